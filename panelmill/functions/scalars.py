"""Scalar functions as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
Z95 = NormalDist().inv_cdf(0.975)
#: Albers conic origin (latitude, longitude) and standard parallels, in degrees.
ALBERS = (23.0, -96.0, 29.5, 45.5)
#: Postal codes of the states and the federal district.
STATES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def metro_key(name: Column) -> Column:
    """Struct (city, state): the part before the first comma up to ``-`` or ``/``, and the part after
    the last comma up to ``-``; both trimmed and in lower case, state empty without a comma."""
    city = F.element_at(F.split(F.element_at(F.split(name, ","), 1), "[-/]"), 1)
    state = F.when(name.contains(","), F.element_at(F.split(F.element_at(F.split(name, ","), -1), "-"), 1)).otherwise("")
    return F.struct(F.lower(F.trim(city)).alias("city"), F.lower(F.trim(state)).alias("state"))


def padded_code(x: Column, width: int) -> Column:
    """Digits of x without a trailing ``.0``, left-padded with zeros; longer codes are not cut."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(x.cast("string")), r"\.0$", ""), "[^0-9]", "")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def bare_code(x: Column) -> Column:
    """Code without leading zeros."""
    return F.regexp_replace(F.trim(x), "^0+", "")


def tolerant_double(x: Column) -> Column:
    """Number, or null where the text is none; NaN counts as null."""
    v = F.trim(x).try_cast("double")
    return F.when(~F.isnan(v), v)


def month_start(yyyymm: Column) -> Column:
    """First day of a ``YYYYMM`` month, null if malformed."""
    text = yyyymm.cast("string")
    return F.when(text.rlike("^[0-9]{4}(0[1-9]|1[0-2])$"), F.make_date(F.substring(text, 1, 4).try_cast("int"), F.substring(text, 5, 2).try_cast("int"), F.lit(1)))


def decimal_year(ym: Column) -> Column:
    return F.substring(ym, 1, 4).cast("double") + (F.substring(ym, 6, 2).cast("double") - 1) / 12


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def albers(lat: Column, lon: Column) -> Column:
    """Struct (x, y) of the Albers equal-area conic projection on the unit sphere."""
    lat0, lon0, s1, s2 = (F.radians(F.lit(v)) for v in ALBERS)
    n = (F.sin(s1) + F.sin(s2)) / 2
    c = F.pow(F.cos(s1), 2) + 2 * n * F.sin(s1)
    rho = F.sqrt(c - 2 * n * F.sin(F.radians(lat))) / n
    rho0 = F.sqrt(c - 2 * n * F.sin(lat0)) / n
    theta = n * (F.radians(lon) - lon0)
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))


def retained_share(j: Column, q: Column, r: Column) -> Column:
    return F.pow(1 - 1 / j, (q + 1) * (2 * r + 1))


def effective_dim(ranks: Column, t: Column, n: Column) -> Column:
    return F.aggregate(ranks, F.lit(0).cast("long"), lambda s, r: s + r * (t + n - r))


def rank_penalty(sigma2: Column, t: Column, n: Column, j: Column, c: float = 1.0) -> Column:
    tn = t * n
    return c * sigma2 * F.pow(tn, F.lit(0.125)) * F.greatest(F.lit(1.0), F.log(F.log(tn))) * F.sqrt(F.log(tn * j)) / F.sqrt(1 / t + 1 / n)


def companion_radius(a: Column, b: Column) -> Column:
    """Largest modulus of the roots of z^2 = a z + b."""
    disc = a * a + 4 * b
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when(disc >= 0, F.greatest(F.abs(a + root), F.abs(a - root)) / 2).otherwise(F.sqrt(-b))


def irf(a: Column, b: Column, h: Column) -> Column:
    """Impulse response of an AR(2) after h periods, by recursion; b = 0 gives a^h."""
    zero = F.struct(F.lit(1.0).alias("now"), F.lit(0.0).alias("last"))
    walk = F.aggregate(F.when(h > 0, F.sequence(F.lit(1), h)).otherwise(F.array().cast("array<int>")), zero, lambda s, _: F.struct((a * s["now"] + b * s["last"]).alias("now"), s["now"].alias("last")))
    return walk["now"]


def irf_gradient(a: Column, b: Column, h: Column) -> Column:
    """Struct (da, db): derivatives of the response by both coefficients, by the differentiated recursion."""
    start = F.struct(*(F.lit(v).alias(k) for k, v in (("p", 1.0), ("p1", 0.0), ("da", 0.0), ("da1", 0.0), ("db", 0.0), ("db1", 0.0))))

    def step(s, _):
        return F.struct(
            (a * s["p"] + b * s["p1"]).alias("p"),
            s["p"].alias("p1"),
            (s["p"] + a * s["da"] + b * s["da1"]).alias("da"),
            s["da"].alias("da1"),
            (s["p1"] + a * s["db"] + b * s["db1"]).alias("db"),
            s["db"].alias("db1"),
        )

    walk = F.aggregate(F.when(h > 0, F.sequence(F.lit(1), h)).otherwise(F.array().cast("array<int>")), start, step)
    return F.struct(walk["da"].alias("da"), walk["db"].alias("db"))


def long_run_multiplier(a: Column, b: Column) -> Column:
    return F.try_divide(F.lit(1.0), 1 - a - b)


def delta_se(ga: Column, gb: Column, vaa: Column, vab: Column, vbb: Column) -> Column:
    return F.sqrt(F.greatest(ga * ga * vaa + 2 * ga * gb * vab + gb * gb * vbb, F.lit(0.0)))


def state_token(name: Column, states: list[str] = STATES) -> Column:
    """First two-capital token that is a state."""
    found = F.regexp_extract_all(name, F.lit("([A-Z]{2})"), 1)
    return F.get(F.filter(found, lambda s: s.isin(states)), F.lit(0))


def fixed_decimals(x: Column, digits: int = 3) -> Column:
    """Text with fixed decimals; missing is ``--``."""
    return F.coalesce(F.format_string(f"%.{digits}f", x), F.lit("--"))
