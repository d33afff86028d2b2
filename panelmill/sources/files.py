"""File sources and sinks: wide and long CSV panels, fixed-schema files, lookups, records, reports.

Readers attach a position where the first or the last row of a key wins: Spark keeps no file order
after a shuffle, so the position is the row number within the file, taken before any exchange.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import scalars as S
from panelmill.operators import panel as P


def looks_like_date(name: str) -> bool:
    """At least six characters, four leading digits, and a ``-`` or ``/``."""
    return len(name) >= 6 and name[:4].isdigit() and ("-" in name or "/" in name)


def column_with_words(columns: list[str], words: list[str]) -> str:
    """First column whose name holds all words, whatever their case."""
    for c in columns:
        if all(w.lower() in c.lower() for w in words):
            return c
    raise KeyError(f"no column with {words}")


def column_any_case(columns: list[str], name: str) -> str:
    for c in columns:
        if c.strip().lower() == name.lower():
            return c
    raise KeyError(name)


def trimmed_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _positioned(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.monotonically_increasing_id())


def wide_csv(spark: SparkSession, path: str, kind: str = "msa", start: str | None = None, end: str | None = None) -> DataFrame:
    """(name, ym, value, position) of a wide file: third column the name, fourth the type, one column for
    each date header. Only rows of ``kind`` and months in the inclusive window; bad numbers are null."""
    df = _positioned(spark.read.csv(path, header=True))
    name, type_ = df.columns[2], df.columns[3]
    dates = [c for c in df.columns if looks_like_date(c) and (start is None or c[:7] >= start) and (end is None or c[:7] <= end)]
    rows = df.where(F.col(f"`{type_}`") == kind).select(F.col(f"`{name}`").alias("name"), "position", *[F.col(f"`{c}`").cast("string").alias(c) for c in dates])
    long = rows.unpivot(["name", "position"], [F.col(f"`{c}`") for c in dates], "ym", "value")
    return long.select("name", F.substring(F.regexp_replace("ym", "/", "-"), 1, 7).alias("ym"), S.tolerant_double(F.col("value")).alias("value"), "position")


def two_tiers(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Units (name, tier) of names in both frames, complete over the window; a repeated name's last row wins."""
    def one(df: DataFrame, tier: str) -> DataFrame:
        return P.last_wins(df, ["name", "ym"], "position").withColumn("tier", F.lit(tier))

    a, b = one(top, "top"), one(bottom, "bottom")
    both = a.select("name").intersect(b.select("name"))
    union = a.unionByName(b).join(both, "name", "left_semi")
    months = union.agg(F.countDistinct("ym").alias("months"))
    whole = union.groupBy("name", "tier").agg(F.count("value").alias("n")).join(F.broadcast(months), F.col("n") == F.col("months")).select("name", "tier")
    return union.join(whole, ["name", "tier"], "left_semi").drop("position")


def metro_wide(spark: SparkSession, path: str) -> DataFrame:
    """(year, unit, value) of a file with YEAR and one column for each unit."""
    df = trimmed_header(spark.read.csv(path, header=True))
    year, units = df.columns[0], df.columns[1:]
    long = df.select(F.col(f"`{year}`").try_cast("int").alias("year"), *[F.col(f"`{u}`").cast("string").alias(u) for u in units]).unpivot(["year"], [F.col(f"`{u}`") for u in units], "unit", "value")
    return long.withColumn("value", S.tolerant_double(F.col("value")))


def long_panel(spark: SparkSession, path: str, unit: str, date: str, value: str, start: str | None = None, end: str | None = None, most_missing: int = 6) -> DataFrame:
    """(unit, ym, value) on the full grid of units with at most ``most_missing`` gaps; the last row of a
    repeated (unit, month) wins."""
    df = _positioned(spark.read.csv(path, header=True)).select(F.trim(F.col(unit)).alias("unit"), F.substring(F.col(date), 1, 7).alias("ym"), S.tolerant_double(F.col(value)).alias("value"), "position")
    df = df.where(F.lit(True) if start is None else F.col("ym") >= start).where(F.lit(True) if end is None else F.col("ym") <= end)
    rows = P.last_wins(df, ["unit", "ym"], "position").drop("position")
    grid = rows.select("unit").distinct().crossJoin(rows.select("ym").distinct()).join(rows, ["unit", "ym"], "left")
    keep = grid.groupBy("unit").agg(F.sum(F.col("value").isNull().cast("int")).alias("gaps")).where(F.col("gaps") <= most_missing)
    return grid.join(keep.select("unit"), "unit", "left_semi")


def covariate_lookup(spark: SparkSession, path: str, code: str, date: str, columns: list[str]) -> DataFrame:
    """(code, ym, columns): bare codes, tolerant numbers, last row wins."""
    df = _positioned(spark.read.csv(path, header=True))
    rows = df.select(S.bare_code(F.col(code)).alias("code"), F.substring(F.col(date), 1, 7).alias("ym"), *[S.tolerant_double(F.col(c)).alias(c) for c in columns], "position")
    return P.last_wins(rows, ["code", "ym"], "position").drop("position")


def crosswalk(spark: SparkSession, path: str, name: str, code: str) -> DataFrame:
    """(city, state, code) by metro key; the first row wins."""
    df = _positioned(spark.read.csv(path, header=True))
    rows = df.select(S.metro_key(F.col(name)).alias("k"), S.padded_code(F.col(code), 5).alias("code"), "position").select("k.city", "k.state", "code", "position")
    return P.first_wins(rows, ["city", "state"], "position").drop("position")


def centroids(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """(code, lat, lon, matched) for every row of ``codes``."""
    df = trimmed_header(spark.read.csv(path, header=True)).select(F.trim(F.col("cbsa")).alias("code"), S.tolerant_double(F.col("lat")).alias("lat"), S.tolerant_double(F.col("lon")).alias("lon"))
    return codes.join(df.dropDuplicates(["code"]), "code", "left").withColumn("matched", F.col("lat").isNotNull())


def build_centroids(spark: SparkSession, path: str, encoding: str = "iso-8859-1") -> DataFrame:
    """(cbsa, lat, lon) as text from a local tab-separated gazetteer; headers may carry white space. The code is
    column CBSAFP, else GEOID; rows without a code or a coordinate are left out."""
    df = trimmed_header(spark.read.csv(path, sep="\t", header=True, encoding=encoding))
    by_name = {c.upper(): c for c in df.columns}
    column = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{by_name[n]}`")), F.lit("")) for n in names if n in by_name], F.lit(None))
    out = df.select(column("CBSAFP", "GEOID").alias("cbsa"), column("INTPTLAT").alias("lat"), column("INTPTLONG").alias("lon"))
    return out.where("cbsa IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def write_centroids(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def annual_series(spark: SparkSession, series_path: str, data_path: str, years: int, prefix: str = "LAUMT", suffix: str = "3", area: str = "B", measure: str = "03", period: str = "M13") -> DataFrame:
    """(unit, year, value) of tab-separated series and data tables: one area type and measure, annual rows,
    units seen in all ``years``; repeated names get `` #k``. Columns go by position."""
    tab = {"sep": "\t", "header": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    s = spark.read.csv(series_path, **tab)
    c = s.columns
    s = s.select(F.trim(F.col(f"`{c[0]}`")).alias("id"), F.trim(F.col(f"`{c[1]}`")).alias("area"), F.trim(F.col(f"`{c[3]}`")).alias("measure"), F.trim(F.col(f"`{c[6]}`")).alias("title"))
    s = s.where((F.col("area") == area) & (F.col("measure") == measure) & F.col("id").startswith(prefix) & F.col("id").endswith(suffix))
    s = s.withColumn("title", F.trim(F.regexp_replace("title", r"^[^:]*:\s*|\s*\([A-Z]\)$", "")))
    d = spark.read.csv(data_path, **tab)
    c = d.columns
    d = d.select(F.trim(F.col(f"`{c[0]}`")).alias("id"), F.trim(F.col(f"`{c[1]}`")).try_cast("int").alias("year"), F.trim(F.col(f"`{c[2]}`")).alias("period"), S.tolerant_double(F.col(f"`{c[3]}`")).alias("value")).where(F.col("period") == period)
    rows = d.join(s, "id")
    whole = rows.groupBy("id").agg(F.countDistinct(F.when(F.col("value").isNotNull(), F.col("year"))).alias("n")).where(F.col("n") == years).select("id")
    names = s.join(whole, "id", "left_semi").select("id", "title")
    names = names.select("id", P.numbered_duplicates(names, "title", "id").alias("unit"))
    return rows.join(names, "id").select("unit", "year", "value")


def write_wide(panel: DataFrame, path: str) -> None:
    """One row for each year, one column for each unit, one decimal."""
    units = sorted(r[0] for r in panel.select("unit").distinct().collect())
    wide = panel.groupBy("year").pivot("unit", units).agg(F.format_string("%.1f", F.first("value"))).orderBy("year")
    wide.coalesce(1).write.mode("overwrite").csv(path, header=True)


def dated_files(names: list[str], since: int = 2000) -> list[tuple[str, int, int]]:
    """(name, year, month) of names that end in a four-digit yyMM before the extension, in time order;
    years from 50 on are of the last century."""
    out = []
    for n in names:
        m = re.search(r"(\d{2})(\d{2})[a-z]?\.(?:txt|csv)$", n, re.I)
        if m and 1 <= int(m[2]) <= 12:
            year = int(m[1]) + (1900 if int(m[1]) >= 50 else 2000)
            if year >= since:
                out.append((n, year, int(m[2])))
    return sorted(out, key=lambda r: r[1:] + r[:1])


#: Structure classes and measures of a permit file, after five leading columns.
PERMIT_CLASSES = ("101", "103", "104", "105")
PERMIT_COLUMNS = ["period", "csa_code", "cbsa_code", "header_code", "cbsa_name", *[f"{k}_{c}_{m}" for k in ("imp", "rep") for c in PERMIT_CLASSES for m in ("bldgs", "units", "value")]]


def permits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(cbsa_code, cbsa_name, date, units, value) of headerless permit files: imputed counts over structure
    classes, missing as zero; national and summary rows go."""
    df = spark.read.schema(", ".join(f"{c} string" for c in PERMIT_COLUMNS)).csv(paths)
    total = lambda m: sum((F.coalesce(S.tolerant_double(F.col(f"imp_{c}_{m}")), F.lit(0.0)) for c in PERMIT_CLASSES), F.lit(0.0))
    out = df.select(S.padded_code(F.col("cbsa_code"), 5).alias("cbsa_code"), F.trim("cbsa_name").alias("cbsa_name"), S.month_start(F.trim("period")).alias("date"), total("units").alias("units"), total("value").alias("value"), F.trim("header_code").alias("header_code"))
    return out.where("date is not null and cbsa_code <> '99999' and coalesce(header_code, '') <> '5'").drop("header_code")


def permit_panel(rows: DataFrame) -> DataFrame:
    """Sums by (code, month), the first name of each code, and the 12-row change of units."""
    names = rows.groupBy("cbsa_code").agg(F.min_by("cbsa_name", "date").alias("cbsa_name"))
    sums = rows.groupBy(F.col("cbsa_code").alias("unit_ix"), F.col("date").alias("t_ix")).agg(F.sum("units").alias("units"), F.sum("value").alias("value"))
    out = sums.withColumn("units_pct_change_12m", P.pct_change("units", 12))
    return out.withColumnsRenamed({"unit_ix": "cbsa_code", "t_ix": "date"}).join(names, "cbsa_code", "left")


def county_series(spark: SparkSession, path: str, value: str, since: int) -> DataFrame:
    """(county_fips, year, value) of a local JSON dump with GeoFips, TimePeriod, DataValue: commas go, no
    totals, 5-digit counties only."""
    df = spark.read.json(path)
    out = df.select(F.trim("GeoFips").alias("county_fips"), F.col("TimePeriod").try_cast("int").alias("year"), S.tolerant_double(F.regexp_replace("DataValue", ",", "")).alias(value))
    return out.where(F.col("county_fips").rlike("^[0-9]{5}$") & ~F.col("county_fips").endswith("000") & (F.col("year") >= since))


def county_to_metro(counties: DataFrame, xwalk: DataFrame, value: str) -> DataFrame:
    """Inner join on the county, then sums by (code, year); missing counts as zero."""
    return counties.join(xwalk.select("county_fips", "cbsa_code"), "county_fips").groupBy("cbsa_code", "year").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """First 16 hexadecimal digits of a file's SHA-256; of two files, 8 and 8."""
    size = 16 if len(paths) == 1 else 16 // len(paths)
    rows = spark.read.format("binaryFile").load(paths).select("path", F.substring(F.sha2("content", 256), 1, size).alias("h")).collect()
    by = {r["path"].rsplit("/", 1)[-1]: r["h"] for r in rows}
    return "".join(by[p.rsplit("/", 1)[-1]] for p in paths)


def read_records(spark: SparkSession, path: str) -> DataFrame | None:
    """Records under ``path``, one for each (config, rep, target); None where there are none yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.option("basePath", path).parquet(path).dropDuplicates(["config", "rep", "target"])


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON lines file; malformed lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def write_json(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def write_text(text: str, path: str) -> None:
    with open(path, "w") as f:
        f.write(text)


def geojson_rings(spark: SparkSession, path: str) -> DataFrame:
    """(name, part, k, lon, lat): points of the outer rings of polygons and multipolygons."""
    df = spark.read.option("multiLine", True).schema("features array<struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:string>>>").json(path)
    f = df.select(F.explode("features").alias("f")).select("f.properties.name", "f.geometry.type", "f.geometry.coordinates")
    multi = F.from_json("coordinates", "array<array<array<array<double>>>>")
    single = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    parts = f.select("name", F.posexplode(F.when(F.col("type") == "MultiPolygon", multi).otherwise(single)).alias("part", "polygon"))
    return parts.select("name", "part", F.posexplode(F.col("polygon")[0]).alias("k", "p")).select("name", "part", "k", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
