"""Near-duplicate detection with SetSketch registers.

Each document's shingle set is reduced to registers: the minimum of a hash over the set, put on an
exponentially spaced scale and truncated. Registers of a union are the maxima of the registers, and
two registers are equal with a probability that grows with the Jaccard similarity. Steps:

1. Equal sets collapse to one representative, a number that is fixed once the sketches are written.
2. Bands of registers deal representatives into buckets. In every bucket each member meets the least
   one; then, where they lie in different components, up to ``CENTRES`` others. So a bucket gives rows
   in proportion to its members.
3. A joint maximum-likelihood estimate of the similarity, from the counts of greater, smaller and
   equal registers and both set sizes, drops pairs five standard errors below the threshold.
4. The other pairs are confirmed on full sets; components come from the confirmed links.
5. Buckets whose members still lie in several components are gone through exactly: each member outside
   the bucket's largest component meets all members, in a grid of ``BLOCK`` outsiders by ``BLOCK``
   members. Steps 3 and 4 run inside the block, which returns confirmed links only.
6. Before that, members of buckets with over ``HOT`` pairs to go through are thinned: shingles that no
   other such member holds cannot be shared. A member with too few others left can have no link, and of
   two linked sets the one that is not larger must share 2t / (1 + t) of its shingles. So variants of a
   template, of which each has its own words, leave the grid without being compared.

With 24 bands of 5 registers a pair at similarity 0.85 shares no bucket with probability 7e-7.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import drop_since, made, map_batches, perhaps_in, slices, table, text_or_empty, texts_of, written
from panelmill.llm.components import components
from panelmill.llm.wordhash import Words, mix, rolling

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE = 1.001
RATE = 20.0
TOP = 2**16 - 2
CENTRES = 6
BLOCK = 256
HOT = 16_000_000
SLICE = 250_000
_MULT = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SKETCH = "doc_id long, text_id string, n_shingles long, set_id string, registers binary"


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, A-Z in lower case; a text of fewer words
    has its whole word sequence as one shingle, a text without words none."""
    w = Words(texts, lower=True)
    n = w.counts
    h = rolling(w.hashes, width)
    out = []
    starts = w.offsets
    for i, k in enumerate(n.tolist()):
        if k >= width:
            part = h[starts[i] : starts[i] + k - width + 1]
            out.append(np.unique(part))
        elif k:
            out.append(mix(rolling(w.hashes[starts[i] : starts[i] + k], k) + np.uint64(k)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def registers(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch registers (sets x REGISTERS) of consecutive non-empty sets of hashes."""
    out = np.empty((len(offsets), REGISTERS), np.uint16)
    for r in range(REGISTERS):
        least = np.minimum.reduceat(flat * _MULT[r], offsets)
        u = (least.astype(np.float64) + 1.0) / 2.0**64
        x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
        out[:, r] = np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, TOP + 1)
    return out


def likelihood_similarity(n_a: np.ndarray, n_b: np.ndarray, greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity that is likeliest for the register counts, given both set sizes."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 129)[None, :] * most

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    same = np.clip(1 - up - down, 1e-12, 1)
    score = greater[:, None] * np.log(np.clip(up, 1e-12, 1)) + smaller[:, None] * np.log(np.clip(down, 1e-12, 1)) + equal[:, None] * np.log(same)
    return j[np.arange(len(u)), score.argmax(axis=1)]


def least_estimate(threshold: float) -> float:
    return threshold - 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def _sketcher(width: int):
    def run(batch):
        texts = texts_of(batch)
        for a, b in slices(texts, SLICE):
            sets = shingle_sets(texts[a:b], width)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            regs: list = [None] * len(sets)
            ids = [None] * len(sets)
            if len(full):
                flat = np.concatenate(sets)
                offsets = (np.cumsum(sizes) - sizes)[full]
                r = registers(flat, offsets)
                for row, i in enumerate(full.tolist()):
                    regs[i] = r[row].tobytes()
                    ids[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).hexdigest()
            yield batch.column("doc_id").slice(a, b - a), batch.column("text_id").slice(a, b - a), sizes, ids, regs

    return run


def bands_of(registers: Column) -> Column:
    """One 64-bit key for each band."""
    return F.array(*[F.xxhash64(F.lit(b), F.substring(registers, 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)])


def _estimates(threshold: float):
    low = least_estimate(threshold)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["regs_a"]), np.uint16).reshape(-1, REGISTERS)
            y = np.frombuffer(b"".join(pdf["regs_b"]), np.uint16).reshape(-1, REGISTERS)
            est = likelihood_similarity(pdf["n_a"].to_numpy(float), pdf["n_b"].to_numpy(float), (x > y).sum(1), (x < y).sum(1), (x == y).sum(1))
            yield pdf.loc[est >= low, ["a", "b"]]

    return run


def _confirm(percent: int):
    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["set_a"], pdf["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = _common(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _make_sets(width: int):
    def run(batch):
        texts = texts_of(batch)
        for a, b in slices(texts, SLICE):
            yield batch.column("rep").slice(a, b - a), [s.tobytes() for s in shingle_sets(texts[a:b], width)]

    return run


def _shingles_of(batch):
    """(rep, shingle) of every set of a batch, some sets at a time."""
    reps, sets = batch.column("rep").to_pylist(), batch.column("items").to_pylist()
    for k in range(0, len(reps), 256):
        flat = [np.frombuffer(v, np.int64) for v in sets[k : k + 256]]
        yield np.repeat(reps[k : k + 256], [len(v) for v in flat]), np.concatenate(flat)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _leftover(threshold: float, percent: int):
    """Confirmed links between a block of outsiders and a block of members of their bucket.

    An outsider needs one link to each other component, so its likeliest partners go first.
    """
    low = least_estimate(threshold)

    def run(key, pdf):
        x = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(-1, REGISTERS)
        n, rep, comp = (pdf[c].to_numpy() for c in ("n_shingles", "rep", "comp"))
        sets = [np.frombuffer(v, np.uint64) for v in pdf["items"]]
        outside, small = pdf["outside"].to_numpy(bool), pdf["small"].to_numpy(bool)
        members = np.flatnonzero(~outside)
        found = []
        for i in np.flatnonzero(outside).tolist():
            near = members[(comp[members] != comp[i]) & (n[members] >= threshold * n[i]) & (n[members] * threshold <= n[i]) & np.where(n[members] == n[i], small[i] | small[members], np.where(n[members] > n[i], small[i], small[members]))]
            if not len(near):
                continue
            y = x[near]
            est = likelihood_similarity(np.full(len(near), float(n[i])), n[near].astype(float), (x[i] > y).sum(1), (x[i] < y).sum(1), (x[i] == y).sum(1))
            linked: set[int] = set()
            for k in np.argsort(-est, kind="stable").tolist():
                m = near[k]
                if est[k] < low:
                    break
                if comp[m] not in linked and 100 * (c := _common(sets[i], sets[m])) >= percent * (len(sets[i]) + len(sets[m]) - c):
                    linked.add(comp[m])
                    found.append((min(rep[i], rep[m]), max(rep[i], rep[m])))
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")

    return run


def _thinned(kept: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """The open buckets' members that can have a link; ``small``: also to a set that is not smaller.

    Only members of hot buckets are looked at. A shingle is counted over all of them, so one that is met
    once is shared with no other member of any hot bucket.
    """
    size = F.col("n_outside") * F.col("n")
    hot = kept.where(size > HOT).select("rep").distinct()
    held = profiles.join(hot, "rep")
    lone = map_batches(held.select("rep", "items"), _shingles_of, "rep long, shingle long").groupBy("shingle").agg(F.count("*").alias("times"), F.min("rep").alias("rep")).where("times = 1").groupBy("rep").agg(F.count("*").alias("lone"))
    shared = F.col("n_shingles") - F.coalesce("lone", F.lit(0))
    # a little less than the bounds, as they are compared in floating point
    able = held.select("rep", "n_shingles").join(lone, "rep", "left").where(shared >= (threshold - 1e-9) * F.col("n_shingles"))
    able = able.select("rep", (shared >= (2 * threshold / (1 + threshold) - 1e-9) * F.col("n_shingles")).alias("small"))
    thin = kept.where(size > HOT).join(able, "rep")
    return kept.where(size <= HOT).withColumn("small", F.lit(True)).unionByName(thin.select(*kept.columns, "small"))


def _winners(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Every row of ``docs`` with its text_id, n_shingles and its group's least (doc_id, text_id), null ids last."""
    threshold = percent / 100
    spark = docs.sparkSession
    mark = made(spark)
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_id", F.md5("text"))
    sketches = written(map_batches(texts, _sketcher(width), _SKETCH).withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id")
    reps = written(
        sketches.where("n_shingles > 0").groupBy("set_id").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "representatives",
    )
    keyed = reps.select("rep", F.explode(bands_of(F.col("registers"))).alias("band"))
    buckets = keyed.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1")
    members = written(keyed.join(buckets, "band").select("band", "rep", "least"), "buckets")
    # the text of a set is one of its least (doc_id, text_id)
    held = written(members.select("rep").distinct().join(reps.select("rep", "n_shingles", "registers", "first.doc_id", "first.text_id"), "rep"), "members")
    near = perhaps_in(texts, held, "doc_id", "text_id").where("_perhaps").alias("t")
    near = held.select("rep", "doc_id", "text_id").alias("r").join(near, F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.text_id") == F.col("t.text_id"))).select("r.rep", "t.text")
    side = held.select("rep", "n_shingles", "registers")
    profiles = written(map_batches(near, _make_sets(width), "rep long, items binary").dropDuplicates(["rep"]).join(side, "rep"), "profiles")
    sets = profiles.select("rep", "items")

    def links_of(met: DataFrame) -> DataFrame:
        """Confirmed links among candidate pairs (rep, centre)."""
        pairs = met.where("rep != centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        pairs = pairs.join(side.toDF("a", "n_a", "regs_a"), "a").join(side.toDF("b", "n_b", "regs_b"), "b")
        pairs = pairs.where((F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a")))
        pairs = written(pairs.mapInPandas(_estimates(threshold), "a long, b long"), "pairs")
        full = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return full.mapInPandas(_confirm(percent), "a long, b long")

    def placed_in(comps: DataFrame) -> DataFrame:
        return members.join(comps.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    comps = components(links_of(members.select("rep", F.col("least").alias("centre"))))
    # second round: a few more centres, only where they lie in another component
    slot = F.pmod(F.xxhash64("rep"), F.lit(CENTRES))
    placed = placed_in(comps)
    chosen = [F.when(slot == i, F.col("rep")) for i in range(CENTRES)]
    centres = placed.groupBy("band").agg(F.array(*[F.struct(F.min(c).alias("rep"), F.min_by("comp", c).alias("comp")) for c in chosen]).alias("centres"))
    met = placed.join(centres, "band").select("rep", "comp", F.explode("centres").alias("centre")).where("centre.comp != comp").select("rep", F.col("centre.rep").alias("centre"))
    more = written(links_of(met), "links")
    if not more.isEmpty():
        comps = components(comps.unionByName(more))
    placed = placed_in(comps).select("band", "rep", "comp")
    split = placed.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("comps"), F.sum("n").alias("size"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    split = split.where("comps > 1 and size > 2")
    kept = placed.join(split, "band").withColumn("outside", F.col("comp") != F.col("main"))
    # buckets with the same members are gone through once
    same = kept.groupBy("band").agg(F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"), F.sum(F.col("outside").cast("long")).alias("n_outside"))
    once = same.groupBy("sum", "n").agg(F.min_by(F.struct("band", "n_outside"), "band").alias("one")).select("one.band", "one.n_outside", "n")
    kept = written(kept.select("band", "rep", "comp", "outside").join(once, "band"), "open-buckets")
    if not kept.where(F.col("n_outside") * F.col("n") > HOT).isEmpty():
        kept = _thinned(kept, profiles, threshold).drop("n", "n_outside")
        sizes = kept.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.col("outside").cast("long")).alias("n_outside"), F.max("small").alias("any_small")).where("any_small and n_outside > 0")
        kept = written(kept.join(sizes.drop("any_small"), "band"), "thinned-buckets")
    else:
        kept = kept.withColumn("small", F.lit(True))
    if not kept.isEmpty():
        rows, cols = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_outside", "n"))

        def each(n):
            return F.explode(F.sequence(F.lit(0), n - 1))

        def one(n, salt: int):
            return F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")

        take = ("band", "row", "col", "rep", "comp", "outside", "small")
        down = kept.where("outside").withColumn("row", one(rows, 1)).withColumn("col", each(cols)).select(*take)
        across = kept.withColumn("outside", F.lit(False)).withColumn("col", one(cols, 2)).withColumn("row", each(rows)).select(*take)
        blocks = down.unionByName(across).join(profiles, "rep")
        extra = written(blocks.groupBy("band", "row", "col").applyInPandas(_leftover(threshold, percent), "a long, b long"), "links")
        if not extra.isEmpty():
            comps = components(comps.unionByName(extra))
    # the least document of every group, over sets first; only sets with copies or links travel
    named = reps.join(comps.toDF("rep", "comp"), "rep", "left").select("set_id", "first", "copies", F.coalesce("comp", "rep").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first").alias("winner"), F.sum("copies").alias("rows")).where("rows > 1")
    named = written(named.select("set_id", "comp").join(least, "comp").select("set_id", "winner"), "groups")
    drop_since(spark, mark, sketches, named)
    return sketches.select("doc_id", "text_id", "n_shingles", "set_id").join(named, "set_id", "left").drop("set_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Links: 100 * intersection >= percent * union of the word-shingle sets. Null and empty texts have no
    shingles and stay alone. component_id is the least doc_id of the group that is not null, null where
    the group has none; a row is kept if its doc_id equals it, null for null. Rows that repeat a doc_id are
    all returned, with equal components if their texts link. Extra columns are ignored. An empty table
    gives an empty result.
    """
    out = _winners(docs, width, percent)
    label = F.when(F.col("winner").isNull(), F.col("doc_id")).otherwise(F.col("winner.doc_id"))
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of ``docs``, all columns kept: the one of the least doc_id (null ids last), of
    several texts under that id the one of the least MD5, of rows that repeat both any one. Rows without
    words stay."""
    spark = docs.sparkSession
    mark = made(spark)
    out = _winners(docs.select("doc_id", "text"), width, percent).where("winner is not null")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id")
    out = written(out.groupBy("doc_id", "text_id").agg(F.count("*").alias("rows"), F.min(first == F.col("winner")).alias("stays")).where("rows > 1 or not stays"), "near-duplicates")
    drop_since(spark, mark, out)
    marked = out.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_met"), "stays")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_met"))
    # texts that are surely unmarked do not travel
    keyed = perhaps_in(docs.withColumn("_text", F.md5(text_or_empty())), out.withColumnRenamed("text_id", "_text"), "doc_id", "_text")
    near = keyed.where("_perhaps")
    alone = keyed.where("NOT _perhaps").select(docs.columns).unionByName(near.join(marked, on, "left_anti").select(docs.columns))
    repeated = marked.where("stays")
    if repeated.isEmpty():
        return alone
    return alone.unionByName(near.join(repeated, on, "left_semi").dropDuplicates(["doc_id", "_text"]).select(docs.columns))


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=3, percent=85)


QUERIES = {"op4_setsketch": op4_setsketch}

ORACLE_SQL = {
    "op4_setsketch": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
items AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[s : s + 2], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS s FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
least AS (SELECT a AS doc_id, least(a, min(b)) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m, doc_id) AS BIGINT) AS component_id, coalesce(m, doc_id) = doc_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)""",
}
