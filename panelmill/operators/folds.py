"""Cross-fitting folds with a forward exclusion window, as frames (t_ix, unit_ix, fold)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checker(cells: DataFrame, j: int) -> DataFrame:
    return cells.withColumn("fold", F.pmod(F.col("t_ix") + F.col("unit_ix"), F.lit(j)).cast("int"))


def contiguous(cells: DataFrame, j: int, periods: int) -> DataFrame:
    return cells.withColumn("fold", F.least(F.floor(F.col("t_ix") * j / periods), F.lit(j - 1)).cast("int"))


def scatter(cells: DataFrame, j: int, seed: int) -> DataFrame:
    """Near-balanced pseudo-random ids: ranks of a seeded hash within the period, shifted by period.
    The rank window runs by period, so no task holds the whole panel."""
    rank = F.row_number().over(Window.partitionBy("t_ix").orderBy(F.xxhash64(F.lit(seed), "t_ix", "unit_ix"), "unit_ix"))
    return cells.withColumn("fold", F.pmod(rank + F.pmod(F.xxhash64(F.lit(seed), "t_ix"), F.lit(j)), F.lit(j)).cast("int"))


def scatter_balanced(cells: DataFrame, j: int, seed: int) -> DataFrame:
    """Pseudo-random ids whose sizes differ by one at most over all cells: the rank of each cell by a seeded hash, modulo
    ``j``. Cells (t_ix, unit_ix, one row each) are dealt into ranges of the hash and ranked inside each; a range's
    first rank is the sum of the sizes before it. Only one count a range is gathered, and no task holds the panel."""
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("t_ix").cast("string"), F.col("unit_ix").cast("string")).cast("binary"))
    parts = max(2, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # hash digits are spread evenly, so ranges of their first four need no sampling
    bucket = F.floor(F.conv(F.substring("code", 1, 4), 16, 10).cast("long") * parts / 65536).cast("int")
    keyed = cells.withColumn("code", code).withColumn("bucket", bucket)
    sizes = keyed.groupBy("bucket").count()
    before = sizes.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("code", "t_ix", "unit_ix"))
    ranked = keyed.withColumn("rank", rank).join(F.broadcast(before), "bucket")
    return ranked.withColumn("fold", F.pmod(F.col("before") + F.col("rank") - 1, F.lit(j)).cast("int")).select(*cells.columns, "fold")


def purged_sets(folds: DataFrame, j: int, q: int, r: int = 0) -> DataFrame:
    """(t_ix, unit_ix, fold, trains ARRAY<INT>): the folds that a cell trains, one row a cell however many folds there are.
    The folds held out near a cell are gathered as a set by the same windows that ``purged`` runs for each fold."""
    near = F.collect_set("fold").over(Window.partitionBy("unit_ix").orderBy("t_ix").rangeBetween(-q, 0))
    out = folds.select("t_ix", "unit_ix", "fold", near.alias("near"))
    if r:
        beside = F.collect_set("near").over(Window.partitionBy("t_ix").orderBy("unit_ix").rangeBetween(-r, r))
        out = out.withColumn("near", F.array_distinct(F.flatten(beside)))
    return out.select("t_ix", "unit_ix", "fold", F.array_except(F.sequence(F.lit(0), F.lit(j - 1)), "near").alias("trains"))


def purged(folds: DataFrame, j: int, q: int, r: int = 0) -> DataFrame:
    """(fold j, t_ix, unit_ix, is_val, is_train): a cell trains fold j unless held out, or within q periods
    after and r units beside a held-out cell. The windows see a cell once; only their result is copied by fold."""
    each = F.explode(F.sequence(F.lit(0), F.lit(j - 1)))
    out = purged_sets(folds, j, q, r).select(each.alias("j"), "t_ix", "unit_ix", "fold", "trains")
    return out.select("j", "t_ix", "unit_ix", (F.col("fold") == F.col("j")).alias("is_val"), F.array_contains("trains", F.col("j")).alias("is_train"))


def fold_meta(masks: DataFrame) -> DataFrame:
    """Held-out share p, training cells, and scale of every fold."""
    out = masks.groupBy("j").agg(F.avg(F.col("is_val").cast("int")).alias("p"), F.sum(F.col("is_train").cast("long")).alias("n_train"), F.count("*").alias("n"))
    return out.select("j", "p", "n_train", (F.col("n") / F.greatest("n_train", F.lit(1))).alias("alpha"))


def least_row_support(masks: DataFrame) -> DataFrame:
    """Fewest training cells of any period, by fold."""
    return masks.groupBy("j", "t_ix").agg(F.sum(F.col("is_train").cast("long")).alias("s")).groupBy("j").agg(F.min("s").alias("min_support"))
