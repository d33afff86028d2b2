"""Spelling variant grouping: a rare-first q-gram prefix filter over the corpus's words.

Words are counted over all documents. Every word of L code points has L - 1 positional bigrams; they are
ordered by how often the bigram stands in the words, then by bigram, then by position. One edit changes at
most two bigrams, so of two near words the first bigram that both keep is among the three rarest of either.
Only those three are joined, and only at positions that one edit allows: words of equal length (a
replacement) keep it in place, of a longer word (an insertion) it stands at the same place or one further.
Candidates whose sets of letters differ too much go, the others are verified by edit distance.

All of it is built-in functions. What is broadcast is one row for each bigram of the alphabet, 90 x 90 at
most. Buckets of one bigram, position and length that hold over ``BUCKET`` words are cut into shards: a word
is indexed in one shard and probes all of them, so no task meets more than ``BUCKET`` words for a probe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import drop_written, table, text_or_empty, written

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form stands at least this many times as often as its variant.
FORM_RATIO = 5
#: One run of a document in this many loses a code point.
SLIPS = 199
PREFIX = 3
BUCKET = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences. Shorter runs
    cannot give such words, so they are not even cut out."""
    long_run = RUN.replace("+", f"{{{LEAST_LENGTH},}}")
    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_or_empty().alias("text"))
    runs = read.select("id", F.explode(F.regexp_extract_all("text", F.lit(long_run), F.lit(0))).alias("found"))
    runs = runs.select("id", F.translate("found", _UPPER, _LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % SLIPS == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters() -> Column:
    """The set of a word's letters as bits: one edit takes one away at most and adds one at most."""
    marks = F.transform(F.split("word", ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(63)).cast("int")))
    return F.aggregate(marks, F.lit(0).cast("long"), lambda all_, one: all_.bitwiseOR(one))


def prefixes(words: DataFrame) -> DataFrame:
    """(word, n, size, letters, gram, pos): the ``PREFIX`` rarest positional bigrams of every word."""
    bigrams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    grams = words.select("word", "n", F.posexplode(bigrams).alias("pos", "gram"))
    often = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("often")))
    rare = grams.join(often, "gram").groupBy("word", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "gram", "pos"))), 1, PREFIX).alias("rare"))
    rare = rare.select("word", "n", F.length("word").alias("size"), _letters().alias("letters"), F.explode("rare").alias("r"))
    return rare.select("word", "n", "size", "letters", "r.gram", "r.pos")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words that differ by exactly one inserted, deleted or replaced code
    point, once, in no fixed order."""
    rows = written(prefixes(words), "spelling-prefixes")
    key = ["gram", "pos", "size"]
    hot = rows.groupBy(*key).count().where(F.col("count") > BUCKET).select(*key, F.ceil(F.col("count") / BUCKET).cast("int").alias("shards"))
    hot = written(hot, "spelling-hot")
    index = rows.join(hot, key, "left").select(*key, F.pmod(F.xxhash64("word"), F.coalesce("shards", F.lit(1))).alias("shard"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("letters").alias("letters_b"))
    places = F.array(*[F.struct((F.col("pos") + p).alias("pos"), (F.col("size") + s).alias("size")) for p, s in ((0, 0), (0, 1), (1, 1))])
    probe = rows.select("gram", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("letters").alias("letters_a"), F.length("word").alias("size_a"), F.explode(places).alias("place")).select("gram", "place.pos", "place.size", "a", "n_a", "letters_a", "size_a")
    shards = F.sequence(F.lit(0).cast("long"), F.coalesce("shards", F.lit(1)).cast("long") - 1)
    probe = probe.join(hot, key, "left").select(*key, F.explode(shards).alias("shard"), "a", "n_a", "letters_a", "size_a")
    met = probe.join(index, [*key, "shard"]).where((F.col("size") > F.col("size_a")) | (F.col("a") < F.col("b")))
    met = met.where(F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2).where(F.levenshtein("a", "b", 1) == 1)
    pairs = written(met.select("a", "n_a", "b", "n_b").distinct(), "spelling-pairs")
    drop_written(rows, hot)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form), by doubling. A form stands ``FORM_RATIO`` times as
    often as its word, so chains end, and no chain of a corpus of n words is longer than log n."""
    reach = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(reach.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        drop_written(reach)
        reach = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return reach


def variants(docs: DataFrame) -> DataFrame:
    """One row for each word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    A null text holds no words; a null doc_id is written as nothing before the colon. Rows that repeat count
    again. Of forms that stand equally often the least in code-point order counts. No words: no rows.
    Extra columns are ignored.
    """
    words = written(word_counts(docs), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    out = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    formed = -F.col("best.less") >= FORM_RATIO * F.col("n")
    out = written(
        out.select("word", F.when(formed, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.less")).alias("form_n")),
        "spelling-forms",
    )
    drop_written(words, pairs)
    ends = roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_qgram_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op13_qgram_prefix": op13_qgram_prefix}

# SQL: the check sum is worked out byte by byte; near words meet in their wildcard and deletion patterns, not in bigrams.
ORACLE_SQL = {
    "op13_qgram_prefix": rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{RUN}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
held AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run),
coded AS (SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS bytes FROM held),
summed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc),
slipped AS (SELECT n, CASE WHEN h % {SLIPS} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, word[1:i - 1] AS head, word[i + 1:] AS tail FROM places),
near AS (
    SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b USING (i, head, tail) WHERE a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.head || c.tail
    UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.head || c.tail),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= {FORM_RATIO} * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b USING (word)),
named AS (SELECT f.word, f.n, f.n_near, f.form_n, min(near.other) AS form FROM forms f LEFT JOIN near ON near.word = f.word AND near.n = f.form_n GROUP BY ALL),
walk AS (SELECT word, word AS at FROM named UNION ALL SELECT walk.word, named.form FROM walk JOIN named ON named.word = walk.at WHERE named.form IS NOT NULL)
SELECT named.word, named.form, walk.at AS root, named.n, CAST(named.n_near AS BIGINT) AS n_near, named.form_n
FROM named JOIN walk ON walk.word = named.word JOIN named e ON e.word = walk.at WHERE e.form IS NULL""",
}
