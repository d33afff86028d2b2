"""The pipeline on the smallest tables, and its stages' decisions."""

from collections import Counter

import corpus_pipeline
import frames


def test_stages_keep_the_columns_and_filter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < docs.count() <= before
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_repeated_keys_and_nulls_pass_every_stage(spark, sf):
    df, rows = frames.awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, df, sf).collect(), df.schema)
    got = Counter(r.doc_id for r in df.collect())
    # null and empty texts stay; one of the texts that repeat is kept, under its least id; no id is changed
    assert got == Counter(i for i, t in rows if t is None or not t.split()) + Counter({900_004: 1, 900_005: 1, 900_006: 1, 900_007: 1, 900_009: 1, 900_010: 1, None: 1, -7: 1, 2**53 + 1: 1, 2**62 + 3: 1})


def test_stages_ask_for_small_batches(spark, sf, monkeypatch):
    def sizes(docs):
        def run(batches):
            for b in batches:
                yield b.select([]).from_pydict({"bytes": [b.nbytes], "rows": [b.num_rows]})

        return docs.mapInArrow(run, "bytes long, rows long")

    monkeypatch.setattr(corpus_pipeline.bpe, "tokens", sizes)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id % 10 as string), 8000) AS text")
    got = corpus_pipeline.encode(spark, docs, sf).collect()
    assert sum(r.rows for r in got) == 3000
    assert max(r.bytes for r in got) < 6_000_000  # 24 MB in one batch by Spark's own bound of 10,000 rows
