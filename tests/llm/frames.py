"""Small document tables with the awkward cases."""

from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"
_SENTENCE = "The river runs past the old mill and under the stone bridge where children fish every summer evening until dark falls over the quiet valley town"


def sample_texts(n: int = 120) -> list[tuple[int, str]]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()


def awkward(spark, extra: list[tuple[int, str | None]] = ()):
    """Rows of (doc_id, text, source, lang, n_chars, labels-like clashing columns): nulls, empty, blank, very long,
    copies, ties, a repeated row, and ids that are null, negative or beyond what a double holds."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (900_001, None),
        (900_002, ""),
        (900_003, " \t\n "),
        (900_004, "one"),
        (900_005, "two words"),
        (900_006, long),
        (900_007, _SENTENCE + " " + _SENTENCE.lower()),
        (900_008, _SENTENCE + " " + _SENTENCE.lower()),
        (900_009, "naïve café — 日本語 \U0001f600 é x y"),
        (900_010, "a" * 50_000),
        (None, _SENTENCE + " " + _SENTENCE.lower()),
        (None, None),
        (None, "mail x.y@z.example.org or password = hunter2222 of nobody " + _SENTENCE[::-1]),
        (-7, "a negative id " + _SENTENCE),
        (2**53 + 1, "large ids one " + _SENTENCE.upper()),
        (2**62 + 3, "large ids two 10.0.0.7 " + _SENTENCE.upper()),
        *extra,
    ]
    rows.append(rows[6])
    data = [(i, t, "src", None, None if t is None else len(t), "clash", 1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long, path string, hash int"), rows


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
