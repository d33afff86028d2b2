"""Side-by-side comparison of a query with its SQL."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, f"{v:.4f}")
    return (2, str(v))


def difference(df, con, sql: str) -> str:
    """Empty if rows agree (floats to 2e-6), else what differs."""
    got_cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    if sorted(names) != got_cols:
        return f"columns {got_cols} and {sorted(names)}"
    order = [names.index(c) for c in got_cols]
    want = sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(map(_key, r)))
    got = sorted((tuple(r) for r in df.select(*got_cols).collect()), key=lambda r: tuple(map(_key, r)))
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and y is not None:
                if not math.isclose(x, float(y), rel_tol=1e-9, abs_tol=2e-6):
                    return f"{a} and {b}"
            elif x != y:
                return f"{a} and {b}"
    return ""
