"""Report text and the command line."""

import json

import pandas as pd

from panelmill import __main__ as cli
from panelmill.functions import report as R


def test_points_and_numbers():
    assert R.number(None) == "--" and R.number(float("nan")) == "--" and R.number(1.25, 1) == "1.2"
    assert [round(v, 4) for _, v in R.irf_points(0.5, 0.2, 3)] == [1.0, 0.5, 0.45, 0.325]
    assert R.root_points(0.9, 0.0) == [(0.9, 0.0), (0.0, 0.0)]
    assert round(abs(complex(*R.root_points(1.25, -0.419)[0])), 3) == 0.647
    assert R.path_points(["2020-07"], [1.0]) == [(2020.5, 1.0)]
    assert R.bar_points(pd.DataFrame({"bin": [0, 1], "n": [3, 4]}), 0.0, 1.0) == [(0.25, 3.0), (0.75, 4.0)]
    assert R.tex_table(pd.DataFrame({"target": ["lag_entry"], "v": [0.5]}), ["target", "v"]) == r"lag\_entry & 0.500 \\"


def test_stage_configs():
    c = {"tuning": {"folds": 3}, "purge": {"sizes": [[10, 8]], "qs": [0, 2]}}
    assert [x["q"] for x in cli.simulation_configs(c, "purge")] == [0, 2]


def test_grid_stage(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"tuning": {"folds": 3, "q": 1, "sweeps": 6, "restarts": 1, "levels": 2}, "grid": {"sizes": [[12, 10]], "reps": 2}}))
    cli.main(["--config", str(p), "--stage", "grid", "--out", f"file://{tmp_path}/out"])
    rows = spark.read.json(f"file://{tmp_path}/out/grid").collect()
    assert len(rows) == 8 and {r.reps for r in rows} == {2}


def _aggregates():
    rows = [(json.dumps({"q": q, "oracle": o}), t, 0.01 * q, 0.1 + q, 0.2, 0.3, 0.9 + 0.01 * q, 0.5) for q in (0, 1) for o in (True, False) for t in ("lag_entry", "slope_fmean")]
    return pd.DataFrame(rows, columns=["config", "target", "bias", "rmse", "mean_se", "sd", "coverage", "length"])


def test_simulation_tables():
    a = _aggregates()
    one = R.console_table(a[:2], "title").split("\n")
    assert one[0] == "title" and one[1].split() == ["target", "bias", "rmse", "mean_se", "sd", "coverage"] and one[2].split() == ["lag_entry", "0.0000", "0.1000", "0.2000", "0.3000", "0.9000"]
    both = R.oracle_vs_feasible(a)
    assert list(both["target"]) == ["lag_entry", "slope_fmean"] and {"coverage_oracle", "coverage_feasible"} <= set(both.columns)
    purge = R.purge_table(a)
    assert list(purge["q"]) == [0, 1] and abs(purge["coverage"][1] - 0.91) < 1e-12


def test_lines_by_specification():
    rows = [(s, sec, q, "all", v) for s in "AB" for sec, q, v in (("target", "lag1", 0.5), ("dynamics", "companion_radius", 0.6), ("sample", "units", 9.0), ("homogeneous", "beta1", 1.0))]
    out = R.by_specification(pd.DataFrame(rows, columns=["spec", "section", "quantity", "grp", "estimate"]))
    assert list(out["spec"]) == ["A", "B"] and list(out["lag1"]) == [0.5, 0.5] and out["lag2"].isna().all()
