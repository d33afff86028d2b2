"""Text of tables and figure coordinates from small summary frames; rendering runs on the driver."""

from __future__ import annotations

import json
import math

import pandas as pd


def number(x, digits: int = 3) -> str:
    return "--" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.{digits}f}"


def tex_table(rows: pd.DataFrame, columns: list[str], digits: int = 3) -> str:
    """Body of a table: one line for each row, cells joined by ``&``."""
    cell = lambda v: number(float(v), digits) if isinstance(v, float) else str(v).replace("_", r"\_")
    return "\n".join(" & ".join(cell(r[c]) for c in columns) + r" \\" for _, r in rows[columns].iterrows())


def coordinates(points: list[tuple[float, float]], digits: int = 4) -> str:
    return " ".join(f"({number(x, digits)},{number(y, digits)})" for x, y in points)


def irf_points(a: float, b: float, horizon: int = 24) -> list[tuple[float, float]]:
    out, now, last = [], 1.0, 0.0
    for h in range(horizon + 1):
        out.append((float(h), now))
        now, last = a * now + b * last, now
    return out


def root_points(a: float, b: float) -> list[tuple[float, float]]:
    """Real and imaginary parts of both companion roots."""
    disc = a * a + 4 * b
    if disc >= 0:
        r = math.sqrt(disc)
        return [((a + r) / 2, 0.0), ((a - r) / 2, 0.0)]
    r = math.sqrt(-disc)
    return [(a / 2, r / 2), (a / 2, -r / 2)]


def decimal_year(ym: str) -> float:
    return int(ym[:4]) + (int(ym[5:7]) - 1) / 12


def path_points(months: list[str], values: list[float]) -> list[tuple[float, float]]:
    return [(decimal_year(m), v) for m, v in zip(months, values, strict=True)]


def bar_points(counts: pd.DataFrame, low: float, high: float) -> list[tuple[float, float]]:
    """Bin centres and counts of a histogram frame (bin, n)."""
    width = (high - low) / max(len(counts), 1)
    return [(low + (b + 0.5) * width, float(n)) for b, n in zip(counts["bin"], counts["n"], strict=True)]


def main_performance(aggregates: pd.DataFrame) -> str:
    return tex_table(aggregates.sort_values(["config", "target"]), ["target", "reps", "bias", "rmse", "mean_se", "coverage", "coverage_xs"])


def debiased_vs_plugin(aggregates: pd.DataFrame) -> str:
    return tex_table(aggregates.sort_values("target"), ["target", "plugin_bias", "plugin_rmse", "bias", "rmse"])


def by_target_type(aggregates: pd.DataFrame) -> pd.DataFrame:
    """Means over blocks of each target kind."""
    kind = aggregates["target"].str.split("_").str[-1]
    return aggregates.groupby(kind)[["bias", "rmse", "coverage", "length"]].mean().reset_index()


def console_table(aggregates: pd.DataFrame, title: str = "") -> str:
    """Fixed-width lines of bias, errors and coverage by target, under a title and a head."""
    columns = ("bias", "rmse", "mean_se", "sd", "coverage")
    lines = [title] if title else []
    lines.append(f"{'target':<20}" + "".join(f"{c:>10}" for c in columns))
    lines += [f"{r['target']:<20}" + "".join(f"{number(float(r[c]), 4):>10}" for c in columns) for _, r in aggregates.sort_values("target").iterrows()]
    return "\n".join(lines)


def _setting(aggregates: pd.DataFrame, name: str) -> pd.Series:
    return aggregates["config"].map(lambda text: json.loads(text).get(name))


def oracle_vs_feasible(aggregates: pd.DataFrame) -> pd.DataFrame:
    """Errors and coverage by target, with the true spaces and with estimated ones side by side."""
    a = aggregates.assign(spaces=_setting(aggregates, "oracle").map(lambda v: "oracle" if v else "feasible"))
    wide = a.pivot_table(index="target", columns="spaces", values=["rmse", "coverage", "length"])
    wide.columns = [f"{value}_{spaces}" for value, spaces in wide.columns]
    return wide.reset_index()


def purge_table(aggregates: pd.DataFrame) -> pd.DataFrame:
    """Mean coverage, error and length over targets for each exclusion window q."""
    a = aggregates.assign(q=_setting(aggregates, "q"))
    return a.groupby("q")[["coverage", "rmse", "mean_se", "length"]].mean().reset_index()


def by_specification(reports: pd.DataFrame, quantities: tuple[str, ...] = ("lag1", "lag2", "persistence", "companion_radius")) -> pd.DataFrame:
    """One line for each specification: its sizes and the main quantities of a specifications frame."""
    main = reports[(reports["grp"] == "all") & (reports["section"].isin(["target", "dynamics", "sample"]))]
    wide = main.pivot_table(index="spec", columns="quantity", values="estimate")
    return wide.reindex(columns=["units", "periods", *quantities]).reset_index()
