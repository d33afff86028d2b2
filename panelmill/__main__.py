"""Stages from the command line: python -m panelmill --config FILE --stage NAME [--only KEY] --out DIR."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

STAGES = ("oracle", "grid", "purge", "theorems", "empirical")


def simulation_configs(config: dict, stage: str) -> list[dict]:
    """Replication settings of a stage: the ``tuning`` section under each size of its own section."""
    base = dict(config.get("tuning", {}))
    own = config.get(stage, {})
    sizes = own.get("sizes", [[own.get("t", 24), own.get("n", 24)]])
    out = [base | {"t": t, "n": n, "oracle": stage in ("oracle", "purge")} for t, n in sizes]
    return [c | {"q": q} for c in out for q in own["qs"]] if stage == "purge" and "qs" in own else out


def main(argv: list[str] | None = None) -> None:
    from panelmill.operators import estimator as E
    from panelmill.operators import montecarlo as M
    from panelmill.plans import registry
    from panelmill.sources.files import read_config, write_json

    parser = argparse.ArgumentParser(prog="panelmill", description=__doc__)
    parser.add_argument("--config", required=True)
    parser.add_argument("--stage", choices=STAGES, required=True)
    parser.add_argument("--only", help="empirical: the query to run; simulations: a single T x N size")
    parser.add_argument("--data", default="/root/testdata/sf0.1", help="folder of the input tables")
    parser.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = read_config(args.config)
    if args.stage == "empirical":
        for name in [args.only] if args.only else ("run_ar2", "housing_specs", "unemployment_specs", "geographic_se", "state_lookup"):
            write_json(registry.queries()[name](spark, args.data), f"{args.out}/{name}")
    elif args.stage == "theorems":
        for name in [args.only] if args.only else ("debiasing_demo", "rank_consistency", "irf_lrm_coverage", "xs_coverage", "contiguous_fold_singular"):
            write_json(registry.queries()[name](spark, args.data), f"{args.out}/{name}")
    else:
        configs = [c for c in simulation_configs(config, args.stage) if not args.only or f"{c['t']}x{c['n']}" == args.only]
        tasks = E.replication_tasks(spark, configs, int(config.get(args.stage, {}).get("reps", 20)))
        write_json(M.aggregate(E.resume_grid(tasks, f"{args.out}/records")), f"{args.out}/{args.stage}")
    print(json.dumps({"stage": args.stage, "out": args.out}))


if __name__ == "__main__":
    main()
