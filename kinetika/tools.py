"""Two jobs for the command line.

``python -m kinetika.tools tune`` chooses a selection threshold on training rows and confirms it on held-out ones.
``python -m kinetika.tools ranks`` shows how much the most important features of a forest change with its seed, beside Boruta's, and holds the
sets of features against each other. Both read Parquet tables of one row per entity and write JSON.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from kinetika.functions.columns import numeric
from kinetika.operators.classifiers import make_classifier
from kinetika.operators.evaluation import compare_feature_sets
from kinetika.operators.selection import BorutaSelector, importance_top_k
from kinetika.operators.tuning import confirm_thresholds, tune_selection_threshold
from kinetika.sources import read_table, write_json_summary


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kinetika.tools", description=__doc__)
    jobs = out.add_subparsers(dest="job", required=True)
    for name, text in (("tune", "choose and confirm a selection threshold"), ("ranks", "stability of the most important features")):
        job = jobs.add_parser(name, help=text)
        for flag in ("--train", "--test", "--label", "--key"):
            job.add_argument(flag, required=True)
        job.add_argument("--positive", help="the positive label; not needed for 0 and 1")
        job.add_argument("--boruta-repeats", type=int, default=20)
        job.add_argument("--trees", type=int, default=500)
        job.add_argument("--seed", type=int, default=0)
        job.add_argument("--fast", action="store_true", help="few repeats and small forests, to try the job out")
        job.add_argument("--out", help="a JSON file for the summary; printed without it")
    jobs.choices["tune"].add_argument("--group", required=True, help="matched rows share it and stay on one side")
    jobs.choices["tune"].add_argument("--n-splits", type=int, default=5)
    jobs.choices["tune"].add_argument("--n-repeats", type=int, default=3)
    jobs.choices["ranks"].add_argument("--top", type=int, default=8)
    jobs.choices["ranks"].add_argument("--n-seeds", type=int, default=20)
    return out


def _features(df: DataFrame, *others: str | None) -> list[str]:
    return [c for c in numeric(df) if c not in others]


def tune(spark: SparkSession, args: argparse.Namespace) -> dict:
    train, test = read_table(spark, args.train), read_table(spark, args.test)
    selector = BorutaSelector(_features(train, args.label, args.group, args.key), args.boruta_repeats, n_estimators=args.trees, random_state=args.seed, max_iter=15 if args.fast else 100)
    model = make_classifier("random_forest", None, args.seed, n_estimators=args.trees)
    found = tune_selection_threshold(train, args.label, args.group, selector=selector, model=model, positive_label=args.positive, n_splits=args.n_splits, n_repeats=args.n_repeats, random_state=args.seed)
    confirmed = confirm_thresholds(found, train, test, args.label, model=model, positive_label=args.positive)
    return {"threshold": found.best_threshold, "features": found.selected_columns_, "curve": [r.asDict() for r in found.curve.collect()], "held_out": [r.asDict() for r in confirmed.collect()]}


def ranks(spark: SparkSession, args: argparse.Namespace) -> dict:
    train, test = read_table(spark, args.train), read_table(spark, args.test)
    features = _features(train, args.label, args.key)
    top = importance_top_k(train, args.label, features, args.top, args.n_seeds, args.trees, random_state=args.seed).collect()
    chosen = BorutaSelector(features, args.boruta_repeats, n_estimators=args.trees, random_state=args.seed, max_iter=15 if args.fast else 100).fit(train, args.label)
    sets = {"all": features, "top": [r.feature for r in top[: args.top]], "boruta": chosen.selected_columns_}
    sets = {n: f for n, f in sets.items() if f}
    compared = compare_feature_sets(sets, lambda seed: make_classifier("random_forest", None, seed, n_estimators=args.trees), train, test, args.label, args.key, args.positive, 2 if args.fast else 5)
    return {"top": [r.asDict() for r in top], "boruta": chosen.selection_frequency_, "sets": sets, "compared": [r.asDict() for r in compared.collect()]}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(arguments)
    if args.fast:
        args.boruta_repeats, args.trees = min(args.boruta_repeats, 2), min(args.trees, 15)
    found = {"tune": tune, "ranks": ranks}[args.job](spark or SparkSession.builder.getOrCreate(), args)
    if args.out:
        write_json_summary(found, args.out)
    else:
        print(json.dumps(found, indent=1))
    return found


if __name__ == "__main__":
    main()
