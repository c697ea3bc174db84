"""Command line: train, audit, sweep, ingest, and maintenance. Roles of columns come as JSON text."""

from __future__ import annotations

import argparse
import json

from verity.plans import workflows
from verity.session import build
from verity.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verity")
    sub = p.add_subparsers(dest="verb", required=True)
    t = sub.add_parser("train", help="model input, model 1, and if asked for model 2")
    size = t.add_mutually_exclusive_group()
    size.add_argument("--full", action="store_true", help="all groups")
    size.add_argument("--groups", type=int, default=80)
    t.add_argument("--rebuild", action="store_true", help="fit the axes and make the model input again")
    t.add_argument("--from-scratch", action="store_true", help="remove all artifacts of the folder first")
    t.add_argument("--grids", action="store_true", help="tables of correlations")
    t.add_argument("--plots", action="store_true", help="tables of correlations, and their heat maps")
    second = t.add_mutually_exclusive_group()
    second.add_argument("--train-model-2", action="store_true")
    second.add_argument("--only-model-2", action="store_true")
    t.add_argument("--scored", help="pattern of scored tables for model 2")
    t.add_argument("--reduction", default="top5")
    a = sub.add_parser("audit", help="score a table with saved models")
    a.add_argument("--csv", help="a CSV to take in first; its paths are derived from its name")
    a.add_argument("--schema", help="DDL of the CSV's columns")
    a.add_argument("--times", default="{}", help="JSON text: column to pattern")
    a.add_argument("--output", help="path of the scored table")
    a.add_argument("--force-parquet", action="store_true")
    a.add_argument("--force-embed", action="store_true")
    a.add_argument("--model-1-dir")
    a.add_argument("--model-2-dir")
    a.add_argument("--no-model-2", action="store_true")
    a.add_argument("--shap", action="store_true", help="attributions, importances and the report")
    a.add_argument("--shap-sample", type=int)
    a.add_argument("--no-cluster", action="store_true")
    a.add_argument("--plots", action="store_true", help="with --shap: bars and a swarm of the attributions")
    s = sub.add_parser("sweep")
    s.add_argument("--reductions", nargs="+", default=["pc1", "top5", "adaptive_0.95"])
    s.add_argument("--skip-on-error", action="store_true")
    m = sub.add_parser("model-input", help="the model input alone")
    x = sub.add_parser("axes", help="the axes alone")
    v = sub.add_parser("variance", help="the first components' shares of variance")
    g = sub.add_parser("grids", help="tables of correlations of the newest model input")
    g.add_argument("--plots", action="store_true", help="and their heat maps")
    for q in (m, x):
        q.add_argument("--reduction", default="top5")
        q.add_argument("--rebuild", action="store_true")
    for q in (t, a, s, m, x, v, g):
        q.add_argument("--table", required=q not in (a, v, g), help="Parquet table")
        q.add_argument("--columns", required=True, help="JSON text with the roles of columns")
        q.add_argument("--folder", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--csv", required=True)
    i.add_argument("--parquet", required=True)
    i.add_argument("--schema", required=True, help="DDL of the CSV's columns")
    i.add_argument("--times", default="{}", help="JSON text: column to pattern")
    i.add_argument("--force", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> object:
    from pyspark.sql import types as T

    from verity.operators import derive, models, pca

    o = parser().parse_args(argv)
    spark = spark or build()
    if o.verb == "ingest":
        return files.ingest(spark, o.csv, o.parquet, T.StructType.fromDDL(o.schema), json.loads(o.times), o.force)
    roles = json.loads(o.columns)
    columns = workflows.Columns(**{k: tuple(map(tuple, v)) if k == "describe_under" else tuple(v) if isinstance(v, list) else v for k, v in roles.items()})
    if o.verb == "variance":
        return pca.report(spark, pca.load(spark, f"{o.folder}/reduction")[1])
    if o.verb == "grids":
        newest = files.latest(spark, f"{o.folder}/cache/*") if files.exists(spark, f"{o.folder}/cache") else f"{o.folder}/model_input"
        return workflows.grids(spark, spark.read.parquet(newest), models.load(spark, f"{o.folder}/model_1")[1]["feature_columns"], columns, o.folder, plots=o.plots)
    if o.verb == "audit":
        return _audit(spark, o, columns)
    df = spark.read.parquet(o.table)
    if o.verb == "sweep":
        return workflows.sweep(spark, df, columns, o.folder, o.reductions, o.skip_on_error)
    if o.verb == "model-input":
        return workflows.model_input(spark, df, columns, o.folder, o.reduction, inputs=[o.table], rebuild=o.rebuild)[0]
    if o.verb == "axes":
        from verity.operators import encoder

        vectors = workflows.vectors_of(spark, df, columns, o.folder, encoder.HashingEncoder(), o.rebuild)
        split = derive.split_groups(df, columns.group)
        rows = derive.rows_of_keys(df, split.where("NOT is_test"), columns.group)
        return workflows.export_axes(spark, rows, vectors, columns, o.folder, pca.parse_strategy(o.reduction), o.rebuild)
    if o.from_scratch:
        files.remove(spark, o.folder)
    out = None
    if not o.only_model_2:
        out = workflows.train(spark, df, columns, o.folder, o.reduction, inputs=[o.table], groups=None if o.full else o.groups, rebuild=o.rebuild)
        if o.grids or o.plots:
            main(["grids", "--columns", o.columns, "--folder", o.folder, *(["--plots"] if o.plots else [])], spark)
    if o.train_model_2 or o.only_model_2:
        out = workflows.train_model_2(spark, o.scored or f"{o.folder}/scored/*.scored.parquet", columns, o.folder)
    return out


def _audit(spark, o: argparse.Namespace, columns: workflows.Columns) -> object:
    from pyspark.sql import types as T

    table, output = o.table, o.output
    if o.csv:
        if not o.schema:
            raise SystemExit("--csv needs --schema")
        paths = files.derived_paths(o.csv, f"{o.folder}/scored", f"{o.folder}/encoded", f"{o.folder}/dictionary")
        files.ingest(spark, o.csv, paths["parquet"], T.StructType.fromDDL(o.schema), json.loads(o.times), o.force_parquet)
        table, output = paths["parquet"], output or paths["scored"]
    if not table:
        raise SystemExit("give --table or --csv")
    stem = table.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
    scored = workflows.audit(spark, spark.read.parquet(table), columns, o.folder, output or f"{o.folder}/scored/{stem}.scored.parquet", not o.no_model_2, o.model_1_dir, o.model_2_dir, force_encode=o.force_embed)
    if not o.shap:
        return scored
    return workflows.explain(spark, scored, columns, o.folder, sample=o.shap_sample, cluster=not o.no_cluster, model_2=o.model_2_dir, plots=o.plots)


if __name__ == "__main__":
    main()
