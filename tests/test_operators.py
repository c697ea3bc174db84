"""Edge cases of the operators on hand-made tables, and properties of the numeric kernels."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.functions import scalars as S
from verity.operators import clusters, corr, crosstab, derive, encoder, metrics, models, pca
from verity.plans import cli, observe, workflows
from verity.sources import files
from verity.streaming import scoring


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_quotes_and_null_rules(spark):
    df = spark.createDataFrame([(1, '["a","b, c"]'), (2, "[]"), (3, None), (4, '["x",\n"y",\n"z"]')], "i int, s string")
    assert values(df.select("i", S.quoted_items(F.col("s")).alias("n")), "i", "n") == [(1, 2), (2, 0), (3, 0), (4, 3)]
    grid = spark.createDataFrame(list(itertools.product([True, False, None], [True, False])), "t boolean, p boolean")
    got = {(r["t"], r["p"]): (r["e"], r["d"]) for r in grid.select("t", "p", S.is_error(F.col("t"), F.col("p")).alias("e"), S.direction(F.col("t"), F.col("p")).alias("d")).collect()}
    assert got == {(True, True): (False, S.AGREES), (False, False): (False, S.AGREES), (True, False): (True, S.UNEXPECTED), (False, True): (True, S.NOT_CAPTURED), (None, True): (True, S.LABEL_MISSING), (None, False): (True, S.LABEL_MISSING)}


def test_derived_adds_only_what_is_missing(spark):
    df = spark.createDataFrame([("a", "FSA", None), (None, "X", '"q"'), (None, None, "")], "g string, flag string, j string")
    args = ("flag", {"is_fsa": "FSA"}, "g", "j", "n", "items")
    once = derive.derived(df, *args)
    assert values(once, "g", "is_fsa", "n", "items") == values(derive.derived(once, *args), "g", "is_fsa", "n", "items") == sorted([("a", True, 1, 0), (None, False, 2, 1), (None, None, 2, 0)], key=str)


def test_split_is_exact_and_disjoint(spark):
    for n, share in ((1, 0.2), (7, 0.2), (10, 0.3), (500, 0.2), (5, 0.0)):
        df = spark.range(n).select(F.col("id").alias("k")).unionByName(spark.range(n).select(F.col("id").alias("k")))
        got = derive.split_groups(df, "k", share).collect()
        assert len(got) == n and sum(r["is_test"] for r in got) == math.ceil(round(share * n, 9))


def test_auc_and_curve_under_ties(spark):
    rows = [(True, 0.5), (False, 0.5), (True, 0.9), (False, 0.1), (True, 0.1), (None, 0.7), (False, 0.5)]
    df = spark.createDataFrame(rows, "t boolean, s double")
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if t is False]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(df, "t", "s").first()["auc"] - want) < 1e-12
    assert metrics.roc_auc(df.where("t"), "t", "s").first()["auc"] is None
    assert metrics.threshold_for_recall(df, "t", "s", 0.6).first()["threshold"] == 0.5
    assert metrics.threshold_for_recall(df.where("NOT t"), "t", "s", 0.6).count() == 0
    assert metrics.binary(df.where("NOT t").withColumn("p", F.lit(False)), "t", "p").first()["f1"] == 0


def test_bins_share_ties_and_keep_nulls(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]] + [(None,)], "x double")
    edges = crosstab.bin_edges(df, "x", 5)
    assert edges == sorted(set(edges))
    got = df.select("x", crosstab.bin_index("x", edges).alias("b")).collect()
    assert {r["b"] for r in got if r["x"] == 1.0} == {0} and {r["b"] for r in got if r["x"] is None} == {None}
    assert crosstab.bin_edges(df.where("x <= 3"), "x", 5) is None


def test_crosstab_of_nulls_and_skipped_report(spark):
    df = spark.createDataFrame([(0, None), (0, "a"), (1, "a"), (1, None), (1, None)], "c int, v string")
    got = {(r["cluster"], r["value"]): r["enrichment"] for r in crosstab.crosstab(df, "c", ["v"]).collect()}
    assert got[1, "<null>"] == pytest.approx((2 / 3) / (3 / 5)) and got[0, "a"] == pytest.approx((1 / 2) / (2 / 5))
    assert clusters.report(df.withColumn("d", F.lit("x")), "c", "d", ["v"], "c").skipped
    twenty = spark.range(20).select(F.lit(0).alias("c"), F.lit("x").alias("d"), F.col("id"), F.lit("s").alias("v"))
    done = clusters.report(twenty, "id", "d", ["v"], "c")
    assert not done.skipped and done.groups.collect()[0]["size"] == 20  # no driver: grouped by direction alone


def test_tree_keeps_groups_that_end_above_others():
    rows = [{"direction": "d", "path": ["a=1"], "size": 3, "group_no": 2}, {"direction": "d", "path": ["a=1", "b=2"], "size": 5, "group_no": 1}]
    (root,) = clusters.tree_json(rows)
    assert root["rows"] == 8 and root["children"][0]["own_rows"] == 3 and root["children"][0]["children"][0]["rows"] == 5


def test_strategies_and_components(spark):
    assert pca.parse_strategy("top1") == pca.parse_strategy("PC1") and pca.parse_strategy("adaptive_0.9").k_max == 32
    for bad in ("pc0", "adaptive_0", "adaptive_1.5", "x"):
        with pytest.raises(ValueError):
            pca.parse_strategy(bad)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    w = rng.integers(1, 5, 200)
    df = spark.createDataFrame([(v.tolist(), int(n)) for v, n in zip(x, w, strict=True)], "v array<double>, n int").repartition(3)
    axes = pca.fit(df, "v", pca.parse_strategy("top3"), "n")
    mean = (x * w[:, None]).sum(0) / w.sum()
    cov = ((x - mean) * w[:, None]).T @ (x - mean) / w.sum()
    values_, vectors = np.linalg.eigh(cov)
    for k in range(3):
        v = vectors[:, -1 - k]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(axes.axes[k], v, atol=1e-5)
    assert np.allclose(axes.ratios, values_[::-1] / values_.sum(), atol=1e-8)
    full = pca.fit(df, "v", pca.parse_strategy("adaptive_1.0"), "n")
    assert full.k == 6 and full.target_met
    constant = spark.createDataFrame([([1.0, 2.0], 3)] * 4, "v array<double>, n int")
    assert pca.fit(constant, "v", pca.parse_strategy("top5"), "n").k == 0


def test_axes_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0, 2.0]), ("a", [0.0, 1.0, 1.0]), ("b", [1.0, 1.0, 0.0]), ("b", [3.0, 1.0, 0.0])], "c string, v array<double>")
    strategy = pca.parse_strategy("pc1")
    fits = pca.fit_by(df, "c", "v", strategy)
    pca.save(spark, fits, strategy, str(tmp_path))
    again, loaded = pca.load(spark, str(tmp_path))
    assert again == strategy and all(np.allclose(loaded[c].axes, fits[c].axes) for c in fits)
    assert pca.complete(spark, str(tmp_path), strategy, ["a", "b"]) and not pca.complete(spark, str(tmp_path), pca.parse_strategy("top2"), ["a"])


def brute_shap(x, leaves, width):
    """Shapley values from the definition: expectations over subsets of features by cover shares."""

    def value(s):
        return sum(v * math.prod((float(lo < x[f] <= hi) if f in s else z) for f, lo, hi, z in p) for v, p in zip(leaves.values, leaves.paths, strict=True))

    out = np.zeros(width)
    for i in range(width):
        rest = [j for j in range(width) if j != i]
        for k in range(width):
            for s in itertools.combinations(rest, k):
                out[i] += math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width) * (value({*s, i}) - value(set(s)))
    return out


def test_tree_shap_is_exact_and_adds_up(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).tolist()
    df = spark.createDataFrame([(i, *map(float, r), t) for i, (r, t) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, t boolean")
    names = ["a", "b", "c"]
    for backend in ("gbt", "forest"):
        model = models.train(df, names, "t", models.TrainConfig(trees=3, depth=3), backend)
        leaves = models.leaves_of(model, str(tmp_path / backend))
        wide = np.hstack([x, np.zeros_like(x)])[:15]
        phi = models.attributions(wide, leaves)
        for row in range(5):
            assert np.allclose(phi[row], brute_shap(wide[row], leaves, 6), atol=1e-9)
        p = np.array([r["PROBA_T"] for r in models.score(df, model, names, "T").orderBy("i").limit(15).collect()])
        total = phi.sum(1) + leaves.expected
        assert np.allclose(1 / (1 + np.exp(-total)) if backend == "gbt" else total, p, atol=1e-6)
    long = models.shap(df, model, names, "i", str(tmp_path / "more"))
    assert long.count() == 360


def test_model_guards_and_artifacts(spark, tmp_path):
    with pytest.raises(ValueError):
        models.guard(["a", "PRED_X"], ["PRED_X"])
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i), i % 7 > 3) for i in range(80)] + [(99, 1.0, 1.0, None)], "i long, a double, b double, t boolean")
    with pytest.raises(ValueError):
        models.ordered(df, ["a", "zz"])
    model = models.train(df, ["a", "b"], "t", models.TrainConfig(trees=3, depth=2))
    models.save(spark, model, str(tmp_path), ["a", "b"], threshold=0.3)
    again, manifest = models.load(spark, str(tmp_path))
    assert manifest == {"feature_columns": ["a", "b"], "threshold": 0.3}
    assert values(models.score(df, again, ["a", "b"], "T"), "i", "PROBA_T") == values(models.score(df, model, ["a", "b"], "T"), "i", "PROBA_T")
    assert models.parameters(model.stages[-1])["maxDepth"] == 2
    with pytest.raises(FileNotFoundError):
        models.load(spark, str(tmp_path / "none"))


def test_canonical_correlation_of_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5))
    x[:, 3] = x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=300)
    df = spark.createDataFrame([(k % 2, *map(float, r), 1.0) for k, r in enumerate(x)], "g int, a double, b double, c double, d double, e double, k double")
    got = {(r["g"], r["i"], r["j"]): r["r"] for r in corr.block_correlations(df, {"x": ["a", "b", "c"], "y": ["d", "e"], "k": ["k"]}, ["g"]).collect()}
    for g in (0, 1):
        part = x[g::2] - x[g::2].mean(0)
        qx, qy = np.linalg.qr(part[:, :3])[0], np.linalg.qr(part[:, 3:])[0]
        assert got[g, "x", "y"] == pytest.approx(np.linalg.svd(qx.T @ qy, compute_uv=False)[0], abs=1e-6)
        assert got[g, "x", "k"] is None
    few = corr.block_correlations(df.limit(3), {"x": ["a", "b", "c"], "y": ["d", "e"]}, [])
    assert few.first()["r"] is None
    assert corr.correlations(df, ["a", "k"]).first()["r"] is None  # a constant column


def test_dense_codes_and_first_rows(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", None, "a", "c", "b"])], "i int, v string").repartition(4)
    assert values(corr.dense_codes(df, "v", "c"), "i", "c") == sorted([(0, 2), (1, None), (2, 1), (3, 3), (4, 2)], key=str)


def test_encoder_dictionary(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",), ("yy",)], "t string")
    enc = encoder.HashingEncoder(8)
    known = encoder.build(df.where("t = 'x'"), ["t"], enc)
    got = {r["text"]: (r["n"], r["vector"]) for r in encoder.refresh(df, ["t"], enc, known).collect()}
    assert {k: v[0] for k, v in got.items()} == {"x": 2, "MISSING": 1, "yy": 1}
    assert np.linalg.norm(got["yy"][1]) == pytest.approx(1, abs=1e-6)
    hidden = np.array([[[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]]])
    assert np.allclose(encoder.pooled(hidden, np.array([[1, 1, 0]])), [[0.70710678, 0.70710678]])


def test_files(spark, tmp_path):
    csv, parquet = f"{tmp_path}/t.csv", f"{tmp_path}/t.parquet"
    (tmp_path / "t.csv").write_text('id,at,name\n1,2024-01-02 03:04:05,"a ""q"" b"\n2,,\n')
    schema = T.StructType.fromDDL("id long, at timestamp_ntz, name string")
    assert files.ingest(spark, csv, parquet, schema, {"at": "yyyy-MM-dd HH:mm:ss"})
    assert not files.ingest(spark, csv, parquet, schema, {"at": "yyyy-MM-dd HH:mm:ss"})  # fresh
    assert files.row_count(spark, parquet) == 2 and files.readable(spark, parquet) and not files.readable(spark, csv + "x")
    assert values(spark.read.parquet(parquet), "id", "name") == [(1, 'a "q" b'), (2, None)]
    files.write_atomic(spark.range(3).toDF("id"), parquet)
    assert files.row_count(spark, parquet) == 3
    key = files.cache_key(spark, [parquet], seed=1)
    assert key != files.cache_key(spark, [parquet], seed=2)
    assert files.cached(spark, str(tmp_path / "cache"), key, lambda: spark.range(2)).count() == files.cached(spark, str(tmp_path / "cache"), key, lambda: spark.range(9)).count() == 2
    assert files.append_log(spark, {"run_id": "r", "nope": 1}, observe.QA_LOG, f"{tmp_path}/log") == ["nope"]
    files.append_log(spark, {"run_id": "s"}, observe.QA_LOG, f"{tmp_path}/log")
    assert spark.read.option("header", True).csv(f"{tmp_path}/log").count() == 2
    with pytest.raises(FileNotFoundError):
        files.glob(spark, f"{tmp_path}/*.none")
    paths = files.derived_paths("/d/a.csv", "/s", "/e", "/train")
    assert paths["scored"] == "/s/a.scored.parquet" and paths["embeddings"] == "/e/a"
    with pytest.raises(ValueError):
        files.derived_paths("/d/a.csv", "/s", "/train", "/train")
    files.write_json(spark, {"b": 1}, f"{tmp_path}/j")
    assert files.read_json(spark, f"{tmp_path}/j") == {"b": 1}


def test_timer_and_report(spark):
    timer = observe.Timer(expected={"a": 10.0})
    with timer.step("a"):
        pass
    assert 4 < timer.expected["a"] < 6 and timer.remaining(["a", "b"]) == timer.expected["a"]
    report = observe.RunReport("run")
    report.add("data", rows=3)
    assert '"rows": 3' in report.json() and "| rows | 3 |" in report.markdown()
    assert cli.parser().parse_args(["train", "--table", "t", "--columns", "{}", "--folder", "f", "--full"]).full


def audit_rows(seed, n=240):
    rng = np.random.default_rng(seed)
    return [(i, f"g{i % 30}", ["ann", "bob", "cid"][i % 3], "xy"[i % 2], float(rng.normal() + 2 * (i % 3 == 0)), None if i % 11 == 0 else (i % 3 == 0) != (i % 17 == 0)) for i in range(n)]


ROLES = {"key": "id", "group": "grp", "truth": "truth", "text": ["name"], "tabular": ["x"], "lineage": ["name", "place", "grp"], "excluded": ["grp"], "describe_under": [["grp", "name"]], "where": ["place"]}


def test_workflows_and_stream(spark, tmp_path):
    """Both models: the second is trained on the marks of two tables, then applied to a third without being fitted."""
    folder = str(tmp_path / "run")
    frames = [spark.createDataFrame(audit_rows(k), "id long, grp string, name string, place string, x double, truth boolean") for k in range(3)]
    for k, f in enumerate(frames):
        f.write.parquet(f"{tmp_path}/t{k}.parquet")
    columns, c = json.dumps(ROLES), models.TrainConfig(trees=3, depth=2)
    roles = workflows.Columns(**{k: tuple(map(tuple, v)) if k == "describe_under" else tuple(v) if isinstance(v, list) else v for k, v in ROLES.items()})
    row = workflows.train(spark, frames[0], roles, folder, "top2", c=c, inputs=[f"{tmp_path}/t0.parquet"])
    assert row["n_rows"] == 240 and row["f1"] > 0.8 and row["strategy"] == "top2"
    manifest = models.load(spark, f"{folder}/model_1")[1]
    assert {r["backend"] for r in manifest["ranking"]} == {"gbt", "forest"} and manifest["backend"] == "gbt" and manifest["encoder"] == {"kind": "HashingEncoder", "dim": 64}
    before = files.latest(spark, f"{folder}/cache/*")
    again = workflows.model_input(spark, frames[0], roles, folder, "top2", inputs=[f"{tmp_path}/t0.parquet"])[0]
    assert files.latest(spark, f"{folder}/cache/*") == before and again.where("is_train").count() + again.where("is_test").count() == 240
    with pytest.raises(FileNotFoundError):
        workflows.audit(spark, frames[0], roles, folder)  # no second model yet
    for k in (0, 1):
        cli.main(["audit", "--table", f"{tmp_path}/t{k}.parquet", "--columns", columns, "--folder", folder, "--no-model-2"], spark)
    second = workflows.train_model_2(spark, f"{folder}/scored/*.scored.parquet", roles, folder, c)
    assert second["tables"] == ["t0", "t1"] and second["n_rows"] == 480 and second["n_groups"] == 60
    saved = models.load(spark, f"{folder}/model_2")
    done = workflows.audit(spark, frames[2], roles, folder, f"{folder}/scored/t2.scored.parquet")
    assert models.load(spark, f"{folder}/model_2")[1] == saved[1] and saved[1]["threshold"] == second["threshold"]
    assert done.count() == 240 and done.where("truth IS NULL AND NOT IF_ERROR").count() == 0
    assert done.where(F.col("PRED_IF_ERROR") != (F.col("PROBA_IF_ERROR") >= second["threshold"]).cast("int")).count() == 0
    assert {"PRED_IF_ERROR", "PROBA_IF_ERROR", "ERROR_DIRECTION"} <= set(done.columns)
    log = spark.read.option("header", True).csv(f"{folder}/logs/audit").collect()
    assert len(log) == 3 and {r["source"] for r in log} == {"t0.scored.parquet", "t1.scored.parquet", "t2.scored.parquet"}
    assert spark.read.option("header", True).csv(f"{folder}/logs/columns").count() == 1
    assert "## model gbt" in spark.read.text(f"{folder}/reports/{row['run_id']}/markdown", wholetext=True).first()["value"]

    report = workflows.explain(spark, done, roles, folder, k=2, plots=True)
    assert report.n_errors >= 20 and report.assignments.count() == report.n_errors
    told = files.read_json(spark, f"{folder}/report")
    sizes = {(r["ERROR_GROUP"], r["ERROR_CLUSTER"], r["ERROR_DIRECTION"]): r["count"] for r in spark.read.parquet(f"{folder}/assignments").where("ERROR_GROUP IS NOT NULL").groupBy("ERROR_GROUP", "ERROR_CLUSTER", "ERROR_DIRECTION").count().collect()}
    assert {(g["group"], g["archetype"], next(iter(g["error_direction_mix"]))): g["size"] for g in told["groups"]} == sizes  # one numbering
    assert [g["group"] for g in told["groups"]] == list(range(1, len(sizes) + 1)) and all(g["share"] == round(g["size"] / report.n_errors, 4) for g in told["groups"])
    assert sum(n["rows"] for a in told["archetypes"] for n in a["tree"]) == sum(sizes.values())
    top = spark.read.parquet(f"{folder}/flagged_contributors")
    assert top.select("id").distinct().count() == done.where("PRED_IF_ERROR = 1 AND IF_ERROR").count() and top.agg(F.max("rank")).first()[0] <= 8
    names = saved[1]["feature_columns"]
    assert {r["feature"] for r in spark.read.option("header", True).csv(f"{folder}/importance_by_feature").collect()} == set(names)
    assert {r["feature_group"] for r in spark.read.option("header", True).csv(f"{folder}/importance_by_column").collect()} == {"name", "x"}
    assert workflows.explain(spark, done, roles, folder, sample=25, cluster=False) is None and spark.read.parquet(f"{folder}/shap").select("id").distinct().count() == 25

    features, blocks = cli.main(["grids", "--columns", columns, "--folder", folder, "--plots"], spark)
    drawn = [r["p"].rsplit("/", 1)[-1] for r in spark.read.text(f"{folder}/plots/*.svg", wholetext=True).select(F.col("_metadata.file_path").alias("p")).collect()]
    assert {"importance_feature_group.svg", "importance_feature.svg", "contributions.svg"} <= set(drawn) and len(drawn) == 3 + features.select("place").distinct().count() + blocks.select("place").distinct().count()
    assert features.where("place = 'x' AND i = 'x' AND j = 'truth'").count() == 1
    assert {(r["i"], r["j"]) for r in blocks.collect()} == {("x", "name"), ("x", "truth"), ("name", "truth")}
    shares = cli.main(["variance", "--columns", columns, "--folder", folder], spark).collect()
    assert [r["component"] for r in shares] == [1, 2] and shares[-1]["cumulative"] <= 1 + 1e-9
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frames[0].limit(5).write.parquet(src)
    for _ in range(2):  # the second start finds nothing new
        scoring.drop_folder(spark, src, frames[0].schema, lambda b: b.select("id"), out, str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 5


def test_command_line_takes_a_csv_through(spark, tmp_path):
    folder, columns = str(tmp_path / "run"), json.dumps(ROLES)
    schema = "id long, grp string, name string, place string, x double, truth boolean"
    spark.createDataFrame(audit_rows(5), schema).coalesce(1).write.option("header", True).csv(f"{tmp_path}/given.csv")
    spark.createDataFrame(audit_rows(6), schema).write.parquet(f"{tmp_path}/t.parquet")
    base = ["--columns", columns, "--folder", folder]
    assert cli.main(["axes", "--table", f"{tmp_path}/t.parquet", "--reduction", "pc1", *base], spark)["name"].k == 1
    assert cli.main(["model-input", "--table", f"{tmp_path}/t.parquet", "--reduction", "pc1", *base], spark).count() == 240
    row = cli.main(["train", "--table", f"{tmp_path}/t.parquet", "--reduction", "pc1", "--groups", "20", "--from-scratch", *base], spark)
    assert row["n_groups"] == 20 and row["n_rows"] == 160
    done = cli.main(["audit", "--csv", f"{tmp_path}/given.csv", "--schema", schema, "--no-model-2", *base], spark)
    assert done.count() == 240 and files.exists(spark, f"{folder}/scored/given.scored.parquet") and files.readable(spark, f"{tmp_path}/given.parquet")
    assert cli.main(["train", "--table", f"{tmp_path}/t.parquet", "--only-model-2", *base], spark)["tables"] == ["given"]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["train", "--table", "t", "--train-model-2", "--only-model-2", *base])


def test_report_numbers_groups_once(spark):
    """Two groups of one size whose paths are cut to different depths keep the numbers of their whole paths."""
    rows = [("d", 0, "1", "2")] * 30 + [("d", 0, "1", "3")] * 30 + [("d", 1, "z", c) for c in "45678" for _ in range(20)] + [("d", 2, "y", str(k)) for k in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, way string, c int, a string, b string")
    signatures = spark.createDataFrame([(k, col, w) for k in (0, 1, 2) for col, w in (("a", 0.5), ("b", -0.9), ("nowhere", 3.0))], "cluster int, feature_group string, mean_shap double")
    r = clusters.report(df, "id", "way", ["a", "b"], "c", crosstab.Config(importance=3.0), (), signatures, {"b": "a"})
    groups = {g["group_no"]: g for g in r.groups.collect()}
    mine = {x["group_no"]: x["n"] for x in r.assignments.groupBy("group_no").agg(F.count("id").alias("n")).collect()}
    assert {n: g["size"] for n, g in groups.items()} == {n: c for n, c in mine.items() if n is not None}
    for row in r.assignments.where("group_no IS NOT NULL").collect():
        g = groups[row["group_no"]]
        assert g["cluster"] == row["c"] and all(row[step.split("=")[0]] == step.split("=")[1] for step in g["whole"])
    told = clusters.as_json(r, crosstab.Config(importance=3.0))
    stats = {(s["cluster"], s["col"]): s["sum"] for s in r.stats.collect()}
    for g in told["groups"]:
        weak = [x["column"] for x in g["not_important"]]
        assert weak == [c for c in ("b", "a") if stats[g["archetype"], c] <= 3.0]  # by size of their contribution
        assert [d["column"] for d in g["main_drivers"]] == sorted((c for c in "ab" if stats[g["archetype"], c] > 3.0), key=lambda c: -max(s["max"] for s in r.stats.collect() if s["cluster"] == g["archetype"] and s["col"] == c))
    # Values in fewer rows than a group must have do not count as over-represented.
    assert stats[2, "b"] == 0.0 and stats[1, "b"] > 3.0
    assert clusters.report(df.limit(10), "id", "way", ["a"], "c").skipped


def test_descriptions_under_a_driver(spark):
    rows = spark.createDataFrame([(1, "u"), (1, "u"), (1, "v"), (2, "w"), (None, "x")], "group_no int, brands string")
    groups = spark.createDataFrame([(1, 0, "d", ["n=3", "a=1"]), (2, 0, "d", ["n=3"]), (3, 0, "d", ["a=1"])], "group_no int, cluster int, direction string, path array<string>")
    got = {(r["node"], r["value"]): r["count"] for r in crosstab.described(rows, groups, "brands", "n", 2).collect()}
    assert got == {("n=3", "u"): 2, ("n=3", "v"): 1, ("n=3", "(other)"): 1}
    told = clusters.tree_json([{"direction": "d", "path": ["n=3", "a=1"], "size": 3, "group_no": 1, "cluster": 0}, {"direction": "d", "path": ["n=3"], "size": 1, "group_no": 2, "cluster": 0}], under={(0, "d", "n=3"): {"brands": {"u": 2}}})
    node = told[0]["children"][0]
    assert node["described"] == {"brands": {"u": 2}} and node["own_rows"] == 1 and node["children"][0]["group"] == 1


@pytest.mark.parametrize("few", [20_000, 5])
def test_percentiles_are_exact(spark, few):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=700), rng.integers(0, 4, 500).astype(float), np.repeat([1.0, 5.0, 5.0, 9.0], 90), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
        shares = [0.0, 0.2, 0.4, 0.61, 1.0]
        assert crosstab.percentiles(df, "v", shares, few) == pytest.approx(np.quantile(x, shares).tolist(), abs=1e-12)
    assert crosstab.percentiles(df.where("false"), "v", [0.5], few) == []


def test_buckets_by_halving(spark):
    cuts = [0.5, 1.0, 2.5, 7.0, 9.0]
    df = spark.createDataFrame([(float(v),) for v in (-1, 0.5, 0.7, 1, 2, 2.5, 8, 9, 11)], "v double")
    got = [r["b"] for r in df.select(metrics.bucket_of(F.col("v"), cuts).alias("b")).collect()]
    assert got == [sum(v >= c for c in cuts) for v in (-1, 0.5, 0.7, 1, 2, 2.5, 8, 9, 11)]


def test_correlations_of_many_columns_with_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 40)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 39] = 7.0
    names = [f"c{k}" for k in range(40)]
    df = spark.createDataFrame([(k % 2, *(None if np.isnan(v) else float(v) for v in r)) for k, r in enumerate(x)], ", ".join(["g int", *(f"{n} double" for n in names)]))
    got = {(r["g"], r["i"], r["j"]): r["r"] for r in corr.correlations(df, names, ["g"]).collect()}
    assert len(got) == 2 * 40 * 39 // 2
    for g, a, b in [(0, 0, 1), (1, 5, 30), (0, 20, 38), (1, 3, 39)]:
        u, v = x[g::2, a], x[g::2, b]
        ok = ~np.isnan(u) & ~np.isnan(v)
        want = None if b == 39 else np.corrcoef(u[ok], v[ok])[0, 1]
        assert got[g, f"c{a}", f"c{b}"] == (want if want is None else pytest.approx(want, abs=1e-6))


def test_block_guard_counts_rounded_rows(spark):
    """Rows that differ by less than the rounding are one; the guard needs more rows than the widths."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 3))
    x = np.repeat(base, 30, axis=0) + rng.normal(size=(90, 3)) * 1e-9
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    assert corr.block_correlations(df, {"p": ["a", "b"], "q": ["c"]}, []).first()["r"] is None  # 3 of 4 rows
    assert corr.block_correlations(df, {"p": ["a"], "q": ["c"]}, []).first()["r"] is not None


def test_write_atomic_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t.parquet"
    files.write_atomic(spark.range(4), path)
    real = files._path

    class Stubborn:
        """A file system that refuses to move a staging folder."""

        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            return False if ".staging-" in a.toString() else self.fs.rename(a, b)

    monkeypatch.setattr(files, "_path", lambda s, p: (Stubborn(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError, match="back"):
        files.write_atomic(spark.range(9), path)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == files.row_count(spark, path) == 4
    files.write_atomic(spark.range(9), path)
    assert files.row_count(spark, path) == 9 and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]
    beside = files.batches(spark.range(5), lambda f: f, "id long, w long", spark.range(3).selectExpr("id", "id * 2 AS w"), "id")
    assert values(beside, "id", "w") == [(0, 0), (1, 2), (2, 4)]


def test_older_layout_of_axes(spark, tmp_path):
    (tmp_path / "name.json").write_text(json.dumps({"mean": [1.0, 2.0], "axis": [0.6, 0.8], "ratio": 0.7}))
    strategy, fits = pca.load(spark, str(tmp_path))
    assert strategy == pca.parse_strategy("pc1") and fits["name"].k == 1 and np.allclose(fits["name"].project(np.array([[2.0, 3.0]])), [[1.4]])


def test_silhouette_counts_every_row(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(2300, 3)), rng.integers(0, 3, 2300)
    x[:, 0] += c * np.where(np.arange(2300) < 1500, 3, 0)
    c[7] = 3  # a cluster of one
    df = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(2300)], "id long, v array<double>, c int")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = []
    for i in range(2300):
        mean = {k: d[i, c == k].sum() / ((c == k).sum() - (k == c[i])) for k in range(4) if (c == k).sum() > (k == c[i])}
        a, b = mean.get(c[i]), min(v for k, v in mean.items() if k != c[i])
        want.append(0.0 if a is None else (b - a) / max(a, b))
    for block in (2048, 300):
        assert clusters.silhouette(df, "v", "c", block=block) == pytest.approx(np.mean(want), abs=1e-9)
    assert clusters.silhouette(df.withColumn("c", F.lit(0)), "v", "c") is None


def test_charts(spark, tmp_path):
    """Well-formed SVG with a mark for each value, labels escaped, blanks for missing values; too many marks are refused."""
    import xml.etree.ElementTree as ET

    from verity.plans import charts

    kinds = lambda svg: [e.tag.rsplit("}", 1)[-1] for e in ET.fromstring(svg).iter()]
    grid = charts.heatmap({("a<b", "x"): -1.0, ("a<b", "y"): None, ("c", "x"): 0.25}, "t & u", ["a<b", "c"], ["x", "y"])
    assert kinds(grid).count("rect") == 5 and kinds(grid).count("title") == 4 and ">-1.00<" in grid and "no value" in grid
    assert charts.colour(-1, -1, 1) == charts.LOW and charts.colour(0, -1, 1) == charts.MIDDLE and charts.colour(9, -1, 1) == charts.HIGH and charts.colour(0, 0, 1) == charts.LIGHT
    assert kinds(charts.bars([("p", 2.0), ("q", 0.0)], "t")).count("rect") == 3 and kinds(charts.bars([], "t")).count("rect") == 1
    dots = charts.swarm([("p", 0.1, 1.0), ("p", 0.1, None), ("q", -0.2, float("nan"))], "t", ["p", "q"])
    assert kinds(dots).count("circle") == 3
    charts.save(spark, grid, f"{tmp_path}/plots/{charts.file_name('a/b', 1)}.svg")
    assert (tmp_path / "plots" / "a_b_1.svg").read_text() == grid
    assert len(charts.rows_of(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        charts.rows_of(spark.range(6), 5)


def field(number: int, value) -> bytes:
    """One field of a protocol buffer: a number, or bytes or text with its length."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def lookup_model(table: np.ndarray) -> bytes:
    """An ONNX model that looks token ids up in a table: (batch, tokens) -> (batch, tokens, width)."""

    def tensor(name: str, kind: int, dims: int) -> bytes:
        shape = b"".join(field(1, field(2, f"{name}{k}")) for k in range(dims))
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    weights = field(1, table.shape[0]) + field(1, table.shape[1]) + field(2, 1) + field(8, "table") + field(9, table.astype("<f4").tobytes())
    node = field(1, "table") + field(1, "input_ids") + field(2, "hidden") + field(4, "Gather")
    graph = field(1, node) + field(2, "lookup") + field(5, weights) + field(11, tensor("input_ids", 7, 2)) + field(12, tensor("hidden", 1, 3))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_onnx_encoder_runs_a_model(spark, tmp_path):
    """Weights are found in a folder, lengths are mixed, both modes and both poolings equal plain sums."""
    from tokenizers import Tokenizer
    from tokenizers import models as kinds
    from tokenizers import pre_tokenizers

    words = ["[UNK]", *"abcdef"]
    tokenizer = Tokenizer(kinds.WordLevel({w: k for k, w in enumerate(words)}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    table = np.random.default_rng(1).normal(size=(len(words), 5)).astype(np.float32)
    with pytest.raises(FileNotFoundError):
        encoder.weights_in(str(tmp_path))
    (tmp_path / "onnx").mkdir()
    (tmp_path / "onnx" / "model.onnx").write_bytes(lookup_model(table))
    assert encoder.weights_in(str(tmp_path)).endswith("onnx/model.onnx")  # no 8-bit weights there
    texts = ["a", "b c d e f a b", "zz a", "f f", "c", "a b c", "e d"]
    ids = [[words.index(w) if w in words else 0 for w in t.split()] for t in texts]
    for pooling, pick in (("mean", lambda i: table[i[:6]].mean(0)), ("first", lambda i: table[i[0]])):
        want = np.array([pick(i) / np.linalg.norm(pick(i)) for i in ids])
        for mode in ("single_pass", "per_batch"):
            enc = encoder.OnnxEncoder(str(tmp_path), str(tmp_path / "tokenizer.json"), 5, max_tokens=6, batch=3, pooling=pooling, mode=mode)
            assert np.allclose(enc.open().encode(texts), want, atol=1e-6) and enc.encode([]).shape == (0, 5)
            assert encoder.describe(encoder.from_description(encoder.describe(enc))) == encoder.describe(enc)
    df = spark.createDataFrame([(t,) for t in texts * 2], "t string")
    got = {r["text"]: r["vector"] for r in encoder.build(df, ["t"], enc).collect()}  # opened before it is sent to the workers
    assert np.allclose([got[t] for t in texts], want, atol=1e-6)
    with pytest.raises(ValueError):
        encoder.OnnxEncoder("m", "t", 5, mode="other")
