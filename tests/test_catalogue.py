"""Every query with SQL against DuckDB on the smallest tables; the others for rows and properties."""

from __future__ import annotations

import itertools
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from verity.plans import catalogue
from verity.sources.files import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float | Decimal):
        return f"{round(float(v), 5) + 0.0:.5f}"
    return str(v).removesuffix(" 00:00:00")


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, SF), duck.sql(catalogue.oracle_sql()[name])
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


def table(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/{name}.parquet").to_pandas()


def vectors():
    return np.stack(table("embeddings")["embedding"].to_numpy()).astype(float)


def explained(x):
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    return np.maximum(values, 0) / values.sum()


def check_pca_fit(found):
    x, axes = vectors(), [r for r in found if r["i"]]
    assert len(axes) == 5 and np.allclose([r["axis"] for r in found if not r["i"]][0], x.mean(0), atol=1e-5)
    assert np.allclose([r["ratio"] for r in sorted(axes, key=lambda r: r["i"])], explained(x)[:5], atol=1e-6)
    v = np.array([r["axis"] for r in axes])
    assert np.allclose(v @ v.T, np.eye(5), atol=1e-4)


def check_explained_variance(found):
    want = explained(vectors())
    assert np.allclose([r["ratio"] for r in found], want, atol=1e-8) and np.allclose([r["cumulative"] for r in found], want.cumsum(), atol=1e-8)
    assert sum(r["kept"] for r in found) == min(int(np.argmax(want.cumsum() >= 0.95 - 1e-12)) + 1, 64) or len([r for r in found if r["kept"]]) <= 64


def check_reduction_by_label(found):
    t, ks = table("embeddings"), []
    for _, part in t.groupby("label"):
        ks.append(int(np.argmax(explained(np.stack(part["embedding"].to_numpy()).astype(float)).cumsum() >= 0.90 - 1e-12)) + 1)
    (r,) = found
    assert (r["max_k"], r["total_k"]) == (max(ks), sum(ks)) and r["min_variance"] >= 0.9


def check_train_score(found):
    truth = dict(zip(table("embeddings")["vec_id"], table("embeddings")["label"] % 2 == 1, strict=True))
    assert len(found) == len(truth) and all(r["PRED_TRUTH"] == (r["PROBA_TRUTH"] > 0.5) and 0 <= r["PROBA_TRUTH"] <= 1 for r in found)
    assert np.mean([truth[r["vec_id"]] == (r["PRED_TRUTH"] == 1) for r in found]) > 0.9


def check_train_compare(found):
    assert sorted(r["backend"] for r in found) == ["forest", "gbt"] and [r["f1"] for r in found] == sorted((r["f1"] for r in found), reverse=True)
    assert all(0 <= r[c] <= 1 for r in found for c in ("accuracy", "precision", "recall", "f1", "auc"))


def check_feature_importances(found):
    assert len(found) == 20 and [r["importance"] for r in found] == sorted((r["importance"] for r in found), reverse=True)
    assert 0 < sum(r["importance"] for r in found) <= 1 + 1e-9


def check_tree_shap(found):
    each: dict = {}
    for r in found:
        each.setdefault(r["vec_id"], []).append(r)
    assert len(each) == len(table("embeddings"))
    for rows_ in each.values():
        assert [r["rank"] for r in sorted(rows_, key=lambda r: r["rank"])] == list(range(1, 9))
        sizes = [abs(r["shap"]) for r in sorted(rows_, key=lambda r: r["rank"])]
        assert sizes == sorted(sizes, reverse=True)


def check_kmeans_archetypes(found):
    x = vectors()
    z = (x - x.mean(0)) / x.std(0)
    c = np.array([r["archetype"] for r in sorted(found, key=lambda r: r["vec_id"])])
    z = z[np.argsort(table("embeddings")["vec_id"].to_numpy())]
    centres = np.stack([z[c == k].mean(0) for k in range(10)])
    near = ((z[:, None] - centres) ** 2).sum(2)
    assert (near.argmin(1) == c).mean() > 0.97  # rows lie with their nearest centre


def check_silhouette(found):
    (r,) = found
    assert r["k"] == 10 and -1 <= r["silhouette"] <= 1


def check_block_cca_wide(found):
    t, blocks = table("embeddings"), catalogue.wide_blocks()
    x, got = vectors(), {(r["label"], r["i"], r["j"]): r["r"] for r in found}
    for label in sorted(set(t["label"])):
        part = x[(t["label"] == label).to_numpy()]
        part = part - part.mean(0)
        q = {b: np.linalg.qr(part[:, [int(d[1:]) for d in ds]])[0] for b, ds in blocks.items()}
        for (i, di), (j, dj) in itertools.combinations(blocks.items(), 2):
            if len(part) < len(di) + len(dj) + 1:
                assert got[label, i, j] is None
            else:
                assert abs(got[label, i, j]) == pytest.approx(np.linalg.svd(q[i].T @ q[j], compute_uv=False)[0], abs=1e-5)


def check_audit_workflow(found):
    ways = {(True, False): "unexpected_own_flag", (False, True): "own_not_captured"}
    assert len(found) == len(table("documents"))
    for r in found:
        predicted = r["PRED_TRUTH"] == 1
        assert r["IF_ERROR"] == (r["truth"] is None or r["truth"] != predicted)
        assert r["ERROR_DIRECTION"] == ("label_missing" if r["truth"] is None else ways.get((r["truth"], predicted), "no_disagreement"))
    flagged = [r["PROBA_IF_ERROR"] for r in found if r["PRED_IF_ERROR"] == 1]
    assert not flagged or min(flagged) >= max((r["PROBA_IF_ERROR"] for r in found if r["PRED_IF_ERROR"] == 0), default=0)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_properties(spark, name):
    """Queries that SQL cannot express, against numpy or by what must hold of them."""
    df = catalogue.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    globals()[f"check_{name}"](df.collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
