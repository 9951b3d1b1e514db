"""Cells of an image: kernels against all pairs, and queries on missing keys, from one shuffle of the line items."""

import math

import duckdb
import numpy as np
import pytest

from compare import oracle, rows
from cytomesh import registry
from cytomesh.operators import images

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Line items with missing and equal keys, one image of one cell, one of two cells on one place."""
    out = tmp_path_factory.mktemp("odd")
    duckdb.sql(f"""copy (
      select case when l_linenumber = 3 and l_partkey % 5 = 0 then null else l_orderkey end as l_orderkey, case when l_partkey % 41 = 0 then null else l_partkey end as l_partkey,
        case when l_orderkey % 50 = 7 then null when l_suppkey = 9 then 1 else l_suppkey end as l_suppkey, * exclude (l_orderkey, l_partkey, l_suppkey) from '{SF}/lineitem.parquet'
      union all select l_orderkey, l_partkey, 1000 + k.k, * exclude (l_orderkey, l_partkey, l_suppkey, k) from (select * from '{SF}/lineitem.parquet' order by all limit 1) l, (select unnest([1, 2, 2]) as k) k
    ) to '{out}/lineitem.parquet' (format parquet)""")
    for name in ("part", "supplier"):
        duckdb.sql(f"copy (select * from '{SF}/{name}.parquet') to '{out}/{name}.parquet' (format parquet)")
    return str(out)


def one_shuffle(spark, df, least=1):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count(" Exchange hashpartitioning") <= least
    return df


def agrees(spark, odd, name, shuffles=1):
    got = one_shuffle(spark, registry.QUERIES[name](spark, odd), shuffles).toPandas()
    want = oracle(odd, registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(want)


def test_nn_features_of_odd_cells(spark, odd):
    agrees(spark, odd, "nn_features")


def cloud(kind, n=240):
    rng = np.random.default_rng(7)
    x, y = rng.uniform(0, 400, n), rng.uniform(0, 300, n)
    if kind == "copies":
        x[: n // 2], y[: n // 2] = x[0], y[0]
        x[-40:], y[-40:] = np.repeat(x[-40:-20], 2), np.repeat(y[-40:-20], 2)
    if kind == "dense":  # one crowded spot, some points far away, and a line
        x[: n // 2], y[: n // 2] = 5 + rng.uniform(0, 1e-3, n // 2), 5 + rng.uniform(0, 1e-3, n // 2)
        x[-3:], y[-20:] = (1e6, -3e5, 9e5), 0.0
    if kind == "lattice":
        x, y = np.floor(x / 20), np.floor(y / 20)
    x[n // 3] = np.nan
    return x, y


@pytest.mark.parametrize("kind", ["even", "copies", "dense", "lattice"])
def test_nearest_and_pairs_against_all(kind, monkeypatch):
    monkeypatch.setattr(images, "MANY", 8)
    x, y = cloud(kind)
    n, far = len(x), lambda i, k: math.sqrt((x[i] - x[k]) ** 2 + (y[i] - y[k]) ** 2)
    d, at = images.nearest(x, y, x, y, own=True)
    ok = [i for i in range(n) if x[i] == x[i]]
    assert [(d[i], at[i]) for i in ok] == [min((far(i, k), k) for k in ok if k != i) for i in ok] and np.isnan(d[n // 3])
    other, of = images.nearest(x[::3] + 50, y[::3], x[1::2], y[1::2])
    targets = [k for k in range(1, n, 2) if x[k] == x[k]]
    for i in range(0, n, 3):
        if x[i] == x[i]:
            best = min((math.sqrt((x[i] + 50 - x[k]) ** 2 + (y[i] - y[k]) ** 2), k // 2) for k in targets)
            assert (other[i // 3], of[i // 3]) == best
    radius = far(1, 2) / 4
    want = {(i, k) for i in ok for k in ok if i < k and far(i, k) <= radius}
    assert {(int(i), int(k)) for a, b, _ in images.pairs_near(x, y, radius) for i, k in zip(a, b, strict=True)} == want
    few = np.array([0, 5, n // 3, n - 1])
    assert {(int(i), int(k)) for a, b, _ in images.pairs_near(x, y, radius, few) for i, k in zip(a, b, strict=True)} == {p for a, b in want for p in ((a, b), (b, a)) if p[0] in few}


def test_graph_is_united_over_pieces(monkeypatch):
    from cytomesh.operators import sessions

    x, y = cloud("even")
    whole = images.graph({"x": x, "y": y, "median_diameter": np.full(len(x), 14.0)}, 1.5, 5)
    monkeypatch.setattr(sessions, "PAIRS", 10)
    assert images.graph({"x": x, "y": y, "median_diameter": np.full(len(x), 14.0)}, 1.5, 5) == whole and 1 < whole["largest"] < len(x)


def test_image_features_of_odd_cells(spark, odd):
    agrees(spark, odd, "image_features")


def test_classify_field_of_odd_cells(spark, odd):
    agrees(spark, odd, "classify_field")


def test_classify_dark_field_of_odd_cells(spark, odd):
    agrees(spark, odd, "classify_dark_field")


def test_contact_ratio_of_odd_cells(spark, odd):
    agrees(spark, odd, "contact_ratio")


def test_clusters_of_odd_cells(spark, odd):
    agrees(spark, odd, "clusters")


def test_degree_distribution_of_odd_cells(spark, odd):
    agrees(spark, odd, "degree_distribution")


def test_centroid_matches_of_odd_cells(spark, odd):
    agrees(spark, odd, "centroid_matches", 2)


def test_mask_axes_of_odd_cells(spark, odd):
    agrees(spark, odd, "mask_axes")


def test_cells_csv_formats_a_value_once(spark, odd):
    agrees(spark, odd, "cells_csv", 0)  # reads the files; the shuffle was before
    from cytomesh.plans.sql import view

    one_shuffle(spark, view(spark, odd, "flagged"))


def test_cells_by_image_of_odd_cells(spark, odd):
    agrees(spark, odd, "cells_by_image", 0)


def test_cells_are_written_again_over_old_ones(spark, tmp_path):
    from cytomesh.sources import readers, sinks

    path = f"file://{tmp_path}/cells"
    for keys in ((1, 2, None), (3, None)):
        sinks.write_cells(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "image_id long, n long"), path)
        got = readers.cells_by_image(spark, path, "n long, image_id long").collect()
        assert sorted((r.n, r.image_id) for r in got) == list(enumerate(keys))
    sinks.write_cells(spark.createDataFrame([("a/b", 1)], "image_id string, n long"), path)
    assert [tuple(r) for r in readers.cells_by_image(spark, path, "n long, image_id string").collect()] == [(1, "a/b")]
