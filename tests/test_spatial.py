import math

import numpy as np
import pandas as pd
import pytest

from cytomesh.operators import spatial


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({"image_id": rng.integers(0, 3, n), "instance_id": range(n), "x": rng.uniform(0, 400, n), "y": rng.uniform(0, 300, n), "r": 3.0})
    pdf.loc[0:5, "x"] += 5000  # far from all others of their images
    return pdf, spark.createDataFrame(pdf)


def test_nearest_equals_brute_force(cloud):
    pdf, df = cloud
    got = {(r.image_id, r.instance_id): (r.nn, r.d) for r in spatial.nearest(df).collect()}
    for a in pdf.itertuples():
        d, nn = min((math.hypot(a.x - b.x, a.y - b.y), b.instance_id) for b in pdf.itertuples() if b.image_id == a.image_id and b.instance_id != a.instance_id)
        assert got[a.image_id, a.instance_id] == (nn, pytest.approx(d))


def test_pairs_and_components(cloud):
    from pyspark.sql import functions as F

    pdf, df = cloud
    edges = spatial.pairs_within(df, F.lit(25.0))
    want = {(a.instance_id, b.instance_id) for a in pdf.itertuples() for b in pdf.itertuples() if a.image_id == b.image_id and a.instance_id < b.instance_id and math.hypot(a.x - b.x, a.y - b.y) <= 25}
    assert {(r.instance_id, r.instance_id2) for r in edges.collect()} == want
    root = {r.instance_id: r.component for r in spatial.group_components(edges).collect()}
    assert all(root[a] == root[b] for a, b in want)


def test_union_of_overlapping_squares(spark):
    rects = spark.createDataFrame([(1, 0.0, 0.0, 200.0, 200.0), (1, 100.0, 0.0, 300.0, 200.0), (2, 0.0, 0.0, 5.0, 10.0), (2, 5.0, 0.0, 10.0, 10.0)], "g long, x0 double, y0 double, x1 double, y1 double")
    got = {r.g: r.a for r in spatial.union_bands(rects, "g").selectExpr("g", "(x1 - x0) * (y1 - y0) as a").groupBy("g").agg({"a": "sum"}).withColumnRenamed("sum(a)", "a").collect()}
    assert got == {1: 60000.0, 2: 100.0}


def test_greedy_points_keep_their_distance(spark):
    rows = spark.createDataFrame([(1, i, float(i), 0.0, 1.0 - i / 100) for i in range(50)], "session_id long, job_id long, x double, y double, score double")
    got = spatial.greedy_separated(rows, "session_id", ["-score", "job_id"], 10.0, 3).collect()
    assert [r.job_id for r in got] == [0, 10, 20]
