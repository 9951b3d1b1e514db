"""Kernels over a session's fields, against all pairs."""

import numpy as np
import pytest

from cytomesh.operators import sessions


def some_fields(seed, n, wide=3000.0, sizes=False, copies=False):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, int(wide * 100), n) / 100, rng.integers(0, int(wide * 60), n) / 100
    if copies:  # dense groups, and fields on one place
        x[n // 2 :], y[n // 2 :] = 500 + rng.integers(0, 300, n - n // 2) / 100, 500 + rng.integers(0, 200, n - n // 2) / 100
    w, h = (rng.integers(1, 900, n) * 1.0, rng.integers(1, 500, n) * 1.0) if sizes else (np.full(n, 800.0), np.full(n, 448.0))
    return x, y, w, h


def union_area(b):
    xs, ys = np.unique(b[[0, 2]]), np.unique(b[[1, 3]])
    hit = ((b[0][:, None, None] <= xs[:-1, None]) & (b[2][:, None, None] >= xs[1:, None]) & (b[1][:, None, None] <= ys[:-1]) & (b[3][:, None, None] >= ys[1:])).any(axis=0)
    return (hit * np.diff(xs)[:, None] * np.diff(ys)).sum()


SHAPES = [dict(), dict(sizes=True), dict(copies=True), dict(wide=90000.0), dict(wide=20000.0, sizes=True, copies=True)]


@pytest.mark.parametrize("shape", SHAPES)
def test_coverage_of_earlier_fields(shape):
    x, y, w, h = some_fields(5, 160, **shape)
    got = sessions.coverage({"job_id": np.arange(10, 170), "x": x, "y": y, "w": w, "h": h, "new": np.ones(160, bool), "old": np.ones(160, bool), "lone": np.array(False)})
    b = sessions.boxes(x, y, w, h)
    for j in range(160):
        a = [np.maximum(0, min(b[2, j], b[2, k]) - max(b[0, j], b[0, k])) * np.maximum(0, min(b[3, j], b[3, k]) - max(b[1, j], b[1, k])) for k in range(j)]
        gaps = [np.hypot(max(b[0, k] - b[2, j], b[0, j] - b[2, k], 0), max(b[1, k] - b[3, j], b[1, j] - b[3, k], 0)) for k in range(j)]
        assert got["a"][j] == max(a, default=0)
        assert got["o"][j].as_py() == (10 + int(np.argmax(a)) if max(a, default=0) > 0 else None)
        assert got["gap"][j].as_py() == (None if not j else pytest.approx(min(gaps), abs=1e-6))
        clip = np.stack([np.maximum(b[0, j], b[0, :j]), np.maximum(b[1, j], b[1, :j]), np.minimum(b[2, j], b[2, :j]), np.minimum(b[3, j], b[3, :j])])
        clip = clip[:, (clip[2] > clip[0]) & (clip[3] > clip[1])]
        assert got["u"][j] == pytest.approx(union_area(clip) if clip.size else 0.0, abs=1e-4)


def test_coverage_writes_no_clips(spark, monkeypatch):
    """A map scanned many times over left a clip for every pair."""
    from cytomesh.plans import spatial

    monkeypatch.setattr(spatial, "written", lambda *_: pytest.fail("a table was written"), raising=False)
    x, y, w, h = some_fields(1, 20000)
    rows = spark.createDataFrame(list(zip([1] * 20000, range(20000), x.tolist(), y.tolist(), w.tolist(), h.tolist(), strict=True)), "session_id long, job_id long, x double, y double, w double, h double")
    got = {r.state: r["count"] for r in spatial.coverage(rows, rows).groupBy("state").count().collect()}
    assert got["FIRST_FIELD"] == 1 and got["ALREADY_SCANNED"] > 19000 and sum(got.values()) == 20000


def test_duplicate_skip_reads_the_fields_once(spark):
    from cytomesh.plans import survey

    plan = survey.duplicate_skip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_six_digits_round_as_the_sql(spark):
    import duckdb

    from cytomesh.sources import sinks

    values = [100000.5, 100001.5, 250000.5, 0.1234565, 1234565.0, 1e6, 1e-5, 123456.5, 0.5, -2.5, 100.0, 0.0]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(sinks.six_digits("v").alias("t")).collect()]
    assert got == [duckdb.execute("select format('{:.6g}', ?::double)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize("shape", SHAPES)
def test_rows_before_by_blocks(shape):
    """Covered fractions and the last rows near, against all pairs."""
    n = 300
    x, y, w, h = some_fields(8, n, **shape)
    flag, b = np.arange(n) % 3 > 0, sessions.boxes(x, y, w, h)
    base = {"job_id": np.arange(5, 5 + n), "x": x, "y": y, "w": w, "h": h, "lone": np.array(False)}
    got = sessions.covered(base | {"mono": flag})["covered"]
    near = sessions.latest_near(base | {"good": flag, "radius": 1.3 * np.sqrt(w * w + h * h)})
    near = set(zip(near["job_id"].tolist(), near["ref"].tolist(), strict=True))
    want = set()
    for j in range(n):
        total = sum(sessions._shared(tuple(b[:, j]), tuple(b[:, k])) for k in range(j) if flag[k])
        assert got[j] == pytest.approx(min(1.0, total / max(1.0, w[j] * h[j])) if total else 1.0)
        refs = [k for k in range(j) if flag[k] and np.sqrt((x[j] - x[k]) ** 2 + (y[j] - y[k]) ** 2) <= 1.3 * np.sqrt(w[j] * w[j] + h[j] * h[j])]
        want |= {(5 + j, 5 + k) for k in refs[-8:]}
    assert near == want


@pytest.mark.parametrize("shape", SHAPES)
def test_layer_equals_its_fold(shape):
    from cytomesh.streaming import folds

    n = 300
    x, y, w, h = some_fields(9, n, **shape)
    mono, human = np.arange(n) % 5 < 3, np.arange(n) % 7 == 0
    got = sessions.layer({"job_id": np.arange(n), "x": x, "y": y, "w": w, "h": h, "mono": mono, "weight": np.where(human, 2, 1), "lone": np.array(False)})
    fold = folds.layer()
    state = fold.start()
    for j in range(n):
        row = fold.step(state, {"x": x[j], "y": y[j], "w": w[j], "h": h[j], "raw_class": "MONOLAYER" if mono[j] else "X", "human_label": "M" if human[j] else None})
        assert all(got[c][j] == v for c, v in row.items())


@pytest.mark.parametrize("share", [0.35, 0.5, 0.65])
@pytest.mark.parametrize("shape", SHAPES)
def test_layer_over_blocks(shape, share, monkeypatch):
    """Footprints that are left alone and counted again, in blocks and cells of any size; a field without a place has no part in it."""
    from cytomesh.streaming import folds

    n = 600
    x, y, w, h = some_fields(11, n, **shape)
    rng = np.random.default_rng(12)
    mono, human = rng.random(n) < share, rng.random(n) < 0.2
    fold = folds.layer()
    state = fold.start()
    want = [fold.step(state, {"x": x[j], "y": y[j], "w": w[j], "h": h[j], "raw_class": "MONOLAYER" if mono[j] else "X", "human_label": "M" if human[j] else None}) for j in range(n)]
    at = [100, 300]
    x, y, w, h, mono, human = (np.insert(c, at, v) for c, v in ((x, [np.nan, 5.0]), (y, 5.0), (w, 800.0), (h, [448.0, np.nan]), (mono, [True, False]), (human, False)))
    for steps, counted, raster, most in ((16, 64, 6, 2**18), (64, 16, 40, 2**18), (1024, 8192, 32, 50)):
        for name, value in (("STEPS", steps), ("COUNTED", counted), ("RASTER", raster), ("MOST_CELLS", most)):
            monkeypatch.setattr(sessions, name, value)
        got = sessions.layer({"job_id": np.arange(n + 2), "x": x, "y": y, "w": w, "h": h, "mono": mono, "weight": np.where(human, 2, 1), "lone": np.array(False)})
        alone = [got[c][[100, 301]].tolist() for c in ("affirmed", "contradicted", "demoted", "restored", "joined")]
        assert alone == [[0, 0]] * 4 + [[True, False]]
        for c in want[0]:
            assert np.delete(got[c], [100, 301]).tolist() == [row[c] for row in want]


def test_layer_does_not_meet_all_footprints(monkeypatch):
    """A step compared its field with every footprint about it, so work grew with the square of a session."""

    class Counting:
        seen = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def minimum(self, *a, **b):
            out = np.minimum(*a, **b)
            self.seen += np.size(out)
            return out

    def work(n):
        x, y, w, h = some_fields(13, n, wide=6000.0)
        count = Counting()
        monkeypatch.setattr(sessions, "np", count)
        sessions.layer({"job_id": np.arange(n), "x": x, "y": y, "w": w, "h": h, "mono": np.random.default_rng(14).random(n) < 0.4, "weight": np.ones(n, np.int64), "lone": np.array(False)})
        monkeypatch.setattr(sessions, "np", np)
        return count.seen

    few, many = work(10_000), work(40_000)
    assert many < 7 * few


def test_outline_has_the_union_of_all():
    """Few of many boxes on one map: bands and boxes met in numbers that grew with their square."""
    x, y, w, h = some_fields(2, 4000)
    b = sessions.boxes(x, y, w, h)
    kept = sessions.outline(b)
    assert len(kept) < 400
    inside = lambda c: sessions.united(b, np.full(4000, c.shape[1]), c)
    assert np.allclose(inside(b[:, kept]), w * h)


def test_images_of_a_small_table_are_dealt(spark):
    """One file of suppliers was one task, whatever the images cost."""
    from cytomesh.plans import pixels

    for f in (pixels.frame_shifts, pixels.frame_measures):
        assert f(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 200


def test_shapes_of_runs_in_any_order(spark):
    from cytomesh.operators import frames

    runs = [(1, label, label + y, 3 * label, 3 * label + 5 - label % 2 * (y == 4)) for label in range(50) for y in range(5)]
    rows = spark.createDataFrame(runs[::-1], "image_id long, label long, row_no long, x0 long, x1 long")
    shapes = {r.label: (r.area_px, r.perimeter, r.solidity) for r in frames.region_shapes(rows).collect()}
    assert len(shapes) == 50 and all(v[0] == 25 - k % 2 and (v == (25, 16.0, 1.0)) == (k % 2 == 0) for k, v in shapes.items())


def links_of_all_pairs(x, y, w, h, mono, least=0.25):
    x0, y0, x1, y1 = sessions.boxes(x, y, w, h)
    out = {}
    for j in range(len(x)):
        part = np.maximum(0, np.minimum(x1[j], x1) - np.maximum(x0[j], x0)) * np.maximum(0, np.minimum(y1[j], y1) - np.maximum(y0[j], y0)) / np.minimum(w[j] * h[j], w * h)
        out |= {(j, int(k)): part[k] for k in np.flatnonzero(mono & (part >= least)) if k != j}
    return out


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("room", [2**15, 50])
def test_links_are_all_pairs(shape, room, monkeypatch):
    monkeypatch.setattr(sessions, "COMPARED", room)
    n = 700
    x, y, w, h = some_fields(4, n, **shape)
    mono = np.arange(n) % 5 < 3
    v = {"job_id": np.arange(n), "x": x, "y": y, "w": w, "h": h}
    b = {c: v[c][mono] for c in v}
    got = [(v["job_id"][j], b["job_id"][k], s) for m, each, ks, parts in sessions.links(v, b, 0.25) for j, k, s in zip(np.repeat(m, each), ks, parts, strict=True)]
    assert len(got) == len({(j, k) for j, k, _ in got}) and {(j, k): s for j, k, s in got} == links_of_all_pairs(x, y, w, h, mono)


@pytest.mark.parametrize("shape", SHAPES)
def test_layer_links_over_tiles(spark, shape, monkeypatch):
    """Below zero and over tiles' edges, with a field's links in several lists; a missing session or place has none."""
    n = 500
    x, y, w, h = some_fields(6, n, **shape)
    x, y, mono = x - 2000, y - 900, np.arange(n) % 2 == 0
    rows = [(1, j, float(x[j]), float(y[j]), float(w[j]), float(h[j]), bool(mono[j]), 1 + j % 2) for j in range(n)]
    rows += [(None, 1, 0.0, 0.0, 800.0, 448.0, True, 1), (None, 2, 0.0, 0.0, 800.0, 448.0, True, 1), (1, n, None, 0.0, 800.0, 448.0, True, 1), (2, 0, 0.0, 0.0, 800.0, 448.0, True, 1), (2, 1, 0.0, 0.0, 800.0, 448.0, False, 2)]
    fields = spark.createDataFrame(rows, "session_id long, job_id long, x double, y double, w double, h double, mono boolean, weight int")
    want = [(1, j, k, bool(mono[j]), 1 + j % 2, pytest.approx(s, abs=5.1e-5)) for (j, k), s in links_of_all_pairs(x, y, w, h, mono).items()] + [(2, 1, 0, False, 2, 1.0)]
    got = [(r.session_id, r.job_id, r.footprint, r.affirms, r.weight, r.overlap) for r in sessions.layer_links(fields).collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[:3]) and all(r[5] == round(r[5], 4) for r in got)


def test_layer_overlaps_joins_no_buckets(spark):
    """Fields met in the buckets of a join, ten candidates for a row, and a field lay in up to four."""
    from cytomesh import registry

    plan = registry.QUERIES["layer_overlaps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


@pytest.mark.parametrize("shape", SHAPES)
def test_points_inside_any(shape):
    n = 900
    x, y, w, h = some_fields(7, n, **shape)
    mono, thick = np.arange(n) % 3 == 0, np.arange(n) % 3 == 1
    x[1], y[1], x[4], y[4] = x[0] + w[0] / 2, y[0], x[3], y[3] - h[3] / 2  # on a border
    v = {"job_id": np.arange(n), "x": x, "y": y, "w": w, "h": h, "mono": mono, "thick": thick}
    got = sessions.inside_any(v | {"lone": np.array(False)})["job_id"].tolist()
    assert got == [j for j in np.flatnonzero(thick) if (mono & (np.abs(x[j] - x) <= w / 2) & (np.abs(y[j] - y) <= h / 2)).any()]
    assert not len(sessions.inside_any(v | {"lone": np.array(True)})["job_id"])


def test_point_in_any_joins_no_buckets(spark):
    from cytomesh import registry

    plan = registry.QUERIES["point_in_any"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1
