import struct
import zlib

import numpy as np
import pytest

from cytomesh.operators import kernels
from cytomesh.sources import readers, sinks


def scene(h=160, w=200, seed=0):
    rng = np.random.default_rng(seed)
    image = rng.normal(size=(h, w))
    for _ in range(2):
        image = (image + np.roll(image, 1, 0) + np.roll(image, 1, 1) + np.roll(image, -1, 0) + np.roll(image, -1, 1)) / 5
    return 128 + 60 * image


def test_shift_is_recovered():
    big = scene(300, 300)
    ref, cur = big[50:210, 50:250], big[43:203, 62:262]  # content moves by (-12, +7)
    dx, dy, _ = kernels.phase_shift(ref, cur)
    assert (dx, dy) == (pytest.approx(-12, abs=1), pytest.approx(7, abs=1))
    assert kernels.best_shift(ref, cur, 14)[:2] == (12, -7) or kernels.best_shift(ref, cur, 14)[:2] == (-12, 7)
    assert kernels.overlap_ncc(ref, np.full_like(ref, 9.0), 0, 0) == 0


def test_template_is_found():
    big = scene(120, 150)
    x, y, r = kernels.template_match(big, big[30:70, 45:95])
    assert (x, y) == (45, 30) and r == pytest.approx(1)
    assert kernels.template_match(big, np.zeros((10, 10)))[2] == 0


def test_quality_of_a_flat_frame():
    q = kernels.frame_quality(np.full((20, 30, 3), 255, np.uint8))
    assert (q["sharpness"], q["over_pct"], q["saturation"]) == (pytest.approx(0), 100, 0)


def test_shapes():
    y, x = np.mgrid[:40, :70]
    one = (x - 20) ** 2 + (y - 20) ** 2 <= 144
    two = one | ((x - 48) ** 2 + (y - 20) ** 2 <= 144)
    assert kernels.distance_peaks(one, 12) == 1 and kernels.distance_peaks(two, 12) == 2
    assert kernels.solidity(np.ones((4, 6), bool)) == 1 and kernels.solidity(two) < kernels.solidity(one)
    square = np.array([[0, 0], [200, 0], [200, 200], [0, 200]], float)
    assert kernels.quad_iou(square, square + [100, 0], (220, 420)) == pytest.approx(1 / 3, abs=0.02)
    gap = np.ones((7, 7), bool)
    gap[3, 3] = False
    assert kernels.closing(gap)[1:-1, 1:-1].all() and not kernels.closing(gap)[0].any()  # outside is empty


def test_homographies():
    h = np.array([[0.5, 0, 10], [0, 0.5, 20], [0, 0, 1]])
    assert kernels.apply_homography(h, np.array([[2.0, 4.0]])).tolist() == [[11.0, 22.0]]
    rng = np.random.default_rng(1)
    src = rng.uniform(0, 500, (60, 2))
    dst = kernels.apply_homography(h, src)
    dst[:20] += rng.uniform(50, 90, (20, 2))
    got, inside = kernels.ransac_homography(src, dst)
    assert np.allclose(got, h, atol=1e-6) and inside.sum() == 40


def png(mask, kind):
    lines = []
    raw = mask.astype(">u2").view(np.uint8).reshape(len(mask), -1).astype(int)
    for y, line in enumerate(raw):
        above = raw[y - 1] if y else line * 0
        left = np.concatenate([[0, 0], line[:-2]])
        corner = np.concatenate([[0, 0], above[:-2]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines.append(bytes([kind]) + ((line - (0, left, above, (left + above) // 2, paeth)[kind]) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", mask.shape[1], mask.shape[0], 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_masks_become_runs(spark, tmp_path):
    mask = np.zeros((6, 9), int)
    mask[1:3, 2:5] = 300
    mask[2, 5:8] = 7
    for kind in range(5):
        assert (readers.decode_png(png(mask, kind)) == mask).all()
    (tmp_path / "a.png").write_bytes(png(mask, 4))
    (tmp_path / "b.png").write_bytes(b"broken")
    rows = readers.mask_runs(spark, str(tmp_path)).collect()
    assert sorted((r.label, r.row_no, r.x0, r.x1) for r in rows if not r.error) == [(7, 2, 5, 8), (300, 1, 2, 5), (300, 2, 2, 5)]
    assert [r.path[-5:] for r in rows if r.error] == ["b.png"]


def test_folder_in_natural_order(spark, tmp_path):
    for name in ("img10.png", "img2.PNG", "Img1.jpg", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in readers.image_files(spark, str(tmp_path)).orderBy("sort_key").collect()] == ["Img1.jpg", "img2.PNG", "img10.png"]
    assert [r.frame_index for r in readers.keyframe_files(spark, str(tmp_path)).orderBy("frame_index").collect()] == [1, 2, 10]


def test_source_specs():
    assert readers.parse_source("replay:/a/b?files=2&loop=1") == readers.SourceSpec("replay", "/a/b", {"files": "2", "loop": "1"})
    with pytest.raises(ValueError):
        readers.parse_source("camera:0")


def test_csv_and_map_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "x"), (2, float("nan"), None), (3, 1234567.0, "y"), (4, 0.000012345678, "z")], "id long, v double, s string")
    sinks.write_csv(df, f"{tmp_path}/csv", ["id", "v", "missing"])
    got = {r.id: (r.v, r.missing) for r in readers.csv_table(spark, f"{tmp_path}/csv", "id long, v string, missing string").collect()}
    assert got == {1: ("1.5", None), 2: (None, None), 3: ("1.23457e+06", None), 4: ("1.23457e-05", None)}
    fields = spark.createDataFrame([(1, 2.0), (2, 3.0)], "job_id long, x double")
    sinks.write_scan_map(fields, f"{tmp_path}/map")
    assert sorted(readers.scan_map(spark, f"{tmp_path}/map", "job_id: bigint, x: double").collect()) == sorted(fields.collect())
    sinks.write_survey(fields, fields, {"cell": 50}, f"{tmp_path}/survey")
    grid, places, manifest = sinks.read_survey(spark, f"{tmp_path}/survey")
    assert grid.count() == places.count() == 2 and manifest == {"cell": "50"}


def test_small_copies():
    image = np.arange(24.0).reshape(4, 6)
    assert kernels.area_resize(image, 3).tolist() == [[4, 6, 8], [16, 18, 20]]  # means 3.5, 5.5, ... rounded up
    assert kernels.area_resize(np.full((9, 7), 5.0), 3).tolist() == [[5, 5, 5]] * 4
    assert (kernels.blur(np.full((8, 8), 9)) == 9).all()
    spot = np.zeros((9, 9), int)
    spot[4, 4] = 256
    assert kernels.blur(spot)[4, 4] == 36 and kernels.blur(spot)[4, 2] == 6 and kernels.blur(spot).sum() == 256
    prep, spread = kernels.prepared(scene(40, 60), 30)
    assert prep.mean() == pytest.approx(0) and prep.std() == pytest.approx(1) and spread > 1
    assert kernels.prepared(np.full((10, 10), 3.0), 5)[0].tolist() == [[0] * 5] * 5
    assert (kernels.stretched(prep).min(), kernels.stretched(prep).max()) == (0, 255) and not kernels.stretched(np.ones((4, 4))).any()


def test_screen_of_a_dark_and_a_bright_frame():
    dark = np.full((40, 60), 30.0)
    dark[:6] = 220
    bright = 250 - dark
    assert kernels.fast_screen(dark, 30)["verdict"] == "CLEARLY_THICK" and kernels.fast_screen(bright, 30)["verdict"] == "CLEARLY_THIN"


def test_borders():
    square = np.ones((5, 5), bool)
    assert kernels.perimeter(square) == 16 and kernels.perimeter(np.eye(5, dtype=bool)) > 4
    labels = np.array([[1, 1, 2], [1, 1, 2], [0, 0, 0]])
    assert kernels.label_edges(labels).tolist() == [[False, True, True], [True, True, True], [False, False, False]]
    assert kernels.spread_fraction(np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float), (20, 20)) == 0.25
    assert kernels.spread_fraction(np.zeros((2, 2)), (20, 20)) == 0


def test_schedules_and_relocation():
    big = scene(120, 150)
    assert kernels.relocate(big, big[30:70, 45:95])[:2] == (45, 30) and kernels.relocate(big, scene(40, 50, 9)) is None
    tried = []
    attempt = lambda x: tried.append(x) or x * 10
    assert kernels.first_good(attempt, [1, 5, 3, 9], lambda r: r >= 50, lambda r: r) == (5, 50) and tried == [1, 5]
    assert kernels.first_good(attempt, [1, 4, 3], lambda r: r >= 50, lambda r: r) == (4, 40)


def test_settings_and_reports(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"analysis": {"gpu_workers": 3}, "coverage": {"target_overlap_min": 0.2}, "source": "a"}')
    config = readers.load_config(spark, f"{tmp_path}/c.json", {"source": "b", "backend": None})
    assert (config["gpu_workers"], config["cpu_feature_workers"], config["target_overlap_min"], config["semantic_min_votes"], config["source"]) == (3, 2, 0.2, None, "b")
    assert "backend" not in config
    sinks.write_report(spark, "Run", {"inliers": 12, "state": "GOOD"}, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/json").first().asDict() == {"inliers": 12, "state": "GOOD"}
    assert "| inliers | 12 |" in [r.value for r in spark.read.text(f"{tmp_path}/report/markdown").collect()]
    assert sinks.run_metadata(spark, {"seed": 1})["seed"] == 1


def gray_png(image):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(b"\0" + bytes(line) for line in image.astype(np.uint8).tolist())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_pixels_and_broken_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(gray_png(np.array([[1, 2, 3], [4, 5, 6]])))
    got = readers.rgb_pixels(spark, str(tmp_path)).first()
    assert (got.width, got.height, bytes(got.rgb)) == (3, 2, bytes(x for p in range(1, 7) for x in (p, p, p)))
    assert readers.image_sizes(spark, str(tmp_path)).first().pixels == 6
    (tmp_path / "b.png").write_bytes(b"broken")
    with pytest.raises(Exception, match="not an image"):
        readers.image_sizes(spark, str(tmp_path)).collect()


def test_merged_cells_are_split():
    y, x = np.mgrid[:40, :70]
    two = ((x - 20) ** 2 + (y - 20) ** 2 <= 144) | ((x - 42) ** 2 + (y - 20) ** 2 <= 144)
    parts = kernels.split_region(two, 12)
    assert parts.max() == 2 and parts[20, 12] != parts[20, 50] and (parts > 0).sum() == two.sum()
    assert abs(int((parts == 1).sum()) - int((parts == 2).sum())) < 40
    assert kernels.split_region((x - 20) ** 2 + (y - 20) ** 2 <= 144, 12) is None and kernels.split_region(two, 5) is None
    assert kernels.depth(np.array([[0, 1, 1, 1, 0]], bool)).tolist() == [[0, 1, 2, 1, 0]]


def fit_by_rounds(src, dst):
    """The robust fit round by round, with one decomposition each."""

    def fit(src, dst):
        rows = []
        for (x, y), (u, v) in zip(src, dst, strict=True):
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
        h = np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)
        return h / h[2, 2]

    rng, best = np.random.default_rng(0), np.zeros(len(src), bool)
    for _ in range(500 if len(src) >= 4 else 0):
        pick = rng.choice(len(src), 4, replace=False)
        with np.errstate(all="ignore"):
            error = np.hypot(*(kernels.apply_homography(fit(src[pick], dst[pick]), src) - dst).T)
        inside = np.nan_to_num(error, nan=np.inf) <= 3.0
        best = inside if inside.sum() > best.sum() else best
    return (fit(src[best], dst[best]) if best.sum() >= 4 else None), best


@pytest.mark.parametrize("kind", ["exact", "noise", "grid", "line", "few", "many"])
def test_rounds_of_a_robust_fit_are_tried_together(kind, monkeypatch):
    rng = np.random.default_rng(3)
    n = {"few": 4, "many": 400}.get(kind, 36)
    src = rng.uniform(0, 900, (n, 2))
    src = np.round(src / 150) * 150 if kind == "grid" else np.c_[src[:, 0], 2 * src[:, 0]] if kind == "line" else src
    dst = kernels.apply_homography(np.array([[0.4, 0.03, 20], [-0.02, 0.3, 5], [1e-5, 4e-5, 1]]), src) + rng.normal(0, 0 if kind == "exact" else 0.8, (n, 2))
    dst[: n // 3] += rng.uniform(20, 90, (n // 3, 2))
    monkeypatch.setattr(kernels, "TRIED", 5000)
    want, inside = fit_by_rounds(src, dst)
    calls, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *a, **b: calls.append(1) or svd(*a, **b))
    got, found = kernels.ransac_homography(src, dst)
    assert (found == inside).all() and (got is None) == (want is None)
    assert kind == "line" or np.allclose(kernels.apply_homography(got, src), kernels.apply_homography(want, src), atol=1e-6)
    assert len(calls) < 50  # one for each of 500 rounds before


def test_fits_of_ids_over_batches(spark):
    """Ids that end inside a batch, one over many batches, one of too few points, one with a missing place and a missing id."""
    from cytomesh.operators import frames

    rng, rows, want = np.random.default_rng(4), [], {}
    for i, n in [(1, 30), (2, 3), (None, 12), (5, 300), (6, 20), (7, 31)]:
        src = rng.integers(0, 900, (n, 2)).astype(float)
        dst = src / 2 + 7
        dst[: n // 5] += 60
        rows += [(i, *map(float, p), *map(float, q)) for p, q in zip(src, dst, strict=True)]
        want[i] = (n, n - n // 5 if n > 3 else 0)
    rows.append((6, None, 1.0, 2.0, 3.0))
    want[6] = (21, 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        out = frames.fitted_homographies(spark.createDataFrame(rows, "id long, x double, y double, u double, v double"))
        assert {r.id: (r.n, r.inliers) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
