import pytest

from cytomesh.plans.sql import view
from cytomesh.streaming import folds

SF = "/root/testdata/sf0.001"


def walk(fold, rows):
    state = fold.start()
    return [fold.step(state, r) for r in rows]


def test_ema_of_three_scores():
    got = walk(folds.smoother(), [{"score": s, "raw_class": "MONOLAYER"} for s in (0.2, 0.8, 0.5)])
    assert [g["ema"] for g in got] == [0.2, 0.44, 0.464]


def test_two_goods_then_a_middle_score_are_not_in():
    got = walk(folds.navigation(), [{"score": s} for s in (0.7, 0.7, 0.5)])
    assert [g["to_state"] for g in got] == ["OUTSIDE", "ENTERING", "ENTERING"]


def test_commit_order_is_capture_order():
    got = walk(folds.commit_gate(), [{"done_at": float(t)} for t in (4, 3, 1, 2)])
    assert [g["commit_at"] for g in got] == [4, 4, 4, 4]


def test_layer_demotes_after_two_contradictions():
    field = lambda cls: {"x": 0.0, "y": 0.0, "w": 10.0, "h": 10.0, "raw_class": cls, "human_label": None}
    got = walk(folds.layer(), [field("MONOLAYER"), field("TOO_THICK"), field("TOO_THICK"), field("MONOLAYER")])
    assert [g["demoted"] for g in got] == [0, 0, 1, 0]
    assert got[0]["joined"]


@pytest.mark.parametrize("make,source,order", [(folds.keyframes, "frames", "frame_index"), (folds.navigation, "fields", "job_id"), (folds.smoother, "fields", "job_id"), (folds.controller, "frame_steps", "frame_index")])
def test_stream_equals_batch(spark, tmp_path, make, source, order):
    rows = view(spark, SF, source)
    rows = rows.select([c for c, t in rows.dtypes if not t.startswith("timestamp")])
    batch = folds.run(rows, make(), "session_id", (order,)).toPandas().sort_values(["session_id", order]).reset_index(drop=True)
    cut = int(rows.agg({order: "max"}).first()[0]) // 2
    for i, part in enumerate((rows.where(f"{order} <= {cut}"), rows.where(f"{order} > {cut}"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = f"out_{make.__name__}"
    folds.run_stream(stream, make(), "session_id", (order,)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.table(name).toPandas().sort_values(["session_id", order]).reset_index(drop=True)
    assert got[batch.columns].equals(batch)
