"""Queries over whole sessions and images of a larger table, against SQL over all pairs."""

import duckdb
import pytest

from compare import oracle, rows
from cytomesh import registry

SF = "/root/testdata/sf0.01"
NAMES = """coverage_eval union_area containment sampled_scan natural_sort asof_positions edge_set all_logs revisit_cursor mask_geometry
instance_count roi_mask_coverage covered_fraction layer_overlaps snap_candidates point_in_any sweep_membership nn_features pose_chain"""


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """Two sessions of fields and of frames, and 6 images, each whole."""
    out = tmp_path_factory.mktemp("few")
    where = {"orders": "o_custkey % 50 in (3, 17)", "events": "user_id % 10 in (1, 4)", "lineitem": "l_suppkey between 8 and 13", "part": "true"}
    for name, keep in where.items():
        duckdb.sql(f"copy (select * from '{SF}/{name}.parquet' where {keep}) to '{out}/{name}.parquet' (format parquet)")
    return str(out)


@pytest.mark.parametrize("name", NAMES.split())
def test_query_covers_its_whole_table(spark, few, name):
    want = oracle(few, registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, few).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(want)


def test_holes_see_all_fields(spark, few):
    """Of 300 fields a session; with the first 60 only there are more holes."""
    import numpy as np

    con = duckdb.connect()
    got = sorted((r.session_id, r.x, r.y, r.area_cells) for r in registry.QUERIES["holes"](spark, few).collect())
    con.execute(f"create view orders as select * from '{few}/orders.parquet'")
    from cytomesh.plans.sql import duck

    fields, want = con.sql(duck("select * from @fields")).df(), []
    box = con.sql(duck("select * from @grid_geometry")).df().set_index("session_id")
    for session, f in fields.groupby("session_id"):
        g = box.loc[session]
        empty = np.ones((int(np.ceil((g.gy1 - g.gy0) / g.cell)), int(np.ceil((g.gx1 - g.gx0) / g.cell))), bool)
        for r in f[f.reg_state != "REGISTRATION_FAILED"].itertuples():
            empty[int((r.y - r.h / 2 - g.gy0) // g.cell) : int(np.ceil((r.y + r.h / 2 - g.gy0) / g.cell)), int((r.x - r.w / 2 - g.gx0) // g.cell) : int(np.ceil((r.x + r.w / 2 - g.gx0) / g.cell))] = False
        empty[[0, -1]] = empty[:, [0, -1]] = False
        left = set(zip(*np.nonzero(empty), strict=True))
        while left:
            todo = [left.pop()]
            part = []
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if n in left:
                        left.remove(n)
                        todo.append(n)
            if len(part) >= 2:
                want.append((session, min(x for _, x in part), min(y for y, _ in part), len(part)))
    assert got == sorted(want)
