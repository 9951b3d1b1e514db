"""Queries on folds; their oracles walk each session with a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytomesh.operators import sessions
from cytomesh.plans import relational  # noqa: F401  (fills VIEWS)
from cytomesh.plans.sql import duck, view
from cytomesh.streaming import folds


TIMEOUT = 15.0


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(view(spark, sf_dir, "frames"), folds.keyframes(), "session_id", ("frame_index",))


def keyframe_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyframes(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def accepted_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyframes(spark, sf_dir).where("status like 'ACCEPTED%'")


def field_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(view(spark, sf_dir, "frame_steps"), folds.controller(), "session_id", ("frame_index",))


def temporal_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(view(spark, sf_dir, "fields"), folds.smoother(), "session_id", ("job_id",))


def nav_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(view(spark, sf_dir, "fields"), folds.navigation(), "session_id", ("job_id",))


def nav_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_state(spark, sf_dir).where("from_state <> to_state").groupBy("session_id", "from_state", "to_state").agg(F.count("*").alias("n"))


def monolayer_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of streaming/folds.py over whole sessions, whose footprints lie in a grid."""
    fields = view(spark, sf_dir, "fields").selectExpr("session_id", "job_id", "x", "y", "w", "h", "coalesce(raw_class = 'MONOLAYER', false) as mono", "if(human_label is null, 1L, 2L) as weight")
    return sessions.by_session(fields, sessions.layer, "session_id long, job_id long, affirmed long, contradicted long, demoted long, restored long, joined boolean")


def raster_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(view(spark, sf_dir, "fields"), folds.raster(), "session_id", ("job_id",))


def commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each job commits: after all jobs before it, but it waits no longer than TIMEOUT.

    A running maximum, so a window; streaming/folds.py has the same rule as a fold for streams.
    """
    jobs = view(spark, sf_dir, "jobs").select("session_id", "job_id", (F.col("t_capture") + F.col("value") / 10).alias("done_at"))
    before = Window.partitionBy("session_id").orderBy("job_id").rowsBetween(Window.unboundedPreceding, -1)
    wait = F.coalesce(F.max("done_at").over(before) - F.col("done_at"), F.lit(0.0))
    commit = F.when(wait > TIMEOUT, F.col("done_at") + TIMEOUT).when(wait > 0, F.max("done_at").over(before)).otherwise(F.col("done_at"))
    return jobs.select("session_id", "job_id", F.round(commit, 6).alias("commit_at"), (wait > TIMEOUT).alias("out_of_order"))


QUERIES = {f.__name__: f for f in (keyframes, keyframe_histogram, accepted_keyframes, field_controller, temporal_smoothing, nav_state, nav_transitions, monolayer_layer, raster_guidance, commit_order)}

_KEYFRAMES = """
with recursive walk as (
  select session_id, cast(-1 as bigint) as frame_index, cast(0 as double) as moved, cast(null as double) as accepted, cast('' as varchar) as status, cast(0 as double) as since, cast(0 as double) as cumulative from (select distinct session_id from @frames) s
  union all
  select session_id, frame_index, case when status like 'ACCEPTED%' then 0 else moved end, case when status like 'ACCEPTED%' then t_sec else accepted end, status, since, case when status like 'ACCEPTED%' then 0 else round(moved, 4) end
  from (
    select *, case when sharpness < 5 then 'SKIPPED_BLUR' when accepted is null then 'ACCEPTED_FIRST' when since >= 15 then 'ACCEPTED_HEARTBEAT' when moved < 240 then 'SKIPPED_STATIONARY' when since >= 2 then 'ACCEPTED_NEW_FIELD' else 'SKIPPED_RATE_LIMIT' end as status
    from (select f.session_id, f.frame_index, f.t_sec, f.sharpness, w.accepted, w.moved + f.disp as moved, case when w.accepted is null then -1 else f.t_sec - w.accepted end as since from walk w join @frame_steps f on f.session_id = w.session_id and f.frame_index = w.frame_index + 1) a
  ) b
)"""
_SMOOTH = """
with recursive walk as (
  select session_id, job_id, score as e from @fields where job_id = 1
  union all
  select f.session_id, f.job_id, 0.4 * f.score + 0.6 * w.e from walk w join @fields f on f.session_id = w.session_id and f.job_id = w.job_id + 1
), votes as (
  select a.session_id, a.job_id, b.raw_class, count(*) as n from @fields a join @fields b on b.session_id = a.session_id and b.job_id between a.job_id - 4 and a.job_id group by all
), top as (select *, max(n) over (partition by session_id, job_id) as most from votes),
win as (select session_id, job_id, count(*) as k, min(raw_class) as cls from top where n = most group by all)
select w.session_id, w.job_id, round(w.e, 6) as ema, case when k = 1 then cls when w.e >= 0.6 then 'MONOLAYER' else 'UNCERTAIN' end as smoothed_class from walk w join win on win.session_id = w.session_id and win.job_id = w.job_id"""
_NAV = """
with recursive walk as (
  select session_id, cast(0 as bigint) as job_id, cast(0 as bigint) as streak, cast(0 as bigint) as entering, cast(0 as bigint) as leaving, cast('OUTSIDE' as varchar) as from_state, cast('OUTSIDE' as varchar) as to_state from (select distinct session_id from @fields) s
  union all
  select session_id, job_id, streak, case when to_state = 'ENTERING' and s <> 'ENTERING' then 0 else entering end,
    case when s = 'LEAVING' and to_state = 'IN' then 0 else leaving end, s, to_state
  from (
    select *, case when s = 'OUTSIDE' and streak >= 2 then 'ENTERING' when s = 'ENTERING' and bad then 'OUTSIDE' when s = 'ENTERING' and good and entering + 1 >= 2 then 'IN'
      when s = 'IN' and bad and leaving >= 2 then 'LEAVING' when s = 'LEAVING' and good then 'IN' when s = 'LEAVING' and bad and leaving >= 2 then 'OUTSIDE' else s end as to_state
    from (
      select f.session_id, f.job_id, f.score >= 0.65 as good, f.score <= 0.45 as bad, w.to_state as s, case when f.score >= 0.65 then w.streak + 1 else 0 end as streak,
        case when w.to_state = 'ENTERING' and f.score >= 0.65 then w.entering + 1 else w.entering end as entering,
        case when w.to_state in ('IN', 'LEAVING') and f.score <= 0.45 then w.leaving + 1 when w.to_state = 'IN' then 0 else w.leaving end as leaving
      from walk w join @fields f on f.session_id = w.session_id and f.job_id = w.job_id + 1) a
  ) b
)"""
_LAYER = """
with recursive walk as (
  select session_id, cast(0 as bigint) as job_id, cast([] as struct(x double, y double, a bigint, d bigint, dem boolean)[]) as layer, cast(0 as bigint) as affirmed, cast(0 as bigint) as contradicted, cast(0 as bigint) as demoted, cast(0 as bigint) as restored, false as joined
  from (select distinct session_id from @fields) s
  union all
  select session_id, job_id, case when mono then list_append(l4, struct_pack(x := x, y := y, a := cast(joins as bigint), d := cast(0 as bigint), dem := false)) else l4 end,
    case when mono then n_hit else 0 end, case when mono then 0 else n_hit end, n_dem, n_res, mono and joins
  from (
    select *, list_transform(l3, lambda f: struct_pack(x := f.x, y := f.y, a := f.a, d := f.d, dem := f.now)) as l4, len(list_filter(l3, lambda f: f.hit)) as n_hit, len(list_filter(l3, lambda f: f.now and not f.was)) as n_dem, len(list_filter(l3, lambda f: f.was and not f.now)) as n_res,
      least(1, coalesce(list_sum(list_transform(list_filter(l3, lambda f: not f.now), lambda f: f.part)), 0) / (800.0 * 448)) < 0.8 as joins
    from (
      select *, list_transform(l2, lambda f: struct_pack(x := f.x, y := f.y, a := f.a, d := f.d, was := f.dem, hit := f.hit, part := f.part,
        now := case when f.hit and mono and f.dem and f.a > f.d then false when f.hit and not mono and not f.dem and f.d >= 2 and f.d > f.a then true else f.dem end)) as l3
      from (
        select *, list_transform(l1, lambda f: struct_pack(x := f.x, y := f.y, dem := f.dem, part := f.part, hit := f.part > 0 and f.part / (800.0 * 448) >= 0.25,
          a := f.a + case when mono and f.part > 0 and f.part / (800.0 * 448) >= 0.25 then weight else 0 end, d := f.d + case when not mono and f.part > 0 and f.part / (800.0 * 448) >= 0.25 then weight else 0 end)) as l2
        from (
          select c.session_id, c.job_id, c.x, c.y, c.raw_class = 'MONOLAYER' as mono, case when c.human_label is null then 1 else 2 end as weight,
            list_transform(w.layer, lambda f: struct_pack(x := f.x, y := f.y, a := f.a, d := f.d, dem := f.dem, part := greatest(0, 800 - abs(f.x - c.x)) * greatest(0, 448 - abs(f.y - c.y)))) as l1
          from walk w join @fields c on c.session_id = w.session_id and c.job_id = w.job_id + 1
        ) a
      ) b
    ) d
  ) e
) select session_id, job_id, affirmed, contradicted, demoted, restored, joined from walk where job_id > 0"""
ORACLE_SQL = {
    "keyframes": duck(_KEYFRAMES + " select session_id, frame_index, status, since, cumulative from walk where frame_index >= 0"),
    "keyframe_histogram": duck(_KEYFRAMES + " select status, count(*) as n from walk where frame_index >= 0 group by status"),
    "accepted_keyframes": duck(_KEYFRAMES + " select session_id, frame_index, status, since, cumulative from walk where status like 'ACCEPTED%'"),
    "field_controller": duck("""
with recursive walk as (
  select session_id, cast(-1 as bigint) as frame_index, cast(0 as double) as moved, cast(0 as bigint) as still, cast(null as double) as asked, cast('' as varchar) as state, cast(null as varchar) as reason from (select distinct session_id from @frames) s
  union all
  select session_id, frame_index, case when reason is not null then 0 else moved end, still, case when reason is not null then t_sec else asked end, state, reason
  from (
    select *, case when disp > 8 then 'MOVING' when still < 6 then 'SETTLING' else 'STATIONARY' end as state,
      case when disp > 8 or still < 10 or sharpness < 5 then null when asked is null then 'FIRST_FIELD' when moved >= 240 and t_sec - asked >= 2 then 'NEW_FIELD' when t_sec - asked >= 15 then 'HEARTBEAT' end as reason
    from (select f.session_id, f.frame_index, f.t_sec, f.sharpness, f.disp, w.asked, w.moved + f.disp as moved, case when f.disp > 8 then 0 else w.still + 1 end as still from walk w join @frame_steps f on f.session_id = w.session_id and f.frame_index = w.frame_index + 1) a
  ) b
) select session_id, frame_index, state, reason, greatest(0, still - 6) as settled from walk where frame_index >= 0"""),
    "temporal_smoothing": duck(_SMOOTH),
    "nav_state": duck(_NAV + " select session_id, job_id, from_state, to_state from walk where job_id > 0"),
    "nav_transitions": duck(_NAV + " select session_id, from_state, to_state, count(*) as n from walk where job_id > 0 and from_state <> to_state group by all"),
    "monolayer_layer": duck(_LAYER),
    "raster_guidance": duck("""
with recursive walk as (
  select session_id, job_id, y as base, cast(0 as bigint) as sweep, cast('ROW_SWEEP' as varchar) as hint from @fields where job_id = 1
  union all
  select f.session_id, f.job_id, case when abs(f.y - w.base) >= 300 then f.y else w.base end, case when abs(f.y - w.base) >= 300 then w.sweep + 1 else w.sweep end, case when abs(f.y - w.base) >= 300 then 'STEP_DOWN' else 'ROW_SWEEP' end
  from walk w join @fields f on f.session_id = w.session_id and f.job_id = w.job_id + 1
) select session_id, job_id, sweep, case when sweep % 2 = 0 then 'RIGHT' else 'LEFT' end as direction, hint from walk"""),
    "commit_order": duck("""
select session_id, job_id, round(case when earlier - done_at > 15 then done_at + 15 when earlier > done_at then earlier else done_at end, 6) as commit_at, coalesce(earlier - done_at > 15, false) as out_of_order
from (select *, max(done_at) over (partition by session_id order by job_id rows between unbounded preceding and 1 preceding) as earlier from (select session_id, job_id, t_capture + value / 10 as done_at from @jobs) j) t"""),
}
