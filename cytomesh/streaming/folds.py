"""Order-dependent folds over the frames and fields of a session, in batch and as streams.

A fold is an initial state and a step (state, row) -> (state, output row). In batch, rows are
dealt by session, sorted, and run through the step while the state is carried over Arrow
batches, so a long session is never held in memory. As a stream, the same step runs under
applyInPandasWithState, one state for each session.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = dict
Step = Callable[[State, dict], dict]


@dataclass(frozen=True)
class Fold:
    """step changes the state and returns the output columns of a row."""

    start: Callable[[], State]
    step: Step
    columns: str  # the output's schema, after the input's columns named in keep
    keep: tuple[str, ...]


def run(rows: DataFrame, fold: Fold, key: str, order: tuple[str, ...]) -> DataFrame:
    """The fold's output for every row; order must be a total order in a session."""
    types = dict(rows.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in (key, *fold.keep)]) + ", " + fold.columns
    names = [c.split()[0] for c in fold.columns.split(", ")]
    kinds = {c.split()[0]: {"long": "Int64", "boolean": "boolean"}.get(c.split()[1], object if c.endswith("string") else "float64") for c in fold.columns.split(", ")}

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), {}
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row[key] != current:
                    current, state = row[key], fold.start()
                out.append(fold.step(state, row))
            made = pd.DataFrame({c: pd.Series([o[c] for o in out], index=pdf.index, dtype=kinds[c]) for c in names})
            yield pd.concat([pdf[[key, *fold.keep]], made], axis=1)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(folded, schema)


def run_stream(rows: DataFrame, fold: Fold, key: str, order: tuple[str, ...]) -> DataFrame:
    """The same over a streaming DataFrame, whose micro-batches must come in order."""
    types = dict(rows.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in (key, *fold.keep)]) + ", " + fold.columns
    names = [c.split()[0] for c in fold.columns.split(", ")]

    def folded(group: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else fold.start()
        parts = list(batches)
        pdf = pd.concat(parts).sort_values(list(order), kind="stable") if parts else None
        if pdf is None:
            return
        made = pd.DataFrame([fold.step(state, row) for row in pdf.to_dict("records")], columns=names, index=pdf.index)
        kept.update((json.dumps(state),))
        yield pd.concat([pdf[[key, *fold.keep]], made], axis=1)

    return rows.groupBy(key).applyInPandasWithState(folded, schema, "state string", "append", GroupStateTimeout.NoTimeout)


# ---- keyframe selection
def keyframes(motion: float = 240.0, least: float = 2.0, heartbeat: float = 15.0, blur: float = 5.0) -> Fold:
    def step(s: State, row: dict) -> dict:
        disp = 0.0 if s["first"] else math.hypot(row["dx"], row["dy"])
        s["first"] = False
        s["moved"] += disp
        since = -1.0 if s["accepted"] is None else row["t_sec"] - s["accepted"]
        if row["sharpness"] < blur:
            status = "SKIPPED_BLUR"
        elif s["accepted"] is None:
            status = "ACCEPTED_FIRST"
        elif since >= heartbeat:
            status = "ACCEPTED_HEARTBEAT"
        elif s["moved"] < motion:
            status = "SKIPPED_STATIONARY"
        else:
            status = "ACCEPTED_NEW_FIELD" if since >= least else "SKIPPED_RATE_LIMIT"
        if status.startswith("ACCEPTED"):
            s["moved"], s["accepted"] = 0.0, row["t_sec"]
        return {"status": status, "since": since, "cumulative": round(s["moved"], 4)}

    return Fold(lambda: {"first": True, "moved": 0.0, "accepted": None}, step, "status string, since double, cumulative double", ("frame_index",))


# ---- live field controller
def controller(moving: float = 8.0, still: int = 6, settle: int = 4, blur: float = 5.0, motion: float = 240.0, least: float = 2.0, heartbeat: float = 15.0) -> Fold:
    def step(s: State, row: dict) -> dict:
        s["moved"] += row["disp"]
        s["still"] = 0 if row["disp"] > moving else s["still"] + 1
        state = "MOVING" if row["disp"] > moving else "SETTLING" if s["still"] < still else "STATIONARY"
        settled = s["still"] - still
        reason = None
        if state == "STATIONARY" and settled >= settle and row["sharpness"] >= blur:
            since = None if s["asked"] is None else row["t_sec"] - s["asked"]
            if row.get("force"):
                reason = "MANUAL"
            elif since is None:
                reason = "FIRST_FIELD"
            elif s["moved"] >= motion and since >= least:
                reason = "NEW_FIELD"
            elif since >= heartbeat:
                reason = "HEARTBEAT"
        if reason:
            s["moved"], s["asked"] = 0.0, row["t_sec"]
        return {"state": state, "reason": reason, "settled": max(0, settled)}

    return Fold(lambda: {"moved": 0.0, "still": 0, "asked": None}, step, "state string, reason string, settled long", ("frame_index",))


# ---- score smoothing and majority class
def smoother(alpha: float = 0.4, window: int = 5, score_min: float = 0.60) -> Fold:
    def step(s: State, row: dict) -> dict:
        s["ema"] = row["score"] if s["ema"] is None else alpha * row["score"] + (1 - alpha) * s["ema"]
        s["recent"] = [*s["recent"], row["raw_class"]][-window:]
        counts = {c: s["recent"].count(c) for c in s["recent"]}
        top = [c for c, n in counts.items() if n == max(counts.values())]
        best = top[0] if len(top) == 1 else "MONOLAYER" if s["ema"] >= score_min else "UNCERTAIN"
        return {"ema": round(s["ema"], 6), "smoothed_class": best}

    return Fold(lambda: {"ema": None, "recent": []}, step, "ema double, smoothed_class string", ("job_id",))


# ---- navigation with hysteresis
def navigation(enter: float = 0.65, leave: float = 0.45, enter_n: int = 2, exit_n: int = 2) -> Fold:
    def step(s: State, row: dict) -> dict:
        good, bad = row["score"] >= enter, row["score"] <= leave
        s["streak"] = s["streak"] + 1 if good else 0
        before = s["state"]
        if before == "OUTSIDE" and s["streak"] >= enter_n:
            s["state"], s["entering"] = "ENTERING", 0
        elif before == "ENTERING" and bad:
            s["state"] = "OUTSIDE"
        elif before == "ENTERING" and good:
            s["entering"] += 1
            if s["entering"] + 1 >= enter_n:
                s["state"] = "IN"
        elif before == "IN":
            s["leaving"] = s["leaving"] + 1 if bad else 0
            if bad and s["leaving"] >= exit_n:
                s["state"] = "LEAVING"
        elif before == "LEAVING" and good:
            s["state"], s["leaving"] = "IN", 0
        elif before == "LEAVING" and bad:
            s["leaving"] += 1
            if s["leaving"] >= exit_n:
                s["state"] = "OUTSIDE"
        return {"from_state": before, "to_state": s["state"]}

    return Fold(lambda: {"state": "OUTSIDE", "streak": 0, "entering": 0, "leaving": 0}, step, "from_state string, to_state string", ("job_id",))


# ---- evidence layer of monolayer fields
def layer(overlap_min: float = 0.25, demote: int = 2, human_weight: int = 2, covered_max: float = 0.8) -> Fold:
    """For each field: how many footprints it affirms, contradicts, demotes, restores; and if it joins."""

    def shared(a: list, b: list) -> float:
        w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
        h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
        return w * h if w > 0 and h > 0 else 0.0

    def step(s: State, row: dict) -> dict:
        box = [row["x"], row["y"], row["w"], row["h"]]
        mono = row["raw_class"] == "MONOLAYER"
        weight = human_weight if isinstance(row["human_label"], str) else 1
        out = {"affirmed": 0, "contradicted": 0, "demoted": 0, "restored": 0, "joined": False}
        covered = 0.0
        for other in s["layer"]:  # box, agreements, disagreements, demoted
            part = shared(box, other[0])
            if part and part / min(box[2] * box[3], other[0][2] * other[0][3]) >= overlap_min:
                if mono:
                    other[1] += weight
                    out["affirmed"] += 1
                    if other[3] and other[1] > other[2]:
                        other[3] = False
                        out["restored"] += 1
                else:
                    other[2] += weight
                    out["contradicted"] += 1
                    if not other[3] and other[2] >= demote and other[2] > other[1]:
                        other[3] = True
                        out["demoted"] += 1
            if not other[3]:
                covered += part
        if mono:
            out["joined"] = min(1.0, covered / max(1.0, box[2] * box[3])) < covered_max
            s["layer"].append([box, int(out["joined"]), 0, False])
        return out

    return Fold(lambda: {"layer": []}, step, "affirmed long, contradicted long, demoted long, restored long, joined boolean", ("job_id",))


# ---- raster navigation
def raster(step_px: float = 300.0) -> Fold:
    """Sweep number, its direction (alternating) and the hint while the pose moves down the slide."""

    def step(s: State, row: dict) -> dict:
        if s["y"] is None:
            s["y"] = row["y"]
        hint = "ROW_SWEEP"
        if abs(row["y"] - s["y"]) >= step_px:
            s["sweep"] += 1
            s["y"] = row["y"]
            hint = "STEP_DOWN"
        return {"sweep": s["sweep"], "direction": "RIGHT" if s["sweep"] % 2 == 0 else "LEFT", "hint": hint}

    return Fold(lambda: {"y": None, "sweep": 0}, step, "sweep long, direction string, hint string", ("job_id",))


# ---- commit in capture order
def commit_gate(timeout: float = 15.0) -> Fold:
    """When each job commits: after all jobs before it, but it waits no longer than timeout."""

    def step(s: State, row: dict) -> dict:
        waits = s["done"] is not None and s["done"] > row["done_at"]
        late = waits and s["done"] - row["done_at"] > timeout
        commit = row["done_at"] + timeout if late else max(row["done_at"], s["done"]) if waits else row["done_at"]
        s["done"] = row["done_at"] if s["done"] is None else max(s["done"], row["done_at"])
        return {"commit_at": round(commit, 6), "out_of_order": bool(late)}

    return Fold(lambda: {"done": None}, step, "commit_at double, out_of_order boolean", ("job_id",))


# ---- pose chain
GOOD, WEAK, FAILED = "REGISTRATION_GOOD", "REGISTRATION_WEAK", "REGISTRATION_FAILED"


def made_evidence(ref: list, row: dict) -> dict:
    """Registration evidence of a pair of captures, as a fixed rule of their numbers and true positions."""
    r, c = ref[0], row["job_id"]
    x, y = row["tx"] - ref[3], row["ty"] - ref[4]
    return {
        "phase": (x + (r * 5 + c * 3) % 7 - 3, y + (r * 3 + c * 5) % 7 - 3, ((r * 37 + c * 11) % 100) / 100.0),
        "orb": (x + (r * 2 + c) % 5 - 2, y + (r + c * 2) % 5 - 2, ((r * 19 + c * 23) % 100) / 100.0, (r * 7 + c * 13) % 50, ((r * 11 + c * 17) % 100) / 100.0),
        "ncc": ((r * 29 + c * 31) % 100) / 100.0,
        "snap": (x + (r * 3 + c) % 5 - 2, y + (r + c * 3) % 5 - 2, ((r * 41 + c * 23) % 100) / 100.0),
    }


def pose_chain(evidence: Callable[[list, dict], dict], keep: int = 30, recent: int = 8, texture_min: float = 3.0, phase_good: float = 0.22, phase_weak: float = 0.12, ncc_min: float = 0.25, jump: float = 1.6, reach: float = 1.3, drift_px: float = 300.0) -> Fold:
    """Global pose of each capture from the chain of references, with loop closure on recent good fields.

    The state is bounded: the last `keep` fields (job, pose, true position, good). Strong feature
    evidence wins over phase correlation, which wraps beyond half a frame; an overlap that does not
    correlate, or too long a jump, is a failure, and a failed field is kept but is no reference.
    """

    def reference(s: State, row: dict) -> list | None:
        if row["anchor"] is not None and row["anchor"] == row["anchor"]:
            s["preferred"] = int(row["anchor"])
        for f in s["fields"]:
            if f[0] == s["preferred"] and f[5]:
                s["preferred"] = None  # for one field only
                return f
        by_id = {f[0]: f for f in s["fields"]}
        return by_id.get(s["last"]) or next((f for f in reversed(s["fields"]) if f[5]), None)

    def judged(e: dict, width: float) -> tuple[float, float, float, str, str]:
        px, py, response = e["phase"]
        ox, oy, strength, matches, inliers = e["orb"]
        wrapped = math.sqrt(px * px + py * py) > 0.45 * width
        if matches >= 15 and inliers >= 0.5 and strength >= 0.3:
            agree = response >= phase_good and abs(ox - px) < 25 and abs(oy - py) < 25
            return ox, oy, max(strength, response) if agree else strength, "ORB_TRANSLATION", GOOD
        if response >= phase_good and not wrapped and matches > 0:
            return px, py, response, "PHASE_CORR", GOOD
        if matches >= 8 and inliers >= 0.35:
            return ox, oy, max(strength, 0.2), "ORB_TRANSLATION", WEAK
        if response >= phase_good:
            return px, py, min(response, 0.45), "PHASE_CORR", WEAK
        if response >= phase_weak and not wrapped:
            return px, py, response, "PHASE_CORR", WEAK
        return px, py, 0.0, "PHASE_CORR", FAILED

    def closure(s: State, row: dict, ref: list, x: float, y: float, radius: float) -> tuple | None:
        best = None
        for f in [f for f in s["fields"] if f[5] and f[0] != ref[0]][-recent:]:
            dx, dy, conf = evidence(f, row)["snap"]
            if math.sqrt((f[1] - x) ** 2 + (f[2] - y) ** 2) <= radius and conf >= phase_weak and (best is None or conf > best[2]):
                best = (f[1] + dx, f[2] + dy, conf)
        return best

    def step(s: State, row: dict) -> dict:
        ref = reference(s, row)
        out = {"state": GOOD, "method": "FIRST_FIELD", "conf": 1.0, "gx": 0.0, "gy": 0.0, "ref_job": None if ref is None else ref[0], "drift": False}
        if row["texture"] < texture_min:
            return out | {"state": FAILED, "method": "FEATURELESS", "conf": 0.0}
        if ref is not None:
            diagonal = math.sqrt(row["w"] ** 2 + row["h"] ** 2)
            e = evidence(ref, row)
            dx, dy, conf, method, state = judged(e, row["w"])
            if e["ncc"] < ncc_min:
                state, conf = FAILED, min(conf, 0.05)
            if math.sqrt(dx * dx + dy * dy) > jump * diagonal:
                state, conf = FAILED, 0.0
            x, y = ref[1] + dx, ref[2] + dy
            drift = False
            if (best := closure(s, row, ref, x, y, reach * diagonal)) is not None:
                drift = math.sqrt((best[0] - x) ** 2 + (best[1] - y) ** 2) > drift_px
                if best[2] >= conf or drift:
                    x, y, conf = best[0], best[1], max(conf, best[2])
                    method, state = f"MAP_FIELD_SNAP+{method}", GOOD if best[2] >= phase_good else WEAK
            out |= {"state": state, "method": method, "conf": conf, "gx": x, "gy": y, "drift": drift}
        s["fields"].append([row["job_id"], out["gx"], out["gy"], row["tx"], row["ty"], out["state"] == GOOD])
        if out["state"] == GOOD:
            s["last"] = row["job_id"]
        if len(s["fields"]) > keep:
            gone = s["fields"].pop(0)
            if s["last"] == gone[0]:
                s["last"] = s["fields"][-1][0]
        return out | {"conf": round(out["conf"], 6), "gx": round(out["gx"], 3), "gy": round(out["gy"], 3)}

    return Fold(lambda: {"fields": [], "last": None, "preferred": None}, step, "state string, method string, conf double, gx double, gy double, ref_job long, drift boolean", ("job_id",))


# ---- bounded manual queue
def manual_queue(most: int = 20) -> Fold:
    """Job ids given out; a manual job beyond `most` waiting ones is refused and takes no id."""

    def step(s: State, row: dict) -> dict:
        given = None
        if row["kind"] == "TAKE":
            s["pending"] = max(0, s["pending"] - 1)
        elif row["kind"] == "MANUAL" and s["pending"] >= most:
            s["refused"] += 1
        else:
            given, s["next"] = s["next"], s["next"] + 1
            s["pending"] += row["kind"] == "MANUAL"
        return {"job_id": given, "pending": s["pending"], "refused": s["refused"]}

    return Fold(lambda: {"pending": 0, "next": 1, "refused": 0}, step, "job_id long, pending long, refused long", ("seq",))


# ---- capture rate
def rate_average(keep: float = 0.9) -> Fold:
    def step(s: State, row: dict) -> dict:
        if row["dt"] > 0:
            s["fps"] = 1 / row["dt"] if s["fps"] == 0 else keep * s["fps"] + (1 - keep) * (1 / row["dt"])
        return {"fps": round(s["fps"], 6)}

    return Fold(lambda: {"fps": 0.0}, step, "fps double", ("frame_index",))


# ---- incremental mosaic
def blend() -> Fold:
    """The weighted mean of what a tile holds and a new field, kept as 8 bits after every step."""

    def step(s: State, row: dict) -> dict:
        mixed = (s["value"] * s["total"] + row["pixel"] * row["weight"]) / (s["total"] + row["weight"] + 1e-6)
        s["value"], s["total"] = math.floor(min(255.0, max(0.0, mixed))), s["total"] + row["weight"]
        return {"value": s["value"], "total": round(s["total"], 9)}

    return Fold(lambda: {"value": 0, "total": 0.0}, step, "value long, total double", ("job_id",))
