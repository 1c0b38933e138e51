"""Streams whose late rows correct what came before them.

Each key has a state that holds what a batch query over all its rows so far would need;
a batch's rows change it, and the differences come out as rows with a version that grows
by key: the last version of a row is the one that holds. A key that is not heard of for
``idle`` milliseconds is forgotten, and begins anew if it comes back. Timeouts ask for
batches without data; a stream that is to end when all is read (trigger availableNow) runs
with spark.sql.streaming.noDataMicroBatches.enabled off.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

IDLE = 7 * 24 * 3600 * 1000
STATE = "held string, version long"
BEST = "run_id string, tag string, step long, best double, improved boolean, version long"
JOBS = "subject string, session string, pre string, post string, reference string, planned boolean, version long"


def staircase(rows: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The steps at which the best value so far rises above 0 and all before."""
    out, best = [], 0.0
    for step, value in sorted(rows, key=lambda r: (r[0], -r[1])):
        if value > best:
            out.append((step, value))
            best = value
    return out


def _turned(state: GroupState) -> tuple[str | None, int]:
    return state.get if state.exists else (None, 0)


def running_best(metrics: DataFrame, idle: int = IDLE) -> DataFrame:
    """A stream of run_id, tag, step, value -> the improvements: a late metric may add one
    and take back later ones (improved false). A key holds its improvements, not its rows.
    Of several values at a step the largest counts; null steps and values do not."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, version = _turned(state)
        old = [tuple(x) for x in json.loads(held or "[]")]
        rows = [r for b in batches for r in zip(b["step"].tolist(), b["value"].tolist())]
        new = staircase(old + rows)
        version += 1
        state.update((json.dumps(new), version))
        state.setTimeoutDuration(idle)
        changed = [(*key, s, v, True, version) for s, v in new if (s, v) not in old] + [(*key, s, v, False, version) for s, v in old if s not in dict(new)]
        yield pd.DataFrame(changed, columns=["run_id", "tag", "step", "best", "improved", "version"])

    able = metrics.where("step is not null and value is not null and not isnan(value)").select("run_id", "tag", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    return able.groupBy("run_id", "tag").applyInPandasWithState(update, BEST, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def planned(files: dict[str, dict[str, list[str]]], base: str) -> set[tuple]:
    """Jobs of one subject (session -> kind -> paths), by the rule of ``coregistration_jobs``."""
    out = set()
    for session, kinds in files.items():
        if session == base or "Done" in kinds:
            continue
        for pre in kinds.get("Petra_Pre", []):
            for reference in files.get(base, {}).get("T1", []):
                out |= {(session, pre, post, reference) for post in kinds.get("Petra_Post", [None])}
    return out


def work_list(files: DataFrame, base: str = "base", idle: int = IDLE) -> DataFrame:
    """A stream of subject, session, kind, path (kind Done: the session has its output) ->
    jobs that are planned or taken back, whatever the order in which files come."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, version = _turned(state)
        known = json.loads(held or "{}")
        before = planned(known, base)
        for b in batches:
            for session, kind, path in zip(b["session"], b["kind"], b["path"]):
                paths = known.setdefault(session, {}).setdefault(kind, [])
                if path not in paths:
                    paths.append(path)
        now = planned(known, base)
        version += 1
        state.update((json.dumps(known), version))
        state.setTimeoutDuration(idle)
        rows = [(*key, *j, True, version) for j in now - before] + [(*key, *j, False, version) for j in before - now]
        yield pd.DataFrame(rows, columns=["subject", "session", "pre", "post", "reference", "planned", "version"])

    able = files.where("subject is not null and session is not null and kind is not null").select("subject", "session", "kind", "path")
    return able.groupBy("subject").applyInPandasWithState(update, JOBS, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def standing(changes: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """What holds after all changes: the rows whose last version has the flag."""
    last = Window.partitionBy(*keys).orderBy(F.desc("version"), F.desc(flag))
    return changes.withColumn("_n", F.row_number().over(last)).where((F.col("_n") == 1) & F.col(flag)).drop("_n", flag, "version")
