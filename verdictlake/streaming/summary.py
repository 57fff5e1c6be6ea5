"""The verdict summary over a stream of results, and per-stream classification with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.verdicts import summarize


def summarize_stream(results: DataFrame, *, verdict: str = "verdict") -> DataFrame:
    """The summary of all that a finite stream holds now, by incremental aggregation to completion."""
    return run_to_end(summarize(results, verdict=verdict, with_text=False), "complete")


def run_to_end(rows: DataFrame, mode: str = "append") -> DataFrame:
    """What a finite stream gives, kept in memory."""
    name = f"stream_{uuid.uuid4().hex}"
    running = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return rows.sparkSession.table(name)


STATE = "failed array<string>, started array<string>, ran array<string>, broken array<string>, lost boolean, seq long"
OUTPUT = "stream_id string, verdict string, tests string"


def _classify(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failed, started, ran, broken, lost, _ = state.get if state.exists else ([], [], [], [], False, -1)
    failed, started, ran, broken, done = set(failed), set(started), set(ran), set(broken), False
    rows = pd.concat(frames)
    for r in rows.sort_values("seq").itertuples():
        name = f"{r.Package}\0{r.Test}"
        if r.Action == "end":
            done = True
        elif r.Action == "output" and not r.Test and r.broken:
            broken.add(r.Package)
        elif r.Test and r.Action == "run":
            started.add(name), ran.add(r.Package)
        elif r.Test and r.Action in ("pass", "skip", "fail"):
            started.discard(name)
            if r.Action == "fail":
                failed.add(name)
        lost = lost or bool(r.lost)
    if not done:
        state.update((sorted(failed), sorted(started), sorted(ran), sorted(broken), lost, int(rows["seq"].max())))
        return
    if state.exists:
        state.remove()
    names = sorted({x.split("\0", 1)[1] for x in failed | started})
    verdict = "KILLED" if names else "UNKNOWN" if lost else "INVALID" if broken - ran else "KILLED"
    yield pd.DataFrame({"stream_id": [key[0]], "verdict": [verdict], "tests": [",".join(names)]})


def classify_live(events: DataFrame) -> DataFrame:
    """(stream_id, verdict, tests) of each stream once its ``end`` event came; events (stream_id, seq, Package, Test, Action, broken, lost) of one stream must come in order of their batches."""
    return events.groupBy("stream_id").applyInPandasWithState(_classify, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
