"""The tracker over a stream of candidate rows, with the same step as in batch."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..operators.tracks import EMITTED, State, Track, advance, emitted, frames_of


def track_stream(candidates: DataFrame, config: Config, idle_ms: int | None = None) -> DataFrame:
    """Emitted tracks per camera and frame. A frame must arrive within one micro-batch; frames that come late are dropped.

    A frame without candidates counts as missed by all tracks once a later frame, or a row without observation_id, tells of
    it. State holds living tracks only (they expire by misses), one row for each camera. With idle_ms a camera that is idle for
    so long is forgotten; Spark then runs batches without input all the time to look for timeouts, so give such a query a
    trigger interval.
    """

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in EMITTED.split(", ")]
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([], columns=columns)
            return
        state = State()
        if held.exists:
            text, state.next_id, state.last_frame = held.get
            state.tracks = [Track(**(t | {"box": tuple(t["box"])})) for t in json.loads(text)]
        out = []
        for frame, own in frames_of(pd.concat(list(batches))):
            for f, tracks in advance(state, frame, own, config):
                out += emitted(key[0], f, tracks)
        held.update((json.dumps([asdict(t) for t in state.tracks]), state.next_id, state.last_frame))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return candidates.groupBy("camera_id").applyInPandasWithState(run, EMITTED, "tracks string, next_id long, last_frame long", "append", timeout)
