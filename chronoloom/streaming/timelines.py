"""Streaming twins of the run operators: state per video, late rows bounded by a watermark.

An extension: stored timelines need only the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.operators.folds import ChangeGate, GateConfig
from chronoloom.operators.runs import RUN_KEY

OUT = "video string, ord long, t_us long, action string, resource string, location string"


def collapsed_stream(entries: DataFrame) -> DataFrame:
    """The first row of each run as it arrives; entries (video string, ord, t_us, action, resource, location) come in order per video and trigger."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t_us", "ord"])
        last = tuple(state.get) if state.exists else None
        kept = []
        for row in rows.itertuples(index=False):
            now = tuple(None if pd.isna(x) else x for x in (getattr(row, c) for c in RUN_KEY))
            if last is None or now != last:
                kept.append(row)
            last = now
        if last is not None:
            state.update(last)
        yield pd.DataFrame(kept, columns=rows.columns)

    columns = [x.split()[0] for x in OUT.split(", ")]
    return entries.select(columns).groupBy("video").applyInPandasWithState(step, OUT, "action string, resource string, location string", "append", GroupStateTimeout.NoTimeout)


def gated_stream(keyframes: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:  # noqa: B008  frozen
    """Keyframes (video string, ord, t_us, tokens) that the change gate selects, as they arrive."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t_us", "ord"])
        gate = ChangeGate(config, *(state.get if state.exists else ()))
        kept = [(r.video, r.ord, r.t_us) for r in rows.itertuples(index=False) if gate.selects(r.t_us, r.tokens)]
        if gate.at_us is not None:
            state.update((int(gate.at_us), sorted(gate.tokens)))
        yield pd.DataFrame(kept, columns=["video", "ord", "t_us"])

    picked = keyframes.select("video", "ord", "t_us", "tokens")
    return picked.groupBy("video").applyInPandasWithState(step, "video string, ord long, t_us long", "t_us long, tokens array<string>", "append", GroupStateTimeout.NoTimeout)


def dwell_stream(entries: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Seconds per application in tumbling windows; entries have ts, app and duration_us, late ones wait for the watermark."""
    app = F.coalesce(F.when(F.length("app") > 0, F.col("app")), F.lit("（不明）")).alias("app")
    return entries.withWatermark("ts", late).groupBy(F.window("ts", window), app).agg(F.sum("duration_us").alias("total_us"))
