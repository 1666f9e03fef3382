"""Folds over a timeline whose state depends on earlier decisions.

No window function can express them: the state is the last *selected* row, not the last
row. But a video need not be folded in one go:

* a memo begins anew at every keyframe, so its rows are dealt by video and number of the
  keyframe they follow;
* a gate's state is a row of the last ``most_gap_us`` or plays no part any more, as then
  the next row is selected whatever was before. Each stretch is folded once for all rows that
  its state may be when it begins, which gives one short row a stretch, the state at its end
  for each state at its beginning; these are chained along the video, and each stretch is
  folded again from the state that is now known.

Rows stream by in Arrow batches: a task holds a state (or those that a stretch may begin
with) and one batch; no video is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.operators.stretches import STRETCH_US, counted, place_of

#: Frames that are compared with the last recognised one at once, at most.
LOOK_AHEAD = 256


def in_order(rows: DataFrame, fold: Callable, out: str, out_type: str, keys: Sequence[str] = ("video",), order: Sequence[str] = ("t_us", "ord")) -> DataFrame:
    """rows with the column out: fold(state, batch) -> (state, values) over the batches of each key in order; state starts as None."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` {out_type}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for batch in batches:
            values, owner = np.empty(len(batch), object), [batch[k].astype(object).where(batch[k].notna(), None).to_numpy() for k in keys]
            changed = np.any([c[1:] != c[:-1] for c in owner], axis=0)
            begins = np.flatnonzero(np.r_[True, changed]) if len(batch) else np.zeros(0, np.int64)
            for a, b in zip(begins, [*begins[1:], len(batch)], strict=True):
                if (here := tuple(c[a] for c in owner)) != key:
                    key, state = here, None
                state, values[a:b] = fold(state, batch.iloc[a:b])
            batch[out] = pd.Series(values, index=batch.index, dtype=object)
            yield batch

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


@dataclass(frozen=True)
class GateConfig:
    """When a changed screen is worth a model call."""

    skip_from_jaccard: float = 0.85
    least_gap_us: int = 10_000_000
    most_gap_us: int = 120_000_000
    least_union: int = 3


def gate_rules(elapsed_us: int, own: int, before: int, shared: int, config: GateConfig) -> Iterator[tuple[bool, bool]]:
    """The gate's decision table, (applies, selects) by rank, from the time and the sizes of the two token sets and of what they share."""
    union = own + before - shared
    yield elapsed_us >= config.most_gap_us, True
    yield elapsed_us < config.least_gap_us, False
    yield min(own, before) == 0 < max(own, before), True
    yield union < config.least_union, False
    yield True, shared / max(union, 1) < config.skip_from_jaccard


class ChangeGate:
    """The last selected screen of one video."""

    def __init__(self, config: GateConfig, at_us: int | None = None, tokens: Iterable[str] = ()):
        self.config, self.at_us, self.tokens = config, at_us, frozenset(tokens)

    def selects(self, at_us: int, tokens: Iterable[str]) -> bool:
        """Whether the screen is selected; it then becomes the last one. The first one always is."""
        tokens = frozenset(tokens)
        rules = [(True, True)] if self.at_us is None else gate_rules(at_us - self.at_us, len(tokens), len(self.tokens), len(tokens & self.tokens), self.config)
        chosen = next(selects for applies, selects in rules if applies)
        if chosen:
            self.at_us, self.tokens = at_us, tokens
        return chosen


def change_gate(keyframes: DataFrame, config: GateConfig = GateConfig(), width: int = STRETCH_US) -> DataFrame:  # noqa: B008  frozen
    """keyframes (video, t_us, ord, tokens) with selected: whether the screen changed since the last selected one.

    ord is unique in a video. Frames without a time are not selected and change nothing; null
    tokens are none. Stretches are of width, or of most_gap_us where that is more.
    """
    width = max(width, config.most_gap_us)
    own = keyframes.withColumns({"__at": place_of("video", "t_us", width), "__early": F.lit(False)})
    # what a stretch's state may be when it begins: rows of the stretch before, from most_gap_us before its last one on
    late = F.col("t_us") > F.max("t_us").over(Window.partitionBy("__at")) - config.most_gap_us
    following = F.struct(F.col("__at.key").alias("key"), (F.col("__at.stretch") + 1).alias("stretch"))
    early = own.withColumn("__late", late).filter("__late").drop("__late").withColumns({"__at": following, "__early": F.lit(True)})
    begun = own.select("__at").distinct()
    rows = own.unionByName(early.join(begun, "__at", "left_semi")).withColumns({"video": F.col("__at.key"), "__stretch": F.col("__at.stretch")}).drop("__at")
    states = _gate_states(rows.select("video", "__stretch", "__early", "t_us", "ord", "tokens").filter(F.col("t_us").isNotNull()), config)

    def fold(state, batch):
        gate, out = state or ChangeGate(config), []
        for early, begins, t, tokens in zip(*(batch[c] for c in ("__early", "__begins", "t_us", "tokens")), strict=True):
            if begins:
                gate = ChangeGate(config, int(t), _tokens(tokens))
            out.append(not early and not pd.isna(t) and gate.selects(int(t), _tokens(tokens)))
        return gate, out

    known = rows.withColumn("__at", F.struct("video", "__stretch")).join(states, "__at", "left").drop("__at")
    begins = F.col("__early") & F.coalesce(F.col("ord") == F.col("__begins"), F.lit(False))
    # of each stretch the rows before it come first, as their times are lower
    found = in_order(known.withColumn("__begins", begins), fold, "selected", "boolean", ("video", "__stretch"))
    return found.filter(~F.col("__early")).select(*keyframes.columns, "selected")


def _tokens(value) -> Iterable[str]:
    return () if value is None else value


def _gate_states(rows: DataFrame, config: GateConfig) -> DataFrame:
    """(__at, __begins): the ord of the row that is each stretch's state as it begins; null where there is none or it plays no part."""
    schema = f"video {rows.schema['video'].dataType.simpleString()}, __stretch long, __from array<long>, __to array<long>, __to_first long"

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each stretch: the last row selected, or else the state itself, for every row that may be its state and for none."""
        key, gates = None, []

        def told() -> pd.DataFrame:
            pairs = [(c, c if to is None else to) for _, to, held in gates for c in held]
            known = [(c, to) for c, to in pairs if c is not None]
            return pd.DataFrame([[*key, [c for c, _ in known], [to for _, to in known], next(to for c, to in pairs if c is None)]], columns=["video", "__stretch", "__from", "__to", "__to_first"])

        for batch in batches:
            videos = batch["video"].astype(object).where(batch["video"].notna(), None)
            for *owner, early, t, ord_, tokens in zip(videos, *(batch[c] for c in ("__stretch", "__early", "t_us", "ord", "tokens")), strict=True):
                if owner != key:
                    if key is not None:
                        yield told()
                    key, gates = owner, [(ChangeGate(config), None, [None])]
                words = frozenset(_tokens(tokens))
                if early:
                    gates.append((ChangeGate(config, t, words), None, [ord_]))
                    continue
                chosen = [g[0].selects(t, words) for g in gates]
                if any(chosen):
                    # those that select it are in one state from now on
                    alike = (ChangeGate(config, t, words), ord_, [c for g, yes in zip(gates, chosen, strict=True) if yes for c in g[2]])
                    gates = [*(g for g, yes in zip(gates, chosen, strict=True) if not yes), alike]
        if key is not None:
            yield told()

    def chain(state, batch):
        out, (stretch, last) = [], state or (None, None)
        for at, begins, to, first in zip(*(batch[c] for c in ("__stretch", "__from", "__to", "__to_first")), strict=True):
            near = last if stretch is not None and at == stretch + 1 else None
            out.append(near)
            stretch, last = at, int(dict(zip(begins, to, strict=True)).get(near, first))
        return (stretch, last), out

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chains = rows.repartition(parts, "video", "__stretch").sortWithinPartitions("video", "__stretch", "t_us", "ord").mapInPandas(ends, schema)
    chained = in_order(chains, chain, "__begins", "long", order=("__stretch",))
    return chained.select(F.struct("video", "__stretch").alias("__at"), "__begins")


def memo_skip(frames: DataFrame, similar: Callable | None, value: str) -> DataFrame:
    """frames (video, t_us, ord, is_keyframe, value) with source_ord: the frame whose recognition each one reuses.

    A frame is recognised itself if it is the first, a keyframe, nothing compares, or it
    is not similar to the last recognised one. similar(value, values) answers for many
    values at once: for one at first, for twice as many each time it finds all alike,
    LOOK_AHEAD at most. So a long run costs few calls, and no more than two comparisons are
    made for each frame. A null is_keyframe is none.
    """
    key = F.coalesce(F.col("is_keyframe"), F.lit(False))
    if similar is None:
        return frames.withColumn("source_ord", F.col("ord"))

    def fold(state, batch):
        (last, ahead), ords, values = state or (None, 1), batch["ord"].to_numpy(), batch[value].to_numpy()
        out, at = np.empty(len(batch), object), 0
        while at < len(batch):
            if last is None:
                last, out[at], at = (ords[at], values[at]), ords[at], at + 1
                continue
            end = min(at + ahead, len(batch))
            unlike = np.flatnonzero(~np.asarray(similar(last[1], values[at:end]), bool))
            to = at + int(unlike[0]) if len(unlike) else end
            out[at:to] = last[0]
            last, ahead, at = (None, 1, to) if len(unlike) else (last, min(2 * ahead, LOOK_AHEAD), to)
        return (last, ahead), out

    parts = counted(frames, "__memo", key.cast("int"))
    return in_order(parts, fold, "source_ord", "long", ("video", "__memo")).drop("__memo")


def nearby(most: float) -> Callable:
    """For memo_skip over vectors: mean absolute difference below most."""

    def similar(one, many):
        return np.abs(np.stack(many).astype(np.float64) - np.asarray(one, np.float64)).mean(1) < most

    return similar


def keyframes_only(frames: DataFrame, recognise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """frames with lines and unread: keyframes are recognised, a failed one (unread) and all others get an empty array; the others never reach the model."""
    key = F.coalesce(F.col("is_keyframe"), F.lit(False))
    empty = F.array().cast("array<string>")
    seen = recognise(frames.filter(key)).withColumn("unread", F.col("lines").isNull()).withColumn("lines", F.coalesce("lines", empty))
    return seen.unionByName(frames.filter(~key).withColumns({"unread": F.lit(False), "lines": empty}))


def recognised(frames: DataFrame, recognise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """frames (with source_ord), lines and unread: only distinct sources are recognised, their lines joined back.

    recognise adds ``lines`` to frames; a failed one gives null. Later frames do not
    inherit a failure: they get an empty array, as the failed frame itself does, which alone is unread.
    """
    own = recognise(frames.filter(F.col("source_ord") == F.col("ord"))).select("video", F.col("ord").alias("source_ord"), "lines")
    out = frames.join(own, ["video", "source_ord"], "left").withColumn("unread", F.col("lines").isNull() & (F.col("source_ord") == F.col("ord")))
    return out.withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
