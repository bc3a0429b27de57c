"""Interventions on traces as their paragraphs arrive, as a stateful stream.

The stream brings (rollout_id, trace_id, paragraph_idx, paragraph, ts). Types and symbols
are columns, computed before the state is touched; the state of a trace holds its steps'
types and inputs, the symbols of the last ten, and paragraphs that came too early. Edges
never change once both steps are there, so a paragraph costs one look back over ten steps
and one backward pass. What comes out equals the batch operator on the same paragraphs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators.motifs import REVISIT_SHARE

OUT = "rollout_id bigint, trace_id int, step_id int, num_steps int, num_dead int, intervention string"
STATE = "state string"


def live_steps(types: list[str], inputs: list[list[int]]) -> set[int]:
    seeds = {i for i, t in enumerate(types) if t == "conclusion"} or {len(types) - 1}
    live = set(seeds)
    for i in range(len(types) - 1, -1, -1):
        if i in live:
            live.update(inputs[i])
    return live


def _islands(ids: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i in ids:
        if out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


class TraceState:
    """The steps seen of one trace."""

    def __init__(self, saved: str | None = None, motifs: bool = False):
        self.motifs = motifs
        d = json.loads(saved) if saved else {}
        self.types: list[str] = d.get("types", [])
        self.symbols: list[list[str]] = d.get("symbols", [])  # of the last LOOKBACK steps: no edge reaches farther; of all where motifs are counted
        self.inputs: list[list[int]] = d.get("inputs", [])
        self.early: dict[str, list] = d.get("early", {})

    def saved(self) -> str:
        return json.dumps({"types": self.types, "symbols": self.symbols, "inputs": self.inputs, "early": self.early})

    def arrive(self, place: int, kind: str, symbols: list[str]) -> Iterator[tuple[int, int, int, str | None]]:
        """Take a paragraph; (step, steps, dead, intervention) for it and for early ones it makes room for. Known places are ignored."""
        if place >= len(self.types):
            self.early[str(place)] = [kind, symbols]
        while (nxt := self.early.pop(str(len(self.types)), None)) is not None:
            self._append(*nxt)
            yield self._look()

    def rest(self) -> Iterator[tuple[int, int, int, str | None]]:
        """Take what still waits, in order, gaps closed: what is missing will not come any more."""
        for place in sorted(self.early, key=int):
            self._append(*self.early[place])
            yield self._look()
        self.early = {}

    def _append(self, kind: str, symbols: list[str]) -> None:
        i = len(self.types)
        mine, own = set(symbols), []
        if i and kind in fixed.CHAIN_TYPES and self.types[i - 1] in fixed.CHAIN_TYPES:
            own.append(i - 1)
        first = i - len(self.symbols)
        own += [j for j in range(max(0, i - fixed.LOOKBACK), i) if j not in own and not mine.isdisjoint(self.symbols[j - first])]
        if kind == "conclusion" and not own and i:
            own = [i - 1]
        self.types.append(kind)
        self.symbols.append(list(symbols))
        if not self.motifs:
            self.symbols = self.symbols[-fixed.LOOKBACK :]
        self.inputs.append(own)

    def _look(self) -> tuple[int, int, int, str | None]:
        n = len(self.types)
        last, live = n - 1, live_steps(self.types, self.inputs)
        dead = [i for i in range(n) if i not in live]
        what = None
        if any(b - a >= 2 and b >= last - 1 for a, b in _islands(dead)):
            what = "redirect_cascade"
        elif last not in live and self.types[last] == "verification" and not live.intersection(self.inputs[last]):
            what = "skip_theater"
        elif last not in live:
            i = last
            while i >= 0 and i not in live and self.types[i] != "exploration":
                i -= 1
            if i >= 0 and i not in live and last - i >= 2:
                what = "redirect_branch"
        return (last, n, len(dead), what, self._motifs(live, dead)) if self.motifs else (last, n, len(dead), what)

    def _motifs(self, live: set[int], dead: list[int]) -> int:
        """How many motifs the steps so far hold."""
        types, found = self.types, sum(b - a >= 2 for a, b in _islands(dead))
        found += len(_islands([i for i in dead if types[i] == "verification" and not live.intersection(self.inputs[i])]))
        for i in dead:
            own = set(self.symbols[i])
            if types[i] == "exploration":
                end = next((j for j in range(i + 1, len(types)) if j in live or types[j] == "exploration"), len(types))
                found += end - i >= 2
            elif types[i] in ("derivation", "computation") and len(own) >= 2:
                found += any(j < i and len(own.intersection(self.symbols[j])) / len(own) >= REVISIT_SHARE for j in live)
        return found


def _updater(motifs: bool, names: list[str]):
    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            left = [(*key, *x) for x in TraceState(state.get[0], motifs).rest()]
            state.remove()
            yield pd.DataFrame(left, columns=names)
            return
        s = TraceState(state.get[0] if state.exists else None, motifs)
        rows = []
        for f in frames:
            for r in f.sort_values("paragraph_idx").itertuples():
                rows += [(*key, *x) for x in s.arrive(int(r.paragraph_idx), r.step_type, list(r.sym))]
        state.update((s.saved(),))
        if state.getCurrentWatermarkMs() > 0:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 3_600_000)
        yield pd.DataFrame(rows, columns=names)

    return update


def paragraphs(traces: DataFrame) -> DataFrame:
    """Traces as the rows such a stream brings."""
    seg = F.transform(text.segments(F.col("solution")), lambda x, i: F.struct(i.alias("paragraph_idx"), x.alias("paragraph")))
    return traces.select("rollout_id", "trace_id", F.explode(seg).alias("s")).select("rollout_id", "trace_id", "s.*")


def watch(stream: DataFrame, late: str = "1 hour", motifs: bool = False) -> DataFrame:
    """Per paragraph: the step, steps and dead steps so far, and the intervention (null for none); with ``motifs`` also how many motifs there are, for which the state keeps all symbols.

    Needs rollout_id, trace_id, paragraph_idx, paragraph and an event time ``ts``. Paragraphs
    later than ``late`` behind the watermark are dropped, and a trace's state goes an hour
    after its last paragraph; paragraphs that still wait then are taken in order, gaps
    closed, and so is what comes of a trace after that. Order inside a trace comes from
    paragraph_idx: early ones wait in the state, repeated ones are ignored.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    out = OUT + (", num_motifs int" if motifs else "")
    names = [c.split()[0] for c in out.split(", ")]
    p = text.trim_all(F.col("paragraph"))
    typed = stream.withWatermark("ts", late).select("rollout_id", "trace_id", "paragraph_idx", text.step_type(p, F.lower(p)).alias("step_type"), text.symbols(p).alias("sym"), "ts")
    return typed.groupBy("rollout_id", "trace_id").applyInPandasWithState(_updater(motifs, names), out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
