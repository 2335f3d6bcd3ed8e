"""Chunks with context from a stream of text fragments, with state for each request.

Fragments may cut a code in two: what follows the last whole code waits for the next fragment. A chunk is
emitted once it and its context have arrived; the end mark flushes the rest. Emitted chunks equal those of the batch operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

END = "[DONE]"
#: The client has gone: nothing more is emitted of the request, and its state goes.
CANCEL = "[CANCEL]"
CODE = re.compile(r"<\|s_(\d+)\|>")
CHUNKS = "request string, k int, start int, end int, codes array<int>"
STATE = "rest string, codes array<int>, k int, first int"


def step(rest: str, codes: list[int], k: int, first: int, fragments: list[str], chunk: int, context: int) -> tuple[str, list[int], int, int, list[tuple]]:
    """One step of a request: codes are kept only as far back as the next chunk's context reaches (``first`` is the number of the oldest)."""
    out = []
    for fragment in fragments:
        if fragment == END:
            seen = first + len(codes)
            if k * chunk < seen:
                start = k * chunk
                out.append((k, start, seen, codes[max(start - context, 0) - first :]))
                k = -(-seen // chunk)
            rest = ""
            continue
        rest += fragment
        last = 0
        for m in CODE.finditer(rest):
            codes.append(int(m[1]))
            last = m.end()
        rest = rest[last:]
        while (k + 1) * chunk + context <= first + len(codes):
            start, end = k * chunk, (k + 1) * chunk
            out.append((k, start, end, codes[max(start - context, 0) - first : end + context - first]))
            k += 1
            drop = max(k * chunk - context, 0) - first
            if drop > 0:
                codes, first = codes[drop:], first + drop
    return rest, codes, k, first, out


def in_order(frames: Iterator[pd.DataFrame], *columns: str) -> list[list]:
    """Columns of a request's rows in the order of ``seq``; plain lists, since frames cost more than most requests."""
    frames = list(frames)
    seqs = [s for f in frames for s in f["seq"].tolist()]
    order = sorted(range(len(seqs)), key=seqs.__getitem__)
    return [[values[i] for i in order] for values in ([v for f in frames for v in f[c].tolist()] for c in columns)]


def chunk_stream(fragments: DataFrame, chunk: int, context: int, idle: int | None = None) -> DataFrame:
    """Chunks of a stream with columns request, seq and fragment. Within a micro-batch fragments are taken in the order of ``seq``.

    A request that gets nothing for ``idle`` milliseconds is taken to have ended: what it holds is flushed and its state goes.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, codes, k, first = state.get if state.exists else ("", [], 0, 0)
        if state.hasTimedOut:
            *_, out = step(rest, list(codes), k, first, [END], chunk, context)
            state.remove()
            if out:
                yield pd.DataFrame([(key[0], *o) for o in out], columns=["request", "k", "start", "end", "codes"])
            return
        (texts,) = in_order(frames, "fragment")
        if CANCEL in texts:
            state.remove()
            return
        rest, codes, k, first, out = step(rest, list(codes), k, first, texts, chunk, context)
        if idle and END in texts:
            state.remove()
        else:
            state.update((rest, codes, k, first))
            if idle:
                state.setTimeoutDuration(idle)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["request", "k", "start", "end", "codes"])

    return fragments.groupBy("request").applyInPandasWithState(run, CHUNKS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
