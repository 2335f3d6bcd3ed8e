"""Streams of requests that may fail, fall silent or be cancelled, with timers and state of their own.

Fragments of a request carry codes, the end mark, the cancel mark, or an error. Whatever happens, a request ends: by its end, which flushes what is left, by a
cancel, which drops it, by an error, which is told in a row of its own, or by silence, which is told as an error too. What comes after the end is ignored
until the request's state is forgotten, ``idle`` milliseconds later.

State lives in RocksDB and grows with open requests only: codes as far back as the next context reaches, samples that wait for the next window. Chunks keep it in one
row, which comes and goes with the request's fragments; sounds keep it in lists with timers, where every call is a message, which decoding outweighs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessitura.streaming.chunks import CANCEL, CODE, END, in_order, step

CHUNKS = "request string, k int, start int, end int, codes array<int>, error string"
STATE = "rest string, codes array<int>, k int, first int, closed boolean"
SOUNDS = "request string, k int, start int, end int, samples array<float>, error string"
SILENT = "no fragment for {} ms"
MARGIN = 256
Decode = Callable[[list[int]], np.ndarray]


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep their state in RocksDB, as timers and lists need; ``spark`` itself stays as it is."""
    other = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(name, spark.conf.get(name))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return other


def taken(rows: Iterable[tuple[str | None, str | None]], closed: bool) -> tuple[list[str], str | None, bool]:
    """(fragments, error, closed) of a request's rows (fragment, error) in order, up to what ends it."""
    texts, error = [], None
    for text, bad in rows:
        if closed:
            break
        if isinstance(bad, str):
            error, closed = bad, True
        elif text == CANCEL:
            closed = True
        elif isinstance(text, str):
            texts.append(text)
            closed = text == END
    return texts, error, closed


def told(columns: tuple[str, ...], key: object, found: list[tuple], error: str | None = None) -> pd.DataFrame:
    """Rows of what a request gives, and of its error."""
    rows = [(key, *f, None) for f in found] + ([(key, None, None, None, None, error)] if error is not None else [])
    return pd.DataFrame(rows, columns=list(columns), dtype=object)


class Sounds(StatefulProcessor):
    """Windows of the last two chunks, decoded, without what the window before has given, cut at a change of sign; what is cut off waits for the next window.

    ``decode`` makes a fixed number of samples of each code. The last ``context`` codes of a window are given by the next one, or at the end.
    """

    columns = ("request", "k", "start", "end", "samples", "error")

    def __init__(self, chunk: int, context: int, idle: int | None, decode: Decode) -> None:
        self.chunk, self.context, self.idle, self.decode = chunk, context, idle, decode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.codes = handle.getListState("codes", "code int")
        self.place = handle.getValueState("place", "rest string, k int, first int, closed boolean")
        self.left = handle.getListState("left", "sample float")

    def close(self) -> None:
        pass

    def forget(self) -> None:
        self.codes.clear()
        self.left.clear()

    def fragments(self, texts: list[str], rest: str, k: int, first: int) -> tuple[str, int, int, list[tuple]]:
        """What some fragments add, as (rest, k, first, rows of k, start, end, samples); the state of codes and samples follows."""
        held = [] if self.fresh else [int(c[0]) for c in self.codes.get()]
        left = np.array([] if self.fresh else [x[0] for x in self.left.get()], np.float32)
        held, rest, k, first, left, out = windows(texts, held, rest, k, first, left, self.chunk, self.context, self.decode)
        for state, values in ((self.codes, held), (self.left, left.tolist())):
            if len(values):
                state.put([(v,) for v in values])
            elif not self.fresh:
                state.clear()
        return rest, k, first, out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        place = self.place.get()  # every call of the state is a message to the JVM
        self.fresh = place is None
        rest, k, first, closed = place or ("", 0, 0, False)
        texts, error, closed = taken(zip(*in_order(rows, "fragment", "error")), closed)
        out = []
        if texts:
            rest, k, first, out = self.fragments(texts, rest, k, first)
        if closed and (texts or not self.fresh):
            self.forget()
        if self.idle or not closed:
            self.place.update(("" if closed else rest, k, first, closed))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        elif closed and not self.fresh:
            self.place.clear()
        if out or error is not None:
            yield told(self.columns, key[0], out, error)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        closed = self.place.get()[3] if self.place.exists() else True
        self.forget()
        self.place.clear()
        yield told(self.columns, key[0], [], None if closed else SILENT.format(self.idle))


def cut_at_crossing(samples: np.ndarray, margin: int = MARGIN) -> int:
    """Where to cut: the last change of sign within the final ``margin`` samples; the end of short sounds and of those without one."""
    if len(samples) < 2 * margin:
        return len(samples)
    signs = np.signbit(samples[-margin:])
    changes = np.flatnonzero(signs[1:] != signs[:-1])
    return len(samples) - margin + int(changes[-1]) if len(changes) else len(samples)


def windows(texts: list[str], held: list[int], rest: str, k: int, first: int, left: np.ndarray, chunk: int, context: int, decode: Decode) -> tuple[list[int], str, int, int, np.ndarray, list[tuple]]:
    """One step: codes of the last window, what waits of a cut code and of samples, the number of windows given, and rows (k, start, end, samples).

    ``first`` is the number of the first held code; ``start`` and ``end`` are the codes that a window newly gives.
    """
    out = []

    def given(end: int, whole: bool) -> np.ndarray:
        """The samples from the last given code to ``end``, behind those that waited."""
        start = max(k * chunk - context, 0) if k else 0
        decoded = decode(held)
        per = len(decoded) // len(held) if held else 0
        fresh = np.clip(decoded[(start - first) * per : (end - first) * per], -1, 1).astype(np.float32)
        both = np.concatenate((left, fresh))
        cut = len(both) if whole else cut_at_crossing(both)
        out.append((k, start, end, both[:cut].tolist()))
        return both[cut:]

    for text in texts:
        if text == END:
            if held:
                left = given(first + len(held), True)
            return [], "", k + 1, first, np.zeros(0, np.float32), out
        rest += text
        found = list(CODE.finditer(rest))
        for m in found:
            held.append(int(m[1]))
            if first + len(held) == (k + 1) * chunk:
                left = given(max(first + len(held) - context, 0), False)
                k += 1
                drop = len(held) - chunk
                held, first = held[drop:], first + drop
        rest = rest[found[-1].end() :] if found else rest
    return held, rest, k, first, left, out


def request_chunks(fragments: DataFrame, chunk: int, context: int, idle: int | None = None) -> DataFrame:
    """Chunks and errors of a stream with columns request, seq (a whole number), fragment and error, made in a ``streaming_session``.

    Within a micro-batch fragments are taken in the order of ``seq``. Without ``idle`` requests wait for ever, and state of ended ones goes at once.
    """
    columns = ("request", "k", "start", "end", "codes", "error")

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.exists
        rest, codes, k, first, closed = state.get if known else ("", [], 0, 0, False)
        if state.hasTimedOut:
            state.remove()
            if not closed:
                yield told(columns, key[0], [], SILENT.format(idle))
            return
        found = sorted((r for f in rows for r in f["row"].tolist()), key=lambda r: (r[0] is not None, int(r[0] or 0)))
        texts, error, closed = taken(((text, bad) for _, text, bad in found), closed)
        out = []
        if texts:
            rest, codes, k, first, out = step(rest, list(codes), k, first, texts, chunk, context)
        if idle or not closed:
            state.update(("", [], k, first, True) if closed else (rest, codes, k, first, False))
            if idle:
                state.setTimeoutDuration(idle)
        elif known:
            state.remove()
        if out or error is not None:
            yield told(columns, key[0], out, error)

    wait = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    packed = fragments.select("request", F.array(F.col("seq").cast("string"), "fragment", "error").alias("row"))  # each column of a request costs as much as its rows
    return packed.groupBy("request").applyInPandasWithState(run, CHUNKS, STATE, "append", wait)


def request_sounds(fragments: DataFrame, chunk: int, context: int, decode: Decode, idle: int | None = None) -> DataFrame:
    """Decoded windows and errors of a stream, in the same way."""
    rows = fragments.select("request", "seq", "fragment", "error").groupBy("request")
    return rows.transformWithStateInPandas(Sounds(chunk, context, idle, decode), SOUNDS, "Append", "ProcessingTime" if idle else "None")
