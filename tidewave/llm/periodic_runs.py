"""Periodic runs of words: Lyndon arrays by Baier's grouping, Lyndon roots extended into runs.

A run is a stretch that has a smallest period, holds it at least twice and can't be made longer. Of the two orders of an
alphabet, one and its reverse, one at least has a Lyndon word of the run's period inside the run that is the longest Lyndon
word at its place (Bannai et al., "The runs theorem", 2017). So for each order the longest Lyndon word at every place is
found (the first phase of Baier's suffix sorter, 2016: ``lyndon_lengths``), and each is extended to both sides by longest
common extensions (names of all stretches of 2^k words, so equal names mean equal words); what spans two periods is a run.

A run of 12 words or more matches itself, one period on, over six words or more. So words that lie in no six-word window which
occurs twice in their document are in no run: each stretch of them is replaced by one letter of its own, which can't be in
a run either, and the documents of a slice of a batch become one short string. That is exact; the windows are found by
a 64-bit hash, where a clash only makes the string longer.

Scale: a document is worked on where it is read, without a shuffle. Texts go through in slices of ``SLICE`` bytes or one
document, all steps are linear in a slice but for sorting, and the tables of names take log2(longest stretch) numbers a word.

Defined results: a null, empty or wordless text has no runs and collapses to the empty string. Every row comes back once,
with its id whatever it is (null, repeated). Other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import text_of

#: A run has at least so many words, and matches itself over at least half of them.
LEAST = 12
WINDOW = LEAST // 2
SLICE = 4 << 20


def lyndon_lengths(letters: np.ndarray, n_letters: int) -> np.ndarray:
    """The length of the longest Lyndon word at each place of a string of numbers below ``n_letters``.

    Places are grouped by what is known of their Lyndon word, at first its letter. Groups are taken from the highest
    down. The words of the group in hand are complete; the nearest lower place before each (or before a row of them that
    follow each other) is that much longer, so it moves up out of its group: above those that have fewer of them.
    """
    n = letters.size
    group = letters.tolist()
    members: list[list[int]] = [[] for _ in range(n_letters)]
    for i, g in enumerate(group):
        members[g].append(i)
    live = [len(m) for m in members]
    lower, upper = list(range(-1, n_letters - 1)), [*range(1, n_letters), -1]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # among the places not yet complete
    out = [0] * n
    top = n_letters - 1
    while top >= 0:
        moves: dict[tuple[int, int], list[int]] = {}
        head, times, last = -1, 0, -1
        for i in members[top]:
            if group[i] != top:
                continue
            if times and before[i] == last:
                times += 1
            else:
                if times and head >= 0:
                    moves.setdefault((group[head], times), []).append(head)
                head, times = before[i], 1
            last, end = i, after[i]
            out[i] = end - i
            if end == n or group[end] != top:  # the row of equal words ends: it leaves the string
                if head >= 0:
                    after[head] = end
                if end < n:
                    before[end] = head
        if times and head >= 0:
            moves.setdefault((group[head], times), []).append(head)
        below, place = -1, -1
        for old, k in sorted(moves):
            moved = moves[old, k]
            if old != below:
                below = place = old
            if len(moved) == live[old]:  # the whole group, or what is left of it: those that moved before it go below
                if place == old:
                    continue
            new = len(members)
            members.append(moved)
            live.append(len(moved))
            live[old] -= len(moved)
            for j in moved:
                group[j] = new
            above = upper[place]
            lower.append(place)
            upper.append(above)
            upper[place] = new
            if above >= 0:
                lower[above] = new
            place = new
        top = lower[top]
    return np.array(out, np.int64)


def stretch_names(letters: np.ndarray, longest: int) -> list[np.ndarray]:
    """``[k][i]`` is a number for the 2^k letters from i on, equal for equal ones."""
    names, size = [letters.astype(np.int64)], 1
    while 2 * size <= min(longest, letters.size):
        low = names[-1]
        pairs = low[: low.size - size] * (int(low.max()) + 1) + low[size:]
        names.append(np.unique(pairs, return_inverse=True)[1].reshape(-1).astype(np.int64))
        size *= 2
    return names


def common_extension(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
    """How many letters agree from a and b (a < b) on, or before them."""
    reach = np.zeros(a.size, np.int64)
    for k in range(len(names) - 1, -1, -1):
        size = 1 << k
        x, y = (a - reach - size, b - reach - size) if left else (a + reach, b + reach)
        inside = x >= 0 if left else y < names[k].size
        same = np.zeros(a.size, bool)
        same[inside] = names[k][x[inside]] == names[k][y[inside]]
        reach += size * same
    return reach


def runs_of(letters: np.ndarray, longest: int | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of ``least`` letters or more, by start and period; no run is longer than ``longest``."""
    none = np.empty(0, np.int64)
    if letters.size < 2:
        return none, none, none
    kinds, ranks = np.unique(letters, return_inverse=True)
    ranks = ranks.reshape(-1)
    names = stretch_names(ranks, longest or letters.size)
    found = []
    for order in (ranks, kinds.size - 1 - ranks):
        period = lyndon_lengths(order, kinds.size)
        at = np.flatnonzero(np.arange(letters.size) + period < letters.size)
        period = period[at]
        start = at - common_extension(names, at, at + period, left=True)
        end = at + period + common_extension(names, at, at + period)
        whole = end - start >= np.maximum(least, 2 * period)
        found.append(np.stack([start, end - start, period], axis=1)[whole])
    both = np.unique(np.concatenate(found), axis=0)
    both = both[np.lexsort((both[:, 2], both[:, 0]))]
    return both[:, 0], both[:, 1], both[:, 2]


_ODD = np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 63, WINDOW + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _repeating(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a window of ``WINDOW`` words that occurs twice in their document (or, rarely, seems to)."""
    inside = np.zeros(codes.size + 1, np.int32)
    if codes.size < WINDOW:
        return inside[1:] > 0
    n, x = codes.size - WINDOW + 1, codes.astype(np.uint64)
    h = doc[:n].astype(np.uint64) * _ODD[WINDOW]
    for k in range(WINDOW):
        h = (h ^ (h >> np.uint64(29))) * _ODD[k] + x[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    h = h[whole := np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])]
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if twice.size:
        at = whole[twice[np.minimum(np.searchsorted(twice, h), twice.size - 1)] == h]
        inside[at] += 1
        inside[at + WINDOW] -= 1
    return np.cumsum(inside[:-1]) > 0


def document_runs(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and period of every run of ``LEAST`` words or more in any of the documents, in this order."""
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(x, len(known)) for w in words for x in w), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(_repeating(codes, doc))
    if not at.size:
        return (np.empty(0, np.int64),) * 4
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc[at]) > 0)])
    stretch = np.cumsum(new)  # from 1 on: a letter of its own stands before each
    place = np.arange(at.size) + stretch
    string = len(known) + np.arange(at.size + int(stretch[-1]), dtype=np.int64)
    string[place] = codes[at]
    origin = np.zeros(string.size, np.int64)
    origin[place] = at
    start, length, period = runs_of(string, int(np.bincount(stretch).max()))
    start = origin[start]
    of = doc[start]
    order = np.lexsort((period, start))
    return of[order], (start - first[of])[order], length[order], period[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of about ``SLICE`` bytes of text, or a row."""
    ends = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            words = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in part.column(1)]  # bytes split at ASCII white space only
            of, start, length, period = document_runs(words)
            ends = np.searchsorted(of, np.arange(part.num_rows + 1))
            texts = []
            for i, w in enumerate(words):
                if ends[i] < ends[i + 1]:
                    change = np.zeros(len(w) + 1, np.int64)
                    own = slice(ends[i], ends[i + 1])
                    np.add.at(change, start[own] + period[own], 1)
                    np.add.at(change, start[own] + length[own], -1)
                    w = [w[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                texts.append(b" ".join(w))
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(_RUN))
            cols = [part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), runs), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_words, runs (start, length, period; by start, then period), and collapsed:
    the words, joined by one space, without those that a run holds after its first period."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(_collapse, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
