"""Best-fit-decreasing packing into bins of several permitted lengths, solved on the histogram of lengths.

Documents (in pieces of at most the largest length) are packed longest first; each piece goes to the fullest open bin
it fits. If none fits, a bin is opened: of the permitted lengths, the one with the least cost per token when filled
best-fit from the pieces still to come. In the end each bin shrinks to the smallest permitted length that holds its
contents. Pieces of one length are interchangeable, so the whole of this runs on counts: per length, bins with
the same room are one class, and the plan is the same, piece for piece, as packing one at a time.

Scale: the driver sees one row per distinct length (the largest permitted length bounds that, whatever the input) and
makes a plan of about as many classes. Pieces get their rank within their length from counts per (length, shard) and a
row number inside the shard; a shard holds about ``shard_pieces`` pieces, so a length that a third of all pieces
share is ranked by as many tasks as it needs. The plan is looked up by rank in the executors. No bin is ever gathered.

Defined results: null or wordless text has no tokens and gives one row with piece 0, no bin and 0 tokens. A null id is
packed like any other. Rows that repeat an id are packed each. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import cut, text_of
from tidewave.llm.mixing import word_tokens

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16  # what a sequence costs beside its length
SHARD = 250_000


def _fill(room: int, left: list[int], counts: dict[int, int]) -> int:
    """Tokens that best-fit puts into ``room`` from the lengths in ``left`` (ascending, with counts)."""
    used, top = 0, len(left)
    while top := bisect_right(left, room, 0, top):
        size = left[top - 1]
        n = min(counts[size], room // size)
        used += n * size
        room -= n * size
        top -= 1
    return used


def _open(size: int, todo: int, left: list[int], counts: dict[int, int], lengths: tuple[int, ...], overhead: float) -> int:
    """The permitted length to open for a piece of ``size``, of which ``todo`` are to come; ``left``: the shorter lengths still to come."""
    best = None
    for cap in lengths:
        if cap >= size:
            own = min(todo, cap // size) * size
            used = own + _fill(cap - own, left, counts)
            shrunk = next(c for c in lengths if c >= used)
            price = ((shrunk + overhead) / used, cap)
            best = min(best or price, price)
    return best[1]


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Runs (length, first rank, class, first bin of the class's bins, pieces a bin) and classes (first bin, bins, tokens used).

    A run says: pieces of that length from that rank on go, so many to a bin, to the bins counted from that bin on.
    A class is a run of consecutive bins with the same contents.
    """
    lengths = tuple(sorted(lengths))
    counts = {int(k): int(v) for k, v in histogram.items() if k > 0 and v > 0}
    left = sorted(counts)
    rooms: list[int] = []  # rooms of open classes, ascending
    bins: dict[int, list[tuple[int, int]]] = {}  # room: runs of bins (first, number), in the order they got that room
    runs, used, n_bins = [], [], 0
    while left:
        size = left.pop()
        todo, rank = counts[size], 0
        while todo:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, number = bins[room].pop(0)
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room = _open(size, todo, left, counts, lengths, overhead)
                # the next bins are opened alike as long as the pieces of this length still to come could fill any bin
                first, number = n_bins, max(0, todo - lengths[-1] // size) // (room // size) + 1
                n_bins += number
                used.append((first, number, room))
            each = room // size
            whole = min(number, todo // each)
            parts = [(first, whole, each)] if whole else []
            if whole < number:
                rest = todo - whole * each
                if rest:
                    parts.append((first + whole, 1, rest))
                more = number - whole - (rest > 0)
                if more:  # bins that got nothing keep their room
                    if room not in bins:
                        insort(rooms, room)
                    bins.setdefault(room, []).insert(0, (first + whole + (rest > 0), more))
            for b, n, k in parts:
                runs.append((size, rank, b, n, k))
                rank += n * k
                todo -= n * k
                if room > k * size:
                    if room - k * size not in bins:
                        insort(rooms, room - k * size)
                    bins.setdefault(room - k * size, []).append((b, n))
    return runs, used


def _contents(runs: list, n_bins: int) -> tuple[np.ndarray, list]:
    """Edges of the stretches of bins with equal contents, and tokens used in each: from runs, by a sweep."""
    marks: dict[int, int] = {}
    for size, _, b, n, k in runs:
        marks[b] = marks.get(b, 0) + size * k
        marks[b + n] = marks.get(b + n, 0) - size * k
    edges = np.array(sorted(marks), np.int64)
    return edges, np.cumsum([marks[e] for e in edges.tolist()]) if len(edges) else np.empty(0, np.int64)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, shard_pieces: int = SHARD) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin_id, bin_offset, bin_used, bin_length."""
    spark, top = docs.sparkSession, max(lengths)
    n = tokens if tokens is not None else word_tokens(text_col)
    pieces = docs.select(F.col(id_col).alias("id"), n.alias("n"), F.xxhash64(F.col(id_col), text_of(text_col)).alias("h")).select(
        "id", "n", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top)))).alias("piece")
    )
    pieces = cut(pieces.select("id", "piece", "h", (F.col("piece") * top).alias("start"), F.greatest(F.lit(0), F.least(F.lit(top), F.col("n") - F.col("piece") * top)).cast("long").alias("n")))
    histogram = {r.n: r.c for r in pieces.groupBy("n").agg(F.count("*").alias("c")).collect()}  # max(lengths) + 1 rows at most
    runs, used = plan(histogram, lengths, overhead)
    edges, filled = _contents(runs, 0)

    # Rank within the length: (pieces of earlier shards) + (row number in the shard).
    shards = spark.createDataFrame([(int(k), max(1, -(-int(c) // shard_pieces))) for k, c in histogram.items()], "n long, shards long")
    in_file = pieces.withColumn("rid", F.monotonically_increasing_id())  # from files, so the same at every read
    dealt = in_file.join(F.broadcast(shards), "n").withColumn("shard", F.pmod(F.xxhash64("rid", "h"), "shards"))
    sizes = dealt.groupBy("n", "shard").agg(F.count("*").alias("c"))
    base = sizes.select("n", "shard", (F.sum("c").over(Window.partitionBy("n").orderBy("shard")) - F.col("c")).alias("base"))
    row = F.row_number().over(Window.partitionBy("n", "shard").orderBy("h", "id", "piece", "rid")) - 1
    ranked = dealt.withColumn("row", row).join(base, ["n", "shard"]).select("id", "piece", "start", "n", (F.col("base") + F.col("row")).alias("rank"))

    by_size: dict[int, list] = {}
    for size, rank, b, count, k in runs:
        by_size.setdefault(size, []).append((rank, b, k))
    tables = {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in by_size.items()}
    caps = np.array(sorted(lengths), np.int64)
    # Where each run's pieces begin in their bins: what was there before, longest first.
    starts, fill = {}, _Fill()
    for size, rank, b, count, k in runs:
        starts.setdefault(size, []).append(fill.add(b, count, size * k))
    offsets = {s: np.array(x, np.int64) for s, x in starts.items()}
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            bins, offset = np.full(n.size, -1, np.int64), np.zeros(n.size, np.int64)
            for size in np.unique(n):
                if int(size) not in tables:
                    continue
                first, b, k = tables[int(size)]
                mine = np.flatnonzero(n == size)
                run = np.searchsorted(first, rank[mine], "right") - 1
                inside = rank[mine] - first[run]
                bins[mine] = b[run] + inside // k[run]
                offset[mine] = offsets[int(size)][run] + inside % k[run] * size
            total = filled[np.maximum(np.searchsorted(edges, bins, "right") - 1, 0)] if len(edges) else np.zeros(n.size, np.int64)
            cap = caps[np.minimum(np.searchsorted(caps, total), len(caps) - 1)]
            out = [pa.array(x, pa.int64(), mask=bins < 0) for x in (bins, offset, total, cap)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *out], names=[id_col, "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_used", "bin_length"])

    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_used long, bin_length long")


class _Fill:
    """Tokens in each bin so far, kept for runs of bins; a run that is added covers bins that are equally full."""

    def __init__(self) -> None:
        self.edges: list[int] = []
        self.at: dict[int, int] = {}

    def _split(self, b: int) -> None:
        i = bisect_left(self.edges, b)
        if i == len(self.edges) or self.edges[i] != b:
            self.at[b] = self.at[self.edges[i - 1]] if i else 0
            self.edges.insert(i, b)

    def add(self, b: int, n: int, tokens: int) -> int:
        self._split(b)
        self._split(b + n)
        before = self.at[b]
        i = bisect_left(self.edges, b)
        while self.edges[i] < b + n:
            self.at[self.edges[i]] += tokens
            i += 1
        return before
