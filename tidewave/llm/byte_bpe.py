"""Byte-level BPE as a monoid: texts are encoded in halves, and neighbours are joined by encoding a window at their border anew.

An encoding is a pair of lists: spans of the text, each some of the pieces that the pattern splits it into, and the ids of
each. Encodings of neighbouring texts have a product (``Encoder.join``), the encoding of the two texts as one, so a text may be
cut anywhere, also within a word, a letter or a run of one character, and put together up a tree.

Joining texts. The pattern is matched from left to right and never looks back, so a piece depends on the characters from
its start to a little past its end only (``PAST``). The left text's last spans, which such a look could reach past its end,
are matched anew together with spans of the right text, more and more of them, until a match ends where one of the right
text's spans begins: from there on all are as they were. Where a space stands before something that isn't white,
the pattern always begins a piece, and the product is the two lists put together; so a short text's spans are its words.

Joining byte strings of one piece. Tokens are the BPE of their bytes if and only if every two neighbours are the BPE of
theirs: the first merge across a border would happen in the same way among the two tokens alone. So the last tokens on
the left and the first on the right are merged anew, more and more of them, until the window's first and last tokens
stand as they are beside the ones outside it.

Scale: texts are encoded where they are read, without a shuffle; ids of pieces are kept in a table of at most
``CACHE`` short pieces a worker. The vocabulary is read on the driver from a file that the caller names and is
broadcast; its size is bounded (``MAX_TOKENS``). Decoding concatenates: the tree's product is then that of byte strings.

Defined results: null counts as empty and has no ids; ids that are null decode to no bytes, an id that the vocabulary lacks
is an error. Every row comes back once, with its id whatever it is (null, repeated). Other columns are ignored and may have any name.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import text_of

#: Fixed value: how texts are split into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The pattern looks at most so far past a piece's end to decide it: three characters from the start of an apostrophe, two past white space.
PAST = 3
#: Characters of a text, and bytes of a piece, that are encoded without halving.
CHUNK, LEAF = 1 << 14, 64
#: Bytes that are merged as they are.
SHORT = 6
#: Marks that often follow a word.
MARKS = frozenset(".,;:!?")
CACHE, CACHED_CHARS = 1 << 19, 64
MAX_TOKENS = 1 << 21

#: Spans of the text, each of whole pieces, and the ids of each as four bytes an id: joined without an object for every id.
Encoding = tuple[list[str], list[bytes]]


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines of base64 and number, read by Spark from wherever it is."""
    rows = spark.read.text(path).where("trim(value) <> ''").limit(MAX_TOKENS + 1).collect()
    if len(rows) > MAX_TOKENS:
        raise ValueError(f"more than {MAX_TOKENS} tokens in {path}")
    ranks = {base64.b64decode(token): int(rank) for token, rank in (r.value.split() for r in rows)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the single bytes {missing}")
    if max(ranks.values()) >= MAX_TOKENS:
        raise ValueError(f"ranks must be below {MAX_TOKENS}")
    return ranks


class Encoder:
    def __init__(self, ranks: dict[bytes, int], chunk: int = CHUNK, leaf: int = LEAF) -> None:
        self.ranks, self.chunk, self.leaf = ranks, max(1, chunk), max(1, leaf)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(PATTERN).findall
        self.loose, self.cut = regex.compile(r" (?!\S)").search, regex.compile(r" (?=\S)").split
        self.pieces, self.short = Known(self.piece), Known(self.merge)
        self.two = lru_cache(CACHE)(self._two)

    # ---- byte strings of one piece ----

    def merge(self, piece: bytes) -> list[int]:
        """Neighbours merge by the lowest rank, of equal ones the first, until none has a rank."""
        if len(piece) > self.leaf:
            return self._merge_long(piece)
        ranks, never = self.ranks, MAX_TOKENS
        rank_of = ranks.get
        at = list(range(len(piece) + 1))
        pairs = [rank_of(piece[i : i + 2], never) for i in at[:-2]]
        while pairs and (least := min(pairs)) < never:
            i = pairs.index(least)
            del pairs[i], at[i + 1]
            if i:
                pairs[i - 1] = rank_of(piece[at[i - 1] : at[i + 1]], never)
            if i < len(pairs):
                pairs[i] = rank_of(piece[at[i] : at[i + 2]], never)
        return [ranks[piece[i:j]] for i, j in zip(at, at[1:], strict=False)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs, for windows that had to grow."""
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a place; what begins before it
        alive = [True] * n
        heap = [(ranks[x], i, i + 2) for i in range(n - 1) if (x := piece[i : i + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two has merged otherwise
            alive[j], end[i] = False, stop
            before[stop] = i
            if stop < n and (rank := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
            if (k := before[i]) >= 0 and (rank := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (rank, k, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _two(self, a: int, b: int) -> list[int]:
        return self.merge(self.bytes_of[a] + self.bytes_of[b])

    def text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        two = self.two
        middle = two(left[-1], right[0])
        x = y = 1
        while True:
            first = x >= len(left) or two(left[-x - 1], middle[0])[0] == left[-x - 1]
            last = y >= len(right) or two(middle[-1], right[y])[-1] == right[y]
            if first and last:
                return left[:-x] + middle + right[y:]
            x, y = x if first else min(2 * x, len(left)), y if last else min(2 * y, len(right))
            middle = self.merge(self.text(left[-x:]) + self.text(right[:y]))

    def tokens(self, piece: bytes) -> list[int]:
        """Halves are looked up or halved again. A long piece's left half is the greatest power of two, so that the parts of a
        repeated character fit together at once."""
        n = len(piece)
        if n <= SHORT:
            return self.short[piece]
        half = n // 2 if n <= self.leaf else 1 << ((n - 1).bit_length() - 1)
        return self.join_tokens(self.tokens(piece[:half]), self.tokens(piece[half:]))

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return array("i", self.tokens(raw) if whole is None else (whole,)).tobytes()

    # ---- texts ----

    def join(self, left: Encoding, right: Encoding) -> Encoding:
        """The encoding of two neighbouring texts as one."""
        (a, a_ids), (b, b_ids) = left, right
        if not a or not b:
            return (a, a_ids) if a else (b, b_ids)
        kept, past = len(a), 0  # characters after the spans that are kept
        while kept and past < PAST:
            kept, past = kept - 1, past + len(a[kept - 1])
        tail, m = "".join(a[kept:]), 1
        while True:
            m = min(m, len(b))
            window = tail + "".join(b[:m])
            begins = {len(tail) + n: k for k, n in enumerate(accumulate(map(len, b[:m]), initial=0))}
            found, end = self.split(window), 0
            for k, x in enumerate(found, 1):
                end += len(x)
                if m < len(b) and end + PAST > len(window):
                    break
                if end in begins:
                    at = begins[end]
                    return a[:kept] + found[:k] + b[at:], a_ids[:kept] + [*map(self.pieces.__getitem__, found[:k])] + b_ids[at:]
            m *= 2

    def _cut(self, text: str) -> list[str]:
        """The text at its spaces before something that isn't white: no piece goes on over such a place. The spaces are left out."""
        return self.cut(text) if self.loose(text) else text.split(" ")

    def encode(self, text: str) -> Encoding:
        if len(text) > self.chunk:
            half = len(text) // 2
            return self.join(self.encode(text[:half]), self.encode(text[half:]))
        first, *others = self._cut(text)
        spans = [first] * bool(first) + [" " + x for x in others]
        return spans, [*map(self._span, spans)]

    def _span(self, span: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(span)))

    def ids(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if len(text) > self.chunk:
            return b"".join(self.encode(text)[1])
        first, *others = self._cut(text)
        pieces, span = self.pieces, self._span
        out = [span(first)]
        add = out.append
        for x in others:
            if x.isalpha():  # one piece, as it is known without the pattern
                add(pieces[" " + x])
            elif x[-1] in MARKS and x[:-1].isalpha():  # two
                add(pieces[" " + x[:-1]])
                add(pieces[x[-1]])
            else:
                add(span(" " + x))
        return b"".join(out)


class Known(dict):
    """Strings and their ids, looked up or found."""

    def __init__(self, find: Callable) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, x: str | bytes) -> bytes | list[int]:
        ids = self.find(x)
        if len(x) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[x] = ids
        return ids


#: So many texts at a time go back to the JVM, so that memory is bounded by few texts.
TOGETHER = 256


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: its id and ``ids``, the tokens of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, chunk, leaf)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                each = [encoder.ids(t) for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in each)]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(each), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``tokens`` with the further column ``decoded``: the bytes of its ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    if "decoded" in tokens.columns:
        raise ValueError("a column is named like the result, decoded: rename it")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(shared.value.values()) + 1
        table: list[bytes | None] = [None] * size
        for token, rank in shared.value.items():
            table[rank] = token
        vocabulary = pa.array(table, pa.large_binary())
        for whole in parts:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                lists = batch.column(batch.schema.get_field_index(ids_col))
                ids = lists.flatten()  # of lists that aren't null
                known = pc.fill_null(pc.and_(pc.less(ids, size), pc.greater_equal(ids, 0)), False)
                tokens = vocabulary.take(pc.if_else(known, ids, 0))
                if tokens.null_count or not pc.all(known, min_count=0).as_py():
                    odd = next(i for i in ids.to_pylist() if i is None or not 0 <= i < size or table[i] is None)
                    raise ValueError(f"id {odd} is not in the vocabulary")
                # the tokens' bytes already stand one after the other: a text's are those from its first token to its last
                ends = np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
                places = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1) if len(tokens) else np.zeros(1, np.int64)
                out = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(places[ends].tobytes()), tokens.buffers()[2]])
                yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary())], names=[*batch.schema.names, "decoded"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{names}, decoded binary")
