"""Repeated byte strings across documents: sparse suffix arrays in a logarithmic family per key range.

A suffix is indexed where a string of `length` bytes has its least k-gram (window minimum, leftmost),
so equal strings are indexed at the same place. The consecutive windows that share one such place
form a fragment; fragments are the suffixes' leading text, in the order of (k-gram hash, fragment
hash), which is all that matches of `length` bytes or more need.

1. Every chunk of documents is a batch with its own sorted suffix array; only its first of equal
   fragments leaves it, packed and routed by k-gram.
2. A range task takes batches into a family of sorted levels. A level merges with the next as soon as
   they are of equal size class, keeping the earliest document of each fragment. Each batch is then
   scanned against the merged order: a fragment with an earlier document repeats as a whole, and a
   k-gram with several fragments may hide repeats that begin or end within them.
3. The windows of just those fragments go through the same family, each keyed by its own text.
4. Each chunk turns what repeats into spans of bytes.

A key's rows are at most one per chunk however often it occurs. Keys are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.wordhash import BASE, POWERS, byte_values, mix

SEGMENT = 1 << 20
PLACE = np.uint64(31)
BACK = np.uint64(pow(int(BASE), -1, 2**64))
REPEATS, MIXED = 1, 2
NO_ID = np.iinfo(np.int64).min


class _Inverse:
    def __init__(self) -> None:
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            grown = np.full(max(n, 2 * len(self.table)), BACK)
            grown[0] = 1
            self.table = np.cumprod(grown)
        return self.table[:n]


INVERSE = _Inverse()


class Chunk:
    """The documents of a chunk in id order, as one run of bytes."""

    def __init__(self, table: pa.Table, length: int, gram: int) -> None:
        ids = table.column("doc_id").to_pylist()
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (NO_ID if ids[k] is None else ids[k], texts[k]))
        self.ids = [ids[k] for k in order]
        self.keys = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.texts = [texts[k] for k in order]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in self.texts], dtype=np.int64)))
        self.length, self.gram = length, gram
        self.valid = np.ones(len(self.data), bool)
        for start, end in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            self.valid[max(start, end - length + 1) : end] = False

    def _segments(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Window starts first..last, with prefix sums and inverse powers over their bytes."""
        n = len(self.data) - self.length + 1
        for first in range(0, max(0, n), SEGMENT):
            last = min(first + SEGMENT, n)
            letters = byte_values()[self.data[first : last + self.length - 1]]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * POWERS.upto(len(letters)))))
            yield first, last, sums, INVERSE.upto(len(letters) + 1)

    def fragments(self) -> tuple[np.ndarray, ...]:
        """First and last window start, k-gram key and fragment key of every fragment, in order."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        wide = self.length - self.gram + 1
        for first, last, sums, back in self._segments():
            at = np.flatnonzero(self.valid[first:last])
            if not len(at):
                continue
            grams = mix((sums[self.gram :] - sums[: -self.gram]) * back[: len(sums) - self.gram])
            least = (grams >> PLACE << PLACE) | np.arange(len(grams), dtype=np.uint64)
            reach = 1
            while reach * 2 <= wide:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            if reach < wide:
                least = np.minimum(least[: reach - wide], least[wide - reach :])
            place = (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)[at]
            opens = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(place) != 0))))
            low, high = at[opens], at[np.append(opens[1:], len(at)) - 1]
            place = place[opens]
            size = high - low + self.length
            whole = mix((sums[low + size] - sums[low]) * back[low])
            whole = mix(whole + size.astype(np.uint64) * BASE + (place - low).astype(np.uint64))
            found.append((low + first, high + first, grams[place], whole))
        return tuple(np.concatenate(x) for x in zip(*found))

    def window_keys(self, starts: np.ndarray) -> np.ndarray:
        """The key of the window at each start, ascending."""
        out = [np.zeros(0, np.uint64)]
        for first, last, sums, back in self._segments():
            at = starts[np.searchsorted(starts, first) : np.searchsorted(starts, last)] - first
            out.append(mix((sums[at + self.length] - sums[at]) * back[at]))
        return np.concatenate(out)

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The id of the document at each place."""
        return self.keys[np.searchsorted(self.bounds, places, "right") - 1]


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of equal keys, and for each entry its key's number among them."""
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return first, number


def _routed(outer: np.ndarray, inner: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a chunk's suffix array within routes, and the route of each entry in that order."""
    route = outer % np.uint64(ranges)
    order = np.lexsort((inner, outer, route))
    return order, route[order].astype(np.int64)


def _blocks(kind: int, chunk: int, order, route, outer, inner, owner) -> dict[str, list]:
    rows: dict[str, list] = {"route": [], "kind": [], "chunk": [], "data": []}
    cuts = np.flatnonzero(np.diff(route)) + 1
    for part in np.split(np.arange(len(order)), cuts) if len(order) else ():
        mine = order[part]
        rows["route"].append(int(route[part[0]]))
        rows["kind"].append(kind)
        rows["chunk"].append(chunk)
        rows["data"].append(outer[mine].tobytes() + inner[mine].tobytes() + owner[mine].tobytes())
    return rows


BLOCK = pa.schema([("route", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])


class Family:
    """Sorted levels of (outer key, inner key, earliest owner); equal size classes merge."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _merged(a, b):
        outer, inner, owner = (np.concatenate(x) for x in zip(a, b))
        order = np.lexsort((owner, inner, outer))
        outer, inner, owner = outer[order], inner[order], owner[order]
        first = np.concatenate(([True], (outer[1:] != outer[:-1]) | (inner[1:] != inner[:-1])))
        return outer[first], inner[first], owner[first]

    def add(self, batch: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1][0]).bit_length() >= len(self.levels[-2][0]).bit_length():
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        while len(self.levels) > 1:
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))
        return self.levels[0]


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 24
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint64, n, 8 * n), np.frombuffer(data, np.int64, n, 16 * n)


def _scan(table: pa.Table) -> pa.Table:
    """A range task: all batches into the family, then each against it; one flag byte per entry."""
    batches = [_unpacked(d) for d in table.column("data").to_pylist()]
    family = Family()
    for batch in batches:
        family.add(batch)
    outer, inner, owner = family.closed()
    several = np.concatenate(([False], outer[1:] == outer[:-1]))
    several[:-1] |= several[1:]
    # One number per (outer, inner) pair, so that a batch finds its entries by one binary search.
    pair = mix(outer * BASE + inner)
    by_pair = np.argsort(pair)
    sorted_pair = pair[by_pair]
    flags = []
    for a, b, mine in batches:
        at = by_pair[np.searchsorted(sorted_pair, mix(a * BASE + b))]
        flags.append(((owner[at] < mine) * REPEATS + several[at] * MIXED).astype(np.uint8).tobytes())
    return pa.Table.from_arrays(
        [table.column("chunk"), table.column("kind"), table.column("route"), pa.array(flags, pa.binary())], names=["chunk", "kind", "route", "flags"])


def _flags(replies: pa.Table, kind: int, route: np.ndarray) -> np.ndarray:
    """The replies of one kind in the order the chunk's entries were packed."""
    out = np.zeros(len(route), np.uint8)
    for k, r, data in zip(*(replies.column(c).to_pylist() for c in ("kind", "route", "flags"))):
        if k == kind:
            at = np.searchsorted(route, r)
            out[at : at + len(data)] = np.frombuffer(data, np.uint8)
    return out


class _Dedup:
    def __init__(self, ranges: int, length: int, gram: int) -> None:
        self.ranges, self.length, self.gram = ranges, length, gram

    def first_blocks(self, table: pa.Table) -> pa.Table:
        chunk = Chunk(table, self.length, self.gram)
        low, _, outer, inner = chunk.fragments()
        first, _ = _firsts(inner)
        outer, inner, owner = outer[first], inner[first], chunk.owner(low[first])
        order, route = _routed(outer, inner, self.ranges)
        return pa.table(_blocks(0, table.column("chunk")[0].as_py(), order, route, outer, inner, owner), schema=BLOCK)

    def _repeating(self, chunk: Chunk, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fragments that repeat as a whole (low, high), and the starts of windows to look at one by one."""
        low, high, outer, inner = chunk.fragments()
        first, number = _firsts(inner)
        order, route = _routed(outer[first], inner[first], self.ranges)
        state = np.zeros(len(first), np.uint8)
        state[order] = _flags(replies, 0, route)
        whole = (state & REPEATS > 0)[number]
        later = np.ones(len(low), bool)
        later[first] = False
        whole |= later
        single = ~whole & (state & MIXED > 0)[number]
        size = (high - low + 1)[single]
        starts = np.repeat(low[single] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return low[whole], high[whole], starts

    def window_blocks(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return BLOCK.empty_table()
        chunk = Chunk(table, self.length, self.gram)
        _, _, starts = self._repeating(chunk, replies)
        keys = chunk.window_keys(starts)
        first, _ = _firsts(keys)
        keys, owner = keys[first], chunk.owner(starts[first])
        order, route = _routed(keys, keys, self.ranges)
        return pa.table(_blocks(1, table.column("chunk")[0].as_py(), order, route, keys, keys, owner), schema=BLOCK)

    def spans(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, sizes, spans, kept = [], [], [], []
        if table.num_rows:
            chunk = Chunk(table, self.length, self.gram)
            low, high, starts = self._repeating(chunk, replies)
            keys = chunk.window_keys(starts)
            first, number = _firsts(keys)
            order, route = _routed(keys[first], keys[first], self.ranges)
            state = np.zeros(len(first), np.uint8)
            state[order] = _flags(replies, 1, route)
            repeats = (state & REPEATS > 0)[number]
            later = np.ones(len(starts), bool)
            later[first] = False
            starts = starts[repeats | later]
            change = np.zeros(len(chunk.data) + 1, np.int32)
            np.add.at(change, low, 1)
            np.add.at(change, high + self.length, -1)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + self.length, -1)
            gone = np.cumsum(change[:-1]) > 0
            for k, text in enumerate(chunk.texts):
                start, end = chunk.bounds[k], chunk.bounds[k + 1]
                mine = gone[start:end]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0])))).reshape(-1, 2)
                ids.append(chunk.ids[k])
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in edge.tolist()])
                kept.append(chunk.data[start:end][~mine].tobytes())
        return pa.Table.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"])

    def digests(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        out = self.spans(table, replies)
        digest = [hashlib.sha256(b).hexdigest() for b in out.column("kept").to_pylist()]
        return out.set_column(3, "kept_sha256", pa.array(digest, pa.string()))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def repeated_spans(
    docs: DataFrame, length: int = 100, gram: int = 48, text: str = "text", doc_id: str = "doc_id",
    chunk_bytes: int = 4 << 20, digest: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, spans (bytes from 0, end exclusive) and kept (the other bytes) of every document.

    A byte is in a span if a string of `length` bytes that covers it also starts earlier: in a row of a
    smaller id, or earlier in the same text. Strings are judged on the input and lie within one document.
    With `digest`, the kept bytes come as their SHA-256 in `kept_sha256`. NULL and empty texts have no
    spans; rows that share an id count in the order of their texts, so a repeated row repeats all of
    its strings; rows without an id come before all others. Other columns are ignored.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, total // chunk_bytes)
    # A range task holds the entries of about four chunks, so that a chunk's entries travel in few, large blocks.
    work = _Dedup(max(1, chunks // 4), length, gram)
    chunked = plain.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    groups = lambda: chunked.groupBy("chunk")
    block = "route bigint, kind int, chunk bigint, data binary"
    reply = "chunk bigint, kind int, route bigint, flags binary"
    first = groups().applyInArrow(lambda t: work.first_blocks(t), block).groupBy("route").applyInArrow(_scan, reply)
    windows = groups().cogroup(first.groupBy("chunk")).applyInArrow(lambda t, r: work.window_blocks(t, r), block)
    second = windows.groupBy("route").applyInArrow(_scan, reply)
    out = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>"
    return groups().cogroup(first.union(second).groupBy("chunk")).applyInArrow(
        (lambda t, r: work.digests(t, r)) if digest else (lambda t, r: work.spans(t, r)), f"{out}, kept_sha256 string" if digest else f"{out}, kept binary")
