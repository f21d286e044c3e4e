"""Documents packed into windows of bounded length by best-fit decreasing.

1. Documents become token ids once. A document longer than a window is cut into full windows and a rest; every
   piece is stored with its ids and its number among the pieces of its length in its task.
2. Best-fit decreasing sees lengths alone, so it runs on how many pieces each length has: one row per length,
   however many documents there are. A segment tree over remaining capacities finds the tightest open windows;
   windows of equal history are kept as one range of numbers, and a step places a range of pieces in them.
3. What is left are windows at the end that no piece was short enough to fill. Those with a gap of `slack`
   tokens or more are settled: the emptiest are dissolved, and their tokens, in a row, fill the gaps of the
   others; what remains of one window is cut into powers of two, which need no padding.
4. A piece finds its step by its length and its number among all pieces of that length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.encoding import LETTERS, NUMBERS, WHITE, WordIds
from tessitura.llm.wordhash import slices
from tessitura.session import shared_folder

END_ID = 2
WINDOW = 4096
SLACK = 64
#: The words of lower-case text below U+0100: letters, contractions, one number, the rest.
WORDS = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{WHITE}{LETTERS}{NUMBERS}]+")
SPACES = re.compile("[ \t\n\r\x0b\x0c]+")
RANK_BITS = 44


def word_level_path() -> str:
    """The vocabulary with word ends of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(WordIds):
    """Ids under a vocabulary that drops case and white space."""

    def __init__(self, path: str, end_id: int, **limits: int) -> None:
        super().__init__(path, end_id, WORDS, lower=True, **limits)

    def encode(self, text: str) -> bytes:
        """The ids of a text, the end id included."""
        if self.latin(text):
            return self.ids_of(text) + self.end
        # No word crosses white space.
        return b"".join([self.ids_of(p) if self.latin(p) else self.whole(p) for p in SPACES.split(text)]) + self.end


@lru_cache(1)
def _encoder(path: str, end_id: int) -> Encoder:
    """One per worker process, so that later tasks find the pieces of earlier ones."""
    return Encoder(path, end_id)


def _crc(ids: bytes, kind: str) -> int:
    return zlib.crc32(ids if kind == "<u4" else np.frombuffer(ids, kind).astype("<u4").tobytes())


PIECES = "task int, rank long, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, ids binary"
_KINDS = dict(zip(re.findall(r"(\w+) \w+", PIECES), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())))


def encode_pieces(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of all documents with their ids, stored in `folder`.

    NULL reads as empty: such a document has its end id alone. Rows that share an id, or have none, are
    documents of their own. Other columns are ignored.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = _encoder(path, end_id), TaskContext.get().partitionId(), {}
        wide = int(encoder.kind[-1])
        for batch in batches:
            names = batch.column("doc_id")
            for part in slices(batch.column("text")):
                texts = batch.column("text").slice(part.first, len(part.bounds) - 1).to_pylist()
                rows: dict[str, list] = {name: [] for name in _KINDS}
                for k, value in enumerate(texts):
                    ids = encoder.encode(value or "")
                    total, name = len(ids) // wide, names[part.first + k].as_py()
                    for start in range(0, total, window):
                        piece = ids[start * wide : (start + window) * wide]
                        length = len(piece) // wide
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        for column, x in zip(rows.values(), (task, rank, name, start, length, total, _crc(piece, encoder.kind), piece)):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in _KINDS.items()], names=list(_KINDS))

    plain.mapInArrow(run, PIECES).write.mode("overwrite").parquet(f"{folder}/pieces")
    return docs.sparkSession.read.schema(PIECES).parquet(f"{folder}/pieces")


class Open:
    """Ranges of open windows by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = np.zeros(2 * self.size, bool)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, capacity: int) -> None:
        node = capacity + self.size
        self.any[node] = bool(self.ranges.get(capacity))
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def push(self, capacity: int, first: int, count: int) -> None:
        if count:
            self.ranges.setdefault(capacity, []).append((first, count))
            self._mark(capacity)

    def pop(self, capacity: int) -> tuple[int, int]:
        found = self.ranges[capacity].pop()
        self._mark(capacity)
        return found

    def tightest(self, length: int) -> int | None:
        """The least capacity of `length` or more that some open window has."""
        node = length + self.size
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


class Plan(NamedTuple):
    steps: np.ndarray  # rows of length, first rank, count, first window, offset
    gone: np.ndarray  # dissolved ranges: first window, count, tokens of each, place of the first in their row of tokens
    cells: np.ndarray  # where those go: place, windows, tokens of each, first window, offset


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[list[tuple], Open, int]:
    """Steps that place counts[length] pieces of every length, the open windows, and how many there are."""
    steps, open_, windows = [], Open(window), 0

    def place(length: int, rank: int, slots: int, first: int, count: int, used: int) -> int:
        for slot in range(slots):
            steps.append((length, rank, count, first, used + slot * length))
            rank += count
        return rank

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = open_.tightest(length)
            if capacity is None:
                capacity, first, count = window, windows, -(-left // (window // length))
                windows += count
            else:
                first, count = open_.pop(capacity)
            # A window that takes one piece is then the tightest, until it is too full for another.
            slots = capacity // length
            full = min(count, left // slots)
            used = window - capacity
            rank = place(length, rank, slots, first, full, used)
            left -= full * slots
            open_.push(capacity - slots * length, first, full)
            first, count = first + full, count - full
            if count and left:
                rank = place(length, rank, left, first, 1, used)
                open_.push(capacity - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            open_.push(capacity, first, count)
    return steps, open_, windows


def _settle(open_: Open, windows: int, window: int, slack: int) -> tuple[list[tuple], list[tuple]]:
    """Which windows are dissolved, and the cells that take their tokens."""
    loose = [(window - gap, first, count) for gap, ranges in open_.ranges.items() for first, count in ranges
             if gap >= slack and (window - gap) & (window - gap - 1)]
    gaps = sum(count * (window - used) for used, _, count in loose)
    tokens, gone, cells = 0, [], []
    for used, first, count in sorted(loose):
        # One more dissolved window adds its tokens and takes its own gap away.
        some = min(count, max(0, -(-(gaps - tokens) // window)))
        if some:
            gone.append((first, some, used, tokens))
        tokens, gaps = tokens + some * used, gaps - some * (window - used)
        if some < count:
            cells.append((first + some, count - some, window - used, used))
    placed, at = [], 0
    for first, count, gap, used in cells:
        placed.append((at, count, gap, first, used))
        at += count * gap
    for bit in reversed(range(window.bit_length())):
        if (tokens - at) >> bit:
            placed.append((at, 1, 1 << bit, windows, 0))
            at, windows = at + (1 << bit), windows + 1
    return gone, placed


def plan(counts: dict[int, int], window: int = WINDOW, slack: int = SLACK) -> Plan:
    """Where the pieces of every length go, by best-fit decreasing and settling."""
    steps, open_, windows = best_fit_decreasing(counts, window)
    gone, cells = _settle(open_, windows, window, slack)
    table = lambda rows, width: np.array(sorted(rows), np.int64).reshape(-1, width)
    return Plan(table(steps, 5), table(gone, 4), table(cells, 5))


def _parts(plan: Plan, window: int, offset: int, length: int) -> list[tuple[int, int, int, int]]:
    """A piece as (from, length, window, offset): whole, or cut over the cells its dissolved window goes to."""
    k = int(np.searchsorted(plan.gone[:, 0], window, "right")) - 1
    if k < 0 or window >= plan.gone[k, 0] + plan.gone[k, 1]:
        return [(0, length, window, offset)]
    first, _, used, base = (int(x) for x in plan.gone[k])
    at, out, done = base + (window - first) * used + offset, [], 0
    while done < length:
        cell = int(np.searchsorted(plan.cells[:, 0], at, "right")) - 1
        place, _, size, target, into = (int(x) for x in plan.cells[cell])
        number, inside = divmod(at - place, size)
        take = min(length - done, size - inside)
        out.append((done, take, target + number, into + inside))
        at, done = at + take, done + take
    return out


PLACED = "task int, size int, rank long, skip int, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PLACED = dict(zip(re.findall(r"(\w+) \w+", PLACED), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4)))


def place_pieces(pieces: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """Each piece, or the parts it is cut into, with its sequence and offset.

    `task, size, rank` name the stored piece and `skip` the tokens before the part; ids_crc32 is NULL for
    parts of a piece that was cut here.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("task", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    # At most a row per length: `window` rows.
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Its size depends on the lengths there are, not on how many pieces have them.
    made = spark.sparkContext.broadcast(plan(counts, window, slack))
    meta = pieces.select("task", "rank", "doc_id", "start", "length", "ids_crc32", "doc_tokens").join(before, ["task", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = made.value
        keys = (table.steps[:, 0] << RANK_BITS) + table.steps[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            ranks = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            step = table.steps[np.searchsorted(keys, (length << RANK_BITS) + ranks, "right") - 1].reshape(-1, 5)
            sequence, offset = step[:, 3] + ranks - step[:, 1], step[:, 4]
            rows = dict(zip(_PLACED, (batch.column("task"), batch.column("length"), batch.column("rank"), pa.array(np.zeros(len(length), np.int32)),
                                      batch.column("doc_id"), batch.column("start"), batch.column("length"), batch.column("ids_crc32"),
                                      batch.column("doc_tokens"), pa.array(sequence), pa.array(offset))))
            whole = pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))
            k = np.searchsorted(table.gone[:, 0], sequence, "right") - 1
            moved = np.zeros(len(length), bool)
            if len(table.gone):
                moved = (k >= 0) & (sequence < table.gone[k, 0] + table.gone[k, 1])
            yield whole.filter(pa.array(~moved))
            cut: dict[str, list] = {name: [] for name in _PLACED}
            for row in whole.filter(pa.array(moved)).to_pylist():
                parts = _parts(table, row["sequence_id"], row["offset"], row["size"])
                for skip, take, target, into in parts:
                    crc = row["ids_crc32"] if len(parts) == 1 else None
                    new = row | {"skip": skip, "start": row["start"] + skip, "length": take, "ids_crc32": crc, "sequence_id": target, "offset": into}
                    for name, column in cut.items():
                        column.append(new[name])
            yield pa.RecordBatch.from_arrays([pa.array(cut[n], t) for n, t in _PLACED.items()], names=list(_PLACED))

    return meta.mapInArrow(run, PLACED)


def _with_ids(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    stored = pieces.select("task", F.col("length").alias("size"), "rank", "ids")
    wide = F.length("ids") / F.col("size")
    cut = F.substring("ids", (F.col("skip") * wide + 1).cast("int"), (F.col("length") * wide).cast("int"))
    return placed.join(stored, ["task", "size", "rank"]).withColumn("ids", cut)


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, window: int = WINDOW, slack: int = SLACK,
         text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every document,
    and the piece's ids (little-endian, of two bytes, or four if the vocabulary needs them) on request.

    Every id of a document lies in exactly one piece; the pieces of a sequence fill it from 0 without gaps.
    A sequence that is neither full nor of a power of two is less than `slack` ids short of full. Empty and NULL
    texts have their end id alone; rows that share an id, or have none, are documents of their own; an empty table
    gives an empty result. Other columns are ignored. `folder` holds the stored pieces (a fresh one unless given).
    """
    if not 0 < slack <= window:
        raise ValueError("slack must lie in 1..window")
    folder = folder or shared_folder(docs.sparkSession, "packing")
    pieces = encode_pieces(docs, folder, path or word_level_path(), end_id, window, text, doc_id)
    placed = place_pieces(pieces, window, slack)
    shown = [F.col(c).cast("long").alias(c) for c in COLUMNS]
    if ids:
        full = _with_ids(placed, pieces)
        return full.select(*(c if n != "ids_crc32" else F.coalesce(F.col(n), _crc_of("ids", "length")).alias(n) for n, c in zip(COLUMNS, shown)), "ids")
    whole = placed.where("ids_crc32 IS NOT NULL").select(*shown)
    cut = _with_ids(placed.where("ids_crc32 IS NULL"), pieces).withColumn("ids_crc32", _crc_of("ids", "length"))
    return whole.union(cut.select(*shown))


def _crc_of(ids: str, length: str):
    """crc32 of ids as 32-bit values: two-byte ones are widened by two zero bytes each."""
    hexed = F.hex(ids)
    wide = F.when(F.length(ids) == 2 * F.col(length), F.regexp_replace(hexed, "(.{4})", "$10000")).otherwise(hexed)
    return F.crc32(F.unhex(wide))


def windows(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every window of `pack(..., ids=True)`; a window has `window` pieces at most."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return rows.select("sequence_id", "length", joined.alias("ids"))
