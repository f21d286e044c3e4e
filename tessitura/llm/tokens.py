"""Token ids in binary shards: one zstandard frame per document under a shared dictionary.

A shard file holds

    magic "TKD1", dictionary SHA-256 (32 bytes), bytes per id (u32)
    a zstandard frame of each document's little-endian ids
    the index: id known (u8 each), doc_id (i64 each), ids before (u64, one more), frame offset (u64, one more)
    documents (u64), index offset (u64)

so one document is read by its index entry and one range. The dictionary lies beside the shards under
its hash. Documents are range-partitioned by id and each partition writes its shard; only the sums
per shard are needed to number the ids of all documents.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.encoding import LETTERS, NUMBERS, WHITE, WordIds
from tessitura.llm.files import ranged, written
from tessitura.llm.wordhash import slices

END_ID = 2
MAGIC = b"TKD1"
HEAD = 40
DICTIONARY_BYTES = 64 << 10
#: A space with white space or an end beside it: the text is then encoded in one piece.
UNEVEN = re.compile(r"\s | \s|^ | $")
#: The words of text below U+0100: letters, contractions, numbers or other signs, with a space before them or not, and white
#: space, whose last character is left to what follows.
WORDS = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_level_path() -> str:
    """The byte-level vocabulary of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(WordIds):
    """Ids under a byte-level vocabulary, which keeps white space: a single space opens the word behind it."""

    def __init__(self, path: str, end_id: int, **limits: int) -> None:
        super().__init__(path, end_id, WORDS, **limits)
        self.width = int(self.kind[-1])

    def encode(self, text: str) -> bytes:
        """The ids of a text, the end id included, of `width` bytes each."""
        if self.latin(text):
            return self.ids_of(text) + self.end
        if UNEVEN.search(text) or any(token in text for token in self.added):
            return self.whole(text) + self.end
        # A lone space always opens a word, so the pieces between single spaces are encoded one by one.
        pieces = [" " * (k > 0) + piece for k, piece in enumerate(text.split(" "))]
        return b"".join([self.ids_of(p) if self.latin(p) else self.whole(p) for p in pieces]) + self.end


@lru_cache(1)
def _encoder(path: str, end_id: int) -> Encoder:
    """One per worker process, so that later tasks find the pieces of earlier ones."""
    return Encoder(path, end_id)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    for part in slices(batch.column("text")):
        count = len(part.bounds) - 1
        yield part.first, [t or "" for t in batch.column("text").slice(part.first, count).to_pylist()]


def train_dictionary(docs: DataFrame, path: str, end_id: int, rows: int = 2000, sample_bytes: int = 32 << 10) -> bytes:
    """A zstandard dictionary from the serialised ids of about `rows` documents, chosen by a hash of
    their ids, of each at most the first `sample_bytes` (samples only shape the dictionary)."""
    total = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // rows))) == 0).limit(2 * rows)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        for batch in batches:
            for _, texts in _texts(batch):
                out = [encoder.encode(t)[:sample_bytes] for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    found = [r["ids"] for r in chosen.mapInArrow(samples, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: the samples themselves
        return b"".join(sorted(found))[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, text: str = "text", doc_id: str = "doc_id", level: int = 3) -> DataFrame:
    """Encodes every whole text and writes the shards into `folder`; gives the stored manifest: shard,
    uri, doc_ids from and to, docs, tokens, bytes.

    Documents lie in ascending order of id (none first; rows that share an id by their texts). NULL
    reads as empty: such a document has its end id alone. Other columns are ignored; an empty table
    writes no shard.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    raw = train_dictionary(plain, path, end_id)
    name = hashlib.sha256(raw).hexdigest()
    with written(f"{folder}/{name}.zdict") as out:
        out.write(raw)
    shared = spark.sparkContext.broadcast(raw)  # DICTIONARY_BYTES at most

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared.value))
        known, ids, before, offsets = [], [], [0], [HEAD]
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder, uri = _encoder(path, end_id), f"{folder}/shard-{shard:08d}.tok"
        with written(uri) as out:
            out.write(MAGIC + bytes.fromhex(name) + np.array([encoder.width], "<u4").tobytes())
            for batch in chain([first], batches):
                names = batch.column("doc_id").to_pylist()
                for start, texts in _texts(batch):
                    for k, value in enumerate(texts):
                        tokens = encoder.encode(value)
                        frame = squeeze.compress(tokens)
                        out.write(frame)
                        known.append(names[start + k] is not None)
                        ids.append(names[start + k] or 0)
                        before.append(before[-1] + len(tokens) // encoder.width)
                        offsets.append(offsets[-1] + len(frame))
            for values, kind in ((known, "u1"), (ids, "<i8"), (before, "<u8"), (offsets, "<u8"), ((len(ids), offsets[-1]), "<u8")):
                out.write(np.array(values, kind).tobytes())
        size = offsets[-1] + 25 * len(ids) + 32
        row = [[shard], [uri], [ids[0] if known[0] else None], [ids[-1] if known[-1] else None], [len(ids)], [before[-1]], [size]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 5))], names=MANIFEST)

    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, "shard int, uri string, doc_from long, doc_to long, docs long, tokens long, bytes long").write.mode(
        "overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


MANIFEST = ["shard", "uri", "doc_from", "doc_to", "docs", "tokens", "bytes"]


class Shard:
    """An open shard file."""

    def __init__(self, source, dictionaries: dict[str, bytes], folder: str) -> None:
        head = source.read_at(HEAD, 0)
        if head[:4] != MAGIC:
            raise ValueError("not a token shard")
        name = head[4:36].hex()
        if name not in dictionaries:
            with ranged(f"{folder}/{name}.zdict") as raw:
                dictionaries[name] = raw.read()
            if hashlib.sha256(dictionaries[name]).hexdigest() != name:
                raise ValueError("the dictionary does not have the hash that the shard names")
        self.width = int(np.frombuffer(head, "<u4", 1, 36)[0])
        end = source.size()
        self.n, start = (int(x) for x in np.frombuffer(source.read_at(16, end - 16), "<u8"))
        index = source.read_at(end - 16 - start, start)
        self.known = np.frombuffer(index, "u1", self.n)
        self.ids = np.frombuffer(index, "<i8", self.n, self.n)
        self.before = np.frombuffer(index, "<u8", self.n + 1, 9 * self.n).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", self.n + 1, 17 * self.n + 8).astype(np.int64)
        self.source, self.unsqueeze = source, zstandard.ZstdDecompressor(dict_data=_dictionary(dictionaries[name]))

    def tokens(self, first: int, last: int) -> Iterator[np.ndarray]:
        """The ids of documents first..last-1, by one read."""
        raw = self.source.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        base = int(self.offsets[first])
        for k in range(first, last):
            frame = self.unsqueeze.decompress(raw[self.offsets[k] - base : self.offsets[k + 1] - base])
            yield np.frombuffer(frame, "<u2" if self.width == 2 else "<u4").astype("<u4")


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids
    of every document in the shards of `folder`."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    # A row per shard: the running sum is over as many rows as the writing job had tasks.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("uri", before.alias("before"))
    shards = shards.repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries: dict[str, bytes] = {}
        for batch in batches:
            for uri, start in zip(*(batch.column(c).to_pylist() for c in ("uri", "before"))):
                with ranged(uri) as source:
                    shard = Shard(source, dictionaries, folder)
                    for first in range(0, shard.n, 512):
                        last = min(first + 512, shard.n)
                        found = list(shard.tokens(first, last))
                        columns = [
                            pa.array([i if k else None for i, k in zip(shard.ids[first:last].tolist(), shard.known[first:last])], pa.int64()),
                            pa.array(start + shard.before[first:last]),
                            pa.array([len(t) for t in found], pa.int64()),
                            pa.array([zlib.crc32(t) for t in found], pa.int64()),
                        ]
                        if ids:
                            columns.append(pa.array([t.astype(np.int64) for t in found], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return shards.mapInArrow(read, f"{schema}, ids array<long>" if ids else schema)


def read_documents(spark: SparkSession, folder: str, wanted: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few documents, each by its shard's index and one range read."""
    out: dict[int, list[np.ndarray]] = {i: [] for i in wanted}
    dictionaries: dict[str, bytes] = {}
    near = [(F.coalesce("doc_from", F.lit(-(2**63))) <= i) & (F.col("doc_to") >= i) for i in wanted]
    some = near[0] if near else F.lit(False)
    for more in near[1:]:
        some |= more
    for row in spark.read.parquet(f"{folder}/manifest").where(some).collect():
        with ranged(row["uri"]) as source:
            shard = Shard(source, dictionaries, folder)
            keys = shard.ids[shard.known == 1]
            skip = shard.n - len(keys)
            for i in wanted:
                for k in range(int(np.searchsorted(keys, i, "left")), int(np.searchsorted(keys, i, "right"))):
                    out[i] += list(shard.tokens(skip + k, skip + k + 1))
    return out
