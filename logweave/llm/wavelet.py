"""Token ids on disk as wavelet matrices, one compressed file a shard.

A shard file holds the ids of consecutive documents. The ids are stored as bit planes, highest bit first;
each plane orders the ids stably by the bits above it, and its ranks are sampled. The planes answer
``access(i)``, ``rank(id, i)`` (how often an id occurs before i) and ``select(id, k)`` (where its k-th
occurrence is) in one step a plane, without decoding the shard.

File format, little-endian: the 8 bytes ``WAVELET1``; a 64-bit length and a JSON header of that length
(ids, bits, zeros per plane, documents, sizes of the parts); then zstandard frames: document ids
(64-bit), their null marks (bytes), document lengths (64-bit), and each plane's bits (packed, first bit
highest). Planes are padded to whole blocks of 512 bits; rank samples, one 32-bit count a block, are
summed up when a plane is opened.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.files import delete_matching, make_folder, shared_path
from logweave.llm.scratch import folder, stored
from logweave.llm.tokens import read_tokenizer, worker_encoder
from logweave.llm.words import text_chunks
from logweave.operators.scan import Scan, prefix_scan

MAGIC = b"WAVELET1"
BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """A sequence of ids below 2^bits as bit planes with rank and select."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes
        self._samples: list[np.ndarray | None] = [None] * bits

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = [], []
        for shift in range(bits - 1, -1, -1):
            bit = (now >> shift) & 1
            one = bit.astype(bool)
            packed = np.packbits(one)
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)]))
            low = now[~one]
            zeros.append(len(low))
            now = np.concatenate([low, now[one]])
        return cls(len(ids), bits, zeros, planes)

    def ids(self) -> np.ndarray:
        """All ids in order: the partitions undone from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            back = np.empty_like(now)
            back[~one] = now[: self.zeros[level]]
            back[one] = now[self.zeros[level] :] | now.dtype.type(1 << (self.bits - 1 - level))
            now = back
        return now.astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """One bits before position i of a plane."""
        samples = self._samples[level]
        if samples is None:
            blocks = _ONES[self.planes[level]].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            samples = self._samples[level] = np.concatenate(([0], np.cumsum(blocks, dtype=np.int64)))
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : i // 8]
        count = int(samples[block]) + int(_ONES[part].sum())
        return count + (bin(int(self.planes[level][i // 8]) >> (8 - i % 8)).count("1") if i % 8 else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][i // 8]) >> (7 - i % 8) & 1
            ones = self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where occurrences of ``token`` before i lie below the last plane."""
        low, high = 0, i
        for level in range(self.bits):
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + ones_low, self.zeros[level] + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position i."""
        if not 0 <= token < 1 << self.bits:
            return 0
        low, high = self._range(token, min(i, self.n))
        return high - low

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k (from 0) of ``token``."""
        if not 0 <= token < 1 << self.bits or k < 0:
            raise IndexError(k)
        low, high = self._range(token, self.n)
        if low + k >= high:
            raise IndexError(k)
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th bit of this kind in a plane, by bisection over its ranks."""
        low, high = 0, self.n
        while high - low > 1:
            middle = (low + high) // 2
            ones = self._ones(level, middle)
            if (ones if bit else middle - ones) <= k:
                low = middle
            else:
                high = middle
        return low


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, level: int = 1) -> bytes:
    matrix = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=level).compress
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [pack(known.tobytes()), pack(bytes(d is None for d in doc_ids)), pack(np.asarray(lengths, "<i8").tobytes())]
    parts += [pack(p.tobytes()) for p in matrix.planes]
    header = json.dumps({"ids": matrix.n, "bits": bits, "zeros": matrix.zeros, "documents": len(doc_ids), "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *parts])


def read_shard(content: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, document lengths and the wavelet matrix of a shard file."""
    if content[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    size = int.from_bytes(content[8:16], "little")
    header = json.loads(content[16 : 16 + size])
    at, parts = 16 + size, []
    unpack = zstandard.ZstdDecompressor().decompress
    for n in header["parts"]:
        parts.append(unpack(content[at : at + n]))
        at += n
    null = np.frombuffer(parts[1], np.uint8)
    doc_ids = [None if gone else d for d, gone in zip(np.frombuffer(parts[0], "<i8").tolist(), null)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[3:]]
    return doc_ids, np.frombuffer(parts[2], "<i8"), WaveletMatrix(header["ids"], header["bits"], header["zeros"], planes)


def _put(root: str, name: str, content: bytes) -> None:
    """Write under another name, then rename: a task that runs again replaces its file by the same one."""
    system, path = fs.FileSystem.from_uri(root)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, f"{path}/{name}")


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    shard_ids: int = 1 << 21,
    parts: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode all documents in ascending order of their id and write them as shard files below ``path``.

    A null text is empty (the end id alone); rows with a null id come first; repeated rows are documents of
    their own, equal ids in the order of their texts' hashes. A shard closes at the end of the document that fills it,
    so a task holds one shard and one chunk of text at most. ``parts`` is the number of write tasks
    (default: the session's shuffle partitions). An empty table writes no file. ``path`` is one of Spark's default file system
    if it names no other; a folder of one machine is refused on a cluster. What tries that failed have left is removed at the end.

    Returns the stored list of shards: part, nr, name, n_ids.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    path = shared_path(spark, path)
    make_folder(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(spec.value, end_id)
        bits = max(1, int(encoder.vocabulary - 1).bit_length())
        part, nr, held, doc_ids, lengths, waiting = TaskContext.get().partitionId(), 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            name = f"shard-{part:06d}-{nr:06d}.wm"
            _put(path, name, shard_bytes(doc_ids, np.concatenate(lengths), np.concatenate(waiting), bits))
            return pa.RecordBatch.from_pydict({"part": [part], "nr": [nr], "name": [name], "n_ids": [held]})

        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(0)):
                ids, bounds = encoder.encode(data, offsets)
                keys, at = batch.column(1).slice(low, high - low).to_pylist(), 0
                while at < len(keys):  # up to the document that fills the shard
                    end = min(len(keys), int(np.searchsorted(bounds, bounds[at] + shard_ids - held)))
                    doc_ids += keys[at:end]
                    lengths.append(np.diff(bounds[at : end + 1]))
                    waiting.append(ids[bounds[at] : bounds[end]])
                    held += int(bounds[end] - bounds[at])
                    at = end
                    if held >= shard_ids:
                        yield close()
                        nr, held, doc_ids, lengths, waiting = nr + 1, 0, [], [], []
        if doc_ids:
            yield close()

    rows = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "text_hash", "row"]  # the row number splits any number of equal rows
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).select("text", "doc_id")
    shards = stored(sorted_rows.mapInArrow(run, "part bigint, nr bigint, name string, n_ids bigint"), "shards")
    delete_matching(spark, f"{path}/.shard-*")
    return shards


def read_documents(spark: SparkSession, path: str, shards: DataFrame) -> DataFrame:
    """Documents of the listed shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    starts = prefix_scan(
        shards.withColumn("block", F.expr("part div 1024")), [], [["block"], ["part"]], ["nr"],
        [Scan("before", F.col("n_ids"))],
    ).select("name", "before")
    files = spark.read.format("binaryFile").load(path).select("content", F.element_at(F.split("path", "/"), -1).alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, name in zip(batch.column(0), batch.column(1)):
                doc_ids, lengths, matrix = read_shard(content.as_py())
                raw = memoryview(matrix.ids().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([name.as_py()] * len(doc_ids))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "inside", "n_tokens", "ids_crc32", "name"])

    rows = files.mapInArrow(run, "doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint, name string")
    return rows.join(starts, "name").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, **options) -> DataFrame:
    """Write all documents as shard files and read them back from there."""
    path = path or folder(docs.sparkSession, "wavelet")
    shards = write_shards(docs, path, tokenizer_path, end_id, **options)
    return read_documents(docs.sparkSession, path, shards)
