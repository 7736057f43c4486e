"""Token ids in binary files: patched frame-of-reference blocks.

A file holds the ids of consecutive documents, in blocks of 256 ids. Of each block the
minimum is subtracted; the differences are packed at the width that holds a given share of
them; those that need more bits are outliers, of which the packed bits are the low ones and
the rest is in an exception list. Layout, all numbers little-endian:

    magic "HFPF" | version u32 | ids u64 | documents u64 | blocks u64
    per document:  length in bytes of its id's text u32 (0xFFFFFFFF: null) and its number of ids u64
    the texts of the documents' ids, side by side
    block index:   u64 start of each block, from the first block, and the end of the last
    per block:     minimum u32 | width u8 | number of exceptions u16 (256 at most) | packed
                   differences, lowest bit first | exceptions' positions u8 | their high bits u32

Files are written by the tasks that hold the documents, sorted by id, into the folder that
the cluster shares: first under a name of the attempt, then moved to the name of the part,
so that a task that is run again, or twice, leaves one and the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS, shared_dir
from .tokens import Encoder, tokenizer_path

MAGIC, VERSION, BLOCK = b"HFPF", 1, 256
#: Share of a block's differences that its width holds, at least.
SHARE = 0.9
#: A file is closed once it has as many ids: some 8 MB.
FILE_IDS = 4 << 20
#: Blocks coded at once.
MANY = 4096
NULL = 0xFFFFFFFF


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray, share: float = SHARE) -> list[bytes]:
    """The blocks of unsigned 32-bit ids; the last may be short."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    for first in range(0, whole, MANY * BLOCK):
        out += encode_many(ids[first : min(first + MANY * BLOCK, whole)].reshape(-1, BLOCK), share)
    if whole < len(ids):
        out += encode_many(ids[whole:].reshape(1, -1), share)
    return out


def encode_many(blocks: np.ndarray, share: float) -> list[bytes]:
    n = blocks.shape[1]
    low = blocks.min(1)
    diff = blocks - low[:, None]
    pick = min(n - 1, int(np.ceil(share * n)) - 1)
    widths = bit_length(np.partition(diff, pick, axis=1)[:, pick])
    out: list = [None] * len(blocks)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        part = diff[rows]
        raw = part.astype("<u4").view(np.uint8).reshape(len(rows), n, 4)
        bits = np.unpackbits(raw, axis=2, count=int(width), bitorder="little") if width else np.zeros((len(rows), 0), np.uint8)
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        high = part.astype(np.uint64) >> np.uint64(width)
        for k, row in enumerate(rows):
            at = np.flatnonzero(high[k])
            out[row] = struct.pack("<IBH", int(low[row]), int(width), len(at)) + packed[k].tobytes() + at.astype(np.uint8).tobytes() + high[k][at].astype("<u4").tobytes()
    return out


def decode_block(data: bytes, n: int) -> np.ndarray:
    low, width, count = struct.unpack_from("<IBH", data)
    size = (n * width + 7) // 8
    out = np.zeros((n, 32), np.uint8)
    if width:
        out[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, 7), count=n * width, bitorder="little").reshape(n, width)
    ids = np.packbits(out, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint64)
    at = np.frombuffer(data, np.uint8, count, 7 + size)
    high = np.frombuffer(data, "<u4", count, 7 + size + count)
    ids[at] |= high.astype(np.uint64) << np.uint64(width)
    return (ids + np.uint64(low)).astype("<u4")


def encode_file(keys: list[str | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A file of documents with the given id texts and numbers of ids."""
    names = [None if k is None else k.encode() for k in keys]
    blocks = encode_blocks(ids)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    table = np.array([(NULL if x is None else len(x), c) for x, c in zip(names, counts, strict=True)], [("name", "<u4"), ("n", "<u8")])
    return b"".join([MAGIC, struct.pack("<IQQQ", VERSION, len(ids), len(keys), len(blocks)), table.tobytes(), *[x or b"" for x in names], starts.tobytes(), *blocks])


class File:
    """A file's documents and, by the block index, any stretch of its ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or struct.unpack_from("<I", data, 4)[0] != VERSION:
            raise ValueError("not a token file of this version")
        self.data = data
        self.ids, documents, blocks = struct.unpack_from("<QQQ", data, 8)
        table = np.frombuffer(data, [("name", "<u4"), ("n", "<u8")], documents, 32)
        self.counts = table["n"].astype(np.int64)
        at, self.keys = 32 + 12 * documents, []
        for size in table["name"].tolist():
            self.keys.append(None if size == NULL else data[at : at + size].decode())
            at += 0 if size == NULL else size
        self.index = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.blocks = at + 8 * (blocks + 1)

    def read(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, "<u4")
        parts = []
        for b in range(start // BLOCK, (end - 1) // BLOCK + 1):
            n = min(BLOCK, self.ids - b * BLOCK)
            parts.append(decode_block(self.data[self.blocks + self.index[b] : self.blocks + self.index[b + 1]], n))
        first = start // BLOCK * BLOCK
        return np.concatenate(parts)[start - first : end - first]

    def documents(self, at_once: int = 1 << 20):
        """``(key, ids)`` in order, decoding about ``at_once`` ids at a time."""
        start, k = 0, 0
        while k < len(self.keys):
            last, end = k, start
            while last < len(self.keys) and (last == k or end - start < at_once):
                end += int(self.counts[last])
                last += 1
            ids, at = self.read(start, end), 0
            for key, n in zip(self.keys[k:last], self.counts[k:last].tolist(), strict=True):
                yield key, ids[at : at + n]
                at += n
            start, k = end, last


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Writes the ids of ``docs`` into ``folder``, in ascending order of id (nulls first, equal
    ids by text): token files, and a table ``manifest`` of ``(part, file, ids, documents)``.

    ``folder`` is a URI that pyarrow's file systems and Spark both know, such as file, hdfs
    or s3. A null text counts as empty: a document of the end id alone. Repeated rows are
    documents of their own."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encode, end = Encoder.get(path).ids, np.array([end_id], "<u4").tobytes()
        keys, counts, ids, number = [], [], [], 0
        done = []

        def close():
            nonlocal keys, counts, ids, number
            name = f"part-{part:06d}-{number:06d}.hfpf"
            with system.open_output_stream(f"{root}/.{name}.{attempt}") as f:
                f.write(encode_file(keys, counts, np.frombuffer(b"".join(ids), "<u4")))
            system.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            done.append((part, name, sum(counts), len(keys)))
            keys, counts, ids, number = [], [], [], number + 1

        waiting = 0
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = encode(text or "") + end
                keys.append(key)
                counts.append(len(got) // 4)
                ids.append(got)
                waiting += len(got) // 4
                if waiting >= file_ids:
                    close()
                    waiting = 0
        if keys:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "ids", "documents"])

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(F.col(id_col), F.xxhash64("text")).sortWithinPartitions(F.col(id_col), "text")
    dealt.select(F.col(id_col).cast("string"), "text").mapInArrow(run, "part int, file string, ids long, documents long").write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document of the files in ``folder``;
    ``doc_id`` is the id's text, ``start`` the number of ids of all documents before it."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                file = File(data.as_py())
                found = [(key, len(ids), zlib.crc32(np.ascontiguousarray(ids).tobytes())) for key, ids in file.documents()]
                n = np.array([f[1] for f in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([f[2] for f in found], pa.int64())],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hfpf").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    manifest = spark.read.parquet(f"{folder}/manifest")
    # Names sort like documents. Parts are summed first, so that no window holds all files.
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    of_part = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_file = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.select("part", "file", of_file.alias("inside")).join(parts.select("part", of_part.alias("before")), "part").select("file", (F.col("before") + F.col("inside")).alias("first"))
    documents = files.mapInArrow(run, "file string, doc_id string, at long, n_tokens long, ids_crc32 long")
    return documents.join(starts, "file").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes ``docs`` into a new folder of the shared one and reads the files back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    write(docs, folder, tokenizer, end_id, id_col, text_col, file_ids)
    kind = docs.select(id_col).schema[0].dataType
    return read(spark, folder).withColumn(id_col, F.col("doc_id").cast(kind)).select(id_col, "start", "n_tokens", "ids_crc32")
