"""Token-id files: whole texts to ids, range-coded blocks in files, and back.

Documents are range-partitioned by id, so the files in name order hold the
documents in ascending order.  A task tokenises its documents, cuts the stream
of ids into blocks of ``BLOCK`` ids and writes files of at most ``FILE_IDS``
ids: a header, an index (document ids and lengths), a table of blocks (bytes,
CRC-32 of their ids and bytes) and the coded blocks (:mod:`id_codec`), which are
independent of each other.  A file gets its final name by a rename after it is
complete, and its content depends on its documents only, so a task that runs
again writes the same files.

Reading goes through Spark's binary file source.  Magic, header, index and
every block are verified; damage raises an error that names the file.

Nulls: a null text is empty, its document is the end id alone; a null document
id is written as such and sorts first.  Documents with the same id follow one
another in the order of their texts.  An empty table writes no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .id_codec import decode_blocks, encode_blocks
from .scratch import shared_folder, stage
from .token_ids import encoder, text_slices

MAGIC = b"SWIDS2\r\n"
HEADER = struct.Struct("<IIIIQ")  # block ids, ids below, documents, blocks, all ids
BLOCK = 1024
LANES = 4096
FILE_IDS = 16 * LANES * BLOCK
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_ids", "<u4")])
TABLE = np.dtype([("n_bytes", "<u4"), ("crc", "<u4")])


class FileBuilder:
    """One file: documents go in, coded blocks are kept, ``content`` gives the bytes."""

    def __init__(self, ids_below: int):
        self.ids_below = ids_below
        self.index: list[tuple[int, int, int]] = []
        self.table: list[tuple[int, int]] = []
        self.payloads: list[bytes] = []
        self.waiting: list[bytes] = []
        self.n_waiting = self.n_ids = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        n = len(raw) // 4
        self.index.append((doc_id or 0, doc_id is not None, n))
        self.waiting.append(raw)
        self.n_waiting += n
        self.n_ids += n
        if self.n_waiting >= LANES * BLOCK:
            self._code(self.n_waiting // BLOCK * BLOCK)

    def _code(self, n: int) -> None:
        """Code the first ``n`` waiting ids; the last block may be short, it is filled up for coding."""
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        rest, ids = ids[n:], ids[:n]
        filled = np.zeros(-(-n // BLOCK) * BLOCK, np.uint32)
        filled[:n] = ids
        for at in range(0, len(filled), LANES * BLOCK):
            part = filled[at:at + LANES * BLOCK].reshape(-1, BLOCK)
            for k, payload in enumerate(encode_blocks(part, self.ids_below)):
                start = at + k * BLOCK
                self.table.append((len(payload), zlib.crc32(payload, zlib.crc32(ids[start:start + BLOCK].tobytes()))))
                self.payloads.append(payload)
        self.waiting, self.n_waiting = [rest.tobytes()], len(rest)

    def content(self) -> bytes:
        if self.n_waiting:
            self._code(self.n_waiting)
        head = MAGIC + HEADER.pack(BLOCK, self.ids_below, len(self.index), len(self.table), self.n_ids)
        head += np.array(self.index, INDEX).tobytes() + np.array(self.table, TABLE).tobytes()
        return b"".join([head, struct.pack("<I", zlib.crc32(head)), *self.payloads])


def documents_of(content: bytes, name: str = "") -> Iterator[tuple[int | None, int, bytes]]:
    """(document id, ids before it in the file, its ids as little-endian uint32) of a file."""
    if content[:len(MAGIC)] != MAGIC:
        raise ValueError(f"{name}: not a token-id file")
    block, below, n_docs, n_blocks, n_ids = HEADER.unpack_from(content, len(MAGIC))
    index_at = len(MAGIC) + HEADER.size
    table_at = index_at + n_docs * INDEX.itemsize
    end = table_at + n_blocks * TABLE.itemsize
    if len(content) < end + 4 or struct.unpack_from("<I", content, end)[0] != zlib.crc32(content[:end]):
        raise ValueError(f"{name}: header or index is damaged")
    index = np.frombuffer(content, INDEX, n_docs, index_at)
    table = np.frombuffer(content, TABLE, n_blocks, table_at)
    stops = end + 4 + np.cumsum(table["n_bytes"], dtype=np.int64)
    starts = stops - table["n_bytes"]
    if len(content) != (int(stops[-1]) if n_blocks else end + 4):
        raise ValueError(f"{name}: it holds {len(content)} bytes, its blocks end elsewhere")

    def chunks() -> Iterator[bytes]:
        for first in range(0, n_blocks, LANES):
            group = range(first, min(first + LANES, n_blocks))
            ids = decode_blocks([content[starts[k]:stops[k]] for k in group], block, below).astype("<u4").reshape(-1)
            ids = ids[:min(len(ids), n_ids - first * block)]
            raw = ids.tobytes()
            for k in group:
                at = (k - first) * block * 4
                if zlib.crc32(content[starts[k]:stops[k]], zlib.crc32(raw[at:at + 4 * block])) != table["crc"][k]:
                    raise ValueError(f"{name}: block {k} is damaged")
            yield raw

    source, held, at, before = chunks(), b"", 0, 0
    for doc_id, known, n in index.tolist():
        while len(held) - at < 4 * n:
            held, at = held[at:] + next(source), 0
        yield (doc_id if known else None), before, held[at:at + 4 * n]
        at, before = at + 4 * n, before + n


def write_files(docs: DataFrame, folder: str, vocabulary: str, ids_below: int, end_id: int, n_parts: int) -> DataFrame:
    """Write the files of ``docs`` (``doc_id, text``); gives one row per file."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        part, tag, written = TaskContext.get().partitionId(), uuid.uuid4().hex, []

        def finish(file: FileBuilder) -> None:
            name = f"{root}/ids-{part:06d}-{len(written):05d}.swids"
            content = file.content()
            with files.open_output_stream(f"{root}/_writing-{tag}") as out:
                out.write(content)
            files.move(f"{root}/_writing-{tag}", name)
            written.append((name.rsplit("/", 1)[1], len(file.index), file.n_ids, len(content)))

        enc, file = encoder(vocabulary), FileBuilder(ids_below)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in text_slices(texts):
                for doc_id, raw in zip(ids[a:b], enc.encode_all(texts[a:b])):
                    file.add(doc_id, raw + end)
                    if file.n_ids >= FILE_IDS:
                        finish(file)
                        file = FileBuilder(ids_below)
        if file.index:
            finish(file)
        if written:
            name, n_docs, n_ids, n_bytes = zip(*written)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), *(pa.array(c, pa.int64()) for c in (n_docs, n_ids, n_bytes))],
                names=["file", "n_docs", "n_ids", "n_bytes"])

    ordered = docs.repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "file string, n_docs long, n_ids long, n_bytes long")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, doc_id, at, n_tokens, ids_crc32``: the documents of all files, from the decoded ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [(d, at, len(raw) // 4, zlib.crc32(raw)) for d, at, raw in documents_of(content.as_py(), name)]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.rsplit("/", 1)[1]] * len(rows)), *(pa.array(c, pa.int64()) for c in columns)],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.swids").load(folder)
    return found.select("path", "content").mapInArrow(
        run, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, vocabulary: str, ids_below: int, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 1) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: one row per document, as read back from the files."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).mkdirs(path)
    path.getFileSystem(conf).deleteOnExit(path)
    stage(write_files(texts, folder, vocabulary, ids_below, end_id, max(1, docs.rdd.getNumPartitions())), "id-files")
    rows = stage(read_files(spark, folder), "id-rows")
    # one row per file: the ids in the files before it
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(files.select("file", ahead.alias("ahead")), "file").select(
        F.col("doc_id").alias(id_col), (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
