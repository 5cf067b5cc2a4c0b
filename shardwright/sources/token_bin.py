"""``token_bin``: Python data source for token shard files.

File layout (fixed values): 256 int32 little-endian header words (magic
20240520, version 1, token count), then the uint16 tokens.

Paths may name any store of ``sources.stores`` (local, ``s3:``, ``hdfs:``, ...);
planning lists a folder once and opens no file, reading fetches only the byte
ranges of the chunks asked for.

Read: one input partition per (file, range of chunks); a chunk row is
``(shard_stem, chunk_id, start_pos, tokens array<int>)``, header-free
positions.  Filters on ``shard_stem``, ``chunk_id`` and ``start_pos`` are pushed
into the planning: shards and chunks that they exclude make no partition and
are not read.  Options: ``path`` (glob) or ``paths`` (JSON list of files),
``chunkSize`` (tokens per row, default 65536), ``chunksPerPartition`` (default 64),
``headerOnly`` (``true``: one row per file ``(shard_stem, magic, version,
n_tokens, n_bytes)`` without reading tokens), ``minTokens`` (a file with a smaller
count is an error), ``raw`` (``true``: positions as in a whole-file uint16 read,
i.e. plus 512), ``fileSystem`` (``module:function`` that opens other stores).

Write: rows ``(shard_stem, start_pos, tokens)``, or with the ids already as bytes of the
file in a binary column ``packed``; the caller puts every
shard in one task in position order (``repartition(shard_stem)`` +
``sortWithinPartitions``).  Arrow batches go to 16-bit buffers as they are; a
shard's buffers are held until its count, which stands in the header, is known
(2 bytes a token, 200 MB for a shard of 100 million).  Each task writes
``<stem>.bin`` files under a temporary name; ``commit`` renames them, ``abort``
removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter,
                                    GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
                                    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from ..constants import HEADER_INTS, HEADER_TOKENS, SHARD_MAGIC, SHARD_VERSION, TOKEN_LIMIT
from ..session import cut_lineage
from . import stores

HEADER_BYTES = HEADER_INTS * 4
PART_TOKENS = 1 << 26  # tokens of a long file that one task writes
COPY_BYTES = 1 << 23
READ_TOKENS = 1 << 20  # most tokens of a batch of chunks
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

CHUNK_SCHEMA = "shard_stem string, chunk_id int, start_pos long, tokens array<int>"
HEADER_SCHEMA = "shard_stem string, magic int, version int, n_tokens long, n_bytes long"

# what a pushed filter keeps, for arrays of values; a null literal keeps nothing
KEEPS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v,
    EqualNullSafe: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: np.isin(x, [one for one in v if one is not None]),
    IsNotNull: lambda x, v: np.ones(len(x), bool),
    StringStartsWith: lambda x, v: np.char.startswith(x, v),
    StringEndsWith: lambda x, v: np.char.endswith(x, v),
    StringContains: lambda x, v: np.char.find(x, v) >= 0,
}


def kept(filters: Iterable[Filter], column: str, values: np.ndarray) -> np.ndarray:
    """Mask of the column's values that all its filters keep."""
    mask = np.ones(len(values), bool)
    for f in filters:
        if f.attribute == (column,):
            value = getattr(f, "value", None)
            mask &= KEEPS[type(f)](values, value) if value is not None or isinstance(f, IsNotNull) else False
    return mask


def read_header(path: str, opener: str | None = None) -> np.ndarray:
    return np.frombuffer(stores.read_range(path, 0, HEADER_BYTES, opener), "<i4")


def check_header(path: str, n_bytes: int, opener: str | None = None) -> int:
    h = read_header(path, opener)
    if len(h) < 3 or h[0] != SHARD_MAGIC:
        raise ValueError(f"{path}: header starts with {h[:1].tolist()}, expected {SHARD_MAGIC}")
    if h[1] != SHARD_VERSION:
        raise ValueError(f"{path}: version {h[1]}, expected {SHARD_VERSION}")
    n = int(h[2])
    if n_bytes != HEADER_BYTES + 2 * n:
        raise ValueError(f"{path}: {n_bytes} bytes, expected {HEADER_BYTES + 2 * n} for {n} ids")
    return n


def _header(count: int) -> bytes:
    header = np.zeros(HEADER_INTS, "<i4")
    header[:3] = SHARD_MAGIC, SHARD_VERSION, count
    return header.tobytes()


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class ChunkRange(InputPartition):
    """Consecutive chunks of a file."""

    def __init__(self, path: str, n_bytes: int, first_chunk: int, n_chunks: int):
        self.path, self.n_bytes, self.first_chunk, self.n_chunks = path, n_bytes, first_chunk, n_chunks


class TokenBinReader(DataSourceReader):
    def __init__(self, options: dict):
        self.patterns = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.opener = options.get("fileSystem")
        self.chunk = int(options.get("chunkSize", 65536))
        self.per_part = int(options.get("chunksPerPartition", 64))
        self.min_tokens = int(options.get("minTokens", 0))
        self.header_only = str(options.get("headerOnly", "false")).lower() == "true"
        self.shift = HEADER_TOKENS if str(options.get("raw", "false")).lower() == "true" else 0
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        columns = {"shard_stem"} if self.header_only else {"shard_stem", "chunk_id", "start_pos"}
        for f in filters:
            if type(f) in KEEPS and f.attribute in {(c,) for c in columns}:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[ChunkRange]:
        files = [f for p in self.patterns for f in stores.matching(p, self.opener)]
        if not files:
            raise FileNotFoundError(f"{self.patterns} matches no file; expected one or more shard files")
        wanted = kept(self.filters, "shard_stem", np.array([_stem(f.path) for f in files]))
        parts = []
        for f in (f for f, k in zip(files, wanted) if k):
            if self.header_only:
                parts.append(ChunkRange(f.path, f.size, 0, 0))
                continue
            n_tokens = max((f.size - HEADER_BYTES) // 2, 0)
            chunks = np.arange(max(-(-n_tokens // self.chunk), 1))
            chunks = chunks[kept(self.filters, "chunk_id", chunks)
                            & kept(self.filters, "start_pos", chunks * self.chunk + self.shift)]
            for run in np.split(chunks, np.flatnonzero(np.diff(chunks) != 1) + 1):
                parts += [ChunkRange(f.path, f.size, int(run[k]), len(run[k:k + self.per_part]))
                          for k in range(0, len(run), self.per_part)]
        return parts

    def read(self, part: ChunkRange | None) -> Iterator:
        if part is None:  # Spark's one task of a scan without partitions
            return
        if self.header_only:
            h = read_header(part.path, self.opener)
            if self.min_tokens and (len(h) < 3 or h[2] < self.min_tokens):
                raise ValueError(f"{part.path} holds {h[2:3].tolist()} tokens, expected at least {self.min_tokens}")
            yield (_stem(part.path), int(h[0]), int(h[1]), int(h[2]), part.n_bytes)
            return
        n = check_header(part.path, part.n_bytes, self.opener)
        if n < self.min_tokens:
            raise ValueError(f"{part.path} holds {n} tokens, expected at least {self.min_tokens}")
        lo = part.first_chunk * self.chunk
        hi = min(n, (part.first_chunk + part.n_chunks) * self.chunk)
        if hi <= lo:
            return
        step = max(1, READ_TOKENS // self.chunk) * self.chunk
        for a in range(lo, hi, step):
            b = min(a + step, hi)
            raw = stores.read_range(part.path, HEADER_BYTES + 2 * a, 2 * (b - a), self.opener)
            tokens = np.frombuffer(raw, "<u2").astype(np.int32)
            starts = np.arange(a, b, self.chunk, dtype=np.int64)
            offsets = np.append(starts - a, b - a).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([_stem(part.path)] * len(starts), pa.string()),
                pa.array((starts // self.chunk).astype(np.int32)),
                pa.array(starts + self.shift),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens)),
            ], names=["shard_stem", "chunk_id", "start_pos", "tokens"])


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class TokenBinWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.dir = options["path"].rstrip("/")
        self.opener = options.get("fileSystem")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = stores.open_store(self.dir, self.opener)
        store.create_dir(folder, recursive=True)
        done: list[tuple[str, str]] = []
        stem, held = None, []
        try:
            for batch in iterator:
                stems = batch.column("shard_stem")
                first = 0
                while first < batch.num_rows:  # once per shard of the batch
                    name = stems[first].as_py()
                    n = int(np.argmin(np.append(stems.slice(first).to_numpy(zero_copy_only=False) == name, False)))
                    if name != stem:
                        self._close(store, folder, stem, held, done)
                        stem, held = name, []
                    held.append(self._ids(name, batch, first, n))
                    first += n
            self._close(store, folder, stem, held, done)
        except BaseException:  # a failed attempt leaves no file behind
            self._remove([temporary for temporary, _ in done])
            raise
        return Written(done)

    @staticmethod
    def _ids(stem: str, batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
        """The ids of ``n`` rows of a shard, as the file stores them."""
        if "packed" in batch.schema.names:
            rows = batch.column("packed").slice(first, n)
            if rows.null_count:
                raise ValueError(f"shard {stem} holds a null part")
            if pa.types.is_binary(rows.type) and len(rows):  # a copy: a view would keep the whole batch
                _, at, data = rows.buffers()
                bounds = np.frombuffer(at, np.int32, count=rows.offset + len(rows) + 1)
                return np.frombuffer(data[int(bounds[rows.offset]):int(bounds[-1])].to_pybytes() if data else b"", "<u2")
            return np.frombuffer(b"".join(rows.to_pylist()), "<u2")
        tokens = batch.column("tokens").slice(first, n).flatten()
        if tokens.null_count:
            raise ValueError(f"shard {stem} holds a null id")
        ids = tokens.to_numpy()
        if ids.size and (ids.min() < 0 or ids.max() >= TOKEN_LIMIT):
            raise ValueError(f"shard {stem} holds ids from {ids.min()} to {ids.max()}; a file stores 16 bits each")
        return ids.astype("<u2")

    @staticmethod
    def _close(store: fs.FileSystem, folder: str, stem: str | None, held: list[np.ndarray], done: list[tuple[str, str]]) -> None:
        """Write a whole shard under a temporary name."""
        if stem is None:
            return
        count = sum(map(len, held))
        if count >= 2 ** 31:
            raise ValueError(f"shard {stem} has {count} ids; the header's count is a signed 32-bit integer")
        temporary = f"{folder}/.{stem}.bin.{uuid.uuid4().hex}.tmp"
        done.append((temporary, f"{folder}/{stem}.bin"))
        with store.open_output_stream(temporary) as out:
            out.write(_header(count))
            for ids in held:
                out.write(ids)

    def _remove(self, paths: list[str]) -> None:
        store, _ = stores.open_store(self.dir, self.opener)
        for path in paths:
            if store.get_file_info(path).type == fs.FileType.File:
                store.delete_file(path)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = stores.open_store(self.dir, self.opener)
        written = set()
        for temporary, final in (f for m in messages if m for f in m.files):
            store.move(temporary, final)
            written.add(final)
        if self.overwrite:  # the folder then holds this job's shards only
            old = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            self._remove([f.path for f in old if f.path.endswith(".bin") and f.path not in written])

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([temporary for m in messages if m for temporary, _ in m.files])


class TokenBinDataSource(DataSource):
    @classmethod
    def name(cls):
        return "token_bin"

    def schema(self):
        if str(self.options.get("headerOnly", "false")).lower() == "true":
            return HEADER_SCHEMA
        return CHUNK_SCHEMA

    def reader(self, schema: StructType):
        return TokenBinReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return TokenBinWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``token_bin`` known to the session, and let Spark hand filters to Python sources."""
    spark.dataSource.register(TokenBinDataSource)
    spark.conf.set(PUSHDOWN, "true")


def write_shards(chunks: DataFrame, path: str, **options) -> None:
    """Write ``(shard_stem, start_pos, tokens)`` or ``(shard_stem, start_pos, packed)`` rows as shard files."""
    register(chunks.sparkSession)
    ids = "packed" if "packed" in chunks.columns else "tokens"
    chunks.select("shard_stem", "start_pos", ids).repartition("shard_stem") \
        .sortWithinPartitions("shard_stem", "start_pos") \
        .write.format("token_bin").mode("append").options(path=path, **options).save()


def write_long_shards(rows: DataFrame, path: str, part_tokens: int = PART_TOKENS,
                      cut: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple[str, int]]:
    """S5 for files of any length: ``(shard_stem, start_pos, tokens or packed)`` rows, start positions per file from 0.

    A file's position ranges of ``part_tokens`` are written by separate tasks as part
    files; then one task per file streams its parts, in order and behind a header with
    their total, into the file, and removes them.  No task holds more than a part and one
    row, and nothing passes through the driver but names and counts, which are returned.

    With ``cut`` the rows are ``(shard_stem, start_pos, n_tokens, ...)`` without ids.  They are
    dealt by file; ``cut`` adds ``packed`` to them where they then lie, and each file is streamed
    from its rows by one task: no ids are exchanged, and none is stored but in its file.
    """
    if cut is not None:
        return _write_streams(rows, path, cut)
    spark, staging = rows.sparkSession, f"{path.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    part = F.format_string("%s.%012d", "shard_stem", F.floor(F.col("start_pos") / part_tokens))
    write_shards(rows.withColumn("shard_stem", part), staging)
    if not stores.matching(f"{staging}/*.bin"):  # no rows, no files
        return []
    parts = header_inventory(spark, f"{staging}/*.bin").select(
        F.regexp_extract("shard_stem", r"^(.*)\.\d+$", 1).alias("stem"), F.col("shard_stem").alias("part"), "n_tokens")
    files = parts.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("part", "n_tokens"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = stores.open_store(path.rstrip("/"))
        _, inside = stores.open_store(staging)
        for batch in batches:
            for row in batch.to_pylist():
                count = sum(p["n_tokens"] for p in row["parts"])
                final = f"{folder}/{row['stem']}.bin"
                names = [f"{inside}/{p['part']}.bin" for p in row["parts"]]
                if store.get_file_info(names[-1]).type == fs.FileType.File:  # else joined by a task that is run again
                    with _new_file(store, folder, row["stem"], count) as out:
                        for name in names:
                            with store.open_input_file(name) as source:
                                source.seek(HEADER_BYTES)
                                while block := source.read(COPY_BYTES):
                                    out.write(block)
                    for name in reversed(names):
                        store.delete_file(name)
                elif store.get_file_info(final).size != HEADER_BYTES + 2 * count:
                    raise FileNotFoundError(f"{names[-1]}: a part of {final} is missing")
                yield pa.RecordBatch.from_pylist([{"stem": row["stem"], "n_tokens": count}])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = files.repartition(n, "stem").mapInArrow(join, "stem string, n_tokens long").collect()
    store, inside = stores.open_store(staging)
    store.delete_dir(inside)
    return sorted((r["stem"], r["n_tokens"]) for r in done)


@contextmanager
def _new_file(store: fs.FileSystem, folder: str, stem: str, count: int) -> Iterator[pa.NativeFile]:
    """A shard file of ``count`` ids to write them to; it gets its name when it is complete."""
    if count >= 2 ** 31:
        raise ValueError(f"shard {stem} has {count} ids; the header's count is a signed 32-bit integer")
    temporary = f"{folder}/.{stem}.bin.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(temporary) as out:
            out.write(_header(count))
            yield out
            written = out.tell()
        if written != HEADER_BYTES + 2 * count:
            raise ValueError(f"shard {stem} has {count} ids, {written - HEADER_BYTES} bytes were written")
        store.move(temporary, f"{folder}/{stem}.bin")
    except BaseException:
        if store.get_file_info(temporary).type == fs.FileType.File:
            store.delete_file(temporary)
        raise


def _write_streams(rows: DataFrame, path: str, cut: Callable[[DataFrame], DataFrame]) -> list[tuple[str, int]]:
    """One task per file: its rows in position order, their ids cut and streamed behind a header with the total."""
    spark, total = rows.sparkSession, "file_tokens"
    rows = cut_lineage(rows)  # small rows; the totals and the files are of the same ones
    totals = rows.groupBy("shard_stem").agg(F.sum("n_tokens").cast("long").alias(total))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = stores.open_store(path.rstrip("/"))
        store.create_dir(folder, recursive=True)
        columns = ("shard_stem", total, "start_pos", "packed")
        each = (row for batch in batches for row in zip(*(batch.column(c) for c in columns)))
        for stem, own in groupby(each, key=lambda row: row[0].as_py()):
            first = next(own)
            with _new_file(store, folder, stem, count := first[1].as_py()) as out:
                for _, _, start, packed in chain([first], own):
                    if out.tell() != HEADER_BYTES + 2 * start.as_py():
                        raise ValueError(f"shard {stem}: ids up to {(out.tell() - HEADER_BYTES) // 2}, the next start at {start}")
                    if not packed.is_valid:
                        raise ValueError(f"shard {stem} holds a null part")
                    out.write(packed.as_buffer())
            yield pa.RecordBatch.from_pylist([{"stem": stem, "n_tokens": count}])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by the work, which the rows' few bytes do not show
    # by a hash of the name: Spark leaves out an exchange by the join's own key, and may then turn the join into
    # a broadcast one, which does not bring a file's rows together
    dealt = rows.join(totals, "shard_stem").repartition(n, F.xxhash64("shard_stem")) \
        .sortWithinPartitions("shard_stem", "start_pos", "n_tokens")
    done = cut(dealt).select("shard_stem", total, "start_pos", "packed").mapInArrow(stream, "stem string, n_tokens long").collect()
    return sorted((r["stem"], r["n_tokens"]) for r in done)


def read_shards(spark: SparkSession, files: str | list[str], **options) -> DataFrame:
    """Chunk rows of every file matching a pattern, or of the files of a list, in path order."""
    register(spark)
    where = {"path": files} if isinstance(files, str) else {"paths": json.dumps(files)}
    return spark.read.format("token_bin").options(**where, **options).load()


def header_inventory(spark: SparkSession, pattern: str, min_tokens: int = 0, **options) -> DataFrame:
    """Header of every file without reading tokens; a file of less than ``min_tokens`` is refused."""
    return read_shards(spark, pattern, headerOnly="true", minTokens=str(min_tokens), **options)


def inventory_total(inventory: DataFrame) -> DataFrame:
    """Files and tokens over all files, and the smallest and largest count."""
    return inventory.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_tokens").alias("n_tokens"),
                         F.min("n_tokens").alias("fewest"), F.max("n_tokens").alias("most"))
