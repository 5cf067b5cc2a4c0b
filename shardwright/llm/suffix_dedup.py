"""Suffix dedup: remove every byte covered by a 50-byte string of an earlier document.

This is hashing of content-defined windows, in place of a difference-cover
suffix array: there is no recursion, no suffix is ordered or merged, and no
prefixes are compared; equal 64-bit hashes count as equal bytes, without a check
of the bytes.  Positions are sampled by content (a synchronising set): a position
is sampled if its 20-byte string has the smallest hash among the 31 that start in
some 50-byte string.  That meets every 50-byte string, and equal strings at the
same offset, with 1 of 16 positions.

1. *Sampled strings* are dealt by hash.  A 50-byte string can repeat
   only if its own sample, the least of its 20-byte strings, occurs in another
   document as well.
2. *Tuples.*  The text that five neighbouring shared samples span gets one name,
   the hash of its bytes, in one flat step.  A tuple that also starts in an
   earlier document settles all the strings inside it at once.
3. *Remaining suffixes*, the possible starts that no settled tuple covers, get
   the name of their 50-byte prefix, and are settled by the smallest document
   of the equal prefixes beside them.

Whole copies of a text are settled before that, by SHA-256: all but the first
are removed.  Names are 64-bit hashes of the bytes.  In every step a batch of
documents sends a name once, with its smallest owner; what repeats inside the
batch is settled there, so a passage that a third of all documents share makes
at most one row per batch.  Texts are written once, bucketed by document, and
met there by the small results of each step.

A null text is empty.  A null id counts as larger than all others; documents
with equal ids are no source for one another.  Texts under 50 bytes stay as
they are.  Repeated rows each give a row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shared_folder, stage
from .shingles import mixed, powers, slices

LENGTH = 50
SAMPLE = 20
STARTS = LENGTH - SAMPLE + 1
TUPLE = 5
BUCKET_NAMES = 2_000_000
BUCKET_BYTES = 24 << 20
NO_ID = (1 << 63) - 1
NEVER = 0xFFFFFFFF
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
BYTES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
PAIRS = np.dtype("<i4")


class Hashes:
    """Hashes of substrings of a run of bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * up[:len(data)], out=self.run[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed((self.run[stops] - self.run[starts]) * self.down[starts]
                     + (stops - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def of_all(self, width: int) -> np.ndarray:
        return mixed((self.run[width:] - self.run[:-width]) * self.down[:len(self.run) - width])


def sliding(x: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """``best`` over every ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, worst, x.dtype)
    padded[:len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = best.accumulate(rows, axis=1).reshape(-1)
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[:n], ahead[width - 1:width - 1 + n])


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions inside some [start, stop)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal true runs."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def possible_starts(offsets: np.ndarray) -> np.ndarray:
    """Mask of the positions at which a 50-byte string of one document starts."""
    stops = offsets[1:]
    return ~covered(np.maximum(offsets[:-1], stops - LENGTH + 1), stops, int(offsets[-1]))


def cover(hashes: Hashes, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, the hashes of their strings; the order of all strings, and the least in each 50 bytes."""
    n = len(possible)
    if n < LENGTH or not possible.any():
        none = np.zeros(0, np.uint32)
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), none, none
    strings = hashes.of_all(SAMPLE)
    order = (strings >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = np.where(possible[:n - LENGTH + 1], sliding(order, STARTS, np.minimum, NEVER), np.uint32(0))
    edge = np.zeros(STARTS - 1, np.uint32)
    chosen = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), STARTS, np.maximum, 0) == order)
    return chosen, strings[chosen], order, least


def slices_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, Hashes, np.ndarray]]:
    for row, data, offsets in slices(batch.column("text")):
        yield row, data, offsets, Hashes(data), possible_starts(offsets)


def deal(rows: list[tuple[int, np.ndarray]], n_buckets: int, local: int, earlier: bool) -> pa.RecordBatch | None:
    """Names of a batch by bucket, each once with its smallest owner; names settled here under ``local``."""
    rows = [(o, k) for o, k in rows if len(k)]
    if not rows:
        return None
    names = np.concatenate([k for _, k in rows])
    owners = np.repeat(np.array([o for o, _ in rows], np.int64), [len(k) for _, k in rows])
    order = np.lexsort((owners, names))
    names, owners = names[order], owners[order]
    fresh = np.concatenate(([True], names[1:] != names[:-1]))
    group, starts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    behind = owners != owners[starts][group]  # not the smallest owner
    many = np.logical_or.reduceat(behind, starts)
    told = behind if earlier else many[group]
    out = [(local, names[told].tobytes(), owners[told].tobytes(), b"")]
    names, owners = names[starts], owners[starts]
    bucket = (names % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, owners, many, bucket = names[order], owners[order], many[order], bucket[order]
    for a, b in runs_of(bucket):
        out.append((int(bucket[a]), names[a:b].tobytes(), owners[a:b].tobytes(), many[a:b].tobytes()))
    b, *blobs = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), *(pa.array(c, pa.binary()) for c in blobs)],
                                      names=["bucket", "names", "owners", "many"])


DEALT = "bucket long, names binary, owners binary, many binary"


def settled(dealt: DataFrame, earlier: bool, n_parts: int) -> DataFrame:
    """``owner, told``: the names of each document that another (``earlier``: a smaller one) has as well.

    A bucket hands its answers on in ``n_parts`` parts by owner, not owner by owner, so the rows on the way are
    buckets times parts however many documents there are.
    """

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.frombuffer(b"".join(rows["names"]), np.uint64)
        owners = np.frombuffer(b"".join(rows["owners"]), np.int64)
        if rows["bucket"].iloc[0] >= 0:
            many = np.frombuffer(b"".join(rows["many"]), bool)
            order = np.lexsort((owners, names))
            names, owners, many = names[order], owners[order], many[order]
            fresh = np.concatenate(([True], names[1:] != names[:-1]))
            group, starts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            told = owners != owners[starts][group]
            if not earlier:
                told = (np.logical_or.reduceat(told | many, starts))[group]
            names, owners = names[told], owners[told]
        part = (mixed(owners.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        names, owners, part = names[order], owners[order], part[order]
        edges = runs_of(part)
        return pd.DataFrame({"part": np.array([part[a] for a, _ in edges], np.int64),
                             "names": [names[a:b].tobytes() for a, b in edges],
                             "owners": [owners[a:b].tobytes() for a, b in edges]})

    def by_owner(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.frombuffer(b"".join(rows["names"]), np.uint64)
        owners = np.frombuffer(b"".join(rows["owners"]), np.int64)
        order = np.argsort(owners, kind="stable")
        names, owners = names[order], owners[order]
        edges = runs_of(owners)
        return pd.DataFrame({"owner": np.array([owners[a] for a, _ in edges], np.int64),
                             "told": [names[a:b].tobytes() for a, b in edges]})

    found = dealt.groupBy("bucket").applyInPandas(judge, "part long, names binary, owners binary")
    return found.groupBy("part").applyInPandas(by_owner, "owner long, told binary")


def runs_of(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs of equal keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(keys)].tolist()))


def dealing(batches: Iterator[pa.RecordBatch], names_of, n_buckets: int, earlier: bool) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 24
    for number, batch in enumerate(batches):
        out = deal(names_of(batch), n_buckets, -1 - task - number, earlier)
        if out is not None:
            yield out


def told_names(told) -> np.ndarray:
    return np.frombuffer(told or b"", np.uint64)


def regions_of(data: np.ndarray, told: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Of one document: runs of possible starts, tuples (start, stop) and their names."""
    hashes, n = Hashes(data), len(data)
    possible = possible_starts(np.array([0, n]))
    at, strings, order, least = cover(hashes, possible)
    shared = np.isin(strings, told)
    if not shared.any():
        return b"", b"", b""
    # a start stays possible if the least string of its 50 bytes is a shared sample
    known = np.full(len(order), NEVER, np.uint32)
    known[at[shared]] = order[at[shared]]
    first, last = runs(sliding(known, STARTS, np.minimum, NEVER) == least)
    five = np.flatnonzero(np.convolve(shared, np.ones(TUPLE, int), "valid") == TUPLE) if len(at) >= TUPLE else at[:0]
    start, stop = at[five], at[five + TUPLE - 1] + SAMPLE
    long_ = stop - start >= LENGTH
    start, stop = start[long_], stop[long_]
    return (np.stack([first, last], 1).astype(PAIRS).tobytes(), np.stack([start, stop], 1).astype(PAIRS).tobytes(),
            hashes.of(start, stop).tobytes())


def pairs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, PAIRS).reshape(-1, 2).astype(np.int64)


def open_starts(possible: bytes, spans: bytes, names: bytes, told: np.ndarray) -> tuple[bytes, bytes]:
    """Runs of starts settled by tuples, and runs of possible starts still open."""
    possible_, spans_ = pairs(possible), pairs(spans)
    spans_ = spans_[np.isin(np.frombuffer(names, np.uint64), told)]
    n = int(possible_[-1, 1]) if len(possible_) else 0
    done = covered(spans_[:, 0], np.minimum(spans_[:, 1] - LENGTH + 1, n), n)
    left = covered(possible_[:, 0], possible_[:, 1], n) & ~done
    return tuple(np.stack(runs(m), 1).astype(PAIRS).tobytes() for m in (done, left))


def starts_in(raw: bytes) -> np.ndarray:
    p = pairs(raw)
    return np.concatenate([np.arange(a, b) for a, b in p.tolist()]) if len(p) else np.zeros(0, np.int64)


def window_names(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return Hashes(data).of(starts, starts + LENGTH)


def trimmed(data: np.ndarray, done: bytes, open_: bytes, told: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the digest of what is left."""
    starts = starts_in(open_)
    starts = np.concatenate([starts_in(done), starts[np.isin(window_names(data, starts), told)]])
    gone = covered(starts, starts + LENGTH, len(data))
    return int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(data[~gone].tobytes()).hexdigest()


def text_table(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``owner, cid, text``, written once and bucketed by owner, so that later joins do not shuffle texts."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("owner"),
                       F.sha2(text, 256).alias("cid"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    rows.repartition(n, "owner").write.option("path", path).option("compression", "zstd").bucketBy(
        n, "owner").sortBy("owner").saveAsTable(name)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).deleteOnExit(folder)
    return spark.table(name), n


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256``: one row per document."""
    texts, n_parts = text_table(docs, id_col, text_col)
    digests = stage(texts.select("owner", "cid", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    firsts = digests.filter(f"n_bytes >= {LENGTH}").groupBy("cid").agg(F.min("owner").alias("owner"),
                                                                       F.min("n_bytes").alias("n_bytes"))
    firsts = stage(firsts, "firsts")
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0

    def buckets(names: int) -> int:
        return max(1, -(-names // BUCKET_NAMES))

    # 1. sampled strings
    own = firsts.groupBy("owner").agg(F.collect_set("cid").alias("cids"))
    n_samples = buckets(total // 16)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def names_of(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
            out, owners = [], batch.column("owner").to_pylist()
            for row, _, offsets, hashes, possible in slices_of(batch):
                at, strings, _, _ = cover(hashes, possible)
                cut = np.searchsorted(at, offsets)
                out += [(owners[row + k], strings[a:b]) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
            return out

        return dealing(batches, names_of, n_samples, False)

    first_texts = texts.join(own, "owner").filter(F.array_contains("cids", F.col("cid"))).select("owner", "cid", "text")
    shared = stage(settled(first_texts.mapInArrow(sampled, DEALT), False, n_parts), "shared")

    # 2. tuples of shared samples
    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, out, keep = batch.column("told"), [], []
            for row, data, offsets in slices(batch.column("text")):
                for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    found = regions_of(data[a:b], told_names(told[row + k].as_py()))
                    if found[0]:
                        out.append(found)
                        keep.append(row + k)
            kept = batch.take(pa.array(keep, pa.int64()))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [kept.column("owner"), kept.column("cid"), *(pa.array(c, pa.binary()) for c in columns)],
                names=["owner", "cid", "possible", "spans", "names"])

    with_shared = texts.join(own.join(shared, "owner"), "owner").filter(
        F.array_contains("cids", F.col("cid"))).select("owner", "cid", "text", "told")
    region = stage(with_shared.mapInArrow(
        regions, "owner long, cid string, possible binary, spans binary, names binary"), "regions")
    n_tuples = buckets((region.agg(F.sum(F.length("names"))).first()[0] or 0) // 8)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def names_of(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
            return [(o, np.frombuffer(k, np.uint64))
                    for o, k in zip(batch.column("owner").to_pylist(), batch.column("names").to_pylist())]

        return dealing(batches, names_of, n_tuples, True)

    tuples = settled(region.select("owner", "names").mapInArrow(named, DEALT), True, n_parts)

    # 3. remaining suffixes
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [open_starts(p, s, k, told_names(t)) for p, s, k, t in zip(
                *(batch.column(c).to_pylist() for c in ("possible", "spans", "names", "told")))]
            done, left = zip(*rows) if rows else ((), ())
            n_open = [int((pairs(r)[:, 1] - pairs(r)[:, 0]).sum()) for r in left]
            yield pa.RecordBatch.from_arrays(
                [batch.column("owner"), batch.column("cid"), pa.array(done, pa.binary()), pa.array(left, pa.binary()),
                 pa.array(n_open, pa.int64())], names=["owner", "cid", "done", "open", "n_open"])

    remaining = stage(region.join(tuples, "owner", "left").mapInArrow(
        opened, "owner long, cid string, done binary, open binary, n_open long"), "open")
    n_windows = buckets(remaining.agg(F.sum("n_open")).first()[0] or 0)
    per_owner = remaining.groupBy("owner").agg(F.collect_list(F.struct("cid", "done", "open")).alias("parts"))

    def with_parts(more: DataFrame) -> DataFrame:
        joined = texts.join(more, "owner")
        part = F.filter("parts", lambda p: p["cid"] == F.col("cid"))
        return joined.withColumn("part", F.get(part, F.lit(0))).filter("part IS NOT NULL")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def names_of(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
            open_, owners, out = batch.column("open").to_pylist(), batch.column("owner").to_pylist(), []
            for row, data, offsets in slices(batch.column("text")):
                for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    out.append((owners[row + k], window_names(data[a:b], starts_in(open_[row + k]))))
            return out

        return dealing(batches, names_of, n_windows, True)

    open_texts = with_parts(per_owner).select("owner", "text", F.col("part.open").alias("open"))
    repeated = stage(settled(open_texts.mapInArrow(windows, DEALT), True, n_parts), "repeated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, open_, told = (batch.column(c) for c in ("done", "open", "told"))
            rows = []
            for row, data, offsets in slices(batch.column("text")):
                for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    r = row + k
                    rows.append(trimmed(data[a:b], done[r].as_py(), open_[r].as_py(), told_names(told[r].as_py())))
            removed, spans, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)],
                names=["cid", "n_removed", "n_spans", "kept_sha256"])

    last = with_parts(per_owner.join(repeated, "owner", "left")).select(
        "cid", "text", F.col("part.done").alias("done"), F.col("part.open").alias("open"), "told")
    result = last.filter("length(done) > 0 OR told IS NOT NULL").mapInArrow(
        cut, "cid string, n_removed long, n_spans long, kept_sha256 string")
    whole = firsts.select("cid", F.col("owner").alias("first")).join(result, "cid", "left")
    rows = digests.join(whole, "cid", "left")
    copy = F.col("owner") > F.col("first")
    return rows.select(
        F.when(F.col("owner") != NO_ID, F.col("owner")).alias(id_col), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "cid")).alias("kept_sha256"))
