"""Embedding near-dedup by counting collisions in windows of sorted projections.

Every vector is projected on many random directions (each with both signs) and
every projection is sorted.  Around a vector lies a window: the values of that
direction at most ``window`` away.  Two vectors collide on a direction if one
lies in the other's window; a pair that collides at least ``count`` times over
all directions is verified by its exact cosine in double precision.

In the middle of a projection a window holds a large part of the table, in the
tails few vectors.  So a vector is entered, as query and as candidate, only on
the ``tails`` signed directions on which it lies furthest out, where a vector
of cosine 0.9 mostly lies far out too.

All entries are sorted together by direction and value, with a mark where each
entry's window ends; their numbers in that one range-partitioned order give the
window of every entry as an interval.  The order is cut into blocks of bounded
length.  An entry goes to its own block's task and to a task of its own with
each later block that its window reaches, so a direction on which a large
cluster lies is split like any other.  There the collisions of each pair of a
window are counted over all their common directions, and the pair is judged
only on the smallest direction of its collisions.

``tails`` and ``count`` are calibrated: a bounded sample of vectors each gets a
random partner at exactly the threshold; the count is the largest that finds
the wanted share of them, and the tails are the fewest whose count is at least
``LEAST_COUNT``.  The number of directions grows with the square root of the
table.  They are made in slices of ``SLICE``; of each the best tails so far are
kept, so memory grows neither with their number nor with the table.

Copies of a vector are merged first and count with their number.  Links are
counted where they are found and only the counts and the edges to the smallest
id of each local cluster are written, not the pairs.

Null, zero and non-finite vectors, and vectors with null components, link with
nothing; null ids never become a component's id unless alone.  Vectors of
different lengths never meet.  Other columns (labels) are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_row_number
from .components import components
from .scratch import stage

LEAST_COUNT = 2
WINDOW = 2.6  # in standard deviations of the difference of two projections at the threshold
RECALL = 0.97
SAMPLE = 2000
MOST_TAILS = 24
BLOCK = 4096  # entries and window ends
PAIRS_AT_ONCE = 100_000
SLICE = 512
KEPT_SLICES = 16


@lru_cache(maxsize=KEPT_SLICES)
def directions(dim: int, at: int, n: int) -> np.ndarray:
    """``n`` directions from number ``at`` on, a multiple of ``SLICE``."""
    return np.random.default_rng([dim, at, 17]).standard_normal((dim, n))


def n_directions(n_vectors: int) -> int:
    """Directions so that windows stay small: a power of two near 4 * sqrt(14 n)."""
    return 1 << max(6, math.ceil(math.log2(4 * math.sqrt(14 * max(1, n_vectors)))) - 1)


def tails_of(unit: np.ndarray, n_axes: int, tails: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (ascending) and values of the ``tails`` signed directions a vector lies furthest out on."""
    number = np.zeros((len(unit), 0), np.int64)
    value = np.zeros((len(unit), 0))
    for at in range(0, n_axes, SLICE):
        p = unit @ directions(unit.shape[1], at, min(SLICE, n_axes - at))
        mine = min(tails, p.shape[1])
        top = np.argpartition(-np.abs(p), mine - 1, axis=1)[:, :mine]
        of = np.take_along_axis(p, top, 1)
        number = np.concatenate([number, 2 * (top + at) + (of < 0)], 1)
        value = np.concatenate([value, np.abs(of)], 1)
        if number.shape[1] > tails:
            best = np.argpartition(-value, tails - 1, axis=1)[:, :tails]
            number, value = np.take_along_axis(number, best, 1), np.take_along_axis(value, best, 1)
    order = np.argsort(number, axis=1)
    return np.take_along_axis(number, order, 1), np.take_along_axis(value, order, 1)


def collisions(na, va, nb, vb, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair: number of collisions, and the smallest direction with one (-1: none)."""
    hits, first = np.zeros(len(na), np.int64), np.full(len(na), -1, np.int64)
    for t in range(na.shape[1]):
        v = va[:, t, None]
        close = ((nb == na[:, t, None]) & (np.maximum(v, vb) <= np.minimum(v, vb) + window)).any(axis=1)
        hits += close
        first = np.where(close & (first < 0), na[:, t], first)
    return hits, first


def window_of(threshold: float) -> float:
    return WINDOW * math.sqrt(2 - 2 * threshold)


def partners(sample: np.ndarray, threshold: float, seed: int = 5) -> np.ndarray:
    """To each unit row a random unit row at exactly the threshold."""
    noise = np.random.default_rng(seed).standard_normal(sample.shape)
    noise -= (noise * sample).sum(1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    return threshold * sample + math.sqrt(1 - threshold ** 2) * noise


def calibrated(sample: np.ndarray, n_axes: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """``tails, count``: the fewest tails whose largest count that finds ``recall`` of random partners at the
    threshold is at least ``LEAST_COUNT``; an error if ``MOST_TAILS`` do not."""
    most = min(MOST_TAILS, n_axes)
    if not len(sample) or sample.shape[1] == 1:
        return min(2, most), 1
    partner = partners(sample, threshold)
    for tails in range(LEAST_COUNT, most + 1):
        found = collisions(*tails_of(sample, n_axes, tails), *tails_of(partner, n_axes, tails), window_of(threshold))[0]
        count = int(np.sort(found)[math.floor((1 - recall) * len(found))])
        if count >= LEAST_COUNT:
            return tails, count
    raise ValueError(f"{most} tails of {n_axes} directions find {(found >= LEAST_COUNT).mean():.3f} of the pairs "
                     f"at cosine {threshold}, not {recall}")


def valid(vector: str):
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def rows_of(column: pa.Array) -> np.ndarray:
    """A matrix of unit rows from a list column of equal lengths."""
    x = np.array(column.to_pylist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, row numbers) of a list column."""
    lengths = np.array([len(v) for v in vectors.to_pylist()])
    for dim in np.unique(lengths).tolist():
        yield dim, np.flatnonzero(lengths == dim)


def projected(reps: DataFrame, n_axes: int, tails: int) -> DataFrame:
    """``rep, n, dim, numbers, values, unit``: a row per distinct vector with its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in by_length(batch.column("vector")):
                part = batch.take(pa.array(rows))
                unit = rows_of(part.column("vector"))
                number, value = tails_of(unit, n_axes, tails)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("n"), pa.array(np.full(len(rows), dim)), pa.array(list(number)),
                     pa.array(list(value)), pa.array([u.tobytes() for u in unit])],
                    names=["rep", "n", "dim", "numbers", "values", "unit"])

    return reps.mapInArrow(run, "rep long, n long, dim long, numbers array<long>, values array<double>, unit binary")


def windows(places: DataFrame, window: float) -> DataFrame:
    """``rep, number, pos, until``: every entry's place in the order of all projections, and its window's end."""
    entry = F.explode(F.arrays_zip("numbers", "values"))
    entries = places.select("rep", "dim", entry.alias("e")).select(
        "rep", "dim", F.col("e.numbers").alias("number"), F.col("e.values").alias("value"))
    marks = entries.withColumn("mark", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "value", F.when(F.col("mark") == 1, F.col("value") + F.lit(window)).otherwise(F.col("value")))
    order = [F.col(c).asc() for c in ("dim", "number", "value", "mark", "rep")]
    numbered = global_row_number(marks, order, "at")
    return numbered.groupBy("dim", "number", "rep").agg(
        F.max(F.when(F.col("mark") == 0, F.col("at"))).alias("pos"),
        F.max(F.when(F.col("mark") == 1, F.col("at"))).alias("until")).select("rep", "number", "pos", "until")


def dealt(entries: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of every task ``a, b``: entries of block ``a`` whose windows reach ``b``, and those of block ``b``."""
    cut = entries.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("last", F.floor(F.col("until") / BLOCK))
    asking = cut.select("rep", "number", "pos", "until", F.col("block").alias("a"),
                        F.explode(F.sequence("block", "last")).alias("b"))
    reach = cut.groupBy("block").agg(F.max("last").alias("last")).filter("last > block").select(
        F.col("block").alias("a"), F.explode(F.sequence(F.col("block") + 1, F.col("last"))).alias("b"))
    asked = cut.join(reach, F.col("block") == F.col("b")).select("rep", "number", "pos", "until", "a", "b")
    return asking.unionByName(asked).join(places.select("rep", "n", "numbers", "values", "unit"), "rep")


def pair_numbers(pos: np.ndarray, until: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of a task of which one lies in the other's window, in bounded portions.

    Rows are sorted by place; those of block ``a`` ask, and find later ones of block ``b``.
    """
    asking = int(np.searchsorted(pos, (a + 1) * BLOCK))
    low = np.arange(1, asking + 1) if a == b else np.full(asking, asking)
    size = np.maximum(np.searchsorted(pos, until[:asking]) - low, 0)
    ends = np.cumsum(size)
    for at in range(0, int(ends[-1]) if asking else 0, PAIRS_AT_ONCE):
        nth = np.arange(at, min(at + PAIRS_AT_ONCE, int(ends[-1])))
        x = np.searchsorted(ends, nth, side="right")
        yield x, low[x] + nth - (ends[x] - size[x])


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def linked(tasks: DataFrame, threshold: float, count: int) -> DataFrame:
    """``rep, low, links``: links found here per vector, and the smallest id of its local cluster."""
    window = window_of(threshold)

    def judge_task(part: pa.Table, counts: dict[int, int], parent: dict[int, int]) -> None:
        a, b = part.column("a")[0].as_py(), part.column("b")[0].as_py()
        rep, n, here, pos, until = (part.column(c).to_numpy() for c in ("rep", "n", "number", "pos", "until"))
        number, value = (np.array(part.column(c).to_pylist()) for c in ("numbers", "values"))
        units = part.column("unit").to_pylist()
        size = np.array([len(u) for u in units])
        for i, j in pair_numbers(pos, until, a, b):
            hits, first = collisions(number[i], value[i], number[j], value[j], window)
            passed = (hits >= count) & (first == here[i])
            i, j = i[passed], j[passed]
            near = np.zeros(len(i), bool)
            for dim in np.unique(size[i]).tolist():
                m = np.flatnonzero(size[i] == dim)
                x, y = (np.frombuffer(b"".join([units[k] for k in r[m].tolist()])).reshape(-1, dim // 8) for r in (i, j))
                near[m] = np.einsum("ij,ij->i", x, y) >= threshold
            for p, q, np_, nq in zip(rep[i[near]].tolist(), rep[j[near]].tolist(),
                                     n[i[near]].tolist(), n[j[near]].tolist()):
                counts[p] = counts.get(p, 0) + nq
                counts[q] = counts.get(q, 0) + np_
                r, s = _root(parent, p), _root(parent, q)
                if r != s:
                    parent[max(r, s)] = min(r, s)

    def judge(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        place = np.stack([table.column(c).to_numpy() for c in ("a", "b")], 1)
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)])
        counts, parent = {}, {}
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
            if end - at > 1:
                judge_task(table.slice(at, end - at), counts, parent)
        reps = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(reps, pa.int64()), pa.array([_root(parent, r) for r in reps], pa.int64()),
             pa.array([counts[r] for r in reps], pa.int64())], names=["rep", "low", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # rows are sorted: hand on whole tasks, keep the last, perhaps unfinished one
            place = np.stack([batch.column(c).to_numpy() for c in ("a", "b")], 1)
            starts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            if held:
                last = held[-1]
                before = [last.column(c)[len(last) - 1].as_py() for c in ("a", "b")]
                if before != place[0].tolist():
                    starts = np.r_[0, starts]
            if len(starts):
                cut = int(starts[-1])
                if held or cut:
                    yield judge([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield judge(held)

    return tasks.mapInArrow(run, "rep long, low long, links long")


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
               threshold: float = 0.9) -> DataFrame:
    """``id, n_links, component_id, kept``: one row per vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).withColumn(
        "ok", valid("vector") & F.col("id").isNotNull())
    good = rows.filter("ok").select("id", F.transform("vector", lambda v: v + F.lit(0.0).cast("float")).alias("vector"))
    reps = stage(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    n_axes = n_directions(reps.count())
    size = F.size("vector")
    lengths = reps.groupBy(size.alias("dim")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "dim").first()
    if lengths is None:
        tails, count = LEAST_COUNT, LEAST_COUNT
    else:  # a bounded sample of the most common length
        taken = reps.filter(size == lengths["dim"]).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vector").toArrow()
        tails, count = calibrated(rows_of(taken.column("vector").combine_chunks()), n_axes, threshold)
    places = stage(projected(reps, n_axes, tails), "projected")
    entries = stage(windows(places, window_of(threshold)), "windows")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = dealt(entries, places).repartition(n_parts, "a", "b").sortWithinPartitions("a", "b", "pos")
    found = stage(linked(tasks, threshold, count), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "low").select(F.col("node").alias("rep"), F.col("low").alias("root"))
    told = reps.join(links, "rep", "left").join(roots, "rep", "left").select(
        "vector", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "rep").alias("component"))
    members = good.join(told, "vector").select("id", "n_links", "component")
    alone = rows.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return members.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
