"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

A turn is named by the SHA-256 of its role and text, a conversation by the names
of its turns in a row, 32 bytes each; texts themselves are read once and not
shuffled.  Conversations are sorted by that string and their id and cut into
ranges, so a group of equal conversations is cut like any other.  Within a range
the neighbours' longest common prefixes (in turns) are edges; taken in descending
depth, every round of merges at one depth makes the node of that depth, and the
nodes between it and the nodes below are written as its members' unbranched path.

Each range also sees the last string before it and the first one after it.  The
nodes that reach over a range's ends are prefixes of these strings: the forest of
a range contracts to them.  Everything a node counts is a sum over its members
and the edges between them (an edge between ranges counts in the left one), so
the contracted forests merge by adding up the rows of equal prefixes, however
many ranges a node spans.  The ids that end at such a node are hashed in a stream,
range after range.

Results for odd input: turns are ordered by ``turn``, null first, equal
ones by their names; null role or text is empty; repeated rows are repeated turns.  Rows
without a conversation id belong to no conversation and are left out.  A
conversation without turns is a member of the root.  No conversations, no
nodes.  A conversation's names, 32 bytes a turn, are one row, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage

NAME = 32  # bytes of a turn's name
TURNS_PER_RANGE = 100_000
CLOSED, OPEN, ENDS = range(3)
AHEAD, BEHIND = 1, -1
SCHEMA = pa.schema([
    ("kind", pa.int32()), ("part", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
    ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("edges", pa.int64()), ("above", pa.int64()), ("ends", pa.string())])
DDL = ("kind int, part long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
       "n_convs long, n_children long, n_leaves long, edges long, above long, ends string")
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: an array of (turn, name, chars) per conversation, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), name.alias("name"), F.length(text).alias("chars"))
    ids = F.col("conv_id").cast("long").alias("conv_id")
    named = conversations.filter("conv_id IS NOT NULL").select(ids, turn.alias("t"))
    return named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuild(lists: DataFrame, family: int = 100, most_shared: int = 6) -> DataFrame:
    """Every conversation starts with the first turns of the first one of its family, as many as its id's CRC-32 says."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("int")
    heads = lists.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("first_id"), F.slice("turns", 1, most_shared - 1).alias("head"))
    joined = lists.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % family).join(heads, "first_id", "left")
    head = F.coalesce(F.col("head"), F.slice("turns", 1, 0))
    own = F.slice(F.col("turns"), shared + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(F.slice(head, F.lit(1), shared), own).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Length of the common prefix in whole names."""
    low, high = 0, min(len(a), len(b)) // NAME
    while low < high:
        middle = (low + high + 1) // 2
        if a[:NAME * middle] == b[:NAME * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def prefix_keys(string: bytes, depth: int) -> list[bytes]:
    """Digests of the prefixes of 0 to ``depth`` names."""
    running, keys = hashlib.sha256(), []
    for k in range(depth + 1):
        keys.append(running.copy().digest())
        running.update(string[NAME * k:NAME * (k + 1)])
    return keys


@dataclass(slots=True)
class Component:
    """Neighbouring strings, joined down to the depth of their node."""

    start: int
    stop: int
    top: int  # depth of the node
    ending: int  # strings that end at the node: the first ones
    children: int
    least: int  # id
    leaves: int
    edges: int  # code points above the ends of the edges, summed


class Forest:
    """The trie of one range of sorted strings; ``rows`` gathers its nodes."""

    def __init__(self, part: int, strings: list[bytes], ids: list[int], chars: list[np.ndarray],
                 behind: bytes | None, ahead: bytes | None):
        self.part, self.ids, self.last = part, ids, len(ids) - 1
        self.lengths = [len(s) // NAME for s in strings]
        self.sums = [np.concatenate(([0], np.cumsum(c, dtype=np.int64))).tolist() for c in chars]  # down a path from the root
        self.before = -1 if behind is None else common_turns(behind, strings[0])
        self.after = -1 if ahead is None else common_turns(strings[-1], ahead)
        self.left_keys = prefix_keys(strings[0], self.before)
        self.right_keys = prefix_keys(strings[-1], self.after)
        self.common = [common_turns(a, b) for a, b in zip(strings, strings[1:])]
        self.rows: list[tuple] = []
        self._grow()

    def _find(self, k: int) -> int:
        root = k
        while self.up[root] != root:
            root = self.up[root]
        while self.up[k] != root:
            self.up[k], k = root, self.up[k]
        return root

    def _grow(self) -> None:
        self.up = list(range(len(self.ids)))
        made = [Component(k, k + 1, length, 1, 0, i, int(common < length), 0) for k, (length, i, common) in
                enumerate(zip(self.lengths, self.ids, [*self.common, self.after]))]
        by_depth: dict[int, list[int]] = {0: []}
        for k, depth in enumerate(self.common):
            by_depth.setdefault(depth, []).append(k)
        for depth in sorted(by_depth, reverse=True):
            merged: dict[int, list[Component]] = {}
            edges: dict[int, int] = {}
            for k in by_depth[depth]:
                a, b = self._find(k), self._find(k + 1)
                self.up[b] = a
                merged[a] = merged.pop(a, [made[a]]) + merged.pop(b, [made[b]])
                edges[a] = edges.get(a, 0) + edges.pop(b, 0) + self.sums[k][depth]
            if depth == 0 and not merged:  # all strings share their first turn, or there is one
                merged = {0: [made[0]]}
            for root, parts in merged.items():
                made[root] = self._node(depth, parts, edges.get(root, 0))
        self._write(made[0], 0, None)

    def _node(self, depth: int, parts: list[Component], edges: int) -> Component:
        """The node that joins ``parts``; writes the paths from it down to their nodes."""
        below = [p for p in parts if p.top > depth]
        node = Component(
            parts[0].start, parts[-1].stop, depth, sum(p.ending for p in parts if p.top == depth), len(below),
            min(p.least for p in parts), sum(p.leaves for p in parts), edges + sum(p.edges for p in parts))
        for p in below:
            for k in range(p.top, depth + 1, -1):
                self._write(p, k, p)
            self._write(p, depth + 1, node)
        return node

    def _open(self, c: Component, depth: int) -> bytes | None:
        """Key of the component's node of a depth, if it reaches over an end of the range."""
        if c.start == 0 and depth <= self.before:
            return self.left_keys[depth]
        if c.stop > self.last and depth <= self.after:
            return self.right_keys[depth]
        return None

    def _write(self, c: Component, depth: int, parent: Component | None) -> None:
        """A node whose members are those of ``c``."""
        key, parent_key = self._open(c, depth), self._open(parent, depth - 1) if parent else None
        ending = self.ids[c.start:c.start + c.ending] if depth == c.top else []
        children, edges = c.children if depth == c.top else 1, c.edges
        if c.stop > self.last and depth <= self.after:  # the edge to the next range
            edges += self.sums[self.last][self.after]
            children -= depth < self.after
        ends = ",".join(map(str, ending))
        if key is not None and ending:
            self.rows.append((ENDS, self.part, key, *[None] * 9, ends))
        ends = None if key else hashlib.sha256(ends.encode()).hexdigest()
        known = parent.least if parent and not parent_key else None
        self.rows.append((OPEN if key else CLOSED, self.part, key, parent_key, c.least, depth, known, c.stop - c.start,
                          children, c.leaves, edges, self.sums[c.start][depth - 1] if depth else 0, ends))


def range_trie(part: int, table: pa.Table) -> pa.Table:
    """Nodes of one range: closed ones, the open ones' sums, and the ids that end at open ones."""
    strings, ids, kinds = (table.column(c).to_pylist() for c in ("string", "conv_id", "side"))
    behind = next((s for s, k in zip(strings, kinds) if k == BEHIND), None)
    ahead = next((s for s, k in zip(strings, kinds) if k == AHEAD), None)
    own = sorted((s, i, k) for k, (s, i, side) in enumerate(zip(strings, ids, kinds)) if side == 0)
    if not own:
        return SCHEMA.empty_table()
    chars = table.column("chars").combine_chunks()
    offsets, values = chars.offsets.to_numpy(), chars.values.to_numpy()
    sums = [values[offsets[k]:offsets[k + 1]] for _, _, k in own]
    forest = Forest(part, [s for s, _, _ in own], [i for _, i, _ in own], sums, behind, ahead)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*forest.rows), SCHEMA)], schema=SCHEMA)


def ranges_of(lists: DataFrame, turns_per_range: int) -> DataFrame:
    """``part, string, conv_id, chars, side``: sorted ranges, each with its neighbours' nearest strings."""
    strings = stage(lists.select(
        "conv_id", F.unhex(F.array_join(F.col("turns.name"), "")).alias("string"), F.col("turns.chars").alias("chars")), "strings")
    turns = strings.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("chars")), F.lit(0))).first()[0]
    cut = strings.repartitionByRange(max(1, -(-turns // turns_per_range)), "string", "conv_id")
    cut = stage(cut.select(F.spark_partition_id().cast("long").alias("part"), "string", "conv_id", "chars"), "ranges")
    ends = cut.groupBy("part").agg(F.min("string").alias("first"), F.max("string").alias("last"))
    none = F.lit(None)
    ahead = ends.select((F.col("part") - 1).alias("part"), F.col("first").alias("string"), F.lit(AHEAD).alias("side"))
    behind = ends.select((F.col("part") + 1).alias("part"), F.col("last").alias("string"), F.lit(BEHIND).alias("side"))
    near = ahead.union(behind).select("part", "string", none.cast("long").alias("conv_id"), none.cast("array<int>").alias("chars"), "side")
    return cut.withColumn("side", F.lit(0)).unionByName(near)


def hash_ends(rows: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the ids that end at an open node, hashed range after range in one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256(ends.encode())
                else:
                    running.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())],
                                             names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()], pa.string())],
                                             names=["key", "ends_sha256"])

    return rows.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(lists: DataFrame, turns_per_range: int = TURNS_PER_RANGE) -> DataFrame:
    """One row per node of the trie of ``conv_id, turns`` (see ``turn_lists``)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return range_trie(key[0].as_py(), table)

    nodes = stage(ranges_of(lists, turns_per_range).groupBy("part").applyInArrow(run, DDL), "nodes")
    opened = nodes.filter(F.col("kind") == OPEN)
    merged = opened.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "edges")], F.first("above").alias("above"))
    merged = stage(merged, "merged")
    least = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above_id"))
    hashed = hash_ends(nodes.filter(F.col("kind") == ENDS).select("key", "part", "ends"))
    joined = merged.join(least, "parent_key", "left").join(hashed, "key", "left").withColumn(
        "ends", F.coalesce("ends_sha256", F.lit(NOTHING))).withColumn("parent_conv_id", F.col("above_id"))
    closed = nodes.filter(F.col("kind") == CLOSED)
    # a range asks for the open nodes above its own, so a node with many children is asked for range by range
    asked = opened.select("part", F.col("key").alias("parent_key")).join(least, "parent_key")
    below = closed.filter("parent_key IS NOT NULL").join(asked, ["part", "parent_key"]).withColumn("parent_conv_id", F.col("above_id"))
    inner = closed.filter("parent_key IS NULL")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "edges", "above", "ends"]
    every = joined.select(out).unionByName(below.select(out)).unionByName(inner.select(out))
    saved = F.col("edges") - (F.col("n_convs") - 1) * F.col("above")
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL of the trie of the rebuilt conversations, by grouping whole prefixes."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"""
WITH turns AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                       ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', role, text))) AS own
  FROM {table} WHERE conv_id IS NOT NULL GROUP BY 1),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
                            lambda c, b: {bits}), 4294967295) % 6 AS h FROM turns),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS s
  FROM hashed a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (SELECT conv_id, s[1:d] AS p, d, len(s) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS chars
  FROM nodes LEFT JOIN children USING (p)),
up AS (
  SELECT p[1:a] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM full_nodes v JOIN up USING (p) LEFT JOIN nodes q ON v.d > 0 AND q.p = v.p[1:v.d - 1]
"""
