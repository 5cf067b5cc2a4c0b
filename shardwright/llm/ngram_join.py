"""N-gram Jaccard join: T-occurrence search with DivideSkip, exact at 0.8.

Documents are sets of five-word shingles.  Equal sets become one *node*.  Two
sets that link have an overlap of at least ``T = ceil(0.8 n)`` with n the size
of either; all steps follow from that bound and lose no link.

1. *Sift.*  In hash order, two linked sets share at least ``l`` of their first
   ``n - T + l`` shingles.  Only these travel, as arrays dealt by hash; a node
   of whose ones too few occur in any other node links with nothing.  A part of
   a batch sends a shingle once however many of its texts hold it.
2. *Route.*  Among the nodes left, shingles are ordered from rare to common.
   Linked sets share one of their first ``n - T + 1``, so connecting nodes that
   share one of these gives groups that no link leaves; common passages lie
   behind the prefix and connect nothing.
3. *Leader.*  In each group all nodes are compared with its leader, row by row.
   Nodes that link with it belong together and need not be compared again.
4. *T-occurrence.*  The other nodes are the queries, against all nodes of their
   group.  Groups are cut into blocks; a block of queries meets every block of
   the index in a task of its own.  There the inverted lists of a query's
   shingles are divided: the short ones are merged and counted, nodes with
   enough occurrences are probed in the long ones by binary search, and nodes
   that reach the required overlap are linked (Jaccard checked on the exact
   overlap).

Pairs are never written: a task returns edges of local clusters, and
components follow by star contraction.

Nulls and empties: a null or wordless text has an empty set, links with nothing
and is its own component.  Null ids never become a component's id unless alone.
Repeated rows are documents of their own.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import stage
from .shingles import mixed, shingle_sets, signature

TOP, BOTTOM = 80, 100  # the threshold as a fraction
BUCKET_SHINGLES = 1_000_000
PART_SHINGLES = 250_000  # sifting shingles that a task deals together, and at most one set more
BLOCK = 512
SKIP_WEIGHT = 0.01


def needed(n):
    """Least overlap of a set of ``n`` with any set it links with."""
    return -(-TOP * n // BOTTOM)


def links(overlap, n, m):
    return BOTTOM * overlap >= TOP * (n + m - overlap)


def sift_length(n: int) -> int:
    """Shingles of the sifting prefix of a set of ``n``: l is a tenth of n."""
    return n - needed(n) + -(-n // 10)


def sift_needed(n: int) -> int:
    """Occurrences elsewhere without which a set links with nothing: l of the smallest partner."""
    return -(-needed(n) // 10)


def nodes_of(docs: DataFrame) -> DataFrame:
    """``doc_id, row, n, node, check``: size and signature of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *signature(s)) for _, s in shingle_sets(batch.column("text"))]
            n, node, check = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), *(pa.array(c, pa.int64()) for c in (n, node, check))],
                names=["doc_id", "row", "n", "node", "check"])

    return docs.mapInArrow(run, "doc_id long, row long, n long, node long, check long")


def sifting_parts(texts: pa.Array, most: int = PART_SHINGLES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sifting shingles and their nodes, each node of the texts once; a part ends with the set that reaches ``most``."""
    hashes, owners, size, known = [], [], 0, set()
    for _, s in shingle_sets(texts):
        node = signature(s)[0]
        if len(s) and node not in known:
            known.add(node)
            hashes.append(s[:sift_length(len(s))].copy())  # a view would keep the whole set
            owners.append(node)
            size += len(hashes[-1])
        if size >= most:
            yield np.concatenate(hashes), np.repeat(np.array(owners, np.int64), [len(one) for one in hashes])
            hashes, owners, size = [], [], 0
    if hashes:
        yield np.concatenate(hashes), np.repeat(np.array(owners, np.int64), [len(one) for one in hashes])


def sifted(docs: DataFrame, n_buckets: int, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """``node, seen``: how many of the node's sifting shingles occur in another node."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for number, (h, o) in enumerate(part for batch in batches for part in sifting_parts(batch.column("text"), part_shingles)):
            order = np.argsort(h)
            h, o = h[order], o[order]
            fresh = np.concatenate(([True], h[1:] != h[:-1]))
            group = np.cumsum(fresh) - 1
            many = np.bincount(group) > 1
            seen_here = many[group]
            # of a shingle that several nodes of the part hold, one row goes on as a witness
            nodes, seen = np.unique(o[seen_here], return_counts=True)
            out = [(-1 - task - number, b"", nodes.tobytes(), seen.astype(np.int64).tobytes())]
            h, o, witness = h[fresh], o[fresh], many
            bucket = (h % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((o, bucket))
            h, o, witness, bucket = h[order], o[order], witness[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(h)].tolist()):
                own = np.where(witness[a:b], 0, o[a:b])
                out.append((int(bucket[a]), h[a:b].tobytes(), own.tobytes(), witness[a:b].tobytes()))
            b, h, o, w = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int64()), *(pa.array(c, pa.binary()) for c in (h, o, w))],
                names=["bucket", "hashes", "nodes", "marks"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = np.frombuffer(b"".join(rows["nodes"]), np.int64)
        if rows["bucket"].iloc[0] < 0:  # counts within parts
            seen = np.frombuffer(b"".join(rows["marks"]), np.int64)
        else:
            hashes = np.frombuffer(b"".join(rows["hashes"]), np.uint64)
            witness = np.frombuffer(b"".join(rows["marks"]), bool)
            order = np.lexsort((nodes, hashes))
            hashes, nodes, witness = hashes[order], nodes[order], witness[order]
            fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            group = np.cumsum(fresh) - 1
            starts = np.flatnonzero(fresh)
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (nodes[1:] != nodes[:-1])))
            others = np.add.reduceat(new & ~witness, starts) > 1
            told = others | np.logical_or.reduceat(witness, starts)
            nodes = nodes[new & ~witness & told[group]]
            seen = np.ones(len(nodes), np.int64)
        nodes, seen = summed(nodes, seen)
        # handed on in parts by node, not node by node: buckets times parts, however many nodes there are
        part = (mixed(nodes.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        nodes, seen, part = nodes[order], seen[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        edges = list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(part)].tolist())) if len(part) else []
        return pd.DataFrame({"part": np.array([part[a] for a, _ in edges], np.int64),
                             "nodes": [nodes[a:b].tobytes() for a, b in edges],
                             "seen": [seen[a:b].tobytes() for a, b in edges]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, seen = summed(np.frombuffer(b"".join(rows["nodes"]), np.int64), np.frombuffer(b"".join(rows["seen"]), np.int64))
        return pd.DataFrame({"node": nodes, "seen": seen})

    dealt = docs.mapInArrow(deal, "bucket long, hashes binary, nodes binary, marks binary")
    counted = dealt.groupBy("bucket").applyInPandas(count, "part long, nodes binary, seen binary")
    return counted.groupBy("part").applyInPandas(total, "node long, seen long")


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, values, len(distinct)).astype(np.int64)


def sets_of(docs: DataFrame) -> DataFrame:
    """``node, n, tokens``: whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(signature(s)[0], len(s), s.view(np.int64)) for _, s in shingle_sets(batch.column("text"))]
            for a in range(0, len(rows), 512):
                node, n, tokens = zip(*rows[a:a + 512])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(list(tokens), pa.list_(pa.int64()))],
                    names=["node", "n", "tokens"])

    return docs.mapInArrow(run, "node long, n long, tokens array<long>")


def routes(sets: DataFrame) -> DataFrame:
    """``node, low``: groups of nodes that share a shingle of their rare-first prefix."""
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    listed = tokens.join(common, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common")).join(sets.select("node", "n"), "node")
    # shingles of no other node come first in the order from rare to common
    unique = F.col("n") - F.size("common")
    reach = F.col("n") - F.ceil(F.col("n") * TOP / BOTTOM) + 1 - unique
    prefix = listed.filter(reach > 0).select(
        "node", F.explode(F.slice(F.col("common.token"), F.lit(1), reach.cast("int"))).alias("token"))
    prefix = stage(prefix, "prefixes")
    first = prefix.groupBy("token").agg(F.min("node").alias("other"))
    return components(prefix.join(first, "token").select("node", "other").filter("node <> other"), "node", "other")


def against_leader(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """``route, node, led``: whether a node links with its group's leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            led = []
            for n, m, a, b in zip(*(batch.column(c) for c in ("n", "m", "tokens", "leader"))):
                overlap = len(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True))
                led.append(links(overlap, n.as_py(), m.as_py()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("route"), batch.column("node"), pa.array(led, pa.bool_())], names=["route", "node", "led"])

    return members.join(leaders, "route").filter(
        f"{BOTTOM} * least(n, m) >= {TOP} * greatest(n, m)").select(
        "route", "node", "n", "m", "tokens", "leader").mapInArrow(run, "route long, node long, led boolean")


class InvertedLists:
    """Inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(tokens, kind="stable")  # owners ascend within a list
        self.owner = owner[order]
        self.tokens, self.start = np.unique(tokens[order], return_index=True)
        self.stop = np.append(self.start[1:], len(tokens))

    def search(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the sets that link with ``query``, by DivideSkip."""
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        least = needed(len(query))
        if len(at) < least:
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.stop[at] - self.start[at], kind="stable")]
        longest = int(self.stop[at[-1]] - self.start[at[-1]])
        n_long = min(least - 1, int(least / (SKIP_WEIGHT * math.log2(longest + 1) + 1)))
        short, long_ = (at[:-n_long], at[-n_long:]) if n_long else (at, at[:0])
        merged = np.concatenate([self.owner[a:b] for a, b in zip(self.start[short].tolist(), self.stop[short].tolist())])
        found = np.bincount(merged, minlength=len(self.n))
        able = np.flatnonzero(found >= least - n_long)
        able = able[(BOTTOM * self.n[able] >= TOP * len(query)) & (BOTTOM * len(query) >= TOP * self.n[able])]
        count = found[able]
        for left, k in zip(range(n_long, 0, -1), long_.tolist()):
            ok = count + left >= least
            if not ok.all():
                able, count = able[ok], count[ok]
            if not len(able):
                break
            one = self.owner[self.start[k]:self.stop[k]]
            probe = np.minimum(np.searchsorted(one, able), len(one) - 1)
            count = count + (one[probe] == able)
        return able[links(count, len(query), self.n[able])]


def occurrence_search(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges between the queries and the index nodes of one task."""
    index, queries = rows[~rows["query"]], rows[rows["query"]]
    if not len(index) or not len(queries):
        return pd.DataFrame({"node": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)})
    lists, nodes = InvertedLists([np.asarray(t) for t in index["tokens"]]), index["node"].to_numpy()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for node, tokens in zip(queries["node"].tolist(), queries["tokens"]):
        for other in nodes[lists.search(np.asarray(tokens))].tolist():
            a, b = root(node), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    edges = [(x, root(x)) for x in list(parent) if root(x) != x]
    return pd.DataFrame(edges, columns=["node", "low"], dtype=np.int64)


def joined(sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """``node, low``: edges that connect linked nodes."""
    route = grouped.select("node", F.col("low").alias("route"))
    all_routes = route.unionByName(route.select(F.col("route").alias("node"), "route").distinct())
    members = stage(sets.dropDuplicates(["node"]).join(all_routes, "node"), "members")
    leaders = members.filter("node = route").select("route", F.col("n").alias("m"), F.col("tokens").alias("leader"))
    led = stage(against_leader(members.filter("node <> route"), leaders).filter("led"), "led")
    rest = members.filter("node <> route").join(led.select("node"), "node", "left_anti")
    sizes = members.groupBy("route").agg(F.count(F.lit(1)).alias("g"))
    blocks = stage(rest.groupBy("route").agg(F.count(F.lit(1)).alias("q")).join(sizes, "route").select(
        "route", F.ceil(F.col("g") / BLOCK).cast("int").alias("index"),
        F.ceil(F.col("q") / BLOCK).cast("int").alias("queries")), "blocks")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row to the block of its own kind that its hash names, beside every block of the other kind."""
        return rows.join(blocks, "route").select(
            "route", "node", "tokens", F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_block"),
            F.lit(own == "queries").alias("query"))

    tasks = dealt(members, "index", "queries").unionByName(dealt(rest, "queries", "index"))
    found = tasks.groupBy("route", "index_block", "queries_block").applyInPandas(
        occurrence_search, "node long, low long")
    return found.unionByName(led.select("node", F.col("route").alias("low")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 row_col: str | None = None) -> DataFrame:
    """``id, n_shingles, component_id`` (and the row number ``row_col``): one row per document."""
    numbered = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.col(row_col) if row_col else F.lit(0).cast("long")).alias("row"))
    texts = numbered.select("doc_id", "text")
    by_doc = stage(nodes_of(numbered), "nodes")
    nodes = by_doc.filter("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("first"))
    total = by_doc.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-3 * total // (10 * BUCKET_SHINGLES)))
    seen = sifted(texts, n_buckets)
    enough = F.ceil(F.ceil(F.col("n") * TOP / BOTTOM) / 10)
    left = stage(nodes.join(seen, "node").filter(F.col("seen") >= enough).select("node", "first"), "sifted")
    # nothing bounds the ids that are left, so they are never broadcast: one plan at every size
    ids = left.select(F.col("first").alias("id")).distinct().hint("merge")
    sets = sets_of(texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"))
    sets = stage(sets.join(left.select("node"), "node", "left_semi"), "sets")
    edges = joined(sets, routes(sets))
    roots = stage(components(edges, "node", "low"), "roots")
    told = nodes.join(roots, "node", "left").select("node", F.coalesce("low", "node").alias("root"), "first")
    smallest = told.groupBy("root").agg(F.min("first").alias("component"))
    named = told.join(smallest, "root").select("node", "component")
    full = by_doc.filter("n > 0").join(named, "node").select("doc_id", "row", "n", "component")
    empty = by_doc.filter("n = 0").select("doc_id", "row", "n", F.col("doc_id").alias("component"))
    return full.unionByName(empty).select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        *([F.col("row").alias(row_col)] if row_col else []))
