"""The trie against a plain one, over ranges of all sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from llm_helpers import table
from pyspark.sql import functions as F

from shardwright.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(sequences):
    """Nodes of ``conv_id -> list of (role, text)`` by their prefixes."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                children[tuple(turns[:d - 1])].add(turns[d - 1])
        ends[tuple(turns)].append(conv)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children[p]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=repr)


def plain_lists(rows):
    lists = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            name = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            lists[conv].append((turn is not None, turn or 0, name, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in lists.items()}


def plain_rebuild(lists):
    out = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = lists.get(c - c % 100, [])[:h] + own[h:]
    return out


def conversations():
    rnd, rows = random.Random(5), []
    for c in range(230):
        for k in range(rnd.randrange(1, 7)):
            rows.append((c, k, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "ç😀", ""])))
    for c in range(1000, 1120):  # copies, more than a range holds
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "again"), (c, 2, "user", "and again")]
    rows += [(2003, k, "user", f"turn {k % 5}") for k in range(150)]  # long ones that part late, in a family of none
    rows += [(2004, k, "user", f"turn {k % 5}" if k < 140 else "else") for k in range(145)]
    rows += [(3001, None, None, None), (3001, 0, "user", None), (3002, None, "", ""), (3002, 0, "user", "x")]
    rows += [(0, 0, "user", "a"), (0, 0, "user", "a"), (None, 0, "user", "nobody"), (5001, 0, "user", "short")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return conversations()


@pytest.fixture(scope="module")
def frame(spark, rows):
    clashing = {c: F.lit("other") for c in ("turns", "key", "part", "head", "string", "depth", "t", "first_id")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clashing)


@pytest.mark.parametrize("per_range", [3, 40, 100_000])
def test_rebuilt_conversations(frame, rows, per_range):
    lists = prefix_trie.rebuild(prefix_trie.turn_lists(frame))
    assert table(prefix_trie.prefix_trie(lists, per_range), *COLUMNS) == plain_trie(plain_rebuild(plain_lists(rows)))


@pytest.mark.parametrize("per_range", [1, 11])
def test_conversations_as_they_are(frame, rows, per_range):
    lists = prefix_trie.turn_lists(frame.filter("conv_id < 60 OR conv_id > 1090"))
    wanted = {c: t for c, t in plain_lists(rows).items() if c < 60 or c > 1090}
    assert table(prefix_trie.prefix_trie(lists, per_range), *COLUMNS) == plain_trie(wanted)


def test_sql_agrees(frame, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.oracle()})").fetchall()
    assert sorted(map(tuple, got), key=repr) == plain_trie(plain_rebuild(plain_lists(rows)))


def test_one_forest_cut_anywhere():
    rnd = random.Random(8)
    names = [hashlib.sha256(bytes((k,))).digest() for k in range(3)]
    for _ in range(100):
        lists = {c: [rnd.choice(names) for _ in range(rnd.randrange(5))] for c in range(rnd.randrange(1, 12))}
        order = sorted((b"".join(v), c) for c, v in lists.items())
        forest = prefix_trie.Forest(0, [s for s, _ in order], [c for _, c in order], [[7] * (len(s) // 32) for s, _ in order], None, None)
        got = [(r[4], r[5], r[6], r[7], r[8], r[9], r[10] - (r[7] - 1) * r[11], r[12]) for r in forest.rows]
        assert sorted(got, key=repr) == plain_trie({c: [(n, "7 chars") for n in v] for c, v in lists.items()})


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(prefix_trie.rebuild(prefix_trie.turn_lists(empty))).collect() == []
