"""Exact, suffix and n-gram dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from llm_helpers import table

from shardwright.llm import exact_dedup, ngram_join, shingles, suffix_dedup

LAST = 1 << 62


def test_exact_dedup(docs, no_docs, rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t, *_ in rows]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    want = sorted(((d, min((x for x in groups[t] if x is not None), default=None), len(groups[t]),
                    hashlib.sha256(t.encode()).hexdigest()) for d, t in norm), key=repr)
    out = exact_dedup.exact_dedup(docs)
    assert table(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = [r for r in out.collect() if r["kept"]]
    assert len(kept) == len(groups)  # one row of each group, of a repeated row as well
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_tree_depths_agree(docs):
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    assert table(exact_dedup.exact_dedup(docs, fan_in=2, rounds=5), *columns) == \
        table(exact_dedup.exact_dedup(docs, fan_in=64, rounds=1), *columns)


def suffix_brute(rows, length=50):
    first = {}
    for d, t, *_ in rows:
        raw, d = (t or "").encode(), LAST if d is None else d
        for i in range(len(raw) - length + 1):
            first[raw[i:i + length]] = min(first.get(raw[i:i + length], LAST), d)
    out = []
    for d, t, *_ in rows:
        raw, me = (t or "").encode(), LAST if d is None else d
        gone = np.zeros(len(raw) + 1, np.int8)
        for i in range(len(raw) - length + 1):
            if first[raw[i:i + length]] < me:
                gone[i:i + length] = 1
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_dedup(docs, no_docs, rows):
    assert table(suffix_dedup.suffix_dedup(docs), *COLUMNS) == suffix_brute(rows)
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0


def test_suffix_dedup_short_overlaps(spark):
    rnd = np.random.default_rng(3)
    base = "".join(rnd.choice(list("abcde fgh"), 900))
    rows = [(1, base)]
    for k in range(40):  # pieces around the limit, overlapping, inside other text
        a, n, b = int(rnd.integers(0, 700)), int(rnd.integers(44, 120)), int(rnd.integers(0, 700))
        rows.append((2 + k, f"<{k}>{base[a:a + n]}[{k}]{base[b:b + int(rnd.integers(49, 52))]}{base[a + 3:a + n]}"))
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert table(out, *COLUMNS) == suffix_brute(rows)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingle_set(text):
    w = words_of(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_brute(texts):
    """Size and component (smallest position) of every text."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(len(s), root(k)) for k, s in enumerate(sets)]


def test_jaccard_join(docs, no_docs, rows):
    brute = jaccard_brute([t for _, t, *_ in rows])
    members = defaultdict(list)
    for (d, *_), (_, c) in zip(rows, brute):
        members[c].append(d)
    want = sorted(((d, n, min((x for x in members[c] if x is not None), default=None))
                   for (d, *_), (n, c) in zip(rows, brute)), key=repr)
    assert table(ngram_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == want
    assert ngram_join.jaccard_join(no_docs).count() == 0


def test_jaccard_join_around_the_threshold(spark):
    rnd = np.random.default_rng(8)
    base = [f"w{k}" for k in range(260)]
    texts = []
    for k in range(70):  # edits that leave some pairs just above and some just below 0.8, and chains between them
        w = list(base)
        for _ in range(int(rnd.integers(0, 9))):
            w[int(rnd.integers(0, len(w)))] = f"edit{k}_{rnd.integers(1 << 30)}"
        texts.append(" ".join(w[:int(rnd.integers(230, 261))]))
    brute = jaccard_brute(texts)
    out = ngram_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert table(out, "doc_id", "n_shingles", "component_id") == sorted(
        ((k, n, c) for k, (n, c) in enumerate(brute)), key=repr)
    assert 1 < len(Counter(c for _, c in brute)) < 70


def test_divide_skip_finds_every_partner():
    rnd = np.random.default_rng(1)
    sets = []
    for k in range(120):
        core = rnd.permutation(400)[:int(rnd.integers(60, 90))] + (k % 4) * 400
        sets.append(np.unique(np.concatenate([core if k % 3 else np.arange(70) + (k % 4) * 400, rnd.integers(5000, 9000, k % 9)])))
    lists = ngram_join.InvertedLists(sets)
    for s in sets:
        want = [k for k, t in enumerate(sets) if ngram_join.links(len(np.intersect1d(s, t)), len(s), len(t))]
        assert lists.search(s).tolist() == want


def test_shingles_do_not_cross_texts_or_depend_on_slices():
    import pyarrow as pa

    texts = ["a b c d e f", "g h", "", "A b  c\nd e F", "g H", "c d e f g h", "é è ü à ö 😀"]
    alone = [list(shingles.shingle_sets(pa.array([t])))[0][1].tolist() for t in texts]
    together = [s.tolist() for _, s in shingles.shingle_sets(pa.array(texts))]
    assert alone == together == [s.tolist() for _, s in shingles.shingle_sets(pa.chunked_array([["x"], texts]).combine_chunks()[1:])]
    assert together[0] == together[3] and together[1] == together[4] and together[2] == []


def test_sifting_parts_are_bounded():
    """A batch's sifting shingles come in parts, each node once, and hold on to no whole set."""
    texts = [" ".join(f"w{k}_{i}" for i in range(204)) for k in range(40)]
    sets = [s for _, s in ngram_join.shingle_sets(pa.array(texts))]
    length = ngram_join.sift_length(200)
    parts = list(ngram_join.sifting_parts(pa.array(texts + texts[:5]), most=3 * length))
    assert [len(h) for h, _ in parts] == [3 * length] * 13 + [length]
    assert all(h.base is None for h, _ in parts)
    assert np.array_equal(np.concatenate([h for h, _ in parts]), np.concatenate([s[:length] for s in sets]))
    nodes = [ngram_join.signature(s)[0] for s in sets]
    assert np.concatenate([o for _, o in parts]).tolist() == np.repeat(nodes, length).tolist()


def test_counts_do_not_depend_on_the_parts(spark):
    """Shingles that texts of one batch but of different parts share are counted as those within a part."""
    base = [" ".join(f"w{k}_{i}" for i in range(60)) for k in range(30)]
    docs = spark.createDataFrame([(t,) for t in base + [t + " more" for t in base]], "text string").coalesce(1)
    whole, cut = (table(ngram_join.sifted(docs, 3, most), "node", "seen") for most in (1 << 30, 20))
    assert whole == cut
    assert len(whole) == 60
