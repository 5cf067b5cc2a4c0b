"""Embedding near-dedup against brute force, and its recall at the threshold."""

import math

import numpy as np
from llm_helpers import table

from shardwright.llm import near_vectors
from shardwright.llm.components import components


def vectors():
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal((60, 32))
    rows = [(k, v) for k, v in enumerate(base)]
    for k in range(80):
        v = base[k % 9] + rnd.standard_normal(32) * rnd.choice([0.0, 0.1, 0.3, 0.45])
        rows.append((100 + k, v * rnd.choice([1.0, 7.0])))
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    rows += [(300, None), (301, [0.0] * 32), (302, [math.nan] * 32), (303, [1.0] * 31 + [None]), (304, []),
             (305, [math.inf] + [0.0] * 31), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (None, rows[0][1]), rows[3]]
    return rows


def brute(rows):
    ok = [k is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for k, v in rows]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.9 - 1e-12:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    smallest = {}
    for k in range(n):
        if rows[k][0] is not None:
            smallest[root(k)] = min(smallest.get(root(k), 1 << 60), rows[k][0])
    return sorted(((r[0], links[k], smallest.get(root(k)) if r[0] is not None else None,
                    r[0] is None or r[0] == smallest.get(root(k))) for k, r in enumerate(rows)), key=repr)


def test_near_vectors(spark):
    rows = vectors()
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<float>, rep string, n int")
    got = table(near_vectors.near_dedup(frame), "vec_id", "n_links", "component_id", "kept")
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.97 * there <= found <= there  # links are verified, so there are none too many
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.95
    assert near_vectors.near_dedup(frame.limit(0)).count() == 0


def test_recall_at_the_threshold_is_calibrated():
    sample = np.random.default_rng(4).standard_normal((1500, 64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    partner = near_vectors.partners(sample, 0.9, seed=9)
    assert np.allclose((sample * partner).sum(1), 0.9)
    for n in (500, 50_000):
        axes = near_vectors.n_directions(n)
        tails, count = near_vectors.calibrated(sample, axes, 0.9)
        found = near_vectors.collisions(*near_vectors.tails_of(sample, axes, tails),
                                        *near_vectors.tails_of(partner, axes, tails), near_vectors.window_of(0.9))[0]
        assert count >= near_vectors.LEAST_COUNT and (found >= count).mean() >= 0.95


def test_tails_in_slices_equal_those_of_all_directions_at_once():
    unit = np.random.default_rng(6).standard_normal((50, 8))
    axes = np.concatenate([near_vectors.directions(8, at, near_vectors.SLICE) for at in range(0, 2048, near_vectors.SLICE)], 1)
    number, value = near_vectors.tails_of(unit, 2048, 7)
    p = unit @ axes
    for k in range(50):
        best = np.sort(np.argsort(-np.abs(p[k]))[:7])
        assert number[k].tolist() == [2 * int(j) + int(p[k, j] < 0) for j in best]
        assert np.allclose(value[k], np.abs(p[k, best]))


def test_pairs_of_windows_over_block_borders(monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 7)
    monkeypatch.setattr(near_vectors, "PAIRS_AT_ONCE", 5)
    rnd = np.random.default_rng(3)
    pos = np.sort(rnd.choice(100, 40, replace=False))
    until = pos + rnd.integers(1, 30, 40)
    got = []
    for a in range(15):
        for b in range(a, 15):
            rows = np.flatnonzero(((pos // 7 == a) & (until // 7 >= b)) | (pos // 7 == b))
            for x, y in near_vectors.pair_numbers(pos[rows], until[rows], a, b):
                got += list(zip(rows[x].tolist(), rows[y].tolist()))
    want = [(i, j) for i in range(40) for j in range(i + 1, 40) if pos[j] < until[i]]
    assert sorted(got) == want


def test_planted_pairs_near_the_threshold_and_a_large_cluster(spark):
    rnd = np.random.default_rng(8)
    base = rnd.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = near_vectors.partners(base[:400], 0.91, seed=3)
    crowd = base[1400] + 0.02 * rnd.standard_normal((700, 64)) / 8
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, near, crowd]))]
    got = {r["vec_id"]: r for r in near_vectors.near_dedup(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert np.mean([got[1500 + k]["component_id"] == k for k in range(400)]) >= 0.95
    assert all(got[k]["n_links"] == 700 and got[k]["component_id"] == 1400 for k in [1400, *range(1900, 2600)])
    assert all(got[k]["n_links"] == 0 for k in range(400, 1400))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000 + k, 2000) for k in range(50)] + [(5, 5)]
    got = dict(table(components(spark.createDataFrame(edges, "a long, b long"), "a", "b"), "node", "low"))
    assert got == {k: 0 for k in range(1, 301)} | {k: 1000 for k in [*range(1001, 1050), 2000]}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
