"""Whitening and nearest neighbours against numpy over all rows in one piece."""

import math

import numpy as np
import pytest

from postroom.llm import neighbours, vectors, whitening

VECTORS = "vec_id long, embedding array<float>, row string, leaf int"
NAN, INF = float("nan"), float("inf")
BAD = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [NAN] * 6, [INF, 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]


def frame(spark, monkeypatch, module, rows, parts=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(parts)
    monkeypatch.setattr(module, "table", lambda *_: df)


def points(n, d, seed, centres=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * np.linspace(0.2, 2, d) + 1
    if centres:
        x = r.normal(size=(centres, d))[r.integers(0, centres, n)] * 3 + x * 0.4
    return x.astype(np.float32).astype(float)


# ---- whitening -------------------------------------------------------------------


@pytest.mark.parametrize(("parts", "block"), [(1, 4096), (11, 16), (70, 7)])  # one, two and three levels of merging
def test_whitening(spark, monkeypatch, parts, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    x = points(400, 12, 1)
    x[5] = x[6]
    rows = [(i if i != 9 else None, v) for i, v in enumerate(x.tolist())] + [(1000 + i, v) for i, v in enumerate(BAD)] + [(4, x[4].tolist())]
    frame(spark, monkeypatch, whitening, rows, parts)
    got = {(r.vec_id, r.component): r for r in whitening.op12_whitening(spark, "").collect()}
    x = np.vstack([x, x[4]])
    w = np.floor(1024 * x).astype(np.int64) + 100_000
    n, sums = len(w), w.sum(axis=0)
    c = w - sums / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    want = c @ v / np.sqrt(e)
    assert len(got) == 400 * 8  # id 4 is there twice
    for k in range(8):
        signs = {math.copysign(1, got[i, k + 1].whitened * want[i, k]) for i in range(400) if i != 9 and abs(want[i, k]) > 1e-6}
        assert len(signs) == 1
        for i in range(400):
            r = got[None if i == 9 else i, k + 1]
            assert abs(abs(r.whitened) - abs(want[i, k])) < 1e-9
            assert r.n == n and r.deviation == int(((n * w[i] - sums) ** 2).sum())
            assert abs(r.explained - e[k] / e.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening_without_spread_and_without_rows(spark, monkeypatch):
    frame(spark, monkeypatch, whitening, [(1, [1.0, 0.0, 2.0]), (2, [3.0, 0.0, 2.0])])
    got = sorted((r.vec_id, r.component, r.deviation, r.whitened and round(abs(r.whitened), 9), r.explained, r.identity_error < 1e-9) for r in whitening.op12_whitening(spark, "").collect())
    assert got == [(i, k, 2048**2, 1.0 if k == 1 else None, 1.0 if k == 1 else 0.0, True) for i in (1, 2) for k in (1, 2, 3)]
    frame(spark, monkeypatch, whitening, [(1, [1.0, 0.5])])
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.op12_whitening(spark, "").collect()] == [(0, None, None, 0.0)] * 2
    for rows in ([], [(1, None), (2, [])]):
        frame(spark, monkeypatch, whitening, rows)
        out = whitening.op12_whitening(spark, "")
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_large_numbers(spark, monkeypatch):
    """Entries near 2^39 and long vectors: sums stay exact, a deviation beyond 64 bits is null."""
    big = [[2.0**36 * k] + [float(k % 3)] * 299 for k in range(7)]
    frame(spark, monkeypatch, whitening, list(enumerate(big)) + [(9, [2.0**41] * 300)])
    got = whitening.op12_whitening(spark, "").collect()
    assert {r.vec_id for r in got} == set(range(7)) and {r.n for r in got} == {7}
    w = [[int(1024 * c) + 100_000 for c in v] for v in big]
    sums = [sum(c) for c in zip(*w, strict=True)]
    for r in got:
        dev = sum((7 * a - s) ** 2 for a, s in zip(w[r.vec_id], sums, strict=True))
        assert r.deviation == (dev if dev < 2**63 else None)


# ---- nearest neighbours ------------------------------------------------------------


def brute(rows, every, k):
    """query id -> [(id, score)] with the query's own row left out."""
    x = np.array([v for _, v in rows])
    out = {}
    for q, (i, _) in enumerate(rows):
        if i is not None and i % every == 0:
            s = neighbours.cosines(x[q], x)
            order = sorted((j for j in range(len(rows)) if j != q), key=lambda j: (-s[j], rows[j][0] is None, rows[j][0] or 0))
            out[i] = [(rows[j][0], float(s[j])) for j in order[:k]]
    return out


def found(spark):
    out = {}
    for r in sorted(neighbours.op13_nearest_neighbours(spark, "").collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("centres", [0, 25])
def test_neighbours(spark, monkeypatch, centres):
    """Recall of at least 0.9, scores as brute force has them; shards and copies of shards are many."""
    for name, value in (("LEAF", 20), ("SHARD", 64), ("MEET", 8), ("SAMPLE", 900)):
        monkeypatch.setattr(neighbours, name, value)
    rows = [(i, v) for i, v in enumerate(points(1500, 6, 3, centres).tolist())]
    frame(spark, monkeypatch, neighbours, rows + [(50 * i + 2000, v) for i, v in enumerate([*BAD, [0.0] * 6])])
    got, want = found(spark), brute(rows, 50, 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    score = {i: v for i, v in rows}
    for q, best in got.items():
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))
        for i, s in best:
            assert abs(s - neighbours.cosines(np.array(score[q]), np.array([score[i]]))[0]) < 1e-12


def test_neighbours_of_copies_and_ties(spark, monkeypatch):
    """A vector that most rows share: nearest are the smallest ids; repeated ids and null ids are candidates."""
    r = np.random.default_rng(5)
    hot = r.normal(size=6).astype(np.float32).astype(float).tolist()
    rows = [(i, hot) for i in range(0, 600)] + [(1000 + i, r.normal(size=6).astype(np.float32).astype(float).tolist()) for i in range(100)]
    rows += [(1050, rows[-1][1]), (None, rows[-2][1]), (None, rows[-2][1])]
    frame(spark, monkeypatch, neighbours, rows)
    got = found(spark)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[550]] == [0, 1, 2, 3, 4] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(abs(s - 1) < 1e-12 for _, s in got[550])
    index = neighbours.Index(neighbours.stored(spark.createDataFrame([(n, i, v) for n, (i, v) in enumerate(rows)], "row long, vec_id long, vec array<float>"), "t"), 6)
    assert index.rows.count() == 6 + 103


def test_few_and_no_candidates(spark, monkeypatch):
    frame(spark, monkeypatch, neighbours, [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])])
    got = found(spark)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [3, 50], 50: [3, 0]}
    for rows in ([], [(0, None), (50, [0.0, 0.0])], [(0, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 3.0])]):
        frame(spark, monkeypatch, neighbours, rows)
        assert found(spark) == {}


def test_best_bin_first_reaches_every_leaf_once_and_the_nearest_first():
    x = points(600, 5, 8, 12)
    t = neighbours.Tree(x, leaf=15, branches=4)
    place = t.place(x)
    assert t.leaves > 10 and set(place) == set(range(t.leaves))
    for q in range(0, 600, 40):
        order = list(t.visits(neighbours.unit(x[q : q + 1])[0] @ t.centres.T))
        assert sorted(order) == list(range(t.leaves)) and order[0] == place[q]


def test_commonest_length(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0, 1.0]), (4, [3.0])], "i long, v array<float>")
    rows, d = vectors.of_one_length(vectors.finite(df, "i", "v"))
    assert d == 2 and sorted(r.vec_id for r in rows.collect()) == [2, 3]
