"""Merkle manifest against a tree built in one piece."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from postroom.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        first = i // 16 * 16
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 16])
        i //= 16


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    last = tree([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            proof = [*siblings(trees[g], i), *siblings(last, k)]
            text = r[4]
            if text is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf((*r[:4], text))
            for left, right in proof:
                node = digest(left + node + right)
            yield r[0], leaf(r), trees[g][-1][0], last[-1][0], digest("".join(a + b for a, b in proof)), node, node == last[-1][0]


def corpus(n, sources, seed):
    r = random.Random(seed)
    rows = [(r.randrange(10 * n), r.choice(sources), r.choice(["en", None]), r.choice([None, 3]), r.choice(["Ab", "é Ü", "", None, "X" * 50_000 if not r.randrange(50) else "y"])) for _ in range(n)]
    return rows + rows[:5] + [(None, sources[0], None, None, None), (None, None, "", 0, "T"), (None, None, "", 0, "T")]


def got(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(merkle, "table", lambda *_: spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", root string").repartition(parts))
    return sorted(map(tuple, merkle.op11_merkle_manifest(spark, "").collect()), key=repr)


@pytest.mark.parametrize(
    ("n", "sources", "local"),
    [
        (700, ["hot"] * 8 + ["b", "é", None, "z", "Z"], 3),
        (700, ["hot"] * 8 + ["b", "é", None, "z", "Z"], 1),  # most levels between the partitions
        (60, [f"s{i}" for i in range(40)], 3),  # groups of one leaf, a tree of groups with several levels
        (1, ["only"], 3),
    ],
)
def test_manifest(spark, monkeypatch, n, sources, local):
    monkeypatch.setattr(merkle, "LOCAL", local)
    rows = corpus(n, sources, n)
    assert got(spark, monkeypatch, rows, 3) == sorted(brute(rows), key=repr)


def test_large_group_over_many_partitions(spark, monkeypatch):
    """More than 4096 leaves, so that whole subtrees of three levels and ragged ones meet."""
    rows = [(i, "hot", "en", i, "T") for i in range(9000)] + [(i, None, "en", i, "T") for i in range(20)]
    assert got(spark, monkeypatch, rows, 4) == sorted(brute(rows), key=repr)


def test_no_rows(spark, monkeypatch):
    assert got(spark, monkeypatch, [], 1) == []


def test_same_key_in_most_rows(spark, monkeypatch):
    """One id in nearly all rows: they are dealt to several partitions, told apart by their leaves."""
    rows = [(7, "hot", "en", i % 50, "T") for i in range(2000)] + [(1, "a", "en", 1, "T")]
    assert got(spark, monkeypatch, rows, 4) == sorted(brute(rows), key=repr)
    leaves = merkle._sorted_rows(spark.createDataFrame([("hot", 7, "x")] * 2000, "grp string, key long, leaf string"))
    assert leaves.groupBy("p").count().agg(F.max("count")).first()[0] < 1500


def test_proof_fails_for_another_leaf(spark):
    df = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(40)], DOCS)
    m = merkle.documents_manifest(df)
    other = m.select(F.lead("leaf").over(merkle.Window.orderBy("doc_id")).alias("other"), "leaf", "proof", "root").filter("other is not null")
    folded = other.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("own"), (merkle.fold(F.col("other"), F.col("proof")) == F.col("root")).alias("others"))
    assert {tuple(r) for r in folded.collect()} == {(True, False)}
