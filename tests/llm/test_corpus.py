"""Operators over a corpus against brute force: mixing, near-duplicates, lines, URLs, language model, pipeline."""

import collections
import math
import random
import re
import zlib
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postroom.llm import common, components, language_model, line_dedup, lists, minhash_dedup, mixing, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def word(r, k=6):
    return "".join(r.choice("abcdefghijklmn") for _ in range(r.randrange(2, k)))


# ---- components ----------------------------------------------------------------


def test_join_of_hot_keys(spark, monkeypatch):
    """Broadcast and shuffled keys together give the plain join."""
    monkeypatch.setattr(common, "HOT", 3)
    left = spark.createDataFrame([(k % 7 if k < 40 else 9, k) for k in range(60)], "k long, v long")
    right = spark.createDataFrame([(k, 5) for k in range(1, 7)] + [(9, 20)], "k long, n long")
    for how, more in (("inner", 0), ("left", 6)):
        got = sorted(map(tuple, common.join_hot(left, right, "k", how).collect()), key=repr)
        assert got == sorted(map(tuple, left.join(right, "k", how).collect()), key=repr) and len(got) == 54 + more


@pytest.mark.parametrize("hot", [100_000, 2])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)]
    over = {}

    def root(x):
        while over.setdefault(x, x) != x:
            x = over[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        over[b] = a
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}


def test_stored_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    made = common.stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "made")
    assert not shuffle_files(spark) - before
    assert made.count() == 7


def test_rounds_of_pairs_of_blocks(spark, monkeypatch):
    """Every pair is in one round, and a round's copies grow as the members, not as their pairs."""
    monkeypatch.setattr(lists, "FEW_COPIES", 1)
    members = spark.createDataFrame([(i, i, i % 40) for i in range(400)], "rep long, comp long, block long")
    pairs = spark.createDataFrame([(a * 40 + b, a, b) for a in range(40) for b in range(a, 40)], "pair long, one long, two long")
    rounds = lists.rounds_of(members, pairs)
    sizes = [p.count() for p in rounds]
    assert sorted(r.pair for p in rounds for r in p.collect()) == sorted(r.pair for r in pairs.collect())
    assert len(rounds) == 6 and max(sizes) * 20 < 2 * lists.COPIES * 400


# ---- near-duplicates -----------------------------------------------------------


def brute_near(rows, n, hundredths):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    over = {d: d for d in sets}

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= hundredths * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                over[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_corpus(seed):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = [word(r) for _ in range(r.randrange(1, 140))]
        for _ in range(r.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = word(r)
            rows.append((i * 7 % 1000, r.choice([" ", "\n"]).join(w)))
            i += 1
    rows += [(2000, ""), (2001, None), (2002, " \t"), (2003, "One"), (2004, "one"), (2005, "one two"), (2006, "É x"), (2007, "é x")]
    return rows


@pytest.mark.parametrize(("seed", "n", "s"), [(1, 3, 85), (2, 5, 80)])
def test_near_duplicates(spark, monkeypatch, seed, n, s):
    rows = near_corpus(seed)
    for name, value in (("BLOCK", 4), ("SHORT", 3), ("HUBS", 1)):  # many blocks, so that pairs of blocks count
        monkeypatch.setattr(lists, name, value)
    monkeypatch.setattr(minhash_dedup, "CHUNK", 3)
    df = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, n, s / 100).collect()}
    assert got == brute_near(rows, n, s)


@pytest.mark.parametrize("near", [True, False])
def test_near_duplicates_of_a_large_family(spark, monkeypatch, near):
    """Many near copies of one text: those that only other copies link, and those that are too far from all."""
    if not near:
        monkeypatch.setattr(lists, "BLOCK", 40)
        monkeypatch.setattr(lists, "HUBS", 1)
    r = random.Random(3)
    base = [word(r, 9) for _ in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for k in range(r.randrange(0, 4) if near else r.randrange(3, 9)):
            w[r.randrange(len(w))] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # exact copies
    seen = []
    real = minhash_dedup.Corpus.links
    monkeypatch.setattr(minhash_dedup.Corpus, "links", lambda self, pairs: seen.append(pairs.count()) or real(self, pairs))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_near(rows, 5, 80)
    assert max(seen) < 30 * len(rows)


def test_near_duplicates_with_repeated_ids_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (5, long), (6, long + " x"), (7, "other words here for all"), (7, "quite different text as well"), (7, "and yet another text of some words"), (None, long), (None, None), (None, "a text without any id at all"), (8, None), (8, "")]
    df = spark.createDataFrame([(*x, "v", "w") for x in rows], "doc_id long, text string, _row string, row string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == {(5, 5, True): 2, (6, 5, False): 1, (7, 7, True): 3, (None, 5, False): 1, (None, None, True): 2, (8, 8, True): 2}
    kept = minhash_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {5: 1, 7: 3, None: 2, 8: 2}
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0 and minhash_dedup.drop_near_duplicates(df.limit(0)).count() == 0


def test_match_threshold():
    t = minhash_dedup.match_threshold(0.85)
    below = lambda t: sum(math.comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(t))
    assert below(t) <= minhash_dedup.MISS < below(t + 1)


# ---- lines ---------------------------------------------------------------------


def line_sets(line):
    """All shingles of a line, hashed by no one."""
    w = line_dedup.WIDTH
    return frozenset(line[i : i + w] for i in range(len(line) - w + 1)) or frozenset([line])


def brute_lines(rows, sets=line_sets):
    seen = collections.defaultdict(list)
    for d, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            if len(x) >= line_dedup.MIN_CHARS and x.strip(" \t\r\x0b\f"):
                seen[x.strip(" \t\r\x0b\f").lower()].append((d, p))
    keys = list(seen)
    over = list(range(len(keys)))

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    own = [sets(k) for k in keys]
    for i in range(len(keys)):
        for j in range(i):
            small, large = sorted((len(own[i]), len(own[j])))
            if small < 0.8 * large:
                continue
            k = len(own[i] & own[j])
            if k >= 0.8 * (len(own[i]) + len(own[j]) - k):
                a, b = sorted((root(i), root(j)))
                over[b] = a
    groups = collections.defaultdict(list)
    for i, k in enumerate(keys):
        groups[root(i)] += seen[k]
    gone = collections.defaultdict(set)
    for places in groups.values():
        for d, p in sorted(places)[1:]:
            gone[d].add(p)
    return gone


def removed_lines(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    ids = df.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    return {x.doc_id: set(x.removed) for x in line_dedup.duplicate_lines(df).join(ids, "row").collect()}


@pytest.mark.parametrize("hot", [100_000, 2])
def test_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    r = random.Random(8)
    base = [" ".join(word(r) for _ in range(40)) for _ in range(15)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(r.randrange(0, 6)):
            w = r.choice(base).split()
            if r.random() < 0.5:
                w[r.randrange(40)] = word(r)
            lines.append(r.choice([" ".join(w), " ".join(w).upper() + " ", "short", "", " ".join(word(r) for _ in range(20))]))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "x" * 3000 + " " + "y " * 2000)]
    df = spark.createDataFrame([(*x, len(x[1] or ""), "e") for x in rows], "doc_id long, text string, n_chars long, _row string")
    want = brute_lines(rows)
    ids = df.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    got = {x.doc_id: set(x.removed) for x in line_dedup.duplicate_lines(df).join(ids, "row").collect()}
    assert got == {d: p for d, p in want.items() if p}, "brute force over all shingles"
    out = {x.doc_id: x for x in line_dedup.deduplicated(df, drop_empty=False).collect()}
    for d, t in rows:
        text = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d])
        assert out[d].text == text and (t is None or out[d].n_chars == len(text))
    assert line_dedup.deduplicated(df).columns == df.columns
    assert line_dedup.duplicate_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "few"), [(400, 1_000_000), (8, 1_000_000), (8, 40)])
def test_lines_of_long_lists(spark, monkeypatch, block, few):
    """A line, one shorter copy of it, and many copies with words of their own, which only the line links; others that nothing links."""
    monkeypatch.setattr(lists, "BLOCK", block)  # many blocks, so that pairs of blocks count
    monkeypatch.setattr(lists, "FEW_COPIES", few)
    monkeypatch.setattr(lists, "COPIES", min(lists.COPIES, few // 20))  # several rounds in the last case
    r = random.Random(11)
    words = [word(r, 9) + "qrst"[i % 4] * 3 for i in range(30)]
    own = lambda i: [f"own{i}{k}{word(r, 9)}" for k in range(4)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:-2]))] + [(i, " ".join(words + own(i))) for i in range(2, 80)]
    rows += [(100 + i, f"{' '.join(words[:9])} {' '.join(word(r, 9) for _ in range(21))}") for i in range(9)]
    want = brute_lines(rows)
    assert set(want) >= set(range(1, 80))
    assert removed_lines(spark, rows) == {d: p for d, p in want.items() if p}


def test_lines_of_a_large_family(spark):
    """1000 variants of one line: recall against brute force over all shingles, and no false removal."""
    r = random.Random(21)
    words = [word(r, 9) for _ in range(40)]
    rows = []
    for i in range(1000):
        w = list(words)
        for k in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"v{i}{word(r, 7)}"
        rows.append((i, " ".join(w)))
    want, got = brute_lines(rows), removed_lines(spark, rows)
    want = {d for d, p in want.items() if p}
    assert set(got) <= want and len(got) >= 0.99 * len(want)


def test_lines_without_blanks(spark):
    """Lines in scripts without blanks, addresses that differ late, exact repeats in other rows."""
    r = random.Random(22)
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(120))
    rows = [(1, han), (2, han[:60] + "\u4e00" + han[60:]), (3, "https://archive.example.org/2019/annual-report-0001.pdf"), (4, "https://archive.example.org/2024/quarterly-minutes-9999.zip"), (5, han.upper())]
    want = brute_lines(rows)
    assert set(want) == {2, 5} and removed_lines(spark, rows) == want


def test_short_lines(spark):
    """Repeats of short lines go, whatever their indentation; blank lines stay."""
    rows = [(1, "ok.\n\n  \nyes, it is\nOK."), (2, "\t  ok.  \n \n\n          yes, it is"), (3, "yes, it was\n"), (4, "ok")]
    df = spark.createDataFrame(rows, DOCS)
    ids = df.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    got = {x.doc_id: x.removed for x in line_dedup.duplicate_lines(df).join(ids, "row").collect()}
    assert got == {1: [4], 2: [0, 3]}


def test_lines_by_whole_words(spark):
    """What comes after the first characters of a word counts; lines of one token have near copies too."""
    r = random.Random(12)
    token = "".join(r.choice("abcdefghijklmn") for _ in range(300))
    rows = [(1, "get https://example.com/item/1001 200"), (2, "get https://example.com/item/2002 200"), (3, token), (4, token[:150] + "z" + token[150:]), (5, "-" * 70), (6, "-" * 72)]
    df = spark.createDataFrame(rows, DOCS)
    ids = df.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    got = {x.doc_id: x.removed for x in line_dedup.duplicate_lines(df).join(ids, "row").collect()}
    assert got == {4: [0], 6: [0]}


def test_lines_of_few_words(spark):
    """Candidates are found by all shingles: lines that share no pair of neighbouring words, and small sets."""
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghijklmn") for _ in range(24)) for _ in range(4)]
    small = "".join(r.choice("opqrstuvwxyz") for _ in range(16))  # five shingles
    rows = [(1, " ".join(words[:2])), (2, " ".join([words[0], words[1][:-1] + "q"])), (3, " ".join(words[2:])), (4, " ".join(["q" + words[2][1:], words[3][:-1] + "q"])), (5, small), (6, small[:-1]), (7, small[1:])]
    want = brute_lines(rows)
    assert set(want) == {2, 4, 6, 7} and removed_lines(spark, rows) == want


def test_lines_of_common_words_do_not_meet(spark):
    """Lists do not grow with lines that have pairs of neighbouring words in common and little else."""
    r = random.Random(14)
    words = ["".join(r.choice("abcdefghijklmn") for _ in range(7)) for _ in range(16)]
    rows = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(300)]
    lines = line_dedup.signed_lines(spark.createDataFrame(rows, DOCS))
    assert line_dedup.meetings(line_dedup.line_classes(lines)).count() < len(rows)


def test_copies_of_a_line_are_dealt_once_a_batch(spark):
    """Copies of a common line are summed where they are read, and the class has the first of all, ids that are null before others."""
    rows = [(None if i == 77 else i, f"Common line, as all have it.\n\n own {i}") for i in range(200)] + [(500, None), (501, ""), (502, " \n\t")]
    lines = line_dedup.signed_lines(spark.createDataFrame(rows, DOCS).coalesce(1))
    assert lines.count() == 400 and lines.filter("n > 0").count() == 201 and lines.agg(F.sum("n")).first()[0] == 400
    common = line_dedup.line_classes(lines).filter("n > 1").collect()
    assert [(x.n, x["first"].doc_id, x["first"].pos) for x in common] == [(200, None, 0)]


@pytest.mark.parametrize("size", [1 << 17, 40])
def test_shingles_of_many_lines_at_once(monkeypatch, size):
    """Whole and thinned sets of lines hashed together, against plain ones, in characters of one to four bytes."""
    monkeypatch.setattr(line_dedup, "_SLICE", size)
    r = random.Random(31)
    drawn = ["".join(r.choice("ab\u00e9\u6f22\U0001f600  \t") for _ in range(r.randrange(1, 60))).strip() for _ in range(300)]
    drawn = [x for x in drawn if x] + ["ok", "-" * 70, "a" * 11, "a" * 12, "a" * 13, "b" * 11 + " c"]
    for lines in (drawn, [x for x in drawn if x.isascii()]):
        column = pa.array([x + line_dedup._TAIL for x in lines])
        assert [len(s) for s in line_dedup.whole_sets(column)] == [len(line_sets(x)) for x in lines]
        thinned = [n for part in line_dedup.parts(column) for n in line_dedup.sketches(part)[2].tolist()]
        starts = lambda x: {x[i : i + 12] for i in range(len(x)) if x[i] not in " \t" and (i == 0 or x[i - 1] in " \t" or len(x[i : i + 12].split()[0]) == 12)}
        assert thinned == [len(starts(x)) for x in lines]
    one, two = line_dedup.whole_sets(pa.array([x + line_dedup._TAIL for x in ("a long enough line \u00e9", "a long enough line \u00e8")]))
    assert len(set(one.tolist()) & set(two.tolist())) == len(one) - 1


def test_lines_run_no_python_on_executors(spark, monkeypatch):
    """Signatures, verification and texts are column expressions; shingles of characters of one to four bytes are the plain ones."""

    def refused(*_):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", refused)
    r = random.Random(41)
    words = [word(r, 9) for _ in range(30)]
    rows = [(1, " ".join(words) + "\n\nown one"), (2, " ".join(words[:-1]) + "\nown two, longer"), (3, None)]
    assert removed_lines(spark, rows) == {2: {0}}
    lines = ["".join(r.choice("ab\u00e9\u6f22\U0001f600 ") for _ in range(r.randrange(1, 60))) for _ in range(50)] + ["a" * 12, "-" * 70]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", F.size(F.array_distinct(line_dedup.shingles(F.col("line")))).alias("n"))
    assert {x.i: x.n for x in got.collect()} == {i: len(line_sets(x)) for i, x in enumerate(lines)}


# ---- mixing --------------------------------------------------------------------


def water(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        w = sum(weight[s] for s in names if s not in fixed)
        target = {s: fixed.get(s, rest * weight[s] / w if w else 0) for s in names}
        above = [s for s in names if s not in fixed and target[s] > 3 * sizes[s]]
        if not above:
            return target
        fixed |= {s: 3 * sizes[s] for s in above}


@pytest.mark.parametrize("cell", [2000, 7])
def test_mixing(spark, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL", cell)
    r = random.Random(9)
    names = ["a", "b", None, "tiny", "Z"]
    rows = [(i, r.choice(["a", "a", "a", *names]), " ".join("w" for _ in range(int(r.expovariate(1 / 60))))) for i in range(900)] + [(5, "a", "one two"), (5, "a", "one two"), (901, "none", None), (902, "none", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = water(sizes)
    got = mixing.mixture(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixture(df).collect()), key=repr)
    taken = collections.Counter()
    for x in got:
        taken[x.source] += x.taken
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source]) and x.taken in [k * x.size for k in range(4)]
    largest = {s: max(len(WORD.findall(t or "")) for _, q, t in rows if q == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 3 * largest[s] for s in sizes)
    out = mixing.mixed(df).collect()
    assert sum(len(WORD.findall(x.text or "")) for x in out) == sum(taken.values())
    assert mixing.mixture(df.limit(0)).count() == 0


def test_mixture_of_shared_ids(spark):
    """Ids shared by sources, null ids, equal rows, clashing names: each source's words are those of the mixture."""
    r = random.Random(10)
    rows = [(i, s, " ".join("w" for _ in range(r.randrange(1, 120))), i, "v", "c") for s in ("a", "b") for i in range(200)]
    rows += [(None, "a", "one two three", 0, "v", "c")] * 7 + [(5, "c", "one two", k, "v", "c") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_copies long, _d string, copy string")
    want, got = collections.Counter(), collections.Counter()
    for x in mixing.mixture(df).collect():
        want[x.source] += x.taken
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "copy_"]
    for x in out.collect():
        got[x.source] += len(x.text.split())
    assert got == want
    assert mixing.mixed(df.limit(0)).count() == 0


# ---- URLs ----------------------------------------------------------------------


def test_url_filter(spark):
    day = lambda n: date(2024, 1, n)
    events = spark.createDataFrame([("s", "block", "x.org", "add", day(5)), ("s", "block", "x.org", "remove", day(10)), ("s", "block", "x.org", "add", day(20)), ("t", "allow", "a.x.org", "add", day(7)), ("p", "block", "y.org/bad/deep", "add", day(1)), ("q", "block", "z.org", "remove", day(3)), ("q", "block", "z.org", "add", day(3))], "list string, verdict string, key string, action string, at date")
    rows = [(1, "http://X.org/a", day(4)), (2, "http://u:p@b.x.org:80/a", day(5)), (3, "http://x.org", day(10)), (4, "https://x.org.?q", day(25)), (5, "http://a.x.org/", day(8)), (6, "http://a.x.org/", day(6)), (7, "http://y.org/bad/deep/er?x", day(2)), (8, "http://y.org/bad/deeper", day(2)), (9, None, day(2)), (10, "no url", day(2)), (11, "http://x.org", None), (12, "http://z.org/", day(3)), (1, "http://X.org/a", day(4))]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched date")
    want = {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 8: False, 9: False, 10: False, 11: False, 12: True}
    for small in (1000, 0):
        got = url_filter.filtered(df, events, small=small).collect()
        assert len(got) == 13 and all(r.blocked == want[r.page_id] for r in got)
    assert not any(r.blocked for r in url_filter.filtered(df, events.limit(0)).collect())
    assert url_filter.filtered(df.limit(0), events).count() == 0


# ---- language model ------------------------------------------------------------


def test_seating_follows_the_restaurant_process():
    rng = np.random.default_rng(3)
    n, d, s, base = 9, 0.5, 1.0, 0.3
    got = np.mean([language_model.seat(np.array([n]), np.array([base]), np.array([2.0]), d, s, rng)[0] for _ in range(4000)])
    a, p = (s + d * 2.0) * base, {1: 1.0}
    for k in range(1, n):
        nxt = collections.Counter()
        for t, q in p.items():
            new = a / (a + k - d * t)
            nxt[t + 1] += q * new
            nxt[t] += q * (1 - new)
        p = nxt
    assert abs(got - sum(t * q for t, q in p.items())) < 0.1


def test_predictive_probabilities_sum_to_one():
    r = np.random.default_rng(5)
    counts = r.poisson(2.0, (6, 5)).astype(float)
    counts[3] = 0
    assert np.allclose(language_model.sample_contexts(counts).sum(1), 1)
    p, unseen = language_model.sample_rare(np.array([1.0, 3.0]), np.array([4, 2]), 10)
    assert abs(4 * p[0] + 2 * p[1] + 4 * unseen - 1) < 1e-6


def test_language_model(spark):
    r = random.Random(7)
    words = [word(r) for _ in range(300)]
    zipf = [1 / (i + 1) for i in range(300)]

    def text():
        out = ["the"]
        for _ in range(60):
            out.append(words[(words.index(out[-1]) + 1) % 300] if out[-1] in words and r.random() < 0.4 else r.choices(words, zipf)[0])
        return " ".join(out)

    rows = [(i, text()) for i in range(150)] + [(900, None), (901, ""), (901, ""), (902, "Never SEEN words")]
    df = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    got = language_model.score_documents(df, df.filter(~F.col("held_out"))).collect()
    low = lambda t: [w.lower() for w in WORD.findall(t or "")] + ["\n"]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = collections.Counter(w for d, t in rows if not held(d) for w in low(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    of = dict(rows)
    for x in got:
        t = low(of[x.doc_id])
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    out = [x for x in got if x.held_out and x.n_tokens > 10]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)
    empty = language_model.score_documents(df, df.limit(0)).collect()
    assert len(empty) == len(rows) and all(x.train_tokens == 0 and math.isfinite(x.score) for x in empty)
    assert language_model.score_documents(df.limit(0), df).count() == 0


def test_counts_of_rare_words_are_not_binned(spark, monkeypatch):
    """Words of 1030 and 1031 occurrences are two counts; their probabilities and those of the frequent words' table are as sampled."""
    seen = {}
    sampled = language_model.sample_rare
    monkeypatch.setattr(language_model, "sample_rare", lambda counts, many, types: seen.setdefault("p", (list(counts), list(many), sampled(counts, many, types)))[2])
    rows = [(0, "a " * 2_100_000), (1, "x " * 1030), (2, "y " * 1031 + "z z"), (3, "z")]
    df = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.lit(False))
    got = {r.doc_id: r for r in language_model.score_documents(df, df).collect()}
    counts, many, _ = seen["p"]
    assert dict(zip(counts, many, strict=True)) == {3: 1, 4: 1, 1030: 1, 1031: 1}
    assert got[2].n_known == 1034 and math.isfinite(got[2].score)


def test_rare_words_are_contexts(spark):
    """Pairs of rarer words are told from the same words in other pairs, and the probabilities after each context sum to one."""
    texts = ["a " * 60_000, *["x1 y1"] * 3, *["x2 y2"] * 3, "a x1"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(100, "x1 y1", True), (101, "x1 y2", True), (102, "never seen", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in language_model.score_documents(df, df.filter("not held_out")).collect()}
    assert got[100] > got[101] + 0.3 and got[100] == pytest.approx(got[1]) and math.isfinite(got[102])
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    # one frequent word, four rarer ones and the end, all known
    index = {language_model.word_hash(w): i for i, w in enumerate([b"a", b"x1", b"x2", b"y1", b"y2"])} | {language_model.END: 5}
    coder = language_model.Coder(index, 1, np.zeros(6))
    rest, rare = np.log10([0.3, 0.7]), np.log10([0.2, 0.2, 0.2, 0.2, 0.15])  # 0.05 of the rarer words' mass is for words never seen
    left, added = language_model.child_restaurants(training, coder, rest, rare, spark.createDataFrame([], "w bigint, lp double"))
    added = {r.p: r.lc for r in added.collect()}
    for u, lb in [(r.u, r.lb) for r in left.collect()]:
        total = 0.0
        for w in range(6):
            if u not in (0, language_model.START):
                parent = rest[0] if w == 0 else rest[1] + rare[w - 1]
            elif w == 0:
                continue  # a frequent word after a frequent context is not this restaurant's
            else:
                parent = rare[w - 1]
            start = u == language_model.START
            codes = np.array([w] if start else [u, w], np.uint64)
            total += 10 ** (parent + lb + added.get(int(coder.children(codes)[2][-1]), 0.0))
        unseen = 0.05 if u in (0, language_model.START) else 0.7 * 0.05
        assert total + 10**lb * unseen == pytest.approx(1)


# ---- pipeline ------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    stop = ["the", "of", "and", "is", "in"]
    text = lambda n=60: ". ".join(" ".join(r.choice([r.choice(stop), word(r, 8)]) for _ in range(12)) for _ in range(n // 12)) + "."
    item = text(24)
    base = text(240)
    rows = [(i, text(), "en", f"s{i % 3}") for i in range(40)]
    rows += [(50, base, "en", "s0"), (51, base + " end", "en", "s1"), (60, text() + "\n" + item + "\n" + text(), "en", "s2"), (70, "x | y | " * 40, "en", "s0"), (80, "few words", "en", None)]
    spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
    before = {x.doc_id for x in spark.read.parquet(str(tmp_path / "decontamination")).collect()}
    assert before == set(range(40)) | {50}
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= before
