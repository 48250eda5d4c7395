import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from swathframe.llm import parity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width=5, percent=80):
    """(n_shingles, component) of each doc_id, from all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in by[g])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((top(i), top(j)))
                up[b] = a
        for g in s:
            by[g].append(i)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def result(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def test_odd_rows(spark, odd, odd_rows):
    want = brute([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    found = parity.jaccard_components(odd)
    assert found.count() == len(odd_rows)
    assert result(found.filter("doc_id is not null")) == {(i, *v) for i, v in want.items()}
    assert {r.component_id for r in found.filter("doc_id is null").collect()} == {None}


def test_empty(none):
    assert parity.jaccard_components(none).count() == 0


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 80), (3, 60)])
def test_brute_force(spark, seed, percent):
    """Groups of near copies whose pairs lie around the threshold, chains, short sets, shared passages."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(14):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice((4, 5, 6, 9, 12, 20, 40, 90, 200, 400)))]
        for _ in range(r.randrange(1, 16)):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 30)):
                copy[r.randrange(len(copy))] = f"e{r.random()}"
            if r.random() < 0.2:
                copy = copy[: r.randrange(1, len(copy) + 1)]
            if r.random() < 0.3:
                copy += passage
            rows.append(" ".join(copy))
            base = copy if r.random() < 0.3 else base
    rows = list(enumerate(rows))
    r.shuffle(rows)
    found = parity.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)
    assert result(found) == {(i, *v) for i, v in brute(rows, percent=percent).items()}


def test_more_rounds(spark, monkeypatch):
    """With one candidate a node and tiny tiles, further rounds still find every link."""
    monkeypatch.setattr(parity, "FEW", 2)
    monkeypatch.setattr(parity, "TILE", 4)
    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(w if r.random() > 0.03 else f"x{r.random()}" for w in base)) for i in range(60)]
    assert result(parity.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == {(i, *v) for i, v in brute(rows).items()}


def test_hot_keys(spark, monkeypatch):
    """Keys that are hot in some tasks only, and salted groups, lose no link."""
    monkeypatch.setattr(parity, "GROUPS", 3)
    r = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, passage + " " + " ".join(f"t{i % 40}_{j if r.random() > 0.04 else r.random()}" for j in range(25))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(parity.jaccard_components(df)) == {(i, *v) for i, v in brute(rows).items()}


def test_bounds():
    """Sketches bound the symmetric difference from below; linked sets share a key."""
    r = np.random.default_rng(5)
    bands = parity.Bands(80)
    for n in (5, 6, 8, 13, 30, 77, 200, 900):
        for _ in range(6):
            a = r.integers(1, 1 << 54, n, dtype=np.uint64)
            most = int(bands.differ(np.array(2 * n)))
            b = np.concatenate([a[most // 2 :], r.integers(1, 1 << 54, most // 2, dtype=np.uint64)])
            bits = parity.Bits(pa.array([parity.sketch(a).tobytes(), parity.sketch(b).tobytes()]), np.array([len(a), len(b)]), bands)
            ok, apart = bits.near(np.array([0]), np.array([1]))
            assert ok[0] and apart[0] <= len(np.setxor1d(a, b))
            keys = [set(parity.keys_of(x, np.zeros(len(x), np.int64), np.array([len(x)]), bands)[0].tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_one_of_each(spark, odd, odd_rows):
    kept = parity.one_of_each(odd)
    assert kept.columns == odd.columns
    want = {i for i, (_, c) in brute([(r[0], r[1]) for r in odd_rows if r[0] is not None]).items() if i == c}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_tally():
    """Keys that come often in a slice or in all slices are hot from then on, and the table of counts stays bounded."""
    tally, one = parity.Tally(), lambda *k: np.array(k, np.uint64)
    assert tally.met(one(1, 2, 3), np.array([parity.HOT, 10, 1])).tolist() == [True, False, False]
    rounds = [tally.met(one(2, 3), np.array([10, 1])).tolist() for _ in range(parity.HOT_TASK // 10 + 1)]
    assert rounds[0] == [False, False] and rounds[-1] == [True, False]
    assert tally.met(one(2), np.array([1])).tolist() == [True]
    tally.met(np.arange(10, 10 + 2 * parity.TALLY, dtype=np.uint64), np.full(2 * parity.TALLY, 2))
    assert len(tally.count) <= parity.TALLY


def test_keys_hot_in_a_task(spark, monkeypatch):
    """A key that no slice has often, but a task has, loses no link."""
    monkeypatch.setattr(parity, "HOT_TASK", 6)
    monkeypatch.setattr(parity, "GROUPS", 3)
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words = list(base) if i % 2 else [f"v{i}_{k}" for k in range(80)]
        words[int(r.integers(80))] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_rows_of_a_large_bucket(spark, monkeypatch):
    """A group whose sets are one component but for a few sends each of its rows to few tiles, and loses no link."""
    monkeypatch.setattr(parity, "TILE", 8)
    monkeypatch.setattr(parity, "HOT", 20)
    met, tile = [], parity.Scratch.keep
    monkeypatch.setattr(parity.Scratch, "keep", lambda self, df, name: (met.append(df) if name.startswith("apart") else None, tile(self, df, name))[1])
    r = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base, *(f"n{i}_{k}" for k in range(r.randrange(1, 4)))])) for i in range(120)]
    rows += [(200 + i, " ".join([*base, *(f"m{i}_{k}" for k in range(18))])) for i in range(6)]
    assert result(parity.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == {(i, *v) for i, v in brute(rows).items()}
    for df in met:
        large = df.filter("mains > 0").selectExpr("sum(if(label = main, rest, mains + rest)) AS n", "count(*) AS s").first()
        assert large.n is None or large.n <= 4 * large.s  # by tiles of all members: 15 and more
