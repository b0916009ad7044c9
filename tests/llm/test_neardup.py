import random

import numpy as np

from lexmill.llm import neardup
from lexmill.llm.common import Scratch, components
from tests.llm.helpers import frame, odd_rows, prose


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(d, shingle_set(t, k)) for d, t, *_ in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=repr)


def test_against_all_pairs(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for _ in range(25):
        words = prose(rng, rng.randint(8, 150)).split()
        for _ in range(rng.randint(1, 12)):
            own = [rng.choice("abcdefgh") if rng.random() < rng.choice([0, 0.01, 0.03, 0.05]) else w for w in words]
            rows.append((n, " ".join(own), "en", "s", 1))
            n += 1
    rng.shuffle(rows)
    for k in (4, 5):
        got = neardup.near_duplicates(frame(spark, rows), k).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(rows, k)


def test_odd_rows(spark):
    got = neardup.near_duplicates(frame(spark, extra=True), 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(odd_rows(), 4)
    assert neardup.near_duplicates(frame(spark, []), 4).collect() == []
    assert [r.kept for r in neardup.near_duplicates(frame(spark, [(1, None, None, None, None)])).collect()] == [True]


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(10)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(5, a), (5, b), (7, a + " word"), (8, b + " word"), (3, ""), (3, b), (9, prose(rng, 30)), (9, ""), (11, None), (12, a), (12, a), (-4, prose(rng, 20)), (-4, prose(rng, 25)), (None, a)]
    rows = [(d, t, "en", "s", 1) for d, t in rows]
    got = neardup.near_duplicates(frame(spark, rows), 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(rows, 4)


def test_sketches_fill_and_concentrate():
    rng = np.random.default_rng(2)
    one = [rng.integers(0, 1 << 63, size=n, dtype=np.uint64) for n in (1, 2, 7, 500)]
    t = neardup.BANDS * neardup.ROWS
    assert (neardup.sketches(one, t) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    shared = rng.integers(0, 1 << 63, size=400, dtype=np.uint64)
    off = []
    for _ in range(40):
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, size=50, dtype=np.uint64)]) for _ in range(2))
        x, y = neardup.sketches([a, b], t)
        off.append((x == y).mean() - 400 / 500)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.04


def test_long_chains_settle(spark):
    """Documents that are each linked to the next only, their ids rising along the chain."""
    edges = [(i, i + 1) for i in range(999)] + [(2000 + i, 2001 + i) for i in range(70)]
    got = components(Scratch(spark, "chain"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == 1071 and all(r.component == (0 if r.id < 1000 else 2000) for r in got)
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 15)), "en", "s", 1) for i in range(1000)]
    sets = [shingle_set(t, 4) for _, t, *_ in rows[:3]]
    assert 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 80 * len(sets[0] | sets[2])
    found = neardup.near_duplicates(frame(spark, rows), 4).collect()
    assert len(found) == 1000 and {(r.component_id, r.kept) for r in found} == {(0, r.doc_id == 0) for r in found}
