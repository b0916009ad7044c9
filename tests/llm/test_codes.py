import hashlib
import math
import os
import random

import numpy as np
import pytest

from lexmill.llm import codes
from tests.llm.helpers import against_sql

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1])
    cuts = [(d * p // parts, d * (p + 1) // parts) for p in range(parts)]
    seeds = [q for _, q in sorted((i, q) for i, q, _ in kept if i is not None)][:entries]
    books = [[q[a:b] for q in seeds] for a, b in cuts]

    def assign(q):
        best = [min((sum((x - y) ** 2 for x, y in zip(q[a:b], e, strict=True)), k) for k, e in enumerate(book)) for (a, b), book in zip(cuts, books, strict=True)]
        return [k for _, k in best], sum(s for s, _ in best)

    for _ in range(2):
        found = [assign(q)[0] for _, q, _ in kept]
        new = []
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for (_, q, _), code in zip(kept, found, strict=True):
                groups.setdefault(code[p], []).append(q[a:b])
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])])
        books = new
    out = sorted(((i, bytes(assign(q)[0]).hex(), assign(q)[1], lab) for i, q, lab in kept), key=repr)
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def rows_of(n, d, seed=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(9)]
    return [(i, [x + rng.choice([0, 0.004, rng.gauss(0, 0.3)]) for x in rng.choice(centres)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "d"), [(200, 32), (30, 16), (1, 48), (150, 21)])
def test_against_brute_force(spark, n, d):
    data = rows_of(n, d)
    data += [(1000, None, 1), (1001, [None] * d, 1), (1002, [float("nan")] * d, 2), (1003, [float("inf")] + [0.0] * (d - 1), 2), (1004, [], 1), (None, data[0][1], 3), data[0]]
    got, books = codes.compress(spark.createDataFrame(data, COLUMNS).repartition(3))
    want, digest = brute(data)
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got.collect()), key=repr) == want
    assert hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest() == digest


def test_partial_distances_keep_ties():
    rng = np.random.default_rng(1)
    for d in (1, 4, 9):
        book = codes.Book(rng.integers(-2, 3, size=(64, d)))
        x = rng.integers(-3, 4, size=(500, d))
        full = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        entry, error = book.nearest(x)
        assert (entry == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()


def test_odd_tables(spark):
    assert codes.compress(spark.createDataFrame([], COLUMNS))[0].collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1)], COLUMNS))[0].collect() == []
    mixed = [(i, [float(i)] * 16, 1) for i in range(5)] + [(9, [1.0] * 32, 1)]
    assert sorted(r.vec_id for r in codes.compress(spark.createDataFrame(mixed, COLUMNS))[0].collect()) == [0, 1, 2, 3, 4]
    wide = spark.createDataFrame([(1, [3e38] * 16, "a"), (2, [-3e38] * 16, "b")], "vec_id long, embedding array<float>, label string")
    for name in ("q", "v", "code", "error", "p", "e", "n"):
        wide = wide.selectExpr("*", f"cast(7 as int) as `{name}`")
    assert sorted((r.vec_id, r.error) for r in codes.compress(wide)[0].collect()) == [(1, 0), (2, 0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_against_sql(spark):
    assert against_sql(codes.op12_vector_codes(spark, "/root/testdata/sf0.001"), codes.ORACLE_OP12, "/root/testdata/sf0.001") == []


def test_spread_join(spark):
    from lexmill.llm.common import Scratch, spread_join

    rows = [(k, i) for i, k in enumerate([None] * 900 + ["a"] * 700 + [str(i) for i in range(800)] + ["none"] * 50)]
    one = [(None, 1), ("a", 2), *((str(i), i) for i in range(800))]
    got = spread_join(spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame(one, "k string, v int"), "k", Scratch(spark, "spread"))
    want = dict(one)
    assert {(r.i, r.v) for r in got.collect()} == {(i, want.get(k)) for k, i in rows}
    assert got.count() == len(rows)
