import numpy as np

from lexmill.llm import forest


def exact(ids, x, queries, k=20):
    out = {}
    for q in queries:
        i = ids.index(q)
        s = [(-(x[i] * x[j]).sum(), ids[j]) for j in range(len(ids)) if ids[j] != q]
        out[q] = [v for _, v in sorted(s)[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32) * rng.uniform(0.5, 2, size=(1500, 1)).astype(np.float32)
    x[700:760] = x[700]  # one vector many times
    df = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = forest.neighbours(df, df.filter("vec_id % 20 = 0")).collect()
    want = exact(list(range(1500)), x.astype(float), range(0, 1500, 20))
    found = {}
    for r in got:
        assert np.isclose(r.score, float((x[r.query_id].astype(float) * x[r.vec_id].astype(float)).sum()), rtol=1e-12)
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert all(sorted(v) == list(range(1, 21)) for v in found.values()) and len(found) == 75
    assert sum(len(set(found[q].values()) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
    hot = [found[700][k] for k in range(1, 21)]
    assert hot == want[700]


def test_codes_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    for scale in (np.ones((2000, 1)), rng.uniform(0.2, 3, size=(2000, 1))):
        x = rng.normal(size=(2000, 12))
        x = x / np.linalg.norm(x, axis=1, keepdims=True) * scale
        f = forest.Forest(x[:500], x[:500].mean(axis=0), 4.0, 2000, 100, 24, None, 20)
        together = f.codes(x, False)
        assert np.array_equal(together, np.vstack([f.codes(r[None], False) for r in x]))
        assert np.array_equal(f.ranges(together)[0], np.vstack([f.ranges(c[None])[0] for c in together]))


def test_recall_of_unequal_lengths_and_parts_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(1200, 24)) * rng.uniform(0.3, 2, size=(1200, 1))).astype(np.float32)
    df = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).repartition(5)
    want = exact(list(range(1200)), x.astype(float), range(0, 1200, 20))

    def recall(**how):
        found = {}
        for r in forest.neighbours(df, df.filter("vec_id % 20 = 0"), **how).collect():
            found.setdefault(r.query_id, []).append(r.vec_id)
        return sum(len(set(found[q]) & set(want[q])) for q in want) / (20 * len(want))

    least = [recall(reach=r) for r in (0.25, 1.0, 24.0)]
    assert least == sorted(least) and least[-1] == 1.0 and recall() >= 0.9
    monkeypatch.setattr(forest, "BLOCK", 16)  # blocks of many rows and many queries, dealt out in parts
    assert recall(reach=24.0) == 1.0 and recall() >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (20, [-1.0, 0.0], 1), (20, [-1.0, 0.0], 1), (40, None, 0)]
    df = table(spark, rows).selectExpr("*", "1 as tree", "2 as block", "3 as score")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in forest.neighbours(df, df.filter("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 2, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0)]
    none = table(spark, [])
    assert forest.neighbours(none, none).collect() == []
    assert forest.neighbours(df.filter("vec_id = 0"), df.filter("vec_id = 0")).collect() == []


def test_ties_at_the_bound_go_to_the_smaller_id(spark):
    """Groups of copies, the second cut by the bound, and coarse vectors of few scores; every range holds all rows."""
    rng = np.random.default_rng(8)
    first, second = [2.0, 1.0, 0.0], [1.0, 2.0, 0.0]
    vectors = [first] * 15 + [second] * 40 + rng.uniform(-1, 0.2, size=(60, 3)).tolist()
    for rows in (vectors, rng.integers(0, 2, size=(400, 6)).tolist()):
        rows = [[float(c) for c in v] for v in rows]
        ids = [int(i) for i in rng.permutation(len(rows)) + 1]
        df = table(spark, [(i, v, 0) for i, v in zip(ids, rows, strict=True) if any(v)] + [(0, [3.0] + [0.0] * (len(rows[0]) - 1), 0)])
        data = {r.vec_id: list(r.embedding) for r in df.collect()}
        got = forest.neighbours(df, df.filter("vec_id = 0"), trees=2).orderBy("rank").collect()
        assert [r.vec_id for r in got] == exact(list(data), np.array(list(data.values())), [0])[0]
