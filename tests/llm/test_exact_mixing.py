import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexmill.llm import exact, mixing
from lexmill.llm.common import Scratch, numbered
from tests.llm.helpers import frame, odd_rows, prose, targets


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        done = False
        for m in members:
            kept = m == best and not done
            done |= kept
            out.append((m[2], best[2], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_against_brute_force(spark):
    rng = random.Random(6)
    bases = [prose(rng, n) for n in (1, 3, 10, 40, 300, 3000)]
    rows = [(i, rng.choice(["", " ", "\n"]) + rng.choice(bases)[: rng.choice([5, 20, 100, 100000])] + rng.choice(["", "\t", " "]), "en", "s", 1) for i in range(300)]
    for data in (odd_rows(), rows):
        got = exact.radix_groups(frame(spark, data)).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.norm_sha256) for r in got), key=repr) == brute(data)
    assert exact.radix_groups(frame(spark, [])).collect() == []


def test_exact_carries_rows(spark):
    df = frame(spark, extra=True)
    kept = exact.radix_groups(df, rows=True).filter("kept").select("row.*")
    assert kept.columns == df.columns
    assert Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()) == Counter({re.sub(r"[\x20\x09-\x0D]", "", t or ""): 1 for _, t, *_ in odd_rows()})


def test_targets_share_out(spark):
    assert targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]
    rng = random.Random(7)
    for sizes in ([100, 100, 100], [5, 1000, 70, 0], [], [0, 0], [3], [rng.choice([0, 1, 9, 500, 10**6]) for _ in range(300)]):
        names = [*(f"s{i:03d}" for i in range(len(sizes) - 1)), None][: len(sizes)]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long").repartition(3)
        got = {r.source: r.target for r in mixing.targets(Scratch(spark, "goals"), df).collect()}
        assert got == dict(zip(names, targets(sizes), strict=True))


def test_places_in_order(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, None]), i) for i in range(500)]
    got = numbered(Scratch(spark, "places"), spark.createDataFrame(rows, "a int, b int").repartition(7), F.col("a").asc_nulls_last(), F.col("b")).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    assert sorted(r.place for r in got) == list(range(500))


def test_mixing_near_targets(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 60)) + (" big" * 400 if i % 97 == 0 else ""), "en", rng.choice(["a", "a", "b", "ü", None]), 1) for i in range(900)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rs in by.values():
        assert abs(sum(r.size * r.copies for r in rs) - rs[0].target) <= 0.02 * rs[0].target
        assert all(0 <= r.copies <= 2 for r in rs) and rs[0].source_size == sum(r.size for r in rs)
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mixed = mixing.mixed(frame(spark, rows, extra=True).drop("size"))
    want = Counter({r.doc_id: r.copies for r in got if r.copies})
    assert Counter(r.doc_id for r in mixed.collect()) == want


def test_mixing_odd_rows(spark):
    got = mixing.mix(frame(spark, extra=True)).collect()
    assert len(got) == len(odd_rows())
    assert mixing.mix(frame(spark, [])).collect() == []
    assert mixing.mixed(frame(spark, extra=True)).columns == frame(spark, extra=True).columns
