import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict

import pytest

from lexmill.llm import trie
from tests.llm.helpers import against_sql, prose

COLUMNS = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """The trie built in memory, one dictionary entry a sequence."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h, b = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        whole = (turns.get(b, [])[:h]) + turns[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    total = {}
    for s in sorted(members, key=len, reverse=True):
        saved = (len(members[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        total[s] = (sum(total[k][0] for k in kids[s]) or 1, saved + sum(total[k][1] for k in kids[s]))
    return sorted(
        ((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), *total[s], hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items()),
        key=repr,
    )


def got(spark, rows, parts=3):
    df = trie.prefix_trie(spark.createDataFrame(rows, COLUMNS).repartition(parts))
    assert tuple(df.columns) == NAMES
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 2, 5, 9)]
    rows = [(c, t, rng.choice(["user", "user", "assistant", None]), rng.choice(texts)) for c in range(130) if c % 7 for t in range(rng.randint(1, 6))]
    rows += [(7, None, "user", "of no turn"), (8, 2, "user", "tied"), (8, 2, "user", "tied"), (8, 2, None, None), (None, 1, "user", "of nobody"), (60, 1, "x", "y")]
    rows += [(c, t, "user", "all alike") for c in range(200, 260) for t in range(3)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[::-1], 5) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds most rows, and is deep, is dealt out; its digests go on from range to range."""
    rng = random.Random(2)
    deep = [("user", rng.choice("abc") * 3) for _ in range(700)]
    rows = [(c, i, r, t) for c in (20, 21, 39) for i, (r, t) in enumerate(deep[: 700 - c])] + [(c, i, "user", "short") for c in range(40, 60) for i in range(2)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(spark, rows) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    odd = [(-25, 0, "user", "below zero"), (-20, 0, "user", "its head"), (5, None, None, None), (2**53, 1, "ü", "𝒳 \x0b y"), (1, 0, "user", "w " * 200_000)]
    df = spark.createDataFrame(odd, COLUMNS)
    for name in ("c", "node", "parent", "d", "words", "range", "up", "own", "base", "last", "i", "saved"):
        df = df.selectExpr("*", f"cast(7 as int) as `{name}`")
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=repr) == brute(odd)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_against_sql(spark):
    assert against_sql(trie.op11_prefix_trie(spark, "/root/testdata/sf0.001"), trie.ORACLE_OP11, "/root/testdata/sf0.001") == []
