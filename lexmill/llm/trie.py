"""Conversation prefix trie: nodes keyed by digests, subtree sums by pointer jumping."""

from __future__ import annotations

import hashlib
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch, either, numbered, read, shared_dir, spread_join, tune

#: Conversations are rebuilt in blocks of so many ids, from fewer than HEADS of the block's first turns.
BLOCK, HEADS = 20, 4
#: Digests of sequences are polynomials over the digests of their turns, modulo a prime, at a fixed point.
PRIME, POINT = (1 << 127) - 1, 0x1B873593CC9E2D51E6546B64A3C59AC3 % ((1 << 127) - 1)
BACK = pow(POINT, -1, PRIME)
#: Ids in one piece of a list of members whose digest is taken.
PIECE = 4096

TURN = "struct<d: binary, words: long>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, d, words): a turn's digest, over role and text together, and the words of its text."""
    role, text = (F.coalesce(either(conversations, n, "string"), F.lit("")) for n in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
    rows = conversations.select(either(conversations, "conv_id", "long").alias("c"), either(conversations, "turn", "long").alias("turn"), role.alias("role"), digest.alias("d"), words.alias("words"))
    return rows.filter("c is not null")


def _heads(turns: DataFrame) -> DataFrame:
    """(c, own): the first HEADS - 1 turns of every conversation; no task sees more than those of one conversation."""
    from pyspark.sql import Window

    w = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "d")
    first = turns.withColumn("i", F.row_number().over(w)).filter(F.col("i") < HEADS)
    return first.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d", "words"))), lambda x: F.struct(x["d"].alias("d"), x["words"].alias("words"))).alias("own"))


def _value(digest: bytes) -> int:
    return int.from_bytes(digest[:16], "big") % PRIME


def _poly(digests) -> int:
    total, power = 0, 1
    for d in digests:
        total, power = (total + _value(d) * power) % PRIME, power * POINT % PRIME
    return total


class _Walk:
    """Goes through rows in the order of (c, header first, turn) and holds what the current conversation needs."""

    def __init__(self, state=None):
        """state: what the ranges before hold of a conversation that goes on here."""
        self.c, self.head, self.n, self.sum, self.power = None, None, 0, 0, 1
        if state:
            self.c, self.head, self.n, self.sum = state
            self.power = pow(POINT, self.n, PRIME)

    def opens(self, c, base, own):
        h = crc32(str(c).encode()) % HEADS
        shared, gone = base[:h], own[:h]
        self.c, self.n, self.sum, self.power = c, 0, 0, 1
        # own turns move from place h to place len(shared); what they add starts after the first h of them
        shift = pow(BACK, h - len(shared), PRIME)
        self.head = (h, len(shared), _poly(x["d"] for x in shared), shift, _poly(x["d"] for x in gone))
        return shared

    def turn(self, d):
        """The digest and depth of the sequence that ends with this turn, or None where it is left out."""
        self.sum = (self.sum + _value(d) * self.power) % PRIME
        self.power = self.power * POINT % PRIME
        self.n += 1
        h, k, before, shift, gone = self.head
        return None if self.n <= h else ((before + (self.sum - gone) * shift) % PRIME, k + self.n - h)


def _rows(batch):
    columns = [batch.column(n).to_pylist() for n in ("c", "header", "last", "d", "words", "base", "own")]
    return zip(*columns, strict=True)


def _name(depth: int, value: int) -> bytes:
    return hashlib.sha256(depth.to_bytes(8, "big") + value.to_bytes(16, "big")).digest()[:16]


def paths(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, parent, depth, c, words, ends): one row for each rebuilt conversation and depth, the root included.

    All turns lie in one order of (conversation, turn), dealt out in ranges, so that a conversation of any length is
    many tasks. A first pass gives what every range adds to the conversation that is open at its end, one row a range;
    from those each range knows what its first rows continue, and digests are worked out in one more pass. The order
    is held by checkpoint(), whose partitions stay what they are when executors are lost.
    """
    spark = turns.sparkSession
    shared_dir(spark)
    heads = scratch.keep(_heads(turns))
    base = heads.filter(F.col("c") % BLOCK == 0).select(F.col("c").alias("b"), F.col("own").alias("base"))
    none = F.array().cast(f"array<{TURN}>")
    headers = heads.join(base, F.col("c") - F.col("c") % BLOCK == F.col("b"), "left").select("c", F.lit(True).alias("header"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("d"), F.lit(0).cast("long").alias("words"), F.coalesce("base", none).alias("base"), "own")
    counts = turns.groupBy("c").agg(F.count("*").alias("last"))
    headers = headers.join(counts, "c")
    plain = turns.select("c", F.lit(False).alias("header"), "turn", "role", "d", "words", none.alias("base"), none.alias("own"), F.lit(None).cast("long").alias("last"))
    order = (F.col("c"), F.desc("header"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("d"))
    line = headers.unionByName(plain).orderBy(*order).select("c", "header", "last", "d", "words", "base", "own").withColumn("range", F.spark_partition_id()).checkpoint()

    def tails(batches):
        import pyarrow as pa

        walk, first, seen, opened, at, last = _Walk(), None, False, None, None, None
        for batch in batches:
            if batch.num_rows:
                at = batch.column("range")[0].as_py()
            for c, header, many, d, _, base_, own in _rows(batch):
                if not seen:
                    first, seen = c, True
                if header:
                    walk.opens(c, base_, own)
                    opened, last = (c, walk.head), many
                    continue
                if opened is None and walk.c is None:
                    walk.c = c
                walk.sum = (walk.sum + _value(d) * walk.power) % PRIME
                walk.power, walk.n = walk.power * POINT % PRIME, walk.n + 1
        if seen:
            import pickle

            row = pickle.dumps((first, opened, last, walk.n, walk.sum))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([row], pa.binary())], names=["range", "tail"])

    import pickle

    carry, state, ahead = {}, None, None
    for r in sorted(line.mapInArrow(tails, "range int, tail binary").collect(), key=lambda r: r["range"]):
        _, opened, last, n, total = pickle.loads(r["tail"])
        if state:
            carry[r["range"]] = (state, ahead)
        if opened:
            state, ahead = (opened[0], opened[1], n, total), last
        else:  # all rows go on with the conversation before
            c, head, before, sum_ = state
            state = (c, head, before + n, (sum_ + total * pow(POINT, before, PRIME)) % PRIME)
    root = _name(0, 0)

    def nodes(batches):
        import pyarrow as pa

        walk, last, begun, before = None, None, False, None
        for batch in batches:
            out = [[] for _ in range(6)]
            if not begun and batch.num_rows:
                state, last = carry.get(batch.column("range")[0].as_py(), (None, None))
                walk, begun = _Walk(state), True
                if state:
                    before = _before(walk)

            def add(depth, value, c, words, ends):
                nonlocal before
                name = _name(depth, value)
                for column, v in zip(out, (name, before if depth else None, depth, c, words, ends), strict=True):
                    column.append(v)
                before = name

            for c, header, many, d, words, base_, own in _rows(batch):
                if header:
                    shared, last, before = walk.opens(c, base_, own), many, root
                    bare = many <= walk.head[0]
                    add(0, 0, c, 0, bare and not shared)
                    for i in range(len(shared)):
                        add(i + 1, _poly(x["d"] for x in shared[: i + 1]), c, shared[i]["words"], bare and i + 1 == len(shared))
                    continue
                found = walk.turn(d)
                if found:
                    add(found[1], found[0], c, words, walk.n == last)
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["node", "parent", "depth", "c", "words", "ends"])

    def _before(walk):
        h, k, shared, shift, gone = walk.head
        if walk.n <= h:
            return _name(k, shared)
        return _name(k + walk.n - h, (shared + (walk.sum - gone) * shift) % PRIME)

    return line.mapInArrow(nodes, "node binary, parent binary, depth long, c long, words long, ends boolean")


def rolled_up(nodes: DataFrame, deepest: int, scratch: Scratch) -> DataFrame:
    """(node, n_leaves, saved) summed over each node's subtree, from (node, parent, n_leaves, saved).

    After round t a node holds the sum over its subtree less than 2^t levels below it, and its pointer names the
    ancestor 2^t above: it adds what those hold that point to it, then pointers jump to the pointers of what they name.
    Rounds are the logarithm of the depth. Nodes whose pointer runs past the root move no more; what points to one node
    is added up before it is moved, and a pointer that very many share is met in place.
    """
    held = scratch.keep(nodes.select("node", "n_leaves", "saved"))
    links = scratch.keep(nodes.filter("parent is not null").select("node", F.col("parent").alias("up")))
    reach = 1
    while reach <= deepest:
        below = links.join(held, "node").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        none = F.lit(0).cast("long")
        grown = held.join(below, "node", "left").select("node", (F.col("n_leaves") + F.coalesce("more_leaves", none)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", none)).alias("saved"))
        held_next = scratch.keep(grown)
        reach *= 2
        if reach <= deepest:
            jumps = links.select(F.col("node").alias("up"), F.col("up").alias("next"))
            links_next = scratch.keep(spread_join(links, jumps, "up", scratch).filter("next is not null").select("node", F.col("next").alias("up")))
            scratch.drop(links)
            links = links_next
        scratch.drop(held)
        held = held_next
    return held


def ends_digests(paths_: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes with which conversations end.

    Ids are sorted by (node, id) in ranges, so that a node that very many share is many tasks, which join their ids to
    pieces of text; a second pass takes the digest over the pieces of a node in order, without holding them.
    """
    ends = paths_.filter("ends").select("node", "c").orderBy("node", "c")

    def pieces(batches):
        import pyarrow as pa

        node, first, ids = None, 0, []
        out = [[], [], []]

        def close():
            for column, v in zip(out, (node, first, ",".join(map(str, ids))), strict=True):
                column.append(v)

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["node", "first", "ids"])

        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if n != node or len(ids) == PIECE:
                    if ids:
                        close()
                    node, first, ids = n, c, []
                ids.append(c)
            if out[0]:
                yield batch_of()
                out = [[], [], []]
        if ids:
            close()
            yield batch_of()

    def digests(batches):
        import pyarrow as pa

        node, digest = None, None
        for batch in batches:
            out = [[], []]
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out[0].append(node)
                    out[1].append(digest.hexdigest())
                node, digest = n, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    cut = ends.mapInArrow(pieces, "node binary, first long, ids string")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    Conversation c is rebuilt from the first h turns of c - c % 20 and its own turns after its first h, h being
    crc32 of c modulo 4. Turns are ordered by turn (null first), then role, then the digest of role and text; null roles
    and texts are empty. A node is a distinct sequence of turns; its key is a digest, in which each turn enters by 127
    bits. Rows of a null conv_id belong to no conversation and are passed over; repeated rows are turns of their own;
    an empty table has no conversation and gives no node, not even the root. Words of very long texts are counted as a
    whole. Other columns are not read, whatever their names.
    """
    spark = conversations.sparkSession
    tune(spark)
    scratch = scratch or Scratch(spark, "trie")
    turns = scratch.keep(turns_of(conversations))
    rows = scratch.keep(paths(turns, scratch))
    nodes = rows.groupBy("node").agg(F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("words").alias("words"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"))
    nodes = scratch.keep(nodes)
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    sized = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    named = scratch.keep(spread_join(sized, nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", scratch))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = named.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    summed = rolled_up(own, deepest, scratch)
    full = named.join(summed, "node").join(ends_digests(rows), "node", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations."""
    return prefix_trie(read(spark, sf_dir, "conversations"))


ORACLE_OP11 = rf"""
WITH RECURSIVE crc AS MATERIALIZED (  -- the table of the reflected polynomial, by eight shifts
  SELECT i, 0 AS k, i AS v FROM range(256) AS t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8
), tab AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8
), turns AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS MATERIALIZED (
  SELECT c, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda j: CAST(ascii(substr(CAST(c AS VARCHAR), j, 1)) AS BIGINT))),
            lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) % {HEADS} AS h
  FROM (SELECT DISTINCT c FROM turns), tab
), rebuilt AS MATERIALIZED (
  SELECT v.c, 0 AS part, b.i, b.role, b.text FROM convs v JOIN turns b ON b.c = v.c - v.c % {BLOCK} AND b.i < v.h
  UNION ALL
  SELECT v.c, 1, o.i, o.role, o.text FROM convs v JOIN turns o ON o.c = v.c AND o.i >= v.h
), seq AS MATERIALIZED (
  SELECT c, row_number() OVER w AS depth, text,
         string_agg(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), paths AS MATERIALIZED (
  SELECT c, depth, path, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM seq
  UNION ALL SELECT c, 0, '', 0 FROM convs
), ended AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM paths
), nodes AS MATERIALIZED (
  SELECT path, min(c) AS conv_id, min(depth) AS depth, min(words) AS words, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends
  FROM ended GROUP BY path
), linked AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS above
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
), kids AS (
  SELECT above AS path, count(*) AS n_children FROM linked WHERE above IS NOT NULL GROUP BY above
), own AS MATERIALIZED (
  SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k USING (path)
), under AS (  -- a node lies below every shorter sequence of its smallest member
  SELECT a.path, CAST(sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
         CAST(sum((o.n_convs - 1) * o.words) AS BIGINT) AS saved_tokens
  FROM own o JOIN paths a ON a.c = o.conv_id AND a.depth <= o.depth GROUP BY a.path
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM own JOIN under USING (path)
"""
