"""Suffix-array dedup: every byte inside a string that occurs twice goes, wherever its copies stand.

A suffix array over every byte position would hold the corpus many times over, so the array is sparse. Every window of
SPAN bytes picks its anchor, the position in it whose K-byte hash is least (the first, of equals). The choice depends on
the window's bytes alone, so two equal windows pick the same place in them. Sorting the suffixes that start at anchors,
group by group of equal first K bytes, therefore meets every pair of equal windows, and a stack scan over common
prefixes yields the tree of intervals in which the occurrences of a right context stand together. Their left contexts
then tell how far to the left each occurrence still agrees with another one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Bitmap, Scratch, either, mix64, read, tune

#: Bytes of a string that must occur twice, and bytes of an anchor's hash.
SPAN, K = 200, 64
#: Contexts that one task sorts together; larger groups are split by the bytes around their anchor first.
GROUP = 8192
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_bytes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))


def prefix_sums(raw: bytes, powers: Powers) -> np.ndarray:
    """Polynomial hashes of all prefixes; hash_of takes the hash of any substring from them."""
    powers.reach(len(raw) + 1)
    with np.errstate(over="ignore"):
        terms = _bytes[np.frombuffer(raw, dtype=np.uint8)] * powers.up[: len(raw)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])


def hash_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((sums[end] - sums[start]) * powers.down[start] + (end - start).astype(np.uint64))


def anchors(raw: bytes, powers: Powers, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): the anchors of a text, each with the range of window starts that pick it."""
    n = len(raw)
    if n < SPAN:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    if sums is None:
        sums = prefix_sums(raw, powers)
    at = np.arange(n - K + 1, dtype=np.int64)
    key = (hash_of(sums, at, at + K, powers) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, least, done = SPAN - K + 1, key, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    pick = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(pick)) + 1])
    last = np.concatenate([first[1:] - 1, [len(pick) - 1]])
    return pick[first], first, last


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """The tree of common-prefix intervals of a sorted array: (prefix length, first, last), children before parents.

    lcp[i] is the common prefix of entries i - 1 and i; lcp[0] is not read. Intervals of prefix length 0 are left out.
    """
    found, stack = [], [(0, 0)]  # prefix length, first entry
    n = len(lcp)
    for i in range(1, n + 1):
        here = lcp[i] if i < n else 0
        first = i - 1
        while stack[-1][0] > here:
            length, first = stack.pop()
            found.append((length, first, i - 1))
        if stack[-1][0] < here:
            stack.append((here, first))
    return found


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), width)


def _common(m: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of rows a and b, pair by pair."""
    if not m.shape[1] or not len(a):
        return np.zeros(len(a), dtype=np.int64)
    differ = m[a] != m[b]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(at, np.minimum(size[a], size[b]))


def agreements(left: list[bytes], right: list[bytes], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each occurrence of an anchor string, the maximal (bytes to the left, bytes to the right) it has in common
    with another one, of at least span bytes together.

    right holds the bytes from the anchor on, left those before it, nearest first. The entries are sorted by right; in
    each interval of a common right prefix the occurrences are then ordered by left. An occurrence whose left context
    is already shared in full by a child interval gains nothing in the parent: only intervals where left extensions
    are diverse go on.
    """
    n = len(right)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n < 2:
        return out
    order = np.array(sorted(range(n), key=right.__getitem__), dtype=np.int64)
    r_size, l_size = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    r, lft = _matrix(right, int(r_size.max())), _matrix(left, int(l_size.max()))
    lcp = [0, *_common(r, r_size, order[:-1], order[1:]).tolist()]
    l_rank = np.empty(n, dtype=np.int64)
    l_rank[sorted(range(n), key=left.__getitem__)] = np.arange(n)
    reached = np.full(n, -1, dtype=np.int64)
    for length, first, last in intervals(lcp):
        who = order[first : last + 1]
        if (reached[who] >= l_size[who]).all() or length + l_size[who].max() < span:
            continue
        who = who[np.argsort(l_rank[who])]
        near = _common(lft, l_size, who[:-1], who[1:])
        best = np.maximum(np.concatenate([[0], near]), np.concatenate([near, [0]]))
        gain = (best > reached[who]) & (best + length >= span)
        for i, g in zip(who[gain].tolist(), best[gain].tolist(), strict=True):
            out[i].append((g, length))
            reached[i] = g
    return out


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """(id, twin, a, lo, hi, h, c, c2): anchors with the hash of their string and two of their whole context."""

    def work(batches):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            counts = []
            for text in batch.column("text").to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < SPAN:
                    counts.append(0)
                    continue
                sums = prefix_sums(raw, powers)
                a, lo, hi = anchors(raw, powers, sums)
                with np.errstate(over="ignore"):
                    c = mix64(hash_of(sums, lo, hi + SPAN, powers) + (a - lo).astype(np.uint64) * np.uint64(_BASE))
                c2 = np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(lo.tolist(), (hi + SPAN).tolist(), strict=True)], dtype=np.uint64)
                for p, v in zip(parts, (a, lo, hi, hash_of(sums, a, a + K, powers).view(np.int64), c.view(np.int64), c2.view(np.int64)), strict=True):
                    p.append(v)
                counts.append(len(a))
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            a, lo, hi, h, c, c2 = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("twin").take(take), *(pa.array(x.astype(np.int32)) for x in (a, lo, hi)), pa.array(h), pa.array(c), pa.array(c2)], names=["id", "twin", "a", "lo", "hi", "h", "c", "c2"])

    return rows.mapInArrow(work, "id long, twin long, a int, lo int, hi int, h long, c long, c2 long")


def _contexts(joined: DataFrame) -> DataFrame:
    """(h, single, id, twin, a, lo, hi, left, right) from rows (id, twin, text, at)."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(9)]
            for doc, twin, text, at in zip(*(batch.column(c).to_pylist() for c in ("id", "twin", "text", "at")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in at:
                    a, lo, hi = x["a"], x["lo"], x["hi"]
                    for col, v in zip(out, (x["h"], x["n"] == 1, doc, twin, a, lo, hi, raw[lo:a][::-1], raw[a : hi + SPAN]), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["h", "single", "id", "twin", "a", "lo", "hi", "left", "right"])

    return joined.mapInArrow(work, "h long, single boolean, id long, twin long, a int, lo int, hi int, left binary, right binary")


def _scanned(contexts: DataFrame) -> DataFrame:
    """(id, twin, start, end) of what single contexts share with others of their group g, by its interval tree."""

    def work(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def solve(group: list[tuple]):
            if len(group) < 2:
                return
            for row, pairs in zip(group, agreements([g[7] for g in group], [g[8] for g in group]), strict=True):
                if row[1]:
                    for back, ahead in pairs:
                        yield row[2], row[3], row[4] - back, row[4] + ahead

        def table(rows):
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "twin", "start", "end"])

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    found += solve(held)
                    held = []
                held.append(row)
            if found:
                yield table(found)
        yield table(list(solve(held)))

    sorted_ = contexts.select("g", "single", "id", "twin", "a", "lo", "hi", "left", "right").repartition("g").sortWithinPartitions("g")
    return sorted_.mapInArrow(work, "id long, twin long, start int, end int")


def _shared(scratch: Scratch, contexts: DataFrame) -> DataFrame:
    """(id, twin, start, end) of what single contexts share with others of their anchor string, however many there are.

    All of a group share r bytes from the anchor on and l before it. Two that share SPAN bytes around it either share
    mid > r bytes to the right, or fewer and so SPAN - mid + 1 to the left: a group too large for one task becomes two
    sets of groups, of equal bytes to the right and to the left, and what is missing to SPAN is half of what it was.
    Once nothing is missing all of a group have one string of SPAN bytes in common, which needs no tree.
    """
    found, rest = [], ["single", "id", "twin", "a", "lo", "hi", "left", "right"]
    state = contexts.select(F.col("h").cast("string").alias("g"), F.lit(K).alias("r"), F.lit(0).alias("l"), *rest)
    while True:
        big = scratch.keep(state.groupBy("g").agg(F.count("*").alias("n"), F.bool_or("single").alias("some")).filter((F.col("n") > GROUP) & F.col("some")).select("g"))
        if big.isEmpty():
            found.append(_scanned(state))
            return reduce(DataFrame.union, found)
        found.append(_scanned(state.join(big, "g", "left_anti")))
        hot = state.join(big, "g").withColumn("lacks", F.lit(SPAN) - F.col("r") - F.col("l"))
        found.append(hot.filter("lacks <= 0 and single").select("id", "twin", (F.col("a") - F.col("l")).alias("start"), (F.col("a") + F.col("r")).alias("end")))
        mid = (F.col("r") + F.floor((F.col("lacks") + 1) / 2)).cast("int")
        sides = []
        for r, l in ((mid, F.col("l")), (F.col("r"), F.lit(SPAN + 1) - mid)):
            side = hot.filter("lacks > 0").withColumns({"r2": r, "l2": l}).filter("octet_length(right) >= r2 and octet_length(left) >= l2")
            own = F.sha2(F.concat(F.expr("substring(left, 1, l2)"), F.expr("substring(right, 1, r2)")), 256)
            sides.append(side.select(F.concat_ws("|", own, "r2", "l2").alias("g"), F.col("r2").alias("r"), F.col("l2").alias("l"), *rest))
        state = scratch.keep(sides[0].union(sides[1]))


def _merged(rows: DataFrame) -> DataFrame:
    """Final columns from (id, text, spans): spans merged, their bytes taken out."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                for col, v in zip(out, (doc, len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), ",".join(f"{a}:{b}" for a, b in runs)), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def repeated_spans(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, twin, spans): for each row with repeated strings, the byte ranges found, not yet merged.

    twin is a hash of the text, so that rows of one doc_id with different texts are kept apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    rows = _texts(docs)
    all_ = scratch.keep(_anchor_rows(rows))
    twice = scratch.keep(all_.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"))
    # Anchors whose string occurs once are dropped before anything but their hash is moved.
    found = scratch.keep(all_.filter(Bitmap(twice, "h", 1 << 24).maybe("h")).join(twice, "h"))
    scratch.drop(all_, twice)
    place = F.struct("id", "twin", "a", "lo", "hi")
    kinds = scratch.keep(found.groupBy("h", "c", "c2").agg(F.count("*").alias("n"), F.min(place).alias("one")))
    # A context that occurs twice as a whole is repeated in all its windows; three hashes of 64 bits tell that.
    whole = found.join(kinds.filter("n > 1").select("h", "c", "c2"), ["h", "c", "c2"]).select("id", "twin", F.col("lo").alias("start"), (F.col("hi") + SPAN).alias("end"))
    mixed = kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("least = 1 and m > 1").select("h")
    todo = scratch.keep(kinds.join(mixed, "h").select("h", "n", "one.*"))
    per_doc = todo.groupBy("id", "twin").agg(F.collect_list(F.struct("h", "n", "a", "lo", "hi")).alias("at"))
    thin = rows.filter(Bitmap(todo, "id").maybe("id"))
    texts = thin.join(per_doc, ["id", "twin"])
    contexts = scratch.keep(_contexts(texts))
    parts = scratch.keep(_shared(scratch, contexts))
    scratch.drop(contexts)
    return scratch.keep(whole.union(parts).groupBy("id", "twin").agg(F.collect_list(F.struct("start", "end")).alias("spans")))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(either(docs, "text", "string"), F.lit(""))
    doc = either(docs, "doc_id", "long")
    # A null id is told from the number that stands for it by the twin.
    return docs.select(F.coalesce(doc, F.lit(-1).cast("long")).alias("id"), F.xxhash64(text, doc.isNull()).alias("twin"), text.alias("text"), doc.alias("doc_id"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of docs.

    Each byte goes that lies in a string of SPAN bytes which also starts elsewhere, in any row or the same one,
    overlaps included; strings are judged on the input. spans lists the removed runs as start:end in bytes. Null
    texts count as empty; texts under SPAN bytes are never touched; repeated rows are copies of each other. A null
    doc_id is a row like any other. An empty table gives an empty result; other columns are not read.
    """
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, scratch)
    rows = _texts(docs)
    hit = Bitmap(spans, "id")
    touched = rows.filter(hit.maybe("id")).join(spans, ["id", "twin"], "left").select(F.col("doc_id").alias("id"), "text", "spans")
    zero = F.lit(0).cast("long")
    intact = rows.filter(~hit.maybe("id")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.lit("").alias("spans"))
    return intact.unionByName(_merged(touched))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every document; spans is added."""
    return remove_repeats(read(spark, sf_dir, "documents"))


#: From byte ranges s (doc_id, a, b) of texts d (doc_id, h in hexadecimal) to the columns of the result.
REMOVED_SQL = """o AS (
  SELECT doc_id, a, b, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s
), m AS (
  SELECT doc_id, a, b, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM o
), r AS (
  SELECT doc_id, run, min(a) AS a, max(b) AS b FROM m GROUP BY doc_id, run
), g AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r
), t AS (
  SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS runs,
         string_agg(a || ':' || b, ',' ORDER BY a) AS spans
  FROM g JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (doc_id)
"""

#: Windows are cut from blocks of 1,000 bytes, since a place far in a long text is slow to reach.
ORACLE_OP8 = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), e AS (
  SELECT doc_id, h, unnest(range(0, length(h) // 2, 1000)) AS o FROM d
), c AS (
  SELECT doc_id, o, substr(h, 2 * o + 1, 2 * {1000 + SPAN - 1}) AS part FROM e
), q AS (
  SELECT doc_id, o, part, unnest(range(0, length(part) // 2 - {SPAN - 1})) AS p FROM c
), w AS (
  SELECT doc_id, o + p AS p, md5(substr(part, 2 * p + 1, {2 * SPAN})) AS x FROM q
), z AS (
  SELECT x FROM w GROUP BY x HAVING count(*) > 1
), s AS (
  SELECT doc_id, p AS a, p + {SPAN} AS b FROM w JOIN z USING (x)
), {REMOVED_SQL}"""
