"""Vector code compression: integer product codes, assigned by partial-distance search."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch, either, read, spread_join, tune

#: Parts of a vector, entries of a part's codebook, rounds of learning, and the factor before the floor.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components beyond this are held at it, so that squared distances of 8,192 dimensions fit a long.
LIMIT = 1 << 24


class Book:
    """The codebook of one part, with its dimensions in descending order of their variance over the entries."""

    def __init__(self, entries: np.ndarray):
        """entries: whole numbers, one row an entry."""
        self.entries = entries.astype(np.int64)
        spread = self.entries.astype(np.float64).var(axis=0) if len(entries) else np.zeros(entries.shape[1])
        self.order = np.argsort(-spread, kind="stable")

    def complete(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Distances of rows to one entry each, over all dimensions."""
        return ((x - self.entries[entry]) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row: the least distance, ties to the lower index.

        Distances grow dimension by dimension. The best complete distance so far is that of the entry that was ahead
        at some dimension; an entry leaves once its accumulated distance strictly exceeds it, so that ties survive.
        """
        n = len(x)
        if not n or not self.order.size:
            return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        first = (x[:, self.order[0], None] - self.entries[None, :, self.order[0]]) ** 2
        best = self.complete(x, first.argmin(axis=1))
        row, entry = np.nonzero(first <= best[:, None])
        so_far = first[row, entry]
        for d in self.order[1:]:
            so_far = so_far + (x[row, d] - self.entries[entry, d]) ** 2
            starts = np.searchsorted(row, np.arange(n))
            ahead = self._first_least(row, so_far, starts)
            best = np.minimum(best, self.complete(x, entry[ahead]))
            stays = so_far <= best[row]
            row, entry, so_far = row[stays], entry[stays], so_far[stays]
        won = self._first_least(row, so_far, np.searchsorted(row, np.arange(n)))
        return entry[won], so_far[won]

    @staticmethod
    def _first_least(row: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each row, where the first of its least values stands; no row is without one."""
        least = np.minimum.reduceat(value, starts)
        at = np.nonzero(value == least[row])[0]
        return at[np.searchsorted(row[at], np.arange(len(starts)))]


def whole_numbers(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(vec_id, label, q) of the vectors that take part, q being their whole-number components."""
    v = F.col("v")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    q = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(either(vectors, "vec_id", "long").alias("vec_id"), label.alias("label"), either(vectors, "embedding", "array<double>").alias("v"))
    kept = scratch.keep(rows.filter(good).select("vec_id", "label", q.alias("q")))
    usual = kept.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return kept.filter((F.size("q") == usual[0]["n"]) & (F.size("q") > 0)) if usual else kept


def _assigned(batch, books: list[Book], cuts: list[tuple[int, int]]):
    x = batch.column("q").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, cuts[-1][1])
    for book, (a, b) in zip(books, cuts, strict=True):
        part = x[:, a:b]
        yield part, *book.nearest(part)


def _learned(rows: DataFrame, books: list[Book], cuts: list[tuple[int, int]]) -> list[Book]:
    """The next codebooks: every entry is the floor of the mean of its parts, and stays where it has none.

    Each task adds up its own rows; what is shuffled is one row an entry and task, what reaches the driver one an entry.
    """
    width = max(b - a for a, b in cuts)

    def work(batches):
        import pyarrow as pa

        total = np.zeros((len(cuts), ENTRIES, 1 + width), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, (part, entry, _) in enumerate(_assigned(batch, books, cuts)):
                np.add.at(total[p, :, 0], entry, 1)
                np.add.at(total[p, :, 1 : 1 + part.shape[1]], entry, part)
        p, e = np.nonzero(total[:, :, 0])
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), *(pa.array(total[p, e, k]) for k in range(1 + width))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    sums = [f"s{k}" for k in range(1 + width)]
    names = ["p", "e", *sums]
    each = rows.select("q").mapInArrow(work, "p int, e int, " + ", ".join(f"{s} long" for s in sums))
    out = [book.entries.copy() for book in books]
    for r in each.groupBy("p", "e").agg(*[F.sum(s).alias(s) for s in sums]).collect():
        a, b = cuts[r["p"]]
        out[r["p"]][r["e"]] = [r[f"s{1 + k}"] // r["s0"] for k in range(b - a)]
    return [Book(entries) for entries in out]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scratch: Scratch | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), codebooks) of vectors with vec_id, embedding and, where there is one, label.

    Components become floor(256 * x); a vector is cut into equal consecutive parts. A part's codebook starts as that
    part of the entries with the smallest vec_ids, ascending (of one vec_id, by its components), and is learned in
    rounds of assigning and averaging, all in whole numbers, so that no order of adding changes anything. A code is the
    index of the nearest entry of every part, two hex digits each; error is the sum of the squared distances.

    Vectors that are null, or hold null or non-finite components, take no part, nor do those of another length than
    most (of lengths equally common the greatest counts) and empty ones. A length that the parts do not divide is cut
    as evenly as whole numbers allow. Rows of a null vec_id are coded and never start a codebook; repeated rows count
    each. Fewer rows than entries make shorter codebooks; without any the result is empty. Components of 65,536 and
    more are held there. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = scratch or Scratch(spark, "codes")
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"a codebook has 1 to {ENTRIES} entries")
    rows = whole_numbers(vectors, scratch)
    seeds = [r["q"] for r in rows.filter("vec_id is not null").orderBy("vec_id", "q").limit(entries).collect()]
    if not seeds:
        return rows.filter("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    seed = np.array(seeds, dtype=np.int64)
    ends = [seed.shape[1] * p // parts for p in range(parts + 1)]
    cuts = list(zip(ends, ends[1:], strict=False))
    books = [Book(seed[:, a:b]) for a, b in cuts]
    for _ in range(rounds):
        books = _learned(rows, books, cuts)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.zeros((batch.num_rows, parts), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for p, (_, entry, distance) in enumerate(_assigned(batch, books, cuts)):
                code[:, p] = entry
                error += distance
            texts = pa.array([r.tobytes().hex() for r in code])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), texts, pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(work, f"vec_id long, label {label}, code string, error long"), [b.entries for b in books]


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for every vector that takes part.

    The sum over a label is added up where the rows are; labels that hold a large share of the rows meet their sum in
    place, all others by a shuffle, so that no label fills a task.
    """
    scratch = Scratch(spark, "codes")
    coded, books = compress(read(spark, sf_dir, "embeddings"), scratch=scratch)
    coded = scratch.keep(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    joined = spread_join(coded, sums, "label", scratch)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """Every vector as one row a part; each assignment is the least of (distance, index) over the codebook."""

    def assigned(book: str) -> str:
        return f"""
  SELECT v.vec_id, v.label, v.p, v.part, min(struct_pack(d := list_sum(list_transform(list_zip(v.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.e)) AS best
  FROM parts v JOIN {book} b ON v.p = b.p
  GROUP BY v.vec_id, v.label, v.p, v.part"""

    def averaged(rows: str, book: str) -> str:
        return f"""
  SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry
  FROM {book} b LEFT JOIN (
    SELECT p, e, list(v ORDER BY k) AS entry
    FROM (
      SELECT p, best.e AS e, k, CAST(floor(sum(part[k]) / count(*)) AS BIGINT) AS v
      FROM {rows}, unnest(range(1, len(part) + 1)) AS t(k) GROUP BY p, best.e, k
    ) GROUP BY p, e
  ) m ON b.p = m.p AND b.e = m.e"""

    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS part
  FROM kept, unnest(range({PARTS})) AS t(p)
), seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}
), book0 AS MATERIALIZED (
  SELECT p, e, part AS entry FROM seeds JOIN parts USING (vec_id)
), near0 AS MATERIALIZED ({assigned("book0")}
), book1 AS MATERIALIZED ({averaged("near0", "book0")}
), near1 AS MATERIALIZED ({assigned("book1")}
), book2 AS MATERIALIZED ({averaged("near1", "book1")}
), near2 AS MATERIALIZED ({assigned("book2")}
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id, label
), flat AS (
  SELECT sha256(string_agg(CAST(entry[k] AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256
  FROM book2, unnest(range(1, len(entry) + 1)) AS t(k)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, flat
"""


ORACLE_OP12 = _oracle()
