"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch, either, read, tune, whole_row

#: Rows whose crc32(doc_id as text) leaves remainder 0 by FOLDS are held out.
FOLDS = 5
THRESHOLD = 0.3
#: Shrinkage of a class covariance towards the pooled one, and of that towards its mean variance.
TO_POOLED, TO_SPHERE = 0.15, 0.02
#: Log-density differences are divided by this before the logistic, since the features are not independent draws.
TEMPER = 4.0
FEATURES = ("chars", "words", "word_length", "upper", "digits", "marks", "symbols", "distinct", "repeats", "shouts", "rows", "short_rows")

_classes = np.zeros(256, dtype=np.int64)
_classes[[*range(97, 123), *range(128, 256)]] = 1  # letters; bytes beyond ASCII nearly always belong to one
_classes[65:91] = 2
_classes[48:58] = 3
_classes[[ord(c) for c in ".,;:'\"-()?"]] = 4
_classes[[32, 9, 10, 11, 12, 13]] = 5
_classes[(_classes == 0)] = 6


def statistics(text: str | None) -> np.ndarray:
    """Counts of a whole text, each passed through a logarithm or a log-ratio so that a normal law fits better."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    by = np.bincount(_classes[np.frombuffer(raw, dtype=np.uint8)], minlength=7)
    words = raw.split()
    w = len(words)
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = by[1] + by[2]
    rows = raw.split(b"\n")
    short = sum(len(r) < 40 for r in rows)

    def ratio(k: float, of: float, by_: float = 0.5) -> float:
        return float(np.log((k + by_) / (max(of - k, 0) + by_ + 4)))

    shout = sum(1 for x in words if x[:1] and x.isupper() and len(x) > 3)
    return np.array([
        np.log1p(n), np.log1p(w), np.log((n - by[5] + 1) / (w + 1)), ratio(by[2], letters), ratio(by[3], n), ratio(by[4], n),
        ratio(by[6], n), ratio(distinct, w), ratio(repeats, w), ratio(shout, w), np.log1p(len(rows)), ratio(short, len(rows)),
    ])


def held_out(doc_id: Column, folds: int = FOLDS, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == remainder, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row; whole texts, null as empty."""
    rows = docs.select(either(docs, "doc_id", "long").alias("doc_id"), either(docs, "text", "string").alias("text"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            flat = np.concatenate(x) if x else np.zeros(0)
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "x"])

    return rows.mapInArrow(work, "doc_id long, x array<double>")


class Discriminant:
    """Two Gaussian classes with shrunk covariances; the Cholesky factors are computed once and kept."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        """Per class (0, 1): number of rows, sum of x, sum of outer products of x."""
        d = sums.shape[1]
        self.usable = bool((counts >= 2).all())
        total = counts.sum()
        self.prior = float((counts[1] + 1) / (total + 2))
        self.mean, self.factor, self.log_det = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
        #: Inverses of the factors: x - mean times this has the identity for its covariance.
        self.whiten = np.zeros((2, d, d))
        if not self.usable:
            return
        means = sums / counts[:, None]
        scatter = np.stack([squares[c] - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)])
        pooled = scatter.sum(axis=0) / total
        sphere = np.eye(d) * max(np.trace(pooled) / d, 1e-6)
        pooled = (1 - TO_SPHERE) * pooled + TO_SPHERE * sphere
        for c in (0, 1):
            cov = (1 - TO_POOLED) * scatter[c] / counts[c] + TO_POOLED * pooled
            cov = (1 - TO_SPHERE) * cov + TO_SPHERE * sphere
            self.mean[c], self.factor[c] = means[c], np.linalg.cholesky(cov)
            self.log_det[c] = 2 * np.log(np.diag(self.factor[c])).sum()
            self.whiten[c] = np.linalg.inv(self.factor[c]).T

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x; the class share where one class has no two rows."""
        if not self.usable:
            return np.full(len(x), self.prior)
        density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.whiten[c]
            density.append(-0.5 * ((z**2).sum(axis=1) + self.log_det[c]))
        gap = (density[1] - density[0]) / TEMPER + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Class moments over all labelled rows that are not held out, summed where the rows are.

    Labels other than 0 and 1 and null ids are passed over; an id labelled more than once counts once for each label
    it has. Counts, sums and outer products are added up as decimals, whose sum does not depend on the order, and two
    rows of them reach the driver.
    """
    d = len(FEATURES)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").distinct()
    rows = stats.filter(~held_out(F.col("doc_id"))).join(known, "doc_id").select("y", "x")

    def moments(batches):
        import pyarrow as pa

        acc = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                acc[c, 0] += len(own)
                acc[c, 1 : 1 + d] += own.sum(axis=0)
                acc[c, 1 + d :] += (own.T @ own).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(acc.tolist(), pa.list_(pa.float64()))], names=["y", "m"])

    each = rows.mapInArrow(moments, "y int, m array<double>").select("y", F.posexplode("m").alias("k", "v"))
    acc = np.zeros((2, 1 + d + d * d))
    for r in each.groupBy("y", "k").agg(F.sum(F.col("v").cast("decimal(34,14)")).alias("v")).collect():
        acc[r["y"], r["k"]] = float(r["v"])
    return Discriminant(acc[:, 0], acc[:, 1 : 1 + d], acc[:, 1 + d :].reshape(2, d, d))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Scores come from the text alone, read as a whole whatever its length. Null and empty texts are scored as the empty
    text; repeated rows get equal scores; a null id is not held out. Without two rows of each class the score is the
    smoothed share of class 1, a half without labels. An empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    tune(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(features(docs))
    model = fit(stats, labels)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() predicts as 1, with all their columns and no others, whatever their names.

    Rows keep their multiplicity; null and empty texts are judged as the empty text. An empty table gives an empty one.
    """
    tune(docs.sparkSession)
    model, names = fit(Scratch(docs.sparkSession, "quality").keep(features(docs)), labels), docs.columns

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.stack([statistics(t) for t in batch.column("text").to_pylist()]) if len(batch) else np.zeros((0, len(FEATURES)))
            rows = batch.column("row").filter(pa.array(model.score(x) >= THRESHOLD))
            yield pa.RecordBatch.from_arrays(rows.flatten(), names=names)

    return docs.select(whole_row(docs).alias("row"), either(docs, "text", "string").alias("text")).mapInArrow(work, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
