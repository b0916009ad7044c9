"""Toxicity: a weighted lexicon of word beginnings, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import re
import unicodedata
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch, either, read, tune
from lexmill.llm.quality import held_out

#: Rows that are held out: crc32(doc_id as text) modulo FOLDS is 0. Predicted 1 from this score on.
FOLDS, THRESHOLD = 5, 0.5
#: The lexicon is learned from so many labelled documents of each class at most, those with the smallest hashes.
SAMPLE_DOCS = 4000
#: Entries of the lexicon at most, the most telling first; candidates that the driver looks through for them.
LEXICON, CANDIDATES = 4096, 65536
#: Letters of an entry. Words of scripts without spaces give entries anywhere in them, of GRAMS letters.
SHORTEST, LONGEST, GRAMS = 3, 16, (2, 3, 4)
#: An entry stands in this many toxic documents at least, and chance would bring it so far with this probability at most.
LEAST_DOCS, CHANCE = 3, 0.02
#: Counts that a task holds before it hands them on.
HELD = 400_000

#: Phrases in which an entry of the lexicon means no offence; what lies within one does not count.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "clownfish", "class clown", "pond scum", "idiot proof", "stupid simple", "loser bracket", "sore loser rule", "worthless stock")

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l",
}
# Digits and signs written for letters. 1 stands for i and for l, so both are folded to i.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

_glyphs = str.maketrans(HOMOGLYPHS)
_signs = str.maketrans(SUBSTITUTES)
_marks = re.compile("[̀-ͯ]+")
_written = re.compile(r"[0-9@$!|+]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9]+")
_apart = re.compile(r"[\W\d_]+")
_unspaced = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")


def fold(text: str | None) -> str:
    """The words of a text, each after one space: lower case, without accents, homoglyphs and signs for letters."""
    text = (text or "").lower()
    if not text.isascii():
        text = _marks.sub("", unicodedata.normalize("NFKD", text)).translate(_glyphs)
    text = _written.sub(lambda m: m[0].translate(_signs), text)
    return " " + _apart.sub(" ", text).strip().replace("l", "i")


def entries_of(word: str) -> list[str]:
    """What of a word may enter the lexicon: its beginnings, written after a space; in unspaced scripts, its grams."""
    if _unspaced.search(word):
        return [word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1)]
    return [" " + word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]


class Lexicon:
    """Entries with their weights, exception phrases and what turns weight and length into a score."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS, line=(0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.line, self._automaton = weights, tuple(exceptions), line, None

    def __getstate__(self):  # each worker builds its own automaton
        return self.__dict__ | {"_automaton": None}

    def _built(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                a.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                if (folded := fold(phrase)).strip():
                    a.add_word(folded + " ", (len(folded) + 1, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def measure(self, text: str | None) -> tuple[float, int]:
        """(weight of the matches, words) of a whole text; matches within an exception phrase weigh nothing."""
        folded = fold(text) + " "
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not len(self._built()):
            return 0.0, words
        hits, spared = [], []
        for end, (length, weight) in self._automaton.iter(folded):
            (spared if weight is None else hits).append((end - length + 1, end, weight))
        if spared and hits:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)]
        return float(sum(h[2] for h in hits)), words

    def terms(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        """What the score is linear in: a constant, the weight in a hundred words, and the weight as such."""
        return np.stack([np.ones(len(weight)), np.log1p(100 * weight / (words + 20)), np.log1p(weight) / 4], axis=1)

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = self.terms(weight, words) @ np.array(self.line)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(either(docs, "doc_id", "long").alias("doc_id"), either(docs, "text", "string").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, most: int, scratch: Scratch) -> tuple[DataFrame, tuple[int, int]]:
    """((y, text) of labelled rows that are not held out, the number of all such labels of each class).

    At most so many ids of each class, those with the smallest hashes. Labels other than 0 and 1 and null ids are
    passed over; an id labelled twice counts once for each label it has; all rows of a repeated id are in. Copies are
    no evidence of their own: of texts of one class with the same least or the same greatest hash of five words, as near
    copies mostly have, one stays.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter("y in (0, 1) and id is not null").filter(~held_out(F.col("id"), FOLDS)).distinct()
    known = scratch.keep(known)
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = (F.xxhash64("id"), F.col("id"))
    chosen = known.filter("y = 0").orderBy(*order).limit(most).unionByName(known.filter("y = 1").orderBy(*order).limit(most))
    rows = _texts(docs)
    joined = rows.join(F.broadcast(scratch.keep(chosen)), rows["doc_id"] == F.col("id"))

    def sketched(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [(t or "").lower().split() for t in texts]
            runs = [[crc32(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(len(w) - 4, 1))] for w in words]
            ends = [pa.array([f(r) for r in runs], pa.int64()) for f in (min, max)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("text"), *ends], names=["y", "text", "low", "high"])

    rows = joined.select("y", "text").mapInArrow(sketched, "y int, text string, low long, high long")
    for end in ("low", "high"):
        rows = rows.groupBy("y", end).agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "low", "high")).alias("t")).select("y", "t.*")
    return scratch.keep(rows.select("y", "text")), (total.get(0, 0), total.get(1, 0))


def weights_of(counts: list[tuple[str, int, int]], clean: int, toxic: int, candidates: int) -> dict[str, float]:
    """The lexicon from (entry, toxic documents, clean documents): entries that chance does not explain, each with the
    logarithm of how much more frequent it is among toxic documents.

    Of a chain of beginnings one is taken, the most telling, and of equally telling ones the longest. The bound is
    Chernoff's for the share of toxic documents among those that have the entry, over all candidates at once.
    """
    if not clean or not toxic:
        return {}
    p = toxic / (clean + toxic)
    least = np.log(max(candidates, 1) / CHANCE)

    def evidence(a: int, b: int) -> float:
        q = a / (a + b)
        return (a + b) * (q * np.log(q / p) + (0 if q == 1 else (1 - q) * np.log((1 - q) / (1 - p)))) if q > p else 0.0

    ranked = sorted(((evidence(a, b), len(e), e, a, b) for e, a, b in counts), key=lambda r: (-r[0], -r[1], r[2]))
    out, inside, beginnings = {}, set(), set()
    for strong, _, entry, a, b in ranked:
        if strong < least or a < LEAST_DOCS or len(out) == LEXICON:
            break
        own = {entry[:n] for n in range(1, len(entry) + 1)} if entry[0] == " " else {entry}
        if entry in beginnings or own & inside:
            continue
        inside.add(entry)
        beginnings |= own
        out[entry] = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
    return out


def learn(rows: DataFrame, totals: tuple[int, int], exceptions=EXCEPTIONS) -> Lexicon:
    """The lexicon of (y, text) rows, with the line that turns weights into scores.

    Documents are counted where they are, once for each entry they hold; what reaches the driver is CANDIDATES entries
    at most and a few sums a step. The line is a logistic one with a ridge, found by Newton's steps; its constant is set
    for the shares of the classes among all labels, whatever those of the sample.
    """

    def counted(batches):
        from collections import Counter

        import pyarrow as pa

        def out():
            keys = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["entry", "a", "b"])

        seen = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[y].update({e for w in set(fold(text).split()) for e in entries_of(w)})
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield out()
                    seen[0].clear()
                    seen[1].clear()
        yield out()

    held = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    clean, toxic = held.get(0, 0), held.get(1, 0)
    every = rows.mapInArrow(counted, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    often = every.filter(F.col("a") >= LEAST_DOCS)
    often = often.filter(F.col("a") * clean > F.col("b") * toxic).orderBy(F.desc(F.col("a") - F.col("b") * (toxic / max(clean, 1))), F.desc(F.length("entry")), "entry")
    found = [(r["entry"], r["a"], r["b"]) for r in often.limit(CANDIDATES).collect()]
    lexicon = Lexicon(weights_of(found, clean, toxic, CANDIDATES), exceptions)
    share = (totals[1] + 1) / (sum(totals) + 2)
    if not clean or not toxic:
        lexicon.line = (float(np.log(share / (1 - share))), 0.0, 0.0)
        return lexicon

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            m = [lexicon.measure(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([w for w, _ in m], pa.float64()), pa.array([n for _, n in m], pa.int64())], names=["y", "w", "n"])

    # documents of one weight in hundredths and one length in steps of a tenth count together
    points = rows.mapInArrow(measured, "y int, w double, n long").groupBy(F.round("w", 1).alias("w"), F.floor(F.log1p("n") * 10).alias("n"), "y").count().collect()
    points.sort(key=lambda r: (r["w"], r["n"], r["y"]))
    w = np.array([r["w"] for r in points])
    x = lexicon.terms(w, np.expm1(np.array([r["n"] for r in points]) / 10))
    y, many = np.array([r["y"] for r in points], dtype=float), np.array([r["count"] for r in points], dtype=float)
    many = many * np.where(y == 1, share / toxic, (1 - share) / clean) * (clean + toxic)
    line, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -500, 500)))
        step = np.linalg.solve((x * (many * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (many * (y - p)) - ridge @ line)
        line = line + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    lexicon.line = tuple(float(v) for v in line)
    return lexicon


def classify(docs: DataFrame, labels: DataFrame, exceptions=EXCEPTIONS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, weight) for every row of docs.

    Texts are folded as a whole (case, accents, homoglyphs, digits for letters) and matched against the lexicon; the
    weight of the matches that lie in no exception phrase is set against the length. Null and empty texts are scored as
    the empty text, which matches nothing; repeated rows get equal scores; a null id is not held out. Without labels of
    both classes the score is the smoothed share of class 1, a half without any. An empty table gives an empty result;
    other columns are not read, whatever their names.
    """
    tune(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    rows, totals = sample(docs, labels, SAMPLE_DOCS, scratch)
    lexicon = learn(rows, totals, exceptions)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            m = [lexicon.measure(t) for t in batch.column("text").to_pylist()]
            w, n = np.array([a for a, _ in m], dtype=float), np.array([b for _, b in m], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lexicon.score(w, n)), pa.array(w)], names=["doc_id", "score", "weight"])

    scored = _texts(docs).mapInArrow(work, "doc_id long, score double, weight double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "weight")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the lexicon's weight for every document."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
