"""Language identification: a linear-chain conditional random field that labels the words of code-switched text."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.common import either, read, tune
from lexmill.llm.quality import held_out

#: Rows whose crc32(doc_id as text) leaves remainder 1 by 3 are held out.
FOLDS, HELD = 3, 1
#: Bound of the training sample: documents of each language, the first by a hash of their id.
SAMPLE_DOCS = 250
#: Shares of a language that are ranked apart before they are ranked together.
SHARES = 64
#: Slots of the feature table, words of a training chain, share of chains spliced from two documents, gradient steps.
SLOTS, CHAIN, SPLICED, STEPS = 1 << 15, 48, 0.3, 30
#: A word is in a language's lexicon if it makes up so much of that language's words and of no other's half as much.
LEXICON_SHARE = 0.002
#: Word types a task remembers, and words that are labelled together.
MEMORY, TOGETHER = 400_000, 1_500_000
#: Longer runs of letters, as in scripts without spaces, are cut into words of so many letters that share OVERLAP of
#: them with the next, so that all letters enter the chain and no n-gram is lost at a cut.
RUN, OVERLAP = 24, 2
UNKNOWN = "und"

_runs = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; a run of over RUN letters is several words, one after the other."""
    found = _runs.findall((text or "").lower())
    if not all(map(str.isalpha, found)):  # numerals other than digits are no letters
        found = [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]
    if all(len(w) <= RUN for w in found):
        return found
    return [w[i : i + RUN] for w in found for i in range(0, max(len(w) - OVERLAP, 1), RUN - OVERLAP)]


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Slots of a word's affixes, n-grams, form and lexicon entry."""
    edged = f"^{word}$"
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3, 4)]
    names += [f"g{edged[i : i + 3]}" for i in range(len(edged) - 2)]
    names += [f"b{edged[i : i + 2]}" for i in range(len(edged) - 1)]
    if len(word) <= 4:
        names.append(f"w{word}")
    if word in lexicon:
        names.append(f"l{lexicon[word]}")
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % SLOTS for n in names]


def emissions(words: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """A row of label scores for each word."""
    slots, ends = [], []
    for w in words:
        slots += word_features(w, lexicon)
        ends.append(len(slots))
    if not words:
        return np.zeros((0, weights.shape[1]))
    sums = np.cumsum(weights[np.array(slots)], axis=0)[np.array(ends) - 1]
    return np.diff(sums, axis=0, prepend=0)


def forward_backward(flat: np.ndarray, lengths: np.ndarray, score: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of every word of chains laid end to end; with pairs also the summed marginals of neighbouring labels.

    flat: word types; lengths: words of each chain (none empty); score: label scores by type. All chains advance
    together, the longest first, so that step t is one operation over the chains that still have a word t.
    """
    order = np.argsort(-lengths, kind="stable")
    long = lengths[order]
    offset = (np.cumsum(lengths) - lengths)[order]
    e = np.exp(score - score.max(axis=1, keepdims=True))
    a = np.exp(trans)
    alpha = np.empty((len(flat), score.shape[1]))
    live = len(long) - np.searchsorted(long[::-1], np.arange(1, long[0] + 1), side="left") if len(long) else np.zeros(0, int)
    prev = None
    for t, n in enumerate(live):
        at = offset[:n] + t
        prev = (np.exp(start) if t == 0 else prev[:n] @ a) * e[flat[at]]
        prev /= prev.sum(axis=1, keepdims=True)
        alpha[at] = prev
    nxt, both = None, np.zeros((score.shape[1],) * 2)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        beta = np.ones((n, score.shape[1]))
        if t + 1 < len(live):
            m = live[t + 1]
            ahead = nxt * e[flat[offset[:m] + t + 1]]
            if pairs:
                joint = alpha[offset[:m] + t][:, :, None] * a[None] * ahead[:, None, :]
                both += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[:m] = ahead @ a.T
            beta[:m] /= beta[:m].sum(axis=1, keepdims=True)
        nxt = beta
        at = offset[:n] + t
        alpha[at] *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    return (alpha, both) if pairs else alpha


class Chain:
    """Languages, feature weights, transition and start scores, and the lexicon."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, lexicon: dict[str, int]):
        self.langs, self.weights, self.trans, self.start, self.lexicon = langs, weights, trans, start, lexicon

    @classmethod
    def train(cls, sample: list[tuple[str, str]]) -> Chain:
        """From (text, language) rows; every word carries its document's language, some chains splice two documents."""
        langs = sorted({lang for _, lang in sample})
        k = len(langs)
        rng = np.random.default_rng(7)
        docs = [(words_of(t), langs.index(lang)) for t, lang in sample]
        docs = [(w, y) for w, y in docs if w]
        counts: list[dict[str, int]] = [{} for _ in langs]
        for words, y in docs:
            for w in words:
                counts[y][w] = counts[y].get(w, 0) + 1
        share = [{w: n / max(sum(c.values()), 1) for w, n in c.items()} for c in counts]
        lexicon = {w: y for y in range(k) for w, s in share[y].items() if s >= LEXICON_SHARE and all(share[z].get(w, 0) < s / 2 for z in range(k) if z != y)}
        chains, truth = [], []
        for words, y in docs:
            for i in range(0, len(words), CHAIN):
                chains.append(words[i : i + CHAIN])
                truth.append([y] * len(chains[-1]))
        for i in np.flatnonzero(rng.random(len(chains)) < SPLICED):
            j = int(rng.integers(len(chains)))
            cut, other = int(rng.integers(1, CHAIN)), int(rng.integers(1, CHAIN))
            chains[i], truth[i] = chains[i][:cut] + chains[j][:other], truth[i][:cut] + truth[j][:other]
        kinds: dict[str, int] = {}
        flat = np.array([kinds.setdefault(w, len(kinds)) for c in chains for w in c], dtype=np.int64)
        gold = np.array([y for t in truth for y in t], dtype=np.int64)
        lengths = np.array([len(c) for c in chains], dtype=np.int64)
        weights, trans, start = np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k)
        if k < 2 or not len(flat):
            return cls(langs, weights, trans, start, lexicon)
        per = [word_features(w, lexicon) for w in kinds]
        slot = np.array([s for p in per for s in p], dtype=np.int64)
        owner = np.repeat(np.arange(len(per)), [len(p) for p in per])
        begins = np.concatenate([[0], np.cumsum([len(p) for p in per])[:-1]])
        firsts = np.cumsum(lengths) - lengths
        inner = np.ones(len(flat), dtype=bool)
        inner[firsts] = False
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
        seen = [np.zeros_like(p) + 1e-8 for p in (weights, trans, start)]
        for _ in range(STEPS):
            score = np.add.reduceat(weights[slot], begins, axis=0)
            p, both = forward_backward(flat, lengths, score, trans, start, pairs=True)
            diff = -p
            diff[np.arange(len(flat)), gold] += 1
            by_kind = np.stack([np.bincount(flat, diff[:, c], len(per)) for c in range(k)], axis=1)
            g_w = np.stack([np.bincount(slot, by_kind[owner, c], SLOTS) for c in range(k)], axis=1)
            g_t = gold_pairs - both
            g_s = np.bincount(gold[firsts], minlength=k) - p[firsts].sum(axis=0)
            for par, grad, acc in ((weights, g_w, seen[0]), (trans, g_t, seen[1]), (start, g_s, seen[2])):
                grad = grad / len(flat) - 1e-6 * par
                acc += grad**2
                par += 0.3 * grad / np.sqrt(acc)
        return cls(langs, weights, trans, start, lexicon)


def fit(docs: DataFrame) -> Chain:
    """Train on a bounded sample: the first SAMPLE_DOCS documents of each language by a hash of their id.

    Held-out rows, null texts, languages and ids take no part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD))
    # Only ids pass through the ranking; the few that are chosen fetch their texts.
    # First within shares of a language, so that one of a third of all rows is no single task's.
    ranked = lambda df, *by: df.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("h", "doc_id"))).filter(F.col("k") <= SAMPLE_DOCS)
    hashed = rows.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("share", F.pmod("h", F.lit(SHARES)))
    chosen = ranked(ranked(hashed, "lang", "share"), "lang").select("doc_id", "lang")
    got = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "text", "lang").collect()
    return Chain.train([(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (r["lang"], r["doc_id"], r["text"]))])


def identify(docs: DataFrame, model: Chain) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, switches) for every row, from its whole text.

    Rows keep their multiplicity and equal texts get equal answers. An empty table gives an empty result; other columns
    are not read, whatever their names.

    lang_pred is the language with the largest sum of word marginals (ties: the first by code point), score the mean
    marginal of it; `und` with score 0 where the text is null or has no letter or nothing was learned. n_words counts what
    words_of yields, the parts of a long run each. switches counts neighbouring words
    whose likeliest languages differ.
    """
    tune(docs.sparkSession)
    rows = docs.select(either(docs, "doc_id", "long").alias("doc_id"), either(docs, "text", "string").alias("text"))

    def work(batches):
        import pyarrow as pa

        kinds: dict[str, int] = {}
        score = np.zeros((0, len(model.langs)))
        fresh: list[str] = []
        ids, chains, total = [], [], 0

        def flush():
            nonlocal score, ids, chains, total
            if fresh:
                score = np.vstack([score, emissions(fresh, model.weights, model.lexicon)])
                fresh.clear()
            lengths = np.array([len(c) for c in chains], dtype=np.int64)
            full = np.flatnonzero(lengths)
            pred, mean, switches = [UNKNOWN] * len(chains), np.zeros(len(chains)), np.zeros(len(chains), dtype=np.int64)
            if len(full) and model.langs:
                flat = np.concatenate([chains[i] for i in full])
                p = forward_backward(flat, lengths[full], score, model.trans, model.start)
                firsts = np.cumsum(lengths[full]) - lengths[full]
                sums = np.add.reduceat(p, firsts, axis=0)
                best = sums.argmax(axis=1)
                label = p.argmax(axis=1)
                change = np.concatenate([[0], (label[1:] != label[:-1]).astype(np.int64)])
                change[firsts] = 0
                switches[full] = np.add.reduceat(change, firsts)
                mean[full] = np.clip(sums[np.arange(len(full)), best] / lengths[full], 0, 1)
                for i, b in zip(full, best, strict=True):
                    pred[i] = model.langs[b]
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(mean), pa.array(lengths), pa.array(switches)], names=["doc_id", "lang_pred", "score", "n_words", "switches"])
            ids, chains, total = [], [], 0
            if len(kinds) > MEMORY:
                kinds.clear()
                score = score[:0]
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = []
                for w in words_of(text):
                    k = kinds.get(w)
                    if k is None:
                        k = kinds[w] = len(kinds)
                        fresh.append(w)
                    own.append(k)
                ids.append(doc)
                chains.append(np.array(own, dtype=np.int64))
                total += len(own)
                if total >= TOGETHER:
                    yield flush()
        yield flush()

    got = rows.mapInArrow(work, "doc_id long, lang_pred string, score double, n_words long, switches long")
    return got.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "lang_pred", "score", "n_words", "switches")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document; n_words and switches are added."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
