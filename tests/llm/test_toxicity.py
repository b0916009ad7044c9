import random
import zlib

import numpy as np

from lexmill.llm import toxicity
from lexmill.llm.common import Scratch
from tests.llm.helpers import frame, odd_rows, prose

LABELS = "doc_id long, quality int, toxic int"
BAD = ["zorgpate", "quimblet", "dralfen"]


def corpus(n=700, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = prose(rng, rng.randint(20, 200)).split()
        if toxic:
            for _ in range(2 + len(words) // 60):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ish"]))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def brute_measure(lexicon, text):
    """Every place of every entry by search, one word after the other."""
    folded = toxicity.fold(text) + " "
    spared = [(i, i + len(p)) for p in (toxicity.fold(e) + " " for e in lexicon.exceptions) for i in range(len(folded)) if folded.startswith(p, i)]
    total = 0.0
    for entry, weight in lexicon.weights.items():
        for i in range(len(folded)):
            if folded.startswith(entry, i) and not any(a <= i and i + len(entry) <= b for a, b in spared):
                total += weight
    return total, len(folded.split())


def test_held_out_accuracy_and_whole_result(spark):
    docs, labels = corpus()
    df, lab = frame(spark, docs), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in toxicity.classify(df, lab).collect()}
    truth = {d: t for d, _, t in labels}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[d].predicted == truth[d] for d in got if got[d].held_out)
    lexicon = toxicity.learn(*toxicity.sample(df, lab, toxicity.SAMPLE_DOCS, Scratch(spark, "t")))
    assert {w[: len(e) - 1] for w in BAD for e in lexicon.weights if toxicity.fold(w).startswith(e)} and len(lexicon.weights) == 3
    for d, text, *_ in docs[::7]:
        weight, words = brute_measure(lexicon, text)
        assert abs(got[d].weight - weight) < 1e-9
        assert abs(got[d].score - lexicon.score(np.array([weight]), np.array([float(words)]))[0]) < 1e-12
    again = {r.doc_id: r.score for r in toxicity.classify(df.repartition(7), lab).collect()}
    assert again == {d: r.score for d, r in got.items()}


def test_only_train_labels_are_learned(spark):
    docs, labels = corpus()
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    a = toxicity.classify(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    b = toxicity.classify(frame(spark, docs), spark.createDataFrame(turned, LABELS)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_folding():
    same = {toxicity.fold(w) for w in ("Moron", "m0r0n", "МОRОN".replace("М", "M"), "mоrоn", "ｍｏｒｏｎ", "mörön", "m0r0n!")}
    assert same == {" moron"}
    assert toxicity.fold("1d10t") == toxicity.fold("idiot") and toxicity.fold("l0ser") == toxicity.fold("loser") == toxicity.fold("1o5er")
    assert toxicity.fold("id!ot, th$$$ 42 4040549990366437") == " idiot th"
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("12 34 !?") == " "


def test_exceptions_and_unspaced_scripts():
    lexicon = toxicity.Lexicon({" trash": 2.0, "坏人": 3.0, " ciown": 1.0}, ("trash can", "class clown"), (-3.0, 1.0, 1.0))
    assert lexicon.measure("The trash can by the tr4sh heap, trashy trash cannot") == (6.0, 10)
    assert lexicon.measure("他是坏人。坏人") == (6.0, 2)
    assert lexicon.measure("class CL0WN and clowns") == (1.0, 4)
    assert lexicon.measure("untrash") == (0.0, 1) and lexicon.measure(None) == (0.0, 0)
    assert lexicon.measure("trash " * 300_000)[1] == 300_000
    assert toxicity.Lexicon({}, ()).measure("any word") == (0.0, 2)


def test_copies_are_no_evidence(spark):
    docs, labels = corpus()
    rng = random.Random(9)
    odd = prose(rng, 30).split()
    docs += [(5000 + i, " ".join([*odd, "unrelatedword", *odd]) + f" {i}", "en", "s", 1) for i in range(60)]
    labels += [(5000 + i, 1, 1) for i in range(60)]
    rows, totals = toxicity.sample(frame(spark, docs), spark.createDataFrame(labels, LABELS), toxicity.SAMPLE_DOCS, Scratch(spark, "t"))
    lexicon = toxicity.learn(rows, totals)
    assert not any(toxicity.fold("unrelatedword").startswith(e) for e in lexicon.weights) and len(lexicon.weights) >= 3


def test_odd_rows(spark):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.classify(frame(spark, extra=True), none).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0), (7, 9, 9)], LABELS)
    got = toxicity.classify(frame(spark), odd).collect()
    assert len(got) == len(odd_rows()) and len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1
    assert toxicity.classify(frame(spark, []), none).collect() == []
    long = frame(spark, [(i, "word " * 1_000_000, None, None, None) for i in range(6)])
    assert len(toxicity.classify(long, none).collect()) == 6
