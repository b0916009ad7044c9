import itertools
import random

import numpy as np

from lexmill.llm import language
from tests.llm.helpers import frame, odd_rows


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    flat = rng.integers(0, 6, size=8)
    score, trans, start = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, pairs = language.forward_backward(flat, lengths, score, trans, start, pairs=True)
    at, total = 0, np.zeros((3, 3))
    for n in lengths:
        want, z = np.zeros((n, 3)), 0.0
        both = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(score[flat[at + i], y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            z += w
            for i, y in enumerate(path):
                want[i, y] += w
            for a, b in zip(path, path[1:], strict=False):
                both[a, b] += w
        assert np.allclose(got[at : at + n], want / z)
        total += both / z
        at += n
    assert np.allclose(pairs, total)


def texts(rng, lang, n):
    stems = {"en": ["th", "wh", "ing", "the", "ough"], "fr": ["eau", "é", "ou", "qu", "ent"], "de": ["sch", "ung", "ß", "ei", "ver"]}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_switching(spark):
    rng = random.Random(4)
    docs = [(i, texts(rng, lang, rng.randint(5, 80)), lang, "s", 1) for i in range(240) for lang in [("en", "fr", "de")[i % 3]]]
    df = frame(spark, docs)
    model = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    held = [d for d in docs if got[d[0]].held_out]
    assert 0.2 < len(held) / len(docs) < 0.5
    assert sum(got[d[0]].lang_pred == d[2] for d in held) / len(held) > 0.97
    mixed = texts(rng, "en", 40) + " " + texts(rng, "de", 20)
    r = language.identify(frame(spark, [(1, mixed, None, "s", 1)]), model).first()
    assert r.lang_pred == "en" and 1 <= r.switches <= 4 and 0.55 < r.score < 0.8
    odd = language.identify(frame(spark, extra=True), model).collect()
    assert len(odd) == len(odd_rows())
    assert {(r.lang_pred, r.score) for r in odd if r.doc_id in (4, 5, 6)} == {("und", 0.0)}
    assert language.identify(frame(spark, []), model).collect() == []
    empty = language.fit(frame(spark, []))
    assert {r.lang_pred for r in language.identify(frame(spark), empty).collect()} == {"und"}


def test_long_runs_are_read_to_their_end(spark):
    word = "abcdefghijklmnopqrstuvwxyz" * 2
    assert len(language.word_features(word, {})) == 7 + len(word) + len(word) + 1
    for n in (1, 24, 25, 26, 46, 47, 500):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        parts = language.words_of(f"{run} one")
        assert parts[-1] == "one" and max(map(len, parts)) <= language.RUN and (n > language.RUN or parts[0] == run)
        assert {run[i : i + 3] for i in range(n - 2)} == {w[i : i + 3] for w in parts[:-1] for i in range(len(w) - 2)}
    rng = random.Random(6)
    low = {"zh": 0x4E00, "ja": 0x3041}
    run = lambda lang, n: "".join(chr(low[lang] + rng.randrange(60)) for _ in range(n))
    docs = [(i, run(lang, rng.randint(5, 200)), lang, "s", 1) for i in range(120) for lang in [("zh", "ja")[i % 2]]]
    model = language.fit(frame(spark, docs))
    r = language.identify(frame(spark, [(1, run("zh", 60) + run("ja", 300), None, "s", 1)]), model).first()
    assert r.lang_pred == "ja" and r.switches == 1


def test_numerals_are_no_letters(spark):
    assert language.words_of("naïve ² ½① x² a_b 日本語 12 Ⅳ Ünï9co\u00b2de \u0661") == ["naïve", "x", "a", "b", "日本語", "ünï", "co", "de"]
    model = language.fit(frame(spark, [(i, "the river" if i % 2 else "la rivière", "en" if i % 2 else "fr", "s", 1) for i in range(60)]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, [(1, "² ½ ①", None, None, 0), (2, "the river ²", None, None, 0)]), model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en"
