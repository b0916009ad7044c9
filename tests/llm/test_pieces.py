import itertools
import os
import random

import pytest

from lexmill.llm import pieces
from tests.llm.helpers import frame, odd_rows, prose

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no public model file")
ODD = ["", " ", "   ", "a", " a  b ", "a\nb\r\n\tc", "▁x", "\u0000y", "日本語のテキスト", "𝒳𝒴 emoji 😀", "=" * 700, "aaaa" * 90, "x" * 61 + "é", "https://example.org/" + "Ab3" * 60, "İSTANBUL ß"]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@needs_model
def test_equals_library(spark, monkeypatch):
    rng = random.Random(14)
    texts = ODD + [prose(rng, 30) for _ in range(20)] + ["".join(rng.choice("abc é.,▁\n-=thein") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    for common in (pieces.COMMON, 5):  # with and without most fragments known beforehand
        monkeypatch.setattr(pieces, "COMMON", common)
        got = {r.doc_id: r for r in pieces.with_ids(pieces.encode(frame(spark, rows, extra=True).repartition(3))).collect()}
        lib = library()
        for i, t in enumerate(texts):
            assert got[i].ids == lib.encode(t), t
            assert got[i].text == t.replace("▁", " "), t


@needs_model
def test_odd_rows(spark):
    got = pieces.summary(frame(spark, extra=True)).collect()
    assert len(got) == len(odd_rows())
    assert sorted(r.n_pieces for r in got) == sorted(len(library().encode(t or "")) for _, t, *_ in odd_rows())
    assert pieces.summary(frame(spark, [])).collect() == []


def test_viterbi_of_unigram_tables(spark):
    rng = random.Random(15)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "bca", "cc", "▁", "▁a", "▁ab"]
    table = pieces.Pieces([None, *[(p, -rng.uniform(1, 9)) for p in names]], True, None, 0)
    words = sorted({"".join(rng.choice("abcz") for _ in range(rng.randint(1, 7))) for _ in range(60)} | {"▁abc", "abc" * 30})
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string").repartition("word"), table).collect()}
    worst = min(table.scores.values()) - 10
    for w in words:
        if len(w) > 8:
            assert got[w] == table.fold_best(w)
            continue
        best = None
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:], strict=False)]
            if all(p in table.scores or len(p) == 1 for p in parts):
                s = sum(table.scores.get(p, worst) for p in parts)
                if best is None or s > best[0]:
                    best = (s, parts)
        names_of = {i: p for p, i in table.ids.items()}
        assert abs(sum(table.scores[names_of[i]] if i else worst for i in got[w]) - best[0]) < 1e-9, w
        assert table.fold_best(w) == got[w]
