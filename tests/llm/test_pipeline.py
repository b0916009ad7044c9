import hashlib
import math
import os
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from lexmill.llm import mixing, neardup, pieces, quality
from tests.llm.helpers import prose, targets

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no public model file")


def test_pipeline_against_brute_force(spark, tmp_path):
    from tests.llm.test_exact_mixing import brute as exact_brute
    from tests.llm.test_neardup import brute as near_brute

    rng = random.Random(16)
    rows, labels, clean = [], [], []
    for i in range(150):
        text = prose(rng, rng.randint(20, 90)) if rng.random() < 0.8 or not clean else rng.choice(clean) + rng.choice(["", " ", " end"])
        clean.append(text)
        good = rng.random() < 0.75
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", rng.choice("abc"), len(text)))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, lab).collect() if r.predicted}
    assert len(good ^ {i for i, q, _ in labels if q}) <= 3
    left = [r for r in rows if r[0] in good]
    keep = {d for d, _, _, kept, _ in exact_brute(left) if kept}
    left = [r for r in left if r[0] in keep]
    keep = {d for d, _, _, kept in near_brute(left, neardup.WORDS) if kept}
    left = [r for r in left if r[0] in keep]
    sizes = Counter()
    for _, t, _, s, _ in left:
        sizes[s] += len(t.split())
    goals = dict(zip(sorted(sizes), targets([sizes[s] for s in sorted(sizes)]), strict=True))
    want = Counter()
    for s in sizes:  # copies by the running sum of expectations, the best of some offsets a source
        rate = goals[s] / sizes[s]
        own = sorted((len(t.split()), d) for d, t, _, source, _ in left if source == s)
        draws = []
        for i in range(mixing.DRAWS):
            offset = int(hashlib.md5(f"{mixing.SEED}|{i}|{s}".encode()).hexdigest()[:8], 16) / 2**32
            copies = [math.floor(offset + (k + 1) * rate) - math.floor(offset + k * rate) for k in range(len(own))]
            draws.append((abs(sum(n * c for (n, _), c in zip(own, copies, strict=True)) - goals[s]), i, copies))
        want.update({d: c for (_, d), c in zip(own, min(draws)[2], strict=True)})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = {r[0]: r[1] for r in left}
    assert Counter(r.doc_id for r in got) == +want
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in got:
        ids = library.encode(by[r.doc_id])
        assert r.n_pieces == len(ids) and r.n_units == len(re.findall(" +[^ ]*", " " + by[r.doc_id]))
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by[r.doc_id].encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
