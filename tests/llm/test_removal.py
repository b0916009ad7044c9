import hashlib
import math
import random
import re
from collections import Counter

from lexmill.llm import lines, suffixes
from tests.llm.helpers import WORDS, frame, odd_rows, prose


def covered(rows, span=200):
    seen, twice = set(), set()
    raws = [(d, (t or "").encode()) for d, t, *_ in rows]
    for _, b in raws:
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            (twice if w in seen else seen).add(w)
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if b[p : p + span] in twice:
                gone[p : p + span] = b"\1" * span
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (30, 40, 60, 200)]
    rows = []
    for i in range(80):
        text = prose(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            text += rng.choice([" ", "\n", ""]) + s[a : rng.randint(a, len(s))] + rng.choice([" é ", "ab" * rng.randint(0, 300), ""])
        rows.append((i, text + prose(rng, rng.randint(0, 30)), "en", "s", 1))
    return rows


def removed(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_suffixes_against_brute_force(spark, monkeypatch):
    for rows in (passages(), odd_rows()):
        assert removed(suffixes.remove_repeats(frame(spark, rows))) == covered(rows)
    for group in (1, 3):  # groups are split by their bytes, to the last round or some of the way
        monkeypatch.setattr(suffixes, "GROUP", group)
        assert removed(suffixes.remove_repeats(frame(spark, passages()))) == covered(passages())
    assert removed(suffixes.remove_repeats(frame(spark, odd_rows(), extra=True))) == covered(odd_rows())
    assert suffixes.remove_repeats(frame(spark, [])).collect() == []


def test_intervals_and_agreements():
    rng = random.Random(12)
    for _ in range(200):
        n = rng.randint(2, 12)
        left = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode() for _ in range(n)]
        right = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))).encode() for _ in range(n)]

        def lcp(a, b):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            return k

        got = suffixes.agreements(left, right, 5)
        for i in range(n):
            windows = {o for g, m in got[i] for o in range(max(0, 5 - m), g + 1)}
            want = {o for j in range(n) if j != i for o in range(max(0, 5 - lcp(right[i], right[j])), lcp(left[i], left[j]) + 1) if lcp(right[i], right[j])}
            assert windows == want, (left, right, i)


def test_null_ids_are_not_other_ids(spark):
    rng = random.Random(17)
    text = prose(rng, 60)
    rows = [(d, t, "en", "s", 1) for d, t in ((None, text), (None, text), (-1, text), (-5, text), (3, prose(rng, 50)), (None, "short"), (-1, "short"))]
    assert removed(suffixes.remove_repeats(frame(spark, rows))) == covered(rows)
    got = [(r.doc_id, r.n_removed) for r in lines.remove_lines(frame(spark, rows)).collect()]
    assert sorted(n for d, n in got if d is None) == [0, 0, len(text.encode())]
    assert all(n == len(text.encode()) for d, n in got if d in (-1, -5) and n) and sum(n > 0 for d, n in got if d in (-1, -5)) == 2


def split_sentences(b):
    """(start, end, words, whether it ends its line) by reading one byte after the other."""
    found, start, i = [], 0, 0

    def put(stop, after, ends):
        words = re.sub(rb"[.]+\Z", b"", bytes(c + 32 if 65 <= c <= 90 else c for c in b[start:stop])).split()
        if words:
            found.append([start, min(after, len(b)), words, ends])
        elif ends and found:
            found[-1][3] = True

    while i < len(b):
        wide = 1 if b[i : i + 1] == b"\n" else 2 if b[i : i + 2] == b". " else 3 if b[i : i + 3] == "\u3002".encode() else 0
        if wide:
            put(i, i + wide, b[i : i + 1] == b"\n")
            start = i = i + wide
        else:
            i += 1
    put(len(b), len(b), True)
    return found


def brute_units(b, words, chars):
    """(start, end, its words) of each unit."""
    own, found = split_sentences(b), set()
    for i in range(len(own)):
        for j in range(i, len(own)):
            many = sum(len(s[2]) for s in own[i : j + 1])
            if many >= words or sum(len(b" ".join(s[2]).decode()) for s in own[i : j + 1]) >= chars or own[j][3]:
                found.add((i, j))
                break
    if own:
        found.add((0, len(own) - 1))
    return [(own[i][0], own[j][1], [w for s in own[i : j + 1] for w in s[2]]) for i, j in sorted(found)]


def brute_lines(rows, words=20, chars=120, chance=0.01):
    """rows in the order in which their occurrences count; the outcome of each in that order."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    place = lambda w: int(hashlib.md5(w).hexdigest()[:6], 16) // 64
    often = Counter(place(w) for b in texts for s in split_sentences(b) for w in s[2])
    units = [brute_units(b, words, chars) for b in texts]
    forms = Counter(b" ".join(f) for own in units for _, _, f in own)
    n_words, n_units = sum(often.values()), sum(forms.values())

    def goes(form):
        n = forms[form]
        if n < 2 or chance is None:
            return n > 1
        log_m = math.log(n_units) - sum(round(1024 * math.log(n_words / often[place(w)])) for w in form.split()) / 1024
        return math.log(n) > log_m and n * (math.log(n) - log_m) - n + math.exp(log_m) > math.log(n_units / chance)

    seen, out = set(), []
    for (d, *_), b, own in zip(rows, texts, units, strict=True):
        gone = bytearray(len(b))
        for start, end, form in own:
            form = b" ".join(form)
            if form in seen and goes(form):
                gone[start:end] = b"\1" * (end - start)
            seen.add(form)
        out.append((d, len(b) - sum(not g for g in gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    rng = random.Random(13)
    pool = [prose(rng, rng.randint(1, 25)).capitalize() + rng.choice([".", "", "...", "\u3002"]) for _ in range(40)]
    rows = [(i, "".join(rng.choice(pool) + rng.choice([" ", "\n", "  ", "\n\n"]) for _ in range(rng.randint(0, 9))), "en", "s", 1) for i in range(120)]
    odd = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    for data in (rows, odd):
        for least in ((20, 120), (1, 1), (6, 40), (20, 120, None), (1, 1, None), (6, 40, 0.5)):
            got = lines.remove_lines(frame(spark, data, extra=True), *least).collect()
            assert sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_lines(data, *least)
    assert lines.remove_lines(frame(spark, [])).collect() == []


def test_a_sentence_stays_once(spark):
    """What is left of all documents together still holds every sentence there was."""
    rng = random.Random(18)
    pool = [prose(rng, rng.randint(3, 12)) for _ in range(12)]
    rows = [(i, ". ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))), "en", "s", 1) for i in range(60)]
    by = {r.doc_id: r.spans for r in lines.remove_lines(frame(spark, rows)).collect()}
    left, had = set(), set()
    for d, t, *_ in rows:
        b = t.encode()
        runs = [tuple(map(int, s.split(":"))) for s in by[d].split(",") if s]
        for start, end, words, _ in lines.segments(b):
            had.add(tuple(words))
            if not any(x <= start and end <= y for x, y in runs):
                left.add(tuple(words))
    assert left == had


def test_short_and_unspaced_lines_are_looked_up(spark):
    menu, rights = "Home\nAbout us\nContact\n", "All rights reserved."
    wrapped = "".join(" ".join(WORDS[i : i + 4]) + "\n" for i in range(0, 24, 4)) * 3
    han = "".join(chr(0x4E00 + 7 * i) for i in range(300))
    sentence = han[:45] + "\u3002"
    shared = [menu, rights, wrapped, han, sentence]
    rows = [(10 * i + j, f"own{i}x{j} text\n" + (chr(0x6E00 + 10 * i + j) + "\u3002" + s + chr(0x6F00 + 10 * i + j) if s == sentence else s), "en", "s", 1) for i, s in enumerate(shared) for j in range(2)]
    for least in ((20, 120), (1, 1)):
        got = {r.doc_id: r.n_removed for r in lines.remove_lines(frame(spark, rows), *least, None).collect()}
        for i, s in enumerate(shared):
            if s != sentence or least == (1, 1):
                assert got[10 * i + 1] == len(s.encode()), s
                assert got[10 * i] == (len(wrapped) * 2 // 3 if s == wrapped else 0), s


def test_short_repeats_go_and_chance_stays(spark):
    """Short lines, tails and whole texts that several documents share go; lines of one word drawn at random do not."""
    rng = random.Random(19)
    own = lambda: f"{prose(rng, 30)}. "
    rights, menu = "All rights reserved. Contact us today", "Home | About | Login"
    rows = [(i, own() + rights, "en", "s", 1) for i in range(5)] + [(10 + i, menu, "en", "s", 1) for i in range(5)] + [(20 + i, f"{own()}\n{menu}\n{own()}", "en", "s", 1) for i in range(3)]
    rows += [(30 + i, "\n".join(prose(rng, 1) for _ in range(40)), "en", "s", 1) for i in range(9)]
    got = {r.doc_id: r.n_removed for r in lines.remove_lines(frame(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == [0] + [len(rights)] * 4
    assert [got[10 + i] for i in range(5)] == [0] + [len(menu)] * 4
    assert [got[20 + i] for i in range(3)] == [len(menu) + 1] * 3
    assert not any(got[30 + i] for i in range(9))
