"""Small tables with the cases every operator has to bear, and brute-force twins."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and rather longer river stone under over cloud mountain seven green quick slow paper window garden letter number music yellow silver winter summer".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, a repeated row, a long text, characters of all widths."""
    rng = random.Random(5)
    base = prose(rng, 120)
    long = prose(rng, 4000)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " ", None, "b", None), (3, base + " ", None, "b", None),
        (4, None, "en", "a", 0), (None, "a row without an id but with a text", "en", None, 3), (5, "", "en", None, 0), (6, " \t\n\x0b\f\r ", None, None, 7),
        (7, "one", "en", "b", 3), (8, "naïve Ünïcode 𝒳 text with ß and é " * 12, "de", "c", 9), (9, long, "en", "c", 5), (10, long[:-40] + " changed tail words here", "en", "a", 5),
        (11, base.upper(), "en", "a", 4), (12, "x" * 500, None, "ü", 500), (13, prose(rng, 60) + "\n" + base, "en", "b", 1),
    ]
    return rows


def frame(spark, rows=None, extra=False):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)
    if extra:  # names that the operators use inside, or might
        for name in ("id", "row", "n", "size", "gid", "key", "h", "spans", "score", "copies", "target", "uid", "place", "node", "__text", "__size", "__copies", "__copy", "_at", "d", "p"):
            df = df.selectExpr("*", f"cast(7 as int) as `{name}`")
    return df


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by sources in order of their names, worked out one round after the other in exact fractions."""
    from fractions import Fraction

    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_ = Fraction(share) * sum(sizes), set(range(len(sizes)))
    while open_:
        over = {i for i in open_ if left * w[i] > cap * sizes[i] * sum(w[j] for j in open_)}
        if not over:
            break
        left -= cap * sum(sizes[i] for i in over)
        open_ -= over
    return [float(left * w[i] / sum(w[j] for j in open_)) if i in open_ else float(cap * sizes[i]) for i in range(len(sizes))]


def against_sql(df, sql, sf_dir):
    """The first rows that a query and its SQL do not share, column by column in order of their names."""
    from collections import Counter

    from tests.oracle import connect

    names = sorted(df.columns)
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    a = Counter(tuple(r[n] for n in names) for r in df.collect())
    b = Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    return list(((a - b) + (b - a)).items())[:5]
