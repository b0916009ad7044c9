import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import maps
from lexmill.functions import text as T

ODD = ["", " ", " x y\x85z\x1c", "ÀÉ ß  İ", "The\r\nEnd\r\r\n\n\n x", "client lien", "é eau", "d’eau", "x_eau", "eau9", "…eau…", "tab\t\tnbsp  end "]


def test_normalize_and_phrases_equal_unicode_python(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aé _9. \n eau ß") for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    body = T.normalize(F.col("t"))
    got = {r.i: r for r in df.select("i", body.alias("b"), *[T.contains_phrase(body, p).alias(f"p{k}") for k, p in enumerate(("eau", "é", "a.", ""))]).collect()}
    for i, t in enumerate(texts):
        b = re.sub(r"\s+", " ", t).strip().lower()
        assert got[i].b == b
        for k, p in enumerate(("eau", "é", "a.")):
            assert got[i][f"p{k}"] == (re.search(rf"(?<!\w){re.escape(p)}(?!\w)", b) is not None), (t, p)
        assert got[i].p3 is False


def test_conservative_normalize(spark):
    want = {
        "": "", " ": "", " x  y ": "x y", "a\tb \t c": "a b c", "a\u00a0\u00a0b": "a b", "one\r\ntwo\rthree": "one\ntwo\nthree", "a\n\nb": "a\n\nb", "a\n\n\nb\n\n\n\n\nc": "a\n\nb\n\nc",
        "\n\n\n\nx\n": "x", "a \n b": "a \n b", "Case Stays": "Case Stays", "a\u2003b": "a\u2003b",
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert [r.n for r in df.select(T.normalize_text(F.col("t")).alias("n")).collect()] == list(want.values())


def test_forbidden_keys(spark):
    gone = ["password", "user_password", "Authorization", "content", "raw-content", "a_secret_b", " Password ", "x-api-key", "set-cookie", "oidc_id_token", "before_state", "my_text", "email", "user_email", "legal_rule_version_id"]
    stay = ["clause_count", "mapping_state", "requirement_code", "textual", "secretary", "n", "", "status", "request_id", "tokens_left"]
    df = spark.createDataFrame([(k,) for k in gone + stay], "k string")
    got = [r.f for r in df.select(maps.forbidden_key(F.col("k")).alias("f")).collect()]
    assert dict(zip(gone + stay, got, strict=True)) == dict.fromkeys(gone, True) | dict.fromkeys(stay, False)


def test_wait_and_ratio(spark):
    r = spark.sql("select timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:01:30.1234' b, cast(null as timestamp) c").select(
        T.wait_seconds(F.col("a"), F.col("b")).alias("w"), T.wait_seconds(F.col("a"), F.col("c")).alias("n"), T.ratio(F.lit(1), F.lit(3)).alias("r"), T.ratio(F.lit(1), F.lit(0)).alias("z")
    ).first()
    assert (r.w, r.n, r.r, r.z) == (90.123, None, 0.3333, None)


def test_settings(spark):
    from lexmill.sources.settings import DEFAULTS, setting

    assert setting(spark, "rate.login.most") == 10 and setting(spark, "rate.login.seconds") == 300 and all(setting(spark, n) == v for n, v in DEFAULTS.items())
    spark.conf.set("spark.lexmill.page.size", "40")
    try:
        assert setting(spark, "page.size") == 40
        spark.conf.set("spark.lexmill.page.size", "0")
        with pytest.raises(ValueError, match="positive"):
            setting(spark, "page.size")
        with pytest.raises(KeyError):
            setting(spark, "page.colour")
    finally:
        spark.conf.unset("spark.lexmill.page.size")
