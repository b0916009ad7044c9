"""Map and redaction functions on string-keyed maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import vocab
from lexmill.functions.text import secret_shaped, strip


def overlay(defaults: Column, given: Column) -> Column:
    """The defaults with what is given laid over them; a null map gives nothing."""
    kept = F.map_filter(defaults, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.when(given.isNull(), defaults).otherwise(F.map_concat(kept, given))


def forbidden_key(key: Column) -> Column:
    """Whether a key may not be logged: as a whole, by a secret word in it, or by a forbidden ending."""
    k = F.regexp_replace(F.lower(strip(key)), "-", "_")
    whole = F.lower(strip(key)).isin(*vocab.FORBIDDEN_KEYS) | k.isin(*vocab.FORBIDDEN_KEYS)
    words = F.arrays_overlap(F.split(k, "_"), F.array(*[F.lit(w) for w in vocab.SECRET_WORDS]))
    ends = [k.endswith(f"_{f}") for f in vocab.FORBIDDEN_KEYS if f not in vocab.EXACT_ONLY_KEYS]
    tail = ends[0]
    for e in ends[1:]:
        tail = tail | e
    return whole | words | tail


def redact_value(value: Column) -> Column:
    """Secret-shaped values are masked, long ones are replaced with their length."""
    return (
        F.when(secret_shaped(value), F.lit("[redacted]"))
        .when(F.length(value) > vocab.MAX_LOGGED, F.concat(F.lit("["), F.length(value).cast("string"), F.lit(" chars omitted]")))
        .otherwise(value)
    )


def redact(fields: Column) -> Column:
    """A map without forbidden keys and with every value redacted; nested fields come as dotted keys."""
    kept = F.map_filter(fields, lambda k, _: ~F.exists(F.split(k, r"\."), forbidden_key))
    return F.transform_values(kept, lambda _, v: redact_value(v))


def operator_message(message: Column) -> Column:
    """An error message up to the first payload marker, then redacted like any value."""
    quoted = "|".join("\\Q" + m + "\\E" for m in vocab.PAYLOAD_MARKERS)
    head = strip(F.regexp_replace(message, f"(?s)({quoted}).*$", ""))
    cut = message.rlike(quoted)
    return redact_value(F.when(~cut, strip(message)).otherwise(strip(F.concat(head, F.lit(" [payload omitted]")))))


def traceback_tail(lines: Column) -> Column:
    """The last lines of a traceback, as many as are logged."""
    return F.slice(lines, F.greatest(F.size(lines) - vocab.TRACEBACK_LINES, F.lit(0)) + 1, F.lit(vocab.TRACEBACK_LINES))


def cause_chain(causes: Column) -> Column:
    """The nearest causes of an error, each cut at the first payload marker and redacted."""
    return F.transform(F.slice(causes, 1, vocab.CAUSES), operator_message)
