"""Mapping clauses to requirements by weighted phrase rules that explain themselves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import holds_phrase, normalize, words
from lexmill.functions.vocab import DEFAULT_WEIGHTS

SIGNAL = "struct<kind:string,matched:string,delta:int>"


class Misconfigured(ValueError):
    """A rule set that may not be used as it is."""


def _frozen(value):
    """Lists as tuples, to any depth."""
    return tuple(map(_frozen, value)) if isinstance(value, list | tuple) else value


def _plain(value):
    """Tuples as lists, to any depth."""
    return list(map(_plain, value)) if isinstance(value, list | tuple) else value


@dataclass(frozen=True, kw_only=True)
class Rules:
    """Phrases of one requirement, as data; the threshold has no default."""

    code: str
    confirm_threshold: int
    exact_phrases: Sequence[str] = ()
    aliases: Sequence[str] = ()
    keyword_groups: Sequence[Sequence[str]] = ()
    negative_patterns: Sequence[str] = ()
    section_heading_terms: Sequence[str] = ()
    weights: dict[str, int] = field(default_factory=dict)

    @classmethod
    def parse(cls, code: str, config: dict | None) -> Rules:
        """From a stored payload; absent, null and empty lists are the same. Unread settings are accepted."""
        given = {f.name: (config or {}).get(f.name) for f in fields(cls) if f.name != "code"}
        if type(given["confirm_threshold"]) is not int:
            raise Misconfigured(f"{code}: confirm_threshold must be an integer")
        return cls(code=code, **{name: _frozen(value) for name, value in given.items() if value or value == 0})

    def payload(self) -> dict:
        """The stored form; parse() of it gives the same rules."""
        stored = {f.name: _plain(getattr(self, f.name)) for f in fields(self) if f.name != "code"}
        return stored | {"weights": DEFAULT_WEIGHTS | self.weights}

    def tests(self, body: Column, body_words: Column, heading: Column, heading_words: Column) -> list[tuple[str, str, Column]]:
        """(kind, matched, condition) of every signal, in the order in which they are explained."""
        found = [("exact_phrase", p, holds_phrase(body, body_words, p)) for p in self.exact_phrases]
        found += [("alias", p, holds_phrase(body, body_words, p)) for p in self.aliases]
        found += [("keyword_group", " + ".join(g), reduce(Column.__and__, [holds_phrase(body, body_words, p) for p in g])) for g in self.keyword_groups if g]
        found += [("section_heading", p, holds_phrase(heading, heading_words, p)) for p in self.section_heading_terms]
        return found + [("negative_pattern", p, holds_phrase(body, body_words, p)) for p in self.negative_patterns]

    def signals(self, *clause: Column) -> Column:
        """array of struct(kind, matched, delta) for a normalized clause."""
        w = DEFAULT_WEIGHTS | self.weights
        made = [F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(matched).alias("matched"), F.lit(w[kind]).alias("delta"))) for kind, matched, test in self.tests(*clause)]
        return F.array_compact(F.array(*made)).cast(f"array<{SIGNAL}>") if made else F.array().cast(f"array<{SIGNAL}>")

    def total(self, *clause: Column) -> Column:
        """The sum of the weights of all signals, which are not listed for it."""
        w = DEFAULT_WEIGHTS | self.weights
        return reduce(Column.__add__, [F.when(test, w[kind]).otherwise(0) for kind, _, test in self.tests(*clause)], F.lit(0))


def score(clauses: DataFrame, rules: Sequence[Rules], content: str = "content", heading: str | None = None, signals: bool = True, only: Sequence[Column] | None = None, keep: str | None = None) -> DataFrame:
    """clauses with one row for each rule set: requirement, threshold, score and, if wanted, signals.

    Each clause is normalized and split into words once and meets all rule sets in its own row: the cross product needs
    no join. only, a condition for each rule set, leaves out clauses that it does not concern before they are tested.
    keep names a column for the normalized content.
    """
    names, taken = clauses.columns, {"body": "__body", "words": "__words", "heading": "__heading", "heading_words": "__heading_words"}
    body = clauses.withColumn("__body", normalize(F.col(content))).withColumn("__heading", normalize(F.col(heading)) if heading else F.lit(""))
    body = body.withColumn("__words", words(F.col("__body"))).withColumn("__heading_words", words(F.col("__heading")))
    clause = [F.col(c) for c in taken.values()]
    per = []
    for i, r in enumerate(rules):
        made = r.signals(*clause).alias("signals") if signals else r.total(*clause).alias("score")
        row = F.struct(F.lit(r.code).alias("requirement"), F.lit(r.confirm_threshold).alias("threshold"), made)
        per.append(F.when(only[i], row) if only else row)
    kept = [F.col("__body").alias(keep)] if keep else []
    names = [*names, keep] if keep else names
    rows = body.select(*clauses.columns, *kept, F.explode(F.array_compact(F.array(*per)) if only else F.array(*per)).alias("__r")).select(*names, "__r.*")
    return rows.withColumn("score", F.aggregate("signals", F.lit(0), lambda a, s: a + s["delta"])) if signals else rows


def explanation(signals: Column) -> Column:
    """kind: 'matched' (+n) for each signal."""
    return F.transform(signals, lambda s: F.format_string("%s: '%s' (%+d)", s["kind"], s["matched"], s["delta"]))


def state(scored: DataFrame, document: list[str], clause: Column, *more: Column) -> DataFrame:
    """One row per document and requirement: its state, counts, best score, evidence, and more aggregates.

    Some clause at the threshold confirms, and all such clauses stay as evidence; else any positive score leaves it
    unresolved with the positive clauses; else there is none. Evidence is ordered by score, then clause id.
    """
    rows = scored.withColumn("__id", clause.cast("string"))
    ranked = F.struct((-F.col("score")).alias("rank"), F.col("__id").alias("id"))
    per = rows.groupBy(*document, "requirement", "threshold").agg(
        F.count("*").alias("clauses"), F.max("score").alias("best"),
        F.count_if(F.col("score") >= F.col("threshold")).alias("qualifying"), F.count_if(F.col("score") > 0).alias("positive"),
        F.sort_array(F.collect_list(F.when((F.col("score") > 0) | (F.col("score") >= F.col("threshold")), ranked))).alias("__kept"), *more,
    )
    found = F.when(F.col("qualifying") > 0, "CONFIRMED").when(F.col("positive") > 0, "UNRESOLVED").otherwise("NONE")
    kept = F.filter("__kept", lambda e: F.when(F.col("qualifying") > 0, -e["rank"] >= F.col("threshold")).otherwise(-e["rank"] > 0))
    return per.withColumn("state", found).withColumn("evidence", F.transform(kept, lambda e: e["id"])).drop("__kept")


def precision_check(scored: DataFrame) -> DataFrame:
    """Hits on a population in which nothing should match: per requirement the pairs tried, hits, and hits that rest
    on a single signal."""
    hit = F.col("score") >= F.col("threshold")
    positive = F.size(F.filter("signals", lambda s: s["delta"] > 0))
    return scored.groupBy("requirement").agg(F.count("*").alias("pairs"), F.count_if(hit).alias("hits"), F.count_if(hit & (positive == 1)).alias("single_signal_hits"))
