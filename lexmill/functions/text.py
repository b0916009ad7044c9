"""Text functions, each from Column to Column. Patterns name their classes, since Java's shorthands know only ASCII."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as Unicode has them.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def fold(text: str) -> str:
    """What normalize() makes of a literal, when a plan is built."""
    return re.sub(r"\s+", " ", text or "").strip().lower()


def normalize(text: Column) -> Column:
    """Runs of white space become one space, ends are stripped, letters lower case; null counts as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " ")))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def normalize_text(text: Column) -> Column:
    """Line ends to LF, runs of space, tab and no-break space to one space, at most one blank line, ends stripped."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    spaces = F.regexp_replace(lines, "[ \t ]+", " ")
    return strip(F.regexp_replace(spaces, "\n{3,}", "\n\n"))


def phrase_pattern(phrase: str) -> str:
    """A pattern for a folded phrase on word boundaries."""
    return f"(?<!{WORD})\\Q{phrase}\\E(?!{WORD})"


def contains_phrase(body: Column, phrase: str) -> Column:
    """Whether a normalized body holds the phrase between word boundaries; an empty phrase is never held.

    The plain search comes first: it is cheap and rules out most rows before the pattern runs.
    """
    p = fold(phrase)
    return body.contains(p) & body.rlike(phrase_pattern(p)) if p else F.lit(False)


def words(body: Column) -> Column:
    """The words of a normalized body."""
    return F.split(body, f"[^{WORD[1:-1]}]+")


def holds_phrase(body: Column, its_words: Column, phrase: str) -> Column:
    """As contains_phrase, for a body whose words are at hand: a phrase of one word is looked up among them."""
    p = fold(phrase)
    return F.array_contains(its_words, p) if re.fullmatch(r"\w+", p) else contains_phrase(body, p)


def any_phrase(body: Column, phrases) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | contains_phrase(body, p)
    return found


#: The ways in which a line states its number. Number first (a title must begin with a capital), then two
#: worded forms.
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+([A-Z][^\n]{0,120})?"
SECTION = r"^(?:Section|SECTION|Clause|CLAUSE)\s+(\d+(?:\.\d+)*)\.?\s*([^\n]{0,120})"
ARTICLE = r"^(?:Article|ARTICLE)\s+([IVXLC]+|\d+)\.?\s*([^\n]{0,120})"


def clause_number(line: Column) -> Column:
    """struct(number, title) that a line states about itself, both null where it states none; never invented."""
    t = strip(line)
    fits = (F.length(t) > 0) & (F.length(t) <= 200)
    number = title = F.lit(None).cast("string")
    for pattern in (ARTICLE, SECTION, NUMBERED):
        hit = t.rlike(pattern)
        number = F.when(hit, F.regexp_extract(t, pattern, 1)).otherwise(number)
        title = F.when(hit, F.nullif(F.regexp_replace(F.regexp_extract(t, pattern, 2), r"^[ .:\-]+|[ .:\-]+$", ""), F.lit(""))).otherwise(title)
    return F.when(fits, F.struct(number.alias("number"), title.alias("title"))).otherwise(F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title")))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def email_key(text: Column) -> Column:
    return strip(F.lower(text))


def role_code(text: Column) -> Column:
    return F.upper(strip(text))


def safe_filename(name: Column) -> Column:
    """Letters, digits and ``._- `` only; a name that loses everything becomes "document"."""
    kept = strip(F.regexp_replace(name, r"[^\p{L}\p{N}._\- ]", ""))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("document"))


def suffix(name: Column) -> Column:
    """.pdf or .docx, else the empty string."""
    s = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(s.isin(".pdf", ".docx"), s).otherwise(F.lit(""))


def safe_request_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9._:-]{1,200}$"), F.lit(False))


#: Fixed value: what credentials and tokens look like.
SECRET = r"scrypt\$|bcrypt\$|\$argon2|-----BEGIN|eyJ[A-Za-z0-9_-]{10,}\."


def secret_shaped(text: Column) -> Column:
    return text.rlike(SECRET)


def fingerprint(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def content_id(*parts: Column) -> Column:
    """An id made of content, the same on every run."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, half to even, null for nothing."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def or_default(value: Column, default: str) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def wait_seconds(start: Column, end: Column) -> Column:
    """Seconds between two instants, to three digits; null if either is."""
    return F.bround((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 3)
