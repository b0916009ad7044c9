"""Substring dedup by hashing lines and runs of sentences: of repeats beyond chance the earliest stays, all others go."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Bitmap, Scratch, either, read, tune
from lexmill.llm.suffixes import REMOVED_SQL, _merged

#: Inside a line, a unit ends with the sentence that gives it so many words or characters. No line is too short.
RUN_WORDS, RUN_CHARS = 20, 120
#: How many units of the whole table may go though their repeats are chance, in expectation.
CHANCE = 0.01
#: Words are counted in so many cells (2 ** CELL_BITS) by the first bits of their MD5.
CELL_BITS = 18
#: Words whose weight a task remembers before it starts anew.
REMEMBERED = 1 << 20

_stop = re.compile("\\. |\u3002".encode())


def segments(raw: bytes) -> list[tuple[int, int, list[bytes], int]]:
    """(start, end, words, line) of each sentence that is not blank, in bytes; the end lies behind the separator.

    Lines end at a line feed, sentences at the end of a line, at a full stop and a space or at an ideographic full
    stop. Words are in lower case (A-Z), the last without its full stop.
    """
    found, at = [], 0
    for number, line in enumerate(raw.split(b"\n")):
        start, last = 0, len(line)
        for m in [*_stop.finditer(line), None]:
            stop, after = (m.start(), m.end()) if m else (last, last + 1)
            words = line[start:stop].lower().rstrip(b".").split()
            if words:
                found.append((at + start, min(at + after, len(raw)), words, number))
            start = after
        at += last + 1
    return found


def units(own: list[tuple[int, int, list[bytes], int]], run_words: int = RUN_WORDS, run_chars: int = RUN_CHARS) -> list[tuple[int, int, int, int]]:
    """(first, last, start, end) of every unit of a text, by its sentences and in bytes.

    From each sentence, the run that ends where it has run_words or run_chars or where the line ends, whichever comes
    first, and the whole text: so a line is a unit or is covered by its units, however short it is.
    """
    chars = [len(b" ".join(words).decode("utf-8", "surrogatepass")) for _, _, words, _ in own]
    found, last, n, size = [], 0, 0, 0
    for i in range(len(own)):
        while last < len(own) and (last <= i or own[last][3] == own[i][3] and n < run_words and size < run_chars):
            n, size, last = n + len(own[last][2]), size + chars[last], last + 1
        found.append((i, last, own[i][0], own[last - 1][1]))
        n, size = n - len(own[i][2]), size - chars[i]
    if own and found[0][1] < len(own):
        found.append((0, len(own), own[0][0], own[-1][1]))
    return found


def cell(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:3], "big") >> (24 - CELL_BITS)


def word_weights(rows: DataFrame) -> np.ndarray:
    """By cell, 1,024 times the natural logarithm of all words over those in the cell, rounded.

    All words of the table are counted, in an array of fixed size (2 MB). Words that share a cell are taken for more
    frequent than they are, which makes repeats look more like chance and never less.
    """

    def count(batches):
        import pyarrow as pa

        total, known = np.zeros(1 << CELL_BITS, dtype=np.int64), {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                at = []
                for _, _, words, _ in segments(text.encode("utf-8", "surrogatepass")):
                    for w in words:
                        c = known.get(w)
                        if c is None:
                            c = known[w] = cell(w)
                        at.append(c)
                np.add.at(total, at, 1)
                if len(known) > REMEMBERED:
                    known.clear()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["cell", "n"])

    got = rows.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.ones(1 << CELL_BITS)
    n[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return np.round(1024 * np.log(max(1.0, float(got["n"].sum())) / n)).astype(np.int32)


def _unit_rows(rows: DataFrame, run_words: int, run_chars: int, weights: np.ndarray | None) -> DataFrame:
    """(id, uid, start, end, d1, d2, weight): the digests of all units, and the sums of their words' weights."""
    sent = None if weights is None else rows.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        import pyarrow as pa

        known = {}

        def weigh(words):
            total = 0
            for w in words:
                x = known.get(w)
                if x is None:
                    x = known[w] = int(sent.value[cell(w)])
                total += x
            return total

        for batch in batches:
            who, starts, ends, low, high, sums = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = segments(text.encode("utf-8", "surrogatepass"))
                forms = [b" ".join(words) for _, _, words, _ in own]
                before = np.concatenate([[0], np.cumsum([weigh(words) if sent else 0 for _, _, words, _ in own])]).astype(np.int64)
                for first, last, start, end in units(own, run_words, run_chars):
                    d = xxhash.xxh3_128_intdigest(b" ".join(forms[first:last]))
                    who.append(i)
                    starts.append(start)
                    ends.append(end)
                    low.append(d & 0xFFFFFFFFFFFFFFFF)
                    high.append(d >> 64)
                    sums.append(before[last] - before[first])
                if len(known) > REMEMBERED:
                    known.clear()
            take = pa.array(who, pa.int64())
            sides = [pa.array(np.array(d, dtype=np.uint64).view(np.int64)) for d in (low, high)]
            columns = [batch.column("id").take(take), batch.column("uid").take(take), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), *sides, pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "uid", "start", "end", "d1", "d2", "weight"])

    return rows.mapInArrow(work, "id long, uid long, start int, end int, d1 long, d2 long, weight long")


def remove_lines(docs: DataFrame, run_words: int = RUN_WORDS, run_chars: int = RUN_CHARS, chance: float | None = CHANCE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of docs.

    Units (see units) of equal normal form, their words with single spaces, are grouped by a 128-bit digest over the
    whole table. Where a form occurs more often than chance explains, the occurrence with the smallest (doc_id, row,
    offset) stays and the rest are removed, whichever document they stand in; spans lists the removed runs of the
    original text as start:end in bytes. A sentence goes only where it stands in a unit that occurred earlier.

    Chance: were words drawn one by one with the frequencies they have in the whole table, a form would be expected
    m = (number of units) * (product of its words' frequencies) times; n occurrences exceed that where Chernoff's bound
    on their probability, exp(n - m) * (m / n)^n, is below chance / (number of units). A line of one common word
    recurs by chance and stays; a line of a few words that stands in five documents goes, and so does any longer
    repeat. With chance None every repeat goes.

    The earliest occurrence is found by a partial minimum, so that a line of a third of all documents moves one row a
    task, and only forms that go are joined back. Null texts count as empty. Every row is a document of its own,
    whether or not another has its doc_id and text: the texts are written once with a number for each row, which
    decides among rows of one doc_id. Null ids rank before all others. A text of any length is read as a whole. An
    empty table gives an empty result; other columns are not read, whatever their names.
    """
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.coalesce(either(docs, "text", "string"), F.lit(""))
    rows = scratch.keep(docs.select(either(docs, "doc_id", "long").alias("id"), F.monotonically_increasing_id().alias("uid"), text.alias("text")))
    all_ = scratch.keep(_unit_rows(rows, run_words, run_chars, None if chance is None else word_weights(rows)))
    place, n = F.struct("id", "uid", "start"), F.col("n").cast("double")
    often = all_.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("weight").alias("weight")).filter("n > 1")
    if chance is not None:
        log_all = float(np.log(max(1, all_.count())))
        log_m = F.lit(log_all) - F.col("weight") / 1024.0
        excess = n * (F.log(n) - log_m) - n + F.exp(log_m)
        often = often.filter((F.log(n) > log_m) & (excess > F.lit(log_all - float(np.log(chance)))))
    often = scratch.keep(often.select("d1", "d2", "first"))
    gone = all_.select("uid", "start", "end", "d1", "d2").join(often, ["d1", "d2"]).filter((F.col("uid") != F.col("first.uid")) | (F.col("start") != F.col("first.start")))
    spans = scratch.keep(gone.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    scratch.drop(all_, often)
    hit = Bitmap(spans, "uid")
    touched = rows.filter(hit.maybe("uid")).join(spans, "uid", "left").select("id", "text", "spans")
    zero = F.lit(0).cast("long")
    intact = rows.filter(~hit.maybe("uid")).select(F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.lit("").alias("spans"))
    return intact.unionByName(_merged(touched))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans for every document."""
    return remove_lines(read(spark, sf_dir, "documents"))


ORACLE_OP7 = rf"""
WITH i AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '\. |\n|\x{{3002}}') AS pieces, regexp_extract_all(coalesce(text, ''), '\. |\n|\x{{3002}}') AS stops FROM documents
), d AS (
  SELECT doc_id, hex(encode(text)) AS h FROM i
), u AS (
  SELECT doc_id, unnest(pieces) AS piece, unnest(list_concat(stops, [''])) AS stop, unnest(range(len(pieces))) AS k FROM i
), v AS (
  SELECT doc_id, k, strlen(piece) + strlen(stop) AS bytes, stop = chr(10) AS ends,
         regexp_extract_all(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.]+$', ''), '[^\x20\x09-\x0D]+') AS words
  FROM u
), p AS (
  SELECT *, CAST(sum(bytes) OVER (PARTITION BY doc_id ORDER BY k) - bytes AS BIGINT) AS a, count(*) FILTER (ends) OVER (PARTITION BY doc_id ORDER BY k) - CAST(ends AS INT) AS line FROM v
), n AS (  -- sentences that are not blank, with what they add
  SELECT doc_id, line, words, a, a + bytes AS b, array_to_string(words, ' ') AS form, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j,
         sum(len(words)) OVER (PARTITION BY doc_id ORDER BY k) AS so_many, sum(length(array_to_string(words, ' '))) OVER (PARTITION BY doc_id ORDER BY k) AS so_long, len(words) AS own, length(array_to_string(words, ' ')) AS size
  FROM p WHERE len(words) > 0
), cells AS (  -- words by cell
  SELECT CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) // {1 << (24 - CELL_BITS)} AS cell, count(*) AS n
  FROM (SELECT unnest(words) AS w FROM n) GROUP BY 1
), weighed AS (
  SELECT cell, CAST(round(1024 * ln(CAST((SELECT sum(n) FROM cells) AS DOUBLE) / n)) AS BIGINT) AS weight FROM cells
), heavy AS (
  SELECT doc_id, j, sum(y.weight) AS weight
  FROM (SELECT doc_id, j, unnest(words) AS w FROM n) x JOIN weighed y ON y.cell = CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) // {1 << (24 - CELL_BITS)}
  GROUP BY doc_id, j
), f AS (  -- the last sentence of the run that begins with each, and the whole text
  SELECT x.doc_id, x.j, coalesce(min(y.j) FILTER (y.so_many - x.so_many + x.own >= {RUN_WORDS} OR y.so_long - x.so_long + x.size >= {RUN_CHARS}), max(y.j)) AS last
  FROM n x JOIN n y ON y.doc_id = x.doc_id AND y.line = x.line AND y.j BETWEEN x.j AND x.j + {RUN_WORDS - 1}
  GROUP BY x.doc_id, x.j
  UNION
  SELECT doc_id, 1, max(j) FROM n GROUP BY doc_id
), units AS (
  SELECT f.doc_id, min(n.a) AS a, max(n.b) AS b, md5(string_agg(n.form, ' ' ORDER BY n.j)) AS digest, sum(y.weight) AS weight
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.j BETWEEN f.j AND f.last JOIN heavy y ON y.doc_id = n.doc_id AND y.j = n.j GROUP BY f.doc_id, f.j, f.last
), forms AS (
  SELECT digest, CAST(count(*) AS DOUBLE) AS n, any_value(weight) / 1024.0 AS weight FROM units GROUP BY digest HAVING count(*) > 1
), scale AS (
  SELECT ln(count(*)) AS log_all FROM units
), expected AS (
  SELECT digest, n, log_all, log_all - weight AS log_m FROM forms, scale
), beyond AS (
  SELECT digest FROM expected WHERE ln(n) > log_m AND n * (ln(n) - log_m) - n + exp(log_m) > log_all - ln({CHANCE})
), s AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, a) AS place FROM units JOIN beyond USING (digest)) WHERE place > 1
), {REMOVED_SQL}"""
