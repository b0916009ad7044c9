"""SentencePiece encoding and decoding over a relational lattice.

Text is cut into fragments, between two characters that stand next to each other in no piece: no piece can reach across
such a cut, so fragments are encoded on their own. The distinct fragments are what is worked on. Their substrings of bounded length are exploded and joined with the piece
table by equality; the edges that this finds are grouped by fragment, and one higher-order fold over them picks the
path: for a unigram model Viterbi's, for a BPE model the merges in the order of their scores. (The best sum of scores
is not what a BPE model means: its scores only rank merges.)
"""

from __future__ import annotations

import functools
import heapq
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lexmill.llm.common import Scratch, either, read, tune

#: Where the model file lies; a parameter of every function that needs it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a fragment whose boundaries fit the bits of one long; longer fragments are folded in Python.
MASKED = 60
#: Added to code points that stand in for a piece id.
MARK = 1 << 22
#: Bounds of the list of common fragments that every task holds: documents it is counted on, and its entries.
COMMON_DOCS, COMMON = 3000, 60_000
#: Requests for fragments in one part of the lattice; most fragments have several.
ASKED_A_PART = 60_000
#: Partitions whose requests for one fragment are listed together.
LISTED = 4096
#: Bytes of text that are cut at a time.
SLICE = 4 << 20


class Pieces:
    """The piece table of a model file: ids and scores of its pieces, and where texts may be cut."""

    def __init__(self, pieces: list[tuple[str, float]], unigram: bool, byte_ids: list[int] | None, unknown: int, prefix: bool = True, names: list[str] | None = None):
        """pieces: (text, score) by id, None for ids that text cannot spell; byte_ids: the ids of 256 byte pieces."""
        self.unigram, self.byte_ids, self.unknown, self.prefix = unigram, byte_ids, unknown, prefix
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p is not None}
        self.scores = {p[0]: float(p[1]) for p in pieces if p is not None}
        self.longest = max(map(len, self.ids), default=1)
        self.joints = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.texts = names or [p[0] if p else "" for p in pieces]

    def fragments(self, unit: str) -> list[str]:
        """The unit, cut wherever no piece holds both neighbours."""
        joints, out, start = self.joints, [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in joints:
                out.append(unit[start:i])
                start = i
        out.append(unit[start:])
        return out

    def fallback(self, char: str) -> list[int]:
        """What stands for a character without a piece: its bytes, or the unknown id."""
        if self.byte_ids is None:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def fold_merges(self, word: str) -> list[int]:
        """BPE by a heap of possible merges, best score first, then leftmost: for words too long for the bit fold."""
        n = len(word)
        end, alive = list(range(1, n + 1)), [True] * n
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < n and (s := self.scores.get(word[a : end[b]])) is not None and end[b] - a <= self.longest:
                heapq.heappush(heap, (-s, a, b, end[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and after[a] == b and end[b] == stop):
                continue
            end[a], alive[b], after[a] = stop, False, after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                w = word[i : end[i]]
                out += [self.ids[w]] if w in self.ids else self.fallback(w)
        return out

    def fold_best(self, word: str) -> list[int]:
        """The best-scoring path, by Viterbi in Python: for words too long for the exploded lattice."""
        n, worst = len(word), min(self.scores.values(), default=0.0) - 10
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), 0)] * n
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                score = self.scores.get(word[s:e], worst if s == e - 1 else None)
                if score is not None and best[s][0] + score > best[e][0]:
                    best[e] = (best[s][0] + score, s)
        cuts, at = [], n
        while at:
            cuts.append((best[at][1], at))
            at = best[at][1]
        out: list[int] = []
        for s, e in reversed(cuts):
            out += [self.ids[word[s:e]]] if word[s:e] in self.ids else self.fallback(word[s:e])
        return out

    def decode(self, ids) -> str:
        """The text that ids spell: bytes joined and read as UTF-8, space marks as spaces, without the prefix."""
        return self.spelt(b"".join(map(self.raw.__getitem__, ids)))

    def spelt(self, raw: bytes) -> str:
        out = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if self.prefix and out[:1] == " " else out

    @functools.cached_property
    def raw(self) -> list[bytes]:
        """The bytes of every id."""
        by = {i: bytes([b]) for b, i in enumerate(self.byte_ids or [])}
        return [by.get(i, t.encode()) for i, t in enumerate(self.texts)]


@functools.lru_cache(maxsize=4)
def load(path: str = MODEL) -> Pieces:
    """Read a model file. Models that rewrite characters or fold spaces before encoding are refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kind = model.normalizer_spec, model.trainer_spec.model_type
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kind not in (1, 2):
        raise ValueError("only unigram and BPE models without a character map are supported")
    normal, bytes_ = [], {}
    for i, p in enumerate(model.pieces):
        normal.append((p.piece, p.score) if p.type in (1, 4) else None)
        if p.type == 6:
            bytes_[int(p.piece[3:5], 16)] = i
    unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), 0)
    return Pieces(normal, kind == 1, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None, unknown, norm.add_dummy_prefix)


def _byte_ids(cp, table: Pieces):
    """Ids for a code point without a piece."""
    if table.byte_ids is None:
        return F.array(F.lit(table.unknown))
    ids = F.array(*[F.lit(i) for i in table.byte_ids])
    at = lambda b: F.get(ids, b.cast("int"))
    low = lambda shift: F.shiftright(cp, shift).bitwiseAND(F.lit(63)) + 128
    return (
        F.when(cp < 0x80, F.array(at(cp)))
        .when(cp < 0x800, F.array(at(F.shiftright(cp, 6) + 0xC0), at(low(0))))
        .when(cp < 0x10000, F.array(at(F.shiftright(cp, 12) + 0xE0), at(low(6)), at(low(0))))
        .otherwise(F.array(at(F.shiftright(cp, 18) + 0xF0), at(low(12)), at(low(6)), at(low(0))))
    )


def lattice(words: DataFrame, table: Pieces) -> DataFrame:
    """(word, n, rest, edges): the edges of each word, best first, and its other columns.

    words has a column of distinct words, already dealt out by word: exploding and the broadcast join keep that, so the
    grouping moves nothing. A word may come up once for each number in a column named list, if there is one. The piece
    table is as large as the model file and no larger, whatever the data.
    """
    spark = words.sparkSession
    levels = {v: k for k, v in enumerate(sorted(set(table.scores.values()), reverse=True))}
    pieces = spark.createDataFrame([(p, i, levels[table.scores[p]]) for p, i in table.ids.items()], "piece string, pid int, rank long")
    n, key = F.length("word"), ["word", "n", "list"]
    rest = F.struct(*[c for c in words.columns if c not in ("word", "list")] or [F.lit(0).alias("none")])
    named = words.select("word", n.alias("n"), either(words, "list", "long").alias("list"), rest.alias("rest"))
    starts = named.select(*key, "rest", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select(*key, "rest", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("n"), F.col("s") + table.longest))).alias("e"))
    # The other columns go with one edge that every word has.
    cut = spans.select(*key, F.expr("if(s = 0 and e = 1, rest, null)").alias("rest"), "s", "e", F.expr("substring(word, s + 1, e - s)").alias("piece"))
    # Equality of the text is what joins; a hash of it is the key, since a join on one long is several times as fast.
    keyed = pieces.select(F.xxhash64("piece").alias("h"), F.col("piece").alias("text"), "pid", "rank")
    joined = cut.withColumn("h", F.xxhash64("piece")).join(F.broadcast(keyed), "h", "left")
    joined = joined.withColumn("pid", F.expr("if(text = piece, pid, null)")).withColumn("rank", F.expr("if(text = piece, rank, null)")).filter("pid is not null or e = s + 1")
    # An edge is one long: rank, start, end, id; a character without a piece has its code point for an id, marked.
    code = F.expr(f"shiftleft(coalesce(rank, 0L), 36) | shiftleft(cast(s as long), 30) | shiftleft(cast(e as long), 24) | coalesce(cast(pid as long), {MARK}L + ascii(piece))")
    grouped = joined.groupBy(*key).agg(F.sort_array(F.collect_list(code)).alias("edges"), F.collect_list("rest").alias("rest"))
    return grouped.select("word", "n", F.get("rest", F.lit(0)).alias("rest"), "edges")


def _named(words: DataFrame) -> list:
    """The other columns of words, out of what lattice() made of them."""
    return [F.col(f"rest.{c}").alias(c) for c in words.columns if c not in ("word", "list")]


def _field(x, shift: int, mask: int):
    return F.shiftright(x, shift).bitwiseAND(F.lit(mask)).cast("int")


def _path_ids(path, table: Pieces):
    """The ids of edges in order of their places."""
    ids = lambda x: F.when(x < MARK, F.array(x)).otherwise(_byte_ids(x - MARK, table))
    return F.flatten(F.transform(path, lambda x: ids(_field(x, 0, 0xFFFFFF))))


def merge_fold(words: DataFrame, table: Pieces) -> DataFrame:
    """words with the ids of a BPE model: each step takes the best edge whose two parts stand side by side.

    The state of the fold is a long: bit i is set while position i is a boundary, the sign once nothing fits.
    """
    long_ = F.filter("edges", lambda x: _field(x, 24, 63) - _field(x, 30, 63) > 1)
    one = F.lit(1).cast("long")
    bits = F.transform(long_, lambda x: F.struct(
        F.call_function("shiftleft", one, _field(x, 30, 63)).bitwiseOR(F.call_function("shiftleft", one, _field(x, 24, 63))).alias("ends"),
        F.call_function("shiftleft", F.call_function("shiftleft", one, _field(x, 24, 63) - _field(x, 30, 63) - 1) - 1, _field(x, 30, 63) + 1).alias("inner"),
    ))

    state = lambda mask, bits: F.struct(mask.alias("mask"), bits.alias("bits"))

    def step(at, _):
        mask = at["mask"]
        fits = F.filter(at["bits"], lambda x: (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1))
        rest = F.transform(F.slice(fits, 1, 1), lambda x: mask.bitwiseAND(F.bitwise_not(x["inner"])))
        return F.when(mask < 0, at).otherwise(state(F.coalesce(F.get(rest, F.lit(0)), -mask), at["bits"]))

    def path(at):
        m = F.abs(at["mask"])

        def left(x):
            s, e = _field(x, 30, 63), _field(x, 24, 63)
            kept = lambda p: F.call_function("shiftright", m, p).bitwiseAND(one) == 1
            inside = F.call_function("shiftright", m, s + 1).bitwiseAND(F.call_function("shiftleft", one, e - s - 1) - 1)
            return kept(s) & kept(e) & (inside == 0)

        # Sorted by start: the rank is taken off.
        return F.array_sort(F.transform(F.filter("edges", left), lambda x: x.bitwiseAND(F.lit((1 << 36) - 1))))

    # The edges' bits are part of the state, so that they are worked out once and not at every step.
    whole = state(F.expr("shiftleft(1L, n + 1) - 1L"), bits)
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), whole, step, path)
    return lattice(words, table).select("word", *_named(words), _path_ids(folded, table).alias("ids"))


def viterbi_fold(words: DataFrame, table: Pieces) -> DataFrame:
    """words with the ids of a unigram model: the path with the best sum of scores.

    The state of the fold is the best (score, start, edge) for every position so far; a second fold walks back.
    """
    worst = min(table.scores.values(), default=0.0) - 10
    scores = F.array(*[F.lit(v) for v in sorted(set(table.scores.values()), reverse=True)])
    kind = "array<struct<score:double,s:int,edge:bigint>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(0).cast("long").alias("edge"))).cast(kind)

    def extend(state, p):
        into = F.filter("edges", lambda x: _field(x, 24, 63) == p)
        own = lambda x: F.when(_field(x, 0, 0xFFFFFF) >= MARK, F.lit(worst)).otherwise(F.get(scores, F.shiftright(x, 36).cast("int")))
        sums = F.transform(into, lambda x: F.struct((F.get(state, _field(x, 30, 63))["score"] + own(x)).alias("score"), (-_field(x, 30, 63)).alias("s"), x.alias("edge")))
        best = F.array_max(sums)
        return F.concat(state, F.array(F.struct(best["score"].alias("score"), (-best["s"]).alias("s"), best["edge"].alias("edge"))).cast(kind))

    best = lattice(words, table).withColumn("best", F.aggregate(F.sequence(F.lit(1), F.col("n")), first, extend))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.col("n")),
        F.struct(F.col("n").cast("int").alias("at"), F.array().cast("array<bigint>").alias("path")),
        lambda w, _: F.when(w["at"] <= 0, w).otherwise(F.struct(F.get("best", w["at"])["s"].alias("at"), F.concat(F.array(F.get("best", w["at"])["edge"]), w["path"]).alias("path"))),
    )
    return best.select("word", *_named(words), _path_ids(walk["path"], table).alias("ids"))


class Cutter:
    """Cuts whole columns of texts into fragments, on the bytes of the Arrow arrays that hold them."""

    def __init__(self, joints: set[str], prefix: bool):
        alphabet = sorted({c for j in joints for c in j})
        self.prefix, self.width = prefix, len(alphabet) + 1
        self.number = np.zeros(0x110000, dtype=np.uint16 if self.width < 65536 else np.uint32)
        self.number[[ord(c) for c in alphabet]] = np.arange(1, self.width)
        self.number[ord(" ")] = self.number[ord(SPACE)]
        self.joined = np.zeros(self.width**2, dtype=bool)
        self.joined[[int(self.number[ord(a)]) * self.width + int(self.number[ord(b)]) for a, b in joints]] = True

    def __call__(self, texts):
        """(fragments, their number by text, units by text) of an Arrow string array; nulls count as empty.

        The space mark is written as a space in the fragments. Between two characters that stand next to each other in
        no piece there is a cut, so that no piece reaches across one.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        number = self.number[chars]
        first = np.ones(len(chars), dtype=bool)
        first[1:] = ~self.joined[number[:-1].astype(np.int64) * self.width + number[1:]]
        heads = np.searchsorted(lead, ends)  # by text its first character, then the number of all
        first[heads[:-1][heads[:-1] < len(chars)]] = True
        space = chars == ord(" ")
        unit = space.copy()
        unit[1:] &= ~space[:-1]
        unit[heads[:-1][np.diff(heads) > 0]] = True
        offsets = np.append(lead[first], len(data)).astype(np.int32)
        fragments = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[heads]).astype(np.int32)
        return fragments, count(first), count(unit)


def _slices(texts):
    """(from, length) of runs of texts with at most SLICE bytes together; a longer text is a run of its own."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > SLICE:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(size) > start:
        yield start, len(size) - start


def fold_words(words: DataFrame, table: Pieces) -> DataFrame:
    """words with ids, for distinct non-empty words of at most MASKED characters, dealt out by word."""
    # The edges of a part's words are held as they come; sorting them by word on disk would cost far more.
    words.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(4 * ASKED_A_PART))
    return viterbi_fold(words, table) if table.unigram else merge_fold(words, table)


def fold_long(words: DataFrame, table: Pieces) -> DataFrame:
    """As fold_words for words of any length, by a heap or a table in Python."""
    words = words.drop("list")
    fold, schema = table.fold_best if table.unigram else table.fold_merges, words.schema

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            ids = pa.array([fold(w) for w in batch.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return words.mapInArrow(work, StructType([*schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def encode_words(words: DataFrame, table: Pieces) -> DataFrame:
    """(word, ids) for distinct non-empty words of any length, dealt out by word; other columns stay, but for list."""
    short = fold_words(words.filter(F.length("word") <= MASKED), table)
    return short.unionByName(fold_long(words.filter(F.length("word") > MASKED), table))


def _common(docs: DataFrame, table: Pieces) -> DataFrame:
    """(word): the commonest fragments of a bounded number of documents."""
    few = docs.select("id").orderBy(F.xxhash64("id"), "id").limit(COMMON_DOCS).distinct()
    joints, prefix = table.joints, table.prefix

    def count(batches):
        import pyarrow as pa

        cut = Cutter(joints, prefix)
        for batch in batches:
            for start, n in _slices(batch.column("text")):
                counted = cut(batch.column("text").slice(start, n))[0].value_counts()
                yield pa.RecordBatch.from_arrays(counted.flatten(), names=["word", "n"])

    counted = docs.join(F.broadcast(few), "id").select("text").mapInArrow(count, "word string, n long")
    best = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON)
    return best.select(F.translate("word", " ", SPACE).alias("word"))


def bucket_key(part: int, buckets: int) -> int:
    """A number of its own for each partition, such that the table's hash deals them to the buckets in turn."""
    found, start = 0, 0
    while True:
        at = np.arange(start, start + (1 << 16), dtype=np.uint32)
        hits = np.flatnonzero(_murmur3(at).astype(np.int64) % buckets == part % buckets)
        if found + len(hits) > part // buckets:
            return start + int(hits[part // buckets - found])
        found, start = found + len(hits), start + len(at)


def _murmur3(x: np.ndarray) -> np.ndarray:
    """What Spark's hash() gives for ints."""
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    with np.errstate(over="ignore"):
        h = turn(np.uint32(42) ^ (turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def _plain(ids, units, data, ends):
    """(doc_id, n_units, raw) as Arrow arrays."""
    import pyarrow as pa

    return [ids, units, pa.array([bytes(data[a:b]) for a, b in pairwise(ends.tolist())], pa.binary())]


def encode(docs: DataFrame, path: str = MODEL, finish=_plain, schema: str = "doc_id long, n_units int, raw binary") -> DataFrame:
    """(doc_id, n_units, raw): every row's piece ids, as little-endian 32-bit numbers in raw; see with_ids.

    finish, if given, makes Arrow arrays of the result out of the ids of some rows where they arise, their numbers of
    units, their raw bytes in one buffer and the bounds in it; schema is that of its rows.

    Each text is cut once. A partition numbers its fragments in order of appearance, behind the common ones, which are
    counted on a bounded sample, encoded first and travel with the code; its texts are kept as those numbers, in a
    bucketed table whose buckets are the partitions. Every fragment that is not common goes through the lattice once
    for the whole table and is sent back to the partitions that asked for it, where ids take the place of numbers. Only
    fragments are shuffled: the bucketed side of that join stays where it was written.

    Null texts count as empty and give no ids. Rows keep their multiplicity. An empty table gives an empty result. A
    text of any length is cut as a whole; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "pieces")
    table = load(path)
    rows = docs.select(either(docs, "doc_id", "long").alias("id"), either(docs, "text", "string").alias("text"))
    known = scratch.keep(encode_words(scratch.keep(_common(rows, table)).repartition(8, "word"), table)).toArrow().combine_chunks()
    common = (_strings(known.column("word")), _strings(known.column("ids")))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joints, prefix = table.joints, table.prefix

    def number(batches):
        """A row for each run of texts: the fragments that are new to the partition, and the texts as numbers."""
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        key = bucket_key(TaskContext.get().partitionId(), buckets)
        cut, zip_ = Cutter(joints, prefix), pa.Codec("zstd", 1)
        held = pc.replace_substring(common[0], SPACE, " ")
        for batch in batches:
            for start, n in _slices(batch.column("text")):
                fragments, counts, units = cut(batch.column("text").slice(start, n))
                kinds = fragments.dictionary_encode()
                at = pc.index_in(kinds.dictionary, value_set=held)
                new = kinds.dictionary.filter(at.is_null())
                place = np.empty(len(at), dtype=np.int32)
                fresh = at.is_null().to_numpy(zero_copy_only=False)
                place[~fresh] = at.drop_null().to_numpy()
                place[fresh] = len(held) + np.arange(len(new), dtype=np.int32)
                codes = place[kinds.indices.to_numpy()]
                base = len(held) - len(common[0])
                held = pa.concat_arrays([held, new])
                # Bytes of equal weight side by side compress best.
                blob = zip_.compress(codes.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                n_long = pc.sum(pc.greater(pc.utf8_length(new), MASKED)).as_py() or 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int32()), pa.array([base], pa.int32()), pa.array([len(new)], pa.int32()), pa.array([n_long], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), new),
                     pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("id").slice(start, n)), one(counts, pa.int32()), one(units, pa.int32()), pa.array([len(codes)], pa.int32()), pa.array([blob], pa.binary())],
                    names=["key", "base", "n_new", "n_long", "new", "ids", "counts", "units", "n_codes", "codes"],
                )

    cut_ = rows.mapInArrow(number, "key int, base int, n_new int, n_long int, new array<string>, ids array<long>, counts array<int>, units array<int>, n_codes int, codes binary")
    texts = scratch.bucketed(cut_, "key", buckets)
    total, n_long = texts.agg(F.coalesce(F.sum("n_new"), F.lit(0)), F.coalesce(F.sum("n_long"), F.lit(0))).first()
    parts = max(1, -(-total // ASKED_A_PART))
    asked = texts.select("key", "base", F.posexplode("new").alias("at", "word"))
    asked = asked.select("key", (F.col("base") + F.col("at")).alias("at"), F.translate("word", " ", SPACE).alias("word"))
    # Who asked for a word is listed with it. Keys of partitions differ, so no list is longer than LISTED.
    dealt = asked.select("*", F.floor(F.col("key") / LISTED).alias("list")).repartition(parts, "word")
    wanted = dealt.groupBy("word", "list").agg(F.collect_list(F.struct("key", "at")).alias("who"))
    folded = encode_words(wanted, table) if n_long else fold_words(wanted, table)
    sent = folded.select(F.explode("who").alias("who"), "ids").select("who.key", "who.at", "ids")
    texts = texts.select("key", "base", "n_new", "ids", "counts", "units", "n_codes", "codes")

    def meet(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        at = right.column("at").to_numpy()
        order = np.argsort(at, kind="stable")
        expected = pc.sum(left.column("n_new")).as_py()
        if len(at) != expected or (len(at) and not np.array_equal(at[order], np.arange(expected))):
            raise RuntimeError(f"{len(at)} fragments came back where {expected} were asked for")
        own = pa.concat_arrays([common[1], _strings(right.column("ids").take(order))])
        own = own.cast(pa.large_binary())
        zip_ = pa.Codec("zstd")
        out = []
        for row in range(left.num_rows):
            field = lambda name: left.column(name)[row]  # noqa: E731, B023
            n = field("n_codes").as_py()
            planes = zip_.decompress(field("codes").as_buffer(), 4 * n)
            codes = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, n).T).view(np.int32).ravel()
            got = own.take(pa.array(codes))
            bounds = np.concatenate([[0], np.cumsum(field("counts").values.to_numpy())])
            ends = np.frombuffer(got.buffers()[1], dtype=np.int64)[bounds] if n else np.zeros(len(bounds), np.int64)
            data = memoryview(got.buffers()[2] or b"") if n else memoryview(b"")
            out.append(finish(field("ids").values, field("units").values, data, ends))
        return pa.table([pa.chunked_array(c) for c in zip(*out, strict=True)], names=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return texts.groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(meet, schema)


def _strings(column):
    """A column as one Arrow array: strings as they are, lists of int as their little-endian bytes."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_list(column.type):
        return column
    flat = column.flatten().to_numpy().astype("<i4")
    ends = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def with_ids(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded with ids (array of int) and text (what they decode to) in place of raw."""
    table = load(path)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [np.frombuffer(r, dtype="<i4") for r in batch.column("raw").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            text = pa.array([table.decode(i.tolist()) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_units"), lists, text], names=["doc_id", "n_units", "ids", "text"])

    return encoded.mapInArrow(work, "doc_id long, n_units int, ids array<int>, text string")


def summary(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_units, n_pieces, ids_sha256, decoded_sha256): digests of the ids, as little-endian 32-bit numbers, and
    of the text decoded from them; rows as in encode. n_units counts runs of the space mark with what follows."""
    import hashlib

    table = load(path)

    def digest(ids, units, data, ends):
        import pyarrow as pa

        each = np.frombuffer(data, dtype="<i4")
        spelt = pa.array(table.raw, pa.large_binary()).take(pa.array(each)) if len(each) else None
        text = memoryview(spelt.buffers()[2] or b"") if spelt else memoryview(b"")
        places = np.frombuffer(spelt.buffers()[1], dtype=np.int64)[ends // 4] if spelt else ends
        of_ids = [hashlib.sha256(data[a:b]).hexdigest() for a, b in pairwise(ends.tolist())]
        of_text = [hashlib.sha256(table.spelt(bytes(text[a:b])).encode()).hexdigest() for a, b in pairwise(places.tolist())]
        return [ids, pa.array(units.to_numpy().astype(np.int64)), pa.array(np.diff(ends) // 4), pa.array(of_ids), pa.array(of_text)]

    return encode(docs, path, digest, "doc_id long, n_units long, n_pieces long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_units, n_pieces, ids_sha256 and decoded_sha256 for every document."""
    return summary(read(spark, sf_dir, "documents"))
