"""Phrase collocations by Toivonen's sampling, counted exactly.

A sample proposes the frequent words and word pairs of each language. The full pass counts, in
one reading, what the sample proposes and its negative border: all words, the pairs of two
proposed words, the triples of two proposed pairs. A border member that turns out frequent is
a failure: what holds it was not counted. Another pass then takes the words and pairs known
to be frequent by now and counts what they span and no earlier pass did, until nothing
frequent is outside the sets of the last pass. As phrases have three words at most, that is
after three passes. The sample only decides what is counted when; every count is of all texts.

The sets that a pass asks are bitmaps of hashes, so what is broadcast has a fixed bound: a full
bitmap lets more be counted than need be, and never less. Tasks cut texts into words and number
them in Arrow and numpy, a block of bytes at a time, and hand on counts of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import small_batches, staged

LEAST, LONGEST = 10, 3
#: A candidate goes if a longer one holds it in this share of its occurrences.
INSIDE = 50
TOP = 2000
UNKNOWN = "und"
#: Bytes of text that the sample has, about, and the least count of what it proposes, if it isn't everything.
SAMPLE, PROPOSED = 32 << 20, 2
#: Bits of a bitmap for each member, and at most (32 MB).
SPARSE, MOST_BITS = 16, 1 << 28
#: Bytes of text that a task numbers at a time.
BLOCK = 8 << 20
#: Parts of a word's rows in joins, and of a language's in ranks: a part keeps its first TOP.
SALTS, PARTS = 4, (4096, 128, 4)
SEED = 13

_BORDERS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(_BORDERS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTS = "lang string, k int, phrase string, c long"
_ROTATE = 31


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first << np.uint64(_ROTATE)) | (first >> np.uint64(64 - _ROTATE))) ^ second


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _words(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their number at each place, whether the next word is in the same piece)."""
    data = np.frombuffer(blob, np.uint8)
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    borders = np.cumsum(kind == 2, dtype=np.int32)
    piece = borders[starts]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    flat = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[kind == 0]])])
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.append(piece[1:] == piece[:-1], False)[: len(starts)]


def _blocks(blob: bytes, block: int) -> Iterator[bytes]:
    """Parts of about this size that end at borders of pieces."""
    at = 0
    while at < len(blob):
        end = at + block
        if end < len(blob):
            cut = max(blob.rfind(bytes([b]), at, end) for b in _BORDERS)
            if cut < 0:
                cut = min((x for b in _BORDERS if (x := blob.find(bytes([b]), end)) >= 0), default=len(blob))
            end = cut + 1
        yield blob[at:end]
        at = end


def _counted(lang: str, blob: bytes, passes: list[tuple[np.ndarray, np.ndarray]] | None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases in blob that the last of these passes asks for; without passes those of all words and pairs."""
    words, ids, same = _words(blob)
    size = len(words)

    def rows(k: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        text = pa.StringArray.from_buffers(len(phrases), phrases.buffers()[1], phrases.buffers()[2]) if phrases.offset == 0 and not phrases.null_count else phrases.cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(text), np.int32))), pa.array(np.full(len(text), k, np.int32)), text, pa.array(counts.astype(np.int64))], ["lang", "k", "phrase", "c"])

    def joined(*parts: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*(words.take(pa.array(p)) for p in parts), pa.scalar(b" ", pa.binary()))

    if size and (passes is None or len(passes) == 1):
        yield rows(0, pa.array([b""]), np.array([len(ids)]))
        yield rows(1, words, np.bincount(ids, minlength=size))
    pairs = np.flatnonzero(same)
    triples = np.zeros(0, np.int64)
    if passes is not None:
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, size)
        keys = _mixed(hashes[ids[:-1]], hashes[ids[1:]])
        triples = np.flatnonzero(same[:-1] & same[1:])
        for last, (one, two) in zip((i == len(passes) - 1 for i in range(len(passes))), passes, strict=True):
            asked = _has(one, hashes)[ids]
            held = asked[pairs] & asked[pairs + 1] if len(pairs) else np.zeros(0, bool)
            pairs = pairs[held if last else ~held]
            asked = _has(two, keys)
            held = asked[triples] & asked[triples + 1] if len(triples) else np.zeros(0, bool)
            triples = triples[held if last else ~held]
    if len(pairs):
        found, counts = np.unique(ids[pairs] * size + ids[pairs + 1], return_counts=True)
        yield rows(2, joined(found // size, found % size), counts)
    if len(triples):
        two, back = np.unique(ids[triples] * size + ids[triples + 1], return_inverse=True)
        found, counts = np.unique(back * size + ids[triples + 2], return_counts=True)
        first = two[found // size]
        yield rows(3, joined(first // size, first % size, found % size), counts)


def _count(texts: DataFrame, passes=None) -> DataFrame:
    """(lang, k, phrase, c) of texts (lang, text); k 0 has the number of all words."""
    block = BLOCK

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = passes.value if passes is not None else None
        held, bytes_held = {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                # texts are joined by a border of pieces
                for blob in _blocks(b"\n".join(parts), block):
                    yield from _counted(lang, blob, asked)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                bytes_held += len(text)
            if bytes_held >= block:
                yield from flush()
                bytes_held = 0
        yield from flush()

    # a block hands on a phrase once, so there is little left to add up before the shuffle
    keys = ("lang", "k", "phrase")
    return texts.mapInArrow(local, _COUNTS).repartition(*keys).groupBy(*keys).agg(F.sum("c").alias("c"))


def _key(lang: str = "lang", phrase: str = "phrase") -> F.Column:
    """The hash of a word, or of a pair from those of its words; the same as in the tasks."""
    first, second = (F.xxhash64(lang, F.substring_index(phrase, " ", n)) for n in (1, -1))
    turned = F.shiftleft(first, _ROTATE).bitwiseOR(F.shiftrightunsigned(first, 64 - _ROTATE))
    return F.when(F.col("k") == 1, second).otherwise(turned.bitwiseXOR(second))


def _bitmap(members: DataFrame) -> np.ndarray:
    """The bitmap of the keys of members (lang, k, phrase): at least SPARSE bits each up to MOST_BITS in all."""
    wanted = max(1 << 15, SPARSE * members.count())
    bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    at = members.select(_key().bitwiseAND(F.lit(bits - 1)).alias("at"))
    parts = at.groupBy(F.expr("at div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # MOST_BITS at most
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _failures(members: DataFrame, bits) -> int:
    """How many of the members are not in the broadcast bitmap."""

    def known(keys: pa.Array) -> pa.Array:
        return pa.array(_has(bits.value, keys.to_numpy(zero_copy_only=False).astype(np.uint64)))

    return members.where(~F.arrow_udf(known, "boolean")(_key())).count()


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(lang, k, phrase, c): how often every phrase of k words up to LONGEST with c >= least stands in the texts of a language, exactly; k 0 has a language's number of words.

    Phrases lie within pieces, overlaps count, a null language is UNKNOWN, null and empty texts
    have no words; a language without words has no rows. Repeated rows count each. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where(F.col("text").isNotNull())
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rate = min(1.0, sample / max(1, size))
    part = texts if rate == 1 else texts.sample(rate, SEED)
    proposed = staged(_count(part).where((F.col("k") > 0) & (F.col("c") >= (least if rate == 1 else min(least, PROPOSED)))), "proposed")
    asked = [tuple(_bitmap(proposed.where(F.col("k") == k)) for k in (1, 2))]
    counted = []
    while True:
        sets = spark.sparkContext.broadcast(asked)
        counted.append(staged(_count(texts, sets).where((F.col("k") == 0) | (F.col("c") >= least)), "phrases"))
        known = reduce(DataFrame.union, counted)
        last = [known.where(F.col("k") == k) for k in (1, 2)]
        tests = [spark.sparkContext.broadcast(b) for b in asked[-1]]
        failed = [_failures(m, b) for m, b in zip(last, tests, strict=True)]
        for b in (sets, *tests):
            b.destroy()
        if not any(failed):
            return known
        asked.append(tuple(_bitmap(m) if n else b for m, n, b in zip(last, failed, asked[-1], strict=True)))


def _looked_up(rows: DataFrame, column: str, counts: DataFrame, out: str) -> DataFrame:
    """rows with the count of the phrase in `column`; a common word's rows are dealt to SALTS parts."""
    salted = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("c").alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    dealt = rows.withColumn("_mine", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    on = (dealt["lang"] == salted["_lang"]) & (dealt[column] == salted["_phrase"]) & (dealt["_mine"] == salted["_part"])
    return dealt.join(salted, on).drop("_lang", "_phrase", "_part", "_mine")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two and three words.

    a is the phrase's count, l and r those of its parts at the cut with the lowest score
    floor(1000000 * a * a / (l * r)), the earliest of equal ones. Phrases that a longer
    candidate holds in INSIDE percent of their occurrences are left out. Order: score, a, both
    falling, then the phrase by its bytes. Products are exact to 38 digits. Odd rows are as in
    `frequent_phrases`; columns other than lang and text are not looked at.
    """
    counts = frequent_phrases(docs, least, sample)
    candidates = counts.where("k >= 2").withColumnRenamed("c", "a").withColumn("words", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", 1, F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, LONGEST), " ").alias("rest"))
    parts = counts.where("k in (1, 2)")
    cuts = _looked_up(_looked_up(cuts, "first", parts, "l"), "rest", parts, "r")
    sides = [F.max(F.when(F.col("cut") == cut, F.col(c))).alias(f"{c}{cut}") for cut in range(1, LONGEST) for c in ("l", "r")]
    whole = cuts.groupBy("lang", "phrase", "a").agg(*sides)
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    for cut in range(1, LONGEST):
        whole = whole.withColumns({"above": F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a"), "below": exact(f"l{cut}") * exact(f"r{cut}")}).withColumn(f"s{cut}", F.expr("above div below"))
    # the last of the lowest falling scores, so the earliest cut of equal ones
    best = reduce(lambda x, cut: F.when(F.col(f"s{cut}") < x["score"], F.struct(F.col(f"s{cut}").alias("score"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r"))).otherwise(x), range(2, LONGEST), F.struct(F.col("s1").alias("score"), F.col("l1").alias("l"), F.col("r1").alias("r")))
    scored = whole.select("lang", "phrase", "a", best.alias("best"))
    inner = candidates.where(F.col("k") == LONGEST).select("lang", "a", F.explode(F.array(*(F.array_join(F.slice("words", at, 2), " ") for at in (1, 2)))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < INSIDE * F.col("a"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for size in PARTS:
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(size))).orderBy(*order)))
        rows = ranked.where(F.col("_rank") <= top).drop("_rank")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("k = 0").select("lang", F.col("c").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
