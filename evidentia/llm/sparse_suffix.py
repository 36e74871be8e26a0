"""Passages that repeat across documents, by a sparse suffix array.

Of a document's word suffixes only those are kept that start at minimisers: the place m(s) where
the hash of GRAM words is the least of the WINDOW that begin at s. The content selects them, so
the LEAST words from s on keep the same suffix wherever they stand. A kept suffix stands for
its zone: the windows of LEAST words whose minimiser it is. All of them hold the first SHARED
words after it, and so two suffixes can only match if these words are equal.

The sort needs no order beyond equal beginnings, so it is a grouping by hashed prefixes, which
combines before the shuffle and makes no large group of a hot passage. Suffixes whose first
SHARED words stand in one row only are dropped before anything else of them is built. Among
the rest, equal zones are one kind. A kind that stands in two rows or more is matched whole,
to the left and to the right of its suffix. Other kinds are extended as far as they go: each
window of theirs is compared with the windows of all kinds that begin with the same words. So
each window of LEAST words that another row has is found, whichever neighbour has it, and no
other is. Windows that overlap or touch are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import drop_path, new_path, small_batches, staged

GRAM, WINDOW, LEAST = 8, 32, 50
#: Words after a kept position that all windows of its zone hold.
SHARED = LEAST - WINDOW + 1
#: Characters of texts, and words, that are treated in one go.
BLOCK, SEGMENT = 1_000_000, 1 << 21
#: Kinds of a suffix beyond which its windows are spread over tasks.
HEAVY = 512
FACTOR = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 22) - 1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased, of all texts, and where each text's begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
    at = coded.indices.to_numpy()
    full = np.array([x != "" for x in names], bool)[at] if names else np.zeros(0, bool)
    ends = np.concatenate(([0], np.cumsum(full)))
    return hashes[at[full]] if names else np.zeros(0, np.uint64), ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Spans:
    """Hashes of runs of words, by sums of powers modulo 2^64."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, FACTOR, np.uint64))))
            less = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64))))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * less[:n])))

    def hashes(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """The hash of `size` words from each place on."""
        with np.errstate(over="ignore"):
            return _mixed((self.sums[at + size] - self.sums[at]) * self.power[at] + np.asarray(size, np.uint64))


def zones(words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Spans]]:
    """(text, suffix, window, windows, first, hashes) of the zones of some texts that stand one after the other.

    A zone's suffix and first window count from the beginning of the part of the words that
    `hashes` is of, `first` is that window's place in its text.
    """
    whose = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for begin in range(0, len(words), SEGMENT):
        part = words[begin : begin + SEGMENT + LEAST - 1]
        if len(part) < LEAST:
            continue
        spans = Spans(part)
        place = np.arange(len(part) - GRAM + 1)
        least = spans.hashes(place, GRAM) & ~PLACE | place.astype(np.uint64)
        for step in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-step], least[step:])
        s = np.flatnonzero(np.arange(begin, begin + len(least)) + LEAST <= ends[1:][whose[begin : begin + len(least)]])
        s = s[s < SEGMENT]
        if not len(s):
            continue
        p = (least[s] & PLACE).astype(np.int64)
        new = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1))
        first = s[new]
        yield whose[begin + first], p[new], first, np.diff(np.append(new, len(s))), first + begin - ends[whose[begin + first]], spans


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of batches with a column `text`, as many at a time as have BLOCK bytes of text, or one."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0), np.int64))
        first = 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(size, BLOCK + (size[first - 1] if first else 0), side="right")))
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()


def _row() -> F.Column:
    return F.xxhash64("doc_id", "text")


def kept_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, first, n, g, z) of each kept suffix: its zone's first window and their number, and the hashes of its first words and of its zone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for text, suffix, at, n, first, spans in zones(*word_hashes(block["text"])):
                g, z = spans.hashes(suffix, SHARED), spans.hashes(at, n + LEAST - 1)
                some = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [block["doc_id"].take(some), block["row"].take(some), pa.array(first), pa.array(n.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(z.view(np.int64))],
                    names=["doc_id", "row", "first", "n", "g", "z"],
                )

    return docs.select("doc_id", _row().alias("row"), "text").mapInArrow(run, "doc_id long, row long, first long, n int, g long, z long")


def zone_windows(docs: DataFrame) -> DataFrame:
    """The elements of a row's array `asked` (structs with first and n), each with the hashes of its windows in the row's text."""
    fields = "g long, z long, lo long, hi long, least long, most long, kinds long"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            words, ends = word_hashes(block["text"])
            asked = block["asked"].flatten()
            whose = np.repeat(np.arange(block.num_rows), np.asarray(pc.list_value_length(block["asked"])))
            begin, count = ends[whose] + np.asarray(asked.field("first")), np.asarray(asked.field("n"), np.int64)
            # a zone of another text whose row has the same hash is left to that text
            own = np.flatnonzero(begin + count + LEAST - 1 <= ends[whose + 1])
            asked, begin, count = asked.take(pa.array(own)), begin[own], count[own]
            found = np.zeros(int(count.sum()), np.uint64)
            out = np.cumsum(count) - count
            for at in range(0, len(words), SEGMENT):
                some = np.flatnonzero((begin >= at) & (begin < at + SEGMENT))
                if len(some):
                    step = np.arange(int(count[some].sum())) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                    spans = Spans(words[at : at + SEGMENT + WINDOW + LEAST])
                    found[np.repeat(out[some], count[some]) + step] = spans.hashes(np.repeat(begin[some] - at, count[some]) + step, LEAST)
            lists = pa.ListArray.from_arrays(pa.array(np.append(out, len(found)).astype(np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(asked.field(x) for x in names), lists], names=[*names, "windows"])

    return docs.select("text", "asked").mapInArrow(run, f"{fields}, windows array<long>")


def _matched(kinds: pa.Table) -> pa.RecordBatch:
    """(g, z, a, b, least, most): the runs of windows a to b of kinds of one row each that some other row has, all kinds of a suffix being there."""
    size = np.asarray(pc.list_value_length(kinds["windows"]), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    w = np.asarray(kinds["windows"].combine_chunks().flatten())
    g, lo, hi = (np.asarray(kinds[c]) for c in ("g", "lo", "hi"))
    bottom, top = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    least, most = np.asarray(pc.fill_null(kinds["least"], top)), np.asarray(pc.fill_null(kinds["most"], bottom))
    order = np.lexsort((w, g[owner]))
    new = np.flatnonzero(np.concatenate(([True], (w[order][1:] != w[order][:-1]) | (g[owner][order][1:] != g[owner][order][:-1]))))
    group = np.empty(len(owner), np.int64)
    group[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    first, last, low, high = (f.reduceat(x[owner][order], new)[group] for f, x in ((np.minimum, lo), (np.maximum, hi), (np.minimum, least), (np.maximum, most)))
    good = (lo == hi)[owner] & ((first != lo[owner]) | (last != lo[owner]))
    at = np.flatnonzero(good)
    begins = np.ones(len(at), bool)
    begins[1:] = (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1])
    runs = np.flatnonzero(begins)
    if not len(at):
        runs, low, high = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        low, high = np.minimum.reduceat(low[at], runs), np.maximum.reduceat(high[at], runs)
    a, b = at[runs], at[np.append(runs[1:], len(at)) - 1] if len(at) else at
    return pa.RecordBatch.from_arrays(
        [kinds["g"].combine_chunks().take(owner[a]), kinds["z"].combine_chunks().take(owner[a]), pa.array(offset[a].astype(np.int32)), pa.array(offset[b].astype(np.int32)), pa.array(low, mask=low == top), pa.array(high, mask=high == bottom)],
        names=["g", "z", "a", "b", "least", "most"],
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_matched of kinds sorted by g; the kinds of the last suffix of a batch wait for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.asarray(batch["g"])
        cut = int(np.flatnonzero(g[1:] != g[:-1])[-1]) + 1 if (g[1:] != g[:-1]).any() else 0
        if held and np.asarray(held[-1]["g"])[-1] != g[0]:
            yield _matched(pa.Table.from_batches(held))
            held = []
        if cut:
            yield _matched(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _matched(pa.Table.from_batches(held))


def _matches(base: DataFrame, held: DataFrame) -> DataFrame:
    """(g, z, a, b, least, most): the windows a to b of each kind of zone that another row has, and the least and largest doc_id of some rows that have them."""
    sides = [F.min("row").alias("lo"), F.max("row").alias("hi"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")]
    kinds = staged(held.groupBy("g", "z").agg(*sides, F.min_by(F.struct("first", "n"), "row").alias("place"), F.max("n").alias("n")), "kinds")
    whole = kinds.where("lo <> hi").select("g", "z", F.lit(0).alias("a"), (F.col("n") - 1).cast("int").alias("b"), "least", "most")
    several = staged(kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.max(F.col("lo") == F.col("hi")).alias("open")).where("open and kinds > 1").select("g", "kinds"), "several")
    fields = ("lo", "hi", "least", "most")
    asked = kinds.join(several, "g").groupBy(F.col("lo").alias("row")).agg(F.collect_list(F.struct("place.first", "place.n", "g", "z", *fields, "kinds")).alias("asked"))
    open_kinds = staged(zone_windows(base.withColumn("row", _row()).join(asked, "row")), "windows")
    light = open_kinds.where(F.col("kinds") <= HEAVY).drop("kinds").repartition("g").sortWithinPartitions("g").mapInArrow(_compared, "g long, z long, a int, b int, least long, most long")
    heavy = open_kinds.where(F.col("kinds") > HEAVY).select("g", "z", *fields, F.posexplode("windows").alias("a", "w"))
    found = heavy.groupBy("g", "w").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.min("least").alias("least"), F.max("most").alias("most")).where("first <> last")
    spread = heavy.where("lo = hi").select("g", "z", "a", "w").join(staged(found, "found"), ["g", "w"])
    return staged(whole.union(light).union(spread.select("g", "z", "a", F.col("a").alias("b"), "least", "most")), "matches")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, partner): each maximal run of words that repeats in another document.

    start and end count a text's words from zero, end not included. Each window of LEAST words
    that another row has is in a run, and each run is made of such windows. partner is a
    doc_id of a place where some of the run was found: the smallest, or where that is the
    run's own the largest (its own if another text has the same doc_id). Repeats inside one
    document, and rows equal in doc_id and text, are no others. Null, empty and short texts
    have no runs. Rows with a null doc_id match like others. Runs of rows with one doc_id and
    one text are given once. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") >= 2 * LEAST - 1)
    path = new_path(spark, "suffixes")
    kept_suffixes(base).write.parquet(path)
    suffixes = spark.read.schema("doc_id long, row long, first long, n int, g long, z long").parquet(path)
    repeated = staged(suffixes.groupBy("g").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi").select("g"), "repeated")
    held = staged(suffixes.join(repeated, "g"), "held")
    drop_path(spark, path)
    at = held.select("g", "z", "row", "doc_id", "first").join(_matches(base, held), ["g", "z"])
    each = at.select(
        "row",
        "doc_id",
        (F.col("first") + F.col("a")).alias("start"),
        (F.col("first") + F.col("b") + LEAST).alias("end"),
        F.when(F.col("least").eqNullSafe(F.col("doc_id")), F.col("most")).otherwise(F.col("least")).alias("partner"),
    )
    text = Window.partitionBy("row", "doc_id").orderBy("start", "end")
    begins = F.coalesce(F.col("start") > F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = each.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = marked.groupBy("row", "doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("partner").alias("partner"))
    return runs.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "partner")
