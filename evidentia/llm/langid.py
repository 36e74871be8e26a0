"""Language of each word and text by a linear-chain conditional random field.

Words are the runs of letters of a text, letters by their Unicode category. A run longer than
PIECE letters, such as a sentence in a script without spaces, is cut into pieces of PIECE, and
each piece is a position of the chain. A position's scores for each language are the sums of
learned weights of its features: affixes of one to three letters, inner n-grams of two and
three over all its letters, and its place in the lexicon (its own identity where it is frequent
in the training spans, else a mark for unknown words). Learned transitions tie neighbouring
words. The forward-backward recursions give the probability of each language for each word; a
text's language is the one with the largest mean over its words, and that mean is its score.

The model is fitted on a bounded sample: SPANS spans of at most SPAN words for each language,
or as many fewer as keep all within SAMPLE, of documents in the order of a hash. Every
language of the table is learned. Spans of several languages are spliced into code-switched
training sequences, so transitions are learned from switches that are known. Prediction reads
every word of every text.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_batches

#: Documents per language that the model is fitted on, words taken of each, and documents in all.
SPANS, SPAN, SAMPLE = 400, 120, 12_000
#: Languages beyond which fitting raises an error.
LANGUAGES = 1_000
#: Texts of one id and language that a span may come from.
SAME_ID = 2
#: Times the ids to take that are ranked for each language.
SPARE = 4
PIECE = 24
BUCKETS = 1 << 15
LEXICON = 400
EPOCHS, BATCH, RATE = 4, 64, 0.25
SEED = 5
UNKNOWN = "und"
#: Words of one forward-backward run, and words of context on each side of a longer text's windows: the recursions forget their start far sooner.
WINDOW, CONTEXT = 1024, 128
#: Pieces whose scores a task keeps, and letters of the longest string that it keeps the pieces of.
KEPT, SHORT = 150_000, 64
#: Characters that are looked up, and positions that are run, in one go.
BLOCK, RUN = 2_000_000, 500_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: What no run of letters begins or ends with.
NEVER = string.digits + string.punctuation


def pieces_of(text: str | None) -> list[str]:
    """The chain's positions: lower-case runs of letters, `^` before a run's first and `$` after its last letter."""
    if text and len(text) < PIECE and text.isalpha():
        return [f"^{text.lower()}$"]
    out = []
    for word in WORD.findall(text.lower()) if text else ():
        marked = [word[i : i + PIECE] for i in range(0, len(word), PIECE)]
        marked[0], marked[-1] = f"^{marked[0]}", f"{marked[-1]}$" if len(marked) > 1 else f"^{word}$"
        out += marked
    return out


def features(pieces: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the weights that each piece adds up, piece after piece, and where each piece's begin.

    They are the hashed n-grams of two and three characters, marks included, those of four at
    either end, and a row of the piece's own or of all unknown ones.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(pieces)), size)
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    rows, owners = [np.fromiter((lexicon.get(x, len(lexicon)) for x in pieces), np.int64, len(pieces)) + BUCKETS], [np.arange(len(pieces))]
    for n in (2, 3, 4):
        at = np.flatnonzero(np.arange(len(codes)) + n <= ends[owner])
        if n == 4:
            at = at[(at == (ends - size)[owner[at]]) | (at + n == ends[owner[at]])]
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        rows.append((h % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[at])
    whose = np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(rows)[order], np.searchsorted(whose[order], np.arange(len(pieces)))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # rows of features() x languages
    steps: np.ndarray  # languages x languages
    starts: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, pieces: list[str]) -> np.ndarray:
        """The scores of each piece for each language."""
        rows, begin = features(pieces, self.lexicon)
        return np.add.reduceat(self.weights[rows], begin, axis=0) if pieces else np.zeros((0, len(self.languages)), self.weights.dtype)


class Emissions:
    """exp of the scores of pieces, largest one, for the strings between white space; a task has one, and it is bounded between blocks."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.strings: dict[str, list[int]] = {}
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table for all positions of the texts, and how many positions each text has."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        bare = pc.utf8_trim(coded.dictionary, NEVER).dictionary_encode()
        found, fresh, strings = [], [], self.strings
        for name in bare.dictionary.to_pylist():
            rows = strings.get(name)
            if rows is None:
                rows = []
                for piece in pieces_of(name):
                    row = self.rows.get(piece)
                    if row is None:
                        row = self.rows[piece] = len(self.rows)
                        fresh.append(piece)
                    rows.append(row)
                if len(name) <= SHORT:
                    strings[name] = rows
            found.append(rows)
        if fresh:
            new = [self.model.emissions(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
            scores = np.concatenate(new)
            self.table = np.concatenate((self.table, np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)))
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
        at = bare.indices.to_numpy()[coded.indices.to_numpy()]
        n = size[at]
        before = np.cumsum(n) - n
        rows = flat[np.repeat((np.cumsum(size) - size)[at] - before, n) + np.arange(int(n.sum()))]
        ends = np.concatenate(([0], np.cumsum(n)))[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return rows.astype(np.int32), np.diff(ends)


def marginals(e: np.ndarray, starts_at: np.ndarray, lengths: np.ndarray, steps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once: probabilities of each position, log-partition of each sequence, expected transitions.

    e holds the exponentials of the scores of the sequences, one after the other; starts_at
    and lengths name them. All positions are laid out by their place in the sequence, longer
    sequences first, so a step treats a slice.
    """
    order = np.argsort(-lengths, kind="stable")
    at, size = starts_at[order], lengths[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    off = np.concatenate(([0], np.cumsum(active)))
    place = np.concatenate([at[:n] + t for t, n in enumerate(active.tolist())]) if longest else np.zeros(0, np.int64)
    a, s = np.exp(steps).astype(e.dtype), np.exp(starts).astype(e.dtype)
    laid = e[place]
    alpha, scale, pair = np.empty_like(laid), np.empty(len(laid), e.dtype), np.zeros(steps.shape)
    now = None
    for t in range(longest):
        x, y = off[t], off[t + 1]
        now = (now[: y - x] @ a if t else s) * laid[x:y]
        total = now.sum(axis=1)
        now = now / total[:, None]
        alpha[x:y], scale[x:y] = now, total
    logs = np.zeros(len(laid))
    logs[place] = np.log(scale)
    beta = np.ones((0, e.shape[1]), e.dtype)
    p = np.empty_like(laid)
    for t in range(longest - 1, -1, -1):
        x, y = off[t], off[t + 1]
        if len(beta) < y - x:
            beta = np.concatenate((beta, np.ones((y - x - len(beta), e.shape[1]), e.dtype)))
        out = alpha[x:y] * beta
        p[x:y] = out / out.sum(axis=1, keepdims=True)
        if t:
            ahead = laid[x:y] * beta / scale[x:y, None]
            pair += a * (alpha[off[t - 1] : off[t - 1] + y - x].T @ ahead)
            beta = ahead @ a.T
    back = np.empty_like(p)
    back[place] = p
    return back, np.add.reduceat(logs, starts_at) if len(starts_at) else np.zeros(0), pair


def train(spans: list[tuple[str, list[str]]]) -> Model | None:
    """Fits the field on (language, pieces) by AdaGrad on the log-likelihood of code-switched sequences."""
    spans = sorted((lang, words) for lang, words in spans if words)
    languages = sorted({lang for lang, _ in spans})
    if not languages:
        return None
    k = len(languages)
    counts = {lang: Counter() for lang in languages}
    for lang, words in spans:
        counts[lang].update(words)
    frequent = sorted({w for c in counts.values() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n > 1})
    lexicon = {w: i for i, w in enumerate(frequent)}
    known = {w: i for i, w in enumerate(sorted(set().union(*counts.values())))}
    rng = np.random.default_rng(SEED)
    place = {lang: i for i, lang in enumerate(languages)}
    pools: list[list[np.ndarray]] = [[] for _ in languages]
    for lang, words in spans:
        pools[place[lang]].append(np.array([known[w] for w in words]))
    sequences = []
    for own, pool in enumerate(pools):
        for words in pool:
            text, marks, at = [], [], 0
            while at < len(words):
                n = int(rng.integers(8, 40))
                text.append(words[at : at + n])
                marks.append(np.full(len(text[-1]), own))
                at += n
                if k > 1 and rng.random() < 0.3:
                    other = int((own + rng.integers(1, k)) % k)
                    text.append(pools[other][int(rng.integers(len(pools[other])))][: int(rng.integers(3, 20))])
                    marks.append(np.full(len(text[-1]), other))
            sequences.append((np.concatenate(text), np.concatenate(marks)))
    flat, begin = features(list(known), lexicon)
    begin = np.append(begin, len(flat))
    weights, steps, starts = np.zeros((BUCKETS + len(lexicon) + 1, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(x, 1e-6) for x in (weights, steps, starts)]
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(sequences))
        for b in range(0, len(shuffled), BATCH):
            some = [sequences[i] for i in shuffled[b : b + BATCH]]
            names, rows = np.unique(np.concatenate([text for text, _ in some]), return_inverse=True)
            n = begin[names + 1] - begin[names]
            owner = np.repeat(np.arange(len(names)), n)
            used = flat[np.repeat(begin[names] - (np.cumsum(n) - n), n) + np.arange(len(owner))]
            table = np.add.reduceat(weights[used], np.cumsum(n) - n, axis=0)
            gold = np.concatenate([m for _, m in some])
            lengths = np.array([len(m) for _, m in some])
            at = np.cumsum(lengths) - lengths
            p, _, pair = marginals(np.exp(table - table.max(axis=1, keepdims=True))[rows], at, lengths, steps, starts)
            miss = np.eye(k)[gold] - p
            by_word = np.zeros_like(table)
            np.add.at(by_word, rows, miss)
            cells, where = np.unique(used, return_inverse=True)
            g_weights = np.zeros((len(cells), k))
            np.add.at(g_weights, where, by_word[owner])
            inner = np.ones(len(gold), bool)
            inner[at] = False
            later = np.flatnonzero(inner)
            g_steps = -pair
            np.add.at(g_steps, (gold[later - 1], gold[later]), 1)
            # the small decay of weights reaches those that the batch uses
            for x, g, s, c in ((weights, g_weights, sums[0], cells), (steps, g_steps, sums[1], slice(None)), (starts, miss[at].sum(axis=0), sums[2], slice(None))):
                g = g / len(some)
                s[c] += g * g
                x[c] += RATE * g / np.sqrt(s[c]) - 1e-4 * x[c]
    return Model(languages, weights.astype(np.float32), steps, starts, lexicon)


def predict(model: Model | None, texts: list[str | None], table: Emissions | None = None) -> tuple[list[str], list[float]]:
    """The language and score of each text; `und` and 0 for a text without letters, or without a model."""
    names, values = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, values
    table, first = table or Emissions(model), 0
    while first < len(texts):
        last, n = first, 0
        while last < len(texts) and (n < BLOCK or last == first):
            n += len(texts[last] or "")
            last += 1
        if len(table.rows) > KEPT:
            table.clear()
        rows, lengths = table.of([t or "" for t in texts[first:last]])
        ends = np.cumsum(lengths)
        # (text, first position with context, first, last, last with context) of each window
        cuts = [(i, max(b, c - CONTEXT), c, min(z, c + WINDOW), min(z, c + WINDOW + CONTEXT)) for i, (b, z) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)) for c in range(b, z, WINDOW)]
        sums, at = np.zeros((last - first, len(model.languages))), 0
        while at < len(cuts):
            to, n = at, 0
            while to < len(cuts) and (n < RUN or to == at):
                n += cuts[to][4] - cuts[to][1]
                to += 1
            some = np.array(cuts[at:to])
            size = some[:, 4] - some[:, 1]
            begin = np.cumsum(size) - size
            taken = rows[np.repeat(some[:, 1] - begin, size) + np.arange(n)]
            p, _, _ = marginals(table.table[taken], begin, size, model.steps, model.starts)
            inner = np.stack((begin + some[:, 2] - some[:, 1], begin + some[:, 3] - some[:, 1]), axis=1).ravel()
            total = np.add.reduceat(np.concatenate((p, np.zeros_like(p[:1]))).astype(np.float64), inner, axis=0)[::2]
            np.add.at(sums, some[:, 0], total)
            at = to
        for i in np.flatnonzero(lengths).tolist():
            best = int(sums[i].argmax())
            names[first + i], values[first + i] = model.languages[best], min(1.0, max(0.0, float(sums[i][best]) / int(lengths[i])))
        first = last
    return names, values


def fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo five; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def _limit(ids: int, taken: int = SPANS) -> int:
    """The largest hash of the ids to rank: about SPARE * taken of so many ids lie below it."""
    return 2**63 - 1 if ids <= SPARE * taken else (SPARE * taken << 64) // ids - 2**63


def fit(docs: DataFrame) -> Model | None:
    """Learns from rows with a language and an id outside the held-out fold.

    The languages, and SPANS ids of each (SAMPLE in all), the least by hash, are chosen from
    (doc_id, lang) alone. A limit on the hash, set by each language's number of ids, leaves
    about SPARE times as many to rank, however many documents a language has. Then spans of
    SPAN words at a place that a hash names are cut from these texts on the executors, and only
    they come to the driver: SPANS of a language, SAME_ID of an id in it at most, so an id in many rows
    takes no other language's place. A table with more than LANGUAGES languages raises an error.
    """
    spark = docs.sparkSession
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id", "lang", "text")
    counts = able.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    taken = max(1, min(SPANS, SAMPLE // max(1, len(counts))))
    limits = spark.createDataFrame([(lang, _limit(ids, taken)) for lang, ids in counts], "lang string, most long")
    hashed = F.xxhash64("doc_id")
    few = able.join(F.broadcast(limits), "lang").where(hashed <= F.col("most")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= taken)
    ids = spark.createDataFrame([(r[0],) for r in chosen.select("doc_id").distinct().collect()], "doc_id long")  # SAMPLE, or a row for each language, at most

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, lang, text in batch[["doc_id", "lang", "text"]].itertuples(index=False):
                words = pieces_of(text)
                start = zlib.crc32(str(doc).encode()) % max(1, len(words) - SPAN + 1)
                out.append((doc, lang, " ".join(words[start : start + SPAN])))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "span"])

    cut = able.join(F.broadcast(ids), "doc_id", "left_semi").mapInPandas(spans, "doc_id long, lang string, span string").where("span <> ''").distinct()
    # an id may stand in many rows: of an id and a language the first texts by a hash count, and of a language the first `taken`
    each = cut.withColumn("hash", F.xxhash64("span")).withColumn("turn", F.row_number().over(Window.partitionBy("lang", "doc_id").orderBy("hash", "span")))
    few = each.where(F.col("turn") <= SAME_ID).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("turn", F.xxhash64("doc_id"), "doc_id"))).where(F.col("n") <= taken)
    return train([(r.lang, r.span.split(" ")) for r in few.orderBy("lang", "doc_id", "span").collect()])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; a text alone decides them. Columns of these names are replaced.

    A null or empty text, and one without letters, is `und` with score 0, and so is every text
    where no language was learned. Texts of any length are read whole. Repeated rows stay, an
    empty table gives an empty table, and other columns pass through.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score")

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = None if held.value is None else Emissions(held.value)
        for texts in batches:
            names, values = predict(held.value, texts.where(texts.notna(), None).to_list(), table)
            yield pd.DataFrame({"lang_pred": names, "score": values})
        pa.default_memory_pool().release_unused()

    return rest.withColumn("_guess", guess(F.col(text_col))).select(*rest.columns, F.col("_guess.lang_pred").alias("lang_pred"), F.col("_guess.score").alias("score"))
