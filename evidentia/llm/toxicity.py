"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has an interpolated Kneser-Ney model of words and word pairs.
Both orders use continuation counts, the number of different words that an expression
follows, so copies of a text count once. Pairs back off to the class's words, words to their stems (their
first letters), and these to counts that both classes share and that are gathered from all
documents (in how many of them an expression occurs). An expression that is rare, or whose
probabilities in the two classes differ by less than e or not beyond chance (G-test), is left
to its backoff and gives no evidence of its own: how likely a word is within its stem is
shared by both classes and cancels.

A text's evidence is the difference of its log-likelihoods under the two models, divided by
its length; a logistic curve turns it into a score. The difference splits into a number for
each word, one for each predecessor and a correction for the pairs that are kept.

Class counts come from a bounded sample: SAMPLE labelled documents in the order of a hash,
whole texts. The curve is fitted on the same documents by cross-fitting: each is scored by
models that have not seen its fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import fold
from .staging import small_batches, staged

#: Labelled documents that the class counts are taken from.
SAMPLE = 6_000
FOLDS = (1, 2, 3, 4)
DISCOUNT = 0.75
#: Contexts that a kept expression has in both classes together, at least; and the least G statistic.
RARE, SURE = 3, 15.0
#: The least log-ratio of a kept expression's probabilities in the classes.
CLEAR = 1.0
#: Letters of stems.
STEMS = (6, 5, 4, 3)
#: Words whose log-ratio a worker remembers.
CACHED = 400_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def stems_of(word: str) -> list[str]:
    """The stems of a longer word, longest first."""
    return [f"{word[:k]}*" for k in STEMS if len(word) > k]


def _stems(column: str) -> F.Column:
    return F.explode(F.array(*(F.when(F.length(column) > k, F.concat(F.substring(column, 1, k), F.lit("*"))) for k in STEMS)))


def _g(a: float, n: float, b: float, m: float) -> float:
    """The G statistic of a of n against b of m."""
    if not n or not m:
        return 0.0
    p = (a + b) / (n + m)
    return 2 * sum(x * math.log(x / e) for x, e in ((a, n * p), (b, m * p), (n - a, n * (1 - p)), (m - b, m * (1 - p))) if x > 0 and e > 0)


class _Gains(dict):
    """The log-ratio of a word over the base: that of its longest expression that is kept. Words that were asked for are kept, up to a bound."""

    def __init__(self, words: dict[str, float], base: float) -> None:
        self.words, self.base = words, base

    def __missing__(self, word: str) -> float:
        gain = next((self.words[x] - self.base for x in (word, *stems_of(word)) if x in self.words), 0.0)
        if len(self) < CACHED:
            self[word] = gain
        return gain


@dataclass
class Model:
    """words, heads and pairs: the log-ratio of a word or stem, of a predecessor's backoff, and the correction of a pair; base: of all other words."""

    words: dict[str, float]
    heads: dict[str, float]
    pairs: dict[tuple[str, str], float]
    base: float
    curve: tuple[float, float, float] = (0.0, 0.0, -30.0)

    def __post_init__(self) -> None:
        self.gains = _Gains(self.words, self.base)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "gains"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.gains = _Gains(self.words, self.base)

    def evidence(self, text: str | None) -> tuple[float, int]:
        """The difference of log-likelihoods per word, over that of a text that holds nothing kept, and the number of words."""
        words = words_of(text)
        n = len(words)
        if not n:
            return 0.0, 0
        total = sum(map(self.gains.__getitem__, words))
        heads = self.heads
        if heads:
            for i in [i for i, h in enumerate(words[:-1]) if h in heads]:
                total += heads[words[i]] + self.pairs.get((words[i], words[i + 1]), 0.0)
        return total / n, n

    def score(self, text: str | None) -> float:
        s, n = self.evidence(text)
        a, b, c = self.curve
        z = a * s + b * s * math.sqrt(n) + c
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def build(words: dict[str, tuple[float, float]], pairs: dict[tuple[str, str], tuple[float, float]], heads: dict[str, tuple[float, float]], totals: tuple[float, float], shared: dict[str, float]) -> Model:
    """The model of (toxic, ordinary) continuation counts; shared: each word's share of the backoff."""
    if not all(totals):
        return Model({}, {}, {}, 0.0)
    kept = {w: c for w, c in words.items() if sum(c) >= RARE and _g(c[0], totals[0], c[1], totals[1]) >= SURE}
    # stems hold words that are counted already
    mass = [1 - sum(max(c[k] - DISCOUNT, 0) for w, c in kept.items() if w[-1] != "*") / totals[k] for k in (0, 1)]
    mass = [max(m, 1e-6) for m in mass]
    least = min(shared.values(), default=1e-9)
    p = {w: [max(c[k] - DISCOUNT, 0) / totals[k] + mass[k] * shared.get(w, least) for k in (0, 1)] for w, c in kept.items()}
    p = {w: x for w, x in p.items() if abs(math.log(x[0] / x[1])) >= CLEAR}
    out = Model({w: math.log(x / y) for w, (x, y) in p.items()}, {}, {}, math.log(mass[0] / mass[1]))
    sure: dict[str, list[str]] = defaultdict(list)
    for (h, w), c in pairs.items():
        n = heads.get(h, (0.0, 0.0))
        if all(n) and sum(c) >= RARE and _g(c[0], n[0], c[1], n[1]) >= SURE:
            sure[h].append(w)
    for h, after in sure.items():
        n = heads[h]
        after = [w for w in after if abs(math.log((pairs[h, w][0] + 0.5) / (n[0] + 1) * (n[1] + 1) / (pairs[h, w][1] + 0.5))) >= CLEAR]
        if not after:
            continue
        rest = [max(1e-6, 1 - sum(max(pairs[h, w][k] - DISCOUNT, 0) for w in after) / n[k]) for k in (0, 1)]
        out.heads[h] = math.log(rest[0] / rest[1])
        for w in after:
            low = next((p[x] for x in (w, *stems_of(w)) if x in p), [m * shared.get(w, least) for m in mass])
            high = [max(pairs[h, w][k] - DISCOUNT, 0) / n[k] + rest[k] * low[k] for k in (0, 1)]
            out.pairs[h, w] = math.log(high[0] / high[1]) - out.heads[h] - math.log(low[0] / low[1])
    return out


def fit_curve(rows: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """Logistic regression of the label on (evidence, evidence x root of length), by Newton's method with a small ridge."""
    y = np.array([r[2] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 2)  # without labels nothing is toxic
        return 0.0, 0.0, math.log(share / (1 - share))
    s = np.array([r[0] for r in rows])
    x = np.stack([s, s * np.sqrt([r[1] for r in rows])], axis=1)
    scale = np.maximum(x.std(axis=0), 1e-9)
    x = np.concatenate((x / scale, np.ones((len(y), 1))), axis=1)
    beta, ridge = np.zeros(3), np.diag([1e-2, 1e-2, 1e-6])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + ridge, x.T @ (y - q) - ridge @ beta)
        beta += step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale[0]), float(beta[1] / scale[1]), float(beta[2])


def document_shares(docs: DataFrame) -> DataFrame:
    """(word, n): in how many documents each word occurs, over all documents; a task adds up before the shuffle. A stem has the sum of its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(set(words_of(text)))
                if len(seen) > 500_000:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    words = docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    stems = words.select(_stems("word").alias("word"), "n").where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    return words.union(stems)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled documents outside the held-out fold; labels (doc_id, toxic) with null or other labels than 0 and 1, or null ids, are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").where("doc_id is not null").distinct().join(marked, "doc_id")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = spark.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, toxic int")  # SAMPLE rows at most
    texts = staged(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).withColumn("fold", fold().cast("int")), "labelled")

    def triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, toxic, part in zip(batch["text"], batch["toxic"], batch["fold"], strict=True):
                w = ["", "", *words_of(text)]
                some = sorted(set(zip(w, w[1:], w[2:], strict=False)))
                if some:
                    yield pd.DataFrame(some, columns=["u", "h", "w"]).assign(part=2 * part + toxic)

    seen = texts.mapInPandas(triples, "u string, h string, w string, part int").distinct()
    cells = [2 * f + c for f in FOLDS for c in (1, 0)]
    each = [F.sum((F.col("part") == p).cast("long")).alias(f"c{p}") for p in cells]
    pair = staged(seen.groupBy("h", "w").agg(*each), "pairs")
    sums = [F.sum(f"c{p}").alias(f"c{p}") for p in cells]
    types = [F.sum((F.col(f"c{p}") > 0).cast("long")).alias(f"c{p}") for p in cells]
    every = sum(F.col(f"c{p}") for p in cells)
    word_rows = staged(pair.groupBy("w").agg(*types), "words")
    stem_rows = word_rows.select(_stems("w").alias("w"), *(f"c{p}" for p in cells)).where("w is not null").groupBy("w").agg(*sums)
    total = np.array(list(word_rows.agg(*sums).first()), float) if not word_rows.isEmpty() else np.zeros(len(cells))
    common = staged(word_rows.union(stem_rows).where(every >= RARE), "common")
    counts_w = {r[0]: np.array(r[1:], float) for r in common.collect()}
    counts_p = {(r[0], r[1]): np.array(r[2:], float) for r in pair.where(every >= RARE).collect()}
    counts_h = {r[0]: np.array(r[1:], float) for r in pair.groupBy("h").agg(*sums).where(every >= RARE).collect()}
    shares = staged(document_shares(docs), "shares")
    size = (shares.where(~F.col("word").endswith("*")).agg(F.sum("n")).first()[0] or 0) + 1.0
    shared = {r[0]: r[1] / size for r in shares.join(common.select(F.col("w").alias("word")), "word").collect()}

    def model(without: int | None) -> Model:
        use = np.array([f != without for f in FOLDS for _ in (1, 0)], float)

        def both(c: np.ndarray) -> tuple[float, float]:
            return tuple((c * use).reshape(-1, 2).sum(axis=0).tolist())

        return build({w: both(c) for w, c in counts_w.items()}, {k: both(c) for k, c in counts_p.items()}, {h: both(c) for h, c in counts_h.items()}, both(total), shared)

    parts = spark.sparkContext.broadcast({f: model(f) for f in FOLDS})

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*parts.value[f].evidence(text), toxic) for text, toxic, f in zip(batch["text"], batch["toxic"], batch["fold"], strict=True)]
            yield pd.DataFrame(rows, columns=["s", "n", "toxic"])

    out = model(None)
    out.curve = fit_curve([tuple(r) for r in texts.mapInPandas(cross, "s double, n long, toxic int").collect()])
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score and predicted; a text alone decides them. A null or empty text has the score of no evidence. Columns of these names are replaced."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score", "predicted")

    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return rest.withColumn("score", value(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
