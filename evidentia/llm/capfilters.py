"""Near-duplicate vectors by spherical-cap filters from a structured random product code.

After a random rotation a vector is cut into blocks. Each block has a small random codebook of
unit vectors, and a filter direction is one codeword of each block: their number is the
product of the codebooks' sizes, while only the codebooks are stored. A vector is decoded to
the list of the directions that are nearest to it, the same number for every vector, by adding
sorted half-sums of the blocks. Vectors join on (label, filter) and are verified by their cosine
in double precision.

The code's size follows from the largest label's number of vectors: a filter holds OCCUPANCY
vectors of it on average. A vector has LISTED filters, or more where pairs at the very bound,
drawn at random and decoded with the code at hand, share a filter in less than RECALL of the
cases. Pairs above the bound are found more often. The draw is of the code's rotation, so the
recall does not hang on how the vectors lie. Where no list reaches it, as in few dimensions,
filters hold more vectors, and of the codes that reach it the one that compares least is taken;
all pairs are compared only where each code would compare half of them or more.

Equal vectors are one row with a multiplicity. A task reads the buckets that it holds one after
the other. The members of a bucket, or CHUNK of them where there are more, are compared with
each other and then with the other chunks' members as they stream by; each member gets the
number of its links and one that it is connected with, so no pairs are shuffled and rows grow
with the members. A pair is counted in the least filter that it has in common. Only the
filters before a bucket's own travel with its members, and vectors in the type they came in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import unit, valid_vector
from .components import connected_components
from .staging import staged

COSINE = 0.98
OCCUPANCY, LISTED = 32, 24
RECALL, PAIRS, DIRECTIONS = 0.999, 4096, 1 << 20
BLOCKS = 4
#: Members of a bucket that a task compares with the others, and rows of a block of cosines.
CHUNK, STRIP = 4096, 512
SEED = 23


@lru_cache(16)
def _code(dim: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation, padded to a multiple of BLOCKS, and the codebooks."""
    rng = np.random.default_rng((SEED, dim, words))
    full = -(-dim // BLOCKS) * BLOCKS
    rotation = np.linalg.qr(rng.standard_normal((full, full)))[0][:dim]
    books = [np.unique(b / np.linalg.norm(b, axis=1, keepdims=True), axis=0) for b in (rng.standard_normal((words, full // BLOCKS)) for _ in range(BLOCKS))]
    return rotation, books


def _top(sums: np.ndarray, most: int) -> np.ndarray:
    """Where the largest sums of each row are, falling."""
    if sums.shape[1] <= most:
        return np.argsort(-sums, axis=1, kind="stable")
    at = np.argpartition(-sums, most - 1, axis=1)[:, :most]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(sums, at, 1), axis=1, kind="stable"), 1)


def decode(vectors: np.ndarray, words: int, listed: int) -> np.ndarray:
    """The sorted filters of each vector: the `listed` best directions, or one for all if there are no more."""
    rotation, books = _code(vectors.shape[1], words)
    half = len(books[2]) * len(books[3])
    if len(books[0]) * len(books[1]) * half <= listed:
        return np.zeros((len(vectors), 1), np.int64)
    out = [np.zeros((0, listed), np.int64)]
    for part in np.array_split(vectors, -(-len(vectors) // 1024) or 1):
        sums = [t @ b.T for t, b in zip(np.split(part @ rotation, BLOCKS, axis=1), books, strict=True)]
        sides = [(x[:, :, None] + y[:, None, :]).reshape(len(part), -1) for x, y in (sums[:2], sums[2:])]
        left, right = (_top(x, listed) for x in sides)
        x, y = (np.take_along_axis(s, o, 1) for s, o in zip(sides, (left, right), strict=True))
        # a sum of ranks i and j has (i + 1) * (j + 1) - 1 sums that are no less
        i, j = np.nonzero(np.outer(np.arange(1, x.shape[1] + 1), np.arange(1, y.shape[1] + 1)) <= listed)
        best = _top(x[:, i] + y[:, j], listed)
        out.append(np.sort(np.take_along_axis(left[:, i], best, 1) * half + np.take_along_axis(right[:, j], best, 1), axis=1))
    return np.concatenate(out)


def recall(dim: int, words: int, listed: int, cosine: float, pairs: int = PAIRS) -> float:
    """The share of random pairs at this cosine that have a filter in common."""
    rng = np.random.default_rng((SEED, dim))
    x, z = unit(rng.standard_normal((pairs, dim))), rng.standard_normal((pairs, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = unit(cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * unit(z)) if dim > 1 else x
    a, b = decode(x, words, listed), decode(y, words, listed)
    return float((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean())


@lru_cache(256)
def code_size(vectors: int, dim: int, cosine: float) -> tuple[int, int]:
    """Codewords of a block, and the filters of a vector that reach RECALL; (1, 1) compares all pairs."""
    first = share = min(0.25, OCCUPANCY / max(1, vectors))
    found = [(0.5, 1, 1)]
    while share <= 0.25:
        listed = LISTED if share == first else LISTED // 4
        most = max(DIRECTIONS, 4 * LISTED / share) if share == first else 4 * LISTED / share
        while listed / share <= most:
            words = max(2, round((listed / share) ** (1 / BLOCKS)))
            if recall(dim, words, listed, cosine, PAIRS // 8) >= RECALL - 0.02 and recall(dim, words, listed, cosine) >= RECALL:
                if share == first:
                    return words, listed
                found.append((listed * listed / words**BLOCKS, words, listed))
                break
            listed += listed // 2
        share *= 2
    return min(found)[1:]


class _Bucket:
    """The members that ask in a bucket: their links and components as other members come by."""

    def __init__(self, cosine: float) -> None:
        self.cosine, self.parts, self.ready = cosine, [], False

    def add(self, members: tuple) -> None:
        self.parts.append(members)

    def _begin(self) -> None:
        """Compares the members that ask with each other."""
        v, self.rep, self.copies, flat, sizes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.ready, m = [], True, len(v)
        self.v, self.links, self.root = v, np.zeros(m, np.int64), np.arange(m)
        linked = np.zeros((m, m), bool)
        for at in range(0, m, STRIP):
            linked[at : at + STRIP] = v[at : at + STRIP] @ v.T >= self.cosine
        np.fill_diagonal(linked, False)
        self.values, where = np.unique(flat, return_inverse=True)
        self.marks = np.zeros((m, len(self.values)), np.float32)
        self.marks[np.repeat(np.arange(m), sizes), where] = 1
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            return
        linked, marks, copies = linked[np.ix_(some, some)], self.marks[some], self.copies[some]
        for at in range(0, len(some), STRIP):
            new = linked[at : at + STRIP] & ~(marks[at : at + STRIP] @ marks.T > 0.5)
            self.links[some[at : at + STRIP]] = new @ copies
        root = np.arange(len(some))
        while True:
            least = np.concatenate([np.minimum(root[at : at + STRIP], np.where(linked[at : at + STRIP], root[None, :], len(some)).min(axis=1)) for at in range(0, len(some), STRIP)])
            if (least == root).all():
                break
            root = least
        self.root[some] = some[root]

    def meet(self, members: tuple, later: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Members of other chunks: they count for those that ask, and those of later chunks are connected."""
        if not self.ready:
            self._begin()
        v, rep, copies, flat, sizes = members
        marks = np.zeros((len(v), len(self.values)), np.float32)
        where = np.searchsorted(self.values, flat)
        where[where == len(self.values)] = 0
        same = self.values[where] == flat if len(self.values) else np.zeros(len(flat), bool)
        marks[np.repeat(np.arange(len(v)), sizes)[same], where[same]] = 1
        out = []
        for at in range(0, len(v), STRIP):
            linked = self.v @ v[at : at + STRIP].T >= self.cosine
            if not linked.any():
                continue
            self.links += (linked & ~(self.marks @ marks[at : at + STRIP].T > 0.5)) @ copies[at : at + STRIP]
            for k in np.flatnonzero(linked.any(axis=0)).tolist():
                roots = np.unique(self.root[linked[:, k]])
                if len(roots) > 1:
                    self.root[np.isin(self.root, roots)] = roots[0]
                if later[at + k]:
                    out.append((rep[at + k : at + k + 1], np.zeros(1, np.int64), self.rep[roots[:1]]))
        return out

    def end(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not self.ready:
            self._begin()
        some = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(self.root))))
        return [(self.rep[some], self.links[some], self.rep[self.root[some]])] if len(some) else []


def _compared(cosine: float):  # noqa: ANN202
    """A map over members sorted by bucket and chunk, those that ask before the others: (rep, links, root)."""
    names = ("label", "dim", "filter", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            changed = np.zeros(batch.num_rows, bool)
            for c in names:
                changed[1:] |= np.asarray(pc.not_equal(batch[c].slice(1), batch[c].slice(0, batch.num_rows - 1)))
            first = tuple(batch[c][0].as_py() for c in names)
            changed[0] = first != last
            last = tuple(batch[c][-1].as_py() for c in names)
            other, chunk, task, dims = (np.asarray(batch[c]) for c in ("other", "chunk", "task", "dim"))
            changed |= np.concatenate(([False], other[1:] != other[:-1]))
            cuts = np.append(np.flatnonzero(changed | (np.arange(batch.num_rows) == 0)), batch.num_rows)
            v, filters = batch["v"], batch["filters"]
            flat, at = np.asarray(v.flatten(), np.float64), np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(v), np.int64))))
            listed, sizes = np.asarray(filters.flatten(), np.int64), np.asarray(pc.list_value_length(filters), np.int64)
            place = np.concatenate(([0], np.cumsum(sizes)))
            rep, copies = np.asarray(batch["rep"]), np.asarray(batch["copies"])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                members = (unit(flat[at[x] : at[y]].reshape(-1, int(dims[x]))), rep[x:y], copies[x:y], listed[place[x] : place[y]], sizes[x:y])
                if not other[x]:
                    if changed[x]:
                        out += bucket.end() if bucket else []
                        bucket = _Bucket(cosine)
                    bucket.add(members)
                elif bucket is not None:
                    out += bucket.meet(members, chunk[x:y] > task[x:y])
            if out:
                yield _links(out)
        if bucket is not None and (out := bucket.end()):
            yield _links(out)

    return run


def _links(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*rows, strict=True)], names=["rep", "links", "root"])


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their vectors have one dimension and
    their cosine is at least the bound; equal rows link too. A vector that is null, empty,
    zero or holds a null or non-finite component links with nothing, nor does a row without an
    id (component_id null, kept false). Repeated ids are rows of one vec_id: each gives a row.
    An empty table gives an empty table. Other columns are not read.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label"))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid_vector("embedding")
    number = "float" if dict(base.dtypes)["embedding"] == "array<float>" else "double"
    normal = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast(number))
    # two hashes name a vector with its label when rows are joined with what is found for it
    name = [F.xxhash64("label", normal), F.xxhash64(F.lit(SEED), "label", normal)]
    part = base.where(able).select("vec_id", "label", normal.alias("v"), name[0].alias("h1"), name[1].alias("h2"))
    distinct = part.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    reps = staged(distinct.withColumn("row", F.monotonically_increasing_id()), "reps")
    most = reps.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("most")).collect()
    codes = {r.dim: code_size(r.most, r.dim, cosine) for r in most}

    def filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            for dim, rows in batch.groupby(batch["v"].map(len)):
                yield rows.assign(filters=list(decode(unit(np.stack(rows["v"].to_numpy()).astype(np.float64)), *codes[dim])))

    kind = dict(reps.dtypes)["label"]
    some = reps.select("label", "v", "row", "copies", F.size("v").alias("dim"))
    decoded = staged(some.mapInPandas(filters, f"label {kind}, v array<{number}>, row long, copies long, dim int, filters array<long>"), "decoded")
    on = ["label", "dim", "filter"]
    sizes = staged(decoded.select("label", "dim", F.explode("filters").alias("filter")).groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = decoded.select("label", "dim", F.col("row").alias("rep"), "copies", "v", "filters", F.explode("filters").alias("filter")).join(sizes, on)
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = members.withColumn("filters", F.filter("filters", lambda x: x < F.col("filter"))).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    wide = members.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("other", F.col("task") != F.col("chunk"))
    dealt = wide.select(*on, "task", "other", "chunk", "rep", "copies", "v", "filters").repartition(*on, "task").sortWithinPartitions(*on, "task", "other")
    seen = staged(dealt.mapInArrow(_compared(cosine), "rep long, links long, root long"), "links")
    links = seen.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(seen.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "row")
    known = reps.join(links.withColumnRenamed("rep", "row"), "row", "left").join(groups, "row", "left").select("h1", "h2", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "row").alias("component"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = staged(known.join(least, "component").select("h1", "h2", "copies", "links", "component_id"), "known")
    marked = base.select("vec_id", *(F.when(able, h).alias(c) for h, c in zip(name, ("h1", "h2"), strict=True)))
    out = marked.where("h1 is not null").join(known, ["h1", "h2"]).select("vec_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    rest = marked.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
