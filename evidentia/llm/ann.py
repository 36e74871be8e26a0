"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, where the Euclidean distance orders rows as the cosine
does. Each table hashes a vector with Gaussian (2-stable) projections, cut into cells. A query
visits its own bucket and those of perturbed keys, in the order of their scores: the sum of
squared distances to the borders that the perturbation crosses, which orders them by their
estimated chance of holding a neighbour. All candidates of the visited buckets are ranked by
the exact cosine.

How many tables, projections and probes there are, and how wide cells are, is fitted to the
rows: the true neighbours of ASKED queries among all rows are found by brute force (one scan),
and of the settings at hand (CELLS, TABLES, PROBES) the one that does least work is taken whose buckets hold WANTED
of them. The share of rows visited is measured on SEEN rows. So clustered rows get narrow
buckets and few probes, more so the more rows there are, and rows without near neighbours get
the wide ones that they need. Every row is indexed.

Buckets are processed in tasks sorted by bucket, queries before rows, and the rows arrive in
batches; a task holds the queries of one bucket and the best rows of its queries. Buckets
above HEAVY rows or QUERIES queries are cut both ways: each part of the queries meets each
part of the rows, so a task holds about QUERIES of them at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import staged



class Setting(NamedTuple):
    """An index: tables, projections of a table, the width of a cell, and buckets that a query visits in a table."""

    tables: int
    width: int
    cell: float
    probes: int


#: The settings to choose from: projections with cells, and tables and probes.
CELLS = [(w, c) for w in (6, 8, 12, 16) for c in (0.7, 1.0, 1.4, 2.0)]
TABLES, PROBES = (1, 2, 3, 4, 5, 6, 8), (1, 4, 16, 60, 240)
#: Queries and rows that a setting is chosen by, and the share of true neighbours that it must hold.
ASKED, SEEN, WANTED = 256, 4096, 0.95
#: Comparisons of two vectors that cost as much as one row of a shuffle, about.
MOVED = 100
#: Perturbations of a key that are scored, at most.
STEPS = 1000
SEED = 11
#: Rows of a bucket beyond which it is salted; also at least a ten-thousandth of all rows of a table, so that the heavy buckets are 10,000 a table at most and may be broadcast.
HEAVY = 20_000
#: Queries of a bucket that a task holds, about, and queries whose best rows it holds before it hands them on.
QUERIES, HELD = 20_000, 20_000


def valid_vector(column: str) -> F.Column:
    """True for vectors with components, all of them finite, and not all zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


@lru_cache(256)
def _projections(dim: int, table: int, width: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim, table))
    return rng.standard_normal((width, dim)).T, rng.uniform(0, cell, width)


@lru_cache(16)
def _steps(width: int) -> np.ndarray:
    """The perturbations of a key: of few cells at once where there are more than STEPS of all cells."""
    out = []
    for moved in range(width + 1):
        more = [(at, by) for at in combinations(range(width), moved) for by in product((-1, 1), repeat=moved)]
        if moved and len(out) + len(more) > STEPS:
            break
        out += more
    steps = np.zeros((len(out), width), np.int64)
    for i, (at, by) in enumerate(out):
        steps[i, list(at)] = by
    return steps


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _keys(cells: np.ndarray) -> np.ndarray:
    """One long for the cells of a table; cells that meet in one long share a bucket, which costs comparisons only."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for i in range(cells.shape[-1]):
        out = out * np.int64(6364136223846793005) + cells[..., i]
    return out


def bucket_keys(vectors: np.ndarray, setting: Setting, probes: int) -> np.ndarray:
    """The keys (rows x tables x probes) of vectors of length one, best first."""
    n, dim = vectors.shape
    steps = _steps(setting.width)
    probes = min(probes, len(steps))
    out = np.empty((n, setting.tables, probes), np.int64)
    for t in range(setting.tables):
        a, b = _projections(dim, t, setting.width, setting.cell)
        at = (vectors @ a + b) / setting.cell
        cell = np.floor(at).astype(np.int64)
        if probes == 1:
            out[:, t, 0] = _keys(cell)
            continue
        below = (at - cell) ** 2
        above = (1 - (at - cell)) ** 2
        score = below @ (steps == -1).T + above @ (steps == 1).T
        best = np.argsort(score, axis=1, kind="stable")[:, :probes]
        out[:, t] = _keys(cell[:, None, :] + steps[best])
    return out


def _hasher(setting: Setting, probes: int):  # noqa: ANN202
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        dims: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            dims.setdefault(len(v), []).append(i)
        for at in dims.values():
            found = bucket_keys(unit(np.stack([np.asarray(vectors[i], np.float64) for i in at])), setting, probes)
            for i, row in zip(at, found.reshape(len(at), -1), strict=True):
                out[i] = row
        return pd.Series(out, dtype=object)

    return keys


def weigh(width: int, cell: float, asked: np.ndarray, near: list[np.ndarray], seen: np.ndarray) -> dict[Setting, tuple[int, float, int]]:
    """For vectors of one dimension and each number of tables and probes: the true neighbours (near, one array a query)
    in visited buckets, the rows compared by all queries as shares of the rows seen, and the queries that
    miss a neighbour and whose buckets hold none of the rows seen."""
    most = Setting(max(TABLES), width, cell, max(PROBES))
    probes, rows = bucket_keys(asked, most, most.probes), bucket_keys(seen, most, 1)[:, :, 0]
    owner = np.repeat(np.arange(len(asked)), [len(v) for v in near])
    keys = bucket_keys(np.concatenate(near), most, 1)[:, :, 0] if len(owner) else np.zeros((0, most.tables), np.int64)
    first, visited = np.zeros((len(owner), most.tables), np.int64), np.zeros((len(asked), most.tables, probes.shape[2]), np.int64)
    for t in range(most.tables):
        met = probes[owner, t] == keys[:, t, None]
        first[:, t] = np.where(met.any(axis=1), met.argmax(axis=1), most.probes)
        line = np.sort(rows[:, t])
        visited[:, t] = np.cumsum(np.searchsorted(line, probes[:, t], "right") - np.searchsorted(line, probes[:, t]), axis=1)
    out = {}
    for tables, p in product(TABLES, PROBES):
        hit = (first[:, :tables] < p).any(axis=1)
        looks = visited[:, :tables, min(p, probes.shape[2]) - 1].sum(axis=1)
        missed = np.bincount(owner[~hit], minlength=len(asked)) > 0
        out[Setting(tables, width, cell, p)] = int(hit.sum()), float(looks.sum()) / max(1, len(seen)), int((missed & (looks == 0)).sum())
    return out


def cosine(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in one order of summation, so that equal rows get equal scores."""
    return np.clip((queries * rows).sum(axis=1), -1.0, 1.0)


class _Best:
    """The k best rows of each query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.best = k, {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.best:
            old_ids, old_scores = self.best[query]
            ids, scores = np.concatenate((old_ids, ids)), np.concatenate((old_scores, scores))
        ids, first = np.unique(ids, return_index=True)
        scores = scores[first]
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[query] = ids[order], scores[order]

    def frame(self) -> pd.DataFrame:
        rows = [(q, i, s) for q, (ids, scores) in self.best.items() for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        self.best = {}
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _search(k: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, bucket, ids, vectors = _Best(k), None, np.zeros(0, np.int64), None
        for batch in batches:
            marks = batch[["dim", "tab", "bucket", "salt", "ask"]].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            kinds, names, given = batch["row"].to_numpy(), batch["vec_id"].to_numpy(np.int64), batch["v"].to_numpy()
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if bucket != tuple(marks[a]):
                    bucket, ids, vectors = tuple(marks[a]), np.zeros(0, np.int64), None
                asked = a + int((kinds[a:z] == 0).sum())
                if asked > a:
                    more = unit(np.stack(given[a:asked]).astype(np.float64))
                    ids, vectors = np.concatenate((ids, names[a:asked])), more if vectors is None else np.concatenate((vectors, more))
                if asked == z or vectors is None:
                    continue
                rows, row_ids = unit(np.stack(given[asked:z]).astype(np.float64)), names[asked:z]
                for at in range(0, len(ids), 512):
                    near = vectors[at : at + 512] @ rows.T
                    near[ids[at : at + 512, None] == row_ids[None, :]] = -9
                    floor = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -2.0)
                    q, r = np.nonzero((near >= np.maximum(floor, -2.0)[:, None] - 1e-9) & (near > -9))
                    exact = cosine(vectors[at + q], rows[r])
                    ends = np.searchsorted(q, np.arange(len(near) + 1))
                    for i, (x, y) in enumerate(zip(ends, ends[1:], strict=False)):
                        if x < y:
                            best.add(int(ids[at + i]), row_ids[r[x:y]], exact[x:y])
            if len(best.best) > HELD:
                yield best.frame()
        yield best.frame()

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visit(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best rows for each query in the parts of buckets (dim, tab, bucket, salt, ask) where both are."""
    both = queries.withColumn("row", F.lit(0)).unionByName(rows.withColumn("row", F.lit(1)))
    keys = ["dim", "tab", "bucket", "salt", "ask"]
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "row")
    return dealt.mapInPandas(_search(k), "query_id long, vec_id long, score double")


def _exact(batches: Iterator[pd.DataFrame], asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pd.DataFrame]:
    best = _Best(k)
    for batch in batches:
        ids, dims, given = batch["vec_id"].to_numpy(np.int64), batch["dim"].to_numpy(np.int64), batch["v"].to_numpy()
        for dim, (names, vectors) in asked.items():
            at = np.flatnonzero(dims == dim)
            if not len(at):
                continue
            rows = unit(np.stack(given[at]).astype(np.float64))
            near = vectors @ rows.T
            near[names[:, None] == ids[at][None, :]] = -9
            for i, row in enumerate(near):
                floor = np.partition(row, -k)[-k] - 1e-9 if len(row) > k else -2.0
                top = np.flatnonzero((row >= floor) & (row > -9))
                if len(top):
                    best.add(int(names[i]), ids[at[top]], cosine(vectors[i], rows[top]))
    yield best.frame()


def choose(rows: DataFrame, asked: DataFrame, k: int) -> tuple[Setting, float, float]:
    """The setting for rows and queries (vec_id, v, dim), its measured recall, and the rows that a query compares as a share of all.

    The queries and rows that it is chosen by are the first by a hash of the id; the recall is
    of their true neighbours among all rows. Where no setting reaches WANTED, it is the one of most recall.
    """
    draw = lambda df, n: df.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n).collect()
    sample, seen = draw(asked, ASKED), draw(rows, SEEN)
    total, asks = rows.count(), asked.count()
    of_dim: dict[int, dict[int, np.ndarray]] = {}
    for r in sample:
        of_dim.setdefault(r["dim"], {})[r["vec_id"]] = np.asarray(r["v"], np.float64)
    given = {d: (np.array(list(x), np.int64), unit(np.stack(list(x.values())))) for d, x in of_dim.items()}
    if not given or not total:
        return Setting(1, *CELLS[0], 1), 1.0, 0.0
    found = staged(_ranked(rows.mapInPandas(lambda b: _exact(b, given, k), "query_id long, vec_id long, score double"), k), "true_neighbours")
    ids = F.broadcast(found.select("vec_id").distinct())
    vectors = {(r["dim"], r["vec_id"]): np.asarray(r["v"], np.float64) for r in rows.join(ids, "vec_id").groupBy("dim", "vec_id").agg(F.min("v").alias("v")).collect()}
    mine: dict[int, list[int]] = {}
    for r in found.select("query_id", "vec_id").orderBy("query_id", "rank").collect():
        mine.setdefault(r[0], []).append(r[1])
    groups, asking, wanted = [], 0, 0
    for dim, (names, units) in given.items():
        near = [unit(np.stack(v)) if (v := [vectors[dim, i] for i in mine.get(int(q), []) if (dim, i) in vectors]) else np.zeros((0, dim)) for q in names]
        looked = [np.asarray(r["v"], np.float64) for r in seen if r["dim"] == dim]
        groups.append((units, near, unit(np.stack(looked)) if looked else np.zeros((0, dim)), len(looked) / len(seen)))
        asking, wanted = asking + len(names), wanted + sum(map(len, near))
    weighed = []
    for cells in CELLS:
        sums: dict[Setting, list[float]] = {}
        for units, near, looked, share in groups:
            for setting, (hits, compared, short) in weigh(*cells, units, near, looked).items():
                old = sums.get(setting, [0.0, 0.0, 0.0])
                sums[setting] = [old[0] + hits, old[1] + compared * share, old[2] + short]
        for setting, (hits, compared, short) in sums.items():
            recall = hits / wanted if wanted else 1.0
            work = asks * (compared + short) / asking * total + MOVED * setting.tables * (total + asks * setting.probes)
            weighed.append((recall < WANTED, -recall if recall < WANTED else work, work, setting, recall, compared / asking))
    return min(weighed, key=lambda w: w[:4])[3:]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors nearest to each row of queries, by cosine.

    Both have vec_id long and embedding array. Rows with a null id, and vectors that are null,
    empty, zero or hold a null or non-finite component take no part. A row is no neighbour of
    a query with its own id; repeated ids count once, at their best score. Vectors of another
    dimension are no candidates. Ties go to the smaller id. Repeated queries are one. An empty
    table gives an empty table, and other columns are not read. A query whose buckets held fewer
    than k rows is compared with all rows, in blocks, so it gets min(k, candidates) rows. The
    index is chosen by `choose`, from a bounded sample of the queries and all rows.
    """
    number = "float" if all(dict(df.dtypes)["embedding"] == "array<float>" for df in (vectors, queries)) else "double"

    def clean(df: DataFrame) -> DataFrame:
        return df.where(F.col("vec_id").isNotNull() & valid_vector("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("v"), F.size("embedding").cast("long").alias("dim"))

    rows, asked = clean(vectors), clean(queries)
    setting, _, _ = choose(rows, asked, k)
    tables, probes = setting.tables, min(setting.probes, len(_steps(setting.width)))
    hashed = rows.withColumn("keys", _hasher(setting, 1)("v")).select("vec_id", "v", "dim", F.posexplode("keys").alias("tab", "bucket"))
    probed = asked.withColumn("keys", _hasher(setting, probes)("v")).select("vec_id", "v", "dim", F.posexplode("keys").alias("tab", "bucket")).withColumn("tab", F.floor(F.col("tab") / probes).cast("int"))
    counts = staged(hashed.groupBy("dim", "tab", "bucket").agg(F.count("*").alias("n")), "buckets")
    total = counts.agg(F.sum("n")).first()[0] or 0
    on = ["dim", "tab", "bucket"]
    asks = probed.groupBy(*on).agg(F.count("*").alias("asks"))
    most, many = (max(own, n // (tables * 10_000)) for own, n in ((HEAVY, total), (QUERIES, asked.count() * tables * probes)))
    heavy = counts.join(asks, on).where((F.col("n") > most) | (F.col("asks") > many)).select(*on, F.ceil(F.col("n") / HEAVY).cast("int").alias("salts"), F.ceil(F.col("asks") / QUERIES).cast("int").alias("parts"))
    heavy = staged(heavy, "heavy")
    rows_in, queries_in = F.coalesce("salts", F.lit(1)), F.coalesce("parts", F.lit(1))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    salted = hashed.join(F.broadcast(heavy), on, "left").withColumn("salt", part(rows_in)).withColumn("ask", each(queries_in)).drop("salts", "parts")
    spread = probed.join(F.broadcast(heavy), on, "left").withColumn("ask", part(queries_in)).withColumn("salt", each(rows_in)).drop("salts", "parts")
    found = staged(_ranked(_visit(salted, spread, k), k), "nearest")
    short = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    left = short.count()
    if left:
        blocks, parts = (F.lit(max(1, -(-n // own))) for n, own in ((total, tables * HEAVY), (left, QUERIES)))
        where = {"tab": F.lit(0), "bucket": F.lit(0).cast("long")}
        every = rows.withColumns(where | {"salt": part(blocks)}).withColumn("ask", each(parts))
        asks = short.withColumns(where | {"ask": part(parts)}).withColumn("salt", each(blocks))
        rest = staged(_ranked(_visit(every, asks, k), k), "rest")
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")
