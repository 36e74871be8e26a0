"""Near-duplicate documents by 64-bit SimHash, found through Golay-code keys.

A fingerprint is cut into three segments. Two fingerprints that differ in at most two bits
agree wholly in at least one segment (pigeonhole), and in the following segment they differ
in at most two bits. The perfect binary Golay code of length 23 corrects three errors; the
codewords nearest to a segment and to its one-bit neighbours are one (within two bits of a
codeword) or six (at three bits). Two segments at distance two have a common one-bit
neighbour, so they share one of these codewords. A key is the number of the agreeing
segment, its bits and one such codeword's index: no pair within two bits is missed, and
every pair of a bucket is verified by its bits.

Buckets of more than LIGHT fingerprints emit no pairs. Their fingerprints are grouped by each
word of their one-bit neighbourhoods: members of such a group (65 at most) lie within two
bits of each other, and fingerprints within two bits share such a word, so this is exact.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .staging import small_batches, staged

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101
LIGHT = 64


def text_fingerprint(text: str | None) -> int:
    """SimHash of the XXH64 of a text's 3-word shingles, repeats included; 0 for no words.

    Only A-Z are lower-cased and only ASCII white space parts words, which is what bytes do.
    """
    words = text.encode().lower().split() if text else ()
    n = len(words) - SHINGLE + 1
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    for at in range(0, n, 255):
        part = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += np.add.reduce(part, axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """The fingerprint's 64 bits as a signed long."""
    return pd.Series([signed(text_fingerprint(t)) for t in texts], dtype="int64")


@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, and the error that each syndrome names."""
    rest = [1 << i for i in range(11)]
    for _ in range(12):
        x = rest[-1] << 1
        rest.append(x ^ GENERATOR if x >> 11 else x)
    syndromes = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for i in range(12):
        syndromes[1 << i : 2 << i] = syndromes[: 1 << i] ^ rest[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ rest[12 + i]
    error = np.zeros(1 << 11, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            s = e = 0
            for i in bits:
                s, e = s ^ rest[i], e | 1 << i
            error[s] = e
    return syndromes, high, error


def codewords(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    low, high, error = _code()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def keys_of(prints: np.ndarray) -> list[np.ndarray]:
    """The bucket keys of each fingerprint (int64): those of fingerprints within two bits meet."""
    bits = prints.view(np.uint64)
    cut = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [codewords(np.stack([s, *(s ^ (1 << b) for b in range(n))], axis=1)) for s, (_, n) in zip(cut, SEGMENTS, strict=True)]
    out = [(i << 34 | cut[i] << 12)[:, None] | near[(i + 1) % 3] for i in range(3)]
    return [np.unique(row) for row in np.concatenate(out, axis=1)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def golay_keys(prints: pd.Series) -> pd.Series:
    return pd.Series(keys_of(prints.to_numpy(np.int64)), dtype=object)


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints of column fp within two bits of each other, directly or through others that they lie within two bits of."""
    keyed = staged(prints.select("fp", F.explode(golay_keys("fp")).alias("key")), "golay")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(sizes, "key")
    light = held.where(F.col("n") <= LIGHT).select("key", "fp")
    other = light.select("key", F.col("fp").alias("b"))
    pairs = light.withColumnRenamed("fp", "a").join(other, "key").where(f"a < b and bit_count(a ^ b) <= {DISTANCE}").select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(64)))
    words = held.where(F.col("n") > LIGHT).select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("word"))
    balls = words.groupBy("word").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return pairs.union(balls.select("a", F.explode("all").alias("b")).where("a < b"))


def fingerprint_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints and near-duplicate groups: (id, fp, component, component_id) per row of docs.

    component is the least fingerprint of a group and names it.

    component_id is the smallest id of a group. A null id is nobody's component_id unless all
    of its group are null, then it is null. Null, empty and wordless texts have fingerprint
    zero and link like any other. Repeated rows are kept. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    marked = staged(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "prints")
    distinct = staged(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = connected_components(links(distinct))
    groups = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(groups.select("fp", "component").join(least, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint in hexadecimal, component_id) per row of docs."""
    return fingerprint_components(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each group the row whose id is its component_id.

    Of several such rows in a group (repeated ids) one stays, and of a group without any id one.
    """
    found = fingerprint_components(docs, id_col, text_col).withColumn("stands", F.col("id").eqNullSafe(F.col("component_id")))
    tally = staged(found.groupBy("id").agg(F.count("*").alias("_n"), F.max("stands").alias("_stands")).where("_stands"), "kept").select(F.col("id").alias("_id"), "_n")
    held = docs.select(F.struct("*").alias("_row"))
    # the rows are dealt by id at every size: the ids that stay are nearly as many as the rows
    rows = held.join(tally.hint("merge"), F.col("_row")[id_col].eqNullSafe(F.col("_id")))
    single = rows.where("_n = 1").select("_row.*")
    if tally.where("_n > 1").isEmpty():
        return single
    groups = found.where("stands").select(F.col("id").alias("_id2"), F.col("fp").alias("_fp2"), F.struct("component").alias("_group")).distinct()
    several = rows.where("_n > 1").select("_row", "_id", fingerprint(F.col("_row")[text_col]).alias("_fp"))
    several = several.join(groups, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_fp") == F.col("_fp2")))
    return single.union(several.dropDuplicates(["_id", "_group"]).select("_row.*"))
