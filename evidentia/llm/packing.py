"""Concatenate and cut: documents packed into sequences of a fixed window.

The corpus is one long stream of token ids, in the order of the staged table. The first pass
tokenizes; each task numbers its own ids from zero and keeps, per document, their place in its
part. A running sum over the token totals of the parts, one row per task, is the offset of each part.
The second pass is a narrow map: a document's global offset is its part's plus its own, and it
is cut where the windows end. Only the last sequence is shorter than a window.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .staging import small_batches, staged

WINDOW = 2048
VOCABULARY = "word_bpe_49k.json"
END = 1
#: Letter strings whose ids a task keeps; beyond it starts anew.
KEPT = 400_000
#: Characters of texts that are looked up in one go, and bytes of pieces that are handed on at once.
BLOCK, HANDED = 4_000_000, 8_000_000
#: The rules under which a text's ids are those of its strings between white space, letters parted from the marks after them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A string of plain letters and marks after it, which the vocabulary's rules always part.
PLAIN = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{134}-\x{148}\x{14a}-\x{17e}]+)(?P<marks>[!-&(-/:;=-@\[-^`{-~]*)$"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(2)
def _tokenizer(path: str) -> tuple[Tokenizer, np.ndarray, dict[str, bytes], bool]:
    """The tokenizer, which of its ids end a word, the ids of strings, and whether texts may be tokenized string by string."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    last[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
    rules = json.loads(tokenizer.to_str())
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    parted = bool(steps) and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    parted &= len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    parted &= (rules["normalizer"] or {}).get("normalizers") == NORMALIZERS and rules["model"].get("end_of_word_suffix") == "</w>"
    parted &= all(t["content"].startswith("<|") for t in rules["added_tokens"])
    return tokenizer, last, {}, parted


def _learn(words: list[str], path: str) -> None:
    """Tokenizes strings that are one word each, a hundred at a time: the ids that end a word part them."""
    tokenizer, last, known, _ = _tokenizer(path)
    groups = [words[i : i + 100] for i in range(0, len(words), 100)]
    for at in range(0, len(groups), 500):
        some = groups[at : at + 500]
        for group, e in zip(some, tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(last[ids]) + 1) * 4
            raw = ids.tobytes()
            if len(ends) == len(group):
                known.update(zip(group, [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)], strict=True))
            else:
                known.update(zip(group, [_ids(x, tokenizer) for x in group], strict=True))


def _ids(text: str, tokenizer: Tokenizer) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _gather(table: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the table's entries at these places, one after the other, and how many each has."""
    ids = np.frombuffer(b"".join(table), "<u4")
    sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
    starts = np.cumsum(sizes) - sizes
    n = sizes[at]
    before = np.cumsum(n) - n
    return ids[np.repeat(starts[at] - before, n) + np.arange(int(n.sum()))], n


def _strings(strings: pa.Array, path: str) -> list[bytes]:
    """The ids of distinct strings without white space."""
    tokenizer, _, known, _ = _tokenizer(path)
    if len(known) > KEPT:
        known.clear()
    parts = pc.extract_regex(strings, PLAIN)
    letters = pc.utf8_lower(pc.struct_field(parts, "letters")).dictionary_encode()
    marks = pc.struct_field(parts, "marks").dictionary_encode()
    words, signs = letters.dictionary.to_pylist(), marks.dictionary.to_pylist()
    _learn([w for w in words if w not in known], path)
    plain = np.asarray(pc.is_valid(parts))
    other = pc.filter(strings, pa.array(~plain)).to_pylist()
    table = [*(known[w] for w in words), *(_ids(x, tokenizer) for x in signs), *(np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(other, add_special_tokens=False))]
    first, second = np.zeros(len(strings), np.int64), np.full(len(strings), len(table))
    table.append(b"")
    first[plain] = letters.indices.drop_null().to_numpy()
    second[plain] = marks.indices.drop_null().to_numpy() + len(words)
    first[~plain] = np.arange(len(other)) + len(words) + len(signs)
    ids, n = _gather(table, np.stack((first, second), axis=1).ravel())
    raw = ids.tobytes()
    ends = (4 * np.cumsum(n)[1::2]).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    Where the vocabulary's rules drop white space and never join what it parts, a text's ids
    are those of its strings between ASCII white space, and each distinct string is tokenized
    once. Texts that may hold a special token, and all texts of vocabularies with other
    rules, are tokenized whole.
    """
    out: list[bytes] = [b""] * len(texts)
    parted = _tokenizer(path)[3]
    whole = [i for i, t in enumerate(texts) if not parted or "<|" in t]
    rest = [i for i, t in enumerate(texts) if parted and "<|" not in t]
    for i in whole:
        out[i] = _ids(texts[i], _tokenizer(path)[0])
    if not rest:
        return out
    lists = pc.ascii_split_whitespace(pa.array([texts[i] for i in rest], pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    ids, n = _gather(_strings(coded.dictionary, path), coded.indices.to_numpy())
    ends, flat = np.concatenate(([0], np.cumsum(n))), ids.tobytes()
    cuts = (4 * ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]).tolist()
    for i, a, b in zip(rest, cuts, cuts[1:], strict=False):
        out[i] = flat[a:b]
    return out


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, at, ids): ids as 16-bit little-endian numbers where the vocabulary allows, at their offset in the part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from _coded(batches, path)
        finally:  # an idle worker keeps nothing
            _tokenizer(path)[2].clear()
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, part int, at long, n long, ids binary")


def _coded(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, texts = batch["id"].to_list(), [t or "" for t in batch["text"]]
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= BLOCK):
                size += len(texts[last])
                last += 1
            coded, places = [], []
            for raw in encode(texts[first:last], path):
                full = np.frombuffer(raw + END.to_bytes(4, "little"), "<u4")
                coded.append(full.astype("<u2").tobytes() if (full < 1 << 16).all() else full.tobytes())
                places.append((at, len(full)))
                at += len(full)
            yield pd.DataFrame({"id": pd.Series(ids[first:last], dtype="Int64"), "part": part, "at": [p for p, _ in places], "n": [n for _, n in places], "ids": coded})
            first = last


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian 32-bit).

    Each document's ids end with id 1; a null or empty text has that alone. Sequences hold
    `window` ids without gaps, but for the last one. Repeated rows and ids and null ids are
    packed row by row. Other columns are not read. An empty table gives no piece.
    """
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()
    coded = staged(tokenize(docs, path, id_col, text_col), "tokens")
    # one row for each task of the first pass: as many as the input has splits, whatever they hold
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = coded.groupBy("part").agg(F.sum("n").alias("n"))
    starts = staged(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    placed = coded.join(F.broadcast(starts), "part").select("id", (F.col("before") + F.col("at")).alias("place"), "n", "ids")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            out, held = [], 0
            for doc, place, n, ids in batch.itertuples(index=False):
                full, start = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4"), 0
                while start < n:
                    sequence, offset = divmod(place + start, window)
                    length = min(n - start, window - offset)
                    piece = full[start : start + length].astype("<u4").tobytes()
                    out.append((doc, start, length, zlib.crc32(piece), n, sequence, offset, piece))
                    start, held = start + length, held + len(piece)
                    if held > HANDED:
                        yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})
                        out, held = [], 0
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    pieces = placed.mapInPandas(cut, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.withColumnRenamed("id", id_col)
