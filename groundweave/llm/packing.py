"""Operator 9, best-fit packing planned on a histogram of lengths.

The plan is made over counts: best fit, decreasing, moves whole groups of equally filled sequences at once, so its work
and its size depend on the capacity alone, not on the number of documents. A document's piece then takes the planned
slot that has its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundweave.llm.common import hold, table, text_batches, written

CAPACITY = 2048
#: About as many pieces of one length are ranked by one task; a length with more is dealt to as many tasks as it takes.
RANKED = 1_000_000


def _encoder(path: str) -> Callable[[str], bytes]:
    """The file's ids for a text, as little-endian unsigned 32-bit integers.

    A byte-level file whose ids follow its merges is a table of ranks, which tiktoken takes as well and works off three
    times as fast. Texts that hold an added token's string, and other files, go to the tokenizers library.
    """
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    added = [x["content"] for x in file["added_tokens"]]

    @lru_cache(maxsize=1)
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)  # loaded only where a text needs it

    plain = lambda text: np.asarray(library().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    ranks = _ranks(file)
    if ranks is None:
        return plain
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
    return lambda text: plain(text) if any(x in text for x in added) else fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


#: The words of byte-level tokenizers with use_regex, a fixed value of that format.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(file: dict) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE file whose ids are in the order of its merges; else None."""
    how, model = file["pre_tokenizer"] or {}, file["model"]
    if file["normalizer"] or how.get("type") != "ByteLevel" or how.get("add_prefix_space") or not how.get("use_regex") or model["type"] != "BPE":
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary = {k: v for k, v in model["vocab"].items() if all(c in byte for c in k)}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(vocabulary) != len(merged) + 256:
        return None
    return {bytes(byte[c] for c in k): v for k, v in vocabulary.items()}


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Rows id_col, piece, start, length, ids_crc32 (and ids): each text's ids and an end id, cut if longer than capacity.

    The last pieces are full; the first takes what is left over. A null or empty text is the end id alone. Repeated
    rows each give their pieces; other columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = hold(("ranks", tokenizer_path), lambda: _encoder(tokenizer_path)), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"], strict=True):
                ids = encode(t or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * s : 4 * e]
                    rows.append((k, i, s, e - s, zlib.crc32(part), part if keep_ids else None))
            yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInPandas(run, f"k {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return (got if keep_ids else got.drop("ids")).withColumnRenamed("k", id_col)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, decreasing, over counts of lengths: rows (length, first rank, ranks, first sequence, offset).

    The pieces of a length whose ranks are first + i, i under ranks, take the offset in sequence first sequence + i.
    """
    free: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # room left: groups of (sequences, lengths in them)

    def put(room: int, n: int, lengths: tuple[int, ...]) -> None:
        free.setdefault(room, []).append((n, lengths))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, left // each, (length,) * each)
                if left % each:
                    put(capacity - left % each * length, 1, (length,) * (left % each))
                break
            n, lengths = free[room].pop()
            if not free[room]:
                del free[room]
            if n > left:
                put(room, n - left, lengths)
            put(room - length, min(n, left), (*lengths, length))
            left -= min(n, left)
    out, used, sequence = [], dict.fromkeys(counts, 0), 0
    for room in sorted(free):
        for n, lengths in free[room]:
            offset = 0
            for x in lengths:
                out.append((x, used[x], n, sequence, offset))
                used[x] += n
                offset += x
            sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", ranked: int = RANKED) -> DataFrame:
    """pieces with sequence_id and offset; lengths must lie between 1 and capacity.

    Only the histogram reaches the driver: a row for each length, and one more for each `ranked` pieces. An empty table
    gives no rows. Rows that are equal in all columns may swap their slots.
    """
    found = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    salts = F.lit(np.array([1 + found.get(x, 0) // ranked for x in range(capacity + 1)]))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in pieces.columns)), F.get(salts, F.col("length").cast("int"))))
    seen = salted.groupBy("length", "_salt").count().orderBy("length", "_salt").collect()
    group, first, counts = np.zeros(len(seen), "int64"), np.zeros(len(seen), "int64"), {}
    for i, (length, salt, n) in enumerate(seen):
        group[i], first[i] = (length << 32) + salt, counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    slots = sorted(plan_slots(counts, capacity))
    table_of = {n: np.array([s[i] for s in slots], "int64") for i, n in enumerate(("length", "first", "n", "sequence", "offset"))}
    key = (table_of["length"] << 44) + table_of["first"]
    placed = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece")) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["length"].to_numpy()
            rank = first[np.searchsorted(group, (length << 32) + b.pop("_salt").to_numpy())] + b.pop("_rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            yield b.assign(sequence_id=table_of["sequence"][at] + rank - table_of["first"][at], offset=table_of["offset"][at])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return placed.mapInPandas(run, f"{kinds}, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packed_documents(spark, table(spark, sf_dir, "documents"))


def packed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    text_batches(spark)
    return pack(written(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))
