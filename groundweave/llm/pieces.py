"""Operator 5, SentencePiece encoding and decoding with a table of distinct marked words.

In a model none of whose pieces has a whitespace marker after another character, no merge crosses the start of a run
of markers. A normalised text then falls into chunks, a run of markers and what follows up to the next run, and its
ids are those of its chunks in order. Each task segments a distinct chunk once and joins the ids back by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.llm.chunks import ChunkTable
from groundweave.llm.common import hold, table, text_batches

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_START = re.compile(f"(?<!{MARK}){MARK}")
_PROBE = "a  b ﬁ　c\tZ "


def chunkable(model) -> bool:
    """Whether texts may be cut at markers: no piece crosses one, and normalising only marks spaces."""
    crossing = any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return not crossing and model.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK)


def _cut(text: str, at: int) -> int:
    found = _START.search(text, at)
    return found.start() if found else len(text)


def _encoder(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = lambda ids: np.asarray(ids, "<u4").tobytes()
    if not chunkable(model):
        return model, lambda texts: [raw(model.encode(t)) for t in texts]
    # A chunk's first marker is the one that encoding a text of its own puts there.
    chunks = ChunkTable(lambda new: [raw(x) for x in model.encode([c[1:] for c in new], num_threads=1)] if new else [])
    lone = raw([model.piece_to_id(MARK)])

    def encode(texts: list[str]) -> list[bytes]:
        return chunks.texts([MARK + t.replace(" ", MARK) if t else "" for t in texts], _CHUNK.findall, _cut)

    # The library gives no ids for an empty text, so a lone marker has its own entry.
    plain = chunks.encode
    chunks.encode = lambda new: [lone if c == MARK else x for c, x in zip(new, plain(new), strict=True)]
    return model, encode


def sentencepiece_ids(df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", decode: bool = True) -> DataFrame:
    """One row per row of df: id_col, ids (binary, little-endian unsigned 32-bit, with begin and end ids), decoded.

    The ids are the library's for the whole text; decoded is its decode(ids). A null or empty text has the begin and
    end ids alone and decodes to an empty text. Repeated rows and ids stay as they are; other columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, encode = hold(("pieces", model_path), lambda: _encoder(model_path))
        begin, end = (np.asarray([x], "<u4").tobytes() for x in (model.bos_id(), model.eos_id()))
        for b in batches:
            ids = [begin + x + end for x in encode([t or "" for t in b["t"]])]
            back = [model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids] if decode else None
            yield pd.DataFrame({"k": b["k"], "ids": ids, "decoded": back})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInPandas(run, f"k {kind}, ids binary, decoded string").withColumnRenamed("k", id_col)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text as digests."""
    import public_tokenizers

    text_batches(spark)
    got = sentencepiece_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
