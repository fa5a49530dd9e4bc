"""Operator 1, language identification by prediction by partial matching.

For each language a context tree of bytes holds how often each byte followed each context of up to ORDER bytes. A
byte's probability blends along the tree: with n symbols of d kinds seen after a context, a symbol seen c times has
c / (n + d) there, and the escape d / (n + d) goes on to the context one byte shorter, at last to 1/256 for each byte
(method C; symbols aren't excluded after an escape). The statistics are frozen after the fit, so the code length of a
text is the sum over its bytes of a function of ORDER + 1 bytes, and each distinct string of that many bytes is scored
once and then looked up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.llm.common import hold, let_go, table, text_batches

#: Bytes of context. A string of ORDER + 1 bytes is an unsigned number of 8 bits a byte.
ORDER = 4
#: The fit reads at most about so many bytes of text of all languages together, an equal share of each; this bounds the model.
FIT_BYTES = 8_000_000
#: Where a text's first context would begin before it, zero bytes stand in.
_PAD = b"\0" * ORDER
_SLAB = 1 << 18
_SLOTS = 1 << 21
#: Code lengths that the table of strings may hold, over all languages.
_HELD = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_codes(data: np.ndarray) -> np.ndarray:
    """The strings of ORDER + 1 bytes that end at each byte from the ORDER-th on, as numbers."""
    wide = data.astype("uint64")
    n = len(wide) - ORDER
    out = wide[:n].copy()
    for i in range(1, ORDER + 1):
        out = (out << np.uint64(8)) | wide[i : i + n]
    return out


@dataclass
class ContextTrees:
    """Frozen statistics: for each language and order, sorted strings (context and symbol) and their counts."""

    langs: list[str]
    grams: list[np.ndarray]  # by language: distinct strings of ORDER + 1 bytes, sorted
    counts: list[np.ndarray]
    _levels: list[list[tuple[np.ndarray, ...]]] = field(default_factory=list)

    def __getstate__(self):
        return {"langs": self.langs, "grams": self.grams, "counts": self.counts, "_levels": []}

    def levels(self, lang: int) -> list[tuple[np.ndarray, ...]]:
        """From the longest context to none: (strings, their counts, contexts, their totals, their kinds of symbols)."""
        if not self._levels:
            for grams, counts in zip(self.grams, self.counts, strict=True):
                own = []
                for k in range(ORDER, -1, -1):
                    short = grams & np.uint64((1 << 8 * (k + 1)) - 1)
                    strings, at = np.unique(short, return_inverse=True)
                    n = np.bincount(at, counts, len(strings))
                    contexts, at = np.unique(strings >> np.uint64(8), return_inverse=True)
                    own.append((strings, n, contexts, np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float)))
                self._levels.append(own)
        return self._levels[lang]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each string: rows by string, columns by language."""
        out = np.empty((len(codes), len(self.langs)))
        for lang in range(len(self.langs)):
            p, weight = np.zeros(len(codes)), np.ones(len(codes))
            for k, (strings, n, contexts, total, kinds) in zip(range(ORDER, -1, -1), self.levels(lang), strict=True):
                short = codes & np.uint64((1 << 8 * (k + 1)) - 1)
                if not len(strings):
                    continue
                at = np.minimum(np.searchsorted(contexts, short >> np.uint64(8)), len(contexts) - 1)
                known = contexts[at] == short >> np.uint64(8)
                i = np.minimum(np.searchsorted(strings, short), len(strings) - 1)
                seen = np.where(strings[i] == short, n[i], 0.0)
                room = total[at] + kinds[at]
                p += np.where(known, weight * seen / room, 0.0)
                weight = np.where(known, weight * kinds[at] / room, weight)
            out[:, lang] = -np.log2(p + weight / 256)
        return out


class Scorer:
    """Code lengths of texts, with a table of strings scored before (bounded; beyond it strings are scored each time)."""

    def __init__(self, trees: ContextTrees):
        self.trees = trees
        self.keys = np.full(_SLOTS, np.iinfo("uint64").max, "uint64")
        self.rows = np.zeros(_SLOTS, "int32")
        self.bits = np.zeros((0, len(trees.langs)))
        self.free = min(_SLOTS // 2, _HELD // max(1, len(trees.langs)))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _MIX) >> np.uint64(64 - 21)).astype("int64")

    def of(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        lost = np.flatnonzero(self.keys[slot] != codes)
        if not len(lost):
            return self.bits[self.rows[slot]]
        new, back = np.unique(codes[lost], return_inverse=True)
        scored = self.trees.bits(new)
        at = self._slot(new)
        put = np.flatnonzero(self.keys[at] == np.iinfo("uint64").max)[: self.free]
        put = put[np.unique(at[put], return_index=True)[1]]
        self.keys[at[put]] = new[put]
        self.rows[at[put]] = len(self.bits) + np.arange(len(put))
        self.bits = np.concatenate([self.bits, scored[put]])
        self.free -= len(put)
        out = np.zeros((len(codes), len(self.trees.langs)))
        found = np.ones(len(codes), bool)
        found[lost] = False
        out[found] = self.bits[self.rows[slot[found]]]
        out[lost] = scored[back]
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Rows by text, columns by language: bits."""
        total = np.zeros((len(texts), len(self.trees.langs)))
        slab: list[bytes] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal slab, owner, size
            if slab:
                data = np.frombuffer(b"".join(slab), "uint8")
                ends = np.cumsum([len(s) for s in slab])
                bits = self.of(gram_codes(data))
                for i, s, e in zip(owner, np.concatenate([[0], ends[:-1]]), ends - ORDER, strict=True):
                    total[i] += bits[s:e].sum(axis=0)
            slab, owner, size = [], [], 0

        for i, t in enumerate(texts):
            padded = _PAD + t
            for at in range(ORDER, len(padded), _SLAB):
                part = padded[at - ORDER : at + _SLAB]
                slab.append(part)
                owner.append(i)
                size += len(part)
                if size >= _SLAB:
                    flush()
        flush()
        return total


#: Bytes of a text that are taken or left out together.
PIECE = 1 << 12


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_bytes: int = FIT_BYTES) -> ContextTrees:
    """Context trees of every language among rows with text and language.

    The bytes of each language are counted over all rows. Where they exceed its share of fit_bytes, a share of the pieces of PIECE
    bytes that its texts fall into is taken, chosen by a hash of id, text and place, so that a language in one long text is learned as
    one in many short ones. The trees have about fit_bytes strings at most, which bounds what reaches the driver
    and goes to the executors. Without any labelled row there are no languages.
    """
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where("t is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("t") + ORDER).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return ContextTrees([], [], [])
    share = fit_bytes / len(langs)
    number = most = F.lit(-1)
    for i, lang in enumerate(langs):
        number = F.when(F.col("lang") == lang, i).otherwise(number)
        most = F.when(F.col("lang") == lang, int(min(1.0, share / sizes[lang]) * (1 << 30))).otherwise(most)
    every = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("t") - 1, F.lit(0)) / PIECE).cast("int"))
    placed = rows.select(number.alias("lang"), "t", F.xxhash64("k", "t").alias("h"), most.alias("most"))
    chosen = placed.withColumn("pieces", F.filter(every, lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) < F.col("most")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, own in b.groupby("lang"):
                codes = []
                for t, pieces in zip(own["t"], own["pieces"], strict=True):
                    data = np.frombuffer(_PAD + t.encode(), "uint8")
                    codes += [gram_codes(data[i * PIECE : (i + 1) * PIECE + ORDER]) for i in pieces]
                grams, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.astype("int64"), "n": n})

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("gram")
        return pd.DataFrame({"lang": b["lang"].iloc[:1], "grams": [b["gram"].to_numpy().tobytes()], "counts": [b["n"].to_numpy("int32").tobytes()]})

    found = chosen.where(F.size("pieces") > 0).select("lang", "t", "pieces").mapInPandas(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    packed = {r["lang"]: r for r in found.groupBy("lang").applyInPandas(pack, "lang int, grams binary, counts binary").toLocalIterator()}
    grams = [np.frombuffer(packed[i]["grams"], "uint64") if i in packed else np.zeros(0, "uint64") for i in range(len(langs))]
    counts = [np.frombuffer(packed[i]["counts"], "int32") if i in packed else np.zeros(0, "int32") for i in range(len(langs))]
    del packed
    let_go()
    return ContextTrees(langs, grams, counts)


def identify(df: DataFrame, trees: ContextTrees, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per row of df: id_col (or the columns in keep), lang_pred, score, bits_per_byte (of the best language).

    The language with the shortest code for the whole text wins, ties go to the first by name; score is the share of its
    probability in that of all languages. Null texts, texts without a letter and empty ones are `und` with score 0, and
    so is everything if no language was learned. Repeated rows stay; other columns are left out.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(trees)
    key = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        letter = regex.compile(r"\p{L}")
        scorer = hold(key, lambda: Scorer(model.value))
        langs = np.array([*scorer.trees.langs, "und"], dtype=object)
        for own in parts:
            n = len(own)
            ok = np.array([bool(langs[:-1].size) and t is not None and letter.search(t) is not None for t in own], bool)
            best, score, rate = np.full(n, len(langs) - 1), np.zeros(n), np.zeros(n)
            texts = [t.encode() for t in own[ok]]
            if texts:
                bits = scorer.texts(texts)
                best[ok] = bits.argmin(axis=1)
                least = bits.min(axis=1)
                score[ok] = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
                rate[ok] = least / [len(t) for t in texts]
            yield pd.DataFrame({"lang_pred": langs[best], "score": score, "bits_per_byte": rate})

    columns = (id_col,) if keep is None else keep
    return df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), judge(F.col(text_col)).alias("_j")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "_j.lang_pred", "_j.score", "_j.bits_per_byte")


def held_out():
    """Whether a document belongs to the held-out quarter: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learned from the documents that aren't held out."""
    text_batches(spark)
    docs = table(spark, sf_dir, "documents")
    got = identify(docs, fit(docs.where(~held_out())))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
