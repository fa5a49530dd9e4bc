"""Operator 3, document fingerprints from prefix polynomial hashes.

Modular prefix arrays of a text give the hash of any span by one difference, so span equality is one comparison and the
longest common extension of two positions a binary search. A fingerprint is the hash of the whole text under two primes
and, for likeness, a sketch of the hashes of all spans of SPAN code points: the least hash in each of BINS classes. How
far two texts agree from their starts on is their longest common extension there, under both primes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundweave.llm.common import let_go, table, text_batches, written

P1, P2 = 2147483647, 2147483629  # the two largest primes below 2**31
BASE1, BASE2 = 1103515245, 1220703125
SPAN = 12
BINS = 64
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, p: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) mod p; a table that doubles as longer texts come."""
    own = _powers.get((base, p), np.ones(1, "uint64"))
    while len(own) < n:
        own = np.concatenate([own, own * np.uint64(pow(base, len(own), p)) % np.uint64(p)])
    _powers[base, p] = own
    return own[:n]


class Prefixes:
    """Prefix arrays of a text of code points under one prime."""

    def __init__(self, text: str, base: int = BASE1, p: int = P1):
        self.base, self.p, self.inverse = base, np.uint64(p), pow(base, -1, p)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
        self.n = len(points)
        sums = np.zeros(self.n + 1, "uint64")
        np.cumsum((points + np.uint64(1)) * powers(base, p, self.n) % self.p, out=sums[1:])
        self.sums = (sums % self.p).astype("uint32")  # half the memory while a text waits for the next

    def span(self, start: np.ndarray | int, length: int) -> np.ndarray:
        """Hashes of the spans of one length at the given starts; equal spans have equal hashes wherever they stand."""
        start = np.asarray(start)
        shift = powers(self.inverse, int(self.p), self.n + 1)[start]
        return (self.sums[start + length] + self.p - self.sums[start]) % self.p * shift % self.p

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length."""
        n = self.n - length + 1
        return (self.sums[length:] + self.p - self.sums[:n]) % self.p * powers(self.inverse, int(self.p), n) % self.p


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """The longest common extension of position i of a and j of b, by binary search over span equality."""
    p = int(a.p)
    (x, u), (y, v) = ((int(s.sums[k]), int(powers(s.inverse, p, s.n + 1)[k])) for s, k in ((a, i), (b, j)))
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if (int(a.sums[i + mid]) - x) * u % p == (int(b.sums[j + mid]) - y) * v % p:
            low = mid
        else:
            high = mid - 1
    return low


def sketch(text: str) -> tuple[str, np.ndarray, tuple[Prefixes, Prefixes]]:
    """Fingerprint of a text, the numbers of its sketch, and its prefix arrays under both primes; an empty class of the
    sketch holds 65536 and shows as `----`."""
    first, second = Prefixes(text), Prefixes(text, BASE2, P2)
    whole = f"{int(first.sums[-1]):08x}{int(second.sums[-1]):08x}{first.n:08x}"
    slots = np.full(BINS, 65536, "uint64")
    if first.n:
        mixed = first.spans(min(SPAN, first.n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.full(BINS, np.iinfo("uint64").max, "uint64")
        np.minimum.at(least, (mixed & np.uint64(BINS - 1)).astype("int64"), mixed >> np.uint64(6))
        held = least != np.iinfo("uint64").max
        slots[held] = least[held] & np.uint64(65535)
    return whole + "".join("----" if s == 65536 else f"{s:04x}" for s in slots.tolist()), slots, (first, second)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal numbers among classes that either sketch fills; 1 for two empty texts."""
    held = (a != 65536) | (b != 65536)
    return float((a == b)[held].mean()) if held.any() else 1.0


def common_start(a: tuple[Prefixes, Prefixes], b: tuple[Prefixes, Prefixes]) -> int:
    """How many code points two texts have in common from their starts on; both primes must agree."""
    return min(common_extension(x, 0, y, 0) for x, y in zip(a, b, strict=True))


def _row(key, text: str, own: tuple, after: str, next_own: tuple) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = sketch(edited)
    near = (likeness(own[1], x[1]) for x in (changed, next_own))
    return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own[0], changed[0], *near, common_start(own[2], changed[2]), common_start(own[2], next_own[2])


_COLUMNS = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
_KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def edited_neighbours(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df with the fingerprints of its text and of its edited text, their likeness (near_) to each
    other and to the next text's, and how many code points the texts have in common from their starts on (common_).

    The edited text has its last half (rounded down) replaced by as many first code points of the next text, in order of
    id and text, the first text after the last. Null texts are empty. Rows are sorted into ranges of ids; within a range
    a text meets the next as it passes. Only the first and last text of each range are brought together afterwards. A
    table of one row has itself as next; an empty one gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        held = first = None
        for b in batches:
            rows = []
            for key, text in zip(b["k"], b["t"], strict=True):
                now = (key, text, sketch(text))
                if held:
                    rows.append((*_row(*held, now[1], now[2]), 0, None))
                else:
                    first = (key, text)
                held = now
            yield pd.DataFrame(rows, columns=[*_COLUMNS, "edge", "t"])
        if held:
            none = [None] * (len(_COLUMNS) - 1)
            edges = [(first[0], *none, 1, first[1]), (held[0], *none, 2, held[1])]
            yield pd.DataFrame(edges, columns=[*_COLUMNS, "edge", "t"]).astype(dict.fromkeys(("n_chars", "common_edited", "common_next"), "Int64"))

    source = df.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ranges = source.repartitionByRange("k").sortWithinPartitions("k", "t")
    out = written(ranges.mapInPandas(run, f"k {kind}, {_KINDS}, edge int, t string"), "ranges")
    # Two rows a range: ids alone are put in one order, texts are joined to them.
    edges = out.where("edge > 0").select("k", "edge", "t", F.xxhash64("k", "edge", "t").alias("e"))
    order = Window.orderBy(F.col("k").asc_nulls_first(), "edge")
    placed = edges.select("k", "edge", "e").withColumn("after", F.lead("e").over(order)).withColumn("start", F.first("e").over(order))
    links = placed.where("edge = 2").select("e", F.coalesce("after", "start").alias("after"))
    heads = edges.where("edge = 1").select(F.col("e").alias("after"), F.col("t").alias("after_t")).dropDuplicates(["after"])
    met = edges.where("edge = 2").join(links, "e").join(heads, "after").select("k", "t", "after_t")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_row(k, t, sketch(t), a, sketch(a)) for k, t, a in zip(b["k"], b["t"], b["after_t"], strict=True)], columns=_COLUMNS)

    return out.where("edge = 0").drop("edge", "t").unionByName(met.mapInPandas(close, f"k {kind}, {_KINDS}")).withColumnRenamed("k", id_col)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, their likeness and common starts."""
    text_batches(spark)
    return edited_neighbours(table(spark, sf_dir, "documents"))
