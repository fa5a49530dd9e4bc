"""Operator 7, exact Jaccard join on word shingles with token-combination prefixes.

Documents with equal sets are one class from the start. Shingles are ordered by class of frequency: rare ones first, by
hash, then the frequent ones (a bounded table, by rising count). With J >= 0.8 two sets of sizes n share a token among
their first n - ceil(0.8 n) + 1, the prefix. If a rare token of both prefixes is shared, the index of single rare tokens
finds the pair. Otherwise a shared token of the prefixes is frequent, so all rare tokens of either set lie in its prefix;
such sets extend their prefix, and combinations of k neighbouring tokens in it are indexed, k by the class of the first:
2 for frequent tokens, 3 for very frequent ones. The two sets together have D <= n / 4 tokens that aren't shared,
which part the shared ones into D + 1 runs at most; so among the first 3 D + 3 tokens of their union three shared ones
are neighbours in both (sets of under SMALL tokens, which may have no such three, index pairs in the first 2 D + 2).

Every entry of the index says how many tokens of its set two sets that meet there can share at most: from a rare token
on, as it is the first shared one in the bucket that counts; all frequent ones for a combination, as no rare one is
shared. So of a large family of edited copies only those meet whose own tokens are few enough for the threshold.

Candidates never mean all pairs of a bucket. First each member meets the bucket's centre, the one with the fewest rare
tokens or else the best connected one; then only members of different components meet, the largest component of a bucket standing on one side. Parity signatures, whose
Hamming distance never exceeds the size of the symmetric difference, drop pairs early; the rest is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.llm.common import discard, let_go, table, text_batches, trimmed, written
from groundweave.llm.repeats import Spans

WORDS = 5
#: The threshold in hundredths.
NEAR = 80
#: A shingle counts as frequent from so many documents on. All are counted, but those that stand once in a part of
#: _HELD tokens only if they are among their documents' first by hash (half as many again as the prefix). The table
#: of frequent shingles holds the FREQUENT_MOST most frequent; buckets of others stay exact, and grow with their number.
FREQUENT = 32
FREQUENT_MOST = 1 << 18
#: A combination that begins with a token in so many documents has three tokens, else two.
MANY = 1024
#: Sets of fewer tokens than SMALL index pairs, sets of LEAST or more combinations by class; partners always share a kind.
LEAST, SMALL = 12, 16
#: Tokens that a task gathers before it passes them on.
_HELD = 1 << 19
_CLASSES = 1 << 18


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words, A-Z lower-cased; of all words if there are fewer."""
    own = text.lower().split()  # of bytes: just A-Z, and just white space \x09-\x0D and \x20
    if not own:
        return np.zeros(0, "int64")
    length = np.fromiter(map(len, own), "int64", len(own))
    end = np.cumsum(length + 1) - 1
    k = min(words, len(own))
    return np.unique(Spans(np.frombuffer(b" ".join(own), "uint8"), 0)(end[: len(own) - k + 1] - length[: len(own) - k + 1], end[k - 1 :]))


def set_hashes(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set that don't depend on order."""
    wide = tokens.view("uint64")
    first = (wide * np.uint64(0x9E3779B97F4A7C15) ^ (wide >> np.uint64(17))).sum(dtype="uint64")
    return int(first.view("int64")), int(np.bitwise_xor.reduce(wide * np.uint64(0xD1342543DE82EF95)).view("int64"))


def signature(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the tokens by their last bits, packed into bytes."""
    return np.packbits(np.bincount((tokens.view("uint64") & np.uint64(bits - 1)).astype("int64"), minlength=bits).astype("uint8") & 1)


def signature_bits(n: int) -> int:
    return max(256, 1 << (4 * n - 1).bit_length())


def _fold(sig: np.ndarray, size: int) -> np.ndarray:
    while len(sig) > size:
        sig = sig[: len(sig) // 2] ^ sig[len(sig) // 2 :]
    return sig


def _packed(entries: np.ndarray, by: np.ndarray, buckets: int) -> pd.DataFrame:
    """Entries as bytes, by bucket of the numbers in `by`."""
    bucket = (by.view("uint64") % np.uint64(buckets)).astype("int64")
    order = np.argsort(bucket, kind="stable")
    own, start = np.unique(bucket[order], return_index=True)
    return pd.DataFrame({"bucket": own, "packed": [x.tobytes() for x in np.split(entries[order], start[1:])][: len(own)]})


def _summaries(buckets: int, near: int):
    """By document: size, two hashes of the set, signature (whole and in four numbers). By part of a task: tokens that
    it repeats with their number, and those that stand once in it, among the first of a document by hash, by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        held: list[np.ndarray] = []
        first: list[np.ndarray] = []
        room = _HELD

        def counted() -> Iterator[pd.DataFrame]:
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, "int64"), np.zeros(0, "int64"))
            often = tokens[n > 1]
            yield pd.DataFrame({"token": often, "times": n[n > 1]}).astype("Int64")
            once = np.concatenate(first) if first else tokens
            once = once[often[np.minimum(np.searchsorted(often, once), len(often) - 1)] != once] if len(often) else once
            yield _packed(once, once, buckets)

        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["t"], strict=True):
                tokens = shingle_set(text)
                n = len(tokens)
                s1, s2 = set_hashes(tokens)
                sig = signature(tokens, signature_bits(n)) if n else np.zeros(32, "uint8")
                rows.append((key, n, s1, s2, sig.tobytes(), *(int(x) for x in _fold(sig, 32).view("<i8"))))
                held.append(tokens)
                first.append(tokens[: 3 * prefix(n, near) // 2])
                room -= n
                if room < 0:
                    yield from counted()
                    held, first, room = [], [], _HELD
            yield pd.DataFrame(rows, columns=["id", "n", "s1", "s2", "sig", "g0", "g1", "g2", "g3"])
        yield from counted()

    return run


def _counted(b: pd.DataFrame) -> pd.DataFrame:
    """The tokens of a bucket that stand in several parts, with the number of parts."""
    tokens, n = np.unique(np.frombuffer(b"".join(b["packed"]), "int64"), return_counts=True)
    return pd.DataFrame({"token": tokens[n > 1], "times": n[n > 1]})


def _ordered(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, many: int) -> tuple[np.ndarray, int, int]:
    """Tokens in the global order, how many of them are rare, and how many come before the very frequent ones (of rank
    `many` or more)."""
    if not len(frequent):
        return tokens, len(tokens), len(tokens)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    hit = frequent[at] == tokens
    often, place = tokens[hit], rank[at[hit]]
    return np.concatenate([tokens[~hit], often[np.argsort(place, kind="stable")]]), int((~hit).sum()), len(tokens) - int((place >= many).sum())


def prefix(n: int, near: int = NEAR) -> int:
    return n - -(-near * n // 100) + 1


def extended(n: int, near: int = NEAR, k: int = 2) -> int:
    """How many tokens hold k shared neighbours: k (D + 1), where D is at most (1 / t - 1) n for threshold t."""
    return min(n, k * ((100 - near) * n // near + 1))


#: An entry of the index of single tokens; rest: tokens of the set from this one on.
_ENTRY = np.dtype([("token", "<i8"), ("set", "<i8"), ("rest", "<u4")])


def _rare_keys(model, buckets: int, near: int):
    """Packed entries of rare prefix tokens, by bucket of tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        held: list[np.ndarray] = []
        room = _HELD

        def pack() -> pd.DataFrame:
            all_ = np.concatenate(held) if held else np.zeros(0, _ENTRY)
            return _packed(all_, np.ascontiguousarray(all_["token"]), buckets)

        for b in batches:
            for text in b["t"]:
                tokens, rare, _ = _ordered(shingle_set(text), *model.value)
                own = np.zeros(min(rare, prefix(len(tokens), near)), _ENTRY)
                own["token"], own["set"], own["rest"] = tokens[: len(own)], set_hashes(tokens)[0], len(tokens) - np.arange(len(own))
                held.append(own)
                room -= len(own)
            if room < 0:
                yield pack()
                held, room = [], _HELD
        yield pack()

    return run


def _shared_keys(b: pd.DataFrame) -> pd.DataFrame:
    """The entries of a bucket whose token several sets have."""
    all_ = np.frombuffer(b"".join(b["packed"]), _ENTRY)
    all_ = all_[np.lexsort((all_["set"], all_["token"]))]
    same = all_["token"][1:] == all_["token"][:-1]
    all_ = all_[np.concatenate([np.ones(min(1, len(all_)), bool), ~(same & (all_["set"][1:] == all_["set"][:-1]))])]
    same = all_["token"][1:] == all_["token"][:-1]
    none = np.zeros(min(1, len(all_)), bool)
    all_ = all_[np.concatenate([none, same]) | np.concatenate([same, none])]
    return pd.DataFrame({"key": all_["token"], "s1": all_["set"], "rest": all_["rest"].astype("int64")})


def combinations(tokens: np.ndarray, before: int, near: int = NEAR) -> np.ndarray:
    """Keys of neighbouring tokens in the extended prefix of a set in the global order; `before` of them aren't very frequent."""
    n, wide, keys = len(tokens), tokens.view("uint64"), []
    two = wide[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (wide[1:] * np.uint64(0xD1342543DE82EF95) >> np.uint64(3))
    if n < SMALL:
        keys.append(two[: max(0, extended(n, near) - 1)])
    if n >= LEAST:
        starts = extended(n, near, 3) - 2  # of three neighbours in the extended prefix
        three = two[:starts] * np.uint64(0xAF251AF3B0F025B5) ^ (wide[2 : starts + 2] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(5))
        keys.append(np.where(np.arange(starts) < before, two[:starts] + np.uint64(1), three))
    return np.concatenate(keys).view("int64")


def _combination_keys(model, near: int):
    """Keys of combinations of sets whose rare tokens all lie in the prefix; rest: their frequent tokens, own: their rare ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for b in batches:
            keys, sets, rest, few = ([np.zeros(0, "int64")] for _ in range(4))
            for text in b["t"]:
                tokens, rare, before = _ordered(shingle_set(text), *model.value)
                if rare < prefix(len(tokens), near):
                    own = combinations(tokens, before, near)
                    keys.append(own)
                    sets.append(np.full(len(own), set_hashes(tokens)[0], "int64"))
                    rest.append(np.full(len(own), len(tokens) - rare, "int64"))
                    few.append(np.full(len(own), rare, "int64"))
            yield pd.DataFrame({"key": np.concatenate(keys), "s1": np.concatenate(sets), "rest": np.concatenate(rest), "own": np.concatenate(few)})

    return run


def _close(pairs: DataFrame, sigs: DataFrame, near: int, tag: str) -> DataFrame:
    """Pairs (a, b) whose signatures allow the threshold."""
    side = lambda c: sigs.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = []
            for na, sa, nb, sb in zip(x["na"], x["sa"], x["nb"], x["sb"], strict=True):
                sa, sb = np.frombuffer(sa, "uint8"), np.frombuffer(sb, "uint8")
                size = min(len(sa), len(sb))
                keep.append((100 + near) * int(np.bitwise_count(_fold(sa, size) ^ _fold(sb, size)).sum()) <= (100 - near) * (na + nb))
            yield x.loc[keep, ["a", "b"]]

    return written(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long"), f"{tag}-close")


def _links(pairs: DataFrame, docs: DataFrame, near: int, tag: str) -> DataFrame:
    """The pairs that whole sets confirm. docs: id, t, of which only the pairs' own are read into sets."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{tag}-wanted")
    of = F.pmod(F.xxhash64("id"), F.lit(_CLASSES)).alias("class")
    marks = written(wanted.select(of).distinct(), f"{tag}-classes")  # at most _CLASSES numbers
    texts = docs.withColumn("class", of).join(F.broadcast(marks), "class", "left_semi").drop("class")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "tokens": [shingle_set(t).tobytes() for t in x["t"]]})

    found = written(texts.join(wanted, "id", "left_semi").mapInPandas(trimmed(sets), "id long, tokens binary"), f"{tag}-sets")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for x in batches:
            keep = []
            for ta, tb in zip(x["ta"], x["tb"], strict=True):
                ta, tb = np.frombuffer(ta, "int64"), np.frombuffer(tb, "int64")
                both = len(np.intersect1d(ta, tb, assume_unique=True))
                keep.append(100 * both >= near * (len(ta) + len(tb) - both))
            yield x.loc[keep, ["a", "b"]]

    side = lambda c: found.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}"))
    out = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(trimmed(verify), "a long, b long"), f"{tag}-links")
    discard(pairs, wanted, marks, found)
    return out


def components(links: DataFrame) -> DataFrame:
    """Rows id, component (the least id reachable) of the ids in links (a, b): least labels of neighbours, then of labels."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        of = labels.select(F.col("id").alias("b"), "component")
        least = both.join(of, "b").groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(least, labels["id"] == least["a"]).select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = written(near.join(jump, "component").select("id", F.least("component", "next").alias("component"), "was"), "labels")
        discard(labels)
        labels = new
        if not new.where("component <> was").limit(1).count():
            discard(both)
            return new.drop("was")


def shingle_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", near: int = NEAR) -> DataFrame:
    """One row per row of df: id_col (an integer), n_shingles, component_id: the least id reachable over links of
    similarity near / 100 or more, its own included.

    Null and empty texts, and such of white space alone, have no shingles and no links. Rows that repeat an id count as
    one document with all their links; a null id has a null component. near must be 80 at least, for which
    the extended prefix is derived. An empty table gives no rows.
    """
    if not 80 <= near <= 100:
        raise ValueError("near must lie between 80 and 100")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kinds = "id long, n long, s1 long, s2 long, sig binary, g0 long, g1 long, g2 long, g3 long, token long, times long, bucket long, packed binary"
    size = docs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] // 6  # about as many tokens
    buckets = max(64, 1 << int(size // 5 // 50_000).bit_length())
    out = written(docs.mapInPandas(trimmed(_padded(_summaries(buckets, near), kinds)), kinds), "summaries")
    often = out.where("token is not null").select("token", "times").unionByName(out.where("bucket is not null").groupBy("bucket").applyInPandas(_counted, "token long, times long"))
    top = often.groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "token").limit(FREQUENT_MOST).toPandas()
    frequent = top["token"].to_numpy("int64")
    times = top["times"].to_numpy("int64")
    rank = np.argsort(np.argsort(times, kind="stable"), kind="stable")
    order = np.argsort(frequent)
    model = df.sparkSession.sparkContext.broadcast((frequent[order], rank[order], int((times < MANY).sum())))

    filled = out.where("n > 0 and id is not null")
    one = F.min_by(F.struct("sig", "g0", "g1", "g2", "g3"), "id")
    classes = written(filled.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), one.alias("x")).select("n", "s1", "s2", "rep", "x.*"), "classes")
    rows = written(out.where("n is not null").select("id", "n", "s1", "s2"), "rows")
    discard(out)

    texts = docs.where("id is not null and octet_length(t) > 0").select("t")
    rare = texts.mapInPandas(trimmed(_rare_keys(model, buckets, near)), "bucket long, packed binary").groupBy("bucket").applyInPandas(_shared_keys, "key long, s1 long, rest long").withColumn("own", F.lit(0).cast("long"))
    combined = written(texts.mapInPandas(trimmed(_combination_keys(model, near)), "key long, s1 long, rest long, own long").groupBy("key", "s1").agg(F.max("rest").alias("rest"), F.max("own").alias("own")), "combined")
    several = written(combined.groupBy("key").count().where("count > 1").select("key"), "several")
    keys = written(rare.unionByName(combined.join(several, "key", "left_semi")), "keys")
    discard(combined, several)
    degree = keys.groupBy("s1").agg(F.count("*").alias("degree"))
    members = written(keys.join(classes.join(degree, "s1").select("s1", "rep", "n", "degree", "g0", "g1", "g2", "g3"), "s1").drop("s1"), "members")
    discard(keys)
    model.destroy()

    sized = lambda a, b: (F.least(a, b) * 100 >= F.greatest(a, b) * near)
    parity = lambda a, b: sum((F.bit_count(F.col(f"{a}.g{i}").bitwiseXOR(F.col(f"{b}.g{i}"))) for i in range(4)), F.lit(0)) * (100 + near) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - near)
    fits = lambda: sized(F.col("x.n"), F.col("y.n")) & parity("x", "y")
    shares = F.least("x.rest", "y.rest") * (100 + near) >= (F.col("x.n") + F.col("y.n")) * near
    pair = (F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    centres = written(members.groupBy("key").agg(F.max(F.struct((-F.col("own")).alias("few"), "degree", (-F.col("rep")).alias("i"), "rep", "n", "g0", "g1", "g2", "g3")).alias("c")).select("key", "c.*").drop("few", "degree", "i"), "centres")
    met = members.alias("x").join(centres.alias("y"), F.col("x.key") == F.col("y.key")).where((F.col("x.rep") != F.col("y.rep")) & fits()).select(*pair).distinct()
    met = written(met, "met")
    discard(centres)
    links = _links(_close(met, classes, near, "star"), docs, near, "star")

    labels = components(links)
    placed = written(members.join(labels, members["rep"] == labels["id"], "left").select(members["*"], F.coalesce("component", "rep").alias("component")), "placed")
    discard(members, labels)
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    mains = written(sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("c"), F.count("*").alias("k")).where("k > 1").select("key", F.col("c.component").alias("main")), "mains")
    mixed = written(placed.join(mains, "key"), "mixed")
    discard(placed, mains)
    apart = mixed.where("component <> main").alias("x").join(mixed.alias("y"), (F.col("x.key") == F.col("y.key")) & shares & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))) & fits())
    rest = written(apart.select(*pair).distinct().join(met, ["a", "b"], "left_anti"), "rest")
    discard(mixed, met)
    more = _links(_close(rest, classes, near, "rest"), docs, near, "rest")
    discard(rest)
    labels = components(links.unionByName(more))
    discard(links, more)

    own = rows.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    joined = own.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def _padded(run, kinds: str):
    """run with the columns that a part of its rows lacks as nulls."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def padded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in run(batches):
            out = b.reindex(columns=names)
            whole = [k.split()[0] for k in kinds.split(", ") if k.endswith("long")]
            yield out.astype(dict.fromkeys(whole, "Int64"))

    return padded


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    text_batches(spark)
    return shingle_components(table(spark, sf_dir, "documents"))
