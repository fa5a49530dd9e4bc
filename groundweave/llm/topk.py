"""Operator 2, exact top-k by inner product over norm-sorted vectors.

Candidates are parted by ranges of length, and within a part they stand by descending length. An orthogonal rotation (the eigenvectors of the
sum of outer products, as an SVD gives them) brings most of every product into the first coordinates, the head. For a
query with least score s so far, a block is skipped if |q| times its greatest length is under s; else a vector is
scored exactly only if its head product plus the product of both tails' lengths (Cauchy-Schwarz) reaches s. The first
scores come from the longest vectors of all, so that every part starts with a good bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundweave.llm.common import table, written

K = 10
SCALE = 1024
#: Coordinates of the head; vectors that give the first bound; vectors of a block; of a part; queries of a part.
HEAD = 24
SEEDS = 2048
BLOCK = 1024
PART, QUERIES = 1 << 13, 1 << 15
#: Queries that are compared with a block at once.
AT_ONCE = 1 << 11


def whole_numbers(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """Rows id, v (array of whole numbers floor(scale * x)), dim, norm2 of the vectors that are neither null nor hold a
    null, NaN or infinite component."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(False))
    made = df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))
    return made.select("id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("norm2"))


def _outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for dim, own in b.groupby("dim")["v"]:
            if dim:
                m = np.stack(own.to_numpy())
                sums[dim] = sums.get(dim, 0) + m.T @ m
    for dim, s in sums.items():
        yield pd.DataFrame({"dim": dim, "i": np.arange(dim), "row": list(s)})


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension: the orthonormal eigenvectors of the sum of outer products, greatest first. Only dim x dim sums move."""
    summed = vectors.mapInPandas(_outer, "dim int, i int, row array<double>").select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    found = {}
    for dim, own in summed.groupby("dim"):
        m = np.zeros((dim, dim))
        m[own["i"], own["j"]] = own["x"]
        found[int(dim)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return found


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: score down, id up."""
    return np.lexsort((ids, -score))[:k]


def search(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, c: np.ndarray, c_ids: np.ndarray, rotation: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best of the candidates that reach its bound. q, c: whole numbers as doubles, rows by vector."""
    length = np.sqrt((c * c).sum(axis=1))
    order = np.lexsort((c_ids, -length))
    c, c_ids, length = c[order], c_ids[order], length[order]
    head = min(HEAD, c.shape[1])
    qr, cr = q @ rotation, c @ rotation
    q_tail, c_tail = np.sqrt((qr[:, head:] ** 2).sum(axis=1)), np.sqrt((cr[:, head:] ** 2).sum(axis=1))
    q_length = np.sqrt((q * q).sum(axis=1))
    slack = 1e-9 * (1 + q_length * (length[0] if len(length) else 0))  # rounding of the rotated sums
    bound = bound.astype(float).copy()
    top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, "int64")) for _ in q]
    for at in range(0, len(c), BLOCK):
        live = np.flatnonzero(q_length * length[at] + slack >= bound)
        if not len(live):
            break
        part = slice(at, at + BLOCK)
        reach = qr[live, :head] @ cr[part, :head].T + np.outer(q_tail[live], c_tail[part]) + slack[live, None]
        hit = reach >= bound[live, None]
        for i, row in zip(live, hit, strict=True):
            found = at + np.flatnonzero(row)
            found = found[c_ids[found] != q_ids[i]]
            if not len(found):
                continue
            score = np.concatenate([top[i][0], c[found] @ q[i]])
            ids = np.concatenate([top[i][1], c_ids[found]])
            keep = _best(score, ids, k)
            top[i] = score[keep], ids[keep]
            if len(keep) == k:
                bound[i] = max(bound[i], score[keep[-1]])
    n = [len(s) for s, _ in top]
    return pd.DataFrame({"query_id": np.repeat(q_ids, n), "vec_id": np.concatenate([i for _, i in top]) if n else [], "score": np.concatenate([s for s, _ in top]) if n else []})


def part_of(spark: SparkSession, cuts: list[float]):
    """A Column function: how many of the sorted cuts lie under a value. The cuts, one for each PART vectors, are data of the task, not of the plan."""
    held = spark.sparkContext.broadcast(np.array(cuts, float))

    @F.pandas_udf("int")
    def part(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, x.to_numpy(float), side="left").astype("int32"))

    return part


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, score: each query's k best by whole-number inner product, all if fewer.

    vectors and queries are as of whole_numbers. Rows that repeat an id count once, with the vector of the greatest length
    (then the greatest by its components). A query meets vectors of its own dimension but never the one with
    its id; ties go to the smaller id. Candidates are dealt in parts by ranges of length, queries by hash; a query goes to
    those parts only whose greatest length times its own reaches its first bound. No vectors or no queries give no rows.
    """
    one = lambda df: df.groupBy("id").agg(F.max(F.struct("norm2", "v", "dim")).alias("x")).select("id", "x.v", "x.dim", "x.norm2")
    vectors, queries = written(one(vectors), "vectors"), written(one(queries), "queries")
    turn = vectors.sparkSession.sparkContext.broadcast(rotations(vectors))
    seeds = vectors.orderBy(F.desc("norm2"), "id").limit(SEEDS).select("id", "v", "dim").toPandas()
    first = vectors.sparkSession.sparkContext.broadcast({int(d): (np.stack(x["v"].to_numpy()) if d else np.zeros((len(x), 0)), x["id"].to_numpy("int64")) for d, x in seeds.groupby("dim")})

    n, m = vectors.count(), queries.count()
    parts, blocks = max(1, -(-n // PART)), max(1, -(-m // QUERIES))
    cuts = sorted(set(vectors.approxQuantile("norm2", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    ranged = written(vectors.select("id", "v", "dim", "norm2", part_of(vectors.sparkSession, cuts)("norm2").alias("p")), "ranged")
    # By dimension: parts and their greatest length, two numbers for each PART vectors.
    most = {int(d): (x["p"].to_numpy(), np.sqrt(x["m"].to_numpy())) for d, x in ranged.groupBy("dim", "p").agg(F.max("norm2").alias("m")).toPandas().groupby("dim")}
    longest = vectors.sparkSession.sparkContext.broadcast(most)

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            least, there = np.full(len(b), -np.inf), [np.zeros(0, "int32")] * len(b)
            for dim, rows in b.groupby("dim"):
                if dim in first.value:
                    c, ids = first.value[dim]
                    scores = np.stack(rows["v"].to_numpy()) @ c.T if dim else np.zeros((len(rows), len(ids)))
                    scores[rows["id"].to_numpy()[:, None] == ids[None]] = -np.inf
                    if len(ids) > k:
                        least[rows.index] = np.partition(scores, -k, axis=1)[:, -k]
                own, length = longest.value.get(dim, (np.zeros(0, "int32"), np.zeros(0)))
                for i, size in zip(rows.index, np.sqrt(rows["norm2"]), strict=True):
                    there[i] = own[size * (1 + 1e-9) * length + 1e-6 >= least[i]]
            yield b.assign(bound=least, there=there)

    known = queries.mapInPandas(bounds, "id long, v array<double>, dim int, norm2 double, bound double, there array<int>")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    held = written(known.select("id", "v", "dim", "bound", block.alias("q"), "there"), "asked")
    asked = held.select("id", "v", "dim", "bound", "q", F.explode("there").alias("p"))
    wanted = held.select("dim", "q", F.explode("there").alias("p")).distinct()
    wanted = wanted.select(*(F.col(c).alias(c) for c in wanted.columns))  # columns of its own, as the queries come from the same table
    given = ranged.select("id", "v", "dim", "p").join(wanted, ["dim", "p"])  # a part goes to blocks with a query in reach

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if q.empty or c.empty:
            return empty
        dim = int(q["dim"].iloc[0])
        rows = lambda x: np.stack(x["v"].to_numpy()) if dim else np.zeros((len(x), 0))
        own, ids, turned = rows(c), c["id"].to_numpy(), turn.value.get(dim, np.zeros((0, 0)))
        some = (q.iloc[i : i + AT_ONCE] for i in range(0, len(q), AT_ONCE))
        return pd.concat([search(rows(x), x["id"].to_numpy(), x["bound"].to_numpy(), own, ids, turned, k) for x in some]).astype("int64")

    found = asked.groupBy("dim", "q", "p").cogroup(given.groupBy("dim", "q", "p")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all other vectors for every hundredth."""
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_inner_products(vectors, vectors.where("id % 100 = 0"))


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""
