"""Embeddings: blocked nearest neighbours, voting, mutual matches, spread, assignment, projections, regression sweeps.

Vectors are rows (id, v: array of doubles). Similarities are computed block against block in NumPy and only the best of a
block leave the task, so the table of all similarities never exists.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundweave.sources.shared import written

#: Queries whose similarities to a block are held at once.
STRIP = 256


def _blocks(df: DataFrame, block: int) -> int:
    return max(1, -(-df.count() // block))


def best_of(sims: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column, value of each row's `want` greatest, ties to the smaller column, NaN last."""
    below = -sims
    want = min(want, sims.shape[1])
    least = np.partition(below, want - 1, axis=1)[:, want - 1 : want]
    rows, columns = np.nonzero(~(below > least))
    order = np.lexsort((columns, below[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(sims)))
    held = np.arange(len(rows)) - first[rows] < want
    return rows[held], columns[held], sims[rows[held], columns[held]]


def knn_join(queries: DataFrame, train: DataFrame, k: int, skip_first: bool = False, block: int = 8192) -> DataFrame:
    """q, rank (from 1), id, sim: each query's k best by dot product, ties to the smaller id; all if there are fewer.

    With skip_first the best hit is left out and ranks start after it.
    """
    want = k + skip_first
    nq, nt = _blocks(queries, block), _blocks(train, block)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("id", "v", deal(nq).alias("a"), spread(nt).alias("b"))
    t = train.select("id", "v", spread(nq).alias("a"), deal(nt).alias("b"))

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"q": [], "id": [], "sim": []})
        t = t.sort_values("id")
        ids, own, right = t["id"].to_numpy(), q["id"].to_numpy(), np.stack(t["v"].to_numpy()).T
        parts = []
        for at in range(0, len(q), STRIP):
            rows, columns, sims = best_of(np.stack(q["v"].iloc[at : at + STRIP].to_numpy()) @ right, want)
            parts.append(pd.DataFrame({"q": own[at : at + STRIP][rows], "id": ids[columns], "sim": sims}))
        return pd.concat(parts)

    found = q.groupBy("a", "b").cogroup(t.groupBy("a", "b")).applyInPandas(best, "q long, id long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id")) - int(skip_first)
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank").between(1, k)).select("q", "rank", "id", "sim")


def knn_vote(neighbours: DataFrame, ks: tuple[int, ...] = (10, 20, 100, 200), temperature: float = 0.07) -> DataFrame:
    """q, k, label, p: softmax(sim / temperature) over all neighbours (q, rank, label, sim), summed by class over the first k."""
    most = F.max("sim").over(Window.partitionBy("q"))
    weight = neighbours.withColumn("_e", F.exp((F.col("sim") - most) / temperature))
    share = weight.withColumn("_p", F.col("_e") / F.sum("_e").over(Window.partitionBy("q")))
    each = share.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("rank") <= F.col("k"))
    return each.groupBy("q", "k", "label").agg(F.sum("_p").alias("p"))


def similarities(a: DataFrame, b: DataFrame, candidates: DataFrame) -> DataFrame:
    """i, j, sim of candidate pairs (i, j)."""
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return candidates.join(a.select(F.col("id").alias("i"), F.col("v").alias("va")), "i").join(b.select(F.col("id").alias("j"), F.col("v").alias("vb")), "j").select("i", "j", dot.alias("sim"))


def mutual_nn_match(a: DataFrame, b: DataFrame, candidates: DataFrame | None = None, temperature: float = 0.1, threshold: float = 0.2, block: int = 4096) -> DataFrame:
    """i, j, score of pairs that are each other's best among the candidates (i, j), or among all pairs of a and b; the score is the
    softmax over i's candidates times that over j's, and must be over threshold. Ties go to the smaller id.

    Without candidates no table of pairs is made: blocks of a meet blocks of b, and of each block a row and a column
    keep their best and their sum of exponentials about it, which add up over blocks (see _mutual_of_all). Rows without
    an id or a vector match nothing.
    """
    if candidates is None:
        return _mutual_of_all(a, b, temperature, threshold, block)
    sims = similarities(a, b, candidates)
    soft = lambda by: F.exp((F.col("sim") - F.max("sim").over(Window.partitionBy(by))) / temperature)
    both = sims.withColumns({"ei": soft("i"), "ej": soft("j")})
    first = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), other))
    share = both.withColumn("score", F.col("ei") / F.sum("ei").over(Window.partitionBy("i")) * F.col("ej") / F.sum("ej").over(Window.partitionBy("j")))
    return share.withColumns({"ri": first("i", "j"), "rj": first("j", "i")}).where((F.col("ri") == 1) & (F.col("rj") == 1) & (F.col("score") > threshold)).select("i", "j", "score")


#: Similarities are compared to so many places, as equal vectors' differ in the last bits with their place in a block.
PLACES = 12


def _mutual_of_all(a: DataFrame, b: DataFrame, temperature: float, threshold: float, block: int) -> DataFrame:
    """Of i's row of similarities with maximum M, softmax at the maximum is 1 / sum(exp((sim - M) / temperature)). A part of the row
    gives (its maximum m, the least id there, its sum s about m); parts add up as s * exp((m - M) / temperature). Columns alike.
    A pair that is best both ways has the score 1 / (i's sum * j's sum), so only the two tables of best partners are joined."""
    a, b = (d.select("id", "v").where("id is not null and v is not null") for d in (a, b))
    na, nb = _blocks(a, block), _blocks(b, block)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.select("id", "v", deal(na).alias("a"), spread(nb).alias("b"))
    right = b.select("id", "v", spread(na).alias("a"), deal(nb).alias("b"))

    def parts(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame([], columns=["side", "id", "best", "other", "total"])
        x, y = x.sort_values("id"), y.sort_values("id")
        ids, others, against = x["id"].to_numpy(), y["id"].to_numpy(), np.stack(y["v"].to_numpy()).T
        best, other, total = np.full(len(y), -np.inf), np.zeros(len(y), ids.dtype), np.zeros(len(y))
        out = []
        for at in range(0, len(x), STRIP):
            sims = np.round(np.stack(x["v"].iloc[at : at + STRIP].to_numpy()) @ against, PLACES)
            own = ids[at : at + STRIP]
            top = sims.argmax(axis=1)  # the first of equals has the least id
            most = sims[np.arange(len(own)), top]
            out.append(pd.DataFrame({"side": 0, "id": own, "best": most, "other": others[top], "total": np.exp((sims - most[:, None]) / temperature).sum(axis=1)}))
            top = sims.argmax(axis=0)
            most = sims[top, np.arange(len(others))]
            up = np.maximum(best, most)
            other = np.where(most > best, own[top], other)
            total = total * np.exp((best - up) / temperature) + np.exp((sims - up) / temperature).sum(axis=0)
            best = up
        out.append(pd.DataFrame({"side": 1, "id": others, "best": best, "other": other, "total": total}))
        return pd.concat(out)

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(parts, "side int, id long, best double, other long, total double")
    held = found.groupBy("side", "id").agg(F.sort_array(F.collect_list(F.struct("best", "other", "total"))).alias("p"))  # one for each block
    top = F.array_max(F.transform("p", lambda p: p["best"]))
    merged = held.withColumn("_m", top).select(
        "side", "id",
        F.array_min(F.transform(F.filter("p", lambda p: p["best"] == F.col("_m")), lambda p: p["other"])).alias("other"),
        F.aggregate("p", F.lit(0.0), lambda s, p: s + p["total"] * F.exp((p["best"] - F.col("_m")) / temperature)).alias("total"),
    )
    table = written(merged, "best-partners")
    ours = table.where("side = 0").select(F.col("id").alias("i"), F.col("other").alias("j"), F.col("total").alias("_i"))
    theirs = table.where("side = 1").select(F.col("id").alias("j"), F.col("other").alias("i"), F.col("total").alias("_j"))
    return ours.join(theirs, ["i", "j"]).select("i", "j", (1 / (F.col("_i") * F.col("_j"))).alias("score")).where(F.col("score") > threshold)


def best_match_confident(a: DataFrame, b: DataFrame, thr: float = 0.5) -> DataFrame:
    """q, id, sim: the most similar of b by cosine for points of a (id, v, conf) with conf over thr, or over 0 if none is."""
    any_ = a.where(F.col("conf") > thr).limit(1).count() > 0
    unit = lambda d: d.withColumn("v", F.transform("v", lambda x: x / (F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)) + 1e-8)))
    return knn_join(unit(a.where(F.col("conf") > (thr if any_ else 0.0))), unit(b), 1).select("q", "id", "sim")


def knn_in_groups(vectors: DataFrame, k: int, group: str, block: int = 8192) -> DataFrame:
    """_group, q, rank (from 1), id, sim: each vector's k best others of its own group (id, v, group; null is a group), ties to the smaller id.

    Groups of up to `block` vectors come whole and many to a task; larger ones are dealt into blocks that meet each
    other, so that no group is one task.
    """
    own = vectors.select(F.col(group).alias("_group"), "id", "v").where("id is not null and v is not null")
    sizes = written(own.groupBy("_group").agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).withColumnRenamed("_group", "_of"), "group-sizes")
    met = own.join(sizes, F.col("_group").eqNullSafe(F.col("_of"))).drop("_of")
    work = sizes.agg(F.sum(F.col("_n") * F.col("_blocks"))).first()[0] or 0
    tasks = max(1, -(-int(work) // block))
    mine = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    to = F.pmod(F.xxhash64("_group", "a", "b"), F.lit(tasks)).cast("int").alias("_task")
    q = met.withColumn("a", mine).withColumn("b", every).select("_group", "a", "b", "id", "v", to)
    t = met.withColumn("b", mine).withColumn("a", every).select("_group", "a", "b", "id", "v", to)
    t = t.select(*(F.col(c).alias(c) for c in t.columns))  # columns of its own, as both sides come from one table

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        units = dict(iter(t.groupby(["_group", "a", "b"], dropna=False, sort=False)))
        nulls = [u for key, u in units.items() if pd.isna(key[0])]
        out = []
        for key, own in q.groupby(["_group", "a", "b"], dropna=False, sort=False):
            other = units.get(key)
            if other is None and pd.isna(key[0]):  # null keys don't equal each other
                other = next((u for u in nulls if (u["a"].iloc[0], u["b"].iloc[0]) == key[1:]), None)
            if other is None:
                continue
            other = other.sort_values("id")
            ids, asked, right = other["id"].to_numpy(), own["id"].to_numpy(), np.stack(other["v"].to_numpy()).T
            for at in range(0, len(own), STRIP):
                rows, columns, sims = best_of(np.stack(own["v"].iloc[at : at + STRIP].to_numpy()) @ right, k + 1)
                some = asked[at : at + STRIP][rows]
                out.append(pd.DataFrame({"_group": pd.Series([own["_group"].iloc[0]] * len(some), dtype=own["_group"].dtype), "q": some, "id": ids[columns], "sim": sims}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["_group", "q", "id", "sim"])

    kind = own.schema["_group"].dataType.simpleString()
    found = q.groupBy("_task").cogroup(t.groupBy("_task")).applyInPandas(best, f"_group {kind}, q long, id long, sim double").where("q <> id")
    rank = F.row_number().over(Window.partitionBy("_group", "q").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("_group", "q", "rank", "id", "sim")


def embedding_spread(vectors: DataFrame, topk: int = 1, eps: float = 1e-8, group: str | None = None) -> DataFrame:
    """spread: mean of -log(distance to the topk nearest other vectors + eps) of unit vectors (id, v); with a group column, a row for each group with
    neighbours taken from the group alone (null for a group of one vector)."""
    d = F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0)))
    if group:
        spread = knn_in_groups(vectors, topk, group).groupBy("_group").agg(F.avg(-F.log(d + eps)).alias("spread"))
        all_ = vectors.where("id is not null and v is not null").groupBy(group).agg(F.count("*").alias("n"))
        return all_.join(spread, F.col(group).eqNullSafe(F.col("_group")), "left").select(group, "n", "spread")
    found = knn_join(vectors, vectors, topk + 1).where(F.col("id") != F.col("q"))
    near = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).where(F.col("_r") <= topk)
    return near.agg(F.avg(-F.log(d + eps)).alias("spread"))


def balanced_assignment(scores: DataFrame, temperature: float, n_iterations: int = 3) -> DataFrame:
    """sample, prototype, q: exp(score / temperature) balanced in turn, prototypes to equal sums, then samples to sums of 1."""
    most = scores.agg(F.max("score")).first()[0]
    q = scores.select("sample", "prototype", F.exp((F.col("score") - F.lit(most)) / temperature).alias("q"))
    sizes = scores.agg(F.count_distinct("sample").alias("b"), F.count_distinct("prototype").alias("k")).first()
    for _ in range(n_iterations):
        by_prototype = q.groupBy("prototype").agg(F.sum("q").alias("_s"))
        q = q.join(by_prototype, "prototype").select("sample", "prototype", (F.col("q") / F.col("_s") / sizes["k"]).alias("q"))
        q = written(q.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy("sample")) / sizes["b"]), "assigned")
    return q.withColumn("q", F.col("q") * sizes["b"])


def feature_pca3(vectors: DataFrame) -> DataFrame:
    """id, c: three principal components scaled to 0..255 over all values and truncated; a component's greatest loading is
    positive."""
    rows = vectors.select("id", array_to_vector("v").alias("v"))
    model = PCA(k=3, inputCol="v", outputCol="p").fit(rows)
    loadings = model.pc.toArray()
    sign = [1.0 if c[np.abs(c).argmax()] >= 0 else -1.0 for c in loadings.T]
    p = model.transform(rows).select("id", vector_to_array("p").alias("p"))
    mean = rows.select(vector_to_array("v").alias("v")).select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).toPandas().sort_values("i")["m"].to_numpy()
    base = mean @ loadings  # PCA projects without centring
    own = p.select("id", F.array(*((F.col("p")[i] - float(base[i])) * sign[i] for i in range(3))).alias("p"))
    ends = own.agg(F.min(F.array_min("p")).alias("a"), F.max(F.array_max("p")).alias("b")).first()
    span = (ends["b"] - ends["a"]) or 1.0
    return own.select("id", F.transform("p", lambda x: F.floor((x - F.lit(ends["a"])) * 255.0 / F.lit(span)).cast("int")).alias("c"))


#: Fits of a sweep that run at once: each is a row of short jobs, between which the tasks would wait.
FITS = 8
#: Rows of which a task of a fit has no more, unless all tasks have them.
FITTED = 20_000


def logreg_sweep(train: DataFrame, val: DataFrame, test: DataFrame, cs: list[float] | None = None, refit: bool = True, max_iter: int = 100) -> DataFrame:
    """c, is_best, val_accuracy of each strength, and test_accuracy of the best, refitted on train and val if asked.

    Tables are (id, v, label). c is the inverse of the penalty's strength over all rows. FITS strengths are fitted at once.
    """
    cs = [float(c) for c in (10 ** np.linspace(-6, 5, 45) if cs is None else cs)]
    rows = lambda d: d.select(array_to_vector("v").alias("features"), F.col("label").cast("double").alias("label"))
    spark, a, n = train.sparkSession, rows(train), train.count()
    tasks = min(spark.sparkContext.defaultParallelism, -(-n // FITTED))
    a, b, c_ = (a if a.rdd.getNumPartitions() >= tasks else a.repartition(tasks)).cache(), rows(val).cache(), rows(test)
    right = lambda m, d: m.transform(d).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    fit = lambda d, c, n: LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, maxIter=max_iter).fit(d)
    with ThreadPool(FITS) as pool:
        scores = list(zip(cs, pool.map(inheritable_thread_target(spark)(lambda c: right(fit(a, c, n), b)), cs, chunksize=1), strict=True))
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    whole = a.unionByName(b) if refit else a
    final = right(fit(whole, best, whole.count()), c_)
    a.unpersist(), b.unpersist()
    return train.sparkSession.createDataFrame([(c, c == best, v, final if c == best else None) for c, v in scores], "c double, is_best boolean, val_accuracy double, test_accuracy double")
