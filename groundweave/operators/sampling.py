"""Samples, splits and numbering that are the same on every run: keys come from a portable hash of ids and seeds."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundweave.sources.shared import discard, written

MODULUS = 4294967296


def hash_key(key: Column, seed: Column | int = 0) -> Column:
    """A number under 2**32 from an id under 3e9 and a seed."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.pmod(key.cast("long") * 2654435761 + seed.cast("long") * 40503, F.lit(MODULUS))


def uniform(key: Column, seed: Column | int = 0) -> Column:
    return hash_key(key, seed) / F.lit(float(MODULUS))


def dealt_by_range(df: DataFrame, per_task: int, *order: Column) -> DataFrame:
    """df written with _b, the number of its range in order (from 0, empty ranges may be left out), ranges of about per_task rows.
    discard(result) removes it."""
    held = written(df, "unranged")
    ranges = max(1, -(-held.count() // per_task))
    out = written(held.repartitionByRange(ranges, *order).withColumn("_b", F.spark_partition_id()), "ranged")
    discard(held)
    return out


def numbered(df: DataFrame, order: list[Column], name: str = "rn", start: int = 0) -> DataFrame:
    """df with consecutive numbers in one order, without gathering it: ranges are sorted apart, and each range starts
    where the ranges before it end. order should have no ties; tied rows may swap. The result reads a written table, which
    discard(result) removes."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    base = ranged.groupBy("_part").count().select(F.col("_part").alias("_at"), (F.coalesce(before, F.lit(0)) + F.lit(start - 1)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    met = ranged.join(base, F.col("_part") == F.col("_at"))
    out = met.withColumn(name, (F.col("_base") + inside).cast("long")).drop("_part", "_at", "_base")
    out.written_to = vars(ranged).pop("written_to")
    return out


def numbered_by(df: DataFrame, by: str | list[str], order: list[Column], name: str = "turn") -> DataFrame:
    """df with the place (from 0) of each row within its group, where a group may be most of the rows: ranges of (by,
    order) are numbered as a whole and each group's first number is taken off. discard(result) removes what it reads."""
    keys = [by] if isinstance(by, str) else by
    places = numbered(df, [*map(F.col, keys), *order], "_rn")
    all_ = written(places, "numbered")
    discard(places)
    first = all_.groupBy(*keys).agg(F.min("_rn").alias("_first")).withColumnsRenamed({c: f"_by_{c}" for c in keys})
    met = all_.join(first, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in keys)))
    out = met.select(*df.columns, (F.col("_rn") - F.col("_first")).alias(name))
    out.written_to = vars(all_).pop("written_to")
    return out


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with each of sums added up from the first row of its group to the row itself, where a group may be most of the
    rows: ranges of (by, order) are summed apart, and each starts with what its group has in the ranges before it."""
    ranged = written(df.withColumns({f"_{n}": v for n, v in sums.items()}).repartitionByRange(*map(F.col, by), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    whole = ranged.groupBy(*by, "_part").agg(*(F.sum(f"_{n}").alias(f"_of_{n}") for n in sums))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = whole.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_at"), *(F.sum(f"_of_{n}").over(before).alias(f"_of_{n}") for n in sums))
    met = ranged.join(base, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_part") == F.col("_at")))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = met.select(*df.columns, *((F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) + F.coalesce(f"_of_{n}", F.lit(0))).alias(n) for n in sums))
    out.written_to = vars(ranged).pop("written_to")
    return out


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], times: Column | int = 1) -> DataFrame:
    """by, p: exact percentiles of each group's values (array, between neighbours in proportion; nulls don't count), a
    row standing for `times` values. Equal values are counted first and their counts added up by ranges, so that no group's values come together."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(times if isinstance(times, Column) else F.lit(times).cast("long")).alias("_n"))
    sums = running(counts, by, [F.col(value)], {"_upto": F.col("_n")})
    placed = written(sums, "counted")
    discard(sums)
    size = placed.groupBy(*by).agg(F.max("_upto").alias("_size")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    met = placed.join(size, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.lit(True)))
    at = [(F.col("_size") - 1) * share for share in shares]
    value_at = lambda i: F.min(F.when(F.col("_upto") > i, F.col(value)))
    found = met.groupBy(*by).agg(*(x for i, a in enumerate(at) for x in (value_at(F.floor(a)).alias(f"_l{i}"), value_at(F.ceil(a)).alias(f"_h{i}"), F.max(a - F.floor(a)).alias(f"_r{i}"))))
    return found.where("_l0 is not null").select(*by, F.array(*(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_r{i}") for i in range(len(at)))).alias("p"))


def sample_groups(groups: DataFrame, n: int | None = None, select: list[int] | None = None, seed: int = 42, key: str = "group_id") -> DataFrame:
    """n groups without replacement in hash order, or the groups at the given positions of the id order."""
    if select is not None:
        return numbered(groups, [F.col(key)], "_pos").where(F.col("_pos").isin(*select)).drop("_pos")
    return groups.orderBy(hash_key(F.col(key), seed), key).limit(n)


def few_shot_subset(labels: DataFrame, k_or_percent: float, n_tries: int = 1) -> DataFrame:
    """try, idx, label: for each try and class n samples in hash order, or max(int(count * percent), 1) under one."""
    tries = labels.select("idx", "label", F.explode(F.sequence(F.lit(0), F.lit(n_tries - 1))).alias("try"))
    placed = numbered_by(tries, ["try", "label"], [hash_key(F.col("idx"), F.col("try")), F.col("idx")])
    if k_or_percent >= 1:
        return placed.where(F.col("turn") < int(k_or_percent)).select("try", "idx", "label")
    counts = labels.groupBy("label").agg(F.greatest(F.floor(F.count("*") * F.lit(float(k_or_percent))), F.lit(1)).alias("_n"))
    return placed.join(counts, "label").where("turn < _n").select("try", "idx", "label")


def few_shot_multilabel(labels: DataFrame, k_or_percent: float, n_tries: int = 1) -> DataFrame:
    """try, idx: for each try the samples, once each, that any of their classes picks (labels: idx, label, a row for each label of a sample).

    A class picks k samples in hash order, or max(int(count * percent), 1) under one. As a picked sample brings its other labels along, a percentage
    is then set anew for each try to percent / (labels that came / labels wanted), and the classes pick again in the same order.
    Repeated rows count once; rows without a sample or a label are left out.
    """
    known = labels.select("idx", "label").where("idx is not null and label is not null").distinct()
    tries = known.select("idx", "label", F.explode(F.sequence(F.lit(0), F.lit(n_tries - 1))).alias("try"))
    places = numbered_by(tries, ["try", "label"], [hash_key(F.col("idx"), F.col("try")), F.col("idx")])
    placed = written(places, "few-shot")
    discard(places)
    if k_or_percent >= 1:
        return placed.where(F.col("turn") < int(k_or_percent)).select("try", "idx").distinct()
    counts = known.groupBy("label").agg(F.count("*").alias("_n"))
    met = placed.join(counts, "label")
    pick = lambda share: F.col("turn") < F.greatest(F.floor(F.col("_n") * share), F.lit(1))
    first = met.where(pick(F.lit(float(k_or_percent)))).select("try", "idx").distinct()
    came = first.join(known, "idx").groupBy("try").agg(F.count("*").alias("_came"))
    wanted = known.agg(F.floor(F.count("*") * F.lit(float(k_or_percent))).alias("_wanted"))
    share = F.when(F.col("_wanted") > 0, F.lit(float(k_or_percent)) / (F.col("_came") / F.col("_wanted"))).otherwise(0.0)
    shares = came.crossJoin(F.broadcast(wanted)).select(F.col("try").alias("_try"), share.alias("_share"))  # a row for each try
    return met.join(F.broadcast(shares), F.col("try") == F.col("_try")).where(pick(F.col("_share"))).select("try", "idx").distinct()


def train_val_split(labels: DataFrame, p: float = 0.1, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """idx, label, is_val: of each class of n the first max(1, int(p n)) are for validation, none of a class of one."""
    key = [hash_key(F.col("idx"), seed), F.col("idx")] if shuffle else [F.col("idx")]
    size = F.when(F.count("*") > 1, F.greatest(F.floor(F.count("*") * F.lit(p)), F.lit(1))).otherwise(0)
    placed = numbered_by(labels.select("idx", "label"), "label", key)
    return placed.join(labels.groupBy("label").agg(size.alias("_size")), "label").select("idx", "label", (F.col("turn") < F.col("_size")).alias("is_val"))


def epoch_shard(ids: DataFrame, size: int, epoch: int, start: int, step: int, seed: int = 0, advance: int = 0) -> DataFrame:
    """pos, id: an epoch of `size` items from repeated ids in hash order, of which every step-th from start on, without
    the first `advance`."""
    n = ids.count()
    if not n:
        return ids.select(F.lit(0).cast("long").alias("pos"), "id").limit(0)
    turns = -(-size // n)
    tiled = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    mixed = (seed * epoch) if seed else epoch
    placed = numbered(tiled, [hash_key(F.col("id") + F.col("turn") * n, mixed), F.col("id"), F.col("turn")], "pos").where(F.col("pos") < size)
    return placed.where((F.col("pos") % step == start) & (F.floor(F.col("pos") / step) >= advance)).select("pos", "id")


def mixture_sample(sources: DataFrame, ratios: dict[str, float], n: int, seed: int = 65537) -> DataFrame:
    """draw, source, id: each draw picks a source by ratio and takes its next row in hash order; the draws end before the first
    that finds its source empty."""
    spark = sources.sparkSession
    total, low = sum(ratios.values()), 0.0
    pick, u = F.lit(None).cast("string"), F.col("u")
    for name, r in ratios.items():
        pick = F.when((u >= low / total) & (u < (low + r) / total), name).otherwise(pick)
        low += r
    draws = spark.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("u")).select("draw", pick.alias("source"))

    def turn(df: DataFrame, order: list[Column]) -> DataFrame:
        placed = numbered_by(df, "source", order)
        out = written(placed, "mixture")
        discard(placed)
        return out

    d = turn(draws, [F.col("draw")])
    s = turn(sources.where(F.col("source").isin(*ratios)), [hash_key(F.col("id"), seed), F.col("id")])
    met = written(d.join(s, ["source", "turn"], "left"), "mixture")
    discard(d, s)
    empty = met.where("id is null").agg(F.min("draw").alias("m")).first()["m"]
    return (met if empty is None else met.where(F.col("draw") < empty)).select("draw", "source", "id")


def training_pair_draw(groups: DataFrame, epoch: int) -> DataFrame:
    """group_id, a, b: two images of each group's n; if the same is drawn twice, the second is the next."""
    seed = F.col("group_id") + epoch * 10000
    a, b = F.pmod(hash_key(seed, 1), "n"), F.pmod(hash_key(seed, 2), "n")
    return groups.select("group_id", a.alias("a"), F.when(a == b, F.pmod(a + 1, "n")).otherwise(b).alias("b"))


def cap_windows(windows: DataFrame, n: int, seed: int = 42, scored: bool = True) -> DataFrame:
    """At most n windows of each pair, by score or in hash order; all for n <= 0."""
    if n <= 0:
        return windows
    key = [F.desc("score")] if scored else [hash_key(F.col("window_id"), seed)]
    return windows.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy(*key, "window_id"))).where(F.col("_r") <= n).drop("_r")


def assign_group_ids(windows: DataFrame, existing: DataFrame, max_groups: int | None = None) -> DataFrame:
    """Windows that aren't skipped with consecutive group ids after the greatest existing numeric name."""
    last = existing.agg(F.max(F.expr("try_cast(name AS BIGINT)")).alias("m")).first()["m"]
    out = numbered(windows.where(~F.col("skipped")), [F.col("window_id")], "group_id", 0 if last is None else last + 1)
    return out if max_groups is None else out.where(F.col("group_id") < (0 if last is None else last + 1) + max_groups)


def smoothed_metric(metrics: DataFrame, window: int = 20, chunk: int = 100_000) -> DataFrame:
    """metric, step, median (the lower middle), avg of the last `window` values, global_avg of all so far.

    A metric may be most of the rows: its values are numbered by ranges and meet in chunks, each with the values just before it.
    """
    order = [F.col("step"), F.col("value")]
    sums = {"_place": F.lit(1).cast("long"), "_seen": F.col("value").isNotNull().cast("long"), "_total": F.col("value").cast("double")}
    summed = running(metrics.select("metric", "step", "value"), ["metric"], order, sums)
    placed = written(summed, "placed")
    discard(summed)
    own = F.floor((F.col("_place") - 1) / chunk)
    again = F.floor((F.col("_place") - 1 + window - 1) / chunk)  # the chunk that needs the value for its first rows
    dealt = placed.withColumn("_own", own).withColumn("_chunk", F.explode(F.array_distinct(F.array(own, again))))
    last = Window.partitionBy("metric", "_chunk").orderBy("_place").rowsBetween(1 - window, 0)
    held = F.sort_array(F.collect_list("value").over(last))
    median = F.get(held, F.floor((F.size(held) - 1) / 2).cast("int")).alias("median")
    found = dealt.select("metric", "step", median, F.avg("value").over(last).alias("avg"), F.try_divide("_total", F.col("_seen").cast("double")).alias("global_avg"), (F.col("_chunk") == F.col("_own")).alias("_mine"))
    return found.where("_mine").drop("_mine")
