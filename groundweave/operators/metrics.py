"""Classification metrics over long prediction tables (idx, target, cls, score) and error reports.

Scores tie to the smaller class. Nothing is gathered by class on one machine but the ranks of rank metrics, which first
collapse rows of equal class and score.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundweave.operators.sampling import numbered_by, percentiles, running
from groundweave.sources.shared import written


#: Distinct values, of all groups together, up to which medians are taken from one buffer a group; beyond, by ranges.
FEW = 200_000


def error_report(errors: DataFrame, d: str = "d", by: tuple[str, ...] = (), overall: bool = True, few: int = FEW) -> DataFrame:
    """count, mean, median, max, rmse and percentages under 1, 3 and 5, for each group of `by`, and overall. With `by`, is_overall tells
    the overall row, whose keys are null, from a group of null keys; overall=False leaves it out.

    A NaN error counts and is never under a threshold, and makes mean, median, max and rmse of its group NaN. A null
    error counts as NaN. Without rows the overall row has count 0 and NaN. Equal errors of a group are counted first; the exact median comes
    from these counts in the same pass where they are few, else by ranges.
    """
    keys, nan = list(by), F.lit(float("nan"))
    counted = written(errors.groupBy(*keys, F.coalesce(F.col(d).cast("double"), nan).alias("_d")).agg(F.count("*").alias("_n")), "errors")
    x, n = F.col("_d"), F.col("_n")
    kept = F.when(~F.isnan(x), x)
    poisoned = lambda c: F.when(F.coalesce(F.max(F.isnan(x)), F.lit(True)), nan).otherwise(c)
    mean = lambda c: F.try_divide(F.sum(c * n), F.sum(n).cast("double"))
    under = lambda t: F.coalesce(mean(F.when(F.isnan(x), 0.0).when(x < t, 100.0).otherwise(0.0)), nan)
    first = [F.coalesce(F.sum(n), F.lit(0)).alias("count"), poisoned(mean(kept)).alias("mean")]
    rest = [poisoned(F.max(kept)).alias("max"), poisoned(F.sqrt(mean(kept * kept))).alias("rmse"), *(under(t).alias(f"lt{t}_percent") for t in (1, 3, 5))]
    at_once = counted.count() <= few

    def report(of: list[str]) -> DataFrame:
        found = counted.groupBy(*of).agg(*first, *([F.percentile(kept, 0.5, n).alias("_m")] if at_once else []), *rest)
        names = [c for c in found.columns[len(of) :] if c != "_m"]
        if not at_once:
            medians = percentiles(counted.where(~F.isnan(x)), of, "_d", [0.5], n).select(*(F.col(c).alias(f"_by_{c}") for c in of), F.col("p")[0].alias("_m"))
            found = found.join(medians, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in of), F.lit(True)), "left")
        median = F.when(F.isnan("mean"), nan).otherwise(F.col("_m")).alias("median")
        mark = [F.lit(not of).alias("is_overall")] if keys else []
        return found.select(*(F.col(c) if c in of else F.lit(None).cast(errors.schema[c].dataType).alias(c) for c in keys), *mark, *names[:2], median, *names[2:])

    if not keys:
        return report([])
    return report(keys).unionByName(report([])) if overall else report(keys)


def ranked(preds: DataFrame) -> DataFrame:
    """preds with the rank of each class by score, ties to the smaller class."""
    return preds.withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("score"), "cls")))


def topk_hits(preds: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """idx, target and hit{k}: whether the target is among the k best classes."""
    own = ranked(preds).groupBy("idx", "target").agg(F.min(F.when(F.col("cls") == F.col("target"), F.col("rank"))).alias("r"))
    return own.select("idx", "target", *(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double").alias(f"hit{k}") for k in ks))


def class_ks(n_classes: int) -> tuple[int, ...]:
    """The default ranks looked at: 1 and 5 from five classes on, else 1."""
    return (1, 5) if n_classes >= 5 else (1,)


def topk_accuracy(preds: DataFrame, ks: tuple[int, ...] = (1, 5), average: str = "micro") -> DataFrame:
    """accuracy{k}: over all samples (micro), the mean over classes (macro), or a row for each class (none)."""
    hits = topk_hits(preds, ks)
    if average == "micro":
        return hits.agg(*(F.avg(f"hit{k}").alias(f"accuracy{k}") for k in ks))
    per = hits.groupBy("target").agg(*(F.avg(f"hit{k}").alias(f"accuracy{k}") for k in ks))
    return per if average == "none" else per.agg(*(F.avg(f"accuracy{k}").alias(f"accuracy{k}") for k in ks))


def topk_recall(preds: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Recall of each class at each k, averaged over classes."""
    return topk_accuracy(preds, ks, "macro").select(*(F.col(f"accuracy{k}").alias(f"recall{k}") for k in ks))


def f1_scores(outcomes: DataFrame, average: str = "macro") -> DataFrame:
    """F1 of rows (cls, predicted, actual: 0 or 1); multiclass predictions are rows for each class as well.

    A class without predicted or actual members has F1 0.
    """
    sums = (F.sum(F.col("predicted") * F.col("actual")).alias("tp"), F.sum("predicted").alias("p"), F.sum("actual").alias("a"))
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("p") + F.col("a")), F.lit(0.0))
    if average == "micro":
        return outcomes.agg(*sums).select(f1.alias("f1"))
    per = outcomes.groupBy("cls").agg(*sums).select("cls", f1.alias("f1"))
    return per if average == "none" else per.agg(F.avg("f1").alias("f1"))


def multiclass_outcomes(preds: DataFrame) -> DataFrame:
    """(cls, predicted, actual) of the best class of each sample."""
    return ranked(preds).select("cls", (F.col("rank") == 1).cast("int").alias("predicted"), (F.col("cls") == F.col("target")).cast("int").alias("actual"))


def auroc(preds: DataFrame) -> DataFrame:
    """cls, auroc: one class against the rest, by average ranks. A class without members or without others has null."""
    same = preds.groupBy("cls", "score").agg(F.sum((F.col("target") == F.col("cls")).cast("long")).alias("pos"), F.count("*").alias("n"))
    neg = F.col("n") - F.col("pos")
    upto = running(same, ["cls"], [F.col("score")], {"upto": neg})
    wins = upto.select("cls", "pos", neg.alias("neg"), (F.col("pos") * (F.col("upto") - neg / 2)).alias("u"))
    return wins.groupBy("cls").agg(F.try_divide(F.sum("u"), F.sum("pos") * F.sum("neg").cast("double")).alias("auroc"))


def average_precision(scores: DataFrame, kind: str = "macro") -> DataFrame:
    """cls, ap of rows (cls, score, actual). `macro` sums precision at each step of recall; `voc2007` averages the
    best precision at recalls 0, 0.1 .. 1. Classes without members have null."""
    same = scores.groupBy("cls", "score").agg(F.sum("actual").alias("pos"), F.count("*").alias("n"))
    steps = running(same, ["cls"], [F.desc("score")], {"tp": F.col("pos"), "seen": F.col("n")}).withColumn("precision", F.col("tp") / F.col("seen"))
    if kind == "macro":
        return steps.groupBy("cls").agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("tp")).alias("ap"))
    whole = same.groupBy("cls").agg(F.sum("pos").alias("all"))
    steps = steps.join(whole, "cls").withColumn("recall", F.try_divide("tp", "all"))
    best = [F.coalesce(F.max(F.when(F.col("recall") >= i / 10, F.col("precision"))), F.lit(0.0)) for i in range(11)]
    return steps.groupBy("cls").agg(F.when(F.max("all") > 0, reduce(lambda a, b: a + b, best) / 11).alias("ap"))


def any_match_accuracy(preds: DataFrame, targets: DataFrame, k: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy: the share of samples with any of their k best classes among their targets; overall and by each of `by`.

    targets has idx, targets (array; -1 is none) and the columns of by. Samples without a target don't count.
    """
    best = ranked(preds).where(F.col("rank") <= k).groupBy("idx").agg(F.collect_list("cls").alias("best"))
    held = targets.withColumn("targets", F.array_remove("targets", -1)).where(F.size("targets") > 0)
    hits = held.join(best, "idx").withColumn("hit", F.arrays_overlap("best", "targets").cast("double"))
    return hits.groupingSets([[], *([c] for c in by)], *by).agg(F.avg("hit").alias("accuracy")) if by else hits.agg(F.avg("hit").alias("accuracy"))


def macro_mrr(preds: DataFrame, num_classes: int) -> DataFrame:
    """mrr: 1 / (classes that score at least the target's score), averaged within classes, then over all num_classes."""
    own = preds.groupBy("idx", "target").agg(F.max(F.when(F.col("cls") == F.col("target"), F.col("score"))).alias("t"))
    ranks = preds.join(own, ["idx", "target"]).groupBy("idx", "target").agg(F.sum((F.col("score") >= F.col("t")).cast("int")).alias("rank"))
    per = ranks.groupBy("target").agg((F.sum(F.try_divide(F.lit(1.0), F.col("rank"))) / (F.count("*") + F.lit(1e-6))).alias("m"))
    return per.agg((F.sum("m") / num_classes).alias("mrr"))


def relative_corruption_error(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """mce: for each type mean(1 - accuracy) / mean(reference error) over the levels present, then the mean over types.

    scores: type, level, accuracy; reference: type, level, error.
    """
    both = scores.join(reference, ["type", "level"])
    per = both.groupBy("type").agg((F.avg(1 - F.col("accuracy")) / F.avg("error")).alias("ce"))
    return per.agg(F.avg("ce").alias("mce"))


def metrics_over_tries(metrics: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """metric, mean, std (of the sample; null for one try) of rows (try, metric, value) that aren't ignored."""
    kept = metrics.where(~F.col("metric").isin(*ignore)) if ignore else metrics
    return kept.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def best_model(metrics: DataFrame, best_on_val: str | None = None) -> DataFrame:
    """The row (name, position, value) of the best value, the first by position on ties; or of the given name."""
    if best_on_val is not None:
        return metrics.where(F.col("name") == best_on_val)
    return metrics.agg(F.max_by(F.struct(*metrics.columns), F.struct("value", -F.col("position"))).alias("b")).select("b.*")


def drop_padding_rows(preds: DataFrame, order: Column | None = None) -> DataFrame:
    """Rows with a negative index go; of rows with one index the last by `order` stays."""
    held = preds.where(F.col("index") >= 0)
    last = F.struct(order if order is not None else F.lit(0), F.struct(*preds.columns))
    return held.groupBy("index").agg(F.max(last).alias("_x")).select("_x.col2.*")


def class_index(labels: DataFrame) -> DataFrame:
    """label, pos, idx, num_classes of rows (idx, label): each label's samples in order, a row each, and greatest label + 1.

    A label may be most of the rows: places come from ranges of (label, idx), not from one task a label.
    """
    most = labels.agg((F.max("label") + 1).alias("num_classes"))
    placed = numbered_by(labels.select("label", "idx"), "label", [F.col("idx")])
    return placed.crossJoin(F.broadcast(most)).select("label", F.col("turn").alias("pos"), "idx", "num_classes")  # one row


def one_hot_index(targets: DataFrame, targets_col: str = "target") -> DataFrame:
    """class_index of samples with one-hot (or multi-hot) targets (idx, target: array of 0 and 1): a sample counts under each of its classes, and
    num_classes is the targets' width. Samples of other widths than the first's fail; those without a class have no row."""
    size = targets.agg(F.min(F.size(targets_col)).alias("a"), F.max(F.size(targets_col)).alias("b")).first()
    if size["a"] != size["b"]:
        raise ValueError("targets have different widths")
    held = targets.select("idx", F.posexplode(targets_col).alias("label", "_on")).where(F.col("_on") > 0).select("idx", F.col("label").cast("long").alias("label"))
    return numbered_by(held.select("label", "idx"), "label", [F.col("idx")]).select("label", F.col("turn").alias("pos"), "idx", F.lit(size["b"] or 0).cast("long").alias("num_classes"))


def class_remap(preds: DataFrame, mapping: list[int], scores: str = "probs") -> DataFrame:
    """Scores (an array) kept and put in the order of mapping."""
    return preds.withColumn(scores, F.array(*(F.get(scores, F.lit(i)) for i in mapping)))


def complement_split(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key isn't chosen."""
    return df.join(chosen.select(key).distinct(), key, "left_anti")
