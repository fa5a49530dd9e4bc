"""Registered queries of metrics and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundweave.operators import metrics as M
from groundweave.plans.base import Registry, rounded

R = Registry()

_REPORT = """COUNT(*) AS count, ROUND(AVG(d), 6) AS mean, ROUND(quantile_cont(d, 0.5), 6) AS median, ROUND(MAX(d), 6) AS max,
  ROUND(SQRT(AVG(d*d)), 6) AS rmse, ROUND(100.0*AVG(CASE WHEN d < 1 THEN 1.0 ELSE 0.0 END), 6) AS lt1_percent,
  ROUND(100.0*AVG(CASE WHEN d < 3 THEN 1.0 ELSE 0.0 END), 6) AS lt3_percent, ROUND(100.0*AVG(CASE WHEN d < 5 THEN 1.0 ELSE 0.0 END), 6) AS lt5_percent"""

_RANKED = "SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, cls) AS rank FROM preds_fx"


@R.query(f"SELECT {_REPORT} FROM pair_err_fx")
def error_report(t):
    return rounded(M.error_report(t("pair_err_fx")))


@R.query(f"SELECT i, j, GROUPING(i, j) > 0 AS is_overall, {_REPORT} FROM pair_err_fx GROUP BY GROUPING SETS ((i, j), ())")
def error_report_by_pair(t):
    return rounded(M.error_report(t("pair_err_fx"), by=("i", "j")))


@R.query("SELECT ROUND(AVG(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy1, ROUND(AVG(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy3 FROM (SELECT idx, MIN(CASE WHEN cls = target THEN rank END) AS r FROM (" + _RANKED + ") GROUP BY idx)")
def topk_accuracy(t):
    return rounded(M.topk_accuracy(t("preds_fx"), (1, 3)))


@R.query("SELECT ROUND(AVG(a1), 6) AS recall1, ROUND(AVG(a3), 6) AS recall3 FROM (SELECT target, AVG(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END) AS a1, AVG(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END) AS a3 FROM (SELECT idx, target, MIN(CASE WHEN cls = target THEN rank END) AS r FROM (" + _RANKED + ") GROUP BY idx, target) GROUP BY target)")
def topk_recall(t):
    return rounded(M.topk_recall(t("preds_fx"), (1, 3)))


@R.query("SELECT cls, ROUND(2.0*SUM(CASE WHEN rank = 1 AND cls = target THEN 1 ELSE 0 END)/(SUM(CASE WHEN rank = 1 THEN 1 ELSE 0 END)+SUM(CASE WHEN cls = target THEN 1 ELSE 0 END)), 6) AS f1 FROM (" + _RANKED + ") GROUP BY cls")
def f1_scores(t):
    return rounded(M.f1_scores(M.multiclass_outcomes(t("preds_fx")), "none"))


@R.query("""WITH l AS (SELECT 'quality' AS cls, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted, quality AS actual FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT 'toxic', CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END, toxic FROM labels JOIN documents USING (doc_id))
  SELECT ROUND(2.0*SUM(predicted*actual)/(SUM(predicted)+SUM(actual)), 6) AS f1 FROM l""")
def f1_multilabel(t):
    both = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    long = [both.select(F.lit(c).alias("cls"), p.cast("int").alias("predicted"), F.col(c).alias("actual")) for c, p in (("quality", F.col("n_chars") > 1000), ("toxic", F.col("n_chars") % 7 == 0))]
    return rounded(M.f1_scores(long[0].unionByName(long[1]), "micro"))


@R.query("""SELECT a.cls, ROUND(SUM(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)/COUNT(*), 6) AS auroc
  FROM (SELECT cls, score, COUNT(*) FROM preds_fx WHERE cls = target GROUP BY cls, score, idx) a JOIN (SELECT cls, score, idx FROM preds_fx WHERE cls <> target) b ON a.cls = b.cls GROUP BY a.cls""")
def auroc(t):
    return rounded(M.auroc(t("preds_fx")))


_STEPS = """g AS (SELECT cls, score, SUM(actual) AS pos, COUNT(*) AS n FROM (SELECT cls, score, CASE WHEN cls = target THEN 1 ELSE 0 END AS actual FROM preds_fx) GROUP BY cls, score),
  s AS (SELECT cls, pos, SUM(pos) OVER w AS tp, SUM(n) OVER w AS seen, SUM(pos) OVER (PARTITION BY cls) AS total FROM g WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@R.query(f"WITH {_STEPS} SELECT cls, ROUND(SUM(pos*1.0*tp/seen)/MAX(total), 6) AS ap FROM s GROUP BY cls")
def average_precision(t):
    return rounded(M.average_precision(_actual(t)))


@R.query(f"WITH {_STEPS} SELECT cls, ROUND((" + " + ".join(f"COALESCE(MAX(CASE WHEN tp/total >= {i / 10} THEN tp*1.0/seen END), 0)" for i in range(11)) + ")/11, 6) AS ap FROM s GROUP BY cls")
def average_precision_voc(t):
    return rounded(M.average_precision(_actual(t), "voc2007"))


def _actual(t):
    return t("preds_fx").select("cls", "score", (F.col("cls") == F.col("target")).cast("int").alias("actual"))


@R.query("WITH h AS (SELECT p.idx, c.grp, MAX(CASE WHEN p.cls = p.target OR p.cls = (p.idx % 7) THEN 1.0 ELSE 0.0 END) AS hit FROM (" + _RANKED + ") p JOIN class_fx c ON p.idx = c.idx WHERE p.rank <= 2 GROUP BY p.idx, c.grp) SELECT grp, ROUND(AVG(hit), 6) AS accuracy FROM h GROUP BY GROUPING SETS ((grp), ())")
def any_match_accuracy(t):
    targets = t("class_fx").select("idx", "grp", F.array((F.col("label") % 5).cast("long"), (F.col("idx") % 7).cast("long"), F.lit(-1).cast("long")).alias("targets"))
    return rounded(M.any_match_accuracy(t("preds_fx"), targets, 2, ("grp",)))


@R.query("""WITH o AS (SELECT idx, target, MAX(CASE WHEN cls = target THEN score END) AS ts FROM preds_fx GROUP BY idx, target),
  r AS (SELECT p.idx, p.target, SUM(CASE WHEN p.score >= o.ts THEN 1 ELSE 0 END) AS rank FROM preds_fx p JOIN o ON p.idx = o.idx GROUP BY p.idx, p.target)
  SELECT ROUND(SUM(m)/5, 6) AS mrr FROM (SELECT SUM(1.0/rank)/(COUNT(*)+1e-6) AS m FROM r GROUP BY target)""")
def macro_mrr(t):
    return rounded(M.macro_mrr(t("preds_fx"), 5))


@R.query("""WITH s AS (SELECT event_type AS type, user_id % 5 AS level, AVG(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS accuracy FROM events GROUP BY 1, 2)
  SELECT ROUND(AVG(ce), 6) AS mce FROM (SELECT type, AVG(1-accuracy)/AVG(0.5+level/10.0) AS ce FROM s GROUP BY type)""")
def relative_corruption_error(t):
    scores = t("events").groupBy(F.col("event_type").alias("type"), (F.col("user_id") % 5).alias("level")).agg(F.avg((F.col("event_id") % 3 == 0).cast("double")).alias("accuracy"))
    reference = t("events").select(F.col("event_type").alias("type")).distinct().select("type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("level")).withColumn("error", 0.5 + F.col("level") / 10)
    return rounded(M.relative_corruption_error(scores, reference))


@R.query("SELECT metric, ROUND(AVG(v), 6) AS mean, ROUND(stddev_samp(v), 6) AS std FROM (SELECT metric, step % 5 AS try, AVG(value) AS v FROM metric_fx WHERE metric <> 'error' GROUP BY 1, 2) GROUP BY metric")
def metrics_over_tries(t):
    tries = t("metric_fx").groupBy("metric", (F.col("step") % 5).alias("try")).agg(F.avg("value").alias("value"))
    return rounded(M.metrics_over_tries(tries, ("error",)))


@R.query("SELECT metric AS name, position, ROUND(v, 6) AS value FROM (SELECT metric, MIN(step) AS position, AVG(value) AS v FROM metric_fx GROUP BY metric) ORDER BY v DESC, position LIMIT 1")
def best_model(t):
    models = t("metric_fx").groupBy(F.col("metric").alias("name")).agg(F.min("step").alias("position"), F.avg("value").alias("value"))
    return rounded(M.best_model(models))


@R.query("SELECT idx % 997 - 5 AS index, MAX(idx) AS idx FROM class_fx WHERE idx % 997 - 5 >= 0 GROUP BY 1")
def drop_padding_rows(t):
    return M.drop_padding_rows(t("class_fx").select((F.col("idx") % 997 - 5).alias("index"), "idx"), F.col("idx"))


@R.query("SELECT label, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS pos, idx, (SELECT MAX(label) + 1 FROM class_fx) AS num_classes FROM class_fx")
def class_index(t):
    return M.class_index(t("class_fx").select("idx", "label"))


@R.query("""WITH l AS (SELECT idx, cls AS label FROM preds_fx WHERE score > 0.5)
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS pos, idx, CAST(5 AS BIGINT) AS num_classes FROM l""")
def one_hot_index(t):
    """Samples whose targets are the classes of high score."""
    target = F.transform(F.sort_array(F.collect_list(F.struct("cls", "score"))), lambda x: (x["score"] > 0.5).cast("int"))
    return M.one_hot_index(t("preds_fx").groupBy("idx").agg(target.alias("target")))


@R.query("SELECT idx, MAX(CASE WHEN cls = 3 THEN score END) AS p0, MAX(CASE WHEN cls = 1 THEN score END) AS p1 FROM preds_fx GROUP BY idx")
def class_remap(t):
    wide = t("preds_fx").groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("cls", "score"))), lambda x: x["score"]).alias("probs"))
    return M.class_remap(wide, [3, 1]).select("idx", F.col("probs")[0].alias("p0"), F.col("probs")[1].alias("p1"))


@R.query("SELECT idx, label FROM class_fx WHERE idx NOT IN (SELECT idx FROM class_fx WHERE label % 3 = 0)")
def complement_split(t):
    return M.complement_split(t("class_fx").select("idx", "label"), t("class_fx").where("label % 3 = 0"), "idx")
