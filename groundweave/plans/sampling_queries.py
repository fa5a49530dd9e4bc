"""Registered queries of samples, splits and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundweave.operators import sampling as O
from groundweave.plans.base import Registry, rounded

R = Registry()

_H = "(({0})*2654435761 + CAST({1} AS BIGINT)*40503) % 4294967296"


@R.query(f"SELECT idx AS group_id FROM class_fx ORDER BY {_H.format('idx', 42)}, idx LIMIT 100")
def sample_groups(t):
    return O.sample_groups(t("class_fx").select(F.col("idx").alias("group_id")), 100)


@R.query(f"""WITH x AS (SELECT k.try, idx, label, row_number() OVER (PARTITION BY k.try, label ORDER BY {_H.format('idx', 'k.try')}, idx) AS r, COUNT(*) OVER (PARTITION BY k.try, label) AS n FROM class_fx, (VALUES (0), (1), (2)) k(try))
  SELECT try, idx, label FROM x WHERE r <= GREATEST(floor(n*CAST(0.1 AS DOUBLE)), 1)""")
def few_shot_subset(t):
    return O.few_shot_subset(t("class_fx").select("idx", "label"), 0.1, 3)


@R.query(f"""WITH l AS (SELECT idx, label FROM class_fx UNION SELECT idx, (label + 1 + idx % 3) % 25 FROM class_fx),
  x AS (SELECT k.try, idx, label, row_number() OVER (PARTITION BY k.try, label ORDER BY {_H.format('idx', 'k.try')}, idx) AS r, COUNT(*) OVER (PARTITION BY k.try, label) AS n FROM l, (VALUES (0), (1), (2)) k(try)),
  f AS (SELECT DISTINCT try, idx FROM x WHERE r <= GREATEST(floor(n*CAST(0.1 AS DOUBLE)), 1)),
  s AS (SELECT f.try, CAST(0.1 AS DOUBLE)/(COUNT(*)/floor((SELECT COUNT(*) FROM l)*CAST(0.1 AS DOUBLE))) AS share FROM f JOIN l USING (idx) GROUP BY f.try)
  SELECT DISTINCT x.try, idx FROM x JOIN s USING (try) WHERE r <= GREATEST(floor(n*share), 1)""")
def few_shot_multilabel(t):
    """Samples of two labels each."""
    own = t("class_fx").select("idx", "label")
    return O.few_shot_multilabel(own.union(own.select("idx", ((F.col("label") + 1 + F.col("idx") % 3) % 25).alias("label"))), 0.1, 3)


@R.query(f"""WITH x AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY {_H.format('idx', 0)}, idx) AS r, COUNT(*) OVER (PARTITION BY label) AS n FROM class_fx)
  SELECT idx, label, r <= CASE WHEN n > 1 THEN GREATEST(floor(n*CAST(0.1 AS DOUBLE)), 1) ELSE 0 END AS is_val FROM x""")
def train_val_split(t):
    return O.train_val_split(t("class_fx").select("idx", "label"))


@R.query(f"""WITH n AS (SELECT COUNT(*) AS n FROM class_fx), x AS (SELECT idx AS id, k.turn, row_number() OVER (ORDER BY {_H.format('idx + k.turn*n.n', 3)}, idx, k.turn) - 1 AS pos FROM class_fx, n, (VALUES (0), (1)) k(turn))
  SELECT pos, id FROM x, n WHERE pos < n.n + n.n // 2 AND pos % 4 = 1 AND pos // 4 >= 10""")
def epoch_shard(t):
    ids = t("class_fx").select(F.col("idx").alias("id"))
    n = ids.count()
    return O.epoch_shard(ids, n + n // 2, 3, 1, 4, advance=10)


@R.query(f"""WITH d AS (SELECT draw, CASE WHEN u < 0.5 THEN 'src1' WHEN u < 0.75 THEN 'src2' WHEN u < 1.0 THEN 'src3' END AS source FROM (SELECT range AS draw, ({_H.format('range', 65537)})/4294967296.0 AS u FROM range(2000))),
  dn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw) AS k FROM d),
  s AS (SELECT source, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY {_H.format('doc_id', 65537)}, doc_id) AS k FROM documents WHERE source IN ('src1', 'src2', 'src3')),
  m AS (SELECT dn.draw, dn.source, s.id FROM dn LEFT JOIN s ON dn.source = s.source AND dn.k = s.k)
  SELECT draw, source, id FROM m WHERE draw < COALESCE((SELECT MIN(draw) FROM m WHERE id IS NULL), 1000000000)""")
def mixture_sample(t):
    return O.mixture_sample(t("documents").select(F.col("doc_id").alias("id"), "source"), {"src1": 2.0, "src2": 1.0, "src3": 1.0}, 2000)


@R.query(f"""WITH x AS (SELECT idx AS group_id, grp + 2 AS n, ({_H.format('idx + 30000', 1)}) % (grp + 2) AS a, ({_H.format('idx + 30000', 2)}) % (grp + 2) AS b FROM class_fx)
  SELECT group_id, a, CASE WHEN a = b THEN (a + 1) % n ELSE b END AS b FROM x""")
def training_pair_draw(t):
    return O.training_pair_draw(t("class_fx").select(F.col("idx").alias("group_id"), (F.col("grp") + 2).alias("n")), 3)


@R.query("SELECT pair_id, window_id, score FROM (SELECT scene_id % 16 AS pair_id, scene_id AS window_id, w AS score, row_number() OVER (PARTITION BY scene_id % 16 ORDER BY w DESC, scene_id) AS r FROM scenes_fx) WHERE r <= 10")
def cap_windows(t):
    return O.cap_windows(t("scenes_fx").select((F.col("scene_id") % 16).alias("pair_id"), F.col("scene_id").alias("window_id"), F.col("w").alias("score")), 10)


@R.query("SELECT window_id, group_id FROM (SELECT scene_id AS window_id, row_number() OVER (ORDER BY scene_id) + (SELECT MAX(TRY_CAST(CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE CAST(s_suppkey AS VARCHAR) END AS BIGINT)) FROM supplier) AS group_id, row_number() OVER (ORDER BY scene_id) AS r FROM scenes_fx WHERE scene_id % 5 <> 0) WHERE r <= 500")
def assign_group_ids(t):
    windows = t("scenes_fx").select(F.col("scene_id").alias("window_id"), (F.col("scene_id") % 5 == 0).alias("skipped"))
    existing = t("supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(F.col("s_suppkey").cast("string")).alias("name"))
    return O.assign_group_ids(windows, existing, 500).select("window_id", "group_id")


@R.query("""SELECT metric, step, ROUND((list_sort(list(value) OVER w)[CAST(floor((len(list(value) OVER w)-1)/2) AS INTEGER)+1]) + 1e-9, 6) AS median, ROUND(AVG(value) OVER w + 1e-9, 6) AS avg, ROUND(AVG(value) OVER g + 1e-9, 6) AS global_avg
  FROM metric_fx WINDOW w AS (PARTITION BY metric ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY metric ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def smoothed_metric(t):
    # Means of 2 ** k values end in exact halves; a shift keeps both engines on one side.
    return rounded(O.smoothed_metric(t("metric_fx")).select("metric", "step", *((F.col(c) + 1e-9).alias(c) for c in ("median", "avg", "global_avg"))))
