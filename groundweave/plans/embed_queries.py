"""Registered queries of embeddings and the run monitor, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groundweave.functions import geometry as G
from groundweave.operators import embed as O
from groundweave.plans.base import Registry, rounded
from groundweave.sources.shared import shared_dir
from groundweave.streaming import monitor as M

R = Registry()

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)/sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE)*y)))) AS v FROM embeddings)"
_NN = f"""{_E}, s AS (SELECT q.vec_id AS q, t.vec_id AS id, t.label, list_inner_product(q.v, t.v) AS sim FROM e q JOIN e t ON q.vec_id % 20 = 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) - 1 AS rank FROM s), k AS (SELECT * FROM n WHERE rank BETWEEN 1 AND 20)"""


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), "label", G.l2_normalize(F.col("embedding")).alias("v"))


def _neighbours(t, k: int = 20):
    v = _vectors(t)
    return O.knn_join(v.where("id % 20 = 0"), v, k, skip_first=True)


@R.query(f"WITH {_NN} SELECT q, CAST(rank AS INTEGER) AS rank, id, ROUND(sim, 6) AS sim FROM k")
def knn_join(t):
    return rounded(_neighbours(t))


@R.query(f"""WITH {_NN}, w AS (SELECT *, exp(sim/0.07) AS x FROM k), p AS (SELECT *, x/SUM(x) OVER (PARTITION BY q) AS p FROM w)
  SELECT q, v.k AS k, label, ROUND(SUM(p), 6) AS p FROM p, (VALUES (5), (20)) v(k) WHERE rank <= v.k GROUP BY q, v.k, label""")
def knn_vote(t):
    labelled = _neighbours(t).join(t("embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return rounded(O.knn_vote(labelled, (5, 20)))


@R.query(f"""WITH {_E}, s AS (SELECT a.vec_id AS i, b.vec_id AS j, ROUND(list_inner_product(a.v, b.v), 12) AS sim FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
  x AS (SELECT *, exp(sim/0.1)/SUM(exp(sim/0.1)) OVER (PARTITION BY i)*exp(sim/0.1)/SUM(exp(sim/0.1)) OVER (PARTITION BY j) AS score, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS ri, row_number() OVER (PARTITION BY j ORDER BY sim DESC, i) AS rj FROM s)
  SELECT i, j, ROUND(score, 6) AS score FROM x WHERE ri = 1 AND rj = 1 AND score > 0.0001""")
def mutual_nn_match(t):
    """Vectors of even against those of odd id, all of them."""
    v = _vectors(t)
    return rounded(O.mutual_nn_match(v.where("id % 2 = 0"), v.where("id % 2 = 1"), threshold=0.0001))


@R.query(f"""WITH {_E}, g AS (SELECT *, CASE WHEN label = 3 THEN NULL ELSE label % 4 END AS grp FROM e), s AS (SELECT a.grp, a.vec_id AS q, MAX(list_inner_product(a.v, b.v)) AS sim FROM g a JOIN g b ON a.grp IS NOT DISTINCT FROM b.grp AND a.vec_id <> b.vec_id GROUP BY 1, 2)
  SELECT grp, COUNT(*) AS n, ROUND(AVG(-ln(sqrt(GREATEST(2 - 2*sim, 0)) + 1e-8)), 4) AS spread FROM s GROUP BY grp""")
def embedding_spread_groups(t):
    grouped = _vectors(t).withColumn("grp", F.when(F.col("label") != 3, F.col("label") % 4))
    return rounded(O.embedding_spread(grouped, group="grp"), 4)


@R.query(f"""WITH {_E}, s AS (SELECT a.vec_id AS q, b.vec_id AS id, list_inner_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.vec_id % 2 = 0 AND a.label % 2 = 1 AND b.vec_id % 2 = 1)
  SELECT q, id, ROUND(sim, 5) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS r FROM s) WHERE r = 1""")
def best_match_confident(t):
    v = _vectors(t)
    a = v.where("id % 2 = 0").withColumn("conf", F.when(F.col("label") % 2 == 1, 0.9).otherwise(0.1))
    return rounded(O.best_match_confident(a, v.where("id % 2 = 1")), 5)


@R.query(f"""WITH {_E}, s AS (SELECT a.vec_id AS q, MAX(list_inner_product(a.v, b.v)) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1)
  SELECT ROUND(AVG(-ln(sqrt(GREATEST(2 - 2*sim, 0)) + 1e-8)), 4) AS spread FROM s""")
def embedding_spread(t):
    return rounded(O.embedding_spread(_vectors(t)), 4)


_SINK = "WITH q0 AS (SELECT idx AS sample, cls AS prototype, exp(score/CAST(0.5 AS DOUBLE)) AS q FROM preds_fx)"
for _i in range(3):
    _SINK += f", p{_i} AS (SELECT sample, prototype, q/SUM(q) OVER (PARTITION BY prototype)/5 AS q FROM q{_i}), q{_i + 1} AS (SELECT sample, prototype, q/SUM(q) OVER (PARTITION BY sample)/(SELECT COUNT(*) FROM customer) AS q FROM p{_i})"


@R.query(_SINK + " SELECT sample, prototype, ROUND(q*(SELECT COUNT(*) FROM customer), 6) AS q FROM q3")
def balanced_assignment(t):
    return rounded(O.balanced_assignment(t("preds_fx").select(F.col("idx").alias("sample"), F.col("cls").alias("prototype"), "score"), 0.5))


@R.query()
def feature_pca3(t):
    return O.feature_pca3(_vectors(t).select("id", "v"))


@R.query("""WITH e AS (SELECT vec_id, (vec_id % 97 + 1)*4.0 AS a, vec_id % 31 + 1 AS b, (vec_id % 7 + 1)*0.1 AS c FROM embeddings),
  v AS (SELECT vec_id*8 + k AS id, a*(1 - k % 2*2) AS x, b*(1 - k//2%2*2) AS y, c*(1 - k//4%2*2) AS z FROM e, range(8) r(k)), m AS (SELECT MAX(x) AS m FROM v)
  SELECT id, CAST(floor((x + m)*255/(2*m)) AS INTEGER) AS c0, CAST(floor((y + m)*255/(2*m)) AS INTEGER) AS c1, CAST(floor((z + m)*255/(2*m)) AS INTEGER) AS c2 FROM v, m""")
def feature_pca3_planted(t):
    """Vectors that lie evenly about 0 along three axes of falling spread: their components are what they have along these."""
    k = F.col("vec_id")
    on = lambda i: 1 - F.floor(F.col("k") / i) % 2 * 2
    parts = ((k % 97 + 1) * 4.0 * on(1), (k % 31 + 1) * on(2), (k % 7 + 1) * 0.1 * on(4))
    spread = t("embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    zero = F.lit(0.0)
    vectors = spread.select((k * 8 + F.col("k")).alias("id"), F.array(zero, parts[2].cast("double"), parts[0].cast("double"), zero, parts[1].cast("double")).alias("v"))
    return O.feature_pca3(vectors).select("id", *(F.col("c")[i].alias(f"c{i}") for i in range(3)))


@R.query()
def logreg_sweep(t):
    v = _vectors(t)
    return O.logreg_sweep(v.where("id % 5 > 1"), v.where("id % 5 = 1"), v.where("id % 5 = 0"))


@R.query("""SELECT r.rank, s.ts, COALESCE(s.current_task, 'Waiting...') AS current_task, COALESCE(s.progress, '-') AS progress, COALESCE(s.level, '-') AS level, COALESCE(s.current_step, '-') AS current_step, s.error FROM (SELECT range AS rank FROM range(10)) r
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY ts DESC, event_id DESC) AS n FROM status_fx) WHERE n = 1) s ON r.rank = s.rank""")
def latest_status(t):
    return M.with_waiting(M.latest_status(t("status_fx")), 10)


@R.query("SELECT event_id, ts, rank, current_task, progress, level, current_step, error FROM status_fx WHERE length(error) > 0")
def crash_alerts(t):
    return M.crash_alerts(t("status_fx"))


@R.query("SELECT event_id, ts, rank, current_task, progress, level, current_step, error FROM status_fx WHERE length(error) > 0 ORDER BY ts, event_id LIMIT 1")
def first_crash(t):
    return M.first_crash(t("status_fx"))


@R.query("""SELECT event_id, ts, rank, current_task, progress, level, current_step, error FROM status_fx
  WHERE (SELECT COUNT(*) FROM status_fx WHERE length(error) > 0) = 0 OR (ts, event_id) <= (SELECT (ts, event_id) FROM status_fx WHERE length(error) > 0 ORDER BY ts, event_id LIMIT 1)""")
def crash_stop(t):
    """What is written of the events as a stream that stops on its first crash."""
    stream = t.stream("status_fx")
    path = f"{shared_dir(stream.sparkSession)}/groundweave/run-{uuid.uuid4().hex}"
    M.stop_on_crash(stream, f"{path}/out", f"{path}/checkpoint")
    return stream.sparkSession.read.schema(M.STATUS).parquet(f"{path}/out/statuses/batch=*")


#: A run of quick steps: a row every 40 ms, a new task every 50 rows, and steps that change within a task.
_RUN = """SELECT event_id, make_timestamp({epoch}) AS ts, user_id % 8 AS rank, CONCAT('task ', CAST({event} AS VARCHAR(20))) AS current_task, '1/1' AS progress, '-' AS level, CONCAT('step ', CAST(user_id % 3 AS VARCHAR(20))) AS current_step, CAST(NULL AS VARCHAR) AS error FROM events"""
_FOLD = f"""WITH RECURSIVE s AS ({_RUN.format(epoch="CAST(event_id*40000 AS BIGINT)", event="event_id//50")}),
  o AS (SELECT *, row_number() OVER w AS n, lag(current_task) OVER w AS t, lag(current_step) OVER w AS p FROM s WINDOW w AS (PARTITION BY rank ORDER BY ts, event_id)),
  c AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY n) AS k, n = 1 OR t IS DISTINCT FROM current_task AS forced FROM o WHERE n = 1 OR t IS DISTINCT FROM current_task OR p IS DISTINCT FROM current_step),
  f AS (SELECT rank, k, event_id, true AS emit, ts AS at FROM c WHERE k = 1
    UNION ALL SELECT c.rank, c.k, c.event_id, c.forced OR epoch_us(c.ts) - epoch_us(f.at) > 100000, CASE WHEN c.forced OR epoch_us(c.ts) - epoch_us(f.at) > 100000 THEN c.ts ELSE f.at END FROM f JOIN c ON c.rank = f.rank AND c.k = f.k + 1)
  SELECT s.event_id, s.ts, s.rank, current_task, progress, level, current_step, error FROM f JOIN s USING (event_id) WHERE emit"""


def _run(events):
    step = F.concat(F.lit("step "), (F.col("user_id") % 3).cast("string"))
    task = F.concat(F.lit("task "), F.floor(F.col("event_id") / 50).cast("string"))
    return events.select("event_id", F.timestamp_micros((F.col("event_id") * 40000).cast("long")).alias("ts"), (F.col("user_id") % 8).alias("rank"), task.alias("current_task"), F.lit("1/1").alias("progress"), F.lit("-").alias("level"), step.alias("current_step"), F.lit(None).cast("string").alias("error"))


@R.query(_FOLD)
def status_changes(t):
    """The events as a stream of statuses: changes with the gap of a tenth of a second."""
    stream = _run(t.stream("events"))
    path = f"{shared_dir(stream.sparkSession)}/groundweave/run-{uuid.uuid4().hex}"
    M.follow_changes(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(M.STATUS).parquet(f"{path}/out/changes/batch=*")


@R.query(_FOLD)
def status_changes_batch(t):
    """The same at once, by ranges."""
    return M.status_changes_batch(_run(t("events")))
