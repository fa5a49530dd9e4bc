"""Tables derived from the given ones by arithmetic that reads the same in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

FIXTURES = {
    "scenes_fx": """
        SELECT c_custkey AS scene_id, CAST((c_custkey*37) % 499 AS DOUBLE)*CAST(50 AS DOUBLE) AS x0,
               CAST((c_custkey*61) % 491 AS DOUBLE)*CAST(50 AS DOUBLE) AS y0,
               CAST(900 + (c_custkey % 7)*150 AS DOUBLE) AS w, CAST(900 + (c_custkey % 5)*150 AS DOUBLE) AS h FROM {customer}""",
    "tie_obs_fx": """
        SELECT l_orderkey AS tie_id, CAST(l_linenumber AS BIGINT) AS img, MIN(l_quantity) AS line,
               MIN(l_extendedprice)/CAST(1000 AS DOUBLE) AS samp, MIN(l_discount)*CAST(1000 AS DOUBLE) AS height,
               MIN(l_tax)*CAST(100 AS DOUBLE) AS err FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "pair_err_fx": """
        SELECT a.img AS i, b.img AS j, a.tie_id AS tie_id,
               SQRT((a.err-b.err)*(a.err-b.err) + (a.height-b.height)*(a.height-b.height)/CAST(400 AS DOUBLE)) AS d
        FROM {tie_obs_fx} a JOIN {tie_obs_fx} b ON a.tie_id=b.tie_id AND a.img<b.img""",
    "cells_fx": """
        SELECT CAST(0 AS BIGINT) AS grid_id, CAST(FLOOR(p_partkey/CAST(50 AS DOUBLE)) AS BIGINT) AS r, p_partkey % 50 AS c,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice - CAST(900 AS DOUBLE) END AS v,
               CAST(p_size AS DOUBLE)/CAST(50 AS DOUBLE) AS conf FROM {part}""",
    "matches_fx": """
        SELECT l_orderkey % 32 AS group_id, l_partkey % 3 AS img_a,
               (l_partkey % 3) + 1 + (l_suppkey % (3 - (l_partkey % 3))) AS img_b,
               l_quantity*CAST(0.5 AS DOUBLE) AS xa, l_discount*CAST(250 AS DOUBLE) AS ya,
               l_quantity*CAST(0.5 AS DOUBLE)+l_tax*CAST(50 AS DOUBLE)-CAST(1 AS DOUBLE) AS xb,
               l_discount*CAST(250 AS DOUBLE)+CAST(l_linenumber AS DOUBLE)*CAST(0.25 AS DOUBLE) AS yb FROM {lineitem}""",
    "status_fx": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id % 8 AS rank, event_type AS current_task,
               CONCAT(CAST(event_id % 3 AS VARCHAR(20)), '/3') AS progress, CASE WHEN event_type='error' THEN 'high' ELSE '-' END AS level,
               CONCAT('step ', CAST(user_id % 3 AS VARCHAR(20))) AS current_step,
               CASE WHEN event_type='error' AND event_id % 97 = 0 THEN CONCAT('E', CAST(event_id AS VARCHAR(20))) ELSE NULL END AS error
        FROM {events}""",
    "metric_fx": "SELECT event_type AS metric, event_id AS step, value FROM {events}",
    "class_fx": "SELECT c_custkey AS idx, CAST(c_nationkey AS BIGINT) AS label, (c_custkey*40503) % 7 AS grp FROM {customer}",
    "preds_fx": """
        SELECT c.c_custkey AS idx, CAST(c.c_nationkey % 5 AS BIGINT) AS target, CAST(k.cls AS BIGINT) AS cls,
               CAST((c.c_custkey*(k.cls+3)*7919) % 101 AS DOUBLE)/CAST(101 AS DOUBLE) AS score
        FROM {customer} c CROSS JOIN (SELECT n_nationkey AS cls FROM {nation} WHERE n_nationkey < 5) k""",
    "fit_fx": """
        SELECT l_suppkey % 16 AS pair_id, l_quantity AS sx, l_discount*CAST(100 AS DOUBLE) AS sy,
               l_quantity*CAST(1.01 AS DOUBLE)+l_discount*CAST(2 AS DOUBLE)+CAST(3 AS DOUBLE)+l_tax AS dx,
               l_discount*CAST(99 AS DOUBLE)-l_quantity*CAST(0.02 AS DOUBLE)-CAST(5 AS DOUBLE)+l_tax AS dy,
               l_tax*CAST(100 AS DOUBLE) AS wgt FROM {lineitem}""",
    "hash_fx": "SELECT doc_id, source, (doc_id*2654435761 + 7*40503) % 4294967296 AS h FROM {documents}",
}


def fixture(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A given or derived table as a DataFrame, or as a stream of the given table's files."""
    if name not in FIXTURES:
        given = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spark.readStream.schema(given.schema).parquet(f"{sf_dir}/{name}.parquet*") if stream else given
    text = FIXTURES[name]
    used = [n for n in (*GIVEN, *FIXTURES) if "{" + n + "}" in text]
    return spark.sql(text, **{n: fixture(spark, sf_dir, n, stream) for n in used})


def with_fixtures(body: str) -> str:
    """DuckDB text with the derived tables that body names, as common table expressions in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in FIXTURES:
            if n in text and n not in needed and not (text is FIXTURES.get(n)):
                need(FIXTURES[n])
                needed.append(n)

    need(body)
    parts = [f"{n} AS ({FIXTURES[n].replace('{', '').replace('}', '')})" for n in needed]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]]) if parts else body
    return f"WITH {', '.join(parts)} {body}" if parts else body
