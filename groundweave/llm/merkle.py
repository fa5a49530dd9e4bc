"""Operator 11, a Merkle manifest of a dataset by a rollup of nested structs.

Leaves are numbered within their tree, and the number falls into octal digits. Blocks of 512 leaves are the bounded unit: within one, the last
digit is grouped away first, then the next, each group keeping its children nested in it, so that a block is one row
that holds its three lowest levels. One transform over the nested children and one explode then give every leaf with its siblings, with
no join. The blocks' own hashes are the leaves of the next, 512 times smaller table, worked off in the same way up to one block a tree; a block meets
its siblings above by one join of block rows, not of leaves. The subroots of all trees are the leaves of a last tree.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.llm.common import discard, table, written
from groundweave.operators.sampling import numbered

FAN, DEPTH = 8, 3
WIDTH = FAN**DEPTH
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """H of the fields, each `-` if null, else its UTF-8 byte count, `:` and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _hashes(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["hash"]), "")


def _siblings(kids: Column, at: Column) -> Column:
    """What stands left and right of the child with digit `at` in its run."""
    return F.struct(_hashes(F.filter(kids, lambda k: k["d"] < at)).alias("left"), _hashes(F.filter(kids, lambda k: k["d"] > at)).alias("right"))


def paths(nodes: DataFrame, payload: tuple[str, ...] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """tree, rank, hash, payload, path (left and right siblings of each level, lowest first) and top, the hash of its tree's root, of each node; and
    the tables that the result reads.

    nodes: tree (long), rank (from 0, without gaps in a tree), size (nodes of the tree), hash, and the payload's columns.
    A tree of one node is its own root and has an empty path.
    """
    digit = lambda i: F.floor(F.col("rank") / FAN**i) % FAN
    block = F.floor(F.col("rank") / WIDTH).alias("block")
    at = nodes.select("tree", "size", block, *(digit(i).cast("int").alias(f"d{i}") for i in range(DEPTH)), "hash", F.struct("rank", *payload).alias("own"))
    level = at.repartition("tree", "block").select("tree", "size", "block", *(f"d{i}" for i in range(1, DEPTH)), F.struct(F.col("d0").alias("d"), "hash", "own").alias("kid"))
    for i in range(DEPTH):
        left = [f"d{k}" for k in range(i + 1, DEPTH)]
        runs = level.groupBy("tree", "size", "block", *left).agg(F.sort_array(F.collect_list("kid")).alias("kids"))  # of 8 at most
        up = F.when(F.col("size") > FAN**i, F.sha2(_hashes(F.col("kids")), 256)).otherwise(F.col("kids")[0]["hash"])
        runs = runs.withColumn("hash", up)
        level = runs if i == DEPTH - 1 else runs.select("tree", "size", "block", *left[1:], F.struct(F.col(left[0]).alias("d"), "hash", "kids").alias("kid"))
    blocks = written(level, "merkle-blocks")
    held = [blocks]

    levels = F.when(F.col("size") <= 1, 0)
    for i in range(1, DEPTH):
        levels = levels.when(F.col("size") <= FAN**i, i)
    levels = levels.otherwise(DEPTH)

    def leaves(kids: Column, above: list[Column], depth: int) -> Column:
        def one(kid: Column) -> Column:
            path = [_siblings(kids, kid["d"]), *above]
            if depth:
                return leaves(kid["kids"], path, depth - 1)
            return F.array(F.struct(kid["own"].alias("own"), kid["hash"].alias("hash"), F.slice(F.array(*path), 1, levels).alias("path")))

        return F.flatten(F.transform(kids, one))

    apart = blocks.select("tree", "block", "size", F.col("hash").alias("top"), leaves(F.col("kids"), [], DEPTH - 1).alias("leaves"))
    if blocks.where(F.col("block") > 0).isEmpty():
        met = apart.withColumn("upper", F.array().cast("array<struct<left:string,right:string>>"))
    else:
        above = blocks.select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / WIDTH).alias("size"), "hash")
        higher, more = paths(above)
        held += more
        met = apart.drop("top").join(higher.select("tree", F.col("rank").alias("block"), F.col("path").alias("upper"), "top"), ["tree", "block"])
    out = met.select("tree", "top", "upper", F.explode("leaves").alias("l"))
    return out.select("tree", "l.own.*", "l.hash", F.concat("l.path", "upper").alias("path"), "top"), held


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def manifest(df: DataFrame, tree_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of df: id_col, leaf, subroot, root, path, tampered_leaf (null without tampering), folded_root, verified.

    A tree for each value of tree_col (null is one, before all others), its leaves in ascending order of id_col (null first; rows of one id
    by their leaf, so repeated rows are leaves side by side); the subroots in order are the leaves of the last tree. Null
    fields are `-`, so a null text differs from an empty one. tampered gives fields as they are found later (null: as
    they were; fields that were null stay so); what it changes is folded anew with the original siblings. An empty table gives no rows; columns that
    aren't fields don't matter, whatever their names. Only hashes are numbered and shuffled, never texts.
    """
    found = tampered or {}
    base = df.select(*(F.col(f"`{c}`").alias(f"_f{i}") for i, c in enumerate(fields)), F.col(f"`{tree_col}`").alias("_tree"), F.col(f"`{id_col}`").alias("_id"), *(to.alias(f"_t{fields.index(c)}") for c, to in found.items()))
    plain = [F.col(f"_f{i}") for i in range(len(fields))]
    later = [F.when(F.col(f"_f{i}").isNotNull(), F.coalesce(f"_t{i}", f"_f{i}")) if c in found else F.col(f"_f{i}") for i, c in enumerate(fields)]
    differs = reduce(or_, (F.col(f"_t{fields.index(c)}") != F.col(f"_f{fields.index(c)}") for c in found), F.lit(False))
    thin = written(base.select("_tree", "_id", leaf_hash(*plain).alias("hash"), F.when(differs, leaf_hash(*later)).alias("_tampered")), "merkle-hashes")
    order = [F.col("_tree").asc_nulls_first(), F.col("_id").asc_nulls_first(), F.col("hash")]
    placed = numbered(thin, order, "_rn")
    places = written(placed, "merkle-leaves")
    discard(placed, thin)
    counts = places.groupBy("_tree").agg(F.min("_rn").alias("_first"), F.count("*").alias("size"))
    firsts = numbered(counts, [F.col("_tree").asc_nulls_first()], "tree")
    trees = written(firsts.withColumnRenamed("_tree", "_of"), "merkle-trees")
    discard(firsts)
    nodes = places.join(trees, F.col("_tree").eqNullSafe(F.col("_of"))).withColumn("rank", F.col("_rn") - F.col("_first"))
    leaves, held = paths(nodes.select("tree", "rank", "size", "hash", "_id", "_tampered"), ("_id", "_tampered"))
    n = trees.count()
    tops = held[-1].where("block = 0").select("tree", "hash")  # the uppermost table has one block a tree
    last, more = paths(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(n).cast("long").alias("size"), "hash"))
    roots = written(last.select(F.col("rank").alias("_at"), F.col("path").alias("_last"), F.col("top").alias("root")), "merkle-roots")
    discard(places, *more)
    met = leaves.join(roots, F.col("tree") == F.col("_at")).withColumn("path", F.concat("path", "_last"))
    folded = fold(F.coalesce("_tampered", "hash"), F.col("path"))
    out = met.select(F.col("_id").alias(id_col), F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "root", "path", F.col("_tampered").alias("tampered_leaf"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language; where 3 divides the CRC-32 of the id, texts come back with A-Z in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    upper = "".join(map(chr, range(65, 91)))
    lower = F.when(hit, F.translate("text", upper, upper.lower()))
    got = manifest(table(spark, sf_dir, "documents"), tampered={"text": lower})
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    return got.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


#: CRC-32 of a string column: its table of 256 remainders, and the fold over the bytes.
CRC_TABLE = """(SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(i)))"""


def crc_sql(text: str) -> str:
    """CRC-32 of a string expression in DuckDB, where crc (of CRC_TABLE) is in scope."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda k: {byte})), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


_LEAF = " || ".join(_field(c) for c in FIELDS)
_TAMPERED = " || ".join(_field("found" if c == "text" else c) for c in FIELDS)

#: Level by level by recursion; each leaf then climbs, taking its run's other members along. Trees are numbered, the last one is -1.
OP11_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED {CRC_TABLE},
found AS (
    SELECT d.*, CASE WHEN {crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS found FROM documents d, crc),
leaves AS MATERIALIZED (
    SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i,
           sha256({_LEAF}) AS h, sha256({_TAMPERED}) AS t FROM found),
nodes AS (
    SELECT tree, 0 AS level, i, h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
    UNION ALL
    SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, i // 8),
tops AS MATERIALIZED (SELECT tree, h FROM nodes WHERE n = 1),
last AS (
    SELECT 0 AS level, tree AS i, h, count(*) OVER () AS n FROM tops
    UNION ALL
    SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM last WHERE n > 1 GROUP BY level, i // 8),
every AS MATERIALIZED (SELECT tree, level, i, h, n FROM nodes UNION ALL SELECT -1, level, i, h, n FROM last),
climbed AS (
    SELECT doc_id, tree AS own, tree, 0 AS level, i, t, '' AS proof, false AS over FROM leaves
    UNION ALL
    SELECT c.doc_id, any_value(c.own), CASE WHEN any_value(e.n) > 1 THEN c.tree ELSE -1 END, CASE WHEN any_value(e.n) > 1 THEN any_value(c.level) + 1 ELSE 0 END,
           CASE WHEN any_value(e.n) > 1 THEN c.i // 8 ELSE c.tree END,
           CASE WHEN any_value(e.n) > 1 THEN sha256(string_agg(CASE WHEN e.i = c.i THEN c.t ELSE e.h END, '' ORDER BY e.i)) ELSE any_value(c.t) END,
           any_value(c.proof) || coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (WHERE e.i <> c.i), ''), c.tree = -1 AND any_value(e.n) = 1
    FROM climbed c JOIN every e ON e.tree = c.tree AND e.level = c.level AND e.i // 8 = c.i // 8 WHERE NOT c.over GROUP BY c.doc_id, c.tree, c.i)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.t AS folded_root, c.t = r.h AS verified
FROM climbed c JOIN leaves l USING (doc_id) JOIN tops s ON s.tree = l.tree CROSS JOIN (SELECT h FROM last WHERE n = 1) r WHERE c.over
"""
