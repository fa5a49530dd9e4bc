"""From raw documents to packed training sequences: language, near duplicates, repeated strings, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Stage by stage the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.llm.common import let_go, table, text_batches, written
from groundweave.llm.jaccard import shingle_components
from groundweave.llm.langid import fit, held_out, identify
from groundweave.llm.packing import packed_documents
from groundweave.llm.repeats import PASSAGE, without_repeats
from groundweave.operators.sampling import numbered

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its best language has less than this share of the probability, or needs more bits for a byte.
LEAST_SCORE, MOST_BITS = 0.5, 7.5
#: Texts of fewer bytes are judged by score alone, as the first bytes of any text cost much.
LEAST_BYTES = 64


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, torn between languages or unlike any go."""
    text_batches(spark)
    let_go()
    got = identify(docs, fit(docs.where(~held_out())), keep=COLUMNS)
    likely = (F.octet_length("text") < LEAST_BYTES) | (F.col("bits_per_byte") <= MOST_BITS)
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & likely).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a number _key, the same in rows that are equal in id and text only, and in the order of ids, null last:
    the id where every id stands for one text, else the place among the distinct rows."""
    own = F.xxhash64("text")
    odd = docs.groupBy("doc_id").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("doc_id is null or a <> b")
    if odd.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    hashed = docs.withColumn("_hash", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    places = numbered(hashed.select("doc_id", "_hash").distinct(), [F.col("doc_id").asc_nulls_last(), F.col("_hash")], "_key").withColumnsRenamed({"doc_id": "_id", "_hash": "_own"})
    return written(hashed.join(places, hashed["doc_id"].eqNullSafe(places["_id"]) & (hashed["_hash"] == places["_own"])).select(*COLUMNS, "_key"), "keyed")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id, null last. Rows that are equal in id and text
    count once; different texts under one id, or without one, are documents of their own."""
    text_batches(spark)
    let_go()
    keyed = _keyed(docs)
    stay = shingle_components(keyed, id_col="_key").where("component_id = _key").select(F.col("_key").alias("_stay")).distinct()
    return keyed.join(stay, keyed["_key"] == stay["_stay"], "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of PASSAGE that occur more than once; what is left is cut to whole characters.
    A document of repeated strings alone stays, with an empty text."""
    text_batches(spark)
    rest = without_repeats(docs, PASSAGE, characters=True, keep=("lang", "source"))
    return rest.select("doc_id", F.col("kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    return packed_documents(spark, docs)


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_near_duplicates),
    ("repeated strings", without_repeated_strings),
    ("packing", packed),
]

#: No stage but the second half of the last has a form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
