"""Operator 6, chat formatting: schema fingerprints choose how a record's layout becomes canonical turns.

A record's layout is the sorted list of its nested field paths that hold a value; the hash of that list selects a
declarative mapping, a list of turns each of a role (fixed or a path) and a text path, or one array of messages. All of it
is DataFrame expressions. In the formatted text every turn is `<turn>role`, a line end, the text, `</turn>` and a line
end. Texts and roles write a backslash as `\\s` and `<` as `\\l` (roles also a line end as `\\n`), so no marker can stand
inside a turn and reading back gives the same characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundweave.llm.common import table

OPEN, CLOSE = "<turn>", "</turn>\n"


@dataclass(frozen=True)
class Mapping:
    """How records whose present paths are exactly `paths` become turns.

    turns: (fixed role, text path) in order; or messages: (array path, role field, text field).
    """

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None


#: Layouts that are known: fixed values.
MAPPINGS = (
    Mapping(("messages.content", "messages.role"), messages=("messages", "role", "content")),
    Mapping(("conversations.from", "conversations.value"), messages=("conversations", "from", "value")),
    Mapping(("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("context.system", "instruction", "output"), turns=(("system", "context.system"), ("user", "instruction"), ("assistant", "output"))),
)


def _paths(schema: T.DataType, at: str = "") -> list[str]:
    """Leaf paths; the element fields of an array of structs follow its path."""
    if isinstance(schema, T.ArrayType):
        return _paths(schema.elementType, at)
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in _paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def schema_fingerprint(record: str, schema: T.StructType) -> Column:
    """Hash of the sorted paths under the struct column `record` that hold a value: non-null, or in a non-empty array."""
    present = []
    for f in schema:
        held = F.col(f"{record}.`{f.name}`")
        for p in sorted(_paths(f.dataType, f.name)):
            if isinstance(f.dataType, T.ArrayType):
                there = F.coalesce(F.size(held) > 0, F.lit(False))
            else:
                there = F.col(f"{record}.{p}").isNotNull()
            present.append((p, F.when(there, F.lit(p))))
    return F.xxhash64(F.concat_ws(",", *(c for _, c in sorted(present, key=lambda x: x[0]))))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(array: Column, role: str, text: str) -> Column:
    return F.transform(array, lambda x: _turn(x[role], x[text]))


def canonical_turns(df: DataFrame, record: str, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Rows id_col, pos (from 0), role, text of the records in the struct column `record`.

    Null roles and texts count as empty. Records without any present path or with an unknown layout give one row with
    null pos, role and text, so that none is lost without trace. Repeated ids are separate records only if the caller's
    ids tell them apart.
    """
    schema = df.schema[record].dataType
    known = set(_paths(schema))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        if not set(m.paths) <= known:
            continue
        if m.messages:
            made = _messages(F.col(f"{record}.{m.messages[0]}"), *m.messages[1:])
        else:
            made = F.array(*(_turn(F.lit(role), F.col(f"{record}.{path}")) for role, path in m.turns))
        turns = F.when(F.col("_layout") == F.xxhash64(F.lit(",".join(sorted(m.paths)))), made).otherwise(turns)
    found = df.select(F.col(id_col), F.col(record), schema_fingerprint(record, schema).alias("_layout")).select(id_col, turns.alias("_turns"))
    return found.select(id_col, F.posexplode_outer("_turns").alias("pos", "_turn")).select(id_col, "pos", "_turn.role", "_turn.text")


def escape(text: Column, line: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescape(text: Column) -> Column:
    """The inverse of escape, for both forms: a backslash is always followed by one of s, l, n."""
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_turns(turns: DataFrame, id_col: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """One row per record: id_col, formatted (text), loss_mask (array of start and length in characters, from 0).

    The mask covers the escaped texts of the role `learn`. turns are rows as of canonical_turns; rows with null pos give
    an empty formatted text. An empty table gives no rows.
    """
    there = F.col("pos").isNotNull()
    head = F.concat(F.lit(OPEN), escape("role", line=True), F.lit("\n"))
    body = escape("text")
    parts = turns.select(id_col, "pos", F.when(there, head).otherwise("").alias("head"), F.when(there, body).otherwise("").alias("body"), F.when(there, F.lit(CLOSE)).otherwise("").alias("tail"), (there & (F.col("role") == learn)).alias("learn"))
    size = F.length("head") + F.length("body") + F.length("tail")
    before = F.sum(size).over(Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.select(id_col, "pos", F.concat("head", "body", "tail").alias("piece"), F.when(F.col("learn"), F.struct((F.coalesce(before, F.lit(0)) + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))).alias("span"))
    rows = placed.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "piece", "span"))).alias("rows"))
    return rows.select(
        id_col,
        F.concat_ws("", F.transform("rows", lambda r: r["piece"])).alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of role and text of a formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def as_records(conversations: DataFrame) -> DataFrame:
    """Turn rows as records of several layouts: prompt and completion for one exchange, instruction with a system
    text, and messages for the rest."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    roles = F.concat_ws(",", F.transform("m", lambda x: x["role"]))
    at = lambda i: F.get("m", F.lit(i))["content"]
    pair, three = roles == "user,assistant", roles == "system,user,assistant"
    return rows.select(
        "conv_id",
        F.struct(
            F.when(pair, at(0)).alias("prompt"),
            F.when(pair, at(1)).alias("completion"),
            F.struct(F.when(three, at(0)).alias("system")).alias("context"),
            F.when(three, at(1)).alias("instruction"),
            F.when(three, at(2)).alias("output"),
            F.when(~pair & ~three, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"),
        ).alias("record"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7 with markers in its texts, read back from its formatted form."""
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    out = format_turns(canonical_turns(as_records(given.unionByName(extra)), "record"))
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(lines).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        digest(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same in DuckDB.
OP6_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, 6 + length(replace(replace(replace(role, '\', '\s'), '<', '\l'), chr(10), '\n')) + 1
            + length(replace(replace(text, '\', '\s'), '<', '\l')) + 8 AS size FROM given
)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(size) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
