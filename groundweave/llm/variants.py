"""Operator 12, spelling variant grouping over permuterm rotations.

A word w is marked with a terminator, w$, and all its rotations are sorted. Leaving out one character of w gives a string
that holds the terminator, w[i+1:]$w[:i]: it is what all words have in common that differ from w in that character
alone, and it is the whole rotation of the word that lacks it. So in the sorted rotations each such string is a prefix range of
itself and of itself with one more character: a word that may stand there alone and, behind it, at most one word for each character of the
alphabet. A scan over these groups, whose size the alphabet bounds, gives each member its number of neighbours and its
best one; pairs are never put out.

Strings of more than LONGEST code points would take their square in rotations, so they are scanned as fingerprints of
122 bits, taken from one prefix array of the word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.llm.common import discard, table, text_batches, written
from groundweave.llm.merkle import CRC_TABLE, crc_sql
from groundweave.operators.sampling import numbered

#: The alphabet: A-Z are put in lower case beforehand, other letters stay as they are.
WORD = re.compile("[a-zÀ-ÿ]+")
END = "$"
#: Longer prefixes are compared by fingerprints.
LONGEST = 64
#: One occurrence in so many loses a character.
DROPPED = 199
#: Counted words that a task holds before it hands them on.
HELD = 200_000
_PRIME, _BASES = (1 << 61) - 1, (911382323, 972663749)


def words_of(doc_id: int | None, text: str) -> Counter:
    """The words of a text with their numbers, each run as it is read in the document of this id."""
    runs = Counter(WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))  # bytes: A-Z alone
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run in list(runs):
        h = zlib.crc32(run.encode(), start)
        if h % DROPPED == 0:
            n, at = runs.pop(run), h % len(run)
            runs[f"{run[:at]}{run[at + 1 :]} "] += n  # the blank keeps it apart from a run that is read so
    return runs


def word_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n: the words of at least `shortest` code points that occur at least `least` times in all texts.

    Null texts have none; a null id reads as an empty one; repeated rows count each. A task counts what it reads before
    anything is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for k, t in zip(b["k"], b["t"], strict=True):
                if t:
                    for word, n in words_of(None if k is None else int(k), t).items():
                        word = word.rstrip()
                        if len(word) >= shortest:
                            seen[word] += n
                    if len(seen) > HELD:
                        yield pd.DataFrame(list(seen.items()), columns=["word", "n"])
                        seen.clear()
        yield pd.DataFrame(list(seen.items()), columns=["word", "n"])

    found = df.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).mapInPandas(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _fingerprints(word: str, longest: int) -> Iterator[tuple[str, str | None]]:
    """(prefix, skipped character or null) of each rotation of a long word, the prefixes as fingerprints."""
    hashes, powers = [], []
    for base in _BASES:
        h, p = [0], [1]
        for c in word:
            h.append((h[-1] * base + ord(c)) % _PRIME)
            p.append(p[-1] * base % _PRIME)
        hashes.append(h), powers.append(p)
    n = len(word)

    def joined(start: int, end: int) -> str:
        """Of word[start:] + END + word[:end]."""
        each = []
        for h, p, base in zip(hashes, powers, _BASES, strict=True):
            tail = (h[n] - h[start] * p[n - start]) * base + ord(END)
            each.append(f"{(tail * p[end] + h[end]) % _PRIME:016x}")
        return f"{n - start + 1 + end}:" + "".join(each)

    for i in range(n + 1):
        yield joined(i, i), None
        if i < n and n > longest:
            yield joined(i + 1, i), word[i]


def rotations(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """id, n, prefix, skipped, doubled: every rotation of word, whole (skipped is null) and without its last character, for words of
    (id, word, n). doubled: the character before the skipped one in the word is the same."""
    short = words.where(F.length("word") <= longest)
    marked = F.concat("word", F.lit(END))
    turned = short.select("id", "n", marked.alias("_m"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("_i"))
    rotation = F.concat(F.substr("_m", F.col("_i") + 1), F.substr("_m", F.lit(1), F.col("_i")))
    turned = turned.select("id", "n", "_i", rotation.alias("_r"), F.length("_m").alias("_size"))
    whole = F.when(F.col("_size") <= longest, F.struct(F.col("_r").alias("prefix"), F.lit(None).cast("string").alias("skipped")))
    cut = F.when(F.col("_i") > 0, F.struct(F.substr("_r", F.lit(1), F.col("_size") - 1).alias("prefix"), F.right("_r", F.lit(1)).alias("skipped")))
    spread = turned.select("id", "n", F.explode(F.array_compact(F.array(whole, cut))).alias("_e")).select("id", "n", "_e.prefix", "_e.skipped")
    plain = spread.withColumn("doubled", F.coalesce(F.col("skipped") == F.right("prefix", F.lit(1)), F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, word, n in b.itertuples(index=False):
                rows = [(k, n, prefix, c) for prefix, c in _fingerprints(word, longest)]
                out = pd.DataFrame(rows, columns=["id", "n", "prefix", "skipped"])
                skips = out["skipped"].notna()
                before = ["", *word[:-1]]
                out["doubled"] = False
                if skips.any():
                    out.loc[skips, "doubled"] = [c == p for c, p in zip(word, before, strict=True)]
                yield out

    long = words.where(F.length("word") >= longest).select("id", "word", "n").mapInPandas(run, "id long, n long, prefix string, skipped string, doubled boolean")
    return plain.unionByName(long)


def neighbours(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """id, n_near, best_n, best: for each of (id, word, n) that has one, the number of near words and the greatest n among them with the
    least id that has it. ids follow the order of the words."""
    ranged = rotations(words, longest).repartitionByRange("prefix")  # sorts the rotations; a prefix range lies in one partition
    member = F.struct((-F.col("n")).alias("less"), "id", "skipped", "doubled")
    groups = ranged.groupBy("prefix").agg(F.sort_array(F.collect_list(member)).alias("members")).where(F.size("members") > 1)  # bounded by the alphabet
    longer = F.size(F.filter("members", lambda m: m["skipped"].isNotNull()))
    alone = F.size("members") - longer  # the word that is the prefix itself: one or none
    twice = F.size(F.filter("members", lambda m: m["doubled"]))
    spread = groups.select(longer.alias("_longer"), alone.alias("_alone"), twice.alias("_twice"), F.slice("members", 1, 2).alias("_top"), F.explode("members").alias("m"))
    # A word with a doubled letter lies in one group with the word that lacks it for each of the two letters; it counts in the first.
    near = F.when(F.col("m.skipped").isNull(), F.col("_longer") - F.col("_twice")).otherwise(F.col("_longer") - 1 + F.when(F.col("m.doubled"), 0).otherwise(F.col("_alone")))
    other = F.when(F.col("_top")[0]["id"] == F.col("m.id"), F.col("_top")[1]).otherwise(F.col("_top")[0])
    each = spread.select("m.id", near.alias("near"), F.struct(other["less"].alias("less"), other["id"].alias("id")).alias("other"))
    found = each.groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.min("other").alias("best"))
    return found.select("id", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.id").alias("best"))


def variant_groups(counts: DataFrame, times: int = 5, longest: int = LONGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of (word, n), each of which is there once.

    Near words differ in exactly one inserted, deleted or replaced code point. form: the near word of greatest n, the smallest in code-point
    order among equals, if its n is at least `times` the word's. root: where forms lead in the end; as n grows by each
    step, the walk ends after at most log(n) of them. Words without near words are rows too; an empty table gives none.
    """
    placed = numbered(counts.select("word", "n"), [F.col("word")], "id")
    words = written(placed, "variant-words")
    near = written(neighbours(words, longest), "variant-near")
    discard(placed)
    steps = near.join(words.select("id", "n"), "id").where(F.col("best_n") >= times * F.col("n")).select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    forms = written(steps, "variant-forms")
    roots = written(forms.select("id", F.col("form").alias("root")), "variant-roots")
    while True:  # each round doubles the steps taken
        onward = roots.select(F.col("id").alias("_at"), F.col("root").alias("_on"))
        further = written(roots.join(onward, F.col("root") == F.col("_at"), "left").select("id", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "variant-roots")
        discard(roots)
        roots = further
        if roots.where("moved").isEmpty():
            break
    name = lambda c: words.select(F.col("id").alias(f"_{c}"), F.col("word").alias(f"{c}_word"))
    out = words.join(near.select("id", "n_near"), "id", "left").join(forms, "id", "left").join(roots.select("id", "root"), "id", "left")
    out = out.join(name("form"), F.col("form") == F.col("_form"), "left").join(name("root"), F.col("root") == F.col("_root"), "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their preferred forms."""
    text_batches(spark)
    return variant_groups(word_counts(table(spark, sf_dir, "documents")))


#: Near words by masks of one place: a replaced letter leaves the same mask, a deletion is a word itself.
OP12_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, crc),
kept AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masks AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS mask, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
pairs AS MATERIALIZED (
    SELECT a.word, b.word AS other, b.n FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
    UNION SELECT m.word, w.word, w.n FROM masks m JOIN words w ON m.less = w.word
    UNION SELECT w.word, m.word, m.n FROM masks m JOIN words w ON m.less = w.word),
near AS (SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, n.best AS form, n.best_n AS form_n FROM words w JOIN near n USING (word) WHERE n.best_n >= 5 * w.n),
walk AS (
    SELECT word, word AS root FROM words
    UNION ALL
    SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root),
roots AS (SELECT word, root FROM walk w WHERE NOT EXISTS (SELECT 1 FROM forms f WHERE f.word = w.root))
SELECT w.word, f.form, r.root, w.n, coalesce(x.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN forms f USING (word) LEFT JOIN near x USING (word) JOIN roots r USING (word)
"""
