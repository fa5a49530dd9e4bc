"""Operator 13, secret scans: fixed patterns, and strings that a primed compressor finds new where secrets are kept.

A candidate is a run of key characters shortly behind a word such as password or key. Its novelty is what zstandard
needs for it on top of what stands before it: the compressed size of context and candidate less that of the context,
by the candidate's bytes. The compressor is primed with two dictionaries of identifiers: those that code is made of,
and those that stand before such words in several of the given texts. Words of the language, names
and placeholders are found there or in the context and cost little; keys cost nearly all their bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.llm.common import hold, table, text_batches

#: The patterns that count by themselves: kind, expression, group that must have so many characters. Fixed values.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = (*(kind for kind, *_ in BASE), "novel")
#: Words behind which secrets stand, in lower case. Fixed values.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "authorization", "bearer", "signing_key")
#: Identifiers of code and of its placeholders, with which the compressor is primed. Fixed values.
CODE = (
    "public static final private protected const string return function import export default class self this null none true false undefined "
    "username user_name password passwd passphrase secret token access_token refresh_token api_key apikey access_key secret_key private_key public_key "
    "client_id client_secret authorization bearer basic credential credentials session_id cookie header request response config settings environment "
    "process.env os.environ getenv example placeholder changeme your_password your_token your_api_key your-secret-key-here insert_key_here redacted xxxxxxxx "
    "********* ......... localhost 127.0.0.1 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ http:// https:// www. .com .org .json .yaml .html "
    "application/json text/html utf-8 base64 sha256 md5 aes-256 rsa ssh-rsa BEGIN END PRIVATE KEY CERTIFICATE"
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)))
_PATTERNS = [(kind, re.compile(pattern, re.IGNORECASE | re.ASCII) if kind == "assign" else re.compile(pattern), group, least) for kind, pattern, group, least in BASE]
_ASSIGNED = ("passw", "secret", "token", "apikey", "api_key")
_IDENTIFIER = re.compile(r"\b[^\W\d]{4,24}\b")

#: A candidate starts at most so many characters behind the sensitive word; so much of what stands before it is its context.
REACH, CONTEXT = 40, 200
#: Shorter candidates are left alone; a novelty of less than this share of a candidate's bytes is.
SHORTEST, NOVELTY = 12, 0.7
#: The dictionary of the texts' own identifiers holds so many, each from at least so many different texts.
IDENTIFIERS, PLACES = 4096, 2
LEVEL, LETTERS = 6, 3


def lower(text: str) -> str:
    """text with A-Z alone in lower case, so that positions stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, each leftmost and without overlaps within its kind."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(_PATTERNS):
        if kind == "access" and "AKIA" not in text or kind == "assign" and not any(w in low for w in _ASSIGNED):
            continue
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(text: str, low: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of the context) of each run of key characters that starts within REACH behind a sensitive word's end, once."""
    if not any(w in low for w in SENSITIVE):
        return
    done = 0
    for m in _SENSITIVE.finditer(low):
        for c in _CANDIDATE.finditer(text, max(m.end(), done)):
            if c.start() > m.end() + REACH:
                break
            done = c.end()
            if c.end() - c.start() >= SHORTEST:
                yield c.start(), c.end(), max(0, c.start() - CONTEXT)


def identifiers(df: DataFrame, text_col: str = "text", most: int = IDENTIFIERS, places: int = PLACES) -> list[str]:
    """The identifiers that stand before sensitive words in most different ones of all texts, at least in `places` of them; the
    most frequent last, as near ones are cheapest to refer to.

    Equal texts count once, so that a secret isn't known because a text has copies; runs with digits are no
    identifiers. `most` bounds the dictionary, and with it what the driver gets, not the texts that are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = set()
            for t in b["t"]:
                if t and any(w in (low := lower(t)) for w in SENSITIVE):
                    place = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                    for m in _SENSITIVE.finditer(low):
                        found |= {(x, place) for x in _IDENTIFIER.findall(low, max(0, m.start() - CONTEXT), m.end())}
            yield pd.DataFrame(list(found), columns=["identifier", "place"])

    seen = df.select(F.col(text_col).alias("t")).mapInPandas(run, "identifier string, place long").distinct()
    counts = seen.groupBy("identifier").agg(F.count("*").alias("n")).where(F.col("n") >= places)
    return [r["identifier"] for r in counts.orderBy(F.desc("n"), "identifier").limit(most).collect()][::-1]


class Novelty:
    """Marginal compressed bytes behind a context, with a compressor primed once."""

    def __init__(self, words: list[str]):
        import zstandard

        # The context's own dictionary is the text before the candidate; these two stand before that.
        primed = " ".join([*words, CODE]).encode("utf-8", "surrogatepass")
        held = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def __call__(self, context: str, candidate: str) -> float:
        """Between 0 and about 1."""
        before, own = context.encode("utf-8", "surrogatepass"), candidate.encode()
        more = len(self.compress(before + own)) - len(self.compress(before))
        return min(1.0, max(0, more) / len(own))


def scan(text: str, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, novelty) of all spans of a text in order: the base ones, and of the candidates that touch none of them those that
    are new and have a digit and at least LETTERS letters, as numbers and dates haven't."""
    low = lower(text)
    base = base_spans(text, low)
    out: list[tuple[int, int, int, float]] = [(s, k, e, novelty(text[max(0, s - CONTEXT) : s], text[s:e])) for s, k, e in base]
    at, reach = 0, 0
    for start, end, context in candidates(text, low):
        while at < len(base) and base[at][0] < end:
            reach, at = max(reach, base[at][2]), at + 1
        own = text[start:end]
        if reach <= start and re.search("[0-9]", own) and len(re.findall("[A-Za-z]", own)) >= LETTERS:
            new = novelty(text[context:start], own)
            if new >= least:
                out.append((start, len(BASE), end, new))
    return sorted(out)


def secret_spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: list[str] | None = None) -> DataFrame:
    """One row per row of df: id_col, spans (array of kind, start, end, novelty; code points, end exclusive), in order of
    start and kind.

    Null and empty texts have no spans. A base span is the whole match of its pattern. words: the texts' own identifiers (default: counted here, over all of df).
    A row's result depends on its text and on these alone, so repeated rows have equal ones; other columns are left out.
    """
    known = identifiers(df, text_col) if words is None else words
    key = hashlib.sha256("\n".join(known).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = hold(("secrets", key), lambda: Novelty(known))
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "novelty": x} for s, k, e, x in scan(t, novelty)] if t else [] for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "spans": spans})

    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInPandas(run, f"k {kind}, spans array<struct<kind:string,start:long,end:long,novelty:double>>")
    return got.withColumnRenamed("k", id_col)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: base spans by kind and as a digest, and all spans."""
    text_batches(spark)
    got = secret_spans(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256)
    return got.select("doc_id", *(count(kind) for kind, *_ in BASE), base.alias("base_sha256"), joined(F.col("spans")).alias("spans"))

