import hashlib
import random
import re
import string

import pytest

from groundweave.llm import secrets
from tests.llm.conftest import text

PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def brute(t: str) -> list[str]:
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, keep) in enumerate(PATTERNS) for m in p.finditer(t or "") if keep(m)]
    return [x for *_, x in sorted(found)]


ODD = [
    "token=secret: 'abcdefghijklmnop", "token=secret\": \"abcdefghijklmnop", 'API_KEY : "abcdefghijk"', "apikey=''abcdefghijklm", "AKIAAKIA" + "Z" * 9, "xAKIA" + "0" * 14 + "AKIA" + "1" * 13,
    "0" * 15 + "g" + "a" * 16 + "A" + "0123456789abcdef" * 3000, "PASSWORDſecret=abcdefghijklmno Key", "é😀 passwd = " + "A1" * 40 + " token=short secret==" + "f" * 20, "password\t=abcdefghijklmnop", "password=\nabcdefghijklmnop",
]


def test_base_spans_equal_brute_force(spark, tmp_path, odd_docs):
    texts = [*ODD, " ".join(ODD), None, "", *(r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in secrets.op13_secrets(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("novel")] == want
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
    assert any(map(brute, ODD)) and sum(r["n_assign"] for r in got.values()) > 12


def test_novel_strings_are_found_and_words_left(spark, odd_docs):
    rng = random.Random(5)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(24)) for _ in range(40)]
    rows = [(i, f"{text(60, i)} Authorization Bearer {k} {text(30, i + 1)}") for i, k in enumerate(keys)]
    rows += [(100 + i, rows[0][1]) for i in range(50)]  # copies don't make a key known
    plain = ["the password is getUserCredentials2 as before", "token: see the_configuration_settings_File for more", "a secret your_api_key_here_123 stands here", "secret 2026-11-28T12:00", "token aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"]
    rows += [(200 + i, t) for i, t in enumerate(plain)] + [(300 + i, f"{text(90, i)} {k}") for i, k in enumerate(keys)]  # keys in no sensitive place
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, spans in got.items():
        found = [texts[i][s["start"] : s["end"]] for s in spans if s["kind"] == "novel"]
        assert found == ([keys[i if i < 100 else 0]] if i < 200 else []), (i, found)
    assert all(0.7 <= s["novelty"] <= 1 for spans in got.values() for s in spans if s["kind"] == "novel")


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_secrets_of_odd_rows(spark, request, name):
    df = request.getfixturevalue(name)
    got = secrets.secret_spans(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    assert all(r["spans"] == [] for r in got if r["doc_id"] in (3, 4, 5))


def test_candidates_in_long_texts_are_seen_once():
    t = "token " * 20_000 + "abcdefghijkl" * 3
    assert list(secrets.candidates(t, t)) == [(120_000, 120_036, 119_800)]
