import random
import re
import zlib
from collections import Counter

import pytest

from groundweave.llm import variants


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int]) -> list[tuple]:
    best, counts = {}, {}
    for w, n in words.items():
        own = [x for x in words if x != w and near(w, x)]
        counts[w] = len(own)
        top = min(own, key=lambda x: (-words[x], x), default=None)
        best[w] = top if top and words[top] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while best[root]:
            root = best[root]
        out.append((w, best[w], root, n, counts[w], words[best[w]] if best[w] else None))
    return sorted(out)


def rows(df) -> list[tuple]:
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("longest", [64, 5])
def test_variant_groups_equal_brute_force(spark, longest):
    """Doubled letters at both ends, chains, ties, letters beyond ASCII, words at and beyond the length that is fingerprinted."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(250)}
    words |= {"aaaa", "aaaaa", "aaaaaa", "×÷×÷", "×÷×", "zzzzq", "zzzz"}
    long = "".join(rng.choice("xyz") for _ in range(400))
    for base in (long[:63], long[:64], long[:65], long):
        words |= {base, base[:-1], base[1:], base + base[-1], base[:30] + "w" + base[31:], base[:30] + base[30] + base[30:], "v" + base}
    counted = {w: rng.choice([5, 6, 30, 31, 200, 1200, 7000]) for w in words}
    df = spark.createDataFrame(list(counted.items()), "word string, n long").selectExpr("*", "1 AS id", "2 AS prefix", "3 AS best")
    assert rows(variants.variant_groups(df, longest=longest)) == brute(counted)


def test_variants_of_documents(spark, tmp_path, odd_docs, no_docs):
    """Whole query against brute force: read runs lose a letter by the CRC-32 of id and run; nulls, repeated rows, long texts."""
    rng = random.Random(7)
    stock = ["".join(rng.choice("abcdé") for _ in range(6)) for _ in range(40)] + ["Straße", "ÀÉÎÕÜ×÷", "x" * 300]
    docs = [(i, " ".join(rng.choice(stock).capitalize() for _ in range(300)) + "1a_b") for i in range(60)]
    docs += [docs[0], (None, "Straße " * 9), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    seen, lower = Counter(), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counted = {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}
    assert len(counted) > len(stock) - 3
    assert rows(variants.op12_variants(spark, str(tmp_path))) == brute(counted)
    assert variants.variant_groups(variants.word_counts(odd_docs, shortest=3)).count() > 0
    assert variants.variant_groups(variants.word_counts(no_docs)).count() == 0
