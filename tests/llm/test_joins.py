import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundweave.llm import jaccard, repeats, topk
from groundweave.llm.common import table
from tests.llm.conftest import text


def near_components(rows, near=80):
    """Brute force: {id: (set size, component)}; rows of one id are one document with all links."""
    sets = []
    for key, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((key, frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()))
    parent = {k: k for k, _ in sets if k is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, r in sets[:i]:
            both = len(s & r)
            if a is not None and b is not None and both and 100 * both >= near * len(s | r):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return sorted((str(k), len(s), str(top(k) if k is not None else None)) for k, s in sets)


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_jaccard_edges(spark, odd_docs, no_docs):
    assert found(jaccard.shingle_components(odd_docs)) == near_components([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert found(jaccard.shingle_components(no_docs)) == []
    with pytest.raises(ValueError):
        jaccard.shingle_components(no_docs, near=50)


def test_jaccard_threshold_is_exact(spark):
    # Sets of 4 of 5 and 7 of 9 shared shingles stand on both sides of 0.8.
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "A\tb c  d e f g h j k"), (10, "p q r s t u v w x y z"), (11, "p q r s t u v w x y z 1 2"), (20, "x y"), (21, "X  y"), (22, "x y z")]
    assert found(jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"))) == near_components(rows)


@pytest.mark.parametrize(("frequent", "many"), [(2, 3), (2, 60), (32, 1024)])
def test_jaccard_near_copies(spark, monkeypatch, frequent, many):
    """Copies of one base with more and more edits, some past the threshold: rare and frequent tokens decide."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent), monkeypatch.setattr(jaccard, "MANY", many)
    rng = np.random.default_rng(1)
    base = text(90).split()
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.choice(len(words), int(rng.integers(0, 9)), replace=False):
            words[k] = f"edit{rng.integers(1 << 30)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(i, text(60, i)) for i in range(30)] + [(2000 + i, text(40, 99) + " " + text(8, i)) for i in range(20)]
    assert found(jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"))) == near_components(rows)


def test_jaccard_short_sets_of_frequent_tokens(spark, monkeypatch):
    """Sets of 1 to 20 shingles around the sizes at which combinations change."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2), monkeypatch.setattr(jaccard, "MANY", 4)
    rows, base = [], text(24).split()
    for n in range(5, 25):
        rows += [(100 * n, " ".join(base[:n])), (100 * n + 1, " ".join(base[24 - n :])), (100 * n + 2, " ".join([*base[: n - 1], f"end{n}"])), (100 * n + 3, " ".join([f"at{n}", *base[1:n]]))]
    assert found(jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"))) == near_components(rows)


def test_jaccard_hot_bucket_of_unlike_documents(spark, monkeypatch):
    """A form that all fill in their own way: every frequent token is everywhere, yet only one pair is near; the others
    aren't even compared, as their own tokens are too many."""
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    form, rows = text(80).split(), []
    for i in range(150):
        own = [f"own{i}w{k}" for k in range(12)]
        rows.append((i, " ".join([*form, *own])))
    rows.append((900, rows[11][1] + " end"))
    compared = []
    close = jaccard._close
    monkeypatch.setattr(jaccard, "_close", lambda pairs, *a: compared.append(pairs.count()) or close(pairs, *a))
    assert found(jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"))) == near_components(rows)
    assert sum(compared) < 4 * len(rows)


def test_jaccard_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert found(jaccard.op7_jaccard(spark, "/root/testdata/sf0.001")) == near_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["component"] for r in jaccard.components(links).collect()} == {0, 100}


def without(rows, length):
    seen = Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for key, t in rows:
        spans = []
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        kept, at = b"", 0
        for s, e in spans:
            kept += t[at:s]
            at = e
        out.append((str(key), len(t), hashlib.sha256(kept + t[at:]).hexdigest(), str(spans)))
    return sorted(out)


def removed(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest(), str([list(s) for s in r["spans"]])) for r in df.collect())


def raw(df):
    return [(r[0], (r[1] or "").encode()) for r in df.select("doc_id", "text").collect()]


def test_repeats_edges(spark, odd_docs, no_docs):
    assert removed(repeats.without_repeats(odd_docs, 64)) == without(raw(odd_docs), 64)
    assert removed(repeats.without_repeats(no_docs, 64)) == []
    with pytest.raises(ValueError):
        repeats.without_repeats(no_docs, 10)


def test_repeats_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert removed(repeats.without_repeats(docs)) == without(raw(docs), 400)


def test_repeats_shifted_overlapping_and_periodic(spark):
    rng = np.random.default_rng(5)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype="uint8")).decode()
    shared, long = word(150), word(900)
    rows = [(1, word(50) + shared + word(70)), (2, shared), (3, word(3) + shared[10:140] + word(200)), (4, long), (5, word(9) + long[100:700] + word(40) + long[300:420]), (6, "ab" * 200), (7, "abc" * 70), (8, word(99)), (9, word(100)), (10, long[850:] + long[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(repeats.without_repeats(df, 100)) == without(raw(df), 100)


def test_repeats_slabs(spark, monkeypatch):
    """Texts that are worked off in parts give the same."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("length(text) > 3000")
    keyed = [(i, t) for i, t in raw(docs)]
    whole = sorted(without(keyed, 400))
    monkeypatch.setattr(repeats, "_SLAB", 1000)
    runs = repeats._runs(400)
    import pandas as pd

    frame = pd.DataFrame({"ik": [str(i) for i, _ in keyed], "th": 0, "t": [t for _, t in keyed]})
    starts = pd.concat(runs(iter([frame])))
    assert (starts["last"] - starts["start"] + 1).sum() == sum(len(t) - 399 for _, t in keyed)
    assert len(whole) == len(keyed)


def brute_topk(rows, k):
    ok = [(i, np.floor(np.asarray(v, float) * 1024).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_brute_force_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 30])]) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 460)] + [(500, None), (600, [1.0, None] + [0.0] * 6), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (900, [1.0, 2.0]), (901, [3.0, 4.0]), (1000, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS dim")
    vectors = topk.whole_numbers(df)
    got = topk.top_inner_products(vectors, vectors.where("id % 100 = 0"), 10)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(exact, 10)


def test_topk_parts_meet_once(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 50), monkeypatch.setattr(topk, "QUERIES", 2), monkeypatch.setattr(topk, "SEEDS", 20)
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    assert sorted(tuple(r) for r in topk.op2_topk(spark, "/root/testdata/sf0.001").collect()) == brute_topk(rows, 10)


def test_topk_plan_stays_small_with_many_parts(spark):
    """The cuts of 50 million vectors: the plan is made in under a second, and values fall between their cuts."""
    import time

    cuts = np.arange(6100) * 10.0
    part = topk.part_of(spark, cuts.tolist())
    df = spark.range(100).selectExpr("id * 611.5 AS x")
    df.select(part("x")).collect()
    began = time.time()
    plan = df.withColumn("p", part("x")).groupBy("p").count()._jdf.queryExecution().toString()
    assert time.time() - began < 1 and len(plan) < 20_000
    assert [r["p"] for r in df.select("x", part("x").alias("p")).collect()] == [int((cuts < r["x"]).sum()) for r in df.collect()]


def test_topk_repeated_ids_count_once(spark):
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.5, 0.5]), (2, [-4.0, 1.0]), (200, [1.0, 2.0])]
    vectors = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in topk.top_inner_products(vectors, vectors.where("id % 100 = 0"), 10).collect())
    assert got == brute_topk([(100, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [-4.0, 1.0]), (200, [1.0, 2.0])], 10)


def test_topk_empty(spark):
    none = topk.whole_numbers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_inner_products(none, none).count() == 0


def test_repeats_passages_of_51_words_beside_long_strings(spark, tmp_path):
    """A passage of 51 words under 400 bytes goes from the column text alone; the digests tell of strings of 400 bytes alone. Both by brute force."""
    passage, long = text(51, 4000), text(120, 9000)
    rows = [(i, f"{text(70, 5000 + i)} {passage} {text(70, 6000 + i)}") for i in range(4)] + [(10, long), (11, f"{long} {text(60, 1)}"), (12, text(90, 2)), (12, text(90, 2)), (13, text(120, 3)), (14, passage), (15, ""), (16, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.op4_repeats(spark, str(tmp_path)).collect()
    pairs = [(k, (t or "").encode()) for k, t in rows]
    assert 256 < len(passage) < 400
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["kept_sha256"], r["n_spans"]) for r in got) == [(k, n, sha, len(eval(s))) for k, n, sha, s in without(pairs, 400)]
    assert sorted((str(r["doc_id"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in got) == [(k, sha) for k, _, sha, _ in without(pairs, 256)]
    assert not any(passage in r["text"] for r in got) and {r["doc_id"]: r["n_removed"] for r in got}[14] == 0


def test_repeats_two_lengths_on_odd_documents(spark, odd_docs, no_docs):
    docs = repeats.without_repeats(odd_docs, 128, passage=64)
    assert removed(docs) == without(raw(odd_docs), 128)
    assert sorted(hashlib.sha256(r["rest"].encode()).hexdigest() for r in docs.collect()) == sorted(sha for _, _, sha, _ in without(raw(odd_docs), 64))
    assert removed(repeats.without_repeats(no_docs, 128, passage=64)) == []
    with pytest.raises(ValueError):
        repeats.without_repeats(no_docs, 128, passage=128)


def test_repeats_blocks_of_parts(monkeypatch):
    """Runs whose texts are cut into stretches and parts give the same blocks."""
    import pandas as pd
    import pyarrow as pa

    texts = [text(900, 3).encode(), text(200, 4).encode(), text(90, 5).encode()]
    frame = pd.DataFrame({"ik": ["a", "b", "c"], "th": [1, 2, 3], "t": texts})
    runs = pd.concat(repeats._runs(400)(iter([frame]))).assign(weight=1)
    lists = [runs[runs["ik"] == k].iloc[:: 1 + (k == "a") * 2] for k in "abc"]
    columns = {c: pa.array([x[c].tolist() for x in lists], pa.list_(pa.int64())) for c in ("start", "last", "anchor", "core", "weight")}
    batch = pa.record_batch({"ik": ["a", "b", "c"], "th": pa.array([1, 2, 3]), "t": pa.array(texts), **columns})
    blocks = lambda: sorted(map(str, pa.Table.from_batches(repeats._blocks(400)(iter([batch]))).to_pylist()))
    whole = blocks()
    monkeypatch.setattr(repeats, "_SLAB", 300)
    monkeypatch.setattr(repeats, "_PART", 500)
    assert blocks() == whole and sum(x.count("core") for x in whole) >= len(pd.concat(lists))
