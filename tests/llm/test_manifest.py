import hashlib
import zlib

from groundweave.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root, and for each node its runs' (left, right) siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append((run[: k % 8], run[k % 8 + 1 :]))
        nodes, at = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [k // 8 for k in at]
    return nodes[0], paths


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    roots, out = [], []
    for lang in order:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in trees[lang]), key=lambda x: x[:3])
        roots.append(climb([x[2] for x in own]))
    root, last = climb([r[0] for r in roots])
    for lang, (sub, paths), up in zip(order, roots, last, strict=True):
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in trees[lang]), key=lambda x: x[:3])
        for (_, _, h, r), path in zip(own, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            t = leaf((*r[:4], r[4] and r[4].translate(LOWER))) if hit else h
            for left, right in path + up:
                t = H(*left, t, *right)
            out.append((r[0], h, sub, root, H(*(x for left, right in path + up for x in left + right)), t, t == root))
    return sorted(map(str, out))


def check(spark, tmp_path, rows):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(rows, kind).selectExpr("*", "1 AS tree", "2 AS rank", "3 AS hash", "4 AS _id", "5 AS path").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path)).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(str(tuple(r[c] for c in names)) for r in got) == brute(rows)


def test_merkle_equals_brute_force(spark, tmp_path):
    """Trees of one leaf, of more than one block of 512 and of more than one block of blocks' siblings; nulls, ties, repeated rows."""
    rows = [(i, "s", "en", i, f"Text {i} É") for i in range(0, 9400, 2)]
    rows += [(i, None, None, None, None) for i in range(513)] + [(None, "s", None, 1, "A"), (None, "s", None, 1, "B")]
    rows += [(5, "x", "-", 2, ""), (6, "x", "é", 0, "ABC"), (6, "x", "é", 0, "ABC"), (6, "x", "é", 0, "abd"), (7, "1:x", "z", 1, "Z" * 200_000)]
    check(spark, tmp_path, rows)


def test_merkle_of_one_and_of_none(spark, tmp_path):
    check(spark, tmp_path / "one", [(0, "s", "en", 1, "A")])
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op11_merkle(spark, str(tmp_path)).count() == 0


def test_merkle_finds_tampered_rows(spark, odd_docs):
    from pyspark.sql import functions as F

    got = merkle.manifest(odd_docs, tampered={"text": F.when(F.col("doc_id") == 6, F.lit("other")), "source": F.when(F.col("doc_id") == 7, "q")}).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {6, 7} and len(got) == odd_docs.count()
