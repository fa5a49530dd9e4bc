import corpus_pipeline
import pytest

from groundweave.llm.common import table, written
from tests.llm.conftest import text
from tests.llm.test_joins import near_components, without


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], "/root/testdata/sf0.001"), "test-" + name.replace(" ", "-")))
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_hand_on_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "repeated strings", "packing"]
    assert all(tuple(df.columns) == corpus_pipeline.COLUMNS for df in stages[:-1])


def test_language_keeps_clean_documents(stages):
    """Each document with a letter and a known language stays."""
    lost = {t for _, t in rows(stages[0])} - {t for _, t in rows(stages[1])}
    assert set(rows(stages[1])) <= set(rows(stages[0])) and not [t for t in lost if len(set((t or "").split())) > 20]
    assert len(rows(stages[1])) >= 0.99 * len(rows(stages[0]))


def test_one_of_each_component_stays(stages):
    want = {int(k) for k, _, c in near_components(rows(stages[1])) if k == c}
    assert {k for k, _ in rows(stages[2])} == want and len(rows(stages[2])) == len(want)


def test_texts_without_their_own_id_stay(spark, odd_docs):
    """Null ids with different texts, and texts that share an id, are near duplicates only by their texts."""
    rows = [(None, text(60, 1)), (None, text(60, 2)), (None, text(60, 2)), (None, text(60, 1) + " end"), (None, text(60, 3)), (None, None), (None, ""), (5, text(60, 4)), (5, text(60, 5)), (5, text(60, 5)), (6, text(60, 6)), (6, text(60, 3)), (7, text(60, 7)), (8, text(60, 7)), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], odd_docs.select(*corpus_pipeline.COLUMNS).schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_near_duplicates(spark, docs, "").collect()]
    first = [x for x in got if x[0] is None and x[1] in (text(60, 1), text(60, 1) + " end")]
    want = [(None, text(60, 2)), (None, None), (None, ""), (5, text(60, 4)), (5, text(60, 5)), (6, text(60, 6)), (6, text(60, 3)), (7, text(60, 7)), (9, None), (9, "")]
    assert len(first) == 1 and sorted(got, key=str) == sorted(want + first, key=str)


def test_repeated_strings_go(stages):
    before = [(k, t.encode()) for k, t in rows(stages[2])]
    after = dict(rows(stages[3]))
    spans = {k: s for k, _, _, s in without(before, corpus_pipeline.PASSAGE)}
    for key, t in before:
        kept, at = b"", 0
        for s, e in eval(spans[str(key)]):
            kept += t[at:s]
            at = e
        assert after[key] == (kept + t[at:]).decode("utf-8", "ignore")


def test_packing_takes_every_document(stages):
    assert {r["doc_id"] for r in stages[4].select("doc_id").collect()} == {k for k, _ in rows(stages[3])}


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    for source in (odd_docs, no_docs):
        docs = source
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, ""), "odd-" + name.replace(" ", "-"))
        assert docs.columns[:2] == ["doc_id", "piece"]
    assert docs.count() == 0


def test_planted_copies_and_passages_are_caught_and_clean_documents_stay(spark):
    """On the given documents and planted ones: of exact and near copies one stays, a passage of 51 words in twelve documents is cut from all
    of them, and every clean planted document comes out as it went in."""
    given = table(spark, "/root/testdata/sf0.001", "documents")
    clean = [(10_000 + i, text(120, 1000 + i)) for i in range(60)]
    exact = [(20_000 + i, text(150, 2000)) for i in range(8)]
    words = text(200, 3000).split()
    near = [(30_000 + i, " ".join([*words[: 20 * i + 5], "changed", *words[20 * i + 6 :]])) for i in range(8)]
    passage = text(51, 4000)
    shared = [(40_000 + i, f"{text(70, 5000 + i)} {passage} {text(70, 6000 + i)}") for i in range(12)]
    planted = spark.createDataFrame([(k, t, "en", "planted", len(t)) for k, t in clean + exact + near + shared], given.select(*corpus_pipeline.COLUMNS).schema)
    docs = given.select(*corpus_pipeline.COLUMNS).unionByName(planted)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, ""), "planted-" + name.replace(" ", "-"))
    left = {k: t for k, t in rows(docs) if k >= 10_000}
    assert all(left[k] == t for k, t in clean)
    assert [k for k in left if 20_000 <= k < 40_000] == [20_000, 30_000]
    assert all(passage not in left[k] and left[k].startswith(text(70, 5000 + k - 40_000)[:-20]) and left[k].endswith(text(70, 6000 + k - 40_000)[20:]) for k, _ in shared)
    assert len(passage.encode()) > corpus_pipeline.PASSAGE and sum(len(left[k]) for k, _ in shared) > 0.95 * sum(len(t) - len(passage) for _, t in shared)
