"""Every operator and stage on nulls, odd and long texts, ties, repeats, empty tables and clashing columns."""

import corpus_pipeline
import pytest

from pixelloom.llm import jaccard, knn, language, lm, packing, pii, quality, toxicity, transducer, vocabulary, wordbpe

BYTE, WORD = vocabulary.public_path("byte_bpe_50k.json"), vocabulary.public_path("word_bpe_49k.json")
LANGUAGES = language.fit([("the of and thing", "en"), ("der die das und", "de")])
OPERATORS = {
    "quality": quality.compression_bands,
    "lm": lm.scores,
    "pii": pii.personal_data,
    "counts": lambda d: transducer.token_counts(d, BYTE),
    "packing": lambda d: packing.pack(d, BYTE),
    "toxicity": lambda d: toxicity.toxicity(d, toxicity.Model(-5.0, {"same": 9.0})),
    "encoded": lambda d: wordbpe.encoded(d, WORD),
    "digests": lambda d: wordbpe.digests(d, WORD),
    "jaccard": jaccard.link_components,
    "language": lambda d: language.identify(d, LANGUAGES),
    "language without model": lambda d: language.identify(d, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(name, odd, empty):
    operator = OPERATORS[name]
    rows = operator(odd).collect()
    if name != "packing":
        assert len(rows) == odd.count()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert operator(empty).collect() == []


def test_defined_results(odd):
    by = lambda rows: [tuple(r) for r in rows]
    lang = {r["doc_id"]: r for r in language.identify(odd, LANGUAGES).collect()}
    assert lang[0]["lang_pred"] == "und" and lang[0]["score"] == 0.0
    counts = transducer.token_counts(odd, BYTE).where("doc_id is null").collect()
    assert by(counts) == [(None, 1, 1, False)]
    linked = jaccard.link_components(odd).collect()
    assert {r["component_id"] for r in linked if r["doc_id"] is None} == {None}
    assert {r["n_shingles"] for r in linked if r["doc_id"] == 4} == {1}
    packed = packing.pack(odd, BYTE).collect()
    assert sum(r["length"] for r in packed if r["start"] == 0 and r["doc_tokens"] == 1) == 2  # null and empty: their ends


def test_learning_from_nothing(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.query(odd, labels).collect()} == {0}
    assert language.query(empty).collect() == []
    nulls = spark.createDataFrame([(None, None, None), (1, None, None), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert len(toxicity.query(odd, nulls).collect()) == odd.count()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(name, odd, empty, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(odd.sparkSession, odd, str(tmp_path))
    if name != "packing":
        assert out.columns == odd.columns
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd.collect()}
    out.collect()
    assert stage(odd.sparkSession, empty, str(tmp_path)).collect() == []


def test_vectors(spark):
    rows = [(0, [1.0, 2.0], "a"), (100, [1.0, 2.0], "b"), (100, [1.0, 2.0], "b"), (200, None, None), (300, [1.0, None], None), (400, [float("nan"), 1.0], None), (500, [1.0], "c"), (None, [1.0, 1.0], "d"), (1, [1e30, 1.0], "e"), (600, [], "f")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = [tuple(r) for r in knn.top_products(vectors).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in found if r[0] == 0] == [(0, 1, 1), (0, 2, 100), (0, 3, 100)]
    assert [r for r in found if r[0] == 0][1][3] == 1024 * 1024 * 5
    assert {r[0] for r in found} == {0, 100}
    assert [r[1:3] for r in found if r[0] == 100] == [(1, 1), (1, 1), (2, 0), (2, 0), (3, 100), (3, 100)]  # each row of 100 asks
    assert knn.top_products(vectors.where("false")).collect() == []
