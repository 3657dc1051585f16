"""Every registered query, and the pipeline, over the whole tables of the smallest test data."""

import os

import corpus_pipeline
import duckdb
import pytest

from pixelloom.llm import oracle, queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op2": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op3": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op4": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op5": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op6": {"doc_id", "held_out", "score", "predicted"},
    "op7": {"query_id", "rank", "vec_id", "score"},
    "op8": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9": {"doc_id", "n_shingles", "component_id"},
    "op10": {"doc_id", "held_out", "lang_pred", "score"},
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", queries.queries())
def test_queries(spark, name):
    df = queries.queries()[name](spark, SF)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    if name in queries.oracle_sql():
        assert compare(spark, duck(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) is None
        return
    ids = [r[0] for r in duckdb.execute(f"SELECT doc_id FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()]
    rows = df.collect()
    found = [r["doc_id"] for r in rows]
    assert sorted(set(found)) == ids if name.startswith("op5") else sorted(found) == ids
    if name.startswith("op2"):  # what the model learned beats the words' own frequencies on texts it did not see
        held = [r for r in rows if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    if name.startswith("op10"):
        lang = dict(duckdb.execute(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
        assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in rows)
    if name.startswith("op5"):
        places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
        for (s, a, n), (t, b, _) in zip(places, places[1:]):
            assert b == (a + n if s == t else 0)


def test_pipeline(spark):
    """The pipeline's rows are those of its stages one after the other, and its decisions those of the operators."""
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in queries.op1_compression_bands(spark, SF).collect() if r["kept"]}
    group = {r["doc_id"]: r["component_id"] for r in queries.op9_universe_partition_join(spark, SF).collect()}
    found = {r["doc_id"] for r in rows}
    assert found <= kept and len({group[i] for i in found}) == len(found)
    assert {group[i] for i in kept if texts[i]} - {group[i] for i in found} <= {group[i] for i in kept - {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, SF).collect()}}
    assert oracle.JACCARD and corpus_pipeline.ORACLE_SQL is None
