"""The registered queries and the pipeline on the smallest given tables."""

import hashlib
import os
import sys
import zlib

import pytest
import test_leaks
import test_lines
import test_similar

from gaugewright.llm import catalog
from gaugewright.llm import quality as classifier
from gaugewright.llm.common import raw, spaced_words
from gaugewright.llm.tokenizer import TOKENIZER

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")

# The columns that each query must have.
COLUMNS = {
    "op1_language": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_pieces": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_nearest": "query_id rank vec_id score",
    "op4_leaks": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_lines": "doc_id n_lines n_removed kept_sha256",
    "op8_quality": "doc_id held_out score predicted",
    "op9_similar": "doc_id n_shingles component_id",
    "op10_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_prefixes": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_bytepairs": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{FOLDER}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_one_row_per_document(spark, documents, name):
    rows = catalog.QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(rows.columns)
    if "doc_id" in rows.columns:
        assert sorted(r["doc_id"] for r in rows.select("doc_id").collect()) == sorted(documents)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
    from check import duck, rows

    found = catalog.QUERIES[name](spark, FOLDER)
    result = duck(FOLDER).execute(catalog.ORACLES[name])
    assert rows(found.columns, found.collect()) == rows([d[0] for d in result.description], result.fetchall())


def test_folds_and_tokens(spark, documents):
    rows = {r["doc_id"]: r for r in catalog.op1_language(spark, FOLDER).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in documents}
    total = sum(len(spaced_words(t[0])) + 1 for k, t in documents.items() if not held[k])
    assert all(r["held_out"] == held[k] and r["train_tokens"] == total for k, r in rows.items())
    rows = catalog.op8_quality(spark, FOLDER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_pipeline_like_brute_force(spark, documents):
    import corpus_pipeline
    import sentencepiece

    from gaugewright.llm.common import table

    docs = table(spark, FOLDER, "documents")
    labels = table(spark, FOLDER, "labels").collect()
    model = classifier.fit(docs, spark.createDataFrame([r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]))
    import numpy as np

    texts = {k: v[0] for k, v in documents.items() if model.score(np.array([classifier.describe(raw(v[0]))]))[0] >= 0.5}
    cut = test_lines.brute(sorted(texts.items()))
    texts = {k: cut[k][2] for k in texts if not cut[k][3]}
    texts = {k: texts[k] for k, _, c in test_similar.brute(sorted(texts.items())) if k == c}
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    clean = {k for k, *_, bad in test_leaks.brute(sorted(texts.items()), items) if not bad}
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    want = {}
    for k in clean:
        ids = library.encode(texts[k]) + [2]
        want[k] = (ids, hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(got) < len(documents)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), FOLDER).columns == docs.columns
    strange = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "x " * 4000, None, "s", None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, strange, FOLDER).count() <= 3
