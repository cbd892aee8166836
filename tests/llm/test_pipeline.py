"""The stages one by one against what the operators say, and the whole run."""

import corpus_pipeline
from loomrow.llm import bpe
from loomrow.llm.common import written


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, data), name)
        kept[name] = docs.count()
        if name != "bpe":
            assert docs.columns == before.columns
    assert 0 < kept["toxicity"] <= 200 and kept["line_dedup"] == kept["toxicity"]
    assert 0 < kept["jaccard_join"] <= kept["line_dedup"]
    assert kept["bpe"] == kept["mixing"] > 0
    tokenizer = bpe.Tokenizer(open(bpe.default_tokenizer()).read())
    mixed = before.collect()
    want = sorted((r.doc_id, tokenizer.encode(r.text or "")) for r in mixed)
    assert sorted((r.doc_id, r.tokens) for r in docs.collect()) == want


def test_columns_beyond_those_of_documents_stay(spark, data):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "en", "s", 11, 7, None), (2, None, None, None, None, None, "x"), (None, "", "en", "s", 0, 1, "y")],
        "doc_id long, text string, lang string, source string, n_chars long, score int, row string",
    )
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, data)
        if name != "bpe":
            assert after.columns == docs.columns
            docs = written(after, name)
        assert after.count() > 0
