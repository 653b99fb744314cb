import public_tokenizers
import tiktoken

import corpus_pipeline
from depotlens.llm import bpe, decontam, near, pii
from tests_llm_brute import brute_classes, shares_passage


def test_stages_over_the_small_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    own = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = own.collect()
        own = stage(spark, own, folder)
        assert own.columns == columns
        own = spark.createDataFrame(own.collect(), docs.schema)
        kept[name] = (before, own.collect())
    before, after = kept["toxicity"]
    assert 0.7 * len(before) <= len(after) <= len(before)
    before, after = kept["ngram_jaccard_join"]
    classes = brute_classes([r.text for r in before])
    ids = {}
    for r, c in zip(before, classes, strict=True):
        ids[c] = min(ids.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(ids.values())
    before, after = kept["benchmark_decontamination"]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {r.doc_id for r in before if shares_passage(r.text, items, 11)} <= gone <= {r.doc_id for r in before if shares_passage(r.text, items, 4)}
    before, after = kept["personal_data"]
    assert len(before) == len(after) and not any(pii.base_spans(r.text) for r in after)
    clean = {r.doc_id: r.text for r in before if not pii.candidates(r.text)}
    assert clean and all(r.text == clean[r.doc_id] for r in after if r.doc_id in clean)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rows = corpus_pipeline.run(spark, folder).collect()
    text = {r.doc_id: r.text for r in after}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(r.round_trip and r.ids == library.encode_ordinary(text[r.doc_id]) for r in rows)


def test_odd_rows_pass_all_stages(spark, folder):
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 30_000, "en", "s", 60_000)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 2  # the empty ones are copies of each other
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), folder).count() == 0
