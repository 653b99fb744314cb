"""The registered queries over whole small tables, against plain versions or DuckDB."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import test_alignment
import test_lm
import test_packing
import test_pii
import test_variants
import tiktoken
from tests_llm_brute import brute_classes, shares_passage
from tokenizers import Tokenizer

import __spark_entry__ as entry
from check_oracle import normal, table
from depotlens.llm import alignment, bpe, lm, queries


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def test_all_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_op1(spark, folder, docs):
    got = sorted((str(r.doc_id), *r[1:]) for r in queries.op1_lm_scoring(spark, folder).collect())
    want = test_lm.brute([(r.doc_id, r.text) for r in docs], lm.Settings())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=1e-3)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # better than the base on texts it hasn't seen


def test_op2(spark, folder):
    got = queries.op2_secret_scan(spark, folder).collect()
    assert got and all(0 <= r.score <= 1 and r.end - r.start == r.length for r in got)
    assert all(r.is_secret == bool(r.label) for r in got if r.label is not None)


def test_op3(spark, folder, docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, folder).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_op4(spark, folder, docs):
    least = {}
    classes = brute_classes([r.text for r in docs])
    for r, c in zip(docs, classes, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    got = queries.op4_ngram_jaccard_join(spark, folder).collect()
    assert {r.doc_id: r.class_id for r in got} == {r.doc_id: least[c] for r, c in zip(docs, classes, strict=True)}
    assert all((r.n_links > 0) == (r.class_size > 1) for r in got)


def test_op5(spark, folder, docs):
    got = {r.doc_id: r for r in queries.op5_token_counts(spark, folder).collect()}
    cut = bpe.compiled(public_tokenizers.PATTERN)
    assert {i: r.n_pre_tokens for i, r in got.items()} == {r.doc_id: len(cut.findall(r.text or "")) for r in docs}
    assert all(r.n_tokens >= r.n_pre_tokens for r in got.values())


def test_op6(spark, folder, docs):
    from depotlens.llm import pii

    got = {r.doc_id: r for r in queries.op6_personal_data(spark, folder).collect()}
    for r in docs:
        base = test_pii.plain_base(r.text or "")
        counts = [sum(s[1] == k for s in base) for k in range(4)]
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == counts
        assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert not base or set(pii.shown(base).split(",")) <= set(got[r.doc_id].spans.split(","))


def test_op7(spark, folder):
    df = queries.op7_warc_revisits(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    cur = con.execute(queries.ORACLES["op7_warc_revisits"])
    want = table([c[0] for c in cur.description], cur.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want and len(want[1]) and normal(None) == "NULL"


def test_op8(spark, folder, docs):
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, folder).collect()}
    assert {i: r.held_out for i, r in got.items()} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_op9(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op9_inverted_multi_index(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    found = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((ids, d)) if j != i][:10]
        found.append(len({int(ids[j]) for j in want} & {v for v, _ in got[int(ids[i])]}) / len(want))
        assert all(s == pytest.approx(d[ids == v][0]) for v, s in got[int(ids[i])])
    assert np.mean(found) >= 0.9


def test_op10(spark, folder, docs):
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {r.doc_id for r in queries.op10_decontamination(spark, folder).collect()}
    assert {r.doc_id for r in docs if shares_passage(r.text, items, 11)} <= got <= {r.doc_id for r in docs if shares_passage(r.text, items, 4)}


def test_op11(spark, folder, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert test_packing.checked(queries.op11_sequence_packing(spark, folder).collect(), {r.doc_id: r.text for r in docs}, library) < 0.02


def test_op12(spark, folder, docs):
    both = alignment.Tokenizers.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    got = queries.op12_tokenizer_alignment(spark, folder).collect()
    assert len(got) == len(docs) and test_alignment.shown(got) == test_alignment.plain({r.doc_id: r.text for r in docs}, both)


def test_op13(spark, folder, docs):
    assert test_variants.rows_of(queries.op13_spelling_variants(spark, folder)) == test_variants.brute([(r.doc_id, r.text) for r in docs])
