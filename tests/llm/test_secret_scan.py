import random

import pytest
from pyspark.sql import functions as F

from depotlens.llm import secret_scan

SCHEMA = "doc_id long, text string, source string, score string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = ["stable", "window", "garden", "letters", "morning", "traveller", "understanding"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(500):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        issued = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        camel = "".join(rng.choice(words).title() for _ in range(4))
        own = [f'token = "{key}"', f"id {issued} set", f"call {camel}Of now", f"number {rng.randint(10**17, 10**18)} here", some(3)][i % 5]
        rows.append((i, f"{some(20)} {own} {some(10)}", f"s{i % 3}", "x", "y"))
    return spark.createDataFrame(rows + [(None, None, None, None, None), (1, "", "s", "x", "y"), rows[0], (2, "q" * 9000, None, None, None)], SCHEMA)


def test_false_findings_go_and_secrets_stay(docs):
    rows = secret_scan.findings(docs).collect()
    kind = {i: i % 5 for i in range(500)}
    found = {0: [], 1: [], 2: [], 3: [], 4: []}
    for r in rows:
        if r.doc_id in kind:
            found[kind[r.doc_id]].append(r.is_secret)
    assert all(sum(found[k]) > 0.95 * len(found[k]) >= 90 for k in (0, 1))
    assert all(sum(found[k]) < 0.05 * len(found[k]) and len(found[k]) >= 90 for k in (2, 3))


def test_unnamed_keys_are_told_by_their_make(spark, docs):
    """Held out: a key without a name beside it has no label; it is still told from a long word."""
    rows = [(9000, 'x "9f3b0c1d5e7a8842b6d0f1a2c3e4958671bdcafe" y', "s1", "", ""), (9001, "see UnderstandingGardenWindowLetters1 there", "s1", "", "")]
    got = {r.doc_id: r for r in secret_scan.findings(docs.union(spark.createDataFrame(rows, SCHEMA))).filter("doc_id >= 9000").collect()}
    assert got[9000].label is None and got[9000].score > got[9001].score


def test_nothing_to_learn_from(spark, docs):
    assert secret_scan.findings(docs.limit(0)).count() == 0
    assert secret_scan.findings(docs.filter("text LIKE '%number%'")).filter("is_secret").count() == 0


def test_short_values_given_to_names_of_secrets():
    spans = lambda text: [text[a:b] for a, b in secret_scan.candidate_spans(text)]
    assert spans('password = "a8!x.9$k", other') == ["a8!x.9$k"] and spans("api_key: ab~12&34, next") == ["ab~12&34"]
    assert spans("{'secret': 'hunter2.é!'}") == ["hunter2.é!"] and spans("passwd=short") == [] and spans("name = a8!x.9$kk") == []


def test_copies_take_one_place_of_the_sample(spark):
    rng = random.Random(3)
    rows = [(i, f"v{i}", "b", [rng.random(), rng.random()]) for i in range(60)]
    found = spark.createDataFrame(rows, "id long, value string, before string, x array<double>")
    copies = spark.createDataFrame([(1000 + i, *rows[7][1:]) for i in range(300)], found.schema)
    s = secret_scan.Settings(sample=50, trees=3, depth=3)
    label = F.when(F.col("x")[0] > 0.5, 1).otherwise(0)
    score = lambda df: {r.id: r.score for r in secret_scan.judged(df, label, s).filter("id < 1000").collect()}
    assert score(copies.union(found)) == score(found)
