import random
import re

import numpy as np
import pytest

from depotlens.llm import boost, pii

SCHEMA = "doc_id long, text string, n_chars long, spans string, lang string"


def plain_base(text):
    """The base by the plain patterns and finditer."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())][::-1]
        if 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_agrees_with_the_plain_patterns():
    rng = random.Random(1)
    marks = ["a", "é", "@", ".", "-", "+", " ", "1", "25", "255", "256", "007", "(", ")", "_", "%", "x.y", "4111111111111111", "b@c.de", "+1 (743) 555-3824", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "5 " * 100_000):
        pii.base_spans(text)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = boost.boosted(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        kind = i % 4
        number = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        own = [f"mail {i}@mail.example.com", f"call +1 {number}", f"host {rng.randint(1, 255)}.7.{i % 200}.9 up", f"code {rng.randint(10**5, 10**6)} of {i} parts"][kind]
        rows.append((i, f"Some wörds {own} and more.", 10, "x", "en"))
    rows += [(1000, f"Some wörds call +1 (300) 555-{1000 + i} 4{i} and more.", 10, "x", "en") for i in range(40)]
    rows += [(None, None, None, None, None), (5, "", 0, "x", "en"), rows[1], (7, "plain", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_base_stays_and_spans_are_redacted(spark, docs):
    model = pii.train(docs)
    text = {}
    for r in docs.collect():
        text.setdefault((r.doc_id, pii.shown(plain_base(r.text or ""))), r.text or "")
    found = pii.detected(docs, model).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == (len(r.spans.split(",")) if r.spans else 0)
    out = pii.redacted(docs, model)
    assert out.columns == docs.columns and out.schema == docs.schema
    for r in out.collect():
        assert not plain_base(r.text or "")
    assert out.filter("text LIKE '%[PHONE]%'").count() >= 100 and out.filter("text IS NULL AND doc_id IS NULL").count() == 1


def test_empty_table_and_no_candidates(spark, docs):
    empty = docs.limit(0)
    assert pii.detected(empty, pii.train(empty)).count() == 0
    plain = docs.filter("text = 'plain'")
    assert [r.spans for r in pii.detected(plain, pii.train(plain)).collect()] == [""]


def test_overlaps_are_replaced_once():
    assert pii.without("ab 123 cd", [(3, 2, 6), (3, 3, 5), (4, 1, 8)]) == "ab [CARD]d"


def test_copies_and_order_of_rows_change_no_model(spark, docs):
    """A group of copies that alone would fill the sample leaves trees and thresholds as one of them does."""
    text = " ".join(f"+1 (743) 555-{1000 + i}, 12{i}.300.1.7;" for i in range(40))
    others = [(2001 + i, f"Part {300 + i}.1.{i}.400 and order 12-{i % 90 + 10}-{i}.", 1, "x", "en") for i in range(200)]
    once = docs.union(spark.createDataFrame([(2000, text, 1, "x", "en"), *others], SCHEMA))
    copies = spark.createDataFrame([(3000 + i, text, 1, "x", "en") for i in range(1500)], SCHEMA)
    plain, full = pii.train(once), pii.train(copies.union(once).repartition(5))
    assert min(plain.thresholds) < 1 and plain.thresholds == full.thresholds
    x = np.random.default_rng(1).random((50, pii.FEATURES)) * 20
    assert (plain.forest.score(x) == full.forest.score(x)).all()


def test_labels_agree_with_all_pairs():
    rng = random.Random(2)
    marks = ["a", "@", ".", "-", "+", " ", "1", "25", "4111111111111111", "b@c.de", "+1 (743) 555-3824", "1.2.3.4", "743 555 3824"]
    for _ in range(2000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 25)))
        base = pii.base_spans(text)
        for span, y in pii.labelled(text):
            assert y == any(k == span[1] and min(e, span[2]) - max(s, span[0]) >= 0.7 * (e - s) for s, k, e in base)


def test_threshold_is_where_the_precision_still_holds():
    good, bad = np.zeros(pii.BINS, int), np.zeros(pii.BINS, int)
    good[[4000, 3000, 2500]], bad[[3000, 2500]] = [980, 10, 5], [10, 500]
    assert pii.calibrated(good, bad, pii.Settings()) == 3000 / pii.BINS
    assert pii.calibrated(bad * 0, bad, pii.Settings()) == 2.0
