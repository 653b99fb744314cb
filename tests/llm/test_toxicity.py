import random

import numpy as np
import pytest

from depotlens.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score string"
INSULTS, GROUPS = ["dolt", "oaf"], ["rowers", "bakers"]


def area(scores, labels):
    high, low = scores[labels == 1], scores[labels == 0]
    return np.mean([(low < h).mean() + 0.5 * (low == h).mean() for h in high])


@pytest.fixture(scope="module")
def case(spark):
    """Label 1 needs an insult and a group: what weights of single terms can't tell."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        words = [f"n{rng.randrange(300)}" for _ in range(rng.randint(3, 40))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += [rng.choice(INSULTS)] * insult + [rng.choice(GROUPS)] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(insult and group)))
    rows += [(None, None, None, None), (3, "", "x", "y"), rows[5]]
    labels += [(None, 0, 1), (9_999, 1, None), (5, 1, labels[5][2])]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pairs_are_learned(case):
    docs, labels = case
    scored = toxicity.scored(docs, toxicity.train(docs, labels))
    assert scored.count() == docs.count() and scored.columns == ["doc_id", "text", "lang", "score"]
    own = {r.doc_id: r.toxic for r in labels.filter("toxic IS NOT NULL AND doc_id < 1500").collect()}
    held = [r for r in scored.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 AND text <> ''").collect()]
    assert area(np.array([r.score for r in held]), np.array([own[r.doc_id] for r in held])) > 0.97


def test_rejected_documents_go(case):
    docs, labels = case
    kept = toxicity.kept(docs, labels)
    assert kept.columns == docs.columns
    text = [r.text or "" for r in kept.collect()]
    both = sum(any(w in INSULTS for w in t.split()) and any(w in GROUPS for w in t.split()) for t in text)
    assert both < 20 and len(text) > 1000


def test_labels_of_one_kind_or_none(spark, case):
    docs, labels = case
    assert all(r.score < 1e-12 for r in toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).collect())
    assert all(r.score > 1 - 1e-12 for r in toxicity.scored(docs, toxicity.train(docs, labels.filter("toxic = 1"))).collect())
    assert toxicity.scored(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_a_repeated_labelled_id_takes_one_place(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(500)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 6, 7)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, toxicity.Settings()).collect()
    assert len(rows) <= 2 and len({r.label for r in rows}) == len(rows)
