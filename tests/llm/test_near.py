import random
import re

import pytest

from depotlens.llm import near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, class string"


def sets(text, n=5):
    words = re.findall(r"[^ \t-\r]+", (text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, threshold=0.8):
    """(n_links, class_id) by all pairs."""
    own = [sets(r[1]) for r in rows]
    link = [[i != j and ((rows[i][1] or "") == (rows[j][1] or "") or bool(own[i] & own[j]) and len(own[i] & own[j]) >= threshold * len(own[i] | own[j]) - 1e-12)
             for j in range(len(rows))] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in range(len(rows)) if link[i][j])]) for i in range(len(rows))]
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[label[i]] = min(least.get(label[i], r[0]), r[0])
    return sorted((str(r[0]), str(least.get(label[i])), sum(link[i])) for i, r in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 40, 120)))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            near_copy = list(base)
            for _ in range(rng.randint(0, 3)):
                near_copy[rng.randrange(len(base))] = rng.choice(vocabulary)
            out.append(" ".join(near_copy) + rng.choice(("", " end")))
    out += ["", "", None, "   ", "a b", "a b", "A B", out[0], out[0].upper()]
    rows = [(i, t, "en", "s", len(t or ""), "k", "c") for i, t in enumerate(out)]
    return rows + [(None, out[1], None, None, None, None, None), rows[2], (None, None, None, None, None, None, None)]


def test_agrees_with_all_pairs(spark, rows):
    got = near.joined(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute(rows)


def test_blocks_of_a_large_component_agree(spark, rows):
    got = near.joined(spark.createDataFrame(rows, SCHEMA), near.Settings(block_texts=2)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute(rows)


def test_one_row_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = near.kept(docs)
    assert kept.columns == docs.columns
    classes = {c for _, c, _ in brute(rows)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(classes)


def test_one_of_rows_that_are_the_same_stays(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(7, text), (7, text), (7, text), (None, text), (9, "other"), (None, None), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.text)) for r in near.kept(docs).collect()) == [("7", text), ("9", "other"), ("None", "None")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near.joined(docs).count() == 0 and near.kept(docs).count() == 0


def test_bands_reach_the_recall():
    bands, width = near.bands_for(near.Settings())
    assert 1 - (1 - 0.8 ** width) ** bands >= 0.999 and bands * width <= 96
