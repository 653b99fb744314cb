import random

import pytest

from depotlens.llm import decontam

SCHEMA = "doc_id long, text string, item_id string, found string"


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 50))) for _ in range(40)]
    items.append("one two three four five six seven eight nine")  # shorter than a mask
    items += ["too short", "", None]
    rows, planted = [], {}
    for i in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 4 == 0:
            k = rng.randrange(41)
            passage = items[k].split()
            for _ in range(len(passage) // 12 if k < 40 else 0):
                passage[rng.randrange(len(passage))] = "Changed,"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.3 else w + "!" for w in passage]
            planted[i] = k
        rows.append((i, " ".join(words), "x", "y"))
    rows += [(None, None, None, None), (7, "", "x", "y"), rows[4]]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), planted


@pytest.mark.parametrize("chars", [8_000_000, 3000])
def test_planted_passages_with_substitutions(case, chars):
    docs, benchmark, planted = case
    rows = decontam.matched(docs, benchmark, decontam.Settings(block_chars=chars), "hits").collect()
    got = {r.doc_id: {f.item_id for f in r.hits} for r in rows if r.hits}
    assert got == {i: {k} for i, k in planted.items()}
    assert len(rows) == 203


def test_clean_documents_stay(case):
    docs, benchmark, planted = case
    kept = decontam.kept(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == 203 - len(planted) - 1  # one planted row stands twice


def test_empty_tables(spark, case):
    docs, benchmark, _ = case
    assert decontam.matched(docs.limit(0), benchmark).count() == 0
    assert decontam.kept(docs, benchmark.limit(0)).count() == docs.count()


def test_pieces_of_an_item_in_neighbouring_rows(spark):
    """Both rows of a passage cut in two are found, also on one diagonal; a passage of neither row is not."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:20]), " ".join(words[20:]), "other text", " ".join(["x", *words[:6]]), " ".join([*words[6:12], "y"])]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: [(f.item_id, f.first, f.words) for f in r.hits] for r in decontam.matched(docs, benchmark, column="hits").collect()}
    assert got == {0: [(1, 0, 20)], 1: [(1, 0, 20)], 2: [], 3: [], 4: []}


def test_short_items_and_short_stretches(spark):
    """Any substitutions of a short item that the verification allows; shorter ones as a whole; eight words on end of a long one."""
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (1, 3, 7, 8, 9, 10, 30)}
    texts = []
    for n, words in items.items():
        if n < 30:
            texts.append((n, words, True))
        for a in range(n if n < 30 else 0):
            one = words[:a] + ["changed"] + words[a + 1:]
            texts.append((n, one, n >= 9))
            texts += [(n, one[:b] + ["changed"] + one[b + 1:], n == 10) for b in range(a)]
    texts += [(30, items[30][11:19], True), (30, items[30][11:18], False)]
    docs = spark.createDataFrame([(i, " ".join(["p", *w, "q"]), "x", "y") for i, (_, w, _) in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {r.doc_id: [f.item_id for f in r.hits] for r in decontam.matched(docs, benchmark, column="hits").collect()}
    assert got == {i: [n] if found else [] for i, (n, _, found) in enumerate(texts)}
