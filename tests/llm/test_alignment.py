import hashlib
from collections import Counter

import public_tokenizers
import pytest

from depotlens.llm import alignment

NASTY = [
    "", None, "a\r\n b", "a \n b　 c", "x▁ y", "\n\nlead", "  two  spaces \n", "tab\tx\r", "é ﬁ ½ ​", "日本語のテキスト。 次", "<|endoftext|> <s> </s> <unk>",
    "\x00 a\x01b", "emoji 😀 😀", "a;\r\rb \r c", "don't 's ' s", "\x85 a\x1c b\x1f", " ́x", "   ", "\t", "\n", "a\x0bb\x0c c", "  a  b", "x" * 20_000, "So  it goes  \n on", "word " * 5000]


@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def plain(texts, tok):
    """{doc: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)} over whole texts, token by token."""
    made, counts = {}, Counter()
    for doc, text in texts.items():
        a = tok.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tok.model.encode(text) if text else []
        if not text or not b"".join(tok.a_bytes[i] for i in a) == b"".join(tok.b_bytes[i] for i in b) == (" " + text).encode():
            made[doc] = ([], [], [], "")
            continue
        ends = []
        for ids, of in ((a, tok.a_bytes), (b, tok.b_bytes)):
            at, own = 0, {}
            for k, i in enumerate(ids):
                at += len(of[i])
                own[at] = k
            ends.append(own)
        links = [(a[ends[0][e]], b[ends[1][e]]) for e in sorted(ends[0].keys() & ends[1].keys())]
        groups, p, q = [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            groups.append(",".join(map(str, a[p:ends[0][e] + 1])) + "|" + ",".join(map(str, b[q:ends[1][e] + 1])))
            p, q = ends[0][e] + 1, ends[1][e] + 1
        counts.update(links)
        made[doc] = (a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return {d: (len(a), len(b), len(li), len(li), sum(counts[x] == most[x[1]] for x in li), sum(counts[x] for x in li), h) for d, (a, b, li, h) in made.items()}


def shown(rows):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}


def test_rows(spark, tok):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(NASTY)], "doc_id long, text string, n_links string")
    assert shown(alignment.aligned(docs, tok).collect()) == plain(dict(enumerate(NASTY)), tok)
    twice = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1)], "doc_id long, text string, pairs int")
    assert [(r.doc_id, r.n_links, r.count_sum) for r in alignment.aligned(twice, tok).collect()] == [(None, 2, 4)] * 2
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), tok).count() == 0


def test_overlaps(tok):
    """Against every pair of byte ranges."""
    import pyarrow as pa

    texts = ["Überraschung 12,345 days, naïve café", "the cat \t sat", "日本語 text"]
    found = alignment.Aligned(pa.array(texts), tok)
    for k, text in enumerate(texts):
        sides = []
        for ids, of in ((tok.tokenizer.encode(" " + text, add_special_tokens=False).ids, tok.a_bytes), (tok.model.encode(text), tok.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of[i])))
                at += len(of[i])
            sides.append(own)
        assert found.n_overlaps[k] == sum(p < s and r < q for p, q in sides[0] for r, s in sides[1])


def test_linkable_holds_all_that_end_together(tok):
    keys = alignment.linkable(tok)
    b_size = len(tok.b_bytes)
    some = set(keys[::997].tolist())
    assert all((lambda x, y: x.endswith(y) or y.endswith(x))(tok.a_bytes[k // b_size], tok.b_bytes[k % b_size]) for k in some)
