"""Plain versions that the operators are held against."""

import re


def words(text):
    return re.findall(r"[^ \t-\r]+", (text or "").lower())


def gram_set(text, n=5):
    own = words(text)
    return frozenset(tuple(own[i:i + n]) for i in range(max(1, len(own) - n + 1))) if own else frozenset()


def brute_classes(texts, threshold=0.8):
    sets = [gram_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (texts[i] or "") == (texts[j] or "") or a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b) - 1e-12:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def bare(text):
    return re.sub(r"[!-/:-@\[-`{-~\x00-\x20]+", " ", (text or "").lower()).split()


def shares_passage(text, items, n):
    own = bare(text)
    found = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)}
    return any(tuple(w[i:i + n]) in found for w in map(bare, items) for i in range(len(w) - n + 1))
