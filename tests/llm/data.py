"""Rows that every operator must bear, and brute-force versions."""

import collections
import random

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, token string, spans string, ids string, chunk string"
VOCABULARY = "byte_bpe_50k.json"


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = ["an", "the", "ti", "on", "re", "he", "st", "ou", "ly", "ble"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(words))


def row(doc_id, text, lang="en", source="s", n_chars=None):
    return (doc_id, text, lang, source, len(text or "") if n_chars is None else n_chars, "c", "t", "p", "i", "k")


def odd_rows():
    long = prose(1, 30_000)
    edited = prose(2, 200).split()
    edited[100] = "changed"
    return [
        row(1, prose(2, 200)), row(2, " ".join(edited)), row(3, None), row(4, ""), row(5, " \n\t "), row(6, "123 456 %%%"), row(7, "one two"), row(8, "one two"),
        row(9, long), row(10, "É" * 700), row(11, "a" * 5000), row(12, "x <|endoftext|> y'll  \x1c½ 中文 😀"), row(13, prose(3, 90), None, None, None), row(13, prose(3, 90), None, None, None),
        row(None, prose(4, 80)), row(None, prose(4, 80)), row(None, None), row(14, prose(2, 200)), row(15, prose(5, 60) + "\n" + prose(2, 120)),
    ]


def odd(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def components(rows, n, percent):
    """doc_id -> (set size, smallest doc_id reachable), by all pairs that share a shingle."""
    sets, index, links = {}, collections.defaultdict(list), collections.Counter()
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        for s in sets[i]:
            index[s].append(i)
    for v in index.values():
        for a in range(len(v)):
            for b in range(a):
                links[v[b], v[a]] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in links.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def removed(texts, length, keep):
    """Boolean masks of the bytes to remove; texts are in order of preference."""
    places = collections.defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for r, b in enumerate(data):
        for s in range(len(b) - length + 1):
            places[b[s : s + length]].append((r, s))
    masks = [np.zeros(len(b), bool) for b in data]
    for v in places.values():
        for r, s in v if keep == "none" and len(v) > 1 else v[1:]:
            masks[r][s : s + length] = True
    return data, masks
