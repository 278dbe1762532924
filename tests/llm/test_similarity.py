import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourloom.llm import contamination, graph, jaccard, suffix
from tests.llm.data import components, odd, odd_rows, prose, removed, row


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def near_copies(seed, copies, words, first):
    r, base = random.Random(seed), prose(seed, words).split()
    out = []
    for i in range(copies):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"edit{r.randrange(40)}"
        out.append(row(first + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_links_equal_all_pairs(spark, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard, "CHUNK", 20)  # several chunks for one leader
    rows = near_copies(7, 70, 60, 100) + near_copies(8, 30, 100, 300) + [row(500 + i, prose(50 + i, 40) + " " + prose(9, 30)) for i in range(30)] + [r for r in odd_rows() if r[0] is not None and r[0] != 13]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(odd(spark, rows), n, percent, sketch_bits=12).collect()}
    assert got == components([(r[0], r[1]) for r in rows], n, percent)


def test_tokens_of_one_class_alone_are_counted_over_groups():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(12)]
    sets = [np.unique(np.r_[x[:200], sets[i // 2][200:]]) for i, x in enumerate(sets)]
    packets = []
    for part in range(3):
        own = range(part, 12, 3)
        packets += [(part, *p) for p in jaccard._packets(part, list(own), [sets[i] for i in own], 4)]
    got = {}
    for at in range(16):
        rows = [p for p in packets if p[1] == at]
        if not rows:
            continue
        met = jaccard._alone(pa.table({"part": [p[0] for p in rows], "tokens": [p[2] for p in rows], "owners": [p[3] for p in rows]}))
        for part, owners in zip(met["part"].to_pylist(), met["owners"].to_pylist(), strict=True):
            for o in np.frombuffer(owners, "<u2"):
                got[part + 3 * int(o)] = got.get(part + 3 * int(o), 0) + 1
    seen, many = np.unique(np.concatenate(sets), return_counts=True)
    alone = set(seen[many == 1].tolist())
    assert got == {i: sum(t in alone and t % 2 == 0 for t in x.tolist()) for i, x in enumerate(sets)}
    names = pa.table({"part": [p[0] for p in packets if p[1] < 0], "tokens": [p[2] for p in packets if p[1] < 0], "owners": [p[3] for p in packets if p[1] < 0]})
    assert sorted(x for i in range(3) for x in jaccard._open_classes(90)(names.slice(i, 1))["class"].to_pylist()) == list(range(12))  # none alone: all stay


def test_one_of_each(spark):
    kept = jaccard.one_of_each(odd(spark))
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")[1:2] for r in kept.collect())
    assert [i for (i,) in ids] == [0, 0, 1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 15]  # missing ids: the repeated text once, and the row without text
    assert kept.columns == odd(spark).columns
    assert jaccard.one_of_each(odd(spark, [])).count() == 0


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeated_spans_equal_brute_force(spark, monkeypatch, keep):
    monkeypatch.setattr(suffix, "SLICE", 3000)
    monkeypatch.setattr(suffix, "ORDERED", 4000)
    r = random.Random(3)
    passage, other = prose(11, 40), "é" + prose(12, 25)
    texts = [prose(20 + i, 30) + (passage[r.randrange(30) :] if i % 3 else other) + prose(60 + i, 20) for i in range(40)] + [passage, passage, "ab" * 300, "a" * 500, None, "", passage + passage]
    rows = [row(i, t) for i, t in enumerate(texts)]
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix.summaries(odd(spark, rows), 50, keep).collect()}
    data, masks = removed(texts, 50, keep)
    for i, (b, m) in enumerate(zip(data, masks, strict=True)):
        rest = bytes(np.frombuffer(b, np.uint8)[~m])
        spans = int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
        assert got[i] == (len(b), int(m.sum()), spans, hashlib.sha256(rest).hexdigest()), i
    cut = {x["doc_id"]: x["text"] for x in suffix.remove(odd(spark, rows), 50, keep).collect()}
    assert all((cut[i] or "") == bytes(np.frombuffer(b, np.uint8)[~m]).decode("utf-8", "ignore") for i, (b, m) in enumerate(zip(data, masks, strict=True)))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_anchors_equal_brute_force(spark, monkeypatch, keep):
    monkeypatch.setattr(suffix, "HOT", 5)
    taken, whole = [], suffix._find
    ordered = spark.sparkContext.accumulator(0)

    def watched(length, keep):
        run = whole(length, keep)

        def count(batches):
            for batch in batches:
                ordered.add(max(np.unique(batch.column("anchor").to_numpy(), return_counts=True)[1], default=0) > 5)
                yield batch

        return lambda batches: run(count(batches))

    monkeypatch.setattr(suffix, "_find", watched)
    monkeypatch.setattr(suffix, "_of_hot", lambda *a, f=suffix._of_hot: taken.append(f(*a)) or taken[-1])
    passage = prose(11, 12)[:60]
    texts = [prose(20 + i, 15) + passage + prose(90 + i, 15) for i in range(40)] + [prose(12, 30)] * 2 + [prose(5, 9) + prose(12, 30)]
    rows = [row(i, t) for i, t in enumerate(texts)]
    cut = {x["doc_id"]: x["text"] for x in suffix.remove(odd(spark, rows), 50, keep).collect()}
    data, masks = removed(texts, 50, keep)
    assert all(cut[i].encode() == bytes(np.frombuffer(b, np.uint8)[~m]) for i, (b, m) in enumerate(zip(data, masks, strict=True)))
    assert taken and taken[0].select("text_hash").distinct().count() >= 39 and taken[0].count() <= 3 * len(texts) and ordered.value == 0


@pytest.mark.parametrize("keep", ["none", "first"])
def test_anchors_met_everywhere_stay_in_place(spark, monkeypatch, keep):
    """All ways of looking up repeated anchors at once: looked up in the task, dealt by anchor, hot and not."""
    monkeypatch.setattr(suffix, "SPREAD", 8)
    passage = prose(11, 60)
    texts = [prose(20 + i, 15) + passage + prose(90 + i, 15) for i in range(30)] + [prose(5, 9) + prose(12, 30), prose(12, 30) + prose(6, 9)]
    rows = [row(i, t) for i, t in enumerate(texts)]
    cut = {x["doc_id"]: x["text"] for x in suffix.remove(odd(spark, rows), 50, keep).collect()}
    data, masks = removed(texts, 50, keep)
    assert all(cut[i].encode() == bytes(np.frombuffer(b, np.uint8)[~m]) for i, (b, m) in enumerate(zip(data, masks, strict=True)))


CLASHING = ["_key", "_lang", "_rows", "_hash", "_first", "_spans", "_later", "text_hash", "first_id", "n_rows", "later", "spans", "document_key", "class", "token", "root", "lang_pred"]


def test_columns_may_have_any_name(spark):
    """Helper columns get out of the way of the table's own ones, which come through with their values."""
    import corpus_pipeline as cp

    text = prose(31, 120)
    docs = spark.createDataFrame([(1, text, "en"), (2, text + " more", "en"), (3, prose(32, 90), "en")], "doc_id long, text string, lang string")
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(c), "doc_id"))
    for name, stage in cp.STAGES[:3]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in CLASHING), name


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline as cp

    passages = [prose(400 + n, n) for n in range(51, 61)] + [" ".join("abcdefghijklmnopqrstuvwxyz"[(i * i + i // 7) % 26] for i in range(51)), " ".join(f"w{i}" for i in range(80))]
    assert min(map(len, passages)) == cp.WINDOW_BYTES
    short = prose(470, 40)
    rows = [row(100 * k + i, f"{prose(900 + 50 * k + i, 30)} {p} {prose(2000 + 50 * k + i, 30)}") for k in (0, 1) for i, p in enumerate([*passages, short])]
    cut = {r["doc_id"]: r["text"] for r in cp.repeated_spans(spark, odd(spark, rows), "").collect()}
    for i, p in enumerate(passages):
        assert p in cut[i] and len(cut[100 + i]) <= len(rows[len(passages) + 1 + i][1]) - len(p), i
    assert short in cut[len(passages)] and short in cut[100 + len(passages)]


def test_spans_of_odd_rows(spark):
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix.summaries(odd(spark), 400, "none").collect()}
    assert got[11, 5000] == 5000 and got[10, 1400] == 1400 and got[3, 0] == 0
    whole = len(prose(2, 200))
    assert got[1, whole] == got[14, whole] == whole  # equal texts
    copy = len(prose(3, 90))
    assert got[13, copy] == copy  # a repeated row starts elsewhere too
    assert suffix.summaries(odd(spark, []), 400, "none").count() == 0


def test_repeated_rows_keep_the_first_copy(spark):
    passage = prose(71, 100)
    first, other = prose(72, 30) + " " + passage + " " + prose(73, 30), prose(74, 30) + " " + passage + " " + prose(75, 30)
    got = [(r["doc_id"], r["text"]) for r in suffix.remove(odd(spark, [row(1, first), row(1, first), row(2, other)]).coalesce(1), 400, "first").collect()]
    assert sorted(got)[:2] == [(1, first)] * 2
    assert got != [] and passage not in dict(got)[2] and len(dict(got)[2]) < len(other)


def test_items_in_documents_equal_all_pairs(spark):
    r = random.Random(5)
    items = [(i, prose(100 + i, w)) for i, w in enumerate([5, 6, 9, 17, 33, 70, 150])] + [(7, "too short item"), (8, None), (9, ""), (5, prose(100, 5))]
    rows = []
    for i in range(60):
        words = prose(300 + i, 400).split()
        item = items[i % 7][1].split()
        if i % 4 == 1:
            item[len(item) // 2] = "changed"
        if i % 5 == 2:
            item = [w.upper() + "," for w in item]
        at = r.randrange(400)
        rows.append(row(i, " ".join(words[:at] + item + words[at:]) if i % 10 else " ".join(words)))
    rows += [(x[0] and x[0] + 1000, *x[1:]) for x in odd_rows()]
    docs, bench = odd(spark, rows), spark.createDataFrame(items, "item_id long, text string")

    def shingles(text):
        w = contamination.WORDS.findall((text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = []
    for doc_id, text, *_ in rows:
        own = shingles(text)
        for item_id, item in items:
            s = shingles(item)
            if s and 100 * len(s & own) >= 80 * len(s):
                want.append((doc_id, item_id, len(s), len(s & own)))
    got = [tuple(x) for x in contamination.leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 40
    dirty = {w[0] for w in want}
    assert None not in dirty
    assert sorted((x["doc_id"] for x in contamination.clean(docs, bench).collect()), key=str) == sorted((x[0] for x in rows if x[0] not in dirty), key=str)
    assert contamination.leaks(docs, bench.limit(0)).count() == 0 and contamination.leaks(odd(spark, []), bench).count() == 0
