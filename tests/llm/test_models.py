import collections
import math

import numpy as np
import pytest
import xxhash
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hourloom.llm import cotrain, language, lm, rules, warc
from hourloom.llm.common import fold, scratch
from tests.llm.data import odd, odd_rows, prose, row, vocabulary

SF = "/root/testdata/sf0.01"


def test_rank_order_profiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs.where(fold("doc_id", 4) != 2), 300)
    held = language.identify(docs.where(fold("doc_id", 4) == 2), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    # the profiles themselves, by plain counting
    count = collections.defaultdict(collections.Counter)
    for r in docs.where(fold("doc_id", 4) != 2).collect():
        text = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in r["text"]).split()) + " "
        for n in (1, 2, 3):
            grams = [text[i : i + n] for i in range(len(text) - n + 1)]
            count[r["lang"]].update(g for g in grams if g != " " and not (n == 3 and g[1] == " "))
    for i, lang in enumerate(model.langs):
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        best = sorted(count[lang].items(), key=lambda x: (-x[1], code(x[0])))[:300]
        rank = {int(g): int(model.ranks[k, i]) for k, g in enumerate(model.grams) if model.ranks[k, i] < 300}
        assert rank == {code(g): k for k, (g, _) in enumerate(best)}


def test_language_of_odd_rows(spark):
    model = language.learn(odd(spark), 50)
    got = language.identify(odd(spark), model).collect()
    assert len(got) == len(odd_rows())
    none = [r for r in got if r["doc_id"] in (3, 4, 5, 6)]
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in none) and all(0 <= r["score"] <= 1 for r in got)
    empty = language.learn(odd(spark, []), 50)
    assert {r["lang_pred"] for r in language.identify(odd(spark), empty).collect()} == {"und"}
    assert language.identify(odd(spark, []), model).count() == 0


def test_rule_statistics_by_hand():
    assert rules.statistics("a b c a b c\nx # y\nx # y\n\n \n")[:5] == (12, 12, 2, 1, 12)
    assert rules.statistics("") == (0, 0, 0, 0, 0, 0)
    for seed in range(30):
        text = prose(seed % 5, 30) + "\n" + prose(seed % 3, 10) + "  " + prose(seed, 5) * 2
        w = text.split()
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        assert rules.statistics(text)[4] == len(covered)


def test_forest_sets_outliers_apart_and_bears_odd_rows(spark):
    rng = np.random.default_rng(1)
    forest = rules.Forest(rng.normal(size=(500, 3)))
    assert forest.score(np.array([[8.0, 8, 8]]))[0] > forest.score(np.zeros((1, 3)))[0] + 0.1
    assert rules.best_threshold(np.array([0.1, 0.2]), np.array([0.8, 0.9])) == 0.2
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 16)] + [(None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    got = rules.judge(odd(spark), rules.fit(odd(spark), labels)).collect()
    assert len(got) == len(odd_rows()) and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    without = rules.judge(odd(spark), rules.fit(odd(spark), labels.limit(0))).collect()
    assert all(r["kept"] != r["base_failed"] for r in without)
    assert rules.judge(odd(spark, []), rules.fit(odd(spark, []), labels)).count() == 0


def test_quality_rules_on_labelled_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = rules.judge(docs, rules.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) >= 0.85 and np.mean(bad) <= 0.15


def test_cotraining(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    heads = cotrain.fit(docs, labels, fit_rows=1000)
    got = cotrain.score(docs, heads).join(labels, "doc_id").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    low = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(clean) >= 0.85 and np.mean(low) <= 0.1
    assert cotrain.score(odd(spark), heads).count() == len(odd_rows())
    nothing = cotrain.score(odd(spark), cotrain.fit(odd(spark), labels.limit(0)))
    assert nothing.where("kept and p_toxic is null").count() == len(odd_rows())
    assert cotrain.score(odd(spark, []), heads).count() == 0


def test_archive_gives_back_every_page(spark):
    big = "<p>" + "x" * 200 + "</p>"
    pages = [(5, "http://a/\r\nX: 1", big, 1), (3, None, big, 1), (9, "u", big, 1), (4, "u", "tiny", 1), (6, "u", "tiny", 1), (7, "u", None, 1), (None, "u", big, 1), (8, "ü", "é" * 60, 1), (8, "ü", "é" * 60, 1)]
    folder = scratch(spark, "warc-test")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string, digest int"), folder, "2024-01-01T00:00:00Z")
    read = warc.records(spark, folder)
    got = sorted((tuple(r) for r in warc.summaries(read).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    n = len(big)
    want = [(5, n, "revisit", 3), (3, n, "response", None), (9, n, "revisit", 3), (None, n, "revisit", 3), (4, 4, "response", None), (6, 4, "response", None), (7, 0, "response", None), (8, 120, "response", None), (8, 120, "response", None)]
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    for r in read.collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert bytes(r["header"]) == head + b"\r\n\r\n" and body == (bytes(r["payload"]) if length else b"") + b"\r\n\r\n"
        assert b"\nX: 1" not in head
    spark.createDataFrame([("00", bytearray(b"broken"))], "digest string, payload binary").write.parquet(f"{folder}/bad/payloads")
    spark.createDataFrame([(1, "00", bytearray(b"WARC/1.1\r\n"))], "page_id long, digest string, header binary").write.parquet(f"{folder}/bad/headers")
    with pytest.raises(PySparkException, match="damaged payload"):
        warc.records(spark, f"{folder}/bad").collect()
    none = scratch(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), none, "2024-01-01T00:00:00Z")
    assert warc.summaries(warc.records(spark, none)).count() == 0


def by_hand(model, inputs, targets):
    """log10 probabilities of the target classes of one window, place by place."""
    w = {n: x.astype(np.float64) for n, x in model.w.items()}
    x = w["e"][np.maximum(inputs, 0)] + w["p"]
    out = []
    for s, target in enumerate(targets):
        at = lm.WINDOW - lm.STRIDE + s
        if target < 0:
            out.append(0.0)
            continue
        seen = [j for j in range(at + 1) if inputs[j] >= 0]
        mass = np.exp([x[at] @ w["a"] @ x[j] * float(lm.SCALE) for j in seen])
        h = x[at] + sum(m * x[j] for m, j in zip(mass / mass.sum(), seen, strict=True)) @ w["v"]
        outer, f = np.exp(h @ w["g"] + w["c"]), target // lm.MEMBERS
        inner = np.exp(h @ w["m"][f] + w["d"][f])
        out.append(math.log10(outer[f] / outer.sum() * inner[target % lm.MEMBERS] / inner.sum()))
    return np.array(out)


def test_attention_gradients_and_scoring():
    rng = np.random.default_rng(2)
    model = lm.Attention()
    model.w = {n: rng.normal(size=x.shape) * 0.3 for n, x in model.w.items()}
    inputs = rng.integers(-1, 40, (3, lm.WINDOW))
    inputs[:, 0] = 3
    inputs[:, -lm.STRIDE :] = np.maximum(inputs[:, -lm.STRIDE :], 0)
    targets = rng.integers(-1, lm.CLASSES, (3, lm.STRIDE))
    for row_in, row_out, got in zip(inputs, targets, model.log_probabilities(inputs, targets), strict=True):
        assert np.allclose(by_hand(model, row_in, row_out), got)

    def loss():
        return -model.log_probabilities(inputs, targets).sum() / (targets >= 0).sum() * math.log(10)

    g = model.gradients(inputs, targets)
    own = int(targets[targets >= 0][0])
    family, member = own // lm.MEMBERS, own % lm.MEMBERS
    for name, at in (("g", (2, 5)), ("c", (7,)), ("m", (family, 4, member)), ("d", (family, member)), ("a", (1, 1)), ("a", (0, 3)), ("v", (4, 2)), ("p", (lm.WINDOW - 2, 1)), ("p", (3, 0)), ("e", (3, 2)), ("e", (int(inputs[0, -1]), 5))):
        old = model.w[name][at]
        model.w[name][at] = old + 1e-5
        up = loss()
        model.w[name][at] = old - 1e-5
        down = loss()
        model.w[name][at] = old
        assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=1e-3, abs_tol=1e-7), name
    # every id is scored once, with the context of its window, and probabilities of all ids sum to one
    counts = rng.integers(0, 50, 3000).astype(float)
    classes = lm.Classes(counts)
    assert np.allclose(np.bincount(classes.of, 10.0**classes.share, minlength=lm.CLASSES), 1)
    model = lm.Attention(classes)
    outer, inner = np.exp(model.w["c"]), np.exp(model.w["d"])
    assert np.allclose(outer.sum(), 1) and np.allclose(inner.sum(axis=1), 1)
    whole = np.repeat(inputs[:1], lm.CLASSES, axis=0)
    every = np.full((lm.CLASSES, lm.STRIDE), -1)
    every[:, 5] = np.arange(lm.CLASSES)
    assert math.isclose((10.0 ** model.log_probabilities(whole, every)[:, 5]).sum(), 1, rel_tol=1e-4)
    texts = [rng.integers(0, 3000, n).astype("<u2") for n in (1, lm.STRIDE, lm.STRIDE + 1, 200)]
    for ids, value in zip(texts, model.scores(texts, classes), strict=True):
        inputs, targets, _ = lm.windows(ids, classes.row)
        assert (targets >= 0).sum() == len(ids)
        slow = sum(by_hand(model, i, np.where(t >= 0, classes.of[np.maximum(t, 0)], -1)).sum() for i, t in zip(inputs, targets, strict=True)) + classes.share[ids].sum()
        assert math.isclose(slow, value, rel_tol=1e-4)
    # a long text piece by piece is the same windows
    ids = rng.integers(0, 3000, lm.STRIDE * 4096 + 77)
    inputs, targets, _ = lm.windows(ids, classes.row)
    cut = [np.concatenate(x) for x in zip(*lm.cut(ids, classes), strict=True)]
    assert (cut[0] == inputs).all() and (cut[1] == np.where(targets >= 0, classes.of[np.maximum(targets, 0)], -1)).all()


def test_word_frequencies_over_odd_rows(spark):
    got = lm.score(odd(spark), vocabulary(), fold("doc_id", 7) == 2).collect()
    import zlib

    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in odd_rows()}
    c = collections.Counter(w for r in odd_rows() if not held[r[0]] for w in lm.tokens(r[1] or ""))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r in odd_rows():
        words = lm.tokens(r[1] or "")
        want[r[0], held[r[0]], len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 3)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score(odd(spark, []), vocabulary(), F.lit(False)).count() == 0


def test_chunks_give_back_every_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3_000)  # many chunks; a longer text is one of its own
    run = lm._gather(vocabulary())
    turned = odd(spark).select("doc_id", "text", F.lit(0).alias("turn")).coalesce(1)
    got = turned.mapInArrow(run, "chunk long, place int, name long, n long, doc_id long, ids binary, words binary, turn int").collect()
    names = {(r["chunk"], r["place"]): r["name"] for r in got if r["turn"] == lm.WORD}
    coder, docs = lm.ids_of(vocabulary()), [r for r in got if r["turn"] >= 0]
    assert len({r["chunk"] for r in docs}) > 3
    for r, (_, text, *_rest) in zip(docs, odd_rows(), strict=True):
        words = lm.tokens(text or "")
        assert (np.frombuffer(r["ids"], coder.type) == coder.encode(words)).all()
        assert [names[r["chunk"], x] for x in np.frombuffer(r["words"], "<u4").tolist()] == [int(np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64)) for w in words]
    ids = collections.Counter()
    for _, text, *_rest in odd_rows():
        ids.update(coder.encode(lm.tokens(text or "")).tolist())
    assert {r["name"]: r["n"] for r in got if r["turn"] == lm.ID} == dict(ids)


def test_attention_learns_from_every_window(spark):
    coder = lm.ids_of(vocabulary())
    texts = [coder.encode(lm.tokens(r[1] or "")).astype(coder.type) for r in odd_rows()]
    assert max(map(len, texts)) > 0.9 * sum(map(len, texts)) > 60_000
    docs = spark.createDataFrame([(bytearray(x.tobytes()), i % lm.ROUNDS) for i, x in enumerate(texts)], "ids binary, turn int").repartition(5)
    classes = lm.Classes(np.ones(coder.end + 1))
    before = lm.Attention(classes)
    model = lm._fit(docs, classes, coder.type)
    assert model.windows_seen == sum(-(-len(x) // lm.STRIDE) for x in texts)
    assert all(np.isfinite(x).all() and (x != before.w[n]).any() for n, x in model.w.items())
    held = texts[8]  # the long one was learned from
    assert model.scores([held], classes)[0] > before.scores([held], classes)[0]
    # the mean goes by windows
    n, weights = lm._average((k, np.full(3, x, "<f4").tobytes()) for k, x in ((1, 4.0), (3, 8.0)))
    assert n == 4 and (weights == 7).all()
    again = lm.Attention(seed=1)
    again.load(model.flat())
    assert all((again.w[n] == x).all() for n, x in model.w.items())


def test_pipeline(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "encoding":
            assert docs.columns == columns, name
        assert docs.count() <= before.count()
    assert docs.count() == cp.run(spark, folder).count() > 0.7 * seen.count()
    some = odd(spark, [*odd_rows(), row(77, prose(2, 200))])
    for name, stage in cp.STAGES[:-1]:
        some = stage(spark, some, folder)
        assert some.columns == odd(spark).columns, name
    left = [r["doc_id"] for r in some.collect()]
    assert {1, 9, 10, 12, 13} <= set(left) and not {3, 4, 5, 6, 14, 77} & set(left)


def test_language_stage_without_profiles(spark):
    import corpus_pipeline as cp

    rows = [row(1, prose(2, 20), None), row(2, "123 %", None), row(3, None, None), row(4, "\n 中", None)]
    assert {r["doc_id"] for r in cp.by_language(spark, odd(spark, rows), "").collect()} == {1, 4}


def test_a_step_of_attention_goes_over_all_weights_at_once():
    """op8: weights, gradients and moments lie in flat arrays; a pass over the same windows gives what a step weight by weight gives."""
    rng = np.random.default_rng(5)
    classes = lm.Classes(rng.integers(0, 50, 3000).astype(float))
    inputs, targets = (np.concatenate(x) for x in zip(*lm.cut(rng.integers(0, 3000, 100 * lm.STRIDE), classes), strict=True))
    model, other = lm.Attention(classes), lm.Attention(classes)
    assert all(x.base is model.every or np.shares_memory(x, model.every) for x in model.w.values()) and model.flat().size == sum(x.size for x in model.w.values())
    assert model.train(iter([(inputs, targets)]), 0.02, 9) == 100
    order = np.random.default_rng(9).permutation(100)
    m, v = ({n: np.zeros_like(x) for n, x in other.w.items()} for _ in range(2))
    for t, at in enumerate(range(0, 100, lm.BATCH), 1):
        some = order[at : at + lm.BATCH]
        step = 0.02 * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for n, g in other.gradients(inputs[some], targets[some]).items():
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.99 * v[n] + 0.01 * g * g
            other.w[n] -= step * m[n] / (np.sqrt(v[n]) + 1e-7)
    assert all(np.allclose(model.w[n], other.w[n], atol=1e-5) for n in model.w)
    before = model.flat()
    other.load(before)
    assert (other.flat() == before).all() and all((other.w[n] == x).all() for n, x in model.w.items())
