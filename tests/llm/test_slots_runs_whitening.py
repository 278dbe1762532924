"""Virtual slots, runs of words, whitening: against brute force and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.llm import periodic, queries, sharding, whitening
from tests.llm import data


def write(df, folder, name):
    df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# ------------------------------------------------------------------ slots
def sizes_of(rows):
    return np.bincount([r.shard for r in rows], [r["size"] for r in rows], 24)


def check_places(rows):
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_slots_deal_every_row_once_and_evenly(spark, tmp_path):
    rows = [(i, data.prose(i, 5 + i % 60)) for i in range(3000)]
    # a third of all rows are one row, and one id has many texts
    rows += [(7, "the same row again and again")] * 1500 + [(8, data.prose(i, 20)) for i in range(500)]
    folder = write(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "documents")
    got = queries.op11_virtual_slots(spark, folder).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted(
        (i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows)
    check_places(got)
    load = sizes_of(got)
    assert load.max() - load.min() <= 0.01 * load.mean()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    # other rows' slots follow from the row alone
    again = queries.op11_virtual_slots(spark, write(spark.createDataFrame(rows[:3000], "doc_id long, text string").repartition(3), tmp_path / "b", "documents"))
    slots = {r.doc_id: r.virtual_slot for r in again.collect()}
    assert all(slots[r.doc_id] == r.virtual_slot for r in got if r.doc_id not in (7, 8))


def test_slots_of_odd_and_no_rows(spark, tmp_path):
    folder = write(data.odd(spark), tmp_path, "documents")
    got = queries.op11_virtual_slots(spark, folder).collect()
    assert len(got) == len(data.odd_rows())
    check_places(got)
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id == 3} == {(8, 0)}
    assert queries.op11_virtual_slots(spark, write(data.odd(spark, []), tmp_path / "e", "documents")).collect() == []


def test_map_versions(spark, tmp_path):
    sizes = np.array([random.Random(i).choice([0, 5, 50, 500]) for i in range(4096)], float)
    first = sharding.SlotMap.even(24)
    second = first.rebalanced(sizes)
    third = second.grown(sizes)
    assert second.version == 2 and np.ptp(second.loads(sizes)) <= 0.001 * second.loads(sizes).mean()
    moved = second.shard_of != third.shard_of
    assert set(third.shard_of[moved]) == {24} and third.shards == 25
    load = third.loads(sizes)
    assert abs(load[24] - load.mean()) <= 500 and load.max() <= second.loads(sizes).max()
    for m in (first, second, third):
        m.store(spark, str(tmp_path / "map"))
    for version, m in ((1, first), (2, second), (None, third)):
        back = sharding.SlotMap.load(spark, str(tmp_path / "map"), version)
        assert (back.shard_of == m.shard_of).all() and (back.version, back.shards) == (m.version, m.shards)


def test_written_shards_hold_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([data.row(i, data.prose(i, 30)) for i in range(200)], data.SCHEMA)
    rows = sharding.records(docs)
    dealt = sharding.assign(rows, sharding.SlotMap.even(5))
    sharding.write_shards(docs, dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.drop("shard").select(docs.columns).collect()) == sorted(docs.collect())
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in dealt.collect()}


# ------------------------------------------------------------------- runs
def brute_runs(words, exponent=4, least=6):
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            seg = words[s : i + p]
            smallest = all(any(a != b for a, b in zip(seg, seg[q:])) for q in range(1, p))
            if len(seg) >= max(least, exponent * p) and smallest:
                out.append((s, len(seg), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(doc_id, text):
    """The contract's words."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_runs(doc_id, text):
    words = repeated(doc_id, text)
    spans = brute_runs(words)
    drop = {i for s, length, p in spans for i in range(s + p, s + length)}
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(spans, key=lambda r: (-r[1], r[0], r[2])) if spans else (None,) * 3
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in spans)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(spans), *best, best[1] and 1000 * best[1] // best[2], sha(lines.encode()), sha(left))


@pytest.mark.parametrize("seed", range(4))
def test_lyndon_arrays_and_runs_against_brute_force(seed):
    r = random.Random(seed)
    for _ in range(400):
        k = r.choice([1, 2, 2, 3, 6])
        codes = [r.randrange(k) for _ in range(r.randint(0, 45))]
        number = {}
        codes = [number.setdefault(c, len(number)) for c in codes]
        for sign in (1, -1):
            ranked = [sign * c for c in codes]
            want = []
            for i in range(len(codes)):
                j = i + 1
                while j < len(codes) and ranked[i:] < ranked[j:]:
                    j += 1
                want.append(j - i)
            letters = sorted(range(len(number)), key=lambda c: -sign * c)
            assert periodic.lyndon_array(codes, letters) == want
        words = [b"%d" % c for c in codes]
        for exponent, least in ((2, 2), (3, 1), (4, 6)):
            assert periodic.runs(words, exponent, least) == brute_runs(words, exponent, least)


def test_runs_query_equals_brute_force(spark, tmp_path):
    rows = data.odd_rows() + [data.row(100 + i, data.prose(i, 40 + i)) for i in range(120)]
    rows += [data.row(300, "na " * 50 + "batman " * 3 + "a b a b a b a b c a b a b"), data.row(301, "x\x0by\x0cx y x\ty x y x y")]
    rows = [r if len(r[1] or "") < 20_000 else data.row(r[0], r[1][:20_000]) for r in rows]  # brute force is quadratic
    folder = write(data.odd(spark, rows), tmp_path, "documents")
    got = [tuple(r) for r in queries.op12_baier_runs(spark, folder).collect()]
    key = lambda r: (r[0] is not None, r[0], r[-1])
    assert sorted(got, key=key) == sorted((expected_runs(r[0], r[1]) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 5
    assert queries.op12_baier_runs(spark, write(data.odd(spark, []), tmp_path / "e", "documents")).collect() == []


def test_long_text_keeps_all_runs(spark):
    words = data.prose(1, 150_000).split()
    words[70_000:70_000] = words[:40] * 6
    docs = data.odd(spark, [data.row(1, " ".join(words))])
    found = periodic.find(docs).first()
    assert [tuple(r) for r in found.runs if r.period == 40] == [(70_000 - 0, 240, 40)] and found.n_words == len(words)
    assert len(found.collapsed.split()) <= len(words) - 200


# -------------------------------------------------------------- whitening
VECTORS = "vec_id long, embedding array<float>, label int, ids string, kind string, cells string, at int"


def vectors(spark, array, odd=()):
    rows = [(i, [float(x) for x in v], 0, "i", "k", "c", 1) for i, v in enumerate(array)]
    return spark.createDataFrame(rows + [(n, v, 0, "i", "k", "c", 1) for n, v in odd], VECTORS)


def whole(array):
    return np.floor(64 * np.asarray(array, np.float32).astype(float)) + 1_000_000


def check_whitening(got, ids, x, k):
    n = len(x)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    values, basis = values[::-1], basis[:, ::-1]
    sums = x.astype(np.int64).sum(axis=0)
    deviation = ((n * x.astype(np.int64) - sums) ** 2).sum(axis=1)
    by_row = {(r.vec_id, r.component): r for r in got}
    assert len(by_row) == len(got) == n * k
    for c in range(1, k + 1):
        rows = [by_row[i, c] for i in ids]
        assert [r.deviation for r in rows] == deviation.tolist() and {r.n for r in rows} == {n}
        want = (x - sums / n) @ basis[:, c - 1] / np.sqrt(values[c - 1])
        mine = np.array([r.whitened for r in rows])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert abs(rows[0].explained / (values[c - 1] / values.sum()) - 1) < 1e-10
    assert {r.identity_error for r in got}.pop() < 1e-10


def test_whitening_equals_a_dense_solver(spark, tmp_path):
    r = np.random.default_rng(3)
    array = (r.standard_normal((400, 48)) * np.linspace(1, 2, 48) * 0.2).astype(np.float32)
    array[300:] = array[200]  # repeated vectors
    odd = [(1000, None), (1001, [1.0] * 47 + [None]), (1002, [float("nan")] * 48), (1003, [float("inf")] + [0.0] * 47)]
    folder = write(vectors(spark, array, odd), tmp_path, "embeddings")
    check_whitening(queries.op13_jacobi_davidson(spark, folder).collect(), range(400), whole(array), 32)


def test_whitening_of_few_dimensions_and_no_vectors(spark, tmp_path):
    array = np.random.default_rng(4).standard_normal((50, 3)).astype(np.float32)
    check_whitening(queries.op13_jacobi_davidson(spark, write(vectors(spark, array), tmp_path, "embeddings")).collect(), range(50), whole(array), 3)
    assert queries.op13_jacobi_davidson(spark, write(vectors(spark, [], [(1, None)]), tmp_path / "e", "embeddings")).collect() == []
    same = queries.op13_jacobi_davidson(spark, write(vectors(spark, [[1.0, 2.0]] * 5), tmp_path / "s", "embeddings")).collect()
    assert len(same) == 10 and {(r.whitened, r.deviation, r.explained, r.identity_error) for r in same} == {(None, 0, 0.0, 0.0)}


def test_leading_pairs_without_filling_the_space():
    """Far more dimensions than the search space holds: rounds, locking and restarts do the work."""
    r = np.random.default_rng(5)
    basis = np.linalg.qr(r.standard_normal((400, 400)))[0]
    values = np.sort(np.concatenate([r.uniform(50, 60, 20), r.uniform(0, 45, 380)]))[::-1]
    values[3] = values[4]  # a double one
    matrix = (basis * values) @ basis.T
    calls = []

    def product(u):
        calls.append(u.shape[1])
        return matrix @ u

    got, vectors_, residuals = whitening.leading(product, 400, 10)
    assert np.abs(got - values[:10]).max() < 1e-11 * 60
    assert np.abs(matrix @ vectors_ - vectors_ * got).max() < 1e-11 * 60 and residuals.max() < 1e-11
    assert np.abs(vectors_.T @ vectors_ - np.eye(10)).max() < 1e-12
    assert len(calls) < 300


def test_deviation_beyond_a_long_is_null():
    rows = np.array([[2**40, 0], [0, 1]], np.int64)
    assert whitening._deviations(rows, 2, [2**40, 1]) == [None, None]
    assert whitening._deviations(rows[1:], 1, [0, 1]) == [0]


def test_vectors_of_two_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="different lengths"):
        whitening.fit(whitening.packed(vectors(spark, [[1.0, 2.0], [1.0]]).withColumn("x", F.lit(1))))
