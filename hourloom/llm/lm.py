"""Log probabilities of texts: add-one word frequencies, and a causal self-attention model over subword ids.

The words of a text (A-Z in lower case, cut at ASCII white space) and one end are its tokens. Every text is cut and encoded once: a task stores chunks of bounded size, the ids and the numbers
of the words of each document beside one row for each distinct word of the chunk. Words are counted over the whole corpus from these rows, and a chunk gets back the counts of its own words.

The model sees the words as ids of a public byte-level vocabulary (a blank before each word, the end last), and predicts the class of the next id: each of the most
frequent ids is a class, the others share classes of about equal weight. Classes of neighbouring frequency are a family; the probability of an id is that of the family, times that of the class in
the family, times the id's add-one share of the class, from the counts of all training documents. The model is one layer of masked attention with learned positions. It starts at the frequencies of
the classes and is trained in numpy by Adam over all windows of all training rows, each once: in each of ROUNDS rounds every task starts from the common weights and learns from its share of the
round's rows, and the tasks' weights are averaged by their numbers of windows, in groups before the driver. A text is scored in overlapping windows of WINDOW ids: each window scores its
last STRIDE ids once, and the ids before them are context; windows of many texts go through masked attention together.

Only the averaged weights and the vocabulary's counts come to the driver. How rows lie in files has a part in the weights, but a task that runs again repeats its own.

Rows: every row gives one row. A null text is empty and consists of the end alone. Repeated rows are repeated and count each time; whole texts are scored whatever their length. Words are counted by
64-bit hashes. Other columns are ignored; an empty table gives an empty table. Without a training text N and V are 0 and classes are shared evenly.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import Remembered, forget, stored
from hourloom.llm.packed import library_ids

CHUNK_BYTES = 4_000_000
WORD, ID = -1, -2  # kinds of rows beside documents
WINDOW, STRIDE, WIDTH = 32, 24, 32
FAMILIES, MEMBERS = 32, 32  # an id's class is predicted in two steps, its family and its place there
CLASSES, SHARED = FAMILIES * MEMBERS, 64  # all classes, those of several ids
SINGLE = CLASSES - SHARED
INPUTS = 2_048  # frequent ids that have an input vector of their own; others have that of their class
SCALE = np.float32(WIDTH**-0.5)
ROUNDS, BATCH, RATE = 8, 64, 0.02
PART = 16_384  # weights that a step takes at a time
TOGETHER = 4 * BATCH  # windows scored at once
MIXED = 64 * BATCH  # windows of neighbouring rows that are put in a random order
GROUPS = 32  # partial averages that come to the driver
HELD_OUT = ROUNDS
END = b""
LAST = STRIDE - WINDOW  # a window's scored ids, counted from its end


class Ids:
    """Ids of each word with a blank before it."""

    def __init__(self, path: str):
        self.library = library_ids(path)
        self.end = self.library.vocabulary
        self.type = "<u2" if self.end < 65_536 else "<u4"
        self.of = Remembered(self._word)

    def _word(self, word: bytes) -> bytes:
        if word == END:
            return np.array([self.end], "<u4").tobytes()
        return self.library.encode_word(" " + word.decode())

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.of.__getitem__, words)), "<u4")


@functools.cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


class Classes:
    """Class of each id, log10 of its share of the class, and the row of its input vector."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        rest = np.cumsum(counts[order[SINGLE:]] + 1e-9)
        shared = np.minimum((rest - rest[0]) * SHARED / max(rest[-1] - rest[0], 1e-12), SHARED - 1).astype(np.int64) if len(rest) else rest.astype(np.int64)
        self.of = np.empty(len(counts), np.int64)
        self.of[order[:SINGLE]] = np.arange(min(SINGLE, len(order)))
        self.of[order[SINGLE:]] = SINGLE + shared
        self.mass = np.bincount(self.of, counts + 1, minlength=CLASSES)
        self.share = np.log10((counts + 1) / self.mass[self.of])
        self.row = np.where(rank < INPUTS, rank, INPUTS + self.of) + 1  # row 0 stands before the text


def windows(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: input rows (windows, WINDOW; -1 before the text), and the ids each window scores (-1 beyond the text)."""
    ids = ids.astype(np.int64)
    n = -(-len(ids) // STRIDE)
    place = np.arange(n)[:, None] * STRIDE + np.arange(LAST, STRIDE)[None, :]
    inputs = np.where(place > 0, rows[ids[np.clip(place - 1, 0, len(ids) - 1)]], np.where(place == 0, 0, -1))
    inputs = np.where(place - 1 < len(ids), inputs, -1)
    targets = place[:, -STRIDE:]
    return inputs, np.where(targets < len(ids), ids[np.minimum(targets, len(ids) - 1)], -1), place


def cut(ids: np.ndarray, classes: Classes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Input rows and target classes of a text's windows, a long text piece by piece."""
    for start in range(0, len(ids), STRIDE * 4096):
        lead = min(start, 2 * STRIDE)  # whole strides, at least the context of a window
        inputs, targets, _ = windows(ids[start - lead : start + STRIDE * 4096], classes.row)
        wanted = targets[lead // STRIDE :]
        yield inputs[lead // STRIDE :], np.where(wanted >= 0, classes.of[np.maximum(wanted, 0)], -1)


OPEN = (np.arange(WINDOW)[None, :] <= np.arange(-LAST, WINDOW)[:, None]).astype(np.float32)


def keep_heap() -> None:
    """A freed block of this size makes glibc keep memory of smaller arrays in the process instead of asking the system for it at every product."""
    np.empty(30_000_000, np.uint8)


def spread(x: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place; exponents of 60 and more count as 60."""
    np.exp(np.minimum(x, 60, out=x), out=x)
    x /= x @ np.ones((x.shape[-1], 1), x.dtype)  # a product is faster than a sum along short rows
    return x


def views(every: np.ndarray, shape: dict[str, tuple]) -> dict[str, np.ndarray]:
    """Arrays of these shapes, one after the other in a flat array."""
    ends = np.cumsum([math.prod(s) for s in shape.values()]).tolist()
    return {n: every[end - math.prod(s) : end].reshape(s) for (n, s), end in zip(shape.items(), ends, strict=True)}


class Attention:
    """Weights: `e` input vectors, `p` positions, `a` products of a position with those before it, `v` what they bring, `g` and `c` families of classes, `m` and `d` classes of a family."""

    def __init__(self, classes: Classes | None = None, seed: int = 11):
        self.windows_seen = 0  # windows it learned from
        rng = np.random.default_rng(seed)
        shape = {"e": (1 + INPUTS + CLASSES, WIDTH), "p": (WINDOW, WIDTH), "a": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "g": (WIDTH, FAMILIES), "c": (FAMILIES,), "m": (FAMILIES, WIDTH, MEMBERS), "d": (FAMILIES, MEMBERS)}
        self.every = np.zeros(sum(map(math.prod, shape.values())), np.float32)
        self.w = views(self.every, shape)  # all weights lie in one array, so that a step of Adam is a few calls
        for n, x in self.w.items():
            x[:] = rng.normal(size=x.shape) * 0.1 * (n not in "cd")
        if classes is not None:  # it starts at the frequencies of the classes
            mass = classes.mass.reshape(FAMILIES, MEMBERS) + 1e-3
            self.w["c"][:] = np.log(mass.sum(axis=1) / mass.sum())
            self.w["d"][:] = np.log(mass / mass.sum(axis=1, keepdims=True))

    def context(self, inputs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Input vectors, their scaled products, attention, its mean, and the vector that predicts, of the last STRIDE places of each window."""
        w = self.w
        x = w["e"][np.maximum(inputs, 0)]
        x += w["p"]
        late = np.ascontiguousarray(x[:, -STRIDE:])
        t = (late.reshape(-1, WIDTH) @ (w["a"] * SCALE)).reshape(late.shape)
        mass = t @ x.transpose(0, 2, 1)
        np.exp(np.minimum(mass, 60, out=mass), out=mass)
        mass *= OPEN
        if inputs.min() < 0:
            mass *= (inputs >= 0)[:, None, :]
        rows = mass.reshape(-1, WINDOW)
        rows /= rows @ np.ones((WINDOW, 1), rows.dtype)
        mean = mass @ x
        h = (mean.reshape(-1, WIDTH) @ w["v"]).reshape(late.shape)
        h += late
        return x, t, mass, mean, h

    def families(self, h: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of h that have a target in the order of their families, the targets, bounds of the families, and softmax over families and over classes of the own family."""
        w = self.w
        flat = targets.ravel()
        order = np.flatnonzero(flat >= 0)
        order = order[np.argsort((flat[order] // MEMBERS).astype(np.int16), kind="stable")]
        h, flat = h.reshape(-1, WIDTH)[order], flat[order]
        bounds = np.searchsorted(flat // MEMBERS, np.arange(FAMILIES + 1))
        outer = h @ w["g"]
        outer += w["c"]
        inner = np.empty((len(h), MEMBERS), h.dtype)
        for f in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[f], bounds[f + 1])
            np.matmul(h[own], w["m"][f], out=inner[own])
            inner[own] += w["d"][f]
        return h, order, flat, bounds, spread(outer), spread(inner)

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 probability of each target class, 0 where it is -1."""
        h, order, flat, _, outer, inner = self.families(self.context(inputs)[-1], targets)
        at, out = np.arange(len(flat)), np.zeros(targets.size)
        out[order] = np.log10(outer[at, flat // MEMBERS].astype(np.float64) * inner[at, flat % MEMBERS])
        return out.reshape(targets.shape)

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the classes; targets -1 do not count."""
        return self.steps(inputs, targets)[0]

    def steps(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The gradients by name, and the flat array in which they lie."""
        w = self.w
        x, t, a, mean, full = self.context(inputs)
        h, order, flat, bounds, outer, inner = self.families(full, targets)
        at, share = np.arange(len(flat)), 1 / max(len(flat), 1)
        outer[at, flat // MEMBERS] -= 1
        inner[at, flat % MEMBERS] -= 1
        outer *= share
        inner *= share
        every = np.zeros(self.every.size, full.dtype)
        g = views(every, {n: x.shape for n, x in w.items()})
        np.matmul(h.T, outer, out=g["g"])
        np.sum(outer, axis=0, out=g["c"])
        back, from_inner, turned = outer @ w["g"].T, np.empty_like(h), w["m"].transpose(0, 2, 1)
        some = np.flatnonzero(np.diff(bounds))
        for f in some:
            own = slice(bounds[f], bounds[f + 1])
            np.matmul(h[own].T, inner[own], out=g["m"][f])
            np.matmul(inner[own], turned[f], out=from_inner[own])
        back += from_inner
        if len(some):
            g["d"][some] = np.add.reduceat(inner, bounds[some], axis=0)
        dh = np.zeros_like(full)
        dh.reshape(-1, WIDTH)[order] = back
        np.matmul(mean.reshape(-1, WIDTH).T, dh.reshape(-1, WIDTH), out=g["v"])
        dm = (dh.reshape(-1, WIDTH) @ w["v"].T).reshape(dh.shape)
        ds = dm @ x.transpose(0, 2, 1)
        dx = a.transpose(0, 2, 1) @ dm
        ds -= np.einsum("bsd,bsd->bs", dm, mean)[..., None]  # the mean of ds under a
        ds *= a
        dx += ds.transpose(0, 2, 1) @ t
        dt = (ds @ x).reshape(-1, WIDTH)
        np.multiply(x[:, -STRIDE:].reshape(-1, WIDTH).T @ dt, SCALE, out=g["a"])
        dh += (dt @ (w["a"].T * SCALE)).reshape(dh.shape)
        dx[:, -STRIDE:] += dh
        if inputs.min() < 0:
            dx *= (inputs >= 0)[..., None]
        np.sum(dx, axis=0, out=g["p"])
        rows = np.maximum(inputs, 0).ravel()
        by_row = np.argsort(rows.astype(np.int16), kind="stable")
        rows = rows[by_row]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        g["e"][rows[first]] = np.add.reduceat(dx.reshape(-1, WIDTH)[by_row], first, axis=0)
        return g, every

    def flat(self) -> np.ndarray:
        return self.every.astype("<f4")

    def load(self, flat: np.ndarray) -> None:
        self.every[:] = flat

    def train(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], rate: float, seed: int) -> int:
        """One pass of Adam over windows, inputs and target classes. Returns their number."""
        rng = np.random.default_rng(seed)
        m, v, kept = (np.zeros_like(self.every) for _ in range(3))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = seen = t = 0

        def learn() -> None:
            nonlocal t
            inputs, targets = (np.concatenate(x) for x in zip(*held, strict=True))
            order = rng.permutation(len(inputs))
            for at in range(0, len(order), BATCH):
                t += 1
                some = order[at : at + BATCH]
                step = np.float32(rate * math.sqrt(1 - 0.99**t) / (1 - 0.9**t))
                _, every = self.steps(inputs[some], targets[some])
                for low in range(0, len(every), PART):  # a part stays in the processor's cache from the first call to the last
                    own = slice(low, low + PART)
                    g, mean, square, spare = every[own], m[own], v[own], kept[own]
                    mean *= np.float32(0.9)
                    np.multiply(g, np.float32(0.1), out=spare)
                    mean += spare
                    g *= g
                    g *= np.float32(0.01)
                    square *= np.float32(0.99)
                    square += g
                    np.sqrt(square, out=g)
                    g += np.float32(1e-7)
                    np.divide(mean, g, out=g)
                    g *= step
                    self.every[own] -= g

        for part in parts:
            held.append(part)
            waiting, seen = waiting + len(part[0]), seen + len(part[0])
            if waiting >= MIXED:
                learn()
                held, waiting = [], 0
        if waiting:
            learn()
        return seen

    def scores(self, texts: Iterable[np.ndarray], classes: Classes) -> list[float]:
        """log10 probability of each id sequence."""
        out: list[float] = []
        held, owners, many = [], [], 0

        def flush() -> None:
            inputs, targets = (np.concatenate(x) for x in zip(*held, strict=True))
            owner = np.repeat(owners, [len(x[0]) for x in held])
            for at in range(0, len(inputs), TOGETHER):
                some = slice(at, at + TOGETHER)
                for i, value in zip(owner[some].tolist(), self.log_probabilities(inputs[some], targets[some]).sum(axis=1).tolist(), strict=True):
                    out[i] += value

        for i, ids in enumerate(texts):
            out.append(float(classes.share[ids].sum()))
            for both in cut(ids, classes):
                held.append(both)
                owners.append(i)
                many += len(both[0])
                if many >= 16 * BATCH:
                    flush()
                    held, owners, many = [], [], 0
        if held:
            flush()
        return out


class Places(dict):
    """Number of each distinct word, by its first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def joined(flat: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen pieces of a flat array, whose pieces have these sizes, one after the other."""
    many = sizes[chosen]
    shift = (np.cumsum(sizes) - sizes)[chosen] - (np.cumsum(many) - many)
    return flat[np.repeat(shift, many) + np.arange(many.sum())]


def _gather(path: str):
    """Of every chunk, a run of rows of about CHUNK_BYTES: rows of its words (turn WORD: place in the chunk, hash, times in training texts) and of its documents (ids, places of the
    words); and once a task the ids' times in training texts (turn ID)."""
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("name", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("words", pa.binary()), ("turn", pa.int32())])

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = ids_of(path), TaskContext.get().partitionId() << 32
        seen = np.zeros(coder.end + 1, np.int64)

        def chunk(number: int, docs: list[tuple[int | None, int]], places: Places, used: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sizes, every = np.array([len(x) for x in used]), np.concatenate(used)
            learned = np.repeat([turn != HELD_OUT for _, turn in docs], sizes)
            counts = np.bincount(every[learned], minlength=len(places))
            spelled = [coder.of[word] for word in places]
            lengths = np.array([len(x) for x in spelled]) // 4
            flat = np.frombuffer(b"".join(spelled), "<u4")
            np.add.at(seen, flat, np.repeat(counts, lengths))
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, places), np.uint64, len(places)).view(np.int64)
            size = len(places)
            yield rows(size, chunk=np.full(size, number), place=np.arange(size, dtype=np.int32), name=names, n=counts, turn=np.full(size, WORD, np.int32))
            ids = joined(flat.astype(coder.type), lengths, every)
            ends = np.concatenate([[0], np.cumsum(lengths[every])])[np.cumsum(sizes)]
            data = [x.tobytes() for x in np.split(ids, ends[:-1])]
            yield rows(len(docs), chunk=np.full(len(docs), number), doc_id=[x for x, _ in docs], ids=data, words=[x.tobytes() for x in used], turn=[x for _, x in docs])

        docs: list[tuple[int | None, int]] = []
        used: list[np.ndarray] = []
        places, size, number = Places(), 0, first
        for batch in batches:
            for doc_id, text, turn in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("turn").to_pylist(), strict=True):
                words = tokens(text.as_py() or "")
                docs.append((doc_id, turn))
                used.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                size += sum(map(len, words)) + len(words)
                if size >= CHUNK_BYTES:
                    yield from chunk(number, docs, places, used)
                    docs, used, places, size, number = [], [], Places(), 0, number + 1
        if docs:
            yield from chunk(number, docs, places, used)
        known = np.flatnonzero(seen)
        yield rows(len(known), name=known, n=seen[known], turn=np.full(len(known), ID, np.int32))

    return run


def _average(rows: Iterator[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    """Number of windows and mean weights of (windows, weights)."""
    many, total = 0, np.zeros(1)
    for n, data in rows:
        many, total = many + n, total + n * np.frombuffer(data, "<f4").astype(np.float64)
    return many, (total / max(many, 1)).astype("<f4")


def _fit(docs: DataFrame, classes: Classes, kind: str) -> Attention:
    """`docs`: `ids`, arrays of the type `kind`, and `turn`, the round that learns from them."""
    schema = "part long, n long, weights binary"

    def row(part: int, n: int, weights: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["part", "n", "weights"])

    def learn(weights: np.ndarray, rate: float, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_heap()
            own, model = TaskContext.get().partitionId(), Attention()
            model.load(weights)
            parts = (both for b in batches for x in b.column("ids") for both in cut(np.frombuffer(x.as_buffer(), kind), classes))
            n = model.train(parts, rate, 1_000_003 * turn + own)
            if n:
                yield row(own % GROUPS, n, model.flat())

        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, weights = _average(x for b in batches for x in zip(b.column("n").to_pylist(), b.column("weights").to_pylist(), strict=True))
        if n:
            yield row(0, n, weights)

    model = Attention(classes)
    for turn in range(ROUNDS):
        rate = RATE * (1 - 0.9 * turn / ROUNDS)
        learned = docs.where(F.col("turn") == turn).select("ids").mapInArrow(learn(model.flat(), rate, turn), schema)
        n, weights = _average((r["n"], r["weights"]) for r in learned.repartition(GROUPS, "part").mapInArrow(average, schema).collect())
        if n:
            model.load(weights)
        model.windows_seen += n
    return model


def score(docs: DataFrame, path: str, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. `held_out` is the column that keeps a row out of training."""
    turn = F.when(held_out, HELD_OUT).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", turn.alias("turn"))
    gathered = stored(rows.mapInArrow(_gather(path), "chunk long, place int, name long, n long, doc_id long, ids binary, words binary, turn int"), "encoded", "turn")
    words, encoded = gathered.where(F.col("turn") == WORD), gathered.where("turn >= 0").select("chunk", "doc_id", "turn", "words", "ids")
    counts = stored(words.groupBy("name").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    used = gathered.where(F.col("turn") == ID).groupBy("name").agg(F.sum("n").alias("n")).collect()  # one row for an id of the vocabulary
    end, kind = ids_of(path).end, ids_of(path).type
    seen = np.zeros(end + 1)
    for r in used:
        seen[r["name"]] = r["n"]
    classes = Classes(seen)
    model = _fit(encoded, classes, kind)
    answers = stored(words.join(counts, "name", "left").select(F.col("chunk").alias("whole"), "place", F.coalesce("c", F.lit(0)).alias("c")), "answers")
    forget(gathered, f"turn={WORD}")
    rest = np.log10(total + distinct + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        for batch in batches:
            scores = model.scores((np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")), classes)
            yield batch.drop_columns(["ids"]).append_column("score", pa.array(scores, pa.float64()))

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        c = np.zeros(known.num_rows, np.int64)
        c[known.column("place").to_numpy()] = known.column("c").to_numpy()
        logs = np.log10(c + 1) - rest
        lists = [np.frombuffer(x.as_buffer(), "<u4") for x in texts.column("words")]
        n = texts.num_rows
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.array(texts.column("turn").to_numpy() == HELD_OUT), "n_tokens": pa.array([len(x) for x in lists], pa.int64()),
            "n_known": pa.array([int((c[x] > 0).sum()) for x in lists], pa.int64()), "train_tokens": pa.array([total] * n, pa.int64()),
            "base_score": pa.array([float(logs[x].sum()) for x in lists], pa.float64()), "score": texts.column("score"),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = encoded.mapInArrow(judge, "chunk long, doc_id long, turn int, words binary, score double")
    return scored.groupBy("chunk").cogroup(answers.groupBy("whole")).applyInArrow(run, schema)
