"""Two classifiers of documents that teach each other: one reads the text, one the page metadata.

The text view has the presence of words and of runs of signs; the metadata view has source, language, length and shape (lines, line length, share of
signs, share of distinct words), each cut into steps. Both are logistic models over hashed features, trained in numpy. In each round every view labels rows of
an unlabelled pool; those it is confident about, by probabilities calibrated on labelled rows that it was not trained on, join the other view's
training rows. At the end both views are calibrated again and combined by a logistic model of their two scores, and every document is scored.
There is one such pair for quality and one for toxicity; a document is kept if neither speaks against it.

Bounds: training uses at most `fit_rows` labelled and as many unlabelled documents (smallest hashes of the id); only their feature numbers, of which a document
has at most DIMS, come to the driver. Scoring covers every document.

Rows: every row gives one row. A null or empty text has only metadata; missing metadata is a value of its own. Without labels of both kinds a head keeps everything
and its probability is null. Thresholds that tie go to the one that rejects less. Whole texts are used; repeated rows are repeated; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import WordHashes, texts_of
from hourloom.llm.rules import best_threshold

TEXT_BITS = 18
DIMS = 1 << TEXT_BITS
PARTS = re.compile(r"\w+|[^\w\s]+").findall
META_DIMS = 1 << 12
FIT_ROWS, ROUNDS, CONFIDENT = 10_000, 2, 0.97
LEAST_DOCS, STANDS_OUT = 5, 3.5  # training rows that must have a feature, and standard errors by which its odds must differ
SIGNS = "#*$%&|<>{}[]=+_~^@/"  # of code, tables and markup
META = ("source", "lang", "n_chars")
HEADS = {"quality": 0, "toxic": 1}  # the label value that speaks against a document


def text_features(text: str, hashes: WordHashes) -> np.ndarray:
    parts = list(set(PARTS(text.lower())))
    return np.unique(hashes.of(parts) >> np.uint64(64 - TEXT_BITS)).astype(np.int32)


def meta_features(text: str, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    words, lines = text.split(), text.split("\n")
    signs = sum(map(text.count, SIGNS))
    shares = (
        f"source={source}", f"lang={lang}", f"chars={None if n_chars is None else int(n_chars).bit_length()}", f"lines={len(lines).bit_length()}",
        f"line={(len(text) // len(lines)).bit_length()}", f"signs={40 * signs // max(len(text), 1)}",
        f"word={2 * sum(map(len, words)) // max(len(words), 1)}", f"distinct={10 * len(set(words)) // max(len(words), 1)}",
    )
    return np.array(sorted({xxhash.xxh3_64_intdigest(x) % META_DIMS for x in shares}), np.int32)


class Logistic:
    """Weights of presence features; a score is their sum plus a bias."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, dims: int, steps: int = 60, rate: float = 0.1, decay: float = 3e-5):
        self.weights, self.bias = np.zeros(dims, np.float32), 0.0
        if not len(labels) or labels.min() == labels.max():
            return
        sizes = np.array([len(r) for r in rows])
        at = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), sizes)
        both = [np.bincount(at[labels[owner] == c], minlength=dims) for c in (0, 1)]
        odds = [np.log((n + 0.5) / ((labels == c).sum() - n + 0.5)) for c, n in enumerate(both)]
        spread = np.sqrt(sum(1 / (n + 0.5) + 1 / ((labels == c).sum() - n + 0.5) for c, n in enumerate(both)))
        known = (both[0] + both[1] >= LEAST_DOCS) & (np.abs(odds[1] - odds[0]) >= STANDS_OUT * spread)
        keep = known[at]
        at, owner = at[keep], owner[keep]
        each = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())  # both classes weigh the same
        w, bias = np.zeros(dims), 0.0
        m, v = np.zeros(dims + 1), np.zeros(dims + 1)
        for t in range(1, steps + 1):
            z = np.bincount(owner, w[at], minlength=len(rows)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * each
            g = np.append(np.bincount(at, error[owner], minlength=dims) + decay * w, error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            w, bias = w - step[:-1], bias - step[-1]
        self.weights, self.bias = np.where(known, w, 0).astype(np.float32), float(bias)

    def score(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum()) + self.bias


def logistic_of(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Coefficients (of each column, then the constant) of a logistic model by Newton's method with a small ridge."""
    x = np.column_stack([scores, np.ones(len(scores))])
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b = b + np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * b)
    return b


def probability(scores: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scores @ b[:-1] + b[-1], -30, 30)))


@dataclass
class Head:
    """The two views of one label and their combination; probability is that of the value that speaks against a document."""

    text: Logistic
    meta: Logistic
    mixture: np.ndarray
    threshold: float

    def probability(self, text: np.ndarray, meta: np.ndarray) -> float:
        return float(probability(np.array([[self.text.score(text), self.meta.score(meta)]]), self.mixture)[0])


def teach(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> Head | None:
    """rows: (text, meta) features; labels: 1 against, 0 for, -1 unlabelled; held: labelled rows for calibration only."""
    train, check = (labels >= 0) & ~held, (labels >= 0) & held
    if any(len(np.unique(labels[part])) < 2 for part in (train, check)):
        return None
    own = [labels.copy(), labels.copy()]  # what each view is trained on
    views: list[Logistic] = []
    for turn in range(rounds + 1):
        views = []
        for v, dims in ((0, DIMS), (1, META_DIMS)):
            part = np.flatnonzero((own[v] >= 0) & ~held)
            views.append(Logistic([rows[i][v] for i in part], own[v][part].astype(np.float64), dims))
        if turn == rounds:
            break
        pool = np.flatnonzero(labels < 0)
        for v in (0, 1):
            fit = logistic_of(np.array([[views[v].score(rows[i][v])] for i in np.flatnonzero(check)]), labels[check])
            p = probability(np.array([[views[v].score(rows[i][v])] for i in pool]).reshape(-1, 1), fit)
            other = own[1 - v]
            other[pool[p >= CONFIDENT]] = 1
            other[pool[p <= 1 - CONFIDENT]] = 0
    scores = np.array([[views[v].score(rows[i][v]) for v in (0, 1)] for i in np.flatnonzero(check)])
    mixture = logistic_of(scores, labels[check])
    p = probability(scores, mixture)
    return Head(views[0], views[1], mixture, best_threshold(p[labels[check] == 0], p[labels[check] == 1]))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            meta = zip(*(batch.column(c).to_pylist() for c in META), strict=True)
            found = [(text_features(t, hashes).tobytes(), meta_features(t, *m).tobytes()) for t, m in zip(texts_of(batch), meta, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], [*others, "text_view", "meta_view"])

    others = [c for c in docs.columns if c not in ("text", *META)]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{kinds}, text_view binary, meta_view binary")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, Head | None]:
    order = (F.xxhash64("doc_id"), "doc_id")
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").where("doc_id is not null")
    some = marked.join(ids, "doc_id", "left_semi").orderBy(*order).limit(fit_rows)
    pool = ids.join(marked, "doc_id", "left_anti").distinct().orderBy(*order).limit(fit_rows)
    chosen = some.unionByName(pool, allowMissingColumns=True)
    half = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0).alias("held")
    rows = _features(docs.select("doc_id", "text", *META).join(F.broadcast(chosen), "doc_id")).select("*", half).collect()  # at most 2 * fit_rows ids
    rows.sort(key=lambda r: (r["doc_id"], r["text_view"]))
    views = [(np.frombuffer(r["text_view"], np.int32), np.frombuffer(r["meta_view"], np.int32)) for r in rows]
    held = np.array([r["held"] for r in rows], bool)
    return {
        head: teach(views, np.array([-1 if r[head] is None else int(r[head] == against) for r in rows], np.int64), held)
        for head, against in HEADS.items()
    }


def score(docs: DataFrame, heads: dict[str, Head | None]) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            meta = zip(*(batch.column(c).to_pylist() for c in META), strict=True)
            for text, m in zip(texts_of(batch), meta, strict=True):
                views = text_features(text, hashes), meta_features(text, *m)
                p = [heads[h].probability(*views) if heads[h] else None for h in HEADS]
                out.append((*p, all(x is None or x <= heads[h].threshold for h, x in zip(HEADS, p, strict=True))))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], ["doc_id", "p_low_quality", "p_toxic", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *META).mapInArrow(run, f"doc_id {kind}, p_low_quality double, p_toxic double, kept boolean")
