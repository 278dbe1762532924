"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can end its BPE encoding. The vocabulary is held in an
automaton with suffix links, which reports every token that is a suffix of the prefix read so far. A token is the last
one of prefix p if it is compatible with the stored last token of the prefix before it; two tokens are compatible if
merging their joined bytes from scratch would leave exactly these two. The ids follow from the back-pointers.

Rows: every row of the input gives one row. A null text counts as empty: no tokens, digests of the empty string. Text of
any length is encoded whole; repeated rows are repeated; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from hourloom.llm.common import CACHED_WORDS, Remembered, texts_of

# The word pattern of the byte-level vocabulary, in terms of letters, numbers and white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
# Characters for which Python's classes may differ from the library's: numbers that are no decimal digits, code points
# that one side's Unicode version does not know, and the separators \x1c-\x1f.
UNSURE = {"No", "Nl", "Cn"}


COMMON = 0x250  # most texts lie below this code point, and a short class is tested a hundred times faster


@functools.cache
def _unsure(below: int = 0x110000) -> re.Pattern:
    """Finds an unsure character below a code point, or any character from there on."""
    parts, start = [], None
    for c in range(below + 1):
        odd = c < below and not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) in UNSURE or 0x1C <= c <= 0x1F)
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            parts.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    beyond = f"\\U{below:08x}-\\U0010ffff" if below < 0x110000 else ""
    return re.compile(f"[{''.join(parts)}{beyond}]")


class Splitter:
    """Cuts text into the special tokens it contains and, between them, the words that are encoded on their own."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.find = re.compile(WORDS).findall
        self.maybe_odd, self.odd = _unsure(COMMON), _unsure()

    def plain(self, text: str) -> list[str]:
        if not self.maybe_odd.search(text) or not self.odd.search(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if not self.cut or not self.cut.search(text):
            return self.plain(text)
        return list(chain.from_iterable([x] if x in self.special else self.plain(x) for x in self.cut.split(text) if x))


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        self.ids_of = Remembered(self.encode_word)
        self.split = Splitter(path)
        letters, model = byte_letters(), self.split.spec["model"]
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.split.special.values()]) + 1
        self.bytes_of = [b""] * size
        self.born = [-1] * size  # position of the merge that makes a token; -1 for single bytes
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        self.joins: dict[tuple[int, int], int] = {}
        automaton = ahocorasick.Automaton()
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(map(letters.__getitem__, word))
            automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(word)))
        for word, i in self.split.special.items():
            self.bytes_of[i] = word.encode()
        automaton.make_automaton()
        self.suffixes = automaton.iter
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            if self.born[whole] >= 0:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.born[whole], self.halves[whole] = rank, (vocab[a], vocab[b])
            self.joins[vocab[a], vocab[b]] = rank
        self.text_of = [str(i) for i in range(size)]
        self.tested: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether bytes of a and b, merged from scratch, end as these two tokens. Merges are undone at the border from the
        latest to the first; at each point the two border tokens must not have been due to merge with each other."""
        pair = (a, b)
        if pair in self.tested:
            return self.tested[pair]
        born, halves, joins = self.born, self.halves, self.joins
        a_ends = b_ends = len(joins)
        good = True
        while True:
            due = joins.get((a, b))
            if due is not None and due < a_ends and due <= b_ends:  # of equal merges the left one goes first
                good = False
                break
            if born[a] > born[b]:
                a_ends, a = born[a], halves[a][1]
            elif born[b] >= 0:
                b_ends, b = born[b], halves[b][0]
            else:
                break
        if len(self.tested) > CACHED_WORDS:
            self.tested.clear()
        self.tested[pair] = good
        return good

    def encode_word(self, word: str) -> tuple[int, ...]:
        if word in self.split.special:
            return (self.split.special[word],)
        data = word.encode()
        last = [-1] * (len(data) + 1)
        for end, (token, size) in self.suffixes(data.decode("latin-1")):
            end += 1
            if last[end] < 0 and (end == size or self.compatible(last[end - size], token)):
                last[end] = token
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.ids_of.__getitem__, self.split.words(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = pa.array([enc.encode(x) for x in texts_of(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = pa.array([enc.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded text in UTF-8). Encoding and
    decoding run in one pass, so the ids never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in texts_of(batch):
                ids = enc.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(enc.text_of.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
