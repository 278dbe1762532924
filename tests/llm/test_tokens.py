import hashlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from hourloom.llm import bpe, packed
from hourloom.llm.common import scratch
from tests.llm.data import odd, odd_rows, vocabulary


def library(text):
    return Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_words_are_cut_as_the_library_does():
    split, lib = bpe.Splitter(vocabulary()), Tokenizer.from_file(vocabulary()).pre_tokenizer
    points = [*range(0x3100), *random.Random(1).sample(range(0x3100, 0x110000), 20_000)]
    for c in (c for c in points if not 0xD800 <= c < 0xE000):
        t = f"a{chr(c)}1 {chr(c)}b!{chr(c)} _{chr(c)}"
        assert split.plain(t) == [t[a:b] for _, (a, b) in lib.pre_tokenize_str(t)], hex(c)


def test_prefix_encoding_equals_the_library_and_decodes():
    enc, lib, r = bpe.Encoder(vocabulary()), Tokenizer.from_file(vocabulary()), random.Random(2)
    parts = ["a", "e", "th", " ", "  ", "\n", "é", "ß", "中", "😀", "1", "!", "_", "'s", "<|endoftext|>", "\x1c", "½", "aaaa", "=====", "\t", "The"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        ids = enc.encode(text)
        assert ids == lib.encode(text, add_special_tokens=False).ids
        assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text
    some = r.sample(range(50_000), 300)  # parts of characters as well
    assert enc.decode(some) == lib.decode(some, skip_special_tokens=False)


def test_round_trip_of_odd_rows(spark):
    got = sorted(map(tuple, bpe.round_trip_digests(odd(spark), vocabulary()).collect()), key=str)
    want = []
    for r in odd_rows():
        ids = library(r[1])
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(odd(spark), vocabulary()), vocabulary())
    assert sorted((r["text"] for r in back.collect())) == sorted(r[1] or "" for r in odd_rows())
    assert bpe.round_trip_digests(odd(spark, []), vocabulary()).count() == 0


def test_bits():
    for width in (1, 3, 11, 16, 17):
        ids = np.random.default_rng(width).integers(0, 1 << width, 1001)
        data = packed.pack(ids, width)
        assert len(data) == -(-1001 * width // 8)
        assert (packed.unpack(data, width, 0, 1001) == ids).all() and (packed.unpack(data, width, 17, 100) == ids[17:117]).all()
    assert packed.width_of(50_257) == 16 and packed.width_of(1) == 1


def test_packed_files(spark):
    folder = scratch(spark, "packed-test")
    packed.write(odd(spark), vocabulary(), folder, block_ids=500)
    blocks = packed.read(spark, folder)
    got = sorted(map(tuple, packed.summaries(blocks).collect()), key=lambda r: r[1])
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for (doc_id, at, n, crc), r in zip(got, rows, strict=True):
        ids = [*library(r[1]), 0]
        assert (doc_id, at, n, crc) == (r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert packed.lookup(blocks, 12).first()["ids"] == [*library(odd_rows()[11][1]), 0]
    empty = scratch(spark, "packed-test")
    packed.write(odd(spark, []), vocabulary(), empty)
    assert packed.summaries(packed.read(spark, empty)).count() == 0
