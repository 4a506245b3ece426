"""Encoding, decoding and packing against the libraries on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from syllabica.llm import byte_bpe, packing
from syllabica.llm.chunked_bpe import ChunkCoder, read_ranks, segments
from tests.llm.helpers import empty, prose, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENCODING = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
ODD = ["", None, " ", "\n", "  two  spaces\t tab\xa0hard 　wide ", "it's we'll 'S 1234 5,6", "a\r\n b \n\n c", "<|endoftext|> x",
       "été naïve 日本語 \U0001f600\U0001f600", "x" * 3000, "word " * 30_000, "\x1c \x1d a", prose(500, 3)]
ROWS = [*enumerate(ODD), (None, "no id"), (3, "\n")]


def test_encode_decode(spark):
    got = byte_bpe.encode_decode(table(spark, ROWS), RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((str(i), ENCODING.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["token_ids"], bytes(r["decoded"])) for r in got) == want
    assert byte_bpe.encode_decode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\x1c\xa0 ab1.'sé中"), max_size=40))
def test_boundaries_never_change_ids(text):
    first, rest = segments(text)
    assert " ".join([first, *rest]) == text
    assert ChunkCoder(ENCODING.encode_ordinary, keep=5).ids(text).tolist() == ENCODING.encode_ordinary(text)


def test_pack(spark):
    json, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = Tokenizer.from_file(json)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(20 + 13 * i, i)) for i in range(60)]
    got = packing.pack(table(spark, [*rows, (None, "no id")]), json, ranks, capacity=256, per_bucket=40).collect()
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    pieces = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] is not None)
    assert pieces == sorted((i, a, len(x[a: a + 256]), zlib.crc32(x[a: a + 256].tobytes()), len(x)) for i, x in ids.items() for a in range(0, len(x), 256))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(empty(spark), json, ranks).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_the_closest_sum(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(1, 7))}
    capacity = rng.randint(1, 130)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity}
    chosen = packing.fill(counts, sorted(counts), capacity)
    assert sum(length * n for length, n in chosen.items()) == max(sums)
    assert all(0 < n <= counts[length] for length, n in chosen.items())


def test_window_of_every_piece():
    rng = np.random.default_rng(4)
    length = rng.integers(1, 300, 5000)
    window, offset = packing.pack_lengths(length, 300)
    used = np.bincount(window, length)
    assert used.max() <= 300 and used.sum() == length.sum() and 300 * len(used) < 1.01 * length.sum()
    order = np.lexsort((offset, window))
    same = window[order][1:] == window[order][:-1]
    assert (offset[order][1:][same] == (offset + length)[order][:-1][same]).all()
