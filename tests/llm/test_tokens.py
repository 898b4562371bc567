"""Packing, token counts and BPE against the libraries themselves."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pagewarden.llm import bpe_tree, packing, token_count
from pagewarden.llm.vocabulary import WordEncoder
from tests.llm.fixtures import edge_docs, empty_docs, sf, texts_of

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = "ab'st reéÉ́ḦH̱ß\n\t \x1c\x85 　中文字ñ12.!?#|<>İiσΣς▁'ll 👍🏽"
LIBRARY = Tokenizer.from_file(WORDS)


def ids_of(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4")


def odd_texts(n, seed=5, size=80):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, size))) for _ in range(n)]


@given(st.lists(st.integers(1, 512), min_size=1, max_size=120), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_differencing_is_a_partition(sizes, k):
    sets = packing.differencing(sizes, k)
    assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and len(sets) <= k


@given(st.lists(st.integers(1, 512), min_size=1, max_size=200))
@settings(max_examples=100, deadline=None)
def test_windows_hold_their_capacity(sizes):
    sums = [sum(sizes[i] for i in s) for s in packing.windows(sizes, 2048)]
    assert sum(sums) == sum(sizes) and max(sums) <= 2048


def test_differencing_makes_near_equal_sums():
    r = random.Random(3)
    sizes = [r.randint(1, 512) for _ in range(800)]
    sums = [sum(sizes[i] for i in s) for s in packing.differencing(sizes, 100)]
    assert len(sums) == 100 and max(sums) - min(sums) <= 8
    assert len(packing.windows([300, 300, 300], 512)) == 3  # two windows would do for the sum


def _check_packed(rows, texts, padding):
    blobs = defaultdict(list)
    for doc, text in texts:
        blobs[doc].append(ids_of(text).tobytes() + np.array([1], "<u4").tobytes())
    parts, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.array(r.ids, "<u4").tobytes()
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens in {len(b) // 4 for b in blobs[r.doc_id]}
        parts[r.doc_id].append((r.start, part))
        windows[r.sequence_id].append(r)
    assert parts.keys() == blobs.keys()
    for doc, found in parts.items():  # rows that repeat an id are packed as often
        if len(blobs[doc]) == 1:
            assert b"".join(p for _, p in sorted(found)) == blobs[doc][0]
        assert sum(len(p) for _, p in found) == sum(map(len, blobs[doc]))
    total = 0
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at == pieces[0].sequence_tokens
        assert pieces[0].padded_tokens == (at if at & (at - 1) == 0 else 2048)
        total += pieces[0].padded_tokens
    assert total <= padding * sum(len(b) for bs in blobs.values() for b in bs) / 4 + 2048


def test_pack(spark):
    docs = sf(spark, at="0.01")
    _check_packed(packing.pack(docs, WORDS).collect(), texts_of(docs), 1.02)
    again = packing.pack(docs, WORDS, with_ids=False).collect()
    assert sorted((r.doc_id, r.start, r.sequence_id) for r in again) == sorted((r.doc_id, r.start, r.sequence_id) for r in packing.pack(docs, WORDS).collect())


def test_pack_edges(spark):
    docs = edge_docs(spark)
    _check_packed(packing.pack(docs, WORDS).collect(), texts_of(docs), 1.5)
    assert packing.pack(empty_docs(spark), WORDS).count() == 0


def test_encoders_equal_the_library():
    words = WordEncoder(WORDS, cache_words=50)
    trees = [bpe_tree.TreeEncoder(words), bpe_tree.TreeEncoder(words, leaf_chars=24, run_chars=12), bpe_tree.TreeEncoder(words, leaf_chars=7, run_chars=3)]
    fixed = ["", "<|endoftext|>x <|startoftext|>'s", "a<|endoftext|>.", "don't. we're! 'tis", "x" * 3000, "中" * 2000, "ab'" * 900, "l'll'll're" * 300, "!'s!!'s" * 400]
    r = random.Random(9)
    fixed += ["".join(r.choice("abcdeé'!1") for _ in range(2000)) for _ in range(3)]
    for text in odd_texts(600) + fixed:
        want = ids_of(text).tobytes()
        assert words.encode(text) == want
        for tree in trees:
            assert tree.encode(text) == want, (tree.leaf, text[:60])


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_tree_on_any_text(text):
    words = WordEncoder(WORDS)
    assert bpe_tree.TreeEncoder(words, leaf_chars=10, run_chars=5).encode(text) == ids_of(text).tobytes()


def test_long_unsplit_texts():
    """Windows stay short: a long word costs about what the library takes for it."""
    import time

    r = random.Random(12)
    tree = bpe_tree.TreeEncoder(WordEncoder(WORDS))
    for text in ("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(200_000)), "".join(r.choice("etaoinshrdlu") for _ in range(200_000)), "x" * 50_000, "ab12" * 20_000):
        start = time.perf_counter()
        want = ids_of(text).tobytes()
        plain = time.perf_counter() - start
        start = time.perf_counter()
        assert tree.encode(text) == want
        assert time.perf_counter() - start < 12 * plain + 0.5


def _check_coded(rows, texts):
    want = defaultdict(list)
    for doc, text in texts:
        ids = ids_of(text)
        decoded = LIBRARY.decode(ids.tolist(), skip_special_tokens=False)
        want[doc].append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_encode_decode(spark):
    docs = sf(spark)
    _check_coded(bpe_tree.encode_decode(docs, WORDS, with_ids=False).collect(), texts_of(docs))
    _check_coded(bpe_tree.encode_decode(edge_docs(spark), WORDS).collect(), texts_of(edge_docs(spark)))
    assert bpe_tree.encode_decode(empty_docs(spark), WORDS).count() == 0


def test_token_counts_equal_the_library(spark):
    library = SentencePieceProcessor(model_file=PIECES)
    counter = token_count.MergeCounter(PIECES, cache_words=100)
    for text in odd_texts(1500, seed=8) + ["  a  b ", "▁", "▁▁x", " ", "aaaa" * 500, "\n\n a"]:
        assert counter.count(text) == len(library.encode(text)), text
    for docs in (sf(spark), edge_docs(spark)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, PIECES).collect())
        want = [(d is None, d or 0, len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in texts_of(docs)]
        assert got == sorted(want)
    assert token_count.count_tokens(empty_docs(spark), PIECES).count() == 0
