import zlib

import numpy as np
import pytest

from attesta.llm import packing, token_files
from attesta.llm.queries import tokenizer_path
from attesta.llm.tokens import encoder

from .conftest import AWKWARD

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = ["", " ", "a", " a", "a ", "  a  b\n\n c", "a\n b", "a\nb", "\na", "a\n", "it's 'S 12 34 x", "É é ́x ́ a b  c", "Σας ΣΑΣ Σ Α", "\x1c a \x1c b", "a\x00b \x00c",
         "Foo*** bar,*** b|| (x) x). it's, ét", "a | b| |c", "x y  z", "a\tb c\td", "a\r\nb c", "12. a1. ab.' it'. a\"b\" (a)", "A\nfoo.\nBar, X"]


@pytest.mark.parametrize("name", NAMES)
def test_encoder_equals_whole_texts(name):
    e = encoder(tokenizer_path(name))
    texts = TEXTS + [t for _, t, *_ in AWKWARD if t]
    for some in (texts, texts[::-1]):
        for text, ids in zip(some, e.encode_batch(some), strict=True):
            assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encoder_keeps_right_when_its_cache_turns_over():
    from attesta.llm.tokens import UnitEncoder

    e = UnitEncoder(tokenizer_path(NAMES[0]), limit=5)
    for text in TEXTS * 2:
        assert e.encode_batch([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype("<u4")
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (token_files.unpack_bits(data, 1003, bits) == ids).all()


def test_image_random_access():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 5000, n).astype("<u4") for n in (1, 0, 9000, 4096, 17)]
    image = token_files.Image(token_files.write_image([5, None, 7, 8, 9], arrays, 13))
    whole = np.concatenate(arrays)
    for a, b in ((0, len(whole)), (4090, 4100), (8192, 8192), (9001, 13000), (13100, len(whole))):
        assert (image.ids(a, b) == whole[a:b]).all()
    assert [(image.document(k) == x).all() for k, x in enumerate(arrays)] == [True] * 5
    assert image.valid.tolist() == [1, 0, 1, 1, 1]


def expected(name):
    t = encoder(tokenizer_path(name)).tokenizer
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in AWKWARD]


def test_token_output(awkward):
    rows = token_files.token_output(awkward, tokenizer_path(NAMES[0]), 2, with_ids=True).collect()
    want = sorted((i is not None, i or 0, x) for i, x in expected(NAMES[0]))
    rows.sort(key=lambda r: r["start"])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == want
    assert [r["doc_id"] or 0 for r in rows] == [x[1] for x in want]
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]


def test_token_output_of_nothing(nothing):
    assert token_files.token_output(nothing, tokenizer_path(NAMES[0]), 2).count() == 0


def test_nnls_finds_known_solutions():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(a @ packing.nnls(a, np.array([4.0, 2.0])), [4, 2])
    assert packing.nnls(a, np.array([-1.0, -1.0])).max() == 0


def test_plan_never_takes_more_than_there_is():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = rng.integers(0, 200, 64)
        tokens = int((counts * (np.arange(64) * 64 + rng.integers(1, 65, 64))).sum())
        used = np.zeros(64, int)
        for some, n in packing.plan(counts, tokens):
            assert sum(b + 1 for b in some) == 64
            for b in some:
                used[b] += n
        assert (used <= counts).all()
        assert sum(n for _, n in packing.plan(counts, tokens)) * 4096 <= tokens


@pytest.mark.parametrize("window", [4096, 64])
def test_packing(awkward, window):
    path = tokenizer_path(NAMES[1])
    pieces, atoms = packing.pack(awkward, path, 2, window=window, bins=16)
    rows = pieces.collect()
    want = expected(NAMES[1])
    pool = {}
    for i, ids in want:
        pool.setdefault((i, len(ids)), []).append(np.array(ids, "<u4"))
    lengths = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths.get(r["sequence_id"], 0)
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in pool[r["doc_id"], r["doc_tokens"]])
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in want)
    assert all(n == window or n & (n - 1) == 0 for n in lengths.values())
    made = packing.sequences(pieces, atoms, path).collect()
    assert {r["sequence_id"]: r["length"] for r in made} == lengths
    assert sorted(b"".join(r["ids"] for r in made)) == sorted(b"".join(np.array(x, "<u4").tobytes() for _, x in want))


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, tokenizer_path(NAMES[1]), 2)[0].count() == 0
