import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from llm_fixtures import documents, empty, odd, small  # noqa: F401
from tickloom.llm import queries, token_files
from tickloom.llm.dac import Codes, pack

VOCABULARY = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1], [3] * 1000])
def test_codes_round_trip(ids):
    codes = Codes(pack(np.array(ids, np.uint32)))
    assert len(codes) == len(ids) and codes.slice(0, len(ids)).tolist() == ids


def test_random_access():
    rng = random.Random(1)
    ids = [rng.randrange(1 << rng.choice([4, 8, 12, 16, 20, 32])) for _ in range(20_000)]
    codes = Codes(pack(np.array(ids, np.uint32)))
    places = [rng.randrange(len(ids)) for _ in range(3000)]
    assert codes.get(np.array(places)).tolist() == [ids[p] for p in places]


def test_slices_are_read_by_the_ranks_of_their_ends(monkeypatch):
    rng = random.Random(4)
    for n in (1, 63, 64, 65, 128, 1000):
        ids = [rng.randrange(1 << rng.choice([4, 8, 9, 16, 20, 32])) for _ in range(n)]
        codes = Codes(pack(np.array(ids, np.uint32)))
        monkeypatch.setattr(codes, "get", lambda places: pytest.fail("a slice is no list of places"))
        for a, b in [(0, 0), (0, n), (n, n), (n - 1, n), *(sorted((rng.randrange(n + 1), rng.randrange(n + 1))) for _ in range(60))]:
            assert codes.slice(a, b).tolist() == ids[a:b]


def test_pieces_encode_as_the_library(tokenizer, documents):
    rng, model = random.Random(2), token_files.pieces(VOCABULARY)
    texts = [d["text"] for d in documents]
    texts += ["".join(rng.choice(["a", "Be", " ", "  ", "\n", "\t", "'s", "é", "　", " ", "12", "!", "🙂", "\x1c", "\x00", "\x85", "\u2003", "\u200a ", "<|endoftext|>"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "  ", "a ", " a", "<|endoftext|> x", "x" * 5000]
    texts += ["a.\nB c", "a\n\nb", "\na b\n", "x y\nz\nw v", "x\r\ny z", "a \nb", "q a\n b"]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    for text, ids in zip(texts, want):
        assert np.frombuffer(model.ids(text), "<u4").tolist() == ids, repr(text)
    flat, bounds = model.many(pa.array(texts, pa.string()))
    for text, ids, a, b in zip(texts, want, bounds, bounds[1:]):
        assert flat[a:b].tolist() == ids, repr(text)


def test_words_behind_line_ends_and_before_signs_go_side_by_side(tokenizer):
    """Words of letters that differ in the signs behind them or in what stands before a line end: the library encodes none of them alone."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", ",", "$$$", "?!", "%%%", "))"])
    texts = [" ".join(word() + (f"\n{word()}" if rng.random() < 0.3 else "") for _ in range(60)) for _ in range(100)]
    texts += ["a\nb\nc\nd", "a\x01\nb", "\x01\nx y", "x \x01\ny", "a\x00\nb", "x \ny", "a\n\nb c", "a\n\x85b", "a\u00a0\nb", "don't\n's 't", "a'\n'b", "x\r\ny", "a.\n.b c-\n-d"]
    model, alone = token_files.Pieces(tokenizer), []
    encoded = model.encoded
    model.encoded = model.heads.make = lambda text: alone.append(text) or encoded(text)
    flat, bounds = model.many(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert flat[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(alone) < 200, alone[:20]  # first words and the odd texts


def test_new_pieces_of_letters_digits_and_signs_are_not_made_one_by_one(tokenizer):
    """Words met once, with digits and signs inside and around: none of them is encoded alone; those the vocabulary's rule treats otherwise are."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ab", "Qé", "ɏß", "7", "42", "-", "...", "_", "$%", "'\"", "'9", "x"]) for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(["The", *(word() for _ in range(60))]) + f"\n{word()} {word()}\n{word()}" for _ in range(100)]
    model, alone = token_files.Pieces(tokenizer), []
    make = model.after_blank.make
    model.after_blank.make_many = lambda found: alone.extend(found) or list(map(make, found))
    flat, bounds = model.many(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert flat[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert not alone, alone[:20]
    odd = ["a don't we'll 'tis x'9's", "a 3×4 ×b a÷c ɐb cɐ ª1 µm ½x 漢a \u0301e", "a x\ty z\x00q \x7f \xa0b", f"a {'longer' * 30} {'=' * 100} {'8' * 60}. {'x1' * 3000} {'y2' * 2048}", "a  b", "a x\n's y\n÷"]
    flat, bounds = model.many(pa.array(odd, pa.string()))
    for text, a, b in zip(odd, bounds, bounds[1:]):
        assert flat[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    flat, bounds = model.many(pa.array([], pa.string()))
    assert not len(flat) and bounds.tolist() == [0]


def test_query_equals_brute_force(spark, small, documents, tokenizer):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_codes(spark, small).collect()}
    at, want = 0, {}
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = np.array(tokenizer.encode(d["text"], add_special_tokens=False).ids + [2], "<u4")
        want[d["doc_id"]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_small_blocks_give_the_same(spark, odd, tmp_path, monkeypatch):
    folders = [str(tmp_path / name) for name in ("one", "many")]
    token_files.write(odd, folders[0], VOCABULARY)
    rows = [sorted(map(tuple, token_files.read(spark, f).collect()), key=str) for f in folders[:1]]
    starts = sorted((r[1], r[2]) for r in rows[0])
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert len(rows[0]) == 11 and [r[0] for r in rows[0] if r[1] == 0] == [None]
    assert [r[2] for r in rows[0] if r[0] in (3, 4)] == [1, 1]


def test_empty_table(spark, empty, tmp_path):
    token_files.write(empty, str(tmp_path / "none"), VOCABULARY)
    assert token_files.read(spark, str(tmp_path / "none")).collect() == []
