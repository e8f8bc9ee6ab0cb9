"""Ids of several texts at once, against the library."""

import random

import numpy as np
import pytest

from tonelake.llm import shingles, tokenfiles, tokens


@pytest.fixture(scope="module")
def encoder():
    of = tokens.Encoder(tokens.default_path(), 1000)
    assert of.by_chunk
    return of


def odd_texts(seed, n):
    rng = random.Random(seed)
    marks = ["'", "’", ".", "***", "-", "0", "12", "́", "̸", "=", "é", "É", "Σ", "σ", "漢", " ", "　", " ", "\n", "\t ", "\x1c", "\x85", "…", "s", "t", "LL", "<|", "|>"]
    texts = ["".join(rng.choice(marks) if rng.random() < 0.6 else rng.choice(["don", "word", "X", "straße", "a" * 9, "bc" * 40]) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [None, b"", b" ", *(t.encode() for t in texts), b"a <|EndOfText|> b"[: 8 if seed else None]]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_ids_of_several_texts(encoder, seed):
    texts = odd_texts(seed, 400)
    want = [encoder.whole(t or b"") for t in texts]
    ids, sizes = encoder.all_ids(texts)
    assert ids.tobytes() == b"".join(want) and sizes.tolist() == [len(w) // 4 for w in want]
    ids, sizes = encoder.all_ids([])
    assert not len(ids) and not len(sizes)


def test_equal_pieces_are_looked_up_once():
    class Counted(tokens.Encoder):
        looked = 0

        def __getitem__(self, key):
            self.looked += 1
            return dict.__getitem__(self, key) if key in self else self.__missing__(key)

    of = Counted(tokens.default_path(), 1000)
    of.looked = 0
    texts = [b"two words, two words*** and words."] * 500
    ids, sizes = of.all_ids(texts)
    assert ids.tobytes() == of.whole(texts[0]) * 500 and of.looked < 20


def test_clashing_hashes_change_no_id(encoder, monkeypatch):
    texts = odd_texts(3, 50)
    want = b"".join(encoder.whole(t or b"") for t in texts)
    monkeypatch.setattr(shingles, "hashes_at", lambda text, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(20))
    assert encoder.all_ids(texts)[0].tobytes() == want


def test_equal_at_sees_every_byte():
    word = b"k" * 200
    for n in (9, 16, 17, 40, 64, 65, 200):
        for i in range(8, n):
            text = word[:n] + b" " + word[:i] + b"j" + word[i + 1 : n]
            assert not shingles.equal_at(text, np.array([n + 1]), np.array([2 * n + 1]), np.array([0]))
        assert shingles.equal_at(text, np.array([0]), np.array([n]), np.array([0]))


@pytest.mark.parametrize("most", [0, 1, 15, 17, 20, 30, 31, 60])
def test_blocks_take_the_most_values_a_word(most):
    values = np.random.default_rng(most).integers(0, 1 << most, 5000, dtype=np.uint64) >> np.random.default_rng(1).integers(0, most + 1, 5000).astype(np.uint64)
    words, at, n = tokenfiles.encode_block(values), 0, 0
    bits = [int(v).bit_length() for v in values]
    while at < len(values):
        at += next(c for s in range(1, 16) if max(bits[at : at + (c := tokenfiles.COUNTS[s])], default=0) <= tokenfiles.BITS[s])
        n += 1
    assert len(words) == n and (tokenfiles.decode_block(words, len(values)) == values).all()
