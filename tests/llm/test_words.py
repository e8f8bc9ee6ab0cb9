"""Words hashed by their places, and the sets built on them, against plain versions."""

import random

import numpy as np
import pytest

from tonelake.llm import passages, shingles


def some_words(rng, n):
    return ["".join(rng.choice("abcXYZé漢0.") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 64, 65, 200]))).encode() for _ in range(n)]


def test_words_are_hashed_by_their_bytes_alone():
    rng = random.Random(5)
    found = some_words(rng, 3000)
    text = b"".join(w + rng.choice([b" ", b"\n", b"\t\r", b"  "]) for w in [*found, *reversed(found)]) + found[0]
    starts, ends = passages.word_spans(text)
    plain, got = text.split(), shingles.hashes_at(text, starts, ends).tolist()
    assert len(got) == len(plain) and len(set(zip(plain, got))) == len(set(plain)) == len(set(got))
    again = shingles.hashes_at(found[0], *passages.word_spans(found[0]))
    assert again.tolist() == got[-1:]
    assert not len(shingles.hashes_at(b"", *passages.word_spans(b"")))


def test_cut_words_are_not_hashed_one_by_one(monkeypatch):
    """A table of words grows with them, and is emptied over and over where few words recur."""

    class Unused(dict):
        def __missing__(self, word):
            raise AssertionError(word)

    monkeypatch.setattr(shingles, "_hashes", Unused())
    rng = random.Random(6)
    texts = [b" ".join(some_words(rng, n)) for n in (0, 1, 80, 300)] + [None]
    w = passages.Words(texts)
    assert (w.upto - w.first).tolist() == [0, 1, 80, 300, 0]
    assert (w.hashes == np.concatenate([passages.Words([t]).hashes for t in texts])).all()
    assert (passages.Words([t and t.lower() for t in texts]).hashes == w.hashes).all()


@pytest.mark.parametrize("width", [1, 2, 26])
def test_chosen_windows_by_brute_force(width):
    rng = np.random.default_rng(width)
    values, of = rng.integers(0, 9, 400), rng.random(401 - width) < 0.7
    want = {max(range(i, i + width), key=lambda k: (-values[k], k)) for i in np.flatnonzero(of).tolist()}
    assert passages._chosen(values, width, of).tolist() == sorted(want)


def test_distinct_parts_are_sets():
    values = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    starts, stops = np.array([0, 0, 10, 10, 400, 500]), np.array([0, 40, 60, 9, 500, 500])
    got, sizes = shingles.distinct_parts(values, starts, stops)
    want = [sorted(set(values[a:b].tolist())) for a, b in zip(starts, stops)]
    assert sizes.tolist() == [len(x) for x in want] and got.tolist() == [v for x in want for v in x]
    assert not len(shingles.distinct_parts(values[:0], starts[:0], stops[:0])[0])


def test_places_of_a_window_in_its_text():
    n, key, at = np.array([0, 0, 0, 0, 2, 2]), np.array([7, 5, 7, 7, 7, 5]), np.array([1, 2, 4, 9, 0, 3])
    low, high = passages._ends_of(n, key, at)
    assert low.tolist() == [1, 2, 1, 1, 0, 3] and high.tolist() == [9, 2, 9, 9, 0, 3]


def test_words_that_repeat_with_a_period(spark):
    """Whatever the words' hashes, all copies of such passages are found."""
    rng = random.Random(1)

    def words(n):
        return [rng.choice("ka lo mi ru se ta vu ze na po".split()) + rng.choice("x y z w q".split()) + str(rng.randrange(40)) for _ in range(n)]

    texts = [(turn * 30)[: 51 + 2 * k] for _ in range(60) for k, turn in enumerate([words(2), words(5), words(13), words(3)])]
    rows = [(2 * k + j, " ".join(words(rng.randrange(10, 60)) + t + words(rng.randrange(0, 60)))) for k, t in enumerate(texts) for j in range(2)]
    assert {r.doc_id for r in passages.repeats(spark.createDataFrame(rows, "id long, text string")).collect()} == set(range(len(rows)))
