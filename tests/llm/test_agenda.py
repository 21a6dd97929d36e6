import random

import numpy as np
import pytest

from tickloom.llm.agenda import Agenda


def one_by_one(pairs, word):
    word = list(word)
    while True:
        found = [(pairs[p][0], k) for k, p in enumerate(zip(word, word[1:])) if p in pairs]
        if not found:
            return word
        _, k = min(found)
        word[k : k + 2] = [pairs[word[k], word[k + 1]][1]]


@pytest.mark.parametrize("size", [30, 600, 40_000])
@pytest.mark.parametrize("costs", [3, 10**6])
def test_rows_are_joined_as_one_word_is(size, costs):
    """Equal costs of pairs that become different symbols too: the leftmost is joined."""
    rng = random.Random(size + costs)
    some = [rng.randrange(size) for _ in range(20)] + [0, size - 1]
    pairs = {(rng.choice(some), rng.choice(some)): (float(rng.randrange(costs)), rng.choice(some)) for _ in range(250)}
    agenda = Agenda(pairs, size)
    words = [[rng.choice(some) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 30, 47, 48, 60]))] for _ in range(400)]
    words += [[some[0], -1, some[1]], [-1], [-1, -1]]
    flat = np.array([x for w in words for x in w], np.int32)
    for word, ids in zip(words, agenda.words(flat, np.array(list(map(len, words)), np.int64))):
        if 0 < len(word) < 48 and -1 not in word:
            assert np.frombuffer(ids, "<i4").tolist() == one_by_one(pairs, word)
        else:
            assert ids is None


def test_no_words_and_no_pairs():
    assert Agenda({(0, 1): (1.0, 2)}, 3).words(np.empty(0, np.int32), np.empty(0, np.int64)) == []
    assert np.frombuffer(Agenda({}, 3).words(np.array([0, 1, 2], np.int32), np.array([3]))[0], "<i4").tolist() == [0, 1, 2]
