"""Decontamination: every placement of the tolerated substitutions, in long and short items."""

from itertools import combinations

import pytest

from pixelloom.llm import decontaminate
from pixelloom.llm.words import Words
import pyarrow as pa


def found(item, text):
    w = Words(pa.array([text]), lower=True)
    return decontaminate.overlaps_of(w.hashes(), w.at, decontaminate.Items([0], [item]))


@pytest.mark.parametrize("n,most", [(5, 1), (7, 1), (10, 2), (12, 2), (13, 2), (15, 3), (18, 3)])
def test_every_placement(n, most):
    words = [f"w{k}" for k in range(n)]
    for c in range(most + 1):
        for gone in combinations(range(n), c):
            text = ["x", "y", *("other" if k in gone else w for k, w in enumerate(words)), "z"]
            assert found(" ".join(words), " ".join(text)), gone
    assert not found(" ".join(words), " ".join("other" if k % 3 == 0 else w for k, w in enumerate(words)))


def test_stretch_of_long_texts():
    words = [f"w{k}" for k in range(60)]
    part = [*(f"p{k}" for k in range(30)), *words[20:33], *(f"q{k}" for k in range(30))]
    part[30] = "other"
    assert found(" ".join(words), " ".join(part))
    part[33] = part[36] = "other"
    assert not found(" ".join(words), " ".join(part))


def test_repeated_words_make_few_hits():
    item, text = " ".join(["same"] * 1500), " ".join(["other", *["same"] * 1500, "end"])
    w = Words(pa.array([text]), lower=True)
    items = decontaminate.Items([0], [item])
    here, _ = items.hits(w.hashes(), w.doc)
    assert len(here) < 10_000
    got = decontaminate.overlaps_of(w.hashes(), w.at, items)
    assert max((x[4], x[2], x[3]) for x in got)[0] >= 1500
    two = " ".join(["a", "b"] * 400)
    w = Words(pa.array(["x " + two, two + " y", "a b " * 6 + "a"]), lower=True)
    got = decontaminate.overlaps_of(w.hashes(), w.at, decontaminate.Items([0], ["q " + two + " z"]))
    assert [max(x[4] for x in got if x[0] == k) for k in range(3)] == [800, 800, 13]


def brute(item, text):
    """The longest stretch on any diagonal of 13 words or more (the item, if shorter) with 80 % equal ones."""
    best = 0
    least = min(13, len(item))
    for shift in range(-len(item) + 1, len(text)):
        lo, hi = max(0, shift), min(len(text), shift + len(item))
        equal = [text[k] == item[k - shift] for k in range(lo, hi)]
        for a in range(len(equal)):
            for e in range(a + least, len(equal) + 1):
                if sum(equal[a:e]) >= 0.8 * (e - a) - 1e-9:
                    best = max(best, e - a)
    return best


def test_against_all_diagonals():
    import random

    rng = random.Random(4)
    for _ in range(120):
        item = [f"w{rng.randrange(60)}" for _ in range(rng.choice([5, 8, 13, 16, 20, 30]))]
        a = rng.randrange(len(item))
        part = item[a:] if rng.random() < 0.3 else list(item)
        for k in range(len(part)):
            if rng.random() < rng.choice([0.05, 0.2, 0.3]):
                part[k] = f"x{k}"
        text = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(20))] + part + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(20))]
        got = found(" ".join(item), " ".join(text))
        assert bool(got) == bool(brute(item, text)), (item, text)
