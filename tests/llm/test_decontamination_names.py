"""Capitals at any place, short items and items of few literal words."""

import numpy as np
import pytest

from notesift.llm import decontamination as dec

ITEMS = [
    (1, "What is the tallest peak on Earth today"),
    (2, "John has 5 apples and buys 7 more. How many now?"),
    (3, "What is 12 times 7?"),
    (4, "John walked to the big market with Anna. Peter sold him 3 pears. Maria ate 2 of the ripe ones at home. How many are left?"),
    (5, "Solve 3x+2=11 now"),
]


def ids(text):
    with np.errstate(over="ignore"):
        return {x[0] for x in dec.leaks(dec.Items.of(ITEMS), dec.Templates(), text)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("... see also What is the tallest peak on Earth today", {1}),
        ("see also what is the tallest peak on earth today", {1}),
        ("What Is The Tallest Peak On Earth Today", {1}),
        ("Mary has 5 apples and buys 7 more. How many now?", {2}),
        ("so Mary has 9 apples and buys 4 more. how many now?", {2}),
        ("Ask: What is 12 times 7? Then stop.", {3}),
        ("What is 13 times 7?", {3}),
        ("What is 13 plus 7?", set()),
        ("Eva walked to the big market with Ida. Karl sold him 8 pears. Nora ate 6 of the ripe ones at home. How many are left?", {4}),
        ("please solve 3x+2=11 now, quickly", {5}),
        ("please solve 4x+2=11 now, quickly", {5}),
        ("please solve 4x+2=12 now, quickly", set()),
        ("Mary has five pears and sells 7 more. How many now?", set()),
    ],
)
def test_places_of_capitals_do_not_matter(text, want):
    assert ids(text) == want
