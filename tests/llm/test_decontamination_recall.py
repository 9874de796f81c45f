"""Re-parameterised questions: how many are found, and that other texts aren't."""

import random
import re

import numpy as np

from notesift.llm import decontamination as dec

NAMES = "Anna Bert Clara David Emma Frank Greta Henry Ida Jonas Karl Lena Martin Nora Oscar Paula Quinn Rosa Simon Tilda".split()
UNITS = "km miles kg pounds hours minutes litres cups dollars euros".split()
WORDS = "the train market river old green before after walks buys gives finds basket garden window letters carries together slowly evening morning yellow stones bridge and then counts shares with".split()


def question(rng):
    """A question with numbers, names and units, of 8 to 45 words."""
    out = []
    for _ in range(rng.randrange(7, 40)):
        kind = rng.random()
        out.append("{name}" if kind < 0.1 else "{n}" if kind < 0.2 else "{n} {unit}" if kind < 0.25 else rng.choice(WORDS))
        if rng.random() < 0.08:
            out[-1] += "."
    return " ".join([rng.choice(("{name}", "The", "A")), *out]) + " How many are left?"


def filled(rng, template):
    """Values for the slots; a number or a name that occurs again is another one each time, or the same."""
    fill = {"name": lambda: rng.choice(NAMES), "n": lambda: str(rng.randrange(2, 500)), "unit": lambda: rng.choice(UNITS)}
    return re.sub(r"\{(\w+)\}", lambda m: fill[m[1]](), template)


def changed(rng, text):
    """Other names, numbers and units, each for each."""
    names, numbers, units = dict(zip(NAMES, rng.sample(NAMES, len(NAMES)), strict=True)), {}, dict(zip(UNITS, rng.sample(UNITS, len(UNITS)), strict=True))

    def other(m):
        word = m[0]
        if word.isdigit():
            return numbers.setdefault(word, str(rng.randrange(500, 999)))
        return names.get(word) or units.get(word) or word

    return re.sub(r"\w+", other, text)


def test_nine_of_ten_changed_questions_are_found():
    rng = random.Random(4)
    items = [(k, filled(rng, question(rng))) for k in range(300)]
    made, templates, found, wrong = None, dec.Templates(), 0, 0
    with np.errstate(over="ignore"):
        made = dec.Items.of(items)
        for k, text in items:
            around = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(2)]
            got = {x[0] for x in dec.leaks(made, templates, f"{around[0]}. {changed(rng, text)} {around[1]}")}
            found += k in got
            wrong += len(got - {k})
        clean = sum(bool(dec.leaks(made, templates, filled(rng, question(rng)))) for _ in range(300))
    assert found >= 0.9 * len(items)
    assert wrong <= 3 and clean <= 3


FORMS = (
    "What is {n} times {n}?",
    "Is {n} larger than {n}?",
    "Compute {n} plus {n} minus {n}.",
    "What is {n} percent of {n}?",
    "Who met {name} in {n}?",
    "What is {n} squared?",
    "How many pages are {n} {unit} of reading?",
    "Does {name} still owe {name} {n} dollars?",
    "Divide {n} by {n} and add {n}.",
    "When did {name} leave {name} with {n} books?",
    "{name} walks {n} {unit} before lunch.",
    "How old was {name} in {n}?",
)


def test_short_questions_with_other_values_are_found():
    """Items whose literal words are few, in texts of other words, and texts that hold none of them."""
    rng = random.Random(9)
    items = [(k, filled(rng, FORMS[k % len(FORMS)])) for k in range(40 * len(FORMS))]
    templates, found, clean = dec.Templates(), [0] * len(FORMS), 0
    with np.errstate(over="ignore"):
        made = dec.Items.of(items)
        for k, text in items:
            around = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(2)]
            got = {x[0] for x in dec.leaks(made, templates, f"{around[0]}. {changed(rng, text)} {around[1]}")}
            found[k % len(FORMS)] += k in got
        clean = sum(bool(dec.leaks(made, templates, filled(rng, question(rng)))) for _ in range(300))
    assert min(found) >= 36, found
    assert clean <= 3


def test_short_items_need_three_literal_words_and_consistent_slots():
    """A unit without a number before it is a word; a text with other words in its place isn't the item."""
    with np.errstate(over="ignore"):
        made, templates = dec.Items.of([(1, "Who met Anna in 1900?"), (2, "Is 5 prime?"), (3, "What is 7 times 7?")]), dec.Templates()
        hits = lambda text: {x[0] for x in dec.leaks(made, templates, text)}
        assert hits("He asked who met Carl in 2001 again") == {1}
        assert hits("Bert met Carl in 2001") == set()
        assert hits("Is 9 prime?") == set() and hits("Is 5 prime?") == {2}
        two = dec.Items.of([(4, "Does Anna owe Bert 5 dollars?"), (5, "How many km are 3 miles?")])
        found = lambda text: {x[0] for x in dec.leaks(two, templates, text)}
        assert found("Does Carl owe Dora 9 dollars?") == set() and found("Does Anna owe Bert 5 dollars?") == {4}
        assert found("How many km are 9 feet?") == {5} and found("How many feet are 9 miles?") == set()
        assert hits("What is 8 times 8?") == {3} and hits("What is 8 times 9?") == set()
