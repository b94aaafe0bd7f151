import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.constants import WARNING_TEXT_NORMALIZED
from attestra.functions import fuzzy


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def slow_ratio(a, b):
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def slow_partial(a, b):
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0

    def best(s, t):
        return max(slow_ratio(s, t[max(i, 0): i + len(s)]) for i in range(1 - len(s), len(t)))

    s, t = (a, b) if len(a) <= len(b) else (b, a)
    return max(best(s, t), best(t, s)) if len(a) == len(b) else best(s, t)


words = st.text(alphabet="abcde é😀", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=6), st.sampled_from([4, 9, 3072]))
def test_scores_equal_brute_force(pairs, piece):
    kept, fuzzy.PIECE = fuzzy.PIECE, piece
    try:
        partial, whole = fuzzy.partial_ratios(pairs), fuzzy.ratios(pairs)
    finally:
        fuzzy.PIECE = kept
    for pair, p, w in zip(pairs, partial, whole):
        assert p == pytest.approx(slow_partial(*pair), abs=1e-9)
        assert w == pytest.approx(slow_ratio(*pair), abs=1e-9)


def test_long_text_over_several_pieces():
    rnd = random.Random(7)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(7000))
    needle = text[5000:5012] + "zz" + text[5012:5030]
    assert fuzzy.partial_ratios([(needle, text)])[0] == pytest.approx(slow_partial(needle, text))


def test_needle_longer_than_small_integers():
    text = "ab" * 9000
    assert fuzzy.partial_ratios([("c" + text[:6000], text)])[0] > 99.9


def test_fixed_values():
    altered = "x " + WARNING_TEXT_NORMALIZED.replace("surgeon", "surgical") + " y"
    assert fuzzy.partial_ratios([(WARNING_TEXT_NORMALIZED, altered)])[0] == pytest.approx(98.54, abs=.005)
    assert fuzzy.ratios([("750 ml", "700 ml")])[0] == pytest.approx(83.333, abs=.001)


def test_columns_with_nulls_and_containment(spark):
    rows = [("abc", "xxabcxx"), ("abd", "xxabcxx"), (None, "x"), ("", ""), ("", "x"), ("longer", "long")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(fuzzy.partial_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100.0 and got[2] is None and got[3] == 100.0 and got[4] == 0.0
    assert got[1] == pytest.approx(slow_partial("abd", "xxabcxx")) and got[5] == 100.0
    same = [r[0] for r in df.select(fuzzy.ratio(F.col("a"), F.col("b"))).collect()]
    assert same[3] == 100.0 and same[1] == pytest.approx(slow_ratio("abd", "xxabcxx"))


def test_ratios_of_many_lanes_equal_dynamic_programming():
    rng = random.Random(11)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    pairs = [(None, "a"), ("", "a"), ("", ""), ("same", "same")]
    for low, high in ((1, 12), (60, 68), (120, 130)):
        pairs += [tuple("".join(rng.choice("abcé 😀") for _ in range(rng.randint(low, high))) for _ in "xy") for _ in range(150)]
    pairs += [(b, a) for a, b in pairs]
    want = [None if a is None or b is None else 100.0 if a == b else 200.0 * common(a, b) / (len(a) + len(b)) for a, b in pairs]
    assert fuzzy.ratios(pairs) == pytest.approx(want)


def test_letters_scored_at_once_are_bounded(monkeypatch):
    pairs = [("abcd", f"{k:05d}ab{k % 7}cd") for k in range(500)] + [("abcd", "x" * 300), (None, "a"), ("ab", "ba")]
    whole = fuzzy.partial_ratios(pairs)
    swept, inner = [], fuzzy._column_starts
    monkeypatch.setattr(fuzzy, "LETTERS", 200)
    monkeypatch.setattr(fuzzy, "_column_starts", lambda some: swept.append(
        [len(a) + len(b) for a, b in some]) or inner(some))
    assert fuzzy.partial_ratios(pairs) == whole
    assert all(sum(sizes) <= 200 or len(sizes) == 1 for sizes in swept)
