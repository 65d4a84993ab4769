"""What meets by deletions and by runs against a comparison of all pairs, and the ratio against the library's."""

import difflib
import random
from collections import Counter

import pytest

from civicgrid.functions import text as T
from civicgrid.operators import dedup


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def in_common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def changed_names(r, lengths, letters, n):
    """Names in groups that differ by some letters."""
    out = []
    while len(out) < n:
        name = [r.choice(letters) for _ in range(r.choice(lengths))]
        for _ in range(5):
            out.append("".join(name))
            for _ in range(r.randint(1, 3)):
                at, letter = r.randint(0, len(name) - 1), r.choice(letters)
                name[at : at + r.randint(0, 1)] = [letter] if r.random() < 0.7 or len(name) == 1 else []
            name = name or [letters[0]]
    return sorted(set(out[:n]))


def test_numbered_names_meet_by_what_they_share_only(spark):
    r = random.Random(3)
    names = [f"customer#{n:09d}" for n in sorted(r.sample(range(30_000), 900))]
    rows = spark.createDataFrame([("x", i, n) for i, n in enumerate(names)], "city string, ord long, clean string")
    want = {(i, j) for j, b in enumerate(names) for i, a in enumerate(names[:j]) if in_common(a[9:], b[9:]) >= 8}
    got = dedup.meeting_names(rows, 0.9, None).collect()
    assert sorted((x["ord_a"], x["ord_b"]) for x in got) == sorted(want) and 1000 < len(want) < 0.05 * len(names) ** 2 / 2


@pytest.mark.parametrize("lengths", [[range(1, 9), (10, 18)], [range(5, 40), range(20, 90)]])
@pytest.mark.parametrize(("threshold", "within"), [(0.85, 5), (0.88, 1), (0.9, None)])
def test_no_pair_is_lost_or_found_twice(spark, lengths, threshold, within):
    names = [n for some in lengths for n in changed_names(random.Random(len(some)), some, "abcdé ", 150)]
    rows = spark.createDataFrame([("xy"[k], i, n) for i, n in enumerate(names) for k in range(1 + (i % 3 == 0))], "city string, ord long, clean string")
    got = Counter((x["city"], x["a"]["ord"], x["b"]["ord"]) for x in dedup.close_pairs(rows, threshold, within).collect())
    inside = lambda a, b: within and min(len(a), len(b)) >= within and (a in b or b in a)
    pairs = [(i, j) for j, b in enumerate(names) for i, a in enumerate(names[:j]) if inside(a, b) or max(ratio(a, b), ratio(b, a)) >= threshold]
    want = {(c, i, j) for i, j in pairs for c in "xy" if c == "x" or i % 3 == 0 == j % 3}
    assert want <= set(got) and len(want) > 30 and set(got.values()) == {1}


def test_changed_names_meet_the_others(spark):
    names = changed_names(random.Random(5), (10, 11, 18), "0123", 200)
    rows = spark.createDataFrame([("x", i, n, i % 10 == 0) for i, n in enumerate(names)], "city string, ord long, clean string, changed boolean")
    pairs = lambda df: {(x["a"]["ord"], x["b"]["ord"]) for x in dedup.close_pairs(df, 0.85, None).collect()}
    assert pairs(rows) == {p for p in pairs(rows.drop("changed")) if p[0] % 10 == 0 or p[1] % 10 == 0} != set()


def test_no_names(spark):
    rows = spark.createDataFrame([("x", 1, ""), ("x", 2, "")], "city string, ord long, clean string")
    for within in (None, 5):
        assert dedup.close_pairs(rows, 0.9, within).count() == dedup.meeting_names(rows, 0.9, within).count() == 0


def test_ratio_is_that_of_the_library():
    r = random.Random(9)
    texts = ["", "a", "b" * 230, "b" * 199 + "a", *["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for letters in ("ab", "abcd", "customer#0123456789") for _ in range(60)]]
    assert all(T.block_ratio(a, b) == ratio(a, b) for a in texts for b in texts)
