"""Spellings against all pairs scored one by one: edits, swaps, long values, word order, hot blocks."""

import random
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pytest

from tablewright.operators import correct, spelling


def plain_likeness(a, b, sa, sb):
    return max(SequenceMatcher(None, a, b, autojunk=False).ratio(), SequenceMatcher(None, sa, sb, autojunk=False).ratio())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before if x == y else 1 + min(before, row[j], row[j - 1])
    return row[-1]


def alike(a, b):
    sa, sb = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    r = plain_likeness(a, b, sa, sb)
    return r >= 0.85 and (r >= 0.92 or edits(a, b) <= 4)


def changed(r, text, times, letters="abcdefghijklmnopqrstuvwxyz"):
    own = list(text)
    for _ in range(times):
        kind, k = r.randrange(4), r.randrange(len(own) + 1)
        if kind == 0:
            own.insert(k, r.choice(letters))
        elif kind == 1 and len(own) > 1:
            own.pop(min(k, len(own) - 1))
        elif kind == 2 and own:
            own[min(k, len(own) - 1)] = r.choice(letters)
        elif len(own) > 1:  # a swap of neighbours
            k = min(k, len(own) - 2)
            own[k], own[k + 1] = own[k + 1], own[k]
    return "".join(own)


def planted(r, sizes, families, letters="abcdefghijklmnopqrstuvwxyz"):
    out = set()
    for _ in range(families):
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(30)]
        size = r.choice(sizes)
        base = " ".join(words)[:size].strip() or "a"
        out |= {base, *(changed(r, base, k, letters) for k in (1, 2, 2, 3, 4, 6))}
        shuffled = base.split()
        r.shuffle(shuffled)
        out |= {" ".join(shuffled), changed(r, " ".join(shuffled), 2, letters), " ".join(reversed(base.split()))}
    return sorted(" ".join(x.split()) for x in out)


def found_pairs(spark, texts):
    rows = [(i, 7, t, " ".join(sorted(t.split()))) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, scope long, form string, sorted string")
    return {(r.a, r.b) for r in spelling.candidate_pairs(frame).collect()}


@pytest.mark.parametrize("sizes,families,letters", [((1, 2, 3, 5, 8), 40, "abcd"), ((9, 12, 14, 17, 20), 30, "abcdefgh"), ((19, 22, 24, 26, 30), 25, "abcdefghij"), ((100, 150, 200, 260), 8, "abcdefghijklmnopqrstuvwxyz")])
def test_no_pair_is_missing(spark, sizes, families, letters):
    texts = planted(random.Random(sum(sizes)), sizes, families, letters)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(texts[i], texts[j])}
    found = found_pairs(spark, texts)
    assert want <= found and len(want) > families


def test_two_swaps_in_fourteen_letters(spark):
    texts = ["abcdefghijklmn", "bacdefghijklnm", "abdcefghijlkmn", "zzzzzzzzzzzzzz"]
    assert {(0, 1), (0, 2)} <= found_pairs(spark, texts)


def test_hot_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 16)
    monkeypatch.setattr(spelling, "PAIRS", 64)
    r = random.Random(5)
    texts = sorted({changed(r, "the same street", r.randint(0, 3)) for _ in range(150)})
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(texts[i], texts[j])}
    assert want <= found_pairs(spark, texts)


def test_strings_of_small_scopes_meet_by_the_scope(spark):
    """Long strings in scopes of a few: a row or two each, not one per run, and the same pairs."""
    r = random.Random(9)
    texts = planted(r, (14, 40, 160), 12)
    rows = [(i, i // 40, t, " ".join(sorted(t.split()))) for i, t in enumerate(texts)] + [(1000 + i, 99, f"{t} x", f"{t} x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, scope long, form string, sorted string")
    small = frame.filter("scope < 99")
    assert spelling.meeting_rows(small).count() <= 4 * len(texts)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if i // 40 == j // 40 and alike(texts[i], texts[j])}
    found = {(x.a, x.b) for x in spelling.candidate_pairs(frame).collect()}
    assert want <= found and len(want) > 5
    assert all(scopes[a] == scopes[b] for scopes in [{x[0]: x[1] for x in rows}] for a, b in found)


def test_matching_blocks_equal_the_plain_scorer():
    r = random.Random(6)
    a = ["".join(r.choice("abcd ") for _ in range(r.randrange(40))) for _ in range(800)] + ["", "", "x" * 300, "ab" * 150, "é漢字😀 x"]
    b = [changed(r, x, r.randrange(6), "abcd ") if x and r.random() < 0.8 else "dcba" * r.randrange(4) for x in a[:-5]] + ["", "a", "x" * 280, "ba" * 140, "é漢字 😀x"]
    want = [sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) for x, y in zip(a, b)]
    assert spelling.matched(a, b).tolist() == want


def test_character_bound_never_closes_a_pair():
    r = random.Random(7)
    a = planted(r, (3, 6, 10, 16, 30), 60, "abcde")
    pairs = [(x, y) for x in a for y in r.sample(a, 20)]
    open_ = spelling.may_be_alike(spelling.character_counts([x for x, _ in pairs]), spelling.character_counts([y for _, y in pairs]))
    for (x, y), may in zip(pairs, open_):
        if plain_likeness(x, y, " ".join(sorted(x.split())), " ".join(sorted(y.split()))) >= 0.85:
            assert may


def plain_merges(values):
    """The merges of a column by all pairs: {old: (new, confidence)}; values as {value: times}, no case variants among them."""
    best = {}
    digits = lambda v: "".join(c for c in v if c in "0123456789")
    for old, n in values.items():
        for new, m in values.items():
            if new == old or not (m > n or (m == n and new < old)) or digits(new) != digits(old):
                continue
            a, b = new.lower(), old.lower()
            ratio = plain_likeness(a, b, " ".join(sorted(a.split())), " ".join(sorted(b.split())))
            if ratio >= 0.85 and (ratio >= 0.92 or edits(a, b) <= 4):
                best[old] = max(best.get(old, (0,)), (ratio, m, [-ord(c) for c in new], new))
    return {old: (b[3], float(Decimal(repr(b[0])).quantize(Decimal("0.01"), ROUND_HALF_UP))) for old, b in best.items() if b[3] not in best}


def test_merges_equal_all_pairs(spark):
    r = random.Random(8)
    texts = planted(r, (5, 9, 14, 22, 40, 160), 30)
    values = {t: r.randint(1, 6) for t in texts if t and not t.startswith(("a ", "an ", "the "))}
    values |= {"unit 12 of block 7": 3, "unit 12 of blok 7": 1, "unit 13 of block 7": 1}
    df = spark.createDataFrame([(t,) for t, n in values.items() for _ in range(n)], "c string")
    got = {x.old_value: (x.new_value, x.confidence) for x in correct.fuzzy_merges(df).collect()}
    assert got == plain_merges(values)
    assert got["unit 12 of blok 7"][0] == "unit 12 of block 7" and "unit 13 of block 7" not in got
    assert any(len(x) >= 150 for x in got)


def test_no_values_and_one_value(spark):
    assert correct.fuzzy_merges(spark.createDataFrame([(None,), (None,)], "c string")).collect() == []
    assert correct.fuzzy_merges(spark.createDataFrame([("x",), ("x",), ("",)], "c string")).collect() == []
    assert np.all(spelling.likeness(["", "a"], ["", "a"], ["", "a"], ["", "a"]) == 1.0)
