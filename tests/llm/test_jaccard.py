"""Components equal those of all pairs compared outright."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import chronoband.llm.jaccard as jaccard
from chronoband.llm.jaccard import components, linked, near_duplicates, shingle_set


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if i == j or x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted((i, len(shingles(t)), None if i is None else root(i)) for i, t in rows if i is not None)


def edited(rng, text, times):
    w = text.split(" ")
    for _ in range(times):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    fresh = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, base = fresh(60), fresh(120)
    texts = [fresh(rng.randrange(3, 90)) for _ in range(n // 4)]
    texts += [passage + " " + fresh(rng.randrange(0, 40)) for _ in range(n // 4)]  # one passage, some close, some not
    texts += [edited(rng, base, rng.randrange(0, 7)) for _ in range(n // 4)]  # a large group of near copies
    chain = fresh(80)
    for _ in range(n // 8):  # links only to its neighbours
        chain = edited(rng, chain, 2)
        texts.append(chain)
    texts += [texts[k].upper() for k in range(0, n // 4, 9)] + [base] * 12
    texts += ["", None, "  \n", "one", "One", "one two", "É a b c d e", "é a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_planted_groups(spark, monkeypatch, seed):
    if seed == 3:
        monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)  # the last round alone must find every link
    if seed == 2:
        monkeypatch.setattr(jaccard, "PER_HUB", 3)
        monkeypatch.setattr(jaccard, "PICKED", 1)
        monkeypatch.setattr(jaccard, "HOT", 0)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, node int, list string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
    assert got == brute(rows)


def test_last_round_forms_pairs_that_agree_early_only(spark):
    # sets of 60 need 52 in common: the first two of them stand at place 9 at most
    def group(name, node, places):
        return [(f"{name}{at}", node, 60, node, at) for at in places]
    rows = [r for node in (1, 2, 3) for r in group("late", node, range(9, 17))] + group("early", 5, range(8, 17)) + group("early", 6, range(8, 17))
    rows += [("size", 8, 60, 8, 0), ("size", 9, 40, 9, 0)]
    members = spark.createDataFrame(rows, "list string, node bigint, n bigint, label bigint, at int")
    assert [tuple(r) for r in jaccard.crossing_pairs(members, 75).collect()] == [(6, 5)]


def test_repeated_rows_null_keys_and_long_text(spark):
    long = " ".join(f"a{k % 5000}b{k % 777}" for k in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text of words"), (7, "quite another text of words"),
            (None, "a b c d e f"), (3, long), (4, long + " end"), (5, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id)
           for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    n = len(shingles(long))
    assert got == {(1, 2, 1), (1, 1, 1), (7, 1, 1), (None, 2, None), (3, n, 3), (4, n + 1, 3), (5, 0, 5)}


def test_unrelated_texts_of_one_key(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = fresh(200), fresh(40), fresh(60)
    near = b + " end"
    rows = [(3, a), (5, a), (5, b), (6, near), (7, c), (8, c + " end"), (8, ""), (9, None), (9, fresh(30)), (None, b), (None, c), (2, fresh(9)), (2, near)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id)
                 for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.doc_id is not None)
    assert got == brute(rows) and {c for i, _, c in got if i in (3, 5, 6)} == {2}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_linked_is_exact_at_the_threshold():
    x = np.arange(8, dtype=np.uint64)
    assert linked(x, x[:6], 75) and not linked(x, x[:5], 75)
    assert linked(np.arange(7, dtype=np.uint64), np.arange(1, 8, dtype=np.uint64), 75)
    assert not linked(x[:0], x[:0], 75)


def test_shingles_match_words():
    for text in ("", None, "a", "a b c d e", "A b\x0bc\x1cd e  f", "a b c d e a b c d e"):
        assert len(shingle_set(text)) == len(shingles(text))


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    want = jaccard.word_hashes("Ab cd ab\u00e9 cd xyz")
    assert want[1] == want[3] and len(set(want.tolist())) == 4
    long = " ".join(f"w{k}" for k in range(90_000)) + " " + "z" * 300_000 + " tail w5 w6"
    whole = jaccard.word_hashes(long)
    assert len(whole) == 90_004 and whole[5] == whole[-2] and whole[6] == whole[-1]
    assert (whole[:90_000] == np.concatenate([jaccard.word_hashes(f"w{k}") for k in range(90_000)])).all()
    assert len(jaccard.word_hashes("q" * 600_000)) == 1 and len(jaccard.word_hashes(" " * 600_000)) == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(1, 40)] + [(100, 101)], "x bigint, y bigint")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, 101: 100}


def test_sketches_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 5, 60, 300, 900) for _ in range(4)] + [pool[:0]]
    marks = jaccard.sketches(sets).view(np.uint64)
    for a, x in zip(marks, sets, strict=True):
        for b, y in zip(marks, sets, strict=True):
            assert sum(int(v).bit_count() for v in a ^ b) <= len(np.setxor1d(x, y))
    assert not marks[-1].any()


def test_last_round_forms_no_pair_whose_sketches_differ_too_much(spark):
    # sets of 63 link with at most 18 differing shingles
    def mark(node, ones):
        return (node, (1 << ones) - 1, *[0] * (len(jaccard.SKETCH) - 1))
    members = spark.createDataFrame([(f"l{at}", node, 63, node, at) for node in (1, 2, 3) for at in range(8)],
                                    "list string, node bigint, n bigint, label bigint, at int")
    marks = spark.createDataFrame([mark(1, 0), mark(2, 18), mark(3, 37)], ["node", *jaccard.SKETCH])
    assert sorted(tuple(r) for r in jaccard.crossing_pairs(members, 75).collect()) == [(2, 1), (3, 1), (3, 2)]
    assert [tuple(r) for r in jaccard.crossing_pairs(members, 75, marks).collect()] == [(2, 1)]
    assert [tuple(r) for r in jaccard.star_pairs(members, marks, 0, 75).where("least(x, y) <> 1 OR greatest(x, y) <> 2").collect()] == []


def test_counters_travel_in_few_rows(spark):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 900}" for j in range(40))) for k in range(300)] + [(None, "a b c d e f"), (7, "")]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    seen = docs.mapInArrow(jaccard._inspect(5), jaccard._INSPECTED).cache()
    assert seen.where("kind = 1").count() <= 3 * jaccard.COUNTERS // jaccard.BLOCK
    sets = [shingle_set(t) for _, t in rows]
    want = np.bincount((np.concatenate(sets) % np.uint64(jaccard.COUNTERS)).astype(np.int64), minlength=jaccard.COUNTERS)
    assert (jaccard._counters(seen) == want).all()
    seen.unpersist()
