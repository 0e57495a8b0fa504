"""Exact duplicates and benchmark windows on odd rows, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from chronoband.llm import decontaminate
from chronoband.llm.decontaminate import contamination
from chronoband.llm.exact import exact_duplicates


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("counters", [2, 64])
def test_exact(spark, counters):
    rng = random.Random(counters)
    rows = [(i, rng.choice(["Hot", "hOT", "hot"]) if i % 3 else f"Text {i % 40}") for i in range(300)]
    rows += [(900, None), (901, ""), (902, "É"), (903, "é"), (None, "hot"), (None, "lonely"), (None, "lonely"), (299, "Text 19"), (298, "hot")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, keep_id string, kept int").repartition(5)
    out = exact_duplicates(docs, counters=counters).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    assert len(out) == len(rows)
    for t, ids in groups.items():
        own = [r for r in out if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        last = max((i for i in ids if i is not None), default=None)
        assert sorted((r.doc_id for r in own), key=str) == sorted(ids, key=str)
        assert {(r.keep_id, r.group_size) for r in own} == {(last, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [last]


def test_exact_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def words(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower(t))


def plain(rows, items):
    windows = {}
    for name, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(name)
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    names |= {str(x) for x in found if x is not None}
        out.append((i, len(w), len(hit), tuple(sorted(names)), bool(hit)))
    return sorted(out, key=str)


def got(spark, rows, items):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, place int, items string")
    tests = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id bigint, text string, mark string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in contamination(docs, tests).collect()), key=str)


@pytest.mark.parametrize("small", [True, False])
def test_windows(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "x9"]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(fresh(n))) for k, n in enumerate([10, 11, 14, 25, 40, 9, 3, 8])]
    items += [(20, items[2][1]), (21, None), (22, "!!"), (None, items[3][1]), (23, items[4][1].upper().replace(" ", ", "))]
    rows = []
    for i in range(80):
        w = fresh(rng.randrange(0, 30))
        if i % 3 == 0:
            source = words(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(source) - 8))
            w += source[a:a + rng.randrange(8, 30)]
        rows.append((i, rng.choice([" ", "-", ".\n"]).join(w + fresh(rng.randrange(0, 5)))))
    rows += [(200, None), (201, ""), (202, " ,."), (None, items[4][1]), (7, items[0][1]), (7, items[0][1]), (300, " ".join(fresh(20_000)) + " " + items[1][1])]
    assert got(spark, rows, items) == plain(rows, items)


def test_windows_of_empty_tables(spark):
    assert got(spark, [], [(1, "a b c")]) == []
    assert got(spark, [(1, "a b c")], []) == [(1, 3, 0, (), False)]
