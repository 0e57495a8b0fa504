"""The filter audit against running the filters in every order, and against SQL."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np

from chronoband.llm.filteraudit import filter_audit, removal_steps
from chronoband.llm.queries import OP13_SQL
from tests.compare import difference


def failed(i, t, rows):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    first = min((j for j, s in rows if (s or "") == t and j is not None), default=None)
    return {x for x, bad in zip("ABCDE", (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
        bool(re.search("[#$%&*|]", t)), i is not None and i > first), strict=True) if bad}


def plain(rows, labels):
    parts, fails = {}, []
    for i, t, lang in rows:
        own = failed(i, t, [(j, s) for j, s, _ in rows])
        good, toxic = (any(j == i is not None and y[k] == 1 for j, *y in labels) for k in (0, 1))
        parts.setdefault(lang or "", []).append((own, good, toxic))
        fails.append(own)
    out = []
    for part, docs in parts.items():
        runs, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                shapley[x] += len(gone)
                runs.append(("".join(order), step, x, len(left), len(gone), sum(x in d[0] for d in docs) - len(gone),
                             sum(d[0] == {x} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(part, order, step, *rest, shapley[x]) for order, step, x, *rest in runs]
    return sorted(out)


def corpus():
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghé", k=rng.randrange(3, 8))) for _ in range(600)]
    rows = []
    for i in range(90):
        t = " ".join(rng.sample(words, 130) if i % 2 else rng.choices(words[:40], k=rng.choice([20, 99, 100, 300])))
        t = t.upper() if i % 7 == 0 else t
        t += rng.choice(["", "", " 5%", "|", "Ö"])
        rows.append((i, t, rng.choice(["en", "de", None, ""])))
    rows += [(200 + k, rows[k][1], "fr") for k in range(12)] + [(3, rows[3][1], "en"), (None, rows[5][1], "en"), (None, "x", None), (300, None, "en"),
                                                               (301, "", "en"), (302, " \t\n", None), (303, "Word " * 50_000, "en")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_against_running_the_filters(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, lang string, mask int, good int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit(docs, marks).collect())
    assert got == plain(rows, labels)


def test_against_sql(spark, duck):
    import pandas as pd
    rows, labels = corpus()
    con = duck.cursor()
    kinds = {"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}
    con.register("d", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"}))
    con.register("l", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype(kinds))
    sql = OP13_SQL.replace("FROM documents", "FROM d").replace("FROM labels", "FROM l")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert difference(filter_audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")), con, sql) is None


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert filter_audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_ranks():
    orders, fails, steps = removal_steps(3)
    assert steps.shape == (8, 6) and (steps[0] > 3).all() and (steps[7] == 1).all()
    for m in range(1, 8):
        for p, order in enumerate(orders):
            assert steps[m, p] == 1 + next(s for s, f in enumerate(order) if m >> f & 1)
    assert np.array_equal(fails.sum(axis=1), [bin(m).count("1") for m in range(8)])
