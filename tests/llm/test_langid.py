"""Kernel values equal set arithmetic, held-out texts get their language."""

from __future__ import annotations

import random

import numpy as np
import pytest

from chronoband.llm.langid import SLOTS, fit, grams, has_letter, kernel, presence

TONGUES = {"xa": ["ka", "lo", "mi", "tu"], "yb": ["ße", "rün", "ach", "ö"], "zc": ["ñu", "ció", "la", "que"]}


def text(rng, lang):
    return " ".join("".join(rng.choices(TONGUES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40)))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang), lang, "clash") for i, lang in enumerate(rng.choices(list(TONGUES), weights=[8, 1, 1], k=400))]
    rows += [(900, None, "xa", ""), (901, "12 !", "xa", ""), (902, "lost text", None, ""), (None, text(rng, "xa"), "xa", "")]
    return fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string"), sample=120, landmarks=24)


def test_kernel_is_set_arithmetic():
    texts = ["The cat", "the  CAT sat", "x", ""]
    sets = [{plain[k:k + n] for plain in [" " + " ".join(t.lower().split()) + " "] for n in (1, 2, 3) for k in range(len(plain) - n + 1)}
            for t in texts]
    got = kernel(presence(texts), presence(texts))
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(got, want, atol=1e-5)
    assert grams("any text").max() < SLOTS


def test_held_out(spark, model):
    rng = random.Random(3)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(sorted(TONGUES) * 40)]
    got = {r.doc_id: r for r in model.predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in rows)


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, " 12\n!"), (None, "kalo"), (5, "kalo " * 40_000), (5, "kalo " * 40_000), (6, "中文")]
    got = [(r.doc_id, r.lang_pred) for r in model.predict(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str)[:5] == [(1, "und"), (2, "und"), (3, "und"), (5, "xa"), (5, "xa")]
    assert (None, "xa") in got and len(got) == 7
    assert has_letter("1é") and not has_letter("1_ ")


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in fit(none).predict(none).collect()] == ["und"]
    assert fit(none.limit(0)).predict(none.limit(0)).count() == 0
