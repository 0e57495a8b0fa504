"""Disguised words are read, labels are learnt, held-out rows are told apart."""

from __future__ import annotations

import random

import numpy as np
import pytest

from chronoband.llm import toxicity
from chronoband.llm.toxicity import Reader, character_model, disguised, features, fit

BAD = ["idiot", "moron", "worthless", "stupid", "loser", "clown"]
SYLLABLES = ["the", "re", "on", "an", "er", "st", "ing", "ha", "ou", "ti", "es", "le"]


def text(rng, extra=()):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60))]
    for w in extra:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    return [(i, text(rng, rng.choices(BAD, k=2) if i % 5 == 0 else ()), int(i % 5 == 0)) for i in range(600)]


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in corpus], "doc_id bigint, text string, score string, label double")
    labels = spark.createDataFrame([(i, y, "y") for i, _, y in corpus if i < 450], "doc_id bigint, toxic int, text string")
    return docs, labels


@pytest.fixture(scope="module")
def classifier(tables):
    return fit(*tables)


def scores(spark, classifier, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.score for r in sorted(classifier.score(rows).collect())]


def test_held_out_rows(tables, corpus, classifier):
    got = {r.doc_id: r.score for r in classifier.score(tables[0]).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in corpus)


@pytest.mark.parametrize("shown", ["id1ot", "1d10t", "!d!ot", "i d i o t", "i.d.i.o.t", "iiidiooot", "stuuuupid", "m0r0n", "l o s e r",
                                   "$tup1d", "IDIOT!", "c-l-o-w-n"])
def test_disguises(spark, classifier, shown):
    rng = random.Random(8)
    assert scores(spark, classifier, [text(rng, [shown])])[0] >= 0.3


ENDS = ["{}.", "{},", "{}?", '"{}"', "'{}'", "“{}”", '"{}."', "({});", "{}!", "{}..."]


def test_disguises_next_to_punctuation(classifier):
    read = Reader(classifier.characters.value)
    for shown in ("id1ot", "1d10t", "i d i o t", "i.d.i.o.t", "i-d-i-o-t", "i_d_i_o_t", "iiidiooot", "!diot"):
        missed = [end for end in ENDS if "idiot" not in read("the er " + end.format(shown) + " on the")]
        assert not missed, (shown, missed)
    assert all("moron" in read("the " + end.format("m o r o n")) for end in ENDS)


@pytest.mark.parametrize("sign", [" ", ".", "-"])
def test_long_runs_are_read_across_every_place(classifier, sign):
    read = Reader(classifier.characters.value)
    missed = [k for k in range(50, 64) if "idiot" not in "".join(read.decode(sign.join("th" * (k // 2) + "e" * (k % 2) + "idiot" + "the" * 9)))]
    assert not missed
    assert len("".join(read.decode("i.d.i.o.t." * 5000))) > 20_000


def test_clean_texts_stay_clean(spark, classifier):
    rng = random.Random(9)
    clean = [text(rng, extra) for extra in (["THE!!"], ["3d"], ["a", "a", "a", "a"], ["+1"], ["$$$"], ["2024"], ["on***"])]
    odd = [None, "", " \n", "a " * 3000, "x" * 50_000, "1" * 5000, "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace")]
    assert max(scores(spark, classifier, clean + odd)) < 0.3


def test_model_counts_every_text(spark, tables):
    once = character_model(tables[0])
    twice = character_model(tables[0].union(tables[0]))
    assert once.sum() > 0 and np.array_equal(2 * once, twice)


def test_plain_tokens_have_one_reading(classifier):
    read = Reader(classifier.characters.value)
    assert read("The oner, hessing.") == {"the", "oner", "hessing"}
    assert not any(map(disguised, ["the", "hello", "on***", "!!", "2024", "ll"]))
    assert features("loser") == ["=loser", "^lose", "^loser", "$oser", "$loser"]


def test_nothing_to_learn_from(spark, tables):
    docs, labels = tables
    none = fit(docs.limit(0), labels.limit(0))
    assert none.score(docs.limit(0)).count() == 0
    assert scores(spark, none, ["idiot", None])[0] < 0.3
    nulls = spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int")
    assert max(scores(spark, fit(docs, nulls), ["idiot"])) < 0.3


def test_plain_tokens_and_weights():
    """The short ways give what the long ones give."""
    rng = random.Random(8)
    letters = "abcdeé1!$.,'-(@ß"
    table = {f: 1 + k for k, f in enumerate(["=abc", "^abcd", "$dcba", "^abcde", "$aaaaaa", "=é"])}
    weight = toxicity.Weights(table)
    read = toxicity.Reader(np.ones(2 * toxicity.SLOTS))
    for _ in range(4000):
        token = "".join(rng.choices(letters, k=rng.randrange(1, 9)))
        word = toxicity.plain(token)
        core = token.strip(toxicity.EDGES)
        if word is not None:
            assert word == core and not toxicity.disguised(token) and read._words(token) == (core,)
        else:
            assert toxicity.disguised(token) or not core.isalpha() or token[0] in toxicity.EDGES
        assert weight(core) == max((table.get(f, 0.0) for f in toxicity.features(core)), default=0.0)
