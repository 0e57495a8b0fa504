"""The stages on a small corpus against plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute

BAD = ["idiot", "moron"]
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COMMON = "This line stands in many documents."


def sentence(rng, n=9):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng, folder = random.Random(6), str(tmp_path_factory.mktemp("sf"))
    items = [" ".join(sentence(rng, 14).split()) for _ in range(3)]
    rows, labels = [], []
    for i in range(240):
        lines = [sentence(rng) for _ in range(rng.randrange(2, 6))]
        if i % 8 == 0:
            lines.insert(1, " " + COMMON.upper() if i % 16 else COMMON)
        if i % 10 == 3:
            lines[0] += f" {rng.choice(BAD)}"
            labels.append((i, 1))
        elif i % 3 == 0:
            labels.append((i, 0))
        if i % 40 == 5:
            lines[-1] += " " + items[i % 3]
        rows.append((i, "\n".join(lines), "en", "s", 1))
    rows += [(300 + k, rows[k][1] + " and a bit", "en", "s", 1) for k in range(20, 30)]  # near copies
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (None, sentence(rng), "en", "s", 1), (20, rows[20][1], "en", "s", 1)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, made):
    folder, items = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "test-" + name)
        kept[name] = (before, rows(docs))
        if name != "packing":
            assert docs.columns == columns

    before, after = kept["toxicity"]
    assert after == [r for r in before if not any(b in (r[1] or "") for b in BAD)]

    before, after = kept["line_dedup"]
    have = sorted((r for r in before if COMMON.lower() in (r[1] or "").lower()), key=lambda r: r[0])
    want = []
    for r in before:
        if r in have[1:]:
            text = "\n".join(x for x in r[1].split("\n") if x.strip().lower() != COMMON.lower())
            r = (r[0], text, *r[2:4], len(text))
        want.append(r)
    assert len(have) > 10 and after == sorted(want, key=str)

    before, after = kept["near_duplicates"]
    groups = {i: c for i, _, c in brute([r[:2] for r in before])}
    want = {r for r in before if r[0] is None or groups[r[0]] == r[0]}
    assert after == sorted(want, key=str) and len(after) < len(before) - 8

    before, after = kept["decontamination"]
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    grams = {tuple(w[k:k + 10]) for w in map(words, items) for k in range(len(w) - 9)}
    assert after == [r for r in before if not any(tuple(words(r[1])[k:k + 10]) in grams for k in range(len(words(r[1]))))]
    assert len(after) < len(before)

    before, after = kept["packing"]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {}
    for r in docs.collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {r[0] for r in before}
    for r in before:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        assert b"".join(p.ids for p in sorted(found[r[0]], key=lambda p: p.start)) == ids
        assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in found[r[0]])


def test_run_is_the_stages_in_a_row(spark, made):
    got = corpus_pipeline.run(spark, made[0])
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"] and got.count() > 100


def test_rejected_rows_take_no_others_along(spark, made):
    folder, items = made
    docs, rng = spark.read.parquet(f"{folder}/documents.parquet"), random.Random(7)
    clean, other = sentence(rng), sentence(rng)
    toxic, leaked = f"{sentence(rng)} {BAD[0]} {BAD[1]}", f"{sentence(rng)} {items[0]}"
    more = [(None, clean), (None, toxic), (None, leaked), (None, None), (500, clean), (500, toxic), (500, leaked), (500, other), (501, toxic)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], KIND))
    for stage, bad in ((corpus_pipeline.toxicity, toxic), (corpus_pipeline.decontamination, leaked)):
        left = [r for r in rows(stage(spark, docs, folder)) if r[0] is None or r[0] >= 500]
        want = [(i, t, "en", "s", 1) for i, t in more if t != bad]
        assert [r for r in left if r[:2] in more] == sorted(want, key=str)


def test_unrelated_texts_of_one_id_stay(spark, made):
    rng = random.Random(8)
    a, b, c = sentence(rng, 60), sentence(rng, 40), sentence(rng, 50)
    more = [(3, a), (5, a), (5, b), (6, b + " end"), (5, c), (5, c), (7, ""), (7, c + " end"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], KIND)
    left = [r[:2] for r in rows(corpus_pipeline.near_duplicate_documents(spark, docs, made[0]))]
    assert left == sorted([(3, a), (5, b), (5, c), (7, ""), (None, a)], key=str)


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", KIND), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns(spark, made):
    """Extra columns keep their values, whatever they are called."""
    folder, _ = made
    names = ["text_key", "key_of", "row_key", "list", "node", "id", "row", "tag", "score", "n_dropped", "rejected_id", "component_id"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept, name
        for r in kept:
            for k, c in enumerate(names):
                assert r[c] == (None if r.doc_id is None else f"{k}:{r.doc_id}"), (name, c)
