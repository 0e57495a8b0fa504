"""Line bitmaps against plain counting, runs across partitions, odd rows."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from chronoband.llm.lines import keep_bitmaps, without_lines

KIND = "doc_id bigint, text string, row string, keep int"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, min_docs, keep_first):
    """(doc, n_lines, kept text) by a dictionary of keys."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found, first = defaultdict(set), {}
    for d in docs:
        for k, line in enumerate((d[1] or "").split("\n")):
            if key(line):
                found[key(line)].add(d)
                first.setdefault(key(line), (d, k))
    out = []
    for d in rows:
        lines = (d[1] or "").split("\n")
        kept = [x for k, x in enumerate(lines) if len(found[key(x)]) < min_docs or keep_first and first[key(x)] == (d, k)]
        out.append((d[0], len(lines), len(lines) - len(kept), d[1] if d[1] is None else "\n".join(kept)))
    return sorted(out, key=str)


def got(spark, rows, min_docs, keep_first):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], KIND).repartition(4)
    out = without_lines(docs, keep_bitmaps(docs, min_docs=min_docs, keep_first=keep_first))
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    lines = [f"Line {k} Says é" for k in range(30)]
    rows = [(i, "\n".join([rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(lines[:rng.randrange(1, 30)]))
                           for _ in range(rng.randrange(1, 9))])) for i in range(150)]
    return rows + [(500, None), (501, ""), (502, "\n\n"), (503, " \t\x0b"), (504, "own line\x1c"), (505, "own line")]


@pytest.mark.parametrize("min_docs", [2, 10])
@pytest.mark.parametrize("keep_first", [True, False])
def test_against_counting(spark, min_docs, keep_first):
    rows = corpus(min_docs)
    assert got(spark, rows, min_docs, keep_first) == plain(rows, min_docs, keep_first)


def test_one_line_in_every_document(spark):
    rows = [(i, f"everywhere\nonly {i}\nEVERYWHERE ") for i in range(400)]
    assert got(spark, rows, 10, False) == sorted([(i, 3, 2, f"only {i}") for i in range(400)], key=str)
    out = got(spark, rows, 10, True)
    assert (0, 3, 1, "everywhere\nonly 0") in out and sum(r[2] for r in out) == 799


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "a\nc"), (None, "a"), (None, "a"), (2, "b\nz")]
    assert got(spark, rows, 3, False) == sorted([(1, 2, 1, "b"), (1, 2, 1, "b"), (1, 2, 1, "c"), (None, 1, 1, ""), (None, 1, 1, ""),
                                                 (2, 2, 0, "b\nz")], key=str)


def test_long_text_and_bitmap(spark):
    text = "\n".join(["same"] * 50_000 + ["end"])
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string")
    rows = keep_bitmaps(docs, min_docs=3, keep_first=True).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in rows) == [(0, 50_001, 49_999), (1, 50_001, 50_001), (2, 50_001, 50_001)]
    bits = np.unpackbits(np.frombuffer(zlib.decompress([r for r in rows if r.doc_id == 0][0].keep_bitmap), np.uint8), count=50_001)
    assert bits.sum() == 2 and bits[0] and bits[-1]
    assert max(len(r.keep_bitmap) for r in rows) < 100


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert without_lines(none, keep_bitmaps(none)).count() == 0
