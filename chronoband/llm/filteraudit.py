"""Which of several document filters does the work, over every order they may run in.

Each document is reduced to the set of filters it fails, a bit mask.  Everything
the audit asks for is a sum over the 32 masks, so a part of the corpus is 32
counts, whatever its size.  The step that removes a mask under an order is a
min-plus product: masks as a matrix with nought for a failed filter and
infinity elsewhere, orders as the matrix of their inverse permutations (the
place of each filter), combined by sum and minimum.  The counts are scattered
to (order, step) by that rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.llm.common import materialise, text_or_empty

BLANK = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
RESULT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
          "good_lost bigint, toxic_lost bigint, shapley bigint")


def text_failures(text: Column, words: Column) -> list[Column]:
    """Filters A to D, true where the document fails: too short, repetitive, shouted, marked up."""
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return [n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, capitals * 100 > F.char_length(text) * 10, text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per row of ``docs``: part, mask (bit k: fails filter k of ``FILTERS``), good, toxic.

    Filter E fails a row if a smaller key has the same text anywhere in the
    table; a null key is smaller than none and has none below it, rows that
    share key and text do not fail each other.  A null text is empty, a null
    part the empty string.  Several labels of one key count as any of them.
    """
    body = F.btrim(F.col("_text"), F.lit(BLANK))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\t-\\r]+", -1))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).alias("_text"))
    rows = rows.withColumn("_words", words)
    bits = sum((fails.cast("int") * (1 << k) for k, fails in enumerate(text_failures(F.col("_text"), F.col("_words")))), F.lit(0))
    facts = materialise(rows.select("_id", "part", bits.alias("mask"), F.unhex(F.sha2("_text", 256)).alias("_sha")))
    repeated = facts.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows")
    marks = labels.groupBy(F.col(key).alias("_key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)).cast("int") * (1 << 4)
    whole = facts.join(repeated, "_sha", "left").join(marks, F.col("_id") == F.col("_key"), "left")
    return whole.select("part", (F.col("mask") + copy).alias("mask"), *[F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")])


def removal_steps(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders, masks x filters failed, masks x orders first failing step); the empty mask is never removed."""
    orders = np.array(list(permutations(range(n))))
    place = np.argsort(orders, axis=1) + 1
    failed = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    cost = np.where(failed, 0, 2 * n)
    return orders, failed, (cost[:, None, :] + place[None, :, :]).min(axis=2)


def _interactions(names: str):
    """A row per part (part, cells: mask, rows, good, toxic) becomes a row per order and step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        orders, failed, steps = removal_steps(n)
        labels = np.repeat(["".join(names[k] for k in order) for order in orders], n)
        cell = (np.arange(len(orders)) * n + steps - 1)[1:]
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.zeros((3, 1 << n), dtype=np.int64)
                for c in cells:
                    counts[:, c["mask"]] = c["rows"], c["good"], c["toxic"]
                lost = np.zeros((3, orders.size), dtype=np.int64)
                for of, into in zip(counts, lost, strict=True):
                    np.add.at(into, cell.ravel(), np.repeat(of[1:], len(orders)))
                removed, own = lost[0].reshape(orders.shape), counts[0] @ failed
                shapley = np.array([removed[orders == k].sum() for k in range(n)])
                unique = counts[0][1 << np.arange(n)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * orders.size, pa.string()), "filter_order": pa.array(labels.tolist(), pa.string()),
                    "step": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))),
                    "kept": pa.array((counts[0].sum() - np.cumsum(removed, axis=1)).ravel()), "removed": pa.array(removed.ravel()),
                    "redundant": pa.array((own[orders] - removed).ravel()), "unique_fails": pa.array(unique[orders].ravel()),
                    "good_lost": pa.array(lost[1]), "toxic_lost": pa.array(lost[2]), "shapley": pa.array(shapley[orders].ravel())})
    return run


def interactions(marked: DataFrame, names: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant and lost; ``shapley`` sums a filter's removals over all orders.

    ``marked`` has a row per document (part, mask, good, toxic).  An empty table
    gives an empty result.  A part is at most ``2 ** len(names)`` counts before
    it reaches Python.
    """
    counted = marked.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("good").cast("bigint").alias("good"), F.sum("toxic").cast("bigint").alias("toxic"))
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_interactions(names), RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five text filters on every row of ``docs``; see ``masks`` and ``interactions`` for odd rows."""
    return interactions(masks(docs, labels, key, text, part))
