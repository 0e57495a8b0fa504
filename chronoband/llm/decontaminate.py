"""Benchmark passages in training documents, by winnowing.

Every ``SPAN`` consecutive words are covered by ``SPAN - K + 1`` K-grams, and the
least of their hashes is the span's fingerprint.  Equal spans have equal
fingerprints wherever they stand, so joining the fingerprints of documents and
items misses no shared span of that length.  A joined fingerprint is then
extended to its whole span: the hash over all its words must agree too.  An item
shorter than a span is one fingerprint of its own length.

Everything is array expressions: hashes of 2, 4, 8 ... words and minima over 2, 4
... places are built by joining an array with itself moved on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.llm.common import ascii_lower, materialise, text_or_empty

SPAN, K = 10, 8
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: above so many benchmark windows the joins are left to shuffle
BROADCAST_WINDOWS = 200_000


def words(text: str) -> Column:
    """Words of a text: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text_or_empty(text)), BETWEEN_WORDS, -1), "")


def _joined(left: str, right: str, ahead: int, length: Column, how) -> Column:
    """``how(left[i], right[i + ahead])`` for the first ``length`` places."""
    return F.zip_with(F.slice(left, 1, length), F.slice(right, ahead + 1, length), how)


class _Arrays:
    """Adds columns g<k> (hashes of k words) and m<k>_<w> (minima over w of them) to a table with g1 and n."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _add(self, name: str, make) -> str:
        if name not in self.df.columns:
            self.df = self.df.withColumn(name, make())
        return name

    def places(self, width: int) -> Column:
        return F.greatest(F.col("n") - (width - 1), F.lit(0))

    def grams(self, k: int) -> str:
        if k == 1:
            return "g1"
        head = 1 << (k - 1).bit_length() - 1  # the largest power of two below k
        a, b = self.grams(head), self.grams(k - head)
        return self._add(f"g{k}", lambda: _joined(a, b, head, self.places(k), lambda x, y: F.xxhash64(x, y)))

    def minima(self, k: int, w: int) -> str:
        if w == 1:
            return self.grams(k)
        half = 1 << (w - 1).bit_length() - 1
        a = self.minima(k, half)
        return self._add(f"m{k}_{w}", lambda: _joined(a, a, w - half, self.places(k + w - 1), lambda x, y: F.least(x, y)))


def _hashed(rows: DataFrame) -> _Arrays:
    return _Arrays(rows.withColumn("n", F.size("words")).withColumn("g1", F.transform("words", lambda w: F.xxhash64(w))).drop("words"))


def spans(rows: DataFrame, keep: list[str], span: int = SPAN, k: int = K) -> DataFrame:
    """A row per span: the kept columns, place, mark (fingerprint), whole (hash of all its words)."""
    arrays = _hashed(rows)
    whole, mark = arrays.grams(span), arrays.minima(k, span - k + 1)
    both = arrays.df.select(*keep, F.arrays_zip(F.col(mark).alias("mark"), F.col(whole).alias("whole")).alias("spans"))
    # the outer form: a plain explode is given a filter on the array's size, which would be computed twice over
    return both.select(*keep, F.posexplode_outer("spans").alias("place", "s")).select(*keep, "place", "s.mark", "s.whole")


def _grams(rows: DataFrame, keep: list[str], length: int) -> DataFrame:
    """A row per run of ``length`` words: the kept columns, place, whole."""
    arrays = _hashed(rows)
    name = arrays.grams(length)
    return arrays.df.select(*keep, F.posexplode_outer(name).alias("place", "whole"))


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def hits(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, span: int, k: int) -> DataFrame:
    """Occurrences of item windows: _id, _tag, place, length, items."""
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_tag"), words(text).alias("words"))
    tests = items.select(F.col(item_key).cast("string").alias("item"), words(item_text).alias("words"))
    windows = materialise(spans(tests, ["item"], span, k).where("mark IS NOT NULL").groupBy("mark", "whole").agg(F.collect_set("item").alias("items")))
    small = windows.count() <= BROADCAST_WINDOWS
    marks = windows.select("mark").distinct()
    marked = spans(rows, ["_id", "_tag"], span, k).join(_small(marks, small), "mark")
    found = [marked.join(_small(windows, small), ["mark", "whole"])
             .select("_id", "_tag", "place", F.lit(span).alias("length"), "items")]
    brief = tests.where(F.size("words").between(1, span - 1))
    lengths = sorted(r.n for r in brief.select(F.size("words").alias("n")).distinct().collect())  # fewer than a span
    for length in lengths:
        own = _grams(brief.where(F.size("words") == length), ["item"], length)
        named = materialise(own.where("whole IS NOT NULL").groupBy("whole").agg(F.collect_set("item").alias("items")))
        found.append(_grams(rows, ["_id", "_tag"], length).join(_small(named, named.count() <= BROADCAST_WINDOWS), "whole")
                     .select("_id", "_tag", "place", F.lit(length).alias("length"), "items"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _covered(places: Column) -> Column:
    """Words inside the union of (place, length) intervals sorted by place."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("covered"))

    def step(so_far: Column, one: Column) -> Column:
        end = one["place"] + one["length"]
        return F.struct(F.greatest(so_far["end"], end).alias("end"),
                        (so_far["covered"] + F.greatest(end - F.greatest(so_far["end"], one["place"]), F.lit(0))).alias("covered"))
    return F.aggregate(places, start, step, lambda done: done["covered"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, items (sorted names of the items found), contaminated.

    A window of an item is ``span`` consecutive words, or the whole item if it
    has fewer, but some.  A document word inside any occurrence of a window is
    hit.  Null and empty texts have no words and no hits; an item without words
    is never found; items that share a name count once and an item without a
    name is not named.  Repeated rows are each returned with the same result,
    and rows that share a key are told apart by their text.  Empty tables give
    no rows or no hits.
    """
    found = hits(docs, items, key, text, item_key, item_text, span, k)
    by_doc = found.groupBy("_id", "_tag").agg(
        F.array_sort(F.collect_set(F.struct("place", "length"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    by_doc = by_doc.select(F.col("_id").alias("h_id"), F.col("_tag").alias("h_tag"), _covered(F.col("places")).alias("n_hit"), "items")
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_tag"),
                       F.size(words(text)).cast("bigint").alias("n_words"))
    joined = rows.join(by_doc, F.col("_id").eqNullSafe(F.col("h_id")) & (F.col("_tag") == F.col("h_tag")), "left")
    return joined.select(F.col("_id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                         F.col("n_hit").isNotNull().alias("contaminated"))
