"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage to the folder
the cluster shares and hands the files to the next.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoband.llm.common import documents, materialise, stored, table, text_or_empty
from chronoband.llm.decontaminate import contamination
from chronoband.llm.jaccard import text_groups, text_keys
from chronoband.llm.lines import keep_bitmaps, without_lines
from chronoband.llm.packing import packed_pieces
from chronoband.llm.toxicity import fit as fit_toxicity
from chronoband.session import prepared

TOXIC = 0.3
LINE_DOCUMENTS = 10
END_ID, WINDOW = 2, 4096


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``row_key``: the id and a hash of the text, which tells rows apart that share an id or have none."""
    return docs.withColumn("row_key", F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_or_empty("text")).alias("tag")))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``row_key`` is not rejected; null ids are compared as values.  The rejected are the fewer, so they travel."""
    keys = rejected.select(F.col("row_key.id").alias("rejected_id"), F.col("row_key.tag").alias("rejected_tag")).distinct()
    same = docs["doc_id"].eqNullSafe(keys["rejected_id"]) & (F.xxhash64(text_or_empty("text")) == keys["rejected_tag"])
    return docs.join(keys, same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; all labels teach.

    A null or empty text has a score like any other; repeated rows stay or go
    together, rows that share an id are told apart by their text, a null id is
    an id.  Extra columns are passed on.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scores = fit_toxicity(docs, labels).score(_keyed(docs), key="row_key")
    return _without(docs, scores.where(F.col("score") >= TOXIC))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents keep their first occurrence only; documents stay, with ``n_chars`` brought up to date.

    A document that loses every line stays with an empty text.
    """
    bitmaps = keep_bitmaps(docs, min_docs=LINE_DOCUMENTS, keep_first=True)
    out = without_lines(docs, bitmaps)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes])


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, the one with the smallest id; rows without an id or words are in no group and stay.

    Texts that share an id are linked by their words only; of rows with the same id and text one stays.
    """
    # the row travels as one value, so that none of its columns can meet a name used here
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed, shared = text_keys(whole)
    groups = text_groups(keyed, "text_key", "text").where("component_id IS NOT NULL AND n_shingles > 0")
    groups = groups.groupBy("text_key", "component_id").agg(F.count(F.lit(1)).alias("rows"))
    groups = groups.withColumn("id", F.col("text_key")) if shared is None else groups.join(shared, "text_key", "left").withColumn(
        "id", F.coalesce("key_of", "text_key")).drop("key_of")
    groups = materialise(groups)
    first = groups.groupBy("component_id").agg(F.min(F.struct("id", "text_key"))["text_key"].alias("first"))
    others = groups.join(first, "component_id").where("text_key <> first").select("text_key")
    left = keyed.join(others, "text_key", "left_anti").select("text_key", "row")
    repeated = groups.where("rows > 1").select("text_key")
    single = left.join(repeated, "text_key", "left_anti").select("row.*")
    one = left.join(repeated, "text_key", "left_semi").groupBy("text_key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return single.unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item.

    A null or empty text has none and stays; rows that share an id are told
    apart by their text.  Extra columns are passed on.
    """
    found = contamination(_keyed(docs), table(spark, sf_dir, "benchmark"), key="row_key")
    return _without(docs, found.where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of token ids, with the ids.

    A null or empty text is its end mark alone; repeated rows are packed each.
    """
    return packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, WINDOW)


def _prepared(stage):
    """The stage in a session with the settings it relies on, bounded Arrow batches among them."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepared(spark), docs, sf_dir)
    return run_stage


STAGES = [(name, _prepared(stage)) for name, stage in (
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicate_documents),
    ("decontamination", decontamination),
    ("packing", packing),
)]

#: a learnt classifier and a tokenizer stand in the way of SQL; the tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
