"""The registered queries of this package, each next to the DuckDB text it must equal where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoband.llm.blocklstm import main_text
from chronoband.llm.common import documents, table
from chronoband.llm.conversations import repair_summary
from chronoband.llm.decontaminate import BETWEEN_WORDS, SPAN, contamination
from chronoband.llm.exact import exact_duplicates
from chronoband.llm.filteraudit import filter_audit
from chronoband.llm.jaccard import near_duplicates
from chronoband.llm.langid import fit as fit_languages
from chronoband.llm.lines import keep_bitmaps, without_lines
from chronoband.llm.packing import packed_pieces
from chronoband.llm.simhash import NEAR, simhash_groups
from chronoband.llm.tokenfile import read_tokens, write_tokens
from chronoband.llm.toxicity import fit as fit_toxicity
from chronoband.llm.warc import read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(key: str, folds: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


LINE_DOCUMENTS = 10
END_ID = 2
WINDOW = 4096
TOXIC = 0.3


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    bitmaps = keep_bitmaps(docs, min_docs=LINE_DOCUMENTS, keep_first=False)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return without_lines(docs, bitmaps).select(
        "row.doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_dropped").cast("bigint").alias("n_dropped"),
        kept.alias("kept_sha256"))


OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
frequent AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {LINE_DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN frequent f ON k.key = f.key GROUP BY doc_id
"""


@F.pandas_udf(T.LongType())
def _crc32(ids: pd.Series) -> pd.Series:
    return ids.map(zlib.crc32)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return read_tokens(manifest, folder).select("doc_id", "start", "n_tokens", _crc32("ids").alias("ids_crc32"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), END_ID, WINDOW)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit_languages(docs.where(fold("doc_id", 5) != 0))
    return model.predict(docs).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op8_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory, folder = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(directory, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM r
"""

OP7_SQL = f"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN_WORDS}'), lambda x: x <> '') AS w
  FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN_WORDS}'), lambda x: x <> '') AS w
  FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), {SPAN}) AS n FROM bw WHERE len(w) > 0),
bx AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dn AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bn)),
h AS (
  SELECT d.doc_id, d.i, d.n, b.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM dn) d JOIN bx b ON d.win = b.win AND d.n = b.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c ON c.doc_id = dw.doc_id LEFT JOIN t ON t.doc_id = dw.doc_id
"""

def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted; labels of the held-out fold teach nothing."""
    classifier = fit_toxicity(docs, labels.where(fold("doc_id", 4) != 2))
    return classifier.score(docs).withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scores.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir), near=NEAR)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults drawn from a checksum of their keys; a null prints, and counts as a role or a text, as one space."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(shown["conv_id"], F.lit(":"), shown["turn"]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown["role"].alias("role"), shown["text"].alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_summary(damaged(turns), turns)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT part, fails, n, good, toxic, filter_order,
             list_min(list_transform(string_split(fails, ''), lambda q: strpos(filter_order, q))) AS gone
      FROM m, o WHERE fails <> ''),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter
      FROM (SELECT DISTINCT part FROM m), o, (SELECT unnest(range(1, 6))::INT AS step)),
c AS (
  SELECT s.part, s.filter_order, s.step, s.letter, coalesce(sum(n) FILTER (WHERE gone = step), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE gone < step AND contains(fails, letter)), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE gone = step), 0) AS toxic_lost
  FROM s LEFT JOIN r ON r.part = s.part AND r.filter_order = s.filter_order GROUP BY ALL),
t AS (SELECT part, sum(n) AS total FROM m GROUP BY part)
SELECT c.part, filter_order, step,
       (total - sum(removed) OVER (PARTITION BY c.part, filter_order ORDER BY step))::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY c.part, letter))::BIGINT AS shapley
FROM c JOIN t ON t.part = c.part
"""

QUERIES: dict[str, Query] = {
    "op1_main_text": op1_main_text,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_files": op3_token_files,
    "op4_language": op4_language,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op8_web_archive": op8_web_archive,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_simhash": op11_simhash,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_web_archive": OP8_SQL,
    "op13_filter_audit": OP13_SQL,
}
