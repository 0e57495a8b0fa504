"""Language of whole texts by a string kernel.

The kernel is a blended spectrum of presence: two texts share the n-grams of 1
to ``LONGEST`` characters that occur in both, over the geometric mean of how
many each has.  N-grams are hashed to ``SLOTS`` places, so a text is a 0/1 row
and kernel values of a batch are one matrix product.  ``LANDMARKS`` sample texts
span the Nyström approximation; in that space each language is a ridge
regression of one against the rest.

Only the sample (at most about ``SAMPLE`` labelled rows, as many of each language,
chosen by a hash of the key) reaches the driver, as bits; all texts are scored
where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoband.llm.common import text_or_empty

LONGEST = 3
SLOTS = 1 << 15
LANDMARKS = 128
SAMPLE = 4000
RIDGE = 1e-3
UNKNOWN = "und"
_BATCH = 64
_SHIFT = np.uint64(64 - 15)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def grams(text: str) -> np.ndarray:
    """Slots of a text's n-grams, repeats included; lower case, white space as one blank, blanks at the ends."""
    plain = " " + " ".join(text.lower().split()) + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    out, value = [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(LONGEST):
        value = value[:len(codes) - n] * _MULTIPLIERS[1] + codes[n:]
        mixed = (value ^ (value >> np.uint64(29))) * _MULTIPLIERS[0] + _MULTIPLIERS[2] * np.uint64(n + 1)
        out.append(((mixed ^ (mixed >> np.uint64(32))) * _MULTIPLIERS[1] >> _SHIFT).astype(np.int32))
        if n + 1 < LONGEST:
            value = value[:max(len(codes) - n - 1, 0)]
    return np.concatenate(out)


def presence(texts: list[str]) -> np.ndarray:
    rows = np.zeros((len(texts), SLOTS), dtype=np.float32)
    for k, text in enumerate(texts):
        rows[k, grams(text)] = 1
    return rows


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of both texts' numbers of n-grams."""
    own, other = x.sum(axis=1), landmarks.sum(axis=1)
    return (x @ landmarks.T) / np.sqrt(np.maximum(own, 1))[:, None] / np.sqrt(np.maximum(other, 1))[None, :]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _BATCH):
            few = batch.slice(lo, _BATCH)
            bits = np.packbits(presence(few.column(2).to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array([b.tobytes() for b in bits], pa.binary())],
                                             names=["lang", "rank", "bits"])


class Classifier:
    """Landmarks, the combined map from kernel values to languages, and the languages."""

    def __init__(self, landmarks, weights: np.ndarray, languages: list[str]):
        self.landmarks, self.weights, self.languages = landmarks, weights, languages

    def predict(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Key, lang_pred, score of every row; ``und`` and 0 where the text is null or has no letters."""
        kind = dict(docs.dtypes)[key]
        rows = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
        return rows.mapInArrow(_predict(self), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", key)


def _predict(model: Classifier):
    bits, weights, languages = model.landmarks, model.weights, np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = np.unpackbits(bits.value, axis=1).astype(np.float32)
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH):
                few = batch.slice(lo, _BATCH)
                texts = few.column(1).to_pylist()
                known = np.array([has_letter(t) for t in texts]) & (len(languages) > 1)
                best, score = np.full(len(texts), len(languages) - 1), np.zeros(len(texts))
                if known.any():
                    margins = kernel(presence([t for t, k in zip(texts, known, strict=True) if k]), landmarks) @ weights
                    best[known] = margins.argmax(axis=1)
                    score[known] = np.clip((margins.max(axis=1) + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(list(languages[best]), pa.string()), pa.array(score)],
                                                 names=["id", "lang_pred", "score"])
    return run


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        landmarks: int = LANDMARKS) -> Classifier:
    """Learn from rows with a language and a text that has letters.

    Each language gives the same number of sample rows, or all it has.  Repeated
    rows count as often as they come.  Without any such row all texts are ``und``.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(key, text).alias("rank"), F.col(text).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not sizes:
        return Classifier(sc.broadcast(np.zeros((0, SLOTS // 8), np.uint8)), np.zeros((0, 0)), [])
    each, span = max(1, sample // len(sizes)), float(1 << 40)
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, each / n) * span))])
    chosen = rows.where(F.pmod("rank", F.lit(1 << 40)) < F.element_at(share, F.col("lang")))
    seen = sorted(chosen.mapInArrow(_sampled, "lang string, rank bigint, bits binary").collect())  # about ``sample`` rows of SLOTS bits
    languages = sorted({r.lang for r in seen})
    packed = np.stack([np.frombuffer(r.bits, dtype=np.uint8) for r in seen])
    of = np.array([languages.index(r.lang) for r in seen])
    per = -(-landmarks // len(languages))
    first = np.concatenate([np.flatnonzero(of == k)[:per] for k in range(len(languages))])
    base = np.unpackbits(packed[first], axis=1).astype(np.float32)
    near = np.concatenate([kernel(np.unpackbits(packed[lo:lo + 256], axis=1).astype(np.float32), base)
                           for lo in range(0, len(packed), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel(base, base).astype(np.float64))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    x = near @ whiten
    y = np.where(of[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    balance = 1 / np.bincount(of, minlength=len(languages))[of]  # every language weighs the same
    gram = (x * balance[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
    weights = whiten @ np.linalg.solve(gram, (x * balance[:, None]).T @ y)
    return Classifier(sc.broadcast(packed[first]), weights.astype(np.float32), languages)
