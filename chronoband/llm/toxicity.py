"""Toxicity of texts whose words may be disguised: decode first, then score.

The decoder is a noisy channel.  A token that looks disguised (letters mixed
with look-alike signs, letters parted by signs or blanks, a letter three times
running) becomes a lattice: every sign may stand for itself or a letter it
resembles, partings and repetitions may be dropped.  Viterbi search finds the
reading that a character model likes best, after the channel's costs.  Any other
token has one reading, itself.

The character model counts trigrams over all documents into two arrays of fixed
size.  The classifier learns from at most ``LABELLED`` labelled rows, spread
evenly by a hash of their id: log-odds of words, beginnings and ends, the
``FEATURES`` with most evidence kept; a logistic curve turns a text's two
strongest words into a score.  For that curve each row's own words are first
taken out of the counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoband.llm.common import materialise, text_or_empty

LABELLED = 40_000
FEATURES = 20_000
LEAST_POSITIVE = 3
SLOTS = 1 << 18
KNOWN_TOKENS = 200_000
#: characters after which the search puts its readings aside
STRETCH = 120

#: fixed values: signs and the letters they resemble, and signs that part letters
ALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
         "|": "il", "+": "t", "(": "c", "€": "e"}
PARTING = " .-_*~'/"
#: channel costs in nats: a look-alike for a letter, a parting dropped or kept, a repeated letter dropped
AS_LETTER, PARTED, PARTING_KEPT, REPEATED = 1.0, 0.3, 2.5, 0.7
EDGES = ".,;:?!\"'()[]{}<>#%&*|$-_=+~/\\“”„‘’«»…–—"
#: edges that resemble no letter
SOFT = "".join(c for c in EDGES if c not in ALIKE)
_RUN = re.compile(r"([^\W\d_])\1\1")
_PARTED = re.compile(r"\w(?:[.\-_*~'/]\w){2,}$")
_SPACED = re.compile(rf"(?<!\S)[{re.escape(EDGES)}]*(?:\S ){{3,}}\S[{re.escape(EDGES)}]*(?!\S)")
_AGAIN = re.compile(r"(\S)(?: \1)+(?!\S)")


def _slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter slots of every pair and every triple of neighbouring characters."""
    x = codes.astype(np.uint64) + np.uint64(1)
    pair = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = (pair[:-1] ^ (pair[:-1] >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD) + x[2:] * np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - 18)
    return (pair >> shift).astype(np.int64), (triple >> shift).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def spaced_out(text: str) -> str:
    """Lower case, two blanks before every word, so that a word starts in one context."""
    return "  " + "  ".join(text.lower().split()) + " "


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(2 * SLOTS, dtype=np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            texts = batch.column(0).slice(lo, 128).to_pylist()
            pair, triple = _slots(_codes("".join(map(spaced_out, texts))))
            counts[:SLOTS] += np.bincount(pair, minlength=SLOTS)
            counts[SLOTS:] += np.bincount(triple, minlength=SLOTS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64())})


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character pairs and triples over all texts, in ``2 * SLOTS`` hashed slots."""
    rows = docs.select(text_or_empty(text).alias("text")).mapInArrow(_count_characters, "slot int, n bigint")
    model = np.zeros(2 * SLOTS, dtype=np.float64)
    for r in rows.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most 2 * SLOTS rows
        model[r.slot] = r.n
    return model


class Decoder:
    """``decoder(token)``: the words a disguised token stands for."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.memory: dict[str, float] = {}

    def _logp(self, context: str, c: str) -> float:
        key = context + c
        if key not in self.memory:
            if len(self.memory) > KNOWN_TOKENS:
                self.memory.clear()
            pair, triple = _slots(_codes(key))
            self.memory[key] = math.log((self.model[SLOTS + triple[0]] + 0.1) / (self.model[pair[0]] + 10.0))
        return self.memory[key]

    def _best(self, token: str) -> str:
        paths = {"  ": (0.0, "", None)}  # last two characters: score, reading since the last stretch, what was read before
        for k, c in enumerate(token):
            if k and k % STRETCH == 0:  # long readings are chained, not copied letter by letter
                paths = {context: (score, "", (reading, before)) for context, (score, reading, before) in paths.items()}
            options = [(c, PARTING_KEPT if c in PARTING else 0.0)]
            if c in ALIKE:
                options += [(letter, AS_LETTER) for letter in ALIKE[c]]
            if c in PARTING:
                options.append(("", PARTED))
            elif k and token[k - 1] == c:
                options.append(("", REPEATED))
            following: dict[str, tuple] = {}
            for context, (score, reading, before) in paths.items():
                for out, cost in options:
                    if out:
                        new, gain = context[1] + out, self._logp(context, out)
                        if out == " ":
                            new = "  "
                    else:
                        new, gain = context, 0.0
                    total = score + gain - cost
                    if new not in following or total > following[new][0]:
                        following[new] = (total, reading + out, before)
            paths = following
        _, _, reading, before = max((score + self._logp(context, " "), context, reading, before)
                                    for context, (score, reading, before) in paths.items())
        parts = [reading]
        while before:
            reading, before = before
            parts.append(reading)
        return "".join(reversed(parts))

    def __call__(self, token: str) -> list[str]:
        return self._best(token).split()


def disguised(token: str) -> bool:
    core = token.strip(EDGES)
    if _RUN.search(token) or _PARTED.match(core):
        return True
    return any(c in ALIKE for c in token) and any(c.isalpha() for c in core) and not core.isalpha()


def plain(token: str) -> str | None:
    """The word of a token that is letters with marks behind them at most, which nothing can disguise."""
    core = token.strip(EDGES)
    return core if core.isalpha() and token[0] not in EDGES and not _RUN.search(core) else None


class Reader:
    """Words of a text after decoding; remembers the reading of tokens."""

    def __init__(self, model: np.ndarray):
        self.decode = Decoder(model)
        self.known: dict[str, tuple[str, ...]] = {}

    def _words(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            word = plain(token)
            if word is not None:
                return (word,)
            if len(self.known) > KNOWN_TOKENS:
                self.known.clear()
            core, inner = token.strip(EDGES), token.strip(SOFT)
            found = (core,)
            if disguised(token):
                found += tuple(w.strip(EDGES) for w in self.decode(inner))
                if core not in ("", inner):
                    found += tuple(w.strip(EDGES) for w in self.decode(core))
            elif core.isalpha() and token[:1] in EDGES:
                sign = token[token.index(core) - 1]
                if sign in ALIKE:
                    found += tuple(self.decode(sign + core))
            found = self.known[token] = tuple(dict.fromkeys(w for w in found if w))
        return found

    def spaced(self, text: str, tokens: set[str]) -> list[str]:
        """Words written with blanks between their letters."""
        single = list(map(len, tokens)).count(1)
        if not single or single < 3 and single + sum(len(t.strip(EDGES)) == 1 for t in tokens if not t.isalpha() and len(t) > 1) < 3:
            return []
        spans = set()
        for m in _SPACED.finditer(" ".join(text.split())):
            spans |= {_AGAIN.sub(r"\1", m[0].strip(edges + " ")) for edges in (SOFT, EDGES)}
        found = (w.strip(EDGES) for s in spans if s.count(" ") > 1 for w in self.decode(s))
        return [w for w in found if w]

    def __call__(self, text: str) -> set[str]:
        text = text.lower()
        tokens = set(text.split())
        words = {w for t in tokens for w in self._words(t)}
        words.update(self.spaced(text, tokens))
        return words


def features(word: str) -> list[str]:
    """The word, and for longer ones its beginnings and ends."""
    out = ["=" + word]
    out += ["^" + word[:k] for k in (4, 5, 6) if len(word) >= k]
    out += ["$" + word[-k:] for k in (4, 5, 6) if len(word) >= k]
    return out


def _count_features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counts = Reader(model.value), (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "pos": pa.array([counts[1][f] for f in names], pa.int64()),
                                               "neg": pa.array([counts[0][f] for f in names], pa.int64())})
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label].update({f for w in read(text) for f in features(w)})
                if len(counts[0]) + len(counts[1]) > KNOWN_TOKENS:
                    yield out()
                    counts = (Counter(), Counter())
        yield out()
    return run


def _log_odds(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    return math.log((pos + 0.1) / (n_pos + 0.2)) - math.log((neg + 0.5) / (n_neg + 1.0))


def _pooled(weights: list[float]) -> tuple[float, float]:
    """The strongest and second strongest of a text's words; below nought counts as nought."""
    top = sorted((w for w in weights if w > 0), reverse=True)[:2] + [0.0, 0.0]
    return top[0], top[1]


def _own_left_out(model, table, n_pos: int, n_neg: int):
    """Pooled weights of labelled rows, each with its own counts taken out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counts = Reader(model.value), table.value
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                weights = []
                for word in read(text):
                    best = 0.0
                    for f in features(word):
                        if f in counts:
                            pos, neg = counts[f]
                            pos, neg = pos - label, neg - (1 - label)
                            if pos >= LEAST_POSITIVE:
                                best = max(best, _log_odds(pos, neg, n_pos - label, n_neg - (1 - label)))
                    weights.append(best)
                rows.append((*_pooled(weights), label))
            yield pa.RecordBatch.from_pydict({"first": pa.array([r[0] for r in rows], pa.float64()), "second": pa.array([r[1] for r in rows], pa.float64()),
                                              "label": pa.array([r[2] for r in rows], pa.int32())})
    return run


def _basis(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(first), first, second, np.maximum(first - 2, 0), np.maximum(first - 4, 0)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Classifier:
    """What scoring needs: the character counts, the kept features' weights, the curve."""

    def __init__(self, characters, weights, curve: np.ndarray):
        self.characters, self.weights, self.curve = characters, weights, curve

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Key and score (0 to 1, higher: toxic likelier) of every row; null and empty texts get the score of no words."""
        kind = dict(docs.dtypes)[key]
        rows = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
        return rows.mapInArrow(_score(self), f"id {kind}, score double").withColumnRenamed("id", key)


class Weights:
    """Weight of a word: the greatest of its features, nought without any above it."""

    def __init__(self, weights: dict[str, float]):
        kinds: dict[str, dict[str, float]] = {"=": {}, "^": {}, "$": {}}
        for name, w in weights.items():
            kinds[name[0]][name[1:]] = w
        self.whole, self.starts, self.ends = kinds.values()

    def __call__(self, word: str) -> float:
        found = [self.whole.get(word, 0.0)]
        for k in range(4, min(len(word), 6) + 1):
            found += self.starts.get(word[:k], 0.0), self.ends.get(word[-k:], 0.0)
        return max(found)


def _score(classifier: Classifier):
    characters, table, curve = classifier.characters, classifier.weights, classifier.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, weight = Reader(characters.value), Weights(table.value)

        class Known(dict):
            """Token: its words with a weight above nought, or nothing."""

            def __missing__(self, token: str):
                if len(self) > KNOWN_TOKENS:
                    self.clear()
                word = plain(token)
                if word is None:
                    value = weigh(read._words(token)) or None
                else:
                    w = weight(word)
                    value = {word: w} if w > 0 else None
                self[token] = value
                return value

        def weigh(words) -> dict[str, float]:
            return {w: x for w in words if (x := weight(w)) > 0}

        known = Known()
        for batch in batches:
            first, second = [], []
            for text in batch.column(1).to_pylist():
                text = text.lower()
                tokens = set(text.split())
                found: dict[str, float] = {}
                for value in map(known.__getitem__, tokens):
                    if value:
                        found.update(value)
                found.update(weigh(read.spaced(text, tokens)))
                a, b = _pooled(list(found.values()))
                first.append(a)
                second.append(b)
            x = _basis(np.array(first, dtype=np.float64), np.array(second, dtype=np.float64))
            score = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])
    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        labelled: int = LABELLED, kept: int = FEATURES) -> Classifier:
    """Learn from ``labels`` (key, 0 or 1); rows with a null key or label teach nothing, several labels count as 1 if any is.

    At most about ``labelled`` rows are read, chosen by a hash of their key;
    without labelled rows every score is low, with one label only all follow it.
    """
    sc = docs.sparkSession.sparkContext
    characters = sc.broadcast(character_model(docs, text))
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("label_of")).agg(
        F.max((F.col(label) > 0).cast("int")).alias("label"))
    total = marks.count()
    if total > labelled:
        marks = marks.where(F.pmod(F.xxhash64("label_of"), F.lit(1 << 20)) < int(labelled / total * (1 << 20)))
    sample = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(marks), F.col("id") == F.col("label_of"))
    sample = sample.select("text", "label")
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    counted = sample.mapInArrow(_count_features(characters), "feature string, pos bigint, neg bigint")
    counted = counted.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST_POSITIVE)
    odds = F.log((F.col("pos") + 0.1) / (n_pos + 0.2)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    best = counted.withColumn("odds", odds).where("odds > 1").orderBy(F.desc(F.col("pos") * F.col("odds")), "feature").limit(kept)
    rows = best.collect()  # at most ``kept`` rows
    table = sc.broadcast({r.feature: (r.pos, r.neg) for r in rows})
    pooled = materialise(sample.mapInArrow(_own_left_out(characters, table, n_pos, n_neg), "first double, second double, label int"))
    seen = pooled.groupBy("first", "second", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the labelled rows
    a, b, y, n = (np.array([r[k] for r in seen], dtype=np.float64) for k in range(4))
    x, y = np.repeat(_basis(a, b), n.astype(int), axis=0), np.repeat(y, n.astype(int))
    curve = _logistic(x, y) if len(y) else np.array([-4.0, 0, 0, 0, 0])
    return Classifier(characters, sc.broadcast({r.feature: r.odds for r in rows}), curve)
