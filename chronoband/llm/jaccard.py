"""Near-duplicate documents: exact Jaccard join on word shingles by T-occurrence search.

A document is a query against the inverted lists of its shingles; a partner must
occur in at least T of them.  As in DivideSkip the T - 1 longest lists of a query
are not merged: every partner must also occur in one of the short lists, so only
those are built and merged, and the long ones are decided by binary search in
the candidate's sorted set.  List lengths come from one counter array of fixed
size, summed over all documents; it only sets the order of a document's lists
and any order gives the same links.

Only components are wanted, so copies are not expanded into pairs.  Equal sets
are one node.  A few star rounds try each member of a list against one hub of
the list and join what holds; whatever is joined needs no further test.  The
last round takes the pairs that are still in two components and share enough
early shingles, and tests them, a few of each component at first and then all
that are still between two, so no link between different components is lost.

Every set has a sketch: the parities of its shingles in 512 slots.  Two sketches
differ in at most as many places as the sets differ in shingles, so a pair whose
sketches differ too much is no link and forms no row.  Large sets fill their
sketch, which then tells little; the early shingles remain for them.

Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoband.llm.common import materialise, release, text_or_empty

SHINGLE = 5
PERCENT = 75
COUNTERS = 1 << 17
#: counters that travel in one value
BLOCK = 1 << 10
#: parities of a set, in columns of 64
SKETCH_BITS = 512
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
FILTER_BITS = 1 << 22
STAR_ROUNDS = 2
#: a list is hot when its counter is so many times the mean
HOT, SALTS = 8, 64
#: above so many keys with several texts the join is left to shuffle
BROADCAST_KEYS = 200_000
#: members tested against one copy of a hub's set
PER_HUB = 256
#: pairs of a component that the last round tests at first
PICKED = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0xC2B2AE3D27D4EB4F
#: texts are hashed in stretches of at most so many bytes, cut between words
STRETCH = 1 << 18
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE, STRETCH + 1), _powers(pow(_BASE, -1, 1 << 64), STRETCH + 1)


def _hash_words(data: bytes) -> np.ndarray:
    """A hash per word: a polynomial over its bytes, taken from running sums over the whole stretch."""
    codes = np.frombuffer(data, dtype=np.uint8)
    inside = ~_BLANK[codes]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if len(codes) > STRETCH:  # one word longer than a stretch, or words on both sides of it
        return np.array([xxhash.xxh3_64_intdigest(data[a:b]) if b - a > STRETCH else _hash_words(data[a:b])[0]
                         for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.uint64)
    running = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _UP[:len(codes)], out=running[1:])
    value = (running[end] - running[start]) * _DOWN[start] + (end - start).astype(np.uint64) * _MIX
    value = (value ^ (value >> np.uint64(32))) * _MIX
    return value ^ (value >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words in order; ASCII white space parts words, A-Z count as a-z."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= STRETCH:
        return _hash_words(data)
    out, at = [], 0
    blank = _BLANK[np.frombuffer(data, dtype=np.uint8)]
    while at < len(data):
        until = min(at + STRETCH, len(data))
        if until < len(data):
            back = np.flatnonzero(blank[at:until])
            ahead = np.flatnonzero(blank[until:])
            until = at + int(back[-1]) + 1 if len(back) else until + int(ahead[0]) if len(ahead) else len(data)
        out.append(_hash_words(data[at:until]))
        at = until
    return np.concatenate(out)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    hashes = word_hashes(text)
    if not len(hashes):
        return np.empty(0, np.uint64)
    size = min(size, len(hashes))
    places = len(hashes) - size + 1
    total = np.full(places, size, dtype=np.uint64)
    for k in range(size):
        total += hashes[k:k + places] * _MULTIPLIERS[k]
    total ^= total >> np.uint64(31)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return np.unique(total)


def short_lists(own: np.ndarray, lengths: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The n - T + 1 shingles with the shortest lists, and those lengths."""
    n = len(own)
    need = -(-percent * n // 100)
    length = lengths[own % np.uint64(len(lengths))]
    first = np.lexsort((own, length))[:n - need + 1]
    return own[first], length[first]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity: the smaller one is probed in the larger by binary search."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y) or not len(x):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    shared = int(np.count_nonzero(y[at] == x))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SKETCH_BITS / 64`` integers per set: the parity of the number of its shingles in each slot."""
    slot = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
    odd = np.bincount(row * SKETCH_BITS + slot, minlength=len(sets) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), SKETCH_BITS), axis=1).view("<i8")


_INSPECTED = "kind int, id bigint, a bigint, b bigint, n bigint, " + ", ".join(f"{c} bigint" for c in SKETCH) + ", counts binary"


def _inspect(size: int):
    """A row per document (kind 0: id, n, two digests of the set, its sketch) and one per block of counters (kind 1: block, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.zeros(COUNTERS, dtype=np.int64)

        for batch in batches:
            a, b, n, marks = [], [], [], []
            for lo in range(0, batch.num_rows, 256):
                sets = [shingle_set(text, size) for text in batch.column(1).slice(lo, 256).to_pylist()]
                lengths += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                marks.append(sketches(sets))
                for own in sets:
                    digest = xxhash.xxh3_128_digest(own.tobytes())
                    a.append(int.from_bytes(digest[:8], "little", signed=True))
                    b.append(int.from_bytes(digest[8:], "little", signed=True))
                    n.append(len(own))
            if a:
                columns = np.concatenate(marks)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.zeros(len(a), np.int32)), "id": batch.column(0).cast(pa.int64()), "a": pa.array(a, pa.int64()),
                    "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()),
                    **{c: pa.array(columns[:, k]) for k, c in enumerate(SKETCH)}, "counts": pa.nulls(len(a), pa.binary())})
        blocks = lengths.astype("<i8").reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        none = {c: pa.nulls(len(used), pa.int64()) for c in ("id", "b", "n", *SKETCH)}
        columns = {"kind": pa.array(np.ones(len(used), np.int32)), "a": pa.array(used, pa.int64()), **none,
                   "counts": pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in used], pa.binary())}
        yield pa.RecordBatch.from_pydict({c: columns[c] for c in ("kind", "id", "a", "b", "n", *SKETCH, "counts")})
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of counters added up; all rows of a block are in one partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(zlib.decompress(raw), dtype="<i8")
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int64()), "counts": pa.array(
        [zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())})


def _counters(inspected: DataFrame) -> np.ndarray:
    """The counter array of fixed size, summed over all documents."""
    lengths = np.zeros(COUNTERS, dtype=np.int64)
    blocks = inspected.where("kind = 1").select(F.col("a").alias("block"), "counts").repartition("block")
    for r in blocks.mapInArrow(_summed, "block bigint, counts binary").collect():  # at most COUNTERS / BLOCK rows
        lengths[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(r.counts), dtype="<i8")
    return lengths


def _post(size: int, percent: int, lengths: np.ndarray, hot: float):
    """The short lists of every document; a hot list is dealt out by a salt that equal sets share, any other has the salt -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                few = batch.slice(lo, 512)
                lists, salts, ids, counts, sizes = [], [], [], [], []
                for key, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    own = shingle_set(text, size)
                    if key is not None and len(own):
                        first, length = short_lists(own, lengths, percent)
                        lists.append(first.view(np.int64))
                        salts.append(np.where(length > hot, np.int32(own.sum() % np.uint64(SALTS)), np.int32(-1)))
                        ids.append(key)
                        sizes.append(len(own))
                        counts.append(len(first))
                if ids:
                    yield pa.RecordBatch.from_pydict({
                        "list": pa.array(np.concatenate(lists)), "id": pa.array(np.repeat(np.array(ids, np.int64), counts)),
                        "at": pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in counts])),
                        "n": pa.array(np.repeat(np.array(sizes, np.int64), counts)), "salt": pa.array(np.concatenate(salts), pa.int32())})
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                few = batch.slice(lo, 256)
                yield pa.RecordBatch.from_pydict({"node": few.column(0), "set": pa.array(
                    [shingle_set(t, size).tobytes() for t in few.column(1).to_pylist()], pa.binary())})
    return run


def sets_of(nodes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Shingle sets (node, set) of the documents that ``nodes`` names, and of few others.

    A filter of fixed size, at most ``FILTER_BITS / 64`` rows and so safe to
    broadcast, keeps the other texts from leaving their scan.
    """
    def bit(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    one = F.expr("shiftleft(1L, cast(bit % 64 AS int))")
    words = nodes.select(bit("node").alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))
    texts = rows.where("id IS NOT NULL").select("id", "text", bit("id").alias("bit"))
    wanted = texts.join(F.broadcast(words), F.floor(F.col("bit") / 64) == F.col("word")).where(F.col("bits").bitwiseAND(one) != 0)
    return wanted.select("id", "text").mapInArrow(_sets(size), "node bigint, set binary")


def _test(percent: int):
    """Rows sorted by (hub, salt, member or null): the hub's set, then the members tested against it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            x, y = [], []
            for hub, salt, member, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, dtype=np.uint64)
                if (hub, salt) != now:
                    now, sets = (hub, salt), []
                if member is None:
                    sets.append(own)  # more than one only where rows share an id
                elif any(linked(own, s, percent) for s in sets):
                    x.append(member)
                    y.append(hub)
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})
    return run


def verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are linked.  A hub's set travels once per ``PER_HUB`` members, no other document's does."""
    sets = sets_of(pairs.select(F.col("x").alias("node")).union(pairs.select("y")), rows, size)
    hubs = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / PER_HUB).cast("int").alias("salts"))
    dealt = pairs.join(hubs, "y").select("x", "y", F.pmod(F.xxhash64("x"), "salts").cast("int").alias("salt"))
    members = dealt.select(F.col("y").alias("hub"), "salt", F.col("x").alias("member"), F.col("x").alias("node"))
    own = (hubs.select(F.col("y").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
           .select("hub", "salt", F.lit(None).cast("bigint").alias("member"), F.col("hub").alias("node")))
    sent = members.unionByName(own).join(sets, "node").select("hub", "salt", "member", "set")
    sent = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("member"))
    return sent.mapInArrow(_test(percent), "x bigint, y bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, by alternating large and small stars until nothing moves."""
    def star(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else None
        if large:
            moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = both.where("v < u")
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    now = materialise(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, True)
        now = materialise(star(large.unionByName(large.select(F.col("v").alias("u"), F.col("u").alias("v"))), False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = seen


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (list, node, n, at) of the lists that hold more than one component, with their labels."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("list")
    return materialise(named.join(mixed, "list", "left_semi"))


def _near(x: str, y: str, percent: int) -> Column:
    """Whether sketches in columns named after x and y let sets of m and n shingles reach the similarity.

    Linked sets differ in at most ``(m + n) (100 - p) / (100 + p)`` shingles.
    """
    return _apart(x, y) * (100 + percent) <= (F.col("m") + F.col("n")) * (100 - percent)


def _apart(x: str, y: str) -> Column:
    return reduce(add, [F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in SKETCH])


def _sketched(pairs: DataFrame, marks: DataFrame, side: str) -> DataFrame:
    """``pairs`` with the sketch of one side, in columns named after it."""
    return pairs.join(marks.select(F.col("node").alias(side), *[F.col(c).alias(side + c) for c in SKETCH]), side)


def _can_link(m: str, i: str, n: str, j: str, percent: int) -> Column:
    """Whether sets of m and n shingles that share the one at places i and j may reach the similarity.

    In the common order at most ``least(i, j)`` shared ones come before it, and
    it and what follows are at most ``least(m - i, n - j)``.
    """
    most = F.least(i, j) + F.least(F.col(m) - F.col(i), F.col(n) - F.col(j))
    return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & (most * (100 + percent) >= (F.col(m) + F.col(n)) * percent)


def star_pairs(members: DataFrame, marks: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member with one hub of its lists: of those whose sketch allows a link, the one whose sketch is closest."""
    rank = F.xxhash64(F.lit(turn), "node")
    hubs = members.groupBy("list").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "label", "at")).alias("hub"))
    met = members.join(hubs, "list").where((F.col("hub.label") != F.col("label")) & _can_link("n", "at", "hub.n", "hub.at", percent))
    pairs = met.select(F.col("node").alias("x"), F.col("n").alias("m"), F.col("hub.node").alias("y"), F.col("hub.n").alias("n")).distinct()
    known = _sketched(_sketched(pairs, marks, "x"), marks, "y").where(_near("x", "y", percent))
    return known.groupBy("x").agg(F.min_by("y", F.struct(_apart("x", "y").alias("apart"), "y")).alias("y"))


def _overlap(percent: int) -> Column:
    """The least number of shingles that linked sets of m and n have in common."""
    return F.ceil((F.col("m") + F.col("n")) * percent / F.lit(100 + percent) - 1e-9)


def _first_few(percent: int) -> Column:
    """How many shared shingles a pair has to show early: a quarter of the short lists it needs."""
    need = _overlap(percent) - F.ceil(F.greatest("m", "n") * percent / F.lit(100) - 1e-9) + 1
    return F.greatest(F.ceil(need / F.lit(4)), F.lit(1))


def crossing_pairs(members: DataFrame, percent: int, marks: DataFrame | None = None) -> DataFrame:
    """Every pair in two components that shares enough of what may be its first shared shingles.

    The k-th shingle linked sets share leaves an overlap less k - 1 from there
    on, so the first few of them stand early in both orders.  Only those are met
    and counted: pairs that agree far down alone, such as texts around one
    passage, form no rows, and those with too few early ones are not tested.
    With sketches (node and ``SKETCH``) only pairs that these allow are met.
    One side of a pair is outside its list's most common component, so lists
    that are nearly one component give few pairs.
    """
    counted = members.groupBy("list", "label").agg(F.count(F.lit(1)).alias("of"))
    main = counted.groupBy("list").agg(F.max_by("label", F.struct("of", "label")).alias("main"))
    marked = members.join(main, "list")
    x = marked.where("label <> main").select("list", F.col("node").alias("x"), F.col("n").alias("m"), F.col("at").alias("i"), F.col("label").alias("lx"))
    y = marked.select("list", F.col("node").alias("y"), "n", F.col("at").alias("j"), F.col("label").alias("ly"), (F.col("label") == F.col("main")).alias("inner"))
    if marks is not None:
        x, y = _sketched(x, marks, "x"), _sketched(y, marks, "y")
    met = x.join(y, "list").where("lx <> ly AND (inner OR x < y)").where(_near("x", "y", percent) if marks is not None else F.lit(True)).where(
        _can_link("m", "i", "n", "j", percent) & (F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) > _overlap(percent) - _first_few(percent)))
    # a pair may come either way round, from one list to the next
    turned = met.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"), _first_few(percent).alias("few"))
    return turned.groupBy("x", "y", "few").agg(F.count(F.lit(1)).alias("shared")).where("shared >= few").select("x", "y")


def _between(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs that are in two components, with the one of x."""
    if labels is None:
        return pairs.withColumn("lx", F.col("x"))
    named = pairs.select("x", "y")
    for side in ("x", "y"):
        own = labels.select(F.col("node").alias(side), F.col("label").alias("l" + side))
        named = named.join(own, side, "left").withColumn("l" + side, F.coalesce("l" + side, side))
    return named.where("lx <> ly").select("x", "y", "lx")


def _picked(pairs: DataFrame, most: int) -> DataFrame:
    """At most so many pairs of each component."""
    dealt = pairs.groupBy("lx", F.pmod(F.xxhash64("x", "y"), F.lit(most)).alias("deal")).agg(F.min(F.struct("x", "y")).alias("one"))
    return dealt.select("one.x", "one.y")


def text_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "text_key") -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a column ``out`` that differs where texts of one key differ, and (key_of, out) of the keys it stands for.

    A key with one text stands for itself, a null one stays null; a key with
    several has a 64-bit hash of key and text for each.  None if there is none.
    """
    own, tag = F.col(key).cast("bigint"), F.xxhash64(text_or_empty(text))
    several = docs.where(F.col(key).isNotNull()).groupBy(own.alias("key_of")).agg(F.min(tag).alias("lo"), F.max(tag).alias("hi"))
    several = materialise(several.where("lo <> hi").select("key_of"))
    n = several.count()
    if not n:
        return docs.withColumn(out, own), None
    marked = docs.join(F.broadcast(several) if n <= BROADCAST_KEYS else several, own == F.col("key_of"), "left")
    marked = marked.withColumn(out, F.when(F.col("key_of").isNull(), own).otherwise(F.xxhash64(own, text_or_empty(text))))
    return marked.drop("key_of"), marked.where("key_of IS NOT NULL").select("key_of", out).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (the smallest key reachable by links, its own included).

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of distinct shingles of ``size`` words; a text with fewer words is one
    shingle, a null text or one without words has none and no links.  Repeated
    rows are each returned; rows that share a key count as linked.  A null key
    gives a null component and links nobody.  The key must be an integer.  An
    empty table gives an empty result.
    """
    rows, shared = text_keys(docs.select(F.col(key).alias("own_key"), F.col(text).alias("own_text")), "own_key", "own_text")
    found = text_groups(rows, "text_key", "own_text", size, percent)
    if shared is None:
        return found.withColumnRenamed("text_key", key)
    found = materialise(found.join(shared, "text_key", "left").withColumn("key_of", F.coalesce("key_of", "text_key")))
    # the texts of one key belong together
    sides = shared.select("text_key").join(found.select("text_key", "key_of", "component_id").distinct(), "text_key")
    least = sides.groupBy("key_of").agg(F.min("component_id").alias("y"))
    merged = components(sides.join(least, "key_of").select(F.col("component_id").alias("x"), "y"))
    whole = found.join(merged, found["component_id"] == merged["node"], "left").withColumn("whole", F.coalesce("label", "component_id"))
    whole = materialise(whole.select("key_of", "n_shingles", "whole"))
    smallest = whole.where("whole IS NOT NULL").groupBy("whole").agg(F.min("key_of").alias("component_id"))
    return whole.join(smallest, "whole", "left").select(F.col("key_of").alias(key), "n_shingles", "component_id")


def text_groups(docs: DataFrame, key: str, text: str, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """As ``near_duplicates``, for keys that have one text each."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), text_or_empty(text).alias("text"))
    seen = materialise(rows.mapInArrow(_inspect(size), _INSPECTED))
    lengths = _counters(seen)
    hot = HOT * max(1.0, lengths.mean())
    info = seen.where("kind = 0").select("id", "a", "b", "n")
    marks = materialise(seen.where("kind = 0 AND n > 0 AND id IS NOT NULL").select(F.col("id").alias("node"), *SKETCH).dropDuplicates(["node"]))

    copies = info.where("n > 0 AND id IS NOT NULL").groupBy("a", "b").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("a", "b", "first")
    known = materialise(info.join(copies, ["a", "b"], "left").select(
        "id", "n", F.coalesce("first", "id").alias("node"), (F.col("n") > 0).alias("any")))
    moved = known.where("any AND id <> node").select("id", "node").distinct()
    del seen, info, copies
    release(docs.sparkSession)

    posted = rows.mapInArrow(_post(size, percent, lengths, hot), "list bigint, id bigint, at int, n bigint, salt int")
    # a hot list is dealt out over many windows and kept without its count, which its counter already tells
    both = Window.partitionBy("list", "salt")
    shared = posted.withColumn("of", F.count(F.lit(1)).over(both)).where("salt >= 0 OR of > 1").drop("of")
    nodes = shared.join(moved, "id", "left").select("list", "salt", F.coalesce("node", "id").alias("node"), "n", "at").distinct()
    # copies are one node now, so some lists have one member left
    lists = nodes.withColumn("of", F.count(F.lit(1)).over(both)).where("salt >= 0 OR of > 1")
    lists = materialise(lists.select("list", "node", "n", "at"))
    del posted, shared, nodes
    release(docs.sparkSession)

    links, labels = None, None

    def joined(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = materialise(verified(pairs, rows, size, percent))
        whole = found if links is None else links.unionByName(found)
        return whole, components(whole)

    for turn in range(STAR_ROUNDS):
        lists = _labelled(lists.select("list", "node", "n", "at"), labels)
        pairs = materialise(star_pairs(lists, marks, turn, percent))
        links, labels = joined(pairs)
        del pairs
        release(docs.sparkSession)  # the files of a finished round go before the next one writes
    lists = _labelled(lists.select("list", "node", "n", "at"), labels)
    left, most = materialise(_between(crossing_pairs(lists, percent, marks), labels)), PICKED
    del lists
    while (n := left.count()) or labels is None:
        # near copies join through a few pairs each; what is then within one component needs no test
        picked = materialise(_picked(left, most))
        if 2 * picked.count() >= n:
            picked = left.select("x", "y")
        links, labels = joined(picked)
        left, most = materialise(_between(left.join(picked, ["x", "y"], "left_anti"), labels)), most * 16
        del picked
        release(docs.sparkSession)
    out = known.join(labels.withColumnRenamed("label", "component"), "node", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
