"""Repair of conversation structure by the cheapest edits, in linear space.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles.  Four
states say where a prefix stands: nothing yet, after the system turn, after a
user turn, after an assistant turn.  A row's edit (keep, rerole, delete, with
inserts before it) moves between them at a cost; an end mark inserts what is
still missing.  Hirschberg's scheme finds the edits: forward costs of the first
half and backward costs of the second meet in the middle, the optimal crossing
whose edits come first in ASCII order is chosen, and both halves are solved
alike.  Of two prefixes over the same rows neither begins the other, so their
order is a rank among four, and ranks travel with the costs.

On Spark the rows are reduced to what the edits need (no text) and
range-partitioned by conversation and turn, so a conversation of any length
spreads over partitions.  Only the first and last conversation of a partition
can go on in another; those give a matrix of four by four costs and ranks,
the same scheme over the matrices fixes the states at the borders, and then all
partitions are solved at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronoband.llm.common import materialise

NOTHING, SYSTEM, USER, ASSISTANT, OVER = range(5)
#: role that comes next after each state where no system turn is kept
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 2, 3, 2, 1
COST = {"K": KEEP, "R": REROLE, "D": DELETE}
#: initials of roles that may follow each other
LEGAL = ("su", "ua", "au")
#: fault of a row; the first that holds counts
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
END = -1
#: conversations up to so many rows are remembered by their codes
SHORT, REMEMBERED = 32, 4096
ROWS_PER_PARTITION = 200_000

Moves = list[tuple[int, int, int, object]]
Costs = dict[int, tuple[int, int]]


@lru_cache(maxsize=None)
def moves(code: int) -> Moves:
    """(state, next state, cost, edits) of a row: the cheapest, then ASCII-least edits for each pair of states.

    A code is ``4 * initial + fault``; ``END`` is the end mark.
    """
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(a: int, b: int, cost: int, edits: str) -> None:
        found[a, b] = min(found.get((a, b), (cost, edits)), (cost, edits))
    for start in (NOTHING, SYSTEM, USER, ASSISTANT):
        at = start
        for inserts in range(4):
            cost, edits = INSERT * inserts, "I" * inserts
            if code == END:
                if at in (NOTHING, ASSISTANT):
                    offer(start, OVER, cost, edits)
            else:
                initial, fault = divmod(code, 4)
                offer(start, at, cost + DELETE, edits + "D")
                if fault not in (BLANK, DUPLICATE):
                    stays = LEFT_TRUNCATED * (fault == TRUNCATED)
                    offer(start, NEXT[at], cost + REROLE + stays, edits + "R")
                    if initial and (initial == NEXT[at] or initial == SYSTEM and at == NOTHING):
                        offer(start, initial, cost + KEEP + stays, edits + "K")
            at = NEXT[at]
    return [(a, b, cost, edits) for (a, b), (cost, edits) in found.items()]


def forward(steps: list[Moves], state: int) -> Costs:
    """State to (cost, rank of its ASCII-least edits among the states) after ``steps`` from ``state``."""
    now: Costs = {state: (0, 0)}
    for step in steps:
        best: dict[int, tuple] = {}
        for a, b, cost, edits in step:
            if a in now:
                own = (now[a][0] + cost, now[a][1], edits)
                if b not in best or own < best[b]:
                    best[b] = own
        order = {b: k for k, b in enumerate(sorted(best, key=lambda b: best[b][1:]))}
        now = {b: (v[0], order[b]) for b, v in best.items()}
    return now


def backward(steps: list[Moves], state: int) -> dict[int, int]:
    """State to the cost of ``steps`` from it to ``state``."""
    now = {state: 0}
    for step in reversed(steps):
        best: dict[int, int] = {}
        for a, b, cost, _ in step:
            if b in now and (a not in best or now[b] + cost < best[a]):
                best[a] = now[b] + cost
        now = best
    return now


def hirschberg(steps: list[Moves], first: int, last: int) -> list[tuple[int, int]]:
    """The states (before, after) of each step on the cheapest, then ASCII-least way from ``first`` to ``last``."""
    if not steps:
        return []
    if len(steps) == 1:
        return [(first, last)]
    middle = len(steps) // 2
    ahead, behind = forward(steps[:middle], first), backward(steps[middle:], last)
    _, _, crossing = min((ahead[s][0] + behind[s], ahead[s][1], s) for s in ahead if s in behind)
    return hirschberg(steps[:middle], first, crossing) + hirschberg(steps[middle:], crossing, last)


def _edits(codes: tuple[int, ...], first: int, last: int) -> list[tuple[str, int]]:
    """Edits of each step and the state after it."""
    steps = [moves(c) for c in codes]
    tables = [{(a, b): edits for a, b, _, edits in step} for step in steps]
    return [(table[pair], pair[1]) for table, pair in zip(tables, hirschberg(steps, first, last), strict=True)]


@lru_cache(maxsize=REMEMBERED)
def _short_edits(codes: tuple[int, ...], first: int, last: int) -> list[tuple[str, int]]:
    return _edits(codes, first, last)


def edits(codes: list[int], first: int = NOTHING, last: int = OVER) -> list[tuple[str, int]]:
    return (_short_edits if len(codes) <= SHORT else _edits)(tuple(codes), first, last)


def matrix(codes: list[int], ends: bool) -> list[list[int]]:
    """Rows (state, next state, cost, rank) of a stretch as one step; ranks compare next states of one state."""
    steps = [moves(c) for c in codes] + [moves(END)] * ends
    return [[a, b, cost, rank] for a in (NOTHING, SYSTEM, USER, ASSISTANT) for b, (cost, rank) in forward(steps, a).items()]


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def facts(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Equal rows as one: conv, turn, role, sha (of the text), n, blank, cut (does not end in a stop)."""
    body = F.rtrim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    seen = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), digest(F.col(text)).alias("sha"),
                       (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"))
    return seen.groupBy("conv", "turn", "role", "sha", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))


def _same(columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"own.{c}").eqNullSafe(F.col(f"again.{c}")) for c in columns])


def ordered_rows(rows: DataFrame, **names: str) -> DataFrame:
    """Facts in their order, each with its fault and a code: a checkpointed table whose partitions are ranges of (conv, turn).

    Rows of one turn stand by role, then by the digest of their text.  Equal rows
    are one with a count: the copies are deleted where they stand, as a delete
    comes before any other edit of the same cost, so they need no search.
    """
    own = materialise(facts(rows, **names))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = own.groupBy("conv", "role", "sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    marked = own.alias("own").join(again.alias("again"), _same(["conv", "role", "sha"]), "left").select("own.*", "first")
    repeated = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("blank"), BLANK).when(repeated, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    initial = F.when(F.col("role").startswith("s"), SYSTEM).when(F.col("role").startswith("u"), USER).when(F.col("role").startswith("a"), ASSISTANT).otherwise(0)
    coded = marked.select("conv", "turn", "role", "sha", "n", (initial * 4 + fault).cast("int").alias("code"))
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "sha"]
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // ROWS_PER_PARTITION))
    ranged = coded.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return materialise(ranged.withColumn("part", F.spark_partition_id()))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, dict[str, list]]]:
    """The conversations of a partition in their order: (conv, part, columns)."""
    conv, part, held = None, None, None
    for batch in batches:
        columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        at = 0
        while at < batch.num_rows:
            now = columns["conv"][at]
            until = at + 1
            while until < batch.num_rows and columns["conv"][until] == now:
                until += 1
            if held is not None and now == conv:
                for n, c in columns.items():
                    held[n] += c[at:until]
            else:
                if held is not None:
                    yield conv, part, held
                conv, part, held = now, columns["part"][at], {n: c[at:until] for n, c in columns.items()}
            at = until
    if held is not None:
        yield conv, part, held


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of a partition as matrices, without and with the end mark."""
    first, last = None, None
    for run in _runs(batches):
        first, last = first or run, run
    out = [] if first is None else [first] if last is first else [first, last]
    yield pa.RecordBatch.from_pydict({
        "conv": [str(conv) if conv is not None else None for conv, _, _ in out], "part": pa.array([part for _, part, _ in out], pa.int32()),
        "inner": pa.array([matrix(h["code"], False) for _, _, h in out], pa.list_(pa.list_(pa.int64()))),
        "final": pa.array([matrix(h["code"], True) for _, _, h in out], pa.list_(pa.list_(pa.int64()))),
        "initial": pa.array([h["role"][-1][:1] for _, _, h in out], pa.string())},
        schema=pa.schema([("conv", pa.string()), ("part", pa.int32()), ("inner", pa.list_(pa.list_(pa.int64()))),
                          ("final", pa.list_(pa.list_(pa.int64()))), ("initial", pa.string())]))


def border_states(placed: DataFrame) -> dict[tuple[str | None, int], tuple[int, int, str | None]]:
    """(conv, part) to (state before, state after, initial before) of conversations that lie in several partitions.

    At most two rows per partition reach the driver.
    """
    pieces: dict[str | None, list] = {}
    for r in placed.mapInArrow(_borders, "conv string, part int, inner array<array<bigint>>, final array<array<bigint>>, initial string").collect():
        pieces.setdefault(r.conv, []).append(r)
    out = {}
    for conv, own in pieces.items():
        if len(own) > 1:
            own.sort(key=lambda r: r.part)
            steps = [[tuple(m) for m in (r.final if k == len(own) - 1 else r.inner)] for k, r in enumerate(own)]
            before = [None, *[r.initial for r in own[:-1]]]
            for r, (a, b), initial in zip(own, hirschberg(steps, NOTHING, OVER), before, strict=True):
                out[conv, r.part] = (a, b, initial)
    return out


EDITED = ("part int, seq bigint, turn bigint, sha binary, was string, n bigint, fault int, breaks bigint, cost bigint, before string, edit string, "
          "role string, after string")


def _edited(states: dict[tuple[str | None, int], tuple[int, int, str | None]], kind: pa.DataType):
    """A row per fact with its edits: inserted turns before it, the edit of its first row, the role it gets, turns after the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {}
        seq = 0

        def closed() -> pa.RecordBatch:
            kinds = {"conv": kind, "part": pa.int32(), "fault": pa.int32(), "seq": pa.int64(), "turn": pa.int64(), "n": pa.int64(),
                     "breaks": pa.int64(), "cost": pa.int64(), "sha": pa.binary()}
            done = pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()})
            out.clear()
            return done
        for conv, part, held in _runs(batches):
            first, last, before = states.get((str(conv) if conv is not None else None, part), (NOTHING, OVER, None))
            codes = held["code"]
            plan = edits([*codes, END] if last == OVER else codes, first, last)
            state = first
            for k, (code, n, role) in enumerate(zip(codes, held["n"], held["role"], strict=True)):
                (letters, after), inserted, ending = plan[k], [], []
                for _ in letters[:-1]:
                    state = NEXT[state]
                    inserted.append(NAMES[state])
                state, edit = after, letters[-1]
                end = plan[-1][0] if k == len(codes) - 1 and last == OVER else ""
                for _ in end:
                    state = NEXT[state]
                    ending.append(NAMES[state])
                new = None if edit == "D" else role if edit == "K" else NAMES[after]
                cost = INSERT * (len(inserted) + len(ending)) + COST[edit] + DELETE * (n - 1) + LEFT_TRUNCATED * (code % 4 == TRUNCATED and edit != "D")
                initial = role[:1]
                row = {"conv": conv, "part": part, "seq": seq, "turn": held["turn"][k], "sha": held["sha"][k], "was": role, "n": n, "fault": code % 4,
                       "breaks": (n - 1) + (before is not None and before + initial not in LEGAL), "cost": cost, "before": ",".join(inserted),
                       "edit": letters + "D" * (n - 1) + end, "role": new, "after": ",".join(ending)}
                before = initial
                for c, v in row.items():
                    out.setdefault(c, []).append(v)
                seq += 1
            if len(out["seq"]) >= 4096:
                yield closed()
        if out:
            yield closed()
    return run


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of ``rows`` that differ, each with its edits, in order of (conv, part, seq).

    ``n`` equal rows are one; ``edit`` has the letters of all of them and of the
    turns inserted around them (Keep, Rerole, Delete, Insert), ``role`` the role
    the first one gets (null where it is deleted), ``before`` and ``after`` the
    roles of inserted turns, ``text`` its text where it stays, ``fault`` 0 none,
    1 blank, 2 duplicate, 3 truncated, ``breaks`` the role changes that are not
    su, ua or au, ``cost`` the cost of the edits.

    A null conversation is one conversation, a null turn stands first, a null
    role or text must be replaced before.  Rows of one turn stand by role, then
    by a digest of the text.  Texts may be of any length; they are not moved for
    the search.  An empty table gives an empty result.
    """
    names = {"conv": conv, "turn": turn, "role": role, "text": text}
    placed = ordered_rows(rows, **names)
    kind = placed.schema["conv"].dataType
    states = border_states(placed)
    schema = T.StructType([T.StructField("conv", kind), *T._parse_datatype_string(EDITED).fields])
    found = placed.select("conv", F.col("turn").cast("bigint").alias("turn"), "role", "sha", "n", "code", "part").mapInArrow(
        _edited(states, to_arrow_type(kind)), schema)
    found = materialise(found)
    keys = ["conv", "turn", "was", "sha"]
    texts = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("was"),
                        digest(F.col(text)).alias("sha"), F.col(text).alias("text")).dropDuplicates(keys)
    staying = found.where("role IS NOT NULL").alias("own").join(texts.alias("again"), _same(keys)).select("own.*", "text")
    return staying.unionByName(found.where("role IS NULL").withColumn("text", F.lit(None).cast("string")))


def _joined(kind: pa.DataType):
    """Rows sorted by (conv, part, seq): the edits of a conversation in one string, its repaired rows in one hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, total, any_row = None, [], None, False
        out: list[tuple[object, str, str]] = []

        def put(role: str, text: str) -> None:
            nonlocal any_row
            total.update((("\n" if any_row else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            any_row = True

        def flushed() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pydict({"conv": pa.array([o[0] for o in out], kind), "audit": pa.array([o[1] for o in out], pa.string()),
                                               "repaired_sha256": pa.array([o[2] for o in out], pa.string())})
            out.clear()
            return done
        for batch in batches:
            for conv, before, edit, role, after, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total is None or conv != now:
                    if total is not None:
                        out.append((now, "".join(audit), total.hexdigest()))
                    now, audit, total, any_row = conv, [], hashlib.sha256(), False
                audit.append(edit)
                for name in before.split(",") if before else []:
                    put(name, "")
                if role is not None:
                    put(role, text)
                for name in after.split(",") if after else []:
                    put(name, "")
            if len(out) >= 1024:
                yield flushed()
        if total is not None:
            out.append((now, "".join(audit), total.hexdigest()))
            yield flushed()
    return run


def repair_summary(rows: DataFrame, convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per value of ``convs``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The hash of a conversation reads its repaired rows in order, so one task
    streams them; it holds one batch and the audit.  A conversation without rows
    has zeros, an empty audit and the hash of the empty string.
    """
    found = materialise(repaired(rows, conv, turn, role, text))
    kind = found.schema["conv"]
    moved = found.select("conv", "part", "seq", "before", "edit", "role", "after", "text").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    texts = moved.select("conv", "before", "edit", "role", "after", "text").mapInArrow(
        _joined(to_arrow_type(kind.dataType)), T.StructType([kind, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]))

    def of(fault: int) -> Column:
        return F.sum(F.when(F.col("fault") == fault, F.when(F.lit(fault) == BLANK, F.col("n")).otherwise(1)).otherwise(0))
    copies = F.sum(F.when(F.col("fault") == BLANK, 0).otherwise(F.col("n") - 1))
    sums = found.groupBy("conv").agg(of(BLANK).alias("blank"), (of(DUPLICATE) + copies).alias("duplicate"), of(TRUNCATED).alias("truncated"),
                                     F.sum("breaks").alias("illegal"), F.sum("cost").alias("cost"))
    turns = found.where("turn IS NOT NULL").select("conv", "turn").distinct()
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    base = convs.select(F.col(conv).alias("own")).distinct()
    whole = base
    for side, name in ((sums, "s"), (gaps, "g"), (texts, "t")):
        side = side.withColumnRenamed("conv", f"conv_{name}")
        whole = whole.join(side, F.col("own").eqNullSafe(F.col(f"conv_{name}")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(F.col("own").alias(conv), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
