"""Conversation repair against a search over all edits, and the damaged table against a plain version."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chronoband.llm import conversations as C
from chronoband.llm.queries import damaged, op12_conversation_repair
from tests.conftest import SMALL

KIND = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()
BODY = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """blank, duplicate, truncated or fine per row."""
    out, seen = [], set()
    for role, text in rows:
        body = BODY.findall(text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "fine" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows):
    """Cheapest edits, ASCII-least: shortest paths over (rows read, state), the audit in the key.  No halves, no matrices."""
    kinds = faults(rows)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, out = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        follows = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[follows]
        heapq.heappush(queue, (cost + 2, audit + "I", at, follows, (*out, (name, ""))))
        if at < len(rows):
            (role, text), kind = rows[at], kinds[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, out))
            if kind in ("fine", "truncated"):
                stays = int(kind == "truncated")
                heapq.heappush(queue, (cost + 2 + stays, audit + "R", at + 1, follows, (*out, (name, text))))
                if role[:1] == follows or role[:1] == "s" and state == "":
                    heapq.heappush(queue, (cost + stays, audit + "K", at + 1, role[:1], (*out, (role, text))))


def plain(rows, originals):
    """rows: (conv, turn, role, text) after damage."""
    out = []
    for conv in dict.fromkeys(originals):
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        said = [(r[2], r[3]) for r in own]
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, fixed = search(said)
        kinds = faults(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def summary(frame, base):
    return sorted((tuple(r) for r in C.repair_summary(frame, base).select(*COLUMNS).collect()), key=str)


def corpus(seed, convs=60, most=12):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        turn = 0
        for _ in range(rng.randrange(0, most)):
            role = rng.choices(["system", "user", "assistant", "tool", "", "s", "Ürole", " "], [2, 6, 6, 1, 1, 1, 1, 1])[0]
            text = rng.choice(["Hello.", "What?", "no end", "", " \t\n", "Yes! ", "a\nb.", "É…", "Same.", f"t{rng.randrange(9)}."])
            rows.append((c, None if rng.random() < 0.05 else turn, role, text))
            if rng.random() < 0.15:
                rows += [rows[-1]] * rng.randrange(1, 4)
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_search(spark, seed):
    rows = corpus(seed)
    base = [*rows, (777, 1, "user", "dropped"), (778, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", part string, n int").repartition(5)
    assert summary(frame, spark.createDataFrame(base, KIND)) == plain(rows, [r[0] for r in base])


def test_one_conversation_over_many_partitions(spark):
    """Borders of partitions inside a conversation: matrices and ranks decide the same edits as one pass."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "user", "system", "x"]), rng.choice([f"text {t}.", f"cut {t}", "", "Again."])) for t in range(400)]
    rows += [(0, 1, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        placed = C.ordered_rows(spark.createDataFrame(rows, KIND))
        assert placed.where("conv = 1").select("part").distinct().count() > 10
        got = summary(spark.createDataFrame(rows, KIND), spark.createDataFrame(rows, KIND))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == plain(rows, [0, 1, 2])


def test_search_in_halves():
    rng = random.Random(9)
    for _ in range(300):
        codes = [rng.choice([4 * i + f for i in range(4) for f in range(4)]) for _ in range(rng.randrange(0, 12))]
        rows, want = [], ["fine", "blank", "duplicate", "truncated"]
        for k, c in enumerate(codes):
            initial = ["x", "s", "u", "a"][c // 4]
            fault = want[c % 4]
            if fault == "duplicate" and not rows:
                codes[k], fault = c - c % 4, "fine"
            if fault == "duplicate":
                twin = next((r for r, f in zip(rows, codes, strict=False) if f % 4 in (0, 3)), None)
                if twin is None:
                    codes[k], fault = c - c % 4, "fine"
                else:
                    codes[k] = 4 * "xsua".index(twin[0]) + 2
                    rows.append(twin)
                    continue
            rows.append((initial, {"blank": "", "fine": f"{k}.", "truncated": f"{k}"}[fault]))
        cost, audit, _ = search(rows)
        assert "".join(e for e, _ in C.edits([*codes, C.END])) == audit
        for cut in range(len(codes) + 1):
            steps = [[tuple(m) for m in C.matrix(codes[:cut], False)], [tuple(m) for m in C.matrix(codes[cut:], True)]]
            (a, b), (c, d) = C.hirschberg(steps, C.NOTHING, C.OVER)
            halves = C.edits(codes[:cut], a, b) + C.edits([*codes[cut:], C.END], c, d)
            assert "".join(e for e, _ in halves) == audit


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "More."), (1, 3, "tool", "cut"), (1, 4, "assistant", "")]
    out = C.repaired(spark.createDataFrame(rows, KIND)).orderBy("part", "seq").collect()
    assert "".join(r.edit for r in out) == search([r[2:] for r in rows])[1]
    assert [(r.was, r.fault) for r in out] == [("user", 0), ("user", 2), ("user", 0), ("tool", 3), ("assistant", 1)]
    assert all((r.text is None) == (r.role is None) for r in out)


def test_many_copies_and_long_text(spark):
    rows = spark.range(30_000).select(F.lit(4).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("turn"),
                                      F.lit("user").alias("role"), F.lit("Again.").alias("text"))
    long = spark.createDataFrame([(4, 2, "assistant", "word " * 200_000)], KIND)
    (got,) = summary(rows.unionByName(long), rows)
    text = "user:Again.\nassistant:" + "word " * 200_000
    assert got == (4, 0, 0, 29_999, 1, 29_999, 3 * 29_999 + 1, "K" + "D" * 29_999 + "K", hashlib.sha256(text.encode()).hexdigest())


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert summary(none, none) == []
    assert summary(none, spark.createDataFrame([(3, 1, "user", "x")], KIND)) == [(3, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def harmed(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = [(None, None, None, None), (None, 3, None, "x."), (5, None, "user", None), *[(k, None, None, "y") for k in range(90, 130)]]
    for given in (rows, odd):
        frame = spark.createDataFrame(given, KIND)
        after = list(harmed(given))
        assert sorted((tuple(r) for r in damaged(frame).collect()), key=str) == sorted(after, key=str)
        assert summary(damaged(frame), frame) == plain(after, [r[0] for r in given])
    got = sorted((tuple(r) for r in op12_conversation_repair(spark, SMALL).select(*COLUMNS).collect()), key=str)
    assert got == plain(list(harmed(rows)), [r[0] for r in rows])
