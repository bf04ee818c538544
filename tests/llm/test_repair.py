import hashlib
import heapq
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from tagloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(rows):
    """Best-first search over whole strings: (cost, audit, repaired messages), insertions anywhere."""
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(out)
        if (i, audit, roles[-2:], len(roles)) in done or not re.fullmatch("s?(ua)*u?", roles):
            continue
        done.add((i, audit, roles[-2:], len(roles)))
        if audit.count("I") < 3:
            for name in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + name[0], (*out, (name, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
            if found[i] not in ("blank", "duplicate"):
                extra = 5 if found[i] == "truncated" else 0
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + (role[:1] or "?"), (*out, (role, text))))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, roles + name[0], (*out, (name, text))))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        out += [(turn, "user" if x == 4 else role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    return order(out)


def report(conv, rows):
    turns = [t for t, _, _ in rows if t is not None]
    found, (cost, audit, kept) = faults(rows), plain(rows)
    return {
        "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }


def conversations(rnd, n):
    rows = []
    for conv in [None, *range(n)]:
        for t in range(rnd.randint(1, 7)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "cut of", "Well, é?", " \n", "", None, "end. \t", "…", "😀"])
            rows.append((conv, rnd.choice([t, t, t + 2, None, 0]), role, text))
    return rows + rows[:3]


def test_digest_against_search_over_all_repairs(spark):
    rows = conversations(random.Random(5), 60)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", cost string").repartition(3)
    want = {c: report(c, damage([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    for chunk_rows in (256, 2, 1):
        got = {r["conv_id"]: r.asDict() for r in repair.repair_digest(df, chunk_rows).collect()}
        assert got == want


def test_digest_against_sql(spark):
    rows = conversations(random.Random(6), 80)
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    key = lambda r: str(r)
    sql = con.sql(repair.ORACLE).select(",".join(cols)).fetchall()
    got = [tuple(r) for r in repair.repair_digest(df).select(cols).collect()]
    assert sorted((r for r in got if r[0] is not None), key=key) == sorted((r for r in sql if r[0] is not None), key=key)


def test_weights_of_chunks_join_to_those_of_the_whole():
    rnd = random.Random(7)
    for _ in range(200):
        rows = [(rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["", "", "blank", "truncated", "duplicate"])) for _ in range(rnd.randint(0, 12))]
        at = rnd.randint(0, len(rows))
        whole = repair.chunk_weights(rows)[0]
        head = repair.chunk_weights(rows[:at])[0]
        assert repair.join_weights(head, at, repair.chunk_weights(rows[at:]), len(rows) - at) == whole


def test_messages_follow_the_audit(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "S."), ("user", "a."), ("user", "b."), ("assistant", "c."), ("assistant", "c."), ("user", "")])]
    got = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    want = plain(order([r[1:] for r in rows]))
    assert [(r["role"], r["text"]) for r in got] == want[2]
    assert "".join(r["edit"] for r in got) == want[1].replace("D", "")


def test_long_conversation_and_long_text_over_many_partitions(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"Word {t % 911}{'.' if t % 5 else ''}") for t in range(3000)] + [(8, 0, "user", "x" * 3_000_000 + "."), (8, 1, "assistant", "y.")]
    rows += [(9, 0, "user", "again.")] * 700
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = {r["conv_id"]: r for r in repair.repair_digest(df).collect()}
    kept = damage([r for r in rows if r[0] == 7])
    best = repair.cheapest(repair.chunk_weights([(r, f) for (_, r, _), f in zip(kept, faults(kept))])[0], len(kept))
    assert (got[7]["cost"], got[7]["audit"]) == best
    n = len(damage(rows[-700:]))
    assert got[9]["audit"] == "D" * n and got[9]["duplicate"] in (0, n - 1) and got[8]["conv_id"] == 8


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair_digest(df).collect() == [] and repair.repair_conversations(df).where(F.lit(True)).collect() == []
