"""Conversation structure repair by shortest paths over scalar big-integer weights.

The repairs of a conversation are the paths of a DAG whose nodes are (rows read, insertions so far,
state of the role grammar). A weight is one integer: its high digits are the cost, its low digits,
three bits each, the edits' letters at the places that they take in the audit; places beyond the
audit's end are zero. The smallest integer is the cheapest repair and among those the one whose
audit is ASCII-least, so the DP is a plain minimum of integers.

Rows of a conversation lie in chunks of bounded size, in order over range partitions. A chunk gives
the least weights from each state to each node; a conversation is the fold of its chunks, read as a
sorted stream without texts. The chunks are then read once more in that order for the repaired
messages. No task holds a conversation's rows, only its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, shuffle_width

#: Cost of each edit; a truncated row that is not deleted costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Insertions that the DAG has room for. No cheapest repair holds any: an inserted message stands in a pair of user and
#: assistant, and deleting that pair, with a system row before it where no other pair follows, costs 2 + 2 at most instead of 5.
INSERTS = 2
#: A chunk ends at so many rows or bytes of text.
CHUNK_ROWS, CHUNK_BYTES = 256, 1 << 18

_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTER = {v: k for k, v in _DIGIT.items()}
#: States: nothing yet, after the system row, after a user's row, after an assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: (_USER, "user"), _SYSTEM: (_USER, "user"), _USER: (_ASSISTANT, "assistant"), _ASSISTANT: (_USER, "user")}
_NODES = 4 * (INSERTS + 1)

Weights = list[int | None]


def _kept(state: int, role: str) -> int | None:
    """The state after a row that keeps its role, if the grammar allows it."""
    if state == _START and role[:1] == "s":
        return _SYSTEM
    after, name = _NEXT[state]
    return after if role[:1] == name[0] else None


def _edges(state: int, role: str, fault: str) -> list[tuple[int, int, str]]:
    """(next state, cost, letter) of the edits of one row."""
    out = [(state, DELETE, "D")]
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        if (after := _kept(state, role)) is not None:
            out.append((after, extra, "K"))
        out.append((_NEXT[state][0], REROLE + extra, "R"))
    return out


def _improve(best: Weights, at: int, weight: int) -> None:
    if best[at] is None or weight < best[at]:
        best[at] = weight


def _insert(best: Weights, row: int, width: int) -> None:
    """Edges of an insertion before the row numbered ``row``, among ``width`` places."""
    for k in range(INSERTS):
        for state in range(4):
            if (w := best[4 * k + state]) is not None:
                w += (INSERT << 3 * width) + (_DIGIT["I"] << 3 * (width - 1 - row - k))
                _improve(best, 4 * (k + 1) + _NEXT[state][0], w)


def chunk_weights(rows: list[tuple[str, str]]) -> list[Weights]:
    """For each first state the least weight to each node 4 * insertions + state, over rows of (role, fault)."""
    width, out = len(rows) + INSERTS, []
    for first in range(4):
        best: Weights = [None] * _NODES
        best[first] = 0
        for i, (role, fault) in enumerate(rows):
            _insert(best, i, width)
            new: Weights = [None] * _NODES
            for state in range(4):
                edges = _edges(state, role, fault)
                for k in range(INSERTS + 1):
                    if (w := best[4 * k + state]) is not None:
                        for after, cost, letter in edges:
                            _improve(new, 4 * k + after, w + (cost << 3 * width) + (_DIGIT[letter] << 3 * (width - 1 - i - k)))
            best = new
        out.append(best)
    return out


def join_weights(prefix: Weights, before: int, chunk: list[Weights], rows: int) -> Weights:
    """``prefix``, the weights over ``before`` rows from the start, and one more chunk of ``rows`` rows."""
    out: Weights = [None] * _NODES
    own, whole = 3 * (rows + INSERTS), 3 * (before + rows + INSERTS)
    for k in range(INSERTS + 1):
        for state in range(4):
            if (w := prefix[4 * k + state]) is not None:
                for at, c in enumerate(chunk[state][: _NODES - 4 * k]):
                    if c is not None:
                        _improve(out, 4 * k + at, (w << 3 * rows) + ((c >> own) << whole) + ((c & ((1 << own) - 1)) >> 3 * k))
    return out


def cheapest(weights: Weights, rows: int) -> tuple[int, str]:
    """(cost, audit) of the least weight that ends the role grammar, over a whole conversation of ``rows`` rows."""
    last, width = list(weights), rows + INSERTS
    _insert(last, rows, width)
    least = min(w for at, w in enumerate(last) if w is not None and at % 4 in (_START, _ASSISTANT))
    digits = least & ((1 << 3 * width) - 1)
    return least >> 3 * width, "".join(_LETTER[x] for x in map(int, format(digits, "o").zfill(width)) if x)


def _fault(role: Column, text: Column, first: Column) -> Column:
    last = F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", "blank").when(~first, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


def _with_faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) with equal ones added up, and ``first``: the role and text stand nowhere earlier.

    The first places come from an aggregate and meet their rows by one more, on the whole row as key: no key is hot.
    """
    known, turn = F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0))
    first = (
        rows.where("copies > 0").groupBy("conv_id", "role", "text").agg(F.min(F.struct(known.alias("known"), turn.alias("turn"))).alias("at"))
        .select("conv_id", F.when(F.col("at.known"), F.col("at.turn")).alias("turn"), "role", "text", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first"))
    )
    both = rows.withColumn("first", F.lit(False)).unionByName(first)
    found = both.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"), F.max("first").alias("first"))
    return found.withColumn("fault", _fault(F.col("role"), F.col("text"), F.col("first")))


def _chunk_schema(conv: pa.DataType) -> pa.Schema:
    longs = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")
    return pa.schema(
        [("conv_id", conv), ("part", pa.int32()), ("seq", pa.int64()), *((c, pa.int64()) for c in longs), ("first_role", pa.string()), ("last_role", pa.string()),
         ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.string())), ("weights", pa.list_(pa.binary()))]
    )


def _ddl(schema: pa.Schema, conv: str) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.list_(pa.binary()): "array<binary>"}
    return ", ".join(f"{f.name} {conv if f.name == 'conv_id' else names[f.type]}" for f in schema)


def _illegal(before: str | None, role: str) -> bool:
    return before is not None and before[:1] + role[:1] not in ("su", "ua", "au")


def _chunk(conv: Any, part: int, seq: int, rows: list[tuple]) -> dict:
    """One chunk of rows (turn, role, text, fault) in order."""
    roles, faults, turns = [r[1] for r in rows], [r[3] for r in rows], [r[0] for r in rows if r[0] is not None]
    return {
        "conv_id": conv, "part": part, "seq": seq, "rows": len(rows), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(_illegal(a, b) for a, b in zip(roles, roles[1:])), "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first_role": roles[0] if roles else None, "last_role": roles[-1] if roles else None, "roles": roles, "texts": [r[2] for r in rows], "faults": faults,
        "weights": [None if w is None else w.to_bytes(w.bit_length() // 8 + 1, "big") for best in chunk_weights(list(zip(roles, faults))) for w in best],
    }


def _batches(records: Iterable[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of some megabytes."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += 400 + sum(map(len, r.get("texts") or ())) + len(r.get("text") or "") + len(r.get("audit") or "")
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of a partition, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """The chunks of all conversations; (part, seq) orders those of one conversation."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = _chunk_schema(to_arrow_type(rows.schema["conv_id"].dataType))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def records() -> Iterator[dict]:
            held, size, seq, now, any_row = [], 0, 0, None, False
            for r in _stream(batches):
                if any_row and r["conv_id"] != now:
                    yield _chunk(now, part, seq, held)
                    held, size, seq = [], 0, seq + 1
                now, any_row = r["conv_id"], True
                for i in range(r["copies"]):
                    if held and (len(held) >= chunk_rows or size + len(r["text"]) > CHUNK_BYTES):
                        yield _chunk(now, part, seq, held)
                        held, size, seq = [], 0, seq + 1
                    fault = r["fault"] if i == 0 or r["fault"] == "blank" else "duplicate"
                    held.append((r["turn"], r["role"], r["text"], fault))
                    size += len(r["text"])
            if any_row:
                yield _chunk(now, part, seq, held)

        return _batches(records(), schema)

    # bounds of ranges are sampled rows: they hold the head of a text only; within a partition the whole text sorts
    n = shuffle_width(rows.sparkSession)
    placed = rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 200)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(placed.mapInArrow(cut, _ddl(schema, conv)), "chunks")


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _slices(chunks: DataFrame) -> DataFrame:
    """For each chunk its letters of the audit; the conversation's first one also has the report."""
    conv = chunks.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", to_arrow_type(chunks.schema["conv_id"].dataType)), ("part", pa.int32()), ("seq", pa.int64()), ("letters", pa.string()), *((c, pa.int64()) for c in _LONGS), ("audit", pa.string())])

    def finished(conv_id: Any, s: dict) -> Iterator[dict]:
        cost, audit = cheapest(s["weights"], s["rows"])
        low, high = s["turns_seen"]
        gaps = min(high - low + 1 - s["turns"], 2**63 - 1) if low is not None else 0
        report = {"gaps": gaps, "cost": cost, "audit": audit, **{c: s[c] for c in ("blank", "duplicate", "truncated", "illegal")}}
        at = 0
        for i, (part, seq, rows) in enumerate(s["chunks"]):
            end = at
            while rows and end < len(audit):  # an insertion belongs to the row after it
                rows -= audit[end] != "I"
                end += 1
            end = len(audit) if i == len(s["chunks"]) - 1 else end
            yield {"conv_id": conv_id, "part": part, "seq": seq, "letters": audit[at:end], **(report if i == 0 else {})}
            at = end

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            s, now = None, None
            for r in _stream(batches):
                if s is None or r["conv_id"] != now:
                    if s is not None:
                        yield from finished(now, s)
                    now = r["conv_id"]
                    s = {"weights": [0] + [None] * (_NODES - 1), "rows": 0, "chunks": [], "turns": 0, "turns_seen": (None, None), "role": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                w = [None if x is None else int.from_bytes(x, "big") for x in r["weights"]]
                s["weights"] = join_weights(s["weights"], s["rows"], [w[_NODES * q : _NODES * (q + 1)] for q in range(4)], r["rows"])
                s["rows"] += r["rows"]
                s["chunks"].append((r["part"], r["seq"], r["rows"]))
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    s[c] += r[c]
                if r["rows"]:
                    s["illegal"] += _illegal(s["role"], r["first_role"])
                    s["role"] = r["last_role"]
                if r["turns"]:
                    low, high = s["turns_seen"]
                    s["turns"] += r["turns"] - (high == r["first_turn"])
                    s["turns_seen"] = (r["first_turn"] if low is None else low, r["last_turn"])
            if s is not None:
                yield from finished(now, s)

        return _batches(records(), schema)

    few = chunks.drop("roles", "texts", "faults")
    placed = few.repartition(shuffle_width(few.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return materialize(placed.mapInArrow(fold, _ddl(schema, conv)), "slices")


def _messages(rows: Iterator[dict]) -> Iterator[tuple[bool, dict | None, list[tuple[str, str, str]]]]:
    """For each chunk of the sorted stream: (a conversation begins, its report, repaired messages as (edit, role, text))."""
    state, held = _START, {}
    for r in rows:
        if r["kind"] == 0:
            held = r
            continue
        begins = held["cost"] is not None
        state, out, at = _START if begins else state, [], 0
        for letter in held["letters"]:
            if letter == "I":
                state, role = _NEXT[state]
                out.append((letter, role, ""))
                continue
            role, text = r["roles"][at], r["texts"][at]
            at += 1
            if letter == "K":
                state = _kept(state, role)
                out.append((letter, role, text))
            elif letter == "R":
                state, role = _NEXT[state]
                out.append((letter, role, text))
        yield begins, held, out


def _repaired(rows: DataFrame, chunk_rows: int, emit: Callable[[Iterator], Iterator[dict]], schema: Callable[[pa.DataType], pa.Schema]) -> DataFrame:
    chunks = _chunks(_with_faults(rows), chunk_rows)
    conv = chunks.schema["conv_id"].dataType.simpleString()
    out = schema(to_arrow_type(chunks.schema["conv_id"].dataType))
    slices = _slices(chunks).withColumn("kind", F.lit(0))
    both = slices.unionByName(chunks.select("conv_id", "part", "seq", F.lit(1).alias("kind"), "roles", "texts"), allowMissingColumns=True)
    placed = both.repartition(shuffle_width(both.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq", "kind")
    return placed.mapInArrow(lambda batches: _batches(emit(_messages(_stream(batches))), out), _ddl(out, conv))


def _plain(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.lit(1).cast("long").alias("copies"))


def repair_conversations(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The repaired messages: (conv_id, place, edit, role, text), place counting from 0 in each conversation.

    Rows go by turn (null first), then role and text; a null role or text counts as one blank, a null
    conv_id as a conversation of its own. Repeated rows are duplicates of the first. Blank and duplicate rows are
    deleted; what else happens is the cheapest repair. Conversations of which nothing stays have no rows; an
    empty table has none. Other columns of the input are not read. Edits are K, R and I.
    """

    def emit(found: Iterator) -> Iterator[dict]:
        place = 0
        for begins, head, messages in found:
            place = 0 if begins else place
            for edit, role, text in messages:
                yield {"conv_id": head["conv_id"], "place": place, "edit": edit, "role": role, "text": text}
                place += 1

    def schema(conv: pa.DataType) -> pa.Schema:
        return pa.schema([("conv_id", conv), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    return _repaired(_plain(conversations), chunk_rows, emit, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` modulo 20 gives them: 0 dropped (no copies), 1 emptied,
    2 without ``.!?``, 3 twice, 4 from the user. A null conv_id or turn is one blank in that text."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = _plain(conversations).withColumn("x", F.crc32(key.cast("binary")) % 20)
    return rows.select(
        "conv_id", F.when(F.col("x") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("x") == 0, "").when(F.col("x") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("x").isin(0, 1), "").when(F.col("x") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("x") == 0, 0).when(F.col("x") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair_digest(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Damages the rows, repairs them, and reports one row a conversation, as the contract of the query names them.

    Nulls, ties and repeated rows as in ``repair_conversations``; every conv_id of the input has a row, with zeros, an
    empty audit and the hash of nothing where no row stayed. gaps stops at the largest long.
    """

    def emit(found: Iterator) -> Iterator[dict]:
        hasher, head, some = None, None, False
        for begins, report, messages in found:
            if begins:
                if head is not None:
                    yield {**{c: head[c] for c in ("conv_id", *_LONGS, "audit")}, "repaired_sha256": hasher.hexdigest()}
                hasher, head, some = hashlib.sha256(), report, False
            for _, role, text in messages:
                hasher.update(f"{'\n' if some else ''}{role}:{text}".encode())
                some = True
        if head is not None:
            yield {**{c: head[c] for c in ("conv_id", *_LONGS, "audit")}, "repaired_sha256": hasher.hexdigest()}

    def schema(conv: pa.DataType) -> pa.Schema:
        return pa.schema([("conv_id", conv), *((c, pa.int64()) for c in _LONGS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    return _repaired(damaged(conversations), chunk_rows, emit, schema)


#: The DP without insertions, which never pay (see INSERTS); crc32 byte by byte.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
   lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 1, 1, 1, 1, 1, 1, 1]), lambda x, i: xor(x // 2, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), 4294967295) % 20 AS x FROM conversations),
a AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE WHEN x = 1 THEN '' WHEN x = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN x = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE x <> 0),
o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen, regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM o),
r AS (SELECT conv_id, turn, role, text, n, left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
s(conv_id, n, q, best) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': ''} FROM conversations
 UNION ALL SELECT conv_id, n, q, min(best) FROM (
  SELECT s.conv_id, r.n, CASE e WHEN 'D' THEN s.q WHEN 'K' THEN CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN s.q = 2 THEN 3 ELSE 2 END END AS q,
   {'cost': s.best.cost + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 't' THEN 5 ELSE 0 END, 'audit': s.best.audit || e} AS best
  FROM s JOIN r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = s.n + 1 CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS edits(e)
  WHERE e = 'D' OR fault NOT IN ('b', 'd') AND (e = 'R' OR (left(role, 1) = 's' AND s.q = 0) OR (left(role, 1) = 'u' AND s.q <> 2) OR (left(role, 1) = 'a' AND s.q = 2))) AS edges GROUP BY conv_id, n, q),
h AS (SELECT conv_id, count(n) AS rows, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate,
 count_if(fault = 't') AS truncated, count_if(coalesce(illegal, false)) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
b AS (SELECT h.conv_id, min(s.best) AS best FROM h JOIN s ON s.conv_id = h.conv_id AND s.n = h.rows AND s.q IN (0, 3) GROUP BY h.conv_id),
k AS (SELECT r.*, best.audit[CAST(r.n AS INT)] AS e, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS j, first_value(left(role, 1) = 's' AND best.audit[CAST(r.n AS INT)] = 'K') OVER (PARTITION BY conv_id ORDER BY n) AS s
 FROM r JOIN b USING (conv_id) WHERE best.audit[CAST(r.n AS INT)] <> 'D'),
t AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (j - CAST(s AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY n)) AS hash FROM k GROUP BY conv_id)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated, CAST(illegal AS BIGINT) AS illegal,
 best.cost AS cost, best.audit AS audit, coalesce(hash, sha256('')) AS repaired_sha256 FROM h JOIN b USING (conv_id) LEFT JOIN t USING (conv_id)
"""
