"""Removal of byte strings that stand in the corpus more than once, by suffix sorting.

Whether the 200 bytes from a place recur is settled in two steps. First every such
window is named by the smallest hash of its 100-byte grams, so equal windows have one
name, and neighbouring windows with one name and place of it form a run. A name that occurs once has no
repeated window; runs equal as a whole are repeated throughout. Only runs that share a
name but differ are left: the edges of repeats. Their windows contain 150 common bytes
next to the gram (50 on its left, or else on its right), which become one symbol. For each batch
of such groups the symbols' suffixes are sorted, and breadth-first backward
extension on the Burrows-Wheeler transform derives the common prefixes by
increasing value and stops at the window's length: boundaries that are not reached part suffixes
with at least that much in common.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_chunks

_BASE = 0x9E3779B97F4A7C15
_TILE = 1 << 20
_HOLD = 1 << 20
_BATCH = 1_500_000
#: Rows of a group that are sorted together; larger groups are divided.
_GROUP = 10_000
_EDGE = ["g", "core", "ref", "at", "open", "a", "b"]
_EDGE_SCHEMA = "g long, core long, ref long, at long, open boolean, a binary, b binary"
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def runs(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, hash of all bytes, first window, windows, place of the naming gram) for each run of a text's windows.

    A gram has half the window's bytes; of equal smallest hashes the last one names.
    """
    out = []
    for lo in range(0, len(text) - length + 1, _TILE):
        part = text[lo : lo + _TILE + length - 1]
        n, gram = len(part), length // 2
        width = length - gram + 1
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * inverse[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * power[: n - gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        rows = -(-len(h) // width)
        block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        block[: len(h)] = h
        block = block.reshape(rows, width)
        place = np.arange(rows * width, dtype=np.int64).reshape(rows, width)
        fore = np.minimum.accumulate(block, 1)
        fore_at = np.maximum.accumulate(np.where(block == fore, place, -1), 1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1]
        fresh = np.ones(block.shape, bool)
        fresh[:, :-1] = block[:, :-1] < back[:, 1:]
        back_at = np.minimum.accumulate(np.where(fresh, place, rows * width)[:, ::-1], 1)[:, ::-1].ravel()
        fore, back = fore.ravel(), back.ravel()
        windows = n - length + 1
        right, left = fore[width - 1 : width - 1 + windows], back[:windows]
        last = right <= left
        name = np.where(last, right, left)
        at = np.where(last, fore_at[width - 1 : width - 1 + windows], back_at[:windows])
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        end = np.r_[first[1:], windows]
        whole = (sums[end - 1 + length] - sums[first]) * power[first]
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + (end - first).astype(np.uint64)
        out.append((name[first].view(np.int64), whole.view(np.int64), first + lo, end - first, at[first] + lo))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def sort_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rotations in the order of their first ``depth`` symbols, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.uint64)
    order, done = np.argsort(rank, kind="stable"), 1
    while done < depth:
        pair = rank * np.uint64(n + 1) + np.roll(rank, -(done % n))
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        step = np.r_[False, ordered[1:] != ordered[:-1]]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(step).astype(np.uint64)
        done *= 2
        if step.sum() == n - 1:
            break
    return order


def long_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each boundary between sorted suffixes, and both ends, whether ``least`` symbols are common.

    Interval expansion on the Burrows-Wheeler transform: an interval of suffixes that
    begin with one string is extended backward by every symbol before it; a right
    boundary met for the first time at strings of v + 1 symbols has common prefix v.
    """
    n = len(symbols)
    before = symbols[order - 1]
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    kinds = int(symbols.max()) + 1
    unmet = np.ones(n + 1, bool)
    unmet[[0, n]] = False
    low, width = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(least):
        single = width == 1
        lows, widths = [step[low[single]]], [width[single]]
        low, width = low[~single], width[~single]
        if len(low):
            ends = np.cumsum(width)
            of = np.repeat(np.arange(len(low)), width)
            at = np.repeat(low - (ends - width), width) + np.arange(ends[-1])
            _, first, count = np.unique(of * kinds + before[at], return_index=True, return_counts=True)
            lows.append(step[at[first]])
            widths.append(count)
        low, width = np.concatenate(lows), np.concatenate(widths)
        new = unmet[low + width]
        low, width = low[new], width[new]
        unmet[low + width] = False
        if not len(low):
            break
    return unmet


def _repeated(lefts: list[bytes], cores: np.ndarray, rights: list[bytes], least: int) -> list[np.ndarray]:
    """For each piece left + core + right: whether its strings of ``least`` symbols stand in another place too."""
    size = np.array([len(a) + len(b) + 2 for a, b in zip(lefts, rights)], np.int64)
    text = np.frombuffer(b"".join(x for a, b in zip(lefts, rights) for x in (a, b"\0", b, b"\0")), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(size)
    starts = ends - size
    text[starts + np.array([len(a) for a in lefts], np.int64)] = 257 + np.unique(cores, return_inverse=True)[1]
    text[ends - 1] = 0
    order = sort_suffixes(text, least)
    joined = long_prefixes(text, order, least)
    repeated = np.empty(len(text), bool)
    repeated[order] = joined[:-1] | joined[1:]
    return [repeated[s : e - least] for s, e in zip(starts.tolist(), ends.tolist())]


def _row_key():
    return F.xxhash64("doc_id", "text")


def _naming_runs(docs: DataFrame, length: int) -> DataFrame:
    """Rows (name, whole, ref, at, n, gram, m). Of runs that are equal within a task one goes on, with their number m; the others are settled: m = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            name, whole, at, n, gram, ref = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((whole, name))
            name, whole, at, n, gram, ref = (x[order] for x in (name, whole, at, n, gram, ref))
            first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (whole[1:] != whole[:-1])])
            m = np.zeros(len(name), np.int32)
            m[first] = np.diff(np.r_[first, len(name)])
            name = np.where(m == 0, ref + at, name)  # settled rows meet nobody
            for lo in range(0, len(name), 100_000):
                cut = slice(lo, lo + 100_000)
                yield pa.record_batch({
                    "name": pa.array(name[cut]), "whole": pa.array(whole[cut]), "ref": pa.array(ref[cut]), "at": pa.array(at[cut]),
                    "n": pa.array(n[cut].astype(np.int32)), "gram": pa.array((gram - at)[cut].astype(np.int32)), "m": pa.array(m[cut]),
                })

        count = 0
        for b in text_chunks(batches, "text"):
            for ref, text in zip(b.column("ref").to_pylist(), b.column("text").to_pylist()):
                found = runs(np.frombuffer((text or "").encode(), np.uint8), length)
                if len(found[0]):
                    held.append((*found, np.full(len(found[0]), ref)))
                    count += len(found[0])
            if count > _HOLD:
                yield from flush()
                count = 0
        yield from flush()

    return docs.select(_row_key().alias("ref"), "text").mapInArrow(run, "name long, whole long, ref long, at long, n int, gram int, m int")


def _edges(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The runs that are not settled, cut to what their groups do not have in common."""
    gram, half = length // 2, length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            rows = []
            for ref, text, parts in zip(b.column("ref").to_pylist(), b.column("text").to_pylist(), b.column("parts").to_pylist()):
                raw = text.encode()
                for p in parts:
                    at, q, last = p["at"], p["at"] + p["gram"], p["at"] + p["n"] - 1
                    for side, lo, hi, core in ((0, at, min(last, q - half), q - half), (1, max(at, q - half + 1), last, q)):
                        if lo <= hi:
                            common = raw[core : core + gram + half]
                            rows.append((xxhash.xxh64_intdigest(common, side) >> 1, xxhash.xxh64_intdigest(common, 7 + side) >> 1, ref, lo, p["open"], raw[lo:core], raw[core + gram + half : hi + length]))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], _EDGE)

    parts = wanted.groupBy("ref").agg(F.collect_list(F.struct("at", "n", "gram", "open")).alias("parts"))
    texts = docs.select(_row_key().alias("ref"), "text")
    return texts.join(parts, "ref").mapInArrow(run, _EDGE_SCHEMA)


def _split(hot: DataFrame, low: int, high: int, room: int) -> DataFrame:
    """Groups whose windows have ``low`` to ``high`` bytes before the core, cut in two each.

    Equal windows with at most ``mid`` bytes before the core agree in the room - mid bytes behind it, the
    others in the mid + 1 bytes before it; so each half of the windows meets in groups of its own.
    """
    mid = (low + high) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b, g = r["a"], r["b"], r["g"].to_bytes(8, "little", signed=True)
                for side, key, left, right in ((0, b[: room - mid], a[max(0, len(a) - mid) :], b), (1, a[max(0, len(a) - mid - 1) :], a, b[: room - mid - 1])):
                    if len(key) == (mid + 1 if side else room - mid) and len(left) + len(right) >= room:
                        rows.append((xxhash.xxh64_intdigest(g + key, side) >> 1, r["core"], r["ref"], r["at"] + len(a) - len(left), r["open"], left, right, side))
            cols = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [*_EDGE, "side"])

    return hot.select(*_EDGE).mapInArrow(run, f"{_EDGE_SCHEMA}, side int")


def _divide(edges: DataFrame, room: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(groups of at most ``_GROUP`` rows, rows of larger groups whose only window is thus repeated)."""
    small, settled, open_ = [], [], [(materialize(edges, "edges"), 0, room)]
    while open_:
        rows, low, high = open_.pop()
        big = materialize(rows.groupBy("g", "core").count().where(F.col("count") > _GROUP).select("g", "core"), "big")
        if big.isEmpty():
            small.append(rows)
            continue
        small.append(rows.join(big, ["g", "core"], "left_anti").select(*_EDGE))
        hot = rows.join(big, ["g", "core"], "left_semi")
        if low == high:
            settled.append(hot.where("open").select("ref", "at", F.lit(1).alias("n")))
            continue
        halves, mid = materialize(_split(hot, low, high, room), "halves"), (low + high) // 2
        open_ += [(halves.where("side = 0").select(*_EDGE), low, mid), (halves.where("side = 1").select(*_EDGE), mid + 1, high)]
    return small, settled


def _settle(edges: DataFrame, length: int) -> DataFrame:
    """(ref, at, n): stretches of windows of open runs that recur."""
    least = length - (length // 2 + length // 4) + 1
    small, settled = _divide(edges, least - 1)
    edges = reduce(DataFrame.unionByName, small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def settle(rows: pa.Table) -> pa.RecordBatch:
            a, b = rows.column("a").to_pylist(), rows.column("b").to_pylist()
            found = _repeated(a, rows.column("core").to_numpy(), b, least)
            ref, at, open_ = rows.column("ref").to_numpy(), rows.column("at").to_numpy(), rows.column("open").to_pylist()
            refs, ats, ns = [], [], []
            for r, p, o, hit in zip(ref.tolist(), at.tolist(), open_, found):
                if o and hit.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
                    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        refs.append(r)
                        ats.append(p + lo)
                        ns.append(hi - lo)
            return pa.record_batch({"ref": pa.array(refs, pa.int64()), "at": pa.array(ats, pa.int64()), "n": pa.array(ns, pa.int32())})

        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                held.append(b)
                size += b.num_rows * (2 + least) + sum(b.column(c).nbytes for c in ("a", "b"))
                if size > _BATCH:
                    table = pa.Table.from_batches(held)
                    g = table.column("g").to_numpy()
                    whole = int(np.searchsorted(g, g[-1]))  # the last group may go on
                    if whole:
                        yield settle(table.slice(0, whole))
                        held, size = table.slice(whole).to_batches(), 0
        if held:
            yield settle(pa.Table.from_batches(held))

    found = edges.repartition("g").sortWithinPartitions("g").mapInArrow(run, "ref long, at long, n int")
    return reduce(DataFrame.unionByName, settled, found)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with ``kept`` (the bytes of ``text`` that stay), n_bytes, n_removed, n_spans added.

    A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere in the
    corpus, the same document included; strings do not cross documents and are judged
    on the input. Null is the empty text. Rows that repeat a doc_id and text are copies of
    each other. All rows and other columns stay; columns of the added names are replaced.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    by_name, by_whole = Window.partitionBy("name"), Window.partitionBy("name", "whole")
    found = (
        _naming_runs(docs, length)
        .withColumns({"total": F.sum("m").over(by_name), "mixed": F.min("whole").over(by_name) != F.max("whole").over(by_name)})
        .where("m = 0 or total > 1")
        .withColumns({"same": F.sum("m").over(by_whole), "nth": F.row_number().over(by_whole.orderBy("ref", "at"))})
    )
    found = materialize(found.drop("name", "whole"), "runs")
    settled = found.where("m = 0 or same > 1").select("ref", "at", "n")
    wanted = found.where("m > 0 and mixed and nth = 1").select("ref", "at", "n", "gram", (F.col("same") == 1).alias("open"))
    repeats = materialize(settled.unionByName(_settle(_edges(docs, wanted, length), length)), "repeats")
    spans = repeats.groupBy("ref").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    found_name = f"spans_{uuid.uuid4().hex}"  # no column of docs has this name
    keep = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            kept, sizes, removed, counts = [], [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column(found_name).to_pylist()):
                raw = (text or "").encode()
                gone = np.zeros(len(raw) + 1, np.int32)
                for s in spans or ():
                    gone[s["at"]] += 1
                    gone[s["at"] + s["n"] + length - 1] -= 1
                mask = np.cumsum(gone)[:-1] > 0
                kept.append(np.frombuffer(raw, np.uint8)[~mask].tobytes())
                sizes.append(len(raw))
                removed.append(int(mask.sum()))
                counts.append(int((mask & ~np.r_[False, mask[:-1]]).sum()) if len(raw) else 0)
            added = {"kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(counts, pa.int64())}
            yield pa.record_batch({c: b.column(c) for c in keep} | added)

    base = docs.select(*keep)
    joined = base.join(spans, F.xxhash64(base["doc_id"], base["text"]) == spans["ref"], "left").select(*[base[c] for c in keep], spans["spans"].alias(found_name))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return joined.mapInArrow(run, f"{schema}, kept binary, n_bytes long, n_removed long, n_spans long")


def repeats_digest(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and the SHA-256 of the bytes that stay."""
    out = remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
