"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words joined by blanks, with a line feed as end. Each
byte is coded as eight binary decisions; each decision has its own context tree over the
preceding bytes, and a node mixes its Krichevsky-Trofimov estimate with the product
of its branches, at every depth, with the weights that the training texts give. Every
context that occurs is a node: nothing is pruned, and the tree grows with the corpus.

Texts are read in chunks. A chunk sends its different words and byte grams, each once, to
their buckets; there the counts of all chunks meet. A bucket holds whole subtrees below
contexts of two bytes and weights them from the leaves up; what the buckets say about
contexts of one byte (at most 256 times 255 decisions) is summed by Spark and weighted in
the driver. Then each bucket returns to each chunk the values of what that chunk sent,
and the chunk's texts add them up. A frequent word or gram is one entry a chunk, so
no key is hot, and a bucket's memory follows its different entries only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, text_chunks
from .labelled import fold

DEPTH = 5
FOLDS, HELD_OUT = 10, 0
_ROOT = 2  # bytes of context that name a subtree, which lies whole in one bucket
_END = b"\n"
_COUNTS, _WORDS, _GRAMS, _TEXTS = 0, 1, 2, 3
_CHUNK = 16 << 20  # bytes of text whose words and grams are sent together
_STEP = 2 << 20  # bytes of text that are coded at once
_BUCKET = 8 << 20  # bytes of the corpus for each bucket
_ROW = "bucket int, kind int, chunk long, slot int, distinct long, total long, payload binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_TYPES = {c: _ARROW[t] for c, t in (x.split() for x in _ROW.split(", "))}


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after six steps of the recurrence; x > 0."""
    y = x + 6
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


_SMALL = 4096
_HALF = _log_gamma(np.arange(_SMALL) + 0.5)
_WHOLE = _log_gamma(np.arange(_SMALL) + 1.0)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts; small counts are looked up."""
    n = zeros + ones
    at = np.minimum(n, _SMALL - 1).astype(np.int64)
    a, b = np.minimum(zeros, at).astype(np.int64), np.minimum(ones, at).astype(np.int64)
    out = _HALF[a] + _HALF[b] - _WHOLE[at] - math.log(math.pi)
    out[n == 0] = 0.0
    big = n >= _SMALL
    if big.any():
        out[big] = _log_gamma(zeros[big] + 0.5) + _log_gamma(ones[big] + 0.5) - _log_gamma(n[big] + 1.0) - math.log(math.pi)
    return out


def _mix(here: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the share of it that a node's own estimate has."""
    both = np.logaddexp(here, below) - math.log(2)
    return both, np.exp(here - math.log(2) - both)


def _own(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


class Subtrees:
    """All nodes of ``_ROOT`` and more bytes above the grams of a bucket: ``codes`` sorted and different, ``n`` their counts.

    A code holds the byte before the coded one highest, then the one before that, .. and the coded byte lowest.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int):
        self.codes, self.n, self.depth = codes, n, depth

    def _up(self, bit: int):
        """Per depth from the deepest (zeros, ones, own share, index of the parent of each), then keys and logs at ``_ROOT``."""
        symbol = self.codes & 255
        at, key = pd.factorize(self.codes >> 8 << bit | symbol >> (8 - bit))
        ones = np.bincount(at, self.n * (symbol >> (7 - bit) & 1), len(key))
        zeros = np.bincount(at, self.n, len(key)) - ones
        log, share, steps = _log_kt(zeros, ones), np.ones(len(key)), []
        for _ in range(self.depth - _ROOT):
            parent, above = pd.factorize(key >> (bit + 8) << bit | key & ((1 << bit) - 1))
            steps.append((zeros, ones, share, parent))
            zeros, ones = np.bincount(parent, zeros, len(above)), np.bincount(parent, ones, len(above))
            log, share = _mix(_log_kt(zeros, ones), np.bincount(parent, log, len(above)))
            key = above
        steps.append((zeros, ones, share, None))
        return at, steps, key, log

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """(decisions of contexts one byte shorter than the roots, [zeros, ones, sum of the logs of their branches])."""
        keys, rows = [], []
        for bit in range(8):
            _, steps, key, log = self._up(bit)
            zeros, ones = steps[-1][:2]
            above = key >> (bit + 8) << 8 | 1 << bit | key & ((1 << bit) - 1)
            at, k = pd.factorize(above)
            keys.append(k)
            rows.append(np.stack([np.bincount(at, x, len(k)) for x in (zeros, ones, log)], 1))
        return np.concatenate(keys), np.concatenate(rows)

    def values(self, so_far: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of the mixture over all depths for each code, given the mixture and the share left above the roots."""
        out = np.zeros(len(self.codes))
        for bit in range(8):
            at, steps, key, _ = self._up(bit)
            above = key >> (bit + 8) << 8 | 1 << bit | key & ((1 << bit) - 1)
            p, rest = so_far[above], left[above]
            for zeros, ones, share, parent in reversed(steps):
                if parent is not None:
                    p, rest = p[parent], rest[parent]
                p, rest = p + rest * share * _own(zeros, ones), rest * (1.0 - share)
            p, one = p[at], (self.codes >> (7 - bit) & 1).astype(bool)
            out += np.log10(np.where(one, p, 1.0 - p))
        return out


def weigh_top(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixture and share left after the contexts of no and of one byte, for each of 256 x 256 decisions."""
    zeros, ones, below = np.zeros((3, 256 * 256))
    zeros[keys], ones[keys], below[keys] = rows.T
    log, share = _mix(_log_kt(zeros, ones), below)
    all_zeros, all_ones, all_below = (x.reshape(256, 256).sum(0) for x in (zeros, ones, log))
    _, top = _mix(_log_kt(all_zeros, all_ones), all_below)
    so_far, left = np.tile(top * _own(all_zeros, all_ones), 256), np.tile(1.0 - top, 256)
    return so_far + left * share * _own(zeros, ones), left * (1.0 - share)


def _grams(texts: list[bytes], depth: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, index of the text) of every byte, some at a time; line feeds stand before a text."""
    pad = _END * depth
    flat = np.frombuffer(pad + pad.join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for lo in range(0, int(ends[-1]) if len(ends) else 0, step):
        hi = min(lo + step, int(ends[-1]))
        first, last = np.searchsorted(ends, [lo, hi - 1], "right")
        inside = np.diff(np.clip(np.r_[ends[first : last + 1]], lo, hi), prepend=lo)
        of = np.repeat(np.arange(first, last + 1), inside)
        at = np.arange(lo, hi) + (of + 1) * depth
        code = flat[at].astype(np.int64)
        for j in range(1, depth + 1):
            code |= flat[at - j].astype(np.int64) << (8 * (depth - j + 1))
        yield code, of


def _words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in order, and how many each text has."""
    split = [(t or "").encode().lower().split() for t in texts]
    return [w for ws in split for w in ws], np.array([len(ws) for ws in split], np.int64)


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of each word among the different ones, 64-bit hash of each different word)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64).view(np.int64)
    return coded.indices.to_numpy().astype(np.int64), hashes


def _canonical(words: list[bytes], sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [b" ".join(words[a:b]) + _END for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class _Held:
    """Counts by key that are added up whenever they have doubled."""

    def __init__(self):
        self.parts, self.size, self.settled = [], 0, 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n.astype(np.int64)))
        self.size += len(key)
        if self.size > 2 * self.settled + 500_000:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self.parts = [_add_up(self.parts)]
            self.size = self.settled = len(self.parts[0][0])
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _pack(key: np.ndarray, value: np.ndarray) -> bytes:
    """Sorted keys as differences, then values, each byte by byte, which compresses well."""
    return zstandard.compress(_planes(np.diff(key, prepend=0)) + _planes(value), 1)


def _unpack(packed: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw, size = np.frombuffer(zstandard.decompress(packed), np.uint8), np.dtype(kind).itemsize
    n = len(raw) // (8 + size)
    key = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<i8").ravel().cumsum()
    return key, np.ascontiguousarray(raw[8 * n :].reshape(size, n).T).view(kind).ravel()


def _pack_texts(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _rows(**columns) -> pa.RecordBatch:
    k = max(len(c) for c in columns.values())
    given = {c: x if isinstance(x, pa.Array) else pa.array(x, _TYPES[c]) for c, x in columns.items()}
    return pa.record_batch([given.get(c, pa.nulls(k, t)) for c, t in _TYPES.items()], list(_TYPES))


def _bucket_of(kind: int, key: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    if kind == _GRAMS:  # by the root of the subtree
        key = key >> (8 * (depth - _ROOT) + 8)
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def send_chunks(docs: DataFrame, buckets: int, depth: int, chunk_bytes: int, step: int) -> DataFrame:
    """Rows of packed texts by chunk, ``total`` telling how many are training texts; for each chunk, kind and bucket a row with the words or grams, and their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        held = {_WORDS: _Held(), _GRAMS: _Held()}

        def settle() -> Iterator[pa.RecordBatch]:
            for kind, h in held.items():
                key, n = h.total()
                bucket = _bucket_of(kind, key, buckets, depth)
                order = np.argsort(bucket, kind="stable")
                key, n, bucket = key[order], n[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                packed = [_pack(key[a:b], n[a:b].astype("<u4")) for a, b in zip(cuts, [*cuts[1:], len(key)])]
                yield _rows(bucket=bucket[cuts], kind=np.full(len(cuts), kind), chunk=np.full(len(cuts), chunk), payload=packed)
                held[kind] = _Held()

        for b in text_chunks(batches, "text", step):
            words, sizes = _words(b.column("text").to_pylist())
            train = ~b.column("held_out").to_numpy(zero_copy_only=False)
            texts = _canonical(words, sizes)
            at, hashes = _hashes(words)
            held[_WORDS].add(hashes, np.bincount(at, np.repeat(train, sizes), len(hashes)))
            for code, of in _grams(texts, depth, step):
                found, different = pd.factorize(code)
                held[_GRAMS].add(different, np.bincount(found, train[of], len(different)))
            piece = pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(sizes + 1), pa.array(texts, pa.large_binary())], ["doc_id", "held_out", "n_tokens", "text"])
            yield _rows(kind=[_TEXTS], chunk=[chunk], total=[int(train.sum())], payload=[_pack_texts(piece)])
            size += sum(map(len, texts))
            if size >= chunk_bytes:
                yield from settle()
                chunk, size = chunk + 1, 0
        if size:
            yield from settle()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(FOLDS) == HELD_OUT).alias("held_out"))
    return keyed.mapInArrow(run, _ROW)


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "chunk", "slot", "payload")))


def count_buckets(sent: DataFrame, buckets: int, depth: int) -> DataFrame:
    """For each bucket and kind one row of kind ``_COUNTS``, ``slot`` telling which, with all keys and their counts.

    For words ``distinct`` holds how many occur in training texts and ``total`` how often. Rows
    of kind ``_GRAMS`` hold what the bucket adds to the contexts of one byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, _Held()

        def settle() -> Iterator[pa.RecordBatch]:
            bucket, kind = current
            key, n = held.total()
            one = {"bucket": [bucket], "kind": [_COUNTS], "slot": [kind], "payload": [_pack(key, n.astype("<i8"))]}
            if kind == _WORDS:
                yield _rows(**one, distinct=[int((n > 0).sum())], total=[int(n.sum())])
            else:
                yield _rows(**one)
                keys, rows = Subtrees(key, n, depth).roots()
                yield _rows(kind=np.full(len(keys), _GRAMS), slot=keys, payload=[r.tobytes() for r in rows])

        for bucket, kind, _, _, packed in _packed_rows(batches):
            if (bucket, kind) != current:
                if current:
                    yield from settle()
                current, held = (bucket, kind), _Held()
            held.add(*_unpack(packed, "<u4"))
        if current:
            yield from settle()

    return sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, _ROW)


def lm_scores(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = _CHUNK, step: int = _STEP) -> DataFrame:
    """One row per row of docs(doc_id, text, ..): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Trained on the documents outside the held-out fold. ``score`` is the log10 probability of
    the lower-cased words with single blanks and an end; base_score that of the smoothed word
    counts; bits_per_byte the code length of what is scored, its end included, in bits for each of its bytes. Null and blank texts have the end alone. A null doc_id is in the fold of the
    empty text; repeated rows each count and get equal scores; an empty table gives no rows.
    Texts are coded ``step`` bytes at a time, so that very long ones need no more memory than they have bytes. Other columns are ignored, whatever their names.
    """
    if not _ROOT < depth <= 6:
        raise ValueError("depth must be 3 to 6")
    spark = docs.sparkSession
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(shuffle_width(spark), n_bytes // _BUCKET)
    sent = materialize(send_chunks(docs, buckets, depth, chunk_bytes, step), "sent", "kind")
    postings, texts = sent.where(F.col("kind") != _TEXTS), sent.where(F.col("kind") == _TEXTS)
    counts = materialize(count_buckets(postings.select(*_TYPES), buckets, depth), "counts", "kind")
    n_docs, n_chunks = texts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count_distinct("chunk")).first()
    merged = counts.where(F.col("kind") == _COUNTS)
    of_words = merged.where(F.col("slot") == _WORDS)
    total, distinct = of_words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n_train, vocabulary = total + n_docs, distinct + (n_docs > 0)
    scale, end = math.log10(n_train + 0.1 * (vocabulary + 1)), math.log10(n_docs + 0.1)
    top = _sum_tops(counts.where(F.col("kind") == _GRAMS)).toPandas()
    above = spark.sparkContext.broadcast(weigh_top(top["slot"].to_numpy(), top[["zeros", "ones", "below"]].to_numpy(float)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a bucket come first, its words, then its grams; then what each chunk sent gets its values."""
        current, known = None, {}
        for bucket, kind, chunk, slot, packed in _packed_rows(batches):
            if bucket != current:
                current, known = bucket, {}
            if kind == _COUNTS:
                key, n = _unpack(packed, "<i8")
                known[slot] = (key, n if slot == _WORDS else Subtrees(key, n, depth).values(*above.value).astype("<f4"))
                continue
            key, _ = _unpack(packed, "<u4")
            all_keys, value = known[kind]
            yield _rows(kind=[kind], chunk=[chunk], payload=[_pack(key, value[np.searchsorted(all_keys, key)])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Values of a chunk come first, then its texts."""
        current, got, tables = None, {}, None
        for b in batches:
            kinds, chunks = b.column("kind").to_numpy(), b.column("chunk").to_numpy()
            for lo, hi in _runs(kinds, chunks):
                part = b.slice(lo, hi - lo)
                if chunks[lo] != current:
                    current, got, tables = chunks[lo], {_WORDS: [], _GRAMS: []}, None
                if kinds[lo] != _TEXTS:
                    got[kinds[lo]] += [_unpack(p, "<i8" if kinds[lo] == _WORDS else "<f4") for p in part.column("payload").to_pylist()]
                    continue
                if tables is None:
                    tables, got = {k: _sorted_table(v) for k, v in got.items()}, {}
                for p in part.column("payload"):
                    yield score(pa.ipc.open_stream(p.as_buffer()).read_next_batch(), tables)

    def score(b: pa.RecordBatch, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        texts, rows = b.column("text").to_pylist(), b.num_rows
        split = [t.split() for t in texts]
        at, hashes = _hashes([w for ws in split for w in ws])
        key, value = tables[_WORDS]
        c = value[np.searchsorted(key, hashes)][at]
        of = np.repeat(np.arange(rows), [len(ws) for ws in split])
        n_tokens = b.column("n_tokens").to_numpy()
        known = np.bincount(of, c > 0, rows).astype(np.int64) + (n_docs > 0)
        base = np.bincount(of, np.log10(c + 0.1), rows) + end - n_tokens * scale
        model, (key, value) = np.zeros(rows), tables[_GRAMS]
        for code, of in _grams(texts, depth, step):
            found, different = pd.factorize(code)
            model += np.bincount(of, value[np.searchsorted(key, different)][found], rows)
        return pa.record_batch({
            "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "n_tokens": b.column("n_tokens"), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(rows, n_train)), "base_score": pa.array(base), "score": pa.array(model),
            "bits_per_byte": pa.array(model * -np.log2(10) / np.array([len(t) for t in texts])),
        })

    asked = merged.select(*_TYPES).unionByName(postings.select(*_TYPES))
    values = asked.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, _ROW)
    return values.unionByName(texts.select(*_TYPES)).repartition(max(1, n_chunks), "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(finish, _SCORES)


def _sum_tops(rows: DataFrame) -> DataFrame:
    """(slot, zeros, ones, below): at most 256 x 255 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("payload").to_pylist()), "<f8").reshape(-1, 3)
            yield pa.record_batch([b.column("slot"), *(pa.array(c) for c in x.T.copy())], ["slot", "zeros", "ones", "below"])

    split = rows.select("slot", "payload").mapInArrow(run, "slot int, zeros double, ones double, below double")
    return split.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])


def _runs(kinds: np.ndarray, chunks: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(kinds):
        cuts = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (chunks[1:] != chunks[:-1])])
        yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(kinds)])


def _sorted_table(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, value = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(key)
    return key[order], value[order]
