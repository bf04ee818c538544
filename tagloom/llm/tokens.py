"""Token-ID encoding and flat binary token files.

Documents are dealt into shards by ranges of doc_id. A shard is three flat
files in one folder of shared storage: ``<shard>.ids`` (unsigned little-endian ids of 16
or 32 bits, as the vocabulary needs), ``<shard>.off`` (unsigned 64-bit offsets,
one more than documents, in ids) and ``<shard>.doc`` (signed 64-bit doc_ids). All
are read by memory mapping. The first id of a shard within the whole corpus is the prefix
sum of the shards before it; only one row a shard passes through the driver.
"""

from __future__ import annotations

import json
import os
import re
import string
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_width, text_chunks

_ENCODERS: dict[str, "UnitEncoder"] = {}
_MARKS = string.punctuation
_MARK_SET = frozenset(_MARKS)
_LATIN_END = "\u0250"  # letters before it are letters in every version of Unicode
_SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}\x{180e}]"
_BETWEEN = f"{_SPACE} {_SPACE}"
_PLAIN_UNIT = re.compile(r" \S(?:.*\S)?", re.S).fullmatch


class UnitEncoder:
    """Encodes texts with the tokenizers library, each distinct unit once.

    A unit is a blank with the run of other characters after it. A byte-level
    pre-tokenizer never joins two units unless white space stands on both sides
    of the blank; such texts, texts with special tokens and all texts of other kinds of
    tokenizers are encoded whole. Two generations of at most ``cache`` units each bound memory.
    """

    def __init__(self, path: str, cache: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.width = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token)
        self.cache, self.young, self.old = cache, {}, {}
        self.sentence_end: np.ndarray | None = None  # filled by the packer

    @classmethod
    def of(cls, path: str) -> "UnitEncoder":
        """The worker's encoder: loaded once in each Python process."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Many units make one call; token widths in bytes tell where each unit ends."""
        out: list[bytes | None] = [None] * len(units)
        clean = [i for i, x in enumerate(map(_PLAIN_UNIT, units)) if x]
        size = self.dtype.itemsize
        for lo in range(0, len(clean), 1024):
            part = clean[lo : lo + 1024]
            joined = [units[i] for i in part]
            ids = np.array(self.tokenizer.encode("".join(joined), add_special_tokens=False).ids, self.dtype)
            ends = np.cumsum(self.width[ids])
            want = np.cumsum(pc.binary_length(pa.array(joined)).to_numpy(), dtype=np.int64)
            cut = np.minimum(np.searchsorted(ends, want), len(ids) - 1)
            if np.array_equal(ends[cut], want):
                blob, last = ids.tobytes(), 0
                for i, c in zip(part, ((cut + 1) * size).tolist()):
                    out[i] = blob[last:c]
                    last = c
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._plain([units[i] for i in rest])):
            out[i] = x
        return out

    def _look_up(self, units: list[str]) -> list[bytes]:
        """The marks behind a letter are encoded apart anyhow, so a unit that ends in marks is its stem and its tail."""
        young, old = self.young, self.old
        found = list(map(young.get, units))
        missing = [i for i, x in enumerate(found) if x is None]
        parts: dict[int, tuple[str, str]] = {}
        new: dict[str, None] = {}
        for i in missing:
            u = units[i]
            if (x := old.get(u)) is not None:
                found[i] = x
                continue
            new[u] = None
            if u[-1:] in _MARK_SET and self.by_unit:
                stem = u.rstrip(_MARKS)
                if (last := stem[-1:]).isalpha() and last < _LATIN_END:
                    del new[u]
                    parts[i] = stem, (tail := u[len(stem) :])
                    if stem not in young and stem not in old:
                        new[stem] = None
                    if tail not in young and tail not in old:
                        new[tail] = None
        young.update(zip(new, self._encode_units(list(new))))
        for i, (stem, tail) in parts.items():
            found[i] = young[units[i]] = (young.get(stem) or old[stem]) + (young.get(tail) or old[tail])
        for i in missing:
            if found[i] is None:
                found[i] = young[units[i]]
        if len(young) > self.cache:
            self.young, self.old = {}, young
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text, one more than texts)."""
        if not texts:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        if self.by_unit:
            plain = pc.invert(pc.match_substring_regex(pa.array(texts, pa.large_string()), _BETWEEN)).to_pylist()
            whole = [i for i, t in enumerate(texts) if not plain[i] or any(x in t for x in self.special)]
        else:
            whole = list(range(len(texts)))
        odd = dict(zip(whole, self._plain([texts[i] for i in whole])))
        split = pc.split_pattern(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string()), " ")
        starts = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        unit = coded.indices.to_numpy().astype(np.int64)
        firsts = coded.dictionary.take(pa.array(unit[starts[:-1]])).to_pylist()
        led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
        pieces = led.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        unit[starts[:-1]] = len(pieces) + np.arange(len(texts))
        values = self._look_up(pieces) + self._look_up(firsts)
        for i, x in odd.items():
            values[len(pieces) + i] = x
        ids = np.frombuffer(b"".join(values), self.dtype)
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        of_unit = size[unit]
        ends = np.cumsum(of_unit)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        move = ((np.cumsum(size) - size)[unit] - (ends - of_unit)).astype(kind)
        out = ids[np.repeat(move, of_unit) + np.arange(ends[-1], dtype=kind)]
        return out, np.r_[0, ends][starts].astype(np.int64)


def encode_with_end(encoder: UnitEncoder, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode``, with id ``end`` after each text; null is the empty text."""
    ids, off = encoder.encode([t or "" for t in texts])
    full = np.full(len(ids) + len(texts), end, "<u4")
    mask = np.ones(len(full), bool)
    off = off + np.arange(len(off))
    mask[off[1:] - 1] = False
    full[mask] = ids
    return full, off


def in_id_order(docs: DataFrame, shards: int, least: int = 0) -> DataFrame:
    """Deal docs(doc_id, text) into shards by doc_id ranges, sorted inside each; adds ``shard``.

    The bounds are quantiles of doc_id; there are fewer than ``shards`` if a shard would have under ``least``
    bytes of text. Null ids come first. Rows of one id, or of none, stand together in order of their
    text; where they fill several shards, they are dealt over these by the text's hash.
    """
    at = [i / shards for i in range(1, shards)]
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = F.percentile_approx("doc_id", at, 100_000) if at else F.lit(None).cast("array<bigint>")
    size = F.sum(F.octet_length("text")) if least else F.lit(None).cast("long")
    found = known.agg(marks.alias("q"), size.alias("size"), F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    wanted = min(shards, max(1, (found["size"] or 0) // least)) if least else shards
    quantiles = found["q"] or []
    bounds = [quantiles[i * shards // wanted - 1] for i in range(1, wanted)] if quantiles else []
    nameless = max(1, round(wanted * (found["n"] - found["named"]) / max(1, found["n"])))
    shard = _shard_of(F.col("doc_id"), F.xxhash64("text"), bounds, nameless)
    keyed = known.withColumn("shard", shard)
    return keyed.repartitionById(nameless + len(bounds), "shard").sortWithinPartitions("shard", "doc_id", "text")


def _shard_of(c: Column, text: Column, bounds: list[int], nameless: int) -> Column:
    """Null ids have the first ``nameless`` shards, the last of which is also that of ids up to the first bound.

    Native binary search over constants, as a balanced tree of comparisons; an id that is a bound several
    times has as many shards.
    """
    distinct = sorted(set(bounds))
    base = [nameless - 1 + bisect_left(bounds, b) for b in distinct] + [nameless - 1 + len(bounds)]

    def leaf(i: int) -> Column:
        times = bounds.count(distinct[i]) if i < len(distinct) else 1
        first = F.lit(base[i])
        return first if times == 1 else F.when(c == F.lit(distinct[i]), first + F.pmod(text, F.lit(times)).cast("int")).otherwise(first)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(c > F.lit(distinct[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(c.isNull(), F.pmod(text, F.lit(nameless)).cast("int")).otherwise(tree(0, len(distinct)))


def local_path(uri: str) -> str:
    """The mounted path of a shared folder; memory mapping needs one."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"token files need a shared folder that is mounted, not {uri}")
    return parsed.path


def write_token_files(
    docs: DataFrame, out_dir: str, tokenizer_path: str, end: int = 0, shards: int | None = None
) -> list[tuple[int, int, int, int]]:
    """Encode docs(doc_id, text, ..) into token files under ``out_dir``.

    Every text gets id ``end`` behind it; a null text is empty. Returns one tuple
    a shard: (shard, documents, ids, ids of all shards before). A file is renamed into
    place when complete, so a retried task repeats it without harm. An empty table makes
    no shard. Null doc_ids stand first and are written as the smallest long.
    """
    root = local_path(out_dir)
    shards = shards or shuffle_width(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of(tokenizer_path)
        os.makedirs(root, exist_ok=True)
        shard, files, temp, total, docs_n = None, {}, "", 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            if shard is None:
                return
            for kind, f in files.items():
                f.close()
                os.replace(f"{temp}.{kind}", f"{root}/{shard:06d}.{kind}")
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "docs": pa.array([docs_n]), "ids": pa.array([total])})

        for b in text_chunks(batches, "text"):
            of = b.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for lo, hi in zip(cuts, [*cuts[1:], len(of)]):
                if of[lo] != shard:
                    yield from close()
                    shard, total, docs_n, temp = int(of[lo]), 0, 0, f"{root}/.{uuid.uuid4().hex}"
                    files = {kind: open(f"{temp}.{kind}", "wb") for kind in ("ids", "off", "doc")}
                    files["off"].write(np.zeros(1, "<u8").tobytes())
                part = b.slice(lo, hi - lo)
                ids, off = encode_with_end(encoder, part.column("text").to_pylist(), end)
                files["ids"].write(ids.astype(encoder.dtype).tobytes())
                files["off"].write((off[1:] + total).astype("<u8").tobytes())
                files["doc"].write(part.column("doc_id").fill_null(-(1 << 63)).to_numpy().astype("<i8").tobytes())
                total, docs_n = total + int(off[-1]), docs_n + part.num_rows
        yield from close()

    done = sorted(in_id_order(docs, shards).mapInArrow(run, "shard int, docs long, ids long").collect())
    bases = [0, *accumulate(r.ids for r in done)]
    return [(r.shard, r.docs, r.ids, base) for r, base in zip(done, bases)]


def read_token_files(spark: SparkSession, out_dir: str, shards: list[tuple[int, int, int, int]], tokenizer_path: str) -> DataFrame:
    """One row a document, from the memory-mapped files: doc_id, start, n_tokens, ids_crc32."""
    root = local_path(out_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = UnitEncoder.of(tokenizer_path).dtype
        for b in batches:
            for shard, docs, base in zip(*(b.column(c).to_pylist() for c in ("shard", "docs", "base"))):
                ids = np.memmap(f"{root}/{shard:06d}.ids", dtype, "r")
                off = np.memmap(f"{root}/{shard:06d}.off", "<u8", "r")
                doc = np.memmap(f"{root}/{shard:06d}.doc", "<i8", "r")
                for lo in range(0, docs, 4096):
                    o = off[lo : min(lo + 4096, docs) + 1].astype(np.int64)
                    flat = ids[o[0] : o[-1]].astype("<u4")
                    crc = [zlib.crc32(flat[s:e]) for s, e in zip((o[:-1] - o[0]).tolist(), (o[1:] - o[0]).tolist())]
                    name = np.array(doc[lo : lo + len(crc)])
                    yield pa.record_batch({
                        "doc_id": pa.array(name, pa.int64(), mask=name == -(1 << 63)),
                        "start": pa.array(o[:-1] + base), "n_tokens": pa.array(np.diff(o)), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    listed = spark.createDataFrame([(s, n, base) for s, n, _, base in shards], "shard int, docs long, base long")
    return listed.repartition(max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end: int = 0) -> DataFrame:
    """Write token files to the shared folder and read their digest back.

    One row per row of docs(doc_id, text, ..): doc_id, start (ids of all documents
    before it in ascending doc_id order), n_tokens with the end id, ids_crc32.
    """
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}/tokens"
    return read_token_files(spark, out, write_token_files(docs, out, tokenizer_path, end), tokenizer_path)
