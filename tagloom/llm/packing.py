"""Order-preserving packing of token streams into fixed windows by dynamic programming.

Documents are laid end to end in doc_id order. Windows may be cut at document
ends (free) and sentence ends (small penalty); only inside a stretch that has neither
within a window's length is every place allowed (larger penalty). The best chain of cuts
minimises padding plus penalties over a whole shard. Padding is linear in the window's
start, so the best start within reach is the head of a monotone queue. The queue is carried
over from piece to piece of the stream, and a cut is emitted once every candidate in the
queue descends from it; so how the stream is cut into batches changes no result. No window
is made short to have a length that is a power of two and so needs no padding.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, text_chunks
from .tokens import UnitEncoder, encode_with_end, in_id_order

SENTENCE_PENALTY = 8
INNER_PENALTY = 48
WINDOW_COST = 16
#: Bytes of text that a shard has at least, so that its last window, which is not full, is a small part of it.
SHARD_BYTES = 4 << 20


class CutChain:
    """The cheapest chain of cuts over a stream of places, with gaps of at most ``window``."""

    def __init__(self, window: int):
        self.window = window
        # places from the last settled cut on: where each is, its rank, and the best cut before it
        self.pos, self.rank, self.back = [0], [0], [0]
        self.queue = deque([0])  # rising places with rising ranks

    def extend(self, places: np.ndarray, penalty: np.ndarray) -> None:
        # a window from place i to place j costs its padding, places[i] + window - places[j], and what the cut at j costs; with
        # rank = cost so far + place, the place of j drops out: rank[j] = the least rank within reach + window + the cut's cost
        n = len(self.pos)
        self.pos += places.tolist()
        self.rank += (penalty + (self.window + WINDOW_COST)).tolist()
        self.back += [0] * len(places)
        pos, rank, back, queue = self.pos, self.rank, self.back, self.queue
        for j, least in enumerate((places - self.window).tolist(), n):
            while pos[queue[0]] < least:
                queue.popleft()
            back[j] = i = queue[0]
            rank[j] = r = rank[i] + rank[j]
            while queue and rank[queue[-1]] >= r:
                queue.pop()
            queue.append(j)

    def _take(self, last: int) -> list[int]:
        """The cuts of the chain up to the place of index ``last``, which becomes the first one."""
        out, j = [], last
        while j:
            out.append(self.pos[j])
            j = self.back[j]
        self.pos, self.rank = self.pos[last:], self.rank[last:]
        self.back = [max(0, i - last) for i in self.back[last:]]
        self.queue = deque(i - last for i in self.queue)
        return out[::-1]

    def settled(self) -> list[int]:
        """New cuts that every way to go on shares."""
        live = [-i for i in self.queue]
        heapify(live)
        while (top := -live[0]) != -max(live):
            heapreplace(live, -self.back[top])
        return self._take(top)

    def finish(self) -> list[int]:
        """All other cuts, if the stream ends at its last place."""
        self.queue = deque()
        return self._take(len(self.pos) - 1)


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the places that end a window, for all places at once, from places[0] = 0 to the last."""
    chain = CutChain(window)
    chain.extend(places[1:], penalty[1:])
    return np.searchsorted(places, chain.finish())


def places_of(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts in the ids of whole documents, with penalties; the last document end is the last one."""
    cost = np.full(len(ids) + 1, -1, np.int8)
    cost[1:][sentence[ids]] = SENTENCE_PENALTY
    cost[doc_ends] = 0
    places = np.flatnonzero(cost >= 0)
    penalty = cost[places].astype(np.int64)
    before = np.r_[0, places[:-1]]
    far = np.flatnonzero(places - before > window)
    if len(far):
        inner = np.concatenate([np.arange(a + 1, b) for a, b in zip(before[far], places[far])])
        order = np.argsort(np.r_[places, inner], kind="stable")
        places, penalty = np.r_[places, inner][order], np.r_[penalty, np.full(len(inner), INNER_PENALTY)][order]
    return places, penalty


def sentence_ends(encoder: UnitEncoder) -> np.ndarray:
    """For each id, whether its token ends a sentence or a line."""
    if encoder.sentence_end is not None:
        return encoder.sentence_end
    size = len(encoder.width)
    texts = [encoder.tokenizer.decode([i], skip_special_tokens=False) for i in range(size)]
    ends = (".", "!", "?", "\n", "。", "！", "？")
    encoder.sentence_end = np.array([t.rstrip(" ").endswith(ends) for t in texts])
    return encoder.sentence_end


class ShardPacker:
    """Packs the documents of one shard, given in order and piece by piece."""

    def __init__(self, shard: int, window: int, sentence: np.ndarray):
        self.shard, self.window, self.sentence = shard, window, sentence
        self.chain, self.sequence, self.done = CutChain(window), 0, 0
        # ids that are not emitted, and the documents they belong to
        self.ids, self.name = np.zeros(0, "<u4"), pa.array([], pa.int64())
        self.end, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, off: np.ndarray) -> pa.RecordBatch | None:
        """Take documents with these ids (``off`` as from ``encode``); pieces that are settled come out."""
        begin = self.done + len(self.ids)
        places, penalty = places_of(ids, off[1:], self.sentence, self.window)
        self.chain.extend(places + begin, penalty)
        self.ids = np.concatenate([self.ids, ids])
        self.name = pa.concat_arrays([self.name, names])
        self.end, self.size = np.r_[self.end, off[1:] + begin], np.r_[self.size, np.diff(off)]
        return self._emit(self.chain.settled())

    def finish(self) -> pa.RecordBatch | None:
        return self._emit(self.chain.finish())

    def _emit(self, found: list[int]) -> pa.RecordBatch | None:
        if not found:
            return None
        cuts, start = np.array(found, np.int64), self.done
        self.done = int(cuts[-1])
        bounds = np.unique(np.r_[start, cuts, self.end[self.end < self.done]])
        lo, hi = bounds[:-1], bounds[1:]
        doc = np.searchsorted(self.end, lo, "right")
        seq = np.searchsorted(cuts, lo, "right")
        flat = np.ascontiguousarray(self.ids[: self.done - start])
        spans = pa.py_buffer(((bounds - start) * 4).astype(np.int32).tobytes())
        out = pa.record_batch({
            "doc_id": self.name.take(pa.array(doc)),
            "start": pa.array(lo - (self.end[doc] - self.size[doc])),
            "length": pa.array(hi - lo),
            "doc_tokens": pa.array(self.size[doc]),
            "sequence_id": pa.array((self.shard << 32) + self.sequence + seq),
            "offset": pa.array(lo - np.r_[start, cuts][seq]),
            "ids": pa.Array.from_buffers(pa.binary(), len(lo), [None, spans, pa.py_buffer(flat)]),
        })
        self.sequence += len(cuts)
        first = int(np.searchsorted(self.end, self.done, "right"))
        self.ids = self.ids[self.done - start :].copy()
        self.name, self.end, self.size = self.name.slice(first), self.end[first:], self.size[first:]
        return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end: int = 1, shards: int | None = None
) -> DataFrame:
    """Pack docs(doc_id, text, ..) into sequences of at most ``window`` ids.

    One row a piece: doc_id, start (the document's ids before it), length, doc_tokens
    (with the end id), sequence_id, offset in the sequence, ids (unsigned 32-bit
    little-endian, as binary). A null text is empty and has its end id alone. Rows
    that repeat a doc_id, or have none, are packed each by itself; null ids come first.
    Each shard of doc_ids is packed by itself; its number stands in the high half of
    sequence_id. Without ``shards`` there are as many as shuffle partitions, but none of fewer
    than ``SHARD_BYTES`` of text. A task holds one piece of the stream and what is not settled:
    some windows, and the whole shard only if equal documents keep several chains equally good.
    An empty table gives no rows. Other columns are ignored.
    """
    if window < 1:
        raise ValueError("window must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of(tokenizer_path)
        packer = None
        for b in text_chunks(batches, "text", 6 << 20):
            of = b.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for lo, hi in zip(cuts, [*cuts[1:], len(of)]):
                if packer is None or packer.shard != of[lo]:
                    if packer is not None and (out := packer.finish()) is not None:
                        yield out
                    packer = ShardPacker(int(of[lo]), window, sentence_ends(encoder))
                part = b.slice(lo, hi - lo)
                ids, off = encode_with_end(encoder, part.column("text").to_pylist(), end)
                if (out := packer.add(part.column("doc_id"), ids, off)) is not None:
                    yield out
        if packer is not None and (out := packer.finish()) is not None:
            yield out

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    dealt = in_id_order(docs, shards or shuffle_width(docs.sparkSession), 0 if shards else SHARD_BYTES)
    return dealt.mapInArrow(run, schema)


def packing_digest(docs: DataFrame, tokenizer_path: str, window: int = 2048, end: int = 1) -> DataFrame:
    """``pack_documents`` with a checksum in place of the ids; nulls, empty texts, repeats and empty tables as there."""
    return pack_documents(docs, tokenizer_path, window, end).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
