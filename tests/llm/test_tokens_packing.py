import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagloom.llm.packing import best_cuts, pack_documents
from tagloom.llm.tokens import UnitEncoder, read_token_files, token_file_digest, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "a  b", " a", "a ", "x \n y", "x\n\n y", "tab\t tab", "it's I'll, don't", "é  ü", "<|endoftext|> a <|endoftext|>", "1234 5678.9", "end. Next! \n", "\n \n", "日本語 テスト。", "a" * 300, "'s 's"]


def texts(n=60, seed=1):
    rnd = random.Random(seed)
    parts = ["the", "Ünder", "foo,", "bar.", "baz!\n", "x1", "\t", "", "end?", "don't", "…"]
    return ODD + [" ".join(rnd.choices(parts, k=rnd.randint(1, 80))) for _ in range(n)]


def plain(t):
    return Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids


def test_units_encode_like_whole_texts():
    plain_one = Tokenizer.from_file(PATH)
    ts = [t or "" for t in texts(400)]
    for cache in (500_000, 20):
        e = UnitEncoder(PATH, cache)
        for lo in range(0, len(ts), 50):
            ids, off = e.encode(ts[lo : lo + 50])
            for i, t in enumerate(ts[lo : lo + 50]):
                assert ids[off[i] : off[i + 1]].tolist() == plain_one.encode(t, add_special_tokens=False).ids, repr(t)
    assert UnitEncoder(PATH).encode([])[0].size == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    path = public_tokenizers.path(name)
    e, t = UnitEncoder(path), Tokenizer.from_file(path)
    ids, off = e.encode(["Hello  there, you", ""])
    assert ids.tolist() == t.encode("Hello  there, you", add_special_tokens=False).ids and off[-1] == off[1]


def test_token_files_round_trip(spark, tmp_path):
    ts = texts()
    rows = [(i * 3 - 20, t, 1) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    shards = write_token_files(df, str(tmp_path / "t"), PATH, 0, 5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, str(tmp_path / "t"), shards, PATH).collect()}
    start, want = 0, {}
    for doc, t, _ in rows:
        ids = np.array([*plain(t), 0], "<u4")
        want[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    assert np.fromfile(tmp_path / "t" / f"{shards[0][0]:06d}.off", "<u8")[0] == 0


def test_token_files_of_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b"), (1, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.start, r.n_tokens) for r in token_file_digest(df, PATH).collect()), key=lambda x: x[1])
    assert got == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2)]
    assert token_file_digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_cuts_against_full_search():
    rnd = np.random.default_rng(3)
    from tagloom.llm.packing import WINDOW_COST

    for window in (5, 16, 40):
        for _ in range(30):
            places = np.r_[0, np.cumsum(rnd.integers(1, 5, 60))]
            penalty = rnd.integers(0, 20, len(places))
            cost = [0.0]
            for j in range(1, len(places)):
                cost.append(min(cost[i] + window - (places[j] - places[i]) for i in range(j) if places[j] - places[i] <= window) + penalty[j] + WINDOW_COST)
            cuts, got, last = best_cuts(places, penalty, window), 0.0, 0
            for j in cuts:
                assert places[j] - places[last] <= window
                got += window - (places[j] - places[last]) + penalty[j] + WINDOW_COST
                last = j
            assert last == len(places) - 1 and got == cost[-1]


@pytest.mark.parametrize("window, shards", [(2048, 1), (64, 3), (16, 2)])
def test_every_id_lies_in_one_piece(spark, window, shards):
    ts = texts(200, 5) + ["Sentence one. " * 2000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ts)], "doc_id long, text string, length int").repartition(3)
    pieces = [r.asDict() for r in pack_documents(df, PATH, window, 1, shards).collect()]
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault(p["doc_id"], []).append(p)
    for i, t in enumerate(ts):
        ids, at = np.array([*plain(t), 1], "<u4"), 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and bytes(p["ids"]) == ids[at : at + p["length"]].tobytes()
            at += p["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    total = sum(p["length"] for p in pieces)
    if window == 2048:
        assert len(by_seq) * window < 1.1 * total + window


def test_packing_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b"), (1, None)], "doc_id long, text string")
    got = pack_documents(df, PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 1), ("2", 2), ("2", 2), ("None", 2)]
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def full_search(places, penalty, window):
    from tagloom.llm.packing import WINDOW_COST

    places, penalty = [0, *places], [0, *penalty]
    cost = [0]
    for j in range(1, len(places)):
        cost.append(min(cost[i] + window - (places[j] - places[i]) for i in range(j) if places[j] - places[i] <= window) + penalty[j] + WINDOW_COST)
    return dict(zip(places, penalty)), cost[-1]


@pytest.mark.parametrize("window", [24, 100])
def test_shard_is_the_optimum_however_it_is_cut(spark, window):
    """The same pieces for small and large Arrow batches, at the least cost over the whole shard."""
    from tagloom.llm.packing import WINDOW_COST, places_of, sentence_ends

    ts = texts(150, 9) + ["word " * 150, "a b. " * 60, "x" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string").repartition(3)
    got = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in (7, 50, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got.append(sorted(map(tuple, pack_documents(df, PATH, window, 1, 1).collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] == got[2]
    ids = [[*plain(t), 1] for t in ts]
    ends = np.cumsum([len(x) for x in ids])
    encoder = UnitEncoder.of(PATH)
    penalties, least = full_search(*map(list, places_of(np.concatenate(ids), ends, sentence_ends(encoder), window)), window)
    sequences = {}
    for doc, start, length, _, seq, _, _ in got[0]:
        at = int(ends[doc]) - len(ids[doc]) + start
        lo, hi = sequences.get(seq, (at, at))
        sequences[seq] = min(lo, at), max(hi, at + length)
    cost = sum(window - (hi - lo) + penalties[hi] + WINDOW_COST for lo, hi in sequences.values())
    assert cost == least and sum(hi - lo for lo, hi in sequences.values()) == ends[-1]


def test_equal_documents_keep_two_chains(spark):
    """Cuts after odd and after even documents cost the same for ever; nothing is lost then."""
    df = spark.createDataFrame([(i, "word " * 5) for i in range(300)], "doc_id long, text string").coalesce(1)
    got = pack_documents(df, PATH, 16, 1, 1).collect()
    assert sum(r.length for r in got) == 300 * len([*plain("word " * 5), 1])


def test_nameless_and_hot_ids_fill_several_shards(spark):
    rows = [(None, f"n {i}") for i in range(40)] + [(5, f"h {i}") for i in range(40)] + [(i, f"t {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    from tagloom.llm.tokens import in_id_order

    dealt = [(r.shard, r.doc_id) for r in in_id_order(df, 12).collect()]
    assert len({s for s, d in dealt if d is None}) > 2 and len({s for s, d in dealt if d == 5}) > 2
    order = [d for _, d in sorted(dealt, key=lambda x: (x[0], x[1] is not None, x[1] or 0))]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    got = sorted(((r.start, r.n_tokens) for r in token_file_digest(df, PATH).collect()))
    assert [s for s, _ in got] == list(np.r_[0, np.cumsum([n for _, n in got])][:-1])


def test_very_long_text_round_trip(spark):
    long = "Sätze über alles, 12 more words. " * 60_000
    df = spark.createDataFrame([(1, long), (2, "b")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_file_digest(df, PATH).collect())
    ids = np.array([*plain(long), 0], "<u4")
    assert got[0] == (1, 0, len(ids), zlib.crc32(ids.tobytes())) and got[1][1] == len(ids)
    pieces = [r for r in pack_documents(df, PATH).collect() if r.doc_id == 1]
    assert b"".join(bytes(r.ids) for r in sorted(pieces, key=lambda r: r.start)) == np.array([*plain(long), 1], "<u4").tobytes()
