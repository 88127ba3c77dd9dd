import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.token_counts import vocabulary_path
from tests.llm.conftest import SF, odd_rows

PATH = vocabulary_path("byte_bpe_50k.json")


def check(df, rows, capacity=2048):
    """Every document's ids come back whole, sequences are gapless, and little is padded."""
    tool = Tokenizer.from_file(PATH)
    want = Counter((r[0], np.array([*tool.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in rows)
    pieces = df.toPandas()
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own.length.cumsum() - own.length == own.offset).all()
        assert own.length.sum() <= capacity
    assert sorted(pieces.sequence_id.unique()) == list(range(pieces.sequence_id.nunique()))
    crcs, tokens = Counter(), 0
    for (doc_id, ids), n in want.items():
        own = pieces[pieces.doc_id.isna() if doc_id is None else pieces.doc_id == doc_id]
        for r in own.itertuples():
            assert r.length > 0
        tokens += n * len(ids) // 4
        if sum(1 for k in want if k[0] == doc_id) == 1:
            assert (own.doc_tokens == len(ids) // 4).all()
            for start, length, crc in zip(own.start, own.length, own.ids_crc32, strict=True):
                assert crc == zlib.crc32(ids[4 * start : 4 * (start + length)])
                crcs[start, length] += 1
            assert own.length.sum() == n * len(ids) // 4
    assert pieces.length.sum() == tokens
    return pieces


def test_round_trip_on_odd_rows(odd_docs):
    pieces = check(packing.pack(odd_docs), odd_rows())
    assert (pieces[pieces.doc_id == 0].doc_tokens == 1).all()


def test_cut_pieces_keep_their_ids(spark):
    rows = [(i, "alpha beta " * 70 + "gamma " * (i % 3)) for i in range(40)]
    pieces = check(packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=200), rows, 200)
    assert (pieces.groupby("sequence_id").length.sum() < 184).sum() <= 1


def test_sequences_hold_the_ids(spark):
    rows = [(i, "alpha beta " * (60 + i) + "gamma") for i in range(25)]
    df = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=150, with_ids=True)
    pieces = check(df.drop("ids"), rows, 150)
    tool = Tokenizer.from_file(PATH)
    told = df.toPandas().sort_values(["doc_id", "start"])
    assert len(told) == len(pieces)
    for doc_id, own in told.groupby("doc_id"):
        ids = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert ids == [*tool.encode(rows[doc_id][1], add_special_tokens=False).ids, 1]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in told.itertuples())


def test_query_round_trip(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(packing.op7_packing(spark, SF), rows)


def test_empty_table(no_docs):
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(rng.randint(1, 60))}
    plan = packing.plan_windows(histogram, 100, 3)
    covered, used = Counter(), Counter()
    for r in plan.itertuples():
        for rank in range(r.lo, r.hi):
            i = rank - r.lo + r.skip
            covered[r.origin, rank] += r.part
            used[r.first + i // r.each] += r.part
    assert covered == {(x, n): x for x, m in histogram.items() for n in range(m)}
    assert max(used.values()) <= 100
    assert sum(1 for u in used.values() if u < 97) <= 1


def test_fill_is_the_best_subset_sum():
    rng = random.Random(9)
    for _ in range(50):
        counts = {rng.randint(3, 40): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 120)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing._fill(counts, room)
        assert all(n <= counts[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def test_ids_equal_the_library_on_unusual_characters():
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x3000), 32, 32, 97, 39])) for _ in range(50)) for _ in range(400)]
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    tool = packing.Encoder(PATH)
    assert [np.frombuffer(tool.encode(t), "<u4").tolist() for t in texts] == [e.ids for e in tool.tool.encode_batch(texts, add_special_tokens=False)]
