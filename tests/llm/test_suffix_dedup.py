import hashlib
import random
from collections import Counter

import pytest

from quire.llm import suffix_dedup
from tests.llm.conftest import SF, odd_rows


def brute(rows, length=100):
    """Digest rows; rows with one doc_id stand at one place, null doc_ids before all."""
    texts = [((-(1 << 63) if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    first = {}
    for doc, data in texts:
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    out = Counter()
    for (doc, data), row in zip(texts, rows, strict=True):
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (doc, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[row[0], len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize("hot", [20_000, 1])
def test_equals_brute_force_on_odd_rows(odd_docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    assert found(suffix_dedup.digest(odd_docs)) == brute(odd_rows())


@pytest.mark.parametrize("length", [100, 37])
def test_shared_passages_in_different_surroundings(spark, length):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [make(260), make(120), "ab" * 120]
    rows = [(i, make(rng.randrange(150)) + rng.choice(passages)[rng.randrange(20) :] + make(rng.randrange(150))) for i in range(60)]
    got = found(suffix_dedup.digest(spark.createDataFrame(rows, "doc_id bigint, text string"), length))
    assert got == brute(rows, length)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(suffix_dedup.op3_suffix_dedup(spark, SF)) == brute(rows)


def test_expansion_finds_the_equal_windows():
    rng = random.Random(2)
    for length in (9, 16, 23):
        segments = ["".join(rng.choice("ab") for _ in range(rng.randrange(length, 60))).encode() for _ in range(12)]
        owner, offset, group = suffix_dedup.repeated_windows(segments, length)
        got = {}
        for o, f, g in zip(owner.tolist(), offset.tolist(), group.tolist(), strict=True):
            got.setdefault(g, set()).add((o, f))
        want = {}
        for o, s in enumerate(segments):
            for f in range(len(s) - length + 1):
                want.setdefault(s[f : f + length], set()).add((o, f))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_empty_table_and_text_column(odd_docs, no_docs):
    assert suffix_dedup.digest(no_docs).count() == 0
    whole = suffix_dedup.with_spans(odd_docs)
    assert whole.columns[: len(odd_docs.columns) - 1] == [c for c in odd_docs.columns if c != "_spans"][: len(odd_docs.columns) - 1]
    cut = whole.withColumn("t", suffix_dedup.removed("text", "_spans"))
    assert cut.where("doc_id = 0").first()["t"] is None
    assert cut.where("doc_id = 5").first()["t"] == "the quick brown fox of the north walked with the old bear over a long and narrow bridge in the rain"
