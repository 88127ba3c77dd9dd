import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import resampling
from tests.llm.conftest import SF, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5):
    """Rows of the result as the rule says them, by plain loops."""
    s, t, held = [0] * 10000, [0] * 10000, []
    for doc_id, text in docs:
        n, own = features(text)
        held.append((doc_id, n, own))
        for b in own:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out, able = [], []
    for i, (doc_id, n, own) in enumerate(held):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            able.append(i)
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0, out[i][1]))
    for rank, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][4] = rank
    return sorted(map(repr, map(tuple, out)))


def told(df):
    return sorted(map(repr, (tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert told(resampling.op13_importance_resampling(spark, SF)) == brute(docs, target)


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_odd_rows(spark, odd_docs, percent):
    target = spark.createDataFrame([("the quick brown fox",), (None,)], "text string")
    got = resampling.resample(odd_docs, target, percent)
    assert told(got) == brute([(r[0], r[1]) for r in odd_rows()], ["the quick brown fox", None], percent)


def test_empty_tables(spark, no_docs, odd_docs):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, nothing).count() == 0
    assert told(resampling.resample(odd_docs, nothing, 50)) == brute([(r[0], r[1]) for r in odd_rows()], [], 50)


def test_tiles_do_not_change_features(monkeypatch):
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 6, 7, 8, 9, 50):
        words = [rng.choice([b"a", "é".encode(), b"word"]) for _ in range(n)]
        whole = np.sort(np.concatenate([*resampling.feature_buckets(words), np.array([], np.uint32)]))
        monkeypatch.setattr(resampling, "TILE", 7)
        tiled = np.sort(np.concatenate([*resampling.feature_buckets(words), np.array([], np.uint32)]))
        monkeypatch.undo()
        assert whole.tolist() == tiled.tolist() == sorted(features(b" ".join(words).decode())[1])
        assert len(whole) == resampling.n_features(n)


@pytest.mark.parametrize("spread, kind", [(1, "sketch"), (1000, "sketch"), (10**9, "sketch"), (40, "low"), (40, "high"), (1000, "all")])
def test_bracket_finds_every_rank(spark, spread, kind):
    rng = random.Random(spread)
    values = [(rng.randint(-spread, spread), rng.choice([1, 1, 1, 7])) for _ in range(60)]
    rows = spark.createDataFrame(values, "k bigint, times bigint").coalesce(1)
    told = sorted(v for v, n in values for _ in range(n))
    wrong = {"low": lambda *_: [min(told), min(told)], "high": lambda *_: [max(told), max(told)], "all": lambda *_: [min(told) - 5, max(told) + 5]}
    sketch = wrong.get(kind, resampling._sketch)
    for wanted in (1, len(told) // 3, len(told)):
        cut = resampling.bracketed(rows, "k", wanted, 10, sketch)
        assert cut.value == told[wanted - 1]
        assert cut.taken == wanted - sum(v < cut.value for v in told)
    with pytest.raises(ValueError):
        resampling.bracketed(rows, "k", len(told) + 1)


def test_ranks_over_many_parts_and_ties(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), 20 + rng.randint(-3, 3), 57, 0, rng.randint(0, 3)) for _ in range(600)]
    scored = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    got = resampling.draw(scored, 30, sorted_rows=5, ranked_rows=20).collect()
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= 20)
    ranked = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, 30 * len(able) // 100 + 1))
    assert [r[1:] for r in ranked] == able[: len(ranked)]
    assert len(got) == len(rows)
