import itertools
from collections import Counter

import pytest

from quire.llm import graph, ngram_join
from tests.llm.conftest import SF, odd_rows


def brute(rows, threshold=0.8, words=5):
    def grams(text):
        w = (text or "").split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [grams(r[1]) for r in rows]
    up, n = list(range(len(rows))), Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            n[a] += 1
            n[b] += 1
            up[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for x in range(len(rows)):
        ids.setdefault(find(x), []).append(rows[x][0])
    least = {root: min((i for i in own if i is not None), default=None) for root, own in ids.items()}
    return Counter((rows[x][0], least[find(x)], n[x]) for x in range(len(rows)))


def found(df):
    assert df.columns == ["doc_id", "class_id", "n_links"]
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small,block", [(32, 4 << 20), (1, 4 << 20), (2, 1000)])
def test_equals_all_pairs_on_odd_rows(odd_docs, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    assert found(ngram_join.near_duplicates(odd_docs)) == brute(odd_rows())


@pytest.mark.parametrize("small", [32, 3])
def test_a_group_of_different_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 20_000)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words[: i % 8], f"x{i % 40}", *words[i % 8 + 1 :]])) for i in range(120)]
    df = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found(df) == brute(rows)


WORDS = [f"w{i}" for i in range(60)]


def near_copy(*changed):
    return " ".join("x" if i in changed else w for i, w in enumerate(WORDS))


@pytest.mark.parametrize("small", [32, 1])
def test_near_copies_without_doc_id(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    # The first and third are linked only through the second, which has no doc_id; the last group has none at all.
    rows = [(1, near_copy()), (None, near_copy(0, 1, 2, 3)), (3, near_copy(0, 1, 2, 3, 56, 57, 58, 59)), (None, near_copy().upper()), (None, near_copy(5).upper())]
    want = brute(rows)
    assert want[None, 1, 2] == 1 and want[3, 1, 1] == 1
    assert found(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == want


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(ngram_join.op1_ngram_join(spark, SF)) == brute(rows)


def test_empty_table(no_docs):
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert bands * rows <= ngram_join.MOST_ROWS


def test_components_of_a_long_chain(spark):
    n = 200
    order = [(i * 73) % n for i in range(n)]
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}
