import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quire.llm import alignment
from quire.llm.packing import token_bytes
from quire.llm.token_counts import vocabulary_path
from tests.llm.conftest import SF, odd_rows

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


class Plain:
    """Both libraries on whole texts, and alignment by comparing all byte ranges."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=B)

    def tokens(self, text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        a = [(i, token_bytes(self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        same = b"".join(x for _, x in a) == raw == b"".join(x for _, x in b)
        return (a, b) if same else ([], [])

    def rows(self, docs):
        held, pairs = [], defaultdict(int)
        for doc_id, text in docs:
            a, b = self.tokens(text)
            spans = []
            for side in (a, b):
                at, own = 0, []
                for i, x in side:
                    own.append((i, at, at + len(x)))
                    at += len(x)
                spans.append(own)
            links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e] if len(a) < 400 else self.swept(*spans)
            cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            text_of = lambda own, lo, hi: ",".join(str(i) for i, s, _ in own if lo <= s < hi)
            groups = ";".join(f"{text_of(spans[0], lo, hi)}|{text_of(spans[1], lo, hi)}" for lo, hi in zip([0, *cuts], cuts)) if len(a) < 400 else None
            held.append((doc_id, len(a), len(b), len(cuts), links, groups))
            for pair in set(links):
                pairs[pair] += 1
        best = defaultdict(int)
        for (i, _), n in pairs.items():
            best[i] = max(best[i], n)
        out = []
        for doc_id, n_a, n_b, n_groups, links, groups in held:
            sha = None if groups is None else hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
            out.append((doc_id, n_a, n_b, n_groups, len(links), sum(pairs[x] == best[x[0]] for x in links), sum(pairs[x] for x in links), sha))
        return out

    def swept(self, a, b):
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        return links


ORDER = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(df, docs):
    key = lambda r: (repr(r[:7]), r[7] or "")
    got = sorted((tuple(r[c] for c in ORDER) for r in df.collect()), key=key)
    want = sorted(Plain().rows(docs), key=key)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    told = defaultdict(set)
    for r in got:
        told[r[:7]].add(r[7])
    assert all(r[7] is None or r[7] in told[r[:7]] for r in want)


def test_odd_rows(odd_docs):
    check(alignment.align_corpus(odd_docs), [(r[0], r[1]) for r in odd_rows()])


def test_empty_table(no_docs):
    assert alignment.align_corpus(no_docs).count() == 0


@pytest.mark.parametrize("pairs, docs", [(1, 100), (40, 100), (10**6, 3)])
def test_chunks_do_not_change_rows(spark, pairs, docs):
    rng = random.Random(4)
    letters = "ab é日\n\t .,'1▁\x00<s>|endoftext|½ﬁ́\U0001f600"
    rows = [(n, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for n in range(120)]
    rows += [(500, "  two  spaces  "), (501, " "), (502, "<|endoftext|>"), (503, "the the the"), (None, "the the the")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(alignment.align_corpus(df, chunk_pairs=pairs, chunk_docs=docs), rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(alignment.op12_token_alignment(spark, SF), rows)


def test_groups_come_along(spark):
    df = spark.createDataFrame([(1, "unbelievable things"), (2, None)], "doc_id bigint, text string")
    for r in alignment.align_corpus(df, with_groups=True).collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")
        assert r.n_groups == (len(r.groups.split(";")) if r.n_a else 0)


def test_gallop_and_links_equal_plain_search():
    rng = random.Random(8)
    for _ in range(300):
        end = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, end + 1), rng.randint(0, end)), end}) for _ in range(2))
        assert alignment.gallop(a, b) == np.searchsorted(b, a).tolist()
        found = alignment.align(np.array(a), np.array(b))
        spans = [list(zip([0, *x], x)) for x in (a, b)]
        assert sorted(zip(found.link_a.tolist(), found.link_b.tolist())) == [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        assert [a[i] for i in found.group_a] == [b[j] for j in found.group_b] == sorted({*a} & {*b})


def test_pieces_equal_the_library():
    rng, tool = random.Random(6), alignment.pieces(B)
    texts = ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x3000), 32, 32, 97])) for _ in range(40)) for _ in range(300)]
    texts += [" ", "  ", "a ", " a", "▁", "a▁ b", "", "\n", "\n ", " \n"]
    assert [np.frombuffer(tool.encode(t), "<u4").tolist() for t in texts] == tool.model.encode(texts)
