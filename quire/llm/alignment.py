"""Alignment of two tokenizations of a text by galloping intersection of their byte ends.

Both token lists cover the same bytes, so each is known by its ends. The ends of the shorter list are
looked for in the longer one by exponential and binary search from the place of the last. Common ends
cut both lists into groups; the differences of the places are the tokens that each one overlaps.

How many documents hold a pair of ids linked is counted over the whole corpus. Documents are read in
chunks of bounded size. The different pairs of a chunk are sent out once and their answers come back
once, so what is shuffled by pair are the pairs of chunks, and no pair is a large group.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.packing import encoder, token_bytes
from quire.llm.registry import query, table
from quire.llm.shared import small_batches, written
from quire.llm.token_counts import vocabulary_path

CHUNK_PAIRS = 2_000_000  # pairs of documents after which a chunk is closed
CHUNK_DOCS = 50_000  # documents after which it is closed
SLICE = 1 << 16  # pairs of one row of a chunk's list
KEPT_WORDS = 400_000  # words whose ids a worker remembers
MARK = "▁"  # stands for a space in a piece


@dataclass(frozen=True)
class Side:
    """A vocabulary: bytes and their number for each id."""

    tokens: list[bytes]
    lengths: np.ndarray


def _side(tokens: list[bytes]) -> Side:
    return Side(tokens, np.array([len(t) for t in tokens], np.int64))


@functools.cache
def byte_side(path: str) -> Side:
    """The byte-level vocabulary of a file of `tokenizers`."""
    held = encoder(path, False).tool.get_vocab(True)
    tokens = [b""] * (max(held.values()) + 1)
    for token, n in held.items():
        tokens[n] = token_bytes(token)
    return _side(tokens)


class Pieces(dict):
    """Ids of texts by a piece vocabulary, as little-endian unsigned 32-bit numbers.

    If no piece goes on with a space after another character, no merge crosses the start of a run of
    spaces. Each run with the word behind it is then encoded once and remembered.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.side = _side([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.space = struct.pack("<I", self.model.piece_to_id(MARK))

    def __missing__(self, word: str) -> bytes:
        ids = self.model.encode(word[1:])  # the model puts a space in front, unless nothing follows it
        packed = struct.pack(f"<{len(ids)}I", *ids) if word != " " else self.space
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text; the model itself puts a space in front."""
        if not self.apart or not text:
            ids = self.model.encode(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, _SPACED(" " + text)))


_SPACED = re.compile(" +[^ ]*").findall


@functools.cache
def pieces(path: str) -> Pieces:
    """The pieces of a file, one for each Python worker."""
    return Pieces(path)


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each number of `short` the place of the first number of `long` that is not smaller.

    Both ascend. From the last place the step is doubled until a number is not smaller; the last step is
    then searched by halves.
    """
    places, low, n = [], 0, len(long)
    for x in short:
        high, step = low, 1
        while high < n and long[high] < x:
            low = high + 1
            high += step
            step += step
        low = bisect_left(long, x, low, high if high < n else n)
        places.append(low)
    return places


@dataclass(frozen=True)
class Alignment:
    """Last tokens of each group on both sides, and the overlapping tokens of each link."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Groups and links of two ascending lists of byte ends with the same last end."""
    if len(ends_b) < len(ends_a):
        turned = align(ends_b, ends_a)
        return Alignment(turned.group_b, turned.group_a, turned.link_b, turned.link_a)
    places = np.array(gallop(ends_a.tolist(), ends_b.tolist()), np.int64)
    common = ends_b[places] == ends_a
    # A token begins in the token of the other side behind the last end, and ends in that at its place.
    first = np.zeros(len(places), np.int64)
    first[1:] = places[:-1] + common[:-1]
    each = places - first + 1
    upto = np.cumsum(each)
    link_a = np.repeat(np.arange(len(places)), each)
    link_b = np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - upto + each, each)
    return Alignment(np.flatnonzero(common), places[common], link_a, link_b)


@functools.cache
def _labels(n_a: int, n_b: int) -> tuple[list[bytes], int, int]:
    """Ids in writing, after a semicolon, a comma and a bar; where the last two begin."""
    n = max(n_a, n_b)
    return [b";%d" % i for i in range(n_a)] + [b",%d" % i for i in range(n)] + [b"|%d" % i for i in range(n_b)], n_a, n_a + n


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, n_a: int, n_b: int) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: ids of the first and, behind a bar, of the second side, group by group."""
    labels, comma, bar = _labels(n_a, n_b)
    first_a, first_b = np.concatenate(([0], found.group_a[:-1] + 1)), np.concatenate(([0], found.group_b[:-1] + 1))
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    own_a, own_b = ids_a.astype(np.int64) + comma, ids_b.astype(np.int64) + comma
    own_a[first_a] -= comma
    own_b[first_b] += bar - comma
    out[np.arange(len(ids_a)) + np.repeat(first_b, found.group_a - first_a + 1)] = own_a
    out[np.arange(len(ids_b)) + np.repeat(found.group_a + 1, found.group_b - first_b + 1)] = own_b
    return b"".join(map(labels.__getitem__, out.tolist()))[1:]


class Aligner:
    """Aligns texts under two vocabulary files."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.encode_a, self.a = encoder(path_a, False).encode, byte_side(path_a)
        self.encode_b, self.b = pieces(path_b).encode, pieces(path_b).side
        self.n_a, self.n_b = len(self.a.tokens), len(self.b.tokens)

    def text(self, text: str | None) -> tuple[np.ndarray, np.ndarray, Alignment] | None:
        """Ids of both sides and their alignment; None if a side does not give back the text's bytes."""
        if not text:
            return None
        raw = (" " + text).encode("utf-8", "surrogatepass")
        ids_a, ids_b = (np.frombuffer(ids, "<u4") for ids in (self.encode_a(" " + text), self.encode_b(text)))
        for ids, side in ((ids_a, self.a), (ids_b, self.b)):
            if b"".join(map(side.tokens.__getitem__, ids.tolist())) != raw:
                return None
        return ids_a, ids_b, align(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]))


_READ = (
    "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, "
    "pairs binary, times binary, codes array<bigint>, docs array<bigint>"
)
_NAMES = [c.split()[0] for c in _READ.split(", ")]


def _read(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, with_groups: bool, chunk_pairs: int, chunk_docs: int) -> DataFrame:
    """Rows of documents, whose pairs are places in their chunk's ascending list of different pairs, and
    rows with slices of these lists (`codes`) and the number of the chunk's documents with each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Aligner(vocabulary_path(vocabulary_a), vocabulary_path(vocabulary_b))
        chunk = TaskContext.get().partitionId() << 32
        rows, held, size = [], [], 0

        def closed() -> Iterator[pd.DataFrame]:
            codes, places, docs = np.unique(np.concatenate([np.array([], np.int64), *held]), return_inverse=True, return_counts=True)
            at, out = 0, []
            for row, own in zip(rows, held, strict=True):
                out.append((*row[:-1], places[at : at + len(own)].astype("<u4").tobytes(), row[-1], None, None))
                at += len(own)
            yield pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64"})
            for begin in range(0, len(codes), SLICE):
                own = slice(begin, begin + SLICE)
                yield pd.DataFrame([(chunk, *[None] * 9, codes[own], docs[own])], columns=_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                name = None if pd.isna(doc_id) else int(doc_id)
                done = tool.text(text if isinstance(text, str) else None)
                if done is None:
                    own, row = np.array([], np.int64), (chunk, name, 0, 0, 0, 0, "", "", b"")
                else:
                    ids_a, ids_b, found = done
                    written_out = groups_text(ids_a, ids_b, found, tool.n_a, tool.n_b)
                    own, times = np.unique(ids_a[found.link_a].astype(np.int64) * tool.n_b + ids_b[found.link_b], return_counts=True)
                    row = (
                        chunk, name, len(ids_a), len(ids_b), len(found.group_a), len(found.link_a), hashlib.sha256(written_out).hexdigest(),
                        written_out.decode() if with_groups else "", times.astype("<u2" if times.max() < 1 << 16 else "<u4").tobytes(),
                    )
                rows.append(row)
                held.append(own)
                size += len(own)
                if size >= chunk_pairs or len(rows) >= chunk_docs:
                    yield from closed()
                    rows.clear()
                    held.clear()
                    chunk, size = chunk + 1, 0
        if rows:
            yield from closed()

    # A name leaves Spark as a string, so that nulls beside it do not make it a floating number.
    return docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), "text").mapInPandas(run, _READ)


def align_corpus(
    docs: DataFrame, vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model", with_groups: bool = False,
    chunk_pairs: int = CHUNK_PAIRS, chunk_docs: int = CHUNK_DOCS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]), one row per input row.

    Side A reads a space and the text, side B the text, before which it puts a space; strings of special
    tokens are plain text. `count_sum` adds over the links of a document in how many documents the link's
    pair of ids is linked; `n_best` counts the links whose pair is the most frequent of its A id, ties
    included. With `with_groups` the groups themselves come along.

    A null or empty text, and one that a side does not give back byte for byte, has no tokens: zeros and
    an empty string. Very long texts are aligned whole. Repeated rows are documents of their own, and a
    null doc_id stays null. An empty table gives no rows; other columns are ignored.

    The rows are written to the shared folder once, because chunks must not change if a task runs again.
    A task of the second pass holds one chunk: at most `chunk_docs` documents and `chunk_pairs` pairs
    beyond its last document.
    """
    small_batches(docs.sparkSession)
    read = written(_read(docs, vocabulary_a, vocabulary_b, with_groups, chunk_pairs, chunk_docs), "aligned")
    asked = read.where("codes IS NOT NULL").select("chunk", F.inline(F.arrays_zip("codes", "docs"))).toDF("chunk", "code", "docs")
    n_b = len(pieces(vocabulary_path(vocabulary_b)).side.tokens)
    counts = asked.groupBy("code").agg(F.sum("docs").alias("count"))
    of_a = Window.partitionBy(F.expr(f"code div {n_b}"))  # at most one row for each id of side B
    told = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    answers = asked.select("chunk", "code").join(told, "code").select("chunk", "code", "count", "best")

    kinds = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string" + ", groups string" * with_groups

    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(answers["code"].to_numpy(), kind="stable")
        count, best = answers["count"].to_numpy()[order].astype(np.int64), answers["best"].to_numpy()[order].astype(bool)
        n_best, count_sum = [], []
        for pairs, times in zip(rows["pairs"], rows["times"], strict=True):
            at = np.frombuffer(pairs, "<u4")
            n = np.frombuffer(times, "<u2" if len(times) == 2 * len(at) else "<u4").astype(np.int64)
            n_best.append(int(n[best[at]].sum()))
            count_sum.append(int((n * count[at]).sum()))
        names = [None if pd.isna(v) else int(v) for v in rows["doc_id"]]
        out = rows.assign(doc_id=pd.array(names, "Int64"), n_best=n_best, count_sum=count_sum)
        return out[[k.split()[0] for k in kinds.split(", ")]]

    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * with_groups, "pairs", "times"]
    # A name is a string here, for the same reason as above.
    rows = read.where("codes IS NULL").select(*[F.col(c).cast("string") if c == "doc_id" else c for c in names])
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, kinds)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_corpus(table(spark, folder, "documents"))
