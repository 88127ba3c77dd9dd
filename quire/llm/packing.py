"""Packing of token sequences by minimum bin slack over a histogram of lengths.

Documents are cut into full windows and one remainder. The remainders' lengths, at most 2047 different
ones however many documents there are, are packed as multisets: a bitset subset sum finds the counts
that fill a window closest to its capacity, and the same filling is used for as many windows as the
histogram allows. Pieces find their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import small_batches, written
from quire.llm.token_counts import byte_letters, vocabulary_path

CAPACITY = 2048
END = 1  # id after each document
MAX_SLACK = 16  # a filling that leaves more than this is closed by cutting one more piece
KEPT_WORDS = 400_000  # words whose ids a task remembers
# Fixed value: the word pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ALL_WORDS = regex.compile(WORDS).findall
# The same pattern with its classes spelt out, which is faster, for texts whose characters lie within them.
_SPACE, _LETTER = r" \t\n\r\x0b\x0c", "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_LATIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
).findall
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search


@functools.cache
def _letter_bytes() -> dict[str, int]:
    return {letter: b for b, letter in byte_letters().items()}


def token_bytes(token: str) -> bytes:
    """Bytes of an entry of a byte-level vocabulary."""
    return bytes(map(_letter_bytes().__getitem__, token))


@functools.cache
def _tool(path: str) -> object:
    """The library's tokenizer of a file, one for each Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Words(dict):
    """Ids of words as bytes, merged when a word is first met.

    In a byte-level vocabulary the id of a merged token is its rank plus a constant, so the table of
    tokens is all that the merging needs.
    """

    def __init__(self, tool: object) -> None:
        super().__init__()
        special = {t.content for t in tool.get_added_tokens_decoder().values()}
        ranks = {token_bytes(token): n for token, n in tool.get_vocab(False).items() if token not in special}
        self.merge = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        ids = self.merge(word.encode("utf-8", "surrogatepass"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = packed
        return packed


class Encoder:
    """Ids of whole texts as the library gives them, as little-endian unsigned 32-bit numbers.

    The library's result for a text is the concatenation of its model's results for the words of the
    pattern, so each different word is encoded once and remembered; special strings are cut out first,
    or are plain text if `special` is false.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        self.tool = _tool(path)
        found = sorted(t.content for t in self.tool.get_added_tokens_decoder().values()) if special else []
        self.special = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        self.words = _Words(self.tool)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = self.special.split(text) if self.special is not None and "<|" in text else [text]
        out = []
        for n, part in enumerate(parts):
            if n % 2:
                out.append(self.tool.token_to_id(part).to_bytes(4, "little"))
            elif part:
                split = _ALL_WORDS if _UNUSUAL(part) else _LATIN_WORDS
                out.extend(map(self.words.__getitem__, split(part)))
        return b"".join(out)


@functools.cache
def encoder(path: str, special: bool = True) -> Encoder:
    """The encoder of a file, one for each Python worker: its words last over the worker's tasks."""
    return Encoder(path, special)


def _fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest that is at most `room`.

    Bit s of `reach` says that s tokens can be filled. Counts enter as powers of two; the way back
    through the stored bitsets gives the counts of the best sum.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left:
            take = min(unit, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            unit *= 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found[length] += take
            at -= length * take
    return dict(found)


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY, max_slack: int = MAX_SLACK) -> pd.DataFrame:
    """Places of pieces by length and rank: one row for pieces lo <= rank < hi of an original length.

    A piece of rank r gives the part [cut, cut + part) of itself to sequence `first + i // each`, where
    i = r - lo + skip, at offset `offset + i % each * part`. The size of the plan depends on the
    capacity only: each filling uses up a length or lowers the number of it that fits.
    """
    pools: dict[int, deque] = {x: deque([(x, 0, n, 0)]) for x, n in sorted(histogram.items()) if n}
    counts = {x: n for x, n in histogram.items() if n}
    rows: list[tuple] = []
    sequence = 0

    def take(length: int, n: int) -> list[tuple]:
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        got = []
        while n:
            origin, lo, hi, cut = pools[length].popleft()
            m = min(n, hi - lo)
            got.append((origin, lo, lo + m, cut))
            if lo + m < hi:
                pools[length].appendleft((origin, lo + m, hi, cut))
            n -= m
        return got

    while counts:
        largest = max(counts)
        rest = {x: n - (x == largest) for x, n in counts.items()}
        filling = _fill({x: n for x, n in rest.items() if n}, capacity - largest)
        filling[largest] = filling.get(largest, 0) + 1
        slack = capacity - sum(x * n for x, n in filling.items())
        cut_from = max((x for x, n in counts.items() if n > filling.get(x, 0)), default=0) if slack > max_slack else 0
        times = min(counts[x] // (n + (x == cut_from)) for x, n in filling.items())
        if cut_from:
            times = min(times, counts[cut_from] // (filling.get(cut_from, 0) + 1))
        offset = 0
        for length, each in sorted(filling.items(), reverse=True):
            skip = 0
            for origin, lo, hi, cut in take(length, each * times):
                rows.append((origin, lo, hi, cut, length, skip, each, sequence, offset))
                skip += hi - lo
            offset += each * length
        if cut_from:
            skip = 0
            for origin, lo, hi, cut in take(cut_from, times):
                rows.append((origin, lo, hi, cut, slack, skip, 1, sequence, offset))
                skip += hi - lo
                left = cut_from - slack
                pools.setdefault(left, deque()).append((origin, lo, hi, cut + slack))
                counts[left] = counts.get(left, 0) + hi - lo
        sequence += times
    return pd.DataFrame(rows, columns=["origin", "lo", "hi", "cut", "part", "skip", "each", "first", "offset"], dtype="int64")


def _pieces(docs: DataFrame, vocabulary: str, capacity: int, with_ids: bool) -> DataFrame:
    """Full windows and remainders of documents, with their rank among the pieces of equal length in
    their task, and the remainders' ids, which a later cut needs; all ids if they are wanted."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, task, seen = encoder(vocabulary_path(vocabulary)), TaskContext.get().partitionId(), defaultdict(int)
        small = tool.tool.get_vocab_size() < 1 << 16
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = tool.encode(text if isinstance(text, str) else None) + END.to_bytes(4, "little")
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    tail = None if length == capacity and not with_ids else np.frombuffer(own, "<u4").astype("<u2").tobytes() if small else own
                    out.append((doc_id, start, length, zlib.crc32(own), total, task, seen[length], tail))
                    seen[length] += 1
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "crc", "doc_tokens", "task", "nth", "tail"])
            yield frame.astype({"doc_id": "Int64"})

    kinds = "doc_id bigint, start bigint, length int, crc bigint, doc_tokens bigint, task int, nth bigint, tail binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, kinds)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row per piece.

    With `with_ids` the ids of each piece come along as little-endian unsigned 32-bit numbers: the pieces
    of a sequence by their offset are the training sequence. Without, only their checksum leaves the task.

    Null and empty texts are one token, the end id. Repeated rows are packed each by itself; a null
    doc_id stays null. An empty table gives no rows. The pieces are written to the shared folder once,
    because ranks must not change if a task runs again; the histogram (at most `capacity` rows) is all
    that reaches the driver, and the plan made from it is all that the tasks are sent.
    """
    small_batches(docs.sparkSession)
    pieces = written(_pieces(docs, vocabulary, capacity, with_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_windows(histogram, capacity).sort_values(["origin", "cut", "lo"])
    places = {
        origin: [tuple(level[c].to_numpy() for c in ("lo", "hi", "cut", "part", "skip", "each", "first", "offset")) for level in _levels(own)]
        for origin, own in plan.groupby("origin")
    }

    kinds = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, start, length, crc, total, rank, tail in batch.itertuples(index=False):
                for lo, hi, cut, part, skip, each, first, offset in places[length]:
                    at = int(np.searchsorted(lo, rank, "right")) - 1
                    if at < 0 or rank >= hi[at]:
                        continue
                    i = rank - lo[at] + skip[at]
                    size, begin = int(part[at]), int(cut[at])
                    ids = None
                    if with_ids or size != length:
                        wide = np.frombuffer(tail, "<u2" if len(tail) == 2 * length else "<u4")
                        ids = wide[begin : begin + size].astype("<u4").tobytes()
                    if size != length:
                        crc = zlib.crc32(ids)
                    out.append((doc_id, start + begin, size, crc, total, int(first[at] + i // each[at]), int(offset[at] + i % each[at] * size), *([ids] if with_ids else [])))
            frame = pd.DataFrame(out, columns=[k.split()[0] for k in kinds.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    ranked = pieces.join(bases, ["task", "length"]).select(
        "doc_id", "start", F.col("length").cast("bigint").alias("length"), "crc", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"), "tail"
    )
    return ranked.mapInPandas(assign, kinds)


def _levels(own: pd.DataFrame) -> list[pd.DataFrame]:
    """Plan rows of one length in lists whose rank ranges do not overlap: a piece that is cut lies in
    one row of several lists."""
    levels: list[list] = []
    for row in own.itertuples(index=False):
        for level in levels:
            if level[-1].hi <= row.lo:
                level.append(row)
                break
        else:
            levels.append([row])
    return [pd.DataFrame(level) for level in levels]


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
