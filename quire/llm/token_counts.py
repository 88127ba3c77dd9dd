"""Token counts by byte-pair merging on a heap and a linked list, without building identifiers.

The rules of the vocabulary file (normalization, word pattern, end-of-word mark, special strings) are
read from its JSON. A word is merged once per task and its count kept in a bounded table.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import small_batches

LIMIT = 2048  # tokens above which a document is too long for one window
KEPT_WORDS = 400_000  # counts of words a task remembers
KEPT_LENGTH = 64  # longer words are merged each time, so the memory of a task stays bounded


@functools.cache
def byte_letters() -> dict[int, str]:
    """Printable stand-in of every byte: itself where printable, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens left after merging: symbols minus merges.

    The heap holds (rank, place) of adjacent pairs; neighbours are linked by `left` and `right`, and a
    pair that has changed since it was pushed is skipped when popped. Equal ranks go left to right.
    """
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i]
        if symbols[i] == "" or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        merges += 1
        right[i] = after = right[j]
        if after >= 0:
            left[after] = i
            if (r := ranks.get((symbols[i], symbols[after]))) is not None:
                heapq.heappush(heap, (r, i))
        before = left[i]
        if before >= 0 and (r := ranks.get((symbols[before], symbols[i]))) is not None:
            heapq.heappush(heap, (r, before))
    return n - merges


class Counter:
    """Counts the tokens of texts under one vocabulary file of the word-end kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model = rules["model"]
        self.ranks = {tuple(pair): n for n, pair in enumerate(model["merges"])}
        self.vocabulary = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        kinds = [step["type"] for step in rules["normalizer"]["normalizers"]]
        split = rules["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path}: not a vocabulary of this kind")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        special = [regex.escape(t["content"]) for t in rules["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.space = regex.compile(rules["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        if not all(s in self.vocabulary for s in symbols):  # a symbol outside the vocabulary gives no token
            symbols = [s for s in symbols if s in self.vocabulary]
        count = merged_length(symbols, self.ranks)
        if len(word) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = count
        return count

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; special strings in it are one token each, as the library has it."""
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special is not None and "<|" in text:
            total, parts = len(self.special.findall(text)), self.special.split(text)
        known, word = self.known.get, self.word
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # White space never enters a word, so folding it cannot change the count.
            part = _lower(part)
            for w in self.words(part):
                n = known(w)
                total += word(w) if n is None else n
        return total


def _lower(text: str) -> str:
    """Lower case letter by letter, without Python's rule for a final sigma."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


@functools.cache
def counter(path: str) -> Counter:
    """The counter of a file, one for each Python worker."""
    return Counter(path)


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def n_tokens(text: str | Column, vocabulary: str = "word_bpe_49k.json") -> Column:
    """Tokens of a text column (long); null and empty texts have none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = counter(vocabulary_path(vocabulary))
        for batch in batches:
            yield pd.Series([tool.text(v if isinstance(v, str) else None) for v in batch], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row; other columns are ignored."""
    small_batches(docs.sparkSession)
    counted = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens("text", vocabulary).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))
