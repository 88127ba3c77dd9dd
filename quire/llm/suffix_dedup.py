"""Removal of long repeated strings, found by interval expansion on a Burrows-Wheeler transform.

Equal strings of the minimum length have equal smallest hashed k-grams (anchors), so text is cut into
segments of consecutive windows with one anchor and only segments whose anchor occurs twice in the corpus
are gathered, by anchor. In a task, segments with equal bytes are merged; over the different ones a suffix
order and its Burrows-Wheeler transform are built, and intervals of suffixes with a common prefix are
extended backwards breadth first, eight bytes a step, until the common prefixes reach the minimum length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import small_batches, written

LENGTH = 100  # bytes of a repeated string
SLICE = 1 << 18  # bytes of a text scanned at once
PLACE_BITS = 20  # more than the bytes scanned at once have
HOT = 100_000  # segments of an anchor above which its windows are dealt by more of their bytes
FINE = 4  # window offsets that share a key then
HELD = 48 << 20  # bytes of different segments a task gathers before it sends them
ROWS = 20_000  # rows of an output batch
CHUNK = 1 << 20  # bytes of segments in one index, about
FIRST = -(1 << 63)  # place of a null doc_id
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _gram_length(length: int) -> int:
    return max(1, length * 24 // 100)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from every position, by doubling."""
    power, parts, size, factor = data.astype(np.uint64) + np.uint64(1), {}, 1, _P
    parts[1] = power
    while 2 * size <= k:
        power = power[:-size] * np.uint64(factor) + power[size:]
        factor = factor * factor & _MASK
        size *= 2
        parts[size] = power
    n, at, total = len(data) - k + 1, 0, None
    for size in sorted(parts, reverse=True):
        if k & size:
            part = parts[size][at : at + n]
            total = part.copy() if total is None else total * np.uint64(pow(_P, size, 1 << 64)) + part
            at += size
    total ^= total >> np.uint64(32)
    total *= np.uint64(_P)
    total ^= total >> np.uint64(29)
    return total


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours."""
    low, size = values, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        n = len(values) - width + 1
        low = np.minimum(low[:n], low[width - size : width - size + n])
    return low


def _scan(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts: text number, first window, number of windows, anchor, place of the anchor.

    The anchor of a window is its k-gram with the smallest hash, the leftmost of equal ones; a segment
    holds consecutive windows with the anchor at one place, so no two of its windows are equal.
    """
    k = _gram_length(length)
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    found: list[tuple] = []

    def flush(pieces: list[tuple[int, int, bytes]]) -> None:
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        if len(data) < length:
            return
        hashes = _grams(data, k)
        low = _lowest((hashes & ~low_bits) | np.arange(len(hashes), dtype=np.uint64), length - k + 1) & low_bits
        sizes = np.array([len(p[2]) for p in pieces])
        begins = np.cumsum(sizes) - sizes
        ends = begins + sizes - length + 1  # of windows
        use = ends > begins
        edge = np.zeros(len(low) + 1, np.int32)
        np.add.at(edge, begins[use], 1)
        np.add.at(edge, ends[use], -1)
        inside = np.cumsum(edge)[:-1] > 0
        new = np.concatenate(([True], low[1:] != low[:-1]))
        new[begins[use]] = True
        at = np.flatnonzero(new & inside)
        own = np.searchsorted(begins, at, "right") - 1
        until = np.minimum(np.append(at[1:], len(low)), ends[own])
        numbers, shifts = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
        spot = low[at].astype(np.int64)
        move = shifts[own] - begins[own]
        found.append((numbers[own], at + move, until - at, hashes[spot].view(np.int64), spot + move))

    pieces, held = [], 0
    for number, text in enumerate(texts):
        for shift in range(0, max(len(text) - length + 1, 0), SLICE):
            piece = text[shift : shift + SLICE + length - 1]
            pieces.append((number, shift, piece))
            held += len(piece)
            if held >= SLICE // 2:
                flush(pieces)
                pieces, held = [], 0
    if pieces:
        flush(pieces)
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _bytes(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _suffix_places(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of every suffix in the order of suffixes, to `depth` bytes at least, and the eight bytes
    from every position as one number."""
    n = len(data)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | wide[j : j + n]
    order = np.argsort(eight)
    ordered = eight[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)  # of a suffix: where its group of equal prefixes begins
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    reach = 8
    while reach < depth:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            break
        own = order[tied]
        after = own + reach
        key = (rank[own] << 32) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        turn = np.argsort(key)
        own, key = own[turn], key[turn]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        order[tied], first[tied] = own, new
        rank[own] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        reach *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place, eight


def repeated_windows(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `length` bytes that occur more than once in the segments: segment number, offset, and
    number of the group of equal windows.

    The interval of a string is the set of suffixes that begin with it. Extending it backwards by the
    eight bytes before each suffix, the super-symbol of the Burrows-Wheeler transform, splits it into
    the intervals of the longer strings, which are contiguous in the suffix order. Intervals are taken
    breadth first, so common prefixes are met by increasing length; those of one suffix are dropped.
    """
    sizes = np.array([len(s) for s in segments])
    data = np.frombuffer(b"\xff".join([*segments, b""]), np.uint8)  # 255 is in no UTF-8 text
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    place, eight = _suffix_places(data, length)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(segments)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = begins[owner] + offset
    depth = length % 8 or 8
    at = start + length - depth  # suffix that is `depth` bytes before the window's end
    symbol = eight[at] >> np.uint64(64 - 8 * depth)
    group = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    slot = np.full(len(data), -1, np.int64)
    while True:
        where = place[at]
        slot[where] = np.arange(len(at))
        order = slot[np.sort(where)] if len(at) < len(data) // 16 else slot[slot >= 0]
        slot[where] = -1
        g, s = group[order], symbol[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]))) if len(order) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        keep = np.bincount(number, minlength=1)[number] > 1 if len(order) else new
        order, group = order[keep], number[keep]
        live, at = live[order], at[order]
        if depth == length or not len(live):
            break
        at = at - 8
        symbol = eight[at]
        depth += 8
    return owner[live], offset[live], group


class _Index:
    """Gathers the different segments of whole keys and gives the places to remove."""

    def __init__(self, length: int) -> None:
        self.length, self.segments, self.firsts, self.held, self.out = length, [], [], 0, []

    def key(self, contents: dict[bytes, list[tuple[int, int, int]]]) -> None:
        """Take the places (doc, start, variant) of each different segment of one key."""
        for content, places in contents.items():
            doc, start, _ = min(places)
            firsts = [p for p in places if p[0] == doc and p[1] == start]
            if len(firsts) < len(places):
                self.out.extend((d, v, s, s + len(content)) for d, s, v in places if d != doc or s != start)
            if len(contents) > 1:  # equal windows lie in different segments
                self.segments.append(content)
                self.firsts.append(firsts)
                self.held += len(content)
        if self.held >= CHUNK:
            self.search()

    def search(self) -> None:
        if not self.segments:
            return
        owner, offset, group = repeated_windows(self.segments, self.length)
        if len(owner):
            docs = np.array([f[0][0] for f in self.firsts])[owner]
            at = np.array([f[0][1] for f in self.firsts])[owner] + offset
            order = np.lexsort((at, docs, group))
            g, d, a = group[order], docs[order], at[order]
            head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            lead = np.repeat(head, np.diff(np.append(head, len(g))))
            later = (d != d[lead]) | (a != a[lead])
            own, off = owner[order][later], offset[order][later]
            order = np.lexsort((off, own))
            own, off = own[order], off[order]
            if len(own):
                new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (off[1:] > off[:-1] + self.length))))
                last = np.append(new[1:], len(own)) - 1
                for o, b, e in zip(own[new].tolist(), off[new].tolist(), off[last].tolist(), strict=True):
                    self.out.extend((doc, v, s + b, s + e + self.length) for doc, s, v in self.firsts[o])
        self.segments, self.firsts, self.held = [], [], 0

    def frame(self) -> pd.DataFrame:
        out, self.out = self.out, []
        return pd.DataFrame(out, columns=["place", "variant", "begin", "end"], dtype="int64")


def _anchors(base: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"anchor": _scan([_bytes(t) for t in batch["text"]], length)[3]})

    return base.select("text").mapInPandas(run, "anchor bigint")


def _anchors_of_docs(base: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, _, _, anchor, _ = _scan([_bytes(t) for t in batch["text"]], length)
            order = np.lexsort((anchor, number))
            number, anchor = number[order], anchor[order]
            if len(number):
                new = np.concatenate(([True], (number[1:] != number[:-1]) | (anchor[1:] != anchor[:-1])))
                number, anchor = number[new], anchor[new]
            place, variant = batch["place"].to_numpy(np.int64), batch["variant"].to_numpy(np.int64)
            yield pd.DataFrame({"place": place[number], "variant": variant[number], "anchor": anchor})

    return base.select("place", "variant", "text").mapInPandas(run, "place bigint, variant bigint, anchor bigint")


def _fine_keys(text: bytes, start: int, windows: int, anchor: int, spot: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(key, first window, windows) of a hot anchor's segment: windows that begin at nearly the same
    distance before the anchor share the bytes they all cover, and those bytes are the key."""
    begin, end = start, start + windows
    while begin < end:
        band = (spot - begin) // FINE
        last = spot - band * FINE  # last window start of the band, whose bytes reach furthest
        core = text[last : last - FINE + 1 + length]
        key = xxhash.xxh64_intdigest(core, seed=band) ^ (anchor & _MASK)
        until = min(last + 1, end)
        yield (key - (1 << 64) if key >> 63 else key), begin, until - begin
        begin = until


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """Segments of the repeated anchors with their bytes; of equal ones only the first met in a task keeps
    its bytes, the others are sent as places to remove. A task holds HELD bytes of segments at most."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["key", "place", "variant", "start", "size", "content"])
        return made.astype({"key": "int64", "place": "int64", "variant": "int64", "start": "int64", "size": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        out: list[tuple] = []
        held = 0

        def offer(key: int, content: bytes, at: tuple[int, int, int]) -> None:
            nonlocal held
            old = best.get((key, content))
            if old is None:
                best[key, content] = at
                held += len(content)
            elif at[:2] == old[:2]:
                out.append((key, at[0], at[2], at[1], None, content))  # the same place: neither is earlier
            else:
                first, later = min(at, old), max(at, old)
                best[key, content] = first
                out.append((later[0] ^ later[1], later[0], later[2], later[1], len(content), None))

        for batch in batches:
            texts = [_bytes(t) for t in batch["text"]]
            place, variant = batch["_place"].to_numpy(np.int64), batch["_variant"].to_numpy(np.int64)
            number, start, width, anchor, spot = _scan(texts, length)
            bounds = np.searchsorted(number, np.arange(len(texts) + 1))
            for n, wanted in enumerate(batch["_anchors"]):
                low, high = bounds[n], bounds[n + 1]
                if low == high:
                    continue
                counts = {w["anchor"]: w["n"] for w in wanted}
                text, doc, kind = texts[n], int(place[n]), int(variant[n])
                for a, s, w, at in zip(*[x[low:high].tolist() for x in (anchor, start, width, spot)], strict=True):
                    many = counts.get(a)
                    if many is None:
                        continue
                    if many <= HOT:
                        offer(a, text[s : s + w + length - 1], (doc, s, kind))
                        continue
                    for key, begin, count in _fine_keys(text, s, w, a, at, length):
                        offer(key, text[begin : begin + count + length - 1], (doc, begin, kind))
            if held >= HELD:
                out.extend((key, d, v, s, None, content) for (key, content), (d, s, v) in best.items())
                best.clear()
                held = 0
            for at in range(0, len(out), ROWS):
                yield frame(out[at : at + ROWS])
            out.clear()
        rest = [(key, d, v, s, None, content) for (key, content), (d, s, v) in best.items()]
        best.clear()
        for at in range(0, len(rest), ROWS):
            yield frame(rest[at : at + ROWS])

    kinds = "key bigint, place bigint, variant bigint, start bigint, size bigint, content binary"
    return joined.mapInPandas(run, kinds)


def _search(segments: DataFrame, length: int) -> DataFrame:
    """Places to remove, from segments dealt by key; a task holds one key and one index at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, now, contents = _Index(length), None, {}
        for batch in batches:
            for key, place, variant, start, size, content in zip(*[batch[c].tolist() for c in batch.columns], strict=True):
                if content is None:
                    index.out.append((place, variant, start, start + int(size)))
                    continue
                if key != now:
                    if contents:
                        index.key(contents)
                    now, contents = key, {}
                contents.setdefault(content, []).append((place, start, variant))
            yield index.frame()
        if contents:
            index.key(contents)
        index.search()
        yield index.frame()

    dealt = segments.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, "place bigint, variant bigint, begin bigint, end bigint")


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The columns of `docs` and `_spans`: pairs (begin, end) of bytes to remove, in any order, null where
    there is none.

    A byte goes if it is covered by a string of `length` bytes that also starts earlier, in a smaller
    doc_id or before in the same text. Null doc_ids come before all others. Rows with one doc_id stand at
    the same place: a string at the same start in both is not earlier. Null texts are empty.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("_place", "_variant", "_spans", "_anchors", "_again")]
    base = docs.select(*names).withColumn("_place", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)))
    again = base.groupBy("_place").count().where("count > 1").select("_place")
    keys = ["_place"]
    if again.limit(1).count():
        # Texts that share a doc_id are told apart by a hash; without such rows nothing is joined.
        keys.append("_variant")
        hashed = F.when(F.col("_again"), F.xxhash64("text")).otherwise(F.lit(0))
        base = base.join(again.withColumn("_again", F.lit(True)), "_place", "left").withColumn("_variant", F.coalesce(hashed, F.lit(0))).drop("_again")
    else:
        base = base.withColumn("_variant", F.lit(0).cast("bigint"))
    own = [k[1:] for k in keys]
    slim = base.select(F.col("_place").alias("place"), F.col("_variant").alias("variant"), "text")
    repeated = written(_anchors(slim, length).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    wanted = _anchors_of_docs(slim, length).join(repeated, "anchor").groupBy(*own).agg(F.collect_list(F.struct("anchor", "n")).alias("_anchors"))
    named = lambda df, value: df.select(*[F.col(k[1:]).alias(k) for k in keys], value)
    # Both joins with `base` read the same columns, so its texts are shuffled once and the exchange is reused.
    joined = base.join(named(wanted, "_anchors"), keys).select(*names, "_place", "_variant", "_anchors")
    spans = _search(_cut(joined, length), length).groupBy(*own).agg(F.collect_list(F.struct("begin", "end")).alias("_spans"))
    return base.join(named(spans, "_spans"), keys, "left").select(*names, "_spans")


def _merged(spans: object) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans) if spans is not None else ():
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for begin, end in runs:
        out.append(text[at:begin])
        at = end
    return b"".join([*out, text[at:]])


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row."""

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for text, own in zip(texts, spans, strict=True):
                data, runs = _bytes(text), _merged(own)
                kept = _kept(data, runs)
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(docs.select("doc_id", "text"), length).withColumn("d", told("text", "_spans"))
    return found.select("doc_id", "d.n_bytes", "d.n_removed", "d.n_spans", "d.kept_sha256")


def removed(text: str | Column, spans: str | Column) -> Column:
    """A text without the bytes of its spans; bytes of a character that was cut through are dropped."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, own in batches:
            yield pd.Series(
                [t if s is None or not isinstance(t, str) else _kept(_bytes(t), _merged(s)).decode("utf-8", "ignore") for t, s in zip(texts, own, strict=True)], dtype="object"
            )

    return run(text, spans)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return digest(table(spark, folder, "documents"))
