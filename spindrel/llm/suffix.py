"""Benchmark decontamination with suffix arrays of the training text.

Each shard (a chunk of documents in a task) gets a suffix array over its words, and every suffix of the benchmark items
is binary-searched in it: equal beginnings once. What is found are the locations of verbatim matches; how far a match
at a location goes is the longest common beginning with any item suffix, looked up in the items' own suffix array.
Words that are hit, items, the longest match and the removal of documents all follow from these matches. Words that no
item has end all matches, so shard suffixes that can't reach the shortest match are left out of the array; that
changes no match.

A document is scanned where it lies: nothing is shuffled unless the benchmark is too large for one broadcast; then
blocks of it are searched one after another and the hits of a document are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.common import release, slices, staged, text_bytes, without
from spindrel.llm.words import ALNUM, hashed

#: Bytes of a shard.
SHARD = 1 << 20
#: Bytes of item texts in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Words of an item from which its occurrence alone, as a whole, counts as a passage.
LEAST_ITEM = 4
MATCHES = "doc_id long, doc_word long, item_id string, item_word long, length long"
HITS = "doc_id long, row long, n_words long, items array<string>, starts array<long>, ends array<long>, longest long, longest_start long"
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_start long"


@dataclass
class Benchmark:
    """Items as word numbers (1 and up), one after another, each followed by 0."""

    ids: list[str]
    vocabulary: np.ndarray  # sorted word hashes; the word number is the place plus 1
    words: np.ndarray
    firsts: np.ndarray  # first word of each item and the end
    window: int

    def __post_init__(self) -> None:
        """Beginnings to search: runs of `window` words, or whole shorter items; equal ones are one, with all its items."""
        n = np.diff(self.firsts) - 1
        count = np.where(n == 0, 0, np.maximum(n - self.window + 1, 1))
        item = np.repeat(np.arange(len(n)), count)
        start = self.firsts[:-1][item] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(n, self.window)[item]
        self.least = int(length.min(initial=self.window))
        stops = np.flatnonzero(self.words == 0)
        at = np.flatnonzero(self.words)
        self.left = np.zeros(len(self.words), np.int64)  # words up to the item's end
        self.left[at] = stops[np.searchsorted(stops, at)] - at
        self.suffixes = Suffixes(self.words, at[self.left[at] >= self.least])
        low, high = self.suffixes.search(self.words, start, length)
        self.key, first, which = np.unique(np.stack([low, length], 1), axis=0, return_index=True, return_inverse=True) if len(start) else (None, start, start)
        self.start, self.length = start[first], length[first]
        order = np.lexsort((item, which))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (which[order][1:] != which[order][:-1]) | (item[order][1:] != item[order][:-1])
        order = order[fresh]
        self.items = item[order]  # of each beginning, from bounds[k] to bounds[k + 1]
        self.bounds = np.searchsorted(which[order], np.arange(len(self.start) + 1))

    @property
    def item_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.firsts))


def compile_items(items: list[tuple[str | None, str | None]], window: int = 8) -> Benchmark:
    """Items without words, or without an id, match nothing and are left out."""
    items = [(str(i), t) for i, t in items if i is not None and t]
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
    hashes, at = hashed(data, offsets, ALNUM)
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, hashes) + 1
    words = np.insert(numbers, at[1:], 0)
    return Benchmark([i for i, _ in items], vocabulary, words.astype(np.int32), at + np.arange(len(at)), window)


def numbered(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The word number of each hash, 0 for words that no item has."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int32)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def suffix_array(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The given suffixes of text in order; 0 ends a suffix. Prefix doubling over ranks."""
    if not len(starts):
        return starts
    n, step = len(text), 1
    rank = text.astype(np.int64)
    stops = np.flatnonzero(text == 0)
    left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)  # words before the next 0
    while step < n:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        after[left < step] = 0  # what follows a 0 doesn't count
        _, fresh = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        done = step >= int(left.max())
        rank, step = fresh, step * 2
        if done:
            break
    return starts[np.argsort(rank[starts], kind="stable")]


class Suffixes:
    """The given suffixes of a text of numbers, in order; 0 ends a suffix."""

    def __init__(self, text: np.ndarray, starts: np.ndarray) -> None:
        self.text, self.array = text, suffix_array(text, starts)

    def _compare(self, suffix: np.ndarray, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix against the words[start:start + length]; 0 if it begins with them."""
        out = np.zeros(len(suffix), np.int8)
        open_ = np.ones(len(suffix), bool)
        for k in range(int(length.max(initial=0))):
            use = np.flatnonzero(open_ & (length > k))
            if not len(use):
                break
            a, b = self.text[suffix[use] + k], words[start[use] + k]
            out[use] = np.sign(a.astype(np.int64) - b)
            open_[use[(a != b) | (a == 0)]] = False
        return out

    def search(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix array that begin with each words[start:start + length]."""
        found = []
        for upper in (False, True):
            low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.array), np.int64)
            while (go := np.flatnonzero(low < high)).size:
                mid = (low[go] + high[go]) // 2
                c = self._compare(self.array[mid], words, start[go], length[go])
                right = (c <= 0) if upper else (c < 0)
                low[go[right]] = mid[right] + 1
                high[go[~right]] = mid[~right]
            found.append(low)
        return found[0], found[1]

    def longest(self, words: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Length of the longest match of each item suffix words[start:ends]: a neighbour of its place has it."""
        best = np.zeros(len(start), np.int64)
        if not len(self.array):
            return best
        low, _ = self.search(words, start, ends - start)
        for near in (np.maximum(low - 1, 0), np.minimum(low, len(self.array) - 1)):
            suffix, size = self.array[near], np.zeros(len(start), np.int64)
            go = np.arange(len(start))
            while len(go := go[size[go] < (ends - start)[go]]):
                same = self.text[suffix[go] + size[go]] == words[start[go] + size[go]]
                go = go[same]
                size[go] += 1
            best = np.maximum(best, size)
        return best


class Shard(Suffixes):
    """The suffix array of some texts' word numbers."""

    def __init__(self, numbers: np.ndarray, firsts: np.ndarray, least: int) -> None:
        """Keeps runs of at least `least` words that items have; firsts: first word of each text and the end."""
        stop = np.zeros(len(numbers) + 1, bool)
        stop[:-1] = numbers == 0
        stop[-1] = True
        heads = np.zeros(len(numbers) + 1, bool)
        heads[firsts] = True
        edge = np.flatnonzero(stop | heads)  # a run ends at an unknown word or where a text begins
        begin = np.r_[0, edge]
        begin = begin + np.r_[False, stop[edge]]
        end = np.r_[edge, len(numbers)]
        keep = end - begin >= least
        begin, end = begin[keep], end[keep]
        sizes = end - begin + 1  # each run is followed by a 0
        into = np.cumsum(sizes) - sizes
        text = np.zeros(int(sizes.sum()), np.int32)
        inner = np.arange(len(text)) - np.repeat(into, sizes)
        self.place = np.repeat(begin, sizes) + inner  # word of the shard
        self.left = np.repeat(sizes - 1, sizes) - inner  # words up to the run's end
        text[self.left > 0] = numbers[self.place[self.left > 0]]
        super().__init__(text, np.flatnonzero(self.left >= least))


def _shards(batches: Iterator[pa.RecordBatch], benches: list[Benchmark]):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in slices(offsets, SHARD):
            part = offsets[i : j + 1]
            hashes, firsts = hashed(data[part[0] : part[-1]], part - part[0], ALNUM)
            yield batch, i, j, firsts, [numbered(hashes, b.vocabulary) for b in benches]


def _matches(bench: Benchmark, shard: Shard, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word in the shard, length) of the longest match at each location, and the distinct (text, item)."""
    low, high = shard.search(bench.words, bench.start, bench.length)
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    spot = shard.array[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    text = np.searchsorted(firsts, shard.place[spot], side="right") - 1
    seen = np.unique(text * (len(low) + 1) + which)  # a beginning counts once a text
    each = seen // (len(low) + 1), seen % (len(low) + 1)
    number = (bench.bounds[1:] - bench.bounds[:-1])[each[1]]
    item = bench.items[np.repeat(bench.bounds[:-1][each[1]] - (np.cumsum(number) - number), number) + np.arange(number.sum())]
    pairs = np.unique(np.stack([np.repeat(each[0], number), item], 1), axis=0)
    spot, first = np.unique(spot, return_inverse=True)
    short = np.zeros(len(spot), np.int64)
    np.maximum.at(short, first, bench.length[which])
    longest = bench.suffixes.longest(shard.text, spot, spot + shard.left[spot])
    return shard.place[spot], np.where(longest >= bench.window, longest, short), pairs[:, 0], pairs[:, 1]


def _longest_of(doc: np.ndarray, place: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n texts the longest match and its first place in the shard, 0 and -1 without one."""
    longest, start = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    order = np.lexsort((-place, length, doc))  # the last of a text is its longest, the first in place among equals
    longest[doc[order]], start[doc[order]] = length[order], place[order]
    return longest, start


def _report(shared):
    """A report row for each document, the whole benchmark at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        names, none = np.array(bench.ids, object), hashlib.sha256(b"").hexdigest()
        for batch, i, j, firsts, (numbers,) in _shards(batches, [bench]):
            place, length, text, item = _matches(bench, Shard(numbers, firsts, bench.least), firsts)
            delta = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(delta, place, 1)
            np.add.at(delta, place + length, -1)
            hit = np.r_[0, np.cumsum(np.cumsum(delta[:-1]) > 0)]
            found: dict[int, set[str]] = {}
            for k, name in zip(text.tolist(), names[item].tolist(), strict=True):
                found.setdefault(k, set()).add(name)
            sums = [hashlib.sha256(",".join(sorted(found[k])).encode()).hexdigest() if k in found else none for k in range(j - i)]
            n_items = [len(found.get(k, ())) for k in range(j - i)]
            longest, start = _longest_of(np.searchsorted(firsts, place, side="right") - 1, place, length, j - i)
            start = pa.array(start - firsts[:-1], mask=start < 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(np.diff(firsts)), pa.array(np.diff(hit[firsts])), pa.array(n_items, pa.int64()), pa.array(sums), pa.array([n >= 2 for n in n_items]), pa.array(longest), start],
                names=[c.split()[0] for c in REPORT.split(", ")],
            )
        release()

    return run


def _hits(shared):
    """For one block of the benchmark: each document's items, hit word ranges and longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        names = np.array(bench.ids, object)
        for batch, i, j, firsts, (numbers,) in _shards(batches, [bench]):
            place, length, text, item = _matches(bench, Shard(numbers, firsts, bench.least), firsts)
            order = np.argsort(place, kind="stable")
            place, length = place[order], length[order]
            doc = np.searchsorted(firsts, place, side="right") - 1
            cut, cut_items = np.searchsorted(doc, np.arange(j - i + 1)), np.searchsorted(text, np.arange(j - i + 1))
            longest, start = _longest_of(doc, place, length, j - i)
            rows = []
            for k in range(j - i):
                mine = slice(cut[k], cut[k + 1])
                ranges = _merged(place[mine] - firsts[k], place[mine] - firsts[k] + length[mine])
                rows.append((sorted(set(names[item[cut_items[k] : cut_items[k + 1]]].tolist())), ranges[:, 0].tolist(), ranges[:, 1].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(i, j - i) for c in (0, 2)),
                    pa.array(np.diff(firsts)),
                    *(pa.array([r[c] for r in rows], pa.list_(kind)) for c, kind in enumerate((pa.string(), pa.int64(), pa.int64()))),
                    pa.array(longest),
                    pa.array(start - firsts[:-1], mask=start < 0),
                ],
                names=[c.split()[0] for c in HITS.split(", ")],
            )
        release()

    return run


def _merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Disjoint ranges that cover the same words, in order."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return np.stack([starts[new], reach[np.r_[new[1:] - 1, len(starts) - 1]]], 1)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, n_words, items, starts, ends, longest, start in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "items", "starts", "ends", "longest", "longest_start")), strict=True):
            ranges = _merged(np.array([x for part in starts for x in part], np.int64), np.array([x for part in ends for x in part], np.int64))
            names = sorted({x for part in items for x in part})
            out.append((doc, n_words, int((ranges[:, 1] - ranges[:, 0]).sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2, longest, start))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=[c.split()[0] for c in REPORT.split(", ")])


def benchmark_blocks(benchmark: DataFrame, window: int = 8, block_bytes: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The items in blocks of about block_bytes; one block is on the driver at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null")
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text.encode())
        if size >= block_bytes:
            yield compile_items(held, window)
            held, size = [], 0
    if held:
        yield compile_items(held, window)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_start.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. An item's windows are its runs of `window` words;
    an item with fewer words, but not none, is one window. n_hit counts the words inside any occurrence of a window,
    n_items the items with an occurring window; contaminated means two items or more. longest is the number of words
    of the longest verbatim match with an item, longest_start its first word in the document (the first of equals; 0
    and null without a match). A null text has no words; null items or item texts match nothing; items that repeat an
    id count once. Repeated documents each get their row. A text is searched whole: one beyond the size of a shard is a
    shard of its own. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = benchmark_blocks(benchmark, window, block_bytes)
    first = next(blocks, None) or compile_items([], window)
    second = next(blocks, None)
    if second is None:
        return rows.mapInArrow(_report(spark.sparkContext.broadcast(first)), REPORT)
    numbered_rows = rows.withColumn("row", F.monotonically_increasing_id())
    parts, block = [], first
    while block is not None:
        parts.append(staged(numbered_rows.mapInArrow(_hits(spark.sparkContext.broadcast(block)), HITS), "hits"))
        block, second = second, next(blocks, None)
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    lists = [F.collect_list(c).alias(c) for c in ("items", "starts", "ends")]  # one entry a block
    top = F.max(F.struct("longest", (-F.col("longest_start")).alias("s")))
    merged = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists, top.alias("top"))
    return merged.select("doc_id", "n_words", "items", "starts", "ends", F.col("top.longest").alias("longest"), (-F.col("top.s")).alias("longest_start")).mapInArrow(_combined, REPORT)


def _longest(shared, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        item_of = bench.item_of
        start = np.flatnonzero(bench.words != 0)
        ends = (bench.firsts[1:] - 1)[item_of[start]]
        start, ends = start[ends - start >= least], ends[ends - start >= least]
        for batch, i, _, firsts, (numbers,) in _shards(batches, [bench]):
            shard = Shard(numbers, firsts, least)
            size = shard.longest(bench.words, start, ends)
            use = size >= least
            low, high = shard.search(bench.words, start[use], size[use])
            count = high - low
            which = np.repeat(np.flatnonzero(use), count)
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place = shard.place[shard.array[at]]
            doc = np.searchsorted(firsts, place, side="right") - 1
            item = item_of[start[which]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc + i)), pa.array(place - firsts[doc]), pa.array([bench.ids[x] for x in item.tolist()], pa.string()), pa.array(start[which] - bench.firsts[item]), pa.array(size[which])],
                names=["doc_id", "doc_word", "item_id", "item_word", "length"],
            )

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per shard and item suffix of at least `least` words, the longest verbatim match and all its locations."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in benchmark_blocks(benchmark):
        part = rows.mapInArrow(_longest(docs.sparkSession.sparkContext.broadcast(block), least), MATCHES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCHES)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, least_item: int = LEAST_ITEM) -> DataFrame:
    """docs without the documents that hold a benchmark passage verbatim, with all their columns.

    A passage is a match of `window` words or more, or a whole shorter item of least_item words or more. Documents with
    matches of two items go as well, if one of them has two words or more; scattered single words never count. Rows with
    a null doc_id stay; rows of one doc_id go together.
    """
    found = contamination(docs, benchmark, id_col, text_col, window)
    bad = (F.col("longest") >= min(least_item, window)) | (F.col("contaminated") & (F.col("longest") >= 2))
    gone = staged(found.where(bad & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return without(docs, gone, id_col)
