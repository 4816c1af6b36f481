"""Substring dedup by paragraphs: MinHash banding, exact verification, removal by components.

Paragraphs are lines. Equal ones (by words) are one class. Classes that collide in a band of MinHash values make
blocks; in a block, signature-tree tiles verify the exact Jaccard similarity of the word shingles. Each component of
verified links keeps its first paragraph; where a run of repeated paragraphs of a document is long enough, it goes.

Verbatim passages don't stop at lines. Every window of RUN_WORDS words has a MinHash value, its least shingle: copies
of a window share it and its place. Windows whose least shingle occurs again anywhere are compared by their words;
all but the first of equal ones are repeats, whose words go, wherever lines begin or end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.llm import words as W
from spindrel.llm.common import attach, components, release, slices, small_or_shuffled, staged, text_bytes
from spindrel.llm.sigtree import block_links

#: 10 bands of 3 values: of pairs with a similarity of 0.8, 1 - (1 - 0.8 ** 3) ** 10 = 0.9992 collide.
BANDS, BAND_ROWS = 10, 3
#: Shortest paragraph that can be a repeat, in words, and shortest run of them that goes.
LEAST_WORDS, RUN_WORDS = 8, 50
#: Words of a passage's shingles: shorter ones occur again by chance too often.
SHINGLE = 16
FLUSH, BUCKET = 750_000, 500_000
#: Least id of a further text of a doc_id; ids of documents must be below it.
APART = 1 << 62
_A = np.random.default_rng(77).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(78).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
PARAGRAPHS = "doc_id long, paragraph int, words int, shingles int, set_key long"
SEGMENTS = "doc_id long, start long, windows long, keep_doc_id long, keep_start long, keep_paragraph long, copies long"
REPEATS = "doc_id long, paragraph int, first_word int, words int, keep_doc_id long, keep_paragraph int, copies long"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def freed(step):
    """The step of a task, whose memory goes back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        release()

    return run


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each paragraph, its number there, word hashes, first word of each paragraph and the end)."""
    inner = np.flatnonzero(data == 10) + 1
    text = np.r_[np.arange(len(offsets) - 1), np.searchsorted(offsets, inner - 1, side="right") - 1]
    start = np.r_[offsets[:-1], inner]
    order = np.lexsort((np.r_[np.zeros(len(offsets) - 1, int), np.ones(len(inner), int)], start, text))
    text, start = text[order], start[order]
    number = np.arange(len(text)) - np.searchsorted(text, text)
    hashes, firsts = W.hashed(data, np.r_[start, len(data)], W.SPACED)
    return text, number, hashes, firsts


def keys(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's word sequence."""
    up, down = W._power(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    a, b = firsts[:-1], firsts[1:]
    return W.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)


def shingled(hashes: np.ndarray, firsts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of the chosen paragraphs, first shingle of each and the end); each has at least 5 words."""
    count = (np.diff(firsts) - 4)[chosen]
    bounds = np.r_[0, np.cumsum(count)]
    at = np.repeat(firsts[:-1][chosen] - bounds[:-1], count) + np.arange(bounds[-1])
    return W.shingles(hashes)[at] if len(at) else np.zeros(0, np.uint64), bounds


def _rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, W.CHUNK):
                part = offsets[i : j + 1]
                text, number, hashes, firsts = paragraphs(data[part[0] : part[-1]], part - part[0])
                size = np.diff(firsts)
                use = np.flatnonzero(size >= least)
                shingle, bounds = shingled(hashes, firsts, use)
                owner = np.repeat(np.arange(len(use)), np.diff(bounds))
                order = np.lexsort((shingle, owner))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (shingle[order][1:] != shingle[order][:-1])
                distinct = np.bincount(owner[order][fresh], minlength=len(use))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text[use] + i)), pa.array(number[use], pa.int32()), pa.array(size[use], pa.int32()), pa.array(distinct, pa.int32()), pa.array(keys(hashes, firsts)[use])],
                    names=[c.split()[0] for c in PARAGRAPHS.split(", ")],
                )

    return run


def minhashes(shingle: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band hashes, a row for each paragraph."""
    out = np.empty((len(bounds) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(bounds) - 1, band + 1, np.uint64)
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            x = shingle * _A[k] + _B[k]
            x ^= x >> np.uint64(31)
            value = value * W._WEIGHTS[1] + np.minimum.reduceat(x * W._M2, bounds[:-1])
        out[:, band] = W.mix(value)
    return out


def _bands(least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, seen = [], 0, np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, W.CHUNK):
                part = offsets[i : j + 1]
                _, _, hashes, firsts = paragraphs(data[part[0] : part[-1]], part - part[0])
                key = keys(hashes, firsts)
                use = np.flatnonzero(np.diff(firsts) >= least)
                use = use[np.unique(key[use], return_index=True)[1]]
                if not len(use):
                    continue
                held.append((key[use], minhashes(*shingled(hashes, firsts, use))))
                waiting += len(use) * BANDS
                if waiting >= FLUSH:
                    yield from _dealt(held, buckets)
                    held, waiting = [], 0
        if held:
            yield from _dealt(held, buckets)

    return run


def _dealt(held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Band values by bucket. Classes of the task with one value are a star at once: its first class alone goes to the
    bucket, so that a value that very many classes have is one posting a task there. Edges go along in buckets below 0."""
    key, at = np.unique(np.concatenate([k for k, _ in held]), return_index=True)
    bands = np.concatenate([b for _, b in held])[at]
    flat, key = bands.ravel(), np.repeat(key, BANDS)
    order = np.lexsort((key, flat))
    flat, key = flat[order], key[order]
    head = np.r_[True, flat[1:] != flat[:-1]]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    edges = np.unique(np.stack([key[first], key], 1)[~head], axis=0)
    flat, key = flat[head], key[head]
    spot = np.r_[(flat % np.uint64(buckets)).astype(np.int64), -1 - (edges[:, 1] % buckets)]
    yield from _packed(spot, [np.r_[flat.view(np.int64), edges[:, 0]], np.r_[key, edges[:, 1]]])


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each band value as a star of the classes that have it, and the stars that tasks made."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    made: list[np.ndarray] = []
    for batch in batches:
        for bucket, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            (parts if bucket >= 0 else made).append((x, y) if bucket >= 0 else np.stack([x, y], 1))
    if parts:
        band, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((key, band))
        band, key = band[order], key[order]
        first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        least = np.repeat(key[first], np.diff(np.r_[first, len(band)]))
        made.append(np.stack([least, key], 1)[least != key])
    if made:
        edges = np.unique(np.concatenate(made), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1]))], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the wanted paragraphs of each text."""
    names = ["set_key", "root", "chunk", "tokens"]
    for batch in batches:
        rows: list[tuple] = []
        data, offsets = text_bytes(batch.column("text"))
        for k, wanted in enumerate(batch.column("wanted").to_pylist()):
            one = offsets[k : k + 2]
            _, number, hashes, firsts = paragraphs(data[one[0] : one[1]], one - one[0])
            found = keys(hashes, firsts)
            for w in wanted:
                if w["paragraph"] < len(number) and found[w["paragraph"]] == w["set_key"]:
                    shingle, _ = shingled(hashes, firsts, np.array([w["paragraph"]]))
                    rows.append((w["set_key"], w["root"], w["chunk"], np.unique(shingle).tobytes()))
            if len(rows) >= 256:
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array([r[3] for r in rows], pa.binary())], names=names)
                rows = []
        yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array([r[3] for r in rows], pa.binary())], names=names)


def least_shingles(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window of `size` words, its least shingle's first word, shingles); firsts: of each text."""
    words = min(SHINGLE, size)
    shingle = window_keys(hashes, np.arange(max(0, len(hashes) - words + 1)), words)
    count = np.maximum(np.diff(firsts) - size + 1, 0)
    start = np.repeat(firsts[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    width, reach = size - words + 1, 1
    at = np.arange(len(shingle))
    while reach < width:  # at[i]: the leftmost least one of the `reach` shingles from i on
        step = min(reach, width - reach)
        a, b = at[:-step], at[step:]
        at, reach = np.where(shingle[b] < shingle[a], b, a), reach + step
        if not len(at):
            break
    return start, at[start] if len(start) else start, shingle


def window_keys(hashes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A hash of the words of each window."""
    up, down = W._power(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return W.mix((sums[start + size] - sums[start]) * down[start])


def _packed(spot: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns' values bucket by bucket, one row each."""
    order = np.argsort(spot, kind="stable")
    spot, columns = spot[order], [np.ascontiguousarray(c[order]) for c in columns]
    cut = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1], True]) if len(spot) else np.zeros(1, int)
    for lo in range(0, len(cut) - 1, 64):
        some = list(zip(cut[lo : lo + 65][:-1].tolist(), cut[lo : lo + 65][1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([int(spot[a]) for a, _ in some], pa.int64()), *(pa.array([c[a:b].tobytes() for a, b in some], pa.binary()) for c in columns)], names=["bucket", *(f"c{k}" for k in range(len(columns)))])


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    held: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for k, kind in enumerate(kinds):
            held[k] += [np.frombuffer(x, kind) for x in batch.column(k + 1).to_pylist()]
    return [np.concatenate(h) if h else np.zeros(0, kind) for h, kind in zip(held, kinds, strict=True)]


def _flushed(parts: Iterator[tuple[np.ndarray, list[np.ndarray]]], combine=lambda spot, columns: (spot, columns)) -> Iterator[pa.RecordBatch]:
    held, waiting = [], 0

    def pack() -> Iterator[pa.RecordBatch]:
        return _packed(*combine(np.concatenate([s for s, _ in held]), [np.concatenate(c) for c in zip(*(c for _, c in held), strict=True)]))

    for part in parts:
        held.append(part)
        waiting += len(part[0])
        if waiting >= FLUSH:
            yield from pack()
            held, waiting = [], 0
    if held:
        yield from pack()


def _repeated_here(spot: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a shingle at several places of the task, the first place alone goes to the bucket, marked by a negative word;
    the others are known to be repeated and go along in buckets below 0."""
    shingle, doc, word = columns
    order = np.lexsort((word, doc, shingle))
    spot, shingle, doc, word = spot[order].astype(np.int64), shingle[order], doc[order], word[order].astype(np.int64)
    same = shingle[1:] == shingle[:-1]
    again, more = np.r_[False, same], np.r_[same, False]
    return np.where(again, -1 - spot, spot), [shingle, doc, np.where(more & ~again, -1 - word, word)]


def _anchors(size: int, buckets: int):
    """Least shingles of all windows, with document and word, by bucket of the shingle."""

    def parts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, W.CHUNK):
                part = offsets[i : j + 1]
                hashes, firsts = W.hashed(data[part[0] : part[-1]], part - part[0], W.SPACED)
                _, at, shingle = least_shingles(hashes, firsts, size)
                if len(at):
                    at = np.unique(at)
                    text = np.searchsorted(firsts, at, side="right") - 1
                    yield shingle[at] % np.uint64(buckets), [shingle[at], ids[text + i], at - firsts[text]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flushed(parts(batches), _repeated_here)

    return run


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of least shingles that occur at two places or more: the words of each document, packed."""
    known: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for bucket, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shingle, doc, word = (np.frombuffer(v, kind) for v, kind in zip(values, (np.uint64, np.int64, np.int64), strict=True))
            known.append((doc, word)) if bucket < 0 else held.append((shingle, doc, word))
    shingle, doc, word = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    marked, word = word < 0, np.where(word < 0, -1 - word, word)
    order = np.argsort(shingle, kind="stable")
    shingle, doc, word, use = shingle[order], doc[order], word[order], marked[order]
    same = shingle[1:] == shingle[:-1]
    use[1:] |= same
    use[:-1] |= same
    doc, word = (np.concatenate(x) for x in zip((doc[use], word[use]), *known, strict=True))
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    use = np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])][: len(doc)]
    doc, word = doc[use], word[use]
    order = np.argsort(doc, kind="stable")
    doc, word = doc[order], word[order].astype(np.int32)
    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, int)
    for lo in range(0, len(cut) - 1, 4096):
        some = cut[lo : lo + 4097]
        yield pa.RecordBatch.from_arrays([pa.array(doc[some[:-1]]), pa.array([word[a:b].tobytes() for a, b in zip(some[:-1].tolist(), some[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "places"])


def _windows(size: int, buckets: int):
    """Windows whose least shingle is at one of the document's places, by bucket of the shingle."""

    def parts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column("text"))
            for k, places in enumerate(batch.column("places").to_pylist()):
                one = offsets[k : k + 2]
                _, _, hashes, lines = paragraphs(data[one[0] : one[1]], one - one[0])
                start, at, shingle = least_shingles(hashes, np.array([0, len(hashes)]), size)
                use = np.zeros(len(shingle), bool)
                places = np.concatenate([np.frombuffer(x, np.int32) for x in places])
                use[places[places < len(shingle)]] = True
                start, at = start[use[at]], at[use[at]]
                line = np.searchsorted(lines, start, side="right") - 1
                yield shingle[at] % np.uint64(buckets), [window_keys(hashes, start, size), np.full(len(start), ids[k]), start.astype(np.int32), line.astype(np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flushed(parts(batches))

    return run


def _segments(size: int):
    """Of equal windows all but the first, and none that overlaps it; neighbours with one common shift or line are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, start, line = _unpacked(batches, [np.uint64, np.int64, np.int32, np.int32])
        order = np.lexsort((start, doc, key))
        key, doc, start, line = key[order], doc[order], start[order].astype(np.int64), line[order].astype(np.int64)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
        key, doc, start, line = key[fresh], doc[fresh], start[fresh], line[fresh]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        copies = np.diff(np.r_[head, len(key)])
        head, copies = np.repeat(head, copies), np.repeat(copies, copies)
        use = np.flatnonzero((doc != doc[head]) | (start >= start[head] + size))
        order = use[np.lexsort((start[use], doc[use]))]
        head, copies = head[order], copies[order]
        doc, start, to, at, line = doc[order], start[order], doc[head], start[head], line[head]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (to[1:] != to[:-1]) | (start[1:] != start[:-1] + 1) | ((at[1:] != at[:-1] + 1) & (line[1:] != line[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(doc)])
        most = np.maximum.reduceat(copies, first) if len(first) else first
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first], start[first], count, to[first], at[first], line[first], most)], names=[c.split()[0] for c in SEGMENTS.split(", ")])

    return run


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First word of each line of a text and the end, packed."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in slices(offsets, W.CHUNK):
            part = offsets[i : j + 1]
            text, _, _, firsts = paragraphs(data[part[0] : part[-1]], part - part[0])
            cut = np.searchsorted(text, np.arange(j - i + 1)).tolist()
            lines = [(firsts[a : b + 1] - firsts[a]).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lines, pa.binary())], names=["doc_id", "lines"])


def _pieces(size: int):
    """The words of each document's segments, each word once, cut where lines end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, lines, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lines", "found")), strict=True):
                lines = np.frombuffer(lines, np.int32)
                passages: list[list[int]] = []  # first word, end, keeper's document, line and shift, copies
                for x in sorted(found, key=lambda x: (x["start"], x["keep_doc_id"], x["keep_start"])):
                    end, shift, now = x["start"] + x["windows"] + size - 1, x["keep_start"] - x["start"], passages[-1] if passages else None
                    if now and x["start"] <= now[1] and x["keep_doc_id"] == now[2] and (shift == now[4] or x["keep_paragraph"] == now[3]):
                        now[1], now[4], now[5] = max(now[1], end), shift, max(now[5], x["copies"])
                    else:
                        passages.append([x["start"], end, x["keep_doc_id"], x["keep_paragraph"], shift, x["copies"]])
                done = 0
                for first, end, to, line, _, copies in passages:
                    a, end = max(first, done), min(end, int(lines[-1]))
                    while a < end:
                        at = int(np.searchsorted(lines, a, side="right")) - 1
                        b = min(end, int(lines[at + 1]))
                        rows.append((doc, at, a - int(lines[at]), b - a, to, line, copies))
                        a = b
                    done = max(done, end)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=[c.split()[0] for c in REPEATS.split(", ")])

    return run


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Rows as of repeats for all words of verbatim passages; docs has doc_id, not null, and text."""
    run_words = max(run_words, 1)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 5
    buckets = max(least, 2 * words // (run_words - min(SHINGLE, run_words) + 2) // BUCKET + 1)
    anchors = docs.mapInArrow(freed(_anchors(run_words, buckets)), "bucket long, c0 binary, c1 binary, c2 binary").repartition(buckets, "bucket").mapInArrow(freed(_again), "doc_id long, places binary")
    places = staged(anchors.groupBy("doc_id").agg(F.collect_list("places").alias("places")), "places")
    words = places.agg(F.coalesce(F.sum(F.expr("aggregate(places, 0L, (n, x) -> n + length(x) div 4)")), F.lit(0))).first()[0]
    buckets = max(least, words * (run_words // 2) // BUCKET + 1)
    # The places grow with the corpus: texts are shuffled to them at every size.
    windows = docs.join(places.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "places").mapInArrow(freed(_windows(run_words, buckets)), "bucket long, c0 binary, c1 binary, c2 binary, c3 binary")
    segments = windows.repartition(buckets, "bucket").mapInArrow(freed(_segments(run_words)), SEGMENTS)
    found = staged(segments.groupBy("doc_id").agg(F.collect_list(F.struct(*[c.split()[0] for c in SEGMENTS.split(", ")[1:]])).alias("found")), "segments")
    lines = docs.mapInArrow(freed(_lines), "doc_id long, lines binary")  # texts stay where they are
    return lines.join(found, "doc_id").select("doc_id", "lines", "found").mapInArrow(freed(_pieces(run_words)), REPEATS)


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """The paragraphs to remove: doc_id, paragraph (from 0), words, keep_doc_id, keep_paragraph, copies.

    Paragraphs are lines of at least least_words words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased). Paragraphs are alike if
    their words are equal, or 100 * intersection >= percent * union of their 5-word shingles. Of each component of
    alike ones the first by (doc_id, paragraph) stays. A later one goes if it is in a run of such paragraphs of its
    document, with nothing but shorter lines between, of run_words words or more. Null and empty texts have no
    paragraphs. Rows with a null doc_id are left alone. Repeated rows of one doc_id count as one document.
    """
    if least_words < 5:
        raise ValueError("paragraphs of fewer than 5 words have no shingles")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows = staged(docs.mapInArrow(freed(_rows(least_words)), PARAGRAPHS), "paragraphs")
    total = rows.count()
    place = F.struct("doc_id", "paragraph")
    classes = staged(rows.groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"), F.max("shingles").alias("n")), "classes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * BANDS // BUCKET + 1)
    edges = docs.mapInArrow(freed(_bands(least_words, buckets)), "bucket long, c0 binary, c1 binary").repartition(buckets, "bucket").mapInArrow(freed(_colliding), "a long, b long")
    blocks = components(edges, "paragraph-blocks").withColumnRenamed("node", "set_key")
    live = staged(classes.join(blocks, "set_key").select("set_key", F.col("first.doc_id").alias("doc_id"), F.col("first.paragraph").alias("paragraph"), F.col("n").cast("long").alias("n"), "root"), "live")

    def sets(spots: DataFrame, number: int) -> DataFrame:
        wanted = staged(spots.groupBy("doc_id").agg(F.collect_list(F.struct("paragraph", "set_key", "root", "chunk")).alias("wanted")), "wanted")
        return docs.join(small_or_shuffled(wanted, number), "doc_id").select("text", "wanted").mapInArrow(freed(_sets), "set_key long, root long, chunk long, tokens binary")

    links = components(block_links(live, ["doc_id", "paragraph"], sets, percent), "paragraph-links").withColumnRenamed("node", "set_key")
    grouped = staged(classes.join(links, "set_key").select("set_key", "root", "first", "copies"), "grouped")
    heads = staged(grouped.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("members")), "heads")
    found = attach(grouped.select("set_key", "root"), heads, "root", "members", max(1, grouped.count())).select("set_key", "head", "all")
    named = staged(classes.join(found, "set_key", "left").select("set_key", "copies", F.coalesce("head", "first").alias("head"), F.coalesce("all", "copies").alias("all")).where("all > 1"), "named")
    kept = attach(rows.select("doc_id", "paragraph", "words", "set_key"), named, "set_key", "copies", max(1, total))
    # A run ends at a long enough line that isn't a repeat: number all lines of a document that has repeats.
    kept = kept.withColumn("again", F.coalesce(F.col("head") != place, F.lit(False)))
    document = Window.partitionBy("doc_id").orderBy("paragraph")
    runs = kept.withColumn("run", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(document.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum(F.when(F.col("again"), F.col("words")).otherwise(0)).over(Window.partitionBy("doc_id", "run"))
    runs = runs.withColumn("length", length).where(F.col("again") & (F.col("length") >= run_words))
    return runs.select("doc_id", "paragraph", "words", F.col("head.doc_id").alias("keep_doc_id"), F.col("head.paragraph").alias("keep_paragraph"), F.col("all").cast("long").alias("copies")).distinct()


def _told_apart(docs: DataFrame) -> DataFrame:
    """doc_id and text with an id of its own, from APART on, for each further text of a doc_id that has several; rows
    with a null doc_id are left out. The text with the least hash keeps the id."""
    docs = docs.where("doc_id is not null")
    each = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most"))
    several = staged(each.where("least <> most").select("doc_id", "least"), "several-texts")
    if several.isEmpty():
        return docs
    other = F.lit(APART) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    mine = F.col("least").isNull() | (F.col("least") == F.xxhash64("text"))
    return docs.join(small_or_shuffled(several), "doc_id", "left").select(F.when(mine, F.col("doc_id")).otherwise(other).alias("doc_id"), "text")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """The words to remove: doc_id, paragraph, first_word (from 0), words, keep_doc_id, keep_paragraph, copies.

    All of repeated_paragraphs, with first_word 0. Of the lines that stay, the words of every run of run_words words or
    more that occurs before, in an earlier document or earlier in this one and apart from it, go as well, a row for each
    line; keep_paragraph is then the line in which the copy that stays begins, copies the number of
    places. The passage may begin and end within lines, and lines may be broken elsewhere in the other copy. Several
    texts of one doc_id are documents of their own, each but one behind all others in order; rows that repeat both are
    one document. Null ids and texts have no rows; texts are read whole; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = _told_apart(docs)
    found = _repeats(own, percent, least_words, run_words)
    if own is docs or found.where(F.greatest("doc_id", "keep_doc_id") >= APART).isEmpty():
        return found
    apart = F.lit(APART) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    real = staged(docs.where("doc_id is not null").select(apart.alias("_apart"), F.col("doc_id").alias("_real")).distinct(), "real-ids")
    for name in ("doc_id", "keep_doc_id"):
        found = found.join(real.withColumnRenamed("_apart", "_key"), F.col("_key") == F.col(name), "left").withColumn(name, F.coalesce("_real", name)).drop("_key", "_real")
    return found


def _repeats(docs: DataFrame, percent: int = 80, least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """The rows of repeats, by the ids of _told_apart; a written table."""
    names = [c.split()[0] for c in REPEATS.split(", ")]
    whole = staged(repeated_paragraphs(docs, percent=percent, least_words=least_words, run_words=run_words).withColumn("first_word", F.lit(0)).select(*names), "whole-lines")
    parts = repeated_passages(docs, run_words).distinct()
    return staged(whole.unionByName(parts.join(whole.select("doc_id", "paragraph"), ["doc_id", "paragraph"], "left_anti")), "repeats")


def _without(line: str, gone: list[tuple[int, int]]) -> str | None:
    """The line without the ranges (first word, words); None if no word is left."""
    spans = [m.span() for m in _WORD.finditer(line)]
    out, at = [], 0
    for first, words in sorted(gone):
        if first < len(spans):
            out.append(line[at : spans[first][0]])
            at = spans[first + words][0] if first + words < len(spans) else len(line)
    kept = "".join([*out, line[at:]])
    return (kept.rstrip() if at == len(line) else kept) if _WORD.search(kept) else None


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            drop: dict[int, list[tuple[int, int]]] = {}
            for x in gone or ():
                drop.setdefault(x["paragraph"], []).append((x["first_word"], x["words"]))
            if drop and text is not None:
                lines = (_without(x, drop[k]) if k in drop else x for k, x in enumerate(text.split("\n")))
                text = "\n".join(x for x in lines if x is not None)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def drop_repeats(docs: DataFrame, percent: int = 80, least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id and text without the repeated words; rows of one doc_id with several texts are each cut by their own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = _told_apart(docs)
    gone = F.collect_list(F.struct("paragraph", "first_word", "words")).alias("gone")
    found = _repeats(own, percent, least_words, run_words)
    gone = staged(found.groupBy("doc_id").agg(gone), "gone")
    cut = own.join(small_or_shuffled(gone, found.count()), "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(freed(_cut), "doc_id long, text string")
    if not cut.where(F.col("doc_id") >= APART).isEmpty():
        apart = F.lit(APART) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
        real = staged(docs.where("doc_id is not null").select(apart.alias("_apart"), F.col("doc_id").alias("_real")).distinct(), "real-ids")
        cut = cut.join(real, F.col("_apart") == F.col("doc_id"), "left").select(F.coalesce("_real", "doc_id").alias("doc_id"), "text")
    return cut.unionByName(docs.where("doc_id is null"))
