"""Set-similarity join on word shingles with signature trees; exact.

1. Every text becomes its set of shingle hashes. Equal sets are one class, so copies are never paired.
2. In any common order of tokens, the first n - ceil(t n) + 1 tokens of two sets that link have at least
   ceil(t / (1 + t) (m + n)) - ceil(t max(m, n)) + 1 in common. A sketch of all tokens (of bounded size) puts frequent ones
   last. Tokens meet in buckets, where pairs of comparable size are counted; a token of more than DENSE sets
   joins them as a star instead; if one task has so many, it makes the star itself and hands on few of its sets. Pairs
   with enough counts, and stars, make blocks (components of these edges):
   sets that link are in one block.
3. Blocks are packed or cut into tiles of a bounded number of sets. In a tile, signature trees (nodes with OR-combined
   bitmaps and size ranges) are traversed in pairs; what the largest possible overlap leaves is verified exactly. A
   tile returns a forest of its links, never all pairs.
4. Components of the links give each class its group.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.common import UnionFind, attach, batch_rows, components, release, small_or_shuffled, staged, text_bytes, without
from spindrel.llm.words import shingle_sets

#: Bits of the finest token sketch, blocks in which it is added up (bits), and tokens that a task holds for it. The
#: sketch is folded to LOAD tokens a counter: 1 MB to 64 MB come to the driver and go to the tasks.
FINEST, BLOCK_BITS, SKETCHED, LOAD = 26, 6, 2_000_000, 16
#: Postings that a task holds before it hands them on, and those that a bucket is meant to hold.
FLUSH, BUCKET = 750_000, 500_000
#: Sets of a tile's side: a share of all candidates within these bounds; and its tokens.
TILE_LEAST, TILE_MOST, TILE_TOKENS = 256, 2048, 1_500_000
#: Bits of a signature, sets of a leaf, and children of a node.
BITS, LEAF, FAN = 2048, 16, 8
#: Words of an exact bit matrix row; beyond it pairs are verified one by one.
MATRIX_WORDS = 1024
#: Sets with a common token up to which their pairs are counted.
DENSE = 32
#: Pairs that a traversal holds at a time, rows and bytes of an Arrow batch of sets.
FRONT, ROWS, BYTES = 1 << 19, 256, 4 << 20


def _set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _scan(size: int):
    """(doc_id, n, set_key) of each text; in between, counts of the task's tokens by sketch block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, waiting = [], 0
        for batch in batches:
            n, keys = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, tokens in shingle_sets(*text_bytes(batch.column(1)), size):
                n[i] = len(tokens)
                if len(tokens):
                    keys[i] = _set_key(tokens)
                    if keys[i] not in seen:  # a copy in the same task counts once
                        seen.add(int(keys[i]))
                        held.append((tokens >> np.uint64(64 - FINEST)).astype(np.uint32))
                        waiting += len(tokens)
                        if waiting >= SKETCHED:
                            yield from _sketched(held)
                            held, waiting = [], 0
            yield _slim(batch.column(0), batch.column(2), pa.array(n), pa.array(keys), None, None)
        if held:
            yield from _sketched(held)
        del held
        release()

    return run


def _sketched(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Steps between the counters in use, their counts and the first of them, block by block."""
    place, count = np.unique(np.concatenate(held), return_counts=True)
    inner = FINEST - BLOCK_BITS
    cut = np.searchsorted(place >> inner, np.arange((1 << BLOCK_BITS) + 1))
    for block, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            at = place[a:b] & np.uint32((1 << inner) - 1)
            packed = zlib.compress(np.r_[np.diff(at, prepend=at[:1]), count[a:b], at[:1]].astype(np.uint32).tobytes(), 1)
            yield _slim(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([0]), pa.array([0]), block, packed)


def _slim(ids, nameless, n, keys, block, counts) -> pa.RecordBatch:
    m = len(n)
    return pa.RecordBatch.from_arrays([ids, nameless, n, keys, pa.array([block] * m, pa.int32()), pa.array([counts] * m, pa.binary())], names=["doc_id", "nameless", "n", "set_key", "block", "counts"])


def _levels(mean: float, fold: int):
    """Each folded counter as a level, one byte: how many times its count doubles the mean."""
    width = 1 << (FINEST - BLOCK_BITS - fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(zlib.decompress(counts), np.uint32)
                steps, number = values[: len(values) // 2], values[len(values) // 2 : -1]
                at = (np.cumsum(steps, dtype=np.int64) + int(values[-1])) >> fold
                sums[block] = sums.get(block, 0) + np.bincount(at, number, width)
        for block, total in sums.items():
            level = np.clip(np.log2(np.maximum(total, 1) / max(mean, 1)), 0, 15).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()])], names=["block", "levels"])

    return run


def _postings(size: int, percent: int, levels, bits: int, buckets: int):
    """The prefix of each distinct set of the task, dealt to buckets: a row per bucket holds packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        waiting = 0
        for batch in batches:
            for _, tokens in shingle_sets(*text_bytes(batch.column(1)), size):
                if not len(tokens) or (key := _set_key(tokens)) in seen:
                    continue
                seen.add(key)
                order = (level[tokens >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(60)) | (tokens & np.uint64((1 << 60) - 1))
                p = len(tokens) - _needed(len(tokens), percent) + 1
                if p < len(order):
                    order = np.partition(order, p - 1)[:p]
                held.append((order, key, len(tokens)))
                waiting += p
                if waiting >= FLUSH:
                    yield from _dealt(held, buckets, percent)
                    held, waiting = [], 0
        if held:
            yield from _dealt(held, buckets, percent)
        del held
        release()

    return run


#: Marks the size of a set that stands for a star that its task made.
STAR = 1 << 31


def _stars(tokens: np.ndarray, keys: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, which of it go on, edges, which of it are of stars): a token that more than DENSE sets of the task have becomes stars of sets whose
    sizes have no gap that a link can't bridge. Of such a star the least and largest set of each size band go on: no two
    of them in a row are further apart than a link allows, so the buckets see the same gaps."""
    order = np.lexsort((keys, sizes, tokens))
    token, size, key = tokens[order], sizes[order].astype(np.int64), keys[order]
    head = np.r_[True, token[1:] != token[:-1]]
    dense = np.diff(np.r_[np.flatnonzero(head), len(token)])[np.cumsum(head) - 1] > DENSE
    cut = head | np.r_[True, percent * size[1:] > 100 * size[:-1]]
    first = np.flatnonzero(cut)[np.cumsum(cut) - 1]
    rest = np.flatnonzero(dense & ~cut)
    edges = np.unique(np.stack([key[first[rest]], key[rest]], 1), axis=0)
    band = np.floor(np.log(np.maximum(size, 1)) / (0.99 * np.log(100 / percent))) if percent < 100 else size
    begins = cut | np.r_[True, band[1:] != band[:-1]]
    return order, ~dense | begins | np.r_[begins[1:], True], edges, dense


def _dealt(held: list, buckets: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Postings by bucket; the edges of the task's stars go along in buckets below 0."""
    lengths = np.fromiter((len(x[0]) for x in held), np.int64, len(held))
    tokens = np.concatenate([x[0] for x in held])
    keys = np.repeat(np.fromiter((x[1] for x in held), np.int64, len(held)), lengths)
    sizes = np.repeat(np.fromiter((x[2] for x in held), np.uint32, len(held)), lengths)
    order, on, edges, dense = _stars(tokens, keys, sizes, percent)
    tokens, keys, sizes = tokens[order][on], keys[order][on], (sizes[order] | (dense * np.uint32(STAR)).astype(np.uint32))[on]
    spot = (tokens & np.uint64(0xFFFFFFF)) % np.uint64(buckets)
    short = ((tokens >> np.uint64(28)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort(spot, kind="stable")
    spot, short, keys, sizes = spot[order], short[order], keys[order], sizes[order]
    names = ["bucket", "tokens", "set_keys", "sizes"]
    at = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1], True])
    for lo in range(0, len(at) - 1, 64):
        some = list(zip(at[lo : lo + 65][:-1].tolist(), at[lo : lo + 65][1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([int(spot[a]) for a, _ in some], pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in some], pa.binary()) for x in (short, keys, sizes))], names=names)
    for lo in range(0, len(edges), 65536):
        some = np.ascontiguousarray(edges[lo : lo + 65536].T)
        yield pa.RecordBatch.from_arrays([pa.array([-1 - int(some[1, 0] % buckets)], pa.int64()), pa.array([some[1].tobytes()], pa.binary()), pa.array([some[0].tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=names)


def _candidates(percent: int):
    """Pairs (a, b) of comparable size with the number of tokens seen in common and the number needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for bucket, t, k, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket >= 0:
                    parts.append((np.full(len(k) // 8, bucket, np.uint64), np.frombuffer(t, np.uint32), np.frombuffer(k, np.int64), np.frombuffer(s, np.uint32)))
                else:  # edges that are certain to be needed
                    a, b = np.frombuffer(k, np.int64), np.frombuffer(t, np.int64)
                    yield _pairs(np.stack([a, b, np.zeros_like(a), np.ones_like(a)], 1))
        if not parts:
            return
        bucket, token, keys, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        token = (bucket << np.uint64(32)) | token
        order = np.argsort(token, kind="stable")
        token, keys, sizes = token[order], keys[order], sizes[order]
        same = token[1:] == token[:-1]
        live = np.r_[same, False] | np.r_[False, same]
        token, keys, sizes = token[live], keys[live], sizes[live].astype(np.int64)
        star, sizes = sizes >= STAR, sizes & (STAR - 1)
        order = np.lexsort((keys, sizes, token))
        token, keys, sizes, star = token[order], keys[order], sizes[order], star[order]
        if not len(token):
            return
        head = np.r_[True, token[1:] != token[:-1]]
        star = np.logical_or.reduceat(star, np.flatnonzero(head))[np.cumsum(head) - 1]
        fresh = np.ones(len(token), bool)  # copies from several tasks
        fresh[1:] = (token[1:] != token[:-1]) | (keys[1:] != keys[:-1])
        token, keys, sizes, star = token[fresh], keys[fresh], sizes[fresh], star[fresh]
        head = np.r_[True, token[1:] != token[:-1]]
        members = np.diff(np.r_[np.flatnonzero(head), len(token)])[np.cumsum(head) - 1]
        dense = star | (members > DENSE)
        # Stars: sizes in order, a new one wherever the next set is too large for all before it.
        head |= np.r_[True, percent * sizes[1:] > 100 * sizes[:-1]]
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        at = np.flatnonzero(dense & (first != np.arange(len(token))))
        pairs = [np.unique(np.stack([keys[first[at]], keys[at], np.zeros_like(at), np.ones_like(at)], 1), axis=0)]
        at = np.flatnonzero(~dense)
        x, y = [], []
        for step in range(1, DENSE):
            at = at[at + step < len(token)]
            at = at[(token[at + step] == token[at]) & (percent * sizes[at + step] <= 100 * sizes[at])]
            if not len(at):
                break
            x.append(at)
            y.append(at + step)
        if x:
            x, y = np.concatenate(x), np.concatenate(y)
            needed = -(-percent * (sizes[x] + sizes[y]) // (100 + percent)) + percent * sizes[y] // -100 + 1
            swap = keys[x] > keys[y]
            both = np.stack([np.where(swap, keys[y], keys[x]), np.where(swap, keys[x], keys[y])], 1)
            order = np.lexsort((both[:, 1], both[:, 0]))
            both, needed = both[order], needed[order]
            cut = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(1)])
            pairs.append(np.column_stack([both[cut], needed[cut], np.diff(np.r_[cut, len(both)])]))
        for some in pairs:
            yield _pairs(some)

    return run


def _pairs(some: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[:, c]).astype(np.int64)) for c in range(4)], names=["a", "b", "needed", "seen"])


def _full_sets(size: int):
    """The tokens of the texts that stand for their class; a row of another text with the same doc_id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("set_key").to_numpy(zero_copy_only=False)
            rows, sets = [], []
            for i, tokens in shingle_sets(*text_bytes(batch.column("text")), size):
                if len(tokens) and _set_key(tokens) == wanted[i]:
                    rows.append(i)
                    sets.append(tokens.tobytes())
                if len(rows) and (len(rows) == ROWS or sum(map(len, sets)) >= BYTES):
                    yield _taken(batch, rows, sets)
                    rows, sets = [], []
            yield _taken(batch, rows, sets)

    return run


def _taken(batch: pa.RecordBatch, rows: list[int], sets: list[bytes]) -> pa.RecordBatch:
    kept = batch.select(["set_key", "root", "chunk"]).take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], names=["set_key", "root", "chunk", "tokens"])


class SignatureTree:
    """Levels of nodes over sets that are sorted by block and size; level 0 has a node for each set."""

    def __init__(self, sets: list[np.ndarray], roots: np.ndarray) -> None:
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        at = np.concatenate(sets) & np.uint64(BITS - 1) if len(sets) else np.zeros(0, np.uint64)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), n), (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
        slack = n - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, n, n, slack, roots, roots)]
        for fan in (LEAF, *[FAN] * 12):
            bits, low, high, slack, first, last = self.levels[-1]
            if len(low) == 1:
                break
            cut = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut), np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)))


def dual_traversal(tree: SignatureTree, percent: int, cross: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets x < y that may link, with the largest overlap that the bitmaps leave possible.

    cross: only pairs with x before this index and y from it on.
    """
    top = len(tree.levels) - 1
    work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        level, i, j = work.pop()
        if len(i) > FRONT // 16:
            work += [(level, i[FRONT // 16 :], j[FRONT // 16 :])]
            i, j = i[: FRONT // 16], j[: FRONT // 16]
        bits, low, high, slack, first, last = tree.levels[level]
        ok = (first[i] <= last[j]) & (first[j] <= last[i]) & (percent * low[i] <= 100 * high[j]) & (percent * low[j] <= 100 * high[i])
        i, j = i[ok], j[ok]
        most = np.minimum(np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(slack[i], slack[j]), np.minimum(high[i], high[j]))
        ok = most * (100 + percent) >= percent * (low[i] + low[j])
        i, j, most = i[ok], j[ok], most[ok]
        if level == 0:
            ok = i < j
            yield i[ok], j[ok], most[ok]
            continue
        fan, below = LEAF if level == 1 else FAN, len(tree.levels[level - 1][1])
        step = np.arange(fan)
        for at in range(0, len(i), FRONT // fan**2):
            some = slice(at, at + FRONT // fan**2)
            ii = np.repeat((i[some, None] * fan + step), fan, axis=1).ravel()
            jj = np.tile((j[some, None] * fan + step), (1, fan)).ravel()
            ok = (ii < below) & (jj < below) & (ii <= jj)
            if cross is not None and level == 1:
                ok &= (ii < cross) & (jj >= cross)
            work.append((level - 1, ii[ok], jj[ok]))


def tile_links(keys: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int, cross: int | None = None) -> list[tuple[int, int]]:
    """A forest of the links between the sets; each side must be sorted by root and size."""
    found: list[tuple[int, int]] = []
    union = UnionFind(len(sets))
    matrix = _matrix(sets)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    for i, j, most in dual_traversal(SignatureTree(sets, roots), percent, cross):
        order = np.argsort(-most / (n[i] + n[j]), kind="stable")  # likely links first: what they join is skipped
        i, j = i[order], j[order]
        for at in range(0, len(i), 512):
            pairs = [(x, y) for x, y in zip(i[at : at + 512].tolist(), j[at : at + 512].tolist(), strict=True) if union.find(x) != union.find(y)]
            if not pairs:
                continue
            x, y = np.array(pairs).T
            if matrix is not None:
                both = np.bitwise_count(matrix[x] & matrix[y]).sum(1, dtype=np.int64)
            else:
                both = np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs), np.int64, len(pairs))
            for a, b in np.stack([x, y], 1)[100 * both >= percent * (n[x] + n[y] - both)].tolist():
                if union.join(a, b):
                    found.append((int(keys[a]), int(keys[b])))
    return found


def _matrix(sets: list[np.ndarray]) -> np.ndarray | None:
    """Exact bit rows over the tokens that at least two of the sets have; None if there are too many of them."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    token, place, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    width = int(shared.sum())
    if width > 64 * MATRIX_WORDS:
        return None
    column = np.cumsum(shared) - 1
    use = shared[place]
    at = column[place][use]
    matrix = np.zeros((len(sets), width // 64 + 1), np.uint64)
    np.bitwise_or.at(matrix, (np.repeat(np.arange(len(sets)), lengths)[use], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return matrix


def _tiles(percent: int):
    """Links of each tile; rows come sorted by tile."""

    def solve(rows: list) -> pa.RecordBatch:
        unique = {(side, key): (side, root, len(tokens), key, tokens) for side, root, key, tokens in rows}
        ordered = sorted(unique.values(), key=lambda x: x[:4])
        sets = [np.frombuffer(x[4], np.uint64) for x in ordered]
        left = sum(x[0] == 0 for x in ordered)
        links = tile_links(np.array([x[3] for x in ordered]), np.array([x[1] for x in ordered]), sets, percent, left if left < len(ordered) else None) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for tile, side, root, key, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != now:
                    if rows:
                        yield solve(rows)
                    now, rows = tile, []
                rows.append((side, root, key, tokens))
        if rows:
            yield solve(rows)
        del rows
        release()

    return run


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a set holds the distinct shingles of `size` words (at most 5),
    or the whole sequence if it is shorter. Sets link when 100 * intersection >= percent * union; component_id is the
    least doc_id that links reach, the row's own included. A null or blank text has an empty set and no link. Rows that
    repeat a doc_id are compared like all others, and so are rows without one; component_id is null where a group has no
    other. Texts are read whole. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("nameless", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))  # how a row without an id is found again
    scanned = staged(docs.mapInArrow(_scan(size), "doc_id long, nameless long, n long, set_key long, block int, counts binary"), "sets")
    slim = scanned.where("block is null").select("doc_id", "nameless", "n", "set_key")
    rows, tokens = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    fold = max(0, FINEST - max(20, int(np.ceil(np.log2(max(1, tokens) / LOAD)))))
    bits = FINEST - fold
    width = 1 << (bits - BLOCK_BITS)
    levels = bytearray(1 << bits)
    for block, part in scanned.where("block is not null").select("block", "counts").repartition(1 << BLOCK_BITS, "block").mapInArrow(_levels(tokens / (1 << bits), fold), "block int, levels binary").toLocalIterator():
        levels[block * width : (block + 1) * width] = part
    table = spark.sparkContext.broadcast(bytes(levels))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens * (1 - percent / 100) / BUCKET) + 1)
    postings = docs.mapInArrow(_postings(size, percent, table, bits, buckets), "bucket long, tokens binary, set_keys binary, sizes binary")
    pairs = postings.repartition(buckets, "bucket").mapInArrow(_candidates(percent), "a long, b long, needed long, seen long")
    edges = pairs.groupBy("a", "b").agg(F.min("needed").alias("needed"), F.sum("seen").alias("seen")).where("seen >= needed").select("a", "b")
    blocks = components(edges, "blocks")
    classes = staged(slim.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("nameless").alias("nameless"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "classes", rows)
    live = staged(classes.join(blocks.withColumnRenamed("node", "set_key"), "set_key").select("set_key", "least", "nameless", "n", "root"), "live", rows)

    def sets(spots: DataFrame, rows: int) -> DataFrame:
        columns = ["text", "set_key", "root", "chunk"]
        found = docs.join(small_or_shuffled(spots.drop("nameless"), rows), "doc_id").select(*columns)
        unnamed = spots.where("doc_id is null").drop("doc_id")
        if not unnamed.isEmpty():
            found = found.unionByName(docs.where("doc_id is null").join(small_or_shuffled(unnamed, rows), "nameless").select(*columns))
        return found.mapInArrow(_full_sets(size), "set_key long, root long, chunk long, tokens binary")

    links = block_links(live.withColumnRenamed("least", "doc_id"), ["doc_id", "nameless"], sets, percent)
    grouped = staged(classes.join(components(links, "links").withColumnRenamed("node", "set_key"), "set_key").select("set_key", "least", "root"), "grouped", rows)
    heads = grouped.groupBy("root").agg(F.min("least").alias("head"), F.count(F.lit(1)).alias("members"))
    total = grouped.count()
    found = attach(grouped.select("set_key", "root"), staged(heads, "heads", total), "root", "members", max(1, total)).select("set_key", "head")
    named = staged(classes.join(found, "set_key", "left").select("set_key", "copies", F.coalesce("head", "least").alias("component_id")), "named", rows)
    return attach(slim.where("n > 0"), named, "set_key", "copies", rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(slim.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def block_links(live: DataFrame, place: list[str], sets: Callable[[DataFrame, int], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) between the sets of each block; a written table.

    live has set_key, n (its size), root (its block) and the columns `place`, which tell where the set is;
    sets(spots, rows) turns rows of set_key, root, chunk and place into set_key, root, chunk, tokens.
    """
    spark = live.sparkSession
    alive = live.count()
    side = min(TILE_MOST, max(TILE_LEAST, alive // 64))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(101 / percent)))).cast("long")  # a bit wide: rounding
    per_root = staged(live.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens")), "roots", alive)
    large = (F.col("members") > side) | (F.col("tokens") > TILE_TOKENS)
    packs = max(1, alive // side + int(live.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // TILE_TOKENS))
    placed = attach(live, per_root, "root", "members", max(1, alive)).withColumns({"large": large, "band": band})
    # A large block is cut by size band, and a band with many sets by hash; only neighbouring bands can link.
    bands = placed.where("large").groupBy("root", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / side), F.ceil(F.sum("n") / TILE_TOKENS)).alias("parts"))
    bands = staged(bands, "bands", alive)
    cuts = placed.where("large").join(small_or_shuffled(bands), ["root", "band"]).withColumn("chunk", F.xxhash64("root", "band", F.pmod(F.xxhash64("set_key"), F.col("parts"))))
    whole = placed.where("not large").withColumn("chunk", F.pmod(F.xxhash64("root"), F.lit(packs)))
    columns = ["set_key", *place, "root", "chunk"]
    spots = staged(whole.select(*columns).unionByName(cuts.select(*columns)), "spots", alive)
    pieces = bands.select("root", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("root", "band", F.xxhash64("root", "band", F.col("part").cast("long")).alias("chunk"))
    other = pieces.select("root", F.col("band").alias("band2"), F.col("chunk").alias("chunk2"))
    across = pieces.join(other, "root").where("abs(band - band2) <= 1 and chunk < chunk2").select("chunk", "chunk2")
    alone = spots.select("chunk", F.col("chunk").alias("chunk2")).distinct()
    tiles = alone.unionByName(across).withColumn("tile", F.xxhash64("chunk", "chunk2"))
    sides = staged(tiles.select("chunk", "tile", F.lit(0).alias("side")).unionByName(tiles.where("chunk <> chunk2").select(F.col("chunk2").alias("chunk"), "tile", F.lit(1).alias("side"))), "sides")
    dealt = sets(spots, alive).join(small_or_shuffled(sides), "chunk").select("tile", "side", "root", "set_key", "tokens")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packs)
    with batch_rows(spark, ROWS):
        return staged(dealt.repartition(count, "tile").sortWithinPartitions("tile").mapInArrow(_tiles(percent), "a long, b long"), "links")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, the one with the least doc_id; rows with a null doc_id stay."""
    gone = staged(similar_groups(docs, id_col, text_col, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct(), "near-copies")
    return without(docs, gone, id_col)
