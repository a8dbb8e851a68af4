"""Parts of similarity joins: MinHash bands, candidate groups, tiled exact verification, connected components.

Nothing here emits the pairs of a group. A band's bucket is verified inside tasks, block against block, and what
leaves a task are each item's number of links and a spanning forest of the links found there."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import materialize, release

#: Items of a block, and the size (shingles) from which a bucket is cut into more blocks.
BLOCK = 1024
BLOCK_SHINGLES = 2_000_000
#: Tiles of up to this many items are solved pair by pair, all those of a batch at once.
PAIRWISE = 4
#: Whole tiles are gathered up to about this many items or characters.
HELD_ROWS = 2_000
HELD_CHARS = 1 << 19
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096
#: Bits of the filter that passes over most rows when texts of candidates are read again. False hits only cost time.
FILTER_BITS = 24
#: Most bands that the choice of bands and rows may use.
MAX_BANDS = 24


def choose_bands(threshold: float, recall: float, most: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the longest bands that find a pair at the threshold with this probability, within ``most``."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands > most:
            break
        best = (max(1, bands), rows)
    return best


@functools.cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = (hashing.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)).astype(np.uint32)
    return seeds[:n], seeds[n:] | np.uint32(1)


def minima(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """MinHash values, one row per set: ``h`` holds the sets one after another, each from its start. They are made of the
    upper 32 bits of the hashes, which processors take several of at a time."""
    flip, times = _functions(n)
    h = (h >> np.uint64(32)).astype(np.uint32)
    out, turned = np.empty((n, len(starts)), dtype=np.uint32), np.empty_like(h)
    for k in range(n):
        np.multiply(np.bitwise_xor(h, flip[k], out=turned), times[k], out=turned)
        np.minimum.reduceat(turned, starts, out=out[k])
    return out.T.astype(np.uint64)


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row; the band's number is part of it."""
    parts = low.T.reshape(bands, rows, len(low))
    first = [(b + 1) * 0xA24BAED4963EE407 % (1 << 64) for b in range(bands)]
    key = np.repeat(np.array(first, dtype=np.uint64)[:, None], len(low), axis=1)
    for x in range(rows):
        key = hashing.mix(key ^ parts[:, x])
    return key.T


def candidate_groups(keys: DataFrame) -> DataFrame:
    """``_row`` and ``_groups`` of the items that share a key with another one.

    ``keys`` has ``_key``, ``_row``, ``_n`` (the item's shingles), each (key, row) once; it is read more than once.
    Keys with the same items count once. ``_groups`` holds the item's keys in ascending order with their numbers of
    items and shingles; it is no longer than the item has keys."""
    buckets = keys.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_items"),
        F.sum("_n").alias("_shingles"),
        F.bit_xor(F.xxhash64("_row")).alias("_x"),
        F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("_y"),
    )
    buckets = buckets.where("_items > 1").groupBy("_x", "_y", "_items", "_shingles").agg(F.min("_key").alias("_key"))
    buckets = materialize(buckets.select("_key", "_items", "_shingles"), "buckets")
    return keys.join(buckets, "_key").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_key", "_items", "_shingles"))).alias("_groups"))


def tiles(items: DataFrame) -> DataFrame:
    """Deal items (``_row``, ``_groups``, anything else) to tiles: pairs of blocks of a bucket.

    Adds ``_tile`` (key, low block, high block) and ``_block``; a bucket of one block has one tile."""
    own = items.withColumn("_g", F.explode("_groups"))
    blocks = F.greatest(F.ceil(F.col("_g._items") / BLOCK), F.ceil(F.col("_g._shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    own = own.withColumn("_blocks", F.least(blocks, F.col("_g._items").cast("int"))).withColumn("_block", F.pmod(F.xxhash64("_row", F.col("_g._key")), F.col("_blocks")).cast("int"))
    pair = lambda x: F.struct(F.col("_g._key").alias("key"), F.least(F.col("_block"), x).alias("low"), F.greatest(F.col("_block"), x).alias("high"))
    return own.withColumn("_tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), pair))).drop("_g", "_blocks")


def verify(items: DataFrame, shingles: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], threshold: float) -> DataFrame:
    """Exact links of candidates: ``_row``, ``_other``, ``_texts``, ``_docs``.

    ``items`` has ``_row``, ``_groups``, ``_copies`` and ``_text``; rows that repeat an item count once. ``shingles`` gives the distinct
    shingles of texts as (position, hash) in ascending order. A row with ``_other`` is a link of the spanning forest,
    one without carries numbers of linked items and of their copies; sum them for an item. A pair is looked at in its
    lowest common bucket only, so it counts once."""
    dealt = tiles(items).select(
        F.xxhash64("_tile").alias("_at"),
        F.col("_tile.key").alias("_key"),
        F.col("_tile.low").alias("_low"),
        F.col("_tile.high").alias("_high"),
        "_block",
        "_row",
        "_copies",
        F.transform("_groups", lambda g: g["_key"]).alias("_keys"),
        "_text",
    )
    dealt = dealt.repartition("_at").sortWithinPartitions("_at", "_key", "_low", "_high", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = chars = 0
        name = None
        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in (1, 2, 3)]
            n = batch.num_rows
            if not n:
                continue
            size = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index("_text"))))
            start = 0
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            first = tuple(int(c[0]) for c in cols)
            # tiles are solved many at a time; one that goes on in the next batch waits for it
            for at in [*([0] if held and first != name else []), *cut]:
                if rows + at - start >= HELD_ROWS or chars + int(size[start:at].sum()) >= HELD_CHARS or at == 0:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    yield from _solve_all(held, shingles, threshold)
                    held, rows, chars, start = [], 0, 0, at
            held.append(batch.slice(start))
            rows, chars = rows + n - start, chars + int(size[start:].sum())
            name = tuple(int(c[-1]) for c in cols)
        if held:
            yield from _solve_all(held, shingles, threshold)

    return dealt.mapInArrow(run, "_row long, _other long, _texts long, _docs long")


def _ragged(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of the lists ``which``, one list after another, and the position of each one's list."""
    n = offsets[which + 1] - offsets[which]
    of = np.repeat(np.arange(len(which)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[which], n), of


def _solve_all(held: list[pa.RecordBatch], shingles, threshold: float) -> Iterator[pa.RecordBatch]:
    """The links of whole tiles that come one after another."""
    table = pa.Table.from_batches(held).combine_chunks()
    name = np.stack([table[c].to_numpy() for c in ("_key", "_low", "_high")])
    ids = table["_row"].to_numpy()
    again = np.r_[False, (ids[1:] == ids[:-1]) & (name[:, 1:] == name[:, :-1]).all(axis=0)]
    if again.any():
        table, name = table.filter(pa.array(~again)), name[:, ~again]
        table = table.combine_chunks()
    if not table.num_rows:
        return
    ids, copies, block = (table[c].to_numpy() for c in ("_row", "_copies", "_block"))
    lists = table["_keys"].chunk(0)
    keys, key_at = np.asarray(lists.values), np.asarray(lists.offsets).astype(np.int64)
    at, h = shingles(table["_text"].to_pylist())
    set_at = np.r_[0, np.cumsum(np.bincount(at, minlength=len(ids)))]
    edge = np.flatnonzero(np.r_[True, (name[:, 1:] != name[:, :-1]).any(axis=0), True])
    count = np.diff(edge)
    small = (count > 1) & (count <= PAIRWISE)
    pairs = [(edge[:-1][small & (count > j)] + i, edge[:-1][small & (count > j)] + j) for j in range(1, PAIRWISE) for i in range(j)]
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    a, b = _linked_pairs(a, b, name, block, keys, key_at, h, set_at, threshold)
    if len(a):
        one = np.ones(len(a), np.int64)
        none = pa.nulls(2 * len(a), pa.int64())
        yield _out(ids[np.r_[a, b]], none, np.r_[one, one], copies[np.r_[b, a]])
        yield _out(ids[b], pa.array(ids[a]), 0 * one, 0 * one)
    for t in np.flatnonzero(count > PAIRWISE):
        rows = np.arange(edge[t], edge[t + 1])
        yield from _solve_tile(name[:, rows[0]], ids[rows], copies[rows], block[rows], keys, key_at, rows, h, set_at, threshold)


def _linked_pairs(a, b, name, block, keys, key_at, h, set_at, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows of one tile those that belong to it and reach the threshold."""
    size = np.diff(set_at)
    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    ok = ((name[1, a] == name[2, a]) | (block[a] != block[b])) & (low >= threshold * high - 1e-9) & (low > 0)
    a, b = a[ok], b[ok]
    # a pair that meets in a lower bucket is looked at there
    x, of = _ragged(key_at, np.r_[a, b])
    of = of % max(1, len(a))
    below = keys[x] < name[0, a[of]]
    k, of = keys[x][below], of[below]
    order = np.lexsort((k, of))
    k, of = k[order], of[order]
    twice = (k[1:] == k[:-1]) & (of[1:] == of[:-1])
    ok = np.ones(len(a), dtype=bool)
    ok[of[1:][twice]] = False
    a, b = a[ok], b[ok]
    x, of = _ragged(set_at, np.r_[a, b])
    of = of % max(1, len(a))
    s = h[x]
    if len(s) and len(a) < 1 << 20 and s.max() < 1 << 44:
        # pair and hash fit one number
        both = of.astype(np.uint64) << np.uint64(44) | s
        both.sort()
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(44)).astype(np.int64), minlength=len(a))
    else:
        order = np.lexsort((s, of))
        s, of = s[order], of[order]
        common = np.bincount(of[1:][(s[1:] == s[:-1]) & (of[1:] == of[:-1])], minlength=len(a))
    ok = common * (1 + threshold) >= threshold * (size[a] + size[b]) - 1e-6
    return a[ok], b[ok]


def _solve_tile(name, ids, copies, block, keys, key_at, rows, h, set_at, threshold: float) -> Iterator[pa.RecordBatch]:
    key, low, high = (int(x) for x in name)
    s = len(ids)
    linked = np.triu(np.ones((s, s), dtype=bool), 1)
    if low != high:
        linked &= np.not_equal.outer(block, block)
    # pairs that meet in a lower bucket are looked at there
    x, of = _ragged(key_at, rows)
    flat = keys[x]
    below = flat < key
    flat, of = flat[below], of[below]
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True]) if len(flat) else np.zeros(0, int)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a > 1:
            linked[np.ix_(of[a:b], of[a:b])] = False
    size = np.diff(set_at)[rows]
    # a pair below this size ratio cannot reach the threshold
    linked &= np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9
    if not linked.any():
        return
    x, at = _ragged(set_at, rows)
    linked &= _common(at, h[x], s) * (1 + threshold) >= threshold * np.add.outer(size, size) - 1e-6
    both = linked | linked.T
    texts = both.sum(axis=1)
    some = np.flatnonzero(texts)
    if not len(some):
        return
    docs = both.astype(np.int64) @ copies
    none = pa.nulls(len(some), pa.int64())
    yield _out(ids[some], none, texts[some], docs[some])
    label = np.arange(s)
    while True:
        near = np.minimum(label, np.where(both, label[None, :], s).min(axis=1))
        near = near[near]
        if (near == label).all():
            break
        label = near
    tied = some[label[some] != some]
    yield _out(ids[tied], pa.array(ids[label[tied]]), np.zeros(len(tied), np.int64), np.zeros(len(tied), np.int64))


def _out(row: np.ndarray, other: pa.Array, texts: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), other, pa.array(texts.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["_row", "_other", "_texts", "_docs"])


def _common(at: np.ndarray, h: np.ndarray, s: int) -> np.ndarray:
    """Sizes of all intersections of ``s`` sets, as products of their incidence matrix, some columns at a time."""
    out = np.zeros((s, s), dtype=np.float64)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(h) else new
    at, column = at[shared], column[shared]
    if not len(at):
        return out
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1, COLUMNS))
    for a, b in zip(edges, np.r_[edges[1:], len(column)], strict=True):
        x = np.zeros((s, COLUMNS if column[b - 1] - column[a] >= 64 else 64), dtype=np.float32)
        x[at[a:b], column[a:b] - column[a]] = 1
        out += x @ x.T
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (``_a``, ``_b``): ``_row`` and ``_label``, the least node of its component;
    a row for every node with an edge to another.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until nothing changes. Every step reads written
    tables, so lineage stays short and a hub's rows are split by the skew join."""
    ends = F.array_sort(F.array("_a", "_b"))
    now = materialize(edges.where("_a != _b").select(ends[1].alias("u"), ends[0].alias("v")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        release(now, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "small")
        release(large, least)
        was, seen = seen, _state(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("_row"), F.col("v").alias("_label")).unionByName(now.select(F.col("v").alias("_row"), F.col("v").alias("_label")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def bitmap(items: DataFrame, col: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of fixed size: whether a number of ``col`` (bigint) has these last bits."""
    slot = f"pmod({col}, {1 << bits})"
    words = items.groupBy(F.expr(f"shiftright({slot}, 6)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 AS int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint8)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sift(df: DataFrame, col: str, bits: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose ``col`` passes the filter. They are few before they are dealt to a join, at any size of the
    table, so the join's exchange does not depend on whether its other side is small enough to be sent around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = passes(bits, np.asarray(batch.column(batch.schema.get_field_index(col))))
            if ok.any():
                yield batch.filter(pa.array(ok))

    return df.mapInArrow(run, df.schema)


def first_of(*order: Column) -> Column:
    """An aggregate: the least of rows in this order, as a struct."""
    return F.min(F.struct(*order))
