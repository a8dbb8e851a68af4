"""Fuzzy line deduplication by MinHash.

Lines are compared lower-cased and trimmed. Equal lines are one item; items of similar character shingles meet in band
buckets, are verified exactly, and linked items form components by distributed union-find. Of each component's
occurrences the first one stays. Blank lines are left alone.

One changed character changes as many shingles as a shingle has characters, which is much of a short line. With
``fine``, lines are short that have at most FINE_CHARS characters (or no more distinct shingles than those have), and two
short lines are linked if their sets of shingles of ``fine`` characters reach the threshold; a long line and another one
are compared by the longer shingles, and so are short ones that have enough of those to resemble a long line.

A line's identity has 96 bits: the 64 of its hash, by which lines are dealt, and 32 more that are compared where lines
are taken for equal. Only one of several lines that share the 64 bits is linked with others.

Signatures: a set of fewer than SMALL + margin shingles gets classic MinHash values, one of SMALL or more gets
one-permutation values (the least hash in each of as many bins, empty bins borrowing from others). The margin is such
that two sets above the threshold always share one of the two kinds.

Unrelated short lines meet in many buckets. A sketch of 64 bits goes with their keys, each bit the parity of the number of
shingles that fall on it. Two sketches differ in no more bits than their sets in shingles, so two sets whose sketches
differ in more than sets at the threshold can are not similar: they are dropped before texts are fetched, no link is lost."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, near
from .common import block_batches, materialize, release, shuffle_partitions, text_batches, text_or_empty

SHINGLE = 8
THRESHOLD = 0.8
#: Characters of the shorter shingles and of the longest line that gets them. From 29 characters on, a line stays above
#: the threshold when one of its characters changes; above 115, a changed run of 5 characters does with SHINGLE too.
FINE = 3
FINE_CHARS = 120
RECALL = 0.998
MAX_BANDS = 13
#: Unrelated lines share more short shingles, so their bands are longer, and there are more of them.
MAX_FINE_BANDS = 16
#: Parts in which band keys are sorted, one after another, so that the disk holds the exchange of one of them.
KEY_PARTS = 3
#: A bucket of more items is not looked at pair by pair before texts are fetched; all of like sizes stay.
SKETCHED = 256
SMALL = 160
#: Characters and lines that are worked on at a time (their arrays fit a processor's cache) and rows that leave together.
BATCH_CHARS = 1 << 16
OUT_ROWS = 20_000
#: Band keys that a task deals at a time, and cells they are dealt to for each shuffle partition.
DEALT_KEYS = 1 << 18
CELLS = 8
#: Slots of the memory of lines that a task has met; a line that has been pushed out of it only costs time.
MET_SLOTS = 1 << 20
_HASH_BITS = 44
_SECOND = np.uint64(0x14057B7EF767814F)


@functools.cache
def _char_table() -> np.ndarray:
    return hashing.mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


@functools.cache
def _blank_table() -> np.ndarray:
    out = np.zeros(65536, dtype=bool)
    out[[c for c in range(65536) if chr(c).isspace()]] = True
    return out


def _trimmed(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of ``code`` without the blanks at both ends; a blank one is empty, at its start."""
    blank = _blank_table()
    a, b, solid = start.copy(), end.copy(), None
    for at, step in ((a, 1), (b, -1)):
        # few lines have more than a few blanks there; for those all others are searched
        todo = np.flatnonzero(a < b)
        for _ in range(8):
            todo = todo[blank[np.minimum(code[at[todo] - (step < 0)], 65535)]]
            at[todo] += step
            todo = todo[a[todo] < b[todo]]
            if not len(todo):
                break
        if len(todo):
            solid = np.flatnonzero(~blank[np.minimum(code, 65535)]) if solid is None else solid
            spot = np.searchsorted(solid, at[todo])
            at[todo] = np.minimum(np.r_[solid, len(code)][spot], b[todo]) if step > 0 else solid[spot - 1] + 1
    return np.where(a == b, start, a), np.where(a == b, start, b)


class Lines:
    """The lines of a batch of texts as arrays: ``doc``, ``line`` (number in its text), ``start`` and ``end`` of the
    trimmed line among ``code`` (code points of all texts in lower case), blank ones included."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.joined = "\n".join(low) + "\n"
        code = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        feed = np.flatnonzero(code == 10)
        start = np.r_[0, feed[:-1] + 1]
        count = np.array([t.count("\n") + 1 for t in low])
        self.doc = np.repeat(np.arange(len(texts)), count)
        self.line = np.arange(len(feed)) - np.repeat(np.cumsum(count) - count, count)
        self.start, self.end = _trimmed(code, start, feed)
        self.blank = self.start == self.end
        self.value = _char_table()[code & 0xFFFF]
        if (code > 0xFFFF).any():
            self.value = self.value + (code >> 16).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        self.up, self.down = hashing._power(len(code) + 1)
        self.total = self._sums(self.value)

    def _sums(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(value * self.up[: len(value)], out=out[1:])
        return out

    def _whole(self, total: np.ndarray) -> np.ndarray:
        return hashing.mix((total[self.end] - total[self.start]) * self.down[self.start] + (self.end - self.start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self._whole(self.total)

    def checks(self, which: np.ndarray | None = None) -> np.ndarray:
        """32 further bits of each line, or of the lines ``which``."""
        if which is None:
            out = self._whole(self._sums(hashing.mix(self.value ^ _SECOND)))
        else:
            # their characters alone, one line after another; a hash does not depend on the place
            many = self.end[which] - self.start[which]
            at = np.cumsum(many) - many
            total = self._sums(hashing.mix(self.value[np.repeat(self.start[which] - at, many) + np.arange(many.sum())] ^ _SECOND))
            out = hashing.mix((total[at + many] - total[at]) * self.down[at] + many.astype(np.uint64))
        return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def shingles(self, which: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of the lines ``which`` (indexes, ascending): (position in ``which``, hash), sorted. A line
        of fewer than ``k`` characters is one shingle."""
        start, end = self.start[which], self.end[which]
        many = np.maximum(end - start - k + 1, np.minimum(end - start, 1))
        if not many.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        offset = np.cumsum(many) - many
        at = np.repeat(start - offset, many) + np.arange(many.sum())
        if 2 * len(at) > len(self.value) > k:
            # most places are wanted: all in a row, and the lines that are one shingle after that
            h = hashing.mix((self.total[k:] - self.total[:-k]) * self.down[: len(self.total) - k])[np.minimum(at, len(self.total) - k - 1)]
            few = np.flatnonzero((end > start) & (end - start < k))
            h[offset[few]] = hashing.mix((self.total[end[few]] - self.total[start[few]]) * self.down[start[few]])
        else:
            to = np.minimum(at + k, np.repeat(end, many))
            h = hashing.mix((self.total[to] - self.total[at]) * self.down[at])
        key = np.repeat(np.arange(len(which), dtype=np.uint64), many) << np.uint64(_HASH_BITS) | h >> np.uint64(64 - _HASH_BITS)
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        return (key >> np.uint64(_HASH_BITS)).astype(np.int64), key & np.uint64((1 << _HASH_BITS) - 1)

    def text(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]]


@functools.cache
def _borrow(n: int) -> np.ndarray:
    """For each bin, the order in which it tries others when it is empty."""
    keys = hashing.mix((np.arange(n, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(1, n + 1, dtype=np.uint64)[None, :])
    return np.argsort(keys, axis=1)


def _one_permutation(size: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Least hash of each bin; each set's hashes are sorted, so it is the first one of its bin."""
    rows = len(size)
    cell = h * np.uint64(n)
    cell >>= np.uint64(_HASH_BITS)
    cell += np.repeat(np.arange(0, rows * n, n, dtype=np.uint64), size)
    new = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1]
    out = np.zeros(rows * n, dtype=np.uint64)
    has = np.zeros(rows * n, dtype=bool)
    cell = cell[new].astype(np.int64)
    out[cell], has[cell] = hashing.mix(h[new] + np.uint64(1)), True
    out, has = out.reshape(rows, n), has.reshape(rows, n)
    r, b = np.nonzero(~has)
    order = _borrow(n)[b]
    first = np.argmax(has[r[:, None], order], axis=1)
    out[r, b] = out[r, order[np.arange(len(r)), first]] ^ (b + 1).astype(np.uint64)
    return out


def sketches(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits for each set of distinct hashes, which ``h`` holds one after another: a bit is the parity of the number of
    those that fall on it."""
    out = np.zeros(len(size), dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), (np.cumsum(size) - size)[full])
    return out


def signatures(lines: Lines, which: np.ndarray, k: int, threshold: float, bands: int, rows: int, sketch: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys of the lines ``which``: number of distinct shingles of each, and (position, key). ``sketch`` is filled
    with their sketches."""
    at, h = lines.shingles(which, k)
    size = np.bincount(at, minlength=len(which))
    if sketch is not None:
        sketch[:] = sketches(h, size)
    out = []
    n = bands * rows
    for large in (False, True):
        own = np.flatnonzero(size >= SMALL) if large else np.flatnonzero((size > 0) & (size < SMALL / threshold + 1))
        if not len(own):
            continue
        part = np.zeros(len(which), dtype=bool)
        part[own] = True
        h_own, size_own = h if part.all() else h[np.repeat(part, size)], size[own]
        if large:
            low = _one_permutation(size_own, h_own, n)
        else:
            low = near.minima(hashing.mix(h_own), np.cumsum(size_own) - size_own, n)
        keys = near.band_keys(low, bands, rows) ^ np.uint64(0x5851F42D4C957F2D if large else 0)
        out.append((np.repeat(own, bands), keys.ravel()))
    if not out:
        return size, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return size, np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        # the number of a line must fit beside the bits of a shingle
        if total >= BATCH_CHARS or i + 1 - start >= 10_000:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_PARTS = 1 << 16


class Met:
    """Which lines a task has met, in bounded memory."""

    def __init__(self):
        self.at = np.zeros(MET_SLOTS, dtype=np.int64)
        self.at[0] = 1  # no hash is taken for met at the start

    def fresh(self, h: np.ndarray) -> np.ndarray:
        """Positions, ascending, of the first occurrences in ``h`` (int64) that are not remembered; they are from now on."""
        _, first = np.unique(h, return_index=True)
        slot = h[first] & (MET_SLOTS - 1)
        first, slot = first[self.at[slot] != h[first]], slot[self.at[slot] != h[first]]
        self.at[slot] = h[first]
        return np.sort(first)


def occurrences(docs: DataFrame, k: int, threshold: float, bands: int, rows: int, fine: tuple[int, int, int] | None = None, cells: int = 1) -> DataFrame:
    """Rows of three kinds from ``docs`` (``_row``, ``_id``, ``_text``). For each text one with ``_line`` -1, ``_n`` its number
    of lines and ``_list`` those that are blank; for each other line one with ``_line``, ``_h`` and ``_check`` its hashes,
    hashes. Between them rows of a third kind with ``_line`` -2, ``_n`` a cell and ``_keys_0``, ``_keys_1``, ... the band keys
    that fall into that cell, in parts: keys, hashes of their lines, numbers of shingles and sketches one after another as
    64-bit numbers. A line that this task remembers has no keys.

    With ``fine`` (characters, bands, rows) the last bit of a key is 1 if it comes from the shorter shingles; only those have
    sketches."""
    # distinct shingles of the largest short line, and characters that a line needs to resemble one with more of them
    most = FINE_CHARS - k + 1
    least = int(np.ceil(threshold * (most + 1) - 1e-9)) + k - 1

    def keys_of(lines: Lines, which: np.ndarray) -> list[np.ndarray]:
        """Keys of the lines ``which``, and for each its position in ``which``, its line's shingles and sketch."""
        sketch = np.zeros(len(which), dtype=np.uint64)
        if fine is None:
            size, at, keys = signatures(lines, which, k, threshold, bands, rows, sketch)
            return [keys, at, size[at], sketch[at]]
        length = lines.end[which] - lines.start[which]
        long = np.flatnonzero(length >= least)
        size = np.zeros(len(which), dtype=np.int64)
        size[long], at, keys = signatures(lines, which[long], k, threshold, bands, rows)
        short = np.flatnonzero((length <= FINE_CHARS) | (size <= most))
        sketch = sketch[: len(short)]
        fine_size, own, more = signatures(lines, which[short], fine[0], threshold, *fine[1:], sketch)
        of = long[at]
        return [np.r_[keys & ~np.uint64(1), more | np.uint64(1)], np.r_[of, short[own]], np.r_[size[of], fine_size[own]], np.r_[np.zeros(len(at), np.uint64), sketch[own]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(some(batches))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, held, n = Met(), [], 0
        for batch in batches:
            ids, texts = batch.select([0, 1]), batch.column(2).to_pylist()
            for a, b in _groups(texts):
                lines = Lines(texts[a:b])
                count = np.bincount(lines.doc, minlength=b - a)
                blank = np.bincount(lines.doc[lines.blank], minlength=b - a)
                blanks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(blank)].astype(np.int32)), pa.array(lines.line[lines.blank].astype(np.int64)))
                head = ids.slice(a, b - a)
                yield _batch(head, np.full(b - a, -1), None, None, count, blanks)
                full = np.flatnonzero(~lines.blank)
                hashed, checked = hashing.as_signed(lines.hashes()), lines.checks()
                yield _batch(head.take(pa.array(lines.doc[full])), lines.line[full], hashed[full], checked[full], np.zeros(len(full)))
                for c in range(0, len(full), _PARTS):
                    which = full[c : c + _PARTS]
                    which = which[met.fresh(hashed[which])]
                    keys, at, size, sketch = keys_of(lines, which)
                    held.append(np.stack([hashing.as_signed(keys), hashed[which[at]], size, hashing.as_signed(sketch)]))
                    n += len(keys)
                    if n >= DEALT_KEYS:
                        yield _dealt(held, cells, ids.schema)
                        held, n = [], 0
        if n:
            yield _dealt(held, cells, ids.schema)

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_row long, _id {kind}, _line long, _h long, _check int, _n long, _list array<long>, " + ", ".join(f"{c} binary" for c in _key_columns()))


def _key_columns() -> list[str]:
    return [f"_keys_{p}" for p in range(KEY_PARTS)]


def _batch(ids: pa.RecordBatch, line, h, check, n, blanks=None, keys=None) -> pa.RecordBatch:
    def column(x, kind: pa.DataType) -> pa.Array:
        return pa.nulls(len(line), kind) if x is None else pa.array(x, kind)

    cols = [column(line, pa.int64()), column(h, pa.int64()), column(check, pa.int32()), column(n.astype(np.int64), pa.int64())]
    blanks = pa.nulls(len(line), pa.list_(pa.int64())) if blanks is None else blanks
    lists = [column(x, pa.binary()) for x in keys or [None] * KEY_PARTS]
    return pa.RecordBatch.from_arrays([*ids.columns, *cols, blanks, *lists], names=["_row", "_id", "_line", "_h", "_check", "_n", "_list", *_key_columns()])


def _dealt(held: list[np.ndarray], cells: int, ids: pa.Schema) -> pa.RecordBatch:
    """Rows of cells from columns of keys, lines, shingles and sketches."""
    rows = np.concatenate(held, axis=1)
    slot = ((hashing.mix(rows[0].view(np.uint64)) >> np.uint64(32)) % np.uint64(cells * KEY_PARTS)).astype(np.uint16 if cells * KEY_PARTS < 1 << 16 else np.uint32)
    order = np.argsort(slot, kind="stable")
    rows, edge = rows[:, order], np.searchsorted(slot[order], np.arange(cells * KEY_PARTS + 1)).tolist()
    used = [c for c in range(cells) if edge[c * KEY_PARTS] < edge[(c + 1) * KEY_PARTS]]
    keys = [[rows[:, edge[i] : edge[i + 1]].tobytes() or None for i in range(p, cells * KEY_PARTS, KEY_PARTS)] for p in range(KEY_PARTS)]
    none = pa.RecordBatch.from_arrays([pa.nulls(len(used), t) for t in ids.types], schema=ids)
    return _batch(none, np.full(len(used), -2), None, None, np.array(used), keys=[[x[c] for c in used] for x in keys])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, of OUT_ROWS or a little more, as each batch has its costs in the JVM."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= OUT_ROWS:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def shared_keys(keys: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``keys`` (``_key``, ``_row``, ``_n`` and, if there are sketches, ``_sketch``) whose key has another item
    that can reach the threshold by its size and sketch, each (key, item) once. ``keys`` may also have ``_cell`` and
    ``_keys``, as ``occurrences`` deals them; then nothing is done for single keys outside numpy, and a task holds a cell.

    The rows of a partition come sorted by key and size. The items of a key are compared in pairs if there are at most
    SKETCHED; of more, all with a neighbour of like size are passed on. Nothing is held but the rows of one such key, or
    the last row of a larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # columns of the last key's rows, and whether they are found to stay
        large = False
        for cols in of_cells(batches) if celled else ([np.asarray(x) for x in batch.columns] for batch in batches):
            cols = [*cols, np.zeros(len(cols[0]), dtype=bool)]
            if held is not None:
                cols = [np.r_[x, y] for x, y in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
            key, row, n, sketch, ok = cols = [x[new] for x in cols]
            same = key[1:] == key[:-1]
            edge = np.r_[0, np.flatnonzero(~same) + 1, len(key)]
            more = np.diff(edge) > SKETCHED
            more[0] |= large
            in_more = np.repeat(more, np.diff(edge))
            like = same & in_more[1:] & (n[:-1] >= threshold * n[1:] - 1e-9)
            ok |= np.r_[False, like] | np.r_[like, False]
            a, step = np.flatnonzero(same & ~in_more[1:]), 1
            while len(a):
                b = a + step
                # sets at the threshold differ in this share of the sum of their sizes
                most = (n[a] + n[b]) * ((1 - threshold) / (1 + threshold)) + 1e-5
                near_by = (n[a] >= threshold * n[b] - 1e-9) & (np.bitwise_count((sketch[a] ^ sketch[b]).view(np.uint64)) <= most)
                ok[a[near_by]] = ok[b[near_by]] = True
                step += 1
                a = a[a + step < len(key)]
                a = a[key[a] == key[a + step]]
            large = bool(more[-1])
            keep = len(key) - 1 if large else edge[-2]
            held = [x[keep:] for x in cols]
            yield from _rows(*(x[:keep] for x in cols))
        if held is not None:
            yield from _rows(*held)

    def _rows(key, row, n, _, ok) -> Iterator[pa.RecordBatch]:
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (key, row, n)], names=["_key", "_row", "_n"])

    def of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        now, parts = None, []
        for batch in batches:
            for cell, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if cell != now and parts:
                    yield in_order(parts)
                    parts = []
                now = cell
                parts.append(np.frombuffer(part, dtype=np.int64).reshape(4, -1))
        if parts:
            yield in_order(parts)

    def in_order(parts: list[np.ndarray]) -> list[np.ndarray]:
        rows = np.concatenate(parts, axis=1)
        order = np.argsort(rows[0])
        key = rows[0][order]
        same = key[1:] == key[:-1]
        rows = rows[:, order[np.r_[False, same] | np.r_[same, False]]]
        return list(rows[:, np.lexsort((rows[1], rows[2], rows[0]))])

    celled = "_cell" in keys.columns
    if celled:
        return keys.select("_cell", "_keys").repartition("_cell").sortWithinPartitions("_cell").mapInArrow(run, "_key long, _row long, _n long")
    if "_sketch" not in keys.columns:
        keys = keys.withColumn("_sketch", F.lit(0).cast("long"))
    keys = keys.select("_key", "_row", F.col("_n").cast("long").alias("_n"), "_sketch")
    return keys.repartition("_key").sortWithinPartitions("_key", "_n", "_row").mapInArrow(run, "_key long, _row long, _n long")


def candidate_lines(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``_h``, ``_check`` and ``_text`` of the lines of ``docs`` (``_text``) that pass the filter, one row for each hash.

    A task gives a line once while it remembers it; the copies of a common line are combined before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(some(batches))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _groups(texts):
                lines = Lines(texts[a:b])
                h = hashing.as_signed(lines.hashes())
                hit = np.flatnonzero(near.passes(bits, h) & ~lines.blank)
                take = hit[met.fresh(h[hit])]
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(lines.checks(take)), pa.array([lines.text(i) for i in take], pa.string())], names=["_h", "_check", "_text"])

    found = docs.mapInArrow(run, "_h long, _check int, _text string")
    # of lines that share a hash the one with the least further bits stands for it
    first = found.groupBy("_h").agg(F.min(F.struct("_check", "_text")).alias("x"))
    return first.select("_h", "x._check", "x._text")


def shingler(k: int):
    """Distinct shingles of whole lines."""

    def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(a, *Lines(texts[a:b]).shingles(np.arange(b - a), k)) for a, b in _groups(texts)]
        return np.concatenate([a + at for a, at, _ in parts]), np.concatenate([h for *_, h in parts])

    return shingles


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, fine: int | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``n_lines``, ``n_dropped``, ``dropped`` (array of line numbers, from 0).

    ``fine``: characters of the shingles by which short lines are compared.

    Occurrences are ordered by id, row (the order of the table) and line number; null ids come last. Rows that repeat
    an id or a whole row are rows of their own. A null or empty text has one line, which is blank. Other columns are
    ignored, whatever their names. ``drop_lines`` applies the result to a text."""
    text_batches(docs.sparkSession)
    fine = None if fine == k else fine
    bands, rows = near.choose_bands(threshold, recall, MAX_BANDS)
    text = text_or_empty(text_col).alias("_text")
    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text)
    more = None if fine is None else (fine, *near.choose_bands(threshold, recall, MAX_FINE_BANDS))
    cells = CELLS * shuffle_partitions(docs.sparkSession)
    found = materialize(occurrences(source, k, threshold, bands, rows, more, cells), "lines")
    with block_batches(docs.sparkSession):
        dealt = [found.where("_line = -2").select(F.col("_n").alias("_cell"), F.col(part).alias("_keys")).where("_keys IS NOT NULL") for part in _key_columns()]
        parts = [materialize(shared_keys(keys, threshold), "shared") for keys in dealt]
    shared = reduce(DataFrame.unionByName, parts)
    # the keys, most of that table, are not needed any more
    slim = materialize(found.where("_line >= -1").drop(*_key_columns()), "lines")
    release(found)
    each, heads = slim.where("_line >= 0"), slim.where("_line = -1")
    # texts are read once for the candidates of either size of shingle
    sizes = [k] if fine is None else [k, fine]
    groups = [near.candidate_groups(shared if fine is None else shared.where(F.col("_key").bitwiseAND(F.lit(1)) == int(size == fine))) for size in sizes]
    items = materialize(reduce(DataFrame.unionByName, [g.withColumn("_shingle", F.lit(size)) for g, size in zip(groups, sizes, strict=True)]), "items")
    texts = candidate_lines(docs.select(text), near.bitmap(items, "_row"))
    known = items.join(texts, F.col("_row") == F.col("_h")).select("_row", F.lit(1).cast("long").alias("_copies"), "_groups", "_text", "_check", "_shingle")
    known = materialize(known, "known")
    release(items, *parts)
    links = [materialize(near.verify(known.where(F.col("_shingle") == size).drop("_check", "_shingle"), shingler(size), threshold), "links") for size in sizes]
    checks = materialize(known.select("_row", "_check").distinct(), "checks")
    release(known)
    tied = reduce(DataFrame.unionByName, links).where("_other IS NOT NULL").select(F.col("_row").alias("_a"), F.col("_other").alias("_b"))
    labels = near.components(tied).join(checks, "_row")
    labels = materialize(labels.select(F.col("_row").alias("_l"), F.col("_check").alias("_c"), "_label"), "labels")
    labelled = each.join(labels, (F.col("_h") == F.col("_l")) & (F.col("_check") == F.col("_c")), "left")
    # a line by itself is told from others by all of its bits
    labelled = labelled.withColumns({"_own": F.when(F.col("_label").isNull(), F.col("_check")), "_label": F.coalesce("_label", "_h")})
    place = F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_line").alias("line"))
    stay = labelled.groupBy("_label", "_own").agg(F.min(place).alias("_first"))
    # the lines of one document
    stay = stay.groupBy(F.col("_first.row").alias("_r")).agg(F.collect_list("_first.line").alias("_stay"))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    gone = F.array_except(F.array_except(numbers, "_list"), F.coalesce("_stay", F.array().cast("array<bigint>")))
    return heads.join(stay, F.col("_row") == F.col("_r"), "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), gone.alias("dropped")
    )


def drop_lines(df: DataFrame, text_col: str = "text", dropped_col: str = "dropped", out: str = "text") -> DataFrame:
    """Add ``out``: the text without the lines whose numbers are in ``dropped_col``."""
    lines = F.split(text_or_empty(text_col), "\n", -1)
    return df.withColumn(out, F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(dropped_col, i.cast("bigint"))), "\n"))


def report(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))
