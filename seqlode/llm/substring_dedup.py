"""Substring deduplication by sliding sentence spans.

Sentences end at sentence marks and line feeds; longer ones are cut further where the text itself says so (where the
word of the least hash among the last CUT ones changes), so a passage is cut alike wherever it stands, from its word
CUT on, and no sentence has more than CUT words. From every sentence a span runs over at least SENTENCES sentences and
MIN_WORDS words. The first cut of a shared run is at most 2 CUT words from its start and a span ends less than CUT
words after its MIN_WORDS-th, so a run of 3 CUT + MIN_WORDS - 1 = 50 words holds a whole span. Span hashes (96 bits)
are joined over the whole table; sentences covered by a span that also occurs earlier (smaller id, then earlier row,
then earlier place) are removed.

Rows are told apart by a number of their own, given in a written table, so rows that share an id share nothing else."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, near
from .common import materialize, release, text_batches, text_or_empty

#: A span has at least this many sentences and words.
SENTENCES = 3
MIN_WORDS = 24
#: Without a mark, a sentence is cut after at most so many words.
CUT = 9
#: Texts are cut and hashed in batches of about this many characters.
BATCH_CHARS = 1 << 18
#: Bits of the filter that passes over spans which stand once. False hits only cost time.
FILTER_BITS = 26

_SECOND = np.uint64(0x5851F42D4C957F2D)
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in ".!?"]] = True
#: Further marks by their bytes in UTF-8, as one number.
_WIDE_MARKS = {n: np.array([int.from_bytes(c.encode(), "big") for c in marks]) for n, marks in {2: "\u037e؟۔", 3: "…‼⁇⁈⁉。｡！？．।॥።။។"}.items()}


def _marked(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a sentence mark is the last character of the words that end at ``end``."""
    out = _MARKS[data[end - 1]]
    wide = np.flatnonzero(data[end - 1] >= 0x80)
    if len(wide):
        at = end[wide]
        tail = data[at - 1].astype(np.int64) | data[at - 2].astype(np.int64) << 8
        out[wide] = np.isin(tail, _WIDE_MARKS[2]) | np.isin(tail | data[np.maximum(at - 3, 0)].astype(np.int64) << 16, _WIDE_MARKS[3])
    return out


def _further(word: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where sentences that end at ``stop`` are cut further: after CUT words, then wherever the place of the least hash
    among the last CUT words is another than one word before. Whether a word is a cut depends on the CUT words before
    it and on itself, and no CUT words in a row are without one."""
    n = len(word)
    out = np.zeros(n, dtype=bool)
    if n <= CUT:
        return out  # the last word of a text ends its sentence anyway
    begin = np.r_[0, np.flatnonzero(stop[:-1]) + 1]
    since = np.arange(1, n + 1) - np.repeat(begin, np.diff(np.r_[begin, n]))
    # least of the CUT - 1 words between the one that leaves and the one that enters
    least = word[1:-1].copy()
    size = 1
    while size < CUT - 1:
        step = min(size, CUT - 1 - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    out[CUT:] = ((word[:-CUT] < least) | (word[CUT:] <= least)) & (since[CUT:] > CUT)
    return out | (since == CUT)


def _pieces(texts: list[str]):
    """Sentences of all texts: hash, row, words, start and end (code points in the text); ends take the white space
    that follows along."""
    word, row, start, end, data = hashing.words([t.lower() if t.isascii() else _lower(t) for t in texts])
    if not len(word):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    n = len(word)
    feed = np.cumsum(data == 10)
    last = np.r_[row[1:] != row[:-1], True]
    stop = last | _marked(data, end)
    stop[:-1] |= feed[start[1:]] > feed[end[:-1] - 1]
    stop |= _further(word, stop)
    to = np.flatnonzero(stop)
    of = np.r_[0, to[:-1] + 1]
    # polynomial over the words of a sentence, by the same cumulative sums as for bytes
    up, down = hashing._power(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word * up[:n], out=total[1:])
    h = hashing.mix((total[to + 1] - total[of]) * down[of] + (to + 1 - of).astype(np.uint64))
    # places in code points: bytes that do not continue a character, counted from the start of the text
    chars = np.cumsum((data & 0xC0) != 0x80)
    before = np.r_[0, chars]
    lengths = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    origin = np.r_[0, np.cumsum(lengths)[:-1]]
    at = row[of]
    begin = before[start[of]] - before[origin[at]]
    same = np.r_[at[1:] == at[:-1], False]
    finish = np.where(same, np.r_[begin[1:], 0], np.array([len(t) for t in texts])[at])
    return h, at, to + 1 - of, begin, finish


def _lower(t: str) -> str:
    """Lower case without a change of length (in UTF-8 bytes), so places stay those of the text."""
    low = t.lower()
    if len(low) == len(t) and len(low.encode("utf-8", "surrogatepass")) == len(t.encode("utf-8", "surrogatepass")):
        return low
    return "".join(c.lower() if len(c.lower().encode("utf-8", "surrogatepass")) == len(c.encode("utf-8", "surrogatepass")) and len(c.lower()) == 1 else c for c in t)


def _spans(h: np.ndarray, row: np.ndarray, count: np.ndarray, sentences: int, min_words: int):
    """First sentence of each span, the sentence after its last one, and two hashes; only spans that fit into the text."""
    n = len(h)
    total = np.r_[0, np.cumsum(count)]
    i = np.arange(n)
    # first j with words(i..j) >= min_words, and at least `sentences`
    j = np.maximum(np.searchsorted(total, total[:-1] + min_words, side="left"), i + sentences)
    ok = (j <= n) & (row[np.minimum(j, n) - 1] == row) if n else np.zeros(0, bool)
    up, down = hashing._power(n + 1)
    i, j = i[ok], j[ok]
    both = []
    for unit in (h, hashing.mix(h ^ _SECOND)):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(unit * up[:n], out=sums[1:])
        both.append(hashing.mix((sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64)))
    return i, j, *both


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= BATCH_CHARS:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def spans(rows: DataFrame, sentences: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """The spans of ``rows`` (``_row``, ``_id``, ``_text``): ``_row``, ``_id``, ``_span`` and ``_more`` (64 and 32 bits of
    hashes), ``_i`` (first sentence; the last one follows from the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _groups(texts):
                h, row, count, _, _ = _pieces(texts[a:b])
                i, _, s, more = _spans(h, row, count, sentences, min_words)
                at = row[i]
                first = np.searchsorted(row, at)
                take = pa.array(at + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(hashing.as_signed(s)), pa.array((more >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array((i - first).astype(np.int32))],
                    names=["_row", "_id", "_span", "_more", "_i"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_row", "_id", "_text").mapInArrow(run, f"_row long, _id {kind}, _span long, _more int, _i int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: ``id_col`` (of any type that can be ordered), ``n_sentences``, ``n_removed``, ``removed``
    (places start:end of what goes, in code points), ``text`` (what stays).

    A null text counts as empty. Of a span's occurrences the first one stays: that of the smallest id (null ids come
    last), of equal ids that of the row which the table gave first, then the first in the text. So of two equal rows
    one stays whole, whether their ids are equal, different or null. Other columns are ignored."""
    text_batches(docs.sparkSession)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), "rows")
    found = materialize(spans(rows, sentences, min_words), "spans")
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("_row").alias("r"), F.col("_i").alias("i"))
    many = found.groupBy("_span", "_more").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    many = materialize(many.select("_span", "_more", F.col("_first.r").alias("_r"), F.col("_first.i").alias("_f")), "repeated")
    # spans that stand once are passed over before they are dealt to the join
    again = near.sift(found.select("_span", "_more", "_row", "_i"), "_span", near.bitmap(many, "_span", FILTER_BITS))
    again = again.join(many, ["_span", "_more"]).where((F.col("_row") != F.col("_r")) | (F.col("_i") != F.col("_f")))
    # the sentences of one document; spans of a document are no more than its sentences
    covered = materialize(again.groupBy(F.col("_row").alias("_c")).agg(F.collect_set("_i").alias("_spans")), "covered")
    release(found, many)
    joined = rows.join(covered, F.col("_row") == F.col("_c"), "left").select("_id", "_text", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                part = texts[a:b]
                h, row, count, begin, finish = _pieces(part)
                i, j, _, _ = _spans(h, row, count, sentences, min_words)
                n = np.bincount(row, minlength=b - a)
                first = np.searchsorted(row, np.arange(b - a))
                ends = np.zeros(len(h) + 1, dtype=np.int64)
                ends[i] = j
                lists = batch.column(2).slice(a, b - a)
                own = np.repeat(first, lists.value_lengths().fill_null(0).to_numpy()) + lists.flatten().to_numpy()
                gone = np.bincount(own, minlength=len(h) + 1) - np.bincount(ends[own], minlength=len(h) + 1)
                gone = np.cumsum(gone)[:-1] > 0
                removed = np.bincount(row[gone], minlength=b - a)
                places, kept = [""] * (b - a), list(part)
                for k in np.flatnonzero(removed):
                    cuts, out, at = [], [], 0
                    edge = first[k] + np.flatnonzero(np.diff(np.r_[0, gone[first[k] : first[k] + n[k]].astype(np.int8), 0]))
                    for x, y in zip(edge[::2], edge[1::2], strict=True):
                        p, q = int(begin[x]), int(finish[y - 1])
                        cuts.append(f"{p}:{q}")
                        out.append(part[k][at:p])
                        at = q
                    places[k], kept[k] = ",".join(cuts), "".join([*out, part[k][at:]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(places, pa.string()), pa.array(kept, pa.string())],
                    names=[id_col, "n_sentences", "n_removed", "removed", "text"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_sentences long, n_removed long, removed string, text string")
