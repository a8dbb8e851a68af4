"""Near-duplicate documents: a Jaccard join of word n-gram sets by MinHash banding.

Texts with the same n-gram set are one class from the start. Classes meet in the buckets of their band hashes; every
pair of a bucket is verified on its full sets; linked classes form components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, near
from .common import materialize, text_batches, text_or_empty

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995
BATCH_CHARS = 1 << 18


def shingler(n: int):
    """Distinct runs of ``n`` lower-case words between white space; a shorter text has one run, all of its words."""

    def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        word, row, *_ = hashing.words([t.lower() for t in texts])
        return hashing.row_runs(word, row, n, len(texts))

    return shingles


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= BATCH_CHARS:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``_id``, ``_hash`` as given, and of the text: ``_d``, ``_e`` (a 128-bit digest of its set), ``_n`` (its size),
    ``_bands``. A text without words has size 0 and no bands."""
    shingles = shingler(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _groups(texts):
                at, h = shingles(texts[a:b])
                size = np.bincount(at, minlength=b - a)
                has = np.flatnonzero(size)
                d, e = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                keys = np.zeros((0, bands), np.uint64)
                if len(has):
                    starts = np.r_[0, np.cumsum(size[has])[:-1]]
                    d[has] = np.add.reduceat(hashing.mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    e[has] = np.add.reduceat(hashing.mix(h ^ np.uint64(0x14057B7EF767814F)), starts)
                    keys = near.band_keys(near.minima(h, starts, bands * rows), bands, rows)
                offsets = np.r_[0, np.cumsum((size > 0) * bands)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashing.as_signed(keys.ravel())))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(hashing.as_signed(d)), pa.array(hashing.as_signed(e)), pa.array(size.astype(np.int64)), lists],
                    names=["_id", "_hash", "_d", "_e", "_n", "_bands"],
                )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, _hash long, _d long, _e long, _n long, _bands array<long>")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: ``id_col``, ``class_id`` (least id of the rows linked with it, over any number of
    links), ``class_size``, ``n_links`` (other rows with this similarity or more, copies included), ``n_text_links``
    (other n-gram sets among them), ``kept`` (one row of each class), ``text_hash`` (xxhash64 of the text).

    A null text counts as empty; texts without words form one class. Null ids come after all others; of rows with one
    id the one with the least hash of the text stays. ``recall`` is
    the probability with which a pair right at the threshold becomes a candidate; a more similar pair's is higher."""
    text_batches(docs.sparkSession)
    bands, rows = near.choose_bands(threshold, recall)
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_hash"), text_or_empty(text_col).alias("_text"))
    sig = materialize(signatures(source, n, bands, rows).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    by_id = (F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_hash").alias("hash"), F.col("_row").alias("row"))
    sets = materialize(sig.groupBy("_d", "_e", "_n").agg(near.first_of(*by_id).alias("_first"), F.count(F.lit(1)).alias("_copies")).withColumn("_row", F.col("_first.row")), "sets")
    reps = sig.where("_n > 0").join(sets.select("_row", "_copies"), "_row")
    keys = materialize(reps.select("_row", "_n", F.explode("_bands").alias("_key")), "keys")
    groups = near.candidate_groups(keys)
    items = materialize(reps.select("_row", "_id", "_hash", "_copies").join(groups, "_row"), "items")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))
    texts = near.sift(source.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_text"), "_h", near.bitmap(items, "_hash"))
    # rows that repeat a representative's id and text repeat the item, which counts once
    joined = items.join(texts, same).select("_row", "_copies", "_groups", "_text")
    found = materialize(near.verify(joined, shingler(n), threshold), "links")
    links = found.where("_other IS NULL").groupBy("_row").agg(F.sum("_texts").alias("_texts"), F.sum("_docs").alias("_docs"))
    labels = near.components(found.where("_other IS NOT NULL").select(F.col("_row").alias("_a"), F.col("_other").alias("_b")))
    labelled = materialize(sets.join(labels, "_row", "left").join(links, "_row", "left").withColumn("_label", F.coalesce("_label", "_row")), "labelled")
    classes = materialize(labelled.groupBy("_label").agg(F.min("_first").alias("_keep"), F.sum("_copies").alias("_size")), "classes")
    whole = materialize(labelled.join(classes, "_label").select("_d", "_e", "_n", "_keep", "_size", "_copies", "_texts", "_docs"), "whole")
    return sig.select("_id", "_hash", "_row", "_d", "_e", "_n").join(whole, ["_d", "_e", "_n"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep.id").alias("class_id"),
        F.col("_size").alias("class_size"),
        (F.coalesce("_docs", F.lit(0)) + F.col("_copies") - 1).alias("n_links"),
        F.coalesce("_texts", F.lit(0)).alias("n_text_links"),
        (F.col("_row") == F.col("_keep.row")).alias("kept"),
        F.col("_hash").alias("text_hash"),
    )
