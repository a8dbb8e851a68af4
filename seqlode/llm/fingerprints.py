"""Document fingerprints: bottom-k sketches of word shingle hashes, from built-in functions only.

A sketch is the ascending array of the K smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge
into the sketch of the whole; two of them estimate resemblance and containment, one the number of distinct shingles.
With fewer than K shingles all of these are exact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_or_empty

K = 128
SHINGLE = 5
WORDS = r"[^\p{L}\p{N}]+"


def add_sketch(df: DataFrame, text: Column, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Add ``out`` (array<bigint>): the sketch of a text's runs of ``shingle`` lower-case words (letters and digits).

    A text of fewer words has one shingle, all of its words; a text without words, an empty or null one has an empty
    sketch. A very long text is one array of numbers, eight bytes a word, while its row is worked on."""
    w, n = f"_{out}_w", f"_{out}_n"
    words = F.filter(F.split(F.lower(text_or_empty(text)), WORDS), lambda x: x != "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    df = df.withColumn(n, F.size(w) - (shingle - 1))
    runs = F.transform(F.slice(F.col(w), F.lit(1), F.greatest(F.col(n), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + j) for j in range(1, shingle))))
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    hashes = F.when(F.col(n) > 0, runs).otherwise(few)
    return df.withColumn(out, bottom(F.array_distinct(hashes), k)).drop(w, n)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together. Shingles across their border are in neither part."""
    return bottom(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 if both are empty, 0 if one is."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    part = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(part, F.lit(2.0**-64)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    own, whole = distinct_count(a, k), distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * whole / own))


def as_text(a: Column) -> Column:
    """A sketch as a string: Base64 of its hashes, eight bytes each."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), "\r\n", "")


def from_text(s: Column) -> Column:
    hexa = F.hex(F.unbase64(s))
    n = F.floor(F.length(hexa) / 16).cast("int")
    at = lambda i: F.conv(F.substr(hexa, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<bigint>"))


def _place(bounds: list[int]) -> tuple[Column, callable]:
    """Number of ``bounds`` below ``_key``, in two steps of about sqrt(len(bounds)) comparisons."""
    step = max(1, math.isqrt(len(bounds)))
    literal = lambda xs: F.expr(f"array({', '.join(f'{x}L' for x in xs)})") if xs else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(literal(bounds[::step]), lambda b: b < F.col("_key")))
    fine = lambda c: F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + F.size(F.filter(F.slice(literal(bounds), (c - 1) * step + 1, F.lit(step)), lambda b: b < F.col("_key"))))
    return coarse, fine


def bucketed_by_id(docs: DataFrame, id_col: str = "doc_id", per_partition: int = 4) -> DataFrame:
    """Rows dealt to buckets of neighbouring ids: ``_key``, ``_bucket``, ``_extra`` are added.

    The first row (largest id) of each bucket is repeated, marked ``_extra``, in the bucket before it in descending
    order, and the overall first row in the last bucket, so each row's successor is in its own bucket. Bucket bounds
    are approximate quantiles of the ids, a few for each shuffle partition. A null id counts as the smallest."""
    lowest = F.lit(-(2**63) + 1)
    keyed = docs.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), lowest))
    n = per_partition * shuffle_partitions(docs.sparkSession)
    ids = keyed.select("_key")
    bounds = sorted({int(x) for x in ids.approxQuantile("_key", [i / n for i in range(1, n)], 1 / (4 * n)) or []})
    coarse, fine = _place(bounds)
    placed = lambda df: df.withColumn("_coarse", coarse).withColumn("_bucket", fine(F.col("_coarse"))).drop("_coarse")
    # one row for each bucket
    heads = sorted((r["_bucket"], r["head"]) for r in placed(ids).groupBy("_bucket").agg(F.max("_key").alias("head")).collect())
    if not heads:
        return placed(keyed).withColumn("_extra", F.lit(False))
    above = {head: heads[i + 1][0] for i, (_, head) in enumerate(heads[:-1])}
    also = F.when(F.col("_key").isin(list(above)), F.element_at(F.create_map(*(F.lit(x) for kv in above.items() for x in kv)), F.col("_key"))) if above else F.lit(None).cast("int")
    last = F.when(F.col("_key") == heads[-1][1], F.lit(heads[0][0]))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("x"))
    more = lambda c: F.struct(c.alias("b"), F.lit(True).alias("x"))
    rows = placed(keyed).withColumn("_to", F.explode(F.filter(F.array(own, more(also), more(last)), lambda s: s["b"].isNotNull())))
    return rows.withColumns({"_bucket": F.col("_to.b"), "_extra": F.col("_to.x")}).drop("_to")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every text, of its edited text and of the next document (descending id).

    The edited text has its last half replaced by as much of the next document's start. Columns: ``id_col``, ``text``,
    ``edited``, ``sketch``, ``edited_sketch``, ``next_sketch``."""
    rows = bucketed_by_id(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), "_id").repartition("_bucket")
    rows = add_sketch(rows, F.col("_text"), "sketch")
    order = Window.partitionBy("_bucket").orderBy("_extra", F.desc("_key"), F.xxhash64("_text"))
    rows = rows.withColumns({"_next": F.lead("_text").over(order), "next_sketch": F.lead("sketch").over(order)}).where("NOT _extra")
    rows = rows.withColumn("_n", F.length("_text")).withColumn("_half", F.floor(F.col("_n") / 2).cast("int"))
    edited = F.concat(F.substr("_text", F.lit(1), F.col("_n") - F.col("_half")), F.substr("_next", F.lit(1), F.col("_half")))
    rows = rows.withColumn("edited", edited).drop("_next")
    rows = add_sketch(rows, F.col("edited"), "edited_sketch")
    return rows.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), "edited", "sketch", "edited_sketch", "next_sketch")


def report(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(
        id_col,
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
