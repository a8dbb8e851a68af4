"""Byte-pair merging of token arrays.

A sequence is kept as one string with a blank on either side of every token, so applying a merge is a plain string
replacement: left to right and without overlap. Learning alternates counting pairs over the corpus with one
replacement; its state is a string column, written as a table every few merges, so that a step reads the last table and
applies the merges since then in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ngrams import bigrams
from ..sources import workspace

#: Merges between two written states while learning.
WRITE_EVERY = 10


def as_blanked(tokens: str | Column) -> Column:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.array_join(F.transform(t, lambda x: F.concat(F.lit(" "), x.cast("string"), F.lit(" "))), "")


def as_tokens(blanked: Column) -> Column:
    parts = F.filter(F.split(blanked, " "), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("int"))


def apply_merge(blanked: Column, a: int, b: int, new: int) -> Column:
    return F.replace(blanked, F.lit(f" {a}  {b} "), F.lit(f" {new} "))


def encode(docs: DataFrame, merges: list[tuple[int, int, int]], col: str = "tokens") -> DataFrame:
    """``docs`` with the merges (a, b, new) applied to ``col`` in order, in one projection."""
    s = as_blanked(col)
    for a, b, new in merges:
        s = apply_merge(s, a, b, new)
    return docs.withColumn(col, as_tokens(s))


def pair_counts(docs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``cnt`` of all adjacent pairs, overlapping ones too, with the first place: ``doc``, ``pos``."""
    rows = docs.select("doc_idx", F.posexplode(bigrams("tokens")).alias("pos", "p"))
    first = F.min(F.struct("doc_idx", "pos")).alias("first")
    return rows.groupBy(F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).agg(F.count(F.lit(1)).alias("cnt"), first).select("a", "b", "cnt", F.col("first.doc_idx").alias("doc"), F.col("first.pos").alias("pos"))


def most_frequent_pair(docs: DataFrame) -> DataFrame:
    """At most one row: the most frequent pair, of equal ones the one seen first in document order."""
    return pair_counts(docs).orderBy(F.desc("cnt"), "doc", "pos").limit(1)


@dataclass
class Merges:
    """Learned merges: (a, b, new) in order, with the pair's count at that step."""

    steps: list[tuple[int, int, int]]
    counts: list[int]
    base_vocab: int

    def table(self, spark) -> DataFrame:
        rows = [(i, a, b, n, c) for i, ((a, b, n), c) in enumerate(zip(self.steps, self.counts, strict=True))]
        return spark.createDataFrame(rows, "step long, a int, b int, new_id int, cnt long")

    def encode(self, docs: DataFrame, col: str = "tokens") -> DataFrame:
        return encode(docs, self.steps, col)


def fit(docs: DataFrame, merges: int = 200, min_frequency: int = 2) -> Merges:
    """Learn up to ``merges`` merges of integer tokens; stops when the best pair is rarer than ``min_frequency``.
    New ids follow the largest token. An empty corpus gives no merge.

    The state goes to the folder of ``workspace``; the table before goes when the next one stands."""
    spark = docs.sparkSession
    path = _written(docs.select("doc_idx", as_blanked("tokens").alias("_s")), spark)
    top = spark.read.parquet(path).select(F.max(F.array_max(as_tokens(F.col("_s")))).alias("m")).first()["m"]
    out = Merges([], [], 0 if top is None else int(top) + 1)
    since: list[tuple[int, int, int]] = []
    for step in range(merges if top is not None else 0):
        best = most_frequent_pair(_merged(spark, path, since).select("doc_idx", as_tokens(F.col("_s")).alias("tokens"))).first()
        if best is None or best["cnt"] < min_frequency:
            break
        merge = (int(best["a"]), int(best["b"]), out.base_vocab + step)
        out.steps.append(merge)
        out.counts.append(int(best["cnt"]))
        since.append(merge)
        if len(since) == WRITE_EVERY and step + 1 < merges:
            path, before = _written(_merged(spark, path, since), spark), path
            workspace.remove(before)
            since = []
    workspace.remove(path)
    return out


def _written(state: DataFrame, spark) -> str:
    path = workspace.new_path(spark, "merging")
    state.write.parquet(path)
    return path


def _merged(spark, path: str, merges: list[tuple[int, int, int]]) -> DataFrame:
    s = F.col("_s")
    for a, b, new in merges:
        s = apply_merge(s, a, b, new)
    return spark.read.parquet(path).select("doc_idx", s.alias("_s"))


def fit_to_vocabulary(docs: DataFrame, vocab_size: int = 1024, min_frequency: int = 2) -> Merges:
    """As ``fit``, until the vocabulary has ``vocab_size`` ids; none if the tokens fill it already."""
    top = docs.select(F.max(F.array_max("tokens")).alias("m")).first()["m"]
    return fit(docs, 0 if top is None else max(0, vocab_size - int(top) - 1), min_frequency)


def merge_frequencies(docs: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """``step``, ``a``, ``b``, ``new_id``, ``cnt``: the pair's occurrences, overlapping ones too, just before its merge.

    One pass: the sequence before every merge is a column, and its pairs are counted within the row."""
    if not merges:
        return docs.sparkSession.createDataFrame([], "step long, a int, b int, new_id int, cnt long")
    rows, counts = docs.select(as_blanked("tokens").alias("_s0")), []
    for i, (a, b, new) in enumerate(merges):
        # a column of its own, as the pairs are counted in a function of its tokens
        rows = rows.withColumn(f"_s{i + 1}", apply_merge(F.col(f"_s{i}"), a, b, new)).withColumn(f"_t{i}", as_tokens(F.col(f"_s{i}")))
        hits = F.size(F.filter(bigrams(f"_t{i}"), _is_pair(a, b))).cast("long")
        counts.append(F.struct(F.lit(i).cast("long").alias("step"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(new).alias("new_id"), hits.alias("n")))
    each = rows.select(F.explode(F.array(*counts)).alias("x"))
    return each.groupBy("x.step", "x.a", "x.b", "x.new_id").agg(F.sum("x.n").alias("cnt"))


def _is_pair(a: int, b: int):
    return lambda p: (p[0] == a) & (p[1] == b)


def compression_ratio(original: DataFrame, encoded: DataFrame) -> DataFrame:
    """One row: ``ratio``, the mean over non-empty sequences of encoded over original length; 1 if there is none."""
    o = original.select("doc_idx", F.size("tokens").alias("_o")).where("_o > 0")
    e = encoded.select("doc_idx", F.size("tokens").alias("_e"))
    return o.join(e, "doc_idx").agg(F.coalesce(F.avg(F.col("_e") / F.col("_o")), F.lit(1.0)).alias("ratio"))
