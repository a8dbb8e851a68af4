"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A small network routes the
patterns' words to the sources' quotas: each repetition of a pattern is an arc of its own whose cost grows with the
repetition, so fresh words are used before repeated ones. Seeded documents then fill the routed amounts."""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: A document is taken this many times at most.
MAX_REPEATS = 3
#: Hexadecimal digits of the order key that name a bucket: 4096 buckets a pattern.
BUCKET_DIGITS = 3
#: Size classes, in parts of what a pattern misses or its mean size, from which the last moves are chosen; sizes reach
#: twice that.
CLASSES = 8
#: More patterns than this are refused, as the network is solved on the driver.
MAX_PATTERNS = 100_000


def word_count(text_col: str = "text"):
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def cycle_weights(sources: list[str | None], weights: tuple[int, ...] = (1, 2, 3)) -> list[int]:
    """Weights by code point order of the names, null last, repeating."""
    order = sorted(range(len(sources)), key=lambda i: (sources[i] is None, [ord(c) for c in sources[i] or ""]))
    out = [0] * len(sources)
    for rank, i in enumerate(order):
        out[i] = weights[rank % len(weights)]
    return out


def fair_targets(sizes: list[int], weights: list[int], total: int, most: int = MAX_REPEATS) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` times its size and the excess is shared again."""
    caps = [most * n for n in sizes]
    left, weight, level = total, sum(weights), 0.0
    for i in sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i)):
        level = left / weight
        if caps[i] / weights[i] > level:
            break
        left, weight = left - caps[i], weight - weights[i]
        level = float("inf")
    return [float(c) if c / w <= level else w * level for c, w in zip(caps, weights, strict=True)]


@dataclass
class _Arc:
    to: int
    cap: int
    cost: int
    back: int


class FlowNetwork:
    """Min-cost flow in phases: potentials by Dijkstra's distances, then all flow that the arcs of least cost can take.
    Costs are not negative; there is a phase for each cost of a path that occurs, not for each path."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]
        self.height = [0] * nodes

    def add(self, a: int, b: int, cap: int, cost: int = 0) -> tuple[int, int]:
        self.arcs[a].append(_Arc(b, cap, cost, len(self.arcs[b])))
        self.arcs[b].append(_Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return a, len(self.arcs[a]) - 1

    def used(self, arc: tuple[int, int]) -> int:
        x = self.arcs[arc[0]][arc[1]]
        return self.arcs[x.to][x.back].cap

    def solve(self, s: int, t: int) -> int:
        flow = 0
        while self._raise(s, t):
            while level := self._levels(s, t):
                flow += self._push(s, t, level)
        return flow

    def _free(self, v: int, x: _Arc) -> bool:
        """Whether an arc has room and lies on a path of least cost."""
        return x.cap > 0 and x.cost + self.height[v] == self.height[x.to]

    def _raise(self, s: int, t: int) -> bool:
        """Add the distances from ``s`` to the potentials; false if ``t`` is out of reach."""
        dist: list[int | None] = [None] * len(self.arcs)
        dist[s], heap = 0, [(0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for x in self.arcs[v]:
                if x.cap > 0:
                    e = d + x.cost + self.height[v] - self.height[x.to]
                    if dist[x.to] is None or e < dist[x.to]:
                        dist[x.to] = e
                        heapq.heappush(heap, (e, x.to))
        far = max(d for d in dist if d is not None)
        self.height = [h + (d if d is not None else far) for h, d in zip(self.height, dist, strict=True)]
        return dist[t] is not None

    def _levels(self, s: int, t: int) -> list[int] | None:
        """Number of free arcs from ``s`` to each node, -1 out of reach; None if that is so for ``t``."""
        level, row = [-1] * len(self.arcs), [s]
        level[s] = 0
        while row:
            later = []
            for v in row:
                for x in self.arcs[v]:
                    if level[x.to] < 0 and self._free(v, x):
                        level[x.to] = level[v] + 1
                        later.append(x.to)
            row = later
        return level if level[t] >= 0 else None

    def _push(self, s: int, t: int, level: list[int]) -> int:
        """Fill the free paths that go up one level at a time until each has a full arc."""
        flow, at, path, v = 0, [0] * len(self.arcs), [], s
        while True:
            if v == t:
                push = min(x.cap for _, x in path)
                for _, x in path:
                    x.cap -= push
                    self.arcs[x.to][x.back].cap += push
                flow += push
                path, v = [], s
                continue
            while at[v] < len(self.arcs[v]):
                x = self.arcs[v][at[v]]
                if level[x.to] == level[v] + 1 and self._free(v, x):
                    path.append((v, x))
                    v = x.to
                    break
                at[v] += 1
            else:
                if not path:
                    return flow
                v, _ = path.pop()
                at[v] += 1


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int = MAX_REPEATS) -> list[list[tuple[int, int]]]:
    """For each pattern (its sources, its words) the (source, words) it gives, whose sum is at most ``most`` times its
    words; the quotas are met as far as possible, with as few repetitions as possible."""
    p, q = len(patterns), len(quotas)
    net = FlowNetwork(p + q + 2)
    s, t = p + q, p + q + 1
    given = []
    for i, (members, words) in enumerate(patterns):
        for repetition in range(most):
            net.add(s, i, words, repetition)
        given.append([(m, net.add(i, p + m, most * words)) for m in members])
    for m, quota in enumerate(quotas):
        net.add(p + m, t, quota)
    net.solve(s, t)
    return [[(m, net.used(arc)) for m, arc in arcs if net.used(arc)] for arcs in given]


def mix(
    docs: DataFrame,
    members_col: str = "sources",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    seed: str = "mix",
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``members``, ``size`` (words), ``source_size`` and ``target`` (of its
    first source), ``repeats`` (0 to 3 whole takes), ``taken`` (words).

    ``members_col`` is an array of sources, which may hold null (a source of its own); a null or empty array counts
    as [null]. Of a pattern's words the routed amount is filled in the order of md5(seed, id): whole passes, then
    the leading documents that fit the rest, then up to three of either kind change places where that comes nearer to the amount.
    A null text has size 0; rows with one id are told apart by size only."""
    spark = docs.sparkSession
    members = F.when(F.size(members_col) > 0, F.array_sort(F.array_distinct(members_col))).otherwise(F.array(F.lit(None).cast("string")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            members.alias("_members"),
            word_count(text_col).alias("_size"),
            order.alias("_order"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "sizes",
    )
    found = sized.groupBy("_members").agg(F.sum("_size").alias("words")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    # the flow's choice among equal ones depends on the order of the patterns
    found.sort(key=lambda r: (r["_members"] is None, [(m is None, m or "") for m in r["_members"] or ()]))
    plan = _plan(spark, found, weights)
    # words of each bucket, then of the buckets before it
    at = F.substring("_order", 1, BUCKET_DIGITS)
    sums = sized.groupBy("_members", at.alias("_bucket")).agg(F.sum("_size").alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("_members").orderBy("_bucket")) - F.col("_words")
    sums = sums.withColumn("_before", before).join(F.broadcast(plan), sums["_members"].eqNullSafe(plan["_pattern"]))
    border = sums.where("_rest > 0 AND _before <= _rest AND _before + _words > _rest").select("_pattern", "_bucket", "_before")
    border = border.groupBy("_pattern").agg(F.max(F.struct("_bucket", "_before")).alias("_border"))
    plan = materialize(plan.join(border.withColumnRenamed("_pattern", "_p"), F.col("_pattern").eqNullSafe(F.col("_p")), "left").drop("_p").coalesce(1), "plan")
    rows = sized.join(F.broadcast(plan), F.col("_members").eqNullSafe(F.col("_pattern"))).withColumn("_at", at)
    inside = F.col("_at") == F.col("_border._bucket")
    within = F.sum("_size").over(Window.partitionBy("_pattern").orderBy("_order", "_id", "_size", "_row").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where(inside).withColumn("_fits", F.col("_border._before") + within <= F.col("_rest"))
    outer = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("_fits", F.when(F.col("_border").isNull(), F.col("_rest") > 0).otherwise(F.col("_at") < F.col("_border._bucket")))
    chosen = materialize(outer.unionByName(edge).select("_row", "_id", "_members", "_size", "_order", "_pattern", "_full", "_rest", "_source_size", "_target", "_fits"), "chosen")
    picked = _picked(chosen)
    out = chosen.join(F.broadcast(picked), F.col("_row") == F.col("_pick"), "left")
    extra = F.col("_fits") != F.col("_pick").isNotNull()
    repeats = F.least(F.col("_full") + extra.cast("int"), F.lit(MAX_REPEATS))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_members").alias("members"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        repeats.cast("int").alias("repeats"),
        (repeats * F.col("_size")).cast("long").alias("taken"),
    )


def _picked(chosen: DataFrame) -> DataFrame:
    """``_pick``, the rows whose choice is turned round so that each pattern's words come nearer to what is routed.

    Of the documents left out and of those chosen the first one of each size class is looked at: a bounded number for
    each pattern, from which the best one, two or three moves are taken."""
    size = F.when(F.col("_fits"), F.col("_size"))
    missing = chosen.groupBy("_pattern").agg((F.max("_rest") - F.coalesce(F.sum(size), F.lit(0))).alias("_missing"), F.avg("_size").alias("_mean"))
    missing = missing.where("_missing > 0").select(F.col("_pattern").alias("_p"), "_missing", F.greatest("_missing", "_mean").alias("_scale"))
    moves = chosen.join(F.broadcast(missing), F.col("_pattern").eqNullSafe(F.col("_p"))).where("_size > 0 AND _size < 2 * _scale")
    class_ = F.floor(F.col("_size") * CLASSES / F.col("_scale"))
    first = F.min(F.struct("_order", "_id", "_size", "_row")).alias("x")
    found = moves.groupBy("_p", "_missing", "_fits", class_.alias("class")).agg(first).orderBy("_p", "_fits", "class").collect()
    by: dict = {}
    for r in found:
        by.setdefault(tuple(r["_p"]), (r["_missing"], []))[1].append((-r["x"]["_size"] if r["_fits"] else r["x"]["_size"], r["x"]["_row"]))
    picks = []
    for want, given in by.values():
        sets = (c for n in (1, 2, 3) for c in itertools.combinations(given, n))
        best = min(sets, key=lambda c: abs(want - sum(n for n, _ in c)))
        if abs(want - sum(n for n, _ in best)) < want:
            picks += [row for _, row in best]
    return chosen.sparkSession.createDataFrame([(x,) for x in picks], "_pick long")


def _plan(spark: SparkSession, found: list, weights: tuple[int, ...]) -> DataFrame:
    """A row per pattern: whole passes, words beyond them, its first source's size and target."""
    names = list(dict.fromkeys(m for r in found for m in r["_members"]))
    size = {m: sum(r["words"] for r in found if m in r["_members"]) for m in names}
    total = sum(r["words"] for r in found)
    targets = fair_targets([size[m] for m in names], cycle_weights(names, weights), total) if names else []
    at = {m: i for i, m in enumerate(names)}
    given = route([(tuple(at[m] for m in r["_members"]), r["words"]) for r in found], [round(t) for t in targets])
    rows = []
    for r, gives in zip(found, given, strict=True):
        flow, words, first = sum(n for _, n in gives), r["words"], r["_members"][0]
        full, rest = divmod(flow, words) if words else (0, 0)
        rows.append((r["_members"], int(full), int(rest), int(size[first]), float(targets[at[first]])))
    schema = T.StructType([
        T.StructField("_pattern", T.ArrayType(T.StringType())),
        T.StructField("_full", T.IntegerType()),
        T.StructField("_rest", T.LongType()),
        T.StructField("_source_size", T.LongType()),
        T.StructField("_target", T.DoubleType()),
    ])
    return spark.createDataFrame(rows, schema)


def by_source(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """``docs`` with the array column ``sources`` that ``mix`` reads."""
    return docs.withColumn("sources", F.array(F.col(source_col).cast("string")))


def report(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "size", "source_size", "target", "taken")
