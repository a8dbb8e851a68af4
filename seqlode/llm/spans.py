"""Regular-expression matches with their positions, from built-in functions only.

Spark has no function that gives the place of a match, but the gaps that ``split`` leaves and the matches that
``regexp_extract_all`` finds alternate, so running sums of their lengths are the places, in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements summed one after another; arrays are built block by block, so their cost stays near-linear.
BLOCK = 64
#: Characters kept on either side of a match.
CONTEXT = 32

SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def running_sum(a: str) -> str:
    """Inclusive running sums of a non-empty array<int>, as SQL of a column's name. (Texts of SQL make plans of many
    patterns quick to build.)"""
    blocks = f"transform(sequence(0, cast(floor((size({a}) - 1) / {BLOCK}) AS int)), b -> slice({a}, b * {BLOCK} + 1, {BLOCK}))"
    sums = f"transform({blocks}, b -> aggregate(b, 0, (t, x) -> t + x))"
    grow = "(t, x) -> concat(t, array(element_at(t, -1) + x))"
    starts = f"slice(aggregate({sums}, array(0), {grow}), 1, size({sums}))"
    return f"flatten(zip_with({blocks}, {starts}, (b, s) -> slice(aggregate(b, array(s), {grow}), 2, {BLOCK})))"


def add_spans(df: DataFrame, text_col: str, pattern: str, out: str, only_if: Column | None = None) -> DataFrame:
    """Add ``out``: the leftmost non-overlapping matches of a pattern (no empty ones), in order. The array is empty if
    there is none or ``only_if`` (a cheap test that every text with a match passes) is false."""
    return add_all_spans(df, text_col, {out: (pattern, only_if)})


def add_all_spans(df: DataFrame, text_col: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """``add_spans`` for several patterns (column: pattern, test) in the same few steps, which keeps plans short."""
    text, empty = F.col(text_col), F.array().cast("array<string>")
    m, g, s, n = (lambda out, x=x: f"_{out}_{x}" for x in "mgsn")  # matches, gaps, steps, places

    def found(pattern: str, only_if: Column | None) -> Column:
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return every if only_if is None else F.when(only_if, every).otherwise(empty)

    def some(out: str, sql: str, other: str = "NULL") -> Column:
        return F.expr(f"CASE WHEN size({m(out)}) > 0 THEN {sql} ELSE {other} END")

    def steps(out: str) -> str:
        return f"transform(sequence(0, size({m(out)}) - 1), i -> length({g(out)}[i]) + CASE WHEN i > 0 THEN length(get({m(out)}, i - 1)) ELSE 0 END)"

    def spans(out: str) -> str:
        value, gap, at = f"{m(out)}[i]", f"{g(out)}[i]", f"{n(out)}[i]"
        sides = f"'left', right({gap}, {CONTEXT}), 'right', left(get({g(out)}, i + 1), {CONTEXT})"
        return f"transform(sequence(0, size({m(out)}) - 1), i -> named_struct('start', {at}, 'end', {at} + length({value}), 'value', {value}, {sides}))"

    df = df.withColumns({m(out): found(*p) for out, p in patterns.items()})
    df = df.withColumns({g(out): F.when(F.size(m(out)) > 0, F.split(text, p, -1)) for out, (p, _) in patterns.items()})
    df = df.withColumns({s(out): some(out, steps(out)) for out in patterns})
    df = df.withColumns({n(out): some(out, running_sum(s(out))) for out in patterns})
    df = df.withColumns({out: some(out, spans(out), f"CAST(array() AS {SPAN})") for out in patterns})
    return df.drop(*(x(out) for out in patterns for x in (m, g, s, n)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    d = digits_of(value)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.ascii(F.substr(d, n - i + 1, F.lit(1))) - 48
        return acc + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
