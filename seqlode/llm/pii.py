"""Personal data by candidate gradient boosting, with built-in functions only.

High-recall patterns propose spans, which may overlap, of three sorts: strict matches, near misses (dotted names
without an at-sign, dotted numbers of two or three parts, groups of digits) and loose ways of writing a kind. Boosted
trees score them by shape and context. They learn from weak labels that neither shape nor context holds: a strict match
that passes its check (octets, Luhn, number of digits, a top-level domain of letters) is valid; one that fails, and a
near miss that is known to be something else, is not. Loose candidates carry no label and are not learned from; they are
brought into the shape of strict ones (an "(at)" is read as the sign, a country code is left out) and scored like them.
The threshold of a kind is the lowest one that is precise enough on a held-out fourth of the rows; a kind without
negatives, or with too few held-out rows to show it, adds nothing. Valid strict matches are always kept."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import materialize, text_or_empty
from .spans import add_all_spans, digits_of, joined, luhn

KINDS = ["email", "ip", "card", "phone"]

#: Strict patterns. Possessive quantifiers and the look-behinds change no match; they keep long runs linear.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What resembles a kind. Cards need none: their strict pattern takes any number.
NEAR = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)++(?![@.])",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){1,2}+(?!\.?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?<!\+[0-9]{1,3}\x20)\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++){0,6}+(?![0-9A-Za-z])",
}
#: Generators beyond the strict patterns.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\.)[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.(])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{4}(?![0-9A-Za-z])",
}
#: Words that announce a kind, and words that announce something else, in the text before a span.
CUES = {
    "email": r"(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|payment|credit",
    "phone": r"(?i)phone|tel|call|mobile|fax",
}
OTHERS = {
    "email": r"(?i)https?:|www|file|version|import",
    "ip": r"(?i)version|section|chapter|release|licen[cs]e|\bv\.?$",
    "card": r"(?i)order|invoice|ticket|isbn|serial|\bid\b",
    "phone": r"(?i)order|invoice|ticket|isbn|page|version|serial|\bid\b",
}
#: Levels of the features that a kind's model sees: what its check looks at is not among them, or only coarsely. Beside
#: them the flags: a word of CUES, a word of OTHERS, a letter or digit that touches the span.
LEVELS = {
    "email": {"letters": 9, "parts": 7, "digits": 4},
    "ip": {"digits": 13, "longest": 7, "letters": 3},
    "card": {"digits": 10, "breaks": 7, "longest": 7},
    "phone": {"parts": 7, "breaks": 7, "longest": 7},
}
FLAGS = ["cue", "other", "glued"]
SHAPE = ["digits", "letters", "parts", "breaks", "longest"]
#: Bound of the table of distinct feature vectors that the driver fits to, half of them held out.
MAX_CELLS = sum(math.prod(x.values()) for x in LEVELS.values()) * 2 ** (len(FLAGS) + 1)
#: Precision that a threshold must show on held-out rows, counted with one row of either sort added.
PRECISION = 0.9


def _valid(kind: str, value: Column) -> Column:
    """The check of the base patterns."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= F.lit("255"))))
    n = F.length(digits_of(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(value)).otherwise(False)
    return n.between(9, 15)


def _refuted(kind: str, value: Column) -> Column:
    """Whether a near miss is known to be something else."""
    if kind != "phone":
        return F.lit(True)
    n = F.length(digits_of(value))
    dated = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{2,4}$|^[0-9]+(\.[0-9]+)+$")
    return ~n.between(7, 15) | dated | F.when(n.between(13, 19), luhn(value)).otherwise(False)


def _shaped(kind: str, value: Column) -> Column:
    """A value as its strict form would look."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(value, r"\x20?[(\[{]at[)\]}]\x20?", "@"), r"\x20?[(\[{]dot[)\]}]\x20?", ".")
    return F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20.-]+", "") if kind == "phone" else value


def _described(kind: str, x: Column, sort: str) -> Column:
    """A candidate: its place, ``label`` (1 valid, 0 not, null unknown), whether it is a base span, and its features as
    small integers."""
    v = _shaped(kind, x["value"])
    count = lambda chars: F.length(v) - F.length(F.regexp_replace(v, chars, ""))
    level = lambda c, name: F.least(F.greatest(c, F.lit(0)), F.lit(LEVELS[kind].get(name, 1) - 1)).cast("int").alias(name)
    edge = F.concat(F.right(x["left"], F.lit(1)), F.left(x["right"], F.lit(1)))
    digits, letters = count("[0-9]"), count("[A-Za-z]")
    parts = F.split(v, r"[^0-9A-Za-z]+")
    base = _valid(kind, x["value"]) if sort == "strict" else F.lit(False)
    if sort == "strict":
        # an address whose last part has no letters, say of a package and its version, teaches as invalid
        label = (base & v.rlike(r"\.[A-Za-z-]{2,24}$") if kind == "email" else base).cast("int")
    else:
        label = F.lit(0 if sort == "near" else None).cast("int")
    return F.struct(
        F.lit(kind).alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        label.alias("label"),
        base.alias("base"),
        level({"email": F.ceil(digits / 2), "card": digits - 11}.get(kind, digits), "digits"),
        level(letters / 4 if kind == "email" else letters, "letters"),
        level(F.size(F.filter(parts, lambda p: p != "")), "parts"),
        level(F.length(v) - digits - letters, "breaks"),
        level(F.array_max(F.transform(parts, lambda p: F.length(p))), "longest"),
        x["left"].rlike(CUES[kind]).cast("int").alias("cue"),
        x["left"].rlike(OTHERS[kind]).cast("int").alias("other"),
        edge.rlike("[0-9A-Za-z_]").cast("int").alias("glued"),
    )


def _describer(kind: str, sort: str):
    return lambda x: _described(kind, x, sort)


def _keeper(kind: str, sort: str):
    """Which matches are candidates: near misses that are refuted, loose ones that pass the check of the kind."""
    if sort == "near":
        return lambda x: _refuted(kind, x["value"])
    return (lambda x: _valid(kind, x["value"])) if kind == "card" else lambda x: F.lit(True)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` and ``cands``, the described candidates of every text by kind, sort and start, the near misses among
    them; they only teach."""
    df = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    has_digit = F.col("_text").rlike("[0-9]")
    tests = {
        ("email", "strict"): F.contains("_text", F.lit("@")),
        ("phone", "strict"): F.contains("_text", F.lit("+")),
        ("email", "near"): F.col("_text").rlike(r"[A-Za-z0-9_%+-]\.[A-Za-z0-9_%+-]"),
        ("ip", "near"): F.col("_text").rlike(r"[0-9]\.[0-9]"),
        ("email", "loose"): F.col("_text").rlike(r"[(\[{]at[)\]}]"),
        ("ip", "loose"): F.col("_text").rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    }
    sorts = {"strict": STRICT, "near": NEAR, "loose": LOOSE}
    every = [(kind, sort, f"{kind}_{sort}") for kind in KINDS for sort in sorts if kind in sorts[sort]]
    df = add_all_spans(df, "_text", {out: (sorts[sort][kind], tests.get((kind, sort), has_digit)) for kind, sort, out in every})
    made = []
    for kind, sort, out in every:
        some = F.col(out) if sort == "strict" else F.filter(out, _keeper(kind, sort))
        made.append(F.transform(some, _describer(kind, sort)))
    return df.select("_id", F.concat(*made).alias("cands"))


def fit_models(found: DataFrame, precision: float = PRECISION) -> dict[str, boosting.Boosted]:
    """A model for each kind that has valid and invalid candidates in ``found`` (see ``candidates``), with its threshold
    and what held-out rows show for it. All labelled candidates of the table are counted, by feature vector."""
    each = found.select(F.explode(F.filter("cands", lambda x: x["label"].isNotNull())).alias("c"), (F.pmod(F.xxhash64("_id"), F.lit(4)) == 0).alias("held"))
    # by id: a held-out fourth calibrates what the rest has taught; at most MAX_CELLS rows
    cells = each.groupBy("c.kind", "held", *(f"c.{f}" for f in (*SHAPE, *FLAGS))).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.label").cast("long")).alias("pos"))
    cells = [r.asDict() for r in cells.collect()]
    models = {}
    for kind in KINDS:
        names = [*LEVELS[kind], *FLAGS]
        own = sorted((c for c in cells if c["kind"] == kind), key=lambda c: (c["held"], *(c[f] for f in names)))
        taught, held = ([c for c in own if c["held"] == h] for h in (False, True))
        pos, n = sum(c["pos"] for c in taught), sum(c["n"] for c in taught)
        if 0 < pos < n:
            models[kind] = boosting.fit(taught, names)
            boosting.calibrate(models[kind], held, precision)
    return models


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per input row: ``id_col`` and ``spans``, an array of (kind, start, end, base, score) by kind and start.

    Places are in code points, ends exclusive. A null text counts as empty; an empty table gives an empty result. Rows
    that repeat an id or a whole row are rows of their own; other columns are ignored, whatever their names.
    ``base`` marks valid strict matches, the others are loose candidates that the model selected."""
    found = materialize(candidates(docs, id_col, text_col), "pii")
    models = fit_models(found, precision)

    def by_kind(values: dict[str, str], other: str) -> str:
        return " ".join(["CASE x.kind", *(f"WHEN '{k}' THEN {v}" for k, v in values.items()), f"ELSE {other} END"]) if values else other

    score = by_kind({k: m.sql(lambda f: f"x.{f}") for k, m in models.items()}, "0D")
    least = by_kind({k: f"{m.threshold!r}D" for k, m in models.items()}, "2D")
    # near misses and failing strict matches have taught; they are no spans
    scored = f"transform(filter(cands, x -> x.base OR x.label IS NULL), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'base', x.base, 'score', {score}))"
    spans = f"filter({scored}, x -> x.base OR x.score >= {least})"
    rank = "array_position(array({}), x.kind)".format(", ".join(f"'{k}'" for k in KINDS))
    keyed = f"transform({spans}, x -> named_struct('rank', {rank}, 'start', x.start, 'end', x.end, 'added', NOT x.base, 'span', x))"
    return found.select(F.col("_id").alias(id_col), F.expr(f"transform(array_sort({keyed}), x -> x.span)").alias("spans"))


def held_out_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> dict[str, dict]:
    """For each kind with a model: splits, threshold, and held-out positives, negatives, precision and recall at it."""
    models = fit_models(materialize(candidates(docs, id_col, text_col), "pii"), precision)
    return {k: {"splits": sum(t.low is not None for t in m.trees), "threshold": m.threshold} | m.shown for k, m in models.items()}


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans", out: str = "redacted") -> DataFrame:
    """Add the text with every span replaced by its kind in brackets; overlapping spans are replaced together, under
    the kind of the first."""
    by_place = F.array_sort(F.transform(spans_col, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = text_or_empty(text_col)
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["done"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], piece).otherwise(acc["done"]).alias("done"))

    whole = F.aggregate(by_place, init, step, lambda acc: F.concat(acc["done"], F.substr(text, acc["at"] + 1)))
    return df.withColumn(out, whole)


def report(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return result.select(id_col, *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
