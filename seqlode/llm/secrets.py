"""Secrets by corpus-wide ownership frequency, with built-in functions only.

Every candidate's value is hashed, and the hashes are counted by distinct owners and repositories over the whole
table. A value that many owners share is an example or a documented default; one that stays with its owner looks
live. Base candidates are reported either way, with that label; candidates of the further patterns are reported only
if they look live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .spans import add_all_spans, joined

KINDS = ["assign", "access", "hex"]

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base patterns; runs that are too short for a base match are left out by the pattern itself where that changes no
#: other match (``access`` and ``hex`` match whole runs).
BASE = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
#: What may stand between the lines of a key: white space (also as escapes), quotes, comment and list marks.
_GAP = r"""(?:\\[nrt]|\+(?=\s)|[\s"'`,;>#*|\\])*+"""
_END = r"-----END [A-Z ]{0,24}PRIVATE KEY-----"
#: A key with its header: lines of base64, with the END line if it follows, or else whatever stands before the END
#: line. A header without either is no key.
PEM = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
    + rf"(?:{_GAP}[A-Za-z][A-Za-z0-9-]{{1,40}}+: [^\r\n\\]{{0,200}}+){{0,8}}+"
    + rf"(?:(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+){{1,1000}}+(?:{_GAP}[A-Za-z0-9+/]{{0,15}}+={{0,2}}+{_GAP}{_END}|{_GAP}[A-Za-z0-9+/]{{1,15}}+={{1,2}}+)?+|[^-]{{1,16384}}+{_END})"
)
#: Patterns beyond the base ones: key blocks, signed tokens, provider prefixes, long mixed strings.
MORE = {
    "pem": (PEM, F.contains, "-----BEGIN "),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", F.contains, "eyJ"),
    "prefixed": (r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}+)", F.rlike, r"gh[pousr]_|sk-|xox|AIza"),
}
#: A value with this many owners or more is widely copied.
WIDE_OWNERS = 3
SALTS = 60


def _secret(kind: str, value: Column) -> Column:
    """What is hashed: the value of an assignment, the body of a key without what lies between its lines."""
    if kind == "assign":
        return F.regexp_extract(value, ASSIGN, 2)
    if kind == "pem":
        return F.regexp_replace(F.regexp_replace(value, r"-----[A-Z ]+-----", ""), r"\\[nrt]|\+(?=\s)|[^A-Za-z0-9+/=]", "")
    return value


def _describer(kind: str, base: bool):
    def describe(x: Column) -> Column:
        secret = _secret(kind, x["value"])
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), F.xxhash64(secret).alias("hash"), F.length(secret).alias("length"))

    return describe


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """``_id``, ``_owner``, ``_repo`` and ``cands``, the candidates of every text."""
    df = docs.select(F.col(id_col).alias("_id"), owner.alias("_owner"), repo.alias("_repo"), text_or_empty(text_col).alias("_text"))
    tests = {
        "assign": F.rlike("_text", F.lit(r"(?i)password|passwd|secret|token|api_?key")),
        "access": F.contains("_text", F.lit("AKIA")),
        "hex": None,
    }
    more = {kind: (pattern, test("_text", F.lit(needle))) for kind, (pattern, test, needle) in MORE.items()}
    df = add_all_spans(df, "_text", {kind: (BASE[kind], tests[kind]) for kind in KINDS} | more)
    made = [F.transform(kind, _describer(kind, kind in KINDS)) for kind in (*KINDS, *more)]
    cands = F.filter(F.concat(*made), lambda x: (x["kind"] != "assign") | (x["length"] >= 6))
    return df.select("_id", "_owner", "_repo", cands.alias("cands"))


def ownership(each: DataFrame, salts: int = SALTS) -> DataFrame:
    """Distinct owners and repositories of each hash: ``hash``, ``salt``, ``owners``, ``repos``, ``places``, a row for
    each salt that occurs. Counts are combined step by step, so a value that is everywhere is never gathered."""
    a = each.groupBy("hash", "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("m"))
    b = a.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"), F.bit_or("m").alias("m"))
    c = b.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repos"), F.sum("n").alias("places"), F.bit_or("m").alias("m"))
    used = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit("m", s) == 1)
    return c.select("hash", "owners", "repos", "places", F.explode(used).alias("salt"))


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repo: Column | None = None,
    wide_owners: int = WIDE_OWNERS,
) -> DataFrame:
    """One row per input row: ``id_col`` and ``spans``, an array of (kind, start, end, base, owners, repos, live) by
    start, then kind, the base kinds first.

    Places are in code points, ends exclusive. A null text counts as empty, null owners and repositories as one each
    (without ``owner`` and ``repo`` every row counts as its own)."""
    own = F.col(id_col).cast("string") if owner is None else owner
    found = materialize(candidates(docs, id_col, text_col, own, own if repo is None else repo).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    some, none = found.where(F.size("cands") > 0), found.where(F.size("cands") == 0)
    each = some.select("_row", "_id", "_owner", "_repo", F.explode("cands").alias("c")).withColumns({"hash": F.col("c.hash"), "salt": F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")})
    known = each.join(ownership(each), ["hash", "salt"])
    order = [*KINDS, *MORE]
    span = F.struct(
        F.col("c.start").alias("start"),
        F.array_position(F.array(*map(F.lit, order)), F.col("c.kind")).alias("rank"),
        F.col("c.end").alias("end"),
        F.col("c.kind").alias("kind"),
        F.col("c.base").alias("base"),
        F.col("owners"),
        F.col("repos"),
        (F.col("owners") < wide_owners).alias("live"),
    )
    # a document's own candidates are gathered, no more
    spans = known.groupBy("_row").agg(F.first("_id").alias("_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    public = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), x["owners"].alias("owners"), x["repos"].alias("repos"), x["live"].alias("live")))
    kept = spans.select(F.col("_id").alias(id_col), public(F.filter("spans", lambda x: x["base"] | x["live"])).alias("spans"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,owners:bigint,repos:bigint,live:boolean>>")
    return kept.unionByName(none.select(F.col("_id").alias(id_col), empty.alias("spans")))


def report(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return result.select(
        id_col,
        *(count(k) for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )
