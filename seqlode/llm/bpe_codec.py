"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

#: Texts above this many characters are encoded piecewise.
LONG_TEXT = 1 << 16
#: Output batches hold about this many characters of input.
BATCH_CHARS = 1 << 20

#: Runs of white space from this length on are encoded apart from what stands around them.
LONG_RUN = 1 << 12
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_RUN = re.compile(f"{_WHITE}{{{LONG_RUN},}}")
#: How a pattern must treat white space for that: a run but for its last character is one piece, at the end of the text
#: the whole run is. The library's matcher gives up on runs of about a million characters under this rule.
_WHITE_RULE = r"|\s+(?!\S)|\s+"

#: A word character followed by a blank: no match of the pre-split pattern reaches across that point, and what
#: follows it is matched as it would be after the whole prefix, since only white space looks ahead.
_SAFE = re.compile(r"\w(?=[ \n])")


def safe_chunks(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Cut ``text`` at safe boundaries, each chunk at least ``size`` characters long but the last.

    A stretch without a safe boundary stays whole; the library matches it in one pass, however long, if it holds no
    long run of white space (see ``encode_text``)."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size - 1)
        if not m:
            break
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The encoding of a rank file (lines of base64 token and rank), one per process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _runs_apart(pattern: str) -> bool:
    """Whether a pattern has the rule for white space, and no other part that takes more than one blank."""
    return pattern.endswith(_WHITE_RULE) and r"\s" not in pattern.removesuffix(_WHITE_RULE).replace(r"[^\s", "[^")


def encode_text(enc, text: str) -> list[int]:
    """The ids of a text as the library gives them for the whole text. Long texts are encoded piece by piece: long runs
    of white space as the one piece that they are, what stands between them in safe chunks."""
    if len(text) <= LONG_TEXT:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in _LONG_RUN.finditer(text) if _runs_apart(enc._pat_str) else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        for chunk in safe_chunks(text[at : m.start()]):
            ids += enc.encode_ordinary(chunk)
        ids += enc._encode_single_piece(text[m.start() : end])
        at = end
    for chunk in safe_chunks(text[at:]):
        ids += enc.encode_ordinary(chunk)
    return ids


def _spans(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to about ``most``."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Add ``ids_col`` (array<int>): the tokens of each whole text, without special tokens.

    A null text counts as empty and gives an empty array. Other columns pass through, an existing ``ids_col`` is
    replaced; rows are neither added nor dropped."""
    text_batches(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != ids_col]
    out = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in _spans([len(t) + 64 for t in texts], BATCH_CHARS):
                ids = pa.array([encode_text(enc, t) for t in texts[a:b]], type=out)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_col])

    kept = df.select(*(f"`{f.name}`" for f in rest))
    return kept.mapInArrow(run, T.StructType([*rest, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col`` (binary): the raw bytes of each id array. Token borders may fall inside a character, so the
    result is bytes, not text. Null and empty arrays give empty bytes."""
    text_batches(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != bytes_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            raw = pa.array([enc.decode_bytes(i or []) for i in ids], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, bytes_col])

    kept = df.select(*(f"`{f.name}`" for f in rest))
    return kept.mapInArrow(run, T.StructType([*rest, T.StructField(bytes_col, T.BinaryType())]))


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``token_ids`` and ``decoded`` for each text in one pass over the workers (the two steps above in turn cost a
    second transfer of every id)."""
    text_batches(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name not in ("token_ids", "decoded")]
    out = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for a, b in _spans([len(t) + 64 for t in texts], BATCH_CHARS):
                ids = [encode_text(enc, t) for t in texts[a:b]]
                raw = pa.array([enc.decode_bytes(i) for i in ids], type=pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, type=out), raw], names=[*part.schema.names, "token_ids", "decoded"])

    kept = df.select(*(f"`{f.name}`" for f in rest))
    ids_type = T.ArrayType(T.IntegerType())
    return kept.mapInArrow(run, T.StructType([*rest, T.StructField("token_ids", ids_type), T.StructField("decoded", T.BinaryType())]))


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the registered query, from the operator's ids and bytes."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return df.select(
        id_col,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
