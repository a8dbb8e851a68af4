"""Language identification with string kernels.

The kernel of two texts counts the character n-grams (of all orders of the spectrum) that are present in both,
divided by the root of the product of their counts of distinct n-grams that the landmarks know. A bounded sample of labelled texts gives the
landmarks; the Nyström approximation spans the kernel by them, and one ridge regression per language is solved in
that space. Only n-grams of the landmarks can add to a kernel value, so a text is scored as a row of presence flags
over the landmarks' n-grams, batch by batch, as one matrix product.

The score says which language is nearest, not whether any is near. For that, a text's share of n-grams with a letter
that two or more landmarks hold is compared with the median share of the labelled sample of its language."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

#: Orders of the blended spectrum.
ORDERS = (2, 3, 4)
#: Bounds of the training sample: texts a language, characters of each of them, landmarks a language.
PER_LABEL = 300
TRAIN_CHARS = 8_000
LANDMARKS = 60
MAX_LABELS = 500
RIDGE = 1e-2
#: Texts and characters of a scoring batch.
BATCH_TEXTS = 64
BATCH_CHARS = 1 << 20
SLOT_BITS = 21
UNDETERMINED = "und"

_MUL = np.uint64(0x9E3779B97F4A7C15)
_END, _BLANK = 1, 2


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else the common blank; the end mark for 0."""
    out = np.full(0x110000, _BLANK, dtype=np.uint32)
    for c in range(1, 0x110000):
        if chr(c).isalpha():
            out[c] = c
    out[0] = _END
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters, blanks and end marks of all texts, and the text each belongs to."""
    lower = [t.lower() for t in texts]
    code = np.frombuffer(("\0".join(lower) + "\0").encode("utf-32-le"), dtype=np.uint32)
    return _letters()[code], np.repeat(np.arange(len(lower), dtype=np.int32), [len(t) + 1 for t in lower])


def _lettered(texts: list[str]) -> np.ndarray:
    """For each text, the n-grams of all orders that hold a letter and no end mark; repeated ones count each time."""
    code, row = _codes(texts)
    ends, letters = (np.r_[0, np.cumsum(x)] for x in (code == _END, code > _BLANK))
    out = np.zeros(len(texts), dtype=np.int64)
    for n in ORDERS:
        if len(code) >= n:
            ok = (ends[n:] == ends[:-n]) & (letters[n:] > letters[:-n])
            out += np.bincount(row[: len(ok)][ok], minlength=len(texts))
    return out


def _grams(texts: list[str], inner: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashes of all n-grams of the texts, and the text each belongs to. N-grams over the end of a
    text hold the end mark; ``inner`` leaves them out, as the landmarks do, so no other text's can match."""
    code, row = _codes(texts)
    h = code.astype(np.uint64) * _MUL
    h ^= h >> np.uint64(29)
    unit = h.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + unit[n - 1 :]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(32))) * _MUL
            at = row[: len(mixed)]
            if inner:
                ends = np.r_[0, np.cumsum(code == _END)]
                ok = ends[n:] == ends[: len(mixed)]
                mixed, at = mixed[ok], at[ok]
            yield mixed, at


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # hashes of the landmarks' n-grams
    weights: np.ndarray  # n-grams by labels
    common: np.ndarray | None = None  # whether two landmarks or more hold the n-gram, and it holds a letter
    usual: np.ndarray | None = None  # median share of common n-grams in the sample of each label

    @functools.cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Column of each slot of the hash space, and the further bits that confirm it."""
        column = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        check = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
        slot, rest = _slots(self.grams)
        column[slot], check[slot] = np.arange(len(self.grams), dtype=np.int32), rest
        return column, check

    def _found(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text and column of the n-grams that the landmarks hold."""
        column, check = self.index
        for h, row in _grams(texts):
            slot, rest = _slots(h)
            col = column[slot]
            ok = (col >= 0) & (check[slot] == rest)
            yield row[ok], col[ok]

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.grams)), dtype=np.float32)
        for row, col in self._found(texts):
            out[row, col] = 1
        return out

    def known(self, texts: list[str]) -> np.ndarray:
        """The share of common n-grams among those of a text that hold a letter; repeated ones count each time, so it
        does not fall with a text's length."""
        out = np.zeros(len(texts))
        for row, col in self._found(texts):
            out += np.bincount(row[self.common[col]], minlength=len(texts))
        return out / np.maximum(_lettered(texts), 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        p = self.presence(texts)
        return (p @ self.weights) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int = PER_LABEL) -> list[tuple[str, str, str]]:
    """At most ``per_label`` (label, order, text) of each label, the first by md5 of the id.

    The labels' counts give each a bound on the hash that about one and a half times as many rows pass, so no task
    and no more than that reaches the driver. Texts are cut to ``TRAIN_CHARS`` here (and only here)."""
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("_label"), F.col(text_col).alias("_text"), order.alias("_order")
    )
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    share = F.lit(0.0)
    for label, n in sorted(counts.items()):
        share = F.when(F.col("_label") == label, min(1.0, 1.5 * per_label / n + 1e-9)).otherwise(share)
    part = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    found = rows.where(part < share).select("_label", "_order", F.substring("_text", 1, TRAIN_CHARS).alias("_text")).collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted((r["_label"], r["_order"], r["_text"]) for r in found):
        if taken[r[0]] < per_label:
            taken[r[0]] += 1
            out.append(r)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", ridge: float = RIDGE) -> Model:
    """Fit on a bounded sample of the rows with text and label. No such row gives a model without labels."""
    rows = sample(docs, id_col, text_col, label_col)
    labels = sorted({r[0] for r in rows})
    if not labels:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    marks, taken = [], dict.fromkeys(labels, 0)
    for label, _, text in rows:
        if taken[label] < LANDMARKS and len(text) >= 20:
            taken[label] += 1
            marks.append(text)
    marks = marks or [r[2] for r in rows]
    sets = [np.unique(np.concatenate([h for h, _ in _grams([t], inner=True)])) for t in marks]
    grams, count = np.unique(np.concatenate(sets), return_counts=True)
    # one n-gram a slot, the most frequent one
    slot, _ = _slots(grams)
    best = np.lexsort((-count, slot))
    best = np.sort(best[np.r_[True, np.diff(slot[best]) > 0]])
    grams, count = grams[best], count[best]
    model = Model(labels, grams, np.zeros((len(grams), len(labels)), np.float32))
    landmark = np.concatenate([model.presence([t]) for t in marks])
    landmark /= np.sqrt(np.maximum(landmark.sum(axis=1, keepdims=True), 1))
    among = landmark @ landmark.T
    left, right = np.zeros_like(among, dtype=np.float64), np.zeros((len(marks), len(labels)))
    for i in range(0, len(rows), BATCH_TEXTS):
        part = rows[i : i + BATCH_TEXTS]
        p = model.presence([r[2] for r in part])
        k = ((p @ landmark.T) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))).astype(np.float64)
        y = np.full((len(part), len(labels)), -1.0)
        y[np.arange(len(part)), [labels.index(r[0]) for r in part]] = 1
        left, right = left + k.T @ k, right + k.T @ y
    alpha = np.linalg.solve(left + ridge * len(rows) * (among + 1e-3 * np.eye(len(marks))), right)
    model.weights = (landmark.T @ alpha).astype(np.float32)
    # what a text alone holds does not make it known, be it a landmark or not
    blank = np.concatenate([np.unique(h) for h, _ in _grams([" " * max(ORDERS)], inner=True)])
    model.common = (count > 1) & ~np.isin(grams, blank)
    share = np.concatenate([model.known([r[2] for r in rows[i : i + BATCH_TEXTS]]) for i in range(0, len(rows), BATCH_TEXTS)])
    model.usual = np.array([np.median(share[[r[0] == x for r in rows]]) for x in labels])
    return model


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= BATCH_CHARS or i + 1 - start >= BATCH_TEXTS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of each text; ``und`` and 0 if it has no letter or the model no label."""
    texts = [t or "" for t in texts]
    labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not model.labels:
        return labels, scores
    for a, b in _batches(texts):
        f = model.scores(texts[a:b])
        top = f.argmax(axis=1)
        for i in range(b - a):
            if any(map(str.isalpha, texts[a + i])):
                labels[a + i] = model.labels[top[i]]
                scores[a + i] = float(min(1.0, max(0.0, (1 + f[i, top[i]]) / 2)))
    return labels, scores


def familiarity(model: Model, texts: list[str | None], labels: list[str]) -> list[float]:
    """A text's share of common n-grams, divided by what is usual for its label; 0 for ``und``, 1 where nothing is
    usual."""
    texts, out = [t or "" for t in texts], []
    usual = dict(zip(model.labels, model.usual if model.usual is not None else (), strict=False))
    for a, b in _batches(texts):
        for share, label in zip(model.known(texts[a:b]) if usual else [0.0] * (b - a), labels[a:b], strict=True):
            out.append(0.0 if label not in usual else float(share / usual[label]) if usual[label] else 1.0)
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score", familiar_out: str | None = None) -> DataFrame:
    """Add ``label_out`` and ``score_out`` (0 to 1), from the whole text alone. Other columns pass through; columns of
    these names are replaced. A null text, or one without a letter, gives ``und`` and 0. ``familiar_out`` adds how
    familiar a text is (see ``familiarity``): about 1 in a language of the model, near 0 in another script."""
    text_batches(docs.sparkSession)
    extra = [] if familiar_out is None else [familiar_out]
    rest = [f for f in docs.schema.fields if f.name not in (label_out, score_out, *extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            labels, scores = predict_texts(model, texts)
            more = [pa.array(familiarity(model, texts, labels), pa.float64()) for _ in extra]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), *more], names=[*batch.schema.names, label_out, score_out, *extra]
            )

    kept = docs.select(*(f"`{f.name}`" for f in rest))
    return kept.mapInArrow(run, T.StructType([*rest, T.StructField(label_out, T.StringType()), *(T.StructField(x, T.DoubleType()) for x in (score_out, *extra))]))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from the training: crc32 of the id as text, modulo ``folds``, is ``fold``. Null ids count
    as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Train on what is not held out and predict every row."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, label_col)
    out = identify(docs.select(F.col(id_col), F.col(text_col)), model, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
