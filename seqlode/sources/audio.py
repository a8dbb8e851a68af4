"""Audio files to frames: decoding of WAV, and the place where a feature extractor is plugged in.

Decoding and extraction run in Python workers, a file at a time. A file that cannot be read gives no frames and says
why, so one broken file does not end a job."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import path_stem
from ..functions.tokens import ordered_tokens
from ..operators.quantize import assign

RATE = 16_000
#: Samples between two frames (20 ms).
HOP = 320


def decode_wav(data: bytes, rate: int = RATE) -> np.ndarray:
    """Samples between -1 and 1 of PCM data of 8, 16 or 32 bits: channels averaged, brought to ``rate`` by linear
    interpolation."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    else:
        raise ValueError(f"samples of {8 * width} bits")
    x = x.reshape(-1, channels).mean(axis=1)
    if own != rate and len(x):
        x = np.interp(np.arange(round(len(x) * rate / own)) * own / rate, np.arange(len(x)), x).astype(np.float32)
    return x


def band_energies(samples: np.ndarray, bands: int = 24) -> np.ndarray:
    """A simple extractor: log energies of ``bands`` equal parts of the spectrum of each hop, frames by bands."""
    n = len(samples) // HOP
    power = np.abs(np.fft.rfft(samples[: n * HOP].reshape(n, HOP), axis=1)) ** 2
    edges = np.linspace(0, power.shape[1], bands + 1).astype(int)
    return np.log(np.stack([power[:, a:b].sum(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1) + 1e-10)


def read_frames(spark: SparkSession, folder: str, extract: Callable[[np.ndarray], np.ndarray] = band_energies, decode: Callable[[bytes], np.ndarray] = decode_wav) -> DataFrame:
    """``stem``, ``pos``, ``vec`` of every frame of a folder's audio files, and a row with ``error`` alone for a file
    that fails. ``extract`` may be any model that turns samples into frames."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,flac}").load(folder)
    files = files.select(path_stem("path").alias("stem"), F.col("content").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    frames, error = np.asarray(extract(decode(data.as_py())), dtype=np.float64), None
                except Exception as e:  # noqa: BLE001 - whatever decoder or model raises belongs to this file
                    frames, error = np.zeros((0, 1)), f"{type(e).__name__}: {e}"
                n = len(frames)
                if error is None:
                    columns = [[stem] * n, list(range(n)), list(frames), [None] * n]
                else:
                    columns = [[stem], [None], [None], [error]]
                types = (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["stem", "pos", "vec", "error"])

    return files.mapInArrow(run, "stem string, pos long, vec array<double>, error string")


def tokenised(frames: DataFrame, centroids: DataFrame) -> DataFrame:
    """Token sequences of the files that could be read: ``stem``, ``tokens``."""
    tokens = assign(frames.where("error IS NULL"), centroids)
    return ordered_tokens(tokens, "stem", "token", "pos").withColumnRenamed("doc_idx", "stem")
