import zlib

import numpy as np
from pyspark.sql import functions as F

from seqlode.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_presence_kernel_is_the_set_kernel(make):
    from .conftest import rows_of

    texts = ["the cat sat on the mat", "der hund lief über die wiese", "the dog ran over the lawn"] * 3
    model = L.train(make(rows_of(texts)))

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        return {t[i : i + n] for n in L.ORDERS for i in range(len(t) - n + 1)}

    known = set().union(*map(grams, texts))
    p = model.presence(["the mat über 12", "zzz"])
    assert p[0].sum() == len(grams("the mat über 12") & known)
    assert (p @ p.T)[0, 1] == len(grams("the mat über 12") & grams("zzz") & known)


def test_batches_do_not_mix_texts():
    model = L.Model(["x"], np.zeros(0, np.uint64), np.zeros((0, 1), np.float32))
    model.grams = np.unique(np.concatenate([h for h, _ in L._grams(["abc", "b\0c"], inner=True)]))
    model.weights = np.zeros((len(model.grams), 1), np.float32)
    together = model.presence(["ab", "bc", ""])
    apart = np.concatenate([model.presence([t]) for t in ["ab", "bc", ""]])
    assert (together == apart).all()


def test_messy(messy):
    model = L.train(messy)
    out = L.identify(messy, model).collect()
    assert len(out) == messy.count()
    for r in out:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
        assert r.lang_pred == "und" or r.lang_pred in model.labels
    assert L.report(messy).count() == messy.count()


def test_no_labels(messy, empty):
    assert {r.lang_pred for r in L.identify(messy, L.train(empty)).collect()} == {"und"}
    assert L.report(empty).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert len(L.sample(docs, "doc_id", "text", "lang", per_label=50)) == 50
