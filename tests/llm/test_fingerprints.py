import hashlib
import re

import pytest
from pyspark.sql import functions as F

from seqlode.llm import fingerprints as P


def shingles(t):
    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("n", [1, 2, 3, 200])
def test_against_brute_force(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") < n)
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    out = {r.doc_id: r for r in P.report(P.fingerprint_edits(docs)).collect()}
    assert len(out) == len(rows)
    far = 0
    for i, r in enumerate(rows):
        after = rows[(i + 1) % len(rows)].text
        h = len(r.text) // 2
        edited = r.text[: len(r.text) - h] + after[:h]
        o = out[r.doc_id]
        assert o.n_chars == len(r.text)
        assert o.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(r.text), shingles(edited), shingles(after)
        far += abs(o.near_edited - jaccard(a, b)) > 0.13
        assert abs(o.near_next - jaccard(a, c)) < 0.2
        if len(a | b) < P.K:
            assert o.near_edited == pytest.approx(jaccard(a, b))
        if r.text == edited:
            assert o.fingerprint == o.edited_fingerprint
    assert far <= 0.02 * len(rows) + 1


def sketch(spark, text):
    return spark.range(1).select(F.lit(text).alias("t")), text


def values(spark, *texts, **cols):
    df = spark.range(1)
    for i, t in enumerate(texts):
        df = P.add_sketch(df, F.lit(t), f"s{i}")
    return df.select(*(c(df).alias(k) for k, c in cols.items())).first()


def test_merge_and_estimates(spark):
    a, b = " ".join(f"a{i}" for i in range(5000)), " ".join(f"a{i}" for i in range(2500)) + " " + " ".join(f"b{i}" for i in range(2500))
    r = values(
        spark, a, b, a + " . " + b,
        j=lambda d: P.resemblance(d.s0, d.s1), n=lambda d: P.distinct_count(d.s0), c=lambda d: P.containment(d.s0, d.s1),
        lost=lambda d: F.size(F.array_except(P.merge(d.s0, d.s1), d.s2)), back=lambda d: P.from_text(P.as_text(d.s0)) == d.s0,
    )
    assert r.j == pytest.approx(1 / 3, abs=0.15)
    assert r.n == pytest.approx(4996, rel=0.3)
    assert r.c == pytest.approx(0.5, abs=0.2)
    assert r.lost <= 4 and r.back


def test_few_and_no_words(spark):
    r = values(spark, "", "one two", "ONE, two!", "...", e=lambda d: F.size(d.s0), two=lambda d: F.size(d.s1), same=lambda d: d.s1 == d.s2, dots=lambda d: F.size(d.s3),
               j=lambda d: P.resemblance(d.s0, d.s3), k=lambda d: P.resemblance(d.s0, d.s1), t=lambda d: P.as_text(d.s0), n=lambda d: P.distinct_count(d.s0))
    assert (r.e, r.two, r.same, r.dots, r.j, r.k, r.t, r.n) == (0, 1, True, 0, 1.0, 0.0, "", 0.0)


def test_messy(messy):
    out = P.report(P.fingerprint_edits(messy)).collect()
    assert len(out) == messy.count()
    by_text = {}
    ids = {r.doc_id: r for r in out if r.doc_id in (5, 9)}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    for r in P.fingerprint_edits(messy).collect():
        assert by_text.setdefault(r.text, r.sketch) == r.sketch
    assert ids[5].n_chars > 200_000


def test_empty(empty):
    assert P.report(P.fingerprint_edits(empty)).collect() == []
