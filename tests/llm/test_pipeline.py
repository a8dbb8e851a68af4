import hashlib

import corpus_pipeline as P
from seqlode.llm import registry
from seqlode.llm.bpe_codec import encoding

from .test_ngram_join import brute


def stages(spark, docs):
    out = [docs]
    for name, stage in P.STAGES:
        done = stage(spark, out[-1], None)
        out.append(spark.createDataFrame(done.collect(), done.schema))
    return out


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    start, named, exact, near, mixed, encoded = stages(spark, docs)
    assert all(d.columns == docs.columns for d in (named, exact, near, mixed))
    rows = {r.doc_id: r for r in start.collect()}
    assert {r.doc_id for r in named.collect()} == {d for d, r in rows.items() if any(map(str.isalpha, r.text or ""))}
    last = {}
    for r in named.collect():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(last.values())
    ordered = sorted((r.doc_id, r.text) for r in exact.collect())
    _, root = brute(ordered)
    assert sorted(r.doc_id for r in near.collect()) == sorted({ordered[i][0] for i in root})
    assert {r for r in mixed.collect()} <= {r for r in near.collect()}
    enc = encoding(*registry.tokenizer_files())
    want = []
    for r in mixed.collect():
        ids = enc.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in encoded.collect()) == sorted(want)


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_messy(spark, messy):
    out = stages(spark, messy)
    assert out[1].where("text IS NULL").count() == 0
    assert out[2].count() <= out[1].count()
    assert all(d.columns == messy.columns for d in out[1:5])


def test_empty(spark, empty):
    assert [d.count() for d in stages(spark, empty)] == [0] * 6


def test_registered():
    import __spark_entry__ as E

    assert set(registry.QUERIES) | {"pipeline"} <= set(E.queries())
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_texts_in_no_known_language_go(spark):
    """Other scripts and random letters go, labelled or not; every text of the table stays."""
    import random

    rng = random.Random(16)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gibberish = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (20, 60, 300)]
    foreign = ["Привет, это простой русский текст о погоде и жизни.", "これは日本語の文章です。今日は天気がいいですね。", "Ελληνικό κείμενο με πολλές λέξεις για δοκιμή."]
    texts = [*gibberish, *foreign]
    alien = spark.createDataFrame([(10**9 + i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    stay = {r.doc_id for r in P.identified(spark, docs.unionByName(alien, allowMissingColumns=True), None).select("doc_id").collect()}
    assert stay == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}


def test_same_rows_however_partitioned(spark, make):
    """Rows of one id whose texts differ in case, language or source: the stages keep the same ones at any number of
    partitions."""
    text = " ".join(f"word{i % 50} and {i}" for i in range(80))
    rows = [(i % 3, t, lang, source, n, "own", "own", "own", "own", "own") for i in range(6) for t in (text, text.upper()) for lang, source, n in (("en", "a", 1), ("de", "b", 2), (None, None, None))]
    for stage in (P.deduplicated, P.dissimilar):
        kept = {tuple(stage(spark, make(rows).repartition(n), None).collect()) for n in (1, 2, 3, 5, 8)}
        assert len(kept) == 1 and len(kept.pop()) == 1


def test_long_white_space(spark, make):
    docs = make([(1, "a" + " " * 1_200_000 + "b", "en", "a", 3, "", "", "", "", "")])
    assert P.encoded(spark, docs, None).count() == 1
