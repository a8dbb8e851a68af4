"""File formats: readers, writers, preparation, command line, streams."""

import json
import wave

import pytest
from pyspark.sql import functions as F

from seqlode.plans import cli, prep, sweeps
from seqlode.plans.systems import ALIGNED, PAIRED, UNIGRAM, System, compared
from seqlode.sources import annotations, sinks, tables, workspace
from seqlode.streaming.scoring import Scorer, rank_stream, windowed_counts


def write(path, text):
    path.write_text(text)
    return str(path)


CORPUS = "filename,tokens\n" + "\n".join(f"utt_{i:02d}.wav,{' '.join(str((i * 7 + j * j) % 11) for j in range(12))}" for i in range(12)) + "\n"
QUERIES = "Query_ID,Data\n" + "\n".join(f"Q_{i:02d}.wav,\"{','.join(str((i * 7 + j * j) % 11) for j in range(3, 7))}\"" for i in range(4)) + "\n"


def test_headers():
    assert tables.token_columns(["x", " Tokens ", "FILE"]) == ("FILE", " Tokens ")
    assert tables.token_columns(["a", "b"]) == ("a", "b")
    assert tables.token_columns(["only"]) == ("only", "only")


def test_tokens(spark, tmp_path):
    path = write(tmp_path / "c.csv", 'name,sequence\nb.wav,1 2\na.x.wav,"3,4"\nempty.wav,\nb.flac,5\nbad.wav,x y\nlist.wav,"[1,2,3]"\n')
    rows = [tuple(r) for r in tables.read_corpus(spark, path).orderBy("doc_idx").collect()]
    assert rows == [(0, "b", [5]), (1, "a.x", [3, 4]), (2, "list", [2])]
    rows = [tuple(r)[1:] for r in tables.read_corpus(spark, path, cells="json", keep_empty=True).where("stem IN ('list', 'empty', 'a.x')").orderBy("doc_idx").collect()]
    assert rows == [("a.x", [3, 4]), ("empty", []), ("list", [1, 2, 3])]
    with pytest.raises(ValueError):
        tables.read_corpus(spark, write(tmp_path / "e.csv", "name,data\na,\n"))


def test_relevance(spark, tmp_path):
    path = write(tmp_path / "r.json", json.dumps({"THE_q_1.wav": {"relevant": ["u_1.wav", "u_2.wav"]}, "q_2": ["u_3.wav"], "q_3.wav": {"relevant": []}}, indent=1))
    rows = sorted(map(tuple, tables.read_relevance(spark, path).collect()), key=repr)
    assert rows == [("THE_q_1", "u_1", 0), ("THE_q_1", "u_2", 0), ("q_2", "u_3", 1), ("q_3", None, 2)]
    assert {r.query_stem for r in tables.read_relevance(spark, path, "suffix").collect()} == {"1", "2", "3"}
    assert {r.doc_stem for r in tables.read_relevance(spark, path, "raw").collect()} == {"u_1.wav", "u_2.wav", "u_3.wav", None}
    assert {r.query_stem: r.n_rel for r in tables.named_counts(tables.read_relevance(spark, path)).collect()} == {"THE_q_1": 2, "q_2": 1, "q_3": 0}


def test_written_relevance_is_read(spark, tmp_path):
    """What a preparation writes comes back whole, and joins to a ground truth."""
    from seqlode.operators.groundtruth import ground_truth

    pairs = [("q1", "d1"), ("q1", "d2"), ("q2", "d3"), ("q3", None)]
    path = str(tmp_path / "relevance")
    sinks.write_relevance(spark.createDataFrame(pairs, "query_stem string, doc_stem string").repartition(3), path)
    back = tables.read_relevance(spark, path)
    assert sorted(((r.query_stem, r.doc_stem) for r in back.collect()), key=repr) == sorted(pairs, key=repr)
    assert {r.query_stem: r.n_rel for r in tables.named_counts(back).collect()} == {"q1": 2, "q2": 1, "q3": 0}
    queries = spark.createDataFrame([(0, "q1"), (1, "q2")], "query_idx long, stem string")
    corpus = spark.createDataFrame([(7, "d1"), (8, "d2"), (9, "d3")], "doc_idx long, stem string")
    assert sorted(map(tuple, ground_truth(queries, corpus, back).select("query_idx", "doc_idx").collect())) == [(0, 7), (0, 8), (1, 9)]


def test_line_breaks_and_blanks(spark, tmp_path):
    path = write(tmp_path / "c.csv", 'Filename,Data\n" a.wav ","1,2,\n3"\n"b.wav"," 4 5\n6 "\n')
    assert {r.stem: r.tokens for r in tables.read_corpus(spark, path).collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    path = write(tmp_path / "j.csv", 'id,tokens\na,"[1,\n2]"\nb," 3,\n4"\n')
    assert {r.stem: r.tokens for r in tables.read_corpus(spark, path, cells="json").collect()} == {"a": [1, 2], "b": [3, 4]}


def test_tables_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", [1, 2]), (1, "b", [3])], "doc_idx long, stem string, tokens array<int>")
    sinks.write_tokens(docs, str(tmp_path / "t"))
    assert sorted((r.stem, r.tokens) for r in tables.read_corpus(spark, str(tmp_path / "t")).collect()) == [("a", [1, 2]), ("b", [3])]
    c = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "token int, centroid array<double>")
    sinks.write_centroids(c, str(tmp_path / "k"), model="m", layer=3)
    assert tables.read_centroids(spark, str(tmp_path / "k"), {"layer": 3}).count() == 2
    with pytest.raises(ValueError):
        tables.read_centroids(spark, str(tmp_path / "k"), {"layer": 4})
    a, b = spark.range(1).select(F.lit("x").alias("system"), F.lit(0.5).alias("mrr")), spark.range(1).select(F.lit("y").alias("system"))
    sinks.write_rows([a, b], str(tmp_path / "w"))
    sinks.append_rows(a, str(tmp_path / "w"), ["system", "mrr"])
    assert sorted((r.system, r.mrr) for r in tables.read_csv(spark, str(tmp_path / "w")).collect()) == [("x", "0.5"), ("x", "0.5"), ("y", None)]


def test_latencies_and_configs(spark, tmp_path):
    path = write(tmp_path / "l.csv", "label,tfidf_ms_mean,dtw_ms_mean\na,1,10\nb,3,x\n")
    assert {r.system: r.ms for r in tables.read_latencies(spark, path).collect()} == {"tfidf": 2.0, "dtw": 10.0}
    for name in ("k100", "k50"):
        (tmp_path / "cfg" / name).mkdir(parents=True)
        write(tmp_path / "cfg" / name / "corpus.csv", CORPUS)
    write(tmp_path / "cfg" / "k50" / "queries.csv", QUERIES)
    assert [x[0] for x in tables.find_configs(spark, str(tmp_path / "cfg"))] == ["k50"]
    assert tables.parse_config("a:b:c") == ("a", "b", "c")
    with pytest.raises(ValueError):
        tables.parse_config("a:b")


@pytest.fixture
def language(tmp_path):
    top = tmp_path / "hindi"
    for folder in ("Audio", "dev_queries", "scoring/dev"):
        (top / folder).mkdir(parents=True)
    for f in ("Audio/d1.wav", "Audio/d2.flac", "dev_queries/t1.wav"):
        with wave.open(str(top / f), "wb") as w:
            w.setparams((1, 2, 16000, 0, "NONE", ""))
    at = top / "scoring/dev"
    write(at / "hindi.ecf.xml", '<ecf><excerpt audio_filename="x/d1.wav" channel="1"/><excerpt audio_filename="d2.sph"/><excerpt audio_filename="d3.wav"/></ecf>')
    write(at / "hindi.tlist.xml", '<termlist><term termid="t1"><termtext>a</termtext></term><term termid="t2"/></termlist>')
    write(at / "hindi.rttm", "SPEAKER d1 1 0 1 x\nLEXEME d1.wav 1 0.5 0.2 t1 lex spk\nLEXEME d2 1 0.1 0.2 t1\nLEXEME d1 1 0 1\n  LEXEME   d1 1 0 1 t2\n")
    return top


def test_annotations(spark, language):
    at = f"{language}/scoring/dev/hindi"
    assert [r.stem for r in annotations.read_excerpts(spark, f"{at}.ecf.xml").orderBy("pos").collect()] == ["d1", "d2", "d3"]
    assert [r.stem for r in annotations.read_terms(spark, f"{at}.tlist.xml").orderBy("pos").collect()] == ["t1", "t2"]
    by = {r.term: r.docs for r in annotations.occurrences_by_term(annotations.read_occurrences(spark, f"{at}.rttm")).collect()}
    assert by == {"t1": ["d1", "d2"], "t2": ["d1"]}


def test_preparation(spark, language, tmp_path):
    out = str(tmp_path / "out")
    row = prep.prepare_language(spark, "hindi", str(language), "dev", out).first()
    assert (row.n_queries, row.n_docs, row.n_pairs, row.n_positives, row.has_ground_truth) == (1, 2, 2, 3, True)
    assert sorted(r.value for r in spark.read.text(f"{out}/hindi/dev/all_pairs").collect()) == ['["t1","d1"]', '["t1","d2"]']
    (language / "scoring/dev/hindi.rttm").unlink()
    row = prep.prepare_language(spark, "hindi", str(language), "dev", out).first()
    assert (row.n_positives, row.has_ground_truth) == (0, False)


@pytest.fixture
def files(tmp_path):
    rel = {f"Q_{i:02d}.wav": {"relevant": [f"utt_{i:02d}.wav"]} for i in range(4)}
    return [write(tmp_path / n, t) for n, t in (("c.csv", CORPUS), ("q.csv", QUERIES), ("r.json", json.dumps(rel)))]


def test_command_line(spark, files, tmp_path):
    args = cli.arguments(["--system", "all", "--corpus", files[0], "--queries", files[1], "--relevance", files[2], "--candidates", "6", "--output", str(tmp_path / "o")])
    rows = cli.run(spark, args)
    assert [r["system"] for r in rows] == [UNIGRAM.name, ALIGNED.name, PAIRED.name]
    assert rows[1]["p_at_1"] == 1.0 and rows[1]["map"] == 1.0
    assert tables.read_csv(spark, str(tmp_path / "o")).columns == sinks.RUN_FIELDS


@pytest.fixture
def loaded(spark, files):
    docs, queries = tables.read_corpus(spark, files[0]), tables.read_queries(spark, files[1])
    truth = queries.select("query_idx", F.col("query_idx").alias("doc_idx"))
    return docs, queries, truth


def test_sweeps(spark, loaded):
    docs, queries, truth = loaded
    grid = {g: own[:1] for g, own in sweeps.groups(System("p", tau=0.0, candidates=5)).items() if g in "AE"}
    rows = sweeps.ablation(docs, queries, truth, grid).collect()
    assert [(r["group"], r.system) for r in rows] == [("A", "A_no_pairs"), ("E", "E_cosine")]
    merged = sweeps.merge_ablation(docs, queries, truth, [5, 13], System("p", candidates=5), with_queries=True).collect()
    assert [(r.vocab_size, r.merges) for r in merged] == [(13, 2)]
    with pytest.raises(ValueError):
        sweeps.merge_ablation(docs, queries, truth, [5])
    wide = sweeps.over_configs([("x", docs, queries, truth)], (UNIGRAM, System("aligned", candidates=5)))
    r = sweeps.side_by_side(wide, ("tfidf", "aligned"), "tfidf", "aligned").first()
    assert r.map_gain == pytest.approx((r.aligned_map - r.tfidf_map) / r.tfidf_map)
    assert sweeps.averages(wide).count() == 2
    assert sweeps.best_by(wide, "label", "system").first().system == "aligned"
    assert compared(docs, queries, truth, (UNIGRAM,), mode="core").first().system == "tfidf"


def test_streamed_queries(spark, loaded, tmp_path):
    docs, queries, _ = loaded
    queries.coalesce(1).write.parquet(str(tmp_path / "in"))
    scorer = Scorer(docs, System("p", tau=0.0, candidates=4))
    seen = []
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    q = rank_stream(stream, scorer, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.query_idx, r["rank"], r.doc_idx)
    assert sorted(map(key, seen)) == sorted(map(key, scorer.rank(queries).collect())) and len(seen) == 16
    with pytest.raises(ValueError):
        Scorer(docs, UNIGRAM)


def test_windowed_counts(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = windowed_counts(stream, "ts", "event_type", "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().select(F.col("w.start").cast("timestamp"), "event_type", "count").collect()
    assert sorted(map(tuple, spark.table("counts").select("start", "token", "cnt").collect())) == sorted(map(tuple, want))


def test_audio_to_tokens(spark, tmp_path):
    import numpy as np

    from seqlode.operators.quantize import fit_centroids
    from seqlode.sources import audio

    t = np.arange(16000) / 8000
    for name, pitch in (("low", 200), ("high", 3000)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setparams((2, 2, 8000, 0, "NONE", ""))
            x = (np.sin(2 * np.pi * pitch * t) * 20000).astype("<i2")
            w.writeframes(np.stack([x, x], axis=1).tobytes())
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    frames = audio.read_frames(spark, str(tmp_path))
    rows = frames.collect()
    assert {r.stem: r.error is None for r in rows} == {"low": True, "high": True, "bad": False}
    assert sum(r.stem == "low" for r in rows) == 100
    centroids = fit_centroids(frames.where("error IS NULL"), 2)
    tokens = {r.stem: max(set(r.tokens), key=r.tokens.count) for r in audio.tokenised(frames, centroids).collect()}
    assert set(tokens) == {"low", "high"} and tokens["low"] != tokens["high"]


def test_manifests_of_lines_and_of_one_array(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "lang string, n long").coalesce(1)
    sinks.write_manifest(rows, str(tmp_path / "lines"))
    (tmp_path / "one.json").write_text('[\n {"lang": "a", "n": 1},\n {"lang": "b", "n": 2}, {"lang": "c", "n": 3}\n]')
    for path in ("lines", "one.json"):
        found = tables.read_manifest(spark, str(tmp_path / path), ["a", "c"])
        assert sorted((r.lang, r.n) for r in found.collect()) == [("a", 1), ("c", 3)]


def test_paths_of_the_workspace_are_removed(spark, tmp_path):
    path = workspace.new_path(spark, "rows")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    workspace.remove(path)
    workspace.remove(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
