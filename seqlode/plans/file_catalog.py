"""Registered queries of the sources and sinks: each writes files from a table's rows, reads them, and is held against
SQL over the table itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import parse_json_tokens, parse_tokens, token_string
from ..operators import quantize
from ..sources import annotations, sinks, tables, workspace
from . import corpora as C
from . import prep, sweeps
from . import sql as S
from .register import query

# token tables


def _users(spark, d) -> DataFrame:
    return C.coded_users(spark, d).select(F.concat(F.lit("u_"), F.col("doc_idx").cast("string")).alias("stem"), "tokens")


def _joined(df: DataFrame) -> DataFrame:
    return df.select("stem", token_string("tokens").alias("tokens"))


def _csv(df: DataFrame, name: str) -> str:
    path = workspace.new_path(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


_CODED_ROWS = f"WITH {S.CODED} SELECT 'u_' || doc_idx AS stem, array_to_string(tokens, ',') AS tokens FROM docs"


@query(_CODED_ROWS)
def token_table_round_trip(spark, d):
    path = workspace.new_path(spark, "tokens")
    sinks.write_tokens(_users(spark, d), path)
    return _joined(tables.read_corpus(spark, path))


@query(_CODED_ROWS)
def token_table_headers(spark, d):
    """Known headers in any case and place, names with folders, suffixes and blanks around them."""
    name = F.concat(F.lit("  a.b/"), "stem", F.lit(".wav ")).alias("Utt_ID")
    rows = _users(spark, d).select(F.lit(7).alias("other"), token_string("tokens", " ").alias("SEQUENCE"), name)
    return _joined(tables.read_queries(spark, _csv(rows, "headers")))


@query(_CODED_ROWS)
def token_table_json_cells(spark, d):
    """Cells with a JSON array, or with commas."""
    t = token_string("tokens", ", ")
    cell = F.when(F.crc32("stem") % 2 == 0, F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)
    return _joined(tables.read_tokens(spark, _csv(_users(spark, d).select(F.col("stem").alias("file"), cell.alias("tokens")), "json"), cells="json"))


@query(f"WITH {S.CODED} SELECT 'u_' || doc_idx AS stem, CASE WHEN doc_idx % 3 = 0 THEN '' ELSE array_to_string(tokens, ',') END AS tokens FROM docs")
def token_table_empty_rows(spark, d):
    """A third of the cells is empty; those rows stay."""
    cell = F.when(F.substring_index("stem", "_", -1).cast("long") % 3 == 0, "").otherwise(token_string("tokens"))
    return _joined(tables.read_tokens(spark, _csv(_users(spark, d).select(F.col("stem").alias("id"), cell.alias("data")), "empty"), cells="json", keep_empty=True))


@query("SELECT 'o_' || l_orderkey AS stem, CAST(arg_max(l_suppkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey) AS VARCHAR) AS tokens FROM lineitem GROUP BY l_orderkey")
def token_table_repeated_names(spark, d):
    """Of rows with one name the last one's tokens count."""
    rows = C.table(spark, d, "lineitem").select(F.concat(F.lit("o_"), F.col("l_orderkey").cast("string")).alias("name"), F.col("l_suppkey").cast("string").alias("data"), "l_linenumber", "l_suppkey")
    rows = rows.repartition("name").sortWithinPartitions("name", "l_linenumber", "l_suppkey").drop("l_linenumber", "l_suppkey")
    return _joined(tables.read_tokens(spark, _csv(rows, "repeated")))


@query("SELECT 'd_' || doc_id AS stem, string_agg(CAST(doc_id + i AS VARCHAR), ',' ORDER BY i) AS tokens FROM documents, generate_series(0, 40000) g(i) WHERE doc_id % 40 = 0 OR i < 3 GROUP BY doc_id")
def token_table_long_cells(spark, d):
    """Every 40th cell is longer than what CSV readers take as a limit, 131,072 characters."""
    n = F.when(F.col("doc_id") % 40 == 0, 40_000).otherwise(2)
    ids = C.table(spark, d, "documents").select("doc_id").repartition("doc_id")
    rows = ids.select(F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("id"), token_string(F.transform(F.sequence(F.lit(0), n), lambda i: F.col("doc_id") + i)).alias("data"))
    return _joined(tables.read_tokens(spark, _csv(rows, "long")))


_CELL = """cells AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id || ',' || n || ', x ,-' || doc_id || ',1.5' WHEN 1 THEN '  ' || doc_id || '   ' || n || ' -7 y' WHEN 2 THEN '[1, ' || doc_id || ', ' || n || ']' WHEN 3 THEN '99999999999,--5,' || n ELSE '' END AS cell FROM (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents)),
parts AS (SELECT doc_id, list_transform(CASE WHEN contains(cell, ',') THEN string_split(cell, ',') ELSE string_split_regex(trim(cell), '\\s+') END, lambda x: trim(x)) AS p FROM cells),
found AS (SELECT doc_id, list_filter(list_transform(list_filter(p, lambda x: regexp_full_match(x, '-*[0-9]+')), lambda x: TRY_CAST(x AS INT)), lambda x: x IS NOT NULL) AS t FROM parts)"""


def _cells(spark, d) -> DataFrame:
    k, n = F.col("doc_id").cast("string"), F.coalesce(F.length("text"), F.lit(0)).cast("string")
    kind = F.col("doc_id") % 5
    cell = (
        F.when(kind == 0, F.concat(k, F.lit(","), n, F.lit(", x ,-"), k, F.lit(",1.5")))
        .when(kind == 1, F.concat(F.lit("  "), k, F.lit("   "), n, F.lit(" -7 y")))
        .when(kind == 2, F.concat(F.lit("[1, "), k, F.lit(", "), n, F.lit("]")))
        .when(kind == 3, F.concat(F.lit("99999999999,--5,"), n))
        .otherwise("")
    )
    return C.table(spark, d, "documents").select("doc_id", cell.alias("cell"))


@query(f"WITH {_CELL} SELECT doc_id, array_to_string(t, ',') AS tokens FROM found")
def token_cells(spark, d):
    return _cells(spark, d).select("doc_id", token_string(parse_tokens("cell")).alias("tokens"))


@query("SELECT doc_id, '1,' || doc_id || ',-3' AS tokens FROM documents")
def token_cells_json(spark, d):
    k = F.col("doc_id").cast("string")
    cell = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" [1, "), k, F.lit(", -3] "))).otherwise(F.concat(F.lit("1, "), k, F.lit(",,-3")))
    return C.table(spark, d, "documents").select("doc_id", token_string(parse_json_tokens(cell)).alias("tokens"))


# relevance


def _regions(spark, d) -> DataFrame:
    """Nations of each region, as a relevance: a table of fixed size."""
    rows = C.table(spark, d, "nation").join(C.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    query_path = F.concat(F.lit("q/x_"), F.col("r_name"), F.lit(".wav"))
    return rows.groupBy(query_path.alias("q")).agg(F.array_sort(F.collect_list(F.concat(F.lit("d/y_"), "n_name", F.lit(".wav")))).alias("docs"))


def _one_object(rows: DataFrame, value, name: str) -> str:
    path = workspace.new_path(rows.sparkSession, name)
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("q", value)))).alias("value")).coalesce(1).write.text(path)
    return path


def _region_rows(q: str, n: str) -> str:
    return f"SELECT {q} AS query_stem, {n} AS doc_stem FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_region_rows("'x_' || r_name", "'y_' || n_name"))
def relevance_objects(spark, d):
    path = _one_object(_regions(spark, d), F.struct(F.col("docs").alias("relevant")), "objects")
    return tables.read_relevance(spark, path).select("query_stem", "doc_stem")


@query(_region_rows("list_extract(string_split(r_name, '_'), -1)", "list_extract(string_split(n_name, '_'), -1)"))
def relevance_suffixes(spark, d):
    path = _one_object(_regions(spark, d), F.col("docs"), "suffixes")
    return tables.read_relevance(spark, path, ids="suffix").select("query_stem", "doc_stem")


@query(_region_rows("'q/x_' || r_name || '.wav'", "'d/y_' || n_name || '.wav'"))
def relevance_lists(spark, d):
    path = _one_object(_regions(spark, d), F.col("docs"), "lists")
    return tables.read_relevance(spark, path, ids="raw").select("query_stem", "doc_stem")


def _truth_names(spark, d) -> DataFrame:
    """Items and the documents that contain them; an item without any has a null document."""
    items = C.table(spark, d, "benchmark").select(F.col("item_id").alias("query_idx"))
    rows = items.join(C.contained(spark, d), "query_idx", "left")
    return rows.select(F.concat(F.lit("q_"), F.col("query_idx").cast("string")).alias("query_stem"), F.concat(F.lit("d_"), F.col("doc_idx").cast("string")).alias("doc_stem"))


@query(f"WITH {S.TRUTH} SELECT 'q_' || item_id AS query_stem, 'd_' || doc_idx AS doc_stem FROM benchmark LEFT JOIN truth ON query_idx = item_id")
def relevance_round_trip(spark, d):
    path = workspace.new_path(spark, "relevance")
    sinks.write_relevance(_truth_names(spark, d), path)
    return tables.read_relevance(spark, path).select("query_stem", "doc_stem")


@query(f"WITH {S.TRUTH} SELECT 'q_' || item_id AS query_stem, count(DISTINCT doc_idx) AS n_rel FROM benchmark LEFT JOIN truth ON query_idx = item_id GROUP BY item_id")
def relevance_counts(spark, d):
    return tables.named_counts(_truth_names(spark, d))


# annotations


def _text(df: DataFrame, name: str) -> str:
    path = workspace.new_path(df.sparkSession, name)
    df.write.text(path)
    return path


def _xml(rows: DataFrame, name: str, top: str, element, order: str) -> str:
    """One XML file from a table of fixed size."""
    all_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), element.alias("e")))), lambda x: x["e"]), "")
    return _text(rows.agg(F.concat(F.lit(f"<?xml version='1.0'?><{top}>"), all_of, F.lit(f"</{top}>")).alias("value")).coalesce(1), name)


def _nations(spark, d) -> str:
    element = F.concat(F.lit('<excerpt audio_filename="Audio/'), "n_name", F.lit('.wav" channel="1"/>'))
    return _xml(C.table(spark, d, "nation"), "ecf", "ecf", element, "n_nationkey")


def _terms(spark, d) -> str:
    element = F.concat(F.lit('<term termid="'), "r_name", F.lit('"><termtext>t</termtext></term>'))
    return _xml(C.table(spark, d, "region"), "tlist", "termlist", element, "r_regionkey")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS pos, n_name AS stem FROM nation")
def excerpt_list(spark, d):
    return annotations.read_excerpts(spark, _nations(spark, d))


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INT) AS pos, r_name AS stem FROM region")
def term_list(spark, d):
    return annotations.read_terms(spark, _terms(spark, d))


def _rttm(spark, d) -> str:
    """A row for each line item; those of the first line number are of another type, which is passed over."""
    kind = F.when(F.col("l_linenumber") == 1, "SPEAKER").otherwise("LEXEME")
    value = F.concat(F.lit(" "), kind, F.lit(" Audio/o_"), F.col("l_orderkey").cast("string"), F.lit(".wav  1 0.5 0.25\tp_"), F.col("l_partkey").cast("string"), F.lit(" lex <NA>"))
    return _text(C.table(spark, d, "lineitem").select(value.alias("value")), "rttm")


@query("SELECT 'p_' || l_partkey AS term, 'o_' || l_orderkey AS doc, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY l_partkey, l_orderkey")
def occurrence_rows(spark, d):
    return annotations.read_occurrences(spark, _rttm(spark, d)).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'p_' || l_partkey AS term, string_agg('o_' || l_orderkey, ',' ORDER BY 'o_' || l_orderkey) AS docs, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY l_partkey")
def occurrence_positives(spark, d):
    rows = annotations.occurrences_by_term(annotations.read_occurrences(spark, _rttm(spark, d)))
    return rows.select("term", F.array_join("docs", ",").alias("docs"), "n")


# preparation

_PREP = "c AS (SELECT n_name AS doc FROM nation WHERE n_nationkey % 5 <> 0), q AS (SELECT r_name AS query FROM region WHERE r_regionkey <> 0)"


def _prepared(spark, d) -> dict[str, DataFrame]:
    """Nations are documents, regions queries; some have no file. A nation holds its region's name."""
    nations, regions = C.table(spark, d, "nation"), C.table(spark, d, "region")
    file = lambda name: [F.col(name).alias("stem"), F.concat(F.lit("Audio/"), name, F.lit(".wav")).alias("path")]
    holds = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("term"), F.col("n_name").alias("doc"))
    return prep.prepared(
        annotations.read_excerpts(spark, _nations(spark, d)),
        annotations.read_terms(spark, _terms(spark, d)),
        nations.where("n_nationkey % 5 != 0").select(*file("n_name")),
        regions.where("r_regionkey != 0").select(*file("r_name")),
        holds,
    )


@query(f"WITH {_PREP} SELECT query AS query_stem, doc AS doc_stem FROM q CROSS JOIN c")
def prepared_pairs(spark, d):
    path = workspace.new_path(spark, "pairs")
    sinks.write_pairs(_prepared(spark, d)["pairs"], path)
    pair = F.from_json("value", "array<string>")
    return spark.read.text(path).select(pair[0].alias("query_stem"), pair[1].alias("doc_stem"))


@query(f"WITH {_PREP} SELECT doc AS stem, 'Audio/' || doc || '.wav' AS path FROM c UNION ALL SELECT query, 'Audio/' || query || '.wav' FROM q")
def prepared_file_lists(spark, d):
    parts, paths = _prepared(spark, d), []
    for name in ("corpus", "queries"):
        paths.append(workspace.new_path(spark, name))
        sinks.write_file_list(parts[name], paths[-1])
    return reduce(DataFrame.unionByName, [tables.read_csv(spark, p) for p in paths]).select("stem", "path")


_COUNTS = "(SELECT count(*) FROM q) AS n_queries, (SELECT count(*) FROM c) AS n_docs, (SELECT count(*) FROM q) * (SELECT count(*) FROM c) AS n_pairs, (SELECT count(*) FROM nation) AS n_positives"


@query(f"WITH {_PREP} SELECT lang, 'dev' AS split, {_COUNTS}, true AS has_ground_truth, 'out/' || lang || '/relevance' AS relevance_json FROM (VALUES ('a'), ('c')) l(lang)")
def prepared_manifest(spark, d):
    """A manifest of three languages, of which two are read."""
    parts = _prepared(spark, d)
    path = workspace.new_path(spark, "manifest")
    sinks.write_manifest(reduce(DataFrame.unionByName, [prep.manifest_row(parts, x, "dev", f"out/{x}") for x in "abc"]), path)
    return tables.read_manifest(spark, path, ["a", "c"]).select("lang", "split", "n_queries", "n_docs", "n_pairs", "n_positives", "has_ground_truth", "relevance_json")


# other files


@query("""WITH m AS (SELECT label AS token, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos)
SELECT CAST(token AS BIGINT) AS token, CAST(pos - 1 AS BIGINT) AS pos, round(m, 6) AS x FROM m""")
def centroid_files(spark, d):
    path = workspace.new_path(spark, "centroids")
    sinks.write_centroids(quantize.centroid_means(C.frames(spark, d), "label"), path, layer=3, model="m")
    found = tables.read_centroids(spark, path, {"layer": 3, "model": "m"})
    return found.select(F.col("token").cast("long").alias("token"), F.posexplode("centroid").alias("pos", "x")).select("token", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""WITH {S.CODED}, b AS (SELECT l_orderkey AS doc_idx, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT 'baskets' AS label, (SELECT count(*) FROM b) AS n_docs, (SELECT sum(n) FROM b)::BIGINT AS n_tokens, (SELECT count(*) FROM docs) AS n_queries
UNION ALL SELECT 'users', (SELECT count(*) FROM docs), (SELECT sum(len(tokens)) FROM docs)::BIGINT, (SELECT count(*) FROM b)""")
def config_folders(spark, d):
    """Folders that hold both token tables are found; one without queries is not."""
    top = workspace.new_path(spark, "configs")
    own = {"users": _users(spark, d), "baskets": C.baskets(spark, d).select(F.col("doc_idx").cast("string").alias("stem"), "tokens")}
    for label, other in (("users", "baskets"), ("baskets", "users")):
        sinks.write_tokens(own[label], f"{top}/{label}/corpus.csv")
        sinks.write_tokens(own[other], f"{top}/{label}/queries.csv")
    sinks.write_tokens(own["users"], f"{top}/half/corpus.csv")
    rows = []
    for spec in tables.find_configs(spark, top):
        docs, queries = tables.read_corpus(spark, spec[1]), tables.read_queries(spark, spec[2])
        about = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("tokens")).alias("n_tokens"))
        rows.append(about.crossJoin(F.broadcast(queries.agg(F.count(F.lit(1)).alias("n_queries")))).select(F.lit(spec[0]).alias("label"), "*"))
    return reduce(DataFrame.unionByName, rows)


@query("SELECT 'tfidf' AS system, round(avg(CAST(l_quantity AS DOUBLE)), 4) AS ms FROM lineitem UNION ALL SELECT 'aligned', round(avg(CAST(l_linenumber AS DOUBLE)), 4) FROM lineitem")
def latency_means(spark, d):
    rows = C.table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("tfidf_ms_mean"), F.col("l_linenumber").alias("aligned_ms_mean"))
    return tables.read_latencies(spark, _csv(rows, "latencies")).select("system", F.round("ms", 4).alias("ms"))


# reports, over qualities of documents by source and language as if they were a system's metrics

_RUNS = "runs AS (SELECT source AS system, lang AS label, avg(CAST(quality AS DOUBLE)) AS map, avg(CAST(toxic AS DOUBLE)) AS mrr FROM labels JOIN documents USING (doc_id) GROUP BY source, lang)"


def _runs(spark, d) -> DataFrame:
    rows = C.table(spark, d, "labels").join(C.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.groupBy(F.col("source").alias("system"), F.col("lang").alias("label")).agg(F.avg("quality").alias("map"), F.avg("toxic").alias("mrr"))


@query(f"WITH {_RUNS} SELECT system, round(avg(map), 6) AS map, round(avg(mrr), 6) AS mrr FROM runs GROUP BY system")
def report_averages(spark, d):
    return sweeps.averages(_runs(spark, d)).select("system", F.round("map", 6).alias("map"), F.round("mrr", 6).alias("mrr"))


@query(f"WITH {_RUNS} SELECT system, label, round(map, 6) AS map FROM runs QUALIFY row_number() OVER (PARTITION BY system ORDER BY map DESC, label NULLS FIRST) = 1")
def report_best(spark, d):
    return sweeps.best_by(_runs(spark, d), "system", "label").select("system", "label", F.round("map", 6).alias("map"))


@query(f"WITH {_RUNS} SELECT system, label, CAST(NULL AS VARCHAR) AS note, round(map, 6) AS map, round(mrr, 6) AS mrr FROM runs UNION ALL SELECT system, NULL, 'all', round(avg(map), 6), NULL FROM runs GROUP BY system")
def report_tables(spark, d):
    """Tables of other columns in one report; what one lacks is null."""
    runs = _runs(spark, d)
    total = runs.groupBy("system").agg(F.avg("map").alias("map")).withColumn("note", F.lit("all"))
    path = workspace.new_path(spark, "report")
    sinks.write_rows([runs, total], path, ["system", "label", "note", "map", "mrr"])
    return _read_report(spark, path, "system", "label", "note")


@query(f"WITH {_RUNS} SELECT system, label, round(map, 6) AS map, round(mrr, 6) AS mrr FROM runs UNION ALL SELECT system, label, round(map, 6), round(mrr, 6) FROM runs")
def report_appended(spark, d):
    """Rows are appended twice, with fixed fields; headers do not become rows."""
    path = workspace.new_path(spark, "appended")
    for _ in range(2):
        sinks.append_rows(_runs(spark, d).withColumn("extra", F.lit(1)), path, ["system", "label", "map", "mrr"])
    return _read_report(spark, path, "system", "label")


def _read_report(spark, path: str, *names: str) -> DataFrame:
    rows = tables.read_csv(spark, path)
    return rows.select(*names, *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("map", "mrr")))
