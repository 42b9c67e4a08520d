"""Registered queries over the driver's tables, and the SQL that gives the same rows.

Orders (or customers, suppliers, users) stand for entities, parts for features, and
quantities for weights, so the operators run over tables of any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillgraph.config import ALIASES, Options
from skillgraph.functions import cells, text
from skillgraph.operators import entities, events, export, graph, lookup, paths, projection, quality, subset
from skillgraph.operators.components import connected
from skillgraph.plans import pipeline
from skillgraph.sources import exports, tabular
from skillgraph.storage import scratch_path, stored
from skillgraph.streaming import increments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the bipartite reading -------------------------------------------------

_EDGES = "SELECT CAST(l_orderkey AS VARCHAR) AS entity, CAST(l_partkey AS VARCHAR) AS feature, MAX(CAST(l_quantity AS DECIMAL(18,6))) AS weight FROM lineitem GROUP BY 1, 2"
_WITH = f"WITH e AS ({_EDGES})"
_PAIRS = "SELECT x.entity AS a, y.entity AS b, COUNT(*) AS shared_count, SUM(LEAST(x.weight, y.weight)) AS weighted_score FROM {e} x JOIN {e} y ON x.feature = y.feature AND x.entity < y.entity GROUP BY 1, 2"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items: an order is a row, a line its place there."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("entity"), F.col("l_partkey").cast("string").alias("feature"), F.col("l_quantity").cast("decimal(18,6)").alias("weight"), F.col("l_orderkey").alias("row_idx"), F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("place"), F.col("l_suppkey").alias("supplier")
    )


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.best_edges(_items(spark, sf_dir), "entity", "feature", "weight", ("row_idx", "place"))


def _order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of orders and parts under their numbers, which are shorter than texts."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("feature"), F.col("l_quantity").cast("decimal(18,6)").alias("weight"))
    return entities.best_edges(lines.repartition("entity"), "entity", "feature", "weight", ())  # an entity's edges lie together


def _customer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts, under their numbers: far fewer entities, with many shared parts."""
    own = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("feature"), F.col("l_quantity").cast("decimal(18,6)").alias("weight"))
    return lines.join(own, "l_orderkey").groupBy("entity", "feature").agg(F.max("weight").alias("weight"))


def _customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_parts(spark, sf_dir).select(F.col("entity").cast("string").alias("entity"), F.col("feature").cast("string").alias("feature"), "weight")


_CUSTOMER_EDGES = "SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(l_partkey AS VARCHAR) AS feature, MAX(CAST(l_quantity AS DECIMAL(18,6))) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"


@_register("SELECT entity, feature, CAST(weight AS DOUBLE) AS weight, place FROM (SELECT CAST(l_orderkey AS VARCHAR) AS entity, CAST(l_partkey AS VARCHAR) AS feature, l_quantity AS weight, CAST(l_linenumber AS BIGINT) AS place, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def edge_dedup_max_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("entity", "feature", F.col("weight").cast("double").alias("weight"), F.col("place.l_linenumber").cast("long").alias("place"))


@_register("""WITH w AS (SELECT MAX(l_quantity) OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, l_quantity AS q FROM lineitem),
c AS (SELECT COUNT(DISTINCT l_orderkey) - 1 AS n FROM lineitem GROUP BY l_orderkey, l_partkey)
SELECT CAST((SELECT COUNT(*) FROM w WHERE m >= q) + (SELECT SUM(n) FROM c) AS BIGINT) AS duplicate_edges""")
def edge_duplicate_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("place"))
    return entities.duplicate_edges(lines, "l_orderkey", "l_partkey", "l_quantity", "l_orderkey", "place")  # orders and parts under their numbers


_UPSERT = "SELECT CAST(user_id AS VARCHAR) AS entity, event_id AS row_idx, CASE WHEN event_id % 3 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 5 <> 0 THEN value END AS amount FROM events"


@_register(f"""WITH r AS ({_UPSERT}), f AS (SELECT entity, MIN(row_idx) AS first_order, COUNT(*) AS n_rows, MIN(CASE WHEN kind IS NOT NULL THEN row_idx END) AS k, MIN(CASE WHEN amount IS NOT NULL THEN row_idx END) AS a FROM r GROUP BY entity)
SELECT f.entity, x.kind, y.amount, f.first_order, f.n_rows FROM f LEFT JOIN r x ON x.row_idx = f.k LEFT JOIN r y ON y.row_idx = f.a""")
def entity_upsert_first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("row_idx"), F.expr("case when event_id % 3 <> 0 then event_type end").alias("kind"), F.expr("case when event_id % 5 <> 0 then value end").alias("amount"))
    return entities.first_known(rows, "entity", "row_idx", ("kind", "amount"))


@_register("SELECT feature, example FROM (SELECT CAST(l_partkey AS VARCHAR) AS feature, l_suppkey AS example, ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def feature_catalog_first_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.feature_catalog(_items(spark, sf_dir), "feature", "supplier", ("row_idx", "place"))


@_register("""SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE t IS NULL) AS missing_title, COUNT(*) FILTER (WHERE t IS NOT NULL AND blank) AS missing_cell, COUNT(*) FILTER (WHERE t IS NOT NULL AND NOT blank) AS valid_rows FROM (
SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS t, event_id % 5 = 0 AS blank FROM events)""")
def validation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 == 0, " None ").when(F.col("event_id") % 11 == 0, "  ").otherwise(F.col("event_type"))
    rows = _table(spark, sf_dir, "events").select(text.clean(raw).alias("t"), (F.col("event_id") % 5 == 0).alias("blank"))
    return rows.agg(F.count("*").alias("total_rows"), F.count_if(F.col("t").isNull()).alias("missing_title"), F.count_if(F.col("t").isNotNull() & F.col("blank")).alias("missing_cell"), F.count_if(F.col("t").isNotNull() & ~F.col("blank")).alias("valid_rows"))


# --- cells -----------------------------------------------------------------

#: Cells that a task parses. Tables tell little of that by their bytes: many keys lie in few splits.
CELLS_AT_ONCE = 40_000


def _dealt(df: DataFrame, key: str, rows_a_cell: int = 1) -> DataFrame:
    """``df`` dealt out by ``key``, from which cells are made then, in as many tasks as its rows want."""
    return df.repartition(max(1, -(-df.count() // (CELLS_AT_ONCE * rows_a_cell))), key)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for each order: its lines as a JSON list."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("Part "), "l_partkey").alias("skill"), F.element_at(F.array(*map(F.lit, ("Advanced", "Proficient", "critical"))), F.col("l_linenumber").cast("int") % 3 + 1).alias("bucket"), (F.col("l_discount") * 10).alias("mapping_similarity"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    grouped = _dealt(lines, "l_orderkey", 4).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("i"))
    return grouped.select(F.col("l_orderkey").alias("row_idx"), F.to_json(F.transform("i", lambda x: F.struct(x["skill"].alias("skill"), x["bucket"].alias("bucket"), x["mapping_similarity"].alias("mapping_similarity")))).alias("skills"))


@_register("""SELECT l_orderkey AS row_idx, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Part ' || l_partkey, l_discount) - 1 AS BIGINT) AS place, 'part ' || l_partkey AS feature, CASE CAST(l_linenumber AS INT) % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 4 END AS bucket_score,
ROUND(0.7 * LEAST(1.0, GREATEST(0.0, l_discount * 10)) + 0.3 * (CASE CAST(l_linenumber AS INT) % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 4 END) / 4.0, 6) AS edge_weight FROM lineitem""")
def parse_feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = cells.items_of(cells.parse_cells(_cells(spark, sf_dir)), "row_idx").withColumnRenamed("item", "i")
    scored = parsed.withColumn("bucket_score", text.bucket(F.col("i.bucket"))["score"])
    return scored.select("row_idx", F.col("place").cast("long").alias("place"), text.normalize_text(F.col("i.text")).alias("feature"), "bucket_score", text.edge_weight(F.col("bucket_score"), F.col("i.similarity")).alias("edge_weight"))


@_register("SELECT o_orderkey AS row_id, CASE CAST(o_orderkey % 4 AS INT) WHEN 1 THEN 'unable_to_parse_skills' ELSE 'parsed_but_no_valid_skill_objects' END AS reason, CASE CAST(o_orderkey % 4 AS INT) WHEN 1 THEN 'order ' || o_orderkey ELSE '[1, ' || o_orderkey || ']' END AS snippet FROM orders WHERE o_orderkey % 4 IN (1, 2)")
def parse_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    cell = F.when(key % 4 == 1, F.concat(F.lit("order "), key)).when(key % 4 == 2, F.concat(F.lit("[1, "), key, F.lit("]"))).when(key % 4 == 3, F.concat(F.lit("see {'skill': 'Part "), key, F.lit("', bucket: Advanced} there"))).otherwise(F.concat(F.lit("[{'skill': 'Part "), key, F.lit("', 'bucket': None}]")))
    parsed = cells.parse_cells(_dealt(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(key.alias("row_id"), cell.alias("skills")))
    return cells.faults_of(parsed, "row_id", "skills").select("row_id", "reason", F.substring("skills", 1, 500).alias("snippet"))


@_register("SELECT o_orderkey AS row_id, 'Part ' || o_orderkey AS feature, CASE WHEN o_orderkey % 2 = 1 THEN 'Advanced' END AS bucket FROM orders")
def parse_broken_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    cell = F.when(key % 2 == 1, F.concat(F.lit("see {'skill': 'Part "), key, F.lit("', bucket: Advanced} there"))).otherwise(F.concat(F.lit("[{'skill': 'Part "), key, F.lit("', 'bucket': None}]")))
    parsed = cells.parse_cells(_dealt(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(key.alias("row_id"), cell.alias("skills")))
    return cells.items_of(parsed, "row_id").select("row_id", F.col("item.text").alias("feature"), F.col("item.bucket").alias("bucket"))


@_register("""SELECT o_orderkey AS row_id, 'Part ' || o_orderkey AS feature, CAST(CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END AS INT) AS n_extra, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 9 AS VARCHAR) END AS level, CASE WHEN o_orderkey % 4 < 2 THEN 'true' END AS must,
CASE o_orderkey % 4 WHEN 0 THEN 'says "' || o_orderkey || '"' WHEN 1 THEN 'says ' || o_orderkey WHEN 3 THEN '{"of":[' || o_orderkey || ',1.5]}' END AS note, o_orderkey % 4 = 0 OR o_orderkey % 4 = 2 AS has_none FROM orders""")
def parse_extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further fields of objects: JSON (read by Spark), a Python literal, an object within text, one within another."""
    key, level = F.col("o_orderkey"), F.col("o_orderkey") % 9
    cell = (
        F.when(key % 4 == 0, F.concat(F.lit('[{"skill":"Part '), key, F.lit('","level":'), level, F.lit(',"note":"says \\"'), key, F.lit('\\"","must":true,"none":null,"mapping_similarity":0.5,"empty":""}]')))
        .when(key % 4 == 1, F.concat(F.lit("[{'skill': 'Part "), key, F.lit("', 'level': "), level, F.lit(", 'note': 'says "), key, F.lit("', 'must': True, 'other': 'x', 'bucket': 'Advanced'}]")))
        .when(key % 4 == 2, F.concat(F.lit('see {"skill": "Part '), key, F.lit('", "level": '), level, F.lit(', "none": null} there')))
        .otherwise(F.concat(F.lit('[{"skill":"Part '), key, F.lit('","note":{"of": ['), key, F.lit(", 1.5]}}]")))
    )
    items = cells.items_of(cells.parse_cells(_dealt(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(key.alias("row_id"), cell.alias("skills"))), "row_id")
    extra = F.col("item.extra")
    return items.select("row_id", F.col("item.text").alias("feature"), F.size(extra).alias("n_extra"), extra["level"].alias("level"), extra["must"].alias("must"), extra["note"].alias("note"), F.map_contains_key(extra, "none").alias("has_none"))


# --- scalars ---------------------------------------------------------------


@_register("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('  ' || p_name || '  ' || p_brand || ' .;- ')), '\\s+', ' ', 'g'), '[\\s.,;:!?\\-_/]+$', '') AS normalized FROM part")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit("  "), "p_brand", F.lit(" .;- "))
    return _table(spark, sf_dir, "part").select("p_partkey", text.normalize_text(raw).alias("normalized"))


@_register("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM part")
def pretty_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text.pretty_label(F.lower("p_name")).alias("label"))


@_register("SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(p_type || ' - ' || p_brand), '[-/]+', '_', 'g'), '\\s+', '_', 'g'), '[^0-9a-zA-Z_]', '', 'g'), '_+', '_', 'g'), '_')) AS header FROM part")
def header_snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text.header_expression(F.concat("p_type", F.lit(" - "), "p_brand")).alias("header"))


@_register("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'mission-critical' WHEN '2-HIGH' THEN 'advanced' WHEN '3-MEDIUM' THEN 'more proficient' WHEN '5-LOW' THEN 'unknown' ELSE '4 not specified' END AS bucket,
CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 0 END AS score FROM orders""")
def bucket_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", " Mission-Critical ").when(p == "2-HIGH", "ADVANCED").when(p == "3-MEDIUM", "more_proficient!").when(p == "5-LOW", "???").otherwise("4-Not  Specified")
    found = text.bucket(raw)
    return _table(spark, sf_dir, "orders").select("o_orderkey", found["text"].alias("bucket"), found["score"].alias("score"))


@_register("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN ROUND(0.5 * (CAST(l_linenumber AS INT) % 5) / 4.0 + 0.25, 6) ELSE ROUND(0.7 * LEAST(1.0, GREATEST(0.0, l_discount * 20 - 0.5)) + 0.3 * (CAST(l_linenumber AS INT) % 5) / 4.0, 6) END AS w FROM lineitem""")
def edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_discount") * 20 - 0.5)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.edge_weight(F.col("l_linenumber").cast("int") % 5, similarity).alias("w"))


@_register("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE FLOOR(ABS(c_acctbal) * 100) END AS amount, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' WHEN FLOOR(ABS(c_acctbal) * 100) < 10000 THEN 'lt_10k' WHEN FLOOR(ABS(c_acctbal) * 100) < 20000 THEN '10k_20k' WHEN FLOOR(ABS(c_acctbal) * 100) < 50000 THEN '20k_50k' ELSE 'ge_50k' END AS band FROM customer")
def numeric_parse_salary_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("c_custkey") % 3 == 0, "about 5k").otherwise(F.concat(F.lit(" "), F.format_number(F.floor(F.abs("c_acctbal") * 100), 0), F.lit(" ")))
    return _table(spark, sf_dir, "customer").select("c_custkey", cell.alias("t")).select("c_custkey", text.parse_number(F.col("t")).alias("amount"), text.salary_band(F.col("t")).alias("band"))


@_register("SELECT c_custkey, 'skill::' || substr(sha1(lower(c_name)), 1, 16) AS id, 'job_fallback::' || substr(sha1(CASE WHEN c_custkey % 5 = 0 THEN 'row_' || c_custkey ELSE lower(c_name) || '|' || lower(c_mktsegment) || '|' END), 1, 20) AS fallback, CAST(('0x' || substr(sha1('42:' || c_custkey), 1, 8)) AS UBIGINT)::DOUBLE / 4294967295 AS u FROM customer")
def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.col("c_custkey") % 5 == 0
    return _table(spark, sf_dir, "customer").select("c_custkey", text.hashed_id("skill", F.lower("c_name")).alias("id"), text.fallback_id(F.when(~blank, F.col("c_name")), F.when(~blank, F.concat(F.lit(" "), "c_mktsegment")), F.lit(None).cast("string"), F.col("c_custkey")).alias("fallback"), text.unit_hash(42, F.col("c_custkey")).alias("u"))


@_register("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_attribute_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@_register("""SELECT p_partkey, '{"name":"' || p_name || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"size":' || p_size WHEN p_partkey % 3 = 0 THEN ',"price":' || p_size || '.5' ELSE '' END || '}' AS attributes_json FROM part""")
def compact_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text.compact_json(name=F.col("p_name"), size=F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")), price=F.when(F.col("p_partkey") % 2 != 0, F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + F.lit(0.5).cast("double")).otherwise(F.lit(float("nan"))))).alias("attributes_json"))


@_register("SELECT 'cell' AS inferred")
def feature_column_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).select(F.col("row_idx").cast("string").alias("id"), F.lit("plain text").alias("note"), F.col("skills").alias("cell"))
    return spark.createDataFrame([(tabular.infer_cell_column(rows, rows.columns),)], "inferred string")


# --- projection ------------------------------------------------------------


@_register(f"{_WITH} SELECT node, COUNT(*) AS degree, CAST(SUM(weight) AS DOUBLE) AS strength FROM (SELECT 'e' || entity AS node, weight FROM e UNION ALL SELECT 'f' || feature, weight FROM e) GROUP BY node")
def bipartite_degree_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _edges(spark, sf_dir).select(F.concat(F.lit("e"), "entity").alias("a"), F.concat(F.lit("f"), "feature").alias("b"), "weight")
    return graph.degrees(links).select("node", "degree", F.col("strength").cast("double").alias("strength"))


@_register(f"{_WITH} SELECT a, b, shared_count, CAST(weighted_score AS DOUBLE) AS weighted_score FROM ({_PAIRS.format(e='e')})")
def projection_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_pairs(projection.pair_scores(_order_parts(spark, sf_dir))).withColumn("weighted_score", F.col("weighted_score").cast("double"))


def _text_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of numbers as pairs of texts, the lesser text first."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    return pairs.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})


_SUPPLIER_EDGES = "SELECT CAST(l_suppkey AS VARCHAR) AS entity, CAST(l_partkey AS VARCHAR) AS feature, MAX(CAST(l_quantity AS DECIMAL(18,6))) AS weight FROM lineitem GROUP BY 1, 2"


def _supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("entity"), F.col("l_partkey").cast("string").alias("feature")).agg(F.max(F.col("l_quantity").cast("decimal(18,6)")).alias("weight"))


def _guard_sql(verdict: str) -> str:
    return f"""WITH e AS ({_SUPPLIER_EDGES}), d AS (SELECT feature, COUNT(DISTINCT entity) AS degree FROM e GROUP BY feature), j AS (SELECT feature, degree, degree * (degree - 1) // 2 AS pairs, {verdict} AS verdict FROM d) SELECT feature, degree, CAST(pairs AS BIGINT) AS pairs, verdict FROM j"""


@_register(_guard_sql("CASE WHEN degree < 2 THEN 'single' WHEN degree > 28 THEN 'degree' ELSE 'used' END"))
def projection_guarded_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.guarded(_supplier_edges(spark, sf_dir), max_degree=28, max_pairs=0, max_total=0).select("feature", "degree", "pairs", "verdict")


@_register(_guard_sql("CASE WHEN degree < 2 THEN 'single' WHEN degree * (degree - 1) // 2 > 300 THEN 'pairs' ELSE 'used' END"))
def projection_guarded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.guarded(_supplier_edges(spark, sf_dir), max_degree=2_000, max_pairs=300, max_total=0).select("feature", "degree", "pairs", "verdict")


@_register(f"""WITH RECURSIVE e AS ({_SUPPLIER_EDGES}), d AS (SELECT feature, COUNT(DISTINCT entity) AS degree FROM e GROUP BY feature), o AS (SELECT feature, degree, CAST(degree * (degree - 1) // 2 AS BIGINT) AS pairs, ROW_NUMBER() OVER (ORDER BY degree < 2, feature) AS n FROM d),
f(n, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false UNION ALL SELECT o.n, CASE WHEN f.used + o.pairs <= 5000 THEN f.used + o.pairs ELSE f.used END, f.used + o.pairs <= 5000 FROM f JOIN o ON o.n = f.n + 1 AND o.degree >= 2)
SELECT o.feature, o.degree, o.pairs, CASE WHEN o.degree < 2 THEN 'single' WHEN f.taken THEN 'used' ELSE 'total' END AS verdict FROM o LEFT JOIN f ON f.n = o.n""")
def projection_guarded_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.guarded(_supplier_edges(spark, sf_dir), max_degree=1_000_000, max_pairs=0, max_total=5_000).select("feature", "degree", "pairs", "verdict")


@_register(f"""WITH e AS ({_SUPPLIER_EDGES}), d AS (SELECT feature, COUNT(DISTINCT entity) AS degree FROM e GROUP BY feature), j AS (SELECT degree, degree * (degree - 1) // 2 AS pairs, CASE WHEN degree < 2 THEN 'single' WHEN degree > 28 THEN 'degree' WHEN degree * (degree - 1) // 2 > 300 THEN 'pairs' ELSE 'used' END AS v FROM d)
SELECT COUNT(*) AS features, COUNT(*) FILTER (WHERE v = 'used') AS features_used, COUNT(*) FILTER (WHERE v = 'degree') AS skipped_by_degree, COUNT(*) FILTER (WHERE v = 'pairs') AS skipped_by_pairs, CAST(COALESCE(SUM(pairs) FILTER (WHERE v = 'used'), 0) AS BIGINT) AS pairs_used, MAX(degree) AS max_degree FROM j""")
def projection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = projection.guarded(_supplier_edges(spark, sf_dir), max_degree=28, max_pairs=300, max_total=0)
    return projection.projection_stats(judged).select("features", "features_used", "skipped_by_degree", "skipped_by_pairs", "pairs_used", "max_degree")


def _topk_sql(edges: str, score: str, k: int, threshold: float, method: str) -> str:
    return f"""SELECT entity, neighbor, ROUND(CAST(s AS DOUBLE), 6) AS similarity_score, CAST(r AS INT) AS rank, '{method}' AS method FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY s DESC, neighbor) AS r FROM (
SELECT a AS entity, b AS neighbor, {score} AS s FROM p WHERE {score} >= {threshold} UNION ALL SELECT b, a, {score} FROM p WHERE {score} >= {threshold})) WHERE r <= {k}"""


def _with_pairs(edges: str) -> str:
    return f"WITH e AS ({edges}), p AS ({_PAIRS.format(e='e')})"


def _named(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.col(c).cast("string") for c in ("entity", "neighbor")})


@_register(f"{_with_pairs(_EDGES)} {_topk_sql('e', 'shared_count', 20, 0, 'unweighted')}")
def topk_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(projection.similar(_order_parts(spark, sf_dir), "unweighted", 20))


@_register(f"{_with_pairs(_EDGES)} {_topk_sql('e', 'weighted_score', 5, 0, 'weighted')}")
def topk_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(projection.similar(_order_parts(spark, sf_dir), "weighted", 5))


@_register(f"{_with_pairs(_CUSTOMER_EDGES)} {_topk_sql('e', 'shared_count', 10, 3, 'unweighted')} UNION ALL {_topk_sql('e', 'weighted_score', 10, 3, 'weighted')}")
def topk_both_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(projection.similar(_customer_parts(spark, sf_dir), "both", 10, 3.0))


# --- lookups ---------------------------------------------------------------

_JOBS_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_name AS job_title, c_mktsegment AS company_name FROM customer"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("job_id"), F.col("c_name").alias("job_title"), F.col("c_mktsegment").alias("company_name"), F.lit("").alias("district"))
    return jobs.withColumn("job_title_norm", F.lower(F.trim("job_title")))


def _job_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_edges(spark, sf_dir).select(F.col("entity").alias("job_id"), F.col("feature").alias("skill_id"), F.col("weight").cast("double").alias("edge_weight"), F.concat(F.lit("part "), "feature").alias("skill_text_normalized"), F.lit("").alias("bucket_normalized"), F.lit(None).cast("double").alias("mapping_similarity"))


def _similarity_of(spark: SparkSession, sf_dir: str, job_id: str) -> DataFrame:
    """Closest jobs of one job: its filter is pushed below the self-join."""
    edges = _customer_edges(spark, sf_dir)
    mine = edges.where(F.col("entity") == job_id).select("feature", F.col("weight").alias("v"))
    scores = edges.where(F.col("entity") != job_id).join(mine, "feature").groupBy("entity").agg(F.count("*").alias("s"))
    ranked = scores.orderBy(F.desc("s"), "entity").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "entity")))
    return ranked.select(F.lit(job_id).alias("job_id"), F.col("entity").alias("neighbor_job_id"), F.col("s").cast("double").alias("similarity_score"), "rank", F.lit("unweighted").alias("method"))


_CLOSE = f"""WITH e AS ({_CUSTOMER_EDGES}), m AS (SELECT feature FROM e WHERE entity = '7'), s AS (SELECT e.entity, COUNT(*) AS s FROM e JOIN m USING (feature) WHERE e.entity <> '7' GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY s DESC, entity) AS rank FROM s), j AS ({_JOBS_SQL})"""


@_register(f"{_CLOSE} SELECT '7' AS job_id, q.job_title AS query_job_title, r.entity AS neighbor_job_id, n.job_title AS neighbor_job_title, n.company_name AS neighbor_company_name, CAST(r.s AS DOUBLE) AS similarity_score, CAST(rank AS INT) AS rank, 'unweighted' AS method FROM r LEFT JOIN j q ON q.job_id = '7' LEFT JOIN j n ON n.job_id = r.entity WHERE rank <= 10")
def closest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.closest_jobs(_similarity_of(spark, sf_dir, "7"), _jobs(spark, sf_dir), "7", "unweighted", 10)


@_register(f"""{_CLOSE}, x AS (SELECT e.entity, COUNT(DISTINCT feature) AS c, LIST(DISTINCT 'part ' || feature ORDER BY 'part ' || feature) AS l FROM e JOIN m USING (feature) GROUP BY 1)
SELECT '7' AS job_id, q.job_title AS query_job_title, r.entity AS neighbor_job_id, n.job_title AS neighbor_job_title, n.company_name AS neighbor_company_name, CAST(r.s AS DOUBLE) AS similarity_score, CAST(rank AS INT) AS rank, 'unweighted' AS method, c AS shared_skill_count, array_to_string(l[1:5], ', ') AS shared_skills_preview FROM r LEFT JOIN j q ON q.job_id = '7' LEFT JOIN j n ON n.job_id = r.entity JOIN x USING (entity) WHERE rank <= 10""")
def closest_entities_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.closest_jobs(_similarity_of(spark, sf_dir, "7"), _jobs(spark, sf_dir), "7", "unweighted", 10, _job_edges(spark, sf_dir))


def _resolved(found: tuple[str | None, DataFrame, str]) -> DataFrame:
    job_id, rows, reason = found
    return rows.select("job_id", "job_title", F.lit(job_id).cast("string").alias("resolved"), F.lit(reason).alias("reason"))


@_register(f"SELECT job_id, job_title, job_id AS resolved, 'resolved_by_exact_title' AS reason FROM ({_JOBS_SQL}) WHERE job_title = (SELECT c_name FROM customer WHERE c_custkey = 42)")
def resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_name").first()[0]
    return _resolved(lookup.resolve_job(_jobs(spark, sf_dir), title=f" {name.upper()} "))


@_register(f"SELECT job_id, job_title, CAST(NULL AS VARCHAR) AS resolved, 'ambiguous_partial_title' AS reason FROM ({_JOBS_SQL}) WHERE lower(job_title) LIKE '%00001%' ORDER BY job_id LIMIT 10")
def resolve_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(lookup.resolve_job(_jobs(spark, sf_dir), title="00001"))


@_register()
def resolve_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(lookup.resolve_job(_jobs(spark, sf_dir), title="Costumer#00000042x"))


def _skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("skill_id"), text.normalize_text(F.col("p_name")).alias("skill_text_normalized"))
    return parts.withColumn("label", text.pretty_label(F.col("skill_text_normalized")))


def _suggested(cutoff: float, shown: int) -> str:
    """Suggestions for a name with a letter too many, one with two changed, and nothing like any: common subsequences by recursion over the characters of each pair, a list for each row of the table."""
    return f"""WITH RECURSIVE c AS (SELECT DISTINCT lower(p_name) AS t, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM part), m AS (SELECT MIN(t) AS f, MAX(t) AS l FROM c),
q AS (SELECT 0 AS place, f || 'x' AS q FROM m UNION ALL SELECT 1, substr(l, 2) || 'zz' FROM m UNION ALL SELECT 2, 'nothing like it'),
r(place, q, t, i, l) AS (SELECT place, q, t, 0, list_transform(range(0, length(q) + 1), lambda x: 0) FROM q, c
 UNION ALL SELECT place, q, t, i + 1, list_reduce(list_transform(range(1, length(q) + 1), lambda j: [CASE WHEN q[j] = t[i + 1] THEN l[j] + 1 ELSE 0 END, l[j + 1]]), lambda a, x: list_append(a, greatest(x[1], x[2], a[len(a)])), [0]) FROM r WHERE i < length(t)),
s AS (SELECT place, q, t, 200.0 * l[len(l)] / (length(q) + length(t)) AS score FROM r WHERE i = length(t)),
n AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, t) AS n FROM s)
SELECT q.q AS query, q.q AS query_normalized, coalesce(list(c.label ORDER BY n.n) FILTER (WHERE n.t IS NOT NULL), []) AS suggestions FROM q LEFT JOIN n ON n.place = q.place AND n.n <= {shown} AND score >= {cutoff} LEFT JOIN c ON c.t = n.t GROUP BY 1, 2"""


@_register(_suggested(70, 5))
def suggest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = _table(spark, sf_dir, "part").agg(F.min(F.lower("p_name")), F.max(F.lower("p_name"))).first()
    return lookup.resolve_skills([first + "x", last[1:] + "zz", "nothing like it"], _skills(spark, sf_dir), 70)[1]


_IDS = ("1", "3", "5", "8", "13", "21", "34", "55", "89", "144")
_IN = ", ".join(f"'{i}'" for i in _IDS)


@_register(f"""WITH e AS ({_CUSTOMER_EDGES}), c AS (SELECT entity, COUNT(DISTINCT feature) AS n, ROUND(CAST(SUM(weight) AS DOUBLE), 6) AS w, array_to_string(LIST(DISTINCT 'part ' || feature ORDER BY 'part ' || feature), ', ') AS m FROM e WHERE feature IN ({_IN}) GROUP BY 1)
SELECT entity AS job_id, c_name AS job_title, n AS matched_skill_count, 10 AS total_query_skills, ROUND(n / 10, 6) AS matched_ratio, w AS matched_weight_sum, m AS matched_skills, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, w DESC, entity) AS INT) AS rank FROM c LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = entity QUALIFY rank <= 20""")
def rank_for_features_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.rank_for_skills(_job_edges(spark, sf_dir), _jobs(spark, sf_dir), list(_IDS), len(_IDS))


@_register(f"""WITH e AS ({_CUSTOMER_EDGES}) SELECT '7' AS job_id, (SELECT c_name FROM customer WHERE c_custkey = 7) AS job_title, feature AS skill_id, 'part ' || feature AS skill_text_normalized, CAST(weight AS DOUBLE) AS edge_weight, CAST(ROW_NUMBER() OVER (ORDER BY weight DESC, 'part ' || feature, feature) AS INT) AS rank FROM e WHERE entity = '7' QUALIFY rank <= 15""")
def entity_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.top_skills(_job_edges(spark, sf_dir), _jobs(spark, sf_dir), _skills(spark, sf_dir), "7", 15).select("job_id", "job_title", "skill_id", "skill_text_normalized", "edge_weight", "rank")


@_register(f"WITH e AS ({_CUSTOMER_EDGES}) SELECT CAST(p_partkey AS VARCHAR) AS node, p_name AS label, COUNT(feature) AS global_degree FROM part LEFT JOIN e ON feature = CAST(p_partkey AS VARCHAR) GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 300")
def feature_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("node"), F.lit("skill").alias("node_type"), F.col("p_name").alias("label"))
    return graph.hubs(_customer_edges(spark, sf_dir).select(F.concat(F.lit("c"), "entity").alias("a"), F.col("feature").alias("b")), nodes)


@_register(f"WITH e AS ({_CUSTOMER_EDGES}) SELECT entity AS job_id, c_name AS job_title FROM (SELECT DISTINCT entity FROM e WHERE feature = '9') LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = entity ORDER BY 1 LIMIT 200")
def feature_linked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.linked_jobs(_job_edges(spark, sf_dir), _jobs(spark, sf_dir), "9")


# --- graph -----------------------------------------------------------------

_SPARSE = "SELECT DISTINCT 'e' || l_orderkey AS a, 'f' || l_partkey AS b FROM lineitem WHERE l_quantity >= 49"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts joined by large quantities: many components."""
    lines = _table(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    return lines.groupBy(F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("b")).agg(F.max("l_quantity").alias("weight"))


_COMPONENTS = f"""WITH RECURSIVE e AS ({_SPARSE}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node), c AS (SELECT node, MIN(root) AS component FROM r GROUP BY node)"""


@_register(f"{_COMPONENTS} SELECT node, component FROM c")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected(_sparse(spark, sf_dir))


@_register(f"{_COMPONENTS} SELECT component, COUNT(*) AS size, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, component) AS INT) AS rank FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_components(graph.component_sizes(_sparse(spark, sf_dir)), 20)


@_register(f"{_COMPONENTS}, t AS (SELECT component FROM c GROUP BY 1 ORDER BY COUNT(*) DESC, component LIMIT 1) SELECT c.node, COUNT(*) AS degree FROM c JOIN t USING (component) JOIN u ON u.a = c.node GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def component_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(_sparse(spark, sf_dir), "edges")
    members = stored(connected(edges), "members")
    top = graph.top_components(members.groupBy("component").agg(F.count("*").alias("size")), 1).first()[0]
    return graph.component_part(edges, members, top, 8)


@_register(f"""WITH e AS ({_SPARSE}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), s AS (SELECT MIN(a) AS n FROM e), h1 AS (SELECT DISTINCT b AS n FROM u JOIN s ON a = n), h2 AS (SELECT DISTINCT b AS n FROM u JOIN h1 ON a = n WHERE b NOT IN (SELECT n FROM s UNION SELECT n FROM h1)), h3 AS (SELECT DISTINCT b AS n FROM u JOIN h2 ON a = n WHERE b NOT IN (SELECT n FROM s UNION SELECT n FROM h1 UNION SELECT n FROM h2))
SELECT n AS node, 0 AS hop FROM s UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2 UNION ALL SELECT n, 3 FROM h3""")
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(_sparse(spark, sf_dir), "edges")
    return graph.ego(edges, edges.agg(F.min("a")).first()[0], 3, 5_000).select("node", "hop")


@_register("SELECT a, b, weight FROM (SELECT 'e' || l_orderkey AS a, 'f' || l_partkey AS b, MAX(l_quantity) AS weight FROM lineitem WHERE l_quantity >= 49 GROUP BY 1, 2) WHERE b < 'f5' AND a < 'e5' ORDER BY weight DESC, a, b LIMIT 25")
def induced_subgraph_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(_sparse(spark, sf_dir), "edges")
    nodes = edges.select(F.col("a").alias("node")).where("node < 'e5'").unionByName(edges.select(F.col("b").alias("node")).where("node < 'f5'")).distinct()
    return graph.induced(edges, nodes, 25)


def _customer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who share five parts or more."""
    pairs = _text_pairs(projection.pair_scores(_customer_parts(spark, sf_dir)).where("shared_count >= 5"))
    return stored(pairs.select("a", "b", F.col("shared_count").cast("double").alias("weight")), "graph")


_CUSTOMER_GRAPH = f"{_with_pairs(_CUSTOMER_EDGES)}, g AS (SELECT a, b, shared_count FROM p WHERE shared_count >= 5)"


@_register(f"{_CUSTOMER_GRAPH} SELECT CAST(c_custkey AS VARCHAR) AS node, COUNT(w) AS degree, CAST(COALESCE(SUM(w), 0) AS DOUBLE) AS strength FROM customer LEFT JOIN (SELECT a AS n, shared_count AS w FROM g UNION ALL SELECT b, shared_count FROM g) ON n = CAST(c_custkey AS VARCHAR) GROUP BY 1")
def projected_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node"))
    return graph.degrees(_customer_graph(spark, sf_dir), nodes)


@_register(_CUSTOMER_GRAPH.replace("WITH e", "WITH RECURSIVE e") + """, u AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g), d(s, t, k) USING KEY (s, t) AS (SELECT a, a, 0 FROM u UNION SELECT d.s, u.b, MIN(d.k) + 1 FROM d JOIN u ON u.a = d.t LEFT JOIN recurring.d o ON o.s = d.s AND o.t = u.b WHERE o.s IS NULL GROUP BY d.s, u.b),
m AS (SELECT s, MIN(t) AS c, COUNT(*) AS n, SUM(k) AS total FROM d GROUP BY s), top AS (SELECT c FROM m GROUP BY c ORDER BY COUNT(*) DESC, c LIMIT 1) SELECT s AS node, ROUND((n - 1) / total, 9) AS closeness FROM m JOIN top USING (c)""")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _customer_graph(spark, sf_dir)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return paths.closeness(edges, nodes).select("node", F.round("closeness", 9).alias("closeness"))


def _betweenness(levels: int = 14) -> str:
    """Numbers of shortest paths level by level from every vertex, then what each vertex adds to those before it, from the last level back."""
    parts = ["u AS MATERIALIZED (SELECT a, b FROM g UNION ALL SELECT b, a FROM g)", "l0 AS MATERIALIZED (SELECT DISTINCT a AS s, a AS v, CAST(1 AS DOUBLE) AS n FROM u)"]
    for k in range(1, levels + 1):
        seen = f"SELECT s, v FROM l{k - 1}" + (f" UNION ALL SELECT s, v FROM l{k - 2}" if k > 1 else "")
        parts.append(f"l{k} AS MATERIALIZED (SELECT x.s, u.b AS v, SUM(n) AS n FROM l{k - 1} x JOIN u ON u.a = x.v WHERE NOT EXISTS (SELECT 1 FROM ({seen}) o WHERE o.s = x.s AND o.v = u.b) GROUP BY 1, 2)")
    parts.append(f"d{levels} AS MATERIALIZED (SELECT s, v, n, CAST(0 AS DOUBLE) AS d FROM l{levels})")
    for k in range(levels - 1, 0, -1):
        parts.append(f"d{k} AS MATERIALIZED (SELECT x.s, x.v, x.n, COALESCE(SUM(x.n / y.n * (1 + y.d)), 0) AS d FROM l{k} x JOIN u ON u.a = x.v LEFT JOIN d{k + 1} y ON y.s = x.s AND y.v = u.b GROUP BY 1, 2, 3)")
    every = " UNION ALL ".join(f"SELECT v, d FROM d{k}" for k in range(1, levels + 1))
    return f"{_CUSTOMER_GRAPH}, {', '.join(parts)}, t AS (SELECT v, SUM(d) / 2 AS b FROM ({every}) GROUP BY 1) SELECT a AS node, COUNT(*) AS degree, ROUND(COALESCE(MAX(t.b), 0), 4) AS betweenness FROM u LEFT JOIN t ON t.v = u.a GROUP BY 1"


@_register(_betweenness())
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _customer_graph(spark, sf_dir)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return paths.betweenness(edges, nodes).select("node", "degree", F.round("betweenness", 4).alias("betweenness"))


# --- subset ----------------------------------------------------------------

_STRATA = "SELECT o_orderkey AS row_idx, o_orderpriority || '||' || CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'mid' ELSE 'high' END AS stratum FROM orders"
_QUOTAS = f"""s AS ({_STRATA}), n AS (SELECT stratum, COUNT(*) AS n FROM s GROUP BY 1), x AS (SELECT stratum, n, n / SUM(n) OVER () * 1000.0 AS exact FROM n), f AS (SELECT *, CAST(FLOOR(exact) AS BIGINT) AS q FROM x),
quota AS (SELECT stratum, n, q + CASE WHEN ROW_NUMBER() OVER (ORDER BY exact - q DESC, n DESC, stratum DESC) <= 1000 - SUM(q) OVER () THEN 1 ELSE 0 END AS quota FROM f)"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("o_totalprice") < 100_000, "low").when(F.col("o_totalprice") < 250_000, "mid").otherwise("high")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.concat_ws("||", "o_orderpriority", band).alias("stratum"))


@_register(f"WITH {_QUOTAS} SELECT stratum, n, CAST(quota AS BIGINT) AS quota FROM quota")
def subset_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.quotas(_strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n")), 1_000)


@_register(f"""WITH {_QUOTAS}, k AS (SELECT row_idx, stratum, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY CAST(('0x' || substr(sha1('42:' || row_idx), 1, 8)) AS UBIGINT)::DOUBLE / 4294967295 DESC, row_idx DESC) AS r FROM s) SELECT row_idx, stratum FROM k JOIN quota USING (stratum) WHERE r <= quota""")
def subset_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _strata(spark, sf_dir).withColumn("score", text.unit_hash(42, F.col("row_idx")))
    share = subset.quotas(rows.groupBy("stratum").agg(F.count("*").alias("n")), 1_000)
    return subset.choose(rows, share, 1_000)


@_register("""WITH f AS (SELECT l_partkey, COUNT(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), l AS (SELECT LIST(n ORDER BY n) AS l, COUNT(*) AS c FROM f)
SELECT GREATEST(1, l[GREATEST(1, CAST(FLOOR(c * 0.1) AS BIGINT))]) AS rare, GREATEST(1, l[GREATEST(1, CAST(FLOOR(c * 0.9) AS BIGINT))]) AS common FROM l""")
def frequency_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"))
    return spark.createDataFrame([subset.frequency_cutoffs(stored(counts, "frequency"))], "rare long, common long")


@_register("SELECT c_custkey, CAST(1 + length(c_name) + CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE length(c_mktsegment) END AS BIGINT) AS size FROM customer")
def row_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment")).alias("segment"))
    return rows.select("c_custkey", subset.row_size(["c_name", "segment"]).cast("long").alias("size"))


# --- whole rows --------------------------------------------------------------


def _raw_rows(spark: SparkSession, sf_dir: str) -> tabular.Canonical:
    """A canonical row for each order: some without title, with blank, spaced, broken, literal or empty cells, some ids twice or missing."""
    key = F.col("o_orderkey")
    bad = key % 7
    cell = (
        F.when(bad == 0, F.lit(None)).when(bad == 1, "   ").when(bad == 2, F.concat(F.lit("order "), key)).when(bad == 3, F.concat(F.lit("[1, "), key, F.lit("]")))
        .when(bad == 4, F.concat(F.lit("[{'skill': 'Part "), key % 50, F.lit("', 'bucket': 'Advanced'}]")))
        .when(bad == 5, F.concat(F.lit('[{"skill":"Part '), key % 50, F.lit('","bucket":"critical","mapping_similarity":0.5},{"skill":" part  '), key % 50, F.lit('.","mapping_similarity":0.25}]')))
        .otherwise(F.concat(F.lit('{"skill": "Part '), key % 20, F.lit('", "bucket": "proficient", "mapping_similarity": 1}')))
    )
    none = F.lit(None).cast("string")
    columns = {"job_id": F.when(key % 3 != 0, F.concat(F.lit("j"), F.floor(key / 4))), "job_title": F.when(key % 11 != 0, F.col("o_orderpriority")).otherwise(F.lit(" nan ")), "skills": cell, "company_name": F.col("o_custkey").cast("string"), "posted_at": F.when(key % 2 == 0, "2025")}
    rows = _table(spark, sf_dir, "orders").select(key.alias("row_idx"), *[columns.get(c, none).alias(c) for c in sorted(ALIASES)])
    return tabular.Canonical(rows, frozenset(columns), ())


_RAW = """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 7 AS bad, CASE WHEN o_orderkey % 3 <> 0 THEN 'j' || (o_orderkey // 4) ELSE 'job_fallback::' || substr(sha1(lower(o_orderpriority) || '|' || o_custkey || '|' || CASE WHEN o_orderkey % 2 = 0 THEN '2025' ELSE '' END), 1, 20) END AS job_id, o_orderpriority AS job_title, CAST(o_custkey AS VARCHAR) AS company_name, CASE WHEN o_orderkey % 2 = 0 THEN '2025' END AS posted_at FROM orders WHERE o_orderkey % 11 <> 0),
v AS (SELECT * FROM r WHERE bad <> 1),
i AS (SELECT k, job_id, 0 AS place, 'part ' || (k % 50) AS t, 3 AS score, NULL AS sim, 0.5 * 0.75 + 0.25 AS w FROM v WHERE bad = 4 UNION ALL SELECT k, job_id, 0, 'part ' || (k % 50), 4, 0.5, 0.7 * 0.5 + 0.3 FROM v WHERE bad = 5 UNION ALL SELECT k, job_id, 1, 'part ' || (k % 50), 0, 0.25, 0.7 * 0.25 FROM v WHERE bad = 5 UNION ALL SELECT k, job_id, 0, 'part ' || (k % 20), 2, 1, 0.7 + 0.3 * 0.5 FROM v WHERE bad = 6)"""


@_register(f"""{_RAW} SELECT job_id, arg_min(job_title, k) AS job_title, arg_min(company_name, k) AS company_name, arg_min(posted_at, k) AS posted_at, COUNT(*) AS n_rows FROM v GROUP BY 1""")
def build_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.build(_raw_rows(spark, sf_dir)).jobs.select("job_id", "job_title", "company_name", "posted_at", "n_rows")


@_register(f"""{_RAW}, b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id, t ORDER BY ROUND(w, 6) DESC, k, place) AS n FROM i) SELECT job_id, 'skill::' || substr(sha1(t), 1, 16) AS skill_id, t AS skill_text_normalized, CAST(ROUND(w, 6) AS DOUBLE) AS edge_weight, k AS source_row_index FROM b WHERE n = 1""")
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.build(_raw_rows(spark, sf_dir)).edges.select("job_id", "skill_id", "skill_text_normalized", F.col("edge_weight").cast("double").alias("edge_weight"), "source_row_index")


@_register(f"""{_RAW}, n AS (SELECT job_id, COUNT(*) AS n FROM v GROUP BY 1), e AS (SELECT job_id, t, COUNT(DISTINCT k) AS n FROM i GROUP BY 1, 2)
SELECT 'total_rows' AS counter, COUNT(*) AS n FROM orders UNION ALL SELECT 'missing_job_title', COUNT(*) FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'missing_skills', COUNT(*) FROM r WHERE bad = 1
UNION ALL SELECT 'valid_rows', COUNT(*) FROM v UNION ALL SELECT 'parse_failure_count', COUNT(*) FROM v WHERE bad IN (2, 3) UNION ALL SELECT 'duplicate_job_rows', CAST(SUM(n - 1) AS BIGINT) FROM n
UNION ALL SELECT 'duplicate_job_skill_edges', CAST((SELECT COUNT(*) FROM i WHERE place = 1) + (SELECT SUM(n - 1) FROM e) AS BIGINT)""")
def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.build(_raw_rows(spark, sf_dir)).counters


@_register("""SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 4 = 0 THEN 'group a' WHEN o_orderkey % 4 = 1 THEN 'group b' WHEN o_orderkey % 4 = 2 THEN 'nan' ELSE lower(o_orderpriority) END || '||' || lower(o_orderstatus) || '||' || CASE WHEN o_totalprice < 10000 THEN 'lt_10k' WHEN o_totalprice < 20000 THEN '10k_20k' WHEN o_totalprice < 50000 THEN '20k_50k' ELSE 'ge_50k' END AS stratum FROM orders""")
def stratum_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    occupation = F.when(key % 4 == 0, "  ").when(key % 4 == 1, " UnKnown ").when(key % 4 == 2, F.lit(None)).otherwise(F.col("o_orderpriority"))
    rows = _table(spark, sf_dir, "orders").select(key.alias("row_idx"), occupation.alias("assigned_occupation_group"), F.when(key % 4 == 0, "Group A").otherwise(" group B").alias("group"), F.concat(F.lit(" "), "o_orderstatus").alias("district"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("salary_mean_inr_month"))
    return rows.select("row_idx", subset.stratum_key(frozenset(rows.columns)).alias("stratum"))


@_register(f"""{_RAW} SELECT DISTINCT 'skill::' || substr(sha1(t), 1, 16) AS skill_id, t AS skill_text_normalized, 'P' || t[2:] AS skill_text_raw_example, 'P' || t[2:] AS label FROM i""")
def build_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.build(_raw_rows(spark, sf_dir)).skills.select("skill_id", "skill_text_normalized", "skill_text_raw_example", "label")


@_register("""WITH c AS (SELECT o_orderkey % 7 AS bad FROM orders) SELECT 'skills' AS name, ROUND(COUNT(*) FILTER (WHERE bad >= 4) / COUNT(*) FILTER (WHERE bad <> 0), 9) AS rate FROM c UNION ALL SELECT unnest(['company_name', 'job_id', 'job_title', 'posted_at']), 0.0""")
def feature_cell_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each column, the share of cells that look like lists of skill objects."""
    rows = stored(_raw_rows(spark, sf_dir).rows.select("job_id", "job_title", "company_name", "posted_at", "skills"), "rows")
    rates = tabular.cell_rates(rows, rows.columns, rows.count())
    return spark.createDataFrame([(c, round(r, 9)) for c, r in rates.items()], "name string, rate double")


def _made_file(spark: SparkSession, sf_dir: str, cells_name: str = "Skills") -> str:
    """The raw rows as delimited files, in order, under headers as users write them."""
    path = scratch_path(spark, "made")
    rows = _raw_rows(spark, sf_dir).rows.orderBy("row_idx").select(F.col("job_id").alias("Job ID"), F.col("job_title").alias("Job Title"), F.col("company_name").alias("Company"), F.col("posted_at").alias("Posted At"), F.col("skills").alias(cells_name))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@_register(f"""{_RAW}, e AS (SELECT job_id AS entity, t AS feature, MAX(CAST(ROUND(w, 6) AS DECIMAL(18,6))) AS weight FROM i GROUP BY 1, 2), p AS ({_PAIRS.format(e='e')}), x AS ({_topk_sql('e', 'shared_count', 5, 1, 'unweighted')} UNION ALL {_topk_sql('e', 'weighted_score', 5, 1, 'weighted')})
SELECT entity AS job_id, neighbor AS neighbor_job_id, similarity_score, rank, method FROM x""")
def pipeline_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over files that Spark has written: reading, parsing, deduplication, projection, ranks."""
    options = Options(top_k=5, threshold=1.0, max_feature_degree=None, max_pairs_per_feature=0, max_total_pairs=0, betweenness_limit=None, closeness_limit=None)
    return pipeline.run(spark, _made_file(spark, sf_dir), options).topk


def _subset_rows(spark: SparkSession, sf_dir: str) -> tabular.Canonical:
    """Orders as canonical rows with one or two skills, in strata of priority, status and price."""
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    cell = F.concat(F.lit('[{"skill":"Part '), key % 50, F.lit('"}'), F.when(key % 3 == 0, F.concat(F.lit(',{"skill":"Part '), key % 7 + 60, F.lit('."}'))).otherwise(""), F.lit("]"))
    columns = {"job_id": key.cast("string"), "job_title": F.lit("t"), "skills": cell, "assigned_occupation_group": F.col("o_orderpriority"), "district": F.col("o_orderstatus"), "salary_mean_inr_month": F.col("o_totalprice").cast("decimal(18,2)").cast("string")}
    return tabular.Canonical(_table(spark, sf_dir, "orders").select(key.alias("row_idx"), *[columns.get(c, none).alias(c) for c in sorted(ALIASES)]), frozenset(columns), ())


_SUBSET = """WITH s AS (SELECT o_orderkey AS row_idx, lower(o_orderpriority) || '||' || lower(o_orderstatus) || '||' || CASE WHEN o_totalprice < 10000 THEN 'lt_10k' WHEN o_totalprice < 20000 THEN '10k_20k' WHEN o_totalprice < 50000 THEN '20k_50k' ELSE 'ge_50k' END AS stratum,
CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey % 50, o_orderkey % 7 + 60] ELSE [o_orderkey % 50] END AS skills FROM orders),
f AS (SELECT skill, COUNT(*) AS n FROM (SELECT unnest(skills) AS skill FROM s) GROUP BY 1), l AS (SELECT LIST(n ORDER BY n) AS l, COUNT(*) AS c FROM f), k AS (SELECT GREATEST(1, l[GREATEST(1, CAST(FLOOR(c * 0.1) AS BIGINT))]) AS rare, GREATEST(1, l[GREATEST(1, CAST(FLOOR(c * 0.9) AS BIGINT))]) AS common FROM l),
m AS (SELECT row_idx, MAX(CAST(n <= rare AS INT)) AS rare, MAX(CAST(n >= common AS INT)) AS common FROM (SELECT row_idx, unnest(skills) AS skill FROM s) JOIN f USING (skill), k GROUP BY 1),
v AS (SELECT s.row_idx, stratum, CAST(('0x' || substr(sha1('42:' || s.row_idx), 1, 8)) AS UBIGINT)::DOUBLE / 4294967295 + CAST(0.3 AS DOUBLE) * rare + CAST(0.1 AS DOUBLE) * common + len(skills) / CAST(100 AS DOUBLE) AS score FROM s JOIN m USING (row_idx)),
n AS (SELECT stratum, COUNT(*) AS n FROM s GROUP BY 1), t AS (SELECT least(600, SUM(n)) AS target, SUM(n) AS total FROM n), x AS (SELECT stratum, n, n / total * CAST(target AS DOUBLE) AS exact, target FROM n, t), q AS (SELECT *, CAST(FLOOR(exact) AS BIGINT) AS q FROM x),
quota AS (SELECT stratum, n, q + CASE WHEN ROW_NUMBER() OVER (ORDER BY exact - q DESC, n DESC, stratum DESC) <= target - SUM(q) OVER () THEN 1 ELSE 0 END AS quota FROM q),
c AS (SELECT row_idx, stratum, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY score DESC, row_idx DESC) <= quota AS chosen, score FROM v JOIN quota USING (stratum)),
z AS (SELECT row_idx, stratum FROM c ORDER BY chosen DESC, score DESC, row_idx DESC LIMIT 600)"""


@_register(f"{_SUBSET} SELECT CAST(row_idx AS VARCHAR) AS job_id FROM z")
def stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.stratified_subset(_subset_rows(spark, sf_dir), 0, 42, 600)[0].select("job_id")


@_register(f"{_SUBSET} SELECT s.stratum, COUNT(*) AS total_rows, COUNT(z.row_idx) AS selected_rows FROM s LEFT JOIN z USING (row_idx) GROUP BY 1")
def subset_strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _subset_rows(spark, sf_dir)
    rows = source.rows.select("row_idx", subset.stratum_key(source.present).alias("stratum"))
    chosen = subset.stratified_subset(source, 0, 42, 600)[0].select("row_idx")
    return subset.strata_counts(rows, rows.join(chosen, "row_idx", "left_semi"))


@_register("""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, CASE WHEN o_orderkey % 3 <> 0 THEN 'j' || (o_orderkey // 4) END AS job_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority ELSE ' nan ' END AS job_title, CAST(o_custkey AS VARCHAR) AS company_name, CASE WHEN o_orderkey % 2 = 0 THEN '2025' END AS posted_at,
CASE o_orderkey % 7 WHEN 1 THEN '   ' WHEN 2 THEN 'order ' || o_orderkey WHEN 3 THEN '[1, ' || o_orderkey || ']' WHEN 4 THEN replace('[{"skill": "Part ' || (o_orderkey % 50) || '", "bucket": "Advanced"}]', '"', chr(39))
WHEN 5 THEN '[{"skill":"Part ' || (o_orderkey % 50) || '","bucket":"critical","mapping_similarity":0.5},{"skill":" part  ' || (o_orderkey % 50) || '.","mapping_similarity":0.25}]' WHEN 6 THEN '{"skill": "Part ' || (o_orderkey % 20) || '", "bucket": "proficient", "mapping_similarity": 1}' END AS skills FROM orders""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read back into canonical columns: headers by their aliases, the cell column by its content, rows numbered over all files."""
    path = _made_file(spark, sf_dir, "Importance (JSON)")
    source = tabular.canonical(tabular.read_csv(spark, path, tabular.sniff_encoding(spark, path)))
    return source.rows.select("row_idx", "job_id", "job_title", "company_name", "posted_at", "skills")


@_register("""SELECT o_orderkey AS row_id, 'Part "' || o_orderkey || '"' AS feature, 'it''s ' || (o_orderkey % 9) AS bucket, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0.25 END AS DOUBLE) AS similarity FROM orders""")
def parse_curly_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curly quotes are straightened and NULs dropped; similarities beyond any number are clipped."""
    key = F.col("o_orderkey")
    cell = F.concat(F.lit("[{“skill”: “Part \\”"), key, F.lit("\\””, “bucket”: “it’s "), key % 9, F.lit("”, “mapping_similarity”: "), F.when(key % 2 == 0, "Infinity").otherwise("0.25"), F.lit("\x00}]"))
    items = cells.items_of(cells.parse_cells(_dealt(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(key.alias("row_id"), cell.alias("skills"))), "row_id")
    return items.select("row_id", F.col("item.text").alias("feature"), F.col("item.bucket").alias("bucket"), text.clip_similarity(F.col("item.similarity")).alias("similarity"))


@_register("SELECT CAST(l_orderkey AS VARCHAR) AS entity, CAST(l_partkey AS VARCHAR) AS feature, MAX(l_quantity) AS weight, MIN(l_orderkey) AS row_idx FROM lineitem GROUP BY 1, 2")
def edge_stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that arrive in six files, two in a batch."""
    source, folder = scratch_path(spark, "arriving"), scratch_path(spark, "stream")
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("entity"), F.col("l_partkey").cast("string").alias("feature"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("row_idx"))
    items.repartition(6).write.parquet(source)
    increments.edge_stream(spark, source, items.schema, folder, max_files=2, parts=16).awaitTermination()
    return increments.current_edges(spark, folder)


def _customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node"), F.lit("job").alias("node_type"), F.col("c_name").alias("label"))


@_register("SELECT 'id' AS asked, CAST(c_custkey AS VARCHAR) AS node FROM customer WHERE c_custkey = 42 UNION ALL SELECT * FROM (SELECT 'label', CAST(c_custkey AS VARCHAR) AS node FROM customer WHERE lower(c_name) LIKE '%00007%' ORDER BY node LIMIT 20) UNION ALL SELECT * FROM (SELECT 'first', CAST(c_custkey AS VARCHAR) AS node FROM customer ORDER BY node LIMIT 20)")
def job_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id that is there, one that isn't (no rows, whatever the pattern), a pattern, and neither."""
    nodes = _customer_nodes(spark, sf_dir)
    asked = (("id", " 42 ", None), ("unknown", "nobody", "0"), ("label", " ", " 00007"), ("first", None, ""))
    found = [graph.matching(nodes, i, p, 20).select(F.lit(name).alias("asked"), "node") for name, i, p in asked]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@_register("""SELECT CAST(l_orderkey AS VARCHAR) AS source, 'p' || l_partkey AS target, 'requires_skill' AS relation, l_quantity AS weight, '{"skill_text_raw":"Part ' || l_partkey || '","skill_text_normalized":"part ' || l_partkey || '",' || CASE WHEN l_linenumber % 2 = 0 THEN '"bucket_raw":"' || l_returnflag || '",' ELSE '' END || '"bucket_normalized":"' || lower(l_returnflag) || '","bucket_score":' || CAST(l_linenumber AS INT) % 5 || ',"source_row_index":' || l_orderkey || '}' AS attributes_json FROM lineitem""")
def edges_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return export.edges_table(lines.select(
        F.col("l_orderkey").cast("string").alias("job_id"), F.concat(F.lit("p"), "l_partkey").alias("skill_id"), F.col("l_quantity").alias("edge_weight"), F.concat(F.lit("Part "), "l_partkey").alias("skill_text_raw"), F.concat(F.lit("part "), "l_partkey").alias("skill_text_normalized"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("bucket_raw"), F.lower("l_returnflag").alias("bucket_normalized"), (F.col("l_linenumber").cast("int") % 5).alias("bucket_score"), F.lit(float("nan")).alias("mapping_similarity"), F.col("l_orderkey").alias("source_row_index"),
    ))


@_register("""WITH n AS (SELECT CAST(c_custkey AS VARCHAR) AS node FROM customer), e AS (SELECT CAST(o_orderkey % 40 AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE CAST(o_orderkey % 9 AS DOUBLE) END AS weight FROM orders)
SELECT a, b, weight FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n) AND a <> b""")
def graph_from_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _customer_nodes(spark, sf_dir).withColumnRenamed("node", "node_id")
    key = F.col("o_orderkey")
    edges = _table(spark, sf_dir, "orders").select((key % 40).cast("string").alias("source"), F.col("o_custkey").cast("string").alias("target"), F.when(key % 3 == 0, "heavy").otherwise((key % 9).cast("string")).alias("weight"))
    return exports.graph_tables(nodes.unionByName(nodes), edges)[1]


@_register("SELECT 'Part ' || p_partkey AS query, CAST(p_partkey AS VARCHAR) AS skill_id, 'exact_normalized' AS match_type FROM part WHERE p_partkey IN (3, 5, 8)")
def resolve_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a query between commas that name a feature; one named twice counts once."""
    catalog = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("skill_id"), F.concat(F.lit("part "), "p_partkey").alias("skill_text_normalized"), F.concat(F.lit("Part "), "p_partkey").alias("label"))
    hits, _ = lookup.resolve_skills(cells.split_query("Part 3, Part 5;PART  5.,nothing\nPart 8,part 3"), catalog)
    return hits.select("query", "skill_id", "match_type")


@_register(f"""{_guard_sql("CASE WHEN degree < 2 THEN 'single' WHEN degree > 28 THEN 'degree' WHEN degree * (degree - 1) // 2 > 300 THEN 'pairs' ELSE 'used' END").replace("SELECT feature, degree, CAST(pairs", "SELECT CAST(COALESCE(SUM(degree) FILTER (WHERE verdict = 'degree'), 0) AS BIGINT) AS edges_skipped_by_degree, CAST(COALESCE(SUM(degree) FILTER (WHERE verdict = 'pairs'), 0) AS BIGINT) AS edges_skipped_by_pairs FROM j --")}""")
def projection_skipped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = projection.guarded(_supplier_edges(spark, sf_dir), max_degree=28, max_pairs=300, max_total=0)
    return projection.projection_stats(judged).select("edges_skipped_by_degree", "edges_skipped_by_pairs")


# --- the whole graph ---------------------------------------------------------

_ALL = "SELECT DISTINCT 'e' || l_orderkey AS a, 'f' || l_partkey AS b FROM lineitem"


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("b")).agg(F.max("l_quantity").alias("weight"))


@_register(f"""WITH RECURSIVE e AS ({_ALL}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), s AS (SELECT MIN(a) AS s FROM e), r(node) AS (SELECT s FROM s UNION SELECT u.b FROM r JOIN u ON u.a = r.node), n AS (SELECT DISTINCT a AS node FROM u)
SELECT (SELECT COUNT(*) FROM n) AS nodes, (SELECT COUNT(*) FROM r) AS in_first FROM s""")
def components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the graph of all lines: how many nodes, and how many in the component of the least one."""
    lines = _table(spark, sf_dir, "lineitem").where("l_orderkey is not null and l_partkey is not null")
    edges = lines.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))  # orders even, parts odd: numbers are shorter than names
    least = lines.agg(F.min(F.struct(F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("name"), (F.col("l_orderkey") * 2).alias("node")))).first()[0]
    members = stored(connected(edges), "members")
    first = members.where(F.col("node") == F.lit(least["node"])).first()["component"] if least else None
    return members.agg(F.count("*").alias("nodes"), F.count_if(F.col("component") == F.lit(first)).alias("in_first"))


@_register(f"""WITH e AS ({_ALL}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), s AS (SELECT MIN(a) AS n FROM e), h1 AS (SELECT DISTINCT b AS n FROM u JOIN s ON a = n), h2 AS (SELECT DISTINCT b AS n FROM u JOIN h1 ON a = n WHERE b NOT IN (SELECT n FROM s UNION SELECT n FROM h1))
SELECT n AS node, 0 AS hop FROM s UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2""")
def ego_network_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(_whole(spark, sf_dir), "edges")
    return graph.ego(edges, edges.agg(F.min("a")).first()[0], 2, 1_000_000).select("node", "hop")


@_register("SELECT 'e' || l_orderkey AS a, 'f' || l_partkey AS b, MAX(l_quantity) AS weight FROM lineitem GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 500")
def induced_subgraph_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(_whole(spark, sf_dir), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.induced(edges, nodes, 500)


@_register(f"""WITH e AS ({_ALL}), d AS (SELECT node, kind, COUNT(*) AS degree FROM (SELECT a AS node, 'job' AS kind FROM e UNION ALL SELECT b, 'skill' FROM e) GROUP BY 1, 2), z AS (SELECT kind, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM d GROUP BY 1),
q AS (SELECT kind, CAST(least(n, greatest(1, round(n * 1000 / total))) AS INT) AS quota FROM z), h AS (SELECT kind, quota, CAST(least(quota, greatest(1, round(quota * 0.35))) AS INT) AS high FROM q),
t AS (SELECT d.*, quota, high, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, node) <= high AS top FROM d JOIN h USING (kind)),
c AS (SELECT *, top OR row_number() OVER (PARTITION BY kind, top ORDER BY CAST(('0x' || substr(sha1('42:' || node), 1, 8)) AS UBIGINT)::DOUBLE / 4294967295, node) <= quota - high AS chosen FROM t)
SELECT node, kind AS node_type, degree FROM c ORDER BY chosen DESC, degree DESC, node LIMIT 1000""")
def stratified_node_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(_whole(spark, sf_dir), "edges")
    nodes = edges.select(F.col("a").alias("node")).distinct().withColumn("node_type", F.lit("job")).unionByName(edges.select(F.col("b").alias("node")).distinct().withColumn("node_type", F.lit("skill")))
    return graph.sample_nodes(nodes, edges, 1_000)


@_register("""WITH e AS (SELECT 'c' || o_custkey AS a, 'c' || (o_orderkey % 997) AS b, CAST(o_totalprice AS DECIMAL(18,2)) AS w FROM orders WHERE o_custkey <> o_orderkey % 997), x AS (SELECT a AS node, 0 AS i, w FROM e UNION ALL SELECT b, 1, w FROM e)
SELECT node, COUNT(*) AS degree, COUNT(*) FILTER (WHERE i = 1) AS in_degree, COUNT(*) FILTER (WHERE i = 0) AS out_degree, CAST(SUM(w) AS DOUBLE) AS strength, CAST(COALESCE(SUM(w) FILTER (WHERE i = 1), 0) AS DOUBLE) AS in_strength, CAST(COALESCE(SUM(w) FILTER (WHERE i = 0), 0) AS DOUBLE) AS out_strength FROM x GROUP BY 1""")
def directed_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and those that their orders' numbers point to: each end of an edge counts by its direction."""
    key = F.col("o_orderkey") % 997
    edges = _table(spark, sf_dir, "orders").where(F.col("o_custkey") != key).select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("c"), key).alias("b"), F.col("o_totalprice").cast("decimal(18,2)").alias("weight"))
    found = graph.degrees(edges, directed=True)
    return found.select("node", "degree", "in_degree", "out_degree", *[F.col(c).cast("double").alias(c) for c in ("strength", "in_strength", "out_strength")])


_ORDER_GRAPH = "n AS (SELECT 'o' || o_orderkey AS node, 'order' AS kind FROM orders UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer), e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b, o_totalprice AS w FROM orders)"
_NATION_GRAPH = "n AS (SELECT 'c' || c_custkey AS node, 'customer' AS kind FROM customer UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation), e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, c_acctbal AS w FROM customer)"


def _order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and their customers: a star for each customer."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    nodes = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.lit("order").alias("node_type"), F.lit("").alias("label")).unionByName(customers.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.lit("customer").alias("node_type"), F.col("c_name").alias("label")))
    return nodes, orders.select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"), F.col("o_totalprice").alias("weight"))


def _nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers, nations = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    nodes = customers.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.lit("customer").alias("node_type"), F.col("c_name").alias("label")).unionByName(nations.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("nation").alias("node_type"), F.col("n_name").alias("label")))
    return nodes, customers.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"), F.col("c_acctbal").alias("weight"))


def _overview_sql(made: str) -> str:
    return f"""WITH RECURSIVE {made}, u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, root) AS (SELECT node, node FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node), m AS (SELECT node, MIN(root) AS component FROM r GROUP BY 1), k AS (SELECT component, COUNT(*) AS size FROM m GROUP BY 1),
d AS (SELECT node, kind, COUNT(u.b) AS degree FROM n LEFT JOIN u ON u.a = n.node GROUP BY 1, 2), g AS (SELECT (SELECT COUNT(*) FROM n) AS n, (SELECT COUNT(*) FROM e) AS m), p AS (SELECT n > 8000 OR m > 60000 AS sampled FROM g),
z AS (SELECT kind, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM d GROUP BY 1), q AS (SELECT kind, CAST(least(n, greatest(1, round(n * 1000 / total))) AS INT) AS quota FROM z), h AS (SELECT kind, quota, CAST(least(quota, greatest(1, round(quota * 0.35))) AS INT) AS high FROM q),
t AS (SELECT d.*, quota, high, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, node) <= high AS top FROM d JOIN h USING (kind)),
c AS (SELECT *, top OR row_number() OVER (PARTITION BY kind, top ORDER BY CAST(('0x' || substr(sha1('42:' || node), 1, 8)) AS UBIGINT)::DOUBLE / 4294967295, node) <= quota - high AS chosen FROM t),
s AS (SELECT node FROM c ORDER BY chosen DESC, degree DESC, node LIMIT 1000), x AS (SELECT node, kind FROM n WHERE NOT (SELECT sampled FROM p) OR node IN (SELECT node FROM s)),
i AS (SELECT a, b FROM e WHERE a IN (SELECT node FROM x) AND b IN (SELECT node FROM x) ORDER BY w DESC, a, b LIMIT 300), w AS (SELECT MIN(degree) AS lo, (MAX(degree) - MIN(degree)) / 40 AS w FROM d),
o AS (SELECT x.node, COUNT(y.node) AS n FROM x LEFT JOIN (SELECT a AS node FROM i UNION ALL SELECT b FROM i) y ON y.node = x.node GROUP BY 1)
SELECT 'nodes' AS part, '' AS item, CAST(n AS BIGINT) AS n FROM g UNION ALL SELECT 'edges', '', m FROM g UNION ALL SELECT 'components', '', COUNT(*) FROM k UNION ALL SELECT 'sampled', '', CAST(sampled AS BIGINT) FROM p
UNION ALL SELECT 'clipped', '', greatest(0, (SELECT COUNT(*) FROM e WHERE a IN (SELECT node FROM x) AND b IN (SELECT node FROM x)) - 300) UNION ALL SELECT 'type', kind, COUNT(*) FROM d GROUP BY kind
UNION ALL SELECT 'bin', kind || ' ' || CAST(LEAST(40, FLOOR((degree - lo) / w) + 1) AS INT), COUNT(*) FROM d, w GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'component', component, size FROM k ORDER BY size DESC, component LIMIT 20) UNION ALL SELECT 'shown', node, n FROM o"""


def _overview(found: graph.Overview) -> DataFrame:
    one = found.types.sparkSession.createDataFrame([(k, "", v) for k, v in (("nodes", found.nodes), ("edges", found.edges), ("components", found.components), ("sampled", int(found.sampled)), ("clipped", found.clipped))], "part string, item string, n long")
    parts = [found.types.select(F.lit("type"), "node_type", "n"), found.histogram.select(F.lit("bin"), F.concat_ws(" ", "node_type", "bin"), "n"), found.largest.select(F.lit("component"), "component", "size"), found.shown.select(F.lit("shown"), "node", "rendered_degree")]
    for p in parts:
        one = one.union(p)
    return one


@_register(_overview_sql(_ORDER_GRAPH))
def graph_overview_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked for whole; beyond the limits (from sf0.01 on) it is a sample."""
    return _overview(graph.overview(*_order_graph(spark, sf_dir), whole=True, max_edges=300))


@_register(_overview_sql(_NATION_GRAPH))
def graph_overview_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(graph.overview(*_nation_graph(spark, sf_dir), whole=True, max_edges=300))


@_register(f"WITH {_ORDER_GRAPH}, d AS (SELECT c_custkey, 'c' || c_custkey AS node FROM customer), k AS (SELECT least(node, coalesce(MIN('o' || o_orderkey), node)) AS component, COUNT(o_orderkey) + 1 AS size FROM d LEFT JOIN orders ON o_custkey = c_custkey GROUP BY node) SELECT component, size, CAST(row_number() OVER (ORDER BY size DESC, component) AS INT) AS rank FROM k QUALIFY rank <= 50")
def component_sizes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _order_graph(spark, sf_dir)
    return graph.top_components(graph.component_sizes(edges, nodes), 50)


@_register("""WITH t AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY COUNT(*) DESC, least('c' || o_custkey, MIN('o' || o_orderkey)) LIMIT 1), n AS (SELECT 'c' || o_custkey AS node, COUNT(*) AS degree FROM orders JOIN t USING (o_custkey) GROUP BY 1 UNION ALL SELECT 'o' || o_orderkey, 1 FROM orders JOIN t USING (o_custkey)) SELECT node, degree FROM n ORDER BY degree DESC, node LIMIT 12""")
def component_clip_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _order_graph(spark, sf_dir)
    members = stored(connected(edges, nodes), "members")
    top = graph.top_components(members.groupBy("component").agg(F.count("*").alias("size")), 1).first()[0]
    return graph.component_part(edges, members, top, 12)


_HUBS = """WITH e AS (SELECT 'e' || l_orderkey AS a, 'f' || l_partkey AS b, MAX(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), c AS (SELECT b AS center FROM e GROUP BY b ORDER BY COUNT(*) DESC, b LIMIT 3),
p0 AS (SELECT center, center AS node, 0 AS hop, CAST(1 AS BIGINT) AS place FROM c),
n1 AS (SELECT center, u.b AS node, MIN(place) AS parent FROM p0 JOIN u ON u.a = p0.node GROUP BY 1, 2), p1 AS (SELECT center, node, 1 AS hop, 1 + row_number() OVER (PARTITION BY center ORDER BY parent, node) AS place FROM n1 QUALIFY place <= 150),
n2 AS (SELECT center, u.b AS node, MIN(place) AS parent FROM p1 JOIN u ON u.a = p1.node WHERE u.b <> center AND NOT EXISTS (SELECT 1 FROM p1 o WHERE o.center = p1.center AND o.node = u.b) GROUP BY 1, 2), h AS (SELECT center, 1 + COUNT(*) AS held FROM p1 GROUP BY 1),
p2 AS (SELECT center, node, 2 AS hop, held + row_number() OVER (PARTITION BY center ORDER BY parent, node) AS place FROM n2 JOIN h USING (center) QUALIFY place <= 150), s AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""


def _hub_networks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = stored(_whole(spark, sf_dir), "edges")
    nodes = edges.select(F.col("a").alias("node")).distinct().withColumn("node_type", F.lit("job")).unionByName(edges.select(F.col("b").alias("node")).distinct().withColumn("node_type", F.lit("skill"))).withColumn("label", F.upper("node"))
    centers = graph.hubs(edges, nodes, 3).select(F.col("node").alias("center"))
    return graph.hub_networks(edges, nodes, centers, 2, 150, 120)


@_register(f"{_HUBS} SELECT center, node, CASE WHEN node LIKE 'e%' THEN 'job' ELSE 'skill' END AS node_type, upper(node) AS label, hop, CAST(place AS INT) AS place FROM s")
def hub_network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hub_networks(spark, sf_dir)[0]


@_register(f"{_HUBS} SELECT s.center, a, b, weight FROM e JOIN s ON s.node = e.a JOIN s o ON o.center = s.center AND o.node = e.b QUALIFY row_number() OVER (PARTITION BY s.center ORDER BY weight DESC, a, b) <= 120")
def hub_network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hub_networks(spark, sf_dir)[1]


@_register("""WITH e AS (SELECT 'e' || l_orderkey AS a, 'f' || l_partkey AS b, MAX(l_quantity) AS w FROM lineitem GROUP BY 1, 2), d AS (SELECT node, COUNT(*) AS global_degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
n AS (SELECT node, global_degree FROM d QUALIFY row_number() OVER (PARTITION BY node[1] ORDER BY global_degree DESC, node) <= 400), l AS (SELECT e.* FROM e JOIN n x ON x.node = a JOIN n y ON y.node = b), k AS (SELECT * FROM l ORDER BY w DESC, a, b LIMIT 100),
c AS (SELECT node, SUM(x) AS local_degree, SUM(y) AS rendered_degree FROM (SELECT a AS node, 1 AS x, 0 AS y FROM l UNION ALL SELECT b, 1, 0 FROM l UNION ALL SELECT a, 0, 1 FROM k UNION ALL SELECT b, 0, 1 FROM k) GROUP BY 1)
SELECT node, global_degree, CAST(COALESCE(local_degree, 0) AS BIGINT) AS local_degree, CAST(COALESCE(rendered_degree, 0) AS BIGINT) AS rendered_degree, greatest(0, (SELECT COUNT(*) FROM l) - 100) AS clipped FROM n LEFT JOIN c USING (node)""")
def rendered_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees in the whole graph, among the busiest nodes of each kind, and in the heaviest edges among these."""
    edges = stored(_whole(spark, sf_dir), "edges")
    ranked = graph.degrees(edges).withColumn("kind", F.substring("node", 1, 1))
    best = Window.partitionBy("kind").orderBy(F.desc("degree"), "node")
    nodes = stored(ranked.withColumn("at", F.row_number().over(best)).where("at <= 400").select("node"), "busiest")
    table, _, clipped = graph.rendered(edges, nodes, 100)
    return table.select("node", "global_degree", "local_degree", "rendered_degree", F.lit(clipped).cast("long").alias("clipped"))


# --- quality, exports and summaries ---------------------------------------


def _broken_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their customers as edges, some without an end, some to nobody."""
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(F.when(key % 10 != 0, key.cast("string")).alias("source"), F.when(key % 7 == 0, "").when(key % 5 == 1, F.concat(F.lit("x"), "o_custkey")).otherwise(F.col("o_custkey").cast("string")).alias("target"))


@_register("SELECT COUNT(*) FILTER (WHERE o_orderkey % 10 = 0) AS null_source, COUNT(*) FILTER (WHERE o_orderkey % 7 = 0) AS null_target FROM orders")
def qa_null_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_endpoints(_broken_edges(spark, sf_dir))


@_register("""WITH n AS (SELECT CAST(o_orderkey AS VARCHAR) AS i FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer), e AS (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS s, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS t FROM orders)
SELECT 'source' AS endpoint, COUNT(*) AS orphans FROM e WHERE s IS NOT NULL AND s NOT IN (SELECT i FROM n) UNION ALL SELECT 'target', COUNT(*) FROM e WHERE t NOT IN (SELECT i FROM n)""")
def qa_orphan_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    nodes = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("node_id")).union(customers.select(F.col("c_custkey").cast("string"))).distinct()
    return quality.orphan_endpoints(_broken_edges(spark, sf_dir), nodes)


@_register("SELECT CAST(l_orderkey AS VARCHAR) AS job_id, MIN(l_linenumber) AS least, MAX(l_linenumber) AS most, COUNT(*) AS n, COUNT(DISTINCT l_linenumber) AS n_distinct FROM lineitem GROUP BY 1 HAVING MIN(l_linenumber) <> 1 OR MAX(l_linenumber) <> COUNT(*) OR COUNT(DISTINCT l_linenumber) <> COUNT(*)")
def qa_rank_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.broken_ranks(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"), F.col("l_linenumber").alias("rank")), ("job_id",))


@_register(f"{_WITH} SELECT COUNT(DISTINCT entity) AS entities, COUNT(DISTINCT feature) AS features, COUNT(*) AS edges, ROUND(COUNT(*) / (COUNT(DISTINCT entity) * COUNT(DISTINCT feature)), 8) AS density FROM e")
def graph_summary_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = entities.graph_size(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return counts.withColumn("density", F.round(F.col("edges") / (F.col("entities") * F.col("features")), 8))


def _typed_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return edges.groupBy("entity").agg(F.count("*").alias("degree")).select(F.lit("job").alias("node_type"), "degree").unionByName(edges.groupBy("feature").agg(F.count("*").alias("degree")).select(F.lit("skill").alias("node_type"), "degree"))


_DEGREES = f"{_WITH}, d AS (SELECT 'job' AS node_type, COUNT(*) AS degree FROM e GROUP BY entity UNION ALL SELECT 'skill', COUNT(*) FROM e GROUP BY feature)"


@_register(f"{_DEGREES} SELECT node_type, COUNT(*) AS n FROM d GROUP BY 1")
def node_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed_degrees(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"))


@_register(f"{_DEGREES}, r AS (SELECT MIN(degree) AS lo, (MAX(degree) - MIN(degree)) / 40 AS w FROM d) SELECT node_type, CAST(LEAST(40, FLOOR((degree - lo) / w) + 1) AS INT) AS bin, COUNT(*) AS n FROM d, r GROUP BY 1, 2")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_histogram(stored(_typed_degrees(spark, sf_dir), "degrees"))


@_register("""SELECT 'p' || p_partkey AS node_id, 'skill' AS node_type, p_name AS label, '{"skill_text_normalized":"' || lower(p_name) || '","skill_text_raw_example":"' || p_name || '"}' AS attributes_json FROM part
UNION ALL SELECT 'c' || c_custkey, 'job', c_name, '{"company_name":"' || c_mktsegment || '"}' FROM customer""")
def nodes_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    jobs = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("job_id"), F.col("c_name").alias("job_title"), F.col("c_mktsegment").alias("company_name"), *[none.alias(c) for c in export.JOB_ATTRIBUTES if c != "company_name"])
    skills = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("skill_id"), F.col("p_name").alias("label"), F.lower("p_name").alias("skill_text_normalized"), F.col("p_name").alias("skill_text_raw_example"))
    return export.nodes_table(jobs, skills)


@_register("SELECT event_id, user_id FROM events WHERE event_type = (SELECT MIN(event_type) FROM events) ORDER BY event_id LIMIT 1")
def job_queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    kind = rows.agg(F.min("event_type")).first()[0]
    return events.oldest(rows, F.col("event_type") == kind, "event_id", "event_id", "user_id")


@_register("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.latest(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 200)


@_register("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.current(_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@_register("SELECT 'skill' AS kind, 'p' || p_partkey AS id, p_name AS label, lower(p_name) AS normalized FROM part UNION ALL SELECT 'job', 'c' || c_custkey, c_name, lower(c_name) FROM customer")
def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table written as delimited files and read back as the two catalogs."""
    path = scratch_path(spark, "nodes")
    exports.write_csv(nodes_export(spark, sf_dir), path)
    read = exports.read_table(spark, path, ("node_id", "node_type", "label", "attributes_json"))
    skills = exports.skills_catalog(read).select(F.lit("skill").alias("kind"), F.col("skill_id").alias("id"), "label", F.col("skill_text_normalized").alias("normalized"))
    return skills.unionByName(exports.jobs_catalog(read).select(F.lit("job").alias("kind"), F.col("job_id").alias("id"), F.col("job_title").alias("label"), F.col("job_title_norm").alias("normalized")))


@_register("""WITH n AS (SELECT CAST(o_orderkey AS VARCHAR) AS i FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer), e AS (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS s, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS t FROM orders),
c AS (SELECT COUNT(*) FILTER (WHERE s IS NULL) AS ns, COUNT(*) FILTER (WHERE t = '') AS nt, COUNT(*) FILTER (WHERE s IS NOT NULL AND s NOT IN (SELECT i FROM n)) AS os, COUNT(*) FILTER (WHERE t NOT IN (SELECT i FROM n)) AS ot FROM e),
b AS (SELECT COUNT(*) AS b FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING MIN(l_linenumber) <> 1 OR MAX(l_linenumber) <> COUNT(*) OR COUNT(DISTINCT l_linenumber) <> COUNT(*)))
SELECT 'no_null_endpoints' AS name, ns + nt = 0 AS passed, 'null sources ' || ns || ', null targets ' || nt AS message FROM c UNION ALL SELECT 'edge_nodes_exist', os + ot = 0, 'unknown sources ' || os || ', unknown targets ' || ot FROM c UNION ALL SELECT 'topk_rank_continuity', b = 0, 'groups with broken ranks ' || b FROM b
UNION ALL SELECT 'all', ns + nt + os + ot + b = 0, '' FROM c, b""")
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three checks, of faulty edges and of ranks, and whether all passed."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    nodes = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("node_id")).union(customers.select(F.col("c_custkey").cast("string"))).distinct()
    ranks = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"), F.lit("m").alias("method"), F.col("l_linenumber").alias("rank"))
    found = quality.report(nodes, _broken_edges(spark, sf_dir), ranks)
    return spark.createDataFrame([*((k, c["passed"], c["message"]) for k, c in found["checks"].items()), ("all", found["all_passed"], "")], "name string, passed boolean, message string")


@_register("""WITH s AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1), f AS (SELECT 'node_columns' AS name, 'missing: []' AS details UNION ALL SELECT 'edge_columns', 'missing: []' UNION ALL SELECT 'null_node_ids', '0 nodes' UNION ALL SELECT 'null_endpoints', '0 ends' UNION ALL SELECT 'endpoint_membership', '0 ends')
SELECT * FROM f UNION ALL SELECT 'ego_network', '2 nodes' UNION ALL SELECT 'components', 'largest has ' || (MAX(n) + 1) || ' nodes' FROM s UNION ALL SELECT 'global_sample', least(100, (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM customer)) || ' nodes'""")
def graph_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight checks that passed, of orders and customers. The least end is an order, which has one neighbour."""
    nodes, edges = _order_graph(spark, sf_dir)
    found = quality.diagnostics(nodes.withColumnRenamed("node", "node_id"), edges.withColumnsRenamed({"a": "source", "b": "target"}))
    return spark.createDataFrame([(c["check"], c["details"]) for c in found if c["status"] == "ok"], "name string, details string")


@_register(f"""WITH {_NATION_GRAPH}, k AS (SELECT b, COUNT(*) AS n FROM e GROUP BY 1 ORDER BY n DESC LIMIT 1)
SELECT 'betweenness' AS measure, 'guarded_by_size(v=' || (SELECT COUNT(*) FROM n) || ',e=' || (SELECT COUNT(*) FROM e) || ',v_limit=9,e_limit=1000000)' AS reason UNION ALL SELECT 'closeness', 'guarded_by_size(giant_v=' || (n + 1) || ',giant_e=' || n || ',v_limit=1000000,e_limit=3)' FROM k UNION ALL SELECT 'off', 'disabled_by_config'""")
def centrality_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why measures are left out: the whole graph has too many vertices, its largest component too many edges, or nobody wants them."""
    nodes, edges = _nation_graph(spark, sf_dir)
    notes = paths.centrality(edges, nodes.select("node"), (9, 1_000_000), (1_000_000, 3))[1] | {"off": paths.guard(0, 0, None)}
    return spark.createDataFrame(list(notes.items()), "measure string, reason string")


@_register("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def entity_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.point(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 42)


@_register("SELECT user_id, CAST(SUM(length(props)) AS BIGINT) AS size FROM events GROUP BY 1")
def bytes_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.totals(_table(spark, sf_dir, "events").select("user_id", F.length("props").cast("long").alias("size")), "user_id", "size")
