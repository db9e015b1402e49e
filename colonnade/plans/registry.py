"""All queries of the engine's own operators, with their SQL. Every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import convert, storage, types
from colonnade import schema as schemas
from colonnade.functions import csvtext, values
from colonnade.operators import batch, stats
from colonnade.sources import csv_io, rowgroup_file, store

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The columns of each table that have a counterpart among the engine's types, with how they are cast (Spark, DuckDB).
SECOND = ("CAST(date_trunc('second', {c}) AS TIMESTAMP_NTZ)", "date_trunc('second', {c})")
COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "props"),
}
TIMES = {"o_orderdate", "l_shipdate", "ts"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's columns of the engine's types, timestamps cut to seconds."""
    rows = table(spark, sf_dir, name)
    return rows.select(*(F.expr(SECOND[0].format(c=c)).alias(c) if c in TIMES else F.col(c) for c in COLUMNS[name]))


def typed_sql(name: str) -> str:
    return ", ".join(f"{SECOND[1].format(c=c)} AS {c}" if c in TIMES else c for c in COLUMNS[name])


FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        FOUND[name], SQL[name] = f, sql
        return f

    return keep


# Scans of whole tables.
for _t in TABLES:
    query(f"scan_{_t}", f"SELECT * FROM {_t}")(lambda s, d, t=_t: table(s, d, t))

# CSV, stores and row-group files: written and read again.
for _t in ("region", "nation", "customer", "supplier", "part"):
    query(f"csv_roundtrip_{_t}", f"SELECT {typed_sql(_t)} FROM {_t}")(lambda s, d, t=_t: csv_io.roundtrip(typed(s, d, t), t))
for _t in ("orders", "lineitem", "events"):
    query(f"csv_roundtrip_{_t}", f"SELECT {typed_sql(_t)} FROM {_t}")(lambda s, d, t=_t: csv_io.roundtrip(typed(s, d, t), t))
for _t in ("lineitem", "documents"):
    query(f"store_roundtrip_{_t}", f"SELECT * FROM {_t}")(lambda s, d, t=_t: store.roundtrip(table(s, d, t), t, store.GROUP_ROWS))
for _t in ("nation", "orders", "events"):
    query(f"iyx_roundtrip_{_t}", f"SELECT {typed_sql(_t)} FROM {_t}")(lambda s, d, t=_t: rowgroup_file.roundtrip(typed(s, d, t), t))


@query("csv_roundtrip_temporal", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, date_trunc('second', o_orderdate) AS second FROM orders")
def csv_roundtrip_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.expr(SECOND[0].format(c="o_orderdate"))
    return csv_io.roundtrip(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), second.alias("second")), "temporal")


@query("csv_roundtrip_delimiter", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), storage.fresh_path(spark, "delimiter")
    csv_io.write(rows, path, delimiter="|", quote="'")
    return csv_io.read(spark, path, rows.schema, delimiter="|", quote="'")


@query("csv_raw_times", "SELECT CAST(o_orderkey AS VARCHAR) || ',' || CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS VARCHAR) || ',' || CAST(CAST(floor(epoch(o_orderdate)) AS BIGINT) AS VARCHAR) AS value FROM orders")
def csv_raw_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderdate")
    return csv_io.to_lines(rows, raw_times=True)


def in_key_order(rows: DataFrame) -> DataFrame:
    """orders in the order of its keys, which count from 0, in several tasks whose rows make whole groups of 2048."""
    return rows.repartitionByRange(F.floor(F.col("o_orderkey") / (4 * store.GROUP_ROWS))).sortWithinPartitions("o_orderkey")


def ordered_store(spark: SparkSession, sf_dir: str) -> str:
    """orders in files of key ranges, in groups of 2048 rows."""
    path = storage.fresh_path(spark, "groups")
    store.write(in_key_order(table(spark, sf_dir, "orders")), path, store.GROUP_ROWS)
    return path


@query("row_group_directory", "SELECT CAST(i AS INTEGER) AS group_no, 2048 * i AS row_offset, least(2048, n - 2048 * i) AS row_count FROM (SELECT n, unnest(range(0, CAST(ceil(n / 2048.0) AS BIGINT))) AS i FROM (SELECT count(*) AS n FROM orders))")
def row_group_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.numbered_directory(spark, ordered_store(spark, sf_dir)).select("group_no", "row_offset", "row_count")


@query("row_group_totals", "SELECT CAST(ceil(count(*) / 2048.0) AS BIGINT) AS n_groups, count(*) AS n_rows FROM orders")
def row_group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.totals(spark, ordered_store(spark, sf_dir))


@query("row_group_read", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 2048 OFFSET 0")
def row_group_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_groups(spark, ordered_store(spark, sf_dir), [0], ["o_orderkey", "o_custkey", "o_totalprice"])


@query("iyx_group_read", f"SELECT {typed_sql('orders')} FROM orders ORDER BY o_orderkey LIMIT 2048 OFFSET 0")
def iyx_group_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.fresh_path(spark, "numbered")
    rowgroup_file.write(in_key_order(typed(spark, sf_dir, "orders")), path)
    return rowgroup_file.read(spark, path, [0])


@query("iyx_pushdown", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2 AND n_name <> 'CHINA'")
def iyx_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowgroup_file.roundtrip(typed(spark, sf_dir, "nation"), "pushdown").where("n_regionkey >= 2 and n_name != 'CHINA'").select("n_nationkey", "n_name")


@query("iyx_columns", "SELECT o_orderpriority, o_orderkey FROM orders WHERE o_custkey < 500")
def iyx_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns decoded of five, one of them for the comparison alone."""
    path = storage.fresh_path(spark, "pruned")
    rowgroup_file.write(typed(spark, sf_dir, "orders"), path)
    return rowgroup_file.read(spark, path, columns=["o_orderpriority", "o_orderkey", "o_custkey"]).where("o_custkey < 500").select("o_orderpriority", "o_orderkey")


@query("iyx_counts", "SELECT count(*) AS n_rows FROM lineitem")
def iyx_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer says that it has written."""
    made = rowgroup_file.write(typed(spark, sf_dir, "lineitem"), storage.fresh_path(spark, "counted"))
    return spark.createDataFrame([(made.rows,)], "n_rows bigint")


# Conversions.
def _as_csv(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder with the table as data and schema.csv."""
    path = storage.fresh_path(spark, f"{name}-csv")
    csv_io.write(typed(spark, sf_dir, name), f"{path}/data")
    schemas.save(spark, typed(spark, sf_dir, name).schema, f"{path}/schema.csv")
    return path


for _t, _suffix in (("orders", ".iyx"), ("part", ".iyx"), ("orders", ""), ("part", "")):

    @query(f"convert_import_{_t}" + ("_store" if not _suffix else ""), f"SELECT {typed_sql(_t)} FROM {_t}")
    def convert_import(spark: SparkSession, sf_dir: str, t: str = _t, suffix: str = _suffix) -> DataFrame:
        path = _as_csv(spark, sf_dir, t)
        convert.import_csv(spark, f"{path}/schema.csv", f"{path}/data", f"{path}/table{suffix}")
        return convert.open_table(spark, f"{path}/table{suffix}")

    @query(f"convert_export_{_t}" + ("_store" if not _suffix else ""), f"SELECT {typed_sql(_t)} FROM {_t}")
    def convert_export(spark: SparkSession, sf_dir: str, t: str = _t, suffix: str = _suffix) -> DataFrame:
        path = storage.fresh_path(spark, f"{t}-out")
        (rowgroup_file if suffix else store).write(typed(spark, sf_dir, t), f"{path}/table{suffix}")
        convert.export_csv(spark, f"{path}/table{suffix}", f"{path}/data", f"{path}/schema.csv")
        return csv_io.read(spark, f"{path}/data", schemas.load(spark, f"{path}/schema.csv"))


@query("convert_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS imported, count(*) AS exported FROM {t}" for t in ("nation", "customer", "lineitem")))
def convert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that both converters count as they write them."""
    rows = []
    for t in ("nation", "customer", "lineitem"):
        path = _as_csv(spark, sf_dir, t)
        n = convert.import_csv(spark, f"{path}/schema.csv", f"{path}/data", f"{path}/table")
        rows.append((t, n, convert.export_csv(spark, f"{path}/table", f"{path}/again", f"{path}/again.csv")))
    return spark.createDataFrame(rows, "name string, imported bigint, exported bigint")


@query("reader_counts", "SELECT 'orders' AS name, count(*) AS n_rows, 5 AS n_columns FROM orders")
def reader_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a CSV reader has read: rows seen by the action itself, and the schema's columns."""
    path = _as_csv(spark, sf_dir, "orders")
    rows, seen = batch.counted(csv_io.read(spark, f"{path}/data", schemas.load(spark, f"{path}/schema.csv")))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("orders", seen.get["rows"], schemas.count(rows.schema))], "name string, n_rows bigint, n_columns int")


# CSV text.
ESCAPED = "CASE WHEN regexp_matches({c}, '[,\"\n\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query("csv_needs_quotes", "SELECT doc_id, regexp_matches(text, '[,\"\n\r]') AS quoted FROM documents")
def csv_needs_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", csvtext.needs_quotes(F.col("text")).alias("quoted"))


@query("csv_escape", f"SELECT doc_id, {ESCAPED.format(c='text')} AS field FROM documents")
def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", csvtext.escape(F.col("text")).alias("field"))


@query("csv_join", f"SELECT page_id, {ESCAPED.format(c='url')} || ',' || {ESCAPED.format(c='html')} AS line FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def csv_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("url is not null and html is not null").select("page_id", csvtext.join([F.col("url"), F.col("html")]).alias("line"))


@query("csv_split", "SELECT conv_id, turn, role, text FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL")
def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role is not null and text is not null")
    cut = rows.select("conv_id", "turn", csvtext.split(csvtext.join([F.col("role"), F.col("text")])).alias("f"))
    return cut.select("conv_id", "turn", F.col("f")[0].alias("role"), F.col("f")[1].alias("text"))


# Text to values and back.
def _parsed(name: str, column: str, kind: str, sql_type: str, source: str) -> None:
    @query(f"parse_{kind}", f"SELECT {name} AS k, CAST({column} AS {sql_type}) AS v FROM {source}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.concat(F.lit(" \t"), F.col(column).cast("string"), F.lit("\r "))
        return table(spark, sf_dir, source).select(F.col(name).alias("k"), values.parse(text, kind).alias("v"))


for _k, _c, _kind, _type, _source in (("p_partkey", "p_size", "int16", "SMALLINT", "part"), ("p_partkey", "p_size", "int32", "INTEGER", "part"), ("l_orderkey", "l_partkey", "int64", "BIGINT", "lineitem"), ("l_orderkey", "l_suppkey", "int128", "DECIMAL(38,0)", "lineitem")):
    _parsed(_k, _c, _kind, _type, _source)


@query("parse_bool", "SELECT p_partkey AS k, p_size > 25 AS v FROM part")
def parse_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") > 25, " TRUE\t").otherwise("False")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), values.parse(text, "bool").alias("v"))


@query("parse_string", "SELECT doc_id AS k, text AS v FROM documents")
def parse_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), values.parse(F.col("text"), "string").alias("v"))


@query("parse_date", "SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS v FROM lineitem")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = values.to_text(F.col("l_shipdate").cast("date"), "date")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), values.parse(F.concat(F.lit(" "), text), "date").alias("v"))


@query("parse_timestamp", "SELECT event_id AS k, date_trunc('second', ts) AS v FROM events")
def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), values.parse(values.to_text(F.col("ts"), "timestamp"), "timestamp").alias("v"))


@query("format_date", "SELECT l_orderkey AS k, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS v FROM lineitem")
def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), values.date_text(values.days(F.col("l_shipdate").cast("date"))).alias("v"))


@query("format_timestamp", "SELECT event_id AS k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS v FROM events")
def format_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), values.timestamp_text(values.seconds(F.col("ts"))).alias("v"))


@query("value_to_text", "SELECT CAST(CAST(p_size AS SMALLINT) AS VARCHAR) AS a, CAST(p_size AS VARCHAR) AS b, CAST(p_partkey AS VARCHAR) AS c, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS d, p_name AS e FROM part")
def value_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("smallint").alias("a"), F.col("p_size").alias("b"), F.col("p_partkey").alias("c"), (F.col("p_size") > 25).alias("d"), F.col("p_name").alias("e"))
    return rows.select(*(values.to_text(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema))


@query("strip", "SELECT doc_id, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS v FROM documents")
def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", values.strip(F.col("text")).alias("v"))


@query("lower", "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS v FROM documents")
def lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", values.lower(F.col("text")).alias("v"))


# Schemas, by way of their side files.
def _described(name: str) -> list[tuple[int, str, str]]:
    kinds = {"p_size": "int32", "n_nationkey": "int32", "n_regionkey": "int32", "c_nationkey": "int32", "s_nationkey": "int32", "r_regionkey": "int32", "l_linenumber": "int32"}
    longs = {"c_custkey", "s_suppkey", "p_partkey", "o_orderkey", "o_custkey", "l_orderkey", "l_partkey", "l_suppkey", "event_id", "user_id"}
    return [(i, c, "timestamp" if c in TIMES else "int64" if c in longs else kinds.get(c, "string")) for i, c in enumerate(COLUMNS[name])]


for _t in COLUMNS:

    @query(f"schema_table_{_t}", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{k}')" for i, c, k in _described(_t)) + ") AS t(position, name, type)")
    def schema_table(spark: SparkSession, sf_dir: str, t: str = _t) -> DataFrame:
        path = storage.fresh_path(spark, "schema.csv")
        schemas.save(spark, typed(spark, sf_dir, t).schema, path)
        return schemas.table(spark, schemas.load(spark, path))


@query("schema_find", "SELECT * FROM (VALUES ('o_custkey', 1), ('O_CUSTKEY', NULL), ('missing', NULL), ('o_orderkey', 0)) AS t(name, position)")
def schema_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = typed(spark, sf_dir, "orders").schema
    return spark.createDataFrame([(n, schemas.find(schema, n)) for n in ("o_custkey", "O_CUSTKEY", "missing", "o_orderkey")], "name string, position int")


def _schemas(spark: SparkSession, sf_dir: str) -> list[tuple[str, T.StructType]]:
    nation = typed(spark, sf_dir, "nation").schema
    twice = T.StructType([*nation.fields, nation.fields[0]])
    return [("nation", nation), ("again", schemas.make(*((f.name, types.of_spark(f.dataType).name) for f in nation))), ("reversed", T.StructType(nation.fields[::-1])), ("empty", T.StructType()), ("twice", twice)]


@query("schema_same", "SELECT a, b, a = b OR (a IN ('nation', 'again') AND b IN ('nation', 'again')) AS same FROM (VALUES ('nation'), ('again'), ('reversed'), ('empty'), ('twice')) AS x(a), (VALUES ('nation'), ('again'), ('reversed'), ('empty'), ('twice')) AS y(b)")
def schema_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _schemas(spark, sf_dir)
    return spark.createDataFrame([(a, b, schemas.same(x, y)) for a, x in known for b, y in known], "a string, b string, same boolean")


@query("schema_valid", "SELECT * FROM (VALUES ('nation', 3, true, 'n_nationkey'), ('again', 3, true, 'n_nationkey'), ('reversed', 3, true, 'n_regionkey'), ('empty', 0, false, NULL), ('twice', 4, false, 'n_nationkey')) AS t(name, n_columns, valid, first_column)")
def schema_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, schemas.count(x), schemas.valid(x), schemas.at(x, 0).name if schemas.count(x) else None) for n, x in _schemas(spark, sf_dir)]
    return spark.createDataFrame(rows, "name string, n_columns int, valid boolean, first_column string")


@query("type_table", "SELECT * FROM (VALUES " + ", ".join(f"({t.tag}, '{t.name}', {t.size}, {t.fixed})" for t in types.TYPES) + ") AS t(tag, name, size, fixed)")
def type_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t.tag, types.name_of(t.tag), types.by_name(t.name).size, t.fixed) for t in types.TYPES], "tag int, name string, size int, fixed boolean")


# Tables.
@query("select_by_name", "SELECT l_partkey FROM lineitem")
def select_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.column_named(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("select_by_index", "SELECT l_suppkey FROM lineitem")
def select_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.column_at(table(spark, sf_dir, "lineitem"), 2)


@query("append_row", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, ' NOWHERE ', -1")
def append_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.append_row(typed(spark, sf_dir, "nation"), [" 99 ", " NOWHERE ", "-1"])


@query("empty_batch", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE false")
def empty_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.empty(spark, typed(spark, sf_dir, "nation").schema)


@query("clear_batch", "SELECT * FROM lineitem WHERE false")
def clear_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.clear(table(spark, sf_dir, "lineitem"))


@query("from_columns", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS t(id, name)")
def from_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.from_columns(spark, {"id": [1, 2, 3], "name": ["a", "b", "c"]}, schemas.make(("id", "int32"), ("name", "string")))


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionAll, [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES])


@query("batch_state", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) = 0 AS empty, count(*) >= 2048 AS is_full FROM {t}" for t in ("region", "orders", "lineitem")) + " UNION ALL SELECT 'cleared', true, false")
def batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {t: table(spark, sf_dir, t) for t in ("region", "orders", "lineitem")}
    known["cleared"] = batch.clear(known["region"])
    return spark.createDataFrame([(t, df.isEmpty(), batch.is_full(df, store.GROUP_ROWS)) for t, df in known.items()], "name string, empty boolean, is_full boolean")


@query("from_uneven_columns", "SELECT 'columns of different lengths' AS error")
def from_uneven_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        batch.from_columns(spark, {"id": [1, 2], "name": ["a"]})
        error = None
    except ValueError as e:
        error = str(e).split(":")[0]
    return spark.createDataFrame([(error,)], "error string")


@query("numeric_product", "SELECT list_reduce(list(x), lambda a, b: (a * b) % 1000000007) AS product FROM (SELECT unnest([o_orderkey + 1, o_custkey + 1]) % 1000000007 AS x FROM orders)")
def numeric_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("a"), (F.col("o_custkey") + 1).alias("b"), "o_orderstatus")
    return batch.numeric_product(rows)


# Statistics.
def stats_sql(name: str) -> str:
    out = []
    for _, c, kind in _described(name):
        value = f"date_trunc('second', {c})" if kind == "timestamp" else c
        text = (lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S')") if kind == "timestamp" else (lambda x: f"CAST({x} AS VARCHAR)")  # noqa: B023
        size = "octet_length(encode({c}))".format(c=c) if kind == "string" else "NULL"
        out.append(f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, {text(f'min({value})')} AS min_value, {text(f'max({value})')} AS max_value, CAST(min({size}) AS BIGINT) AS min_length, CAST(max({size}) AS BIGINT) AS max_length, CAST(sum({size}) AS BIGINT) AS total_length, count(DISTINCT {value}) AS unique_count FROM {name}")
    return " UNION ALL ".join(out)


for _t in COLUMNS:
    query(f"stats_{_t}", stats_sql(_t))(lambda s, d, t=_t: stats.column_stats(typed(s, d, t)))

@query("stats_typed", "SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS row_count, count(*) - count(o_orderkey) AS null_count, false AS may_be_less, true AS may_be_equal FROM orders")
def stats_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.TypedStatistics.of(typed(spark, sf_dir, "orders"), "o_orderkey")
    row = (found.min_value, found.max_value, found.row_count, found.null_count, found.may_hold("lt", found.min_value), found.may_hold("eq", found.max_value))
    return spark.createDataFrame([row], "low bigint, high bigint, row_count bigint, null_count bigint, may_be_less boolean, may_be_equal boolean")


# Comparisons, which reach the scan.
for _op, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(f"pred_{_op}", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey {_sign} 100")(lambda s, d, op=_op: batch.compare(table(s, d, "lineitem"), "l_partkey", op, 100).select("l_orderkey", "l_linenumber", "l_partkey"))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
