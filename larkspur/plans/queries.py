"""Driver queries over the test tables, each beside the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.expr import js_string, parse_float, type_of
from larkspur.operators.encoders import LabelEncoder, MinMaxScaler, OneHotEncoder, Pipeline, StandardScaler, StringIndexer
from larkspur.operators.frame import Frame
from larkspur.session import fresh_dir
from larkspur.sources.readers import ingest, json_to_ndjson, read, read_csv, read_json, read_ndjson, scan_ndjson
from larkspur.sources.writers import fixed4_line, report_lines, to_csv, to_json, to_ndjson
from larkspur.streaming.batches import stream_batches

KEYS = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "orders": ["o_orderkey"], "customer": ["c_custkey"],
    "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "events": ["event_id"],
    "documents": ["doc_id"], "labels": ["doc_id"], "pages": ["page_id"], "embeddings": ["vec_id"], "conversations": ["conv_id", "turn"],
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name])


def r6(name) -> F.Column:
    return F.round(name, 6)


MONEY = "decimal(18,2)"

# -- projection and filters ------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem WHERE l_quantity > 25 AND l_discount > 0")
def filter_predicate(spark, d):
    f = table(spark, d, "lineitem").filter("l_quantity > 25 AND l_discount > 0", inputs=["l_quantity", "l_discount"])
    return f.select(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"]).data


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE floor(o_totalprice) % 7 = 3")
def filter_callable(spark, d):
    f = table(spark, d, "orders").filter(lambda p: int(p) % 7 == 3, inputs=["o_totalprice"])
    return f.select(["o_orderkey", "o_totalprice"]).data


def _derived(name, formula, inputs):
    def run(spark, d):
        f = table(spark, d, "lineitem").with_columns([{"name": "x", "inputs": inputs, "formula": formula}])
        return f.select([*KEYS["lineitem"], "x"]).data

    run.__name__ = name
    query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({formula})::DOUBLE AS x FROM lineitem")(run)


_derived("with_columns_1_input", "l_quantity * 2", ["l_quantity"])
_derived("with_columns_2_inputs", "l_extendedprice * (1 - l_discount)", ["l_extendedprice", "l_discount"])
_derived("with_columns_4_inputs", "l_extendedprice * (1 - l_discount) * (1 + l_tax) / (l_quantity + 1)", ["l_extendedprice", "l_discount", "l_tax", "l_quantity"])
_derived("with_columns_5_inputs", "l_quantity + l_extendedprice + l_discount + l_tax + l_linenumber", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
_derived("with_columns_boolean", "l_quantity > 25", ["l_quantity"])


@query("SELECT o_orderkey, round(o_totalprice * 0.5, 6) AS half FROM orders")
def with_columns_callable(spark, d):
    f = table(spark, d, "orders").with_columns([{"name": "half", "inputs": ["o_totalprice"], "formula": lambda p: p * 0.5}])
    return f.select(["o_orderkey", "half"]).data.withColumn("half", r6("half"))


@query("SELECT p_partkey, p_brand, p_size FROM part")
def select_cols(spark, d):
    return table(spark, d, "part").select(["p_partkey", "p_brand", "p_size"]).data


@query("SELECT p_partkey AS id, p_name, p_brand AS maker, p_type, p_size, p_retailprice FROM part")
def rename_cols(spark, d):
    return table(spark, d, "part").rename({"p_partkey": "id", "p_brand": "maker"}).data


@query(r"SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(p_brand, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1), '') AS DOUBLE), 0.0) AS p_brand, p_size::DOUBLE AS p_size FROM part")
def cast_float(spark, d):
    return table(spark, d, "part").select(["p_partkey", "p_brand", "p_size"]).cast("p_brand", "float").cast("p_size", "float").data


@query("SELECT o_orderkey, o_totalprice FROM orders")
def cast_int_no_trunc(spark, d):
    return table(spark, d, "orders").select(["o_orderkey", "o_totalprice"]).cast("o_totalprice", "int").data


@query("SELECT p_partkey, p_size::VARCHAR AS p_size, CASE WHEN q = floor(q) THEN q::BIGINT::VARCHAR ELSE q::VARCHAR END AS q FROM (SELECT p_partkey, p_size, p_size / 2.0::DOUBLE AS q FROM part)")
def cast_string(spark, d):
    f = table(spark, d, "part").assign({"q": F.col("p_size") / 2.0})
    return f.select(["p_partkey", "p_size", "q"]).cast("p_size", "string").cast("q", "string").data


@query("SELECT s_suppkey, s_acctbal, round(s_acctbal * 1.1, 6) AS raised FROM supplier")
def assign_column(spark, d):
    f = table(spark, d, "supplier").assign({"raised": r6(F.col("s_acctbal") * 1.1)})
    return f.select(["s_suppkey", "s_acctbal", "raised"]).data


@query("SELECT s_suppkey, s_name, c_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) JOIN (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) USING (k)")
def assign_frame(spark, d):
    left = table(spark, d, "supplier").select(["s_suppkey", "s_name"])
    names = table(spark, d, "customer").head(left.row_count).select(["c_custkey", "c_name"])
    return left.assign(names).select(["s_suppkey", "s_name", "c_name"]).data


@query("SELECT p_partkey, p_name FROM part WHERE p_name <> '' AND regexp_matches(p_name, 'A', 'i')")
def str_contains_ci(spark, d):
    return table(spark, d, "part").select(["p_partkey", "p_name"]).str_contains("p_name", "A").data


@query("SELECT doc_id, lang FROM documents WHERE text <> '' AND regexp_matches(text, 'É[a-z]+ |ü(ber|r)', 'i')")
def str_contains_regex(spark, d):
    return table(spark, d, "documents").select(["doc_id", "lang", "text"]).str_contains("text", "É[a-z]+ |ü(ber|r)").select(["doc_id", "lang"]).data


def _labelled(spark, d) -> Frame:
    docs = table(spark, d, "documents").select(["doc_id", "lang"])
    return docs.join(Frame(spark.read.parquet(f"{d}/labels.parquet"), ["doc_id"]), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"SELECT * FROM {LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def dropna_any(spark, d):
    return _labelled(spark, d).drop_na().data


@query("SELECT quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def dropna_all(spark, d):
    return Frame(_labelled(spark, d).data.select("quality", "toxic"), []).drop_na("all").data


@query(f"SELECT doc_id, lang, coalesce(quality, 9) AS quality, coalesce(toxic, 9) AS toxic FROM {LABELLED}")
def fillna_num(spark, d):
    return _labelled(spark, d).fill_na(9).data


@query(f"SELECT doc_id, CASE WHEN quality = 1 THEN lang ELSE 'none' END AS lang FROM {LABELLED}")
def fillna_str(spark, d):
    f = _labelled(spark, d)
    f.df = f.df.withColumn("lang", F.when(F.col("quality") == 1, F.col("lang"))).select("doc_id", "lang")
    return f.fill_na("none").data


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7")
def head_n(spark, d):
    return table(spark, d, "orders").head(7).select(["o_orderkey", "o_totalprice"]).data


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail_n(spark, d):
    return table(spark, d, "orders").tail(7).select(["o_orderkey", "o_totalprice"]).data


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey")
def sort_asc(spark, d):
    return table(spark, d, "orders").select(["o_orderkey", "o_orderpriority"]).sort("o_orderpriority").data


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sort_desc_topk(spark, d):
    return table(spark, d, "orders").select(["o_orderkey", "o_totalprice"]).sort("o_totalprice", ascending=False).df.limit(10)


# -- column functions ------------------------------------------------------------------------------


def _column(name, change, sql):
    def run(spark, d):
        f = table(spark, d, "lineitem").select([*KEYS["lineitem"], "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
        change(f)
        return f.data.select(*KEYS["lineitem"], F.col("l_extendedprice").alias("x"))

    run.__name__ = name
    query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({sql})::DOUBLE AS x FROM lineitem")(run)


_column("col_add", lambda f: f.col("l_extendedprice").add(5).add(f.col("l_quantity")), "l_extendedprice + 5 + l_quantity")
_column("col_sub", lambda f: f.col("l_extendedprice").sub(f.col("l_tax")).sub(1.5), "l_extendedprice - l_tax - 1.5")
_column("col_mul", lambda f: f.col("l_extendedprice").mul(f.col("l_tax")), "l_extendedprice * l_tax")
_column("col_div", lambda f: f.col("l_extendedprice").div(f.col("l_quantity")).div(0), "l_extendedprice / l_quantity")
_column("col_div_zero", lambda f: f.col("l_extendedprice").div(f.col("l_discount")), "l_extendedprice / CASE WHEN l_discount = 0 THEN 1 ELSE l_discount END")
_column("col_chain", lambda f: f.col("l_extendedprice").mul(f.col("l_tax")).add(f.col("l_quantity").div(2000)), "l_extendedprice * l_tax + l_quantity / 2000")


@query("SELECT event_id, (epoch_us(ts) // 1000)::DOUBLE AS ts FROM events")
def to_datetime_ms(spark, d):
    f = table(spark, d, "events").select(["event_id", "ts"])
    f.col("ts").to_datetime()
    return f.data


def _hour(offset):
    def run(spark, d):
        f = table(spark, d, "events").select(["event_id", "ts"])
        f.col("ts").to_datetime().extract_hour(offset)
        return f.data.select("event_id", "ts_hour")

    return run


def _hour_sql(offset):
    return f"SELECT event_id, floor((((epoch_us(ts) // 1000000 - {offset}) % 86400 + 86400) % 86400) / 3600)::DOUBLE AS ts_hour FROM events"


for _name, _offset in (("extract_hour_offset", 0), ("extract_hour_wrap", 32400)):
    _run = _hour(_offset)
    _run.__name__ = _name
    query(_hour_sql(_offset))(_run)


@query(r"SELECT event_id, try_cast(nullif(regexp_extract(t, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1), '') AS DOUBLE) AS n FROM (SELECT event_id, (event_id % 100)::VARCHAR || '.5e1 ' || event_type AS t FROM events)")
def parse_float_text(spark, d):
    text = F.concat((F.col("event_id") % 100).cast("string"), F.lit(".5e1 "), F.col("event_type"))
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", text.alias("t"))
    return df.select("event_id", parse_float(F.col("t"), type_of(df, "t")).alias("n"))


# -- reducers and grouping -------------------------------------------------------------------------


@query("SELECT round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 2) AS s FROM customer")
def reduce_sum(spark, d):
    f = table(spark, d, "customer")
    return f.df.agg(F.round(f._total("c_acctbal", False), 2).alias("s"))


@query("SELECT round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(*), 6) AS m FROM customer")
def reduce_mean(spark, d):
    return table(spark, d, "customer").stats_frame("c_acctbal").select(r6("mean").alias("m"))


@query("SELECT max(o_totalprice) AS x FROM orders")
def reduce_max(spark, d):
    return spark.createDataFrame([(table(spark, d, "orders").max("o_totalprice"),)], "x double")


@query("SELECT min(o_totalprice) AS x FROM orders")
def reduce_min(spark, d):
    return spark.createDataFrame([(table(spark, d, "orders").min("o_totalprice"),)], "x double")


@query("SELECT count(*) AS count, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS sum, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 6) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def stats_row(spark, d):
    return table(spark, d, "orders").stats_frame("o_totalprice").select("count", F.round("sum", 2).alias("sum"), r6("mean").alias("mean"), "min", "max")


def _grouped(op, sql):
    def run(spark, d):
        out = table(spark, d, "lineitem").group_by("l_returnflag", {"l_extendedprice": op}).df
        return out.withColumn("l_extendedprice", out.l_extendedprice if op in ("count", "max", "min") else F.round("l_extendedprice", 4))

    run.__name__ = f"groupby_{op}"
    query(f"SELECT l_returnflag, {sql} AS l_extendedprice FROM lineitem GROUP BY 1")(run)


_grouped("sum", "round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 4)")
_grouped("mean", "round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*), 4)")
_grouped("count", "count(*)")
_grouped("max", "max(l_extendedprice)")
_grouped("min", "min(l_extendedprice)")


@query("SELECT l_returnflag, count(*) AS l_quantity_count, sum(l_quantity::BIGINT)::DOUBLE AS l_quantity_sum, round(sum(l_quantity::BIGINT)::DOUBLE / count(*), 6) AS l_quantity_mean, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, max(l_tax) AS l_tax FROM lineitem GROUP BY 1")
def groupby_multi_ops(spark, d):
    out = table(spark, d, "lineitem").group_by("l_returnflag", {"l_quantity": ["count", "sum", "mean", "min", "max", "nothing"], "l_tax": "max"}, ordered=True).df
    return out.withColumn("l_quantity_mean", r6("l_quantity_mean"))


@query("SELECT event_type, round(sum(value::DECIMAL(24,8))::DOUBLE, 4) AS sum, count(*) AS count FROM events WHERE event_type IS NOT NULL AND event_type <> '' AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1")
def groupby_category(spark, d):
    return table(spark, d, "events").group_by_category("event_type", "value").withColumn("sum", F.round("sum", 4))


RANGE = 'SELECT floor({k})::INTEGER AS "group", round(avg({v}), 4) AS avg FROM {t} WHERE floor({k}) >= 0 AND floor({k}) < {n} GROUP BY 1 HAVING avg({v}) > 0'


@query(RANGE.format(k="l_quantity", v="l_extendedprice", t="lineitem", n=30))
def groupby_range(spark, d):
    return table(spark, d, "lineitem").group_by_range("l_quantity", "l_extendedprice", 30).withColumn("avg", F.round("avg", 4))


@query(RANGE.format(k="l_suppkey", v="l_quantity", t="lineitem", n=300))
def groupby_id(spark, d):
    return table(spark, d, "lineitem").group_by_id("l_suppkey", "l_quantity").withColumn("avg", F.round("avg", 4))


@query(RANGE.format(k="c_nationkey", v="(c_acctbal - 4000)", t="customer", n=25))
def groupby_range_negative_dropped(spark, d):
    f = table(spark, d, "customer").assign({"c_acctbal": F.col("c_acctbal") - 4000})
    return f.group_by_range("c_nationkey", "c_acctbal", 25).withColumn("avg", F.round("avg", 4))


@query("SELECT DISTINCT o_orderpriority FROM orders")
def unique_vals(spark, d):
    return table(spark, d, "orders").unique("o_orderpriority")


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT quality FROM {LABELLED})")
def nunique_with_null(spark, d):
    return spark.createDataFrame([(_labelled(spark, d).nunique("quality"),)], "n bigint")


@query(f"SELECT coalesce(quality::VARCHAR, 'null') AS value, count(*) AS count FROM {LABELLED} GROUP BY 1")
def value_counts(spark, d):
    return _labelled(spark, d).value_counts("quality")


# -- joins and running sums ------------------------------------------------------------------------


def _customers(spark, d) -> Frame:
    return table(spark, d, "customer").select(["c_custkey", "c_name"]).rename({"c_custkey": "o_custkey"})


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return table(spark, d, "orders").select(["o_orderkey", "o_custkey"]).join(_customers(spark, d), "o_custkey").data


@query("SELECT c_custkey AS o_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey")
def join_left(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 300000").select(["o_orderkey", "o_custkey"])
    return _customers(spark, d).join(big, "o_custkey", "left").data


@query("SELECT l.doc_id, l.quality AS quality, r.name FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) l JOIN (SELECT 0 AS quality, 'low' AS name UNION ALL SELECT NULL, 'none') r ON l.quality IS NOT DISTINCT FROM r.quality")
def join_nullsafe(spark, d):
    names = Frame(spark.createDataFrame([(0, "low"), (None, "none")], "quality int, name string"), ["quality"])
    return _labelled(spark, d).select(["doc_id", "quality"]).join(names, "quality").data


@query("SELECT n_nationkey, r_name AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_overwrite(spark, d):
    regions = table(spark, d, "region").rename({"r_regionkey": "n_regionkey", "r_name": "n_name"})
    return table(spark, d, "nation").select(["n_nationkey", "n_name", "n_regionkey"]).join(regions, "n_regionkey").data


@query("SELECT event_id, round(sum(value::DECIMAL(24,8)) OVER (ORDER BY event_id)::DOUBLE, 4) AS value_cumsum FROM events")
def cumsum_global(spark, d):
    return table(spark, d, "events").select(["event_id", "value"]).cumsum("value").data.select("event_id", F.round("value_cumsum", 4).alias("value_cumsum"))


@query(
    "SELECT 'l_quantity' AS \"column\", count(*) AS count, printf('%.2f', avg(l_quantity)) AS mean, min(l_quantity) AS min, list_sort(list(l_quantity))[floor(count(*) * 0.25)::BIGINT + 1] AS \"25%\", "
    "list_sort(list(l_quantity))[floor(count(*) * 0.5)::BIGINT + 1] AS \"50%\", list_sort(list(l_quantity))[floor(count(*) * 0.75)::BIGINT + 1] AS \"75%\", max(l_quantity) AS max FROM lineitem "
    "UNION ALL SELECT 'l_extendedprice', count(*), printf('%.2f', avg(l_extendedprice)), min(l_extendedprice), list_sort(list(l_extendedprice))[floor(count(*) * 0.25)::BIGINT + 1], "
    "list_sort(list(l_extendedprice))[floor(count(*) * 0.5)::BIGINT + 1], list_sort(list(l_extendedprice))[floor(count(*) * 0.75)::BIGINT + 1], max(l_extendedprice) FROM lineitem"
)
def describe_quartiles(spark, d):
    return Frame(spark.read.parquet(f"{d}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_returnflag"), []).describe()


@query('SELECT count(*) AS "rowCount", 4 AS "columnCount", printf(\'%.2f MB\', count(*) * 4 * 8 / 1048576.0) AS memory FROM supplier')
def info_row(spark, d):
    i = table(spark, d, "supplier").info()
    return spark.createDataFrame([(i["rowCount"], i["columnCount"], i["memory"])], "rowCount bigint, columnCount int, memory string")


# -- encoders --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code FROM orders")
def label_encoder(spark, d):
    df = table(spark, d, "orders").df
    return LabelEncoder().fit_column(df, "o_orderpriority").encode(df, "o_orderpriority", "code").select("o_orderkey", "code")


@query("SELECT o_orderkey, o_orderpriority AS label FROM orders")
def label_inverse(spark, d):
    df = table(spark, d, "orders").df
    e = LabelEncoder().fit_column(df, "o_orderpriority")
    coded = e.encode(df, "o_orderpriority", "code")
    return e.decode(coded, "code", "label", type_of(df, "o_orderpriority")).select("o_orderkey", "label")


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY trim(p_type)) - 1)::DOUBLE AS p_type_indexed FROM part")
def string_indexer(spark, d):
    df = table(spark, d, "part").df
    return StringIndexer().fit_transform(df, "p_type").select("p_partkey", "p_type_indexed")


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY trim(p_brand)) - 1)::DOUBLE AS p_brand_indexed FROM part")
def with_label_indexer(spark, d):
    f = table(spark, d, "part")
    return f.with_label([{"input": "p_brand", "indexer": StringIndexer().fit(f.df, "p_brand")}]).data.select("p_partkey", "p_brand_indexed")


ONE_HOT = {s: f"(c_mktsegment = '{s}')::TINYINT AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}


@query(f"SELECT c_custkey, {', '.join(ONE_HOT.values())} FROM customer")
def one_hot(spark, d):
    out = OneHotEncoder(["c_mktsegment"]).fit_transform(table(spark, d, "customer").df)
    return out.select("c_custkey", *[c for c in out.columns if c.startswith("c_mktsegment_")])


@query(f"SELECT c_custkey, {', '.join(list(ONE_HOT.values())[1:])} FROM customer")
def one_hot_drop_first(spark, d):
    out = OneHotEncoder(["c_mktsegment"], drop_first=True).fit_transform(table(spark, d, "customer").df)
    return out.select("c_custkey", *[c for c in out.columns if c.startswith("c_mktsegment_")])


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal_scaled FROM customer")
def standard_scaler(spark, d):
    return StandardScaler(["c_acctbal"]).fit_transform(table(spark, d, "customer").df).select("c_custkey", r6("c_acctbal_scaled").alias("c_acctbal_scaled"))


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice_normalized FROM part")
def minmax_scaler(spark, d):
    out = MinMaxScaler(["p_retailprice"]).fit_transform(table(spark, d, "part").df)
    return out.select("p_partkey", r6("p_retailprice_normalized").alias("p_retailprice_normalized"))


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ())::DOUBLE / (max(p_size) OVER () - min(p_size) OVER ()) * 2 - 1, 6) AS p_size_normalized FROM part")
def minmax_range(spark, d):
    out = MinMaxScaler(["p_size"], (-1, 1)).fit_transform(table(spark, d, "part").df)
    return out.select("p_partkey", r6("p_size_normalized").alias("p_size_normalized"))


@query(f"SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal_scaled, {', '.join(ONE_HOT.values())} FROM customer")
def pipeline_scale_onehot(spark, d):
    df = table(spark, d, "customer").df
    out = Pipeline([StandardScaler(["c_acctbal"])]).add(OneHotEncoder(["c_mktsegment"])).fit_transform(df)
    out = out.withColumn("c_acctbal_scaled", r6("c_acctbal_scaled"))
    return out.select("c_custkey", "c_acctbal_scaled", *[c for c in out.columns if c.startswith("c_mktsegment_")])


# -- sources and sinks: tables written in one format and read back ---------------------------------

NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, d):
    path = fresh_dir(spark, "csv") + ".csv"
    to_csv(table(spark, d, "nation").select(["n_nationkey", "n_name", "n_regionkey"]), path)
    return read_csv(spark, path, schema=NATION).data


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def csv_directory_roundtrip(spark, d):
    """Many parts, each with the header."""
    path = fresh_dir(spark, "csv") + ".csv"
    orders = table(spark, d, "orders").select(["o_orderkey", "o_orderpriority"])
    to_csv(Frame(orders.data.repartition(4)), path)
    return read_csv(spark, path, schema="o_orderkey bigint, o_orderpriority string").data


@query("""SELECT doc_id, text, '"' || lang || '", ' || coalesce(source, '') AS note FROM documents""")
def csv_quoted_cells(spark, d):
    """Cells with quotes, delimiters and line breaks."""
    path = fresh_dir(spark, "csv") + ".csv"
    note = F.concat(F.lit('"'), "lang", F.lit('", '), F.coalesce("source", F.lit("")))
    to_csv(Frame(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", note.alias("note"))), path)
    return read_csv(spark, path, schema="doc_id bigint, text string, note string", multiline=True).data


def _json_file(spark, text: str) -> str:
    path = fresh_dir(spark, "texts") + ".json"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


@query("SELECT * FROM (VALUES (1.0::DOUBLE, 'x}'), (2.0, NULL), (3.0, 'z')) AS t(a, \"b.c\")")
def json_concatenated(spark, d):
    return read_json(spark, _json_file(spark, '{"a":1,"b":{"c":"x}"}}{"a":2}\n{"a":3,"b":{"c":"z"}}')).data


@query("SELECT 0::BIGINT AS n_rows, 0 AS n_columns")
def json_primitive_array(spark, d):
    df = read_json(spark, _json_file(spark, '[1, "two", [3], null]')).data
    return df.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


@query("SELECT * FROM (VALUES (1.0::DOUBLE), (2.0)) AS t(a)")
def json_broken_tail(spark, d):
    return read_json(spark, _json_file(spark, '[{"a":1},{"a":2},{"a":3, "b":[1')).data


@query("SELECT n_nationkey::DOUBLE AS n_nationkey, NULL::DOUBLE AS n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation")
def csv_numeric_only(spark, d):
    path = fresh_dir(spark, "csv") + ".csv"
    to_csv(table(spark, d, "nation").select(["n_nationkey", "n_name", "n_regionkey"]), path)
    return read_csv(spark, path, numeric_only=True).data


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def tsv_roundtrip(spark, d):
    path = fresh_dir(spark, "tsv")
    table(spark, d, "nation").data.select("n_nationkey", "n_name", "n_regionkey").write.option("sep", "\t").option("header", True).csv(path)
    return read(spark, path, kind="tsv").data


@query("SELECT s_suppkey::DOUBLE AS s_suppkey, s_name, s_acctbal FROM supplier")
def json_array_read(spark, d):
    path = fresh_dir(spark, "json") + ".json"
    to_json(table(spark, d, "supplier").select(["s_suppkey", "s_name", "s_acctbal"]), path)
    return read_json(spark, path).data


@query('SELECT s_suppkey::DOUBLE AS id, s_name AS "meta.name", s_acctbal AS "meta.more.balance" FROM supplier')
def json_nested_flatten(spark, d):
    path = fresh_dir(spark, "json")
    nested = F.struct(F.col("s_suppkey").alias("id"), F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_acctbal").alias("balance")).alias("more")).alias("meta"))
    table(spark, d, "supplier").data.select(nested.alias("x")).select("x.*").write.json(path)
    return read(spark, path, kind="ndjson").data


@query("SELECT event_id::DOUBLE AS event_id, event_type FROM events")
def ndjson_scan_select(spark, d):
    path = fresh_dir(spark, "events") + ".ndjson"
    to_ndjson(table(spark, d, "events").select(["event_id", "event_type", "value"]), path)
    return scan_ndjson(spark, path).select(["event_type", "event_id", "no_such_column"]).data


@query(f"SELECT doc_id::DOUBLE AS doc_id, lang, coalesce(quality, 0)::DOUBLE AS quality FROM {LABELLED}")
def ndjson_defaults(spark, d):
    path = fresh_dir(spark, "labelled") + ".ndjson"
    f = _labelled(spark, d).select(["doc_id", "lang", "quality"])
    f.data.coalesce(1).write.json(path)  # nulls are left out of the lines
    return read_ndjson(spark, path, defaults=True).data


@query("SELECT r_regionkey::DOUBLE AS r_regionkey, r_name FROM region")
def json_to_ndjson_convert(spark, d):
    source, target = fresh_dir(spark, "region") + ".json", fresh_dir(spark, "region") + ".ndjson"
    to_json(table(spark, d, "region").select(["r_regionkey", "r_name"]), source, pretty=True)
    json_to_ndjson(spark, source, target)
    return read_ndjson(spark, target).data


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 40")
def parquet_read(spark, d):
    return read(spark, f"{d}/part.parquet", order_by=["p_partkey"]).filter("p_size > 40").select(["p_partkey", "p_name"]).data


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, round(o_totalprice * 2, 4) AS twice FROM orders")
def ingest_transforms(spark, d):
    path = fresh_dir(spark, "orders") + ".csv"
    table(spark, d, "orders").data.select("o_orderkey", "o_totalprice").write.option("header", True).csv(path)
    f = ingest(spark, path, [{"name": "twice", "formula": "round(cast(o_totalprice AS double) * 2, 4)"}])
    return f.select(["o_orderkey", "twice"]).data


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_batches_count(spark, d):
    path, sink = fresh_dir(spark, "stream-in"), fresh_dir(spark, "stream-out")
    table(spark, d, "events").data.select("event_id", "event_type").write.json(path)
    stream_batches(spark, path, lambda f: f.data.groupBy("event_type").count().write.mode("append").parquet(sink), batch_size=5000, kind="ndjson")
    return spark.read.parquet(sink).groupBy("event_type").agg(F.sum("count").alias("n"))


@query(
    "SELECT rpad(n_nationkey::VARCHAR, 11, ' ') || ' | ' || rpad(n_name, (SELECT max(greatest(6, length(n_name))) FROM nation)::INTEGER, ' ') AS line FROM nation "
    "UNION ALL SELECT 'n_nationkey | ' || rpad('n_name', (SELECT max(greatest(6, length(n_name))) FROM nation)::INTEGER, ' ') "
    "UNION ALL SELECT '----------- | ' || repeat('-', (SELECT max(greatest(6, length(n_name))) FROM nation)::INTEGER)"
)
def txt_report_lines(spark, d):
    lines = report_lines(table(spark, d, "nation").select(["n_nationkey", "n_name"]))
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("SELECT s_suppkey::VARCHAR || ',' || CASE WHEN s_acctbal = floor(s_acctbal) THEN s_acctbal::BIGINT::VARCHAR ELSE printf('%.4f', s_acctbal) END AS line FROM supplier")
def write_fixed4(spark, d):
    df = table(spark, d, "supplier").data.select("s_suppkey", "s_acctbal")
    return df.select(fixed4_line(df).alias("line"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey IS NULL THEN 'null' ELSE n_nationkey::VARCHAR END AS shown FROM nation")
def js_string_ints(spark, d):
    df = table(spark, d, "nation").data
    return df.select("n_nationkey", js_string(F.col("n_nationkey"), type_of(df, "n_nationkey")).alias("shown"))


# -- flagship: load, clean, derive, five averages --------------------------------------------------


def _trips(spark, d) -> Frame:
    """lineitem as trips: cleaned, with margin, rate and unit price."""
    f = table(spark, d, "lineitem").filter("l_quantity > 0 AND l_extendedprice > 0", inputs=["l_quantity", "l_extendedprice"])
    f.with_columns([
        {"name": "net", "inputs": ["l_extendedprice", "l_discount"], "formula": "l_extendedprice * (1 - l_discount)"},
        {"name": "rate", "inputs": ["net", "l_extendedprice"], "formula": "100 * net / l_extendedprice"},
        {"name": "unit", "inputs": ["net", "l_quantity"], "formula": "net / l_quantity"},
    ])
    return f


TRIPS = "(SELECT *, l_extendedprice * (1 - l_discount) AS net, 100 * (l_extendedprice * (1 - l_discount)) / l_extendedprice AS rate, l_extendedprice * (1 - l_discount) / l_quantity AS unit FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)"


@query("SELECT floor((epoch_us(ts) // 1000000 % 86400) / 3600)::INTEGER AS \"group\", round(avg(value), 4) AS avg FROM events WHERE value > 0 GROUP BY 1")
def flagship_hourly(spark, d):
    f = table(spark, d, "events").select(["event_id", "ts", "value"]).filter("value > 0", inputs=["value"])
    f.col("ts").to_datetime().extract_hour(0)
    return f.group_by_range("ts_hour", "value", 24).withColumn("avg", F.round("avg", 4))


@query(f'SELECT l_suppkey::INTEGER AS "group", round(avg(unit), 4) AS avg FROM {TRIPS} WHERE l_suppkey < 300 GROUP BY 1 HAVING avg(unit) > 0')
def flagship_zone(spark, d):
    return _trips(spark, d).group_by_id("l_suppkey", "unit").withColumn("avg", F.round("avg", 4))


@query(f"SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity FROM {TRIPS} GROUP BY 1")
def flagship_payment(spark, d):
    return _trips(spark, d).group_by("l_returnflag", {"l_quantity": "mean"}).df.withColumn("l_quantity", F.round("l_quantity", 4))


@query(f"SELECT round(avg(l_extendedprice), 4) AS fare FROM {TRIPS} WHERE l_linenumber = 1")
def flagship_single(spark, d):
    return _trips(spark, d).filter("l_linenumber = 1").df.agg(F.round(F.avg("l_extendedprice"), 4).alias("fare"))


@query(f'SELECT l_quantity::INTEGER AS "group", round(avg(rate), 4) AS avg FROM {TRIPS} WHERE l_quantity < 300 GROUP BY 1 HAVING avg(rate) > 0')
def flagship_rate(spark, d):
    return _trips(spark, d).group_by_range("l_quantity", "rate", 300).withColumn("avg", F.round("avg", 4))


@query(f'SELECT l_quantity::INTEGER AS "group", round(avg(net), 4) AS avg FROM {TRIPS} WHERE l_quantity < 300 GROUP BY 1 HAVING avg(net) > 0')
def flagship_net(spark, d):
    return _trips(spark, d).group_by_range("l_quantity", "net", 300).withColumn("avg", F.round("avg", 4))
