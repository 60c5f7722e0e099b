"""Queries over the driver's tables, one for each operator, and the same results in SQL.

Tables hold no flat files, so a query encodes rows as records, damages some by their key, reads them with
the engine and returns what came out. Files that a query needs go to a folder of its own under the
session's checkpoint directory.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flatspark.functions import codepage
from flatspark.operators import rules as rule_ops
from flatspark.operators.detect import BONUS, RECORDS, candidates, detect, scores
from flatspark.operators.infer import DELIMITERS, SAMPLE, infer_layout
from flatspark.operators.validate import diagnostics, rejects, validate, values_of
from flatspark.plans.conversion import convert_distributed
from flatspark.plans.layout import EXAMPLES, LIBRARY, Layout, build_layout, load_layout
from flatspark.plans.registry import registry
from flatspark.sinks.text import join_parts, singer_records, sql_inserts, write_distributed, write_single
from flatspark.sources.flat import read_flat, scan
from flatspark.sources.framed import scan_frames
from flatspark.sources.lines import from_frame, scan_lines, shared_folder
from flatspark.streaming.flat import stream_flat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def field(name: str, start: int, length: int, kind: str = "string", **more) -> dict:
    extra = {"date": {"format": "YYYYMMDD"}, "decimal": {"scale": 2, "align": "right"}}.get(kind, {})
    return {"name": name, "start": start, "length": length, "type": kind, **extra, **more}


def fixed(*fields: dict, page: str = "cp850", **more) -> Layout:
    return build_layout({"format": "orders_fixed", "version": "1.0.0", "codepage": page, "record_length": max(f["start"] + f["length"] for f in fields), "fields": list(fields), **more})


ORDER_FIELDS = (field("id", 0, 10), field("type", 10, 15), field("date", 25, 8, "date"), field("amount", 33, 12, "decimal"), field("currency", 45, 3))
ORDERS = fixed(*ORDER_FIELDS)
AR = load_layout(f"{LIBRARY}/jde_ar.yaml")


def cents() -> Column:
    return (F.col("o_totalprice").cast("decimal(38,2)") * 100).cast("bigint").cast("string")


def day() -> Column:
    return F.date_format("o_orderdate", "yyyyMMdd")


def k() -> Column:
    return F.col("o_orderkey")


def padded(key: Column, kind: Column, date: Column, amount: Column, width: int = 12) -> Column:
    return F.concat(F.lpad(key.cast("string"), 10, "0"), F.rpad(kind, 15, " "), date, F.lpad(amount, width, " "), F.lit("USD"))


def order_records(spark: SparkSession, sf_dir: str, date: Column | None = None, amount: Column | None = None, width: int = 12) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    date, amount = (day() if date is None else date), (cents() if amount is None else amount)
    return from_frame(orders.select(k(), codepage.encode(padded(k(), F.col("o_orderpriority"), date, amount, width), "cp850").alias("r")), "r", "o_orderkey", "orders")


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th date has month 13, every 89th record 13 bytes, every 83rd amount a letter."""
    records = order_records(spark, sf_dir, F.when(k() % 97 == 0, F.concat(F.substring(day(), 1, 4), F.lit("1301"))).otherwise(day()), F.when(k() % 83 == 0, F.lit("12X4")).otherwise(cents()))
    return records.withColumn("record", F.when(F.col("line") % 89 == 0, F.substring("record", 1, 13)).otherwise(F.col("record")))


ORDER_SQL = """SELECT lpad(o_orderkey::varchar, 10, '0') AS id, o_orderpriority AS "type", strftime(o_orderdate, '%Y-%m-%d') AS "date",
  o_totalprice::decimal(38,2) AS amount, 'USD' AS currency FROM orders"""
BAD = "(o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 OR o_orderkey % 83 = 0)"
ERRORS_SQL = """CASE WHEN o_orderkey % 89 = 0 THEN 'length 13 != record_length 48; field ''type'': out of range (short line); field ''date'': out of range (short line); field ''amount'': out of range (short line); field ''currency'': out of range (short line)'
  ELSE concat_ws('; ', CASE WHEN o_orderkey % 97 = 0 THEN 'field ''date'': invalid date ''' || strftime(o_orderdate, '%Y') || '1301'': month must be in 1..12' END,
  CASE WHEN o_orderkey % 83 = 0 THEN 'field ''amount'': invalid decimal ''        12X4''' END) END"""


@query(ORDER_SQL)
def parse_orders_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_of(validate(order_records(spark, sf_dir, width=8), AR))


@query(f"SELECT * FROM ({ORDER_SQL} WHERE NOT {BAD})")
def fixed_parse_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_of(validate(damaged(spark, sf_dir), ORDERS))


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT {BAD}) AS ok, count(*) FILTER ({BAD}) AS errors FROM orders")
def fixed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(damaged(spark, sf_dir), ORDERS).agg(*rule_ops.measures(ORDERS))


@query(f"SELECT o_orderkey AS line, {ERRORS_SQL} AS error FROM orders WHERE {BAD}")
def fixed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(validate(damaged(spark, sf_dir), ORDERS)).drop("source")


@query(f"SELECT o_orderkey AS line, '  line ' || o_orderkey || ': ' || CASE WHEN {BAD} THEN 'ERR [' || {ERRORS_SQL} || ']' ELSE 'OK' END AS text FROM orders")
def record_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(validate(damaged(spark, sf_dir), ORDERS)).drop("source")


@query("""SELECT o_orderkey AS line, 'field ''date'': invalid date ''20XX0101'' (expected YYYYMMDD); field ''amount'': empty decimal' AS error
  FROM orders WHERE o_orderkey % 3 = 0""")
def cumulative_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = k() % 3 == 0
    records = order_records(spark, sf_dir, F.when(bad, F.lit("20XX0101")).otherwise(day()), F.when(bad, F.lit("")).otherwise(cents()))
    return rejects(validate(records, ORDERS)).drop("source")


@query("""SELECT o_orderkey AS line, CASE o_orderkey % 4 WHEN 0 THEN 'field ''date'': invalid date ''20230229'': day is out of range for month'
  WHEN 1 THEN 'field ''date'': invalid date ''00000101'': year 0 is out of range' WHEN 2 THEN 'field ''date'': invalid date '' 2023010'' (expected YYYYMMDD)'
  ELSE 'field ''date'': invalid date ''2023-1-1'' (expected YYYYMMDD)' END AS error FROM orders""")
def date_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.element_at(F.array(*map(F.lit, ("20230229", "00000101", " 2023010", "2023-1-1"))), (k() % 4 + 1).cast("int"))
    return rejects(validate(order_records(spark, sf_dir, bad), ORDERS)).drop("source")


@query("SELECT lpad(o_orderkey::varchar, 10, '0') AS id, CASE WHEN o_orderkey % 7 = 0 THEN -(o_totalprice::decimal(38,2)) ELSE o_totalprice::decimal(38,2) END AS amount FROM orders")
def trailing_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_records(spark, sf_dir, amount=F.when(k() % 7 == 0, F.concat(cents(), F.lit("-"))).otherwise(cents()))
    return values_of(validate(records, ORDERS)).select("id", "amount")


@query("""SELECT lpad(o_orderkey::varchar, 10, '0') AS id, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice::decimal(38,2) WHEN 1 THEN o_totalprice::decimal(38,2)
  WHEN 2 THEN 1000.00::decimal(38,2) ELSE 1.24::decimal(38,2) END AS amount FROM orders""")
def implied_vs_explicit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.col("o_totalprice").cast("decimal(38,2)").cast("string")
    amount = F.when(k() % 4 == 0, cents()).when(k() % 4 == 1, point).when(k() % 4 == 2, F.lit("1E5")).otherwise(F.lit("1.235"))
    return values_of(validate(order_records(spark, sf_dir, amount=amount), ORDERS)).select("id", "amount")


@query("SELECT o_orderkey AS line, 'field ''amount'': more than 2 decimals in ''       1.235''' AS error FROM orders WHERE o_orderkey % 5 = 0")
def strict_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_records(spark, sf_dir, amount=F.when(k() % 5 == 0, F.lit("1.235")).otherwise(cents()))
    return rejects(validate(records, ORDERS, strict_scale=True)).drop("source")


ACCENTED = "éÄñ"
CUSTOMER_SQL = f"SELECT lpad(c_custkey::varchar, 10, '0') AS id, c_name || '{ACCENTED}' AS name, c_acctbal::decimal(38,2) AS balance FROM customer"


def customers(spark: SparkSession, sf_dir: str, page: str, name_page: str | None = None) -> DataFrame:
    """Customers in a page, with letters beyond ASCII; the name field may have a page of its own."""
    c = table(spark, sf_dir, "customer")
    name = F.concat("c_name", F.lit(ACCENTED))
    wide = 40
    money = (F.col("c_acctbal").cast("decimal(38,2)") * 100).cast("bigint")
    amount = F.lpad(F.concat(F.abs(money).cast("string"), F.when(money < 0, "-").otherwise("")), 12, " ")
    raw = lambda text, p: codepage.encode(text, p)
    blank = raw(F.lit(" "), name_page or page)
    named = raw(name, name_page or page)
    record = F.concat(raw(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), page), F.rpad(named, wide, blank), raw(amount, page))
    layout = fixed(field("id", 0, 10), field("name", 10, wide, **({"codepage": name_page} if name_page else {})), field("balance", 10 + wide, 12, "decimal"), page=page)
    return values_of(validate(from_frame(c.select("c_custkey", record.alias("r")), "r", "c_custkey"), layout))


def _page_query(name: str, page: str, own: str | None = None) -> None:
    QUERIES[name], ORACLES[name] = lambda spark, sf_dir: customers(spark, sf_dir, page, own), CUSTOMER_SQL


for _name, _page, _own in (
    ("ebcdic_parse", "ebcdic-cp037", None),
    ("cp850_parse", "cp850", None),
    ("cp1252_parse", "cp1252", None),
    ("latin1_parse", "latin-1", None),
    ("utf8_parse", "utf-8", None),
    ("per_field_codepage", "cp850", "ebcdic-cp037"),
    ("per_field_codepage_utf8", "cp1252", "utf-8"),
):
    _page_query(_name, _page, _own)


@query("SELECT o_orderkey AS line, 'field ''type'': undecodable bytes' AS error FROM orders WHERE o_orderkey % 11 = 0")
def undecodable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_records(spark, sf_dir)
    bad = F.overlay("record", F.unhex(F.lit("81")), 13, 1)
    records = records.withColumn("record", F.when(F.col("line") % 11 == 0, bad).otherwise(F.col("record")))
    return rejects(validate(records, fixed(*ORDER_FIELDS, page="cp1252"), on_decode_error="record")).drop("source")


DELIMITED = build_layout({"format": "delimited", "version": 1, "delimiter": "|", "fields": [{"name": "id"}, {"name": "date", "type": "date", "format": "YYYYMMDD"}, {"name": "amount", "type": "decimal", "scale": 2}, {"name": "status"}]})


def delimited_records(spark: SparkSession, sf_dir: str, delimiter: str = "|", tail: Column | None = None) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    text = F.concat_ws(delimiter, k().cast("string"), day(), F.col("o_totalprice").cast("decimal(38,2)").cast("string"), F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit("\t")))
    return from_frame(orders.select(k(), (text if tail is None else F.concat(text, tail)).alias("r")), "r", "o_orderkey")


DELIMITED_SQL = """SELECT o_orderkey::varchar AS id, strftime(o_orderdate, '%Y-%m-%d') AS "date", o_totalprice::decimal(38,2) AS amount, o_orderstatus AS status FROM orders"""


@query(DELIMITED_SQL)
def delimited_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_of(validate(delimited_records(spark, sf_dir), DELIMITED))


@query(DELIMITED_SQL)
def delimited_long_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = build_layout({"format": "delimited", "version": 1, "delimiter": ".*$", "fields": [{"name": "id"}, {"name": "date", "type": "date", "format": "YYYYMMDD"}, {"name": "amount", "type": "decimal", "scale": 2}, {"name": "status"}]})
    return values_of(validate(delimited_records(spark, sf_dir, ".*$"), layout))


@query("SELECT o_orderkey AS line, 'field ''status'': missing column (3 columns in line)' AS error FROM orders WHERE o_orderkey % 6 = 0")
def delimited_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = delimited_records(spark, sf_dir)
    short = F.substring_index(F.col("record").cast("string"), "|", 3).cast("binary")
    return rejects(validate(records.withColumn("record", F.when(F.col("line") % 6 == 0, short).otherwise(F.col("record"))), DELIMITED)).drop("source")


@query("SELECT o_orderkey AS line, '6 columns in line, schema expects 4' AS error FROM orders WHERE o_orderkey % 6 = 1")
def delimited_extra_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(validate(delimited_records(spark, sf_dir, tail=F.when(k() % 6 == 1, "|x|").otherwise("")), DELIMITED)).drop("source")


def files(spark: SparkSession, sf_dir: str, header: bool = False) -> str:
    """Orders in four text files by key, in key order; a blank line before every fifth key; a header on request."""
    path = folder(spark)
    text = F.concat_ws("|", k().cast("string"), day(), F.col("o_totalprice").cast("decimal(38,2)").cast("string"), "o_orderstatus")
    rows = table(spark, sf_dir, "orders").select((k() % 4).alias("f"), k(), F.concat(F.when(k() % 5 == 0, "\r\n").otherwise(""), text, F.lit("\r")).alias("value"))
    if header:
        first = spark.range(4).select(F.col("id").alias("f"), F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit("\nid|date|amount|status").alias("value"))
        rows = rows.unionByName(first)
    rows.repartition(4, "f").sortWithinPartitions("f", "o_orderkey").select("f", "value").write.partitionBy("f").text(path)
    return path


LINES_SQL = "SELECT o_orderkey, o_orderkey % 4 AS f, sum(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS line FROM orders"


def file_number() -> Column:
    return F.regexp_extract("source", r"f=(\d)", 1).cast("bigint").alias("f")


@query(f"SELECT o_orderkey::varchar AS id, f::bigint AS f, line::bigint AS line FROM ({LINES_SQL})")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Small splits: a file is read by several tasks, as large files are; they are cut when the scan is made.
    size, key = spark.conf.get("spark.sql.files.maxPartitionBytes"), "spark.sql.files.maxPartitionBytes"
    path = files(spark, sf_dir)
    try:
        spark.conf.set(key, "64k")
        lines = scan_lines(spark, f"{path}/f=*")
    finally:
        spark.conf.set(key, size)
    return validate(lines, DELIMITED).select("value.id", file_number(), "line")


@query(f"SELECT (o_orderkey % 4)::bigint AS f, count(*) AS n, sum(o_totalprice::decimal(38,2)) AS amount FROM orders GROUP BY 1")
def batch_multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate(scan_lines(spark, f"{files(spark, sf_dir)}/f=*"), DELIMITED).where("ok")
    return checked.groupBy(file_number()).agg(F.count("*").alias("n"), F.sum("value.amount").cast("decimal(38,2)").alias("amount"))


@query(DELIMITED_SQL)
def delimited_header_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_of(validate(scan_lines(spark, f"{files(spark, sf_dir, header=True)}/f=*", skip_first=True), DELIMITED))


@query(f"SELECT id, amount FROM ({ORDER_SQL} WHERE NOT {BAD})")
def on_error_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    damaged(spark, sf_dir).select(F.col("record").cast("string").alias("value")).write.text(path)
    return read_flat(spark, path, ORDERS, on_error="ignore").select("id", "amount")


def with_rules(*rules: dict) -> Layout:
    return fixed(*ORDER_FIELDS, rules=list(rules))


@query(f"SELECT sum(o_totalprice::decimal(38,2))::varchar AS total FROM orders WHERE NOT {BAD}")
def rule_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = with_rules({"type": "sum", "field": "amount", "expected": 0})
    return validate(damaged(spark, sf_dir), layout).agg(*rule_ops.measures(layout)).select(F.col("sum_0").cast("string").alias("total"))


@query(f"SELECT 'sum' AS rule, 'rule ''sum:amount'': total ' || sum(o_totalprice::decimal(38,2)) || ' != expected 999' AS message FROM orders WHERE NOT {BAD}")
def rule_sum_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = with_rules({"type": "sum", "field": "amount", "expected": 999})
    return rule_ops.violations_frame(validate(damaged(spark, sf_dir), layout), layout)


BALANCE = fixed(field("debit", 0, 12, "decimal"), field("credit", 12, 12, "decimal"), page="utf-8", rules=[{"type": "balance", "positive": "debit", "negative": "credit"}])


@query("""SELECT 'balance' AS rule, 'rule ''balance:debit/credit'': debit=' || a || ' != credit=' || b || ' (diff ' || (a - b) || ')' AS message
  FROM (SELECT sum(o_totalprice::decimal(38,2)) AS a, sum(o_totalprice::decimal(38,2)) - 1.00 * count(*) FILTER (o_orderkey % 1000 = 0) AS b FROM orders) WHERE a != b""")
def rule_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    credit = F.when(k() % 1000 == 0, (cents().cast("bigint") - 100).cast("string")).otherwise(cents())
    records = from_frame(orders.select(k(), F.concat(F.lpad(cents(), 12, " "), F.lpad(credit, 12, " ")).alias("r")), "r", "o_orderkey")
    return rule_ops.violations_frame(validate(records, BALANCE), BALANCE)


@query(f"SELECT 'jde_ar.yaml' AS path, {RECORDS * (BONUS + 5)}::bigint AS score")
def detect_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = order_records(spark, sf_dir, width=8).orderBy("line").limit(RECORDS)
    return scores(sample, candidates()).where("score > 0").select(F.substring_index("path", "/", -1).alias("path"), "score")


def with_header(spark: SparkSession, sf_dir: str, delimiter: str) -> str:
    """Orders in one delimited file under a header; all tasks write it, and their parts are then joined."""
    path = folder(spark)
    names = spark.range(1).select(F.lit(delimiter.join(["id", "date", "amount", "status"])).alias("value"))
    rows = delimited_records(spark, sf_dir, delimiter).select(F.rtrim(F.col("record").cast("string"), F.lit("\t")).alias("value"))
    names.unionAll(rows).write.text(f"{path}/parts")
    join_parts(spark, f"{path}/parts", f"{path}/orders.txt")
    return f"{path}/orders.txt"


def _inferred(name: str, sample: int | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared_folder(spark)  # set before threads ask for it
        layouts = {}

        def one(d: str) -> None:
            layouts[d] = infer_layout(spark, with_header(spark, sf_dir, d), sample_lines=sample)

        # Side by side, so that the last tasks of one file do not leave cores idle.
        with ThreadPoolExecutor(len(DELIMITERS)) as pool:
            for done in [pool.submit(inheritable_thread_target(spark)(partial(one, d))) for d in DELIMITERS]:
                done.result()
        rows = [(layouts[d]["delimiter"], layouts[d]["has_header"], f["name"], f["type"], f.get("scale")) for d in DELIMITERS for f in layouts[d]["fields"]]
        return spark.createDataFrame(rows, "delimiter string, has_header boolean, name string, type string, scale int")

    QUERIES[name] = run
    ORACLES[name] = """SELECT delimiter, true AS has_header, name, "type", scale FROM (VALUES (','), (chr(9)), (';'), ('|')) d(delimiter),
      (VALUES ('id', 'decimal', 0), ('date', 'date', NULL), ('amount', 'decimal', 2), ('status', 'string', NULL)) t(name, "type", scale)"""


_inferred("infer_schema", SAMPLE)
_inferred("infer_schema_whole_file", None)


@query(f"""SELECT 'INSERT INTO "export" ("id", "type", "date", "amount", "currency") VALUES (''' || id || ''', ''O''''' || "type" || ''', ''' || "date" || ''', ' || amount || ', ''USD'');' AS value FROM ({ORDER_SQL})""")
def sql_insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values_of(validate(order_records(spark, sf_dir), ORDERS))
    return sql_inserts(rows.withColumn("type", F.concat(F.lit("O'"), F.col("type"))), ORDERS)


@query("SELECT * FROM (SELECT 'RECORD' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'SCHEMA', 1 UNION ALL SELECT 'STATE', 1)")
def singer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    write_distributed(validate(order_records(spark, sf_dir), ORDERS), ORDERS, "singer", path)
    return spark.read.text(path).groupBy(F.get_json_object("value", "$.type").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT lpad(o_orderkey::varchar, 10, '0') AS id, o_totalprice::decimal(38,2) AS amount FROM orders")
def singer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = singer_records(values_of(validate(order_records(spark, sf_dir), ORDERS)), ORDERS)
    return made.select(F.get_json_object("value", "$.record.id").alias("id"), F.get_json_object("value", "$.record.amount").cast("double").cast("decimal(38,2)").alias("amount"))


def _round_trip(fmt: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = folder(spark)
        write_distributed(validate(damaged(spark, sf_dir), ORDERS), ORDERS, fmt, path)
        return read(spark, path).select("id", "type", "date", F.col("amount").cast("decimal(38,2)").alias("amount"), "currency")

    QUERIES[f"{fmt}_roundtrip"], ORACLES[f"{fmt}_roundtrip"] = run, f"SELECT * FROM ({ORDER_SQL} WHERE NOT {BAD})"


WRITTEN = "id string, type string, date string, amount double, currency string"
_round_trip("parquet", lambda spark, path: spark.read.parquet(path))
_round_trip("csv", lambda spark, path: spark.read.schema(WRITTEN).csv(path, header=True))
_round_trip("ndjson", lambda spark, path: spark.read.schema(WRITTEN).json(path))


def frame_writer(path: str):
    """Writes r as a frame of the file f, for mapInArrow."""

    def write(batches):
        import struct
        from pyarrow import RecordBatch, array
        from pyarrow import fs as pafs

        files, where = pafs.FileSystem.from_uri(path)
        files.create_dir(where, recursive=True)
        open_files: dict = {}
        for batch in batches:
            for f, r in zip(batch.column("f").to_pylist(), batch.column("r").to_pylist()):
                out = open_files.get(f) or open_files.setdefault(f, files.open_output_stream(f"{where}/{f}.frames"))
                out.write(struct.pack(">H", len(r)) + r)
        for out in open_files.values():
            out.close()
        yield RecordBatch.from_arrays([array([len(open_files)])], names=["n"])

    return write


@query("SELECT (o_orderkey % 3)::bigint AS f, lpad(o_orderkey::varchar, 10, '0') AS id, strftime(o_orderdate, '%Y-%m-%d') AS \"date\", o_totalprice::decimal(38,2) AS amount FROM orders")
def framed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a third of the orders each, from three files."""
    path = folder(spark)
    amount = F.lpad(cents(), 12, " ")
    rows = table(spark, sf_dir, "orders").select((k() % 3).alias("f"), F.encode(F.concat(F.lpad(k().cast("string"), 10, "0"), day(), amount), "ISO-8859-1").alias("r"))
    rows.repartition(3, "f").mapInArrow(frame_writer(path), "n bigint").count()
    layout = build_layout({"format": "framed", "version": 1, "parser": "length_prefixed_frame", "codepage": "cp1252", "fields": [field("id", 0, 10), field("date", 10, 8, "date"), field("amount", 18, 12, "decimal")]})
    return validate(scan_frames(spark, path), layout).where("ok").select(F.regexp_extract("source", r"(\d)\.frames", 1).cast("bigint").alias("f"), "value.*")


@query("SELECT o_orderkey::varchar AS id FROM orders")
def strip_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    around = F.concat(F.lit("   \t"), k().cast("string"), F.lit("　\x85 "))
    layout = build_layout({"format": "delimited", "version": 1, "delimiter": ";", "fields": [{"name": "id"}]})
    return values_of(validate(from_frame(orders.select(k(), around.alias("r")), "r", "o_orderkey"), layout))


@query(
    """SELECT * FROM (VALUES ('cobol_fixed', '1.0.0', '57', 'cobol_export', 5), ('jde_ap', '1.0.0', '64', 'jde_ap_export', 6), ('jde_fixed_width', '1.0.0', '44', 'jde_ar_export', 5),
  ('jde_gl', '1.0.0', '81', 'jde_gl_export', 7), ('sap_batch', '1.0.0', '60', 'sap_batch_export', 6), ('sap_fi_document', '1.0.0', '78', 'sap_fi_document', 9)) t(format, version, len, "table", n_fields)"""
)
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, LIBRARY).select("format", "version", "len", "table", "n_fields")


@query(DELIMITED_SQL)
def streaming_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = files(spark, sf_dir), folder(spark)
    stream = stream_flat(spark, f"{path}/f=*", DELIMITED).where("ok").select("value.*")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}-state").format("parquet").start(out).awaitTermination()
    return spark.read.parquet(out).select("id", "date", "amount", "status")


@query("SELECT lpad(o_orderkey::varchar, 10, '0') AS id, o_orderdate::date AS \"date\" FROM orders")
def dates_as_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_of(validate(order_records(spark, sf_dir), ORDERS, date_as="date")).select("id", "date")


def encoded_rows(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    """Orders as records of any fixed layout: dates and amounts in its typed fields, the key in the others."""
    texts = []
    for f in layout.fields:
        whole = {"date": day(), "decimal": F.lpad(cents(), f.length, " ")}.get(f.type, F.rpad(k().cast("string"), f.length, " "))
        texts.append((f.start, codepage.encode(F.substring(whole, 1, f.length), f.codepage or layout.codepage)))
    return from_frame(table(spark, sf_dir, "orders").select(k(), F.concat(*(t for _, t in sorted(texts, key=lambda x: x[0]))).alias("r")), "r", "o_orderkey")


@query(
    """SELECT name AS format, count(*) AS n, min(o_orderdate::date)::varchar AS first_day FROM orders,
  (VALUES ('cobol_fixed'), ('jde_ap'), ('jde_gl'), ('sap_batch'), ('sap_fi_document')) t(name) GROUP BY name"""
)
def library_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the library's other layouts, parsed."""
    out = []
    for name in ("cobol_fixed", "jde_ap", "jde_gl", "sap_batch", "sap_fi_document"):
        layout = load_layout(f"{LIBRARY}/{name}.yaml")
        date = next(f.name for f in layout.fields if f.type == "date")
        rows = values_of(validate(encoded_rows(spark, sf_dir, layout), layout))
        out.append(rows.agg(F.lit(name).alias("format"), F.count("*").alias("n"), F.min(date).alias("first_day")))
    return reduce(DataFrame.unionAll, out)


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT {BAD}) AS ok, count(*) FILTER ({BAD}) AS errors, sum(o_totalprice::decimal(38,2)) FILTER (NOT {BAD}) AS written FROM orders")
def convert_to_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts come from the job that writes; the total is that of the rows written."""
    path, out = folder(spark), folder(spark)
    damaged(spark, sf_dir).select(F.col("record").cast("string").alias("value")).write.text(path)
    report = convert_distributed(spark, path, ORDERS, "parquet", out)
    return spark.read.parquet(out).agg(F.lit(report.total).alias("total"), F.lit(report.ok).alias("ok"), F.lit(report.errors).alias("errors"), F.sum("amount").cast("decimal(38,2)").alias("written"))


@query(f"SELECT id, \"type\", \"date\", amount, currency FROM ({ORDER_SQL} WHERE o_orderkey <= 2000 AND NOT {BAD})")
def json_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered JSON file, as the command line writes it."""
    layout, text = ORDERS, io.StringIO()
    write_single(validate(damaged(spark, sf_dir).where("line <= 2000"), layout), layout, "json", "-", text)
    return spark.createDataFrame([(json.dumps(r),) for r in json.loads(text.getvalue())], "value string").select(F.from_json("value", WRITTEN).alias("r")).select("r.id", "r.type", "r.date", F.col("r.amount").cast("decimal(38,2)").alias("amount"), "r.currency")


def failing(spark: SparkSession, run) -> DataFrame:
    """What a run fails with: the line that its error names, or -1 if it does not fail."""
    try:
        run()
    except Exception as e:  # noqa: BLE001  the failure is the result
        found = re.search(r"line (\d+): ([a-z]+)", str(e))
        return spark.createDataFrame([(int(found[1]), found[2])] if found else [(0, str(e)[:200])], "line bigint, what string")
    return spark.createDataFrame([(-1, "nothing")], "line bigint, what string")


@query("SELECT 777::bigint AS line, 'undecodable' AS what")
def abort_at_undecodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.overlay("record", F.unhex(F.lit("81")), 13, 1)
    records = order_records(spark, sf_dir).withColumn("record", F.when(F.col("line") == 777, bad).otherwise(F.col("record")))
    return failing(spark, lambda: values_of(validate(records, fixed(*ORDER_FIELDS, page="cp1252"))).write.format("noop").mode("overwrite").save())


@query("SELECT 5::bigint AS line, 'field' AS what UNION ALL SELECT 5, 'field'")
def on_error_raise_and_lazily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose fifth line has month 13, read by both ways that fail."""
    path = folder(spark)
    rows = order_records(spark, sf_dir).orderBy("line").limit(9).coalesce(1)
    bad = F.overlay("record", F.encode(F.lit("13"), "UTF-8"), 30, 2)
    rows.select(F.when(F.monotonically_increasing_id() == 4, bad).otherwise(F.col("record")).cast("string").alias("value")).write.text(path)
    now = failing(spark, lambda: read_flat(spark, path, ORDERS))
    return now.unionAll(failing(spark, lambda: read_flat(spark, path, ORDERS, on_error="fail_lazily").collect()))


@query("SELECT 'jde_ar.yaml' AS path, 75::bigint AS score, count(*) AS n FROM orders")
def detect_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file without a named layout: it is detected from the file's head and then read whole."""
    path = folder(spark)
    order_records(spark, sf_dir, width=8).select(F.col("record").cast("string").alias("value")).coalesce(1).write.text(path)
    found = detect(spark, path)
    return read_flat(spark, path).agg(F.lit(found.path.rsplit("/", 1)[-1]).alias("path"), F.lit(found.score).cast("bigint").alias("score"), F.count("*").alias("n"))


@query("SELECT 'rule ''sum:amount'': total ' || sum(o_totalprice::decimal(38,2)) || ' != expected 1' AS message FROM orders")
def check_rules_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = with_rules({"type": "sum", "field": "amount", "expected": 1})
    rows = values_of(validate(order_records(spark, sf_dir), layout))
    return spark.createDataFrame([(v.message,) for v in rule_ops.check_rules(rows, layout)], "message string")


FRAMED = load_layout(f"{EXAMPLES}/framed.yaml")


@query("SELECT lpad((o_orderkey % 10000)::varchar, 4, '0') AS id, strftime(o_orderdate, '%Y-%m-%d') AS \"date\", (((o_totalprice::decimal(38,2) * 100)::bigint % 100000000) * 0.01)::decimal(38,2) AS amt FROM orders")
def framed_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example layout of frames, by its parser's name."""
    path = folder(spark)
    amount = F.lpad((cents().cast("bigint") % 100_000_000).cast("string"), 8, " ")
    rows = table(spark, sf_dir, "orders").select(F.lit(0).alias("f"), F.encode(F.concat(F.lpad((k() % 10_000).cast("string"), 4, "0"), day(), amount), "ISO-8859-1").alias("r"))
    rows.repartition(1).mapInArrow(frame_writer(path), "n bigint").count()
    return values_of(validate(scan(spark, path, FRAMED), FRAMED))
