"""Some queries of the catalogue against DuckDB; the others differ in their records only."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__
from flatspark.plans import catalogue

CHOSEN = ["fixed_parse_ok", "fixed_rejects", "implied_vs_explicit_scale", "undecodable_records", "delimited_extra_column", "line_numbers", "on_error_ignore", "detect_layout", "infer_schema", "infer_schema_whole_file", "library_layouts", "convert_to_folder", "abort_at_undecodable", "on_error_raise_and_lazily", "framed_example", "sql_insert_statements", "framed_parse", "registry_listing", "streaming_parse"]


def plain(value):
    return str(value.normalize()) if isinstance(value, decimal.Decimal) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = catalogue.QUERIES[name](spark, sf)
    want = db.execute(catalogue.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_every_catalogue_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()
    assert catalogue.QUERIES.keys() <= __spark_entry__.queries().keys()


def test_hot_path_has_no_python(spark, sf):
    plan = catalogue.parse_orders_fixed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_file_under_header_is_written_by_many_tasks(spark, sf):
    """One file, its header first, with all rows, though no task has all of them to write."""
    spark.sparkContext.setJobGroup("written", "written")
    try:
        path = catalogue.with_header(spark, sf, ";")
    finally:
        spark.sparkContext.setJobGroup("", "")
    seen = spark.sparkContext.statusTracker()
    assert max(seen.getStageInfo(i).numTasks for job in seen.getJobIdsForGroup("written") for i in seen.getJobInfo(job).stageIds) > 1
    with open(path.removeprefix("file:")) as f:
        lines = f.read().split("\n")
    keys = [r.o_orderkey for r in catalogue.table(spark, sf, "orders").select("o_orderkey").collect()]
    assert lines[0] == "id;date;amount;status" and [r.split(";")[0] for r in lines[1:]] == [*map(str, keys), ""]
