"""Field conversion and code pages."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from flatspark.functions import codepage
from flatspark.operators.validate import validate
from flatspark.plans.layout import build_layout
from flatspark.sources.lines import from_frame


def run(spark, texts, field, strict=False):
    """(value, error) of each text in a delimited field."""
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    lay = build_layout({"format": "delimited", "version": 1, "delimiter": "|", "fields": [{"name": "f", **field}]})
    got = validate(from_frame(frame, "t", "i"), lay, strict_scale=strict).orderBy("line").collect()
    return [(r.value.f, r.errors[0].removeprefix("field 'f': ") if r.errors else None) for r in got]


DATE = {"type": "date", "format": "YYYYMMDD"}
MONEY = {"type": "decimal", "scale": 2}


def test_dates(spark):
    texts = ["20250115", " 20240229 ", "20230229", "20251301", "2025-01-15", "", "00000101", "2025011a", "20250100"]
    got = run(spark, texts, DATE)
    for text, (value, error) in zip(texts, got):
        try:
            want = datetime.datetime.strptime(text.strip(), "%Y%m%d").date().isoformat() if len(text.strip()) == 8 else None
        except ValueError:
            want = None
        assert value == want and (error is None) == (want is not None), text
    assert got[4][1] == "invalid date '2025-01-15' (expected YYYYMMDD)"
    assert got[3][1] == "invalid date '20251301': month must be in 1..12"


def test_unknown_date_format(spark):
    assert run(spark, ["20250115"], {"type": "date", "format": "DDMMYYYY"}) == [(None, "unsupported date format: 'DDMMYYYY'")]


@pytest.mark.parametrize(
    "text,want",
    [("12345", "123.45"), ("12345-", "-123.45"), ("-5-", "0.05"), ("1.5", "1.50"), (".5", "0.50"), ("5.", "5.00"), ("1E5", "1000.00"), ("1_000", "10.00"), ("+7", "0.07"), ("1.235", "1.24"), ("000000", "0.00")],
)
def test_decimals(spark, text, want):
    assert run(spark, [text], MONEY) == [(decimal.Decimal(want), None)]


@pytest.mark.parametrize("text", ["", "   ", "12X4", "NaN", "Infinity", "1,000", "$5", "--5", "1e999", "9" * 60])
def test_bad_decimals(spark, text):
    ((value, error),) = run(spark, [text], MONEY)
    assert value is None and error.startswith("empty decimal" if not text.strip() else "invalid decimal")


def test_strict_scale(spark):
    ((value, error),) = run(spark, ["1.235"], MONEY, True)
    assert value is None and error == "more than 2 decimals in '1.235'"


def test_strip_is_unicode(spark):
    texts = ["　a b ", "\x1f\tx\r\n", "​z", "", " "]
    assert [v for v, _ in run(spark, texts, {"type": "string"})] == [t.strip() for t in texts]


@pytest.mark.parametrize("page,name", [("cp850", "cp850"), ("cp1252", "cp1252"), ("latin-1", "latin-1"), ("ebcdic-cp037", "cp037")])
def test_every_byte_of_a_page(spark, page, name):
    frame = spark.createDataFrame([(bytearray(range(256)),)], "b binary")
    text, bad = frame.select(codepage.decode(F.col("b"), page), codepage.undecodable(F.col("b"), page)).first()
    assert text == bytes(range(256)).decode(name, "replace")
    assert bad == (name == "cp1252")


def test_utf8(spark):
    samples = [b"caf\xc3\xa9", b"\xff\xfea", b"\xe2\x82", b""]
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(samples)], "i int, b binary").orderBy("i")
    got = frame.select(codepage.decode(F.col("b"), "utf-8"), codepage.undecodable(F.col("b"), "utf-8")).collect()
    assert [tuple(r) for r in got] == [(b.decode("utf-8", "replace"), b != b.decode("utf-8", "replace").encode()) for b in samples]
