"""Record frames to validated frames.

A validated frame has ``source``, ``line``, ``ok``, ``errors`` (array of strings), ``undecodable`` and
``value``, a struct of the layout's fields. Projections of built-in expressions make it one after the
other: the text of the record, the texts of the fields, the stripped texts, the values. A text is
computed once, as each projection uses what the one below has made. The values pass a generator of one
row, through which the optimizer neither merges projections nor pushes filters, so that a filter on
``ok`` does not compute them again; ``ok`` looks at nulls only, and error texts are made for records
that fail, where they are asked for.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspark.functions import codepage
from flatspark.functions.values import date_error, date_value, decimal_error, decimal_value, lit, signed, strip, unsigned
from flatspark.plans.layout import Field, Layout


def why(i: int, field: Field, shown: str, strict_scale: bool) -> str:
    """The error of a text s_i without a value."""
    if field.type == "date":
        return date_error(f"s_{i}", shown, field.format)
    if field.type == "decimal":
        return decimal_error(f"s_{i}", shown, field.scale, strict_scale)
    return "CAST(null AS string)"


def validate(records: DataFrame, layout: Layout, on_decode_error: str = "abort", date_as: str = "string", strict_scale: bool = False) -> DataFrame:
    """Checks each record and converts its fields; errors are collected, not raised.

    Bytes that a fixed field cannot decode end the query (``abort``) or are an error of the field (``record``).
    """
    if on_decode_error not in ("abort", "record"):
        raise ValueError(f"unsupported on_decode_error: {on_decode_error!r}")
    fields = list(enumerate(layout.fields))
    cut, absent, before, after = (_split if layout.delimited else _sliced)(records, layout)
    kept = cut.columns
    bads = [c for c in kept if c.startswith("bad_")]
    # Each step names what the next one uses more than once.
    frame = cut.selectExpr(*kept, *(f"trim(t_{i}) AS p_{i}" for i, _ in fields))
    frame = frame.selectExpr(*kept, *(f"{strip(f'p_{i}')} AS s_{i}" for i, _ in fields))
    kept = [*kept, *(f"s_{i}" for i, _ in fields)]
    numbers = [(i, f) for i, f in fields if f.type == "decimal"]
    if numbers:
        frame = frame.selectExpr(*kept, *(f"{unsigned(f's_{i}')} AS b_{i}" for i, _ in numbers))
        frame = frame.selectExpr(*kept, *(f"{decimal_value(f'b_{i}', f.scale, strict_scale)} AS d_{i}" for i, f in numbers))
    made = []
    for i, f in fields:
        value = f"s_{i}"
        if f.type == "date":
            value = date_value(value, f.format, date_as == "date")
        elif f.type == "decimal":
            value = f"CAST({signed(f'd_{i}', value)} AS decimal(38,{f.scale}))"
        made.append(f"CASE WHEN NOT ({absent(i)}) THEN {value} END AS v_{i}")
    fits = " AND ".join(f"NOT ({wrong})" for wrong, _ in (*before, *after)) or "true"
    frame = frame.selectExpr(*kept, *made, f"{fits} AS fits")
    kept = [c for c in kept if c not in bads]
    frame = frame.selectExpr(*kept, f"inline(array(struct({', '.join(['fits', *bads, *(f'v_{i}' for i, _ in fields)])})))")

    bad = " OR ".join(bads) or "false"
    if bads and on_decode_error == "abort":
        # An undecodable byte must end the query also where only ok and the value are asked for.
        bad = f"CASE WHEN {bad} THEN CAST(raise_error(concat(source, ', line ', CAST(line AS string), ': undecodable bytes')) AS boolean) ELSE false END"
    good = " AND ".join(["fits", f"NOT ({bad})"] + [f"v_{i} IS NOT NULL" for i, _ in fields])
    errors = []
    for i, f in fields:
        cases = [f"WHEN {absent(i)} THEN " + ("concat('missing column (', CAST(size AS string), ' columns in line)')" if layout.delimited else "'out of range (short line)'")]
        if f"bad_{i}" in bads and on_decode_error == "record":
            cases.insert(0, f"WHEN bad_{i} THEN 'undecodable bytes'")
        shown = f"s_{i}" if layout.delimited else f"t_{i}"
        errors.append(f"concat({lit(f'field {chr(39)}{f.name}{chr(39)}: ')}, CASE {' '.join(cases)} WHEN v_{i} IS NULL THEN {why(i, f, shown, strict_scale)} END)")
    all_errors = [*(f"CASE WHEN {wrong} THEN {text} END" for wrong, text in before), *errors, *(f"CASE WHEN {wrong} THEN {text} END" for wrong, text in after)]
    value = f"named_struct({', '.join(f'{lit(f.name)}, v_{i}' for i, f in fields)}) AS value"
    frame = frame.selectExpr("source", "line", f"{good} AS ok", f"{bad} AS undecodable", value, *kept[2:], *bads, *(f"v_{i}" for i, _ in fields))
    return frame.selectExpr("source", "line", "ok", f"CASE WHEN ok THEN CAST(array() AS array<string>) ELSE filter(array({', '.join(all_errors)}), e -> e IS NOT NULL) END AS errors", "undecodable", "value")


def _sliced(records: DataFrame, layout: Layout):
    """Texts t_i of the fields, the size, and bad_i for fields whose bytes may not be decodable.

    With them go when field i is absent, and what may be wrong with the whole record (condition and text),
    told before and after the fields' errors.
    """
    for f in layout.fields:
        if f.start is None or f.length is None:
            raise ValueError(f"field '{f.name}' needs start and length to be sliced")
    pages = [f.codepage or layout.codepage for f in layout.fields]
    raw = [F.substring("record", f.start + 1, f.length) for f in layout.fields]
    absent = lambda i: f"size < {layout.fields[i].start + layout.fields[i].length}"
    whole = records.selectExpr("source", "line", "length(record) AS size", "record")
    if len({codepage.canonical(p) for p in pages}) == 1 and not codepage.is_utf8(pages[0]):
        # A byte is a character: the record is decoded once and sliced as text.
        whole = whole.select("*", codepage.decode(F.col("record"), pages[0]).alias("text"))
        texts = [F.expr(f"substring(text, {f.start + 1}, {f.length})") for f in layout.fields]
    else:
        texts = [codepage.decode(r, p) for r, p in zip(raw, pages)]
    # Whether strict decoding can fail at all is known from the page.
    bads = [(codepage.undecodable(raw[i], p) & ~F.expr(absent(i))).alias(f"bad_{i}") for i, p in enumerate(pages) if codepage.is_utf8(p) or codepage.LOST in codepage.byte_table(p)]
    cut = whole.select("source", "line", "size", *(t.alias(f"t_{i}") for i, t in enumerate(texts)), *bads)
    length = f"concat('length ', CAST(size AS string), ' != record_length {layout.record_length}')"
    return cut, absent, [(f"size != {layout.record_length}", length)] if layout.record_length is not None else [], []


def _split(records: DataFrame, layout: Layout):
    """The same of delimited records; the size is the number of columns, and errors show stripped texts."""
    n = len(layout.fields)
    apart = re.sub(r"([^A-Za-z0-9\s])", r"\\\1", layout.delimiter)
    parts = records.select("source", "line", F.split(codepage.decode(F.col("record"), layout.codepage), apart, -1).alias("parts"))
    cut = parts.selectExpr("source", "line", "size(parts) AS size", *(f"get(parts, {i}) AS t_{i}" for i in range(n)))
    return cut, lambda i: f"size <= {i}", [], [(f"size > {n}", f"concat(CAST(size AS string), ' columns in line, schema expects {n}')")]


def accepted(validated: DataFrame) -> DataFrame:
    """source, line and the fields of the valid records."""
    return validated.where("ok")


def values_of(validated: DataFrame) -> DataFrame:
    """The layout's columns of the valid records."""
    return validated.where("ok").select("value.*")


def rejects(validated: DataFrame) -> DataFrame:
    """source, line and joined errors of the other records."""
    return validated.where("NOT ok").select("source", "line", F.array_join("errors", "; ").alias("error"))


def diagnostics(validated: DataFrame) -> DataFrame:
    """A line of text for each record."""
    found = F.when(F.size("errors") > 0, F.concat(F.lit(" ["), F.array_join("errors", "; "), F.lit("]"))).otherwise("")
    return validated.select("source", "line", F.concat(F.lit("  line "), F.col("line").cast("string"), F.lit(": "), F.when(F.col("ok"), "OK").otherwise("ERR"), found).alias("text"))
