"""Conversion of field texts to strings, dates and decimals, with the error of each.

All are SQL expressions of column names as text: a layout of many fields is then built with few calls
to the JVM. A name is that of a column with a stripped text, unless stated otherwise.
"""

from __future__ import annotations

#: What counts as white space at either end of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE_FORMAT = "YYYYMMDD"
PLAIN = r"\A[+-]?[0-9]+\z"
EIGHT = r"\A[0-9]{8}\z"


def lit(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(spaced: str) -> str:
    """A text without white space at its ends; its spaces have gone already (``trim``), which mostly is all."""
    plain = " AND ".join(f"ascii({c}) BETWEEN 33 AND 126" for c in (spaced, f"substring({spaced}, -1, 1)"))
    return f"CASE WHEN {plain} THEN {spaced} ELSE btrim({spaced}, {lit(BLANKS)}) END"


def quoted(text: str) -> str:
    """The text as a quoted literal: double quotes only if it has single quotes alone."""
    t = text
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        t = f"replace({t}, {lit(raw)}, {lit(shown)})"
    single, double = lit("'"), lit('"')
    return f"CASE WHEN contains({text}, {single}) AND NOT contains({text}, {double}) THEN concat({double}, {t}, {double}) ELSE concat({single}, replace({t}, {single}, {lit(chr(92) + chr(39))}), {single}) END"


def date_value(text: str, fmt: str | None, as_date: bool = False) -> str:
    """The ISO string (or date) of a YYYYMMDD text that names a day, else null; other formats have no value."""
    if fmt != DATE_FORMAT:
        return f"CAST(null AS {'date' if as_date else 'string'})"
    iso = f"concat(substring({text}, 1, 4), '-', substring({text}, 5, 2), '-', substring({text}, 7, 2))"
    day = f"try_cast({iso} AS date)"
    return f"CASE WHEN {text} RLIKE {lit(EIGHT)} AND {text} >= '0001' AND {day} IS NOT NULL THEN {day if as_date else iso} END"


def date_error(text: str, shown: str, fmt: str | None) -> str:
    """Why a text has no date; ``shown`` is the text as it stands in the record."""
    if fmt != DATE_FORMAT:
        return lit(f"unsupported date format: {fmt!r}")
    month = f"substring({text}, 5, 2)"
    reason = f"CASE WHEN {text} < '0001' THEN 'year 0 is out of range' WHEN {month} < '01' OR {month} > '12' THEN 'month must be in 1..12' ELSE 'day is out of range for month' END"
    return f"concat('invalid date ', {quoted(shown)}, CASE WHEN {text} RLIKE {lit(EIGHT)} THEN concat(': ', {reason}) ELSE {lit(f' (expected {DATE_FORMAT})')} END)"


def unsigned(text: str) -> str:
    """A number's text without its trailing sign and its underscores."""
    return f"replace(CASE WHEN endswith({text}, '-') THEN btrim(substring({text}, 1, length({text}) - 1), {lit(BLANKS)}) ELSE {text} END, '_')"


def decimal_value(body: str, scale: int, strict_scale: bool = False) -> str:
    """decimal(38, scale) of an :func:`unsigned` number, else null.

    A text without a point has its point put ``scale`` digits from the right; one with a point keeps it,
    and further digits are rounded half up (or have no value if ``strict_scale``).
    """
    kind = f"decimal(38,{scale})"
    moved = f"concat(regexp_extract({body}, '^([+-]?[0-9]*)', 1), 'E', CAST(try_cast(regexp_extract({body}, '[eE]([+-]?[0-9]+)$', 1) AS int) - {scale} AS string))"
    pointed = f"try_cast({body} AS {kind})"
    if strict_scale:
        pointed = f"CASE WHEN length(regexp_extract({body}, '[.]([0-9]*)', 1)) <= {scale} THEN {pointed} END"
    other = f"CASE WHEN {body} RLIKE {lit(NUMBER)} THEN CASE WHEN contains({body}, '.') THEN {pointed} ELSE try_cast({moved} AS {kind}) END END"
    return f"CASE WHEN {body} RLIKE {lit(PLAIN)} THEN try_cast(concat({body}, 'E-{scale}') AS {kind}) ELSE {other} END"


def signed(value: str, text: str) -> str:
    """The decimal with the trailing sign of its text."""
    return f"CASE WHEN endswith({text}, '-') THEN -{value} ELSE {value} END"


def decimal_error(text: str, shown: str, scale: int, strict_scale: bool = False) -> str:
    """Why a text has no decimal."""
    wrong = f"concat('invalid decimal ', {quoted(shown)})"
    if strict_scale:
        wrong = f"CASE WHEN ({decimal_value(unsigned(text), scale)}) IS NOT NULL THEN concat({lit(f'more than {scale} decimals in ')}, {quoted(shown)}) ELSE {wrong} END"
    return f"CASE WHEN {text} = '' THEN 'empty decimal' ELSE {wrong} END"
