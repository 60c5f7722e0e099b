"""Layouts: what a YAML file says about a flat file, checked as a whole."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import types as T

from flatspark.functions.codepage import SUPPORTED, canonical

TYPES = ("string", "date", "decimal")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
LIBRARY = str(Path(__file__).with_name("library"))
EXAMPLES = str(Path(__file__).with_name("examples"))


class LayoutError(ValueError):
    """A layout that cannot be used; the message lists everything wrong with it."""


@dataclass(frozen=True)
class Field:
    name: str
    start: int | None = None
    length: int | None = None
    type: str = "string"
    format: str | None = None
    scale: int = 0
    align: str = "left"
    codepage: str | None = None

    def spark_type(self, date_as: str = "string") -> T.DataType:
        if self.type == "decimal":
            return T.DecimalType(38, self.scale)
        return T.DateType() if self.type == "date" and date_as == "date" else T.StringType()


@dataclass(frozen=True)
class Layout:
    format: str
    version: Any
    fields: tuple[Field, ...]
    record_length: int | None = None
    codepage: str = "utf-8"
    delimiter: str | None = None
    has_header: bool | None = None
    parser: str | None = None
    description: str | None = None
    table: str | None = None
    rules: tuple[dict, ...] | None = None
    path: str | None = None

    @property
    def delimited(self) -> bool:
        """Records without a length or a plugin are split, not sliced."""
        return self.parser is None and self.record_length is None

    def struct(self, date_as: str = "string") -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type(date_as), True, {k: v for k, v in vars(f).items() if k not in ("name", "type") and v is not None}) for f in self.fields])


def load_layout(path: str, strict: bool = False) -> Layout:
    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise LayoutError(f"{path}: not valid YAML: {e}") from e
    if not isinstance(data, dict):
        raise LayoutError(f"{path}: schema root must be a mapping")
    return build_layout(data, path, strict)


def _whole(value: Any, least: int) -> bool:
    return isinstance(value, int) and value >= least


class _Checker:
    """Collects what is wrong with a mapping while it builds the layout."""

    def __init__(self, data: dict[str, Any], strict: bool):
        self.data, self.strict, self.wrong = data, strict, []
        self.delimited = data.get("format") == "delimited"

    def need(self, good: bool, message: str) -> bool:
        if not good:
            self.wrong.append(message)
        return good

    def rules(self) -> tuple[dict, ...] | None:
        given = self.data.get("rules")
        if given is None or not self.need(isinstance(given, list), "rules must be a list"):
            return None
        keys = {"sum": ("field", "expected"), "balance": ("positive", "negative")}
        kept = []
        for i, rule in enumerate(given):
            if not self.need(isinstance(rule, dict), f"rules[{i}]: must be a mapping"):
                continue
            kind = rule.get("type")
            if self.need(kind in keys, f"rules[{i}]: unsupported rule type {kind!r}"):
                for key in keys[kind]:
                    self.need(key in rule, f"rules[{i}]: '{kind}' rule requires '{key}'")
            kept.append(rule)
        return tuple(kept)

    def shape(self) -> dict[str, Any]:
        """Delimiter, header and record length by family."""
        d, plugin, length = self.data, self.data.get("parser"), self.data.get("record_length")
        self.need(plugin is None or isinstance(plugin, str), "parser must be a string (plugin module name)")
        self.need(plugin is None or not self.delimited, "parser cannot be combined with delimited format")
        if self.delimited:
            delimiter, header = d.get("delimiter", ","), d.get("has_header", False)
            self.need(isinstance(delimiter, str) and delimiter != "", "delimiter must be a non-empty string")
            self.need(isinstance(header, bool), "has_header must be a boolean")
            self.need(length is None, "record_length is not allowed for delimited format")
            return {"delimiter": delimiter, "has_header": header}
        if plugin is None and self.need(length is not None, "missing required field 'record_length'"):
            self.need(_whole(length, 1), f"record_length must be int > 0 (got {length!r})")
        return {"record_length": length}

    def field(self, i: int, raw: Any, seen: set[str]) -> Field | None:
        if not self.need(isinstance(raw, dict), f"fields[{i}]: must be a mapping"):
            return None
        name = raw.get("name")
        if not self.need(isinstance(name, str) and name != "", f"fields[{i}]: missing 'name'"):
            name = f"field_{i}"
        at = f"fields[{i}] '{name}'"
        self.need(name not in seen, f"{at}: duplicate name")
        seen.add(name)
        kind, align, scale, page = raw.get("type", "string"), raw.get("align", "left"), raw.get("scale", 0), raw.get("codepage")
        self.need(kind in TYPES, f"{at}: unsupported type {kind!r}")
        self.need(align in ("left", "right"), f"{at}: unsupported align {align!r}")
        self.need(_whole(scale, 0), f"{at}: scale must be int >= 0")
        self.need(kind != "date" or raw.get("format") is not None, f"{at}: type date requires 'format'")
        start, length = raw.get("start"), raw.get("length")
        if self.delimited:
            self.need("start" not in raw and "length" not in raw, f"{at}: start/length not allowed for delimited format")
            start = length = None
        elif self.data.get("parser") is None:
            placed = self.need(_whole(start, 0), f"{at}: start must be int >= 0")
            sized = self.need(_whole(length, 1), f"{at}: length must be int > 0")
            room = self.data.get("record_length")
            if placed and sized and isinstance(room, int):
                self.need(start + length <= room, f"{at}: overflows record_length ({start}+{length}>{room})")
            start, length = start if placed else -1, length if sized else 0
        if self.strict:
            try:
                canonical(page or "utf-8")
            except LookupError:
                self.need(False, f"{at}: unknown code page {page!r}")
            self.need(kind != "date" or raw.get("format") in (None, "YYYYMMDD"), f"{at}: unsupported date format {raw.get('format')!r}")
        return Field(name, start, length, kind, raw.get("format"), scale if isinstance(scale, int) else 0, align, page)

    def overlaps(self, fields: list[Field]) -> None:
        placed = [f for f in fields if f.start is not None and f.length and f.start >= 0]
        for i, a in enumerate(placed):
            for b in placed[i + 1 :]:
                self.need(a.start + a.length <= b.start or b.start + b.length <= a.start, f"fields '{a.name}' and '{b.name}' overlap")


def build_layout(data: dict[str, Any], path: str | None = None, strict: bool = False) -> Layout:
    """A layout from a mapping; ``strict`` also refuses what would only fail record by record."""
    c = _Checker(data, strict)
    rules = c.rules()
    for key in ("format", "version"):
        c.need(data.get(key) is not None, f"missing required field '{key}'")
    shape = c.shape()
    page, table, given = data.get("codepage", "utf-8"), data.get("table"), data.get("fields")
    c.need(page in SUPPORTED, f"unsupported codepage: {page!r}")
    c.need(isinstance(given, list) and bool(given), "fields must be a non-empty list")
    c.need(table is None or IDENTIFIER.fullmatch(str(table)) is not None, f"invalid SQL table name: {table!r}")
    seen: set[str] = set()
    fields = [f for i, raw in enumerate(given if isinstance(given, list) else []) if (f := c.field(i, raw, seen))]
    if not c.delimited:
        c.overlaps(fields)
    if strict:
        for rule in rules or ():
            for key in ("field", "positive", "negative"):
                c.need(key not in rule or rule[key] in seen, f"rule names an unknown field {rule.get(key)!r}")
    if c.wrong:
        raise LayoutError("; ".join(c.wrong))
    return Layout(data["format"], data["version"], tuple(fields), codepage=page, parser=data.get("parser"), description=data.get("description"), table=table, rules=rules, path=path, **shape)
