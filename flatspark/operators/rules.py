"""Control totals and run statistics, all from one aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flatspark.plans.layout import Layout


@dataclass(frozen=True)
class Violation:
    rule: dict
    message: str


@dataclass(frozen=True)
class Report:
    total: int
    ok: int
    errors: int
    violations: list[Violation]


def _summed(layout: Layout) -> list[str]:
    """Decimal fields that a rule names; others contribute nothing."""
    wanted = {rule.get(k) for rule in layout.rules or () for k in ("field", "positive", "negative")}
    return [f.name for f in layout.fields if f.type == "decimal" and f.name in wanted]


def measures(layout: Layout) -> list:
    """Aggregates over a validated frame; a total that does not fit decimal(38) is null."""
    sums = [F.try_sum(F.when(F.col("ok"), F.col("value").getField(name))).alias(f"sum_{i}") for i, name in enumerate(_summed(layout))]
    terms = [F.count_if(F.col("ok") & F.col("value").getField(name).isNotNull()).alias(f"terms_{i}") for i, name in enumerate(_summed(layout))]
    return [F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("errors"), *sums, *terms]


def judge(layout: Layout, row: dict) -> Report:
    totals: dict[str, Decimal | None] = {}
    for i, name in enumerate(_summed(layout)):
        totals[name] = row[f"sum_{i}"] if row[f"terms_{i}"] else Decimal(0)
    found = []
    for rule in layout.rules or ():
        if rule["type"] == "sum":
            name, expected = rule["field"], Decimal(str(rule["expected"]))
            got = totals.get(name, Decimal(0))
            if got is None or got != expected:
                found.append(Violation(rule, f"rule 'sum:{name}': total {'overflow' if got is None else got} != expected {expected}"))
        elif rule["type"] == "balance":
            plus, minus = rule["positive"], rule["negative"]
            a, b = totals.get(plus, Decimal(0)), totals.get(minus, Decimal(0))
            if a is None or b is None or a != b:
                gap = "overflow" if a is None or b is None else a - b
                found.append(Violation(rule, f"rule 'balance:{plus}/{minus}': {plus}={a} != {minus}={b} (diff {gap})"))
    return Report(row["total"], row["ok"], row["errors"], found)


def check(validated: DataFrame, layout: Layout) -> Report:
    """Counts and rule violations of a validated frame."""
    return judge(layout, validated.agg(*measures(layout)).first().asDict())


def observed(validated: DataFrame, layout: Layout) -> tuple[DataFrame, Observation]:
    """The frame with its measures taken by the job that writes it."""
    seen = Observation()
    return validated.observe(seen, *measures(layout)), seen


def check_rules(rows: DataFrame, layout: Layout) -> list[Violation]:
    """Rules over a frame of the layout's columns."""
    frame = rows.select(F.lit(True).alias("ok"), F.struct(*(F.col(f.name) for f in layout.fields)).alias("value"))
    return check(frame, layout).violations


def violations_frame(validated: DataFrame, layout: Layout) -> DataFrame:
    """rule and message, a row for each violation."""
    found = check(validated, layout).violations
    return validated.sparkSession.createDataFrame([(v.rule["type"], v.message) for v in found], "rule string, message string")
