"""Reading physical plans: exchanges, join strategies, what a scan reads."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.session import scoped_conf

_JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")
MODES = ("simple", "extended", "codegen", "cost", "formatted")


@dataclass
class PlanReport:
    text: str
    exchanges: int = 0
    exchange_kinds: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    read_schemas: list[str] = field(default_factory=list)
    pushed_filters: list[str] = field(default_factory=list)
    partition_filters: list[str] = field(default_factory=list)
    selected_buckets: list[str] = field(default_factory=list)
    partial_aggregate: bool = False
    bounded_sort: bool = False
    python: bool = False


def physical_plan(df: DataFrame) -> str:
    """The plan as it stands before adaptive execution changes it."""
    spark = df.sparkSession
    with scoped_conf(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.maxMetadataStringLength": "10000"}):
        again = spark._jsparkSession.sessionState().executePlan(df._jdf.queryExecution().logical(), df._jdf.queryExecution().mode())
        return again.executedPlan().toString()


def inspect_plan(df: DataFrame) -> PlanReport:
    text = physical_plan(df)
    kinds = re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (\w+)", text)
    return PlanReport(
        text=text,
        exchanges=len(kinds),
        exchange_kinds=kinds,
        joins=re.findall("|".join(_JOINS), text),
        read_schemas=re.findall(r"ReadSchema: struct<(.*?)>(?:,|\n|$)", text),
        pushed_filters=re.findall(r"PushedFilters: \[(.*?)\]", text),
        partition_filters=re.findall(r"PartitionFilters: \[(.*?)\]", text),
        selected_buckets=re.findall(r"SelectedBucketsCount: (\d+ out of \d+)", text),
        partial_aggregate="partial_" in text,
        bounded_sort="TakeOrderedAndProject" in text,
        python=bool(re.search(r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|FlatMapGroups", text)),
    )


def classify_join(report: PlanReport) -> str:
    """co-located (no exchange), broadcast, co-partitioned or shuffled."""
    if not report.exchanges:
        return "broadcast" if any(j.startswith("Broadcast") for j in report.joins) else "co-located"
    hashed = re.findall(r"Exchange hashpartitioning\(.*?\), (\w+)", report.text)
    return "co-partitioned" if hashed and "ENSURE_REQUIREMENTS" not in hashed else "shuffled"


def explain(df: DataFrame, mode: str = "formatted") -> None:
    if mode not in MODES:
        raise ValueError(f"one of {MODES}")
    df.explain(mode)
