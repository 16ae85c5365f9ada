"""Ordered thresholds as expressions generated from the tables in :mod:`tidemark.config`."""

from __future__ import annotations

import operator

from pyspark.sql import Column, functions as F

from tidemark.config import THRESHOLDS

_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def threshold_label(value: Column, metric: str) -> Column:
    """Label of a value under one metric's rules; null stays null."""
    rules, other = THRESHOLDS[metric]
    expr = F.when(value.isNull(), None)
    for op, bound, label in rules:
        expr = expr.when(_OPS[op](value, F.lit(bound)), label)
    return expr.otherwise(other)


def label_by_metric(metric: Column, value: Column) -> Column:
    """Label of a value whose metric is itself a column."""
    expr = None
    for name in THRESHOLDS:
        label = threshold_label(value, name)
        expr = F.when(metric == name, label) if expr is None else expr.when(metric == name, label)
    return expr


def threshold_sql(value: str, metric: str) -> str:
    """The same rules as SQL text."""
    rules, other = THRESHOLDS[metric]
    body = " ".join(f"WHEN {value} {op} {bound} THEN '{label}'" for op, bound, label in rules)
    return f"CASE WHEN {value} IS NULL THEN NULL {body} ELSE '{other}' END"
