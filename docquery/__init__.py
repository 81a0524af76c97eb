"""A document query engine on Spark: filters, pipelines, expressions, modifiers, text and vector search over DataFrames."""

from docquery.operators.query import Collection, aggregate, find
from docquery.plans.expressions import OPERATORS as _EXPRESSIONS
from docquery.plans.filters import MODIFIERS, OPERATORS
from docquery.plans.pipelines import ACCUMULATORS, STAGES

__all__ = ["Collection", "aggregate", "expression_operators", "find", "operators", "modifier_operators", "aggregate_stages", "aggregate_accumulators"]


def operators() -> list[str]:
    return list(OPERATORS)


def modifier_operators() -> list[str]:
    return list(MODIFIERS)


def aggregate_stages() -> list[str]:
    return list(STAGES)


def aggregate_accumulators() -> list[str]:
    return list(ACCUMULATORS)


def expression_operators() -> list[str]:
    return [*_EXPRESSIONS, "$literal"]
