"""Registries that users extend: transformers, evaluators and metrics by name."""

from __future__ import annotations

import warnings
from abc import ABC
from collections.abc import Callable
from dataclasses import dataclass, field
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gene import Gene


#: Classes that a label can have.
MAX_LEVELS = 1000


@dataclass
class Target:
    """The label column as encoders see it."""

    column: str
    kind: str = "numeric"
    levels: list = field(default_factory=list)

    @staticmethod
    def of(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> Target:
        """Numbers of more than ``max_levels`` values have no classes; other labels of so many are an error."""
        kind = dict(df.dtypes)[column]
        levels = [r[0] for r in df.select(F.col(f"`{column}`")).where(F.col(f"`{column}`").isNotNull()).distinct().limit(max_levels + 1).collect()]
        numeric = kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")
        if len(levels) > max_levels:
            if not numeric:
                raise ValueError(f"{column} has more than {max_levels} classes")
            levels = []
        return Target(column, "numeric" if numeric else "discrete", sorted(levels))

    def value(self) -> Column | None:
        """The label as a number: as it is, or 1 for the larger of two levels; null if it has no such form."""
        c = F.col(f"`{self.column}`")
        if self.kind == "numeric":
            return c.cast("double")
        if len(self.levels) > 2 or not self.levels:
            return None
        return (c == F.lit(self.levels[-1])).cast("double")


@dataclass
class State:
    """What a fit leaves: plain values, and for dictionaries rows by key (local if small, else a table)."""

    values: dict = field(default_factory=dict)
    keys: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] | None = None
    table: DataFrame | None = None
    valid: bool = True


class Transformer(ABC):
    """One derived column. What a fit needs is declared, so that a recipe's fits share scans:
    ``totals`` in one aggregate over all rows, ``grouped`` in one aggregate per ``key``."""

    name: str = ""
    arity: str = "unary"
    input_type: str = "numeric"
    output_type: str = "numeric"
    allow_replace: bool = False
    needs_target: bool = False
    n_inputs: tuple[int, int] = (1, 1)

    def sample_params(self, rng: Random, n_inputs: int) -> dict:
        return {}

    def components(self, gene: Gene) -> list[int]:
        """Components that are added together; none for a single column."""
        return []

    def totals(self, gene: Gene, target: Target | None) -> dict[str, Column]:
        return {}

    def key(self, gene: Gene) -> Column | None:
        return None

    def grouped(self, gene: Gene, target: Target | None) -> dict[str, Column]:
        return {}

    def finish(self, gene: Gene, totals: dict, groups: DataFrame | None, target: Target | None) -> State:
        """The state from the aggregates."""
        return State(values=totals)

    def fit(self, df: DataFrame, gene: Gene, target: Target | None) -> State | None:
        """A fit of its own, where aggregates aren't enough; None to use them."""
        return None

    def column(self, gene: Gene, state: State, found: dict[str, Column]) -> Column:
        """The derived column; ``found`` has the dictionary's columns for the row's key."""
        raise NotImplementedError

    def apply(self, df: DataFrame, gene: Gene, state: State) -> DataFrame | None:
        """An apply of its own, where a column expression isn't enough; None to use ``column``."""
        return None


TRANSFORMERS: dict[str, Transformer] = {}
EVALUATORS: dict[str, object] = {}
METRICS: dict[str, Callable] = {}


def register_transformer(transformer: Transformer) -> Transformer:
    if transformer.name in TRANSFORMERS:
        warnings.warn(f"transformer {transformer.name!r} is replaced", stacklevel=2)
    TRANSFORMERS[transformer.name] = transformer
    return transformer


def create_transformer(name: str, arity: str, column: Callable[[Gene, State], Column], input_type: str = "numeric", output_type: str = "numeric", fit: Callable | None = None, allow_replace: bool = False, n_inputs: tuple[int, int] | None = None) -> Transformer:
    """A transformer from functions: ``column(gene, state)`` gives the derived column, ``fit(df, gene, target)`` a State."""
    made = type(f"User_{name}", (Transformer,), {"column": lambda self, gene, state, found: column(gene, state), "fit": lambda self, df, gene, target: fit(df, gene, target) if fit else None})()
    made.name, made.arity, made.input_type, made.output_type, made.allow_replace = name, arity, input_type, output_type, allow_replace
    made.n_inputs = n_inputs or ((2, 2) if "binary" in arity else (2, 5) if arity == "multivariate" else (1, 1))
    return made


def register_evaluator(name: str, evaluator) -> None:
    if name in EVALUATORS:
        warnings.warn(f"evaluator {name!r} is replaced", stacklevel=2)
    EVALUATORS[name] = evaluator


def register_metric(name: str, function: Callable) -> None:
    METRICS[name] = function


def number(c: str) -> Column:
    """An input column as a double; what isn't a number is null."""
    return F.col(f"`{c}`").try_cast("double")


def text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def fill(x: Column, default) -> Column:
    """``x`` with null, NaN and infinities as ``default``."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(F.coalesce(x, F.lit(default)))
