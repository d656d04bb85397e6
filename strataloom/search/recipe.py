"""The result of a search: a fitted pipeline that is an ordinary lazy DataFrame transformation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..gene import Gene, Individual
from ..plans.pipeline import apply_fitted
from ..registry import State, Target
from ..roles import ColumnRoles, normalise
from . import models


@dataclass
class Recipe:
    best: Individual
    states: dict[str, State]
    fitted: models.Fitted | None
    target: Target
    task: str
    metric: str = "default"
    evaluator: str = "lm"
    baseline_fitness: float | None = None
    holdout_fitness: float | None = None
    confirmation_fitness: float | None = None
    search_gap: float | None = None
    headroom_closed: float | None = None
    history: list[float] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)
    islands: list[Individual] = field(default_factory=list)
    problem: object = None

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the recipe's columns; no action runs, so streams work as well."""
        return apply_fitted(self.best, normalise(df, self.best.roles), self.states)

    def features(self, df: DataFrame, *keep: str) -> DataFrame:
        return self.transform(df).select(*keep, *self.best.features)

    def predict(self, df: DataFrame, *keep: str) -> DataFrame:
        """Predictions ``p`` beside the ``keep`` columns; an array by class for multiclass tasks."""
        if self.fitted is None:
            raise ValueError("the recipe was loaded without a model; fit one with refit()")
        return self.fitted.predict(self.transform(df), *[F.col(c) for c in keep])

    def refit(self, df: DataFrame, **params) -> Recipe:
        """Train the evaluator's model again on ``df`` with the frozen features."""
        from ..registry import EVALUATORS
        from .evaluate import label_column

        data = self.transform(df).withColumn("__y", label_column(self.target, self.task))
        self.fitted = EVALUATORS[self.evaluator].fit(data, self.best.features, "__y", self.task, max(2, len(self.target.levels)), **params)
        return self

    def to_json(self) -> str:
        """Genes, roles and states; dictionaries too large for the driver have to be written as tables first."""
        if any(s.table is not None and s.rows is None and s.columns for s in self.states.values()):
            raise ValueError("a state is a table; save it with save()")
        states = {k: {"values": s.values, "columns": s.columns, "rows": s.rows, "valid": s.valid} for k, s in self.states.items()}
        genes = [{"transformer": g.transformer, "inputs": g.inputs, "params": g.options} for g in self.best.genes]
        roles = self.best.roles
        return json.dumps({"genes": genes, "roles": [roles.numeric, roles.categorical, roles.datetime], "active": self.best.active, "states": states, "task": self.task, "metric": str(self.metric), "evaluator": self.evaluator, "target": [self.target.column, self.target.kind, self.target.levels], "fitness": self.best.fitness})

    @staticmethod
    def from_json(text: str) -> Recipe:
        d = json.loads(text)
        genes = [Gene(g["transformer"], tuple(g["inputs"]), tuple(sorted(g["params"].items()))) for g in d["genes"]]
        best = Individual(genes, ColumnRoles(*d["roles"]), d["active"], fitness=d["fitness"])
        states = {k: State(values=s["values"], columns=s["columns"], rows=None if s["rows"] is None else [tuple(r) for r in s["rows"]], valid=s["valid"]) for k, s in d["states"].items()}
        return Recipe(best, states, None, Target(*d["target"]), d["task"], d["metric"], d["evaluator"])

    def save(self, spark: SparkSession, path: str) -> None:
        """JSON beside one table per large dictionary, and the model in Spark's own format."""
        for i, (k, s) in enumerate(self.states.items()):
            if s.table is not None and s.rows is None and s.columns:
                s.table.write.mode("overwrite").parquet(f"{path}/state-{i}")
                s.table = spark.read.parquet(f"{path}/state-{i}")
        small = {k: s for k, s in self.states.items() if s.rows is not None or s.table is None or not s.columns}
        kept = Recipe(self.best, small, None, self.target, self.task, self.metric, self.evaluator)
        large = {str(i): k for i, (k, s) in enumerate(self.states.items()) if k not in small}
        matrix = None if self.fitted is None else [self.fitted.matrix.means, self.fitted.matrix.codes, self.fitted.n_classes]
        inner = getattr(getattr(self.fitted, "model", None), "model", getattr(self.fitted, "model", None))
        columns = {k: self.states[k].columns for k in large.values()}
        values = {k: self.states[k].values for k in large.values()}
        spark.createDataFrame([(kept.to_json(), json.dumps([large, columns, values, matrix, f"{type(inner).__module__}.{type(inner).__name__}" if self.fitted else None, getattr(getattr(self.fitted, "model", None), "means", None)]))], "recipe string, more string").coalesce(1).write.mode("overwrite").parquet(f"{path}/recipe")
        if self.fitted is not None:
            inner.write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Recipe:
        import importlib

        row = spark.read.parquet(f"{path}/recipe").first()
        recipe = Recipe.from_json(row.recipe)
        large, columns, values, matrix, kind, means = json.loads(row.more)
        for i, k in large.items():
            recipe.states[k] = State(values=values[k], columns=columns[k], table=spark.read.parquet(f"{path}/state-{i}"))
        if kind:
            module, _, name = kind.rpartition(".")
            model = getattr(importlib.import_module(module), name).load(f"{path}/model")
            model = model if means is None else models.Binned(model, means)
            recipe.fitted = models.Fitted(models.Matrix(matrix[0], matrix[1]), model, recipe.task, matrix[2])
        return recipe

    def genes_table(self, spark: SparkSession) -> DataFrame:
        rows = [(g.output, g.transformer, list(g.inputs), json.dumps(g.options), g.formula, float(self.best.importances.get(g.output, 0.0))) for g in self.best.genes]
        return spark.createDataFrame(rows, "output string, transformer string, inputs array<string>, params string, formula string, importance double")

    def events(self, spark: SparkSession) -> DataFrame:
        """The search's log: one JSON message per event."""
        return spark.createDataFrame([(i, e.get("type", ""), json.dumps(e, default=str)) for i, e in enumerate(self.log)], "seq long, type string, message string")

    def importances_table(self, spark: SparkSession) -> DataFrame:
        """What a bar plot shows: features by falling importance."""
        rows = sorted(((n, float(v), n in {g.output for g in self.best.genes}) for n, v in self.best.importances.items()), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame(rows, "feature string, importance double, derived boolean")

    def history_table(self, spark: SparkSession) -> DataFrame:
        """What a line plot shows: the best fitness by generation, with the baseline."""
        base = None if self.baseline_fitness is None else float(self.baseline_fitness)
        return spark.createDataFrame([(i, float(f), base) for i, f in enumerate(self.history)], "generation int, best double, baseline double")

    def dependencies_table(self, spark: SparkSession) -> DataFrame:
        """What a graph shows: an edge from each input column to the column made of it."""
        rows = [(c, g.output, g.transformer) for g in self.best.genes for c in g.inputs]
        return spark.createDataFrame(rows, "source string, target string, transformer string")

    def view(self, path: str | None = None) -> str:
        """A page with the recipe, its importances and the search's log as JSON in it; written to ``path`` if given."""
        import html

        content = {"summary": self.summary(), "history": self.history, "importances": self.best.importances, "genes": [[g.output, g.formula] for g in self.best.genes], "log": self.log}
        raw = json.dumps(content, default=str).replace("</", "<\\/")
        top = sorted(self.best.importances.items(), key=lambda x: -x[1])
        most = max([v for _, v in top], default=1.0) or 1.0
        bars = "".join(f"<tr><td>{html.escape(n)}</td><td><div style='background:#4a7;height:1em;width:{300 * v / most:.0f}px'></div></td><td>{v:.4f}</td></tr>" for n, v in top)
        steps = "".join(f"<tr><td>{i}</td><td>{f:.6g}</td></tr>" for i, f in enumerate(self.history))
        page = f"<!doctype html><meta charset='utf-8'><title>Recipe</title><pre>{html.escape(self.summary())}</pre><table>{bars}</table><table>{steps}</table><script type='application/json' id='data'>{raw}</script>"
        if path:
            with open(path, "w", encoding="utf-8") as out:
                out.write(page)
        return page

    def summary(self) -> str:
        top = sorted(self.best.importances.items(), key=lambda x: -x[1])[:10]
        lines = [f"Recipe for {self.target.column} ({self.task}, {self.evaluator})", f"fitness {self.best.fitness} (baseline {self.baseline_fitness}, headroom closed {self.headroom_closed})", f"holdout {self.holdout_fitness}, confirmation {self.confirmation_fitness}, search gap {self.search_gap}", self.best.recipe_string]
        return "\n".join([*lines, *(f"  {n}: {v:.4f}" for n, v in top)])
