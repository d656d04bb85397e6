"""Topologies, policies, genetics, metrics, and a search from end to end."""

import math
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import metrics
from strataloom.gene import Gene, create_gene, create_individual, topological_order
from strataloom.plans import folds
from strataloom.registry import EVALUATORS, Target
from strataloom.roles import ColumnRoles, infer_roles
from strataloom.search import genetics, policy, topology
from strataloom.search.ensemble import ensemble_islands, stack_weights
from strataloom.search.evolve import evolve_features
from strataloom.search.recipe import Recipe
from strataloom.search.tuning import optimise

ROLES = ColumnRoles(["a", "b"], ["c", "d"], [])


def test_topologies():
    assert topology.ring(3).edges() == [(1, 2), (2, 3), (3, 1)]
    assert [len(p) for p in topology.tiered(10, 3).tiers] == [6, 3, 1]
    assert sorted(topology.torus(9).out(1)) == [2, 3, 4, 7]
    assert sorted(topology.grid(9).out(5)) == [2, 4, 6, 8]
    assert topology.hypercube(8).out(1) == [2, 3, 5]
    assert topology.custom([[0, 1], [0, 0]]).into(2) == [1]
    assert topology.ring(1).edges() == []
    with pytest.raises(ValueError):
        topology.ring(0)


def test_policies():
    state = policy.IslandState([0.5, 0.9, None], [0, 4, 9], [{"x"}, {"x", "y"}, set()])
    assert sum(policy.gibbs_weights(1, [2, 3], "fitness", 0.5, state, True)) == pytest.approx(1)
    assert policy.gibbs_weights(1, [2, 3], "fitness", 0.5, state, True)[1] == 0
    moves = policy.transactions(policy.push_uniform(), topology.ring(3), state, Random(1))
    assert [(m["from"], m["to"]) for m in moves] == [(1, 2), (2, 3), (3, 1)]
    with pytest.raises(ValueError):
        policy.migration_config("ring", "tiered_admission")
    with pytest.raises(ValueError):
        policy.gibbs_push(0)


def test_genetics_keep_enough_features_and_order():
    rng, allowed = Random(2), genetics.allowed_transformers("basic", "regression")
    people = genetics.initialise_population(8, ROLES, rng, allowed)
    assert not people[0].genes and people[0].active == ROLES.all
    for _ in range(120):
        a, b = rng.choice(people), rng.choice(people)
        child = rng.choice([lambda: genetics.mutate(a, rng, allowed), lambda: genetics.crossover(a, b, rng), lambda: genetics.union_crossover(a, b)])()
        assert len(child.features) >= 2
        assert topological_order(child.genes, ROLES.all) == child.genes
        people.append(child)
    assert any(set(g.inputs) & {x.output for x in i.genes} for i in people for g in i.genes)


def test_gene_names_and_order():
    a = create_gene("log", "a")
    b = create_gene("add", ["b", a.output])
    assert topological_order([b, a], ["a", "b"]) == [a, b]
    assert topological_order([b], ["a", "b"]) == []
    assert create_gene("pca", ["a", "b"], comp_idx=1).state_key == create_gene("pca", ["a", "b"], comp_idx=2).state_key
    assert a.output == Gene("log", ("a",)).output


def test_penalties():
    p = metrics.complexity_penalty(3, 100, strength=1.0, mode="bic")
    assert p == pytest.approx((1 + math.log(100) / 200) ** 3 - 1)
    assert metrics.complexity_penalty(0, 100, strength=1.0) == 0
    assert metrics.penalised(0.8, 0.1, "classification") == pytest.approx(0.78)
    assert metrics.penalised(-2, 0.1, "regression") == pytest.approx(-2.2)


def test_metric_edge_cases(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    assert metrics.calibrated_mae(flat) == pytest.approx(2 / 3)
    assert flat.agg(metrics.calibrated_rmse(F.col("y"), F.col("p"))).first()[0] == pytest.approx(math.sqrt(2 / 3))
    assert metrics.auc(flat.withColumn("y", F.lit(1))) == 0.5
    line = spark.createDataFrame([(2.0 * i + 1, float(i)) for i in range(20)], "y double, p double")
    assert metrics.calibrated_mae(line) == pytest.approx(0, abs=1e-3)


def test_folds(spark):
    df = spark.range(11).selectExpr("id", "id % 2 AS y", "id AS t")
    sizes = [r["count"] for r in folds.fold_time(df.withColumn("t", F.timestamp_seconds("t")), 3, "t", "id").groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [4, 3, 4]
    assert folds.fold_group(df, 2, "y").groupBy("y").agg(F.countDistinct("fold")).collect()[0][1] == 1
    parts = {(r.y, r.part): r["count"] for r in folds.stratified_split(df, "y", [0.6, 0.2, 0.2], "id").groupBy("y", "part").count().collect()}
    assert parts[0, "train"] == 4 and parts[0, "val"] == 1 and parts[0, "holdout"] == 1


def test_roles(spark):
    df = spark.createDataFrame([(1, 2.0, "x", "2024-01-02", True)], "i int, f double, s string, d string, b boolean")
    roles = infer_roles(df, "f")
    assert (roles.numeric, roles.categorical, roles.datetime) == (["i"], ["b", "s"], ["d"]) or (roles.numeric, sorted(roles.categorical), roles.datetime) == (["i"], ["b", "s"], ["d"])


def test_tuning_finds_an_optimum():
    best, value = optimise(lambda p: -((p["x"] - 4.5) ** 2) - (p["k"] - 7) ** 2, {"x": (0.0, 10.0), "k": (1, 10), "fixed": 3}, iterations=15, seed=1)
    assert best["fixed"] == 3 and abs(best["x"] - 4.5) < 1.5 and abs(best["k"] - 7) <= 1 and value > -3


@pytest.fixture(scope="module")
def frame(spark):
    rng = Random(5)
    rows = []
    for i in range(240):
        c, a, b = rng.choice("pqr"), rng.gauss(0, 1), rng.uniform(1, 9)
        rows.append((i, a, b, c, "s" if rng.random() < 0.5 else "t", a * 3 + b * ({"p": 1, "q": 4, "r": 9}[c]) + rng.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "rid long, a double, b double, c string, d string, y double")


def test_search_end_to_end(spark, frame, tmp_path):
    options = {"task": "regression", "generations": 2, "pop_size": 2, "cv_folds": 2, "seed": 4, "rid": "rid", "allowed_transformers": ["groupby_mean", "multiply", "log"], "holdout_frac": 0.2, "threads": 2}
    recipe = evolve_features(frame, "y", **options)
    again = evolve_features(frame, "y", **options)
    assert recipe.best.recipe_string == again.best.recipe_string and recipe.history == pytest.approx(again.history)
    assert math.isfinite(recipe.best.fitness) and recipe.best.fitness >= recipe.baseline_fitness - 1e-9
    assert recipe.confirmation_fitness is not None and recipe.search_gap is not None
    assert recipe.predict(frame, "rid").count() == 240
    recipe.save(spark, str(tmp_path / "recipe"))
    loaded = Recipe.load(spark, str(tmp_path / "recipe"))
    a, b = (r.predict(frame, "rid").orderBy("rid").first().p for r in (recipe, loaded))
    assert a == pytest.approx(b)
    blend = ensemble_islands([recipe, again], "stack")
    assert sum(blend.weights) == pytest.approx(1) and blend.predict(frame, "rid").count() == 240
    frame.drop("y").write.parquet(str(tmp_path / "in"))
    from strataloom.streaming.recipes import read_stream, transform_stream, write_stream

    stream = transform_stream(recipe, read_stream(spark, str(tmp_path / "in"), frame.drop("y").schema))
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 240


def test_islands_with_split_and_classes(spark, frame):
    df = frame.withColumn("y", F.when(F.col("y") > 20, "hi").otherwise("lo"))
    recipe = evolve_features(df, "y", generations=2, pop_size=2, early_stopping_generations=0, evaluation_strategy="split", islands=2, migration_interval=1, seed=1, rid="rid", allowed_transformers=["log"], metric="auc", row_split_islands=True)
    assert recipe.holdout_fitness is not None and 0 <= recipe.best.fitness <= 1
    assert {e["type"] for e in recipe.log} >= {"baseline", "generation", "migration", "tournament", "complete"}
    with pytest.raises(ValueError, match="two classes"):
        evolve_features(frame, "a", rid="rid")


def test_stack_prefers_the_better_member(spark):
    df = spark.createDataFrame([(float(i), float(i) + 0.1, float(-i)) for i in range(50)], "y double, p0 double, p1 double")
    assert stack_weights(df, ["p0", "p1"])[0] > 0.99


def test_toggles_are_made_once_and_leave_two_features():
    roles = ColumnRoles([f"c{i}" for i in range(8)])
    for seed in range(200):
        before = create_individual([], roles, ["c0", "c1", "c2"])
        after = genetics.toggle_raw(before, Random(seed), {"c0": 0.9}, 0.3)
        assert len(after.active) >= 2 and len(set(after.active)) == len(after.active)
        assert set(before.active) ^ set(after.active)  # what is switched stays so


def test_mask_chances_follow_importance():
    shares = genetics.mask_shares(ColumnRoles(["a", "b", "c", "d"]), {"a": 1.0}, 0.5)
    assert shares["a"] == pytest.approx(1 / (1 + math.exp(-1.5))) and shares["b"] == pytest.approx(1 / (1 + math.exp(0.5)))


@pytest.fixture(scope="module")
def three(spark):
    rng = Random(8)
    rows = []
    for i in range(360):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice("xyz")
        rows.append((i, a, b, c, "p" if a > 0.5 else "q" if b > 0 else "r", 2 * a - b + rng.gauss(0, 0.1), i % 3 + 1))
    return spark.createDataFrame(rows, "rid long, a double, b double, c string, k string, y double, fold int").persist()


def problem_of(df, task, evaluator="lm", **more):
    from strataloom.search.evaluate import Problem, label_column

    target = Target.of(df, "y" if task == "regression" else "k")
    return Problem(df.withColumn("__y", label_column(target, task)), "rid", target, task, evaluator=evaluator, n_classes=1 if task == "regression" else 3, folds=[1, 2, 3], **more)


def test_a_recipe_is_scored_once(three, monkeypatch):
    from strataloom.search import evolve

    problem, calls = problem_of(three, "regression"), []
    inner = evolve.evaluate_fitness
    monkeypatch.setattr(evolve, "evaluate_fitness", lambda i, p, **c: calls.append(i.signature) or inner(i, p, **c))
    individual = create_individual([create_gene("add", ["a", "b"])], ColumnRoles(["a", "b"], ["c"]))
    first = evolve.evaluate_population([individual, individual.copy()], problem, {}, threads=1)
    again = evolve.evaluate_population([individual.copy()], problem, {}, threads=1)
    assert len(calls) == 1 and again[0].fitness == first[0].fitness == first[1].fitness


def test_redundant_genes_are_dropped_in_evaluation(three):
    from strataloom.search.evaluate import evaluate_part

    problem = problem_of(three, "regression")
    (train, val), *_ = problem.parts([1])
    twice = create_individual([create_gene("add", ["a", "a"]), create_gene("multiply", ["a", "b"])], ColumnRoles(["a", "b"], ["c"]))
    assert [g.transformer for g in evaluate_part(twice, problem, train, val).individual.genes] == ["multiply"]


def test_errors_that_arent_the_recipes_are_raised(three):
    from strataloom.search.evaluate import evaluate_fitness

    class Broken:
        def fit(self, *a, **b):
            raise RuntimeError("lost")

    EVALUATORS["broken"] = Broken()
    try:
        with pytest.raises(RuntimeError):
            evaluate_fitness(create_individual([], ColumnRoles(["a", "b"])), problem_of(three, "regression", "broken"))
    finally:
        del EVALUATORS["broken"]


def test_strength_is_chosen_by_folds(spark):
    from strataloom.search.models import chosen_strength, fold_grams

    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 12))
    clear, noise = x[:, 0] * 3 + rng.normal(0, 0.1, 300), rng.normal(0, 1, 300)
    found = []
    for y in (clear, noise):
        from pyspark.ml.linalg import Vectors

        df = spark.createDataFrame([(Vectors.dense(r.tolist()), float(v)) for r, v in zip(x, y, strict=True)], ["__features", "label"])
        rows, grams = fold_grams(df, 2, 5)
        assert rows.sum() == 300
        whole = np.column_stack([np.ones(300), x, y])
        assert np.allclose(grams.sum(axis=0), whole.T @ whole)
        found.append(chosen_strength(grams, 1, 0.5))
    r = [max(abs(np.corrcoef(x[:, j], y)[0, 1]) for j in range(12)) / 0.5 for y in (clear, noise)]
    assert found[0] < 0.05 * r[0] and found[1] > 0.3 * r[1]


@pytest.mark.parametrize("evaluator, task", [("lightgbm", "multiclass"), ("lightgbm", "regression"), ("keras3", "multiclass"), ("keras3", "regression"), ("lm", "multiclass")])
def test_every_model_has_importances(three, evaluator, task):
    params = {"nrounds": 5 if evaluator == "lightgbm" else 30}
    problem = problem_of(three, task, evaluator)
    fitted = EVALUATORS[evaluator].fit(problem.data, ["a", "b"], "__y", task, problem.n_classes, **params)
    assert set(fitted.importances) == {"a", "b"} and all(v > 0 for v in fitted.importances.values())
    assert fitted.predict(problem.data, "rid").where("p IS NULL").count() == 0


def test_boosting_stops_early(spark):
    rng = Random(1)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(400)], "a double, y double")
    assert EVALUATORS["lightgbm"].fit(df, ["a"], "y", "regression").model.getNumTrees < 50


def test_multiclass_ensembles_have_a_fitness(spark, three):
    from strataloom.search import ensemble

    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        y = int(rng.integers(0, 3))
        good, bad = np.full(3, 0.1), rng.dirichlet(np.ones(3))
        good[y] = 0.8
        rows.append((i, float(y), good.tolist(), bad.tolist()))
    table = spark.createDataFrame(rows, "rid long, y double, p0 array<double>, p1 array<double>")
    weights = ensemble.caruana_select(table, ["p0", "p1"], "multiclass", "default", 3, rounds=4)
    assert weights == [1.0, 0.0]
    stacked, honest = ensemble.stack_select(table, ["p0", "p1"], "multiclass", problem_of(three, "multiclass"), 0.5)
    assert stacked[0] > 0.9 and 0.7 < honest <= 0.81


def test_equal_rows_have_ids_of_their_own(spark):
    from strataloom.search.evolve import prepared

    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(2.0, 3.0)] * 3, "a double, y double")
    _, _, data, rid = prepared(df, "y", "regression", None)
    assert data.select(rid).distinct().count() == 8


def test_too_many_classes_are_refused(spark):
    df = spark.range(1200).selectExpr("cast(id as string) AS k", "id AS n")
    with pytest.raises(ValueError):
        Target.of(df, "k")
    assert Target.of(df, "n").levels == []


def test_calibrated_mae_against_all_lines_through_two_points(spark):
    rng = np.random.default_rng(6)
    p = rng.normal(0, 1, 40)
    y = 2 * p + 1 + rng.standard_t(2, 40)
    best = min(np.abs(y - (y[i] + (p - p[i]) * (y[j] - y[i]) / (p[j] - p[i]))).mean() for i in range(40) for j in range(i))
    found = metrics.calibrated_mae(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, p double"))
    assert best - 1e-9 <= found <= best * 1.002


def test_ts_refinement_against_a_fine_grid(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(0, 2, 300)
    y = (rng.random(300) < 1 / (1 + np.exp(-z / 2))).astype(float)
    p = 1 / (1 + np.exp(-z))
    one, zero = y.sum(), (1 - y).sum()
    smooth = np.where(y == 1, (one + 1) / (one + 2), 1 / (zero + 2))
    loss = lambda t, s: -np.mean(s * np.log(1 / (1 + np.exp(-z / t))) + (1 - s) * np.log(1 - 1 / (1 + np.exp(-z / t))))
    best = min(np.geomspace(0.1, 10, 4000), key=lambda t: loss(t, smooth))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, p double")
    assert metrics.ts_refinement(df) == pytest.approx(loss(best, y), abs=1e-5)


def test_options_and_viewer(three):
    import json as reader
    from urllib.request import urlopen

    from strataloom.options import OPTIONS, options
    from strataloom.search.viewer import Viewer

    with options(importance_threshold=0.3):
        assert metrics.normalised_importances([{"a": 0.8, "b": 0.2}])["b"] == 0
    assert OPTIONS["importance_threshold"] == 0.001
    with pytest.raises(ValueError), options(nothing=1):
        pass
    viewer = Viewer(0)
    try:
        viewer.send({"type": "config"})
        viewer.send({"type": "baseline", "fitness": [0.5]})
        assert [e["type"] for e in reader.loads(urlopen(viewer.url + "events?from=1").read())] == ["baseline"]
        assert b"<script>" in urlopen(viewer.url).read()
    finally:
        viewer.close()


def test_absolute_errors_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(8)
    columns = {"even": rng.normal(1e6, 1, 4000), "odd": np.append(rng.normal(0, 1, 3999), np.nan), "ties": rng.integers(0, 3, 4000).astype(float), "flat": np.full(4000, 2.5), "split": np.repeat([0.0, 1.0], 2000), "skew": rng.pareto(0.5, 4000)}
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns))
    wanted = [float(np.nanmean(np.abs(v - np.nanmedian(v)))) for v in columns.values()]
    # No row is held by the distinct values of a column; that is what made a task grow with the table.
    monkeypatch.setattr(F, "percentile", None)
    for around in (40_000, 100, 1):
        monkeypatch.setattr(metrics, "AROUND", around)
        assert metrics.absolute_errors(df, [F.col(c) for c in columns], 4000) == pytest.approx(wanted, rel=1e-12)
    monkeypatch.setattr(F, "percentile_approx", lambda c, q, accuracy: F.array(F.max(c), F.max(c)) if accuracy == 1000 and not tried.append(c) and len(tried) == 1 else approx(c, q, accuracy))
    tried, approx = [], F.approx_percentile
    monkeypatch.setattr(metrics, "AROUND", 40_000)
    assert metrics.absolute_errors(df, [F.col("skew")], 4000) == pytest.approx(wanted[-1:], rel=1e-12)  # a bracket that misses is widened
    assert len(tried) == 2


def test_linear_evaluator_query_runs_alone(tmp_path):
    """In a process of its own no other query has registered the evaluators."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import __spark_entry__
from strataloom.session import session
spark = session("alone", **{{"spark.master": "local[1]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"}})
spark.range(30).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "cast(id % 7 AS double) AS l_quantity", "cast(3 * (id % 7) + 2 AS double) AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'O' AS l_linestatus", "timestamp '1999-01-01' AS l_shipdate", "'N' AS l_returnflag").write.parquet("{tmp_path}/lineitem.parquet")
rows = __spark_entry__.queries()["evaluator_lm"](spark, "{tmp_path}").collect()
assert len(rows) == 30 and all(r.p == 3 * r.q + 2 for r in rows)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
