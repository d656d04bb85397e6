"""Queries of the search: topologies, policies, genetic operators, and small searches end to end."""

from __future__ import annotations

from random import Random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import add
from .gene import create_gene, create_individual
from .roles import ColumnRoles
from .search import genetics, policy, topology

ROLES = ColumnRoles(["price", "cust"], ["st", "pr"], ["dt"])


def edges(t) -> object:
    return lambda s, d: s.createDataFrame(t.edges(), "src long, dst long")


add("topology_ring", edges(topology.ring(10)), "SELECT i AS src, i % 10 + 1 AS dst FROM range(1, 11) r(i)")
add("topology_complete", edges(topology.complete(6)), "SELECT a.i AS src, b.i AS dst FROM range(1, 7) a(i), range(1, 7) b(i) WHERE a.i <> b.i")
add("topology_hypercube", edges(topology.hypercube(8)), "SELECT i + 1 AS src, xor(i, b) + 1 AS dst FROM range(8) r(i), (VALUES (1::BIGINT), (2), (4)) v(b)")
add("topology_grid", edges(topology.grid(9)), "SELECT a.i + 1 AS src, b.i + 1 AS dst FROM range(9) a(i), range(9) b(i) WHERE abs(a.i // 3 - b.i // 3) + abs(a.i % 3 - b.i % 3) = 1")
add("topology_torus", edges(topology.torus(9)), "SELECT a.i + 1 AS src, b.i + 1 AS dst FROM range(9) a(i), range(9) b(i) WHERE a.i <> b.i AND (a.i // 3 = b.i // 3 OR a.i % 3 = b.i % 3)")
TIERS = """WITH w AS (SELECT t, greatest(1, CAST(round_even(pow(0.5, t) / 1.75 * 10, 0) AS BIGINT)) AS s FROM range(3) r(t)), z AS (SELECT t, s + CASE WHEN t = 0 THEN greatest(0, 10 - (SELECT sum(s) FROM w)) ELSE 0 END AS s FROM w),
p AS (SELECT t, s, coalesce(sum(s) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z), i AS (SELECT t, s, before, before + k + 1 AS i, k FROM p, range(10) r(k) WHERE k < s)
SELECT CAST(a.i AS BIGINT) AS src, CAST(b.i AS BIGINT) AS dst FROM i a JOIN i b ON (a.t = b.t AND a.i <> b.i) OR (b.t = a.t + 1 AND b.k = least(b.s - 1, a.k // 2))"""
add("topology_tiered", edges(topology.tiered(10)), TIERS)
add("topology_custom", edges(topology.custom([[0, 1, 0], [0, 0, 1], [1, 1, 0]])), "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT), (2, 3), (3, 1), (3, 2)) v(src, dst)")


def state(n: int) -> policy.IslandState:
    return policy.IslandState([0.5 + 0.03 * ((7 * i) % n) for i in range(n)], [(3 * i) % 5 for i in range(n)], [{f"f{i}", f"f{i + 1}"} for i in range(n)])


def moves(p: policy.Policy, t: topology.Topology):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = policy.transactions(p, t, state(t.islands), Random(1))
        rows = [(m["from"], m["to"], m["is_pull"], m.get("is_promotion", False), m.get("from_tier"), m.get("to_tier")) for m in found]
        return spark.createDataFrame(rows, "`from` int, `to` int, is_pull boolean, is_promotion boolean, from_tier int, to_tier int")

    return query


add("migration_push", moves(policy.gibbs_push(), topology.torus(9)))
add("migration_pull", moves(policy.gibbs_pull(), topology.complete(6)))
add("migration_tiered", moves(policy.tiered_admission(), topology.tiered(10)))
add(
    "gibbs_weights", lambda s, d: s.createDataFrame([(j, round(w, 6)) for j, w in zip(range(2, 7), policy.gibbs_weights(1, list(range(2, 7)), "stagnation", 0.5, state(6)), strict=True)], "island long, weight double"),
    "WITH x AS (SELECT i + 1 AS island, (3 * i) % 5 AS s FROM range(1, 6) r(i)) SELECT island, round(exp((s - (SELECT max(s) FROM x)) / 0.5) / sum(exp((s - (SELECT max(s) FROM x)) / 0.5)) OVER (), 6) AS weight FROM x",
)


def genes(population):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(k, g.transformer, list(g.inputs), g.output, i.active) for k, i in enumerate(population()) for g in (i.genes or [create_gene("log", ["price"])])]
        return spark.createDataFrame(rows, "individual int, transformer string, inputs array<string>, output string, active array<string>")

    return query


def population(n: int = 6):
    return genetics.initialise_population(n, ROLES, Random(9), genetics.allowed_transformers("basic", "regression"))


def mutated():
    rng, allowed = Random(4), genetics.allowed_transformers("robust", "regression")
    return [genetics.mutate(i, rng, allowed) for i in population()]


def crossed(union: bool):
    def made():
        rng, p = Random(2), population()
        return [genetics.union_crossover(a, b) if union else genetics.crossover(a, b, rng) for a, b in zip(p, p[1:], strict=False)]

    return made


def tournament():
    rng, p = Random(6), population(8)
    for k, i in enumerate(p):
        i.fitness = k / 10
    return [genetics.tournament_select(p, rng) for _ in range(10)]


add("ga_init_population", genes(population))
add("ga_mutate", genes(mutated))
add("ga_crossover", genes(crossed(False)))
add("ga_union_crossover", genes(crossed(True)))
add("ga_tournament", genes(tournament))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "o_custkey % 50 AS cust", "o_orderstatus AS st", "o_orderpriority AS pr", "o_orderdate AS dt", "o_totalprice AS price")


def search(task: str, **options):
    from .search.evolve import evolve_features

    def run(spark: SparkSession, sf_dir: str):
        y = {"regression": "price / (1 + cust % 7)", "classification": "CASE WHEN price > 100000 AND pr < '3' THEN 'yes' ELSE 'no' END", "multiclass": "CASE WHEN price > 150000 THEN 'a' WHEN price > 80000 THEN 'b' ELSE 'c' END"}[task]
        df = orders(spark, sf_dir).withColumn("y", F.expr(y))
        return df, evolve_features(df, "y", task, **{"generations": 1, "pop_size": 3, "cv_folds": 2, "seed": 3, "rid": "o_orderkey", "allowed_transformers": "basic", **options})

    return run


def evolve_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search("regression", generations=2)(spark, sf_dir)[1].genes_table(spark)


def predict_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, recipe = search("classification")(spark, sf_dir)
    return recipe.predict(df, "o_orderkey").select("o_orderkey", F.round("p", 6).alias("p"))


def multiclass_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, recipe = search("multiclass")(spark, sf_dir)
    return recipe.predict(df, "o_orderkey").select("o_orderkey", *[F.round(F.element_at("p", k + 1), 6).alias(f"p_{v}") for k, v in enumerate(recipe.target.levels)])


def ensembled(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .search.ensemble import ensemble_islands

        df, a = search("regression")(spark, sf_dir)
        _, b = search("regression", seed=8, allowed_transformers="robust")(spark, sf_dir)
        b.problem = a.problem
        return ensemble_islands([a, b], method).predict(df, "o_orderkey").select("o_orderkey", F.round("p", 4).alias("p"))

    return query


add("evolve_small", evolve_small)
add("predict_model", predict_model)
add("multiclass_proba", multiclass_proba)
for _method in ("equal", "caruana", "stack"):
    add(f"ensemble_{_method}", ensembled(_method))


# What the search works out in numbers and names, a row each.
def constant(rows: list[tuple], schema: str):
    return lambda s, d: s.createDataFrame(rows, schema)


def rates_rows():
    from .search.evolve import adaptive_rates

    return [(k, *(round(x, 9) for x in adaptive_rates(k, 3))) for k in range(6)]


def sizes_rows():
    from .search.evolve import next_size

    return [(n, next_size(n, 10, True), next_size(n, 10, False)) for n in (10, 13, 25, 40, 50)]


WIDE = ColumnRoles(["a", "b", "c"], ["d"])
IMPORTANT = {"a": 0.5, "b": 0.3, "d": 0.2}
add("adaptive_rates", lambda s, d: constant(rates_rows(), "stagnation long, rate double, temperature double")(s, d), "SELECT k AS stagnation, round(0.3 + 0.4 * least(1, k / 3), 9) AS rate, round(0.1 + 0.9 * least(1, k / 3), 9) AS temperature FROM range(6) r(k)")
add("dynamic_population", lambda s, d: constant(sizes_rows(), "size long, improved long, stalled long")(s, d), "SELECT n AS size, least(50, greatest(10, CAST(round_even(n * 0.7, 0) AS BIGINT))) AS improved, least(50, greatest(n + 1, CAST(round_even(n * 1.5, 0) AS BIGINT))) AS stalled FROM (VALUES (10::BIGINT), (13), (25), (40), (50)) v(n)")
add(
    "active_mask_chances", lambda s, d: constant([(c, round(p, 9)) for c, p in genetics.mask_shares(WIDE, IMPORTANT, 0.5).items()], "name string, chance double")(s, d),
    "SELECT name, round(1 / (1 + exp(-(v - 0.25) / 0.5)), 9) AS chance FROM (VALUES ('a', 0.5::DOUBLE), ('b', 0.3), ('c', 0.0), ('d', 0.2)) t(name, v)",
)


def ordered_genes():
    from .gene import topological_order

    a = create_gene("log", ["a"])
    b = create_gene("add", [a.output, "b"])
    c = create_gene("multiply", [b.output, a.output])
    lost = create_gene("log", ["nowhere"])
    return [(k, g.transformer) for k, g in enumerate(topological_order([c, lost, b, a], ["a", "b"]))]


add("topological_order", lambda s, d: constant(ordered_genes(), "place long, transformer string")(s, d), "SELECT * FROM (VALUES (0::BIGINT, 'log'), (1, 'add'), (2, 'multiply')) v(place, transformer)")


def names_rows():
    one, two = create_gene("add", ["a", "b", "c", "d", "e"]), create_gene("power", ["a"], p=3)
    same = create_gene("pca", ["a", "b"], comp_idx=1).state_key == create_gene("pca", ["a", "b"], comp_idx=2).state_key
    apart = create_gene("one_hot_encode", ["a"], comp_idx=1).state_key == create_gene("one_hot_encode", ["a"], comp_idx=2).state_key
    recipe = create_individual([create_gene("log", ["a"])], ColumnRoles(["a", "b"]), ["b"]).recipe_string
    return [("formula", one.formula), ("parameters", two.formula), ("state shared", str(same).lower()), ("state apart", str(not apart).lower()), ("recipe", recipe)]


add(
    "gene_names", lambda s, d: constant(names_rows(), "kind string, value string")(s, d),
    "SELECT 'formula' AS kind, 'add(' || array_to_string(['a', 'b', 'c'], ', ') || ', +' || (5 - 3) || ' more)' AS value UNION ALL SELECT 'parameters', 'power(a, p=3)' UNION ALL SELECT 'state shared', 'true' UNION ALL SELECT 'state apart', 'true' UNION ALL SELECT 'recipe', '[log(a)] (active: 1/2 raw, 1 genes)'",
)
