"""The search: populations on islands, evaluated, bred and exchanged, and the winner fitted as a recipe.

Random draws happen on the driver before evaluations are handed to a few threads, so results don't
depend on their order; each evaluation is a set of Spark jobs over the same persisted rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from random import Random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import VALID, headroom_closed
from ..gene import Gene, Individual
from ..options import OPTIONS
from ..plans import folds as splits
from ..plans.pipeline import fit_apply
from ..registry import MAX_LEVELS, Target
from ..roles import infer_roles, normalise
from . import genetics, policy as policies
from .evaluate import Problem, evaluate_fitness, label_column, score_on
from .recipe import Recipe


def evaluate_population(population: list[Individual], problem: Problem, cache: dict[str, float], threads: int = 2, **context) -> list[Individual]:
    """Score whoever has no fitness; a recipe is scored once on the same rows and folds, in all generations."""
    at = tuple(context.get("folds") or ())
    todo = {i.signature: i for i in population if i.fitness is None and (i.signature, at) not in problem.scored}
    with ThreadPoolExecutor(max(1, threads)) as pool:
        done = dict(zip(todo, pool.map(lambda i: evaluate_fitness(i, problem, **context), todo.values()), strict=True))
    problem.scored.update({(k, at): i for k, i in done.items()})
    out = [i if i.fitness is not None else problem.scored[i.signature, at] for i in population]
    cache.update({i.signature: i.fitness for i in out})
    return out


def screen(population: list[Individual], problem: Problem, quick: Problem, cache: dict, share: float = 0.5, **context) -> list[Individual]:
    """Multi-fidelity: score all on fewer rows, and the better ``share`` again on all."""
    rough = evaluate_population([i.copy() for i in population], quick, {}, **context)
    order = sorted(range(len(rough)), key=lambda k: -(rough[k].fitness if rough[k].fitness is not None else -math.inf))
    promoted = set(order[: math.ceil(len(order) * share)])
    full = evaluate_population([population[k] for k in sorted(promoted)], problem, cache, **context)
    return [full[sorted(promoted).index(k)] if k in promoted else rough[k] for k in range(len(population))]


def better(a: Individual | None, b: Individual) -> Individual:
    return b if a is None or (b.fitness or -math.inf) > (a.fitness if a.fitness is not None else -math.inf) else a


def adaptive_rates(stagnation: int, patience: int) -> tuple[float, float]:
    """(mutation rate, temperature), which rise while nothing improves."""
    s = min(1.0, stagnation / max(1, patience))
    return 0.3 + 0.4 * s, 0.1 + 0.9 * s


def next_size(size: int, start: int, improved: bool, growth_rate: float = 1.5, decay_rate: float = 0.7) -> int:
    """Individuals of the next generation: more while nothing improves, fewer when something does."""
    wanted = max(start, round(size * decay_rate)) if improved else max(size + 1, round(size * growth_rate))
    return min(5 * start, wanted)


def search_gap(checked: float | None, found: float | None) -> float | None:
    """What a fitness loses on rows that the search didn't see."""
    return None if checked is None or found is None else checked - found


def breed(population: list[Individual], size: int, rng: Random, allowed: list[str], cache: dict, best: float | None, stagnation: int, patience: int, crossover_type: str, migrated: list[Gene], options: dict, expansion: int = 0) -> list[Individual]:
    """The next generation: the best one, then children by tournament."""
    ranked = sorted(population, key=lambda i: -(i.fitness if i.fitness is not None else -math.inf))
    rate, temperature = adaptive_rates(stagnation, patience)
    survivors = ranked[: max(2, math.ceil(len(ranked) / 2))]
    importances: dict[str, float] = {}
    for i in survivors:
        for n, v in i.importances.items():
            importances[n] = importances.get(n, 0.0) + v / len(survivors)
    out, seen = [ranked[0]], {ranked[0].signature}
    while len(out) < size:
        child, grow = None, len(out) >= size - expansion
        for _ in range(15):
            a = genetics.tournament_select(population, rng)
            if grow:
                child = genetics.mutate(a, rng, allowed, importances, 100.0, force_add=True, migrated=migrated, **options)
            elif rng.random() >= rate and len(population) > 1:
                b = genetics.tournament_select(population, rng)
                union = crossover_type == "union" or (crossover_type == "both" and rng.random() < 0.5)
                child = genetics.union_crossover(a, b) if union else genetics.crossover(a, b, rng)
                if rng.random() < 0.2:
                    child = genetics.mutate(child, rng, allowed, importances, temperature, migrated=migrated, **options)
            else:
                child = genetics.mutate(a, rng, allowed, importances, temperature, migrated=migrated, **options)
            if not genetics.taboo(child, seen, cache, best):
                break
        out.append(child.copy())
        seen.add(child.signature)
    return out


def migrate(populations: list[list[Individual]], migration: policies.Migration, state: policies.IslandState, pool: list[list[Gene]], rng: Random, rate: int, relative: bool = False) -> list[dict]:
    """Carry out a step's moves: genes join the destination's pool, or individuals replace its worst."""
    moves = policies.transactions(migration.policy, migration.topology, state, rng)
    for m in moves:
        source, destination = populations[m["from"] - 1], m["to"] - 1
        ranked = sorted(source, key=lambda i: -(i.fitness if i.fitness is not None else -math.inf))
        if migration.payload == "gene_only":
            genes = sorted(ranked[0].genes, key=lambda g: -ranked[0].importances.get(g.output, 0.0))[:20]
            pool[destination] = [*pool[destination], *[g for g in genes if g not in pool[destination]]][-20:]
        else:
            home = sorted(populations[destination], key=lambda i: -(i.fitness if i.fitness is not None else -math.inf))
            guests = [i.copy() if relative else replace(i) for i in ranked[:rate]]
            populations[destination] = [*home[: max(1, len(home) - len(guests))], *guests]
    return moves


def prepared(df: DataFrame, target_col: str, task: str, rid: str | None):
    if task not in VALID:
        raise ValueError(f"unknown task {task!r}; known: {', '.join(VALID)}")
    target = Target.of(df, target_col)
    if task == "classification" and len(target.levels) != 2:
        raise ValueError(f"classification needs two classes, {target_col} has {len(target.levels)}")
    if task == "multiclass" and len(target.levels) < 2:
        raise ValueError(f"multiclass needs two classes at least and {MAX_LEVELS} at most in {target_col}")
    drop = {rid} - {None}
    roles = infer_roles(df.drop(*drop), target_col)
    data = normalise(df, roles)
    if rid is None:
        # Equal rows are numbered, so that ids don't repeat.
        alike = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        rid, data = "__rid", data.withColumn("__rid", alike).withColumn("__rid", F.xxhash64("__rid", F.row_number().over(Window.partitionBy("__rid").orderBy("__rid"))))
    return target, roles, data.withColumn("__y", label_column(target, task)).where("__y IS NOT NULL"), rid


def evolve_features(
    df: DataFrame,
    target_col: str,
    task: str = "classification",
    generations: int = 10,
    pop_size: int = 10,
    cv_folds: int = 3,
    evaluation_strategy: str = "cv",
    split_ratio: tuple[float, ...] = (0.6, 0.2, 0.2),
    split_col: str | None = None,
    holdout_frac: float = 0.0,
    cv_strategy: str = "random",
    time_col: str | None = None,
    group_col: str | None = None,
    multi_fidelity: bool = False,
    mf_sample_frac: float = 0.5,
    mf_warmup_frac: float = 0.5,
    early_stopping_generations: int = 3,
    evaluator: str = "lm",
    seed: int = 0,
    dynamic_population: bool = True,
    growth_rate: float = 1.5,
    decay_rate: float = 0.7,
    crossover_type: str = "both",
    threads: int | None = None,
    metric: str | Callable = "default",
    model_all_final_genes: bool = False,
    model_all_historical_genes: bool = False,
    allowed_transformers: str | list[str] = "all",
    complexity_penalty: float = 0.0,
    complexity_mode: str = "bic_dynamic",
    complexity_floor: float = 0.2,
    complexity_target: str = "all_features",
    islands: int = 1,
    migration: policies.Migration | str | None = None,
    migration_interval: int = 5,
    migration_rate: int = 1,
    migration_temperature: float = 1.0,
    gene_migration_prob: float = 0.2,
    raw_toggle_prob: float = 0.15,
    recalculate_mask_prob: float = 0.05,
    mask_temp_factor: float = 0.5,
    row_split_islands: bool = False,
    per_island_validation: bool = False,
    metacv_selection: str | None = None,
    rid: str | None = None,
    viewer=None,
    **model_params,
) -> Recipe:
    """Search for a recipe. Equal seeds give equal searches.

    ``cv`` scores by folds (random, ``time``: contiguous blocks, ``group``: whole groups), ``split``
    by training and validation parts with a last holdout. ``holdout_frac`` takes rows away before
    the search, to confirm the winner. Islands breed apart and exchange by ``migration``; with
    ``row_split_islands`` each trains on its own rows, and with ``metacv_selection`` (fitness,
    headroom or tournament) island j scores on fold j alone. Events go to the recipe's log, and as
    they happen to ``viewer`` (a ``Viewer``) and, with the option ``verbose``, to standard output.
    """
    if not 0 <= holdout_frac < 1:
        raise ValueError("holdout_frac has to be in [0, 1)")
    if evaluation_strategy not in ("cv", "split"):
        raise ValueError(f"unknown evaluation_strategy {evaluation_strategy!r}")
    rng, log = Random(seed), []
    target, roles, data, rid = prepared(df, target_col, task, rid)
    threads = int(OPTIONS["threads"]) if threads is None else threads

    def note(kind: str, **x) -> None:
        log.append({"type": kind, **x})
        if viewer is not None:
            viewer.send(log[-1])
        if OPTIONS["verbose"]:
            print(log[-1])

    note("config", target=target_col, task=task, generations=generations, pop_size=pop_size, islands=islands, evaluator=evaluator)
    confirm = None
    if holdout_frac:
        parts = splits.stratified_split(data, "__y", [1 - holdout_frac, holdout_frac], rid, seed + 17, task == "regression").persist()
        confirm, data = parts.where("part = 'val'").drop("part"), parts.where("part = 'train'").drop("part")
        if confirm.count() < 5:
            confirm, data = None, parts.drop("part")
    fold_ids: list[int] = []
    if evaluation_strategy == "cv":
        cv_folds = islands if metacv_selection else cv_folds
        if cv_strategy == "time":
            data = splits.fold_time(data, cv_folds, time_col, rid)
        elif cv_strategy == "group":
            data = splits.fold_group(data, cv_folds, group_col)
        elif cv_strategy == "random":
            data = splits.fold_random(data, cv_folds, rid, seed)
        else:
            raise ValueError(f"unknown cv_strategy {cv_strategy!r}")
        fold_ids = list(range(1, cv_folds + 1))
    elif split_col:
        data = data.withColumn("part", F.col(split_col))
    else:
        data = splits.stratified_split(data, "__y", list(split_ratio), rid, seed, task == "regression")
    if row_split_islands and islands > 1:
        data = splits.island_rows(data, islands, rid, seed + 5)
    data = data.persist()
    n = data.count()
    penalty = {"strength": complexity_penalty, "mode": complexity_mode, "floor": complexity_floor, "target": complexity_target}
    problem = Problem(data, rid, target, task, metric, evaluator, max(2, len(target.levels)) if task != "regression" else 1, fold_ids, model_params, penalty)
    problem.model()
    allowed = genetics.allowed_transformers(allowed_transformers, task)
    options = {"gene_migration_prob": gene_migration_prob, "raw_toggle_prob": raw_toggle_prob, "recalculate_mask_prob": recalculate_mask_prob}
    if isinstance(migration, str) or migration is None:
        migration = policies.LEGACY[migration or "ring"](islands, migration_temperature)

    def island_problem(j: int) -> tuple[Problem, list[int] | None]:
        own = problem
        if row_split_islands and islands > 1:
            mine = F.col("island") == j + 1
            if fold_ids:
                own = replace(problem, data=data.where(mine), scored={})
            elif per_island_validation:
                ratio = (split_ratio[0], split_ratio[1])
                inner = splits.island_validation(data.where(mine & (F.col("part") != "holdout")).drop("part"), ratio, rid, seed)
                own = replace(problem, data=inner, scored={})
            else:
                own = replace(problem, data=data.where(mine | (F.col("part") != "train")), scored={})
        return own, [fold_ids[j]] if metacv_selection else None

    problems = [island_problem(j) for j in range(islands)]
    baseline = Individual([], roles, list(roles.all))
    baselines = [evaluate_fitness(baseline, p, n_samples=n, folds=f) for p, f in (problems if metacv_selection or row_split_islands else problems[:1])]
    baselines = baselines * (islands // len(baselines)) if len(baselines) < islands else baselines
    note("baseline", fitness=[b.fitness for b in baselines])
    populations = [genetics.initialise_population(pop_size, roles, Random(seed + 1000 * (j + 1)), allowed, baselines[j].importances, mask_temperature=mask_temp_factor) for j in range(islands)]
    pools: list[list[Gene]] = [[] for _ in range(islands)]
    caches: list[dict[str, float]] = [{} for _ in range(islands)]
    bests: list[Individual | None] = [None] * islands
    quicks: list[Problem | None] = [None] * islands
    stagnation, sizes, history, past = [0] * islands, [pop_size] * islands, [], {}
    for generation in range(generations):
        quick_round = multi_fidelity and generation < generations * mf_warmup_frac
        for j, (own, folds) in enumerate(problems):
            context = {"best": bests[j].fitness if bests[j] else None, "baseline": baselines[j].fitness, "n_samples": n, "folds": folds, "threads": threads}
            if quick_round:
                quicks[j] = quicks[j] or replace(own, data=splits.low_fidelity(own.data, mf_sample_frac, rid, seed), scored={})
                populations[j] = screen(populations[j], own, quicks[j], caches[j], **context)
            else:
                populations[j] = evaluate_population(populations[j], own, caches[j], **context)
            leader = max(populations[j], key=lambda i: i.fitness if i.fitness is not None else -math.inf)
            improved = bests[j] is None or leader.fitness > bests[j].fitness + 1e-12
            bests[j] = better(bests[j], leader)
            past[leader.signature] = leader
            stagnation[j] = 0 if improved else stagnation[j] + 1
            if dynamic_population:
                sizes[j] = next_size(sizes[j], pop_size, improved, growth_rate, decay_rate)
            note("island_evaluated", generation=generation, island=j + 1, best=bests[j].fitness, size=len(populations[j]))
        history.append(max(b.fitness for b in bests))
        note("generation", generation=generation, best=history[-1])
        if early_stopping_generations and all(s >= early_stopping_generations for s in stagnation):
            note("status", text="stopped early")
            break
        if generation == generations - 1:
            break
        if islands > 1 and (generation + 1) % migration_interval == 0:
            shown = [headroom_closed(b.fitness, baselines[j].fitness, task) if metacv_selection else b.fitness for j, b in enumerate(bests)]
            state = policies.IslandState(shown, stagnation, [set(b.active) | {g.formula for g in b.genes} for b in bests])
            moves = migrate(populations, migration, state, pools, rng, migration_rate, bool(metacv_selection or row_split_islands))
            note("migration", generation=generation, moves=moves)
        for j in range(islands):
            expansion = max(0, sizes[j] - len(populations[j])) if stagnation[j] else 0
            populations[j] = breed(populations[j], sizes[j], rng, allowed, caches[j], bests[j].fitness, stagnation[j], early_stopping_generations, crossover_type, pools[j], options, expansion)
    # A last tournament where islands saw different rows or folds; else the fittest.
    context = {"baseline": baselines[0].fitness, "n_samples": n}
    if islands > 1 and (row_split_islands or metacv_selection == "tournament"):
        finals = [evaluate_fitness(b.copy(), problem, **context) for b in bests]
        winner = max(finals, key=lambda i: i.fitness)
        note("tournament", fitness=[i.fitness for i in finals])
    elif metacv_selection == "headroom":
        winner = bests[max(range(islands), key=lambda j: headroom_closed(bests[j].fitness, baselines[j].fitness, task))]
    else:
        winner = max(bests, key=lambda i: i.fitness)
    for wanted, kind, members in ((model_all_final_genes, "pooled", [i for p in populations for i in p if i.fitness is not None]), (model_all_historical_genes, "historical", list(past.values()))):
        if wanted and members:
            merged = members[0]
            for i in members[1:]:
                merged = genetics.union_crossover(merged, i)
            merged = evaluate_fitness(merged.copy(), problem, **context)
            note(kind, fitness=merged.fitness, genes=len(merged.genes))
            winner = better(winner, merged)
    # States are fitted afresh on all search rows, never carried over from a fold.
    search_rows = data if fold_ids else data.where("part <> 'holdout'") if len(split_ratio) > 2 or split_col else data
    trained, _, done, states = fit_apply(winner, search_rows, target, redundancy=problem.redundancy)
    fitted = problem.model().fit(trained, done.features, "__y", task, problem.n_classes, **model_params)
    done = replace(done, fitness=winner.fitness, raw_fitness=winner.raw_fitness, penalty=winner.penalty, importances=winner.importances, n_folds_ok=winner.n_folds_ok)
    recipe = Recipe(done, states, fitted, target, task, metric if isinstance(metric, str) else "custom", evaluator, baselines[0].fitness, history=history, log=log, islands=bests, problem=problem)
    recipe.headroom_closed = headroom_closed(winner.fitness, baselines[0].fitness, task)
    if not fold_ids and data.where("part = 'holdout'").limit(1).count():
        recipe.holdout_fitness = score_on(done, problem, fitted, states, data.where("part = 'holdout'"))
    if confirm is not None:
        recipe.confirmation_fitness = score_on(done, problem, fitted, states, confirm)
    checked = recipe.confirmation_fitness if recipe.confirmation_fitness is not None else recipe.holdout_fitness
    recipe.search_gap = search_gap(checked, winner.raw_fitness)
    note("complete", fitness=winner.fitness, formula=done.recipe_string)
    return recipe
