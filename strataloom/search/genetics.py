"""Genetic operators on recipes. All randomness comes from the ``Random`` that is passed in."""

from __future__ import annotations

import math
from random import Random

from ..gene import Gene, Individual, create_gene, topological_order
from ..registry import TRANSFORMERS
from ..roles import ColumnRoles

#: Named sets of transformers.
PRESETS = {
    "basic": [
        "add", "subtract", "multiply", "divide", "log", "sqrt", "reciprocal", "power", "displaced_log", "normalized_difference", "frequency_encode", "one_hot_encode",
        "target_encode", "pooled_target_encode", "target_encode_multiclass", "feature_hash", "rank_transform", "groupby_mean", "groupby_min", "groupby_max", "concat",
    ],
    "clustering": [
        "genie", "genie_centroid_dist", "lumbermark", "lumbermark_centroid_dist", "mst_score", "deadwood", "umap", "random_projection", "truncated_svd", "pca", "umap_genie",
        "umap_lumbermark", "mca", "famd", "between_group_pca",
    ],
    "robust": [
        "log", "sqrt", "reciprocal", "power", "displaced_log", "rank_transform", "add", "subtract", "multiply", "divide", "normalized_difference", "log_ratio", "target_encode",
        "pooled_target_encode", "woe_encode", "frequency_encode", "feature_hash", "groupby_mean", "groupby_median", "groupby_sd", "groupby_zscore", "groupby_ratio",
        "groupby_quantile", "groupby_min", "groupby_max", "groupby_signed_log", "quantile_binning", "pca", "concat", "mca", "famd", "between_group_pca",
    ],
}


def allowed_transformers(allowed: str | list[str], task: str) -> list[str]:
    names = list(TRANSFORMERS) if allowed == "all" else PRESETS.get(allowed, allowed) if isinstance(allowed, str) else allowed
    names = [n for n in ([names] if isinstance(names, str) else names) if n in TRANSFORMERS] or list(TRANSFORMERS)
    barred = {"target_encode", "pooled_target_encode"} if task == "multiclass" else {"target_encode_multiclass"}
    return [n for n in names if n not in barred]


def draw(rng: Random, names: list[str], importances: dict[str, float], temperature: float, inactive: set[str] = frozenset()) -> str:
    """One name, by softmax of importance; switched-off columns weigh as if unimportant, unknown ones as the least important known."""
    known = [v for v in importances.values() if v > 0]
    base = min(known) if known else 0.0
    weights = [1.0 if n in inactive else math.exp(min(50.0, importances.get(n, base) / max(temperature, 1e-6))) for n in names]
    return rng.choices(names, weights)[0]


def pools(individual: Individual, chained: list[Gene]) -> dict[str, list[str]]:
    made = {"numeric": [], "categorical": []}
    for g in chained:
        made["categorical" if TRANSFORMERS[g.transformer].output_type == "categorical" else "numeric"].append(g.output)
    r = individual.roles
    return {"numeric": [*r.numeric, *made["numeric"]], "categorical": [*r.categorical, *made["categorical"]], "datetime": list(r.datetime)}


def draw_inputs(rng: Random, name: str, have: dict[str, list[str]], importances: dict, temperature: float, inactive: set[str]) -> list[str] | None:
    """Inputs of a new gene, or None if there aren't enough columns."""
    t = TRANSFORMERS[name]
    pick = lambda pool: draw(rng, pool, importances, temperature, inactive)
    if t.arity == "mixed_binary" or name == "between_group_pca":
        if not have["categorical"] or not have["numeric"]:
            return None
        first, more = pick(have["categorical"]), 1 if t.arity == "mixed_binary" else min(len(have["numeric"]), rng.randint(2, 4))
        rest: list[str] = []
        while len(rest) < more:
            pool = [c for c in have["numeric"] if c not in rest]
            rest.append(pick(pool))
        return [first, *rest] if t.arity == "mixed_binary" or len(rest) >= 2 else None
    pool = [*have["numeric"], *have["categorical"]] if t.input_type == "mixed" else have[t.input_type]
    low, high = t.n_inputs
    if not pool or (len(set(pool)) < low and not t.allow_replace):
        return None
    n, found = rng.randint(low, high if t.allow_replace else min(high, len(set(pool)))), []
    while len(found) < n:
        found.append(pick(pool if t.allow_replace else [c for c in pool if c not in found]))
    return found


def new_genes(rng: Random, individual: Individual, allowed: list[str], importances: dict, temperature: float, chained: list[Gene], attempts: int = 5) -> list[Gene]:
    """A new gene with all its components, or none if every attempt failed."""
    have, known = pools(individual, chained), {g.output for g in individual.genes}
    inactive = {c for c in individual.roles.all if c not in individual.active}
    for _ in range(attempts):
        name = rng.choice(allowed)
        inputs = draw_inputs(rng, name, have, importances, temperature, inactive)
        if inputs is None:
            continue
        t = TRANSFORMERS[name]
        gene = create_gene(name, inputs, **t.sample_params(rng, len(inputs)))
        parts = [gene.with_params(comp_idx=k) for k in t.components(gene)] or [gene]
        parts = [g for g in parts if g.output not in known]
        if parts:
            return parts
    return []


def least_active(individual: Individual, rng: Random) -> Individual:
    """Switch raw columns on until there are enough features."""
    least = min(2, len(individual.roles.all))
    while len(individual.features) < least:
        individual.active.append(rng.choice([c for c in individual.roles.all if c not in individual.active]))
    return individual


def sample_mask(rng: Random, roles: ColumnRoles, importances: dict[str, float] | None, temperature: float = 0.5) -> list[str]:
    """Raw columns on with the logistic of importance above the average, in units of ``temperature``."""
    share = mask_shares(roles, importances, temperature)
    return [c for c in roles.all if rng.random() < share[c]]


def mask_shares(roles: ColumnRoles, importances: dict[str, float] | None, temperature: float = 0.5) -> dict[str, float]:
    """The chance that each raw column is on; 0.7 where no importance is known."""
    if not importances or not any(v > 0 for v in importances.values()):
        return dict.fromkeys(roles.all, 0.7)
    above = {c: (importances.get(c, 0.0) - 1 / len(roles.all)) / max(temperature, 1e-6) for c in roles.all}
    return {c: 1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for c, x in above.items()}


def recalculate_mask(individual: Individual, rng: Random, importances: dict, temperature: float) -> Individual:
    return least_active(individual.copy(active=sample_mask(rng, individual.roles, importances, temperature)), rng)


def toggle_raw(individual: Individual, rng: Random, importances: dict, temperature: float) -> Individual:
    """Switch a few raw columns, each once: off rather if unimportant, on evenly. What would leave
    fewer than two features isn't switched off."""
    n, active, done = len(individual.roles.all), list(individual.active), set()
    if not n:
        return individual.copy()
    count, stop = 1, 1 / (1 + math.log(n)) if n > 1 else 1.0
    while count < n and rng.random() > stop:
        count += 1
    for _ in range(count):
        off = [c for c in individual.roles.all if c not in active and c not in done]
        on = [c for c in active if c not in done] if len(active) + len(individual.genes) > min(2, n) else []
        if not on and not off:
            break
        if on and (not off or rng.random() < 0.5):
            chosen = rng.choices(on, [math.exp(-min(50.0, importances.get(c, 0.0) / max(temperature, 1e-6))) + 1e-12 for c in on])[0]
            active.remove(chosen)
        else:
            chosen = rng.choice(off)
            active.append(chosen)
        done.add(chosen)
    return least_active(individual.copy(active=active), rng)


def dependent(genes: list[Gene], output: str) -> set[Gene]:
    """Genes that need a column, through others too."""
    gone, names = set(), {output}
    for g in genes:
        if set(g.inputs) & names:
            gone.add(g)
            names.add(g.output)
    return gone


def remove_gene(individual: Individual, rng: Random, importances: dict) -> Individual:
    g = rng.choices(individual.genes, [1 / (importances.get(g.output, 0.0) + 1e-8) for g in individual.genes])[0]
    gone = dependent(individual.genes, g.output) | {g}
    return least_active(individual.copy(genes=[x for x in individual.genes if x not in gone]), rng)


def modify_gene(individual: Individual, rng: Random, importances: dict, temperature: float, chained: list[Gene]) -> Individual | None:
    """Change a gene's inputs or parameters; None if that changes nothing."""
    g = rng.choice(individual.genes)
    t, have = TRANSFORMERS[g.transformer], pools(individual, [c for c in chained if c not in dependent(individual.genes, g.output) and c != g])
    ways = ["params"] if t.sample_params(Random(0), len(g.inputs)) else []
    ways += ["swap"] + (["add"] if len(g.inputs) < t.n_inputs[1] else []) + (["remove"] if len(g.inputs) > t.n_inputs[0] else [])
    way, inputs, params = rng.choice(ways), list(g.inputs), g.options
    inactive = {c for c in individual.roles.all if c not in individual.active}
    if way == "params":
        params = {**params, **t.sample_params(rng, len(inputs))}
    elif way == "remove":
        inputs.pop(rng.randrange(len(inputs)))
    else:
        at = rng.randrange(len(inputs))
        kind = next((k for k, names in have.items() if inputs[at] in names), t.input_type if t.input_type in have else "numeric")
        pool = [c for c in have[kind] if t.allow_replace or c not in inputs]
        if not pool:
            return None
        new = draw(rng, pool, importances, temperature, inactive)
        inputs = [*inputs, new] if way == "add" else [*inputs[:at], new, *inputs[at + 1 :]]
    made = create_gene(g.transformer, inputs, **params)
    if made.output in {x.output for x in individual.genes}:
        return None
    gone = dependent(individual.genes, g.output)
    return individual.copy(genes=[made if x == g else x for x in individual.genes if x not in gone])


def mutate(individual: Individual, rng: Random, allowed: list[str], importances: dict | None = None, temperature: float = 1.0, force_add: bool = False, migrated: list[Gene] = (), gene_migration_prob: float = 0.2, raw_toggle_prob: float = 0.15, recalculate_mask_prob: float = 0.05, chained: list[Gene] | None = None) -> Individual:
    """One change: the mask redrawn or toggled, else a gene removed, modified or added."""
    importances = individual.importances if importances is None else importances
    chained = individual.genes if chained is None else chained
    if not force_add:
        r = rng.random()
        if r < recalculate_mask_prob:
            return recalculate_mask(individual, rng, importances, temperature)
        if r < recalculate_mask_prob + raw_toggle_prob:
            return toggle_raw(individual, rng, importances, temperature)
        if individual.genes:
            r = rng.random()
            if r < 0.33:
                return remove_gene(individual, rng, importances)
            if r < 0.66:
                changed = modify_gene(individual, rng, importances, temperature, chained)
                if changed is not None:
                    return changed
    if migrated and rng.random() < gene_migration_prob:
        known = {g.output for g in individual.genes}
        fits = [g for g in migrated if g.output not in known and len(topological_order([*individual.genes, g], individual.roles.all)) == len(individual.genes) + 1]
        if fits:
            return individual.copy(genes=[*individual.genes, rng.choice(fits)])
    added = new_genes(rng, individual, allowed, importances, temperature, chained, 25 if force_add else 5)
    return individual.copy(genes=[*individual.genes, *added])


def crossover(a: Individual, b: Individual, rng: Random) -> Individual:
    """Each gene of either parent with even odds, and each raw column from either mask."""
    genes = {g.output: g for g in [*a.genes, *b.genes] if rng.random() < 0.5}
    active = [c for c in a.roles.all if c in (a if rng.random() < 0.5 else b).active]
    importances = {k: max(a.importances.get(k, 0), b.importances.get(k, 0)) for k in {*a.importances, *b.importances}}
    return least_active(a.copy(genes=list(genes.values()), active=active, importances=importances), rng)


def union_crossover(a: Individual, b: Individual) -> Individual:
    genes = {g.output: g for g in [*a.genes, *b.genes]}
    return a.copy(genes=list(genes.values()), active=[c for c in a.roles.all if c in a.active or c in b.active])


def tournament_select(population: list[Individual], rng: Random, k: int = 3) -> Individual:
    return max(rng.sample(population, min(k, len(population))), key=lambda i: -math.inf if i.fitness is None else i.fitness)


def initialise_population(size: int, roles: ColumnRoles, rng: Random, allowed: list[str], importances: dict | None = None, initial_genes: int = 2, mask_temperature: float = 0.5) -> list[Individual]:
    """The baseline (all raw columns, no genes), and individuals with drawn masks and a few genes on raw columns."""
    out = [Individual([], roles, list(roles.all))]
    while len(out) < size:
        made = least_active(Individual([], roles, sample_mask(rng, roles, importances, mask_temperature)), rng)
        for _ in range(initial_genes):
            made = mutate(made, rng, allowed, importances or {}, force_add=True, chained=[])
        out.append(made)
    return out


def taboo(individual: Individual, seen: set[str], cache: dict[str, float], best: float | None) -> bool:
    """Whether it stands in the new generation already, or is known to be clearly worse than the best."""
    if individual.signature in seen:
        return True
    if best is None or individual.signature not in cache:
        return False
    slack = max(2e-5, 0.1 * (1 - abs(best))) if abs(best) <= 1 else max(2e-5, 0.01 * abs(best))
    return cache[individual.signature] < best - slack
