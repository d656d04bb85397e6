"""The recipe compiler: fits and applies genes level by level with few scans and few joins.

Fit: all global statistics of a level are one aggregate, all dictionaries with the same key are one
grouped aggregate, and genes that differ in their component share a state. Apply: column genes of a
level are one projection, and dictionaries with the same key are one left join. Dictionaries of up
to ``LOCAL_KEYS`` keys are broadcast; larger ones stay tables, for which Spark chooses the join.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators  # noqa: F401  registers the transformers
from ..functions.linalg import correlation
from ..gene import Gene, Individual, levels
from ..options import OPTIONS
from ..registry import TRANSFORMERS, State, Target, Transformer
from ..roles import finite

#: Keys of a dictionary that is collected and broadcast.
LOCAL_KEYS = 100_000


def key_name(gene: Gene) -> str:
    """Genes with equal key expressions over equal columns share a dictionary."""
    return str(TRANSFORMERS[gene.transformer].key(gene))


def fit_genes(df: DataFrame, genes: list[Gene], target: Target | None, states: dict[str, State]) -> None:
    """Fit the genes of one level into ``states`` (by state key)."""
    todo: dict[str, Gene] = {}
    for g in genes:
        if g.state_key not in states:
            todo.setdefault(g.state_key, g)
    totals, grouped = {}, defaultdict(dict)
    for i, (k, g) in enumerate(list(todo.items())):
        t = TRANSFORMERS[g.transformer]
        own = t.fit(df, g, target)
        if own is not None:
            states[k] = own
            del todo[k]
            continue
        totals |= {f"t{i}_{n}": c.alias(f"t{i}_{n}") for n, c in t.totals(g, target).items()}
        if t.key(g) is not None:
            grouped[key_name(g)] |= {f"t{i}_{n}": c.alias(f"t{i}_{n}") for n, c in t.grouped(g, target).items()}
        todo[k] = (i, g)  # type: ignore[assignment]
    row = df.agg(*totals.values()).first().asDict() if totals else {}
    tables: dict[str, DataFrame] = {}
    for k, (i, g) in todo.items():  # type: ignore[misc]
        t = TRANSFORMERS[g.transformer]
        table = None
        if t.key(g) is not None and grouped[key_name(g)]:
            name = key_name(g)
            if name not in tables:
                tables[name] = settle(df.groupBy(t.key(g).alias("key")).agg(*grouped[name].values()))
            mine = [c for c in tables[name].columns if c.startswith(f"t{i}_")]
            table = tables[name].select("key", *[F.col(c).alias(c.split("_", 1)[1]) for c in mine])
        states[k] = local(t.finish(g, {n.split("_", 1)[1]: v for n, v in row.items() if n.startswith(f"t{i}_")}, table, target))


def settle(table: DataFrame) -> DataFrame:
    """A small table as local rows, so that several uses cost one job; a large one as it is."""
    head = table.limit(LOCAL_KEYS + 1).collect()
    return table.sparkSession.createDataFrame(head, table.schema) if len(head) <= LOCAL_KEYS else table


def local(state: State) -> State:
    if state.table is not None and state.columns:
        table = state.table.select("key", *state.columns)
        head = table.limit(LOCAL_KEYS + 1).collect()
        if len(head) <= LOCAL_KEYS:
            state.rows, state.table = [tuple(r) for r in head], None
    return state


def apply_genes(df: DataFrame, genes: list[Gene], states: dict[str, State]) -> DataFrame:
    """Append the genes of one level. No action runs."""
    plain, keyed, custom = [], defaultdict(list), []
    for g in dict.fromkeys(genes):
        t, s = TRANSFORMERS[g.transformer], states[g.state_key]
        if s.valid and s.columns and (s.rows is not None or s.table is not None):
            keyed[key_name(g)].append(g)
        else:
            plain.append(g)
    kept = df.columns
    made = {}
    for n, group in enumerate(keyed.values()):
        df, found = join_dictionary(df, group, states, n)
        made |= {g.output: TRANSFORMERS[g.transformer].column(g, states[g.state_key], found[g.state_key]) for g in group}
    for g in plain:
        t, s = TRANSFORMERS[g.transformer], states[g.state_key]
        if type(t).apply is not Transformer.apply:
            whole = t.apply(df, g, s)
            if whole is not None:
                df, custom = whole, [*custom, g.output]
                continue
        made[g.output] = t.column(g, s, {})
    made = {n: guard(c, g) for n, c, g in ((g.output, made[g.output], g) for g in dict.fromkeys(genes) if g.output in made)}
    return df.withColumns(made).select(*kept, *custom, *made)


def guard(column, gene: Gene):
    """Numeric columns within the range of 32-bit floats; others as strings."""
    return finite(column.cast("double")) if TRANSFORMERS[gene.transformer].output_type == "numeric" else column.cast("string")


def join_dictionary(df: DataFrame, genes: list[Gene], states: dict[str, State], n: int):
    """Left join, null-safe, with one dictionary that holds the columns of all these genes' states."""
    unique = {g.state_key: states[g.state_key] for g in genes}
    found, key = {}, f"__k{n}"
    df = df.withColumn(key, TRANSFORMERS[genes[0].transformer].key(genes[0]))
    small = {k: s for k, s in unique.items() if s.rows is not None}
    if small:
        names = {(k, c): f"__d{n}_{i}_{c}" for i, (k, s) in enumerate(small.items()) for c in s.columns}
        rows: dict = defaultdict(dict)
        for k, s in small.items():
            for r in s.rows:
                rows[r[0]].update({names[k, c]: v for c, v in zip(s.columns, r[1:], strict=True)})
        schema = f"`{key}_r` string, " + ", ".join(f"`{v}` double" for v in names.values())
        data = [(k, *[None if v.get(c) is None else float(v[c]) for c in names.values()]) for k, v in rows.items()]
        table = df.sparkSession.createDataFrame(data, schema)
        df = df.join(F.broadcast(table), df[key].eqNullSafe(table[f"{key}_r"]), "left")
        found |= {k: {c: F.col(names[k, c]) for c in s.columns} for k, s in small.items()}
    for i, (k, s) in enumerate((k, s) for k, s in unique.items() if s.rows is None):
        names = {c: f"__e{n}_{i}_{c}" for c in s.columns}
        table = s.table.select(F.col("key").alias(f"{key}_t{i}"), *[F.col(c).cast("double").alias(v) for c, v in names.items()])
        df = df.join(table, df[key].eqNullSafe(table[f"{key}_t{i}"]), "left")
        found[k] = {c: F.col(v) for c, v in names.items()}
    return df, found


class RejectedColumn(ValueError):
    """A derived column that says nothing new."""


def rejected(df: DataFrame, outputs: list[str], threshold: float | None = None, against: list[str] | None = None) -> dict[str, str]:
    """Reasons to drop columns: constant, or correlated with an earlier one beyond ``threshold``. One aggregate for all."""
    threshold = OPTIONS["redundancy_cor_threshold"] if threshold is None else threshold
    kinds = dict(df.dtypes)
    numeric = [c for c in outputs if kinds[c] == "double"]
    earlier = [c for c in (df.columns if against is None else against) if kinds.get(c) in ("double", "float", "int", "bigint") and c not in outputs]
    aggs = [F.min(f"`{c}`").alias(f"lo{i}") for i, c in enumerate(outputs)] + [F.max(f"`{c}`").alias(f"hi{i}") for i, c in enumerate(outputs)]
    pairs = [(c, e) for i, c in enumerate(numeric) for e in [*earlier, *numeric[:i]]]
    for i, (c, e) in enumerate(pairs):
        both = F.col(f"`{c}`").isNotNull() & F.col(f"`{e}`").isNotNull()
        aggs += [correlation(F.col(f"`{c}`"), F.col(f"`{e}`").cast("double")).alias(f"r{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    row = df.agg(*aggs).first() if aggs else {}
    out = {c: "constant" for i, c in enumerate(outputs) if row[f"lo{i}"] == row[f"hi{i}"]}
    for i, (c, e) in enumerate(pairs):
        r = row[f"r{i}"]
        if c not in out and e not in out and row[f"n{i}"] > 2 and r is not None and r == r and abs(r) >= threshold:
            out[c] = f"redundant with {e}"
    return out


def fit_apply(individual: Individual, train: DataFrame, target: Target | None, others: list[DataFrame] = (), prune: bool = True, states: dict[str, State] | None = None, redundancy: bool = False) -> tuple[DataFrame, list[DataFrame], Individual, dict[str, State]]:
    """Fit all genes on ``train`` and append them there and to ``others``; (train, others, individual, states).

    Genes that are constant, or with ``redundancy`` nearly copies of another column, are dropped
    with what needs them. Raw columns come back until enough features are active.
    """
    states = {} if states is None else states
    others, dropped, kept = list(others), set(), []
    for step in levels(individual.genes, individual.roles.all):
        step = [g for g in step if not set(g.inputs) & dropped]
        fit_genes(train, step, target, states)
        train = apply_genes(train, step, states)
        if prune and step:
            known = [*individual.roles.all, *(g.output for g in kept)]
            bad = rejected(train, [g.output for g in step], against=known if redundancy else [], threshold=None if redundancy else 2.0)
            dropped |= set(bad)
            if bad:
                train = train.drop(*bad)
                step = [g for g in step if g.output not in bad]
        others = [apply_genes(o, step, states) for o in others]
        kept += step
    done = individual.copy(genes=kept)
    least = min(2, len(individual.roles.all))
    missing = [c for c in individual.roles.all if c not in done.active]
    while len(done.features) < least and missing:
        done.active.append(missing.pop(0))
    return train, others, done, states


def apply_fitted(individual: Individual, df: DataFrame, states: dict[str, State]) -> DataFrame:
    """Append all genes with frozen states; no action, so the result is as lazy, or as streaming, as ``df``."""
    for step in levels(individual.genes, individual.roles.all):
        df = apply_genes(df, step, states)
    return df


def apply_gene(gene: Gene, train: DataFrame, others: list[DataFrame] = (), target: Target | None = None, states: dict[str, State] | None = None, check: bool = True) -> tuple[DataFrame, list[DataFrame], State]:
    """One gene, fitted on ``train``; a constant or redundant column is an error."""
    states = {} if states is None else states
    fit_genes(train, [gene], target, states)
    out = apply_genes(train, [gene], states)
    if check:
        bad = rejected(out, [gene.output])
        if bad:
            raise RejectedColumn(f"{gene.output}: {bad[gene.output]}")
    return out, [apply_genes(o, [gene], states) for o in others], states[gene.state_key]
