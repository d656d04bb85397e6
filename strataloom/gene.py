"""Genes (one derived column each), individuals, and the names and orders they have."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from .roles import ColumnRoles

#: Transformers whose state is the same for every component.
SHARED_STATE = {"pca", "truncated_svd", "mca", "famd", "between_group_pca", "supervised_bgpca", "supervised_mca", "supervised_famd", "umap", "genie_centroid_dist", "lumbermark_centroid_dist"}


@dataclass(frozen=True)
class Gene:
    transformer: str
    inputs: tuple[str, ...]
    params: tuple[tuple[str, object], ...] = ()

    @property
    def options(self) -> dict:
        return dict(self.params)

    @property
    def output(self) -> str:
        """Name of the derived column; equal genes have equal names."""
        key = json.dumps([self.transformer, self.inputs, sorted(self.params)], default=str)
        return f"{self.transformer}_{hashlib.md5(key.encode()).hexdigest()[:6]}"

    @property
    def state_key(self) -> str:
        """Genes with one key share a fitted state."""
        params = sorted((k, v) for k, v in self.params if not (k == "comp_idx" and self.transformer in SHARED_STATE))
        return json.dumps([self.transformer, self.inputs, params], default=str)

    @property
    def formula(self) -> str:
        shown = ", ".join(self.inputs[:3]) + (f", +{len(self.inputs) - 3} more" if len(self.inputs) > 3 else "")
        params = "".join(f", {k}={v}" for k, v in self.params)
        return f"{self.transformer}({shown}{params})"

    def with_params(self, **params) -> Gene:
        return replace(self, params=tuple(sorted({**self.options, **params}.items())))


def create_gene(transformer: str, inputs: list[str] | tuple[str, ...] | str, **params) -> Gene:
    from .registry import TRANSFORMERS

    if transformer not in TRANSFORMERS:
        raise ValueError(f"unknown transformer {transformer!r}; known: {', '.join(sorted(TRANSFORMERS))}")
    return Gene(transformer, (inputs,) if isinstance(inputs, str) else tuple(inputs), tuple(sorted(params.items())))


def topological_order(genes: list[Gene], raw: list[str]) -> list[Gene]:
    """Genes after the columns they need; those that never get theirs are left out."""
    have, order, left = set(raw), [], list(dict.fromkeys(genes))
    while left:
        ready = [g for g in left if set(g.inputs) <= have]
        if not ready:
            break
        order += ready
        have |= {g.output for g in ready}
        left = [g for g in left if g not in ready]
    return order


def levels(genes: list[Gene], raw: list[str]) -> list[list[Gene]]:
    """The same order in steps, each of which needs columns of earlier ones only."""
    depth: dict[str, int] = dict.fromkeys(raw, 0)
    out: list[list[Gene]] = []
    for g in topological_order(genes, raw):
        d = max((depth[c] for c in g.inputs), default=0)
        depth[g.output] = d + 1
        while len(out) <= d:
            out.append([])
        out[d].append(g)
    return out


@dataclass
class Individual:
    """A recipe as the search sees it: genes, and the raw columns that are switched on."""

    genes: list[Gene]
    roles: ColumnRoles
    active: list[str]
    fitness: float | None = None
    raw_fitness: float | None = None
    penalty: float = 0.0
    importances: dict[str, float] = field(default_factory=dict)
    n_folds_ok: int = 0

    def __post_init__(self):
        self.genes = topological_order(self.genes, self.roles.all)

    @property
    def features(self) -> list[str]:
        return [*self.active, *(g.output for g in self.genes)]

    @property
    def recipe_string(self) -> str:
        return f"[{', '.join(g.formula for g in self.genes)}] (active: {len(self.active)}/{len(self.roles.all)} raw, {len(self.genes)} genes)"

    @property
    def signature(self) -> str:
        """All that decides the fitness, unlike the readable string."""
        return json.dumps([sorted(self.active), sorted([g.transformer, g.inputs, g.params] for g in self.genes)], default=str)

    def copy(self, **changes) -> Individual:
        return replace(self, **{"genes": list(self.genes), "active": list(self.active), "fitness": None, "raw_fitness": None, "importances": dict(self.importances), **changes})


def create_individual(genes: list[Gene], roles: ColumnRoles, active: list[str] | None = None) -> Individual:
    return Individual(genes, roles, list(roles.all if active is None else active))
