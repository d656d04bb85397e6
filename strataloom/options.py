"""Options of the package, which users set by name."""

from __future__ import annotations

from contextlib import contextmanager

OPTIONS: dict[str, object] = {
    "verbose": False,  # print the search's events
    "threads": 2,  # evaluations that run side by side
    "max_clustering_size": 5000,  # distinct rows that a quadratic method is fitted on
    "redundancy_cor_threshold": 0.95,  # correlation from which a derived column says nothing new
    "importance_threshold": 0.001,  # share of all importance below which a feature counts as unimportant
    "viewer_port": 0,  # port of the live viewer; 0 is any free one
}


def set_options(**values) -> None:
    for name in values:
        if name not in OPTIONS:
            raise ValueError(f"unknown option {name!r}; known: {', '.join(OPTIONS)}")
    OPTIONS.update(values)


@contextmanager
def options(**values):
    """Options for a while."""
    before = dict(OPTIONS)
    set_options(**values)
    try:
        yield
    finally:
        OPTIONS.update(before)
