"""The transformers; importing this registers all of them."""

from . import arithmetic, binning, categorical, cluster, datetime, groupby, linear, target  # noqa: F401
