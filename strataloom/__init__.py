"""Evolutionary feature engineering on Spark DataFrames."""

import os

# Tasks and driver threads run side by side; BLAS threads of their own only get in the way, and can hang.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

__version__ = "0.1.0"
