"""Parts, cycles and differences of datetimes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..registry import Transformer, fill, register_transformer
from ..roles import DATETIME_FORMATS


def moment(c: str):
    """A timestamp from a timestamp, a date, or a string in any known format."""
    raw = F.col(f"`{c}`").cast("string")
    return F.coalesce(F.col(f"`{c}`").try_cast("timestamp"), *[F.try_to_timestamp(raw, F.lit(f)) for f in DATETIME_FORMATS])


class DatetimeExtract(Transformer):
    name, input_type = "datetime_extract", "datetime"
    parts = ("year", "month", "day", "hour", "day_of_week", "weekend")

    def sample_params(self, rng, n_inputs):
        return {"component": rng.choice(self.parts)}

    def column(self, gene, state, found):
        t, part = moment(gene.inputs[0]), gene.options.get("component", "month")
        weekday = F.weekday(t) + 1
        value = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "day_of_week": weekday, "weekend": (weekday >= 6).cast("int")}.get(part, F.lit(0))
        return F.coalesce(value.cast("double"), F.lit(0.0))


class DateDiff(Transformer):
    name, arity, input_type, n_inputs = "date_diff", "binary", "datetime", (2, 2)

    def column(self, gene, state, found):
        a, b = moment(gene.inputs[0]), moment(gene.inputs[1])
        return fill((F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400_000_000.0), 0.0)


class DatetimeCyclic(Transformer):
    name, input_type = "datetime_cyclic", "datetime"
    cycles = {"hour": 24.0, "wday": 7.0, "month": 12.0, "yday": 365.25}

    def sample_params(self, rng, n_inputs):
        return {"component": rng.choice([f"{c}_{f}" for c in self.cycles for f in ("sin", "cos")])}

    def column(self, gene, state, found):
        t = moment(gene.inputs[0])
        part, _, wave = gene.options.get("component", "hour_sin").partition("_")
        if part not in self.cycles or wave not in ("sin", "cos"):
            return F.lit(0.0)
        value = {"hour": F.hour(t), "wday": F.weekday(t), "month": F.month(t) - 1, "yday": F.dayofyear(t) - 1}[part]
        angle = F.lit(2 * math.pi) * value / F.lit(self.cycles[part])
        return F.coalesce(F.sin(angle) if wave == "sin" else F.cos(angle), F.lit(0.0))


for kind in (DatetimeExtract, DateDiff, DatetimeCyclic):
    register_transformer(kind())
