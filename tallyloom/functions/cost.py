"""Token and accelerator cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: USD an hour.
GPU_RATES = {
    "A100": 1.86, "A100-40GB": 1.86, "A100-80GB": 2.50, "A10G": 1.10, "A10": 1.10, "L40S": 1.95, "L4": 0.80, "T4": 0.59, "H100": 4.40,
    "H100-80GB": 4.40, "CPU": 0.135,
}
BATCH_DISCOUNT = 0.5
MILLION = 1_000_000.0


def _n(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def token_cost(fresh: Column, cached: Column, created: Column, output: Column, price_in: Column, price_cached: Column, price_out: Column, batch: Column, convention: str = "inclusive") -> Column:
    """M1 (``inclusive``: input counts cached tokens too, creation at the full rate) and M2 (``exclusive``: creation at 1.25).

    Unknown models (null prices) cost 0.
    """
    if convention == "inclusive":
        paid, made = F.greatest(_n(fresh) - _n(cached), F.lit(0.0)) + _n(created), F.lit(0.0)
    else:
        paid, made = _n(fresh), _n(created) * 1.25
    raw = (paid + made) / MILLION * price_in + _n(cached) / MILLION * price_cached + _n(output) / MILLION * price_out
    return F.coalesce(F.when(batch, raw * BATCH_DISCOUNT).otherwise(raw), F.lit(0.0))


def priced(usage: DataFrame, prices: DataFrame, convention: str = "inclusive") -> DataFrame:
    """``usage`` (model, input, cached, created, output, batch) with cost_usd. ``prices``: (model, price_in, price_cached, price_out), a row a model."""
    joined = usage.join(prices, "model", "left")
    c = F.col
    cost = token_cost(c("input"), c("cached"), c("created"), c("output"), c("price_in"), c("price_cached"), c("price_out"), c("batch"), convention)
    return joined.withColumn("cost_usd", cost).drop("price_in", "price_cached", "price_out")


def gpu_cost(gpu: Column, seconds: Column) -> Column:
    """M3: unknown kinds pay the CPU rate; negative time fails the query."""
    rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GPU_RATES.items() for x in kv]), gpu), F.lit(GPU_RATES["CPU"])) / 3600
    return F.when(seconds < 0, F.raise_error(F.lit("negative wall-clock time")).cast("double")).otherwise(rate * seconds)


def ceil_div(a: Column, b: Column) -> Column:
    """M4 on integers."""
    return F.ceil(a / b).cast("long")


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """M7: ``empty`` where the divisor is 0."""
    r = F.try_divide(a, b)
    return r if empty is None else F.coalesce(r, F.lit(empty))


def reported(value: Column, places: int = 6) -> Column:
    """M6: rounded as reports show it: 6 places of a cost, 4 of a total, 2 of a time."""
    return F.round(value.cast("double"), places)


def synth_projection(n: Column, prefix: int, suffix: int, output: int, price_in: float, price_cached: float, price_out: float) -> Column:
    """One request creates the cached prefix, the others read it."""
    made = prefix / MILLION * price_in * 1.25
    read = (n - 1) * (prefix / MILLION * price_cached)
    each = n * (suffix / MILLION * price_in + output / MILLION * price_out)
    return F.when(n > 0, (F.lit(made) + read + each) * BATCH_DISCOUNT).otherwise(0.0)
