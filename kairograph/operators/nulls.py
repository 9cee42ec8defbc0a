"""Significance against null models, and generators of networks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.errors import BadInput
from kairograph.functions.islands import islands
from kairograph.operators.surrogates import MODELS, surrogates
from kairograph.plans.network import Network, build
from kairograph.plans.storage import keep

__all__ = ["MODELS", "null_summary", "random_network", "randomise", "renewal_network", "significance", "summarise_null", "surrogates"]

def randomise(net: Network, model: str = "times", n: int = 1, seed: int = 1, within: str = "network", **how) -> DataFrame:
    """``replicate`` and spells of ``n`` surrogates; ``surrogates`` says what each model keeps."""
    return surrogates(net, model, n, seed, within, **how).spells


def significance(net: Network, statistic: Callable[[Network], DataFrame], keys: list[str], value: str = "value", model: str = "times", n: int = 99, seed: int = 1, alternative: str = "two.sided", within: str = "network", **how) -> DataFrame:
    """Observed values against surrogates, cell by cell.

    ``observed, null_mean, null_sd, null_low, null_high, z, n_null, p, p_adj, mcse``;
    a surrogate without a cell is missing there, not nought.  The statistic is run
    once on each surrogate network.
    """
    drawn = surrogates(net, model, n, seed, within, **how)
    drawn = replace(drawn, spells=keep(drawn.spells, "surrogates", "replicate"))
    parts = None
    for r in range(1, n + 1):
        one = statistic(drawn.network(r)).select(*keys, F.col(value).cast("double").alias("null"))
        parts = one if parts is None else parts.unionByName(one)
    seen = statistic(net).select(*keys, F.col(value).cast("double").alias("observed"))
    return summarise_null(seen, parts, keys, alternative)


def summarise_null(seen: DataFrame, null: DataFrame, keys: list[str], alternative: str = "two.sided") -> DataFrame:
    """Summary of surrogate values for each observed cell, with corrected p-values."""
    if alternative not in ("two.sided", "greater", "less"):
        raise BadInput("alternative is two.sided, greater or less")
    mean = null.groupBy(*keys).agg(F.avg("null").alias("null_mean"))
    both = seen.join(mean, keys, "left").join(null, keys, "left")
    near = F.lit(2.0**-26) * F.greatest(F.lit(1.0), F.abs("observed"))
    up, down = F.col("null") >= F.col("observed") - near, F.col("null") <= F.col("observed") + near
    far = F.abs(F.col("null") - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean")) - near
    extreme = {"greater": up, "less": down, "two.sided": far}[alternative]
    g = both.groupBy(*keys, "observed", "null_mean").agg(
        F.stddev_samp("null").alias("null_sd"), F.percentile("null", F.lit(0.025)).alias("null_low"), F.percentile("null", F.lit(0.975)).alias("null_high"),
        F.count("null").alias("n_null"), F.count(F.when(extreme, 1)).alias("hits"), F.count(F.when(up & down, 1)).alias("n_ties"),
    )
    g = g.withColumn("p", (1 + F.col("hits")) / (1 + F.col("n_null"))).withColumn("z", F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.when(F.col("null_sd") > 0, F.col("null_sd")).otherwise(1.0)))
    g = g.withColumn("mcse", F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("n_null") + 1)))
    # Cells share few p-values, at most one for each number of hits: those are ordered, not the cells.
    at = g.groupBy("p").agg(F.count("*").alias("_c"))
    w = Window.orderBy("p")
    at = at.withColumns({"_below": F.sum("_c").over(w), "_total": F.sum("_c").over(Window.partitionBy())})
    at = at.withColumn("p_adj", F.least(F.lit(1.0), F.min(F.col("p") * F.col("_total") / F.col("_below")).over(Window.orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, 0)))).select("p", "p_adj")
    return g.join(F.broadcast(at), "p").select(*keys, "observed", "null_mean", "null_sd", "null_low", "null_high", "n_null", "n_ties", "p", "z", "mcse", "p_adj")


def null_summary(statistics: DataFrame, value: str = "value") -> DataFrame:
    """``replicate, n, mean, sd, min, max`` of a statistic's values on each surrogate."""
    v = F.col(value)
    return statistics.groupBy("replicate").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def random_network(spark: SparkSession, n: int, slices: int, p: float = 0.1, birth: float | None = None, persist: float | None = None, directed: bool = True, groups: int | None = None, p_between: float | None = None, seed: int = 1) -> Network:
    """Ties drawn in each slice, or by a chain of births and survivals; runs become spells."""
    pairs = spark.range(n).select(F.col("id").alias("a")).join(spark.range(n).select(F.col("id").alias("b")), F.col("a") != F.col("b") if directed else F.col("a") < F.col("b"))
    draw = lambda salt, *c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *c), 11).cast("double") * 2.0**-53
    chance = F.lit(p) if groups is None else F.when(F.col("a") % groups == F.col("b") % groups, p).otherwise(p if p_between is None else p_between)
    if birth is None:
        on = pairs.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).filter(draw("iid", "a", "b", "t") < chance)
    else:
        stay = persist if persist is not None else 0.5
        steps = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda t: F.struct(t.alias("t"), draw("m", "a", "b", t).alias("u")))
        first = F.lit(birth / (birth + 1 - stay) if birth + 1 - stay > 0 else birth)
        chain = F.aggregate(steps, F.array().cast("array<struct<t:int,on:boolean>>"), lambda acc, x: F.concat(acc, F.array(F.struct(x["t"].alias("t"), (x["u"] < F.when(x["t"] == 0, first).when(F.element_at(acc, -1)["on"], stay).otherwise(birth)).alias("on")))))
        on = pairs.withColumn("x", F.explode(chain)).filter("x.on").select("a", "b", F.col("x.t").alias("t"))
    cells = on.select(F.col("a").cast("string").alias("from"), F.col("b").cast("string").alias("to"), F.col("t").cast("double").alias("start"), (F.col("t") + 1).cast("double").alias("end"))
    nodes = spark.range(n).select(F.col("id").cast("string").alias("name"), *([(F.col("id") % groups).cast("string").alias("group")] if groups else []))
    return build(islands(cells, ["from", "to"]), directed, nodes=nodes, keep_isolates=True, check=False, observed=((0.0, float(slices)),))


def renewal_network(spark: SparkSession, n: int, rate: float, horizon: float, gaps: str = "exponential", shape: float = 1.0, directed: bool = True, seed: int = 1) -> Network:
    """Contacts of each pair by a renewal process with a mean gap of ``1 / rate``."""
    if gaps not in ("exponential", "weibull", "lognormal"):
        raise BadInput(f"unknown gaps {gaps!r}")
    pairs = spark.range(n).select(F.col("id").alias("a")).join(spark.range(n).select(F.col("id").alias("b")), F.col("a") != F.col("b") if directed else F.col("a") < F.col("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b in pdf.itertuples(index=False):
                rng, t = np.random.default_rng([seed, a, b]), 0.0
                while True:
                    if gaps == "exponential":
                        g = rng.exponential(1 / rate)
                    elif gaps == "weibull":
                        g = rng.weibull(shape) / rate / math.gamma(1 + 1 / shape)
                    else:
                        g = rng.lognormal(-shape * shape / 2, shape) / rate
                    t += g
                    if t > horizon:
                        break
                    rows.append((str(a), str(b), t, t))
            yield pd.DataFrame(rows, columns=["from", "to", "start", "end"])

    nodes = spark.range(n).select(F.col("id").cast("string").alias("name"))
    return build(pairs.mapInPandas(run, "from string, to string, start double, end double"), directed, nodes=nodes, keep_isolates=True, check=False, observed=((0.0, float(horizon)),), format="contact")
