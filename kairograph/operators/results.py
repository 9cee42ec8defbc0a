"""Accessors of networks and of tidy results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import BadInput
from kairograph.plans.grid import make_grid
from kairograph.plans.network import Network

IDS = ("session", "node", "from", "to", "node1", "node2")


def tidy(net: Network, what: str = "edges") -> DataFrame:
    """One of a network's tables: edges, observed_edges, nodes, bins, observations, vertex_spells."""
    spark = net.spells.sparkSession
    if what == "edges":
        return net.spells.withColumn("duration", F.col("end") - F.col("start"))
    if what == "observed_edges":
        return net.fragments().withColumn("duration", F.col("end") - F.col("start"))
    if what == "nodes":
        return net.nodes
    if what == "bins":
        return make_grid(net).frame(spark)
    if what == "observations":
        return spark.createDataFrame([(i + 1, a, b, b - a) for i, (a, b) in enumerate(net.observed or (net.span(),))], "observation int, start double, end double, duration double")
    if what == "vertex_spells":
        if net.presence is None:
            return spark.createDataFrame([], "node string, start double, end double, duration double")
        return net.presence.withColumn("duration", F.col("end") - F.col("start"))
    raise BadInput(f"unknown table {what!r}")


def widen(result: DataFrame) -> DataFrame:
    """Long to wide: one column for each time, or for each measure if there is no time."""
    ids = [c for c in result.columns if c in IDS]
    if "time" in result.columns:
        keys = [*ids, *(["measure"] if "measure" in result.columns else [])]
        return result.withColumn("_t", F.concat(F.lit("t"), F.regexp_replace(F.col("time").cast("decimal(38,6)").cast("string"), r"\.?0+$", ""))).groupBy(*keys).pivot("_t").agg(F.first("value"))
    return result.groupBy(*ids).pivot("measure").agg(F.first("value"))


def top_nodes(result: DataFrame, top: int) -> DataFrame:
    """Rows of the ``top`` vertices by mean value."""
    mean = result.filter(~F.isnan("value")).groupBy("node").agg(F.avg("value").alias("m"))
    best = mean.orderBy(F.desc("m"), "node").limit(top).select("node")
    return result.join(best, "node", "left_semi")


def summarise(result: DataFrame) -> DataFrame:
    """``n, mean, sd, min, max, peak_time`` for each subject and measure."""
    ids = [c for c in result.columns if c in (*IDS, "measure")]
    known = result.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    peak = [F.max_by("time", F.struct("value", -F.col("time"))).alias("peak_time")] if "time" in result.columns else []
    return known.groupBy(*ids).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), *peak)


def animation_bins(net: Network, **grid) -> DataFrame:
    """``time, nodes, ties, forming, dissolving`` between neighbouring windows."""
    from kairograph.plans.grid import snapshot_edges

    g = make_grid(net, **grid)
    e = snapshot_edges(net, g).select("bin", "from", "to")
    w = Window.partitionBy("from", "to").orderBy("bin")
    m = e.withColumns({"new": F.coalesce(F.lag("bin").over(w) != F.col("bin") - 1, F.lit(True)), "last": F.coalesce(F.lead("bin").over(w) != F.col("bin") + 1, F.lit(True))})
    ties = m.groupBy("bin").agg(F.count("*").alias("ties"), F.count(F.when(F.col("new"), 1)).alias("forming"), F.count(F.when(F.col("last"), 1)).alias("dissolving"))
    nodes = e.select("bin", F.explode(F.array("from", "to")).alias("v")).groupBy("bin").agg(F.countDistinct("v").alias("nodes"))
    frame, last = g.frame(net.spells.sparkSession).select("bin", "time"), len(g.bins)
    z = lambda c: F.coalesce(c, F.lit(0))
    out = frame.join(ties, "bin", "left").join(nodes, "bin", "left")
    return out.select("time", z("nodes").alias("nodes"), z("ties").alias("ties"), F.when(F.col("bin") > 1, z("forming")).alias("forming"), F.when(F.col("bin") < last, z("dissolving")).alias("dissolving"))
