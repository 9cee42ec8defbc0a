"""Measures of snapshots as joins over their ties: no matrix of a window is formed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.labels import components
from kairograph.plans.storage import keep

#: Measures of components, and the census of triads.
OF_COMPONENTS = ("components", "largest_component", "connectedness", "efficiency")


def component_measures(e: DataFrame, population: DataFrame, at: list[str], directed: bool) -> DataFrame:
    """``at, components, largest_component, connectedness, efficiency``.

    ``population`` has ``at, n``; vertices without ties are components of one.
    """
    label = components(e.select(*at, F.col("from").alias("a"), F.col("to").alias("b")), at)
    size = label.groupBy(*at, "label").agg(F.count("*").cast("double").alias("k"))
    s = size.groupBy(*at).agg(F.sum("k").alias("in"), F.count("*").cast("double").alias("c"), F.max("k").alias("most"), F.sum(F.col("k") * (F.col("k") - 1)).alias("pairs"), F.sum(F.col("k") - 1).alias("needed"), F.sum((F.col("k") - 1) ** 2).alias("spare"))
    m = e.groupBy(*at).agg(F.count("*").cast("double").alias("m"))
    rows = population.join(s, at, "left").join(m, at, "left").na.fill(0.0, ["in", "c", "most", "pairs", "needed", "spare", "m", "n"])
    n, arcs = F.col("n"), F.col("m") * (1.0 if directed else 2.0)
    alone = n - F.col("in")
    most = F.greatest("most", F.when(alone > 0, 1.0).otherwise(0.0))
    over = F.when(F.col("spare") > 0, F.col("spare"))
    return rows.select(
        *at,
        (F.col("c") + alone).alias("components"),
        F.when(n > 0, most / F.when(n > 0, n)).otherwise(0.0).alias("largest_component"),
        F.when(n > 1, F.col("pairs") / F.when(n > 1, n * (n - 1))).otherwise(1.0).alias("connectedness"),
        F.when(n == 0, 0.0).when(F.col("spare") > 0, 1 - (arcs - F.col("needed")) / over).otherwise(float("nan")).alias("efficiency"),
    )


def _dyads(e: DataFrame, at: list[str]) -> DataFrame:
    """``at, a, b, kind`` with a < b: 3 both ways, 1 from a to b, 2 from b to a."""
    low, high = F.least("from", "to"), F.greatest("from", "to")
    way = F.when(F.col("from") < F.col("to"), 1).otherwise(2)
    return e.select(*at, low.alias("a"), high.alias("b"), way.alias("way")).distinct().groupBy(*at, "a", "b").agg(F.sum("way").cast("int").alias("kind"))


def _turned(kind: str):
    """The kind seen from the other end."""
    return F.when(F.col(kind) == 1, 2).when(F.col(kind) == 2, 1).otherwise(F.col(kind))


def triads(e: DataFrame, population: DataFrame, at: list[str]) -> DataFrame:
    """``at`` and a column for each of the sixteen classes.

    Only triangles are listed, each once, by wedges at its vertex of least degree; open
    triads follow from the kinds of dyads at each vertex, those with one dyad from
    degrees, and empty ones are what is left.
    """
    d = keep(_dyads(e, at), "dyads")
    ends = d.select(*at, F.col("a").alias("v"), F.col("b").alias("w"), "kind").unionByName(d.select(*at, F.col("b").alias("v"), F.col("a").alias("w"), _turned("kind").alias("kind")))
    is_kind = lambda k: F.sum((F.col("kind") == k).cast("double"))
    deg = keep(ends.groupBy(*at, "v").agg(F.count("*").cast("double").alias("deg"), is_kind(3).alias("mu"), is_kind(1).alias("out"), is_kind(2).alias("in")), "degrees")
    # Dyads lead from the end of less degree to the other, so a hub has few to pair.
    rank = lambda v, as_: deg.select(*at, F.col("v").alias(v), F.struct("deg", "v").alias(as_))
    up = ends.join(rank("v", "rv"), [*at, "v"]).join(rank("w", "rw"), [*at, "w"]).filter("rv < rw").select(*at, "v", "w", "kind", "rw")
    x, y = up.withColumnsRenamed({"w": "x", "kind": "kx", "rw": "rx"}), up.withColumnsRenamed({"w": "y", "kind": "ky", "rw": "ry"})
    wedge = x.join(y, [*at, "v"]).filter("rx < ry")
    closing = up.select(*at, F.col("v").alias("x"), F.col("w").alias("y"), F.col("kind").alias("kz"))
    tri = wedge.join(closing, [*at, "x", "y"])
    both = sum((F.col(k) == 3).cast("int") for k in ("kx", "ky", "kz"))
    # Arcs that are not returned: how many leave and enter each of the three vertices.
    leaves = lambda k, mine: F.when(F.col(k) == 3, 0).when(F.col(k) == mine, 1).otherwise(0)
    out_v, out_x, out_y = leaves("kx", 1) + leaves("ky", 1), leaves("kx", 2) + leaves("kz", 1), leaves("ky", 2) + leaves("kz", 2)
    top = F.greatest(out_v, out_x, out_y)
    # The vertex that no mutual tie reaches, where there is one mutual tie.
    lone = F.when(F.col("kz") == 3, out_v).when(F.col("ky") == 3, out_x).otherwise(out_y)
    name = (
        F.when(both == 3, "300").when(both == 2, "210").when(both == 0, F.when(top == 2, "030T").otherwise("030C"))
        .otherwise(F.when(lone == 2, "120D").when(lone == 0, "120U").otherwise("120C"))
    )
    closed = tri.select(*at, name.alias("name"), "kx", "ky", "kz", "v", "x", "y")
    names = ("030T", "030C", "120D", "120U", "120C", "210", "300")
    closed_counts = closed.groupBy(*at).agg(*(F.sum((F.col("name") == c).cast("double")).alias(c) for c in names), *_wedges_of_triangles())
    # Pairs of dyads at each vertex by their kinds; those of triangles come off.
    pair = lambda c: F.col(c) * (F.col(c) - 1) / 2
    at_v = {"021D": pair("out"), "021U": pair("in"), "021C": F.col("out") * F.col("in"), "111U": F.col("mu") * F.col("out"), "111D": F.col("mu") * F.col("in"), "201": pair("mu")}
    open_ = deg.groupBy(*at).agg(*(F.sum(c).alias(f"all_{k}") for k, c in at_v.items()))
    n = F.col("n")
    ones = d.join(deg.select(*at, F.col("v").alias("a"), F.col("deg").alias("da")), [*at, "a"]).join(deg.select(*at, F.col("v").alias("b"), F.col("deg").alias("db")), [*at, "b"])
    single = ones.groupBy(*at).agg(*(F.sum(F.when(F.col("kind") == 3 if k == "102" else F.col("kind") != 3, F.col("da") + F.col("db") - 2)).alias(f"near_{k}") for k in ("012", "102")), *(F.sum((F.col("kind") == 3 if k == "102" else F.col("kind") != 3).cast("double")).alias(f"dyads_{k}") for k in ("012", "102")))
    rows = population.join(closed_counts, at, "left").join(open_, at, "left").join(single, at, "left").na.fill(0.0)
    value = {c: F.col(c) for c in names}
    for k in at_v:
        value[k] = F.col(f"all_{k}") - F.col(f"in_{k}")
    for k in ("012", "102"):
        # Third vertices that touch neither end: all others, less neighbours; a common one counts once.
        value[k] = F.col(f"dyads_{k}") * (n - 2) - F.col(f"near_{k}") + F.col(f"shared_{k}")
    rest = sum(value.values(), F.lit(0.0))
    value["003"] = F.greatest(n * (n - 1) * (n - 2) / 6 - rest, F.lit(0.0))
    return rows.select(*at, *(value[c].alias(c) for c in CLASSES))


#: The classes in their order.
CLASSES = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def _wedges_of_triangles() -> list:
    """How many pairs of dyads of each kind triangles have, and how many dyads of each kind lie in a triangle."""
    corners = ((F.col("kx"), F.col("ky")), (_turned("kx"), F.col("kz")), (_turned("ky"), _turned("kz")))
    kinds = {"021D": (1, 1), "021U": (2, 2), "021C": (1, 2), "111U": (3, 1), "111D": (3, 2), "201": (3, 3)}
    out = []
    for k, (p, q) in kinds.items():
        hit = sum((((a == p) & (b == q)) | ((a == q) & (b == p))).cast("double") for a, b in corners)
        out.append(F.sum(hit).alias(f"in_{k}"))
    mutual = sum((F.col(k) == 3).cast("double") for k in ("kx", "ky", "kz"))
    return [*out, F.sum(mutual).alias("shared_102"), F.sum(3 - mutual).alias("shared_012")]


def coreness(arcs: DataFrame, at: list[str]) -> DataFrame:
    """``at, v, core`` of vertices by arcs ``v, w``: in every round a vertex takes the largest h of which h neighbours have h or more.

    These numbers fall from the degrees to the cores (Lü and others, 2016); a pair may
    have two arcs, which count as two.
    """
    arcs = keep(arcs.select(*at, "v", "w"), "arcs")
    now = keep(arcs.groupBy(*at, "v").agg(F.count("*").alias("core")), "cores")
    order = Window.partitionBy(*at, "v").orderBy(F.desc("near"))
    while True:
        # Merged, not broadcast: else the driver would collect a row for each vertex in every round.
        near = arcs.join(now.select(*at, F.col("v").alias("w"), F.col("core").alias("near")).hint("merge"), [*at, "w"], "left").na.fill(0, ["near"])
        h = near.withColumn("i", F.row_number().over(order)).groupBy(*at, "v").agg(F.max(F.least("near", F.col("i").cast("long"))).alias("h"))
        after = keep(now.join(h.hint("merge"), [*at, "v"]).select(*at, "v", F.col("core").alias("old"), F.least("core", "h").alias("core")), "cores")
        now = after.select(*at, "v", "core")
        if after.filter("old <> core").isEmpty():
            return now
