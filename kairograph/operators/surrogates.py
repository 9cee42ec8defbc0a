"""Surrogate networks: permutations, swaps of ends, and draws that keep to presence and watched time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from kairograph.errors import BadInput, BadScope, NoValidDraw
from kairograph.functions.timeops import c_leq
from kairograph.operators.swaps import TALLY, Rules, _dealt, _mended, _mixed, _packed, _runs
from kairograph.plans.network import Network
from kairograph.plans.storage import ROWS, keep

MODELS = ("times", "timeline", "labels", "targets", "edges", "reversal")
SCOPED = ("times", "timeline", "targets")
RESPECT = ("activity", "observation")
#: Rows of a scope that one task puts in order.
SLICE = 200_000
#: Rows of all replicates in a slice whose rows take values of others, and the least of one replicate.
GROUP, LEAST = 400_000, 5_000
#: Most readings of the spells side by side for their replicates.
READS = 16


@dataclass(frozen=True)
class Surrogates:
    """``spells`` and ``presence`` of all surrogates by ``replicate``, and a ``report`` of how they were drawn.

    The report has ``replicate, rejected, acceptance``: ties met outside presence or
    watched time while drawing, and the share of proposed swaps that were made (null for
    models without swaps).  Below a half the surrogates stay near the network.
    """

    source: Network
    spells: DataFrame
    presence: DataFrame | None
    report: DataFrame

    def network(self, replicate: int) -> Network:
        """One surrogate as a network."""
        own = lambda d: d.filter(F.col("replicate") == replicate).drop("replicate")
        return self.source.with_(spells=own(self.spells), presence=None if self.presence is None else own(self.presence))

    def summary(self) -> DataFrame:
        """``replicate, n_events, n_pairs, t_min, t_max, mean_duration, rejected``."""
        length = F.col("end") - F.col("start")
        g = self.spells.groupBy("replicate").agg(F.count("*").alias("n_events"), F.countDistinct("from", "to").alias("n_pairs"), F.min("start").alias("t_min"), F.max("end").alias("t_max"), F.avg(length).alias("mean_duration"))
        return g.join(F.broadcast(self.report.select("replicate", "rejected")), "replicate")  # a row for each replicate


def _copies(df: DataFrame, which: list[int]) -> DataFrame:
    return df.withColumn("replicate", F.explode(F.array(*[F.lit(r) for r in which])))


def draw(seed: int, salt: str, *columns: str) -> Column:
    """Thirty-two hexadecimal digits for each row and replicate, the same whatever the partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.col(c).cast("string") for c in ("replicate", *columns)]))


def share(digits: Column) -> Column:
    """A number in [0, 1) from the first thirteen digits."""
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") * 2.0**-52


def ranked(df: DataFrame, scope: list[str], by: str, name: str, slices: int) -> DataFrame:
    """Places 1, 2, ... within a scope in the order of a column of digits.

    Digits are spread evenly, so a scope is cut in slices of its order and a slice's
    rows are numbered from the count of those before: no scope is one task.  Digits
    travel as bytes, half as long.
    """
    df = df.withColumn("_slice", F.floor(share(F.col(by)) * slices)).withColumn(by, F.unhex(by))
    sizes = df.groupBy(*scope, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*scope).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*scope, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(*scope, "_slice").orderBy(by))
    return df.withColumn("_here", here).join(sizes, [*scope, "_slice"]).withColumns({name: F.col("_here") + F.col("_before"), by: F.lower(F.hex(by))}).drop("_slice", "_here", "_before")


def _slice(digits: str) -> Column:
    """The slice of its scope in which a row lies by its digits, of ``_slices``."""
    return F.when(F.col("_slices") > 1, F.floor(share(F.col(digits)) * F.col("_slices"))).otherwise(0).cast("int")


def _stretches(net: Network) -> DataFrame:
    """``node`` and its stretches in order, ``_there``; those of a vertex are disjoint."""
    return net.presence.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("b")))).alias("_there"))


def _outside(df: DataFrame, net: Network, respect: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """Rows and whether they lie outside the presence of an end or outside watched time."""
    bad = F.lit(False)
    if "observation" in respect and net.observed is not None:
        within = lambda t: F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in net.observed]), lambda w: (w["a"] <= F.col(t)) & (F.col(t) <= w["b"]))
        bad = bad | ~within("start") | ~within("end")
    if "activity" in respect and net.presence is not None:
        there = _stretches(net)
        for end in ("from", "to"):
            df = df.join(there.select(F.col("node").alias(end), F.col("_there").alias(f"_there_{end}")), end, "left")
            covered = F.exists(f"_there_{end}", lambda w: c_leq(w["a"], F.col("start")) & c_leq(F.col("end"), w["b"]))
            bad = bad | ~F.coalesce(covered, F.lit(True))
    return df, bad


def _flagged(df: DataFrame, net: Network, respect: tuple[str, ...], no_loops: bool) -> DataFrame:
    """Adds ``_out`` (outside what is respected) and ``_loop`` (a loop that may not be)."""
    columns = [c for c in df.columns if c not in ("_out", "_loop")]
    df, bad = _outside(df.select(*columns), net, respect)
    return df.select(*columns, bad.alias("_out"), (F.lit(no_loops) & (F.col("from") == F.col("to"))).alias("_loop"))


def _tally(df: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Rows outside, loops, and rows with either, for each replicate."""
    n = lambda c: F.count(F.when(c, 1))
    rows = df.groupBy("replicate").agg(n(F.col("_out")).alias("o"), n(F.col("_loop")).alias("l"), n(F.col("_out") | F.col("_loop")).alias("e")).collect()  # a row for each replicate
    return {r["replicate"]: (r["o"], r["l"], r["e"]) for r in rows}


class _Draw:
    """What all models need: the kept spells, their number, and the parameters.

    For models that move values between rows, spells have content-made ids and lie in
    slices of their scope by these; small scopes are a slice each and share tasks.
    """

    def __init__(self, net: Network, seed: int, within: str, respect: tuple[str, ...], swaps: float, most: int, n: int, numbered: bool) -> None:
        if net.presence is not None:
            net = net.with_(presence=keep(net.presence, "presence"))
        self.net, self.seed, self.respect, self.swaps, self.most = net, seed, respect, swaps, most
        scope = F.coalesce({"network": F.lit(""), "sender": F.col("from"), "session": F.concat(F.lit("s"), "session")}[within], F.lit(""))
        size = max(LEAST, GROUP // n)
        base = net.spells.withColumn("_scope", scope)
        sizes = base.groupBy("_scope").agg(F.count("*").alias("_n"))
        large = sizes.agg(F.sum("_n").alias("n"), F.collect_list(F.when(F.col("_n") > size, F.struct("_scope", "_n"))).alias("large")).first()  # scopes of more rows than a slice
        self.n = large["n"] or 0
        self.slices = max(1, -(-self.n // SLICE))
        if numbered:
            content = ["from", "to", "start", "end", "weight", "session"]
            copy = F.row_number().over(Window.partitionBy(*content).orderBy("raw_id"))
            ids = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content], copy.cast("string")))
            cut = net.spells.sparkSession.createDataFrame([(r["_scope"], -(-r["_n"] // size)) for r in large["large"]], "_scope string, _slices int")
            base = base.withColumn("_id", ids).join(F.broadcast(cut), "_scope", "left").withColumn("_slices", F.coalesce("_slices", F.lit(1)))
            base = base.withColumns({"_slice": _slice("_id"), "_bundle": F.pmod(F.xxhash64("_scope"), F.lit(max(1, -(-self.n // size)))).cast("int"), "_id": F.unhex("_id")})
        self.base = keep(base, "spells")
        seen = _flagged(self.base.withColumn("replicate", F.lit(0)), net, respect, True).agg(F.count(F.when(F.col("_out"), 1)).alias("out"), F.count(F.when(F.col("_loop"), 1)).alias("loops")).first()
        self.allowed, self.no_loops = seen["out"], not seen["loops"]
        self.watched = net.observed if "observation" in respect else None
        self.present = "activity" in respect and net.presence is not None
        self.there = keep(_stretches(net), "stretches") if self.present and numbered else None
        self.bound = self.watched is not None or self.present
        self.tasks = max(int(net.spells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.n * n // ROWS))

    def carried(self, moved: list[str]) -> list[str]:
        """What goes along with ``moved``: receivers bring their presence."""
        return [*moved, *(["_there_to"] if self.present and "to" in moved else [])]

    def ends(self, df: DataFrame, *ends: str) -> DataFrame:
        """Rows with the stretches in which their ends are there, ``_there_<end>``; null for a vertex that always is."""
        for end in ends if self.present else ():
            df = df.join(self.there.select(F.col("node").alias(end), F.col("_there").alias(f"_there_{end}")), end, "left")
        return df

    def permuted(self, which: list[int], moved: list[str], salt: str) -> DataFrame:
        """What each row takes of another row of its scope, in order of rows: runs of values for a slice.

        Values are put in order of their digits, slice by slice, and go as compressed runs
        to the slices of the rows, which are in order of their ids: no row is moved.
        """
        carried = self.carried(moved)
        s = self.ends(self.base.select("_scope", "_bundle", "_slices", F.lower(F.hex("_id")).alias("_id"), *moved), *(c for c in moved if c == "to"))
        # Replicates are read one beside the other, so that a task deals out the rows of few of them and need not spill.
        s = reduce(DataFrame.unionByName, [_copies(s, which[i::READS]) for i in range(min(READS, len(which)))])
        s = s.withColumn("_d", draw(self.seed, salt, "_id")).withColumn("_cut", _slice("_d"))
        by = Window.partitionBy("replicate", "_scope").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
        before = s.filter("_slices > 1").groupBy("replicate", "_scope", "_cut").agg(F.count("*").alias("_n")).select("replicate", "_scope", "_cut", F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_before"))
        # Eighty bits of digits travel; ``before`` has a row for each replicate and slice of a scope that is larger than one.
        s = s.select("replicate", "_bundle", "_cut", "_scope", F.unhex(F.substring("_d", 1, 20)).alias("_d"), *carried).join(F.broadcast(before), ["replicate", "_scope", "_cut"], "left")
        counts: dict[str, dict[int, int]] = {}
        for r in self.base.filter("_slices > 1").groupBy("_scope", "_slice").count().collect():  # likewise
            counts.setdefault(r["_scope"], {})[r["_slice"]] = r["count"]
        starts = {k: np.cumsum([0, *[c.get(i, 0) for i in range(max(c))]]) for k, c in counts.items()}
        schema = "replicate int, _bundle int, _slice int, _scope string, _first long, _values binary"
        s = s.repartition(self.tasks, "replicate", "_bundle", "_cut")
        return keep(s.groupBy("replicate", "_bundle", "_cut").applyInArrow(lambda t: _runs(t, carried, starts), schema), "draws")

    def _met(self, rows: DataFrame, draws: DataFrame, fn: Callable, schema: StructType | str) -> DataFrame:
        """``fn(rows, draws)`` for each slice."""
        at = ["_bundle", "_slice"]
        return rows.repartition(self.tasks, *at).groupBy(*at).cogroup(draws.repartition(self.tasks, *at).groupBy(*at)).applyInArrow(fn, schema)

    def dealt(self, draws: DataFrame, moved: list[str], *columns: str) -> DataFrame:
        """Rows of all replicates with what they take."""
        kinds = self.base.schema
        rows = self.base.select("_bundle", "_slice", "_scope", "_id", *(c for c in columns if c not in moved and not c.startswith("_")))
        own = [StructField(c, kinds[c].dataType) for c in columns if not c.startswith("_")]
        more = [StructField(c, t) for c, t in (("_scope", StringType()), ("_bundle", IntegerType()), ("_slice", IntegerType()), ("_row", LongType())) if c in columns]
        schema = StructType([StructField("replicate", IntegerType()), *own, *more])
        names = schema.names
        carried = self.carried(moved)
        return self._met(rows, draws.select("replicate", "_bundle", "_slice", "_scope", "_first", "_values"), lambda own, values: _dealt(own, values, carried, names), schema)

    def repaired(self, draws: DataFrame, which: list[int], moved: list[str]) -> tuple[DataFrame, dict[int, int]]:
        """Rows that may not stay change ``moved`` with rows of their scope until enough may.

        Changes are tried within slices, in the task that has one; what a slice cannot mend
        is dealt to other slices at random and tried again.  A change is a swap after which
        no more of its two rows offend, so what a scope holds stays as it is; the draw is a
        valid one, not uniform among them.
        """
        carried, rejected = self.carried(moved), dict.fromkeys(which, 0)
        rules = Rules(tuple(moved), self.no_loops, self.watched, self.present, self.most, self.seed & (1 << 62) - 1)
        rows = self.ends(self.base.select("_bundle", "_slice", "_scope", "_id", "from", "to", "start", "end"), "from", "to")
        schema = StructType([*draws.schema.fields, *(StructField(c, LongType()) for c in TALLY)])
        now = keep(self._met(rows, draws, lambda own, values: _mended(own, values, rules, carried), schema), "draws")
        for turn in range(1, self.most + 1):
            tally = {r["replicate"]: r for r in now.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in TALLY)).collect()}  # a row for each replicate
            for r, t in tally.items():
                rejected[r] += t["_met"]
            open_ = [r for r, t in tally.items() if t["_out"] > self.allowed or t["_loops"]]
            if not open_:
                return now, rejected
            if turn == self.most:
                break
            here = self.dealt(now.filter(F.col("replicate").isin(open_)), moved, "from", "to", "start", "end", "_scope", "_bundle", "_slice", "_row")
            slices = F.broadcast(self.base.filter("_slices > 1").select("_scope", "_slices").distinct())
            here = self.ends(here, "from", "to").join(slices, "_scope", "left")
            here = here.withColumn("_mix", F.pmod(F.xxhash64("_slice", "_row", F.lit(turn)), F.coalesce("_slices", F.lit(1))).cast("int")).drop("_slices")
            keys = ["replicate", "_bundle", "_mix"]
            kept = StructType([here.schema[c] for c in ("replicate", "_bundle", "_slice", "_row", *carried)] + [StructField(c, LongType()) for c in TALLY])
            mixed = here.repartition(self.tasks, *keys).groupBy(*keys).applyInArrow(lambda t: _mixed(t, rules, carried, turn), kept)
            keys = ["replicate", "_bundle", "_slice"]
            again = mixed.repartition(self.tasks, *keys).groupBy(*keys).applyInArrow(lambda t: _packed(t, carried), schema)
            done = now.filter(~F.col("replicate").isin(open_)).withColumn("_met", F.lit(0).cast("long"))
            now = keep(again.unionByName(done), "draws")
        raise NoValidDraw(f"surrogates {open_} still have ties that may not stay after {self.most} tries")

    def timelines(self, which: list[int], salt: str) -> DataFrame:
        """Each pair's spells go, as they are, to another pair of the scope."""
        pairs = _copies(self.base.select("_scope", "from", "to").distinct().withColumn("_p", F.md5(F.concat_ws("|", "_scope", "from", "to"))), which)
        scope = ["replicate", "_scope"]
        a = ranked(pairs, scope, "_p", "_k", self.slices).drop("_p")
        b = ranked(pairs.select(*scope, F.col("from").alias("_f"), F.col("to").alias("_t"), draw(self.seed, salt, "_p").alias("_d")), scope, "_d", "_k", self.slices).drop("_d")
        return self._renamed(a.join(b, [*scope, "_k"]).drop("_k"), ["_scope", "from", "to"], which)

    def _renamed(self, names: DataFrame, on: list[str], which: list[int]) -> DataFrame:
        """Spells whose ends become ``_f, _t``; a pair's spells are few beside all, else the join splits them."""
        s = _copies(self.base, which).join(names, ["replicate", *on])
        return s.select(*[F.col(f"_{c[0]}").alias(c) if c in ("from", "to") else F.col(c) for c in s.columns if c not in ("_f", "_t")])

    def swapped(self, which: list[int], salt: str) -> tuple[DataFrame, dict[int, float]]:
        """Double swaps of distinct pairs, half as many side by side in a round as there are pairs.

        A round couples pairs at random, slice by slice, and proposes a swap for each couple,
        on undirected networks in either orientation.  A proposal stands if neither new pair
        is a loop, is there already, or is proposed by a couple that comes before: so degrees
        stay, pairs stay distinct, and a round can be undone by a round as likely.  Vertices
        are numbers meanwhile, and a pair is known by those it began with.
        """
        directed = self.net.directed
        plain = keep(self.base.select("from", "to").distinct(), "distinct")
        m = plain.count()
        vertex = plain.select(F.explode(F.array("from", "to")).alias("name")).distinct().withColumn("_id", F.md5("name"))
        vertex = keep(ranked(vertex.withColumn("_one", F.lit(1)), ["_one"], "_id", "_v", max(1, -(-2 * m // SLICE))).select("name", "_v"), "numbers")
        number = lambda c, v: vertex.select(F.col("name").alias(c), F.col("_v").alias(v))
        pairs = keep(plain.join(number("from", "_f"), "from").join(number("to", "_t"), "to").select((F.col("_f") * (2 * m + 1) + F.col("_t")).alias("_p"), "_f", "_t", "from", "to"), "pairs")
        lo_hi = (lambda a, b: (a, b)) if directed else (lambda a, b: (F.least(a, b), F.greatest(a, b)))
        f, t = lo_hi(F.col("_f"), F.col("_t"))
        now = _copies(pairs.select("_p", f.alias("_f"), t.alias("_t")), which).select("replicate", "_p", "_f", "_t", F.lit(0).alias("_made"))
        asked = max(1, round(self.swaps * m)) if m > 1 else 0
        rounds = -(-asked // max(1, m // 2))
        tasks = max(int(self.base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-m * len(which) // ROWS))
        slices = max(1, -(-m // SLICE))
        for turn in range(rounds):
            drawn = lambda what: F.xxhash64(F.lit(self.seed), F.lit(f"{salt} {what} {turn}"), "replicate", "_p")  # noqa: B023, E731
            order = now.withColumns({"_h": drawn("order"), "_cut": F.pmod(drawn("slice"), F.lit(slices)).cast("int")}).repartition(tasks, "replicate", "_cut")
            w = Window.partitionBy("replicate", "_cut").orderBy("_h", "_p")
            order = order.withColumns({"_k": F.row_number().over(w), "_next": F.lead(F.struct("_p", "_f", "_t", "_made")).over(w)})
            own = F.struct("_p", "_f", "_t", "_made")
            couple = order.filter("_k % 2 = 1").select("replicate", F.struct("_h", F.col("_p").alias("_by")).alias("_h"), own.alias("x"), F.col("_next").alias("y"))
            turned = F.lit(not directed) & (F.pmod(F.xxhash64("_h", F.lit(turn)), F.lit(2)) == 0)
            c, d = F.when(turned, F.col("y._t")).otherwise(F.col("y._f")), F.when(turned, F.col("y._f")).otherwise(F.col("y._t"))
            p, q = lo_hi(F.col("x._f"), d), lo_hi(c, F.col("x._t"))
            # A pair left over proposes nothing; one that may not stand keeps its place with ends that are not asked for.
            fair = F.col("y").isNotNull() & (p[0] != p[1]) & (q[0] != q[1]) & ~((p[0] == q[0]) & (p[1] == q[1]))
            side = lambda of, ends: F.struct(F.when(F.col("_fair"), ends[0]).alias("f"), F.when(F.col("_fair"), ends[1]).alias("t"), F.col(of).alias("was"))
            both = couple.withColumn("_fair", F.coalesce(fair, F.lit(False))).select("replicate", "_h", F.explode(F.array(side("x", p), side("y", q))).alias("_s")).select("replicate", "_h", "_s.*").filter("was IS NOT NULL")
            none = both.schema["was"].dataType
            there = now.select("replicate", F.lit(None).cast(both.schema["_h"].dataType).alias("_h"), F.col("_f").alias("f"), F.col("_t").alias("t"), F.lit(None).cast(none).alias("was"))
            # Nulls come first: pairs that are there.
            asked_for = Window.partitionBy("replicate", "f", "t").orderBy(F.asc_nulls_first("_h"))
            every = both.filter("f IS NOT NULL").unionByName(there).repartition(tasks, "replicate", "f", "t").withColumn("_first", F.row_number().over(asked_for) == 1).filter("was IS NOT NULL")
            sides = every.select("replicate", "_h", "f", "t", "was", "_first").unionByName(both.filter("f IS NULL").withColumn("_first", F.lit(False)))
            couples = sides.repartition(tasks, "replicate", "_h").groupBy("replicate", "_h").agg(F.collect_list(F.struct("f", "t", "was", "_first")).alias("_s"))  # two each
            stands = F.forall("_s", lambda e: e["_first"])
            now = couples.select("replicate", stands.alias("_ok"), F.explode("_s").alias("_s")).select("replicate", "_ok", "_s.*")
            now = now.select("replicate", F.col("was._p").alias("_p"), F.when(F.col("_ok"), F.col("f")).otherwise(F.col("was._f")).alias("_f"), F.when(F.col("_ok"), F.col("t")).otherwise(F.col("was._t")).alias("_t"), (F.col("was._made") + F.col("_ok").cast("int")).alias("_made"))
            now = keep(now, "swaps")
        made = {r["replicate"]: r["n"] for r in now.groupBy("replicate").agg((F.sum("_made") / 2).alias("n")).collect()}
        accepted = {r: made[r] / (rounds * (m // 2)) if rounds else 0.0 for r in made}
        end = lambda v, c: vertex.select(F.col("_v").alias(v), F.col("name").alias(c))
        named = now.drop("_made").join(end("_f", "_nf"), "_f").join(end("_t", "_nt"), "_t").groupBy("_p").agg(F.collect_list(F.struct("replicate", F.col("_nf").alias("_f"), F.col("_nt").alias("_t"))).alias("_g"))  # one for each replicate
        names = pairs.select("_p", "from", "to").join(named, "_p").drop("_p")
        s = self.base.join(names, ["from", "to"]).select(*self.base.columns, F.explode("_g").alias("_one"))
        return s.select("_one.replicate", *[F.col(f"_one._{c[0]}").alias(c) if c in ("from", "to") else F.col(c) for c in self.base.columns]), accepted


def surrogates(net: Network, model: str = "times", n: int = 1, seed: int = 1, within: str = "network", respect: tuple[str, ...] = RESPECT, swaps: float = 10, max_tries: int = 100, transpose: bool = False) -> Surrogates:
    """``n`` surrogates of a network.

    times: starts and ends change places together between ties of a scope.  timeline:
    each pair's spells go, as they are, to another pair of the scope.  targets: receivers
    change places within a scope, without new loops.  edges: ``swaps`` double swaps for
    each distinct pair; degrees stay.  labels: vertices change names, and presence goes
    with them.  reversal: time runs backwards, also for presence and censoring;
    ``transpose`` turns ties round as well.

    ``within`` is network, sender or session (ties without one are a scope).  Where
    presence or watched time is declared, a surrogate has no more ties outside them than
    the network has, for those named in ``respect``: times and targets repair their draws,
    timeline and edges draw anew whole, at most ``max_tries`` times, else ``NoValidDraw``.
    """
    if model not in MODELS:
        raise BadInput(f"unknown null model {model!r}")
    if within not in ("network", "sender", "session") or (within != "network" and model not in SCOPED):
        raise BadScope(f"{model} is not defined within {within}")
    if within == "session":
        net.sessions("separate")
    if set(respect) - set(RESPECT) or n < 1 or swaps <= 0 or max_tries < 1:
        raise BadInput("respect names activity or observation; n, swaps and max_tries are positive")
    if transpose and model != "reversal":
        raise BadInput("only reversal turns ties round")
    every = list(range(1, n + 1))
    rejected, accepted = dict.fromkeys(every, 0), dict.fromkeys(every)
    presence = None if net.presence is None else _copies(net.presence, every)
    columns = net.spells.columns
    if model == "labels":
        spells, presence = _relabelled(net, every, seed, presence)
    elif model == "reversal":
        spells, presence = _reversed(net, every, transpose, presence)
        if "observation" in respect and net.observed is not None:
            here = net.with_(presence=None)
            count = lambda s: _flagged(s, here, ("observation",), False).filter("_out").count()
            if count(spells) > n * count(net.spells.withColumn("replicate", F.lit(0))):
                raise NoValidDraw("reversal puts more ties outside watched time, and has no other draw")
    else:
        numbered = model in ("times", "targets")
        d = _Draw(net, seed, within, tuple(respect), swaps, max_tries, n, numbered)
        if numbered:
            moved = ["start", "end"] if model == "times" else ["to"]
            draws = d.permuted(every, moved, model)
            if d.bound or (model == "targets" and d.no_loops):
                draws, rejected = d.repaired(draws, every, moved)
            spells = d.dealt(draws, moved, *columns)
        else:
            spells = None
            left = every
            for turn in range(max_tries + 1):
                salt = model if not turn else f"{model} again {turn}"
                one, share_made = (d.timelines(left, salt), {}) if model == "timeline" else d.swapped(left, salt)
                accepted |= share_made
                if not d.bound:
                    spells = one
                    break
                one = keep(_flagged(one, net, d.respect, False), "draws")
                tally = _tally(one)
                fine = [r for r in left if tally[r][0] <= d.allowed]
                if fine:
                    good = one.filter(F.col("replicate").isin(fine))
                    spells = good if spells is None else spells.unionByName(good)
                left = [r for r in left if r not in fine]
                if not left:
                    break
                if turn == max_tries:
                    raise NoValidDraw(f"surrogates {left} lie outside presence or watched time after {max_tries} tries")
                for r in left:
                    rejected[r] += tally[r][0]
    report = net.spells.sparkSession.createDataFrame([(r, rejected[r], accepted[r]) for r in every], "replicate int, rejected long, acceptance double")
    spells = spells.select("replicate", *columns)
    if not net.directed:
        spells = spells.withColumns({"from": F.least("from", "to"), "to": F.greatest("from", "to")})
    return Surrogates(net, spells, presence, report)


def _relabelled(net: Network, every: list[int], seed: int, presence: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    v = keep(_copies(net.nodes.select("name").withColumn("_id", F.md5("name")), every), "names")
    slices = max(1, -(-v.count() // (SLICE * len(every))))
    a = ranked(v, ["replicate"], "_id", "_k", slices).drop("_id")
    b = ranked(v.select("replicate", F.col("name").alias("_name"), draw(seed, "labels", "name").alias("_d")), ["replicate"], "_d", "_k", slices).drop("_d")
    names = keep(a.join(b, ["replicate", "_k"]).drop("_k"), "names")
    turn = lambda df, end: df.join(names.withColumnRenamed("name", end), ["replicate", end]).drop(end).withColumnRenamed("_name", end)
    spells = turn(turn(_copies(net.spells, every), "from"), "to")
    return spells, None if presence is None else turn(presence, "node")


def _reversed(net: Network, every: list[int], transpose: bool, presence: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    lo, hi = net.span()
    back = {"start": F.lit(lo + hi) - F.col("end"), "end": F.lit(lo + hi) - F.col("start")}
    s = _copies(net.spells, every).withColumns({**back, "onset_censored": F.col("terminus_censored"), "terminus_censored": F.col("onset_censored")})
    if transpose and net.directed:
        s = s.withColumns({"from": F.col("to"), "to": F.col("from")})
    return s, None if presence is None else presence.withColumns(back)
