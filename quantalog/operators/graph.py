"""Reachability, strong components and migration order of dependency graphs, by joins to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.operators.checkpoints import removed, shared_path, written
from quantalog.operators.components import connected_components
from quantalog.operators.numbering import placed


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(source, target) for every pair with a path, cycles included. Path lengths double each round; each round is written."""
    spark = edges.sparkSession
    at = shared_path(spark, "paths")
    paths = written(edges.select("source", "target").distinct(), "paths", at)
    count = paths.count()
    for _ in range(max_rounds):
        a, b = paths.alias("a"), paths.alias("b")
        longer = a.join(b, F.col("a.target") == F.col("b.source")).select(F.col("a.source"), F.col("b.target"))
        following = shared_path(spark, "paths")
        paths = written(paths.unionByName(longer).distinct(), "paths", following)
        removed(spark, at)
        at, before, count = following, count, paths.count()
        if count == before:
            return paths
    raise RuntimeError("paths did not settle")


def dependents(paths: DataFrame) -> DataFrame:
    """How many other nodes reach each node."""
    return paths.where("source != target").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("dependents"))


def _stored(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """A written table whose folder is noted in `keep`, so that it can be deleted when nothing reads it any more."""
    keep.append(shared_path(df.sparkSession, name))
    return written(df, name, keep[-1])


def _dropped(spark: SparkSession, folders: list[str]) -> None:
    while folders:
        removed(spark, folders.pop())


def _settled(start: DataFrame, step, name: str, keep: list[str], max_rounds: int) -> DataFrame:
    """start (node, label) after as many rounds of `step` (rows with smaller labels for some nodes) as change anything; only changed nodes go on."""
    spark, mine = start.sparkSession, []
    state = _stored(start, name, mine)
    fresh = state
    for _ in range(max_rounds):
        following = []
        better = step(fresh).groupBy("node").agg(F.min("label").alias("new"))
        joined = state.join(better, "node", "left").withColumn("less", F.coalesce(F.col("new") < F.col("label"), F.lit(False)))
        joined = _stored(joined.select("node", F.least("label", F.coalesce("new", "label")).alias("label"), "less"), name, following)
        _dropped(spark, mine)
        mine, state, fresh = following, joined.select("node", "label"), joined.where("less").select("node", "label")
        if fresh.isEmpty():
            keep += mine
            return state
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def strongly_connected(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, component) for every node of edges (source, target): nodes that reach each other share the least of their names.

    No table of reachable pairs is made. Each round (1) sets nodes aside that nothing comes from or goes to, each its own component,
    (2) makes one node of every path whose inner edges have no other way in or out, so a chain of any length takes rounds that
    grow with its logarithm, and (3) colours every node by the least one that it is reached from; what reaches that one within its
    colour is a component. Tables of a round are deleted when it is over; only whether rows are left reaches the driver. Edges
    that are null at an end are ignored.
    """
    spark = edges.sparkSession
    previous: list[str] = []
    plain = _stored(edges.where("source is not null and target is not null").select("source", "target").distinct(), "edges", previous)
    ends = lambda e: e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct()
    # For each node, who stands for it in the graph that is left, and the nodes that it is known to be of one component with (unit).
    stands = _stored(ends(plain).select("node", F.col("node").alias("for"), F.col("node").alias("unit")), "stands", previous)
    now = plain.where("source != target")
    for _ in range(max_rounds):
        folders: list[str] = []
        following: list[str] = []
        both = now.select(F.col("source").alias("node")).intersect(now.select(F.col("target").alias("node")))
        now = _stored(now.join(both.withColumnRenamed("node", "source"), "source", "left_semi").join(both.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target"), "edges", folders)
        if now.isEmpty():
            break
        # Paths: edges whose source has no other way out and whose target no other way in. More ways in lead to the first node of a
        # path only, and out of the last, so an edge from its last to its first makes all of it one component, and so does a ring.
        out, into = now.groupBy("source").agg(F.count("*").alias("o")), now.groupBy("target").agg(F.count("*").alias("i"))
        single = _stored(now.join(out.where("o = 1"), "source", "left_semi").join(into.where("i = 1"), "target", "left_semi").select("source", "target"), "single", folders)
        paths = _stored(connected_components(single, "source", "target").select("node", F.col("component").alias("path")), "paths", folders)
        a, b = paths.select(F.col("node").alias("source"), F.col("path").alias("a")), paths.select(F.col("node").alias("target"), F.col("path").alias("b"))
        named = now.join(a, "source", "left").join(b, "target", "left").join(single.withColumn("single", F.lit(True)), ["source", "target"], "left")
        named = _stored(named.select(F.coalesce("a", "source").alias("source"), F.coalesce("b", "target").alias("target"), F.coalesce("single", F.lit(False)).alias("inside")), "edges", folders)
        rings = named.where("inside").groupBy(F.col("source").alias("path")).agg(F.count("*").alias("e")).join(paths.groupBy("path").agg(F.count("*").alias("n")), "path").where("e = n").select("path")
        loops = named.where("not inside and source = target").select(F.col("source").alias("path")).unionByName(rings).distinct()
        now = _stored(named.where("source != target").select("source", "target").distinct(), "edges", folders)
        colours = _settled(ends(now).select("node", F.col("node").alias("label")), lambda f, e=now: f.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node"), "label"), "colours", folders, max_rounds)
        same = now.join(colours.select(F.col("node").alias("source"), F.col("label").alias("c")), "source").join(colours.select(F.col("node").alias("target"), F.col("label").alias("d")), "target").where("c = d").select("source", "target")
        same = _stored(same, "edges", folders)
        # Backwards from the least node of each colour, within it: label 0 is reached.
        start = colours.select("node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label"))
        back = _settled(start, lambda f, e=same: f.where("label = 0").join(e, F.col("node") == F.col("target")).select(F.col("source").alias("node"), "label"), "reached", folders, max_rounds)
        found = _stored(back.where("label = 0").select("node").join(colours, "node").select(F.col("node").alias("for"), F.col("label").alias("least")), "found", folders)
        many = found.join(found.groupBy("least").agg(F.count("*").alias("n")).where("n > 1"), "least", "left_semi").select("for", "least")
        known = many.unionByName(loops.join(many, F.col("path") == F.col("for"), "left_anti").select(F.col("path").alias("for"), F.col("path").alias("least")))
        moved = stands.join(paths.select(F.col("node").alias("for"), "path"), "for", "left").select("node", F.coalesce("path", "for").alias("for"), "unit")
        stands = _stored(moved.join(known, "for", "left").select("node", "for", F.coalesce("least", "unit").alias("unit")), "stands", following)
        gone = found.select("for")
        now = now.join(gone.withColumnRenamed("for", "source"), "source", "left_anti").join(gone.withColumnRenamed("for", "target"), "target", "left_anti").select("source", "target")
        now = _stored(now, "edges", following)
        _dropped(spark, folders)
        _dropped(spark, previous)
        previous = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = written(stands.join(stands.groupBy("unit").agg(F.min("node").alias("component")), "unit").select("node", "component"), "components")
    _dropped(spark, folders)
    _dropped(spark, previous)
    return out


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes, those without edges too."""
    return nodes.join(strongly_connected(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def depths(components: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(component, size, depth, order): depth 1 depends on nothing; order is by depth, then larger, then name."""
    spark = edges.sparkSession
    a = components.select(F.col("node").alias("source"), F.col("component").alias("above"))
    b = components.select(F.col("node").alias("target"), F.col("component").alias("below"))
    dag = written(edges.join(a, "source").join(b, "target").where("above != below").select("above", "below").distinct(), "dag")
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    at: list[str] = []
    depth = _stored(sizes.select("component", F.lit(1).cast("bigint").alias("depth")), "depth", at)
    for _ in range(max_rounds):
        step = dag.join(depth, F.col("below") == F.col("component")).groupBy("above").agg((F.max("depth") + 1).alias("next"))
        raised = depth.join(step, F.col("component") == F.col("above"), "left").select("component", F.greatest("depth", F.coalesce("next", F.lit(1))).alias("depth"))
        following: list[str] = []
        raised = _stored(raised, "depth", following)
        settled = raised.agg(F.sum("depth")).first() == depth.agg(F.sum("depth")).first()
        _dropped(spark, at)
        at, depth = following, raised
        if settled:
            break
    return placed(depth.join(sizes, "component"), [F.col("depth"), -F.col("size"), F.col("component")], "order")
