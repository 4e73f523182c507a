"""Basic blocks, control flow, loops and data flow of machine code, over all functions at once.

instructions: func, addr, cls (cbr, jmp, ret or anything else), target (address, null if not known). Functions are the groups of windows;
loops are worked out within a function where few blocks can be on a cycle, else as strong components of one graph, and reaching definitions a fixpoint over rows that are new in a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantalog.operators.checkpoints import removed, shared_path, written
from quantalog.operators.graph import strongly_connected

BRANCHES, ENDS = ("cbr", "jmp"), ("cbr", "jmp", "ret")
#: Blocks that a number has bits for, without its sign.
BITS = 63


def blocks(instructions: DataFrame) -> DataFrame:
    """instructions with their block (from 0 in each function). A block begins at the first instruction, behind a branch or return, and
    where a branch of the function leads to. A branch to itself is an unresolved address and leads nowhere."""
    order = Window.partitionBy("func").orderBy("addr")
    led = instructions.where(F.col("cls").isin(*BRANCHES) & (F.col("target") != F.col("addr"))).select("func", F.col("target").alias("addr"), F.lit(True).alias("led")).distinct()
    before = F.lag("cls").over(order)
    marked = instructions.join(led, ["func", "addr"], "left").withColumn("leads", before.isNull() | before.isin(*ENDS) | F.coalesce("led", F.lit(False)))
    return marked.withColumn("block", F.count_if("leads").over(order) - 1).select(*instructions.columns, "block")


def flow(in_blocks: DataFrame) -> DataFrame:
    """func, a, b: from block a the control may go to block b, by a branch or by falling through."""
    last = in_blocks.groupBy("func", "block").agg(F.max_by(F.struct("cls", "target", "addr"), "addr").alias("l"))
    at = in_blocks.select("func", F.col("addr").alias("target"), F.col("block").alias("b"))
    jumps = last.where(F.col("l.cls").isin(*BRANCHES)).select("func", F.col("block").alias("a"), F.col("l.target").alias("target")).join(at, ["func", "target"]).select("func", "a", "b")
    falls = last.where(~F.col("l.cls").isin("jmp", "ret")).select("func", F.col("block").alias("a"), (F.col("block") + 1).alias("b"))
    return jumps.unionByName(falls.join(last.select("func", F.col("block").alias("b")), ["func", "b"], "left_semi").select("func", "a", "b")).distinct()


def _between(edges: DataFrame) -> DataFrame:
    """edges with low and high, for those that can be on a cycle: its least block is led to, and its greatest left, by an edge that doesn't go up."""
    back = edges.where("b <= a").groupBy("func").agg(F.min("b").alias("low"), F.max("a").alias("high"))
    return edges.join(back, "func").where("a between low and high and b between low and high")


def _masked_loops(edges: DataFrame) -> DataFrame:
    """Loops of functions whose cycles lie within `BITS` blocks: what a block reaches is one number, closed over each block in between (Warshall)."""
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))
    bit = lambda mask, n: F.call_function("shiftright", mask, n.cast("int")).bitwiseAND(F.lit(1)) == 1
    rows = edges.select("func", "low", (F.col("high") - F.col("low")).cast("int").alias("top"), (F.col("a") - F.col("low")).cast("int").alias("x"), (F.col("b") - F.col("low")).alias("y"))
    out = rows.groupBy("func", "low", "top", "x").agg(F.bit_or(one(F.col("y"))).alias("m"))
    of_func = out.groupBy("func", "low", "top").agg(F.map_from_entries(F.collect_list(F.struct("x", "m"))).alias("led"))  # BITS entries at most
    blocks_ = F.sequence(F.lit(0), F.col("top"))
    direct = F.transform(blocks_, lambda x: F.coalesce(F.col("led")[x], F.lit(0).cast("bigint")))
    through = lambda masks, k: F.transform(masks, lambda m: F.when(bit(m, k), m.bitwiseOR(F.get(masks, k))).otherwise(m))
    closed = of_func.select("func", "low", "top", F.aggregate(blocks_, direct, through).alias("reached"))
    each = closed.select("func", "low", "top", "reached", F.posexplode("reached").alias("x", "m")).where(bit(F.col("m"), F.col("x")))
    least = F.get(F.filter(blocks_, lambda y: bit(F.col("m"), y) & bit(F.get("reached", y), F.col("x"))), F.lit(0))
    return each.select("func", (F.col("low") + least).alias("loop"), (F.col("low") + F.col("x")).alias("block"))


def loops(edges: DataFrame, bits: int = BITS) -> DataFrame:
    """func, loop (its least block), block: blocks that control comes back to.

    Functions whose cycles lie within `bits` blocks (`BITS` at most) are settled row by row; those of all others are strong components of one graph.
    """
    near = written(_between(edges), "flow")
    large = near.where(F.col("high") - F.col("low") >= bits)
    found = _masked_loops(near.where(F.col("high") - F.col("low") < bits))
    return found if large.isEmpty() else found.unionByName(_component_loops(large))


def _component_loops(edges: DataFrame) -> DataFrame:
    name = lambda c: F.struct("func", F.col(c).alias("block"))
    graph = written(edges.select(name("a").alias("source"), name("b").alias("target")), "flow")
    found = strongly_connected(graph)
    many = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    own = graph.where("source = target").select(F.col("source").alias("component")).distinct()
    cyclic = many.unionByName(own).distinct()
    return found.join(cyclic, "component", "left_semi").select("node.func", F.col("component.block").alias("loop"), F.col("node.block").alias("block"))


def reaching(in_blocks: DataFrame, edges: DataFrame, registers: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """func, a, b: a register that block a writes may be read in block b before it is written again.

    registers: func, addr, reg, written (boolean; an instruction reads before it writes). Each round carries what is new over one edge, unless
    the block there writes the register itself; it ends when nothing is new.
    """
    spark = in_blocks.sparkSession
    used = registers.join(in_blocks.select("func", "addr", "block"), ["func", "addr"]).groupBy("func", "block", "reg").agg(F.min(F.when(F.col("written"), F.col("addr"))).alias("w"), F.min(F.when(~F.col("written"), F.col("addr"))).alias("r"))
    used = written(used, "registers")
    writes = used.where("w is not null").select("func", F.col("block").alias("b"), "reg")
    reads = used.where("r is not null and (w is null or r <= w)").select("func", F.col("block").alias("b"), "reg")
    edges = written(edges, "flow")
    onward = edges.select("func", F.col("a").alias("b"), F.col("b").alias("to"))
    step = lambda facts: facts.join(onward, ["func", "b"]).select("func", F.col("to").alias("b"), "reg", "d")
    at = shared_path(spark, "reaching")
    fresh = written(step(writes.withColumn("d", F.col("b"))).distinct(), "reaching", f"{at}/0")
    known = fresh
    for n in range(1, max_rounds):
        if fresh.isEmpty():
            break
        passing = fresh.join(writes, ["func", "b", "reg"], "left_anti")
        fresh = written(step(passing).distinct().join(known, ["func", "b", "reg", "d"], "left_anti"), "reaching", f"{at}/{n}")
        known = spark.read.schema(fresh.schema).parquet(*[f"{at}/{k}" for k in range(n + 1)])
    else:
        raise RuntimeError(f"definitions did not settle in {max_rounds} rounds")
    out = written(known.where("d != b").join(reads, ["func", "b", "reg"], "left_semi").select("func", F.col("d").alias("a"), "b").distinct(), "uses")
    removed(spark, at)
    return out
