"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partial-aggregated minimum per node and a join, in which the edges of a node
with very many of them are dealt over several tasks. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake.llm.heavy import heavy_keys, spread_join
from defectlake.llm.scratch import forget, keep

MAX_ROUNDS = 60
#: Bytes of a node that hold the id of its row.
REP_BYTES = 9


def node_of(rep: str, seal: str) -> Column:
    """A binary node for a class of rows: ordered by the class's smallest id (null last), then by its seal.

    The smallest node of a component so tells the component's smallest id.
    """
    ordered = F.lpad(F.hex(F.col(rep).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.when(F.col(rep).isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), ordered))), F.col(seal))


def rep_of(node: Column) -> Column:
    """The id in a node of ``node_of``."""
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", number.cast("long"))


def _to_smallest(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): each directed edge with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    return spread_join(edges, least.drop("n"), "u", heavy_keys(least.select("u", "n"), "u", total), "v")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_smallest(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _to_smallest(down, total)
    own = near.select("u", F.col("m").alias("v"))
    return near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def _seen(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (u, v) there are, with v < u, and whether they are stars already: each u has one edge, and no v has one to a smaller node."""
    end = lambda node, down, up: F.struct(F.col(node).alias("node"), F.lit(down).alias("down"), F.lit(up).alias("up"))
    ends = edges.select(F.explode(F.array(end("u", 1, 0), end("v", 0, 1))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    total, odd = nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))).first()
    return total, not odd


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for every node of ``edges`` (u, v), the smallest node reachable.

    Nodes may be of any orderable type. Loops and repeated edges do no harm; edges with a
    null end are ignored. A table without edges gives an empty result.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    for _ in range(MAX_ROUNDS):
        total, settled = _seen(now)
        if settled:
            break
        # An edge gives one edge at most in a large star, and two in a small one.
        before, now = now, keep(_small_star(_large_star(now, total).distinct(), total).distinct(), name)
        forget(before)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
