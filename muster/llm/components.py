"""Connected components of a table of links, by alternating stars.

Each round reads and writes links only (large star, then small star), until no link changes. A node with very many
links does not gather them: its smallest neighbour is a grouped minimum, and the join that hands it back is salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import saved

SALTS = 8


def smallest_neighbours(links: DataFrame) -> DataFrame:
    """`u`, `v` and `m`, the smallest of u and its neighbours in `links`."""
    smallest = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = smallest.withColumnRenamed("u", "_u").withColumn("_salt", salts)
    salted = links.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    same = (salted["u"] == spread["_u"]) & (salted["_salt"] == spread["_salt"])
    return salted.join(spread, same).select("u", "v", "m")


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its smallest neighbour."""
    around = smallest_neighbours(both_ways(links).select("col.u", "col.v"))
    return around.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Links lead from larger to smaller."""
    around = smallest_neighbours(links)
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return around.select(F.explode(pairs)).select("col.u", "col.v").filter("u > v").distinct()


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """`node`, `root`: every node of `links` (`u`, `v`, numbers) and the smallest node of its component.

    Repeated links, links in both directions and links of a node to itself are allowed; a node linked only to itself is
    its own root, and links with NULL are left out. No links give no rows.
    """
    given = links.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    pairs = given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    alone = given.filter("u = v").select("u").distinct()
    now = saved(pairs.filter("u > v").distinct(), "links")
    before = None
    after = state(now)
    while after != before and after[0]:
        now = saved(small_star(large_star(now)), "links")
        before, after = after, state(now)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = now.select("v").distinct().unionByName(alone.select(F.col("u").alias("v")))
    lone = own.select(F.col("v").alias("node"), F.col("v").alias("root")).join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(lone.distinct())
