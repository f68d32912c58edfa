"""Connected components of a graph that no single machine holds: large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import remove, stored

#: At most so many keys are broadcast: those with over 1 / HUBS of all rows, of which there cannot be more.
HUBS = 10_000
LEAST_HUB = 500


def met(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, largest: int | None = None) -> DataFrame:
    """rows joined with table on key. table: key, n (how many of the rows have the key; total in all) and what is to be joined.

    Frequent keys meet their line of the table by a broadcast, whose size their own frequency bounds; the others by a shuffle, in which no
    key has more than max(LEAST_HUB, total / HUBS) rows. So a key that holds a third of all rows is no task of its own. largest: the largest n, if it is known; then
    nothing is broadcast where no key is frequent."""
    most = max(LEAST_HUB, total // HUBS)
    keys = [key] if isinstance(key, str) else key
    made = [c for c in table.columns if c not in (*keys, "n")]
    if largest is not None and largest <= most:
        return rows.join(table.drop("n"), keys).select(*rows.columns, *made)
    hubs = F.broadcast(table.where(F.col("n") > most).select(*keys, F.struct(*made).alias("__hub")))
    marked = rows.join(hubs, keys, "left")
    rest = marked.where("__hub is null").drop("__hub").join(table.where(F.col("n") <= most).drop("n"), keys)
    frequent = marked.where("__hub is not null").select(*rows.columns, *[F.col(f"__hub.{c}").alias(c) for c in made])
    return frequent.unionByName(rest.select(*rows.columns, *made))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: any ordered type): root is the smallest node reachable.

    Each round makes two star steps (Kiveris et al., 2014): every node links its larger neighbours, then its smaller ones, to the
    smallest. The number of edges never grows, rounds are logarithmic in the longest path, and all is min-aggregates and equi-joins.
    It ends when every node with a smaller neighbour has no other: the edges are stars then. Self links are dropped. Both the edges and each node's
    least neighbour are written to the shared folder at every step, so lineage and plans stay short, and old tables go at once.
    """
    spark = edges.sparkSession
    now, path = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large star: u with smallest m of {u} and its neighbours; every neighbour above u goes to m
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, told = stored(_least(both), "least")
        loose, most, ends = least.agg(F.count_if(F.expr("m < u and n > 1")), F.max("n"), F.sum("n")).first()
        if not loose:
            remove(spark, told)
            break
        large = met(both.where("v > u"), least.select("u", F.least("u", "m").alias("m"), "n"), "u", ends, most)
        now, path = _replaced(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), [path, told])
        # small star: u with its smaller neighbours; all of them and u go to the smallest
        least, told = stored(_least(now), "least")
        most, ends = least.agg(F.max("n"), F.sum("n")).first()
        small = met(now, least, "u", ends, most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, path = _replaced(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), [path, told])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _least(edges: DataFrame) -> DataFrame:
    """u, the least v it is linked with, and how many."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _replaced(edges: DataFrame, old: list[str]) -> tuple[DataFrame, str]:
    """edges, stored; the tables they were made of go."""
    made = stored(edges, "edges")
    for path in old:
        remove(edges.sparkSession, path)
    return made
