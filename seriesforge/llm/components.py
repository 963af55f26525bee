"""Connected components of a table of links: local forests, leaves set aside, then alternating large and small stars until one task can hold the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop_written, map_batches, written

#: Links that are contracted together: of a partition, or all that are left.
TOGETHER = 100_000
#: Parts that the rows of one key are dealt to in a join with a row a key.
SALTS = 16


def salted_join(left: DataFrame, spread: Column, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A join with a right side of few rows a key; a key with very many rows on the left is dealt on by spread.

    Merged by sorting: the repeated right side is never broadcast, however small it was before.
    """
    dealt = left.withColumn("salt_l", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    each = right.withColumn("salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(each.hint("merge"), on & (F.col("salt_l") == F.col("salt_r")), how).drop("salt_l", "salt_r")


def _contracted(links: DataFrame, whole: bool = False) -> DataFrame:
    """Links of a partition as stars on the smallest node of what they connect: the same components, shorter paths.

    A node's links to smaller ones come together, of which one is left.  whole: links of ``TOGETHER`` rows at most
    in one task, which makes stars of the whole components, each with a row from its smallest node to itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(k):
            while (parent := up.setdefault(k, k)) != k:
                up[k] = k = up[parent]
            return k

        def stars() -> pa.RecordBatch:
            found = [(k, r) for k in up if (r := root(k)) != k or whole]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([s[at] for s in found], kind) for at in (0, 1)], ["a", "b"])

        kind, seen = None, 0
        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen >= TOGETHER and not whole:
                yield stars()
                seen = 0
        if up:
            yield stars()

    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    return map_batches(links.coalesce(1) if whole else links.repartition("a"), run, links.schema)


def components(links: DataFrame, stored: bool = False) -> DataFrame:
    """(node, component) of every node of links (a, b); a component's id is its smallest node.

    Nodes that hang on a single smaller node are set aside and get that node's component at the
    end.  For the others each round hangs a node's larger neighbours, then its smaller ones, on
    its smallest neighbour, until all links are stars.  The rounds grow with the logarithm of the
    longest path; minima are taken before the shuffle, no node's neighbours are gathered, and a
    node with very many of them is dealt to several tasks.  As soon as no more than ``TOGETHER``
    links are left, one task ends it without a further round.  stored: links are a table, whose
    rows can be counted before anything else.
    """
    edges = links if stored and links.count() <= TOGETHER else written(_contracted(links), "links")
    if edges is links or edges.count() <= TOGETHER:
        return written(_contracted(edges, whole=True), "links").toDF("node", "component")
    edges, before = written(edges.distinct(), "links"), edges
    drop_written(before)
    ends = edges.select(F.col("a").alias("of"), F.lit(1).alias("up"), F.lit(0).alias("down"), "b").unionByName(edges.select(F.col("b").alias("of"), F.lit(0).alias("up"), F.lit(1).alias("down"), F.col("b").alias("b")))
    degrees = ends.groupBy("of").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.min("b").alias("b"))
    leaves = written(degrees.where("up = 1 and down = 0").select(F.col("of").alias("a"), "b"), "leaves")
    core = written(edges.join(leaves.select(F.col("a").alias("of")), F.col("a") == F.col("of"), "left_anti"), "links")
    drop_written(edges)
    while core.count() > TOGETHER and (core.groupBy("a").count().where("count > 1").head(1) or core.select(F.col("b").alias("a")).distinct().join(core.select("a"), "a", "left_semi").head(1)):
        both = core.union(core.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("of")).agg(F.least("of", F.min("b")).alias("m"))
        large = salted_join(both.where("b > a"), F.col("b"), least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
        hung = salted_join(large, F.col("b"), lowest, F.col("a") == F.col("of"))
        small = hung.select("a", F.col("m").alias("b")).union(hung.where("b <> m").select("b", "m"))
        core, before = written(_contracted(small).distinct(), "links"), core
        drop_written(before)
    if core.count() <= TOGETHER:
        core, before = written(_contracted(core, whole=True).where("a <> b"), "links"), core
        drop_written(before)
    roots = core.select(F.col("a").alias("of"), F.col("b").alias("m"))
    hanging = salted_join(leaves, F.col("a"), roots, F.col("b") == F.col("of"), "left").select(F.col("a").alias("node"), F.coalesce("m", "b").alias("component"))
    out = hanging.union(core.select("a", "b"))
    return out.union(out.select("component", "component").distinct())
