"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.runtime import drop, join_heavy, save, ship


#: Links that a task joins up, and nodes that it holds at once.
LINKS = 1_000_000
HELD = 500_000


class UnionFind:
    """Local grouping inside one task; the root of a group is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(links: DataFrame, tasks: int) -> DataFrame:
    """The links of each task joined up by union-find: every node with the root that its task knows."""
    ship(links.sparkSession)

    def run(batches):
        import pyarrow as pa

        groups = UnionFind()

        def flush():
            rows = [(x, groups.find(x)) for x in list(groups.up)]
            groups.up.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                groups.union(a, b)
            if len(groups.up) > HELD:
                yield flush()
        yield flush()

    return links.coalesce(tasks).mapInArrow(run, "a long, b long")


def _settled(links: DataFrame) -> bool:
    """Whether every node has one root only, and no root is below another."""
    roles = links.select(F.col("a").alias("x"), "b").unionByName(links.select(F.col("b").alias("x"), F.lit(None).cast("long").alias("b")))
    per = roles.groupBy("x").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.count_if(F.col("b").isNull()).alias("as_root"))
    return per.filter("least <> most or (least is not null and as_root > 0)").isEmpty()


def _stars(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """One star step over at most ``n`` saved links: every node hands its larger (or smaller) neighbours to the least node it knows.

    A step never makes more links than it was given. It is saved, as are its minima: left to one plan, two
    steps read the links 86 times, and the driver holds what it knows of all those scans and tasks.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = save(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
    moved = join_heavy(both.filter("b > a") if large else both, least, "a", "n", 2 * n if large else n)
    moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    moved = save(moved.filter("a <> b").distinct(), "stars")
    drop(least)
    return moved


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(id long, component long)`` for every node with a link.

    Links that one task can hold, ``HELD`` at most, are joined up in one, and that is all. More are dealt to
    several tasks, each of which joins up its own by union-find, in bounded memory. Where the trees of
    several tasks meet, large-star and small-star steps alternate, each round followed by union-find within
    the tasks, until every node points straight at the least node of its component, or one task can hold
    the links that are left. A node's neighbours are aggregated (a minimum, with map-side combine), and the
    links of hubs, which are few, meet that minimum by broadcast, so a hub with a third of all links is no
    hot task. Rounds grow with the logarithm of the longest path. Self-links and nulls are ignored; no links
    give no rows.
    """
    spark = edges.sparkSession
    tasks = lambda n: 1 if n <= HELD else max(spark.sparkContext.defaultParallelism, -(-n // LINKS))
    links = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        n = links.count()
        now = save(_forest(links, tasks(n)), "links")
        drop(links)
        if n <= HELD or _settled(now):
            break
        n = now.count()
        if n <= HELD:
            links = now
            continue
        larger = _stars(now, n, True)
        links = _stars(larger, n, False)
        drop(now, larger)
    return now.distinct().select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
