"""Connected components of a link table, by stars of least labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import staged


def _are_stars(links: DataFrame) -> bool:
    """Whether each ``a`` has one ``b``, and no ``b`` is an ``a``."""
    ends = F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(c).alias("end")) for c in ("a", "b")]))
    is_a = F.col("end") == "a"
    times = links.select(ends).groupBy("node").agg(F.count_if(is_a).alias("n"), F.bool_or(~is_a).alias("centre"))
    return times.filter("n > 1 OR (n = 1 AND centre)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of every node of ``links`` (``a``, ``b``, longs).

    Alternates large and small stars until the links are stars of least nodes; each
    round is a group and a join on the node, written to the shared folder. NULL ends and
    self-links are ignored; an empty table gives no nodes.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = staged(links.distinct(), "components")
    while not _are_stars(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(pairs.select("a", F.col("m").alias("b")))
        links = staged(small.filter("a <> b").distinct(), "components")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
