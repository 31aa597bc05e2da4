"""Connected components of a link table, by large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.session import cut


def components(links: DataFrame) -> DataFrame:
    """links: a, b long, without null. Gives node, label: label is the component's smallest node.

    Each step is two aggregations and two joins over the links, and is written to the shared folder. Links of a hot node are combined on the
    map side; nothing is gathered on the driver but a count and a checksum. Links of a node to itself give the node a label.
    """
    links = cut(links, "pairs")  # read for nodes and for links
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        edges = cut(joined.select("a", F.col("m").alias("b")).union(joined.filter("b <> m").select("b", "m")).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    return nodes.join(edges, nodes.node == edges.a, "left").select("node", F.coalesce("b", "node").alias("label"))
