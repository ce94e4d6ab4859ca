"""Connected components of a table of links."""

from pyspark.sql import functions as F

from folioscope.llm.shared import stored


def components(links, a="a", b="b"):
    """(node, component): for every node of a link the least node that links reach; ends of a link must not be null.

    Large and small stars by turns: each node hands its larger neighbours to
    its least one, then its smaller ones, until only stars are left.  A step
    moves (node, least) pairs through one aggregate and one join, so a node
    with many links is pre-aggregated and its join can be split; the number of
    steps grows with the logarithm of the longest chain.
    """
    def pairs(df):
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = stored(pairs(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the links of one node can be split where its least one is joined
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = pairs(large)
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(pairs(small.unionByName(least.select("u", F.col("m").alias("v")))), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
