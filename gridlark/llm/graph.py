"""Connected components of links, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label), label the smallest node of its component, for links (a, b).

    Labels move along the links and then jump to the label's own label, so a path of n links
    takes about log n rounds. Links, labels and components stay in tables.
    """
    both = stored(links.select("a", "b").filter("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    lab = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(lab.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        new = lab.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        up = lab.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = stored(new.join(up, "label", "left").select("node", "old", F.coalesce(F.least("label", "top"), "label").alias("label")), "labels")
        done = new.filter("old <> label").isEmpty()
        lab = new.select("node", "label")
        if done:
            return lab
