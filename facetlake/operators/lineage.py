"""Chains of records that name the record they were made from: decisions over reviews over labels.

Records: id, parent_id (null for a first one), digest, parent_digest (what the record saw of its
parent), actor. ``chains`` follows all records to their first ones at once by pointer doubling:
each round a record's pointer jumps as far again as it has come, so the rounds grow with the
logarithm of the longest chain; a record that has arrived takes no further part. What has not
arrived after as many rounds as the number of records allows runs in a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.plans.experiment_gate import heads, marked, repeated
from facetlake.storage import written


def chains(records: DataFrame) -> DataFrame:
    """(id, root, depth) of each distinct id; root and depth are null where the chain is a circle or leads into one.

    A parent that is missing ends the chain: the record that names it is a root.
    """
    links = records.filter("id is not null").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    known = links.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    first = links.join(known, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("to"))
    now = written(first.select("id", F.coalesce("to", "id").alias("to"), F.col("to").isNotNull().cast("long").alias("depth"), F.col("to").isNull().alias("arrived")), "chains")
    done, left = now.filter("arrived"), now.filter("not arrived")
    for _ in range(max(1, now.count()).bit_length() + 1):
        if left.isEmpty():
            break
        #: A pointer to a record that has arrived has arrived too; others jump by their target's pointer.
        ends = done.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.lit(True).alias("ended"))
        steps = left.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.lit(False).alias("ended"))
        moved = written(left.join(ends.unionByName(steps), "to").select("id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ended").alias("arrived")), "chains")
        done, left = done.unionByName(moved.filter("arrived")), moved.filter("not arrived")
    circles = left.select("id", F.lit(None).cast(dict(now.dtypes)["to"]).alias("root"), F.lit(None).cast("long").alias("depth"))
    return done.select("id", F.col("to").alias("root"), "depth").unionByName(circles)


def lineage_violations(records: DataFrame) -> DataFrame:
    """(name, rule, key): ids repeated, parents missing or changed since, actors who review their own work, circles."""
    parents = heads(records, "id", ["digest", "actor"], "p")
    own = records.join(parents, F.col("parent_id") == F.col("p_key"), "left")
    first, found = F.col("parent_id").isNull(), F.col("p_key").isNotNull()
    rules = {
        "missing_parent": first | found,
        "changed_parent": first | ~found | F.col("parent_digest").eqNullSafe(F.col("p_digest")),
        "own_review": first | ~found | ~F.col("actor").eqNullSafe(F.col("p_actor")),
    }
    circles = chains(records).filter("root is null").select(F.lit("lineage").alias("name"), F.lit("circle").alias("rule"), F.col("id").cast("string").alias("key"))
    return repeated(parents, "lineage", "p").unionByName(marked(own, "lineage", F.col("id"), rules)).unionByName(circles)
