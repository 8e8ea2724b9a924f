"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import discard, materialize


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1000000007)).first()
    return tuple(r)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (longs), where ``root`` is
    the smallest node that links reach from it.

    Each round turns every node's larger neighbours, then its smaller ones,
    towards the smallest neighbour it knows (large star, small star), which
    needs about log2 of the longest chain in rounds.  Minima are hash
    aggregates (combined before the shuffle) and are written before they are
    joined back, so both join sides are scans and a hub is split by the
    skew-join rule.  No component is ever gathered.  A round's tables are deleted
    once the next round's links are written.

    Null ends and self links are ignored; repeated links count once; an empty
    table gives no rows.  Not converging within ``max_rounds`` raises.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                    .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
                    .distinct(), "cc-links")
    state = _state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "cc-least")
        large = materialize(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .filter("hi != lo").distinct(), "cc-large")
        low = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "cc-low")
        turned = large.join(low, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = materialize(turned.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "cc-links")
        discard(e, least, large, low)
        e, now = new, _state(new)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


__all__ = ["connected_components"]
