"""Relational shapes that several operators share: latest per key, as-of join, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.storage import PLACE_BITS, in_order, materialize, release


def latest_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order columns. One aggregation with map-side combine, no sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")


#: Rows of a key beyond which its stream is cut into slices.
HOT_ROWS = 2_000_000


def left_join_known(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The left join on one column that may be null. Rows without a key match nothing, and a plain join's shuffle would send
    them all to one task; here they are spread by a hash of the row."""
    salt = F.when(F.col(on).isNull(), F.xxhash64(*[F.col(c) for c in left.columns]))
    keyed = left.withColumn("__key", F.struct(F.col(on).alias("key"), salt.alias("salt")))
    other = right.filter(F.col(on).isNotNull()).withColumn("__key", F.struct(F.col(on).alias("key"), F.lit(None).cast("long").alias("salt")))
    return keyed.join(other.drop(on), "__key", "left").drop("__key")


def in_slices(stream: DataFrame, on: list[str], *order: str) -> tuple[DataFrame, bool]:
    """stream with __slice, and whether there is more than one. A running value of a key is that of its slice on top of what the key's slices before, by number, add up to.

    If some key has more than HOT_ROWS rows, all rows are sorted by ranges of (key, order) and a slice is a key's share of a
    range: each hot key is cut where its own rows are dense, however many there are of them, and no task has more than a range.
    """
    most = stream.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    if most <= HOT_ROWS:
        return stream.withColumn("__slice", F.lit(0).cast("long")), False
    placed = in_order(stream, *[F.col(c).asc_nulls_first() for c in (*on, *order)])
    return placed.withColumn("__slice", F.shiftright("__at", PLACE_BITS)).drop("__at"), True


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, right_order: list[str],
        prefix: str = "r_") -> DataFrame:
    """Each left row with the last right row of its key at or before its time (null columns where there is none).

    Both sides are merged into one sorted stream for each key, in which a running last() carries the right row, so the
    cost is that of a sort and a key with many rows on both sides doesn't multiply them. Hot keys are cut into slices, and a
    row that finds nothing in its slice takes the last right row of the slices before, of which there is one each.
    """
    carried = [c for c in right.columns if c not in on]
    packed = F.struct(*carried)
    rows = right.select(*on, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), packed.alias("__right"),
        F.struct(*right_order).alias("__order"))
    own = left.select(*on, F.col(left_time).alias("__t"), F.lit(1).alias("__side"),
        F.struct(*[c for c in left.columns if c not in on]).alias("__left"))
    stream, cut = in_slices(own.unionByName(rows, allowMissingColumns=True), on, "__t", "__side", "__order")
    running = Window.partitionBy(*on, "__slice").orderBy("__t", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    ends = stream.groupBy(*on, "__slice").agg(F.max_by("__right", F.when(F.col("__side") == 0, F.struct("__t", "__order"))).alias("__end"))
    earlier = Window.partitionBy(*on).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*on, "__slice", F.last("__end", ignorenulls=True).over(earlier).alias("__before")).filter("__before IS NOT NULL")
    found = stream.withColumn("__here", F.last("__right", ignorenulls=True).over(running)).filter("__side = 1")
    if cut:
        found = found.join(before, [*on, "__slice"], "left").withColumn("__hit", F.coalesce("__here", "__before"))
    else:
        found = found.withColumnRenamed("__here", "__hit")
    return found.select(*on, "__left.*", *[F.col(f"__hit.{c}").alias(f"{prefix}{c}") for c in carried])


def counts_before(rows: DataFrame, events: DataFrame, on: list[str], time: str) -> DataFrame:
    """rows with n, how many events of their key have an earlier time: a running count in one sort, with hot keys cut into slices.

    A row without a key has none. At one time rows stand before events, so what happens then isn't counted.
    """
    own = rows.select(*on, F.col(time).alias("__t"), F.lit(0).alias("__is"), F.struct(*[c for c in rows.columns if c not in on]).alias("__row"))
    theirs = events.select(*on, F.col(time).alias("__t"), F.lit(1).alias("__is"))
    keyed = F.lit(True)
    for c in on:
        keyed = keyed & F.col(c).isNotNull()
    stream, cut = in_slices(own.filter(keyed).unionByName(theirs.filter(keyed), allowMissingColumns=True), on, "__t", "__is")
    running = Window.partitionBy(*on, "__slice").orderBy("__t", "__is").rowsBetween(Window.unboundedPreceding, 0)
    found = stream.withColumn("__n", F.sum("__is").over(running)).filter("__is = 0")
    if cut:
        sums = stream.groupBy(*on, "__slice").agg(F.sum("__is").alias("__sum"))  # one row for each slice of a key
        upto = F.sum("__sum").over(Window.partitionBy(*on).orderBy("__slice")) - F.col("__sum")
        found = found.join(sums.select(*on, "__slice", upto.alias("__before")), [*on, "__slice"]).withColumn("__n",
            F.col("__n") + F.col("__before"))
    out = found.select(*on, "__row", F.col("__n").alias("n")).unionByName(own.filter(~keyed).select(*on, "__row",
        F.lit(0).cast("long").alias("n")))
    return out.select(*on, "__row.*", "n")


def components_of(edges: DataFrame) -> DataFrame:
    """edges (a, b) of ids to (node, component), materialized: the least id of each node's component. Nodes without edges have no row.

    Alternates large-star and small-star steps, which converge in a logarithmic number of rounds. An edge is kept once,
    with its greater end as a, so a hub stands in b only: its rows are joined with at most one row that has something to
    say about it, a join that AQE can split, and no aggregate is keyed by it without map-side combine.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        # Large star: greater neighbours go to the least neighbour of their smaller end, if that has one below itself.
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        large = e.join(low.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # Small star: smaller neighbours, and the node itself, go to the least of them.
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        new = materialize(small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select("b", "m")).distinct())
        release(e)
        e = new
    out = materialize(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct()))
    release(e)
    return out


def connected_components(nodes: DataFrame, node: str, pairs: DataFrame) -> DataFrame:
    """(node, component) for every node: the least one that pairs (a, b) connect it with; lone nodes are their own component."""
    stars = components_of(pairs).select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    return nodes.select(node).distinct().join(stars, F.col(node) == F.col("__n"), "left").select(node,
        F.coalesce("__c", node).alias("component"))


def link_by_keys(keys: DataFrame, node: str) -> DataFrame:
    """Pairs (a, b) that connect all nodes sharing a key (columns other than node): each node with its key's least one, not all pairs."""
    by = [c for c in keys.columns if c != node]
    hub = keys.groupBy(*by).agg(F.min(node).alias("b"))
    return keys.join(hub, by).select(F.col(node).alias("a"), "b").filter("a <> b")


def greedy_distinct(rows: DataFrame, order: list[str], keys: list[str], limit: int) -> DataFrame:
    """The first limit rows that a scan in order takes, which takes a row if none that it took before has one of its keys; with position.

    A row that is the first of those left at each of its keys is taken by the scan as well, whatever it does before. So
    each round takes all these, and drops the rows that share a key with them; what comes after the limit-th row taken so
    far can't matter and goes, too. The first row left is always taken, so there are at most limit rounds, and few if keys
    are spread. order must be unique; null keys are no one's.
    """
    at, some = F.struct(*order), " OR ".join(f"{k} IS NOT NULL" for k in keys)
    # Of rows with the same keys only the first can be taken; rows without any block no others.
    left = rows.filter(some).groupBy(*keys).agg(F.min(at).alias("__at")).select("__at", *keys)
    left = materialize(left.unionByName(rows.filter(f"NOT ({some})").select(at.alias("__at"), *keys).orderBy("__at").limit(limit)))
    taken = materialize(left.limit(0))
    while limit > 0 and left.limit(1).count():
        first = left
        for i, k in enumerate(keys):
            least = left.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("__at").alias(f"__first{i}"))
            first = first.join(least, k, "left").filter(F.col(k).isNull() | (F.col("__at") == F.col(f"__first{i}")))
        new = materialize(first.select("__at", *keys))
        taken = materialize(taken.unionByName(new).orderBy("__at").limit(limit))
        left = left.join(new.select("__at"), "__at", "left_anti")
        for k in keys:
            left = left.join(new.select(k).filter(F.col(k).isNotNull()), k, "left_anti")
        n, last = taken.agg(F.count("*"), F.max("__at")).first()
        if n == limit:
            left = left.filter(F.col("__at") < F.struct(*[F.lit(last[c]).alias(c) for c in order]))
        left = materialize(left.select("__at", *keys))
    chosen = taken.select("__at", F.row_number().over(Window.orderBy("__at")).alias("position"))  # at most limit rows
    return rows.withColumn("__at", at).join(F.broadcast(chosen), "__at").drop("__at")
