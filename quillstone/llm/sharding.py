"""Sharding by a k-d tree over document metadata.

The dimensions are the language, the source and the size (on a log scale), each mapped to 20-bit numbers by a rule that
needs no dictionary. A node of the tree that is to hold k shards is split along its widest dimension, at the point that
gives floor(k/2) and ceil(k/2) shards their parts of its bytes, until each leaf is one shard of about the target bytes.

Equal texts stay together: their metadata are those of the copy that sorts first, so that they are one point of the
space, and ties on the dimension are ordered by a hash of the text. A group of equal texts at a cut goes to one side as
a whole if that leaves an error of at most GROUP_SLACK of a shard's bytes; a larger one, such as a third of all rows, is
cut between its rows. So at most one group a cut, shards - 1 in all, is ever in two shards.

The weighted medians are distributed: the order key of a row has 20 + 42 bits, and a histogram of bytes over the next
digit narrows each cut down, one pre-aggregated pass over (key, size) rows for a step, for all nodes of a level at once,
until what is left undecided is at most SLACK of a shard's bytes. The driver sees one row for each node and step. Texts
are read once; the passes read a table of ids, keys and sizes.

Law: bytes. Cases: null texts have size 1; a null language or source is a value of its own; null and repeated ids, and
rows that are alike in all columns, are rows like others (their order is that in which they were written); an empty
table gives an empty result; columns asked for by keep are carried, but one with the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import MAX_BROADCAST_IDS, PLACE_BITS, byte_size, in_order, literal_rows, materialize, release

#: Bits of a dimension and of the text's hash in the order key; the widths of its digits and of those of a row's number.
DIM_BITS, TEXT_BITS = 20, 42
DIGITS, ROW_DIGITS = (20, 14, 14, 14), (15, 16, 16, 16)
DIMS = ("dim_language", "dim_source", "dim_size")
#: Errors of a cut, in parts of a shard's bytes: where narrowing down ends, and what keeping equal texts together may cost.
SLACK, GROUP_SLACK = 0.001, 0.01
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def dimensions(docs: DataFrame) -> dict[str, Column]:
    """The metadata dimensions of a row as numbers from 0 to 2**20 - 1."""
    coded = lambda c: F.shiftrightunsigned(F.crc32(F.coalesce(F.col(c), F.lit("\x00"))), 32 - DIM_BITS)
    size = F.least(F.floor(F.log2(byte_size(F.col("text"))) * (2**DIM_BITS / 40)), F.lit(2**DIM_BITS - 1))
    present = {"dim_language": "lang", "dim_source": "source"}
    found = {n: coded(c) if c in docs.columns else F.lit(0) for n, c in present.items()} | {"dim_size": size}
    return {n: found[n].cast("long") for n in DIMS}


def _group_points(meta: DataFrame) -> DataFrame:
    """meta with the language and source of each group of equal texts set to those of its least copy."""
    point = F.struct("dim_language", "dim_source")
    mixed = meta.groupBy("text_hash", "text_crc32", "size").agg(F.min(point).alias("p"),
        F.max(point).alias("q")).filter("p <> q").select("text_hash", "text_crc32", "size", "p")
    mixed = materialize(mixed)  # groups whose copies differ in metadata
    few = mixed.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    out = meta.join(F.broadcast(mixed) if few else mixed, ["text_hash", "text_crc32", "size"], "left")
    return out.withColumns({d: F.coalesce(F.col("p").getField(d), F.col(d)) for d in DIMS[:2]}).drop("p")


def _order_key() -> Column:
    """The order key on the node's widest dimension."""
    return F.shiftleft(F.element_at(F.array(*DIMS), F.coalesce(F.col("dim"), F.lit(0)) + 1), TEXT_BITS) + F.col("text_hash")


_NODE = "node int, dim int, want double, prefix long, cut long, left long"


def _step(rows: DataFrame, nodes: list[dict], number: Column, before: int, shift: int) -> dict[int, dict]:
    """One histogram pass for some nodes: rows whose number has the node's prefix, by their next digit. The digit at which the running bytes reach want."""
    table = literal_rows(rows.sparkSession, [(n["id"], n["dim"], n["want"], n["prefix"], n.get("cut"), n["left"]) for n in nodes], _NODE)
    keyed = rows.join(F.broadcast(table),
        "node").filter(F.col("cut").isNull() | (_order_key() == F.col("cut"))).withColumn("number", number)
    digits = keyed.filter(F.shiftright("number", before) == F.col("prefix")).groupBy("node", "want", "left",
        F.shiftright("number", shift).alias("digit"))
    sums = digits.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    order = Window.partitionBy("node").orderBy("digit")  # at most 2**20 sums a node
    sums = sums.select("*", (F.col("left") + F.sum("bytes").over(order)).alias("upto"), F.lead("digit").over(order).isNull().alias("last"))
    found = sums.filter((F.col("upto") >= F.col("want")) | F.col("last")).groupBy("node").agg(F.min(F.struct("digit", "bytes", "upto",
        "n")).alias("at")).collect()
    return {r["node"]: r["at"].asDict() for r in found}


def _narrow(rows: DataFrame, nodes: list[dict], number: Column, widths: tuple[int, ...], slack: float) -> None:
    """Narrows each node's prefix down, digit by digit, until the bytes of one prefix are at most slack of a shard's, or the number's bits end.

    Sets shift, the bits that are still open, and keep: whether the rows of the prefix go to the left side, which has the smaller error then.
    """
    total = before = sum(widths)
    for n in nodes:
        n |= {"prefix": 0, "shift": total}
    open_nodes, at = nodes, 0
    while open_nodes and at < len(widths):
        shift = before - widths[at]
        found = _step(rows, open_nodes, number, before, shift)
        for n in open_nodes:
            d = found[n["id"]]
            n |= {"prefix": d["digit"], "shift": shift, "left": d["upto"] - d["bytes"], "bytes": d["bytes"], "rows": d["n"]}
            n["keep"] = d["upto"] - n["want"] <= n["want"] - n["left"]
            n["error"] = min(d["upto"] - n["want"], n["want"] - n["left"])
        open_nodes = [n for n in open_nodes if n["bytes"] > slack * n["share"]]
        before, at = shift, at + 1


def _cuts(rows: DataFrame, nodes: list[dict]) -> list[tuple]:
    """(node, dim, cut, row_cut, to): rows whose key is beyond cut, or at it and whose number is at row_cut or beyond, go to the node to."""
    for n in nodes:
        n |= {"left": 0}
    _narrow(rows, nodes, _order_key(), DIGITS, SLACK)
    for n in nodes:
        n["first"] = n["prefix"] << n["shift"]  # the least key of the undecided prefix
        n["next"] = (n["prefix"] + n["keep"]) << n["shift"]
    heavy = [n for n in nodes if n["shift"] == 0 and n["rows"] > 1 and n["error"] > GROUP_SLACK * n["share"]]
    halves = [{**n, "cut": n["prefix"]} for n in heavy]
    if halves:
        _narrow(rows, halves, F.col("row"), ROW_DIGITS, SLACK)
    by_row = {n["id"]: (n["cut"], (n["prefix"] + n["keep"]) << n["shift"]) for n in halves}
    # Without a cut inside a group, every row whose key is at least the cut goes right.
    return [(n["id"], n["dim"], *by_row.get(n["id"], (n["next"], 0)), n["id"] + n["shards"] // 2) for n in nodes]


def kd_tree_shards(meta: DataFrame, shards: int) -> DataFrame:
    """meta: size, text_hash, row and the DIMS, materialized. Adds shard (0..shards-1)."""
    spark = meta.sparkSession
    rows, nodes = meta.withColumn("node", F.lit(0)), [{"id": 0, "shards": shards}]
    share = None
    while nodes := [n for n in nodes if n["shards"] > 1]:
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"),
            *[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).collect()}
        nodes = [n for n in nodes if n["id"] in stats]  # a node without rows has nothing to split
        if not nodes:
            break
        share = share or stats[0]["bytes"] / shards
        for n in nodes:
            s = stats[n["id"]]
            n |= {"dim": max(range(len(DIMS)), key=lambda i: s[DIMS[i]]), "want": s["bytes"] * (n["shards"] // 2) / n["shards"],
                "share": share}
        cuts = literal_rows(spark, _cuts(rows, nodes), "node int, dim int, cut long, row_cut long, to int")
        key = _order_key()
        right = F.col("cut").isNotNull() & ((key > F.col("cut")) | (key == F.col("cut")) & (F.col("row") >= F.col("row_cut")))
        placed = materialize(rows.join(F.broadcast(cuts), "node", "left").withColumn("node",
            F.when(right, F.col("to")).otherwise(F.col("node"))).drop("dim", "cut", "row_cut", "to"))  # each level is written once
        release(rows)
        rows = placed
        nodes = [c for n in nodes for c in ({"id": n["id"], "shards": n["shards"] // 2},
            {"id": n["id"] + n["shards"] // 2, "shards": n["shards"] - n["shards"] // 2})]
    return rows.withColumnRenamed("node", "shard")


#: Rows of a shard that write_shards() puts in one file; (range, shard) pairs that are broadcast, more are joined by shuffle.
ROWS_A_FILE, MAX_BROADCAST_PAIRS = 200_000, 1_000_000


def number_slots(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard. Rows are sorted by ranges of (shard, text_hash, row): a range holds few shards or a
    part of one, so there are at most ranges + shards pairs, and a pair's rows go on from those of its shard in the ranges before."""
    found = in_order(rows, F.col("shard"), F.col("text_hash"), F.col("row"))
    part = F.shiftright("__at", PLACE_BITS)
    pairs = materialize(found.groupBy(part.alias("part"), "shard").agg(F.min("__at").alias("first"), F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    base = pairs.select("part", "shard", (before - F.col("first")).alias("base"))
    few = pairs.count() <= MAX_BROADCAST_PAIRS
    return found.withColumn("part", part).join(F.broadcast(base) if few else base, ["part", "shard"]).withColumn("slot",
        (F.col("__at") + F.col("base")).cast("long")).drop("part", "base", "__at")


def assign_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
        keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, size, text_crc32, law, shard and slot for every row of docs; shards, or as many as target_bytes asks for."""
    text, keep = F.coalesce(F.col("text"), F.lit("")), tuple(c for c in keep if c.lower() not in RESULTS)
    read = materialize(docs.select(
        F.struct(F.lit(0).alias("none"), *keep).alias("kept"), byte_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(2**TEXT_BITS)).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in dimensions(docs).items()]))
    if shards is None:
        total = read.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // max(1, target_bytes or 1)))
    meta = materialize(_group_points(read))
    release(read)
    placed = number_slots(kd_tree_shards(meta, shards))
    return placed.select(*[F.col("kept").getField(c).alias(c) for c in keep], "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Writes whole documents to path, a folder for each shard. The documents' id must be unique."""
    placed = assign_shards(docs, **how).select("doc_id", "shard", "slot")
    out = docs.join(placed, "doc_id")
    out.repartition("shard", F.floor(F.col("slot") / ROWS_A_FILE)).sortWithinPartitions("shard",
        "slot").write.partitionBy("shard").parquet(path)
