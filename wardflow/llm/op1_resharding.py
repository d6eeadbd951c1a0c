"""Resharding by minimum-cost flow: new shard sizes at the fewest bytes moved.

The old shards are sources of bytes, the new ones sinks with a capacity, a byte that stays in its
shard costs nothing and one that moves costs one. The flow of least cost says how many bytes go from
which shard to which; this problem has one node per shard, whatever the number of rows, and is
solved on the driver.

A flow is carried out on blocks. The rows of a shard lie in a fixed order, in which running sums of
bytes are worked out block by block (a shard may hold most of the table, a block may not); each
transfer takes the next stretch of that order, and a row goes where its middle byte lies. Shards are
then off by parts of rows. A second flow evens this out with the smallest rows of the shards that
got too much. Every new shard is then written whole, with the rows that stay in it, and read back.

Law: ``bytes`` (sizes near equal). Defined results: NULL text has size 8 and checksum 0; repeated
rows are placed each on their own; NULL doc_id is a value like others; an old shard that is NULL
counts as shard 0, one beyond the new shards is emptied; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.tables import BLOCK_ROWS, block_of, rank_in_blocks
from wardflow.session import materialize, scratch_path

Flow = dict[tuple[int, int], int]


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> Flow:
    """Bytes from each old to each new shard, moving the fewest; capacities must suffice for the supply.

    Successive shortest paths: every round finds the cheapest way from a shard with bytes left to one
    with room left, which may send back what an earlier round sent, and uses it as far as it goes.
    """
    old, new = sorted(supply), sorted(capacity)
    left, room = dict(supply), dict(capacity)
    flow: Flow = defaultdict(int)
    height = {("old", s): 0 for s in old} | {("new", s): 0 for s in new}
    cost = lambda s, t: 0 if s == t else 1

    while any(left.values()):
        far = {("old", s): 0 for s in old if left[s]}
        via: dict = {}
        heap = [(0, node) for node in far]
        done = set()
        while heap:
            d, node = heappop(heap)
            if node in done:
                continue
            done.add(node)
            side, s = node
            if side == "old":
                steps = ((("new", t), cost(s, t)) for t in new)
            else:
                steps = ((("old", t), -cost(t, s)) for t in old if flow[t, s])
            for other, price in steps:
                reduced = d + price + height[node] - height[other]
                if reduced < far.get(other, 1 << 60):
                    far[other], via[other] = reduced, node
                    heappush(heap, (reduced, other))
        ends = [("new", t) for t in new if room[t] and ("new", t) in far]
        if not ends:
            raise ValueError("the new shards have not enough room")
        end = min(ends, key=lambda node: far[node] + height[node])
        most = far[end]
        for node in height:
            height[node] += min(far.get(node, most), most)
        path = [end]
        while path[-1] in via:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], room[end[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "new":
                amount = min(amount, flow[b[1], a[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "old":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return {arc: n for arc, n in flow.items() if n}


def equal_capacities(total: int, n_shards: int) -> dict[int, int]:
    return {s: total // n_shards + (s < total % n_shards) for s in range(n_shards)}


def moved_bytes(flow: Flow) -> int:
    return sum(n for (s, t), n in flow.items() if s != t)


def _sums(rows: DataFrame, shard: str) -> dict[int, int]:
    return {row[0]: row[1] for row in rows.groupBy(shard).agg(F.sum("size")).collect()}


def _carry_out(rows: DataFrame, shard: str, flow: Flow, block: list[str], order: list[str]) -> DataFrame:
    """Add ``_to``: where the flow takes a row of ``shard``; the bytes that stay are the last in order."""
    stretches = []
    for s in sorted({s for s, _ in flow}):
        at = 0
        for t in sorted((t for o, t in flow if o == s), key=lambda t: (t == s, t)):
            stretches.append((s, at, at + flow[s, t], t))
            at += flow[s, t]
    # One row per pair of shards.
    schema = f"{shard} int, _lo long, _hi long, _to int"
    plan = F.broadcast(rows.sparkSession.createDataFrame(stretches, schema))
    placed = rank_in_blocks(rows, [shard], block, order, "_before", F.col("size"))
    middle = F.col("_before") + F.expr("size div 2")
    return placed.join(plan, shard).where((middle >= F.col("_lo")) & (middle < F.col("_hi"))).drop("_before", "_lo", "_hi")


def reshard(rows: DataFrame, capacity: dict[int, int]) -> DataFrame:
    """Add ``shard`` and ``slot`` to a stored table of rows: doc_id, size, text_hash, old (and others).

    ``capacity`` gives the bytes of each new shard; together they must hold all rows.
    """
    spark = rows.sparkSession
    n_blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // BLOCK_ROWS)
    keyed = rows.withColumn("_block", block_of(n_blocks, "doc_id", "text_hash"))
    order = ["doc_id", "text_hash"]
    flow = min_cost_flow(_sums(rows, "old"), capacity)
    first = materialize(_carry_out(keyed, "old", flow, ["_block"], order).withColumnRenamed("_to", "_first"), "transfers")

    got = _sums(first, "_first")
    excess = {s: got.get(s, 0) - n for s, n in capacity.items()}
    evening = min_cost_flow({s: n for s, n in excess.items() if n > 0}, {s: -n for s, n in excess.items() if n < 0})
    settled = first.withColumn("_to", F.lit(None).cast("int"))
    if evening:
        # The smallest rows of a shard, up to the size class in which its excess ends, take part.
        size_class = F.floor(F.log2("size")).cast("int")
        classed = first.withColumn("_class", size_class)
        by_class = classed.groupBy("_first", "_class").agg(F.sum("size").alias("n")).orderBy("_first", "_class").collect()
        limit, seen = {}, defaultdict(int)
        for s, c, n in by_class:
            if seen[s] < 2 * max(0, excess.get(s, 0)):
                limit[s] = c
            seen[s] += n
        whole = {s: sum(n for s2, c, n in by_class if s2 == s and c <= limit[s]) for s in limit}
        for s in limit:
            evening[s, s] = whole[s] - excess[s]
        limits = F.broadcast(spark.createDataFrame(list(limit.items()), "_first int, _limit int"))
        split = classed.join(limits, "_first", "left")
        small = split.where("_class <= _limit").drop("_limit")
        others = split.where("_limit IS NULL OR _class > _limit").drop("_limit", "_class")
        evened = _carry_out(small, "_first", evening, ["_class", "_block"], order).drop("_class")
        settled = evened.unionByName(others.withColumn("_to", F.lit(None).cast("int")))
    placed = settled.withColumn("shard", F.coalesce("_to", "_first")).drop("_to", "_first")
    return rank_in_blocks(placed, ["shard"], ["_block"], order, "slot").drop("_block")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> DataFrame:
    """Write every row, moved or not, to the files of its new shard (``path``/shard=…); returns them.

    ``placed`` has doc_id, text_hash, old, shard and slot; texts come from ``docs`` by id and hash, each
    once, so that repeated rows neither multiply nor meet in one task.
    """
    # Texts of one hash are equal, so the id only spreads them; any number may stand for NULL.
    key = F.coalesce("doc_id", F.lit(0).cast("long")).alias("_key")
    texts = docs.select(key, "text_hash", "text").groupBy("_key", "text_hash").agg(F.first("text").alias("text"))
    rows = placed.withColumn("_key", key).join(texts, ["_key", "text_hash"]).select("doc_id", "text", "old", "shard", "slot")
    schema = "doc_id long, text string, old int, slot long, shard int"
    laid = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    # The files are the largest thing written; zstd keeps them well below the shuffles.
    laid.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard_documents(spark: SparkSession, docs: DataFrame, old: Column, n_shards: int) -> DataFrame:
    """Digest of all documents in ``n_shards`` shards of equal bytes, from shards ``old``.

    All shards are written anew, and every row is described from the files of its shard.
    """
    text = F.col("text").cast("string")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        F.coalesce(old.cast("int"), F.lit(0)).alias("old"),
    )
    sizes = texts.select("doc_id", "text_hash", "old", _size(F.col("text")).alias("size"), _checksum(F.col("text")).alias("text_crc32"))
    sizes = materialize(sizes, "sizes")
    total = sizes.agg(F.sum("size")).head()[0] or 0
    placed = materialize(reshard(sizes, equal_capacities(total, n_shards)), "placed")
    files = write_shards(texts, placed.select("doc_id", "text_hash", "old", "shard", "slot"), scratch_path(spark, "shards"))
    return files.select(
        "doc_id", _size(F.col("text")).alias("size"), _checksum(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"),
    )
