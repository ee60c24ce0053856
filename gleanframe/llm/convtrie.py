"""Prefix trie of conversations with subtree totals, by time-forward processing.

A node is a distinct sequence of first turns.  Its key is the exclusive-or of the hashes of
(place, turn), so keys of all beginnings of a conversation are running aggregates, its
parent's key is at hand, and nodes come from one combinable grouping, however many
conversations share them.  A conversation with very many turns is dealt to several tasks by
ranges of its turns.

A node is named by its smallest member and its depth.  Nodes are sharded by ranges of that
member, sorted by falling depth, and every node sends its totals to its parent through a
priority queue that spills.  A first pass gives the totals of the shards' roots.  Roots
point to the root of the shard's tree that holds their parent; pointer doubling adds up what
each root's tree is sent from other shards.  A second pass, with these totals put in where they
arrive, gives the totals of all nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm.tables import kept

# Blocks of conversations that share beginnings, and how many first turns at most.
BLOCK = 100
HEADS = 6
# Binary logarithm of the conversation ids of a shard, and of a piece of a node's list of ids.
SHARD_BITS = 12
PIECE_BITS = 12
# Messages a queue holds in memory.
QUEUE = 1 << 17


class SpillingQueue:
    """Messages in order of their numbers; sorted runs of them go to unnamed files of the task.

    A run is private to the task and dies with it, so a task that is repeated starts afresh.
    """

    def __init__(self, width: int, limit: int = QUEUE):
        self.row, self.limit = struct.Struct(f"<{width}q"), limit
        self.heap: list[tuple[int, ...]] = []
        self.runs: list[tuple[tuple[int, ...], int, Iterator]] = []

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            spilled = tempfile.TemporaryFile()
            for item in sorted(self.heap):
                spilled.write(self.row.pack(*item))
            spilled.seek(0)
            self.heap = []
            self._next(self._read(spilled), len(self.runs))

    def _read(self, spilled) -> Iterator[tuple[int, ...]]:
        with spilled:
            while block := spilled.read(self.row.size * 1024):
                yield from self.row.iter_unpack(block)

    def _next(self, run: Iterator, number: int) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, number, run))

    def first(self) -> tuple[int, ...] | None:
        heads = [q[0] for q in (self.heap,) if q] + [r[0][0] for r in (self.runs,) if r]
        return min(heads, default=None)

    def pop(self) -> tuple[int, ...]:
        if self.heap and (not self.runs or self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        head, number, run = heapq.heappop(self.runs)
        self._next(run, number)
        return head


def _earlier(totals: DataFrame, key: str, column: str, how: str) -> Column:
    window = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.expr(how).over(window), F.lit(0).cast("long")).alias(column)


def _turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, part, pos, role, told, size)``: turns in order, text as a hash and its length.

    ``part`` numbers ranges of all turns, so a conversation of very many turns has several.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.md5(text.cast("binary")).alias("told"), F.length(text).cast("long").alias("size"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("told")]
    dealt = kept(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = counts.select("conv_id", "part", _earlier(counts, "conv_id", "before", "sum(n)"))
    placed = dealt.withColumn("row", F.row_number().over(inside)).join(before, ["conv_id", "part"])
    return placed.select("conv_id", "part", (F.col("row") - 1 + F.col("before")).alias("pos"), "role", "told", "size")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the first turns of its block's, and its steps.

    ``(conv_id, total)`` and ``(conv_id, part, pos, role, told, size, total)``.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = own.select("conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    bases = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("took", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = kept(convs.withColumn("total", F.col("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    named = convs.select("conv_id", "h", "took", "total")
    tails = turns.join(named, "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("took"))
    first = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    # A first turn has at most BLOCK conversations.
    taken = first.join(convs.select("conv_id", "base", "h", "total"), "base").where("pos < h").withColumn("part", F.lit(-1))
    columns = ["conv_id", "part", "pos", "role", "told", "size", "total"]
    return convs.select("conv_id", "total"), tails.select(columns).unionByName(taken.select(columns))


def _keyed(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """A row per conversation and depth: node key ``(k1, k2)``, parent's key ``(p1, p2)``."""
    steps = steps.withColumn("x1", F.xxhash64("pos", "role", "told")).withColumn("x2", F.xxhash64("told", "pos", "role"))
    inside = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.expr(f"bit_xor({c})").over(inside)
    totals = steps.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    before = totals.select(
        "conv_id", "part", _earlier(totals, "conv_id", "e1", "bit_xor(t1)"), _earlier(totals, "conv_id", "e2", "bit_xor(t2)")
    )
    along = steps.withColumn("r1", run("x1")).withColumn("r2", run("x2")).join(before, ["conv_id", "part"])
    along = along.withColumn("k1", F.col("r1").bitwiseXOR(F.col("e1"))).withColumn("k2", F.col("r2").bitwiseXOR(F.col("e2")))
    last = (F.col("total") == F.col("pos") + 1).alias("last")
    rows = along.select(
        "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"),
        "conv_id", (F.col("pos") + 1).alias("depth"), "size", last,
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select(
        zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "conv_id",
        zero.alias("depth"), zero.alias("size"), (F.col("total") == 0).alias("last"),
    )
    return rows.unionByName(roots)


def _ends(rows: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)``: the hash of the members that end at a node, in order.

    Pieces of at most ``2 ** PIECE_BITS`` ids are joined first; a node's pieces are then
    read one by one, since the hash of a sequence can't be put together from parts.
    """
    ids = rows.where("last").withColumn("piece", F.shiftright("conv_id", PIECE_BITS))
    joined = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = ids.groupBy("k1", "k2", "piece").agg(joined.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done = {"k1": [], "k2": [], "ends_sha256": []}
            for key, text in zip(zip(batch["k1"].to_pylist(), batch["k2"].to_pylist()), batch["ids"].to_pylist()):
                if key != now:
                    if now:
                        _add(done, now, running)
                    now, running = key, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(text.encode())
            yield pa.RecordBatch.from_pydict(done, _ENDS)
        if now:
            done = {"k1": [], "k2": [], "ends_sha256": []}
            _add(done, now, running)
            yield pa.RecordBatch.from_pydict(done, _ENDS)

    by_node = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece")
    return by_node.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


_ENDS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _add(done: dict, key: tuple[int, int], running) -> None:
    done["k1"].append(key[0])
    done["k2"].append(key[1])
    done["ends_sha256"].append(running.hexdigest())


def _shard(column: str, bits: int) -> Column:
    return F.shiftright(column, bits)


def _totals(nodes: DataFrame, bits: int, roots_only: bool) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_leaves, saved_tokens)`` within every shard.

    ``nodes`` has ``leaves`` and ``saved``: what a node has by itself or is sent from other
    shards.  With ``roots_only`` only nodes whose parent is in another shard are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(5)
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("conv_id", "depth", "parent_conv_id", "leaves", "saved")]
            for conv, depth, parent, leaves, saved in zip(*columns):
                # A shard's messages are all taken before the next shard begins.
                top = queue.first()
                while top and top[0] == -depth and top[1] == conv:
                    _, _, _, more, add = queue.pop()
                    leaves, saved, top = leaves + more, saved + add, queue.first()
                outside = parent is None or parent >> bits != conv >> bits
                if not outside:
                    queue.push((1 - depth, parent, conv, leaves, saved))
                if outside or not roots_only:
                    out.append((conv, depth, parent, leaves, saved))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.int64()) for i in range(5)],
                names=["conv_id", "depth", "parent_conv_id", "n_leaves", "saved_tokens"],
            )

    given = nodes.select("conv_id", "depth", "parent_conv_id", "leaves", "saved", _shard("conv_id", bits).alias("shard"))
    sorted_ = given.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id")
    schema = "conv_id long, depth long, parent_conv_id long, n_leaves long, saved_tokens long"
    return sorted_.drop("shard").mapInArrow(run, schema)


def _tops(nodes: DataFrame, bits: int) -> DataFrame:
    """``(conv_id, top)``: for nodes with that smallest member the root of their tree in the shard.

    All nodes with one smallest member are a path, and the smallest member of a parent is
    never greater, so a shard has one row per conversation at most.
    """
    paths = nodes.where("parent_conv_id is null or parent_conv_id <> conv_id")

    def run(table: pa.Table) -> pa.Table:
        above = dict(zip(table["conv_id"].to_pylist(), table["parent_conv_id"].to_pylist()))
        top: dict[int, int] = {}
        for conv in sorted(above):
            top[conv] = top.get(above[conv], conv)
        return pa.table({"conv_id": pa.array(top.keys(), pa.int64()), "top": pa.array(top.values(), pa.int64())})

    return paths.select("conv_id", "parent_conv_id", _shard("conv_id", bits).alias("shard")).groupBy("shard").applyInArrow(
        run, "conv_id long, top long"
    )


def _across(roots: DataFrame, tops: DataFrame) -> DataFrame:
    """Roots with all that is below them: the roots of other shards hang at nodes of their trees."""
    hung = tops.select(F.col("conv_id").alias("parent_conv_id"), F.col("top").alias("up"))
    state = kept(roots.join(hung, "parent_conv_id", "left").select(
        "conv_id", "depth", "parent_conv_id", "up", "n_leaves", "saved_tokens"
    ))
    while not state.where("up is not null").isEmpty():
        sent = state.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(
            F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("add")
        )
        jump = state.select(F.col("conv_id").alias("up"), F.col("up").alias("onward"))
        state = kept(state.join(sent, "conv_id", "left").join(jump, "up", "left").select(
            "conv_id", "depth", "parent_conv_id", F.col("onward").alias("up"),
            (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("add", F.lit(0))).alias("saved_tokens"),
        ))
    return state


def conversation_trie(conversations: DataFrame, shard_bits: int = SHARD_BITS) -> DataFrame:
    """One row per node, with the columns of the contract.

    Turns are in order of ``turn`` (null first), then role, then the MD5 of the text; repeated
    rows are turns of their own.  Rows without a conv_id belong to no conversation.  Other
    columns play no part, and an empty table gives no rows.
    """
    convs, steps = _rebuilt(kept(_turns(conversations)))
    rows = kept(_keyed(convs, steps))
    nodes = rows.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("size").alias("size"),
    )
    nodes = kept(nodes)
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(above, ["p1", "p2"], "left").join(below, ["k1", "k2"], "left").join(_ends(rows), ["k1", "k2"], "left")
    nodes = kept(nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    ))
    own = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    across = _across(_totals(own, shard_bits, True), _tops(nodes, shard_bits))
    arrive = across.where("parent_conv_id is not null").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    ).agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("add"))
    given = own.join(arrive, ["conv_id", "depth"], "left")
    given = given.withColumn("leaves", F.col("leaves") + F.coalesce("more", F.lit(0)))
    given = given.withColumn("saved", F.col("saved") + F.coalesce("add", F.lit(0)))
    totals = _totals(given, shard_bits, False).select("conv_id", "depth", "n_leaves", "saved_tokens")
    return nodes.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
