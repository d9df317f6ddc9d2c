"""Prefix trie of rebuilt conversations, by fingerprints that compose: no rebuilt text is ever put together."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.scale import checkpointed, join_counted_keys

#: Fingerprints are numbers below this Mersenne prime, in sixteen octets.
PRIME = (1 << 127) - 1
OCTETS = 16
EMPTY = bytes(OCTETS)
#: The most turns that a conversation takes over.
MOST = 5
#: Ids that end at one node are joined in blocks of this power of two of consecutive ids.
BLOCK_BITS = 12


def base_of(attempt: int) -> int:
    """The base of the fingerprints of an attempt."""
    return int.from_bytes(hashlib.sha256(f"base {attempt}".encode()).digest(), "big") % PRIME


def digest_of(role: Column, text: Column, attempt: int) -> Column:
    """A digest of a turn; the length of the role keeps role and text apart."""
    head = F.concat_ws(":", F.lit(str(attempt)), F.octet_length(role).cast("string"), role)
    return F.unhex(F.sha2(F.concat(head, text), 256))


def symbol(digest: bytes) -> int:
    """A turn as a number from 1 to PRIME - 1."""
    return int.from_bytes(digest[:OCTETS], "big") % (PRIME - 1) + 1


class Product:
    """The product of a run of turns, an element of a monoid: (power, value) stands for x -> power * x + value."""

    __slots__ = ("power", "value")

    def __init__(self, power: int = 1, value: int = 0):
        self.power, self.value = power, value

    def then(self, other: Product) -> Product:
        """This run, followed by the other."""
        return Product(self.power * other.power % PRIME, (self.value * other.power + other.value) % PRIME)


def octets(value: int) -> bytes:
    return value.to_bytes(OCTETS, "big")


def rebuilt(value: int, own_head: int, head: int, after: int, base: int) -> int:
    """The fingerprint of a conversation's turns up to ``value``'s once its own head is replaced by another, from
    the fingerprints alone: ``value`` covers ``after`` turns beyond the own head."""
    return (value + (head - own_head) * pow(base, after, PRIME)) % PRIME


def turns_of(conversations: DataFrame, attempt: int) -> DataFrame:
    """Every turn with its digest and code points, texts left where they are."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv"), conversations["turn"].alias("turn"),
        digest_of(role, text, attempt).alias("digest"), F.length(text).cast("long").alias("points"),
        role.alias("role"), text.alias("text"),
    )


def prefixes(turns: DataFrame, base: int) -> DataFrame:
    """(conv, i, before, value, digest, points): the i-th turn of a conversation, from 1, with the fingerprints of
    the turns before it and of those up to it.

    A scan over the turns in order, dealt out by ranges, so that a conversation of any length spreads over many
    tasks: each range gives the product of its last conversation's turns, and what runs into a range is composed
    from those of the ranges before it.
    """
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest")]
    ranged = turns.select("conv", "turn", "digest", "points").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.select("conv", "digest", "points"))

    def last_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, run, whole = None, 0, Product(), True
        for batch in batches:
            for c, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != conv:
                    whole = conv is None
                    conv, n, run = c, 0, Product()
                n, run = n + 1, run.then(Product(base, symbol(digest)))
        if conv is not None:
            row = [TaskContext.get().partitionId(), conv, n, octets(run.power), octets(run.value), whole]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "conv", "n", "power", "value", "whole"])

    # one row a range
    runs = ranged.mapInArrow(last_runs, "part long, conv long, n long, power binary, value binary, whole boolean").collect()
    into, state = {}, None
    for row in sorted(runs, key=lambda r: r.part):
        run = Product(int.from_bytes(row.power, "big"), int.from_bytes(row.value, "big"))
        if state is not None:
            into[row.part] = state
        if row.whole and state is not None and state[0] == row.conv:
            state = (row.conv, state[1] + row.n, Product(1, state[2]).then(run).value)
        else:
            state = (row.conv, row.n, run.value)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, value = into.get(TaskContext.get().partitionId(), (None, 0, 0))
        for batch in batches:
            place, before, after = [], [], []
            for c, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != conv:
                    conv, n, value = c, 0, 0
                before.append(octets(value))
                n, value = n + 1, (value * base + symbol(digest)) % PRIME
                place.append(n)
                after.append(octets(value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(place, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), batch.column(1), batch.column(2)],
                names=["conv", "i", "before", "value", "digest", "points"],
            )

    return checkpointed(ranged.mapInArrow(scan, "conv long, i long, before binary, value binary, digest binary, points long"))


def one_text_each(turns: DataFrame, known: DataFrame) -> bool:
    """Whether equal digests are equal turns: those that occur more than once are compared, role and text."""
    repeated = known.groupBy("digest").agg(F.count("*").alias("size")).where("size > 1")
    rows = join_counted_keys(turns.select("digest", "role", "text"), repeated, ["digest"])
    turn = F.struct("role", "text")
    return rows.groupBy("digest").agg((F.min(turn) == F.max(turn)).alias("same")).where("not same").isEmpty()


def _own_members(rows: DataFrame, base: int) -> DataFrame:
    """Members by a conversation's own turns: (depth, value, parent, digest, points, n, conv, last)."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, value, parent = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("i", "before", "value", "h", "k", "head", "own_head")]
            for i, before, after, h, k, head, own in zip(*columns, strict=True):
                before, after, head, own = (int.from_bytes(x, "big") for x in (before, after, head, own))
                depth.append(k + i - h)
                parent.append(octets(rebuilt(before, own, head, i - 1 - h, base)))
                value.append(octets(rebuilt(after, own, head, i - h, base)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(depth, pa.int64()), pa.array(value, pa.binary()), pa.array(parent, pa.binary()), batch.column("digest"), batch.column("points"),
                    pa.array([1] * len(depth), pa.int64()), batch.column("conv"), batch.column("last"),
                ],
                names=["depth", "value", "parent", "digest", "points", "n", "conv", "last"],
            )

    columns = ["conv", "i", "before", "value", "digest", "points", "h", "k", "head", "own_head", (F.col("i") == F.col("turns")).alias("last")]
    return rows.select(*columns).mapInArrow(
        compose, "depth long, value binary, parent binary, digest binary, points long, n long, conv long, last boolean"
    )


def _members(known: DataFrame, source: Callable[[Column], Column], taken: Callable[[Column], Column], base: int) -> tuple[DataFrame, DataFrame]:
    """(members, ends): rows whose sums by (depth, value) make the nodes, and where each conversation ends."""
    h = taken(F.col("conv")).cast("long")
    empty = F.lit(EMPTY)
    convs = known.withColumn("h", h).groupBy("conv", "h").agg(
        F.max("i").alias("turns"), F.coalesce(F.max(F.when(F.col("i") == F.col("h"), F.col("value"))), empty).alias("own_head")
    )
    convs = convs.withColumn("source", source(F.col("conv")).cast("long"))
    turn = F.struct("i", "before", "value", "digest", "points")
    heads = known.where(F.col("i") <= MOST).groupBy(F.col("conv").alias("source")).agg(F.sort_array(F.collect_list(turn)).alias("turns_taken"))
    heads = heads.join(convs.select("source").distinct(), "source", "left_semi")
    convs = convs.join(heads, "source", "left")
    mine = F.filter("turns_taken", lambda t: t["i"] <= F.col("h"))
    convs = convs.withColumn("turns_taken", F.coalesce(mine, F.array().cast(heads.schema["turns_taken"].dataType)))
    convs = convs.withColumn("k", F.size("turns_taken").cast("long"))
    last = F.element_at(F.slice("turns_taken", -1, 1), 1)["value"]
    convs = checkpointed(convs.withColumn("head", F.when(F.col("k") > 0, last).otherwise(empty)))

    shared = convs.groupBy("source", "k").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.first("turns_taken").alias("turns_taken"))
    shared = shared.select("n", "conv", F.explode("turns_taken").alias("t")).select(
        F.col("t.i").alias("depth"), "t.value", F.col("t.before").alias("parent"), "t.digest", "t.points", "n", "conv"
    )
    joined = known.join(convs.select("conv", "h", "k", "turns", "head", "own_head"), "conv").where("i > h")
    own = checkpointed(_own_members(joined, base))
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0")
    nothing = F.lit(None).cast("binary")
    root = root.select(F.lit(0).cast("long").alias("depth"), empty.alias("value"), nothing.alias("parent"), nothing.alias("digest"), F.lit(0).cast("long").alias("points"), "n", "conv")
    members = own.drop("last").unionByName(shared).unionByName(root)
    ends = own.where("last").select("depth", "value", "conv").union(convs.where("turns <= h").select("k", "head", "conv"))
    return members, ends


def _node(depth: Column, value: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(depth), 16, "0")), value)


def _ended(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ids that end at a node, in order.

    Ids are joined in blocks of consecutive ones, each bounded; one after the other the blocks of a node are put
    into its digest, which no other way of work could split."""
    block = F.shiftright("conv", BLOCK_BITS)
    blocks = ends.select(_node(F.col("depth"), F.col("value")).alias("node"), block.alias("block"), "conv").groupBy("node", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            nodes, digests = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        nodes.append(node)
                        digests.append(digest.hexdigest())
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(put, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(node, sums of ``columns`` over its subtree) of nodes (node, up, columns): ``up`` is the node above or null.

    Each round doubles the distance that sums have come up and the pointers reach, so rounds grow with the
    logarithm of the depth. Sums are combined before the shuffle, the children of a hot node are not gathered."""
    state = nodes.select("node", "up", *columns)
    while not state.where("up is not null").isEmpty():
        gains = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(*[F.sum(c).alias(f"__{c}") for c in columns])
        grown = state.join(gains, "node", "left")
        grown = grown.select("node", "up", *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in columns])
        above = state.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("__next"))
        far = grown.where("up is not null").join(above, "up", "left").select("node", F.col("__next").alias("up"), *columns)
        state = checkpointed(far.union(grown.where("up is null").select("node", "up", *columns)))
    return state.drop("up")


def hundred(conv: Column) -> Column:
    """The conversation whose first turns a conversation takes over: the one that its hundred begins with."""
    return conv - conv % 100


def by_checksum(conv: Column) -> Column:
    """How many turns it takes over: 0 to MOST, by the checksum of its decimal id."""
    return F.crc32(conv.cast("string").cast("binary")) % (MOST + 1)


def trie(conversations: DataFrame, source: Callable[[Column], Column] = hundred, taken: Callable[[Column], Column] = by_checksum) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations (``conversations``: conv_id, turn, role, text).

    A conversation c is rebuilt from the first ``taken(c)`` turns (0 to MOST; all, if there are fewer) of the
    conversation ``source(c)``, none if that is absent, and its own turns after its first ``taken(c)``. Returns per
    node conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members but one times the code points of the last turn), ends_sha256.

    Fingerprints of a conversation's turns are products in a monoid; that of a rebuilt one is composed from the
    head's and the own suffix's. Members with equal fingerprints make a node, if all have the same node above and
    the same last turn, and equal digests of turns are compared as texts where they are stored. Should two
    different sequences agree, all is taken again with other digests and another base.

    Turns are in the order of ``turn``, null first; turns that share it follow each other by their digests (SHA-256
    of "0:", the role's octets, ":", role, text). Null roles and texts are empty, rows without conv_id are left
    out, repeated rows are turns of their own, other columns are ignored. Texts of any length are read once and
    moved only to be compared. An empty table has no node.
    """
    attempt = 0
    while True:
        turns, base = turns_of(conversations, attempt), base_of(attempt)
        known = prefixes(turns, base)
        members, ends = _members(known, source, taken, base)
        nodes = members.groupBy("depth", "value").agg(
            F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("points").alias("points"), F.min("parent").alias("parent"),
            (F.min("parent").eqNullSafe(F.max("parent")) & F.min("digest").eqNullSafe(F.max("digest"))).alias("proven"),
        )
        nodes = checkpointed(nodes.select(
            _node(F.col("depth"), F.col("value")).alias("node"), F.when(F.col("depth") > 0, _node(F.col("depth") - 1, F.col("parent"))).alias("up"),
            "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"), "proven",
        ))
        if nodes.where("not proven").isEmpty() and one_text_each(turns, known):
            break
        attempt += 1
    children = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = checkpointed(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    sums = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
    sums = subtree_sums(sums, ["n_leaves", "saved_tokens"])
    above = nodes.where("n_children > 0").select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("up is not null").join(above, "up").select("node", "parent_conv_id")
    found = nodes.drop("saved_tokens").join(sums, "node").join(below, "node", "left").join(_ended(ends), "node", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
