"""Prefix trie of conversations: which openings they share, and what sharing them saves.

A turn's id is a 16-byte digest of its role and text, so a conversation is a key of fixed-width ids, and a node of the trie
is a prefix of whole turns. Conversations are sorted by key over all tasks. Each task walks its range in chunks, puts a chunk into an
adaptive radix tree (:mod:`radix`) and reads the nodes off the tree at byte depths that are whole turns.

A node inside a chunk is finished there. Only prefixes of a chunk's first and last key may go on in the next chunk; they come out as
parts, a few a chunk, and are added up by Spark. Keys are cut at a window of turns. A conversation that has no company at the window's end
is a chain from there on, one row a turn; the others go on, in the next, larger window, below the node they share. So no task needs
a whole conversation or all that share an opening, and rounds grow with the longest opening that is shared, not with long conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.llm.radix import Node, bottom_up, insert
from logweave.llm.scratch import stored

WIDTH = 16  # bytes of a turn's id
WINDOW = 32  # turns of the first key
LARGEST_WINDOW = 512
CHUNK = 20_000  # keys in a tree
NOTHING = hashlib.sha256(b"").hexdigest()

FOUND = "kind string, node binary, depth bigint, conv_id bigint, parent bigint, above binary, n bigint, children bigint, leaves bigint, saved bigint, chars bigint, ends string, path array<binary>"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Per turn: conv_id, pos (its place in the conversation, from 0), id, chars. Null turns first, null texts empty, ties by id; no row without a conversation."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.length(text).cast("bigint").alias("chars"),
    )
    ordered = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "id").select("conv_id", "id", "chars", F.monotonically_increasing_id().alias("place"))
    ordered = stored(ordered, "ordered").withColumn("part", F.shiftright("place", 33))
    # A conversation may lie in several sorted partitions; it has one row for each here.
    runs = ordered.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ahead = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"))
    return stored(ordered.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("shift")).alias("pos"), "id", "chars"), "turns")


def with_borrowed_heads(turns: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Rebuild every conversation of :func:`numbered_turns`: the first h turns of the first one of its block of ids, then its own after its first h.

    h is the crc32 of the id as text modulo ``most`` + 1. Adds conversations without turns of their own as one row with a null pos.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % (most + 1))
    bases = sizes.filter("conv_id = base").select("base", F.col("n").alias("base_n"))
    sizes = stored(sizes.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))), "sizes")
    heads = turns.filter((F.col("conv_id") % block == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    borrowed = sizes.filter("m > 0").join(heads, "base").filter("pos < m").select("conv_id", "pos", "id", "chars")
    own = turns.join(sizes.select("conv_id", "h", "m"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id", "chars")
    none = sizes.filter("m = 0 and n <= h").select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("pos", "bigint"), ("id", "binary"), ("chars", "bigint"))))
    return stored(borrowed.unionByName(own).unionByName(none), "rebuilt")


@dataclass
class Below:
    """What hangs below a place of the tree, up to the next turn above: its conversations, and its finished nodes added up."""

    n: int = 0
    conv: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    edge: bool = False
    waiting: list = field(default_factory=list)  # finished nodes directly below, whose parent is not known yet

    def add(self, other: Below) -> None:
        self.n += other.n
        self.conv = other.conv if self.conv is None else self.conv if other.conv is None else min(self.conv, other.conv)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.edge |= other.edge
        self.waiting += other.waiting


def node_id(root: bytes, prefix: bytes) -> bytes:
    return hashlib.md5(root + prefix).digest() if prefix else root


def tree_rows(root: bytes, low: int, window: int, members: list[tuple[int, bytes, bool]], chars: dict[bytes, int], left: bool, right: bool) -> Iterator[tuple]:
    """Rows (columns of ``FOUND``) of one root's sorted ``members`` (conversation, key, more behind it); ``left``, ``right``: others of this root may come before, after."""
    tree = Node()
    for conv, key, more in members:
        insert(tree, key, conv, more)
    ends = [key for key, open_ in ((members[0][1], left), (members[-1][1], right)) if open_]
    sums: dict[int, Below] = {}
    for node, start, whole in bottom_up(tree):
        below = Below()
        for _, child in node.kids.items():
            below.add(sums.pop(id(child)))
        for conv in node.ends + node.goes:
            below.add(Below(1, conv))
        first = start // WIDTH + 1 if node is not tree else 0
        for turn in range(len(whole) // WIDTH, first - 1, -1):
            prefix = whole[: turn * WIDTH]
            last = len(prefix) == len(whole)
            done, onward = (node.ends, node.goes) if last else ([], [])
            size = chars[prefix[-WIDTH:]] if turn else 0
            shared = not turn or any(key.startswith(prefix) for key in ends)
            edge = below.edge or shared or len(onward) > 1
            if edge:
                steps = [node_id(root, prefix[: k * WIDTH]) for k in range(turn + 1)]
                for row in below.waiting:
                    yield (*row[:5], steps[-1], *row[6:])
                above = steps[-2] if turn else None
                yield ("edge", steps[-1], low + turn, below.conv, None, above, below.n if turn or not low else 0, below.children, below.leaves, below.saved, size, None, steps)
                if done:
                    yield ("ends", steps[-1], None, done[0], None, None, None, None, None, None, None, ",".join(map(str, done)), None)
                for conv in onward:
                    yield ("open", steps[-1], None, conv, *[None] * 9)
                below = Below(below.n, below.conv, edge=True)
                continue
            if onward:
                yield ("tail", None, None, onward[0], below.conv, *[None] * 8)
            children = below.children + len(onward)
            leaves = below.leaves + len(onward) if children else 1
            saved = below.saved + (below.n - 1) * size
            text = hashlib.sha256(",".join(map(str, done)).encode()).hexdigest() if done else NOTHING
            for row in below.waiting:
                yield (*row[:4], below.conv, *row[5:])
            row = ("node", None, low + turn, below.conv, None, None, below.n, children, leaves, saved, None, text, None)
            below = Below(below.n, below.conv, 1, leaves, saved, False, [row])
        sums[id(node)] = below


def _level(keys: DataFrame, low: int, window: int) -> DataFrame:
    """All rows of a window's trees. ``keys``: root, conv_id, ids (of its turns inside the window), sizes (their characters), more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (root, conversation, key, more)
        chars: dict[bytes, int] = {}

        def trees() -> pa.RecordBatch:
            out, at = [], 0
            while at < len(held):
                end = at
                while end < len(held) and held[end][0] == held[at][0]:
                    end += 1
                out += tree_rows(held[at][0], low, window, [m[1:] for m in held[at:end]], chars, at == 0, end == len(held))
                at = end
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], [f.name for f in SCHEMA])

        for batch in batches:
            for root, conv, ids, sizes, more in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((root, conv, b"".join(ids), more))
                chars.update(zip(ids, sizes))
                if len(held) == CHUNK:
                    yield trees()
                    held, chars = [], {}
        if held:
            yield trees()

    binary, number, text = pa.binary(), pa.int64(), pa.string()
    SCHEMA = pa.schema(
        [("kind", text), ("node", binary), ("depth", number), ("conv_id", number), ("parent", number), ("above", binary), ("n", number), ("children", number)]
        + [("leaves", number), ("saved", number), ("chars", number), ("ends", text), ("path", pa.list_(binary))]
    )
    TYPES = SCHEMA.types
    ordered = keys.orderBy("root", "ids", "conv_id").select("root", "conv_id", "ids", "sizes", "more")
    return stored(ordered.mapInArrow(run, FOUND), "level")


def _keys(rebuilt: DataFrame, members: DataFrame, low: int, high: int) -> DataFrame:
    """Keys of the conversations of ``members`` (root, conv_id, n) in the window of turns ``low`` to ``high`` - 1."""
    inside = rebuilt.filter((F.col("pos") >= low) & (F.col("pos") < high)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("turns"))
    rows = members.join(inside, "conv_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<struct<pos:bigint,id:binary,chars:bigint>>")))
    return rows.select("root", "conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("sizes"), (F.col("n") > high).alias("more"))


def _merged(level: DataFrame, below: DataFrame | None) -> DataFrame:
    """Parts of nodes added up: node, depth, conv_id, above, n, children, leaves, saved (with all nodes below), and ``root_of``: it only stands for a node of the window before.

    ``below`` has children, leaves and saved of nodes (node) that go on in the next window.
    """
    parts = level.filter("kind = 'edge'").select("node", "depth", "conv_id", "above", "n", "children", "leaves", "saved", "chars", "path")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    edges = parts.groupBy("node").agg(F.min("conv_id").alias("conv_id"), *sums, *[F.any_value(c).alias(c) for c in ("depth", "above", "chars", "path")])
    if below is not None:
        more = below.select("node", F.col("children").alias("c"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        for name, extra in (("children", "c"), ("leaves", "l"), ("saved", "s")):
            edges = (edges.join(more, "node", "left") if name == "children" else edges).withColumn(name, F.col(name) + F.coalesce(extra, F.lit(0)))
    kids = edges.groupBy(F.col("above").alias("node")).agg(F.count("*").alias("kids"))
    edges = edges.drop("c", "l", "s").join(kids.filter("node is not null"), "node", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    own_saved = F.when(F.col("n") > 0, (F.col("n") - 1) * F.col("chars")).otherwise(0)
    edges = stored(edges.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves"))).withColumn("saved", F.col("saved") + own_saved), "edges")
    totals = edges.select(F.explode("path").alias("node"), "leaves", "saved").groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return stored(edges.drop("leaves", "saved", "path", "chars", "kids").join(totals, "node"), "merged")


def _hashed_ends(pieces: DataFrame) -> DataFrame:
    """Per node the hash of its pieces (node, conv_id, ends) in order, one piece in memory at a time."""
    rows = pieces.select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = ["node", "ends_sha256"]
        for batch in batches:
            nodes, hashes = [], []
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node != now:
                    if state:
                        nodes.append(now)
                        hashes.append(state.hexdigest())
                    now, state = node, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names)

    return rows.mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, pos: from 0 without gaps, id, chars; a null pos stands for no turns).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (characters that need not be repeated at or below the node),
    ends_sha256 (of the ids, ascending, of the conversations that end here). No conversations give no rows; equal
    conversations share all nodes; a conversation of any length is followed to its end.
    """
    sizes = stored(rebuilt.groupBy("conv_id").agg(F.count("pos").alias("n")), "lengths")
    rebuilt = rebuilt.filter("pos is not null")
    members = sizes.select(F.lit(b"").alias("root"), "conv_id", "n")
    low, levels, tails, alone = 0, [], [], []
    while True:
        level = _level(_keys(rebuilt, members, low, low + window), low, window)
        levels.append(level)
        low, window = low + window, min(2 * window, LARGEST_WINDOW)
        tails.append((low, level.filter("kind = 'tail'").select("conv_id", F.col("parent").alias("top"), F.lit(None).cast("binary").alias("above"))))
        onward = level.filter("kind = 'open'").select(F.col("node").alias("root"), "conv_id")
        onward = stored(onward.join(onward.groupBy("root").agg(F.count("*").alias("company")), "root"), "onward")
        single = onward.filter("company = 1")
        tails.append((low, single.select("conv_id", F.lit(None).cast("bigint").alias("top"), F.col("root").alias("above"))))
        alone.append(single.select(F.col("root").alias("node"), *(F.lit(v).cast("bigint").alias(c) for c, v in (("children", 1), ("leaves", 1), ("saved", 0)))))
        members = onward.filter("company > 1").drop("company").join(sizes, "conv_id")
        if members.isEmpty():
            break
    edges, below = [], None
    for level, single in zip(reversed(levels), reversed(alone)):
        below = single if below is None else single.unionByName(below)
        merged = _merged(level, below)
        below = merged.filter("n = 0").select("node", "children", "leaves", "saved")
        edges.append(merged.filter("n > 0"))

    def all_of(frames: list[DataFrame]) -> DataFrame:
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        return whole

    edges = all_of(edges)
    parents = edges.select(F.col("node").alias("above"), F.col("conv_id").alias("found"))
    hashes = _hashed_ends(all_of([level.filter("kind = 'ends'") for level in levels]))
    edges = edges.join(hashes, "node", "left").withColumn("ends", F.coalesce("ends_sha256", F.lit(NOTHING))).withColumn("parent", F.lit(None).cast("bigint"))
    columns = ["conv_id", "depth", "parent", "above", "n", "children", "leaves", "saved", "ends"]
    chains = all_of([_chain(rebuilt, sizes, convs, since) for since, convs in tails])
    nodes = all_of([level.filter("kind = 'node'").select(columns) for level in levels]).unionByName(edges.select(columns)).unionByName(chains)
    lacking = nodes.filter("above is not null").join(parents, "above", "left").withColumn("parent", F.col("found"))
    out = [c for c in columns if c != "above"]
    return nodes.filter("above is null").select(out).unionByName(lacking.select(out)).toDF(*COLUMNS)


def _chain(rebuilt: DataFrame, sizes: DataFrame, convs: DataFrame, since: int) -> DataFrame:
    """The nodes of conversations (conv_id, and of the node they leave: top, its member, or above, its id) that go on alone after ``since`` turns."""
    first, last = F.col("pos") == since, F.col("pos") + 1 == F.col("n")
    rows = rebuilt.filter(F.col("pos") >= since).join(convs.join(sizes, "conv_id"), "conv_id")
    ends: Column = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return rows.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.when(first, F.col("top")).otherwise(F.col("conv_id")).alias("parent"), F.when(first, F.col("above")).alias("above"),
        one.alias("n"), F.when(last, none).otherwise(one).alias("children"), one.alias("leaves"), none.alias("saved"), ends.alias("ends"),
    )


def conversation_trie(
    turns: DataFrame, block: int = 100, most: int = 5, window: int = WINDOW, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """:func:`prefix_trie` of conversations rebuilt by :func:`with_borrowed_heads` (``most`` 0: as they are).

    Null roles and texts are empty; rows without a conversation are left out; turns that tie go by their digest; repeated rows are turns of their own.
    An empty table gives no rows; other columns are not read.
    """
    return prefix_trie(with_borrowed_heads(numbered_turns(turns, conv_col, turn_col, role_col, text_col), block, most), window)
