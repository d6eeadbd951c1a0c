"""Prefix trie of conversations: which turns many conversations share from the start, and what that saves.

A turn is a symbol (128 hash bits of role and text); a prefix of d turns has a fingerprint, a polynomial of
its symbols modulo the prime 2^127 - 1. Fingerprints of two parts of a conversation compose, so a
conversation is sorted by ranges and may lie in several tasks (``paths``).

A task puts the conversations that it reads into a z-fast trie (``ZFastTrie``): compacted nodes are hashed
at their handles, the prefixes of two-fattest depth on their edges; the exit node of a conversation is found by
fat binary search over its depth, a logarithmic number of look-ups however long it is. Conversations come
in batches: copies in a batch are counted first, all exit nodes are located, then edges are split and
leaves added. Edges are expanded to one row for each depth, and rows of one fingerprint from all tasks are
added up. A trie that has grown to ``TRIE_CELLS`` is emitted and begun anew; sequences of more than
``PIECE_TURNS`` turns are inserted piece by piece, each under the fingerprint it continues. Neither
changes results, as counts of a prefix simply add up.

Sums over subtrees need no walk down the trie: a node belongs to its smallest conversation, which then owns
all deeper nodes on its own path. What a subtree adds up to is the sum over its members of what they own,
less what the node's owner owns above it.

Defined results: turns come by ``turn`` (NULL first), equal ones by role, then by hash; NULL role or text is
empty; rows without conv_id belong to no conversation and are left out; repeated rows are repeated turns;
an empty table gives no nodes; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.operators.scan import number_rows, running
from wardflow.session import materialize

# Turns of a conversation inserted at once, conversations located at once, trie rows held in a task.
PIECE_TURNS = 4096
BATCH = 2048
TRIE_CELLS = 200_000
# Bytes of ids that are hashed from one row.
_ID_BYTES = 4096

# Fixed values of the fingerprint: a Mersenne prime and a number drawn at random below it.
_PRIME = (1 << 127) - 1
_BASE = 0x3A7F19C45D2E8B60F1D3572C9E84A6B7
_UNBASE = pow(_BASE, -1, _PRIME)
_MASK = (1 << 64) - 1

def _step(fingerprint: int, symbol: int) -> int:
    return (fingerprint * _BASE + symbol + 1) % _PRIME


def _bytes(fingerprint: int) -> bytes:
    return fingerprint.to_bytes(16, "big")


# Sequences


def turns(conversations: DataFrame) -> DataFrame:
    """Turns as (conv_id, place from 0, s1, s2, chars), texts as hash bits and lengths only."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    symbols = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("s1"),
        F.xxhash64(F.lit(1), text, role).alias("s2"),
        F.length(text).cast("long").alias("chars"),
    )
    numbered = number_rows(symbols, ["turn", "role", "s1", "s2"], "place", ["conv_id"])
    return numbered.select("conv_id", (F.col("place") - 1).alias("place"), "s1", "s2", "chars")


def rebuilt(own: DataFrame, hundred: int = 100, most: int = 5) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % ``hundred`` in place of its own.

    h is crc32(decimal c) % (``most`` + 1). A row of place -1 stands for the conversation itself.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    first = F.col("conv_id") - F.col("conv_id") % hundred
    convs = own.select("conv_id").distinct()
    starts = own.where((F.col("conv_id") % hundred == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "_first")
    wanted = convs.select("conv_id", first.alias("_first"), taken.alias("_taken"))
    borrowed = wanted.join(starts, "_first").where("place < _taken").select(own.columns)
    zero = F.lit(0).cast("long")
    marks = convs.select("conv_id", F.lit(-1).cast("long").alias("place"), zero.alias("s1"), zero.alias("s2"), zero.alias("chars"))
    return own.where(F.col("place") >= taken).unionAll(borrowed).unionAll(marks)


def _batch(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    values = zip(*rows) if rows else [()] * len(columns)
    return pa.RecordBatch.from_pydict({c: pa.array(v, kind) for (c, kind), v in zip(columns.items(), values)})


_LOCAL = {
    "chunk": pa.int64(),
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "fp": pa.binary(),
    "symbol": pa.binary(),
    "chars": pa.int64(),
    "is_last": pa.bool_(),
}


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth and fingerprint of each row, counted from where its conversation begins in this range."""
    chunk = TaskContext.get().partitionId()
    waiting = None  # the row before, until it is known whether its conversation goes on
    for batch in batches:
        out = []
        for conv_id, place, s1, s2, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "s1", "s2", "chars"))):
            symbol = ((s1 & _MASK) << 64 | s2 & _MASK) % _PRIME
            depth = fp = 0
            if waiting:
                if waiting[0] == conv_id:
                    depth, fp = waiting[1:3]
                out.append((chunk, *waiting[:2], _bytes(waiting[2]), *waiting[3:], waiting[0] != conv_id))
            if place >= 0:
                depth, fp = depth + 1, _step(fp, symbol)
            waiting = (conv_id, depth, fp, _bytes(symbol), chars)
        yield _batch(_LOCAL, out)
    if waiting:
        yield _batch(_LOCAL, [(chunk, *waiting[:2], _bytes(waiting[2]), *waiting[3:], True)])


def paths(sequences: DataFrame) -> DataFrame:
    """One row for each prefix of each conversation: depth, fingerprint, that of the prefix one shorter, whether it is whole.

    ``sequences`` has (conv_id, place, s1, s2, chars), and a row of place -1 for every conversation. Rows
    are sorted by ranges; of the one conversation that may cross a border, what the ranges before make
    of it is carried over. One row for each range passes through the driver.
    """
    ranged = sequences.repartitionByRange("conv_id", "place").sortWithinPartitions("conv_id", "place")
    kinds = "chunk long, conv_id long, depth long, fp binary, symbol binary, chars long, is_last boolean"
    local = materialize(ranged.mapInArrow(_local_paths, kinds), "local_paths")
    last = F.max(F.struct("conv_id", "depth", "fp"))
    borders = local.groupBy("chunk").agg(F.min("conv_id").alias("first"), last.alias("last")).collect()
    carried: dict[int, tuple[int, int, int]] = {}  # range -> conversation begun before it, its depth, fingerprint
    goes_on: dict[int, int] = {}  # range -> conversation that does not end in it
    before: tuple[int, int, int] | None = None
    for number, row in enumerate(rows := sorted(borders)):
        conv_id, depth, fp = row["last"]["conv_id"], row["last"]["depth"], int.from_bytes(row["last"]["fp"], "big")
        if before and before[0] == row["first"]:
            carried[row["chunk"]] = before
            goes_on[rows[number - 1]["chunk"]] = conv_id if conv_id == row["first"] else row["first"]
            if conv_id == row["first"]:
                depth, fp = depth + before[1], (before[2] * pow(_BASE, depth, _PRIME) + fp) % _PRIME
        before = (conv_id, depth, fp)
    shared = local.sparkSession.sparkContext.broadcast((carried, goes_on))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, goes_on = shared.value
        none = (None, 0, 0)
        for batch in batches:
            out = []
            for chunk, conv_id, depth, fp, symbol, chars, is_last in zip(*(c.to_pylist() for c in batch.columns)):
                fp = int.from_bytes(fp, "big")
                begun, base_depth, base = carried.get(chunk, none)
                if begun == conv_id:
                    fp = (base * pow(_BASE, depth, _PRIME) + fp) % _PRIME
                    depth += base_depth
                parent = _bytes((fp - int.from_bytes(symbol, "big") - 1) * _UNBASE % _PRIME) if depth else None
                out.append((conv_id, depth, _bytes(fp), parent, chars, is_last and goes_on.get(chunk) != conv_id))
            yield _batch(_PATH, out)

    # In the order of the ranges' files, so a conversation's rows follow each other.
    return materialize(local.mapInArrow(whole, _PATH_KINDS), "paths")


_PATH = {
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "fp": pa.binary(),
    "parent": pa.binary(),
    "chars": pa.int64(),
    "is_end": pa.bool_(),
}
_PATH_KINDS = "conv_id long, depth long, fp binary, parent binary, chars long, is_end boolean"


# The trie


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the greatest power of two divides."""
    return high & -1 << (low ^ high).bit_length() - 1


class Piece:
    """Consecutive prefixes of conversations: ``prints[i]`` is the fingerprint at depth ``root`` + i."""

    __slots__ = ("root", "prints", "chars", "count", "least", "has_mark", "marked")

    def __init__(self, root: int, prints: list[bytes], chars: list[int], conv_id: int, has_mark: bool):
        self.root, self.prints, self.chars = root, prints, chars
        self.count, self.least = 1, conv_id
        # Conversations that begin here, and so are members of the root itself.
        self.marked, self.has_mark = int(has_mark), has_mark

    @property
    def end(self) -> int:
        return self.root + len(self.prints) - 1

    def at(self, depth: int) -> bytes:
        return self.prints[depth - self.root]


class Node:
    """A compacted node: the edge from below depth ``base`` down to ``extent``, spelled by ``piece``."""

    __slots__ = ("above", "base", "extent", "piece", "children", "count", "least", "handle")

    def __init__(self, above: Node | None, base: int, extent: int, piece: Piece):
        self.above, self.base, self.extent, self.piece = above, base, extent, piece
        self.children: dict[bytes, Node] = {}
        self.count, self.least, self.handle = 0, None, None

    def stop(self, count: int, least: int) -> None:
        self.count += count
        self.least = least if self.least is None else min(self.least, least)


class ZFastTrie:
    """Compacted tries (one for each fingerprint that pieces continue), nodes hashed at two-fattest depths."""

    def __init__(self) -> None:
        self.roots: dict[bytes, Node] = {}
        self.handles: dict[bytes, Node] = {}
        self.marked: dict[bytes, tuple[int, int]] = {}
        self.cells = 0

    def _hash(self, node: Node) -> None:
        handle = node.piece.at(two_fattest(node.base, node.extent))
        if node.handle is not None and node.handle != handle:
            del self.handles[node.handle]
        node.handle = handle
        self.handles[handle] = node

    def locate(self, piece: Piece) -> Node:
        """The deepest node whose hashed prefix is on the piece: its exit node, or the one above that."""
        node = self.roots[piece.prints[0]]
        low, high = piece.root, piece.end
        while low < high:
            middle = two_fattest(low, high)
            found = self.handles.get(piece.at(middle))
            if found is None:
                high = middle - 1
                continue
            node = found
            if node.extent > piece.end or node.piece.at(node.extent) != piece.at(node.extent):
                return node
            low = node.extent
        return node

    def insert(self, pieces: list[Piece]) -> None:
        """Insert a batch: copies once, all exit nodes first, then the changes."""
        distinct: dict[tuple[bytes, bytes], Piece] = {}
        for piece in pieces:
            same = distinct.setdefault((piece.prints[0], piece.prints[-1]), piece)
            if same is not piece:
                same.count, same.marked = same.count + piece.count, same.marked + piece.marked
                same.least = min(same.least, piece.least)
        for piece in distinct.values():
            if piece.prints[0] not in self.roots:
                self.roots[piece.prints[0]] = Node(None, piece.root, piece.root, piece)
        exits = [(piece, self.locate(piece)) for piece in distinct.values()]
        for piece, node in exits:
            self._add(piece, node)

    def _add(self, piece: Piece, node: Node) -> None:
        end = piece.end
        if piece.marked:
            count, least = self.marked.get(piece.prints[0], (0, piece.least))
            self.marked[piece.prints[0]] = (count + piece.marked, min(least, piece.least))
        # Edges may have been split since the node was located: go up to one that begins on the piece.
        while node.above and not (node.base < end and node.piece.at(node.base + 1) == piece.at(node.base + 1)):
            node = node.above
        while True:
            low, high = node.base, min(node.extent, end)
            while low < high:  # the last depth of the edge that is on the piece
                middle = (low + high + 1) // 2
                if node.piece.at(middle) == piece.at(middle):
                    low = middle
                else:
                    high = middle - 1
            if low < node.extent:
                node = self._split(node, low)
            if low == end:
                break
            name = piece.at(low + 1)
            below = node.children.get(name)
            if below is None:
                below = node.children[name] = Node(node, low, end, piece)
                self._hash(below)
                self.cells += end - low
                node = below
                break
            node = below
        node.stop(piece.count, piece.least)

    def _split(self, node: Node, depth: int) -> Node:
        """Put a node at ``depth`` into the edge of ``node``; returns it."""
        upper = Node(node.above, node.base, depth, node.piece)
        node.above.children[node.piece.at(node.base + 1)] = upper
        node.above, node.base = upper, depth
        upper.children[node.piece.at(depth + 1)] = node
        self._hash(node)
        self._hash(upper)
        return upper

    def rows(self) -> Iterator[tuple]:
        """Edges expanded: (fingerprint, parent's, depth, members, smallest member, code points of the last text)."""
        for fp, (count, least) in self.marked.items():
            yield fp, None, 0, count, least, 0
        for root in self.roots.values():
            order = [root]
            for node in order:
                order.extend(node.children.values())
            for node in reversed(order):  # children before the node above them
                if node.above is None:
                    continue
                node.above.stop(node.count, node.least)
                piece = node.piece
                for depth in range(node.base + 1, node.extent + 1):
                    at = depth - piece.root
                    yield piece.prints[at], piece.prints[at - 1], depth, node.count, node.least, piece.chars[at]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """Rows of one conversation that follow each other, as pieces."""
    piece, last = None, (None, None)
    for batch in batches:
        for conv_id, depth, fp, parent, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "depth", "fp", "parent", "chars"))):
            if (conv_id, depth - 1) == last and len(piece.prints) <= PIECE_TURNS:
                piece.prints.append(fp)
                piece.chars.append(chars)
            else:
                if piece:
                    yield piece
                if depth:
                    piece = Piece(depth - 1, [parent, fp], [0, chars], conv_id, False)
                else:
                    piece = Piece(0, [fp], [0], conv_id, True)
            last = (conv_id, depth)
    if piece:
        yield piece


_NODE = {"fp": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "n": pa.int64(), "least": pa.int64(), "chars": pa.int64()}
_NODE_KINDS = "fp binary, parent binary, depth long, n long, least long, chars long"


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the tries over the conversations of a task."""
    trie, waiting = ZFastTrie(), []

    def emitted() -> Iterator[pa.RecordBatch]:
        rows = trie.rows()
        while part := list(islice(rows, 10_000)):
            yield _batch(_NODE, part)

    for piece in _pieces(batches):
        waiting.append(piece)
        if len(waiting) == BATCH:
            trie.insert(waiting)
            waiting = []
            if trie.cells >= TRIE_CELLS:
                yield from emitted()
                trie = ZFastTrie()
    trie.insert(waiting)
    yield from emitted()


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """(fp, parent, depth, n_convs, conv_id, chars) of every node: those of all tasks' tries, added up."""
    parts = prefixes.select("conv_id", "depth", "fp", "parent", "chars").mapInArrow(_tries, _NODE_KINDS)
    return parts.groupBy("fp").agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.sum("n").alias("n_convs"),
        F.min("least").alias("conv_id"),
        F.max("chars").alias("chars"),
    )


# What hangs on the nodes


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node as comma-joined strings of bounded size."""
    kinds = {"fp": pa.binary(), "first": pa.int64(), "ids": pa.string()}
    at, first, ids, size = None, None, [], 0
    for batch in batches:
        out = []
        for fp, conv_id in zip(batch["fp"].to_pylist(), batch["conv_id"].to_pylist()):
            if ids and (fp != at or size >= _ID_BYTES):
                out.append((at, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                at, first = fp, conv_id
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
        yield _batch(kinds, out)
    if ids:
        yield _batch(kinds, [(at, first, ",".join(ids))])


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"fp": pa.binary(), "ends_sha256": pa.string()}
    at, digest = None, None
    for batch in batches:
        out = []
        for fp, ids in zip(batch["fp"].to_pylist(), batch["ids"].to_pylist()):
            if fp == at:
                digest.update(b",")
            else:
                if digest:
                    out.append((at, digest.hexdigest()))
                at, digest = fp, hashlib.sha256()
            digest.update(ids.encode())
        yield _batch(kinds, out)
    if digest:
        yield _batch(kinds, [(at, digest.hexdigest())])


def end_digests(prefixes: DataFrame) -> DataFrame:
    """SHA-256 of the ids, ascending and comma-joined, of the conversations that end at each node that has some.

    Ids are sorted by ranges and joined into strings of some kilobytes, so that the one task a node's
    digest needs reads few rows, one after the other, however many conversations are equal.
    """
    ends = prefixes.where("is_end").select("fp", "conv_id")
    ranged = ends.repartitionByRange("fp", "conv_id").sortWithinPartitions("fp", "conv_id")
    chunks = ranged.mapInArrow(_id_chunks, "fp binary, first long, ids string")
    return chunks.repartition("fp").sortWithinPartitions("fp", "first").mapInArrow(_id_digests, "fp binary, ends_sha256 string")


def _with_parent_conv(nodes: DataFrame) -> DataFrame:
    """Add the parent's conv_id. The few parents with a thousandth or more of all nodes are broadcast, so no key is hot."""
    least = max(1000, nodes.count() // 1000)
    wide = nodes.where(F.col("n_children") >= least).select(F.col("fp").alias("parent"), F.col("conv_id").alias("_wide"))
    other = nodes.where(F.col("n_children").between(1, least - 1)).select(F.col("fp").alias("parent"), F.col("conv_id").alias("_other"))
    found = nodes.join(F.broadcast(wide), "parent", "left")
    known = found.where("_wide IS NOT NULL OR parent IS NULL").withColumn("_other", F.col("_wide"))
    rest = found.where("_wide IS NULL AND parent IS NOT NULL").join(other, "parent", "left")
    both = known.unionByName(rest)
    return both.withColumn("parent_conv_id", F.coalesce("_wide", "_other")).drop("_wide", "_other")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """All nodes with members, children, leaves and savings; ``sequences`` as for ``paths``."""
    prefixes = paths(sequences)
    bare = materialize(trie_nodes(prefixes), "trie_nodes")
    children = bare.where("depth > 0").groupBy(F.col("parent").alias("fp")).agg(F.count("*").alias("n_children"))
    saved = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).cast("long")
    nodes = bare.join(children, "fp", "left").withColumns(
        {"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "_saved": saved}
    )
    above = running(nodes, ["conv_id"], ["depth"], {"_above": ("sum", F.col("_saved"))}, inclusive=False)
    nodes = materialize(_with_parent_conv(materialize(above, "owned")), "nodes")
    owned = nodes.groupBy("conv_id").agg(
        F.sum("_saved").alias("_owned"), F.max((F.col("n_children") == 0).cast("long")).alias("_leaf")
    )
    members = prefixes.select("conv_id", "fp").join(owned.where("_owned > 0 OR _leaf > 0"), "conv_id")
    sums = members.groupBy("fp").agg(F.sum("_owned").alias("_sum"), F.sum("_leaf").alias("n_leaves"))
    total = F.col("_sum") - F.coalesce("_above", F.lit(0))
    found = nodes.join(sums, "fp").join(end_digests(prefixes), "fp", "left")
    return found.withColumn("saved_tokens", total).drop("_sum", "_above", "_saved")


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn; ``conversations`` has (conv_id, depth, role, text) of every turn."""
    return nodes.join(conversations.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over the rebuilt conversations."""
    nodes = prefix_trie(rebuilt(turns(conversations)))
    nothing = hashlib.sha256(b"").hexdigest()
    whole = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes.select(
        *(F.col(c).cast("long").alias(c) for c in whole), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )


TRIE_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS first_conv, xor(list_reduce(
    list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda crc, c: list_reduce(
      list_prepend(xor(crc, c), range(8)),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 6 AS taken
  FROM (SELECT DISTINCT conv_id FROM own)
), rows_ AS (
  SELECT c.conv_id, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.first_conv AND o.place < c.taken
  UNION ALL
  SELECT c.conv_id, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place >= c.taken
), whole AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS seq FROM rows_ GROUP BY conv_id
  UNION ALL
  SELECT conv_id, [] FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM rows_)
), prefixes AS (
  SELECT conv_id, depth, len(seq) = depth AS is_end, seq[1:depth] AS seq
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM whole)
), nodes AS (
  SELECT row_number() OVER () AS node, * FROM (
    SELECT depth, seq, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256,
      CASE WHEN depth > 0 THEN (count(*) - 1) * length(seq[-1].text) ELSE 0 END AS saved
    FROM prefixes GROUP BY depth, seq)
), linked AS (
  SELECT n.*, p.node AS parent, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1]
), counted AS (
  SELECT l.*, coalesce(k.n, 0) AS n_children
  FROM linked l LEFT JOIN (SELECT parent, count(*) AS n FROM linked GROUP BY parent) k ON k.parent = l.node
), subtrees AS (
  SELECT a.node, sum((d.n_children = 0)::BIGINT) AS n_leaves, sum(d.saved) AS saved_tokens
  FROM counted d, unnest(range(0, d.depth + 1)) AS up(depth) JOIN nodes a ON a.depth = up.depth AND a.seq = d.seq[1:up.depth]
  GROUP BY a.node
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN subtrees USING (node)
"""
