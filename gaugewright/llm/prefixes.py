"""Prefix trie of conversations, built as a burst trie.

A conversation is a sequence of turn ids (128-bit digests of role and text), so texts leave the work at the first step.
All conversations begin in one container under the root. A container of more than `most` turns bursts: the turns that all its
members share become trie heads (their number follows from the least and the greatest sequence of the container, as
nothing in between can share less), members that end there are put down as ends of the last head, and the others go to
a container of their own for each next turn id. This is repeated, a few Spark jobs a round, until no container is too
large. What remains is sorted by container and suffix on the JVM side and swept: neighbours share a stack of open nodes,
and a node is finished when a suffix leaves it. Sums over subtrees run through the sweep, then from container to
container up the heads, one round at a time.

No task holds more than a row of the sorted stream and its open nodes with their finished children. A hot first turn,
or thousands of equal conversations, burst like any container and are counted by partial aggregates; their ids are
joined in blocks of 4,096 consecutive ids before the digest takes the blocks in order. What is broadcast has a row per
container that bursts in a round, and `most` grows with the input so that there are at most 2 ** 18 of them.

Results: null roles and texts count as empty; rows without a conversation id are left out. Turns are taken in order
(nulls first), equal turns in order of their digest. Repeated rows are turns like others. A conversation without turns
is a member of the root. An empty table gives no nodes. Other columns don't matter. One row of the sequences holds the
ids of one conversation (24 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import checksum, enter
from gaugewright.session import materialize

MOST = 1024  # turns in a container that need not burst, while the input is small
CONTAINERS = 18  # more turns than 2 ** this many times MOST raise it
BLOCK = 12  # ids that agree but for so many bits are joined at once

NODE = "top boolean, head binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id binary"
NOTHING = hashlib.sha256().hexdigest()


def digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def sequences(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and turns, an ordered array of (id, size in bytes)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("id"), F.octet_length(text).cast("long").alias("size"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id", "size")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame, siblings: int = 5, most: int = 9) -> DataFrame:
    """Sequences in which conversation c takes its first h turns from c - c % siblings; h = crc32(c) % most."""
    given = materialize(conversations)
    first = given.filter(F.col("conv_id") % siblings == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("start")
    )
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int")
    own = given.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % siblings).alias("base"), h.alias("h"))
    none = F.slice("turns", 1, 0)
    return own.join(first, "base", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("start", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns")
    )


class Node:
    __slots__ = ("turn", "size", "least", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, turn: bytes | None, size: int):
        self.turn, self.size = turn, size
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends = None  # digest of the members that end here
        self.waiting: list[tuple] = []  # finished children, which lack only this node's least member

    def end(self, member: int) -> None:
        text = str(member).encode()
        if self.ends is None:
            self.ends = hashlib.sha256(text)
        else:
            self.ends.update(b"," + text)
        self.n += 1
        self.least = member if self.least is None else min(self.least, member)

    def finish(self, top: bool, head: bytes | None, depth: int) -> tuple:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size
        ends = NOTHING if self.ends is None else self.ends.hexdigest()
        return top, head, depth, self.least, self.n, self.children, self.leaves, self.saved, ends, self.turn

    def take(self, child: Node, record: tuple) -> None:
        self.n += child.n
        self.least = child.least if self.least is None else min(self.least, child.least)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved
        self.waiting.append(record)


class Sweep:
    """Sorted suffixes of one container become nodes."""

    def __init__(self, head: bytes, depth: int, parent: int | None, turn: bytes | None, size: int):
        self.head, self.depth, self.parent = head, depth, parent
        self.open = [Node(turn, size)]

    def add(self, member: int, turns: list[dict]) -> Iterator[tuple]:
        shared, opened = 0, self.open
        for turn, node in zip(turns, opened[1:]):
            if turn["id"] != node.turn:
                break
            shared += 1
        yield from self.close(shared + 1)
        opened.extend(Node(t["id"], t["size"]) for t in turns[shared:])
        opened[-1].end(member)

    def close(self, keep: int) -> Iterator[tuple]:
        while len(self.open) > keep:
            node = self.open.pop()
            for record in node.waiting:
                yield *record[:4], node.least, *record[4:]
            depth = self.depth + len(self.open)
            if self.open:
                self.open[-1].take(node, node.finish(False, None, depth))
            else:
                record = node.finish(True, self.head, depth)
                yield *record[:4], self.parent, *record[4:]


def batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def swept(settled: DataFrame) -> DataFrame:
    """Nodes of all containers; a container's own node is marked as its top."""
    dealt = settled.repartition("head").sortWithinPartitions("head", "suffix", "conv_id")
    kind = {"boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in NODE.split(", ")]
    names, kinds = [f[0] for f in fields], [kind[f[1]] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("prefixes")
        now, out = None, []
        for given in batches:
            columns = [given.column(c) for c in ("head", "k", "parent_rep", "turn_id", "size", "conv_id", "suffix")]
            for i in range(given.num_rows):  # a row at a time, as a suffix may be long
                head, k, parent, turn, size, member, suffix = (c[i].as_py() for c in columns)
                if now is None or now.head != head:
                    if now is not None:
                        out.extend(now.close(0))
                    now = Sweep(head, k, parent, turn, size)
                for node in now.add(member, suffix):
                    out.append(node)
                    if len(out) >= 2048:
                        yield batch(names, kinds, out)
                        out = []
        if now is not None:
            for node in now.close(0):
                out.append(node)
                if len(out) >= 2048:
                    yield batch(names, kinds, out)
                    out = []
        yield batch(names, kinds, out)

    return dealt.mapInArrow(run, NODE)


def ends(ended: DataFrame) -> DataFrame:
    """Digest of the sorted ids of each head's ended members: ids joined by block, then blocks taken in order."""
    blocks = ended.groupBy("head", F.shiftright("conv_id", BLOCK).alias("block")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("joined")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sha = None
        out: list[tuple] = []
        for given in batches:
            for head, joined in zip(given.column("head").to_pylist(), given.column("joined").to_pylist()):
                if sha is None or head != now:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = head, hashlib.sha256(joined.encode())
                else:
                    sha.update(b"," + joined.encode())
            yield batch(["head", "ends_sha256"], [pa.binary(), pa.string()], out)
            out = []
        if sha is not None:
            yield batch(["head", "ends_sha256"], [pa.binary(), pa.string()], [(now, sha.hexdigest())])

    return blocks.repartition("head").sortWithinPartitions("head", "block").mapInArrow(run, "head binary, ends_sha256 string")


def nodes(sequences: DataFrame, most: int | None = None) -> DataFrame:
    """All trie nodes of sequences (conv_id, turns), with the id of their last turn.

    `most` is the number of turns (one more for each member) from which a container bursts.
    """
    root = F.lit(b"")
    live = materialize(sequences.select(
        "conv_id", "turns", root.alias("head"), F.lit(0).alias("k"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_rep"),
    ))
    rounds: list[DataFrame] = []  # containers that burst
    settled: list[DataFrame] = []
    ended: list[DataFrame] = []
    while True:
        suffix = F.slice("turns", F.col("k") + 1, F.size("turns"))
        sizes = live.groupBy("head", "k", "parent", "parent_rep").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.sum(F.size("turns") - F.col("k") + 1).alias("n_turns"),
            F.min("turns").alias("low"), F.max(suffix).alias("high"),
        )
        if most is None:
            total = live.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
            most = max(MOST, total >> CONTAINERS)
        low = F.slice("low", F.col("k") + 1, F.size("low"))
        unequal = F.array_position(F.zip_with(low, "high", lambda a, b: a.eqNullSafe(b)), False)
        m = F.col("k") + F.when(unequal == 0, F.size("high")).otherwise(unequal - 1).cast("int")
        burst = sizes.filter(F.col("n_turns") > most).withColumn("m", m)
        # Turns of the heads at depths k to m; the root has none.
        heads = F.concat(
            F.when(F.col("k") == 0, F.array(F.struct(F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("size")))).otherwise(F.slice("low", F.greatest(F.col("k"), F.lit(1)), F.lit(1))),
            F.slice("low", F.col("k") + 1, F.col("m") - F.col("k")),
        )
        burst = materialize(burst.select("head", "k", "parent", "parent_rep", "n", "rep", "m", heads.alias("heads")))
        marked = live.join(F.broadcast(burst.select("head", "m", "rep")), "head", "left")
        own = F.when(F.col("k") > 0, F.element_at("turns", F.greatest(F.col("k"), F.lit(1))))
        settled.append(marked.filter("m IS NULL").select(
            "head", "k", "parent", "parent_rep", own["id"].alias("turn_id"), F.coalesce(own["size"], F.lit(0)).alias("size"), "conv_id",
            suffix.alias("suffix"),
        ))
        if burst.isEmpty():
            break
        rounds.append(burst)
        ended.append(marked.filter(F.col("m") == F.size("turns")).select("head", "conv_id"))
        following = F.element_at("turns", F.col("m") + 1)["id"]
        live = materialize(marked.filter(F.col("m") < F.size("turns")).select(
            "conv_id", "turns", digest(F.col("head"), following).alias("head"), (F.col("m") + 1).alias("k"), F.col("head").alias("parent"), F.col("rep").alias("parent_rep"),
        ))
    together = settled[0]
    for part in settled[1:]:
        together = together.unionByName(part)
    found = materialize(swept(together))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"]
    out = found.select(*columns)
    if not rounds:
        return out
    parents = together.select("head", "parent").distinct()
    tops = found.filter("top").select("head", "n_leaves", "saved_tokens").join(parents, "head").select("parent", "n_leaves", "saved_tokens")
    tops = materialize(tops.groupBy("parent").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.count("*").alias("n_children")))
    last = ended[0]
    for part in ended[1:]:
        last = last.unionByName(part)
    last = materialize(ends(last))
    below: DataFrame | None = None  # sums of the containers that burst in the round after
    for burst in reversed(rounds):
        children = tops if below is None else tops.unionByName(below).groupBy("parent").agg(
            *[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")]
        )
        sums = burst.join(children.withColumnRenamed("parent", "head"), "head", "left").join(last, "head", "left")
        own = (F.col("n") - 1) * F.aggregate("heads", F.lit(0).cast("long"), lambda a, t: a + t["size"])
        sums = materialize(sums.select(
            "head", "k", "parent", "parent_rep", "n", "rep", "m", "heads", "ends_sha256", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved_tokens", F.lit(0)) + own).alias("saved_tokens"),
        ))
        below = sums.groupBy("parent").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.count("*").alias("n_children"))
        # What a head saves: the sum at the first one less what lies above.
        each = sums.select("*", F.posexplode("heads").alias("at", "turn"))
        above = F.aggregate(F.slice("heads", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, t: a + t["size"])
        bottom = F.col("k") + F.col("at") == F.col("m")
        out = out.unionByName(each.select(
            F.col("rep").alias("conv_id"), (F.col("k") + F.col("at")).cast("long").alias("depth"),
            F.when(F.col("at") == 0, F.col("parent_rep")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(bottom, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
            (F.col("saved_tokens") - (F.col("n") - 1) * above).alias("saved_tokens"),
            F.when(bottom, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
            F.col("turn")["id"].alias("turn_id"),
        ))
    return out


def oracle(siblings: int = 5, most: int = 9) -> str:
    """The same in SQL: every prefix of every conversation is a key."""
    return f"""
WITH turns AS (
  SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), lengths AS (
  SELECT conv_id, max(i) AS n, conv_id - conv_id % {siblings} AS base, {checksum("conv_id::VARCHAR")} % {most} AS h FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT l.conv_id, t.i AS depth, t.id, t.size FROM lengths l JOIN turns t ON t.conv_id = l.base AND t.i <= l.h
  UNION ALL
  SELECT l.conv_id, t.i - l.h + least(l.h, coalesce(b.n, 0)), t.id, t.size
  FROM lengths l JOIN turns t ON t.conv_id = l.conv_id AND t.i > l.h LEFT JOIN lengths b ON b.conv_id = l.base
), walked AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS size FROM lengths
  UNION ALL SELECT conv_id, depth, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth), size FROM rebuilt
), whole AS (SELECT conv_id, max(depth) AS n FROM walked GROUP BY conv_id),
nodes AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM walked GROUP BY path),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (
  SELECT path, string_agg(w.conv_id::VARCHAR, ',' ORDER BY w.conv_id) AS ids FROM walked w JOIN whole e ON e.conv_id = w.conv_id AND e.n = w.depth GROUP BY path
), sums AS (
  SELECT left(n.path, 32 * d) AS path, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN children c ON c.path = n.path, range(n.depth::BIGINT + 1) t(d) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)"""
