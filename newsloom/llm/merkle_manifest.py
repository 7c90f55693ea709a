"""Merkle manifest of a table with witnesses kept up to date while leaves are appended.

Every row is a leaf; the leaves of a group (a source), in order of the key, are the bottom of a tree with ``ARITY`` children a
node, and the roots of the groups, in order of their names, are the bottom of one more such tree. ``Appender`` takes the
nodes of a tree in order. A run of siblings is open until it is full or the tree ends; the witness of a node holds the siblings
before it from the moment it is appended, and those behind it are added as they come; a full run is hashed and its
node is an append one level up, where all witnesses under it go on growing together, because they share the node's.

Distribution: leaves are range-partitioned and numbered per group without gathering a group; aligned blocks of
``BLOCK`` leaves are streamed through an appender, one open block a task; block roots are appended as the
leaves of the next round, until each group has one. On the way back every block first reads the witness of its root,
then its leaves, so a leaf's witness is complete when it leaves the stream. A group with any share of all rows is cut in blocks; the
driver sees block counts only. Rows move as digests, never as texts.

Defined cases: a null field is hashed as ``-``, so null and empty differ; a null key comes first in its group and a null group
before all others; rows with one key are ordered by leaf digest; repeated rows are leaves of their own; an empty table has no
rows; a one-leaf group is its leaf. Columns that are no fields are neither hashed nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored

ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@dataclass
class Witness:
    """Siblings of a node before and behind it, and the witness of its parent once that is appended."""

    left: list[str]
    right: list[str] = field(default_factory=list)
    parent: Witness | None = None

    def levels(self) -> Iterator[tuple[str, str]]:
        at: Witness | None = self
        while at is not None:
            yield "".join(at.left), "".join(at.right)
            at = at.parent


class Appender:
    """Nodes of a tree of ``levels`` levels, appended in order; holds the open run of each level."""

    def __init__(self, levels: int) -> None:
        self.runs: list[list[tuple[str, Witness]]] = [[] for _ in range(levels)]
        self.root: tuple[str, Witness | None] | None = None

    def append(self, node: str, level: int = 0) -> Witness | None:
        if level == len(self.runs):
            self.root = (node, None)
            return None
        run = self.runs[level]
        witness = Witness([h for h, _ in run])
        for _, open_one in run:
            open_one.right.append(node)
        run.append((node, witness))
        if len(run) == ARITY:
            self.complete(level)
        return witness

    def complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        parent = self.append(digest(h for h, _ in run), level + 1)
        for _, witness in run:
            witness.parent = parent

    def close(self) -> str:
        """End of the leaves: open runs are hashed as they are, bottom up."""
        for level, run in enumerate(self.runs):
            if run:
                self.complete(level)
        return self.root[0]


def height(nodes: int) -> int:
    """Levels above ``nodes`` bottom nodes, until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def leaf_digest(fields: Iterable[Column]) -> Column:
    text = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*text), 256)


def numbered(df: DataFrame, group: str | None, order: list[str], name: str) -> DataFrame:
    """Add ``_index`` from 0 within the group and its ``_total``, by range partitions and their counts per group."""
    keys = ([] if group is None else [group]) + order
    at = F.monotonically_increasing_id()  # partition number, then place within it
    cut = stored(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
                 .withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)), name)
    by = [F.lit(0).alias("_g")] if group is None else [F.col(group).alias("_g")]
    counts = cut.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_part").alias("_p"), "_g", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_g")).alias("_total"))
    same = (cut["_part"] == offsets["_p"]) & (cut[group].eqNullSafe(offsets["_g"]) if group is not None else F.lit(True))
    return cut.join(offsets, same).select(
        *[cut[c] for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_before")).alias("_index"), "_total")


def blocks(nodes: DataFrame) -> DataFrame:
    """Nodes of (tree, index, total, ...) dealt by block and sorted by place in it."""
    # Null trees are a value of their own here; hashing deals them like any other.
    return (nodes.withColumn("block", F.floor(F.col("index") / BLOCK).cast("long")).repartition("tree", "block")
            .sortWithinPartitions(F.col("tree").asc_nulls_first(), "block", F.col("hash").isNotNull(), "index"))


def _steps(total: int) -> int:
    return LEVELS if total > BLOCK else height(total)


def block_roots(nodes: DataFrame) -> DataFrame:
    """One row for each block of (tree, index, total, hash): its root as a node of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, out = None, None, []
        for batch in batches:
            for name, block, total, node in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != (name, block):
                    if at:
                        out.append((*at, count, tree.close()))
                    at, tree, count = (name, block), Appender(_steps(total)), -(-total // BLOCK)
                tree.append(node)
            if len(out) >= 2000:
                yield _rows(out)
                out = []
        if at:
            out.append((*at, count, tree.close()))
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        tree, block, total, root = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(block, pa.int64()), pa.array(total, pa.int64()), pa.array(root, pa.string())],
                                          names=["tree", "index", "total", "hash"])

    return blocks(nodes).select("tree", "block", "total", "hash").mapInArrow(run, "tree string, index long, total long, hash string")


WITNESS = "array<struct<left:string,right:string>>"
#: What travels with a node: its place, digest, and the key and changed digest of a leaf.
CARRIED = ["tree", "index", "total", "hash", "key", "changed"]


def block_witnesses(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes (columns ``CARRIED``) with ``top`` and their whole ``witness``, given both for each block's root in
    ``tops`` (tree, index, top, witness)."""
    none = lambda kind: F.lit(None).cast(kind)
    asked = nodes.select(*CARRIED, none("string").alias("top"), none(WITNESS).alias("witness"))
    heads = tops.select("tree", (F.col("index") * BLOCK).alias("index"), none("long").alias("total"),
                        *[none("string").alias(c) for c in CARRIED[3:]], "top", "witness")
    # The row of the root comes before the leaves of its block.
    dealt = blocks(asked.unionByName(heads)).select(*CARRIED, "top", "witness")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, waiting, name, head, above = None, [], None, None, []

        def finished() -> Iterator[pa.RecordBatch]:
            if waiting:
                tree.close()
            for k in range(0, len(waiting), 256):
                part = waiting[k:k + 256]
                steps = [[*(w.levels() if w else ()), *above] for *_, w in part]
                flat = pa.array([a for own in steps for a, _ in own], pa.string()), pa.array([b for own in steps for _, b in own], pa.string())
                ends = [0]
                for own in steps:
                    ends.append(ends[-1] + len(own))
                place, node, key, changed, _ = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(part), pa.string()), pa.array(place, pa.int64()), *[pa.array(v, pa.string()) for v in (node, key, changed)],
                    pa.array([head] * len(part), pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["left", "right"])),
                ], names=["tree", "index", "hash", "key", "changed", "top", "witness"])

        for batch in batches:
            for k, (name_, place, total, node, key, changed, top) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True)):
                if node is None:
                    yield from finished()
                    tree, waiting, name, head = None, [], name_, top
                    above = [(step["left"], step["right"]) for step in batch.column(7)[k].as_py()]
                    continue
                tree = tree or Appender(_steps(total))
                waiting.append((place, node, key, changed, tree.append(node)))
        yield from finished()

    return dealt.mapInArrow(run, f"tree string, index long, hash string, key string, changed string, top string, witness {WITNESS}")


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Stored rounds of block roots above ``nodes``; the last has one row for each tree."""
    rounds = []
    while True:
        nodes = stored(block_roots(nodes), "manifest-roots")
        rounds.append(nodes)
        if nodes.where("total > 1").isEmpty():
            return rounds


def descended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Witness and top of the nodes of the first round, given those of the last one's rows."""
    for nodes in reversed(rounds[:-1]):
        bare = nodes.withColumns({c: F.lit(None).cast("string") for c in ("key", "changed")})
        tops = stored(block_witnesses(bare, tops).select("tree", "index", "top", "witness"), "manifest-witnesses")
    return tops


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its siblings hash to."""
    return F.aggregate(witness, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof(witness: Column) -> Column:
    return F.sha2(F.array_join(F.transform(witness, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def witnesses(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
              suspect: Column | None = None, now: dict[str, Column] | None = None) -> DataFrame:
    """Key, leaf, changed_leaf, index, subroot, root and witness (siblings left and right, leaf to root) of every row.

    Rows that are ``suspect`` are hashed once more with the values of ``now`` in place of their fields: changed_leaf.
    """
    seen = now or {}
    other = F.when(F.lit(False) if suspect is None else suspect, leaf_digest(seen.get(f, F.col(f"`{f}`")) for f in fields))
    # Only digests go on from here: the texts are read and hashed once.
    leaves = stored(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("tree"),
                                leaf_digest(F.col(f"`{f}`") for f in fields).alias("hash"), other.alias("changed"),
                                F.monotonically_increasing_id().alias("row")), "manifest-leaves")
    placed = stored(numbered(leaves, "tree", ["key", "hash", "row"], "manifest-order").select(
        "tree", F.col("_index").alias("index"), F.col("_total").alias("total"), "hash", F.col("key").cast("string").alias("key"), "changed"), "manifest-nodes")
    rounds = climbed(placed)
    subroots = rounds[-1].select(F.col("tree").alias("name"), "hash")
    # The name takes the place of a key: it comes back beside the witness.
    groups = stored(numbered(subroots, None, ["name"], "manifest-groups").select(
        F.lit("").alias("tree"), F.col("_index").alias("index"), F.col("_total").alias("total"), "hash", F.col("name").alias("key"),
        F.lit(None).cast("string").alias("changed")), "manifest-subroots")
    upper = climbed(groups)
    end = upper[-1].select("tree", "index", F.col("hash").alias("top"), F.array().cast(WITNESS).alias("witness"))
    # Subroot and root travel as one value; they are parted again in the last projection.
    tops = stored(block_witnesses(groups, descended(upper, end)).select(
        F.col("key").alias("tree"), F.lit(0).cast("long").alias("index"), F.concat("hash", "top").alias("top"), "witness"), "manifest-tops")
    return block_witnesses(placed, descended(rounds, tops)).select(
        F.col("key").cast(docs.schema[key].dataType).alias(key), F.col("hash").alias("leaf"), F.coalesce("changed", "hash").alias("changed_leaf"),
        "index", F.substring("top", 1, 64).alias("subroot"), F.substring("top", 65, 64).alias("root"), "witness")


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def verified(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of the witnesses, and whether each leaf as it is now leads to the root."""
    end = folded(F.col("changed_leaf"), F.col("witness"))
    return found.select(key, "leaf", "subroot", "root", proof(F.col("witness")).alias("proof_sha256"), end.alias("folded_root"), (end == F.col("root")).alias("verified"))
