"""A Merkle manifest of a dataset, with a witness for every row.

Each row is a leaf; the leaves of a tree (a source) ascend by their key, and every ``FAN``
consecutive nodes hash to one of the next level until one remains.  The trees' roots, ordered
by tree, are the leaves of one more tree, whose root stands for the dataset.

Trees grow by appending.  A node that is appended to an open run gets a partial witness, the
siblings before it; siblings that complete later extend it on the other side, and when the
run is complete its hash is appended one level up, where the same happens to all leaves below.
Aligned blocks of ``FAN ** LEVELS`` leaves are appended in tasks of their own; their roots are a table
of nodes, appended further in the same way until each tree has one.  On the way back every
block gets the witness of its root and extends those of its leaves by it, so a task holds one block however
large a tree is, and the number of rounds is the logarithm of the largest tree to the base of a block.

Places in a tree come from one shuffle by ranges of (tree, key, hash) and counts per range.

Undefined cases: a null field is hashed as ``-``; a null tree comes first and differs from the
empty one; a null key comes first in its tree; rows that share tree and key are ordered by their
hash, so equal rows are leaves of their own; a tree of one leaf has it as root, and the
witness of an only row is empty.  A row whose key is null is not among those tampered with.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.frames import placed, quoted
from factorloom.session import materialize

FAN = 16
LEVELS = 3                     # of a block, which has FAN ** LEVELS leaves
BLOCK = FAN ** LEVELS

_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_WITNESS = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """A growing tree: the open run of each level, and the witness of every leaf so far.

    A witness is a list of (hashes before, hashes after), from the leaf's run upwards.
    """

    def __init__(self, fan: int = FAN):
        self.fan = fan
        self.open: list[list[tuple[str, range]]] = [[]]   # the nodes of a run, and the leaves below each
        self.appended = [0]
        self.witnesses: list[list[list[str]]] = []

    def append(self, leaf: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._add(0, leaf, range(at, at + 1))

    def _add(self, level: int, node: str, leaves: range) -> None:
        if level == len(self.open):
            self.open.append([])
            self.appended.append(0)
        run = self.open[level]
        before = "".join([n for n, _ in run])
        for leaf in leaves:
            self.witnesses[leaf].append([before, ""])  # partial: what comes later is not known yet
        run.append((node, leaves))
        self.appended[level] += 1
        if len(run) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [n for n, _ in run]
        for k, (_, leaves) in enumerate(run):
            after = "".join(nodes[k + 1:])
            for leaf in leaves:
                self.witnesses[leaf][level][1] = after
        self._add(level + 1, digest("".join(nodes)), range(run[0][1].start, run[-1][1].stop))

    def close(self, levels: int | None = None) -> str:
        """Completes ``levels`` levels, or as many as leave one node, and returns that node."""
        level = 0
        while level < levels if levels is not None else self.appended[level] > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        for witness in self.witnesses:
            del witness[level:]
        return self.open[level][0][0]


def levels_of(size: int) -> int | None:
    """How many levels a block of a tree of ``size`` nodes takes: all of its own, or, where the tree
    goes on beside it, those of a whole block."""
    return LEVELS if size > BLOCK else None


def _grown(group: pa.Table) -> tuple[pa.Table, Tree, str]:
    group = group.sort_by("pos")
    tree = Tree()
    for node in group["node"].to_pylist():
        tree.append(node)
    return group, tree, tree.close(levels_of(group["size"][0].as_py()))


def _block_root(group: pa.Table) -> pa.Table:
    group, _, root = _grown(group)
    return pa.table({"tree": group["tree"][:1],
                     "pos": pa.array([group["pos"][0].as_py() // BLOCK], pa.int64()),
                     "size": pa.array([-(-group["size"][0].as_py() // BLOCK)], pa.int64()),
                     "node": pa.array([root], pa.string())})


def _extended(extra: list[str]):
    """Witnesses of a block's nodes, extended by that of its root."""
    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        if not group.num_rows or not above.num_rows:
            return None
        group, tree, _ = _grown(group)
        further = [(s["left"], s["right"]) for s in above["witness"][0].as_py()]
        steps = [step for w in tree.witnesses for step in (*w, *further)]
        ends = [0]
        for w in tree.witnesses:
            ends.append(ends[-1] + len(w) + len(further))
        flat = pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)],
                                          fields=list(_STEP))
        n = group.num_rows
        same = {c: pa.array([above[c][0].as_py()] * n, pa.string()) for c in ("subroot", "root")}
        return pa.table({"tree": group["tree"], "pos": group["pos"], "node": group["node"],
                         **{c: group[c] for c in extra},
                         "witness": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), **same})
    return run


def _block_of(pos: str) -> Column:
    return F.shiftright(pos, (BLOCK - 1).bit_length()).alias("block")


def _lifted(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the roots of their blocks, and so on to one node for each tree."""
    levels, size = [nodes], nodes.agg(F.max("size")).first()[0] or 1
    while len(levels) == 1 or size > 1:
        here = levels[-1].select("tree", "pos", "size", "node")
        levels.append(materialize(here.groupBy("tree", _block_of("pos")).applyInArrow(
            _block_root, "tree string, pos long, size long, node string"), "roots"))
        size = -(-size // BLOCK)
    return levels


def _lowered(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first level's nodes with their witnesses; ``above`` has those of the last."""
    for nodes in reversed(levels[:-1]):
        extra = [c for c in nodes.columns if c not in ("tree", "pos", "size", "node")]
        kinds = [f"{c} {nodes.schema[c].dataType.simpleString()}" for c in extra]
        layout = ", ".join(["tree string, pos long, node string", *kinds,
                            f"witness {_WITNESS}, subroot string, root string"])
        above = (nodes.groupBy("tree", _block_of("pos")).cogroup(above.groupBy("tree", F.col("pos").alias("block")))
                 .applyInArrow(_extended(extra), layout))
    return above


def manifest(leaves: DataFrame) -> DataFrame:
    """``tree``, ``pos``, ``node``, any other columns, ``witness``, ``subroot`` and ``root`` of each leaf.

    ``leaves`` has ``tree`` (string, not null), ``key_`` and ``node`` (the hash), and other columns.
    """
    low = _lifted(placed(leaves, "key_", "node"))
    subroots = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    top = _lifted(placed(subroots, "name"))
    begin = top[-1].select("tree", "pos", F.array().cast(_WITNESS).alias("witness"),
                           F.col("node").alias("subroot"), F.col("node").alias("root"))
    above = _lowered(top, begin).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "witness",
        F.col("node").alias("subroot"), "root")
    return _lowered(low, above)


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def tree_name(column: Column) -> Column:
    """A string that sorts like ``column``, null first, and is never null."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def proof(witness: Column) -> Column:
    """The hash of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def audited(df: DataFrame, key: str = "doc_id", tree: str = "source", text: str = "text",
            fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), every: int = 5) -> DataFrame:
    """The manifest of ``df``, and a trial of it: rows whose CRC-32 of the key ``every`` divides have the
    letters A to Z of their text lower-cased, and are verified by the untampered witness."""
    columns = [F.col(quoted(c)) for c in fields]
    lower = F.translate(F.col(quoted(text)), string.ascii_uppercase, string.ascii_lowercase)
    tampered = [lower if c == text else F.col(quoted(c)) for c in fields]
    hit = F.coalesce(F.pmod(F.crc32(F.col(quoted(key)).cast("string")), F.lit(every)) == 0, F.lit(False))
    rows = df.select(tree_name(F.col(quoted(tree))).alias("tree"), F.col(quoted(key)).cast("long").alias("key_"),
                     leaf_hash(columns).alias("node"), F.when(hit, leaf_hash(tampered)).alias("tampered"))
    found = manifest(rows)
    root = folded(F.coalesce("tampered", "node"), F.col("witness"))
    return found.select(F.col("key_").alias(key), F.col("node").alias("leaf"), "subroot", "root",
                        proof(F.col("witness")).alias("proof_sha256"), root.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
