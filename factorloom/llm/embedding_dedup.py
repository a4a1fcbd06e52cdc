"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a key of concatenated random hashes.  A hash is the one of
``DIRECTIONS`` random directions, or its opposite, that the vector lies nearest to, as seen from the mean of
its label, so that it also divides labels whose vectors all point the same way.  Vectors are
ordered lexicographically by key; each is compared with the neighbours in its window, a block of
``BLOCK`` places and the first ``OVERLAP`` of the next one.  Places are counted over the whole order,
so windows do not depend on partitions.  Pairs of at least ``THRESHOLD`` cosine (double precision)
join.  ``PASSES`` passes are a round; rounds follow, with new hashes, until one joins nothing that was not
joined before, so a label that is large or dense gets as many as it takes.

Within a component all pairs are then compared, block by block, so that the number of links is exact
and does not depend on windows.  Equal vectors of one label are collapsed first and count as links of each
other.  Only keys are sorted; a vector travels once for each pass and window.

Undefined cases: a vector without label or id, a null or empty one, one of zeros only, or one with a
null or non-finite component links with nothing; labels are equal if they are the same as text; vectors
of different length are not compared; rows that share an id share a component; repeated rows are
copies of each other.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.frames import components, fresh, placed
from factorloom.session import materialize

THRESHOLD = 0.98
PASSES = 6                # of a round
HASHES, DIRECTIONS = 4, 32
BLOCK = 1024
OVERLAP = 128


def _digested(batches):
    """Which vectors can be compared, and a digest of their components."""
    for batch in batches:
        digests = []
        for vector in batch.column(2).to_pylist():
            v = np.array([np.nan] if not vector else [np.nan if x is None else x for x in vector], np.float64)
            fit = np.isfinite(v).all() and v.any()
            digests.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if fit else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())],
                                         ["id", "label", "vector", "digest"])


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Unit vectors; components are scaled by the largest first, so squares stay finite."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _sums(batches):
    """The sum of the unit vectors of each label and length in a batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        names, sizes = np.array(table["label"].to_pylist(), object), table["size"].to_numpy()
        rows = []
        for label, size in sorted(set(zip(names.tolist(), sizes.tolist()))):
            own = np.flatnonzero((names == label) & (sizes == size))
            unit = _matrix(table["vector"].combine_chunks().take(pa.array(own)), size)
            rows.append((label, size, len(own), unit.sum(axis=0)))
        labels, sizes_, counts, sums = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([
            pa.array(labels, pa.string()), pa.array(sizes_, pa.int32()), pa.array(counts, pa.int64()),
            pa.array(list(sums), pa.list_(pa.float64()))], ["label", "size", "n", "sums"])


def _mean(group: pa.Table) -> pa.Table:
    total = np.sum([np.array(x) for x in group["sums"].to_pylist()], axis=0) / sum(group["n"].to_pylist())
    return pa.table({"label": group["label"][:1], "size": group["size"][:1],
                     "centre": pa.array([total], pa.list_(pa.float64()))})


def _keyed(first: int, passes: int):
    """The keys of each vector in ``passes`` passes from ``first`` on."""
    def run(batches):
        for batch in batches:
            node, sizes, vectors, centres = (batch.column(k) for k in range(4))
            sizes = sizes.to_numpy(zero_copy_only=False)
            keys: list = [None] * batch.num_rows
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                at = pa.array(rows)
                centre = centres.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                apart = _matrix(vectors.take(at), size) - centre
                made = []
                for p in range(first, first + passes):
                    random = np.random.default_rng([p, size])
                    seen = (apart @ random.standard_normal((size, HASHES * DIRECTIONS))).reshape(len(rows), HASHES, DIRECTIONS)
                    nearest = np.abs(seen).argmax(axis=2)
                    side = np.take_along_axis(seen, nearest[:, :, None], 2)[:, :, 0] < 0
                    line = (apart @ random.standard_normal((size, 1))).astype(np.float32).view(np.uint32)[:, 0]
                    line = np.where(line >> 31, ~line, line | np.uint32(1 << 31))  # sorts like the number
                    made.append(np.concatenate(((nearest * 2 + side).astype(np.uint8),
                                                line.astype(">u4")[:, None].view(np.uint8)), axis=1))
                for k, row in enumerate(rows.tolist()):
                    keys[row] = [m[k].tobytes() for m in made]
            yield pa.RecordBatch.from_arrays([node, batch.column(4), batch.column(1), pa.array(keys, pa.list_(pa.binary()))],
                                             ["node", "label", "size", "keys"])
    return run


def _joined(threshold: float):
    """Compares all vectors of a window; each that links with others is joined with the smallest of its part."""
    def run(group: pa.Table) -> pa.Table:
        ids = group["node"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        unit = _matrix(group["vector"].combine_chunks(), group["size"][0].as_py())[order]
        linked = unit @ unit.T >= threshold
        part = np.full(len(ids), -1)
        for k in np.flatnonzero(linked.sum(axis=1) > linked.diagonal()).tolist():
            if part[k] < 0:  # spreads from the smallest
                reached = np.array([k])
                part[k] = k
                while len(reached):
                    reached = np.flatnonzero(linked[reached].any(axis=0) & (part < 0))
                    part[reached] = k
        apart = np.flatnonzero((part >= 0) & (part != np.arange(len(ids))))
        return pa.table({"a": pa.array(ids[part[apart]]), "b": pa.array(ids[apart])})
    return run


def passes_of(nodes: DataFrame, centres: DataFrame, first: int, passes: int, threshold: float,
              block: int, overlap: int) -> DataFrame:
    """``a`` and ``b`` of nodes that the passes from ``first`` on join."""
    seen = nodes.join(centres, ["label", "size"]).select("node", "size", "vector", "centre", "label")
    keyed = seen.mapInArrow(_keyed(first, passes), "node long, label string, size int, keys array<binary>")
    rows = keyed.select("node", "label", "size", F.posexplode("keys").alias("pass", "key")).select(
        "node", "key", F.concat_ws("/", F.col("pass").cast("string"), F.col("size").cast("string"), "label").alias("tree"))
    at = placed(rows, "key", "node")
    own = F.floor(F.col("pos") / block)
    windows = F.when((F.col("pos") % block < overlap) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    spread = at.select("node", "tree", F.explode(windows).alias("window"))
    return (spread.join(nodes.select("node", "size", "vector"), "node").groupBy("tree", "window")
            .applyInArrow(_joined(threshold), "a long, b long").distinct())


def all_passes(nodes: DataFrame, threshold: float, passes: int, block: int, overlap: int) -> DataFrame:
    """``node`` and ``component`` of nodes with links, from rounds of passes until one joins nothing new."""
    centres = materialize(nodes.select("label", "size", "vector").mapInArrow(
        _sums, "label string, size int, n long, sums array<double>").groupBy("label", "size").applyInArrow(
        _mean, "label string, size int, centre array<double>"), "centres")
    known = materialize(components(passes_of(nodes, centres, 0, passes, threshold, block, overlap), "a", "b"), "components")
    first = passes
    while True:
        links = passes_of(nodes, centres, first, passes, threshold, block, overlap)
        part = [known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")) for c in "ab"]
        a, b = (F.coalesce(f"{c}_part", c) for c in "ab")
        new = materialize(links.join(part[0], "a", "left").join(part[1], "b", "left")
                          .select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
                          .where("low <> high").distinct(), "new-links")
        if new.isEmpty():
            return known
        merged = components(new, "low", "high").select(F.col("node").alias("component"), F.col("component").alias("under"))
        nodes_now = known.unionByName(new.select(F.explode(F.array("low", "high")).alias("node")).distinct().join(
            known.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
        known = materialize(nodes_now.join(merged, "component", "left").select(
            "node", F.coalesce("under", "component").alias("component")), "components")
        first += passes


def _degrees(threshold: float):
    """For each vector of block i (and j) the vectors of the other block it links with."""
    def run(group: pa.Table) -> pa.Table:
        ids, block = group["node"].to_numpy(), group["block"].to_numpy()
        copies = group["copies"].to_numpy().astype(np.float64)
        unit = _matrix(group["vector"].combine_chunks(), group["size"][0].as_py())
        one, two = (np.flatnonzero(block == group[c][0].as_py()) for c in ("i", "j"))
        linked = (unit[one] @ unit[two].T >= threshold).astype(np.float64)
        if group["i"][0].as_py() == group["j"][0].as_py():
            np.fill_diagonal(linked, 0)
            n = linked @ copies
            return pa.table({"node": ids[one], "n": n.astype(np.int64)})
        return pa.table({"node": np.concatenate((ids[one], ids[two])),
                         "n": np.concatenate((linked @ copies[two], copies[one] @ linked)).astype(np.int64)})
    return run


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         threshold: float = THRESHOLD, passes: int = PASSES, block: int = BLOCK,
         overlap: int = OVERLAP) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    element = F.col(vector).cast("array<double>")
    rows = materialize(df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                                 element.alias("vector"))
                       .mapInArrow(_digested, "id long, label string, vector array<double>, digest binary"), "vectors")
    usable = rows.where("id IS NOT NULL AND label IS NOT NULL AND digest IS NOT NULL")
    copies = usable.groupBy("label", "digest").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = materialize(
        usable.join(copies, ["label", "digest"]).where("id = node").dropDuplicates(["label", "digest"])
        .select("node", "label", F.size("vector").alias("size"), "vector", "copies"), "nodes")
    joined = all_passes(nodes.drop("copies"), threshold, passes, block, overlap)
    sizes = joined.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = nodes.join(joined.join(sizes, "component"), "node").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", "label", "size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "copies", "vector")
    degrees = (paired.groupBy("component", "label", "size", "i", "j")
               .applyInArrow(_degrees(threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")))
    found = copies.join(degrees, "node", "left").join(joined, "node", "left").select(
        "label", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "node").alias("component"))
    alone = rows.where("id IS NULL OR label IS NULL OR digest IS NULL").select(
        "id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    every = usable.select("id", "label", "digest").join(found, ["label", "digest"]).select("id", "n", "component")
    return every.union(alone).select(
        F.col("id").alias(key), F.col("n").alias(fresh(df.select(key), "n_links")), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
