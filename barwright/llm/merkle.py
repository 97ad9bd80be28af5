"""A Merkle manifest of a table: a forest of hash trees, one for each group of rows, under one root, with a proof for every row.

Nodes have coordinates (tree, level, position). The leaves of a tree are sorted into runs by range, numbered by the offsets of the runs, and
stand in ``leaves``; nodes above them stand in Parquet folders by level. A pass reads one level in order and writes the next ``BAND`` levels:
a task gets stretches of 2**BAND nodes, whose subtree it holds and no more. Proofs are read from the top down: a merge-scan by coordinate
brings together a stretch's stored nodes, the path from its top node to the root, and the nodes that want proofs, in that order.

A proof is text: a step for each level, joined by commas, from the leaf to the root. ``L`` or ``R`` and the sibling's digest say on which side
the sibling stands; ``-`` is a node without one, which is hashed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import scratch_path, stash

BAND = 10
PLACE_BITS = 33
ROWS = 4096
_NODE = "level int, tree string, pos long, n long, hash string"


def digest(*columns: Column) -> Column:
    """Hash of values: each ``-`` if null, else its UTF-8 byte count, a colon and the value; integers are decimal."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    beside = lambda step, side: F.when(F.substring(step, 1, 1) == side, F.substr(step, F.lit(2))).otherwise(F.lit(""))
    steps = F.filter(F.split(proof, ","), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(beside(s, "L"), node, beside(s, "R")), 256))


def siblings_digest(proof: Column) -> Column:
    """Hash of the siblings of a proof, one after another."""
    return F.sha2(F.translate(proof, "LR-,", ""), 256)


def _pairs(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[i : i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]


def _raise(level: int):
    """For sorted nodes of ``level``: the nodes of the levels above, up to the top of each stretch or tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def finish(tree: str, block: int, n: int, nodes: list[str]) -> None:
            for k in range(1, BAND + 1):
                if n == 1:
                    break
                nodes, n = _pairs(nodes), (n + 1) // 2
                first = block << (BAND - k)
                out.extend((level + k, tree, first + i, n, h) for i, h in enumerate(nodes))

        def packed() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["level", "tree", "pos", "n", "hash"])

        key, n, nodes = None, 0, []
        for batch in batches:
            for tree, pos, size, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (tree, pos >> BAND):
                    if key:
                        finish(*key, n, nodes)
                    key, n, nodes = (tree, pos >> BAND), size, []
                    if len(out) >= ROWS:
                        yield packed()
                        out.clear()
                nodes.append(h)
        if key:
            finish(*key, n, nodes)
        if out:
            yield packed()

    return run


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch its path (kind 0), its nodes (kind 1) and the nodes that want proofs (kind 2): those with their proofs."""
    path, top, nodes = "", "", []
    for batch in batches:
        kinds, level, pos, n, text = (batch.column(c).to_pylist() for c in ("kind", "level", "pos", "n", "text"))
        subroots = batch.column("subroot").to_pylist()
        rows, proofs, tops = [], [], []
        for i, kind in enumerate(kinds):
            if kind == 0:
                path, top, nodes = text[i], subroots[i], [{} for _ in range(BAND)]
            elif kind == 1:
                nodes[level[i]][pos[i]] = text[i]
            else:
                at, size, steps = pos[i], n[i], []
                for k in range(BAND):
                    if size == 1:
                        break
                    beside = nodes[k].get(at ^ 1)
                    steps.append("-" if beside is None else ("L" if at & 1 else "R") + beside)
                    at, size = at >> 1, (size + 1) // 2
                if path:
                    steps.append(path)
                rows.append(i)
                proofs.append(",".join(steps))
                tops.append(top)
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("payload").take(pa.array(rows)), pa.array(proofs, pa.string()), pa.array(tops, pa.string())], ["payload", "proof", "subroot"])


@dataclass
class Forest:
    """Trees in the shared folder. ``leaves``: tree, pos, n (the tree's leaves), hash and what the leaves keep. ``bands``: nodes by level, above the leaves."""

    leaves: DataFrame
    bands: list[DataFrame]

    def level(self, k: int) -> DataFrame:
        """The nodes of one level, with ``n``, how many their tree has there."""
        if k == 0:
            return self.leaves.select(F.lit(0).alias("level"), "tree", "pos", "n", "hash")
        return self.bands[(k - 1) // BAND].filter(F.col("level") == k)

    def tops(self) -> DataFrame:
        """For each tree ``n``, its leaves, and ``subroot``: the one node that remains."""
        single = [self.level(0).filter("n = 1"), *[b.filter("n = 1") for b in self.bands]]
        roots = single[0]
        for more in single[1:]:
            roots = roots.unionByName(more)
        return self.leaves.filter("pos = 0").select("tree", "n").join(roots.selectExpr("tree", "hash AS subroot"), "tree")

    def proofs(self, paths: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
        """``wanted`` (rows of ``leaves``; all if none) with ``proof`` and ``subroot``. ``paths``: tree, n, subroot and ``path``, the proof of the subroot."""
        wanted = self.leaves if wanted is None else wanted
        above = None
        for j in range(max(len(self.bands), 1) - 1, -1, -1):
            low = j * BAND
            nodes_at = lambda b: F.ceil(F.col("n") / float(1 << b * BAND))
            ends = (nodes_at(j) <= 1 << BAND) & ((nodes_at(j - 1) > 1 << BAND) if j else F.lit(True))
            tops = paths.filter(ends).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
            if above is not None:
                tops = tops.unionByName(above.select("payload.tree", F.col("payload.pos").alias("block"), F.col("proof").alias("path"), "subroot"))
            # A tree that ends at this level, or below, has nothing above it: its path comes from ``paths``, further down.
            stored = self.level(low) if j == 0 else self.level(low).filter("n > 1")
            asked = wanted if j == 0 else stored
            payload = F.struct(*[F.col(c) for c in (asked.columns if j == 0 else ("tree", "pos"))])
            if j < len(self.bands):
                stored = stored.unionByName(self.bands[j].filter(F.col("level") < low + BAND))
            nodes = stored.select("tree", F.expr(f"shiftright(pos, {low + BAND} - level)").alias("block"), (F.col("level") - low).alias("level"), "pos", "n", F.col("hash").alias("text"))
            wants = asked.select("tree", F.shiftright("pos", BAND).alias("block"), "pos", "n", payload.alias("payload"))
            stream = tops.withColumnRenamed("path", "text").withColumn("kind", F.lit(0)).unionByName(nodes.withColumn("kind", F.lit(1)), True).unionByName(wants.withColumn("kind", F.lit(2)), True)
            stream = stream.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind").select("kind", "level", "pos", "n", "text", "subroot", "payload")
            schema = f"payload {stream.schema['payload'].dataType.simpleString()}, proof string, subroot string"
            above = stream.mapInArrow(_trace, schema)
            if j:
                above = stash(above, f"paths-{j}")
        return above.select("payload.*", "proof", "subroot")


def plant(rows: DataFrame, order: list[str], path: str | None = None) -> Forest:
    """Build the trees over ``rows``: ``tree`` (not null), ``hash`` and other columns, which the leaves keep; leaves stand in the order of ``order``.

    Equal rows are counted before they are sorted and dealt out again, so no range holds more than its share of them. ``path`` is where the nodes
    stay; without it they go to the scratch folder.
    """
    path = path or scratch_path(rows.sparkSession, "merkle")
    spark, columns = rows.sparkSession, rows.columns
    each = rows.groupBy(*columns).agg(F.count("*").alias("copies_")).withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_"))))
    keys = ["tree", *order, *[c for c in columns if c not in ("tree", *order)], "copy_"]
    run = each.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns, F.monotonically_increasing_id().alias("at_"))
    run.write.parquet(f"{path}/runs")
    run = spark.read.schema(run.schema).parquet(f"{path}/runs").withColumn("part_", F.shiftright("at_", PLACE_BITS))
    parts = run.groupBy("part_", "tree").agg(F.min("at_").alias("first_"), F.count("*").alias("rows_"))
    parts = parts.selectExpr("*", "sum(rows_) OVER (PARTITION BY tree ORDER BY part_) - rows_ AS before_", "sum(rows_) OVER (PARTITION BY tree) AS n").drop("rows_")
    leaves = run.join(parts, ["part_", "tree"]).withColumn("pos", F.col("at_") - F.col("first_") + F.col("before_")).select("tree", "pos", "n", *[c for c in columns if c != "tree"])
    leaves.write.parquet(f"{path}/leaves")
    forest = Forest(spark.read.schema(leaves.schema).parquet(f"{path}/leaves"), [])
    largest = forest.leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        low = len(forest.bands) * BAND
        stretch = forest.level(low).filter("n > 1").withColumn("block", F.shiftright("pos", BAND)).repartition("tree", "block").sortWithinPartitions("tree", "pos")
        stretch.select("tree", "pos", "n", "hash").mapInArrow(_raise(low), _NODE).write.partitionBy("level").parquet(f"{path}/nodes/band={len(forest.bands)}")
        forest.bands.append(spark.read.schema(_NODE).parquet(f"{path}/nodes/band={len(forest.bands)}"))
        largest = -(-largest // (1 << BAND))
    return forest


def manifest(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", group: str = "lang", also: dict[str, Column] | None = None, path: str | None = None) -> DataFrame:
    """A leaf for each row of ``docs``, hashed over ``columns``, in the tree of its ``group``, with its proof.

    Returns a row for each row of ``docs``: ``id``, ``tree`` (``-`` for a null group, else ``=`` and the group), ``pos`` in the tree, ``n``, its
    leaves, ``leaf``, ``subroot``, ``root``, ``proof`` and the columns of ``also``, which are computed from ``docs``. Leaves ascend by id, nulls first,
    then by digest, so that repeated rows stand side by side in either order; each has a position and a proof of its own. Trees are ordered by
    group, null first, bytewise. A null in a hashed column differs from an empty text. An empty table gives an empty table. Columns that are
    neither hashed nor in ``also`` are ignored, whatever their names.
    """
    also = also or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(tree.alias("tree"), F.col(doc_id).alias("id"), digest(*[F.col(c) for c in columns]).alias("hash"), *[e.alias(f"also_{k}") for k, e in also.items()])
    forest = plant(rows, ["id", "hash"], path)
    tops = stash(forest.tops(), "subroots")
    crown = plant(tops.select(F.lit("-").alias("tree"), F.col("tree").alias("id"), F.col("subroot").alias("hash")), ["id"], path and f"{path}/crown")
    crown_top = crown.tops().withColumn("path", F.lit(""))
    steps = crown.proofs(crown_top).select(F.col("id").alias("tree"), F.col("proof").alias("path"))
    paths = stash(tops.join(steps, "tree"), "crown")
    root = crown_top.select("subroot").scalar()
    return forest.proofs(paths).select("id", "tree", "pos", "n", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "proof", *[F.col(f"also_{k}").alias(k) for k in also])


__all__ = ["Forest", "digest", "fold", "manifest", "plant", "siblings_digest"]
