"""A Merkle manifest of a dataset: a tree of three per source, a tree of the sources' roots above, a proof per row.

Large blocks of leaves are reduced where they lie, round by round, until few nodes are left. The driver builds the
tree of those, and their paths to the root go out as a broadcast table; each block finishes the proofs of its members
from that. So the driver holds `top` nodes whatever the number of rows or sources, and rows are shuffled twice.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prefix_sums

FAN, LEVELS = 3, 6  # a block has FAN ** LEVELS members at most
_PATH = "array<struct<l: binary, r: binary>>"


def hash_of(parts: list[bytes]) -> bytes:
    """Digest (hex text, as bytes) of the parts."""
    return sha256(b"".join(parts)).hexdigest().encode()


def climb(level: list[bytes], least: int = 0) -> list[list[bytes]]:
    """A tree's levels from these nodes to a single one, at least so many above them."""
    out = [level]
    while len(level) > 1 or len(out) <= least:
        level = [hash_of(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        out.append(level)
    return out


def paths(levels: list[list[bytes]], above: list[tuple[bytes, bytes]]) -> list[list[tuple[bytes, bytes]]]:
    """For each node of the lowest level, what stands left and right of it at every level up to the root."""
    held = [above]
    for level in levels[-2::-1]:
        runs = [level[i : i + FAN] for i in range(0, len(level), FAN)]
        held = [[(b"".join(run[:k]), b"".join(run[k + 1 :])), *held[j]] for j, run in enumerate(runs) for k in range(len(run))]
    return held


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = hash_of([left, node, right])
    return node


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(_field, values)), 256)


def _rows(batch: pa.RecordBatch):
    """A batch's rows one by one, as a block may be long."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _reduced(blocks: DataFrame) -> DataFrame:
    """tree, idx, node of each block's root. Block 0 of a tree stops at a single node, as it is alone if it isn't full."""

    def run(batches):
        for batch in batches:
            roots = [climb(nodes, LEVELS if block else 0)[-1][0] for block, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.binary())], ["tree", "idx", "node"])

    return materialise(blocks.select("tree", "block", F.col("members.node").alias("nodes")).mapInArrow(run, "tree string, idx long, node binary"), "nodes")


def _blocks(nodes: DataFrame, more: list[str] = ()) -> DataFrame:
    """tree, block, members in order: FAN ** LEVELS consecutive nodes of a tree."""
    block = F.expr(f"idx div {FAN**LEVELS}").alias("block")
    members = F.array_sort(F.collect_list(F.struct("idx", "node", *more)))
    return materialise(nodes.groupBy("tree", block).agg(members.alias("members")), "blocks")


def _below(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """tree, idx, subroot, path of the members of the blocks; above has those of the blocks."""

    def run(batches):
        for batch in batches:
            for tree, block, members, subroot, path in _rows(batch):
                found = paths(climb([m["node"] for m in members], LEVELS if block else 0), [(p["l"], p["r"]) for p in path])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(members)), pa.array([m["idx"] for m in members]), pa.array([subroot] * len(members), pa.binary()), pa.array([[{"l": a, "r": b} for a, b in p] for p in found], pa.list_(pa.struct({"l": pa.binary(), "r": pa.binary()})))],
                    ["tree", "idx", "subroot", "path"],
                )

    met = blocks.join(above.withColumnRenamed("idx", "block"), ["tree", "block"])
    return met.select("tree", "block", "members", "subroot", "path").mapInArrow(run, f"tree string, idx long, subroot binary, path {_PATH}")


def _upper(nodes: list, of_sources: bool) -> tuple[bytes, list]:
    """The root and the rows (tree, idx, subroot, path) of the few nodes that are left."""
    by_tree: dict[str, list] = {}
    for row in sorted(nodes, key=lambda r: (r["tree"].encode(), r["idx"])):
        by_tree.setdefault(row["tree"], []).append(bytes(row["node"]))
    trees = {t: climb(level) for t, level in by_tree.items()}
    above = climb([levels[-1][0] for levels in trees.values()]) if not of_sources else None
    if of_sources:  # all in one tree
        (levels,) = trees.values()
        return levels[-1][0], [("", i, None, path) for i, path in enumerate(paths(levels, []))]
    rows = []
    for (tree, levels), up in zip(trees.items(), paths(above, [])):
        rows += [(tree, i, levels[-1][0], path) for i, path in enumerate(paths(levels, up))]
    return above[-1][0], rows


def _finish(blocks: DataFrame, above: DataFrame, root: bytes, keep: list) -> DataFrame:
    """A row per leaf: the proof's digest, and the root that its altered leaf folds to."""
    head = root.decode()
    schema = f"{', '.join(f'`{n}` {t}' for n, t in keep)}{', ' if keep else ''}leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    names = [n for n, _ in keep]

    def run(batches):
        for batch in batches:
            for block, members, subroot, path in _rows(batch):
                found = paths(climb([m["node"] for m in members], LEVELS if block else 0), [(p["l"], p["r"]) for p in path])
                proofs = [sha256(b"".join([x for pair in p for x in pair])).hexdigest() for p in found]
                folded = [fold(m["node"] if m["altered"] is None else m["altered"], p).decode() for m, p in zip(members, found)]
                n = len(members)
                kept = [pa.array([m["kept"][k] for m in members], t) for k, t in zip(names, types(batch))]
                rest = [[m["node"].decode() for m in members], [subroot.decode()] * n, [head] * n, proofs, folded, [f == head for f in folded]]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, rest)], [*names, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    def types(batch):
        member = batch.schema.field(1).type.value_type
        return [f.type for f in member.field("kept").type] if names else []

    met = blocks.join(above.withColumnRenamed("idx", "block"), ["tree", "block"])
    return met.select("block", "members", "subroot", "path").mapInArrow(run, schema)


def build(leaves: DataFrame, keep: list[str], top: int = 4096) -> DataFrame:
    """leaves has tree (text that orders the trees), idx (gapless from 0), node and altered (hex digests as binary; altered
    null: as node) and kept (a struct of `keep`). Result: `keep`, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = leaves.sparkSession
    lowest = _blocks(leaves, ["altered", "kept"])
    rounds, nodes, crowned = [lowest], _reduced(lowest), None
    while True:
        n, trees = nodes.agg(F.count("*"), F.count_if(F.col("idx") == 0)).first()
        if n <= top:
            break
        if n == trees and crowned is None:  # every source is down to its root: those are the nodes of one tree now
            crowned = prefix_sums(nodes.drop("idx"), [F.col("tree")], {"rank": F.lit(1)})
            crowned = materialise(crowned, "sources")
            split = len(rounds)
            nodes = crowned.select(F.lit("").alias("tree"), F.col("rank").alias("idx"), "node")
        rounds.append(_blocks(nodes))
        nodes = _reduced(rounds[-1])
    if n == 0:
        root, rows = b"", []
    else:
        root, rows = _upper(nodes.collect(), crowned is not None)  # at most `top` rows
    above = F.broadcast(spark.createDataFrame(rows, f"tree string, idx long, subroot binary, path {_PATH}"))
    for k in range(len(rounds) - 1, 0, -1):
        above = _below(rounds[k], above)
        if crowned is not None and k == split:
            above = crowned.join(above.select(F.col("idx").alias("rank"), "path"), "rank").select("tree", F.lit(0).cast("long").alias("idx"), F.col("node").alias("subroot"), "path")
    field = {f.name: f.dataType.simpleString() for f in leaves.schema["kept"].dataType} if keep else {}
    return _finish(lowest, above, root, [(c, field[c]) for c in keep])


def manifest(docs: DataFrame, columns: list[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", top: int = 4096) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf hashes the row's columns with their lengths. Where the check sum of the id is even, the row is tampered with:
    the line ends of its text are gone; folded_root is what its leaf then folds to with the proof. Rows of one id stand in
    the order of their leaves, so repeated rows change nothing; null ids come first and are not tampered with; null
    sources are a source of their own, before the others. A table without rows gives none. Other columns are ignored
    whatever their names. A text of any length is hashed in the JVM.
    """
    c = {name: F.col(f"`{name}`") for name in columns}
    shorter = [F.replace(v, F.lit("\n"), F.lit("")) if name == text_col else v for name, v in c.items()]
    tampered = (F.crc32(c[id_col].cast("string")) % 2 == 0) & F.contains(c[text_col], F.lit("\n"))
    source = c[source_col].cast("string")
    slim = docs.select(
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("tree"), c[id_col].alias("_id"), leaf(list(c.values())).cast("binary").alias("node"),
        F.when(tampered, leaf(shorter).cast("binary")).alias("altered"), F.struct(c[id_col].alias("doc_id")).alias("kept"),
    )
    placed = prefix_sums(slim, [F.col("tree"), F.col("_id"), F.col("node")], {"idx": F.lit(1)}, ["tree"])
    return build(placed.drop("_id"), ["doc_id"], top)
