"""Merkle manifest of a dataset, with a proof for every row, by butterfly exchange.

Rows are leaves. The leaves of one part (a language, say) ascend by id; every ``fanout`` consecutive nodes
(a last run may be shorter, even of one) become the digest of their concatenation until one node is left, the
part's subroot. The subroots, ordered by part, make the root in the same way.

Leaves are dealt into aligned blocks of ``fanout ** block_levels``, each of which hashes its own subtree. Then blocks
swap subtree roots, round by round: in round r the blocks that stand at the same seat of ``fanout`` neighbouring
subtrees of ``fanout ** r`` blocks form a group. Each member receives the roots of the others, appends them to its proof
and hashes the parent itself, so all blocks reach the root with their upper proofs and no pass goes back down.
Rounds over the parts follow in the same way. A subtree of fewer blocks sends its root to the seats that it lacks.

A block is the largest thing held at once: no group is larger than ``fanout`` roots, whatever the data. Texts are read
once and never shuffled. Every round is a written table, so a lost executor costs no earlier round. The table of
parts (one row each) is numbered in one task.

Defined results: null fields count as ``-``; a null part comes first; null ids come first in their part; equal ids
ascend by leaf, and equal rows have equal leaves at places of their own; an empty table gives no
rows; only the columns named are read, so that clashing names do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

_LEVEL = "struct<before:string,after:string>"
_ARROW_LEVEL = pa.struct([("before", pa.string()), ("after", pa.string())])


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields: each ``-`` if null, else its UTF-8 bytes' count, a colon and the value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(c) for c in fields]).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda node, level: F.sha2(
        F.concat(level["before"], node, level["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, level by level and left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["before"], s["after"]))).cast("binary"), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _parents(nodes: list[str], fanout: int) -> list[str]:
    return [_digest("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]


def _subtree(leaves: list[str], fanout: int, levels: int, whole: bool) -> list[list[str]]:
    """The levels of a block's subtree: ``levels`` steps up, or for a block that is a ``whole`` part until one node is left."""
    out = [leaves]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        out.append(_parents(out[-1], fanout))
    return out


def _local_proofs(tree: list[list[str]], fanout: int) -> pa.ListArray:
    """Each leaf's levels inside its block."""
    before, after, first = [], [], [0]
    for nodes in tree[:-1]:
        for i in range(len(nodes)):
            run = i - i % fanout
            before.append("".join(nodes[run:i]))
            after.append("".join(nodes[i + 1:run + fanout]))
        first.append(len(before))
    n, depth = len(tree[0]), len(tree) - 1
    at = np.arange(n)[:, None] // fanout ** np.arange(depth, dtype=np.int64) + np.array(first[:-1], np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(_ARROW_LEVEL))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * depth, pa.int32()), pairs.take(pa.array(at.ravel())))


def _build(fanout: int, levels: int, names: list[str], types: list[pa.DataType]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        whole = table.column("n_leaves")[0].as_py() <= fanout ** levels
        tree = _subtree(table.column("leaf").to_pylist(), fanout, levels, whole)
        values = [table.column("part")[0].as_py(), table.column("block")[0].as_py(), table.column("id").to_pylist(),
                  tree[0], table.column("other").to_pylist(), tree[-1][0]]
        return pa.table({n: pa.array([v], t) for n, v, t in zip(names, values, types)})
    return run


def _expand(fanout: int, levels: int):
    """Task function: the rows of blocks with their whole proofs."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                leaves = row.column("leaves").flatten()
                n = len(leaves)
                tree = _subtree(leaves.to_pylist(), fanout, levels, row.column("whole")[0].as_py())
                same = pa.array(np.zeros(n, np.int64))
                yield pa.record_batch(
                    [row.column("ids").flatten(), leaves, row.column("others").flatten(), _local_proofs(tree, fanout),
                     row.column("upper").take(same), row.column("subroot").take(same), row.column("root").take(same)],
                    names=["id", "leaf", "other", "local", "upper", "subroot", "root"])
    return run


def _swap(state: DataFrame, group: list[Column], fanout_place: Column, seat: Column, size: Column, seats: Column) -> DataFrame:
    """One round: blocks at one seat of neighbouring subtrees exchange their roots and hash the parent.

    ``fanout_place``: the subtree's place in its group; ``seat``: the block's place in its subtree of ``size``
    blocks, ``seats``: the largest size in the group. A smaller subtree's blocks also serve the seats that it lacks.
    """
    mine = F.struct(*[F.col(c) for c in state.columns])
    sent = state.select(*[g.alias(f"g{i}") for i, g in enumerate(group)], fanout_place.alias("place"), seat.alias("own"), mine.alias("m"),
                        F.explode(F.sequence(seat, seats - 1, size)).alias("seat"))
    members = F.when(F.col("seat") == F.col("own"), F.struct("place", "m"))
    met = sent.groupBy(*[f"g{i}" for i in range(len(group))], "seat").agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("m.node").alias("node")))).alias("roots"),
        F.collect_list(members).alias("members"))
    got = met.select("roots", F.explode("members").alias("x")).select("roots", "x.place", "x.m.*")

    def side(keep):
        return F.concat_ws("", F.transform(F.filter("roots", keep), lambda r: r["node"]))

    before, after = side(lambda r: r["place"] < F.col("place")), side(lambda r: r["place"] > F.col("place"))
    got = got.withColumns({"before": before, "after": after})
    new = {"node": F.sha2(F.concat("before", "node", "after").cast("binary"), 256),
           "upper": F.concat("upper", F.array(F.struct("before", "after")))}
    return got.select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns])


def prove(rows: DataFrame, fanout: int = 2, block_levels: int = 12) -> DataFrame:
    """id, leaf, other, proof, subroot and root of every row of ``rows`` (part, id, leaf and other, a digest carried along).

    ``proof``: for each level the siblings before and after, as concatenated digests.
    """
    if fanout < 2 or block_levels < 0:
        raise ValueError("a fanout of at least 2 and no negative number of levels")
    spark, wide = rows.sparkSession, fanout ** block_levels
    id_type = rows.schema["id"].dataType
    # a null part sorts before all others
    part = F.when(F.col("part").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("part").cast("string")))
    leaves = written(rows.select(part.alias("part"), "id", "leaf", "other").withColumn("tie", F.monotonically_increasing_id()), "leaves")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["part", "id", "leaf", "tie"]
    ranged = leaves.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("tie")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")

    task = F.shiftright("at", 33).alias("task")
    counts = ranged.groupBy("part", task).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n_leaves")).withColumn(
        "n_blocks", F.ceil(F.col("n_leaves") / F.lit(wide)).cast("long"))
    over = Window.orderBy("part")
    parts = written(parts.select(
        "*", (F.row_number().over(over) - 1).cast("long").alias("pos"),
        (F.sum("n_blocks").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_blocks")).alias("base")), "parts")
    size = parts.agg(F.count(F.lit(1)).alias("parts"), F.max("n_blocks").alias("blocks")).first()

    placed = ranged.withColumn("task", task).join(counts.join(parts.select("part", "n_leaves"), "part"), ["part", "task"])
    placed = placed.withColumn("idx", F.col("at") - F.col("first") + F.col("start")).withColumn(
        "block", F.expr(f"idx div {wide}")).select("part", "block", "idx", "id", "leaf", "other", "n_leaves")
    block_schema = T.StructType([
        T.StructField("part", T.StringType()), T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("leaves", T.ArrayType(T.StringType())), T.StructField("others", T.ArrayType(T.StringType())),
        T.StructField("node", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(block_schema)
    blocks = written(placed.groupBy("part", "block").applyInArrow(
        _build(fanout, block_levels, arrow.names, arrow.types), block_schema), "blocks")

    state = blocks.select("part", "block", "node", F.array().cast(f"array<{_LEVEL}>").alias("upper")).join(
        parts.select("part", "pos", "n_blocks", "base"), "part")
    width = 1
    while width < (size["blocks"] or 0):  # subtrees of ``width`` blocks, inside the parts
        state = written(state, "swap") if width == 1 else state
        tree, count = F.expr(f"block div {width}"), F.col("n_blocks")
        group = F.expr(f"block div {width * fanout}")
        left = count - group * (width * fanout)
        open_ = state.where(count > width)
        state = written(_swap(
            open_, [F.col("part"), group], tree % fanout, F.col("block") % width,
            F.least(F.lit(width), count - tree * width), F.least(F.lit(width), left)).unionByName(state.where(count <= width)), "swap")
        width *= fanout
    state = state.withColumn("subroot", F.col("node"))
    width = 1
    while width < size["parts"]:  # subtrees of ``width`` parts
        ranks = parts.withColumn("tree", F.expr(f"pos div {width}")).withColumn("group", F.expr(f"tree div {fanout}"))
        trees = ranks.groupBy("group", "tree").agg(F.min("base").alias("tree_base"), F.sum("n_blocks").alias("tree_size"))
        trees = trees.withColumn("seats", F.max("tree_size").over(Window.partitionBy("group")))
        columns = state.columns
        joined = state.withColumn("tree", F.expr(f"pos div {width}")).join(trees, "tree")
        tmp = joined.select("*", (F.col("base") + F.col("block") - F.col("tree_base")).alias("seat0"))
        state = written(_swap(tmp, [F.col("group")], F.col("tree") % fanout, F.col("seat0"), F.col("tree_size"),
                              F.col("seats")).select(*columns), "swap")
        width *= fanout
    upper = state.select("part", "block", "upper", "subroot", F.col("node").alias("root"),
                         (F.col("n_blocks") == 1).alias("whole"))
    out = T.StructType([T.StructField("id", id_type), *[T.StructField(c, T.StringType()) for c in ("leaf", "other")],
                        T.StructField("local", upper.schema["upper"].dataType), upper.schema["upper"],
                        upper.schema["subroot"], upper.schema["root"]])
    rows = blocks.select("part", "block", "ids", "leaves", "others").join(upper, ["part", "block"]).mapInArrow(
        _expand(fanout, block_levels), out)
    return rows.select("id", "leaf", "other", F.concat("local", "upper").alias("proof"), "subroot", "root")
