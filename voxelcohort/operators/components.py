"""Connected components and hole filling on sparse masks ``(case_id, z, y, x)``.

Voxels shrink to horizontal runs and runs to a graph of touching runs. Links inside one
block of lines are solved block by block (a block is bounded, whatever the case size);
what remains is the small graph between blocks, solved by parent hooking with pointer
jumping: a logarithmic number of rounds, each a few equi-joins. A component is named by
its first voxel in raster order (``pack_voxel``). 2-D images use a constant ``z``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelcohort.functions import pack_voxel, unpack_voxel
from voxelcohort.session import cut_lineage, small_side

BLOCK_Z_BITS, BLOCK_Y_BITS = 4, 6  # a block holds 16 slices by 64 rows of lines
LINKS_PER_BATCH = 250_000  # about this many links meet in one task call
X_BIN = 32  # runs meet inside bins of this width, so a line never yields all its run pairs

# Forward line offsets (dz, dy) with the reach along x, per connectivity.
LINE_OFFSETS = {
    4: [(0, 1, 0)],
    8: [(0, 1, 1)],
    6: [(0, 1, 0), (1, 0, 0)],
    18: [(0, 1, 1), (1, 0, 1), (1, 1, 0), (1, -1, 0)],
    26: [(0, 1, 1), (1, 0, 1), (1, 1, 1), (1, -1, 1)],
}


def to_runs(mask: DataFrame) -> DataFrame:
    """Maximal runs ``(case_id, z, y, x0, x1, run)`` of each line; ``run`` is the packed start."""
    line = W.partitionBy("case_id", "z", "y").orderBy("x")
    return (
        mask.select("case_id", "z", "y", "x")
        .withColumn("_island", F.col("x") - F.dense_rank().over(line))
        .groupBy("case_id", "z", "y", "_island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_island")
        .withColumn("run", pack_voxel(F.col("z"), F.col("y"), F.col("x0")))
    )


def runs_to_voxels(runs: DataFrame) -> DataFrame:
    """Back to one row per voxel, other columns kept."""
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1", "run")


def touching_runs(runs: DataFrame, connectivity: int) -> DataFrame:
    """Pairs ``(case_id, a, b)`` of runs that touch; each pair once."""
    offsets = F.array(*[
        F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(reach).alias("reach"))
        for dz, dy, reach in LINE_OFFSETS[connectivity]
    ])
    bin_of = lambda c: F.floor(c / F.lit(X_BIN))
    left = (
        runs.select("case_id", "z", "y", "x0", "x1", F.col("run").alias("a"), F.explode(offsets).alias("_o"))
        .select(
            "case_id", (F.col("z") + F.col("_o.dz")).alias("z"), (F.col("y") + F.col("_o.dy")).alias("y"),
            (F.col("x0") - F.col("_o.reach")).alias("lo"), (F.col("x1") + F.col("_o.reach")).alias("hi"), "a",
        )
        .withColumn("_bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi")))))
    )
    right = runs.select("case_id", "z", "y", "x0", "x1", F.col("run").alias("b")).withColumn(
        "_bin", F.explode(F.sequence(bin_of(F.col("x0")), bin_of(F.col("x1"))))
    )
    overlap = (F.col("x0") <= F.col("hi")) & (F.col("x1") >= F.col("lo"))
    first_shared_bin = F.col("_bin") == bin_of(F.greatest("lo", "x0"))
    return left.join(right, ["case_id", "z", "y", "_bin"]).where(overlap & first_shared_bin).select("case_id", "a", "b")


def _minimum_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a link list and the smallest node each can reach (hooking on arrays)."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u):]
    parent = np.arange(len(nodes))
    while True:
        grand = parent[parent]
        best = grand.copy()
        np.minimum.at(best, a, grand[b])
        np.minimum.at(best, b, grand[a])
        moved = np.minimum(parent, best)
        np.minimum.at(moved, parent, best)
        if np.array_equal(moved, parent):
            return nodes, nodes[parent]
        parent = moved


def _solve_links(links: pd.DataFrame) -> pd.DataFrame:
    """Labels of a batch of blocks; nodes of different cases never mix."""
    codes, cases = pd.factorize(links["case_id"])
    ids, index = np.unique(np.concatenate([links["a"], links["b"]]), return_inverse=True)
    keyed = np.concatenate([codes, codes]).astype("int64") * len(ids) + index
    nodes, labels = _minimum_labels(keyed[: len(links)], keyed[len(links):])
    return pd.DataFrame({"case_id": cases[nodes // len(ids)], "node": ids[nodes % len(ids)], "label": ids[labels % len(ids)]})


def connected_labels(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node that has an edge: ``(case_id, node, label)``.

    Nodes are packed run starts. Links within a block of lines are contracted first, whole
    blocks batched by hash so that the number of batches grows with the links; only links
    between blocks enter the distributed rounds.
    """
    block = lambda c: F.struct(
        F.shiftright(c, 2 * 21 + BLOCK_Z_BITS).alias("zb"),
        F.shiftright(c, 21).bitwiseAND((1 << 21) - 1).bitwiseAND(-(1 << BLOCK_Y_BITS)).alias("yb"),
    )
    links = cut_lineage(
        edges.where("a <> b").withColumn("_block", block(F.col("a"))).withColumn("_inside", F.col("_block") == block(F.col("b")))
    )
    inside = links.where("_inside")
    spread = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches = max(spread, -(-inside.count() // LINKS_PER_BATCH))
    case_type = edges.schema["case_id"].dataType.simpleString()
    local = cut_lineage(
        inside.select("case_id", "a", "b", F.pmod(F.hash("case_id", "_block"), F.lit(batches)).alias("_batch"))
        .groupBy("_batch")
        .applyInPandas(_solve_links, f"case_id {case_type}, node long, label long")
    )
    between = links.where("not _inside").select("case_id", "a", "b")
    if between.isEmpty():
        return local
    for end in ("a", "b"):
        named = local.select("case_id", F.col("node").alias(end), F.col("label").alias("_to"))
        between = between.join(named, ["case_id", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    merged = _hook_rounds(between.where("a <> b").distinct())
    renamed = local.join(merged.select("case_id", F.col("node").alias("label"), F.col("label").alias("_to")), ["case_id", "label"], "left")
    contracted = renamed.select("case_id", "node", F.coalesce("_to", "label").alias("label"))
    return contracted.unionByName(merged.join(local.select("case_id", "node"), ["case_id", "node"], "left_anti"))


def _hook_rounds(edges: DataFrame) -> DataFrame:
    """Distributed hooking until no parent moves.

    A giant component concentrates parents on one label; that side of the join is the
    one adaptive execution splits, and the minimum per parent is combined map-side.
    """
    links = cut_lineage(
        edges.where("a <> b").select("case_id", F.explode(F.array(
            F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
            F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
        )).alias("_l")).select("case_id", "_l.u", "_l.v")
    )
    parents = links.groupBy("case_id", F.col("u")).agg(F.least(F.col("u"), F.min("v")).alias("p"))
    parents = cut_lineage(parents)
    while True:
        up = parents.select("case_id", F.col("u").alias("p"), F.col("p").alias("g"))
        state = parents.join(up, ["case_id", "p"])
        best = (
            links.join(state.select("case_id", F.col("u").alias("v"), "g"), ["case_id", "v"])
            .groupBy("case_id", "u")
            .agg(F.min("g").alias("m"))
        )
        moves = F.array(
            F.struct(F.col("u").alias("u"), F.least("p", "g", "m").alias("to"), F.col("p").alias("old")),
            F.struct(F.col("p").alias("u"), F.col("m").alias("to"), F.lit(None).cast("long").alias("old")),
        )
        parents = cut_lineage(
            state.join(best, ["case_id", "u"])
            .select("case_id", F.explode(moves).alias("_m"))
            .groupBy("case_id", F.col("_m.u").alias("u"))
            .agg(F.min("_m.to").alias("p"), F.max("_m.old").alias("old"))
        )
        if parents.where("p <> old").isEmpty():
            return parents.select("case_id", F.col("u").alias("node"), F.col("p").alias("label"))
        parents = parents.drop("old")


def label_runs(runs: DataFrame, connectivity: int) -> DataFrame:
    """Runs with their ``component``."""
    runs = cut_lineage(runs)
    labels = connected_labels(touching_runs(runs, connectivity)).withColumnRenamed("node", "run")
    return runs.join(labels, ["case_id", "run"], "left").withColumn(
        "component", F.coalesce("label", "run")
    ).drop("label")


def label_components(mask: DataFrame, connectivity: int = 26) -> DataFrame:
    """Foreground voxels with their component: ``(case_id, z, y, x, component)``."""
    return runs_to_voxels(label_runs(to_runs(mask), connectivity)).select("case_id", "z", "y", "x", "component")


def component_table(labels: DataFrame) -> DataFrame:
    """Per component: voxel count and first voxel in raster order."""
    z, y, x = unpack_voxel(F.col("component"))
    return labels.groupBy("case_id", "component").agg(F.count(F.lit(1)).alias("voxels")).select(
        "case_id", "component", z.alias("z"), y.alias("y"), x.alias("x"), "voxels"
    )


def background_runs(runs: DataFrame) -> DataFrame:
    """Complement of the runs inside each case's bounding box padded by one voxel.

    ``edge`` marks runs on the padding, which always belongs to the outside.
    """
    box = runs.groupBy("case_id").agg(
        *[f(c).alias(n) for f, c, n in (
            (F.min, "z", "z_lo"), (F.max, "z", "z_hi"), (F.min, "y", "y_lo"), (F.max, "y", "y_hi"),
            (F.min, "x0", "x_lo"), (F.max, "x1", "x_hi"))]
    )
    for axis in ("z", "y", "x"):
        box = box.withColumn(f"{axis}_lo", F.col(f"{axis}_lo") - 1).withColumn(f"{axis}_hi", F.col(f"{axis}_hi") + 1)
    box = small_side(box)
    slices = box.withColumn("z", F.explode(F.sequence("z_lo", "z_hi"))).repartition("case_id", "z")
    lines = slices.withColumn("y", F.explode(F.sequence("y_lo", "y_hi")))
    # A sentinel run just outside the box on the left starts the first gap of every line.
    starts = lines.select("case_id", "z", "y", (F.col("x_lo") - 1).alias("x0"), (F.col("x_lo") - 1).alias("x1"))
    joined = starts.unionByName(runs.select("case_id", "z", "y", "x0", "x1")).join(box, "case_id")
    line = W.partitionBy("case_id", "z", "y").orderBy("x0")
    gap_end = F.coalesce(F.lead("x0").over(line) - 1, F.col("x_hi"))
    on_edge = (
        (F.col("z") == F.col("z_lo")) | (F.col("z") == F.col("z_hi"))
        | (F.col("y") == F.col("y_lo")) | (F.col("y") == F.col("y_hi"))
        | (F.col("g0") == F.col("x_lo")) | (F.col("g1") == F.col("x_hi"))
    )
    # Padding may lie at index -1; shifting by one keeps packed names non-negative.
    return (
        joined.withColumn("g0", F.col("x1") + 1)
        .withColumn("g1", gap_end)
        .where("g0 <= g1")
        .select(
            "case_id", "z", "y", F.col("g0").alias("x0"), F.col("g1").alias("x1"), on_edge.alias("edge"),
            pack_voxel(F.col("z") + 1, F.col("y") + 1, F.col("g0") + 1).alias("run"),
        )
    )


def hole_runs(runs: DataFrame, face_connectivity: int = 6) -> DataFrame:
    """Background runs enclosed by the mask under face connectivity."""
    labelled = label_runs(background_runs(runs), face_connectivity)
    outside = labelled.groupBy("case_id", "component").agg(F.bool_or("edge").alias("open")).where("open")
    return labelled.join(outside.select("case_id", "component"), ["case_id", "component"], "left_anti").select(
        "case_id", "z", "y", "x0", "x1"
    )


def fill_holes(mask: DataFrame, face_connectivity: int = 6) -> DataFrame:
    """Mask plus its enclosed background."""
    runs = cut_lineage(to_runs(mask))
    filled = runs.select("case_id", "z", "y", "x0", "x1").unionByName(hole_runs(runs, face_connectivity))
    return runs_to_voxels(filled)


def largest_component(runs: DataFrame, connectivity: int) -> DataFrame:
    """Runs of each case's largest component; the first in raster order wins a tie."""
    labelled = cut_lineage(label_runs(runs, connectivity))
    sizes = labelled.groupBy("case_id", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))
    best = sizes.groupBy("case_id").agg(
        F.min_by("component", F.struct((-F.col("size")).alias("s"), F.col("component").alias("c"))).alias("component")
    )
    return labelled.join(best, ["case_id", "component"], "left_semi").select("case_id", "z", "y", "x0", "x1", "run")
