"""Embedding near-dedup by a random-projection tree forest.

Vectors of equal label (and length) are compared by cosine; pairs of 0.93 or more
are linked.  A tree splits a label's vectors at the median of their projections on a
random direction, again and again, until a node holds ``LEAF`` or fewer; vectors near
a split go to both sides.  How near follows from the node: the density of its
projections at the median is measured, and the overlap is as wide as it takes to part
a pair at the threshold with a probability of ``MISS``.  A node that a split shrinks
little, as its vectors are much alike, is a leaf of any size.  Overlaps are narrow, so
trees are cheap and many: a label has as many as it takes to miss a pair at the
threshold in all of them with a probability of ``LOST``; a label that is one leaf has one.

Vectors are written once, dealt by id.  A level moves (id, node) rows only; a vector
meets all of its nodes in one row.

Equal vectors are one from the start and counted.  A leaf's members meet in blocks
(``BLOCK`` each), so that no leaf is gathered in one task; every pair is verified in
double precision and counted only in the first leaf that it shares.  A block gives
each member's number of links and a spanning forest, never its pairs.  Directions
come from a hash of the node, medians from Spark; the driver sees counts of nodes
still to split only.

Edge cases: a vector that is null, zero or has null or non-finite components, or a
null label, has no links; a null id is returned with null component; repeated rows
are linked vectors like any; extra columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.blocks import block_pairs, forest, pairs_here
from panelkit.llm.common import cut, n_partitions
from panelkit.llm.graph import components
from panelkit.llm.vectors import matrix, usable

LEAST = 0.93
LEAF = 400
MISS = 0.06  # a split parts a pair at the threshold so often
LOST = 1e-5  # all trees of a label part it so often
SHRINK = 0.75  # a child with a larger share of its node isn't split again
BLOCK = 400
BROADCAST_NODES = 100_000  # a table of nodes (a number or two each) is broadcast up to so many rows


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, n, dim, at) of every node of every vector: its projection on the node's direction."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, dims, nodes = batch.column("id").to_numpy(), batch.column("dim").to_numpy(), batch.column("nodes")
        row = np.repeat(np.arange(len(ids)), np.diff(nodes.offsets.to_numpy()))
        node, n = (c.to_numpy() for c in nodes.flatten().flatten())
        at = np.zeros(len(node))
        for dim in np.unique(dims):
            here = np.flatnonzero(dims == dim)
            v = matrix(batch.column("vec").take(pa.array(here)))
            v /= np.linalg.norm(v, axis=1)[:, None]
            place = np.zeros(len(ids), np.int64)
            place[here] = np.arange(len(here))
            mine = np.flatnonzero(dims[row] == dim)
            mine = mine[np.argsort(node[mine], kind="stable")]
            for some in np.split(mine, np.flatnonzero(np.diff(node[mine])) + 1):
                way = np.random.default_rng(int(node[some[0]]) & (2**63 - 1)).standard_normal(dim)
                at[some] = v[place[row[some]]] @ (way / np.linalg.norm(way))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[row], node, n, dims[row], at)], ["id", "node", "n", "dim", "at"])


def _trees(n: Column) -> Column:
    """How many trees a label of ``n`` vectors needs, at a depth a quarter above that of even halves."""
    depth = F.ceil(1.25 * F.log2(n / LEAF))
    return F.when(n <= LEAF, 1).otherwise(F.ceil(math.log(LOST) / F.log(1 - F.pow(F.lit(1 - MISS), depth)))).cast("int")


def _near(gap: Column, dim: Column) -> Column:
    """Half the overlap of a split, if 0.3 of the node's projections lie within ``gap`` around the median.

    The difference of a pair at the threshold projects to about a normal d of deviation s;
    the split parts it where |d| > 2 * near and the median lies in the rest of d:
    probability 2 * s * density * (phi(x) - x * Q(x)) with x = 2 * near / s, and that
    bracket is at most phi(0) * exp(-1.2533 * x - 0.2854 * x * x)."""
    s = F.sqrt((2 - 2 * LEAST) / dim)
    excess = F.greatest(F.lit(0.0), F.log(2 * s * 0.3 / gap / math.sqrt(2 * math.pi) / MISS))
    return F.when(gap > 0, s / 2 * (F.sqrt(1.2533**2 + 4 * 0.2854 * excess) - 1.2533) / (2 * 0.2854)).otherwise(2.0)


def leaves(vectors: DataFrame) -> DataFrame:
    """(id, leaf) of every leaf of every tree; ``vectors``: id, label, vec."""
    vectors = cut(vectors.select("id", "label", "vec", F.size("vec").alias("dim"))
                  .repartition(n_partitions(vectors.sparkSession), "id"))
    labels = cut(vectors.groupBy("label", "dim").agg(_trees(F.count("*")).alias("trees")))
    small = _small(labels)
    state = (vectors.drop("vec").join(small(labels), ["label", "dim"])
             .select("id", F.explode(F.sequence(F.lit(1), F.col("trees"))).alias("tree"), "label", "dim")
             .select("id", F.xxhash64("label", "dim", "tree").alias("node"), F.lit(None).cast("long").alias("above")))
    done = None
    while True:
        sizes = cut(state.groupBy("node", "above").agg(F.count("*").alias("n")))
        split = (F.col("n") > LEAF) & (F.col("above").isNull() | (F.col("n") <= SHRINK * F.col("above")))
        small = _small(sizes)
        ended = state.join(small(sizes.where(~split).select("node")), "node").select("id", F.col("node").alias("leaf"))
        done = ended if done is None else done.union(ended)
        if sizes.where(split).isEmpty():
            return done
        nodes = state.join(small(sizes.where(split).select("node", "n")), "node").groupBy("id").agg(
            F.collect_list(F.struct("node", "n")).alias("nodes"))
        rows = cut(vectors.drop("label").join(nodes, "id").mapInArrow(_project, "id long, node long, n long, dim int, at double"))
        middle = rows.groupBy("node").agg(F.percentile_approx("at", [0.35, 0.5, 0.65], 1000).alias("q"), F.first("dim").alias("dim"))
        middle = cut(middle.select("node", F.get("q", F.lit(1)).alias("mid"), _near(F.get("q", F.lit(2)) - F.get("q", F.lit(0)), F.col("dim")).alias("near")))
        sides = F.filter(F.array(F.when(F.col("at") <= F.col("mid") + F.col("near"), 0), F.when(F.col("at") >= F.col("mid") - F.col("near"), 1)),
                         lambda s: s.isNotNull())
        state = (rows.join(small(middle), "node").select("id", "node", "n", F.explode(sides).alias("side"))
                 .select("id", F.xxhash64("node", "side").alias("node"), F.col("n").alias("above")))


def _small(table: DataFrame):
    """Broadcast of tables with as many rows as ``table``, if they are few; else their joins shuffle (id, node) rows."""
    return F.broadcast if table.count() <= BROADCAST_NODES else lambda other: other


def _verify(key, table):
    """In a block pair: (u, null, n) for members with n links first met here, (u, v, 0) for a spanning forest of all links."""
    _, lo, hi = (k.as_py() for k in key)
    ids, mult = table.column("id").to_numpy(), table.column("mult").to_numpy()
    v = matrix(table.column("vec"))
    v /= np.linalg.norm(v, axis=1)[:, None]
    links = pairs_here(table.column("side").to_numpy(), lo, hi) & (v @ v.T >= LEAST)
    a, b = forest(links)
    some = np.flatnonzero(links.any(0) | links.any(1))
    if len(some):
        held = table.column("before").combine_chunks().take(pa.array(some))
        row, value = np.repeat(np.arange(len(some)), np.diff(held.offsets.to_numpy())), held.flatten().to_numpy()
        _, value, often = np.unique(value, return_inverse=True, return_counts=True)
        row, value = row[often[value] > 1], value[often[value] > 1]  # leaves that two linked members share
        if len(value):
            _, value = np.unique(value, return_inverse=True)
            before = np.zeros((len(some), value.max() + 1), np.float32)
            before[row, value] = 1
            links[np.ix_(some, some)] &= before @ before.T == 0
    links = links | links.T
    n = links @ mult
    some = np.flatnonzero(n)
    return pa.table({"u": pa.array(np.concatenate([ids[some], ids[a]])),
                     "v": pa.array([None] * len(some) + ids[b].tolist(), pa.int64()),
                     "n": pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)]))})


def near_copies(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vec"))
    valid = rows.where(usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    alike = cut(valid.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult")))
    leaf = cut(leaves(alike))
    lists = leaf.groupBy("id").agg(F.collect_set("leaf").alias("leaves"))
    # blocks are dealt on (id, leaf) alone; the vector joins them once and moves once
    members = block_pairs(leaf, ["leaf"], "id", BLOCK).join(alike.select("id", "vec", "mult").join(lists, "id"), "id").select(
        "leaf", "lo", "hi", "side", "id", "vec", "mult", F.filter("leaves", lambda x: x < F.col("leaf")).alias("before"))
    met = cut(members.groupBy("leaf", "lo", "hi").applyInArrow(_verify, "u long, v long, n long"))
    degree = met.where("v is null").groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "id")
    found = components(met.where("v is not null").select("u", "v"))
    reps = (alike.join(degree, "id", "left").join(found, "id", "left")
            .select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    known = valid.join(reps, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    other = rows.where(~(usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
