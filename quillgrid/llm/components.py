"""Connected components of an edge table: parts are contracted by themselves, then large and small stars alternate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.storage import discard, materialise

#: A node with more than one in ``HOT`` edge ends is hot: there are fewer than ``HOT`` of them.
HOT, SALTS = 64, 64
#: Edges that are contracted at once, by one task.
CHUNK = 1 << 17


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of these edges: all its nodes but the smallest, and that one for each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    rest = least != np.arange(len(nodes))
    return nodes[rest], nodes[least[rest]]


def _contract(edges: DataFrame, chunk: int) -> DataFrame:
    """Each partition's edges, some ``chunk`` at a time, as stars: from larger nodes to the smallest that they reach there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ends = contracted(*(table.column(c).to_numpy() for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                yield stars()
                held.clear()
        if held:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars: no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("c"))
    n, stars = nodes.agg(F.coalesce(F.sum("below"), F.lit(0)), F.coalesce(F.bool_and((F.col("below") == 0) | (F.col("c") == 1)), F.lit(True))).first()
    return n, stars


def _with_least(edges: DataFrame, ends: int) -> DataFrame:
    """u, v, m: edges with the smallest neighbour ``m`` of u. The edges of a hot u are dealt to ``SALTS`` keys."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    hot = F.col("c") * HOT > ends
    # fewer than HOT rows, whatever the size of the table
    hubs = F.broadcast(least.where(hot).select(F.col("u").alias("hub")))
    salt = F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(SALTS))).cast("int")
    dealt = edges.join(hubs, F.col("u") == F.col("hub"), "left").select("u", "v", salt.alias("salt"))
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    # merge join: what one side holds grows with the input
    return dealt.hint("merge").join(least.select("u", "m", F.explode(salts).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, u: str, v: str, chunk: int = CHUNK) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge.

    Each round contracts parts of some ``chunk`` edges by themselves, one task
    each, however many edges there are. If all is not stars by then, it moves
    every node's larger neighbours to its smallest one, then its smaller neighbours
    likewise, as joins on keys. Edges are written to the shared folder between
    steps. Rounds grow with the logarithm of the longest path. Edges of a node with
    itself and repeated edges change nothing.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u <> v")
    edges, path = materialise(_contract(edges, chunk), "edges")

    def step(df: DataFrame) -> tuple[DataFrame, str, int, bool]:
        new, new_path = materialise(df, "edges")
        discard(spark, path)
        return new, new_path, *_state(new)

    n, stars = _state(edges)
    while not stars:
        edges, path, n, stars = step(_contract(edges.coalesce(n // chunk + 1), chunk))
        if stars:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # every edge now leads from a larger node to a smaller one
        star = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _with_least(large, n).select(F.explode(star).alias("e")).select("e.*").where("u <> v").distinct()
        edges, path, n, stars = step(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
