"""A Merkle manifest of a dataset: leaves by row, a tree per group, a tree over groups.

A node is the lower-case hex SHA-256 of what it covers. Leaves cover a row's
columns, each as ``-`` if null, else its UTF-8 byte count, ``:`` and its text.
In a group leaves ascend by ``order``; while a tree has several nodes, every
three consecutive ones become one (the last run may have fewer, even one). The
subroots of groups, null first, then bytewise, are the leaves of the outer tree.

How it runs: Spark hashes the rows, so texts never leave the JVM, and ranks the
narrow leaves by a range partitioning and prefix sums, so a group of any size is
dealt to many tasks. Ranks cut a tree into aligned blocks of 3**7 nodes.
Executors run DuckDB over Arrow batches of whole blocks: a level is an ordered
``string_agg`` of each run and the ``sha256`` of that. One pass up gives the
blocks' roots, which are nodes of the next, 2,187 times smaller round; one pass
down gives the siblings of every node, to which those of its block are added.
Spark combines the rounds and joins the outer proofs, one row a block that meets
the block's nodes in the exchange which deals them, so no node repeats it on the way. Memory is
that of an Arrow batch and a block; the number of rounds grows with the
logarithm of the largest group. All tables between are written to the shared
folder, so lost executors cost their own tasks.

Defined results: null and empty texts differ (``-`` and ``0:``); null ``order``
comes first; rows equal in ``order`` come by their leaves, equal rows are
neighbours and have each its own proof; a lone leaf is its subroot, a lone
subroot the root, and both have an empty proof; texts of any length are hashed
whole; an empty table gives no rows; other columns are ignored and may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from quillgrid.llm.storage import materialise

FAN = 3
LEVELS = 7
#: Groups' parts of a range partitioning: up to so many rows of prefix sums are broadcast.
MOST_SPANS = 100_000

_HEX = 64
_STEPS = "array<struct<left:string,right:string>>"
_ARROW_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_AT = (1 << 33) - 1


def leaf(columns: Sequence[Column]) -> Column:
    """The leaf of these values, in this order."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def siblings(proof: Column) -> Column:
    """The digests of a proof end to end, from the leaf's siblings to those below the root, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def _ranked(nodes: DataFrame, by: list[str], name: str) -> tuple[DataFrame, int]:
    """``nodes`` (tree, hash, ...) with pos and n, their place in and the size of their tree; and the largest n.

    The rows are written sorted: their places have to be the same in both reads.
    The last key of the sort is the place in the input, so rows that are equal
    are dealt to several partitions too.
    """
    order = ["tree", *by, "hash", "_tie"]
    rows = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    rows, _ = materialise(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_AT))}), name)
    spans = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    tree = Window.partitionBy("tree")
    before = F.sum("_count").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_count")
    spans, _ = materialise(spans.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_count").over(tree).alias("n")), f"{name}-spans")
    known = spans.agg(F.count("*").alias("spans"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    placed = rows.join(F.broadcast(spans) if known["spans"] <= MOST_SPANS else spans, ["tree", "_part"])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"), known["most"]


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Nodes by block and place in it, with the levels their block climbs."""
    size = FAN**LEVELS
    levels = sum((F.when(F.col("n") > FAN**i, 1).otherwise(0) for i in range(LEVELS)), F.lit(0))
    return nodes.withColumns({"block": F.floor(F.col("pos") / size), "place": F.col("pos") % size, "levels": levels})


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, of about a batch each, with the number ``k`` of the block in the table."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        ends = _last_rows(rows)
        cut = int(ends[-2]) + 1 if len(ends) > 1 else 0
        if cut:
            yield _numbered(rows.slice(0, cut), ends[:-1])
        held = rows.slice(cut)
    if held is not None:
        yield _numbered(held, _last_rows(held))


def _last_rows(rows: pa.Table) -> np.ndarray:
    """The last row of each block; a block starts where ``place`` does not go on."""
    place = rows.column("place").to_numpy()
    return np.append(np.flatnonzero(place[1:] != place[:-1] + 1), len(place) - 1)


def _numbered(rows: pa.Table, ends: np.ndarray) -> pa.Table:
    last = rows.take(pa.array(ends)).select(["n", "block", "place"])
    n, block, place = (last.column(c).to_numpy() for c in ("n", "block", "place"))
    if (place + 1 != np.minimum(FAN**LEVELS, n - block * FAN**LEVELS)).any() or (np.diff(ends, prepend=-1) < place + 1).any():
        raise RuntimeError("a block came in pieces")
    k = np.searchsorted(ends, np.arange(rows.num_rows))
    return rows.append_column("k", pa.array(k)).append_column("row", pa.array(np.arange(rows.num_rows)))


def _levels_sql() -> str:
    """The common tables n0 to n7 (nodes of a level) and r0 to r6 (its runs, digests end to end)."""
    parts = ["n0 AS MATERIALIZED (SELECT k, place, levels, hash FROM nodes)"]
    for i in range(LEVELS):
        parts.append(f"r{i} AS MATERIALIZED (SELECT k, place // {FAN} AS place, levels, string_agg(hash, '' ORDER BY place) AS run FROM n{i} WHERE levels > {i} GROUP BY ALL)")
        parts.append(f"n{i + 1} AS MATERIALIZED (SELECT k, place, levels, sha256(run) AS hash FROM r{i})")
    return "WITH " + ", ".join(parts)


def _up_sql() -> str:
    tops = " UNION ALL ".join(f"SELECT k, hash FROM n{i} WHERE levels = {i}" for i in range(LEVELS + 1))
    return f"{_levels_sql()} SELECT head.tree, head.block AS pos, head.n, tops.hash FROM ({tops}) tops JOIN (SELECT k, tree, block, n FROM nodes WHERE place = 0) head USING (k)"


def _down_sql() -> str:
    steps, joins = [], []
    for i in range(LEVELS):
        at = f"(nodes.place // {FAN**i} % {FAN})::BIGINT * {_HEX}"
        steps.append(f"CASE WHEN r{i}.run IS NULL THEN [] ELSE [{{'left': substr(r{i}.run, 1, {at}), 'right': substr(r{i}.run, {at} + {_HEX + 1})}}] END")
        joins.append(f"LEFT JOIN r{i} ON r{i}.k = nodes.k AND r{i}.place = nodes.place // {FAN ** (i + 1)}")
    return f"{_levels_sql()} SELECT {' || '.join(steps)} || coalesce(above.above, []) AS proof FROM nodes JOIN above ON above.k = nodes.k {' '.join(joins)} ORDER BY nodes.row"


def _asked(sql: str, **tables: pa.Table) -> pa.Table:
    with duckdb.connect(config={"threads": 1}) as con:
        for name, rows in tables.items():
            con.register(name, rows)
        return con.sql(sql).to_arrow_table()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sql = _up_sql()
    for rows in _whole_blocks(batches):
        yield from _asked(sql, nodes=rows).to_batches()


def _proofs(inherited: list[str]):
    """Of blocks that each begin with what their nodes share (place -1): the nodes with that and their proofs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sql = _down_sql()
        for rows in _whole_blocks(batches):
            first = pc.equal(rows.column("place"), -1)
            head, rows = rows.filter(first), rows.filter(pc.invert(first))
            proof = _asked(sql, nodes=rows.select(["k", "row", "place", "levels", "hash"]), above=head.select(["k", "above"])).column("proof").cast(_ARROW_STEPS)
            for c in inherited:
                rows = rows.set_column(rows.column_names.index(c), c, head.column(c).take(rows.column("k")))
            yield from rows.drop_columns(["k", "row", "place", "block", "levels", "above"]).append_column("proof", proof).to_batches()

    return run


def _climbed(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The nodes of all rounds, from these to one node a tree."""
    rounds, size = [nodes], FAN**LEVELS
    while most > 1:
        rows = _dealt(_in_blocks(rounds[-1].select("tree", "pos", "n", "hash")))
        up = rows.mapInArrow(_roots, "tree string, pos long, n long, hash string")
        up, _ = materialise(up.withColumn("n", F.ceil(F.col("n") / size)), f"{name}-{len(rounds)}")
        rounds.append(up)
        most = -(-most // size)
    return rounds


def _descended(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest round with their proofs; ``above`` has a row a tree: its proof further up, and what all its nodes inherit."""
    inherited = [c for c in above.columns if c not in ("tree", "proof")]
    proved = rounds[-1].join(above, "tree")
    for nodes in reversed(rounds[:-1]):
        parents = proved.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("place"), F.col("proof").alias("above"), *inherited)
        kinds = {f.name: f.dataType.simpleString() for f in [*nodes.schema, *parents.schema] if f.name in (*nodes.columns, *inherited)}
        rows = _dealt(_in_blocks(nodes).unionByName(parents, allowMissingColumns=True)).select(*kinds, "place", "block", "levels", "above")
        proved = rows.mapInArrow(_proofs(inherited), ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()) + f", proof {_STEPS}")
    return proved


def prove(rows: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row: ``order``, ``group``, leaf, subroot, root, proof, and the columns of ``carry``, computed from the input's.

    A proof lists the runs from the leaf up: the digests left and right of one's own.
    """
    spark, carry = rows.sparkSession, carry or {}
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    nodes = rows.select(tree.alias("tree"), F.col(order).alias("_order"), F.col(group).alias("_group"), leaf([F.col(c) for c in columns]).alias("hash"), *[c.alias(f"_carry{i}") for i, c in enumerate(carry.values())])
    leaves, most = _ranked(nodes, ["_order"], "leaves")
    rounds = _climbed(leaves, most, "nodes")
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("_name"), "hash")
    tops, groups = _ranked(subroots, ["_name"], "subroots")
    outer = _climbed(tops, groups, "outer")
    root = outer[-1].select("hash").first()
    top = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(_STEPS).alias("proof"))
    above = _descended(outer, top).select(F.col("_name").alias("tree"), "proof", F.col("hash").alias("subroot"))
    return _descended(rounds, above).select(
        F.col("_order").alias(order),
        F.col("_group").alias(group),
        F.col("hash").alias("leaf"),
        "subroot",
        F.lit(root["hash"] if root else None).cast("string").alias("root"),
        "proof",
        *[F.col(f"_carry{i}").alias(name) for i, name in enumerate(carry)],
    )


def without_line_ends(text: Column) -> Column:
    """The tampering that the query looks for: a text without its line feeds."""
    return F.replace(text, F.lit("\n"), F.lit(""))
