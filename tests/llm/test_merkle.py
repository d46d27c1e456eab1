"""The Merkle manifest against a plain recursion."""

import hashlib
import random

from helpers import DOCS, clashing, empty, odd, odd_rows
from pyspark.sql import functions as F

from quillgrid.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def plain(leaves):
    """Root, and each leaf's siblings."""
    nodes, proofs, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            p += [n for j, n in enumerate(nodes[at[i] // 3 * 3 : at[i] // 3 * 3 + 3]) if j != at[i] % 3]
            at[i] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    subroots, inner = {}, {}
    for source, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
        subroots[source], proofs = plain([leaf(r) for r in mine])
        inner[source] = list(zip(mine, proofs, strict=True))
    names = sorted(subroots, key=lambda s: (s is not None, (s or "").encode()))
    root, outer = plain([subroots[s] for s in names])
    return sorted(repr((r[0], leaf(r), subroots[s], root, "".join(p + outer[i]))) for i, s in enumerate(names) for r, p in inner[s])


def found(df):
    rows = merkle.prove(df).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("siblings", merkle.siblings(F.col("proof"))).collect()
    assert all(r.folded == r.root for r in rows)
    return sorted(repr((r.doc_id, r.leaf, r.subroot, r.root, r.siblings)) for r in rows)


def test_odd_rows_repeats_and_clashing_names(spark):
    again = odd(spark).unionByName(odd(spark))
    assert found(clashing(again)) == expected(odd_rows() * 2)
    assert found(odd(spark)) == expected(odd_rows())


def test_null_ids_and_sources(spark):
    rows = [(None, "a", None, None, None), (None, "b", "x", None, 1), (3, None, None, "é", 1), (-1, "", "", "", 0), (7, "z", "", "zz", 2)]
    assert found(spark.createDataFrame(rows, DOCS)) == expected(rows)


def test_empty_and_single(spark):
    assert found(empty(spark)) == []
    one = [(5, "text", "en", "a", 4)]
    assert found(spark.createDataFrame(one, DOCS)) == expected(one)
    assert merkle.prove(spark.createDataFrame(one, DOCS)).first().proof == []


def test_several_rounds_in_a_group_and_over_groups(spark):
    rows = [(i, f"t{i}", "en", "hot", i) for i in range(5000)] + [(10_000 + i, "x", None, f"s{i}", 1) for i in range(2500)]
    random.Random(1).shuffle(rows)
    assert found(spark.createDataFrame(rows, DOCS).repartition(5)) == expected(rows)


def test_tampering_is_seen_only_where_the_leaf_changes(spark):
    rows = [(i, "a\nb" if i % 2 else "ab", "en", "s", 2) for i in range(30)]
    cut = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.replace("text", F.lit("\n"), F.lit(""))])
    out = merkle.prove(spark.createDataFrame(rows, DOCS), carry={"cut": cut}).withColumn("ok", merkle.fold(F.col("cut"), F.col("proof")) == F.col("root")).collect()
    assert {r.doc_id: r.ok for r in out} == {i: i % 2 == 0 for i in range(30)}


def test_proofs_of_another_group_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k long, g string")
    out = merkle.prove(df, columns=["k"], group="g", order="k").collect()
    assert {r.k: r.leaf for r in out} == {k: h(f"1:{k}") for k in (1, 2, 3)} and len({r.root for r in out}) == 1
