"""Near-duplicate detection with Circulant MinHash and exact verification.

Words are runs of anything but ASCII white space, A-Z lower-cased; a document's
set holds its distinct ``shingle``-word sequences (a shorter text is one
sequence). Documents with Jaccard similarity of at least ``percent`` / 100 are
linked; a class is a connected component of links.

Method. One permutation spreads the shingles over the 32-bit ring, a second one,
shifted by k round the ring, gives coordinate k of the signature: two
permutations serve all coordinates. Bands of ``ROWS`` coordinates are hashed, as
many bands as leave a pair at ``percent`` without a common one with probability
4e-7: 28 at 80.

How it runs.

1. One pass gives each document its band keys and a 128-bit hash of its set, from
   two independent hashes of its words. Equal sets are one vertex from here on,
   so copies cost nothing more.
2. Within a band key each vertex is tied to the smallest one there; components
   of these ties are groups. Whatever shares a band key is in one group.
3. Texts of grouped vertices are dealt to tasks by group. A task numbers shingles
   by their words, so it compares sets exactly, through an inverted index: it
   sweeps from the most central document
   until every document outside the largest class has met all others, so the
   many links inside a class are never listed, yet no link between classes is
   lost. Groups beyond ``task_shingles`` are first dealt to parts by hash, each
   with the group's hub (its smallest member), and members linked to the hub are
   settled: they are one class, so no two of them need to meet again. The group
   is then cut by set size (only neighbouring size levels, a factor of
   100 / ``percent`` apart, can hold a link), by settled or open, and by hash into
   parts; every pair of parts that could hold a link, but for two settled ones,
   meets in some task. A group of near copies of one text thus costs one pass.
   Where pairs of parts would send members more than ``MOST_SENT`` times, as in a
   group that chance ties or a common form hold together, members meet by the
   band keys they share, if that sends less: only keys of several members, one of
   them open, count, and a member is sent at most once for each of its bands.
4. Components of the links found give component_id.

Defined results: null, empty and blank texts have an empty set and link with
nothing; a null doc_id links with nothing and is its own (null) class; rows with
the same doc_id and set share a result; doc_id is a whole number; an empty table
gives no rows; other columns are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.components import HOT, SALTS, connected_components
from quillgrid.llm.hashing import coded_words, gram_codes, gram_hashes, mix, slices, string_bytes
from quillgrid.llm.storage import materialise, run
from quillgrid.llm.text import whole_numbers

ROWS = 4
MISSED = 4.2e-7
PERCENT = 80
TASK_SHINGLES = 1_000_000
MOST_SENT = 4
SLOTS = 1 << 18
_FILL = np.array([[0x6A09E667F3BCC908, 0xBB67AE8584CAA73B]], dtype=np.uint64)


def n_bands(percent: int) -> int:
    """Bands of which a pair at this similarity shares none with probability ``MISSED`` at most."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-min((percent / 100) ** ROWS, 1 - 1e-9))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int, hashed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the distinct shingles of all rows, row by row, how many each row has, and their two hashes if asked for.

    Numbers are equal if and only if the words of the shingles are. A row of
    fewer words is filled up with a word that no text has.
    """
    code, lanes, _, _, counts = coded_words(data, offsets, lower=True)
    length = np.where(counts > 0, np.maximum(counts, shingle), 0)
    first = np.cumsum(length) - length
    filled = np.full(int(length.sum()), len(lanes), dtype=np.int64)
    filled[np.arange(len(code)) + np.repeat(first - (np.cumsum(counts) - counts), counts)] = code
    row = np.repeat(np.arange(len(counts)), length)
    starts = np.flatnonzero(np.arange(len(filled)) - first[row] + shingle <= length[row])
    grams = gram_codes(filled, shingle)[starts]
    _, at = np.unique(row[starts] * (grams.max(initial=0) + 1) + grams, return_index=True)
    hashes = np.zeros((2, 0), dtype=np.uint64)
    if hashed and len(at):
        lanes = np.concatenate([lanes, _FILL])
        hashes = np.stack([gram_hashes(lanes[filled, i], shingle)[starts[at]] for i in (0, 1)])
    return grams[at], np.bincount(row[starts[at]], minlength=len(counts)), hashes


def _second_permutation(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(hashes: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """coordinates x rows Circulant MinHash values of rows that all have at least one shingle."""
    ring = (mix(hashes, 3) >> np.uint64(32)).astype(np.uint32)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.empty((coordinates, len(counts)), dtype=np.uint32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(_second_permutation(ring - np.uint32(k)), begins)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """rows-of-table x bands 64-bit keys; keys of different bands differ."""
    bands = len(signature) // rows
    out = np.empty((signature.shape[1], bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(signature.shape[1], b, dtype=np.uint64)
        for row in signature[b * rows : (b + 1) * rows]:
            key = mix(key ^ (row.astype(np.uint64) << np.uint64(16)), 4)
        out[:, b] = key
    return out


def _sketch_batches(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for i, j in slices(offsets):
                o = offsets[i : j + 1]
                _, counts, hashes = shingle_sets(data[o[0] : o[-1]], o - o[0], shingle, hashed=True)
                full = counts > 0
                sums, keys = np.zeros((2, j - i), dtype=np.uint64), np.zeros((0, bands), dtype=np.uint64)
                if full.any():
                    begins = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                    sums[0, full], sums[1, full] = (np.add.reduceat(mix(h, i), begins) for i, h in enumerate(hashes, 1))
                    keys = band_keys(signatures(hashes[0], counts[full], bands * rows), rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * bands)]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(counts, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def sketches(documents: DataFrame, shingle: int, bands: int, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, the set's hash (set_a, set_b) and band keys of every row."""
    docs = documents.select(whole_numbers(documents, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_sketch_batches(shingle, bands, rows), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A link between members of each pair of classes that some link joins: their components are those of all links."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), sizes)
    central = np.bincount(doc, weights=df[token], minlength=n) / np.maximum(sizes, 1)
    queue = np.argsort(-central, kind="stable")
    token = token[np.lexsort((token, df[token], doc))]  # of each document, the rarest first
    place = np.arange(len(token)) - ends[doc]
    # a linked pair shares more than all but the rarest (100 - percent) / 100 of either: one of these at least
    rare = (100 * place <= (100 - percent) * sizes[doc]) & (df[token] > 1)
    token_of, doc_of = token[rare], doc[rare]
    order = np.argsort(token_of, kind="stable")
    posting, edge = doc_of[order], np.searchsorted(token_of[order], np.arange(len(df) + 1))
    mark = np.zeros(len(df), dtype=bool)
    label, swept, out = np.arange(n), np.zeros(n, dtype=bool), []
    while True:
        weight = np.bincount(label, minlength=n)
        open_ = queue[~swept[queue]]
        if swept.any():
            open_ = open_[label[open_] != weight.argmax()]
        if not len(open_):
            return out
        x = open_[0]
        swept[x] = True
        mine = token[ends[x] : ends[x + 1]]
        first = mine[100 * np.arange(len(mine)) <= (100 - percent) * len(mine)]
        first = first[df[first] > 1]
        if not len(first):
            continue
        met = np.unique(np.concatenate([posting[edge[t] : edge[t + 1]] for t in first]))
        met = met[(100 * sizes[met] >= percent * sizes[x]) & (percent * sizes[met] <= 100 * sizes[x])]
        mark[mine] = True
        both = np.zeros(n, dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes[met])])
        at = np.arange(begins[-1]) + np.repeat(ends[met] - begins[:-1], sizes[met])
        both[met] = np.add.reduceat(mark[token[at]].astype(np.int64), begins[:-1]) if len(met) else 0
        mark[mine] = False
        linked = (both > 0) & (100 * both >= percent * (sizes + sizes[x] - both))
        linked[x] = False
        found, where = np.unique(label[linked], return_index=True)
        others = np.flatnonzero(linked)[where]
        for l, y in zip(found, others, strict=True):  # noqa: E741
            if l != label[x]:
                out.append((int(x), int(y)))
        label[np.isin(label, found)] = label[x]


def _tasks_of(rows: pa.Table, shingle: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """The rows of each task and their sets, one task at a time; rows are in order of task."""
    data, offsets = string_bytes(rows.column("text"))
    task = rows.column("task").combine_chunks().dictionary_encode().indices.to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        o = offsets[i : j + 1]
        grams, counts, _ = shingle_sets(data[o[0] : o[-1]], o - o[0], shingle)
        yield slice(i, j), np.split(grams, np.cumsum(counts)[:-1])


def _edges(us: list[int], vs: list[int]) -> pa.Table:
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _link_tasks(shingle: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.select(["task", "node", "text"]).sort_by([("task", "ascending"), ("node", "ascending")])
        node = rows.column("node").to_numpy()
        found = [(node[of][x], node[of][y]) for of, sets in _tasks_of(rows, shingle) for x, y in links_within(sets, percent)]
        return _edges([u for u, _ in found], [v for _, v in found])

    return run


def _hub_links(shingle: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("task", "ascending"), ("node", "ascending")])
        node, hub = rows.column("node").to_numpy(), rows.column("grp").to_numpy()
        us, vs = [], []
        for of, sets in _tasks_of(rows, shingle):
            mine, least = node[of], hub[of.start]
            hubs = [x for x, n in zip(sets, mine, strict=True) if n == least]  # rows of one doc_id may differ
            for x, n in zip(sets, mine, strict=True):
                both = [len(np.intersect1d(x, h, assume_unique=True)) for h in hubs] if n != least else []
                if any(100 * b >= percent * (len(x) + len(h) - b) for b, h in zip(both, hubs, strict=False)):
                    us.append(least)
                    vs.append(n)
        return _edges(us, vs)

    return run


def _with_hubs(members: DataFrame, task_shingles: int) -> DataFrame:
    """grp, node, n, task: members of the groups beyond ``task_shingles`` in parts, the hub in each part."""
    loads = members.groupBy("grp").agg(F.sum("n").alias("load")).where(F.col("load") > task_shingles)
    parts = F.ceil(F.col("load") / task_shingles).cast("int")
    large = members.join(loads, "grp").select("grp", "node", "n", parts.alias("parts"))
    dealt = large.where("node <> grp").select("grp", "node", "n", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    hubs = large.where("node = grp").select("grp", "node", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.union(hubs).select("grp", "node", "n", F.concat_ws(":", "grp", "part").alias("task"))


def _levels(key: Column) -> tuple[Column, Column]:
    """The keys that members of a key meet: open members of three levels, and, if they are open themselves, settled ones too."""
    level = F.floor(key / 2).cast("int") * 2
    settled = F.when(key % 2 != 0, F.array(*[level + d for d in (-2, 0, 2)])).otherwise(F.array().cast("array<int>"))
    return F.array(*[level + d for d in (-1, 1, 3)]), settled


def _parts(key: Column) -> Column:
    return F.coalesce(F.element_at("parts", key), F.lit(0))


def _cut(members: DataFrame, task_shingles: int, percent: int = PERCENT) -> DataFrame:
    """members (node, grp, n, settled) with their key, the parts into which each key of their group is cut, and ``times``, in how many tasks they are.

    A key is a size level, doubled, and one more for open members.
    """
    key = (F.floor(F.log("n") / F.lit(math.log(100 / percent + 1e-7))).cast("int") * 2 + F.when(F.col("settled"), 0).otherwise(1)).alias("key")
    keyed = members.select("node", "grp", "n", key)
    keys = keyed.groupBy("grp", "key").agg(F.sum("n").alias("load"))
    parts = F.map_from_entries(F.collect_list(F.struct("key", F.ceil(F.col("load") / task_shingles).cast("int").alias("parts"))))
    groups = keys.groupBy("grp").agg((F.sum("load") <= task_shingles).alias("whole"), parts.alias("parts"))  # some hundred keys at most
    times = F.aggregate(F.concat(*_levels(F.col("key"))), F.lit(0), lambda s, k: s + _parts(k))
    return keyed.join(groups, "grp").withColumn("times", F.when(F.col("whole"), 1).otherwise(times))


def _tasks(members: DataFrame, task_shingles: int, percent: int = PERCENT) -> DataFrame:
    """node, n, task of every member and each of the tasks, none or more, in which it has to be compared."""
    cut = _cut(members, task_shingles, percent)
    own = F.pmod(F.xxhash64("node"), _parts(F.col("key"))).cast("int")
    part = lambda k, i: F.concat_ws(".", k.cast("string"), i.cast("string"))
    pair = lambda k, i: F.concat_ws(":", F.col("grp").cast("string"), F.sort_array(F.array(part(F.col("key"), own), part(k, i))))
    met = lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(_parts(k), F.lit(1)) - 1), lambda i: i < _parts(k)), lambda i: pair(k, i))
    tasks = F.when(F.col("whole"), F.array(F.col("grp").cast("string"))).otherwise(F.flatten(F.transform(F.concat(*_levels(F.col("key"))), met)))
    return cut.select("node", "n", F.explode(tasks).alias("task"))


def _frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many texts have the shingles of each slot: never less than those of one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for i, j in slices(offsets):
                o = offsets[i : j + 1]
                hashes = shingle_sets(data[o[0] : o[-1]], o - o[0], shingle, hashed=True)[2][0]
                seen += np.bincount((hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(seen[slot], pa.int64())], ["slot", "n"])

    rows = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _rare_shingles(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, key: the rarest (100 - percent) / 100 of each text's shingles and one more, but for those that only it has.

    In any one order of all shingles, the first shingle that a linked pair has in
    common is among these of both texts. This order is by slot's frequency, then by hash.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            node = batch.column("node").to_numpy()
            data, offsets = string_bytes(batch.column("text"))
            for i, j in slices(offsets):
                o = offsets[i : j + 1]
                _, counts, hashes = shingle_sets(data[o[0] : o[-1]], o - o[0], shingle, hashed=True)
                hashes = hashes[0]
                doc = np.repeat(np.arange(j - i), counts)
                often = seen[(hashes % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((hashes, often, doc))
                place = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
                rare = order[(100 * place <= (100 - percent) * counts[doc]) & (often[order] > 1)]
                yield pa.RecordBatch.from_arrays([pa.array(node[i:j][doc[rare]], pa.int64()), pa.array(hashes[rare].view(np.int64))], ["node", "key"])

    return texts.select("node", "text").mapInArrow(run, "node long, key long")


def _spread(members: DataFrame, keys: DataFrame, docs: DataFrame, shingle: int, percent: int, task_shingles: int) -> DataFrame:
    """node, n, task: where each member has to be compared; ``keys`` (rep, key) are the bands of all vertices.

    A group whose pairs of parts would send its members more than ``MOST_SENT``
    times is dealt by band keys or by rare shingles instead, whichever sends
    least: a task has the members with one of some keys that an open member and
    another one share, and a task too large is cut into pairs of parts as groups are.
    """
    # what is sent is reckoned from the parts of each key: a member's tasks are listed only where it is compared in them
    sent = _cut(members, task_shingles, percent).groupBy("grp").agg(F.sum("n").alias("load"), F.sum(F.col("n") * F.col("times")).alias("sent"))
    costly, _ = materialise(sent.where(F.col("sent") > F.col("load") * MOST_SENT), "costly")
    if costly.isEmpty():
        return _tasks(members, task_shingles, percent)
    # merge joins: costly groups grow in number with the input
    large, _ = materialise(members.join(costly.select("grp").hint("merge"), "grp").select("node", "grp", "n", "settled"), "large")
    rare, _ = materialise(_rare_shingles(large.hint("merge").join(docs, "node"), shingle, percent).distinct(), "rare")
    ways = keys.select(F.lit("band").alias("way"), F.col("rep").alias("node"), "key").union(rare.select(F.lit("rare").alias("way"), "node", "key"))
    keyed, _ = materialise(ways.join(large.hint("merge"), "node"), "keyed")
    met = keyed.groupBy("way", "grp", "key").agg(F.count("*").alias("c"), F.bool_or(~F.col("settled")).alias("open")).where("c > 1 AND open").select("way", "grp", "key")
    keyed, _ = materialise(keyed.join(met.hint("merge"), ["way", "grp", "key"]), "met")
    buckets = keyed.groupBy("way", "grp").agg(F.ceil(F.sum("n") / task_shingles).alias("buckets"))
    bucket = F.pmod(F.xxhash64("key"), F.col("buckets"))
    dealt = keyed.join(buckets, ["way", "grp"]).select("node", "n", "settled", F.concat_ws("/", "grp", "way", bucket).alias("grp")).distinct()
    dealt, _ = materialise(dealt, "dealt")
    named = F.split("grp", "/")
    of = named[0].cast("long"), named[1]
    # a way in which nobody meets anybody has no rows, and sends nothing
    sums = _cut(dealt, task_shingles, percent).groupBy(of[0].alias("of"), of[1].alias("way")).agg(F.sum(F.col("n") * F.col("times")).alias("sent"))
    found = sums.groupBy(F.col("of").alias("grp")).pivot("way", ["band", "rare"]).agg(F.sum("sent"))
    by = costly.join(found, "grp", "left").select("grp", "sent", F.coalesce("band", F.lit(0)).alias("band"), F.coalesce("rare", F.lit(0)).alias("rare"))
    best = by.select("grp", F.when(F.col("sent") <= F.least("band", "rare"), "parts").when(F.col("band") < F.col("rare"), "band").otherwise("rare").alias("way"))
    best, _ = materialise(best.where("way <> 'parts'"), "ways")
    by_keys = dealt.join(best.select(F.col("grp").alias("of"), "way"), (of[0] == F.col("of")) & (of[1] == F.col("way")), "left_semi")
    by_parts = members.join(best, "grp", "left_anti")
    return _tasks(by_parts, task_shingles, percent).union(_tasks(by_keys, task_shingles, percent))


def _dealt(tasks: DataFrame, docs: DataFrame, task_shingles: int) -> DataFrame:
    """tasks with the text of each node and the bin of each task: about four bins for each ``task_shingles`` that are sent, copies counted.

    A node with more than one in ``HOT`` rows, as the hub of a large group, meets
    its text under ``SALTS`` keys, so that no one task copies it to all its tasks;
    it has more rows than keys, so its text is sent less often than it is needed.
    """
    load, rows = tasks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bins = max(1, math.ceil(load / task_shingles) * 4)
    # fewer than HOT rows, whatever the size of the table
    hot = F.broadcast(tasks.groupBy("node").agg(F.count("*").alias("c")).where((F.col("c") * HOT > rows) & (F.col("c") > SALTS)).select(F.col("node").alias("hot")))
    salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("task"), F.lit(SALTS))).cast("int")
    salts = F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sent = tasks.join(hot, F.col("node") == F.col("hot"), "left").select(*tasks.columns, salt.alias("salt"), F.pmod(F.xxhash64("task"), F.lit(bins)).alias("bin"))
    texts = docs.join(hot, F.col("node") == F.col("hot"), "left").select("node", "text", F.explode(salts).alias("salt"))
    # a merge join at every size: what is broadcast would grow with the input, and the plan would turn over at some size
    return sent.hint("merge").join(texts, ["node", "salt"])


def classes(documents: DataFrame, shingle: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of its class), kept for every row."""
    sketch, _ = materialise(sketches(documents, shingle, n_bands(percent), id_col=id_col, text_col=text_col), "sketches")
    sets = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    reps, _ = materialise(reps, "vertices")
    # rows of one rep are equal sets or share a doc_id: one text a node is enough
    docs = documents.select(whole_numbers(documents, id_col).alias("node"), F.col(text_col).alias("text"))

    def compared(tasks: DataFrame, links, *more: str) -> DataFrame:
        dealt = _dealt(tasks, docs, task_shingles).select("bin", "task", "node", *more, "text")
        return dealt.groupBy("bin").applyInArrow(links(shingle, percent), "u long, v long")

    with run(documents.sparkSession) as steps:
        keys = reps.select("rep", F.explode("bands").alias("key"))
        smallest = keys.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("c")).where("c > 1").select("key", "least")
        ties = keys.join(smallest, "key").where("rep <> least").select("rep", "least")
        groups = connected_components(ties, "rep", "least").withColumnRenamed("component", "grp")
        members = groups.join(reps.select(F.col("rep").alias("node"), "n"), "node").groupBy("node", "grp").agg(F.min("n").alias("n"))
        members, _ = materialise(members, "members")
        largest = members.groupBy("grp").agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if largest > task_shingles:
            stars, _ = materialise(compared(_with_hubs(members, task_shingles), _hub_links, "grp"), "stars")
            settled = stars.select(F.col("v").alias("node")).distinct().withColumn("hit", F.lit(True))
            marked = members.join(settled, "node", "left").withColumn("settled", F.col("hit").isNotNull() | (F.col("node") == F.col("grp"))).drop("hit")
            marked, _ = materialise(marked, "marked")
            tasks, _ = materialise(_spread(marked, keys, docs, shingle, percent, task_shingles), "tasks")
            links = compared(tasks, _link_tasks).union(stars)
        else:
            links = compared(_tasks(members.withColumn("settled", F.lit(False)), task_shingles, percent), _link_tasks)
        # written first: contracting them in the tasks that find them would keep two Python workers a core
        links, _ = materialise(links, "links")
        found = connected_components(links, "u", "v").select(F.col("node").alias("rep"), F.col("component").alias("linked"))
        steps.discard(but=steps.paths[-1:])  # the links are found and written
    named = reps.select("set_a", "set_b", "rep").join(found, "rep", "left").select("set_a", "set_b", F.coalesce("linked", "rep").alias("component"))
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").join(named, ["set_a", "set_b"])
    alone = sketch.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").withColumn("component", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept")]
    return full.select(columns).union(alone.select(columns))


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one of the smallest doc_id, all columns as they were."""
    gone = classes(documents, shingle, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return documents.join(gone, documents[id_col].cast("long") == gone["_gone_id"], "left_anti")
