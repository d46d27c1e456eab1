"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text becomes units (runs of anything but ASCII white space, longer ones in
pieces of ``PIECE`` characters, so texts without spaces have units too) and its
k-mers of ``K`` consecutive units; a text of fewer units is one k-mer. Units are
the same for texts of every length. Each k-mer is numbered by
its occurrence, so repeats count. Numbered k-mers are hashed once; the hash
deals them to ``SKETCHES`` sketches and orders them within each. A sketch keeps
its ``KEPT`` smallest, puts them back in text order and hashes the tuple: what
it keeps moves with the set of k-mers, the tuple also with their order, so the
share of equal sketches falls with edit distance, not only with set overlap.

A fingerprint is 8 hex digits a sketch, "--------" for a sketch without k-mers.
``likeness`` is the share of equal sketches among those that either text has;
two texts without units are alike (1.0).

Everything is computed within the row on packed 64-bit integers (sorted arrays
of hash and position), so no k-mer is ever shuffled. A position takes 30 bits:
a string holds no more units than that.

Defined results: null is an empty text; texts of any length are taken whole;
repeated rows get
equal fingerprints; in ``edited`` a row with a null doc_id stands outside the
order and has an empty next document, rows that share a doc_id share its next
document, which is the smallest text of the next greater doc_id; doc_id may be
of any type that has an order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.storage import materialise
from quillgrid.llm.text import let

K = 2
PIECE = 8
SKETCHES = 32
KEPT = 2
NONE = "--------"

# A packed k-mer: sketch in bits 58 to 62, its order in bits 30 to 57, position of the k-mer below.
_POS_BITS = 30
_SKETCH_SHIFT = 58
_POS = (1 << _POS_BITS) - 1
_HASH = ((1 << 63) - 1) ^ _POS


def _bits(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _differs(x: Column, y: Column, shift: int) -> Column:
    """Whether two packed k-mers differ in the bits from ``shift`` up."""
    return x.bitwiseXOR(y) >= F.lit(1 << shift)


def _numbered(packed: Column) -> Column:
    """Sorted packed k-mers in which each repeat of a k-mer has a hash of its own, by its occurrence."""
    again = lambda x, i: (i > 0) & ~_differs(x, F.get(packed, i - 1), _POS_BITS)
    repeats = F.filter(packed, again)

    def renumber(d: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda t: (t == 0) | _differs(F.get(d, t), F.get(d, t - 1), _POS_BITS))

        def runs(begins: Column) -> Column:
            of_run = lambda s, r: F.transform(
                F.sequence(s, F.coalesce(F.get(begins, r + 1), F.size(d)) - 1),
                lambda t: _bits(F.xxhash64(_bits(F.get(d, t), _HASH), t - s + 1), _HASH).bitwiseOR(_bits(F.get(d, t), _POS)),
            )
            return F.flatten(F.transform(begins, of_run))

        return let(starts, runs)

    merged = lambda d: F.sort_array(F.concat(F.filter(packed, lambda x, i: ~again(x, i)), renumber(d)))
    return let(repeats, lambda d: F.when(F.size(d) == 0, packed).otherwise(merged(d)))


def _sketches(units: Column) -> Column:
    kmer = lambda i: F.xxhash64(F.slice(units, i + 1, K))
    last = F.greatest(F.size(units) - K, F.lit(0))
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: _bits(kmer(i), _HASH).bitwiseOR(_bits(i.cast("long"), _POS))))

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < KEPT) | _differs(x, F.get(s, i - KEPT), _SKETCH_SHIFT))

    def tuples(kept: Column) -> Column:
        sketch = F.transform(kept, lambda x: F.shiftright(x, _SKETCH_SHIFT).cast("int"))

        def texts(number: Column) -> Column:
            def one(b: Column) -> Column:
                first = F.array_position(number, b).cast("int")
                size = F.when(F.get(number, first) == b, F.lit(2)).otherwise(F.lit(1)) if KEPT == 2 else F.size(F.filter(number, lambda n: n == b))
                places = F.sort_array(F.transform(F.slice(kept, first, size), lambda x: _bits(x, _POS).cast("int")))
                digits = F.right(F.lpad(F.lower(F.hex(F.xxhash64(F.transform(places, kmer)))), 16, "0"), F.lit(8))
                return F.when(first == 0, F.lit(NONE)).otherwise(digits)

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), one), "")

        return let(sketch, texts)

    return let(packed, lambda a: let(_numbered(a), lambda s: let(smallest(s), tuples)))


def fingerprint(text: Column) -> Column:
    """The Order MinHash fingerprint of a text."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    return let(units, lambda u: F.when(F.size(u) == 0, F.lit(NONE * SKETCHES)).otherwise(_sketches(u)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches of two fingerprints, 0 to 1."""
    at = lambda x, j: F.substring(x, j * 8 + 1, F.lit(8))
    every = F.sequence(F.lit(0), F.lit(SKETCHES - 1))
    either = F.size(F.filter(every, lambda j: (at(a, j) != NONE) | (at(b, j) != NONE)))
    equal = F.size(F.filter(every, lambda j: (at(a, j) == at(b, j)) & (at(a, j) != NONE)))
    return F.when(either == 0, F.lit(1.0)).otherwise(equal / either)


def _order(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, prev_id, prev_chars: the document whose next one this is (for the first: the last)."""
    spark = documents.sparkSession
    ids = documents.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("chars"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = materialise(ids.repartitionByRange(ranges, "doc_id").withColumn("range", F.spark_partition_id()), "order")
    within = Window.partitionBy("range").orderBy("doc_id")
    rows = ranged.select("doc_id", "range", F.lag("doc_id").over(within).alias("prev_id"), F.lag("chars").over(within).alias("prev_chars"))
    # one row a range: where each range ends, seen from the next one
    ends = ranged.groupBy("range").agg(F.max("doc_id").alias("end_id"), F.max_by("chars", "doc_id").alias("end_chars"))
    line = Window.orderBy("range")
    back = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = ends.select("range", *[F.coalesce(F.lag(c).over(line), F.last(c).over(back)).alias(c) for c in ("end_id", "end_chars")])
    return rows.join(F.broadcast(edges), "range").select("doc_id", F.coalesce("prev_id", "end_id").alias("prev_id"), F.coalesce("prev_chars", "end_chars").alias("prev_chars"))


def edited(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, next_fingerprint for every row.

    ``edited`` is the text with its last quarter of characters replaced by the
    first as many of the next document. Texts are dealt once by doc_id, with
    their fingerprints; of the next document only the characters needed travel.
    """
    # an alias that changes nothing would keep the planner from seeing that both exchanges are one
    ident = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    texts = documents.select(ident, F.coalesce(F.col(text_col), F.lit("")).alias("text"), fingerprint(F.col(text_col)).alias("fingerprint"))
    # both joins read one exchange of texts and fingerprints
    placed = texts.where("doc_id IS NOT NULL")
    heads = placed.join(_order(documents, id_col, text_col), "doc_id")
    heads = heads.select("prev_id", F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"), F.col("fingerprint").alias("next"))
    heads = heads.groupBy("prev_id").agg(F.min(F.struct("head", "next")).alias("n"))
    with_next = placed.join(heads, F.col("doc_id") == F.col("prev_id"), "left").select("doc_id", "text", "fingerprint", "n.head", F.col("n.next").alias("next_fingerprint"))
    outside = texts.where("doc_id IS NULL").select("*", F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("next_fingerprint"))
    rows = with_next.union(outside)
    quarter = F.floor(F.length("text") / 4).cast("int")
    new = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter))
    rows = rows.select("doc_id", "text", "fingerprint", new.alias("edited"), F.coalesce("next_fingerprint", F.lit(NONE * SKETCHES)).alias("next_fingerprint"))
    return rows.select("doc_id", "text", "edited", "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
