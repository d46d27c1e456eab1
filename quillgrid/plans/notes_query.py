"""Note queries as clauses of a plan.

The clauses are those of the note query language that the reference hands to a
plugin. There is no query text to parse here: a query is a value, its conditions
are Columns, and ``run`` turns it into one DataFrame plan in which the source
conditions come before lists are flattened.

Our rules where none are written down: a missing property is null, comparisons
with null are false, sorts put nulls last.

Groups stay rows: a grouped query gives the rows of each group in order, with the
group's key, so a group of any size is spread over tasks. Its sort, limit and
offset are those of the keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(name: str) -> Column:
    return F.array_contains("tags", name if name.startswith("#") else f"#{name}")


def folder(name: str) -> Column:
    """Notes in a folder, or the note of this path."""
    return F.startswith("path", F.lit(name.rstrip("/") + "/")) | (F.col("path") == name)


def prop(name: str, kind: str = "string") -> Column:
    """A property of the note, null where it is missing or of another kind; ``a.b``, ``a[0]`` and ``['a b']`` reach into it."""
    return F.try_variant_get(F.try_parse_json(F.col("properties")), f"${name}" if name.startswith("[") else f"$.{name}", kind)


def has(name: str) -> Column:
    return prop(name, "variant").isNotNull()


def choice(condition: Column, yes: object, no: object) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


@dataclass(frozen=True)
class NotesQuery:
    """LIST without ``fields``, TABLE with them."""

    fields: dict[str, Column] = field(default_factory=dict)
    source: Column | None = None
    where: Column | None = None
    flatten: tuple[str, Column] | None = None
    group: Column | None = None
    sort: tuple[Column, ...] = ()
    limit: int | None = None
    offset: int = 0

    def run(self, notes: DataFrame) -> DataFrame:
        rows = notes
        for condition in (self.source, self.where):
            rows = rows if condition is None else rows.where(condition)
        if self.flatten:
            name, values = self.flatten
            rows = rows.select("*", F.explode(values).alias(name))
        if self.group is not None:
            return self._grouped(rows)
        rows = rows.select("*", *[c.alias(f"_{n}") for n, c in self.fields.items()])
        return self._cut(rows).select(F.col("path").alias("link"), *[F.col(f"_{n}").alias(n) for n in self.fields])

    def _cut(self, rows: DataFrame) -> DataFrame:
        rows = rows.orderBy(*self.sort) if self.sort else rows
        rows = rows.offset(self.offset) if self.offset else rows
        return rows if self.limit is None else rows.limit(self.limit)

    def _grouped(self, rows: DataFrame) -> DataFrame:
        """key, n (rows of the group), ord, link and fields, in order of key and then of the scan."""
        rows = rows.select(self.group.alias("key"), "ord", F.col("path").alias("link"), *[c.alias(n) for n, c in self.fields.items()])
        keys = self._cut(rows.groupBy("key").agg(F.count("*").alias("n")))
        joined = rows.join(keys.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")))
        return joined.select("key", "n", "ord", "link", *self.fields).orderBy(F.asc_nulls_last("key"), "ord")
