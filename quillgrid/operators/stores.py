"""Keyed stores: changes that can conflict or miss, cascades, defaults of two levels, answers of providers, form checks.

A change that cannot be made is not an exception, which would end a job of many
changes: it comes back as a row with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import strings

ADD, UPDATE, DELETE = "add", "update", "delete"


def changed(current: DataFrame, changes: DataFrame, key: list[str], order: str, reserved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after ``changes`` (op, the columns of ``current``, ``order``), and the changes refused, with ``error``.

    Changes of a key apply in order. Adding a key that is there, or is ``reserved``,
    is refused, as is updating or deleting one that is not there. Whether a key is
    there depends on the last add or delete before a change alone, made or refused,
    so one window over each key's changes settles all of them.
    """
    names = [c for c in current.columns if c not in key]
    known = current.select(*key, F.lit(True).alias("_there"))
    rows = changes.join(known, key, "left")
    held = F.lit(False)
    if reserved is not None:
        rows, held = rows.join(reserved.select(*key, F.lit(True).alias("_held")), key, "left"), F.coalesce("_held", F.lit(False))
    line = Window.partitionBy(*key).orderBy(order)
    before = F.last(F.when((F.col("op") == ADD) & ~held, True).when(F.col("op") == DELETE, False), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    there = F.coalesce(before, "_there", F.lit(False))
    error = F.when((F.col("op") == ADD) & held, "reserved").when((F.col("op") == ADD) & there, "already exists").when((F.col("op") != ADD) & ~there, "not found")
    rows = rows.withColumn("error", error)
    refused = rows.where("error IS NOT NULL").select("op", *key, order, "error")
    last = rows.where("error IS NULL").groupBy(*key).agg(F.max_by(F.struct("op", *names), order).alias("_c"))
    kept = current.join(last.select(*key), key, "left_anti")
    made = last.where(F.col("_c.op") != DELETE).select(*key, *[F.col(f"_c.{c}").alias(c) for c in names])
    return kept.unionByName(made), refused


def cascaded(rows: DataFrame, left: DataFrame, key: list[str]) -> DataFrame:
    """Rows that depend on another table: those whose key is no longer in ``left`` go with it."""
    return rows.join(left.select(*key).distinct(), key, "left_semi")


def cleared(chosen: DataFrame, left: DataFrame, key: list[str]) -> DataFrame:
    """Choices (such as default models) of keys that are no longer in ``left`` become null; the rows stay."""
    there = left.select(*key).distinct().withColumn("_there", F.lit(True))
    return chosen.join(there, key, "left").select(*[F.when(F.col("_there"), F.col(c)).alias(c) if c in key else F.col(c) for c in chosen.columns])


def merge_sections(defaults: DataFrame, own: DataFrame, deep: DataFrame) -> DataFrame:
    """Settings (section, name, value) over defaults. A section of ``deep`` (section) is merged by name; any other is replaced whole by one's own."""
    mine = own.select("section", "name", F.col("value").alias("_own"), F.lit(True).alias("_set"))
    base = defaults.join(own.select("section").distinct().withColumn("_has", F.lit(True)), "section", "left")
    base = base.join(deep.select("section").distinct().withColumn("_deep", F.lit(True)), "section", "left").where("_deep OR _has IS NULL").drop("_has", "_deep")
    return base.join(mine, ["section", "name"], "full_outer").select("section", "name", F.when(F.col("_set"), F.col("_own")).otherwise(F.col("value")).alias("value"))


def with_entry_defaults(entries: Column, defaults: Column) -> Column:
    """A map with the default of every entry that it does not have; a null map is the defaults."""
    own = F.coalesce(entries, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)), own)


# What an answer says; these are shown to users.
_NO_KEY, _NO_URL, _NO_BASE, _DENIED_BARE, _DENIED, _FAILED, _LOST = "API key is required", "Server URL is required", "Base URL is required", "Authentication failed", "Authentication failed (%d)", "Request failed with status %d", "Connection failed: %s"
# Where each provider's error body has its message, and what marks a failed sign-in there whatever the status is.
_MESSAGE = {"openai": "$.error.message", "anthropic": "$.error.message", "openrouter": "$.error.message", "openai-compatible": "$.error.message"}
_MARKS = {"openai": ("$.error.code", "invalid_api_key"), "anthropic": ("$.error.type", "authentication_error")}


def auth_answer(provider: Column, credential: Column, status: Column, body: Column, failure: Column) -> Column:
    """kind, error: what the answer of a provider to a sign-in says.

    ``credential`` is the key, or the URL of a server without keys or of one that is
    compatible with another's (``openai-compatible``: keys are optional there); ``failure`` is
    why there was no answer (null: there was one). kind is valid, missing,
    unreachable, denied or failed; error is null for valid.
    """
    said = F.try_parse_json(F.nullif(body, F.lit("")))

    def at(paths: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for name, path in paths.items():
            out = F.when(provider == name, F.try_variant_get(said, path, "string")).otherwise(out)
        return out

    mark = F.lit(False)
    for name, (path, value) in _MARKS.items():
        mark = mark | ((provider == name) & F.coalesce(F.try_variant_get(said, path, "string") == value, F.lit(False)))
    own = F.nullif(at(_MESSAGE), F.lit(""))
    text = F.nullif(body, F.lit(""))
    bare = ~provider.isin(*_MESSAGE)  # a provider without messages answers with plain text
    like = provider == "openai-compatible"
    kind = (
        F.when(F.when(like, F.coalesce(credential, F.lit("")) == "").otherwise(strings.is_blank(F.coalesce(credential, F.lit("")))), "missing")
        .when(failure.isNotNull(), "unreachable")
        .when(status.between(200, 299), "valid")
        .when(status.isin(401, 403) | mark, "denied")
        .otherwise("failed")
    )
    error = (
        F.when(kind == "missing", F.when(provider == "ollama", _NO_URL).when(like, _NO_BASE).otherwise(_NO_KEY))
        .when(kind == "unreachable", F.format_string(_LOST, failure))
        .when(kind == "denied", F.coalesce(F.when(bare, text).otherwise(own), F.when(like, _DENIED_BARE).otherwise(F.format_string(_DENIED, status))))
        .when(kind == "failed", F.coalesce(own, F.when(~like, text), F.format_string(_FAILED, status)))
    )
    return F.struct(kind.alias("kind"), error.alias("error"))


def form_errors(forms: DataFrame, servers: DataFrame) -> DataFrame:
    """Forms of tool servers (name, transport, command, url, editing: the id that is edited, or null) with ``id`` and their first ``error``."""
    ident = strings.slug(F.col("name"))
    rows = forms.withColumn("id", ident).join(servers.select(F.col("id"), F.lit(True).alias("_taken")), "id", "left")
    blank = lambda c: strings.is_blank(F.coalesce(c, F.lit("")))
    remote = F.col("transport").isin("http", "sse")
    # an absolute URL: a scheme, and for web schemes a host
    valid = strings.trim(F.col("url")).rlike(r"^(?i:(?:https?|wss?|ftp)://?[^/?#\s:]+(?::\d*)?(?:[/?#].*)?|(?!https?:|wss?:|ftp:)[a-z][a-z0-9+.-]*:.*)$")
    # Shown to users.
    error = (
        F.when(blank(F.col("name")), "Name is required")
        .when(F.col("id") == "", "Name must contain at least one letter or number")
        .when(F.col("_taken") & ~F.col("id").eqNullSafe(F.col("editing")), "A server with this name already exists")
        .when((F.col("transport") == "stdio") & blank(F.col("command")), "Command is required for stdio transport")
        .when(remote & blank(F.col("url")), "URL is required for HTTP/SSE transport")
        .when(remote & ~valid, "Invalid URL format")
    )
    return rows.withColumn("error", error).drop("_taken")


def optional_set(fields: DataFrame, stored: DataFrame) -> DataFrame:
    """provider and whether any field that is not required has a value (stored: provider, field, value)."""
    rows = fields.join(stored, ["provider", "field"], "left")
    given = ~F.coalesce("required", F.lit(False)) & (F.coalesce("value", F.lit("")) != "")
    return rows.groupBy("provider").agg(F.bool_or(given).alias("any_optional"))


def output_candidate(event: Column) -> Column:
    """Whether the output of an event (JSON) is an answer of the agent: an object with a list of messages."""
    return F.coalesce(_list(event, "$.data.output.messages").isNotNull(), F.lit(False))


def _list(event: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(event), path, "array<variant>")


def event_messages(event: Column) -> Column:
    """The messages of an event (JSON texts): of its output, else its chunk as a list, else its chunk's messages; what is no object is dropped."""
    found = F.coalesce(_list(event, "$.data.output.messages"), _list(event, "$.data.chunk"), _list(event, "$.data.chunk.messages"))
    texts = F.transform(found, lambda x: F.to_json(x))
    return F.coalesce(F.filter(texts, lambda t: F.left(t, F.lit(1)).isin("{", "[")), F.array().cast("array<string>"))
