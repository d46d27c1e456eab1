"""Catalogues of providers and models: semi, anti and outer joins, precedence, grouping.

Sides are left to the optimiser, which broadcasts only what it knows is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import strings


def available(configured: DataFrame, discovered: DataFrame, keys: list[str]) -> DataFrame:
    return configured.join(discovered, keys, "left_semi")


def unconfigured(discovered: DataFrame, configured: DataFrame, keys: list[str]) -> DataFrame:
    return discovered.join(configured, keys, "left_anti")


def semi_or_all(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` with a partner in ``right``, all of them if ``right`` is empty (which one row tells)."""
    return left if right.isEmpty() else left.join(right, keys, "left_semi")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have a key, the one of ``first``."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def merge_defaults(defaults: DataFrame, own: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of either side with its own value, else the default."""
    mine = own.select(key, F.col(value).alias("_own"))
    return defaults.join(mine, key, "full_outer").select(key, F.coalesce("_own", value).alias(value))


def configured_first(rows: DataFrame, order: str) -> DataFrame:
    return rows.orderBy(F.desc("is_configured"), order)


def grouped(options: DataFrame, group: str, order: str) -> DataFrame:
    """Groups in the order they are first seen (a sort over all tasks, no ranking in one), with their size and first place."""
    rows = options.groupBy(F.coalesce(group, F.lit("")).alias("grp")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return rows.orderBy("first_seen", "grp")


def selected(models: DataFrame, provider: str, model: str, order: str) -> DataFrame:
    """The chosen model if it is there, else the first, else none."""
    chosen = (F.col("provider") == provider) & (F.col("model") == model)
    return models.orderBy(F.desc(chosen), order).limit(1)


def provider_models(providers: DataFrame, models: DataFrame) -> DataFrame:
    """Configured providers with how many models they have; those without any are dropped."""
    return providers.where("is_configured").join(models, "provider").groupBy("provider").agg(F.count("*").alias("n_models"))


def unavailable(providers: DataFrame, states: DataFrame) -> DataFrame:
    """Configured providers whose state is known and whose sign-in failed."""
    return providers.where("is_configured").join(states.where("NOT auth_ok"), "provider").select("provider")


def with_fallback(tools: DataFrame, defaults: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Tools with the default of each column where their own is missing."""
    side = defaults.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return tools.join(side, key, "left").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def enabled_prompts(extensions: DataFrame) -> DataFrame:
    """Prompts of enabled extensions of enabled plugins in order, as one text (settings: some rows)."""
    rows = extensions.where(F.col("enabled") & F.col("plugin_enabled") & ~strings.is_blank(F.col("prompt")))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "prompt"))), lambda x: x["prompt"]), "\n\n").alias("prompt"))


def server_connection() -> Column:
    """How to reach a tool server, by its transport; empty settings are left out."""
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    local = F.to_json(F.struct(F.lit("stdio").alias("transport"), "command", "args", full("env").alias("env")))
    remote = F.to_json(F.struct(F.col("transport"), "url", full("headers").alias("headers")))
    return F.when(F.col("transport") == "stdio", local).when(F.col("transport").isin("http", "sse"), remote)


def enabled_servers(servers: DataFrame) -> DataFrame:
    return servers.where("enabled").select("id", server_connection().alias("connection"))


def auth_state(status: Column, has_key: Column) -> Column:
    """What an answer of a provider says of the sign-in."""
    return (
        F.when(~has_key, "missing key")
        .when(status.between(200, 299), "valid")
        .when(status.isin(401, 403), "invalid key")
        .when(status == 429, "rate limited")
        .when(status >= 500, "provider error")
        .when(status.isNull(), "unreachable")
        .otherwise("error")
    )


def slug_conflicts(servers: DataFrame, name: str = "name") -> DataFrame:
    """Ids that more than one server name would get."""
    ids = servers.select(strings.slug(F.col(name)).alias("id"))
    return ids.where("id <> ''").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def configured_models(providers: DataFrame, models: str = "chat_models") -> DataFrame:
    """provider and model of each entry of the providers' model maps."""
    return providers.where("is_configured").select("provider", F.explode(F.map_keys(models)).alias("model"))


def tool_enabled(tools: DataFrame, settings: DataFrame, key: str = "tool") -> DataFrame:
    """Tools with their setting; a tool without one is enabled."""
    return tools.join(settings.select(key, F.col("enabled").alias("_own")), key, "left").select(key, F.coalesce("_own", F.lit(True)).alias("enabled"))


def auth_fields(fields: DataFrame, required: bool) -> DataFrame:
    return fields.where(F.coalesce("required", F.lit(False)) == required)


def provider_states(providers: DataFrame, states: DataFrame) -> DataFrame:
    """Every provider with its discovery state, null where it has not answered yet."""
    return providers.join(states, "provider", "left")
