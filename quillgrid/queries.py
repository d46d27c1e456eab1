"""The registered queries over the reference's operators, each with DuckDB SQL.

The tables stand in for a knowledge base: documents are notes, conversations are
threads, events are a log of checkpoints, writes and tool calls. SQL is written
from what the operators mean, not from their Spark code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions import dates, scripts, strings, values
from quillgrid.operators import catalog, metadata, search, threads
from quillgrid.plans.notes_query import NotesQuery, choice, folder, prop, tag
from quillgrid.sources import tables
from quillgrid.streaming import folds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_PATH = "lang || '/' || source || '/doc-' || doc_id || '.md'"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return tables.notes(tables.table(spark, d, "documents"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role", "text")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events")


# Search


def _grep_sql(query: str, most: int) -> str:
    return f"""
SELECT doc_id AS ord, {_PATH} AS path, 'doc-' || doc_id AS name, row_number() OVER (ORDER BY doc_id) AS n FROM (
  SELECT * FROM documents WHERE contains(lower('doc-' || doc_id), lower('{query}')) OR contains(lower(text), lower('{query}')) ORDER BY doc_id LIMIT {most})"""


def _grep(spark: SparkSession, d: str, query: str, most: int = 10) -> DataFrame:
    return search.numbered(search.grep(_notes(spark, d), query, most)).select("ord", "path", "name", "n")


@_query(_grep_sql("the", 10))
def grep_search(spark, d):
    return _grep(spark, d, "the")


@_query(_grep_sql("", 10))
def grep_search_empty_query(spark, d):
    return _grep(spark, d, "")


@_query(_grep_sql("%", 10))
def grep_search_literal_wildcards(spark, d):
    return _grep(spark, d, "%")


@_query(_grep_sql("ÜBER", 3))
def search_with_limit(spark, d):
    return _grep(spark, d, "ÜBER", 3)


@_query(_grep_sql("doc-1", 10))
def search_limit_is_capped(spark, d):
    return _grep(spark, d, "doc-1", 50)


@_query(f"""
WITH top AS (SELECT doc_id * 2 AS id, round(((doc_id * 37) % 101) / 101.0, 6) AS score FROM labels ORDER BY score DESC, id LIMIT 10)
SELECT {_PATH} AS path, 'doc-' || doc_id AS name, score FROM documents JOIN top ON doc_id = id""")
def ranked_hits_join(spark, d):
    notes = _notes(spark, d)
    hits = tables.table(spark, d, "labels").select((F.col("doc_id") * 2).alias("path"), F.round((F.col("doc_id") * 37) % 101 / 101.0, 6).alias("score"))
    found = search.ranked_hits(hits, notes.withColumns({"file": F.col("path"), "path": F.col("ord")}).select("path", F.col("file").alias("name"), "properties"))
    return found.select(F.col("name").alias("path"), F.concat(F.lit("doc-"), F.col("path").cast("string")).alias("name"), "score")


@_query("""
WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c),
r AS (SELECT doc_id, ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
                   + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM c, s)
SELECT doc_id AS ord, round(score, 4) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT 10""")
def bm25_search(spark, d):
    return search.bm25(_notes(spark, d), "the license").select("ord", F.round("score", 4).alias("score"))


_VECTOR_SQL = """
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (
  SELECT vec_id, list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS d,
         sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))) AS n
  FROM embeddings, q)
SELECT vec_id, round(d / n, 6) AS score FROM s {where} ORDER BY round(d / n, 6) DESC, vec_id LIMIT {most}"""


def _vector(spark, d, **limits):
    vectors = tables.table(spark, d, "embeddings")
    query = vectors.where("vec_id = 0").first()["embedding"]
    return search.vector_search(vectors, F.array(*[F.lit(float(x)) for x in query]), **limits)


@_query(_VECTOR_SQL.format(where="", most=100))
def vector_topk(spark, d):
    return _vector(spark, d)


@_query(_VECTOR_SQL.format(where="WHERE round(d / n, 6) >= 0.2", most=100))
def vector_threshold(spark, d):
    return _vector(spark, d, threshold=0.2)


@_query(f"SELECT count(*) AS n, min({_PATH}) AS first FROM documents WHERE NOT starts_with({_PATH}, 'en/') AND NOT starts_with({_PATH}, 'fr/src1/')")
def folders_excluded(spark, d):
    return search.within_folders(_notes(spark, d), ["en", "fr/src1/"]).agg(F.count("*").alias("n"), F.min("path").alias("first"))


@_query("SELECT DISTINCT lang AS folder FROM documents UNION SELECT DISTINCT lang || '/' || source FROM documents")
def all_folders(spark, d):
    return tables.folders(_notes(spark, d))


# Metadata


@_query("SELECT DISTINCT '#' || lang AS tag FROM documents UNION SELECT DISTINCT '#' || source FROM documents")
def distinct_tags(spark, d):
    return metadata.distinct_tags(_notes(spark, d))


@_query("SELECT tag, count(*) AS n_notes FROM (SELECT '#' || lang AS tag FROM documents UNION ALL SELECT '#' || source FROM documents) GROUP BY tag")
def tag_count(spark, d):
    return metadata.tag_counts(_notes(spark, d))


@_query("SELECT DISTINCT key FROM (SELECT unnest(json_keys(props)) AS key FROM events UNION ALL SELECT unnest(['lang', 'source', 'n_chars']) FROM documents)")
def distinct_property_keys(spark, d):
    props = _events(spark, d).select(F.col("props").alias("properties"))
    return metadata.property_keys(props.union(_notes(spark, d).select("properties")))


@_query("""
SELECT 'lang' AS key, lang AS value FROM documents WHERE doc_id = 7 UNION ALL SELECT 'source', source FROM documents WHERE doc_id = 7
UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id = 7""")
def note_properties_lookup(spark, d):
    return metadata.properties_of(_notes(spark, d), "doc-7")


def _first_path(spark, d):
    return _notes(spark, d).where("ord = 3").first()["path"]


@_query(f"SELECT {_PATH} AS path, text AS content FROM documents WHERE doc_id = 3")
def read_note(spark, d):
    return metadata.read_note(_notes(spark, d), _first_path(spark, d))


@_query(f"SELECT {_PATH} AS path, left(text, 100) || chr(10) || chr(10) || '... [Content truncated at 100 characters]' AS content FROM documents WHERE doc_id = 3")
def read_note_truncated(spark, d):
    return metadata.read_note(_notes(spark, d), _first_path(spark, d), 100)


@_query("SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY source")
def tag_search(spark, d):
    return metadata.tagged(_notes(spark, d), "de").groupBy(F.regexp_extract("path", "/([^/]+)/", 1).alias("source")).agg(F.count("*").alias("n"))


# Threads

_PAIRS = """
WITH m AS (SELECT conv_id, turn, role, text, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS pair
           FROM conversations WHERE role IN ('user', 'assistant') {and_}),
p AS (SELECT conv_id AS thread_id, pair, min(turn) AS first_seq, coalesce(max(text) FILTER (WHERE role = 'user'), '') AS user_text,
             count(*) FILTER (WHERE role = 'assistant') AS n_assistant,
             coalesce(CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 1 THEN max(text) FILTER (WHERE role = 'assistant')
                           ELSE arg_max(text, turn) FILTER (WHERE role = 'assistant' AND regexp_matches(text, '\\S')) END, '') AS content
      FROM m GROUP BY conv_id, pair, CASE WHEN pair = 0 THEN turn END)
"""


@_query(_PAIRS.format(and_="") + "SELECT thread_id, pair, first_seq, n_assistant FROM p")
def turn_pairs(spark, d):
    return threads.pairs(_messages(spark, d)).select("thread_id", "pair", "first_seq", "n_assistant")


@_query(_PAIRS.format(and_="") + "SELECT thread_id, pair, user_text, content FROM p")
def merged_assistant_content(spark, d):
    return threads.pairs(_messages(spark, d)).select("thread_id", "pair", "user_text", "content")


@_query(_PAIRS.format(and_="AND turn <> 0") + "SELECT thread_id, pair, first_seq, user_text, content FROM p WHERE pair = 0")
def orphan_assistant(spark, d):
    """Threads whose opening message counts as a system message, so that assistants come first."""
    opened = _messages(spark, d).withColumn("role", F.when(F.col("seq") == 0, "system").otherwise(F.col("role")))
    return threads.pairs(opened).where("pair = 0").select("thread_id", "pair", "first_seq", "user_text", "content")


@_query(
    _PAIRS.format(and_="")
    + """, e AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 150 GROUP BY user_id),
o AS (SELECT p.*, sum(CASE WHEN n_assistant = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY first_seq) AS open FROM p)
SELECT thread_id, pair, CASE WHEN n_assistant > 0 THEN 'success' WHEN open <= coalesce(errors, 0) THEN 'error' ELSE 'cancelled' END AS state
FROM o LEFT JOIN e ON user_id = thread_id"""
)
def turn_pair_states(spark, d):
    errors = _events(spark, d).where("event_type = 'error' AND value > 150").groupBy(F.col("user_id").alias("thread_id")).agg(F.count("*").alias("error_count"))
    return threads.pair_states(threads.pairs(_messages(spark, d)), errors).select("thread_id", "pair", "state")


@_query("SELECT conv_id AS thread_id, max(turn) AS seq, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_assistant_message(spark, d):
    return threads.last_message(_messages(spark, d), "assistant").select("thread_id", "seq", "text")


@_query("SELECT conv_id AS thread_id, left(arg_max(text, turn), 200) AS last_message_preview, arg_max(role, turn) AS last_message_role FROM conversations GROUP BY conv_id")
def thread_preview(spark, d):
    return threads.summaries(_messages(spark, d))


@_query("SELECT conv_id AS thread_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id")
def thread_title_source(spark, d):
    return threads.first_message(_messages(spark, d))


def _threads(spark, d):
    return _events(spark, d).groupBy(F.col("user_id").alias("thread_id")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


@_query("SELECT user_id AS thread_id, strftime(max(ts), '%d.%m.%y %H:%M') AS updated FROM events GROUP BY user_id")
def threads_by_recency(spark, d):
    return threads.by_recency(_threads(spark, d)).select("thread_id", dates.short_date(F.col("updated_at")).alias("updated"))


@_query("SELECT user_id AS thread_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 1")
def latest_thread(spark, d):
    return threads.by_recency(_threads(spark, d)).limit(1).select("thread_id")


def _checkpoints(spark, d):
    return _events(spark, d).select(F.col("user_id").alias("thread_id"), F.col("event_id").cast("string").alias("checkpoint_id"), F.col("event_type").alias("entry"))


@_query("SELECT user_id AS thread_id, max(CAST(event_id AS VARCHAR)) AS checkpoint_id, arg_max(event_type, CAST(event_id AS VARCHAR)) AS entry FROM events GROUP BY user_id")
def latest_checkpoint(spark, d):
    return threads.latest_checkpoint(_checkpoints(spark, d))


@_query("""
SELECT thread_id, checkpoint_id, n FROM (
  SELECT user_id AS thread_id, CAST(event_id AS VARCHAR) AS checkpoint_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(event_id AS VARCHAR) DESC) AS n
  FROM events WHERE CAST(event_id AS VARCHAR) < '5') WHERE n <= 4""")
def checkpoints_before(spark, d):
    return threads.checkpoints_before(_checkpoints(spark, d), "5", 4).select("thread_id", "checkpoint_id", "n")


@_query("""
SELECT user_id AS thread_id, count(*) FILTER (WHERE event_type = 'error') AS error_count,
       arg_max(coalesce(json_extract_string(props, '$.message'), 'Unknown error') || ' ' || event_id, event_id) FILTER (WHERE event_type = 'error' AND event_id % 4 <> 0) AS last_error
FROM events GROUP BY user_id""")
def error_count_last_error(spark, d):
    e = _events(spark, d)
    message = F.concat_ws(" ", F.coalesce(F.get_json_object("props", "$.message"), F.lit("Unknown error")), F.col("event_id").cast("string"))
    writes = e.select(F.col("user_id").alias("thread_id"), F.when(F.col("event_type") == "error", "__error__").otherwise("messages").alias("channel"), (F.col("event_id") % 4 != 0).alias("is_object"), message.alias("message"), "event_id")
    return threads.errors(writes, "event_id")


@_query("""
WITH w AS (SELECT user_id AS thread_id, CAST(event_id % 7 AS VARCHAR) AS checkpoint_id, event_id AS pos, event_type = 'error' AS e FROM events),
c AS (SELECT thread_id, max(checkpoint_id) AS chosen FROM w GROUP BY thread_id)
SELECT thread_id, checkpoint_id, pos, row_number() OVER (PARTITION BY thread_id ORDER BY checkpoint_id <> chosen, checkpoint_id, pos) AS n
FROM w JOIN c USING (thread_id) WHERE checkpoint_id = chosen OR e""")
def pending_writes_with_errors(spark, d):
    writes = _events(spark, d).select(F.col("user_id").alias("thread_id"), (F.col("event_id") % 7).cast("string").alias("checkpoint_id"), F.col("event_id").alias("at"), (F.col("event_type") == "error").alias("names_error"))
    chosen = writes.groupBy("thread_id").agg(F.max("checkpoint_id").alias("chosen"))
    rows = threads.writes_with_errors(writes, chosen)
    return rows.select("thread_id", "checkpoint_id", F.col("at").alias("pos"), F.row_number().over(Window.partitionBy("thread_id").orderBy("place")).cast("long").alias("n"))


@_query("""
WITH t AS (SELECT conv_id, min(text) AS title FROM conversations WHERE turn = 0 GROUP BY conv_id), c AS (SELECT user_id, max(event_id) AS ts FROM events WHERE event_type = 'error' AND value > 150 GROUP BY user_id)
SELECT coalesce(conv_id, user_id) AS thread_id, title, coalesce(CASE WHEN conv_id % 5 = 0 THEN conv_id END, ts, -1) AS updated_at FROM t FULL JOIN c ON conv_id = user_id""")
def thread_history_full_outer(spark, d):
    index = _messages(spark, d).where("seq = 0").groupBy("thread_id").agg(F.min("text").alias("title"))
    index = index.select("thread_id", "title", F.lit(None).cast("long").alias("created_at"), F.when(F.col("thread_id") % 5 == 0, F.col("thread_id")).alias("updated_at"))
    latest = _events(spark, d).where("event_type = 'error' AND value > 150").groupBy(F.col("user_id").alias("thread_id")).agg(F.max("event_id").alias("ts"))
    return threads.history(index, latest).select("thread_id", "title", F.coalesce("updated_at", F.lit(-1).cast("long")).alias("updated_at"))


_CALLS = "SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(event_id % 500 AS VARCHAR) END AS id FROM events WHERE event_type = 'click'"


def _calls(spark, d):
    ident = F.when(F.col("event_id") % 11 == 0, "").otherwise((F.col("event_id") % 500).cast("string"))
    return _events(spark, d).where("event_type = 'click'").select("event_id", F.col("user_id").alias("thread_id"), ident.alias("tool_call_id"))


def _results(spark, d):
    e = _events(spark, d).where("event_type <> 'click'")
    return e.select((F.col("event_id") % 500).cast("string").alias("tool_call_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "error").alias("status"), F.col("event_type").alias("text"))


@_query(f"""
WITH r AS (SELECT CAST(event_id % 500 AS VARCHAR) AS id, arg_max(event_type, event_id) AS output FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT event_id, output, CASE WHEN output = 'error' THEN 'failed' ELSE 'completed' END AS status FROM ({_CALLS}) c LEFT JOIN r USING (id)""")
def tool_result_left_join(spark, d):
    return threads.with_tool_results(_calls(spark, d), _results(spark, d)).select("event_id", "output", "status")


@_query("""
SELECT user_id AS thread_id, CASE WHEN bool_or(event_type = 'error' AND value > 150) THEN 'running' ELSE 'completed' END AS status,
       'Used ' || count(*) || CASE WHEN count(*) = 1 THEN ' tool' ELSE ' tools' END AS summary FROM events GROUP BY user_id""")
def tool_status_any_running(spark, d):
    calls = _events(spark, d).select(F.col("user_id").alias("thread_id"), F.when(F.expr("event_type = 'error' AND value > 150"), "running").otherwise("completed").alias("status"))
    return threads.tool_status(calls)


# Catalogue


@_query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def available_models_semi(spark, d):
    return catalog.available(tables.table(spark, d, "documents").select("doc_id"), tables.table(spark, d, "labels"), ["doc_id"])


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unconfigured_anti(spark, d):
    return catalog.unconfigured(tables.table(spark, d, "documents").select("doc_id"), tables.table(spark, d, "labels"), ["doc_id"])


@_query("SELECT 'empty' AS side, doc_id FROM documents UNION ALL SELECT 'some', doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_passthrough_empty(spark, d):
    docs, labels = tables.table(spark, d, "documents").select("doc_id"), tables.table(spark, d, "labels")
    none = catalog.semi_or_all(docs, labels.where("quality > 5"), ["doc_id"]).select(F.lit("empty").alias("side"), "doc_id")
    return none.union(catalog.semi_or_all(docs, labels.where("toxic = 1"), ["doc_id"]).select(F.lit("some").alias("side"), "doc_id"))


@_query("""
SELECT n_nationkey AS id, n_name AS label FROM nation UNION ALL
SELECT CAST(s_suppkey AS INTEGER), s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)""")
def provider_precedence(spark, d):
    built_in = tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    own = tables.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("label"))
    return catalog.prefer(built_in, own, "id")


@_query("""
SELECT coalesce(n_nationkey, k) AS key, coalesce(v, n_name) AS value FROM nation
FULL JOIN (SELECT s_nationkey + 5 AS k, max(s_name) AS v FROM supplier GROUP BY 1) ON k = n_nationkey""")
def default_merge(spark, d):
    defaults = tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    own = tables.table(spark, d, "supplier").groupBy((F.col("s_nationkey") + 5).alias("key")).agg(F.max("s_name").alias("value"))
    return catalog.merge_defaults(defaults, own, "key", "value")


@_query("SELECT doc_id, doc_id % 3 = 0 AS is_configured FROM documents ORDER BY is_configured DESC, doc_id")
def configured_first_sort(spark, d):
    rows = tables.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("is_configured"))
    return catalog.configured_first(rows, "doc_id")


@_query("SELECT lang AS grp, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY lang")
def grouped_options(spark, d):
    return catalog.grouped(tables.table(spark, d, "documents"), "lang", "doc_id")


@_query("SELECT n_name AS provider, count(*) AS n_models FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY n_name")
def provider_models_grouped(spark, d):
    providers = tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("provider"), "n_name", (F.col("n_regionkey") != 2).alias("is_configured"))
    models = tables.table(spark, d, "supplier").select(F.col("s_nationkey").alias("provider"))
    return catalog.provider_models(providers.withColumnRenamed("provider", "k").withColumn("provider", F.col("n_name")), models.join(providers.select("provider", "n_name"), "provider").select(F.col("n_name").alias("provider")))


@_query("SELECT 'hit' AS which, 7 AS ord UNION ALL SELECT 'first', min(doc_id) FROM documents")
def selected_model(spark, d):
    models = tables.table(spark, d, "documents").select(F.col("source").alias("provider"), F.col("doc_id").cast("string").alias("model"), F.col("doc_id").alias("ord"))
    source = models.where("ord = 7").first()["provider"]
    hit = catalog.selected(models, source, "7", "ord").select(F.lit("hit").alias("which"), "ord")
    return hit.union(catalog.selected(models, "none", "none", "ord").select(F.lit("first").alias("which"), "ord"))


@_query("""
SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'missing key' WHEN s BETWEEN 200 AND 299 THEN 'valid' WHEN s IN (401, 403) THEN 'invalid key' WHEN s = 429 THEN 'rate limited'
       WHEN s >= 500 THEN 'provider error' WHEN s IS NULL THEN 'unreachable' ELSE 'error' END AS state
FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 404 END AS s FROM events)""")
def provider_auth_state(spark, d):
    e, m = _events(spark, d), F.col("event_id") % 7
    status = F.when(m == 0, 200).when(m == 1, 401).when(m == 2, 403).when(m == 3, 429).when(m == 4, 500).when(m == 5, 404)
    return e.select("user_id", "event_id", catalog.auth_state(status, F.col("event_id") % 5 != 0).alias("state"))


# Scalar functions


def _documents(spark, d, *columns):
    return tables.table(spark, d, "documents").select("doc_id", *columns)


@_query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bth.*ing')")
def wildcard_match(spark, d):
    return tables.table(spark, d, "documents").where(strings.wildcard(F.col("text"), "th*ing")).select("doc_id")


@_query("SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugify(spark, d):
    return _documents(spark, d, strings.slug(F.col("text")).alias("slug"))


@_query("SELECT c_custkey, CASE WHEN length(c_name) > 9 THEN left(c_name, 3) || '...' || right(c_name, 4) ELSE c_name END AS masked FROM customer")
def mask_secret(spark, d):
    return tables.table(spark, d, "customer").select("c_custkey", strings.mask_secret(F.col("c_name")).alias("masked"))


@_query("""
SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_type, '_', ' '), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM (
  SELECT p_partkey, lower(replace(p_name || ' ' || p_type, ' ', '_')) AS p_type FROM part)""")
def title_case(spark, d):
    name = F.lower(F.regexp_replace(F.concat_ws(" ", "p_name", "p_type"), " ", "_"))
    return tables.table(spark, d, "part").select("p_partkey", strings.title_from_snake(name).alias("title"))


@_query("""SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '[<>:"/|?*\\\\]', '-', 'g'), '\\s+', ' ', 'g')), 100) AS name FROM documents""")
def sanitize_filename(spark, d):
    return _documents(spark, d, strings.file_name(F.col("text")).alias("name"))


@_query("SELECT event_id, 'Chat ' || strftime(ts, '%Y-%m-%d %H-%M-%S') AS thread_id FROM events")
def thread_id_format(spark, d):
    return _events(spark, d).select("event_id", dates.thread_id(F.lit("Chat"), F.col("ts")).alias("thread_id"))


@_query("SELECT event_id, epoch_us(ts) // 1000 AS millis, true AS valid FROM events")
def uuid7_timestamp(spark, d):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    value = dates.uuid7(millis, F.md5(F.col("event_id").cast("string")))
    return _events(spark, d).select("event_id", dates.uuid7_millis(value).alias("millis"), dates.is_uuid7(value).alias("valid"))


@_query("SELECT doc_id, lang || '/' || coalesce(trim(regexp_extract(text, '^[^\\n=]*')), '') AS language, source || '=x' AS origin, CAST(2 AS BIGINT) AS n FROM documents")
def parse_kv_lines(spark, d):
    first = F.regexp_replace(F.regexp_extract(F.coalesce("text", F.lit("")), "^[^\\n=]*", 0), "^ +| +$", "")
    lines = F.concat(F.lit("LANG=first\n\n no separator\n =blank\nLANG = "), F.col("lang"), F.lit("/"), first, F.lit("\nSRC="), F.col("source"), F.lit("=x "))
    found = strings.key_values(lines, "=")
    return _documents(spark, d, found["LANG"].alias("language"), found["SRC"].alias("origin"), F.size(found).cast("long").alias("n"))


@_query("SELECT doc_id, regexp_extract('x - ' || source || ' - ' || lang, '[^ ]+$') AS tail, 'Chat ' || lang AS thread, source || ':' || lang AS key FROM documents")
def names_and_keys(spark, d):
    name = F.concat(F.lit("x - "), F.col("source"), F.lit(" - "), F.col("lang"))
    return _documents(spark, d, strings.last_segment(F.concat(F.lit("a:"), F.col("lang"))).alias("tail"), strings.thread_name(name).alias("thread"), strings.composite_key(F.col("source"), F.col("lang")).alias("key"))


@_query("""SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN text || text ELSE text END AS text FROM conversations WHERE turn % 5 <> 4""")
def message_normalization(spark, d):
    return _normalized(spark, d, F.col("text"), F.col("text"))


def _normalized(spark, d, t, second):
    m = F.col("turn") % 5
    plain = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    kind = F.when(F.col("role") == "user", "HumanMessage").when(F.col("role") == "assistant", "AIMessage").otherwise("SystemMessage")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), t.alias("text")), F.struct(F.lit("text").alias("type"), second.alias("text"))))
    content = F.when(F.col("turn") % 4 == 3, blocks).otherwise(F.regexp_extract(F.to_json(F.struct(t.alias("c"))), r'^\{"c":([\s\S]*)\}$', 1))
    raw = (
        F.when(m == 0, F.concat(F.lit('{"id":["core","'), kind, F.lit('"],"kwargs":{"content":'), content, F.lit("}}")))
        .when(m == 1, F.concat(F.lit('{"type":"'), plain, F.lit('","data":{"content":'), content, F.lit("}}")))
        .when(m == 4, F.concat(F.lit('{"type":"else","content":'), content, F.lit("}")))
        .otherwise(F.concat(F.lit('{"type":"'), plain, F.lit('","content":'), content, F.lit("}")))
    )
    rows = tables.table(spark, d, "conversations").select("conv_id", "turn", values.message(raw).alias("m"))
    return rows.where("m.role IS NOT NULL").select("conv_id", "turn", "m.role", "m.text")


# Note queries


@_query(f"SELECT {_PATH} AS link FROM documents WHERE lang = 'de' AND source <> 'src3' ORDER BY doc_id LIMIT 10")
def notes_query_list(spark, d):
    return NotesQuery(source=tag("de") & ~tag("src3"), sort=(F.col("ord"),), limit=10).run(_notes(spark, d))


@_query(f"SELECT {_PATH} AS link, source AS \"Source\", CASE WHEN n_chars > 3000 THEN 'long' ELSE 'short' END AS \"Size\" FROM documents WHERE lang = 'en' AND n_chars > 2500 AND source <> 'src1' ORDER BY n_chars DESC, doc_id LIMIT 10")
def notes_query_table(spark, d):
    fields = {"Source": prop("source"), "Size": choice(prop("n_chars", "bigint") > 3000, "long", "short")}
    query = NotesQuery(fields, source=folder("en") & ~folder("en/src1"), where=prop("n_chars", "bigint") > 2500, sort=(F.desc(prop("n_chars", "bigint")), F.col("ord")), limit=10)
    return query.run(_notes(spark, d))


@_query(f"SELECT source AS key, count(*) OVER (PARTITION BY source) AS n, doc_id AS ord, {_PATH} AS link, 'doc-' || doc_id AS name FROM documents WHERE lang = 'es'")
def notes_query_group_by(spark, d):
    return NotesQuery({"name": F.col("name")}, source=tag("es"), group=prop("source")).run(_notes(spark, d))


@_query(f"SELECT {_PATH} AS link, t AS tag FROM (SELECT *, unnest(['#' || lang, '#' || source]) AS t FROM documents) ORDER BY t, doc_id LIMIT 25 OFFSET 5")
def notes_query_flatten(spark, d):
    return NotesQuery({"tag": F.col("one")}, flatten=("one", F.col("tags")), sort=(F.col("one"), F.col("ord")), limit=25, offset=5).run(_notes(spark, d))


# Streams


def _stream_events(spark, d, events=None, *more):
    """A table of events, or a stream of them, as chat events."""
    e = _events(spark, d) if events is None else events
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("click", "tool_start"), ("view", "tool_end"), ("purchase", "token"), ("error", "result")) for x in pair]), F.col("event_type"))
    return e.select(
        F.col("user_id").cast("string").alias("thread_id"),
        F.floor(F.col("event_id") / 1000).cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.coalesce(kind, F.lit("checkpoint_message")).alias("type"),
        F.concat(F.lit("t"), (F.col("event_id") % 10).cast("string")).alias("token"),
        (F.col("event_id") % 60).cast("string").alias("tool_call_id"),
        F.lit("tool").alias("tool_name"),
        F.col("props").alias("input"),
        F.col("event_type").alias("output"),
        *more,
    )


_STREAM = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS thread_id, CAST(event_id // 1000 AS VARCHAR) AS run_id, event_id AS seq, event_type, props, CASE event_type WHEN 'click' THEN 'tool_start' WHEN 'view' THEN 'tool_end' WHEN 'purchase' THEN 'token' WHEN 'error' THEN 'result' ELSE 'checkpoint_message' END AS type,
                  't' || (event_id % 10) AS token, CAST(event_id % 60 AS VARCHAR) AS tool_call_id FROM events),
tool AS (SELECT thread_id, run_id, tool_call_id, min(seq) AS first_seq, 'tool' AS tool_name, CASE WHEN bool_or(type = 'tool_end') THEN 'completed' ELSE 'running' END AS status,
                coalesce(arg_max(props, seq) FILTER (WHERE type = 'tool_start'), '{}') AS input, arg_max(event_type, seq) FILTER (WHERE type = 'tool_end') AS output
         FROM e WHERE type IN ('tool_start', 'tool_end') GROUP BY thread_id, run_id, tool_call_id)
"""


@_query(_STREAM + "SELECT thread_id, seq // 4000 AS part, string_agg(token, '' ORDER BY seq) AS text FROM e WHERE type = 'token' GROUP BY thread_id, part")
def token_concat(spark, d):
    return threads.joined_tokens(folds.forwarded(_stream_events(spark, d)).where("type = 'token'"), span=4000)


@_query(_STREAM + "SELECT * FROM tool")
def tool_correlation(spark, d):
    return folds.correlated(_stream_events(spark, d))


_FOLDED = (
    _STREAM
    + """, n AS (SELECT thread_id, run_id, count(*) AS n_tools, count(*) FILTER (WHERE status = 'running') AS n_running FROM tool GROUP BY thread_id, run_id)
SELECT thread_id, run_id, coalesce(string_agg(token, '' ORDER BY seq) FILTER (WHERE type = 'token'), '') AS content, coalesce(any_value(n_tools), 0) AS n_tools, coalesce(any_value(n_running), 0) AS n_running, bool_or(type = 'result') AS has_result
FROM e LEFT JOIN n USING (thread_id, run_id) WHERE type <> 'checkpoint_message' GROUP BY thread_id, run_id"""
)


@_query(_FOLDED)
def stream_fold(spark, d):
    return folds.folded(_stream_events(spark, d))


@_query(_STREAM + "SELECT thread_id, arg_max(event_type, seq) FILTER (WHERE type = 'result') AS output, arg_max(seq, seq) FILTER (WHERE type = 'result') IS NULL AS failed FROM e GROUP BY thread_id")
def latest_output(spark, d):
    return folds.latest_output(_stream_events(spark, d))


# Settings, stores and rendering


def _providers(spark, d):
    """Nations as providers; their models are the suppliers there."""
    nations = tables.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("provider"), (F.col("n_regionkey") != 1).alias("is_configured"))
    models = tables.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.map_from_entries(F.collect_list(F.struct("s_name", "s_acctbal"))).alias("chat_models"))
    return nations.join(models, "n_nationkey", "left").select("provider", "is_configured", "chat_models")


@_query("SELECT n_name AS provider, s_name AS model FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 1")
def configured_models(spark, d):
    return catalog.configured_models(_providers(spark, d))


@_query("SELECT n_name AS provider, r_name AS state FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey")
def provider_states(spark, d):
    states = tables.table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("provider"), F.col("r_name").alias("state"))
    nations = tables.table(spark, d, "nation").select(F.col("n_regionkey").alias("provider"), "n_name")
    return catalog.provider_states(nations, states).select(F.col("n_name").alias("provider"), "state")


@_query("SELECT n_name AS provider FROM nation WHERE n_regionkey IN (0, 3) AND n_nationkey % 2 = 0")
def unavailable_providers(spark, d):
    nations = tables.table(spark, d, "nation")
    providers = nations.select(F.col("n_name").alias("provider"), (F.col("n_nationkey") % 2 == 0).alias("is_configured"))
    states = nations.where("n_regionkey < 4").select(F.col("n_name").alias("provider"), F.col("n_regionkey").isin(1, 2).alias("auth_ok"))
    return catalog.unavailable(providers, states)


@_query("SELECT DISTINCT event_type AS tool, event_type <> 'error' AND event_type <> 'view' AS enabled FROM events")
def tool_enabled(spark, d):
    tools = _events(spark, d).select(F.col("event_type").alias("tool")).distinct()
    settings = tools.where("tool IN ('error', 'view', 'click')").withColumn("enabled", F.col("tool") == "click")
    return catalog.tool_enabled(tools, settings)


@_query("SELECT 'required' AS kind, count(*) AS n FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'optional', count(*) FROM part WHERE p_size % 2 = 1")
def auth_fields(spark, d):
    fields = tables.table(spark, d, "part").select((F.col("p_size") % 2 == 0).alias("required"))
    count = lambda required, kind: catalog.auth_fields(fields, required).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(True, "required").union(count(False, "optional"))


@_query("SELECT p_brand AS grp, count(*) AS n FROM part WHERE contains(lower(p_name), lower('R')) GROUP BY p_brand")
def options_filter(spark, d):
    options = tables.table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_name").alias("label"))
    return search.filter_options(options, "R").groupBy("grp").agg(F.count("*").alias("n"))


_SNAPSHOTS = """
WITH i AS (SELECT user_id AS thread_id, min(event_id) AS created_at, max(event_id) AS updated_at FROM events GROUP BY user_id),
s AS (SELECT conv_id AS thread_id, max(turn) AS created_at, max(turn) + 1000 AS updated_at FROM conversations GROUP BY conv_id)
"""


@_query(_SNAPSHOTS + "SELECT coalesce(i.thread_id, s.thread_id) AS thread_id, CASE WHEN s.thread_id IS NULL THEN 'old' ELSE 'new' END AS title, coalesce(i.created_at, s.created_at) AS created_at, coalesce(s.updated_at, i.updated_at) AS updated_at FROM i FULL JOIN s ON i.thread_id = s.thread_id")
def snapshot_upsert(spark, d):
    none = F.lit(None).cast("string").alias("metadata")
    index = _events(spark, d).groupBy(F.col("user_id").alias("thread_id")).agg(F.min("event_id").alias("created_at"), F.max("event_id").alias("updated_at"))
    new = _messages(spark, d).groupBy("thread_id").agg(F.max("seq").alias("created_at"), (F.max("seq") + 1000).alias("updated_at"))
    index, new = index.select("*", F.lit("old").alias("title"), none), new.select("*", F.lit("new").alias("title"), none)
    return threads.write_snapshots(index, new).select("thread_id", "title", "created_at", "updated_at")


@_query("SELECT user_id AS thread_id, arg_max(CAST(event_id AS VARCHAR), event_id) AS v FROM events WHERE event_type = 'error' AND value > 150 GROUP BY user_id UNION ALL SELECT DISTINCT user_id, 'old' FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)")
def store_upsert_last_wins(spark, d):
    e = _events(spark, d)
    now = e.select(F.col("user_id").alias("thread_id")).distinct().withColumn("v", F.lit("old"))
    changes = e.where("event_type = 'error' AND value > 150").select(F.col("user_id").alias("thread_id"), F.col("event_id").cast("string").alias("v"), F.col("event_id").alias("at"))
    return tables.upsert(now, changes, "thread_id", "at")


@_query("SELECT DISTINCT conv_id AS thread_id FROM conversations WHERE conv_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)")
def thread_delete(spark, d):
    gone = _events(spark, d).where("event_type = 'error' AND value > 150").select(F.col("user_id").alias("thread_id"))
    return tables.delete(_messages(spark, d).select("thread_id").distinct(), gone, "thread_id")


@_query("SELECT n_name AS provider, s_name AS model FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0")
def discovered_models(spark, d):
    """Discovery answers of both forms with blank, missing and null ids, read back."""
    rows = tables.table(spark, d, "supplier").join(tables.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ident = F.when(F.col("s_suppkey") % 3 == 0, F.when(F.col("s_suppkey") % 2 == 0, " ")).otherwise(F.col("s_name"))
    listed = rows.groupBy("n_name").agg(F.collect_list(F.struct(ident.alias("id"))).alias("data"), F.collect_list(F.struct(ident.alias("name"))).alias("models"))
    first = F.to_json(F.struct("data"))
    body = F.when(F.length("n_name") % 2 == 0, first).otherwise(F.to_json(F.struct("models")))
    return tables.discovered_models(listed.select(F.col("n_name").alias("provider"), body.alias("body")))


@_query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN props WHEN 2 THEN '{\"value\":[1,2]}' WHEN 3 THEN '{\"value\":7}' ELSE '{\"input\":\"not json\"}' END AS input FROM events")
def tool_inputs(spark, d):
    m = F.col("event_id") % 5
    raw = F.when(m == 1, F.col("props")).when(m == 2, "[1,2]").when(m == 3, "7").when(m == 4, "not json")
    return _events(spark, d).select("event_id", values.tool_input(raw).alias("input"))


@_query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' ELSE 'id' || event_id END AS id, CASE event_id % 4 WHEN 0 THEN replace(props, ': ', ':') WHEN 1 THEN '{\"a\":1}' ELSE '{}' END AS args FROM events")
def tool_calls_parsed(spark, d):
    m, ident = F.col("event_id") % 4, F.concat(F.lit('{"id":"id'), F.col("event_id").cast("string"), F.lit('","args":'))
    raw = F.when(m == 0, F.concat(ident, F.col("props"), F.lit("}"))).when(m == 1, F.concat(ident, F.lit('"{\\"a\\":1}"}'))).when(m == 2, F.concat(ident, F.lit("[3]}"))).otherwise('{"id":4,"arguments":"x"}')
    return _events(spark, d).select("event_id", values.tool_call(raw).alias("c")).select("event_id", "c.id", "c.args")


@_query("SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE event_type END AS token FROM events")
def token_extraction(spark, d):
    m, text = F.col("event_id") % 6, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    wrap = lambda a, b: F.concat(F.lit(a), text, F.lit(b))
    chunk = (
        F.when(m == 0, text)
        .when(m == 1, wrap('[{"text":', '},""]'))
        .when(m == 2, wrap('{"content":[', "]}"))
        .when(m == 3, wrap('{"message":{"content":', "}}"))
        .when(m == 4, wrap('{"content":"","delta":{"text":', "}}"))
        .otherwise('{"other":1}')
    )
    return _events(spark, d).select("event_id", values.chunk_text(chunk).alias("token"))


@_query("SELECT user_id, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS millis FROM events GROUP BY user_id")
def run_duration(spark, d):
    ts = F.col("ts").cast("timestamp")
    return _events(spark, d).groupBy("user_id").agg(dates.duration_millis(F.min(ts), F.max(ts)).alias("millis"))


@_query("SELECT conv_id AS thread_id, 'kept' AS own, 'run' || max(turn) AS last_run, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def metadata_merge(spark, d):
    existing = F.create_map(F.lit("own"), F.lit("kept"), F.lit("lastRunId"), F.lit("old"))
    added = F.create_map(F.lit("lastRunId"), F.concat(F.lit("run"), F.col("seq").cast("string")), F.lit("lastMessageRole"), F.col("role"))
    merged = threads.last_message(_messages(spark, d)).select("thread_id", threads.merge_metadata(existing, added).alias("m"))
    return merged.select("thread_id", F.col("m")["own"].alias("own"), F.col("m")["lastRunId"].alias("last_run"), F.col("m")["lastMessageRole"].alias("role"))


@_query(
    _PAIRS.format(and_="")
    + """, e AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 150 GROUP BY user_id),
o AS (SELECT p.*, sum(CASE WHEN n_assistant = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY first_seq) AS open FROM p)
SELECT thread_id, pair, CASE WHEN n_assistant > 0 THEN content WHEN open <= coalesce(errors, 0) THEN '> [!Error] an error occured' ELSE '> [!Warning] stopped by user' END AS shown
FROM o LEFT JOIN e ON user_id = thread_id"""
)
def pair_text_shown(spark, d):
    errors = _events(spark, d).where("event_type = 'error' AND value > 150").groupBy(F.col("user_id").alias("thread_id")).agg(F.count("*").alias("error_count"))
    states = threads.pair_states(threads.pairs(_messages(spark, d)), errors)
    return states.select("thread_id", "pair", threads.state_text(F.col("state"), F.col("content")).alias("shown"))


@_query("SELECT CAST(user_id AS VARCHAR) AS thread_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error') GROUP BY user_id")
def event_forwarding(spark, d):
    return folds.forwarded(_stream_events(spark, d)).groupBy("thread_id").agg(F.count("*").alias("n"))


@_query(f"SELECT string_agg(n || '. ' || name || ' (' || path || ')', chr(10) ORDER BY n) AS text FROM ({_grep_sql('the', 10)})")
def search_rendered(spark, d):
    hits = _grep(spark, d, "the").select("n", strings.render_hits(F.col("n"), F.col("name"), F.col("path")).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("n", "line")))  # ten at most
    return hits.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


@_query("SELECT doc_id, trim(text, ' \t\n\r') AS title FROM documents")
def title_cleanup(spark, d):
    return _documents(spark, d, strings.clean_title(F.concat(F.lit('"'), F.col("text"), F.lit("'"))).alias("title"))


@_query("SELECT o_orderkey, CAST(floor(o_totalprice / 60) AS BIGINT) || ' min ' || (CAST(floor(o_totalprice) AS BIGINT) % 60) || ' sec' AS left_, CAST(least(round(o_totalprice / 1000), 100) AS BIGINT) AS percent FROM orders")
def time_and_percent(spark, d):
    price = F.col("o_totalprice")
    return tables.table(spark, d, "orders").select("o_orderkey", dates.minutes_left(price).alias("left_"), dates.percent(price, 100_000).alias("percent"))


@_query("SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ' ')[:-2], lambda w: 'x' || regexp_replace(w, '[\\]\\[|\\n]', '', 'g')), ' ') AS links FROM documents")
def wiki_links(spark, d):
    """Every word but the last of a text as a link with an alias."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    plain = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: F.concat(F.lit("[[x"), F.regexp_replace(w, r"[\]\[|\n]", ""), F.lit("|alias]] and [[open\n]]")))
    return _documents(spark, d, F.array_join(strings.wiki_links(F.array_join(plain, " ")), " ").alias("links"))


@_query("""
SELECT doc_id, CAST(len(a) AS BIGINT) AS n, array_to_string(a, '|') AS joined FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:"[^"]*(?:"|\\z)|''[^'']*(?:''|\\z)|[^ "''])+'),
                             lambda w: regexp_replace(w, '"([^"]*)(?:"|\\z)|''([^'']*)(?:''|\\z)', '\\1\\2', 'g')), lambda w: w <> '') AS a FROM documents)""")
def command_arguments(spark, d):
    return _documents(spark, d, scripts.arguments(F.col("text")).alias("a")).select("doc_id", F.size("a").cast("long").alias("n"), F.array_join("a", "|").alias("joined"))


def _fuzzy_sql(query: str) -> str:
    """Every alignment's score, a character at a time, as joins of places."""
    steps = "".join(
        f""", d{n} AS (SELECT c.path, c.i, max(w + CASE WHEN d.i = c.i - 1 THEN d.s + 8 ELSE d.s - (c.i - d.i - 1) END) AS s FROM c JOIN d{n - 1} d ON c.path = d.path AND d.i < c.i WHERE c.c = '{x}' GROUP BY ALL)"""
        for n, x in enumerate(query)
        if n
    )
    return f"""
WITH p AS (SELECT DISTINCT {_PATH} AS path FROM documents),
c AS (SELECT path, i, substr(lower(path), i, 1) AS c,
        16 + CASE WHEN regexp_matches(substr(lower(path), i, 1), '[\\p{{L}}\\p{{N}}]') AND (i = 1 OR NOT regexp_matches(substr(lower(path), i - 1, 1), '[\\p{{L}}\\p{{N}}]')) THEN 8 ELSE 0 END AS w
      FROM (SELECT path, unnest(range(1, length(path) + 1)) AS i FROM p)),
d0 AS (SELECT path, i, w AS s FROM c WHERE c = '{query[0]}'){steps}
SELECT path, CAST(max(s) AS BIGINT) AS score FROM d{len(query) - 1} GROUP BY path ORDER BY score DESC, length(path), path LIMIT 10"""


@_query(_fuzzy_sql("fs1d"))
def fuzzy_paths(spark, d):
    """Our own scorer: the best of all alignments."""
    return search.fuzzy(_notes(spark, d).select("path"), "fs1d").select("path", "score")
