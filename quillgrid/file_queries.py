"""More registered queries: files of notes and chats, streams, stores with conflicts, answers of providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import dates, scripts, strings, values
from quillgrid.operators import catalog, metadata, search, sql_tools, stores, threads
from quillgrid.operators.ranked_index import RankedIndex
from quillgrid.plans.notes_query import NotesQuery, folder, prop, tag
from quillgrid.queries import _FOLDED, _PAIRS, _PATH, _STREAM, _documents, _events, _messages, _notes, _query, _stream_events
from quillgrid.sources import chats, index, markdown, tables
from quillgrid.sources.scratch import new_path
from quillgrid.streaming import folds, log, views

# Files


@_query("""
SELECT doc_id, 'doc-' || doc_id AS name, 'lang: ' || lang AS front_matter, '#' || source AS tag, 'doc-' || (doc_id + 1) AS link, 'Head ' || doc_id AS heading, sha256(text) AS body
FROM (SELECT doc_id, lang, source, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM documents)""")
def markdown_notes(spark, d):
    """Documents as bytes of markdown files, each with a byte that is not UTF-8, read back."""
    ident = F.col("doc_id").cast("string")
    head = F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\n---\n# Head "), ident, F.lit("\n#"), F.col("source"), F.lit(" [[doc-"), (F.col("doc_id") + 1).cast("string"), F.lit("|next]]\n"))
    raw = F.concat(head.cast("binary"), F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("0AE9")))
    files = tables.table(spark, d, "documents").select(F.concat(F.lit("notes/doc-"), ident, F.lit(".md")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).alias("length"), raw.alias("content"))
    body = F.sha2(F.regexp_extract("content", r"\|next\]\]\n([\s\S]*)\n�$", 1), 256)
    out = markdown.parsed_notes(files)
    return out.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("doc_id"), "name", "front_matter", F.get("tags", F.lit(0)).alias("tag"), F.get("links", F.lit(0)).alias("link"), F.get("headings", F.lit(0)).alias("heading"), body.alias("body"))


def _built_notes(spark, d):
    """Documents as markdown files with front matter (every 7th malformed, every 11th without), a fence and code that hold no tags, and tags that count."""
    ident, text = F.col("doc_id").cast("string"), F.regexp_replace(F.coalesce("text", F.lit("")), "[`#~]", "")
    front = F.concat(
        F.lit("---\nlang: "), "lang", F.lit("\nsize: "), F.length(text).cast("string"), F.lit("\n\"quoted key\": 'it''s: "), ident, F.lit("' # said\ntags:\n  - "), "source", F.lit("\n  - \"two words\"\nnested: {list: [1, "), ident,
        F.lit("], flag: true}\nposition:\n  line: 0\n---\n"),
    )
    front = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 7 == 0, "---\nlang: [open\nlang: x\n---\n").otherwise(front)
    body = F.concat(F.lit("# Head "), ident, F.lit(" ##\n#"), "lang", F.lit(" and #2024 `#code`\n\n````md\n#fenced [[no]]\n```\n# no head\n\n````\n~~~\n#closed\n~~~\n"), text, F.lit("\n#end/"), "source", F.lit(" [[doc-"), (F.col("doc_id") + 1).cast("string"), F.lit("|next]]\n```\n#open"))
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc-"), ident, F.lit(".md")))
    files = tables.table(spark, d, "documents").select(path.alias("path"), F.timestamp_seconds("doc_id").alias("modificationTime"), F.lit(1).cast("long").alias("length"), F.concat(front.cast("binary"), body.cast("binary")).alias("content"))
    return markdown.parsed_notes(files)


_BUILT = r"""
WITH n AS (SELECT doc_id, lang, source, lang || '/' || source || '/doc-' || doc_id || '.md' AS path, 'doc-' || doc_id AS name, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AS fine,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'lang: [open lang: x' ELSE 'lang: size: "quoted key": said tags: "two words" nested: list: flag: true position: line: 0' END AS head,
  length(regexp_replace(coalesce(text, ''), '[`#~]', '', 'g')) AS size, regexp_replace(coalesce(text, ''), '[`#~]', '', 'g') AS text FROM documents),
t AS (SELECT doc_id, unnest(['#' || lang, '#end/' || source] || CASE WHEN fine THEN ['#' || source, '#two words'] ELSE [] END) AS tag FROM n)
"""


@_query(_BUILT + """SELECT path, name, '["' || array_to_string(['#' || lang, '#end/' || source] || CASE WHEN fine THEN ['#' || source, '#two words'] ELSE [] END, '","') || '"]' AS tags,
  '["Head ' || doc_id || '"]' AS headings, '["doc-' || (doc_id + 1) || '"]' AS links, CASE WHEN fine THEN '{"lang":"' || lang || '","size":' || size || ',"quoted key":"it''s: ' || doc_id || '","tags":["' || source || '","two words"],"nested":{"list":[1,' || doc_id || '],"flag":true},"position":{"line":0}}' END AS properties FROM n""")
def folder_notes(spark, d):
    """What is read from each file: no tag, heading or link of a fence or code; malformed front matter gives none and ends nothing."""
    notes = _built_notes(spark, d)
    return notes.select("path", "name", *[F.to_json(c).alias(c) for c in ("tags", "headings", "links")], "properties")


@_query(_BUILT + "SELECT path, name, row_number() OVER (ORDER BY path) AS n FROM (SELECT * FROM n WHERE contains(lower(text), 'license') OR contains(name, 'license') ORDER BY path LIMIT 10)")
def folder_grep(spark, d):
    return search.numbered(search.grep(_built_notes(spark, d), "LICENSE")).select("path", "name", "n")


@_query(_BUILT + "SELECT tag, count(*) AS n_notes FROM t GROUP BY tag")
def folder_tags(spark, d):
    return metadata.tag_counts(_built_notes(spark, d))


@_query("SELECT unnest(['lang', 'size', 'quoted key', 'tags', 'nested']) AS key FROM (SELECT 1 FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 LIMIT 1)")
def folder_property_keys(spark, d):
    return metadata.property_keys(_built_notes(spark, d))


@_query(_BUILT + "SELECT path AS link, size, 'it''s: ' || doc_id AS said, doc_id AS last, epoch_us(make_timestamp(doc_id * 1000000)) // 1000000 AS mtime FROM n WHERE fine AND lang = 'en' AND source <> 'src0' AND size > 500 ORDER BY size DESC, path LIMIT 50")
def folder_note_query(spark, d):
    """A table of notes by tag, folder, nested and quoted properties, and file time."""
    notes = _built_notes(spark, d)
    fields = {"size": prop("size", "long"), "said": prop("['quoted key']"), "last": prop("nested.list[1]", "long"), "mtime": F.unix_seconds("mtime")}
    return NotesQuery(fields, tag("en") & ~folder("en/src0"), F.col("properties").isNotNull() & (prop("size", "long") > 500), sort=(F.desc("_size"), F.asc("path")), limit=50).run(notes)


@_query("SELECT path, name FROM (SELECT 'en/src1/doc-' || min(doc_id) || '.md' AS path, 'doc-' || min(doc_id) AS name FROM documents WHERE lang = 'en' AND source = 'src1') WHERE path IS NOT NULL")
def folder_point_read(spark, d):
    """The note of a path, read whole."""
    notes = _built_notes(spark, d)
    wanted = tables.table(spark, d, "documents").where("lang = 'en' AND source = 'src1'").agg(F.concat(F.lit("en/src1/doc-"), F.min("doc_id").cast("string"), F.lit(".md")).alias("path")).first()["path"]
    return metadata.find_note(notes, wanted or "").select("path", "name")


@_query("""
WITH c AS (SELECT c_custkey AS k, 's' || (c_custkey // 2) AS t, c_custkey % 6 AS m FROM customer),
th AS (SELECT DISTINCT CASE WHEN k % 5 = 0 THEN t ELSE 'Chat ' || t END AS id, t FROM c),
f AS (SELECT 'chats/' || CASE m WHEN 0 THEN 'Chat ' || t WHEN 1 THEN 'Title ' || k || ' - ' || t WHEN 2 THEN 'old Chat ' || t || ' copy' WHEN 3 THEN 'A - B - ' || t WHEN 4 THEN t ELSE 'x ' || t || 'y' END || CASE WHEN k % 13 = 0 THEN '.txt' ELSE '.chat' END AS path FROM c),
p AS (SELECT id, path, CASE WHEN path = 'chats/' || id || '.chat' THEN 1 WHEN contains(path, id) THEN 2 WHEN path LIKE '% - ' || t || '.chat' THEN 3 END AS r FROM th, f WHERE path LIKE '%.chat')
SELECT id AS thread_id, (SELECT arg_min(path, {'r': r, 'path': path}) FROM p WHERE p.id = th.id AND r IS NOT NULL) AS path FROM th""")
def chat_files_of_threads(spark, d):
    """The file of every thread at once."""
    k = F.col("c_custkey")
    c = tables.table(spark, d, "customer").select(k.alias("k"), F.concat(F.lit("s"), F.floor(k / 2).cast("string")).alias("t"), (k % 6).alias("m"), k.cast("string").alias("id"))
    text = lambda *parts: F.concat(*[F.lit(p) if not isinstance(p, str) or p not in ("t", "id") else F.col(p) for p in parts])
    name = F.when(F.col("m") == 0, text("Chat ", "t")).when(F.col("m") == 1, text("Title ", "id", " - ", "t")).when(F.col("m") == 2, text("old Chat ", "t", " copy")).when(F.col("m") == 3, text("A - B - ", "t")).when(F.col("m") == 4, F.col("t")).otherwise(text("x ", "t", "y"))
    files = c.select(F.concat(F.lit("chats/"), name, F.when(F.col("k") % 13 == 0, ".txt").otherwise(".chat")).alias("path"))
    return chats.chat_paths(files, c.select(F.when(F.col("k") % 5 == 0, F.col("t")).otherwise(text("Chat ", "t")).alias("thread_id")))


@_query("""
WITH RECURSIVE c AS (SELECT c_custkey AS k, CASE WHEN c_custkey < 120 THEN 'chats/T' || (c_custkey % 3) ELSE 'chats/x' || c_custkey END || ' - s' || (c_custkey % 40) || '.chat' AS path,
  CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'chats/T' || ((c_custkey // 3) % 4) || '- - s' || (c_custkey % 40) || '.chat' END AS wanted FROM customer),
r AS (SELECT path, CASE WHEN k % 2 = 0 THEN replace(wanted, '- -', ' -') ELSE wanted END AS new_path, row_number() OVER (ORDER BY (k * 7919) % 100003, k) AS i FROM c WHERE wanted <> ''),
s(i, names, done) AS (
  SELECT 0, (SELECT list(path) FROM c), []::STRUCT(path VARCHAR, new_path VARCHAR)[]
  UNION ALL
  SELECT r.i, CASE WHEN list_contains(names, new_path) THEN names ELSE list_append(list_filter(names, lambda x: x <> r.path), new_path) END,
         CASE WHEN list_contains(names, new_path) THEN done ELSE list_append(done, {'path': r.path, 'new_path': new_path}) END
  FROM s JOIN r ON r.i = s.i + 1)
SELECT d.path, d.new_path FROM (SELECT unnest(done) AS d FROM s WHERE i = (SELECT max(i) FROM s))""")
def rename_collisions(spark, d):
    """A batch of renames with conflicts, freed names and chains, held to one after the other."""
    k = F.col("c_custkey")
    stamp = F.concat(F.lit("s"), (k % 40).cast("string"))
    head = F.when(k < 120, F.concat(F.lit("T"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    title = F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit(" T"), (F.floor(k / 3) % 4).cast("string"), F.when(k % 2 == 0, " ").otherwise("?")))
    rows = tables.table(spark, d, "customer").select(F.concat(F.lit("chats/"), head, F.lit(" - "), stamp, F.lit(".chat")).alias("path"), F.concat(F.lit("Chat "), stamp).alias("thread_id"), title.alias("title"), ((k * 7919) % 100003 * 1000000 + k).alias("ord"))
    return chats.renamed(rows.select("path"), rows)


@_query("""
WITH n AS (SELECT source, count(*) AS rows, 'v1' AS version FROM documents GROUP BY source)
SELECT source, CASE WHEN source = 'src1' THEN 1 ELSE rows END AS rows, 2 - CAST(source NOT IN ('src1', 'new') AS INT) AS parsed_in FROM (SELECT source, rows FROM n WHERE source <> 'src2' UNION ALL SELECT 'new', 3 FROM (SELECT 1 FROM documents LIMIT 1))""")
def refreshed_index(spark, d):
    """An index of files by source: built, then brought up to one changed, one new and one deleted file, of which it parses two."""
    out = new_path(spark, "index")
    rows = tables.table(spark, d, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("value"))
    put = lambda df: df.repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").text(f"{out}/files")
    put(rows)
    stage = []

    def parse(files):
        lines = F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != ""))
        return files.select("path", F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), lines.cast("long").alias("rows"), F.lit(len(stage) + 1).alias("parsed_in"))

    index.refresh(spark, f"{out}/files", f"{out}/index", "*.txt", parse)
    stage.append("changes")
    some = rows.limit(1)
    put(some.select(F.lit("src1").alias("source"), "value").unionByName(some.select(F.lit("new").alias("source"), F.explode(F.array_repeat("value", 3)).alias("value"))))
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/files/source=src2")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    found = index.refresh(spark, f"{out}/files", f"{out}/index", "*.txt", parse).rows
    return found.groupBy("source").agg(F.sum("rows").alias("rows"), F.max("parsed_in").alias("parsed_in"))


def _threads(spark, d):
    """Conversations as texts of chat files: a checkpoint a turn, two writes a turn, the second an error of odd turns."""
    turn = F.col("turn")
    name = F.lpad(turn.cast("string"), 5, "0")
    write = F.array(F.to_json(F.array(F.lit("task"), F.lit("messages"), F.coalesce("text", F.lit("")))), F.to_json(F.array(F.when(turn % 2 == 1, "__error__").otherwise("other"), F.col("role"))), F.lit('["short"]'))
    texts = tables.table(spark, d, "conversations").groupBy("conv_id").agg(
        F.max("turn").alias("last"),
        F.map_from_entries(F.collect_list(F.struct(name, F.coalesce("text", F.lit(""))))).alias("checkpoints"),
        F.map_from_entries(F.collect_list(F.struct(name, F.transform(write, lambda x: F.parse_json(x))))).alias("writes"),
    )
    body = F.struct(F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("threadId"), F.lit("T").alias("title"), F.lit(0).alias("createdAt"), (F.col("last") * 1000).alias("updatedAt"), "checkpoints", "writes")
    bad = spark.createDataFrame([("{ no json",), ('{"title": "x"}',), (None,)], "text string")
    return tables.parsed_threads(texts.select(F.to_json(body).alias("text")).union(bad))


@_query("SELECT 'Chat ' || conv_id AS thread_id, 'T' AS title, CAST(max(turn) * 1000 AS BIGINT) AS updated FROM conversations GROUP BY conv_id")
def chat_thread_index(spark, d):
    return tables.thread_index(_threads(spark, d)).select("thread_id", "title", F.unix_millis("updated_at").alias("updated"))


@_query("SELECT 'Chat ' || conv_id AS thread_id, lpad(CAST(turn AS VARCHAR), 5, '0') AS checkpoint_id, coalesce(text, '') AS entry FROM conversations")
def chat_checkpoints(spark, d):
    return tables.checkpoints(_threads(spark, d))


@_query("""
SELECT 'Chat ' || conv_id AS thread_id, lpad(CAST(turn AS VARCHAR), 5, '0') AS checkpoint_id, 0 AS at, 'messages' AS channel, coalesce(text, '') AS value, false AS names_error FROM conversations
UNION ALL SELECT 'Chat ' || conv_id, lpad(CAST(turn AS VARCHAR), 5, '0'), 1, CASE WHEN turn % 2 = 1 THEN '__error__' ELSE 'other' END, role, turn % 2 = 1 FROM conversations""")
def chat_writes(spark, d):
    return tables.writes(_threads(spark, d))


@_query("SELECT max('chats/' || source || ' - Chat 7.chat') AS path FROM documents WHERE source = 'src2'")
def chat_file_of_thread(spark, d):
    source = F.col("source")
    files = tables.table(spark, d, "documents").select(source).distinct()
    name = F.when(source == "src2", F.concat(F.lit("chats/"), source, F.lit(" - Chat 7.chat"))).otherwise(F.concat(F.lit("chats/"), source, F.lit(".chat")))
    return chats.chat_path(files.select(name.alias("path")), "Chat 7")


# Streams


def _event_files(spark, d, out: str):
    """The events as a stream of files, a range of time each, one of them a micro-batch."""
    events = _stream_events(spark, d, _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    at = F.coalesce(F.unix_micros("ts"), F.lit(0))  # not by id: ids may begin again with an older time
    cuts = events.select(at.alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):  # one after another: the stream takes files by age
        part = events if low is None else events.where(at >= low)
        (part if high is None else part.where(at < high)).coalesce(1).write.mode("append").parquet(f"{out}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")


def _change_log(spark, d, **how):
    out = new_path(spark, "streams")
    folds.with_rocksdb(spark)
    events = _event_files(spark, d, out)
    if "quiet" in how:  # where runs end, an event of none of the other kinds is a cancellation
        events = events.withColumn("type", F.when(F.col("type") == "checkpoint_message", "cancel").otherwise(F.col("type")))
    query = folds.log_changes(folds.changes(events, **how), f"{out}/log", f"{out}/state")
    query.awaitTermination()
    return folds.logged(spark, f"{out}/log")


@_query(_FOLDED)
def streamed_fold(spark, d):
    """The fold over four micro-batches: runs, of which some get their result in the middle."""
    return folds.runs_of(_change_log(spark, d))


@_query(_STREAM + "SELECT * FROM tool")
def streamed_calls(spark, d):
    """The same log's calls: starts wait in the log until their end comes."""
    return folds.calls_of(_change_log(spark, d))


@_query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS thread_id, CAST(event_id // 1000 AS VARCHAR) AS run_id, event_id AS seq, ts,
  CASE event_type WHEN 'click' THEN 'tool_start' WHEN 'view' THEN 'tool_end' WHEN 'purchase' THEN 'token' WHEN 'error' THEN 'result' ELSE 'cancel' END AS type FROM events),
n AS (SELECT *, ts > lag(ts) OVER (PARTITION BY thread_id, run_id ORDER BY ts, seq) + INTERVAL 2 HOURS AS new FROM e),
s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id, run_id ORDER BY ts, seq) AS session FROM n),
o AS (SELECT thread_id, run_id, max(ts) AS last, min(seq) FILTER (WHERE type = 'result') AS r, min(seq) FILTER (WHERE type = 'cancel') AS c FROM s GROUP BY thread_id, run_id, session)
SELECT thread_id, run_id, epoch_us(last) // 1000 AS last_at, CASE WHEN c IS NOT NULL AND (r IS NULL OR c < r) THEN 'cancelled' WHEN r IS NULL THEN 'error' ELSE 'success' END AS outcome
FROM o WHERE epoch_us(last) // 1000 + 7200000 < (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM e)""")
def streamed_endings(spark, d):
    """Runs that went silent for two hours, each told once, by session windows on the events' own time."""
    log = _change_log(spark, d, quiet="2 hours", delay="10 minutes")
    return folds.endings_of(log).select("thread_id", "run_id", F.unix_millis("last_at").alias("last_at"), "outcome")


@_query("SELECT conv_id AS thread_id, turn AS checkpoint_id, coalesce(text, '') AS entry FROM conversations")
def logged_checkpoints(spark, d):
    """Checkpoints in a log of buckets: a first version of all, the last of each after eight batches and a repeated one."""
    path = new_path(spark, "checkpoints")
    rows = tables.table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("checkpoint_id"), F.coalesce("text", F.lit("")).alias("entry"))
    key = ["thread_id", "checkpoint_id"]
    log.append(rows.withColumn("entry", F.lit("draft")), 0, path, key)
    for number in range(1, 9):
        log.append(rows.where(F.col("thread_id") % 8 == number - 1), number, path, key)
    log.append(rows.withColumn("entry", F.lit("again")), 8, path, key)
    return log.read(spark, path, key)


@_query("""
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE c_nationkey END AS nation FROM customer WHERE c_custkey % 5 <> 0)
SELECT id, nation, nation IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 1) AS matched FROM c""")
def kept_matches(spark, d):
    """A semi and an anti join of customers with suppliers' nations, kept while rows of both are inserted, changed and deleted."""
    view = views.MatchedView(spark, new_path(spark, "views"), ["nation"], ["id"])
    left = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"), F.lit("insert").alias("op"))
    right = tables.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), "s_suppkey", F.lit("insert").alias("op"))
    view.apply(0, left, right.drop("s_suppkey"))
    moved = left.where("id % 7 = 0").withColumn("nation", F.lit(3).cast("long"))
    gone = left.where("id % 5 = 0").withColumn("op", F.lit("delete"))
    less = right.where("s_suppkey % 2 = 0").select("nation", F.lit("delete").alias("op"))
    for _ in range(2):  # run again, it changes nothing
        view.apply(1, moved.unionByName(gone), less)
    return view.matched().withColumn("matched", F.lit(True)).unionByName(view.unmatched().withColumn("matched", F.lit(False)))


# Messages and events


@_query(
    _PAIRS.format(and_="")
    + """SELECT p.thread_id, p.pair, c.calls AS tool_calls FROM p LEFT JOIN (
  SELECT conv_id, pair, CASE WHEN pair = 0 THEN turn END AS orphan, string_agg('a' || turn || ' b' || turn, ' ' ORDER BY turn) AS calls FROM m WHERE role = 'assistant' AND turn % 3 <> 0 GROUP BY ALL) c
ON c.conv_id = p.thread_id AND c.pair = p.pair AND (p.pair > 0 OR c.orphan = p.first_seq)"""
)
def merged_tool_calls(spark, d):
    """Two calls in each assistant message but every third, which has none or no list at all."""
    seq = F.col("seq").cast("string")
    calls = F.when(F.col("seq") % 3 != 0, F.array(F.concat(F.lit("a"), seq), F.concat(F.lit("b"), seq))).when(F.col("seq") % 2 == 0, F.array().cast("array<string>"))
    return threads.pairs(_messages(spark, d).withColumn("tool_calls", calls)).select("thread_id", "pair", F.array_join("tool_calls", " ").alias("tool_calls"))


@_query("""
SELECT event_id, event_id % 6 IN (0, 5) AS candidate, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props || props WHEN 2 THEN props WHEN 5 THEN '' ELSE '' END AS messages FROM
(SELECT event_id, replace(props, ': ', ':') AS props FROM events)""")
def event_messages(spark, d):
    m, props = F.col("event_id") % 6, F.regexp_replace("props", ": ", ":")
    wrap = lambda a, b: F.concat(F.lit(a), props, F.lit(b))
    event = (
        F.when(m == 0, wrap('{"data":{"output":{"messages":[', ',3]},"chunk":[{}]}}'))
        .when(m == 1, F.concat(F.lit('{"data":{"output":{"other":1},"chunk":['), props, F.lit(',null,"x",'), props, F.lit("]}}")))
        .when(m == 2, wrap('{"data":{"chunk":{"messages":[', "]}}}"))
        .when(m == 3, F.lit('{"data":{"chunk":"text"}}'))
        .when(m == 4, F.lit("not json"))
        .otherwise('{"data":{"output":{"messages":[]},"chunk":[{"a":1}]}}')
    )
    return _events(spark, d).select("event_id", stores.output_candidate(event).alias("candidate"), F.array_join(stores.event_messages(event), "").alias("messages"))


@_query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'm' || event_id WHEN 1 THEN 'Unknown error' END AS message, CASE event_id % 4 WHEN 0 THEN 'E' END AS name, event_id % 4 = 2 AS has_messages FROM events")
def error_values(spark, d):
    m, ident = F.col("event_id") % 4, F.col("event_id").cast("string")
    value = F.when(m == 0, F.concat(F.lit('{"message":"m'), ident, F.lit('","name":"E"}'))).when(m == 1, '{"name":""}').when(m == 2, '"text"').otherwise("no json")
    found = F.when(m == 2, '{"messages":[]}').when(m == 3, '{"messages":3}').otherwise("[]")
    e = values.error_of(value)
    return _events(spark, d).select("event_id", e["message"].alias("message"), e["name"].alias("name"), values.has_messages(found).alias("has_messages"))


@_query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '' END AS a, event_id % 3 <> 2 AS valid FROM events")
def header_texts(spark, d):
    m = F.col("event_id") % 3
    text = F.when(m == 0, F.concat(F.lit('{"A":"'), F.col("event_type"), F.lit('","B":"c"}'))).when(m == 1, F.lit(" \n")).otherwise('{"A":1}')
    found = values.headers(text)
    return _events(spark, d).select("event_id", F.when(found.isNotNull(), F.coalesce(found["A"], F.lit(""))).alias("a"), found.isNotNull().alias("valid"))


@_query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN t || chr(10) || t WHEN 1 THEN t WHEN 2 THEN '{' || chr(10) || '  "n": 2' || chr(10) || '}' WHEN 3 THEN '' ELSE t END AS output
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def rendered_outputs(spark, d):
    m, text = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    block = lambda t: F.to_json(F.struct(F.lit("text").alias("type"), t.alias("text")))
    raw = F.when(m == 0, F.concat(F.lit("["), block(text), F.lit(","), block(text), F.lit("]"))).when(m == 1, F.concat(F.lit('{"content":{"content":'), block(text), F.lit("}}"))).when(m == 2, '{"n":2.0}').when(m == 3, "null").otherwise(F.to_json(F.array(text)))
    raw = F.when(m == 4, F.regexp_extract(raw, r"^\[([\s\S]*)\]$", 1)).otherwise(raw)
    # a list of two empty texts has no lines to show, and stays JSON
    return _documents(spark, d, F.when((m == 0) & (text == ""), F.lit("\n")).otherwise(values.tool_output(raw)).alias("output"))


# Cursors and names


@_query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(length(t) + 1 AS BIGINT) END AS fence, CAST(length(t) AS BIGINT) AS start, CAST(length(t) + 8 + length(lang) AS BIGINT) AS end_, lang AS file, 'al' AS alias
FROM (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '[`\\[\\]]', '', 'g') AS t FROM documents)""")
def cursor_positions(spark, d):
    """An open fence and a link behind each text, looked for from a cursor inside the link."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[`\[\]]", "")
    fenced = F.concat(text, F.lit("\n```dataview\nLIST"), F.when(F.col("doc_id") % 2 == 1, "\n```").otherwise(""))
    linked = F.concat(text, F.lit("[["), F.col("lang"), F.lit("|al]] x"))
    rows = _documents(spark, d, scripts.query_fence(fenced).alias("fence"), scripts.link_at_cursor(linked, F.length(text) + 3).alias("l"))
    return rows.select("doc_id", "fence", "l.start", (F.col("l.end") + 1).alias("end_"), "l.file", "l.alias")


@_query("SELECT c_custkey, 'Search Notes ' || c_custkey AS title, 'https://h' || c_custkey || '/v1' AS url, 'tag' || c_custkey AS tag, c_custkey % 2 = 0 AS provider_id, CASE c_custkey % 3 WHEN 0 THEN 'embedding' WHEN 1 THEN 'chat' END AS kind FROM customer")
def identifiers(spark, d):
    ident, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    name = F.concat(F.lit("search_notes_"), ident)
    model = F.when(m == 0, F.concat(F.lit("text-embed-"), ident)).when(m == 1, F.concat(F.lit("talk-"), ident)).otherwise(F.concat(F.lit("whisper-"), ident))
    return tables.table(spark, d, "customer").select(
        "c_custkey",
        strings.title_from_identifier(name).alias("title"),
        strings.base_url(F.concat(F.lit("https://h"), ident, F.lit("/v1/"))).alias("url"),
        strings.tag_text(F.concat(F.lit("#tag"), ident)).alias("tag"),
        strings.is_provider_id(F.concat(F.when(F.col("c_custkey") % 2 == 0, "own-").otherwise("Own-"), ident)).alias("provider_id"),
        strings.model_kind(model).alias("kind"),
    )


@_query("SELECT event_id, epoch_us(ts) // 1000 AS at_, epoch_us(ts) // 1000 AS created FROM events")
def parsed_times(spark, d):
    ts, otherwise = F.col("ts").cast("timestamp"), F.timestamp_millis(F.lit(5))
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return _events(spark, d).select("event_id", F.unix_millis(dates.parsed_or(text, otherwise)).alias("at_"), F.unix_millis(F.coalesce(dates.parsed_or(F.lit("no time"), ts))).alias("created"))


@_query("SELECT user_id, 'x' AS shown FROM events WHERE false UNION ALL SELECT DISTINCT user_id, user_id || '. n (p) [score: ' || printf('%.2f', user_id / 7) || ']' FROM events")
def hits_with_scores(spark, d):
    users = _events(spark, d).select("user_id").distinct()
    return users.select("user_id", strings.render_hits(F.col("user_id"), F.lit("n"), F.lit("p"), F.col("user_id") / 7).alias("shown"))


@_query("SELECT 'ranked' AS via, 'doc-' || doc_id AS name FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 3) UNION ALL SELECT 'grep', 'doc-' || doc_id FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains('doc-' || doc_id, 'the') ORDER BY doc_id LIMIT 10)")
def search_by_algorithm(spark, d):
    """A ranked backend that answers, and one that fails only when it runs."""
    notes = _notes(spark, d)
    good = lambda _: notes.select("path", F.col("ord").cast("double").alias("score"))
    broken = lambda _: notes.select("path", F.raise_error(F.lit("no index")).cast("double").alias("score"))
    run = lambda via, rank, most: search.search(notes, "the", "ranked", most, rank).select(F.lit(via).alias("via"), "name")
    return run("ranked", good, 3).union(run("grep", broken, 10))


# Stores


_STORE = """
WITH now AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0),
ch AS (SELECT o_custkey AS k, o_orderkey AS "at", CASE o_orderkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS op, CAST(o_orderkey AS VARCHAR) AS v FROM orders),
st AS (SELECT ch.*, k % 10 = 1 AS held, coalesce(last_value(CASE WHEN op = 'add' AND k % 10 <> 1 THEN true WHEN op = 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY k ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k IN (SELECT k FROM now)) AS there FROM ch),
er AS (SELECT *, CASE WHEN op = 'add' AND held THEN 'reserved' WHEN op = 'add' AND there THEN 'already exists' WHEN op <> 'add' AND NOT there THEN 'not found' END AS error FROM st),
la AS (SELECT k, arg_max(op, "at") AS op, arg_max(v, "at") AS v FROM er WHERE error IS NULL GROUP BY k),
after AS (SELECT * FROM now WHERE k NOT IN (SELECT k FROM la) UNION ALL SELECT k, v FROM la WHERE op <> 'delete')
"""


def _changed(spark, d):
    now = tables.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    m = F.col("o_orderkey") % 3
    op = F.when(m == 0, stores.ADD).when(m == 1, stores.UPDATE).otherwise(stores.DELETE)
    orders = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), op.alias("op"), F.col("o_orderkey").cast("string").alias("v"))
    reserved = tables.table(spark, d, "customer").where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("k"))
    return stores.changed(now, orders, ["k"], "at", reserved)


@_query(_STORE + "SELECT k, v FROM after")
def store_changes(spark, d):
    return _changed(spark, d)[0]


@_query(_STORE + 'SELECT op, k, "at", error FROM er WHERE error IS NOT NULL')
def store_changes_refused(spark, d):
    return _changed(spark, d)[1]


@_query(_STORE + "SELECT o_orderkey AS model, CASE WHEN o_custkey IN (SELECT k FROM after) THEN o_custkey END AS k, o_custkey IN (SELECT k FROM after) AS kept FROM orders")
def store_cascades(spark, d):
    """Models (orders) of providers (customers) that may be gone: those that go, and choices that become none."""
    after = _changed(spark, d)[0]
    models = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("model"), F.col("o_custkey").alias("k"))
    kept = stores.cascaded(models, after, ["k"]).select("model", F.lit(True).alias("kept"))
    return stores.cleared(models, after, ["k"]).join(kept, "model", "left").select("model", "k", F.coalesce("kept", F.lit(False)).alias("kept"))


@_query("""
WITH de AS (SELECT p_brand AS section, CAST(p_size AS VARCHAR) AS name, min(p_type) AS value FROM part GROUP BY ALL),
own AS (SELECT p_brand AS section, CAST(p_size AS VARCHAR) AS name, max(p_name) AS value FROM part WHERE p_partkey % 7 = 0 GROUP BY ALL)
SELECT coalesce(de.section, own.section) AS section, coalesce(de.name, own.name) AS name, CASE WHEN own.section IS NULL THEN de.value ELSE own.value END AS value
FROM (SELECT * FROM de WHERE section < 'Brand#3' OR section NOT IN (SELECT section FROM own)) de FULL JOIN own ON de.section = own.section AND de.name = own.name""")
def settings_sections(spark, d):
    part = tables.table(spark, d, "part").select(F.col("p_brand").alias("section"), F.col("p_size").cast("string").alias("name"), "p_partkey", "p_type", "p_name")
    defaults = part.groupBy("section", "name").agg(F.min("p_type").alias("value"))
    own = part.where("p_partkey % 7 = 0").groupBy("section", "name").agg(F.max("p_name").alias("value"))
    return stores.merge_sections(defaults, own, part.select("section").where("section < 'Brand#3'").distinct())


@_query("SELECT n_name AS agent, 'on' AS search, CASE WHEN n_nationkey % 3 = 0 THEN 'on' ELSE 'off' END AS read, CASE WHEN n_nationkey % 3 = 1 THEN n_name END AS own FROM nation")
def agent_defaults(spark, d):
    m = F.col("n_nationkey") % 3
    own = F.when(m == 1, F.create_map(F.lit("read"), F.lit("off"), F.lit("own"), F.col("n_name"))).when(m == 2, F.create_map(F.lit("read"), F.lit("off")))
    tools = stores.with_entry_defaults(own, F.create_map(F.lit("search"), F.lit("on"), F.lit("read"), F.lit("on")))
    return tables.table(spark, d, "nation").select(F.col("n_name").alias("agent"), tools["search"].alias("search"), tools["read"].alias("read"), tools["own"].alias("own"))


@_query("""
WITH a AS (SELECT event_id, ['openai', 'anthropic', 'ollama', 'openrouter'][1 + event_id % 4] AS p, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'key' END AS c, [200, 401, 400, 500, 403][1 + event_id % 5] AS s, event_id % 3 AS b, event_id % 13 = 0 AS lost FROM events),
k AS (SELECT *, CASE WHEN c = ' ' THEN 'missing' WHEN lost THEN 'unreachable' WHEN s = 200 THEN 'valid' WHEN s IN (401, 403) OR (b = 0 AND p IN ('openai', 'anthropic')) THEN 'denied' ELSE 'failed' END AS kind FROM a)
SELECT event_id, kind, CASE kind WHEN 'missing' THEN CASE WHEN p = 'ollama' THEN 'Server URL is required' ELSE 'API key is required' END WHEN 'unreachable' THEN 'Connection failed: no route'
  WHEN 'denied' THEN CASE WHEN b = 0 AND p <> 'ollama' THEN 'told' WHEN p = 'ollama' AND b <> 2 THEN CASE b WHEN 0 THEN '{"error":{"code":"invalid_api_key","type":"authentication_error","message":"told"}}' ELSE 'plain' END ELSE 'Authentication failed (' || s || ')' END
  WHEN 'failed' THEN CASE WHEN b = 0 AND p <> 'ollama' THEN 'told' WHEN b = 0 THEN '{"error":{"code":"invalid_api_key","type":"authentication_error","message":"told"}}' WHEN b = 1 THEN 'plain' ELSE 'Request failed with status ' || s END END AS error FROM k""")
def auth_answers(spark, d):
    ident = F.col("event_id")
    pick = lambda options, n: F.element_at(F.array(*[F.lit(x) for x in options]), (ident % n + 1).cast("int"))
    body = F.when(ident % 3 == 0, '{"error":{"code":"invalid_api_key","type":"authentication_error","message":"told"}}').when(ident % 3 == 1, "plain").otherwise("")
    answer = stores.auth_answer(pick(["openai", "anthropic", "ollama", "openrouter"], 4), F.when(ident % 11 == 0, " ").otherwise("key"), pick([200, 401, 400, 500, 403], 5), body, F.when(ident % 13 == 0, "no route"))
    return _events(spark, d).select("event_id", answer.alias("a")).select("event_id", "a.kind", "a.error")


@_query("""
WITH a AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN ' ' ELSE 'https://' || source END AS c, [200, 401, 500, 403][1 + doc_id % 4] AS s, doc_id % 3 AS b, doc_id % 13 = 0 AS lost FROM documents)
SELECT doc_id, CASE WHEN c = '' THEN 'Base URL is required' WHEN lost THEN 'Connection failed: ' || source WHEN s = 200 THEN NULL WHEN b = 0 THEN 'told ' || lang || ' ' || source WHEN s IN (401, 403) THEN 'Authentication failed' ELSE 'Request failed with status ' || s END AS error FROM a""")
def compatible_sign_in(spark, d):
    """Answers of servers that are compatible with another's: a URL is needed, a key is not; only the message of an error counts."""
    ident = F.col("doc_id")
    told = F.to_json(F.struct(F.struct(F.concat_ws(" ", F.lit("told"), "lang", "source").alias("message")).alias("error")))
    body = F.when(ident % 3 == 0, told).when(ident % 3 == 1, "plain text").otherwise("")
    url = F.when(ident % 7 == 0, F.when(ident % 2 == 0, "")).when(ident % 7 == 1, " ").otherwise(F.concat(F.lit("https://"), "source"))
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 401, 500, 403)]), (ident % 4 + 1).cast("int"))
    answer = stores.auth_answer(F.lit("openai-compatible"), url, status, body, F.when(ident % 13 == 0, F.col("source")))
    return tables.table(spark, d, "documents").select("doc_id", answer["error"].alias("error"))


@_query("""
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Name is required' WHEN 1 THEN 'Name must contain at least one letter or number' WHEN 2 THEN 'A server with this name already exists' WHEN 4 THEN 'Command is required for stdio transport'
  WHEN 5 THEN 'URL is required for HTTP/SSE transport' WHEN 6 THEN 'Invalid URL format' END AS error FROM customer""")
def server_forms(spark, d):
    m, ident = F.col("c_custkey") % 8, F.col("c_custkey").cast("string")
    forms = tables.table(spark, d, "customer").select(
        "c_custkey",
        F.when(m == 0, " ").when(m == 1, "!?").when(m.isin(2, 3), "Taken One").otherwise(F.concat(F.lit("Server "), ident)).alias("name"),
        F.when(m == 5, "sse").when(m > 5, "http").otherwise("stdio").alias("transport"),
        F.when(m != 4, "run").alias("command"),
        F.when(m == 6, "not a url").when(m == 7, F.concat(F.lit(" https://h"), ident, F.lit(":80/x "))).alias("url"),
        F.when(m == 3, "taken-one").alias("editing"),
    )
    return stores.form_errors(forms, spark.createDataFrame([("taken-one",)], "id string")).select("c_custkey", "error")


@_query("SELECT p_brand AS provider, bool_or(p_size % 2 = 1 AND p_partkey % 5 = 0) AS any_optional FROM part GROUP BY p_brand")
def optional_fields_set(spark, d):
    part = tables.table(spark, d, "part").select(F.col("p_brand").alias("provider"), F.col("p_partkey").cast("string").alias("field"), (F.col("p_size") % 2 == 0).alias("required"), "p_partkey")
    stored = part.where("p_partkey % 5 IN (0, 1)").select("provider", "field", F.when(F.col("p_partkey") % 5 == 0, "x").otherwise("").alias("value"))
    return stores.optional_set(part.drop("p_partkey"), stored)


@_query("SELECT n_name AS provider, CASE WHEN n_nationkey % 3 = 0 THEN 'm' || n_nationkey ELSE '' END AS models FROM nation")
def models_or_none(spark, d):
    """Answers of which a third is there, a third is no JSON and a third is missing."""
    nation = tables.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("provider"))
    good = F.concat(F.lit('{"data":[{"id":"m'), F.col("n_nationkey").cast("string"), F.lit('"},{"id":" "}]}'))
    answers = nation.where("n_nationkey % 3 <> 2").select("provider", F.when(F.col("n_nationkey") % 3 == 0, good).otherwise("<html>").alias("body"))
    return tables.models_or_none(nation.select("provider"), answers).select("provider", F.array_join("models", ",").alias("models"))


@_query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN '{\"transport\":\"stdio\",\"command\":\"run\",\"args\":[\"' || n_name || '\"]}' ELSE '{\"transport\":\"http\",\"url\":\"u\",\"headers\":{\"A\":\"' || n_name || '\"}}' END AS connection FROM nation WHERE n_nationkey % 2 = 0")
def server_connections(spark, d):
    key, name = F.col("n_nationkey"), F.col("n_name")
    none = F.create_map().cast("map<string,string>")
    servers = tables.table(spark, d, "nation").select(
        key.alias("id"),
        (key % 2 == 0).alias("enabled"),
        F.when(key % 3 == 0, "stdio").otherwise("http").alias("transport"),
        F.lit("run").alias("command"),
        F.array(name).alias("args"),
        none.alias("env"),
        F.lit("u").alias("url"),
        F.create_map(F.lit("A"), name).alias("headers"),
    )
    return catalog.enabled_servers(servers)


@_query("SELECT string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS prompt FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 0")
def prompt_extensions(spark, d):
    key = F.col("n_nationkey")
    rows = tables.table(spark, d, "nation").select(key.alias("ord"), (key % 2 == 0).alias("enabled"), (key % 3 != 0).alias("plugin_enabled"), F.when(key % 5 == 0, " ").otherwise(F.col("n_name")).alias("prompt"))
    return catalog.enabled_prompts(rows)


@_query("SELECT c_mktsegment AS tool, c_custkey AS n, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'own' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) END) AS label FROM customer")
def tools_with_fallback(spark, d):
    tools = tables.table(spark, d, "customer").select(F.col("c_mktsegment").alias("tool"), F.col("c_custkey").alias("n"), F.when(F.col("c_custkey") % 2 == 0, "own").alias("label"))
    defaults = tools.select("tool").distinct().where("tool <> 'BUILDING'").select("tool", F.lower("tool").alias("label"), F.lit(None).cast("long").alias("n"))
    return catalog.with_fallback(tools, defaults, "tool", ["n", "label"])


@_query("SELECT slug AS id, count(*) AS n FROM (SELECT regexp_replace(lower(p_brand || '! ' || p_size), '[^a-z0-9]+', '-', 'g') AS slug FROM part) GROUP BY slug HAVING count(*) > 1")
def server_id_conflicts(spark, d):
    return catalog.slug_conflicts(tables.table(spark, d, "part").select(F.concat_ws("! ", "p_brand", "p_size").alias("name")))


@_query("SELECT conv_id AS thread_id, count(*) AS n FROM conversations WHERE conv_id % 10 <> 3 GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, 1 FROM conversations WHERE conv_id % 10 = 3")
def saved_threads(spark, d):
    """All threads saved, then a tenth of them again, with one row each."""
    path = new_path(spark, "threads")
    rows = tables.table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), "turn")
    tables.save_threads(rows, path)
    tables.save_threads(rows.where("thread_id % 10 = 3").groupBy("thread_id").agg(F.max("turn").alias("turn")), path)
    return tables.saved_threads(spark, path).groupBy("thread_id").agg(F.count("*").alias("n"))


# Search: a kept index, and tools in SQL


_KEPT_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'License; the license. ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0),
w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM d),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c),
r AS (SELECT doc_id, ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
                   + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM c, s)
SELECT doc_id AS ord, round(score, 4) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT 10"""


@_query(_KEPT_SQL)
def kept_ranked_index(spark, d):
    """Ranked hits of an index that was built once and then took changed and deleted notes."""
    index = RankedIndex(spark, new_path(spark, "ranked"))
    notes = _notes(spark, d)
    index.apply(0, notes)
    changed = notes.where("ord % 7 = 0").withColumn("content", F.concat(F.lit("License; the license. "), F.coalesce("content", F.lit(""))))
    index.apply(1, changed, notes.where("ord % 5 = 0").select("path"))
    return index.search("the license").select("ord", F.round("score", 4).alias("score"))


def _sql(spark, d, text: str):
    sql_tools.register(_notes(spark, d), "kept_notes")
    return spark.sql(text)


@_query(f"SELECT doc_id AS ord, {_PATH} AS path, 'doc-' || doc_id AS name, row_number() OVER (ORDER BY doc_id) AS n FROM (SELECT * FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 10)")
def sql_search_notes(spark, d):
    return _sql(spark, d, "SELECT ord, path, name, n FROM search_notes('The', 10)")


@_query("""
WITH h AS (SELECT * FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 5), t AS (SELECT doc_id, '#' || lang AS tag FROM documents UNION ALL SELECT doc_id, '#' || source FROM documents)
SELECT tag, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM h)) AS n_hits, count(*) AS n_notes FROM t GROUP BY tag""")
def sql_tags_of_hits(spark, d):
    """Tags with how many of a search's hits and how many notes have them: three calls in one plan."""
    return _sql(spark, d, """
        SELECT a.tag, count(h.tag) AS n_hits, any_value(a.n_notes) AS n_notes
        FROM all_tags() a LEFT JOIN (SELECT tag FROM search_notes('LICENSE', 5) JOIN kept_notes USING (path) LATERAL VIEW explode(tags) t AS tag) h ON a.tag = h.tag GROUP BY a.tag""")


@_query("SELECT k AS key, CASE k WHEN 'lang' THEN lang WHEN 'source' THEN source ELSE CAST(n_chars AS VARCHAR) END AS value FROM (SELECT *, unnest(['lang', 'source', 'n_chars']) AS k FROM documents WHERE doc_id = 7)")
def sql_note_properties(spark, d):
    return _sql(spark, d, "SELECT p.key, p.value FROM note_properties('doc-7') p JOIN property_keys() k ON p.key = k.key")


@_query("SELECT left(text, 100) || CASE WHEN length(text) > 100 THEN chr(10) || chr(10) || '... [Content truncated at 100 characters]' ELSE '' END AS content, text AS whole FROM documents WHERE doc_id = 3")
def sql_read_note(spark, d):
    path = _notes(spark, d).where("ord = 3").first()["path"]
    return _sql(spark, d, f"SELECT a.content, b.content AS whole FROM read_note('{path}', 100) a, read_note('{path}', 0) b WHERE a.path = b.path")
