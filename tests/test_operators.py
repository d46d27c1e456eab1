import json
import random

from pyspark.sql import functions as F

from quillgrid.operators import catalog, metadata, search, threads
from quillgrid.plans.notes_query import NotesQuery, choice, folder, has, prop, tag
from quillgrid.sources import tables

NOTE = "ord long, path string, name string, content string, tags array<string>, properties string"
MESSAGE = "thread_id string, seq long, role string, text string"


def notes(spark):
    rows = [
        (1, "Books/a.md", "a", "Dune 100%", ["#library", "#x"], '{"Title":"A","Rating":5,"position":{"line":1}}'),
        (2, "Books/b.md", "b", "über_all", ["#library"], '{"Title":"B","Rating":2,"tags":["t1","t2"]}'),
        (3, "Templates/c.md", "c", "dune", ["#library"], '{"Title":"C","Rating":4}'),
        (4, "Books/Sub/a.md", "a", "", [], None),
    ]
    return spark.createDataFrame(rows, NOTE)


def paths(df):
    return [r.path for r in df.collect()]


def test_search(spark):
    n = notes(spark)
    assert paths(search.grep(n, "DUNE")) == ["Books/a.md", "Templates/c.md"]
    assert paths(search.grep(n, "%")) == ["Books/a.md"] and paths(search.grep(n, "_")) == ["Books/b.md"]
    assert len(paths(search.grep(n, ""))) == 4 and len(paths(search.grep(n, "", 2))) == 2
    assert paths(search.search(n, "dune", "embeddings")) == ["Books/a.md", "Templates/c.md"]

    def broken(query):
        raise RuntimeError(query)

    assert paths(search.search(n, "dune", "ranked", rank=broken)) == ["Books/a.md", "Templates/c.md"]
    late = lambda q: n.select("path", F.raise_error(F.lit("no index")).cast("double").alias("score"))
    assert paths(search.search(n, "dune", "ranked", rank=late)) == ["Books/a.md", "Templates/c.md"]
    hits = spark.createDataFrame([("Books/b.md", 2.0), ("gone.md", 9.0), ("Books/a.md", 1.0)], "path string, score double")
    assert sorted(paths(search.search(n, "x", "ranked", 2, lambda q: hits))) == ["Books/b.md"]
    assert paths(search.bm25(n, "dune"))[0] == "Templates/c.md"
    assert paths(search.within_folders(n, ["Books"])) == ["Templates/c.md"] and len(paths(search.within_folders(n, ["Books/"], False))) == 3
    assert paths(search.fuzzy(n.select("path"), "tmc")) == ["Templates/c.md"] and len(paths(search.fuzzy(n.select("path"), "", 2))) == 2


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = search.vector_search(v, F.array(F.lit(1.0), F.lit(0.0)), 5, 0.5).collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 1.0), (1, 0.6)]


def test_metadata(spark):
    n = notes(spark)
    assert [r.tag for r in metadata.distinct_tags(n).collect()] == ["#library", "#x"]
    assert [r.key for r in metadata.property_keys(n).collect()] == ["Rating", "Title", "tags"]
    assert {r.key: r.value for r in metadata.properties_of(n, "a").collect()} == {"Title": "A", "Rating": "5"}
    assert paths(metadata.find_note(n, "a")) == ["Books/a.md"] and paths(metadata.find_note(n, "Books/Sub/a.md")) == ["Books/Sub/a.md"]
    assert metadata.read_note(n, "nope").count() == 0
    assert metadata.read_note(n, "Books/a.md", 4).first().content.startswith("Dune\n\n...")
    assert n.select(tables.all_tags(F.col("tags"), F.col("properties")).alias("t")).collect()[1].t == ["#library", "#t1", "#t2"]


def test_notes_query(spark):
    """The example of the query language: a table of the library without templates, rated over 3, by rating."""
    n = notes(spark)
    query = NotesQuery({"Title": prop("Title")}, source=tag("library") & ~folder("Templates"), where=prop("Rating", "int") > 3, sort=(F.desc("ord"),), limit=10)
    assert [tuple(r) for r in query.run(n).collect()] == [("Books/a.md", "A")]
    assert [r.link for r in NotesQuery(where=has("tags")).run(n).collect()] == ["Books/b.md"]
    grouped = NotesQuery(group=choice(prop("Rating", "int") > 3, "high", "low"), where=has("Rating"))
    assert [(r.key, r.n, r.link) for r in grouped.run(n).collect()] == [("high", 2, "Books/a.md"), ("high", 2, "Templates/c.md"), ("low", 1, "Books/b.md")]
    last = NotesQuery(group=grouped.group, where=has("Rating"), sort=(F.desc("key"),), limit=1)
    assert [r.link for r in last.run(n).collect()] == ["Books/b.md"]
    assert [r.t for r in NotesQuery({"t": F.col("one")}, flatten=("one", F.col("tags")), sort=(F.col("ord"), F.col("one")), offset=1, limit=2).run(n).collect()] == ["#x", "#library"]


def pair_model(messages, errors):
    """Pairing and states as a plain loop over one thread."""
    out, talk, i = [], [m for m in sorted(messages, key=lambda m: m[1]) if m[2] in ("user", "assistant")], 0
    while i < len(talk):
        if talk[i][2] == "assistant":
            out.append((talk[i][1], "", talk[i][3], "success"))
            i += 1
            continue
        j = i + 1
        while j < len(talk) and talk[j][2] == "assistant":
            j += 1
        said = [t[3] for t in talk[i + 1 : j]]
        if not said:
            state, errors = ("error", errors - 1) if errors else ("cancelled", 0)
        else:
            state = "success"
        content = said[0] if len(said) == 1 else next((t for t in reversed(said) if t.strip()), "")
        out.append((talk[i][1], talk[i][3], content, state))
        i = j
    return out


def test_pairs_equal_the_loop(spark):
    rng = random.Random(3)
    rows, errors = [], []
    for t in range(60):
        errors.append((f"t{t}", rng.randrange(3)))
        for s in range(rng.randrange(1, 12)):
            rows.append((f"t{t}", s, rng.choice(["user", "assistant", "assistant", "user", "system", "tool"]), rng.choice(["a", "b ", " ", "", "c\n"])))
    pairs = threads.pair_states(threads.pairs(spark.createDataFrame(rows, MESSAGE)), spark.createDataFrame(errors, "thread_id string, error_count long"))
    got = {}
    for r in pairs.orderBy("thread_id", "first_seq").collect():
        got.setdefault(r.thread_id, []).append((r.first_seq, r.user_text, r.content, r.state))
    for t, n in errors:
        assert got.get(t, []) == pair_model([r for r in rows if r[0] == t], n)


def test_tools(spark):
    calls = spark.createDataFrame([("t", "1"), ("t", "2"), ("t", "")], "thread_id string, tool_call_id string")
    results = spark.createDataFrame([("1", 1, None, "old"), ("1", 2, "error", "new"), ("", 3, "error", "x")], "tool_call_id string, seq long, status string, text string")
    got = {r.tool_call_id: (r.status, r.output) for r in threads.with_tool_results(calls, results).collect()}
    assert got == {"1": ("failed", "new"), "2": ("completed", None), "": ("completed", None)}
    one = spark.createDataFrame([("a", "running"), ("b", "x"), ("b", "y")], "thread_id string, status string")
    assert {r.thread_id: (r.status, r.summary) for r in threads.tool_status(one).collect()} == {"a": ("running", "Used 1 tool"), "b": ("completed", "Used 2 tools")}


def test_chat_files(spark, tmp_path):
    thread = {
        "threadId": "Chat 1",
        "title": "T",
        "createdAt": 0,
        "updatedAt": 5000,
        "checkpoints": {"b": {"checkpoint": 2}, "a": {"checkpoint": 1}},
        "writes": {"b": [["task", "messages", {"x": 1}], ["__error__", {"message": "own"}]], "z": [["task", "__error__", {"message": "late", "name": "E"}], ["task", "other", 1], "bad", ["x"]], "c": [["__error__", "text"]]},
    }
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.chat").write_text(json.dumps(thread, indent=2))
    (tmp_path / "bad.chat").write_text("{ no json")
    (tmp_path / "none.chat").write_text('{"title": "x"}')
    t = tables.chat_files(spark, f"file://{tmp_path}")
    assert [r.thread_id for r in tables.thread_index(t).collect()] == ["Chat 1"]
    points = tables.checkpoints(t)
    assert threads.latest_checkpoint(points).first().checkpoint_id == "b"
    assert [r.checkpoint_id for r in threads.checkpoints_before(points, "b", 0).collect()] == ["a"]
    rows = threads.writes_with_errors(tables.writes(t), spark.createDataFrame([("Chat 1", "b")], "thread_id string, chosen string")).orderBy("place").collect()
    assert [(r.checkpoint_id, r.channel) for r in rows] == [("b", "messages"), ("b", "__error__"), ("c", "__error__"), ("z", "__error__")]
    flat = spark.createDataFrame([("t", r.channel, r.value.startswith("{"), json.loads(r.value)["message"] if r.value.startswith('{"m') else None, i) for i, r in enumerate(rows)], "thread_id string, channel string, is_object boolean, message string, i long")
    assert tuple(threads.errors(flat, "i").first())[1:] == (3, "late")


def test_stores(spark, tmp_path):
    now = spark.createDataFrame([("a", 1), ("b", 1)], "thread_id string, v long")
    new = spark.createDataFrame([("b", 2, 1), ("c", 3, 1), ("b", 4, 2)], "thread_id string, v long, n long")
    merged = tables.upsert(now, new, "thread_id", "n")
    assert sorted(map(tuple, merged.collect())) == [("a", 1), ("b", 4), ("c", 3)]
    assert tables.delete(merged, now, "thread_id").first().thread_id == "c"
    path = f"file://{tmp_path}/threads"
    tables.save_threads(now, path)
    tables.save_threads(spark.createDataFrame([("b", 9)], "thread_id string, v long"), path)
    assert sorted((r.thread_id, r.v) for r in tables.saved_threads(spark, path).collect()) == [("a", 1), ("b", 9)]
    models = spark.createDataFrame([("o", '{"data":[{"id":"m"},{"id":" "},{"id":null},{}]}'), ("l", '{"models":[{"name":"n"}]}'), ("e", "{}")], "provider string, body string")
    assert sorted(map(tuple, tables.discovered_models(models).collect())) == [("l", "n"), ("o", "m")]
    assert sorted(r.folder for r in tables.folders(spark.createDataFrame([("a/b/c.md",), ("d.md",)], "path string")).collect()) == ["a", "a/b"]


def test_catalog(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    none = spark.createDataFrame([], "k int, v string")
    assert catalog.semi_or_all(a, none, ["k"]).count() == 2 and [r.k for r in catalog.semi_or_all(a, a.where("k = 2"), ["k"]).collect()] == [2]
    assert {r.k: r.v for r in catalog.prefer(a.where("k = 1"), spark.createDataFrame([(1, "no"), (3, "z")], "k int, v string"), "k").collect()} == {1: "x", 3: "z"}
    assert {r.k: r.v for r in catalog.merge_defaults(a, spark.createDataFrame([(2, "own"), (4, "n")], "k int, v string"), "k", "v").collect()} == {1: "x", 2: "own", 4: "n"}
    servers = spark.createDataFrame([("1", True, "stdio", "npx", ["-y"], {}, None, None), ("2", True, "http", None, None, None, "http://h", {"A": "b"}), ("3", False, "sse", None, None, None, "u", None)], "id string, enabled boolean, transport string, command string, args array<string>, env map<string,string>, url string, headers map<string,string>")
    assert {r.id: json.loads(r.connection) for r in catalog.enabled_servers(servers).collect()} == {"1": {"transport": "stdio", "command": "npx", "args": ["-y"]}, "2": {"transport": "http", "url": "http://h", "headers": {"A": "b"}}}
    prompts = spark.createDataFrame([(2, True, True, "B"), (1, True, True, "A"), (3, True, False, "C"), (4, True, True, " ")], "ord int, enabled boolean, plugin_enabled boolean, prompt string")
    assert catalog.enabled_prompts(prompts).first().prompt == "A\n\nB"
    names = spark.createDataFrame([("My Server",), ("my-server",), ("Other",)], "name string")
    assert [tuple(r) for r in catalog.slug_conflicts(names).collect()] == [("my-server", 2)]
    tools = spark.createDataFrame([("t", None, "own")], "id string, name string, description string")
    defaults = spark.createDataFrame([("t", "Default", "d")], "id string, name string, description string")
    assert tuple(catalog.with_fallback(tools, defaults, "id", ["name", "description"]).first()) == ("t", "Default", "own")
    providers = spark.createDataFrame([("p", True), ("q", True), ("r", False)], "provider string, is_configured boolean")
    states = spark.createDataFrame([("p", False), ("r", False)], "provider string, auth_ok boolean")
    assert [r.provider for r in catalog.unavailable(providers, states).collect()] == ["p"]
