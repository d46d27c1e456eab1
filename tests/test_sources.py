"""Files of notes and chats: front matter, blocks, renames, paths, the index."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.functions.frontmatter import parse
from quillgrid.operators import metadata, search
from quillgrid.plans.notes_query import NotesQuery, prop, tag
from quillgrid.sources import chats, index, markdown


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: 1\nb: -2.5\nc: yes\nd: true\ne: ~\nf:\ng: 2024-01-02", {"a": 1, "b": -2.5, "c": "yes", "d": True, "e": None, "f": None, "g": "2024-01-02"}),
        ("tags: [a, 'b c', \"d\\n\\u00e9\"]", {"tags": ["a", "b c", "d\né"]}),
        ("tags:\n- a\n- b # no\nnext: x#y", {"tags": ["a", "b"], "next": "x#y"}),
        ("tags:\n    - a\n    -\n    - [1, {k: v}]", {"tags": ["a", None, [1, {"k": "v"}]]}),
        ("n:\n  k: v\n  l:\n    m: 1\no: 2", {"n": {"k": "v", "l": {"m": 1}}, "o": 2}),
        ("l:\n- k: 1\n  m: 2\n- - x\n  - y", {"l": [{"k": 1, "m": 2}, ["x", "y"]]}),
        ("t: |\n  one\n   two\n\n  three\nf: >-\n  a\n  b\n\n  c\nk: |+\n  x\n\n", {"t": "one\n two\n\nthree\n", "f": "a b\nc", "k": "x\n\n\n"}),
        ("url: https://x.y/z?a=b\ntime: 10:30", {"url": "https://x.y/z?a=b", "time": "10:30"}),
        ("long: [1,\n  2]\nq: \"a\n  b\"\np: plain\n  goes on", {"long": [1, 2], "q": "a b", "p": "plain goes on"}),
        ("'it''s': \"say \\\"hi\\\"\"\n1: one", {"it's": 'say "hi"', "1": "one"}),
        ("{a: 1, b: [x]}", {"a": 1, "b": ["x"]}),
        ("# c\n\na: 1 # x\r\nb: '#no'\r\n", {"a": 1, "b": "#no"}),
    ],
)
def test_front_matter(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text", ["", "  ", "# only", "text", "- a\n- b", "a: 1\na: 2", "a: b: c", "a: [1", "a: 'x", "a: \"\\q\"", "\ta: 1", "a:\n   b: 1\n  c: 2", "a: *x", "a: &b c", "a: - b", "a: 1\n  b: 2", "[" * 4000, "a: " + "[" * 4000, "a: ]", "a: {x: 1, x: 2}", "---\na: 1", None])
def test_front_matter_that_is_malformed_or_none_is_null(text):
    assert parse(text) is None


def note(spark, text, path="d/n.md"):
    files = spark.createDataFrame([(path, None, 1, bytearray(text.encode() if isinstance(text, str) else text))], "path string, modificationTime timestamp, length long, content binary")
    return markdown.parsed_notes(files).first()


@pytest.mark.parametrize(
    ("body", "tags"),
    [
        ("#a #b/c-d_e #Ü", ["#a", "#b/c-d_e", "#Ü"]),
        ("#1984 #1984x #-", ["#1984x", "#-"]),
        ("x#no [#no](y) \\#no (#no)", []),
        ("```\n#no\n```\n#yes", ["#yes"]),
        ("````md\n#no\n```\n#no\n````\n#yes", ["#yes"]),
        ("~~~\n#no\n```\n#no\n~~~~~\n#yes", ["#yes"]),
        ("```\n#no to the end", []),
        ("``` `#x` ```\n#yes", ["#yes"]),
        ("```\n```\n#yes\n```\n\n```\n#yes2", ["#yes", "#yes2"]),
        ("`#no` ``a ` #no`` #yes `open\n\n#yes2` #yes3", ["#yes", "#yes2", "#yes3"]),
        ("`two\n#no lines` #yes", ["#yes"]),
        ("#a\r\n#b\r#c", ["#a", "#b", "#c"]),
    ],
)
def test_inline_tags(spark, body, tags):
    assert note(spark, body).tags == tags


def test_headings_links_and_listed_tags(spark):
    r = note(spark, "---\r\ntags: [x, 3]\nalias: [a]\n---\r\n# One #\n##No\n  ### Two ## \n[[A|b]] `[[no]]`\n```\n# no\n[[no]]\n```\n#in")
    assert (r.tags, r.headings, r.links, json.loads(r.properties)) == (["#in", "#x", "#3"], ["One", "Two"], ["A"], {"tags": ["x", 3], "alias": ["a"]})
    assert (r.ord, r.name) == ("d/n.md", "n")


def test_front_matter_only_at_the_start_and_closed(spark):
    assert note(spark, "x\n---\na: 1\n---\n").properties is None
    r = note(spark, "---\na: 1\n#open")
    assert r.properties is None and r.tags == ["#open"]
    assert note(spark, "---\n---\n#t").tags == ["#t"]
    r = note(spark, "---\na: [\n---\n#t")
    assert (r.front_matter, r.properties, r.tags) == ("a: [", None, ["#t"])


def test_very_long_note(spark):
    text = "---\na: 1\n---\n" + "word #tag `code #no`\n\n```\n#no\n```\n" * 30_000
    r = note(spark, text)
    assert len(r.tags) == 30_000 and set(r.tags) == {"#tag"}


def test_a_folder_of_notes_is_searched_and_queried(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "n.md").write_text("---\ntags: [a]\nsize: 3\n---\n# Head\nText #tag/x and [[Other|o]].\n")
    (tmp_path / "bad.md").write_text("---\na: [\n---\n#two text\n")
    (tmp_path / "skip.txt").write_text("text")
    (tmp_path / "latin.md").write_bytes("# Caf\xe9\nx".encode("latin-1"))
    notes = markdown.markdown(spark, f"file://{tmp_path}")
    assert [r.name for r in search.grep(notes, "TEXT").collect()] == ["bad", "n"]
    assert [r.tag for r in metadata.distinct_tags(notes).collect()] == ["#a", "#tag/x", "#two"]
    assert [r.key for r in metadata.property_keys(notes).collect()] == ["size", "tags"]
    assert [(r.key, r.value) for r in metadata.properties_of(notes, "n").collect()] == [("tags", '["a"]'), ("size", "3")]
    assert metadata.read_note(notes, notes.where("name = 'latin'").first().path, 6).first().content.startswith("# Caf\ufffd")
    found = NotesQuery({"size": prop("size", "long")}, tag("a")).run(notes).collect()
    assert [(r.link[-6:], r["size"]) for r in found] == [("d/n.md", 3)]


# Chats


def one_after_another(files, wanted):
    """The plain loop: names in use, one request at a time."""
    names, out, clean = set(files), [], lambda t: " ".join("".join("-" if c in '<>:"/|?*\\' else c for c in t).split())[:100]
    for path, thread, title, _ in sorted(wanted, key=lambda r: (r[3], r[0])):
        if title is None or not title.strip() or path not in names:
            continue
        new = path[: path.rindex("/") + 1] + f"{clean(title)} - {thread[5:] if thread.startswith('Chat ') else thread}.chat"
        if new != path and new not in names:
            names = names - {path} | {new}
            out.append((path, new))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_renames_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    spots = [f"c/{t} - {s}.chat" for t in "abcde" for s in ("1", "2")] + [f"c/Chat {s}.chat" for s in ("1", "2")]
    files = rng.sample(spots, rng.randrange(4, len(spots)))
    wanted = []
    for path in rng.sample(files, len(files) - 1) + ["c/missing - 1.chat"]:
        wanted.append((path, f"Chat {path[-6]}" if rng.random() < 0.8 else path[-6], rng.choice(["a", "b", "c", "d", "e", " a ", " ", None]), rng.randrange(8)))
    df = spark.createDataFrame(wanted, "path string, thread_id string, title string, ord int")
    got = sorted(map(tuple, chats.renamed(spark.createDataFrame([(f,) for f in files], "path string"), df).collect()))
    assert got == one_after_another(files, wanted)


def test_long_chains_and_swaps(spark):
    files = [f"c/n{i} - t.chat" for i in range(60)]
    chain = [(f"c/n{i} - t.chat", "Chat t", f"n{i + 1}", 100 - i) for i in range(60)]  # the last moves first
    swap = [("c/x - t.chat", "t", "y", 1), ("c/y - t.chat", "t", "x", 2)]
    for rows in (chain, [r for r in chain if r[3] != 70], swap, [(p, t, n, -o) for p, t, n, o in chain]):
        every = files + ["c/x - t.chat", "c/y - t.chat"]
        got = chats.renamed(spark.createDataFrame([(f,) for f in every], "path string"), spark.createDataFrame(rows, "path string, thread_id string, title string, ord int"))
        assert sorted(map(tuple, got.collect())) == one_after_another(every, rows)


def test_paths_of_all_threads_equal_the_rule_for_one(spark):
    rng = random.Random(4)
    ids = [f"Chat {t}" for t in ("2024-01-02 10-00-00", "2024-01-02 10-00-01", "7", "7 - 8")] + ["2024-01-02 10-00-00", "x", "", "z" * 300]
    names = [rng.choice(["Chat ", "T - ", "a - b - ", "old Chat ", "x", ""]) + rng.choice(["2024-01-02 10-00-00", "2024-01-02 10-00-01", "7", "8", "7 - 8"]) + rng.choice([".chat", " copy.chat", ".md"]) for _ in range(40)]
    files = spark.createDataFrame([(f"d/{n}",) for n in names], "path string")
    got = {r.thread_id: r.path for r in chats.chat_paths(files, spark.createDataFrame([(i,) for i in ids + ids[:2]], "thread_id string")).collect()}
    want = {i: chats.chat_path(files, i).first().path for i in ids if i}
    assert len(got) == len(ids) and {i: p for i, p in got.items() if i} == want
    plan = chats.chat_paths(files, spark.createDataFrame([("x",)], "thread_id string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# The index


def test_index_parses_only_what_changed(spark, tmp_path):
    folder, path = tmp_path / "notes", f"file://{tmp_path}/index"
    folder.mkdir()

    def parse(files):
        notes = markdown.parsed_notes(files)
        return notes.select("path", "name", "tags")

    def refreshed():
        done = index.refresh(spark, f"file://{folder}", path, "*.md", parse)
        rows = sorted((r.name, tuple(r.tags)) for r in done.rows.collect())
        fresh = sorted((r.name, tuple(r.tags)) for r in markdown.markdown(spark, f"file://{folder}").collect())
        assert rows == fresh
        return done.parsed, done.gone

    assert index.refresh(spark, f"file://{folder}", path, "*.md", parse).parsed == 0
    for i in range(5):
        (folder / f"n{i}.md").write_text(f"#t{i}")
    assert refreshed() == (5, 0)
    assert refreshed() == (0, 0)
    (folder / "n1.md").write_text("#changed and longer")
    (folder / "n9.md").write_text("#new")
    (folder / "n2.md").unlink()
    assert refreshed() == (2, 1)
    (folder / "n3.md").unlink()
    assert refreshed() == (0, 1)
    for broken in (tmp_path / "index" / "manifests").glob("*.json"):
        broken.write_text("{ no json")
    assert refreshed() == (4, 0)
    assert refreshed() == (0, 0)


def test_index_of_many_changes_scans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_NAMED", 2)
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("#a")
    parse = lambda files: markdown.parsed_notes(files).select("path", "name", "tags")
    index.refresh(spark, f"file://{folder}", f"file://{tmp_path}/i", "*.md", parse)
    for i in range(5):
        (folder / f"n{i}.md").write_text(f"#t{i}")
    done = index.refresh(spark, f"file://{folder}", f"file://{tmp_path}/i", "*.md", parse)
    assert done.parsed == 5 and done.rows.agg(F.count("*")).first()[0] == 6


def test_names_of_one_task_are_dealt_and_cut_only_where_an_id_may_begin(spark):
    rng = random.Random(4)
    ids = {"".join(rng.choices("ab- ", k=rng.randrange(1, 8))) for _ in range(60)} | {"Chat 7", "x.chat"}
    names = {"".join(rng.choices("ab- ", k=rng.randrange(0, 14))) for _ in range(150)} | {"a - 7", "Chat 7", "x"} | set(list(ids)[:9])
    files = spark.createDataFrame([(f"f/{n}.chat",) for n in names], "path string").coalesce(1)
    assert chats._names(files).rdd.getNumPartitions() > 1
    want = {}
    for i in ids:
        stamp = i.removeprefix("Chat ")
        ranked = [(1 if n == i else 2 if i in f"{n}.chat" else 3, f"f/{n}.chat") for n in names if i in f"{n}.chat" or f"{n}.chat".endswith(f" - {stamp}.chat")]
        want[i] = min(ranked)[1] if ranked else None
    found = chats.chat_paths(files, spark.createDataFrame([(i,) for i in ids], "thread_id string"))
    assert {r.thread_id: r.path for r in found.collect()} == want
