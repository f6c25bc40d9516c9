import json
import time

from pyspark.sql import functions as F

from memoria.operators import notes
from memoria.sources import files, transcripts
from memoria.streaming import changes, live


def test_exports_and_transcripts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"uuid": "x", "extra": 1, "chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "assistant", "text": "yo"}]}]))
    (tmp_path / "b.json").write_text(json.dumps([{"conversation_id": "y", "messages": [{"author": {"role": "user"}, "content": {"parts": ["a", "b"]}}]}]))
    (tmp_path / "c.json").write_text(json.dumps([{"id": "z", "turns": [{"speaker": "User", "body": "q"}]}]))
    (tmp_path / "t.txt").write_text("before\nUser: one\nmore\nAssistant:two\nUser: three")
    got = [[tuple(r) for r in f(spark, str(tmp_path / n)).collect()] for f, n in ((transcripts.read_export_a, "a.json"), (transcripts.read_export_b, "b.json"), (transcripts.read_takeout, "c.json"))]
    assert got == [[("x", 0, "user", "hi"), ("x", 1, "assistant", "yo")], [("y", 0, "user", "a\nb")], [("z", 0, "user", "q")]]
    turns = [(r.role, r.text) for r in transcripts.read_transcripts(spark, str(tmp_path / "t.txt")).orderBy("turn").collect()]
    assert turns == [("user", "one\nmore"), ("assistant", "two"), ("user", "three")]
    raw = spark.createDataFrame([('{"messages":[]}',), ('{"chat_messages":[]}',), ("User: x",), ("{}",), ("plain",), (None,)], "raw string")
    assert [r[0] for r in raw.select(transcripts.detected_format(F.col("raw"))).collect()][:5] == ["export_b", "export_a", "transcript", "json", "unknown"]


def test_crawl_skip_and_sinks(spark, tmp_path):
    for p, text in (("in/one/a.md", "a"), ("in/one/node_modules/b.md", "b"), ("in/two/d - Copy.md", "c"), ("in/two/c.lock", "c"), ("in/two/d.md", "d")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    found = files.crawl(spark, str(tmp_path / "in"))
    readable = found.filter(files.is_readable(F.col("path")))
    assert sorted((r.project, r.name) for r in readable.collect()) == [("one", "a.md"), ("two", "c.lock"), ("two", "d.md")]
    index = readable.filter("name = 'a.md'").select("path", "sha")
    assert sorted(r.name for r in files.unseen(readable, index).collect()) == ["c.lock", "d.md"]
    assert files.stale(index, readable.filter("name = 'd.md'")).count() == 1
    out = str(tmp_path / "table")
    readable.select("path", "sha").write.parquet(out)
    new = readable.filter("name = 'd.md'").select("path", F.lit("new").alias("sha"))
    files.upsert(spark, new, out, ["path"], out + "2")
    assert sorted(len(r.sha) for r in spark.read.parquet(out + "2").collect()) == [3, 64, 64]
    files.append_log(new, str(tmp_path / "log"))
    files.append_log(new, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    files.route_by_flag(new.withColumn("sensitive", F.lit(True)), "sensitive", str(tmp_path / "routed"))
    assert (tmp_path / "routed/sensitive=true").is_dir()
    assert spark.read.parquet(files.replace_version(new, str(tmp_path / "v"))).count() == 1


def test_inbox_stream(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for i in range(3):
        (tmp_path / "raw" / f"{i}.md").write_text(f"note {i}\nmore")
    got = live.drained(live.watch_text(spark, str(tmp_path / "raw"), max_files=1))
    assert sorted(r.body for r in got.collect()) == [f"note {i}\nmore" for i in range(3)]


def test_projects_of_odd_folders(spark, tmp_path):
    folder = tmp_path / "a(1)+b"
    for p in ("x/one.md", "x/deep/two.md", "beside.md"):
        (folder / p).parent.mkdir(parents=True, exist_ok=True)
        (folder / p).write_text("words " * 300)
    assert sorted((r.project or "", r.name) for r in files.crawl(spark, str(folder)).collect()) == [("", "beside.md"), ("x", "one.md"), ("x", "two.md")]
    first = files.ingested(spark, str(folder))
    assert sorted((r.path.rsplit("/", 1)[1], r.chunk, len(r.words)) for r in first.collect()) == [(n, c, w) for n in ("beside.md", "one.md", "two.md") for c, w in ((0, 200), (1, 120))]
    assert files.ingested(spark, str(folder), first.select("path", "sha").distinct()).count() == 0


def test_documented_lists_and_captures(spark):
    assert len(files.EXCLUDED_FOLDERS) == 21 and len(files.SKIPPED_PARTS) == 9
    rows = spark.createDataFrame([("/home/a", False), ("/home/a/b", False), ("/home/ab", False), ("/home/c", True), ("/home/c", None)], "folder string, own boolean")
    assert [r[0] for r in rows.select(files.is_captured(F.col("folder"), ["/home/a"], F.col("own"))).collect()] == [False, False, True, False, True]


def test_lines_facts_and_tiers(spark, tmp_path):
    (tmp_path / "probes.jsonl").write_text('{"id":"p1","profile":"work","class":"indirect","prompt":"x","more":1}\nbroken\n')
    (tmp_path / "eval.jsonl").write_text('{"id":"q1","category":"recall","question":"which","expect":["fact:a"]}\n')
    assert [tuple(r) for r in transcripts.read_lines(spark, str(tmp_path / "probes.jsonl"), transcripts.PROBES).collect()] == [("p1", "work", "indirect", "x")]
    assert transcripts.read_lines(spark, str(tmp_path / "eval.jsonl"), transcripts.QUESTIONS).first().expect == ["fact:a"]
    facts = spark.createDataFrame([("k1", "s", False), ("k2", "t", True), ("k3", "u", None)], "key string, statement string, clinical boolean")
    files.write_facts(facts, str(tmp_path / "out"))
    read = lambda name: {r.key for r in transcripts.read_lines(spark, str(tmp_path / "out" / name), transcripts.FACTS).collect()}
    assert read("facts") == {"k1"} and read("clinical") == {"k2", "k3"}
    files.write_tiered(facts, F.col("key") == "k1", str(tmp_path / "tiers"))
    left = files.hot(spark, str(tmp_path / "tiers"))
    assert {r.key for r in left.collect()} == {"k2", "k3"}
    assert "PartitionFilters: [isnotnull(tier" in left._jdf.queryExecution().toString()
    assert files.table_columns({"f": facts})[2] == ("f", 2, "clinical", "boolean")


def test_long_transcripts_split_in_proportion(spark):
    body = "".join(f"User: {i}\nmore\nAssistant: yes\n" for i in range(20_000))
    turns = transcripts.split_speakers(spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "no speaker")], "id int, body string"), "id", "body")
    assert turns.count() == 40_000
    assert turns.filter("id = 1 and turn = 39998").first().text == "19999\nmore"


def test_formats_are_told_by_arrays(spark):
    raws = ['{"note":"messages","x":{"messages":[]}}', '[{"chat_messages":[]}]', '{"turns":[1]}', '{"messages":"text"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", transcripts.detected_format(F.col("raw")).alias("f"))
    assert [r.f for r in df.orderBy("i").collect()] == ["json", "export_a", "takeout", "json"]


def test_inbox_and_notes_part_and_the_latest_counts(spark, tmp_path):
    paths = spark.createDataFrame([("/x/raw/a.md",), ("/x/wiki/b.md",), ("/x/raw/wiki/c.md",), ("/x/wiki.md",), ("/x/y/d.md",)], "p string")
    assert [r[0] for r in paths.select(live.work_for(F.col("p"))).collect()] == ["compile", "index", "index", None, None]
    inbox, table, point = (str(tmp_path / x) for x in ("raw", "table", "point"))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.md").write_text("first")
    live.kept_current(live.watch_text(spark, inbox), table, point)
    (tmp_path / "raw" / "a2.md").write_text("other")
    (tmp_path / "raw" / "b.md").write_text("second")
    live.kept_current(live.watch_text(spark, inbox), table, point)
    assert sorted((r.path.rsplit("/", 1)[1], r.work, r.body) for r in live.current(spark, table).collect()) == [("a.md", "compile", "first"), ("a2.md", "compile", "other"), ("b.md", "compile", "second")]


def test_files_changed_in_place_and_gone(spark, tmp_path):
    inbox, table, point, listings = (str(tmp_path / x) for x in ("raw", "table", "point", "listings"))
    (tmp_path / "raw").mkdir()
    run = lambda: live.kept_current(changes.changed_files(spark, inbox, listings), table, point)
    now = lambda: sorted((r.path.rsplit("/", 1)[1], r.body) for r in live.current(spark, table).collect())
    (tmp_path / "raw" / "a.md").write_text("first")
    (tmp_path / "raw" / "b.md").write_text("other")
    (tmp_path / "raw" / "c.bin").write_text("not text")
    run()
    assert now() == [("a.md", "first"), ("b.md", "other")]
    (tmp_path / "raw" / "a.md").write_text("second, changed")
    run()
    assert now() == [("a.md", "second, changed"), ("b.md", "other")]
    run()
    assert spark.read.parquet(table).count() == 3  # nothing changed, nothing comes twice
    (tmp_path / "raw" / "b.md").unlink()
    (tmp_path / "raw" / "d.md").write_text("new")
    run()
    assert now() == [("a.md", "second, changed"), ("d.md", "new")]
    live.compacted(spark, table)
    assert now() == [("a.md", "second, changed"), ("d.md", "new")]
    assert spark.read.parquet(table).count() < 6
    (tmp_path / "raw" / "a.md").write_text("third")
    query = live.kept_current(changes.changed_files(spark, inbox, listings), table, point, every="1 second")
    for _ in range(60):
        time.sleep(0.5)
        if ("a.md", "third") in now():
            break
    query.stop()
    assert now() == [("a.md", "third"), ("d.md", "new")]


def test_a_batch_run_again_gives_the_same_paths(tmp_path):
    (tmp_path / "in").mkdir()
    reader = lambda: changes.ChangesReader(str(tmp_path / "in"), str(tmp_path / "listings"), (".md",), 2)
    one, offsets = reader(), [reader().initialOffset()]
    for i in range(5):
        (tmp_path / "in" / f"{i}.md").write_text("x" * i)
        if i in (1, 4):
            offsets.append(one.latestOffset())
    assert offsets[1:] == [{"listing": 1}, {"listing": 2}] and one.latestOffset() == offsets[2]
    paths = lambda r, a, b: [[p.rsplit("/", 1)[1] for p, _ in part.paths] for part in r.partitions(a, b)]
    assert paths(reader(), offsets[0], offsets[1]) == [["0.md", "1.md"]]
    assert paths(reader(), offsets[1], offsets[2]) == paths(one, offsets[1], offsets[2]) == [["2.md", "3.md"], ["4.md"]]
    two = reader()
    assert two.latestOffset() == offsets[2]
    (tmp_path / "in" / "0.md").unlink()
    end = two.latestOffset()
    (gone,) = two.partitions(offsets[2], end)
    assert [(g, b) for _, _, g, b in two.read(gone)] == [(True, None)]
    two.commit(end)
    assert sorted(p.name for p in (tmp_path / "listings").iterdir()) == ["000000002.json", "000000003.json"]


def test_upsert_touches_only_its_parts(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, "k bigint, at int, v string")
    put = lambda rows: files.upsert_parts(spark, frame(rows), path, ["k"], "at", parts=8)
    rows = lambda: sorted((-1 if r.k is None else r.k, r.at, r.v) for r in spark.read.parquet(path).collect())
    listed = lambda: {str(p.relative_to(path)) for p in (tmp_path / "table").rglob("part-*.parquet")}
    put([(i, 1, f"a{i}") for i in range(40)] + [(3, 2, "newer"), (3, 0, "older"), (None, 1, "n")])
    want = {i: (1, f"a{i}") for i in range(40)} | {3: (2, "newer"), -1: (1, "n")}
    assert rows() == sorted((k, *v) for k, v in want.items())
    before = listed()
    files.upsert_parts(spark, frame([(5, 1, "again"), (7, 0, "too old"), (None, None, "no time")]), path, ["k"], "at", parts=3)
    want |= {5: (1, "again")}
    assert rows() == sorted((k, *v) for k, v in want.items())
    assert len(before & listed()) >= len({p.split("/")[0] for p in before}) - 3 and before != listed()
    put([])
    assert rows() == sorted((k, *v) for k, v in want.items())


def test_export_with_a_tree_of_messages(spark, tmp_path):
    node = lambda parent, role=None, *parts: {"id": "x", "parent": parent, "children": [], "message": role and {"author": {"role": role}, "content": {"content_type": "text", "parts": list(parts)}}}
    tree = {"r": node(None), "c": node("b", "assistant", "first answer"), "a": node("r", "system", ""), "b": node("a", "user", "question", {"image": 1}), "d": node("b", "assistant", "second answer"), "e": node("d", "user", "thanks")}
    export = [{"title": "t", "conversation_id": "k", "current_node": "e", "mapping": tree, "more": 1}, {"id": "ring", "mapping": {"p": node("q", "user", "1"), "q": node("p", "user", "2")}}, {"id": "none", "mapping": {}}]
    (tmp_path / "conversations.json").write_text(json.dumps(export))
    rows = transcripts.read_export_b(spark, str(tmp_path / "conversations.json")).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in rows if r.conv_id == "k"] == [("k", 0, "system", ""), ("k", 1, "user", 'question\n{"image": 1}'), ("k", 2, "assistant", "second answer"), ("k", 3, "user", "thanks")]
    assert sorted(r.text for r in rows if r.conv_id == "ring") == ["1", "2"] and not [r for r in rows if r.conv_id == "none"]
    both = transcripts.read_export_b(spark, str(tmp_path / "conversations.json"), branches=True).filter("branch = 1").collect()
    assert [tuple(r) for r in both] == [("k", 1, 0, "assistant", "first answer")]
    raw = spark.createDataFrame([(json.dumps(export),), (json.dumps(export[0]),), ('{"mapping":[]}',)], "raw string")
    assert [r[0] for r in raw.select(transcripts.detected_format(F.col("raw"))).collect()] == ["export_b", "export_b", "json"]
    (tmp_path / "p.json").write_text(json.dumps({"uuid": "u", "name": "n", "docs": [{"filename": "f.md", "content": "body", "x": 1}]}))
    assert [tuple(r) for r in transcripts.read_projects_a(spark, str(tmp_path / "p.json")).collect()] == [("u", "n", "f.md", "body")]


def test_graph_sink_and_forced_index(spark, tmp_path):
    notes = spark.createDataFrame([(1, "a"), (2, "b")], "page_id bigint, title string")
    links = spark.createDataFrame([(1, 2), (1, 2), (2, None)], "page_id bigint, dst bigint")
    files.write_graph(notes, links, str(tmp_path))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "edges")).collect()] == [(1, 2)] and spark.read.parquet(str(tmp_path / "vertices")).count() == 2
    items = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha string")
    assert files.reindexed(items, items.limit(1)).count() == 1 and files.reindexed(items, items, force=True).count() == 2


def test_inbox_files_become_notes(spark, tmp_path):
    rows = [("raw/a.md", "x", "talk\n---\ntitle: \"First note\"\naliases: [one, 'The First']\ndomain: maths\n---\nSee [[second]] and [[nowhere]]."), ("raw/b.md", "x", "\n## Second\n\nBack to [[The first|it]], [[Second]]."), ("raw/c.md", None, None), ("raw/d.md", "y", "# Second\nalone")]
    files_ = spark.createDataFrame([(p, d, None, "sha", b) for p, d, b in rows], "path string, domain string, changed timestamp, sha string, body string")
    made = notes.compiled(files_)
    got = {r.path: r for r in made.collect()}
    assert [(got[f"raw/{x}.md"].title, got[f"raw/{x}.md"].domain) for x in "abcd"] == [("First note", "maths"), ("Second", "x"), ("raw/c.md", "general"), ("Second", "y")]
    assert got["raw/a.md"].aliases == ["one", "The First"] and len({r.name for r in got.values()}) == 4
    assert got["raw/a.md"].note.startswith("---\ntitle: First note\naliases: [one, The First]\ndomain: maths\nupdated: \nprovenance: raw/a.md sha\n---\nSee")
    edges = notes.note_edges(made)
    name = {p: r.name for p, r in got.items()}
    second = min(name["raw/b.md"], name["raw/d.md"])
    want = {(name["raw/a.md"], second), (name["raw/b.md"], name["raw/a.md"])} | ({(name["raw/b.md"], second)} if second != name["raw/b.md"] else set())
    assert {tuple(r) for r in edges.collect()} == want
    lines = [tuple(r) for r in notes.index_lines(made, edges).collect()]
    assert ("1 totals", "total_entities: 4") in lines and ("2 namespaces", "- maths: 1") in lines and ("4 orphans", f"- [[{name['raw/c.md']}]]") in lines
    out = made.select(F.concat("domain", F.lit("/"), "name", F.lit(".md")).alias("name"), F.col("note").alias("body"))
    assert files.write_files(out, str(tmp_path / "wiki")) == files.write_files(out, str(tmp_path / "wiki")) == 4
    assert len(list((tmp_path / "wiki").rglob("*"))) == 4 + 4
    assert (tmp_path / "wiki" / "maths" / f"{name['raw/a.md']}.md").read_text() == got["raw/a.md"].note


def test_entities_beside_the_facts(spark, tmp_path):
    rows = [("relationships", "Ann", "friend", False), ("relationships", " ann", "colleague", False), ("relationships", "Bob", "", False), ("intellectual_themes", "graphs", None, False), ("relationships", "Secret", "doctor", True), ("biography", "born", "x", False)]
    facts = spark.createDataFrame(rows, "bucket string, statement string, evidence string, clinical boolean")
    files.write_facts(facts, str(tmp_path))
    got = spark.read.schema("entity string, kind string, roles array<string>, mentions bigint").json(str(tmp_path / "entities"))
    assert sorted(tuple(r) for r in got.collect()) == [("Ann", "person", ["colleague", "friend"], 2), ("Bob", "person", [], 1), ("graphs", "theme", [], 1)]


def test_activity_of_a_takeout(spark, tmp_path):
    entries = [{"header": "H", "title": "Prompted why & how", "time": "t1", "safeHtmlItem": [{"html": "<p>Because <b>1 &lt; 2</b></p><p>so</p>"}], "products": ["H"]}, {"header": "H", "title": "Prompted more", "time": "t2"}, {"header": "H", "title": "Visited x", "time": "t3"}]
    (tmp_path / "MyActivity.json").write_text(json.dumps(entries))
    rows = [tuple(r) for r in transcripts.read_activity(spark, str(tmp_path / "MyActivity.json")).orderBy("conv_id", "turn").collect()]
    assert rows == [("t1", 0, "user", "why & how"), ("t1", 1, "assistant", "Because 1 < 2\nso"), ("t2", 0, "user", "more")]
    raw = spark.createDataFrame([(json.dumps(entries),), ('[{"title":"x","time":1}]',)], "raw string")
    assert [r[0] for r in raw.select(transcripts.detected_format(F.col("raw"))).collect()] == ["activity", "json"]


def test_sessions_captured_again_count_once(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    where, table, point, listings = (str(tmp_path / x) for x in ("sessions", "table", "point", "listings"))
    run = lambda: live.kept_current(changes.changed_files(spark, where, listings), table, point)
    (tmp_path / "sessions" / "one.md").write_text("User: hi\nAssistant: yo")
    run()
    (tmp_path / "sessions" / "one.md").write_text("User: hi\nAssistant: yo\nUser: more")
    (tmp_path / "sessions" / "two.txt").write_text("User: other")
    run()
    assert sorted((r.path[-7:], r.turn, r.role, r.text) for r in live.captured_turns(spark, table).collect()) == [("/one.md", 0, "user", "hi"), ("/one.md", 1, "assistant", "yo"), ("/one.md", 2, "user", "more"), ("two.txt", 0, "user", "other")]
