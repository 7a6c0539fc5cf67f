import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators import reports
from lectern.plans import scaffold, services
from lectern.plans.config import ProjectConfig, editor_width
from lectern.sources import converter, files
from lectern.streaming import documents
from lectern.streaming.debounce import debounced, stream_debounced


def test_config(tmp_path):
    text = 'extra_abbreviations = ["Foo"]\nignore = ["*.bib"]\nmax_width = 80\nlang = "de"\nunknown = 1\n[org]\nextra_abbreviations = ["Bar"]\nmax_width = 0\n'
    c = ProjectConfig.parse(text)
    assert c.abbreviations("org") == ["Foo", "Bar"] and c.abbreviations("rst") == ["Foo"] and c.width("org") == 0 and c.width("rst") == 80
    (tmp_path / ".rc.toml").write_text(text)
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert ProjectConfig.find(tmp_path / "a" / "b", ".rc.toml") == c
    assert ProjectConfig.find(tmp_path, ".other.toml") == ProjectConfig()
    assert editor_width("[*]\nmax_line_length = 90\n[*.{md,org}]\nmax_line_length = off\n", "a/x.tex") == 90
    assert editor_width("[*]\nmax_line_length = 90\n[*.{md,org}]\nmax_line_length = off\n", "x.md") is None


def test_reports(spark):
    df = spark.createDataFrame([("r", "b.md", 3, 4), ("r", "a.md", 1, 2), ("s", None, None, None)], "run string, file string, original_lines int, formatted_lines int")
    got = {r.run: json.loads(r.report) for r in reports.json_report(df, "run").collect()}
    assert [x["file"] for x in got["r"]] == ["a.md", "b.md"] and got["s"] == [{"file": None, "original_lines": None, "formatted_lines": None}]
    sarif = json.loads(reports.sarif_report(df.where("run = 'r'"), "run").first()["report"])
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == 2
    codes = {r.run: r.exit_code for r in reports.exit_codes(df, "run", F.col("original_lines") != F.col("formatted_lines")).collect()}
    assert codes == {"r": 1, "s": 0}


def brute(times, quiet):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= quiet:
            kept.append(t)
    return kept


def test_debounce(spark):
    import random

    random.seed(4)
    base = datetime(2025, 1, 1)
    rows = [(k, base + timedelta(milliseconds=random.randint(0, 20_000))) for k in ("a", "b", None) for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    for stretch in (1, 3, 3600):
        got = {}
        for r in debounced(df, "k", "ts", 200, stretch).collect():
            got.setdefault(r.k, []).append(r.ts)
        for k in ("a", "b"):
            assert sorted(got[k]) == brute([t for x, t in rows if x == k], timedelta(milliseconds=200))
        assert set(got) == {"a", "b"}
    assert debounced(df.limit(0), "k", "ts").count() == 0


def test_stream_debounce(spark, tmp_path):
    base = datetime(2025, 1, 1)
    rows = [("a", base + timedelta(milliseconds=m)) for m in (0, 100, 250, 300, 460)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_debounced(stream, "k", "ts").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r.ts for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == brute([t for _, t in rows], timedelta(milliseconds=200))


def test_watch(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# H\n\nOne a. Two b.\n")
    (folder / "b.txt").write_text("Only one.\n")
    (folder / "c.bib").write_text("X y. Z w.\n")
    out = []
    q = documents.watch(documents.watched(spark, str(folder)), lambda: ProjectConfig(ignore=("*.bib",)), lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert [(r.path.rsplit("/", 1)[-1], r.formatted) for r in out] == [("a.md", "# H\n\nOne a.\nTwo b.\n")]


def test_open_documents(spark):
    rows = [("u", 1, "A b. C d.", False), ("u", 2, "A b.\nC d. E f.", False), ("v", 1, "X y. Z w.", False), ("v", 2, None, True), (None, 1, "q", False)]
    changes = spark.createDataFrame(rows, "uri string, version int, text string, closed boolean")
    assert [(r.uri, r.version) for r in documents.latest_documents(changes).collect()] == [("u", 2)]
    assert [(r.uri, r.line) for r in documents.open_diagnostics(changes).collect()] == [("u", 1)]
    state = documents.merged_state(None, changes)
    assert [(r.uri, r.version) for r in state.collect()] == [("u", 2)]  # closed documents leave it
    later = spark.createDataFrame([("u", 3, "Z.", False), ("w", 1, "A b. C.", False)], changes.schema)
    assert sorted((r.uri, r.version) for r in documents.merged_state(state, later).collect()) == [("u", 3), ("w", 1)]
    assert [r.uri for r in documents.republished(documents.merged_state(state, later), ProjectConfig()).collect()] == ["w"]
    assert documents.republished(documents.merged_state(state, later), ProjectConfig(ignore=("w",))).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "d" / ".hidden").mkdir(parents=True)
    (tmp_path / "d" / "a.org").write_text("x")
    (tmp_path / "d" / ".hidden" / "b.org").write_text("y")
    got = files.read_documents(spark, str(tmp_path / "d"), recursive=True).collect()
    assert [r.text for r in got] == ["x"]
    assert files.read_documents(spark, str(tmp_path / "d" / "*.org")).count() == 1
    (tmp_path / ".top" / "e").mkdir(parents=True)
    (tmp_path / ".top" / "e" / "a.org").write_text("z")
    assert [r.text for r in files.read_documents(spark, str(tmp_path / ".top"), recursive=True).collect()] == ["z"]  # only folders below count
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, text string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, text string")
    assert {r.path for r in files.changed_paths(old, new).collect()} == {"b", "c", "d"}


def test_converter():
    tree = json.dumps({"blocks": [
        {"t": "Header", "c": [1, ["", [], []], [{"t": "Str", "c": "Top"}]]},
        {"t": "Para", "c": [{"t": "Str", "c": "A"}, {"t": "Space"}, {"t": "Emph", "c": [{"t": "Str", "c": "b."}]}, {"t": "Note", "c": []}, {"t": "Math", "c": [{"t": "InlineMath"}, "x"]}]},
        {"t": "BulletList", "c": [[{"t": "Plain", "c": [{"t": "Link", "c": [["", [], []], [{"t": "Str", "c": "l"}], ["u", ""]]}]}]]},
        {"t": "CodeBlock", "c": [["", [], []], "x = 1"]}, {"t": "HorizontalRule"}, {"t": "Table", "c": []},
    ]})
    assert converter.tree_regions(tree) == [("structure", "Top\n"), ("prose", "A b.$x$"), ("prose", "l"), ("structure", "x = 1"), ("structure", "---\n"), ("structure", "[table]\n")]


def test_services(spark):
    services.register(spark)
    row = spark.sql("SELECT format_text('A b. C d.', 'plaintext', 0) AS f, split_sentences('A b. C d.') AS s, check_formatting('A b. C d.') AS c, detect_format('# x') AS d").first()
    assert row.f == "A b.\nC d." and row.s == ["A b.", "C d."] and row.c.violations == [1] and not row.c.passed and row.d == "markdown"

    row = spark.sql("SELECT format_text('A Krf. C d.', null, null, array('Krf.', null)) AS f, split_sentences('A Krf. C d.', array('Krf')) AS s, format_range('A b. C.\\nD. E.', 2, 2, null, 0) AS r, detect_format(null) AS d").first()
    assert row.f == "A Krf. C d." and row.s == ["A Krf. C d."] and row.r == "A b. C.\nD. E.".replace("D. E.", "D. E.") and row.d is None

    class Words:
        def split(self, text):
            return text.split()

    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [r.sentences for r in services.split_with(df, "t", Words).collect()] == [["a", "b"], None]
    prose = spark.createDataFrame([("# H\n\na b\n", "markdown"), (None, None)], "text string, format string")
    assert [r.formatted for r in services.format_with(prose, Words).collect()] == ["# H\n\na\nb\n", None]
    assert set(services.capabilities()) >= {"formatting", "hover", "reload"}
    assert services.splitter_for("de").split("A z.B. C.") == ["A z.B. C."] and services.version()


def test_editor_snippet():
    got = scaffold.editor_snippet(["org", "latex"])
    assert got.count("apheleia-mode-alist") == 2 and "org-mode" in got and got.count("(") == got.count(")")


def test_scaffold(tmp_path):
    (tmp_path / ".gitattributes").write_text("kept")
    new = scaffold.scaffold(tmp_path, ["org", "markdown"], ".rc.toml", dry_run=True)
    assert set(new) == {".rc.toml", ".pre-commit-config.yaml"} and not (tmp_path / ".rc.toml").exists()
    scaffold.scaffold(tmp_path, ["org"], ".rc.toml")
    assert ProjectConfig.parse((tmp_path / ".rc.toml").read_text()).format == "org" and (tmp_path / ".gitattributes").read_text() == "kept"


def test_editor_widths(spark, tmp_path):
    from lectern.plans.config import editor_width_of, editor_widths

    (tmp_path / ".editorconfig").write_text("root = true\n[*]\nmax_line_length = 90\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / ".editorconfig").write_text("[*.md]\nmax_line_length = 70\n[b/*.org]\nmax_line_length = 60\n")
    for name, width in (("a/x.md", 70), ("a/b/x.org", 60), ("a/x.tex", 90), ("x.md", 90)):
        assert editor_width_of(tmp_path / name) == width, name
    (tmp_path / "a" / ".editorconfig").write_text("root=true\n[*.md]\nmax_line_length = off\n")
    assert editor_width_of(tmp_path / "a" / "x.md") is None
    assert [tuple(r) for r in editor_widths(spark, [str(tmp_path / "x.md")]).collect()] == [(str(tmp_path / "x.md"), 90)]


def test_runs(spark, tmp_path):
    from lectern.plans import jobs

    texts = {"b.md": "# H\n\nOne a. Two b.\n", "a.txt": "A b. C d.\n", "c.org": "Fine.\n", "skip.md": "X y. Z w.\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / ".editorconfig").write_text("root = true\n[c.org]\nmax_line_length = 8\n")
    paths = [str(tmp_path / x) for x in texts]
    config = ProjectConfig(ignore=("skip.*",))
    shown = []
    assert jobs.run(spark, paths, config, write=shown.append).exit_code == 0
    assert shown == ["# H\n\nOne a.\nTwo b.\n", "A b.\nC d.\n", "Fine.\n", "X y.\nZ w.\n"]  # in the order asked for; nothing is left out
    got = jobs.run(spark, paths, config, "check")
    assert got.exit_code == 1 and got.output == f"would reformat: {paths[0]}\nwould reformat: {paths[1]}\n"
    assert [x["file"] for x in json.loads(jobs.run(spark, paths, config, "check", "json").output)] == sorted(paths[:2])
    got = jobs.run(spark, paths[:1], config, "diff")
    assert got.exit_code == 1 and "+One a.\n+Two b.\n" in got.output and jobs.run(spark, paths[2:3], config, "diff").exit_code == 0
    jobs.run(spark, paths, config, "output", target=str(tmp_path / "out"))
    assert (tmp_path / "out").read_text() == "X y.\nZ w.\n"  # the last one's
    sent = []
    assert jobs.integration_check(spark, [str(tmp_path / "*.md")], config, sent.append) == 1 and len(json.loads(sent[0])["runs"][0]["results"]) == 1
    jobs.run(spark, paths, config, "in_place")
    assert (tmp_path / "b.md").read_text() == "# H\n\nOne a.\nTwo b.\n" and (tmp_path / "skip.md").read_text() == texts["skip.md"]
    assert jobs.run(spark, paths, config, "check").exit_code == 0


def test_watching_files_that_change_in_place(spark, tmp_path):
    import time

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("Old one.\n")
    (folder / "c.bib").write_text("X.\n")
    out = []
    q = documents.watch_files(spark, [str(folder)], lambda: ProjectConfig(ignore=("*.bib",)), lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"))
    try:
        end = time.time() + 60
        while not (tmp_path / "cp" / "listing-0" / "_SUCCESS").exists() and time.time() < end:
            time.sleep(0.2)
        (folder / "a.md").write_text("One a. Two b.\n")
        (folder / "b.txt").write_text("New a. File b.\n")
        (folder / "c.bib").write_text("X y. Z w.\n")
        while len(out) < 2 and time.time() < end:
            time.sleep(0.2)
        (folder / "a.md").write_text("One a. Two b. Three c.\n")
        while len(out) < 3 and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    got = sorted((r.path.rsplit("/", 1)[-1], r.formatted) for r in out)
    assert got == [("a.md", "One a.\nTwo b.\n"), ("a.md", "One a.\nTwo b.\nThree c.\n"), ("b.txt", "New a.\nFile b.\n")]


def test_file_events(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5), ("d", 1, 5)], "path string, modified int, length int")
    new = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 1, 6), ("e", 1, 1)], "path string, modified int, length int")
    events = files.file_events(old, new)
    assert {(r.path, r.kind) for r in events.collect()} == {("b", "modify"), ("c", "modify"), ("d", "remove"), ("e", "create")}
    watched = spark.createDataFrame([("b",), ("d",)], "path string")
    assert {r.path for r in files.to_format(events).collect()} == {"b", "c", "e"} and [r.path for r in files.to_format(events, watched).collect()] == ["b"]


def test_steady_key_is_split(spark):
    one = spark.range(200_000).select(F.lit("u").alias("k"), F.timestamp_millis(F.col("id") * 150).alias("ts"))
    assert debounced(one, "k", "ts", 200, 60).count() == 100_000


def test_converted(spark):
    trees = [json.dumps({"blocks": [{"t": "Header", "c": [1, ["", [], []], [{"t": "Str", "c": "H"}]]}, {"t": "Para", "c": [{"t": "Str", "c": "A b. C d."}]}]}), None]
    df = spark.createDataFrame([(t, 1) for t in trees], "tree string, regions int")
    assert [r.formatted for r in converter.format_converted_df(df).collect()] == ["H\nA b.\nC d.\n", None]


def test_checkpoints_need_a_shared_folder():
    from lectern import runtime

    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Frame:
        class sparkSession:  # noqa: N801
            sparkContext = Context()

            class conf:  # noqa: N801
                @staticmethod
                def get(name, default):
                    return default

    import pytest

    with pytest.raises(RuntimeError):
        runtime.checkpointed(Frame())


def test_core_needs_no_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "lectern"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lectern.llm" not in p.read_text(), p
