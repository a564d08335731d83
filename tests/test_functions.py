import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leafspark import catalog
from leafspark.functions import formulas, numbers
from leafspark.functions import text as T
from leafspark.operators import changes, lines, prompt
from leafspark.streaming import watch


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [
    ("a\r\nb\rc\u2028d\x85e", "a\nb\nc\nd\ne"), ("\x1b[31mred\x1b[0m \x1b]0;title\x07x", "red x"), ("a\x00b\x07c\td", "abc\td"), ("in\u200bvis\u00adible\ufeff", "invisible"), ("\U000e0041tag\ufe0f\ufe01", "tag\ufe0f"), ("a\u202eb", "ab"),
])
def test_strip_controls(spark, text, want):
    assert one(spark, text, T.strip_controls) == want


def test_lines_and_widths(spark):
    assert one(spark, "a\nb\x07c", T.sanitize_line) == "a b c"
    assert one(spark, "x" * 300, T.sanitize_line) == "x" * 199 + "…"
    assert one(spark, "日本e\u0301😀", T.str_width) == 7
    assert one(spark, "日本語", lambda c: T.cut_to(c, 5)) == "日本…"
    assert one(spark, "ab", lambda c: T.pad_right(c, 4)) == "ab  "
    assert one(spark, "hello world", lambda c: T.fit_start(c, 5)) == "hello"


def test_fences(spark):
    assert one(spark, "see @notes.md and a@b.c", T.fence_safe) == "see ＠notes.md and a@b.c"
    assert one(spark, "</ file excerpt-1>", T.fence_safe) == "‹/ file excerpt-1>"
    assert one(spark, '<h1> (under "' + "h" * 70 + '")', T.place_safe) == '<h1> (under "' + "h" * 60 + '…")'


@pytest.mark.parametrize(("path", "want"), [
    ("C:\\Users\\rocks\\proj\\..\\docs\\.\\plan.md", "C:/Users/rocks/docs/plan.md"), ("c:/Users/rocks/", "C:/Users/rocks"), ("C:\\", "C:/"), ("\\\\host\\share\\plan.md", "//host/share/plan.md"), ("/a/./b/../c", "/a/c"), ("a/../../b", "../b"), ("/..", "/"),
])
def test_paths(spark, path, want):
    assert one(spark, path, T.normalize_path) == want


@pytest.mark.parametrize(("x", "fmt", "want"), [
    (1234567.5, "#,##0.00", "1,234,567.50"), (1.005, "0.00", "1.01"), (-1234.0, "#,##0_);(#,##0)", "(1,234)"), (-5.0, "0", "-5"), (0.256, "0.0%", "25.6%"), (1200.0, '"$"#,##0', "$1,200"), (1234.0, "General", "1,234"), (0.5, "General", "0.5"),
    (1234.56789, "General", "1,234.56789"), (0.00001234, "General", "1.234e-05"), (1e15, "General", "1E+15"), (46023.0, "yyyy-mm-dd", "2026-01-01"), (46023.395833333336, "m/d/yy h:mm", "2026-01-01 09:30"), (0.5, "h:mm", "12:00"),
    (1.5, "[h]:mm", "36:00"), (-1.0, "yyyy", "#####"), (59.0, "yyyy-mm-dd", "1900-02-28"), (61.0, "yyyy-mm-dd", "1900-03-01"), (1.0, "yyyy-mm-dd", "1900-01-01"), (float("inf"), "0", "#NUM!"),
])
def test_cell_text(spark, x, fmt, want):
    assert one(spark, x, lambda c: numbers.cell_text(c, F.lit(fmt)), "double") == want


def test_dates_of_1904_and_names(spark):
    assert one(spark, 0.0, lambda c: numbers.date_text(c + 1, F.lit("yyyy-mm-dd"), True), "double") == "1904-01-02"
    assert [one(spark, n, numbers.col_letters, "int") for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert [one(spark, s, numbers.col_index) for s in ("A", "zz", "XFD")] == [1, 702, 16384]
    assert [one(spark, s, numbers.quote_sheet) for s in ("Budget", "Bob's Q1", "Q1", "Q1!Data", "TRUE")] == ["Budget", "'Bob''s Q1'", "'Q1'", "'Q1!Data'", "'TRUE'"]
    assert [one(spark, x, numbers.format_number, "double") for x in (1234.0, -1234.5, 0.127)] == ["1,234", "-1,234.5", "0.13"]


@pytest.mark.parametrize(("criterion", "want"), [(0, [True, False, False]), (">=0", [True, True, True]), ("<>abc", [True, True, False]), (">90", [False, False, True]), ("<5", [True, True, False])])
def test_criteria(spark, criterion, want):
    frame = spark.createDataFrame([(1, None, None), (2, 3.0, None), (3, None, "abc")], "k int, x double, v string")
    got = frame.orderBy("k").select(formulas.matches(criterion, F.col("x"), F.col("v")).alias("m")).collect()
    assert [r.m for r in got] == want


def test_row_changes_and_relocation(spark):
    def rows(texts):
        return spark.createDataFrame([(1, i, t, t, "p") for i, t in enumerate(texts)], "d int, src int, text string, quote string, style string")

    assert [r.src for r in changes.row_changes(rows(["a", "b", "a"]), rows(["a", "a", "a", "", "c"]), "d").orderBy("src").collect()] == [2, 4]
    comments = spark.createDataFrame([(1, 1, "three", 2, 2), (1, 2, "beta", 1, 1), (1, 3, "one\ntwo", 0, 1), (1, 4, "gone\ntwo", 0, 1)], "d int, id int, quote string, `from` int, `to` int")
    got = {r.id: (r["from"], r["to"], r.is_stale) for r in changes.reanchor_rows(rows(["zero", "half", "one", "two", "three"]), comments, "d").collect()}
    assert got == {1: (4, 4, False), 2: (1, 1, True), 3: (2, 3, False), 4: (2, 3, True)}


def test_shifts_match_brute_force(spark):
    """Gaps, null values and keys, values with line ends, repeats, ranges over several blocks and backwards, places left of row 0; nothing is broadcast."""
    pick = random.Random(5)
    values = [(k, r, pick.choice(["a", "b", "a\nb", None])) for k in range(30) for r in range(pick.choice([3, 60, 400])) if pick.random() < 0.97]
    values += [(30, r, f"v{r}") for r in range(600)] + [(None, r, "a") for r in range(9)]
    held = {(k, r): v for k, r, v in values}

    def now(k, a, b):
        got = [held[k, r] for r in range(a, b + 1) if (k, r) in held]
        return "\n".join(v for v in got if v is not None) if len(got) == b - a + 1 and got else None

    comments = [(30, 1, 100, 420, now(30, 130, 450)), (30, 2, 100, 420, now(30, 151, 471)), (30, 3, 0, 1, now(30, 50, 51)), (30, 4, 0, 1, now(30, 51, 52)), (30, 5, -2, -1, now(30, 0, 1)), (30, 6, 9, 8, "v9"), (30, 7, 5, 6, None), (30, 8, 5, None, "v5"), (None, 9, 3, 4, "a\na"), (99, 10, 0, 1, "a\nb")]
    for i in range(400):
        k, a, n = pick.randrange(30), pick.randrange(300), pick.choice([1, 2, 5, 9])
        comments.append((k, 100 + i, max(0, a + pick.randint(-60, 60)), 0, now(k, a, a + n - 1)))
        comments[-1] = (*comments[-1][:3], comments[-1][2] + n - 1, comments[-1][4])

    def shift(k, a, b, was):
        fits = [s for s in range(-50, 51) if None not in (k, b, was) and a + s >= 0 and now(k, a + s, b + s) == was]
        return fits[0] if len(fits) == 1 and 0 not in fits else 0

    want = {i: shift(k, a, b, was) for k, i, a, b, was in comments}
    assert (want[1], want[2], want[3], want[4], want[5], want[9]) == (30, 0, 50, 0, 2, 0) and len(set(want.values())) > 30
    frame = spark.createDataFrame(comments, "k int, id int, `from` int, `to` int, was string")
    got = changes.reanchor_shift(spark.createDataFrame(values, "k int, r int, value string"), frame, "k")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r["shift"] for r in got.collect()} == want and got.count() == len(comments)


def test_shifts_of_orders_broadcast_nothing(spark):
    """A table that explode made longer was broadcast by its size before, which took the driver's memory."""
    plan = catalog.queries()["reanchor_grid_shift"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_labels(spark):
    frame = spark.createDataFrame([("line 3", "line 7"), ('lines 3–4 (under "H")', 'lines 6–9 (under "X")'), ("paragraph 2", "paragraph 5"), ("<p> at line 1", "<p> at line 2"), ("line 3", "line 3")], "a string, b string")
    got = [r.y for r in frame.select(lines.merged_label(F.col("a"), F.col("b")).alias("y")).collect()]
    assert got == ["lines 3–7", 'lines 3–9 (under "H")', "paragraphs 2–5", "<p> at line 1 to <p> at line 2", "line 3"]
    quote = one(spark, "C3: 4,800  (formula =A1)\nnot one\nD3: x", changes.quoted_values)
    assert quote == ["4,800", "x"]


def test_prompts(spark):
    comments = spark.createDataFrame([("k", 2, "/w/b.md", "line 1", "q1\nq2", "do\nit", True), ("k", 1, "/w/a.md", "line 9", "", "first", False)], "k string, id int, path string, label string, quote string, text string, is_stale boolean")
    text = prompt.feedback_prompts(comments, ["k"], "file-excerpt-1", "/w").first().prompt
    assert "1. <file-excerpt-1> a.md: line 9\n   </file-excerpt-1>\n   Feedback: first\n2. <file-excerpt-1> b.md: line 1 (changed since the comment was written)\n   > q1\n   > q2\n" in text
    assert text.endswith("Feedback: do\n   it")


EVENTS = [("a", 1, "save", "x", None), ("a", 2, "queue", None, None), ("a", 3, "send", None, 7), ("a", 4, "done", None, 8), ("b", 1, "save", "y", None), ("b", 2, "save", "", None), ("c", 1, "save", "z", None), ("c", 2, "send", None, 7), ("c", 3, "done", None, 7), ("d", 1, "save", "w", None), ("d", 2, "queue", None, None), ("d", 3, "unqueue", None, None)]


def test_comment_states(spark):
    events = spark.createDataFrame(EVENTS, "place string, seq int, event string, text string, batch long")
    want = {"a": ("sent", "x", 7), "b": (None, None, None), "c": (None, None, None), "d": ("draft", "w", None)}
    assert {r.place: (r.status, r.text, r.batch) for r in watch.fold_comments(events).collect()} == want
    for place, expected in want.items():
        state = None
        for p, _, event, text, batch in EVENTS:
            state = watch.step(state, event, text, batch) if p == place else state
        assert (state or (None, None, None)) == expected


def test_streams(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, "place string, seq int, event string, text string, batch long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = watch.comment_states(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {r.place: r.status for r in spark.table("states").collect()}
    assert got == {"a": "sent", "b": None, "c": None, "d": "draft"}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("one\ntwo")
    seen = []
    watch.watch(spark, str(tmp_path / "docs"), str(tmp_path / "c2"), lambda df, n: seen.extend(r.content for r in df.collect()), once=True).awaitTermination(120)
    assert seen == ["one\ntwo"]


def test_versions_keep_the_last_good_read(spark):
    t = [datetime(2026, 1, d) for d in (1, 2, 3)]
    frame = spark.createDataFrame([("p", 1, t[0], "a", None), ("p", 2, t[0], "a", None), ("p", 3, t[1], None, "broken"), ("p", 4, t[0], "b", None)], "path string, seq int, mtime timestamp, content string, problem string")
    got = [(r.seq, r.version, r.shown) for r in watch.versions(frame).orderBy("seq").collect()]
    assert got == [(1, 1, "a"), (3, 2, "a"), (4, 3, "b")]


def test_file_scan(spark, tmp_path):
    from leafspark.sources import files
    from tests import office

    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.md").write_text("# T\n\ntext")
    (tmp_path / "sub" / "b.pdf").write_bytes(office.pdf([["hello"]]))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.xlsx").write_bytes(office.workbook({"S": '<row r="1"><c><v>2</v></c><c><f>A1*3</f></c></row>'}))
    (tmp_path / "e.exe").write_text("no")
    (tmp_path / "node_modules" / "x.md").write_text("no")
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.path.rpartition("/")[2] for r in found.select("path").collect()) == ["a.md", "b.pdf", "c.docx", "d.xlsx"]
    rows = files.rows(found).collect()
    assert {(r.path.rpartition("/")[2], r.style, r.text) for r in rows if r.style in ("h1", "p")} == {("a.md", "h1", "T"), ("a.md", "p", "text"), ("b.pdf", "p", "hello")}
    assert [r.path.rpartition("/")[2] for r in rows if r.style == "error"] == ["c.docx"]
    assert sorted((r.c, r.x, r.shown) for r in files.cells(found).collect()) == [(0, 2.0, "2"), (1, 6.0, "6")]
    assert files.plain_lines(found).count() == 3


def test_nearest_rows_choose_by_distance_then_place(spark):
    rows = spark.createDataFrame([(1, i, q, "p") for i, q in enumerate("abaab")] + [(1, 9, "a", "space")], "d int, src int, quote string, style string")
    wanted = spark.createDataFrame([(1, 1, "a", 1, 0), (1, 2, "a", 0, 1), (1, 3, "b", 9, 0), (1, 4, "b", 0, 5), (1, 5, "a", 2, 3), (1, 6, "z", 0, 0)], "d int, id int, quote string, near int, floor int")
    assert {r.id: r.src for r in changes.nearest_rows(rows, wanted, "d").collect()} == {1: 0, 2: 2, 3: 4, 5: 3}


@pytest.mark.parametrize(("folder", "want"), [("/", True), ("", True), ("C:/", True), ("C:", True), ("//host/share", True), ("//host/share/x", False), ("/home", True), ("/Users/ann/", True), ("/home/ann/work", False), ("/mnt/c/Users/ann", True), ("/mnt/c/work", False), ("/var/home", True), ("/root", True), ("/root/x", False), ("/var/root", True), ("D:/Users", True), ("D:/root", False), ("/srv", False)])
def test_too_broad_folders(spark, folder, want):
    from leafspark.functions import paths

    assert one(spark, folder, paths.is_too_broad) is want


def test_typed_paths(spark):
    from leafspark.functions import paths

    typed = lambda text, folder: one(spark, text, lambda c: paths.typed_path(c, F.lit(folder)))
    assert typed("'~/a b.md'", "/home/ann/work") == "/home/ann/a b.md" and typed("~", "/root/x") == "/root" and typed("~x/y", "/home/ann/w") == "/home/ann/w/~x/y"
    assert typed('"', "/w") == '/w/"' and typed("../x", "C:/Users/bo/p") == "C:/Users/bo/x" and typed("~\\d.md", "C:/Users/bo/p") == "C:/Users/bo/d.md"
    assert one(spark, "a\\ b\\(1\\).md", paths.unescaped) == "a b(1).md" and one(spark, "a\\\\\\ b", paths.unescaped) == "a\\ b"
    assert one(spark, "C:\\my docs", paths.unescaped) is None and one(spark, "plain", paths.unescaped) is None


@pytest.mark.parametrize(("x", "want"), [(12345678.5, "12345678.5"), (0.00001, "0.00001"), (1e-7, "1e-7"), (-2.5e-9, "-2.5e-9"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (123456789012345680.0, "123456789012345680"), (0.1, "0.1"), (-0.0, "0"), (5.0, "5"), (100.0, "100")])
def test_numbers_joined_to_text(spark, x, want):
    assert one(spark, x, numbers.js_number_text, "double") == want


def test_rows_of_every_kind_and_what_is_left_out(spark, tmp_path):
    from leafspark.sources import files

    (tmp_path / "a.json").write_text('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"page"}]}]}')
    (tmp_path / "b.json").write_text('{"x": 1}')
    (tmp_path / "c.yaml").write_text("k: v\n" * 30)
    (tmp_path / "d.txt").write_text("x" * 20_001)
    found = files.scan(spark, str(tmp_path))
    rows = files.document_rows(found, most=20).collect()
    name = lambda p: p.rpartition("/")[2]
    assert {(name(r.path), r.style, r.text) for r in rows if r.src == 0 and r.path[-1] != "t"} == {("a.json", "p", "page"), ("b.json", None, '{"x": 1}'), ("c.yaml", None, "k: v")}
    assert sum(name(r.path) == "c.yaml" for r in rows) == 20
    assert {name(r.path): r.note for r in files.notes(found, most=20).collect()} == {"c.yaml": "Only the first 20 of 30 rows are shown.", "d.txt": "Lines over 20,000 characters are cut short."}
