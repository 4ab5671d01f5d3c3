"""Operators on small hand-made tables with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scalars
from gaugeworks.operators import agent_eval, classify, clones, documentation, evidence, graph, semantics, summary, temporal
from gaugeworks.parse.python_facts import complexity, facts_of, python_facts
from gaugeworks.report import render
from gaugeworks.sources import coverage, files
from gaugeworks.sources.history import parse_history


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "expr", "want"),
    [
        ("", scalars.line_count, 0),
        ("a\nb\n", scalars.line_count, 3),
        ("", scalars.line_count_open, 1),
        ("  ", scalars.word_count, 0),
        ("the quick brown fox jumps over the lazy dog", scalars.word_count, 9),
        ("a b　c\u0085d", scalars.word_count, 4),
        ("äöü", scalars.token_estimate, 1),
        ("src/{old => new}/f.go", scalars.rename_target, "src/new/f.go"),
        ("src/{ => new}/f.go", scalars.rename_target, "src/new/f.go"),
        ("src/{old => }/f.go", scalars.rename_target, "src/f.go"),
        ("a.go => b.go", scalars.rename_target, "b.go"),
        ("plain.go", scalars.rename_target, "plain.go"),
        ("NewHTTPServer", scalars.identifier_words, 6),
        ("CamelCase", scalars.identifier_words, 2),
        ("snake_case", scalars.identifier_words, 2),
        ("'x'", scalars.strip_quotes, "x"),
        ("@a/b/c", scalars.top_module, "@a/b"),
        ("lodash/fp", scalars.top_module, "lodash"),
        ("a-b c_d", scalars.badge_text, "a--b%20c__d"),
        ("```\nx\n```", scalars.fence_count, 2),
    ],
)
def test_scalars(spark, value, expr, want):
    assert one(spark, value, expr) == want


def test_upper_median(spark):
    assert one(spark, [1.0, 2.0, 3.0, 4.0], scalars.upper_median, "array<double>") == 3.0
    assert one(spark, [], scalars.upper_median, "array<double>") is None


def test_file_classes(spark):
    rows = [("main.go", ""), ("main_test.go", ""), ("gen.go", "// Code generated by x. DO NOT EDIT.\npackage a\n"), ("vendor/a/b.go", ""), ("skip.go", ""), ("_x.go", ""), ("a.py", ""), ("test_a.py", ""), ("__init__.py", ""), ("a.spec.TS", ""), ("a.spec.ts", ""), ("notes.txt", "")]
    got = {r["rel_path"]: (r["class"], r["exclude_reason"]) for r in classify.classify(spark.createDataFrame([("r", *x) for x in rows], "repo_id string, rel_path string, content string"), classify.ignored_by(F.col("rel_path"), ["skip.*", "# no"])).collect()}
    assert got == {"main.go": ("source", None), "main_test.go": ("test", None), "gen.go": ("generated", "generated"), "vendor/a/b.go": ("excluded", "vendor"), "skip.go": ("excluded", "gitignore"), "_x.go": ("excluded", None), "a.py": ("source", None), "test_a.py": ("test", None), "__init__.py": ("excluded", None), "a.spec.ts": ("test", None)}


@pytest.mark.parametrize(
    ("lines", "path", "want"),
    [
        (["*.log"], "a/b.log", True), (["/a.log"], "b/a.log", False), (["build/"], "x/build/y", True), (["build/"], "build", False),
        (["a/**/z"], "a/b/c/z", True), (["*.go", "!keep.go"], "x/keep.go", False), (["doc/*.txt"], "doc/a/b.txt", False), (["[ab].c"], "a.c", True), (["?.c"], "ab.c", False),
    ],
)
def test_ignore_lines(spark, lines, path, want):
    assert one(spark, path, lambda c: classify.ignored_by(c, lines)) is want


STATEMENTS = "repo_id string, file string, block string, pos int, hash string, start int, end int"


def plain_duplicated(rows, least=3, lines=6):
    """(file, line) of all windows of any length that occur apart, by comparing every pair."""
    blocks = {}
    for _, f, b, p, h, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        blocks.setdefault((f, b), []).append((h, s, e))
    windows = {}
    for (f, _), ss in blocks.items():
        for i in range(len(ss)):
            for j in range(i + least, len(ss) + 1):
                if ss[j - 1][2] - ss[i][1] + 1 >= lines:
                    windows.setdefault(tuple(h for h, _, _ in ss[i:j]), []).append((f, ss[i][1], ss[j - 1][2]))
    out = set()
    for group in windows.values():
        for a in group:
            if any(a != b and not (a[0] == b[0] and a[1] < b[2] and b[1] < a[2]) for b in group):
                out |= {(a[0], k) for k in range(a[1], a[2] + 1)}
    return out


def duplicated(spark, rows, **more):
    windows = clones.deciding_windows(spark.createDataFrame(rows, STATEMENTS), **more)
    spans = clones.duplicated_windows(windows).collect()
    return {(r["file"], k) for r in spans for k in range(r["start"], r["end"] + 1)}


def test_clones(spark):
    body = ["a", "b", "c", "d"]
    rows = [("r", f, f"{f}{k}", i, h, start + 2 * i, start + 2 * i + 1) for f, k, start in (("x", 0, 1), ("x", 1, 20), ("y", 0, 5)) for i, h in enumerate(body)]
    rows += [("r", "z", "z0", i, h, 2 * i + 1, 2 * i + 2) for i, h in enumerate("efgh")]
    windows = clones.deciding_windows(spark.createDataFrame(rows, STATEMENTS))
    totals = spark.createDataFrame([("r", 96)], "repo_id string, lines int")
    got = clones.duplication_rate(windows, totals).first()
    assert got["duplicated_lines"] == 24 and got["duplication_rate"] == 25.0
    got = {(p["file"], p["start"], p["end"], p["partner_file"], p["partner_start"]) for p in clones.partners(windows).collect()}
    assert {("x", 1, 6, "x", 20), ("x", 20, 25, "x", 1), ("y", 5, 10, "x", 1)} <= got and len(got) == 6
    classes = {(c["copies"], c["files"], c["first_file"], c["first_start"]) for c in clones.clone_classes(windows).collect()}
    assert classes == {(3, 2, "x", 1), (3, 2, "x", 3)}


@pytest.mark.parametrize("seed", range(6))
def test_duplicated_lines_at_any_length(spark, seed):
    """Statements of no or several lines, many on one line, gaps between them, copies laid out otherwise, nested blocks."""
    import random

    rng = random.Random(seed)
    passage = [rng.choice("abcdefgh") for _ in range(rng.choice((6, 14, 40)))]
    rows = []
    for f in range(8):
        for b in range(rng.randint(1, 3)):
            names = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
            at = rng.randint(0, len(names))
            cut = rng.randint(0, 4)
            names[at:at] = passage[cut : len(passage) - rng.randint(0, 4)] * rng.choice((0, 1, 1, 2))
            line = rng.randint(1, 9)
            for p, h in enumerate(names):
                end = line + rng.choice((0, 0, 0, 1, 2) if f % 2 else (0, 0, 0, 0, 0, 1))
                rows.append(("r", f"f{f}", f"b{b}", p, h, line, end))
                line = end + rng.choice((0, 0, 1, 1, 3))
    assert duplicated(spark, rows) == plain_duplicated(rows)


def test_a_window_of_very_many_statements(spark):
    """Two hundred statements on six lines: in no shorter window do both copies span enough lines."""
    rows = [("r", f, "b", p, f"s{p}", p // 40 + 1 if f == "x" else p + 1, p // 40 + 1 if f == "x" else p + 1) for f in "xy" for p in range(205)]
    assert duplicated(spark, rows) == plain_duplicated(rows) == {("x", k) for k in range(1, 7)} | {("y", k) for k in range(1, 206)}


def test_sentences_are_dealt_by_the_length_of_texts(spark, monkeypatch):
    """Partitions follow the texts, hold whole files, and change no row."""
    from comparing import SF

    from gaugeworks.plans import texts

    want = sorted(map(tuple, texts.statement_duplication(spark, SF).collect()))
    dealt = texts._sentences(spark, SF, 7)
    assert dealt.rdd.getNumPartitions() == 7
    assert dealt.withColumn("part", F.spark_partition_id()).groupBy("repo_id", "file").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
    monkeypatch.setattr(texts, "CHARS_A_TASK", 20_000)
    assert sorted(map(tuple, texts.statement_duplication(spark, SF).collect())) == want


def test_overlapping_windows_are_no_clones(spark):
    rows = [("r", "x", "b", i, "s", i + 1, i + 1) for i in range(4)]
    assert duplicated(spark, rows, lines=3) == set()
    assert duplicated(spark, rows[:0]) == set()


def test_partners_of_many_copies(spark):
    """Half of all windows are one passage: rows are as many as copies, and none overlaps its partner."""
    texts = spark.createDataFrame([("r", f, "\n".join(["same"] * (9 if f % 3 else 4) + [f"own{f}"])) for f in range(60)] + [("q", 1, "\n".join(["one"] * 5))], "repo_id string, file long, text string")
    got = clones.partners(clones.line_windows(texts, 3)).collect()
    found = clones.duplicated_windows(clones.line_windows(texts, 3)).count()
    assert len(got) == found == 40 * 7 + 20 * 2 + 2
    for p in got:
        assert p["file"] != p["partner_file"] or p["start"] >= p["partner_end"] or p["partner_start"] >= p["end"]
    first = {(p["start"], p["partner_file"], p["partner_start"]) for p in got if p["repo_id"] == "r" and p["file"] == 0}
    assert first == {(1, 1, 1), (2, 1, 1)}
    assert {(p["start"], p["partner_start"]) for p in got if p["repo_id"] == "q"} == {(1, 3), (3, 1)}


def test_longest_windows_equal_all_pairs(spark):
    import random

    rng = random.Random(2)
    texts = [("r", f, [rng.choice("ab") for _ in range(rng.randint(1, 14))]) for f in range(6)] + [("q", 9, ["s"] * 9), ("p", 10, list("abcdefg")), ("p", 11, list("xabcdefy"))]
    want = {}
    for repo in "rqp":
        pairs = []
        own = [(f, t) for r, f, t in texts if r == repo]
        for k in range(3, 15):
            places = {}
            for f, t in own:
                for i in range(len(t) - k + 1):
                    places.setdefault(tuple(t[i : i + k]), []).append((f, i + 1))
            pairs += [(-k, *a, *b) for p in places.values() for a in p for b in p if a < b and (a[0] != b[0] or b[1] >= a[1] + k - 1)]
        want[repo] = sorted(pairs)[:5]
    frame = spark.createDataFrame([(r, f, "\n".join(t)) for r, f, t in texts], "repo_id string, file long, text string")
    got = {}
    for c in clones.longest_windows(frame).orderBy("repo_id", "rank").collect():
        got.setdefault(c["repo_id"], []).append((-c["line_count"], c["file_a"], c["start_a"], c["file_b"], c["start_b"]))
    assert got == want


def test_line_clones_are_whole(spark):
    long, run = [f"l{i}" for i in range(40)], ["same"] * 9
    files = [("r", 1, ["a", *long, "b"]), ("r", 2, ["l3", "l4", "l5"]), ("r", 3, ["c", "d", *long, "e"]), ("q", 4, ["x", *run, "y"])]
    files += [("s", i, ["u", "v", "w", "z"]) for i in range(20)] + [("t", 30, ["one"]), ("t", 31, None)]
    texts = spark.createDataFrame([(r, f, "\n".join(t) if t else None) for r, f, t in files], "repo_id string, file long, text string")
    got = {}
    for c in clones.line_clones(texts).orderBy("repo_id", "rank").collect():
        got.setdefault(c["repo_id"], []).append((c["file_a"], c["start_a"], c["end_a"], c["file_b"], c["start_b"], c["end_b"], c["line_count"]))
    assert got["r"] == [(1, 2, 41, 3, 3, 42, 40), (1, 5, 7, 2, 1, 3, 3), (2, 1, 3, 3, 6, 8, 3)]
    assert got["q"] == [(4, 2, 6, 4, 6, 10, 5), (4, 2, 5, 4, 5, 8, 4), (4, 2, 5, 4, 7, 10, 4), (4, 2, 4, 4, 4, 6, 3), (4, 2, 4, 4, 8, 10, 3)]
    assert got["s"] == [(0, 1, 4, i, 1, 4, 4) for i in range(1, 6)] and "t" not in got


def plain_line_clones(texts, top, least=3):
    """All maximal clones by walking every diagonal of every two files."""
    want = {}
    for repo in {r for r, _, _ in texts}:
        own = [(f, t) for r, f, t in texts if r == repo]
        found = []
        for f, t in own:
            for g, u in own:
                for shift in range(-len(t) + 1 if f < g else 1, len(u)) if f <= g else ():
                    n = 0
                    for i in range(len(t) + 1):
                        if i < len(t) and 0 <= i + shift < len(u) and t[i] == u[i + shift]:
                            n += 1
                            continue
                        length = n if f != g else min(n, shift + 1)
                        if length >= least:
                            found.append((-length, f, i - n + 1, g, i - n + 1 + shift))
                        n = 0
        if found:
            want[repo] = sorted(found)[:top]
    return want


@pytest.mark.parametrize("top", [2, 5])
def test_clones_of_crowds_equal_a_plain_walk(spark, top):
    """A passage in most files, of other lengths in a few; runs of one line; a crowd at a length no doubling meets."""
    import random

    rng = random.Random(top)
    passage = [f"p{k}" for k in range(11)]
    texts = [("r", f, [f"x{f}", *passage[: 11 if f % 9 else 8], f"y{f % 13}"]) for f in range(40)]
    texts += [("q", f, ["s"] * rng.randint(5, 9) + [f"z{f % 3}"]) for f in range(14)]
    texts += [("p", f, [rng.choice("ab") for _ in range(rng.randint(1, 12))]) for f in range(25)]
    texts += [("o", f, [f"u{f % 4}", *passage[:5], f"v{f % 5}"]) for f in range(18)] + [("o", 50, ["w"] * 21)]
    texts += [("n", f, [*passage, "m", "n", f"o{f}"][: 8 + f]) for f in range(9)]
    frame = spark.createDataFrame([(r, f, "\n".join(t)) for r, f, t in texts], "repo_id string, file long, text string")
    got = {}
    for c in clones.line_clones(frame, top).orderBy("repo_id", "rank").collect():
        got.setdefault(c["repo_id"], []).append((-c["line_count"], c["file_a"], c["start_a"], c["file_b"], c["start_b"]))
    assert got == plain_line_clones(texts, top)


def test_pairs_grow_with_copies(spark):
    """A passage in 300 differing files gives a fixed number of pairs, not the square of the files."""
    texts = spark.createDataFrame([("r", f, f"a{f}\none\ntwo\nthree\nb{f}") for f in range(300)] + [("r", None, "one\ntwo\nthree")], "repo_id string, file long, text string")
    found = clones._duplicated(clones.line_windows(texts, 3, around=True), "before", "after")
    assert found.count() == 300 and clones._pairs(found.withColumn("size", F.lit(3)), 5).count() == 10
    assert [(c["file_a"], c["file_b"]) for c in clones.line_clones(texts).orderBy("rank").collect()] == [(0, k) for k in range(1, 6)]


@pytest.mark.parametrize("lines_a_window", [1, 16, 1 << 20])
def test_long_windows_first_equal_a_plain_walk(spark, monkeypatch, lines_a_window):
    """Long clones in crowds, in few files, of one file with itself, and none; with all, some and no sizes tried first."""
    import random

    monkeypatch.setattr(clones, "LINES_A_LONG_WINDOW", lines_a_window, raising=False)
    rng = random.Random(lines_a_window)
    passage = [f"p{k}" for k in range(60)]
    texts = [("c", f, [f"x{f}", *passage[rng.randint(0, 3) : rng.randint(50, 60)], f"y{f % 5}"]) for f in range(14)]
    texts += [("b", f, [f"u{f}", f"v{f}", f"w{f % 9}"]) for f in range(40)] + [("b", f, [*passage[:50], f"z{f}", "a", "b", "c"]) for f in (50, 51)]
    texts += [("a", f, [rng.choice("ab") for _ in range(rng.randint(1, 30))]) for f in range(10)]
    texts += [("d", 1, ["same"] * 61), ("e", 1, ["once"]), ("e", 2, passage)]
    frame = spark.createDataFrame([(r, f, "\n".join(t)) for r, f, t in texts], "repo_id string, file long, text string")
    got = {}
    for c in clones.line_clones(frame, 3).orderBy("repo_id", "rank").collect():
        got.setdefault(c["repo_id"], []).append((-c["line_count"], c["file_a"], c["start_a"], c["file_b"], c["start_b"]))
    assert got == plain_line_clones(texts, 3)


def test_long_clones_take_few_steps(spark, monkeypatch):
    """Where the longest clones are long, the windows of three lines of all texts are not made, and few steps find the length."""
    made, keep = [], clones.kept
    monkeypatch.setattr(clones, "kept", lambda *a: made.append(1) or keep(*a))
    passage = [f"p{k}" for k in range(90)]
    texts = [("r", f, [f"x{f}", *passage, f"y{f}"]) for f in range(12)] + [("r", f, [f"u{f}", "v", "w", "x"] * 2) for f in range(100, 160)] + [("r", f, [f"z{f}"] * 6) for f in range(200, 3000)]
    frame = spark.createDataFrame([(r, f, "\n".join(t)) for r, f, t in texts], "repo_id string, file long, text string")
    best = clones.line_clones(frame).orderBy("rank").collect()
    assert [(c["file_a"], c["start_a"], c["file_b"], c["start_b"], c["line_count"]) for c in best] == [(0, 2, f, 2, 90) for f in range(1, 6)]
    assert len(made) <= 20


def test_copies_without_a_file_take_no_place(spark):
    texts = spark.createDataFrame([("r", f, "one\ntwo\nthree") for f in [None] * 9 + [1, 2]], "repo_id string, file long, text string")
    assert [(c["file_a"], c["file_b"], c["line_count"]) for c in clones.line_clones(texts).collect()] == [(1, 2, 3)]


def test_copies_beyond_an_overlapping_neighbour_are_paired(spark):
    texts = spark.createDataFrame([("r", 1, "\n".join(["same"] * 6)), ("q", 1, "a\nb\nc"), ("q", 2, "a\nb\nc"), ("q", 3, "a\nb\nc")], "repo_id string, file long, text string")
    got = {(c["repo_id"], c["file_a"], c["start_a"], c["file_b"], c["start_b"], c["line_count"]) for c in clones.line_clones(texts).collect()}
    assert got == {("r", 1, 1, 1, 3, 3), ("r", 1, 1, 1, 4, 3), ("q", 1, 1, 2, 1, 3), ("q", 1, 1, 3, 1, 3), ("q", 2, 1, 3, 1, 3)}


def test_graph(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d"), ("q", "x", "y")], "repo_id string, src string, dst string")
    assert [r["cycle"] for r in graph.cycles(edges).collect()] == [["a", "b", "c", "a"]]
    got = {(r["repo_id"], r["node"]): (r["efferent"], r["afferent"]) for r in graph.degrees(edges).collect()}
    assert got["r", "c"] == (2, 1) and got["r", "d"] == (0, 1)
    fan = {r["repo_id"]: r for r in graph.fan_out(graph.degrees(edges)).collect()}
    assert fan["q"]["fanout_avg"] == 0.5 and fan["r"]["fanout_max_node"] == "c"
    exports = spark.createDataFrame([("r", "p", "Used"), ("r", "p", "Unused"), ("q", "p", "Lone")], "repo_id string, unit string, name string")
    used = spark.createDataFrame([("r", "p", "Used")], "repo_id string, unit string, name string")
    units = spark.createDataFrame([("r", "p"), ("r", "main"), ("q", "p")], "repo_id string, unit string")
    assert [r["name"] for r in graph.dead_exports(exports, used, units).collect()] == ["Unused"]
    imports = spark.createDataFrame([("r", "a", "b"), ("r", "a", "a"), ("r", "a", "zz"), ("r", "a", "b")], "repo_id string, src string, target string")
    modules = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_id string, module string")
    assert [tuple(r) for r in graph.resolve_imports(imports, modules).collect()] == [("r", "a", "b")]


def plain_components(edges):
    """(repo, node) -> smallest node of its cycle component, by walking from every node."""
    after = {}
    for r, s, d in edges:
        after.setdefault((r, s), set()).add((r, d))

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {x: reach(x) for x in after}
    out = {}
    for x, seen in far.items():
        mutual = {y for y in seen if x in far.get(y, ()) and y != x}
        if mutual:
            out[x] = min(y[1] for y in mutual | {x})
    return out


def plain_cycles(edges):
    """The first of the shortest cycles through each edge, breadth first from its end."""
    out = set()
    for r, u, v in edges:
        paths = {v: (v,)}
        while u not in paths:
            step = {}
            for n, p in paths.items():
                for q, s, d in edges:
                    if q == r and s == n and d not in paths:
                        step[d] = min(step.get(d, (*p, d)), (*p, d))
            if not step:
                break
            paths |= step
        if u in paths:
            p = paths[u]
            k = p.index(min(p))
            out.add((r, (*p[k:], *p[: k + 1])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_and_cycles_equal_plain_walks(spark, seed):
    import random

    rng = random.Random(seed)
    edges = {(r, f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for r in "ab" for _ in range((10, 20, 30)[seed])}
    edges |= {("ring", f"m{k:02}", f"m{(k + 1) % 9:02}") for k in range(9)} | {("two", "a", "b"), ("two", "b", "a"), ("two", "b", "c"), ("two", "c", "d"), ("two", "d", "c"), ("two", "x", "x")}
    frame = spark.createDataFrame(sorted(edges), "repo_id string, src string, dst string")
    proper = {e for e in edges if e[1] != e[2]}
    assert {(r["repo_id"], r["node"]): r["component"] for r in graph.cyclic_components(frame).collect()} == plain_components(proper)
    assert {(r["repo_id"], tuple(r["cycle"])) for r in graph.cycles(frame).collect()} == plain_cycles(proper)


@pytest.mark.parametrize("small", (62, 25))
def test_small_and_large_graphs_give_the_same(spark, monkeypatch, small):
    """Graphs above and below the bound in one table; those of 62 edges fill the bits, 70 go on by steps."""
    import random

    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    rng = random.Random(8)
    edges = {("ring", f"m{k:02}", f"m{(k + 1) % 62:02}") for k in range(62)} | {("two", "a", "b"), ("two", "b", "a"), ("two", "b", "c"), ("line", "a", "b")}
    edges |= {("mid", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(30)} | {("many", f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(70)}
    frame = spark.createDataFrame([*sorted(edges), (None, "a", "b"), (None, "b", "a")], "repo_id string, src string, dst string")
    proper = {e for e in edges if e[1] != e[2]}
    if small < 62:  # by steps the ring takes 62 of them
        frame, proper = frame.where("repo_id != 'ring'"), {e for e in proper if e[0] != "ring"}
    assert {(r["repo_id"], r["node"]): r["component"] for r in graph.cyclic_components(frame).collect()} == plain_components(proper)
    assert {(r["repo_id"], tuple(r["cycle"])) for r in graph.cycles(frame).collect()} == plain_cycles(proper)


def test_graphs_without_cycles(spark):
    frame = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "c")], "repo_id string, src string, dst string")
    for none in (frame, frame.limit(0)):
        assert graph.cyclic_components(none).count() == 0 and graph.cycles(none).count() == 0


def test_module_paths(spark):
    assert one(spark, "a/b/__init__.py", graph.module_of) == "a.b"
    assert one(spark, "a.b.c", lambda c: graph.relative_module(c, F.lit(1), F.lit("d"))) == "a.b.d"
    assert one(spark, "a.b.c", lambda c: graph.relative_module(c, F.lit(2), F.lit(""))) == "a"
    assert one(spark, "../lib/x.ts", lambda c: graph.script_path(F.lit("src/app"), c)) == "src/lib/x"
    assert one(spark, "./ui/index", lambda c: graph.script_path(F.lit("src"), c)) == "src/ui"


def test_history(spark):
    a, b = "a" * 40, "b" * 40
    text = [f"{a}|x@y|1000", "3\t1\tsrc/{old => new}/f.go", "-\t-\tpic.png", "", f"{b}|z@y|90000", "5\t0\tsrc/new/f.go", "", "9\t9\tstray.go"]
    lines = spark.createDataFrame([("r", i, v) for i, v in enumerate(text)], "repo_id string, line_no long, value string")
    got = parse_history(lines)
    assert sorted((r["hash"][0], r["path"], r["added"], r["deleted"]) for r in got.collect()) == [("a", "src/new/f.go", 3, 1), ("b", "src/new/f.go", 5, 0)]
    typed = got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert temporal.commit_stability(typed).first()["commit_stability"] == pytest.approx(89000 / 86400)
    lone = typed.where(F.col("hash") == a)
    assert temporal.commit_stability(lone).first()["commit_stability"] == 30
    commits = typed.select("repo_id", "hash", "author", "ts").distinct()
    assert temporal.churn_rate(commits, typed, dt.datetime(1970, 1, 3)).first()["churn_rate"] == 4.5
    assert temporal.author_fragmentation(typed, dt.datetime(1970, 1, 3)).first()["author_fragmentation"] == 2


@pytest.mark.parametrize("part", [1, 3, 7, 10_000])
def test_history_parts_carry_their_headers(spark, part):
    """One log far longer than its parts: headers, blank lines and stray lines at every place of a part."""
    import random

    rng = random.Random(part)
    text, want, now = [], [], None
    for k in range(300):
        kind = rng.choice("hbfffffx")
        if kind == "h":
            now = f"{k:040x}"
            text.append(f"{now}|a{k}|{k}")
        elif kind == "b":
            now = None
            text.append("" if k % 2 else " ")
        elif kind == "x":
            text.append("words without counts")
        else:
            text.append(f"{k}\t1\tp{k}")
            if now:
                want.append((now, f"p{k}", k))
    lines = spark.createDataFrame([("r", i, v) for i, v in enumerate(text)] + [("q", 5, "3\t1\tlone")], "repo_id string, line_no long, value string").repartition(5)
    got = parse_history(lines, part).where("path is not null").collect()
    assert sorted((r["hash"], r["path"], r["added"]) for r in got) == sorted(want)


def test_commits_without_files_are_told_in_one_scan(spark):
    """A commit without files has one row a header, none where another header of its hash has files; the log is scanned once."""
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    text = [f"{a}|x|1", "", f"{b}|x|2", "1\t2\tf", "", f"{b}|x|3", "-\t-\tpic", "", f"{c}|x|4", "-\t-\tpic", "", f"{c}|x|5"]
    got = parse_history(spark.createDataFrame([("r", i, v) for i, v in enumerate(text)], "repo_id string, line_no long, value string"))
    assert sorted((r["hash"][0], r["path"] or "", r["added"], r["deleted"]) for r in got.collect()) == [("a", "", 0, 0), ("b", "f", 1, 2), ("c", "", 0, 0), ("c", "", 0, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("LogicalRDD") <= 2


def test_coupling_prunes_before_it_pairs(spark):
    """Equal to counting every pair; bulk commits count neither for pairs nor for the files' own commits."""
    import itertools
    import random
    from collections import Counter

    rng = random.Random(4)
    commits = {f"c{k}": {f"p{int(rng.paretovariate(0.7)) % 40:02}" for _ in range(rng.choice((1, 3, 6, 40)))} for k in range(120)}
    rows = [("r", h, "u", dt.datetime(2024, 1, 1), p, 1, 0) for h, ps in commits.items() for p in ps]
    changes = spark.createDataFrame(rows, "repo_id string, hash string, author string, ts timestamp_ntz, path string, added int, deleted int")
    small = [ps for ps in commits.values() if len(ps) <= 10]
    own = Counter(p for ps in small for p in ps)
    want = {(a, b): n for (a, b), n in Counter(x for ps in small for x in itertools.combinations(sorted(ps), 2)).items() if own[a] >= 5 and own[b] >= 5}
    assert len(small) < len(commits) and want
    assert {(r["a"], r["b"]): r["shared"] for r in temporal.coupled_pairs(changes, bulk=10).collect()} == want


def _awkward_changes(spark, seed=5):
    """Changes with repeated rows, null paths, rare files, files of most commits, and a commit of very many files."""
    import random

    rng = random.Random(seed)
    rows = [("r", f"c{k}", f"u{k % 7}", dt.datetime(2024, 1, 1), f"p{int(rng.paretovariate(0.7)) % 60:02}", 1, 2) for k in range(150) for _ in range(rng.choice((1, 3, 6, 12)))]
    rows += rows[::9] + [("r", f"e{k}", None, dt.datetime(2024, 1, 1), None, 0, 0) for k in range(3)] + [("r", "bulk", "u1", dt.datetime(2024, 1, 1), f"p{k:03}", 1, 0) for k in range(300)]
    return rows, spark.createDataFrame(rows, "repo_id string, hash string, author string, ts timestamp_ntz, path string, added int, deleted int")


@pytest.mark.parametrize("often", (1, 20, 10**6))
@pytest.mark.parametrize("least", (1, 5))
def test_coupling_tells_frequent_files_apart(spark, monkeypatch, often, least):
    import itertools
    from collections import Counter

    monkeypatch.setattr(temporal, "OFTEN", often)
    rows, changes = _awkward_changes(spark)
    commits = {}
    for _, h, _, _, path, _, _ in rows:
        commits.setdefault(h, set()).add(path)
    small = [ps - {None} for ps in commits.values() if len(ps) <= 8]
    own = Counter(x for ps in small for x in ps)
    want = {p: n for p, n in Counter(x for ps in small for x in itertools.combinations(sorted(ps), 2)).items() if min(own[p[0]], own[p[1]]) >= least}
    got = {(r["a"], r["b"]): r["shared"] for r in temporal.coupled_pairs(changes, least, bulk=8).collect()}
    assert want and got == want


def test_files_are_counted_where_changes_are_sent_once(spark):
    rows, changes = _awkward_changes(spark)
    want = {}
    for _, h, u, _, path, added, deleted in rows:
        n, hs, us = want.setdefault(path, [0, set(), set()])
        want[path][0] = n + added + deleted
        hs.add(h)
        us.add(u)
    got = temporal.file_changes(changes)
    assert {r["path"]: (r["total_changes"], r["commits"], r["authors"]) for r in got.collect()} == {k: (n, len(hs), len(us - {None})) for k, (n, hs, us) in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan


def test_history_joins_lines_once_and_deals_them_by_their_number(spark, monkeypatch, tmp_path):
    """Lines of a part that is not listed keep their change and have no brand; a part that is twice gives two."""
    from gaugeworks.operators import steps
    from gaugeworks.plans import adapters

    monkeypatch.setattr(steps, "ROWS_A_TASK", 50)
    day = dt.datetime(2001, 7, 1)
    orders = [(o, o % 4, f"r{o % 2}", day + dt.timedelta(days=o % 40)) for o in range(40)]
    lines = [(o, (o * n) % 7, float(n * 3), n) for o in range(40) for n in range(1, 5)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int"),
        "part": ([(p, None if p == 2 else f"b{p % 3}") for p in (0, 1, 2, 3, 3, 5)], "p_partkey long, p_brand string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got, parts = adapters.history(spark, str(tmp_path))
    assert parts == 1 + len(lines) // 50
    for mine, plain in ((adapters.by_part(got), {}), (adapters.by_brand(got), {"by_brand": True})):
        want = adapters.changes(spark, str(tmp_path), **plain)
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, want.collect()))
    commits, whole = adapters.commits(spark, str(tmp_path)), adapters.changes(spark, str(tmp_path))
    want = temporal.history_metrics(commits, whole, adapters.AS_OF, 16.0).collect()
    assert {r["metric"]: r["repo_id"] for r in want if r["value"]}.keys() >= {"churn_rate", "author_fragmentation", "commit_stability", "hotspot_concentration"}
    assert sorted(temporal.history_metrics(commits, whole, adapters.AS_OF, 16.0, parts=parts).collect()) == sorted(want)


def test_evidence_of_history_reads_files_once(spark):
    _, changes = _awkward_changes(spark)
    files = temporal.file_changes(changes)
    got = evidence.history_evidence(files, temporal.coupled_pairs(changes))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "total_changes" in plan and "sum(lines" not in plan and "sum((added" not in plan
    assert got.groupBy("metric").count().count() == 4


def test_ignore_rules_as_data_equal_those_in_expressions(spark):
    """Each repository has lines of its own; the last that fits decides."""
    files = ["a/b.log", "b/a.log", "a.log", "x/build/y", "build", "build/z", "a/b/c/z", "a/z", "x/keep.go", "keep.go", "doc/a.txt", "doc/a/b.txt", "a.c", "ab.c", "x/a.c", "c[1].c", "sp ace", "#note", "!bang", "deep/doc/a.txt", "w.x+y"]
    ignores = [
        ["*.log"], ["/a.log"], ["build/"], ["build"], ["a/**/z"], ["*.go", "!keep.go", "x/"], ["doc/*.txt"], ["[ab].c", "!/a.c"], ["?.c"], ["", "# no", "\\#note", "\\!bang"],
        ["*", "!a", "!doc/"], ["/doc/", "!doc/a/"], ["sp ace  "], ["[!a]*.c"], ["w.x+y", "**/c"], ["/x/**"], [],
    ]
    rules = classify.ignore_rules(spark.createDataFrame([(f"r{k}", i, line) for k, lines in enumerate(ignores) for i, line in enumerate(lines)], "repo_id string, line_no int, line string"))
    rows = spark.createDataFrame([(f"r{k}", f) for k in range(len(ignores)) for f in files] * 2, "repo_id string, rel_path string")
    got = {(r["repo_id"], r["rel_path"]): r["ignored"] for r in classify.ignored_paths(rows, rules).collect()}
    paths = spark.createDataFrame([(f,) for f in files], "p string").persist()
    want = {}
    for k, lines in enumerate(ignores):
        for r in paths.select("p", classify.ignored_by(F.col("p"), lines).alias("i")).collect():
            want[f"r{k}", r["p"]] = r["i"]
    assert got == want


def test_trend_over_many_reports(spark):
    rows = [("r", 100, "C1", 5.0), ("r", 100, "C2", 6.0), ("r", 300, "C1", 7.0), ("r", 300, "C3", 4.0), ("r", 200_000_000, "C1", 6.5), ("r", 200_000_000, "C2", 1.0), ("q", 50, "C1", 3.0)]
    frame = spark.createDataFrame(rows, "repo_id string, at long, category string, score double")
    want = {
        ("r", 100, "C1"): (None, None), ("r", 100, "C2"): (None, None), ("q", 50, "C1"): (None, None),
        ("r", 300, "C1"): (100, 5.0), ("r", 300, "C3"): (100, 0.0), ("r", 200_000_000, "C1"): (300, 7.0), ("r", 200_000_000, "C2"): (300, 0.0),
    }
    for bucket in (1, 150, 30 * 86400):
        got = {(r["repo_id"], r["at"], r["category"]): (r["before_at"], r["before"]) for r in render.series_trend(frame, bucket).collect()}
        assert got == want


def test_unjudged_names(spark):
    none = spark.createDataFrame([("r", "x")], "repo_id string, name string")
    for unjudged in (100.0, 0.0):
        assert semantics.naming_consistency(none, F.length("name") > 1, F.lit(True), unjudged).first()["naming_consistency"] == unjudged


def test_coupling_leaves_out_bulk_commits(spark):
    rows = [("r", f"c{i}", "u", dt.datetime(2024, 1, 1), p, 1, 0) for i in range(6) for p in ("a", "b")]
    rows += [("r", "bulk", "u", dt.datetime(2024, 1, 1), f"f{k}", 1, 0) for k in range(60)]
    changes = spark.createDataFrame(rows, "repo_id string, hash string, author string, ts timestamp_ntz, path string, added int, deleted int")
    pairs = temporal.coupled_pairs(changes).collect()
    assert [(r["a"], r["b"], r["shared"], r["strength"]) for r in pairs] == [("a", "b", 6, 100.0)]
    assert temporal.coupling(temporal.coupled_pairs(changes)).first()["temporal_coupling_pct"] == 100.0


def test_hotspots(spark):
    rows = spark.createDataFrame([("r", f"p{i:02d}", 10 if i else 200, 1, 1) for i in range(11)], "repo_id string, path string, total_changes int, commits int, authors int")
    assert temporal.hotspot_concentration(rows).first()["hotspot_concentration"] == pytest.approx(200 / 300 * 100)
    assert temporal.top_hotspots(rows, 1).first()["path"] == "p00"


def test_documentation(spark):
    text = "package a\n// one\nx := 1\n/* two\nthree */\ny := 2\n/* four */\nz := 3"
    got = one(spark, text, documentation.comment_lines)
    assert (got["total"], got["comments"]) == (8, 5)
    script = "/**\n * Adds.\n */\nexport function add() {}\nexport const x = 1;\n/** y */\n\nexport class Y {}\n"
    got = one(spark, script, documentation.documented_exports)
    assert (got["public"], got["documented"]) == (3, 2)
    assert one(spark, "a\n```go\nx\ny\n```\nb\n```\nopen", documentation.code_blocks) == ["x\ny"]
    listing = spark.createDataFrame([("r", "README.rst"), ("r", "README"), ("r", "docs/README.md")], "repo_id string, rel_path string")
    assert documentation.well_known(listing).first()["rel_path"] == "README"


def test_summaries(spark):
    rows = spark.createDataFrame([("r", "go", 3, "b"), ("r", "go", 3, "a"), ("r", "go", 0, "c")], "repo_id string, language string, v int, name string")
    got = summary.summary(rows, ["repo_id"], "v", "name").first()
    assert (got["avg"], got["max"], got["max_entity"]) == (2.0, 3, "a")
    sizes = spark.createDataFrame([("r", "python", 7.0, 9, "p"), ("r", "go", 5.0, 6, "g")], "repo_id string, language string, avg double, max int, max_entity string")
    got = summary.file_sizes(sizes).first()
    assert (got["avg"], got["max"], got["max_entity"]) == (5.0, 9, "p")
    values = spark.createDataFrame([("r", "go", 0.0), ("r", "python", 80.0), ("r", "typescript", 40.0)], "repo_id string, language string, v double")
    assert summary.blend(values, "v", unset=0.0).first()["v"] == 60.0
    assert summary.blend(values, "v").first()["v"] == 40.0
    assert one(spark, 300, lambda c: summary.script_null_safety(F.lit(True), F.lit(1), c), "int") == pytest.approx(50 + 100 / 3)


def test_agent_scores(spark):
    rubric = agent_eval.Rubric(2, {"a": ["alpha", "beta"], "b": ["gamma"]}, ["unknown"])
    for text, want in (("Alpha beta GAMMA", 4), ("unknown", 1), ("", 2)):
        assert one(spark, text, lambda c: agent_eval.response_score(c, rubric)) == want
    for text, want in (('["a"]', 10), ("see [x", 7), ("words", 4), (" ", 1)):
        assert one(spark, text, agent_eval.array_score) == want
    runs = spark.createDataFrame([("m", 2.0), ("m", 4.0), ("m", 6.0)], "m string, score double")
    got = agent_eval.consistency_score(runs, ["m"]).first()
    assert got["variance"] == pytest.approx(8 / 3) and got["consistency"] == 10
    samples = spark.createDataFrame([("m", 7, None), ("m", 8, None), ("m", 0, "timeout"), ("n", 0, "x")], "m string, score int, error string")
    got = {r["m"]: r["metric_score"] for r in agent_eval.metric_scores(samples, ["m"]).collect()}
    assert got == {"m": 7, "n": 0}


def test_variance_on_a_limit(spark):
    values = {"a": [6, 5, 2, 8, 6, 9], "b": [7, 6, 1, 6, 5, 9, 6, 8]}
    runs = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "m string, score double").coalesce(1)
    got = {r["m"]: (r["variance"], r["consistency"]) for r in agent_eval.consistency_score(runs, ["m"]).collect()}
    assert got == {"a": (5.0, 7), "b": (5.0, 7)}  # a running mean gave 4.999... and 10 for the first


def test_coverage(spark):
    profile = "mode: set\nm/a.go:1.1,2.2 3 1\nm/a.go:3.1,4.2 3 0\n"
    lcov = "SF:a\nDA:1,1\nDA:2,0\nDA:3,4\nend_of_record\n"
    xml = '<?xml version="1.0"?><coverage line-rate="0.75"></coverage>'
    rows = [("a", "cover.out", profile), ("a", "lcov.info", lcov), ("b", "x/lcov.info", lcov), ("c", "cobertura.xml", xml), ("d", "cover.out", "nothing"), ("d", "coverage.xml", xml)]
    got = {r[0]: round(r[1], 2) for r in coverage.repository_coverage(spark.createDataFrame(rows, "repo_id string, rel_path string, text string")).collect()}
    assert got == {"a": 50.0, "b": 66.67, "c": 75.0, "d": 75.0}


SOURCE = '''
import os
from .a import b as c
from x.y import z

class K:
    """Doc."""
    def m(self, p: int, q) -> str:
        if p and q or p:
            return "a"
        for i in range(3):
            pass

def simple():
    return 1

def test_it():
    assert simple() == 1

def broken_out(a, *b):
    def inner():
        if a: return 1
    return [i for i in b if i] if a else None
'''


def test_python_facts(spark, tmp_path):
    import ast

    got = {}
    for kind, name, *rest in facts_of(SOURCE):
        got.setdefault(kind, {})[name] = rest
    assert {k: v[2] for k, v in got["function"].items()} == {"K.m": 5, "simple": 1, "test_it": 1, "broken_out": 2, "inner": 2}
    assert got["typed_slots"]["K.m"][2] == 2 and got["slots"]["K.m"][2] == 3 and got["slots"]["broken_out"][2] == 3
    assert got["test"]["test_it"][2] == 1 and got["export"]["K"][2] == 1 and set(got["imported_name"]) == {"b", "z"}
    assert [k for k, *_ in facts_of("def (")] == ["error"]
    assert complexity(ast.parse("def f():\n  return 1").body[0]) == 1
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text(SOURCE)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden/b.py").write_text("x = 1")
    tree = files.read_tree(spark, str(tmp_path), "r")
    assert [r["rel_path"] for r in tree.select("rel_path").collect()] == ["pkg/a.py"]
    assert python_facts(tree).where("kind = 'function'").count() == 5


def test_report(spark):
    import json

    from gaugeworks.config import ScoringConfig
    from gaugeworks.operators import scoring

    raw = spark.createDataFrame([("r", "churn_rate", 100.0, True)], "repo_id string, metric string, value double, available boolean")
    sub = scoring.score_metrics(raw, ScoringConfig().frame(spark))
    categories = scoring.category_scores(sub)
    scored = scoring.composite_scores(categories)
    document = json.loads(render.json_reports(scored, categories, sub, scoring.recommend(sub)).first()["report"])
    assert document["version"] == "3" and document["categories"][0]["name"] == "C5" and len(document["categories"][0]["sub_scores"]) == 5
    assert render.gate(scored, 10.0).count() == 1 and render.gate(scored, 0.0).count() == 0
    badge = one(spark, 6.04, lambda c: render.badge(F.lit("Agent-Assisted"), c), "double")
    assert badge == "https://img.shields.io/badge/agent--readiness-Agent--Assisted%206.0%2F10-yellow"


def test_repeated_keys_common_and_rare(spark):
    rows = [("r", "hot", i) for i in range(3000)] + [("r", "pair", 1), ("r", "pair", 2), ("r", "one", 1), ("s", "one", 1), ("r", None, 1), ("r", None, 2)]
    frame = spark.createDataFrame(rows, "repo_id string, key string, at int")
    got = clones._of_repeated(frame, ["repo_id", "key"])
    assert got.columns == frame.columns
    assert {tuple(r) for r in got.groupBy("repo_id", "key").count().collect()} == {("r", "hot", 3000), ("r", "pair", 2)}
    assert clones._of_repeated(frame.limit(0), ["repo_id", "key"]).count() == 0


def test_duplicated_windows_by_one_grouping(spark):
    rows = [("r", "two", 1, 1, 3), ("r", "two", 2, 5, 7), ("r", "apart", 3, 1, 3), ("r", "apart", 3, 3, 5), ("r", "apart", 3, 2, 4), ("r", "over", 4, 1, 3), ("r", "over", 4, 2, 4), ("r", "lost", None, 1, 3), ("r", "lost", None, 9, 11)]
    got = clones.duplicated_windows(spark.createDataFrame(rows, "repo_id string, hash string, file int, start int, end int")).collect()
    assert {(r["hash"], r["file"], r["start"]) for r in got} == {("two", 1, 1), ("two", 2, 5), ("apart", 3, 1), ("apart", 3, 3)}
