"""Operators on small tables worked out by hand: edge cases that the driver tables don't have."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparkloom.errors import CyclicGraph
from sparkloom.functions import mime
from sparkloom.functions import text as X
from sparkloom.operators import dispatch, graphs, relational, runs
from sparkloom.session import written
from sparkloom.sources import files, mail
from sparkloom.streaming import task_events

START = dt.datetime(2024, 1, 1)


def task_runs(spark, *tasks):
    """(name, begin, end) in seconds, null stamps allowed; a fourth item is the status."""
    stamp = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    made = [("r", t[0], t[3] if len(t) > 3 else "success", 1, stamp(t[1]), stamp(t[2])) for t in tasks]
    return runs.duration(spark.createDataFrame(made, "run_id string, name string, status string, attempts int, started_at timestamp_ntz, finished_at timestamp_ntz"))


def edges(spark, *pairs, key="run_id"):
    return spark.createDataFrame([("r", s, d, "hard", k) for k, (s, d) in enumerate(pairs)], f"{key} string, src string, dst string, kind string, pos int")


# -- run analytics ---------------------------------------------------------------------------------------------------


def test_profile_of_a_chain(spark):
    made, needs = task_runs(spark, ("a", 0, 1), ("b", 1, 3), ("c", 3, 4.5)), edges(spark, ("a", "b"), ("b", "c"))
    (row,) = runs.run_profile(made, needs).collect()
    assert (row["wall"], row["critical"], row["peak"], row["efficiency"]) == (4.5, 4.5, 1, 1.0)
    assert [r["name"] for r in runs.profile(made, needs).where("critical").orderBy("name").collect()] == ["a", "b", "c"]


def test_profile_of_parallel_tasks_a_join_and_a_diamond(spark):
    none = edges(spark, ("a", "b")).limit(0)
    (row,) = runs.parallelism(runs.run_spans(task_runs(spark, ("a", 0, 1), ("b", 0, 2)))).collect()
    assert (row["peak"], row["average"]) == (2, 1.5)
    (row,) = runs.critical_path(task_runs(spark, ("a", 0, 1), ("b", 0, 3), ("c", 3, 4)), edges(spark, ("a", "c"), ("b", "c"))).collect()
    assert (row["total"], row["path"]) == (4.0, ["b", "c"])
    diamond = task_runs(spark, ("a", 0, 1), ("b", 1, 4), ("c", 1, 3), ("d", 4, 5)), edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))
    (row,) = runs.critical_path(*diamond).collect()
    assert (row["total"], row["path"]) == (5.0, ["a", "b", "d"])
    assert rows(runs.critical_path(task_runs(spark, ("x", 0, 2), ("a", 0, 2)), none).select("path")) == [(["a"],)]


def test_of_needs_that_tie_the_last_counts(spark):
    made = task_runs(spark, ("a", 0, 2), ("b", 0, 2), ("c", 2, 3))
    assert runs.critical_path(made, edges(spark, ("a", "c"), ("b", "c"))).first()["path"] == ["b", "c"]
    assert runs.critical_path(made, edges(spark, ("b", "c"), ("a", "c"))).first()["path"] == ["a", "c"]


def test_waits_gaps_and_missing_stamps(spark):
    made = task_runs(spark, ("a", 0, 1), ("gap", 1.5, 2), ("overlap", 0.5, 2), ("skip", 5, 6, "skipped"), ("never", None, None))
    waits = dict(rows(runs.wait_times(made, edges(spark, ("a", "gap"), ("a", "overlap"), ("a", "skip"), ("a", "never"))).select("name", "wait")))
    assert waits == {"a": 0.0, "gap": 0.5, "overlap": 0.0, "skip": 0.0, "never": 0.0}
    assert runs.wall_clock(made).first()["wall"] == 6.0
    assert runs.wall_clock(task_runs(spark, ("a", None, None))).first()["wall"] == 0.0
    assert rows(runs.bottlenecks(made, 0)) == []
    assert rows(runs.parallelism(runs.run_spans(task_runs(spark, ("a", 1, 1))))) == []


def test_cyclic_graphs_have_no_critical_path(spark):
    made = task_runs(spark, ("a", 0, 1), ("b", 1, 2))
    assert rows(runs.critical_path(made, edges(spark, ("a", "b"), ("b", "a")))) == []
    assert rows(graphs.cyclic_nodes(spark.createDataFrame([("r", n) for n in "abcd"], "graph string, name string"), edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), key="graph"))) == [("r", "a"), ("r", "b"), ("r", "c")]


def test_soft_edges_carry_no_order(spark):
    made = task_runs(spark, ("a", 0, 5), ("b", 0, 1), ("c", 6, 7))
    needs = edges(spark, ("a", "b"), ("b", "c")).withColumn("kind", F.when(F.col("src") == "a", "soft").otherwise("hard"))
    (row,) = runs.critical_path(made, needs).collect()
    assert (row["total"], row["path"]) == (5.0, ["a"])
    nodes, own = runs.as_graph(made, needs)
    assert rows(graphs.layers(nodes, own)) == [("r", "a", 0), ("r", "b", 0), ("r", "c", 1)]
    assert rows(graphs.describe(nodes, own)) == [("r", 3, 1, 1, 2)]
    assert dict(rows(runs.wait_times(made, needs).select("name", "wait"))) == {"a": 0.0, "b": 0.0, "c": 5.0}
    assert [r["needs"] for r in runs.profile(made, needs).orderBy("name").collect()] == [[], [], ["b"]]
    back = needs.union(edges(spark, ("c", "a")).withColumn("kind", F.lit("soft")))
    assert rows(graphs.layers(nodes, runs.as_graph(made, back)[1]).where("layer IS NULL")) == []
    assert rows(graphs.cyclic_nodes(nodes, runs.as_graph(made, back)[1])) == [("r", "a"), ("r", "b"), ("r", "c")]


def test_deep_graphs_take_rounds_not_plans(spark):
    n = 14
    nodes = spark.createDataFrame([(g, f"n{k:02d}", float(k % 3)) for g in (1, 2) for k in range(n)], "graph int, name string, w double")
    needs = spark.createDataFrame([(g, f"n{k:02d}", f"n{k + 1:02d}", "hard", 0) for g in (1, 2) for k in range(n - 1)] + [(2, "n05", "n05", "hard", 1)], "graph int, src string, dst string, kind string, pos int")
    got = graphs.longest_paths(nodes, needs, "w")
    assert rows(got.where("graph = 1").select("layer", "total")) == sorted([(k, float(sum(j % 3 for j in range(k + 1)))) for k in range(n)], key=repr)
    assert got.where("graph = 2").count() == 5 and graphs.layers(nodes, needs).where("layer IS NULL").count() == n - 5
    last = got.where("name = 'n13'").first()
    assert last["path"] == [f"n{k:02d}" for k in range(n)]
    statuses = nodes.select("graph", "name", F.when(F.col("name") == "n01", "failed").otherwise("success").alias("status"), (F.col("name") == "n09").alias("tolerant"))
    skipped = dispatch.skip_propagation(statuses, needs)
    assert skipped.where("status = 'skipped'").count() == 14 and skipped.where("status = 'success'").count() == 12
    assert graphs.downstream(nodes.where("name = 'n10'"), needs).count() == 8


def test_references_in_several_levels(spark):
    """A chain of graphs that refer to each other, one task of another graph, own nodes after references, and circles."""
    names = lambda g, *given: [(g, f"{g}_{x}", k) for k, x in enumerate(given)]
    nodes = spark.createDataFrame(names("base", "a", "b") + names("tool", "x", "y", "z") + names("top", "one", "two"), "graph string, name string, pos int")
    own = spark.createDataFrame([("base", "base_a", "base_b", "hard", 0), ("tool", "tool_x", "tool_y", "soft", 0)], "graph string, src string, dst string, kind string, pos int")
    refs = spark.createDataFrame([("mid", 0, "base"), ("mid", 1, "tool"), ("top", 0, "mid"), ("top", 1, "tool.tool_y")], "graph string, pos int, ref string")
    made, links = graphs.expand_references(refs, nodes, own)
    order = lambda g: [r["name"] for r in made.where(F.col("graph") == g).orderBy("pos").collect()]
    assert order("mid") == ["base_a", "base_b", "tool_x", "tool_y", "tool_z"]
    assert order("top") == ["base_a", "base_b", "tool_x", "tool_y", "tool_z", "tool_y", "top_one", "top_two"]
    pairs = lambda g: sorted((r["src"], r["dst"]) for r in links.where((F.col("graph") == g) & (F.col("kind") == "hard")).collect())
    mid = [("base_a", "base_b"), ("base_b", "tool_x"), ("base_b", "tool_y"), ("base_b", "tool_z")]
    assert pairs("mid") == mid
    assert pairs("top") == sorted([*mid, ("tool_z", "tool_y"), ("tool_y", "top_one"), ("top_one", "top_two")])
    circle = refs.union(spark.createDataFrame([("base", 0, "top")], refs.schema))
    with pytest.raises(CyclicGraph) as e:
        graphs.expand_references(circle, nodes, own)
    assert set(e.value.path) == {"base", "mid", "top"}
    assert rows(graphs.expand_references(refs.limit(0), nodes, own)[0]) == []


def test_gantt_bars(spark):
    bars = runs.gantt(task_runs(spark, ("a", 0, 1), ("b", 2, 4)), edges(spark, ("a", "b"))).orderBy("name").collect()
    assert [(b["begin"], b["end"], b["left_pct"], b["width_pct"]) for b in bars] == [(0.0, 1.0, 0.0, 25.0), (2.0, 4.0, 50.0, 50.0)]


# -- graphs and dispatch ---------------------------------------------------------------------------------------------


def test_graph_checks(spark):
    nodes = spark.createDataFrame([("r", n) for n in ("a", "b", "b")], "graph string, name string")
    assert rows(graphs.duplicate_nodes(nodes)) == [("r", "b", 2)]
    assert rows(graphs.missing_inputs(nodes, edges(spark, ("a", "b"), ("x", "b"), key="graph")).select("dst", "missing")) == [("b", "x")]
    needs = spark.createDataFrame([("r", "a", []), ("r", "b", ["a", "c"])], "graph string, name string, needs array<string>")
    assert rows(graphs.edges_of(needs).select("src", "dst", "pos")) == [("a", "b", 0), ("c", "b", 1)]
    with pytest.raises(ValueError):
        graphs.mermaid(nodes, edges(spark, ("a", "b"), key="graph"), "UP")


def test_skips_stop_at_tolerant_and_cached_nodes(spark):
    statuses = spark.createDataFrame([("r", "a", "failed", False), ("r", "b", "success", False), ("r", "c", "success", True), ("r", "d", "success", False), ("r", "k", "cached", False), ("r", "l", "success", None)], "graph string, name string, status string, tolerant boolean")
    got = dispatch.skip_propagation(statuses, edges(spark, ("a", "b"), ("b", "c"), ("b", "d"), ("k", "l"), key="graph"))
    assert rows(got.select("name", "status", "cause")) == [("a", "failed", None), ("b", "skipped", "a"), ("c", "success", None), ("d", "skipped", "b"), ("k", "cached", None), ("l", "success", None)]


def test_waves_and_state_limits(spark):
    nodes = spark.createDataFrame([("r", 0, f"n{k}", 0, "k") for k in range(5)] + [("r", 0, "free", 0, None)], "graph string, layer int, name string, priority int, concurrency_key string")
    limits = spark.createDataFrame([("k", 2)], "concurrency_key string, allowed int")
    assert [r["wave"] for r in dispatch.waves(nodes, limits).orderBy("name").collect()] == [0, 0, 0, 1, 1, 2]
    assert dispatch.waves(nodes, limits.limit(0)).agg(F.max("wave")).first()[0] == 4
    state = spark.createDataFrame([("a", 90.0), ("b", 89.9)], "key string, ts double")
    assert rows(dispatch.live_state(state, F.lit(100.0), 10.0).select("key")) == [("a",)]
    assert dispatch.live_state(state, F.lit(100.0), None).count() == 2
    late = spark.createDataFrame([(5.0, 4.0), (4.0, 4.0), (9.0, None)], "duration double, timeout double")
    assert [r["timed_out"] for r in dispatch.timed_out(late).orderBy("duration").collect()] == [False, True, False]


# -- relational ------------------------------------------------------------------------------------------------------


def test_lookup_takes_the_last_duplicate(spark):
    orders = spark.createDataFrame([(1, "C1"), (2, "C2"), (3, "C9")], "id int, customer string")
    customers = spark.createDataFrame([("C1", "old", 1), ("C1", "new", 2), ("C2", None, 1)], "id string, name string, at int")
    assert rows(relational.lookup_join(orders, customers, "customer", "id", {"name": "who"}, [F.col("at")])) == [(1, "C1", "new"), (2, "C2", None)]


def test_search_wildcards_and_backslashes(spark):
    df = spark.createDataFrame([("Harbour Ledger",), ("stone\\lamp",), (None,), ("100%",)], "subject string")
    found = lambda k: [r[0] for r in relational.search(df, k, ["subject"]).collect()]
    assert found("ledger") == ["Harbour Ledger"] and found("e\\l") == ["stone\\lamp"] and found("H_r%r") == ["Harbour Ledger"] and len(found("")) == 3


def test_threads_upserts_and_imports(spark):
    mails = spark.createDataFrame([(1, "Night train", 1), (2, "Re: Night train", 2), (3, "Barley prices", 3), (4, None, 4)], "id int, subject string, at int")
    assert rows(relational.group_threads(mails, "subject", "id", "at").select("subject", "n")) == sorted([("Night train", 2), ("Barley prices", 1), (relational.NO_SUBJECT, 1)])
    old = spark.createDataFrame([("p", "h1", 1)], "file_path string, file_hash string, at int")
    new = spark.createDataFrame([("p", "h2", 2), ("q", "h3", 2)], "file_path string, file_hash string, at int")
    assert rows(relational.upsert_latest(old, new, ["file_path"], "at")) == [("p", "h2", 2), ("q", "h3", 2)]
    assert rows(relational.classify_import(new, old, "file_path", "file_hash").select("file_path", "change")) == [("p", "updated"), ("q", "new")]


@pytest.mark.parametrize(("glob", "yes", "no"), [("a?c*", "ABCdef", "abdc"), ("[!x]*", "ax", "xa"), ("a.b", "A.B", "acb"), ("*[0-9]", "n1", "1n")])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "name string")
    assert rows(df.where(F.col("name").rlike(relational.glob_pattern(glob)))) == [(yes,)]


# -- text ------------------------------------------------------------------------------------------------------------


def applied(spark, fn, *texts):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(fn(F.col("t"))).collect()]


def test_subjects(spark):
    got = applied(spark, X.normalize_subject, "Re: Fwd: Kiln", "FW: x ", "re:y", "Regarding: z", "", None)
    assert got == ["Fwd: Kiln", "x", "y", "Regarding: z", "", None]


def test_versions(spark):
    texts = ["1.2.3", "v0.9.10-rc.1+b", "1.2", "01.2.3", None, "1.2.3-01", "1.2.3-a..b", "1.2.3-0a.-+01.b", "1.2.3+", "0.0.0-0"]
    assert applied(spark, lambda c: X.bump_version(c, "minor"), *texts) == ["1.3.0", "0.10.0", None, None, None, None, None, "1.3.0", None, "0.1.0"]
    long = ["1234567890123456789.2.3", "0.999999999999999999999999999999999999999999.1", "99.0.0"]
    assert applied(spark, lambda c: X.bump_version(c, "major"), *long) == ["1234567890123456790.0.0", "1.0.0", "100.0.0"]
    assert applied(spark, lambda c: X.bump_version(c, "minor"), *long)[1] == "0.1" + "0" * 42 + ".0"
    assert applied(spark, lambda c: X.parse_version(c).getField("major").cast("string"), *long, "x") == ["1234567890123456789", "0", "99", None]
    assert applied(spark, lambda c: X.bump_assignment(c, "patch"), 'version = "v1.2.3"', 'version = "1.2.3-01"') == ['version = "v1.2.3"', 'version = "1.2.3-01"']
    assert applied(spark, lambda c: X.bump_assignment(c, "patch"), 'version = "1.2.3"', "__version__ = '1.0.0'  # x", 'name = "1.2.3"', 'version = "x"') == ['version = "1.2.4"', "__version__ = '1.0.1'  # x", 'name = "1.2.3"', 'version = "x"']


def test_names(spark):
    assert applied(spark, X.stem, "/a/b.c/d.tar.gz", "plain", ".hidden") == ["d.tar", "plain", ".hidden"]
    assert applied(spark, lambda c: X.set_level(c, 2), "report(PUB)", "report [CON](3)", "report") == ["report(INT)", "report (INT)", "report(INT)"]
    assert applied(spark, lambda c: X.set_level(c, 0), "a(PUB)", "a_(3)3_b", "_3_3_", "PUB)", "((PUB))") == ["a", "a_3_b", "3_", "PUB)", "()"]
    assert applied(spark, X.title_case, "it's a1b2 o_x", "HELLO there", "élan ÉTÉ", "") == ["It'S A1B2 O_X", "Hello There", "Élan Été", ""]
    assert applied(spark, X.requirement_name, "a==1", " b == 2", "c>=1", "") == ["a", "b", None, None]


# -- mail, files, streams --------------------------------------------------------------------------------------------

PLAIN = b"From: a@x.org\r\nTo: b@x.org\r\nSubject: =?utf-8?b?w4TDtg==?= tail\r\nDate: Mon, 1 Jan 2024 12:00:00 +0000\r\n\r\nBody"
PARTS = b"""Subject: parts\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain; charset=gbk\n\n\xc4\xe3\xba\xc3\n--B\nContent-Type: text/html\n\n<p>hi</p>\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=x.txt\n\nno body\n--B--\n"""


def test_mail_fields():
    made = mime.parse_message(PLAIN)
    assert (made["subject"], made["date_parsed"], made["body_text"], made["has_attachments"]) == ("Äö tail", "2024-01-01T12:00:00+00:00", "Body", 0)
    made = mime.parse_message(PARTS)
    assert (made["body_text"].strip(), made["body_html"].strip(), made["has_attachments"]) == ("你好", "<p>hi</p>", 1)
    assert (mime.iso_date(""), mime.iso_date("Invalid Date"), mime.iso_date(None)) == ("", "Invalid Date", "")
    assert mime.decode_words("=?iso-8859-1?q?caf=E9?= =?utf-8?q?_x?=") == "café x"
    assert mime.parse_message(b"")["subject"] == ""


def test_mails_are_imported_once(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.eml").write_bytes(PLAIN)
    (tmp_path / "sub" / "b.eml").write_bytes(PARTS)
    (tmp_path / "c.txt").write_bytes(b"no mail")
    first = written(mail.import_mails(spark, str(tmp_path), mail.empty_archive(spark), F.lit(START)), "mails")
    assert first.count() == 2 and mail.list_view(first).columns == mail.LISTED
    (tmp_path / "a.eml").write_bytes(PLAIN.replace(b"tail", b"second edition"))
    later = mail.import_mails(spark, str(tmp_path), first, F.lit(START + dt.timedelta(days=1)))
    assert sorted(r["subject"] for r in later.collect()) == ["parts", "Äö second edition"]
    assert files.list_files(spark, str(tmp_path), "*.txt").count() == 1
    assert files.has_content(spark, str(tmp_path / "c.txt"), "no mail") and not files.has_content(spark, str(tmp_path / "c.txt"), "zz")


def test_header_functions_on_columns(spark):
    df = spark.createDataFrame([("=?utf-8?q?=C3=A9?=", "Tue, 2 Jan 2024 00:00:00 +0100"), (None, None)], "subject string, date string")
    assert rows(df.select(mime.decode_header("subject"), mime.header_date("date"))) == [("", ""), ("é", "2024-01-02T00:00:00+01:00")]


def test_requirements_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("a==1.0",), ("# note",), ("b==2",)], "line string")
    files.write_lines(lines, "line", f"{tmp_path}/req")
    assert rows(files.read_requirements(spark, f"{tmp_path}/req")) == [("a", "1.0"), ("b", "2")]
    files.write_json(lines, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 3


def test_streams_of_task_events(spark, tmp_path):
    event = lambda seq, status, minute: ("r", seq, "a", status, 1, None, None, None, START + dt.timedelta(minutes=minute))
    for k, batch in enumerate([[event(1, "running", 0), event(1, "running", 0)], [event(2, "success", 3), event(3, "failed", 90)]]):
        spark.createDataFrame(batch, task_events.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def ended(df, mode, name):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.table(name))

    events = task_events.read_events(spark, f"{tmp_path}/in")
    assert len(ended(task_events.without_repeats(events, ["run_id", "seq"]), "append", "once")) == 3
    assert [r[2:] for r in ended(task_events.status_counts(events), "complete", "counts")] == [("running", 2), ("success", 1), ("failed", 1)]
    assert sorted(r[-1] for r in ended(task_events.sessions(events, key_col="task"), "complete", "bursts")) == [1, 3]
    assert ended(task_events.latest_status(events), "complete", "last") == [("r", "a", "failed", 1)]
