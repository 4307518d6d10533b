"""Candidate life, notes, sessions, node writes, packs and ingestion on small tables."""

import datetime as dt
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.functions import scalar as fn
from quillgraph.operators import aggregates, facts, graph, ingest, link, resolve, retrieval, tasks, triage
from quillgraph.plans import catalogue, ingestion, router
from quillgraph.session import clear, parts, shared_dir, written
from quillgraph.sources import chat, notes
from quillgraph.sources.base import EPISODE

T = dt.datetime(2024, 1, 1)
CANDIDATE = "candidate_id bigint, proposer string, predicate string, subject string, object_id string, object_value string, statement string, confidence double, status string, reject_reason string, kind string, payload string, episode_id bigint, created_at timestamp_ntz"


def now():
    return F.lit("2024-03-01").cast("timestamp_ntz")


def test_candidate_life(spark):
    none = spark.createDataFrame([], CANDIDATE)
    new = spark.createDataFrame([("llm", "knows", "Ann", "b", "Ann knows Bo", 0.9), ("llm", "knows", "Cy", "a", "Cy knows Ann", 0.8), ("llm", "knows", "", None, "The water filter needs replacing", 0.4)], "proposer string, predicate string, subject string, object_id string, statement string, confidence double")
    c = triage.propose(triage.propose(none, new, now()), new, now())
    assert c.count() == 3 and {(r.status, r.kind) for r in c.collect()} == {("proposed", "fact")}
    resolved = spark.createDataFrame([("ann", "a"), ("Cy", "c")], "subject string, node_id string")
    assert [r.statement for r in triage.pending_about(c, resolved, "a").collect()] == ["Ann knows Bo", "Cy knows Ann"]
    assert [r.statement for r in facts.pending(c, 5, most=0.8).collect()] == ["Cy knows Ann", "The water filter needs replacing"]
    assert triage.pending_in_class(c, "llm", "knows", 2).count() == 2
    one = {r.statement: r.candidate_id for r in c.collect()}
    change = spark.createDataFrame([(one["Ann knows Bo"], "x")], "candidate_id bigint, value string")
    twice = triage.update_payload(triage.update_payload(c, change, "note"), change.withColumn("value", F.lit("y")), "why")
    assert [json.loads(r.payload) for r in twice.where("payload IS NOT NULL").collect()] == [{"note": "x", "why": "y"}]
    none_found = spark.createDataFrame([], "candidate_id bigint, name string, node_type string")
    got = {r.statement: (r.subject, r.marker) for r in triage.headed(c, none_found).collect()}
    assert got["The water filter needs replacing"] == ("water filter", "subject_phrase") and got["Ann knows Bo"] == ("Ann", None)
    verdict = triage.record_verdicts(spark.createDataFrame([], schema.VERDICT), spark.createDataFrame([(1, "m", "accept", "b1")], "candidate_id bigint, mechanism string, verdict string, basis string"))
    verdict = triage.record_verdicts(verdict, spark.createDataFrame([(1, "m", "reject", "b2")], "candidate_id bigint, mechanism string, verdict string, basis string"))
    assert [(r.verdict, r.outcome) for r in verdict.collect()] == [("reject", None)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("The gutter cleaning service is scheduled for July 6.", "gutter cleaning service"), ("A water filtration system needs replacing.", "water filtration system"), ("He is planning a trip.", None),
        ("It was a long day.", None), ("Takes pills before talks", None), ("one two three four five is much", None), ("is late", None), ("", None), (None, None),
    ],
)
def test_subject_phrase(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(fn.subject_phrase(F.col("t"))).first()[0] == want


def test_accepted_objects_are_resolved(spark):
    rows = [(1, "llm", "uses", "Ann", None, "Tool", "s1", 0.9, "proposed", None, "fact", None, 1, T), (2, "llm", "born", "Ann", None, "1990", "s2", 0.9, "proposed", None, "fact", None, 1, T)]
    lanes = spark.createDataFrame([(1, "accept"), (2, "accept")], "candidate_id bigint, lane string")
    resolved = spark.createDataFrame([("Ann", "a"), ("tool", "t")], "subject string, node_id string")
    got = {r.predicate: (r.object_id, r.object_value) for r in triage.accepted_claims(spark.createDataFrame(rows, CANDIDATE), lanes, resolved).collect()}
    assert got == {"uses": ("t", None), "born": (None, "1990")}


def test_commitment_facts(spark):
    rows = [(1, "accepted", "commitment", '{"what": "send plan", "who": "Ann", "direction": "owed_to_me"}', 7), (2, "accepted", "commitment", '{"what": "pay", "who": "me"}', None)]
    candidate = spark.createDataFrame(rows, "candidate_id bigint, status string, kind string, payload string, episode_id bigint")
    task = tasks.create_tasks(spark.createDataFrame([], schema.TASK), tasks.commitments(candidate), now())
    resolved = spark.createDataFrame([("ann", "a", "Ann Roe")], "name string, node_id string, label string")
    got = sorted((r.predicate, r.object_id, r.object_value, r.statement) for r in tasks.commitment_claims(candidate, task, resolved, now()).collect())
    assert got == [("originated_in", None, "7", 'Task "send plan" originated in episode 7'), ("waiting_on", "a", None, '"send plan" is waiting on Ann Roe')]


NOTE = "# Ann Roe\n- Type: #person\n- Email:\n  - Ann@X.org\n  - second@x.org\n- Company: [[Acme]]\n- Title: Head\n- Phone: +49 (89) 1234567\nsee [[Bo]]\n"


def test_notes_are_promoted(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("a/Ann.md", NOTE)
        z.writestr("a/Book.md", "# Deep Work\n- Type: #book\n- Author: [[Cal N]]\n")
        z.writestr("a/2024-01-02.md", "today\n")
        z.writestr("a/skip.txt", "no")
    read = notes.Notes(str(tmp_path / "n.zip")).fetch(spark)
    assert sorted((r.source, r.source_id) for r in read.collect()) == [("notes.daily", "2024-01-02"), ("notes.page", "ann-roe"), ("notes.page", "deep-work")]
    episode = read.withColumn("episode_id", F.xxhash64("source_id"))
    out = {k: v.collect() for k, v in notes.promoted(episode).items()}
    (person,) = out["person"]
    assert (person.name, person.emails, person.phones) == ("Ann Roe", ["ann@x.org", "second@x.org"], ["+49891234567"])
    assert sorted((r.subject, r.predicate, r.object, r.object_value) for r in out["claim"]) == [("Ann Roe", "has_role", None, "Head"), ("Ann Roe", "works_at", "Acme", None), ("Cal N", "authored", "Deep Work", None)]
    names = spark.createDataFrame([("bo", "b")], "name string, node_id string")
    assert [r.node_id for r in notes.linked_nodes(episode, names).collect()] == ["b"]
    e, tags = notes.written_note(spark, " remember ", "2024-01-05 10:00:00", ["x"])
    assert e.first().body == "remember" and tags.first().body == "x" and e.first().source_id == tags.first().source_id


def test_sessions_and_repositories(spark, tmp_path):
    lines = [
        {"type": "user", "timestamp": "2024-01-01T10:00:00Z", "cwd": "/home/u/src/alpha", "message": {"role": "user", "content": "fix it"}},
        {"type": "assistant", "timestamp": "2024-01-01T10:01:00Z", "cwd": "/home/u/src/alpha", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Edit", "input": {"file_path": "/home/u/src/beta/x.py", "n": 1}}, {"type": "text", "text": "ok"}]}},
        {"type": "user", "timestamp": "2024-01-01T10:02:00Z", "cwd": "/home/u/src/alpha", "message": {"role": "user", "content": [{"type": "tool_result", "content": "done"}]}},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (r,) = chat.AgentSessions(str(tmp_path)).fetch(spark).collect()
    meta = json.loads(r.meta)
    assert r.body == "fix it" and meta["projects"] == ["alpha", "beta"] and meta["asked"] == 1 and meta["paths"] == ["/home/u/src/beta/x.py"]
    session = spark.createDataFrame([("s", "A title", T, None, "/x/repos/gamma/a"), ("empty", "t", T, None, None)], "id string, title string, started_at timestamp_ntz, ended_at timestamp_ntz, cwd string")
    message = spark.createDataFrame([("s", "user", "second", T + dt.timedelta(1)), ("s", "user", "first", T), ("s", "assistant", "no", T)], "session_id string, role string, content string, at timestamp_ntz")
    (r,) = chat.session_tables(session, message).collect()
    assert r.body == "A title\n\nfirst\n\nsecond" and json.loads(r.meta)["projects"] == ["gamma"] and r.occurred_end == T + dt.timedelta(1)
    episode = spark.createDataFrame([(1, "github", "me/alpha#2024-01-01"), (2, "github", "me/none#2024-01-01"), (3, "github", "me/two#2024-01-01")], "episode_id bigint, source string, source_id string")
    nodes = spark.createDataFrame([("p1", "project", "Alpha", 0), ("p2", "project", "two", 0), ("p3", "project", "me/two", 0)], schema.NODE)
    assert [(r.episode_id, r.node_id) for r in chat.repository_projects(episode, nodes, spark.createDataFrame([], schema.ALIAS)).collect()] == [(1, "p1")]


def test_node_writes(spark):
    nodes = spark.createDataFrame([("a", "person", "Ann", 3), ("e", "event", "Ann", 0)], schema.NODE)
    new = graph.upsert_nodes(nodes, spark.createDataFrame([("a", "person", " Ann Roe "), ("b", "org", "Acme")], "node_id string, node_type string, name string"))
    assert {r.node_id: (r.name, r.access_count) for r in new.collect()} == {"a": ("Ann Roe", 3), "b": ("Acme", 0), "e": ("Ann", 0)}
    alias = graph.add_aliases(spark.createDataFrame([("a", "ann")], schema.ALIAS), spark.createDataFrame([("a", " ANN "), ("a", " "), ("b", "AC")], schema.ALIAS))
    assert sorted(map(tuple, alias.collect())) == [("a", "ann"), ("b", "ac")]
    ident = graph.upsert_identifiers(spark.createDataFrame([("a", "email", "x")], schema.IDENTIFIER), spark.createDataFrame([("b", "email", "x"), ("b", "email", "y")], schema.IDENTIFIER))
    assert sorted((r.node_id, r.value) for r in ident.collect()) == [("a", "x"), ("b", "y")]
    assert {r.node_id: r.access_count for r in graph.accessed(new, spark.createDataFrame([("a",), ("a",)], "node_id string")).collect()} == {"a": 5, "b": 0, "e": 0}
    assert [r.node_id for r in graph.owner(new, graph.set_owner(graph.set_owner(ident, "a"), "b")).collect()] == ["b"]
    context = graph.set_context(spark.createDataFrame([], schema.CONTEXT), spark.createDataFrame([("a", "be brief", None)], "node_id string, instruction string, summary string"), now())
    context = graph.set_context(context, spark.createDataFrame([("a", None, "knows all")], "node_id string, instruction string, summary string"), now())
    assert [(r.instruction, r.summary, r.summary_stale) for r in context.collect()] == [("be brief", "knows all", False)]
    dead = spark.createDataFrame([("email", "1"), ("sms", "2")], schema.TOMBSTONE)
    assert ingest.list_tombstones(ingest.lift_tombstones(dead, dead.where("source = 'sms'")), "email").count() == 1
    old = spark.createDataFrame([(1, "k", 1, "old"), (2, "k", 1, "kept")], "episode_id bigint, kind string, version int, content string")
    assert sorted(r.content for r in ingest.store_enrichment(old, old.where("episode_id = 1").withColumns({"version": F.lit(2), "content": F.lit("new")})).collect()) == ["kept", "new"]
    assert link.link_temporal(spark.createDataFrame([], schema.EPISODE), spark.createDataFrame([], schema.MENTION), nodes).count() == 0


def test_ingest_run(spark):
    tables = schema.empty_graph(spark)
    person = [{"email": "Ann@X.org", "name": "Ann Roe"}]
    rows = [("email", "1", "hello from Bo Li", T, None, "public", person, None), ("email", "2", "Ann Roe wrote", T, None, "public", None, None), ("email", "dead", "x", T, None, "public", person, None)]
    incoming = spark.createDataFrame(rows, EPISODE).withColumn("raw", F.col("body")).withColumn("projects", F.when(F.col("source_id") == "1", F.array(F.struct(F.lit("/src/alpha").alias("root"), F.lit("alpha").alias("name")))))
    tables |= {"tombstone": spark.createDataFrame([("email", "dead")], schema.TOMBSTONE), "nodes": spark.createDataFrame([("b", "person", "Bo Li", 0), ("d", "document", "Hello from", 0)], schema.NODE)}
    tables["person_interaction"] = link_rollup(spark, tables)
    for k in range(2):
        tables = ingestion.ingest_run(tables, incoming, "capture")
        assert sorted((r.source_id, r.outcome) for r in tables["outcome"].collect()) == ([("1", "inserted"), ("2", "inserted"), ("dead", "tombstoned")] if k == 0 else [("1", "unchanged"), ("2", "unchanged"), ("dead", "tombstoned")])
        ids = {r.name: r.node_id for r in tables["nodes"].collect()}
        assert set(ids) == {"Bo Li", "Hello from", "Ann Roe", "alpha"}
        of = {r.episode_id: r.source_id for r in tables["episode"].collect()}
        assert sorted((of[r.episode_id], r.node_id == ids["Ann Roe"], r.extractor) for r in tables["mention"].collect()) == [("1", False, "alias"), ("1", False, "attendee"), ("1", True, "attendee"), ("2", True, "alias")]
        assert {r.node_id: r.interactions for r in tables["person_interaction"].collect()} == {ids["Ann Roe"]: 2, "b": 1}
        assert tables["raw"].count() == 2 and tables["cursor"].first().items_seen == 2
    with pytest.raises(ValueError):
        ingestion.ingest_run(tables, incoming, "forget")


def link_rollup(spark, tables):
    from quillgraph.operators import aggregates

    return aggregates.person_interactions(tables["episode"], tables["mention"], tables["nodes"], now())


def test_stemmed_search_by_hand(spark):
    docs = spark.createDataFrame([(1, "running runner runs"), (2, "the run of the mill"), (3, "nothing here"), (4, "")], "id bigint, text string")
    asked = spark.createDataFrame([("q", "RUNS quickly")], "query_id string, text string")
    index = retrieval.build_index(docs)
    got = {r.id: r.score for r in retrieval.search(index, asked, 10).collect()}
    # run: 2 of 4 documents; 11 - ... words: 3 + 5 + 2 + 0 of 4, hence 2.5 on average; running and runs have one stem, runner another
    idf = max(1e-6, __import__("math").log((4 - 2 + 0.5) / (2 + 0.5)))
    assert got == {1: pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5))), 2: pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / 2.5)))}
    assert {r.id for r in retrieval.bm25(docs, asked, 10).collect()} == {1, 2} and {r.id for r in retrieval.bm25(docs, asked, 10, stemmed=False).collect()} == {1}


def test_nearest_by_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5))
    x[7] = x[8]
    v = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id bigint, embedding array<double>")
    want = {(q, int(i)) for q in range(50) for i in sorted(range(50), key=lambda i: (round(float(np.linalg.norm(x[q] - x[i])), 9), i))[:4]}
    for block in (7, 4096):
        got = retrieval.nearest(v, v.select(F.col("id").alias("query_id"), F.col("embedding").alias("qv")), 4, block).collect()
        assert {(r.query_id, r.id) for r in got} == want
    assert retrieval.nearest(v.where("false"), v.select(F.col("id").alias("query_id"), F.col("embedding").alias("qv")), 4).count() == 0


def test_pack_is_checked_and_logged(spark):
    e = spark.createDataFrame([(1, "email", "1", "Ann likes the garden", T, None, "public", None, None)], schema.EPISODE)
    nodes = spark.createDataFrame([("a", "person", "Ann Roe", 0), ("b", "person", "Bo Li", 0)], schema.NODE)

    def fact(i, o, statement):
        return (i, "a", "works_at", o, None, statement, T, None, T, None, 0.9, "positive", "public", "user", 1, 1)

    f = spark.createDataFrame([fact("f1", "x", "Ann Roe works at Acme garden"), fact("f2", "y", "something else")], schema.FACT)
    names = nodes.select(F.lower("name").alias("name"), "node_id", "node_type")
    store = router.Store(e, nodes, spark.createDataFrame([(1, "a", "attendee", 1.0)], schema.MENTION), f, names)
    when, half = dt.datetime(2024, 3, 1), spark.createDataFrame([("works_at", 0.23)], "predicate string, decay double")
    pack = router.answer(spark, store, "what about the garden of Ann Roe", when, "kg", spark.createDataFrame([], schema.OBSERVATION), half)
    assert {r.kind for r in pack.items.collect()} == {"fact", "episode"} and [r.kind for r in pack.flags.collect()] == ["contradiction"]
    assert pack.coverage.first().status == "thin" and sorted(r.kind for r in pack.ledger.collect()) == ["flag_shown", "question", "shown:episode", "shown:fact"]
    only = router.answer(spark, store, "what about the garden of Ann Roe", when, "kg", types=("fact",), lens=router.Lens(scope="facts"))
    assert {r.kind for r in only.items.collect()} == {"fact"} and only.ledger.count() == 0
    q, items = router.ask(spark, store, "when did I last email Ann Roe and Bo Li", when)
    said = sorted(r.text for r in items.collect())
    assert q.intent == "lookup" and said == ["Ann Roe: last email: 2024-01-01 00:00:00 (1 interactions, last channel email)", "Bo Li: no recorded last email"]


def test_written_tables_are_cleared(spark):
    df = written(spark.range(5), "some")
    (path,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert df.count() == 5 and clear(spark) >= 1 and clear(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_shared_folder_is_named(spark):
    assert shared_dir(spark).startswith("file:")

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared_dir(Elsewhere)


def test_nightly_sequence(spark):
    """Names become mentions, and what they support is decided in one run."""
    from quillgraph.plans import nightly

    g = schema.empty_graph(spark)
    rows = [(k, "email", str(k), "Ann Roe met Bo Li" if k < 6 else "nobody", T + dt.timedelta(k), None, "public", None, None) for k in range(30)]
    g["episode"] = spark.createDataFrame(rows, schema.EPISODE)
    g["nodes"] = spark.createDataFrame([("a", "person", "Ann Roe", 0), ("b", "person", "Bo Li", 0), ("c", "person", "Cy", 0)], schema.NODE)
    g["mention"] = spark.createDataFrame([(k, f"x{k}", "attendee", 1.0) for k in range(30)], schema.MENTION)
    said = [("f1", "a", "co_occurs", "b", None, "Ann Roe and Bo Li co-occur (9 shared episodes, NPMI 0.20)"), ("f2", "a", "co_occurs", "c", None, "Ann Roe and Cy co-occur (3 shared episodes, NPMI 0.50)")]
    g["fact"] = spark.createDataFrame([(*f, T, None, T, None, 0.9, "positive", "public", "npmi", 1, 1) for f in said], schema.FACT)
    pending = [(1, "llm", "knows", "ann roe", "c", None, "Ann knows Cy", 0.9, "proposed", None, None, "fact", None), (2, "llm", "discussed", "ann roe", None, None, "the plan", 0.9, "proposed", None, None, "fact", None)]
    g["candidate"] = spark.createDataFrame(pending, schema.CANDIDATE)
    out = nightly.nightly(g, now(), spark.createDataFrame([("co_occurs", 0.0)], "predicate string, decay double"))
    assert {(r.episode_id, r.node_id) for r in out["mention"].where("extractor = 'alias'").collect()} == {(k, n) for k in range(6) for n in "ab"}
    assert {r.fact_id: r.action for r in out["decay"].collect()} == {"f1": "rewrite", "f2": "close"} and [r.fact_id for r in out["phantoms"].collect()] == ["f2"]
    assert {r.candidate_id: r.lane for r in out["lanes"].collect()} == {1: "review", 2: "ephemeral"}
    assert {r.fact_id: r.verdict for r in out["verdicts"].collect()} == {"f1": "rederived", "f2": "refuted"}
    assert {r.node_id for r in out["summaries"].collect()} == {"a", "b"} and out["knn"].count() == 0


def test_wearable_pages_and_facts(spark, tmp_path):
    page = {"conversations": [{"id": "1", "start_time": "2024-01-01T10:00:00", "short_summary": "s", "summary": "longer", "primary_location": {"address": "Home", "latitude": 1.5}}, {"id": "1", "short_summary": "s"}, {"id": "2", "summary": "x"}, {"summary": "none"}]}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    pages = notes.conversation_pages(spark, str(tmp_path))
    got = {r.source_id: r for r in pages.collect()}
    assert set(got) == {"1", "2"} and got["1"].body == "s\n\nlonger" and json.loads(got["1"].meta)["latitude"] == 1.5 and got["1"].occurred_at == dt.datetime(2024, 1, 1, 10)
    episode = pages.where("source_id = '1'").withColumn("body", F.lit("s"))
    assert sorted(r.source_id for r in notes.lacking(episode, pages).collect()) == ["1", "2"]
    suggested = notes.suggested_facts(spark.createDataFrame([(7, "likes tea", ["a"])], "id bigint, text string, tags array<string>"))
    c = triage.propose(spark.createDataFrame([], CANDIDATE), suggested, now())
    assert notes.pending_pushes(c).count() == 0
    refused = triage.reject(c, c, "no")
    assert [(r.bee_fact_id, r.confirmed) for r in notes.pending_pushes(refused).collect()] == [("7", False)]
    pushed = triage.update_payload(refused, refused.select("candidate_id", F.lit("1").alias("value")), "bee_pushed")
    assert notes.pending_pushes(pushed).count() == 0
    gold = spark.createDataFrame([("q", "j", ["email:m1", "other"])], "query string, job string, expect_ids array<string>")
    known = spark.createDataFrame([(5, "email", "m1")], "episode_id bigint, source string, source_id string")
    assert sorted(r.expect for r in notes.resolve_expect(gold, known).collect()) == ["5", "other"]


def test_calls_of_a_front_end(spark):
    from quillgraph.plans import tools

    t = schema.empty_graph(spark)
    t["nodes"] = spark.createDataFrame([("a", "person", "Ann Roe", 0), ("b", "org", "Acme", 0)], schema.NODE)
    for _ in range(2):
        t = tools.upsert_fact(t, {"subject": "ann roe", "predicate": "works_at", "object": "Acme", "statement": "Ann works at Acme"}, now())
    t = tools.upsert_fact(t, {"subject": "Ann Roe", "predicate": "born", "object": "1990", "statement": "Ann was born in 1990"}, now())
    t = tools.upsert_fact(t, {"subject": "Nobody", "predicate": "born", "object": "1990", "statement": "x"}, now())
    assert {(r.object_id, r.object_value, r.observations) for r in t["fact"].collect()} == {("b", None, 2), (None, "1990", 1)}
    assert sorted(r.kind for r in t["observation"].collect()) == ["asserted", "asserted", "corroborated"]
    t = tools.upsert_alias(t, "Ann Roe", " Annie ")
    assert sorted((r.part, r.text) for r in tools.entity(t, "a").collect()) == [("alias", "annie"), ("fact", "Ann was born in 1990"), ("fact", "Ann works at Acme"), ("name", "person: Ann Roe")]
    assert tools.entity(t, "a", F.lit("2020-01-01").cast("timestamp_ntz")).where("part = 'fact'").count() == 0
    rows = [(1, "llm", "uses", "annie", None, "Tool", "Annie uses Tool", 0.9, "proposed", None, None, "fact", None), (2, "llm", "knows", "annie", None, None, "no", 0.9, "proposed", None, None, "fact", None)]
    t["candidate"] = spark.createDataFrame(rows, schema.CANDIDATE)
    assert [r.candidate_id for r in tools.review(t, 5).collect()] == [2, 1] and tools.review(t, 5, "llm", "uses").count() == 1
    t = tools.decide(t, [1], [2], "wrong")
    assert {r.candidate_id: (r.status, r.reject_reason) for r in t["candidate"].collect()} == {1: ("accepted", None), 2: ("rejected", "wrong")}
    assert tools.live_statement(t["fact"], "annie USES tool!").count() == 1 and tools.status(t).count() == 0


def test_events_and_migrations(spark):
    tables = schema.empty_graph(spark)
    rows = [("calendar.event", "u1", "Planning\nWith: Ann", T, T + dt.timedelta(hours=1), "personal", [{"email": "ann@x.org", "name": "Ann Roe"}], None)]
    run = ingestion.ingest_run(tables, spark.createDataFrame(rows, EPISODE))
    nodes, mentions, claims = ingestion.event_claims(run)
    assert [(r.node_type, r.name) for r in nodes.collect()] == [("event", "Planning")] and mentions.count() == 1
    assert [(r.predicate, r.statement) for r in claims.collect()] == [("attended", 'Ann Roe attended "Planning" on 2024-01-01 00:00:00')]
    fact = facts.assert_facts(run["fact"], claims, run["episode"])
    assert fact.first().object_id == nodes.first().node_id and fact.first().sensitivity == "personal"
    old = {"nodes": tables["nodes"].drop("access_count"), "fact": fact.drop("object_value", "polarity")}
    new, version = schema.migrate(old)
    assert version == len(schema.MIGRATIONS) and set(new) == set(schema.TABLES) and new["fact"].first().polarity == "positive"
    assert all(new[k].columns == v.columns for k, v in tables.items()) and schema.migrate(new, version)[0]["fact"].count() == 1


def test_intervals_that_meet_in_a_part_of_a_second(spark):
    """An end less than a second after a bin's edge still touches that bin; so does all before 1970."""
    text = [(1, "2024-01-01 09:30:00", "2024-01-01 10:00:00.5"), (2, "1969-12-31 22:30:00", "1969-12-31 23:00:00.000001")]
    other = [(3, "2024-01-01 10:00:00.2", "2024-01-01 10:30:00"), (4, "1969-12-31 23:00:00", "1969-12-31 23:00:01"), (5, "2024-01-01 10:00:00.5", "2024-01-01 11:00:00")]
    a, b = (spark.createDataFrame(x, "id int, start string, end string").selectExpr("id", "CAST(start AS TIMESTAMP_NTZ) AS start", "CAST(end AS TIMESTAMP_NTZ) AS end") for x in (text, other))
    got = {(r.l_id, r.r_id) for r in link.interval_overlaps(a, b).collect()}
    assert got == {(1, 3), (2, 4)}


def test_persons_of_one_name_are_a_class(spark):
    """A name of many persons gives a row each, not a row a pair; punctuation and case don't part them."""
    rows = [(f"p{k:04}", "person", "Ann  Lee" if k % 2 else "ann. LEE") for k in range(3000)] + [("q1", "person", "Bo Li"), ("q2", "org", "Bo Li"), ("q3", "person", "Ann"), ("q4", "person", "Ann")]
    got = resolve.duplicate_persons(spark.createDataFrame(rows, "node_id string, node_type string, name string")).collect()
    assert len(got) == 3000 and {(r["class"], r.links) for r in got} == {("p0000", 2999)}


@pytest.mark.parametrize("light", [2, 5, 64])
def test_strong_scores_are_those_of_all_pairs(spark, light):
    """Hubs' wedges are left out only where no pair can reach a floor."""
    rows = [(f"u{k}", f"h{(k * k + j * 7) % 9}") for k in range(60) for j in range(k % 6)] + [("u1", "u2"), ("u3", "u2"), ("h1", "h2"), ("h3", "h2")]
    edges = spark.createDataFrame(rows, "a string, b string")
    for aa, ra in ((1.2, 0.3), (0.6, 0.1)):
        want = {(r.a, r.b, round(r.aa, 9), round(r.ra, 9)) for r in link.neighbour_scores(edges).where(f"aa >= {aa} OR ra >= {ra}").collect()}
        got = [(r.a, r.b, round(r.aa, 9), round(r.ra, 9)) for r in link.strong_scores(edges, aa, ra, light).collect()]
        assert len(got) == len(want) > 20 and set(got) == want


def test_pair_counts_of_chosen_pairs_and_many_partitions(spark, tmp_path):
    """Counts of chosen pairs are those of all pairs, and partitions are as many as the table's size asks for."""
    m = spark.createDataFrame([(k, f"n{(k * j) % 7}") for k in range(40) for j in range(4)], "episode_id long, node_id string")
    every = {(r.a, r.b): tuple(r) for r in link.pair_counts(m, 1).collect()}
    only = spark.createDataFrame([("n1", "n2"), ("n0", "n3"), ("n8", "n9"), ("n1", "n2")], "a string, b string")
    got = {(r.a, r.b): tuple(r) for r in link.pair_counts(m, 1, only).collect()}
    assert got == {k: every[k] for k in (("n1", "n2"), ("n0", "n3")) if k in every} and len(got) == 2
    m.repartition(1).write.parquet(f"{tmp_path}/m")
    stored = spark.read.parquet(f"{tmp_path}/m")
    assert parts(stored) == 2 and parts(stored, 0.0001) > 2 and parts(m) == 2


def test_scores_of_asked_nodes(spark):
    edges = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("b", "i"), ("a", "i")], "a string, b string")
    every = {frozenset((r.a, r.b)): round(r.aa, 9) for r in link.neighbour_scores(edges).collect()}
    got = {(r.query_id, r.id): round(r.aa, 9) for r in link.neighbour_scores(edges, spark.createDataFrame([("b",), ("b",)], "node_id string")).collect()}
    assert got == {("b", x): every[frozenset(("b", x))] for x in ("a", "c")}


def test_postings_of_a_common_word_lie_in_several_parts(spark):
    docs = spark.createDataFrame([(k, "the runs  running, The" if k else None) for k in range(300)], "id bigint, text string")
    index = retrieval.build_index(docs)
    assert index.postings.where("term = 'the'").select(F.input_file_name()).distinct().count() > 1
    assert {(r.term, r.tf, r.dl) for r in index.postings.collect()} == {("the", 2, 4), ("run", 2, 4)} and index.postings.count() == 598


def test_names_longer_than_runs_are_compared_only_if_there_are_any(spark):
    e = spark.createDataFrame([(1, "Ann Lee of the North met Bo"), (2, "")], "episode_id long, body string")
    few, more = ([("bo li", "b"), ("bob", "x"), ("met", "m")], [("ann lee of the north", "a")])
    plans = [link.alias_scan(e, spark.createDataFrame(x, "name string, node_id string"), 2) for x in (few, few + more)]
    assert [sorted(r.node_id for r in p.collect()) for p in plans] == [["m"], ["a", "m"]]
    assert ["contains(" in p._jdf.queryExecution().optimizedPlan().toString().lower() for p in plans] == [False, True]


def test_observations_without_episode_join_nothing(spark):
    """They'd all meet in one task; their own times count."""
    when = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    fact = spark.createDataFrame([("f", when[0], when[0]), ("g", when[0], when[0])], "fact_id string, valid_from timestamp_ntz, ingested_at timestamp_ntz")
    seen = spark.createDataFrame([("f", "asserted", None, when[3]), ("f", "asserted", 1, when[0]), ("g", "verified", 1, when[0])], "fact_id string, kind string, episode_id long, observed_at timestamp_ntz")
    clock = aggregates.staleness_clock(fact, seen, spark.createDataFrame([(1, when[2])], "episode_id long, occurred_at timestamp_ntz"))
    assert {r.fact_id: r.seen_at for r in clock.collect()} == {"f": when[3], "g": when[2]}
    assert "episode_id IS NULL" in clock._jdf.queryExecution().analyzed().toString() or "isnull(episode_id" in clock._jdf.queryExecution().analyzed().toString()


def hash_partitions(df):
    """The numbers of partitions that the plan hashes rows to."""
    return {int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}


MENTIONS = [(k, f"n{k * j % 7}") for k in range(40) for j in range(4)] + [(None, "n1"), (None, "n2"), (3, None), (5, "n2"), (5, "n2")]


def test_chosen_pairs_lie_in_partitions_by_size(spark, monkeypatch):
    """Mentions pass the chosen nodes, and pairs the chosen pairs, in as many partitions as the size asks for, unsorted."""
    monkeypatch.setattr(link, "parts", lambda df: 7)
    m = spark.createDataFrame(MENTIONS, "episode_id long, node_id string")
    only = spark.createDataFrame([("n1", "n2"), ("n0", "n3"), ("n8", "n9"), ("n1", "n2"), (None, "n4")], "a string, b string")
    got = link.shared_counts(m, 1, only)
    assert hash_partitions(got) == {7} and got._jdf.queryExecution().executedPlan().toString().count("ShuffledHashJoin") == 2
    boxes = {}
    for k, x in MENTIONS:
        boxes.setdefault(k, set()).add(x)
    want = {(a, b, n) for a, b in (("n1", "n2"), ("n0", "n3")) if (n := sum({a, b} <= v for k, v in boxes.items() if k is not None))}
    assert len(want) == 2 and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_derivation_lies_in_partitions_by_size(spark, monkeypatch):
    """A node's mentions aren't sorted in a task by the default number, and what pairs share is as counted by hand."""
    monkeypatch.setattr(link, "parts", lambda df: 7)
    m = spark.createDataFrame(MENTIONS, "episode_id long, node_id string")
    tiers = ["public", "secret", "personal", "private"]
    e = spark.createDataFrame([(k, tiers[k % 4 if k < 30 else 0], dt.datetime(2024, 1, 1 + k % 9)) for k in range(39)], "episode_id long, sensitivity string, occurred_at timestamp")
    got = link.attach_derivation(spark.createDataFrame([("n1", "n2"), ("n0", "n3"), ("n1", "n9"), ("n0", "n3")], "a string, b string"), m, e)
    assert hash_partitions(got) == {7}
    want = []
    for a, b in (("n0", "n3"), ("n1", "n2")):
        both = [k for k in range(39) if all((k, x) in MENTIONS for x in (a, b))]
        strictest = max((tiers[k % 4 if k < 30 else 0] for k in both), key=["public", "personal", "private", "secret"].index)
        want.append((a, b, strictest, max(both, key=lambda k: (k % 9, k))))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_few_claims_are_broadcast(spark, monkeypatch):
    """Mentions of other nodes go before any shuffle, ids of episodes lie in partitions by size, and results are those of many claims."""
    monkeypatch.setattr(link, "parts", lambda df, mb=0.5: 7 if mb == 0.5 else 5)
    m = spark.createDataFrame(MENTIONS, "episode_id long, node_id string")
    claims = spark.createDataFrame([("f", "n2", "n1", 0.3), ("g", "n0", "n3", 0.3), ("h", "n8", "n9", 0.3), ("i", "n1", "n2", 0.9), ("j", None, "n4", 0.3)], "fact_id string, a string, b string, stated double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = {}
    for most in (5, 4):
        monkeypatch.setattr(link, "FEW", most)
        few = link.are_few(claims)
        decay, phantom = facts.npmi_decay(claims, m), facts.phantoms(claims, m)
        assert [few, *("ShuffledHashJoin" not in plan(x) for x in (decay, phantom))] == [most == 5] * 3
        assert (5 in hash_partitions(decay)) == few
        claimed = claims.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        counts = link.pair_counts(m, 1, claimed, few).select("a", "b", "co", "n_a", "n_b", "universe")
        found[most] = [sorted(map(tuple, x.collect())) for x in (decay, phantom, counts)]
    assert found[4] == found[5] and found[5][1] == [("h",), ("j",)]
    rows = set(MENTIONS)
    boxes = {x: {k for k, y in rows if y == x} for _, x in rows}
    universe = len({k for k, _ in rows} - {None})
    want = [(a, b, len(boxes[a] & boxes[b] - {None}), len(boxes[a]), len(boxes[b]), universe) for a, b in (("n0", "n3"), ("n1", "n2"))]
    assert found[5][2] == want


def test_lines_of_nodes_without_claims_are_not_shuffled(spark):
    """The joins of decay and phantoms with claimed nodes are right above the scan."""
    for name in ("dec1_npmi_decay", "dec2_phantoms"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "l_partkey" in plan and not re.search(r"Exchange hashpartitioning\(l_orderkey|ShuffledHashJoin", plan)
