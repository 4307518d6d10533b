"""Order-dependent operators, parsers and streams, on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import porter, scalar
from quillgraph.operators import facts, ingest, link, resolve, retrieval
from quillgraph.sources import calendar, chat, mail, notes
from quillgraph.streaming import ingest as streaming


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_scalars(spark):
    assert one(spark, scalar.parse_due(F.col("s"), F.to_date(F.lit("2024-02-28"))), s="+2d").isoformat() == "2024-03-01"
    assert one(spark, scalar.parse_due(F.col("s"), F.to_date(F.lit("2024-02-28"))), s=" Tomorrow").isoformat() == "2024-02-29"
    assert one(spark, scalar.parse_due(F.col("s"), F.to_date(F.lit("2024-02-28"))), s="soon") is None
    assert one(spark, scalar.title_case_name(F.col("s")), s="ludwig van beethoven j") == "Ludwig van Beethoven J."
    assert one(spark, scalar.normalize_subject(F.col("s")), s=" Re: FWD: Plan") == "plan"
    assert one(spark, scalar.normalize_handle(F.col("s")), s="+1 (555) 010-22") == "+155501022"
    assert one(spark, scalar.apple_date_to_epoch(F.col("v")), v=700_000_000) == one(spark, scalar.apple_date_to_epoch(F.col("v")), v=700_000_000 * 10**9)
    assert one(spark, scalar.stem_predicate(F.col("s")), s="mentoring_studies") == "mentor_stud"
    n, npmi = scalar.parse_cooccurrence(F.lit("A and B co-occur (7 shared episodes, NPMI 0.41)"))
    row = spark.range(1).select(n.alias("n"), npmi.alias("x")).first()
    assert (row.n, row.x) == (7, 0.41)
    assert one(spark, scalar.backlinks(F.col("s")), s="see [[One]] and [[Two words]]") == ["One", "Two words"]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("controll", "control"), ("sky", "sky"), ("happy", "happi")])
def test_porter(word, want):
    assert porter.stem(word) == want


def test_assertion_corroborates(spark):
    columns = "fact_id string, subject_id string, predicate string, object_id string, object_value string, statement string, valid_from timestamp_ntz, valid_to timestamp_ntz, ingested_at timestamp_ntz, invalidated_at timestamp_ntz, confidence double, polarity string, sensitivity string, extractor string, observations int, episode_id bigint"
    fact = spark.createDataFrame([("f1", "a", "knows", "b", None, "s", None, None, None, None, 0.5, "positive", "public", "user", 1, 7)], columns)
    said = spark.sql("SELECT 'a' AS subject_id, 'knows' AS predicate, o AS object_id, p AS polarity, 's' AS statement, e AS episode_id, 0.9D AS confidence, t AS sensitivity, x AS extractor, TIMESTAMP_NTZ '2024-01-01' AS at FROM VALUES ('b', 'positive', 7L, 'private', 'user'), ('b', 'positive', 8L, 'public', 'user'), ('b', 'positive', 9L, 'public', 'agent:x'), ('b', 'negative', 8L, 'public', 'user'), ('c', 'positive', 8L, 'public', 'user') AS v(o, p, e, t, x)")
    got = {(r.object_id, r.polarity): r for r in facts.assert_facts(fact, said).collect()}
    assert got["b", "positive"].observations == 2 and got["b", "positive"].sensitivity == "private" and got["b", "positive"].fact_id == "f1"
    assert set(got) == {("b", "positive"), ("b", "negative"), ("c", "positive")}
    again = facts.assert_facts(facts.assert_facts(fact, said), said.where("false"))
    assert again.count() == 3
    closed = facts.close(fact, fact.select("fact_id"), "never_true", F.lit("2024-05-01").cast("timestamp_ntz")).first()
    assert closed.valid_to is not None and closed.invalidated_at is not None
    assert facts.close(fact, fact.select("fact_id"), "decay", F.lit("2024-05-01").cast("timestamp_ntz")).first().invalidated_at is None


def test_ladder_keeps_its_record(spark):
    h = "proposer string, predicate string, seq int, accepted boolean"
    rows = [("p", "x", k, True) for k in range(40)] + [("p", "y", k, k != 39) for k in range(40)] + [("p", "z", k, True) for k in range(9)] + [("p", "w", k, k % 2 == 0) for k in range(40)] + [("p", "v", 1, False)]
    got = {r.predicate: r.rung for r in facts.ladder(spark.createDataFrame(rows, h)).collect()}
    assert got == {"x": "trusted", "y": "trusted", "z": "sampled", "w": "staged", "v": "staged"}
    rows = [("p", "x", k, True) for k in range(40)] + [("p", "y", k, True) for k in range(40)]
    demoted = spark.createDataFrame([("p", "x", 38), ("p", "y", 39), ("p", "never", 1)], "proposer string, predicate string, seq int")
    got = {r.predicate: r.rung for r in facts.ladder(spark.createDataFrame(rows, h), demoted).collect()}
    assert got == {"x": "sampled", "y": "staged", "never": "staged"}  # one acceptance after it is one rung


def test_semantic_lane_is_sequential(spark):
    rows = [(1, "s", 0.9, [1.0, 0.0]), (2, "s", 0.8, [0.999, 0.01]), (3, "s", 0.7, [0.9, 0.5]), (4, "t", 0.7, [1.0, 0.0]), (5, "s", 0.6, [0.0, 1.0])]
    candidate = spark.createDataFrame(rows, "candidate_id bigint, subject string, confidence double, embedding array<double>")
    known = spark.createDataFrame([("t", [1.0, 0.0])], "subject string, embedding array<double>")
    got = {r.candidate_id: r.lane for r in facts.semantic_lane(candidate, known).collect()}
    assert got == {1: "kept", 2: "duplicate", 3: "similar", 4: "duplicate", 5: "kept"}


def test_persons_from_contacts(spark):
    contact = spark.createDataFrame([(1, "A@x.org", "Ann Roe"), (2, None, "Bob Low"), (3, "new@x.org", "Cy"), (4, "new@x.org", "Cy Ng"), (5, None, "")], "contact_id int, email string, display_name string")
    identifier = spark.createDataFrame([("n1", "email", "a@x.org")], "node_id string, kind string, value string")
    nodes = spark.createDataFrame([("n1", "person", "Ann"), ("n2", "person", "Bob Low")], "node_id string, node_type string, name string")
    linked, new = resolve.persons_from_contacts(contact, identifier, nodes)
    got = {r.contact_id: r.node_id for r in linked.collect()}
    assert got[1] == "n1" and got[2] == "n2" and got[3] == got[4] and 5 not in got
    assert [(r.node_type, r.name) for r in new.collect()] == [("person", "Cy Ng")]
    alias = spark.createDataFrame([("n1", "ann roe"), ("n2", "annroe low")], "node_id string, alias string")
    mail_ = spark.createDataFrame([("n2", "email", "annroe@x.org")], "node_id string, kind string, value string")
    assert [tuple(r) for r in resolve.email_duplicates(nodes, alias, mail_).collect()] == [("n1", "n2")]
    named = spark.createDataFrame([("m", "person", "ann@x.org", 0)], "node_id string, node_type string, name string, access_count int")
    assert resolve.promoted_names(named, spark.createDataFrame([("m", "ann roe"), ("m", "ann")], "node_id string, alias string")).first().name == "Ann Roe"


def test_scope_chain_stops_at_cycles(spark):
    parent = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node_id string, parent_id string")
    assert {r.node_id: r.level for r in link.scope_chain(parent, "a").collect()} == {"a": 0, "b": 1, "c": 2}


def test_budget_counts_what_does_not_fit(spark):
    items = spark.createDataFrame([("q", 1, 3.0, "x" * 40), ("q", 2, 2.0, "y" * 400), ("q", 3, 1.0, "z" * 40), ("q", 4, 0.5, "x" * 40)], "query_id string, push_order int, score double, text string")
    assert [r.push_order for r in retrieval.pack(items, 50).collect()] == [1]
    assert sorted(r.push_order for r in retrieval.pack(items, 1000).collect()) == [1, 2, 3]


def test_upsert_is_idempotent_and_undo_restores(spark):
    rows = spark.createDataFrame([(1, "email", "m1", "hello", "2024-01-01"), (2, "email", "m2", "bye", "2024-01-02")], "episode_id bigint, source string, source_id string, body string, occurred_at string")
    rows = rows.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    none = rows.where("false").withColumn("content_hash", F.lit(""))
    dead = rows.where("source_id = 'm2'")
    once = ingest.apply_upsert(none, ingest.upsert_outcomes(none, rows.union(rows), dead))
    assert [r.source_id for r in once.collect()] == ["m1"]
    assert {r.outcome for r in ingest.upsert_outcomes(once, rows, dead).collect()} == {"unchanged", "tombstoned"}
    tables = {"episode": rows, "mention": rows.select("episode_id", F.lit("n").alias("node_id"))}
    left, tombstone, snapshot = ingest.redact(tables, 1)
    assert [left[t].count() for t in tables] == [1, 1] and tombstone.first().source_id == "m1"
    back = ingest.undo(left, snapshot)
    assert sorted(map(tuple, back["episode"].collect())) == sorted(map(tuple, rows.collect())) and back["mention"].count() == 2
    with pytest.raises(ValueError):
        ingest.set_sensitivity(rows, rows, "hidden")


def test_mailbox(spark, tmp_path):
    (tmp_path / "m.mbox").write_text(
        "From x\nMessage-ID: <1>\nFrom: Ann <ann@x.org>\nTo: me@x.org\nSubject: Plan\nDate: Mon, 01 Jan 2024 10:00:00 +0100\n\nFirst line\n\n"
        "From y\nMessage-ID: <2>\nReferences: <1>\nFrom: me@x.org\nTo: Ann <ann@x.org>, Bo <bo@x.org>\nSubject: Re: Plan\nDate: Mon, 01 Jan 2024 12:00:00 +0000\n\nSecond\n> First line\n\n"
        "From z\nMessage-ID: <3>\nList-Id: news\nFrom: news@x.org\nSubject: Offer\nDate: Mon, 01 Jan 2024 12:00:00 +0000\n\nBuy\n"
    )
    got = mail.Mbox(str(tmp_path / "m.mbox"), "me@x.org").fetch(spark).collect()
    assert len(got) == 1 and got[0].source_id == "<1>" and got[0].body == "Plan\n\nFirst line\n\nSecond"
    assert str(got[0].occurred_at) == "2024-01-01 09:00:00" and sorted(p.email for p in got[0].people) == ["ann@x.org", "bo@x.org"]


def test_calendar(spark, tmp_path):
    (tmp_path / "c.ics").write_text(
        "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:u1\nDTSTART:20240102T090000Z\nDTEND:20240102T100000Z\nSUMMARY:Stand\n up\\, daily\nATTENDEE;CN=\"Roe; Ann\":mailto:Ann@x.org\nRRULE:FREQ=DAILY\nEND:VEVENT\n"
        "BEGIN:VEVENT\nUID:u2\nDTSTART;VALUE=DATE:20240105\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:no id\nEND:VEVENT\nEND:VCALENDAR\n"
    )
    got = sorted(calendar.Ics(str(tmp_path / "c.ics")).fetch(spark).collect(), key=lambda r: r.source_id)
    assert [r.source_id for r in got] == ["u1", "u2"]
    assert got[0].body == "Standup, daily\nWith: Roe; Ann" and str(got[0].occurred_end) == "2024-01-02 10:00:00"
    assert str(got[1].occurred_at) == "2024-01-05 00:00:00"


def test_chats_events_sessions_notes(spark, tmp_path):
    message = spark.createDataFrame([(1, 726_000_000, 0, 5, "hi"), (2, 726_000_060, 1, 5, "yo"), (3, 726_000_070, 1, 5, " ")], "id int, date bigint, is_from_me int, handle_id int, text string")
    got = chat.messages_by_day(message, spark.createDataFrame([(9, "Ann")], "chat_id int, name string"), spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "chat_id int, message_id int"), spark.createDataFrame([(5, "+1 555")], "handle_id int, value string")).collect()
    assert len(got) == 1 and got[0].body == "+1555: hi\nme: yo" and got[0].sensitivity == "private"
    events = [{"type": "PushEvent", "created_at": "2024-01-01T10:00:00Z", "repo": {"name": "a/b"}, "payload": {"size": 1, "commits": [{"message": "Fix\nmore"}]}}, {"type": "WatchEvent", "created_at": "2024-01-01T11:00:00Z", "repo": {"name": "a/b"}, "payload": {}}, {"type": "PullRequestEvent", "created_at": "2024-01-01T12:00:00Z", "repo": {"name": "a/b"}, "payload": {"action": "closed", "pull_request": {"title": "T", "number": 3, "merged": True}}}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, events)))
    got = chat.RepositoryEvents(str(tmp_path / "e.json")).fetch(spark).collect()
    assert [r.body for r in got] == ["pushed 1 commits: Fix\nmerged pull request #3 T"]
    lines = [{"type": "user", "timestamp": "2024-01-01T10:00:00Z", "cwd": "/h/Github/proj/sub", "message": {"role": "user", "content": "<cmd>"}}, {"type": "user", "timestamp": "2024-01-01T10:01:00Z", "cwd": "/h/Github/proj", "message": {"role": "user", "content": "Do it"}}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = chat.AgentSessions(str(tmp_path / "s.jsonl")).fetch(spark).collect()
    assert got[0].body == "Do it" and json.loads(got[0].meta)["projects"] == ["proj"]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "2024-01-03.md").write_text("met [[Ann Roe]]")
    (tmp_path / "n" / "x.md").write_text("# Big Plan\n- Status: open\n- Status: done\n")
    got = sorted(notes.Notes(str(tmp_path / "n")).fetch(spark).collect(), key=lambda r: r.source_id)
    assert [(r.source, r.source_id) for r in got] == [("notes.daily", "2024-01-03"), ("notes.page", "big-plan")]
    assert one(spark, notes.attributes(F.col("s")), s="- Status: open\n- Status: done\n- Who: me") == {"status": "done", "who": "me"}
    (tmp_path / "b.md").write_text("# Conversation 12\n- start_time: 2024-01-01 10:00:00\n\n## Summary\nTalked.\n\n### Key Takeaways\n- one\n- two\n")
    got = notes.Conversations(str(tmp_path / "b.md")).fetch(spark).first()
    assert got.source_id == "12" and got.body == "Talked." and json.loads(got.meta)["takeaways"] == ["one", "two"]
    (tmp_path / "g.jsonl").write_text('# comment\n{"query": "q", "job": "memory", "expect_contains": "x"}\n')
    assert notes.gold_set(spark, str(tmp_path / "g.jsonl")).first().job == "memory"


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT 'email' AS source, concat('m', id % 3) AS source_id, concat('b', id % 3) AS body, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS occurred_at FROM range(6)")
    rows = rows.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.landing(spark, str(tmp_path / "in"), rows.schema)
    held = {"table": rows.where("false").withColumn("content_hash", F.lit(""))}

    def write(df):
        df.write.mode("overwrite").parquet(str(tmp_path / "out"))
        held["table"] = spark.read.parquet(str(tmp_path / "out"))

    q = streaming.upserting(stream, lambda: held["table"], write, rows.where("false"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r.source_id for r in held["table"].collect()) == ["m0", "m1", "m2"]
    q = streaming.deduplicated(stream).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 3
    q = streaming.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.table("daily").collect()] == [6]


def test_names_of_many_words(spark):
    long, near = "The Royal Society for the Protection of Birds", "the royal society for the protection of bees"
    names = spark.createDataFrame([(long, "n1", "org"), ("royal society", "n2", "org"), ("one two three four five", "n3", "org")], "name string, node_id string, node_type string")
    texts = [(1, f"yes, {long}!"), (2, near), (3, "One, two three four. Five"), (4, "one two three four fives"), (5, f"{near} and {long}")]
    episode = spark.createDataFrame(texts, "episode_id long, body string")
    for longest in (1, 4, 9):
        got = {(r.episode_id, r.node_id) for r in link.alias_scan(episode, names.drop("node_type"), longest).collect()}
        assert got == {(1, "n1"), (1, "n2"), (2, "n2"), (3, "n3"), (5, "n1"), (5, "n2")}
    queries = spark.createDataFrame([(1, f"who met {long} today?"), (2, f"who met {near}?")], "query_id long, text string")
    assert sorted((r.query_id, r.node_id, r.ambiguous) for r in retrieval.detect_entities(queries, names).collect()) == [(1, "n1", False), (2, "n2", False)]
