import datetime as dt

from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.operators import enrich, facts, triage
from quillgraph.plans import nightly

T = dt.datetime(2024, 1, 1)
COLUMNS = "candidate_id bigint, proposer string, predicate string, subject string, object_id string, statement string, confidence double, status string, kind string, episode_id bigint, created_at timestamp_ntz"


def candidates(spark):
    rows = [
        (1, "p", "knows", "Ann", "b", "owes a call", 0.5, "proposed", "commitment", 1, T),
        (2, "p", "knows", "Ann", "z", "Was Refused!", 0.5, "proposed", "fact", 1, T),
        (20, "p", "knows", "Ann", "z", "was refused", 0.5, "rejected", "fact", 1, T),
        (12, "p", "mentors", "Ann", "k", "ann mentors k", 0.8, "proposed", "fact", 1, T),
        (13, "llm", "uses", "Ann", "tool", "ann uses a tool", 0.8, "proposed", "fact", 1, T),
        (3, "p", "discussed", "Ann", None, "the budget", 0.5, "proposed", "fact", 1, T),
        (4, "p", "has_role", "Ann", None, "Ann was in a silly mood", 0.5, "proposed", "fact", 1, T),
        (5, "p", "knows", "ann ", "b", "they know each other", 0.5, "proposed", "fact", 1, T),
        (6, "p", "knows", "Ann", "c", "ann knows c", 0.9, "proposed", "fact", 1, T),
        (7, "p", "knows", "Ann", "c", "Ann knows C", 0.8, "proposed", "fact", 1, T),
        (8, "p", "knows", "Nobody", "c", "x y", 0.8, "proposed", "fact", 1, T),
        (9, "p", "works_at", "Ann", "o2", "ann works at o2", 0.8, "proposed", "fact", 1, T),
        (10, "s", "likes", "Ann", "d", "held back", 0.8, "proposed", "fact", 1, T),
        (11, "s", "likes", "Ann", "e", "let through", 0.8, "proposed", "fact", 1, T),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_lanes(spark):
    def live(i, p, o, s):
        return (i, "a", p, o, None, s, T, None, T, None, 0.5, "positive", "public", "user", 1, 1)

    fact = spark.createDataFrame([live("f1", "knows", "b", "old"), live("f2", "works_at", "o1", "at o1")], schema.FACT)
    resolved = spark.createDataFrame([("Ann", "a")], "subject string, node_id string")
    rungs = spark.createDataFrame([("p", "knows", "trusted"), ("s", "likes", "sampled"), ("p", "mentors", "trusted")], "proposer string, predicate string, rung string")
    supported = spark.createDataFrame([(13,), (12,)], "candidate_id bigint")
    lanes = triage.precheck(candidates(spark), fact, resolved, rungs, supported)
    got = {r.candidate_id: (r.lane, r.fact_id) for r in lanes.collect()}
    assert {k: v[0] for k, v in got.items()} == {
        1: "commitment", 2: "rejected_before", 3: "ephemeral", 4: "eventive", 5: "known", 6: "accept", 7: "queued_twice", 8: "unresolved", 9: "contradiction", 10: "review", 11: "accept", 12: "review", 13: "accept",
    }
    assert got[5][1] == "f1"
    status = {r.candidate_id: r.status for r in triage.settle(candidates(spark), lanes).collect()}
    assert status[6] == "accepted" and status[7] == "rejected" and status[9] == "proposed" and status[20] == "rejected"
    new = facts.assert_facts(fact, triage.accepted_claims(candidates(spark), lanes, resolved))
    assert {r.object_id for r in new.collect()} == {"b", "o1", "c", "e", "tool"}
    verdict = spark.createDataFrame([(6, "m", "accept", "", None), (7, "m", "accept", "", None), (9, "m", "accept", "", None)], schema.VERDICT)
    assert {r.candidate_id: r.outcome for r in triage.score_verdicts(verdict, triage.settle(candidates(spark), lanes)).collect()} == {6: "right", 7: "wrong", 9: None}


def test_a_twin_survives_the_next_pass(spark):
    fact = spark.createDataFrame([], schema.FACT)
    resolved = spark.createDataFrame([("Ann", "a")], "subject string, node_id string")
    rungs = spark.createDataFrame([], "proposer string, predicate string, rung string")
    rows = [(1, "p", "knows", "Ann", "c", "ann knows c", 0.9, "proposed", "fact", 1, T), (2, "p", "knows", "Ann", "c", "Ann knows C!", 0.8, "proposed", "fact", 1, T), (3, "p", "knows", "Who?", None, "x y", 0.8, "proposed", "fact", 1, T), (4, "p", "knows", " who? ", None, "X y", 0.7, "proposed", "fact", 1, T)]
    pending = spark.createDataFrame(rows, COLUMNS)
    for _ in range(3):  # as often as it runs, the first of each stays
        lanes = triage.precheck(pending, fact, resolved, rungs)
        got = {r.candidate_id: r.lane for r in lanes.collect()}
        assert got[1] == "review" and got[3] == "unresolved" and set(got) - {1, 3} <= {2, 4} and {got.get(2), got.get(4)} <= {"queued_twice", None}
        pending = triage.settle(pending, lanes)
    assert {r.candidate_id: r.reject_reason for r in pending.collect()} == {1: None, 2: "precheck: queued_twice", 3: None, 4: "precheck: queued_twice"}
    refused = triage.reject(pending, spark.createDataFrame([(1,)], "candidate_id bigint"), "no")
    again = refused.union(spark.createDataFrame([(9, "p", "knows", "Ann", "c", "ANN knows c", 0.9, "proposed", "fact", 1, T, None)], refused.schema))
    assert {r.candidate_id: r.lane for r in triage.precheck(again, fact, resolved, rungs).collect()} == {9: "rejected_before", 3: "unresolved"}


def test_corrections(spark):
    def fact(i, statement, closed=None, extractor="llm", subject="a"):
        return (i, subject, "lives_in", "b", None, statement, T, closed, T, closed, 0.5, "positive", "public", extractor, 1, 1)

    rows = [fact("f1", "Ann lives in Rome"), fact("f2", "Old news", T), fact("f3", "twice"), fact("f4", "Twice", subject="c"), fact("f5", "peer"), fact("f6", "other class", extractor="user"), fact("f7", "by id")]
    table = spark.createDataFrame(rows, schema.FACT)
    meta = (
        '{"corrections": [{"wrong": " ann LIVES in rome", "right": "Ann lives in Oslo"}, {"fact_uid": "f7"}, {"wrong": "in Paris", "about": "Bo"}, {"wrong": "old news"}, {"fact_uid": "f2"}, {"fact_uid": "f99"},'
        ' {"wrong": "twice"}, {"wrong": "twice", "about": "Cy", "right": "once"}]}'
    )
    episode = spark.createDataFrame([(1, meta), (2, None)], "episode_id bigint, meta string")
    about = spark.createDataFrame([("cy", "c")], "about string, node_id string")
    targets = triage.correction_targets(facts.corrections(episode), table, about)
    got = sorted((r.target, r.fact_id or "", r.wrong or r.fact_uid) for r in targets.collect())
    assert got == [("closed", "", "f2"), ("closed", "", "old news"), ("live", "f1", " ann LIVES in rome"), ("live", "f4", "twice"), ("live", "f7", "f7"), ("unresolved", "", "f99"), ("unresolved", "", "in Paris"), ("unresolved", "", "twice")]
    out = {k: v.collect() for k, v in triage.apply_corrections(targets, table, F.lit("2024-02-01").cast("timestamp_ntz")).items()}
    by = {r.fact_id: r for r in out["fact"]}
    assert all(by[k].valid_to and by[k].invalidated_at for k in ("f1", "f4", "f7")) and by["f3"].valid_to is None
    (negation,) = [r for r in out["fact"] if r.polarity == "negative"]
    assert negation.statement == "It is not the case that: by id" and negation.confidence == 0.95 and negation.object_id == "b"
    assert sorted(r.fact_id for r in out["observation"]) == ["f1", "f4", "f7"] and {r.kind for r in out["observation"]} == {"corrected"}
    assert sorted(r.statement for r in out["candidate"])[:2] == ["Ann lives in Oslo", "UNRESOLVED CORRECTION: wrong: f99 | right: (rejection) | about: ?"] and len(out["candidate"]) == 5
    assert [(r.proposer, r.predicate) for r in out["demotion"]] == [("llm", "lives_in")]
    assert sorted(r.fact_id for r in out["sweep"]) == ["f3", "f5"]


def test_claims_with_literals(spark):
    """Literals keep facts apart, a missing one fits any, and every sighting is observed."""
    t = [dt.datetime(2024, 1, k) for k in range(1, 9)]

    def claim(o, v, episode, at, extractor="llm", polarity="positive"):
        return ("a", "born", o, v, polarity, f"born {v}", episode, 0.6, extractor, at)

    columns = "subject_id string, predicate string, object_id string, object_value string, polarity string, statement string, episode_id bigint, confidence double, extractor string, at timestamp_ntz"
    episode = spark.createDataFrame([(1, "email", "public"), (2, "email", "private"), (3, "probe:x", "public"), (4, "agent:y", "secret")], "episode_id bigint, source string, sensitivity string")
    none = spark.createDataFrame([], schema.FACT)
    first = spark.createDataFrame([claim(None, "1990", 1, t[0]), claim(None, "1991", None, t[1]), claim(None, "1990", 1, t[2]), claim(None, "1990", 2, t[3]), claim(None, "1990", 3, t[4]), claim("x", None, 4, t[5])], columns)
    fact = facts.assert_facts(none, first, episode)
    got = {(r.object_id, r.object_value): (r.observations, r.sensitivity, r.episode_id) for r in fact.collect()}
    assert got == {(None, "1990"): (2, "private", 1), (None, "1991"): (1, "personal", None), ("x", None): (1, "secret", 4)}
    seen = facts.observations_of(none, first, episode)
    assert sorted((r.kind, r.episode_id or 0) for r in seen.collect()) == [("asserted", 0), ("asserted", 1), ("asserted", 4), ("corroborated", 1), ("corroborated", 2), ("corroborated", 3)]
    more = spark.createDataFrame([claim(None, "1991", None, t[6]), claim(None, "1991", None, t[7]), claim(None, None, 2, t[6]), claim("x", "late", 1, t[6]), claim(None, "1990", 5, t[7], polarity="negative")], columns)
    after = facts.assert_facts(fact, more, episode, seen)
    got = {(r.object_id, r.object_value, r.polarity): r.observations for r in after.collect()}
    # the claim without a literal joins the batch's least one, 1991, which episode 2 hadn't said yet
    assert got == {(None, "1990", "positive"): 2, (None, "1991", "positive"): 4, ("x", None, "positive"): 2, (None, "1990", "negative"): 1}
    assert facts.assert_facts(none, first.where("false"), episode).count() == 0


def test_models_are_injected(spark):
    episode = spark.createDataFrame([(1, "a b", T), (2, "bad", T), (3, "c", T)], "episode_id bigint, body string, occurred_at timestamp_ntz")
    done = spark.createDataFrame([(3, "v1")], "episode_id bigint, version string")

    def model(texts):
        if texts[0] == "bad":
            raise RuntimeError("poison")
        return [[{"kind": "fact", "subject": w, "predicate": "is", "statement": w, "confidence": 0.5} for w in texts[0].split()]]

    got = sorted((r.episode_id, r.subject or "", r.error or "") for r in enrich.extract(episode, done, "v1", model, 10).collect())
    assert got == [(1, "a", ""), (1, "b", ""), (2, "", "poison")]
    base = enrich.hash_embedder(61)

    def picky(texts):
        if len(texts) > 1:
            raise ValueError("too long")
        return base(texts)

    vectors = enrich.embed_pending(episode, done, "episode_id", "body", picky).collect()
    assert {r.episode_id for r in vectors} == {1, 2} and all(r.error is None and abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in vectors)


def test_nightly_on_an_empty_graph(spark):
    g = schema.empty_graph(spark)
    half = spark.createDataFrame([("knows", 0.1)], "predicate string, decay double")
    out = nightly.nightly(g, F.lit("2024-01-01").cast("timestamp_ntz"), half)
    assert all(df.count() == 0 for df in out.values())
