import datetime as dt

import pytest

from quillgraph import schema
from quillgraph.plans import router

NOW = dt.datetime(2024, 3, 13, 15, 0)


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("what happened yesterday", "2024-03-12", "2024-03-13"), ("notes from last week", "2024-03-06", None), ("mail of last month", "2024-02-11", None), ("walks during june", "2023-06-01", "2023-07-01"), ("in june of 2019", "2019-06-01", "2019-07-01"), ("what was 2021 like", "2021-01-01", "2022-01-01"), ("mail in the last 3 days", "2024-03-10", "2024-03-14"),
        ("since 2024-01-02 anything", "2024-01-02", None), ("on 2024-02-29", "2024-02-29", "2024-03-01"), ("trips in december", "2023-12-01", "2024-01-01"), ("no time at all", None, None),
    ],
)
def test_time(text, start, end):
    _, a, b = router.extract_time(text, NOW)
    assert [x and x.date().isoformat() for x in (a, b)] == [start, end]


@pytest.mark.parametrize("text, intent", [("when did I last email Ann", ("lookup", "email")), ("who do I talk to most often", ("people", None)), ("how long since I saw Ann", ("lookup", "meeting")), ("which projects are stalled", ("projects", None)), ("messages per week", ("count", None)), ("what do we talk about", ("recall", None)), ("how many meetings", ("count", None)), ("plans for the garden", ("recall", None))])
def test_intent(text, intent):
    assert router.classify(text) == intent


def test_tags():
    assert router.extract_tags("#work notes on #garden", {"work"}) == ("notes on garden", ("work",))


@pytest.fixture(scope="module")
def store(spark):
    def t(s):
        return dt.datetime.fromisoformat(s)

    episode = spark.createDataFrame(
        [(1, "email", "m1", "the garden plan needs roses", t("2024-03-12 10:00:00"), None, "public", None, None), (2, "slack", "s1", "lunch", t("2024-03-01 10:00:00"), None, "public", None, None), (3, "email", "m2", "secret garden", t("2024-03-12 11:00:00"), None, "secret", None, None), (4, "email", "m3", "boats", t("2024-01-01 11:00:00"), None, "public", None, None)],
        schema.EPISODE,
    )
    nodes = spark.createDataFrame([("a", "person", "Ann Roe", 0), ("b", "person", "Sam", 0), ("c", "person", "Sam", 0)], schema.NODE)
    mention = spark.createDataFrame([(1, "a", "x", 1.0), (2, "a", "x", 1.0), (4, "b", "x", 1.0)], schema.MENTION)
    fact = spark.createDataFrame([("f1", "a", "knows", "b", None, "Ann likes the garden", t("2024-01-01 00:00:00"), None, None, None, 0.9, "positive", "public", "user", 1, 1)], schema.FACT)
    names = nodes.selectExpr("name", "node_id", "node_type")
    return router.Store(episode, nodes, mention, fact, names)


def test_ask(spark, store):
    q, items = router.ask(spark, store, "garden roses", NOW)
    got = items.collect()
    assert q.intent == "recall" and [(r.kind, r.id) for r in got] == [("fact", "f1"), ("episode", "1")]
    assert [(r.kind, r.id) for r in router.ask(spark, store, "garden roses", NOW, lens=router.Lens(scope="evidence"))[1].collect()] == [("episode", "1")]
    assert router.ask(spark, store, "boats with sam", NOW)[0].intent == "ambiguous"
    assert router.ask(spark, store, "when did I last email ann roe", NOW)[1].collect()[0].text == "Ann Roe: last email: 2024-03-12 10:00:00 (2 interactions, last channel email)"
    assert {r.id: r.score for r in router.ask(spark, store, "how many things with ann roe", NOW)[1].collect()} == {"email": 1.0, "slack": 1.0}
    assert router.ask(spark, store, "who do I talk to most often", NOW)[1].collect()[0].id == "a"
    fallback = router.ask(spark, store, "zzz ann roe", NOW, lens=router.Lens(scope="evidence"))[1].collect()
    assert [r.id for r in fallback] == ["1", "2"] and fallback[0].score == 0.01
    assert [r.fact_id for r in router.ask_as_of(store, spark, "ann roe", NOW).collect()] == ["f1"]


def test_empty_graph(spark):
    g = schema.empty_graph(spark)
    assert schema.violations(g["nodes"], g["observation"]).count() == 0
    assert router.ask(spark, router.Store(g["episode"], g["nodes"], g["mention"], g["fact"], g["nodes"].selectExpr("name", "node_id", "node_type")), "anything", NOW)[1].count() == 0
