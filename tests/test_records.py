"""Nested records of personas and journeys, and the two rounds of calls behind them."""

import json

import pytest
from pyspark.sql import functions as F

from voxfield.operators import records as R

_PACK = "owner string, doc string, text string, url string, source string, lang string"
RUN = {"run_id": "r1", "model": "m", "provider": "p"}


@pytest.fixture(scope="module")
def made(spark):
    pack = spark.createDataFrame([("a", "d1", "It is slow and BAD.", "u1", "s1", "fr"), ("a", "d2", "Good, fast, but it may crash.", "u2", "s2", None), ("a", "d3", None, None, None, None), ("b", "d4", "t", "", "", "")], _PACK)
    return pack, spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "owner string, size int")


def said(spark, **by_owner):
    return spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in by_owner.items()], "owner string, reply string")


def test_persona_records(spark, made):
    pack, sizes = made
    reply = {
        "name": " Ann ", "demographics": {"age": "20-30"},
        "goals": [{"claim": " speed ", "evidence": ["d1", "d2", "d2"], "severity": "high"}, {"claim": "x", "evidence": ["d1", "d9"]}, {"claim": "calm", "evidence": ["d3"]}],
        "pain_points": ["no object", {"claim": "y"}], "motivations": "no list", "behaviors": [],
        "representative_quotes": [{"doc_id": "d1", "text_original": " slow ", "text_translated": "lent"}, {"doc_id": "d1", "text_original": "quick"}, {"doc_id": "d9", "text_original": "slow"}, "none", {"doc_id": "d2", "text_original": "Good", "lang": "de", "url": "v"}],
    }
    rows = {r.cluster_id: r for r in R.persona_records(said(spark, a=reply, b="no object here", c=None), pack, sizes, RUN).collect()}
    a = rows["a"]
    assert (a.name, a.one_liner, a.language, json.loads(a.demographics), a.confidence, a.cluster_size, a.run_id) == ("Ann", "", "en", {"age": "20-30"}, 0.8, 3, "r1")
    assert [(c.claim, c.severity, c.mentioned_by_n_users, c.pct_of_cluster, c.sentiment_scores) for c in a.goals.claims] == [("speed", "high", 2, 0.667, {"negative": 1, "neutral": 0, "positive": 2}), ("calm", None, 1, 0.333, {"negative": 0, "neutral": 1, "positive": 0})]
    assert (a.goals.coverage, a.pain_points.coverage, a.pain_points.claims, a.motivations.coverage) == ("unverified", "unverified", [], "ok")
    assert [tuple(q) for q in a.representative_quotes] == [("slow", "lent", "fr", "s1", "u1", "d1"), ("Good", None, "de", "s2", "v", "d2")]
    for k in "bc":
        assert (rows[k].name, rows[k].goals.claims, rows[k].goals.coverage, rows[k].representative_quotes, rows[k].confidence) == (f"Persona {k}", [], "ok", [], 1.0)
    assert R.persona_records(said(spark, a=reply).limit(0), pack, sizes, RUN).count() == 0


def test_what_is_contested(spark, made):
    pack, sizes = made
    against = spark.createDataFrame([("a", "goals", "x", "d2"), ("a", "goals", "x", "d1"), ("a", "goals", "z", "d1")], "owner string, field string, claim string, doc string")
    reply = {"goals": [{"claim": "x", "evidence": ["d1"]}, {"claim": "x", "evidence": ["d2"]}]}
    row = R.persona_records(said(spark, a=reply), pack, sizes, RUN, contested=against).first()
    assert [c.contested_by for c in row.goals.claims] == [["d1", "d2"], []]


def test_journey_records(spark, made):
    pack, sizes = made
    use = {"stage": "Use", "frictions": [{"claim": "f", "evidence": ["d1"]}, {"claim": "g", "evidence": ["d7"]}], "emotions": [{"label": "joy", "intensity": 0.5, "evidence": ["d2"]}, {"label": "far", "intensity": 7, "evidence": ["d3"]}, {"label": "none", "evidence": ["d1"]}]}
    reply = {"stages": [{"stage": "Awareness", "touchpoints": [{"claim": "old", "evidence": ["d1"]}]}, use, {"stage": "Awareness", "touchpoints": [{"claim": "new", "evidence": ["d1"]}]}, {"stage": "Unknown"}, 3]}
    replies = said(spark, a=reply, b="{}")
    people = R.persona_records(replies, pack, sizes, RUN)
    rows = {r.persona_id: r for r in R.journey_records(replies, people, pack, sizes, RUN).collect()}
    ids = {r.cluster_id: r.id for r in people.collect()}
    a = {s.stage: s for s in rows[ids["a"]].stages}
    assert [s.stage for s in rows[ids["a"]].stages] == R.STAGES
    assert [s.coverage for s in rows[ids["a"]].stages] == ["thin", "none", "none", "none", "ok", "none"]
    assert [c.claim for c in a["Awareness"].touchpoints.claims] == ["new"]
    assert ([c.claim for c in a["Use"].frictions.claims], a["Use"].frictions.coverage, a["Use"].touchpoints.coverage) == (["f"], "unverified", "ok")
    assert [tuple(e) for e in a["Use"].emotions] == [("joy", 0.5, ["d2"]), ("none", 0.0, ["d1"])]
    assert {s.coverage for s in rows[ids["b"]].stages} == {"none"}


def test_two_rounds(spark, made):
    pack, sizes = made
    prompts = spark.createDataFrame([("a", "ask a"), ("b", "ask b"), ("c", "ask c")], "owner string, prompt string")

    def client():
        good = {"goals": [{"claim": "g", "evidence": ["d1"]}], "representative_quotes": [{"doc_id": d, "text_original": t} for d, t in (("d1", "slow"), ("d2", "Good"), ("d2", "fast"))]}

        def ask(prompt):
            if prompt.endswith("ask b"):
                raise RuntimeError("down")
            if prompt.endswith("ask c"):
                return "{}" if prompt.startswith("Fix") else "nothing"
            if prompt.startswith("Fix"):
                assert "1. goals[0] cites unknown doc_id 'd9'" in prompt
                return json.dumps(good)
            return json.dumps(good | {"goals": [{"claim": "g", "evidence": ["d9"]}]})

        return ask

    people, replies = R.generated_personas(prompts, pack, sizes, client, RUN)
    assert {r.owner: (r.attempts, r.failure) for r in replies.collect()} == {"a": (2, None), "b": (2, "call failed: down"), "c": (2, None)}
    rows = {r.cluster_id: r for r in people.collect()}
    assert (len(rows["a"].goals.claims), rows["a"].confidence, len(rows["a"].representative_quotes)) == (1, 1.0, 3)
    assert rows["b"].goals.claims == [] and len(rows) == 3
    seen = []
    journeys, _ = R.generated_journeys(people.where("cluster_id = 'a'"), prompts, pack, sizes, lambda: lambda p: json.dumps({"stages": [{"stage": "Use", "frictions": [{"claim": p.split("Persona: ")[1], "evidence": ["d1"]}]}]}), RUN)
    seen = [s.frictions.claims[0].claim for s in journeys.first().stages if s.frictions.claims]
    assert seen == ["Persona a."] and journeys.select(F.size("stages")).first()[0] == 6
