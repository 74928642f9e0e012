"""Requests, replies, truncation, budgets, headings, blank prose, user extractor
(fixtures A13-A16, A20-A23)."""

import json

import pandas as pd
from pyspark.sql import functions as F

from cribra.functions.text import token_budget
from cribra.operators import extract as E
from cribra.operators.rules import rule_criteria

CRIT_JSON = json.dumps({"criteria": [
    {"criterion_id": "inc-1", "text": "Stage IV non-small cell lung cancer.", "kind": "condition",
     "is_exclusion": False},
    {"criterion_id": "exc-1", "text": "Untreated CNS metastases.", "kind": "comorbidity",
     "is_exclusion": True}]})


def env(content, finish="stop"):
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": content},
                                    "finish_reason": finish}]})


def parse(spark, envelopes):
    df = spark.createDataFrame([(i, e) for i, e in enumerate(envelopes)], "i int, envelope string")
    return {r.i: r for r in E.parse_replies(df, keep=("i",)).collect()}


def test_reply_shapes(spark):
    got = parse(spark, [
        env(CRIT_JSON),                                                          # A13
        env([{"type": "reasoning", "summary": "..."}, {"type": "text", "text": CRIT_JSON}]),  # A14
        env(42),                                                                 # A15
        env([{"type": "reasoning", "summary": "..."}]),                          # A15
        env("{", finish="length"),                                               # A16
        json.dumps({"nope": True}),                                              # A23
        env(json.dumps({"criteria": [{"bogus": 1}]})),                           # A23
        env(json.dumps({"criteria": [{"criterion_id": "a", "text": "t", "kind": "weird",
                                      "is_exclusion": False}]})),
        env(json.dumps({"criteria": [], "extra": 1})),
    ])
    assert [got[i].outcome for i in range(9)] == [
        "ok", "ok", "text_error", "text_error", "truncated", "envelope_error", "schema_error",
        "schema_error", "ok"]
    assert [c.kind for c in got[0].criteria] == ["condition", "comorbidity"]
    assert got[1].criteria[1].is_exclusion is True
    assert got[8].criteria == []
    assert got[2].error == E.ERR_NO_TEXT and got[5].error == E.ERR_ENVELOPE


def test_reply_text_joins_text_parts(spark):
    df = spark.createDataFrame([(env([{"type": "text", "text": "ab"}, {"type": "reasoning"},
                                      {"type": "text", "text": "cd"}]),)], "e string")
    r = df.select(E.reply_text(F.col("e")).alias("r")).first().r
    assert (r.text, r.error) == ("abcd", None)


def test_token_budget_bounds(spark):
    # A20: 100 chars -> 1000, 20,000 -> more, 10,000,000 -> 8000
    df = spark.createDataFrame([(100,), (20_000,), (10_000_000,)], "n int")
    got = [r.b for r in df.select(token_budget(F.expr("repeat('x', n)")).alias("b")).collect()]
    assert got[0] == 1000 and 1000 < got[1] <= 8000 and got[2] == 8000


def test_truncation_retry_doubles_once_up_to_ceiling(spark):
    df = spark.createDataFrame([(1000,), (5000,), (8000,)], "max_tokens long")
    got = {r.max_tokens: r.retry_tokens for r in E.truncation_retries(df).collect()}
    assert got == {1000: 2000, 5000: 8000}


def test_requests_carry_prompt_budget_and_schema(spark):
    df = spark.createDataFrame([("NCT00000001", "x" * 100)], "nct_id string, eligibility string")
    r = E.build_requests(df).first()
    body = json.loads(r.request)
    assert r.max_tokens == 1000 and body["max_tokens"] == 1000 and body["temperature"] == 0
    assert body["messages"][0]["role"] == "system" and body["messages"][1]["content"] == "x" * 100
    assert body["response_format"]["json_schema"]["strict"] is True


def test_inline_headings_and_blank_prose(spark):
    # A21: both headings on one line; A22: blank prose gives no criteria
    df = spark.createDataFrame([
        ("NCT00000001", "INCLUSION: thyroid nodule. EXCLUSION: recent stroke."),
        ("NCT00000002", "   "),
        ("NCT00000003", "Inclusion Criteria:\n- Age 18 years or older\n- ECOG 0-1\n\n"
                        "Exclusion Criteria:\n* Pregnant or breastfeeding\n* Active hepatitis B"),
    ], "nct_id string, eligibility string")
    rows = rule_criteria(df).orderBy("nct_id", "ordinal").collect()
    one = [(r.text, r.is_exclusion) for r in rows if r.nct_id == "NCT00000001"]
    assert one == [("thyroid nodule.", False), ("recent stroke.", True)]
    assert not [r for r in rows if r.nct_id == "NCT00000002"]
    three = [(r.criterion_id, r.text, r.kind, r.is_exclusion) for r in rows if r.nct_id == "NCT00000003"]
    assert three == [("inc-0", "Age 18 years or older", "age", False),
                     ("inc-1", "ECOG 0-1", "ecog", False),
                     ("exc-2", "Pregnant or breastfeeding", "reproductive", True),
                     ("exc-3", "Active hepatitis B", "infection", True)]
    blank = {r.nct_id: r.is_blank for r in E.blank_results(df).collect()}
    assert blank == {"NCT00000001": False, "NCT00000002": True, "NCT00000003": False}


def test_one_bad_trial_fails_alone(spark):
    from conftest import line_extractor
    df = spark.createDataFrame([(f"NCT{i:08d}", "line one\nline two" if i % 3 else "  ")
                                for i in range(300)], "nct_id string, eligibility string")

    def flaky(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["nct_id"] == "NCT00000007").any():
            raise RuntimeError("HTTP 429 Too Many Requests")
        return line_extractor(batch[batch["nct_id"] != "NCT00000011"])      # leaves one trial out

    for tasks in (None, 1, 4):
        rows = E.extract_with(df, flaky, tasks=tasks).collect()
        out = {r.nct_id: r for r in rows}
        assert len(rows) == len(out) == 300
        assert sorted(k for k, r in out.items() if r.criteria == []) == [f"NCT{i:08d}" for i in range(0, 300, 3)]
        assert {k: r.error for k, r in out.items() if r.error} == {
            "NCT00000007": "HTTP 429 Too Many Requests", "NCT00000011": "extractor:no outcome"}
    assert E.tasks_for(1) == 1 and E.tasks_for(10_000) > 10 and E.tasks_for(1, workers=4) == 4


def test_throttle_stop_rule(spark):
    rows = [(0, "1", None), (0, "2", "HTTP 429"), (1, "3", "bad"), (1, "4", "bad"),
            (2, "5", None)]
    df = spark.createDataFrame(rows, "batch_index long, nct_id string, error string")
    got = {r.batch_index: (r.stops, r.ran) for r in E.throttle_stop(df).collect()}
    assert got == {0: (False, True), 1: (True, True), 2: (False, False)}


def test_signature_covers_every_pattern_of_the_rules():
    from cribra.functions.json_fns import config_signature
    from cribra.operators import rules as R
    listed = str(R.EXTRACTOR_MATERIAL)
    for pattern in (R.HEADING_RE, R.QUALIFIER_RE, R.BULLET_RE, R.TRAIL_RE):
        assert repr(pattern)[1:-1] in listed
    changed = {**R.EXTRACTOR_MATERIAL, "bullet": "x"}
    assert config_signature(changed) != config_signature(R.EXTRACTOR_MATERIAL)


def test_numbered_bullets_are_stripped_but_decimals_kept(spark):
    df = spark.createDataFrame([("NCT00000001", "1. Age 18 years or older\n2) Creatinine 1.5 mg/dL\n1.5 mg/dL or less")],
                               "nct_id string, eligibility string")
    got = [(r.text, r.kind) for r in rule_criteria(df).orderBy("ordinal").collect()]
    assert got == [("Age 18 years or older", "age"), ("Creatinine 1.5 mg/dL", "lab"),
                   ("1.5 mg/dL or less", "lab")]


def test_qualified_headings_leave_no_stray_words(spark):
    df = spark.createDataFrame([("NCT00000001", "Key Inclusion Criteria:\n- Adults\nKey Exclusion Criteria:\n- HIV")],
                               "nct_id string, eligibility string")
    got = [(r.text, r.is_exclusion) for r in rule_criteria(df).orderBy("ordinal").collect()]
    assert got == [("Adults", False), ("HIV", True)]
