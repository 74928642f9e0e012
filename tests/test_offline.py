"""Offline batch inference: requests out, replies in (E1-E4 with the attempt log)."""

import gzip
import json
import os

from conftest import study, write_pages

from cribra.plans import offline as OF
from cribra.plans import runs as R
from cribra.sources import tables as TB
from cribra.sources.tables import Warehouse

SIG = "0123456789abcdef"


def _read_lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.endswith(".gz"):
            with gzip.open(os.path.join(path, name), "rt") as f:
                out += [json.loads(line) for line in f if line.strip()]
    return out


def test_requests_out_replies_in(spark, tmp):
    wh = Warehouse(os.path.join(tmp, "wh"))
    prose = "INCLUSION: walks unaided.\nEXCLUSION: asthma attack."
    docs = [study(f"NCT0000000{i}", eligibility=prose if i != 5 else "x" * 12000) for i in range(1, 6)]
    docs.append(study("NCT00000006", eligibility="   "))
    R.run_backfill(spark, wh, write_pages(os.path.join(tmp, "p"), [{"studies": docs}]), run_token="T")

    req_path = os.path.join(tmp, "requests")
    assert OF.export_requests(spark, wh, SIG, req_path, batch="blank-0001") == 5   # blank: no call
    done = TB.done_view(TB.read_attempts(spark, wh)).collect()
    assert [r.nct_id for r in done] == ["NCT00000006"]                 # ok and empty, now done
    reqs = {r["custom_id"]: r for r in _read_lines(req_path)}
    assert reqs["NCT00000001"]["body"]["messages"][1]["content"] == prose
    assert reqs["NCT00000005"]["max_tokens"] == 8000 and reqs["NCT00000001"]["max_tokens"] == 1000

    crit = json.dumps({"criteria": [{"criterion_id": "inc-1", "text": "walks unaided", "kind": "age",
                                     "is_exclusion": False}]})
    replies = [
        {"custom_id": "NCT00000001", "response": {"body": {"choices": [{"message": {"content": crit}}]}}},
        {"custom_id": "NCT00000002", "response": json.dumps({"choices": [{"message": {"content": [
            {"type": "reasoning", "summary": "."}, {"type": "text", "text": crit}]}}]})},
        {"custom_id": "NCT00000003", "response": {"choices": [{"message": {"content": "{"},
                                                               "finish_reason": "length"}]}},
        {"custom_id": "NCT00000004", "response": {"choices": [{"message": {"content": "not json"}}]}},
        {"custom_id": "NCT00000005", "response": {"choices": [{"message": {"content": "{"},
                                                               "finish_reason": "length"}]}},
    ]
    rep_path = os.path.join(tmp, "replies")
    os.makedirs(rep_path)
    with open(os.path.join(rep_path, "part-0.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in replies) + "\n")

    retry_path = os.path.join(tmp, "retry")
    res = OF.import_replies(spark, wh, SIG, rep_path, req_path, batch="offline-0001",
                            retry_path=retry_path)
    assert (res.succeeded, res.failed, res.truncated, res.retries_written, res.criteria) == (2, 2, 1, 1, 2)
    retry = {r["custom_id"]: r for r in _read_lines(retry_path)}
    assert set(retry) == {"NCT00000003"}                               # 5 is already at the ceiling
    assert retry["NCT00000003"]["max_tokens"] == 2000 == retry["NCT00000003"]["body"]["max_tokens"]

    attempts = TB.read_attempts(spark, wh)
    silver = TB.silver_view(attempts).collect()
    assert sorted(r.nct_id for r in silver) == ["NCT00000001", "NCT00000002"]
    fails = {r.nct_id: r.attempts for r in TB.failures_view(attempts).collect()}
    assert fails == {"NCT00000004": 1, "NCT00000005": 1}       # 3 is not finished: its retry is due
    # importing the same file again replaces the batch instead of adding attempts
    OF.import_replies(spark, wh, SIG, rep_path, req_path, batch="offline-0001",
                      retry_path=os.path.join(tmp, "retry2"))
    assert {r.nct_id: r.attempts for r in TB.failures_view(TB.read_attempts(spark, wh)).collect()} == fails
    # the next export only asks for what is still pending
    assert OF.export_requests(spark, wh, SIG, os.path.join(tmp, "requests2"), batch="blank-0002") == 3


def test_reply_files_stream_into_attempts(spark, tmp):
    from cribra.streaming.replies_stream import replies_to_attempts
    wh = Warehouse(os.path.join(tmp, "wh"))
    root = os.path.join(tmp, "replies")
    os.makedirs(root)
    crit = json.dumps({"criteria": [{"criterion_id": "c-0", "text": "walks unaided", "kind": "age",
                                     "is_exclusion": False}]})
    with open(os.path.join(root, "a.jsonl"), "w") as f:
        f.write(json.dumps({"custom_id": "NCT00000001",
                            "response": {"choices": [{"message": {"content": crit}}]}}) + "\n")
        f.write(json.dumps({"custom_id": "NCT00000002", "response": {"nope": True}}) + "\n")
    replies_to_attempts(spark, wh, root, SIG).awaitTermination(120)
    with open(os.path.join(root, "b.jsonl"), "w") as f:
        f.write(json.dumps({"custom_id": "NCT00000002",
                            "response": {"choices": [{"message": {"content": crit}}]}}) + "\n")
    replies_to_attempts(spark, wh, root, SIG).awaitTermination(120)
    attempts = TB.read_attempts(spark, wh)
    assert sorted(r.nct_id for r in TB.silver_view(attempts).collect()) == ["NCT00000001", "NCT00000002"]
    assert TB.failures_view(attempts).count() == 0          # the later success clears the failure
    assert attempts.select("batch").distinct().count() == 2  # one batch per micro-batch
