"""A model is asked once for each distinct prompt, however often tasks and jobs run."""

import json
from pathlib import Path

import pytest

from mediasift.functions.hashing import Engines
from mediasift.plans import model

from .test_operators import SHA, request, seen

ENGINES = Engines(ocr="fake-ocr", asr="fake-asr", vision="fake-vlm")


def counting(folder, fail_after=None):
    """A model that leaves a line for each prompt it sees, and may break off after some calls."""

    def factory():
        import json as js
        import os

        def ask(requests):
            seen_before = len(os.listdir(folder))
            if fail_after is not None and seen_before >= fail_after:
                os._exit(1)  # the worker dies in the middle of the task
            with open(f"{folder}/{seen_before}-{os.getpid()}", "w") as out:
                js.dump(requests, out)
            return [js.dumps({"language": "zh", "summary": f"s{len(r) % 7}", "topics": ["T"], "confidence": 0.92}) for r in requests]

        return ask

    return factory


def asked(folder):
    return [r for p in Path(folder).iterdir() for r in json.loads(p.read_text())]


def rows(spark, n):
    made = request(spark, *[{"request_id": i, "post_text": f"text {i % 20}", "artifacts": [("a.png", 1, SHA, None)]} for i in range(n)])
    return made, seen(spark, *[{"request_id": i, "width": 640, "height": 480} for i in range(n)])


def test_equal_prompts_are_one_and_later_jobs_ask_for_new_ones_only(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    posts, found = rows(spark, 60)
    out = model.analyze_with_model(posts, found, counting(str(calls)), memo=str(tmp_path / "memo"), engines=ENGINES, call_tokens=2000)
    got = out.select("request_id", "output.summary", "output.topics", "output.needs_human_review").collect()
    assert len(got) == 60 and all(r["topics"] == ["T"] and r["summary"].startswith("s") and not r["needs_human_review"] for r in got)
    assert len(asked(calls)) == 20 and len(set(asked(calls))) == 20
    more = request(spark, {"request_id": 5, "post_text": "text 5", "artifacts": [("a.png", 1, SHA, None)]}, {"request_id": 99, "post_text": "new", "artifacts": [("a.png", 1, SHA, None)]})
    also = found.unionByName(seen(spark, {"request_id": 99, "width": 640, "height": 480}))
    model.analyze_with_model(more, also, counting(str(calls)), memo=str(tmp_path / "memo"), engines=ENGINES).count()
    assert len(asked(calls)) == 21 and len(set(asked(calls))) == 21


def test_task_that_runs_again_asks_for_the_rest_only(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    prompts = spark.createDataFrame([(f"ab{i:02d}" + "0" * 60, f"prompt {i} " + "x" * 400) for i in range(30)], "prompt_hash string, model_request string")
    with pytest.raises(Exception):
        model.ask(prompts, counting(str(calls), fail_after=5), str(tmp_path / "pending"), call_tokens=300).collect()
    before = len(asked(calls))
    assert 0 < before < 30
    got = model.ask(prompts, counting(str(calls)), str(tmp_path / "pending"), call_tokens=300).collect()
    assert {r["prompt_hash"] for r in got} == {r["prompt_hash"] for r in prompts.collect()} and all(r["reply"] for r in got)
    assert len(asked(calls)) == 30 and len(set(asked(calls))) == 30


def test_failures_fall_back_and_are_asked_again_by_the_next_job(spark, tmp_path):
    posts, found = rows(spark, 3)
    broken = lambda: lambda requests: [TimeoutError("late")] * len(requests)
    out = model.analyze_with_model(posts, found, broken, memo=str(tmp_path / "memo"), engines=ENGINES)
    assert {tuple(r["warnings"]) for r in out.select("output.warnings").collect()} == {("Semantic model failed; deterministic fallback used (TimeoutError).",)}


def test_calls_hold_a_bounded_number_of_tokens():
    requests = [(str(i), "x" * n) for i, n in enumerate([40, 40, 400, 4, 4, 4])]
    assert [[k for k, _ in c] for c in model.calls_of(requests, 20)] == [["0", "1"], ["2"], ["3", "4", "5"]]
    assert list(model.calls_of([], 20)) == []
