"""Calls of outside models: a window in flight, a budget over all tasks."""

import pytest

from loomquery.plans import models


@pytest.fixture
def client():
    """Made within a function, so that it travels to the workers by value."""
    import threading
    import time

    def make(pause=0.0):
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def complete(prompt):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(pause)
            with lock:
                state["now"] -= 1
            if prompt == "bad":
                raise ValueError("no")
            return {"content": f"{prompt}!", "prompt_tokens": len(prompt), "completion_tokens": 1, "finish_reason": f"{state['most']} {time.time()}"}

        return complete

    return make


def test_a_window_keeps_order_and_results(spark, client):
    rows = [(i, None if i % 9 == 4 else "bad" if i % 9 == 5 else f"p{i}") for i in range(40)]
    prompts = spark.createDataFrame(rows, "query_id long, prompt string").coalesce(1)
    plain = models.call_model(prompts, lambda: client()).collect()
    wide = models.call_model(prompts, lambda: client(0.02), models.Policy(window=6)).collect()
    said = lambda got: [(r.query_id, r.reply, r.error, r.prompt_tokens, r.completion_tokens) for r in got]
    assert said(plain) == said(wide) and [r.query_id for r in wide] == list(range(40))
    assert max(int(r.finish_reason.split()[0]) for r in wide if r.finish_reason) == 6
    assert models.call_model(prompts.where("false"), lambda: client(), models.Policy(window=3)).count() == 0


def test_a_budget_holds_over_tasks(spark, client):
    prompts = spark.createDataFrame([(i, "x" * 9) for i in range(60)], "query_id long, prompt string")
    policy = models.Policy(window=3, tokens_per_minute=12_000, lanes=2, reserve=lambda p: 10)
    got = models.call_model(prompts, lambda: client(), policy).collect()
    times = sorted(float(r.finish_reason.split()[1]) for r in got)
    assert len(got) == 60
    # 200 tokens a second, 10 a call: no stretch of time has more calls than its tokens, one call ahead in each lane and the window's.
    assert all(times[j] - times[i] >= (j - i - 2 - 6) * 10 / 200 for i in range(0, 60, 7) for j in range(i, 60))


def test_budget_by_a_clock():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 6))
        now[0] += s

    b = models.Budget(600, lambda: now[0], sleep)  # ten a second
    b.reserve(5)
    b.reserve(5)
    assert waits == [0.5, 0.5]
    now[0] += 100
    b.reserve(10)
    assert waits == [0.5, 0.5]  # a second's worth was saved up, no more
    b.settle(10, 30)
    b.reserve(10)
    assert waits[-1] == pytest.approx(3.0)
