"""Calls with deadlines: what hangs costs itself alone."""

from __future__ import annotations

import threading
import time

from quillspark.operators import inference


def test_hung_calls_do_not_starve_others(spark):
    """Two calls hang, six are quick; two at a time."""

    def make():
        import time

        return lambda body: time.sleep(20) if body.startswith("hang") else body.upper()

    rows = [(0, "hang a"), (1, "hang b"), *[(k, f"quick {k}") for k in range(2, 8)], (8, None)]
    began = time.time()
    found = {r["index"]: r for r in inference.process_items(spark.createDataFrame(rows, "index long, body string").coalesce(1), "body", make, workers=2, timeout=0.5).collect()}
    assert time.time() - began < 15
    assert all(found[k].success and found[k].result == f"QUICK {k}" and found[k].attempts == 1 for k in range(2, 8))
    assert all(not found[k].success and found[k].error == "TimeoutError: no reply within 0.5 s" for k in (0, 1))
    assert (found[8].success, found[8].attempts, found[8].error) == (False, 0, "no request")


def test_late_first_attempt_then_reply():
    """An attempt that misses its deadline is made again; its own late reply is dropped."""
    seen: dict[str, int] = {}

    def call(body: str) -> str:
        seen[body] = seen.get(body, 0) + 1
        if body == "slow" and seen[body] == 1:
            time.sleep(0.6)
            return "too late"
        if body == "shaky" and seen[body] < 3:
            raise ValueError("again")
        return f"{body} {seen[body]}"

    out = inference.Attempts(call, workers=3, retries=2, delay=0.01, timeout=0.3).run(["slow", "shaky", None, "fine"])
    assert out == [("slow 2", None, 2), ("shaky 3", None, 3), (None, "no request", 0), ("fine 1", None, 1)]


def test_workers_bound_calls_in_flight():
    now, most, lock = [0], [0], threading.Lock()

    def call(body: str) -> str:
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return body

    assert [x[0] for x in inference.Attempts(call, 4, 0, 0.0, None).run([str(k) for k in range(40)])] == [str(k) for k in range(40)]
    assert 1 < most[0] <= 4
    assert inference.Attempts(call, 4, 0, 0.0, None).run([]) == []


def test_all_retries_used():
    def call(body: str) -> str:
        raise KeyError(body)

    assert inference.Attempts(call, 2, 1, 0.0, 5.0).run(["a", "b"]) == [(None, "KeyError: 'a'", 2), (None, "KeyError: 'b'", 2)]
