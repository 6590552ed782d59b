"""Requests to page models, their replies, and the calls in between."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from queue import Empty, SimpleQueue
from threading import Thread
from time import monotonic

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A client turns a request body into the text of a reply, or raises.
Client = Callable[[str], str]

NANOSECONDS = 1e9


def request_body(prompt: Column, image: Column, model: str, style: str = "generate", max_tokens: int = 4096) -> Column:
    """The JSON body of a request in one of the styles ``generate``, ``chat``, ``messages`` and ``plain``."""
    name, limit = F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens")
    if style == "generate":
        return F.to_json(F.struct(name, prompt.alias("prompt"), F.array(image).alias("images"), F.lit(False).alias("stream")))
    if style == "chat":
        said = F.struct(F.lit("text").alias("type"), prompt.alias("text"))
        shown = F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("data:image/png;base64,"), image).alias("url")).alias("image_url"))
        content = F.array(F.to_json(said), F.to_json(shown))
        # the two parts differ in type, so they are joined as text
        head = F.to_json(F.struct(name, limit))
        return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"messages":[{"role":"user","content":['), F.array_join(content, ","), F.lit("]}]}"))
    if style == "messages":
        source = F.struct(F.lit("base64").alias("type"), F.lit("image/png").alias("media_type"), image.alias("data"))
        content = F.array(F.to_json(F.struct(F.lit("image").alias("type"), source.alias("source"))), F.to_json(F.struct(F.lit("text").alias("type"), prompt.alias("text"))))
        head = F.to_json(F.struct(name, limit))
        return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"messages":[{"role":"user","content":['), F.array_join(content, ","), F.lit("]}]}"))
    if style == "plain":
        return F.to_json(F.struct(name, prompt.alias("prompt"), image.alias("image"), limit))
    raise ValueError(f"unknown style {style!r}")


def reply_text(body: Column) -> Column:
    """The text of a reply: the first field that holds one, else the body itself."""
    places = ["$.choices[0].message.content", "$.content[0].text", "$.content", "$.text", "$.response", "$.output"]
    return F.coalesce(*[F.get_json_object(body, p) for p in places], body)


def reply_seconds(body: Column) -> Column:
    """Seconds that a reply states in nanoseconds; null if it states none."""
    return F.get_json_object(body, "$.total_duration").cast("double") / NANOSECONDS


def reply_tokens(body: Column) -> Column:
    """Tokens that a reply says it holds, whatever it calls them; null if it does not say."""
    places = ["$.eval_count", "$.usage.completion_tokens", "$.usage.output_tokens", "$.usage.total_tokens", "$.tokens"]
    return F.coalesce(*[F.get_json_object(body, p).cast("long") for p in places])


class Attempts:
    """Calls in flight, each in a thread of its own, with a deadline and retries.

    ``workers`` calls run at a time.  Deadlines and the times of retries stand
    in one heap; a call that misses its deadline is given up, and its place goes to
    the next item at once, so a call that hangs costs one thread and no other
    item.  What a given-up call returns later is dropped.
    """

    def __init__(self, call: Client, workers: int, retries: int, delay: float, timeout: float | None) -> None:
        self.call, self.workers, self.retries, self.delay, self.timeout = call, workers, retries, delay, timeout

    def run(self, bodies: list[str | None]) -> list[tuple[str | None, str | None, int]]:
        """(reply, error, attempts) of each body, in order; a null body is not sent."""
        out: list[tuple[str | None, str | None, int]] = [(None, "no request", 0)] * len(bodies)
        done: SimpleQueue = SimpleQueue()
        waiting = deque((k, 1) for k, body in enumerate(bodies) if body is not None)
        running: dict[int, int] = {}  # item -> its attempt
        times: list[tuple[float, int, int, str]] = []
        left = len(waiting)

        def work(k: int, attempt: int) -> None:
            try:
                done.put((k, attempt, self.call(bodies[k]), None))
            except Exception as failure:  # any failure of a client becomes the row's error
                done.put((k, attempt, None, f"{type(failure).__name__}: {failure}"))

        def ended(k: int, attempt: int, reply: str | None, error: str | None) -> bool:
            """Whether the item is done; a failure that may be tried again gets its time."""
            del running[k]
            if error is not None and attempt <= self.retries:
                heappush(times, (monotonic() + self.delay * 2 ** (attempt - 1), k, attempt + 1, "retry"))
                return False
            out[k] = (reply, error, attempt)
            return True

        while left:
            while waiting and len(running) < self.workers:
                k, attempt = waiting.popleft()
                running[k] = attempt
                if self.timeout is not None:
                    heappush(times, (monotonic() + self.timeout, k, attempt, "deadline"))
                Thread(target=work, args=(k, attempt), daemon=True).start()
            try:
                k, attempt, reply, error = done.get(timeout=max(0.0, times[0][0] - monotonic()) if times else None)
                if running.get(k) == attempt:  # else it was given up
                    left -= ended(k, attempt, reply, error)
            except Empty:
                _, k, attempt, what = heappop(times)
                if what == "retry":
                    waiting.append((k, attempt))
                elif running.get(k) == attempt:
                    left -= ended(k, attempt, None, f"TimeoutError: no reply within {self.timeout:g} s")
        return out


def process_items(items: DataFrame, column: str, work: Callable[[], Callable[[str], str]], workers: int = 4, retries: int = 0, delay: float = 1.0, timeout: float | None = None) -> DataFrame:
    """items(index, column, ..) -> index, success, result, error, attempts; a failure is a row, not an end.

    ``timeout`` bounds the seconds of one attempt; see ``Attempts``.
    """
    asked = items.select("index", F.col(column).alias("body"))
    done = call_model(asked, work, workers, retries, delay, timeout)
    return done.select("index", (F.col("error").isNull() & (F.col("attempts") > 0)).alias("success"), F.col("reply").alias("result"), "error", "attempts")


def process_batches(items: DataFrame, column: str, work: Callable[[], Callable[[list[str | None]], list[str | None]]], batch: int = 10) -> DataFrame:
    """items(index, column) -> index, result: ``work`` is given lists of up to ``batch`` items; a list that fails has null results."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = work()
        for frame in frames:
            out: list[str | None] = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch, 1].tolist()
                try:
                    found = own(part)
                except Exception:  # any failure of the caller's work leaves its items without a result
                    found = [None] * len(part)
                out += found
            yield pd.DataFrame({"index": frame.iloc[:, 0], "result": pd.Series(out, index=frame.index, dtype="object")})

    return items.select("index", column).mapInPandas(run, "index long, result string")


def call_model(requests: DataFrame, make_client: Callable[[], Client], workers: int = 4, retries: int = 3, delay: float = 1.0, timeout: float | None = None) -> DataFrame:
    """requests(.., body) -> the same rows with reply, error, attempts.

    Each partition makes one client and keeps ``workers`` calls in flight; a
    row carries its own reply, so order does not matter.  A call that raises,
    or takes more than ``timeout`` seconds, is made again up to ``retries``
    times, after ``delay`` seconds doubled each time; then the row gets an
    error and no reply.  Null bodies are not sent: they have an error and no
    attempts.
    """
    schema = requests.selectExpr("*", "'' AS reply", "'' AS error", "0 AS attempts").schema
    place = requests.columns.index("body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempts = Attempts(make_client(), workers, retries, delay, timeout)
        for batch in batches:
            found = attempts.run(batch.iloc[:, place].tolist())
            yield batch.assign(reply=[x[0] for x in found], error=[x[1] for x in found], attempts=pd.Series([x[2] for x in found], index=batch.index, dtype="int32"))

    for f in schema.fields[-3:]:
        f.nullable = True
    return requests.mapInPandas(run, schema)


def seconds_left(elapsed: Column, done: Column, total: Column) -> Column:
    """Time left at the pace so far, never below zero; null before anything is done."""
    return F.when(done > 0, F.greatest(F.lit(0.0), elapsed * total / done - elapsed))
