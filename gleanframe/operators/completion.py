"""Ask for completions: request payloads, and pluggable completers.

A completer takes rows ``(file, chunknumber, attempt, chunk_text)`` and adds
``raw_response``, the reply envelope as text, NULL for an empty chunk (no call is made).
It may add ``started_at`` and ``latency_ms`` of each call, and may leave rows out that it
didn't get to; these stay pending.
"""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.spec import ExtractionSpec


class Completer(Protocol):
    def __call__(self, requests: DataFrame, spec: ExtractionSpec) -> DataFrame: ...


def request_payload(spec: ExtractionSpec, chunk_text: Column) -> Column:
    """The request body as JSON text: model, system and user message, temperature."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(
        F.struct(
            F.lit(spec.model).alias("model"),
            F.array(message("system", F.lit(spec.prompt)), message("user", chunk_text)).alias(
                "messages"
            ),
            F.lit(float(spec.temperature)).alias("temperature"),
        )
    )


def prompt_lines(nodes: DataFrame, by: str) -> DataFrame:
    """Prompt text per group of a node table ``(by, position, name, description, format, required)``.

    A group holds the nodes of one prompt.
    """
    marker = F.when(F.col("required"), " (required)").when(~F.col("required"), " (optional)")
    line = F.concat(
        F.lit("- "),
        "name",
        F.coalesce(marker, F.lit("")),
        F.lit(": "),
        "description",
        F.coalesce(F.concat(F.lit(" ("), "format", F.lit(")")), F.lit("")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return nodes.groupBy(by).agg(F.array_join(ordered["line"], "\n").alias("prompt"))


class Answer(NamedTuple):
    reply: str | None
    started: float | None
    latency_ms: int | None
    failed: bool


@dataclass(frozen=True)
class Pause:
    """A Python worker makes no more calls under ``token`` after so many failed ones."""

    token: str
    failures: int


# Failed calls of this worker process under the token seen last; a process serves many tasks.
_FAILED: dict[str, int] = {}


class _Call:
    """A call in a thread of its own, whose reply is waited for until its deadline only.

    A thread can't be stopped: one whose reply comes late goes on unheard and ends with the
    worker at the latest.
    """

    def __init__(self, function: Callable[[str], str], payload: str) -> None:
        self.started, self._clock = time.time(), time.monotonic()
        self._done = threading.Event()
        self._answer: tuple[str | None, bool, float] = (None, True, 0.0)
        threading.Thread(target=self._run, args=(function, payload), daemon=True).start()

    def _run(self, function: Callable[[str], str], payload: str) -> None:
        try:
            reply = function(payload)
            failed = not _is_envelope(reply)
        except Exception as error:
            reply, failed = f"Request error: {error}", True
        self._answer = (reply, failed, time.monotonic() - self._clock)
        self._done.set()

    def answer(self, timeout: float) -> Answer:
        left = self._clock + timeout - time.monotonic()
        if self._done.wait(max(left, 0)):
            reply, failed, took = self._answer
        else:
            reply, failed, took = f"Request error: no reply within {timeout:g} s", True, timeout
        return Answer(reply, self.started, round(1000 * took), failed)


def _is_envelope(reply: str | None) -> bool:
    try:
        return bool(json.loads(reply or "")["choices"])
    except (ValueError, KeyError, TypeError):
        return False


def answers(
    payloads: list[str | None], function: Callable[[str], str], timeout: float, in_flight: int, pause: Pause | None
) -> Iterator[Answer | None]:
    """The answer to every payload in order, None for calls that a pause left out.

    At most ``in_flight`` calls are open; the next begins when the oldest has been answered
    or has run out of time.
    """
    if pause and pause.token not in _FAILED:
        _FAILED.clear()
        _FAILED[pause.token] = 0
    open_: deque[_Call | None] = deque()

    def oldest() -> Answer:
        call = open_.popleft()
        if call is None:
            return Answer(None, None, None, False)
        answer = call.answer(timeout)
        if answer.failed and pause:
            _FAILED[pause.token] += 1
        return answer

    made = 0
    for payload in payloads:
        while len(open_) >= in_flight:
            yield oldest()
        if pause and _FAILED[pause.token] >= pause.failures:
            break
        open_.append(None if payload is None else _Call(function, payload))
        made += 1
    while open_:
        yield oldest()
    yield from [None] * (len(payloads) - made)


@dataclass(frozen=True)
class FunctionCompleter:
    """Calls ``function(payload) -> reply envelope`` for every non-empty chunk.

    With ``concurrency`` the rows are first spread over that many tasks by key, which
    places rows the same way when a task is retried.  Each task has at most ``in_flight``
    calls open at a time, in threads, and waits ``spec.timeout`` seconds for each; replies
    keep the order of the rows.  The calls are the last step before the write: nothing is
    shuffled after them, so a lost executor repeats only calls whose output was not yet
    committed.  An exception or a missed deadline becomes the reply text of its row, never a
    task failure.
    """

    function: Callable[[str], str]
    concurrency: int | None = None
    in_flight: int = 1
    pause: Pause | None = None

    def pausing(self, token: str, failures: int) -> "FunctionCompleter":
        """The same completer, which leaves rows alone once a worker has seen so many failures."""
        return replace(self, pause=Pause(token, failures))

    def __call__(self, requests: DataFrame, spec: ExtractionSpec) -> DataFrame:
        function, timeout, in_flight, pause = self.function, spec.timeout, self.in_flight, self.pause

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = list(answers(batch["payload"].tolist(), function, timeout, in_flight, pause))
                batch = batch[[a is not None for a in found]].drop(columns="payload")
                made = [a for a in found if a is not None]
                batch["raw_response"] = pd.Series([a.reply for a in made], index=batch.index, dtype=object)
                began = [a.started and datetime.fromtimestamp(a.started, timezone.utc) for a in made]
                batch["started_at"] = pd.Series(began, index=batch.index, dtype="datetime64[us, UTC]")
                batch["latency_ms"] = pd.Series([a.latency_ms for a in made], index=batch.index, dtype="Int64")
                yield batch

        if self.concurrency:
            requests = requests.repartition(self.concurrency, "file", "chunknumber")
        non_empty = F.length("chunk_text") > 0
        payload = F.when(non_empty, request_payload(spec, F.col("chunk_text")))
        added = T.StructType().add("raw_response", "string").add("started_at", "timestamp").add("latency_ms", "long")
        schema = T.StructType([*requests.schema.fields, *added.fields])
        return requests.withColumn("payload", payload).mapInPandas(run, schema)


def envelope(content: Column) -> Column:
    """A reply envelope around a content text."""
    message = F.struct(content.alias("content"))
    return F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))


# Reply kinds of the rule completer by fault code 0..11.
FAULT_CODES = 12
FENCED, SURROUNDED_FENCE, SURROUNDED, NO_QUOTE, CUT_OFF, REQUEST_ERROR, EMPTY = range(5, 12)


@dataclass(frozen=True)
class RuleCompleter:
    """Offline completer: replies computed from the chunk by column expressions.

    Replies are deterministic, including their faults, so a run can be checked by
    arithmetic.  The document number is the last path segment of ``file``.
    """

    short_titles: bool = False

    def __call__(self, requests: DataFrame, spec: ExtractionSpec) -> DataFrame:
        doc_id = F.substring_index("file", "/", -1).cast("long")
        text = F.col("chunk_text")
        title = F.substring(text, 1, 40)
        if self.short_titles:
            title = F.when(doc_id % 5 == 0, F.substring(text, 1, 20)).otherwise(title)
        quote = F.substring_index(text, ".", 1)
        n_words = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
        fields = {
            "title": F.when(doc_id % 17 == 0, "n/a").otherwise(title),
            "n_words": n_words,
            "has_space": F.contains(text, F.lit(" ")),
            "quote": F.when(doc_id % 13 == 0, F.concat(F.lit("~"), quote)).otherwise(quote),
            "score": 1 + n_words % 12,
            "memo": F.concat(F.lit("chunk "), F.col("chunknumber").cast("string")),
        }
        whole = F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
        no_quote = F.to_json(
            F.struct(*[value.alias(name) for name, value in fields.items() if name != "quote"])
        )
        code = (doc_id * 31 + F.col("chunknumber") * 7 + F.col("attempt")) % FAULT_CODES
        fence = F.concat(F.lit("```json\n"), whole, F.lit("\n```"))
        content = (
            F.when(code == FENCED, fence)
            .when(code == SURROUNDED_FENCE, F.concat(F.lit("Here it is:\n"), fence, F.lit("\nDone.")))
            .when(code == SURROUNDED, F.concat(F.lit("Result: "), whole, F.lit(" as asked")))
            .when(code == NO_QUOTE, no_quote)
            .when(code == CUT_OFF, F.substring(whole, F.lit(1), F.length(whole) - 1))
            .when(code == EMPTY, "{}")
            .otherwise(whole)
        )
        reply = F.when(code == REQUEST_ERROR, '{"error": {"message": "overloaded"}}').otherwise(
            envelope(content)
        )
        return requests.withColumn("raw_response", F.when(F.length(text) > 0, reply))
