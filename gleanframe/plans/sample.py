"""The specification and settings shared by the registered queries, tests and bench."""

from __future__ import annotations

import json

from gleanframe.spec import ExtractionSpec, NodeSpec

# Chunk sizes that are compared.
GRID = [500, 1000, 2000, 4000]
CHUNK_SIZE = 1000
MAX_FAILURES = 2
TEMPLATE = """Extract the fields below and answer with one JSON object.
{node_descriptions}
Use only what the text says.
"""
SPEC = ExtractionSpec(
    name="sample",
    nodes=(
        NodeSpec("title", "Opening words of the text", "text", "title", True),
        NodeSpec("n_words", "Number of words\n", "number", "n_words"),
        NodeSpec("has_space", "Does the text hold a space", "boolean", "has_space", False),
        NodeSpec("quote", "First sentence, word for word", "text", "quote", True),
        NodeSpec("score", "Rating from 1 to 10", "number", "score"),
        NodeSpec("memo", "Notes, not stored"),
    ),
    prompt_template=TEMPLATE,
    chunk_size=CHUNK_SIZE,
    max_failures=MAX_FAILURES,
)
COLUMNS = list(SPEC.formats)

# Interval of the run that the event log stands for, and the value that makes a purchase
# count as a stored result.
RUN_START = "2024-01-16 00:00:00"
RUN_END = "2024-01-24 00:00:00"
RESULT_VALUE = 100.0


def read_back(payload: str) -> str:
    """A stand-in for a model call: answers from the user message of the request."""
    text = json.loads(payload)["messages"][1]["content"]
    answer = {
        "title": text[:40],
        "n_words": text.count(" ") + 1,
        "has_space": " " in text,
        "quote": text.split(".")[0],
        "score": len(text) % 10 + 1,
    }
    return json.dumps({"choices": [{"message": {"content": json.dumps(answer)}}]})
