import pytest
from pyspark.sql import functions as F

from gleanframe.functions.replies import classify, clean_replies, with_content

CLEANING = [
    ('{"a":1}', "A", {"a": "1"}),
    (' {"a":1} ', "A", {"a": "1"}),
    ('```json\n{"a":1}\n```', "A", {"a": "1"}),
    ('```\n{"a":1}\n```', "A", {"a": "1"}),
    ('```json{"a":1}```', "A", {"a": "1"}),
    ('Sure!\n```json\n{"a":1}\n```\nHope', "B", {"a": "1"}),
    ('text {"a":1} tail', "C", {"a": "1"}),
    ('{"a":1} {"b":2}', None, None),
    ('two {"a":1} and {"b":2}', None, None),
    ('Here: ```json\n{"a":}\n``` then ```json\n{"a":1}\n```', None, None),
    ('{"a":1,}', None, None),
    ("{'a':1}", None, None),
    ('{"a":1}],[{"b":2}', None, None),
    ('{"a":1},{"mark":"x"}],[', None, None),
    ('{"a":1},{"b":2}', None, None),
    ('{"a":{"b":[1]},"c":true}', "A", {"a": '{"b":[1]}', "c": "1"}),
    ('{"a":"true","b":false,"c":null}', "A", {"a": "true", "b": "0", "c": None}),
    ('{"a":true,"a":"true"}', "A", {"a": "true"}),
    ('{"a":1,"b":2,"a":true}', "A", {"a": "1", "b": "2"}),
    ('{"a":7.0,"b":7.50,"c":"\\u00e9"}', "A", {"a": "7.0", "b": "7.5", "c": "é"}),
    ("{}", "A", {}),
    ('[{"a":1}]', "non_object", None),
    ("[1]", "non_object", None),
    ("5", "non_object", None),
    ('"s {x}"', "non_object", None),
    ("null", None, None),
    ("", None, None),
    (None, None, None),
    ("no json", None, None),
    ("} {", None, None),
]

ENVELOPES = [
    ('{"choices":[{"message":{"content":"x"}}]}', "x"),
    ('{"id":"z","choices":[{"index":0,"message":{"role":"assistant","content":"y"}}]}', "y"),
    ('{"choices":[{"message":{"content":null}}]}', None),
    ('{"choices":[{"message":{}}]}', None),
    ('{"choices":[]}', None),
    ("{}", None),
    ("", None),
    ("oops", None),
    ('{"choices":[{"message":{"content":"x"}}]} more', None),
]


def test_cleaning_cascade(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CLEANING)], "i int, c string")
    for row in clean_replies(frame, "c").collect():
        content, stage, data = CLEANING[row.i]
        assert (row.stage, row.extracted) == (stage, data), content


def test_envelopes(spark):
    frame = spark.createDataFrame([(i, e[0]) for i, e in enumerate(ENVELOPES)], "i int, e string")
    for row in with_content(frame, "e", "content").collect():
        assert row.content == ENVELOPES[row.i][1], ENVELOPES[row.i]


def reply(content):
    import json

    return json.dumps({"choices": [{"message": {"content": content}}]})


@pytest.mark.parametrize(
    "text, raw, outcome, message",
    [
        ("t", reply('{"x":1,"y":null}'), "ok", None),
        ("t", reply('{"x":1}'), "missing_required", "Missing required JSON nodes: y"),
        ("t", reply('{"z":1}'), "missing_required", "Missing required JSON nodes: x, y"),
        ("t", reply("{}"), "empty_object", "LLM response held an empty JSON object."),
        ("t", reply("[1]"), "bad_json", "Failed to extract valid JSON from LLM response."),
        ("t", reply(""), "bad_json", "Failed to extract valid JSON from LLM response."),
        (
            "t",
            "Request error: down",
            "request_failed",
            "LLM request failed or returned empty response. Raw details: Request error: down",
        ),
        ("", None, "empty_chunk", "Chunk content was empty, skipped LLM call."),
    ],
)
def test_outcomes(spark, text, raw, outcome, message):
    frame = spark.createDataFrame([(text, raw)], "chunk_text string, raw_response string")
    row = classify(frame, ["x", "y"]).first()
    assert (row.outcome, row.error_message) == (outcome, message)
    assert row.success == (outcome == "ok")


def test_conditions_do_not_repeat_the_parse(spark):
    """A filter on the outcome stays above the cascade."""
    frame = spark.createDataFrame([("t", reply('{"x":1}'))], "chunk_text string, raw_response string")
    parsed = classify(frame, ["x"])
    alone = parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json")
    kept = parsed.where(F.col("success") & (F.col("outcome") != "bad_json"))
    filtered = kept._jdf.queryExecution().optimizedPlan().toString().count("from_json")
    assert filtered == alone
    assert kept.count() == 1
