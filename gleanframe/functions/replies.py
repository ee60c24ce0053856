"""Model replies as column expressions: envelope, JSON cleaning, checks, outcome.

Spark's JSON functions accept trailing text after a valid value.  A text is therefore
read as the first element of an array whose second and last element is a mark made from
the text: it is valid only if exactly these two elements come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.text import SPACE, strip

# Messages stored with failed attempts.
EMPTY_CHUNK = "Chunk content was empty, skipped LLM call."
REQUEST_FAILED = "LLM request failed or returned empty response. Raw details: "
BAD_JSON = "Failed to extract valid JSON from LLM response."
MISSING_REQUIRED = "Missing required JSON nodes: "
EMPTY_OBJECT = "LLM response held an empty JSON object."

# Fences removed or searched, in order.  ``(?md)`` keeps ``^`` and ``$`` at
# newlines only.
FENCE_OPEN_JSON = f"(?md)^```json{SPACE}*"
FENCE_OPEN = f"(?md)^```{SPACE}*"
FENCE_CLOSE = f"(?md){SPACE}*```$"
FENCED_BLOCK = f"```json{SPACE}*([\\s\\S]*?){SPACE}*```"
BRACED = r"(?s)\{.*\}"

ENVELOPE = "struct<choices:array<struct<message:struct<content:string>>>,mark:string>"


# The parsers are SQL text over named columns.  They read and check in two steps, so each
# text is parsed once however often its parse is looked at, and all of it is generated code.
OPTIONS = "map('allowSingleQuotes', 'false')"


def _with_mark(column: str, element: str, before: str, after: str) -> str:
    """SQL for the array of the column's JSON value and its mark; NULL where malformed."""
    text = f"concat('[', {column}, ',{before}', xxhash64({column}), '{after}]')"
    return f"from_json({text}, 'array<{element}>', {OPTIONS})"


def _checked(parsed: str, column: str, mark: str) -> str:
    """SQL for whether ``parsed`` is one value and the mark; ``mark`` reads ``last``."""
    last = mark.replace("last", f"get({parsed}, 1)")
    return f"(size({parsed}) = 2 AND {last} = CAST(xxhash64({column}) AS string))"


def with_content(df: DataFrame, raw: str, content: str) -> DataFrame:
    """Add ``choices[0].message.content`` of reply envelopes; NULL where any part is absent."""
    parsed = df.withColumn("_envelope", F.expr(_with_mark(raw, ENVELOPE, '{"mark":"', '"}')))
    valid = _checked("_envelope", raw, "last.mark")
    choice = "try_element_at(get(_envelope, 0).choices, 1)"
    return parsed.withColumn(content, F.expr(f"if({valid}, {choice}.message.content, NULL)")).drop(
        "_envelope"
    )


def stored_values(values: str, text: str) -> Column:
    """The parsed map as it is stored: last of equal keys, JSON true/false as '1'/'0'.

    A parsed map holds every entry in the order of the text, and gives a boolean and the
    string of its name the same value.  Types come from a second parse with the same entry
    order, made only where some value looks like a boolean.
    """
    has_words = f"arrays_overlap(map_values({values}), array('true', 'false'))"
    repeated = f"size(map_keys({values})) > size(array_distinct(map_keys({values})))"
    typed = f"""
      transform(array(map_values(from_json({text}, 'map<string,variant>', {OPTIONS}))), types ->
        transform(map_entries({values}), (e, i) -> named_struct('key', e.key, 'value',
          CASE WHEN e.value IN ('true', 'false') AND schema_of_variant(get(types, i)) = 'BOOLEAN'
               THEN if(e.value = 'true', '1', '0') ELSE e.value END)))[0]"""
    last_of_key = f"""
      transform(array(if({has_words}, {typed}, map_entries({values}))), entries ->
        map_from_entries(filter(entries, (e, i) ->
          NOT exists(slice(entries, i + 2, size(entries)), later -> later.key = e.key))))[0]"""
    return F.expr(
        f"CASE WHEN {repeated} THEN {last_of_key} "
        f"WHEN {has_words} THEN map_from_entries({typed}) ELSE {values} END"
    )


def unfenced(text: Column) -> Column:
    """The text without fence marks at line starts and line ends."""
    bare = text
    for pattern in (FENCE_OPEN_JSON, FENCE_OPEN, FENCE_CLOSE):
        bare = F.regexp_replace(bare, pattern, "")
    return F.when(F.contains(text, F.lit("```")), strip(bare)).otherwise(text)


def clean_replies(df: DataFrame, content: str) -> DataFrame:
    """Add ``stage`` and ``extracted``, the outcome of the cleaning cascade.

    Stage A parses the text without its fences, stage B the first fenced block of the
    original text, stage C the stretch from the first ``{`` to the last ``}``.  The first
    stage that yields valid JSON decides; if that is no object the stage is ``non_object``.
    A later stage is computed only for rows the earlier ones left open.
    """
    text = F.col(content)
    candidates = {
        "A": unfenced(strip(text)),
        "B": strip(F.regexp_extract(text, FENCED_BLOCK, 1)),
        "C": F.regexp_extract(text, BRACED, 0),
    }
    still_open = text.isNotNull() & (text != "")
    for stage, candidate in candidates.items():
        source, maps, values = f"_text_{stage}", f"_maps_{stage}", f"_values_{stage}"
        is_object = f"startswith({source}, '{{')"
        as_maps = _with_mark(source, "map<string,string>", '{"mark":"', '"}')
        as_values = _with_mark(source, "string", '"', '"')
        valid_map = _checked(maps, source, "try_element_at(last, 'mark')")
        valid_value = f"({_checked(values, source, 'last')} AND get({values}, 0) IS NOT NULL)"
        df = (
            df.withColumn(source, F.when(still_open, candidate))
            .withColumns(
                {
                    maps: F.expr(f"CASE WHEN {is_object} THEN {as_maps} END"),
                    values: F.expr(f"CASE WHEN NOT {is_object} THEN {as_values} END"),
                }
            )
            .withColumns(
                {
                    f"_data_{stage}": F.expr(f"if({valid_map}, get({maps}, 0), NULL)"),
                    f"_valid_{stage}": F.expr(f"coalesce({valid_map}, {valid_value}, false)"),
                }
            )
            .drop(maps, values)
        )
        still_open = still_open & ~F.col(f"_valid_{stage}")
    chosen_stage = F.coalesce(*[F.when(F.col(f"_valid_{s}"), s) for s in candidates])
    data = F.coalesce(*[F.col(f"_data_{s}") for s in candidates])
    source = F.coalesce(*[F.when(F.col(f"_valid_{s}"), F.col(f"_text_{s}")) for s in candidates])
    df = df.withColumns({"_stage": chosen_stage, "_data": data, "_source": source})
    stage = F.when(F.col("_data").isNotNull() | F.col("_stage").isNull(), F.col("_stage"))
    return df.withColumns(
        {
            "stage": stage.otherwise("non_object"),
            "extracted": stored_values("_data", "_source"),
        }
    ).drop(*[f"_{kind}_{s}" for kind in ("text", "data", "valid") for s in candidates], "_stage", "_data", "_source")


def missing_required(data: Column, required: list[str]) -> Column:
    """Required names absent from the object, in declared order; a null value is present."""
    if not required:
        return F.array().cast("array<string>")
    return F.array_except(F.array(*[F.lit(name) for name in required]), F.map_keys(data))


def classify(df: DataFrame, required: list[str], text: str = "chunk_text") -> DataFrame:
    """Add ``stage, extracted, outcome, success, error_message`` to rows with a reply.

    Needs ``raw_response`` and the chunk's text; an empty chunk is a failure on its own.
    """
    parsed = clean_replies(with_content(df, "raw_response", "_content"), "_content")
    data = F.col("extracted")
    parsed = parsed.withColumn("_missing", missing_required(data, required))
    outcome = (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty_chunk")
        .when(F.col("_content").isNull(), "request_failed")
        .when(data.isNull(), "bad_json")
        .when(F.size(data) == 0, "empty_object")
        .when(F.size("_missing") > 0, "missing_required")
        .otherwise("ok")
    )
    parsed = parsed.withColumn("outcome", outcome)
    message = (
        F.when(F.col("outcome") == "empty_chunk", EMPTY_CHUNK)
        .when(
            F.col("outcome") == "request_failed",
            F.concat(F.lit(REQUEST_FAILED), F.coalesce("raw_response", F.lit(""))),
        )
        .when(F.col("outcome") == "bad_json", BAD_JSON)
        .when(F.col("outcome") == "empty_object", EMPTY_OBJECT)
        .when(
            F.col("outcome") == "missing_required",
            F.concat(F.lit(MISSING_REQUIRED), F.array_join("_missing", ", ")),
        )
    )
    # One generated row per row: conditions on the outcome stay above the parse instead of
    # being pushed into it, where every one of them would repeat the whole cascade.
    fields = F.struct(
        "stage",
        "extracted",
        "outcome",
        (F.col("outcome") == "ok").alias("success"),
        message.alias("error_message"),
    )
    return parsed.select(*df.columns, F.inline(F.array(fields)))
