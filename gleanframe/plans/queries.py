"""Registered queries: every operator run over whole test tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame.  ``documents`` stands for the
document collection; ``events`` stands for a request log (one user's events in one third
of the day are one chunk, errors are failures, large purchases are stored results).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions import replies
from gleanframe.functions.text import collapse_whitespace, log_excerpt
from gleanframe.operators import chunks as C
from gleanframe.operators import pending as P
from gleanframe.operators import reports as R
from gleanframe.operators.attempts import as_results, attempt, replay
from gleanframe.operators.blocks import chunk_size_grid, cut_in_blocks
from gleanframe.operators.completion import (
    Completer,
    FunctionCompleter,
    RuleCompleter,
    prompt_lines,
    request_payload,
)
from gleanframe.operators.store import Store
from gleanframe.plans.run import Breaker, breaker_state, run_extraction
from gleanframe.plans.sample import (
    CHUNK_SIZE,
    COLUMNS,
    GRID,
    MAX_FAILURES,
    RESULT_VALUE,
    RUN_END,
    RUN_START,
    SPEC,
    read_back,
)
from gleanframe.session import shared_folder, spread
from gleanframe.sources.convert import convert_files, html_to_text
from gleanframe.sources.documents import (
    corpus,
    extension,
    from_table,
    read_text,
    route,
    status_report,
    with_status,
)
from gleanframe.sources.exports import read_export
from gleanframe.streaming.ingest import ingest
from gleanframe.streaming.monitor import failure_rate, monitor



def doc_id() -> Column:
    """The document's number, the last part of its name."""
    return F.substring_index("file", "/", -1).cast("long")


# Shared inputs ------------------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_documents(corpus(spark, sf_dir), CHUNK_SIZE)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_texts(corpus(spark, sf_dir), CHUNK_SIZE)


def _attempts(
    spark: SparkSession,
    sf_dir: str,
    number: int = 1,
    tag: str = "a",
    completer: Completer = RuleCompleter(),
) -> DataFrame:
    """Log rows of one attempt at every chunk."""
    requests = _texts(spark, sf_dir).withColumn("attempt", F.lit(number))
    return attempt(requests, SPEC, completer, tag, "run1", number)


def _results(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return as_results(_attempts(spark, sf_dir, **options), SPEC)


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after some were edited: a tenth cut in half, a tenth grown."""
    half = F.floor(F.length("content") / 2).cast("int")
    edited = (
        F.when(doc_id() % 10 == 0, F.substring(F.col("content"), F.lit(1), half))
        .when(doc_id() % 10 == 1, F.concat("content", F.lit(" One more sentence.")))
        .otherwise(F.col("content"))
    )
    return with_status(corpus(spark, sf_dir).select("file", edited.alias("content")))


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("file"),
        (F.hour("ts") % 3).alias("chunknumber"),
        F.col("ts").alias("timestamp"),
        (F.col("event_type") != "error").alias("success"),
        ((F.col("event_type") == "purchase") & (F.col("value") > RESULT_VALUE)).alias("stored"),
        F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("run_tag"),
    )


def _event_results(log: DataFrame) -> DataFrame:
    return log.where("stored").select(F.col("id").alias("request_id"), *C.CHUNK_KEY, "run_tag")


def _moment(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def _store(spark: SparkSession) -> Store:
    return Store(spark, shared_folder(spark), SPEC)


def _finished_run(spark: SparkSession, sf_dir: str) -> Store:
    store = _store(spark)
    run_extraction(store, corpus(spark, sf_dir), RuleCompleter(), "a", "run1", breaker=None)
    return store


# Chunks -------------------------------------------------------------------------------


def chunk_bounds(spark, sf_dir):
    return _chunks(spark, sf_dir)


def chunk_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("file", "chunknumber", "chunk_text")


def chunk_slices(spark, sf_dir):
    """Text of stored bounds, sliced from a document table that has changed since."""
    sliced = C.slice_chunks(_chunks(spark, sf_dir), _changed(spark, sf_dir))
    return sliced.select("file", "chunknumber", "chunk_text")


def long_document_bounds(spark, sf_dir):
    """The bounds of all documents, cut in blocks of two chunks' length at the same time."""
    return cut_in_blocks(corpus(spark, sf_dir), CHUNK_SIZE, 2 * CHUNK_SIZE)


def size_grid(spark, sf_dir):
    return chunk_size_grid(spread(corpus(spark, sf_dir), "file"), GRID)


def chunk_stats(spark, sf_dir):
    return C.chunk_stats(_chunks(spark, sf_dir))


def empty_chunks(spark, sf_dir):
    sliced = C.slice_chunks(_chunks(spark, sf_dir), _changed(spark, sf_dir))
    log = attempt(sliced.withColumn("attempt", F.lit(1)), SPEC, RuleCompleter(), "a", "run1", 1)
    empty = log.where(F.col("outcome") == "empty_chunk")
    return empty.select("file", "chunknumber", "success", "error_message")


def bounds_drift(spark, sf_dir):
    return C.bounds_drift(_chunks(spark, sf_dir), _changed(spark, sf_dir))


def known_files(spark, sf_dir):
    return C.known_files(_chunks(spark, sf_dir))


def active_files(spark, sf_dir):
    """Known files that are still in the folder, here the labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    folder = corpus(spark, sf_dir).withColumn("doc_id", doc_id()).join(labels, "doc_id", "left_semi")
    return C.active_files(_chunks(spark, sf_dir), folder)


def register_chunks(spark, sf_dir):
    """Two registrations; the second, with another size, leaves known files alone."""
    table = spread(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text", "lang"),
        "doc_id",
    )
    file = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    store = _store(spark)
    first = from_table(table.where(F.col("lang") == "en"), file, F.col("text"))
    store.register_chunks(first, 1500)
    store.register_chunks(from_table(table, file, F.col("text")), CHUNK_SIZE)
    return store.chunks()


def key_uniqueness(spark, sf_dir):
    def checked(name: str, table: DataFrame, key: list[str]) -> DataFrame:
        copies = table.groupBy(*key).agg(F.count("*").alias("copies"))
        return copies.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("keys"),
            F.count(F.when(F.col("copies") > 1, 1)).alias("duplicated"),
        )

    log = _event_log(spark, sf_dir)
    return (
        checked("chunks", _chunks(spark, sf_dir), C.CHUNK_KEY)
        .unionByName(checked("log", log, ["id"]))
        .unionByName(checked("results", _event_results(log), C.CHUNK_KEY))
    )


# Pending work and run state -----------------------------------------------------------


def pending_chunks(spark, sf_dir):
    log = _event_log(spark, sf_dir)
    chunks = log.select(*C.CHUNK_KEY).distinct()
    return P.pending_chunks(chunks, _event_results(log), log, MAX_FAILURES, _moment(RUN_START))


def pending_by_tag(spark, sf_dir):
    """Pending work of two run tags over the same chunks."""
    log = _event_log(spark, sf_dir)
    chunks = log.select(*C.CHUNK_KEY).distinct()
    results = _event_results(log)

    def pending(tag: str) -> DataFrame:
        own = log.where(F.col("run_tag") == tag)
        left = P.pending_chunks(chunks, results, own, MAX_FAILURES, _moment(RUN_START), tag)
        return left.withColumn("run_tag", F.lit(tag))

    return pending("a").unionByName(pending("b"))


def results_in_window(spark, sf_dir):
    log = _event_log(spark, sf_dir)
    found = P.results_in_window(_event_results(log), log, _moment(RUN_START), _moment(RUN_END))
    return found.select("request_id", *C.CHUNK_KEY)


def skipped_chunks(spark, sf_dir):
    log = _event_log(spark, sf_dir)
    return P.skipped_chunks(log, _moment(RUN_START), _moment(RUN_END), MAX_FAILURES)


def run_summary(spark, sf_dir):
    log = _event_log(spark, sf_dir)
    return P.run_summary(
        log, _event_results(log), _moment(RUN_START), _moment(RUN_END), MAX_FAILURES
    )


def retry_budget(spark, sf_dir):
    return P.retry_budget(_event_log(spark, sf_dir), _moment(RUN_START), MAX_FAILURES)


def consecutive_failures(spark, sf_dir):
    return P.consecutive_failures(_event_log(spark, sf_dir))


def latest_attempt(spark, sf_dir):
    latest = P.latest_attempt(_event_log(spark, sf_dir))
    return latest.select(*C.CHUNK_KEY, "attempts", "id", "success")


def ts_window(spark, sf_dir):
    """ISO text of log times read back, and both interval rules of a run."""
    log = _event_log(spark, sf_dir)
    offset = F.when(F.col("id") % 2 == 0, "+00:00").otherwise("Z")
    iso = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), offset)
    read = F.try_to_timestamp(F.regexp_replace("iso", "Z$", "+00:00"))
    return log.withColumn("iso", iso).select(
        "id",
        "iso",
        F.unix_micros(read).alias("epoch_us"),
        (F.col("timestamp") > _moment(RUN_START)).alias("counts_as_failure"),
        F.col("timestamp").between(_moment(RUN_START), _moment(RUN_END)).alias("in_summary"),
    )


# Requests and replies -----------------------------------------------------------------


def request_payloads(spark, sf_dir):
    payload = request_payload(SPEC, F.col("chunk_text"))
    sent = _texts(spark, sf_dir).select("file", "chunknumber", payload.alias("payload"))

    def part(path: str) -> Column:
        return F.get_json_object("payload", path)

    return sent.select(
        "file",
        "chunknumber",
        part("$.model").alias("model"),
        part("$.temperature").cast("double").alias("temperature"),
        part("$.messages[0].role").alias("first_role"),
        F.md5(part("$.messages[0].content")).alias("prompt_md5"),
        part("$.messages[1].role").alias("second_role"),
        part("$.messages[1].content").alias("user_text"),
    )


def prompts_by_source(spark, sf_dir):
    """Prompts assembled from a node table: one node per language of a document source."""
    pairs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang").distinct()
    lang = F.col("lang")
    nodes = pairs.select(
        "source",
        lang.alias("position"),
        F.concat(F.lit("n_"), lang).alias("name"),
        F.concat(F.lit("Documents written in "), lang).alias("description"),
        F.when(lang.isin("en", "es"), "number").alias("format"),
        F.when(lang == "en", True).when(lang == "de", False).alias("required"),
    )
    return prompt_lines(nodes, "source")


def envelope_parse(spark, sf_dir):
    """Replies built around conversation texts, some of them damaged, taken apart again."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    whole = F.to_json(F.struct(F.array(message).alias("choices"), F.col("role").alias("note")))
    raw = (
        F.when(kind == 1, F.to_json(F.struct(F.col("text").alias("error"))))
        .when(kind == 2, '{"choices": []}')
        .when(kind == 3, '{"choices": [{"message": {"role": "assistant"}}]}')
        .when(kind == 4, "")
        .when(kind == 5, F.concat(whole, F.lit(" and more")))
        .otherwise(whole)
    )
    replied = turns.select("conv_id", "turn", raw.alias("raw"))
    parsed = replies.with_content(replied, "raw", "content")
    return parsed.select("conv_id", "turn", "content", F.col("content").isNull().alias("failed"))


def json_clean(spark, sf_dir):
    requests = _texts(spark, sf_dir).withColumn("attempt", F.lit(1))
    raw = RuleCompleter()(requests, SPEC)
    content = replies.with_content(raw, "raw_response", "content")
    cleaned = replies.clean_replies(content, "content")
    fields = [F.try_element_at("extracted", F.lit(n.name)).alias(n.name) for n in SPEC.nodes]
    return cleaned.select("file", "chunknumber", "stage", *fields)


def required_check(spark, sf_dir):
    missing = F.array_join(
        replies.missing_required(F.col("extracted"), SPEC.required_nodes), ", "
    )
    parsed = _attempts(spark, sf_dir).where(F.col("extracted").isNotNull())
    return parsed.select("file", "chunknumber", missing.alias("missing"))


def outcome(spark, sf_dir):
    log = _attempts(spark, sf_dir)
    return log.select("file", "chunknumber", "attempt", "outcome", "success", "error_message")


def whitespace_collapsed(spark, sf_dir):
    return corpus(spark, sf_dir).select("file", collapse_whitespace(F.col("content")).alias("text"))


def log_excerpts(spark, sf_dir):
    return corpus(spark, sf_dir).select("file", log_excerpt(F.col("content"), 200).alias("excerpt"))


# Whole runs ---------------------------------------------------------------------------


def completion_wave(spark, sf_dir):
    """One stored wave with a Python function called once per chunk."""
    store = _store(spark)
    completer = FunctionCompleter(read_back, concurrency=8)
    run_extraction(store, corpus(spark, sf_dir), completer, "a", "run1", max_waves=1, breaker=None)
    return store.results().select("file", "chunknumber", *COLUMNS)


def attempt_split(spark, sf_dir):
    """Log rows of one wave and the result row that belongs to each successful one."""
    log = _attempts(spark, sf_dir)
    results = as_results(log, SPEC).select(F.col("request_id").alias("id"), "title")
    joined = log.select("id", "file", "chunknumber", "success").join(results, "id", "left")
    return joined.select("id", "file", "chunknumber", "success", "title")


def run_waves(spark, sf_dir):
    log = _finished_run(spark, sf_dir).log()
    return log.select("file", "chunknumber", "wave", "attempt", "outcome", "success")


def run_results(spark, sf_dir):
    results = _finished_run(spark, sf_dir).results()
    return results.select("request_id", "file", "chunknumber", "run_tag", *COLUMNS)


def resumed_run(spark, sf_dir):
    """A run stopped after its first wave, continued, then followed by a second run."""
    store = _store(spark)
    documents = corpus(spark, sf_dir)
    run_extraction(store, documents, RuleCompleter(), "a", "run1", max_waves=1, breaker=None)
    run_extraction(store, documents, RuleCompleter(), "a", "run1", breaker=None)
    run_extraction(store, documents, RuleCompleter(), "a", "run2", breaker=None)
    return store.log().select("run_id", "file", "chunknumber", "wave", "outcome")


def breaker_counts(spark, sf_dir):
    state = breaker_state(_finished_run(spark, sf_dir).log(), Breaker())
    return state.select(
        "wave", "attempts", "errors", "warnings", "errors_so_far", "warnings_so_far", "tripped"
    )


# Reports ------------------------------------------------------------------------------


def run_compare(spark, sf_dir):
    """Run a against run b, which had other faults and sometimes shorter titles."""
    other = _results(spark, sf_dir, number=2, tag="b", completer=RuleCompleter(short_titles=True))
    return R.run_compare(_results(spark, sf_dir), other, COLUMNS)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.withColumn("stem", F.col("doc_id").cast("string"))


def label_agreement(spark, sf_dir):
    pairs = {
        "quality": (F.col("score").try_cast("int") >= 6, F.col("quality")),
        "toxic": (F.col("title") == "n/a", F.col("toxic")),
    }
    return R.label_agreement(_results(spark, sf_dir), _labels(spark, sf_dir), pairs)


def external_labels(spark, sf_dir):
    """The labels as another tool's export: written as CSV, read and cleaned, compared."""
    path = shared_folder(spark)
    name = F.concat(F.col("stem"), F.lit(".txt")).alias("file_name")
    labels = _labels(spark, sf_dir).select(
        name, F.col("quality").cast("string"), F.when(F.col("toxic") == 1, "1").alias("toxic")
    )
    R.export_results(labels, path)
    export = read_export(spark, path, ["file_name", "quality", "toxic"])
    quality = F.max(F.col("score").try_cast("int"))
    best = _results(spark, sf_dir).groupBy(
        F.substring_index("file", "/", -1).alias("stem")
    ).agg(quality.alias("best_score"))
    return export.join(best, "stem", "left").select("stem", "file_name", "quality", "toxic", "best_score")


def error_triage(spark, sf_dir):
    return R.error_triage(_attempts(spark, sf_dir), F.substring_index("file", "/", 1))


def fill_rate(spark, sf_dir):
    return R.fill_rate(_results(spark, sf_dir), COLUMNS)


def value_distribution(spark, sf_dir):
    return R.value_distribution(_results(spark, sf_dir), ["score", "has_space"])


def typed_results(spark, sf_dir):
    typed = R.typed_results(_results(spark, sf_dir), SPEC)
    return typed.select("file", "chunknumber", *COLUMNS)


def na_rate(spark, sf_dir):
    return R.na_rate(_results(spark, sf_dir), COLUMNS)


def rule_violations(spark, sf_dir):
    rules = [R.RangeRule("score", 1, 10), R.VocabularyRule("has_space", ("1",))]
    return R.rule_violations(_results(spark, sf_dir), rules)


def quote_grounding(spark, sf_dir):
    grounded = R.quote_grounding(
        _results(spark, sf_dir), _chunks(spark, sf_dir), corpus(spark, sf_dir), "quote"
    )
    return grounded.select("file", "chunknumber", "grounded")


def replay_parse(spark, sf_dir):
    """Stored replies parsed again under a spec that requires nothing."""
    relaxed = replace(SPEC, nodes=tuple(replace(node, required=None) for node in SPEC.nodes))
    return replay(_attempts(spark, sf_dir), relaxed).select(
        "file", "chunknumber", "outcome", "success"
    )


def results_export(spark, sf_dir):
    """Results written as CSV and read back the way an outside tool would."""
    path = shared_folder(spark)
    columns = ["file", "chunknumber", "run_tag", *COLUMNS]
    R.export_results(_results(spark, sf_dir).select(*columns), path)
    return read_export(spark, path, columns, multi_line=True).drop("stem")


def filter_results(spark, sf_dir):
    typed = R.typed_results(_results(spark, sf_dir), SPEC)
    wanted = typed.where(F.col("has_space") & (F.col("score") >= 8) & F.col("title").isNotNull())
    return wanted.select("file", "chunknumber", "title", "score")


def top_results(spark, sf_dir):
    typed = R.typed_results(_results(spark, sf_dir), SPEC)
    return R.top_results(typed, "n_words", 25).select("file", "chunknumber", "n_words", "score")


# Files and streams --------------------------------------------------------------------

# Endings given to document names to exercise routing.
ENDINGS = (".md", ".TXT", ".pdf", ".DocX", ".pptx", ".csv", "", ".tar.gz", "/.md", ".d/notes", "..md")


def _ending(doc_id: Column) -> Column:
    endings = F.array(*[F.lit(e) for e in ENDINGS])
    return F.get(endings, (doc_id % len(ENDINGS)).cast("int"))


def doc_routing(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"),
                    _ending(F.col("doc_id")))
    paths = table.select(path.alias("file"))
    return paths.select("file", extension(F.col("file")).alias("ext"), route(F.col("file")).alias("kind"))


def _raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file bytes: mixed newlines, some undecodable, some empty."""
    newline = F.when(doc_id() % 3 == 0, "\r\n").when(doc_id() % 3 == 1, "\r").otherwise("\n")
    data = F.encode(F.replace(F.col("content"), F.lit("\n"), newline), "UTF-8")
    damaged = (
        F.when(doc_id() % 7 == 0, F.concat(data, F.unhex(F.lit("FF"))))
        .when(doc_id() % 11 == 0, F.unhex(F.lit("")))
        .otherwise(data)
    )
    name = F.concat(F.col("file"), F.when(doc_id() % 5 == 0, ".csv").otherwise(".txt"))
    return corpus(spark, sf_dir).select(name.alias("file"), damaged.alias("data"))


def text_normalize(spark, sf_dir):
    return read_text(_raw_files(spark, sf_dir))


def doc_status(spark, sf_dir):
    return status_report(read_text(_raw_files(spark, sf_dir)))


def pages_to_text(spark, sf_dir):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    files = pages.select(name.alias("file"), F.encode("html", "UTF-8").alias("data"))
    return convert_files(files, {".html": html_to_text})


def stream_ingest(spark, sf_dir):
    """The document table read as a stream and registered until it is used up."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    documents = from_table(
        stream, F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("text")
    )
    store = _store(spark)
    ingest(documents, store, f"{store.root}/progress", CHUNK_SIZE).awaitTermination()
    return store.chunks()


def failure_rate_stream(spark, sf_dir):
    """The event log read as a stream: failures per day and tag, of the days that are over."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    log = stream.select(
        "ts", (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("run_tag"),
    )
    folder = shared_folder(spark)
    rates = failure_rate(log, F.col("ts"))
    monitor(rates, f"{folder}/rates", f"{folder}/progress").awaitTermination()
    found = spark.read.schema(rates.schema).parquet(f"{folder}/rates")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def chunk_changes(spark, sf_dir):
    """Chunks of all documents against those of edited ones: cut short, lengthened, or a letter replaced."""
    documents = corpus(spark, sf_dir)
    text, n = F.col("content"), F.length("content")
    edited = (
        F.when(doc_id() % 10 == 0, F.substring(text, F.lit(1), F.floor(n / 2).cast("int")))
        .when(doc_id() % 10 == 1, F.concat(text, F.lit(" One more sentence.")))
        .when(doc_id() % 10 == 2, F.concat(F.lit("#"), F.substring(text, F.lit(2), n)))
        .otherwise(text)
    )
    changed = from_table(documents, F.col("file"), edited)
    old, new = (C.chunk_marks(C.chunk_texts(d, CHUNK_SIZE)) for d in (documents, changed))
    return C.chunk_changes(old, new)


# Queries whose function would hide the operator it calls carry the operator's name here.
RENAMED = {
    "request_payloads": "request_payload",
    "prompts_by_source": "prompt_lines",
    "whitespace_collapsed": "collapse_whitespace",
    "log_excerpts": "log_excerpt",
    "breaker_counts": "breaker_state",
    "size_grid": "chunk_size_grid",
}

QUERIES = {
    RENAMED.get(query.__name__, query.__name__): query
    for query in (
        chunk_bounds, chunk_text, chunk_slices, chunk_stats, long_document_bounds, size_grid, empty_chunks, bounds_drift,
        known_files, active_files, register_chunks, key_uniqueness,
        pending_chunks, pending_by_tag, results_in_window, skipped_chunks, run_summary,
        retry_budget, consecutive_failures, latest_attempt, ts_window,
        request_payloads, prompts_by_source, envelope_parse, json_clean, required_check, outcome,
        whitespace_collapsed, log_excerpts,
        completion_wave, attempt_split, run_waves, run_results, resumed_run, breaker_counts,
        run_compare, label_agreement, external_labels, error_triage, fill_rate,
        value_distribution, typed_results, na_rate, rule_violations, quote_grounding,
        replay_parse, results_export, filter_results, top_results,
        doc_routing, text_normalize, doc_status, pages_to_text, stream_ingest, failure_rate_stream, chunk_changes,
    )
}
