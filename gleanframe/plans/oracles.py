"""The registered queries as plain SQL over the same tables, written independently.

Chunk bounds come from a recursive query, attempt outcomes from the arithmetic of the
fault codes; nothing here parses a reply.
"""

from __future__ import annotations

from gleanframe.plans.sample import (
    CHUNK_SIZE,
    COLUMNS,
    GRID,
    MAX_FAILURES,
    RESULT_VALUE,
    RUN_END,
    RUN_START,
    SPEC,
    TEMPLATE,
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def kept(window: str) -> str:
    """Length of a window up to its last paragraph, line or sentence break, else all of it."""
    patterns = (r"(?s)^(.*\n\s*\n)", r"(?s)^(.*\n)", r"(?s)^(.*[.!?](?:\s|\z))")
    tried = [f"nullif(length(regexp_extract({window}, '{p}', 1)), 0)" for p in patterns]
    return f"coalesce({', '.join(tried)}, length({window}))"


DOCS = """docs AS (
  SELECT source || '/' || doc_id AS file, source, lang, doc_id, text AS content, length(text) AS n
  FROM documents
)"""


def cut(size: str = str(CHUNK_SIZE)) -> str:
    """``docs`` and ``chunks(file, doc_id, chunknumber, start, end)``."""
    return f"""{DOCS}, cuts(file, chunknumber, s, e) AS (
  SELECT file, 0, 0, CASE WHEN n <= {size} THEN n ELSE {kept('w')} END
  FROM (SELECT *, substr(content, 1, {size}) AS w FROM docs WHERE n > 0)
  UNION ALL
  SELECT file, chunknumber + 1, e, e + {kept('w')}
  FROM (SELECT c.file, c.chunknumber, c.e, substr(d.content, c.e + 1, {size}) AS w
        FROM cuts c JOIN docs d ON d.file = c.file WHERE c.e < d.n)
), chunks AS (
  SELECT c.file, d.doc_id, d.source, c.chunknumber, c.s AS start, c.e AS "end",
         substr(d.content, c.s + 1, c.e - c.s) AS chunk_text
  FROM cuts c JOIN docs d ON d.file = c.file
)"""


def chunks(rest: str, size: str = str(CHUNK_SIZE)) -> str:
    return f"WITH RECURSIVE {cut(size)}{rest}"


CHANGED = """, changed AS (
  SELECT file, CASE WHEN doc_id % 10 = 0 THEN substr(content, 1, n // 2)
                    WHEN doc_id % 10 = 1 THEN content || ' One more sentence.'
                    ELSE content END AS content
  FROM docs
)"""

FIELDS = f"""
  CASE WHEN doc_id % 17 = 0 THEN 'n/a' ELSE substr(chunk_text, 1, 40) END AS title,
  length(chunk_text) - length(replace(chunk_text, ' ', '')) + 1 AS words,
  CASE WHEN contains(chunk_text, ' ') THEN '1' ELSE '0' END AS has_space,
  CASE WHEN doc_id % 13 = 0 THEN '~' ELSE '' END || split_part(chunk_text, '.', 1) AS quote"""
OUTCOME = """CASE {k} WHEN 8 THEN 'missing_required' WHEN 9 THEN 'bad_json'
  WHEN 10 THEN 'request_failed' WHEN 11 THEN 'empty_object' ELSE 'ok' END"""


def attempts(name: str = "attempts", number: int = 1, title: str = "title", tag: str = "a") -> str:
    """One attempt at every chunk: its fault code, outcome and extracted texts."""
    return f""", {name} AS (
  SELECT file, doc_id, source, chunknumber, chunk_text, k, {number} AS attempt, '{tag}' AS run_tag,
         {OUTCOME.format(k='k')} AS outcome, k < 8 AS success,
         {title} AS title, CAST(words AS VARCHAR) AS n_words, has_space, quote,
         CAST(1 + words % 12 AS VARCHAR) AS score,
         sha256('{tag}|run1|' || file || '|' || chunknumber || '|{number}') AS id
  FROM (SELECT *, (doc_id * 31 + chunknumber * 7 + {number}) % 12 AS k, {FIELDS} FROM chunks)
)"""


SHORT_TITLE = (
    "CASE WHEN doc_id % 17 <> 0 AND doc_id % 5 = 0 THEN substr(chunk_text, 1, 20) ELSE title END"
)
ERROR_MESSAGE = """CASE outcome
  WHEN 'bad_json' THEN 'Failed to extract valid JSON from LLM response.'
  WHEN 'request_failed' THEN 'LLM request failed or returned empty response. Raw details: '
    || '{"error": {"message": "overloaded"}}'
  WHEN 'empty_object' THEN 'LLM response held an empty JSON object.'
  WHEN 'missing_required' THEN 'Missing required JSON nodes: quote' END"""
RESULTS = attempts() + ", results AS (SELECT * FROM attempts WHERE success)"

START, END = f"TIMESTAMP '{RUN_START}'", f"TIMESTAMP '{RUN_END}'"
LOG = f"""log AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS file, hour(ts) % 3 AS chunknumber, ts,
         event_type <> 'error' AS success,
         event_type = 'purchase' AND value > {RESULT_VALUE} AS stored,
         CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS run_tag
  FROM events
)"""


def pending(run_tag: str | None) -> str:
    own = f"run_tag = '{run_tag}'" if run_tag else "true"
    return f"""
SELECT file, chunknumber FROM (
  SELECT file, chunknumber, bool_or(stored AND {own}) AS has_result,
         count(*) FILTER (WHERE NOT success AND {own} AND ts > {START}) AS failed
  FROM log GROUP BY file, chunknumber) per_chunk
WHERE NOT has_result AND failed < {MAX_FAILURES}"""


SKIPPED = f"""SELECT file, chunknumber, count(*) AS failures FROM log
  WHERE NOT success AND ts >= {START} AND ts <= {END}
  GROUP BY file, chunknumber HAVING count(*) >= {MAX_FAILURES}"""


def prompt() -> str:
    rows = ", ".join(
        f"({i}, {quoted(n.name)}, {quoted(n.description)}, "
        f"{quoted(n.format) if n.format else 'NULL'}, {'NULL' if n.required is None else n.required})"
        for i, n in enumerate(SPEC.nodes)
    )
    head, tail = TEMPLATE.split("{node_descriptions}")
    return f"""(SELECT {quoted(head)} || string_agg('- ' || name
      || CASE required WHEN true THEN ' (required)' WHEN false THEN ' (optional)' ELSE '' END
      || ': ' || description || coalesce(' (' || format || ')', ''), chr(10) ORDER BY i)
      || {quoted(tail)} FROM (VALUES {rows}) AS nodes(i, name, description, format, required))"""


def waves() -> str:
    """Both waves of a run: everything once, then what failed once more."""
    keys = "file, doc_id, chunknumber"
    return f""", waves AS (
  SELECT {keys}, 1 AS wave, outcome, success, id, title, n_words, has_space, quote, score
  FROM attempts
  UNION ALL
  SELECT {keys}, 2, outcome, success, id, title, n_words, has_space, quote, score
  FROM second SEMI JOIN (SELECT file, chunknumber FROM attempts WHERE NOT success) failed
    USING (file, chunknumber)
)"""


RUN = attempts() + attempts("second", 2) + waves()
LABELLED = """, labelled AS (
  SELECT l.doc_id, l.quality, l.toxic, max(CAST(r.score AS INT)) AS best_score,
         max(CAST(CAST(r.score AS INT) >= 6 AS INT)) AS good,
         max(CAST(r.title = 'n/a' AS INT)) AS unavailable
  FROM labels l {join} results r ON r.doc_id = l.doc_id GROUP BY ALL
)"""


def per_column(select: str, columns: list[str] = COLUMNS, source: str = "results") -> str:
    return " UNION ALL ".join(
        f"SELECT {select.format(c=c)} FROM {source} GROUP BY run_tag" for c in columns
    )


def compared(column: str) -> str:
    both = "a.file IS NOT NULL AND b.file IS NOT NULL"
    same = f"a.{column} IS NOT DISTINCT FROM b.{column}"
    return f"""SELECT '{column}' AS field, count(*) FILTER ({both}) AS in_both,
      count(*) FILTER ({both} AND {same}) AS same,
      count(*) FILTER ({both} AND NOT ({same})) AS different,
      count(*) FILTER (b.file IS NULL) AS only_a, count(*) FILTER (a.file IS NULL) AS only_b
      FROM (SELECT * FROM attempts WHERE success) a
      FULL JOIN (SELECT * FROM second WHERE success) b
        ON a.file = b.file AND a.chunknumber = b.chunknumber"""


RAW = f"""{DOCS}, raw AS (
  SELECT file || CASE WHEN doc_id % 5 = 0 THEN '.csv' ELSE '.txt' END AS file,
    CASE WHEN doc_id % 5 = 0 THEN 'unsupported' WHEN doc_id % 7 = 0 THEN 'undecodable'
         WHEN doc_id % 11 = 0 OR n = 0 THEN 'empty' ELSE 'ok' END AS status,
    CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN NULL
         WHEN doc_id % 11 = 0 THEN '' ELSE content END AS content
  FROM docs
)"""

COLUMN_LIST = ", ".join(COLUMNS)

# Every document before and after an edit, under a name of its own.
VERSIONS = """docs AS (
  SELECT version || ':' || source || '/' || doc_id AS file, source, lang, doc_id, content, length(content) AS n
  FROM (SELECT *, 'old' AS version, text AS content FROM documents UNION ALL
        SELECT *, 'new', CASE doc_id % 10 WHEN 0 THEN substr(text, 1, length(text) // 2)
          WHEN 1 THEN text || ' One more sentence.' WHEN 2 THEN '#' || substr(text, 2) ELSE text END
        FROM documents)
)"""

ORACLES: dict[str, str] = {
    "chunk_bounds": chunks(' SELECT file, chunknumber, start, "end" FROM chunks'),
    "chunk_text": chunks(" SELECT file, chunknumber, chunk_text FROM chunks"),
    "chunk_slices": chunks(
        CHANGED
        + """ SELECT c.file, c.chunknumber, substr(d.content, c.start + 1, c."end" - c.start)
          AS chunk_text FROM chunks c JOIN changed d ON d.file = c.file WHERE d.content <> ''"""
    ),
    "chunk_stats": chunks(
        """ SELECT file, count(*) AS n_chunks, min("end" - start) AS min_length,
          max("end" - start) AS max_length, sum("end" - start) AS total_length,
          avg("end" - start) AS avg_length FROM chunks GROUP BY file"""
    ),
    "long_document_bounds": chunks(' SELECT file, chunknumber, start, "end" FROM chunks'),
    "chunk_size_grid": " UNION ALL ".join(
        "SELECT * FROM (" + chunks(
            f""" SELECT {size}::BIGINT AS size, count(*) AS chunks, min("end" - start) AS min_length,
              avg("end" - start) AS avg_length, max("end" - start) AS max_length FROM chunks""",
            str(size),
        ) + ")"
        for size in GRID
    ),
    "empty_chunks": chunks(
        CHANGED
        + """ SELECT c.file, c.chunknumber, false AS success,
          'Chunk content was empty, skipped LLM call.' AS error_message
          FROM chunks c JOIN changed d ON d.file = c.file
          WHERE d.content <> '' AND length(d.content) <= c.start"""
    ),
    "bounds_drift": chunks(
        CHANGED
        + """ SELECT c.file, max(c."end") AS covered, length(any_value(d.content)) AS length,
          CASE WHEN length(any_value(d.content)) > max(c."end") THEN 'grown' ELSE 'shrunk' END
            AS drift
          FROM chunks c JOIN changed d ON d.file = c.file GROUP BY c.file
          HAVING max(c."end") <> length(any_value(d.content))"""
    ),
    "failure_rate_stream": f"""WITH {LOG}, days AS (
        SELECT date_trunc('day', ts) AS window_start, run_tag, count(*) AS attempts,
          count(*) FILTER (NOT success) AS failures FROM log GROUP BY ALL)
      SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, run_tag, attempts, failures,
        failures / attempts AS failure_rate
      FROM days WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM log)""",
    "chunk_changes": chunks(
        """, marks AS (
          SELECT split_part(file, ':', 1) AS version, split_part(file, ':', 2) AS file, chunknumber, md5(chunk_text) AS mark,
            row_number() OVER (PARTITION BY file, md5(chunk_text) ORDER BY chunknumber) AS k FROM chunks)
        SELECT coalesce(o.file, w.file) AS file, coalesce(o.mark, w.mark) AS mark, o.chunknumber AS old_chunk,
          w.chunknumber AS new_chunk, CASE WHEN o.file IS NULL THEN 'new' WHEN w.file IS NULL THEN 'gone'
            WHEN o.chunknumber = w.chunknumber THEN 'kept' ELSE 'moved' END AS change
        FROM (SELECT * FROM marks WHERE version = 'old') o FULL JOIN (SELECT * FROM marks WHERE version = 'new') w
          ON o.file = w.file AND o.mark = w.mark AND o.k = w.k"""
    ).replace(DOCS, VERSIONS),
    "known_files": f"WITH {DOCS} SELECT file FROM docs WHERE n > 0",
    "active_files": f"""WITH {DOCS} SELECT file FROM docs
      WHERE n > 0 AND doc_id IN (SELECT doc_id FROM labels)""",
    "register_chunks": chunks(
        ' SELECT file, chunknumber, start, "end" FROM chunks',
        f"(CASE WHEN lang = 'en' THEN 1500 ELSE {CHUNK_SIZE} END)",
    ).replace("SELECT c.file, c.chunknumber, c.e, substr", "SELECT c.file, c.chunknumber, c.e, d.lang, substr"),
    "key_uniqueness": chunks(
        f""", {LOG}
        SELECT 'chunks' AS table_name, count(*) AS keys, count(*) FILTER (copies > 1) AS duplicated
        FROM (SELECT count(*) AS copies FROM chunks GROUP BY file, chunknumber)
        UNION ALL
        SELECT 'log', count(*), count(*) FILTER (copies > 1)
        FROM (SELECT count(*) AS copies FROM log GROUP BY id)
        UNION ALL
        SELECT 'results', count(*), count(*) FILTER (copies > 1)
        FROM (SELECT count(*) AS copies FROM log WHERE stored GROUP BY file, chunknumber)"""
    ),
    "pending_chunks": f"WITH {LOG} {pending(None)}",
    "pending_by_tag": f"""WITH {LOG} SELECT *, 'a' AS run_tag FROM ({pending('a')})
      UNION ALL SELECT *, 'b' FROM ({pending('b')})""",
    "results_in_window": f"""WITH {LOG} SELECT id AS request_id, file, chunknumber FROM log
      WHERE stored AND id IN (SELECT id FROM log WHERE ts >= {START} AND ts <= {END})""",
    "skipped_chunks": f"WITH {LOG} {SKIPPED}",
    "run_summary": f"""WITH {LOG}
      SELECT count(*) AS llm_calls, count(*) FILTER (stored) AS successes,
        (SELECT count(*) FROM ({SKIPPED})) AS skipped,
        epoch_us({END}) - epoch_us({START}) AS duration_us
      FROM log WHERE ts >= {START} AND ts <= {END}""",
    "retry_budget": f"""WITH {LOG}
      SELECT file, chunknumber, count(*) FILTER (NOT success AND ts > {START}) AS failures,
        greatest({MAX_FAILURES} - count(*) FILTER (NOT success AND ts > {START}), 0) AS attempts_left
      FROM log GROUP BY file, chunknumber""",
    "consecutive_failures": f"""WITH {LOG}, later AS (
        SELECT *, coalesce(bool_or(success) OVER (PARTITION BY file, chunknumber ORDER BY ts, id
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS succeeds_later FROM log)
      SELECT file, chunknumber, count(*) FILTER (NOT succeeds_later) AS consecutive_failures
      FROM later GROUP BY file, chunknumber""",
    "latest_attempt": f"""WITH {LOG}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY file, chunknumber ORDER BY ts DESC, id DESC) AS r,
          count(*) OVER (PARTITION BY file, chunknumber) AS attempts FROM log)
      SELECT file, chunknumber, attempts, id, success FROM ranked WHERE r = 1""",
    "ts_window": f"""SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
        || CASE WHEN event_id % 2 = 0 THEN '+00:00' ELSE 'Z' END AS iso,
      epoch_us(ts) AS epoch_us, ts > {START} AS counts_as_failure,
      ts >= {START} AND ts <= {END} AS in_summary FROM events""",
    "request_payload": chunks(
        f""" SELECT file, chunknumber, '{SPEC.model}' AS model, 0.0::DOUBLE AS temperature,
          'system' AS first_role, md5({prompt()}) AS prompt_md5, 'user' AS second_role,
          chunk_text AS user_text FROM chunks"""
    ),
    "prompt_lines": """SELECT source, string_agg('- n_' || lang
        || CASE lang WHEN 'en' THEN ' (required)' WHEN 'de' THEN ' (optional)' ELSE '' END
        || ': Documents written in ' || lang
        || CASE WHEN lang IN ('en', 'es') THEN ' (number)' ELSE '' END, chr(10) ORDER BY lang) AS prompt
      FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source""",
    "envelope_parse": """SELECT conv_id, turn,
        CASE WHEN (conv_id + turn) % 6 = 0 THEN text END AS content,
        (conv_id + turn) % 6 <> 0 AS failed FROM conversations""",
    "json_clean": chunks(
        attempts()
        + """ SELECT file, chunknumber,
          CASE WHEN k = 6 THEN 'B' WHEN k = 7 THEN 'C' WHEN k NOT IN (9, 10) THEN 'A' END AS stage,
          CASE WHEN k < 9 THEN title END AS title, CASE WHEN k < 9 THEN n_words END AS n_words,
          CASE WHEN k < 9 THEN has_space END AS has_space, CASE WHEN k < 8 THEN quote END AS quote,
          CASE WHEN k < 9 THEN score END AS score,
          CASE WHEN k < 9 THEN 'chunk ' || chunknumber END AS memo FROM attempts"""
    ),
    "required_check": chunks(
        attempts()
        + """ SELECT file, chunknumber, CASE k WHEN 8 THEN 'quote' WHEN 11 THEN 'title, quote'
          ELSE '' END AS missing FROM attempts WHERE k NOT IN (9, 10)"""
    ),
    "outcome": chunks(
        attempts()
        + f""" SELECT file, chunknumber, attempt, outcome, success, {ERROR_MESSAGE} AS error_message
          FROM attempts"""
    ),
    "collapse_whitespace": rf"""WITH {DOCS}
      SELECT file, trim(regexp_replace(content, '\s+', ' ', 'g')) AS text FROM docs""",
    "log_excerpt": f"""WITH {DOCS} SELECT file, CASE WHEN n > 200 THEN substr(content, 1, 200)
        || chr(10) || '...' || chr(10) || '(first 200 out of ' || n || ' characters shown)' || chr(10)
        ELSE content END AS excerpt FROM docs""",
    "completion_wave": chunks(
        f""" SELECT file, chunknumber, substr(chunk_text, 1, 40) AS title,
          CAST(words AS VARCHAR) AS n_words, has_space, split_part(chunk_text, '.', 1) AS quote,
          CAST(length(chunk_text) % 10 + 1 AS VARCHAR) AS score
          FROM (SELECT file, chunknumber, chunk_text, words, has_space
                FROM (SELECT *, {FIELDS} FROM chunks))"""
    ),
    "attempt_split": chunks(
        attempts()
        + """ SELECT id, file, chunknumber, success, CASE WHEN success THEN title END AS title
          FROM attempts"""
    ),
    "run_waves": chunks(
        RUN + " SELECT file, chunknumber, wave, wave AS attempt, outcome, success FROM waves"
    ),
    "run_results": chunks(
        RUN
        + f""" SELECT id AS request_id, file, chunknumber, 'a' AS run_tag, {COLUMN_LIST}
          FROM waves WHERE success"""
    ),
    "resumed_run": chunks(
        RUN
        + """, left_over AS (SELECT file, chunknumber FROM waves WHERE wave = 2 AND NOT success)
        SELECT 'run1' AS run_id, file, chunknumber, wave, outcome FROM waves
        UNION ALL SELECT 'run2', file, chunknumber, 1, outcome
        FROM attempts SEMI JOIN left_over USING (file, chunknumber)
        UNION ALL SELECT 'run2', file, chunknumber, 2, outcome
        FROM second SEMI JOIN left_over USING (file, chunknumber)"""
    ),
    "breaker_state": chunks(
        RUN
        + """, counted AS (
          SELECT wave, count(*) AS attempts, count(*) FILTER (outcome = 'request_failed') AS errors,
            count(*) FILTER (outcome NOT IN ('ok', 'request_failed')) AS warnings
          FROM waves GROUP BY wave), total AS (
          SELECT *, CAST(sum(errors) OVER (ORDER BY wave) AS BIGINT) AS errors_so_far,
            CAST(sum(warnings) OVER (ORDER BY wave) AS BIGINT) AS warnings_so_far FROM counted)
        SELECT *, errors_so_far > 3 OR warnings_so_far > 10 AS tripped FROM total"""
    ),
    "run_compare": chunks(
        attempts()
        + attempts("second", 2, SHORT_TITLE, "b")
        + " "
        + " UNION ALL ".join(compared(c) for c in COLUMNS)
    ),
    "label_agreement": chunks(
        RESULTS
        + LABELLED.format(join="JOIN")
        + """ SELECT 'quality' AS field, count(*) AS documents,
            count(*) FILTER (good = quality) AS agreeing FROM labelled
          UNION ALL SELECT 'toxic', count(*), count(*) FILTER (unavailable = toxic) FROM labelled"""
    ),
    "external_labels": chunks(
        RESULTS
        + LABELLED.format(join="LEFT JOIN")
        + """ SELECT CAST(doc_id AS VARCHAR) AS stem, doc_id || '.txt' AS file_name,
            CAST(quality AS VARCHAR) AS quality, CASE WHEN toxic = 1 THEN '1' END AS toxic, best_score
          FROM labelled"""
    ),
    "error_triage": chunks(
        attempts()
        + f""" SELECT outcome, source AS folder, count(*) AS failures, min({ERROR_MESSAGE}) AS example
          FROM attempts WHERE NOT success GROUP BY outcome, source"""
    ),
    "fill_rate": chunks(
        RESULTS
        + " "
        + per_column(
            "run_tag, '{c}' AS field, count(*) AS rows, count(*) FILTER ({c} <> '') AS filled, "
            "count(*) FILTER ({c} <> '') / count(*) AS fill_rate"
        )
    ),
    "value_distribution": chunks(
        RESULTS
        + """ SELECT run_tag, 'score' AS field, score AS value, count(*) AS rows FROM results
          GROUP BY ALL UNION ALL
          SELECT run_tag, 'has_space', has_space, count(*) FROM results GROUP BY ALL"""
    ),
    "typed_results": chunks(
        RESULTS
        + """ SELECT file, chunknumber,
          CASE WHEN lower(trim(title)) NOT IN ('n/a', '') THEN title END AS title,
          CAST(n_words AS DOUBLE) AS n_words, has_space = '1' AS has_space,
          CASE WHEN lower(trim(quote)) NOT IN ('n/a', '') THEN quote END AS quote,
          CAST(score AS DOUBLE) AS score FROM results"""
    ),
    "na_rate": chunks(
        RESULTS
        + " "
        + per_column(
            "run_tag, '{c}' AS field, count(*) AS rows, "
            "count(*) FILTER (lower(trim({c})) IN ('n/a', '')) AS unavailable"
        )
    ),
    "rule_violations": chunks(
        RESULTS
        + """ SELECT run_tag, 'score_range' AS field, count(*) AS checked,
            count(*) FILTER (CAST(score AS INT) NOT BETWEEN 1 AND 10) AS violations
          FROM results GROUP BY run_tag UNION ALL
          SELECT run_tag, 'has_space_vocabulary', count(*), count(*) FILTER (has_space <> '1')
          FROM results GROUP BY run_tag"""
    ),
    "quote_grounding": chunks(
        RESULTS
        + " SELECT file, chunknumber, contains(chunk_text, quote) AS grounded FROM results"
    ),
    "replay_parse": chunks(
        attempts()
        + """ SELECT file, chunknumber, CASE WHEN k = 8 THEN 'ok' ELSE outcome END AS outcome,
          k <= 8 AS success FROM attempts"""
    ),
    "results_export": chunks(
        RESULTS
        + " SELECT file, CAST(chunknumber AS VARCHAR) AS chunknumber, run_tag, "
        + ", ".join(f"nullif({c}, '') AS {c}" for c in COLUMNS)
        + " FROM results"
    ),
    "filter_results": chunks(
        RESULTS
        + """ SELECT file, chunknumber, title, CAST(score AS DOUBLE) AS score FROM results
          WHERE has_space = '1' AND CAST(score AS INT) >= 8 AND lower(trim(title)) NOT IN ('n/a', '')"""
    ),
    "top_results": chunks(
        RESULTS
        + """ SELECT file, chunknumber, CAST(n_words AS DOUBLE) AS n_words, CAST(score AS DOUBLE) AS score
          FROM results ORDER BY CAST(n_words AS INT) DESC, file, chunknumber LIMIT 25"""
    ),
    "doc_routing": """SELECT '/data/' || source || '/' || doc_id || ending AS file,
        CASE ending WHEN '.TXT' THEN '.txt' WHEN '.DocX' THEN '.docx' WHEN '.tar.gz' THEN '.gz'
          WHEN '/.md' THEN '' WHEN '.d/notes' THEN '' WHEN '..md' THEN '.md' ELSE ending END AS ext,
        CASE WHEN ending IN ('.md', '.TXT', '..md') THEN 'text'
          WHEN ending IN ('.pdf', '.DocX', '.pptx') THEN 'convertible' ELSE 'unsupported' END AS kind
      FROM (SELECT *, ['.md', '.TXT', '.pdf', '.DocX', '.pptx', '.csv', '', '.tar.gz', '/.md',
        '.d/notes', '..md'][doc_id % 11 + 1] AS ending FROM documents)""",
    "text_normalize": f"WITH {RAW} SELECT file, content, status FROM raw",
    "doc_status": f"WITH {RAW} SELECT status, count(*) AS files FROM raw GROUP BY status",
    "stream_ingest": chunks(' SELECT file, chunknumber, start, "end" FROM chunks'),
}
