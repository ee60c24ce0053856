"""Questions asked of the result and log tables after a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.text import file_stem
from gleanframe.functions.values import is_placeholder, typed
from gleanframe.operators.chunks import CHUNK_KEY, slice_chunks
from gleanframe.spec import ExtractionSpec


def typed_results(results: DataFrame, spec: ExtractionSpec) -> DataFrame:
    """Results with stored text read by declared format; the stored text stays as it is."""
    columns = {c: typed(F.col(c), fmt) for c, fmt in spec.formats.items()}
    return results.withColumns(columns)


def _per_column(table: DataFrame, keys: Sequence[str], measures: Mapping[str, Sequence[Column]],
                names: Sequence[str]) -> DataFrame:
    """Aggregate every column in one pass over the table, then turn columns into rows."""
    packed = [
        F.struct(F.lit(column).alias("field"), *[m.alias(n) for m, n in zip(values, names)])
        for column, values in measures.items()
    ]
    return (
        table.groupBy(*keys)
        .agg(F.array(*packed).alias("fields"))
        .select(*keys, F.inline("fields"))
    )


def fill_rate(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and non-empty values per run tag and column."""
    measures = {}
    for c in columns:
        filled = F.count(F.when(F.col(c) != "", 1))
        measures[c] = (F.count("*"), filled, filled / F.count("*"))
    return _per_column(results, ["run_tag"], measures, ["rows", "filled", "fill_rate"])


def na_rate(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values per run tag and column that only mark something unavailable."""
    measures = {
        c: (F.count("*"), F.count(F.when(is_placeholder(F.col(c)), 1))) for c in columns
    }
    return _per_column(results, ["run_tag"], measures, ["rows", "unavailable"])


def value_distribution(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value occurs, for columns with few different values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])
    return (
        results.select("run_tag", F.inline(pairs))
        .groupBy("run_tag", "field", "value")
        .agg(F.count("*").alias("rows"))
    )


@dataclass(frozen=True)
class RangeRule:
    column: str
    low: float
    high: float

    @property
    def name(self) -> str:
        return f"{self.column}_range"

    def broken(self) -> Column:
        return ~F.col(self.column).try_cast("double").between(self.low, self.high)


@dataclass(frozen=True)
class VocabularyRule:
    column: str
    words: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.column}_vocabulary"

    def broken(self) -> Column:
        return ~F.col(self.column).isin(*self.words)


def rule_violations(results: DataFrame, rules: Sequence[RangeRule | VocabularyRule]) -> DataFrame:
    """Violations per rule and run tag; a missing value breaks no rule."""
    measures = {
        rule.name: (F.count(F.col(rule.column)), F.count(F.when(rule.broken(), 1))) for rule in rules
    }
    return _per_column(results, ["run_tag"], measures, ["checked", "violations"])


def quote_grounding(
    results: DataFrame, chunks: DataFrame, documents: DataFrame, column: str
) -> DataFrame:
    """Is the quoted text found word for word in its own chunk?

    Quotes ride along with their bounds to the documents, so no chunk text is shuffled.
    """
    quotes = results.select("request_id", *CHUNK_KEY, F.col(column).alias("quote"))
    located = chunks.join(quotes, CHUNK_KEY)
    sliced = slice_chunks(located, documents, carry=("request_id", "quote"))
    grounded = F.contains(F.col("chunk_text"), F.col("quote"))
    return sliced.select("request_id", *CHUNK_KEY, grounded.alias("grounded"))


def run_compare(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two runs over the same chunks, field by field: in both, same, different, one-sided."""
    def side(results: DataFrame, name: str) -> DataFrame:
        values = F.struct(*columns).alias(name)
        return results.select(*CHUNK_KEY, values)

    joined = side(left, "a").join(side(right, "b"), CHUNK_KEY, "full_outer")
    in_a, in_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    measures = {}
    for c in columns:
        equal = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        measures[c] = (
            F.count(F.when(in_a & in_b, 1)),
            F.count(F.when(in_a & in_b & equal, 1)),
            F.count(F.when(in_a & in_b & ~equal, 1)),
            F.count(F.when(in_a & ~in_b, 1)),
            F.count(F.when(in_b & ~in_a, 1)),
        )
    names = ["in_both", "same", "different", "only_a", "only_b"]
    return _per_column(joined, [], measures, names)


def label_agreement(
    results: DataFrame, labels: DataFrame, pairs: Mapping[str, tuple[Column, Column]]
) -> DataFrame:
    """Agreement between extracted flags and external labels of the same document.

    ``labels`` has one row per ``stem``, the document's base name without extension.  A
    document's flag is set if any of its chunks sets it; chunks are combined before the
    join, so a document with very many of them adds one row to it.
    """
    flags = [F.max(extracted.cast("int")).alias(f"_{name}") for name, (extracted, _) in pairs.items()]
    by_document = results.groupBy(file_stem(F.col("file")).alias("stem")).agg(*flags)
    joined = by_document.join(labels, "stem")
    measures = {}
    for name, (_, label) in pairs.items():
        both = F.col(f"_{name}").isNotNull() & label.isNotNull()
        agree = F.count(F.when(both & (F.col(f"_{name}") == label.cast("int")), 1))
        measures[name] = (F.count(F.when(both, 1)), agree)
    return _per_column(joined, [], measures, ["documents", "agreeing"])


def error_triage(log: DataFrame, group: Column) -> DataFrame:
    """Failed attempts by outcome class and group, for instance the folder of the file."""
    failed = log.where(~F.col("success"))
    return failed.groupBy("outcome", group.alias("folder")).agg(
        F.count("*").alias("failures"), F.min("error_message").alias("example")
    )


def top_results(results: DataFrame, by: str, rows: int) -> DataFrame:
    """The highest ranked results; each task keeps its own top rows before they are merged."""
    return results.orderBy(F.col(by).desc_nulls_last(), *CHUNK_KEY).limit(rows)


def export_results(results: DataFrame, path: str) -> None:
    """Results as quoted CSV with a header, for spreadsheets and other tools."""
    results.write.mode("errorifexists").csv(
        path,
        header=True,
        quoteAll=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
