"""From raw documents to token files: five stages, each on all that the one before kept.

Rejected toxic documents go, one document of each class of near copies stays, documents
that hold benchmark items go, sources are mixed to their weights, and what is left is
written as directly addressable token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm import decontaminate, jaccard, mixing, tokens, toxicity
from gleanframe.llm.queries import TOKENIZER
from gleanframe.llm.tables import DOCUMENT_COLUMNS, kept, settled, table

# Near copies share five-word shingles with a similarity of 0.8.
NEAR_COPIES = jaccard.Join(words=5, num=80, den=100, rounds=2)
# A row of documents is told from others by its id and a hash of its text.
KEY = ("doc_id", "text_key")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS, F.xxhash64("text").alias("text_key"))


def _plain(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with ``k_<name>`` and ``no_<name>`` for columns that may be null.

    Joins and repeats by these and ``text_key`` deal texts out once, joins by null-safe
    conditions and repeats by the columns themselves twice.
    """
    empty = {"doc_id": F.lit(0).cast("long"), "source": F.lit("")}
    return rows.withColumns(
        {f"k_{c}": F.coalesce(c, empty[c]) for c in names} | {f"no_{c}": F.col(c).isNull() for c in names}
    )


def _matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    other = rows.select(*[F.col(c).alias(f"r_{c}") for c in KEY])
    same = docs["doc_id"].eqNullSafe(F.col("r_doc_id")) & (docs["text_key"] == F.col("r_text_key"))
    return docs.join(other, same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a toxic grade is below the operator's limit.

    A null or empty text has no toxic feature and stays.  Repeated rows are judged alike, null
    ids like any other; without labels of both kinds all rows stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    graded = toxicity.severity(docs, model, DOCUMENT_COLUMNS)
    return graded.where(~F.col("toxic")).select(*DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class; a repeated row stays once.

    Documents without words are no copies of each other, but equal rows are.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))

    def stay() -> DataFrame:
        classes = jaccard.jaccard_classes(docs, NEAR_COPIES)
        with_words = classes.where("n > 0").groupBy("component").agg(first.alias("k")).select("k.doc_id", "k.text_key")
        return with_words.unionByName(classes.where("n = 0").select(*KEY).distinct())

    key = ["k_doc_id", "no_doc_id", "text_key"]
    rows = _plain(settled(stay), "doc_id").select(*key)
    return _plain(_keyed(docs), "doc_id").join(rows, key, "left_semi").dropDuplicates(key).select(*DOCUMENT_COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are told apart by id and text, so rows of one id with other texts stay.  Null and
    empty texts hold nothing and stay, and so do all rows where there are no items.
    """
    found = settled(lambda: decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select(*KEY).distinct())
    return _matching(_keyed(docs), found, "left_anti").select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents without words have size zero and are taken as the mix says.  Rows alike in id,
    text and source are interchangeable; a null source is a source of its own.
    """
    key = ["k_doc_id", "no_doc_id", "text_key", "k_source", "no_source"]
    # Rows alike in id, text and source are interchangeable; each is matched once.
    taken = settled(
        lambda: _plain(mixing.mixed(docs).where("copies > 0").select(*KEY, "source", "copies"), "doc_id", "source")
        .groupBy(*key)
        .agg(F.sum("copies").alias("copies"))
    )
    joined = _plain(_keyed(docs), "doc_id", "source").dropDuplicates(key).join(taken, key)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*DOCUMENT_COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The files' description of every document, read back from them.

    A null or empty text has its end id only; rows of equal or null id follow one another.
    """
    return tokens.token_table(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mix", mix_sources),
    ("token_files", token_files),
]

# Training a classifier, similarity classes and alignment are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
