"""A training-data pipeline over the documents table: five stages, each an operator of matrel.llm.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.llm import mixing, pieces, simhash, suffix_dedup, toxicity
from matrel.llm.common import materialize, read_table

#: Shares of the mix, and its tokens as a multiple of what came in.
WEIGHTS = {"en-q1": 0.60, "de-q1": 0.14, "fr-q1": 0.14, "es-q1": 0.10, "en-q0": 0.02}
BUDGET = 1.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model is fitted on the labelled documents among docs."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles of five words (similarity 0.8 or more) that with the smallest id stays.

    Rows without id stay; rows that repeat an id stay or go together."""
    groups = simhash.similar_components(docs)
    gone = groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters inside a 50-byte string that also starts in a document with a smaller id go, and n_chars follows;
    documents of which nothing but white space is left go. Texts without repeats stay as they are, null ones too."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    null = "text_was_null" + "_" * max(map(len, docs.columns))  # a name that no column has
    out = suffix_dedup.remove_repeats(docs.withColumn(null, F.col("text").isNull()), with_text=True, carry=(*rest, null))
    out = out.where(~((F.col("n_removed") > 0) & (F.trim(F.translate("kept_text", "\n\t\r\x0b\x0c", "     ")) == "")))
    text = F.when(F.col(f"carried_{null}"), F.lit(None).cast("string")).otherwise(F.col("kept_text"))
    columns = {c: F.col(f"carried_{c}") for c in rest} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by nonnegative rates that bring the expected tokens of the domains to WEIGHTS: those of domains over
    their share are left out or kept by chance, others are repeated. Rows without tokens stay, once each."""
    domains = mixing.label_domains(read_table(spark, sf_dir, "labels"), docs)
    _, model = mixing.fit_mix(docs, domains, WEIGHTS, BUDGET)
    return mixing.draw_mix(docs, model)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip, samples): the coding of each row and two sampled segmentations."""
    return pieces.code_pieces(docs, pieces.load_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("sentencepiece", encode),
]

#: Learned scores, fingerprints and sampled segmentations are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
