"""Toxicity scores: boosted trees over dense text features, with isotonic calibration.

The lexicon is learned from labelled texts: words, and word beginnings for inflected forms, that far more toxic than
other texts contain. Features of a text: lexicon densities and counts, how often a lexicon word lies near a word of
second person, shares of capitals and of punctuation kinds, and rates of obfuscation (digits or marks inside words,
stretched letters, words that turn into lexicon words once such marks are read as letters).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic
from .common import read_table, release

#: Labelled rows that are used for fitting, at most (about: rows are taken by a hash of their id).
SAMPLE_ROWS = 24_000
#: Lexicon entries of each kind at most (those of the highest odds); the toxic fitting texts that must hold an entry, in
#: number and as a share; the log odds it must have. Parameters of the model, like the depth of its trees.
LEXICON_WORDS = 3000
LEXICON_TEXTS, LEXICON_SHARE, LEXICON_ODDS = 3, 0.002, 1.5
#: Characters of a word beginning.
STEM = 5
#: Words between a lexicon word and a word of second person that count as near.
NEAR = 5
# Words of second person in the four languages of the corpus; marks read as letters.
SECOND_PERSON = frozenset("you your yours yourself u ur thou thee tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch euer sie usted ustedes vosotros ti tuyo tus".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "|": "l"})

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_MIXED = re.compile(r"[^\W\d_][0-9@$!*#+|._-]+[^\W\d_]")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
FEATURES = ("word_hits", "word_density", "word_weight", "word_top", "stem_hits", "stem_density", "stem_weight", "stem_top", "near_second", "near_rate", "second_rate", "capitals", "capital_words", "exclaim", "question", "symbols", "mixed_rate", "stretched_rate", "hidden_hits", "hidden_rate", "log_words", "distinct_hits")


def features(text: str | None, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The values named by FEATURES; all zero for a text without words."""
    text = text or ""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    low = [w.strip(_EDGE) for w in text.lower().split()]
    hits = [(i, words[w]) for i, w in enumerate(low) if w in words]
    stem = [(i, stems[w[:STEM]]) for i, w in enumerate(low) if w[:STEM] in stems]
    hit_at = sorted({i for i, _ in hits} | {i for i, _ in stem})
    second = sum(w in SECOND_PERSON for w in low)
    near = sum(any(w in SECOND_PERSON for w in low[max(0, i - NEAR) : i + NEAR + 1]) for i in hit_at) if second else 0
    mixed = {w for w in set(low) if _MIXED.search(w)}
    hidden = sum(1 for w in mixed if (v := re.sub(r"[^\w]|\d|_", "", w.translate(LOOKALIKE))) in words or re.sub(r"[^\w]|\d|_", "", w) in words or len(v) > STEM and v[:STEM] in stems)
    letters = max(1, len(text))
    return [
        len(hits), len(hits) / n, sum(v for _, v in hits), max((v for _, v in hits), default=0.0),
        len(stem), len(stem) / n, sum(v for _, v in stem), max((v for _, v in stem), default=0.0),
        near, near / n, second / n,
        sum(map(str.isupper, text)) / letters, sum(map(str.isupper, tokens)) / n, text.count("!") / letters, text.count("?") / letters,
        sum(map(text.count, "#*$%&@")) / letters, len(mixed) / n, len(_STRETCH.findall(text)) / n, hidden, hidden / n, math.log1p(n), len({low[i] for i in hit_at}),
    ]


def _lexicon(texts: DataFrame, at_most: int) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with their log odds, from rows (text, toxic). Document counts are summed by partially aggregated
    groupBys; only entries over the thresholds come to the driver, at_most of each kind."""
    low = F.lower(F.coalesce("text", F.lit("")))
    bare = F.array_distinct(F.transform(F.split(low, r"\s+"), lambda w: F.regexp_replace(w, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")))
    n1, n0 = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n1:
        return {}, {}
    found = []
    for terms in (bare, F.array_distinct(F.transform(F.filter(bare, lambda w: F.length(w) > STEM), lambda w: F.substring(w, 1, STEM)))):
        counts = texts.select("toxic", F.explode(terms).alias("w")).where("w <> ''").groupBy("w").agg(F.sum("toxic").alias("c1"), F.count("*").alias("c"))
        # odds with half a document added on either side
        odds = F.ln((F.col("c1") + 0.5) / F.lit(float(n1 + 1))) - F.ln((F.col("c") - F.col("c1") + 0.5) / F.lit(float(n0 + 1)))
        rows = counts.where(F.col("c1") >= max(LEXICON_TEXTS, LEXICON_SHARE * n1)).withColumn("odds", odds).where(F.col("odds") >= LEXICON_ODDS).orderBy(F.desc("odds"), F.desc("c1"), "w").limit(at_most).collect()
        found.append({r["w"]: float(r["odds"]) for r in rows})
    return found[0], found[1]


def _rows(docs: DataFrame, words: dict, stems: dict, keep: list[str]) -> DataFrame:
    """keep and an array column x of features."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, stems))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, s = shared.value
        for batch in batches:
            x = [features(t, w, s) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}, x array<double>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model (plain dict) from labelled rows: about sample_rows of them by a hash of the id, so the bound does not move
    with the corpus. Three disjoint parts by hash: lexicon (40 %), trees (40 %), calibration (20 %).

    Rows with a null id, label or text are left out; of repeated label rows the greatest label counts.
    """
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if where is not None:
        y = y.where(where)
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = y.count()
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000))
    y = y.where(spread < int(1_000_000 * min(1.0, sample_rows / max(1, n))))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(10))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = texts.join(y, "doc_id").withColumn("part", part.cast("int")).persist()
    words, stems = _lexicon(texts.where("part < 4"), LEXICON_WORDS)
    fitted = _rows(texts.where("part >= 4"), words, stems, ["part", "toxic"]).collect()  # sample_rows * 0.6 rows of numbers
    texts.unpersist()
    x = np.array([r["x"] for r in fitted], float).reshape(len(fitted), len(FEATURES))
    t, p = np.array([r["toxic"] for r in fitted], float), np.array([r["part"] for r in fitted], int)
    order = np.lexsort((*x.T, t, p))  # whatever order the rows came in
    x, t, p = x[order], t[order], p[order]
    trees = BoostedTrees().fit(x[p < 8], t[p < 8])
    return {"words": words, "stems": stems, "trees": trees, "calibration": Isotonic().fit(trees.score(x[p >= 8]), t[p >= 8])}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs; the whole text counts, nothing but the text does. No shuffle.

    Null and empty texts get the score of a text without features; repeated rows repeat their result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([features(t, m["words"], m["stems"]) for t in batch.column(1).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m["calibration"].apply(m["trees"].score(x)), pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold. No shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([features(t, m["words"], m["stems"]) for t in batch.column(at).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(m["calibration"].apply(m["trees"].score(x)) < threshold))
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of learning; null for a row without id, which is never learned from either."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, where=~held_out())
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
