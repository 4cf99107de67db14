"""Mixing sources to target weights: soft domain membership and nonnegative document rates.

A labelled table trains a naive Bayes classifier on binned text statistics and on learned words; every document gets
posteriors over the domains of that table. Document rates r >= 0 then minimise half the squared gaps between the expected
tokens of each domain, sum_d r_d * tokens_d * posterior_dk, and its target, a domain's gap in units of the tokens that it
has, by projected gradients. All of it is DataFrame expressions and aggregates.

A pass measures the K gaps by one aggregate of the slim rows (tokens, posteriors) and moves every rate against its
gradient by its token, sum_k posterior_dk * gap_k / mass_k, then up to the bound where it fell below. In these units the
curvature is that of a matrix whose rows sum to one (posteriors do), so its largest eigenvalue is one and so is the step.
The rates of a pass are a fold over the K-vectors of the passes before, which is all that the driver keeps; every few
passes they are written beside the slim rows and the fold starts anew.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Domains at most: all that goes to the driver is of this size by the number of bins or passes.
MAX_DOMAINS = 64
#: Labelled rows that are used for fitting, at most (about: rows are taken by a hash of their id): 70 % for counts, 15 % for
#: the weights of the two kinds of evidence, 15 % held out.
SAMPLE_ROWS = 24_000
#: Learned words, at most: a row of K numbers each, broadcast. A word counts from so many fitting documents on.
VOCABULARY, LEAST_DOCUMENTS = 4096, 5
#: Documents that a word's share over all domains weighs in its share of one domain.
PRIOR_DOCUMENTS = 20.0
#: Weights that are tried for the statistics and for the words.
WEIGHTS_TRIED = tuple((a, b) for a in (0.5, 1.0) for b in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0))
#: Passes between which the rates are written.
FOLD = 8
#: Upper ends of the bins of each statistic, in the order of statistics().
BINS = (
    (20, 50, 100, 200, 400, 800, 1600, 3200, 6400),  # tokens
    (3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9),  # characters per token
    (0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64, 0.9),  # capitals per character
    (0.0001, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 0.6, 1.0),  # marks of MARKS per token
    (0.005, 0.02, 0.05, 0.08, 0.12, 0.2, 0.4, 0.7, 1.0),  # digits, full stops and question marks per token
)
MARKS = "#*$%&|<>!"


def tokens_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _bin(value: Column, ends: tuple) -> Column:
    return sum((value > F.lit(float(x))).cast("int") for x in ends).cast("tinyint")


def slim_rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, doc_id, same, tokens, b0, b1 ..., words): same tells texts apart, words are the distinct ones in lower case."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    number = lambda marks: F.regexp_count("__t", F.lit(f"[{marks}]"))
    rows = docs.select(*keep, F.col(f"`{id_col}`").alias("doc_id"), text.alias("__t"), tokens_of(F.lower(text)).alias("__w"))
    size, tokens = F.greatest(F.length("__t"), F.lit(1)), F.greatest(F.size("__w"), F.lit(1))
    stats = (F.size("__w"), F.length("__t") / tokens, number("A-Z") / size, number(MARKS) / tokens, number("0-9.?") / tokens)
    return rows.select(*keep, "doc_id", F.xxhash64("__t").alias("same"), F.size("__w").cast("long").alias("tokens"), *(_bin(v, ends).alias(f"b{i}") for i, (v, ends) in enumerate(zip(stats, BINS))), F.array_distinct("__w").alias("words"))


_B = [f"b{i}" for i in range(len(BINS))]


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> dict:
    """A model from rows (doc_id, domain): domains, log priors K, log likelihoods statistics x bins x K, lexicon (a table
    (w, l0, l1 ...): what a word adds to each domain's score), the weights of both, and held_out: accuracy and log loss on
    rows that were not used.

    Null ids and domains are left out. About sample_rows labelled rows are used; their ids are broadcast. The driver gets
    K x 50 sums and the losses of WEIGHTS_TRIED."""
    y = labelled.select("doc_id", "domain").where("doc_id is not null and domain is not null").distinct()
    n = y.count()
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("domains")), F.lit(1_000_000))
    y = y.where(spread < int(1_000_000 * min(1.0, sample_rows / max(1, n))))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(20)).cast("int")
    few = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(y), "doc_id")
    rows = materialize(slim_rows(few, "doc_id", "text", ("domain",)).withColumn("part", part), "mixing-labelled")
    fit = rows.where("part < 14")
    bins = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(b).alias("b")) for i, b in enumerate(_B))))
    counts = fit.select("domain", bins.alias("x")).groupBy("domain", "x.i", "x.b").count().collect()
    domains = sorted({r["domain"] for r in counts})
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"{len(domains)} domains; at most {MAX_DOMAINS}")
    if not domains:
        return {"domains": ["all"], "prior": np.zeros(1), "likelihood": np.zeros((len(BINS), 10, 1)), "lexicon": None, "weights": (1.0, 0.0), "held_out": {}}
    table = np.ones((len(BINS), max(map(len, BINS)) + 1, len(domains)))
    for r in counts:
        table[r["i"], r["b"], domains.index(r["domain"])] += r["count"]
    size = table[0].sum(axis=0) - table.shape[1]
    held = lambda k: F.sum((F.col("domain") == domains[k]).cast("double"))
    words = fit.select("domain", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").cast("double").alias("n"), *(held(k).alias(f"c{k}") for k in range(len(domains)))).where(F.col("n") >= LEAST_DOCUMENTS)
    share = F.col("n") / float(size.sum())
    odds = lambda k: F.ln((F.col(f"c{k}") + PRIOR_DOCUMENTS * share) / F.lit(float(size[k] + PRIOR_DOCUMENTS)) / share)
    words = words.select("w", *(odds(k).alias(f"l{k}") for k in range(len(domains))), sum(F.col(f"c{k}") * odds(k) for k in range(len(domains))).alias("tells"))
    lexicon = words.orderBy(F.desc(F.round("tells", 6)), "w").limit(vocabulary).drop("tells")
    model = {"domains": domains, "prior": np.log((size + 1) / (size + 1).sum()), "likelihood": np.log(table / table.sum(axis=1, keepdims=True)), "lexicon": materialize(lexicon, "mixing-lexicon")}
    return model | _weigh(rows.where("part >= 14"), model)


def _weigh(rows: DataFrame, model: dict) -> dict:
    """Weights of the statistics and the words that give the least log loss on parts 14 to 16, measured on parts 17 to 19."""
    own = sum((F.when(F.col("domain") == d, F.col("p")[k]).otherwise(0.0) for k, d in enumerate(model["domains"])), F.lit(0.0))
    best = F.element_at(F.array(*map(F.lit, model["domains"])), F.array_position("p", F.array_max("p")).cast("int"))
    held = (F.col("part") >= 17).alias("held")
    scored = evidence(rows, model, ["domain", "part"])
    tried = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), _softmax(model, weights).alias("p")) for n, weights in enumerate(WEIGHTS_TRIED))))
    at = scored.select("domain", held, tried.alias("t")).select("domain", "held", "t.n", "t.p")
    got = at.groupBy("held", "n").agg(F.avg(-F.ln(F.greatest(own, F.lit(1e-12)))).alias("loss"), F.avg((best == F.col("domain")).cast("double")).alias("right"), F.count("*").alias("rows")).collect()
    chosen = min((r["loss"], r["n"]) for r in got if not r["held"])[1] if any(not r["held"] for r in got) else WEIGHTS_TRIED.index((1.0, 0.5))
    return {"weights": WEIGHTS_TRIED[chosen], "held_out": next(({"accuracy": r["right"], "log_loss": r["loss"], "rows": r["rows"]} for r in got if r["held"] and r["n"] == chosen), {})}


def evidence(rows: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """keep, the bins and e: what the words of a row add to each domain's score, by the root of their number, as words of one
    text are no independent witnesses. The lexicon is broadcast; sums are taken in the task that reads the row, and only
    slim rows are shuffled."""
    k = len(model["domains"])
    if model["lexicon"] is None:
        return rows.select(*keep, *_B, F.array_repeat(F.lit(0.0), k).alias("e"))
    columns = [*keep, *_B]
    numbered = rows.select(F.monotonically_increasing_id().alias("__n"), *columns, "words")  # before the words part
    w = numbered.select("__n", *columns, F.explode_outer("words").alias("w"))
    sums = w.join(F.broadcast(model["lexicon"]), "w", "left").groupBy("__n", *columns).agg(*((F.coalesce(F.sum(f"l{i}"), F.lit(0.0)) / F.sqrt(F.greatest(F.count("w"), F.lit(1)))).alias(f"e{i}") for i in range(k)))
    return sums.select(*columns, F.array(*(f"e{i}" for i in range(k))).alias("e"))


def _softmax(model: dict, weights: tuple[float, float]) -> Column:
    """Posteriors from the bins and e. The model is K x 50 literals inside the expression."""
    prior, likelihood, (a, b) = model["prior"], model["likelihood"], weights
    at = lambda i, k: F.element_at(F.array(*(F.lit(float(v)) for v in likelihood[i, :, k])), F.col(f"b{i}").cast("int") + 1)
    score = F.array(*(F.lit(float(prior[k])) + F.lit(a) * sum(at(i, k) for i in range(len(BINS))) + F.lit(b) * F.col("e")[k] for k in range(len(prior))))
    powers = F.transform(F.array(score), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
    return F.transform(F.array(powers), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, y: t + y)))[0]


def posteriors(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, tokens, p), a row for each row of docs: p is the array of domain posteriors. Written once."""
    rows = evidence(slim_rows(docs, id_col, text_col), model, ["doc_id", "same", "tokens"])
    return materialize(rows.select("doc_id", "same", "tokens", _softmax(model, model["weights"]).alias("p")), "mixing-rows")


def moved(rate: Column, p: Column, steps: list[np.ndarray], least: float) -> Column:
    """rate after the steps: each goes against the gradient and back to the bound."""
    if not steps:
        return rate
    against = lambda g: sum(p[k] * g[k] for k in range(len(steps[0])))
    return F.aggregate(F.array(*(F.array(*(F.lit(float(v)) for v in g)) for g in steps)), rate, lambda r, g: F.greatest(F.lit(float(least)), r - against(g)))


def fit_rates(rows: DataFrame, targets: np.ndarray, least: float = 0.0, passes: int = 40, tolerance: float = 1e-4) -> tuple[DataFrame, float, int]:
    """(rows with rate, gap as a share of all targets, passes) for rows (tokens, p ...); targets: expected tokens of each
    domain. Ends when the gap is under the tolerance, when a pass shrinks the sum of squares by less than one part in a
    hundred (targets out of reach: a least-squares gap is left), or after so many passes."""
    k = len(targets)
    p, t = F.col("p"), F.col("tokens").cast("double")
    rows = rows.withColumn("rate", F.greatest(F.lit(1.0), F.lit(float(least))))
    sums = lambda r: np.array([v or 0.0 for v in rows.agg(*(F.sum(r * t * p[i]).alias(f"c{i}") for i in range(k))).first()], float)  # noqa: B023, E731
    mass = sums(F.lit(1.0))
    unit = np.where(mass > 0, 1 / np.maximum(mass, 1e-300), 0.0)
    scale, steps, before, n = max(1.0, float(np.abs(targets).sum())), [], np.inf, 0
    while True:
        gap = sums(moved(F.col("rate"), p, steps, least)) - targets
        square = float((gap * gap * unit).sum())
        if np.abs(gap).sum() <= tolerance * scale or square > 0.99 * before or n >= passes:
            break
        if len(steps) == FOLD:
            rows, steps = materialize(rows.withColumn("rate", moved(F.col("rate"), p, steps, least)), "mixing-rates"), []
        steps.append(gap * unit)
        before, n = square, n + 1
    return rows.withColumn("rate", moved(F.col("rate"), p, steps, least)), float(np.abs(gap).sum() / scale), n


def fit_mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """((doc_id, same, tokens, p, rate), model): posteriors and rates of all documents, and what gave them."""
    model = fit_domains(docs, labelled, id_col, text_col)
    rows, domains = posteriors(docs, model, id_col, text_col), model["domains"]
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = np.array([(weights or dict.fromkeys(domains, 1.0)).get(d, 0.0) for d in domains], float)
    share = share / share.sum() if share.sum() > 0 else np.full(len(domains), 1 / len(domains))
    targets = share * total * budget
    rows, gap, passes = fit_rates(rows, targets, least) if total else (rows.withColumn("rate", F.lit(max(1.0, least))), 0.0, 0)
    return rows, model | {"targets": targets, "gap": gap, "passes": passes, "rows": rows}


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """((doc_id, n_tokens, posteriors, rate), model). weights: share of the tokens that each domain is to have (of
    domains not named: none); without weights every domain gets the same. budget: expected tokens of the mix as a
    multiple of the corpus. least: lower bound of the rates, 0 unless every document is to stay.

    Null and empty texts have no tokens, a posterior and a rate. Repeated rows repeat their result. With no labelled row
    there is one domain "all"; with no tokens every rate is 1. Other columns are not read. model has the gap that is left
    as a share of all targets, and the classifier's held-out accuracy and log loss.
    """
    rows, model = fit_mix(docs, labelled, weights, budget, least, id_col, text_col)
    return rows.select("doc_id", F.col("tokens").alias("n_tokens"), F.map_from_arrays(F.array(*map(F.lit, model["domains"])), F.col("p")).alias("posteriors"), "rate"), model


def draw_mix(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, as often as their rates say: the whole part of rate + a number in [0, 1) that is a
    hash of id and text; rows without tokens, on which no target hangs, once. docs are those that the model's rates were
    fitted on; rows and rates meet by id and text, so rows of one id or without id get what their own text has."""
    same = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "same", F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.when(F.max("tokens") == 0, 1).otherwise(F.floor(F.max("rate") + F.first(chance)).cast("int"))
    rates = model["rows"].groupBy("doc_id", "same").agg(copies.alias("copies")).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("same").alias("__same"), F.col("copies").alias("__copies"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{id_col}`").alias("__i"), same.alias("__s"))
    rows = rows.join(rates, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__s") == F.col("__same")))
    return rows.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__copy")).select("__row.*")


def label_domains(labels: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, domain) for labelled documents: language and quality together name the domain."""
    y = labels.where("quality is not null").select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    lang = docs.where("lang is not null").select(F.col(id_col).alias("doc_id"), "lang")
    return y.join(lang, "doc_id").select("doc_id", F.concat("lang", F.lit("-q"), "quality").alias("domain")).distinct()


#: Shares of the production mix: more of the languages that are rare in the corpus, less of low quality.
WEIGHTS = {"en-q1": 0.55, "de-q1": 0.14, "fr-q1": 0.14, "es-q1": 0.11, "en-q0": 0.03, "de-q0": 0.01, "fr-q0": 0.01, "es-q0": 0.01}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out, _ = mix(docs, label_domains(labels, docs), WEIGHTS)
    p = lambda d: F.coalesce(F.try_element_at("posteriors", F.lit(d)), F.lit(0.0)).alias(f"p_{d.replace('-', '_')}")
    return out.select("doc_id", "n_tokens", *map(p, WEIGHTS), "rate")


QUERIES = {"op8_mixing": op8_mixing}
SQL: dict[str, str] = {}
