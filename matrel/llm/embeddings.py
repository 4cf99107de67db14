"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells.

Equal vectors of a label are one class. A class lives in the cell of its nearest centre (home) and probes each further
cell that may hold a partner: two unit vectors with cosine c are at most delta = sqrt(2 - 2c) apart, so a partner whose
home is cell b instead of a requires x.a - x.b <= delta * |a - b|. Hence every pair is met, whatever the centres are;
the centres decide the cost alone. In a cell each member is compared with the home members, in blocks; a block gives
counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, read_table
from .unionfind import Forest

#: Classes on which centres are fitted, at most (about: taken by hash).
SAMPLE_CLASSES = 20_000
#: Members that a cell should have, and rows of a block of a cell.
CELL_ROWS, BLOCK_ROWS = 1500, 2048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centres of unit rows; starts from rows that are far apart; deterministic."""
    centres = [x[0]]
    near = x @ x[0]
    for _ in range(1, k):
        j = int(near.argmin())
        if near[j] > 1 - 1e-9:
            break
        centres.append(x[j])
        near = np.maximum(near, x @ x[j])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def _unit(batch: list) -> np.ndarray:
    x = np.array(batch, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components would leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """Slim rows (vec_id, grp, h1, h2, x): grp is label and length; null unless the vector can link with others."""
    x = F.col("x")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    grp = F.when(fit, F.concat_ws(":", F.size(x).cast("string"), F.col("label").cast("string")))
    return vectors.withColumn("grp", grp).withColumn("h1", F.xxhash64(x)).withColumn("h2", F.xxhash64(F.lit(1), x))


def _cells(centres: dict[str, np.ndarray], delta: float):
    """Arrow function: (grp, rep, copies, x) to a row for each cell it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, rep, copies, x = (batch.column(i).to_pylist() for i in range(4))
            by: dict[str, list[int]] = {}
            for i, g in enumerate(grp):
                by.setdefault(g, []).append(i)
            for g, rows in by.items():
                for a in range(0, len(rows), 2000):
                    part = rows[a : a + 2000]
                    v = _unit([x[i] for i in part])
                    c = centres.get(g)
                    if c is None:
                        r, cell, home = np.arange(len(part)), np.zeros(len(part), int), np.zeros(len(part), int)
                    else:
                        s = v @ c.T
                        home = s.argmax(axis=1)
                        far = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))[home]
                        r, cell = np.nonzero(s[np.arange(len(part)), home][:, None] - s <= delta * far + 1e-9)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * len(r), pa.string()), pa.array(cell, pa.int32()), pa.array(cell == home[r], pa.bool_()), pa.array([rep[part[i]] for i in r], pa.int64()), pa.array([copies[part[i]] for i in r], pa.int64()), pa.array([v[i].tobytes() for i in r], pa.binary())],
                        names=["grp", "cell", "home", "rep", "copies", "v"],
                    )

    return run


def _links(least: float):
    """Arrow function over one block: counts of partners among the columns, and a forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        rep = table["rep"].to_numpy()
        v = np.frombuffer(b"".join(table["v"].to_pylist()), float).reshape(len(rep), -1)
        copies = table["copies"].to_numpy()
        row, col = (np.flatnonzero(table[c].to_numpy()) for c in ("as_row", "as_col"))
        links, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
        for a in range(0, len(row), 512):
            part = row[a : a + 512]
            i, j = np.nonzero(v[part] @ v[col].T >= least)
            i, j = part[i], col[j]
            other = i != j
            i, j = i[other], j[other]
            np.add.at(links, i, copies[j])
            forest.add(i, j)
        root = forest.label
        out = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
        return pa.table({"rep": pa.array(rep[out], pa.int64()), "links": pa.array(links[out], pa.int64()), "root": pa.array(rep[root[out]], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE_CLASSES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors; exact, for any centres.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with nothing
    (n_links 0, component their own id, kept). Vectors of one label but unequal lengths do not link. A row without id is
    returned alike (component null, kept true) and is no partner of others. Repeated rows are further copies: they link
    with each other. Centres come from a sample by hash (sample classes); a group that the sample missed is one cell.
    Cells and blocks are spread by hash, so a block has about BLOCK_ROWS rows on either side, however large its cell.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    v = classes(v)
    cls = v.where("grp is not null").groupBy("grp", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x"))
    cls = materialize(cls, "vector-classes")
    sizes = cls.count()
    spread = F.pmod(F.xxhash64("rep", F.lit("centres")), F.lit(1_000_000))
    picked = cls.where(spread < int(1_000_000 * min(1.0, sample / max(1, sizes)))).select("grp", "rep", "x").collect()
    by: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["grp"], r["rep"])):
        by.setdefault(r["grp"], []).append(r["x"])
    scale = sizes / max(1, len(picked))
    centres = {g: spherical_kmeans(_unit(x), int(min(max(1, len(x) * scale // CELL_ROWS), max(1, len(x) // 20)))) for g, x in by.items()}
    delta = float(np.sqrt(2 - 2 * least))
    cells = materialize(cls.select("grp", "rep", "copies", "x").mapInArrow(_cells(centres, delta), "grp string, cell int, home boolean, rep long, copies long, v binary"), "vector-cells")
    blocks = lambda n: F.ceil(n / F.lit(float(BLOCK_ROWS))).cast("int")
    counts = cells.groupBy("grp", "cell").agg(blocks(F.count("*")).alias("n_row"), F.greatest(F.lit(1), blocks(F.sum(F.col("home").cast("int")))).alias("n_col"))
    m = cells.join(counts, ["grp", "cell"])
    m = m.withColumn("ri", F.pmod(F.xxhash64("rep"), F.col("n_row")).cast("int")).withColumn("ci", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n_col")).cast("int"))
    as_rows = F.transform(F.sequence(F.lit(0), F.col("n_col") - 1), lambda j: F.struct(F.col("ri").alias("i"), j.alias("j")))
    as_cols = F.transform(F.sequence(F.lit(0), F.col("n_row") - 1), lambda i: F.struct(i.alias("i"), F.col("ci").alias("j")))
    m = m.select("grp", "cell", "home", "rep", "copies", "v", "ri", "ci", F.explode(F.array_union(as_rows, F.when(F.col("home"), as_cols).otherwise(F.slice(as_rows, 1, 0)))).alias("b"))
    m = m.select("grp", "cell", "b.i", "b.j", "rep", "copies", "v", (F.col("ri") == F.col("b.i")).alias("as_row"), (F.col("home") & (F.col("ci") == F.col("b.j"))).alias("as_col"))
    found = materialize(m.groupBy("grp", "cell", "i", "j").applyInArrow(_links(least), "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("rep <> root").select("rep", "root")).withColumnRenamed("node", "rep")
    facts = cls.select("grp", "h1", "h2", "rep", "copies").join(links, "rep", "left").join(comp, "rep", "left")
    facts = facts.select("grp", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = v.drop("x").join(facts, ["grp", "h1", "h2"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


_COSINE = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))"
QUERIES = {"op5_embedding_dedup": op5_embedding_dedup}
SQL = {
    "op5_embedding_dedup": f"""
        with recursive v as (
            select vec_id, label, list_transform(embedding, lambda z: cast(z as double)) as x from embeddings where label is not null and embedding is not null),
        n as (select vec_id, label, x, sqrt(list_sum(list_transform(x, lambda z: z * z))) as size from v),
        u as (select vec_id, label, list_transform(x, lambda z: z / size) as x from n where size > 0),
        l as (select a.vec_id as p, b.vec_id as q from u a join u b on a.label = b.label and a.vec_id < b.vec_id where {_COSINE} >= 0.98),
        e as (select p, q from l union all select q, p from l),
        r(node, other) as (select vec_id, vec_id from embeddings union select r.node, e.q from r join e on r.other = e.p),
        c as (select node, min(other) as component_id from r group by node),
        d as (select p, count(*) as n_links from e group by p)
        select c.node as vec_id, coalesce(d.n_links, 0) as n_links, c.component_id, c.node = c.component_id as kept from c left join d on d.p = c.node""",
}
