"""SimHash near-duplicates with pivot distance tables.

A fingerprint's distances to many reference fingerprints (pivots) are its coordinates. The Hamming distance is a metric,
so two fingerprints within d bits differ by at most d in every coordinate: pairs whose greatest coordinate difference is
over d are discarded, the rest verified bit by bit. Documents with one fingerprint are one class.

Which classes share a table: the fingerprint is cut into blocks; with d or fewer differing bits, enough blocks agree
(pigeonhole), so a class enters one table for each choice of agreeing blocks, and a table row is compared with rows of
its key only, in the order of its distance to the first pivot. Keys with very many classes are cut into pieces of
bounded size, and each pair of pieces is compared in a group of its own.

Similarity of shingle sets (similar_components) goes in two steps. Tables keyed by min-wise hashes and a wide distance of
fingerprints give groups that hold both ends of every similar pair; inside a group the sets themselves are compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, read_table, release
from .unionfind import Forest

#: Seed of the shingle hash, fixed by the operator's contract.
SEED = 42
#: Reference fingerprints.
PIVOTS = 16
#: Classes of one table key that are compared in one group.
GROUP_ROWS = 8192
#: Rows that a task gathers before it compares them; a key is never split here.
CHUNK_ROWS = 65_536
#: Tables of shingle sets, and the min-wise hashes that make up a key. A pair of similarity s shares a hash with
#: probability s, so one of 0.8 is in no common table with probability (1 - 0.8 ** 3) ** 32 = 1e-10.
TABLES, LEAST = 32, 3
#: Shingle sets of one group that are compared in one piece.
PIECE_SETS = 256

_FP = np.dtype("<u8")


def _splitmix(n: int) -> np.ndarray:
    """n words of the public splitmix64 sequence: the pivots, and what turns one shingle hash into several."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of size words, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lower-cased, ASCII white space alone separates
    n = len(words)
    if not n:
        return np.zeros(0, _FP)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], _FP)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - size] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())], _FP)


def fingerprint(text: str | None, size: int = 3, words: int = 1) -> np.ndarray:
    """words x 64 bits; a bit is 1 if it is set in over half of the shingle hashes. Further words hash the hashes."""
    return fingerprint_of(shingle_hashes(text, size), words)


def fingerprint_of(h: np.ndarray, words: int = 1) -> np.ndarray:
    out = np.zeros(words, _FP)
    if not len(h):
        return out
    for w, extra in enumerate([None, *_splitmix(words - 1)][:words]):
        x = h if extra is None else (h ^ extra) * np.uint64(0xBF58476D1CE4E5B9)
        if extra is not None:
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
        count = np.zeros(64, np.int64)
        for a in range(0, len(x), 1 << 16):
            part = np.ascontiguousarray(x[a : a + (1 << 16)])
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * count > len(h), bitorder="little").view(_FP)[0]
    return out


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bytes, first word first, lowest byte first. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, size, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary())], names=["doc_id", "fp"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def block_tables(bits: int, distance: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each table the bit ranges that form its key: every choice of blocks - distance out of blocks."""
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return [[(cuts[i], cuts[i + 1]) for i in chosen] for chosen in itertools.combinations(range(blocks), blocks - distance)]


def pivot_distances(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows x pivots; fp: rows x words."""
    return np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16) for p in pivots], 1)


def _coordinate(words: int) -> np.dtype:
    """The kind of number that holds a distance."""
    return np.dtype(np.uint8 if 64 * words < 256 else "<u2")


def with_pivots(classes: DataFrame, words: int) -> DataFrame:
    """The pivot distance table: classes (with a column fp) and at, the distances of fp to all pivots, computed here once."""
    names = classes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, width = _splitmix(PIVOTS * words).reshape(PIVOTS, words), PIVOTS * _coordinate(words).itemsize
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(names.index("fp")).to_pylist()), _FP).reshape(-1, words)
            raw = pivot_distances(fp, pivots).astype(_coordinate(words)).tobytes() if len(fp) else b""
            at = pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, at], names=[*names, "at"])

    return classes.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in classes.dtypes) + ", at binary")


def _keys(fp: np.ndarray, tables: list[list[tuple[int, int]]]) -> np.ndarray:
    """Rows x tables: the key of a row in a table (its bits, 63 at most)."""
    out = np.zeros((len(fp), len(tables)), np.int64)
    for t, ranges in enumerate(tables):
        key = np.zeros(len(fp), np.uint64)
        for a, b in ranges:
            while a < b:
                word, low = divmod(a, 64)
                n = min(b - a, 64 - low)
                key = (key << np.uint64(n)) | ((fp[:, word] >> np.uint64(low)) & np.uint64((1 << n) - 1))
                a += n
        out[:, t] = key.astype(np.int64)
    return out


def link_block(key: np.ndarray, fp: np.ndarray, at: np.ndarray, distance: int, tally: dict | None = None) -> np.ndarray:
    """Root position of each row of a block sorted by (key, first pivot's distance): a forest of the links inside keys.
    at: rows x pivots, their distances. tally gets the numbers of pairs met, discarded by coordinates, and verified."""
    forest = Forest(len(key))
    first, coordinates = at[:, 0].astype(np.int16), at.astype(np.int16)
    live = np.arange(len(key))
    step = 1
    while True:
        live = live[live + step < len(key)]
        other = live + step
        near = (key[live] == key[other]) & (first[other] - first[live] <= distance)
        live = live[near]
        if not len(live):
            return forest.label
        i, j = live, live + step
        apart = forest.label[i] != forest.label[j]
        i, j = i[apart], j[apart]
        if len(i):
            for a in range(0, len(i), 1 << 18):
                x, y = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
                keep = np.abs(coordinates[x] - coordinates[y]).max(axis=1) <= distance
                if tally is not None:
                    for name, n in (("met", len(x)), ("discarded", int((~keep).sum())), ("verified", int(keep.sum()))):
                        tally[name] = tally.get(name, 0) + n
                x, y = x[keep], y[keep]
                keep = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1) <= distance
                forest.add(x[keep], y[keep])
        step += 1


ROWS = "tab int, key long, first short, rep long, fp binary, at binary"


def _distances(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _coordinate(words)).reshape(-1, PIVOTS)


def _table_rows(tables: list, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), _FP).reshape(-1, words)
                n = len(fp)
                key = _keys(fp, tables)
                first = pa.array(_distances(part.column(2), words)[:, 0].astype(np.int16))
                for t in range(len(tables)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(key[:, t]), first, *part.columns[:3]], names=["tab", "key", "first", "rep", "fp", "at"])

    return run


def _link_rows(distance: int, words: int):
    """Arrow function over rows sorted by (tab, key, i, j, first): (rep, root) for rows that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compare(group, at, rep, fp):
            change = np.any(np.stack([np.diff(g, prepend=g[:1]) != 0 for g in group]), axis=0)
            run_id = np.cumsum(change)
            size = np.bincount(run_id)
            keep = size[run_id] > 1
            if not keep.any():
                return None
            run_id, at, rep, fp = run_id[keep], at[keep], rep[keep], fp[keep]
            root = link_block(run_id, fp, at, distance)
            out = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(rep[root[out]])], names=["rep", "root"]) if len(out) else None

        def merged():
            columns = [np.concatenate(c) for c in zip(*held)]
            return columns[:4], columns[4], columns[5], columns[6]

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            fp = np.frombuffer(b"".join(batch.column(6).to_pylist()), _FP).reshape(-1, words)
            held.append((*cols[:4], _distances(batch.column(7), words), cols[5], fp))
            if sum(len(h[0]) for h in held) >= CHUNK_ROWS:
                group, at, rep, fp = merged()
                ends = np.flatnonzero(np.any(np.stack([np.diff(g) != 0 for g in group]), axis=0)) + 1
                cut = int(ends[-1]) if len(ends) else 0  # the last group may go on
                if cut and (got := compare([g[:cut] for g in group], at[:cut], rep[:cut], fp[:cut])) is not None:
                    yield got
                held = [(*(g[cut:] for g in group), at[cut:], rep[cut:], fp[cut:])]
        if held:
            group, at, rep, fp = merged()
            if len(rep) and (got := compare(group, at, rep, fp)) is not None:
                yield got
        held.clear()
        release()

    return run


def in_pieces(rows: DataFrame, key: list[str], most: int, tag: str) -> DataFrame:
    """rows (with a column rep) and the columns i, j: a key with over most rows is cut by hash into pieces, and a row goes to
    each pair of pieces that its own piece is in."""
    large = rows.groupBy(*key).count().where(F.col("count") > most).select(*key, F.ceil(F.col("count") / F.lit(float(most))).cast("int").alias("n"))
    large = materialize(large, tag)
    if large.isEmpty():
        return rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    own = F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1), lambda b: F.struct(F.least(b, F.coalesce(own, F.lit(0))).alias("i"), F.greatest(b, F.coalesce(own, F.lit(0))).alias("j")))
    return rows.join(large, key, "left").select(*rows.columns, F.explode(pieces).alias("p")).select(*rows.columns, "p.i", "p.j")


def linked_classes(rows: DataFrame, distance: int, words: int) -> DataFrame:
    """(node, component) of the classes that link, from their table rows (ROWS)."""
    rows = in_pieces(rows, ["tab", "key"], GROUP_ROWS, "fingerprint-keys").select("tab", "key", "i", "j", "first", "rep", "fp", "at")
    rows = rows.repartition("tab", "key", "i", "j").sortWithinPartitions("tab", "key", "i", "j", "first")
    return components(rows.mapInArrow(_link_rows(distance, words), "rep long, root long").distinct())


def link_fingerprints(fps: DataFrame, distance: int, tables: list, words: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): fingerprints within distance bits that share a table are linked;
    component_id is the smallest doc_id reachable.

    Each distinct fingerprint is compared once, whatever the number of its documents.
    """
    cls = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    cls = materialize(with_pivots(cls.select("rep", "fp"), words), "fingerprint-classes")
    comp = linked_classes(cls.mapInArrow(_table_rows(tables, words), ROWS), distance, words)
    known = cls.join(comp, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(known, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits of a one-word fingerprint, highest first."""
    return F.lower(F.concat(*(F.hex(F.substring(fp, i, 1)) for i in range(8, 0, -1))))


def simhash_components(docs: DataFrame, distance: int = 3, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs; exact for distance up to 3.

    Null and empty texts have fingerprint zero and link like any other; whole texts count. A row without id is returned
    with its fingerprint and the component of its equals, null if no row with an id has that fingerprint; it links
    nothing. Repeated ids are one document with several fingerprints: each row gets its own fingerprint's component.
    """
    fps = materialize(fingerprints(docs, size, 1, id_col, text_col), "fingerprints")
    out = link_fingerprints(fps, distance, block_tables(64, distance, distance + 2))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


_FACTORS = _splitmix(TABLES * LEAST) | np.uint64(1)


def least_keys(h: np.ndarray) -> np.ndarray:
    """For each table the key of a shingle set: LEAST min-wise hashes in one."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 1024):
        low = np.minimum(low, (_FACTORS[:, None] * h[None, a : a + 1024]).min(axis=1))
    key = np.zeros(TABLES, np.uint64)
    for r in range(LEAST):
        key = (key ^ low[r::LEAST]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def _same(h: np.ndarray) -> bytes:
    """Tells shingle sets apart."""
    return xxhash.xxh3_128_digest(h.tobytes())


def _sketches(size: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fp, keys = [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), size)
                same.append(_same(h))
                fp.append(fingerprint_of(h, words).tobytes())
                keys.append(least_keys(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in (same, fp, keys))], names=["doc_id", "same", "fp", "keys"])
        release()

    return run


def _least_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                n = part.num_rows
                first = pa.array(_distances(part.column(2), words)[:, 0].astype(np.int16))
                key = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64).reshape(n, TABLES)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.ascontiguousarray(key[:, t])), first, *part.columns[:3]], names=["tab", "key", "first", "rep", "fp", "at"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(text.as_py(), size) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_same(h) for h in made], pa.binary()), pa.array([h.tobytes() for h in made], pa.binary())], names=["rep", "same", "hashes"])
        release()

    return run


def link_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Root position of each of the sets (distinct sorted numbers): a forest of the pairs of that Jaccard similarity or more.

    Sets go by size, so those that one can be similar to are a run; pairs already in one tree are not compared."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[k]) for k in order], np.int64)
    every, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    forest = Forest(len(sets))
    mark = np.zeros(len(every), np.int32)
    for i in np.flatnonzero(size):
        high = int(np.searchsorted(size, size[i] / similarity + 1e-6, "right"))
        label = forest.label
        if high <= i + 1 or (label[order[i + 1 : high]] == label[order[i]]).all():
            continue
        own = flat[starts[i] : ends[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[starts[i + 1] : ends[high - 1]]], starts[i + 1 : high] - starts[i + 1])
        mark[own] = 0
        near = np.flatnonzero(both >= similarity * (size[i] + size[i + 1 : high] - both) - 1e-9)
        forest.add(np.full(len(near), order[i]), order[i + 1 + near])
    return forest.label


def _link_set_rows(similarity: float):
    """Arrow function over rows (component, i, j, rep, hashes) sorted by the first three: (rep, root) for rows that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reps, sets = None, [], []

        def compare():
            rep = np.array(reps, np.int64)
            root = link_sets(sets, similarity)
            out = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(rep[root[out]])], names=["rep", "root"])

        for batch in batches:
            for *group, rep, hashes in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if group != held:
                    if len(reps) > 1:
                        yield compare()
                    held, reps, sets = group, [], []
                reps.append(rep)
                sets.append(np.frombuffer(hashes.as_py(), _FP))
        if len(reps) > 1:
            yield compare()
        release()

    return run


def similarity_distance(similarity: float, bits: int) -> int:
    """Differing bits that pairs of that Jaccard similarity stay under: the number expected and nine standard deviations
    (the expectation is that of large sets; of 4 shingles against 5 it is two deviations more)."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 9 * math.sqrt(bits * share * (1 - share)))


def similar_components(docs: DataFrame, similarity: float = 0.8, size: int = 5, words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): documents whose sets of shingles of size words have a Jaccard similarity of at least that are
    linked; component_id is the smallest doc_id reachable.

    Fingerprints of words x 64 bits that share a table and are not too far apart make up groups; what links in a group is
    told by the sets themselves, so no pair below the similarity links. A text of fewer words is one shingle. Null and
    empty texts are one group, as are texts of one set.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fps = materialize(text.mapInArrow(_sketches(size, words), "doc_id long, same binary, fp binary, keys binary"), "fingerprints")
    cls = fps.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    cls = materialize(with_pivots(cls.select("rep", "fp", "keys", "same"), words), "fingerprint-classes")
    wide = linked_classes(cls.select("rep", "fp", "at", "keys").mapInArrow(_least_rows(words), ROWS), similarity_distance(similarity, 64 * words), words)
    members = materialize(cls.join(wide, F.col("rep") == F.col("node")).select("rep", "same", "component"), "near-members")
    sets = text.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets(size), "rep long, same binary, hashes binary")
    sets = sets.dropDuplicates(["rep", "same"]).join(in_pieces(members, ["component"], PIECE_SETS, "near-pieces"), ["rep", "same"])
    sets = sets.select("component", "i", "j", "rep", "hashes").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    comp = components(sets.mapInArrow(_link_set_rows(similarity), "rep long, root long").distinct())
    known = cls.join(comp, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    return fps.select("doc_id", "same").join(known, "same", "left").select("doc_id", "component_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_dedup": op10_simhash_dedup}
SQL: dict[str, str] = {}
