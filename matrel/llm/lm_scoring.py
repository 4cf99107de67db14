"""Cross-entropy difference scores from matched n-gram models.

A target and a background bigram model share one vocabulary (every word of the corpus, or the most frequent ones if a limit
is given; an unknown word and a text boundary) and one form: p(w | v) = (c(v, w) + MASS * p(w)) / (c(v) + MASS) with p(w) = (c(w) + 1) / (N + V). A
document's score is the mean over its tokens of log p_target - log p_background; higher is nearer to the target.

Counts cover every document and stay spread over the cluster. Words and bigrams are 63-bit hashes, told apart by the lowest
bit. A chunk of documents sends each distinct word and bigram it holds once, with its counts, to the group that owns it;
the group adds the counts of all chunks up and answers each chunk for what it asked about. Nothing that grows with the
corpus is broadcast; a limited vocabulary is.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ANSWER, ANSWER_ARROW, Chunk, ask, groups_of, write_chunks
from .common import materialize, read_table

#: In place of a word's hash: a text's ends, and words outside a limited vocabulary.
BOUNDARY, UNKNOWN = 2, 4
#: Weight of the unigram model in a bigram probability, in counts.
MASS = 50.0
_TARGET, _COUNTS, _TOTALS = 0, 1, 2


def _target_ids(answers: dict) -> set[int]:
    raw = answers.get((_TARGET, 0))
    return set(np.frombuffer(raw, np.int64).tolist()) if raw else set()


def words_of(raw: bytes) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z in lower case."""
    return raw.lower().split()


def _word_rows(groups: int):
    def run(chunk: Chunk, answers: dict) -> pa.Table:
        """Each distinct word of the chunk with its count in all and in target documents, by group."""
        target = _target_ids(answers)
        counts: dict[bytes, list[int]] = {}
        for key, a, b in zip(chunk.keys(), chunk.starts.tolist(), chunk.ends.tolist()):
            t = int(key in target)
            for w in words_of(chunk.data[a:b]):
                c = counts.get(w)
                if c is None:
                    counts[w] = [1, t]
                else:
                    c[0] += 1
                    c[1] += t
        by: dict[int, list[bytes]] = {}
        for w in counts:
            by.setdefault(crc32(w) % groups, []).append(w)
        rows = []
        for g, words in sorted(by.items()):
            words.sort()
            n = np.array([counts[w] for w in words], "<u4")
            rows.append((chunk.number, 0, g, zstandard.ZstdCompressor(level=1).compress(len(words).to_bytes(8, "little") + np.ascontiguousarray(n.T).tobytes() + b" ".join(words))))
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), ANSWER_ARROW)] if rows else [pa.array([], t.type) for t in ANSWER_ARROW], schema=ANSWER_ARROW)

    return run


def _add_words(most: int):
    def run(table: pa.Table) -> pa.Table:
        """The counts of a group's words over all chunks; of these the most frequent, as no others can be in the vocabulary."""
        total: dict[bytes, list[int]] = {}
        every, targets = 0, 0
        for value in table["value"].to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(value)
            n = int.from_bytes(raw[:8], "little")
            c = np.frombuffer(raw, "<u4", 2 * n, 8).reshape(2, n)
            every, targets = every + int(c[0].sum()), targets + int(c[1].sum())
            for w, a, b in zip(raw[8 + 8 * n :].split(b" "), c[0].tolist(), c[1].tolist()):
                have = total.get(w)
                if have is None:
                    total[w] = [a, b]
                else:
                    have[0] += a
                    have[1] += b
        top = sorted(total, key=lambda w: (-total[w][0], w))[:most]
        rest = [every - sum(total[w][0] for w in top), targets - sum(total[w][1] for w in top)]  # words left out, as one row
        return pa.table({"word": pa.array([*(w.decode() for w in top), None], pa.string()), "n": pa.array([*(total[w][0] for w in top), rest[0]], pa.int64()), "t": pa.array([*(total[w][1] for w in top), rest[1]], pa.int64())})

    return run


class Tokens:
    """The tokens of a chunk, told by places in every: the hashes of its distinct words and then of its distinct pairs. first
    and word are the places of a token's history and of itself, pair that of both; sizes tells the texts apart."""

    def __init__(self, chunk: Chunk, known: frozenset | None):
        offsets = np.concatenate([[0], chunk.ends]).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(chunk.sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(chunk.data))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # as words_of
        coded = split.flatten().dictionary_encode()
        local = coded.dictionary.cast(pa.large_binary()).to_pylist()
        hashes = [BOUNDARY, *(xxhash.xxh3_64_intdigest(w) & ~1 if known is None or w in known else UNKNOWN for w in local)]
        words, at = np.unique(np.array(hashes, np.uint64), return_inverse=True)
        token, ends = coded.indices.to_numpy(), split.offsets.to_numpy()[1:].astype(np.int64)
        if b"" in local:  # beside white space at a text's ends
            full = token != local.index(b"")
            token, ends = token[full], np.concatenate([[0], np.cumsum(full)])[ends]
        starts = np.concatenate([[0], ends[:-1]])
        self.sizes = ends - starts + 1  # with the end of the text
        # a token after each text, which is the end of that and the beginning of the next
        self.word = np.insert(at[token + 1], ends, at[0])
        self.first = np.concatenate([[at[0]], self.word[:-1]])
        x, y = words[self.first], words[self.word]
        key = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        pairs, pair = np.unique(((key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) | np.uint64(1), return_inverse=True)
        used = np.bincount(self.word, minlength=len(words)) > 0  # white space alone brought the empty word
        if not used.all():
            place = np.cumsum(used) - 1
            words, self.word, self.first = words[used], place[self.word], place[self.first]
        self.every, self.pair = np.concatenate([words, pairs]), pair + len(words)

    def counts(self, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """How often each of every occurs among some tokens."""
        return np.bincount(np.concatenate([self.word[of], self.pair[of]]), minlength=len(self.every))


def _by_group(keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by group, bounds of the groups in it); within a group keys stay sorted."""
    group = (((keys >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(groups + 1))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _count_rows(shared, groups: int):
    def run(chunk: Chunk, answers: dict) -> pa.Table:
        target = _target_ids(answers)
        x = Tokens(chunk, shared and shared.value)
        every, count = x.every, x.counts()
        t = x.counts(np.repeat(np.array([key in target for key in chunk.keys()], bool), x.sizes))
        order, bounds = _by_group(every, groups)
        rows = []
        for g in np.flatnonzero(np.diff(bounds)):
            part = order[bounds[g] : bounds[g + 1]]
            raw = _planes(np.diff(every[part], prepend=np.uint64(0))) + _planes(count[part].astype(np.uint32)) + _planes(t[part].astype(np.uint32))
            rows.append((chunk.number, _COUNTS, int(g), zstandard.ZstdCompressor(level=1).compress(raw)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ANSWER_ARROW)], schema=ANSWER_ARROW)

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    """For each chunk the counts over all chunks of what it sent, in its order; and for chunk -1 the number of distinct words
    of the group and the sums of their counts."""
    asked = []
    for value in table["value"].to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(value)
        k = len(raw) // 16
        asked.append((np.cumsum(_numbers(raw[: 8 * k], np.uint64), dtype=np.uint64), _numbers(raw[8 * k : 12 * k], np.uint32), _numbers(raw[12 * k :], np.uint32)))
    cuts = np.cumsum([0, *(len(k) for k, _, _ in asked)])
    every, at = np.unique(np.concatenate([k for k, _, _ in asked]), return_inverse=True)
    n, t = (np.bincount(at, np.concatenate([a[c] for a in asked]), len(every)).astype(np.uint64) for c in (1, 2))
    values = [zstandard.ZstdCompressor(level=1).compress(_planes(n[i]) + _planes(t[i])) for i in (at[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
    word = every & np.uint64(1) == 0
    values.append(np.array([word.sum(), n[word].sum(), t[word].sum()], np.int64).tobytes())
    group = table["grp"].to_pylist()
    rows = ([*table["chunk"].to_pylist(), -1], [*table["kind"].to_pylist(), _TOTALS], [*group, group[0]], values)
    return pa.table([pa.array(c, f.type) for c, f in zip(rows, ANSWER_ARROW)], schema=ANSWER_ARROW)


class _Own:
    """How often a document holds the words and pairs of its own tokens; zero for documents outside mask."""

    def __init__(self, x: Tokens, mask: np.ndarray):
        self.inside = np.repeat(mask, x.sizes)
        starts = np.cumsum(x.sizes) - x.sizes
        size = x.sizes[mask]
        self.size = self._spread(np.repeat(size, size))
        word, pair = (self._same(side[self.inside], np.repeat(np.arange(len(size)), size), len(x.every)) for side in (x.word, x.pair))
        self.w, self.pair = self._spread(word), self._spread(pair)
        self.v = np.empty(len(self.w))
        self.v[1:] = self.w[:-1]  # a token's history is the token before it
        self.v[starts] = self.inside[starts]  # that of a text's first one is its beginning, which it holds once

    def _spread(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.inside))
        out[self.inside] = values
        return out

    @staticmethod
    def _same(place: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
        """How often each token's place occurs in its document."""
        key = doc * width + place
        order = np.argsort(key)
        lead = np.flatnonzero(np.diff(key[order], prepend=-1))
        out = np.empty(len(key), np.int64)
        out[order] = np.repeat(np.diff(np.append(lead, len(key))), np.diff(np.append(lead, len(key))))
        return out


def _score_rows(shared, groups: int, size: int, totals: tuple[int, int], leave_out: bool):
    def run(chunk: Chunk, answers: dict) -> pa.Table:
        target = _target_ids(answers) if leave_out else set()
        x = Tokens(chunk, shared and shared.value)
        every = x.every
        order, bounds = _by_group(every, groups)
        n, t = np.zeros(len(every)), np.zeros(len(every))
        for g in np.flatnonzero(np.diff(bounds)):
            raw = zstandard.ZstdDecompressor().decompress(answers[_COUNTS, int(g)])
            part = order[bounds[g] : bounds[g + 1]]
            n[part], t[part] = _numbers(raw[: len(raw) // 2], np.uint64), _numbers(raw[len(raw) // 2 :], np.uint64)
        starts = np.cumsum(x.sizes) - x.sizes
        mask = np.array([key in target for key in chunk.keys()], bool)
        own = _Own(x, mask) if mask.any() else None
        losses = []
        for c, total, out in ((t, totals[1], own), (n, totals[0], None)):
            both, first, single = c[x.pair], c[x.first], c[x.word]
            if out is not None:
                both, first, single, total = both - out.pair, first - out.v, single - out.w, total - out.size
            losses.append(-np.add.reduceat(np.log((both + MASS * ((single + 1) / (total + size + 2))) / (first + MASS)), starts) / x.sizes)
        columns = (pa.array(chunk.keys(), pa.int64()), pa.array(x.sizes - 1, pa.int64()), pa.array(losses[0]), pa.array(losses[1]), pa.array(losses[1] - losses[0]))
        return pa.table(list(columns), names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return run


def _most_frequent(words: DataFrame, most: int) -> list:
    """The rows of the most frequent words. A histogram of counts (sixteenths of a doubling, so a thousand bins at most)
    tells which bins are in whole; only these and the bin at the edge are sorted, and only the result is collected."""
    bin_of = F.floor(F.log2(F.col("n").cast("double")) * 16)
    sizes = {r["b"]: r["count"] for r in words.groupBy(bin_of.alias("b")).count().collect()}
    have, edge = 0, 0
    for edge in sorted(sizes, reverse=True):
        have += sizes[edge]
        if have >= most:
            break
    return materialize(words.where(bin_of >= edge).orderBy(F.desc("n"), "word").limit(most), "lm-vocabulary").collect()


def score_documents(docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None, id_col: str = "doc_id", text_col: str = "text", leave_out: bool = True) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score), one row for each row of docs: mean losses per token in
    nats, the end of the text being a token, and their difference.

    target_ids: one column of ids; their documents, which are also in the background, make up the target model. With
    leave_out a target document's target loss is that of the model without its own counts, so that it is no nearer to
    the target than an equal new document. Null and empty texts have the end as their only token. Rows without id count in
    the background and are scored; repeated rows count each time. vocabulary: the number of most frequent words to tell
    apart, all words if None. Without any target document the target model is uniform. Other columns are not read.
    """
    if vocabulary is not None and vocabulary < 1:
        raise ValueError("vocabulary must be positive")
    spark = docs.sparkSession
    chunks = write_chunks(docs, id_col, text_col)
    groups = groups_of(chunks)

    def ids_of(chunk: Chunk, _: dict) -> pa.Table:
        return pa.table({"chunk": pa.array([chunk.number] * len(chunk.ids), pa.int64()), "doc_id": pa.array(chunk.keys(), pa.int64())})

    slim = chunks.select("chunk", "ids", *(F.lit(b"").alias(c) for c in ("sizes", "data", "rest")), F.lit(0).alias("bytes"))
    members = ask(slim, None, ids_of, "chunk long, doc_id long")
    wanted = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    hits = members.join(wanted, "doc_id", "left_semi").groupBy("chunk").agg(F.collect_set("doc_id").alias("ids"))  # a chunk's own ids at most

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_TARGET] * b.num_rows, pa.int32()), pa.array([0] * b.num_rows, pa.int32()), pa.array([np.array(x, np.int64).tobytes() for x in b.column(1).to_pylist()], pa.binary())], schema=ANSWER_ARROW)

    targets = materialize(hits.mapInArrow(pack, ANSWER), "lm-targets")
    shared = None
    if vocabulary is not None:
        words = materialize(ask(chunks, targets, _word_rows(groups), ANSWER).groupBy("grp").applyInArrow(_add_words(vocabulary), "word string, n long, t long"), "lm-words")
        shared = spark.sparkContext.broadcast(frozenset(r["word"].encode() for r in _most_frequent(words.where("word is not null"), vocabulary)))
    asked = ask(chunks, targets, _count_rows(shared, groups), ANSWER)
    counts = materialize(asked.groupBy("grp").applyInArrow(_add_counts, ANSWER), "lm-counts")
    sums = [np.frombuffer(r["value"], np.int64) for r in counts.where(F.col("chunk") == -1).select("value").collect()]  # one row a group
    found, all_n, all_t = (int(v) for v in np.sum(sums, axis=0)) if sums else (1, 0, 0)
    size = found - 1 if shared is None else len(shared.value)  # the boundary is counted as a word of its own
    answers = counts.where("chunk >= 0")
    return ask(chunks, answers.unionByName(targets) if leave_out else answers, _score_rows(shared, groups, size, (all_n, all_t), leave_out), "doc_id long, n_words long, target_loss double, background_loss double, score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents; the target is what labels marks as of high quality and not toxic."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_documents(docs, labels.where("quality = 1 and toxic = 0").select("doc_id"))


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
SQL: dict[str, str] = {}
