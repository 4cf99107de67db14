"""Greedy word-piece lengths by a longest-match automaton that builds no pieces.

The vocabulary is a trie whose nodes carry a failure link and the number of tokens popped when it is followed. Scanning
a word moves through the trie one symbol at a time; when no edge fits, the failure link stands for emitting the longest
pieces so far, and its count is added. Every symbol is consumed once and each failure shortens the pending text, so the
time is linear in the word, whatever the vocabulary.

Words are the runs of characters other than ASCII white space, lower-cased, as UTF-8 bytes followed by one end mark: a
vocabulary piece "xyz</w>" ends a word, any other piece cannot.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: The public vocabulary used in production; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: The symbol that ends a word, outside the byte range.
END = 256
#: Words of which a worker remembers the count at most; beyond that the memory starts anew.
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The public byte-to-character rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """Pieces as symbol sequences, from a tokenizer file with word ends "</w>"."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    to_byte = byte_alphabet()
    pieces = []
    for piece in vocab:
        end = piece.endswith("</w>")
        body = piece[:-4] if end else piece
        if all(c in to_byte for c in body) and (body or end):
            pieces.append((*(to_byte[c] for c in body), *((END,) if end else ())))
    return pieces


class LongestMatch:
    """Automaton over pieces (sequences of symbols); count() gives how many pieces greedy longest match takes.

    Where no piece starts at a symbol, the whole word is one unknown piece, as in word-piece coding.
    """

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.whole = [False]
        for piece in pieces:
            at = 0
            for x in piece:
                if x not in self.next[at]:
                    self.next[at][x] = len(self.next)
                    self.next.append({})
                    self.whole.append(False)
                at = self.next[at][x]
            self.whole[at] = True
        # fail[v], popped[v]: the node of what is left and the count of pieces emitted when nothing follows v; -1: stuck
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        todo = [(v, 0, x) for x, v in self.next[0].items()]
        for v, parent, x in todo:  # breadth first: shorter strings are ready
            if self.whole[v]:
                self.fail[v], self.popped[v] = 0, 1
            else:
                at, n = self.fail[parent], self.popped[parent]
                while at >= 0 and x not in self.next[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.popped[v] = self.next[at][x], n
            todo += [(w, v, y) for y, w in self.next[v].items()]

    def count(self, word: Iterable[int]) -> int:
        nxt, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for x in (*word, END):
            while (to := nxt[at].get(x)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at:  # what is pending is emitted
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


def greedy_count(word: bytes, pieces: set[tuple[int, ...]]) -> int:
    """The plain rule, for tests: longest piece first, again and again; 1 if some symbol starts no piece."""
    left, n = (*word, END), 0
    while left:
        k = next((k for k in range(len(left), 0, -1) if left[:k] in pieces), 0)
        if not k:
            return 1
        left, n = left[k:], n + 1
    return n


_AUTOMATA: dict[int, tuple[LongestMatch, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, pieces: list[tuple[int, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens), one row for each row of docs; the whole text counts.

    The vocabulary is broadcast (its size is that of a published file); no shuffle. Null and empty texts have no words
    and no tokens; very long words cost time in proportion; repeated rows give repeated results; other columns are not
    read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(pieces)
    key = hash(tuple(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[key] = (LongestMatch(shared.value), {})
        automaton, known = _AUTOMATA[key]
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                n = m = 0
                for w in (text or "").lower().encode().split():
                    k = known.get(w)
                    if k is None:
                        k = automaton.count(w)
                        if len(w) <= 64:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            known[w] = k
                    n += 1
                    m += k
                words.append(n)
                tokens.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), load_vocabulary())


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
