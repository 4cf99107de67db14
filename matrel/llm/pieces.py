"""SentencePiece coding and sampled segmentations without replacement.

encode/decode are those of the given model. Samples come from the lattice of all segmentations into the model's pieces:
each distinct unit (the text between possible piece boundaries: a run of spaces starts one, a line break is one) is
laid out once as a lattice whose edges carry conditional probabilities. A text is a chain of such lattices, so a
segmentation is a path, and the Gumbel-perturbed log probability of a set of paths is one Gumbel draw at the set's log
mass. A-star search over those sets gives the k best perturbed paths, which are k distinct samples without replacement:
the best set is split by its sampled path into "same edges up to here, another edge at this node", each with a draw
truncated at the path's own. With kappa the best perturbed value that is left, a path of log probability f was included
with score 1 - exp(-exp(f - kappa)).

All draws are hashes of (seed, row key, sample, unit, step), so a row's samples depend on its key and text alone.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, release

#: The public model used in production; a parameter of the operators.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the model format: the mark of a space; scores at or under this are pieces out of the ranking.
SPACE = "▁"
UNUSED = -1e8
#: Units whose lattices a task keeps from one group of texts to the next, at most; the first ones met, so the common ones.
KEPT_UNITS = 90_000
#: Further units that are kept until they are as many.
SPARE_UNITS = 60_000
#: Edges of the store beyond those of kept units that stay allocated.
MOST_SPARE_EDGES = 4_000_000
#: Characters of texts that are laid out together.
GROUP_CHARS = 400_000

#: Characters that usual normalisers change, and runs of spaces.
PROBE = "  a   " + "".join(c for c in map(chr, (*range(0x21, 0xD800), *range(0xE000, 0x10000))) if c != SPACE and (c != c.lower() or not unicodedata.is_normalized("NFKC", c))) + "  "

_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
_MASK = (1 << 64) - 1


def load_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def piece_weights(sp: sentencepiece.SentencePieceProcessor, alpha: float = 1.0) -> tuple[dict[str, tuple[int, float]], float]:
    """({piece: (id, log weight)}, log weight of a byte of an unknown character).

    A model of merges holds ranks, not probabilities (its scores are 0, -1, -2, ...): the weight of rank r is taken by
    Zipf's law as (r + 10) ** -alpha. Control, byte and unused pieces are no edges; single characters and runs of spaces always are.
    """
    found, size = {}, sp.get_piece_size()
    for i in range(size):
        piece, score = sp.id_to_piece(i), sp.get_score(i)
        if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)) and (score > UNUSED or not piece.strip(SPACE) or len(piece) == 1):
            found[piece] = (i, -alpha * math.log(10 + min(-score, size)))
    return found, -alpha * math.log(size + 10)


def units(text: str) -> list[str]:
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def distinct_units(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each unit of all texts in a row, the distinct units, where each text's units end): units() of many texts,
    by a mark put between units, a character that none of the texts holds."""
    used = set().union(*texts)
    mark = next((c for c in map(chr, (*range(1, 9), *range(0xE000, 0xF900))) if c not in used), None)
    if mark is None:
        split = pa.array([units(t) for t in texts], pa.large_list(pa.large_string()))
    else:
        new_line = f"{mark}\n{mark}"
        marked = [(SPACE + t.replace(" ", SPACE)).replace(SPACE, mark + SPACE).replace(SPACE + mark, SPACE).replace("\n", new_line) if t else "" for t in texts]
        split = pc.split_pattern(pa.array(marked, pa.large_string()), mark)
    coded = split.flatten().dictionary_encode()
    which, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    ends = split.offsets.to_numpy()[1:].astype(np.int64)
    if "" in distinct:  # marks lie at the beginning of a text and between neighbouring marks
        void = distinct.index("")
        full = which != void
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        which = which[full]
        which, distinct = which - (which > void), distinct[:void] + distinct[void + 1 :]
    return which, distinct, ends


class Lattices:
    """Lattices of distinct units in flat arrays: a node for each character; the edges of a node lie together."""

    def __init__(self, sp: sentencepiece.SentencePieceProcessor, pieces: dict[str, tuple[int, float]], byte_weight: float, kept: int = KEPT_UNITS):
        self.byte_weight, self.kept = byte_weight, kept
        names = sorted(pieces)
        if sp.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("a model whose normaliser changes texts")
        if any("\n" in p and len(p) > 1 or SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("pieces that cross units")
        chars = sorted(set("".join(names)))
        self.most = max(map(len, names), default=1)
        # the trie of pieces: edges as sorted numbers parent * width + character class
        self.chars = np.array([ord(c) for c in chars], np.int64)
        self.width = len(chars) + 1
        self.class_of = np.full(0x110000, self.width - 1, np.int32)  # the last class: characters of no piece
        self.class_of[self.chars] = np.arange(len(chars))
        rank = {c: i for i, c in enumerate(chars)}
        child: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, p in enumerate(names):
            at = 0
            for c in p:
                at = child.setdefault((at, rank[c]), len(child) + 1)
            ends[at] = k
        self._hash_edges(np.array([v * self.width + c for v, c in child], np.int64), np.fromiter(child.values(), np.int64, len(child)))
        self.root = np.zeros(self.width, np.int64)
        for (v, c), to in child.items():
            if v == 0:
                self.root[c] = to
        self.ends = np.full(len(child) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.piece = np.array([pieces[p][0] for p in names], np.int32)
        self.weight = np.array([pieces[p][1] for p in names])
        self.forget()

    def forget(self) -> None:
        """Empty the store of units; the trie stays."""
        self.index: dict[str, int] = {}  # units that are kept
        self.known: dict[str, int] = {}  # these and the units met lately, of higher numbers
        self.units = self.nodes = self.edges = 0  # in use; the arrays below have room for more
        self.units_kept = self.nodes_kept = self.edges_kept = 0
        self.first = np.zeros(0, np.int64)
        self.start, self.degree = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.to, self.id, self.source = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.logq, self.cum = np.zeros(0), np.zeros(0)

    def _hash_edges(self, key: np.ndarray, to: np.ndarray) -> None:
        """The trie's edges as an open hash table."""
        self.bits = max(4, (2 * len(key)).bit_length())
        self.slot_key, self.slot_to = np.full((1 << self.bits) + len(key), -1, np.int64), np.zeros((1 << self.bits) + len(key), np.int64)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.slot_key[at[left]] < 0]
            self.slot_key[at[free]], self.slot_to[at[free]] = key[free], to[free]  # of several for one slot the last one has it
            left = left[self.slot_key[at[left]] != key[left]]
            at[left] += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _child(self, key: np.ndarray) -> np.ndarray:
        """The trie node that an edge leads to; 0 if there is no such edge."""
        at = self._slot(key)
        have = self.slot_key[at]
        to = np.where(have == key, self.slot_to[at], 0)
        left = np.flatnonzero((have != key) & (have >= 0))
        while len(left):
            at[left] += 1
            have = self.slot_key[at[left]]
            hit = have == key[left]
            to[left[hit]] = self.slot_to[at[left[hit]]]
            left = left[~hit & (have >= 0)]
        return to

    def _store(self, name: str, at: int, values: np.ndarray) -> None:
        """Put values into an array of the store, which is made longer if it has no room."""
        have, need = getattr(self, name), at + len(values)
        if need > len(have):
            have, old = np.empty(need + need // 4, have.dtype), have
            have[:at] = old[:at]
            setattr(self, name, have)
        have[at:need] = values

    def _matches(self, codes: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from one on, (node, piece) of all pieces of that length inside units; codes: the characters,
        last: the node after each unit's end."""
        cls = self.class_of[codes]
        node, at, length, found = np.arange(len(codes)), self.root[cls], 1, []
        while True:
            live = at > 0
            node, at = node[live], at[live]
            if not len(node):
                break
            k = self.ends[at]
            hit = k >= 0
            found.append((node[hit], k[hit]))
            inside = node + length < last[node]
            node, at = node[inside], at[inside]
            at = self._child(at * self.width + cls[node + length])
            length += 1
        return found

    def add(self, new: list[str]) -> None:
        """Lay out units that are not in the index."""
        if not new:
            return
        size = np.fromiter(map(len, new), np.int64, len(new))
        head = np.cumsum(size) - size
        codes = np.frombuffer("".join(new).encode("utf-32-le"), "<u4").astype(np.int64)
        n = len(codes)
        last = np.repeat(head + size, size)
        found = self._matches(codes, last)
        degree = np.zeros(n, np.int32)
        for node, _ in found:
            degree[node] += 1
        single = np.zeros(n, bool)
        if found:
            single[found[0][0]] = True
        bare = np.flatnonzero(~single)
        degree[bare] += 1
        # nodes by their distance from the end of their unit; the edges of a node lie together, long ones first
        rest_of = last - np.arange(n)
        near = int(rest_of.max())
        order = np.argsort(rest_of.astype(np.uint16) if near < 1 << 16 else rest_of, kind="stable")
        degree_at = degree[order]
        lead = np.cumsum(degree_at, dtype=np.int64) - degree_at
        start, place = np.empty(n, np.int64), np.empty(n, np.int64)
        start[order], place[order] = lead, lead + degree_at
        many = int(lead[-1] + degree_at[-1])
        target, ident, weight = np.empty(many, np.int64), np.empty(many, np.int32), np.empty(many)
        if len(bare):
            c = codes[bare]
            place[bare] -= 1
            at = place[bare]
            target[at], ident[at] = np.where(rest_of[bare] == 1, -1, bare + 1), -1 - c
            weight[at] = self.byte_weight * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        for length, (node, p) in enumerate(found, 1):
            place[node] -= 1
            at = place[node]
            target[at], ident[at], weight[at] = np.where(rest_of[node] == length, -1, node + length), self.piece[p], self.weight[p]
        source = np.repeat(order, degree_at)
        beta = np.zeros(n + 1)  # the last entry stands for a unit's end
        step = np.cumsum(np.bincount(rest_of)).tolist()
        for x, y in zip(step, step[1:]):  # all nodes at one distance from their unit's end
            a, b = lead[x], lead[y] if y < n else many
            v = weight[a:b] + beta[target[a:b]]
            at = lead[x:y] - a
            top = np.maximum.reduceat(v, at)
            beta[order[x:y]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, degree_at[x:y])), at))
        logq = np.minimum(weight + beta[target] - beta[source], 0.0)
        q, cum = np.exp(logq), np.empty(len(logq))
        so_far, live, k = np.zeros(len(lead)), np.arange(len(lead)), 0
        while len(live := live[degree_at[live] > k]):
            so_far[live] += q[lead[live] + k]
            cum[lead[live] + k] = so_far[live]
            k += 1
        units, nodes, edges = self.units, self.nodes, self.edges
        target[target >= 0] += nodes
        for name, at, values in (
            ("first", units, head + nodes), ("start", nodes, start + edges), ("degree", nodes, degree),
            ("to", edges, target), ("id", edges, ident), ("source", edges, source + nodes), ("logq", edges, logq), ("cum", edges, cum),
        ):
            self._store(name, at, values)
        self.units, self.nodes, self.edges = units + len(new), nodes + n, edges + many

    def trim(self) -> None:
        """Forget the units beyond those that are kept, if there are many."""
        if len(self.known) - len(self.index) > SPARE_UNITS:
            self.known = dict(self.index)
            self.units, self.nodes, self.edges = self.units_kept, self.nodes_kept, self.edges_kept
            for name, n in (("to", self.edges), ("id", self.edges), ("source", self.edges), ("logq", self.edges), ("cum", self.edges)):
                if len(getattr(self, name)) > 2 * n + MOST_SPARE_EDGES:  # one very long group made them long
                    setattr(self, name, getattr(self, name)[:n].copy())

    def look_up(self, texts: list[str]) -> list[np.ndarray]:
        """Index of each unit of each text; lays out those that are new."""
        which, distinct, ends = distinct_units(texts)
        at = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        new = [distinct[i] for i in missing.tolist()]
        room = max(0, self.kept - len(self.index)) if len(self.known) == len(self.index) else 0
        at[missing] = self.units + np.arange(len(new))
        numbered = list(zip(new, range(self.units, self.units + len(new))))
        self.known.update(numbered)
        if room:
            self.index.update(numbered[:room])
            self.add(new[:room])
            self.units_kept, self.nodes_kept, self.edges_kept = self.units, self.nodes, self.edges
        self.add(new[room:])
        return np.split(at[which], ends[:-1])


def _mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, on unsigned words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, a, b) -> np.ndarray:
    """Numbers in (0, 1) from a key and two counters."""
    x = _mix(key + np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(lat: Lattices, node: np.ndarray, key: np.ndarray, unit: np.ndarray, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sample every unit from its node to its end: (owner, edge), the edges of an owner in order."""
    owner, owners, edges = np.arange(len(node)), [], []
    while len(owner):
        u = uniform(key[owner], unit[owner], step)
        e = lat.start[node]
        stop = e + lat.degree[node] - 1
        todo = np.flatnonzero((u >= lat.cum[e]) & (e < stop))
        while len(todo):
            e[todo] += 1
            todo = todo[(u[todo] >= lat.cum[e[todo]]) & (e[todo] < stop[todo])]
        owners.append(owner)
        edges.append(e)
        node = lat.to[e].astype(np.int64)
        go = node >= 0
        owner, node, step = owner[go], node[go], step + 1
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.zeros(len(unit), np.int64)
    for o in owners:
        count[o] += 1
    at = np.cumsum(count) - count
    edge = np.empty(int(count.sum()), np.int64)
    for k, (o, e) in enumerate(zip(owners, edges)):
        edge[at[o] + k] = e
    return np.repeat(np.arange(len(unit)), count), edge


def sample_paths(lat: Lattices, rows: list[np.ndarray], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each row (its unit indexes): up to k samples (edges, log probability, perturbed value, inclusion score) by
    falling perturbed value. Fewer only if the lattice has fewer paths; a row without units has one empty path."""
    out: list[list] = [[] for _ in rows]
    base = np.array(keys, np.uint64)
    root = -np.log(-np.log(uniform(base, 0, (1 << 40) + 1))) if len(rows) else base
    # a set of paths: value (negated, as heaps give the least), tie, path it was split from, position, unit, edges that are out
    heaps: list[list] = [[(-float(g), 0, None, 0, -1, ())] for g in root]
    drawn = [0] * len(rows)
    for s in range(k):
        todo = [i for i in range(len(rows)) if heaps[i]]
        if not todo:
            break
        streams = base + np.uint64(((s + 1) * 0xA0761D6478BD642F) & _MASK)
        popped = [heapq.heappop(heaps[i]) for i in todo]
        heads: list = [(value, None, None, 0, ()) for value, *_ in popped]
        begin = [0] * len(todo)
        split = [n for n, x in enumerate(popped) if x[2] is not None]
        if split:  # another edge at the node where the set leaves its path, then on to the unit's end
            stream = streams[[todo[n] for n in split]]
            unit_of = np.array([popped[n][4] for n in split])
            draw = uniform(stream, unit_of, np.array([(1 << 41) + popped[n][3] for n in split]))
            source = lat.source[[popped[n][2][0][popped[n][3]] for n in split]]
            picks = []
            for n, u, first, degree in zip(split, draw.tolist(), lat.start[source].tolist(), lat.degree[source].tolist()):
                gone = popped[n][5]
                options = [e for e in range(first, first + degree) if e not in gone]
                sums = list(itertools.accumulate(np.exp(lat.logq[options]).tolist()))
                picks.append(options[min(bisect.bisect_right(sums, u * sums[-1]), len(options) - 1)])
            node = lat.to[picks].astype(np.int64)
            go = np.flatnonzero(node >= 0)
            owner, more = walk(lat, node[go], stream[go], unit_of[go], step=1000)
            ends = np.zeros(len(split), np.int64)
            ends[go] = np.bincount(owner, minlength=len(go))
            ends = np.cumsum(ends).tolist()
            for n, pick, a, b in zip(split, picks, [0, *ends], ends):
                value, _, (edges, path_units), at, unit, gone = popped[n]
                part = np.concatenate([[pick], more[a:b]])
                heads[n] = (value, np.concatenate([edges[:at], part]), np.concatenate([path_units[:at], np.full(len(part), unit)]), at, (*gone, pick))
                begin[n] = unit + 1
        count = np.array([len(rows[i]) - f for i, f in zip(todo, begin)], np.int64)
        tail = np.concatenate([rows[i][f:] for i, f in zip(todo, begin)])
        tail_unit = np.concatenate([np.arange(f, len(rows[i])) for i, f in zip(todo, begin)])
        owner, edge = walk(lat, lat.first[tail], np.repeat(streams[todo], count), tail_unit)
        ends = np.searchsorted(owner, np.cumsum(count))
        in_row = tail_unit[owner]
        paths, a = [], 0
        for (value, he, ho, at, gone), b in zip(heads, ends.tolist()):
            paths.append((edge[a:b], in_row[a:b]) if he is None else (np.concatenate([he, edge[a:b]]), np.concatenate([ho, in_row[a:b]])))
            a = b
        # all sets that the paths split theirs into, at once: same edges up to here, another edge at this node
        size = np.array([len(p[0]) - h[3] for p, h in zip(paths, heads)], np.int64)
        every = np.concatenate([p[0][h[3] :] for p, h in zip(paths, heads)])
        logq = lat.logq[every]
        before = np.empty(len(every))
        bounds = np.concatenate([[0], np.cumsum(size)])
        for n, (i, (value, _, _, at, _), (edges, _)) in enumerate(zip(todo, heads, paths)):
            upto = np.cumsum(lat.logq[edges])
            out[i].append([edges, float(upto[-1]) if len(upto) else 0.0, -value, 0.0])
            a, b = bounds[n], bounds[n + 1]
            before[a + 1 : b] = upto[at:-1]
            if b > a:
                before[a] = upto[at - 1] if at else 0.0
        left = -np.expm1(logq)
        for n, (_, _, _, _, gone) in enumerate(heads):
            if gone and size[n]:
                a = bounds[n]
                left[a] = 1.0 - float(np.exp(lat.logq[list(gone)]).sum())
                if len(gone) >= lat.degree[lat.source[every[a]]]:
                    left[a] = 0.0
        left[left < 0] = 0.0  # an edge that is alone has log probability 0, so nothing is left
        at_all = np.arange(len(every)) - np.repeat(bounds[:-1], size) + np.repeat(np.array([h[3] for h in heads], np.int64), size)
        u = uniform(np.repeat(base[todo], size), at_all, (1 << 42) + s)
        with np.errstate(divide="ignore"):
            own = np.log(-np.log(u)) - before - np.log(left)  # the draw of each set, negated, before it is truncated
        for n, (i, (value, _, _, at, gone), path) in enumerate(zip(todo, heads, paths)):
            part = own[bounds[n] : bounds[n + 1]]
            for _ in range(min(k - s, len(part))):  # no later pop reaches beyond these
                j = int(part.argmin())
                if part[j] == np.inf:
                    break
                drawn[i] += 1
                g = float(np.logaddexp(value, part[j]))  # truncated at the path's own value
                heapq.heappush(heaps[i], (g, drawn[i], path, at + j, int(path[1][at + j]), gone if gone and j == 0 else (int(path[0][at + j]),)))
                part[j] = np.inf
    for heap, found in zip(heaps, out):
        for x in found:
            x[3] = 1.0 if not heap else -math.expm1(-math.exp(min(50.0, x[1] + heap[0][0])))
    return [[tuple(x) for x in found] for found in out]


def edge_ids(lat: Lattices, edges: np.ndarray, byte_ids: list[int]) -> np.ndarray:
    """Piece ids of a path; an unknown character is spelled in byte pieces."""
    found = lat.id[edges]
    low = int(found.min()) if len(found) else 0
    if low >= 0:
        return found
    if low >= -0x80:  # characters of one byte
        return np.where(found < 0, np.array(byte_ids, np.int32)[np.maximum(-1 - found, 0) & 0x7F], found)
    return np.array([y for x in found.tolist() for y in ([x] if x >= 0 else [byte_ids[b] for b in chr(-1 - x).encode()])], np.int32)


def row_key(key, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}|{key}".encode())


_STATE: dict = {}


def _state(model: bytes, alpha: float) -> tuple:
    tag = (hashlib.sha256(model).digest(), alpha)
    if tag not in _STATE:
        _STATE.clear()
        sp = processor(model)
        _STATE[tag] = (sp, Lattices(sp, *piece_weights(sp, alpha)), [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    return _STATE[tag]


def _forget() -> None:
    """Empty the stores of this worker: workers live on and take turns, so each would hold one through all other stages."""
    for _, lat, _ in _STATE.values():
        lat.forget()
    release()


def code_pieces(docs: DataFrame, model: bytes, samples: int = 2, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: ids of the deterministic encoding of the whole text, n_pieces, round_trip (whether
    decoding these ids gives the text again), and an array of samples (rank, ids, n_pieces, ids_hash, log_prob,
    perturbed, inclusion).

    No shuffle; the model (a published file) is broadcast. Memory: one Arrow batch, a bounded store of unit lattices,
    and the paths of about GROUP_CHARS characters (or of one longer text). Null counts as the empty text: no pieces and
    one empty sample of probability 1. Repeated rows have equal results, as the key is the id. The mark U+2581 in a
    text reads back as a space, as the model defines. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    sample_type = pa.struct([("rank", pa.int32()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("ids_hash", pa.string()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())])

    def listed(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))

    def columns(keys: list, texts: list[str]) -> list[pa.Array]:
        sp, lat, byte_ids = _state(shared.value, alpha)
        at = lat.look_up(texts)
        coded = sp.encode(texts, num_threads=1, out_type="numpy")
        n_pieces = pa.array(map(len, coded), pa.int64())
        same = pa.array([sp.decode(x) == t for x, t in zip(coded, texts)], pa.bool_())
        coded = listed(coded)
        found = sample_paths(lat, at, [row_key(x, seed) for x in keys], samples)
        flat = [(rank, edge_ids(lat, edges, byte_ids), *more) for row in found for rank, (edges, *more) in enumerate(row, 1)]
        lat.trim()
        rank, ids, log_prob, value, score = zip(*flat) if flat else ((),) * 5
        digests = [xxhash.xxh64_hexdigest(x.astype("<i4").tobytes()) for x in ids]
        struct = pa.StructArray.from_arrays([pa.array(rank, pa.int32()), listed(ids), pa.array(map(len, ids), pa.int64()), pa.array(digests, pa.string()), *(pa.array(c, pa.float64()) for c in (log_prob, value, score))], fields=list(sample_type))
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
        return [coded, n_pieces, same, pa.ListArray.from_arrays(pa.array(offsets), struct)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, a = batch.column(0), batch.column(1), 0
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            while a < len(texts):
                b, n = a, 0
                while b < len(texts) and (b == a or n + sizes[b] <= GROUP_CHARS):
                    n += sizes[b]
                    b += 1
                part = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *columns(keys.slice(a, b - a).to_pylist(), part)], names=[id_col, "ids", "n_pieces", "round_trip", "samples"])
                a = b
        _forget()

    fields = f"`{id_col}` {kind}, ids array<int>, n_pieces long, round_trip boolean, samples array<struct<rank: int, ids: array<int>, n_pieces: long, ids_hash: string, log_prob: double, perturbed: double, inclusion: double>>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, fields)


def decode_pieces(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from piece ids; null ids give a null text."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(shared.value)
        for batch in batches:
            texts = [None if x is None else sp.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: encoding and decoding of whole texts, and two samples without replacement, flattened."""
    out = code_pieces(read_table(spark, sf_dir, "documents"), load_model())
    flat = [F.get("samples", F.lit(i))[c].alias(f"sample{i + 1}_{c}") for i in range(2) for c in ("n_pieces", "ids_hash", "log_prob", "inclusion")]
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "round_trip", *flat)


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}
