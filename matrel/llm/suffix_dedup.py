"""Removal of repeated passages by a logarithmic family of suffix arrays.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id. For every such string
the document with the smallest id that holds it is its owner; owners keep it, all others lose it.

1. Sampling. Each 50-byte window is filed under its anchor, the 16-byte string inside it with the least hash. Equal
   windows have equal anchors, so windows can be compared anchor by anchor. The hash of each distinct anchor of a chunk
   is sent out, and one bit comes back: whether another chunk holds it too. Windows under other anchors are unique.
2. Index. The remaining windows go out as the byte runs that hold them, each distinct run of a chunk once, with the
   smallest id that holds it. A group files the windows of its distinct runs once more, under the longer strings that
   all windows with the anchor at nearly one place have in common; windows whose string no other run has are their run's
   alone. It takes the others in batches of rising id. A batch gets a suffix array (positions in the order of its
   suffixes, cut at 50 bytes, as longer matches are chains of these), which is merge-scanned against the
   arrays of the existing levels; what is new becomes a level, and levels of equal size class merge, so n suffixes are in
   O(log n) arrays and each is moved O(log n) times. Levels live as long as the task of their group.
3. Decision. One bit for each window of a run comes back: whether the id sent with it owns the window. The chunk
   removes the rest, judged on the input text.

Copies shrink before each shuffle (a chunk sends a run once), and what comes back is a bit for each anchor or window a
chunk sent, so a passage in a third of all documents loads no task more than one entry for each chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ANSWER, ANSWER_ARROW, Chunk, ask, groups_of, write_chunks
from .common import materialize, read_table

#: Bytes of a repeated string, fixed by the contract; bytes of an anchor.
LENGTH, ANCHOR = 50, 16
#: Positions that are hashed at a time; windows of a batch of the index, of which a large group takes up to GROWTH times as
#: many, so that it has about BATCHES batches. Places of the anchor in a window that are filed together.
BLOCK, BATCH, BATCHES, GROWTH, PLACES = 1 << 17, 1 << 13, 16, 16, 7
_ANCHORS, _OWNED = 0, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 16-byte string of raw."""
    n = len(raw) - 7
    word = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        view = raw[o : o + (len(raw) - o) // 8 * 8].view("<u8")
        word[o::8] = view[: len(word[o::8])]
    a = word[:-8] * np.uint64(0xE7037ED1A0B428DB)
    a ^= a >> np.uint64(29)
    a += word[8:] * np.uint64(0x8EBC6AF09C88C6E3)
    return _mix(a)


def window_runs(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each run of neighbouring windows inside one of the ranges that
    have one anchor. A run has at most length - 15 windows."""
    span = length - ANCHOR + 1
    raw = np.frombuffer(data, np.uint8)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    windows = len(raw) - length + 1
    for at in range(0, max(0, windows), BLOCK):
        upto = min(windows, at + BLOCK)
        h = anchor_hashes(raw[at : upto + length - 1])
        key = (h & np.uint64((1 << 64) - (1 << 21))) | np.arange(len(h), dtype=np.uint64)
        low, have = key, 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        anchor = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        valid = np.ones(upto - at, bool)
        a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, upto, side="left")
        for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist()):
            valid[max(0, max(s, e - length + 1) - at) : max(0, e - at)] = False
        edge = np.flatnonzero(np.diff(anchor, prepend=-1) | np.diff(valid, prepend=False))
        size = np.diff(np.append(edge, len(anchor)))
        keep = valid[edge]
        edge, size = edge[keep], size[keep]
        found.append((edge + at, size, h[anchor[edge]]))
    first, size, h = (np.concatenate(c) for c in zip(*found))  # documents lie apart: a window that ends in the next is not valid
    return first, size, h


class _Asked:
    """The windows of a chunk that others may hold, and the distinct anchors it asks about."""

    def __init__(self, chunk: Chunk, groups: int, length: int):
        self.chunk, self.groups, self.length = chunk, groups, length
        first, size, h = window_runs(chunk.data, chunk.starts, chunk.ends, length)
        doc = np.searchsorted(chunk.ends, first, side="right")
        keep = chunk.known[doc] if len(doc) else np.zeros(0, bool)
        self.first, self.size, self.h, self.doc = first[keep], size[keep], h[keep], doc[keep]
        self.anchors, self.which = np.unique(self.h, return_inverse=True)
        group = (self.anchors % np.uint64(groups)).astype(np.int64)
        self.order = np.argsort(group, kind="stable")
        self.bounds = np.searchsorted(group[self.order], np.arange(groups + 1))
        # anchors that two documents of this chunk hold
        self.local = np.zeros(len(self.anchors), bool)
        if len(self.h):
            by = np.argsort(self.which, kind="stable")
            at = np.flatnonzero(np.diff(self.which[by], prepend=-1))
            ids = chunk.ids[self.doc[by]]
            self.local = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)

    def anchor_rows(self) -> pa.Table:
        used = np.flatnonzero(np.diff(self.bounds))
        values = [self.anchors[self.order[self.bounds[g] : self.bounds[g + 1]]].tobytes() for g in used]
        return pa.table({"chunk": pa.array([self.chunk.number] * len(used), pa.int64()), "kind": pa.array([_ANCHORS] * len(used), pa.int32()), "grp": pa.array(used, pa.int32()), "value": pa.array(values, pa.binary())}, schema=ANSWER_ARROW)

    def shared(self, answers: dict) -> None:
        """Keep the runs whose anchor another document holds; number their distinct contents, group by group."""
        flag = self.local.copy()
        for g in np.flatnonzero(np.diff(self.bounds)):
            part = self.order[self.bounds[g] : self.bounds[g + 1]]
            flag[part] |= np.unpackbits(np.frombuffer(answers[_ANCHORS, int(g)], np.uint8), count=len(part)).astype(bool)
        keep = flag[self.which] if len(self.which) else np.zeros(0, bool)
        first, size, doc = self.first[keep], self.size[keep], self.doc[keep]
        ids = self.chunk.ids[doc]
        group = (self.h[keep] % np.uint64(self.groups)).astype(np.int64)
        order = np.lexsort((ids, group))  # of equal contents the smallest id comes first
        self.run_first, self.run_size, self.run_id, self.run_group = first[order], size[order], ids[order], group[order]
        seen: dict[bytes, int] = {}
        data, more = self.chunk.data, self.length - 1
        self.run_seg = np.fromiter((seen.setdefault(data[a : a + n + more], len(seen)) for a, n in zip(self.run_first.tolist(), self.run_size.tolist())), np.int64, len(order))
        lead = np.unique(self.run_seg, return_index=True)[1]  # the first run of each content, in order
        self.seg_id, self.seg_size, self.seg_group = self.run_id[lead], self.run_size[lead], self.run_group[lead]
        self.segs = list(seen)
        self.seg_bounds = np.searchsorted(self.seg_group, np.arange(self.groups + 1))

    def segment_rows(self) -> pa.Table:
        used = np.flatnonzero(np.diff(self.seg_bounds))
        rows = {"chunk": [], "grp": [], "ids": [], "sizes": [], "data": []}
        for g in used:
            a, b = self.seg_bounds[g], self.seg_bounds[g + 1]
            for c, v in zip(rows, (self.chunk.number, int(g), self.seg_id[a:b].tobytes(), self.seg_size[a:b].astype(np.uint8).tobytes(), b"".join(self.segs[a:b]))):
                rows[c].append(v)
        return pa.table({"chunk": pa.array(rows["chunk"], pa.int64()), "grp": pa.array(rows["grp"], pa.int32()), **{c: pa.array(rows[c], pa.binary()) for c in ("ids", "sizes", "data")}})

    def removed(self, answers: dict) -> np.ndarray:
        """Whether each byte of the chunk goes."""
        mask = np.zeros(len(self.segs), np.uint64)
        for g in np.flatnonzero(np.diff(self.seg_bounds)):
            mask[self.seg_bounds[g] : self.seg_bounds[g + 1]] = np.frombuffer(answers[_OWNED, int(g)], np.uint64)
        # another document than the one whose id was sent owns nothing of the run
        own = np.where(self.run_id == self.seg_id[self.run_seg], mask[self.run_seg], np.uint64(0)) if len(self.run_seg) else mask[:0]
        n = self.run_size
        window = np.repeat(self.run_first, n) + (at := np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        lost = window[((np.repeat(own, n) >> at.astype(np.uint64)) & np.uint64(1)) == 0]
        change = np.zeros(len(self.chunk.data) + self.length + 1, np.int32)
        change[lost] += 1  # a window is in one run alone
        change[lost + self.length] -= 1
        return np.cumsum(change)[: len(self.chunk.data)] > 0


class SuffixLevels:
    """The levels: arrays of positions in one text, each in the byte order of the suffixes that start there (cut at length
    bytes), with the smallest id of each. Batches come by rising id; no suffix is in two levels."""

    def __init__(self, text: np.ndarray, length: int):
        # every suffix's first bytes as one item, lying over each other in the text
        self.windows = np.ndarray((max(0, len(text) - length + 1),), np.dtype(("S", length)), text, 0, (1,))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.matched = self.merged = 0  # suffixes of batches that a level had; merges of levels

    def suffixes(self, at: np.ndarray) -> np.ndarray:
        return self.windows[at]

    def scan(self, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The owner of each suffix of a batch (positions, by rising id), which is then added."""
        keys = self.suffixes(at)
        order = np.argsort(keys, kind="stable")  # the batch's suffix array
        new = np.ones(len(order), bool)
        keys = keys[order]
        new[1:] = keys[1:] != keys[:-1]
        run = np.cumsum(new) - 1
        heads, place, owner = keys[new], at[order[new]], ids[order[new]]
        fresh = np.ones(len(heads), bool)
        for level, owners in self.levels:
            mine, theirs = self._common(heads, level)
            owner[mine] = np.minimum(owner[mine], owners[theirs])
            fresh[mine] = False
        self.matched += int((~fresh).sum())
        out = np.empty(len(order), np.int64)
        out[order] = owner[run]
        if fresh.any():
            self._push(place[fresh], owner[fresh])
        return out

    def _common(self, heads: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in heads, places in level) of equal suffixes: a scan over the merge of both orders, in which equal ones
        are neighbours. Stretches of the level that lie between two heads far apart are not read: of a level that is much
        longer than the batch only a stretch of its suffixes around each head's place is merged."""
        if len(level) > 8 * len(heads):
            low, high = np.zeros(len(heads), np.int64), np.full(len(heads), len(level))
            while (wide := high > low).any():  # the place of each head, all heads in step
                mid = (low + high) // 2
                less = np.zeros(len(heads), bool)
                less[wide] = self.suffixes(level[mid[wide]]) < heads[wide]
                low, high = np.where(wide & less, mid + 1, low), np.where(wide & ~less, mid, high)
            part = np.unique(np.minimum(low, len(level) - 1))
        else:
            part = np.arange(len(level))
        both = np.concatenate([self.suffixes(level[part]), heads])
        order = np.argsort(both, kind="stable")  # a merge of two runs; of equal ones the level's comes first
        after = np.flatnonzero((order[1:] >= len(part)) & (order[:-1] < len(part)))  # a head right behind one of the level
        after = after[both[order[after + 1]] == both[order[after]]]
        return order[after + 1] - len(part), part[order[after]]

    def _push(self, at: np.ndarray, owners: np.ndarray) -> None:
        while self.levels and len(self.levels[-1][0]).bit_length() <= len(at).bit_length():
            more, their = self.levels.pop()
            both, who = np.concatenate([more, at]), np.concatenate([their, owners])
            order = np.argsort(self.suffixes(both), kind="stable")  # a merge of two runs
            at, owners, self.merged = both[order], who[order], self.merged + 1
        self.levels.append((at, owners))


def _anchor_answers(table: pa.Table) -> pa.Table:
    """For each chunk's anchors of a group: a bit, whether another chunk holds it."""
    asked = [np.frombuffer(v, np.uint64) for v in table["value"].to_pylist()]
    every, count = np.unique(np.concatenate(asked), return_counts=True)
    bits = [np.packbits(count[np.searchsorted(every, a)] > 1).tobytes() for a in asked]
    return pa.table({"chunk": table["chunk"], "kind": table["kind"], "grp": table["grp"], "value": pa.array(bits, pa.binary())}, schema=ANSWER_ARROW)


def rival_windows(raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each run of distinct contents (rising start): 64 bits, bit j whether its window j may equal one of another run.

    Equal windows have their anchor at the same place. All windows with the anchor at one of PLACES neighbouring places
    share a string around it, so where no other run has that string, none has the windows. Strings are told apart by hashes;
    those that collide only leave more windows."""
    span = length - ANCHOR + 1
    out = np.zeros(len(start), np.uint64)
    place = np.zeros(len(start), np.int64)  # of the anchor in the first window, from which it goes down by one a window
    lows = range(0, span, PLACES)
    keys = np.zeros((len(lows), len(start)), np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(start, start[at] + BLOCK, side="left")))
        s, base = start[at:upto], int(start[at])
        h = anchor_hashes(raw[base : int(s[-1] + size[upto - 1]) + length - 1])
        high = h & np.uint64((1 << 64) - (1 << 21))  # as in window_runs
        s = s - base
        best, where = high[s], np.zeros(len(s), np.int64)
        for o in range(1, span):
            less = (inside := high[s + o]) < best
            best, where[less] = np.where(less, inside, best), o
        place[at:upto] = where
        for k, low in enumerate(lows):
            high_place = min(low + PLACES, span) - 1
            width = length - (high_place - low)  # of the string, which starts low before the anchor
            key = np.zeros(len(s), np.uint64)
            for o in (*range(0, width - ANCHOR, ANCHOR), width - ANCHOR):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ h[np.clip(s + where - low + o, 0, len(h) - 1)])
            keys[k, at:upto] = key
        at = upto
    least = place - size + 1
    for k, low in enumerate(lows):
        high_place = min(low + PLACES, span) - 1
        has = np.flatnonzero((least <= high_place) & (place >= low))
        _, back, count = np.unique(keys[k, has], return_inverse=True, return_counts=True)
        has = has[count[back] > 1]
        a = np.maximum(place[has] - high_place, 0).astype(np.uint64)  # the first window of these places, and how many
        n = (np.minimum(place[has] - low, size[has] - 1) + 1).astype(np.uint64) - a
        out[has] |= (np.uint64((1 << 64) - 1) >> (np.uint64(64) - n)) << a
    return out


def _owner_answers(length: int, batch: int):
    def run(table: pa.Table) -> pa.Table:
        """For each chunk's runs of a group: 64 bits, bit j whether the id sent owns the run's window j."""
        ids = [np.frombuffer(v, np.int64) for v in table["ids"].to_pylist()]
        sizes = [np.frombuffer(v, np.uint8).astype(np.int64) for v in table["sizes"].to_pylist()]
        data = table["data"].to_pylist()
        every_id, size = np.concatenate(ids), np.concatenate(sizes)
        pool = b"".join(data)
        start = np.cumsum(size + length - 1) - (size + length - 1)
        raw = np.frombuffer(pool, np.uint8)
        order = np.argsort(every_id, kind="stable")
        seen: dict[bytes, int] = {}
        lead = np.fromiter((seen.setdefault(pool[a : a + n + length - 1], i) for i, a, n in zip(order.tolist(), start[order].tolist(), size[order].tolist())), np.int64, len(order))
        first = order[lead == order]  # the first run of each content, by rising id
        del seen
        mask = np.zeros(len(size), np.uint64)
        mask[first] = np.uint64((1 << 64) - 1) >> (64 - size[first]).astype(np.uint64)
        rivals = np.zeros(len(size), np.uint64)
        rising = np.sort(first)
        rivals[rising] = rival_windows(raw, start[rising], size[rising], length)
        levels = SuffixLevels(raw, length)
        first = first[rivals[first] > 0]  # the other runs own their windows
        edges = np.cumsum(np.bitwise_count(rivals[first]), dtype=np.int64)
        most = max(batch, min(int(edges[-1]) // BATCHES, GROWTH * batch)) if len(first) else batch
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(edges, (edges[a - 1] if a else 0) + most, side="right")))
            part = first[a:b]
            n = size[part]
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            bit = np.uint64(1) << j.astype(np.uint64)
            ask = (np.repeat(rivals[part], n) & bit) > 0
            who, j, bit, run = np.repeat(every_id[part], n)[ask], j[ask], bit[ask], np.repeat(np.arange(len(part)), n)[ask]
            lost = levels.scan(start[part][run] + j, who) != who
            mask[part] &= ~np.bitwise_or.reduceat(np.where(lost, bit, np.uint64(0)), np.flatnonzero(np.diff(run, prepend=-1)))
            a = b
        # an equal run of another id owns nothing; one of the same id owns the same
        back = np.empty(len(size), np.int64)
        back[order] = lead
        mask = np.where(every_id == every_id[back], mask[back], np.uint64(0))
        cuts = np.cumsum([0, *map(len, ids)])
        values = [mask[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
        return pa.table({"chunk": table["chunk"], "kind": pa.array([_OWNED] * len(values), pa.int32()), "grp": table["grp"], "value": pa.array(values, pa.binary())}, schema=ANSWER_ARROW)

    return run


def _result(chunk: Chunk, gone: np.ndarray, with_text: bool, carry: tuple[str, ...] = ()) -> pa.Table:
    ids, sizes, lost, spans, digests, texts = [], [], [], [], [], []
    raw = np.frombuffer(chunk.data, np.uint8)
    for key, a, b in zip(chunk.keys(), chunk.starts.tolist(), chunk.ends.tolist()):
        part = gone[a:b]
        n = int(np.count_nonzero(part))
        whole = chunk.data[a:b]
        left = raw[a:b][~part].tobytes() if n else whole
        ids.append(key)
        sizes.append(b - a)
        lost.append(n)
        spans.append(int(np.count_nonzero(part[1:] & ~part[:-1]) + part[0]) if n else 0)
        digests.append(hashlib.sha256(left).hexdigest())
        if with_text:
            if n:  # a character goes when all its bytes do
                head = (raw[a:b] & 0xC0) != 0x80
                char = np.cumsum(head) - 1
                stays = np.zeros(int(head.sum()), bool)
                np.logical_or.at(stays, char, ~part)
                left = raw[a:b][stays[char]].tobytes()
            texts.append(left.decode())
    columns = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    if with_text:
        columns["kept_text"] = pa.array(texts, pa.string())
    if carry:
        columns |= {f"carried_{c}": v for c, v in zip(carry, chunk.rest().columns)}
    return pa.table(columns)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = (), batch: int = BATCH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]), one row for each row of docs; each column named in
    carry comes along as carried_<name>.

    Exact over whole texts as UTF-8 bytes; matches never cross documents. kept_text has every character that is not
    removed with all its bytes, so it is valid text. Null texts count as empty; texts under length bytes lose nothing;
    rows that repeat an id do not remove each other's strings; a row without id loses nothing and removes nothing.
    length: 24 to 79. Other columns are not read. A task holds one chunk, or one group of the index.
    """
    if not 24 <= length <= 79:
        raise ValueError("length must be 24 to 79")
    chunks = write_chunks(docs, id_col, text_col, carry=tuple(carry))
    groups = groups_of(chunks)
    anchors = ask(chunks, None, lambda c, _: _Asked(c, groups, length).anchor_rows(), ANSWER)
    shared = materialize(anchors.groupBy("grp").applyInArrow(_anchor_answers, ANSWER), "anchor-answers")

    def runs(chunk: Chunk, answers: dict) -> pa.Table:
        asked = _Asked(chunk, groups, length)
        asked.shared(answers)
        return asked.segment_rows()

    asked = ask(chunks, shared, runs, "chunk long, grp int, ids binary, sizes binary, data binary")
    owned = materialize(asked.groupBy("grp").applyInArrow(_owner_answers(length, batch), ANSWER), "owner-answers")

    def decide(chunk: Chunk, answers: dict) -> pa.Table:
        known = _Asked(chunk, groups, length)
        known.shared(answers)
        return _result(chunk, known.removed(answers), with_text, tuple(carry))

    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", `carried_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return ask(chunks, shared.unionByName(owned), decide, fields)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
SQL: dict[str, str] = {}
