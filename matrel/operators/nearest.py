"""Exact nearest neighbours of one block of nodes among another, as an Arrow function: distances of all pairs by a matrix
product, in single precision where that tells enough, which errs by rounding alone; pairs that may be among the best by that
are measured again term by term. One product tells for the nodes of either block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs whose distances are held at a time.
TILE_PAIRS = 1 << 20
#: Larger components are measured term by term, as their squares would leave the range.
LARGEST = 1e100
#: Squared lengths over which single precision is not tried.
SINGLE = 1e30
#: Pairs for each one looked for from which a tile is taken again in double precision.
VAGUE = 32
#: Side of a tile of a product that tells for rows and columns; pairs that wait to be measured, at most about.
TILE, WAITING = 512, 2_000_000
#: Groups over which stretches of a row are not taken one by one.
MANY = 256

PACKED = "part int, block int, node binary, grp binary, eqv binary, label binary, size binary, x binary, single boolean, hole binary"
FOUND = "src long, dst long, dst_grp long, weight double"
_FOUND = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("dst_grp", pa.int64()), ("weight", pa.float64())])
#: A null label or class.
NULL = np.iinfo(np.int64).min


def pack(table: pa.Table) -> pa.Table:
    """One block (part, block, node, grp, eqv, label, x) as one row. size: components of x, -1 for null; single: whether x
    is in single precision, which must lose nothing; hole: null components."""
    whole = lambda c: table[c].cast(pa.int64()).fill_null(NULL).to_numpy()
    x = table["x"].combine_chunks()
    flat = x.flatten()
    size = x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    hole = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        short = values.astype(np.float32)
    if single := bool(((short == values) | np.isnan(values)).all()):
        values = short
    row = [*(table[c][0].as_py() for c in ("part", "block")), *(whole(c).tobytes() for c in ("node", "grp", "eqv", "label")), size.tobytes(), values.tobytes(), single, hole.tobytes() if hole.any() else b""]
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.bool_(), pa.binary())
    names = ("part", "block", "node", "grp", "eqv", "label", "size", "x", "single", "hole")
    return pa.table({n: pa.array([v], t) for n, v, t in zip(names, row, kinds)})


class Block:
    """Nodes in the order of their groups. sound: finite, of the width most nodes have, so fit for the product."""

    def __init__(self, row: dict, width: int):
        part = {c: np.frombuffer(row[c], np.int64) for c in ("node", "grp", "eqv", "label", "size")}
        order = np.argsort(part["grp"], kind="stable")
        self.node, self.grp, self.eqv, self.label, self.size = (part[c][order] for c in ("node", "grp", "eqv", "label", "size"))
        flat, hole = np.frombuffer(row["x"], np.float32 if row["single"] else np.float64), np.frombuffer(row["hole"], bool)
        flat = flat.astype(np.float64, copy=False)
        have = np.maximum(part["size"], 0)
        ends = np.cumsum(have)
        fit = part["size"] == width
        self.x = np.zeros((len(order), width))
        self.x[fit] = flat.reshape(-1, width) if fit.all() else flat[np.repeat(fit, have)].reshape(-1, width)
        self.x = self.x[order]
        with np.errstate(invalid="ignore"):
            self.sound = fit[order] & (np.abs(self.x) < LARGEST).all(axis=1)
        self.void = part["size"][order] < 0
        self.other: dict[int, np.ndarray] = {}  # vectors of other widths
        if len(hole):
            lost = np.add.reduceat(np.append(hole, False).astype(int), np.minimum(ends - have, len(hole)))[: len(have)] * (have > 0)
            self.void |= lost[order] > 0
            self.sound &= ~self.void
        for at in np.flatnonzero(~fit[order] & ~self.void):
            a = order[at]
            self.other[int(at)] = flat[ends[a] - have[a] : ends[a]]

    def vectors(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.x[at] if size == self.x.shape[1] else np.array([self.other[int(i)] for i in at]).reshape(len(at), size)


def measured(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, their terms added in order; negative for pairs that have none (a null, or unequal
    widths)."""
    out = np.full(len(i), -1.0)
    known = (a.size[i] == b.size[j]) & ~a.void[i] & ~b.void[j]
    for size in np.unique(a.size[i[known]]):
        every = np.flatnonzero(known & (a.size[i] == size))
        for at in range(0, len(every), 1 << 17):
            part = every[at : at + (1 << 17)]
            with np.errstate(invalid="ignore", over="ignore"):
                term = (a.vectors(i[part], size) - b.vectors(j[part], size)) ** 2
                total = np.zeros(len(part))
                for t in range(int(size)):
                    total += term[:, t]
            out[part] = total
    return out


def pair_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Squared distances of the vectors in the rows of two columns, their terms added in order; null for pairs that have none
    (a null, or unequal widths)."""
    sizes = [x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for x in (a, b)]
    out = np.full(len(a), np.nan)
    void = (sizes[0] != sizes[1]) | (sizes[0] < 0)
    for size in np.unique(sizes[0][~void]).tolist():
        at = np.flatnonzero(~void & (sizes[0] == size))
        flat = [(x if len(at) == len(x) else x.take(pa.array(at))).flatten() for x in (a, b)]
        for x in flat:
            if x.null_count:
                void[at] |= x.is_null().to_numpy(zero_copy_only=False).reshape(len(at), size).any(axis=1)
        x, y = (f.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(at), size) for f in flat)
        total = np.zeros(len(at))
        with np.errstate(invalid="ignore", over="ignore"):
            for term in np.ascontiguousarray(((x - y) ** 2).T):
                total += term
        out[at] = total
    return pa.array(out, pa.float64(), mask=void)


def _barred(metric: str, a: Block, rows: np.ndarray, b: Block, cols: np.ndarray) -> np.ndarray | None:
    """Pairs that equivalence classes or labels bar; null when they bar none."""
    out = None
    ea, eb = a.eqv[rows][:, None], b.eqv[cols][None, :]
    if (ea >= 0).any() or (ea == NULL).any():
        out = (ea == NULL) | (ea >= 0) & ((ea == eb) | (eb == NULL))
    if metric not in ("any", "label-equal"):
        p, q = a.label[rows][:, None], b.label[cols][None, :]
        void = (p == NULL) | (q == NULL)
        unknown = (p < 0) & (p != NULL) | (q < 0) & (q != NULL)
        fine = {
            "label-equal-or-unknown": lambda: (p == q) & ~void | unknown,
            "label-different": lambda: (p != q) & (p >= 0) & (q >= 0),
            "label-different-or-unknown": lambda: (p != q) & ~void | unknown,
        }[metric]()
        out = ~fine if out is None else out | ~fine
    return out


class Factors:
    """What the columns of a block bring to the product: vectors from a centre and their squared lengths, in either precision."""

    def __init__(self, b: Block, cols: np.ndarray, centre: np.ndarray):
        self.centre = centre
        y = np.where(b.sound[cols, None], b.x[cols] - centre, 0.0)
        norm = np.einsum("ij,ij->i", y, y)
        self.double = np.ascontiguousarray(np.concatenate([-2.0 * y, np.ones((len(y), 1)), norm[:, None]], axis=1).T)
        self.longest = norm.max()
        self.single = self.double.astype(np.float32) if self.longest < SINGLE else None
        self.rounding = np.where(b.sound[cols], np.einsum("ij,ij->i", b.x[cols], b.x[cols]), 0.0).max()
        grp = b.grp[cols]
        self.lead = np.flatnonzero(np.diff(grp, prepend=grp[0] - 1))


def _least(d: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Least of each stretch of columns."""
    if len(lead) > MANY:
        return np.minimum.reduceat(d, lead, axis=1)
    return np.stack([d[:, x:y].min(axis=1) for x, y in zip(lead, [*lead[1:], d.shape[1]])], 1)


def _tile(a: Block, rows: np.ndarray, b: Block, cols: np.ndarray, right: Factors, k: int, metric: str, per_group: bool, bound: np.ndarray, single: bool = True, prime: bool = False) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """Pairs (i, j) of rows and cols, both by group, among which those of the k best of each row are that are not over its
    bound; prime: only what the k-th best of each row is not over, infinite where fewer are known."""
    x = np.where(a.sound[rows, None], a.x[rows] - right.centre, 0.0)
    norm = np.einsum("ij,ij->i", x, x)
    single = single and right.single is not None and norm.max() < SINGLE
    left = np.concatenate([x, norm[:, None], np.ones((len(rows), 1))], axis=1)
    d = left.astype(np.float32) @ right.single if single else left @ right.double
    odd = not (a.sound[rows].all() and b.sound[cols].all())
    if odd:
        d[~a.sound[rows]] = np.nan
        d[:, ~b.sound[cols]] = np.nan
    grp = b.grp[cols]
    for g, at in zip(*np.unique(a.grp[rows], return_index=True)):
        end = np.searchsorted(a.grp[rows], g, side="right")
        d[at:end, np.searchsorted(grp, g) : np.searchsorted(grp, g, side="right")] = np.inf
    if (barred := _barred(metric, a, rows, b, cols)) is not None:
        d[barred] = np.inf
    i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if odd:
        i, j = np.nonzero(np.isnan(d))
        d[i, j] = np.inf
    # twice what rounding does to a distance, and what it does to vectors on their way to the centre
    slack = (3e-7 if single else 1e-15) * (x.shape[1] + 16) * (norm + right.longest) + (1e-30 if single else 1e-300)
    slack += 1e-15 * (x.shape[1] + 16) * (np.where(a.sound[rows], np.einsum("ij,ij->i", a.x[rows], a.x[rows]), 0.0) + right.rounding)
    # least distances of groups; where one group may give several, of stretches: the k-th least is no less than the k-th best
    lead = right.lead if per_group else np.arange(0, len(cols), max(1, len(cols) // (8 * k)))
    least = _least(d, lead).astype(np.float64)
    n = min(k, len(lead))
    best = np.partition(least, n - 1, axis=1)[:, :n]
    if prime:
        return best.max(axis=1) + slack if n == k else np.full(len(rows), np.inf)
    cut = np.where(np.isfinite(best), best, -np.inf).max(axis=1)
    if not per_group and (short := ~np.isfinite(best).all(axis=1) | (n < k)).any():
        cut[short] = np.where(np.isfinite(d[short]), d[short], -np.inf).max(axis=1)
    cut = np.minimum(cut, bound[rows]) + slack
    if single:  # rounded up
        cut = np.nextafter(cut.astype(np.float32), np.float32(np.inf))
    at = np.flatnonzero((d <= cut[:, None]).ravel())
    if single and len(at) > VAGUE * k * len(rows):
        return _tile(a, rows, b, cols, right, k, metric, per_group, bound, False)
    p, q = np.divmod(at, d.shape[1])
    if per_group:
        of = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(cols))))
        near = d[p, q] <= least[p, of[q]] + slack[p]
        p, q = p[near], q[near]
    fine = np.isfinite(d[p, q])
    return np.concatenate([rows[i], rows[p[fine]]]), np.concatenate([cols[j], cols[q[fine]]])


def _first(keys: list[np.ndarray], many: int) -> np.ndarray:
    """Of rows in order, which are among the first many with equal keys."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new |= np.diff(key, prepend=0) != 0
    new[:1] = True
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.arange(len(new)) - head < many


def _best(found: tuple[np.ndarray, ...], k: int, per_group: bool) -> tuple[np.ndarray, ...]:
    """Of pairs (row, node, group, squared distance) the k best of each row, at most one of a group; those without distance
    come last."""
    i, node, grp, w = found
    order = np.lexsort((node, w, w < 0, i))
    i, node, grp, w = (c[order] for c in (i, node, grp, w))
    if per_group:
        by = np.lexsort((grp, i))
        keep = np.sort(by[_first([i[by], grp[by]], 1)])
        i, node, grp, w = (c[keep] for c in (i, node, grp, w))
    keep = _first([i], k)
    return i[keep], node[keep], grp[keep], w[keep]


class Side:
    """A block and what its rows have found so far: the k best measured ones, a bound on the k-th best of each row, and pairs
    (row, column of the block that is met, distance by the product) that are not yet measured."""

    def __init__(self, block: Block, k: int, per_group: bool):
        self.block, self.k, self.per_group = block, k, per_group
        self.found = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        self.base = np.full(len(block.node), np.inf)  # of a few columns, measured
        self.bound = self.base.copy()
        self.slack = np.zeros(len(block.node))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        if len(i):
            self.waiting.append((i, j, d))
            self.many += len(i)

    def measure(self, b: Block, i: np.ndarray, j: np.ndarray) -> None:
        """Take the pairs of rows and columns of b that are among the best."""
        new = (i, b.node[j], b.grp[j], measured(self.block, i, b, j))
        self.found = _best(tuple(np.concatenate(c) for c in zip(self.found, new)), self.k, self.per_group)
        count = np.bincount(self.found[0], minlength=len(self.bound))
        last = np.cumsum(count)[count == self.k] - 1
        w = self.found[3][last]
        self.bound = self.base.copy()
        self.bound[self.found[0][last]] = np.minimum(self.base[self.found[0][last]], np.where((w >= 0) & np.isfinite(w), w, np.inf))

    def settle(self, b: Block) -> None:
        if self.waiting:
            self.tighten(b)
            i, j, _ = (np.concatenate(c) for c in zip(*self.waiting))
            self.waiting, self.many = [], 0
            self.measure(b, i, j)

    def tighten(self, b: Block) -> None:
        """Bounds by the products of pairs that wait; those over them go."""
        i, j, d = (np.concatenate(c) for c in zip(*self.waiting))
        short = np.nextafter(np.maximum(d, 0).astype(np.float32), np.float32(np.inf))  # no less than d
        at = i
        if self.per_group:
            group = np.cumsum(np.diff(b.grp, prepend=b.grp[0]) != 0)  # a block is in the order of its groups
            many = int(group[-1]) + 1
            if many * len(self.bound) < 1 << 32:
                key = np.sort(((i * many + group[j]).astype(np.uint64) << np.uint64(32)) | short.view(np.uint32))  # no distance is negative
                key = key[np.diff(key >> np.uint64(32), prepend=np.uint64(1 << 33)) != 0]
                at, short = (key >> np.uint64(32)).astype(np.int64) // many, key.astype(np.uint32).view(np.float32)
            else:
                order = np.lexsort((short, group[j], i))
                order = order[_first([i[order], group[j][order]], 1)]
                at, short = i[order], short[order]
        key = np.sort((at.astype(np.uint64) << np.uint64(32)) | short.view(np.uint32))
        at = (key >> np.uint64(32)).astype(np.int64)
        count = np.bincount(at, minlength=len(self.bound))
        last = (np.cumsum(count) - count + self.k - 1)[count >= self.k]
        rows = at[last]
        self.bound[rows] = np.minimum(self.bound[rows], key[last].astype(np.uint32).view(np.float32).astype(np.float64))
        near = d <= self.bound[i] + self.slack[i]
        self.waiting, self.many = [(i[near], j[near], d[near])], int(near.sum())

    def one_way(self, mine: np.ndarray, b: Block, theirs: np.ndarray, centre: np.ndarray, metric: str, prime: bool = False) -> None:
        """Rows look among columns by themselves; prime: for a bound alone."""
        if not len(mine) or not len(theirs):
            return
        right, out = Factors(b, theirs, centre), []
        step = max(1, TILE_PAIRS // len(theirs))
        for start in range(0, len(mine), step):
            with np.errstate(invalid="ignore", over="ignore"):
                out.append(_tile(self.block, mine[start : start + step], b, theirs, right, self.k, metric, self.per_group, self.bound, prime=prime))
        if prime:
            self.base[mine] = np.minimum(self.base[mine], np.concatenate(out))
            self.bound[mine] = np.minimum(self.bound[mine], self.base[mine])
        else:
            self.measure(b, *(np.concatenate(c) for c in zip(*out)))


class Laid:
    """Some nodes of a block as rows and as columns of the product of single precision."""

    def __init__(self, b: Block, at: np.ndarray, centre: np.ndarray):
        self.block, self.at, self.centre = b, at, centre
        x = b.x[at] - centre
        self.norm = np.einsum("ij,ij->i", x, x)
        self.raw = np.einsum("ij,ij->i", b.x[at], b.x[at])
        self.grp = b.grp[at]
        self.fine = self.norm.max() < SINGLE
        if self.fine:
            one = np.ones((len(at), 1), np.float32)
            norm = self.norm[:, None].astype(np.float32)
            x = x.astype(np.float32)
            self.rows, self.columns = np.concatenate([x, norm, one], axis=1), np.concatenate([-2.0 * x, one, norm], axis=1)

    def parts(self) -> list[slice]:
        return [slice(x, min(x + TILE, len(self.at))) for x in range(0, len(self.at), TILE)]

    def slack(self, other: Laid, single: bool) -> np.ndarray:
        """Twice what rounding does to a distance, and what it does to vectors on their way to the centre."""
        width = self.block.x.shape[1] + 16
        out = (3e-7 if single else 1e-15) * width * (self.norm + other.norm.max()) + (1e-30 if single else 1e-300)
        return out + 1e-15 * width * (self.raw + other.raw.max())


def _product(a: Laid, p: slice, b: Laid, q: slice, single: bool, room: np.ndarray) -> np.ndarray:
    """Squared distances of a tile; those inside a group are infinite."""
    if single:
        n, m = p.stop - p.start, q.stop - q.start
        d = np.matmul(a.rows[p], b.columns[q].T, out=room[: n * m].reshape(n, m))
    else:
        d = -2.0 * ((a.block.x[a.at[p]] - a.centre) @ (b.block.x[b.at[q]] - a.centre).T)
        d += a.norm[p, None]
        d += b.norm[None, q]
    mine, theirs = a.grp[p], b.grp[q]
    if mine[0] <= theirs[-1] and theirs[0] <= mine[-1]:
        for g in np.intersect1d(mine, theirs):
            d[np.searchsorted(mine, g) : np.searchsorted(mine, g, side="right"), np.searchsorted(theirs, g) : np.searchsorted(theirs, g, side="right")] = np.inf
    return d


def _set(tile: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Places of the few true values of a tile that lies at the beginning of room, looked for eight at a time."""
    end = -(-tile.size // 8) * 8
    room[tile.size : end] = False
    words = np.flatnonzero(room[:end].view(np.uint64) != 0)
    i, j = np.nonzero(room[:end].reshape(-1, 8)[words])
    return words[i] * 8 + j


def _both(s: Side, mine: np.ndarray, t: Side, theirs: np.ndarray, centre: np.ndarray, back: bool) -> None:
    """Rows of s and t that have bounds look among each other; one product tells for both. back: whether those of t look. A
    block that meets itself (s is t) takes each pair of tiles once."""
    same = s is t
    a = Laid(s.block, mine, centre)
    b = a if same else Laid(t.block, theirs, centre)
    single = a.fine and b.fine
    room, low = np.empty(TILE * TILE, np.float32), np.zeros(TILE * TILE + 8, bool)

    def slacks() -> None:
        s.slack[mine] = a.slack(b, single)
        if back and not same:
            t.slack[theirs] = b.slack(a, single)

    def cuts() -> list[np.ndarray]:
        every = [side.bound[at] + side.slack[at] for side, at in ((s, mine), (t, theirs))]
        return [np.nextafter(c.astype(np.float32), np.float32(np.inf)) if single else c for c in every]

    slacks()
    known = cuts()
    left, right = a.parts(), b.parts()
    for shift in range(len(right) // 2 + 1 if same else len(right)):
        for n, p in enumerate(left):
            at = n + shift
            if same and 2 * shift == len(right) and n >= shift:  # the pair of tiles was met
                break
            q = right[at % len(right)]
            answer = shift > 0 if same else back
            while True:
                d = _product(a, p, b, q, single, room)
                over = [known[0][p]]
                if answer:
                    over.append(known[1][q])
                hit = _set(np.less_equal(d, max(c.max() for c in over), out=low[: d.size].reshape(d.shape)), low)
                if len(hit) <= d.size // 64:
                    i, j = np.divmod(hit, d.shape[1])
                    v = d.ravel()[hit]
                    found = [(i[x], j[x], v[x]) for x in (v <= c[of] for c, of in zip(over, (i, j)))]
                else:
                    found = []
                    for c, row in zip(over, (False, True)):
                        i, j = np.divmod(np.flatnonzero((d <= (c[None, :] if row else c[:, None])) & np.isfinite(d)), d.shape[1])
                        found.append((i, j, d[i, j]))
                if single and max(len(f[0]) for f in found) > VAGUE * s.k * max(d.shape):
                    s.settle(t.block)  # bounds of the products of another precision do not hold
                    if answer and not same:
                        t.settle(s.block)
                    single = False
                    slacks()
                    known = cuts()
                    continue
                break
            i, j, v = found[0]
            s.add(mine[p][i], theirs[q][j], v)
            if answer:
                i, j, v = found[1]
                t.add(theirs[q][j], mine[p][i], v)
            for side, other in ((s, t), (t, s)):
                if side.many > WAITING:
                    side.settle(other.block)
                    known = cuts()
        for side, other, of in ((s, t, mine), (t, s, theirs)):
            if side.many > 4 * len(of):
                side.tighten(other.block)
                known = cuts()


def _meet(s: Side, mine: np.ndarray, t: Side, theirs: np.ndarray, centre: np.ndarray, metric: str, back: bool) -> None:
    """Rows of s look among those of t and, with back, the other way too. Rows without bound or not fit for the product look
    by themselves."""
    a, b, same = s.block, t.block, s is t
    back = back and not same
    plain = metric in ("any", "label-equal") and not (a.eqv[mine] != -1).any() and not (b.eqv[theirs] != -1).any()
    if not plain:
        s.one_way(mine, b, theirs, centre, metric)
        if back:
            t.one_way(theirs, a, mine, centre, metric)
        return
    for side, of, other, among in ((s, mine, b, theirs), *[(t, theirs, a, mine)] * back):
        sound = among[other.sound[among]]
        few = sound[:: max(1, len(sound) // min(1024, max(256, len(sound) // 32)))]
        side.one_way(of[np.isinf(side.bound[of]) & side.block.sound[of]], other, few, centre, metric, True)
    ready = a.sound[mine] & np.isfinite(s.bound[mine])
    known = b.sound[theirs] & (np.isfinite(t.bound[theirs]) if back or same else True)
    one, rest, near, far = mine[ready], mine[~ready], theirs[known], theirs[~known]
    if len(one) and len(near):
        _both(s, one, t, near, centre, back)
        s.settle(b)
        t.settle(a)
    s.one_way(one, b, far, centre, metric)
    s.one_way(rest, b, theirs, centre, metric)
    if back:
        t.one_way(near, a, rest, centre, metric)
        t.one_way(far, a, mine, centre, metric)


def block_neighbours(k: int, metric: str, per_group: bool, width: int, both: bool = False):
    """Arrow function over one packed block on the left and some on the right: for each node of the left one its k best in
    those on the right, at most one of a group; with both, for each node of another block on the right also its k best in
    the left one. What is not among them is not among its k best of all nodes. Only one block of the right is laid out at
    a time."""

    def run(table: pa.Table) -> pa.Table:
        at = np.array(table["left"].to_pylist(), bool)
        if at.all() or not at.any():  # the other side has no nodes
            return _FOUND.empty_table()
        one = lambda n: table.slice(int(n), 1).to_pylist()[0]
        number = table["block"].to_pylist()
        mine = int(np.flatnonzero(at)[0])
        s = Side(Block(one(mine), width), k, per_group)
        a = s.block
        centre = a.x[a.sound].mean(axis=0) if a.sound.any() else np.zeros(width)
        out = []

        def found(side: Side) -> pa.Table:
            i, dst, grp, w = side.found
            return pa.table([side.block.node[i], dst, grp, pa.array(w, pa.float64(), mask=w < 0)], schema=_FOUND)

        for n in np.flatnonzero(~at):
            same = number[n] == number[mine]
            t = s if same else Side(Block(one(n), width), k, per_group)
            b = t.block
            whole = [(np.arange(len(a.node)), np.arange(len(b.node)))]
            if metric == "label-equal":
                whole = [(np.flatnonzero(a.label == x), np.flatnonzero(b.label == x)) for x in np.intersect1d(a.label, b.label) if x >= 0]
            for mine_at, theirs_at in whole:
                _meet(s, mine_at, t, theirs_at, centre, metric, both)
            if both and not same:
                out.append(found(t))
        return pa.concat_tables([found(s), *out])

    return run
