"""Jaccard join on word n-grams with count-vector R-trees.

Documents link when the sets of their distinct n-word shingles have a Jaccard
similarity of ``percent`` / 100 or more. The result names, for each row, the
component of documents that links reach.

How it works. Shingles are hashed into groups. Two linked sets with |A| + |B| =
s differ in at most d = s * (100 - p) / (100 + p) shingles, so of g groups at least g - d hold the
same shingles in both. A *cell* of the index is a size band, a group and that group's content; a
set is filed in the cell of each of its groups. Ordered by their number of members, among the first d + 1
cells of a set there is one that it shares with each set it links with; the others are left out.
So a passage that many documents hold makes no candidates of documents that are otherwise of their own. Of cells with the same
members one is kept. In each cell the heaviest member (the one with most company in all its cells)
is held against the others, which joins up nearly all groups of near copies in linear work. Cells
whose members are still in several components get R-trees over the vectors of
counts of shingles by group: a pair of nodes or points is left out when the sum of the
coordinates' minima, which bounds the overlap, is below what a link needs. What survives
is verified with the whole sets, so the links are exact. A call of the R-trees takes the cells
of some heaviest members and the sets of all their members once; it returns links that join
components, never pairs inside of one.

Cells are found from packed (key, set) pairs: equal sets count once, and a
task sends at most ``OPEN`` members of a cell to the one that gathers it; the
others are known to be in a shared cell and pass by. Nothing gathers all
members of a hot cell in one task; R-trees work on tiles of about ``TILE`` shingles, or a single set.

Defined cases: null or empty texts and texts of white space have no shingles
and link with nothing; with fewer words than n, the whole sequence is the one shingle;
rows with equal sets are in one component; rows that repeat an id stay repeated, and are one document (of several texts under one id, one is compared); rows
with a null id get a null component; an empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common, words

#: Members of a cell that one chunk of a task sends to where the cell is gathered.
OPEN = 8
#: Pairs of key and set that a task packs at once.
CHUNK = 1 << 19
#: Shingles of the members of a cell that stand on one side of an R-tree join, and those that one task call works on, about.
TILE, CALL = 1 << 18, 1 << 20
#: Coordinates of the count vectors.
GROUPS = 256
#: Shingles of a group of a long set, about, before it gets more groups for the bound on pairs.
DENSE = 2
#: Points of a leaf.
LEAF = 48

_LOWER, _SPACE = words.lower_table(), words.space_table()


def shingle_sets(column, n: int):
    """(first row, offsets, hashes): sorted distinct shingle hashes of runs of texts."""
    for lo, hi, raw, offs in words.slices(column):
        start, stop, doc = words.spans(raw, offs, _SPACE)
        own = words.run_hashes(_LOWER[raw], start, stop)
        size = np.bincount(doc, minlength=hi - lo)
        first = np.concatenate(([0], np.cumsum(size)))
        many = np.maximum(size - n + 1, (size > 0).astype(np.int64))
        at = np.concatenate(([0], np.cumsum(many)))
        owner = np.repeat(np.arange(hi - lo), many)
        begin = np.arange(at[-1]) - at[owner] + first[owner]
        hashes = words.run_hashes(own, begin, np.minimum(begin + n, first[owner + 1]), 23)
        for a, b in zip(at[:-1], at[1:], strict=True):
            hashes[a:b].sort()
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[keep], owner[keep]
        yield lo, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=hi - lo)))), hashes


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[offs[1:]] - total[offs[:-1]]


def set_ids(hashes: np.ndarray, offs: np.ndarray, which: int) -> np.ndarray:
    """Half ``which`` of a 128-bit name of each set."""
    salt = np.uint64((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[which])
    return words.mix(_sums(words.mix(hashes ^ salt), offs) + np.diff(offs).astype(np.uint64))


def bands(largest: int) -> np.ndarray:
    """Lower bounds of the size bands up to ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out + [max(out[-1] + 1, out[-1] * 5 // 4)], np.int64)


def _slots(hashes: np.ndarray, offs: np.ndarray, percent: int):
    """For each step: its number, sets, bands, groups and differences allowed of each, hashes and their group's slot.

    A set is filed under the band of its own size (step 0) and, as the smaller of a
    pair, under the next ones that a partner can reach.
    """
    size = np.diff(offs)
    edge = bands(int(size.max(initial=1)) * 100 // percent + 1)
    own = np.searchsorted(edge, size, "right") - 1
    top = np.searchsorted(edge, np.maximum(size * 100 // percent, 1), "right") - 1
    step = 0
    while True:
        which = np.flatnonzero((size > 0) & (own + step <= top))
        if not len(which):
            return
        band = own[which] + step
        differ = 2 * (edge[band + 1] - 1) * (100 - percent) // (100 + percent)
        some = differ > 0  # else only equal sets link
        which, band, differ = which[some], band[some], differ[some]
        if len(which):
            groups = differ + 2 + differ // 2
            base = np.concatenate(([0], np.cumsum(groups)))
            count = size[which]
            row = np.repeat(np.arange(len(which)), count)
            pick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offs[which], count)
            h = hashes[pick]
            slot = base[row] + ((words.mix(h + np.uint64(0x5851F42D)) >> np.uint64(33)).astype(np.int64) % groups[row])
            yield step, which, band, groups, differ, h, slot
        step += 1


def _filed(slot: np.ndarray, groups: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner of each slot, whether it is filed): empty groups only of sets in which so many are empty that they may be all that agrees."""
    owner = np.repeat(np.arange(len(groups)), groups)
    full = np.bincount(slot, minlength=len(owner)) > 0
    empty = np.bincount(owner[~full], minlength=len(groups))
    return owner, full | (empty >= groups - differ)[owner]


def cell_keys(hashes: np.ndarray, offs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, step) for each cell that a set is filed in."""
    keys, sets, steps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for step, which, band, groups, differ, h, slot in _slots(hashes, offs, percent):
        owner, keep = _filed(slot, groups, differ)
        content = np.zeros(len(owner), np.uint64)
        np.add.at(content, slot, words.mix(h ^ np.uint64(0x2545F4914F6CDD1D)))
        number = np.arange(len(owner)) - np.repeat(np.cumsum(groups) - groups, groups)
        label = (band[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)
        keys.append(words.mix(content ^ words.mix(label))[keep])
        sets.append(which[owner][keep])
        steps.append(np.full(keep.sum(), step, np.uint8))
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(steps)


def alone(hashes: np.ndarray, offs: np.ndarray, percent: int) -> list[list[int]]:
    """For each set and step, how many of its filed cells more than those of any prefix there are."""
    out: list[list[int]] = [[] for _ in range(len(offs) - 1)]
    for step, which, _, groups, differ, _, slot in _slots(hashes, offs, percent):
        owner, keep = _filed(slot, groups, differ)
        for i, n in zip(which.tolist(), (np.bincount(owner[keep], minlength=len(groups)) - differ - 1).tolist(), strict=True):
            out[i] += [0] * (step - len(out[i])) + [n]
    return out


def _sketch(n: int, percent: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("spare", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for lo, offs, hashes in shingle_sets(batch.column(1), n):
                ids = batch.column(0).slice(lo, len(offs) - 1)
                own = (pa.array(x.view(np.int64)) for x in (np.diff(offs), set_ids(hashes, offs, 0), set_ids(hashes, offs, 1)))
                yield pa.record_batch([ids, *own, pa.array(alone(hashes, offs, percent), schema.types[4])], schema=schema)

    return run


def _packed(n: int, percent: int, buckets: int):
    """Keys with their sets, packed by bucket: 6 bytes of the key, 5 of the set's name, the step."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("packed", pa.binary())])

    def flush(keys, names, steps, turn):
        key, name, step = np.concatenate(keys), np.concatenate(names), np.concatenate(steps)
        order = np.lexsort((name, key))
        key, name, step = key[order], name[order], step[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, step = key[new], name[new], step[new]  # equal sets count once
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(head)
        length = np.diff(np.append(start, len(key)))
        rank = np.arange(len(key)) - np.repeat(start, length)
        hot = np.repeat(length > OPEN, length)
        rows = {0: ~hot, 1: hot & (rank == 0), 2: hot & (rank > 0)}
        out = []
        for kind, mask in rows.items():
            bucket = (key[mask] % np.uint64(buckets)).astype(np.int64)
            body = np.empty((mask.sum(), 12), np.uint8)
            body[:, :6] = (key[mask] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            body[:, 6:11] = name[mask].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            body[:, 11] = step[mask]
            order = np.argsort(bucket, kind="stable")
            body, bucket = body[order], bucket[order]
            if not len(bucket):
                continue
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
                # kind 2 is known to be shared and can pass anywhere, so hot cells spread
                piece = 4096 if kind == 2 else b - a
                for i in range(a, b, max(1, piece)):
                    turn += 1
                    to = int(bucket[a]) if kind < 2 else turn * 7919 % buckets
                    blob = body[i : min(b, i + piece)].tobytes()
                    out.append((to, kind, (int(bucket[a]).to_bytes(4, "little") if kind == 2 else b"") + blob))
        for i in range(0, len(out), 1024):
            part = out[i : i + 1024]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        keys, names, steps, held, turn = [], [], [], 0, 0
        for batch in batches:
            for _, offs, hashes in shingle_sets(batch.column(0), n):
                key, which, step = cell_keys(hashes, offs, percent)
                keys.append(key)
                steps.append(step)
                names.append(set_ids(hashes, offs, 0)[which])
                held += len(key)
                if held >= CHUNK:
                    yield from flush(keys, names, steps, turn)
                    keys, names, steps, held, turn = [], [], [], 0, turn + 13
        if held:
            yield from flush(keys, names, steps, turn)

    return run


def _cells(buckets: int):
    """Members (key, name, step) of the cells of a bucket that hold two sets or more."""

    def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
        body = np.frombuffer(blob, np.uint8).reshape(-1, 12)
        wide = np.zeros((len(body), 16), np.uint8)
        wide[:, :6], wide[:, 8:13] = body[:, :6], body[:, 6:11]
        both = wide.view("<u8").reshape(-1, 2)
        return both[:, 0], both[:, 1], body[:, 11]

    def run(key, group):
        bucket = key[0].as_py()
        kinds, packed = group.column("kind").to_pylist(), group.column("packed").to_pylist()
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))]
        for kind, blob in zip(kinds, packed, strict=True):
            if kind == 2:
                k, s, t = unpack(blob[4:])
                found.append((k * np.uint64(buckets) + np.uint64(int.from_bytes(blob[:4], "little")), s, t))
        own = [(*unpack(b), np.full(len(b) // 12, kind == 1)) for kind, b in zip(kinds, packed, strict=True) if kind < 2]
        if own:
            k, s, t, shared = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.lexsort((s, k))
            k, s, t, shared = k[order], s[order], t[order], shared[order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(k))
            many = (s[stop - 1] != s[start]) | (np.add.reduceat(shared.astype(np.int64), start) > 0)
            keep = np.repeat(many, stop - start)
            keep[1:] &= (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            found.append((k[keep] * np.uint64(buckets) + np.uint64(bucket), s[keep], t[keep]))
        k, s, t = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"key": k.view(np.int64), "name": s.view(np.int64), "step": t.astype(np.int32)})

    return run


def _groups(size: np.ndarray) -> np.ndarray:
    """Groups of a set's count vector: a power of two times ``GROUPS``, for about ``DENSE`` shingles each at most."""
    return GROUPS << np.ceil(np.log2(np.maximum(size / (DENSE * GROUPS), 1))).astype(np.int64)


def _vector(own: np.ndarray, groups: int) -> np.ndarray:
    """Counts of a set's shingles by group; groups are remainders, so fewer of them add up."""
    return np.bincount(((words.mix(own + np.uint64(77)) >> np.uint64(30)) % np.uint64(groups)).astype(np.int64), minlength=groups)


def _vectors(batches):
    """(id, n, counts, excess) of (id, shingles): counts are a byte each, ``excess`` is what bytes can't hold."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("excess", pa.int64())])
    for batch in batches:
        size, counts, excess = [], [], []
        for blob in batch.column(1).to_pylist():
            own = np.frombuffer(blob, np.uint64)
            count = _vector(own, int(_groups(np.array([len(own)]))[0]))
            held = np.minimum(count, 255)
            size.append(len(own))
            counts.append(held.astype(np.uint8).tobytes())
            excess.append(int((count - held).sum()))
        yield pa.record_batch([batch.column(0), *(pa.array(x, t) for x, t in zip((size, counts, excess), schema.types[1:], strict=True))], schema=schema)


def _sets(n: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for lo, offs, hashes in shingle_sets(batch.column(1), n):
                blobs = [hashes[x:y].tobytes() for x, y in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(lo, len(blobs)), pa.array(blobs, pa.binary())], schema=schema)

    return run


def _folded(blob: bytes, groups: int) -> np.ndarray:
    own = np.frombuffer(blob, np.uint8)
    return own if len(own) == groups else own.reshape(-1, groups).sum(0, dtype=np.int32)


def _bounded(percent: int):
    """Pairs (a, b) whose summed minima admit a link, from (a, b, na, nb, ca, cb, ea, eb)."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            bound = np.minimum(batch.column(6).to_numpy(), batch.column(7).to_numpy()).copy()
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                groups = min(len(x), len(y))
                bound[i] += int(np.minimum(_folded(x, groups), _folded(y, groups)).sum(dtype=np.int64))
            keep = pa.array((100 + percent) * bound >= percent * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _similar(percent: int):
    """Pairs (a, b) that link, from (a, b, sa, sb)."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append((100 + percent) * _overlap(x, y) >= percent * (len(x) + len(y)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, that link: count vectors bound them first, whole sets verify the rest."""
    few = common.worth(pairs.count(), 20_000)
    left, right = (vectors.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"), F.col("excess").alias(f"e{x}")) for x in "ab")
    half = common.skew_join(pairs, left, ["a"], "b").join(right, "b").where(f"{percent} * greatest(na, nb) <= 100 * least(na, nb)")
    bounded = common.table(half.select("a", "b", "na", "nb", "ca", "cb", "ea", "eb").mapInArrow(words.released(_bounded(percent)), "a long, b long"), "bounded", few)
    left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = common.skew_join(bounded, left, ["a"], "b").join(right, "b").select("a", "b", "sa", "sb")
    out = common.table(both.mapInArrow(words.released(_similar(percent)), "a long, b long"), "links", few)
    common.drop(bounded)
    return out


class RTree:
    """A packed R-tree over count vectors: leaves of near points, nodes with upper corners.

    A point and a corner end with ``excess``, the sum of what the other coordinates leave out.
    """

    def __init__(self, points: np.ndarray, size: np.ndarray, excess: np.ndarray | None = None):
        self.points, self.size = points, size
        self.excess = np.zeros(len(points), np.int64) if excess is None else excess
        self.nodes: list[tuple] = []  # (upper corner, excess, least size, children or rows)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        if len(rows) <= LEAF:
            below = rows
        else:
            own = self.points[rows]
            axis = int(np.argmax(own.max(0).astype(np.int64) - own.min(0)))
            rows = rows[np.argsort(self.points[rows, axis], kind="stable")]
            below = [self._build(x) for x in np.array_split(rows, min(8, -(-len(rows) // LEAF)))]
        self.nodes.append((self.points[rows].max(0), self.excess[rows].max(), self.size[rows].min(), below))
        return len(self.nodes) - 1


def tree_pairs(left: RTree, right: RTree, percent: int):
    """(row of left, rows of right) of points whose bound admits a link."""
    todo = [(left.root, right.root)]
    while todo:
        x, y = todo.pop()
        (up, more, low, xs), (up2, more2, low2, ys) = left.nodes[x], right.nodes[y]
        if (100 + percent) * (int(np.minimum(up, up2).sum(dtype=np.int64)) + int(min(more, more2))) < percent * int(low + low2):
            continue
        if isinstance(xs, list) or isinstance(ys, list):
            todo += [(a, b) for a in (xs if isinstance(xs, list) else [x]) for b in (ys if isinstance(ys, list) else [y])]
            continue
        other = right.points[ys]
        for i in xs:
            bound = np.minimum(left.points[i], other).sum(1, dtype=np.int64) + np.minimum(left.excess[i], right.excess[ys])
            hits = ys[(100 + percent) * bound >= percent * (left.size[i] + right.size[ys])]
            if len(hits):
                yield int(i), hits


def spanning_links(cells: list[tuple[np.ndarray, np.ndarray]], sets: list[np.ndarray], part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different parts, enough to join what links join; no link inside a joined part.

    ``cells`` are pairs of arrays of rows, the two sides of a tile pair.
    """
    top = {int(p): int(p) for p in part}

    def root(p: int) -> int:
        while top[p] != p:
            top[p] = p = top[top[p]]
        return p

    size, out = np.array([len(s) for s in sets], np.int64), []
    known: dict[tuple[int, int], tuple[np.ndarray, int]] = {}

    def counts(i: int, groups: int) -> tuple[np.ndarray, int]:
        if (i, groups) not in known:
            own = _vector(sets[i], groups)
            held = np.minimum(own, 255)
            known[i, groups] = held.astype(np.uint8), int((own - held).sum())
        return known[i, groups]

    for sides in cells:
        same = sides[0] is sides[1]
        if len({root(int(p)) for side in sides for p in part[side]}) < 2:
            continue
        groups = int(_groups(size[np.concatenate(sides)].min(keepdims=True))[0])
        trees = []
        for side in sides[:1] if same else sides:
            points, excess = zip(*(counts(i, groups) for i in side.tolist()), strict=True)
            trees.append(RTree(np.stack(points), size[side], np.array(excess)))
        for i, hits in tree_pairs(trees[0], trees[-1], percent):
            a = int(sides[0][i])
            for j in hits:
                b = int(sides[1][j])
                if b == a or (same and j <= i):
                    continue
                x, y = root(int(part[a])), root(int(part[b]))
                if x != y and (100 + percent) * _overlap(sets[a], sets[b]) >= percent * int(size[a] + size[b]):
                    top[max(x, y)] = min(x, y)
                    out.append((a, b))
    return out


def _tile_links(percent: int):
    """Links that join the parts of a call's cells, from their members and the members' sets."""

    def run(key, rows, held):
        cell, ids, part, tile, lo, hi = (rows.column(c).to_numpy() for c in ("key", "id", "part", "tile", "lo", "hi"))
        names = held.column("who").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in held.column("shingles").to_pylist()]
        sort = np.argsort(names)
        at = sort[np.searchsorted(names, ids, sorter=sort)]
        parts = np.zeros(len(names), np.int64)
        parts[at] = part
        order = np.lexsort((hi, lo, cell))
        cell, at, tile, lo, hi = (x[order] for x in (cell, at, tile, lo, hi))
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        start = np.flatnonzero(new)
        cells = []
        for x, y in zip(start.tolist(), np.append(start[1:], len(cell)).tolist(), strict=True):
            members = at[x:y]
            sides = (members, members) if lo[x] == hi[x] else (members[tile[x:y] == lo[x]], members[tile[x:y] == hi[x]])
            if all(map(len, sides)):
                cells.append(sides)
        found = np.array(spanning_links(cells, sets, parts, percent), np.int64).reshape(-1, 2)
        words.trim()
        return pa.table({"a": names[found[:, 0]], "b": names[found[:, 1]]})

    return run


def _together(filed: DataFrame) -> DataFrame:
    """``filed`` (key, id, ...) with ``members``, where a cell has two or more; a written table."""
    members = filed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return common.table(common.skew_join(filed, members, ["key"], "id"), "joint", common.worth(filed.count()))


def _different(joint: DataFrame) -> DataFrame:
    """The rows of one cell for each set of members; a written table."""
    name = (F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in range(2))
    cells = joint.groupBy("key").agg(F.count("*").alias("members"), *name)
    cells = cells.groupBy("members", "x0", "x1").agg(F.min("key").alias("key"))
    out = common.table(common.skew_join(joint, cells.select("key"), ["key"], "id"), "joint", common.worth(joint.count()))
    common.drop(joint)
    return out


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id), a row for each row of ``docs``."""
    spark = docs.sparkSession
    common.arrow_rows(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = common.table(base.mapInArrow(words.released(_sketch(n, percent)), "id long, n long, s1 long, s2 long, spare array<int>"), "sets")
    few = common.worth(seen.count())
    reps = common.table(seen.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("spare").alias("spare")).withColumn("name", F.expr("s1 & 1099511627775L")), "reps", few)
    total = seen.agg(F.sum("n")).first()[0] or 0
    buckets = int(min(1 << 20, max(512, total // 2_000_000)))
    packed = base.where("id is not null").select("text").mapInArrow(words.released(_packed(n, percent, buckets)), "bucket int, kind byte, packed binary")
    cells = packed.groupBy("bucket").applyInArrow(_cells(buckets), "key long, name long, step int")
    filed = common.table(cells.join(reps.select("name", "rep"), "name").select("key", F.col("rep").alias("id"), "step").distinct(), "cells")
    joint = _together(filed)
    # a set's cells in order of their members: one of the first ones is shared with each partner
    order = Window.partitionBy("id", "step")
    ranked = joint.withColumn("rank", F.row_number().over(order.orderBy("members", "key"))).withColumn("shared", F.count("*").over(order))
    ranked = ranked.join(reps.select(F.col("rep").alias("id"), "spare"), "id").where(F.col("rank") <= F.col("shared") - F.get("spare", F.col("step")))
    first = common.table(ranked.select("key", "id"), "first", common.worth(joint.count()))
    common.drop(filed, joint)
    joint = _different(_together(first))
    weight = joint.groupBy("id").agg(F.sum("members").alias("weight"))
    wanted = common.table(weight, "wanted", few)
    some = common.worth(wanted.count(), 20_000)
    ids = wanted.select("id")
    sets = common.table(base.join(F.broadcast(ids) if common.small(ids) else ids, "id", "left_semi").mapInArrow(words.released(_sets(n)), "id long, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles")), "shingles", some)
    vectors = common.table(sets.mapInArrow(words.released(_vectors), "id long, n long, counts binary, excess long"), "vectors", some)
    many = common.worth(joint.count())
    placed = common.table(joint.join(wanted, "id").select("key", "id", "weight"), "placed", many)
    common.drop(first, joint)
    common.tidy(spark)

    # the heaviest member of each cell is held against the others, which joins up most groups of copies
    pivots = placed.groupBy("key").agg((-F.max(F.struct("weight", -F.col("id"))).getField("col2")).alias("pivot"))
    placed = common.table(common.skew_join(placed, pivots, ["key"], "id"), "pivots", many)
    tried = common.table(placed.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "tried", many)
    links = _links(tried, sets, vectors, percent)
    parts = common.table(common.connected_components(links), "parts", few)
    common.tidy(spark)

    # cells with members in several parts: R-trees, with a member's set once for all cells of a call
    size = vectors.select("id", "n")
    placed = placed.join(parts.withColumnRenamed("component_id", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    placed = common.table(placed.join(size, "id"), "parted", many)
    opened = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.sum("n").alias("n")).where("p <> q").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    rest = common.skew_join(placed, opened, ["key"], "id").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = common.table(rest.select("key", "pivot", "id", "n", "part", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")), "units", many)
    volume = units.groupBy("pivot").agg(F.ceil(F.sum("n") / CALL).cast("long").alias("splits"))
    calls = int(max(64, (units.agg(F.sum("n")).first()[0] or 0) // CALL))
    split = F.pmod(F.xxhash64("key", "lo", "hi"), F.col("splits"))
    dealt = common.skew_join(units, volume, ["pivot"], "key").withColumn("call", F.pmod(F.xxhash64("pivot", split), F.lit(calls)))
    dealt = common.table(dealt.select("call", "key", "id", "part", "tile", "lo", "hi"), "dealt", common.worth(units.count()))
    held = dealt.select(F.col("call").alias("to"), F.col("id").alias("who")).distinct().join(sets.select(F.col("id").alias("who"), "shingles"), "who")
    late = dealt.groupBy("call").cogroup(held.groupBy("to")).applyInArrow(_tile_links(percent), "a long, b long")
    late = common.table(late.distinct(), "late", many)
    if late.limit(1).count():
        parts = common.table(common.connected_components(links.unionByName(late)), "parts", few)
    known = reps.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    own = seen.where("n > 0 and id is not null")
    out = common.skew_join(common.table(own, "own", few), known, ["s1", "s2"], "id").select("id", "n", "component_id")
    out = out.unionByName(seen.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def near_duplicates_removed(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows without shingles and rows with a null id stay, and so do all rows that repeat an id that stays.
    """
    found = jaccard_components(docs, n, percent, id_col, text_col)
    gone = common.table(found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "gone", common.worth(docs.count()))
    return docs.join(F.broadcast(gone) if common.small(gone) else gone, id_col, "left_anti").select(*docs.columns)
