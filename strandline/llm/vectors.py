"""Near duplicates among embeddings by an inverted multi-index.

Each half of the unit vectors has a codebook of its own, and the pairs of
codewords form a grid of cells. A vector is filed in the cell of its two nearest codewords and
visits cells in the order of the summed squared distances to their codewords
(multi-sequence traversal), until a limit. The limit is calibrated on
sample vectors that the codebooks were not fitted on: they are turned by the angle of the threshold in random directions, and it is
the distance that reaches the turned vector's cell in ``RECALL`` of the cases; a pair
can be found from both of its ends, and closer pairs are found more often. What meets in a cell is
verified by cosine in double precision.

Vectors are compared only with equal labels. Equal vectors are one class,
verified once and weighted with their number. A cell is worked on in blocks of at most ``BLOCK`` filed
against ``BLOCK`` visiting vectors. Each pair is counted in one block: if both ends visit each other's
cell, in that where the smaller id visits. A block returns sums of links and a spanning
forest, never its pairs. Distances to codewords are summed row by row, so both ends of a pair come to the same decision.

The codebooks come from at most ``SAMPLE`` classes, those with the smallest
hashes; every row is filed and visits.

Defined cases: rows with a null id, null label, null or empty vector, null or
non-finite component or only zeros link with nothing and are their own component; repeated
rows count as vectors of their own; vectors of different lengths never link; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import common, words

SAMPLE, RECALL, BLOCK = 20_000, 0.97, 1024
#: Classes for each pair of codewords that the codebooks' size aims at, and their largest size.
FILL, MOST_CODES = 800, 256


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def distances(half: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to the codewords.

    Each is summed by itself, so that a row's distances don't depend on the rows beside it.
    """
    out = np.empty((len(half), len(codes)))
    for i in range(0, len(half), step := max(1, (1 << 20) // max(1, codes.size))):
        differ = half[i : i + step, None] - codes[None]
        out[i : i + step] = np.square(differ, out=differ).sum(2)
    return out


def codebook(half: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords by Lloyd's iterations from evenly picked rows."""
    codes = half[np.linspace(0, len(half) - 1, min(k, len(half))).astype(int)].copy()
    for _ in range(rounds):
        near = distances(half, codes).argmin(1)
        for j in range(len(codes)):
            if (near == j).any():
                codes[j] = half[near == j].mean(0)
    return codes


class Grid:
    """The product grid of two codebooks with its calibrated limit."""

    def __init__(self, rows: np.ndarray, k: int, cosine: float):
        self.cut = rows.shape[1] // 2
        fitted, unseen = rows[0::2], rows[1::2]
        self.codes = codebook(fitted[:, : self.cut], k), codebook(fitted[:, self.cut :], k)
        turn = np.random.default_rng(5).normal(size=unseen.shape)
        turn -= (turn * unseen).sum(1, keepdims=True) * unseen
        norm = np.sqrt((turn * turn).sum(1, keepdims=True))
        turned = cosine * unseen + np.sqrt(1 - cosine * cosine) * turn / np.where(norm > 0, norm, 1)
        a, b = self.halves(unseen)
        c, d = (x.argmin(1) for x in self.halves(turned))
        at = np.arange(len(unseen))
        self.limit = float(np.quantile(a[at, c] + b[at, d], RECALL))

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(rows[:, : self.cut], self.codes[0]), distances(rows[:, self.cut :], self.codes[1])

    def visits(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the visits of rows with these distances; a row's own cell comes first.

        Multi-sequence traversal of all rows side by side: with both codebooks in order of
        distance, the frontier goes down the first one, as far along the second as the limit allows.
        """
        wide = second.shape[1]
        left, right = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
        near, rows = np.take_along_axis(second, right, 1), np.arange(len(first))
        out = [(rows, left[:, 0] * wide + right[:, 0])]
        for i in range(first.shape[1]):
            reach = (first[rows, left[rows, i]][:, None] + near[rows] <= self.limit).sum(1)
            rows, reach = rows[reach > 0], reach[reach > 0]
            if not len(rows):
                break
            at = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            who = np.repeat(rows, reach)
            some = (at > 0) | (i > 0)  # the own cell is there already
            out.append((who[some], (left[who, i] * wide + right[who, at])[some]))
        row, cell = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], cell[order]


_CELLS = pa.schema([("label", pa.string()), ("cell", pa.int64()), ("filed", pa.bool_()), ("rep", pa.int64()), ("weight", pa.int64()), ("home", pa.int64())])


def _filed(grids: dict[int, Grid]):
    """A row for the cell of a class and one for each cell that it visits."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(3)
            size = vectors.value_lengths().to_numpy()
            for d in np.unique(size):
                some = np.flatnonzero(size == d)
                grid = grids.get(int(d))
                for i in range(0, len(some), 256):
                    rows = some[i : i + 256]
                    if grid:
                        row, cell = grid.visits(*grid.halves(unit(vectors.take(pa.array(rows)).flatten().to_numpy().reshape(-1, d))))
                    else:
                        row, cell = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                    home = cell[np.searchsorted(row, np.arange(len(rows)))]
                    which = pa.array(rows[np.concatenate((np.arange(len(rows)), row))])
                    filed = np.arange(len(rows) + len(row)) < len(rows)
                    own = [batch.column(c).take(which) for c in range(3)]
                    yield pa.record_batch([own[0], pa.array(np.concatenate((home, cell))), pa.array(filed), own[1], own[2], pa.array(np.concatenate((home, home[row])))], schema=_CELLS)

    return run


def _block(grids: dict[int, Grid], cosine: float, single: bool):
    """(id, links, root) of the linked classes of a block."""

    def forest(mask: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest id that each row and each column reaches over the mask."""
        big = np.iinfo(np.int64).max
        while True:
            new = np.minimum(columns, np.where(mask, rows[:, None], big).min(0))
            to = np.minimum(rows, np.where(mask, new[None], big).min(1))
            if (new == columns).all() and (to == rows).all():
                return rows, columns
            rows, columns = to, new

    def run(group):
        filed = group.column("filed").to_numpy(zero_copy_only=False).astype(bool)
        rep, weight, home = (group.column(c).to_numpy() for c in ("rep", "weight", "home"))
        blobs = group.column("vector").to_pylist()
        data = np.frombuffer(b"".join(blobs), np.float32 if single else np.float64).reshape(len(blobs), -1) if blobs else np.zeros((0, 1))
        data = unit(data) if blobs else data
        s, q = np.flatnonzero(filed), np.flatnonzero(~filed)
        none = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(s) or not len(q):
            return none
        mask = data[q] @ data[s].T >= cosine
        mask &= rep[q][:, None] != rep[s][None]
        grid = grids.get(data.shape[1])
        if grid:  # does the filed one visit the visitor's home too?
            a, b = grid.halves(data[s])
            wide = len(grid.codes[1])
            back = (a[:, home[q] // wide] + b[:, home[q] % wide]).T <= grid.limit
        else:
            back = np.ones_like(mask)
        back |= home[q][:, None] == home[s][None]
        mask &= ~back | (rep[q][:, None] < rep[s][None])
        if not mask.any():
            return none
        x, y = forest(mask, rep[q], rep[s])
        links = [mask @ weight[s], weight[q] @ mask]
        keep = [n > 0 for n in links]
        parts = [np.concatenate([v[k] for v, k in zip(pair, keep, strict=True)]) for pair in ((rep[q], rep[s]), links, (x, y))]
        return pa.table({"id": parts[0], "links": parts[1].astype(np.int64), "root": parts[2]})

    return run


def _packed_vectors(kind: str):
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: np.asarray(v, kind).tobytes())

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return run


def codebook_size(classes: int) -> int:
    return int(min(MOST_CODES, max(2, (classes / FILL) ** 0.5)))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept), a row for each row of ``vectors``."""
    spark = vectors.sparkSession
    common.arrow_rows(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    named = base.withColumn("fine", F.coalesce(fine, F.lit(False))).select("id", "fine", "v", "label", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"))
    classes = named.where("fine").groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = common.table(classes, "classes")
    total = classes.count()
    sample = classes.orderBy("h1", "h2", "rep").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()  # at most SAMPLE vectors
    size = sample.value_lengths().to_numpy(zero_copy_only=False)
    grids: dict[int, Grid] = {}
    for d in np.unique(size).tolist():
        own = sample.filter(pa.array(size == d)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        if d > 1 and len(own) >= 40:
            grids[d] = Grid(unit(own), codebook_size(total), cosine)
    source = classes.select(F.concat_ws("|", F.size("v"), "label").alias("label"), "rep", "weight", "v")
    # ids travel first; vectors follow in the form they came in, once their blocks are known
    visits = common.table(source.mapInArrow(words.released(_filed(grids)), "label string, cell long, filed boolean, rep long, weight long, home long"), "visits")
    counts = visits.groupBy("label", "cell").agg(F.count_if("filed").alias("filed_rows"), F.count_if(~F.col("filed")).alias("visitors")).where("filed_rows > 0 and filed_rows + visitors > 2")
    tiles = [F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int") for c in ("filed_rows", "visitors")]
    counts = common.table(counts.select("label", "cell", tiles[0].alias("tf"), tiles[1].alias("tv")), "grid", common.worth(total))
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    pack = F.pandas_udf(_packed_vectors("<f4" if single else "<f8"), "binary")
    packed = classes.select("rep", pack("v").alias("vector"))
    placed = common.skew_join(visits, counts, ["label", "cell"], "rep")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("filed"), F.col("tf")).otherwise(F.col("tv"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("filed"), F.col("tv")).otherwise(F.col("tf")) - 1))
    tiles = placed.withColumn("own", own).withColumn("other", other)
    tiles = tiles.join(packed, "rep").select("label", "cell", F.when(F.col("filed"), F.col("own")).otherwise(F.col("other")).alias("f"), F.when(F.col("filed"), F.col("other")).otherwise(F.col("own")).alias("q"), "filed", "rep", "weight", "home", "vector")
    found = common.table(tiles.groupBy("label", "cell", "f", "q").applyInArrow(_block(grids, cosine, single), "id long, links long, root long"), "links")
    common.drop(visits)
    parts = common.connected_components(common.table(found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b"), "pairs", common.worth(found.count())))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("label", "h1", "h2", F.col("rep").alias("id"), "weight").join(sums, "id", "left").join(parts, "id", "left")
    known = known.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    mine = common.table(named.where("fine").select("id", "label", "h1", "h2"), "named")
    out = common.skew_join(mine, known, ["label", "h1", "h2"], "id").select("id", "n_links", "component_id")
    alone = named.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = out.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
