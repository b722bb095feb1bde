"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Vectors are scaled to length one and projected on many random directions. Two vectors at cosine c lie within a known
spread of each other on every direction, so a query's window around its own projection catches its neighbours. Pairs
are sought inside cells: a table's cell is the combination of a few quantised projections, and several tables make up
for pairs that a cell border separates. In a cell the rows are sorted by one projection, which differs from table to
table, each row looks at those in its window, and the windows of all projections that the pair shares are counted. Pairs
that reach the calibrated count are verified with the exact cosine. Directions a cell, tables and the count follow from
the number of rows and the wanted recall at the threshold itself, the sought window included, so cells stay small as the
corpus grows.

Vectors are dealt to cells as sketches first, a byte a counted direction. Counting on sketches, with windows wider by what
rounding may take, shows which rows have any partner in a cell; only those are dealt there with their whole vectors, for
the count itself and the cosine. Unrelated rows, most of a corpus, are never copied into their cells.

Equal vectors are folded into one row with a weight first. A cell with more rows than a block is cut into blocks, and
every pair of its blocks is a task of its own, so a large group is spread over the cluster and still compared in full.
A pair that meets in several tables counts in the first of them. The index is calibrated to find 0.95 of the pairs at the
threshold itself and so loses a few links near it; pairs further above it are found nearly all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, stash

#: Width of a quantisation cell on one direction.
CELL = 1.0
#: Directions whose windows are counted, and half the width of a window.
COUNTED, WINDOW = 24, 0.5
#: Rows that a cell holds by chance, about; more directions a cell keep it there.
CELL_ROWS = 32
#: Rows of a block; larger cells are compared block by block.
BLOCK_ROWS = 4096
#: Pairs counted at a time in a task, and rows of cells gathered before counting.
PAIRS, GATHERED = 1 << 18, 1 << 14
#: Distance between cells on the line where the windows of many cells are sought at once; projections are far smaller.
APART = 1024.0
#: What windows are sought wider by, as the line rounds; the window itself is then tested.
SLACK = 1e-6
#: Steps of a sketch in a projection's unit; a sketch reaches to 8, projections lie near 1.
STEPS = 16
SEED = 20240229


@dataclass(frozen=True)
class Plan:
    """What an index over some number of rows uses."""

    threshold: float
    per_cell: int
    tables: int
    least: int


def calibrate(rows: int, threshold: float = 0.95, recall: float = 0.95) -> Plan:
    """Directions a cell, tables and the least count for a wanted recall of pairs exactly at the threshold.

    On one direction the projections of a pair at distance d differ by a normal variable of spread d, those of an
    unrelated pair by one of spread about 1.41. A pair is found if it reaches the count and shares, in some table, both
    the cell and the window of the direction that the table seeks on.
    """
    d = math.sqrt(2.0 * (1.0 - threshold))

    def same_cell(spread: float) -> float:
        x = np.linspace(0.0, CELL, 2001)
        density = np.exp(-0.5 * (x / spread) ** 2) * 2.0 / (spread * math.sqrt(2.0 * math.pi))
        return float(np.sum(density * (1.0 - x / CELL)) * (x[1] - x[0]))

    near, far = same_cell(d), same_cell(math.sqrt(2.0))
    per_cell = max(2, math.ceil(math.log(max(2.0, rows / CELL_ROWS)) / -math.log(far)))
    inside = math.erf(WINDOW / d / math.sqrt(2.0))
    shares = [math.comb(COUNTED, k) * inside**k * (1.0 - inside) ** (COUNTED - k) for k in range(COUNTED + 1)]
    least = COUNTED
    while least > 0 and sum(shares[least:]) < math.sqrt(recall):
        least -= 1

    def found(tables: int) -> float:
        each, more = divmod(tables, COUNTED)
        total = 0.0
        for k in range(least, COUNTED + 1):
            # Of k shared windows, j are among the directions that one more table than the others seeks on.
            for j in range(max(0, k + more - COUNTED), min(k, more) + 1):
                odds = math.comb(more, j) * math.comb(COUNTED - more, k - j) / math.comb(COUNTED, k)
                total += shares[k] * odds * -math.expm1((each * k + j) * math.log1p(-(near**per_cell)))
        return total

    low, tables = 0, 1
    while found(tables) < recall:
        low, tables = tables, 2 * tables
    while tables - low > 1:
        middle = (low + tables) // 2
        low, tables = (low, middle) if found(middle) >= recall else (middle, tables)
    return Plan(threshold, per_cell, tables, least)


def _directions(dim: int, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions of the cells (dim, tables * per_cell), their offsets, and the counted directions (dim, COUNTED)."""
    rng = np.random.default_rng([SEED, dim])
    counted = rng.standard_normal((dim, COUNTED))
    counted *= math.sqrt(dim) / np.sqrt(np.einsum("ij,ij->j", counted, counted))  # the spread of calibrate() on each
    rng = np.random.default_rng([SEED, dim, plan.tables, plan.per_cell])
    cells = rng.standard_normal((dim, plan.tables * plan.per_cell))
    return cells, rng.random(plan.tables * plan.per_cell) * CELL, counted


def _cells(unit: np.ndarray, plan: Plan) -> np.ndarray:
    """The cell of every row in every table as a 64-bit hash of table, dimension and quantised projections."""
    cells, offset, _ = _directions(unit.shape[1], plan)
    q = np.floor((unit @ cells + offset) / CELL).astype(np.int64).reshape(len(unit), plan.tables, plan.per_cell)
    h = np.full(q.shape[:2], unit.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= (np.arange(plan.tables, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(plan.per_cell):
        h = (h ^ q[:, :, k].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _units(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, length-one vectors in double precision) of a column without nulls, by length of the vectors."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        v = values[starts[rows][:, None] + np.arange(n)]
        v = v / np.abs(v).max(axis=1, keepdims=True)
        yield rows, v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the classes of pairs (i, j)."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _candidates(line: np.ndarray, width: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a sorted line that lie at most a width apart, each once."""
    end = np.searchsorted(line, line + width, "right")
    n = end - np.arange(len(line)) - 1
    at = 0
    while at < len(line):
        last = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), PAIRS, "right")))
        part = n[at:last]
        i = np.repeat(np.arange(at, at + len(part)), part)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        at = last


def _counted(i: np.ndarray, j: np.ndarray, spots: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that lie within a width of each other on at least so many directions."""
    hits = np.zeros(len(i), dtype=np.int16)
    for k in range(COUNTED):
        hits += np.abs(spots[i, k] - spots[j, k]) <= width
        if k % 4 == 0:  # pairs that cannot reach the count any more go early
            alive = hits + (COUNTED - 1 - k) >= least
            i, j, hits = i[alive], j[alive], hits[alive]
    keep = hits >= least
    return i[keep], j[keep]


def sketches(unit: np.ndarray, plan: Plan) -> np.ndarray:
    """The counted projections of vectors of length one, rounded down to bytes."""
    spots = np.floor(unit @ _directions(unit.shape[1], plan)[2] * STEPS)
    return np.clip(spots, -128, 127).astype(np.int8)


def partnered(sketch: np.ndarray, group: np.ndarray, table: np.ndarray, side: np.ndarray, crossed: np.ndarray, plan: Plan) -> np.ndarray:
    """Which rows have a partner in their group that could reach the count, judged by sketches: no row of a pair is missed.

    Rounded projections of a pair inside a window differ by the window's steps and one more at most.
    """
    width = WINDOW * STEPS + 1
    spots = sketch.astype(np.int16)
    sought = spots[np.arange(len(spots)), table % COUNTED]
    line = group.astype(np.int64) * int(APART) * STEPS + sought
    order = np.argsort(line, kind="stable")
    line, spots, side, crossed = line[order], spots[order], side[order], crossed[order]
    out = np.zeros(len(line), dtype=bool)
    for i, j in _candidates(line, width):
        # A row that has a partner needs no second one.
        use = (~crossed[i] | (side[i] != side[j])) & ~(out[i] & out[j])
        i, j = _counted(i[use], j[use], spots, width, plan.least)
        out[i] = out[j] = True
    back = np.empty(len(order), dtype=bool)
    back[order] = out
    return back


def compare(unit: np.ndarray, group: np.ndarray, table: np.ndarray, side: np.ndarray, crossed: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows inside each group (part of a cell) that no earlier table has found: count, then verify.

    The groups are laid out apart on one line by the projection that their table seeks on, so all windows are sought at
    once. In a crossed group only rows of different sides are compared.
    """
    _, _, counted = _directions(unit.shape[1], plan)
    spots = unit @ counted
    sought = table % COUNTED
    line = group * APART + spots[np.arange(len(spots)), sought]
    order = np.argsort(line, kind="stable")
    spots, line = spots[order], line[order]
    side, crossed, table, sought = side[order], crossed[order], table[order], sought[order]
    out_i, out_j = [], []
    for i, j in _candidates(line, WINDOW + SLACK):
        use = (~crossed[i] | (side[i] != side[j])) & (np.abs(spots[i, sought[i]] - spots[j, sought[i]]) <= WINDOW)
        i, j = _counted(i[use], j[use], spots, WINDOW, plan.least)
        keep = np.einsum("ij,ij->i", unit[order[i]], unit[order[j]]) >= plan.threshold
        out_i.append(i[keep])
        out_j.append(j[keep])
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (out_i, out_j))
    if not len(i):
        return i, j
    rows = np.unique(np.concatenate([i, j]))
    cells = _cells(unit[order[rows]], plan)
    a, b, t = np.searchsorted(rows, i), np.searchsorted(rows, j), table[i]
    new = np.ones(len(i), dtype=bool)
    for k in range(plan.tables):
        apart = np.abs(spots[i, k % COUNTED] - spots[j, k % COUNTED]) > WINDOW
        new &= (cells[a, k] != cells[b, k]) | apart | (k >= t)
    return order[i[new]], order[j[new]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Returns (vec_id, n_links, component_id, kept), a row per row of ``vectors``.

    n_links counts the other rows linked directly (cosine of at least ``threshold`` in double precision), component_id
    is the smallest vec_id reachable over links, kept says whether that is the row's own. Vectors that are null, empty
    or zero, or hold null or non-finite parts, link with nothing; vectors link only with vectors of their length. Rows
    with a null vec_id link with nothing and have a null component. Rows that repeat a vec_id count as rows, so each
    may link with the other, and their vectors' classes are one. An empty table gives an empty result; other columns,
    named as they may be, are ignored. Links are found by an index with a calibrated ``recall``, see the module.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    good &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    folded = given.where(good).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    folded = stash(folded, "vectors")
    plan = calibrate(max(2, folded.count()), threshold, recall)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1024):
            for rows, unit in _units(batch.column("v")):
                keys = _cells(unit, plan)
                rep = batch.column("rep").take(pa.array(np.repeat(rows, plan.tables)))
                tables = np.tile(np.arange(plan.tables, dtype=np.int32), len(rows))
                sketch = pa.array([x.tobytes() for x in sketches(unit, plan)], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), plan.tables)))
                yield pa.RecordBatch.from_arrays([rep, pa.array(keys.reshape(-1)), pa.array(tables), sketch], ["rep", "cell", "t", "sketch"])

    keyed = folded.select("rep", "v").mapInArrow(spread, "rep long, cell long, t int, sketch binary")
    keyed = stash(keyed, "vector-cells")
    sizes = stash(keyed.groupBy("cell", "t").agg(F.count("*").alias("rows")).where("rows > 1"), "cell-sizes")
    shared = keyed.join(sizes, ["cell", "t"])
    blocks = F.ceil(F.col("rows") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("rep", "cell"), blocks).cast("int")
    placed = shared.withColumn("blocks", blocks).withColumn("own", own)
    # A row goes to every pair of blocks that its own block is part of; with one block that is the pair (0, 0).
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("own", other).alias("x"), F.greatest("own", other).alias("y")),
    )
    dealt = placed.select("rep", "cell", "t", "own", "sketch", F.explode(pairs).alias("pair"))
    dealt = dealt.select("rep", "cell", "t", "own", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "sketch")
    dealt = dealt.repartition("cell", "t", "x", "y").sortWithinPartitions("cell", "t", "x", "y", "own", "rep")

    def whole_groups(batches: Iterator[pa.RecordBatch], gathered: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Rows of whole groups (one cell and pair of blocks), some thousand at a time, with the number of each row's group."""

        def numbered(held: pa.Table) -> tuple[pa.Table, np.ndarray]:
            held = held.combine_chunks()
            keys = [held.column(c).to_numpy() for c in ("cell", "t", "x", "y")]
            return held, np.cumsum(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))

        held, rows = [], 0
        for batch in small_batches(batches, 4096):
            held.append(batch)
            rows += batch.num_rows
            if rows < gathered:
                continue
            # The last group may go on in the next batch; it is held back whole.
            whole = pa.Table.from_batches(held)
            keys = [whole.column(c).to_numpy() for c in ("cell", "t", "x", "y")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield numbered(whole.slice(0, cut))
            held, rows = whole.slice(cut).to_batches(), len(same) - cut
        if rows:
            yield numbered(pa.Table.from_batches(held))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, group in whole_groups(batches, 4 * GATHERED):
            t, x, y, own = (held.column(c).to_numpy() for c in ("t", "x", "y", "own"))
            sketch = np.frombuffer(b"".join(held.column("sketch").to_pylist()), dtype=np.int8).reshape(-1, COUNTED)
            keep = pa.array(partnered(sketch, group, t, own, x != y, plan))
            yield from held.drop_columns(["sketch"]).filter(keep).to_batches()

    alive = dealt.mapInArrow(narrow, "rep long, cell long, t int, own int, x int, y int")
    alive = stash(alive, "vector-partners")
    met = alive.join(folded, "rep").select("cell", "t", "x", "y", "own", "rep", "weight", "v")
    met = met.repartition("cell", "t", "x", "y").sortWithinPartitions("cell", "t", "x", "y", "own", "rep")

    def judge(held: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole groups: (rep, rep, n) with the row's new links, and (rep, rep, 0) for links that span classes."""
        t, x, y, own, rep, weight = (held.column(c).to_numpy() for c in ("t", "x", "y", "own", "rep", "weight"))
        for rows, unit in _units(held.column("v").chunk(0) if held.column("v").num_chunks else held.column("v")):
            i, j = compare(unit, group[rows], t[rows], own[rows], (x != y)[rows], plan)
            if not len(i):
                continue
            i, j = rows[i], rows[j]
            hit, at = np.unique(rep[np.concatenate([i, j])], return_inverse=True)
            links = np.bincount(at, weights=np.concatenate([weight[j], weight[i]])).astype(np.int64)
            edges = np.array(_forest(rep[i], rep[j]), dtype=np.int64).reshape(-1, 2)
            a, b = np.concatenate([hit, edges[:, 0]]), np.concatenate([hit, edges[:, 1]])
            n = np.concatenate([links, np.zeros(len(edges), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, group in whole_groups(batches, GATHERED):
            yield from judge(held, group)

    found = stash(met.mapInArrow(search, "a long, b long, n long"), "vector-links")
    # A vec_id with several vectors joins their classes.
    several = given.where(good).groupBy("vec_id").agg(F.count_distinct("v").alias("n")).where("n > 1").select("vec_id")
    joined = given.where(good).join(several, "vec_id").join(folded, "v").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    roots = components(found.where("n = 0").select("a", "b").unionByName(joined)).withColumnRenamed("node", "rep")
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    result = folded.join(counts, "rep", "left").join(roots, "rep", "left")
    result = result.select(
        F.col("v").alias("own_v"),
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "rep").alias("component_id"),
    )
    result = stash(result, "vector-results")
    out = given.withColumn("join_v", F.when(good, F.col("v"))).join(result, F.col("join_v") == F.col("own_v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )
