"""Nearest vectors by inverted lists: a coarse quantiser puts every vector into a cell, a search looks into the cells nearest to its query.

The quantiser is fitted on a bounded sample; every vector is indexed, copies and outliers included. The exact mode
looks, after the nearest cells, into each further cell that may hold something nearer: a cell's
radius and its centre's distance bound that from below. Hot cells are dealt to pieces of at most
PIECE rows, so a third of all vectors in one cell is work for many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20_000  # vectors that the quantiser is fitted on, at most
CELLS = 4096  # at most
PIECE = 20_000  # vectors, and queries, of a cell that meet in one task
ROOM = 65_536  # distances of vectors to centres that a task holds at once


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray  # cells x dimension
    cosine: bool = False

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of each row to each centre."""
        d = (x * x).sum(1)[:, None] + (self.centres * self.centres).sum(1)[None, :] - 2 * x @ self.centres.T
        return np.sqrt(np.maximum(d, 0))


def _rows(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, dim)


def _slices(batches, cells: int):
    """Batches of so few rows that their distances to all cells, and the rows' copies for them, stay within ROOM."""
    n = max(1, ROOM // max(1, cells))
    for b in batches:
        for i in range(0, len(b), n):
            yield b.slice(i, n)


def usable(vectors: DataFrame, dim: int, cosine: bool = False) -> DataFrame:
    """vectors (id, v) as id, v (array<double>): those of the dimension; for cosines scaled to length 1, without zero vectors."""
    v = F.transform("v", lambda x: x.cast("double"))
    out = vectors.filter(F.size("v") == dim).select("id", v.alias("v")).filter(~F.exists("v", lambda x: x.isNull()))
    if cosine:
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        out = out.withColumn("_n", norm).filter("_n > 0").select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))
    return out


def fit(vectors: DataFrame, dim: int, cells: int | None = None, cosine: bool = False, sample: int = SAMPLE, rounds: int = 10, seed: int = 7) -> Quantiser:
    """K-means over at most `sample` vectors, those of the least hashes of their ids; `cells` defaults to the square root of the number of vectors, CELLS at most."""
    rows = usable(vectors, dim, cosine)
    if cells is None:
        cells = min(CELLS, max(1, int(rows.count() ** 0.5)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = np.unique(_rows(picked.column("v"), dim), axis=0) if len(picked) else np.zeros((1, dim))
    r = np.random.default_rng(seed)
    centres = x[r.permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = Quantiser(centres).distances(x).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return Quantiser(centres, cosine)


def index(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """id, v, cell and r (distance to the cell's centre) of every vector (id, v) of the quantiser's dimension."""
    rows = usable(vectors, quantiser.dim, quantiser.cosine)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in _slices(batches, len(quantiser.centres)):
            d = quantiser.distances(_rows(b.column(1), quantiser.dim))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "r"])

    return rows.mapInArrow(run, f"id {kind}, v array<double>, cell int, r double")


def _nearest(k: int):
    """The k nearest vectors of each query, among those of one piece of a cell."""

    def run(left, right):
        out = {"qid": [], "id": [], "distance": []}
        if len(left) and len(right):
            ids, dim = left.column("id"), len(left.column("v")[0].as_py())
            x = _rows(left.column("v"), dim)
            q = _rows(right.column("qv"), dim)
            xx = (x * x).sum(1)
            for i in range(0, len(q), 256):
                some = q[i : i + 256]
                d = xx[None, :] + (some * some).sum(1)[:, None] - 2 * some @ x.T
                # candidates by the fast formula with room for its rounding, then by exact differences
                room = 1e-9 * (xx.max() + (some * some).sum(1).max() + 1)
                kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                for j in range(len(some)):
                    at = np.flatnonzero(d[j] <= kth[j] + room)
                    true = ((x[at] - some[j]) ** 2).sum(1)
                    if len(at) > k:
                        # of equal distances the least ids go first, so all at the k-th distance stay in the running
                        limit = np.partition(true, k - 1)[k - 1]
                        at, true = at[true <= limit], true[true <= limit]
                        order = sorted(range(len(at)), key=lambda t: (true[t], ids[int(at[t])].as_py()))[:k]
                        at, true = at[order], true[order]
                    out["qid"] += [right.column("qid")[i + j].as_py()] * len(at)
                    out["id"] += [ids[int(t)].as_py() for t in at]
                    out["distance"] += np.sqrt(true).tolist()
        return pa.table({"qid": pa.array(out["qid"], right.schema.field("qid").type), "id": pa.array(out["id"], left.schema.field("id").type), "distance": pa.array(out["distance"], pa.float64())})

    return lambda a, b: run(a, b)


def _meet(indexed: DataFrame, asked: DataFrame, k: int, piece: int) -> DataFrame:
    """qid, id, distance: for each (qid, qv, cell) of asked the k nearest of the cell, or of each of its pieces."""
    spark = indexed.sparkSession
    sizes = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row a cell
    plan = [(c, -(-n // piece), -(-wanted[c] // piece)) for c, n in sizes.items() if c in wanted]
    if len(plan) <= 64:  # few enough to reach the scan as a filter
        indexed = indexed.filter(F.col("cell").isin([c for c, _, _ in plan]))
    both = F.broadcast(spark.createDataFrame(plan, "cell int, m int, qm int"))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(both, "cell").withColumn("a", deal("id", "m")).withColumn("b", every("qm")).select("cell", "a", "b", "id", "v")
    right = asked.join(both, "cell").withColumn("b", deal("qid", "qm")).withColumn("a", every("m")).select("cell", "a", "b", "qid", "qv")
    q, i = (df.schema[c].dataType.simpleString() for df, c in ((asked, "qid"), (indexed, "id")))
    return left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInArrow(_nearest(k), f"qid {q}, id {i}, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(indexed: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int, probes: int = 8, exact: bool = False, piece: int = PIECE) -> DataFrame:
    """qid, id, distance and rank of the k nearest indexed vectors of each query (qid, v), ties by id.

    probes cells are looked into, more where exact. Distances are Euclidean; with a quantiser for
    cosines they are of unit vectors, so the cosine is 1 - distance^2 / 2. Queries of another dimension find
    nothing. Queries may be as many as the vectors: they are grouped by cell, like these.
    """
    rows = usable(queries.select(F.col("qid").alias("id"), "v"), quantiser.dim, quantiser.cosine)
    kind = rows.schema["id"].dataType.simpleString()
    radii = np.full(len(quantiser.centres), -1.0)
    if exact:
        for r in indexed.groupBy("cell").agg(F.max("r").alias("r")).collect():
            radii[r["cell"]] = r["r"]

    def cells(further: bool):
        def run(batches):
            for b in _slices(batches, len(quantiser.centres)):
                x = _rows(b.column(1), quantiser.dim)
                d = quantiser.distances(x)
                order = np.argsort(d, axis=1, kind="stable")
                picked = [o[:probes] for o in order]
                if further:
                    kth = np.array([np.inf if y is None else y for y in b.column(2).to_pylist()])
                    low = np.maximum(d - radii[None, :], 0) * (1 - 1e-9)
                    picked = [o[probes:][(low[i, o[probes:]] <= kth[i]) & (radii[o[probes:]] >= 0)] for i, o in enumerate(order)]
                at = np.repeat(np.arange(len(x)), [len(p) for p in picked])
                flat = np.concatenate(picked) if len(picked) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(flat, pa.int32())], ["qid", "qv", "cell"])

        return run

    schema = f"qid {kind}, qv array<double>, cell int"
    found = _best(_meet(indexed, rows.mapInArrow(cells(False), schema), k, piece), k)
    if exact:
        kth = found.filter(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("distance").alias("kth"))
        rest = rows.join(kth, "id", "left").select("id", "v", "kth").mapInArrow(cells(True), schema)
        found = _best(found.drop("rank").unionByName(_meet(indexed, rest, k, piece)), k)
    return found


def probes_for(indexed: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int, target: float = 0.95, sample: int = 64) -> int:
    """How many cells a search must look into to find `target` of the k nearest: measured on at most `sample` queries (qid, v), those of the least hashes of their ids, against all vectors."""
    asked = usable(queries.select(F.col("qid").alias("id"), "v"), quantiser.dim, quantiser.cosine).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = asked.collect()
    some = queries.sparkSession.createDataFrame([tuple(r) for r in rows], asked.schema).withColumnRenamed("id", "qid")
    truth = search(indexed, some, quantiser, k, exact=True).join(indexed.select("id", "cell").distinct(), "id").select("qid", "cell").collect()  # k rows a query
    if not truth:
        return 1
    order = {r["id"]: np.argsort(quantiser.distances(np.array([r["v"]]))[0], kind="stable").tolist() for r in rows}
    needed = sorted(order[r["qid"]].index(r["cell"]) + 1 for r in truth)
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]


def quantiser_of(cells: DataFrame) -> Quantiser | None:
    """The quantiser kept as rows (cell, centre) of one model, CELLS at most; None if there are none."""
    rows = sorted((r["cell"], r["centre"]) for r in cells.select("cell", "centre").collect())
    return Quantiser(np.array([c for _, c in rows])) if rows else None


def kept_index(held: DataFrame, new: DataFrame, cells: DataFrame, model: str, dim: int, index_from: int) -> tuple[DataFrame, DataFrame | None]:
    """What to put so that a store's vectors (chunk_id, v, model, dim) have their cells: vector rows, and cell rows where the quantiser is fitted anew.

    That is done from `index_from` vectors on, and again whenever their number has doubled, so each
    vector is written a bounded number of times; else only the new vectors get their cells.
    """
    mine = cells.filter(F.col("model") == model)
    last = mine.agg(F.max("fitted_on")).first()[0]
    count = held.count() + new.count()
    placed = lambda rows, q: rows.drop("cell", "r").join(index(rows.select(F.col("chunk_id").alias("id"), "v"), q).select(F.col("id").alias("chunk_id"), "cell", "r"), "chunk_id", "left")
    if count >= index_from and (last is None or count >= 2 * last):
        every = held.drop("cell", "r").unionByName(new.select(*[c for c in held.columns if c not in ("cell", "r")]))
        q = fit(every.select(F.col("chunk_id").alias("id"), "v"), dim)
        rows = [(model, i, c.tolist(), count) for i, c in enumerate(q.centres)]
        return placed(every, q), held.sparkSession.createDataFrame(rows, "model string, cell int, centre array<double>, fitted_on long")
    q = quantiser_of(mine)
    return (new if q is None else placed(new, q)), None


def nearest_kept(vectors: DataFrame, cells: DataFrame, query: list[float], k: int) -> DataFrame | None:
    """id and 1 / (1 + distance) of the k nearest of a store's vectors, exact, through its cells; None if they have none yet."""
    q = quantiser_of(cells)
    if q is None or q.dim != len(query):
        return None
    indexed = vectors.filter("cell IS NOT NULL").select(F.col("chunk_id").alias("id"), "v", "cell", "r")
    asked = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "qid int, v array<double>")
    return search(indexed, asked, q, k, probes=8, exact=True).select("id", (1 / (1 + F.col("distance"))).alias("score")).orderBy(F.col("score").desc(), "id")
