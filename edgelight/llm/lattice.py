"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbouring cells probed."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import connected_components, staged
from .hashing import U64, mix64

#: Tables, E8 blocks in each, cells that a vector looks into per table, edge of the lattice for 64 dimensions. For cosine 0.9 a pair meets in a
#: table with probability 0.33 (measured for 64 dimensions), so it is missed by all 14 with probability 0.004.
TABLES, BLOCKS, PROBES, SCALE = 14, 2, 8, 0.24


def edge(dimensions: int, scale: float = SCALE) -> float:
    """The edge of the lattice for vectors of so many dimensions.

    A projection of a unit vector shrinks with the square root of the dimensions, and so does the edge, so that pairs meet as often whatever their
    length. Below 8 * BLOCKS dimensions the lattice has no more directions than the vectors, and the edge stays.
    """
    return scale * (64 / max(dimensions, 8 * BLOCKS)) ** 0.5

#: The 240 shortest vectors of E8: two entries of +-1, or all entries +-1/2 with an even number of minus signs.
NEIGHBOURS = np.array(
    [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2] + [tuple(x / 2 for x in v) for v in itertools.product((-1, 1), repeat=8) if v.count(-1) % 2 == 0],
    float,
)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: rounding, and where the sum is odd the worst entry rounded the other way."""
    r = np.rint(x)
    left = x - r
    worst, odd = np.abs(left).argmax(axis=1), np.flatnonzero(r.sum(axis=1) % 2 != 0)
    r[odd, worst[odd]] += np.where(left[odd, worst[odd]] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half: the nearer of the two decodings."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def projections(dimensions: int, tables: int, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions, 8 * BLOCKS per table (zero where the space has too few), and shifts of the lattice."""
    rng, wide = np.random.default_rng(seed), 8 * BLOCKS
    out = np.zeros((tables, dimensions, wide))
    free: list[np.ndarray] = []
    for t in range(tables):
        if len(free) < min(wide, dimensions):
            free = list(np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0].T)
        for j in range(min(wide, dimensions)):
            out[t, :, j] = free.pop()
    return out, rng.uniform(size=(tables, wide))


def cells(unit: np.ndarray, direction: np.ndarray, shift: np.ndarray, scale: float, probes: int, table: int) -> np.ndarray:
    """Keys of the own cell (first) and of the probes - 1 nearest ones that one step in one block leads to."""
    x = unit @ direction / scale + shift
    own, steps, gains = [], [], []
    for b in range(BLOCKS):
        part = x[:, 8 * b : 8 * b + 8]
        point = nearest_e8(part)
        gain = (part - point) @ NEIGHBOURS.T
        best = np.argsort(-gain, axis=1, kind="stable")[:, : probes - 1]
        own.append(point)
        steps.append(best)
        gains.append(np.take_along_axis(gain, best, axis=1))
    order = np.argsort(-np.concatenate(gains, axis=1), axis=1, kind="stable")[:, : probes - 1]
    keys = [cell_key(own, table)]
    rows = np.arange(len(unit))
    for j in range(probes - 1):
        block, step = order[:, j] // (probes - 1), order[:, j] % (probes - 1)
        moved = [own[b] + np.where((block == b)[:, None], NEIGHBOURS[steps[b][rows, step]], 0.0) for b in range(BLOCKS)]
        keys.append(cell_key(moved, table))
    return np.column_stack(keys)


def cell_key(points: list[np.ndarray], table: int) -> np.ndarray:
    coordinates = np.rint(np.concatenate(points, axis=1) * 2).astype(np.int64).view(U64)
    key = np.full(len(coordinates), table + 1, U64)
    with np.errstate(over="ignore"):
        for column in coordinates.T:
            key = mix64(key * U64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def hashed(vectors: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """(id, cells array<array<long>>): per table the own cell and the probed ones; vectors are finite and not zero."""
    made: dict[int, tuple] = {}

    @F.pandas_udf("array<array<long>>")
    def keys(column: pd.Series) -> pd.Series:
        out: list = [None] * len(column)
        sizes = column.map(len).to_numpy() if len(column) else np.zeros(0, int)
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            direction, shift = made.get(d) or made.setdefault(d, projections(int(d), tables))
            for i in range(0, len(rows), 2000):
                r = rows[i : i + 2000]
                x = np.stack(column.iloc[r].to_list()).astype(float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = [cells(x, direction[t], shift[t], edge(int(d), scale), probes, t + int(d) * tables) for t in range(tables)]
                for j, row in enumerate(r):
                    out[row] = [f[j] for f in found]
        return pd.Series(out)

    return vectors.select("id", keys("vector").alias("cells"))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding", tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows, representatives, links): links (a, b) with a < b between representatives of cosine >= threshold.

    Equal vectors are one representative, with a number of its own as id (rows that share an id may differ) and their smallest id as
    least. Each vector is entered into its own cell in each table and looks
    into the nearest cells around it; pairs that meet are told apart once, and the cosine of whole vectors in double
    precision decides. A cell of many members is split by AQE, its links are the result itself and come in pairs.
    """
    vector = F.col(vector_column).cast("array<double>")
    sound = F.size(vector) > 0
    sound &= F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.when(sound, vector).alias("vector"))
    real = rows.where("vector is not null and id is not null")
    reps = real.groupBy("vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = staged(reps.withColumn("id", F.monotonically_increasing_id()))
    keyed = staged(hashed(reps, tables, probes, scale))
    per_table = keyed.select("id", F.explode("cells").alias("cells"))
    entered = per_table.select(F.col("id").alias("a"), F.get("cells", F.lit(0)).alias("cell"))
    looking = per_table.select(F.col("id").alias("b"), F.explode("cells").alias("looks"))
    met = entered.join(looking, (F.col("cell") == F.col("looks")) & (F.col("a") != F.col("b")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    @F.pandas_udf(BooleanType())
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            if len(x) != len(y):
                out.append(False)
                continue
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            out.append(bool(x @ y >= threshold * np.sqrt((x @ x) * (y @ y))))
        return pd.Series(out, dtype=bool)

    left = reps.select(F.col("id").alias("a"), F.col("vector").alias("va"))
    right = reps.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    links = staged(pairs.join(left, "a").join(right, "b").where(close("va", "vb")).select("a", "b"))
    return rows, reps, links


def vector_components(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding", **index) -> DataFrame:
    """(id, n_links, component): how many other vectors each links to directly, and the smallest id that links lead to.

    Vectors that are null, empty or zero, or hold a null or a number that is not finite, link with nothing, nor do vectors
    of different lengths; a null id is alone. Copies of a vector link with each other and with all that it links to, repeated rows
    among them; rows that share an id are told apart by their vectors. An empty table gives an empty result. Other columns are left out.
    """
    rows, reps, links = near_vectors(vectors, threshold, id_column, vector_column, **index)
    copies = reps.select(F.col("id").alias("of"), "copies")
    both = links.union(links.select("b", "a"))
    linked = both.join(copies, F.col("b") == F.col("of")).groupBy("a").agg(F.sum("copies").alias("n"))
    found = connected_components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)
    known = reps.join(linked, F.col("id") == F.col("a"), "left").join(found, F.col("id") == F.col("node"), "left")
    known = known.select("vector", "least", "copies", "n", F.coalesce("component", "id").alias("component"))
    smallest = known.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("smallest"))
    known = known.join(smallest, F.col("component") == F.col("of"))
    known = known.select(F.col("vector").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "smallest")
    out = rows.join(known, (F.col("vector") == F.col("v")) & F.col("id").isNotNull(), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "id").alias("component"))


def op7_lattice_near_dup(spark, sf_dir):
    out = vector_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
