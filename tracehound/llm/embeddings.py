"""Embedding near-dedup: spherical k-means cells, cosine products of pairs of blocks near a border, one representative of each group."""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tracehound.llm.common import partitions, sampled, shared_folder, table, written
from tracehound.llm.components import components
from tracehound.llm.skew import rows_at_once

COSINE = 0.9
#: Vectors that k-means sees, taken by the hash of their id; all vectors are then dealt to the cells.
SAMPLE = 20_000
#: Cells at most: their centres go out to all tasks.
MAX_CELLS = 16_384
#: Vectors, and bytes of them, that a block of a cell has at most; blocks are compared two by two.
BLOCK = 8_192
BLOCK_BYTES = 4_000_000
#: Rows of a block multiplied at once, and tasks that the pairs of blocks are dealt to at most.
ROWS = 256
TASKS = 20_000


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centres of unit vectors; a cell that runs empty is seeded anew."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        lost = size < 1e-9
        c = np.where(lost[:, None], x[rng.integers(0, len(x), k)], sums / np.where(lost, 1, size)[:, None])
    return c


def units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # so that very small and very large vectors keep their length
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def homes(vectors, centres: np.ndarray) -> np.ndarray:
    """The cell of each vector, that of the nearest centre."""
    return np.concatenate([(units(vectors[a : a + 2048]) @ centres.T).argmax(1) for a in range(0, len(vectors), 2048)])


def homed(centres: np.ndarray, kind: type):
    """Each vector as bytes, with its cell."""

    def run(frames):
        for frame in frames:
            if len(frame):
                home = homes(frame["v"].tolist(), centres).astype(np.int32)
                yield pd.DataFrame({"cell": home, "id": frame["id"], "n": frame["n"], "x": [np.asarray(v, kind).tobytes() for v in frame["v"]]})

    return run


def borders(centres: np.ndarray, cell: int) -> np.ndarray:
    """Unit vectors from all centres to that of the cell; zero where there is no way to go."""
    way = centres[cell] - centres
    length = np.linalg.norm(way, axis=1, keepdims=True)
    return np.where(length > 1e-9, way / np.maximum(length, 1e-9), 0)


def packed(centres: np.ndarray, kind: type):
    """A block of a cell as one row, with its least distance to the border with each cell."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, block = key
        x = units([np.frombuffer(v, kind) for v in pdf["x"]])
        way, near = borders(centres, cell).T, np.full(len(centres), np.inf)
        for a in range(0, len(x), 1024):
            near = np.minimum(near, (x[a : a + 1024] @ way).min(0))
        ids, n = pdf["id"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        return pd.DataFrame({"cell": [cell], "block": [block], "ids": [ids.tobytes()], "n": [n.tobytes()], "x": [b"".join(pdf["x"])], "near": [near]})

    return run


def hooked(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of i and j, pair by pair; a label is the smallest index of its group."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def compared(centres: np.ndarray, cosine: float, kind: type):
    """Links inside a block or between two: (id, links, root) for every vector with any.

    If x is of cell i and y of cell j, and u is the unit vector between the centres, then |x - y| >= x.u - y.u, the sum
    of their distances to the border. Linked unit vectors are at most sqrt(2 - 2 cos) apart, so with both sides in order
    of that distance each x meets a first stretch of the other side, and no link is lost. Products are of single
    precision; those within its error of the threshold are done again in double.
    """
    apart = sqrt(max(2 - 2 * cosine, 0)) + 1e-9

    def side(ids: bytes, n: bytes, x: bytes) -> tuple:
        ids = np.frombuffer(ids, np.int64)
        x = units(np.frombuffer(x, kind).reshape(len(ids), -1))
        return ids, np.frombuffer(n, np.int64), x, x.astype(np.float32)

    def links(a: tuple, b: tuple, i_cell: int, j_cell: int) -> pd.DataFrame:
        (ids_a, n_a, x, fx), (ids_b, n_b, y, fy) = a, b
        same, slack = a is b, (x.shape[1] + 8) * 2.0**-23
        rows, cols, far, limit = np.arange(len(x)), np.arange(len(y)), None, len(y)
        if i_cell != j_cell:
            u = borders(centres, i_cell)[j_cell]
            far, other = x @ u, -(y @ u)
            rows, cols = np.argsort(far), np.argsort(other)
            far, other, fx, fy = far[rows], other[cols], fx[rows], fy[cols]
        found = np.zeros(len(x) + len(y), np.int64)
        labels, shift = np.arange(len(found)), 0 if same else len(x)
        for k in range(0, len(x), ROWS):
            if far is not None:
                limit = int(np.searchsorted(other, apart - far[k], "right"))
                if not limit:
                    break
            start = k if same else 0
            p = fx[k : k + ROWS] @ fy[start:limit].T
            at = np.flatnonzero(p >= cosine - slack)
            i, j = np.divmod(at, p.shape[1])
            p, i, j = p.ravel()[at], rows[i + k], cols[j + start]
            good = p >= cosine + slack
            if same:
                later = i < j
                i, j, good = i[later], j[later], good[later]
            near = np.flatnonzero(~good)
            good[near] = np.einsum("ij,ij->i", x[i[near]], y[j[near]]) >= cosine
            i, j = i[good], j[good]
            found += np.bincount(i, weights=n_b[j], minlength=len(found)).astype(np.int64) + np.bincount(j + shift, weights=n_a[i], minlength=len(found)).astype(np.int64)
            labels = hooked(labels, i, j + shift)
        some, ids = np.flatnonzero(found), np.concatenate([ids_a, ids_b])
        return pd.DataFrame({"id": ids[some], "links": found[some], "root": ids[labels[some]]})

    def run(frames):
        left, key = None, None  # the first block stays while others meet it
        for frame in frames:
            for r in frame.itertuples(index=False):
                if key != (r.a_cell, r.a_block):
                    left, key = side(r.a_ids, r.a_n, r.a_x), (r.a_cell, r.a_block)
                right = left if key == (r.b_cell, r.b_block) else side(r.b_ids, r.b_n, r.b_x)
                yield links(left, right, r.a_cell, r.b_cell)

    return run


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links with cosine >= `cosine` in double precision, components by smallest id.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and are kept. Vectors
    of different lengths do not link. Equal vectors are one class, so a hot vector is compared once; its copies link
    with each other. Rows that share an id and a vector count as copies. Other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    v = F.col("v")
    valid = v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    single = vectors.select(F.col(vector_col)).schema[0].dataType == ArrayType(FloatType())  # stays so, for it is half as long
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")).withColumn("ok", F.coalesce(valid, F.lit(False)))
    classes = rows.where("ok").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # Rows find their class by 128 bits of the vector, which need not be shuffled again for it.
    digest = {"length": F.size("v"), "d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit(7), "v")}
    classes = written(classes.withColumns(digest), folder, "classes")
    found, kind = None, np.float32 if single else np.float64
    for length, count in sorted((r[0], r[1]) for r in classes.groupBy("length").count().collect()):  # a row per vector length
        of_length = classes.where(F.col("length") == length).select("id", "n", "v")
        chosen = sampled(of_length, "id", sample).select("v").toPandas()["v"]
        centres = spherical_kmeans(units(chosen), max(1, min(MAX_CELLS, len(chosen), ceil(sqrt(count) / 8))))
        most = max(16, min(BLOCK, BLOCK_BYTES // (length * np.dtype(kind).itemsize)))
        cells = of_length.mapInPandas(homed(centres, kind), "cell int, id long, n long, x binary")  # done twice, not kept
        blocks = cells.groupBy("cell").count().select(F.col("cell").alias("c"), F.ceil(F.col("count") / most).cast("int").alias("blocks"))
        blocks = written(blocks, folder, f"sizes{length}")
        cells = cells.join(F.broadcast(blocks), F.col("cell") == F.col("c")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))  # at most MAX_CELLS rows
        cells = cells.select("cell", "block", "id", "n", "x").repartition(partitions(spark), "cell", "block")
        cells = cells.groupBy("cell", "block").applyInPandas(packed(centres, kind), "cell int, block int, ids binary, n binary, x binary, near array<float>")
        cells = written(cells, folder, f"cells{length}")
        # Pairs of blocks are made by reading one side again for the other, so none is shuffled or written.
        a, b = (cells.select(*[F.col(c).alias(f"{side}_{c}") for c in cells.columns]) for side in "ab")
        reach = sqrt(max(2 - 2 * cosine, 0)) + 1e-5  # the distances of a block are of single precision
        near = F.get("a_near", F.col("b_cell")) + F.get("b_near", F.col("a_cell")) <= reach
        meets = (F.col("a_cell") < F.col("b_cell")) & near | (F.col("a_cell") == F.col("b_cell")) & (F.col("a_block") <= F.col("b_block"))
        pairs = a.coalesce(max(1, TASKS // partitions(spark))).hint("shuffle_replicate_nl").join(b, meets).drop("a_near", "b_near")
        part = pairs.mapInPandas(compared(centres, cosine, kind), "id long, links long, root long")
        with rows_at_once(spark, 4):
            part = written(part, folder, f"found{length}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.drop("v").join(links, "id", "left").join(labels, F.col("id") == F.col("node"), "left")
    named = named.select(*[F.col(c).alias(f"_{c}") for c in digest], (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    rows = rows.withColumns(digest).drop("v")
    out = rows.join(named, F.col("ok") & (F.col("length") == F.col("_length")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: All pairs, for small tables.
SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
r AS (SELECT vec_id, vec_id AS root FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
m AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id
"""
