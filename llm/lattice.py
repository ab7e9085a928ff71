"""Embedding near-dedup by E8 lattice hashing.

In each of TABLES tables a random orthonormal projection brings the unit vector to eight numbers, scaled by SCALE
and decoded to the nearest point of E8 (the nearer of D8 and D8 + 1/2). The point is the home cell; the PROBES
neighbouring cells are the lattice points along the minimal vectors that the residual leans to most. A pair is a
candidate if one's home is the other's home or among its neighbours, and a link if its cosine in double precision
reaches COSINE. Components of the links are the classes.

Vectors that are equal, label included, are one while links are sought: thousands of copies cost one search, and their
links are counted, not listed. (Where an id has several vectors, nothing is folded.)

Only rows with equal labels meet; labels are whole numbers, other text is no label. Null labels, null ids, null, empty
or zero vectors, vectors with null or non-finite components and such whose length in double precision is 0 or infinite
link with nothing. Vectors of different length never meet. Rows that repeat an id are one
vector for the links and are all returned. Every home and neighbour row is 24 bytes; vectors travel only for
candidate pairs. A cell that holds a third of all rows is split by the adaptive join, both sides by a salt.
Empty tables give no rows. Other columns are ignored; names needn't differ from those used here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, signed, stored
from .components import components

TABLES, PROBES, SCALE, COSINE = 8, 8, 2.6, 0.98


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points to the rows of x, in doubled (integer) coordinates."""
    out, gap = None, None
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.rint(y)
        d = y - r
        odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
        if len(odd):
            k = np.abs(d[odd]).argmax(1)
            r[odd, k] += np.where(d[odd, k] >= 0, 1, -1)
        g = ((y - r) ** 2).sum(1)
        r = (2 * (r + shift)).astype(np.int64)
        if out is None:
            out, gap = r, g
        else:
            nearer = g < gap
            out[nearer] = r[nearer]
    return out


def minimal_vectors() -> np.ndarray:
    """The 240 minimal vectors of E8, doubled: two entries of +-2, or eight of +-1 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        if m.bit_count() % 2 == 0:
            out.append([-1 if m >> i & 1 else 1 for i in range(8)])
    return np.array(out)


def _key(cell: np.ndarray, label: np.ndarray, table: int, dim: int) -> np.ndarray:
    h = mix64(label.view(np.uint64) ^ np.uint64(table * 1_000_003 + dim))
    for i in range(8):
        h = mix64(h ^ (cell[:, i].astype(np.int64).view(np.uint64) + np.uint64(i * 7919)))
    return h


def _matrix(col: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = col.filter(pa.array(rows)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _cells(vectors: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    minimal = minimal_vectors()

    def run(batches):
        planes = {}
        for b in batches:
            col = b.column("v")
            size = np.diff(np.asarray(col.offsets))
            ids, labels = np.asarray(b.column("id")), np.asarray(b.column("label"))
            for dim in np.unique(size):
                dim = int(dim)
                x = _matrix(col, size == dim, dim)
                x = x / np.linalg.norm(x, axis=1)[:, None]
                i, lab = ids[size == dim], labels[size == dim].astype(np.int64)
                for t in range(tables):
                    if (dim, t) not in planes:
                        g = np.random.default_rng([seed, dim, t]).standard_normal((dim, 8))
                        planes[dim, t] = (np.linalg.qr(g)[0] if dim >= 8 else np.linalg.qr(g.T)[0].T) * np.sqrt(max(dim, 8)) * scale / 2
                    p = x @ planes[dim, t]
                    home = decode_e8(p)
                    lean = (p - home / 2) @ minimal.T
                    near = np.argpartition(-lean, probes, axis=1)[:, :probes] if probes else np.zeros((len(p), 0), int)
                    out = [(_key(home, lab, t, dim), i, False)]
                    out += [(_key(home + minimal[near[:, k]], lab, t, dim), i, True) for k in range(probes)]
                    for key, who, probe in out:
                        yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(who), pa.array(np.full(len(who), probe))], names=["key", "id", "probe"])

    return vectors.mapInArrow(run, "key bigint, id bigint, probe boolean")


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, v, label of the rows that can link."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    d = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.col(label_col).try_cast("bigint").alias("label"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return d.where("id is not null and v is not null and label is not null").where(ok).where((square > 0) & (square < float("inf")))


def links(vectors: DataFrame, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, cosine: float = COSINE, seed: int = 11) -> DataFrame:
    """Links (a, b, cosine), a < b, of rows (id, v, label)."""
    cells = stored(_cells(vectors, tables, probes, scale, seed), "cells")
    # cells that one row alone touches are dropped before the join
    home = cells.where("not probe").select("key", F.col("id").alias("h"))
    pair = home.join(cells.select("key", F.col("id").alias("q")), "key").where("h <> q")
    pair = pair.select(F.least("h", "q").alias("a"), F.greatest("h", "q").alias("b")).distinct()
    x = vectors.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("label").alias("la"))
    y = vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("label").alias("lb"))
    rows = pair.join(x, "a").join(y, "b").where("la = lb and size(va) = size(vb)").select("a", "b", "va", "vb")

    def verify(batches):
        for b in batches:
            size = np.diff(np.asarray(b.column("va").offsets))
            c = np.zeros(b.num_rows)
            for dim in np.unique(size):
                r = size == dim
                p, q = (_matrix(b.column(n), r, int(dim)) for n in ("va", "vb"))
                c[r] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
            k = pa.array(c >= cosine)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(k), b.column("b").filter(k), pa.array(c).filter(k)], names=["a", "b", "cosine"])

    return rows.mapInArrow(verify, "a bigint, b bigint, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _folded(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives (id, v, label) with n, the number of ids that have the vector; (id, rep) of all ids)."""
    h = d.select("id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), "v").alias("h2"), F.size("v").alias("n"))
    same = ["label", "h1", "h2", "n"]
    ids = h.select("id", *same).distinct()
    rep = stored(ids.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("count")), "vectors")
    # a vector that many rows share meets its representative by a join on the hash, whose other side is one row
    at = stored(ids.join(rep, same).select("id", "rep"), "folded")
    vectors = d.join(rep.select(F.col("rep").alias("id"), F.col("count").alias("n")), "id").dropDuplicates(["id"])
    return vectors, at


def classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """Per row of vectors: id, n_links, component_id, kept."""
    d = usable(vectors, id_col, vec_col, label_col)
    one, at = _folded(d)
    if at.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        one = stored(one, "representatives")
    else:
        one, at = stored(d.withColumn("n", F.lit(1).cast("bigint")), "representatives"), d.select("id", F.col("id").alias("rep")).distinct()
    e = stored(links(one, **options), "links")
    size = one.select("id", "n").distinct()
    both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(e.select("b", "a"))
    n = both.join(size.withColumnRenamed("id", "other"), "other").groupBy("node").agg(F.sum("n").alias("far"))
    c = components(e)
    rep = size.withColumnRenamed("id", "node").join(n, "node", "left").join(c, "node", "left")
    rep = rep.select(F.col("node").alias("rep"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    told = at.join(rep, "rep").select(F.col("id").alias("node"), "n_links", "component")
    r = vectors.select(F.col(id_col).cast("bigint").alias("node")).join(told, "node", "left")
    comp = F.coalesce("component", "node")
    return r.select(F.col("node").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("node"), F.lit(True)).alias("kept"))


def dedup(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """vectors without the rows that another row of their class stands for."""
    gone = classes(vectors, id_col, **options).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return vectors.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def op2_e8_lattice(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
