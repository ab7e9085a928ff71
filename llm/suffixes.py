"""Suffix-array dedup of long repeated byte strings by distributed prefix doubling.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same text or another.

1. Positions that are plainly unique, or plainly repeated, are settled without ranks. Each position looks at the
   GRAM-byte grams of the WINDOW bytes that it starts and takes the one of least hash as its anchor, so equal
   strings have equal anchors at equal offsets. The positions of an anchor are a run. All of them share its core,
   the bytes that every string of that anchor holds: where the core occurs once, none of them repeats. A run whose
   whole stretch (all its strings) occurs twice repeats at every position. A run whose core repeats and whose
   stretch doesn't is open: it goes on with one run of each repeated stretch of its core. Open runs are cut at
   fixed offsets into runs of STEP positions and judged once more in the same way.
2. The positions of the runs that are still open go into prefix doubling: positions are ranked by their first
   FIRST bytes, then by pairs (rank, rank at +length), the length doubling until LENGTH; after every round ranks
   held by one position only are dropped, for their strings are unique. A rank is the least position of its
   group; Spark's shuffle sorts the pairs.
3. A text's spans are the union of [p, p + LENGTH) over its repeated positions.

Work is done on keys and positions; groups are met by counts and minima, combined before the shuffle, never
listed. Null text: empty. Texts below LENGTH bytes lose nothing. Equal rows, ids included, are separate texts and
repeat each other. Inside, a text is known by 128 bits of its hash and rows of one text are decided together, so ids
may be null or repeat. Empty tables give no rows. Cores, stretches and first names are xxh3 hashes of the bytes
themselves, 64 bits each, and two must agree (core and stretch, or both halves of a name or rank); the polynomial
hash only picks anchors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, byte_slices, mix64, prefix_hash, signed, span_hash, stored, text_of, trim

LENGTH, FIRST, WINDOW, GRAM, STEP = 200, 100, 128, 16, 8
_SEGMENT = 1 << 22


def _names(raw: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the bytes of each pair."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(raw[s:e], seed) for s, e in zip(start.tolist(), end.tolist())], np.uint64)


def _wide_names(raw: bytes, start: np.ndarray, size: int) -> np.ndarray:
    """(n, 2): 128-bit hashes of `size` bytes from each start."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[s : s + size]) for s in start.tolist()]), "<u8").reshape(-1, 2)


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM):
    """text, anchor, first and last position, core key and stretch key of every run of positions with one anchor."""
    n = len(data)
    size = np.diff(offs)
    per = np.maximum(size - length + 1, 0)
    p = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(offs[:-1], per)
    if not len(p):
        return None
    h = prefix_hash(data)
    i = np.arange(n - gram + 1)
    v = (span_hash(h, i, i + gram) & ~np.uint64(_SEGMENT * 2 - 1)) | i.astype(np.uint64)
    wide = window - gram + 1
    reach = 1
    while reach * 2 <= wide:
        v[: len(v) - reach] = np.minimum(v[: len(v) - reach], v[reach:])
        reach *= 2
    if reach < wide:
        k = wide - reach
        v[: len(v) - k] = np.minimum(v[: len(v) - k], v[k:])
    a = (v[p] & np.uint64(_SEGMENT * 2 - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    x, p1, p2 = a[new], p[new], np.concatenate([p[new[1:] - 1], p[-1:]])
    raw = data.tobytes()
    core = _names(raw, x, x + length - (wide - 1), 1)
    stretch = mix64(_names(raw, p1, p2 + length, 2) ^ ((x - p1) << 16 | (x - p2)).astype(np.uint64))
    return np.searchsorted(offs, x, "right") - 1, x, p1, p2, core, stretch


def _slices(texts, length: int):
    """Slices of at most _SEGMENT bytes; of a longer text come overlapping parts, with where the part begins."""
    for i, j, data, offs in byte_slices(texts):
        if len(data) <= _SEGMENT:
            yield i, data, offs, 0
            continue
        for at in range(0, len(data), _SEGMENT - length + 1):
            part = data[at : at + _SEGMENT]
            yield i, part, np.array([0, len(part)]), at
            if at + _SEGMENT >= len(data):
                break


_ROW = "t1 bigint, t2 bigint, p1 bigint, n int, o int, core bigint, stretch bigint"


def _anchor_rows(docs: DataFrame, length: int, window: int) -> DataFrame:
    def run(batches):
        for b in batches:
            trim()
            t1, t2 = np.asarray(b.column("t1")), np.asarray(b.column("t2"))
            for i, data, offs, at in _slices(b.column("text"), length):
                got = anchors(data, offs, length, window)
                if got is None:
                    continue
                t, x, p1, p2, core, stretch = got
                cols = [pa.array(t1[i + t]), pa.array(t2[i + t]), pa.array(p1 - offs[t] + at), pa.array((p2 - p1 + 1).astype(np.int32)), pa.array((x - p1).astype(np.int32)), pa.array(signed(core)), pa.array(signed(stretch))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _ROW.split(", ")])

    return docs.select("t1", "t2", "text").mapInArrow(run, _ROW)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, t1 and t2 (128 bits that name the text), text."""
    d = docs.select("doc_id", text_of(docs).alias("text"))
    return d.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(41), "text").alias("t2"), "text")


def _positions(texts: DataFrame, length: int, first: int) -> DataFrame:
    """Of rows (t1, t2, text, runs): every position of the runs and those at + first, + 2 first ..., with the hash of its first bytes."""
    schema = "t1 bigint, t2 bigint, p bigint, own boolean, name bigint, name2 bigint"

    def run(batches):
        for b in batches:
            trim()
            for r in range(b.num_rows):
                raw = b.column("text")[r].as_py().encode()
                runs = b.column("runs")[r].values
                p1, n = (np.asarray(runs.field(k)).astype(np.int64) for k in ("p1", "n"))
                own = np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(p1, n))
                steps = sorted({min(k, length - first) for k in range(0, length, first)})
                every = np.unique(np.concatenate([own + k for k in steps]))
                name = _wide_names(raw, every, first).astype(np.uint64)
                t1, t2 = (np.full(len(every), b.column(c)[r].as_py(), np.int64) for c in ("t1", "t2"))
                cols = [pa.array(t1), pa.array(t2), pa.array(every), pa.array(np.isin(every, own, assume_unique=True)), *(pa.array(signed(np.ascontiguousarray(name[:, k]))) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return texts.mapInArrow(run, schema)


def _rerank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of rows by keys: the least position of the group, as two numbers; groups of one position go."""
    rows = rows.select("t1", "t2", "p", "own", *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    keys = [f"k{i}" for i in range(len(keys))]
    place = F.struct("t1", "t2", "p")
    g = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(place).alias("_m")).where("_n > 1")
    g = stored(g.select(*keys, F.xxhash64("_m").alias("r"), F.xxhash64(F.lit(3), "_m").alias("r2")), "ranks")
    return stored(rows.join(g, keys).select("t1", "t2", "p", "own", "r", "r2"), "ranked")


def doubling(positions: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """Positions (t1, t2, p), own ones only, whose strings of `length` bytes occur at two positions or more."""
    ranked, now = _rerank(positions, ["name", "name2"]), first
    while now < length:
        step = min(now, length - now)
        ahead = ranked.select("t1", "t2", (F.col("p") - step).alias("p"), F.col("r").alias("s"), F.col("r2").alias("s2"))
        c = ranked.join(ahead, ["t1", "t2", "p"])
        now += step
        if now >= length:
            c = c.where("own")
        ranked = _rerank(c, ["r", "r2", "s", "s2"])
    return ranked.where("own").select("t1", "t2", "p")


def _cut_runs(texts: DataFrame, length: int, step: int) -> DataFrame:
    """Of rows (t1, t2, text, runs): the runs cut where the offset from the anchor is a multiple of step, with their keys."""

    def run(batches):
        for b in batches:
            trim()
            for r in range(b.num_rows):
                raw = b.column("text")[r].as_py().encode()
                runs = b.column("runs")[r].values
                first, n, o = (np.asarray(runs.field(k)).astype(np.int64) for k in ("p1", "n", "o"))
                p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                x = np.repeat(first + o, n)
                j = (x - p) // step
                new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (j[1:] != j[:-1]) | (p[1:] != p[:-1] + 1)]))
                p1, p2, x, j = p[new], np.concatenate([p[new[1:] - 1], p[-1:]]), x[new], j[new]
                core = mix64(_names(raw, x - j * step, x - j * step - step + 1 + length, 3) ^ (j + 1).astype(np.uint64))
                stretch = mix64(_names(raw, p1, p2 + length, 4) ^ ((x - p1) << 16 | (x - p2)).astype(np.uint64))
                t1, t2 = (np.full(len(p1), b.column(c)[r].as_py(), np.int64) for c in ("t1", "t2"))
                cols = [pa.array(t1), pa.array(t2), pa.array(p1), pa.array((p2 - p1 + 1).astype(np.int32)), pa.array((x - p1).astype(np.int32)), pa.array(signed(core)), pa.array(signed(stretch))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _ROW.split(", ")])

    return texts.mapInArrow(run, _ROW)


def _judge(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs whose core repeats, repeated runs, runs that go on) of rows as in _ROW."""
    core = rows.groupBy("core").agg(F.count("*").alias("k"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi")).where("k > 1")
    core = stored(core.select("core", (F.col("lo") == F.col("hi")).alias("whole")), "cores")
    cand = stored(rows.join(core, "core"), "runs")
    done = cand.where("whole").select("t1", "t2", "p1", "n")
    mixed = cand.where("not whole")
    kind = mixed.groupBy("core", "stretch").agg(F.count("*").alias("k"), F.min(F.struct("t1", "t2", "p1", "n", "o")).alias("m"))
    kind = stored(kind, "stretches")
    twice = kind.where("k > 1").select("core", "stretch")
    done = done.unionByName(mixed.join(twice, ["core", "stretch"]).select("t1", "t2", "p1", "n"))
    # the open runs of a core, and one of each of its repeated stretches
    has_open = stored(kind.groupBy("core").agg(F.min("k").alias("least")).where("least = 1").select("core"), "open")
    return cand, done, kind.join(has_open, "core").select("m.*")


def repeated_runs(docs: DataFrame, length: int = LENGTH, first: int = FIRST, window: int = WINDOW, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(texts that may lose bytes, each once; runs (t1, t2, p1, n) of repeated positions). docs come from _named()."""
    cand, done, left = _judge(_anchor_rows(docs, length, window))
    some = docs.select("t1", "t2", "text").join(cand.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi")
    some = stored(some.dropDuplicates(["t1", "t2"]), "texts")

    def with_runs(runs: DataFrame) -> DataFrame:
        return some.join(_listed(runs, "p1", "n", "o"), ["t1", "t2"])

    _, more, left = _judge(stored(_cut_runs(with_runs(left), length, step), "cut"))
    pos = stored(_positions(with_runs(left), length, first), "positions")
    rep = doubling(pos, length, first)
    return some, done.unionByName(more).unionByName(rep.select("t1", "t2", F.col("p").alias("p1"), F.lit(1).alias("n")))


def _listed(runs: DataFrame, *columns: str) -> DataFrame:
    """A row a text with its runs; what a text's many rows repeat is told once, before lists are made."""
    each = runs.select("t1", "t2", *columns).distinct()
    return each.groupBy("t1", "t2").agg(F.collect_list(F.struct(*columns)).alias("runs"))


def _union(runs: list[dict], length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["p1"], x["p1"] + x["n"] - 1 + length) for x in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def removals(docs: DataFrame, length: int = LENGTH, first: int = FIRST, window: int = WINDOW) -> DataFrame:
    """A row a text that loses bytes (t1, t2): n_removed, spans, kept_sha256, kept (the bytes that stay)."""
    with batches_of(docs.sparkSession, 200):  # rows are whole texts with their runs
        some, runs = repeated_runs(docs, length, first, window)
    d = some.join(_listed(runs, "p1", "n"), ["t1", "t2"])
    schema = "t1 bigint, t2 bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary"
    arrow = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for b in batches:
            trim()
            for r in range(b.num_rows):
                raw = b.column("text")[r].as_py().encode()
                spans = _union(b.column("runs")[r].as_py(), length)
                kept, at = [], 0
                for x, y in spans:
                    kept.append(raw[at:x])
                    at = y
                kept = b"".join([*kept, raw[at:]])
                row = [b.column("t1")[r].as_py(), b.column("t2")[r].as_py(), len(raw) - len(kept), [{"start": x, "end": y} for x, y in spans], hashlib.sha256(kept).hexdigest(), kept]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    return d.mapInArrow(run, schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    d = _named(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    r = removals(d).select("t1", "t2", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.col("kept_sha256").alias("k"))
    slim = d.select("doc_id", "t1", "t2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.encode("text", "utf-8"), 256).alias("whole"))
    j = slim.join(r, ["t1", "t2"], "left")
    zero = F.lit(0).cast("bigint")
    return j.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("k", "whole").alias("kept_sha256"))
