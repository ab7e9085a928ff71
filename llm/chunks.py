"""Substring dedup by content-defined chunking.

A gear rolling hash over 16 bytes cuts each text (UTF-8) where its top bits are zero and a character starts, with
a least and a greatest chunk size; chunks of equal 128-bit digests are one, however far an insertion moved them.
The first of them by (doc_id, text hash, place) stays and all others go, a text's last chunk, which may be below
`least` bytes, included, so exact copies go completely. With the option `run`, only touching repeats of so many bytes
together go, or such as cover a whole text; it is off. Null text: empty, no chunks. A null doc_id comes first. Equal rows
are one document and are decided alike. Empty tables give no rows. Other columns pass through; names beginning with
_r and the name _th are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, keyed, signed, stored, text_of

LEAST, BITS, MOST, RUN = 48, 5, 1024, 1
_GEAR = np.random.default_rng(915).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = (h << 1) + gear[byte] mod 2^32, so that 16 bytes count; by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cut(data: np.ndarray, offs: np.ndarray, least: int = LEAST, bits: int = BITS, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks, and how many chunks stand before each text. `least` is 16 or more, so that a boundary's hash reads bytes of its own text only."""
    h = gear(data)
    may = (h >> np.uint32(32 - bits)) == 0
    may[:-1] &= (data[1:] & 0xC0) != 0x80
    cand = np.flatnonzero(may) + 1
    ends, count = [], [0]
    c = cand.tolist()
    k, n = 0, len(c)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        at = a
        while at < b:
            lo = at + least
            if lo >= b:
                at = b
                ends.append(at)
                break
            while k < n and c[k] < lo:
                k += 1
            hi = min(at + most, b)
            if k < n and c[k] <= hi:
                at = c[k]
            else:
                at = hi
                while at < b and data[at] & 0xC0 == 0x80:  # stay on a character
                    at += 1
            ends.append(at)
        count.append(len(ends))
    return np.array(ends, np.int64), np.array(count)


_SCHEMA = "doc_id bigint, _th bigint, place int, bytes int, total int, d1 bigint, d2 bigint"


def chunk_rows(docs: DataFrame, least: int = LEAST, bits: int = BITS, most: int = MOST) -> DataFrame:
    """A row a chunk: document, place and size in bytes, size of the whole text, digest."""

    def scan(batches):
        import xxhash

        for b in batches:
            ids, th = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("_th")
            null = np.asarray(b.column("doc_id").is_null())
            ids = np.where(null, 0, ids).astype(np.int64)
            th = th.to_numpy()
            for i, j, data, offs in byte_slices(b.column("text")):
                ends, before = cut(data, offs, least, bits, most)
                if not len(ends):
                    continue
                doc = np.repeat(np.arange(j - i), np.diff(before))
                starts = np.concatenate([[0], ends[:-1]])
                starts[before[:-1][np.diff(before) > 0]] = offs[:-1][np.diff(before) > 0]
                raw = data.tobytes()
                dig = np.array([xxhash.xxh3_128_intdigest(raw[s:e]).to_bytes(16, "little") for s, e in zip(starts.tolist(), ends.tolist())], "S16")
                dig = np.frombuffer(dig.tobytes(), np.uint64).reshape(-1, 2)
                cols = [pa.array(ids[i + doc], pa.int64(), mask=null[i + doc]), pa.array(th[i + doc]), pa.array((starts - offs[doc]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(np.diff(offs)[doc].astype(np.int32)), pa.array(signed(np.ascontiguousarray(dig[:, 0]))), pa.array(signed(np.ascontiguousarray(dig[:, 1])))]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select("doc_id", "_th", text_of(docs).alias("text")).mapInArrow(scan, _SCHEMA)


def repeats(docs: DataFrame, **sizes) -> DataFrame:
    """A row a repeated chunk that goes: doc_id, _th, place, bytes, total; docs come from keyed()."""
    rows = chunk_rows(docs, **sizes)
    # combined before the shuffle: a digest that a third of all chunks share is one row a task
    place = F.struct(F.col("doc_id"), F.col("_th"), F.col("place"))
    first = rows.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first.doc_id is distinct from last.doc_id or first._th <> last._th or first.place <> last.place")
    both = rows.join(stored(first.select("d1", "d2", "first"), "digests"), ["d1", "d2"])
    return both.where("doc_id is distinct from first.doc_id or _th <> first._th or place <> first.place").select("doc_id", "_th", "place", "bytes", "total").distinct()


def _runs(spans):
    """Sorted spans with those that touch joined."""
    one = lambda p, n: F.struct(p.alias("place"), n.alias("bytes"))
    zero = F.struct(F.array().cast("array<struct<place:int,bytes:int>>").alias("done"), one(F.lit(-1), F.lit(0)).alias("now"))

    def step(s, x):
        now = s["now"]
        touch = now["place"] + now["bytes"] == x["place"]
        joined = one(now["place"], now["bytes"] + x["bytes"])
        return F.struct(F.when(touch, s["done"]).otherwise(F.array_append(s["done"], now)).alias("done"), F.when(touch, joined).otherwise(one(x["place"], x["bytes"])).alias("now"))

    return F.aggregate(spans, zero, step, lambda s: F.array_append(s["done"], s["now"]))


def removals(docs: DataFrame, run: int = RUN, **sizes) -> DataFrame:
    """A row a document that loses bytes (doc_id, _th): n_removed and the spans that go, as byte places."""
    go = repeats(docs, **sizes)
    g = go.groupBy("doc_id", "_th").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("place", "bytes"))).alias("s"))
    g = g.select("doc_id", "_th", F.filter(_runs(F.col("s")), lambda x: (x["bytes"] >= run) | (x["bytes"] == F.col("total"))).alias("spans")).where(F.size("spans") > 0)
    return g.select("doc_id", "_th", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["bytes"]).alias("n_removed"), "spans")


def strip(docs: DataFrame, **sizes) -> DataFrame:
    """docs with the repeated chunks taken out of text; every row stays, other columns are untouched."""
    k = keyed(docs)
    r = removals(k, **sizes).select(F.col("doc_id").alias("_rid"), F.col("_th").alias("_rth"), F.col("spans").alias("_rspans"))
    j = k.join(r, F.col("doc_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth")), "left")
    raw = F.encode(text_of(docs), "utf-8")
    ends = F.concat(F.transform("_rspans", lambda x: x["place"]), F.array(F.octet_length(raw)))
    begins = F.concat(F.array(F.lit(0)), F.transform("_rspans", lambda x: x["place"] + x["bytes"]))
    kept = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.decode(F.substring(raw, x["b"] + 1, x["e"] - x["b"]), "utf-8"))
    text = F.when(F.col("_rspans").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return j.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, spans."""
    docs = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    r = removals(docs).select(F.col("doc_id").alias("_rid"), F.col("_th").alias("_rth"), "n_removed", "spans")
    slim = docs.select("doc_id", "_th", F.octet_length(text_of(docs)).cast("bigint").alias("n_bytes"))
    j = slim.join(r, F.col("doc_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth")), "left")
    return j.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"), "spans")
