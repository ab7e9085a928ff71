"""Benchmark decontamination by spaced-seed hashing.

Fixed masks say which words of a short stretch count; a substitution on a masked-out word doesn't change the hash.
The hashes of the test items are a table, and so are those of the documents' stretches that a Bloom filter of the first lets
pass; the two are joined. A document's words around a hit then meet the item, laid on it at every offset where a seed
agrees; any stretch of `min_words` words (all words of a shorter item, 5 at least) or more of which 0.8 are equal is an
overlap. Reported is the best stretch with +1 a equal and -4 an unequal word if it is one, else the longest that is; of several
offsets the longest stretch, then the one with more equal words, then the earliest place. No overlap at 0.8 is without a hit: 13
words or more with a fifth unequal have 4 equal ones in a row, or 3 and 2 around an unequal one, as have 10 to 12; items of 6 to
9 words may differ in one word, and one of three masks of 4 words over 5 fits beside it. An item of 5 words must be there whole.
Words are runs of letters and digits, ASCII case folded. Null or empty texts and items of under 5 words never
match; null ids are kept as they are; equal rows give equal hits, on either side. Texts of any length are read whole; a text of a
few words again and again meets each item once for each pattern of equal words, not for each offset.
The filter has at most `filter_bits` bits, whatever the benchmark's size: a fuller one lets more documents through to the join
and loses none. Nothing else goes to the driver or to all executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, byte_slices, mix64, signed, stored, text_of, word_hash, word_spans

#: Fixed masks: 1 counts, 0 may be substituted. Items of 6 to 9 words have the short ones.
MASKS = ("11101011", "110110011", "1100101101", "1010011101", "1111", "111011")
SHORT_MASKS = ("11011", "10111", "11101")
MIN_WORDS, LEAST_ITEM, IDENTITY = 13, 5, 0.8
FILTER_BITS, SEED_BITS, PROBES = 1 << 29, 64, 5
#: Bits of a segment of the filter, one row while it is built.
_SEGMENT = 8192
#: Cells of the offsets x words tables that are compared at once.
_CELLS = 2_000_000
HITS = "doc_id bigint, item_id bigint, n_words int, n_equal int, identity double, doc_first int, item_first int, item_words int"


def _words(data, offs):
    s, e, first = word_spans(data, offs, LETTERS)
    return word_hash(data, s, e, lower=True), first


def masks_of(n: int) -> tuple[str, ...]:
    """The masks under which an item of n words is hashed."""
    if n < LEAST_ITEM:
        return ()
    if n == LEAST_ITEM:
        return ("1" * LEAST_ITEM,)
    return SHORT_MASKS if n < 10 else tuple(m for m in MASKS if len(m) <= n)


def _seed(w: np.ndarray, mask: str) -> np.ndarray:
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ w[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    return h


def _slots(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The place of each hash in the filter at one of its probes."""
    a = mix64(h)
    return ((a + np.uint64(probe) * (mix64(a ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def _longest(eq: np.ndarray, need: int, identity: float) -> tuple[int, int]:
    """The first of the longest stretches of at least `need` words of which `identity` are equal; (0, 0) if there is none."""
    run = np.concatenate([[0.0], np.cumsum(eq - identity)])
    # from a start, the last place that is no lower: the maxima from the right fall, so a search finds it
    high = np.maximum.accumulate(run[::-1])[::-1]
    end = np.searchsorted(-high, -(run - 1e-9), "right") - 1
    size = end - np.arange(len(run))
    start = int(size.argmax())
    return (start, int(end[start])) if size[start] >= need else (0, 0)


def _stretch(eq: np.ndarray, need: int, identity: float) -> tuple[int, int]:
    run = np.concatenate([[0], np.cumsum(np.where(eq, 1, -4))])
    low = np.minimum.accumulate(run)
    end = int(np.argmax(run - low))
    start = int(np.flatnonzero(run[: end + 1] == low[end])[0])
    if end - start < need or eq[start:end].sum() < identity * (end - start):
        start, end = _longest(eq, need, identity)
    return start, end


def best_overlap(w: np.ndarray, v: np.ndarray, min_words: int = MIN_WORDS, identity: float = IDENTITY):
    """(words, equal, first word in w, in v) of the best overlap of the texts w and item v, None if there is none."""
    need = max(LEAST_ITEM, min(min_words, len(v)))
    laid = np.zeros(len(w) + len(v), bool)
    for mask in masks_of(len(v)):
        x, y = _seed(w, mask), _seed(v, mask)
        order = np.argsort(x, kind="stable")
        x = x[order]
        lo, hi = np.searchsorted(x, y, "left"), np.searchsorted(x, y, "right")
        for j in np.flatnonzero(hi > lo).tolist():
            laid[order[lo[j] : hi[j]] - j + len(v)] = True
    offsets = np.flatnonzero(laid) - len(v)
    # beyond both ends of w nothing is equal, and no stretch goes there
    padded = np.concatenate([np.zeros(len(v), np.uint64), w, np.zeros(len(v), np.uint64)])
    best, seen, step = None, set(), max(1, _CELLS // len(v))
    for i in range(0, len(offsets), step):
        part = offsets[i : i + step]
        same = padded[part[:, None] + len(v) + np.arange(len(v))] == v
        a, b = np.maximum(-part, 0), np.minimum(len(w) - part, len(v))
        place = np.arange(len(v))
        same &= (place >= a[:, None]) & (place < b[:, None])
        likely = np.flatnonzero(same.sum(1) >= identity * need - 1e-9)
        packed = np.packbits(same[likely], axis=1)
        for row, at, key in zip(same[likely], likely.tolist(), packed):
            code = (key.tobytes(), int(a[at]), int(b[at]))
            if code in seen:  # an earlier offset has the same words equal
                continue
            seen.add(code)
            start, end = _stretch(row[a[at] : b[at]], need, identity)
            if n := end - start:
                start += int(a[at])
                got = (n, int(row[start : start + n].sum()), int(part[at]) + start, start)
                if best is None or got[:2] > best[:2]:
                    best = got
    return best


def _items(benchmark: DataFrame) -> DataFrame:
    """_item, item_id, words (64-bit hashes as bytes), size of each row of the benchmark with words enough."""

    def read(batches):
        for b in batches:
            for i, j, data, offs in byte_slices(b.column("text")):
                w, first = _words(data, offs)
                rows = [k for k in range(j - i) if first[k + 1] - first[k] >= LEAST_ITEM]
                if rows:
                    at = pa.array([i + k for k in rows])
                    texts = [w[first[k] : first[k + 1]] for k in rows]
                    yield pa.RecordBatch.from_arrays([b.column("_item").take(at), b.column("item_id").take(at), pa.array([x.tobytes() for x in texts], pa.binary()), pa.array([len(x) for x in texts], pa.int32())], names=["_item", "item_id", "_v", "_size"])

    named = benchmark.select(F.monotonically_increasing_id().alias("_item"), F.col("item_id").cast("bigint").alias("item_id"), text_of(benchmark).alias("text"))
    return stored(named.mapInArrow(read, "_item bigint, item_id bigint, _v binary, _size int"), "items")


def _seeds(items: DataFrame) -> DataFrame:
    """_h, _item: the different hashes of each item."""

    def hashed(batches):
        for b in batches:
            for item, v in zip(b.column("_item").to_pylist(), b.column("_v").to_pylist()):
                v = np.frombuffer(v, np.uint64)
                h = np.unique(np.concatenate([_seed(v, m) for m in masks_of(len(v))]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.full(len(h), item, np.int64))], names=["_h", "_item"])

    return stored(items.select("_item", "_v").mapInArrow(hashed, "_h bigint, _item bigint"), "seeds")


def _filter(seeds: DataFrame, most: int) -> np.ndarray:
    """The Bloom filter of the seeds as packed bits, SEED_BITS a seed while that is under `most`; its segments are made apart."""
    n = seeds.count()
    bits = max(_SEGMENT, min(most, 1 << (max(1, n) * SEED_BITS - 1).bit_length()))
    per = _SEGMENT

    def places(batches):
        for b in batches:
            h = np.asarray(b.column("_h")).view(np.uint64)
            s = np.concatenate([_slots(h, bits, p) for p in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((s // per).astype(np.int32)), pa.array((s % per).astype(np.int16))], names=["_segment", "_bit"])

    def packed(batches):
        for b in batches:
            out = []
            for x in b.column("_bits").to_pylist():
                z = np.zeros(per, bool)
                z[x] = True
                out.append(np.packbits(z, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_segment"), pa.array(out, pa.binary())], names=["_segment", "_bits"])

    segments = seeds.select("_h").mapInArrow(places, "_segment int, _bit smallint").groupBy("_segment").agg(F.collect_set("_bit").alias("_bits"))
    table = np.zeros((bits // per, per // 8), np.uint8)
    for r in segments.mapInArrow(packed, "_segment int, _bits binary").toLocalIterator():
        table[r[0]] = np.frombuffer(r[1], np.uint8)
    return table.reshape(-1)


def _passages(docs: DataFrame, held, masks: list[str], reach: int) -> DataFrame:
    """The words around seeds that pass the filter: _row, doc_id, _th, _passage, _at (first word), _w, _found (seeds)."""

    def scan(batches):
        table = held.value
        bits = np.uint64(len(table) * 8)
        for b in batches:
            for i, _, data, offs in byte_slices(b.column("text")):
                w, first = _words(data, offs)
                if not len(w):
                    continue
                doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                where, what = [], []
                for mask in masks:
                    h = _seed(w, mask)
                    at = np.arange(len(h))
                    at = at[doc[: len(h)] == doc[len(mask) - 1 :]]
                    for p in range(PROBES):
                        s = _slots(h[at], int(bits), p)
                        at = at[(table[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)]
                    where.append(at)
                    what.append(h[at])
                where, what = np.concatenate(where), np.concatenate(what)
                if not len(where):
                    continue
                order = np.argsort(where, kind="stable")
                where, what = where[order], what[order]
                # seeds of one text whose words meet are one passage
                new = np.concatenate([[True], (doc[where[1:]] != doc[where[:-1]]) | (np.diff(where) > 2 * reach)])
                cuts = np.append(np.flatnonzero(new), len(where))
                cols = [[], [], [], [], []]
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    d = int(doc[where[x]])
                    lo, hi = max(int(first[d]), int(where[x]) - reach), min(int(first[d + 1]), int(where[y - 1]) + reach)
                    for c, v in zip(cols, (i + d, lo, lo - int(first[d]), w[lo:hi].tobytes(), signed(np.unique(what[x:y])))):
                        c.append(v)
                at = pa.array(cols[0])
                yield pa.RecordBatch.from_arrays(
                    [b.column("_row").take(at), b.column("doc_id").take(at), b.column("_th").take(at), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.int64()))],
                    names=["_row", "doc_id", "_th", "_at", "_w", "_found"],
                )

    named = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash(docs).alias("_th"), text_of(docs).alias("text"))
    found = named.mapInArrow(scan, "_row bigint, doc_id bigint, _th bigint, _at int, _w binary, _found array<bigint>")
    return stored(found.withColumn("_passage", F.monotonically_increasing_id()), "passages")


def _text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _verified(docs: DataFrame, benchmark: DataFrame, min_words: int, identity: float, filter_bits: int) -> DataFrame:
    """HITS with _th, the hash of the document's text."""
    spark = docs.sparkSession
    items = _items(benchmark)
    reach = items.agg(F.max("_size")).first()[0]
    if reach is None:
        return spark.createDataFrame([], HITS + ", _th bigint")
    masks = [m for m in ("1" * LEAST_ITEM, *SHORT_MASKS, *MASKS) if m in {x for r in items.select(F.least("_size", F.lit(10 + max(map(len, MASKS))))).distinct().collect() for x in masks_of(r[0])}]
    seeds = _seeds(items)
    passages = _passages(docs, spark.sparkContext.broadcast(_filter(seeds, filter_bits)), masks, reach + max(map(len, MASKS)))
    pairs = passages.select("_passage", F.explode("_found").alias("_h")).join(seeds, "_h").select("_passage", "_item").distinct()
    laid = pairs.join(passages.drop("_found"), "_passage").join(items, "_item")

    def verify(batches):
        for b in batches:
            cols = b.to_pydict()
            rows = []
            for row, item, doc_id, th, at, w, item_id, v in zip(*(cols[c] for c in ("_row", "_item", "doc_id", "_th", "_at", "_w", "item_id", "_v"))):
                v = np.frombuffer(v, np.uint64)
                if got := best_overlap(np.frombuffer(w, np.uint64), v, min_words, identity):
                    n, same, first, of = got
                    rows.append((row, item, doc_id, item_id, n, same, same / n, at + first, of, len(v), th))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    found = laid.select("_row", "_item", "doc_id", "_th", "_at", "_w", "item_id", "_v").mapInArrow(verify, _FOUND)
    # several passages of a text may overlap an item
    best = F.max(F.struct("n_words", "n_equal", (-F.col("doc_first")).alias("_back"), *[c for c in _NAMES if c not in ("_row", "_item", "n_words", "n_equal")])).alias("_b")
    return found.groupBy("_row", "_item").agg(best).select("_b.*").select(*[x.split()[0] for x in HITS.split(", ")], "_th")


_FOUND = f"_row bigint, _item bigint, {HITS}, _th bigint"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_TYPES = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in _FOUND.split(", ")]


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each document and item that overlap: ids, words of the overlap, equal ones, its places."""
    return _verified(docs, benchmark, min_words, identity, filter_bits).drop("_th")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs without those that overlap any item; the rest's rows and columns as they were. Spark sends the found ones' keys round if their stored table is small."""
    hits = _verified(docs, benchmark, min_words, identity, filter_bits).select("doc_id", "_th").distinct()
    bad = stored(hits, "contaminated").toDF("_bad_id", "_bad_th")
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad["_bad_id"]) & (_text_hash(docs) == bad["_bad_th"]), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
