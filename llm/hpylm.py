"""LM scoring by a hierarchical Pitman-Yor model.

Tokens are the texts' words (ASCII case folded) and an end. A token is drawn in the restaurant of its context, the
whole word before it (or the start of the text); all context restaurants share the unigram restaurant as parent, and
that has the uniform distribution over the V known tokens and one unknown as its base. Seating is sampled by Gibbs:
given a restaurant's totals its words are independent, and the number of tables that serve a word has the
conditional p(t) ~ S_d(c, t) a^t (generalised Stirling numbers, a the weight of a new table), drawn exactly for up to
EXACT customers and customer by customer in growing blocks beyond. The tables of a word over all contexts are the
parent's customers, whose tables are drawn in turn; the parent's probabilities go back to the contexts. PASSES
times up and down, SWEEPS draws each; then the predictive probabilities of SAMPLES seatings are averaged. Discount and
strength of both levels are drawn from their posterior on a grid, given the numbers of tables (words of more than EXACT
customers tell nothing of the discount).

Where things are: texts are counted in batches of about BATCH bytes. A batch sends its (context, word) pairs to the
context's bucket; a bucket has whole restaurants, so their totals are at hand. A context with more tokens than a quarter
of a bucket's share is split over buckets by its words, and its totals are summed over them (frozen during a pass, so its
probabilities sum to one only nearly; no more than HOT contexts are split). Words have buckets of their own, where the
unigram restaurant is seated. All counts are merged in sorted arrays, nothing of the corpus meets on the driver but
totals, and no vocabulary is broadcast. A word is known by 64 bits of its hash, as a context and in a context by 48.

Null texts are empty: one end token. Rows with a null id are learnt from. Equal rows count twice, as two texts. Very
long texts are one batch. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, batches_of, byte_slices, discard, mix64, stored, text_of, trim, word_hash, word_spans

BATCH, BUCKET, EXACT, PASSES, SWEEPS, SAMPLES, HOT = 5_000_000, 8_000_000, 32, 1, 2, 3, 10_000
#: Log probabilities of pairs travel in steps of one part in so many: an error of 0.000004 a token at most.
STEPS = 1 << 17
FOLDS, HELD = 7, 2
_END, _START = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def pack(**arrays: np.ndarray) -> bytes:
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    return b"".join([struct.pack("<I", len(head)), head, *(np.ascontiguousarray(a).tobytes() for a in arrays.values())])


def unpack(b: bytes) -> dict[str, np.ndarray]:
    n = struct.unpack_from("<I", b)[0]
    at, out = 4 + n, {}
    for k, t, size in json.loads(b[4 : 4 + n]):
        out[k] = np.frombuffer(b, np.dtype(t), size, at)
        at += size * np.dtype(t).itemsize
    return out


# --- counting ------------------------------------------------------------------------------


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with the ends, and the number of tokens of each text."""
    s, e, first = word_spans(data, offs, SPACED)
    n = np.diff(first) + 1
    word = np.ones(int(n.sum()), bool)
    word[np.cumsum(n) - 1] = False
    tok = np.full(len(word), _END)
    tok[word] = word_hash(data, s, e, lower=True)
    return tok, n


def _six(x: np.ndarray) -> np.ndarray:
    """The lower six bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def _unsix(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.view("<u8").ravel()


def _squeezed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, byte by byte of all of them, compressed: what moves and what is stored is a half to a third of it."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T)
    return np.frombuffer(struct.pack("<Q", len(x)) + pa.compress(raw, codec="zstd", asbytes=True), np.uint8)


def _loose(b) -> np.ndarray:
    b = memoryview(b)
    n = struct.unpack("<Q", b[:8])[0]
    raw = np.frombuffer(pa.decompress(b[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _share(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 48-bit hashes: rising with the hash, so the words of a bucket stand together in sorted order."""
    return ((x >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, int)


def _rows(schema: str):
    """A function that makes record batches of a schema from columns."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]

    def make(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    return make


_COUNTED = "batch bigint, words binary, pairs binary, place binary, docs binary"


def _count(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """Rows of two kinds: a batch's words and how many followers each has, the trained counts of the pairs, their second words; documents with their tokens as numbers of words."""
    make = _rows(_COUNTED)

    def run(batches):
        from pyspark import TaskContext

        part, seq, size = TaskContext.get().partitionId(), 0, 0
        held: list = []

        def flush():
            nonlocal seq
            tok, n = (np.concatenate([x[i] for x in held]) for i in range(2))
            ids = [v for x in held for v in x[2]]
            out_of = np.concatenate([x[3] for x in held])
            batch = (part << 24) + seq
            seq += 1
            held.clear()
            word, inv = np.unique(np.append(tok, _START), return_inverse=True)
            del tok
            inv = inv.astype(np.int64)
            start, inv = inv[-1], inv[:-1]
            ends = np.cumsum(n)
            before = np.concatenate([[start], inv[:-1]])
            before[ends - n] = start
            pair, num = np.unique(before << 32 | inv, return_inverse=True)
            cnt = np.bincount(num, weights=np.repeat(~out_of, n), minlength=len(pair)).astype(np.uint32)
            del num, before
            runs = np.bincount((pair >> 32).astype(np.int64), minlength=len(word)).astype(np.uint32)
            w = _squeezed((pair & 0xFFFFFFFF).astype(np.uint32)).tobytes()
            yield make([batch], [pack(word=word, runs=_squeezed(runs), start=np.array([start], np.uint32))], [_squeezed(cnt).tobytes()], [w], [None])
            del pair
            inv, none = inv.astype(np.uint32), np.array([x is None for x in ids])
            doc = np.array([0 if x is None else x for x in ids], np.int64)
            for i in range(0, len(n), 200):
                k = slice(i, i + 200)
                yield make([batch], [None], [None], [None], [pack(doc=doc[k], none=none[k], held=out_of[k], n=n[k].astype(np.uint32), tok=_squeezed(inv[ends[i] - n[i] : ends[min(i + 200, len(n)) - 1]]))])
            del inv
            trim()

        for b in batches:
            for i, j, data, offs in byte_slices(b.column("text")):
                held.append((*_tokens(data, offs), b.column("doc_id").slice(i, j - i).to_pylist(), np.asarray(b.column("held_out").slice(i, j - i))))
                size += len(data)
                if size >= batch_bytes:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, _COUNTED)


def _by_key(rows: DataFrame, key: str, others: list[str], schema: str, flush, parts: int) -> DataFrame:
    """flush(key, rows) over all rows of each key, in the order of the other columns; rows hold unpacked data last."""
    rows = rows.repartition(parts, key).sortWithinPartitions(key, *others)

    def run(batches):
        now, held = None, []
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in (key, *others, "data"))):
                if x[0] != now and held:
                    yield from flush(now, held)
                    held = []
                    trim()
                now = x[0]
                held.append((*x[1:-1], unpack(x[-1])))
        if held:
            yield from flush(now, held)
            trim()

    return rows.mapInArrow(run, schema)


_UNIGRAMS = "bucket int, words binary, batch bigint, start bigint, counts binary"


def _unigrams(counted: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: a bucket's words with their trained counts; those counts for a batch's words from `start` on."""
    schema = "bucket int, batch bigint, start bigint, data binary"
    make, out = _rows(schema), _rows(_UNIGRAMS)

    def split(batches):
        for b in batches:
            for batch, x, c, w in zip(*(b.column(k).to_pylist() for k in ("batch", "words", "pairs", "place"))):
                word = unpack(x)["word"]
                n = np.bincount(_loose(w), weights=_loose(c), minlength=len(word)).astype(np.uint32)
                bucket = _share(word >> np.uint64(16), buckets)
                cut = _cuts(bucket)
                for i, j in zip(cut[:-1], cut[1:]):
                    yield make([int(bucket[i])], [batch], [i], [pack(word=word[i:j], n=_squeezed(n[i:j]))])

    def merge(bucket, rows):
        word, inv = np.unique(np.concatenate([x["word"] for *_, x in rows]), return_inverse=True)
        n = np.bincount(inv, weights=np.concatenate([_loose(x["n"]) for *_, x in rows])).astype(np.int64)
        yield out([bucket], [pack(word=word, n=n)], [None], [None], [None])
        at = 0
        for batch, start, x in rows:
            k = len(x["word"])
            yield out([bucket], [None], [batch], [start], [_squeezed(n[inv[at : at + k]]).tobytes()])
            at += k

    rows = counted.where("words is not null").select("batch", "words", "pairs", "place").mapInArrow(split, schema)
    return _by_key(rows, "bucket", ["batch", "start"], _UNIGRAMS, merge, buckets)


_BIGRAMS = "bucket int, pairs binary, words binary, batch bigint, start bigint, asks binary"


def _bigrams(counted: DataFrame, buckets: int, hot: np.ndarray, parts: np.ndarray) -> DataFrame:
    """Rows of two kinds: a bucket's restaurants (pairs a context, word numbers, trained counts) and its words; which of the pairs a batch has from `start` on.

    hot: 48-bit hashes of the contexts that are split, sorted; parts: over how many buckets each."""
    schema = "bucket int, batch bigint, start bigint, data binary"
    make, out = _rows(schema), _rows(_BIGRAMS)

    def split(batches):
        for b in batches:
            for batch, x, c, w in zip(*(b.column(k).to_pylist() for k in ("batch", "words", "pairs", "place"))):
                x, c, w = unpack(x), _loose(c), _loose(w)
                word = x["word"] >> np.uint64(16)
                runs = _loose(x["runs"]).astype(np.int64)
                v, w = np.repeat(word, runs), word[w]
                bucket = _share(v, buckets)
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
                    of = np.flatnonzero(hot[i] == v)
                    part = (w[of] >> np.uint64(16)) * parts[i[of]] >> np.uint64(32)
                    bucket[of] = _share(mix64(v[of] + part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16), buckets)
                cut = _cuts(bucket)
                for i, j in zip(cut[:-1], cut[1:]):
                    k = _cuts(v[i:j])
                    yield make([int(bucket[i])], [batch], [i], [pack(v=_six(v[i:j][k[:-1]]), n=_squeezed(np.diff(k)), w=_six(w[i:j]), c=_squeezed(c[i:j]))])
                del x, c, w, v, word, bucket
                trim()

    def merge(bucket, rows):
        v = np.concatenate([np.repeat(_unsix(x["v"]), _loose(x["n"])) for *_, x in rows])
        w = np.concatenate([_unsix(x["w"]) for *_, x in rows])
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        inv = np.empty(len(v), np.uint32)
        inv[order] = (np.cumsum(new) - 1).astype(np.uint32)
        c = np.bincount(inv, weights=np.concatenate([_loose(x["c"]) for *_, x in rows])).astype(np.uint32)
        v, w = v[new], w[new]
        del order, new
        word, num = np.unique(w, return_inverse=True)
        cut = _cuts(v)
        who = np.full(len(cut) - 1, -1, np.int32)
        if len(hot):
            i = np.minimum(np.searchsorted(hot, v[cut[:-1]]), len(hot) - 1)
            who = np.where(hot[i] == v[cut[:-1]], i, -1).astype(np.int32)
        yield out([bucket], [pack(n=_squeezed(np.diff(cut)), hot=_squeezed(who + 1), w=_squeezed(num), c=_squeezed(c))], [_six(word).tobytes()], [None], [None], [None])
        at = 0
        for batch, start, x in rows:
            k = len(x["w"]) // 6
            # the pairs of a slice are in order, so steps between them are small
            yield out([bucket], [None], [None], [batch], [start], [_squeezed(np.diff(inv[at : at + k].astype(np.int64), prepend=0)).tobytes()])
            at += k

    rows = counted.where("words is not null").select("batch", "words", "pairs", "place").mapInArrow(split, schema)
    return _by_key(rows, "bucket", ["batch", "start"], _BIGRAMS, merge, buckets)


# --- seating -------------------------------------------------------------------------------


def log_stirling(most: int, d: float) -> np.ndarray:
    """log S_d(c, t) for 1 <= t <= c <= most; -inf elsewhere."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            t = np.arange(1, c + 2)
            s[c + 1, t] = np.logaddexp(s[c, t - 1], np.where(c - t * d > 0, s[c, t] + np.log(np.maximum(c - t * d, 1e-300)), -np.inf))
    return s


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, stirling: np.ndarray, rng) -> np.ndarray:
    """Tables of c customers of one dish where a new table weighs a; each entry by itself."""
    most = len(stirling) - 1
    t = np.minimum(c, 1).astype(np.int64)
    la = np.log(np.maximum(a, 1e-300))
    few = np.minimum(c, most)
    order = np.argsort(few, kind="stable")
    cut = np.searchsorted(few[order], np.arange(2, most + 2))
    for k, (i, j) in enumerate(zip(cut[:-1], cut[1:]), start=2):
        if i == j:
            continue
        who = order[i:j]
        for at in range(0, len(who), 20_000):
            w = who[at : at + 20_000]
            x = stirling[k, 1 : k + 1] + la[w, None] * np.arange(1, k + 1) + rng.gumbel(size=(len(w), k))
            t[w] = x.argmax(1) + 1
    big = np.flatnonzero(c > most)
    if len(big):
        cb, ab, tb, at = c[big], a[big], t[big].astype(float), most
        top = int(cb.max())
        while at < top:
            to = min(top, at + max(8, at // 4))
            n = np.clip(cb - at, 0, to - at)
            p = (ab + 0 * tb) / (ab + np.maximum((at + to) / 2 - d * tb, 1e-9))
            tb += rng.binomial(n, np.clip(p, 0, 1))
            at = to
        t[big] = tb.astype(np.int64)
    return t


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _bins(x: np.ndarray) -> np.ndarray:
    """Numbers up to 2,048 as they are, greater ones in steps of 2 %."""
    x = np.asarray(x, float)
    return np.where(x <= 2048, x, 2048 + np.ceil(np.log(np.maximum(x, 2048) / 2048) / math.log(1.02))).astype(np.int64)


def _unbinned(b: np.ndarray) -> np.ndarray:
    return np.where(b <= 2048, b, 2048 * 1.02 ** (b - 2048.0))


def draw_parameters(tables: dict[int, float], customers: dict[int, float], seats: dict[tuple[int, int], float], rng) -> tuple[float, float]:
    """(discount, strength) from their posterior on a grid: numbers of restaurants by (binned) tables and customers, numbers of words by (c, t)."""
    if not tables:
        return 0.5, 1.0
    ds, ss = np.linspace(0.05, 0.95, 19), np.geomspace(0.01, 1000, 26)
    t, ht = _unbinned(np.array(list(tables))), np.array(list(tables.values()))
    n, hn = _unbinned(np.array(list(customers))), np.array(list(customers.values()))
    out = np.zeros((len(ds), len(ss)))
    for i, d in enumerate(ds):
        s = log_stirling(EXACT, d)
        words = sum(k * s[c, m] for (c, m), k in seats.items())
        for j, a in enumerate(ss):
            grown = (ht * ((t - 1) * math.log(d) + _lgamma(a / d + t) - math.lgamma(a / d + 1))).sum()
            out[i, j] = words + grown - (hn * (_lgamma(a + n) - math.lgamma(a + 1))).sum()
    p = np.exp(out - out.max()).ravel()
    k = int(rng.choice(len(p), p=p / p.sum()))
    return float(ds[k // len(ss)]), float(ss[k % len(ss)])


#: Kinds of the numbers that are summed on the way to the driver.
_TABLES, _CUSTOMERS, _SEATS, _HOT_C, _HOT_T, _OTHER = range(6)
_SUMS = "kind int, i bigint, v double"


def _told(kind: int, i: np.ndarray, v: np.ndarray | None = None):
    """Rows of sums by i."""
    u, inv = np.unique(np.asarray(i, np.int64), return_inverse=True)
    return _rows(_SUMS)(np.full(len(u), kind, np.int32), u, np.bincount(inv, weights=v, minlength=len(u)).astype(float))


def _collected(sums: DataFrame) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {k: {} for k in range(6)}
    for kind, i, v in sums.groupBy("kind", "i").agg(F.sum("v")).collect():  # bins, split contexts, a few totals
        out[kind][i] = v
    return out


def _seat_sums(c: np.ndarray, t: np.ndarray):
    few = (c > 0) & (c <= EXACT)
    return _told(_SEATS, c[few].astype(np.int64) * (EXACT + 1) + t[few])


def _seats(x: dict[int, float]) -> dict[tuple[int, int], float]:
    return {(i // (EXACT + 1), i % (EXACT + 1)): v for i, v in x.items()}


class Level:
    """What is known of the whole: parameters and totals."""

    def __init__(self, d: float = 0.5, strength: float = 1.0, hot: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))):
        self.d, self.strength, self.hot = d, strength, hot


class Restaurants:
    """The context restaurants of a bucket. p: the parent's probability of each of the bucket's words."""

    def __init__(self, x: dict[str, np.ndarray], p: np.ndarray | None, level: Level, rng):
        self.w, self.c, self.d, self.strength, self.rng = x["w"].astype(np.int64), x["c"].astype(np.int64), level.d, level.strength, rng
        hot = level.hot
        self.at = np.concatenate([[0], np.cumsum(x["n"].astype(np.int64))])
        self.r = np.repeat(np.arange(len(x["n"])), x["n"])
        self.hot, self.split = x["hot"], x["hot"] >= 0
        self.own_c = np.add.reduceat(self.c, self.at[:-1])
        self.C = np.where(self.split, hot[0][self.hot] if len(hot[0]) else 0, self.own_c)
        self.hot_t = np.where(self.split, hot[1][self.hot] if len(hot[1]) else 0, 0)
        self.p = None if p is None else p[self.w]
        self.stirling = log_stirling(EXACT, level.d)
        self._seated(np.minimum(self.c, 1))

    def _seated(self, t: np.ndarray) -> None:
        self.t, self.own_t = t, np.add.reduceat(t, self.at[:-1])
        self.T = np.where(self.split, self.hot_t, self.own_t)

    def sweep(self) -> None:
        some = np.flatnonzero(self.c > 1)  # one customer has one table
        t = np.minimum(self.c, 1)
        a = (self.strength + self.d * self.T[self.r[some]]) * self.p[some]
        t[some] = draw_tables(self.c[some], a, self.d, self.stirling, self.rng)
        self._seated(t)

    def predictive(self) -> np.ndarray:
        C, T = self.C[self.r], self.T[self.r]
        return (self.c - self.d * self.t + (self.strength + self.d * T) * self.p) / (self.strength + C)

    def told(self):
        whole = ~self.split & (self.own_c > 0)
        yield _told(_TABLES, _bins(self.own_t[whole]))
        yield _told(_CUSTOMERS, _bins(self.own_c[whole]))
        yield _seat_sums(self.c, self.t)
        if self.split.any():
            yield _told(_HOT_C, self.hot[self.split], self.own_c[self.split])
            yield _told(_HOT_T, self.hot[self.split], self.own_t[self.split])


_JOINED = "bucket int, origin int, start bigint, pairs binary, words binary, p binary, batch bigint, asks binary"


def _joined(bigrams: DataFrame, parents: DataFrame | None, root: Root | None, buckets: int, asks: bool = False) -> DataFrame:
    """The context buckets' rows, each followed by the parent's probabilities of its words and, if wanted, by what batches ask of it."""
    null = {c: F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _JOINED.split(", "))}

    def shaped(df, **columns):
        return df.select(*[columns[c].alias(c) if c in columns else null[c] for c in null])

    all_ = shaped(bigrams.where("pairs is not null"), bucket=F.col("bucket"), origin=F.lit(-1), pairs=F.col("pairs"), words=F.col("words"))
    if parents is not None:
        made = _rows("bucket int, origin int, p binary")

        def answer(batches):
            p = None
            for b in batches:
                for k, x, origin, place in zip(*(b.column(c).to_pylist() for c in ("bucket", "words", "origin", "place"))):
                    if x is not None:
                        p = root.probabilities(k, unpack(x)["c"]).astype("<f4")
                    else:
                        yield made([origin], [k], [p[np.cumsum(_loose(place))].tobytes()])

        # a word bucket's own row, without an origin, comes before those that ask it
        p = parents.repartition(buckets, "bucket").sortWithinPartitions("bucket", "origin").mapInArrow(answer, "bucket int, origin int, p binary")
        all_ = all_.unionByName(shaped(p, bucket=F.col("bucket"), origin=F.col("origin"), p=F.col("p")))
    if asks:
        a = bigrams.where("asks is not null")
        all_ = all_.unionByName(shaped(a, bucket=F.col("bucket"), origin=F.lit((1 << 31) - 1), start=F.col("start"), batch=F.col("batch"), asks=F.col("asks")))
    return all_.repartition(buckets, "bucket").sortWithinPartitions("bucket", "origin", "batch", "start")


def _opened(pairs: bytes) -> dict[str, np.ndarray]:
    x = {k: _loose(v) for k, v in unpack(pairs).items()}
    return x | {"hot": x["hot"].astype(np.int64) - 1}


def _assembled(batches):
    """(bucket, pairs, words, p, None) of each bucket, then (batch, start, asks) of each that asks it."""
    own, got = None, []
    for b in batches:
        for k, origin, start, x, words, p, batch, asks in zip(*(b.column(c.split()[0]).to_pylist() for c in _JOINED.split(", "))):
            if x is None and p is not None:
                got.append(p)
                continue
            if own is not None:
                yield (*own, np.frombuffer(b"".join(got), "<f4").astype(float) if got else None), None
            own, got = ((k, _opened(x), np.frombuffer(words, np.uint8)), []) if x is not None else (None, [])
            if x is None:
                yield None, (batch, start, asks)
    if own is not None:
        yield (*own, np.frombuffer(b"".join(got), "<f4").astype(float) if got else None), None


_SEATED = "bucket int, origin int, data binary, kind int, i bigint, v double"


def _seat(joined: DataFrame, level: Level, buckets: int, seed: int, sweeps: int) -> DataFrame:
    """Rows of two kinds: tables of the words of a word bucket, over a bucket's contexts; sums for the driver."""
    make = _rows(_SEATED)

    def run(batches):
        for (k, x, words, p), _ in _assembled(batches):
            word = _unsix(words)
            s = Restaurants(x, p, level, np.random.default_rng([seed, k]))
            for _ in range(sweeps):
                s.sweep()
            t = np.bincount(s.w, weights=s.t, minlength=len(word)).astype(np.uint32)
            of = _share(word, buckets)
            cut = _cuts(of)
            for i, j in zip(cut[:-1], cut[1:]):
                yield make([int(of[i])], [k], [pack(w=_six(word[i:j]), t=_squeezed(t[i:j]))], [None], [None], [None])
            for told in s.told():
                none = [None] * told.num_rows
                yield make(none, none, none, *told.columns)
            trim()

    return joined.mapInArrow(run, _SEATED)


_PARENTS = "bucket int, words binary, origin int, place binary"


def _parents(up: DataFrame, unigrams: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: a word bucket's customers of the unigram restaurant; where the words of a context bucket stand in it."""
    out = _rows(_PARENTS)
    own = unigrams.where("words is not null").select("bucket", F.lit(-1).alias("origin"), F.col("words").alias("data"))

    def merge(bucket, rows):
        word = rows[0][1]["word"] >> np.uint64(16)
        c = np.zeros(len(word), np.int64)
        places = []
        for origin, x in rows[1:]:
            i = np.searchsorted(word, _unsix(x["w"]))
            c += np.bincount(i, weights=_loose(x["t"]), minlength=len(word)).astype(np.int64)
            places.append((origin, _squeezed(np.diff(i, prepend=0)).tobytes()))
        yield out([bucket], [pack(c=c)], [None], [None])
        for origin, i in places:
            yield out([bucket], [None], [origin], [i])

    return _by_key(own.unionByName(up), "bucket", ["origin"], _PARENTS, merge, buckets)


class Root:
    """The unigram restaurant: totals and parameters. Its tables are drawn where they are needed, the same for the same seed."""

    def __init__(self, known: float, d: float, strength: float, tables: float, seed: int):
        self.uniform, self.d, self.strength, self.before, self.seed = 1.0 / (known + 1), d, strength, tables, seed
        self.C = self.T = 0.0

    def tables(self, bucket: int, c: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([self.seed, bucket])
        return draw_tables(c, np.full(len(c), (self.strength + self.d * self.before) * self.uniform), self.d, log_stirling(EXACT, self.d), rng)

    def probabilities(self, bucket: int, c: np.ndarray) -> np.ndarray:
        return (c - self.d * self.tables(bucket, c) + (self.strength + self.d * self.T) * self.uniform) / (self.strength + self.C)


def _root(parents: DataFrame, known: float, seed: int) -> Root:
    """Draws the unigram restaurant's tables, its parameters, and the tables again; each time the totals are summed over the word buckets."""
    rows = parents.where("words is not null").select("bucket", "words")

    def totals(root: Root | None):
        def run(batches):
            for b in batches:
                for k, x in zip(b.column("bucket").to_pylist(), b.column("words").to_pylist()):
                    c = unpack(x)["c"]
                    t = np.minimum(c, 1) if root is None else root.tables(k, c)
                    yield _told(_OTHER, np.array([0, 1]), np.array([c.sum(), t.sum()], float))
                    yield _seat_sums(c, t)

        got = _collected(rows.mapInArrow(run, _SUMS))
        return got[_OTHER].get(0, 0.0), got[_OTHER].get(1, 0.0), _seats(got[_SEATS])

    _, tables, _ = totals(None)
    customers, tables, seats = totals(Root(known, 0.5, 1.0, tables, seed))
    one = lambda x: {int(_bins(np.array([x]))[0]): 1.0} if x else {}
    d, strength = draw_parameters(one(tables), one(customers), seats, np.random.default_rng([seed, 1]))
    root = Root(known, d, strength, tables, seed + 1)
    root.C, root.T, _ = totals(root)
    return root


# --- scores --------------------------------------------------------------------------------


_ANSWERS = "batch bigint, kind int, start bigint, data binary"
_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _answers(joined: DataFrame, level: Level, seed: int) -> DataFrame:
    """The averaged log10 probabilities of a batch's pairs from `start` on, in steps of 1 / STEPS."""
    make = _rows(_ANSWERS)

    def run(batches):
        lp = None
        for own, ask in _assembled(batches):
            if own is not None:
                k, x, _, p = own
                s = Restaurants(x, p, level, np.random.default_rng([seed, k]))
                total = np.zeros(len(s.c))
                for r in range(SWEEPS + SAMPLES):
                    s.sweep()
                    if r >= SWEEPS:
                        total += s.predictive()
                lp = np.rint(np.minimum(-np.log10(total / SAMPLES), 15.9) * STEPS).astype("<u4")
                del s, total
                trim()
            else:
                batch, start, asks = ask
                yield make([batch], [0], [start], [_squeezed(lp[np.cumsum(_loose(asks))]).tobytes()])

    return joined.mapInArrow(run, _ANSWERS)


def _score(answers: DataFrame, counted: DataFrame, unigrams: DataFrame, tokens: float, known: float, parts: int) -> DataFrame:
    null, zero = F.lit(None).cast("binary").alias("more"), F.lit(0).cast("bigint")
    rows = answers.select("batch", "kind", "start", "data", null)
    rows = rows.unionByName(unigrams.where("counts is not null").select("batch", F.lit(1).alias("kind"), "start", F.col("counts").alias("data"), null))
    own = counted.where("words is not null").select("batch", "words", "place").mapInArrow(_slim, "batch bigint, data binary, more binary")
    rows = rows.unionByName(own.select("batch", F.lit(2).alias("kind"), zero.alias("start"), "data", "more"))
    rows = rows.unionByName(counted.where("docs is not null").select("batch", F.lit(3).alias("kind"), zero.alias("start"), F.col("docs").alias("data"), null))
    rows = rows.repartition(parts, "batch").sortWithinPartitions("batch", "kind", "start")
    total, spread, make = int(tokens), np.log10(tokens + known + 1), _rows(_SCORES)

    def run(batches):
        now, lps, counts, lp = None, [], [], None
        for b in batches:
            for batch, kind, x, more in zip(*(b.column(c).to_pylist() for c in ("batch", "kind", "data", "more"))):
                if batch != now:
                    now, lps, counts = batch, [], []
                if kind == 0:
                    lps.append(_loose(x))
                elif kind == 1:
                    counts.append(_loose(x))
                elif kind == 2:
                    lp = np.concatenate(lps) / -float(STEPS)
                    c = np.concatenate(counts).astype(float)
                    base, seen = np.log10(c + 1) - spread, c > 0
                    x = unpack(x)
                    runs = _loose(x["runs"])
                    pair = np.repeat(np.arange(len(runs)), runs) << 32 | _loose(more).astype(np.int64)
                    lps, counts = [], []
                else:
                    d = unpack(x)
                    tok, n = _loose(d["tok"]).astype(np.int64), d["n"].astype(np.int64)
                    ends = np.cumsum(n)
                    before = np.concatenate([[0], tok[:-1]])
                    before[ends - n] = start
                    at = np.searchsorted(pair, before << 32 | tok)
                    sums = [np.add.reduceat(v, ends - n) for v in (seen[tok].astype(np.int64), base[tok], lp[at])]
                    k = len(n)
                    yield make([None if z else int(i) for i, z in zip(d["doc"], d["none"])], d["held"], n, sums[0], [total] * k, sums[1], sums[2])
                if kind == 2:
                    start = int(x["start"][0])

    return rows.mapInArrow(run, _SCORES)


def _slim(batches):
    """A batch's numbers of followers and the pairs' second words, without the words themselves."""
    make = _rows("batch bigint, data binary, more binary")
    for b in batches:
        for batch, x, w in zip(*(b.column(c).to_pylist() for c in ("batch", "words", "place"))):
            x = unpack(x)
            yield make([batch], [pack(runs=x["runs"], start=x["start"])], [w])


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(FOLDS)) == HELD, F.lit(False))


def scores(docs: DataFrame, batch_bytes: int = BATCH, bucket_bytes: int = BUCKET, seed: int = 5) -> DataFrame:
    """Per row of docs (doc_id, text): the model's and the base's log10 probability of the whole text."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), text_of(docs).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-int(size) // bucket_bytes))
    counted = stored(_count(d, batch_bytes), "counted")
    with batches_of(docs.sparkSession, 1):  # rows are megabytes
        unigrams = stored(_unigrams(counted, buckets), "unigrams")
        tokens, known = _vocabulary(unigrams)
        hot, parts = _hot(unigrams, max(tokens / buckets / 4, 1.0))
        bigrams = stored(_bigrams(counted, buckets, hot, parts), "bigrams")

        level, none = Level(), (np.zeros(len(hot)), np.zeros(len(hot)))
        level.hot = none
        seated = stored(_seat(_joined(bigrams, None, None, buckets), level, buckets, seed, 0), "seated")
        for i in range(PASSES + 1):
            got = _collected(seated.where("kind is not null").select("kind", "i", "v"))
            for k, kind in enumerate((_HOT_C, _HOT_T)):
                for j, v in got[kind].items():
                    none[k][j] = v
            seats = _seats(got[_SEATS])
            if i:
                level = Level(*draw_parameters(got[_TABLES], got[_CUSTOMERS], seats, np.random.default_rng([seed, i])), none)
            else:
                once, twice = (sum(v for (c, _), v in seats.items() if c == k) for k in (1, 2))
                level = Level(float(np.clip(once / max(once + 2 * twice, 1), 0.05, 0.95)), 1.0, none)
            gone = [] if i == 0 else [parents]
            parents = stored(_parents(seated.where("kind is null").select("bucket", "origin", "data"), unigrams, buckets), "parents")
            root = _root(parents, known, seed + 10 * i)
            discard(seated, *gone)
            if i < PASSES:
                seated = stored(_seat(_joined(bigrams, parents, root, buckets), level, buckets, seed + 1 + i, SWEEPS), "seated")
        answers = stored(_answers(_joined(bigrams, parents, root, buckets, asks=True), level, seed + 1 + PASSES), "answers")
        discard(bigrams, parents)
        out = stored(_score(answers, counted, unigrams, tokens, known, buckets), "scores")
        discard(answers, counted, unigrams)
    return out


def _vocabulary(unigrams: DataFrame) -> tuple[float, float]:
    """Trained tokens and distinct trained words."""

    def run(batches):
        for b in batches:
            for x in b.column("words").to_pylist():
                n = unpack(x)["n"]
                yield _told(_OTHER, np.array([0, 1]), np.array([n.sum(), (n > 0).sum()], float))

    got = _collected(unigrams.where("words is not null").select("words").mapInArrow(run, _SUMS))[_OTHER]
    return got.get(0, 0.0), got.get(1, 0.0)


def _hot(unigrams: DataFrame, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of more than `most` tokens, as 48-bit hashes in order, and how many buckets each should have."""
    make = _rows("v bigint, n double")

    def run(batches):
        for b in batches:
            for x in b.column("words").to_pylist():
                x = unpack(x)
                # a text has one start and one end, so the ends' number is the starts'
                word, n = np.where(x["word"] == _END, _START, x["word"]) >> np.uint64(16), x["n"].astype(float)
                yield make(word[n > most].astype(np.int64), n[n > most])

    got = unigrams.where("words is not null").select("words").mapInArrow(run, "v bigint, n double").orderBy(F.desc("n"), "v").limit(HOT).collect()
    got.sort()
    return np.array([r[0] for r in got], np.uint64), np.array([math.ceil(r[1] / most) for r in got], np.uint64)


def perplexity(scored: DataFrame, by: str = "held_out") -> DataFrame:
    """Perplexity a token of the model and of the base, over all texts of each value of `by`."""
    n = F.sum("n_tokens")
    return scored.groupBy(by).agg(n.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / n).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / n).alias("base_perplexity"))


def op4_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
