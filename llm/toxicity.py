"""Toxicity by class-conditional Kneser-Ney models of spelling.

Two interpolated Kneser-Ney models over the bytes of words (order ORDER, ASCII case folded) are trained on toxic
and on ordinary documents. Both back off to the same lower-order continuation counts, pooled over the classes, so
a spelling that one class never showed costs it only its backoff weight, and rare expressions share strength with
their relatives. A text's evidence is the difference of the two log-likelihoods, length-normalised over the whole
text, together with its peaks: the greatest difference of a word and the sum over words beyond PEAK nats. A
logistic curve, fitted on documents that the models it was fitted with had not seen, turns these into a score.

Bounds: the models learn from at most MOST_DOCS labelled documents of each class, those with the least hash of
doc_id (the rule is the same at every size). Everything else is scored whole. Labels that are null teach nothing;
a document labelled twice is toxic if any label says so. Null and empty texts have no evidence and get the
curve's value at zero. With labels of one class only, the score is the share of toxic labels; with none, 0.
Equal rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, byte_slices, text_of, word_hash, word_spans

ORDER, DISCOUNT, PEAK, MOST_DOCS = 6, 0.75, 3.0, 1500
FOLDS = 5


def _grams(data: np.ndarray, s: np.ndarray, e: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the order-grams that end at each byte and at the end of the words data[s:e]; the number for each word."""
    pad, n = order - 1, e - s
    size = n + pad + 1
    total = int(size.sum())
    buf = np.full(total, 32, np.uint64)
    begin = np.cumsum(size) - size
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    b = data[np.repeat(s, n) + at].astype(np.uint64)
    b += np.where((b >= 65) & (b <= 90), 32, 0).astype(np.uint64)
    buf[np.repeat(begin + pad, n) + at] = b
    codes = np.zeros(total, np.uint64)
    for k in range(order):
        codes[k:] |= buf[: total - k] << np.uint64(8 * k)
    real = np.ones(total, bool)
    skip = np.arange(int(pad * len(s))) % pad + np.repeat(begin, pad) if pad else np.zeros(0, int)
    real[skip] = False
    return codes[real], n + 1


def _counts(words: dict[bytes, int], order: int) -> tuple[np.ndarray, np.ndarray]:
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    ks = list(words)
    data = np.frombuffer(b"".join(ks), np.uint8)
    e = np.cumsum([len(k) for k in ks])
    codes, n = _grams(data, e - np.array([len(k) for k in ks]), e, order)
    u, inv = np.unique(codes, return_inverse=True)
    return u, np.bincount(inv, weights=np.repeat(np.array(list(words.values()), float), n))


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, weights=values)


def _at(keys: np.ndarray, values: np.ndarray, q: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(q), other)
    i = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return np.where(keys[i] == q, values[i], other)


class Model:
    """The two models folded into what scoring needs: the log ratio of every gram either class has shown, and of
    every context for all other grams (there the shared lower orders cancel, the backoff weights don't)."""

    def __init__(self, toxic: dict[bytes, int], ordinary: dict[bytes, int], order: int = ORDER, d: float = DISCOUNT):
        self.order = order
        both = [_counts(w, order) for w in (toxic, ordinary)]
        grams = np.unique(np.concatenate([g for g, _ in both]))
        shared = self._continuation(grams, order, d)
        logs, contexts = [], np.unique(grams >> np.uint64(8))
        backs = []
        for g, c in both:
            h, tot = _sum_by(g >> np.uint64(8), c)
            _, kinds = _sum_by(g >> np.uint64(8), np.ones(len(g)))
            weight = d * kinds / tot if len(h) else np.zeros(0)
            ctx = grams >> np.uint64(8)
            n = _at(h, tot, ctx, 0.0)
            lam = _at(h, weight, ctx, 1.0)
            p = np.where(n > 0, np.maximum(_at(g, c, grams, 0.0) - d, 0) / np.maximum(n, 1), 0) + lam * shared
            logs.append(np.log(p))
            backs.append(np.log(_at(h, weight, contexts, 1.0)))
        self.grams, self.ratio = grams, (logs[0] - logs[1]).astype(np.float32)
        self.contexts, self.back = contexts, (backs[0] - backs[1]).astype(np.float32)

    @staticmethod
    def _continuation(grams: np.ndarray, order: int, d: float) -> np.ndarray:
        """p(last byte | context without its first byte) of each gram from pooled continuation counts, down to uniform."""
        mask = lambda k: np.uint64((1 << (8 * k)) - 1)
        levels, g = [], grams
        for k in range(order - 1, 0, -1):  # distinct ways to come to each shorter gram
            u, n = np.unique(g & mask(k), return_counts=True)
            levels.append((k, u, n))
            g = u
        p, keys = np.zeros(0), np.zeros(0, np.uint64)
        for k, u, n in reversed(levels):
            _, inv, kinds = np.unique(u >> np.uint64(8), return_inverse=True, return_counts=True)
            tot = np.bincount(inv, weights=n)
            low = 1 / 256 if k == 1 else p[np.searchsorted(keys, u & mask(k - 1))]
            p = (n - d) / tot[inv] + d * kinds[inv] / tot[inv] * low
            keys = u
        return p[np.searchsorted(keys, grams & mask(order - 1))]

    def words(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        if not len(s):
            return np.zeros(0)
        codes, n = _grams(data, s, e, self.order)
        if not len(self.grams):
            return np.zeros(len(s))
        r = _at(self.grams, self.ratio, codes, np.nan)
        miss = np.isnan(r)
        r[miss] = _at(self.contexts, self.back, codes[miss] >> np.uint64(8), 0.0)
        return np.add.reduceat(r, np.cumsum(n) - n)

    def features(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, 3): mean ratio a byte, greatest of a word, what goes beyond PEAK (log1p)."""
        s, e, first = word_spans(data, offs, SPACED)
        out = np.zeros((len(offs) - 1, 3))
        if not len(s):
            return out
        h = word_hash(data, s, e, lower=True)
        _, one, inv = np.unique(h, return_index=True, return_inverse=True)
        r = self.words(data, s[one], e[one])[inv]
        has = np.flatnonzero(np.diff(first))
        at = first[:-1][has]
        out[has, 0] = np.add.reduceat(r, at) / np.add.reduceat((e - s + 1).astype(float), at)
        out[has, 1] = np.clip(np.maximum.reduceat(r, at), 0, 12) / 4
        out[has, 2] = np.log1p(np.add.reduceat(np.maximum(r - PEAK, 0), at))
        return out


def _bag(texts: list[str]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for t in texts:
        for w in t.encode("utf-8").lower().split():
            out[w] = out.get(w, 0) + 1
    return out


def _feature_rows(m: Model, texts: list[str]) -> np.ndarray:
    out = [m.features(data, offs) for _, _, data, offs in byte_slices(pa.array(texts, pa.large_string()))]
    return np.concatenate(out) if out else np.zeros((0, 3))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * np.r_[0, b[1:]]
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-6, np.full(x.shape[1] - 1, ridge)])
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Scorer:
    def __init__(self, toxic: list[str], ordinary: list[str], share: float):
        """share: of toxic labels among all, so that the score is a probability there."""
        self.constant = None
        if not toxic or not ordinary:
            self.constant = 1.0 if toxic else 0.0
            return
        x, y = [], []
        for k in range(2):  # the curve sees each document through a model trained without it
            m = Model(_bag(toxic[k::2]), _bag(ordinary[k::2]))
            for texts, label in ((toxic[1 - k :: 2], 1.0), (ordinary[1 - k :: 2], 0.0)):
                f = _feature_rows(m, texts)
                x.append(f)
                y.append(np.full(len(f), label))
        x, y = np.concatenate(x), np.concatenate(y)
        share = min(max(share, 1e-3), 1 - 1e-3)
        w = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
        self.curve = _logistic(x, y, w)
        self.model = Model(_bag(toxic), _bag(ordinary))

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offs) - 1, self.constant)
        z = self.curve[0] + self.model.features(data, offs) @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out():
    """True for rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(FOLDS)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS) -> Scorer:
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    n = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    picked = None
    for y in (0, 1):  # bounded, so broadcast
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", text_of(docs).alias("_t")).join(F.broadcast(picked), "doc_id").select("doc_id", "_y", "_t").collect()
    texts.sort(key=lambda r: (r[0], r[2]))
    share = n.get(1, 0) / max(1, sum(n.values()))
    return Scorer([r[2] for r in texts if r[1] == 1], [r[2] for r in texts if r[1] == 0], share)


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, j, data, offs in byte_slices(b.column("text")):
                s[i:j] = held.value.scores(data, offs)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), text_of(docs).alias("text"))
    return d.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """docs without those whose score reaches `at`; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, j, data, offs in byte_slices(b.column("text")):
                keep[i:j] = held.value.scores(data, offs) < at
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
