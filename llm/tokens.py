"""Token ids in directly addressable codes.

Documents are put in ascending doc_id order (null first, equal ids by text hash), encoded, and written in blocks.
A block splits each id into chunks, lowest first: level 0 holds the lowest chunk of every id, level k the next
chunk of the ids that need it. A bit a chunk says whether the id goes on; the position in the next level is the
number of such bits before, which a rank directory of one count every 512 bits gives without scanning. So any
token is read with a few slices, no block is decoded. Chunk widths are the cheapest for the block's own ids.

Block layout, little endian: b"DAC1", u32 documents, u32 ids, u32 levels, u8 widths padded to 4; u32 start of each
document and the end; i64 doc_ids; u8 null marks padded to 4; then a level: u32 chunks, packed chunks, packed
continuation bits, u32 rank directory, each padded to 4 (the last level has no bits).

Null texts count as empty; each document ends with the end id, so an empty one has one id. Equal rows are written
as often as they come. A document is never split over blocks. No documents give no blocks and no rows.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, byte_slices, folder, text_of, trim, word_hash, word_spans

BLOCK_IDS = 1 << 18
#: Bytes of text in a shard, and the number of shards beyond which shards grow instead.
SHARD_BYTES, MOST_SHARDS = 32_000_000, 100_000
RANK = 512


# --- the codes ----------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> bytes:
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return _pad(np.packbits(bits.ravel(), bitorder="little").tobytes())


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


def _widths(ids: np.ndarray) -> list[int]:
    """Chunk widths with the fewest bits, by dynamic programming over the ids' bit lengths."""
    if not len(ids):
        return [1]
    length = np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(int)
    top = max(1, int(length.max()))
    longer = [int((length > k).sum()) for k in range(top + 1)]  # ids with bits beyond the first k
    longer[0] = len(ids)
    best = {top: (0, [])}
    for at in range(top - 1, -1, -1):
        best[at] = min(((longer[at] * ((to - at) + (to < top)) + best[to][0]), [to - at, *best[to][1]]) for to in range(at + 1, top + 1))
    return best[0][1]


def encode_block(docs: list[np.ndarray], doc_ids: list[int | None]) -> bytes:
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    widths = _widths(ids)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u4")
    out = [b"DAC1", np.array([len(docs), len(ids), len(widths)], "<u4").tobytes(), _pad(bytes(widths)), starts.tobytes()]
    out += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), _pad(bytes(x is None for x in doc_ids))]
    rest = ids
    for k, w in enumerate(widths):
        out += [np.array([len(rest)], "<u4").tobytes(), _pack(rest & np.uint32((1 << w) - 1), w)]
        high = rest >> np.uint32(w) if w < 32 else np.zeros_like(rest)
        if k < len(widths) - 1:
            more = high > 0
            out.append(_pad(np.packbits(more, bitorder="little").tobytes()))
            full = np.concatenate([[0], np.cumsum(more)])
            out.append(full[: len(more) + 1 : RANK].astype("<u4").tobytes())
            rest = high[more]
    return b"".join(out)


class Block:
    """A written block, opened without decoding it."""

    def __init__(self, b: bytes):
        if b[:4] != b"DAC1":
            raise ValueError("not a block of directly addressable codes")
        self.b = b
        self.docs, self.n, levels = (int(x) for x in np.frombuffer(b, "<u4", 3, 4))
        self.widths = list(b[16 : 16 + levels])
        at = 16 + levels + (-levels % 4)
        self.starts = np.frombuffer(b, "<u4", self.docs + 1, at)
        at += 4 * (self.docs + 1)
        ids = np.frombuffer(b, "<i8", self.docs, at)
        at += 8 * self.docs
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, b[at : at + self.docs])]
        at += self.docs + (-self.docs % 4)
        self.levels = []
        for k, w in enumerate(self.widths):
            n = int(np.frombuffer(b, "<u4", 1, at)[0])
            chunks = at + 4
            bits = chunks + -(-(-(-n * w // 8)) // 4) * 4
            rank = bits + -(-(-(-n // 8)) // 4) * 4
            last = k == len(self.widths) - 1
            self.levels.append((n, chunks, bits, rank))
            at = bits if last else rank + 4 * (n // RANK + 1)

    def _chunk(self, k: int, i: int) -> int:
        w, (_, at, _, _) = self.widths[k], self.levels[k]
        lo, hi = i * w // 8, (i * w + w + 7) // 8
        return (int.from_bytes(self.b[at + lo : at + hi], "little") >> (i * w % 8)) & ((1 << w) - 1)

    def __getitem__(self, i: int) -> int:
        """The i-th id, by a few slices a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for k, w in enumerate(self.widths):
            out |= self._chunk(k, i) << shift
            shift += w
            if k == len(self.widths) - 1:
                break
            _, _, bits, rank = self.levels[k]
            if not self.b[bits + i // 8] >> (i % 8) & 1:
                break
            r = i // RANK
            before = int.from_bytes(self.b[rank + 4 * r : rank + 4 * r + 4], "little")
            part = int.from_bytes(self.b[bits + r * RANK // 8 : bits + i // 8 + 1], "little") & ((1 << (i - r * RANK)) - 1)
            i = before + part.bit_count()
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, which, shift = np.zeros(self.n, np.uint32), np.arange(self.n), 0
        for k, (w, (n, at, bits, _)) in enumerate(zip(self.widths, self.levels)):
            raw = np.frombuffer(self.b, np.uint8, (n * w + 7) // 8, at)
            chunk = np.unpackbits(raw, bitorder="little", count=n * w).reshape(n, w).astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
            out[which] |= chunk << np.uint32(shift)
            shift += w
            if k < len(self.widths) - 1:
                go = np.unpackbits(np.frombuffer(self.b, np.uint8, (n + 7) // 8, bits), bitorder="little", count=n).astype(bool)
                which = which[go]
        return out


# --- encoding ------------------------------------------------------------------------------


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_spans with a full stop or comma that ends a word after an ASCII letter as a word of its own."""
    s, e, _ = word_spans(data, offs, SPACED)
    last = data[e - 1] if len(e) else np.zeros(0, np.uint8)
    cut = (e - s > 1) & ((last == 46) | (last == 44))
    cut[cut] = _LETTER[data[e[cut] - 2]]
    n = 1 + cut
    at = np.cumsum(n) - n
    s2, e2 = np.repeat(s, n), np.repeat(e, n)
    e2[at[cut]] -= 1
    s2[at[cut] + 1] = e[cut] - 1
    return s2, e2, np.searchsorted(s2, offs)


class WordCache:
    """Ids of whole texts by their words: white space never reaches a token, so a word is encoded once.

    Every encoding is the tokenizer's own. Where the vocabulary marks the ends of words, words of letters alone (a
    trailing full stop or comma is another token) go through it many at a time and are told apart by those marks;
    if their number is not the words', and for all other words, each goes alone. A word is known by two independent
    hashes of 64 bits; words that share the first only are encoded where they stand.
    """

    def __init__(self, path: str, most: int = 450_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.t, self.most = Tokenizer.from_file(path), most
        vocab = self.t.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        # ASCII case can't matter where the tokenizer lower-cases: it is asked, not assumed
        ask = "".join(chr(c) for c in range(65, 91))
        self.lower = self.t.encode(ask, add_special_tokens=False).ids == self.t.encode(ask.lower(), add_special_tokens=False).ids
        self.stops = self._splits_stops()
        self._clear()

    def _clear(self) -> None:
        # sorted word hashes with the place and number of their ids in flat
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.second = np.zeros(0, np.uint64)
        self.hits = np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _splits_stops(self) -> bool:
        """Whether a full stop or comma after a letter is a token of its own."""
        ids = lambda x: self.t.encode(x, add_special_tokens=False).ids
        return all(ids(w + p) == ids(w) + ids(p) for w in ("a", "then", "qz", "Word") for p in ".,")

    def _forget(self) -> None:
        """Keeps the words that came in more than one slice, or nothing if those are too many."""
        keep = self.hits > 1
        if keep.sum() > self.most // 2:
            self._clear()
            return
        at, size = self.at[keep].astype(np.int64), self.size[keep].astype(np.int64)
        upto = np.cumsum(size)
        flat = self.flat[np.repeat(at - (upto - size), size) + np.arange(int(size.sum()))]
        self.second = self.second[keep]
        self.keys, self.size, self.at, self.hits = self.keys[keep], self.size[keep], (upto - size).astype(np.int32), np.ones(int(keep.sum()), np.int32)
        self.flat, self.used = np.concatenate([flat, np.zeros(max(1 << 16, len(flat)), np.uint32)]), len(flat)

    def _alone(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = self.t.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            cut = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(cut) == len(part) and cut[-1] == len(ids):
                out += [ids[x:y] for x, y in zip([0, *cut], cut)]
            else:
                out += self._alone(part)
        return out

    def _encode(self, words: list[str]) -> list[list[int]]:
        if not self.last.any():
            return self._alone(words)
        stems = [w[:-1] if w[-1] in ".," else w for w in words]
        plain = list({x for x in stems if x.isalpha()})
        known = dict(zip(plain, self._together(plain))) if plain else {}
        ends = dict(zip(".,", self._alone([".", ","])))
        rest = [w for w, x in zip(words, stems) if x not in known]
        known |= dict(zip(rest, self._alone(rest))) if rest else {}
        return [known[w] if w in known else known[x] + ends[w[-1]] for w, x in zip(words, stems)]

    def _learn(self, hashes: np.ndarray, second: np.ndarray, words: list[str]) -> None:
        got = self._encode(words)
        k = sum(map(len, got))
        while self.used + k > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        size = np.array([len(x) for x in got], np.int32)
        self.flat[self.used : self.used + k] = np.fromiter(chain.from_iterable(got), np.uint32, k)
        where = np.searchsorted(self.keys, hashes)
        self.at = np.insert(self.at, where, (self.used + np.cumsum(size) - size).astype(np.int32))
        self.size = np.insert(self.size, where, size)
        self.keys = np.insert(self.keys, where, hashes)
        self.second = np.insert(self.second, where, second)
        self.hits = np.insert(self.hits, where, 0)
        self.used += k

    def encode(self, data: np.ndarray, offs: np.ndarray, end: int) -> list[np.ndarray]:
        """Ids of each text of the slice, with the end id."""
        if len(self.keys) > self.most:
            self._forget()
        s, e, first = _spans(data, offs) if self.stops else word_spans(data, offs, SPACED)
        if not len(s):
            return [np.array([end], np.uint32)] * (len(offs) - 1)
        h, h2 = (word_hash(data, s, e, lower=self.lower, seed=k) for k in (0, 1))
        h, one, inv = np.unique(h, return_index=True, return_inverse=True)
        i = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), bool)
        inside = i < len(self.keys)
        known[inside] = self.keys[i[inside]] == h[inside]
        if not known.all():
            raw, new = data.tobytes(), one[~known]
            self._learn(h[~known], h2[new], [raw[x:y].decode() for x, y in zip(s[new].tolist(), e[new].tolist())])
            i = np.searchsorted(self.keys, h)
        self.hits[i] += 1
        clash = np.flatnonzero(self.second[i][inv] != h2)
        at, size = self.at[i][inv].astype(np.int64), self.size[i][inv].astype(np.int64)
        other: list[list[int]] = []
        if len(clash):
            raw = data.tobytes()
            other = self._alone([raw[s[k] : e[k]].decode() for k in clash.tolist()])
            size[clash] = [len(x) for x in other]
        upto = np.cumsum(size)
        ids = self.flat[np.minimum(np.repeat(at - (upto - size), size) + np.arange(upto[-1]), len(self.flat) - 1)]
        for k, x in zip(clash.tolist(), other):
            ids[upto[k] - size[k] : upto[k]] = x
        cut = np.concatenate([[0], upto])[first]
        return [np.append(ids[i:j], np.uint32(end)) for i, j in zip(cut[:-1], cut[1:])]


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """One for all tasks of a Python worker."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end: int = 1, block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes docs (doc_id, text) to path: a row a block, with its shard, its place in it and the payload."""
    d = docs.select("doc_id", text_of(docs).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-int(size) // shard_bytes)))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    # a shard is a range of the order; Spark finds the bounds from a sample of the keys
    d = d.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text").withColumn("shard", F.spark_partition_id())
    schema = "shard int, block int, start bigint, n_docs int, n_ids bigint, payload binary"

    def write(batches):
        trim()
        cache, now = word_cache(tokenizer), {"shard": None}
        held: list[np.ndarray] = []
        ids: list = []

        def flush():
            n = sum(map(len, held))
            if now["block"] % 8 == 7:
                trim()
            row = [now["shard"], now["block"], now["start"], len(held), n, encode_block(held, ids)]
            now["block"] += 1
            now["start"] += n
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["shard", "block", "start", "n_docs", "n_ids", "payload"])

        waiting = 0
        for b in batches:
            for i, j, data, offs in byte_slices(b.column("text"), 400_000):
                part = b.slice(i, j - i)
                for s, doc, x in zip(part.column("shard").to_pylist(), part.column("doc_id").to_pylist(), cache.encode(data, offs, end)):
                    if s != now["shard"] or waiting and waiting + len(x) > block_ids:
                        if held:
                            yield flush()
                        waiting = 0
                        if s != now["shard"]:
                            now = {"shard": s, "block": 0, "start": 0}
                    held.append(x)
                    ids.append(doc)
                    waiting += len(x)
        if held:
            yield flush()

    d.mapInArrow(write, schema).write.option("compression", "zstd").parquet(path)


def read_blocks(spark, path: str) -> DataFrame:
    """One row a document, from the written blocks: doc_id, start, n_tokens, ids_crc32, shard, block, place."""
    blocks = spark.read.parquet(path)
    schema = "shard int, block int, place int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"

    def read(batches):
        for b in batches:
            for shard, block, start, payload in zip(*(b.column(c).to_pylist() for c in ("shard", "block", "start", "payload"))):
                x = Block(payload)
                ids, s = x.ids().astype("<u4"), x.starts.astype(np.int64)
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(s[:-1], s[1:])]
                n = x.docs
                cols = [np.full(n, shard, np.int32), np.full(n, block, np.int32), np.arange(n, dtype=np.int32), x.doc_ids, start + s[:-1], np.diff(s), crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in schema.split(", ")])

    docs = blocks.select("shard", "block", "start", "payload").mapInArrow(read, schema)
    sizes = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one number a shard
    base, rows = 0, []
    for s in sorted(sizes):
        rows.append((s, base))
        base += sizes[s]
    offset = spark.createDataFrame(rows, "shard int, base bigint")
    if len(rows) <= 1_000_000:
        offset = F.broadcast(offset)
    d = docs.join(offset, "shard")
    return d.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", "place")


def token(spark, path: str, shard: int, block: int, i: int) -> int:
    """One id of the written table, read by its address."""
    row = spark.read.parquet(path).where((F.col("shard") == shard) & (F.col("block") == block)).select("payload").first()
    return Block(bytes(row[0]))[i]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_docs(docs: DataFrame, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    path = folder(docs.sparkSession, "ids")
    write_blocks(docs, path, tokenizer or tokenizer_path(), end)
    return read_blocks(docs.sparkSession, path)


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    return encode_docs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
