"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents stand in a permuted order (a seeded hash of the row) that is cut into blocks. A source
with target T and size S gives floor(T / S) whole passes and, of one more pass, the documents at the front of its
order that come nearest to the rest. The blocks so taken are the source's quota. A tree over the output shards
splits the quotas: at each node the left half's share of every source is one multivariate-hypergeometric draw, so
shards get exact disjoint quotas; each shard then takes the next permuted blocks of its quota and is shuffled
locally. Nulls: text counts 0 words, source null is a source of its own and comes last. Equal rows are decided
alike. Empty tables give no rows. Other columns pass through untouched; columns starting with _mix_ are reserved.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of a source, and the cells that each is cut into to find where the last pass ends.
BLOCKS = CELLS = 1024
#: Sources and shard quotas are held on the driver; more than these are refused.
MOST_SOURCES, MOST_QUOTAS = 100_000, 20_000_000


def targets(sizes: list[int], total: float, weights=WEIGHTS, repeats: float = MOST_REPEATS) -> list[float]:
    """Shares of total by cyclic weight, none above repeats times its source; the excess goes to the others by weight."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free and left > 0:
        whole = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / whole > repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / whole
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): exact disjoint quotas, each node split by a multivariate-hypergeometric draw seeded by its place."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, n, method="marginals") if n else np.zeros_like(q)
        stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _placed(docs: DataFrame, seed: int) -> DataFrame:
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(BLOCKS * CELLS * CELLS))
    return docs.select("*", h.alias("_mix_h")).withColumn("_mix_block", F.floor(F.col("_mix_h") / (CELLS * CELLS)).cast("int"))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


class Mix:
    """The plan of one mix: per source its size, target, passes and the end of the last pass."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, repeats: float = MOST_REPEATS, share: float = 1.0, shards: int = 16, seed: int = 7):
        self.docs, self.seed, self.spark, self.shards = _placed(docs, seed), seed, docs.sparkSession, shards
        per = self.docs.groupBy("source", "_mix_block").agg(F.sum(_size()).alias("words"))
        totals = per.groupBy("source").agg(F.sum("words").alias("words")).limit(MOST_SOURCES + 1).collect()
        if len(totals) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [int(r["words"]) for r in totals]
        aims = targets(sizes, share * sum(sizes), weights, repeats)
        self.sources = [
            {"source": r["source"], "source_size": s, "target": t, "passes": int(t // s) if s else 0, "rest": t - (t // s) * s if s else 0.0}
            for r, s, t in zip(totals, sizes, aims)
        ]
        self._find_ends()

    def _table(self, fields: str, rows: list) -> DataFrame:
        df = self.spark.createDataFrame(rows, fields)
        return F.broadcast(df) if len(rows) <= MOST_SOURCES else df

    def _find_ends(self) -> None:
        """Three levels of sums (block, cell, place) find for each source the last hash whose documents are still taken."""
        at = {i: {"low": 0, "rest": s["rest"]} for i, s in enumerate(self.sources) if s["rest"] > 0}
        n = {s["source"]: i for i, s in enumerate(self.sources)}
        for s in self.sources:
            s["end"] = -1
        width = BLOCKS * CELLS * CELLS
        while at and width > 1:
            cell = width // CELLS
            table = self._table("_mix_source string, _mix_low bigint", [(self.sources[i]["source"], v["low"]) for i, v in at.items()])
            d = self.docs.join(table, F.col("source").eqNullSafe(F.col("_mix_source")))
            d = d.where((F.col("_mix_h") >= F.col("_mix_low")) & (F.col("_mix_h") < F.col("_mix_low") + width))
            # one row a source and cell, so at most CELLS rows of a source meet in the window
            sums = d.groupBy("_mix_source", F.floor((F.col("_mix_h") - F.col("_mix_low")) / cell).alias("c")).agg(F.sum(_size()).alias("w"))
            order = Window.partitionBy("_mix_source").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
            sums = sums.withColumn("upto", F.sum("w").over(order))
            rest = self._table("s string, r double", [(self.sources[i]["source"], v["rest"]) for i, v in at.items()])
            over = sums.join(rest, F.col("_mix_source").eqNullSafe(F.col("s"))).where("upto >= r")
            found = over.groupBy("s").agg(F.min(F.struct("c", "w", "upto")).alias("x")).collect()
            hit = {n[r["s"]]: r["x"] for r in found}
            for i in list(at):
                if i not in hit:  # rounding at the very end: everything in reach is taken
                    self.sources[i]["end"] = at[i]["low"] + width - 1
                    del at[i]
                    continue
                x = hit[i]
                low, rest_i = at[i]["low"] + int(x["c"]) * cell, at[i]["rest"] - (x["upto"] - x["w"])
                at[i] = {"low": low, "rest": rest_i}
                if cell == 1:  # the document on the border comes in if that is nearer
                    self.sources[i]["end"] = low if rest_i * 2 >= x["w"] else low - 1
            width = cell

    def table(self) -> DataFrame:
        rows = [(s["source"], s["source_size"], s["target"], s["passes"], s["end"]) for s in self.sources]
        return self._table("_mix_source string, _mix_source_size bigint, _mix_target double, _mix_passes int, _mix_end bigint", rows)

    def copies(self) -> DataFrame:
        """docs with _mix_source_size, _mix_target and _mix_copies, the number of times the mix takes the row."""
        d = self.docs.join(self.table(), F.col("source").eqNullSafe(F.col("_mix_source")))
        return d.withColumn("_mix_copies", F.col("_mix_passes") + (F.col("_mix_h") <= F.col("_mix_end")).cast("int"))

    def quotas(self) -> np.ndarray:
        """Blocks that each source gives, whole passes and the last one."""
        return np.array([s["passes"] * BLOCKS + (s["end"] // (CELLS * CELLS) + 1 if s["end"] >= 0 else 0) for s in self.sources], np.int64)

    def shard_of(self) -> DataFrame:
        """(source, pass, block) -> shard: each shard takes the next blocks of its quota in permuted order."""
        q = self.quotas()
        if len(q) * self.shards > MOST_QUOTAS:
            raise ValueError("too many shard quotas; use fewer shards")
        upto = np.cumsum(split_tree(q, self.shards, self.seed), axis=0) if len(q) else np.zeros((self.shards, 0), np.int64)
        rows = [(s["source"], int(q[i]), [int(x) for x in upto[:, i]]) for i, s in enumerate(self.sources)]
        t = self.spark.createDataFrame(rows, "_mix_s_source string, _mix_s_quota bigint, _mix_s_upto array<bigint>")
        t = t.where("_mix_s_quota > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_mix_s_quota") - 1)).alias("_mix_s_n"))
        perm = F.row_number().over(Window.partitionBy("_mix_s_source", F.floor(F.col("_mix_s_n") / BLOCKS)).orderBy(F.xxhash64(F.lit(self.seed), "_mix_s_source", "_mix_s_n"))) - 1
        t = t.withColumn("_mix_s_pass", F.floor(F.col("_mix_s_n") / BLOCKS).cast("int")).withColumn("_mix_s_rank", F.col("_mix_s_pass") * BLOCKS + perm)
        shard = F.size(F.filter("_mix_s_upto", lambda x: x <= F.col("_mix_s_rank")))
        return t.select("_mix_s_source", "_mix_s_pass", F.pmod("_mix_s_n", F.lit(BLOCKS)).cast("int").alias("_mix_s_block"), shard.alias("_mix_shard"))

    def rows(self) -> DataFrame:
        """The mix itself: every taken copy with _mix_shard, shuffled inside its shard; columns as in docs."""
        d = self.copies().where("_mix_copies > 0").withColumn("_mix_pass", F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1)))
        s = self.shard_of()
        if len(self.sources) * BLOCKS * (MOST_REPEATS + 1) <= 2_000_000:
            s = F.broadcast(s)
        d = d.join(s, F.col("source").eqNullSafe(F.col("_mix_s_source")) & (F.col("_mix_pass") == F.col("_mix_s_pass")) & (F.col("_mix_block") == F.col("_mix_s_block")))
        order = F.xxhash64(F.lit(self.seed), "_mix_shard", "_mix_pass", "_mix_h")
        return d.withColumn("_mix_order", order)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, repeats included, shard by shard in a local random order."""
    m = Mix(docs, **options)
    d = m.rows().repartition(m.shards, "_mix_shard").sortWithinPartitions("_mix_shard", "_mix_order")
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m = Mix(docs)
    d = m.docs.select("doc_id", "source", F.xxhash64("text").alias("_mix_th"), "_mix_h", _size().alias("size"))
    # what the shards drew: rows of the mix counted by document; equal rows are drawn alike and share the count
    same = ["doc_id", "source", "_mix_th", "_mix_h"]
    drawn = m.rows().withColumn("_mix_th", F.xxhash64("text")).groupBy(*same).agg(F.count("*").alias("_mix_drawn"))
    drawn = drawn.select(*[F.col(c).alias(f"_d{c}") for c in same], "_mix_drawn")
    each = d.groupBy(*same, "size").agg(F.count("*").alias("_mix_rows"))
    both = each.join(drawn, [each[c].eqNullSafe(drawn[f"_d{c}"]) for c in same], "left")
    n = F.expr("coalesce(_mix_drawn, 0) div _mix_rows").cast("int")
    c = both.withColumn("copies", n).withColumn("_mix_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_mix_rows"))))
    c = c.join(m.table(), F.col("source").eqNullSafe(F.col("_mix_source")))
    return c.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")
