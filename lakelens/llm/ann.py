"""Operator 10: approximate nearest neighbours by a hash-prefix forest.

Rows are dealt to shards by the prefix of one routing string, and each shard indexes all its rows in a forest. A query looks
in its own shard first. The k-th best cosine found there says how likely a row that is nearer has each other prefix, and the
query goes on to the likeliest until what is left is improbable; in a shard's forest, the same cosine says how far to ascend.
So data with near neighbours are looked at in few places, and data without any nearly everywhere."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stash, trimmed

#: Trees of a forest and bits of a hash string.
TREES, BITS = 64, 32
#: How probably a row as near as the k-th found is among the candidates: of the shards that are asked, and of a forest's rows.
ROUTED, ASCENDED = 0.95, 0.95
#: A query's first look takes so many candidates at least, repeats counted.
LEAST = 256
#: Rows in a shard, about; a shard with many more is split by id. Bits of the routing string at most.
SHARD_ROWS, ROUTE_BITS = 4096, 16
QUERY_BLOCK = 256


def routing(dim: int) -> np.ndarray:
    return np.random.default_rng(29).standard_normal((dim, ROUTE_BITS))


def prefix_of(unit: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of the routing string, as an integer."""
    signs = unit @ routing(unit.shape[1])[:, :bits] > 0
    return (signs * (1 << np.arange(bits - 1, -1, -1))).sum(1).astype(np.int64) if bits else np.zeros(len(unit), np.int64)


def likely(unit: np.ndarray, bits: int, cosine: float) -> list[int]:
    """Prefixes in order of the probability that a row with that cosine has them, until they have ROUTED of it together.

    Such a row is the query's direction and a random one across it, in the ratio of the cosine and the sine, so each bit's
    probability follows from the query's distance to the plane."""
    if not bits:
        return [0]
    margin = unit @ routing(len(unit))[:, :bits]
    cosine = min(max(cosine, -1.0), 1.0)
    slope = cosine / math.sqrt(max(1e-12, 1 - cosine * cosine))
    same = np.array([0.5 * math.erfc(-slope * abs(m) / math.sqrt(2)) for m in margin])
    own = int(prefix_of(unit[None], bits)[0])
    if cosine <= 0:
        return list(range(1 << bits))
    # best first over sets of flipped bits, cheapest flips first; each set is reached from one other alone
    cost = np.log(same) - np.log(np.maximum(1 - same, 1e-300))
    order = np.argsort(cost, kind="stable")
    base = float(np.log(same).sum())
    weigh = [float(cost[j]) for j in order]
    mask = [1 << (bits - 1 - int(j)) for j in order]
    out, mass, heap = [own], math.exp(base), [(weigh[0], 0, mask[0])]
    while heap and mass < ROUTED and len(out) < 1 << bits:
        c, j, flips = heapq.heappop(heap)
        out.append(own ^ flips)
        mass += math.exp(base - c)
        if j + 1 < bits:
            heapq.heappush(heap, (c + weigh[j + 1], j + 1, flips | mask[j + 1]))
            heapq.heappush(heap, (c - weigh[j] + weigh[j + 1], j + 1, flips ^ mask[j] | mask[j + 1]))
    return out


def depth(cosine: float) -> int:
    """The longest prefix at which some tree holds a row with that cosine, with probability ASCENDED or more."""
    same = 1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi
    each = 1 - (1 - ASCENDED) ** (1 / TREES)
    return BITS if same >= 1 else max(0, min(BITS, int(math.log(each) / math.log(max(same, 1e-9)))))


class Forest:
    """For each tree the rows' hash strings, sorted, as integers: a common prefix is a range of the sorted array."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 17):
        self.ids, self.x, self.looked = ids, x, 0
        self.norm = np.sqrt((x * x).sum(1))
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.planes = np.random.default_rng(seed).standard_normal((TREES, x.shape[1], BITS)).astype(np.float32)
        self.sorted, self.order = [], []
        single = self.unit.astype(np.float32)
        for t in range(TREES):
            code = self.code(single, t)
            order = np.argsort(code, kind="stable")
            self.order.append(order.astype(np.int32))
            self.sorted.append(code[order])

    def code(self, unit: np.ndarray, t: int) -> np.ndarray:
        bits = unit.astype(np.float32) @ self.planes[t] > 0
        return np.packbits(bits, axis=1).view(">u4").ravel().astype(np.int64)

    def spans(self, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the range of rows that share so many bits."""
        keep = BITS - bits
        first = (codes >> keep) << keep
        lo = np.stack([np.searchsorted(s, f) for s, f in zip(self.sorted, first)])
        return lo, np.stack([np.searchsorted(s, f + (1 << keep)) for s, f in zip(self.sorted, first)])

    def rows(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Rows in any tree's range for one query."""
        mark = np.zeros(len(self.ids), bool)
        for order, a, b in zip(self.order, lo.tolist(), hi.tolist()):
            mark[order[a:b]] = True
        return np.flatnonzero(mark)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray):
        """(query, row id, cosine) of each query's k best candidates, ties to the smaller id. known: cosines that a row must
        reach to be of use. All trees ascend together: first to the longest prefix with LEAST candidates, then to the depth
        that the k-th best of them asks for; as more candidates only raise it, that is deep enough."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        codes = np.stack([self.code(unit, t) for t in range(TREES)])
        want = min(TREES * len(self.ids), LEAST)
        low, high = np.zeros(len(unit), np.int64), np.full(len(unit), BITS, np.int64)
        levels = {}
        while (low < high).any():  # the longest prefix with enough, by halving
            mid = (low + high + 1) // 2
            for m in np.unique(mid[low < high]).tolist():
                if m not in levels:
                    levels[m] = self.spans(codes, m)
            enough = np.array([(levels[m][1][:, q] - levels[m][0][:, q]).sum() >= want if low[q] < high[q] else True for q, m in enumerate(mid.tolist())])
            low, high = np.where(enough, np.where(low < high, mid, low), low), np.where(enough, high, mid - 1)
        for q, qid in enumerate(query_ids.tolist()):
            level = int(low[q])
            found, near = self._near(codes, levels, level, q, unit[q])
            kth = float(np.partition(near, len(near) - k)[len(near) - k]) if len(near) >= k else -1.0
            due = depth(max(kth, float(known[q])))
            if due < level:
                found, near = self._near(codes, levels, due, q, unit[q])
            self.looked += len(found)
            if len(found) > k:
                found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
            exact = (self.x[found] * queries[q]).sum(1) / (self.norm[found] * np.sqrt((queries[q] * queries[q]).sum()))
            for i in np.lexsort((self.ids[found], -exact))[:k].tolist():
                yield qid, int(self.ids[found[i]]), float(exact[i])

    def _near(self, codes, levels, level, q, unit):
        if level == 0:
            found = np.arange(len(self.ids))
        else:
            if level not in levels:
                levels[level] = self.spans(codes, level)
            found = self.rows(levels[level][0][:, q], levels[level][1][:, q])
        return found, self.unit[found] @ unit


def _asked(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, id, score) from the shards that are asked: rows (dim, shard, part, id, v), asked (dim, shard, part, query, known, v).
    Both are dealt by shard and part; a block of queries is held at a time."""
    one = rows.select("dim", "shard", "part", F.lit(0).alias("asks"), "id", F.lit(-1.0).alias("known"), "v")
    both = one.union(asked.select("dim", "shard", "part", F.lit(1).alias("asks"), F.col("query").alias("id"), "known", "v"))
    both = both.repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "asks", "id")

    def run(batches):
        key, forest, base_rows = None, None, []
        for b in batches:
            dim, shard, part, asks = (b.column(i).to_numpy() for i in range(4))
            marks = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
            for a, z in zip([0, *marks.tolist()], [*marks.tolist(), len(dim)]):
                if a == z:
                    continue
                if key != (dim[a], shard[a], part[a]):
                    key, forest, base_rows = (dim[a], shard[a], part[a]), None, []
                ids = b.column(4).slice(a, z - a).to_numpy()
                x = b.column(6).slice(a, z - a).flatten().to_numpy().reshape(z - a, -1)
                if not asks[a]:
                    base_rows.append((ids, x))
                    continue
                if not base_rows:
                    continue
                if forest is None:
                    forest = Forest(np.concatenate([i for i, _ in base_rows]), np.concatenate([y for _, y in base_rows]))
                known = b.column(5).slice(a, z - a).to_numpy()
                for i in range(0, z - a, QUERY_BLOCK):
                    s = slice(i, i + QUERY_BLOCK)
                    forest.looked = 0
                    got = list(forest.search(ids[s], x[s], k, known[s]))
                    out = [*zip(*got)] if got else [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))] + [pa.array([forest.looked] + [0] * (len(got) - 1) if got else [], pa.int64())], names=["query", "id", "score", "looked"])

    return both.mapInArrow(trimmed(run), "query long, id long, score double, looked long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query, best): each query's k nearest of what shards found, as an array of (s: the negative score, id)."""
    return found.groupBy("query").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, row_id: str = "vec_id", vector: str = "embedding", looked: list | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each query its k nearest of the candidates found among rows, by cosine in
    double precision on the vectors as given, nearest first, ties to the smaller id; a row with the query's id is no
    candidate. All of them, if there are fewer than k.

    Vectors that are null, empty, zero or hold a null or non-finite part take no part, nor do rows without id; vectors of
    different lengths aren't compared; rows or queries with the same id and vector are one. Of equal vectors only the k + 1
    smallest ids can be in a result, so only they are indexed, and equal queries are searched once. Every row is in its
    shard's index or equals k + 1 rows there. Other columns play no part. looked, a list, gets the pairs that were scored."""
    v, spark = F.col(vector), rows.sparkSession
    sound = F.col(row_id).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    tidy = lambda df: df.filter(sound).select(F.col(row_id).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("v"), F.size(v).alias("dim")).withColumn("h", F.xxhash64("v"))
    # by the group limit that Spark puts before the shuffle, equal vectors shrink where they are read
    place = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))
    base = stash(tidy(rows).withColumn("n", place).filter(F.col("n") <= k + 1).select("dim", "id", "v").dropDuplicates(["dim", "id", "v"]), "ann-rows")
    bits = max(0, min(ROUTE_BITS, math.ceil(math.log2(max(1, base.count() / SHARD_ROWS)))))

    def route(batches):
        """(dim, shard, id, v): a row's own prefix."""
        for b in batches:
            dim = b.column(0).to_numpy()
            shard = np.zeros(len(dim), np.int64)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                x = b.column(2).take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
                shard[at] = prefix_of(x / np.linalg.norm(x, axis=1, keepdims=True), bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shard), b.column(1), b.column(2)], names=["dim", "shard", "id", "v"])

    kind = "dim int, shard long, id long, v array<double>"
    routed = base.mapInArrow(route, kind)
    sizes = stash(routed.groupBy("dim", "shard").agg(F.ceil(F.count("*") / (4 * SHARD_ROWS)).alias("parts")), "ann-shards")  # at most 2 ** ROUTE_BITS rows for a length
    held = stash(routed.join(F.broadcast(sizes), ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("dim", "shard", "part", "id", "v"), "ann-held")
    every = tidy(queries).select("id", "v", "h", "dim").distinct()
    one = stash(every.groupBy("h", "v", "dim").agg(F.min("id").alias("id")).select("dim", "id", "v"), "ann-queries")
    parts = F.broadcast(sizes.select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))
    own = one.mapInArrow(route, kind).join(parts, ["dim", "shard"], "left").select("dim", "shard", "part", F.col("id").alias("query"), F.lit(-1.0).alias("known"), "v")
    first = stash(_asked(held, own.filter("part is not null"), k + 1), "ann-first")
    kth = _best(first, k + 1).select("query", F.when(F.size("best") > k, -F.element_at("best", -1)["s"]).otherwise(-1.0).alias("known"))

    def spread(batches):
        """A row for each further prefix that a query has to ask."""
        for b in batches:
            out: list[list] = [[], [], []]
            for row, (dim, known, x) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_numpy(), b.column(3))):
                x = np.array(x.as_py())
                more = likely(x / np.linalg.norm(x), bits, float(known))
                home = int(prefix_of((x / np.linalg.norm(x))[None], bits)[0])
                more = [s for s in more if s != home]
                out[0] += [row] * len(more)
                out[1] += more
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(out[1], pa.int64()), b.column(1).take(at), b.column(2).take(at), b.column(3).take(at)], names=["dim", "shard", "query", "known", "v"])

    due = one.withColumnRenamed("id", "query").join(kth, "query", "left").select("dim", "query", F.coalesce("known", F.lit(-1.0)).alias("known"), "v")
    more = due.mapInArrow(spread, "dim int, shard long, query long, known double, v array<double>").join(parts, ["dim", "shard"])
    found = first.union(stash(_asked(held, more.select("dim", "shard", "part", "query", "known", "v"), k + 1), "ann-more")) if bits else first
    if looked is not None:
        looked.append(found.agg(F.sum("looked")).first()[0] or 0)
    best = _best(found, k + 1).withColumnRenamed("query", "id")
    # each query has its vector's neighbours but itself
    with_best = one.join(best, "id").select("dim", "v", "best")
    mine = every.select(F.col("id").alias("query_id"), "v", "dim").join(with_best, ["dim", "v"]).select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    mine = mine.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))
