"""Operator 6: exact n-gram Jaccard join. Size-banded tiles, hashed bitmap signatures, sorted-array intersections.

1. Sizes fall into bands, and a tile holds sets of one band, some of them from the end of the band before. From STRICT on,
   linked sets differ in few shingles, at most k in a band: it deals shingles by hash to more than k parts, so linked sets
   agree in a whole part, and its hash names the tile. Below STRICT parts would be too small to tell sets apart. There
   shingles have an order, by how often they were met, rarest first, then by hash; of a set of size s, linked sets share one
   of the first s - ceil(threshold * s) + 1, and each of these names a tile.
2. In a small tile all are compared with each other (below STRICT, where the tile's shingle may be the first that both share,
   and those that follow leave room), in a large one with its smallest id, first within a map task (so that a hot tile shrinks
   before the shuffle), then across tasks. Bit counts of the hashed bitmaps bound the overlap of a pair from above, without
   its texts; what they leave is decided by the intersection of the sorted arrays.
3. Where a large tile still has several components, another member may join them. Its components form a family. The sets of all
   components but the largest of a family, in order of size, fill blocks, and these meet each other and the largest's blocks
   where sizes can match. First only their bitmaps do: sets that no other component's leaves room for go, and components that
   nothing leaves room between part. What is left of a family, mostly little, meets again with its texts.

The order is a heuristic that the result doesn't hang on: a bounded table has the shingles that some map task met often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import partitions, stash, trimmed
from .components import components
from .shingles import U, bitmap, mix, shingle_set, words

FLUSH = 1_500_000  # shingles that a map task signs at a time
NARROW, ALL_PAIRS = 3, 4  # ids of a tile that all go on from a map task; that are all compared with each other
FAN = 256  # members of a large tile that share one copy of its smallest
HOT = 4096  # more ids than that are never dealt to several copies
BLOCK = 512  # sets in a block of a family
BLOCKS = 64  # of a family when bitmaps meet; a large family's blocks have more sets, so that a set has no more copies


#: Bits of the table that filters texts by id.
FILTER = 1 << 26
#: Thresholds from which parts name the tiles.
STRICT = 0.85
#: Bits of an end below STRICT; sizes and places have 5 more for what their first bits leave out.
SIZE, PLACE, BEFORE = 10, 6, 38
#: Shingles that the table of frequent ones has at most: of each task, and in all.
OFTEN_TASK, OFTEN = 20_000, 262_144


class Bands:
    """Bands of sizes, each wider than linked sizes can be apart."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        ratio = max(1.5, 1.05 * den / num)
        low = [1]
        while low[-1] < 1 << 40:
            low.append(int(np.ceil(low[-1] * ratio)) if low[-1] > 1 else 2)
        self.low = np.array(low)
        k = 2 * (self.low[1:] - 1) * (den - num) // (den + num)
        self.spare = k // 12 + (k > 3)  # parts that may be empty without all the empty parts being told
        self.parts = k + 1 + self.spare
        self.strict = num >= STRICT * den

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(indices of sets, their band), for the own band and for the next where it can hold a partner."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        near = np.flatnonzero(sizes * self.den >= self.low[own + 1] * self.num)
        return [(np.arange(len(sizes)), own), (near, own[near] + 1)]


def by_parts(bands: Bands, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(tile, index of its set) for non-empty sets: the hash of each part of the shingles."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    begin, joined = np.cumsum(sizes) - sizes, np.concatenate([np.zeros(0, U), *sets])
    tiles, owners = [], []
    for at, band in bands.of(sizes):
        if not len(at):
            continue
        n = sizes[at]
        h = joined[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        m = bands.parts[band]
        part = (mix(h, 1) % np.repeat(m, n).astype(U)).astype(np.int64)
        key = (np.repeat(np.arange(len(at)), n) << 34) | part
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(h, 2)[order], first)
        who, part = key[first] >> 34, key[first] & ((1 << 34) - 1)
        # one of the parts in which linked sets agree isn't empty, unless both have more empty ones than there are to spare
        for i in np.flatnonzero(m - np.bincount(who, minlength=len(at)) > bands.spare[band]).tolist():
            empty = np.setdiff1d(np.arange(m[i]), part[who == i])
            who, part, sums = np.append(who, np.full(len(empty), i)), np.append(part, empty), np.append(sums, np.zeros(len(empty), U))
        tiles.append(mix(sums, 3) ^ mix(mix(part.astype(U), 4) + band[who].astype(U), 5))
        owners.append(at[who])
    return np.concatenate([np.zeros(0, U), *tiles]), np.concatenate([np.zeros(0, np.int64), *owners])


def signatures(bands: Bands, sets: list[np.ndarray], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(tile, index of its set, ends) for non-empty sets. often: two rows, frequent shingles sorted by hash and their ranks.
    Below STRICT, ends holds the set's size, the place of the tile's shingle in the order, and a hash of the one before it
    (0 for none), in SIZE, PLACE and BEFORE bits."""
    if bands.strict:
        return *by_parts(bands, sets), None
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not len(sizes):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    rank = np.zeros(len(h), np.int64)
    if often.shape[1]:
        at = np.minimum(np.searchsorted(often[0], h), often.shape[1] - 1)
        rank = np.where(often[0][at] == h, often[1][at].astype(np.int64), 0)
    order = np.argsort((who << 24) | rank, kind="stable")
    begin = np.cumsum(sizes) - sizes
    keep = sizes + (-bands.num * sizes // bands.den) + 1
    place = np.arange(len(h)) - np.repeat(begin, sizes)
    first = place < np.repeat(keep, sizes)
    h, who = h[order][first], who[first]
    size = sizes[who]
    before = np.concatenate([np.zeros(1, U), mix(h, 9)[:-1] >> U(64 - BEFORE)])[: len(h)]
    before = np.where(place[first] > 0, np.maximum(before, U(1)), U(0))
    end = (((coarse(size, SIZE) << PLACE + 5 | coarse(place[first], PLACE)).astype(U) << U(BEFORE)) | before).view(np.int64)
    tiles, owners, ends = [], [], []
    for at, band in bands.of(sizes):
        by = np.full(len(sizes), -1)
        by[at] = band
        mine = by[who] >= 0
        tiles.append(mix(h[mine] ^ mix(by[who[mine]].astype(U), 5), 3))
        owners.append(who[mine])
        ends.append(end[mine])
    return np.concatenate(tiles), np.concatenate(owners), np.concatenate(ends)


def width(size: int) -> int:
    """Bits of a set's bitmap: twice its size or more."""
    return 1 << max(8, int(2 * size - 1).bit_length())


def room(sizes: tuple[int, int], bits: tuple[bytes, bytes], num: int, den: int) -> bool:
    """Whether two bitmaps leave room for the overlap. The wider is folded: its positions are the narrower's modulo its width."""
    x, y = (np.frombuffer(b, U) for b in bits)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    need = -(-num * sum(sizes) // (num + den))
    return min(sizes) >= need and sizes[0] - int(np.bitwise_count(x & ~y).sum()) >= need and sizes[1] - int(np.bitwise_count(y & ~x).sum()) >= need


def frequent(df: DataFrame, n: int) -> np.ndarray:
    """Shingles that most sets of some map task have, sorted by hash, over their rank by count."""
    def met(batches):
        held, size = [], 0

        def told():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            top = np.flatnonzero(c > 2)
            top = top[np.argsort(-c[top], kind="stable")[:OFTEN_TASK]]
            return _batch([pa.array(h[top].view(np.int64)), pa.array(c[top], pa.int64())], ["h", "c"])

        seen: set = set()
        for b in batches:
            for text in b.column(0):
                if (text := text.as_py()) and (own := hash(text)) not in seen:
                    seen.add(own)
                    s = shingle_set(words(text), n)
                    held.append(s)
                    size += len(s)
                    if size > 4 * FLUSH:
                        yield told()
                        held, size, seen = [], 0, set()
        if held:
            yield told()

    top = df.select("text").mapInArrow(trimmed(met), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(OFTEN).toPandas()
    h = top.h.to_numpy(np.int64).view(U)
    by = np.argsort(h)
    ranks = (len(h) - np.arange(len(h))).astype(U)
    return np.stack([h[by], ranks[by]]) if len(h) else np.zeros((2, 0), U)


def tiles(sigs: np.ndarray, ids: np.ndarray, most: int):
    """Deals ids to tiles by signature without its lowest bit, which marks an id that stands for several. Gives the order by
    tile and id, the sorted ids, where tiles begin, each row's tile, and which tiles have more than most ids or a mark."""
    order = np.lexsort((ids, sigs >> U(1)))
    key, ids = sigs[order] >> U(1), ids[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    size = np.diff(np.append(begin, len(key)))
    wide = (size > most) | (np.maximum.reduceat(sigs[order] & U(1), begin) > 0) if len(key) else np.zeros(0, bool)
    return order, ids, begin, np.repeat(np.arange(len(begin)), size), wide


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def stars(ids, begin, at, wide) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id, other id) of the wide tiles."""
    mine = wide[at] if len(at) else np.zeros(0, bool)
    return distinct(ids[begin][at][mine] if len(at) else ids, ids[mine])


def coarse(n: np.ndarray, bits: int) -> np.ndarray:
    """Numbers with their first bits only, in bits + 5 bits: how many are left out, then those."""
    out = np.maximum(np.frexp(n.astype(np.float64))[1].astype(np.int64) - bits, 0)
    return out << bits | n >> out


def span(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest number with that code."""
    out, top = code >> bits, code & ((1 << bits) - 1)
    return top << out, (top + 1 << out) - 1


def ahead(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets with these ends can be linked if the tile's shingle is the first in order that they share; it isn't where
    both have the same one before it. A linked pair meets in the tile of that one, so what other tiles leave out is found there.
    Different shingles agree in BEFORE bits in 4 of 10^12 cases."""
    x, y = x.view(U), y.view(U)
    fresh = (x ^ y) & U((1 << BEFORE) - 1)
    alone = (x & U((1 << BEFORE) - 1)) == 0
    (low_x, most_x), (low_y, most_y) = (span((e >> U(BEFORE + PLACE + 5)).astype(np.int64), SIZE) for e in (x, y))
    place_x, place_y = (span((e >> U(BEFORE)).astype(np.int64) & ((1 << PLACE + 5) - 1), PLACE)[0] for e in (x, y))
    need = -(-num * (low_x + low_y) // (num + den))
    return (alone | (fresh != 0)) & (np.minimum(most_x - place_x, most_y - place_y) >= need)


def all_pairs(ids, at, wide, most: int, able=None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the other tiles; able, if given, tells which of two arrays of rows can be linked."""
    a, b = [], []
    for d in range(1, most):
        i = np.flatnonzero((at[d:] == at[:-d]) & ~wide[at[d:]]) if len(at) > d else np.zeros(0, np.int64)
        if able is not None:
            i = i[able(i, i + d)]
        a.append(ids[i])
        b.append(ids[i + d])
    return distinct(np.concatenate(a), np.concatenate(b))


def linked(x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray, num: int, den: int) -> bool:
    """Is den * intersection >= num * union? Bits set in one bitmap only are shingles that the other lacks."""
    need = -(-num * (len(x) + len(y)) // (num + den))
    if min(len(x), len(y)) < need or len(x) - int(np.bitwise_count(bx & ~by).sum()) < need or len(y) - int(np.bitwise_count(by & ~bx).sum()) < need:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def _batch(cols, names):
    return pa.RecordBatch.from_arrays(cols, names=names)


def _first_round(df: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Rows (kind, a, b, bits): 0 an id, its number of shingles and its bitmap, 1 a link, 2 a pair to verify, 4 one
    of a tile whose other pairs aren't here."""
    buckets, strict = 4 * partitions(df.sparkSession), num >= STRICT * den
    names = ["bucket", "kind", "a", "b", "payload"]
    often = df.sparkSession.sparkContext.broadcast(np.zeros((2, 0), U) if strict else frequent(df, n))

    def rows(kind, a, b, seed, payload=None):
        if len(a):
            bucket = (np.arange(len(a)) // 16 + seed) % buckets
            yield _batch([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(payload, pa.binary()) if payload else pa.nulls(len(a), pa.binary())], names)

    def sign(batches):
        bands, seed = Bands(num, den), 7919 * TaskContext.get().partitionId()
        ids, sets, known, links, size = [], [], {}, [], 0

        def flush():
            sigs, owner, ends = signatures(bands, sets, often.value)
            order, low, begin, at, wide = tiles(sigs & ~U(1), np.array(ids, np.int64)[owner], NARROW)
            yield from rows(4, *stars(low, begin, at, wide), seed)
            # of a wide tile only the smallest goes on, marked
            sigs = (sigs[order] & ~U(1)) | wide[at].astype(U) if len(at) else sigs
            stay = np.zeros(len(at), bool)
            stay[begin] = True
            stay |= ~wide[at] if len(at) else stay
            sigs, low = sigs[stay], low[stay]
            ends = None if ends is None else ends[order][stay]
            yield from rows(1, [x for x, _ in links], [y for _, y in links], seed)
            bucket = ((sigs >> U(1)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = [i for i in range(buckets) if cut[i] < cut[i + 1]]
            cols = [c for c in (sigs, low, ends) if c is not None]
            blobs = [b"".join(c[order[cut[i] : cut[i + 1]]].tobytes() for c in cols) for i in full]
            if full:
                yield _batch([pa.array(full, pa.int32()), pa.array([3] * len(full), pa.int32()), pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int64()), pa.array(blobs, pa.binary())], names)

        for batch in batches:
            all_ids, sizes, bits = batch.column(0).to_pylist(), [], []
            for i, text in zip(all_ids, batch.column(1)):
                s = shingle_set(words(text.as_py()), n)
                sizes.append(len(s))
                bits.append(None)
                if i is None or not len(s):
                    continue
                same = known.setdefault((len(s), int(mix(s, 21).sum()), int(mix(s, 22).sum())), i)
                if same != i:
                    links.append((same, i))
                    continue
                bits[-1] = bitmap(s, width(len(s))).tobytes()
                ids.append(i)
                sets.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield from flush()
                    ids, sets, known, links, size, seed = [], [], {}, [], 0, seed + 977
            yield from rows(0, all_ids, sizes, seed + 31, bits)
        yield from flush()

    def meet(batches):
        cols = []
        for b in batches:
            kind = b.column(1).to_numpy()
            if (kind != 3).any():
                at = np.flatnonzero(kind != 3)
                yield _batch([b.column(i).take(pa.array(at)) for i in (1, 2, 3, 4)], ["kind", "a", "b", "bits"])
            for k, blob in zip(kind.tolist(), b.column(4)):
                if k == 3:
                    cols.append(np.frombuffer(blob.as_py(), np.int64).reshape(2 if strict else 3, -1))
        if cols:
            sigs, ids, *ends = np.concatenate(cols, 1)
            order, low, begin, at, wide = tiles(sigs.view(U), ids, ALL_PAIRS)
            ends = ends[0][order] if ends else None
            able = None if strict else lambda i, j: ahead(ends[i], ends[j], num, den)
            for k, (a, b) in ((2, all_pairs(low, at, wide, ALL_PAIRS, able)), (4, stars(low, begin, at, wide))):
                for i in range(0, len(a), 100_000):
                    x, y = a[i : i + 100_000], b[i : i + 100_000]
                    yield _batch([pa.array(np.full(len(x), k, np.int32)), pa.array(x), pa.array(y), pa.nulls(len(x), pa.binary())], ["kind", "a", "b", "bits"])

    out = df.mapInArrow(trimmed(sign), "bucket int, kind int, a long, b long, payload binary")
    return out.repartition(partitions(df.sparkSession), "bucket").mapInArrow(trimmed(meet), "kind int, a long, b long, bits binary")


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with s: an a that has many is dealt to several s, so that no task gets all of its pairs. Only those with
    more than a HOT-th of all pairs are, so fewer than HOT rows are broadcast, however many pairs there are."""
    count = stash(pairs.groupBy("a").agg(F.count("*").alias("c")), "jaccard-counts")
    least = max(FAN, (count.agg(F.sum("c")).first()[0] or 0) // HOT)
    hot = count.filter(F.col("c") > least).select("a", F.ceil(F.col("c") / FAN).alias("copies"))
    return pairs.join(F.broadcast(hot), "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("copies")), F.lit(0)).alias("s"), "b")


def _plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps leave room for a link. sets has id, size and bits."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("size").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))

    def run(batches):
        for b in batches:
            keep = [room((x, y), (bx, by), num, den) for x, bx, y, by in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    dealt = _dealt(pairs)
    heads = dealt.select("a", "s").distinct().join(side("a"), "a")
    return dealt.join(heads, ["a", "s"]).join(side("b"), "b").select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(trimmed(run), "a long, b long")


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is among ids, and few others: ids set bits of a table of at most FILTER bits (8 MB), which is
    broadcast, so that texts that nothing asks for aren't shuffled."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER))
    spot = lambda d: d.withColumn("__part", F.shiftright(place, 15)).withColumn("__bit", place.bitwiseAND(32_767))
    parts = spot(ids.select("id")).groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = spot(df).join(F.broadcast(parts), "__part").filter(byte.bitwiseAND(F.pow(2, F.col("__bit") % 8).cast("int")) != 0)
    return hit.select(df.columns)


def _verify(pairs: DataFrame, df: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are linked. Members of a large tile go to several copies of its smallest."""
    dealt = _dealt(pairs)
    need = dealt.select("a", "s", F.col("b").alias("id"), F.lit(1).alias("member")).union(dealt.select("a", "s", F.col("a").alias("id"), F.lit(0).alias("member")).distinct())
    rows = need.join(_only(df, need), "id").repartition(partitions(df.sparkSession), "a", "s").sortWithinPartitions("a", "s", "member").select("a", "s", "member", "id", "text")

    def run(batches):
        key, heads = None, []
        for batch in batches:
            a, s, member, ids, texts = (c.to_pylist() for c in batch.columns)
            oa, ob = [], []
            for i in range(len(a)):
                x = shingle_set(words(texts[i]), n)
                bx = bitmap(x)
                if (a[i], s[i]) != key:
                    key, heads = (a[i], s[i]), []
                if not member[i]:
                    heads.append((x, bx))
                elif any(linked(x, y, bx, by, num, den) for y, by in heads):
                    oa.append(a[i])
                    ob.append(ids[i])
            yield _batch([pa.array(oa, pa.int64()), pa.array(ob, pa.int64())], ["a", "b"])

    return rows.mapInArrow(trimmed(run), "a long, b long")


def _named(family: DataFrame) -> DataFrame:
    """(root, family) for each root of components' families, also for those that the families are named by."""
    return family.select(F.col("node").alias("root"), F.col("root").alias("family")).union(family.select("root", F.col("root").alias("family"))).distinct()


def _mains(members: DataFrame) -> DataFrame:
    """members (id, root, family) with main: 1 in the largest component of a family."""
    largest = members.groupBy("family", "root").agg(F.count("*").alias("c")).groupBy("family").agg(F.max(F.struct("c", "root"))["root"].alias("largest"))
    return members.join(largest, "family").withColumn("main", (F.col("root") == F.col("largest")).cast("int")).select("id", "root", "family", "main")


def _meetings(sized: DataFrame, what: str, num: int, den: int, most: int | None = None) -> DataFrame:
    """Rows family, x, y, block, root, id, size, what: the sets of the blocks x and y of a family, side by side, for all blocks
    that can hold linked sets. most bounds a family's blocks, of its largest component and of the others."""
    # a histogram of sizes gives each size its first block, so no family is sorted in one place
    count = sized.groupBy("family", "main", "size").agg(F.count("*").alias("c"))
    within = Window.partitionBy("family", "main")
    ahead = F.sum("c").over(within.orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    each = F.greatest(F.lit(BLOCK), F.ceil(F.sum("c").over(within) / most)) if most else F.lit(BLOCK)
    place = count.withColumn("ahead", F.coalesce(ahead, F.lit(0))).withColumn("each", each).withColumn("first", F.floor(F.col("ahead") / F.col("each"))).withColumn("last", F.floor((F.col("ahead") + F.col("c") - 1) / F.col("each")))
    number = F.col("first") + F.pmod(F.xxhash64("id"), F.col("last") - F.col("first") + 1)
    blocks = sized.join(place.select("family", "main", "size", "first", "last"), ["family", "main", "size"]).withColumn("block", 2 * number + F.col("main"))
    spans = stash(blocks.groupBy("family", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi")), "jaccard-blocks")
    # blocks only: x meets y if their sizes can match, and never both of the largest component (odd numbers)
    two = spans.select("family", F.col("block").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi")).join(spans.select("family", F.col("block").alias("y"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi")), "family").filter(F.expr(f"x <= y and (x % 2 = 0 or y % 2 = 0) and xhi * {den} >= ylo * {num} and yhi * {den} >= xlo * {num}"))
    sides = two.select("family", F.col("x").alias("block"), "x", "y").union(two.filter("x < y").select("family", F.col("y").alias("block"), "x", "y"))
    rows = blocks.select("family", "block", "root", "id", "size", what).join(sides, ["family", "block"]).repartition(partitions(sized.sparkSession), "family", "x", "y")
    return rows.sortWithinPartitions("family", "x", "y").select("family", "x", "y", "block", "root", "id", "size", what)


def _groups(batches):
    """(whether a block meets itself, its rows (id, root, block, size, what)) of the rows that _meetings gives."""
    key, group = None, []
    for batch in batches:
        for family, x, y, block, r, i, size, what in zip(*(c.to_pylist() for c in batch.columns)):
            if (family, x, y) != key:
                if group:
                    yield key[1] == key[2], group
                key, group = (family, x, y), []
            group.append((i, r, block, size, what))
    if group:
        yield key[1] == key[2], group


def by_width(rows: list) -> dict[int, tuple[np.ndarray, ...]]:
    """ids, roots, sizes and bitmaps of rows (id, root, block, size, bits), by the bitmaps' bytes, each in order of size."""
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r[3]):
        out.setdefault(len(r[4]), []).append(r)
    return {w: (*(np.array([r[k] for r in rs], np.int64) for k in (0, 1, 3)), np.frombuffer(b"".join(r[4] for r in rs), U).reshape(len(rs), -1)) for w, rs in out.items()}


def near(group: list, own: bool, num: int, den: int) -> tuple[list[tuple[int, int]], set[int]]:
    """(a forest of the roots between whose sets bitmaps leave room for a link, the ids of such sets). A block meets itself
    (own) or the other one of the group; the wider bitmaps are folded."""
    found: dict[int, int] = {}

    def root(x):
        while found.get(x, x) != x:
            x = found[x]
        return x

    edges, ids = [], set()
    left = by_width(group if own else [g for g in group if g[2] == group[0][2]])
    right = left if own else by_width([g for g in group if g[2] != group[0][2]])
    for w, (ids_x, roots_x, sizes_x, bits_x) in left.items():
        for v, (ids_y, roots_y, sizes_y, bits_y) in right.items():
            if own and v < w:
                continue
            x, y = bits_x, bits_y
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
            low = np.searchsorted(sizes_y, -(-num * sizes_x // den), "left")
            high = np.searchsorted(sizes_y, den * sizes_x // num, "right")
            for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
                a = max(a, i + 1) if own and v == w else a
                if a >= b:
                    continue
                need = -(-num * (sizes_y[a:b] + sizes_x[i]) // (num + den))
                fits = (roots_y[a:b] != roots_x[i]) & (sizes_x[i] - np.bitwise_count(x[i] & ~y[a:b]).sum(1, dtype=np.int64) >= need)
                at = a + np.flatnonzero(fits)
                if len(at):
                    at = at[sizes_y[at] - np.bitwise_count(y[at] & ~x[i]).sum(1, dtype=np.int64) >= need[at - a]]
                if len(at):
                    ids.add(int(ids_x[i]))
                    ids.update(ids_y[at].tolist())
                    for r in np.unique(roots_y[at]).tolist():
                        if (p := root(int(roots_x[i]))) != (q := root(r)):
                            found[max(p, q)] = min(p, q)
                            edges.append((int(roots_x[i]), r))
    return edges, ids


def _near(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (kind, a, b): 0 two roots of a family between whose sets bitmaps leave room for a link, as far as it takes to
    connect all such roots, 1 the id of such a set. members has id, root, family and main; sets has id, size and bits."""
    sized = stash(members.join(sets, "id").select("family", "root", "main", "id", "size", "bits"), "jaccard-family")

    def run(batches):
        for own, group in _groups(batches):
            edges, ids = near(group, own, num, den)
            if edges:
                kind = pa.array([0] * len(edges) + [1] * len(ids), pa.int32())
                yield _batch([kind, pa.array([*(a for a, _ in edges), *ids], pa.int64()), pa.array([*(b for _, b in edges), *[None] * len(ids)], pa.int64())], ["kind", "a", "b"])

    return _meetings(sized, "bits", num, den, BLOCKS).mapInArrow(trimmed(run), "kind int, a long, b long")


def _families(members: DataFrame, df: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between components of a family: members has id, root, family and main (1 in its largest component)."""
    def measure(batches):
        for b in batches:
            sizes = [len(shingle_set(words(t), n)) for t in b.column(4).to_pylist()]
            yield _batch([*b.columns, pa.array(sizes, pa.int64())], ["family", "root", "main", "id", "text", "size"])

    sized = stash(members.join(_only(df, members), "id").select("family", "root", "main", "id", "text").mapInArrow(trimmed(measure), "family long, root long, main int, id long, text string, size long"), "jaccard-family")

    def compare(group, own):
        ids, roots, side = np.array([g[0] for g in group]), np.array([g[1] for g in group]), np.array([g[2] for g in group])
        sets = [shingle_set(words(g[4]), n) for g in group]
        bits, sizes = np.array([bitmap(s) for s in sets]), np.fromiter(map(len, sets), np.int64, len(sets))
        found = {}

        def root(x):
            while found.get(x, x) != x:
                x = found[x]
            return x

        out = []
        for i in range(len(ids)):
            j = np.flatnonzero((roots != roots[i]) & ((np.arange(len(ids)) > i) if own else (side != side[i]) & (side[i] == side.min())))
            if not len(j):
                continue
            need = -(-num * (sizes[j] + sizes[i]) // (num + den))
            lack = np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64)
            more = np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64)
            for k in j[(sizes[i] - lack >= need) & (sizes[j] - more >= need)].tolist():
                if (x := root(int(roots[i]))) != (y := root(int(roots[k]))) and linked(sets[i], sets[k], bits[i], bits[k], num, den):
                    found[max(x, y)] = min(x, y)
                    out.append((int(ids[i]), int(ids[k])))
        return out

    def run(batches):
        for own, group in _groups(batches):
            out = compare(group, own)
            yield _batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return _meetings(sized, "text", num, den).mapInArrow(trimmed(run), "a long, b long")


def jaccard_components(df: DataFrame, num: int, den: int, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, component_id. Two documents link when den * intersection >= num * union
    of their sets of n-word shingles; component_id is the smallest doc_id reachable by links, itself included.

    A text without words, or null, has no shingles and links with nothing. A row without id links with nothing and its
    component is null. Rows with the same id are one document: a link of any of them is its link. Other columns of df play
    no part. An empty table gives an empty result."""
    src = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = src.filter("id is not null and text is not null")
    got = stash(_first_round(src, n, num, den), "jaccard-first")
    sure = got.filter("kind = 1").select("a", "b")
    pairs = stash(got.filter("kind in (2, 4)").groupBy("a", "b").agg(F.max("kind").alias("kind")), "jaccard-pairs")
    sets = got.filter("kind = 0 and bits is not null").select(F.col("a").alias("id"), F.col("b").alias("size"), "bits")
    likely = stash(_plausible(pairs.select("a", "b"), sets, num, den), "jaccard-likely")
    links = stash(sure.union(_verify(likely, texts, n, num, den)), "jaccard-links")
    root = components(links)
    named = pairs.filter("kind = 4").select("a", "b").join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    apart = named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
    family = components(apart, "jaccard-families")
    if not family.isEmpty():
        family = _named(family)
        inside = root.select(F.col("node").alias("id"), "root").union(family.select(F.col("root").alias("id"), "root"))
        # a copy of a set that is compared anyway need not be compared again
        copies = sure.select(F.col("b").alias("id")).distinct()
        members = stash(family.join(inside, "root").select("id", "root", "family").distinct().join(copies, "id", "left_anti"), "jaccard-members")
        close = stash(_near(_mains(members), sets, num, den), "jaccard-near")
        family = components(close.filter("kind = 0").select("a", "b"), "jaccard-families")
        if not family.isEmpty():
            members = members.select("id", "root").join(close.filter("kind = 1").select(F.col("a").alias("id")).distinct(), "id", "left_semi")
            members = stash(members.join(_named(family), "root").select("id", "root", "family").distinct(), "jaccard-members")
            links = stash(links.union(_families(_mains(members), texts, n, num, den)), "jaccard-links")
            root = components(links)
    docs = got.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    return docs.join(root, docs.doc_id == root.node, "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
