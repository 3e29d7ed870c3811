"""Operator 5: lexical retrieval packing. Each shard holds a BM25 inverted index; seeds fill their windows with neighbours."""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import chunks
from .common import stash, tree_sum

#: The pattern that splits text before the merges; the tokenizer's own (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
K1, B = 1.2, 0.75
#: The rarest terms of a seed that its query has, and the neighbours that it gets at a time.
TERMS, NEIGHBOURS = 16, 24
#: Documents in a shard's index, at most.
SHARD = 6000

_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The tokenizer of a .json file as the tokenizers library loads it, its special tokens' strings in a text included. Where
    a rank file of the same name and vocabulary lies beside it, and no special token takes white space around it, tiktoken
    reads that instead: the ids are the same and come several times as fast."""
    if path not in _TOKENIZERS:
        ranks = path.removesuffix(".json") + ".tiktoken"
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        plain = all(t["special"] and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added)
        if plain and os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={t["content"]: t["id"] for t in added})
            _TOKENIZERS[path] = lambda texts: [enc.encode(t, allowed_special="all") for t in texts]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _TOKENIZERS[path] = lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    return _TOKENIZERS[path]


class Shard:
    """An inverted index over some documents; df and mean length are the whole corpus's."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n, self.idf = len(docs), idf
        terms, who, tf = [], [], []
        for i, d in enumerate(docs):
            t, c = np.unique(d, return_counts=True)
            terms.append(t)
            who.append(np.full(len(t), i, np.int32))
            tf.append(c)
        self.terms = terms
        term, who, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, who, tf))
        lens = np.fromiter(map(len, docs), np.float64, self.n)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[who] / max(mean, 1)))
        order = np.argsort(term, kind="stable")
        self.who, self.weight = who[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def near(self, seed: int, unused: np.ndarray, k: int = NEIGHBOURS) -> list[int]:
        """Unused documents by BM25 score for the seed's rarest terms that others have too, best first, ties to the first."""
        t = self.terms[seed]
        t = t[self.begin[t + 1] - self.begin[t] > 1]
        if len(t) > TERMS:
            t = t[np.argsort(-self.idf[t], kind="stable")[:TERMS]]
        spans = [slice(self.begin[x], self.begin[x + 1]) for x in t.tolist()]
        if not spans:
            return []
        score = np.bincount(np.concatenate([self.who[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        if len(found) > 4 * k:
            found = found[np.argpartition(-score[found], 4 * k)[: 4 * k]]
        return found[np.argsort(-score[found], kind="stable")][:k].tolist()


def fill(lengths: list[int], shard: Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length): each id in exactly one piece, each sequence of exactly window ids but
    for the last ids of the shard, which go to sequences whose lengths are powers of two and so need no padding either."""
    out, at = [], [0] * len(lengths)
    for i, n in enumerate(lengths):  # whole windows of long documents stand alone
        while n - at[i] >= window:
            out.append([(i, at[i], window)])
            at[i] += window
    left = np.array([n - a for n, a in zip(lengths, at)], np.int64)
    unused = left > 0
    order = np.argsort(-left, kind="stable").tolist()
    first = 0
    rest: list[tuple[int, int, int]] = []

    def take(seq, i, room):
        n = min(int(left[i]), room)
        seq.append((i, at[i], n))
        at[i] += n
        left[i] -= n
        unused[i] = left[i] > 0
        return room - n

    while True:
        while first < len(order) and not unused[order[first]]:
            first += 1
        if first == len(order):
            break
        seq: list[tuple[int, int, int]] = []
        seed = order[first]
        room = take(seq, seed, window)
        while room:
            near = shard.near(seed, unused)
            for i in near:  # whole neighbours first, best first; then the best one is cut
                if unused[i] and left[i] <= room:
                    room = take(seq, i, room)
            cut = next((i for i in near if unused[i]), None)
            if room and cut is None:  # no neighbour is left; the next document seeds the rest of the window
                while first < len(order) and not unused[order[first]]:
                    first += 1
                if first == len(order):
                    break
                cut = seed = order[first]
            if room and cut is not None:
                room = take(seq, cut, room)
        if room == 0:
            out.append(seq)
        else:
            rest = seq
    size = window
    while rest:
        size //= 2
        have = sum(n for _, _, n in rest)
        if have < size:
            continue
        seq, room = [], size
        while room:
            i, a, n = rest.pop(0)
            seq.append((i, a, min(n, room)))
            if n > room:
                rest.insert(0, (i, a + room, n - room))
            room -= min(n, room)
        out.append(seq)
    return out


def pack(df: DataFrame, tokenizer_path: str, vocabulary: int, window: int = 1024, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are its text's and then end; a null text counts as empty and has end alone. Documents are rows: rows
    with a repeated or null doc_id are packed each for itself, and keep that id. Other columns play no part. An empty table
    gives no pieces. The ids are written to the shared folder once; each written partition is a shard or, if it has many
    documents, several. Document frequencies and the mean length are counted over all documents, in a vector with one entry
    for each id of the vocabulary, and that vector is all that the driver gets."""
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def tokenise(batches):
        encode = tokenizer(tokenizer_path)
        for b in batches:
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for i, j in chunks(texts):
                out += [np.array([*ids, end], "<u4").tobytes() for ids in encode(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    docs = stash(src.mapInArrow(tokenise, "doc_id long, ids binary"), "packing-ids")

    def count(batches):
        v = np.zeros(vocabulary + 2, np.int64)
        for b in batches:
            for ids in b.column(1).to_pylist():
                ids = np.frombuffer(ids, "<u4")
                v[np.unique(ids)] += 1
                v[-2:] += 1, len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], names=["v"])

    v = tree_sum(docs.mapInArrow(count, "v binary"), vocabulary + 2)
    n, mean = int(v[-2]), int(v[-1]) / max(1, int(v[-2]))
    idf = df.sparkSession.sparkContext.broadcast(np.log1p((n - v[:-2] + 0.5) / (v[:-2] + 0.5)))

    def run(batches):
        task, sequence = TaskContext.get().partitionId(), 0
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def done(ids, docs):
            nonlocal sequence
            cols: list[list] = [[] for _ in names]
            for seq in fill(list(map(len, docs)), Shard(docs, idf.value, mean), window):
                offset = 0
                for i, start, length in seq:
                    for c, x in zip(cols, (ids[i], start, length, docs[i][start : start + length].tobytes(), len(docs[i]), (task << 40) + sequence, offset)):
                        c.append(x)
                    offset += length
                sequence += 1
            kinds = [pa.binary() if c == "ids" else pa.int64() for c in names]
            for i in range(0, len(cols[0]), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 5000], k) for c, k in zip(cols, kinds)], names=names)

        ids, docs = [], []
        for b in batches:
            for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                docs.append(np.frombuffer(d, "<u4"))
                if len(docs) == SHARD:
                    yield from done(ids, docs)
                    ids, docs = [], []
        yield from done(ids, docs)

    return docs.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
