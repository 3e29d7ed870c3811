"""Operator 7: token counts that follow edits, by a segment tree over each document's pre-tokens.

A tree is kept in columns beside its document: its leaves' texts, lengths and counts, and the leaves' sums, from which the
inner nodes follow. An edit finds its place by descending, reads the few leaves around it, and writes those back; the other
leaves pass through as the bytes that they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Encoder, blocks, boundaries, encoder
from .common import stash, with_columns

LEAF = 128  # pre-tokens in a leaf when a tree is built
WINDOW = 96  # bytes after an edit that are looked at first
#: What a node sums: bytes, characters, tokens, pre-tokens.
BYTES, CHARS, TOKENS, PIECES = range(4)
#: The columns of a tree.
TREE = [T.StructField(c, T.ArrayType(T.BinaryType())) for c in ("tree_texts", "tree_lengths", "tree_counts")] + [T.StructField("tree_sums", T.BinaryType())]


def characters(text: bytes) -> int:
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


class Tree:
    """Leaves hold the text of consecutive pre-tokens, their lengths in bytes and their token counts; nodes hold sums."""

    def __init__(self, leaves: list, sums: np.ndarray):
        n = max(1, len(leaves))
        self.width = 1 << (n - 1).bit_length()
        empty = (b"", np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        self.leaves = leaves + [empty] * (self.width - len(leaves))
        self.sums = np.zeros((2 * self.width, 4), np.int64)
        self.sums[self.width : self.width + len(leaves)] = sums
        w = self.width
        while w > 1:
            self.sums[w // 2 : w] = self.sums[w : 2 * w].reshape(-1, 2, 4).sum(1)
            w //= 2

    @classmethod
    def of(cls, text: bytes, lengths: np.ndarray, counts: np.ndarray) -> Tree:
        first = np.arange(0, len(lengths), LEAF)
        sums = np.zeros((len(first), 4), np.int64)
        if not len(first):
            return cls([], sums)
        # a leaf's numbers are cut from the whole's bytes, as load gets them; its sums are taken for all leaves at once
        own, n = lengths.astype("<u4").tobytes(), counts.astype("<u4").tobytes()
        sums[:, BYTES] = np.add.reduceat(lengths, first, dtype=np.int64)
        ends = np.cumsum(sums[:, BYTES])
        starts = ends - sums[:, BYTES]
        sums[:, CHARS] = np.add.reduceat((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, starts, dtype=np.int64)
        sums[:, TOKENS] = np.add.reduceat(counts, first, dtype=np.int64)
        sums[:, PIECES] = np.diff(np.append(first, len(lengths)))
        return cls([(text[a:b], own[i : i + 4 * LEAF], n[i : i + 4 * LEAF]) for a, b, i in zip(starts.tolist(), ends.tolist(), range(0, 4 * len(lengths), 4 * LEAF))], sums)

    @classmethod
    def load(cls, texts: list, lengths: list, counts: list, sums: bytes) -> Tree:
        """A kept tree; its leaves stay as they are stored until an edit reads them."""
        return cls(list(zip(texts, lengths, counts)), np.frombuffer(sums, "<i8").reshape(-1, 4))

    def store(self) -> tuple[list, list, list, bytes]:
        n = int(np.flatnonzero(self.sums[self.width :, PIECES])[-1]) + 1 if self.sums[1, PIECES] else 0
        raw = lambda x: x if isinstance(x, bytes) else x.astype("<u4").tobytes()
        return [x[0] for x in self.leaves[:n]], [raw(x[1]) for x in self.leaves[:n]], [raw(x[2]) for x in self.leaves[:n]], self.sums[self.width : self.width + n].astype("<i8").tobytes()

    def leaf(self, i: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        text, lengths, counts = self.leaves[i]
        if isinstance(lengths, bytes):
            self.leaves[i] = text, lengths, counts = text, np.frombuffer(lengths, "<u4"), np.frombuffer(counts, "<u4")
        return text, lengths, counts

    def total(self) -> int:
        return int(self.sums[1, TOKENS])

    def size(self) -> int:
        return int(self.sums[1, BYTES])

    def _descend(self, what: int, place: int) -> int:
        """The leaf that holds a byte or a character."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.sums[node, what]:
                start += int(self.sums[node, what])
                node += 1
        return node - self.width

    def before_leaf(self, leaf: int, what: int) -> int:
        """The sum over all leaves before one, by climbing."""
        node, out = self.width + leaf, 0
        while node > 1:
            if node & 1:
                out += int(self.sums[node - 1, what])
            node >>= 1
        return out

    def byte_of(self, char: int) -> int:
        """The byte where a character begins; the end for what lies beyond."""
        if char >= self.sums[1, CHARS]:
            return self.size()
        leaf = self._descend(CHARS, char)
        own = self.leaf(leaf)[0].decode()[: char - self.before_leaf(leaf, CHARS)]
        return self.before_leaf(leaf, BYTES) + len(own.encode())

    def find(self, byte: int) -> tuple[int, int]:
        """(leaf, pre-token in it) that holds a byte; the last one for the end."""
        byte = min(byte, self.size() - 1)
        leaf = self._descend(BYTES, byte)
        ends = self.before_leaf(leaf, BYTES) + np.cumsum(self.leaf(leaf)[1], dtype=np.int64)
        return leaf, int(np.searchsorted(ends, byte, "right"))

    def read(self, first: int, end: int) -> bytes:
        """Bytes of the text, from the leaves that have them."""
        out, leaf = [], self._descend(BYTES, first) if first < end else self.width
        at = self.before_leaf(leaf, BYTES) if leaf < self.width else end
        while at < end:
            text = self.leaves[leaf][0]
            out.append(text[max(0, first - at) : end - at])
            at, leaf = at + len(text), leaf + 1
        return b"".join(out)

    def before(self, leaf: int, k: int) -> tuple[int, int]:
        """The pre-token before one, or that one itself if it is the first."""
        if k:
            return leaf, k - 1
        pieces = self.before_leaf(leaf, PIECES)
        if not pieces:
            return leaf, k
        leaf = self._descend(PIECES, pieces - 1)
        return leaf, int(self.sums[self.width + leaf, PIECES]) - 1

    def from_(self, leaf: int, k: int):
        """Lengths of the pre-tokens from one on, a leaf at a time."""
        for i in range(leaf, self.width):
            got = self.leaf(i)[1][k:]
            k = 0
            if len(got):
                yield got.astype(np.int64)

    def splice(self, leaf: int, k: int, removed: int, text: bytes, lengths: np.ndarray, counts: np.ndarray) -> None:
        """Replace so many pre-tokens from (leaf, k) on and bring the sums above up to date."""
        touched, left, i, at = {leaf}, removed, leaf, k
        t, ls, cs = self.leaf(leaf)
        head = t[: int(ls[:k].sum())], ls[:k], cs[:k]
        tail = b"", ls[:0], cs[:0]
        while True:
            t, ls, cs = self.leaf(i)
            take = min(left, len(ls) - at)
            tail = t[int(ls[: at + take].sum()) :], ls[at + take :], cs[at + take :]
            left -= take
            touched.add(i)
            if not left:
                break
            self.leaves[i] = b"", ls[:0], cs[:0]
            i, at = i + 1, 0
        if i != leaf:
            self.leaves[i] = tail
            tail = b"", lengths[:0], counts[:0]
        join = lambda j, x: np.concatenate([head[j], x, tail[j]]).astype(np.uint32)
        self.leaves[leaf] = head[0] + text + tail[0], join(1, lengths), join(2, counts)
        if len(self.leaves[leaf][1]) > 8 * LEAF:  # a long insertion: its leaf is cut anew
            every = [self.leaf(x) for x in range(self.width)]
            new = Tree.of(b"".join(x[0] for x in every), np.concatenate([x[1] for x in every]), np.concatenate([x[2] for x in every]))
            self.width, self.leaves, self.sums = new.width, new.leaves, new.sums
            return
        for x in touched:
            t, ls, cs = self.leaf(x)
            self.sums[self.width + x] = len(t), characters(t), int(cs.sum()), len(ls)
        for node in sorted({(self.width + x) >> up for x in touched for up in range(1, self.width.bit_length())} - {0}, reverse=True):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


def trees(enc: Encoder, texts: list[str]) -> list[Tree]:
    lengths, counts = [[] for _ in texts], [[] for _ in texts]
    for owners, parts in blocks(texts):
        words, starts, per_text = enc.pieces(parts)
        n = enc.counts(words) if words else np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for o, a, b in zip(owners, per_text[:-1].tolist(), per_text[1:].tolist()):
            lengths[o].append(size[a:b])
            counts[o].append(n[a:b])
    none = [np.zeros(0, np.int64)]
    return [Tree.of(t.encode(), np.concatenate(ls or none), np.concatenate(cs or none)) for t, ls, cs in zip(texts, lengths, counts)]


def edit(enc: Encoder, forest: list[Tree], edits: list[tuple[int, int, str] | None]) -> list[int]:
    """Apply one edit (first byte, byte after the last, new text) to each tree; the numbers of pre-tokens encoded again.

    A pre-token is decided by at most two characters after it, so matching starts one pre-token before the one that holds
    the byte before the edit. It goes on to the first start after the edit that was one before; from there on nothing
    changes. All trees' windows are matched together, and those that find no such start get twice the window."""
    again, todo, window = [0] * len(forest), [], WINDOW
    for i, (t, e) in enumerate(zip(forest, edits)):
        if e is None:
            continue
        a, b, new = e[0], e[1], e[2].encode()
        leaf = k = begin = 0
        if t.size():
            leaf, k = t.before(*t.find(max(0, a - 1)))
            begin = t.before_leaf(leaf, BYTES) + int(t.leaf(leaf)[1][:k].sum())
        todo.append((i, leaf, k, begin, t.read(begin, a) + new, b))
    while todo:
        parts, later = [], []
        for i, _, _, _, head, b in todo:
            t = forest[i]
            stop = min(t.size(), b + window)
            while stop < t.size() and t.read(stop, stop + 1)[0] & 0xC0 == 0x80:
                stop += 1
            parts.append((stop, head + t.read(b, stop)))
        data, starts, per = boundaries([p.decode() for _, p in parts])
        base, found, words = 0, [], []
        for n, (item, (stop, raw)) in enumerate(zip(todo, parts)):
            i, leaf, k, begin, head, b = item
            t, size, shift = forest[i], len(raw), b - len(head)  # a place of the part and shift make the place before
            own = starts[per[n] : per[n + 1]] - base
            base += size
            whole = stop == t.size()
            # near the window's end a start may still hang on what follows
            sure = own if whole else own[own <= size - 12]
            fresh = set((sure[sure >= len(head)] + shift).tolist())
            removed, at, hit, cut = 0, begin, -1, len(own)
            for ls in t.from_(leaf, k) if t.size() else ():
                ends = at + np.cumsum(ls)
                hit, j = next(((x, j) for j, x in enumerate([at, *ends[:-1].tolist()]) if x in fresh), (-1, 0))
                if hit >= 0:
                    removed += j
                    break
                removed, at = removed + len(ls), int(ends[-1])
                if at > stop:
                    break
            if hit >= 0:
                cut = int(np.searchsorted(own, hit - shift))
            elif not whole:
                later.append(item)
                continue
            bounds = np.append(own[:cut], own[cut] if cut < len(own) else size)
            words += [raw[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            found.append((i, leaf, k, removed, raw[: int(bounds[-1])], np.diff(bounds)))
        # the words of all trees are encoded together: a pass over a few costs about what one over thousands does
        counts, at = enc.counts(words) if words else np.zeros(0, np.int64), 0
        for i, leaf, k, removed, raw, lengths in found:
            again[i] = len(lengths)
            forest[i].splice(leaf, k, removed, raw, lengths, counts[at : at + len(lengths)])
            at += len(lengths)
        todo, window = later, window * 2
    return again


def _columns(forest: list[Tree]) -> list[pa.Array]:
    kept = [t.store() for t in forest]
    return [pa.array([x[j] for x in kept], pa.list_(pa.binary())) for j in range(3)] + [pa.array([x[3] for x in kept], pa.binary())]


def build(df: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """Adds the columns of TREE, and n_tokens and n_pretokens. A null text counts as empty and has no leaves. Rows are
    independent; columns of these names are replaced."""

    def run(cols):
        forest = trees(encoder(ranks_path), [t or "" for t in cols[0].to_pylist()])
        return [*_columns(forest), *(pa.array([int(t.sums[1, x]) for t in forest], pa.int64()) for x in (TOKENS, PIECES))]

    return with_columns(df, [text], run, [*TREE, *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_pretokens"))])


def apply(df: DataFrame, ranks_path: str, edits: str = "edits") -> DataFrame:
    """Brings the columns of TREE up to date with edits, an array of structs (first character, characters removed, new text)
    that apply one after the other, each to what the last left, and adds n_tokens_after and n_reencoded. Null edits count as
    none, a null new text as empty, and places beyond the text as its end. The text isn't needed: the leaves have it."""

    def run(cols):
        enc, wanted = encoder(ranks_path), [[e for e in x or [] if e] for x in cols[4].to_pylist()]
        forest = [Tree.load(*kept) for kept in zip(*(c.to_pylist() for c in cols[:4]))]
        done = [0] * len(forest)
        for r in range(max(map(len, wanted), default=0)):
            step = []
            for t, es in zip(forest, wanted):
                if r >= len(es):
                    step.append(None)
                    continue
                first, removed, new = es[r].values()
                first = max(0, first or 0)
                step.append((t.byte_of(first), t.byte_of(first + max(0, removed or 0)), new or ""))
            done = [x + y for x, y in zip(done, edit(enc, forest, step))]
        return [*_columns(forest), pa.array([t.total() for t in forest], pa.int64()), pa.array(done, pa.int64())]

    return with_columns(df, [f.name for f in TREE] + [edits], run, [*TREE, *(T.StructField(c, T.LongType()) for c in ("n_tokens_after", "n_reencoded"))])


def count_edits(df: DataFrame, ranks_path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Adds n_tokens, n_tokens_after, n_pretokens and n_reencoded for texts under their edits: the trees are built and written,
    and the edits applied to what was written. Nulls, places beyond a text and repeated rows are as in build and apply. The
    trees go on as columns; columns of these names are replaced."""
    return apply(stash(build(df, ranks_path, text).drop(text), "token-trees"), ranks_path, edits)
