"""Byte-level BPE without regex: codepoint classes, an associative scan of transition functions, cached pair merging."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

#: White space as Unicode's White_Space property has it (fixed values).
WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_WHITE = frozenset(WHITE)

L, N, O, AP0, AP1, AP2, SP_MID, SP_LAST, WS_MID, WS_LAST = range(10)
# States: what the token that holds the previous character still accepts.
IN_L, IN_N, IN_O, SPACE_OPEN, IN_WS, NEED1, NEED2, CLOSED = range(8)
BLOCK = 128
#: The rank of a pair that makes no token.
NONE = 1 << 60
#: Bytes of a pre-token up to which pre-tokens are merged side by side.
SIDE = 32
#: Pre-tokens of like length from which on a pass side by side costs less than one by one.
FEW = 256
#: Pre-tokens a worker remembers: the first that it meets, so the frequent ones, and no more, so that its memory is bounded.
CACHE = 300_000
#: Characters that are split at a time; a longer text is cut where a token is sure to start.
MOST = 262_144


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, O, np.uint8)
    for cp in range(0x110000):
        k = unicodedata.category(chr(cp))[0]
        if k == "L":
            out[cp] = L
        elif k == "N":
            out[cp] = N
    out[WHITE] = WS_MID
    out[32] = SP_MID
    out[39] = AP0
    return out


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a token start here), by symbol and state. Symbols from 10 on are the same at the start of a text."""
    step, start = np.zeros((20, 8), np.uint8), np.zeros((20, 8), bool)
    for sym in range(10):
        for state in range(8):
            fresh, to = True, CLOSED
            if state == NEED2:
                fresh, to = False, NEED1
            elif state == NEED1:
                fresh, to = False, CLOSED
            elif sym in (L, N):
                to = IN_L if sym == L else IN_N
                fresh = state not in (to, SPACE_OPEN)
            elif sym in (O, AP0, AP1, AP2):
                joins = state in (IN_O, SPACE_OPEN)
                fresh, to = not joins, IN_O if joins or sym in (O, AP0) else NEED1 if sym == AP1 else NEED2
            elif sym in (SP_MID, WS_MID):
                fresh, to = state != IN_WS, IN_WS
            else:
                to = SPACE_OPEN if sym == SP_LAST else CLOSED
            step[sym, state], start[sym, state] = to, fresh
    step[10:], start[10:] = step[:10, CLOSED, None], True
    return step, start


def scan(symbols: np.ndarray) -> np.ndarray:
    """Where tokens start. Transition functions compose associatively: blocks are folded side by side, their functions are
    combined by doubling, and each block is then replayed from the state that reaches it."""
    step, start = _machine()
    n = len(symbols)
    if n == 0:
        return np.zeros(0, bool)
    flat = step.ravel()
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint8)
    padded[:n] = symbols
    by_col = np.ascontiguousarray(padded.reshape(rows, BLOCK).T) * np.uint8(8)  # 20 symbols by 8 states fit a byte
    f = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for j in range(BLOCK):
        f = flat[by_col[j][:, None] + f]
    gap = 1
    while gap < rows:  # inclusive scan: f[i] becomes f[i] after f[i - gap]
        later = np.take_along_axis(f[gap:], f[:-gap].astype(np.int64), 1)
        f = np.concatenate([f[:gap], later])
        gap *= 2
    state = np.full(rows, CLOSED, np.uint8)
    state[1:] = f[:-1, CLOSED]
    out = np.empty((BLOCK, rows), bool)
    sflat = start.ravel()
    for j in range(BLOCK):
        at = by_col[j] + state
        out[j] = sflat[at]
        state = flat[at]
    return out.T.ravel()[:n]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all texts in UTF-8, byte offset where each pre-token starts, pre-tokens before each text, with the total last)."""
    joined = "".join(texts)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(lens)])
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(cps)
    if n == 0:
        return b"", np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    sym = _classes()[cps]
    first = np.zeros(n + 1, bool)
    first[at] = True  # also at the very end
    white = (sym == SP_MID) | (sym == WS_MID)
    last = np.zeros(n, bool)
    last[:-1] = ~white[1:]
    last &= white & ~first[1:]
    sym = sym + last.astype(np.uint8)
    for i in np.flatnonzero(sym == AP0).tolist():
        if i + 1 < n and not first[i + 1]:
            a = cps[i + 1]
            if a in (115, 116, 109, 100):
                sym[i] = AP1
            elif i + 2 < n and not first[i + 2] and (a, cps[i + 2]) in ((114, 101), (118, 101), (108, 108)):
                sym[i] = AP2
    sym = sym + 10 * first[:n].astype(np.uint8)
    starts = np.flatnonzero(scan(sym))
    width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    return joined.encode(), byte_at[starts], np.searchsorted(starts, at)


class Encoder:
    """Encodes as the rank file's own library would, without special tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for k, v in self.ranks.items():
            by_id[v] = k
        self.width = np.fromiter(map(len, by_id), np.int64, size)
        self.begin = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        every = [self.ranks.get(bytes([b])) for b in range(256)]
        self.single = None if None in every else np.array(every, np.int64)
        self._pairs()
        self._reset()

    def _pairs(self) -> None:
        """The pairs of tokens that join to a token, as a table of slots by hash; a slot that is taken passes on to the next."""
        ranks = self.ranks
        got = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, ids = np.array([k for k, _ in got], np.int64), np.array([r for _, r in got], np.int64)
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.pair, self.joint, self.steps = np.full(size, -1, np.int64), np.full(size, NONE), 0
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.pair[at[left]] < 0
            self.pair[at[left[free]]] = keys[left[free]]  # of several the last has it
            here = self.pair[at[left]] == keys[left]
            self.joint[at[left[here]]] = ids[left[here]]
            left = left[~here]
            at[left] = at[left] + 1 & size - 1
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that a and b make, or NONE."""
        keys = a << 32 | b
        at = self._slot(keys)
        out = np.where(self.pair[at] == keys, self.joint[at], NONE)
        left = np.flatnonzero((out == NONE) & (self.pair[at] >= 0))
        for _ in range(1, self.steps):
            if not len(left):
                break
            at[left] = at[left] + 1 & len(self.pair) - 1
            out[left] = np.where(self.pair[at[left]] == keys[left], self.joint[at[left]], NONE)
            left = left[(out[left] == NONE) & (self.pair[at[left]] >= 0)]
        return out

    def _merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids in each): merge for words of 2 to SIDE bytes side by side, a step of each word at a time."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(n.max())
        inside = np.arange(wide) < n[:, None]
        ids = np.zeros((len(words), wide), np.int64)
        ids[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), wide), NONE)  # of the pair that begins here
        both = inside[:, 1:]
        rank[:, :-1][both] = self._join(ids[:, :-1][both], ids[:, 1:][both])
        todo, place = np.arange(len(words)), np.arange(wide)
        while len(todo):
            i = rank[todo].argmin(1)  # the leftmost of the least
            best = rank[todo, i]
            more = best < NONE
            todo, i, best = todo[more], i[more], best[more]
            if not len(todo):
                break
            # the rest moves up by one
            take = np.minimum(place + (place > i[:, None]), wide - 1)
            ids[todo] = np.take_along_axis(ids[todo], take, 1)
            rank[todo] = np.take_along_axis(rank[todo], take, 1)
            rank[todo, -1] = NONE
            ids[todo, i] = best
            n[todo] -= 1
            right = i + 1 < n[todo]
            rank[todo, i] = NONE
            left = i > 0
            r, rc, l, lc = todo[right], i[right], todo[left], i[left] - 1
            got = self._join(np.concatenate([best[right], ids[l, lc]]), np.concatenate([ids[r, rc + 1], best[left]]))
            rank[r, rc], rank[l, lc] = got[: len(r)], got[len(r) :]
        return ids[place < n[:, None]], n

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids in each) by merge; words of like length are taken together."""
        tokens, by = [], {}
        for k, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                by.setdefault(0, []).append(k)
                tokens.append(r)
            elif len(w) > SIDE or self.single is None:
                by.setdefault(-1, []).append(k)
            else:
                by.setdefault(-(-len(w) // 4), []).append(k)
        whole, slow = by.pop(0, []), by.pop(-1, [])
        for size in [x for x, which in by.items() if len(which) < FEW]:
            slow += by.pop(size)
        long = [self.merge(words[k]) for k in slow]
        # (places of words, their ids, ids in each)
        parts = [(whole, tokens, [1] * len(whole)), (slow, [*chain.from_iterable(long)], [*map(len, long)])]
        for which in by.values():
            for i in range(0, len(which), 8192):
                parts.append((which[i : i + 8192], *self._merge_many([words[k] for k in which[i : i + 8192]])))
        at, ids, lens = (np.concatenate([np.asarray(x, np.int64) for x in xs]) for xs in zip(*parts))
        own = np.empty(len(words), np.int64)
        own[at] = lens
        begin = np.cumsum(own) - own
        out = np.empty(len(ids), np.int64)
        out[np.repeat(begin[at] - (np.cumsum(lens) - lens), lens) + np.arange(len(ids))] = ids
        return out, own

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int64)
        self.off = np.zeros(1 << 16, np.int64)
        self.len = np.zeros(1 << 16, np.int64)
        self.guests: list[bytes] = []

    def merge(self, word: bytes) -> list[int]:
        """Joins the adjacent pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > 48:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        get, none = ranks.get, 1 << 60
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        n, ranks = len(word), self.ranks
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] is not a or j >= n or part[j] is not b:
                continue
            part[i] = a + b
            part[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [ranks[p] for p in part if p]

    def _learn(self, words: list[bytes]) -> None:
        """Words beyond the cache's size stay until the next are learnt."""
        for w in self.guests:
            del self.index[w]
        self.guests = []
        first = len(self.index)
        ids, lens = self._merged(words)
        self.index.update(zip(words, range(first, first + len(words))))
        self.guests = words[max(0, CACHE - first) :]
        used = int(self.off[first - 1] + self.len[first - 1]) if first else 0
        while first + len(words) > len(self.off):
            self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len))
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.len[first : first + len(words)] = lens
        self.off[first : first + len(words)] = used + np.cumsum(lens) - lens

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens in each pre-token."""
        at = self.known(words)  # first: it may make the arrays anew
        return self.len[at]

    def known(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.index.get, words))
        if None in found:
            guests = set(self.guests)
            again = [i for i, (w, k) in enumerate(zip(words, found)) if k is None or w in guests] if guests else [i for i, k in enumerate(found) if k is None]
            self._learn(list(dict.fromkeys(words[i] for i in again)))
            for i in again:
                found[i] = self.index[words[i]]
        return np.array(found, np.int64)

    def pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(pre-tokens of all texts, their byte offsets, pre-tokens before each text)."""
        data, starts, per_text = boundaries(texts)
        ends = np.append(starts[1:], len(data))
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())], starts, per_text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as unsigned 32-bit integers, ids before each text with the total last)."""
        out, sizes = [np.zeros(0, np.uint32)], np.zeros(len(texts) + 1, np.int64)
        for owners, parts in blocks(texts):
            words, _, per_text = self.pieces(parts)
            if not words:
                continue
            w = self.known(words)
            n = self.len[w]
            at = np.concatenate([[0], np.cumsum(n)])
            out.append(self.flat[np.repeat(self.off[w] - at[:-1], n) + np.arange(at[-1])].astype(np.uint32))
            np.add.at(sizes, np.array(owners) + 1, np.diff(at[per_text]))
        return np.concatenate(out), np.cumsum(sizes)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all ids, byte offset of each id with the total last)."""
        n = self.width[ids]
        at = np.concatenate([[0], np.cumsum(n)])
        return self.bytes[np.repeat(self.begin[ids] - at[:-1], n) + np.arange(at[-1])].tobytes(), at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def chunks(texts: list[str], most: int = MOST):
    """Index ranges of texts with about that many characters together; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def sure_start(text: str, at: int) -> int:
    """The first place from at on, or the end, where a token starts whatever lies further off: a space between two characters
    that aren't white. No token goes on over such a space and none looks beyond it."""
    while (at := text.find(" ", max(at, 1))) >= 0:
        if at + 1 < len(text) and ord(text[at - 1]) not in _WHITE and ord(text[at + 1]) not in _WHITE:
            return at
        at += 1
    return len(text)


def blocks(texts: list[str], most: int = MOST):
    """(indices of texts, parts of them) of about that many characters together, in order."""
    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        begin = 0
        while begin < len(t):
            end = sure_start(t, begin + most) if len(t) - begin > most else len(t)
            if parts and size + end - begin > most:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(t[begin:end])
            size += end - begin
            begin = end
    if parts:
        yield owners, parts
