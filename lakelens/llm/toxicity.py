"""Operator 4: toxicity by a noisy channel. Written forms are decoded over character lattices, then the restored text is scored."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from .common import fold, stash, tree_sum, with_columns

#: What a sign may stand for, besides itself (fixed values); the empty text: nothing.
LEET = {
    "0": ("o",), "1": ("i", "l"), "2": ("z",), "3": ("e",), "4": ("a",), "5": ("s",), "6": ("g", "b"), "7": ("t",), "8": ("b",), "9": ("g",),
    "@": ("a",), "$": ("s", ""), "!": ("i", ""), "|": ("l", "i", ""), "+": ("t",), "(": ("c",), "<": ("c",), "€": ("e",), "£": ("l",), "¡": ("i",),
    "*": ("", "a", "e", "i", "o", "u"), "#": ("", "h"),
}
#: Natural-log costs of the channel's moves.
SUBSTITUTE, DROP, SQUEEZE, JOIN = 1.2, 0.7, 0.4, 0.7
SYMBOLS = 64
CACHE = 400_000
#: Prefix lengths that are features, besides whole words.
PREFIXES = (4, 5, 6, 7, 8)


def symbols(cps: np.ndarray) -> np.ndarray:
    """0 for what isn't a letter, 1 to 26 for a to z, the rest for other letters by code point."""
    out = np.zeros(len(cps), np.int64)
    low = np.where((cps >= 65) & (cps <= 90), cps + 32, cps).astype(np.int64)
    out[(low >= 97) & (low <= 122)] = (low - 96)[(low >= 97) & (low <= 122)]
    high = (low >= 0xAA) & (low != 0xD7) & (low != 0xF7) & ~((low >= 0x2000) & (low < 0x2C00)) & ~((low >= 0xAB) & (low < 0xB5)) & ~((low > 0xB5) & (low < 0xBA)) & ~((low > 0xBA) & (low < 0xC0))
    out[high] = 27 + low[high] % 37
    return out


def symbol(ch: str) -> int:
    return int(symbols(np.array([ord(ch)]))[0])


@dataclass
class Model:
    trigrams: np.ndarray  # log P(c | a, b), SYMBOLS cubed
    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0


class Decoder:
    """Restores words under a character language model; remembers a bounded number of them."""

    def __init__(self, trigrams: np.ndarray):
        self.lm = trigrams.reshape(SYMBOLS, SYMBOLS, SYMBOLS).tolist()
        self.seen: dict[str, str] = {}
        self.sym: dict[str, int] = {}

    def symbol(self, ch: str) -> int:
        if (s := self.sym.get(ch)) is None:
            s = self.sym[ch] = symbol(ch)
        return s

    def lattice(self, word: str):
        """For each run of a character: [(text that it stands for, cost)]."""
        i = 0
        while i < len(word):
            j = i
            while j < len(word) and word[j] == word[i]:
                j += 1
            c, n = word[i], j - i
            if c == " ":
                yield [(" ", 0.0), ("", JOIN)]
            elif c.isalpha():
                yield [(c * n, 0.0)] if n < 3 else [(c, SQUEEZE), (c + c, SQUEEZE)]
            else:
                stands = [(x, SUBSTITUTE if x else DROP) for x in LEET.get(c, ("",))]
                if n > 1:
                    stands = [(x * m, cost + SQUEEZE) for x, cost in stands for m in ({1, min(n, 2)} if x else {1})]
                yield stands + [("", DROP * 5 if c.isdigit() else DROP)]
            i = j

    def restore(self, word: str) -> str:
        """The best reading by Viterbi over the lattice: states are the last two symbols."""
        if (got := self.seen.get(word)) is not None:
            return got
        best = {(0, 0): (0.0, "")}
        for choices in self.lattice(word):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in best.items():
                for out, extra in choices:
                    x, y, total = a, b, cost + extra
                    for ch in out:
                        s = self.symbol(ch)
                        total -= self.lm[x][y][s]
                        x, y = y, s
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, text + out)
            best = after
        got = min((cost - self.lm[a][b][0], text) for (a, b), (cost, text) in best.items())[1]
        if len(self.seen) >= CACHE:
            self.seen.clear()
        self.seen[word] = got
        return got


def strip(word: str) -> str:
    """Without what isn't a letter at either end."""
    i, j = 0, len(word)
    while i < j and not word[i].isalpha():
        i += 1
    while j > i and not word[j - 1].isalpha():
        j -= 1
    return word[i:j]


def readings(word: str, decoder: Decoder) -> tuple[str, ...]:
    """Lower-case readings of one written word: the bare word, and what a noisy one stands for."""
    word = word.lower()
    bare = strip(word)
    out = [bare] if bare else []
    noisy = not bare.isalpha() or any(a == b == c for a, b, c in zip(bare, bare[1:], bare[2:])) or (len(word) > len(bare) and any(c in LEET for c in (word[:1], word[-1:])))
    if noisy and any(c.isalpha() for c in word):
        for form in {word, bare}:
            got = decoder.restore(form)
            if got and got not in out:
                out.append(got)
    return tuple(out)


def spaced(ws: list[str]) -> list[str]:
    """Runs of four or more single characters, joined."""
    out, run = [], []
    for w in [*ws, "  "]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 3 and len(set(run)) > 1:
            out.append("".join(run))
        run = []
    return out


NOTHING = (frozenset(), frozenset())
SIGNS = frozenset(LEET)


class Spacing:
    """Finds words of a lexicon that are written in pieces: windows of words whose characters, by what the channel may have
    made of them, spell one. Each window is then read by the lattice, where every space is kept or dropped."""

    def __init__(self, lexicon, decoder: Decoder):
        self.whole = {f[:-1] for f in lexicon if f.endswith(" ") and len(f) > 3}
        self.begins = {w[:n] for w in self.whole for n in range(len(w) + 1)}
        # written forms that first pieces without signs have: in either case, a letter twice, or a letter and a stop
        plain = {w for w in self.begins if w} | {w[:n] + w[n:][:1] + w[n:] for w in self.begins for n in range(len(w))} | {c + stop for c in self.begins if len(c) == 1 for stop in ".,-"}
        self.plain = plain | {w.upper() for w in plain} | {w.capitalize() for w in plain}
        self.after: dict[str, list[str]] = {}  # the words that go on from a beginning
        for w in self.whole:
            for n in range(1, len(w)):
                self.after.setdefault(w[:n], []).append(w)
        self.decoder = decoder
        self.opens: dict[str, tuple[frozenset, frozenset]] = {}

    def follow(self, states: frozenset, word: str) -> frozenset:
        """What of the lexicon's words may have been spelt after a further piece."""
        for ch in word:
            stands = (ch,) if ch.isalpha() else (*LEET.get(ch, ()), "")
            states = frozenset(x for s in states for o in stands for x in ((s + o, s) if o and s.endswith(o) else (s + o,)) if x in self.begins)
            if not states:
                break
        return states

    def open(self, word: str) -> frozenset:
        """The states after a first piece, none if nothing of a word was spelt."""
        return self.follow(frozenset([""]), word.lower()) - {""}

    def ahead(self, word: str) -> tuple[frozenset, frozenset]:
        """(the states after a first piece, the characters that the next piece may begin with)."""
        states = self.open(word)
        if not states:
            return NOTHING
        after = {s[-1] for s in states} | {w[len(s)] for s in states for w in self.after.get(s, ())}
        signs = {c for c, stands in LEET.items() if "" in stands or not after.isdisjoint(stands)}
        return states, frozenset(after | {c.upper() for c in after} | signs)

    def windows(self, ws: list[str]):
        """(first, end) of the longest windows, from each first piece that isn't the one before it again."""
        until = 0
        for i in [i for i, w in enumerate(ws) if w in self.plain or not w.isalpha() and not SIGNS.isdisjoint(w)]:
            if (x := self.opens.get(ws[i])) is None:
                if len(self.opens) > CACHE:
                    self.opens.clear()
                x = self.opens[ws[i]] = self.ahead(ws[i])
            if i + 1 == len(ws) or ws[i + 1][0] not in x[1]:
                continue
            if i < until or i and ws[i] == ws[i - 1]:
                continue
            first = states = x[0]
            end, j = 0, i + 1
            while j < len(ws) and (states := self.follow(states, ws[j].lower())):
                j += 1
                if not self.whole.isdisjoint(states):
                    end = j
            if end and self.whole.isdisjoint(first):
                until = end
                yield i, end

    def words(self, ws: list[str]):
        """The words that the windows read as and that aren't one of their pieces."""
        for i, end in self.windows(ws):
            got = self.decoder.restore(" ".join(ws[i:end]).lower())
            yield from (w for w in got.split() if w not in ws[i:end])


def forms(reading: str) -> list[str]:
    """Features of a reading: the whole word, and its prefixes."""
    return [f"{reading} ", *(reading[:n] for n in PREFIXES if len(reading) >= n)]


def words_of(text: str | None) -> list[str]:
    """The words of a text that is learned from; there is no lexicon yet, so only spelt-out words are joined."""
    ws = (text or "").split()
    if sum(len(w) == 1 for w in ws) > 3:
        ws = ws + spaced(ws)
    return ws


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of character trigrams, counted over all texts: a vector of fixed size from each partition."""
    size = SYMBOLS**3

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    s = symbols(np.frombuffer(f"  {t}  ".encode("utf-32-le"), np.uint32))
                    key = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                    total += np.bincount(key, minlength=size) if len(key) > size // 8 else 0
                    if len(key) <= size // 8:
                        np.add.at(total, key, 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    counts = tree_sum(docs.select(text).mapInArrow(count, "v binary"), size).reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    uni = counts.sum((0, 1)) + 1.0
    uni /= uni.sum()
    bi = counts.sum(0)
    bi = (bi + 5 * uni) / (bi.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * bi) / (counts.sum(2, keepdims=True) + 5)).ravel()


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights and bias (last) of ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, features: int = 400, doc_id: str = "doc_id", text: str = "text", sample_bytes: int = 32_000_000) -> Model:
    """The language model counts all texts. The classifier learns from at most `sample` labelled ids of each class, those
    with the smallest hash, outside fold 0, and of their texts from so many that the class has at most `sample_bytes`; of
    rows with the same id one text counts, the smallest; rows whose label is neither 0 nor 1 teach nothing. Without labels
    of both classes every score is that of the bias, 0.02."""
    model = Model(language_model(docs, text))
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 0)).select(F.col(doc_id).alias("i"), F.col("toxic").alias("y")).distinct()
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(sample)
        picked = part if picked is None else picked.union(part)
    own = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.min(F.struct(F.octet_length("t").alias("n"), "t"))["t"].alias("t"))
    own = stash(own, "toxicity-sample")  # 2 * sample rows at most
    size = F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i"))
    rows = own.withColumn("n", size).filter(F.col("n") <= sample_bytes).select("i", "t", "y").collect()
    rows.sort(key=lambda r: (r.i, r.t or ""))
    if len({r.y for r in rows}) < 2:
        return model
    decoder = Decoder(model.trigrams)
    y = np.array([r.y for r in rows], float)
    have = {c: int((y == c).sum()) for c in (0, 1)}

    read: dict[str, tuple[str, ...]] = {}

    def counted(r) -> Counter:
        out: Counter = Counter()
        for w, n in Counter(words_of(r.t)).items():
            if (xs := read.get(w)) is None:
                xs = read[w] = readings(w, decoder)
            for x in xs:
                for f in forms(x):
                    out[f] += n
        return out

    # toxic rows propose the features, clean ones only weigh them, so that few are held at a time
    seen = [Counter(), Counter()]
    for r in rows:
        if r.y:
            seen[1].update(counted(r).keys())
    seen[1] = Counter({f: n for f, n in seen[1].items() if n >= 3})
    for r in rows:
        if not r.y:
            seen[0].update(f for f in counted(r) if f in seen[1])

    def gain(f: str) -> float:
        p, q = (seen[1][f] + 0.5) / (have[1] + 1), (seen[0][f] + 0.5) / (have[0] + 1)
        return p * math.log(p / q) + (1 - p) * math.log((1 - p) / (1 - q)) if p > 3 * q else 0

    ranked = sorted(((g, f) for f in seen[1] if (g := gain(f)) > 0), key=lambda x: (-x[0], x[1]))[:features]
    model.lexicon = {f: k for k, (_, f) in enumerate(ranked)}
    x = np.zeros((len(rows), len(ranked)))
    for i, r in enumerate(rows):
        for f, n in counted(r).items():
            if (k := model.lexicon.get(f)) is not None:
                x[i, k] = math.log1p(n)
    weight = np.where(y == 1, total[1] / have[1], total[0] / have[0])
    w = logistic(x, y, weight / weight.mean())
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (score >= 0.5). Null and empty texts have no features and get the bias's score; each
    row is scored alone and in full, so repeated rows and ties score alike; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(cols):
        m = shared.value
        decoder = state.setdefault("decoder", Decoder(m.trigrams))
        cache = state.setdefault("cache", {})
        spacing = state.setdefault("spacing", Spacing([f for f, k in m.lexicon.items() if m.weights[k] > 0], decoder))
        out = []
        for t in cols[0].to_pylist():
            ws = (t or "").split()
            ws += list(spacing.words(ws))
            found = list(map(cache.get, ws))
            if None in found:
                for w in {w for w, k in zip(ws, found) if k is None}:
                    cache[w] = tuple(k for x in readings(w, decoder) for f in forms(x) if (k := m.lexicon.get(f)) is not None)
                found = list(map(cache.get, ws))
            z = m.bias + sum(m.weights[k] * math.log1p(n) for k, n in Counter(k for ks in found if ks for k in ks).items())
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            if len(cache) > CACHE:
                cache.clear()
        return [pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())]

    return with_columns(docs, [text], run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
