"""Each training-data operator against brute force, a round trip or held-out labels, and its edge cases."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lakelens.llm import jaccard_join, pii, quality, queries, toxicity, url_filter, warc
from lakelens.llm.ann import search
from lakelens.llm.bpe import Encoder, encoder
from lakelens.llm.bpe_codec import decode, encode
from lakelens.llm.common import stash, table
from lakelens.llm.packing import fill, pack
from lakelens.llm.shingles import shingle_set, words
from lakelens.llm.token_counts import count_edits, edit, trees

DIR = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (None, "a b c d e f"), (5, "x " * 30_000), (6, "\u00e9\U0001f600 \u3000 mixed 's't"), (7, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", 0, "q", 1.5) for i, t in ODD], DOC + ", ids string, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DIR, "documents")


@pytest.fixture(scope="module")
def tik():
    path = queries.RANKS
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder(path).ranks, special_tokens={})


def mess(r, n):
    return "".join(r.choice("ab 's't're 'll\n\n \t \u00a0\u3000\u00e91\u096712!?'\"''dm\U0001f600\u6f22 vx  ") for _ in range(n))


def test_bpe_matches_the_library(tik):
    r, e = random.Random(1), encoder(queries.RANKS)
    for _ in range(400):
        texts = [mess(r, r.choice((0, 1, 5, 40, 700))) for _ in range(5)]
        ids, at = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tik.encode_ordinary(t) for t in texts]


def test_bpe_small_cache(monkeypatch, tik):
    monkeypatch.setattr("lakelens.llm.bpe.CACHE", 20)
    r, e = random.Random(2), Encoder(queries.RANKS)
    for _ in range(50):
        t = mess(r, 300)
        assert e.encode([t])[0].tolist() == tik.encode_ordinary(t)


def test_op8(spark, docs, odd, tik):
    got = {r.doc_id: r for r in queries.op8_bpe_codec(spark, DIR).collect()}
    for d in docs.collect():
        ids = tik.encode_ordinary(d.text)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())
    out = decode(encode(odd, queries.RANKS), queries.RANKS).collect()
    assert len(out) == len(ODD) and all(r.decoded == (r.text or "").encode() for r in out)
    assert encode(odd.limit(0), queries.RANKS).count() == 0


def test_op7(spark, docs, odd, tik):
    r, e = random.Random(3), encoder(queries.RANKS)
    for _ in range(60):
        texts = [mess(r, r.choice((0, 1, 30, 3000))) for _ in range(6)]
        forest = trees(e, texts)
        for _ in range(3):
            step = []
            for i, t in enumerate(texts):
                a = r.randint(0, len(t))
                b, new = min(len(t), a + r.choice((0, 1, 50))), mess(r, r.choice((0, 1, 40)))
                step.append((len(t[:a].encode()), len(t[:b].encode()), new))
                texts[i] = t[:a] + new + t[b:]
            edit(e, forest, step)
            assert [t.total() for t in forest] == [len(tik.encode_ordinary(t)) for t in texts]
    text = {d.doc_id: d.text for d in docs.collect()}
    for row in queries.op7_token_counts(spark, DIR).collect():
        t = text[row.doc_id]
        a, b = len(t) // 2, len(t) // 3
        t = t[:a] + " revised" + t[a:]
        assert row.n_tokens_after == len(tik.encode_ordinary(t[:b] + t[b + 5 :])) and row.n_reencoded < 40
    wild = odd.withColumn("edits", F.expr("array(null, struct(-3 as a, 99999999 as b, cast(null as string) as c))"))
    assert {r.n_tokens_after for r in count_edits(wild, queries.RANKS).collect()} == {0}


def test_op5(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.PACK_TOKENIZER)
    text = {d.doc_id: d.text for d in docs.collect()}
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in text.items()}
    rows = queries.op5_packing(spark, DIR).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in by_doc.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [s for s, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] == len(want[i])
    for parts in by_seq.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [s for s, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024 and (ends[-1] & (ends[-1] - 1)) == 0
    assert len(by_doc) == len(text)
    got = pack(odd, queries.PACK_TOKENIZER, queries.PACK_VOCABULARY)
    assert got.agg(F.sum("length")).first()[0] == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ODD)
    assert pack(odd.limit(0), queries.PACK_TOKENIZER, queries.PACK_VOCABULARY).count() == 0


def test_fill_prefers_neighbours():
    class Near:
        def near(self, seed, unused, k=0):
            return [i for i in ({0: [2], 1: [3]}.get(seed, [])) if unused[i]]

    got = fill([6, 5, 2, 3], Near(), 8)
    assert [(0, 0, 6), (2, 0, 2)] in got and [(1, 0, 5), (3, 0, 3)] in got


def brute(rows, num, den, n):
    sets = {i: set(shingle_set(words(t), n).tolist()) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num and den * len(x & y) >= num * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("num,den,n", [(90, 100, 3), (80, 100, 5)])
def test_op6(spark, docs, odd, num, den, n):
    r = random.Random(4)
    base = [f"w{r.randint(0, 400)}" for _ in range(120)]
    made = []
    for i in range(150):  # near copies whose links only chain
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 9)}"
        made.append((10_000 + i, " ".join(w)))
    made += [(20_000 + i, " ".join(r.choices("abcd", k=r.randint(1, 14)))) for i in range(150)]
    rows = [(d.doc_id, d.text) for d in docs.limit(250).collect()] + made
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), num, den, n).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, num, den, n)
    few = jaccard_join.jaccard_components(odd, num, den, n).collect()
    assert len(few) == len(ODD) and {(r.doc_id, r.component_id) for r in few} == {(i, i) for i, _ in ODD}
    assert jaccard_join.jaccard_components(odd.limit(0), num, den, n).count() == 0


def test_op4(spark, docs, odd):
    labels = table(spark, DIR, "labels")
    got = queries.op4_toxicity(spark, DIR).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    model = toxicity.fit(docs, labels)
    dec = toxicity.Decoder(model.trigrams)
    for noisy, word in (("m0r0n", "moron"), ("tr@sh", "trash"), ("i-d-i-o-t", "idiot"), ("stuuuupid", "stupid"), ("idiot###", "idiot")):
        assert word in toxicity.readings(noisy, dec)
    assert toxicity.spaced("x y i d i o t the".split()) == ["xyidiot"]
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    blank = toxicity.fit(odd, labels.limit(0))
    assert toxicity.score(odd, blank).filter("predicted = 1").count() == 0


def test_op3(spark, docs, odd):
    text = {d.doc_id: d.text for d in docs.collect()}
    for r in queries.op3_quality_rules(spark, DIR).collect():
        ws = text[r.doc_id].encode().split()
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(ws) < 400 else None
        assert r.n_words == len(ws) and r.word_chars == len(b"".join(ws).decode()) and (hit is None or r.n_repeat_words == len(hit))
        assert r.base_failed == (len(ws) < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert abs(quality.tail(10, 2, 0.3) - 0.3827827864) < 1e-9
    seen = {(s, rule, c): 0 for s in "ab" for rule in quality.RULES for c in quality.GRID}
    seen |= {("a", "symbols", c): 60 for c in quality.GRID if c < 100}
    cut = quality.cutoffs({"a": 5000, "b": 20}, seen, 0.02, 0.05)
    assert cut["a"]["symbols"] >= 100 and cut["a"]["dup_lines"] == min(quality.GRID) and "b" not in cut
    assert quality.judge(odd, table(spark, DIR, "labels")).count() == len(ODD)


def test_op2(spark, docs, odd):
    rows = [(1, "Mail Foo.bar9@mail2.example.com, +1 (974) 555-3436 or +1 974 555 3436; 1.2.3.4, 4111 1111 1111 1111 x 4111111111111111!"), (2, "Mrs. Anna Schmidt met Herr Schmidt"), (3, None), (4, "plain 2.0. text"), (5, "foo.bar9@mail2.example.com")]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    a = got[1].text
    assert "974" not in a and "4111" not in a and "1.2.3.4" not in a and "Foo" not in a
    phones = re.findall(r"\+1[ (\d)-]+\d", a)
    assert len({"".join(c for c in p if c.isdigit()) for p in phones}) == 1  # one number, two formats
    assert got[4].text == rows[3][1] and got[3].text is None and got[5].text in a
    assert got[2].text.startswith("Mrs. ") and got[2].text.split()[2] == got[2].text.split()[-1] and got[2].text.split()[1].endswith("a")
    many = spark.createDataFrame([(i, f"{i % 100:03d}-{i // 100 % 100:02d}-{i:04d}") for i in range(1500)], "doc_id long, text string")
    out = [r.text for r in pii.replace_pii(many, "k").collect()]
    assert len(set(out)) == 1500 and not set(out) & {r.text for r in many.collect()}
    assert pii.replace_pii(odd, "k").count() == len(ODD) and pii.replace_pii(odd.limit(0), "k").count() == 0


def test_op1(spark):
    urls = ["http://A.b.net/x?y", "https://m.example.net/en/1", "https://example.com/de", "https://example.com/de/a#t", "ftp://x.org/fr/", "x.org/fr/", None, "http://u.example.net", "a://b://c/d", "http://net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(7))
    none = spark.createDataFrame([], "items array<string>, anchor string, confidence double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, none).collect()}
    assert got == {
        0: ("a.b.net", "/x", "net/", "block"), 1: ("m.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.com", "/de", None, "allow"), 3: ("example.com", "/de/a", "example.com/de/", "block"),
        4: ("x.org", "/fr/", "org/fr/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("u.example.net", "", None, "allow"), 8: ("b:", "//c/d", None, "allow"), 9: ("net", "/", "net/", "block"),
    }
    rows = [(f"http://{'bad' if i % 3 else 'good'}{'.farm' if i % 2 else '.site'}.io/{i % 7}/{i}", int(i % 3 > 0 and i % 2)) for i in range(600)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, bad int"))
    found = url_filter.matches(spark.createDataFrame(rows, "url string, bad int"), rules)
    assert {r.url for r in found.collect()} == {u for u, b in rows if b}
    assert url_filter.mine(spark.createDataFrame([], "url string, bad int")).count() == 0


def test_op9(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 5000)
    monkeypatch.setattr(warc, "CHUNK", 700)
    html = ["", None, "same", "same", "\u00e9\r\n\r\nWARC/1.1\r\n" * 3000, "x" * 20_000, "same"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(None, None, "last")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 8
    for i, h in enumerate(html):
        body = (h or "").encode()
        first = min(k for k, x in enumerate(html) if (x or "") == (h or ""))
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))
        assert got[i].payload == (body if first == i else None)
    with pytest.raises(ValueError):
        warc.join_segments([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(ValueError):
        warc.unchunk(b"3\r\nabcX")
    row = {r.page_id: r for r in queries.op9_warc(spark, DIR).collect()}
    assert len(row) == 250 and all(r.payload_bytes > 0 for r in row.values())


def test_op10(spark):
    rows = table(spark, DIR, "embeddings")
    data = sorted((r.vec_id, r.embedding) for r in rows.collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    norm, hit = np.sqrt((x * x).sum(1)), 0
    got = {}
    for r in queries.op10_ann(spark, DIR).collect():
        got.setdefault(r.query_id, {})[r.rank] = r
    for k in np.flatnonzero(ids % 50 == 0):
        s = (x * x[k]).sum(1) / (norm * norm[k])
        s[k] = -2
        top = got[ids[k]]
        assert sorted(top) == [1, 2, 3, 4, 5] and all(abs(top[n].score - s[np.searchsorted(ids, top[n].vec_id)]) < 1e-12 for n in top)
        hit += len({r.vec_id for r in top.values()} & set(ids[np.lexsort((ids, -s))[:5]]))
    assert hit >= 0.9 * 5 * len(got)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in search(odd, odd.filter("vec_id = 2")).orderBy("rank").collect()] == [(1, 1), (2, 3)]
    assert search(odd.limit(0), odd).count() == 0


def test_pipeline(spark, docs, odd):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    cur = docs
    for name, f in p.STAGES[:-1]:
        new = f(spark, cur, DIR).persist()
        assert new.columns == docs.columns
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in cur.limit(10**6).collect()]
            assert sorted(r.doc_id for r in new.collect()) == sorted(i for i, c in brute(rows, 80, 100, 5).items() if i == c)
        cur = new
    assert cur.count() == p.run(spark, DIR).select("doc_id").distinct().count()
    for f in stages.values():
        f(spark, odd.select(*docs.columns), DIR).count()


def test_jaccard_tiles_below_strict_miss_no_link():
    """Every linked pair meets in a tile in which its ends leave it; ends' rounded numbers hold the true ones."""
    u, rng = np.uint64, np.random.default_rng(1)
    numbers = np.concatenate([np.arange(5000), rng.integers(0, 1 << 40, 2000)])
    for bits in (jaccard_join.SIZE, jaccard_join.PLACE):
        low, high = jaccard_join.span(jaccard_join.coarse(numbers, bits), bits)
        assert (low <= numbers).all() and (numbers <= high).all()
    links = 0
    for _ in range(40):
        num, every = int(rng.integers(50, 85)), rng.integers(0, 1 << 63, int(rng.integers(5, 1500))).astype(u)
        sets = []
        for base in [rng.choice(every, int(rng.integers(1, len(every) + 1)), replace=False) for _ in range(3)]:
            for _ in range(5):
                kept = base[rng.random(len(base)) > rng.random() / 4]
                sets.append(np.union1d(kept, rng.choice(every, int(len(kept) * rng.random() * 0.15))))
        sets = [s for s in sets if len(s)]
        often = np.unique(rng.choice(every, len(every) // 3, replace=False))
        tile, owner, ends = jaccard_join.signatures(jaccard_join.Bands(num, 100), sets, np.stack([often, rng.permutation(len(often)).astype(u) + u(1)]))
        a, b = (i.ravel() for i in np.meshgrid(np.arange(len(tile)), np.arange(len(tile)))) if len(tile) < 1500 else np.array([(i, j) for t in np.unique(tile) for i in np.flatnonzero(tile == t) for j in np.flatnonzero(tile == t)]).T
        same = (tile[a] == tile[b]) & (owner[a] < owner[b])
        a, b = a[same], b[same]
        left = jaccard_join.ahead(ends[a], ends[b], num, 100) if len(a) else np.zeros(0, bool)
        met = set(zip(owner[a][left].tolist(), owner[b][left].tolist()))
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    links += 1
                    assert (i, j) in met
    assert links > 300


def test_bpe_blocks_cut_only_where_tokens_start(monkeypatch, tik):
    monkeypatch.setattr("lakelens.llm.bpe.blocks.__defaults__", (40,))
    r, e = random.Random(5), encoder(queries.RANKS)
    for _ in range(300):
        texts = [mess(r, r.choice((0, 3, 90, 400))) for _ in range(3)]
        ids, at = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tik.encode_ordinary(t) for t in texts]


def test_spans_bound_rows_and_bytes():
    import pyarrow as pa

    from lakelens.llm.common import spans

    col = pa.array(["a" * n for n in (1, 5, 100, 2, 2, 2, 0)] + [None])
    assert list(spans([col], 8, 3, 10)) == [(0, 2), (2, 1), (3, 3), (6, 2)]
    assert list(spans([], 5, 2)) == [(0, 2), (2, 2), (4, 1)] and list(spans([col.slice(0, 0)], 0)) == []


def views(where):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {name} as select * from '{where}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.parametrize("where", [DIR, "/root/testdata/sf0.001"])
def test_oracle(spark, name, where):
    df = queries.QUERIES[name](spark, where)
    cols = sorted(df.columns)
    found = views(where).execute(queries.ORACLE[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted(str([x[i] for i in at]) for x in found.fetchall())
    assert want and sorted(str([r[c] for c in cols]) for r in df.collect()) == want


def test_op1_mines_what_brute_force_finds(spark):
    """Rules, their confidence and pruning on labelled URLs; held-out pages of the list; no rules from chance."""
    import itertools
    import math

    r = random.Random(6)
    rows = [(f"http://{r.choice('abc')}.{r.choice(['x', 'y'])}.io/{r.choice('pqr')}/{i}", 0) for i in range(900)]
    rows = [(u, int("/p/" in u or (".x.io" in u and "//a" in u) or r.random() < 0.05)) for u, _ in rows]
    n, bad, count, hits = len(rows), sum(b for _, b in rows), {}, {}
    for u, b in rows:
        h, p = u[7:].split("/", 1)
        have = sorted({f"h:{x}" for x in h.split(".")} | {f"p:{x}" for x in p.split("/")})
        for k in range(1, 6):
            for c in itertools.combinations(have, k):
                count[c], hits[c] = count.get(c, 0) + 1, hits.get(c, 0) + b
    cand = {c: hits[c] / count[c] for c in count if hits[c] >= 10 and hits[c] / count[c] >= 0.8}
    base = bad / n
    far = lambda c: count[c] * (cand[c] * math.log(cand[c] / base) + ((1 - cand[c]) * math.log((1 - cand[c]) / (1 - base)) if cand[c] < 1 else 0))
    sure = {c for c in cand if cand[c] > base and far(c) >= math.log(len(cand) / 0.01)}
    want = {c for c in sure if not any(set(d) < set(c) and cand[d] >= cand[c] for d in sure)}
    got = {tuple(x["items"]): x.confidence for x in url_filter.mine(spark.createDataFrame(rows, "url string, bad int")).collect()}
    assert len(want) >= 2 and set(got) == want and all(abs(got[c] - cand[c]) < 1e-9 for c in want)
    chance = spark.createDataFrame([(u, int(r.random() < 0.15)) for u, _ in rows], "url string, bad int")
    assert url_filter.mine(chance).count() == 0 and url_filter.mine(chance.filter("bad = 1")).count() == 0
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    held = (F.crc32(F.col("page_id").cast("string")) % 5) == 0
    rules = url_filter.mine(url_filter.labelled(pages.filter(~held)))
    found = {x.url for x in url_filter.matches(pages, rules).collect()}
    known = url_filter.labelled(pages.filter(held)).collect()
    right = sum(x.bad for x in known if x.url in found)
    assert rules.count() > 0 and right >= 0.95 * sum(x.url in found for x in known) and right >= 0.95 * sum(x.bad for x in known)


def test_op2_query_against_brute_force(spark, docs):
    """Entities by another regex engine; what lies between them stays, each has one surrogate, and no two share one."""
    import regex

    find = regex.compile("|".join(f"({p})" for p in pii.PATTERNS.values()).replace("(?iu:", "(?i:"), regex.V0)
    to = {}
    text = {d.doc_id: d.text for d in docs.collect()}
    for row in queries.op2_pii(spark, DIR).collect():
        old, at = text[row.doc_id], 0
        found = list(find.finditer(old))
        assert row.n_entities == len(found)
        pattern, last = "", 0
        for m in found:
            pattern += regex.escape(old[last : m.start()]) + "(.+)"
            last = m.end()
        m = regex.fullmatch(pattern + regex.escape(old[last:]), row.text, regex.S)
        assert m and not found or [len(g) for g in m.groups()] and all(a.group() not in b for a, b in zip(found, m.groups()))
        for a, b in zip(found, m.groups()):
            assert to.setdefault(a.group(), b) == b
    assert len(to) > 5 and len(set(to.values())) == len(to)


def test_op2_leaves_no_letter(spark):
    """No letter or digit of a name, a mailbox or a number stays at its place, in any script; names are coreferent."""
    words = ["Müller", "Núñez", "Щукин", "Γεωργίου", "Ångström", "Łukasz", "Dvořák", "Đorđević", "Šimić", "İpek", "Ёлкин", "Ødegård", "Թումանյան", "Smith-Lüdenscheidt", "D’Angelo"]
    boxes = ["李明@例子.cn", "مها@x.com", "दीपक@उदाहरण.com", "ひらがな@カタカナ.jp", "홍길동@서울.kr", "юля@почта.рф", "ⴰⵣⵓⵍ@x.org", "นที@x.com"]
    rows = [(i, f"Herr {w}") for i, w in enumerate(words)] + [(100 + i, b) for i, b in enumerate(boxes)]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, t in rows:
        a, b = (t[5:], got[i].text[5:]) if i < 100 else (t.split("@")[0], got[i].text.split("@")[0])
        assert got[i].n_entities == 1 and len(a) == len(b)
        assert all(x != y for x, y in zip(a, b) if x.isalnum()) and [x.isupper() for x in a] == [x.isupper() for x in b]
    text = "Mrs. Anna Schmidt, Mrs. Anna and MRS. SCHMIDT. Anna's Schmidt, anna; Annas. mr Bo Li"
    out = pii.replace_pii(spark.createDataFrame([(1, text), (2, "Ms. Anna; Anna Li")], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    w = re.findall(r"[\w.]+", out[0].text)
    assert w[1] == w[4] == w[8] and w[2].lower() == w[7].lower().strip(".") == w[10].lower() and w[7].isupper() and w[11:13] == ["anna", "Annas."] and w[1].endswith("a")
    assert out[1].text == f"Ms. {w[1]}; {w[1]} Li"  # Li isn't named in this text
    iban = pii.replace_pii(spark.createDataFrame([(1, "DE89 3704 0044 0532 0130 00")], "doc_id long, text string"), "k").first().text
    plain = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain[:2] == "DE" and [c == " " for c in iban] == [c == " " for c in "DE89 3704 0044 0532 0130 00"]
    ips = ["10.1.2.3", "192.168.7.8", "172.16.9.9", "127.0.0.1", "8.8.8.8"]
    new = [r.text for r in pii.replace_pii(spark.createDataFrame(list(enumerate(ips)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    import ipaddress

    assert [ipaddress.ip_address(x).is_private for x in new] == [True, True, True, True, False] and not set(new) & set(ips)


@pytest.mark.parametrize("text", ["x@" + "a." * 3000 + "1", "1 " * 200_000, " ".join(f"user{i}@m.example.com" for i in range(5000)), "Mr. " + "Ab" * 50_000, "a" * 300_000 + "@x.com", "Mr. " + "Ab " * 50_000], ids=range(6))
def test_op2_hostile_texts(spark, text):
    import time

    df = spark.createDataFrame([(1, text, 5, 6)], "doc_id long, text string, __own0 int, __new int")
    began = time.time()
    row = pii.replace_pii(df, "k").first()
    assert row["__own0"] == 5 and row["__new"] == 6 and time.time() - began < 60


def test_op9_records(spark, tmp_path):
    """Repeated long rows in several partitions, clashing columns, an empty table; members are standard gzip, ids are distinct."""
    import gzip

    big = "".join(random.Random(7).choices("ab c\u00e9\n", k=150_000))
    rows = [(1, "u", big), (1, "u", big), (2, None, big), (3, "v", "x"), (4, "v", "x"), (None, "w", big), (None, "w", None), (None, "w", None)]
    pages = spark.createDataFrame([(*r, "q", 9, "z") for r in rows], "page_id long, url string, html string, sha string, first int, value string").repartition(4)
    warc.write(pages, str(tmp_path / "w"))
    found = []
    for f in sorted((tmp_path / "w").glob("*.txt")):
        raw = f.read_bytes()
        one_by_one = list(warc.members(raw))
        assert b"".join(one_by_one) == gzip.decompress(raw) and all(len(list(warc.parse(r))) == 1 for r in one_by_one)
        found += [next(warc.parse(r))[0] for r in one_by_one]
    ids = [f["WARC-Record-ID"] for f in found]
    assert len(set(ids)) == len(ids) and all(f["WARC-Refers-To"] in ids for f in found if "WARC-Refers-To" in f)
    assert any("WARC-Refers-To" in f for f in found) and sum(f["WARC-Type"] == "continuation" for f in found) >= 4
    got = sorted(((r.page_id, r.record_type, r.refers_to, None if r.payload is None else r.payload.decode()) for r in warc.read(spark, str(tmp_path / "w")).collect()), key=str)
    assert got == sorted([(1, "response", None, big)] * 2 + [(2, "revisit", 1, None), (None, "revisit", 1, None), (3, "response", None, "x"), (4, "revisit", 3, None)] + [(None, "response", None, "")] * 2, key=str)
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        list(warc.members(raw[:-3]))


def test_op5_special_tokens_and_ties(spark):
    """Ids are the library's where texts hold its special token; repeated and equal documents are all packed, whole."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.PACK_TOKENIZER)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x <|endoftext|", "<|endoftext|>\n\n  y", "it's <|ENDOFTEXT|>"] + ["same words again"] * 400
    df = spark.createDataFrame([(i // 2, x, 1, "q") for i, x in enumerate(texts)], "doc_id long, text string, start int, offset string").repartition(3)
    want = sorted((i // 2, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, x in enumerate(texts))
    got, room = {}, {}
    for r in pack(df, queries.PACK_TOKENIZER, queries.PACK_VOCABULARY).collect():
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
        got.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert 50256 in np.frombuffer(got[0, 5][0].ids, "<u4") and all(n <= 1024 and n & (n - 1) == 0 for n in room.values())
    whole = [(i, zlib.crc32(r.ids)) for (i, n), rs in got.items() for r in rs if r.length == n]
    assert set(whole) <= set(want) and sum(r.length for rs in got.values() for r in rs) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts)


def test_op4_spacing_is_decoded(spark, docs):
    """Words in pieces score as the words do, next to single letters too; a text's sample is bounded in rows and bytes."""
    labels = table(spark, DIR, "labels")
    model = toxicity.fit(docs, labels)
    word = max((f[:-1] for f in model.lexicon if f.endswith(" ") and f.strip().isascii() and len(f) > 5), key=lambda w: model.weights[model.lexicon[w + " "]])
    spelt = " ".join(word)
    noisy = [word, f"a {spelt} c", f"{word[:2]} {word[2:]}", " ".join(word[:3]) + " " + word[3:], spelt.upper(), "x " * 5000 + spelt, " ".join(c * 2 for c in word)]
    made = spark.createDataFrame(list(enumerate(noisy)), "doc_id long, text string")
    got = [r.score for r in toxicity.score(made, model).orderBy("doc_id").collect()]
    assert got[0] > toxicity.score(made.limit(0).union(spark.createDataFrame([(0, "")], "doc_id long, text string")), model).first().score
    assert all(abs(s - got[0]) < 1e-9 for s in got[:6])
    spacing = toxicity.Spacing({"clown ": 0}, toxicity.Decoder(model.trigrams))
    assert list(spacing.windows("a c l o w n c".split())) == [(1, 6)] and list(spacing.windows("cl 0 o wn the".split())) == [(0, 4)] and not list(spacing.windows("clown c low n".split()[:2]))
    twice = docs.union(docs).union(docs)
    assert toxicity.fit(twice, labels, sample=40).lexicon.keys() == toxicity.fit(docs, labels, sample=40).lexicon.keys()
    assert not toxicity.fit(docs, labels, sample_bytes=0).lexicon


def test_stash_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from lakelens.llm.common import shared_dir

    def session(master, named=None):
        return N(conf=N(get=lambda k, d: named), sparkContext=N(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))

    assert shared_dir(session("spark://host:7077", "hdfs://lake/tmp/")) == "hdfs://lake/tmp"
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_hot_ids_are_dealt(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, i) for i in range(2, 3000)] + [(i, i + 1) for i in range(5000, 5500)], "a long, b long")
    got = jaccard_join._dealt(pairs)
    by = {(r.a, r.s): r["count"] for r in got.groupBy("a", "s").count().collect()}
    assert got.count() == pairs.count() and sum(a == 1 for a, _ in by) == 12 and max(by.values()) < 400 and all(s == 0 for a, s in by if a > 1)
    assert jaccard_join._dealt(pairs.limit(0)).count() == 0


def recall(rows, k=5, every=50):
    """(recall, share of the pairs that were scored) by brute force."""
    looked, got = [], {}
    for r in search(rows, rows.filter(f"vec_id % {every} = 0"), looked=looked).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    data = sorted((r.vec_id, r.embedding) for r in rows.collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    norm, hit, asked = np.sqrt((x * x).sum(1)), 0, np.flatnonzero(ids % every == 0)
    for j in asked:
        s = (x * x[j]).sum(1) / (norm * norm[j])
        s[j] = -2
        hit += len(set(got[ids[j]]) & set(ids[np.lexsort((ids, -s))[:k]].tolist()))
    return hit / (k * len(asked)), looked[0] / (len(asked) * len(ids))


def test_op10_looks_where_near_rows_are(spark, monkeypatch):
    """With several shards: recall without structure, far fewer pairs with structure, and groups of equal vectors."""
    from lakelens.llm import ann

    monkeypatch.setattr(ann, "SHARD_ROWS", 400)
    rng = np.random.default_rng(8)
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plain = rng.standard_normal((3000, 16))
    near = rng.standard_normal((60, 16))[rng.integers(0, 60, 3000)] + 0.05 * rng.standard_normal((3000, 16))
    (a, share_a), (b, share_b) = recall(frame(plain)), recall(frame(near))
    assert a >= 0.9 and b >= 0.9 and share_b < 0.25 < share_a
    same = np.vstack([np.tile(plain[0], (1000, 1)), plain[:500], plain[:500]])
    got = {}
    for r in search(frame(same), frame(same).filter("vec_id in (0, 3, 700, 999, 1001)")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 3, 700, 999):
        assert [i for _, i, _ in sorted(got[q])] == [i for i in range(6) if i != q][:5] and all(abs(s - 1) < 1e-12 for _, _, s in got[q])
    assert sorted(got[1001])[0][1] == 1501
    clash = frame(plain[:20]).selectExpr("vec_id", "embedding", "1 as id", "2 as v", "3 as h", "4 as n", "5 as query_id")
    assert search(clash, clash.filter("vec_id = 0")).count() == 5 and search(clash, clash.limit(0)).count() == 0


def test_op10_prefixes_by_probability():
    from lakelens.llm import ann

    rng = np.random.default_rng(9)
    for cosine in (0.3, 0.7, 0.95, 0.999):
        hit = n = 0
        for _ in range(60):
            q = rng.standard_normal(24)
            q /= np.linalg.norm(q)
            told = ann.likely(q, 6, cosine)
            assert len(set(told)) == len(told) <= 64 and told[0] == ann.prefix_of(q[None], 6)[0]
            for _ in range(20):
                u = rng.standard_normal(24)
                u -= (u @ q) * q
                x = cosine * q + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u)
                hit, n = hit + (ann.prefix_of(x[None], 6)[0] in told), n + 1
        assert hit / n >= ann.ROUTED - 0.05
    assert ann.depth(1.0) == 32 and ann.depth(0.95) > ann.depth(0.5) > ann.depth(0.1) and ann.likely(q, 0, 0.5) == [0]


def test_op7_trees_are_kept(spark, odd, tik):
    """Trees that are written and read again take further edits; untouched leaves stay as they are; clashing columns."""
    from lakelens.llm.token_counts import TREE, Tree, apply, build

    r, e = random.Random(11), encoder(queries.RANKS)
    texts = [mess(r, n) for n in (0, 1, 200, 9000)] + ["word " * 60_000, "漢" * 5000]
    forest = trees(e, texts)
    for _ in range(4):
        forest = [Tree.load(*t.store()) for t in forest]
        step = []
        for i, (t, x) in enumerate(zip(forest, texts)):
            a = r.randint(0, len(x))
            b, new = min(len(x), a + r.choice((0, 3, 700))), mess(r, r.choice((0, 2, 60, 4000)))
            assert t.byte_of(a) == len(x[:a].encode()) and t.read(t.byte_of(a), t.byte_of(b)).decode() == x[a:b]
            step.append((t.byte_of(a), t.byte_of(b), new))
            texts[i] = x[:a] + new + x[b:]
        edit(e, forest, step)
        assert [t.total() for t in forest] == [len(tik.encode_ordinary(t)) for t in texts]
        assert [t.read(0, t.size()).decode() for t in forest] == texts
    big = trees(e, ["some words here " * 20_000])[0]
    kept = Tree.load(*big.store())
    edit(e, [kept], [(160_000, 160_004, "others")])
    assert sum(len(x[0]) > 0 and not isinstance(x[1], bytes) for x in kept.leaves) < 8  # the rest wasn't read
    df = odd.withColumn("tree_sums", F.lit(5)).withColumn("edits", F.expr("array(struct(0 as a, 1 as b, 'new ' as c))"))
    built = build(df, queries.RANKS)
    out = apply(built, queries.RANKS).collect()
    want = sorted(len(tik.encode_ordinary("new " + (t or "")[1:])) for _, t in ODD)
    assert sorted(x.n_tokens_after for x in out) == want and {f.name for f in TREE} <= set(built.columns)
    assert apply(build(df.limit(0), queries.RANKS), queries.RANKS).count() == 0


def test_stash_leaves_no_shuffle_files(spark):
    """Else all steps of an operator lie on the disks together, until the driver collects its garbage."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString(" ")))
    before = files()
    out = stash(spark.range(100_000).withColumn("k", F.col("id") % 977).repartition(4, "k").groupBy("k").agg(F.max("id")), "freed")
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and out.count() == 977


def test_bitmaps_part_families_without_losing_links():
    """A pair that is linked is among the ids that stay, and its roots are connected."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([(s := base[(a := int(r.integers(0, 40))) : a + int(r.integers(60, 360))])[r.random(len(s)) > 0.04], r.integers(0, 1 << 63, int(r.integers(0, 12)), dtype=np.uint64)])) for _ in range(120)]
    sets += [np.unique(r.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in r.integers(1, 900, 80)]
    rows = [(i, 1000 + i // 2, i % 2, len(s), jaccard_join.bitmap(s, jaccard_join.width(len(s))).tobytes()) for i, s in enumerate(sets)]
    for own in (True, False):
        edges, ids = jaccard_join.near(rows, own, 80, 100)
        part = {x[1]: x[1] for x in rows}
        for a, b in edges:
            assert part[a] != part[b]
            part = {k: part[a] if v == part[b] else v for k, v in part.items()}
        links = [(i, j) for i in range(200) for j in range(i) if rows[i][1] != rows[j][1] and (own or i % 2 != j % 2) and 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))]
        assert len(links) > 50 and all({i, j} <= ids and part[rows[i][1]] == part[rows[j][1]] for i, j in links)
        assert not ids & set(range(120, 200))  # what nothing is close to goes


def test_bpe_merges_side_by_side_as_one_by_one():
    """Words that the pass side by side takes, whole tokens, one byte and words beyond its bound, with a repeated learning."""
    r, e = random.Random(9), Encoder(queries.RANKS)
    words = list(dict.fromkeys([mess(r, r.choice((1, 2, 7, 20, 60))).encode() for _ in range(3000)] + [w.encode() for w in ("a", " the", "é" * 16, "x" * 32, "x" * 33, "ab" * 40)]))
    ids, n = e._merged(words)
    want = [e.merge(w) for w in words]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert e.counts(words[:2000]).tolist() == [len(x) for x in want[:2000]] and e.counts(words).tolist() == [len(x) for x in want]


def test_op7_edits_encode_the_words_of_all_trees_together():
    """A pass of an edit asks the encoder once, however many trees it has, and the trees are those of the texts edited anew."""
    r, e, asked = random.Random(11), Encoder(queries.RANKS), []
    texts = [mess(r, r.choice((0, 1, 5, 80, 900))) for _ in range(200)]
    forest, own = trees(e, texts), e.counts
    e.counts = lambda words: asked.append(len(words)) or own(words)
    cuts = [(r.randint(0, len(t)), r.randint(0, 6), mess(r, r.randint(0, 9))) for t in texts]
    again = edit(e, forest, [(f.byte_of(a), f.byte_of(a + n), new) for f, (a, n, new) in zip(forest, cuts)])
    assert sum(asked) == sum(again) > 300 and len(asked) < 20
    for f, t, (a, n, new) in zip(forest, texts, cuts):
        text = t[:a] + new + t[a + n :]
        words = e.pieces([text])[0]
        assert b"".join(x[0] for x in f.leaves) == text.encode() and f.total() == sum(len(e.merge(w)) for w in words)
        assert [int(x) for i in range(f.width) for x in f.leaf(i)[1]] == [*map(len, words)]


def test_bpe_merges_few_words_one_by_one():
    """A few words aren't worth a pass side by side; many of like length are, with the same ids."""
    e, sizes = Encoder(queries.RANKS), []
    own = e._merge_many
    e._merge_many = lambda words: sizes.append(len(words)) or own(words)
    words = [f" {a}qz{b}x".encode() for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    for some in (words[:1], words[:9], words):
        ids, n = e._merged(some)
        want = [e.merge(w) for w in some]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert sizes == [len(words)]
