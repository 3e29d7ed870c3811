"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, stash, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The production key is a secret of the deployment; this one makes the query repeatable.
PII_KEY = "lakelens-demonstration-key"
PACK_TOKENIZER, PACK_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json"), 50_257


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are mined from the pages that the fixed list decides, and judge those that it doesn't."""
    from . import url_filter

    pages = table(spark, sf_dir, "pages")
    rules = url_filter.mine(url_filter.labelled(pages))
    return url_filter.judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii

    return replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"), PACK_TOKENIZER, PACK_VOCABULARY)
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), 90, 100, 3)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under two edits: a word goes in at its middle, and then five characters go at a third."""
    from .token_counts import count_edits

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    one = lambda first, removed, new: F.struct(F.floor(first).cast("int").alias("first"), F.lit(removed).alias("removed"), F.lit(new).alias("new"))
    edits = F.array(one(n / 2, 0, " revised"), one(n / 3, 5, ""))
    return count_edits(docs.withColumn("edits", edits), RANKS).select("doc_id", "n_tokens", "n_tokens_after", "n_pretokens", "n_reencoded")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    folder = warc.fresh_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder)
    back = warc.read(spark, folder).select("page_id", F.length("payload").cast("long").alias("own"), "payload_digest", "record_type", "refers_to")
    back = stash(back, "warc-pages")
    size = back.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("own").alias("payload_bytes"))
    return back.join(size, "payload_digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 50 = 0"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_pii, op3_quality_rules, op4_toxicity, op5_packing, op6_jaccard_join, op7_token_counts, op8_bpe_codec, op9_warc, op10_ann)}
ORACLE: dict[str, str] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every subset of a page's frequent tokens is counted, which is what FP-growth avoids.
ORACLE["op1_url_filter"] = rf"""
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
ruled as (
  select *, case
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
      when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
      when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
    list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
      list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || x))) as tokens from parts),
taught as (select row_number() over () as r, tokens, rule in ('example.com/de/', 'net/') as bad from ruled where rule is not null),
total as (select count(*)::double as n, count(*) filter (bad) as b, ceil(greatest(0.002::double, 10::double / count(*)) * count(*)) as least from taught),
often as (select item from (select r, unnest(tokens) as item from taught) group by item having count(*) >= (select least from total)),
kept as (select r, bad, list(item order by item) as items from (select r, bad, unnest(tokens) as item from taught) semi join often using (item) group by r, bad),
subsets as (select bad, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) as items from (select bad, items, unnest(range(1, 1 << len(items))) as mask from kept)),
counted as (select items, count(*) as a, count(*) filter (bad) as k from subsets group by items),
candidates as (select items, a, k / a as c, b / n as base from counted, total where k >= least and k / a >= 0.8 and b > 0 and b < n),
mined as (select items from candidates where c > base and a * (c * ln(c / base) + case when c < 1 then (1 - c) * ln((1 - c) / (1 - base)) else 0 end) >= ln((select count(*) from candidates) / 0.01::double)),
hit as (select distinct page_id from ruled, mined where list_has_all(tokens, items))
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null or page_id in (select page_id from hit) then 'block' else 'allow' end as verdict from ruled"""
#: The digest's 160 bits are dealt to 32 letters, four for each five hexadecimal places.
ORACLE["op9_warc"] = """
with own as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as sha from pages),
known as (select *, min(page_id) over (partition by sha) as origin, list_transform(range(0, 8), lambda g: ('0x' || substr(sha, 5 * g + 1, 5))::int) as places from own)
select page_id, cast(strlen(body) as bigint) as payload_bytes,
  list_reduce(list_transform(places, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), lambda a, b: a || b) as payload_digest,
  case when page_id = origin then 'response' else 'revisit' end as record_type, case when page_id <> origin then origin end as refers_to from known"""
#: Pairs by shared shingles, then all that is reachable.
ORACLE["op6_jaccard_join"] = r"""
with recursive ws as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from ws),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (select a.doc_id as x, b.doc_id as y from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach as (select doc_id, doc_id as other from sets union select r.doc_id, l.y from reach r join links l on r.other = l.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.other) as component_id from sets s join reach r on r.doc_id = s.doc_id group by s.doc_id, len(s.s)"""
#: Word windows by position, the holdout's counts at each cutoff, the binomial tails, and the tightest cutoff before one fails.
ORACLE["op3_quality_rules"] = r"""
with w as (select doc_id, coalesce(lang, '?') as s, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from documents),
grams as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
twice as (select doc_id, g from grams group by doc_id, g having count(*) > 1),
again as (select doc_id, count(distinct j) as r from (select doc_id, unnest([i, i + 1, i + 2]) as j from grams join twice using (doc_id, g)) group by doc_id),
counted as (select doc_id, s, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r, 0)::bigint as n_repeat_words from w left join again using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 1000 * n_symbols / greatest(word_chars, 1)::double as a, 1000 * n_dup_lines / greatest(n_lines, 1)::double as b,
    1000 * n_repeat_words / greatest(n_words, 1)::double as c, 1000 * word_chars / greatest(n_words, 1)::double / 100 as d from counted),
scores as (select doc_id, s, base_failed, unnest(['a', 'b', 'c', 'd']) as rule, unnest([a, b, c, d]) as score from f),
held as (select * from scores where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
size as (select s, count(*) // 4 as n from held group by s),
grid as (select distinct round(1000 * pow(0.85, k), 1) as cut from range(40) r(k)),
seen as (select s, rule, cut, count(*) filter (score > cut) as k from held, grid group by s, rule, cut),
tails as (select s, rule, cut, case when k >= n then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005::double) + (n - i) * ln(0.995::double)))) end
    > 0.05 / (4 * (select count(*) from size)) as fails from seen join size using (s)),
cuts as (select s, rule, min(cut) as cut from tails x where cut > coalesce((select max(cut) from tails y where y.s = x.s and y.rule = x.rule and y.fails), -1) group by s, rule),
out as (select distinct doc_id from scores join cuts using (s, rule) where score > cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from out) as kept from f"""
