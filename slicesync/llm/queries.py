"""The operators as queries over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicesync.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Appended to each document where the contract asks for an end id.
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.packing import pack, token_pieces

    docs = table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), END_ID))


@register("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.tokenfiles import read_checksums, write_token_files

    folder = run_dir(spark, "tokens")
    write_token_files(
        table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), END_ID)
    return read_checksums(spark, folder)


@register("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.substrings import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("row.doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
g AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w),
t AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
r AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t) WHERE n > 1),
k AS (SELECT doc_id, count(*) AS n FROM (
  SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest([0, 1, 2]) AS j)) GROUP BY doc_id),
l AS (
  SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
    len(regexp_extract_all(x, '[#*$%&<>{}\[\]~^=]')) AS marks,
    len(regexp_extract_all(x, '!')) AS bangs, len(regexp_extract_all(x, '\|')) AS bars
  FROM (SELECT doc_id, unnest(lines) AS x FROM w)),
lost AS (
  SELECT doc_id, sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM l
  WHERE (marks >= 3 AND marks * 5 > n) OR (bangs * 3 > n AND n >= 3) OR bars * 4 >= n
    OR regexp_matches(x, '(?i)\b(lorem ipsum|(enable|requires?) javascript|accept (all )?cookies|we use cookies|subscribe to our newsletter|click here to|skip to (main )?content|share on facebook|follow us on|sign up for free|log in to continue|read more\s*$)')
  GROUP BY doc_id),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(k.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.chars, 0) AS lost_chars
  FROM w LEFT JOIN k USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 25 * word_chars AS kept
FROM f
"""


@register("op9_quality_rules", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.quality import judge

    return judge(table(spark, sf_dir, "documents")).drop("lost_chars", "clean_text", "row")


def _op2_rules():
    from slicesync.llm.urls import Rule

    return (
        Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"),
        Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, host, path, arg_max(h || r.p, length(h || r.p)) AS rule,
    arg_max(verdict, length(h || r.p)) AS ruled
  FROM (SELECT DISTINCT page_id, host, path FROM p) p JOIN r
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)
  GROUP BY page_id, host, path),
words AS (
  SELECT *, regexp_extract_all(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}]+') AS w FROM p),
n AS (
  SELECT page_id, host, path,
    len(list_intersect(list_distinct(w), ['adult', 'casino', 'escort', 'hentai', 'porn', 'porno', 'spam',
      'viagra', 'xxx']))::INT AS n_strict,
    len(list_intersect(list_distinct(w), ['ad', 'ads', 'bet', 'bets', 'bonus', 'buy', 'cheap', 'cialis',
      'click', 'credit', 'crypto', 'deal', 'deals', 'farm', 'free', 'jackpot', 'loan', 'loans', 'lottery',
      'pill', 'pills', 'poker', 'prize', 'promo', 'sale', 'sex', 'slots', 'track', 'tracker', 'win',
      'winner']))::INT AS n_soft
  FROM words)
SELECT n.page_id, n.host, n.path, rule,
  coalesce(ruled, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft
FROM n LEFT JOIN best ON best.page_id IS NOT DISTINCT FROM n.page_id AND best.host = n.host
  AND best.path = n.path
"""


@register("op2_url_filter", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), _op2_rules())


@register("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


@register("op5_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.warc import read_warc, write_warc

    folder = run_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder, revisit_bytes=0)
    return read_warc(spark, folder).drop("url", "payload")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
  vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


@register("op4_embedding_near_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op7_bpe_lexicon")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.lexicon import encode_and_decode, lexicon_for

    docs, path = table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")
    return encode_and_decode(docs, path, lexicon_for(docs, path))


@register("op11_suffix_array_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.suffixes import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
f AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.n + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
  FROM t JOIN v USING (lang) JOIN k USING (lang)
    LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM f WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@register("op13_source_divergence", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE c AS (
  SELECT doc_id, n_chars, coalesce('=' || lang, '') AS key, row_number() OVER () AS r,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z:
        CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS crc
  FROM documents),
l AS (
  SELECT doc_id, key, r, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS other,
    coalesce(crc % 7 = 0, false) AS tampered FROM c),
p AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
    count(*) OVER (PARTITION BY key) AS n FROM l),
t(lvl, key, i, d, n) AS (
  SELECT 0, key, i, leaf, n FROM p
  UNION ALL
  SELECT lvl + 1, key, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2
  FROM t WHERE n > 1 GROUP BY lvl, key, i // 2, n),
s AS (
  SELECT key, d, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, d, n) AS (
  SELECT 0, i, d, n FROM s
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2
  FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
w(r, key, lvl, i, fold, proof, n) AS (
  SELECT r, key, 0, i, CASE WHEN tampered THEN other ELSE leaf END, '', n FROM p
  UNION ALL
  SELECT r, w.key, w.lvl + 1, w.i // 2, sha256(
      CASE WHEN t.d IS NULL THEN fold WHEN w.i % 2 = 0 THEN fold || t.d ELSE t.d || fold END),
    proof || coalesce(t.d, ''), (w.n + 1) // 2
  FROM w LEFT JOIN t ON t.lvl = w.lvl AND t.key = w.key AND t.i = xor(w.i, 1) WHERE w.n > 1),
x(r, lvl, i, fold, proof, n) AS (
  SELECT r, 0, s.i, fold, proof, s.n FROM w JOIN s USING (key) WHERE w.n = 1
  UNION ALL
  SELECT r, x.lvl + 1, x.i // 2, sha256(
      CASE WHEN u.d IS NULL THEN fold WHEN x.i % 2 = 0 THEN fold || u.d ELSE u.d || fold END),
    proof || coalesce(u.d, ''), (x.n + 1) // 2
  FROM x LEFT JOIN u ON u.lvl = x.lvl AND u.i = xor(x.i, 1) WHERE x.n > 1)
SELECT p.doc_id, p.leaf, s.d AS subroot, u.d AS root, sha256(x.proof) AS proof_sha256, x.fold AS folded_root,
  x.fold = u.d AS verified
FROM p JOIN s USING (key) JOIN x ON x.r = p.r AND x.n = 1 JOIN u ON u.n = 1
"""


@register("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicesync.llm.merkle import manifest

    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(
        table(spark, sf_dir, "documents"), where=changed,
        changes={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}).drop("copies")
