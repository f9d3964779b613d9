"""The registered queries of this subpackage over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.llm import decontam, dialogue, inner, jaccard, langid, mixing, neighbours, phrases, pii, substrings, toxicity, urls, warc
from facsimile.llm.common import read


def _fold(parts: int) -> Column:
    """crc32 of the document id as text, modulo ``parts``; a null id is in no fold that is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts, F.lit(-1))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(documents, read(spark, folder, "labels"), _fold(5) != 0)
    scored = toxicity.score(documents.select("doc_id", "lang", "text", (_fold(5) == 0).alias("held_out")), model, keep=["doc_id", "lang", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents, _fold(4) != 2)
    return langid.predict(documents.select("doc_id", "text", (_fold(4) == 2).alias("held_out")), model, keep=["doc_id", "held_out"])


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    made = mixing.mix(read(spark, folder, "documents").select("doc_id", "text", "source"))
    return made.select("doc_id", "source", "n_tokens", "weight", "copies", "block", "place")


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(read(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.summary(warc.read(spark, warc.write(read(spark, folder, "pages").select("page_id", "url", "html"))))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(read(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, folder, "documents").select("doc_id", "text")))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    held = decontam.contained(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))
    return held.select("doc_id", "item_id", "n_shared", "n_item")


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicate(read(spark, folder, "documents").select("doc_id", "text"), digests=True)


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(neighbours.index(vectors), neighbours.every(vectors, 50), 5)


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(read(spark, folder, "documents").select("text", "lang"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    conversations = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return dialogue.summary(conversations, dialogue.damage(conversations))


def op13_top_products(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return inner.top(vectors, neighbours.every(vectors, 100), 10)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_language, op3_mixing, op4_url_filter, op5_warc, op6_jaccard_join, op7_pii, op8_decontamination, op9_substring_dedup, op10_nearest,
    op11_phrases, op12_conversations, op13_top_products, pipeline)}

ORACLES = {
    "op13_top_products": r"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON (c.vec_id <> q.vec_id OR c.e <> q.e) AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
WINDOW w AS (PARTITION BY q.vec_id, q.e ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) QUALIFY row_number() OVER w <= 10""",
    "op12_conversations": r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
-- crc32, bit by bit
z AS (SELECT k, 4294967295::BIGINT AS c, 0 AS i, length(k) AS size FROM (SELECT DISTINCT k FROM o) UNION ALL
  SELECT k, list_reduce(list_prepend(xor(c, CAST(ascii(k[i + 1]) AS BIGINT)), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
                        lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), i + 1, size FROM z WHERE i < size),
l AS (SELECT k, xor(c, 4294967295) % 20 AS lot FROM z WHERE i = size),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM o JOIN l USING (k) WHERE lot <> 0),
r AS (SELECT *, rtrim(text, e' \t\n\x0B\x0C\r') AS bare, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS rows,
    lag(role) OVER w AS previous, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(sha256(text), 32), copy)),
f AS (SELECT *, left(role, 1) AS a, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM r),
g AS (SELECT conv_id, max(rows) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (previous IS NOT NULL AND left(previous, 1) || a NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
-- backwards: the cheapest rest (cost, audit, lines) from nothing yet (n), after a system (s), a user (u), an assistant row (v)
b AS (SELECT conv_id, rows AS i, {'c': 0, 'e': '', 't': ''} AS n, {'c': 4, 'e': 'II', 't': e'\nuser:\nassistant:'} AS s,
             {'c': 2, 'e': 'I', 't': e'\nassistant:'} AS u, {'c': 0, 'e': '', 't': ''} AS v FROM g
  UNION ALL
  SELECT conv_id, i - 1, list_min([x.n, {'c': 2 + x.u.c, 'e': 'I' || x.u.e, 't': e'\nuser:' || x.u.t}, {'c': 4 + x.v.c, 'e': 'II' || x.v.e, 't': e'\nuser:\nassistant:' || x.v.t}]),
         list_min([x.s, {'c': 2 + x.u.c, 'e': 'I' || x.u.e, 't': e'\nuser:' || x.u.t}, {'c': 4 + x.v.c, 'e': 'II' || x.v.e, 't': e'\nuser:\nassistant:' || x.v.t}]),
         list_min([x.u, {'c': 2 + x.v.c, 'e': 'I' || x.v.e, 't': e'\nassistant:' || x.v.t}]), list_min([x.v, {'c': 2 + x.u.c, 'e': 'I' || x.u.e, 't': e'\nuser:' || x.u.t}])
  FROM (SELECT conv_id, i, {
      'n': list_min([{'c': 3 + n.c, 'e': 'D' || n.e, 't': n.t}, {'c': k + m + u.c, 'e': CASE WHEN a = 'u' THEN 'K' ELSE 'R' END || u.e, 't': lu || u.t},
                     {'c': k + CASE WHEN a = 's' THEN 0 ELSE 99999999 END + s.c, 'e': 'K' || s.e, 't': own || s.t}]),
      's': list_min([{'c': 3 + s.c, 'e': 'D' || s.e, 't': s.t}, {'c': k + m + u.c, 'e': CASE WHEN a = 'u' THEN 'K' ELSE 'R' END || u.e, 't': lu || u.t}]),
      'u': list_min([{'c': 3 + u.c, 'e': 'D' || u.e, 't': u.t}, {'c': k + j + v.c, 'e': CASE WHEN a = 'a' THEN 'K' ELSE 'R' END || v.e, 't': lv || v.t}]),
      'v': list_min([{'c': 3 + v.c, 'e': 'D' || v.e, 't': v.t}, {'c': k + m + u.c, 'e': CASE WHEN a = 'u' THEN 'K' ELSE 'R' END || u.e, 't': lu || u.t}])} AS x
    FROM (SELECT b.*, f.a, CASE WHEN f.fault IN ('blank', 'duplicate') THEN 99999999 WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS k,
        CASE WHEN f.a = 'u' THEN 0 ELSE 2 END AS m, CASE WHEN f.a = 'a' THEN 0 ELSE 2 END AS j, e'\n' || f.role || ':' || f.text AS own,
        e'\n' || CASE WHEN f.a = 'u' THEN f.role ELSE 'user' END || ':' || f.text AS lu, e'\n' || CASE WHEN f.a = 'a' THEN f.role ELSE 'assistant' END || ':' || f.text AS lv
      FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i))),
best AS (SELECT conv_id, n FROM b WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(n.c, 0) AS BIGINT) AS cost, coalesce(n.e, '') AS audit, sha256(coalesce(substr(n.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op11_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS x, a FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, cut, l.a AS l, r.a AS r, n,
             CAST(1000 AS HUGEINT) * c.a * n // (CAST(l.a AS HUGEINT) * r.a) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN t USING (lang)
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.x[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.x[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
-- a longer phrase as frequent as a part of it has one of the part's one-word extensions in between
e AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(x[1:k - 1], ' '), array_to_string(x[2:], ' ')]) AS phrase FROM c WHERE k > 2) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE e.a IS NULL OR 100 * e.a < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z WHERE rank <= 2000""",
    "op3_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS g, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n,
         md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS place FROM documents),
s AS (SELECT g, CAST(sum(n) AS BIGINT) AS tokens FROM d WHERE n > 0 GROUP BY g),
t AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, list(tokens::DOUBLE) AS each FROM s),
l AS (SELECT total, list_transform(each, lambda x: x / total) AS p FROM t),
-- the largest exponent whose entropy meets the target, then the smallest one within the limit of passes
e AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, p FROM l UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END, p FROM (
    SELECT *, ln(list_sum(list_transform(p, lambda x: x ** mid))) - list_sum(list_transform(p, lambda x: x ** mid * ln(x) * mid)) / list_sum(list_transform(p, lambda x: x ** mid))
              >= 0.98::DOUBLE * ln(len(p)) AS ok FROM (SELECT *, (low + high) / 2 AS mid FROM e WHERE i < 30))),
f AS (SELECT p, CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.98::DOUBLE * ln(len(p)) THEN 1.0::DOUBLE ELSE low END AS a FROM e WHERE i = 30),
r AS (SELECT 0 AS i, a AS low, 1.0::DOUBLE AS high, p FROM f UNION ALL
  SELECT i + 1, CASE WHEN over THEN mid ELSE low END, CASE WHEN over THEN high ELSE mid END, p FROM (
    SELECT *, list_max(list_transform(p, lambda x: x ** (mid - 1))) / list_sum(list_transform(p, lambda x: x ** mid)) > 4.0::DOUBLE AS over
    FROM (SELECT *, (low + high) / 2 AS mid FROM r WHERE i < 30))),
x AS (SELECT round(CASE WHEN list_max(list_transform(f.p, lambda x: x ** (a - 1))) / list_sum(list_transform(f.p, lambda x: x ** a)) > 4.0::DOUBLE THEN r.high ELSE a END, 6) AS a
      FROM f, r WHERE r.i = 30),
w AS (SELECT g, tokens, total, round((tokens::DOUBLE / total) ** a / sum((tokens::DOUBLE / total) ** a) OVER (), 12) AS weight FROM s, l, x),
b AS (SELECT *, CAST(floor(round(weight * total, 3)) AS BIGINT) AS due FROM w),
c AS (SELECT d.*, weight, due // tokens AS passes, due % tokens AS rest, CAST(ceil(tokens / 1000000.0::DOUBLE) AS BIGINT) AS blocks,
             sum(n) OVER (PARTITION BY d.g ORDER BY place) AS upto FROM d LEFT JOIN b ON d.g = b.g)
SELECT doc_id, source, n AS n_tokens, coalesce(weight, 0) AS weight, CAST(coalesce(passes, 0) + CASE WHEN n > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(coalesce(floor(CAST('0x' || substr(place, 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE * blocks), 0) AS BIGINT) AS block, place FROM c""",
    "op4_url_filter": r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
cut AS (SELECT page_id,
               coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fit AS (SELECT c.page_id, c.host, c.path, u.verdict, u.host || u.path AS rule
        FROM cut c LEFT JOIN rules u ON (c.host = u.host OR ends_with(c.host, '.' || u.host)) AND starts_with(c.path, u.path)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule DESC) AS k FROM fit)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1""",
    "op8_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
              WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS s FROM dw)),
its AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
              WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS s FROM iw)),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM ds JOIN its USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n_item) * 80""",
    "op7_pii": r"""
WITH hits AS (
  SELECT doc_id, k.ord, k.kind, regexp_extract_all(coalesce(text, ''), k.pattern) AS h, string_split_regex(coalesce(text, ''), k.pattern) AS gaps
  FROM documents, (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
                          (3, 'card', '[0-9]([\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
                          (5, 'iban', '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3}\b)?\b')) k(ord, kind, pattern)),
each AS (SELECT doc_id, ord, kind, unnest(h) AS hit, unnest(gaps[1:len(h)]) AS gap, generate_subscripts(h, 1) AS i FROM hits WHERE len(h) > 0),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM each),
judged AS (
  SELECT doc_id, ord, kind, stop - length(hit) AS start, stop, regexp_replace(hit, '[^0-9]', '', 'g') AS d, hit FROM placed),
kept AS (
  SELECT * FROM judged WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND coalesce(try_cast(right(ltrim(p, '0'), 3) AS int), 0) <= 255))
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda j:
           CASE WHEN j % 2 = 0 THEN ascii(d[length(d) - j]) - 48 WHEN (ascii(d[length(d) - j]) - 48) * 2 > 9 THEN (ascii(d[length(d) - j]) - 48) * 2 - 9
                ELSE (ascii(d[length(d) - j]) - 48) * 2 END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    ELSE list_reduce(list_prepend(0, list_transform(string_split(substr(replace(hit, ' ', ''), 5) || left(replace(hit, ' ', ''), 4), ''),
           lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
           lambda a, c: CASE WHEN c > 9 THEN (a * 100 + c) % 97 ELSE (a * 10 + c) % 97 END) = 1 END),
told AS (SELECT doc_id, ord, kind, start, kind || ':' || start || ':' || stop AS s FROM kept)
SELECT d.doc_id, count(*) FILTER (ord = 1) AS n_email, count(*) FILTER (ord = 2) AS n_ip, count(*) FILTER (ord = 3) AS n_card, count(*) FILTER (ord = 4) AS n_phone,
       sha256(coalesce(string_agg(s, ',' ORDER BY ord, start) FILTER (ord < 5), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY ord, start) FILTER (ord <= 5), '') AS spans
FROM documents d LEFT JOIN told t USING (doc_id) GROUP BY d.doc_id""",
}
