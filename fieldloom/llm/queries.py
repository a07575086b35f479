"""The registered query of each corpus operator, on the whole of its table, and the SQL that must agree with it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.bpe import bpe_decode, bpe_encode
from fieldloom.llm.chat import rotate_perspectives
from fieldloom.llm.importance import importance_ranks
from fieldloom.llm.language import identify_languages
from fieldloom.llm.mixing import mix_plan
from fieldloom.llm.neighbours import nearest_neighbours
from fieldloom.llm.passages import score_quality
from fieldloom.llm.quality import quality_verdicts
from fieldloom.llm.repair import damaged, repair_reports
from fieldloom.llm.simhash import simhash_components
from fieldloom.llm.token_counts import count_tokens
from fieldloom.llm.toxicity import score_toxicity
from fieldloom.llm.url_rules import judge_urls
from fieldloom.plans.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe_encode(spark, F.col("text"), path).alias("ids"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe_decode(spark, F.col("ids"), path), 256).alias("decoded_sha256"),
    )


@REGISTRY.query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(table(spark, sf_dir, "documents"), k=4, width=4)


_OP3_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
ruled AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
good AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\.+$', '') AS name
  FROM parts LEFT JOIN good USING (page_id) GROUP BY host),
split_ AS (SELECT *, list_reverse(string_split(name, '.')) AS l, regexp_matches(name, '^\[|^[0-9]+(\.[0-9]+){3}$') AS address FROM hosts),
sites AS (
  SELECT *, CASE WHEN len(l) > 2 AND length(l[1]) = 2
    AND l[2] IN ('ac', 'co', 'com', 'edu', 'go', 'gob', 'gov', 'gouv', 'ltd', 'me', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'plc', 'sch') THEN 2 ELSE 1 END AS s FROM split_),
named AS (
  SELECT host, n, k, CASE WHEN address THEN 'address' ELSE array_to_string(list_reverse(l[1:s]), '.') END AS suffix,
         CASE WHEN address THEN name ELSE array_to_string(list_reverse(l[1:s + 1]), '.') END AS domain FROM sites),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM named GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
m0 AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2.0) AS mean_0 FROM suffixes),
kids AS (
  SELECT 0 AS lvl, '' AS parent, n::DOUBLE AS n, k::DOUBLE AS k FROM suffixes WHERE n > 0
  UNION ALL SELECT 1, suffix, n, k FROM domains WHERE n > 0
  UNION ALL SELECT 2, domain, n, k FROM named WHERE n > 0),
sums AS (SELECT lvl, parent, count(*) AS g, sum(n) AS t, sum(k) AS s, sum(n * n) AS q, sum(k * k / n) AS sc FROM kids GROUP BY 1, 2),
alike AS (
  SELECT lvl, parent, CASE WHEN t - q / t - (g - 1) > 0
    THEN ((sc - s * (s / t)) / nullif(s / t * (1 - s / t), 0) - (g - 1)) / (t - q / t - (g - 1)) END AS a FROM sums),
strength AS (SELECT lvl, parent, CASE WHEN a > 0 THEN greatest(2.0, least(1000.0, 1 / a - 1)) ELSE 1000.0 END AS st FROM alike),
l1 AS (
  SELECT suffix, (k + coalesce(st, 2.0) * mean_0) / (n + coalesce(st, 2.0)) AS mean_1
  FROM suffixes CROSS JOIN m0 LEFT JOIN strength ON lvl = 0),
l2 AS (
  SELECT domain, (k + coalesce(st, 2.0) * mean_1) / (n + coalesce(st, 2.0)) AS mean_2
  FROM domains JOIN l1 USING (suffix) LEFT JOIN strength ON lvl = 1 AND parent = suffix),
l3 AS (
  SELECT host, (k + coalesce(st, 2.0) * mean_2) / (n + coalesce(st, 2.0)) AS mean, n + coalesce(st, 2.0) AS size
  FROM named JOIN l2 USING (domain) LEFT JOIN strength ON lvl = 2 AND parent = domain),
ab AS (SELECT host, mean, mean * size AS a, (1 - mean) * size AS b, 8 * sqrt(1 / (mean * size) + 1 / ((1 - mean) * size)) AS reach FROM l3 WHERE mean < 0.5),
ends_ AS (SELECT *, ln(a / b) - reach - 30 / a AS low, ln(a / b) + reach + 30 / b AS high FROM ab),
cuts AS (SELECT *, least(greatest(0.0, low), high) AS at_, -a * ln(1 + b / a) - b * ln(1 + a / b) AS top FROM ends_),
areas AS (
  SELECT host, sum(CASE WHEN side = 0 THEN (at_ - low) * w * exp(-a * ln(1 + exp(-(low + (at_ - low) * i / 400))) - b * ln(1 + exp(low + (at_ - low) * i / 400)) - top) ELSE 0 END) AS below,
         sum(CASE WHEN side = 1 THEN (high - at_) * w * exp(-a * ln(1 + exp(-(at_ + (high - at_) * i / 400))) - b * ln(1 + exp(at_ + (high - at_) * i / 400)) - top) ELSE 0 END) AS above
  FROM cuts, (SELECT range AS i, CASE WHEN range IN (0, 400) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 401)), (VALUES (0), (1)) AS sides(side) GROUP BY host)
SELECT parts.page_id, host, path, rule,
       coalesce(ruled.verdict, CASE WHEN above / (below + above) < 0.05 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN ruled USING (page_id) LEFT JOIN areas USING (host)
"""


@REGISTRY.query("op3_urls", _OP3_SQL)
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; a page's outcome is the quality label that carries its id."""
    labels = table(spark, sf_dir, "labels")
    return judge_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")))


_OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (ARRAY[5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sizes),
ranked AS (
  SELECT *, (2 * source_size)::DOUBLE AS full_, (2 * source_size)::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * total::DOUBLE - coalesce(sum(full_) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS place
  FROM ranked),
open_ AS (SELECT ratio AS open_ratio, level AS open_level FROM levels WHERE ratio > level ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN open_ratio IS NULL OR ratio < open_ratio THEN full_ ELSE least(full_, open_level * weight) END AS target
  FROM levels LEFT JOIN open_ ON true),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs, floor(target + 0.5)::BIGINT AS budget FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY sized.source ORDER BY ord) - size AS before
  FROM sized JOIN budgets ON sized.source IS NOT DISTINCT FROM budgets.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed
"""


@REGISTRY.query("op4_mix", _OP4_SQL)
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_plan(table(spark, sf_dir, "documents"))


_OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role IS NULL AS nobody,
         replace(replace(replace(replace(replace(coalesce(role, 'unknown'), chr(8288), chr(8288) || chr(8288)), '<|', '<' || chr(8288) || '|'), '|>', '|' || chr(8288) || '>'),
           chr(10), chr(8288) || 'n'), chr(13), chr(8288) || 'r') AS speaker,
         replace(replace(coalesce(text, ''), chr(8288), chr(8288) || chr(8288)), '<|', '<' || chr(8288) || '|') AS text
  FROM conversations),
people AS (SELECT DISTINCT conv_id AS of_, speaker AS perspective FROM rows WHERE NOT nobody AND speaker <> 'system'),
seen AS (
  SELECT conv_id, perspective, turn, speaker, text, (speaker = perspective AND NOT nobody) AS own,
    CASE WHEN speaker = perspective AND NOT nobody THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM rows JOIN people ON conv_id IS NOT DISTINCT FROM of_),
rendered AS (
  SELECT *, '<|' || role || CASE WHEN role = 'user' THEN ':' || speaker ELSE '' END || '|>' || chr(10) AS head FROM seen),
messages AS (SELECT *, head || text || '<|end|>' || chr(10) AS message FROM rendered),
placed AS (
  SELECT *, (sum(length(message)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS end_
  FROM messages)
SELECT conv_id, perspective, turn, speaker, role, message, own::INT AS mask, (end_ - length(message))::BIGINT AS start, end_ AS "end",
       CASE WHEN own THEN (end_ - length(message) + length(head))::BIGINT END AS text_from, CASE WHEN own THEN (end_ - 1)::BIGINT END AS text_to
FROM placed
"""


@REGISTRY.query("op5_chat", _OP5_SQL)
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's perspective, one row for each turn."""
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


@REGISTRY.query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify_languages(table(spark, sf_dir, "documents"))


_OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g_lang, coalesce('=' || source, '-') AS g_source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM often, (VALUES (0), (1), (2)) AS offsets(o) GROUP BY doc_id),
stats AS (
  SELECT base.doc_id, g_lang, g_source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         CASE WHEN len(w) = 0 THEN 0 ELSE length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) END::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
metrics AS (
  SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // (n_lines + 5) AS dup_lines,
         1000 * n_repeat_words // (n_words + 50) AS repeats, 10 * word_chars // greatest(n_words, 1) AS chars
  FROM judged),
long AS (
  UNPIVOT (SELECT g_lang, g_source, symbols, dup_lines, repeats, chars FROM metrics WHERE NOT base_failed)
  ON symbols, dup_lines, repeats, chars INTO NAME metric VALUE v),
s2 AS (SELECT g_lang, g_source, metric, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS bin, count(*) AS n FROM long GROUP BY ALL),
every AS (
  SELECT 0 AS lvl, '' AS g_lang, '' AS g_source, metric, bin, sum(n)::BIGINT AS n FROM s2 GROUP BY ALL
  UNION ALL SELECT 1, g_lang, '', metric, bin, sum(n)::BIGINT FROM s2 GROUP BY ALL
  UNION ALL SELECT 2, g_lang, g_source, metric, bin, n FROM s2),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lvl, g_lang, g_source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lvl, g_lang, g_source, metric) AS total FROM every),
q AS (
  SELECT lvl, g_lang, g_source, metric, max(total)::BIGINT AS n, min(bin) FILTER (100 * upto >= 50 * total) AS mid, min(bin) FILTER (100 * upto >= 5 * total) AS q5,
         min(bin) FILTER (100 * upto >= 90 * total) AS q90, min(bin) FILTER (100 * upto >= 99 * total) AS q99 FROM ranked GROUP BY ALL),
f AS (
  SELECT lvl, g_lang, g_source, metric AS name, n, mid, mid + 3 * greatest(CASE metric WHEN 'symbols' THEN q90 ELSE q99 END - mid, CASE metric WHEN 'symbols' THEN 30 ELSE 40 END)::DOUBLE AS top FROM q WHERE metric <> 'chars'
  UNION ALL SELECT lvl, g_lang, g_source, 'chars', n, mid, mid + 5 * greatest(q90 - mid, 4)::DOUBLE FROM q WHERE metric = 'chars'
  UNION ALL SELECT lvl, g_lang, g_source, 'short', n, -mid, -mid + 5 * greatest(mid - q5, 3)::DOUBLE FROM q WHERE metric = 'chars'),
f1 AS (SELECT f.g_lang, f.name, f.mid, least((f.n * f.top + 50 * u.top) / (f.n + 50), u.mid + 1.5::DOUBLE * (u.top - u.mid)) AS top FROM f JOIN f u ON u.lvl = 0 AND u.name = f.name WHERE f.lvl = 1),
f2 AS (SELECT f.g_lang, f.g_source, f.name, least((f.n * f.top + 50 * u.top) / (f.n + 50), u.mid + 1.5::DOUBLE * (u.top - u.mid)) AS top FROM f JOIN f1 u ON u.g_lang = f.g_lang AND u.name = f.name WHERE f.lvl = 2),
fences AS (
  SELECT g_lang, g_source, max(top) FILTER (name = 'symbols') AS s, max(top) FILTER (name = 'dup_lines') AS d, max(top) FILTER (name = 'repeats') AS r,
         max(top) FILTER (name = 'chars') AS ch, -max(top) FILTER (name = 'short') AS cl FROM f2 GROUP BY ALL),
matched AS (SELECT * FROM metrics LEFT JOIN fences USING (g_lang, g_source))
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols <= s, true) AND coalesce(dup_lines <= d, true) AND coalesce(repeats <= r, true)
       AND coalesce(chars <= ch, true) AND coalesce(chars >= cl, true) AS kept
FROM matched
"""


@REGISTRY.query("op7_quality", _OP7_SQL)
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of and verdict on every document."""
    return quality_verdicts(table(spark, sf_dir, "documents"))


@REGISTRY.query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_tokens", count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@REGISTRY.query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.query("op10_neighbours")
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def _crc32_sql(strings: str) -> str:
    """CTEs that end in ``crc(s, crc)``: the CRC-32 of every ``s`` of the CTE ``strings``.

    A checksum is the exclusive or of what each byte leaves after the zero bytes behind it, and of what the initial value leaves.
    """
    return f"""
bits(b, v, n) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
steps AS (SELECT b, v FROM bits WHERE n = 8),
hexed AS (SELECT s, hex(encode(s)) AS h, length(hex(encode(s))) // 2 AS n FROM (SELECT DISTINCT s FROM {strings})),
longest AS (SELECT max(n) AS n FROM hexed),
left_by(hh, v, k) AS (
  SELECT printf('%02X', b), v, 0 FROM steps
  UNION ALL SELECT hh, xor(steps.v, left_by.v >> 8), k + 1 FROM left_by JOIN steps ON b = left_by.v & 255 WHERE k < (SELECT n FROM longest)),
start(v, k) AS (
  SELECT 4294967295::BIGINT, 0
  UNION ALL SELECT xor(steps.v, start.v >> 8), k + 1 FROM start JOIN steps ON b = start.v & 255 WHERE k < (SELECT n FROM longest)),
bytes AS (SELECT s, substr(h, 2 * i + 1, 2) AS hh, n - 1 - i AS k FROM (SELECT *, unnest(range(n)) AS i FROM hexed)),
summed AS (SELECT s, bit_xor(v) AS v FROM bytes JOIN left_by USING (hh, k) GROUP BY s),
crc AS (SELECT s, xor(xor(coalesce(summed.v, 0), start.v), 4294967295) AS crc FROM hexed JOIN start ON k = n LEFT JOIN summed USING (s))"""


_OP11_SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, true AS own, row_number() OVER () AS row, text FROM documents UNION ALL SELECT NULL, false, -row_number() OVER (), text FROM benchmark),
worded AS (
  SELECT doc_id, own, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT own, row, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT own, row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM worded, (VALUES (1), (2), (3)) AS sizes(n))),
{_crc32_sql("runs")},
features AS (SELECT own, row, crc % 10000 AS bucket FROM runs JOIN crc USING (s)),
shares AS (
  SELECT range AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t, (SELECT count(*) FROM features WHERE own)::DOUBLE AS s_all, (SELECT count(*) FROM features WHERE NOT own)::DOUBLE AS t_all
  FROM range(10000) LEFT JOIN (SELECT bucket AS range, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM features GROUP BY bucket) USING (range)),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM shares),
weights AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE own GROUP BY row),
scored AS (
  SELECT doc_id, row, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (row) WHERE own),
placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, row) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, place AS rank FROM scored LEFT JOIN (SELECT row, place FROM placed WHERE place <= 5 * n // 100) USING (row)
"""


@REGISTRY.query("op11_importance", _OP11_SQL)
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of one in twenty towards the benchmark's distribution."""
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


@REGISTRY.query("op12_passage_quality")
def op12_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.3)


_OP13_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
{_crc32_sql("given")},
hurt AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT given.*, crc % 20 AS how FROM given JOIN crc USING (s)), (VALUES (1), (2)) AS copies(copy) WHERE how <> 0 AND (copy = 1 OR how = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS ini FROM hurt),
rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows GROUP BY conv_id),
moves(state, x, after, role) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
inserted(state, k, after, said) AS (
  VALUES (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''), (0, 1, 2, chr(10) || 'user:'), (1, 1, 2, chr(10) || 'user:'), (2, 1, 3, chr(10) || 'assistant:'), (3, 1, 2, chr(10) || 'user:'),
  (0, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 2, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:')),
edits(state, x, edit, price, after, role) AS (
  SELECT state, NULL::VARCHAR, 'D', 4, state, NULL::VARCHAR FROM (VALUES (0), (1), (2), (3)) AS s(state)
  UNION ALL SELECT state, x, 'K', 0, after, NULL::VARCHAR FROM moves UNION ALL SELECT state, '', 'K', 0, state, NULL::VARCHAR FROM (VALUES (0), (1), (2), (3)) AS s(state)
  UNION ALL SELECT state, NULL::VARCHAR, 'R', 3, after, role FROM moves WHERE x <> 's'),
heads AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'said': ''}} AS best FROM (SELECT DISTINCT conv_id FROM given)
  UNION ALL
  SELECT h.conv_id, r.i, e.after,
         min({{'cost': (h.best).cost + 3 * k + price + CASE WHEN fault = 3 AND edit <> 'D' THEN 3 ELSE 0 END, 'audit': (h.best).audit || repeat('I', k) || edit,
               'said': (h.best).said || ins.said || CASE WHEN edit = 'D' THEN '' ELSE chr(10) || coalesce(e.role, r.role) || ':' || r.text END}})
  FROM heads h JOIN rows r ON r.conv_id IS NOT DISTINCT FROM h.conv_id AND r.i = h.i + 1 JOIN inserted ins ON ins.state = h.state
  JOIN edits e ON e.state = ins.after AND (e.x IS NULL OR e.x = r.ini) AND (edit = 'D' OR fault NOT IN (1, 2))
  GROUP BY h.conv_id, r.i, e.after),
ends_ AS (
  SELECT h.conv_id, min({{'cost': (h.best).cost + 3 * k, 'audit': (h.best).audit || repeat('I', k), 'said': (h.best).said || ins.said}}) AS best
  FROM heads h LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM h.conv_id JOIN inserted ins ON ins.state = h.state WHERE h.i = coalesce(c.n, 0) AND ins.after IN (0, 3) GROUP BY h.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, (best).cost::BIGINT AS cost, (best).audit AS audit, sha256(substr((best).said, 2)) AS repaired_sha256
FROM ends_ e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@REGISTRY.query("op13_repair", _OP13_SQL)
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return repair_reports(damaged(table(spark, sf_dir, "conversations")), F.col("present"))
