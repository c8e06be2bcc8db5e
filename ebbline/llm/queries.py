"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm.chat import format_chats
from ebbline.llm.decontaminate import contamination
from ebbline.llm.html import extract_main_text
from ebbline.llm.lm import score_documents
from ebbline.llm.minhash import near_duplicates
from ebbline.llm.mixing import mix
from ebbline.llm.quality import BASE_RULES, quality_report
from ebbline.llm.repair import COUNTS, damaged, repair_conversations
from ebbline.llm.sharding import shard_documents
from ebbline.llm.spelling import spelling_variants
from ebbline.llm.substring import substring_dedup
from ebbline.llm.suffix import suffix_array_dedup
from ebbline.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "n_copies", F.char_length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


#: Weights of sources in order, repeating.
MIX_WEIGHTS = [3, 1, 2]


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, budget_percent=150, max_epochs=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_class_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_documents(table(spark, sf_dir, "documents"), held_out)


def op9_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = shard_documents(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_report(table(spark, sf_dir, "documents"))
    failed = BASE_RULES[0].rejects(F.col) | BASE_RULES[1].rejects(F.col)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair_conversations(damaged(turns)).withColumnRenamed("conv_id", "repaired_id")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in COUNTS]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_benchmark_decontamination,
        op2_substring_dedup,
        op3_minhash_near_dedup,
        op4_suffix_array_dedup,
        op5_html_extraction,
        op6_chat_formatting,
        op7_source_mixing,
        op8_class_lm_scoring,
        op9_vector_sharding,
        op10_quality_rules,
        op11_toxicity,
        op12_spelling_variants,
        op13_conversation_repair,
    )
    return {f.__name__: f for f in every}


#: The same words as ebbline.llm.text and ebbline.llm.quality, in DuckDB's terms.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[c + 1 : c + 10], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS c FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, c, m, array_to_string(w[c + 1 : c + m], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS c FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
),
hit AS (SELECT doc_id, c, dw.m, item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(c, c + m)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos FROM dup),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 49)) AS s FROM d WHERE length(x) >= 100)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos FROM dup),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR before < pos - 1) AS spans FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * pos + 1, 2), '' ORDER BY pos) AS t FROM (SELECT doc_id, x, unnest(range(length(x) // 2)) AS pos FROM d SEMI JOIN g USING (doc_id)) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN x ELSE coalesce(kept.t, '') END)) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: For pages whose main text is one article, as in the given tables; references as html.escape writes them, and the named ones of the tables.
OP5_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*?)(</article>|<footer|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '(?i)</?(b|a|i|em|strong|span)( [^>]*)?>', '', 'g'), '(?i)</?[a-z][^>]*>', ' ', 'g') AS h FROM a),
c AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(x27|39);', chr(39), 'g'), '&amp;?', '&', 'g') AS h FROM b
)
SELECT page_id, url, trim(regexp_replace(h, '[ \t\n\r\f\v]+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(h, '[ \t\n\r\f\v]+', ' ', 'g'))) AS BIGINT) AS n_chars FROM c
"""

OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER w AS pos, '<|im_start|>' || coalesce(role, '') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS line
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
),
p AS (SELECT conv_id, pos, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos) AS r, max(pos) OVER (PARTITION BY conv_id) AS n FROM t),
e AS (SELECT min(conv_id) AS conv_id, n, r, count(*) AS n_copies FROM p WHERE pos = n GROUP BY n, r)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, CAST(length(r) AS BIGINT) AS n_chars, sha256(r) AS rendered_sha256
FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = e.n AND p.r = e.r)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
    (CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100 - coalesce(CAST(sum(cap) OVER o AS DOUBLE), 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
o AS (SELECT arg_min(level, ratio) AS level FROM l WHERE cap > level * weight),
t AS (SELECT l.source, source_size, CASE WHEN cap <= l.level * weight THEN CAST(cap AS DOUBLE) ELSE o.level * weight END AS target FROM l LEFT JOIN o ON true),
x AS (SELECT *, least(CAST(floor(target / greatest(source_size, 1)) AS BIGINT), 2) AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, source_size, target, whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 < target - whole * source_size AS more
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
)
SELECT doc_id, size, source_size, target, CAST((whole + CAST(more AS BIGINT)) * size AS BIGINT) AS taken FROM r
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
),
g AS (SELECT doc_id, c, array_to_string(w[c + 1 : c + 8], ' ') AS p FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS c FROM m WHERE len(w) >= 8)),
r AS (SELECT doc_id, unnest(list(c)) AS c FROM g GROUP BY doc_id, p HAVING count(*) > 1),
n AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(c, c + 8)) AS x FROM r) GROUP BY doc_id),
a AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
  FROM m LEFT JOIN n USING (doc_id)
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 10 * n_words OR 10 * n_dup_lines > 4 * n_lines) AS kept
FROM f
"""


#: crc32 as the functions of tables and lists have it: byte by byte over a table of 256 values that a rule gives.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))
)"""


def crc_of(codes: str) -> str:
    """The SQL of the crc32 of a list of bytes."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def edited(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """The SQL of an edit before the best edits from a state on."""
    lines = f"chr(10) || {line} || {state}.t" if line else f"{state}.t"
    return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 't': {lines}}}"


def row_edits(state: str, follows: str, after: str, system: bool = False) -> str:
    """The SQL of the best edit of a row in a state."""
    keeps = f"WHEN free AND ini = '{follows[0]}' THEN {edited(after, 'cut', 'K', "role || ':' || text")}"
    if system:
        keeps += f" WHEN free AND ini = 's' THEN {edited('s', 'cut', 'K', "role || ':' || text")}"
    rerole = edited(after, "2 + cut", "R", f"'{follows}:' || text")
    return f"least({edited(state, '3', 'D')}, CASE WHEN free THEN {rerole} END, CASE {keeps} END)"


#: UTF-8 bytes of a text whose letters are ASCII or U+00C0 to U+00FF.
LATIN_BYTES = "flatten(list_transform(string_split(k, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END))"

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY 1, 2
),
hashed AS (SELECT run, n, {crc_of("LATIN")} AS h FROM runs, crc_table),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2
),
del AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM del a JOIN v ON a.k = v.word
  UNION SELECT v.word, v.n, a.word, a.n FROM del a JOIN v ON a.k = v.word
),
best AS (SELECT word, count(*) AS n_near, min({{'k': -near_n, 'w': near}}) AS b FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.k >= 10 * v.n THEN b.w END AS form, CASE WHEN -b.k >= 10 * v.n THEN -b.k END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word
),
walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON w.next = f.word)
SELECT f.word, form, w.at AS root, n, n_near, form_n FROM forms f JOIN walk w ON f.word = w.word AND w.next IS NULL
""".replace("LATIN", LATIN_BYTES)

#: States: z nothing yet, s after system, u after user, a after assistant. The end of the rows, a row's own edit, inserts before it.
OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
filled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT f.*, {crc_of("list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))")} % 20 AS kind
  FROM filled f, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS full_text
  FROM damaged
),
judged AS (
  SELECT *, CASE WHEN full_text = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(full_text, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
),
steps AS (
  SELECT conv_id, n AS i, {{'c': 0, 'a': '', 't': ''}} AS z, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s,
    {{'c': 2, 'a': 'I', 't': chr(10) || 'assistant:'}} AS u, {{'c': 0, 'a': '', 't': ''}} AS a
  FROM (SELECT DISTINCT conv_id, n FROM judged)
  UNION ALL
  SELECT conv_id, i - 1, least(z, {edited('u', '2', 'I', "'user:'")}, {edited('ua', '2', 'I', "'user:'")}), least(s, {edited('u', '2', 'I', "'user:'")}, {edited('ua', '2', 'I', "'user:'")}),
    least(u, ua), least(a, {edited('u', '2', 'I', "'user:'")})
  FROM (
    SELECT *, {edited('a', '2', 'I', "'assistant:'")} AS ua FROM (
      SELECT e.conv_id, e.i, {row_edits('z', 'user', 'u', True)} AS z, {row_edits('s', 'user', 'u')} AS s, {row_edits('u', 'assistant', 'a')} AS u, {row_edits('a', 'user', 'u')} AS a
      FROM steps e JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CAST(fault = 'truncated' AS INT) AS cut FROM judged) j ON e.conv_id IS NOT DISTINCT FROM j.conv_id AND e.i = j.i
    )
  )
),
best AS (SELECT conv_id, CAST(z.c AS BIGINT) AS cost, z.a AS audit, substr(z.t, 2) AS lines FROM steps WHERE i = 0)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": OP1_SQL,
        "op2_substring_dedup": OP2_SQL,
        "op3_minhash_near_dedup": OP3_SQL,
        "op4_suffix_array_dedup": OP4_SQL,
        "op5_html_extraction": OP5_SQL,
        "op6_chat_formatting": OP6_SQL,
        "op7_source_mixing": OP7_SQL,
        "op10_quality_rules": OP10_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_conversation_repair": OP13_SQL,
    }
