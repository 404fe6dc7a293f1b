"""Registered queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableaudit.llm import decontaminate, exactdup, fingerprints, linkgraph, mixing, orcstore, pagetext, prefixtrie, quality, quotes, secretscan, simhash, turnrepair
from tableaudit.llm.common import table


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", simhash.as_hex(found.fp).alias("fingerprint"), "component_id")


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orcstore.round_trip(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op7_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(table(spark, sf_dir, "pages"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.rebuild(table(spark, sf_dir, "conversations"))
    return prefixtrie.prefix_trie(turns).drop("node", "parent")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turnrepair.repair_report(turnrepair.damage(conversations), conversations)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_weighted_fingerprints, op2_quotation_linking, op3_quality_classifier, op4_simhash_near_dedup, op5_token_orc,
        op6_secret_scan, op7_host_suffix_array, op8_benchmark_decontamination, op9_source_mixing, op10_link_graph, op11_prefix_trie, op12_turn_repair, op13_exact_dedup,
    )
}

OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS size, words[i : i + least(10, len(words)) - 1] AS win
       FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, words[i : i + size - 1] AS win
       FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes WHERE len(words) >= size)),
m AS (SELECT DISTINCT doc_id, i, size FROM dw WHERE win IN (SELECT win FROM bw)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT dw.doc_id, CAST(item_id AS VARCHAR) AS item FROM dw JOIN bw USING (size, win)) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
s1 AS (SELECT source, size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s0),
-- Sources in the order in which the limit of three times their size is met.
s2 AS (SELECT *, row_number() OVER (ORDER BY 3.0 * size / weight, source NULLS LAST) AS r FROM s1),
s3 AS (SELECT r, size, weight, (sum(size) OVER () - coalesce(sum(3 * size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate FROM s2),
rate AS (SELECT rate FROM s3 WHERE 3 * size >= weight * rate ORDER BY r LIMIT 1),
t AS (SELECT source, size AS source_size, CASE WHEN 3 * size < weight * rate THEN (3 * size)::DOUBLE ELSE weight * rate END AS target FROM s2, rate),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS copies FROM t),
o AS (SELECT doc_id, d.source, size, h, source_size, target, copies, greatest(target - copies * source_size, 0) AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, copies + CASE WHEN before + size <= budget OR (before <= budget AND floor((budget - before) / size + 0.5) >= 1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""

#: CRC-32 of a decimal string, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''),
    lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)))"""

# A node is named by its path; each node's weights go to every prefix of one path to it.
OP11_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, """ + CRC32.format("CAST(conv_id AS VARCHAR)") + r""" % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
t AS (SELECT c.conv_id, 0 AS kind, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND i <= h
      UNION ALL SELECT conv_id, 1, i, role, text FROM c JOIN o USING (conv_id) WHERE i > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY kind, i) AS depth, sha256(length(role) || ':' || role || text) AS said,
             CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM t),
p AS (SELECT conv_id, depth, string_agg(said, '/') OVER (PARTITION BY conv_id ORDER BY depth) AS path, string_agg(said, '/') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up, words,
             depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM r
      UNION ALL SELECT conv_id, 0, '', NULL, 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (SELECT path, any_value(CASE WHEN depth > 0 THEN coalesce(up, '') END) AS up, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last) AS ends FROM p GROUP BY path),
k AS (SELECT up AS path, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT a.path, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved FROM w JOIN p a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.path)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s USING (path) LEFT JOIN w u ON u.path = w.up
"""

# Costs and audits of the four states are carried from row to row; a struct's minimum is the cheapest, then the least audit.
OP12_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    """ + CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + r""" % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM o WHERE k > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
             left(role, 1) AS who FROM d),
f AS (SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
                     WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             coalesce(lag(who) OVER (PARTITION BY conv_id ORDER BY rn) || who NOT IN ('su', 'ua', 'au'), false) AS illegal FROM n),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM f),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS rn, {'c': 0::BIGINT, 't': ''} AS s0, {'c': 1000000000::BIGINT, 't': ''} AS s1,
              {'c': 1000000000::BIGINT, 't': ''} AS s2, {'c': 1000000000::BIGINT, 't': ''} AS s3 FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL
  SELECT conv_id, rn, {'c': s0.c + 4, 't': s0.t || 'D'},
         list_min([{'c': s1.c + 4, 't': s1.t || 'D'}] || CASE WHEN must OR who <> 's' THEN [] ELSE [{'c': s0.c + more, 't': s0.t || 'K'}] END),
         list_min([{'c': p2.c + 4, 't': p2.t || 'D'}] || CASE WHEN must THEN [] ELSE [{'c': b.c + more + 3, 't': b.t || 'R'}] END || CASE WHEN must OR who <> 'u' THEN [] ELSE [{'c': b.c + more, 't': b.t || 'K'}] END),
         list_min([{'c': p3.c + 4, 't': p3.t || 'D'}] || CASE WHEN must THEN [] ELSE [{'c': p2.c + more + 3, 't': p2.t || 'R'}] END || CASE WHEN must OR who <> 'a' THEN [] ELSE [{'c': p2.c + more, 't': p2.t || 'K'}] END)
  FROM (SELECT g.conv_id, g.rn, must, more, who, s0, s1,
               list_min([s2, {'c': s0.c + 3, 't': s0.t || 'I'}, {'c': s1.c + 3, 't': s1.t || 'I'}, {'c': s3.c + 3, 't': s3.t || 'I'}]) AS p2,
               list_min([s3, {'c': s0.c + 6, 't': s0.t || 'II'}, {'c': s1.c + 6, 't': s1.t || 'II'}, {'c': s2.c + 3, 't': s2.t || 'I'}]) AS p3,
               list_min([s0, s1, list_min([s3, {'c': s0.c + 6, 't': s0.t || 'II'}, {'c': s1.c + 6, 't': s1.t || 'II'}, {'c': s2.c + 3, 't': s2.t || 'I'}])]) AS b
        FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.rn = dp.rn + 1)),
best AS (SELECT conv_id, list_min([s0, s3, {'c': s2.c + 3, 't': s2.t || 'I'}, {'c': s1.c + 6, 't': s1.t || 'II'}]) AS e
         FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1),
l AS (SELECT conv_id, unnest(string_split(e.t, '')) AS edit, generate_subscripts(string_split(e.t, ''), 1) AS pos FROM best WHERE e.t <> ''),
m AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS rn, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS place FROM l),
j AS (SELECT m.*, g.role, g.text, bool_or(m.edit = 'K' AND m.place = 1 AND g.who = 's') OVER (PARTITION BY m.conv_id) AS led
      FROM m LEFT JOIN g ON m.edit <> 'I' AND g.conv_id IS NOT DISTINCT FROM m.conv_id AND g.rn = m.rn),
r AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END)
                                 || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS said FROM j WHERE edit <> 'D' GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM g GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.t, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
     LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY low)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY low ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(low) AS text_sha256
FROM d JOIN g USING (low)
"""

SQL = {"op8_benchmark_decontamination": OP8_SQL, "op9_source_mixing": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_turn_repair": OP12_SQL, "op13_exact_dedup": OP13_SQL}
