"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, jaccard, langid, lines, lm, mixing, neardup, packing, ranked, repair, secrets, substring,
               toxicity)
from .common import fold, table


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (jaccard.join(table(spark, sf_dir, "documents"))
            .select("doc_id", "class_id", "n_links", "n_class_links", "component_id"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (secrets.scan(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring.dedup(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return (toxicity.score(docs, model)
            .select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix_sources(table(spark, sf_dir, "documents"), carry=[])
            .select("doc_id", "size", "source_size", "target", "taken", "source", "copies"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (langid.identify(docs)
            .select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "n_langs"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (lines.dedup(table(spark, sf_dir, "documents"), carry=[])
            .select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jaccard, op2_secrets, op3_lm, op4_substring, op5_toxicity, op6_ann, op7_packing, op8_mixing,
                                op9_neardup, op10_langid, op11_lines, op12_ranked, op13_repair)
}

#: crc32 of the ASCII string k, a bit at a time
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda v, nil: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT)"""

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
k AS (SELECT array_to_string(words, ' ') AS key, min(doc_id) AS class_id, count(*)::BIGINT AS copies,
             any_value(words) AS words
      FROM d WHERE len(words) > 0 GROUP BY 1),
s AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(words) < 5 THEN [key]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram FROM k),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS inter FROM s a JOIN s b USING (gram)
      WHERE a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.class_id = a JOIN n y ON y.class_id = b
      WHERE 5 * inter >= 4 * (x.n + y.n - inter)),
r AS (SELECT class_id AS a, class_id AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS class_id, min(b) AS component_id FROM r GROUP BY 1),
e AS (SELECT a AS class_id, count(*)::BIGINT AS n_class_links, sum(k.copies)::BIGINT AS linked
      FROM l JOIN k ON k.class_id = l.b GROUP BY 1)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id,
       coalesce(coalesce(e.linked, 0) + k.copies - 1, 0)::BIGINT AS n_links,
       coalesce(e.n_class_links, 0)::BIGINT AS n_class_links, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN k ON len(d.words) > 0 AND k.key = array_to_string(d.words, ' ')
LEFT JOIN c ON c.class_id = k.class_id LEFT JOIN e ON e.class_id = k.class_id
""",
    "op4_substring": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM d),
w AS (SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM s),
l AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT w.r, unnest(range(w.i, w.i + 13)) AS p FROM w JOIN l USING (win) WHERE l.least < w.doc_id),
gone AS (SELECT r, list(p) AS ps FROM g GROUP BY r),
k AS (SELECT doc_id, words, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (r))
SELECT doc_id, len(words)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256 FROM k
""",
    "op9_neardup": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT r, vec_id, label, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS norm FROM v
      WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
      WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
n AS (SELECT a, count(*)::BIGINT AS n FROM l GROUP BY a),
c AS (SELECT r AS a, r AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT c.a, min(v.vec_id) AS component_id FROM c JOIN v ON c.b = v.r GROUP BY c.a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON v.r = m.a LEFT JOIN n ON n.a = v.r
""",
    "op6_ann": r"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda e: e[1] * e[2])) AS score
      FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, source IS NULL AS no_src, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT no_src, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY no_src, src) - 1) % 3 + 1] AS weight,
             3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, most / weight AS ratio,
             (sum(source_size) OVER () - coalesce(sum(most) OVER (
                ORDER BY most / weight, no_src, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY most / weight, no_src, src
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(most, weight * (max(level) FILTER (WHERE level <= ratio) OVER ()))::DOUBLE AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size = 0 THEN 0.0 ELSE least(t.target / t.source_size, 3.0::DOUBLE) END AS per_doc,
             row_number() OVER (PARTITION BY d.no_src, d.src ORDER BY size, doc_id) - 1 AS by_size,
             count(*) OVER (PARTITION BY d.no_src, d.src) AS docs,
             CASE WHEN by_size % 2 = 0 THEN by_size // 2 ELSE docs - 1 - by_size // 2 END AS k,
             ('0x' || substr(md5('mix' || CASE WHEN d.no_src THEN ':n' ELSE ':s' || d.src END), 1, 4))::INT
               / 65536.0::DOUBLE AS start
      FROM d JOIN t ON d.no_src = t.no_src AND d.src = t.src),
c AS (SELECT *, least(floor(start + per_doc * (k + 1)) - floor(start + per_doc * k), 3)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
""",
    "op11_lines": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS nth FROM d),
k AS (SELECT r, doc_id, nth, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
g AS (SELECT r, list(nth) AS gone FROM k JOIN f USING (key)
      WHERE first IS NOT NULL AND (doc_id IS NULL OR doc_id > first) GROUP BY r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
       sha256(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10)))
         AS kept_sha256
FROM d LEFT JOIN g USING (r)
""",
    "op12_ranked": r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, list_transform(
           regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
           lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM t WHERE len(terms) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n
      FROM (SELECT r, doc_id, unnest(terms) AS term, len(terms) AS n FROM t) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM p, c GROUP BY term),
q AS (SELECT item_id, i, term, count(*)::BIGINT AS times FROM (
        SELECT item_id, row_number() OVER () AS i, unnest(list_transform(
           regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
           lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
        FROM benchmark) GROUP BY ALL),
s AS (SELECT i, any_value(q.item_id) AS item_id, any_value(p.doc_id) AS doc_id, sum(q.times * w.w * (
               (1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * c.n_docs) // c.n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY i, p.r),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""",
    "op13_repair": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, [CRC] % 20 AS draw FROM c),
e AS (SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
             CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM h WHERE draw <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || ':' || text), copy) AS k,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM e),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS prior,
             CASE WHEN final = '' THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                  WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM o),
-- states of the output: 0 nothing, 1 after s, 2 after u, 3 after a; the ways of one row from state to state
w AS (SELECT * FROM (VALUES (0, 0, 0, 0), (0, 1, 2, 1), (0, 2, 3, 2), (1, 0, 1, 0), (1, 1, 2, 1), (1, 2, 3, 2),
                            (2, 0, 2, 0), (2, 1, 3, 1), (2, 2, 2, 2), (3, 0, 3, 0), (3, 1, 2, 1), (3, 2, 3, 2))
             AS t(i, ins, mid, _)),
x AS (SELECT * FROM (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) AS t(out, mid, j)),
ways AS (
  SELECT y.sym, w.i, w.mid AS j, 5 * w.ins + 2 AS cost, repeat('I', w.ins) || 'D' AS audit
  FROM w, (VALUES ('sn'), ('un'), ('an'), ('xn'), ('st'), ('ut'), ('at'), ('xt'), ('d')) AS y(sym)
  UNION ALL
  SELECT x.out || y.t, w.i, x.j, 5 * w.ins + y.more, repeat('I', w.ins) || 'K'
  FROM w JOIN x USING (mid), (VALUES ('n', 0), ('t', 5)) AS y(t, more)
  UNION ALL
  SELECT z.r || y.t, w.i, x.j, 5 * w.ins + 1 + y.more, repeat('I', w.ins) || 'R'
  FROM w JOIN x USING (mid), (VALUES ('n', 0), ('t', 5)) AS y(t, more), (VALUES ('s'), ('u'), ('a'), ('x')) AS z(r)
  WHERE x.out <> 's'),
cells AS (SELECT s.sym, a.i AS i, b.j AS j FROM (SELECT DISTINCT sym FROM ways) s, range(4) a(i), range(4) b(j)),
best AS (SELECT sym, i, j, min({'c': cost, 'a': audit}) AS b FROM ways GROUP BY ALL),
matrix AS (SELECT sym, list(coalesce(b, {'c': 1000000000, 'a': ''}) ORDER BY i, j) AS m
           FROM cells LEFT JOIN best USING (sym, i, j) GROUP BY sym),
g AS (SELECT f.*, m FROM f JOIN matrix ON sym = CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' ELSE
        CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END || CASE fault WHEN 'truncated' THEN 't' ELSE 'n' END END),
r AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
             count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated,
             count(*) FILTER (WHERE prior || initial NOT IN ('su', 'ua', 'au')) AS illegal,
             list({'role': role, 'text': text} ORDER BY k) AS rows,
             list_reduce(list(m ORDER BY k), lambda p, q: list_transform(range(16), lambda ij: list_min(
               list_transform(range(4), lambda v: {
                 'c': p[(ij // 4) * 4 + v + 1].c + q[v * 4 + ij % 4 + 1].c,
                 'a': p[(ij // 4) * 4 + v + 1].a || q[v * 4 + ij % 4 + 1].a})))) AS m
      FROM g GROUP BY conv_id),
z AS (SELECT *, list_min([{'c': m[1].c, 'a': m[1].a}, {'c': m[2].c + 10, 'a': m[2].a || 'II'},
                          {'c': m[3].c + 5, 'a': m[3].a || 'I'}, {'c': m[4].c, 'a': m[4].a}]) AS b FROM r),
-- each letter of the audit with its row and, for letters that write, its place in the output
a AS (SELECT *, list_transform(range(1, length(b.a) + 1), lambda i: {
        'op': b.a[i], 'row': rows[length(replace(b.a[:i], 'I', ''))],
        'nth': length(replace(b.a[:i - 1], 'D', ''))}) AS steps FROM z),
u AS (SELECT *, list_filter(steps, lambda s: s.op <> 'D') AS outs FROM a),
v AS (SELECT *, CASE WHEN outs[1].op = 'K' AND outs[1].row.role[1] = 's' THEN 1 ELSE 0 END AS sys FROM u),
n AS (SELECT *, array_to_string(list_transform(outs, lambda s: CASE s.op WHEN 'K' THEN s.row.role
             ELSE CASE WHEN (s.nth - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' ||
             CASE s.op WHEN 'I' THEN '' ELSE s.row.text END), chr(10)) AS repaired FROM v)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id
""".replace("[CRC]", _CRC32),
}
