"""DuckDB SQL for every registered query that SQL can express.

The views of FIXTURES.md appear as CTEs over the pre-registered tables.
Counts and sums are cast to BIGINT; derived doubles are rounded to 6
places exactly as the Spark side rounds them.
"""

from __future__ import annotations

# ---------------------------------------------------------------- views
PAT = """pat AS (
  SELECT subject, predicate, object, frequency, concat(subject, '#-#', object) AS pair, src FROM (
    SELECT n_name AS subject, p_name AS predicate, p_type AS object, count(*) AS frequency, 0 AS src
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
    GROUP BY n_name, p_name, p_type
    UNION ALL
    SELECT concat('user', CAST(user_id % 25 AS VARCHAR)), event_type,
           concat('k', regexp_extract(props, '([0-9]+)', 1)), count(*), 1
    FROM events GROUP BY 1, 2, 3) t)"""

SETS = """sets AS (
  SELECT concat(o_orderpriority, '/', o_orderstatus) AS predicate,
         concat(c_mktsegment, '#-#', n_name) AS pair, count(*) AS frequency
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""

ONTO = """subclass AS (
  SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

EQ_CLASS = """eqc AS (
  SELECT DISTINCT n_name AS a, s_name AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

EQ_PROP = """eqp AS (SELECT DISTINCT p_name AS a, p_brand AS b FROM part)"""

LAB = """lab AS (SELECT CAST(doc_id % 97 AS VARCHAR) AS resource, source AS label, lang FROM documents)"""

SENT = """sent AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
         concat(' <e1> ', c_name, ' </e1> bought the <e2> ', p_name, ' </e2> . ') AS sentence,
         CASE WHEN l_discount = 0 THEN 'no_relation'
              ELSE concat('rel:', lower(p_type),
                          CASE WHEN l_linenumber % 2 = 0 THEN '(e1,e2)' ELSE '(e2,e1)' END) END AS relation
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN part ON l_partkey = p_partkey)"""

DEDUP = """dedup AS (
  SELECT sentence, relation FROM (
    SELECT sentence, relation, row_number() OVER (PARTITION BY sentence ORDER BY
      l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC,
      l_quantity DESC, relation DESC) AS rn
    FROM sent) x WHERE rn = 1)"""

REL = """rels AS (SELECT sentence, relation,
  CASE WHEN strpos(relation, '(') > 0 THEN substr(relation, 1, strpos(relation, '(') - 1)
       ELSE relation END AS rel FROM dedup)"""

MAP = """mapping AS (
  SELECT DISTINCT concat('rel:', lower(p_type)) AS rel, concat('prop:', lower(p_type)) AS prop FROM part
  UNION ALL SELECT 'no_relation', 'no_relation')"""

VEC = """vec AS (
  SELECT vec_id, label,
         CASE WHEN label = 0 THEN 'no_relation' ELSE concat('rel', CAST(label AS VARCHAR)) END AS rel,
         concat('P', CAST(label AS VARCHAR)) AS prop,
         CAST(floor(vec_id / 128) AS BIGINT) AS batch_id,
         1.0 / (1.0 + exp(-10.0 * CAST(embedding[1] AS DOUBLE))) AS gate
  FROM embeddings),
vlong AS (
  SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS component,
         CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
space AS (
  SELECT concat('P', CAST(e.label AS VARCHAR)) AS predicate, CAST(e.label AS BIGINT) AS row_order,
         v.component, avg(v.value) AS value
  FROM vlong v JOIN embeddings e ON v.vec_id = e.vec_id GROUP BY e.label, v.component),
vmap AS (SELECT DISTINCT rel, prop FROM vec)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- B: cleaning
B2 = "b2 AS (SELECT * FROM pat WHERE NOT regexp_matches(predicate, 'widget', 'i'))"
B3_ON_B2 = """b3 AS (SELECT * FROM b2 WHERE pair NOT IN (
  SELECT concat(subject, '#-#', object) FROM b2 GROUP BY subject, object HAVING count(*) <= 1))"""
B4_ON_B3 = "b4 AS (SELECT * FROM b3 WHERE frequency > 10)"
B5_ON_B4 = """b5 AS (SELECT * FROM b4 WHERE predicate NOT IN (
  SELECT predicate FROM b4 GROUP BY predicate HAVING count(*) <= 1))"""

PAT_COLS = "subject, predicate, object, frequency, pair, src"

IMPACT = """impact AS (
  SELECT predicate, CAST(size_before AS BIGINT) AS size_before, CAST(sum_before AS BIGINT) AS sum_before,
         CAST(size_after AS BIGINT) AS size_after, CAST(sum_after AS BIGINT) AS sum_after,
         CAST(size_before - size_after AS BIGINT) AS size_delta,
         CAST(sum_before - sum_after AS BIGINT) AS sum_delta,
         round((size_before - size_after) * 100.0 / size_before, 6) AS size_delta_pct,
         round((sum_before - sum_after) * 100.0 / sum_before, 6) AS sum_delta_pct
  FROM (SELECT predicate, count(*) AS size_before, sum(frequency) AS sum_before,
               count(*) FILTER (WHERE frequency > 1) AS size_after,
               coalesce(sum(frequency) FILTER (WHERE frequency > 1), 0) AS sum_after
        FROM pat GROUP BY predicate HAVING min(frequency) < 2) g)"""


def _hist(col: str, bins: int) -> str:
    return with_(PAT, IMPACT, f"""st AS (SELECT
    CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 ELSE min({col}) END AS lo,
    CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 ELSE max({col}) END AS hi FROM impact),
  cnt AS (SELECT CAST(least(floor(({col} - lo) * {bins} / (hi - lo)), {bins - 1}) AS BIGINT) AS bin,
                 count(*) AS n FROM impact, st WHERE {col} IS NOT NULL GROUP BY 1),
  edges AS (SELECT CAST(i AS BIGINT) AS bin, round(lo + i * ((hi - lo) / {bins}), 6) AS bin_lo,
                   round(lo + (i + 1) * ((hi - lo) / {bins}), 6) AS bin_hi
            FROM range({bins}) r(i), st)""") + """
SELECT e.bin, e.bin_lo, e.bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM edges e LEFT JOIN cnt c ON e.bin = c.bin"""


ORACLES: dict[str, str] = {
    "b1_with_pair": with_(PAT) + f"SELECT {PAT_COLS} FROM pat",
    "b2_drop_keyword_predicates": with_(PAT, B2) + f"SELECT {PAT_COLS} FROM b2",
    "b3_drop_rare_pairs": with_(PAT) + f"""SELECT {PAT_COLS} FROM pat WHERE pair NOT IN (
        SELECT concat(subject, '#-#', object) FROM pat GROUP BY subject, object HAVING count(*) <= 1)""",
    "b4_drop_infrequent": with_(PAT) + f"SELECT {PAT_COLS} FROM pat WHERE frequency > 10",
    "b5_drop_small_predicates": with_(PAT) + f"""SELECT {PAT_COLS} FROM pat WHERE predicate NOT IN (
        SELECT predicate FROM pat GROUP BY predicate HAVING count(*) <= 16)""",
    "b6_clean": with_(PAT, B2, B3_ON_B2, B4_ON_B3, B5_ON_B4) + f"SELECT {PAT_COLS} FROM b5",
    "b7_clean_from_summary": with_(PAT) + f"""SELECT {PAT_COLS} FROM pat
        WHERE NOT regexp_matches(predicate, 'widget', 'i')
          AND pair NOT IN (SELECT concat(subject, '#-#', object) FROM pat
                           GROUP BY subject, object HAVING count(*) < 2)
          AND frequency > 10
          AND predicate NOT IN (SELECT predicate FROM pat WHERE frequency < 2
                                GROUP BY predicate HAVING count(*) < 2)""",
    # ---------------------------------------------------------------- C
    "c1_predicate_distribution": with_(PAT) + "SELECT predicate, count(*) AS n_patterns FROM pat GROUP BY predicate",
    "c2_rare_patterns": with_(PAT) + f"SELECT {PAT_COLS} FROM pat WHERE frequency < 2",
    "c3_single_pattern_predicates": with_(PAT) + """SELECT predicate, count(*) AS size FROM pat
        GROUP BY predicate HAVING count(*) < 2""",
    "c4_single_rare_predicates": with_(PAT) + """SELECT predicate, count(*) AS size FROM pat
        WHERE frequency < 2 GROUP BY predicate HAVING count(*) < 2""",
    "c5_unrepeated_pairs": with_(PAT) + """SELECT subject, object, count(*) AS size FROM pat
        GROUP BY subject, object HAVING count(*) < 2""",
    "c6_profile_summary": with_(PAT, """pp AS (SELECT predicate, count(*) AS n,
            count(*) FILTER (WHERE frequency < 2) AS rare_n FROM pat GROUP BY predicate),
          qq AS (SELECT subject, object, count(*) AS n FROM pat GROUP BY subject, object)""") + """
        SELECT CAST((SELECT sum(n) FROM pp) AS BIGINT) AS patterns,
               CAST((SELECT sum(rare_n) FROM pp) AS BIGINT) AS patterns_freq1,
               CAST((SELECT count(*) FROM pp) AS BIGINT) AS predicates,
               CAST((SELECT count(*) FROM pp WHERE n < 2) AS BIGINT) AS single_pattern_predicates,
               CAST((SELECT count(*) FROM pp WHERE rare_n = 1) AS BIGINT) AS single_rare_predicates,
               CAST((SELECT count(*) FROM qq WHERE n < 2) AS BIGINT) AS unrepeated_pairs""",
    "c7_removal_impact": with_(PAT, IMPACT) + "SELECT * FROM impact",
    "c8_impact_histogram_sum": _hist("sum_delta_pct", 40),
    "c8_impact_histogram_size": _hist("size_delta_pct", 10),
    "c9_impact_extremes": with_(PAT, IMPACT) + """
        SELECT *, 'high' AS side FROM impact WHERE sum_delta_pct > 90
        UNION ALL SELECT *, 'low' AS side FROM impact WHERE sum_delta_pct < 10""",
    "c10_namespace_share": with_(PAT, "t AS (SELECT DISTINCT predicate FROM pat WHERE frequency < 2)") + """
        SELECT CAST(count(*) AS BIGINT) AS touched,
               CAST(count(*) FILTER (WHERE contains(predicate, 'ring')) AS BIGINT) AS with_needle,
               round(count(*) FILTER (WHERE contains(predicate, 'ring')) * 100.0 / count(*), 6) AS pct
        FROM t""",
    "c11_lookup_predicate": with_(PAT) + f"SELECT {PAT_COLS} FROM pat WHERE predicate = 'red bolt'",
    "c12_list_predicates": with_(PAT) + "SELECT DISTINCT predicate FROM pat WHERE contains(predicate, 'ring')",
    "c13_predicates_with_n_patterns": with_(SETS) + """SELECT predicate FROM sets
        GROUP BY predicate HAVING count(*) = 125""",
    "c14_pair_sets": with_(SETS) + """SELECT predicate, string_agg(pair, '|' ORDER BY pair) AS pair_list,
            CAST(count(*) AS BIGINT) AS n_pairs FROM sets
        WHERE predicate IN (SELECT predicate FROM sets GROUP BY predicate HAVING count(*) = 125)
        GROUP BY predicate""",
    "c15_equal_pair_sets": with_(SETS, """ps AS (SELECT predicate, list_sort(list(DISTINCT pair)) AS pairs
            FROM sets WHERE predicate IN (SELECT predicate FROM sets GROUP BY predicate HAVING count(*) = 125)
            GROUP BY predicate),
          g AS (SELECT pairs, min(predicate) AS set_rep, count(*) AS members FROM ps GROUP BY pairs)""") + """
        SELECT ps.predicate, g.set_rep, CAST(g.members - 1 AS BIGINT) AS n_equal
        FROM ps JOIN g ON ps.pairs = g.pairs""",
    "c16_relation_counts": with_(SENT, DEDUP, REL) + """SELECT rel, CAST(count(*) AS BIGINT) AS n_sentences
        FROM rels GROUP BY rel""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---------------------------------------------------------------- E: space
PROBS = """probs AS (
  SELECT p.subject, p.predicate, p.object, p.frequency, p.pair, p.src, CAST(t.tot AS BIGINT) AS tot,
         (CAST(p.frequency * 100 AS DOUBLE) / CAST(t.tot AS DOUBLE)) * 0.01 AS prob
  FROM pat p JOIN (SELECT predicate, sum(frequency) AS tot FROM pat GROUP BY predicate) t
    ON p.predicate = t.predicate)"""
DIMS = """dims AS (SELECT CAST(row_number() OVER (ORDER BY pair) - 1 AS BIGINT) AS component, pair AS label
  FROM (SELECT DISTINCT pair FROM pat) d)"""
ENT = """fp AS (SELECT predicate, pair, prob AS value FROM (
    SELECT predicate, pair, prob, row_number() OVER (PARTITION BY predicate, pair
      ORDER BY src, frequency DESC) AS rn FROM probs) x WHERE rn = 1),
  ent AS (SELECT fp.predicate, dims.component, fp.value FROM fp JOIN dims ON fp.pair = dims.label)"""
ROWS_ALL = """allrows AS (SELECT predicate, CAST(row_number() OVER (ORDER BY predicate) - 1 AS BIGINT) AS row_order
  FROM (SELECT DISTINCT predicate FROM pat) d)"""
PLIST = """plist AS (SELECT predicate, CAST(row_order AS BIGINT) AS row_order FROM (VALUES
  ('red bolt', 0), ('hot ring', 1), ('cold gear', 2), ('old rod', 3), ('no such name', 4)) v(predicate, row_order))"""
E5 = """e5 AS (SELECT predicate, CAST(dense_rank() OVER (ORDER BY component) - 1 AS BIGINT) AS component, value
  FROM ent WHERE predicate IN (SELECT predicate FROM plist) AND value <> 0)"""
E6 = """clones AS (SELECT predicate, base, CAST(k AS BIGINT) AS k FROM (VALUES
    ('red bolt_@1', 'red bolt', 0), ('red bolt_@2', 'red bolt', 1)) v(predicate, base, k)),
  d5 AS (SELECT count(DISTINCT component) AS d FROM e5),
  surv AS (SELECT predicate, CAST(row_number() OVER (ORDER BY row_order) - 1 AS BIGINT) AS row_order
    FROM plist WHERE predicate NOT IN (SELECT base FROM clones)),
  rows6 AS (SELECT * FROM surv
    UNION ALL SELECT predicate, (SELECT count(*) FROM surv) + k FROM clones),
  ent6 AS (SELECT * FROM e5 WHERE predicate NOT IN (SELECT base FROM clones)
    UNION ALL SELECT c.predicate, e.component, e.value FROM clones c JOIN e5 e ON e.predicate = c.base
    UNION ALL SELECT predicate, (SELECT d FROM d5) + k, 1.0 FROM clones)"""
E7 = """rows7 AS (SELECT * FROM rows6 UNION ALL SELECT 'no_relation', (SELECT max(row_order) + 1 FROM rows6)),
  ent7 AS (SELECT * FROM ent6 UNION ALL
    SELECT 'no_relation', CAST(i AS BIGINT), -1.0 FROM range((SELECT d + 2 FROM d5)) r(i))"""
SPACE_CTES = (PAT, PROBS, DIMS, ENT, PLIST, E5, E6, E7)


def _long(rows: str, ent: str) -> str:
    return f"""SELECT r.predicate, r.row_order, e.component, round(e.value, 6) AS value
  FROM {rows} r LEFT JOIN {ent} e ON e.predicate = r.predicate"""


TARGET = """t AS (SELECT component, value AS tv FROM ent WHERE predicate = 'red bolt'),
  sims AS (
    SELECT r.predicate, r.row_order,
      round(sqrt(greatest(na + coalesce(s.nb, 0) - 2 * coalesce(s.ab, 0), 0)), 6) AS euclidean,
      round(CASE WHEN na > 0 AND coalesce(s.nb, 0) > 0
                 THEN 1 - coalesce(s.ab, 0) / (sqrt(na) * sqrt(s.nb)) END, 6) AS cosine
    FROM allrows r
    LEFT JOIN (SELECT e.predicate, sum(e.value * coalesce(t.tv, 0)) AS ab, sum(e.value * e.value) AS nb
               FROM ent e LEFT JOIN t ON e.component = t.component GROUP BY e.predicate) s
      ON s.predicate = r.predicate,
    (SELECT coalesce(sum(tv * tv), 0) AS na FROM t) tn
)"""

ALLPAIRS = """norms AS (SELECT r.predicate, coalesce(n.sq, 0) AS sq FROM allrows r
    LEFT JOIN (SELECT predicate, sum(value * value) AS sq FROM ent GROUP BY predicate) n
      ON n.predicate = r.predicate),
  dots AS (SELECT a.predicate AS pa, b.predicate AS pb, sum(a.value * b.value) AS ab
    FROM ent a JOIN ent b ON a.component = b.component GROUP BY 1, 2),
  prs AS (SELECT x.predicate, y.predicate AS neighbor, x.sq AS qs, y.sq AS s, coalesce(d.ab, 0) AS ab
    FROM norms x CROSS JOIN norms y LEFT JOIN dots d ON d.pa = x.predicate AND d.pb = y.predicate),
  scored AS (
    SELECT predicate, neighbor, 'euclidean' AS metric, round(sqrt(greatest(qs + s - 2 * ab, 0)), 6) AS distance FROM prs
    UNION ALL
    SELECT predicate, neighbor, 'cosine', round(CASE WHEN qs > 0 AND s > 0 THEN 1 - ab / (sqrt(qs) * sqrt(s)) END, 6) FROM prs)"""

ORACLES.update({
    "e1_probabilities": with_(PAT, PROBS) + "SELECT subject, predicate, object, frequency, pair, src, tot, round(prob, 6) AS prob FROM probs",
    "e2_dimensions": with_(PAT, DIMS) + "SELECT component, label FROM dims",
    "e3_vectorise": with_(PAT, PROBS, DIMS, ENT) + "SELECT predicate, component, round(value, 6) AS value FROM ent",
    "e4_restrict_to": with_(PAT, PROBS, DIMS, ENT, PLIST) + _long("plist", "ent"),
    "e5_drop_zero_dims": with_(PAT, PROBS, DIMS, ENT, PLIST, E5) + _long("plist", "e5"),
    "e6_disambiguate": with_(PAT, PROBS, DIMS, ENT, PLIST, E5, E6) + _long("rows6", "ent6"),
    "e7_add_constant_row": with_(*SPACE_CTES) + _long("rows7", "ent7"),
    "e9_row_sums": with_(*SPACE_CTES) + """SELECT r.predicate, r.row_order,
        round(coalesce(sum(e.value), 0), 6) AS row_sum
        FROM rows7 r LEFT JOIN ent7 e ON e.predicate = r.predicate GROUP BY r.predicate, r.row_order""",
    "e8_to_wide": with_(*SPACE_CTES) + "SELECT predicate, component, round(value, 6) AS value FROM ent7 WHERE value <> 0",
    "e10_build_space": with_(*SPACE_CTES) + _long("rows7", "ent7"),
    "e10_space_dims": with_(PAT, PROBS, DIMS, ENT, PLIST, E5, E6) + """
        SELECT DISTINCT e5.component, dims.label FROM e5
          JOIN ent ON ent.predicate = e5.predicate AND ent.value = e5.value
          JOIN dims ON dims.component = ent.component
          WHERE e5.component = (SELECT count(DISTINCT x.component) FROM ent x
                                WHERE x.predicate IN (SELECT predicate FROM plist) AND x.value <> 0
                                  AND x.component < ent.component)
        UNION ALL SELECT (SELECT d FROM d5) + k, concat('add', CAST(k + 1 AS VARCHAR)) FROM clones""",
    "e11_pair_similarity": with_(PAT, PROBS, DIMS, ENT).rstrip() + """,
        a AS (SELECT component, value AS va FROM ent WHERE predicate = 'red bolt'),
        b AS (SELECT component, value AS vb FROM ent WHERE predicate = 'hot ring'),
        s AS (SELECT coalesce(sum(va * vb), 0) AS ab, coalesce(sum(va * va), 0) AS na,
                     coalesce(sum(vb * vb), 0) AS nb FROM a FULL OUTER JOIN b ON a.component = b.component)
        SELECT 'red bolt' AS a, 'hot ring' AS b, round(sqrt(greatest(na + nb - 2 * ab, 0)), 6) AS euclidean,
               round(CASE WHEN na > 0 AND nb > 0 THEN 1 - ab / (sqrt(na) * sqrt(nb)) END, 6) AS cosine FROM s""".replace(
        "\n        a AS", "\n        a AS", 1),
    "e12_similarities": with_(PAT, PROBS, DIMS, ENT, ROWS_ALL, TARGET) + "SELECT * FROM sims",
    "e13_top_similar": with_(PAT, PROBS, DIMS, ENT, ROWS_ALL, TARGET) + """
        SELECT metric, predicate, distance, rank FROM (
          SELECT metric, predicate, distance, CAST(row_number() OVER (PARTITION BY metric
                 ORDER BY distance NULLS LAST, predicate) AS INTEGER) AS rank
          FROM (SELECT 'euclidean' AS metric, predicate, euclidean AS distance FROM sims
                UNION ALL SELECT 'cosine', predicate, cosine FROM sims) u) x WHERE rank <= 10""",
    "e14_all_pairs_similarity": with_(PAT, PROBS, DIMS, ENT, ROWS_ALL, ALLPAIRS) + """
        SELECT predicate, metric, rank, neighbor, distance FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY predicate, metric
                 ORDER BY distance NULLS LAST, neighbor) AS BIGINT) AS rank FROM scored) x
        WHERE rank <= 10""",
})


# ---------------------------------------------------------------- D: ontology / derive
def _closure(roots_sql: str) -> str:
    return f"""roots AS ({roots_sql}),
  clo AS (SELECT root, root AS type FROM roots
          UNION SELECT c.root, s.child FROM clo c JOIN subclass s ON s.parent = c.type)"""


def with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


APPROX = """ap AS (SELECT DISTINCT predicate AS value FROM pat WHERE regexp_matches(predicate, 'ring|bolt', 'i')
    UNION SELECT DISTINCT b FROM eqp WHERE a IN (
      SELECT DISTINCT predicate FROM pat WHERE regexp_matches(predicate, 'ring|bolt', 'i')))"""
MATCH_AFRICA = """subs AS (SELECT type AS value FROM clo
    UNION SELECT b FROM eqc WHERE a IN (SELECT type FROM clo))"""

RULE_MEMBERS = """rp AS (
    SELECT r.rule, m.value AS predicate FROM (VALUES ('x:ring_africa', 'ring'), ('x:bolt_europe', 'bolt'),
        ('x:gear_rod_asia', 'gear|rod')) r(rule, rx),
      (SELECT DISTINCT predicate AS value FROM pat UNION SELECT DISTINCT b FROM eqp) m
    WHERE (regexp_matches(m.value, r.rx, 'i') AND m.value IN (SELECT predicate FROM pat))
       OR m.value IN (SELECT b FROM eqp WHERE a IN (SELECT predicate FROM pat)
                      AND regexp_matches(a, r.rx, 'i'))),
  rroots AS (SELECT * FROM (VALUES ('x:ring_africa', 'AFRICA'), ('x:bolt_europe', 'EUROPE'),
        ('x:gear_rod_asia', 'ASIA')) v(rule, root)),
  rs AS (SELECT DISTINCT rr.rule, x.value AS subject FROM rroots rr JOIN (
           SELECT root, type AS value FROM clo
           UNION SELECT c.root, e.b FROM clo c JOIN eqc e ON e.a = c.type) x ON x.root = rr.root),
  ro AS (SELECT * FROM (VALUES ('x:ring_africa', 'SMALL'), ('x:ring_africa', 'ECONOMY'),
        ('x:gear_rod_asia', 'PROMO'), ('x:gear_rod_asia', 'STANDARD')) v(rule, object)),
  art AS (SELECT p.subject, rp.rule AS predicate, p.object, p.pair, CAST(sum(p.frequency) AS BIGINT) AS frequency
    FROM pat p JOIN rp ON rp.predicate = p.predicate
    WHERE p.subject IN (SELECT subject FROM rs WHERE rs.rule = rp.rule)
      AND (rp.rule NOT IN (SELECT rule FROM ro) OR p.object IN (SELECT object FROM ro WHERE ro.rule = rp.rule))
    GROUP BY p.subject, rp.rule, p.object, p.pair)"""

ORACLES.update({
    "d1_filter_exact": with_(PAT) + f"SELECT {PAT_COLS} FROM pat WHERE predicate IN ('red bolt', 'hot ring', 'no such')",
    "d2_filter_contains": with_(PAT) + f"SELECT {PAT_COLS} FROM pat WHERE regexp_matches(predicate, 'ring|bolt', 'i')",
    "d3_equivalent_properties": with_(PAT, EQ_PROP) + """SELECT DISTINCT b AS value FROM eqp
        WHERE a IN (SELECT predicate FROM pat WHERE regexp_matches(predicate, 'ring', 'i'))""",
    "d4_approximate_match": with_(PAT, EQ_PROP, APPROX) + "SELECT value FROM ap",
    "d5_subtypes": with_rec(ONTO, _closure("SELECT 'AFRICA' AS root")) + "SELECT root, type FROM clo",
    "d6_equivalent_classes": with_rec(ONTO, EQ_CLASS, _closure("SELECT 'AFRICA' AS root")) + """
        SELECT DISTINCT b AS value FROM eqc WHERE a IN (SELECT type FROM clo)""",
    "d7_subtypes_match": with_rec(ONTO, EQ_CLASS, _closure("SELECT 'AFRICA' AS root"), MATCH_AFRICA) + "SELECT value FROM subs",
    "d8_resource_labels": with_(LAB) + """SELECT r.resource, coalesce(l.label, 'NULL') AS label
        FROM (SELECT DISTINCT resource FROM lab) r
        LEFT JOIN (SELECT resource, min(label) AS label FROM lab
                   WHERE lower(lang) = 'es' OR starts_with(lower(lang), 'es-') GROUP BY resource) l
          ON l.resource = r.resource""",
    "d9_artificial_property": with_rec(PAT, ONTO, EQ_CLASS, EQ_PROP, APPROX,
                                       _closure("SELECT 'AFRICA' AS root"), MATCH_AFRICA) + """
        SELECT subject, 'x:ringbolt' AS predicate, object, pair, CAST(sum(frequency) AS BIGINT) AS frequency
        FROM pat WHERE predicate IN (SELECT value FROM ap) AND object IN ('ECONOMY', 'SMALL')
          AND subject IN (SELECT value FROM subs)
        GROUP BY subject, object, pair""",
    "d10_artificial_properties": with_rec(PAT, ONTO, EQ_CLASS, EQ_PROP,
                                          _closure("SELECT DISTINCT root FROM (VALUES ('AFRICA'), ('EUROPE'), ('ASIA')) v(root)"),
                                          RULE_MEMBERS) + "SELECT subject, predicate, object, pair, frequency FROM art",
    "d11_extend_profile": with_rec(PAT, ONTO, EQ_CLASS, EQ_PROP, B2, B3_ON_B2, B4_ON_B3, B5_ON_B4,
                                   _closure("SELECT DISTINCT root FROM (VALUES ('AFRICA'), ('EUROPE'), ('ASIA')) v(root)"),
                                   RULE_MEMBERS) + f"""
        SELECT {PAT_COLS} FROM b5
        UNION ALL SELECT subject, predicate, object, frequency, pair, 2 AS src FROM art""",
})


# the shipped rules as rows: rule, predicate keywords, subject root, allowed objects or object root
_ORG, _PERSON = "http://dbpedia.org/ontology/Organisation", "http://dbpedia.org/ontology/Person"
_PLACES = {"city": "http://dbpedia.org/ontology/City", "country": "http://schema.org/Country",
           "region": "http://www.wikidata.org/entity/Q3455524"}
_SHIPPED = [
    ("org:city_of_headquarters", "headquarter", _ORG, "city", None), ("org:country_of_headquarters", "headquarter", _ORG, "country", None),
    ("org:stateorprovince_of_headquarters", "headquarter", _ORG, "region", None), ("per:cities_of_residence", "residence", _PERSON, "city", None),
    ("per:countries_of_residence", "residence", _PERSON, "country", None), ("per:stateorprovinces_of_residence", "residence", _PERSON, "region", None),
    ("org:alternate_names", "alias|alternatename", _ORG, None, None), ("per:alternate_names", "alias|alternatename", _PERSON, None, None),
    ("org:members", "employee|member", _ORG, None, _ORG), ("per:employee_of", "employee|member", _PERSON, None, _ORG),
    ("org:top_members_employees", "employee|member", _ORG, None, _PERSON)]


def _sql(v) -> str:
    return "NULL" if v is None else "'" + v + "'"


ORACLES["d10_profile_rules"] = with_rec(PAT, ONTO, f"""m AS (SELECT subject, frequency,
      'http://x/' || CASE split_part(predicate, ' ', 2) WHEN 'bolt' THEN 'headquarter' WHEN 'ring' THEN 'residence'
        WHEN 'gear' THEN 'aliasName' WHEN 'rod' THEN 'memberOf' ELSE 'other' END AS predicate,
      CASE object WHEN 'SMALL' THEN '{_PLACES["city"]}' WHEN 'ECONOMY' THEN '{_PLACES["country"]}'
        WHEN 'PROMO' THEN '{_PLACES["region"]}' WHEN 'STANDARD' THEN 'FRANCE' ELSE 'KENYA' END AS object
    FROM pat WHERE src = 0)""",
    f"""sc AS (SELECT child, parent FROM subclass UNION ALL SELECT * FROM (VALUES ('AFRICA', '{_ORG}'), ('EUROPE', '{_PERSON}')) v(child, parent))""",
    f"""clo AS (SELECT root, root AS type FROM (VALUES ('{_ORG}'), ('{_PERSON}')) v(root)
      UNION SELECT c.root, s.child FROM clo c JOIN sc s ON s.parent = c.type)""",
    "rules AS (SELECT * FROM (VALUES " + ", ".join(
        f"({_sql(a)}, {_sql(b)}, {_sql(c)}, {_sql(_PLACES.get(d))}, {_sql(e)})" for a, b, c, d, e in _SHIPPED)
    + ") v(rule, rx, root, place, object_root))") + """
    SELECT m.subject, r.rule AS predicate, m.object, m.subject || '#-#' || m.object AS pair, CAST(sum(m.frequency) AS BIGINT) AS frequency
    FROM m JOIN rules r ON regexp_matches(m.predicate, r.rx, 'i')
    WHERE m.subject IN (SELECT type FROM clo WHERE clo.root = r.root)
      AND (r.place IS NULL OR m.object = r.place)
      AND (r.object_root IS NULL OR m.object IN (SELECT type FROM clo WHERE clo.root = r.object_root))
    GROUP BY ALL"""


# ---------------------------------------------------------------- F: sentences
_STRIP = "replace(replace(replace(replace(sentence, '<e1>', ''), '</e1>', ''), '<e2>', ''), '</e2>', '')"
TOKS = """toks AS (SELECT sentence, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS i FROM (
    SELECT sentence, list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> '') AS t FROM dedup) s),
  spans AS (SELECT d.sentence,
      CAST(coalesce(max(i) FILTER (WHERE tok = '<e1>'), 0) AS BIGINT) AS e1_start,
      CAST(coalesce(max(i) FILTER (WHERE tok = '</e1>') - 2, 0) AS BIGINT) AS e1_end,
      CAST(coalesce(max(i) FILTER (WHERE tok = '<e2>') - 2, 0) AS BIGINT) AS e2_start,
      CAST(coalesce(max(i) FILTER (WHERE tok = '</e2>') - 4, 0) AS BIGINT) AS e2_end
    FROM dedup d LEFT JOIN toks ON toks.sentence = d.sentence GROUP BY d.sentence)"""
TAGS = f"""tags AS (SELECT sentence, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (
    SELECT sentence, list_filter(string_split_regex({_STRIP}, '\\s+'), lambda x: x <> '') AS t FROM dedup) s),
  tagged AS (SELECT sentence, pos, CASE
      WHEN starts_with(token, 'Customer#') THEN 'PERSON'
      WHEN token IN ('red', 'blue') THEN 'COLOR'
      WHEN token IN ('small', 'large') THEN 'SIZE'
      WHEN token IN ('old', 'new') THEN 'AGE'
      WHEN token IN ('hot', 'cold') THEN 'TEMP'
      WHEN token IN ('anvil', 'bolt', 'gear', 'gizmo', 'plate', 'ring', 'rod', 'widget') THEN 'PRODUCT'
      ELSE 'O' END AS tag FROM tags),
  ends AS (SELECT sentence, 'e1' AS ent, e1_start AS pos FROM spans UNION ALL SELECT sentence, 'e1', e1_end FROM spans
    UNION ALL SELECT sentence, 'e2', e2_start FROM spans UNION ALL SELECT sentence, 'e2', e2_end FROM spans),
  types AS (SELECT e.sentence,
      string_agg(DISTINCT t.tag, ',' ORDER BY t.tag) FILTER (WHERE e.ent = 'e1' AND t.tag <> 'O') AS e1t,
      string_agg(DISTINCT t.tag, ',' ORDER BY t.tag) FILTER (WHERE e.ent = 'e2' AND t.tag <> 'O') AS e2t,
      count(DISTINCT t.tag) FILTER (WHERE e.ent = 'e1' AND t.tag <> 'O') AS n1,
      count(DISTINCT t.tag) FILTER (WHERE e.ent = 'e2' AND t.tag <> 'O') AS n2
    FROM ends e LEFT JOIN tagged t ON t.sentence = e.sentence AND t.pos = e.pos GROUP BY e.sentence)"""

ORACLES.update({
    "f1_strip_direction": with_(SENT, DEDUP, REL) + "SELECT sentence, relation, rel FROM rels",
    "f2_extract_entity": with_(SENT, DEDUP) + """SELECT sentence,
        regexp_extract(sentence, '<e1>(.*)</e1>', 1) AS e1, regexp_extract(sentence, '<e2>(.*)</e2>', 1) AS e2
        FROM dedup""",
    "f3_strip_markers": with_(SENT, DEDUP) + f"SELECT sentence, {_STRIP} AS clean FROM dedup",
    "f4_entity_spans": with_(SENT, DEDUP, TOKS) + "SELECT * FROM spans",
    "f5_entity_types": with_(SENT, DEDUP, TOKS, TAGS) + """SELECT sentence, CAST(n1 AS BIGINT) AS n_e1_types,
        CAST(n2 AS BIGINT) AS n_e2_types FROM types""",
    "f6_types_as_csv": with_(SENT, DEDUP, TOKS, TAGS) + """SELECT sentence, coalesce(e1t, '') AS e1_type_CNLP,
        coalesce(e2t, '') AS e2_type_CNLP FROM types""",
    "f7_prepare_sentences": with_(SENT, DEDUP, REL, TOKS, TAGS) + """SELECT r.sentence, r.relation, r.rel,
        regexp_extract(r.sentence, '<e1>(.*)</e1>', 1) AS e1, regexp_extract(r.sentence, '<e2>(.*)</e2>', 1) AS e2,
        coalesce(t.e1t, '') AS e1_type_CNLP, coalesce(t.e2t, '') AS e2_type_CNLP
        FROM rels r JOIN types t ON t.sentence = r.sentence""",
})


# ---------------------------------------------------------------- G / H: vectors
SIMS = """qn AS (SELECT vec_id, sum(value * value) AS qa FROM vlong GROUP BY vec_id),
  sn AS (SELECT predicate, row_order, sum(value * value) AS sb FROM space GROUP BY predicate, row_order),
  dots AS (SELECT v.vec_id, s.predicate, s.row_order, sum(v.value * s.value) AS ab
    FROM vlong v JOIN space s ON s.component = v.component GROUP BY 1, 2, 3),
  cs AS (SELECT d.vec_id, d.predicate, d.row_order,
      d.ab / (greatest(sqrt(q.qa), 1e-8) * greatest(sqrt(n.sb), 1e-8)) AS sim
    FROM dots d JOIN qn q ON q.vec_id = d.vec_id JOIN sn n ON n.predicate = d.predicate),
  best_first AS (SELECT * FROM (SELECT cs.*, row_number() OVER (PARTITION BY vec_id
      ORDER BY round(sim, 12) DESC, row_order ASC) AS rn FROM cs) x WHERE rn = 1),
  best_last AS (SELECT * FROM (SELECT cs.*, row_number() OVER (PARTITION BY vec_id
      ORDER BY round(sim, 12) DESC, row_order DESC) AS rn FROM cs) x WHERE rn = 1),
  inv AS (SELECT prop, max(rel) AS rel FROM vmap GROUP BY prop),
  gated AS (SELECT b.vec_id, v.rel AS y_true,
      CASE WHEN v.gate < 0.5 THEN inv.rel ELSE 'no_relation' END AS y_pred
    FROM best_first b JOIN vec v ON v.vec_id = b.vec_id LEFT JOIN inv ON inv.prop = b.predicate)"""

LOSSES = """tgt AS (SELECT v.vec_id, sum(v.value * s.value) AS ab, sum(s.value * s.value) AS tb
    FROM vlong v JOIN vec x ON x.vec_id = v.vec_id
    JOIN space s ON s.predicate = x.prop AND s.component = v.component GROUP BY v.vec_id),
  pl AS (SELECT x.vec_id, x.batch_id,
      CASE WHEN x.rel = 'no_relation' THEN CAST(0 AS DOUBLE)
           ELSE 1 - t.ab / sqrt((q.qa + 1e-12) * (t.tb + 1e-12)) END AS ploss,
      -((CASE WHEN x.rel = 'no_relation' THEN 1 ELSE 0 END) *
          (CASE WHEN x.gate <= 0 THEN -100 ELSE greatest(ln(x.gate), -100) END)
        + (1 - (CASE WHEN x.rel = 'no_relation' THEN 1 ELSE 0 END)) *
          (CASE WHEN 1 - x.gate <= 0 THEN -100 ELSE greatest(ln(1 - x.gate), -100) END)) AS gloss
    FROM vec x JOIN tgt t ON t.vec_id = x.vec_id JOIN qn q ON q.vec_id = x.vec_id)"""


def _report_sql(pred: str, labels: list[str]) -> str:
    vals = ", ".join(f"('{lab}', {i})" for i, lab in enumerate(labels))
    inlist = ", ".join(f"'{lab}'" for lab in labels)
    n = len(labels)
    return f"""per AS (SELECT l.label, l.label_order, coalesce(tp.n, 0) AS tp, coalesce(pn.n, 0) AS pn,
        coalesce(sp.n, 0) AS support
      FROM (VALUES {vals}) l(label, label_order)
      LEFT JOIN (SELECT y_true AS label, count(*) AS n FROM {pred} WHERE y_true = y_pred GROUP BY 1) tp ON tp.label = l.label
      LEFT JOIN (SELECT y_pred AS label, count(*) AS n FROM {pred} GROUP BY 1) pn ON pn.label = l.label
      LEFT JOIN (SELECT y_true AS label, count(*) AS n FROM {pred} GROUP BY 1) sp ON sp.label = l.label),
    pm AS (SELECT *, CASE WHEN pn > 0 THEN tp / pn ELSE CAST(0 AS DOUBLE) END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE CAST(0 AS DOUBLE) END AS recall FROM per),
    pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
        ELSE CAST(0 AS DOUBLE) END AS f1_score FROM pm),
    tot AS (SELECT sum(tp) AS stp, sum(pn) AS spn, sum(support) AS ssup, avg(precision) AS mp, avg(recall) AS mr,
        avg(f1_score) AS mf,
        CASE WHEN sum(support) > 0 THEN sum(precision * support) / sum(support) ELSE CAST(0 AS DOUBLE) END AS wp,
        CASE WHEN sum(support) > 0 THEN sum(recall * support) / sum(support) ELSE CAST(0 AS DOUBLE) END AS wr,
        CASE WHEN sum(support) > 0 THEN sum(f1_score * support) / sum(support) ELSE CAST(0 AS DOUBLE) END AS wf
      FROM pf),
    nout AS (SELECT count(*) AS n_out FROM (SELECT y_true AS t, y_pred AS p FROM {pred} GROUP BY 1, 2) g
      WHERE t NOT IN ({inlist}) OR p NOT IN ({inlist})),
    mic AS (SELECT CASE WHEN spn > 0 THEN stp / spn ELSE CAST(0 AS DOUBLE) END AS p,
        CASE WHEN ssup > 0 THEN stp / ssup ELSE CAST(0 AS DOUBLE) END AS r, ssup FROM tot),
    report AS (
      SELECT label, label_order, precision, recall, f1_score, support FROM pf
      UNION ALL SELECT CASE WHEN (SELECT n_out FROM nout) = 0 THEN 'accuracy' ELSE 'micro avg' END, {n}, p, r,
        CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE CAST(0 AS DOUBLE) END, ssup FROM mic
      UNION ALL SELECT 'macro avg', {n + 1}, mp, mr, mf, ssup FROM tot
      UNION ALL SELECT 'weighted avg', {n + 2}, wp, wr, wf, ssup FROM tot)"""


REPORT_OUT = """SELECT label, label_order, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM report"""


def _cm_sql(pred: str, labels: list[str]) -> str:
    vals = ", ".join(f"('{lab}')" for lab in labels)
    return f"""SELECT a.l AS actual, p.l AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
      FROM (VALUES {vals}) a(l) CROSS JOIN (VALUES {vals}) p(l)
      LEFT JOIN (SELECT y_true, y_pred, count(*) AS n FROM {pred} GROUP BY 1, 2) c
        ON c.y_true = a.l AND c.y_pred = p.l"""


QPRED = "qpred AS (SELECT doc_id, CAST(quality AS VARCHAR) AS y_true, CAST(toxic AS VARCHAR) AS y_pred FROM labels)"
EMB_LABELS = ["no_relation"] + [f"rel{i}" for i in range(1, 10)]
VOCAB = """vt AS (SELECT unnest(list_filter(string_split_regex(lower(sentence), '\\s+'), lambda x: x <> '')) AS token FROM rels),
  vocab AS (SELECT token, CAST(count(*) AS BIGINT) AS n FROM vt GROUP BY token)"""

# [CLS] ids [SEP], at most 160, padded to the longest; integer labels beside
ENCODED = """vid AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM vocab),
  cut AS (SELECT sentence, list_filter(string_split_regex(lower(sentence), '\\s+'), lambda x: x <> '')[1:158] AS t FROM rels),
  pos AS (SELECT sentence, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM cut),
  body AS (SELECT p.sentence, list(v.token_id ORDER BY p.k) AS ids FROM pos p JOIN vid v ON v.token = p.token GROUP BY p.sentence),
  raw AS (SELECT c.sentence AS id, list_concat(list_concat([2], coalesce(b.ids, [])), [3]) AS ids FROM cut c LEFT JOIN body b ON b.sentence = c.sentence),
  enc AS (SELECT id, array_to_string(ids, ',') || repeat(',0', (m - len(ids))::INT) AS input_ids,
      trim(repeat('1,', len(ids)::INT) || repeat('0,', (m - len(ids))::INT), ',') AS attention_mask
    FROM raw, (SELECT max(len(ids)) AS m FROM raw) mm)"""
LABELS = "il AS (SELECT rel, prop, CAST(rank() OVER (ORDER BY prop) - 1 AS BIGINT) AS int_label FROM mapping)"

ORACLES.update({
    "g1_map_relations": with_(SENT, DEDUP, REL, MAP) + """SELECT r.sentence, r.rel, m.prop
        FROM rels r LEFT JOIN mapping m ON m.rel = r.rel""",
    "g1_unmapped_count": with_(SENT, DEDUP, REL, MAP) + """SELECT CAST(count(*) AS BIGINT) AS n_unmapped
        FROM rels WHERE rel NOT IN (SELECT rel FROM mapping)""",
    "g2_integer_labels": with_(MAP) + "SELECT rel, prop, CAST(rank() OVER (ORDER BY prop) - 1 AS BIGINT) AS int_label FROM mapping",
    "g3_no_relation_flag": with_(SENT, DEDUP, REL) + """SELECT sentence, rel, rel = 'no_relation' AS is_no_relation,
        CASE WHEN rel = 'no_relation' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS attribute FROM rels""",
    "g4_label_vectors": with_(VEC) + """SELECT v.vec_id, s.component, round(s.value, 6) AS value
        FROM vec v JOIN vmap m ON m.rel = v.rel JOIN space s ON s.predicate = m.prop""",
    "g5_training_rows": with_(SENT, DEDUP, REL, MAP, LABELS, VOCAB, ENCODED) + """SELECT e.id, e.input_ids, e.attention_mask,
        (SELECT string_agg(CASE WHEN k = l.int_label THEN '1' ELSE '0' END, ',' ORDER BY k)
         FROM generate_series(0, (SELECT max(int_label) FROM il)) g(k)) AS target,
        r.rel, l.prop, l.int_label, r.rel = 'no_relation' AS is_no_relation,
        CASE WHEN r.rel = 'no_relation' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS attribute
        FROM enc e JOIN rels r ON r.sentence = e.id JOIN il l ON l.rel = r.rel""",
    "g8_encode_sequences": with_(SENT, DEDUP, REL, VOCAB, ENCODED) + "SELECT id, input_ids, attention_mask FROM enc",
    "g10_check_encoding": with_(SENT, DEDUP, REL) + "SELECT sentence AS id FROM rels WHERE length(sentence) % 7 = 0",
    "g6_check_label_vectors": with_(VEC) + """SELECT CAST(count(*) FILTER (WHERE vec_id % 7 = 0 OR prop NOT IN (SELECT predicate FROM space)) AS BIGINT) AS n_mismatch,
        CAST(count(*) FILTER (WHERE rel = 'no_relation') AS BIGINT) AS n_no_relation FROM vec""",
    "g7_check_nearest": with_(VEC, SIMS) + """SELECT b.vec_id, v.prop, b.predicate AS nearest,
        round(vs.s, 6) AS vec_sum, round(b.sim, 6) AS sim
        FROM best_last b JOIN vec v ON v.vec_id = b.vec_id
        JOIN (SELECT vec_id, sum(value) AS s FROM vlong GROUP BY vec_id) vs ON vs.vec_id = b.vec_id
        WHERE b.predicate <> v.prop""",
    "g9_build_vocabulary": with_(SENT, DEDUP, REL, VOCAB) + """SELECT token, n,
        CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + 4 AS BIGINT) AS token_id FROM vocab""",
    "g11_check_vector_owner": with_(VEC) + """SELECT CAST(count(*) AS BIGINT) AS n_rows,
        CAST(count(*) FILTER (WHERE vec_id % 7 <> 0 AND prop IN (SELECT predicate FROM space)) AS BIGINT) AS n_owned,
        CAST(count(*) FILTER (WHERE vec_id % 7 = 0 OR prop NOT IN (SELECT predicate FROM space)) AS BIGINT) AS n_mismatch FROM vec""",
    "g12_corruption_check": with_(VEC, SIMS) + """
        SELECT 'label_vectors' AS source, CAST(count(*) AS BIGINT) AS n_checked,
               CAST(count(*) FILTER (WHERE prop NOT IN (SELECT predicate FROM space)) AS BIGINT) AS n_corrupt FROM vec
        UNION ALL
        SELECT 'embeddings', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE ms < 1 - 1e-12) AS BIGINT)
        FROM (SELECT vec_id, max(sim) AS ms FROM cs GROUP BY vec_id) m""",
    "h1_nearest_property": with_(VEC, SIMS) + """SELECT vec_id, predicate AS nearest, row_order AS nearest_order,
        round(sim, 6) AS sim FROM best_first""",
    "h2_gated_predict": with_(VEC, SIMS) + "SELECT vec_id, y_true, y_pred FROM gated",
    "h2_gated_predict_scattered": with_(VEC, SIMS) + "SELECT vec_id, y_true, y_pred FROM gated",
    "i5_nearest_all_predicates": """
        WITH c AS (SELECT c_name, CAST(c_custkey * 3 AS BIGINT) AS o, c_nationkey AS n, CAST(c_acctbal AS DOUBLE) / 10000 AS a FROM customer),
        s AS (SELECT s_suppkey, s_nationkey AS n, CAST(s_acctbal AS DOUBLE) / 10000 AS a FROM supplier),
        sims AS (SELECT s_suppkey, c_name, o, (CASE WHEN s.n = c.n THEN 1 ELSE 0 END + s.a * c.a)
                 / (sqrt(1 + s.a * s.a) * sqrt(1 + c.a * c.a)) AS sim FROM s, c)
        SELECT s_suppkey, c_name AS nearest, o AS nearest_order, round(sim, 6) AS sim FROM (
          SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(sim, 12) DESC, o) AS rn FROM sims) x WHERE rn = 1""",
    "h3_top_class": with_(VEC, SIMS) + """SELECT b.vec_id, inv.rel AS y_pred FROM best_first b
        LEFT JOIN inv ON inv.prop = b.predicate""",
    "h4_projection_loss": with_(VEC, SIMS, LOSSES) + "SELECT round(avg(ploss), 6) AS projection_loss FROM pl",
    "h5_gate_loss": with_(VEC, SIMS, LOSSES) + "SELECT round(avg(gloss), 6) AS gate_loss FROM pl",
    "h6_composed_loss": with_(VEC, SIMS, LOSSES) + """SELECT round(avg(ploss) + avg(gloss), 6) AS loss,
        round(avg(ploss), 6) AS projection_loss, round(avg(gloss), 6) AS gate_loss FROM pl""",
    "h7_cross_entropy": with_(VEC, SIMS).rstrip() + """,
        il AS (SELECT prop, CAST(rank() OVER (ORDER BY prop) - 1 AS BIGINT) AS int_label FROM vmap),
        mx AS (SELECT vec_id, max(sim) AS m FROM cs GROUP BY vec_id),
        lse AS (SELECT c.vec_id, max(mx.m) + ln(sum(exp(c.sim - mx.m))) AS lse FROM cs c
                JOIN mx ON mx.vec_id = c.vec_id GROUP BY c.vec_id)
        SELECT round(avg(l.lse - c.sim), 6) AS cross_entropy FROM lse l JOIN vec v ON v.vec_id = l.vec_id
        JOIN il ON il.prop = v.prop JOIN cs c ON c.vec_id = l.vec_id AND c.row_order = il.int_label""",
    "h8_epoch_loss": with_(VEC, SIMS, LOSSES).rstrip() + """,
        pb AS (SELECT batch_id, avg(ploss) AS p, avg(gloss) AS g FROM pl GROUP BY batch_id)
        SELECT round(avg(p + g), 6) AS epoch_loss, round(avg(p), 6) AS epoch_projection_loss,
               round(avg(g), 6) AS epoch_gate_loss, CAST(count(*) AS BIGINT) AS n_batches FROM pb""",
    "h9_classification_report": with_(QPRED, _report_sql("qpred", ["0", "1"])) + REPORT_OUT,
    "h10_confusion_matrix": with_(QPRED) + _cm_sql("qpred", ["0", "1"]),
    "h11_evaluate": with_(VEC, SIMS, _report_sql("gated", EMB_LABELS)) + REPORT_OUT,
    "h11_confusion_matrix": with_(VEC, SIMS) + _cm_sql("gated", EMB_LABELS),
})


# ---------------------------------------------------------------- flagship
B4_MIN1 = "b4 AS (SELECT * FROM b3 WHERE frequency > 1)"
ORACLES["q0_most_probable_pairs"] = with_(PAT, B2, B3_ON_B2, B4_MIN1, B5_ON_B4).rstrip() + """,
  pr AS (SELECT b5.*, (CAST(frequency * 100 AS DOUBLE) / CAST(t.tot AS DOUBLE)) * 0.01 AS prob
         FROM b5 JOIN (SELECT predicate, sum(frequency) AS tot FROM b5 GROUP BY predicate) t
           ON t.predicate = b5.predicate)
SELECT predicate, subject, object, pair, round(prob, 6) AS prob FROM (
  SELECT pr.*, row_number() OVER (PARTITION BY pr.predicate ORDER BY prob DESC, pair) AS rn FROM pr) x
WHERE rn = 1""".replace("\n,\n", "\n", 0)


# ---------------------------------------------------------------- A: round trips, I: planned ops
ORACLES.update({
    "a1_read_patterns": ORACLES["b1_with_pair"],
    "a3_dedupe_last_label": with_(SENT, DEDUP) + "SELECT sentence, relation FROM dedup",
    "a2_read_marked_records": with_(SENT, DEDUP) + "SELECT sentence, relation FROM dedup",
    "a4_sentences_round_trip": ORACLES["f7_prepare_sentences"],
    "a5_space_round_trip": ORACLES["e10_build_space"],
    "a6_read_mapping": with_(MAP) + "SELECT rel, prop FROM mapping",
    "a7_read_property_list": with_(PAT) + """SELECT predicate,
        CAST(row_number() OVER (ORDER BY predicate) - 1 AS BIGINT) AS row_order FROM (SELECT DISTINCT predicate FROM pat) d""",
    "a8_materialise_label_vectors": ORACLES["g4_label_vectors"],
})

PREP = """prep AS (SELECT r.sentence, r.rel, coalesce(t.e1t, '') AS e1, coalesce(t.e2t, '') AS e2
    FROM rels r JOIN types t ON t.sentence = r.sentence)"""


def _mode_sql(col: str) -> str:
    return f"""mode_{col} AS (SELECT rel, t FROM (SELECT rel, t, row_number() OVER (PARTITION BY rel ORDER BY count(*) DESC, t) AS rn
      FROM (SELECT rel, unnest(string_split({col}, ',')) AS t FROM prep) x WHERE t <> '' GROUP BY rel, t) y WHERE rn = 1),
    cnt_{col} AS (SELECT rel, t, count(*) AS n FROM (SELECT rel, unnest(string_split({col}, ',')) AS t FROM prep) x
      WHERE t <> '' GROUP BY rel, t)"""


def _resolve_expr(col: str) -> str:
    return f"""CASE WHEN len(list_filter(string_split(p.{col}, ','), lambda x: x <> '')) > 1 THEN (
        SELECT c.t FROM (SELECT unnest(list_filter(string_split(p.{col}, ','), lambda x: x <> '')) AS t) u
        LEFT JOIN cnt_{col} c ON c.rel = p.rel AND c.t = u.t
        ORDER BY coalesce(c.n, 0) DESC, u.t LIMIT 1) ELSE p.{col} END"""


ORACLES.update({
    "i1_majority_type": with_(SENT, DEDUP, TOKS, TAGS).rstrip() + """,
      span_pos AS (SELECT sentence, 'e1' AS ent, unnest(range(e1_start, e1_end + 1)) AS pos FROM spans
        UNION ALL SELECT sentence, 'e2', unnest(range(e2_start, e2_end + 1)) FROM spans),
      cnt AS (SELECT s.sentence, s.ent, t.tag, count(*) AS n FROM span_pos s
        JOIN tagged t ON t.sentence = s.sentence AND t.pos = s.pos WHERE t.tag <> 'O' GROUP BY 1, 2, 3),
      best AS (SELECT sentence, ent, tag FROM (SELECT *, row_number() OVER (PARTITION BY sentence, ent
        ORDER BY n DESC, tag) AS rn FROM cnt) x WHERE rn = 1)
      SELECT d.sentence, b1.tag AS e1_major, b2.tag AS e2_major FROM dedup d
        LEFT JOIN best b1 ON b1.sentence = d.sentence AND b1.ent = 'e1'
        LEFT JOIN best b2 ON b2.sentence = d.sentence AND b2.ent = 'e2'""",
    "i2_impute_types": with_(SENT, DEDUP, REL, TOKS, TAGS, PREP, _mode_sql("e1"), _mode_sql("e2")) + """
      SELECT p.sentence, p.rel,
        CASE WHEN p.e1 = '' THEN coalesce(m1.t, '') ELSE p.e1 END AS e1_type_CNLP,
        CASE WHEN p.e2 = '' THEN coalesce(m2.t, '') ELSE p.e2 END AS e2_type_CNLP
      FROM prep p LEFT JOIN mode_e1 m1 ON m1.rel = p.rel LEFT JOIN mode_e2 m2 ON m2.rel = p.rel""",
    "i3_resolve_types": with_(SENT, DEDUP, REL, TOKS, TAGS, PREP, _mode_sql("e1"), _mode_sql("e2")) + f"""
      SELECT p.sentence, p.rel, {_resolve_expr("e1")} AS e1_type_CNLP, {_resolve_expr("e2")} AS e2_type_CNLP
      FROM prep p""",
    "i4_clones_from_mapping": with_(MAP).rstrip() + """,
      m AS (SELECT rel, regexp_replace(prop, '^prop:(small|medium|large)$', 'prop:size') AS prop FROM mapping)
      SELECT rel, prop, concat(prop, '_@', CAST(row_number() OVER (PARTITION BY prop ORDER BY rel) AS VARCHAR)) AS clone
      FROM m WHERE prop IN (SELECT prop FROM m GROUP BY prop HAVING count(*) > 1)""",
})

ORACLES["i6_instances_statistic"] = ORACLES["e3_vectorise"]
ORACLES["a4_sentences_csv_round_trip"] = ORACLES["f7_prepare_sentences"]

# fits: what is left of the equations that their results solve
ORACLES.update({
    "e15_pca_residual": """SELECT CAST(c AS BIGINT) AS component, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS overlap,
        CAST(0 AS DOUBLE) AS residual FROM range(1, 3) r(c)""",
    "h12_gate_gradient": with_(VEC) + """SELECT CAST(c AS BIGINT) AS component, CAST(0 AS DOUBLE) AS gradient
        FROM range((SELECT max(component) + 2 FROM vlong)) r(c)""",
    "h13_baseline_forward": with_(VEC) + """SELECT v.vec_id, CAST(0 AS DOUBLE) AS error, CAST(0 AS BIGINT) AS label_error
        FROM vec v JOIN vmap m ON m.prop = v.prop""",
    "h14_projector_residual": with_(VEC) + """SELECT DISTINCT s.component, CAST(0 AS DOUBLE) AS residual
        FROM vec v JOIN vmap m ON m.rel = v.rel JOIN space s ON s.predicate = m.prop
        WHERE v.rel <> 'no_relation' AND s.component IS NOT NULL AND s.value <> 0""",
    "g13_mini_batches": with_(VEC) + """SELECT vec_id, rel, CAST(floor(n / 128) AS BIGINT) AS batch_id, CAST(n % 128 AS BIGINT) AS pos_in_batch
        FROM (SELECT vec_id, rel, row_number() OVER (ORDER BY md5('7:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS n FROM vec) x""",
})
