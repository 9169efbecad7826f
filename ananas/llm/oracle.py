"""DuckDB SQL for the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from ananas.llm import licenses

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, w[k:k + 12] AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
run AS (
  SELECT doc_id, k, n, w[k:k + n - 1] AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT len(x) AS n FROM win) WHERE len(w) >= n)
),
hit AS (SELECT doc_id, k, n, item FROM run JOIN win USING (x)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm(col: str) -> str:
    return f"trim(regexp_replace(translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"


OP2 = rf"""
WITH known(sid, norm) AS (SELECT sid, {_norm("s")} FROM (VALUES {", ".join(f"({k}, {_quoted(v)})" for k, v in licenses.SENTENCES.items())}) AS t(sid, s)),
rule(name, pattern) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(licenses.rule_pattern(ids))})" for n, ids in licenses.RULES)}),
part AS (
  SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS k
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.!?]+[\x20\x09\r\n]', chr(10), 'g'), '[\r\n]+') AS p FROM documents)
),
sentence AS (SELECT doc_id, k, {_norm("s")} AS norm FROM part),
seq AS (
  SELECT doc_id, count(*) FILTER (norm <> '') AS n_sentences, count(sid) AS n_known,
    coalesce(string_agg(',' || sid || ',', '' ORDER BY k) FILTER (sid IS NOT NULL), '') AS sequence
  FROM sentence LEFT JOIN known USING (norm) GROUP BY doc_id
)
SELECT doc_id, n_sentences::BIGINT AS n_sentences, n_known::BIGINT AS n_known, sequence,
  coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM rule WHERE regexp_matches(sequence, pattern)), '') AS licenses
FROM seq
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
lv AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM w
),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(own, cap / w) FROM lv WHERE own <= cap / w) * w), cap) AS target FROM lv),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, target - whole * source_size AS lack,
    CASE WHEN source_size > 0 THEN lack / source_size ELSE 0 END AS p
  FROM t
),
r AS (
  SELECT d.*, source_size, target, whole, lack, p, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, q / (1 + q) AS rank
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
),
g AS (SELECT source, rank, sum(size) AS words, any_value(lack) AS lack FROM r WHERE p > 0 GROUP BY source, rank),
c AS (SELECT source, rank, coalesce(sum(words) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + words / 2 <= lack AS more FROM g)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.rank = c.rank
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, w[k:k + 3] AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT id, b FROM reach JOIN link ON r = a)
SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id
"""

OP7 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT id, b FROM reach JOIN link ON r = a),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN n ON a = vec_id
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT html, max(page_id) AS m FROM p GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM p JOIN m USING (html)
"""

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS k FROM d WHERE len(h) >= 100)),
low AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT DISTINCT doc_id, k FROM win JOIN low USING (x) WHERE m < doc_id),
run AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT doc_id, min(k) AS s, max(k) + 50 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM run) GROUP BY doc_id, g),
gap AS (
  SELECT doc_id, coalesce(lag(e) OVER w, 0) AS a, s AS b FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT doc_id, max(e), NULL FROM span GROUP BY doc_id
),
kept AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP12 = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
d AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_replace(s, '[^A-Z]', '', 'g')) > 3 * len(s) AS c,
    regexp_matches(s, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY s), false) AS e,
    EXISTS (FROM labels l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good, EXISTS (FROM labels l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS toxic
  FROM t
),
f AS (SELECT row_number() OVER () AS r, *, a::INT + b::INT + c::INT + d::INT + e::INT AS fails FROM d),
x AS (SELECT r, part, good, toxic, fails, unnest(['A', 'B', 'C', 'D', 'E']) AS filter, unnest([a, b, c, d, e]) AS bad FROM f),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT v.x || w.x || x.x || y.x || z.x AS o FROM l v, l w, l x, l y, l z
  WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5
),
gone AS (SELECT r, o, min(instr(o, filter)) FILTER (bad) AS hit FROM x, o GROUP BY r, o),
cell AS (
  SELECT part, o, filter, instr(o, filter)::INT AS step,
    count(*) FILTER (hit IS NULL OR hit > instr(o, filter)) AS kept, count(*) FILTER (hit = instr(o, filter)) AS removed,
    count(*) FILTER (bad AND hit < instr(o, filter)) AS redundant, count(*) FILTER (bad AND fails = 1) AS unique_fails,
    count(*) FILTER (hit = instr(o, filter) AND good) AS good_lost, count(*) FILTER (hit = instr(o, filter) AND toxic) AS toxic_lost
  FROM x JOIN gone USING (r) GROUP BY ALL
)
SELECT part, o AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM cell
"""

OP13 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, list_inner_product(a.q, e.q)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0
),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1,
        "op2_licenses": OP2,
        "op4_mix": OP4,
        "op6_ngram_join": OP6,
        "op7_embedding_dedup": OP7,
        "op9_warc": OP9,
        "op10_suffix_dedup": OP10,
        "op12_filter_audit": OP12,
        "op13_hard_negatives": OP13,
    }
