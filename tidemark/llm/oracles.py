"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, first IS NOT NULL AND doc_id > first AS dropped FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT = f"""
WITH d AS (SELECT doc_id, sha256({LOWERED.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


LM = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS w3, generate_subscripts(w, 1) AS p FROM docs),
grams AS (SELECT doc_id, n, p, w3, lag(w3) OVER d AS w2, lag(w3, 2) OVER d AS w1 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
c1 AS (SELECT w3, count(*) AS c FROM grams GROUP BY ALL), o1 AS (SELECT doc_id, w3, count(*) AS c FROM grams GROUP BY ALL),
c2 AS (SELECT w2, w3, count(*) AS c FROM grams WHERE w2 IS NOT NULL GROUP BY ALL), o2 AS (SELECT doc_id, w2, w3, count(*) AS c FROM grams WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, count(*) AS c FROM grams WHERE w1 IS NOT NULL GROUP BY ALL), o3 AS (SELECT doc_id, w1, w2, w3, count(*) AS c FROM grams WHERE w1 IS NOT NULL GROUP BY ALL),
l1 AS (SELECT doc_id, w3, c1.c - o1.c AS c FROM o1 JOIN c1 USING (w3)),
l2 AS (SELECT doc_id, w2, w3, c2.c - o2.c AS c FROM o2 JOIN c2 USING (w2, w3)),
l3 AS (SELECT doc_id, w1, w2, w3, c3.c - o3.c AS c FROM o3 JOIN c3 USING (w1, w2, w3)),
looked AS (
  SELECT g.doc_id, p, greatest(1, (SELECT count(*) FROM words) - n) AS others, a.c AS u, b.c AS bi, t.c AS tri, x.c AS ctx1, y.c AS ctx2
  FROM grams g JOIN l1 a ON a.doc_id = g.doc_id AND a.w3 = g.w3
  LEFT JOIN l2 b ON b.doc_id = g.doc_id AND b.w2 = g.w2 AND b.w3 = g.w3
  LEFT JOIN l3 t ON t.doc_id = g.doc_id AND t.w1 = g.w1 AND t.w2 = g.w2 AND t.w3 = g.w3
  LEFT JOIN l1 x ON x.doc_id = g.doc_id AND x.w3 = g.w2
  LEFT JOIN l2 y ON y.doc_id = g.doc_id AND y.w2 = g.w1 AND y.w3 = g.w2),
s1 AS (SELECT *, CASE WHEN u > 0 THEN u ELSE 0.4::DOUBLE END / others::DOUBLE AS v1 FROM looked),
s2 AS (SELECT *, CASE WHEN bi > 0 THEN bi / ctx1::DOUBLE WHEN p >= 2 THEN 0.4::DOUBLE * v1 ELSE v1 END AS v2 FROM s1),
s3 AS (SELECT *, CASE WHEN tri > 0 THEN tri / ctx2::DOUBLE WHEN p >= 3 THEN 0.4::DOUBLE * v2 ELSE v2 END AS v3 FROM s2),
sums AS (SELECT doc_id, sum(ln(v3)) AS s FROM s3 GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / len(w), 6) AS mean_log_score FROM docs d LEFT JOIN sums USING (doc_id)
"""


REACH = """
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)"""

JACCARD = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),{REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(coalesce(root, d.doc_id), d.doc_id) AS component_id FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots ON a = d.doc_id
"""

VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),{REACH},
counts AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(coalesce(root, vec_id), vec_id) AS component_id, vec_id <= coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN roots r ON r.a = vec_id LEFT JOIN counts c ON c.a = vec_id
"""


def mixing(rounds: int = 3, seed: int = 7) -> str:
    out = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sizes GROUP BY source),
weighed AS (
  SELECT source, source_size, n, CAST([5.0, 2.0, 1.0][(n - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source AS s, CAST(source_size AS BIGINT) AS source_size,
         least(coalesce((SELECT arg_min(level, (cap / weight, n)) FROM levels WHERE level * weight <= cap) * weight, cap), cap) AS target FROM levels),
shares AS (
  SELECT doc_id, source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share,
         (('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sizes JOIN targets ON source IS NOT DISTINCT FROM s),
r0 AS (
  SELECT doc_id, source, size, source_size, target, CAST(floor(share) AS INTEGER) AS copies, 0 AS extra,
         target - floor(share) * source_size AS missing,
         CASE WHEN share > floor(share) THEN (u / (1 - u)) / ((share - floor(share)) / (1 - (share - floor(share)))) ELSE 0 END AS rank FROM shares)"""
    for k in range(rounds):
        out += f""",
w{k} AS (SELECT *, CASE WHEN extra = 0 AND size > 0 AND size <= missing THEN size ELSE 0 END AS want FROM r{k}),
e{k} AS (SELECT *, want > 0 AND sum(want) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) <= missing AS won FROM w{k}),
r{k + 1} AS (SELECT doc_id, source, size, source_size, target, copies, CASE WHEN won THEN 1 ELSE extra END AS extra, rank,
             missing - sum(CASE WHEN won THEN size ELSE 0 END) OVER (PARTITION BY source) AS missing FROM e{k})"""
    return out + f"\nSELECT doc_id, source, size, source_size, target, copies + extra AS copies, CAST((copies + extra) * size AS BIGINT) AS taken FROM r{rounds}"


def url_filter(depth: int = 4, fanout: int = 20, min_labels: int = 5, prior_weight: float = 4.0, reject: float = 0.8, rules: list[tuple[str, str, str]] | None = None) -> str:
    """The template tree by recursion, a level a step, down to the deepest path."""
    kind = """CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '{num}' WHEN regexp_matches(x, '^[0-9]+[.][A-Za-z]{1,5}$') THEN '{num}.{ext}'
      WHEN regexp_matches(x, '^[0-9a-f]{8,}$') THEN '{hex}' WHEN regexp_matches(x, '^[0-9A-Za-z_-]*[0-9][0-9A-Za-z_-]*$') THEN '{id}' ELSE x END"""
    rules = rules or [("example.com", "/en/7", "allow"), ("example.net", "/de/8", "block"), ("com", "/en/", "block"), ("net", "/de/", "allow"), ("org", "/es/", "block")]
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, a) for h, p, a in rules]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    z = "blocked / labels - (ab - blocked) / (al - labels)"
    return rf"""
WITH RECURSIVE urls AS (
  SELECT page_id, {LOWERED.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
parsed AS (
  SELECT *, {case(1)} AS rule, {case(2)} AS action,
         list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {kind}) AS segs FROM urls),
tree AS (
  SELECT host, segs, count(*) AS n, count(action) AS labels, count(*) FILTER (action = 'block') AS blocked, '' AS template, segs AS rest, 0 AS level FROM parsed GROUP BY host, segs
  UNION ALL (
    WITH here AS (SELECT * FROM tree WHERE len(rest) > 0),
    branch AS (SELECT host, template, rest[1] AS seg, sum(n) AS n, sum(labels)::DOUBLE AS labels, sum(blocked)::DOUBLE AS blocked FROM here GROUP BY ALL),
    node AS (SELECT host, template, count(*) AS kids, sum(n) AS all_n, sum(labels) AS al, sum(blocked) AS ab FROM branch WHERE NOT starts_with(seg, '{{') GROUP BY ALL),
    tokens AS (
      SELECT b.host, b.template, seg, CASE WHEN starts_with(seg, '{{') THEN seg WHEN kids > {fanout} AND n * kids <= all_n THEN '{{var}}' WHEN labels = 0 THEN '{{new}}'
        WHEN al > labels AND ({z}) * ({z}) > 4 * (ab / al * (1 - ab / al) * (1 / labels + 1 / (al - labels))) THEN seg ELSE '{{any}}' END AS token
      FROM branch b LEFT JOIN node k ON b.host = k.host AND b.template = k.template),
    grown AS (
      SELECT h.host, h.segs, h.n, h.labels, h.blocked, h.template || '/' || token AS template, list_slice(h.rest, 2, len(h.rest)) AS rest, h.level + 1 AS level
      FROM here h JOIN tokens t ON h.host = t.host AND h.template = t.template AND h.rest[1] = t.seg),
    ends AS (SELECT host, template, min(rest) AS a, max(rest) AS z FROM grown GROUP BY ALL),
    common AS (SELECT host, template, a <> z AS splits, len(list_filter(range(1, least(len(a), len(z)) + 1), lambda i: a[1:i] = z[1:i])) AS same FROM ends)
    SELECT g.host, segs, n, labels, blocked, g.template, CASE WHEN level < {depth} THEN rest WHEN splits THEN list_slice(rest, same + 1, len(rest)) ELSE [] END AS rest, level
    FROM grown g JOIN common c ON g.host = c.host AND g.template = c.template)),
final AS (SELECT host, segs, n, labels, blocked, template FROM tree QUALIFY row_number() OVER (PARTITION BY host, segs ORDER BY level DESC) = 1),
judged AS (
  SELECT host, template, sum(labels) AS l, (sum(blocked) + {prior_weight}::DOUBLE * coalesce((SELECT sum(blocked)::DOUBLE / nullif(sum(labels), 0) FROM final), 0.0)) / (sum(labels) + {prior_weight}::DOUBLE) AS purity
  FROM final GROUP BY ALL)
SELECT page_id, u.host, u.path, rule, coalesce(action, CASE WHEN l >= {min_labels} AND purity >= {reject}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, j.template, round(purity, 6) AS purity
FROM parsed u JOIN final p ON u.host = p.host AND u.segs = p.segs JOIN judged j ON p.host = j.host AND p.template = j.template"""


WORDS_ONLY = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{WORDS_ONLY}') AS w FROM documents),
items AS (SELECT * FROM (SELECT item_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{WORDS_ONLY}') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, p.n, i, item_id FROM places p JOIN windows v ON p.n = v.n AND p.g = v.g),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256::DOUBLE * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
scores AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT a, b, s FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
found AS (
  SELECT p.a, p.b, p.s, n.b AS nb, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank
  FROM positives p JOIN scores n ON n.a = p.a WHERE NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INT) AS rank, nb AS negative_id, s AS positive_score, ns AS negative_score FROM found WHERE rank <= 3
"""

AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
per AS (SELECT doc_id AS id, max(coalesce(quality, 0)) = 1 AS good, max(coalesce(toxic, 0)) = 1 AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM texts LEFT JOIN per ON doc_id = id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.x <> q.x AND r.x NOT IN (p.x, q.x) AND s.x NOT IN (p.x, q.x, r.x) AND t.x NOT IN (p.x, q.x, r.x, s.x)),
gone AS (
  SELECT part, o, least(CASE WHEN a THEN instr(o, 'A') ELSE 6 END, CASE WHEN b THEN instr(o, 'B') ELSE 6 END, CASE WHEN c THEN instr(o, 'C') ELSE 6 END,
         CASE WHEN d THEN instr(o, 'D') ELSE 6 END, CASE WHEN e THEN instr(o, 'E') ELSE 6 END) AS step, good, toxic FROM marked, orders),
sums AS (SELECT part, o, step, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM gone GROUP BY ALL),
fails AS (
  SELECT part, x, count(*) FILTER (bad) AS n, count(*) FILTER (bad AND many = 1) AS only
  FROM (SELECT part, x, CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS bad, a::INT + b::INT + c::INT + d::INT + e::INT AS many FROM marked, letters) GROUP BY ALL),
grid AS (SELECT part, o, step, o[step] AS x FROM (SELECT DISTINCT part FROM marked), orders, (SELECT unnest(range(1, 6)) AS step)),
full_ AS (SELECT g.*, coalesce(n, 0) AS removed, coalesce(good, 0) AS good_lost, coalesce(toxic, 0) AS toxic_lost FROM grid g LEFT JOIN sums USING (part, o, step))
SELECT part, o AS filter_order, CAST(step AS INT) AS step,
       CAST((SELECT count(*) FROM marked m WHERE m.part = f.part) - sum(removed) OVER (PARTITION BY part, o ORDER BY step) AS BIGINT) AS kept, removed, k.n - removed AS redundant, k.only AS unique_fails,
       good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM full_ f JOIN fails k USING (part, x)
"""


SQL = {"op1_line_dedup": LINES, "op3_exact_dedup": EXACT, "op4_embedding_dedup": VECTORS, "op7_lm_score": LM, "op8_jaccard": JACCARD, "op9_mixing": mixing(), "op10_url_filter": url_filter(), "op11_decontamination": DECONTAMINATION, "op12_hard_negatives": NEGATIVES, "op13_filter_audit": AUDIT}
