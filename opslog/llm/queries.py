"""The queries of the training-data operators over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    decontaminate,
    language_id,
    line_dedup,
    packing,
    parity,
    secret_scan,
    simhash,
    spelling,
    token_files,
    topk,
    toxicity,
    turns,
    url_filter,
)
from .common import new_path, table

#: (verdict, host, path) that hold before the method's own verdict.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), weights=(1.0, 1e-3, 1e-3))


def op2_token_files(spark, sf_dir):
    path = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.read_digest(spark, path)


def op3_line_dedup(spark, sf_dir):
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op4_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    spans = decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(spans)


def op8_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_secret_scan(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return turns.digest(turns.repair(turns.damaged(conversations)), conversations)


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), slip_every=97)


def op13_ngram_jaccard(spark, sf_dir):
    return parity.jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_token_files,
        op3_line_dedup,
        op4_toxicity,
        op5_language_id,
        op6_simhash,
        op7_decontamination,
        op8_top_k,
        op9_url_filter,
        op10_secret_scan,
        op11_structure_repair,
        op12_spelling_variants,
        op13_ngram_jaccard,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 in DuckDB, bit by bit."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    bits = f"flatten(list_transform({octets}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, x: {step}), 4294967295)"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op3_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT id, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM d),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
marked AS (
  SELECT d.*, o.key IS NOT NULL AND o.last_doc IS DISTINCT FROM d.doc_id AS dropped FROM keyed d LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY id, doc_id""",
    "op7_decontamination": rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(k) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM w, lens, unnest(range(1, len(ws) - n + 2)) AS t(k)),
hits AS (SELECT doc_id, k, n, item FROM places JOIN win USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    # one row for each edit of a row: letter, states, the turns it leaves; dp keeps the least (cost, audit) for each state
    "op11_structure_repair": f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, {_crc32("k")} % 20 AS code FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS k FROM d),
f AS (
  SELECT *, CASE WHEN rtrim(text, {_BLANKS}) = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, {_BLANKS}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM o),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
g(a, r, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins AS (
  SELECT a, a AS b, '' AS audit, 0 AS cost, [] ::VARCHAR[] AS turns FROM (VALUES (0), (1), (2), (3)) AS t(a)
  UNION ALL SELECT a, b, 'I', 2, [CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM g WHERE r <> 's'
  UNION ALL SELECT x.a, y.b, 'II', 4, [CASE x.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END, CASE y.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END]
    FROM g x JOIN g y ON x.b = y.a WHERE x.r <> 's' AND y.r <> 's'),
own AS (
  SELECT conv_id, k, s AS a, s AS b, 'D' AS audit, 3 AS cost, [] ::VARCHAR[] AS turns FROM f, (VALUES (0), (1), (2), (3)) AS t(s)
  UNION ALL SELECT conv_id, k, a, b, 'K', CASE fault WHEN 'truncated' THEN 1 ELSE 0 END, [role || ':' || text]
    FROM f JOIN g ON left(role, 1) = r WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, k, a, b, 'R', CASE fault WHEN 'truncated' THEN 3 ELSE 2 END, [CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
    FROM f, g WHERE r <> 's' AND fault IN ('', 'truncated')),
step AS (
  SELECT conv_id, k, ins.a, own.b, ins.cost + own.cost AS cost, ins.audit || own.audit AS audit, list_concat(ins.turns, own.turns) AS turns
  FROM own JOIN ins ON ins.b = own.a),
dp AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS state, {{'cost': 0, 'audit': '', 'turns': []::VARCHAR[]}} AS best FROM n
  UNION ALL
  SELECT dp.conv_id, step.k, step.b,
         min({{'cost': dp.best.cost + step.cost, 'audit': dp.best.audit || step.audit, 'turns': list_concat(dp.best.turns, step.turns)}})
  FROM dp JOIN step ON dp.conv_id IS NOT DISTINCT FROM step.conv_id AND step.k = dp.k + 1 AND step.a = dp.state
  GROUP BY ALL),
done AS (
  SELECT dp.conv_id, min({{'cost': best.cost + ins.cost, 'audit': best.audit || ins.audit, 'turns': list_concat(best.turns, ins.turns)}}) AS best
  FROM dp JOIN n ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.k = n.n JOIN ins ON ins.a = dp.state WHERE ins.b IN (0, 3) GROUP BY 1)
SELECT i.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON i.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN done ON i.conv_id IS NOT DISTINCT FROM done.conv_id""",
    "op12_spelling_variants": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
t AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS k FROM w GROUP BY ALL),
h AS (SELECT run, n, {_crc32("k")} AS h FROM t),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS n_other FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON v.word = c.a || c.b
  UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON v.word = c.a || c.b),
best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, min({{'less': -n_other, 'other': other}}) AS top FROM near GROUP BY word),
forms AS (SELECT word, top.other AS form, -top.less AS form_n FROM best WHERE -top.less >= 2 * n),
walk AS (
  SELECT word, form AS last, 1 AS k FROM forms UNION ALL SELECT walk.word, forms.form, k + 1 FROM walk JOIN forms ON walk.last = forms.word),
roots AS (SELECT word, max_by(last, k) AS root FROM walk GROUP BY 1)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n
FROM v LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)""",
    "op13_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ 	-
]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(ws) - 3) + 1), lambda k: array_to_string(ws[k:k + 3], ' '))) AS grams
  FROM w WHERE len(ws) > 0),
class AS (SELECT min(doc_id) AS node, md5(array_to_string(list_sort(grams), chr(10))) AS name, any_value(grams) AS grams FROM s GROUP BY name),
g AS (SELECT node, unnest(grams) AS gram FROM class),
common AS (SELECT x.node AS a, y.node AS b, count(*) AS n_both FROM g x JOIN g y ON x.gram = y.gram AND x.node < y.node GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN class x ON x.node = a JOIN class y ON y.node = b
  WHERE 100 * n_both >= 85 * (len(x.grams) + len(y.grams) - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT node, node FROM class UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
named AS (SELECT md5(array_to_string(list_sort(grams), chr(10))) AS name, root FROM class JOIN least USING (node))
SELECT w.doc_id, coalesce(len(s.grams), 0)::BIGINT AS n_shingles, coalesce(named.root, w.doc_id) AS component_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN named ON named.name = md5(array_to_string(list_sort(s.grams), chr(10)))""",
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
