"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from cribra.llm.licenses import TEMPLATES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')")
          + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k,
         array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT rid, dw.k AS k, i, item_id FROM dw JOIN win USING (k, win)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit
      FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hit)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls
           FROM documents),
l AS (SELECT rid, i, ls[i] AS line,
             {_LOWER.format("trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
      FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
r AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10),
t AS (SELECT rid, count(*) AS n_lines, count(r.k) AS n_dropped,
             string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.k IS NULL) AS kept
      FROM l LEFT JOIN r USING (k) GROUP BY rid)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN t USING (rid)
"""


def _op3() -> str:
    """Matches and gaps by two splits with one pattern; positions as running sums."""
    rules = (
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
         1, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
        ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
        ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
        ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    )
    parts = " UNION ALL ".join(f"""
      SELECT rid, {k} AS rule, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i,
             list_transform(g, lambda x: length(x)) AS gaps, list_transform(m, lambda x: length(x)) AS lens,
             list_transform(v, lambda x: length(x) >= {least}) AS ok
      FROM (SELECT rid, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m,
                   regexp_extract_all(t, '{p}', {group}) AS v FROM d)""" for k, (kind, p, group, least)
                               in enumerate(rules))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({parts}),
s AS (SELECT rid, rule, kind, list_sum(gaps[1:i]) + list_sum(lens[1:i]) AS e, lens[i] AS n, ok[i] AS ok FROM h),
k AS (SELECT rid, rule, kind, CAST(e - n AS BIGINT) AS b,
             kind || ':' || CAST(CAST(e - n AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS x
      FROM s WHERE ok),
a AS (SELECT rid, count(*) FILTER (WHERE rule = 0) AS n0, count(*) FILTER (WHERE rule = 1) AS n1,
             count(*) FILTER (WHERE rule = 2) AS n2, string_agg(x, ',' ORDER BY b, rule) AS spans,
             string_agg(x, ',' ORDER BY b, rule) FILTER (WHERE rule < 3) AS base
      FROM k GROUP BY rid)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


OP4 = """
WITH v AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0
           GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_GROUP = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {0}, 5) AS INTEGER) >> {1}) & 31), 1)"
    .format(1 + 5 * g, s) for g in range(8) for s in (15, 10, 5, 0))
OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_GROUP} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM l
"""



def _op11() -> str:
    """Every template's first key phrase is sought word by word; other keys and weights at its place."""
    def words(ws: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in ws) + "]"

    notices = ", ".join(f"({k}, '{t.label}', {t.base}, {words(t.words)})" for k, t in enumerate(TEMPLATES))
    keys = ", ".join(f"({k}, {n}, {at}, {words(key)})" for k, t in enumerate(TEMPLATES)
                     for n, (at, key) in enumerate(t.key_places()))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
t(tid, label, base, tw) AS (VALUES {notices}),
k(tid, nr, off, kw) AS (VALUES {keys}),
tj AS (SELECT tid, unnest(range(len(tw))) AS j, unnest(tw) AS x FROM t),
df AS (SELECT x, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS x FROM d)
       WHERE x IN (SELECT x FROM tj) GROUP BY x),
idf AS (SELECT tid, j, tj.x AS x, length(bin((SELECT count(*) FROM d) // (coalesce(df.n, 0) + 1))) AS weight
        FROM tj LEFT JOIN df USING (x)),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
c AS (SELECT p.rid, p.w, k.tid, p.i - k.off AS s FROM p JOIN k ON k.nr = 0 AND p.x = k.kw[1]),
v AS (SELECT rid, c.tid, s, any_value(w) AS w FROM c JOIN k USING (tid)
      GROUP BY rid, c.tid, s HAVING bool_and(w[s + off:s + off + len(kw) - 1] = kw)),
r AS (SELECT rid, tid, s, sum(CASE WHEN s + j >= 1 AND w[greatest(s + j, 1)] = x THEN weight ELSE 0 END)
             / sum(weight) AS share FROM v JOIN idf USING (tid) GROUP BY rid, tid, s),
a AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(s - 1) FILTER (WHERE base) AS first_word,
             max(s - 1) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM r JOIN t USING (tid) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (rid)
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text: each character is exclusive-ored in, then eight shifts (-1)."""
    steps = (f"list_concat([4294967295], flatten(list_transform(string_split({text}, ''),"
             " lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])))")
    return (f"xor(list_reduce({steps}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)"
            " ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)")


def _op12() -> str:
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(
            f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, start: str) -> str:
        return f"""
{name}(g, l, i, n, h) AS (
  {start}
  UNION ALL
  SELECT g, l + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY g, l, i // 3)"""

    def steps(name: str) -> str:
        """Left and right siblings of every node below its top."""
        return f"""
{name}_sides AS (
  SELECT x.g, x.l, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS lt,
         coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS rt
  FROM {name} x JOIN {name} y ON x.g = y.g AND x.l = y.l AND x.i // 3 = y.i // 3
  WHERE x.n > 1 GROUP BY x.g, x.l, x.i)"""

    even = _crc32("CAST(doc_id AS VARCHAR)") + " % 2 = 0"
    return f"""
WITH RECURSIVE d AS (
  SELECT *, {leaf("text")} AS leaf, CASE WHEN {even} THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END
         AS now FROM documents),
o AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY source) AS n FROM d),{levels("a", "SELECT g, 0, i, n, leaf FROM o")},
tops AS (SELECT g, h FROM a WHERE n = 1),{levels("b", "SELECT 0, 0, g, (SELECT count(*) FROM tops), h FROM tops")},
root AS (SELECT h AS root FROM b WHERE n = 1),{steps("a")},{steps("b")},
path AS (
  SELECT o.g, o.i, a.l, lt, rt FROM o JOIN a_sides a ON a.g = o.g
    AND a.i = o.i // CAST(power(3, a.l) AS BIGINT)
  UNION ALL
  SELECT o.g, o.i, 1000 + b.l, lt, rt FROM o JOIN b_sides b ON b.i = o.g // CAST(power(3, b.l) AS BIGINT)),
p AS (SELECT g, i, row_number() OVER (PARTITION BY g, i ORDER BY l) AS step,
             count(*) OVER (PARTITION BY g, i) AS last, lt, rt FROM path),
proof AS (SELECT g, i, string_agg(lt || rt, '' ORDER BY step) AS sibs FROM p GROUP BY g, i),
f(g, i, step, acc) AS (
  SELECT g, i, CAST(0 AS BIGINT), now FROM o
  UNION ALL
  SELECT f.g, f.i, p.step, sha256(lt || acc || rt) FROM f JOIN p ON p.g = f.g AND p.i = f.i AND p.step = f.step + 1),
folded AS (SELECT g, i, arg_max(acc, step) AS folded_root FROM f GROUP BY g, i)
SELECT doc_id, leaf, tops.h AS subroot, root, sha256(coalesce(sibs, '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM o JOIN tops USING (g) CROSS JOIN root JOIN folded USING (g, i) LEFT JOIN proof USING (g, i)
"""


OP13 = f"""
WITH c AS (
  SELECT conv_id, list({{'k': sha256(CAST(strlen(r) AS VARCHAR) || ':' || r || t), 'n': CAST(strlen(t) AS BIGINT)}}
                       ORDER BY turn NULLS FIRST, sha256(CAST(strlen(r) AS VARCHAR) || ':' || r || t)) AS own
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
        WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT conv_id, own, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM c),
s AS (SELECT h.conv_id, list_concat(CASE WHEN b.own IS NULL THEN [] ELSE b.own[1:h.h] END, h.own[h.h + 1:]) AS seq
      FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, d, seq[1:d] AS node, len(seq) = d AS ends
      FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ended
      FROM m GROUP BY d, node),
k AS (SELECT d - 1 AS d, node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
             CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * n.node[n.d].n END AS saved
      FROM n LEFT JOIN k ON k.d = n.d AND k.node = n.node),
u AS (SELECT e AS d, node[1:e] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved
      FROM (SELECT node, n_children, saved, unnest(range(d + 1)) AS e FROM w) GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves,
       CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ended, '')) AS ends_sha256
FROM w JOIN u ON u.d = w.d AND u.node = w.node
LEFT JOIN w p ON p.d = w.d - 1 AND p.node = w.node[1:w.d - 1]
"""

ORACLES = {"op1_decontamination": OP1, "op3_secret_scan": _op3(), "op4_nearest_neighbours": OP4,
           "op6_line_dedup": OP6, "op10_warc": OP10,
           "op11_license_scan": _op11(), "op12_merkle_manifest": _op12(), "op13_prefix_trie": OP13}
