"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from sparkquiver.llm.queries import FORGED
from sparkquiver.llm.quality import CLASSES, COMMON, MAX_CHAR_DISTANCE, MAX_WORD_SHARE

_SPACE = "[\\x20\\x09-\\x0D]"
_WORDS = f"list_filter(regexp_split_to_array({{t}}, '{_SPACE}+'), lambda x: x <> '')"
#: Smallest id reachable in the links (a, b) among the ids.
_COMPONENT = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, root) AS (SELECT id, id FROM ids UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id WHERE r.root < e.b),
component AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id AS id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
ids AS (SELECT id FROM s), t AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT p.id AS a, q.id AS b FROM t p JOIN t q ON p.x = q.x AND p.id < q.id GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
{_COMPONENT}
SELECT s.id AS doc_id, len(s.s)::BIGINT AS n_shingles, root AS component_id, root = s.id AS kept FROM s JOIN component USING (id)"""

_TERM = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END"


def _distance(p: str, q: str, n: int) -> str:
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: {_TERM.format(p=f'{p}[i]', q=f'{q}[i]')})) / 2))"


_COUNT = "length(regexp_replace(t, '{not_}', '', 'g'))"
_CLASSES = ", ".join("length(regexp_replace(t, '{}', '', 'g'))".format((f"[^{rx[1:-1]}]" if not rx.startswith("[^") else "[\\x00-\\x7F]").replace("'", "''")) for rx in CLASSES.values())
_SHARES = "list_concat(list_transform({c}, lambda x: x / greatest({n}, 1)), [greatest(0, 1 - list_sum(list_transform({c}, lambda x: x / greatest({n}, 1))))])"
_MEAN = "[" + ", ".join("avg({c}[%d])" % i for i in range(1, len(CLASSES) + 2)) + "]"
_MEAN_WORDS = "[" + ", ".join("avg({c}[%d])" % i for i in range(1, len(COMMON) + 2)) + "]"

QUALITY = f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, lang, t, {_WORDS.format(t="t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
windows AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.s) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 's': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM m)),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE c > 1) GROUP BY doc_id),
common AS (SELECT doc_id, [{", ".join(f"count(*) FILTER (x = '{x}')" for x in COMMON)}] AS k FROM (SELECT doc_id, unnest(w) AS x FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, [{_CLASSES}] AS c, coalesce(k, list_transform(range({len(COMMON)}), lambda u: 0)) AS k FROM m LEFT JOIN repeated USING (doc_id) LEFT JOIN common USING (doc_id)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_SHARES.format(c="c", n="word_chars")} AS p, {_SHARES.format(c="k", n="n_words")} AS q FROM x),
r AS (SELECT lang, {_MEAN.format(c="p")} AS rp, {_MEAN_WORDS.format(c="q")} AS rq FROM y WHERE NOT base_failed GROUP BY lang),
z AS (SELECT y.*, rp, {_distance("p", "rp", len(CLASSES) + 1)} AS dc, {_distance("q", "rq", len(COMMON) + 1)} AS dw, {_distance("list_concat(list_transform(range(" + str(len(COMMON)) + "), lambda u: 0.0), [1.0])", "rq", len(COMMON) + 1)} AS far FROM y LEFT JOIN r ON y.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(dc, 6) AS char_distance, round(dw, 6) AS word_distance,
 NOT base_failed AND (rp IS NULL OR (dc <= {MAX_CHAR_DISTANCE} AND dw <= {MAX_WORD_SHARE} * far)) AS kept FROM z"""

#: Code points of an escaped text: a backslash goes before each of these.
_ESCAPED = "length({x}) + len(regexp_extract_all({x}, '\\\\')) + len(regexp_extract_all({x}, '<[|/sS]')) + len(regexp_extract_all({x}, '<')) - len(regexp_extract_all({x}, '<+')) + len(regexp_extract_all({x}, '(?i)\\[/?INST\\]'))"

CHAT = f"""WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '{FORGED}' UNION ALL SELECT -1, 1, 'assistant', '{FORGED}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(23 + {_ESCAPED.format(x="role")} + {_ESCAPED.format(x="text")})::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (SELECT p.r, p.vec_id AS a, q.r AS s, q.vec_id AS b FROM ok p JOIN ok q ON p.r < q.r AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.95),
links AS (SELECT a, b FROM near), ids AS (SELECT DISTINCT vec_id AS id FROM v WHERE vec_id IS NOT NULL),
{_COMPONENT},
degree AS (SELECT r, count(*) AS n FROM (SELECT r FROM near UNION ALL SELECT s FROM near) GROUP BY r)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, coalesce(vec_id = root, true) AS kept FROM v LEFT JOIN degree USING (r) LEFT JOIN component ON id = vec_id"""

ORACLE: dict[str, str] = {"op2_near_dedup": NEAR_DEDUP, "op3_quality_rules": QUALITY, "op7_chat_format": CHAT, "op9_embedding_dedup": EMBEDDINGS}
