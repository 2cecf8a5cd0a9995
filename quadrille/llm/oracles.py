"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .url_filters import MAX_BAD, RULES, STRENGTH, SURE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sets(name: str, table: str, key: str) -> str:
    """Distinct shingles of a table's texts, a text of under five words being one shingle."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""{name}_w AS (SELECT {key}, {words} AS w FROM {table}),
{name} AS (SELECT DISTINCT {key}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
  FROM (SELECT {key}, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM {name}_w WHERE len(w) > 0))"""


OP2 = f"""WITH {_sets("d", "documents", "doc_id")}, {_sets("b", "benchmark", "item_id")},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1), h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment FROM h JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item"""

OP6 = f"""WITH RECURSIVE {_sets("d", "documents", "doc_id")},
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), often AS (SELECT s FROM d GROUP BY 1 HAVING count(*) > 1), c AS (SELECT * FROM d WHERE s IN (SELECT s FROM often)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM c x JOIN c y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.b FROM r JOIN l ON l.a = r.v)
SELECT u AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(v) AS component_id FROM r LEFT JOIN n ON n.doc_id = u GROUP BY u"""


def _fits(h: str, p: str) -> str:
    return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"


def _strength(level: str) -> str:
    rho = "((sum(pow(k - n * m, 2)) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0))"
    return f"(SELECT greatest({STRENGTH[0]}, least({STRENGTH[1]}, coalesce(CASE WHEN {rho} > 0 THEN 1 / greatest({rho}, 1e-9) - 1 ELSE {STRENGTH[1]} END, {STRENGTH[1]}))) FROM {level} WHERE n > 0)"


def _op10() -> str:
    rules = sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), r[1:]), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    says = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in rules) + " END"
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM u),
w AS (SELECT page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM v),
lb AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
o AS (SELECT host, bad FROM w LEFT JOIN lb ON lb.doc_id = TRY_CAST(nullif(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1), '') AS BIGINT)),
h AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM o GROUP BY 1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2), x AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
x1 AS (SELECT *, (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) FROM x) AS m FROM x), x2 AS (SELECT suffix, (k + s * m) / (n + s) AS mean FROM (SELECT *, {_strength("x1")} AS s FROM x1)),
d1 AS (SELECT d.*, x2.mean AS m FROM d JOIN x2 USING (suffix)), d2 AS (SELECT domain, (k + s * m) / (n + s) AS mean FROM (SELECT *, {_strength("d1")} AS s FROM d1)),
h1 AS (SELECT h.*, d2.mean AS m FROM h JOIN d2 USING (domain)), h2 AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM (SELECT *, {_strength("h1")} AS s FROM h1)),
t AS (SELECT host, CASE WHEN {MAX_BAD} > a / (a + b) THEN b ELSE a END AS p, CASE WHEN {MAX_BAD} > a / (a + b) THEN a ELSE b END AS q, {MAX_BAD} > a / (a + b) AS turn FROM h2),
y AS (SELECT host, any_value(p) AS p, any_value(q) AS q, any_value(turn) AS turn, sum(exp(lgamma(p + q + i) - lgamma(p) - lgamma(q) - lgamma(p + 1 + i) + lgamma(p + 1) - ln(p) + (p + i) * ln(CASE WHEN turn THEN {1 - MAX_BAD} ELSE {MAX_BAD} END) + q * ln(CASE WHEN turn THEN {MAX_BAD} ELSE {1 - MAX_BAD} END))) AS v
  FROM (SELECT t.*, unnest(generate_series(0, 3000)) AS i FROM t) GROUP BY host),
r AS (SELECT host, CASE WHEN turn THEN v ELSE 1 - v END AS over FROM y)
SELECT page_id, host, path, {rule} AS rule, coalesce({says}, CASE WHEN over >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict, round(over, 6) + 0.0 AS p_bad FROM w JOIN r USING (host)"""


_TAB = """tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n)))"""
#: crc32 of the id as text, by its table tab.t.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"

LM_BASE = f"""WITH {_TAB}, f AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 10 = 0 AS held_out, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents, tab),
k AS (SELECT r, held_out, unnest(list_append(w, ' ')) AS tok FROM f), c AS (SELECT tok, count(*) AS c FROM k WHERE NOT held_out GROUP BY 1), n AS (SELECT coalesce(CAST(sum(c) AS BIGINT), 0) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))) AS b FROM n, k LEFT JOIN c USING (tok) GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(b, 6) AS base_score FROM f JOIN s USING (r), n"""

_ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = f"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda v: length(v) >= 6)) AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24)) AS n_hex FROM documents"""

EDITED = """SELECT doc_id, length(x) AS n_chars, sha256(substr(x, 1, length(x) - length(x) // 2) || substr(y, 1, length(x) // 2)) AS edited_sha256
FROM (SELECT doc_id, x, coalesce(lead(x) OVER (ORDER BY doc_id), first_value(x) OVER (ORDER BY doc_id)) AS y FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))"""


def _op11() -> str:
    byte = "flatten(list_transform(string_split(key, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(ch) - 64 AS BIGINT)] END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    runs = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')"
    return f"""WITH RECURSIVE {_TAB}, r AS (SELECT doc_id, unnest({runs}) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS key FROM r WHERE length(w) >= 5 GROUP BY 1, 2), h AS (SELECT w, n, {crc} AS h FROM c, tab),
x AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM x WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.cut UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.cut),
q AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN q USING (word)),
g AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL),
e AS (SELECT word, max_by(root, step) AS root FROM g GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)"""


ORACLE_SQL: dict[str, str] = {"op11_spelling_variants": _op11(), "op2_decontamination": OP2, "op6_jaccard_join": OP6, "op10_url_filter": _op10(), "lm_base_scores": LM_BASE, "secret_counts": SECRETS, "edited_digests": EDITED}
