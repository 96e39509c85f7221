"""DuckDB twins of the opN queries that SQL can express, by plain paths: exact counts, all pairs, all windows."""

from __future__ import annotations

from .licenses import PARAGRAPHS, TEMPLATES, terms_of
from .urls import LOWER, UPPER

LINES = """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
 bad AS (SELECT line FROM l WHERE length(line) >= 20 AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= 10),
 k AS (SELECT doc_id, string_agg(CASE WHEN bad.line IS NULL THEN l.line END, chr(10) ORDER BY i) AS text, count(*) AS n_lines, count(bad.line) AS n_removed FROM l LEFT JOIN bad ON l.line = bad.line GROUP BY 1)
 SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN k USING (doc_id)"""

WORDS = r"list_filter(string_split_regex({}, '{}'), lambda x: x <> '')"
LEAKS = rf"""WITH it AS (SELECT DISTINCT item_id, {WORDS.format('lower(text)', r'[^\p{L}\p{N}]+')} AS w FROM benchmark),
 n AS (SELECT count(*) AS n FROM it WHERE len(w) > 0),
 ish AS (SELECT DISTINCT item_id, m, h FROM (SELECT item_id, len(w) AS m, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS h FROM it WHERE len(w) >= 5)),
 wt AS (SELECT h, ln(1 + max(n) / count(*)) AS weight FROM ish, n GROUP BY 1), iw AS (SELECT item_id, sum(weight) AS item_weight FROM ish JOIN wt USING (h) GROUP BY 1),
 d AS (SELECT doc_id, {WORDS.format('lower(text)', r'[^\p{L}\p{N}]+')} AS w FROM documents),
 dsh AS (SELECT doc_id, len(w) - 4 AS size, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS h FROM d WHERE len(w) >= 5),
 seed AS (SELECT DISTINCT doc_id, size, pos, item_id, m FROM dsh JOIN ish USING (h)), held AS (SELECT * FROM dsh WHERE doc_id IN (SELECT doc_id FROM seed)),
 win AS (SELECT DISTINCT doc_id, item_id, m, unnest(range(least(greatest(0, pos - m + 5), greatest(0, least(pos, size - m + 4))), greatest(0, least(pos, size - m + 4)) + 1)) AS s FROM seed),
 ins AS (SELECT DISTINCT win.doc_id, win.item_id, win.m, win.s, held.h FROM win JOIN held ON held.doc_id = win.doc_id AND held.pos BETWEEN win.s AND win.s + win.m - 5),
 sc AS (SELECT ins.doc_id, ins.item_id, ins.m, ins.s, sum(coalesce(wt.weight, ln(1 + n.n))) AS a, sum(CASE WHEN ish.h IS NOT NULL THEN wt.weight ELSE 0 END) AS c FROM ins CROSS JOIN n LEFT JOIN wt ON wt.h = ins.h LEFT JOIN ish ON ish.item_id = ins.item_id AND ish.h = ins.h GROUP BY 1, 2, 3, 4),
 f AS (SELECT doc_id, item_id, s, m, round(c / (a + item_weight - c), 6) AS similarity FROM sc JOIN iw USING (item_id))
 SELECT doc_id, item_id, s AS start_word, m AS n_words, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS k FROM f WHERE similarity >= 0.8) WHERE k = 1"""

COMPONENTS = rf"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')", r'[\x20\x09-\x0D]+')} AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
 e AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS x, any_value(b.n) AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 k AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (x + y - c)), both_ AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
 r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a)
 SELECT s.doc_id, len(g) AS n_shingles, c.component_id FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c ON c.doc_id = s.doc_id"""


def _strength(level: str, k: str, n: str) -> str:
    return f"""(SELECT CASE WHEN rho <= 0 OR rho IS NULL THEN 1000.0 ELSE greatest(1.0, least(1000.0, 1 / rho - 1)) END FROM (SELECT CASE WHEN p * (1 - p) * (nn - nsq / nn - (m - 1)) = 0 THEN NULL ELSE (kk - nn * p * p - p * (1 - p) * (m - 1)) / (p * (1 - p) * (nn - nsq / nn - (m - 1))) END AS rho
 FROM (SELECT sum({n})::DOUBLE AS nn, sum({k})::DOUBLE / sum({n}) AS p, count(*)::DOUBLE AS m, sum({n} * {n})::DOUBLE AS nsq, sum({k} * {k} / {n})::DOUBLE AS kk FROM {level} WHERE {n} > 0)))"""


def url_filter(rules: list[tuple[str, str]], threshold: float = 0.3, z: float = 1.645) -> str:
    rule, verdict = "NULL", "NULL"
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{prefix}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    return rf"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
 o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
 hs AS (SELECT host, count(o.bad) AS n, coalesce(sum(o.bad), 0)::BIGINT AS k, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix FROM h LEFT JOIN o USING (page_id) GROUP BY host),
 ds AS (SELECT domain, suffix, sum(n)::BIGINT AS dn, sum(k)::BIGINT AS dk FROM hs GROUP BY 1, 2), ss AS (SELECT suffix, sum(dn)::BIGINT AS sn, sum(dk)::BIGINT AS sk FROM ds GROUP BY 1),
 c AS (SELECT (SELECT (sum(sk) + 1) / (sum(sn) + 10) FROM ss) AS p0, {_strength('ss', 'sk', 'sn')} AS s1, {_strength('ds', 'dk', 'dn')} AS s2, {_strength('hs', 'k', 'n')} AS s3),
 a AS (SELECT host, n, k, s3, (dk + s2 * ((sk + s1 * p0) / (sn + s1))) / (dn + s2) AS pd FROM hs JOIN ds USING (domain) JOIN ss ON ss.suffix = hs.suffix CROSS JOIN c),
 b AS (SELECT host, k + s3 * pd AS a, n - k + s3 * (1 - pd) AS b FROM a),
 v AS (SELECT host, a / (a + b) AS mean, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM b)
 SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN lower > {threshold} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_rate FROM h JOIN v USING (host)"""


def licence_scan(path_sql: str, threshold: float = 0.6) -> str:
    rows = ", ".join(f"({i}, '{name}', '{t}', {n})" for i, (name, text) in enumerate(TEMPLATES) for t, n in terms_of(text).items())
    names = "'^(LICENSE|LICENCE|COPYING|NOTICE)([.].*)?$'"
    cut = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""WITH tt(i, licence, term, f) AS (VALUES {rows}), d AS (SELECT doc_id, text, {path_sql.replace(' div ', ' // ')} AS path FROM documents),
 f AS (SELECT *, regexp_matches(regexp_extract(path, '[^/]*$'), {names}) AS named, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder FROM d),
 df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({cut("coalesce(text, '')")})) AS term FROM d) GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
 idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS w FROM (SELECT term FROM tt UNION SELECT term FROM df) LEFT JOIN df USING (term) CROSS JOIN n),
 u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), CASE WHEN regexp_matches(text, '{PARAGRAPHS}') THEN string_split_regex(text, '{PARAGRAPHS}') ELSE [] END, CASE WHEN named THEN [text] ELSE [] END)) AS unit FROM f WHERE text IS NOT NULL),
 ut AS (SELECT row_number() OVER () AS k, doc_id, {cut('unit')} AS terms FROM u), ux AS (SELECT k, doc_id, term, count(*) * max(w) AS x FROM (SELECT k, doc_id, unnest(terms) AS term FROM ut) JOIN idf USING (term) GROUP BY 1, 2, 3),
 nm AS (SELECT k, any_value(doc_id) AS doc_id, sqrt(sum(x * x)) AS norm FROM ux GROUP BY 1),
 tx AS (SELECT i, licence, term, f * w AS y FROM tt JOIN idf USING (term)), tn AS (SELECT i, any_value(licence) AS licence, sqrt(sum(y * y)) AS norm FROM tx GROUP BY 1),
 sc AS (SELECT k, i, sum(x * y) AS dot FROM ux JOIN tx USING (term) GROUP BY 1, 2),
 cs AS (SELECT nm.doc_id, tn.licence, round(dot / (nm.norm * tn.norm), 6) AS score FROM sc JOIN nm USING (k) JOIN tn USING (i)),
 own AS (SELECT doc_id, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS r FROM cs WHERE score >= {threshold}) WHERE r = 1),
 g AS (SELECT folder AS at, licence, score FROM (SELECT f.folder, own.licence, own.score, row_number() OVER (PARTITION BY f.folder ORDER BY own.score DESC, own.licence) AS r FROM f JOIN own USING (doc_id) WHERE named) WHERE r = 1),
 best AS (SELECT f.doc_id, g.at, g.licence, g.score, row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.at) DESC) AS r FROM f JOIN g ON f.folder = g.at OR starts_with(f.folder, g.at || '/') OR g.at = '')
 SELECT f.doc_id, f.path, coalesce(own.licence, best.licence) AS licence, coalesce(own.score, best.score) AS score, CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN best.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own.licence IS NOT NULL THEN f.folder ELSE best.at END AS from_folder
 FROM f LEFT JOIN own USING (doc_id) LEFT JOIN best ON best.doc_id = f.doc_id AND best.r = 1"""
