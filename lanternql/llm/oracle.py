"""DuckDB equivalents of the training-data queries whose SQL is long.

Written from the definitions, on whole tables; constants come from the operators.
"""

from __future__ import annotations

from . import pii, url_templates
from . import quality_rules as rules

SPACE = r"\x20\x09-\x0D"


def quality() -> str:
    symbols = "#*$%&|<>"
    common = ", ".join(f"('{w}')" for w in rules.WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'other' END AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{SPACE}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
inside AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 3) AS s(k) GROUP BY r),
c AS (
  SELECT w.r, doc_id, lang, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{SPACE}]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^{symbols}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars, regexp_replace(t, '[\x{{10000}}-\x{{10FFFF}}]', '', 'g') AS low
  FROM w LEFT JOIN inside ON inside.r = w.r),
h AS (
  SELECT r, lang, n_words, chars, length(regexp_replace(low, '[^\p{{Ll}}\p{{Lo}}\p{{Nd}}]', '', 'g')) AS plain, length(regexp_replace(low, '[^\p{{Lu}}]', '', 'g')) AS upper,
         chars - word_chars AS space, length(regexp_replace(regexp_replace(low, '[{symbols}]', '', 'g'), '[^\p{{P}}]', '', 'g')) AS punctuation, n_symbols AS symbol
  FROM c),
bins AS (
  SELECT r, lang, n_words, chars, unnest(['plain', 'upper', 'space', 'punctuation', 'symbol', 'other']) AS b, unnest([plain, upper, space, punctuation, symbol, chars - plain - upper - space - punctuation - symbol]) AS n
  FROM h),
med AS (
  SELECT lang, b, quantile_disc(n * {rules.SHARES} // chars, 0.5) + CASE WHEN 2 * count(*) FILTER (WHERE n * {rules.SHARES} // chars = 0) < count(*) THEN 0.5 ELSE 0 END AS m
  FROM bins WHERE n_words >= {rules.MIN_WORDS} AND chars >= {rules.MIN_CHARS} GROUP BY lang, b HAVING count(*) >= {rules.MIN_DOCS}),
cref AS (SELECT lang, b, m::DOUBLE / sum(m) OVER (PARTITION BY lang) AS q FROM med),
cd AS (
  SELECT r, min(sqrt(least(1, greatest(0, s / 2)))) AS far FROM (
    SELECT x.r, x.lang, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) AS s
    FROM (SELECT bins.r, cref.lang, n::DOUBLE / chars AS p, q FROM bins JOIN cref USING (b) WHERE chars >= {rules.MIN_CHARS}) AS x GROUP BY ALL) GROUP BY r),
tok AS (SELECT r, unnest(regexp_extract_all(translate(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '#*$%&|<>.,;:!?"''()[]{{}}/\-+=_~^`@', repeat(' ', 35)), '[^{SPACE}]+')) AS x FROM c),
total AS (SELECT r, count(*) AS n FROM tok GROUP BY r),
common(x) AS (VALUES {common}),
hit AS (SELECT r, x, count(*) AS n FROM tok SEMI JOIN common USING (x) GROUP BY ALL),
wbins AS (
  SELECT total.r, common.x AS b, coalesce(hit.n, 0) AS n, total.n AS total FROM total CROSS JOIN common LEFT JOIN hit ON hit.r = total.r AND hit.x = common.x
  UNION ALL
  SELECT total.r, ' ', total.n - coalesce((SELECT sum(n) FROM hit WHERE hit.r = total.r), 0), total.n FROM total),
wmean AS (
  SELECT lang, b, sum(n * {rules.UNIT} // total) AS m FROM wbins JOIN c USING (r)
  WHERE n_words >= {rules.MIN_WORDS} AND total >= {rules.MIN_COMMON} GROUP BY lang, b HAVING count(*) >= {rules.MIN_DOCS}),
wref AS (SELECT lang, b, m::DOUBLE / sum(m) OVER (PARTITION BY lang) AS q FROM wmean),
wd AS (
  SELECT r, min(sqrt(least(1, greatest(0, s / 2)))) AS far FROM (
    SELECT x.r, x.lang, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) AS s
    FROM (SELECT wbins.r, wref.lang, n::DOUBLE / total AS p, q FROM wbins JOIN wref USING (b) WHERE total >= {rules.MIN_COMMON}) AS x GROUP BY ALL) GROUP BY r),
f AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(cd.far, 0) <= {rules.MAX_CHAR_DISTANCE} AND coalesce(wd.far, 0) <= {rules.MAX_WORD_DISTANCE} AS kept
FROM f LEFT JOIN cd ON cd.r = f.r LEFT JOIN wd ON wd.r = f.r
"""


#: Kind, pattern, and the test a match must pass (m the match, g its digits).
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS BIGINT), 999))) <= 255"),
    (
        "card",
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(g[length(g) + 1 - i] AS INT) ELSE 2 * CAST(g[length(g) + 1 - i] AS INT) - CASE WHEN CAST(g[length(g) + 1 - i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) BETWEEN 9 AND 15"),
)


def _found(rank: int, kind: str, pattern: str, test: str) -> str:
    return f"""SELECT r, t, {rank} AS rank, '{kind}' AS kind, m, g, s, s + length(m) AS e FROM (
  SELECT r, t, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS g,
         CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d))) WHERE {test}"""


def personal_data() -> str:
    found = "\n  UNION ALL ".join(_found(i, *k) for i, k in enumerate(_KINDS))
    run = r"[\p{L}\p{N}]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
texts AS (SELECT count(*) AS n FROM d),
near AS (
  SELECT r, t, kind || ':' || m AS entity,
         CASE WHEN s > {pii.REACH} THEN regexp_replace(substring(t, s - {pii.REACH} + 1, {pii.REACH}), '^{run}+', '') ELSE substring(t, 1, s) END
         || chr(10) || CASE WHEN e + {pii.REACH} < length(t) THEN regexp_replace(substring(t, e + 1, {pii.REACH}), '{run}+$', '') ELSE substring(t, e + 1) END AS context
  FROM f),
contexts AS (SELECT DISTINCT entity, lower(context) AS context FROM near),
per AS (SELECT entity, count(*) AS contexts FROM contexts GROUP BY entity HAVING count(*) >= {pii.SUPPORT}),
pairs AS (
  SELECT entity, term, count(*) AS together FROM (SELECT entity, unnest(list_distinct(regexp_extract_all(context, '{run}{{{pii.MIN_TERM},}}'))) AS term FROM contexts)
  GROUP BY ALL HAVING count(*) >= {pii.SUPPORT}),
carriers AS (SELECT entity, count(DISTINCT r) AS n FROM near GROUP BY entity),
spread AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '{run}{{{pii.MIN_TERM},}}'))) AS term FROM d) SEMI JOIN pairs USING (term) GROUP BY term),
bad AS (
  SELECT pairs.entity, pairs.term FROM pairs JOIN per USING (entity) JOIN carriers USING (entity) JOIN spread USING (term), texts
  WHERE carriers.n < texts.n AND ln((together::DOUBLE / contexts) / (spread.n::DOUBLE / texts.n)) / -ln(carriers.n::DOUBLE / texts.n) >= {pii.DISCLOSURE}),
marked AS (SELECT DISTINCT t, term FROM near JOIN bad USING (entity)),
runs AS (
  SELECT t, ms[i] AS m, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT t, regexp_extract_all(t, '{run}+') AS ms, string_split_regex(t, '{run}+') AS ps FROM (SELECT DISTINCT t FROM marked)))),
terms AS (SELECT d.r, s, s + length(m) AS e FROM runs JOIN marked ON marked.t = runs.t AND lower(runs.m) = marked.term JOIN d ON d.t = runs.t),
every AS (SELECT r, rank, kind, s, e FROM f UNION ALL SELECT r, 9, 'term', s, e FROM terms),
joined AS (
  SELECT r, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (WHERE rank < 9) AS base
  FROM every GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined ON joined.r = d.r
"""


def urls() -> str:
    u = url_templates
    typed = r"""CASE WHEN regexp_full_match(st, '[0-9]+') THEN '{n}' || ex WHEN regexp_full_match(st, '[0-9]{4}-[0-9]{2}(-[0-9]{2})?') THEN '{d}' || ex
    WHEN regexp_full_match(st, '[0-9a-fA-F-]{8,}') AND regexp_matches(st, '[0-9]') THEN '{h}' || ex WHEN regexp_matches(st, '[0-9]') THEN '{x}' || ex WHEN starts_with(s, '{') THEN '{x}' ELSE s END"""
    fits = sorted(u.RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    when = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in fits]
    rule = "CASE " + " ".join(f"{w} THEN '{h}{p}'" for w, (_, h, p) in zip(when, fits)) + " END"
    verdict = "CASE " + " ".join(f"{w} THEN '{v}'" for w, (v, _, _) in zip(when, fits)) + " END"
    levels = ""
    for k in range(u.MAX_DEPTH):
        levels += f""",
child{k} AS (SELECT host, tpl, segs[{k + 1}] AS seg, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad, NOT starts_with(segs[{k + 1}], '{{') AS literal FROM tree{k} WHERE len(segs) > {k} GROUP BY ALL),
rare{k} AS (SELECT *, literal AND (n < {u.MIN_SHARE} * sum(n) OVER v OR count(*) FILTER (WHERE literal) OVER v > {u.MAX_LITERALS}) AS rare FROM child{k} WINDOW v AS (PARTITION BY host, tpl)),
pool{k} AS (SELECT host, tpl, sum(labelled) AS al, sum(bad) AS ab, count(*) AS branches FROM rare{k} WHERE literal AND NOT rare GROUP BY ALL),
name{k} AS (
  SELECT c.host, c.tpl, c.seg, CASE WHEN rare THEN '{{*}}' WHEN literal AND branches > 1 AND abs(bad - p * labelled) <= {u.Z} * sqrt(p * (1 - p) * labelled) + 1e-9 THEN '{{+}}' ELSE seg END AS name
  FROM (SELECT r.*, branches, CASE WHEN al > 0 THEN ab::DOUBLE / al ELSE 0 END AS p FROM rare{k} r LEFT JOIN pool{k} q ON q.host = r.host AND q.tpl = r.tpl) AS c),
tree{k + 1} AS (SELECT t.host, t.segs, t.n, t.labelled, t.bad, t.tpl || CASE WHEN m.name IS NULL THEN '' ELSE '/' || m.name END AS tpl FROM tree{k} t LEFT JOIN name{k} m ON m.host = t.host AND m.tpl = t.tpl AND len(t.segs) > {k} AND m.seg = t.segs[{k + 1}])"""
    return rf"""
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
cut AS (SELECT *, CASE WHEN path IN ('', '/') THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS ss FROM hp),
shape AS (
  SELECT page_id, host, path, list_transform(list_transform(CASE WHEN len(ss) > {u.MAX_DEPTH} THEN list_append(ss[1:{u.MAX_DEPTH - 1}], '{{rest}}') ELSE ss END,
    lambda s: {{'s': s, 'st': regexp_replace(s, '\.[A-Za-z]{{1,5}}$', ''), 'ex': regexp_extract(s, '\.[A-Za-z]{{1,5}}$', 0)}}), lambda z: {typed.replace("st,", "z.st,").replace("|| ex", "|| z.ex").replace("starts_with(s,", "starts_with(z.s,").replace("ELSE s END", "ELSE z.s END")}) AS segs
  FROM cut),
known AS (SELECT doc_id, count(*) AS labelled, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
tree0 AS (SELECT host, segs, count(*) AS n, coalesce(sum(labelled), 0) AS labelled, coalesce(sum(bad), 0) AS bad, '' AS tpl FROM shape LEFT JOIN known ON doc_id = page_id GROUP BY host, segs){levels},
rate AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad)::DOUBLE / sum(labelled) ELSE 0 END AS p FROM tree0),
purity AS (SELECT host, tpl, (sum(bad) + {u.PRIOR} * p) / (sum(labelled) + {u.PRIOR}) AS q FROM tree{u.MAX_DEPTH}, rate GROUP BY host, tpl, p)
SELECT page_id, shape.host, path, {rule.replace("host", "shape.host")} AS rule, coalesce({verdict.replace("host", "shape.host")}, CASE WHEN q >= {u.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM shape JOIN tree{u.MAX_DEPTH} t ON t.host = shape.host AND t.segs = shape.segs JOIN purity ON purity.host = t.host AND purity.tpl = t.tpl
"""
