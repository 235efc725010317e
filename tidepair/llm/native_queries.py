"""Registered queries of the native operators, each beside its SQL twin."""

from .common import table
from .mixing import op5_mixing
from .quality import op9_quality_rules
from .urls import RULES, op1_url_filters

QUERIES = {
    "op1_url_filters": lambda spark, d: op1_url_filters(table(spark, d, "pages"), table(spark, d, "labels")),
    "op5_mixing": lambda spark, d: op5_mixing(table(spark, d, "documents")),
    "op9_quality_rules": lambda spark, d: op9_quality_rules(table(spark, d, "documents")),
}

#: Strength of a beta prior by moments, from a CTE {name}(n, f).
_PRIOR = """
{name}_t AS (SELECT CAST(sum(n) AS DOUBLE) AS t, coalesce(CAST(sum(f) AS DOUBLE) / nullif(CAST(sum(n) AS DOUBLE), 0), 0) AS mean FROM {name}),
{name}_m AS (SELECT CAST(sum(CAST(n / t * ((f / n - mean) * (f / n - mean)) AS DECIMAL(38, 15))) AS DOUBLE) AS dev,
  CAST(sum(CAST(n / t * (1 - n / t) AS DECIMAL(38, 15))) AS DOUBLE) AS w1, CAST(sum(CAST(n / t * (1 - n / t) / n AS DECIMAL(38, 15))) AS DOUBLE) AS w2
  FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(f AS DOUBLE) AS f FROM {name} WHERE n > 0), {name}_t),
{name}_p AS (SELECT mean, 1 / greatest(0.001, least(0.9, coalesce((dev - mean * (1 - mean) * w2) / nullif(mean * (1 - mean) * (w1 - w2), 0), 0.001))) - 1 AS strength
  FROM {name}_t, {name}_m)"""


def url_sql(z=1.645, limit=0.3) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    case = lambda k: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(a, h + p)[k]}'" for a, h, p in ordered)
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH seen AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages),
bad AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic <> 1 AND quality <> 0 THEN 0 END) AS bad FROM labels GROUP BY doc_id),
counts AS (SELECT host, count(*) AS n, sum(bad) AS f FROM seen
  JOIN bad ON doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) WHERE bad IS NOT NULL GROUP BY host),
h AS (SELECT s.host, coalesce(n, 0) AS n, coalesce(f, 0) AS f, regexp_extract(s.host, '([^.]*[.])?[^.]*$', 0) AS domain,
  list_extract(string_split(s.host, '.'), -1) AS suffix FROM (SELECT DISTINCT host FROM seen) s LEFT JOIN counts c ON s.host = c.host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(f) AS f FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(f) AS f FROM h GROUP BY ALL),
{_PRIOR.format(name="h")}, {_PRIOR.format(name="d")}, {_PRIOR.format(name="s")},
s2 AS (SELECT suffix, (f + mean * strength) / (n + strength) AS above FROM s, s_p),
d2 AS (SELECT domain, (f + above * strength) / (n + strength) AS above FROM d JOIN s2 USING (suffix), d_p),
h2 AS (SELECT host, n + strength AS size, (f + above * strength) / (n + strength) AS rate FROM h JOIN d2 USING (domain), h_p),
judged AS (SELECT page_id, host, path, CASE {case(1)} END AS rule, CASE {case(0)} END AS action, rate,
  rate - {z} * sqrt(rate * (1 - rate) / (size + 1)) > {limit} AS blocked FROM seen JOIN h2 USING (host))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS rate FROM judged"""


SIZE = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

#: Common expressions that mix documents {docs}: CTEs up to mixed(..., repeats).
MIXED = """
sized AS (SELECT *, SIZE AS size, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS turn FROM {docs}),
sources AS (SELECT source AS s, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT s, source_size, 3.0::DOUBLE * source_size AS cap,
  CASE (row_number() OVER (ORDER BY s NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sources),
lined AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS left_size, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_w, row_number() OVER o AS k
  FROM weighed WINDOW o AS (ORDER BY cap / w, s NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(arg_min(left_size / left_w, k) FILTER (WHERE cap / w >= left_size / left_w), 1e300) AS level FROM lined),
targets AS (SELECT s, source_size, CASE WHEN cap < level * w THEN cap ELSE level * w END AS target FROM weighed, level),
rated AS (SELECT z.*, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate,
  coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized z JOIN targets ON source IS NOT DISTINCT FROM s),
mixed AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN before + size / 2 < (rate - floor(rate)) * source_size THEN 1 ELSE 0 END AS repeats FROM rated)""".replace("SIZE", SIZE)

#: Common expressions that judge documents {docs}: CTEs up to judged(..., kept).
JUDGED = """
q0 AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
q1 AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM q0),
windows AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM q1)),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY rid),
q2 AS (SELECT q1.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM q1 LEFT JOIN covered USING (rid)),
q3 AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q2),
q AS (SELECT source AS h, count(*) AS n, sum(base_failed::INT) AS f FROM q3 GROUP BY source),
PRIOR,
hosts AS (SELECT h, round((f + mean * strength) / (n + strength), 12) AS host_rate FROM q, q_p),
judged AS (SELECT q3.*, host_rate, NOT base_failed AND host_rate <= 0.5 AS kept FROM q3 JOIN hosts ON source IS NOT DISTINCT FROM h)""".replace("PRIOR", _PRIOR.format(name="q"))

ORACLES = {
    "op1_url_filters": url_sql(),
    "op5_mixing": f"WITH {MIXED.format(docs='documents')} SELECT doc_id, size, source_size, target, size * repeats AS taken FROM mixed",
    "op9_quality_rules": f"WITH {JUDGED.format(docs='documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate FROM judged",
}
