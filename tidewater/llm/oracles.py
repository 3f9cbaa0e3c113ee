"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from tidewater.llm import mixing, sharding, urls


def _draw(seed: str, *parts: str) -> str:
    """The number in (0, 1) that _ranks.unit_hash gives for the seed and SQL parts."""
    text = " || ':' || ".join([f"'{seed}'", *parts])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(1 << 52)!r}"


def _key(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'n' ELSE 'v' || {column}::VARCHAR END"


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def url_filter(rules: list[tuple[str, str]]) -> str:
    rule = "CASE " + " ".join(
        f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '/{b}') THEN '{r}'" for r, _ in sorted(rules, key=lambda r: -len(r[0])) for n, _, b in [r.partition("/")]
    ) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules) + " END"
    spread = lambda level: (
        f"SELECT CASE WHEN count(*) = 0 OR sum(n) = count(*) THEN {urls.USUAL_SPREAD} ELSE least({urls.MOST_SPREAD}, greatest({urls.LEAST_SPREAD}, "
        f"(sum(n * (bad / n - prior) * (bad / n - prior) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)))) END AS s FROM {level} WHERE n > 0"
    )
    shrunk = "(bad + (1 - s) / s * prior) / (n + (1 - s) / s)"
    return f"""
WITH parsed AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) AS doc
  FROM pages),
judged AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
hosts AS (
  SELECT host, count(bad)::DOUBLE AS n, (count(*) FILTER (WHERE bad))::DOUBLE AS bad
  FROM parsed LEFT JOIN judged ON doc = doc_id GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\\.$', '') AS name FROM hosts),
cut AS (SELECT *, string_split(name, '.') AS p FROM named),
ended AS (
  SELECT *, CASE WHEN regexp_matches(name, '^[0-9.]+$|[\\[\\]]') THEN 'ip'
    WHEN array_to_string(p[-2:], '.') IN ({_in(urls.TWO_LABEL_SUFFIXES)}) THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM cut),
placed AS (
  SELECT *, CASE WHEN suffix = 'ip' THEN name ELSE array_to_string(p[-(len(string_split(suffix, '.')) + 1):], '.') END AS domain FROM ended),
l1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + {urls.USUAL_RATE}) / (sum(n) + 1) FROM hosts) AS prior FROM placed GROUP BY suffix),
s1 AS ({spread("l1")}),
l2 AS (
  SELECT placed.suffix, domain, sum(placed.n) AS n, sum(placed.bad) AS bad, any_value(up.prior) AS prior
  FROM placed JOIN (SELECT suffix, {shrunk} AS prior FROM l1, s1) up USING (suffix) GROUP BY placed.suffix, domain),
s2 AS ({spread("l2")}),
l3 AS (
  SELECT host, n, bad, up.prior FROM placed JOIN (SELECT domain, {shrunk} AS prior FROM l2, s2) up USING (domain)),
s3 AS ({spread("l3")}),
posterior AS (SELECT host, n, bad, {shrunk} AS mean, (1 - s) / s AS strength FROM l3, s3),
bound AS (SELECT host, n, bad, mean - {urls.DEVIATIONS} * sqrt(mean * (1 - mean) / (n + strength + 1)) AS bound FROM posterior),
ruled AS (SELECT page_id, host, path, {rule} AS rule FROM parsed)
SELECT page_id, host, path, rule, coalesce({said}, CASE WHEN bound > {urls.TOLERANCE} THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS labelled, bad::BIGINT AS bad
FROM ruled JOIN bound USING (host)"""


def sharding_rows(shards: int = 8) -> str:
    """Checks sizes, law, shards and slots; crc32 is folded byte by byte."""
    table = "SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS c FROM range(256) t(i))"
    return f"""
WITH t AS MATERIALIZED ({table}),
tab AS MATERIALIZED (SELECT * FROM t AS x(crc)),
d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, {_key("source")} AS source,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM documents, tab),
e AS (SELECT *, {_draw(sharding.SEED, _key("doc_id"), "text_crc32::BIGINT::VARCHAR")} AS draw FROM d),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32, size) - 1 + {_draw(sharding.SEED, "'source'", "source")}) / count(*) OVER (PARTITION BY source) AS place FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY place, source, draw, doc_id, text_crc32, size) - 1 AS k, count(*) OVER () // {shards} AS each, count(*) OVER () % {shards} AS more FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
  (CASE WHEN k < more * (each + 1) THEN k // (each + 1) ELSE more + (k - more * (each + 1)) // greatest(each, 1) END)::INTEGER AS shard,
  (CASE WHEN k < more * (each + 1) THEN k % (each + 1) ELSE (k - more * (each + 1)) % greatest(each, 1) END)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard
FROM g"""


def mixing_rows() -> str:
    weight = (
        f"greatest({mixing.LEAST_WEIGHT}, least({mixing.FULL_WEIGHT}, coalesce(length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}]', '', 'g')) "
        "/ nullif(length(regexp_replace(text, '[\\x09-\\x0D\\x20]', '', 'g')), 0)::DOUBLE, 0.0)))"
    )
    weights = ", ".join(f"{w!r}::DOUBLE" for w in mixing.WEIGHTS)
    return f"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')), 0) AS size, -ln({_draw(mixing.SEED, _key("doc_id"), "md5(coalesce(text, ''))")}) / {weight} AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INTEGER] AS w, {mixing.MOST} * source_size::DOUBLE AS cap FROM s),
f AS (
  SELECT *, {mixing.BUDGET} * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0) AS lft, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS ws
  FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, coalesce(least(cap, (SELECT lft / ws FROM f WHERE cap / w > lft / ws ORDER BY cap / w, source NULLS LAST LIMIT 1) * w), cap) AS target FROM f),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size, doc_id, md5(coalesce(text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END
    + CASE WHEN earlier + size / 2.0 <= target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source"""
