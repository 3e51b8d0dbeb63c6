"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidewell.llm import quality as Q
from tidewell.llm import urls as U


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = ", ".join(f"({_quoted(a)}, {_quoted(h)}, {_quoted(p)})" for a, h, p in U.RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"


def _host(url: str) -> str:
    return _LOWER.format(f"regexp_extract(coalesce({_REST.format(url)}, ''), '^[^/?#]*')")


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({_REST.format(url)}, ''), '^[^/?#]*([^?#]*)', 1)"


def _node(url: str) -> str:
    cut = f"split_part({url}, '#', 1)"
    host = f"regexp_extract({_REST.format(cut)}, '^[^/?#]*')"
    return (
        f"CASE WHEN instr({cut}, '://') > 0 THEN substr({cut}, 1, instr({cut}, '://') + 2) || {_LOWER.format(host)}"
        f" || substr({cut}, instr({cut}, '://') + 3 + length({host})) END"
    )


OP4 = f"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (VALUES {_RULES}),
tags AS (
  SELECT url, unnest(list_transform(regexp_extract_all(html, {_quoted(U.LINK_TAG)}),
                                    lambda t: regexp_extract(t, {_quoted(U.HREF)}, 1))
                  || list_transform(regexp_extract_all(html, {_quoted(U.REFRESH_TAG)}),
                                    lambda t: regexp_extract(t, {_quoted(U.REFRESH_URL)}, 1))) AS target
  FROM pages WHERE instr(url, '://') > 0
    AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))),
links AS (SELECT url, replace(target, '&amp;', '&') AS target FROM tags WHERE target <> ''),
whole AS (
  SELECT url, CASE WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '//') THEN split_part(url, '://', 1) || ':' || target
    WHEN starts_with(target, '/') THEN split_part(url, '://', 1) || '://' || {_host("url")} || target
    ELSE regexp_replace(regexp_extract(url, '^[^?#]*') || CASE WHEN {_path("url")} = '' THEN '/' ELSE '' END,
                        '[^/]*$', '') || target END AS target FROM links),
edges AS (SELECT {_node("url")} AS a, {_node("target")} AS b FROM whole),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
spots AS (
  SELECT page_id, {_node("url")} AS node, {_host("url")} AS host, {_path("url")} AS path FROM pages),
all_spots AS (
  SELECT host, path FROM spots UNION SELECT {_host("b")}, {_path("b")} FROM reach),
ruled AS (
  SELECT host, path, action, rule_host || rule_path AS rule FROM all_spots JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, action) = 1),
groups AS (
  SELECT reach.a AS node FROM reach JOIN ruled ON ruled.host = {_host("reach.b")} AND ruled.path = {_path("reach.b")}
  GROUP BY reach.a HAVING bool_or(action = 'block') AND NOT bool_or(action = 'allow'))
SELECT page_id, spots.host, spots.path, rule,
       coalesce(action, CASE WHEN groups.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM spots LEFT JOIN ruled ON spots.host = ruled.host AND spots.path = ruled.path
LEFT JOIN groups ON spots.node = groups.node
"""

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array({{}}, '{_SPACE}'), lambda w: w <> '')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_quoted(pattern)}))"


def quality_ctes(table: str) -> str:
    """CTEs ``judged`` (one row per document, by row number) over ``table``."""
    return f"""
docs AS (SELECT row_number() OVER () AS rid, * FROM {table}),
base AS (SELECT rid, doc_id, coalesce(text, '') AS body, {_WORDS.format("coalesce(text, '')")} AS words FROM docs),
grams AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
repeats AS (SELECT rid, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY rid),
lines AS (
  SELECT rid, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS place FROM base),
counted AS (SELECT rid, place, line, len({_WORDS.format("line")}) AS n FROM lines),
tested AS (
  SELECT rid, place, line, n, n > 0 AND (
    (n < {Q.OPEN_WORDS} AND NOT regexp_matches(regexp_replace(line, '{_SPACE}$', ''), {_quoted(Q.ENDING)}))
    OR {_count("line", Q.SYMBOL)} * 100 > n * {Q.SYMBOL_SHARE}
    OR {_count("line", Q.SEPARATOR)} * 100 > n * {Q.SEPARATOR_SHARE}
    OR (n <= {Q.NOTICE_WORDS} AND regexp_matches(line, {_quoted(Q.NOTICE)}))) AS fails FROM counted),
per_doc AS (
  SELECT rid, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost,
    count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS dup_lines,
    coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT fails), '') AS clean_text
  FROM tested GROUP BY rid),
measured AS (
  SELECT base.rid, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    {_count("body", Q.SYMBOL)} AS n_symbols, dup_lines AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, lost, clean_text
  FROM base JOIN per_doc USING (rid) LEFT JOIN repeats USING (rid)),
judged AS (
  SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT base_failed AND lost * 100 <= n_words * {Q.LOST_SHARE} AS kept FROM measured)
"""


OP5 = f"""
WITH {quality_ctes("documents")}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept
FROM judged
"""

SQL = {"op4_url_filter": OP4, "op5_quality_rules": OP5}

SQL["op8_top_k"] = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
