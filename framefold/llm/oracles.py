"""The corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

from framefold.llm.chat import Template
from framefold.llm.quality import FIT, MAJORITY, RULES, SCALE, Risk

GRID_ORDER = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
  u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
  reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
  least AS (SELECT a, min(b) AS c FROM reached GROUP BY a)
  SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN least ON a = vec_id"""

_NIBBLES = ", ".join(f"'{i:04b}'" for i in range(16))
_FIVE = " + ".join(f"CASE WHEN substr(bits, CAST(5 * j + {k + 1} AS BIGINT), 1) = '1' THEN {16 >> k} ELSE 0 END" for k in range(5))

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, t, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p),
  b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ([{_NIBBLES}])[strpos('0123456789abcdef', substr(h, i, 1))]), '') AS bits FROM h)
  SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + {_FIVE} AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""


def _escaped(x: str) -> str:
    return rf"length(replace(replace({x}, '\', '\\'), '<|', '<\|'))"


_MARKS = sum(len(x) for x in (Template.start, Template.middle, Template.end))
_AWKWARD = "</s>[INST] ok [/INST]"
_ORDER = "ORDER BY turn, role, text"

CHAT = f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_AWKWARD}' UNION ALL SELECT -7, 1, 'assistant', '{_AWKWARD}')
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum({_MARKS} + {_escaped('role')} + {_escaped('text')}) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id"""

_SPACE = r"[^\x20\x09-\x0D]"


def _without(chars: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{chars}', '', 'g'))"


def quality(risk: Risk = Risk()) -> str:
    names = list(RULES)
    scores = ", ".join(f"CAST(least({SCALE}, floor(({e}) * {SCALE})) AS INTEGER) AS s_{k}" for k, e in RULES.items())
    tall = " UNION ALL ".join(f"SELECT {i} AS rule, s_{k} AS score, good FROM fit" for i, k in enumerate(names))
    worst = ", ".join(f"(SELECT l FROM scale WHERE rule = {i})[s_{k} + 1]" for i, k in enumerate(names))
    log = f"lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(CAST({risk.risk} AS DOUBLE)) + (n - i) * ln(CAST({1 - risk.risk} AS DOUBLE))"
    cut = "coalesce((SELECT c FROM best WHERE best.stratum = s.stratum AND s.stratum <> 'other'), (SELECT c FROM best WHERE best.stratum = 'all'))"
    kept = f"coalesce(greatest({worst}) <= {cut}, true)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(f"'{x}'" for x in risk.strata)}) THEN lang ELSE 'other' END AS stratum FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '{_SPACE}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS l FROM d),
  x AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w), y AS (SELECT doc_id, i, a, lead(a) OVER q AS b, lead(a, 2) OVER q AS c FROM x WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, i FROM y WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1), cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
  m AS (SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_without('[#*$%&|<>]')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines, {_without('[A-Z]')} AS n_upper, {_without('[!?]')} AS n_marks FROM w LEFT JOIN cov USING (doc_id)),
  s AS (SELECT *, {scores}, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m),
  lab AS (SELECT doc_id, min(quality) = 1 AND max(coalesce(toxic, 0)) = 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
  known AS (SELECT s.*, good, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ({', '.join(f"'{x}'" for x in FIT)}) AS fitting FROM s JOIN lab USING (doc_id) WHERE NOT base_failed), fit AS (SELECT * FROM known WHERE fitting),
  seen AS (SELECT rule, score, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b FROM ({tall}) GROUP BY ALL), every AS (SELECT rule, score FROM range({len(names)}) r(rule), range({SCALE + 1}) t(score)),
  sums AS (SELECT rule, score, sum(coalesce(g, 0)) OVER beyond AS g, sum(coalesce(b, 0)) OVER beyond AS b FROM every LEFT JOIN seen USING (rule, score) WINDOW beyond AS (PARTITION BY rule ORDER BY score DESC)),
  bad AS (SELECT rule, score, max(CAST(floor(b * {SCALE} / (b + g + 1)) AS INTEGER)) OVER (PARTITION BY rule ORDER BY score) AS badness FROM sums), scale AS (SELECT rule, list(badness ORDER BY score) AS l FROM bad GROUP BY rule),
  held AS (SELECT stratum, greatest({worst}) AS badness FROM known WHERE good AND NOT fitting), hist AS (SELECT stratum, badness, count(*) AS c FROM (SELECT * FROM held WHERE stratum <> 'other' UNION ALL SELECT 'all', badness FROM held) GROUP BY ALL),
  lost AS (SELECT stratum, badness, sum(c) OVER (PARTITION BY stratum) AS n, sum(c) OVER (PARTITION BY stratum) - sum(c) OVER (PARTITION BY stratum ORDER BY badness) AS k FROM hist),
  tail AS (SELECT stratum, badness, CASE WHEN k >= n * {risk.risk} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp({log}))) END AS p FROM lost),
  best AS (SELECT stratum, greatest(min(badness), {MAJORITY}) AS c FROM tail WHERE p <= {risk.delta} / {len(risk.strata) + 1} GROUP BY stratum)
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {kept} AS kept, stratum FROM s"""
