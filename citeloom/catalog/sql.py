"""SQL fragments for the check queries. Each check is one SELECT over common table
expressions, written apart from the Spark code: lines and windows where Spark splits rows in
place, self joins where Spark builds pairs from arrays."""

from __future__ import annotations

from citeloom import fixed_values as fv

SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def words_list(values) -> str:
    return f"[{quoted(values)}]"


STOP = words_list(fv.STOP_TERMS)
LOW = words_list(sorted({*fv.STOP_TERMS, *fv.LOW_VALUE_TERMS}))


def fold(text: str) -> str:
    return f"replace(lower({text}), 'ß', ' ss ')"


def fold_plain(text: str) -> str:
    return f"replace(lower({text}), 'ß', 'ss')"


def singular(x: str) -> str:
    return (f"CASE WHEN length({x}) > 4 AND ends_with({x}, 'ies') THEN left({x}, length({x}) - 3) || 'y' "
            f"WHEN length({x}) > 3 AND ends_with({x}, 's') AND NOT ends_with({x}, 'ss') THEN left({x}, length({x}) - 1) ELSE {x} END")


def tokens(text: str) -> str:
    word = r"[a-z0-9]+(?:''[a-z0-9]+)?|[\p{L}\p{N}]"
    return (f"flatten(list_transform(list_filter(regexp_extract_all({fold(text)}, '{word}'), "
            f"lambda x: NOT list_contains({STOP}, x)), lambda x: "
            f"CASE WHEN regexp_full_match(x, '(?:[a-z]+[0-9]|[0-9]+[a-z])[a-z0-9]*') THEN string_split(x, '') "
            f"ELSE [{singular('x')}] END))")


def ordered_distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda v, i: list_position({xs}, v) = i)"


def expanded(xs: str) -> str:
    flat = (f"list_filter(flatten(list_transform({xs}, lambda a: CASE WHEN regexp_full_match(a, '\\p{{L}}+') AND length(a) > 2 "
            f"THEN [a, {singular('a')}, a || 's'] ELSE [a, {singular('a')}] END)), lambda v: v <> '' AND NOT list_contains({STOP}, v))")
    return flat


def rnd(x: str, places: int) -> str:
    s = f"{float(10 ** places):.1f}::DOUBLE"
    return f"floor(({x}) * {s} + 0.5) / {s}"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


DOCS = "SELECT doc_id AS k1, 0 AS k2, 'documents/' || doc_id AS source_path, text FROM documents"
CHAT = "SELECT conv_id AS k1, turn AS k2, 'chat/' || conv_id || '/' || turn AS source_path, text FROM conversations"
PAGES = "SELECT page_id AS k1, 0 AS k2, 'pages/' || page_id AS source_path, html AS text FROM pages"
QUESTIONS = "SELECT item_id AS question_id, text AS question FROM benchmark"


def blocks(source: str, p: str = "") -> str:
    """CTEs up to ``{p}b`` (blocks), ``{p}t`` (terms), ``{p}post`` and ``{p}cnt``."""
    return rf"""
{p}src AS MATERIALIZED ({source}),
{p}raw AS (SELECT k1, k2, source_path, text AS whole, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n, len(l) AS total
  FROM (SELECT *, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM {p}src)),
{p}ln AS (SELECT *, regexp_full_match(line, '[{SPACE}]*') AS blank FROM {p}raw WHERE NOT (n = total AND line = '')),
{p}para AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY source_path ORDER BY n) AS p FROM {p}ln),
{p}num AS (SELECT *, (row_number() OVER (PARTITION BY source_path, p ORDER BY n) - 1) // 40 AS c FROM {p}para WHERE NOT blank),
{p}blk AS (SELECT k1, k2, source_path, min(n) AS line_start, max(n) AS line_end, string_agg(line, chr(10) ORDER BY n) AS text
  FROM {p}num GROUP BY k1, k2, source_path, p, c
  UNION ALL SELECT k1, k2, source_path, 1, greatest(1, max(n)), any_value(whole) FROM {p}ln GROUP BY k1, k2, source_path
  HAVING bool_and(blank)),
{p}b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY line_start) AS block_index,
  row_number() OVER (ORDER BY k1, k2, line_start) - 1 AS block_ordinal FROM {p}blk),
{p}ids AS (SELECT *, sha1(source_path) || ':' || block_index AS block_id FROM {p}b),
{p}cite AS (SELECT *, 'CIT-' || left(sha1(block_id), 10) AS citation_id FROM {p}ids),
{p}t AS MATERIALIZED (SELECT block_ordinal, {tokens('text')} AS terms FROM {p}b),
{p}post AS MATERIALIZED (SELECT block_ordinal, unnest(terms) AS anchor, unnest(range(len(terms))) AS position FROM {p}t),
{p}cnt AS MATERIALIZED (SELECT anchor, count(*) AS observations FROM {p}post GROUP BY anchor)"""


def relations(p: str = "", window: int = 6) -> str:
    return f"""
{p}off AS (SELECT unnest(range(-{window}, {window + 1})) AS o),
{p}rel AS MATERIALIZED (SELECT x.anchor, y.anchor AS neighbor, o AS off, count(*) AS observations
  FROM {p}post x JOIN {p}off ON o <> 0 JOIN {p}post y ON y.block_ordinal = x.block_ordinal AND y.position = x.position + o
  GROUP BY 1, 2, 3)"""


def questions(source: str = QUESTIONS) -> str:
    return f"""
q0 AS (SELECT *, {tokens('question')} AS toks FROM ({source})),
q AS MATERIALIZED (SELECT *, {ordered_distinct('toks')} AS base, {expanded('toks')} AS ex FROM q0),
q2 AS MATERIALIZED (SELECT *, {ordered_distinct('ex')} AS seeds FROM q),
sd AS MATERIALIZED (SELECT question_id, unnest(seeds) AS anchor, unnest(range(len(seeds))) AS seed_at FROM q2)"""


def ranking(p: str = "", where: str = "") -> str:
    """CTEs ``{p}nb`` (neighbours), ``{p}w`` (weights) and ``{p}sc`` (scores). ``where`` cuts the
    blocks before posting counts are taken."""
    cut = f"SELECT * FROM {p}post WHERE block_ordinal IN ({where})" if where else f"SELECT * FROM {p}post"
    return f"""
{p}nb0 AS (SELECT s.question_id, r.neighbor, sum(r.observations) AS score, min(r.anchor) AS first_anchor
  FROM {p}rel r JOIN sd s ON s.anchor = r.anchor WHERE NOT list_contains({STOP}, r.neighbor)
  AND NOT EXISTS (SELECT 1 FROM sd z WHERE z.question_id = s.question_id AND z.anchor = r.neighbor) GROUP BY 1, 2),
{p}nb AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_anchor, neighbor)
  AS neighbor_rank FROM {p}nb0) WHERE neighbor_rank <= {fv.NEIGHBOR_LIMIT}),
{p}w AS MATERIALIZED (SELECT question_id, anchor, sum(wt) AS weight, max(direct) AS direct FROM (
  SELECT question_id, anchor, {fv.DIRECT_WEIGHT} AS wt, 1 AS direct FROM sd
  UNION ALL SELECT question_id, neighbor, greatest(1, 4 - (neighbor_rank - 1) // 4), 0 FROM {p}nb) GROUP BY 1, 2),{scores(p, cut)}"""


def scores(p: str, cut: str) -> str:
    return f"""
{p}pf AS MATERIALIZED ({cut}),
{p}df AS (SELECT anchor, count(*) AS n FROM {p}pf GROUP BY 1),
{p}len AS (SELECT block_ordinal, count(*) AS n_terms FROM {p}pf GROUP BY 1),
{p}dw AS (SELECT w.*, CAST(floor(w.weight * 1e12::DOUBLE / greatest(1.0::DOUBLE, sqrt(n::DOUBLE)) + 0.5) AS BIGINT) AS fw FROM {p}w w JOIN {p}df d USING (anchor)),
{p}hit AS (SELECT DISTINCT block_ordinal, anchor FROM {p}pf),
{p}sc0 AS (SELECT question_id, block_ordinal, CAST(sum(fw) AS BIGINT)::DOUBLE / 1e12::DOUBLE AS score, CAST(sum(direct) AS BIGINT) AS direct_hit_count
  FROM {p}hit JOIN {p}dw USING (anchor) GROUP BY 1, 2),
{p}sc AS MATERIALIZED (SELECT s.*, n_terms, score / greatest(1.0::DOUBLE, sqrt(n_terms::DOUBLE)) AS density FROM {p}sc0 s JOIN {p}len USING (block_ordinal))"""


def candidates(p: str = "", depth: int = 25) -> str:
    return f"""
{p}top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY direct_hit_count DESC, density DESC, score DESC,
  block_ordinal) AS candidate_rank FROM {p}sc) WHERE candidate_rank <= {depth}),
{p}cd AS MATERIALIZED (SELECT c.question_id, c.candidate_rank, c.block_ordinal, '[' || e.citation_id || ']' AS citation, e.source_path, e.line_start, e.line_end,
  {rnd('c.score', 4)} AS score, {rnd('c.density', 4)} AS density_score, c.n_terms AS block_anchor_count, c.direct_hit_count, e.text, t.terms
  FROM {p}top c JOIN {p}cite e USING (block_ordinal) JOIN {p}t t USING (block_ordinal))"""


def gate(p: str = "", top_k: int = 5) -> str:
    heading = (f"NOT regexp_matches({strip('text')}, '[\\n\\r]') AND {strip('text')} <> '' AND "
               f"(starts_with({strip('text')}, '#') OR length({strip('text')}) <= 80)")
    bare = f"{fold_plain(f'trim({strip(chr(116) + chr(101) + chr(120) + chr(116))}, {chr(39)}#*` {chr(39)})')}"
    true_path = " OR ".join(f"regexp_matches(text, '{x}')" for x in fv.TRUE_PATH_PATTERNS)
    intent = " OR ".join(f"contains({fold_plain('question')}, '{x}')" for x in fv.PATH_INTENT_WORDS)
    return f"""
{p}need AS MATERIALIZED (SELECT question_id, question, base, ({intent}) AS path_intent,
  list_filter(base, lambda a: NOT list_contains({LOW}, a) AND (length(a) > 1 OR regexp_full_match(a, '\\p{{Nd}}+'))) AS required FROM q),
{p}g0 AS (SELECT c.*, n.required, n.path_intent, list_sort(list_filter(n.required, lambda a: list_contains(c.terms, a))) AS covered,
  ({heading}) AS heading_only, ({true_path}) AS path_candidate FROM {p}cd c JOIN {p}need n USING (question_id)),
{p}g1 AS (SELECT *, len(covered)::DOUBLE / greatest(1, len(required))::DOUBLE AS cov,
  heading_only AND ({bare} IN ({quoted(fv.BROAD_HEADINGS)}) OR starts_with({bare}, 'implemented') OR starts_with({bare}, 'next steps')) AS broad_heading FROM {p}g0),
{p}g2 AS (SELECT *, list_filter([
  CASE WHEN broad_heading THEN 'section_heading_ambiguity' END,
  CASE WHEN heading_only AND cov < 0.75 THEN 'heading_without_content' END,
  CASE WHEN path_intent AND regexp_matches(text, '{fv.SLASH_PHRASE}') AND NOT path_candidate THEN 'path_config_classifier_miss' END,
  CASE WHEN len(required) >= 4 AND cov < 0.50 THEN 'unsupported_refusal_threshold' END,
  CASE WHEN len(required) >= 3 AND cov < 0.34 THEN 'predicate_object_coverage_miss' END], lambda r: r IS NOT NULL) AS reasons FROM {p}g1),
{p}g3 AS (SELECT *, len(reasons) = 0 AS qualified, {rnd('density_score + 8.0::DOUBLE * cov + least(4.0::DOUBLE, direct_hit_count::DOUBLE) - CASE WHEN heading_only THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END', 4)} AS qualified_score FROM {p}g2),
{p}g4 AS (SELECT *, row_number() OVER (PARTITION BY question_id, qualified ORDER BY qualified_score DESC, density_score DESC, score DESC, candidate_rank) AS place,
  row_number() OVER (PARTITION BY question_id, qualified ORDER BY candidate_rank) AS found FROM {p}g3),
{p}g AS MATERIALIZED (SELECT *, CASE WHEN qualified AND place <= {top_k} THEN place END AS location_rank,
  CASE WHEN NOT qualified AND found <= {top_k} THEN found END AS rejected_rank FROM {p}g4)"""


def answers(p: str = "") -> str:
    words = lambda x: f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda w: lower(w))"
    return f"""
{p}s0 AS (SELECT g.question_id, location_rank, citation, {words('n.question')} AS qw,
  list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]|$)'), lambda s: {squeeze('s')}), lambda s: s <> '') AS ss, text
  FROM {p}g g JOIN {p}need n USING (question_id) WHERE location_rank <= 3),
{p}s1 AS (SELECT question_id, location_rank, citation, qw, unnest(ss) AS s FROM {p}s0),
{p}s2 AS (SELECT *, {words('s')} AS sw FROM {p}s1),
{p}qwc AS (SELECT question_id, w, count(*) AS qn FROM (SELECT question_id, unnest({words('question')}) AS w FROM {p}need) GROUP BY 1, 2),
{p}sid AS (SELECT *, row_number() OVER () AS sid FROM {p}s2),
{p}swc AS (SELECT sid, question_id, w, count(*) AS sn FROM (SELECT sid, question_id, unnest(sw) AS w FROM {p}sid) GROUP BY 1, 2, 3),
{p}ov AS (SELECT sid, sum(least(qn, sn)) AS o FROM {p}swc JOIN {p}qwc USING (question_id, w) GROUP BY 1),
{p}best AS (SELECT question_id, location_rank, citation, s FROM (SELECT s.*, row_number() OVER (PARTITION BY question_id, location_rank
  ORDER BY coalesce(o, 0) DESC, length(s.s), s.s) AS r FROM {p}sid s LEFT JOIN {p}ov USING (sid)) WHERE r = 1),
{p}best2 AS (SELECT question_id, location_rank, citation, s FROM {p}best UNION ALL
  SELECT question_id, location_rank, citation, {squeeze('text')} FROM {p}s0 WHERE len(ss) = 0),
{p}ans AS MATERIALIZED (SELECT n.question_id, CASE WHEN count(s) = 0 THEN 'not_enough_information' ELSE 'answered_from_locations' END AS status,
  coalesce(string_agg(CASE WHEN contains(s, citation) THEN s ELSE s || ' ' || citation END, ' ' ORDER BY location_rank), '{{REFUSAL}}') AS answer,
  coalesce(string_agg(citation, '|' ORDER BY location_rank), '') AS citations
  FROM {p}need n LEFT JOIN {p}best2 USING (question_id) GROUP BY 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
