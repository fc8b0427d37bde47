"""Check SQL of the registered queries."""

from __future__ import annotations

from citeloom import fixed_values as fv
from citeloom.catalog import sql as s
from citeloom.operators.answers import REFUSAL
from citeloom.operators.frames import NO_FRAMES

JOIN = lambda xs: f"coalesce(array_to_string({xs}, '|'), '')"


def _docs(*parts: str, final: str) -> str:
    return s.with_(s.blocks(s.DOCS), *parts) + "\n" + final


def _chat(*parts: str, final: str) -> str:
    return s.with_(s.blocks(s.CHAT), *parts) + "\n" + final


def _ask(*parts: str, final: str, source: str = s.DOCS, where: str = "") -> str:
    return s.with_(s.blocks(source), s.relations(), s.questions(), s.ranking(where=where), s.candidates(), *parts) + "\n" + final


LEX = "SELECT anchor, '0x' || upper(left(sha1(anchor), 12)) AS symbol, observations FROM cnt"
GATE = (s.gate(),)
ANSWERED = (s.gate(), s.answers().replace("{REFUSAL}", REFUSAL))

LADDER_LEVELS = [level for level, _ in fv.LADDER]


def _cues(level: str) -> str:
    return "(" + " OR ".join(f"contains(folded, '{c}')" for c in fv.LADDER_CUES[level]) + ")"


def _ladder() -> tuple[str, str]:
    names = s.words_list([m for _, m in fv.LADDER])
    flags = ["located", "located AND len(base) > 0 AND len(list_filter(base, lambda a: list_contains(ev, a))) >= least(2, len(base))",
             _cues("L3"), _cues("L4"), f"{_cues('L4')} AND {_cues('L5')}", *[_cues(x) for x in ("L6", "L7", "L8", "L9")]]
    hits = ", ".join(f"CASE WHEN {f} THEN {i} END" for i, f in enumerate(flags, 1))
    ctes = f"""
l0 AS (SELECT question_id, string_agg(text, chr(10) ORDER BY location_rank) AS txt, string_agg(citation, '|' ORDER BY location_rank) AS cites,
  flatten(list(terms)) AS ev0 FROM g WHERE location_rank IS NOT NULL GROUP BY 1),
l1 AS (SELECT n.question_id, n.base, a.status, l.question_id IS NOT NULL AS located, coalesce(cites, '') AS cites, coalesce(ev0, []) AS ev,
  {s.fold_plain("coalesce(txt, '')")} AS folded FROM need n JOIN ans a USING (question_id) LEFT JOIN l0 l USING (question_id)),
l2 AS (SELECT *, list_filter([{hits}], lambda h: h IS NOT NULL) AS hit FROM l1),
l3 AS (SELECT *, list_transform(hit, lambda h: {names}[h]) AS supported,
  list_filter({names}, lambda m: NOT list_contains(list_transform(hit, lambda h: {names}[h]), m)) AS missing,
  CASE WHEN len(hit) = 0 OR status = 'not_enough_information' THEN 'insufficient' WHEN list_contains(hit, 8) THEN 'conflict'
    WHEN list_contains(hit, 9) OR list_contains(hit, 3) THEN 'strong' WHEN len(hit) >= 2 THEN 'partial' ELSE 'weak' END AS support_level FROM l2)"""
    final = f"""SELECT question_id, support_level, {JOIN("list_transform(hit, lambda h: 'L' || h)")} AS ladder_hits, {JOIN('supported')} AS supported,
  {JOIN('missing')} AS not_supported, cites AS citations, CASE WHEN support_level = 'insufficient' THEN 'Not enough cited evidence.' ELSE
  'Established: ' || coalesce(array_to_string(supported, ', '), '') || '. Not established: ' ||
  CASE WHEN len(missing) = 0 THEN 'none' ELSE array_to_string(missing[1:4], ', ') END || '.' END AS conclusion FROM l3"""
    return ctes, final


TRIGGERS = """
trg AS MATERIALIZED (SELECT row_number() OVER (ORDER BY observations DESC, anchor) AS source_index, anchor,
  CASE WHEN length(anchor) <= 5 THEN 'praise' ELSE 'coding_building' END AS class
  FROM (SELECT * FROM cnt WHERE length(anchor) >= 4 ORDER BY observations DESC, anchor LIMIT 25))"""


def _hits(cap: int | None) -> str:
    limit = f"WHERE r <= {cap}" if cap else ""
    return f"""
h0 AS (SELECT t.source_index, t.anchor, t.class, p.block_ordinal, string_agg(p.position, '|' ORDER BY p.position) AS positions
  FROM post p JOIN trg t USING (anchor) GROUP BY 1, 2, 3, 4),
h AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_index ORDER BY block_ordinal) AS r FROM h0) {limit}),
meta AS MATERIALIZED (SELECT c.block_ordinal, lower(v.role) AS speaker, strftime(to_timestamp(1704067200 + v.conv_id * 3600 + v.turn * 60) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date,
  strftime(to_timestamp(1704067200 + v.conv_id * 3600 + v.turn * 60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created, block_id, citation_id, c.text FROM cite c JOIN conversations v ON v.conv_id = c.k1 AND v.turn = c.k2),
dist AS (SELECT unnest([-1, 0, 1]) AS distance),
ar AS MATERIALIZED (SELECT h.source_index, h.anchor, h.class, h.block_ordinal, distance, CASE WHEN distance < 0 THEN 'prior' WHEN distance = 0 THEN 'hit' ELSE 'next' END AS side,
  m.block_ordinal AS context_ordinal, m.speaker, m.date, m.created, m.block_id, m.citation_id, m.text FROM h CROSS JOIN dist JOIN meta m ON m.block_ordinal = h.block_ordinal + distance),
wd AS MATERIALIZED (SELECT a.*, p.anchor AS term FROM ar a JOIN post p ON p.block_ordinal = a.context_ordinal WHERE length(p.anchor) >= 2)"""


SHAPE = """CASE WHEN contains(lower({0}), 'citation') OR contains(lower({0}), '[cit-') THEN 'citation_or_receipt_shape'
 WHEN contains(lower({0}), 'do not') OR contains(lower({0}), 'no ') OR contains(lower({0}), 'must') THEN 'boundary_instruction_shape'
 WHEN contains(lower({0}), 'test') OR contains(lower({0}), 'pass') OR contains(lower({0}), 'failed') THEN 'test_report_shape'
 WHEN contains(lower({0}), 'plan') OR contains(lower({0}), 'step') THEN 'plan_shape' ELSE 'plain_response_shape' END"""


def _context(wide: bool) -> str:
    keyed = ["SELECT 'trigger_to_prior_anchor_counts', anchor, term, count(*) FROM wd WHERE side = 'prior' GROUP BY 2, 3",
             "SELECT 'trigger_to_next_anchor_counts', anchor, term, count(*) FROM wd WHERE side = 'next' GROUP BY 2, 3",
             "SELECT 'trigger_to_role_counts', anchor, speaker, count(*) FROM ar WHERE side = 'hit' GROUP BY 2, 3",
             "SELECT 'date_to_trigger_counts', date, anchor, count(*) FROM ar WHERE side = 'hit' GROUP BY 2, 3"]
    if wide:
        keyed += [f"SELECT 'assistant_response_shape_before_trigger', anchor, {SHAPE.format('text')}, count(*) FROM ar WHERE side = 'prior' AND speaker = 'assistant' GROUP BY 2, 3",
                  f"""SELECT 'user_reaction_after_assistant_shape', {SHAPE.format('m.text')}, a.anchor, count(*) FROM ar a JOIN meta m ON m.block_ordinal = a.block_ordinal
                  WHERE side = 'next' AND m.speaker = 'assistant' GROUP BY 2, 3""",
                  "SELECT 'cross_day_anchor_counts', m.date, term, count(*) FROM wd w JOIN meta m ON m.block_ordinal = w.block_ordinal WHERE side = 'prior' GROUP BY 2, 3"]
    top = " UNION ALL ".join(keyed)
    return f"""SELECT 'anchor_counts' AS measure, '' AS key, term AS item, count(*) AS n FROM wd GROUP BY 3
UNION ALL SELECT 'anchor_class_counts', '', class, count(*) FROM ar WHERE side = 'hit' GROUP BY 3
UNION ALL SELECT measure, key, item, n FROM (SELECT *, row_number() OVER (PARTITION BY measure, key ORDER BY n DESC, item) AS r
  FROM ({top}) AS z(measure, key, item, n)) WHERE r <= 50"""


def _events(shaped: bool) -> str:
    keep = f"length(term) >= 3 AND term NOT IN ({s.quoted(fv.CONTEXT_BLOCKED)})" if shaped else "true"
    shape = ("CASE WHEN speaker = 'user' AND class = 'praise' THEN 'candidate_user_approval_or_positive_signal_after_prior_context' "
             "WHEN speaker = 'assistant' AND class = 'coding_building' THEN 'candidate_assistant_system_building_response' "
             "ELSE 'candidate_contextual_state_signal' END") if shaped else "'candidate_contextual_state_signal'"
    pick = lambda side: f"coalesce(string_agg(term, '|' ORDER BY r) FILTER (side = '{side}'), '')"
    digest = "|| '-' || left(sha1(a.anchor || '|' || created || '|' || speaker || '|' || block_id), 8)" if shaped else ""
    return f"""SELECT printf('tcg-%06d', row_number() OVER (ORDER BY a.source_index, a.block_ordinal)) {digest} AS event_id, date, a.anchor AS trigger, class,
  '[' || citation_id || ']' AS citation, coalesce(prior_terms, '') AS prior_terms, coalesce(hit_terms, '') AS hit_terms, coalesce(next_terms, '') AS next_terms,
  {shape} AS event_shape, 0.0::DOUBLE AS confidence, true AS needs_review
FROM ar a LEFT JOIN (SELECT source_index, block_ordinal, {pick('prior')} AS prior_terms, {pick('hit')} AS hit_terms, {pick('next')} AS next_terms FROM (
  SELECT *, row_number() OVER (PARTITION BY source_index, block_ordinal, side ORDER BY n DESC, term) AS r FROM (
    SELECT source_index, block_ordinal, side, term, count(*) AS n FROM wd WHERE {keep} GROUP BY 1, 2, 3, 4)) WHERE r <= 12 GROUP BY 1, 2) t
  ON t.source_index = a.source_index AND t.block_ordinal = a.block_ordinal WHERE a.side = 'hit'"""


PHRASES = f"""
ph0 AS (SELECT conv_id * 1000 + turn AS source_index, turn, string_split(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' ') AS ws, role AS class,
  CASE WHEN length(text) > 400 THEN 'high' ELSE 'low' END AS severity FROM conversations),
ph1 AS (SELECT *, lower(array_to_string(ws[1:CASE WHEN turn % 2 = 1 AND len(ws) >= 4 THEN 4 ELSE 2 END], ' ')) AS surface FROM ph0 WHERE len(ws) >= 2),
ph2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY source_index) AS r FROM ph1) WHERE r = 1),
ph AS MATERIALIZED (SELECT source_index, surface, class, severity, {s.tokens('surface')} AS wanted FROM ph2),
phm AS (SELECT p.*, b.block_ordinal, t.terms FROM ph p JOIN b ON contains(lower({s.squeeze('b.text')}), p.surface) JOIN t USING (block_ordinal) WHERE len(wanted) > 0),
phh AS MATERIALIZED (SELECT *, list_filter(range(0, len(terms)), lambda i: list_slice(terms, i + 1, i + len(wanted)) = wanted) AS pos FROM phm)"""


def _cloud() -> str:
    return f"""
cl AS MATERIALIZED (SELECT * FROM (SELECT anchor, off, neighbor, observations, row_number() OVER (PARTITION BY anchor, off ORDER BY observations DESC, neighbor) AS cloud_rank
  FROM rel WHERE anchor IN (SELECT anchor FROM sd)) WHERE cloud_rank <= 6)"""


def _frames() -> str:
    """Both passes as one question list: pass 1 with the question's seeds, pass 2 with the
    mirror's seeds added."""
    return s.with_(s.blocks(s.DOCS), s.relations(), f"""
a0 AS (SELECT b.item_id AS qid, {s.tokens('b.text')} AS toks, m.text IS NOT NULL AS mirrored, {s.tokens("coalesce(m.text, '')")} AS mtoks
  FROM benchmark b LEFT JOIN benchmark m ON m.item_id = b.item_id + 1),
a1 AS (SELECT qid, mirrored, {s.expanded('toks')} AS ex, {s.expanded('mtoks')} AS mex FROM a0),
a2 AS (SELECT qid, 1 AS ps, ex FROM a1 UNION ALL SELECT qid, 2, ex || mex FROM a1 WHERE mirrored),
a3 AS (SELECT qid * 10 + ps AS question_id, {s.ordered_distinct('ex')} AS seeds FROM a2),
sd AS MATERIALIZED (SELECT question_id, unnest(seeds) AS anchor, unnest(range(len(seeds))) AS seed_at FROM a3)""", _cloud(), f"""
nb0 AS (SELECT s.question_id, c.neighbor, sum(c.observations) AS score, min([s.seed_at, c.off, c.cloud_rank]) AS met FROM cl c JOIN sd s USING (anchor) GROUP BY 1, 2),
nb AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, met) AS neighbor_rank FROM nb0) WHERE neighbor_rank <= 72),
w AS MATERIALIZED (SELECT question_id, anchor, sum(wt) AS weight, max(direct) AS direct FROM (SELECT question_id, anchor, 80 AS wt, 1 AS direct FROM sd
  UNION ALL SELECT question_id, neighbor, greatest(1, 4 - (neighbor_rank - 1) // 4), 0 FROM nb) GROUP BY 1, 2),{s.scores('', 'SELECT * FROM post')}""",
        s.candidates(depth=5), f"""
fo AS (SELECT question_id, anchor FROM sd UNION SELECT question_id, neighbor FROM nb),
fw AS (SELECT c.question_id, c.block_ordinal, p.position, p.anchor, row_number() OVER (PARTITION BY c.question_id, c.block_ordinal ORDER BY p.position) AS r
  FROM cd c JOIN post p USING (block_ordinal) JOIN fo f ON f.question_id = c.question_id AND f.anchor = p.anchor),
fr AS MATERIALIZED (SELECT c.*, c.question_id // 10 AS qid, CASE WHEN c.question_id % 10 = 1 THEN 'question' ELSE 'mirror_answer_starter' END AS pass, (
  SELECT string_agg(f.position || ':' || f.anchor || ':' || array_to_string(c.terms[greatest(f.position - 6, 0) + 1:f.position], ' ') || ':' ||
    array_to_string(c.terms[f.position + 2:f.position + 7], ' '), '|' ORDER BY f.position) FROM fw f
  WHERE f.question_id = c.question_id AND f.block_ordinal = c.block_ordinal AND f.r <= 4) AS windows FROM cd c)""")


def _sentence_case(x: str) -> str:
    c = f"(CASE WHEN length({s.squeeze(x)}) <= 420 THEN {s.squeeze(x)} ELSE rtrim(left({s.squeeze(x)}, 417)) || '...' END)"
    up = f"upper(left({c}, 1)) || substring({c}, 2)"
    return f"(CASE WHEN {c} = '' THEN '' WHEN right({c}, 1) IN ('.', '?', '!') THEN {up} ELSE {up} || '.' END)"


def _vocabulary() -> str:
    glue, forbidden, phrases = fv.GLUE_TERMS, fv.STRONG_CLAIM_TERMS, tuple(fv.RELATION_PHRASES.values())
    listed = " UNION ALL ".join(
        [f"SELECT unnest({s.words_list(glue)}) AS term, 3 AS pr, 'glue' AS term_class, 'speech_glue_only' AS authority, true AS can_emit, false AS meaningful, true AS is_glue, false AS forbidden, NULL AS symbol, 0 AS observations",
         f"SELECT unnest({s.words_list(phrases)}), 4, 'relation_phrase', 'relation_surface_only', true, false, true, false, NULL, 0",
         f"SELECT unnest({s.words_list(forbidden)}), 1, 'forbidden', 'forbidden_claim_term', false, false, false, true, NULL, 0"])
    g = f"anchor IN ({s.quoted(glue)})"
    return f"""
vo AS (SELECT anchor AS term, 2 AS pr, CASE WHEN {g} THEN 'glue' WHEN regexp_matches(anchor, '[0-9]') THEN 'measure_or_identifier' ELSE 'evidence_anchor' END AS term_class,
  CASE WHEN {g} THEN 'speech_glue_observed' ELSE 'observed_anchor_only' END AS authority, true AS can_emit, NOT ({g}) AS meaningful, {g} AS is_glue, false AS forbidden,
  '0x' || upper(left(sha1(anchor), 12)) AS symbol, observations FROM vcnt UNION ALL {listed}),
v AS MATERIALIZED (SELECT * EXCLUDE (r, pr) FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY pr) AS r FROM vo) WHERE r = 1)"""


MAJOR = lambda toks: (f"({s.ordered_distinct(f'list_filter({toks}, lambda a: length(a) >= 3 AND NOT list_contains({s.words_list(fv.MAJOR_BLOCKED)}, a) AND regexp_matches(a, {chr(39)}' + chr(92) + 'p{L}' + chr(39) + '))')})")


def _routing() -> str:
    def present(p: str) -> str:
        e = p.replace("'", "''")
        if " " in p:
            return f"contains(low, '{e}')"
        return rf"regexp_matches(low, '(?:^|[^\p{{L}}\p{{N}}_''])' || '{e}' || '(?:$|[^\p{{L}}\p{{N}}_''])')"
    groups = ", ".join("list_filter([" + ", ".join(f"CASE WHEN {present(p)} THEN '{p.replace(chr(39), chr(39) * 2)}' END" for p in ps)
                       + f"], lambda z: z IS NOT NULL) AS {g}" for g, ps in fv.ROUTING_GROUPS.items())
    ratio = lambda g, d: s.rnd(f"least(1.0::DOUBLE, len({g})::DOUBLE / {d})", 4)
    audit = "'AUDIT-' || left(sha1(text), 16)"
    return f"""WITH m AS (SELECT *, lower(text) AS low FROM conversations), gr AS MATERIALIZED (SELECT conv_id, turn, text, {groups} FROM m),
sc AS (SELECT *, {ratio('affect', 3)} AS anger, {ratio('urgency', 2)} AS urgency_score, {ratio('confusion', 2)} AS confusion_score,
  {ratio('care_priority', 2)} AS care_score, {ratio('threat', 1)} AS threat_score, {ratio('mutation', 2)} AS mutation_risk, {ratio('evidence', 2)} AS ev,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, {ratio('target', 2)} - 0.35::DOUBLE * {ratio('ambiguity', 2)})) AS target_specificity FROM gr),
s2 AS (SELECT *, greatest(threat_score, mutation_risk) AS di, greatest(anger, urgency_score, confusion_score, threat_score, mutation_risk, ev) AS proof_burden FROM sc),
s3 AS (SELECT *, len(mutation) > 0 OR di >= 0.5 AS destructive_command, len(ambiguity) > 0 AND target_specificity < 0.75 AS target_is_ambiguous FROM s2),
s4 AS (SELECT *, CASE WHEN destructive_command AND greatest(anger, threat_score, confusion_score) > 0 THEN 'RULE_01_DESTRUCTIVE_HIGH_AFFECT'
  WHEN urgency_score > 0 AND len(command) > 0 AND target_specificity < 0.35 THEN 'RULE_02_URGENCY_MISSING_TARGET'
  WHEN anger > 0 AND len(command) = 0 THEN 'RULE_03_VENT_NO_COMMAND'
  WHEN care_score > 0 AND len(command) > 0 AND target_specificity >= 0.35 AND NOT destructive_command THEN 'RULE_04_CARE_VALID_SYSTEM_COMMAND'
  WHEN len(evidence) > 0 THEN 'RULE_05_EVIDENCE_REQUEST' WHEN len(command) > 0 AND target_specificity >= 0.35 AND mutation_risk = 0 THEN 'RULE_06_CLEAR_TASK'
  WHEN len(command) > 0 THEN 'RULE_02_URGENCY_MISSING_TARGET' ELSE 'RULE_03_VENT_NO_COMMAND' END AS rule FROM s3)
SELECT conv_id, turn, {', '.join(f"{JOIN(g)} AS {g}" for g in fv.ROUTING_GROUPS)}, anger, urgency_score, confusion_score, care_score, threat_score, mutation_risk,
  target_specificity, proof_burden, destructive_command, target_is_ambiguous, rule, CASE left(rule, 7) WHEN 'RULE_01' THEN 'DESTRUCTIVE_COMMAND_LOCK'
  WHEN 'RULE_02' THEN 'AMBIGUITY_MODE' WHEN 'RULE_03' THEN 'VENT_MODE' WHEN 'RULE_04' THEN 'SYSTEM_COMMAND_MODE' WHEN 'RULE_05' THEN 'EVIDENCE_AUDIT_MODE'
  ELSE 'TASK_MODE' END AS mode, {audit} AS audit_id FROM s4"""


PRE_Q = "SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations"
PRE = f"""
pq AS MATERIALIZED (SELECT question_id, unnest(base) AS anchor, unnest(range(len(base))) AS term_at FROM q),
pr AS MATERIALIZED (SELECT p.*, c.observations FROM pq p LEFT JOIN cnt c USING (anchor))"""
EXPECTED = """
pt AS (SELECT anchor, neighbor, sum(observations) AS n FROM rel WHERE anchor IN (SELECT anchor FROM pq) GROUP BY 1, 2),
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, neighbor) AS item_rank FROM pt) WHERE item_rank <= 8 AND anchor <> neighbor),
px AS (SELECT p.question_id, l.neighbor, sum(2 * l.n) AS relation_count, string_agg(DISTINCT p.anchor, '|' ORDER BY p.anchor) AS sources,
  min([p.term_at, l.item_rank]) AS met FROM pq p JOIN pl l USING (anchor)
  WHERE NOT EXISTS (SELECT 1 FROM pq z WHERE z.question_id = p.question_id AND z.anchor = l.neighbor) GROUP BY 1, 2),
pe AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relation_count DESC, met) AS expected_rank FROM px) WHERE expected_rank <= 8)"""

LABELS = """
lab AS MATERIALIZED (SELECT b.item_id AS question_id, 'documents/' || d.doc_id AS source_path FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""

SESSION = """
ss AS MATERIALIZED (SELECT conv_id, turn, role AS speaker, text, 'sessions/' || lpad(CAST(conv_id AS VARCHAR), 9, '0') || '.jsonl' AS source_path,
  lpad(CAST(conv_id AS VARCHAR), 9, '0') AS title, strftime(to_timestamp(1704067200 + conv_id * 3600 + turn * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS created_at,
  row_number() OVER (ORDER BY conv_id, turn) AS turn_number FROM conversations WHERE role IN ('user', 'assistant'))"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["block_split"] = _docs(final="""SELECT block_ordinal, block_id, source_path, line_start, line_end, citation_id, '[' || citation_id || ']' AS marker,
        sha1(text) AS text_hash FROM cite""")
    out["tokenize_terms"] = _docs(final="SELECT block_ordinal, len(terms) AS n_terms, sha1(array_to_string(terms, '|')) AS terms_hash FROM t")
    out["postings"] = _docs(final="SELECT anchor, block_ordinal, position FROM post")
    out["anchor_counts"] = _docs(final="SELECT anchor, observations FROM cnt")
    out["incremental_counts"] = out["anchor_counts"]
    out["anchor_counts_from_text"] = f"SELECT anchor, count(*) AS observations FROM (SELECT unnest({s.tokens('html')}) AS anchor FROM pages) GROUP BY 1"
    out["symbol_lexicon"] = _docs(final=LEX)
    out["symbol_collisions"] = _docs(final="SELECT count(*) AS anchors, count(DISTINCT left(sha1(anchor), 12)) AS symbols FROM cnt")
    out["relation_counts"] = _docs(s.relations(), final="SELECT anchor, neighbor, off AS \"offset\", observations FROM rel")
    out["relation_totals"] = _docs(s.relations(), "n AS (SELECT block_ordinal, position, max(position) OVER (PARTITION BY block_ordinal) AS last FROM post)",
                                   final="""SELECT t.block_ordinal, CAST(coalesce(sum(CASE WHEN position IS NOT NULL THEN least(6, position) + least(6, last - position) END), 0) AS BIGINT) AS relation_observations
        FROM t LEFT JOIN n USING (block_ordinal) GROUP BY 1""")
    out["pair_totals"] = _chat(s.relations(), final="""SELECT r.anchor, r.neighbor, CAST(sum(r.observations) AS BIGINT) AS observations, any_value(c.observations) AS neighbor_observations
        FROM rel r JOIN cnt c ON c.anchor = r.neighbor GROUP BY 1, 2""")
    out["block_sequences"] = _chat(final="SELECT block_ordinal, sha1(array_to_string(terms, '|')) AS terms_hash FROM t WHERE len(terms) > 0")
    out["intake_receipt"] = _docs(s.relations(), final="""SELECT (SELECT count(*) FROM b) AS block_count, (SELECT count(*) FROM post) AS anchor_observation_count,
        (SELECT CAST(sum(observations) AS BIGINT) FROM rel) AS relation_observation_count, (SELECT count(*) FROM cnt) AS unique_anchor_count,
        (SELECT count(DISTINCT source_path) FROM b) AS source_file_count""")
    out["source_receipt"] = _docs(final="SELECT source_path, count(*) AS block_count FROM b GROUP BY 1")

    out["dataset_status"] = _docs(s.relations(), final="""SELECT 'blocks' AS table_name, count(*) AS row_count FROM b UNION ALL SELECT 'terms', count(*) FROM t
        UNION ALL SELECT 'counts', count(*) FROM cnt UNION ALL SELECT 'lexicon', count(*) FROM cnt UNION ALL SELECT 'relations', count(*) FROM rel
        UNION ALL SELECT 'pairs', count(*) FROM (SELECT DISTINCT anchor, neighbor FROM rel)""")

    out["lexicon_search"] = _docs(f"lx AS ({LEX})", final="""SELECT * FROM lx WHERE (contains(anchor, 'tion') OR contains(lower(symbol), 'tion')) AND starts_with(anchor, 'e')
        ORDER BY anchor""")
    out["search_totals"] = _docs(f"lx AS ({LEX})", "qt AS (SELECT " + s.tokens("'of the whst'") + " AS w)", final="""SELECT 'lexicon' AS search, count(*) AS total FROM lx
        WHERE contains(anchor, 'tion') OR contains(lower(symbol), 'tion') UNION ALL
        SELECT 'locations', count(*) FROM t, qt WHERE len(list_filter(w, lambda x: NOT list_contains(terms, x))) = 0""")
    out["block_reads"] = _docs(final="""SELECT block_ordinal, block_id, citation_id, source_path, sha1(text) AS read_hash, array_to_string(terms[1:50], '|') AS first_terms
        FROM cite JOIN t USING (block_ordinal) WHERE block_ordinal = 5""")
    out["anchor_detail"] = _docs(f"lx AS ({LEX})", final="SELECT * FROM lx WHERE anchor = 'than'")
    out["term_locations"] = _docs("qt AS (SELECT " + s.tokens("'of the whst'") + " AS w)", final=f"""SELECT c.block_ordinal, source_path, line_start, line_end, citation_id,
        len(sp) > 0 AS exact_sequence, {JOIN('w')} AS query_terms, {JOIN('sp')} AS sequence_positions, n AS position_count FROM (
          SELECT *, list_filter(range(0, len(terms)), lambda i: list_slice(terms, i + 1, i + len(w)) = w) AS sp,
          len(list_filter(terms, lambda a: list_contains(w, a))) AS n FROM t, qt WHERE len(list_filter(w, lambda x: NOT list_contains(terms, x))) = 0) h
        JOIN cite c USING (block_ordinal) ORDER BY exact_sequence DESC, source_path, line_start""")
    out["question_lexicon"] = _docs(s.questions(), f"lx AS ({LEX})", final="""SELECT a.anchor, symbol IS NOT NULL AS known, symbol, coalesce(observations, 0) AS observations
        FROM (SELECT DISTINCT unnest(base) AS anchor FROM q) a LEFT JOIN lx USING (anchor)""")
    out["anchor_blocks"] = _docs(s.questions(), final="""SELECT anchor, block_ordinal, occurrences, block_rank, sha1(ps) AS positions_hash FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY occurrences DESC, block_ordinal) AS block_rank FROM (
          SELECT anchor, block_ordinal, count(*) AS occurrences, string_agg(position, '|' ORDER BY position) AS ps FROM post
          WHERE anchor IN (SELECT unnest(base) FROM q) GROUP BY 1, 2)) WHERE block_rank <= 10""")
    out["anchor_neighbors"] = _docs(s.relations(), s.questions(), final="""SELECT anchor, neighbor, off AS "offset", observations, neighbor_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY observations DESC, neighbor, off) AS neighbor_rank FROM rel
        WHERE anchor IN (SELECT unnest(base) FROM q)) WHERE neighbor_rank <= 10""")

    out["question_seeds"] = s.with_(s.questions()) + f" SELECT question_id, {JOIN('base')} AS base_terms, {JOIN('seeds')} AS seed_terms FROM q2"
    out["top_neighbors"] = _ask(final="SELECT question_id, neighbor, CAST(score AS BIGINT) AS score, neighbor_rank FROM nb")
    out["block_scores"] = _ask(final=f"SELECT question_id, block_ordinal, direct_hit_count, {s.rnd('score', 4)} AS score, {s.rnd('density', 4)} AS density FROM sc")
    out["topk_blocks"] = _ask(final="""SELECT c.question_id, candidate_rank, block_ordinal, citation, score, density_score, block_anchor_count, direct_hit_count,
        coalesce((SELECT string_agg(w.anchor, '|' ORDER BY w.anchor) FROM w WHERE w.question_id = c.question_id AND w.direct = 1 AND list_contains(c.terms, w.anchor)), '') AS direct_matched_anchors,
        coalesce((SELECT string_agg(w.anchor, '|' ORDER BY w.anchor) FROM w WHERE w.question_id = c.question_id AND list_contains(c.terms, w.anchor)), '') AS matched_anchors FROM cd c""")
    out["qualified_evidence"] = _ask(*GATE, final=f"""SELECT question_id, candidate_rank, citation, qualified, {JOIN('reasons')} AS reject_reasons, {JOIN('covered')} AS covered_terms,
        {JOIN('list_sort(list_filter(required, lambda a: NOT list_contains(covered, a)))[1:20]')} AS missing_terms, {s.rnd('cov', 4)} AS coverage, heading_only, broad_heading,
        path_candidate, qualified_score, location_rank, rejected_rank FROM g""")
    out["gate_summary"] = _ask(*GATE, final=f"""SELECT n.question_id, count(g.question_id) AS raw_candidate_count, count(*) FILTER (g.qualified) AS qualified_count,
        count(*) FILTER (NOT g.qualified) AS rejected_count, any_value(n.path_intent) AS path_intent,
        CASE WHEN count(*) FILTER (g.qualified) > 0 THEN 'qualified_evidence' ELSE 'no_qualified_evidence' END AS support_state,
        {JOIN('any_value(n.required)')} AS required_terms FROM need n LEFT JOIN g USING (question_id) GROUP BY 1""")
    out["cited_answers"] = _ask(*ANSWERED, final="SELECT question_id, status, answer, citations FROM ans")
    ladder, ladder_final = _ladder()
    out["support_ladder"] = _ask(*ANSWERED, ladder, final=ladder_final)
    out["batch_summary"] = s.with_(s.questions()) + """ SELECT count(*) AS question_count, count(*) FILTER (len(seeds) > 0) AS completed,
        count(*) FILTER (len(seeds) = 0) AS failed FROM q2"""
    allowed = """SELECT c.block_ordinal FROM b c JOIN conversations v ON v.conv_id = c.k1 AND v.turn = c.k2 WHERE lower(v.role) = 'assistant'
        AND 1704067200 + v.conv_id * 3600 + v.turn * 60 BETWEEN 1704067200 AND 1704686400"""
    out["chat_filter_query"] = _ask(*GATE, source=s.CHAT, where=allowed, final="""SELECT question_id, candidate_rank, citation, score, density_score, direct_hit_count,
        qualified_score, location_rank FROM g""")
    out["containment_labels"] = "WITH" + LABELS + " SELECT * FROM lab"
    out["hit_at_k"] = _ask(LABELS, """
dr AS (SELECT question_id, source_path, row_number() OVER (PARTITION BY question_id ORDER BY r) AS dr FROM (SELECT question_id, source_path, min(candidate_rank) AS r FROM cd GROUP BY 1, 2)),
br AS (SELECT l.question_id, min(d.dr) AS best FROM lab l LEFT JOIN dr d USING (question_id, source_path) GROUP BY 1),
ks AS (SELECT unnest([1, 3, 5, 10])::BIGINT AS k)""", final=f"""SELECT k, count(*) FILTER (best <= k) AS hits, count(*) AS questions,
        {s.rnd('count(*) FILTER (best <= k)::DOUBLE / greatest(1, count(*))::DOUBLE', 4)} AS hit_rate FROM br CROSS JOIN ks GROUP BY k""")
    out["gold_full_rank"] = _ask(LABELS, """
fr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY direct_hit_count DESC, density DESC, score DESC, block_ordinal) AS full_rank FROM sc),
gold AS (SELECT DISTINCT l.question_id, c.block_ordinal FROM lab l JOIN cite c USING (source_path))""",
                                  final="SELECT question_id, block_ordinal AS gold_ordinal, full_rank FROM fr JOIN gold USING (question_id, block_ordinal)")

    chat_parts = (s.blocks(s.CHAT, "c"), s.relations("c"), s.ranking("c"), s.candidates("c", 40), s.gate("c", 8))
    link = lambda p: f"""(SELECT question_id, citation, line_start, line_end, list_filter(list_distinct(terms), lambda a: length(a) >= 3
        AND NOT list_contains({s.words_list(sorted({*fv.STOP_TERMS, *fv.CROSSLINK_BLOCKED}))}, a) AND NOT regexp_full_match(a, '\\p{{Nd}}+')) AS terms
        FROM {p}g WHERE location_rank IS NOT NULL OR rejected_rank IS NOT NULL)"""
    has = lambda *w: "(" + " OR ".join(f"list_contains(sh, '{x}')" for x in w) + ")"
    out["citation_crosslinks"] = s.with_(s.blocks(s.DOCS), s.relations(), s.questions(), s.ranking(), s.candidates("", 40), s.gate("", 8), *chat_parts, f"lk AS MATERIALIZED {link('')}", f"rk AS MATERIALIZED {link('c')}", """
xl AS (SELECT l.question_id, l.citation AS fc, l.line_start AS fs, l.line_end AS fe, r.citation AS tc, r.line_start AS ts, r.line_end AS te,
  list_sort(list_filter(l.terms, lambda a: list_contains(r.terms, a))) AS sh FROM lk l JOIN rk r USING (question_id))""") + f"""
        SELECT question_id, fc AS from_citation,
        fs AS from_line_start, fe AS from_line_end, tc AS to_citation, ts AS to_line_start, te AS to_line_end,
        CASE WHEN {has('citation', 'linking')} AND {has('graph', 'network', 'cross')} THEN 'same_requirement' WHEN {has('file', 'path', 'commit')} THEN 'implementation_followup'
        WHEN {has('contradiction', 'conflict', 'conflicting')} THEN 'contradiction' ELSE 'same_evidence_field' END AS link_type, {JOIN('sh[1:30]')} AS shared_anchors,
        len(sh) AS shared_anchor_count, CASE WHEN len(sh) >= 8 THEN 'strong' WHEN len(sh) >= 5 THEN 'partial' ELSE 'weak' END AS confidence FROM xl WHERE len(sh) >= 3"""

    stamp = "to_timestamp(1704067200 + conv_id * 3600 + turn * 60) AT TIME ZONE 'UTC'"
    out["chat_headers"] = f"""WITH m AS (SELECT *, {stamp} AS ts, len(regexp_split_to_array({s.strip('text')}, '\\r\\n|[\\n\\r]')) + 11 AS n FROM conversations),
        k AS (SELECT *, unnest(range(0, (n + 39) // 40)) AS i FROM m)
        SELECT 'chat/' || conv_id || '/' || turn AS source_path, i + 1 AS block_index, i * 40 + 1 AS line_start, least(n, i * 40 + 40) AS line_end, CAST(conv_id AS VARCHAR) AS conversation_id,
        'chat/' || conv_id || '/' || turn AS message_id, 'Talk ' || conv_id AS title, lower(role) AS speaker, turn AS turn_index, false AS lifetime_allowed,
        strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(ts, '%Y-%m-%d') AS date FROM k"""
    out["chat_timestamps"] = """SELECT event_id, e AS us12, e AS us24, e AS iso, e AS iso_zone, epoch(date_trunc('day', ts))::BIGINT AS day
        FROM (SELECT event_id, ts, epoch(date_trunc('second', ts))::BIGINT AS e FROM events)"""
    out["chat_index"] = _chat(final="""SELECT block_ordinal, block_id, citation_id, source_path, line_start, line_end, CAST(v.conv_id AS VARCHAR) AS conversation_id, lower(role) AS speaker,
        v.turn AS turn_index, 1704067200 + v.conv_id * 3600 + v.turn * 60 AS created_epoch FROM cite c JOIN conversations v ON v.conv_id = c.k1 AND v.turn = c.k2""")
    out["session_staging"] = "WITH" + SESSION + f""" SELECT source_path, turn_number, 'table' AS scope, 's' || conv_id AS conversation_id,
        left(sha1(source_path || ':' || turn_number || ':' || created_at || ':' || speaker), 16) AS message_id, title, created_at, speaker, sha1({s.strip('text')}) AS text_hash FROM ss
        WHERE {s.strip('text')} <> ''"""
    out["staging_receipt"] = "WITH" + SESSION + """ SELECT count(DISTINCT source_path) AS session_count, count(*) AS turn_count, count(*) FILTER (speaker = 'user') AS user_turns,
        count(*) FILTER (speaker = 'assistant') AS assistant_turns, min(created_at) AS earliest_timestamp, max(created_at) AS latest_timestamp FROM ss"""
    out["markdown_staging"] = f"""SELECT 'md/' || conv_id || '/' || turn || '.md' AS source_path, 1::BIGINT AS turn_number, 'c' || conv_id AS conversation_id, 'Talk' AS title,
        '2024-01-01' AS created_at, role AS speaker, sha1({s.strip('text')}) AS text_hash FROM conversations WHERE role IN ('user', 'assistant') AND {s.strip('text')} <> ''"""
    out["message_routing"] = _routing()

    out["watchlist_hits"] = _chat(TRIGGERS, _hits(None), final="SELECT source_index, anchor, class, block_ordinal, positions FROM h")
    out["watchlist_context"] = _chat(TRIGGERS, _hits(None), final="""SELECT anchor, block_ordinal, side, distance, context_ordinal, speaker AS context_speaker,
        citation_id AS context_citation FROM ar""")
    out["context_counts"] = _chat(TRIGGERS, _hits(None), final=_context(False))
    out["event_table"] = _chat(TRIGGERS, _hits(None), final=_events(False))
    out["wide_context_counts"] = _chat(TRIGGERS, _hits(None), final=_context(True))
    out["shaped_events"] = _chat(TRIGGERS, _hits(None), final=_events(True))
    out["phrase_hits"] = _chat(PHRASES, final=f"""SELECT surface, class, severity, block_ordinal, CASE WHEN len(pos) > 0 THEN array_to_string(pos, '|') ELSE '-1' END AS positions,
        len(wanted) AS matched_width FROM phh""")
    out["hits_per_phrase"] = _chat(PHRASES, final="SELECT p.surface, count(h.block_ordinal) AS hits FROM ph p LEFT JOIN phh h USING (source_index) GROUP BY 1")

    out["relation_cloud"] = _docs(s.relations(), s.questions(), _cloud(), final="SELECT anchor, off AS \"offset\", neighbor, observations, cloud_rank FROM cl")
    frames = _frames()
    out["evidence_frames"] = frames + """ SELECT qid AS question_id, pass, candidate_rank AS frame_rank, block_ordinal, citation, score, density_score, coalesce(windows, '') AS windows FROM fr"""
    out["surface_answers"] = frames + f""" SELECT b.item_id AS question_id, CASE WHEN ps = 'mirror_answer_starter' THEN 'answered_from_supplied_answer_and_evidence'
        WHEN ps = 'question' THEN 'answered_from_evidence' ELSE 'not_enough_evidence' END AS status,
        CASE WHEN ps IS NULL THEN '{NO_FRAMES}' ELSE CASE WHEN ps = 'question' THEN {_sentence_case('first_text')} ELSE {_sentence_case('m.text')} END
          || ' ' || array_to_string(cites[1:3], ' ') END AS answer, coalesce(array_to_string(cites[1:3], '|'), '') AS citations, ps AS evidence_pass,
        CASE WHEN ps IS NULL THEN 'none' WHEN ps = 'question' THEN 'top_evidence_text' ELSE 'supplied_answer' END AS surface_source
        FROM benchmark b LEFT JOIN benchmark m ON m.item_id = b.item_id + 1 LEFT JOIN (SELECT qid, pass AS ps, list(citation ORDER BY candidate_rank) AS cites, first(text ORDER BY candidate_rank) AS first_text,
          row_number() OVER (PARTITION BY qid ORDER BY pass) AS r FROM fr GROUP BY qid, pass) f ON f.qid = b.item_id AND f.r = 1"""

    vocab = (s.blocks(s.CHAT, "v"), _vocabulary())
    out["speech_vocabulary"] = s.with_(*vocab) + " SELECT * FROM v"
    out["vocabulary_classes"] = s.with_(*vocab) + """ SELECT term_class, authority, count(*) AS terms, CAST(sum(observations) AS BIGINT) AS observations FROM v GROUP BY 1, 2"""
    out["term_decisions"] = s.with_(s.blocks(s.DOCS), *vocab) + """ SELECT c.anchor AS term, coalesce(can_emit, false) AS allowed, coalesce(meaningful, false) AS meaningful,
        coalesce(authority, 'not_allowed') AS authority, CASE WHEN forbidden THEN 'forbidden_claim_term' WHEN is_glue THEN 'allowed_glue' WHEN meaningful THEN 'observed_anchor'
        WHEN can_emit THEN 'allowed_surface' ELSE 'not_observed_and_not_glue' END AS reason FROM cnt c LEFT JOIN v ON v.term = c.anchor"""
    out["assembled_paths"] = s.with_(*vocab, f"""
ap AS (SELECT path_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM (SELECT 'documents/' || doc_id AS path_id, {s.tokens('text')} AS toks FROM documents)),
aq AS (SELECT path_id, term, min(pos) AS pos FROM ap WHERE length(term) >= 3 AND term NOT IN ({s.quoted(fv.MAJOR_BLOCKED)}) AND regexp_matches(term, '\\p{{L}}') GROUP BY 1, 2),
a1 AS (SELECT 'documents/' || d.doc_id AS path_id, coalesce(list(term ORDER BY pos) FILTER (term IS NOT NULL), []) AS terms FROM documents d
  LEFT JOIN aq x ON x.path_id = 'documents/' || d.doc_id GROUP BY 1),
a2 AS (SELECT path_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM a1),
bad AS (SELECT path_id, first(term ORDER BY pos) AS term FROM a2 LEFT JOIN v USING (term) WHERE NOT coalesce(meaningful, false) GROUP BY 1)""") + f"""
SELECT path_id, CASE WHEN len(terms) = 0 THEN 'not_enough_evidence' WHEN bad.term IS NOT NULL THEN 'refused_unsupported_surface' ELSE 'assembled_from_anchor_path' END AS status,
  CASE WHEN len(terms) = 0 OR bad.term IS NOT NULL THEN '' ELSE array_to_string(terms, ' and ') || '. [' || path_id || ']' END AS surface, {JOIN('terms')} AS terms,
  CASE WHEN len(terms) = 0 THEN '' ELSE '[' || path_id || ']' END AS citations,
  CASE WHEN len(terms) = 0 THEN 'no_anchor_path' WHEN bad.term IS NOT NULL THEN 'unsupported_meaning_anchor:' || bad.term END AS refusal_reason FROM a1 LEFT JOIN bad USING (path_id)"""

    fit = s.with_(s.blocks(s.DOCS), s.questions(PRE_Q), PRE)
    out["preflight_fit"] = fit + f""" SELECT q.question_id, count(p.anchor) AS unique_anchor_count, count(p.observations) AS present_anchor_count,
        CASE WHEN count(p.anchor) > 0 THEN {s.rnd('count(p.observations)::DOUBLE / count(p.anchor)::DOUBLE', 6)} ELSE 0.0::DOUBLE END AS coverage,
        coalesce({s.rnd('sum(CASE WHEN p.observations IS NOT NULL THEN ln(1 + p.observations::DOUBLE) END) / sum(greatest(1.0::DOUBLE, ln(1 + coalesce(p.observations, 0)::DOUBLE)))', 6)}, 0.0::DOUBLE) AS weighted_fit,
        count(p.anchor) > 0 AND count(p.anchor) = count(p.observations) AS approved,
        coalesce(string_agg(p.anchor, '|' ORDER BY term_at) FILTER (p.observations IS NULL), '') AS absent_anchors,
        coalesce(string_agg(p.anchor, '|' ORDER BY term_at) FILTER (p.observations <= 1), '') AS rare_anchors FROM q LEFT JOIN pr p USING (question_id) GROUP BY 1"""
    exp = s.with_(s.blocks(s.DOCS), s.relations(), s.questions(PRE_Q), PRE, EXPECTED)
    out["missing_expected"] = exp + " SELECT question_id, expected_rank, neighbor, CAST(relation_count AS BIGINT) AS relation_count, sources FROM pe"
    out["preflight_common_terms"] = exp + """ SELECT kind, anchor, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, anchor) AS r FROM (
        SELECT kind, anchor, count(*) AS n FROM (SELECT 'low_fit' AS kind, anchor FROM pr WHERE coalesce(observations, 0) <= 1
        UNION ALL SELECT 'expected', neighbor FROM pe) GROUP BY 1, 2)) WHERE r <= 25"""

    sent = f"list_filter(string_split(regexp_replace({s.squeeze('body')}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
    out["evidence_snippets"] = _ask(*GATE, f"""
e0 AS (SELECT question_id, location_rank, citation, CASE WHEN contains(text, 'TEXT:') THEN {s.strip("substring(text, strpos(text, 'TEXT:') + 5)")} ELSE {s.strip('text')} END AS body
  FROM g WHERE location_rank IS NOT NULL),
e1 AS (SELECT question_id, location_rank, citation, unnest({sent}) AS snippet, unnest(range(len({sent}))) AS pos FROM e0),
e2 AS (SELECT e.*, list_sort(list_filter(q.base, lambda a: list_contains({s.tokens('snippet')}, a))) AS matched FROM e1 e JOIN q USING (question_id)),
e3 AS (SELECT *, len(list_filter(matched, lambda a: regexp_matches(a, '[0-9]'))) AS vh FROM e2),
e4 AS (SELECT *, len(matched) + 3 * vh AS score FROM e3),
e5 AS (SELECT *, row_number() OVER (PARTITION BY question_id, location_rank ORDER BY score DESC, vh DESC, CASE WHEN score > 0 THEN length(snippet) END, pos) AS p FROM e4),
e6 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY location_rank, p) AS snippet_rank FROM e5 WHERE p <= 2 AND (score > 0 OR p = 1))""",
        final=f"SELECT question_id, snippet_rank, citation, snippet, {JOIN('matched')} AS matched, CAST(score AS BIGINT) AS snippet_score FROM e6 WHERE snippet_rank <= 5")

    sq = s.squeeze("text")
    out["text_views"] = f"""SELECT conv_id, turn, CASE WHEN length({sq}) <= 120 THEN {sq} ELSE rtrim(left({sq}, 119)) || '...' END AS snippet,
        CASE WHEN length({sq}) <= 100 THEN {sq} ELSE rtrim(left({sq}, 97)) || '...' END AS compact, {_sentence_case('text')} AS sentence,
        role || '_id_' || conv_id AS safe_id, {JOIN(MAJOR('toks') + '[1:8]')} AS major_anchors,
        {JOIN(s.ordered_distinct('lt'))} AS link_terms, {SHAPE.format('text')} AS response_shape,
        NOT contains({s.strip('text')}, chr(10)) AND {s.strip('text')} <> '' AND (starts_with({s.strip('text')}, '#') OR length({s.strip('text')}) <= 80) AS heading_only
        FROM (SELECT *, list_filter(toks, lambda a: length(a) >= 3 AND NOT list_contains({s.words_list(sorted({*fv.STOP_TERMS, *fv.CROSSLINK_BLOCKED}))}, a)
          AND NOT regexp_full_match(a, '\\p{{Nd}}+')) AS lt FROM (SELECT *, {s.tokens('text')} AS toks FROM conversations))"""
    return out
