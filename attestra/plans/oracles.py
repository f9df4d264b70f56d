"""DuckDB SQL that gives the registered queries' rows from the same tables."""

from __future__ import annotations

from attestra.functions import text as X
from attestra.operators.prov import SETS
from attestra.plans.world import oracle

_SPAN = r"'^(.+)#(?:chunk:([0-9]{1,9})@)?chars:([0-9]{1,9})-([0-9]{1,9})$'"
_SPANNED = f"""+ parsed AS (
  SELECT *, regexp_extract(source_locator, {_SPAN}, 1) AS p_loc, TRY_CAST(nullif(regexp_extract(source_locator, {_SPAN}, 2), '') AS INT) AS p_chunk,
         TRY_CAST(regexp_extract(source_locator, {_SPAN}, 3) AS INT) AS p_start, TRY_CAST(regexp_extract(source_locator, {_SPAN}, 4) AS INT) AS p_end FROM evidence_rows),
ev AS (
  SELECT evidence_id, doc_id, availability, content, redacted_at, span_quote,
         coalesce(span_start >= 0 AND span_end >= span_start, false) AS own, coalesce(p_end >= p_start, false) AS found,
         CASE WHEN coalesce(span_start >= 0 AND span_end >= span_start, false) THEN CASE WHEN coalesce(p_end >= p_start, false) THEN p_loc ELSE source_locator END WHEN p_end >= p_start THEN p_loc END AS locator,
         CASE WHEN p_end >= p_start THEN p_chunk END AS chunk_index,
         CASE WHEN coalesce(span_start >= 0 AND span_end >= span_start, false) THEN span_start WHEN p_end >= p_start THEN p_start END AS s_start,
         CASE WHEN coalesce(span_start >= 0 AND span_end >= span_start, false) THEN span_end WHEN p_end >= p_start THEN p_end END AS s_end FROM parsed)"""
_LINKS = _SPANNED + """,
n_own AS (SELECT a.assertion_id, count(r.ord) AS n FROM assertion_rows a LEFT JOIN own_refs r USING (assertion_id) GROUP BY 1),
added AS (
  SELECT assertion_id, evidence_id, relationship, candidate_id, c_ord, r_ord FROM (
    SELECT c.assertion_id, r.evidence_id, r.relationship, c.candidate_id, c.ord AS c_ord, r.ord AS r_ord, row_number() OVER (PARTITION BY c.assertion_id, r.evidence_id, r.relationship ORDER BY c.ord, r.ord) AS k
    FROM own_candidates c JOIN candidate_rows r ON r.subject_id = c.candidate_id
    WHERE NOT EXISTS (SELECT 1 FROM own_refs o WHERE o.assertion_id = c.assertion_id AND o.evidence_id = r.evidence_id AND o.relationship = r.relationship)) WHERE k = 1),
refs AS (
  SELECT assertion_id, ord, evidence_id, relationship, CAST(NULL AS VARCHAR) AS via_candidate FROM own_refs
  UNION ALL SELECT assertion_id, n + row_number() OVER (PARTITION BY assertion_id ORDER BY c_ord, r_ord, evidence_id, relationship) - 1, evidence_id, relationship, candidate_id FROM added JOIN n_own USING (assertion_id)),
links AS (
  SELECT r.*, e.evidence_id IS NOT NULL AS resolved, e.availability, e.content, e.redacted_at, e.own, e.s_start, e.s_end, e.span_quote, e.found,
         CASE WHEN e.evidence_id IS NOT NULL THEN '1' END AS model_version, coalesce(e.availability = 'PRESENT' AND relationship IN ('SUPPORTS', 'DERIVED_FROM'), false) AS backs
  FROM refs r LEFT JOIN ev e ON e.evidence_id = r.evidence_id),
per AS (SELECT assertion_id, count(*) AS n_links, count(*) FILTER (backs) AS n_present, count(*) FILTER (backs AND relationship = 'SUPPORTS') AS n_supporting, count(via_candidate) AS n_added FROM links GROUP BY 1),
ground AS (SELECT a.assertion_id, coalesce(n_links, 0) AS n_links, coalesce(n_present, 0) AS n_present, coalesce(n_present, 0) > 0 AS grounded FROM assertion_rows a LEFT JOIN per USING (assertion_id))"""
_WALK = """,
walk AS (
  SELECT assertion_id, [assertion_id] AS path, superseded_by AS nxt, CAST(NULL AS VARCHAR) AS gap, CAST(NULL AS VARCHAR) AS gap_subject FROM assertion_rows
  UNION ALL
  SELECT w.assertion_id,
         CASE WHEN list_contains(w.path, w.nxt) OR len(w.path) - 1 >= {depth} THEN w.path ELSE list_append(w.path, w.nxt) END,
         CASE WHEN list_contains(w.path, w.nxt) OR len(w.path) - 1 >= {depth} THEN NULL ELSE a.superseded_by END,
         CASE WHEN list_contains(w.path, w.nxt) THEN 'LINEAGE_CYCLE' WHEN len(w.path) - 1 >= {depth} THEN 'LINEAGE_DEPTH_LIMIT' WHEN a.assertion_id IS NULL THEN 'UNRESOLVED_SUCCESSOR' END,
         CASE WHEN list_contains(w.path, w.nxt) OR len(w.path) - 1 >= {depth} OR a.assertion_id IS NULL THEN w.nxt END
  FROM walk w LEFT JOIN assertion_rows a ON a.assertion_id = w.nxt WHERE w.nxt IS NOT NULL),
succ AS (SELECT assertion_id, CAST(len(path) - 1 AS INT) AS n_successors, path[-1] AS current_assertion_id, gap AS gap_kind, gap_subject FROM walk WHERE nxt IS NULL)"""
_BFS = "+ n0 AS (SELECT assertion_id AS root, assertion_id AS ref, 0 AS pos FROM assertion_rows)" + "".join(
    f""",
a{i} AS (SELECT n.root, n.ref AS parent, n.pos AS ppos, i.ord, i.kind, i.ref, row_number() OVER (PARTITION BY n.root, i.kind, i.ref ORDER BY n.pos, i.ord) AS nth
       FROM n{i - 1} n JOIN input_rows i ON i.assertion_id = n.ref),
seen{i} AS ({' UNION ALL '.join(f'SELECT root, ref FROM n{j}' for j in range(i))}),
f{i} AS (SELECT a.* FROM a{i} a WHERE kind = 'assertion' AND nth = 1 AND NOT EXISTS (SELECT 1 FROM seen{i} s WHERE s.root = a.root AND s.ref = a.ref)),
c{i} AS (SELECT a.* FROM a{i} a WHERE kind = 'assertion' AND (nth > 1 OR EXISTS (SELECT 1 FROM seen{i} s WHERE s.root = a.root AND s.ref = a.ref))),
n{i} AS (SELECT root, ref, row_number() OVER (PARTITION BY root ORDER BY ppos, ord) AS pos FROM f{i})"""
    for i in (1, 2, 3)
)
_METHOD = "CASE WHEN {ref} IN (SELECT assertion_id FROM input_rows) THEN 'sum' END"
_BFS += (
    ",\nnodes AS (SELECT root AS root_id, 'assertion' AS kind, ref, 0 AS depth, NULL AS parent_ref, " + _METHOD.format(ref="ref") + " AS method, true AS resolved, 'root' AS via FROM n0"
    + "".join(f" UNION ALL SELECT n.root, 'candidate', c.candidate_id, {i + 1}, n.ref, NULL, true, 'source_candidate' FROM n{i} n JOIN own_candidates c ON c.assertion_id = n.ref" for i in range(4))
    + "".join(f" UNION ALL SELECT root, 'assertion', ref, {i}, parent, {_METHOD.format(ref='ref')}, ref IN (SELECT assertion_id FROM assertion_rows), 'derivation' FROM f{i}" for i in (1, 2, 3))
    + "".join(f" UNION ALL SELECT root, kind, ref, {i}, parent, NULL, kind <> 'evidence' OR ref IN (SELECT evidence_id FROM evidence_rows), 'derivation' FROM a{i} WHERE kind <> 'assertion'" for i in (1, 2, 3))
    + "),\nlineage_gaps AS (" + " UNION ALL ".join(
        f"SELECT root AS root_id, 'LINEAGE_CYCLE' AS kind, ref AS subject_id, parent AS met_at FROM c{i} UNION ALL SELECT root, 'UNRESOLVED_LINEAGE_INPUT', ref, parent FROM f{i} WHERE ref NOT IN (SELECT assertion_id FROM assertion_rows)"
        f" UNION ALL SELECT root, 'UNRESOLVED_LINEAGE_INPUT', ref, parent FROM a{i} WHERE kind = 'evidence' AND ref NOT IN (SELECT evidence_id FROM evidence_rows)" for i in (1, 2, 3))
    + ")"
)
_ANSWERS = """,
n_orders AS (SELECT count(*) AS n FROM orders),
lines AS (
  SELECT concat(conv_id, '-', turn) AS trace_id, text, i, said, CAST(sum(length(said) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(said) - 1 AS INT) AS s, concat('as_o', (conv_id * 31 + turn * 7 + i) % n) AS target
  FROM (SELECT conv_id, turn, text, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations WHERE role = 'assistant' AND text <> '') CROSS JOIN n_orders),
cites AS (SELECT trace_id, i, concat('out:', i, '@chars:', s, '-', s + length(said)) AS node, target, i % 5 = 3 AS narrow FROM lines WHERE i % 5 <> 4)"""
_WORDS = r"""list_filter(list_transform(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9%.''-]*'), lambda x: trim(x, '.''-')), lambda x: x <> '')"""
_NUMBERS = ", ".join(f"'{w}': '{n}'" for w, n in X.NUMBER_WORDS.items())
_THOUSANDS = r"regexp_replace({t}, '([0-9]),([0-9]{3})\b', '\1\2', 'g')"
_TOKENS = (
    "list_transform(regexp_extract_all(replace(" + _THOUSANDS.replace("{t}", _THOUSANDS.replace("{t}", "lower(text)"))
    + r", 'n''t', ' not'), '[a-z][a-z''-]*|[0-9]+(?:\.[0-9]+)?%?'), lambda x: coalesce(map_extract_value(MAP {" + _NUMBERS + "}, x), x))"
)
_STEM = "CASE " + " ".join(f"WHEN length({{w}}) > {len(s) + 3} AND {{w}} LIKE '%{s}' THEN {{w}}[:-{len(s) + 1}]" for s in X.SUFFIXES) + " ELSE {w} END"
_STEMS = "list_transform({l}, lambda w: " + _STEM.format(w="w") + ")"
_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
_BREAKS = {"verifier": r"'([.!?;])\s+'", "generator": r"'([.!?])\s+'"}


def _split(text: str, breaks: str = "verifier") -> str:
    return f"string_split(regexp_replace(regexp_replace({text}, {_BREAKS[breaks]}, '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"


def _sentence(text: str, n: str) -> str:
    """Sentence n, counted round."""
    return f"list_extract({_split(text)}, CAST({n} % len({_split(text)}) AS BIGINT) + 1)"


def _verdicts(pairs: str) -> str:
    """Common table expressions from pairs (claim, evidence_text and any keys) to judged (the same with verdict, score and rationale)."""
    words = lambda text: _TOKENS.replace("lower(text)", f"lower({text})")
    number = r"'^[0-9]+(?:\.[0-9]+)?%?$'"
    opposite = "MAP {" + ", ".join(f"'{x}': '{y}'" for pair in X.OPPOSITES for x, y in (pair, pair[::-1])) + "}"
    prefixed = " OR ".join(f"list_contains(fresh, '{p}' || w) OR (starts_with(w, '{p}') AND length(w) > {len(p) + 3} AND list_contains(fresh, substring(w, {len(p) + 1})))" for p in X.NEGATING_PREFIXES)
    no = f"[{_QUOTED(X.NEGATIONS)}]"
    return f""",
pairs AS ({pairs}),
v1 AS (SELECT *, {words("coalesce(claim, '')")} AS c, list_filter(list_transform({_split("coalesce(evidence_text, '')")}, lambda s: {words("s")}), lambda s: len(s) > 0) AS sents FROM pairs),
v2 AS (SELECT *, {_STEMS.format(l=f"list_filter(c, lambda w: w NOT IN ({_QUOTED((*X.STOPWORDS, *X.NEGATIONS))}))")} AS seq FROM v1),
v3 AS (SELECT *, list_filter(seq, lambda w, i: list_position(seq, w) = i) AS content FROM v2),
v4 AS (SELECT *, list_transform(sents, lambda s: len(list_intersect(content, {_STEMS.format(l="s")}))) AS hits FROM v3),
v5 AS (SELECT *, sents[list_position(hits, list_max(hits))] AS ev, list_max(hits) / nullif(len(content), 0) AS recall FROM v4),
v6 AS (SELECT *, {_STEMS.format(l="ev")} AS est, list_filter(c, lambda w: regexp_matches(w, {number})) AS nc, list_filter(ev, lambda w: regexp_matches(w, {number})) AS ne,
              list_filter(c, lambda w: NOT list_contains(ev, w)) AS alone, list_filter(ev, lambda w: NOT list_contains(c, w)) AS fresh FROM v5),
v7 AS (SELECT *, len(list_filter(nc, lambda w: NOT list_contains(ne, w))) > 0 AS missing, recall >= 0.6::DOUBLE AS full_,
              list_has_any(c, {no}) <> list_has_any(ev, {no})
              OR len(list_filter(c, lambda w: coalesce(list_contains(ev, coalesce(map_extract_value({opposite}, w), map_extract_value({opposite}, {_STEM.format(w="w")}))) OR list_contains(est, coalesce(map_extract_value({opposite}, w), map_extract_value({opposite}, {_STEM.format(w="w")}))), false) AND NOT list_contains(ev, w))) > 0
              OR len(list_filter(alone, lambda w: {prefixed})) > 0 AS clash,
              list_transform(content, lambda w: coalesce(list_position(est, w), 0)) AS place FROM v6),
v8 AS (SELECT *, coalesce(list_sum(list_transform(generate_series(1, len(place) - 2), lambda i: CASE WHEN place[i] = 0 OR place[i + 1] = 0 OR place[i + 2] = 0 THEN 0 WHEN place[i] < place[i + 1] AND place[i + 1] < place[i + 2] THEN -1
              WHEN place[i] > place[i + 1] AND place[i + 1] > place[i + 2] THEN 1 ELSE 0 END)), 0) > 0 AS turned FROM v7),
v9 AS (SELECT *, CASE WHEN len(content) = 0 THEN 'UNVERIFIABLE' WHEN ev IS NULL THEN 'NOT_ENTAILED' WHEN recall >= 0.6::DOUBLE * 0.5::DOUBLE AND missing AND len(ne) > 0 THEN 'CONTRADICTED' WHEN full_ AND clash THEN 'CONTRADICTED'
              WHEN full_ AND turned THEN 'NOT_ENTAILED' WHEN full_ AND NOT missing THEN 'ENTAILED' ELSE 'NOT_ENTAILED' END AS verdict FROM v8),
judged AS (SELECT *, CASE WHEN len(content) = 0 OR ev IS NULL THEN 0.0::DOUBLE ELSE round(recall, 4) END AS score,
              CASE WHEN len(content) = 0 THEN 'the claim says nothing that can be checked' WHEN ev IS NULL THEN 'there is no evidence text' WHEN verdict = 'CONTRADICTED' AND NOT (full_ AND clash) THEN 'the numbers differ' WHEN verdict = 'CONTRADICTED' THEN 'negated or opposite'
                   WHEN full_ AND turned THEN 'the words stand in another order' WHEN verdict = 'ENTAILED' THEN 'the evidence has the claim''s words' WHEN full_ THEN 'a number is missing' ELSE 'too few of the claim''s words' END AS rationale FROM v9)"""


_SCORED = """,
each AS (SELECT c.trace_id, c.i, bool_or(coalesce(g.grounded, false)) AND (NOT bool_or(c.narrow) OR coalesce(bool_or(l.resolved AND l.evidence_id = 'ev_1'), false)) AS good,
                coalesce(bool_or((NOT c.narrow OR l.evidence_id = 'ev_1') AND l.s_start IS NOT NULL), false) AS spanned
         FROM cites c LEFT JOIN links l ON l.assertion_id = c.target LEFT JOIN ground g ON g.assertion_id = c.target GROUP BY 1, 2),
total AS (SELECT trace_id, count(*) AS sentences, count(e.good) AS cited_sentences, count(*) FILTER (e.good) AS grounded_sentences, count(e.good) AS citations, count(*) FILTER (e.good) AS grounded_citations, count(*) FILTER (e.good AND e.spanned) AS span_anchored_citations
          FROM lines LEFT JOIN each e USING (trace_id, i) GROUP BY 1)"""
_DOCS = """,
texts AS (SELECT assertion_id, ord, coalesce(nullif(content, ''), nullif(span_quote, '')) AS t FROM links WHERE availability = 'PRESENT' AND relationship IN ('SUPPORTS', 'DERIVED_FROM')),
firsts AS (SELECT assertion_id, t, min(ord) AS ord FROM texts WHERE t IS NOT NULL GROUP BY 1, 2), base AS (SELECT assertion_id, concat(subject_identity, ' ', replace(predicate, '_', ' '), ' ', object_value_json) AS r FROM assertion_rows),
more AS (SELECT f.assertion_id, string_agg(t, chr(10) ORDER BY ord) AS m FROM firsts f JOIN base b ON b.assertion_id = f.assertion_id AND f.t <> b.r GROUP BY 1),
assertion_docs AS (SELECT assertion_id, CASE WHEN m IS NULL THEN r ELSE concat(r, chr(10), m) END AS text FROM base LEFT JOIN more USING (assertion_id))"""
_READABLE = "CASE WHEN availability = 'PRESENT' THEN coalesce(nullif(content, ''), nullif(span_quote, '')) END"
_SEEDS = ", seeds AS (SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS query_id, concat('as_o', o_orderkey) AS assertion_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 10)"
_NEIGHBOURS = """,
one AS (SELECT assertion_id AS a, ref AS b FROM input_rows WHERE kind = 'assertion' UNION ALL SELECT assertion_id, superseded_by FROM assertion_rows WHERE superseded_by <> ''),
known AS (SELECT a, b FROM one WHERE b IN (SELECT assertion_id FROM assertion_rows)),
small AS (SELECT subject_identity FROM assertion_rows GROUP BY 1 HAVING count(*) <= 50),
near AS (SELECT a AS assertion_id, b AS neighbour FROM known UNION SELECT b, a FROM known
         UNION SELECT x.assertion_id, y.assertion_id FROM assertion_rows x JOIN assertion_rows y USING (subject_identity) WHERE subject_identity IN (FROM small) AND x.assertion_id <> y.assertion_id)"""


def _gap(kind: str, where: str, phase: int = 2) -> str:
    return f"SELECT assertion_id, {phase} AS phase, '{kind}' AS kind, evidence_id AS subject_id, false AS blocking FROM links WHERE {where}"


def _own_gap(kind: str, where: str, phase: int, blocking: str = "false") -> str:
    return f"SELECT a.assertion_id, {phase}, '{kind}', a.assertion_id, {blocking} FROM state a WHERE {where}"


_GAPS = _LINKS + """,
derived AS (SELECT DISTINCT assertion_id FROM input_rows),
state AS (SELECT a.assertion_id, a.status, n.n AS own, EXISTS (SELECT 1 FROM own_candidates c WHERE c.assertion_id = a.assertion_id) AS cand, EXISTS (SELECT 1 FROM derived d WHERE d.assertion_id = a.assertion_id) AS derived,
                 coalesce(p.n_links, 0) AS n_links, coalesce(p.n_present, 0) AS n_present, coalesce(p.n_supporting, 0) AS n_supporting, coalesce(p.n_added, 0) AS n_added
          FROM assertion_rows a JOIN n_own n USING (assertion_id) LEFT JOIN per p USING (assertion_id)),
gaps AS (""" + " UNION ALL ".join([
    _gap("DANGLING_EVIDENCE_REF", "NOT resolved"), _gap("EVIDENCE_ABSENT", "availability = 'ABSENT'"), _gap("EVIDENCE_ERROR", "availability = 'ERROR'"), _gap("REDACTED_EVIDENCE", "availability = 'PRESENT' AND redacted_at IS NOT NULL"),
    _gap("HASH_ONLY_EVIDENCE", "availability = 'PRESENT' AND redacted_at IS NULL AND content IS NULL"), _gap("NO_SPAN", "availability = 'PRESENT' AND s_start IS NULL"), _gap("UNTYPED_SPAN", "availability = 'PRESENT' AND s_start IS NOT NULL AND NOT own"),
    _gap("CONTRADICTING_EVIDENCE", "resolved AND relationship = 'CONTRADICTS'"),
    _own_gap("NOT_ACTIVE", "status <> 'ACTIVE'", 0), _own_gap("NO_SOURCE_CANDIDATE", "NOT cand AND NOT derived", 1), _own_gap("EVIDENCE_VIA_CANDIDATE", "n_added > 0 AND own = 0", 1), _own_gap("NO_EVIDENCE_REFS", "n_links = 0", 1, "true"),
    _own_gap("NO_PRESENT_EVIDENCE", "n_links > 0 AND n_present = 0", 3, "true"), _own_gap("NO_SUPPORTS_RELATIONSHIP", "n_present > 0 AND n_supporting = 0", 3),
]) + ")"


_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''), lambda c: (length(lower({t})) - length(replace(lower({t}), c, '')))::DOUBLE)"
_BROKEN = "(CAST(replace({c}, 'cand_', '') AS INT) % 41 = 3)"
_CHECKED = _LINKS + _ANSWERS + f""",
spoken AS (SELECT c.trace_id, c.i, c.target, l.evidence_id, {_READABLE} AS evidence_text FROM cites c JOIN ground g ON g.assertion_id = c.target AND g.grounded JOIN links l ON l.assertion_id = c.target AND l.relationship IN ('SUPPORTS', 'DERIVED_FROM') AND (NOT c.narrow OR l.evidence_id = 'ev_1'))""" + _verdicts(
    "SELECT s.*, said AS claim FROM spoken s JOIN lines USING (trace_id, i) WHERE evidence_text IS NOT NULL"
) + """,
checked AS (SELECT trace_id, CAST(i AS INT) AS i, 0 AS c, target AS assertion_id, evidence_id, verdict, score, false AS leaky, rationale FROM judged
            UNION ALL SELECT trace_id, CAST(i AS INT), 0, target, NULL, 'UNVERIFIABLE', 0.0::DOUBLE, false, 'no evidence that can be read' FROM cites c WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.trace_id = c.trace_id AND j.i = c.i)),
per_line AS (SELECT l.trace_id, CAST(l.i AS INT) AS i, said, l.i % 5 <> 4 AS cited, coalesce(bool_or(verdict = 'CONTRADICTED'), false) AS contradicted, coalesce(bool_or(verdict = 'ENTAILED'), false) AND NOT coalesce(bool_or(verdict = 'CONTRADICTED'), false) AS supported
             FROM lines l LEFT JOIN checked k ON k.trace_id = l.trace_id AND k.i = l.i GROUP BY 1, 2, 3, 4)"""
_CASES = _CHECKED + _SCORED + """,
runs AS (SELECT DISTINCT trace_id, CAST(split_part(trace_id, '-', 1) AS BIGINT) AS conv, CAST(split_part(trace_id, '-', 2) AS BIGINT) AS turn, n FROM lines CROSS JOIN n_orders),
keyed AS (SELECT *, [concat('as_o', (conv * 31 + turn * 7) % n), concat('as_o', (conv * 31 + turn * 7 + 3) % n)] AS gold, CASE WHEN conv % 7 <> 3 THEN [concat('as_o', (conv * 31 + turn * 7) % n), concat('as_o', (conv * 13 + turn) % n)] ELSE [] END AS top FROM runs),
cited AS (SELECT trace_id, list(target) AS cited, count(*) AS n_cited, count(*) FILTER (NOT coalesce(grounded, false)) AS n_ungrounded FROM (SELECT DISTINCT trace_id, target FROM cites WHERE CAST(split_part(trace_id, '-', 1) AS BIGINT) % 5 <> 4) LEFT JOIN ground ON assertion_id = target GROUP BY 1),
faith AS (SELECT trace_id, coalesce(count(*) FILTER (supported) / nullif(count(*) FILTER (cited), 0), 0.0) AS faithfulness FROM per_line GROUP BY 1),
cases AS (SELECT k.trace_id AS run_id, CAST(conv AS VARCHAR) AS case_id, concat('B', turn % 3) AS baseline, CASE WHEN conv % 2 = 0 THEN 'none' ELSE 'hide_gold_evidence' END AS perturbation, len(list_intersect(gold, top)) / len(gold) AS recall_at_k,
                 coalesce(len(list_intersect(gold, cited)) / n_cited, 0.0) AS gold_precision, CASE WHEN n_cited IS NULL THEN 0.0 ELSE grounded_sentences / sentences END AS completeness, CASE WHEN n_cited IS NULL THEN 0.0 ELSE faithfulness END AS faithfulness,
                 coalesce(n_cited, 0) AS n_cited, coalesce(n_ungrounded, 0) AS n_ungrounded, n_cited IS NULL AS abstained
          FROM keyed k JOIN total USING (trace_id) JOIN faith USING (trace_id) LEFT JOIN cited USING (trace_id))"""
_EVERYTHING = _GAPS + _WALK.format(depth=16) + ",\n" + _BFS.removeprefix("+ ") + """,
paths AS (SELECT assertion_id, path, gap, gap_subject FROM walk WHERE nxt IS NULL)"""
_MADE = """,
made AS (SELECT concat('as_o', o_orderkey) AS assertion_id, concat('au_', o_orderkey) AS audit_id, CASE WHEN o_orderkey % 2 = 0 THEN 'supersession' ELSE 'unknown' END AS decision_kind, CASE WHEN o_orderkey % 5 = 0 THEN 'ACCEPT' ELSE 'MERGE' END AS final_kind,
         o_orderkey % 4 <> 0 AS consulted, CASE WHEN o_orderkey % 7 = 0 THEN 'prior' WHEN o_orderkey % 11 = 0 THEN 'resulting' ELSE 'affected' END AS role FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 97 <> 0),
all_gaps AS (SELECT assertion_id, kind, subject_id FROM gaps UNION ALL SELECT root_id, kind, subject_id FROM lineage_gaps UNION ALL SELECT assertion_id, gap, gap_subject FROM paths WHERE gap IS NOT NULL),
audit_gaps AS (SELECT concat('as_o', o_orderkey) AS assertion_id, 'STORE_ERROR' AS kind FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 97 = 0 UNION ALL SELECT assertion_id, 'NO_CURATION_AUDIT' FROM assertion_rows WHERE coalesce(k % 3, 1) <> 0),
seen_gaps AS (SELECT assertion_id, kind FROM all_gaps UNION ALL SELECT * FROM audit_gaps)"""


def _triples() -> str:
    """Every triple of every chain, as a UNION."""
    name = lambda kind, local: f"concat('urn:attestra:{kind}:', url_encode({local}))"
    rows: list[str] = []

    def put(source: str, s: str, *each: tuple[str, str, str], where: str = "true") -> None:
        rows.extend(f"SELECT assertion_id, {s} AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o, '{kind}' AS kind FROM {source} WHERE {where}" for p, o, kind in each)

    me, ev = name("assertion", "assertion_id"), name("evidence", "evidence_id")
    put("assertion_rows", me, ("@type", "'prov:Entity'", "text"), ("@type", "'att:Assertion'", "text"), ("att:subject", "subject_identity", "iri"), ("att:predicate", "predicate", "text"), ("att:objectValue", "object_value_json", "text"), ("att:status", "status", "text"), ("att:curationEpoch", "1", "int"), ("generatedAtTime", "'2024-01-01T00:00:00Z'", "text"))
    for agent, of, subject, label, software, where in (("authority", "assertion_rows", me, "'curation'", False, "true"), ("actor", "facts", ev, "'extractor'", False, "true"), ("model", "facts", ev, "'reader@1'", True, "doc_id % 2 = 0")):
        put(of, subject, ("wasAttributedTo", name(f"agent:{agent}", label), "iri"), where=where)
        put(of, name(f"agent:{agent}", label), ("@type", "'prov:Agent'", "text"), ("label", label, "text"), *([("@type", "'prov:SoftwareAgent'", "text")] if software else []), where=where)
    put("ground", me, ("att:grounded", "CASE WHEN grounded THEN 'true' ELSE 'false' END", "bool"))
    put("all_gaps", me, ("att:gap", "concat(kind, ' @ ', subject_id)", "text"))
    more = "CASE WHEN via_candidate IS NOT NULL THEN concat(',\"att:viaCandidate\":\"', via_candidate, '\"') ELSE '' END"
    put("links", me, ("wasDerivedFrom", ev, "iri"), ("qualifiedDerivation", f"concat('{{\"@type\":\"prov:Derivation\",\"entity\":\"', {ev}, '\",\"att:relationship\":\"', relationship, '\"', {more}, '}}')", "json"))
    put("links", ev, ("@type", "'prov:Entity'", "text"), ("@type", "'att:Evidence'", "text"))
    put("links", ev, ("att:resolved", "'false'", "bool"), where="NOT resolved")
    put("facts", ev, ("att:sourceType", "'document'", "text"), ("att:sourceLocator", "source_locator", "text"), ("att:availability", "availability", "text"), ("generatedAtTime", "'2024-01-01T00:00:00Z'", "text"), ("att:payloadHash", "concat('h', doc_id)", "text"))
    put("facts", ev, ("att:spanStart", "s_start", "int"), ("att:spanEnd", "s_end", "int"), where="s_start IS NOT NULL")
    target, parent = "concat('urn:attestra:', kind, ':', url_encode(ref))", name("assertion", "parent_ref")
    put("below", parent, ("wasDerivedFrom", target, "iri"), ("@type", "'prov:Entity'", "text"))
    put("below", target, ("@type", "'prov:Entity'", "text"), ("@type", "concat('att:', upper(kind[1]), kind[2:])", "text"))
    put("below", target, ("att:resolved", "'false'", "bool"), where="NOT resolved")
    put("below", target, ("att:derivationMethod", "method", "text"), where="method IS NOT NULL")
    put("later", name("assertion", "nxt"), ("@type", "'prov:Entity'", "text"), ("@type", "'att:Assertion'", "text"), ("wasRevisionOf", name("assertion", "prev"), "iri"))
    head = """, facts AS (SELECT l.assertion_id, l.evidence_id, e.doc_id, e.source_locator, l.availability, l.s_start, l.s_end FROM links l JOIN evidence_rows e ON e.evidence_id = l.evidence_id),
        below AS (SELECT root_id AS assertion_id, kind, ref, parent_ref, method, resolved FROM nodes WHERE parent_ref IS NOT NULL),
        later AS (SELECT assertion_id, path[j] AS prev, path[j + 1] AS nxt FROM (SELECT assertion_id, path, unnest(generate_series(1, len(path) - 1)) AS j FROM paths WHERE len(path) > 1))"""
    return head + ", chain_triples AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(rows) + "))"


def _answer_triples() -> str:
    """The triples of every answer, with those of the chains that it cites."""
    name = lambda kind, local: f"concat('urn:attestra:{kind}:', url_encode({local}))"
    act, by, span = name("answer", "trace_id"), name("agent:producer", "'model'"), name("output", "concat(trace_id, '/', node)")
    answer = ((act, "@type", "'prov:Activity'", "text"), (act, "@type", "'att:AnswerGeneration'", "text"), (act, "wasAssociatedWith", by, "iri"), (by, "@type", "'prov:Agent'", "text"), (by, "@type", "'prov:SoftwareAgent'", "text"), (by, "label", "'model'", "text"))
    cited = ((span, "@type", "'prov:Entity'", "text"), (span, "@type", "'att:OutputSpan'", "text"), (span, "wasGeneratedBy", act, "iri"), (span, "att:span", "node", "text"), (span, "wasDerivedFrom", name("assertion", "target"), "iri"))
    rows = [f"SELECT trace_id, {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS kind FROM {source}" for source, each in (("lines", answer), ("cites", cited)) for s, p, o, kind in each]
    rows.append("SELECT c.trace_id, t.s, t.p, t.o, t.kind FROM (SELECT DISTINCT trace_id, target FROM cites) c JOIN chain_triples t ON t.assertion_id = c.target")
    gaps = ", all_gaps AS (SELECT assertion_id, kind, subject_id FROM gaps UNION ALL SELECT root_id, kind, subject_id FROM lineage_gaps UNION ALL SELECT assertion_id, gap, gap_subject FROM paths WHERE gap IS NOT NULL)"
    return _EVERYTHING + gaps + _triples() + _ANSWERS + ", answer_triples AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(rows) + "))"


#: Fixed values of BLAKE2b (RFC 7693): the first words of its state and, for each of ten rounds, the order of the message's words.
_BLAKE_IV = (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
_BLAKE_ORDER = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15), (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3), (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4),
    (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8), (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13), (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9),
    (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11), (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10), (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5),
    (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)


def _blake(features: str) -> str:
    """Common table expressions from features (f, ASCII, up to 128 characters: one block) to hashed (f, h: the first word of its BLAKE2b with a digest of eight bytes)."""
    word = lambda i: f"list_sum(list_transform(generate_series(0, 7), lambda b: CASE WHEN {i} * 8 + b < length(f) THEN ord(f[{i} * 8 + b + 1]) * CAST(256 ** b AS UBIGINT) ELSE 0 END))::UBIGINT"
    start = (_BLAKE_IV[0] ^ 0x01010008, *_BLAKE_IV[1:], *_BLAKE_IV[:6], _BLAKE_IV[6] ^ (1 << 64) - 1, _BLAKE_IV[7])
    first = ", ".join(f"xor({x}::UBIGINT, length(f)::UBIGINT) AS v{i}" if i == 12 else f"{x}::UBIGINT AS v{i}" for i, x in enumerate(start))
    order = "[" + ", ".join(str(x + 1) for row in _BLAKE_ORDER for x in row) + "]"
    turned = lambda x, n: f"(({x} >> {n}) | (({x} & {(1 << n) - 1}::UBIGINT) * {1 << (64 - n)}::UBIGINT))"
    added = lambda *xs: f"(({' + '.join(f'{x}::UHUGEINT' for x in xs)}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    level = "mix"
    for half, quads in enumerate((((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15)), ((0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)))):
        for second in (0, 1):
            said = lambda g: f"m[ord[(r % 10) * 16 + {half * 8 + g * 2 + second + 1}]]"  # noqa: E731, B023
            for change in (
                lambda g, a, b, c, d: f"{added(f'v{a}', f'v{b}', said(g))} AS v{a}",  # noqa: B023
                lambda g, a, b, c, d: f"{turned(f'xor(v{d}, v{a})', 16 if second else 32)} AS v{d}",  # noqa: B023
                lambda g, a, b, c, d: f"{added(f'v{c}', f'v{d}')} AS v{c}",
                lambda g, a, b, c, d: f"{turned(f'xor(v{b}, v{c})', 63 if second else 24)} AS v{b}",  # noqa: B023
            ):
                level = f"(SELECT * REPLACE ({', '.join(change(g, *q) for g, q in enumerate(quads))}) FROM {level})"
    level = level.replace("FROM mix)", "FROM mix WHERE r < 12)", 1)
    return f"""mix AS (SELECT f, {order} AS ord, list_transform(generate_series(0, 15), lambda i: {word('i')}) AS m, 0 AS r, {first} FROM ({features})
        UNION ALL SELECT * REPLACE (r + 1 AS r) FROM {level}),
        hashed AS (SELECT f, xor(xor(v0, v8), {start[0]}::UBIGINT) AS h FROM mix WHERE r = 12)"""


def _placed() -> str:
    """Common table expressions from vocabulary (w) to placed (w, place, sign): where each of a word's features counts in a vector of 512, and with which sign."""
    features = "features AS (SELECT w, concat('w:', w) AS f FROM vocabulary UNION ALL SELECT w, concat('c:', substring(w, i, 3)) FROM (SELECT w, unnest(generate_series(1, greatest(length(w) - 2, 1))) AS i FROM vocabulary)), "
    # The digest's eight bytes are read from the highest, the word of the state from the lowest.
    return features + _blake("SELECT DISTINCT f FROM features") + ", placed AS (SELECT w, CAST((h >> 56) + 256 * ((h >> 48) & 1) AS INT) AS place, CASE WHEN h & 128 > 0 THEN 1 ELSE -1 END AS sign FROM features JOIN hashed USING (f))"


def _router(asked: str, documents: str, cosines: str, before: str = "") -> str:
    """Route, retrieve, fuse and gate for queries (query_id, query) over documents (id, text); ``cosines`` are common table expressions that end with cos (query_id, assertion_id, score)."""
    return oracle(_LINKS + _WALK.format(depth=16) + _NEIGHBOURS + before + f""",
        q AS ({asked}),
        routes AS (SELECT *, regexp_matches(query, '{X.SPARSE_CUES}') AS sparse, regexp_matches(lower(query), '{X.GRAPH_CUES}') AS graph FROM q),
        d AS (SELECT id, text, {_WORDS.format(t='text')} AS w FROM ({documents})),
        n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), p AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_WORDS.format(t='query')}) AS term FROM q) GROUP BY 1, 2),
        s AS (SELECT query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2),
        words AS (SELECT query_id, id AS assertion_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10),
        every AS (SELECT query_id, assertion_id, score, rank AS sr, CAST(NULL AS VARCHAR) AS via, 0 AS o FROM words UNION ALL SELECT query_id, neighbour, round(score * 0.5::DOUBLE, 6), rank, w.assertion_id, 1 FROM words w JOIN near x ON x.assertion_id = w.assertion_id),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, assertion_id ORDER BY score DESC, o, sr) AS k FROM every) WHERE k = 1),
        around AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, assertion_id) AS rank FROM best) WHERE rank <= 10),
        {cosines},
        close AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, assertion_id) AS rank FROM cos WHERE score > 0) WHERE rank <= 10),
        lists AS (SELECT query_id, assertion_id, rank, CAST(NULL AS VARCHAR) AS via, 1 AS place FROM words JOIN routes USING (query_id) WHERE sparse UNION ALL SELECT query_id, assertion_id, rank, via, 2 FROM around JOIN routes USING (query_id) WHERE graph UNION ALL SELECT query_id, assertion_id, rank, NULL, 3 FROM close),
        fused AS (SELECT query_id, assertion_id, sum(1.0::DOUBLE / (60 + rank)) AS total, first(via ORDER BY place) AS via FROM lists GROUP BY 1, 2),
        seeds AS (SELECT query_id, assertion_id, round(total, 6) AS score, via, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, assertion_id) AS rank FROM fused) WHERE rank <= 10),
        now AS (SELECT s.query_id, s.rank, s.score, s.via, s.assertion_id AS original_id, CASE WHEN c.assertion_id IS NOT NULL THEN c.assertion_id ELSE s.assertion_id END AS assertion_id FROM seeds s JOIN succ x ON x.assertion_id = s.assertion_id LEFT JOIN assertion_rows c ON c.assertion_id = x.current_assertion_id),
        judged AS (SELECT n.*, a.status <> 'ACTIVE' AS inactive, NOT g.grounded AS ungrounded FROM now n JOIN assertion_rows a USING (assertion_id) JOIN ground g USING (assertion_id)),
        passing AS (SELECT *, CASE WHEN NOT inactive AND NOT ungrounded THEN 1 ELSE 0 END AS ok, sum(CASE WHEN NOT inactive AND NOT ungrounded THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, assertion_id ORDER BY rank) AS nth FROM judged),
        counted AS (SELECT *, coalesce(sum(CASE WHEN ok = 1 AND nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM passing)
        SELECT query_id, CAST(rank AS INT) AS rank, original_id, assertion_id, score, via, CASE WHEN ok = 1 AND nth = 1 THEN 'kept' WHEN nth >= 1 THEN 'repeated' WHEN inactive THEN 'inactive' ELSE 'ungrounded' END AS outcome, CASE WHEN ok = 1 AND nth = 1 THEN CAST(before + 1 AS BIGINT) END AS kept_rank FROM counted WHERE before < 5""")


def oracle_sql() -> dict[str, str]:
    found = {
        "q_spans": oracle(_SPANNED + " SELECT evidence_id, locator, chunk_index, s_start AS span_start, s_end AS span_end, CASE WHEN s_start IS NOT NULL THEN own END AS typed, s_end - s_start AS span_length FROM ev"),
        "q_assertions_dedup": "SELECT concat('as_o', o_orderkey) AS assertion_id, CASE WHEN o_orderkey % 5 = 0 THEN 'second' ELSE 'first' END AS object_value_json, o_orderkey AS load_ord FROM orders",
        "q_links": oracle(_LINKS + " SELECT assertion_id, ord, evidence_id, relationship, via_candidate, resolved, availability, model_version, backs FROM links"),
        "q_gaps": oracle(_GAPS + " SELECT * FROM gaps"),
        "q_store_errors": oracle(
            _GAPS.replace("FROM evidence_rows)", "FROM evidence_rows WHERE doc_id % 31 <> 7)").replace("JOIN candidate_rows r", f"JOIN (SELECT * FROM candidate_rows WHERE NOT {_BROKEN.format(c='subject_id')}) r")
            + f""" SELECT * FROM gaps UNION ALL SELECT assertion_id, 2, 'STORE_ERROR', subject_id, false FROM gaps WHERE kind = 'DANGLING_EVIDENCE_REF' AND subject_id IN (SELECT evidence_id FROM evidence_rows WHERE doc_id % 31 = 7)
            UNION ALL SELECT DISTINCT assertion_id, 1, 'STORE_ERROR', candidate_id, false FROM own_candidates WHERE {_BROKEN.format(c='candidate_id')} AND candidate_id IN (SELECT subject_id FROM candidate_rows)"""
        ),
        "q_grounded": oracle(_LINKS + " SELECT * FROM ground"),
        "q_decisions": """SELECT concat('as_o', o_orderkey) AS assertion_id, concat('au_', o_orderkey) AS audit_id, CASE WHEN o_orderkey % 2 = 0 THEN 'supersession' ELSE 'unknown' END AS decision_kind,
            CASE WHEN o_orderkey % 5 = 0 THEN 'ACCEPT' ELSE 'MERGE' END AS final_kind, o_orderkey % 4 <> 0 AS consulted_adviser, CASE WHEN o_orderkey % 7 = 0 THEN 'prior' WHEN o_orderkey % 11 = 0 THEN 'resulting' ELSE 'affected' END AS role
            FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 97 <> 0""",
        "q_audit_gaps": oracle("""SELECT concat('as_o', o_orderkey) AS assertion_id, 'STORE_ERROR' AS kind FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 97 = 0
            UNION ALL SELECT assertion_id, 'NO_CURATION_AUDIT' FROM assertion_rows WHERE coalesce(k % 3, 1) <> 0"""),
        "q_successors": oracle("+" + _WALK.format(depth=16).lstrip(",\n") + " SELECT * FROM succ"),
        "q_successors_depth2": oracle("+" + _WALK.format(depth=2).lstrip(",\n") + " SELECT * FROM succ"),
        "q_lineage": oracle(_BFS + " SELECT * FROM nodes"),
        "q_lineage_gaps": oracle(_BFS + " SELECT * FROM lineage_gaps"),
        "q_impact": oracle("""+ direct AS (SELECT evidence_id, assertion_id FROM own_refs UNION SELECT ref, assertion_id FROM input_rows WHERE kind = 'evidence'),
            via AS (SELECT r.evidence_id, c.assertion_id FROM own_candidates c JOIN candidate_rows r ON r.subject_id = c.candidate_id EXCEPT SELECT * FROM direct),
            reach AS (SELECT * FROM direct UNION SELECT * FROM via UNION SELECT r.evidence_id, i.assertion_id FROM reach r JOIN input_rows i ON i.kind = 'assertion' AND i.ref = r.assertion_id)
            SELECT *, 'direct' AS how FROM direct UNION ALL SELECT *, 'via_candidate' FROM via UNION ALL SELECT *, 'transitive' FROM (SELECT * FROM reach EXCEPT SELECT * FROM direct EXCEPT SELECT * FROM via)"""),
        "q_citing_candidates": oracle("SELECT evidence_id, string_agg(subject_id, ',' ORDER BY ord, subject_id) AS candidates FROM (SELECT evidence_id, subject_id, min(ord) AS ord FROM candidate_rows GROUP BY 1, 2) GROUP BY 1"),
        "q_answer_valid": oracle("+ x AS (SELECT 1)" + _ANSWERS + " SELECT trace_id, CAST(i AS INT) AS i, 'text' AS reason FROM lines WHERE i % 11 = 7 AND substring(text, s + 2, length(said)) <> said"),
        "q_envelope": """SELECT trace_id, reason FROM (SELECT concat(conv_id, '-', turn) AS trace_id,
            CASE WHEN conv_id % 3 <> 0 AND conv_id % 5 <> 0 AND NOT (conv_id % 7 = 0 AND text IS NOT NULL) THEN 'empty' WHEN turn % 2 = 1 AND NOT (conv_id % 7 = 0 AND text IS NOT NULL) THEN 'no answer' END AS reason FROM conversations) WHERE reason IS NOT NULL""",
        "q_prov_graph": oracle(_LINKS + _ANSWERS + """, who AS (SELECT DISTINCT trace_id, target FROM cites)
            SELECT trace_id, 'CITES' AS kind, node AS source, target, NULL AS label FROM cites
            UNION ALL SELECT trace_id, 'BACKED_BY', target, concat(evidence_id, CASE WHEN s_start IS NOT NULL THEN concat('#chars:', s_start, '-', s_end) ELSE '' END), relationship FROM who JOIN links ON assertion_id = target
            UNION ALL SELECT trace_id, 'DERIVED_FROM', target, candidate_id, 'candidate' FROM who JOIN own_candidates ON assertion_id = target"""),
        "q_answer_score": oracle(_LINKS + _ANSWERS + _SCORED + """
            SELECT *, round(cited_sentences / sentences, 6) AS citation_coverage, round(grounded_sentences / sentences, 6) AS chain_completeness, coalesce(round(span_anchored_citations / nullif(grounded_citations, 0), 6), 0.0) AS span_anchoring FROM total"""),
        "q_tokens": f"SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, CAST(len(list_distinct(w)) AS INT) AS n_distinct, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents)",
        "q_stems": "SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, CAST(len(list_filter(w, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in (*X.STOPWORDS, *X.NEGATIONS)) + "))) AS INT) AS n_content, CAST(len(list_distinct(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+(?:\\.[0-9]+)?%?$')))) AS INT) AS n_numbers,"
            f" md5(array_to_string(list_transform(w, lambda x: {_STEM.format(w='x')}), ' ')) AS stems_md5 FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)",
        "q_sentences": r"""SELECT doc_id, CAST(len(string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS INT) AS n_verifier,
            CAST(len(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS INT) AS n_generator FROM documents""",
        "q_sentence_texts": f"SELECT doc_id, md5(array_to_string({_split('text')}, chr(2))) AS verifier_md5, md5(array_to_string({_split('text', 'generator')}, chr(2))) AS generator_md5 FROM documents",
        "q_passages": oracle(_LINKS + _SEEDS + f""", texts AS (SELECT assertion_id, string_agg({_READABLE}, chr(10) ORDER BY ord) AS t FROM links WHERE relationship IN ('SUPPORTS', 'DERIVED_FROM') AND {_READABLE} IS NOT NULL GROUP BY 1)
            SELECT query_id, CAST(rank AS INT) AS rank, s.assertion_id, md5(coalesce(nullif(t, ''), concat(subject_identity, ' ', replace(predicate, '_', ' '), ' ', object_value_json))) AS passage_md5 FROM seeds s JOIN assertion_rows a USING (assertion_id) LEFT JOIN texts USING (assertion_id)"""),
        "q_case_scores": oracle(_CASES + " SELECT run_id, case_id, baseline, perturbation, round(recall_at_k, 6) AS recall_at_k, round(gold_precision, 6) AS gold_precision, round(completeness, 6) AS completeness, round(faithfulness, 6) AS faithfulness, n_cited, n_ungrounded, abstained FROM cases"),
        "q_baseline_summary": oracle(_CASES + """ SELECT baseline, perturbation, count(*) AS cases, round(avg(recall_at_k), 6) AS recall_at_k, round(coalesce(avg(gold_precision) FILTER (NOT abstained), 0), 6) AS gold_precision,
            round(coalesce(avg(completeness) FILTER (NOT abstained), 0), 6) AS completeness, round(coalesce(avg(faithfulness) FILTER (NOT abstained), 0), 6) AS faithfulness, round(coalesce(sum(n_ungrounded) / nullif(sum(n_cited), 0), 0.0), 6) AS ungrounded_rate,
            round(avg(CASE WHEN abstained THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS abstention_rate, round(avg(CASE WHEN abstained THEN 0.0::DOUBLE ELSE faithfulness END), 6) AS faithful_answer_rate FROM cases GROUP BY 1, 2"""),
        "q_chain_contents": oracle(_EVERYTHING + _MADE + """,
            c_links AS (SELECT assertion_id, string_agg(concat(evidence_id, '/', relationship), ',' ORDER BY ord) AS t FROM links GROUP BY 1), c_made AS (SELECT assertion_id, string_agg(concat(audit_id, '/', final_kind, '/', role), ',') AS t FROM made GROUP BY 1),
            c_nodes AS (SELECT assertion_id, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT root_id AS assertion_id, concat(kind, '/', ref, '/', depth) AS t FROM nodes) GROUP BY 1),
            c_gaps AS (SELECT assertion_id, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT assertion_id, concat(kind, '/', subject_id) AS t FROM all_gaps UNION ALL SELECT assertion_id, concat(kind, '/', assertion_id) FROM audit_gaps) GROUP BY 1)
            SELECT a.assertion_id, md5(coalesce(l.t, '')) AS links_md5, md5(coalesce(m.t, '')) AS decisions_md5, md5(coalesce(x.t, '')) AS lineage_md5, md5(coalesce(q.t, '')) AS gaps_md5, array_to_string(p.path[2:], ',') AS successors
            FROM assertion_rows a JOIN paths p USING (assertion_id) LEFT JOIN c_links l USING (assertion_id) LEFT JOIN c_made m USING (assertion_id) LEFT JOIN c_nodes x USING (assertion_id) LEFT JOIN c_gaps q USING (assertion_id)"""),
        "q_bm25_topk": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_WORDS.format(t='text')} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
            p AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
            q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest({_WORDS.format(t='text')}) AS term FROM benchmark), qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY 1, 2),
            s AS (SELECT query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2)
            SELECT query_id, id AS assertion_id, round(round(score, 6), 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
        "q_dense_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS id, list_cosine_similarity(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 20 = 0)
            SELECT query_id, id AS assertion_id, round(round(score, 6), 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
        "q_hash_embed": "SELECT doc_id, 512 AS dim, CASE WHEN len(" + _WORDS.format(t="text") + ") > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS own_cosine FROM documents",
        "q_embedding_components": "WITH RECURSIVE words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(" + _WORDS.format(t="text") + ") AS w FROM documents) GROUP BY 1, 2), vocabulary AS (SELECT DISTINCT w FROM words), "
            + _placed() + """,
            counts AS (SELECT doc_id, place, CAST(sum(n * sign) AS DOUBLE) AS c FROM words JOIN placed USING (w) GROUP BY 1, 2), norms AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM counts GROUP BY 1),
            told AS (SELECT doc_id, count(*) AS n, string_agg(concat(place, ':', CAST(round(c / norm * 1000000) AS BIGINT)), ',' ORDER BY place) AS t FROM counts JOIN norms USING (doc_id) WHERE c <> 0 GROUP BY 1)
            SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_components, md5(coalesce(t, '')) AS components_md5 FROM documents LEFT JOIN told USING (doc_id)""",
        "q_graph_neighbours": oracle("+" + _NEIGHBOURS.lstrip(",\n") + " SELECT * FROM near"),
        "q_graph_topk": oracle("+" + _NEIGHBOURS.lstrip(",\n") + _SEEDS + """, every AS (
              SELECT query_id, assertion_id, round(1.0::DOUBLE / rank, 6) AS score, rank AS sr, CAST(NULL AS VARCHAR) AS via, 0 AS o FROM seeds
              UNION ALL SELECT query_id, neighbour, round(round(1.0::DOUBLE / rank, 6) * 0.5::DOUBLE, 6), rank, s.assertion_id, 1 FROM seeds s JOIN near n ON n.assertion_id = s.assertion_id),
            best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, assertion_id ORDER BY score DESC, o, sr) AS k FROM every) WHERE k = 1)
            SELECT query_id, assertion_id, score, CAST(rank AS INT) AS rank, via FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, assertion_id) AS rank FROM best) WHERE rank <= 10"""),
        "q_fuse": """WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS query_id, concat('as_o', o_orderkey) AS assertion_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r2 FROM orders),
            s AS (SELECT query_id, assertion_id, CASE WHEN r1 <= 10 THEN 1.0::DOUBLE / (60 + r1) ELSE 0 END + CASE WHEN r2 <= 10 THEN 1.0::DOUBLE / (60 + r2) ELSE 0 END AS score, CASE WHEN r1 > 10 THEN 'date' END AS via FROM a WHERE r1 <= 10 OR r2 <= 10)
            SELECT query_id, assertion_id, round(score, 6) AS score, CAST(rank AS INT) AS rank, via FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, assertion_id) AS rank FROM s) WHERE rank <= 10""",
        "q_router_gate": oracle(_LINKS + _WALK.format(depth=16) + _SEEDS + """,
            now AS (SELECT s.query_id, s.rank, s.assertion_id AS original_id, CASE WHEN c.assertion_id IS NOT NULL THEN c.assertion_id ELSE s.assertion_id END AS assertion_id
                    FROM seeds s JOIN succ x ON x.assertion_id = s.assertion_id LEFT JOIN assertion_rows c ON c.assertion_id = x.current_assertion_id),
            judged AS (SELECT n.*, a.status <> 'ACTIVE' AS inactive, NOT g.grounded AS ungrounded FROM now n JOIN assertion_rows a USING (assertion_id) JOIN ground g USING (assertion_id)),
            passing AS (SELECT *, CASE WHEN NOT inactive AND NOT ungrounded THEN 1 ELSE 0 END AS ok, sum(CASE WHEN NOT inactive AND NOT ungrounded THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, assertion_id ORDER BY rank) AS nth FROM judged),
            counted AS (SELECT *, coalesce(sum(CASE WHEN ok = 1 AND nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM passing)
            SELECT query_id, CAST(rank AS INT) AS rank, original_id, assertion_id, CASE WHEN ok = 1 AND nth = 1 THEN 'kept' WHEN nth >= 1 THEN 'repeated' WHEN inactive THEN 'inactive' ELSE 'ungrounded' END AS outcome, CASE WHEN ok = 1 AND nth = 1 THEN CAST(before + 1 AS BIGINT) END AS kept_rank FROM counted WHERE before < 3"""),
        "q_route": "SELECT conv_id, turn, concat_ws(',', CASE WHEN s THEN 'sparse' END, CASE WHEN g THEN 'graph' END, 'dense') AS modes, concat_ws('; ', CASE WHEN s THEN 'exact tokens (quotes/numbers/identifiers)' END, CASE WHEN g THEN 'relational or provenance question' END, 'semantic backstop') AS reason"
            f" FROM (SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '{X.SPARSE_CUES}') AS s, regexp_matches(lower(coalesce(text, '')), '{X.GRAPH_CUES}') AS g FROM conversations)",
        "q_docs": oracle(_LINKS + _DOCS + " SELECT assertion_id, md5(text) AS text_md5 FROM assertion_docs"),
        "q_chain_payload": oracle(_EVERYTHING + _MADE + """,
            c_links AS (SELECT assertion_id, count(*) AS n, count(*) FILTER (backs) AS present FROM links GROUP BY 1), c_made AS (SELECT assertion_id, count(*) AS n FROM made GROUP BY 1), c_nodes AS (SELECT root_id AS assertion_id, count(*) AS n FROM nodes GROUP BY 1),
            c_gaps AS (SELECT assertion_id, count(*) AS n FROM seen_gaps GROUP BY 1)
            SELECT a.assertion_id, CAST(coalesce(l.n, 0) AS INT) AS n_links, s.n_successors, CAST(coalesce(m.n, 0) AS INT) AS n_decisions, CAST(coalesce(x.n, 0) AS INT) AS n_lineage, CAST(coalesce(q.n, 0) AS INT) AS n_gaps, g.grounded, CAST(coalesce(l.present, 0) AS INT) AS n_present, s.current_assertion_id
            FROM assertion_rows a JOIN ground g USING (assertion_id) JOIN succ s USING (assertion_id) LEFT JOIN c_links l USING (assertion_id) LEFT JOIN c_made m USING (assertion_id) LEFT JOIN c_nodes x USING (assertion_id) LEFT JOIN c_gaps q USING (assertion_id)"""),
        "q_explain": oracle(_EVERYTHING + _MADE + """,
            present AS (SELECT assertion_id, evidence_id FROM links WHERE backs GROUP BY 1, 2),
            said AS (SELECT l.assertion_id, string_agg(concat('  - ', l.relationship, ' ', CASE WHEN l.s_start IS NOT NULL THEN concat(e2.locator, ' chars ', l.s_start, '-', l.s_end) ELSE e.source_locator END,
                       CASE WHEN l.own AND coalesce(l.span_quote, '') <> '' THEN concat(' "', l.span_quote, '"') ELSE '' END, ' (actor extractor', CASE WHEN e.doc_id % 2 = 0 THEN ', model reader@1' ELSE '' END, coalesce(', via candidate ' || l.via_candidate, ''), ')'), chr(10) ORDER BY l.ord) AS t
                     FROM links l JOIN present p ON p.assertion_id = l.assertion_id AND p.evidence_id = l.evidence_id JOIN evidence_rows e ON e.evidence_id = l.evidence_id JOIN ev e2 ON e2.evidence_id = l.evidence_id GROUP BY 1),
            n_present AS (SELECT assertion_id, count(*) AS n FROM links WHERE backs GROUP BY 1), up AS (SELECT root_id AS assertion_id, count(*) AS n FROM nodes WHERE depth > 0 AND via = 'derivation' GROUP BY 1),
            told AS (SELECT assertion_id, concat('Curated: ', decision_kind, ' decision ', final_kind, ' at 2024-01-02T03:04:05Z, audit ', audit_id, ' (this assertion: ', role, CASE WHEN consulted THEN ', adviser consulted' ELSE '' END, ').') AS t FROM made),
            kinds AS (SELECT assertion_id, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS t FROM seen_gaps GROUP BY 1)
            SELECT a.assertion_id, g.grounded, md5(concat_ws(chr(10), concat(subject_identity, ' ', predicate, ' ', object_value_json, ' [', status, ', epoch 1, authority curation]'), 'From candidate(s): ' || c.candidate_id, 'Backed by ' || n.n || ' present evidence record(s):', s.t,
                   'Derived via ' || CASE WHEN a.assertion_id IN (SELECT assertion_id FROM derived) THEN 'sum' ELSE '?' END || ' from ' || u.n || ' upstream record(s).', t.t,
                   CASE WHEN len(p.path) > 1 THEN concat('Superseded by ', array_to_string(p.path[2:], ' -> '), ' (current: ', p.path[-1], ').') END, 'Gaps: ' || q.t, CASE WHEN g.grounded THEN 'Grounded.' ELSE 'NOT grounded.' END)) AS summary_md5
            FROM assertion_rows a JOIN ground g USING (assertion_id) JOIN paths p USING (assertion_id) LEFT JOIN own_candidates c USING (assertion_id) LEFT JOIN n_present n USING (assertion_id) LEFT JOIN said s USING (assertion_id) LEFT JOIN up u USING (assertion_id)
            LEFT JOIN told t USING (assertion_id) LEFT JOIN kinds q USING (assertion_id)"""),
        "q_judge": """SELECT doc_id, CASE m WHEN 0 THEN CASE WHEN read THEN 'ENTAILED' ELSE 'NOT_ENTAILED' END WHEN 1 THEN 'CONTRADICTED' WHEN 2 THEN 'NOT_ENTAILED' WHEN 6 THEN 'ENTAILED' ELSE 'UNVERIFIABLE' END AS verdict,
            CASE WHEN m = 0 AND read THEN 0.5::DOUBLE WHEN m = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
            CASE m WHEN 0 THEN CASE WHEN read THEN concat('r ', doc_id) ELSE '' END WHEN 1 THEN '' WHEN 2 THEN repeat('x', 500) WHEN 4 THEN 'the model failed: RuntimeError' WHEN 6 THEN '' ELSE 'the reply is not a judgement' END AS rationale, m = 6 AS leaky
            FROM (SELECT doc_id, doc_id % 8 AS m, coalesce(text, '') <> '' AS read FROM documents)""",
        "q_lexical_verdict": oracle("+ first_ AS (SELECT doc_id, text, " + _sentence("text", "doc_id") + " AS said FROM documents WHERE text <> '')" + _verdicts(
            "SELECT f.doc_id, f.text AS evidence_text, CASE f.doc_id % 4 WHEN 0 THEN f.said WHEN 1 THEN f.said || ' not' WHEN 2 THEN f.said || ' 987654' ELSE coalesce(n.said, f.said) END AS claim FROM first_ f LEFT JOIN first_ n ON n.doc_id - 1 = f.doc_id") + " SELECT doc_id, verdict, score, rationale FROM judged"),
        "q_verify_answer": oracle(_CHECKED + " SELECT *, 'lexical' AS verifier, '2' AS verifier_version FROM checked"),
        "q_verify_score": oracle(_CHECKED + """ SELECT trace_id, count(*) AS sentences, count(*) FILTER (cited) AS cited_sentences, count(*) FILTER (supported) AS supported_sentences, count(*) FILTER (contradicted) AS contradicted_sentences, count(*) FILTER (cited) AS citations,
            count(*) FILTER (supported) AS supporting_citations, CAST(0 AS BIGINT) AS leaky_checks, CASE WHEN bool_or(supported) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS minimality, coalesce(count(*) FILTER (supported) / nullif(count(*) FILTER (cited), 0), 0.0) AS faithfulness, coalesce(count(*) FILTER (supported) / nullif(count(*) FILTER (cited), 0), 0.0) AS citation_precision FROM per_line GROUP BY 1"""),
        "q_unsupported": oracle(_CHECKED + " SELECT trace_id, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (cited AND NOT supported), '') AS unsupported, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (NOT cited), '') AS uncited FROM per_line GROUP BY 1"),
        "q_correct_answer": oracle(_CHECKED + " SELECT trace_id, 1 AS round, said AS original_text, 'ABSTAIN' AS action, 'no evidence entails it' AS reason FROM per_line WHERE NOT cited OR NOT supported"),
        "q_supports_proposals": oracle(_LINKS + ", about AS (SELECT a.*, " + _sentence("coalesce(e.content, '')", "CAST(replace(e.evidence_id, 'ev_', '') AS BIGINT)") + " AS said, e.evidence_id IS NOT NULL AS known FROM assertion_rows a LEFT JOIN own_refs o ON o.assertion_id = a.assertion_id AND o.ord = 0 LEFT JOIN ev e ON e.evidence_id = o.evidence_id)" + _verdicts(
            f"""SELECT l.assertion_id, l.evidence_id, {_READABLE} AS evidence_text, CASE WHEN known THEN CASE k % 4 WHEN 1 THEN said || ' not' WHEN 2 THEN said || ' 987654' ELSE said END ELSE concat(subject_identity, ' ', replace(predicate, '_', ' '), ' ', object_value_json) END AS claim
            FROM links l JOIN about a USING (assertion_id) WHERE relationship = 'DERIVED_FROM' AND {_READABLE} IS NOT NULL""") + """ SELECT CASE verdict WHEN 'ENTAILED' THEN 'SUPPORTS_UPGRADE' ELSE 'CONTRADICTION' END AS kind, assertion_id, evidence_id, CASE verdict WHEN 'ENTAILED' THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS proposed_relationship, verdict, score FROM judged WHERE verdict IN ('ENTAILED', 'CONTRADICTED')"""),
        "q_triggers": oracle(_LINKS + ", about AS (SELECT a.*, " + _sentence("coalesce(e.content, '')", "CAST(replace(e.evidence_id, 'ev_', '') AS BIGINT)") + " AS said, e.evidence_id IS NOT NULL AS known FROM assertion_rows a LEFT JOIN own_refs o ON o.assertion_id = a.assertion_id AND o.ord = 0 LEFT JOIN ev e ON e.evidence_id = o.evidence_id)" + _verdicts(
            f"""SELECT l.assertion_id, l.evidence_id, {_READABLE} AS evidence_text, CASE WHEN known THEN CASE k % 4 WHEN 1 THEN said || ' not' WHEN 2 THEN said || ' 987654' ELSE said END ELSE concat(subject_identity, ' ', replace(predicate, '_', ' '), ' ', object_value_json) END AS claim, known, subject_identity
            FROM links l JOIN about a USING (assertion_id) WHERE relationship = 'DERIVED_FROM' AND {_READABLE} IS NOT NULL""") + """ SELECT CASE WHEN known THEN claim ELSE subject_identity END AS identity_id, assertion_id, evidence_id, CASE verdict WHEN 'ENTAILED' THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS proposed_relationship,
            CAST(least(500, length(concat(CASE verdict WHEN 'ENTAILED' THEN 'SUPPORTS_UPGRADE' ELSE 'CONTRADICTION' END, ' ', assertion_id, ' by ', evidence_id, ' (lexical ', CAST(score AS VARCHAR), '): ', claim, CASE WHEN known THEN '  ' ELSE '' END))) AS INT) AS reason_chars FROM judged WHERE verdict IN ('ENTAILED', 'CONTRADICTED')"""),
        "q_trigger_arguments": oracle(_LINKS + ", about AS (SELECT a.*, " + _sentence("coalesce(e.content, '')", "CAST(replace(e.evidence_id, 'ev_', '') AS BIGINT)") + " AS said, e.evidence_id IS NOT NULL AS known FROM assertion_rows a LEFT JOIN own_refs o ON o.assertion_id = a.assertion_id AND o.ord = 0 LEFT JOIN ev e ON e.evidence_id = o.evidence_id)" + _verdicts(
            f"""SELECT l.assertion_id, l.evidence_id, {_READABLE} AS evidence_text, CASE WHEN known THEN CASE k % 4 WHEN 1 THEN said || ' not' WHEN 2 THEN said || ' 987654' ELSE said END ELSE concat(subject_identity, ' ', replace(predicate, '_', ' '), ' ', object_value_json) END AS claim, known, subject_identity
            FROM links l JOIN about a USING (assertion_id) WHERE relationship = 'DERIVED_FROM' AND {_READABLE} IS NOT NULL""") + """ SELECT CASE verdict WHEN 'ENTAILED' THEN 'NEW_EVIDENCE' ELSE 'CONTRADICTION_DETECTED' END AS kind, CASE WHEN known THEN claim ELSE subject_identity END AS identity_ids, assertion_id AS assertion_ids, evidence_id AS evidence_ids,
            left(concat('attestra ', CASE verdict WHEN 'ENTAILED' THEN 'SUPPORTS_UPGRADE' ELSE 'CONTRADICTION' END, ': lexical@2 judged ', verdict, ' (', printf('%.2f', score), '): ', rationale), 500) AS reason, 'run' AS trace_id FROM judged WHERE verdict IN ('ENTAILED', 'CONTRADICTED')"""),
        "q_correct_repaired": "WITH d AS (SELECT doc_id, text, " + _sentence("text", "doc_id") + " AS said, concat('as_', doc_id) AS own FROM documents WHERE text <> ''), known AS (SELECT said, min(own) AS found FROM d WHERE doc_id % 8 <> 7 GROUP BY 1),"
            " a AS (SELECT d.doc_id, said, CASE doc_id % 4 WHEN 1 THEN concat('as_', doc_id + 1) WHEN 3 THEN NULL ELSE own END AS cited, CASE WHEN doc_id % 4 = 2 THEN said || ' not' ELSE said END AS original FROM d)" + _verdicts(
            """SELECT a.doc_id, a.original AS claim, e.text AS evidence_text, 'cited' AS what, a.cited AS about FROM a JOIN d e ON e.own = a.cited UNION ALL SELECT a.doc_id, a.original, e.text, 'found', k.found FROM a JOIN known k ON k.said = a.original JOIN d e ON e.own = k.found WHERE a.cited IS DISTINCT FROM k.found
            UNION ALL SELECT a.doc_id, a.said, e.text, 'written', NULL FROM a JOIN d e ON e.own = a.cited WHERE a.original <> a.said""") + """
            SELECT CAST(a.doc_id AS VARCHAR) AS trace_id, 1 AS round, original AS original_text, CASE WHEN f.about IS NOT NULL THEN 'RECITE' WHEN w.claim IS NOT NULL THEN 'REGENERATE' ELSE 'ABSTAIN' END AS action, CASE WHEN f.about IS NULL THEN w.claim END AS new_text, f.about AS new_citation
            FROM a LEFT JOIN judged f ON f.doc_id = a.doc_id AND f.what = 'found' AND f.verdict = 'ENTAILED' LEFT JOIN judged w ON w.doc_id = a.doc_id AND w.what = 'written' AND w.verdict = 'ENTAILED'
            WHERE NOT EXISTS (SELECT 1 FROM judged c WHERE c.doc_id = a.doc_id AND c.what = 'cited' AND c.verdict = 'ENTAILED')""",
        "q_prov_triples": oracle(_EVERYTHING + ", all_gaps AS (SELECT assertion_id, kind, subject_id FROM gaps UNION ALL SELECT root_id, kind, subject_id FROM lineage_gaps UNION ALL SELECT assertion_id, gap, gap_subject FROM paths WHERE gap IS NOT NULL)" + _triples() + " SELECT * FROM chain_triples"),
        "q_answer_triples": oracle(_answer_triples() + " SELECT * FROM answer_triples"),
        "q_prov_nodes": oracle(_answer_triples() + f""" SELECT trace_id, s AS node_id, string_agg(p, ',' ORDER BY p) AS properties, CAST(sum(n) AS INT) AS n_values
            FROM (SELECT trace_id, s, p, CASE WHEN p IN ({_QUOTED(SETS)}) THEN count(*) ELSE 1 END AS n FROM answer_triples GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
        "q_extractive": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, {_WORDS.format(t='text')} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
            p AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
            asked AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {_WORDS.format(t='text')} AS words FROM benchmark), q AS (SELECT query_id, unnest(words) AS term FROM asked), qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY 1, 2),
            s AS (SELECT query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2),
            top AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 5),
            cut AS (SELECT query_id, rank, unnest({_split('text', 'generator')}) AS raw, generate_subscripts({_split('text', 'generator')}, 1) AS pos FROM top JOIN d USING (id)),
            each AS (SELECT query_id, rank, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS said FROM cut),
            best AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY query_id, rank ORDER BY len(list_intersect(words, {_WORDS.format(t='said')})) DESC, length(said), pos) AS nth FROM each e JOIN asked USING (query_id) WHERE said <> '') WHERE nth = 1),
            once AS (SELECT *, row_number() OVER (PARTITION BY query_id, said ORDER BY rank) AS again FROM best), kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM once WHERE again = 1)
            SELECT query_id AS trace_id, coalesce(string_agg(said, ' ' ORDER BY k) FILTER (k <= 3), '') AS text, CAST(count(*) FILTER (k <= 3) AS INT) AS n_sentences FROM asked LEFT JOIN kept USING (query_id) GROUP BY 1""",
        "q_load_assertions": oracle("SELECT assertion_id, subject_identity, status, superseded_by FROM assertion_rows"),
        "q_reachable": oracle("SELECT assertion_id, subject_identity FROM assertion_rows WHERE subject_identity IN (SELECT concat('customer/', c_custkey) FROM customer WHERE c_custkey % 3 = 0)"),
        "q_hidden_impact": oracle("""+ direct AS (SELECT evidence_id, assertion_id FROM own_refs UNION SELECT ref, assertion_id FROM input_rows WHERE kind = 'evidence'),
            via AS (SELECT r.evidence_id, c.assertion_id FROM own_candidates c JOIN candidate_rows r ON r.subject_id = c.candidate_id WHERE CAST(replace(r.evidence_id, 'ev_', '') AS BIGINT) % 3 <> 0 EXCEPT SELECT * FROM direct),
            reach AS (SELECT * FROM direct UNION SELECT * FROM via UNION SELECT r.evidence_id, i.assertion_id FROM reach r JOIN input_rows i ON i.kind = 'assertion' AND i.ref = r.assertion_id)
            SELECT *, 'direct' AS how FROM direct UNION ALL SELECT *, 'via_candidate' FROM via UNION ALL SELECT *, 'transitive' FROM (SELECT * FROM reach EXCEPT SELECT * FROM direct EXCEPT SELECT * FROM via)"""),
        "q_hidden_evidence": oracle(_LINKS + ", gold AS (SELECT CAST(item_id AS VARCHAR) AS case_id, concat('as_o', item_id * 37 % (SELECT count(*) FROM orders)) AS id FROM benchmark) SELECT DISTINCT case_id, evidence_id FROM gold JOIN links ON assertion_id = id WHERE resolved"),
        "q_render": oracle("SELECT assertion_id, subject_identity, concat(subject_identity, ' ', replace(predicate, '_', ' '), ' ', object_value_json) AS statement FROM assertion_rows"),
        "q_iri": "SELECT doc_id, md5(concat('urn:x:evidence:', url_encode(text))) AS iri_md5, CAST(least(length(text), 257) AS INT) AS n_bounded FROM documents",
    }
    found["q_router_statements"] = _router(
        """SELECT CAST(n_nationkey AS VARCHAR) AS query_id, CASE n_nationkey % 3 WHEN 0 THEN concat('why is nation/', n_nationkey, ' order sum related') WHEN 1 THEN concat('customer/', n_nationkey, ' order total') ELSE concat('order totals of ', lower(n_name)) END AS query FROM nation""",
        "SELECT assertion_id AS id, concat(subject_identity, ' ', replace(predicate, '_', ' '), ' ', object_value_json) AS text FROM assertion_rows",
        f"dv AS (SELECT id, {_LETTERS.format(t='text')} AS v FROM d), qv AS (SELECT query_id, {_LETTERS.format(t='query')} AS v FROM q), cos AS (SELECT query_id, id AS assertion_id, list_cosine_similarity(qv.v, dv.v) AS score FROM qv, dv)",
    )
    found["q_router"] = _router(
        "SELECT CAST(item_id AS VARCHAR) AS query_id, coalesce(text, '') AS query FROM benchmark", "SELECT assertion_id AS id, text FROM assertion_docs",
        "vocabulary AS (SELECT term AS w FROM tf UNION SELECT term FROM qt), " + _placed() + """, signed AS (SELECT w AS term, place, sum(sign) AS k FROM placed GROUP BY 1, 2),
        dc AS (SELECT id, place, CAST(sum(tf * k) AS DOUBLE) AS c FROM tf JOIN signed USING (term) GROUP BY 1, 2), qc AS (SELECT query_id, place, CAST(sum(qtf * k) AS DOUBLE) AS c FROM qt JOIN signed USING (term) GROUP BY 1, 2),
        dl2 AS (SELECT id, sqrt(sum(c * c)) AS norm FROM dc GROUP BY 1), ql2 AS (SELECT query_id, sqrt(sum(c * c)) AS norm FROM qc GROUP BY 1),
        dots AS (SELECT query_id, id, sum(dc.c * qc.c) AS dot FROM dc JOIN qc USING (place) GROUP BY 1, 2), cos AS (SELECT query_id, id AS assertion_id, dot / dl2.norm / ql2.norm AS score FROM dots JOIN dl2 USING (id) JOIN ql2 USING (query_id) WHERE dot > 0)""",
        before=_DOCS,
    )
    found |= {"q_links_bucketed": found["q_links"], "q_refreshed_docs": found["q_docs"]}
    return found
