"""The registered queries in SQL (DuckDB's dialect), written apart from the DataFrame operators.

Where the semantics need an ordered fold or an iteration that SQL expresses only at great cost, there is none; those
queries are tested against brute force.
"""

from __future__ import annotations

_NORM = r"regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _norm(x: str) -> str:
    return _NORM.format(x)


# canonical tables
_F = r"""f0 AS (SELECT DISTINCT codebook_id g, id, coalesce(unit, '') unit, coalesce(unit_date, '') unit_date,
  CASE WHEN regexp_full_match(t, '\d{4}-\d{2}') AND try_strptime(t || '-01', '%Y-%m-%d') IS NOT NULL THEN t
       WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}') AND try_strptime(t, '%Y-%m-%d') IS NOT NULL THEN t ELSE '' END t,
  coalesce(kind, '') kind, coalesce(who, '') who, coalesce(conf, '') conf, coalesce(dur, '') dur, coalesce(text, '') text,
  list_filter(coalesce(topics, []), lambda x: x IS NOT NULL) topics, list_filter(coalesce(entities, []), lambda x: x IS NOT NULL) entities, list_filter(coalesce(src, []), lambda x: x IS NOT NULL) src,
  list_filter(coalesce(obj, []), lambda x: x IS NOT NULL) obj, list_filter(coalesce(place, []), lambda x: x IS NOT NULL) place, list_filter(coalesce(event, []), lambda x: x IS NOT NULL) event FROM fact),
f AS (SELECT *, CASE WHEN t <> '' THEN t ELSE unit_date END eff FROM f0)"""
_L = "l AS (SELECT DISTINCT codebook_id g, id, coalesce(unit, '') unit, coalesce(unit_date, '') unit_date, pos, coalesce(who, '') who, coalesce(text, '') text FROM line)"
_U = "u AS (SELECT DISTINCT codebook_id g, id, coalesce(date, '') date, coalesce(title, '') title, coalesce(dur_min, 0) dur_min FROM unit)"
_T = "tp AS (SELECT codebook_id g, code, max(coalesce(status, '')) status, max(coalesce(born, '')) born FROM topic WHERE code IS NOT NULL GROUP BY ALL)"
_E = f"ed AS (SELECT DISTINCT g, parent, child FROM (SELECT g, {_norm('p')} parent, child FROM (SELECT codebook_id g, unnest(parents) p, code child FROM topic WHERE code IS NOT NULL)) WHERE parent <> '')"
_N = "en AS (SELECT codebook_id g, code, max(coalesce(etype, '')) etype, max(coalesce(name, '')) name FROM entity WHERE code IS NOT NULL GROUP BY ALL)"
_A = f"al AS (SELECT DISTINCT g, surface, code FROM (SELECT g, {_norm('a')} surface, code FROM (SELECT codebook_id g, unnest(aliases) a, code FROM entity)) WHERE surface <> '' AND surface <> code)"
_S = r"sp AS (SELECT DISTINCT g, who FROM (SELECT codebook_id g, unnest(regexp_split_to_array(lower(speakers), '\s+')) who FROM codebook) WHERE who <> '')"
_R = "roots AS (SELECT g, min(code) topic FROM (SELECT DISTINCT g, parent code FROM ed) JOIN (SELECT g, code FROM tp WHERE status <> 'deprecated') USING (g, code) GROUP BY g)"
_W = "speaker AS (SELECT g, min(who) w FROM sp GROUP BY g)"
_G = "gs AS (SELECT DISTINCT g FROM f)"
_EVENTS = "['the_cabin_trip', 'chess_openings', 'volunteering']"
_OBJECTS = "['the_camper_van', 'two_concert_tickets', 'the_office_plants']"
_LO, _HI = "2022-03", "2023-06"
_CONF = "(CASE conf WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END)"


def _time(when: str, lo: str = f"'{_LO}'", hi: str = f"'{_HI}'") -> str:
    return f"({when} <> '' AND ({when} >= left({lo}, length({when})) OR left({when}, length({lo})) >= {lo}) AND {when} <= {hi} || '~')"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


# the closure of seeds (g, root): breadth first, cut by width
def _closure(seeds: str, name: str = "cl", depth: int = 3, width: int = 40, candidates: bool = True) -> str:
    live = "status <> 'deprecated'" + ("" if candidates else " AND status <> 'candidate'")
    return f"""{name}_e AS (SELECT ed.g, parent, child FROM ed JOIN tp ON tp.g = ed.g AND tp.code = ed.child WHERE {live}),
{name}_r AS (SELECT s.g, s.root, s.root code, 0 depth FROM ({seeds}) s JOIN tp ON tp.g = s.g AND tp.code = s.root
  UNION SELECT r.g, r.root, e.child, r.depth + 1 FROM {name}_r r JOIN {name}_e e ON e.g = r.g AND e.parent = r.code WHERE r.depth < {depth}),
{name}_m AS (SELECT g, root, code, min(depth) depth FROM {name}_r GROUP BY ALL),
{name} AS (SELECT g, root, code, depth FROM (SELECT *, row_number() OVER (PARTITION BY g, root ORDER BY depth, code) n FROM {name}_m) WHERE n <= {width})"""


_STEMS = "list_concat(list_transform(regexp_extract_all(lower({0}), '[a-z][a-z'']{{2,}}'), lambda w: left(w, 6)), flatten(list_transform(regexp_extract_all({0}, '[一-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)::BIGINT), lambda i: substr(r, i, 2)))))"
_D = f"docs AS (SELECT g, 'fact' AS type, id, {_STEMS.format('text')} toks FROM f UNION ALL SELECT g, 'line', id, {_STEMS.format('text')} FROM l)"
_I = """nd AS (SELECT g, count(*) n_docs FROM docs GROUP BY g), post AS (SELECT DISTINCT g, type, id, unnest(toks) stem FROM docs),
idf AS (SELECT g, stem, count(*) df, ln(1 + (any_value(n_docs) + 1) / (count(*) + 1)) idf, any_value(n_docs) n_docs FROM post JOIN nd USING (g) GROUP BY g, stem)"""
_SPEC = "spec AS (SELECT g, type, id, list_sum(list_slice(list_sort(list(idf), 'DESC'), 1, 3)) specificity FROM post JOIN idf USING (g, stem) GROUP BY ALL)"
_QUESTION = "qs AS (SELECT g, min(text) question FROM l WHERE text LIKE '%?%' GROUP BY g)"

# pattern requests: each alternative weighs the idf of its first six letters
_GREPPED = f"""terms AS (SELECT gs.g, t, coalesce(any_value(idf.idf), ln(1 + (coalesce(any_value(nd.n_docs), 0) + 1) / 1.0)) w FROM gs CROSS JOIN (SELECT unnest(['piano', 'ferry', 'kettle']) t) LEFT JOIN idf ON idf.g = gs.g AND idf.stem = left(t, 6) LEFT JOIN nd ON nd.g = gs.g GROUP BY ALL),
grepped AS (SELECT f.*, least(6.0, 0.9 * (SELECT sum(w) FROM terms WHERE terms.g = f.g AND contains(lower(f.text), terms.t))) + 0.2 * {_CONF} score FROM f WHERE regexp_matches(text, '(?i)piano|ferry|kettle'))"""

# topic, event, kind and speaker requests, relaxed
_SCORED = f"""{_closure("SELECT g, topic root FROM roots", "wide", 3, 60)}, {_closure("SELECT g, topic root FROM roots", "cl")},
q0 AS (SELECT gs.g, CASE WHEN EXISTS (SELECT 1 FROM wide JOIN f ON f.g = wide.g AND list_contains(f.topics, wide.code) WHERE wide.g = gs.g) THEN roots.topic END topic,
  coalesce(list_intersect({_EVENTS}, (SELECT list(DISTINCT x) FROM (SELECT unnest(event) x FROM f f2 WHERE f2.g = gs.g))), []) events,
  coalesce(list_intersect(['plan', 'decision'], (SELECT list(DISTINCT kind) FROM f f2 WHERE f2.g = gs.g)), []) kinds, speaker.w
  FROM gs LEFT JOIN roots ON roots.g = gs.g LEFT JOIN speaker ON speaker.g = gs.g),
q1 AS (SELECT * FROM q0 WHERE topic IS NOT NULL OR len(events) > 0 OR len(kinds) > 0),
st AS (SELECT f.*, q1.topic, q1.events, q1.kinds, q1.w, (SELECT list(code) FROM cl WHERE cl.g = f.g) codes,
  (SELECT list(DISTINCT cl.code) FROM cl JOIN ed ON ed.g = cl.g AND ed.child = cl.code WHERE cl.g = f.g) deep FROM f JOIN q1 ON q1.g = f.g),
st2 AS (SELECT *, greatest(CASE WHEN topic IS NULL OR list_has_any(topics, codes) THEN 0 ELSE 99 END, CASE WHEN len(events) = 0 OR list_has_any(event, events) THEN 0 ELSE 2 END,
  CASE WHEN len(kinds) = 0 OR list_contains(kinds, kind) THEN 0 ELSE 4 END, CASE WHEN w IS NULL OR who IN (w, 'both', 'multi') THEN 0 ELSE 6 END) step,
  CASE WHEN topic IS NOT NULL THEN 9 WHEN len(kinds) > 0 THEN 3 WHEN len(events) > 0 THEN 1 END most FROM st),
st3 AS (SELECT *, min(step) OVER (PARTITION BY g) taken FROM st2 WHERE step <= most),
scored AS (SELECT *, CASE WHEN topic IS NULL THEN 0.0 WHEN list_contains(topics, topic) THEN 3.0 WHEN list_has_any(topics, coalesce(deep, [])) THEN 2.0 WHEN list_has_any(topics, codes) THEN 0.8 ELSE 0.0 END
  + CASE WHEN taken < 2 AND list_has_any(event, events) THEN 1.5 ELSE 0 END + CASE WHEN taken < 4 AND list_contains(kinds, kind) THEN 1 ELSE 0 END
  + CASE WHEN taken < 6 AND w IS NOT NULL AND who IN (w, 'both', 'multi') THEN 0.5 ELSE 0 END + 0.2 * {_CONF} score FROM st3 WHERE step = taken)"""
_SCORED_OF = (_F, _T, _E, _S, _R, _W, _G, _SCORED)
_RANKED = "ra AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, eff, id) rank FROM scored)"
_POOL = """rb AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, eff, id) rank FROM grepped),
lsel AS (SELECT l.* FROM l LEFT JOIN speaker USING (g) WHERE l.g IN (SELECT g FROM gs) AND regexp_matches(text, '(?i)piano|ferry|kettle') AND (w IS NULL OR l.who = w)),
pool0 AS (SELECT g, 'F' AS type, id, unit, eff date, greatest(0, score - (rank - 1) * 1e-4) score FROM ra UNION ALL SELECT g, 'F', id, unit, eff, greatest(0, score - (rank - 1) * 1e-4) FROM rb UNION ALL SELECT g, 'L', id, unit, unit_date, 1.0 FROM lsel),
pool AS (SELECT g, type || '::' || id AS key, type, id, unit, date, max(score) score FROM pool0 GROUP BY ALL)"""
_POOL_OF = (*_SCORED_OF, _L, _D, _I, _GREPPED, _RANKED, _POOL)

_FUSED = f"""plan40 AS (SELECT g, 'fact' AS type, id, unit, score, rank FROM ra WHERE rank <= 40),
qstems AS (SELECT DISTINCT g, left(w, 6) stem FROM (SELECT g, unnest(regexp_extract_all(lower(question), '[a-z][a-z'']{{3,}}')) w FROM qs)),
dl AS (SELECT g, avg(len(toks)) a FROM docs GROUP BY g),
lex AS (SELECT g, type, id, s / (0.75 + 0.25 * n / a) score FROM (SELECT post.g, post.type, post.id, sum(idf.idf) s FROM post JOIN qstems USING (g, stem) JOIN idf USING (g, stem) GROUP BY ALL) JOIN (SELECT g, type, id, len(toks) n FROM docs) USING (g, type, id) JOIN dl USING (g)),
lexr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, type, id) rank FROM lex) WHERE rank <= 24),
anchor AS (SELECT g, left(min(date), 7) m FROM u GROUP BY g),
dw AS (SELECT f.g, f.id, CASE WHEN t <> '' AND left(t, 7) = m THEN 0 ELSE 1 END late, coalesce(specificity, 0) s FROM f JOIN anchor USING (g) LEFT JOIN spec ON spec.g = f.g AND spec.id = f.id AND spec.type = 'fact' WHERE m <> '' AND ((t <> '' AND left(t, 7) = m) OR starts_with(unit_date, m))),
dwr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY late, round(s, 9) DESC, id) rank FROM dw) WHERE rank <= 12),
ch AS (SELECT g, type, id, 0 c, rank FROM plan40 UNION ALL SELECT g, type, id, 1, rank FROM lexr UNION ALL SELECT g, 'fact', id, 2, rank FROM dwr),
fu AS (SELECT g, type, id, sum(1.0::DOUBLE / (59 + rank)) rrf, min(c * 1000 + rank) seen FROM ch GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(rrf, 12) DESC, seen) rank FROM fu)"""
_FUSED_OF = (*_SCORED_OF, _L, _U, _D, _I, _SPEC, _QUESTION, _RANKED, _FUSED)

_PUNCT = r"regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g')"
_ANSWER = r"list_filter(regexp_split_to_array(regexp_replace(" + _PUNCT + r", '\b(a|an|the)\b', ' ', 'g'), '\s+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "p4_found": _with(
        f"tp AS (SELECT DISTINCT codebook_id g, code FROM topic WHERE code IS NOT NULL)",
        f"ed AS (SELECT DISTINCT e.g, tp.code parent, child FROM (SELECT g, {_norm('p')} p, child FROM (SELECT codebook_id g, unnest(parents) p, code child FROM topic WHERE code IS NOT NULL)) e JOIN tp ON tp.g = e.g AND {_norm('tp.code')} = e.p WHERE e.p <> '')",
        "r AS (SELECT g, parent ancestor, child code FROM ed UNION SELECT r.g, r.ancestor, ed.child FROM r JOIN ed ON ed.g = r.g AND ed.parent = r.code)",
    )
    + "SELECT g codebook_id, ancestor, code FROM r",
    "norm_codes": f"SELECT raw, {_norm('raw')} code FROM (SELECT DISTINCT unnest(parents) raw FROM topic) WHERE raw IS NOT NULL",
    "topic_children": _with(_E) + "SELECT g, parent, child FROM ed",
    "topic_closure": _with(_T, _E, _closure("SELECT g, code root FROM tp")) + "SELECT g, root, code, depth::BIGINT depth FROM cl",
    "topic_closure_narrow": _with(_T, _E, _closure("SELECT g, code root FROM tp", depth=2, width=5, candidates=False)) + "SELECT g, root, code, depth::BIGINT depth FROM cl",
    "object_bridge": _with(_F) + "SELECT DISTINCT g, entity, unnest(obj) obj FROM (SELECT g, unnest(entities) entity, obj FROM f)",
    "resolve_entities": _with(_F, _N, _A, f"s AS (SELECT DISTINCT g, surface, {_norm('surface')} k FROM (SELECT g, unnest(entities) surface FROM f))", "a1 AS (SELECT g, surface k, min(code) told FROM al GROUP BY ALL)")
    + "SELECT s.g, s.surface, coalesce(en.code, told) code FROM s LEFT JOIN en ON en.g = s.g AND en.code = s.k LEFT JOIN a1 ON a1.g = s.g AND a1.k = s.k",
    "taxonomy_check": _with(_T, _E, "k AS (SELECT ed.* FROM ed JOIN tp ON tp.g = ed.g AND tp.code = ed.parent)", "r AS (SELECT g, parent a, child c FROM k UNION SELECT r.g, r.a, k.child FROM r JOIN k ON k.g = r.g AND k.parent = r.c)")
    + """SELECT g, 'missing parent' problem, child code, parent other FROM ed WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.g = ed.g AND tp.code = ed.parent)
    UNION ALL SELECT g, 'orphan candidate', code, '' FROM tp WHERE status = 'candidate' AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.g = tp.g AND ed.child = tp.code) UNION ALL SELECT g, 'on a circle', a, '' FROM r WHERE a = c""",
    "taxonomy_tree": _with(_T, _E, "lv AS (SELECT g, code, status FROM tp WHERE status <> 'deprecated')", "tr AS (SELECT g, code, [code] path FROM lv WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.g = lv.g AND ed.child = lv.code) UNION ALL SELECT tr.g, ed.child, list_append(tr.path, ed.child) FROM tr JOIN ed ON ed.g = tr.g AND ed.parent = tr.code JOIN lv ON lv.g = ed.g AND lv.code = ed.child WHERE NOT list_contains(tr.path, ed.child))")
    + "SELECT g, n::BIGINT line_no, (len(path) - 1)::BIGINT depth, code, CASE WHEN status = 'candidate' THEN '?' ELSE '' END mark FROM (SELECT tr.*, lv.status, row_number() OVER (PARTITION BY tr.g ORDER BY path) n FROM tr JOIN lv USING (g, code)) WHERE n <= 200",
    "promotion_pass": _with(_F, _T, "us AS (SELECT DISTINCT g, unnest(topics) code, unit, left(unit_date, 7) bucket FROM f)")
    + "SELECT g, code, count(DISTINCT unit) n_units, count(DISTINCT bucket) n_buckets FROM us JOIN tp USING (g, code) WHERE status = 'candidate' GROUP BY ALL HAVING count(DISTINCT unit) >= 3 AND count(DISTINCT bucket) >= 2",
    "consolidation_pressure": _with(_T) + "SELECT g, count(*) FILTER (status = 'candidate') n_candidates, count(*) FILTER (status = 'candidate') > 60 pressed FROM tp GROUP BY g",
    "consolidation_candidates": _with(_F, _T, _E, "us AS (SELECT DISTINCT g, unnest(topics) code, unit FROM f)", "c AS (SELECT ed.g, parent, child FROM ed JOIN tp ON tp.g = ed.g AND tp.code = ed.child WHERE status = 'candidate')", "pr AS (SELECT DISTINCT x.g, x.child a, y.child b FROM c x JOIN c y ON x.g = y.g AND x.parent = y.parent AND x.child < y.child)")
    + "SELECT g, a, b FROM pr WHERE (SELECT count(*) FROM us x JOIN us y ON x.g = y.g AND x.unit = y.unit WHERE x.g = pr.g AND x.code = a AND y.code = b) >= 2 OR starts_with(a, b) OR starts_with(b, a) OR ends_with(a, b) OR ends_with(b, a)",
    "entity_merge_candidates": _with(_N, r"c AS (SELECT g, code FROM en WHERE NOT regexp_matches(code, '\d') AND length(code) >= 2)")
    + "SELECT x.g, x.code a, y.code b FROM c x JOIN c y ON x.g = y.g AND x.code < y.code WHERE (least(length(x.code), length(y.code)) >= 3 AND (contains(x.code, y.code) OR contains(y.code, x.code))) OR (length(x.code) = length(y.code) AND len(list_filter(range(1, length(x.code)::BIGINT + 1), lambda i: substr(x.code, i, 1) <> substr(y.code, i, 1))) = 1)",
    "merge_rewrite": _with(_F, _T, _E, "rw AS (SELECT ed.g, child loser, min(parent) winner FROM ed JOIN tp ON tp.g = ed.g AND tp.code = ed.child WHERE status = 'deprecated' GROUP BY ALL)", "x AS (SELECT g, id, topics, unnest(topics) t, generate_subscripts(topics, 1) i FROM f)", "y AS (SELECT x.g, x.id, coalesce(winner, t) t, min(i) i FROM x LEFT JOIN rw ON rw.g = x.g AND rw.loser = x.t GROUP BY ALL)", "raw AS (SELECT g, id, array_to_string(topics, ' ') joined FROM f WHERE g NOT IN (SELECT g FROM rw))")
    + "SELECT f.g, f.id, coalesce(raw.joined, (SELECT string_agg(t, ' ' ORDER BY i) FROM y WHERE y.g = f.g AND y.id = f.id), '') topics FROM f LEFT JOIN raw USING (g, id)",
    "deprecate_topics": _with(_T, _E, "gone AS (SELECT g, code FROM tp WHERE status = 'deprecated')")
    + "SELECT g, parent, child FROM ed WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.g = ed.g AND gone.code = ed.parent) UNION SELECT x.g, y.parent, x.child FROM ed x JOIN gone ON gone.g = x.g AND gone.code = x.parent JOIN ed y ON y.g = x.g AND y.child = x.parent",
    "admission": _with(
        _T, _E, "pa AS (SELECT g, child code, min(parent) parent FROM ed GROUP BY ALL)",
        "bo AS (SELECT tp.g, born unit, tp.code, coalesce(parent, '') parent FROM tp LEFT JOIN pa ON pa.g = tp.g AND pa.code = tp.code WHERE born <> '')",
        "pr AS (SELECT g, unit, reverse(code) || ' ' || code seq, code raw, parent FROM bo UNION ALL SELECT g, unit, reverse(code) || ' ' || code || ' anew', code || ' anew', parent FROM bo)",
        f"nf AS (SELECT g, unit, seq, {_norm('raw')} code, {_norm('parent')} parent FROM pr)",
        "lv AS (SELECT g, code FROM tp WHERE status <> 'deprecated')",
        "jo AS (SELECT nf.*, o.code IS NOT NULL known, a.code IS NOT NULL parented FROM nf LEFT JOIN lv o ON o.g = nf.g AND o.code = nf.code LEFT JOIN lv a ON a.g = nf.g AND a.code = nf.parent)",
        "fr AS (SELECT *, code <> '' AND NOT known AND parented fresh FROM jo)",
        "nw AS (SELECT *, fresh AND row_number() OVER (PARTITION BY g, unit, code, fresh ORDER BY seq) = 1 new FROM fr)",
        "ad AS (SELECT *, new AND sum(new::INT) OVER (PARTITION BY g, unit ORDER BY seq) <= 2 adm FROM nw)",
    ) + """SELECT g, unit, seq, code, parent, CASE WHEN known THEN 'touched' WHEN NOT fresh THEN 'rejected' WHEN adm THEN 'admitted'
      WHEN max(adm) OVER (PARTITION BY g, unit, code) AND NOT new THEN 'touched' ELSE 'folded' END outcome FROM ad""",
    "match_topic": _with(_F, _T, _E, _R, _closure("SELECT g, topic root FROM roots")) + "SELECT DISTINCT f.g, f.id, 0::BIGINT taken FROM f JOIN cl ON cl.g = f.g AND list_contains(f.topics, cl.code)",
    "match_facets": _with(_F) + f"SELECT g, id, 0::BIGINT taken FROM f WHERE list_has_any(obj, {_OBJECTS})",
    "match_entity_bridge": _with(_F, _N, _A, "q AS (SELECT g, min(code) e FROM en WHERE etype = 'person' GROUP BY g)", "ec AS (SELECT g, e code FROM q UNION SELECT q.g, surface FROM q JOIN al ON al.g = q.g AND al.code = q.e)", "ob AS (SELECT DISTINCT q.g, unnest(obj) o FROM q JOIN f ON f.g = q.g AND list_contains(f.entities, q.e))")
    + "SELECT g, id, 0::BIGINT taken FROM f WHERE list_has_any(entities, (SELECT list(code) FROM ec WHERE ec.g = f.g)) OR list_has_any(obj, (SELECT list(o) FROM ob WHERE ob.g = f.g))",
    "match_kind_legal": _with(_F) + "SELECT g, id, 0::BIGINT taken FROM f WHERE (kind IN ('plan', 'decision') OR kind NOT IN ('event', 'decision', 'plan', 'state', 'purchase')) AND EXISTS (SELECT 1 FROM f f2 WHERE f2.g = f.g AND f2.kind IN ('plan', 'decision'))",
    "match_who": _with(_F, _S, _W) + "SELECT f.g, f.id, 0::BIGINT taken FROM f LEFT JOIN speaker USING (g) WHERE w IS NULL OR who IN (w, 'both', 'multi')",
    "match_time_partial": _with(_F) + f"SELECT g, id, 0::BIGINT taken FROM f WHERE {_time('eff')}",
    "match_grep": _with(_F) + "SELECT g, id, 0::BIGINT taken FROM f WHERE regexp_matches(text, '(?i)piano|ferry|kettle')",
    "match_grep_all": _with(_F) + "SELECT g, id, 0::BIGINT taken FROM f WHERE regexp_matches(text, '(?i)paid|booked') AND regexp_matches(text, '(?i)with')",
    "match_entity_kind": _with(_F, _N, "ty AS (SELECT g, list(code) codes FROM en WHERE contains(lower(etype), 'org') GROUP BY g)") + "SELECT f.g, id, 0::BIGINT taken FROM f JOIN ty USING (g) WHERE list_has_any(entities, codes)",
    "match_conf": _with(_F) + "SELECT g, id, 0::BIGINT taken FROM f WHERE kind = 'plan' AND conf = 'high'",
    "relax_ladder": _with(
        _F, _S, _W, _G,
        f"q AS (SELECT gs.g, w, coalesce(list_intersect({_EVENTS}, (SELECT list(DISTINCT x) FROM (SELECT unnest(event) x FROM f f2 WHERE f2.g = gs.g))), []) events, coalesce(list_intersect({_OBJECTS}, (SELECT list(DISTINCT x) FROM (SELECT unnest(obj) x FROM f f2 WHERE f2.g = gs.g))), []) objs, coalesce(list_intersect(['plan', 'decision'], (SELECT list(DISTINCT kind) FROM f f2 WHERE f2.g = gs.g)), []) kinds FROM gs LEFT JOIN speaker USING (g))",
        f"s AS (SELECT f.g, f.id, greatest(CASE WHEN regexp_matches(text, '(?i)piano|ferry|kettle') THEN 0 ELSE 1 END, CASE WHEN len(events) = 0 OR list_has_any(event, events) THEN 0 ELSE 2 END, CASE WHEN len(objs) = 0 OR list_has_any(obj, objs) THEN 0 ELSE 3 END, CASE WHEN len(kinds) = 0 OR list_contains(kinds, kind) THEN 0 ELSE 4 END, CASE WHEN w IS NULL OR who IN (w, 'both', 'multi') THEN 0 ELSE 6 END, CASE WHEN {_time('eff')} THEN 0 ELSE 8 END) step, greatest(1, CASE WHEN len(events) > 0 THEN 2 ELSE 0 END, CASE WHEN len(objs) > 0 THEN 3 ELSE 0 END, CASE WHEN len(kinds) > 0 THEN 4 ELSE 0 END) - 1 most FROM f JOIN q USING (g))",
        "m AS (SELECT *, min(step) OVER (PARTITION BY g) taken FROM s WHERE step <= most)",
    )
    + "SELECT g, id, taken::BIGINT taken FROM m WHERE step = taken",
    "specialise": _with(
        _F, _T, _E, _R, _closure("SELECT g, topic root FROM roots"),
        "m AS (SELECT f.g, f.id, min(cl.depth) tdepth FROM f JOIN cl ON cl.g = f.g AND list_contains(f.topics, cl.code) GROUP BY ALL)",
        "n AS (SELECT g, count(*) FILTER (tdepth <= 1) n1, count(*) FILTER (tdepth <= 2) n2, count(*) n3 FROM m GROUP BY g)",
        "d AS (SELECT g, CASE WHEN n3 <= 6 THEN 3 WHEN n2 <= 6 THEN 2 WHEN n1 <= 6 THEN 1 ELSE 0 END depth FROM n)",
    )
    + "SELECT g, id, tdepth::BIGINT tdepth, depth::BIGINT depth FROM m JOIN d USING (g) WHERE tdepth <= depth",
    "dead_value_prune": _with(_F, _T, _E, _R, _G, _closure("SELECT g, topic root FROM roots", "cl", 3, 60), f"q AS (SELECT gs.g, list_sort(coalesce(list_intersect({_EVENTS}, (SELECT list(DISTINCT x) FROM (SELECT unnest(event) x FROM f f2 WHERE f2.g = gs.g))), [])) ev, list_sort(coalesce(list_intersect({_OBJECTS}, (SELECT list(DISTINCT x) FROM (SELECT unnest(obj) x FROM f f2 WHERE f2.g = gs.g))), [])) ob, roots.topic t0, CASE WHEN EXISTS (SELECT 1 FROM cl JOIN f f2 ON f2.g = cl.g AND list_contains(f2.topics, cl.code) WHERE cl.g = gs.g) THEN roots.topic END t1 FROM gs LEFT JOIN roots USING (g))")
    + "SELECT g, len(ev) < 3 OR len(ob) < 3 OR (t0 IS NOT NULL AND t1 IS NULL) pruned, array_to_string(ev, ' ') event, array_to_string(ob, ' ') obj, coalesce(t1, '') topics FROM q WHERE len(ev) > 0 OR len(ob) > 0 OR t1 IS NOT NULL",
    "score_facts": _with(*_SCORED_OF) + "SELECT g, id, taken::BIGINT taken, round(score::DOUBLE, 6) score FROM scored",
    "score_by_type": _with(_F, _N, "ep AS (SELECT g, e, count(*) n FROM (SELECT DISTINCT g, id, unnest(entities) e FROM f) GROUP BY ALL)", "b AS (SELECT x.g, x.id, max(least(3.5, 6.0 / (1 + log2(1 + n)))) best FROM (SELECT DISTINCT g, id, unnest(entities) e FROM f) x JOIN ep ON ep.g = x.g AND ep.e = x.e JOIN en ON en.g = x.g AND en.code = x.e WHERE contains(lower(etype), 'org') GROUP BY ALL)")
    + f"SELECT f.g, f.id, round(best + 0.2 * {_CONF}, 6)::DOUBLE score FROM f JOIN b USING (g, id)",
    "grep_idf_score": _with(_F, _L, _G, _D, _I, _GREPPED) + "SELECT g, id, round(score, 6)::DOUBLE score FROM grepped",
    "sort_dur_tail": _with(*_SCORED_OF, _U, _RANKED, "s1 AS (SELECT ra.g, ra.id, row_number() OVER (PARTITION BY ra.g ORDER BY coalesce(dur_min, 0), ra.rank) r, count(*) OVER (PARTITION BY ra.g) n FROM ra LEFT JOIN u ON u.g = ra.g AND u.id = ra.unit)")
    + "SELECT g, id, (r - greatest(0, n - 2))::BIGINT rank FROM s1 WHERE n - r < 2",
    "count_facts": _with(*_SCORED_OF, _RANKED) + "SELECT g, count(*) n, string_agg(id, ' ' ORDER BY rank) FILTER (rank <= 40) members FROM ra GROUP BY g",
    "pool_subqueries": _with(*_POOL_OF) + "SELECT g, key, unit, date, round(score, 6)::DOUBLE score FROM pool",
    "pack_unit_cap": _with(*_POOL_OF, "pk AS (SELECT *, row_number() OVER (PARTITION BY g, unit ORDER BY round(score, 9) DESC, key) n FROM pool)", "pk2 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, key) seat FROM pk WHERE n <= 2)")
    + "SELECT g, key, unit, date, round(score, 6)::DOUBLE score, seat::BIGINT seat FROM pk2 WHERE seat <= 12",
    "pack_quota": _with(
        *_POOL_OF,
        "early AS (SELECT g, key, min(sub * 10 + rank) e FROM (SELECT g, 'F::' || id AS key, 0 sub, rank FROM ra WHERE rank <= 2 UNION ALL SELECT g, 'F::' || id, 1, rank FROM rb WHERE rank <= 2) GROUP BY ALL)",
        "pk AS (SELECT pool.*, e, row_number() OVER (PARTITION BY pool.g, unit ORDER BY coalesce(e, 1000), round(score, 9) DESC, pool.key) n FROM pool LEFT JOIN early ON early.g = pool.g AND early.key = pool.key)",
        "pk2 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n > 2, coalesce(e, 1000), round(score, 9) DESC, key) seat FROM pk)",
    )
    + "SELECT g, key, unit, date, round(score, 6)::DOUBLE score, seat::BIGINT seat FROM pk2 WHERE seat <= 12",
    "select_units_grep": _with(_F, _U, _G, "h AS (SELECT g, unit id, count(*) hits FROM f WHERE regexp_matches(text, '(?i)garden|piano') GROUP BY ALL)", "r AS (SELECT u.g, u.id, u.date, 10 * (regexp_matches(title, '(?i)garden')::INT + regexp_matches(title, '(?i)piano')::INT) + least(coalesce(hits, 0), 8) relevance FROM u JOIN gs USING (g) LEFT JOIN h USING (g, id) WHERE u.date <> '' AND (u.date >= '2021' OR left(u.date, 4) >= '2021'))")
    + "SELECT g, id, relevance::BIGINT relevance, row_number() OVER (PARTITION BY g ORDER BY relevance DESC, date, id)::BIGINT rank FROM r WHERE relevance > 0",
    "count_units": _with(_F, _U, _G, "h AS (SELECT DISTINCT g, unit id FROM f WHERE regexp_matches(text, '(?i)garden|piano'))") + "SELECT u.g, count(*) n FROM u JOIN gs USING (g) WHERE u.date >= '2021' AND (regexp_matches(title, '(?i)garden|piano') OR (u.g, u.id) IN (SELECT g, id FROM h)) GROUP BY u.g",
    "select_lines": _with(_F, _L, _S, _W, _G) + f"SELECT l.g, l.id, l.unit FROM l JOIN gs USING (g) LEFT JOIN speaker USING (g) WHERE regexp_matches(text, '(?i)piano|ferry|kettle') AND (w IS NULL OR l.who = w) AND {_time('unit_date')}",
    "staged_plan": _with(_F, _L, _G, _D, _I, _GREPPED, "s1 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, eff, id) rank FROM grepped)", "b AS (SELECT g, list(DISTINCT unit) units, min(eff) lo FROM s1 WHERE rank <= 2 GROUP BY g)")
    + "SELECT l.g, l.id, l.unit FROM l JOIN b USING (g) WHERE list_contains(units, l.unit) AND (lo = '' OR (unit_date <> '' AND (unit_date >= left(lo, length(unit_date)) OR left(unit_date, length(lo)) >= lo)))",
    "stem_idf": _with(_F, _L, _D, _I) + "SELECT g, stem, df, round(idf, 6) idf FROM idf",
    "document_length": _with(_F, _L, _D) + "SELECT g, count(*) n_docs, round(avg(len(toks)), 6) avg_tokens FROM docs GROUP BY g",
    "fact_specificity": _with(_F, _L, _D, _I, _SPEC) + "SELECT g, id, round(specificity, 6) specificity FROM spec WHERE type = 'fact'",
    "lexical_postings": _with(*_FUSED_OF) + "SELECT g, type, id, round(score, 6) score, rank::BIGINT rank FROM lexr",
    "lexical_plain": _with(_F, _L, _D, _I, _QUESTION, "kw AS (SELECT DISTINCT g, unnest(regexp_extract_all(lower(question), '[a-z]{4,}')) k FROM qs)", "kws AS (SELECT kw.g, k, coalesce(idf.idf, ln(1 + (nd.n_docs + 1) / 1.0)) w FROM kw LEFT JOIN idf ON idf.g = kw.g AND idf.stem = kw.k JOIN nd ON nd.g = kw.g)", "tx AS (SELECT g, 'fact' AS type, id, lower(text) text FROM f UNION ALL SELECT g, 'line', id, lower(text) FROM l)", "sc AS (SELECT tx.g, type, id, sum(w ORDER BY k) score FROM tx JOIN kws ON kws.g = tx.g AND contains(tx.text, kws.k) GROUP BY ALL)", "rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, type, id) rank FROM sc WHERE score > 0)")
    + "SELECT g, type, id, round(score, 6) score, rank::BIGINT rank FROM rk WHERE rank <= 24",
    "date_window": _with(*_FUSED_OF) + "SELECT g, id, round(3.0 - 0.1 * (rank - 1), 6)::DOUBLE score, rank::BIGINT rank FROM dwr",
    "rrf_fusion": _with(*_FUSED_OF) + "SELECT g, type, id, round(rrf, 9) rrf, rank::BIGINT rank FROM fused",
    "recency_context": _with(_F, "r AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY unit_date DESC, id) rank FROM f WHERE kind <> 'plan')") + "SELECT g, id, rank::BIGINT rank FROM r WHERE rank <= 8",
    "hydrate": _with(_F, _L, "x AS (SELECT g, id, s, min(i) i FROM (SELECT g, id, unnest(src) s, generate_subscripts(src, 1) i FROM f) GROUP BY ALL)", "y AS (SELECT x.g, x.id, string_agg(l.id || '=' || l.text, '|' ORDER BY i) sources FROM x JOIN l ON l.g = x.g AND l.id = x.s GROUP BY ALL)")
    + "SELECT f.g, f.id, eff date, len(list_distinct(src))::BIGINT n_sources, coalesce(sources, '') sources FROM f LEFT JOIN y USING (g, id)",
    "neighbour_context": _with(_F, _L, "p AS (SELECT *, row_number() OVER (PARTITION BY g, unit ORDER BY pos, id) - 1 place FROM l)", "ci AS (SELECT DISTINCT g, unnest(src) id FROM f WHERE kind = 'decision')", "h AS (SELECT p.g, p.unit, p.place FROM ci JOIN p USING (g, id))")
    + "SELECT DISTINCT p.g, p.unit, p.id, p.place::BIGINT \"at\" FROM p JOIN h ON h.g = p.g AND h.unit = p.unit AND abs(h.place - p.place) = 1 WHERE NOT EXISTS (SELECT 1 FROM ci WHERE ci.g = p.g AND ci.id = p.id)",
    "profile_block": _with(_F, "t1 AS (SELECT *, CASE WHEN len(topics) > 0 THEN topics[1] ELSE 'misc' END topic FROM f WHERE kind IN ('preference', 'identity'))", "t2 AS (SELECT *, row_number() OVER (PARTITION BY g, topic ORDER BY unit_date DESC, id) n FROM t1)", "t3 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY unit_date DESC, id) rank FROM t2 WHERE n = 1)")
    + "SELECT g, topic, id, unit_date, left(text, 150) text, rank::BIGINT rank FROM t3 WHERE rank <= 15",
    "session_dialogues": _with(
        _L, _U, "ui AS (SELECT DISTINCT g, id unit FROM u)", "p AS (SELECT l.*, row_number() OVER (PARTITION BY g, unit ORDER BY pos, id) - 1 place FROM l)",
        "r AS (SELECT p.g, p.unit, id, place, '(' || id || ') ' || who || ': ' lab, '(' || id || ') ' || who || ': ' || text AS row FROM p JOIN ui USING (g, unit))",
        "s AS (SELECT *, sum(length(row) + 1) OVER (PARTITION BY g, unit ORDER BY place ROWS UNBOUNDED PRECEDING) - length(row) - 1 start FROM r)",
        "e AS (SELECT *, max(start + length(row)) OVER (PARTITION BY g, unit) ends FROM s)",
    )
    + "SELECT g, unit, left(string_agg(row, chr(10) ORDER BY place), 6000) body, coalesce(string_agg(id, ' ' ORDER BY place) FILTER (start + length(lab) < least(6000, ends)), '') shown FROM e GROUP BY g, unit",
    "spoken_lines": _with(_L, r"""lb AS (SELECT g, id, text, left(trim(regexp_replace(regexp_replace(who, '[\[\]()|:"''<>\\/\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), 24) label FROM l)""")
    + "SELECT g, id, CASE WHEN label <> '' THEN label || ': ' || text ELSE text END AS row FROM lb",
    "sessions_of_facts": _with(_F) + r"SELECT g, id, regexp_replace(regexp_replace(id, '[FL]\d+$', ''), ':\d+$', '') sessions FROM f",
    "stratified_questions": """WITH q AS (SELECT DISTINCT question_id, question_type, suffix(question_id, '_abs') a FROM longmemeval_s_cleaned), n AS (SELECT greatest(1, 20 // count(DISTINCT question_type)) quota FROM q),
      r AS (SELECT *, row_number() OVER (PARTITION BY question_type, a ORDER BY question_id) nth, row_number() OVER (PARTITION BY a ORDER BY question_id) every FROM q),
      t AS (SELECT question_id, question_type, CASE WHEN a AND every <= 2 THEN 0 WHEN NOT a AND nth <= quota THEN 1 ELSE 2 END tier FROM r, n)
      SELECT question_id, question_type FROM t ORDER BY tier, question_id LIMIT 20""",
    "facet_codes": _with(
        "x AS (SELECT DISTINCT codebook_id, id, obj, dur FROM fact)",
        f"e AS (SELECT codebook_id, id, i, {_norm('v')} c FROM (SELECT DISTINCT codebook_id, id, unnest(obj) v, generate_subscripts(obj, 1) i FROM x) WHERE v IS NOT NULL)",
        "n AS (SELECT codebook_id, id, i, CASE WHEN c LIKE '%ies' AND length(c) > 3 THEN left(c, length(c) - 3) || 'y' WHEN c LIKE '%s' AND c NOT LIKE '%ss' AND length(c) > 3 THEN left(c, length(c) - 1) ELSE c END c FROM e WHERE c <> '')",
        "m AS (SELECT codebook_id, id, c, min(i) i FROM n GROUP BY ALL)", "k AS (SELECT *, row_number() OVER (PARTITION BY codebook_id, id ORDER BY i) r FROM m)",
        "o AS (SELECT codebook_id, id, string_agg(c, ' ' ORDER BY i) obj FROM k WHERE r <= 4 GROUP BY ALL)", "d AS (SELECT codebook_id, id, upper(trim(coalesce(dur, ''))) u FROM x)",
    )
    + r"SELECT d.codebook_id, d.id, coalesce(o.obj, '') obj, CASE WHEN u <> 'P' AND regexp_full_match(u, 'P(\d+Y)?(\d+M)?(\d+W)?(\d+D)?') THEN u ELSE '' END dur FROM d LEFT JOIN o ON o.codebook_id = d.codebook_id AND o.id = d.id",
    "match_topics_mixed": _with(
        _F, _T, _E, "rt AS (SELECT g, min(code) a, max(code) b FROM (SELECT DISTINCT g, parent code FROM ed) JOIN (SELECT g, code FROM tp WHERE status <> 'deprecated') USING (g, code) GROUP BY g HAVING min(code) <> max(code))",
        _closure("SELECT g, b root FROM rt", "cb"), _closure("SELECT g, a root FROM rt", "ca"),
        "ask AS (SELECT g, a code FROM rt UNION SELECT g, code FROM cb)", "wide AS (SELECT g, code FROM ca UNION SELECT g, code FROM cb)",
        "m0 AS (SELECT DISTINCT f.g, f.id FROM f JOIN ask ON ask.g = f.g AND list_contains(f.topics, ask.code))",
        "m9 AS (SELECT DISTINCT f.g, f.id FROM f JOIN wide ON wide.g = f.g AND list_contains(f.topics, wide.code))",
    )
    + "SELECT g, id, 0::BIGINT taken FROM m0 UNION ALL SELECT g, id, 9 FROM m9 WHERE g NOT IN (SELECT g FROM m0)",
    "match_unreadable_pattern": _with(_F) + "SELECT g, id, 0::BIGINT taken FROM f WHERE kind IN ('plan', 'decision')",
    "merged_topic_links": _with(_T, _E, "rw AS (SELECT ed.g, child loser, min(parent) winner FROM ed JOIN tp p ON p.g = ed.g AND p.code = parent JOIN tp c ON c.g = ed.g AND c.code = child WHERE c.status = 'candidate' GROUP BY ALL)")
    + "SELECT DISTINCT ed.g, coalesce(w.winner, parent) parent, child FROM ed LEFT JOIN rw w ON w.g = ed.g AND w.loser = parent WHERE NOT EXISTS (SELECT 1 FROM rw WHERE rw.g = ed.g AND rw.loser = child) AND coalesce(w.winner, parent) <> child",
    "p4_paths": _with(
        "tp AS (SELECT DISTINCT codebook_id g, code FROM topic WHERE code IS NOT NULL)",
        f"ed AS (SELECT DISTINCT e.g, tp.code parent, child FROM (SELECT g, {_norm('p')} p, child FROM (SELECT codebook_id g, unnest(parents) p, code child FROM topic WHERE code IS NOT NULL)) e JOIN tp ON tp.g = e.g AND {_norm('tp.code')} = e.p WHERE e.p <> '')",
        "r AS (SELECT g, parent ancestor, child code FROM ed UNION SELECT r.g, r.ancestor, ed.child FROM r JOIN ed ON ed.g = r.g AND ed.parent = r.code)",
        "ci AS (SELECT g, code FROM r WHERE ancestor = code)", "nd AS (SELECT g, ancestor code, count(*) n FROM r GROUP BY ALL)",
        "fr AS (SELECT ed.* FROM ed WHERE NOT EXISTS (SELECT 1 FROM ci WHERE ci.g = ed.g AND ci.code = ed.child))",
        "pa AS (SELECT g, code, code root, code path, 0 depth FROM tp WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.g = tp.g AND fr.child = tp.code) UNION ALL SELECT pa.g, fr.child, root, path || '/' || fr.child, depth + 1 FROM pa JOIN fr ON fr.g = pa.g AND fr.parent = pa.code)",
    )
    + "SELECT pa.g codebook_id, pa.code, root, path, depth, ci.code IS NOT NULL on_circle, coalesce(n, 0) n_descendants FROM pa LEFT JOIN ci ON ci.g = pa.g AND ci.code = pa.code LEFT JOIN nd ON nd.g = pa.g AND nd.code = pa.code",
    "p3_turns": r"""WITH sess AS (SELECT sample_id, k, json_extract(record, '$.conversation.' || k) v FROM (SELECT DISTINCT sample_id, record, unnest(json_keys(record, '$.conversation')) k FROM locomo10 WHERE json_valid(record)) WHERE regexp_full_match(k, 'session_\d+')),
      ts AS (SELECT sample_id, k, json_extract(CASE json_type(v) WHEN 'ARRAY' THEN v WHEN 'OBJECT' THEN json_extract(v, '$.turns') END, '$[*]') t FROM sess),
      tu AS (SELECT sample_id, k, unnest(t) t, generate_subscripts(t, 1) - 1 p FROM ts),
      hs AS (SELECT question_id, unnest(haystack_sessions) s, generate_subscripts(haystack_sessions, 1) - 1 sp FROM longmemeval_s_cleaned), ht AS (SELECT question_id, sp, unnest(s) t, generate_subscripts(s, 1) - 1 tp FROM hs)
      SELECT DISTINCT sample_id rec_id, k parent_key, p::BIGINT pos, CASE WHEN json_type(t, '$.speaker') = 'VARCHAR' THEN t ->> '$.speaker' END who, CASE WHEN json_type(t, '$.text') = 'VARCHAR' THEN t ->> '$.text' END text FROM tu WHERE json_type(t) = 'OBJECT'
      UNION SELECT question_id, sp::VARCHAR, tp::BIGINT, t.role, t.content FROM ht""",
    "codebook_summary": _with(_F, _L, _U, _T, _N, "ag AS (SELECT g, count(*) n_units, min(date) a, max(date) b FROM u GROUP BY g)", "al2 AS (SELECT g FROM f UNION SELECT g FROM l UNION SELECT g FROM u UNION SELECT g FROM tp UNION SELECT g FROM en)", "cf AS (SELECT g, count(*) n FROM f GROUP BY g)", "cl AS (SELECT g, count(*) n FROM l GROUP BY g)", "ct AS (SELECT g, count(*) n FROM tp GROUP BY g)", "ce AS (SELECT g, count(*) n FROM en GROUP BY g)")
    + "SELECT al2.g, coalesce(n_units, 0) n_units, coalesce(cf.n, 0) n_facts, coalesce(cl.n, 0) n_lines, coalesce(ct.n, 0) n_topics, coalesce(ce.n, 0) n_entities, coalesce(a, '') first_date, coalesce(b, '') last_date FROM al2 LEFT JOIN ag USING (g) LEFT JOIN cf USING (g) LEFT JOIN cl USING (g) LEFT JOIN ct USING (g) LEFT JOIN ce USING (g)",
    "dangling_sources": _with(_F, _L, "x AS (SELECT DISTINCT g, id, unnest(src) line FROM f)") + "SELECT g, id, line FROM x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.g = x.g AND l.id = x.line)",
    "undeclared_codes": _with(_F, _T, _N, "x AS (SELECT DISTINCT g, 'topics' axis, unnest(topics) code, id FROM f UNION SELECT DISTINCT g, 'entities', unnest(entities), id FROM f)")
    + "SELECT g, axis, code, count(*) n_facts FROM x WHERE NOT EXISTS (SELECT 1 FROM tp WHERE axis = 'topics' AND tp.g = x.g AND tp.code = x.code) AND NOT EXISTS (SELECT 1 FROM en WHERE axis = 'entities' AND en.g = x.g AND en.code = x.code) GROUP BY ALL",
    "record_conflicts": "SELECT codebook_id, code, count(DISTINCT (codebook_id, code, parents, status, born)) versions FROM topic GROUP BY ALL HAVING count(DISTINCT (codebook_id, code, parents, status, born)) > 1",
    "answer_metrics": _with(
        _F, _L,
        f"x AS (SELECT f.g, f.kind, {_ANSWER.format('f.text')} p, {_ANSWER.format('l.text')} r FROM f JOIN l ON l.g = f.g AND l.id = f.src[1] WHERE len(src) > 0)",
        "y AS (SELECT kind, len(p) np, len(r) nr, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda a: a = w)), len(list_filter(r, lambda a: a = w))))), 0) o FROM x)",
        "z AS (SELECT kind, CASE WHEN np = 0 OR nr = 0 THEN CASE WHEN np = nr THEN 1.0 ELSE 0.0 END ELSE 2.0 * o / (np + nr) END f1, CASE WHEN np = 0 THEN 0.0 ELSE CASE WHEN np >= nr THEN 1.0 ELSE exp(1 - nr / greatest(1, np)) END * o / np END bleu1 FROM y)",
    )
    + "SELECT coalesce(kind, '(all)') kind, count(*) n, round(avg(f1), 6) f1, round(avg(bleu1), 6) bleu1 FROM z GROUP BY ROLLUP (kind)",
    "evidence_recall": "WITH x AS (SELECT DISTINCT question_id, question_type, answer_session_ids a, haystack_session_ids h FROM longmemeval_s_cleaned), y AS (SELECT question_type, CASE WHEN len(list_distinct(a)) > 0 THEN len(list_intersect(list_distinct(a), h)) / len(list_distinct(a)) END r FROM x) SELECT coalesce(question_type, '(all)') question_type, count(*) n, round(avg(r), 6) recall FROM y GROUP BY ROLLUP (question_type)",
    "reconcile_lines": _with(_F, "h AS (SELECT codebook_id g, id, count(*) n FROM line GROUP BY ALL)", "w AS (SELECT DISTINCT g, unnest(src) id FROM f)")
    + "SELECT * FROM (SELECT coalesce(h.g, w.g) g, coalesce(h.id, w.id) id, CASE WHEN n IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'foreign' WHEN n > 1 THEN 'repeated' END problem FROM h FULL JOIN w ON w.g = h.g AND w.id = h.id) WHERE problem IS NOT NULL",
    "telling_terms": _with(_F, "w AS (SELECT g, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) term FROM f)", "e AS (SELECT term, g, count(*) k FROM w GROUP BY ALL)") + "SELECT term, count(*) n_docs, sum(k)::BIGINT n FROM e GROUP BY term HAVING count(*) <= 0.3 * (SELECT count(DISTINCT g) FROM f) AND sum(k) >= 5",
    "p3_found": _with(
        r"sess AS (SELECT sample_id, k, json_extract(record, '$.conversation.' || k) v FROM (SELECT sample_id, record, unnest(json_keys(record, '$.conversation')) k FROM locomo10 WHERE json_valid(record)) WHERE regexp_full_match(k, 'session_\d+'))",
        "tu AS (SELECT sample_id, k, json_extract_string(t, '$.dia_id') dia FROM (SELECT sample_id, k, unnest(json_extract(CASE json_type(v) WHEN 'ARRAY' THEN v WHEN 'OBJECT' THEN json_extract(v, '$.turns') END, '$[*]')) t FROM sess))",
        "tn AS (SELECT DISTINCT sample_id, k, dia FROM tu WHERE trim(dia) <> '')",
        "qa AS (SELECT sample_id, unnest(json_extract(record, '$.qa[*]')) q, generate_subscripts(json_extract(record, '$.qa[*]'), 1) - 1 p FROM locomo10 WHERE json_valid(record))",
        r"ev AS (SELECT DISTINCT sample_id, p, unnest(regexp_extract_all(json_extract(q, '$.evidence')::VARCHAR, '[A-Za-z]+\s*\d+\s*:\s*\d+')) c FROM qa)",
        r"nk AS (SELECT sample_id, p, upper(regexp_extract(c, '[A-Za-z]+')) || ltrim(regexp_extract(c, '(\d+)\s*:', 1), '0') || ':' || ltrim(regexp_extract(c, ':\s*(\d+)', 1), '0') n FROM ev)",
        r"dk AS (SELECT DISTINCT sample_id, dia, upper(regexp_extract(dia, '[A-Za-z]+')) || ltrim(regexp_extract(dia, '(\d+)\s*:', 1), '0') || ':' || ltrim(regexp_extract(dia, ':\s*(\d+)', 1), '0') n FROM tn)",
        "hs AS (SELECT question_id, answer_session_ids a, unnest(haystack_session_ids) s, generate_subscripts(haystack_session_ids, 1) - 1 p FROM longmemeval_s_cleaned)",
        "hx AS (SELECT question_id, unnest(haystack_sessions) ts, generate_subscripts(haystack_sessions, 1) - 1 p FROM longmemeval_s_cleaned)",
        "ht AS (SELECT question_id, p, unnest(ts) t, generate_subscripts(ts, 1) - 1 n FROM hx)",
    )
    + r"""SELECT 'turn' link_kind, sample_id rec_id, k parent_key, dia child_key FROM tn UNION SELECT 'evidence', nk.sample_id, p::VARCHAR, dia FROM nk JOIN dk ON dk.sample_id = nk.sample_id AND dk.n = nk.n
    UNION SELECT 'haystack_session', question_id, p::VARCHAR, s FROM hs WHERE s IS NOT NULL UNION SELECT 'answer_session', question_id, p::VARCHAR, s FROM hs WHERE list_contains(a, s) UNION SELECT 'haystack_turn', question_id, p::VARCHAR, n::VARCHAR FROM ht WHERE regexp_matches(t.content, '\S')""",
    "match_topic_exact": _with(_F, _T, _E, _R, _closure("SELECT g, topic root FROM roots"), "m AS (SELECT f.g, f.id, CASE WHEN min(cl.depth) = 0 THEN 0 ELSE 9 END step FROM f JOIN cl ON cl.g = f.g AND list_contains(f.topics, cl.code) GROUP BY f.g, f.id)", "t AS (SELECT *, min(step) OVER (PARTITION BY g) taken FROM m)")
    + "SELECT g, id, taken::BIGINT taken FROM t WHERE step = taken",
    "rendered_rows": _with(_F, _L, "x AS (SELECT g, id, s, min(i) i FROM (SELECT g, id, unnest(src) s, generate_subscripts(src, 1) i FROM f) GROUP BY ALL)", "y AS (SELECT x.g, x.id, left(l.text, 120) t, i, row_number() OVER (PARTITION BY x.g, x.id ORDER BY i) n FROM x JOIN l ON l.g = x.g AND l.id = x.s)", "z AS (SELECT g, id, string_agg(t, ' / ' ORDER BY i) q FROM y WHERE n <= 2 GROUP BY ALL)")
    + "SELECT f.g, f.id, CASE WHEN conf = 'high' THEN '[anchored] ' ELSE '' END || '[' || eff || ' ' || CASE WHEN length(eff) = 10 THEN coalesce(dayname(try_strptime(eff, '%Y-%m-%d')), '') ELSE '' END || '] (' || f.id || ', src=' || unit || ') ' || text || coalesce(' | verbatim: ' || q, '') AS \"row\" FROM f LEFT JOIN z USING (g, id)",
}
