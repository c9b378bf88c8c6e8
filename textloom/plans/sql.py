"""SQL with the meaning of the registered queries, for a database that is no Spark."""

from __future__ import annotations

import re

from textloom.operators.evaluate import MODIFIERS, OTHER_RELATIONS, TYPE_PAIRS
from textloom.operators.graph import TYPE_COLORS
from textloom.profile import Profile

W = r"[\t-\r \x{85}\p{Z}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(map(q, sorted(words))) + ")"


def any_of(words) -> str:
    return q("|".join(re.escape(w) for w in words))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def rule_line(x: str) -> str:
    return f"(length({x}) >= 12 AND len(list_distinct(string_split({x}, ''))) <= 3)"


def unify(x: str) -> str:
    return rf"replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '{CONTROL}', '', 'g'), chr(160), ' ')"


def clean(x: str) -> str:
    lines = f"list_transform(string_split({unify(f'coalesce({x}, {q(str())})')}, chr(10)), lambda l: {strip('l')})"
    kept = rf"list_filter({lines}, lambda l: l <> '' AND NOT regexp_full_match(l, '[0-9]{{1,4}}') AND NOT {rule_line('l')})"
    return rf"array_to_string(list_transform({kept}, lambda l: regexp_replace(l, '[ \t\f\v]+', ' ', 'g')), chr(10))"


def page(x: str) -> str:
    s = rf"regexp_replace({unify(f'coalesce({x}, {q(str())})')}, '[ \t\f\v]+', ' ', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({s}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '' AND NOT {rule_line('l')}), chr(10))"


def split(x: str, marks: str) -> str:
    broken = rf"regexp_replace({x}, '([{marks}])', '\1' || chr(10), 'g')"
    return f"list_filter(list_transform(string_split({broken}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def garbled_columns(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), '{W}', '', 'g')"
    n = lambda p, s=bare: f"len(regexp_extract_all({s}, '{p}'))"
    return (f"length({bare}) AS n, {n('[一-鿿]')} AS han, {n('[A-Za-z]+')} AS latin, {n('[一-龥a-zA-Z0-9]')} AS valid, {n('[^一-龥a-zA-Z0-9]')} AS symbol, "
            f"{n('[A-Za-z0-9]{8,}')} AS noisy, {n(CONTROL, f'coalesce({x}, {q(str())})')} AS control, {n('[�•■●▪▫★☆]', f'coalesce({x}, {q(str())})')} AS weird")


GARBLED = """CASE WHEN n < 10 THEN true WHEN control > 0 THEN true WHEN han::DOUBLE / n < 0.05 AND symbol::DOUBLE / n > 0.25 THEN true
 WHEN han::DOUBLE / n < 0.08 AND noisy >= 2 AND symbol::DOUBLE / n > 0.15 THEN true
 WHEN han::DOUBLE / n < 0.02 AND latin >= 3 AND symbol::DOUBLE / n > 0.35 AND NOT contains(coalesce(text, ''), ' ') THEN true
 ELSE valid::DOUBLE / n < 0.45 AND han::DOUBLE / n < 0.12 END"""
QUALITY = "CASE WHEN n = 0 THEN 0.0 ELSE (valid + 0.8::DOUBLE * han - 0.6::DOUBLE * symbol - (control + weird)) / n END"


def noise(c: str, p: Profile) -> str:
    word = f"regexp_full_match({c}, '[A-Za-z][A-Za-z0-9\\-]*')"
    plain = f"({word} AND (regexp_full_match({c}, '[a-z][a-z0-9\\-]*') OR length({c}) <= 3 OR regexp_matches({c}, '^[A-Z]')))"
    return (f"({c} IN {listed(p.stopwords)} OR lower({c}) IN {listed(p.latin_stopwords)} OR regexp_matches({c}, {any_of(p.noise_parts)}) OR {c} IN {listed(p.noise_terms)}"
            f" OR (starts_with({c}, '第') AND ends_with({c}, '章')) OR regexp_full_match({c}, '[图表式][0-9]+') OR (regexp_matches({c}, '^[图表]') AND length({c}) <= 4)"
            f" OR regexp_matches({c}, '[a-z]{{2,}}[A-Z][a-z]+') OR regexp_matches(lower({c}), {any_of(p.noise_latin_parts)})"
            f" OR (regexp_matches({c}, '[一-鿿]') AND regexp_matches({c}, '[A-Za-z]')) OR ({plain} AND lower({c}) NOT IN {listed(p.latin_whitelist | p.latin_keep)}))")


def valid(c: str, p: Profile) -> str:
    return f"(length({c}) BETWEEN 2 AND {p.max_token} AND regexp_full_match({c}, '[一-鿿A-Za-z][一-鿿A-Za-z0-9\\-]*') AND NOT {noise(c, p)})"


def normal(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '[A-Za-z][A-Za-z0-9\\-]*') THEN lower({c}) ELSE {c} END"


def first_rule(c: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {any_of(w)}) THEN {q(k)}" for k, w in rules) + f" ELSE {q(default)} END"


def color(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TYPE_COLORS.items()) + " ELSE '#374151' END"


def share(salt: str, cols: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {q(salt)}, {cols})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def oracles(p: Profile, hub: str, pmi_cap: int, top: int, allowed: tuple[str, ...]) -> dict[str, str]:
    sents = "s AS (SELECT doc_id, sentence_id, min(text) AS text FROM all_sentences WHERE text IS NOT NULL GROUP BY ALL)"
    ment = """m AS (SELECT min(doc_id) AS doc_id, min(sentence_id) AS sentence_id, min(text) AS text, min(entity) AS entity,
        coalesce(min(entity_type), 'Concept') AS entity_type, min(start_pos) AS start_pos, min(end_pos) AS end_pos, min(source) AS source
        FROM entities_clean WHERE entity IS NOT NULL GROUP BY mention_id)"""
    trm = "tr AS (SELECT term_id, min(term) AS term, coalesce(min(freq), 1) AS freq, min(score) AS score, min(entity_type) AS entity_type, min(alias) AS alias FROM terms_clean GROUP BY term_id)"
    dt = trm + ", dt AS (SELECT term, max(freq) AS freq, round(max(coalesce(score, 0.0)), 6) AS score, min(entity_type) AS entity_type FROM tr WHERE term IS NOT NULL AND trim(term) <> '' GROUP BY term)"
    tok = f"""tok AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[^一-鿿A-Za-z0-9]+'), lambda x: {valid('x', p)}), lambda x: {normal('x')}) AS tokens FROM documents)"""
    clean_docs = f"c AS (SELECT doc_id, {clean('text')} AS text FROM documents)"
    doc_sents = f"{clean_docs}, sl AS (SELECT doc_id, {split('text', p.sentence_marks)} AS l FROM c), ds AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS sentence_id FROM sl)"

    def grams(source: str) -> str:
        per = " UNION ALL ".join(
            f"SELECT unnest(list_transform(range(1, greatest(1, len(tokens) - {n - 2})), lambda i: array_to_string(tokens[i:i+{n - 1}], ''))) AS term FROM {source}" for n in range(1, p.max_ngram + 1))
        return f"""g AS ({per}), cand AS (SELECT term, count(*) AS freq FROM g WHERE length(term) BETWEEN 2 AND {p.max_term} GROUP BY term
            HAVING count(*) >= {p.min_freq}), cnd AS (SELECT term, freq FROM cand WHERE NOT {noise('term', p)} AND {valid('term', p)})"""

    token_grams = " UNION ALL ".join(f"SELECT {n} AS n, unnest(list_transform(range(1, greatest(1, len(tokens) - {n - 2})), lambda i: array_to_string(tokens[i:i+{n - 1}], ' '))) AS g FROM tok" for n in range(1, p.max_ngram + 1))
    tf = f"{tok}, n AS (SELECT count(*) AS n FROM documents), tk AS (SELECT doc_id, unnest(tokens) AS term FROM tok), tf AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term)"
    raw_tfidf = f"{tf}, w AS (SELECT term, sum(tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1)) AS tfidf FROM tf JOIN df USING (term), n GROUP BY term)"
    pmi = f"""top AS (SELECT term FROM cnd WHERE length(term) > 1 ORDER BY freq DESC, length(term) DESC, term LIMIT {pmi_cap}),
        low AS (SELECT lower(coalesce(text, '')) AS t FROM documents), csize AS (SELECT sum(length(coalesce(text, ''))) + count(*) - 1 AS c FROM documents),
        cut AS (SELECT term, unnest(range(1, length(term))) AS i FROM top), cuts AS (SELECT term, term[1:i] AS l, term[i+1:] AS r FROM cut),
        needle AS (SELECT term AS x FROM cuts UNION SELECT l FROM cuts UNION SELECT r FROM cuts),
        own AS (SELECT x, len(list_filter(range(1, length(x)), lambda i: x[1:length(x) - i] = x[i + 1:])) > 0 AS bordered FROM needle),
        sizes AS (SELECT DISTINCT length(x) AS k FROM own WHERE NOT bordered),
        win AS MATERIALIZED (SELECT substr(t, i, {p.max_term}) AS w, count(*) AS n FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM low) GROUP BY 1),
        cnt AS (SELECT x, coalesce(k, 0) AS k FROM needle LEFT JOIN (
            SELECT substr(w, 1, k) AS x, sum(n) AS k FROM win, sizes WHERE length(w) >= k AND substr(w, 1, k) IN (SELECT x FROM own WHERE NOT bordered) GROUP BY 1
            UNION ALL SELECT x, sum((length(t) - length(replace(t, x, ''))) // length(x)) FROM own, low WHERE bordered GROUP BY x) USING (x)),
        pm AS (SELECT cuts.term, min(log2(a.k * c::DOUBLE / (greatest(b.k, 1)::DOUBLE * greatest(d.k, 1)))) AS pmi FROM cuts JOIN cnt a ON a.x = cuts.term JOIN cnt b ON b.x = l JOIN cnt d ON d.x = r, csize WHERE a.k > 0 GROUP BY cuts.term)"""
    reason = (f"CASE WHEN term = '' THEN 'blank' WHEN term IN {listed(p.trigger_words)} THEN 'trigger' WHEN term IN {listed(p.final_noise)} THEN 'noise'"
              f" WHEN regexp_full_match(term, '[A-Za-z][A-Za-z0-9\\-]*') AND lower(term) NOT IN {listed(p.final_latin_keep)} THEN 'foreign' WHEN length(term) <= 1 THEN 'short'"
              f" WHEN regexp_full_match(term, '[0-9]+') THEN 'digits' WHEN regexp_matches(term, '^[图表式第][0-9]') THEN 'caption'"
              f" WHEN {' OR '.join(f'regexp_matches(term, {q(x)})' for x in p.pragmatic)} THEN 'pragmatic' END")
    fin = f"""{trm}, b AS (SELECT term_id, {strip("coalesce(term, '')")} AS term, {strip("coalesce(alias, '')")} AS alias, {strip("coalesce(entity_type, '')")} AS et FROM tr),
        f AS (SELECT *, CASE WHEN et = '' THEN 'Concept' ELSE et END AS kind, {reason} AS reason FROM b)"""
    fine = first_rule("term", p.fine_type_rules, p.default_type)
    review = """rv AS (SELECT term AS rt, CASE WHEN length(term) % 3 = 0 THEN 'Mechanism' ELSE 'Concept' END AS r_type, '又名' || term AS r_alias FROM dt WHERE length(term) % 2 = 0)"""
    trig = "CASE " + " ".join(f"WHEN contains(span, {q(t)}) THEN {q(r)}" for t, r in p.triggers) + " END"
    ok = "CASE relation " + " ".join(
        f"WHEN {q(r)} THEN " + (" AND ".join(f"{c} IN {listed(x)}" for c, x in (("head_type", h), ("tail_type", t)) if x is not None) or "true")
        for r, (h, t) in p.constraints.items()) + " ELSE true END"
    pairs = f"""pr AS (SELECT h.doc_id, h.sentence_id, h.text, h.entity AS head, h.entity_type AS head_type, h.start_pos AS h_start, h.end_pos AS h_end,
        t.entity AS tail, t.entity_type AS tail_type, t.start_pos AS t_start FROM m h JOIN m t ON h.doc_id = t.doc_id AND h.sentence_id = t.sentence_id
        AND row(h.start_pos, h.end_pos, h.entity) < row(t.start_pos, t.end_pos, t.entity) AND abs(t.start_pos - h.end_pos) <= {p.max_distance} AND length(h.text) >= {p.min_sentence})"""
    raw_of = f"""{pairs}, sp AS (SELECT *, CASE WHEN h_end <= t_start THEN substr(text, h_end + 1, t_start - h_end) ELSE substr(text, t_start + 1, h_end - t_start) END AS span FROM pr
        WHERE head <> tail AND head NOT IN {listed(t for t, _ in p.triggers)} AND tail NOT IN {listed(t for t, _ in p.triggers)}),
        rl AS (SELECT *, {trig} AS relation FROM sp),
        raw AS (SELECT doc_id, sentence_id, head, relation, tail, x.a AS head_type, x.b AS tail_type, x.e AS evidence FROM (
            SELECT doc_id, sentence_id, head, relation, tail, min({{'h': h_start, 't': t_start, 'z': h_end, 'a': head_type, 'b': tail_type, 'e': text}}) AS x FROM rl WHERE relation IS NOT NULL GROUP BY ALL))"""
    raw = f"{ment}, {raw_of}"
    rel_of = f"{raw_of}, r AS (SELECT * FROM raw WHERE {ok})"
    rel = f"{ment}, {rel_of}"
    eid = lambda c: f"regexp_replace({strip(c)}, '{W}+', '_', 'g')"
    nodes_of = lambda src: f"""SELECT id, x.name AS name, x.et AS entity_type, x.d AS source_doc FROM (SELECT {eid('entity')} AS id,
        min({{'d': doc_id, 's': sentence_id, 'a': start_pos, 'z': end_pos, 'name': entity, 'et': entity_type}}) AS x FROM {src} GROUP BY 1)"""  # noqa: E731
    kg_of = f"""{rel_of}, n AS ({nodes_of('m')}), e AS (SELECT {eid('head')} AS source, relation, {eid('tail')} AS target, doc_id, sentence_id, min(evidence) AS evidence FROM r GROUP BY 1, 2, 3, 4, 5),
        dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id)"""
    kg = f"{ment}, {kg_of}"
    dist = lambda t, c: f"SELECT coalesce({c}, '') AS {c}, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {t} GROUP BY 1"

    def reach(k: int, budget: int = 1 << 40) -> str:
        both = "bo AS (SELECT source AS id, target AS nx FROM e UNION SELECT target, source FROM e)"
        h1 = f"h1 AS (SELECT {q(hub)} AS id UNION SELECT nx FROM bo WHERE id = {q(hub)})"
        h2 = f"h2 AS (SELECT id FROM h1 UNION SELECT nx FROM bo WHERE id IN (SELECT id FROM h1) AND (SELECT count(*) FROM h1) <= {budget})"
        return f"""WITH {kg}, {both}, {h1}, {h2}, ie AS (SELECT * FROM e WHERE source IN (SELECT id FROM h{k}) AND target IN (SELECT id FROM h{k}))"""

    def hops(k: int, budget: int = 1 << 40) -> str:
        return f"""{reach(k, budget)},
            id2 AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ie UNION ALL SELECT target FROM ie) GROUP BY id)
            SELECT n.id, name, entity_type, coalesce(degree, 0) AS degree, round(CASE WHEN n.id = {q(hub)} THEN 28.0::DOUBLE ELSE greatest(10.0::DOUBLE, least(22.0::DOUBLE, 8 + sqrt(coalesce(degree, 0)) * 2)) END, 4) AS symbol_size,
            {color('entity_type')} AS color, CASE WHEN n.id = {q(hub)} THEN '#ffffff' ELSE 'transparent' END AS border_color, CASE WHEN n.id = {q(hub)} THEN 3 ELSE 0 END AS border_width, true AS labelled
            FROM n LEFT JOIN id2 ON n.id = id2.id WHERE n.id IN (SELECT id FROM h{k})"""

    best = "t AS (SELECT n.*, coalesce(degree, 0) AS degree FROM n LEFT JOIN dg USING (id)), o AS (SELECT * FROM t ORDER BY degree DESC, (entity_type <> 'Concept') DESC, id LIMIT 2000)"

    def scores(side_gold: str, side_pred: str, by: str = "") -> str:
        g = f"{by}, " if by else ""
        cols = f"{by} AS {by}, " if by else ""
        return f"""go AS (SELECT DISTINCT * FROM ({side_gold})), pd AS (SELECT DISTINCT * FROM ({side_pred})),
            al AS (SELECT *, 1 AS side FROM go UNION ALL SELECT *, 2 FROM pd), k AS (SELECT * EXCLUDE (side), sum(side) AS on_ FROM al GROUP BY ALL),
            cn AS (SELECT {cols}count(*) FILTER (on_ = 3) AS tp, count(*) FILTER (on_ = 2) AS fp, count(*) FILTER (on_ = 1) AS fn FROM k {('GROUP BY ' + by) if by else ''}),
            pq AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rc FROM cn)
            SELECT {g}round(p, 4) AS precision, round(rc, 4) AS recall, round(CASE WHEN p + rc = 0 THEN 0.0 ELSE 2 * p * rc / (p + rc) END, 4) AS f1, tp, fp, fn FROM pq"""

    rk = "doc_id, sentence_id::VARCHAR, head, relation, tail"
    ek = "doc_id, sentence_id::VARCHAR, entity, entity_type"
    pert_rel = lambda src: f"""SELECT doc_id, sentence_id, head, CASE WHEN {share('relabel', rk)} < 0.05 THEN '相关' ELSE relation END AS relation, tail FROM {src} WHERE {share('drop', rk)} >= 0.15"""
    pert_ent = f"""SELECT doc_id, sentence_id, entity, CASE WHEN {share('retype', ek)} < 0.05 THEN 'Concept' ELSE entity_type END AS entity_type FROM m WHERE {share('drop', ek)} >= 0.10"""
    gold = "gs AS (SELECT doc_id, sentence_id, n FROM (SELECT *, sum(n) OVER (ORDER BY n DESC, doc_id, sentence_id ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT doc_id, sentence_id, count(*) AS n FROM r GROUP BY ALL)) WHERE before < 400)"
    first_terms = f"{dt}, tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, freq DESC, term) AS place FROM dt)"
    rule_sql = " UNION ALL ".join(f"SELECT doc_id, sentence_id, unnest(regexp_extract_all(text, {q(pt)})) AS entity, {q(k)} AS entity_type FROM s" for pt, k in p.entity_patterns)
    ref = "rf AS (SELECT canonical AS term, max(entity_type) AS entity_type FROM term_reference GROUP BY 1)"
    occ = lambda terms: f"""oc AS (SELECT doc_id, sentence_id, term AS entity, unnest(list_filter(range(1, length(text) - length(term) + 2), lambda i: substr(text, i, length(term)) = term)) - 1 AS start_pos
        FROM s JOIN {terms} ON contains(text, term))"""  # noqa: E731
    halves = "hv AS (SELECT DISTINCT term FROM (SELECT canonical AS term FROM term_reference UNION SELECT substr(canonical, 1, 4) FROM term_reference UNION SELECT substr(canonical, 3, 4) FROM term_reference) WHERE term <> '')"
    # The i-th match of a pattern begins where its string next occurs after the match before.
    at = lambda pt, k, j: f"""SELECT doc_id, sentence_id, text, {j} AS pat, {q(k)} AS kind, list_reduce(list_concat([[{{'t': '', 'a': 0, 'z': 0}}]], list_transform(regexp_extract_all(text, {q(pt)}), lambda w: [{{'t': w, 'a': 0, 'z': 0}}])),
        lambda x, y: list_append(x, {{'t': y[1].t, 'a': x[-1].z + strpos(substr(text, x[-1].z + 1), y[1].t) - 1, 'z': x[-1].z + strpos(substr(text, x[-1].z + 1), y[1].t) - 1 + length(y[1].t)}}))[2:] AS l FROM s"""  # noqa: E731
    spots = f"sp0 AS ({' UNION ALL '.join(at(pt, k, j) for j, (pt, k) in enumerate(p.entity_patterns))}), sp1 AS (SELECT doc_id, sentence_id, pat, kind, unnest(l) AS u FROM sp0)"
    greedy = """ls AS (SELECT doc_id, sentence_id, list([{{'t': t, 'a': a, 'z': z, 'k': k}}] ORDER BY {order}) AS l FROM wanted GROUP BY ALL),
        gr AS (SELECT doc_id, sentence_id, list_reduce(l, lambda x, y: CASE WHEN len(list_filter(x, lambda v: v.a < y[1].z AND y[1].a < v.z)) = 0 THEN list_concat(x, y) ELSE x END) AS kept FROM ls),
        un AS (SELECT doc_id, sentence_id, unnest(kept) AS u FROM gr)"""
    num = lambda cols: f"('0x' || substr(md5(concat_ws('|', {cols})), 1, 15))::BIGINT"
    syn = f"""{sents}, nn AS (SELECT greatest(count(*), 1) AS nn FROM s), rf0 AS (SELECT canonical AS term, entity_type FROM term_reference),
        en AS (SELECT unnest(list_transform(['', {', '.join(q(m) for m in MODIFIERS if m)}], lambda m: m || term)) AS entity, entity_type FROM rf0),
        sl0 AS (SELECT {num('doc_id, sentence_id::VARCHAR')} % nn AS slot, min({{'d': doc_id, 's': sentence_id}}) AS x FROM s, nn GROUP BY 1),
        sy AS (SELECT x.d AS doc_id, x.s AS sentence_id, entity, entity_type FROM en, nn JOIN sl0 ON slot = {num('entity')} % nn)"""
    follow = f"sf AS (SELECT *, lead(entity) OVER w AS tail, lead(entity_type) OVER w AS t_type FROM sy WINDOW w AS (PARTITION BY doc_id ORDER BY {num('entity')}, entity))"
    named = "CASE " + " ".join(f"WHEN entity_type = {q(h)} AND t_type = {q(t)} THEN {q(r)}" for (h, t), r in TYPE_PAIRS.items()) + f" ELSE [{', '.join(map(q, OTHER_RELATIONS))}][{num('entity, tail')} % {len(OTHER_RELATIONS)} + 1] END"
    odd = "CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[一-鿿]', '%', 'g') ELSE text END"
    flag = lambda t: f"(SELECT *, {GARBLED} AS bad, {QUALITY} AS quality FROM (SELECT *, {garbled_columns('text')} FROM {t}))"
    fence = lambda c: strip(rf"regexp_replace(regexp_replace({strip(c)}, '^```[A-Za-z]*\s*', ''), '\s*```$', '')")
    cascade = f"""dc AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), od AS (SELECT doc_id, {odd} AS o, text FROM dc),
        cs AS (SELECT doc_id, 0 AS ord, {page('o')} AS text FROM od UNION ALL SELECT doc_id, 1, {page("replace(o, ' ', '')")} FROM od UNION ALL SELECT doc_id, 2, {page('text')} FROM od WHERE doc_id % 4 = 0),
        sc AS (SELECT * FROM {flag('cs')} WHERE text <> ''), qk AS (SELECT doc_id, arg_min(text, (-quality, ord)) AS text FROM sc WHERE ord < 2 GROUP BY 1), ev AS (SELECT doc_id, arg_min(text, (-quality, ord)) AS text FROM sc GROUP BY 1),
        q0 AS (SELECT doc_id, coalesce(qk.text, '') AS text, coalesce(ev.text, '') AS every FROM dc LEFT JOIN qk USING (doc_id) LEFT JOIN ev USING (doc_id)),
        q1 AS (SELECT doc_id, CASE WHEN bad THEN every ELSE text END AS text FROM {flag('q0')}),
        rp AS (SELECT doc_id, {page(fence("'```text' || chr(10) || text || chr(10) || '```'"))} AS reply FROM dc WHERE doc_id % 3 = 0),
        q2 AS (SELECT doc_id, CASE WHEN bad THEN coalesce(reply, '') ELSE text END AS text FROM {flag('q1')} LEFT JOIN rp USING (doc_id)),
        q3 AS (SELECT doc_id, CASE WHEN bad THEN '' ELSE text END AS text FROM {flag('q2')})"""
    number = r"regexp_full_match(entity, '[0-9]+\.?[0-9]*')"
    own_graph = f"""dict AS MATERIALIZED (WITH {raw_tfidf}, {grams('tok')}, {pmi},
            sr AS (SELECT cnd.term, freq, round(0.6::DOUBLE * freq + 0.3::DOUBLE * coalesce(tfidf, 0) + 0.1::DOUBLE * greatest(coalesce(pmi, 0), 0), 6) AS score, {first_rule('cnd.term', p.type_rules, p.default_type)} AS kind
                FROM cnd LEFT JOIN w ON w.term = cnd.term LEFT JOIN pm ON pm.term = cnd.term)
            SELECT term, CASE WHEN kind = 'Concept' THEN {fine} ELSE kind END AS entity_type FROM sr WHERE {reason} IS NULL ORDER BY score DESC, freq DESC, term LIMIT {p.max_terms}),
        {doc_sents}, s AS (SELECT doc_id, sentence_id, text FROM ds), {occ('dict')}, {spots},
        wanted AS (SELECT doc_id, sentence_id, entity AS t, start_pos AS a, start_pos + length(entity) AS z, dict.entity_type AS k, -1 AS pat FROM oc JOIN dict ON term = entity
            UNION ALL SELECT doc_id, sentence_id, u.t, u.a, u.z, kind, pat FROM sp1),
        {greedy.format(order="pat, CASE WHEN pat < 0 THEN -length(t) ELSE 0 END, CASE WHEN pat < 0 THEN t ELSE '' END, a")},
        mn AS (SELECT doc_id, sentence_id, u.t AS entity, u.k AS entity_type, u.a AS start_pos, u.z AS end_pos FROM un),
        m AS (SELECT mn.*, s.text FROM mn JOIN s USING (doc_id, sentence_id) WHERE entity NOT IN {listed(p.trigger_words)} AND length(entity) > 1 AND NOT {number} AND regexp_matches(entity, '[\\p{{L}}\\p{{N}}\\p{{M}}_]')
            QUALIFY row_number() OVER (PARTITION BY doc_id, sentence_id, entity ORDER BY start_pos, end_pos) = 1), {kg_of}"""
    req = f"""{ment}, {pairs}, so AS (SELECT DISTINCT doc_id, sentence_id FROM pr WHERE head <> tail),
        fe AS (SELECT doc_id, sentence_id, entity, min({{'a': start_pos, 't': entity_type, 'x': text}}) AS x FROM m GROUP BY ALL),
        rq AS (SELECT doc_id, sentence_id, list({{'at': x.a, 'name': entity, 'type': x.t}} ORDER BY x.a, entity, x.t) AS e FROM fe JOIN so USING (doc_id, sentence_id) GROUP BY ALL)"""

    return {
        "clean_text": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
        "page_text": f"SELECT doc_id, {page('text')} AS clean FROM documents",
        "split_sentences": f"WITH {doc_sents} SELECT doc_id, sentence_id, text FROM ds",
        "sentence_stats": f"WITH {doc_sents} SELECT doc_id, count(*) AS n, max(length(text)) AS longest FROM ds GROUP BY doc_id",
        "garbled_flag": f"SELECT doc_id, {GARBLED} AS garbled FROM (SELECT doc_id, text, {garbled_columns('text')} FROM documents)",
        "text_quality": f"SELECT doc_id, round({QUALITY}, 5) AS quality FROM (SELECT doc_id, {garbled_columns('text')} FROM documents)",
        "best_candidate": f"""WITH c AS (SELECT doc_id, text, 0 AS ord FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, {page('text')}, 1 FROM documents WHERE text IS NOT NULL),
            s AS (SELECT *, {QUALITY} AS quality FROM (SELECT *, {garbled_columns('text')} FROM c))
            SELECT doc_id AS page, length(text) AS length, round(quality, 5) AS quality FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, ord) = 1""",
        "doc_metadata": f"SELECT printf('DOC%03d', row_number() OVER (ORDER BY file_name)) AS doc_no, file_name, title, {first_rule(f'coalesce(title, {q(str())})', p.topic_rules, p.default_topic)} AS topic FROM doc_meta",
        "ascii_names": """SELECT doc_id, lower(doc_id) || '_' || coalesce(CASE WHEN regexp_matches(s, '[a-z]') THEN s END, 'file') || '.txt' AS ascii_file_name
            FROM (SELECT doc_id, lower(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g')) AS s FROM doc_meta)""",
        "page_ranges": """WITH p AS (SELECT DISTINCT doc_id, page_no FROM all_sentences WHERE page_no IS NOT NULL), i AS (SELECT *, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS isle FROM p),
            r AS (SELECT doc_id, min(page_no) AS a, max(page_no) AS z FROM i GROUP BY doc_id, isle)
            SELECT doc_id, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END, ', ' ORDER BY a) AS pages FROM r GROUP BY doc_id""",
        "token_freq": f"WITH {tok} SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM tok) GROUP BY token",
        "noise_filter_audit": f"WITH {dt} SELECT term, {noise('term', p)} AS noise, {valid('term', p)} AS valid, {normal('term')} AS normal FROM dt",
        "term_types": f"WITH {dt} SELECT term, {first_rule('term', p.type_rules, p.default_type)} AS coarse, {fine} AS fine FROM dt",
        "ngram_candidates": f"WITH {tok}, {grams('tok')} SELECT term, freq FROM cnd",
        "ngram_sentence_bounded": f"WITH {doc_sents}, tok AS (SELECT list_transform(list_filter(regexp_split_to_array(text, '[^一-鿿A-Za-z0-9]+'), lambda x: {valid('x', p)}), lambda x: {normal('x')}) AS tokens FROM ds), {grams('tok')} SELECT term, freq FROM cnd",
        "tfidf_raw": f"WITH {raw_tfidf} SELECT term, round(tfidf, 5) AS tfidf FROM w",
        "tfidf_l2": f"""WITH n AS (SELECT count(*) AS n FROM documents), tk AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[^一-鿿A-Za-z0-9]+'), lambda x: x <> '')) AS token FROM documents),
            tf AS (SELECT doc_id, token, count(*) AS tf FROM tk GROUP BY ALL), v AS (SELECT token, count(*) AS df, sum(tf) AS total FROM tf GROUP BY token ORDER BY total DESC, token LIMIT 8000),
            w AS (SELECT doc_id, token, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM tf JOIN v USING (token), n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id)
            SELECT {normal('token')} AS term, round(sum(w / l), 5) AS tfidf FROM w JOIN l USING (doc_id) WHERE {valid('token', p)} GROUP BY 1""",
        "pmi_char": f"WITH {tok}, {grams('tok')}, {pmi} SELECT term, round(pmi, 5) AS pmi FROM pm",
        "pmi_token": f"""WITH {tok}, g AS ({token_grams}), c AS (SELECT g, n, count(*) AS c FROM g GROUP BY g, n), t AS (SELECT sum(c)::DOUBLE AS t FROM c WHERE n = 1),
            s AS (SELECT g, c, string_split(g, ' ') AS p, unnest(range(1, n)) AS i FROM c WHERE n > 1 AND c >= {p.min_freq}),
            x AS (SELECT g, c, array_to_string(p[1:i], ' ') AS l, array_to_string(p[i+1:], ' ') AS r FROM s)
            SELECT x.g AS term, x.c AS freq, round(min(log2(x.c * t / (a.c::DOUBLE * b.c))), 5) AS pmi FROM x JOIN c a ON a.g = x.l JOIN c b ON b.g = x.r, t GROUP BY x.g, x.c""",
        "extract_terms": f"""WITH {raw_tfidf}, {grams('tok')}, {pmi} SELECT cnd.term, freq, round(coalesce(tfidf, 0), 3) AS tfidf, round(coalesce(pmi, 0), 3) AS pmi,
            round(round(0.6::DOUBLE * freq + 0.3::DOUBLE * coalesce(tfidf, 0) + 0.1::DOUBLE * greatest(coalesce(pmi, 0), 0), 6), 3) AS score, {first_rule('cnd.term', p.type_rules, p.default_type)} AS entity_type, 'Y' AS keep, '' AS alias
            FROM cnd LEFT JOIN w ON w.term = cnd.term LEFT JOIN pm ON pm.term = cnd.term""",
        "term_scores": f"""WITH {raw_tfidf}, {grams('tok')}, {pmi} SELECT cnd.term, freq, round(round(0.6::DOUBLE * freq + 0.3::DOUBLE * coalesce(tfidf, 0) + 0.1::DOUBLE * greatest(coalesce(pmi, 0), 0), 6), 3) AS score,
            {first_rule('cnd.term', p.type_rules, p.default_type)} AS entity_type FROM cnd LEFT JOIN w ON w.term = cnd.term LEFT JOIN pm ON pm.term = cnd.term""",
        "term_topk": f"WITH {dt} SELECT term, freq, score FROM dt ORDER BY score DESC, freq DESC, term LIMIT {top}",
        "reject_reasons": f"WITH {fin} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM f GROUP BY 1",
        "finalize_terms": f"WITH {fin} SELECT term_id, term, CASE WHEN kind = 'Concept' THEN {fine} ELSE kind END AS entity_type, alias FROM f WHERE reason IS NULL",
        "finalize_reviewed": f"""WITH {fin}, {dt[len(trm) + 2:]}, {review}, j AS (SELECT term_id, term, CASE WHEN r_type = 'Mechanism' THEN r_type ELSE kind END AS kind, CASE WHEN alias = '' THEN coalesce(r_alias, '') ELSE alias END AS alias
            FROM f JOIN (SELECT {strip('rt')} AS rt, r_type, r_alias FROM rv) ON rt = term WHERE reason IS NULL)
            SELECT term_id, term, CASE WHEN kind = 'Concept' THEN {fine} ELSE kind END AS entity_type, alias FROM j""",
        "llm_batches": f"WITH {first_terms} SELECT term, ((place - 1) // 80)::INT AS batch, place::INT AS place FROM tp WHERE place <= 240",
        "llm_merge": f"""WITH {first_terms}, t AS (SELECT *, length(term) AS l FROM tp WHERE place <= 240)
            SELECT term, freq, score, CASE WHEN l % 3 = 0 THEN upper(term) ELSE term END AS canonical,
            CASE WHEN l % 5 = 0 THEN entity_type WHEN l % 2 = 0 THEN 'Mechanism' ELSE 'Mission' END AS entity_type FROM t WHERE l % 4 <> 0""",
        "review_merge": f"""WITH {dt}, nw AS (SELECT *, row_number() OVER (ORDER BY score DESC, term) AS rn FROM dt WHERE length(term) % 3 <> 0)
            SELECT term, freq, 'Y' AS keep, entity_type, '' AS alias FROM dt WHERE length(term) % 3 = 0 UNION ALL
            SELECT term, freq, CASE WHEN rn <= 100 AND length(term) % 2 = 0 THEN 'Y' ELSE 'N' END, CASE WHEN rn <= 100 THEN 'Mission' ELSE entity_type END, CASE WHEN rn <= 100 THEN 'x' ELSE '' END FROM nw""",
        "ner_occurrences": f"WITH {sents}, {ref}, {occ('rf')} SELECT doc_id, sentence_id, entity, start_pos, start_pos + length(entity) AS end_pos FROM oc",
        "ner_greedy": f"""WITH {sents}, {halves}, {occ('hv')}, ls AS (SELECT doc_id, sentence_id, list([{{'t': entity, 'a': start_pos, 'z': start_pos + length(entity)}}] ORDER BY length(entity) DESC, entity, start_pos) AS l FROM oc GROUP BY ALL),
            gr AS (SELECT doc_id, sentence_id, list_reduce(l, lambda x, y: CASE WHEN len(list_filter(x, lambda v: v.a < y[1].z AND y[1].a < v.z)) = 0 THEN list_concat(x, y) ELSE x END) AS k FROM ls),
            un AS (SELECT doc_id, sentence_id, unnest(k) AS u FROM gr) SELECT doc_id, sentence_id, u.t AS entity, u.a AS start_pos, u.z AS end_pos FROM un""",
        "ner_with_rules": f"""WITH {sents}, {halves}, {occ('hv')}, {spots},
            wanted AS (SELECT doc_id, sentence_id, entity AS t, start_pos AS a, start_pos + length(entity) AS z, 'dictionary' AS k, -1 AS pat FROM oc UNION ALL SELECT doc_id, sentence_id, u.t, u.a, u.z, 'rule', pat FROM sp1),
            {greedy.format(order="pat, CASE WHEN pat < 0 THEN -length(t) ELSE 0 END, CASE WHEN pat < 0 THEN t ELSE '' END, a")} SELECT doc_id, sentence_id, u.t AS entity, u.a AS start_pos, u.z AS end_pos, u.k AS source FROM un""",
        "rule_positions": f"""WITH {sents}, {spots}, wanted AS (SELECT doc_id, sentence_id, u.t AS t, u.a AS a, u.z AS z, kind AS k, pat FROM sp1),
            {greedy.format(order="pat, a")} SELECT doc_id, sentence_id, u.t AS entity, u.k AS entity_type, u.a AS start_pos, u.z AS end_pos FROM un""",
        "last_types": f"WITH {trm} SELECT term, arg_max(entity_type, term_id) AS entity_type FROM tr WHERE term IS NOT NULL AND term <> '' GROUP BY term",
        "gold_entities": f"WITH {rel}, {gold} SELECT doc_id, sentence_id, entity, entity_type FROM m SEMI JOIN gs USING (doc_id, sentence_id)",
        "synthetic_gold": f"WITH {syn} SELECT * FROM sy",
        "synthetic_gold_relations": f"WITH {syn}, {follow} SELECT doc_id, sentence_id, entity AS head, {named} AS relation, tail FROM sf WHERE tail IS NOT NULL AND tail <> entity",
        "page_cascade": f"WITH {cascade} SELECT doc_id, md5(text) AS digest, length(text) AS length FROM q3",
        "recognition_replay": f"""WITH dc AS (SELECT doc_id, text AS whole, {odd} AS text FROM documents WHERE text IS NOT NULL), rp AS (SELECT doc_id, {fence("'```text' || chr(10) || whole || chr(10) || '```'")} AS reply FROM dc WHERE doc_id % 3 = 0)
            SELECT doc_id, md5(CASE WHEN bad AND coalesce(reply, '') <> '' THEN reply ELSE text END) AS digest FROM {flag('dc')} LEFT JOIN rp USING (doc_id)""",
        "glyph_repair": "SELECT DISTINCT canonical AS term, canonical || canonical AS text FROM term_reference",
        "latex_sections": r"""SELECT ref_id, 0 AS pos, '\section{' || canonical || '}' || chr(10) || 'body' || chr(10) AS chapter FROM term_reference UNION ALL SELECT ref_id, 1, '\section{' || name_en || '} end' FROM term_reference""",
        "jsonl_round_trip": "SELECT doc_id, title, file_name, topic FROM doc_meta",
        "csv_round_trip": "SELECT doc_id, coalesce(title, '') AS title, coalesce(file_name, '') AS file_name, coalesce(topic, '') AS topic FROM doc_meta",
        "graph_round_trip": f"WITH {kg} SELECT id, name FROM n UNION ALL SELECT source, target FROM e",
        "rule_entities": f"WITH {sents}, a AS ({rule_sql}) SELECT doc_id, sentence_id, entity, entity_type, count(*) AS n FROM a GROUP BY ALL",
        "entities_clean": f"""WITH {ment}, {ref} SELECT doc_id, sentence_id, entity, CASE WHEN rf.entity_type <> 'Concept' THEN rf.entity_type ELSE m.entity_type END AS entity_type, start_pos
            FROM m LEFT JOIN rf ON rf.term = entity WHERE entity NOT IN {listed(p.trigger_words)} AND length(entity) > 1 AND NOT regexp_full_match(entity, '[0-9]+\\.?[0-9]*')
            AND regexp_matches(entity, '[\\p{{L}}\\p{{N}}\\p{{M}}_]')
            QUALIFY row_number() OVER (PARTITION BY doc_id, sentence_id, entity ORDER BY start_pos, end_pos, source, CASE WHEN rf.entity_type <> 'Concept' THEN rf.entity_type ELSE m.entity_type END) = 1""",
        "entity_pairs": f"WITH {ment}, {pairs} SELECT doc_id, sentence_id, head, tail, h_start, t_start FROM pr",
        "relations_raw": f"WITH {raw} SELECT * FROM raw",
        "relations_clean": f"WITH {rel} SELECT * FROM r",
        "llm_relation_requests": f"WITH {req} SELECT doc_id || '_' || sentence_id AS id, array_to_string(list_transform(e, lambda x: x.name || ':' || x.type), '|') AS entities FROM rq",
        "llm_relation_validate": f"""WITH {req} SELECT doc_id, sentence_id, e[1].name AS head, e[1].type AS head_type, 'foo' AS relation, e[2].name AS tail, e[2].type AS tail_type FROM rq WHERE e[1].name <> e[2].name""",
        "kg_nodes": f"WITH {ment} {nodes_of('m')}",
        "kg_nodes_canonical": f"""WITH {ment}, al AS (SELECT alias, min(canonical) AS c FROM alias_final WHERE canonical IS NOT NULL AND alias IS NOT NULL GROUP BY alias),
            mc AS (SELECT doc_id, sentence_id, start_pos, end_pos, entity_type, coalesce(c, entity) AS entity FROM m LEFT JOIN al ON alias = entity) {nodes_of('mc')}""",
        "kg_edges": f"WITH {kg} SELECT * FROM e",
        "rdf_triples": f"""WITH {kg} SELECT id AS s, 'rdf:type' AS p, entity_type AS o, 'iri' AS kind FROM n UNION SELECT id, 'rdfs:label', name, 'literal' FROM n
            UNION SELECT source, relation, target, 'iri' FROM e UNION SELECT source, 'hasEvidence', evidence, 'literal' FROM e""",
        "turtle_lines": f"""WITH {kg}, l AS (SELECT 'ex:' || id || ' a ex:' || entity_type || ' ; rdfs:label "' || replace(name, '"', '''') || '" .' AS line FROM n
            UNION ALL SELECT 'ex:' || source || ' ex:' || relation || ' ex:' || target || ' .' FROM e) SELECT line, count(*) AS n FROM l GROUP BY line""",
        "upsert_merge": "SELECT id, name, entity_type, node_no FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY node_no % 2 DESC, node_no DESC) = 1",
        "matched_edges": f"WITH {kg}, i AS (SELECT id FROM n WHERE entity_type <> 'Concept') SELECT source, relation, target, doc_id, sentence_id FROM e WHERE source IN (SELECT id FROM i) AND target IN (SELECT id FROM i)",
        "graph_stats": f"WITH {kg} SELECT (SELECT count(*) FROM n) AS entities, (SELECT count(*) FROM e) AS relations, (SELECT count(DISTINCT source_doc) FROM n) AS documents",
        "graph_stats_types": f"WITH {kg} {dist('n', 'entity_type')}",
        "graph_stats_relations": f"WITH {kg} {dist('e', 'relation')}",
        "degree": f"WITH {kg} SELECT id, degree FROM dg",
        "search_entities": f"WITH {kg} SELECT id, name, entity_type FROM n WHERE contains(lower(name), 'model') ORDER BY length(name), id LIMIT 60",
        "entity_detail": f"""WITH {kg}, b AS (SELECT 'out' AS direction, * FROM e WHERE source = {q(hub)} UNION ALL SELECT 'in', * FROM e WHERE target = {q(hub)}),
            c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY direction ORDER BY relation, source, target, doc_id, sentence_id) <= 80)
            SELECT direction, source, coalesce(a.name, source) AS source_name, relation, target, coalesce(z.name, target) AS target_name, doc_id, sentence_id
            FROM c LEFT JOIN n a ON a.id = source LEFT JOIN n z ON z.id = target""",
        "subgraph_1hop": hops(1),
        "subgraph_2hop": hops(2),
        "subgraph_2hop_budget": f"SELECT id, degree FROM ({hops(2, 200)})",
        "subgraph_edges": f"{reach(2, 200)} SELECT source, target, relation, evidence, doc_id, sentence_id FROM ie",
        "overview_edges": f"WITH {kg}, {best} SELECT source, target, relation, doc_id, sentence_id FROM e WHERE source IN (SELECT id FROM o) AND target IN (SELECT id FROM o)",
        "search_menu": f"WITH {kg} SELECT id, name, entity_type FROM n WHERE contains(lower(name), '模型') ORDER BY length(name), id LIMIT 20",
        "legend_order": f"""WITH {kg}, k AS (SELECT coalesce(entity_type, 'Concept') AS entity_type, count(*) AS n FROM n GROUP BY 1)
            SELECT entity_type, n, row_number() OVER (ORDER BY n DESC, entity_type)::INT AS place, {color('entity_type')} AS color FROM k""",
        "graph_from_documents": f"""WITH {own_graph}, {best}, z AS (SELECT *, greatest(6.0::DOUBLE, least(26.0::DOUBLE, 6 + sqrt(degree) * 1.8::DOUBLE)) AS size FROM o)
            SELECT id, name, entity_type, degree, round(size, 4) AS symbol_size, size > 12 AS labelled, {color('entity_type')} AS color FROM z""",
        "overview_topn": f"""WITH {kg}, {best},
            z AS (SELECT *, greatest(6.0::DOUBLE, least(26.0::DOUBLE, 6 + sqrt(degree) * 1.8::DOUBLE)) AS size FROM o)
            SELECT id, name, entity_type, degree, round(size, 4) AS symbol_size, size > 12 AS labelled, {color('entity_type')} AS color FROM z""",
        "type_filter": f"WITH {kg}, i AS (SELECT id FROM n WHERE entity_type IN ('Structure', 'Mechanism', 'ControlMethod')) SELECT source, relation, target, doc_id, sentence_id FROM e WHERE source IN (SELECT id FROM i) AND target IN (SELECT id FROM i)",
        "gold_select": f"WITH {rel}, {gold} SELECT doc_id, sentence_id, n FROM gs",
        "gold_perturb": f"WITH {rel}, {gold}, ra AS (SELECT r.* FROM r SEMI JOIN gs USING (doc_id, sentence_id)) {pert_rel('ra')}",
        "eval_relations": f"WITH {rel}, {scores(pert_rel('r'), 'SELECT doc_id, sentence_id, head, relation, tail FROM r')}",
        "eval_entities": f"WITH {ment}, {scores(pert_ent, 'SELECT doc_id, sentence_id, entity, entity_type FROM m')}",
        "eval_by_type": f"WITH {ment}, {scores(pert_ent, 'SELECT doc_id, sentence_id, entity, entity_type FROM m', 'entity_type')}",
        "doccano_export": "SELECT DISTINCT doc_id, title, sentence_id, text FROM all_sentences",
    }
