"""SQL of the annotation queries, put together from named parts."""

from __future__ import annotations

from mentionloom.functions import text as tx

_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(translate({x}, '{tx.DASHES}', '{'-' * len(tx.DASHES)}')), '{_BLANK}', ' ', 'g'))"


def _tidy(x: str) -> str:
    bare = f"upper(regexp_replace(regexp_replace({x}, '(?s)!.*$', ''), '^{_BLANK}|{_BLANK}$', '', 'g'))"
    return f"nullif(regexp_replace({bare}, '^HP[_:]\\s*', 'HP:'), '')"


# the cues for an engine whose word boundary knows ASCII letters only
_EDGE = r"[^\p{L}\p{N}_]"
_BEFORE = tx.NEGATION_BEFORE.replace(r"(?:\bno\b", r"(?:@no").replace(r"|\b", "|@").replace(r"\b", "").replace("@", f"(?:^|{_EDGE})")
_AFTER = tx.NEGATION_AFTER.replace(r"\b", f"(?:{_EDGE}|$)")
_NEAR = tx.NEGATION_NEAR.replace(r"\b(?:no", f"(?:^|{_EDGE})(?:no").replace(r"\b", f"(?:{_EDGE}|$)")

_PARTS = {
    "docs": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id ORDER BY article_row DESC) AS rn FROM articles WHERE pmc_id IS NOT NULL) WHERE rn = 1",
    "psg": """SELECT pmc_id, i AS p_idx, full_text[i+1].section_type AS section, full_text[i+1]."offset" AS p_off, full_text[i+1]."offset" + length(full_text[i+1].text) AS p_end, full_text[i+1].text AS text
              FROM docs, unnest(range(len(full_text))) t(i) WHERE full_text[i+1].text IS NOT NULL AND full_text[i+1]."offset" IS NOT NULL""",
    "pat": "SELECT pmc_id, i AS patient_ord, patient[i+1].patient_id AS patient_id, patient[i+1].mention AS mention FROM docs, unnest(range(len(patient))) t(i) WHERE patient[i+1].patient_id IS NOT NULL",
    "anc": 'SELECT pmc_id, patient_ord, j AS m_ord, patient_id, mention[j+1]."offset" AS m_off, mention[j+1].length AS m_len, mention[j+1].text AS m_text FROM pat, unnest(range(len(mention))) t(j) WHERE mention[j+1]."offset" IS NOT NULL',
    "ent": 'SELECT pmc_id, i AS e_ord, entities[i+1].identifier AS identifier, entities[i+1].type AS type, entities[i+1]."offset" AS off, entities[i+1].length AS len, entities[i+1].text AS text, entities[i+1].note AS note FROM docs, unnest(range(len(entities))) t(i) WHERE entities[i+1] IS NOT NULL',
    "aso": "SELECT pmc_id, patient_id, j AS v_ord, ph[j+1] AS value FROM (SELECT pmc_id, association[i+1].patient_id AS patient_id, association[i+1].phenotype AS ph FROM docs, unnest(range(len(association))) t(i)), unnest(range(len(ph))) u(j) WHERE patient_id IS NOT NULL AND ph[j+1] IS NOT NULL",
    "ann": """SELECT DISTINCT entity_id AS e_ord, pmc_id, list_position(['ann1', 'ann2', 'ann3', 'dict'], annotator) - 1 AS source, annotator, identifier, type, "offset" AS off, length AS len, text, note FROM entities
              WHERE pmc_id IS NOT NULL AND identifier IS NOT NULL AND "offset" IS NOT NULL AND length IS NOT NULL AND annotator IN ('ann1', 'ann2', 'ann3', 'dict')""",
    "cnd": 'SELECT DISTINCT candidate_id AS c_ord, pmc_id, identifier, type, "offset" AS off, length AS len, text, note, score FROM cnn_candidates WHERE pmc_id IS NOT NULL',
    "loc": "SELECT e.*, p.p_idx, p.section, p.p_off, p.text AS p_text FROM ent e LEFT JOIN psg p ON p.pmc_id = e.pmc_id AND p.p_off <= e.off AND e.off < p.p_end QUALIFY row_number() OVER (PARTITION BY e.pmc_id, e.e_ord ORDER BY p.p_idx) = 1",
    "snt": r"""SELECT *, p_off + length(regexp_extract(left(p_text, off - p_off), '(?s)^.*[.!?;\n]')) AS s_start, off + len + length(regexp_extract(substring(p_text, off - p_off + len + 1), '(?s)^[^.!?;\n]*[.!?;\n]?')) AS s_end
               FROM loc WHERE p_idx IS NOT NULL AND note IS DISTINCT FROM 'NO'""",
    "aloc": "SELECT a.*, coalesce(p.p_idx, -1) AS a_idx FROM anc a LEFT JOIN psg p ON p.pmc_id = a.pmc_id AND p.p_off <= a.m_off AND a.m_off < p.p_end QUALIFY row_number() OVER (PARTITION BY a.pmc_id, a.patient_ord, a.m_ord ORDER BY p.p_idx) = 1",
    "strp": """SELECT DISTINCT pmc_id, e_ord, unnest(CASE WHEN len(sent) > 0 THEN sent WHEN len(psgp) > 0 THEN psgp ELSE list_distinct(list_filter([CASE WHEN off - prev.o <= @P@ THEN prev.p END, CASE WHEN nxt.o - off <= @N@ THEN nxt.p END], lambda x: x IS NOT NULL)) END) AS patient_id FROM (
                 SELECT s.pmc_id, s.e_ord, any_value(s.off) AS off, any_value(upper(coalesce(s.section, ''))) AS section,
                   coalesce(list(DISTINCT patient_id) FILTER (a_idx = p_idx AND s_start <= m_off AND m_off < s_end), []) AS sent, coalesce(list(DISTINCT patient_id) FILTER (a_idx = p_idx), []) AS psgp,
                   max({'o': m_off, 'q': patient_ord, 'm': m_ord, 'p': patient_id}) FILTER (m_off <= s.off) AS prev, min({'o': m_off, 'q': patient_ord, 'm': m_ord, 'p': patient_id}) FILTER (m_off > s.off) AS nxt
                 FROM snt s JOIN aloc a ON a.pmc_id = s.pmc_id GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY s.pmc_id, s.e_ord"),
    "ids": "SELECT *, count(*) OVER (PARTITION BY pmc_id) AS n FROM (SELECT DISTINCT pmc_id, patient_id FROM pat)",
    "prox": """SELECT pmc_id, e_ord, any_value(off) AS off, any_value(value) AS value, CASE WHEN min(d) FILTER (a_idx = p_idx) IS NOT NULL THEN CASE WHEN min(d) FILTER (a_idx = p_idx) <= 3500 THEN min({'d': d, 'p': patient_id}) FILTER (a_idx = p_idx).p END
                 ELSE CASE WHEN any_value(n) = 1 OR min(d) <= 1200 THEN min({'d': d, 'p': patient_id}).p END END AS patient_id
               FROM (SELECT s.pmc_id, s.e_ord, s.off, CASE WHEN s.identifier = '-1' THEN coalesce(s.text, '') ELSE s.identifier END AS value, s.p_idx, i.patient_id, i.n, a.a_idx, coalesce(abs(s.off - a.m_off), 1000000000000) AS d
                     FROM snt s JOIN ids i ON i.pmc_id = s.pmc_id LEFT JOIN aloc a ON a.pmc_id = i.pmc_id AND a.patient_id = i.patient_id) GROUP BY pmc_id, e_ord""".replace("min({'d': d, 'p': patient_id}) FILTER (a_idx = p_idx).p", "(min({'d': d, 'p': patient_id}) FILTER (a_idx = p_idx)).p").replace("min({'d': d, 'p': patient_id}).p END END", "(min({'d': d, 'p': patient_id})).p END END"),
    "near": "SELECT pmc_id, patient_id, row_number() OVER (PARTITION BY pmc_id, patient_id ORDER BY o, e) - 1 AS v_ord, value FROM (SELECT pmc_id, patient_id, value, (min({'o': off, 'e': e_ord})).o AS o, (min({'o': off, 'e': e_ord})).e AS e FROM prox WHERE patient_id IS NOT NULL GROUP BY pmc_id, patient_id, value)",
    "counts": f"""SELECT c.pmc_id, {_norm('c.text')} AS surface, count(h.pmc_id) AS tp, count(*) AS total FROM cnd c SEMI JOIN ent e ON e.pmc_id = c.pmc_id
                  LEFT JOIN (SELECT DISTINCT pmc_id, off, len, identifier FROM ent WHERE note IS DISTINCT FROM 'NO') h ON h.pmc_id = c.pmc_id AND h.off = c.off AND h.len = c.len AND h.identifier = c.identifier
                  WHERE c.text IS NOT NULL AND {_norm('c.text')} <> '' GROUP BY ALL""",
    "loo": "SELECT pmc_id, surface, tp / total AS precision, total FROM (SELECT pmc_id, surface, sum(tp) OVER (PARTITION BY surface) - tp AS tp, sum(total) OVER (PARTITION BY surface) - total AS total FROM counts) WHERE total >= 1",
    "adds": f"""SELECT *, row_number() OVER (PARTITION BY pmc_id ORDER BY off, len, identifier, c_ord) - 1 AS a_ord FROM (
                  SELECT c.* FROM cnd c SEMI JOIN docs d ON d.pmc_id = c.pmc_id LEFT JOIN loo l ON l.pmc_id = c.pmc_id AND l.surface = {_norm('c.text')}
                  WHERE c.score >= 0.5 AND NOT isnan(c.score) AND length(coalesce(c.text, '')) >= 6 AND c.identifier IS NOT NULL AND coalesce(l.precision >= 0.2, TRUE)
                    AND NOT EXISTS (SELECT 1 FROM ent b WHERE b.pmc_id = c.pmc_id AND b.off = c.off AND b.len = c.len AND b.identifier = c.identifier AND b.note IS NOT DISTINCT FROM c.note)
                    AND NOT EXISTS (SELECT 1 FROM ent b WHERE b.pmc_id = c.pmc_id AND greatest(b.off, c.off) < least(b.off + b.len, c.off + c.len))
                  QUALIFY row_number() OVER (PARTITION BY c.pmc_id, c.identifier ORDER BY c.score DESC, length(c.text) DESC, c.off, c.c_ord) <= 2)""",
    "fused": "SELECT pmc_id, e_ord, identifier, off, len, text, note FROM ent UNION ALL SELECT a.pmc_id, coalesce(n.n, 0) + a.a_ord, a.identifier, a.off, a.len, a.text, a.note FROM adds a LEFT JOIN (SELECT pmc_id, max(e_ord) + 1 AS n FROM ent GROUP BY 1) n ON n.pmc_id = a.pmc_id",
    "votes": "SELECT pmc_id, identifier, off, len, note, count(DISTINCT source) AS votes, (min({'s': source, 'e': e_ord, 't': type, 'x': text})).x AS text FROM (SELECT pmc_id, identifier, type, off, len, note, text, e_ord, 0 AS source FROM ent UNION ALL SELECT pmc_id, identifier, type, off, len, note, text, e_ord, source + 1 FROM ann) GROUP BY pmc_id, identifier, off, len, note",
    "annd": "SELECT DISTINCT pmc_id, identifier, off, len, note FROM ann",
    "voted": "SELECT * FROM votes WHERE votes >= 2",
    "trm": f"SELECT * EXCLUDE (rn, obsolete, replaced_by), coalesce(obsolete, FALSE) AS obsolete, {_tidy('replaced_by')} AS replaced_by FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY loaded_at DESC, name DESC NULLS LAST) AS rn FROM hpo_terms WHERE trim(identifier) <> '') WHERE rn = 1",
    "als": f"SELECT alias, identifier, max(preferred) AS preferred FROM (SELECT identifier, {_norm('name')} AS alias, 1 AS preferred FROM trm WHERE NOT obsolete UNION ALL SELECT identifier, {_norm('s')}, 0 FROM (SELECT identifier, unnest(synonyms) AS s FROM trm WHERE NOT obsolete)) WHERE alias <> '' GROUP BY ALL",
    "adm": f"SELECT * FROM als WHERE alias NOT IN ({', '.join(repr(a) for a in tx.GENERIC_ALIASES)}) AND length(alias) >= 4 AND length(regexp_replace(alias, '[^\\p{{L}}]', '', 'g')) >= 2",
    "prim": f"SELECT alt, max(identifier) AS main FROM (SELECT identifier, {_tidy('a')} AS alt FROM (SELECT identifier, unnest(alt_ids) AS a FROM trm)) WHERE alt IS NOT NULL GROUP BY alt",
    "freq": "SELECT coalesce(t.replaced_by, coalesce(p.main, u)) AS identifier, count(*) AS freq FROM (SELECT unnest(string_split(identifier, ';')) AS u FROM ent) LEFT JOIN prim p ON p.alt = u LEFT JOIN trm t ON t.identifier = coalesce(p.main, u) AND t.obsolete AND t.replaced_by IS NOT NULL WHERE starts_with(u, 'HP:') GROUP BY 1",
    "dict": "SELECT alias, (max({'f': coalesce(freq, 0), 'i': a.identifier})).i AS identifier FROM adm a LEFT JOIN freq f ON f.identifier = a.identifier GROUP BY alias",
    "runs": r"""SELECT pmc_id, p_idx, run, start, low FROM (SELECT pmc_id, p_idx, run, low, coalesce(sum(length(run)) OVER (PARTITION BY pmc_id, p_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
                FROM (SELECT pmc_id, p_idx, low, i, parts[i+1] AS run FROM (SELECT pmc_id, p_idx, lower(text) AS low, regexp_extract_all(lower(text), '(?s)[\p{L}\p{N}]+|.') AS parts FROM psg), unnest(range(len(parts))) t(i)))""",
    "srf": f"SELECT *, {_norm('text')} AS surface FROM ent WHERE text IS NOT NULL AND text <> ''",
    "lab": r"SELECT surface, count(*) FILTER (note IS DISTINCT FROM 'NO') AS positive, count(*) FILTER (note = 'NO') AS negative, count(*) FILTER (note IS DISTINCT FROM 'NO' AND length(trim(text)) >= 2 AND regexp_matches(trim(text), '[A-Z]') AND regexp_full_match(trim(text), '[A-Z0-9]+([/-][A-Z0-9]+)*')) AS uppercase_positive FROM (SELECT * FROM srf QUALIFY row_number() OVER (PARTITION BY pmc_id, off, len, surface ORDER BY e_ord) = 1) GROUP BY surface",
    "sst": "SELECT l.surface, positive, negative, uppercase_positive, coalesce(o.n, 0) AS occurrences, CASE WHEN o.n > 0 THEN least(1.0, (positive + negative) / o.n) ELSE 0.0 END AS precision FROM lab l LEFT JOIN (SELECT alias, count(*) AS n FROM socc GROUP BY alias) o ON o.alias = l.surface",
    "com": "SELECT surface, identifier, n FROM (SELECT surface, identifier, count(*) AS n, min({'p': pmc_id, 'e': e_ord}) AS seen FROM srf WHERE identifier IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY surface ORDER BY n DESC, seen) = 1",
}
_PARTS["idc"] = """SELECT surface, identifier, pmc_id, count(*) AS n, CAST(count(*) FILTER (rn = 1 AND note IS DISTINCT FROM 'NO') AS BIGINT) AS np, min(e_ord) AS seen
                   FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id, off, len, surface ORDER BY e_ord) AS rn FROM srf WHERE identifier IS NOT NULL) GROUP BY ALL"""
_HIT = r"""SELECT r.pmc_id, r.p_idx, r.start, a.alias FROM runs r JOIN (SELECT DISTINCT alias, regexp_extract(alias, '^(?:[\p{L}\p{N}]+|.)') AS run FROM @A@) a ON a.run = r.run AND substring(r.low, CAST(r.start AS BIGINT) + 1, length(a.alias)) = a.alias
           WHERE NOT (regexp_matches(a.alias, '[\p{L}\p{N}]$') AND regexp_matches(substring(r.low, CAST(r.start AS BIGINT) + length(a.alias) + 1, 1), '^[\p{L}\p{N}]'))"""
_PARTS["occ"] = _HIT.replace("@A@", "dict")
_PARTS["sur"] = "SELECT DISTINCT surface AS alias FROM srf"
_PARTS["socc"] = _HIT.replace("@A@", "sur")
_ORDER = list(_PARTS)
_ORDER.remove("sst"), _ORDER.remove("com")
_ORDER += ["sst", "com"]
_NEEDS = {
    "psg": "docs", "pat": "docs", "anc": "pat", "ent": "docs", "aso": "docs", "loc": "ent psg", "snt": "loc", "aloc": "anc psg", "strp": "snt aloc", "ids": "pat", "prox": "snt aloc ids", "near": "prox", "counts": "cnd ent", "loo": "counts",
    "adds": "docs loo ent", "fused": "adds", "votes": "ann ent", "annd": "ann", "voted": "votes", "als": "trm", "adm": "als", "prim": "trm", "freq": "ent prim trm", "dict": "adm freq", "runs": "psg", "occ": "runs dict", "srf": "ent", "sur": "srf", "socc": "runs sur", "lab": "srf", "idc": "srf", "sst": "lab socc", "com": "srf",
}



def _canon(x: str) -> str:
    """The single ids of a compound id made canonical."""
    return f"CASE WHEN {x} = '-1' THEN '-1' ELSE (SELECT string_agg(coalesce(t.replaced_by, coalesce(p.main, v.u)), ';' ORDER BY v.i) FROM (SELECT unnest(string_split({x}, ';')) AS u, unnest(range(len(string_split({x}, ';')))) AS i) v LEFT JOIN prim p ON p.alt = v.u LEFT JOIN trm t ON t.identifier = coalesce(p.main, v.u) AND t.obsolete AND t.replaced_by IS NOT NULL) END"


_LONG = "length(alias) >= 4 AND length(regexp_replace(alias, '[^\\p{L}]', '', 'g')) >= 2"
_POOL = {
    "ext": f"SELECT DISTINCT alias, coalesce(t.replaced_by, coalesce(p.main, u)) AS identifier FROM (SELECT {_norm('text')} AS alias, unnest(string_split(identifier, ';')) AS u FROM ann WHERE annotator = 'dict' AND text IS NOT NULL) LEFT JOIN prim p ON p.alt = u LEFT JOIN trm t ON t.identifier = coalesce(p.main, u) AND t.obsolete AND t.replaced_by IS NOT NULL WHERE alias <> ''",
    "exl": f"SELECT e.* FROM ext e SEMI JOIN (SELECT identifier FROM trm WHERE NOT obsolete) l ON l.identifier = e.identifier WHERE {_LONG}",
    "cand": "SELECT alias, identifier, preferred, 1 AS o, 0 AS x FROM adm UNION ALL SELECT alias, identifier, 0, 0, 1 FROM exl",
    "best": "SELECT alias, max(o) AS named, max(x) AS external, (max({'p': preferred, 'f': coalesce(freq, 0), 'i': b.identifier})).i AS best FROM cand b LEFT JOIN freq f ON f.identifier = b.identifier GROUP BY alias",
    "uni": "SELECT alias, max(identifier) AS only_ FROM als GROUP BY alias HAVING count(DISTINCT identifier) = 1",
    "pool": "SELECT coalesce(b.alias, u.alias) AS alias, named, external, best, only_ FROM best b FULL JOIN uni u ON u.alias = b.alias",
}
_LOW = "coalesce(occurrences > 0 AND positive + negative > 0 AND precision < 0.4, FALSE)"
_CHOICE = f"""SELECT alias, source, coalesce(only_, CASE WHEN positive + negative > 0 THEN CASE WHEN source = 'train-abbreviation' THEN {_canon('usual_positive')} ELSE {_canon('usual')} END END, best) AS identifier FROM (
    SELECT *, CASE WHEN uppercase_positive >= 1 AND length(alias) >= 2 AND regexp_matches(upper(alias), '[A-Z]') AND regexp_full_match(upper(alias), '[A-Z0-9]+([/-][A-Z0-9]+)*') THEN 'train-abbreviation'
                   WHEN positive + negative > 0 AND precision >= 0.4 AND regexp_matches(alias, '[0-9a-z]') THEN 'train' WHEN named = 1 AND NOT {_LOW} THEN 'ontology'
                   WHEN only_ IS NOT NULL AND {_LONG} AND positive >= 1 AND precision >= 0.1 THEN 'recovered' WHEN external = 1 AND NOT {_LOW} THEN 'external' END AS source FROM rows_)"""


def _with(needs: str, select: str, recursive: bool = False, **extra: str) -> str:
    wanted: set[str] = set()
    todo = needs.split()
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += _NEEDS.get(n, "").split()
    parts = [f"{n} AS ({_PARTS[n]})" for n in _ORDER if n in wanted] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {select}"


_E = 'CAST(e_ord AS BIGINT) AS e_ord, identifier, off AS "offset", len AS length, text, note'
_ORDERED = "row_number() OVER (PARTITION BY pmc_id ORDER BY off, len DESC, identifier, note NULLS FIRST) - 1 AS e_ord"
_VALUES = "SELECT pmc_id, patient_id, v_ord, value"
_PRF = "round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 9) AS recall"
_F1 = "CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 WHEN tp = 0 AND (tp + fp > 0 AND tp + fn > 0) THEN 0.0 ELSE 2 * p * r / (p + r) END"


def _prf(source: str, more: str = "") -> str:
    return f"SELECT tp, fp, fn{more}, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM {source})"


def _seen(rows: str, order: str) -> str:
    """Distinct values in order of first appearance; ``rows`` has pmc_id, patient_id, value and the struct columns ``order``."""
    packed = ", ".join(f"'{c}': {c}" for c in order.split())
    return f"SELECT pmc_id, patient_id, CAST(row_number() OVER (PARTITION BY pmc_id, patient_id ORDER BY o, value) - 1 AS BIGINT) AS v_ord, value FROM (SELECT pmc_id, patient_id, value, min({{{packed}}}) AS o FROM {rows} GROUP BY pmc_id, patient_id, value)"


_UNITS = "CASE WHEN identifier = '-1' THEN [coalesce(text, '')] ELSE string_split(identifier, ';') END"
_MENTION = """SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT CAST(count(*) FILTER (g AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT g AND NOT EXISTS (SELECT 1 FROM gb WHERE gb.pmc_id = b.pmc_id AND gb.off = b.off AND gb.len = b.len)) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT p) AS BIGINT) AS fn FROM (SELECT pmc_id, off, len, u, bool_or(g) AS g, bool_or(p) AS p FROM (SELECT *, TRUE AS g, FALSE AS p FROM gu UNION ALL SELECT *, FALSE, TRUE FROM pu) GROUP BY ALL) b
    UNION ALL SELECT CAST(count(*) FILTER (g AND p) AS BIGINT), CAST(count(*) FILTER (NOT g AND blank) AS BIGINT), CAST(count(*) FILTER (g AND NOT p) AS BIGINT) FROM (SELECT pmc_id, off, len, bool_or(g) AS g, bool_or(p) AS p, bool_or(blank) AS blank FROM (SELECT *, TRUE AS g, FALSE AS p, FALSE AS blank FROM gb UNION ALL SELECT pmc_id, off, len, FALSE, TRUE, identifier = '-1' FROM pp) GROUP BY ALL))"""
_MENTION_PARTS = {
    "pp": "SELECT v.* FROM annd v SEMI JOIN docs d ON d.pmc_id = v.pmc_id WHERE note IS DISTINCT FROM 'NO'",
    "gu": "SELECT DISTINCT pmc_id, off, len, unnest(string_split(identifier, ';')) AS u FROM ent WHERE note IS DISTINCT FROM 'NO' AND identifier <> '-1'",
    "gb": "SELECT DISTINCT pmc_id, off, len FROM ent WHERE note IS DISTINCT FROM 'NO' AND identifier = '-1'",
    "pu": "SELECT DISTINCT pmc_id, off, len, unnest(string_split(identifier, ';')) AS u FROM pp WHERE identifier <> '-1'",
}
_DOCUMENT = "SELECT CAST(count(*) FILTER (g AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT g) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT p) AS BIGINT) AS fn FROM (SELECT pmc_id, u, bool_or(g) AS g, bool_or(p) AS p FROM (SELECT pmc_id, u, TRUE AS g, FALSE AS p FROM gu UNION ALL SELECT pmc_id, u, FALSE, TRUE FROM pu) GROUP BY ALL)"
_PATIENT_PARTS = {
    "gp": "SELECT DISTINCT pmc_id, a.patient_id AS patient_id FROM (SELECT pmc_id, unnest(association) AS a FROM docs) WHERE a.patient_id IS NOT NULL",
    "pv": "SELECT pmc_id, patient_id, value, bool_or(g) AS g, bool_or(p) AS p FROM (SELECT pmc_id, patient_id, value, TRUE AS g, FALSE AS p FROM aso UNION ALL SELECT pmc_id, patient_id, value, FALSE, TRUE FROM near) GROUP BY ALL",
    "pc": "SELECT gp.pmc_id, gp.patient_id, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM gp LEFT JOIN pv ON pv.pmc_id = gp.pmc_id AND pv.patient_id = gp.patient_id GROUP BY ALL",
    "ps": "SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS pp1, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS rr1 FROM pc",
    "asc1": "SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(pp1) AS mp, avg(rr1) AS mr, avg(CASE WHEN pp1 + rr1 = 0 THEN 0.0 ELSE 2 * pp1 * rr1 / (pp1 + rr1) END) AS mf FROM ps",
}
_CLIP = "SELECT DISTINCT pmc_id, unnest(CASE WHEN identifier = '-1' THEN [coalesce(text, '')] ELSE list_append(string_split(identifier, ';'), identifier) END) AS value FROM voted WHERE note IS DISTINCT FROM 'NO'"


_MARKS = r"[^.!?;\n]"
_HAS = lambda text, alias: f"regexp_matches({text}, '(?i)(?:^|[^A-Za-z0-9])' || regexp_escape({alias}) || '(?:[^A-Za-z0-9]|$)')"
_GROUP_PARTS = {
    "np": "SELECT pmc_id, count(*) AS n, list(DISTINCT patient_id) AS everyone FROM pat GROUP BY pmc_id HAVING count(*) > 1",
    "st": rf"""SELECT s.pmc_id, e_ord, n, everyone, identifier, s.text, upper(coalesce(section, '')) AS section, substring(p_text, CAST(s_start - p_off AS BIGINT) + 1, CAST(s_end - s_start AS BIGINT)) AS sentence,
               right(left(p_text, CAST(s_start - p_off AS BIGINT)), length(regexp_extract(left(p_text, greatest(CAST(s_start - p_off - 1 AS BIGINT), 0)), '(?s){_MARKS}*$')) + CASE WHEN s_start > p_off THEN 1 ELSE 0 END) AS prior, off - s_start AS here_at, off + len - s_start AS until FROM snt s JOIN np ON np.pmc_id = s.pmc_id""",
    "sn": f"SELECT *, left(sentence, CAST(here_at AS BIGINT)) AS prefix, regexp_extract(left(substring(sentence, CAST(until AS BIGINT) + 1), 100), '(?i)\\ball\\s+but\\s+(?:individual|patient)?\\s*([A-Za-z0-9:.-]+)') AS but FROM st WHERE NOT regexp_matches(right(left(sentence, CAST(here_at AS BIGINT)), 80), '{_NEAR}')",
    "ali": f"SELECT pmc_id, alias, arg_min(patient_id, patient_ord) AS patient_id FROM (SELECT pmc_id, patient_ord, patient_id, lower(patient_id) AS alias FROM pat UNION ALL SELECT pmc_id, patient_ord, patient_id, lower(substring(patient_id, 2)) FROM pat WHERE starts_with(patient_id, 'O') AND length(patient_id) > 1 UNION ALL SELECT pmc_id, patient_ord, patient_id, a FROM (SELECT *, lower(trim(regexp_replace(coalesce(m_text, ''), '{_BLANK}', ' ', 'g'))) AS a FROM anc) WHERE length(a) >= 2 AND a NOT IN ('case', 'individual', 'man', 'patient', 'person', 'proband', 'subject', 'woman')) GROUP BY ALL",
    "nm": rf"""SELECT s.pmc_id, s.e_ord, any_value(n) AS n, any_value(everyone) AS everyone, any_value(s.identifier) AS identifier, any_value(s.text) AS text, any_value(section) AS section, any_value(sentence) AS sentence,
               coalesce(list(DISTINCT a.patient_id) FILTER ({_HAS('sentence', 'alias')}), []) AS here, coalesce(list(DISTINCT a.patient_id) FILTER ({_HAS('prior', 'alias')}), []) AS bef, coalesce(list(DISTINCT a.patient_id) FILTER ({_HAS('but', 'alias')}), []) AS gone,
               arg_min(a.patient_id, alias) FILTER (regexp_matches(prefix, '(?i)(?:^|[^A-Za-z0-9])' || regexp_escape(alias) || '(?:[^A-Za-z0-9.!?;][^.!?;]{{0,34}})??\b(?:additionally|only|alone)\b')) AS one FROM sn s JOIN ali a ON a.pmc_id = s.pmc_id GROUP BY s.pmc_id, s.e_ord""",
    "gr": r"""SELECT *, CASE WHEN len(here) >= 2 AND regexp_matches(sentence, '(?i)\b(?:all|both|patients?|individuals?|siblings?|sibs?)\b') THEN here
               WHEN n = 2 AND (regexp_matches(sentence, '(?i)\b(?:both\s+(?:of\s+)?(?:our\s+)?patients|one\s+patient\b[^.!?;]{0,100}\bthe\s+other|both\s+associated\s+with\b|one\s+patient\b[^.!?;]{0,100}\b(?:suspected|confirmed)\s+in\s+the\s+other)\b') OR section = 'ABSTRACT' AND regexp_matches(sentence, '(?i)\bboth\b') AND regexp_matches(sentence, '(?i)\b(?:presented|characterized|features?)\b')) THEN everyone
               WHEN regexp_matches(sentence, '(?i)^\s*(?:all|both|they|their)\b') AND len(bef) >= 2 THEN bef END AS grp FROM nm""",
    "stated": f"SELECT DISTINCT pmc_id, patient_id, unnest({_UNITS}) AS value FROM (SELECT *, unnest(list_filter(CASE WHEN one IS NOT NULL THEN [one] ELSE grp END, lambda x: NOT list_contains(gone, x))) AS patient_id FROM gr WHERE grp IS NOT NULL)",
    "vo": f"SELECT pmc_id, value, row_number() OVER (PARTITION BY pmc_id ORDER BY o) AS o FROM (SELECT pmc_id, value, min({{'e': e_ord, 'u': u}}) AS o FROM (SELECT pmc_id, e_ord, vals[i+1] AS value, i AS u FROM (SELECT pmc_id, e_ord, {_UNITS} AS vals FROM ent WHERE note IS DISTINCT FROM 'NO'), unnest(range(len(vals))) t(i)) GROUP BY ALL)",
}
_STABLE_PARTS = {
    "allowed": f"SELECT pmc_id, list(DISTINCT value) AS vals FROM (SELECT pmc_id, unnest({_UNITS}) AS value FROM fused WHERE note IS DISTINCT FROM 'NO') GROUP BY pmc_id",
    "alc": "SELECT a.pmc_id, a.a_ord AS e_ord, a.identifier, a.off, a.len, a.text, a.note, p.p_idx, p.section, p.p_off, p.text AS p_text FROM adds a LEFT JOIN psg p ON p.pmc_id = a.pmc_id AND p.p_off <= a.off AND a.off < p.p_end QUALIFY row_number() OVER (PARTITION BY a.pmc_id, a.a_ord ORDER BY p.p_idx) = 1",
    "elig": rf"""SELECT * FROM alc a WHERE p_idx IS NOT NULL AND upper(coalesce(section, '')) IN ('CASE', 'METHODS', 'RESULTS') AND NOT EXISTS (SELECT 1 FROM adds o WHERE o.pmc_id = a.pmc_id AND o.off <= a.off AND a.off + a.len <= o.off + o.len AND o.len > a.len)
                AND NOT regexp_matches(right(regexp_extract(left(p_text, off - p_off), '(?s){_MARKS}*$'), 80), '{_NEAR}')""",
    "fresh": f"SELECT pmc_id, list(DISTINCT value) AS vals FROM (SELECT pmc_id, unnest({_UNITS}) AS value FROM elig WHERE note IS DISTINCT FROM 'NO') f WHERE NOT EXISTS (SELECT 1 FROM aso a WHERE a.pmc_id = f.pmc_id AND a.value = f.value) GROUP BY pmc_id",
    "idn": "SELECT *, count(*) OVER (PARTITION BY pmc_id) AS n FROM (SELECT DISTINCT pmc_id, patient_id FROM pat)",
    "nanc": "SELECT a.*, coalesce(p.p_idx, -1) AS a_idx FROM (SELECT pmc_id, patient_ord, j AS m_ord, patient_id, mention[j+1].\"offset\" AS m_off FROM pat, unnest(range(len(mention))) t(j) WHERE mention[j+1].\"offset\" IS NOT NULL) a LEFT JOIN psg p ON p.pmc_id = a.pmc_id AND p.p_off <= a.m_off AND a.m_off < p.p_end QUALIFY row_number() OVER (PARTITION BY a.pmc_id, a.patient_ord, a.m_ord ORDER BY p.p_idx) = 1",
    "nprox": _PARTS["prox"].replace("FROM snt s", "FROM (SELECT * FROM alc WHERE p_idx IS NOT NULL AND note IS DISTINCT FROM 'NO') s").replace("JOIN ids i", "JOIN idn i").replace("aloc a", "nanc a"),
    "nnear": _PARTS["near"].replace("FROM prox", "FROM nprox"),
    "both2": "SELECT a.pmc_id, patient_id, value, 0 AS source, v_ord, vals FROM aso a JOIN allowed w ON w.pmc_id = a.pmc_id UNION ALL SELECT a.pmc_id, patient_id, value, 1, v_ord, vals FROM nnear a JOIN fresh w ON w.pmc_id = a.pmc_id",
    "stab": "SELECT b.* FROM both2 b SEMI JOIN idn i ON i.pmc_id = b.pmc_id AND i.patient_id = b.patient_id WHERE list_contains(vals, value) OR (len(list_filter(string_split(value, ';'), lambda u: u <> '')) > 0 AND len(list_filter(string_split(value, ';'), lambda u: u <> '' AND NOT list_contains(vals, u))) = 0)",
}
_ACR = "[A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)*"
_ABBREVIATION_PARTS = {
    "cand": rf"""SELECT pmc_id, identifier, text, unnest([regexp_extract(substring(p_text, off - p_off + len + 1, 24), '^\s*\(\s*({_ACR})\s*\)', 1), CASE WHEN regexp_matches(substring(p_text, off - p_off + len + 1, 4), '^\s*\)') THEN regexp_extract(right(left(p_text, off - p_off), 24), '({_ACR})\s*\(\s*$', 1) ELSE '' END]) AS acronym
                 FROM loc WHERE p_idx IS NOT NULL AND note IS DISTINCT FROM 'NO' AND identifier <> '-1' AND text IS NOT NULL AND off - p_off + len <= length(p_text)""",
    "def": f"""SELECT pmc_id, acronym, min(identifier) AS identifier FROM cand WHERE length(regexp_replace(acronym, '[^A-Z0-9]', '', 'g')) >= 2 AND regexp_replace(acronym, '[^A-Z0-9]', '', 'g') = upper(array_to_string(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]+|[0-9]+'), lambda w: lower(w) NOT IN ({', '.join(repr(w) for w in tx.INITIAL_STOP_WORDS)})), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN w ELSE left(w, 1) END), ''))
               GROUP BY pmc_id, acronym HAVING count(DISTINCT identifier) = 1""",
    "tok": r"SELECT pmc_id, p_idx, run, coalesce(sum(length(run)) OVER (PARTITION BY pmc_id, p_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT pmc_id, p_idx, i, parts[i+1] AS run FROM (SELECT pmc_id, p_idx, regexp_extract_all(text, '(?s)[A-Za-z0-9]+(?:[-/][A-Z0-9]+)*|.') AS parts FROM psg), unnest(range(len(parts))) t(i))",
    "acr": f"SELECT * FROM tok WHERE regexp_full_match(run, '{_ACR}')",
}
_ABBREVIATIONS = f"""SELECT pmc_id, {_E} FROM (SELECT *, {_ORDERED} FROM (SELECT DISTINCT r.pmc_id, d.identifier, CAST(p.p_off + r.start AS INTEGER) AS off, CAST(length(r.run) AS INTEGER) AS len, r.run AS text, CAST(NULL AS VARCHAR) AS note
            FROM acr r JOIN def d ON d.pmc_id = r.pmc_id AND d.acronym = r.run JOIN psg p ON p.pmc_id = r.pmc_id AND p.p_idx = r.p_idx) c WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.pmc_id = c.pmc_id AND e.off = c.off AND e.len = c.len AND e.identifier = c.identifier))"""
_INITIALS = f"upper(array_to_string(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]+|[0-9]+'), lambda w: lower(w) NOT IN ({', '.join(repr(w) for w in tx.INITIAL_STOP_WORDS)})), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN w ELSE left(w, 1) END), ''))"
_WRITTEN_ENT = f"SELECT pmc_id, e_ord, identifier, type, CAST(e_ord * 1000 AS INTEGER) AS off, length(text) AS len, text, note, {_INITIALS} AS ini FROM src WHERE note IS DISTINCT FROM 'NO' AND text IS NOT NULL AND length(text) < 400 AND regexp_full_match({_INITIALS}, '[A-Z][A-Z0-9]+')"
_WRITTEN_PSG = "SELECT pmc_id, e_ord AS p_idx, 'CASE' AS section, off AS p_off, off + length(text || ' (' || ini || ') was seen; later ' || ini || ' grew.') AS p_end, text || ' (' || ini || ') was seen; later ' || ini || ' grew.' AS text FROM ent"
_VALIDATE_PARTS = {
    "prd": "SELECT *, row_number() OVER (PARTITION BY pmc_id ORDER BY article_row) AS n FROM articles WHERE pmc_id IS NOT NULL",
    "fnd": "SELECT p.*, d.pmid AS xpmid, coalesce(list_transform(d.patient, lambda x: x.patient_id), []) AS xpat FROM prd p JOIN docs d ON d.pmc_id = p.pmc_id",
    "ve": "SELECT pmc_id, article_row, i AS e_ord, entities[i+1] AS e FROM fnd, unnest(range(len(entities))) t(i)",
    "vw": "SELECT *, list_filter([CASE WHEN e.identifier IS NULL THEN 'identifier' END, CASE WHEN e.length IS NULL THEN 'length' END, CASE WHEN e.\"offset\" IS NULL THEN 'offset' END, CASE WHEN e.text IS NULL THEN 'text' END, CASE WHEN e.type IS NULL THEN 'type' END], lambda x: x IS NOT NULL) AS absent, article_row || '/' || e_ord AS named FROM ve",
    "vc": "SELECT *, e.\"offset\" AS off FROM vw WHERE len(absent) = 0",
    "vp": "SELECT c.*, p.p_idx, p.p_off, p.text AS p_text FROM vc c LEFT JOIN psg p ON p.pmc_id = c.pmc_id AND p.p_off <= c.off AND c.off < p.p_end QUALIFY row_number() OVER (PARTITION BY c.article_row, c.e_ord ORDER BY p.p_idx) = 1",
}
_VALIDATE = """SELECT code, pmc_id, detail FROM (
    SELECT 'duplicate_document' AS code, pmc_id, CAST(article_row AS VARCHAR) AS detail FROM prd WHERE n > 1
    UNION ALL SELECT 'unexpected_document', pmc_id, CAST(article_row AS VARCHAR) FROM prd p WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.pmc_id = p.pmc_id)
    UNION ALL SELECT 'missing_document', pmc_id, '' FROM docs d WHERE NOT EXISTS (SELECT 1 FROM prd p WHERE p.pmc_id = d.pmc_id)
    UNION ALL SELECT 'pmid_differs', pmc_id, CAST(article_row AS VARCHAR) FROM fnd WHERE pmid IS DISTINCT FROM xpmid
    UNION ALL SELECT 'entities_not_a_list', pmc_id, CAST(article_row AS VARCHAR) FROM fnd WHERE entities IS NULL
    UNION ALL SELECT 'association_not_a_list', pmc_id, CAST(article_row AS VARCHAR) FROM fnd WHERE association IS NULL
    UNION ALL SELECT 'missing_fields', pmc_id, named || ' ' || array_to_string(absent, ',') FROM vw WHERE len(absent) > 0
    UNION ALL SELECT 'bad_type', pmc_id, named FROM vc WHERE e.type <> 'Phenotype'
    UNION ALL SELECT 'outside_passages', pmc_id, named FROM vp WHERE p_idx IS NULL
    UNION ALL SELECT 'text_mismatch', pmc_id, named FROM vp WHERE p_idx IS NOT NULL AND substring(p_text, off - p_off + 1, greatest(e.length, 0)) <> e.text
    UNION ALL SELECT 'duplicate_entity', pmc_id, named FROM (SELECT *, row_number() OVER (PARTITION BY article_row, off, e.length, e.identifier, e.note ORDER BY e_ord) AS r FROM vc) WHERE r > 1
    UNION ALL SELECT 'patients_differ', pmc_id, CAST(article_row AS VARCHAR) FROM fnd WHERE association IS NOT NULL AND list_transform(association, lambda x: x.patient_id) <> xpat
    UNION ALL SELECT 'phenotype_not_a_list', pmc_id, article_row || '/' || i FROM (SELECT pmc_id, article_row, i, association[i+1].phenotype AS ph FROM fnd, unnest(range(len(association))) t(i)) WHERE ph IS NULL OR list_has_any(list_transform(ph, lambda x: x IS NULL), [TRUE])
    UNION ALL SELECT 'count_mismatch', '', a || '/' || b FROM (SELECT (SELECT count(*) FROM prd) AS a, (SELECT count(*) FROM docs) AS b) WHERE a <> b)"""


def oracle_sql() -> dict[str, str]:
    strp = lambda p, n: _PARTS["strp"].replace("@P@", p).replace("@N@", n)
    wide = strp("CASE WHEN section = 'CASE' THEN 6000 ELSE 3000 END", "CASE WHEN section = 'CASE' THEN 600 ELSE 300 END")
    doc_cols = "pmc_id, CAST(e_ord AS BIGINT) AS e_ord"
    return {
        "passages": _with("psg", "SELECT pmc_id, CAST(p_idx AS BIGINT) AS p_idx, section, CAST(p_off AS BIGINT) AS p_off, CAST(p_end AS BIGINT) AS p_end FROM psg"),
        "patient_mentions": _with("anc", "SELECT pmc_id, CAST(patient_ord AS BIGINT) AS patient_ord, CAST(m_ord AS BIGINT) AS m_ord, patient_id, CAST(m_off AS BIGINT) AS m_off, CAST(m_len AS BIGINT) AS m_len, m_text FROM anc"),
        "offset_to_passage": _with("loc", f"SELECT {doc_cols}, CAST(coalesce(p_idx, -1) AS BIGINT) AS p_idx FROM loc"),
        "merge_entities": _with("ent ann", f"SELECT pmc_id, {_E} FROM (SELECT pmc_id, identifier, off, len, text, note, {_ORDERED} FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id, off, len, identifier, note ORDER BY c DESC, e_ord DESC) AS rn FROM (SELECT 0 AS c, pmc_id, e_ord, identifier, off, len, text, note FROM ent UNION ALL SELECT 1 + source, pmc_id, e_ord, identifier, off, len, text, note FROM ann)) WHERE rn = 1)"),
        "subtract_entities": _with("ent ann", f"SELECT pmc_id, {_E} FROM (SELECT pmc_id, identifier, off, len, text, note, {_ORDERED} FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id, off, len, identifier, note ORDER BY e_ord DESC) AS rn FROM ann c WHERE NOT EXISTS (SELECT 1 FROM ent b WHERE b.pmc_id = c.pmc_id AND b.off = c.off AND b.len = c.len AND b.identifier = c.identifier AND b.note IS NOT DISTINCT FROM c.note)) WHERE rn = 1)"),
        "select_entities": _with("voted", f"SELECT pmc_id, {_E} FROM (SELECT *, {_ORDERED} FROM voted WHERE length(coalesce(text, '')) <= 40)"),
        "vote_entities": _with("ent votes", f"SELECT pmc_id, {_E} FROM (SELECT pmc_id, identifier, off, len, text, note, {_ORDERED} FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id, off, len, identifier, note ORDER BY c DESC, e_ord DESC) AS rn FROM (SELECT 0 AS c, pmc_id, e_ord, identifier, off, len, text, note FROM ent UNION ALL SELECT 1, pmc_id, 0, identifier, off, len, text, note FROM votes WHERE votes >= 2)) WHERE rn = 1)"),
        "nested_entities": _with("fused", f'SELECT {doc_cols}, off AS "offset", len AS length FROM fused a WHERE EXISTS (SELECT 1 FROM fused o WHERE o.pmc_id = a.pmc_id AND o.off <= a.off AND a.off + a.len <= o.off + o.len AND o.len > a.len)'),
        "overlap_free_candidates": _with("cnd ent", 'SELECT pmc_id, c_ord, off AS "offset", len AS length FROM cnd c WHERE NOT EXISTS (SELECT 1 FROM ent b WHERE b.pmc_id = c.pmc_id AND greatest(b.off, c.off) < least(b.off + b.len, c.off + c.len))'),
        "surface_precision": _with("counts", "SELECT surface, round(sum(tp) / sum(total), 9) AS precision, CAST(sum(total) AS BIGINT) AS total FROM counts GROUP BY surface HAVING sum(total) >= 3"),
        "surface_precision_loo": _with("loo", "SELECT pmc_id, surface, round(precision, 9) AS precision, CAST(total AS BIGINT) AS total FROM loo"),
        "cnn_additions": _with("adds", 'SELECT pmc_id, CAST(a_ord AS BIGINT) AS a_ord, c_ord, identifier, off AS "offset", len AS length, text, note FROM adds'),
        "cnn_fuse": _with("fused", f"SELECT pmc_id, {_E} FROM fused"),
        "judge_gate": _with("fused psg ann", f"""SELECT pmc_id, {_E} FROM (SELECT f.*, (SELECT min({{'i': p.p_idx, 's': p.section}}).s FROM psg p WHERE p.pmc_id = f.pmc_id AND p.p_off <= f.off AND f.off < p.p_end) AS section FROM fused f) f
            WHERE NOT (upper(coalesce(section, '')) IN ('CASE', 'RESULTS') AND length(coalesce(text, '')) >= 20 AND EXISTS (SELECT 1 FROM adds a WHERE a.pmc_id = f.pmc_id AND a.off = f.off AND a.len = f.len AND a.identifier = f.identifier AND a.note IS NOT DISTINCT FROM f.note))
              OR EXISTS (SELECT 1 FROM ann a WHERE a.pmc_id = f.pmc_id AND a.off = f.off AND a.len = f.len AND a.identifier = f.identifier AND a.note IS NOT DISTINCT FROM f.note)""".replace("min({'i': p.p_idx, 's': p.section}).s", "(min({'i': p.p_idx, 's': p.section})).s")),
        "sentence_bounds": _with("snt", f"SELECT {doc_cols}, CAST(s_start AS BIGINT) AS s_start, CAST(s_end AS BIGINT) AS s_end FROM snt"),
        "negation_flags": _with("loc", rf"""SELECT {doc_cols}, regexp_matches(regexp_extract(left(p_text, off - p_off), '(?s)[^.!?;\n]*$'), '{_BEFORE}') AS "before",
            regexp_matches(regexp_extract(substring(p_text, off - p_off + len + 1), '(?s)^[^.!?;\n]*[.!?;\n]?'), '{_AFTER}') AS "after",
            regexp_matches(right(regexp_extract(left(p_text, off - p_off), '(?s)[^.!?;\n]*$'), 80), '{_NEAR}') AS near FROM loc WHERE p_idx IS NOT NULL"""),
        "proximity_association": _with("near", "SELECT pmc_id, patient_id, CAST(v_ord AS BIGINT) AS v_ord, value FROM near"),
        "structural_patients": _with("snt aloc", "SELECT pmc_id, CAST(e_ord AS BIGINT) AS e_ord, patient_id FROM w", w=wide),
        "structure_filter": _with("snt aloc aso ids ent", f"SELECT pmc_id, patient_id, CAST(v_ord AS BIGINT) AS v_ord, value FROM aso a WHERE coalesce((SELECT count(*) FROM pat p WHERE p.pmc_id = a.pmc_id), 0) <= 1 OR EXISTS (SELECT 1 FROM sup s WHERE s.pmc_id = a.pmc_id AND s.patient_id = a.patient_id AND s.value = a.value)", w=strp("3000", "300"), sup=f"SELECT DISTINCT w.pmc_id, w.patient_id, unnest({_UNITS}) AS value FROM w JOIN ent e ON e.pmc_id = w.pmc_id AND e.e_ord = w.e_ord"),
        "clip_associations": _with("aso voted", "SELECT pmc_id, patient_id, CAST(v_ord AS BIGINT) AS v_ord, value FROM aso a WHERE EXISTS (SELECT 1 FROM allowed x WHERE x.pmc_id = a.pmc_id AND x.value = a.value)", allowed=_CLIP),
        "fuse_patient_count": _with("near aso ids pat", _seen("(SELECT pmc_id, patient_id, value, source, v_ord FROM r JOIN kept USING (pmc_id, patient_id, value))", "source v_ord"),
            r="SELECT t.*, f.n FROM (SELECT pmc_id, patient_id, value, v_ord, 0 AS source FROM near UNION ALL SELECT pmc_id, patient_id, value, v_ord, 1 FROM aso) t JOIN (SELECT DISTINCT pmc_id, patient_id, count(*) OVER (PARTITION BY pmc_id) AS n FROM pat) f ON f.pmc_id = t.pmc_id AND f.patient_id = t.patient_id",
            per="SELECT pmc_id, patient_id, value, any_value(n) AS n, bool_or(source = 0) AS p, bool_or(source = 1) AS s FROM r GROUP BY 1, 2, 3",
            tot="SELECT *, count(*) FILTER (p) OVER (PARTITION BY pmc_id, patient_id) AS np, count(*) FILTER (s) OVER (PARTITION BY pmc_id, patient_id) AS ns FROM per",
            kept="SELECT pmc_id, patient_id, value FROM tot WHERE CASE WHEN n BETWEEN 1 AND 2 AND NOT (ns > 0 AND np / ns >= 2.0) THEN TRUE WHEN NOT n BETWEEN 1 AND 2 THEN p ELSE s END"),
        "vote_associations": _with("near aso voted pat", _seen("(SELECT * FROM r SEMI JOIN ok USING (pmc_id, patient_id, value))", "source v_ord"), allowed=_CLIP,
            r="SELECT t.*, f.n FROM (SELECT pmc_id, patient_id, value, v_ord, 0 AS source FROM aso UNION ALL SELECT pmc_id, patient_id, value, v_ord, 1 FROM near UNION ALL SELECT pmc_id, patient_id, value, v_ord, 2 FROM near c WHERE EXISTS (SELECT 1 FROM allowed x WHERE x.pmc_id = c.pmc_id AND x.value = c.value)) t JOIN (SELECT DISTINCT pmc_id, patient_id, count(*) OVER (PARTITION BY pmc_id) AS n FROM pat) f ON f.pmc_id = t.pmc_id AND f.patient_id = t.patient_id WHERE NOT (f.n = 1 AND source = 2)",
            ok="SELECT pmc_id, patient_id, value FROM r GROUP BY 1, 2, 3 HAVING count(DISTINCT source) >= CASE WHEN any_value(n) = 1 THEN 1 ELSE 2 END"),
        "augment_associations": _with("near aso", _seen("(SELECT pmc_id, patient_id, value, 0 AS source, v_ord FROM aso UNION ALL SELECT pmc_id, patient_id, value, 1, v_ord FROM near n WHERE EXISTS (SELECT 1 FROM aso a WHERE a.pmc_id = n.pmc_id AND a.patient_id = n.patient_id))", "source v_ord")),
        "evaluate_mention": _with("ent annd docs", _prf("m"), **_MENTION_PARTS, m=_MENTION).replace("SELECT tp, fp, fn", "SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn"),
        "evaluate_document": _with("ent annd docs", _prf("m"), **{k: v.replace("pmc_id, off, len, unnest", "pmc_id, unnest") if k != "gb" else v for k, v in _MENTION_PARTS.items()}, m=_DOCUMENT),
        "evaluate_association": _with("aso near docs", _prf("asc1", ", round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1"), **_PATIENT_PARTS),
        "evaluate_score": _with("ent annd aso near docs", "SELECT round(a.f1, 9) AS mention_f1, round(b.f1, 9) AS document_f1, round(c.f1, 9) AS association_micro_f1, round(mf, 9) AS association_macro_f1, round(0.25 * (a.f1 + b.f1) + 0.25 * (c.f1 + mf), 9) AS score FROM f a, f2 b, f3 c, asc1",
            **_MENTION_PARTS, m=_MENTION, d2="SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM (SELECT pmc_id, u, bool_or(g) AS g, bool_or(p) AS p FROM (SELECT pmc_id, u, TRUE AS g, FALSE AS p FROM gu UNION ALL SELECT pmc_id, u, FALSE, TRUE FROM pu) GROUP BY ALL)", **_PATIENT_PARTS,
            f=_f1_of("m"), f2=_f1_of("d2"), f3=_f1_of("asc1")),
        "renested_articles": _with("docs ent pat aso", "SELECT coalesce(e.pmc_id, a.pmc_id) AS pmc_id, coalesce(n, 0) AS n_entities, coalesce(first_identifier, '') AS first_identifier, association FROM (SELECT pmc_id, count(*) AS n, coalesce(arg_min(identifier, e_ord), '') AS first_identifier FROM ent GROUP BY pmc_id) e FULL JOIN a ON a.pmc_id = e.pmc_id",
            v="SELECT pmc_id, patient_id, list(value ORDER BY v_ord, value) AS ph FROM aso GROUP BY ALL",
            a="""SELECT p.pmc_id, '[' || string_agg('{"patient_id":' || to_json(p.patient_id) || ',"phenotype":' || to_json(coalesce(v.ph, [])) || '}', ',' ORDER BY patient_ord) || ']' AS association FROM pat p LEFT JOIN v ON v.pmc_id = p.pmc_id AND v.patient_id = p.patient_id GROUP BY p.pmc_id"""),
        "group_propagation": _with("snt near pat anc ent", _seen("(SELECT pmc_id, patient_id, value, 0 AS part, v_ord AS ord FROM near UNION ALL SELECT s.pmc_id, s.patient_id, s.value, 1, r.o FROM stated s JOIN vo r ON r.pmc_id = s.pmc_id AND r.value = s.value)", "part ord"), **_GROUP_PARTS),
        "stabilize_associations": _with("aso fused adds pat psg", _seen("stab", "source v_ord"), **_STABLE_PARTS),
        "abbreviation_candidates": _with("loc ent psg", _ABBREVIATIONS, **_ABBREVIATION_PARTS),
        "abbreviations_written_out": _with("docs", _ABBREVIATIONS, **{"src": _PARTS["ent"], "ent": _WRITTEN_ENT, "psg": _WRITTEN_PSG, "loc": _PARTS["loc"]}, **_ABBREVIATION_PARTS),
        "validate_submission": _with("docs psg", _VALIDATE, **_VALIDATE_PARTS),
        "ontology_descendants": _with("trm", "SELECT identifier FROM reach", recursive=True, edges=f"SELECT DISTINCT identifier, parent FROM (SELECT identifier, {_tidy('p')} AS parent FROM (SELECT identifier, unnest(parents) AS p FROM trm)) WHERE parent IS NOT NULL", reach="SELECT identifier FROM trm WHERE NOT obsolete AND coalesce(len(parents), 0) = 0 UNION SELECT e.identifier FROM edges e JOIN reach r ON e.parent = r.identifier"),
        "canonical_ids": _with("trm prim", "SELECT i.identifier, coalesce(t.replaced_by, p.main, i.identifier) AS canonical FROM (SELECT identifier FROM trm UNION SELECT unnest(alt_ids) FROM trm) i LEFT JOIN prim p ON p.alt = i.identifier LEFT JOIN trm t ON t.identifier = coalesce(p.main, i.identifier) AND t.obsolete AND t.replaced_by IS NOT NULL WHERE i.identifier IS NOT NULL"),
        "resolve_alias": _with("dict", "SELECT alias, identifier FROM dict"),
        "gazetteer_extract": _with("occ", rf"""SELECT pmc_id, {_E} FROM (SELECT *, {_ORDERED} FROM (SELECT DISTINCT o.pmc_id, d.identifier, CAST(p.p_off + o.start AS INTEGER) AS off, CAST(length(o.alias) AS INTEGER) AS len, substring(p.text, CAST(o.start AS BIGINT) + 1, length(o.alias)) AS text,
            CASE WHEN regexp_matches(regexp_extract(left(p.text, CAST(o.start AS BIGINT)), '(?s)[^.!?;\n]*$'), '{_BEFORE}') OR regexp_matches(regexp_extract(substring(p.text, CAST(o.start AS BIGINT) + length(o.alias) + 1), '(?s)^[^.!?;\n]*[.!?;\n]?'), '{_AFTER}') THEN 'NO' END AS note
            FROM occ o JOIN dict d ON d.alias = o.alias JOIN psg p ON p.pmc_id = o.pmc_id AND p.p_idx = o.p_idx))"""),
        "surface_stats": _with("sst", "SELECT surface, positive, negative, uppercase_positive, occurrences, round(precision, 9) AS precision FROM sst"),
        "most_common_id": _with("com", "SELECT surface, identifier, n FROM com"),
        "alias_priority": _with("sst als adm freq ann trm prim idc", f"SELECT alias, identifier, source FROM ({_CHOICE}) WHERE identifier IS NOT NULL AND source IS NOT NULL", **_POOL,
            usu="SELECT surface, (min({'n': -n, 's': s, 'i': identifier})).i AS usual, (min({'n': -np, 's': s, 'i': identifier}) FILTER (np > 0)).i AS usual_positive FROM (SELECT surface, identifier, sum(n) AS n, sum(np) AS np, min({'p': pmc_id, 'e': seen}) AS s FROM idc GROUP BY ALL) GROUP BY surface",
            rows_="SELECT coalesce(s.surface, p.alias) AS alias, s.* EXCLUDE surface, u.usual, u.usual_positive, p.* EXCLUDE alias FROM sst s FULL JOIN pool p ON p.alias = s.surface LEFT JOIN usu u ON u.surface = s.surface"),
        "gazetteer_leave_one_out": _with("als adm freq ann trm prim idc srf runs", f"SELECT c.pmc_id, c.alias, identifier, source, n FROM ({_CHOICE.replace('SELECT alias', 'SELECT pmc_id, alias')}) c JOIN own o ON o.pmc_id = c.pmc_id AND o.alias = c.alias WHERE identifier IS NOT NULL AND source IS NOT NULL", **_POOL,
            every="SELECT alias FROM pool UNION SELECT surface FROM srf",
            own=f"SELECT pmc_id, alias, count(*) AS n FROM ({_HIT.replace('@A@', 'every')}) GROUP BY ALL",
            lad=_PARTS["lab"].replace("SELECT surface, count", "SELECT pmc_id, surface, count").replace("GROUP BY surface", "GROUP BY pmc_id, surface"),
            # every article against all others, plainly
            los="SELECT o.pmc_id, o.alias, sum(l.positive) AS positive, sum(l.negative) AS negative, sum(l.uppercase_positive) AS uppercase_positive FROM own o JOIN lad l ON l.surface = o.alias AND l.pmc_id <> o.pmc_id GROUP BY ALL",
            loc2="SELECT o.pmc_id, o.alias, sum(x.n) AS occurrences FROM own o JOIN own x ON x.alias = o.alias AND x.pmc_id <> o.pmc_id GROUP BY ALL",
            loi="SELECT o.pmc_id, o.alias, c.identifier, sum(c.n) AS n, sum(c.np) AS np, min({'p': c.pmc_id, 'e': c.seen}) AS s FROM own o JOIN idc c ON c.surface = o.alias AND c.pmc_id <> o.pmc_id GROUP BY ALL",
            lou="SELECT pmc_id, alias, (min({'n': -n, 's': s, 'i': identifier})).i AS usual, (min({'n': -np, 's': s, 'i': identifier}) FILTER (np > 0)).i AS usual_positive FROM loi GROUP BY ALL",
            rows_="SELECT o.pmc_id, o.alias, l.positive, l.negative, l.uppercase_positive, coalesce(c.occurrences, 0) AS occurrences, CASE WHEN c.occurrences > 0 THEN least(1.0, (l.positive + l.negative) / c.occurrences) ELSE 0.0 END AS precision, u.usual, u.usual_positive, p.* EXCLUDE alias FROM own o LEFT JOIN los l ON l.pmc_id = o.pmc_id AND l.alias = o.alias LEFT JOIN loc2 c ON c.pmc_id = o.pmc_id AND c.alias = o.alias LEFT JOIN lou u ON u.pmc_id = o.pmc_id AND u.alias = o.alias LEFT JOIN pool p ON p.alias = o.alias"),
    }


def _f1_of(source: str) -> str:
    return f"SELECT CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM (SELECT CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM {source})"
