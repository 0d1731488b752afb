"""Queries of the record-shaping operators: nested records, packed fields, hierarchies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mentionloom.operators import hierarchy, packed, tagged
from mentionloom.session import shared_path, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "records")
    tagged.write_tables(tagged.flatten_records(table(spark, d, "raw_articles")), path)
    return tagged.child_values(spark, path)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_values(table(spark, d, "entities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.term_hierarchy(table(spark, d, "hpo_terms"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found}


_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _tidy(x: str) -> str:
    bare = _trim(f"regexp_replace({x}, '(?s)!.*$', '')")
    return f"nullif(regexp_replace(upper({bare}), '^HP[_:]\\s*', 'HP:'), '')"


def _array(value: str) -> str:
    """A JSON array as a list: text that holds JSON is opened, an object or scalar is a list of one."""
    text = f"({value} ->> '$')"
    opened = f"CASE WHEN json_type({value}) = 'VARCHAR' AND regexp_matches({text}, '^\\s*[\\[{{]') AND json_valid({text}) THEN CAST({text} AS JSON) ELSE {value} END"
    return f"CASE WHEN {value} IS NULL OR json_type({value}) = 'NULL' THEN [] WHEN json_type({opened}) = 'ARRAY' THEN CAST({opened} AS JSON[]) ELSE [{opened}] END"


def _nested() -> str:
    def level(source: str, field: str) -> str:
        listed = _array(f"json_extract(d, '$.{field}')")
        return f"SELECT line_no, i, l[i+1] AS e FROM (SELECT line_no, {listed} AS l FROM {source}), unnest(range(len(l))) t(i) WHERE l[i+1] IS NOT NULL AND json_type(l[i+1]) <> 'NULL'"

    def inner(source: str, field: str) -> str:
        listed = _array(f"json_extract(e, '$.{field}')")
        return f"SELECT line_no, i, j, m[j+1] AS e FROM (SELECT line_no, i, {listed} AS m FROM {source}), unnest(range(len(m))) t(j) WHERE m[j+1] IS NOT NULL AND json_type(m[j+1]) <> 'NULL'"

    def flat(tag: str, source: str, field: str) -> str:
        return f"SELECT line_no, '{tag}' AS child, CAST(-1 AS INTEGER) AS parent_pos, CAST(i AS INTEGER) AS pos, coalesce(json_extract_string(e, '$.{field}'), '') AS val FROM {source}"

    return f"""
        WITH v AS (SELECT line_no, ltrim(payload, chr(65279)) AS x FROM raw_articles),
             j AS (SELECT line_no, CAST(x AS JSON) AS j FROM v WHERE json_valid(x)),
             o AS (SELECT line_no, CASE WHEN json_exists(j, '$.document') THEN json_extract(j, '$.document') ELSE j END AS d FROM j WHERE json_type(j) = 'OBJECT'),
             p AS ({level("o", "full_text")}), q AS ({level("o", "patient")}), e AS ({level("o", "entities")}), a AS ({level("o", "association")}), m AS ({inner("q", "mention")}), h AS ({inner("a", "phenotype")})
        {flat("passage", "p", "section_type")} UNION ALL {flat("patient", "q", "patient_id")} UNION ALL {flat("entity", "e", "identifier")} UNION ALL {flat("association", "a", "patient_id")}
        UNION ALL SELECT line_no, 'mention', CAST(i AS INTEGER), CAST(j AS INTEGER), coalesce(json_extract_string(e, '$.text'), '') FROM m UNION ALL SELECT line_no, 'phenotype', CAST(i AS INTEGER), CAST(j AS INTEGER), coalesce(json_extract_string(e, '$'), '') FROM h"""


def oracle_sql() -> dict[str, str]:
    ids = r"(HP[:_][0-9]+|-1)"
    piece = r"""(?:"(?:[^"]|"")*"|\([^()]*\)|[^"(;,|/+\t\n\r；，、｜／])+"""
    bare = """CASE WHEN length(v) > 1 AND (v LIKE '"%"' OR v LIKE '''%''') THEN replace(substring(v, 2, length(v) - 2), repeat(left(v, 1), 2), left(v, 1)) ELSE v END"""
    return {
        "p2_found": _nested(),
        "p4_found": f"""
            WITH f AS (SELECT DISTINCT entity_id, regexp_replace(regexp_replace(regexp_replace(identifier, '^\\s*\\[(.*)\\]\\s*$', '\\1'), '{ids} +{ids}', '\\1;\\2', 'g'), '{ids} +{ids}', '\\1;\\2', 'g') AS x FROM entities WHERE identifier IS NOT NULL),
                 s AS (SELECT entity_id, list_filter(list_transform(regexp_extract_all(x, '{piece}'), lambda p: {_trim("p")}), lambda p: p <> '') AS l FROM f)
            SELECT entity_id, CAST(i AS INTEGER) AS pos, {bare} AS val FROM (SELECT entity_id, i, l[i+1] AS v FROM s, unnest(range(len(l))) t(i) WHERE len(l) >= 2)""",
        "p5_found": f"""
            WITH RECURSIVE t AS (SELECT identifier, parents, coalesce(obsolete, FALSE) AS dead, {_tidy("replaced_by")} AS next FROM hpo_terms WHERE trim(identifier) <> '' QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY loaded_at DESC) = 1),
                 step AS (SELECT identifier AS d, next AS c FROM t WHERE dead UNION SELECT s.d, t.next FROM step s JOIN t ON t.identifier = s.c AND t.dead),
                 stands AS (SELECT identifier AS p, identifier AS parent FROM t WHERE NOT dead UNION SELECT s.d, s.c FROM step s JOIN t ON t.identifier = s.c AND NOT t.dead),
                 ent AS (SELECT identifier, {_tidy("p")} AS p FROM (SELECT identifier, unnest(parents) AS p FROM t WHERE NOT dead)),
                 edge AS (SELECT DISTINCT e.identifier AS child, s.parent FROM ent e JOIN stands s ON s.p = e.p),
                 below AS (SELECT parent AS a, child AS n FROM edge UNION SELECT b.a, e.child FROM below b JOIN edge e ON e.parent = b.n),
                 root AS (SELECT identifier FROM t WHERE NOT dead AND identifier NOT IN (SELECT child FROM edge)),
                 lev AS (SELECT identifier AS n, 0 AS d FROM root UNION SELECT e.child, l.d + 1 FROM lev l JOIN edge e ON e.parent = l.n WHERE l.d < 400),
                 dep AS (SELECT n, min(d) AS d FROM lev GROUP BY n),
                 short AS (SELECT e.parent, e.child FROM edge e JOIN dep a ON a.n = e.parent JOIN dep b ON b.n = e.child WHERE b.d = a.d + 1),
                 path AS (SELECT identifier AS n, identifier || '>' AS p FROM root UNION ALL SELECT s.child, x.p || s.child || '>' FROM path x JOIN short s ON s.parent = x.n),
                 best AS (SELECT n, min(p) AS p FROM path GROUP BY n),
                 cnt AS (SELECT a, count(*) FILTER (n <> a) AS k, max(CASE WHEN n = a THEN 1 ELSE 0 END) AS own FROM below GROUP BY a)
            SELECT t.identifier, coalesce(split_part(b.p, '>', 1), '') AS root, CAST(coalesce(d.d, -1) AS INTEGER) AS depth, coalesce(left(b.p, length(b.p) - 1), '') AS path, coalesce(c.k, 0) AS n_descendants, CAST(coalesce(c.own, 0) AS INTEGER) AS on_cycle
            FROM t LEFT JOIN best b ON b.n = t.identifier LEFT JOIN dep d ON d.n = t.identifier LEFT JOIN cnt c ON c.a = t.identifier WHERE NOT t.dead""",
    }
