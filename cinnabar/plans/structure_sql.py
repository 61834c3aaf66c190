"""Structures in plain SQL, for checking the matcher against: texts are parsed to atoms and bonds, queries are joins of bonds.

Rings and electrons are taken as the texts mark them.
"""

#: common table expressions atom(k, i, z, ar), bond(k, a, b, o) and e, the bonds both ways
GRAPH = r"""RECURSIVE
src AS (SELECT doc_key AS k, _molfile AS t FROM molecules WHERE _molfile IS NOT NULL AND trim(_molfile) <> ''),
mol AS (SELECT k, string_split(replace(t, chr(13), ''), chr(10)) AS l FROM src WHERE contains(t, chr(10))),
size AS (SELECT k, l, trim(l[4][1:3])::INT AS na, trim(l[4][4:6])::INT AS nb FROM mol),
matom AS (SELECT k, i, trim(l[4 + i][32:34]) AS s FROM (SELECT k, l, unnest(range(1, na + 1)) AS i FROM size)),
mbond AS (SELECT k, trim(x[1:3])::INT AS a, trim(x[4:6])::INT AS b, trim(x[7:9])::INT AS o FROM (SELECT k, l[4 + na + unnest(range(1, nb + 1))] AS x FROM size)),
tok AS (SELECT k, regexp_extract_all(t, '\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops]|%[0-9]{2}|[0-9]|[-=#:/~.()]') AS w FROM src WHERE NOT contains(t, chr(10))),
run AS (
 SELECT k, w, 1::BIGINT AS i, []::INT[] AS stack, 0 AS last, 0 AS n, NULL::VARCHAR AS mark, []::STRUCT(r INT, a INT, m VARCHAR)[] AS open,
  NULL::VARCHAR AS atom, NULL::INT AS ba, NULL::INT AS bb, NULL::VARCHAR AS bm FROM tok
 UNION ALL
 SELECT k, w, i + 1,
  CASE x WHEN '(' THEN list_append(stack, last) WHEN ')' THEN stack[:-2] ELSE stack END,
  CASE WHEN kind = 'atom' THEN n + 1 WHEN x = ')' THEN stack[-1] WHEN x = '.' THEN 0 ELSE last END,
  n + (kind = 'atom')::INT,
  CASE WHEN kind = 'bond' THEN x WHEN kind IN ('atom', 'ring') OR x = '.' THEN NULL ELSE mark END,
  CASE WHEN kind <> 'ring' THEN open WHEN len(list_filter(open, lambda y: y.r = ring)) > 0 THEN list_filter(open, lambda y: y.r <> ring) ELSE list_append(open, {'r': ring, 'a': last, 'm': mark}) END,
  CASE WHEN kind = 'atom' THEN x END,
  CASE WHEN kind = 'atom' AND last > 0 THEN last WHEN kind = 'ring' THEN list_filter(open, lambda y: y.r = ring)[1].a END,
  CASE WHEN kind = 'atom' AND last > 0 THEN n + 1 WHEN kind = 'ring' THEN last END,
  CASE WHEN kind = 'ring' THEN coalesce(list_filter(open, lambda y: y.r = ring)[1].m, mark) ELSE mark END
 FROM (SELECT *, w[i] AS x, CASE WHEN w[i] IN ('(', ')', '.') THEN 'other' WHEN w[i] IN ('-', '=', '#', ':', '/', '~') THEN 'bond' WHEN regexp_full_match(w[i], '%?[0-9]+') THEN 'ring' ELSE 'atom' END AS kind, try_cast(ltrim(w[i], '%') AS INT) AS ring FROM run WHERE i <= len(w))),
satom AS (SELECT k, n AS i, CASE WHEN atom[1] = '[' THEN regexp_extract(atom, '^\[[0-9]*([A-Z][a-z]?|[a-z])', 1) ELSE atom END AS s, atom FROM run WHERE atom IS NOT NULL),
sbond AS (SELECT k, ba AS a, bb AS b, CASE bm WHEN '=' THEN 2 WHEN '#' THEN 3 WHEN ':' THEN 4 WHEN '-' THEN 1 END AS o FROM run WHERE ba IS NOT NULL),
shared AS (SELECT k, a AS i FROM mbond WHERE o = 4 UNION SELECT k, b FROM mbond WHERE o = 4),
atom AS (SELECT k, i, upper(s[1]) || s[2:] AS z, regexp_full_match(s, '[a-z]') AS ar FROM satom UNION ALL SELECT m.k, m.i, s, h.i IS NOT NULL FROM matom m LEFT JOIN shared h ON h.k = m.k AND h.i = m.i),
bond AS (SELECT b.k, a, b, coalesce(o, CASE WHEN p.ar AND q.ar THEN 4 ELSE 1 END) AS o FROM sbond b JOIN atom p ON p.k = b.k AND p.i = a JOIN atom q ON q.k = b.k AND q.i = b UNION ALL SELECT k, a, b, o FROM mbond),
e AS (SELECT k, a, b, o FROM bond UNION ALL SELECT k, b, a, o FROM bond)"""


def path(first: str, middle: str, last: str, condition: str = "true", more: str = "") -> str:
    """(k, x, y, z) of paths of three atoms with these conditions on p, q and r."""
    return (
        f"WITH {GRAPH}{more}, path AS (SELECT x.k, x.a AS x, x.b AS y, y.b AS z FROM e x JOIN e y ON x.k = y.k AND x.b = y.a AND x.a <> y.b "
        f"JOIN atom p ON p.k = x.k AND p.i = x.a JOIN atom q ON q.k = x.k AND q.i = x.b JOIN atom r ON r.k = x.k AND r.i = y.b WHERE {first} AND {middle} AND {last} AND {condition})"
    )


AMIDE = path("p.z = 'O'", "q.z = 'C' AND NOT q.ar", "r.z = 'N'", "x.o = 2 AND y.o = 1")
#: six shared bonds in a ring of five carbons and a nitrogen
PYRIDINE = f"""WITH {GRAPH}, f AS (SELECT e.k, e.a, e.b FROM e JOIN atom p ON p.k = e.k AND p.i = e.a JOIN atom q ON q.k = e.k AND q.i = e.b WHERE e.o = 4 AND p.ar AND q.ar),
c AS (SELECT f.* FROM f JOIN atom q ON q.k = f.k AND q.i = f.b WHERE q.z = 'C'), n AS (SELECT k, i FROM atom WHERE z = 'N' AND ar), ring AS (
SELECT DISTINCT n.k, list_sort([n.i, c1.b, c2.b, c3.b, c4.b, c5.b]) AS atoms FROM n JOIN c c1 ON c1.k = n.k AND c1.a = n.i JOIN c c2 ON c2.k = n.k AND c2.a = c1.b JOIN c c3 ON c3.k = n.k AND c3.a = c2.b
JOIN c c4 ON c4.k = n.k AND c4.a = c3.b JOIN c c5 ON c5.k = n.k AND c5.a = c4.b JOIN f z ON z.k = n.k AND z.a = c5.b AND z.b = n.i WHERE len(list_distinct([n.i, c1.b, c2.b, c3.b, c4.b, c5.b])) = 6)"""
