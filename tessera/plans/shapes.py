"""Queries of many shapes and their typed skeletons, written by hand.

``#`` stands for a number and ``@`` for a text that a row fills in; null: not
a query.
"""

from __future__ import annotations

T, C, L = "<TABLE>", "<COLUMN>", "<LITERAL>"

SHAPES: list[tuple[str, str | None]] = [
    ("select a.p_name as n, count(*) from part as a where a.p_size > # and p_brand = '@' order by n limit #", f"SELECT {C}, COUNT(*) FROM {T} WHERE {C} > {L} AND {C} = {L} ORDER BY {C} LIMIT {L}"),
    ("SELECT * FROM t", f"SELECT * FROM {T}"),
    ("SELECT t.* FROM t;", f"SELECT {C} FROM {T}"),
    ("SELECT COUNT(DISTINCT x) cnt FROM t", f"SELECT COUNT(DISTINCT {C}) FROM {T}"),
    ("SELECT x FROM t WHERE y IS NOT NULL", f"SELECT {C} FROM {T} WHERE NOT {C} IS NULL"),
    ("SELECT x FROM t WHERE y NOTNULL", f"SELECT {C} FROM {T} WHERE NOT {C} IS NULL"),
    ("SELECT x FROM t WHERE y ISNULL", f"SELECT {C} FROM {T} WHERE {C} IS NULL"),
    ("SELECT x FROM t WHERE y NOT LIKE '%@%'", f"SELECT {C} FROM {T} WHERE NOT {C} LIKE {L}"),
    ("SELECT x FROM t WHERE NOT y LIKE '%@%'", f"SELECT {C} FROM {T} WHERE NOT {C} LIKE {L}"),
    ("SELECT x FROM t WHERE y NOT IN (#, #, #)", f"SELECT {C} FROM {T} WHERE NOT {C} IN ({L}, {L}, {L})"),
    ("SELECT x FROM t WHERE y NOT BETWEEN # AND #", f"SELECT {C} FROM {T} WHERE NOT {C} BETWEEN {L} AND {L}"),
    ("SELECT x FROM t WHERE y BETWEEN # AND # AND z = '@'", f"SELECT {C} FROM {T} WHERE {C} BETWEEN {L} AND {L} AND {C} = {L}"),
    ("SELECT x FROM t LIMIT 5, #", f"SELECT {C} FROM {T} LIMIT {L} OFFSET {L}"),
    ("SELECT x FROM t LIMIT # OFFSET 5", f"SELECT {C} FROM {T} LIMIT {L} OFFSET {L}"),
    ("SELECT x FROM t WHERE flag = TRUE OR flag = false", f"SELECT {C} FROM {T} WHERE {C} = TRUE OR {C} = FALSE"),
    ("SELECT x != #, y == # FROM t", f"SELECT {C} <> {L}, {C} = {L} FROM {T}"),
    ("SELECT -#, +x, -y, ~z FROM t", f"SELECT {L}, +{C}, -{C}, ~{C} FROM {T}"),
    ("SELECT a.x FROM t a INNER JOIN u b ON a.i = b.i", f"SELECT {C} FROM {T} INNER JOIN {T} ON {C} = {C}"),
    ("SELECT x FROM t LEFT OUTER JOIN u USING (i, j)", f"SELECT {C} FROM {T} LEFT OUTER JOIN {T} USING ({C}, {C})"),
    ("SELECT x FROM t, u AS v WHERE t.i = v.i", f"SELECT {C} FROM {T}, {T} WHERE {C} = {C}"),
    ("SELECT x FROM t NATURAL JOIN u CROSS JOIN w", f"SELECT {C} FROM {T} NATURAL JOIN {T} CROSS JOIN {T}"),
    ("SELECT x FROM main.t", f"SELECT {C} FROM {T}"),
    ("SELECT main.t.x FROM main.t", f"SELECT {C} FROM {T}"),
    ('SELECT "a b", `c d`, [e f] FROM "g h"', f"SELECT {C}, {C}, {C} FROM {T}"),
    ("SELECT x AS 'the @' FROM t", f"SELECT {C} FROM {T}"),
    ("SELECT x FROM (SELECT y AS x FROM t WHERE z > #) AS s", f"SELECT {C} FROM (SELECT {C} FROM {T} WHERE {C} > {L})"),
    ("SELECT (SELECT MAX(y) FROM u) FROM t", f"SELECT (SELECT MAX({C}) FROM {T}) FROM {T}"),
    ("SELECT x FROM t WHERE y IN (SELECT z FROM u WHERE w = '@')", f"SELECT {C} FROM {T} WHERE {C} IN (SELECT {C} FROM {T} WHERE {C} = {L})"),
    ("SELECT x FROM t WHERE EXISTS (SELECT # FROM u)", f"SELECT {C} FROM {T} WHERE EXISTS(SELECT {L} FROM {T})"),
    ("SELECT x FROM t WHERE NOT EXISTS (SELECT * FROM u)", f"SELECT {C} FROM {T} WHERE NOT EXISTS(SELECT * FROM {T})"),
    ("WITH c AS (SELECT x FROM t) SELECT x FROM c", f"WITH {T} AS (SELECT {C} FROM {T}) SELECT {C} FROM {T}"),
    ("WITH c(a, b) AS (SELECT x, y FROM t), d AS (SELECT # AS z) SELECT a FROM c, d", f"WITH {T} AS (SELECT {C}, {C} FROM {T}), {T} AS (SELECT {L}) SELECT {C} FROM {T}, {T}"),
    ("WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r) SELECT i FROM r", f"WITH RECURSIVE {T} AS (SELECT {L} UNION ALL SELECT {C} + {L} FROM {T}) SELECT {C} FROM {T}"),
    ("SELECT x FROM t UNION SELECT y FROM u ORDER BY 1", f"SELECT {C} FROM {T} UNION SELECT {C} FROM {T} ORDER BY {L}"),
    ("SELECT x FROM t EXCEPT SELECT y FROM u INTERSECT SELECT z FROM v", f"SELECT {C} FROM {T} EXCEPT SELECT {C} FROM {T} INTERSECT SELECT {C} FROM {T}"),
    ("SELECT x, SUM(y) FROM t GROUP BY x HAVING SUM(y) > # ORDER BY SUM(y) DESC, x ASC", f"SELECT {C}, SUM({C}) FROM {T} GROUP BY {C} HAVING SUM({C}) > {L} ORDER BY SUM({C}) DESC, {C} ASC"),
    ("SELECT x FROM t ORDER BY y NULLS LAST", f"SELECT {C} FROM {T} ORDER BY {C} NULLS LAST"),
    ("SELECT CASE WHEN x > # THEN 'a' WHEN x IS NULL THEN 'b' ELSE y END AS z FROM t", f"SELECT CASE WHEN {C} > {L} THEN {L} WHEN {C} IS NULL THEN {L} ELSE {C} END FROM {T}"),
    ("SELECT CASE x WHEN # THEN 1 END FROM t", f"SELECT CASE {C} WHEN {L} THEN {L} END FROM {T}"),
    ("SELECT CAST(x AS REAL) * 100 / COUNT(y) FROM t", f"SELECT CAST({C} AS REAL) * {L} / COUNT({C}) FROM {T}"),
    ("SELECT CAST(x AS int), CAST(y AS VARCHAR(#)), CAST(z AS double precision) FROM t", f"SELECT CAST({C} AS INTEGER), CAST({C} AS TEXT), CAST({C} AS REAL) FROM {T}"),
    ("SELECT iif(x > #, 1, 0), substr(y, 1, 3), strftime('%Y', z) FROM t", f"SELECT IIF({C} > {L}, {L}, {L}), SUBSTR({C}, {L}, {L}), STRFTIME({L}, {C}) FROM {T}"),
    ("SELECT x || ' ' || y FROM t", f"SELECT {C} || {L} || {C} FROM {T}"),
    ("SELECT (x + y) * (z - #) % 7 FROM t", f"SELECT ({C} + {C}) * ({C} - {L}) % {L} FROM {T}"),
    ("SELECT x & 1, y | 2, z << #, w >> 1 FROM t", f"SELECT {C} & {L}, {C} | {L}, {C} << {L}, {C} >> {L} FROM {T}"),
    ("SELECT ROW_NUMBER() OVER (PARTITION BY x ORDER BY y DESC) AS rn FROM t", f"SELECT ROW_NUMBER() OVER (PARTITION BY {C} ORDER BY {C} DESC) FROM {T}"),
    ("SELECT SUM(x) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM t", f"SELECT SUM({C}) OVER (ORDER BY {C} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM {T}"),
    ("SELECT AVG(x) OVER w FROM t WINDOW w AS (PARTITION BY y)", f"SELECT AVG({C}) OVER {C} FROM {T} WINDOW {C} AS (PARTITION BY {C})"),
    ("SELECT COUNT(*) FILTER (WHERE x > #) FROM t", f"SELECT COUNT(*) FILTER(WHERE {C} > {L}) FROM {T}"),
    ("SELECT GROUP_CONCAT(DISTINCT x) FROM t", f"SELECT GROUP_CONCAT(DISTINCT {C}) FROM {T}"),
    ("SELECT x FROM t WHERE y LIKE '@!%' ESCAPE '!'", f"SELECT {C} FROM {T} WHERE {C} LIKE {L} ESCAPE {L}"),
    ("SELECT x FROM t WHERE y GLOB '@*' COLLATE nocase", f"SELECT {C} FROM {T} WHERE {C} GLOB {L} COLLATE NOCASE"),
    ("SELECT x FROM t WHERE y IS NOT # AND z IS '@'", f"SELECT {C} FROM {T} WHERE NOT {C} IS {L} AND {C} IS {L}"),
    ("SELECT x FROM t WHERE (a = # OR b = #) AND NOT c", f"SELECT {C} FROM {T} WHERE ({C} = {L} OR {C} = {L}) AND NOT {C}"),
    ("SELECT x FROM t WHERE y = ? AND z = :p", f"SELECT {C} FROM {T} WHERE {C} = {L} AND {C} = {L}"),
    ("SELECT 'it''s -- @' /* no # */, x -- '@'\n FROM t", f"SELECT {L}, {C} FROM {T}"),
    ("SELECT last, first, date FROM t WHERE year > #", f"SELECT {C}, {C}, {C} FROM {T} WHERE {C} > {L}"),
    ("SELECT x FROM (t JOIN u ON t.i = u.i) JOIN v ON v.j = u.j", f"SELECT {C} FROM ({T} JOIN {T} ON {C} = {C}) JOIN {T} ON {C} = {C}"),
    ("SELECT value FROM json_each('@') WHERE (key, value) IN (VALUES (#, 1))", f"SELECT {C} FROM JSON_EACH({L}) WHERE ({C}, {C}) IN (VALUES ({L}, {L}))"),
    ("SELECT CURRENT_DATE, NULL FROM t", f"SELECT CURRENT_DATE, NULL FROM {T}"),
    ("INSERT INTO t (a, b) VALUES (#, '@')", f"INSERT INTO {T} ({C}, {C}) VALUES ({L}, {L})"),
    ("UPDATE t SET a = #, b = b + 1 WHERE c = '@'", f"UPDATE {T} SET {C} = {L}, {C} = {C} + {L} WHERE {C} = {L}"),
    ("DELETE FROM t WHERE a < #", f"DELETE FROM {T} WHERE {C} < {L}"),
    ("SELECT FROM t", None),
    ("SELECT a FROM t WHERE", None),
    ("SELECT a b c FROM t", None),
    ("SELECT (a FROM t", None),
    ("SELECT a FROM t WHERE x = '@", None),
    ("the answer is @ #", None),
    ("SELECT a FROM t JOIN", None),
]

#: Texts with comments, and what is left of them.
COMMENTED: list[tuple[str, str]] = [
    ("a/* x */#-- end\n'--'", "a # \n'--'"),
    ("SELECT # -- one", "SELECT #  "),
    ("'/* @ */' /**/ b", "'/* @ */'   b"),
    ('"--@"--x', '"--@" '),
    ("`/*`#*/", "`/*`#*/"),
    ("[--]--[", "[--] "),
    ("'it''s--'--@", "'it''s--' "),
    ("a/*b/*c*/d*/@", "a d*/@"),
    ("/*@*//*#*/", "  "),
    ("- - # / * @", "- - # / * @"),
    ("a--x\nb--y\nc#", "a \nb \nc#"),
    ("'@'/*'*/'#'", "'@' '#'"),
]

#: Queries, their rough skeletons by words alone, and these without what says little.
ROUGH: list[tuple[str, str, str]] = [
    ("select a.n as x, count(*) from part as a where a.s > # and b = '@' order by n limit #", "select _ as _ , _ ( * ) from _ as _ where _ > _ and _ = _ order by _ limit _", "select _ as _ ( * ) from _ as _ where _ order by _ limit _"),
    ("SELECT x FROM t JOIN u ON t.i = u.i", "select _ from _ join _ on _ = _", "select _ from _"),
    ("SELECT x, y, z FROM t", "select _ , _ , _ from _", "select _ from _"),
    ("SELECT x FROM t WHERE a = # OR b <> '@'", "select _ from _ where _ = _ or _ <> _", "select _ from _ where _"),
    ("SELECT max(x) FROM t GROUP BY y HAVING max(x) >= #", "select _ ( _ ) from _ group by _ having _ ( _ ) >= _", "select _ ( _ ) from _ group by _ having _ ( _ ) >= _"),
    ("SELECT x FROM t WHERE y IN (SELECT z FROM u)", "select _ from _ where _ in ( select _ from _ )", "select _ from _ where _ in ( select _ from _ )"),
    ("SELECT DISTINCT x FROM t ORDER BY y DESC", "select distinct _ from _ order by _ desc", "select distinct _ from _ order by _ desc"),
    ("SELECT x + # FROM t WHERE y IS NOT NULL", "select _ + _ from _ where _ is not null", "select _ + _ from _ where _ is not null"),
]

#: Queries and their normal forms.
NORMAL: list[tuple[str, str]] = [
    ("SELECT T1.Name FROM Singer AS T1 JOIN Song AS T2 ON T1.id = T2.id WHERE T2.Title = \"@\";", "select singer.name from singer join song on singer.id = song.id where song.title = '@'"),
    ("SELECT a FROM t ORDER BY b, c DESC LIMIT #", "select a from t order by b asc , c desc limit #"),
    ("SELECT  Max(x)   FROM t", "select max ( x ) from t"),
    ("SELECT 'Keep Me @' FROM t", "select 'Keep Me @' from t"),
    ("SELECT x.a FROM t x, u y WHERE x.i = y.i AND x.n > #", "select t.a from t , u where t.i = u.i and t.n > #"),
    ("SELECT a, b FROM t ORDER BY max(a, b)", "select a , b from t order by max ( a , b ) asc"),
    ("select a from (select b as a from t order by b limit #)", "select a from ( select b from t order by b asc limit # )"),
    ("SELECT count(*) AS n FROM t GROUP BY a ORDER BY n ASC", "select count ( * ) from t group by a order by n asc"),
]
