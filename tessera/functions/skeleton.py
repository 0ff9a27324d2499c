"""Schema-independent skeletons of SQL queries.

A skeleton keeps keywords, functions, operators and brackets of a query and
puts a placeholder for each table, column and literal. Queries are parsed and
written anew, so that each meaning has one text: upper-case keywords and
functions, single spaces, no aliases, no final semicolon; see :class:`Parser`.
Names of functions stay as they are written, but for their case.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are part of the language and are kept by the rough skeleton.
KEYWORDS = frozenset(
    """ALL AND ANY AS ASC BETWEEN BY CASE CAST COLLATE CROSS CURRENT DELETE DESC DISTINCT ELSE END ESCAPE EXCEPT EXISTS FILTER FIRST FOLLOWING FROM FULL
    GLOB GROUP HAVING IN INNER INSERT INTERSECT INTO IS ISNULL JOIN LAST LEFT LIKE LIMIT NATURAL NOT NOTNULL NULL NULLS OFFSET ON OR ORDER OUTER OVER
    PARTITION PRECEDING RANGE RECURSIVE REGEXP RIGHT ROW ROWS SELECT SET THEN UNBOUNDED UNION UPDATE USING VALUES WHEN WHERE WINDOW WITH""".split()
)
# Words of the language that can't be a name without quotes.
RESERVED = frozenset(
    """ALL AND AS BETWEEN BY CASE CAST COLLATE CROSS DELETE DISTINCT ELSE END ESCAPE EXCEPT EXISTS FROM FULL GROUP HAVING IN INNER INSERT INTERSECT INTO
    IS ISNULL JOIN LEFT LIKE LIMIT NATURAL NOT NOTNULL NULL ON OR ORDER OUTER RIGHT SELECT SET THEN UNION UPDATE USING VALUES WHEN WHERE WITH""".split()
)
# Operands that stay as they are.
CONSTANTS = frozenset("NULL TRUE FALSE CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP".split())
# Which storage class a declared type has, by the first of these parts that its name holds.
AFFINITY = (("INT", "INTEGER"), ("BOOL", "INTEGER"), ("CHAR", "TEXT"), ("CLOB", "TEXT"), ("TEXT", "TEXT"), ("BLOB", "BLOB"), ("REAL", "REAL"), ("FLOA", "REAL"), ("DOUB", "REAL"), ("DEC", "REAL"))
#: Operators by how strongly they bind, from comparisons of size up; all are left-associative.
BINARY = (("<", "<=", ">", ">="), ("<<", ">>", "&", "|"), ("+", "-"), ("*", "/", "%"), ("||", "->", "->>"))

_TOKEN = re.compile(
    r"""\s+|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\])|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[?:@$]\w+|\?)"""
    r"""|(?P<word>[^\W\d]\w*)|(?P<op>\|\||<=|>=|<>|!=|==|<<|>>|->>|->|[-+*/%<>=&|~])|(?P<mark>[(),.;])"""
)
TABLE, COLUMN, LITERAL = "<TABLE>", "<COLUMN>", "<LITERAL>"


def strip_comments(sql: str) -> str:
    """Comments as one space each; quotes of any kind are kept. Of an open block comment the last character stays."""
    out, i = [], 0
    closing = {"'": "'", '"': '"', "[": "]", "`": "`"}
    while i < len(sql):
        c = sql[i]
        if c in closing:
            end = i + 1
            while end < len(sql):
                if sql[end] == closing[c]:
                    if c == "'" and sql[end + 1 : end + 2] == "'":
                        end += 2
                        continue
                    break
                end += 1
            out.append(sql[i : end + 1])
            i = end + 1
        elif sql.startswith("--", i):
            end = sql.find("\n", i)
            out.append(" ")
            i = len(sql) if end < 0 else end
        elif sql.startswith("/*", i):
            end = sql.find("*/", i + 2)
            out.append(" ")
            i = len(sql) - 1 if end < 0 else end + 2
        else:
            out.append(c)
            i += 1
    return "".join(out)


def tokens(sql: str) -> list[tuple[str, str]]:
    """(kind, text) of each token: string, name, number, word, op, mark; raises for what is no token."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ValueError(f"no token at {at}: {sql[at : at + 10]!r}")
        at = m.end()
        if m.lastgroup:
            out.append(("name" if m.lastgroup == "quoted" else m.lastgroup, m[0]))
    return out


class Parser:
    """Recursive descent over queries as SQLite has them; each rule returns its part of the skeleton.

    One text for one meaning: names and literals are placeholders, aliases are
    gone, a negated test is the test behind ``NOT``, ``LIMIT a, b`` is ``LIMIT
    b OFFSET a``, types of casts are storage classes.
    """

    def __init__(self, sql: str):
        self.toks, self.i = tokens(sql), 0

    # Tokens

    def at(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("end", "")

    def word(self, k: int = 0) -> str:
        kind, text = self.at(k)
        return text.upper() if kind == "word" else ""

    def take(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def mark(self, *texts: str) -> str:
        kind, text = self.at()
        if kind in ("mark", "op") and text in texts:
            self.i += 1
            return text
        return ""

    def need(self, what: str) -> None:
        if not (self.take(what) if what.isalpha() else self.mark(what)):
            raise ValueError(f"{what} is expected instead of {self.at()[1] or 'the end'}")

    def name(self) -> None:
        kind, text = self.at()
        if kind not in ("word", "name") or (kind == "word" and text.upper() in RESERVED):
            raise ValueError(f"a name is expected instead of {text or 'the end'}")
        self.i += 1

    def alias(self) -> None:
        kind, text = self.at()
        if self.take("AS"):
            if self.at()[0] not in ("word", "name", "string"):
                raise ValueError("an alias is missing")
            self.i += 1
        elif kind in ("name", "string") or (kind == "word" and text.upper() not in RESERVED | {"WINDOW", "OFFSET"}):
            self.i += 1

    def listed(self, rule: Callable[[], str]) -> str:
        out = [rule()]
        while self.mark(","):
            out.append(rule())
        return ", ".join(out)

    # Statements

    def statement(self) -> str:
        out = ""
        if self.take("WITH"):
            recursive = "RECURSIVE " if self.take("RECURSIVE") else ""
            out = f"WITH {recursive}{self.listed(self.common)} "
        if self.take("INSERT"):
            out += self.insert()
        elif self.take("UPDATE"):
            self.name()
            self.need("SET")
            out += f"UPDATE {TABLE} SET {self.listed(self.setting)}{self.where()}"
        elif self.take("DELETE"):
            self.need("FROM")
            self.name()
            out += f"DELETE FROM {TABLE}{self.where()}"
        else:
            out += self.query()
        if self.at()[0] != "end":
            raise ValueError(f"{self.at()[1]} isn't expected")
        return out

    def common(self) -> str:
        self.name()
        if self.mark("("):
            self.listed(self.column)
            self.need(")")
        self.need("AS")
        self.need("(")
        inner = self.inner()
        return f"{TABLE} AS {inner}"

    def insert(self) -> str:
        self.need("INTO")
        self.name()
        columns = ""
        if self.mark("("):
            columns = f" ({self.listed(self.column)})"
            self.need(")")
        return f"INSERT INTO {TABLE}{columns} {self.query()}"

    def setting(self) -> str:
        column = self.column()
        self.need("=")
        return f"{column} = {self.expression()}"

    def where(self) -> str:
        return f" WHERE {self.expression()}" if self.take("WHERE") else ""

    def inner(self) -> str:
        """A query whose opening bracket has been read."""
        out = ""
        if self.take("WITH"):
            recursive = "RECURSIVE " if self.take("RECURSIVE") else ""
            out = f"WITH {recursive}{self.listed(self.common)} "
        out += self.query()
        self.need(")")
        return f"({out})"

    def query(self) -> str:
        out = self.core()
        while self.word() in ("UNION", "INTERSECT", "EXCEPT"):
            out += f" {self.word()}"
            self.i += 1
            out += " ALL" if self.take("ALL") else ""
            out += f" {self.core()}"
        if self.take("ORDER", "BY"):
            out += f" ORDER BY {self.listed(self.ordering)}"
        if self.take("LIMIT"):
            first = self.expression()
            if self.mark(","):
                first, skipped = self.expression(), first
                out += f" LIMIT {first} OFFSET {skipped}"
            else:
                out += f" LIMIT {first}" + (f" OFFSET {self.expression()}" if self.take("OFFSET") else "")
        return out

    def core(self) -> str:
        if self.mark("("):
            return self.inner()
        if self.take("VALUES"):
            return f"VALUES {self.listed(self.row)}"
        if not self.take("SELECT"):
            raise ValueError(f"a query is expected instead of {self.at()[1] or 'the end'}")
        out = "SELECT" + (" DISTINCT" if self.take("DISTINCT") else "")
        self.take("ALL")
        out += f" {self.listed(self.result)}"
        if self.take("FROM"):
            out += f" FROM {self.sources()}"
        out += self.where()
        if self.take("GROUP", "BY"):
            out += f" GROUP BY {self.listed(self.expression)}"
        if self.take("HAVING"):
            out += f" HAVING {self.expression()}"
        if self.take("WINDOW"):
            out += f" WINDOW {self.listed(self.named_window)}"
        return out

    def row(self) -> str:
        self.need("(")
        out = self.listed(self.expression)
        self.need(")")
        return f"({out})"

    def result(self) -> str:
        if self.mark("*"):
            return "*"
        out = self.expression()
        self.alias()
        return out

    def ordering(self) -> str:
        out = self.expression()
        out += " ASC" if self.take("ASC") else " DESC" if self.take("DESC") else ""
        return out + (" NULLS FIRST" if self.take("NULLS", "FIRST") else " NULLS LAST" if self.take("NULLS", "LAST") else "")

    # Sources

    def sources(self) -> str:
        out = self.source()
        while True:
            if self.mark(","):
                out += f", {self.source()}"
                continue
            kind = ["NATURAL"] if self.take("NATURAL") else []
            for w in ("LEFT", "RIGHT", "FULL", "INNER", "CROSS"):
                kind += [w] if self.take(w) else []
            kind += ["OUTER"] if self.take("OUTER") else []
            if not self.take("JOIN"):
                if kind:
                    raise ValueError("JOIN is missing")
                return out
            out += f" {' '.join([*kind, 'JOIN'])} {self.source()}"
            if self.take("ON"):
                out += f" ON {self.expression()}"
            elif self.take("USING"):
                self.need("(")
                out += f" USING ({self.listed(self.column)})"
                self.need(")")

    def source(self) -> str:
        if self.mark("("):
            if self.word() in ("SELECT", "WITH", "VALUES") or self.at()[1] == "(":
                out = self.inner()
            else:
                out = f"({self.sources()})"
                self.need(")")
        elif self.at()[0] == "word" and self.at(1) == ("mark", "(") and self.word() not in RESERVED:
            out = self.call()
        else:
            self.name()
            while self.mark("."):
                self.name()
            out = TABLE
        self.alias()
        return out

    # Expressions

    def column(self) -> str:
        self.name()
        return COLUMN

    def expression(self) -> str:
        out = self.conjunction()
        while self.take("OR"):
            out += f" OR {self.conjunction()}"
        return out

    def conjunction(self) -> str:
        out = self.negation()
        while self.take("AND"):
            out += f" AND {self.negation()}"
        return out

    def negation(self) -> str:
        return f"NOT {self.negation()}" if self.take("NOT") else self.comparison()

    def comparison(self) -> str:
        out = self.binary(0)
        while True:
            if op := self.mark("=", "==", "<>", "!="):
                out += f" {'<>' if op in ('<>', '!=') else '='} {self.binary(0)}"
                continue
            start, no = self.i, ""
            if self.take("IS"):
                no = "NOT " if self.take("NOT") else ""
                how = "IS DISTINCT FROM" if self.take("DISTINCT", "FROM") else "IS"
                out = f"{no}{out} {how} {self.binary(0)}"
                continue
            if self.take("ISNULL"):
                out = f"{out} IS NULL"
                continue
            if self.take("NOTNULL") or self.take("NOT", "NULL"):
                out = f"NOT {out} IS NULL"
                continue
            no = "NOT " if self.take("NOT") else ""
            if self.take("BETWEEN"):
                low = self.binary(0)
                self.need("AND")
                out = f"{no}{out} BETWEEN {low} AND {self.binary(0)}"
            elif self.take("IN"):
                out = f"{no}{out} IN {self.members()}"
            elif self.word() in ("LIKE", "GLOB", "REGEXP", "MATCH"):
                how = self.word()
                self.i += 1
                out = f"{no}{out} {how} {self.binary(0)}" + (f" ESCAPE {self.binary(0)}" if self.take("ESCAPE") else "")
            else:
                self.i = start
                return out

    def members(self) -> str:
        if not self.mark("("):
            self.name()
            return TABLE
        if self.word() in ("SELECT", "WITH", "VALUES"):
            return self.inner()
        out = "" if self.at()[1] == ")" else self.listed(self.expression)
        self.need(")")
        return f"({out})"

    def binary(self, level: int) -> str:
        if level == len(BINARY):
            return self.collated()
        out = self.binary(level + 1)
        while op := self.mark(*BINARY[level]):
            out += f" {op} {self.binary(level + 1)}"
        return out

    def collated(self) -> str:
        out = self.unary()
        while self.take("COLLATE"):
            out += f" COLLATE {self.at()[1].upper()}"
            self.name()
        return out

    def unary(self) -> str:
        if sign := self.mark("-", "+", "~"):
            inner = self.unary()
            return inner if sign == "-" and inner == LITERAL else f"{sign}{inner}"
        return self.operand()

    def operand(self) -> str:
        kind, text = self.at()
        word = self.word()
        if kind in ("string", "number"):
            self.i += 1
            return LITERAL
        if self.mark("("):
            if self.word() in ("SELECT", "WITH", "VALUES"):
                return self.inner()
            out = self.listed(self.expression)
            self.need(")")
            return f"({out})"
        if word in CONSTANTS:
            self.i += 1
            return word
        if self.take("CASE"):
            return self.case()
        if self.take("CAST"):
            return self.cast()
        if self.take("EXISTS"):
            self.need("(")
            return f"EXISTS{self.inner()}"
        if kind == "word" and self.at(1) == ("mark", "(") and (word not in RESERVED or word in ("LEFT", "RIGHT", "LIKE")):
            return self.call()
        self.name()
        while self.mark("."):
            if not self.mark("*"):
                self.name()
        return COLUMN

    def case(self) -> str:
        out = "CASE" + ("" if self.word() == "WHEN" else f" {self.expression()}")
        if self.word() != "WHEN":
            raise ValueError("WHEN is missing")
        while self.take("WHEN"):
            out += f" WHEN {self.expression()}"
            self.need("THEN")
            out += f" THEN {self.expression()}"
        if self.take("ELSE"):
            out += f" ELSE {self.expression()}"
        self.need("END")
        return f"{out} END"

    def cast(self) -> str:
        self.need("(")
        inner, said = self.expression(), []
        self.need("AS")
        while self.at()[0] == "word":
            said.append(self.word())
            self.i += 1
        if not said:
            raise ValueError("a type is missing")
        if self.mark("("):
            self.listed(self.unary)
            self.need(")")
        self.need(")")
        declared = " ".join(said)
        return f"CAST({inner} AS {next((kind for part, kind in AFFINITY if part in declared), declared)})"

    def call(self) -> str:
        out = self.word()
        self.i += 1
        self.need("(")
        if self.mark("*"):
            out += "(*"
        elif self.at()[1] == ")":
            out += "("
        else:
            out += "(" + ("DISTINCT " if self.take("DISTINCT") else "") + self.listed(self.expression)
            if self.take("ORDER", "BY"):
                out += f" ORDER BY {self.listed(self.ordering)}"
        self.need(")")
        out += ")"
        if self.word() == "FILTER" and self.at(1) == ("mark", "("):
            self.i += 2
            out += f" FILTER({self.where().strip()})"
            self.need(")")
        if self.take("OVER"):
            if self.mark("("):
                out += f" OVER ({self.window()})"
                self.need(")")
            else:
                self.name()
                out += f" OVER {COLUMN}"
        return out

    def named_window(self) -> str:
        self.name()
        self.need("AS")
        self.need("(")
        out = f"{COLUMN} AS ({self.window()})"
        self.need(")")
        return out

    def window(self) -> str:
        parts = []
        if self.take("PARTITION", "BY"):
            parts.append(f"PARTITION BY {self.listed(self.expression)}")
        if self.take("ORDER", "BY"):
            parts.append(f"ORDER BY {self.listed(self.ordering)}")
        if self.word() in ("ROWS", "RANGE", "GROUPS"):
            kind = self.word()
            self.i += 1
            if self.take("BETWEEN"):
                low = self.bound()
                self.need("AND")
                parts.append(f"{kind} BETWEEN {low} AND {self.bound()}")
            else:
                parts.append(f"{kind} {self.bound()}")
        return " ".join(parts)

    def bound(self) -> str:
        if self.take("CURRENT", "ROW"):
            return "CURRENT ROW"
        out = "UNBOUNDED" if self.take("UNBOUNDED") else self.binary(1)
        if self.word() not in ("PRECEDING", "FOLLOWING"):
            raise ValueError("PRECEDING or FOLLOWING is missing")
        out += f" {self.word()}"
        self.i += 1
        return out


def mask(sql: str, typed: bool = False) -> str:
    """The skeleton of a query; raises ValueError for what isn't one."""
    joined = Parser(strip_comments(sql).strip().rstrip(";").strip()).statement()
    return joined if typed else joined.replace(TABLE, "_").replace(COLUMN, "_").replace(LITERAL, "_")


def normalised(sql: str) -> str:
    """A query in plain lower case: one blank between tokens, single quotes, table names for their aliases.

    Words outside quotes are in lower case, a final semicolon and aliases go,
    and terms of ORDER BY that say no direction get ``asc``.
    """
    toks = [(kind, "'" + text[1:-1] + "'" if text[0] == '"' else text if kind == "string" else text.lower()) for kind, text in tokens(strip_comments(sql).strip().rstrip(";"))]
    names = {}
    for i, (_, text) in enumerate(toks):
        if text in ("from", "join", ",") and i + 1 < len(toks) and toks[i + 1][0] in ("word", "name"):
            if text == "," and not in_from(toks, i):
                continue
            j = i + 2 + (i + 2 < len(toks) and toks[i + 2][1] == "as")
            if j < len(toks) and toks[j][0] == "word" and toks[j][1].upper() not in RESERVED:
                names[toks[j][1]] = toks[i + 1][1]
    out: list[str] = []
    i = 0
    while i < len(toks):
        kind, text = toks[i]
        dotted = i + 1 < len(toks) and toks[i + 1][1] == "."
        if text == "as" and kind == "word":
            i += 2 if i + 1 < len(toks) and toks[i + 1][1] != "(" else 1
            continue
        if kind == "word" and text in names:
            if dotted:
                out.append(names[text])
            elif out and out[-1] != names[text]:
                out.append(text)
        else:
            out.append(text)
        i += 1
    joined = re.sub(r" ?\. ?", ".", " ".join(out))
    return with_directions(joined)


def in_from(toks: list[tuple[str, str]], i: int) -> bool:
    """Whether the comma at i stands between the tables of FROM."""
    depth = 0
    for _, text in reversed(toks[:i]):
        depth += (text == ")") - (text == "(")
        if depth < 0 or text in ("select", "where", "on", "by", "having", "in"):
            return False
        if text == "from" and depth == 0:
            return True
    return False


def with_directions(sql: str) -> str:
    """``asc`` after each term of ORDER BY that has no direction."""

    def terms(m: re.Match) -> str:
        depth, start, parts, text = 0, 0, [], m[2]
        for i, c in enumerate(text + ","):
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append(text[start:i].strip())
                start = i + 1
        return m[1] + " , ".join(p if re.search(r" (asc|desc)( nulls \w+)?$", p) else f"{p} asc" for p in parts)

    return re.sub(r"(order by )((?:\([^()]*\)|[^()])+?)(?= limit | \)|$)", terms, sql)


def attempt(f: Callable[[str], str], sql: str | None) -> tuple[str | None, str | None]:
    """(skeleton, error): one of them is null."""
    if not sql:
        return None, "no query"
    try:
        return f(sql), None
    except ValueError as e:
        return None, str(e)
    except RecursionError:
        return None, "the query is nested too deeply"


def skeleton(sql: Column, typed: bool = False) -> Column:
    """``struct<skeleton, error>`` of each query; what can't be masked has an error instead of raising.

    A worker remembers what it has masked of late.
    """

    @F.pandas_udf("skeleton string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        found = {x: attempt(lambda y: mask(y, typed), x) for x in s.unique()}
        return pd.DataFrame([found[x] for x in s], columns=["skeleton", "error"])

    return run(sql)


def with_skeletons(rows: DataFrame, sql: str, name: str = "skeleton", typed: bool = False) -> DataFrame:
    """Adds ``struct<skeleton, error>`` as ``name``; each different query is masked once, wherever it stands."""
    distinct = rows.select(sql).distinct().withColumn(name, skeleton(F.col(sql), typed))
    same = distinct.withColumnRenamed(sql, f"{name}_of")
    return rows.join(same, F.col(sql).eqNullSafe(F.col(f"{name}_of")), "left").drop(f"{name}_of")


def normalised_sql(sql: Column) -> Column:
    """:func:`normalised` of each query; null for what isn't one."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: attempt(normalised, x)[0], na_action="ignore")

    return run(sql)


def without_comments(sql: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(strip_comments, na_action="ignore")

    return run(sql)


# Built-in functions only ---------------------------------------------------------


def to_underscores(x: Column) -> Column:
    """A typed skeleton with one kind of placeholder."""
    for p in (TABLE, COLUMN, LITERAL):
        x = F.replace(x, F.lit(p), F.lit("_"))
    return x


def for_embedding(x: Column, style: str) -> Column:
    """A typed skeleton in the style that is embedded: ``underscore`` or ``typed``."""
    if style not in ("underscore", "typed"):
        raise ValueError(f"no such style: {style}")
    return to_underscores(x) if style == "underscore" else x


def fallback(sql: Column) -> Column:
    """A rough skeleton by words alone: keywords and marks in lower case, everything else a placeholder."""
    found = F.regexp_extract_all(sql, F.lit(r"('[^']*'|\"[^\"]*\"|[A-Za-z_][A-Za-z0-9_.]*|[0-9.]+|<=|>=|<>|!=|[^\s])"), F.lit(1))
    known = F.array(*[F.lit(k.lower()) for k in sorted(KEYWORDS)])
    return F.array_join(F.transform(found, lambda w: F.when(F.array_contains(known, F.lower(w)) | w.rlike(r"^([<>!=]=?|<>|[-+*/%(),])\z"), F.lower(w)).otherwise("_")), " ")


def simplify(x: Column) -> Column:
    """A rough skeleton without what says little: join conditions, lists, comparisons and their conjunctions."""
    x = F.lower(x)
    x = F.regexp_replace(x, r" on _ = _( (and|or) _ = _)*", "")
    x = F.regexp_replace(x, r"_( join _)+", "_")
    x = F.regexp_replace(x, r"_( , _)+", "_")
    x = F.regexp_replace(x, r"_ (=|<>|!=|<=|>=|<|>) _", "_")
    x = F.regexp_replace(x, r"where _( (and|or) _)+", "where _")
    return F.trim(F.regexp_replace(x, " +", " "))


def bag_jaccard(a: Column, b: Column) -> Column:
    """Shared over all words of two strings, repeats counted; 0 for two empty ones."""
    x, y = (F.array_remove(F.split(c, " "), "") for c in (a, b))
    count = lambda w, t: F.size(F.filter(w, lambda v: v == t))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, t: s + F.least(count(x, t), count(y, t)))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 0.0).otherwise(shared / (total - shared))


def normal_identifier(x: Column) -> Column:
    """Trimmed, without semicolons, quotes stripped from each part, lower case."""
    parts = F.split(F.replace(F.trim(x), F.lit(";"), F.lit("")), r"\.")
    return F.array_join(F.transform(parts, lambda p: F.lower(F.regexp_replace(p, r'^[`"\[]+|[`"\]]+$', ""))), ".")


def suffixes(x: Column) -> Column:
    """All dotted endings of an identifier, longest first."""
    p = F.split(x, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), "."))


def is_schema_name(x: Column, names: Column) -> Column:
    """Whether an identifier or one of its endings is among the names."""
    return F.exists(suffixes(normal_identifier(x)), lambda s: F.array_contains(names, s))


def or_default(x: Column, default: str) -> Column:
    """The skeleton, or what stands for a query that has none."""
    return F.coalesce(x, F.lit(default))


def names_by_database(columns: DataFrame, db: str, name: str) -> DataFrame:
    """``(db, names)``: different names in lower case, as many as a database's schema has."""
    return columns.groupBy(db).agg(F.array_sort(F.collect_set(F.lower(name))).alias("names"))
