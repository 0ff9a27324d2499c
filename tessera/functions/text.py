"""String functions as columns: SQL fields, answers, tags, literals, JSON clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's strip() and \\s see it within ASCII.
BLANK = r"[ \t\n\r\x0B\f]"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+\z", "")


def or_null(x: Column) -> Column:
    """Null for an empty string."""
    return F.when(x != "", x)


def first_field(columns: Sequence[str], default: str = "") -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[or_null(F.col(c)) for c in columns], F.lit(default))


def first_field_name(columns: Sequence[str]) -> Column:
    """The name of the column that :func:`first_field` takes; null if none holds anything."""
    return F.coalesce(*[F.when(F.col(c) != "", F.lit(c)) for c in columns])


def quote_literal(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_identifier(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))


def truncate(x: Column, n: int, marker: str = "...") -> Column:
    """The first n characters and a marker, if x is longer."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(marker))).otherwise(x)


def is_float(x: Column) -> Column:
    """Digits with at most one point between them and at most one leading minus."""
    return x.rlike(r"^-?[0-9]+(\.[0-9]+)?\z")


def is_negative_int(x: Column) -> Column:
    return x.rlike(r"^-[0-9]+\z")


# Completions --------------------------------------------------------------


def xml_answer(x: Column) -> Column:
    """Text after the last <answer> up to the next </answer>, trimmed."""
    return strip(F.substring_index(F.substring_index(x, "<answer>", -1), "</answer>", 1))


def sql_answer(x: Column) -> Column:
    """SQL of a completion: one line, without semicolons, fences and what stands before the first </think>."""
    out = F.replace(x, F.lit("\n"), F.lit(" "))
    for mark in (";", "</s>", "```sql ", "```"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    end = F.instr(out, "</think>")
    out = F.when(end > 0, F.substring(out, end + len("</think>"), F.length(out))).otherwise(out)
    return xml_answer(out)


def format_reward(x: Column) -> Column:
    """1.0 if x starts as a thought and an answer in their tags, each on lines of its own."""
    return F.when(x.rlike(r"(?smd)\A<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>$"), 1.0).otherwise(0.0)


def tag(x: Column, name: str) -> Column:
    """Content of the first <name> element, whatever its case, trimmed; null if it is empty or missing."""
    return or_null(strip(F.regexp_extract(x, rf"(?is)<{name}>(.*?)</{name}>", 1)))


def unfence(x: Column) -> Column:
    """SQL out of a ```sql block if there is one; without white space and semicolons at the ends."""
    inside = F.regexp_extract(x, r"(?is)```(?:sql)?\s*(.*?)```", 1)
    bare = F.when(x.rlike(r"(?is)```(?:sql)?\s*.*?```"), inside).otherwise(x)
    return F.regexp_replace(strip(bare), r"^[;\s]+|[;\s]+\z", "")


def fail_reason(stage: Column, reason: Column) -> Column:
    return F.concat(stage, F.when(reason == "empty_result", "_sql_empty").otherwise("_sql_invalid"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def url_list(x: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, ","), strip), lambda p: p != "")


def clean_json(x: Column) -> Column:
    """Without byte order marks, zero-width spaces and commas before a closing bracket."""
    return F.regexp_replace(F.regexp_replace(x, "[﻿​]", ""), r",\s*([}\]])", "$1")


def clean_json_hard(x: Column) -> Column:
    """Also without comments and control characters, and with quotes around bare keys."""
    out = F.regexp_replace(x, r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, r"(?m)//[^\n]*", "")
    out = F.regexp_replace(out, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    return clean_json(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def json_block(x: Column) -> Column:
    """The JSON in a completion: the first fenced block, else from the first bracket to its last counterpart."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(x, r"(?s)(\[.*\]|\{.*\})", 1)
    return strip(F.coalesce(or_null(fenced), or_null(bare), x))


# Answers ------------------------------------------------------------------


def normal_answer(x: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    out = F.regexp_replace(F.lower(x), r"""[!-/:-@\[-`{-~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\b(a|an|the)\b", " "), rf"{BLANK}+", " "))


def exact_match(x: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normal_answer(g) == normal_answer(x)).cast("double")


def contains_match(x: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(normal_answer(x), normal_answer(g))).cast("double")


def hash_answer(x: Column) -> Column:
    """The number after ``####``, without commas and dollar signs; null if there is none."""
    return or_null(F.regexp_replace(F.regexp_extract(x, r"#### (-?[0-9.,]+)", 1), "[,$]", ""))


def last_number(x: Column) -> Column:
    """The last run of digits, points and commas that is more than a point."""
    return F.try_element_at(F.filter(F.regexp_extract_all(x, F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda n: ~n.isin("", ".")), F.lit(-1))


def last_tag(x: Column, name: str) -> Column:
    """Content of the last <name> element, trimmed; null if there is none."""
    return strip(F.try_element_at(F.regexp_extract_all(x, F.lit(rf"(?s)<{name}>(.*?)</{name}>"), F.lit(1)), F.lit(-1)))


def count_tags(x: Column, name: str) -> Column:
    """Number of opening and closing tags."""
    return F.struct(F.regexp_count(x, F.lit(f"<{name}>")).alias("opening"), F.regexp_count(x, F.lit(f"</{name}>")).alias("closing"))


def unbox(x: Column) -> Column:
    """What stands in a string that is one box as a whole; null for others."""
    return F.when(x.rlike(r"(?s)^\\boxed\{.*\}\z"), F.regexp_extract(x, r"(?s)^\\boxed\{(.*)\}\z", 1))


def slash_to_frac(x: Column) -> Column:
    """``a/b`` of two integers as a \\frac; other strings as they are."""
    return F.regexp_replace(x, r"^(-?[0-9]+)/(-?[0-9]+)\z", r"\\frac{$1}{$2}")


def fix_sqrt(x: Column) -> Column:
    """Braces around the character after \\sqrt."""
    return F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}")


def cut_units(x: Column) -> Column:
    """What stands before ``\\text{ ``."""
    return F.substring_index(x, "\\text{ ", 1)


def passages(docs: Column) -> Column:
    """Numbered passages, each with its first line as title."""
    one = lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), F.substring_index(d, "\n", 1), F.lit(") "), F.regexp_replace(d, r"(?s)^[^\n]*\n?", ""), F.lit("\n"))
    return F.array_join(F.transform(docs, one), "")


def final_answer_line(x: Column) -> Column:
    """What the last ``Answer:`` line says; ``[INVALID]`` if there is none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(x, F.lit(r"(?i)Answer[ \t]*:[ \t]*([^\n]+)"), F.lit(1)), F.lit(-1)), F.lit("[INVALID]"))


def drop_bracketed(x: Column) -> Column:
    """Trimmed, `` [title]`` as a full stop, other bracketed notes gone, double spaces once made single."""
    out = F.replace(strip(x), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(out, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def choice(x: Column, letters: str = "A-D") -> Column:
    """The letter after ``Answer:``, as it is written; empty without one."""
    return F.regexp_extract(x, rf"(?i)Answer[ \t]*:[ \t]*\$?([{letters}])\$?", 1)


def thought_and_box(x: Column) -> Column:
    """Whether a text is a thought in its tags and then has a box."""
    return x.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z")


def same_lines(a: Column, b: Column) -> Column:
    """Equal but for white space at the ends of the texts and of their lines."""
    lines = lambda x: F.array_join(F.transform(F.split(strip(x), "\n"), strip), "\n")
    return lines(a) == lines(b)
