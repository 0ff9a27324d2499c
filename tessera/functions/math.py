"""Answers of mathematical solutions: boxes with matched braces and LaTeX clean-up, in Arrow batches."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def last_boxed(text: str | None) -> str | None:
    """The last ``\\boxed{...}`` or ``\\fbox{...}`` as a whole; null if there is none or its braces don't match."""
    if text is None:
        return None
    start = max(text.rfind("\\boxed{"), text.rfind("\\fbox{"))
    if start < 0:
        return None
    depth = 0
    for i in range(text.index("{", start), len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth:
            return text[start : i + 1]
    return None


def unbox(boxed: str | None) -> str | None:
    """What stands in a box."""
    return None if boxed is None else boxed[boxed.index("{") + 1 : -1]


def fix_fractions(text: str) -> str:
    """Braces for fractions of single characters: ``\\frac12`` and ``\\frac1{72}``."""

    def braces(m: re.Match) -> str:
        return f"\\frac{{{m[1]}}}{{{m[2]}}}" if m[2] != "{" else f"\\frac{{{m[1]}}}{{"

    return re.sub(r"\\frac([^{\s\\])([^\s\\])", braces, text)


# What the clean-up replaces, in this order.
REWRITES = (
    ("\n", ""),
    ("\\!", ""),
    ("\\\\", "\\"),
    ("tfrac", "frac"),
    ("dfrac", "frac"),
    ("\\left", ""),
    ("\\right", ""),
    ("^{\\circ}", ""),
    ("^\\circ", ""),
    ("\\$", ""),
    ("\\%", ""),
    ("%", ""),
    (" .", " 0."),
    ("{.", "{0."),
)


def clean(text: str) -> str:
    """A LaTeX answer in a form in which equal answers are equal strings."""
    for old, new in REWRITES:
        text = text.replace(old, new)
    text = text.split("\\text{ ")[0]
    if text.startswith("."):
        text = "0" + text
    parts = text.split("=")
    if len(parts) == 2 and len(parts[0]) <= 2:
        text = parts[1]
    text = re.sub(r"\\sqrt(?!\{)(\S)", r"\\sqrt{\1}", text).replace(" ", "")
    text = fix_fractions(text)
    if text == "0.5":
        text = "\\frac{1}{2}"
    if m := re.fullmatch(r"(-?\d+)/(-?\d+)", text):
        text = f"\\frac{{{m[1]}}}{{{m[2]}}}"
    return text


def equivalent(a: str | None, b: str | None) -> bool:
    """Equal after the clean-up; nulls are equal to each other only."""
    if a is None or b is None:
        return a is b
    return clean(a) == clean(b)


def boxed(x: Column) -> Column:
    """What the last box of each solution holds."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unbox(last_boxed(t)), na_action="ignore")

    return run(x)


def boxed_score(x: Column, truth: Column) -> Column:
    """1.0 if the last boxed answer equals the truth after the clean-up; 0.0 for others and without a box."""

    @F.pandas_udf("double")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([float((a := unbox(last_boxed(x))) is not None and equivalent(a, y)) for x, y in zip(s, t, strict=True)])

    return run(x, truth)


def strict_box(x: Column, truth: Column, window: int = 100) -> Column:
    """1.0 if the box in the last ``window`` characters holds just the truth, else -1.0."""

    @F.pandas_udf("double")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x is not None and unbox(last_boxed(x[-window:])) == y else -1.0 for x, y in zip(s, t, strict=True)])

    return run(x, truth)


def cleaned(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(clean, na_action="ignore")

    return run(x)


# Equality by value ------------------------------------------------------------

#: Relative difference that two values may have, points at which expressions are compared, and the largest exponent.
TOLERANCE, POINTS, POWER = 1e-4, (0.37, 1.618, -2.25), 64
_CLOSING = {"(": ")", "[": "]", "{": "}"}
_TERM = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|(sqrt|pi|[a-zA-Z])|(\*\*|[-+*/^()]))")


def plain(text: str) -> str:
    """LaTeX as an arithmetic expression: fractions, roots, products and powers; thousands' commas and units of money go."""
    text = clean(text).replace("\\cdot", "*").replace("\\times", "*").replace("\\pi", "pi").replace("\\infty", "inf")
    text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text).replace("$", "")
    while (new := re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", text))) != text:
        text = new
    return text.replace("{", "(").replace("}", ")")


class Formula:
    """Value of an arithmetic expression at a point; rational as long as it can be."""

    def __init__(self, text: str, at: float):
        self.parts, self.i, self.at = self.parted(text), 0, at

    @staticmethod
    def parted(text: str) -> list[str]:
        out, i = [], 0
        text = text.strip()
        while i < len(text):
            m = _TERM.match(text, i)
            if not m:
                raise ValueError(f"no expression: {text!r}")
            out.append(m[0].strip())
            i = m.end()
        return out

    def next(self) -> str:
        return self.parts[self.i] if self.i < len(self.parts) else ""

    def value(self) -> Fraction | float:
        out = self.sum()
        if self.next():
            raise ValueError(f"{self.next()} isn't expected")
        return out

    def sum(self) -> Fraction | float:
        out = self.product()
        while self.next() in ("+", "-"):
            self.i += 1
            out = out + self.product() if self.parts[self.i - 1] == "+" else out - self.product()
        return out

    def product(self) -> Fraction | float:
        out = self.signed()
        while (op := self.next()) and op not in ("+", "-", ")"):
            self.i += op in ("*", "/")
            other = self.signed()  # two factors side by side are a product
            out = out / other if op == "/" else out * other
        return out

    def signed(self) -> Fraction | float:
        if self.next() in ("-", "+"):
            self.i += 1
            return -self.signed() if self.parts[self.i - 1] == "-" else self.signed()
        out = self.atom()
        if self.next() in ("^", "**"):
            self.i += 1
            power = self.signed()
            if abs(power) > POWER:
                raise ValueError("the exponent is too large")
            out = out**power
            if isinstance(out, complex):
                raise ValueError("no real number")
        return out

    def atom(self) -> Fraction | float:
        part = self.next()
        self.i += 1
        if part == "(":
            out = self.sum()
            if self.next() != ")":
                raise ValueError("a bracket is open")
            self.i += 1
            return out
        if part == "sqrt":
            return math.sqrt(self.atom())
        if part == "pi":
            return math.pi
        if part and part[0] in "0123456789.":
            return Fraction(part)
        if len(part) == 1 and part.isalpha():
            return self.at + ord(part) / 100
        raise ValueError(f"an operand is expected instead of {part!r}")


def close(a: Fraction | float, b: Fraction | float) -> bool:
    return a == b or abs(a - b) <= TOLERANCE * max(abs(a), abs(b))


def members(text: str) -> list[str] | None:
    """What stands between commas inside one pair of brackets, with the kinds of brackets first; null for no such list."""
    text = text.strip()
    if len(text) < 2 or text[0] not in _CLOSING or text[-1] not in ")]}":
        return None
    depth, start, out = 0, 1, []
    for i, c in enumerate(text):
        depth += (c in _CLOSING) - (c in ")]}")
        if depth == 0 and i < len(text) - 1:
            return None
        if (c == "," and depth == 1) or i == len(text) - 1:
            out.append(text[start:i])
            start = i + 1
    return [text[0] + text[-1], *out] if len(out) > 1 else None


def same_value(a: str | None, b: str | None, percent: bool = True) -> bool:
    """Equal as texts after the clean-up, as numbers, as expressions at some points, or member by member.

    ``percent``: the truth b may be meant as a percentage or as a share. Lists
    and intervals have the same brackets and equal members in order.
    """
    if a is None or b is None:
        return a is b
    if equivalent(a, b):
        return True
    x, y = plain(a), plain(b)
    one, two = members(x), members(y)
    if one is not None or two is not None:
        return one is not None and two is not None and len(one) == len(two) and one[0] == two[0] and all(same_value(p, q, percent) for p, q in zip(one[1:], two[1:], strict=True))
    try:
        if not re.search(r"[a-zA-Z]", re.sub("sqrt|pi", "", x + y)):
            u, v = Formula(x, 0.0).value(), Formula(y, 0.0).value()
            return any(close(u, w) for w in ([v, v / 100, v * 100] if percent else [v]))
        return all(close(Formula(x, p).value(), Formula(y, p).value()) for p in POINTS)
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return False


def value_score(x: Column, truth: Column) -> Column:
    """1.0 if the last boxed answer, or the whole text without a box, has the truth's value; else 0.0."""

    @F.pandas_udf("double")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        given = [None if a is None else unbox(last_boxed(a)) or a for a in s]
        return pd.Series([float(a is not None and same_value(a, b)) for a, b in zip(given, t, strict=True)])

    return run(x, truth)
