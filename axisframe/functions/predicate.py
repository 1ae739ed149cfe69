"""The row-selection language: text in, one Catalyst boolean column out.

``a > 1 and not (b in (x, "y z") or c == nan)``: ``or`` binds weaker than ``and``, that weaker than
``not``. Logic is two-valued: a missing entry equals nothing but ``nan``, so ``!=`` and ``not in``
keep it; a missing text entry reads as the empty text. Numbers compare at the column's type. Text is
parsed as a number by the ordering operators, and what cannot be parsed does not match. A value of the
wrong kind is refused when the expression is bound, before any data is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS = ("==", "!=", "<=", ">=", "<", ">")
WORDS = frozenset(("and", "or", "not", "in"))
_STOP = frozenset(" \t\r\n()=!<>,\"'")
_WHOLE = re.compile(r"[+-]?[0-9]+")
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?|[+-]?(?:inf|infinity|nan)", re.I)
#: Text that counts as a number in ordering comparisons, for the JVM's regular expressions.
NUMBER_TEXT = r"(?i)^\s*[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity)\s*$"
_BOUNDS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


class PredicateError(ValueError):
    """An expression that cannot be read, names an unknown column or compares the wrong kinds."""


@dataclass(frozen=True)
class Lexeme:
    """A piece of an expression: its kind (word, value, sign) and its text; quoted values are always values."""

    kind: str
    text: str


def lexemes(source: str) -> list[Lexeme]:
    """Cut an expression into pieces; an unfinished quote or a stray sign is refused with its place."""
    out, at = [], 0
    while at < len(source):
        c = source[at]
        if c.isspace():
            at += 1
        elif c in "(),":
            out.append(Lexeme("sign", c))
            at += 1
        elif c in "\"'":
            end = source.find(c, at + 1)
            if end < 0:
                raise PredicateError(f"the quote at character {at + 1} is not closed")
            out.append(Lexeme("value", source[at + 1 : end]))
            at = end + 1
        elif sign := next((s for s in COMPARISONS if source.startswith(s, at)), None):
            out.append(Lexeme("sign", sign))
            at += len(sign)
        elif c in _STOP:
            raise PredicateError(f"{c!r} at character {at + 1} is no operator; use one of {' '.join(COMPARISONS)}")
        else:
            end = at
            # A quote inside a bare word belongs to the word, as in O'Brien.
            while end < len(source) and (source[end] not in _STOP or end > at and source[end] in "\"'"):
                end += 1
            word = source[at:end]
            out.append(Lexeme("word" if word.lower() in WORDS else "value", word))
            at = end
    return out


@dataclass(frozen=True)
class Comparison:
    column: str
    sign: str
    value: str


@dataclass(frozen=True)
class Member:
    column: str
    values: tuple[str, ...]
    negated: bool


@dataclass(frozen=True)
class Not:
    term: object


@dataclass(frozen=True)
class Both:
    terms: tuple


@dataclass(frozen=True)
class Either:
    terms: tuple


class _Reader:
    def __init__(self, source: str):
        self.rest = lexemes(source)[::-1]

    def keyword(self, word: str) -> bool:
        if self.rest and self.rest[-1].kind == "word" and self.rest[-1].text.lower() == word:
            self.rest.pop()
            return True
        return False

    def sign(self, text: str) -> bool:
        if self.rest and self.rest[-1] == Lexeme("sign", text):
            self.rest.pop()
            return True
        return False

    def chain(self, word: str, part, kind):
        terms = [part()]
        while self.keyword(word):
            terms.append(part())
        return terms[0] if len(terms) == 1 else kind(tuple(terms))

    def either(self):
        return self.chain("or", self.both, Either)

    def both(self):
        return self.chain("and", self.term, Both)

    def term(self):
        if self.keyword("not"):
            return Not(self.term())
        if self.sign("("):
            inner = self.either()
            if not self.sign(")"):
                raise PredicateError("a parenthesis is not closed")
            return inner
        column = self.value("a column name", words=False)
        negated = self.keyword("not")
        if self.keyword("in"):
            return Member(column, self.options(), negated)
        if negated or not self.rest or self.rest[-1].kind != "sign" or self.rest[-1].text not in COMPARISONS:
            raise PredicateError(f"an operator should follow {column!r}: {' '.join(COMPARISONS)}, in or not in")
        return Comparison(column, self.rest.pop().text, self.value("a value"))

    def value(self, what: str, words: bool = True) -> str:
        if self.rest and (self.rest[-1].kind == "value" or words and self.rest[-1].kind == "word"):
            return self.rest.pop().text
        raise PredicateError(f"{what} should come " + (f"before {self.rest[-1].text!r}" if self.rest else "at the end"))

    def options(self) -> tuple[str, ...]:
        if not self.sign("("):
            found = [self.value("a value")]
            while self.sign(","):
                found.append(self.value("a value"))
            return tuple(dict.fromkeys(found))
        found = [self.value("a value")]
        while not self.sign(")"):
            self.sign(",")
            if not self.rest:
                raise PredicateError("a list is not closed")
            found.append(self.value("a value"))
        return tuple(dict.fromkeys(found))


def parse(source: str):
    """The tree of an expression."""
    reader = _Reader(source)
    if not reader.rest:
        raise PredicateError("the expression is empty")
    tree = reader.either()
    if reader.rest:
        raise PredicateError(f"nothing should follow before {reader.rest[-1].text!r}")
    return tree


def columns(tree) -> list[str]:
    """Names that a tree mentions, in order."""
    if isinstance(tree, Comparison | Member):
        return [tree.column]
    parts = [tree.term] if isinstance(tree, Not) else tree.terms
    return list(dict.fromkeys(c for t in parts for c in columns(t)))


def number(text: str) -> int | float | None:
    """``text`` as a whole number or a decimal, or None; underscores and the like make no number."""
    text = text.strip()
    if _WHOLE.fullmatch(text):
        return int(text)
    return float(text) if _DECIMAL.fullmatch(text) else None


def boolean(text: str) -> bool | None:
    return {"true": True, "1": True, "false": False, "0": False}.get(text.strip().lower())


def is_nan(text: str) -> bool:
    return text.strip().lower().lstrip("+-") == "nan" and len(text.strip()) <= 4


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.StringType):
        return "text"
    raise PredicateError(f"a column of type {data_type.simpleString()} cannot be compared")


def missing(c: Column, data_type: T.DataType) -> Column:
    """Whether an entry is missing: null, or NaN in a column of floats."""
    gone = c.isNull()
    return gone | F.isnan(c) if isinstance(data_type, T.FloatType | T.DoubleType) else gone


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _against(c: Column, data_type: T.DataType, value: int | float) -> tuple[Column, Column] | None:
    """Both sides of a numeric comparison at the column's type; None if the value lies outside every number of it."""
    if isinstance(data_type, T.FloatType | T.DoubleType):
        try:
            value = float(value)
        except OverflowError:
            value = float("inf") if value > 0 else float("-inf")
        return c, F.lit(value).cast(data_type)
    if isinstance(value, int):
        if type(data_type) in _BOUNDS:
            if not -(1 << _BOUNDS[type(data_type)]) <= value < 1 << _BOUNDS[type(data_type)]:
                return None
            return c, F.lit(value).cast(data_type)
        return c.cast("decimal(38,0)"), F.lit(str(value)).cast("decimal(38,0)") if abs(value) < 10**38 else F.lit(None)
    return c.cast("double"), F.lit(float(value))


def _equal(c: Column, data_type: T.DataType, name: str, text: str) -> Column:
    kind = kind_of(data_type)
    if kind == "text":
        return F.coalesce(c, F.lit("")) == F.lit(text)
    if is_nan(text):
        return missing(c, data_type)
    if kind == "boolean":
        value = boolean(text)
        if value is None:
            raise PredicateError(f"column {name!r} is true or false, so it cannot equal {text!r}")
        return _sure(c == F.lit(value))
    value = number(text)
    if value is None:
        raise PredicateError(f"column {name!r} holds numbers, so it cannot equal {text!r}")
    sides = _against(c, data_type, value)
    return F.lit(False) if sides is None else _sure(sides[0] == sides[1]) & ~missing(c, data_type)


def _ordered(c: Column, data_type: T.DataType, sign: str, text: str) -> Column:
    value = number(text)
    if value is None:
        raise PredicateError(f"{sign} needs a number, not {text!r}")
    apply = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[sign]
    kind = kind_of(data_type)
    if value != value:
        return F.lit(False)
    if kind == "text":
        as_number = F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast("double"))
        return _sure(apply(as_number, F.lit(float(value))))
    if kind == "boolean":
        return _sure(apply(c.cast("int").cast("double"), F.lit(float(value))))
    sides = _against(c, data_type, value)
    if sides is None:
        # Beyond the column's range every number is below (or above) the value.
        return _sure(c.isNotNull() & F.lit((value > 0) == (sign in ("<", "<="))))
    return _sure(apply(*sides)) & ~missing(c, data_type)


def to_column(tree, schema: T.StructType) -> Column:
    """The boolean column of a tree over a schema; it is never null."""
    types = {f.name: f.dataType for f in schema.fields}
    unknown = [c for c in columns(tree) if c not in types]
    if unknown:
        raise PredicateError(f"no column {unknown[0]!r}; there are {', '.join(sorted(types))}")

    def build(node) -> Column:
        if isinstance(node, Not):
            return ~build(node.term)
        if isinstance(node, Both | Either):
            out = build(node.terms[0])
            for t in node.terms[1:]:
                out = out & build(t) if isinstance(node, Both) else out | build(t)
            return out
        data_type = types[node.column]
        c = F.col("`" + node.column.replace("`", "``") + "`")
        if isinstance(node, Member):
            if kind_of(data_type) == "text":
                hit = F.coalesce(c, F.lit("")).isin(*node.values)
            else:
                hit = _equal(c, data_type, node.column, node.values[0])
                for v in node.values[1:]:
                    hit = hit | _equal(c, data_type, node.column, v)
            return ~hit if node.negated else hit
        if node.sign in ("==", "!="):
            hit = _equal(c, data_type, node.column, node.value)
            return ~hit if node.sign == "!=" else hit
        return _ordered(c, data_type, node.sign, node.value)

    return build(tree)


def where(frame: DataFrame, expression: str) -> DataFrame:
    """Rows of ``frame`` that an expression selects."""
    return frame.where(to_column(parse(expression), frame.schema))
