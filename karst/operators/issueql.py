"""Searches of issue trackers (JQL) and wikis (CQL) as Columns: conditions on fields, AND, OR, NOT, and ORDER BY.

A condition is a field, an operator (=, !=, <, <=, >, >=, ~, !~, IN, NOT IN, IS EMPTY, IS NOT EMPTY) and a value: a word, a number,
a quoted string, a list, now(), startOfDay(), currentUser(), or a time relative to now as -7d. What a field isn't (a negation)
holds only where it has a value, as in these languages. Fields that aren't given, other functions and history operators are refused.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compilers import Refused, _split, _words

_TOKENS = re.compile(r"""\s*(?:(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<mark><=|>=|!=|!~|[=<>~(),])|(?P<word>[^\s"'=<>!~(),]+))""")
_RELATIVE = re.compile(r"-(\d+)([mhdw])")
_UNITS = {"m": timedelta(minutes=1), "h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1)}


@dataclass(frozen=True)
class Field:
    """kind: value (compared in any case if it is text), text (looked for by words), list (an array) or time."""

    column: Column
    kind: str = "value"


class _Query:
    def __init__(self, text: str, fields: Mapping[str, Field], now: datetime | None, user: str | None):
        self.fields, self.now, self.user = {k.lower(): v for k, v in fields.items()}, now, user
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKENS.match(text, at)
            if m is None:
                raise Refused(f"can't be read from here: {text[at : at + 40]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, re.sub(r"\\(.)", r"\1", m[kind][1:-1]) if kind == "string" else m[kind]))
            at = m.end()
        self.at = 0

    def look(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        """Takes keywords if they stand here, all of them."""
        here = [t.upper() if k == "word" else "" for k, t in self.tokens[self.at : self.at + len(words)]]
        if here != list(words):
            return False
        self.at += len(words)
        return True

    def need(self, mark: str) -> None:
        if self.take() != ("mark", mark):
            raise Refused(f"{mark!r} is due")

    def field(self) -> Field:
        kind, name = self.take()
        if kind == "mark" or name.lower() not in self.fields:
            raise Refused(f"no field {name!r}")
        return self.fields[name.lower()]

    def either(self) -> Column:
        out = self.both()
        while self.word("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.word("AND"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.word("NOT"):
            return ~self.one()
        if self.look() == ("mark", "("):
            self.take()
            out = self.either()
            self.need(")")
            return out
        f = self.field()
        if self.word("IS", "NOT"):
            return ~self.empty(f)
        if self.word("IS"):
            return self.empty(f)
        if self.word("NOT", "IN"):
            return ~self.among(f)
        if self.word("IN"):
            return self.among(f)
        kind, op = self.take()
        if kind != "mark" or op in "(),":
            raise Refused(f"an operator is due before {op!r}")
        if op in ("~", "!~"):
            found = self.contains(f)
            return found if op == "~" else ~found
        if op in ("=", "!="):
            if self.look()[1].upper() in ("EMPTY", "NULL") and self.look()[0] == "word":
                return self.empty(f) if op == "=" else ~self.empty(f)
            same = self.equal(f, self.value(f))
            return same if op == "=" else ~same
        if f.kind in ("text", "list"):
            raise Refused(f"{op} needs a field with an order")
        x = self.value(f)
        return {"<": f.column < x, "<=": f.column <= x, ">": f.column > x, ">=": f.column >= x}[op]

    def empty(self, f: Field) -> Column:
        kind, word = self.take()
        if kind != "word" or word.upper() not in ("EMPTY", "NULL"):
            raise Refused("EMPTY is due")
        none = F.coalesce(F.size(f.column) == 0, F.lit(True)) if f.kind == "list" else f.column.isNull()
        return none | F.coalesce(f.column.cast("string") == "", F.lit(False)) if f.kind in ("text", "value") else none

    def equal(self, f: Field, x: Column) -> Column:
        if f.kind == "list":
            return F.when(F.size(f.column) > 0, F.exists(f.column, lambda e: F.lower(e.cast("string")) == F.lower(x.cast("string"))))
        return f.column == x if f.kind == "time" else F.lower(f.column.cast("string")) == F.lower(x.cast("string"))

    def among(self, f: Field) -> Column:
        self.need("(")
        found = [self.equal(f, self.value(f))]
        while self.look() == ("mark", ","):
            self.take()
            found.append(self.equal(f, self.value(f)))
        self.need(")")
        return reduce(Column.__or__, found)

    def contains(self, f: Field) -> Column:
        kind, text = self.take()
        if kind not in ("string", "word") or f.kind == "time":
            raise Refused("~ needs a text and a field that has one")
        own = F.array_join(f.column, " ") if f.kind == "list" else f.column
        phrase = re.fullmatch(r'\s*"(.*)"\s*', text, re.DOTALL)
        words = _split(phrase[1] if phrase else text)
        return _words(own, words, phrase=bool(phrase)) if words else F.lit(False)

    def value(self, f: Field) -> Column:
        kind, text = self.take()
        if kind not in ("string", "word"):
            raise Refused(f"a value is due before {text!r}")
        if kind == "word" and self.look() == ("mark", "("):
            self.need("(")
            self.need(")")
            return self.called(text)
        if f.kind != "time":
            return F.lit(text) if kind == "string" or not re.fullmatch(r"-?\d+(\.\d+)?", text) else F.lit(float(text) if "." in text else int(text))
        if m := _RELATIVE.fullmatch(text):
            return self.time(self.moment() - int(m[1]) * _UNITS[m[2]])
        try:
            at = datetime.fromisoformat(text.replace("/", "-"))
        except ValueError:
            raise Refused(f"no time: {text!r}") from None
        return self.time(at if at.tzinfo else at.replace(tzinfo=UTC))

    def moment(self) -> datetime:
        if self.now is None:
            raise Refused("what time it is was not given")
        return self.now if self.now.tzinfo else self.now.replace(tzinfo=UTC)

    def time(self, at: datetime) -> Column:
        return F.timestamp_micros(F.lit(round(at.timestamp() * 1_000_000)))

    def called(self, name: str) -> Column:
        if name.lower() == "now":
            return self.time(self.moment())
        if name.lower() == "startofday":
            return self.time(self.moment().astimezone(UTC).replace(hour=0, minute=0, second=0, microsecond=0))
        if name.lower() == "currentuser" and self.user is not None:
            return F.lit(self.user)
        raise Refused(f"no function {name}")

    def order(self) -> list[Column]:
        out = []
        while True:
            c = self.field().column
            down = self.word("DESC")
            if not down:
                self.word("ASC")
            out.append(c.desc() if down else c.asc())
            if self.look() != ("mark", ","):
                return out
            self.take()


def searched_by(rows: DataFrame, query: str, fields: Mapping[str, Field], key: str, limit: int, offset: int = 0, now: datetime | None = None, user: str | None = None) -> DataFrame:
    """A page of the rows that a query finds, in its order, then by key. An empty condition finds all."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise Refused("a page has 1 to 1,000 rows")
    q = _Query(query, fields, now, user)
    if q.look()[0] != "end" and [t.upper() for _, t in q.tokens[:2]] != ["ORDER", "BY"]:
        rows = rows.filter(F.coalesce(q.either(), F.lit(False)))
    order = q.order() if q.word("ORDER", "BY") else []
    if q.look()[0] != "end":
        raise Refused(f"too much: {q.look()[1]!r}")
    page = rows.orderBy(*order, key)
    return (page.offset(offset) if offset else page).limit(limit)
