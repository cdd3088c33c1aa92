"""Log queries of piped stages, compiled to Columns and DataFrames.

A query is cut into tokens and read by a grammar of its own; nothing of it reaches Spark's SQL parser. Names must be columns
of the rows so far, functions must be among those listed here, with as many arguments as they take; anything else is
refused. Strings are taken as they are, with \\ before a quote of their own kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compilers import Refused

#: The stages that a log query may have.
STAGES = ("fields", "filter", "stats", "sort", "limit", "parse", "dedup", "display")

_TOKENS = re.compile(
    r"""(?P<space>\s+)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<quoted>`[^`]+`)|(?P<span>\d+(?:ms|s|m|h|d|w)\b)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<name>@?[A-Za-z_][\w.@]*)|(?P<mark>=~|!=|<=|>=|[-+*/%^=<>(),|\[\]])""",
    re.VERBOSE,
)
_PATTERN = re.compile(r"\s*/((?:\\.|[^/\\])*)/", re.DOTALL)

Token = tuple[str, str]


def cut(query: str) -> list[list[Token]]:
    """The stages' tokens. A / opens a pattern behind like and =~ only."""
    out: list[list[Token]] = [[]]
    at = 0
    while at < len(query):
        if out[-1] and out[-1][-1] in (("name", "like"), ("mark", "=~")) and (m := _PATTERN.match(query, at)):
            out[-1].append(("pattern", m[1].replace("\\/", "/")))
        elif m := _TOKENS.match(query, at):
            kind, text = m.lastgroup, m[0]
            if text == "|":
                out.append([])
            elif kind == "string":
                out[-1].append((kind, re.sub(r"\\([\\'\"])", r"\1", text[1:-1])))
            elif kind == "quoted":
                out[-1].append(("column", text[1:-1]))
            elif kind != "space":
                out[-1].append((kind, text.lower() if kind == "name" and text.lower() in _WORDS else text))
        else:
            raise Refused(f"can't be read from here: {query[at : at + 40]!r}")
        at = m.end()
    return out


_WORDS = frozenset({"and", "or", "not", "in", "like", "as", "by", "asc", "desc", *STAGES})

_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}


def _bin(time: Column, span: str) -> Column:
    n = int(re.match(r"\d+", span)[0]) * _SECONDS[span.lstrip("0123456789")]
    if n < 1:
        raise Refused("a bin has a second or more")
    return F.timestamp_seconds(F.floor(F.unix_seconds(time) / F.lit(int(n))) * F.lit(int(n)))


#: Functions of one row: how many arguments they take at least and at most, and what they are.
SCALARS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs), "ceil": (1, 1, F.ceil), "floor": (1, 1, F.floor), "sqrt": (1, 1, F.sqrt), "log": (1, 1, F.log), "greatest": (2, 9, F.greatest), "least": (2, 9, F.least),
    "lower": (1, 1, F.lower), "tolower": (1, 1, F.lower), "upper": (1, 1, F.upper), "toupper": (1, 1, F.upper), "trim": (1, 1, F.trim), "ltrim": (1, 1, F.ltrim), "rtrim": (1, 1, F.rtrim),
    "strlen": (1, 1, F.length), "concat": (1, 99, F.concat), "coalesce": (1, 99, F.coalesce), "strcontains": (2, 2, lambda a, b: F.contains(a, b).cast("int")), "replace": (3, 3, F.replace),
    "substr": (2, 3, lambda x, start, n=None: F.substring(x, start + 1, F.length(x) if n is None else n)), "ispresent": (1, 1, lambda x: x.isNotNull()), "isempty": (1, 1, lambda x: x.isNull() | (x == "")), "isblank": (1, 1, lambda x: x.isNull() | (F.trim(x) == "")),
    "tomillis": (1, 1, F.unix_millis), "frommillis": (1, 1, F.timestamp_millis),
}

#: Functions of a group.
GROUPS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "sum": (1, 1, F.sum), "avg": (1, 1, F.avg), "min": (1, 1, F.min), "max": (1, 1, F.max), "stddev": (1, 1, F.stddev_pop), "median": (1, 1, F.median), "count_distinct": (1, 1, F.count_distinct),
}


class _Reader:
    """Reads one stage's tokens. By precedence: or, and, not, comparisons, sums, products, powers, signs."""

    def __init__(self, tokens: list[Token], columns: Sequence[str]):
        self.tokens, self.at, self.columns = tokens, 0, {c: c for c in columns}

    def look(self) -> Token:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: Token) -> Token | None:
        if not wanted or self.look() in wanted:
            self.at += 1
            return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")
        return None

    def need(self, kind: str, text: str) -> None:
        if not self.take((kind, text)):
            raise Refused(f"{text!r} is due before {self.look()[1]!r}")

    def end(self) -> None:
        if self.look()[0] != "end":
            raise Refused(f"too much: {self.look()[1]!r}")

    def named(self) -> str:
        kind, text = self.take()
        name = text if kind == "column" else text.lstrip("@")
        if kind not in ("name", "column") or name not in self.columns:
            raise Refused(f"no column {text!r}")
        return name

    def column(self) -> Column:
        return F.col("`" + self.named().replace("`", "``") + "`")

    def number(self) -> int:
        kind, text = self.take()
        if kind != "number" or not text.isdigit():
            raise Refused(f"a whole number is due before {text!r}")
        return int(text)

    # ----------------------------------------------------------------- expressions

    def either(self) -> Column:
        out = self.both()
        while self.take(("name", "or")):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.unless()
        while self.take(("name", "and")):
            out = out & self.unless()
        return out

    def unless(self) -> Column:
        return ~self.unless() if self.take(("name", "not")) else self.compared()

    def compared(self) -> Column:
        left = self.sums()
        no = bool(self.take(("name", "not")))
        if self.take(("name", "like"), ("mark", "=~")):
            kind, text = self.take()
            if kind == "pattern":
                re.compile(text)  # a pattern that can't be one is refused here, not in a task
                out = left.rlike(text)
            elif kind == "string":
                out = F.contains(left, F.lit(text))
            else:
                raise Refused("a /pattern/ or a string is due behind like")
            return ~out if no else out
        if self.take(("name", "in")):
            self.need("mark", "[")
            values = [self.sums()]
            while self.take(("mark", ",")):
                values.append(self.sums())
            self.need("mark", "]")
            out = left.isin(*values)
            return ~out if no else out
        if no:
            raise Refused("like or in is due behind not")
        ops = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
        kind, text = self.look()
        if kind == "mark" and text in ops:
            self.take()
            return ops[text](left, self.sums())
        return left

    def sums(self) -> Column:
        out = self.products()
        while t := self.take(("mark", "+"), ("mark", "-")):
            out = out + self.products() if t[1] == "+" else out - self.products()
        return out

    def products(self) -> Column:
        out = self.power()
        while t := self.take(("mark", "*"), ("mark", "/"), ("mark", "%")):
            other = self.power()
            out = out * other if t[1] == "*" else out / F.nullif(other, F.lit(0)) if t[1] == "/" else out % F.nullif(other, F.lit(0))
        return out

    def power(self) -> Column:
        out = self.signed()
        return F.pow(out, self.power()) if self.take(("mark", "^")) else out

    def signed(self) -> Column:
        return -self.signed() if self.take(("mark", "-")) else self.one()

    def one(self) -> Column:
        kind, text = self.look()
        if kind == "number":
            self.take()
            return F.lit(int(text) if text.isdigit() else float(text))
        if kind == "string":
            self.take()
            return F.lit(text)
        if self.take(("mark", "(")):
            out = self.either()
            self.need("mark", ")")
            return out
        if kind == "name" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ("mark", "("):
            return self.called(text.lower())
        if kind not in ("name", "column"):
            raise Refused(f"a value is due before {text!r}")
        return self.column()

    def called(self, name: str) -> Column:
        self.take()
        self.need("mark", "(")
        if name == "bin":
            kind, span = self.take()
            if kind != "span" or "timestamp" not in self.columns:
                raise Refused("bin takes a span as 5m, of the column timestamp")
            out = _bin(F.col("timestamp"), span)
        elif name == "count":
            out = F.count(F.lit(1)) if self.take(("mark", "*")) or self.look() == ("mark", ")") else F.count(self.either())
        elif name in ("pct", "percentile"):
            value = self.either()
            self.need("mark", ",")
            share = self.number()
            if share > 100:
                raise Refused("a percentile is 100 at most")
            out = F.percentile(value, share / 100)
        elif known := {**SCALARS, **GROUPS}.get(name):
            least, most, make = known
            values = [] if self.look() == ("mark", ")") else [self.either()]
            while values and self.take(("mark", ",")):
                values.append(self.either())
            if not least <= len(values) <= most:
                raise Refused(f"{name} takes {least} to {most} arguments")
            out = make(*values)
        else:
            raise Refused(f"no function {name}")
        self.need("mark", ")")
        return out

    def listed(self, stop: tuple[Token, ...] = ()) -> list[Column]:
        """Expressions, each with `as name` or a name made of its own words."""
        out = []
        while True:
            first = self.at
            value = self.either()
            words = [t for _, t in self.tokens[first : self.at]]
            name = re.sub(r"\W+", "_", "".join(words).replace("@", "")).strip("_")
            if self.take(("name", "as")):
                kind, name = self.take()
                name = name.lstrip("@") if kind == "name" else name
                if kind not in ("name", "column"):
                    raise Refused("a name is due behind as")
            out.append(value.alias(name))
            if not self.take(("mark", ",")):
                return out


def _parsed(rows: DataFrame, reader: _Reader) -> DataFrame:
    source = reader.column()
    kind, shape = reader.take()
    if kind != "string" or "*" not in shape:
        raise Refused("parse takes a column and a string with *")
    reader.need("name", "as")
    names = []
    while True:
        kind, name = reader.take()
        if kind not in ("name", "column"):
            raise Refused("names are due behind as")
        names.append(name.lstrip("@"))
        if not reader.take(("mark", ",")):
            break
    if len(names) != shape.count("*"):
        raise Refused(f"{shape.count('*')} names are due, one for each *")
    pattern = "(?s)" + "(.*?)".join(map(re.escape, shape.split("*"))) + ("$" if shape.endswith("*") else "")
    return rows.withColumns({n: F.nullif(F.regexp_extract(source, pattern, i + 1), F.lit("")) for i, n in enumerate(names)})


def log_query(rows: DataFrame, query: str, limit: int = 1000) -> DataFrame:
    """Rows by a log query's stages: fields and display (columns, with names), filter, stats ... by ..., sort, limit, dedup,
    and parse with * as wildcards. Times are in the column timestamp.

    A condition that is null keeps no row. A limit beyond `limit` is refused, not lowered. Division by 0 is null.
    """
    for tokens in cut(query):
        kind, stage = tokens[0] if tokens else ("end", "")
        if kind != "name" or stage not in STAGES:
            raise Refused(f"not permitted: {stage!r}")
        reader = _Reader(tokens[1:], rows.columns)
        try:
            if stage in ("fields", "display"):
                rows = rows.select(*reader.listed())
            elif stage == "filter":
                rows = rows.filter(F.coalesce(reader.either(), F.lit(False)))
            elif stage == "stats":
                what = reader.listed()
                rows = rows.groupBy(*(reader.listed() if reader.take(("name", "by")) else [])).agg(*what)
            elif stage == "sort":
                order = []
                while True:
                    value = reader.either()
                    down = reader.take(("name", "asc"), ("name", "desc"))
                    order.append(value.desc() if down == ("name", "desc") else value.asc())
                    if not reader.take(("mark", ",")):
                        break
                rows = rows.orderBy(*order)
            elif stage == "limit":
                n = reader.number()
                if n > limit:
                    raise Refused(f"a limit is {limit} at most")
                rows = rows.limit(n)
            elif stage == "dedup":
                names = [reader.named()]
                while reader.take(("mark", ",")):
                    names.append(reader.named())
                rows = rows.dropDuplicates(names)
            else:
                rows = _parsed(rows, reader)
        except re.error as e:
            raise Refused(f"not a pattern: {e}") from e
        reader.end()
    return rows
