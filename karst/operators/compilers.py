"""Query strings and search bodies as Columns and DataFrames: what they can't say here is refused, never guessed.

Each has a documented part of its language. Text matching is on whole words in any case, as in an analysed field.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import glob_regex


class Refused(ValueError):
    """A construct that is not permitted."""


def _words(field: Column, words: Sequence[str], phrase: bool = True) -> Column:
    """Whether a text has these words, one after the other or anywhere."""
    text = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(field.cast("string")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))
    if phrase:
        return text.contains(f" {' '.join(words)} ")
    return reduce(Column.__and__, [text.contains(f" {w} ") for w in words])


def _split(value: str) -> list[str]:
    return re.findall(r"[^\W_]+", value.lower())


def _any(columns: Sequence[Column]) -> Column:
    return reduce(Column.__or__, columns)


# --------------------------------------------------------------------------- query strings

_TOKEN = re.compile(
    r"""\s*(?:(?P<mark>[()])|(?P<word>AND|OR|NOT|&&|\|\|)(?=[\s()]|$)|(?P<sign>[+-](?=\S)|!)
    |(?:(?P<field>[\w.@]+):)?(?:"(?P<phrase>[^"]*)"|(?P<open>[\[{])\s*(?P<low>[^\s\]}]+)\s+TO\s+(?P<high>[^\s\]}]+)\s*(?P<close>[\]}])
    |(?P<than>[<>]=?)(?P<bound>[^\s()]+)|(?P<term>[^\s()":]+)))""",
    re.VERBOSE,
)


def query_string(query: str, columns: Mapping[str, Column], default: Sequence[str]) -> Column:
    """A query string as a condition: field:value, "phrases", * and ? inside words, ranges [a TO b], {a TO b} and >=a, AND,
    OR, NOT, + and -, parentheses; words beside each other are alternatives, as is the language's default.

    Words without a field are looked for in the fields `default`. Wildcards at a word's beginning, unknown fields, regular
    expressions, fuzziness, proximity and boosts are refused.
    """
    tokens, at = [], 0
    while at < len(query.rstrip()):
        m = _TOKEN.match(query, at)
        if m is None:
            raise Refused(f"can't be read from here: {query[at:]!r}")
        tokens.append(m.groupdict())
        at = m.end()
    place = 0

    def look() -> dict:
        return tokens[place] if place < len(tokens) else {}

    def take() -> dict:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def clause(t: dict) -> Column:
        names = [t["field"]] if t["field"] else list(default)
        for name in names:
            if name not in columns:
                raise Refused(f"no field {name}")
        own = [columns[n] for n in names]
        if t["phrase"] is not None:
            words = _split(t["phrase"])
            return _any([_words(c, words) if words else F.lit(False) for c in own])
        if t["open"] or t["than"]:
            if not t["field"]:
                raise Refused("a range without a field")
            sides = [(t["open"] == "[", True, t["low"]), (t["close"] == "]", False, t["high"])] if t["open"] else [("=" in t["than"], t["than"][0] == ">", t["bound"])]
            out = F.lit(True)
            for closed, low, bound in sides:
                if bound != "*":
                    x, b = own[0], F.lit(bound)
                    out = out & ((x >= b if closed else x > b) if low else (x <= b if closed else x < b))
            return out
        term = t["term"]
        if term[0] in "*?":
            raise Refused("a wildcard at the beginning")
        if re.search(r"[/~^\\]", term):
            raise Refused(f"not supported: {term}")
        if re.search(r"[*?]", term):
            return _any([F.exists(F.split(F.lower(c.cast("string")), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(glob_regex(term.lower()))) for c in own])
        words = _split(term)
        return _any([_words(c, words) if words else F.lit(False) for c in own])

    def unary() -> Column:
        t = take() if look() else None
        if t is None:
            raise Refused("the query ends too soon")
        if t["word"] == "NOT" or t["sign"] in ("-", "!"):
            return ~F.coalesce(unary(), F.lit(False))
        if t["sign"] == "+":
            return unary()
        if t["mark"] == "(":
            inner = either()
            if take()["mark"] != ")" if look() else True:
                raise Refused("a parenthesis is not closed")
            return inner
        if t["mark"] or t["word"]:
            raise Refused("an operator where a term is due")
        return clause(t)

    def both() -> Column:
        out = unary()
        while look().get("word") in ("AND", "&&"):
            take()
            out = out & unary()
        return out

    def either() -> Column:
        """Alternatives; signed ones must (+) or must not (-) hold beside them."""
        needed, others, required = [], [], False
        while look() and look()["mark"] != ")":
            if look().get("word") in ("OR", "||"):
                take()
            signed = look().get("sign") in ("+", "-", "!") or look().get("word") == "NOT"
            required |= look().get("sign") == "+"
            (needed if signed else others).append(both())
        if not needed and not others:
            raise Refused("an empty query")
        # what is optional counts only where nothing is required beside it
        return reduce(Column.__and__, needed + ([] if required or not others else [_any(others)]))

    out = either()
    if place < len(tokens):
        raise Refused("a parenthesis too many")
    return F.coalesce(out, F.lit(False))


# --------------------------------------------------------------------------- search bodies

#: What a search body may have at its top.
TOP = ("query", "sort", "_source", "size", "from")


def search_body(rows: DataFrame, body: Mapping, columns: Mapping[str, Column], key: str, limit: int = 20, most: int = 1000) -> DataFrame:
    """Rows that a search body asks for: query (bool, term, terms, match, match_phrase, range, exists, ids, prefix, wildcard,
    match_all), sort, _source, from and size.

    What isn't named here is refused wherever it stands: clauses are known by their place, and values are plain ones, so
    scripts, lookups and their like have no place to be. A size beyond `limit` is refused, not lowered.
    """
    unknown = [name for name in body if name not in TOP]
    if unknown:
        raise Refused(f"not permitted: {unknown[0]}")
    first, size = body.get("from", 0), body.get("size", limit)
    if not all(isinstance(x, int) for x in (first, size)) or not 0 <= first or not 0 <= size <= limit or first + size > most:
        raise Refused(f"a size is {limit} at most, and from and size together {most}")

    def column(name: str) -> Column:
        if name not in columns:
            raise Refused(f"no field {name}")
        return columns[name]

    def plain(x):
        if isinstance(x, Mapping | list | tuple):
            raise Refused(f"not permitted: {next(iter(x), 'nothing')}")
        return x

    def told(x, *names: str) -> Mapping:
        if not isinstance(x, Mapping) or not {*x} <= {*names}:
            raise Refused(f"not permitted: {next((n for n in x if n not in names), x) if isinstance(x, Mapping) else x}")
        return x

    def listed(x) -> list:
        return list(x) if isinstance(x, list | tuple) else [x]

    def condition(node: Mapping) -> Column:
        if not isinstance(node, Mapping) or len(node) != 1:
            raise Refused("a clause has one kind")
        kind, spec = next(iter(node.items()))
        if kind == "match_all":
            told(spec)
            return F.lit(True)
        if kind == "ids":
            return F.col(key).isin([plain(x) for x in listed(told(spec, "values").get("values", []))])
        if kind == "exists":
            return column(plain(told(spec, "field").get("field"))).isNotNull()
        if kind == "bool":
            told(spec, "must", "filter", "should", "must_not", "minimum_should_match")
            must = [condition(x) for part in ("must", "filter") for x in listed(spec.get(part, []))]
            should = [condition(x) for x in listed(spec.get("should", []))]
            never = [~condition(x) for x in listed(spec.get("must_not", []))]
            least = int(plain(spec.get("minimum_should_match", 0 if must else bool(should))))
            if should and least:
                must.append(sum((F.when(c, 1).otherwise(0) for c in should), F.lit(0)) >= least)
            return reduce(Column.__and__, must + never, F.lit(True))
        if kind not in ("term", "terms", "match", "match_phrase", "range", "prefix", "wildcard") or not isinstance(spec, Mapping) or len(spec) != 1:
            raise Refused(f"not permitted: {kind}")
        name, value = next(iter(spec.items()))
        c = column(name)
        if kind == "terms":
            return c.isin([plain(x) for x in value] if isinstance(value, list | tuple) else [plain(value)])
        if kind == "range":
            ops = {"gte": Column.__ge__, "gt": Column.__gt__, "lte": Column.__le__, "lt": Column.__lt__}
            return reduce(Column.__and__, [ops[op](c, F.lit(plain(x))) for op, x in told(value, *ops).items()], F.lit(True))
        asked = plain(told(value, "value", "query", "operator").get("value", value.get("query")) if isinstance(value, Mapping) else value)
        if kind == "term":
            return c == F.lit(asked)
        if kind == "prefix":
            return c.startswith(asked)
        if kind == "wildcard":
            return c.rlike(glob_regex(asked))
        words = _split(str(asked))
        if not words:
            return F.lit(False)
        if kind == "match_phrase":
            return _words(c, words)
        every = isinstance(value, Mapping) and str(value.get("operator", "or")).lower() == "and"
        return _words(c, words, phrase=False) if every else _any([_words(c, [w]) for w in words])

    found = rows.filter(F.coalesce(condition(body.get("query", {"match_all": {}})), F.lit(False)))
    order = []
    for s in listed(body.get("sort", [])):
        name, way = next(iter(s.items())) if isinstance(s, Mapping) else (s, "asc")
        way = plain(told(way, "order").get("order", "asc") if isinstance(way, Mapping) else way)
        order.append(column(name).desc() if way == "desc" else column(name).asc())
    found = found.orderBy(*order, key).offset(first).limit(size)
    shown = body.get("_source")
    return found if shown is None else found.select(*dict.fromkeys([key, *map(plain, listed(shown))]))
