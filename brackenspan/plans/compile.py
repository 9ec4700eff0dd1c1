"""Compiles a query tree to one DataFrame: a predicate, then the shaping its ``f:`` functions and parameters ask for.

Comparisons stay bare where a null counts as false anyway, so scans can take them; only what stands under a negation is
coalesced. A field with a normalised column beside it (``sources.ingest.normalised``) is compared there, without a
function around it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackenspan.functions import content, geo, geometry
from brackenspan.functions.types import NORMAL, date, date_of, fold, fold_text, in_cidr, is_time, literal_date, time_literal, unit_end
from brackenspan.operators import shaping
from brackenspan.plans import jexl, lucene
from brackenspan.plans.ast import ANY_FIELD, And, Arith, Call, Compare, Constant, Method, Name, Not, Or, QuerySyntaxError
from brackenspan.plans.parameters import Parameters

#: Ending of the column that holds a field's normal form.
NORMAL_SUFFIX = "__norm"


@dataclass
class Model:
    """Field types (``text`` where not named), aliases that stand for several fields, fields searched unfielded, and how to take values that a type can't read."""

    types: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    searched: tuple[str, ...] = ()
    lenient: frozenset = frozenset()
    strict: frozenset = frozenset()


_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
_OPTIONS = re.compile(r"^(rename|noExpansion|options|lenient|strict|limit_fields|excerpt_fields|summary|(most_recent_)?unique(_by_\w+)?|groupby(_\w+)?|sum|min|max|count|average)$")
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "%": F.try_mod}
#: Arguments that carry no search term.
_OFFSETS = {"termOffsetMap", "TERM_OFFSET_MAP"}


def matched(v: Column, regex, folded: bool = True) -> Column:
    """Whether the regex matches the whole raw value, or the folded one: without case, over line breaks.

    The start is \\A, as ^ would match at the start of any line.
    """
    full = f"(?imsu)\\A(?:{regex})\\z"
    raw = v.cast("string")
    return raw.rlike(full) | fold(raw).rlike(full) if folded else raw.rlike(full)


def _left(group: Column) -> Column:
    """The part of a grouping context before its first dot."""
    return F.split_part(group, F.lit("."), F.lit(1))


def _right(group: Column) -> Column:
    return F.element_at(F.split(group, r"\."), -1)


class Compiler:
    def __init__(self, schema: T.StructType, model: Model):
        self.schema, self.model, self.options, self.fixed = schema, model, [], set()
        self.lenient, self.strict = set(model.lenient), set(model.strict)
        self.negated, self.hits = False, {}

    def fields(self, name: str) -> list[str]:
        """Columns a name stands for; an unknown one stands for none, and ``A||B`` for both."""
        if name == ANY_FIELD:
            return [f for f in (self.model.searched or self.schema.names) if f in self.schema.names and not f.endswith(NORMAL_SUFFIX)]
        out: list[str] = []
        for one in name.split("||"):
            names = self.model.aliases.get(one, (one,)) if one not in self.fixed else (one,)
            out += [n for n in names if n in self.schema.names and n not in out]
        return out

    def element(self, name: str) -> T.DataType:
        """Type of a field's single value."""
        data = self.schema[name].dataType
        data = data.elementType if isinstance(data, T.ArrayType) else data
        return data["value"].dataType if self.grouped(name) else data

    def grouped(self, name: str) -> bool:
        """Whether a field's values are (group, value) structs."""
        data = self.schema[name].dataType
        return isinstance(data, T.ArrayType) and isinstance(data.elementType, T.StructType) and {"group", "value"} <= set(data.elementType.names)

    def kind(self, name: str) -> str:
        data = self.element(name)
        return self.model.types.get(name) or ("number" if isinstance(data, T.NumericType) else "date" if is_time(data) else "text")

    def any_value(self, name: str, test) -> Column:
        """Whether any of a field's values passes; a scalar is tested in place, so scans can push it down."""
        return self.join([self._one(n, test) for n in self.fields(name)], lambda a, b: a | b, False)

    @staticmethod
    def join(parts: list[Column], with_, empty: bool) -> Column:
        out = None
        for p in parts:
            out = p if out is None else with_(out, p)
        return F.lit(empty) if out is None else out

    def present(self, name: str) -> Column:
        one = lambda n: (F.size(n) > 0) & F.col(n).isNotNull() if isinstance(self.schema[n].dataType, T.ArrayType) else F.col(n).isNotNull()
        return self.join([one(n) for n in self.fields(name)], lambda a, b: a | b, False)

    def absent(self, name: str) -> Column:
        one = lambda n: F.coalesce(F.size(n) <= 0, F.lit(True)) if isinstance(self.schema[n].dataType, T.ArrayType) else F.col(n).isNull()
        return self.join([one(n) for n in self.fields(name)], lambda a, b: a & b, True)

    def values(self, name: str) -> Column:
        def one(n: str) -> Column:
            data = self.schema[n].dataType
            if isinstance(data, T.ArrayType):
                plain = F.transform(n, lambda v: v["value"]) if self.grouped(n) else F.col(n)
                return F.coalesce(plain, F.array().cast(T.ArrayType(self.element(n))))
            return F.when(F.col(n).isNotNull(), F.array(n)).otherwise(F.array().cast(T.ArrayType(data)))

        arrays = [one(n) for n in self.fields(name)]
        if not arrays:
            return F.array().cast("array<string>")
        return arrays[0] if len(arrays) == 1 else F.concat(*(a.cast("array<string>") for a in arrays))

    def unreadable(self, n: str, value) -> None:
        if n in self.strict:
            raise QuerySyntaxError(f"{value!r} is no {self.kind(n)}, and {n} is strict")

    def test(self, n: str, op: str, value):
        """A test of one value of a field; None where the type can't read what is asked."""
        kind, data = self.kind(n), self.element(n)
        if op == "=~":
            return lambda v: matched(v, value, folded=kind == "text")
        if kind == "number":
            try:
                want = float(value)
            except (TypeError, ValueError):
                self.unreadable(n, value)
                return (lambda v: _OPS[op](fold(v.cast("string")), F.lit(fold_text(str(value))))) if n in self.lenient else None
            whole = isinstance(data, T.IntegralType) and want.is_integer() and abs(want) < 2**53
            literal = F.lit(int(want)) if whole else F.lit(want)
            return lambda v: _OPS[op](v if isinstance(data, T.NumericType) else NORMAL["number"](v), literal)
        if kind == "date":
            found = literal_date(value)
            if found is None:
                self.unreadable(n, value)
                return (lambda v: _OPS[op](v.cast("string"), F.lit(str(value)))) if n in self.lenient else None
            return lambda v: _OPS[op](date_of(v, data), time_literal(found[0], data if is_time(data) else None))
        if kind == "ip" and ("/" in str(value) or "*" in str(value)):
            return lambda v: in_cidr(v, value)
        if kind == "text":
            return lambda v: _OPS[op](fold(v.cast("string")), F.lit(fold_text(str(value))))
        if kind == "raw":
            return lambda v: _OPS[op](v.cast("string"), F.lit(str(value)))
        return lambda v: _OPS[op](NORMAL[kind](v.cast("string")), NORMAL[kind](F.lit(str(value))))

    def term(self, name: str, op: str, value) -> Column:
        parts = []
        for n in self.fields(name):
            norm = n + NORMAL_SUFFIX
            if norm in self.schema.names and self.kind(n) == "text" and op in _OPS:
                test = lambda v: _OPS[op](v, F.lit(fold_text(str(value))))
                parts.append(self._one(norm, test, n))
            elif test := self.test(n, op, value):
                parts.append(self._one(n, test))
        return self.join(parts, lambda a, b: a | b, False)

    def _one(self, n: str, test, told: str | None = None) -> Column:
        inner = (lambda v: test(v["value"])) if self.grouped(n) else test
        if not self.negated:
            self.hits.setdefault(told or n, []).append(inner if told is None else (lambda v: test(fold(v.cast("string")))))
        return F.exists(F.col(n), lambda v: inner(v)) if isinstance(self.schema[n].dataType, T.ArrayType) else test(F.col(n))

    def unless(self, make) -> Column | None:
        """Not what ``make`` gives; values that pass under an odd number of negations are no hits."""
        self.negated = not self.negated
        inner = make()
        self.negated = not self.negated
        return None if inner is None else ~F.coalesce(inner, F.lit(False))

    def differs(self, name: str, value) -> Column:
        """No value is that; of scalars of a natural type in a form that scans take."""
        names = self.fields(name)
        plain = [n for n in names if not isinstance(self.schema[n].dataType, T.ArrayType) and self.kind(n) in ("number", "date") and n not in self.model.types and n not in self.lenient]
        tests = [self.test(n, "!=", value) for n in plain]
        if len(plain) == len(names) and all(tests):
            return self.join([F.col(n).isNull() | t(F.col(n)) for n, t in zip(plain, tests, strict=True)], lambda a, b: a & b, True)
        return self.unless(lambda: self.term(name, "==", value))

    def predicate(self, node) -> Column | None:
        """The node's column; None for functions that only shape results."""
        if isinstance(node, (And, Or)):
            parts = [p for p in map(self.predicate, node.parts) if p is not None]
            if not parts:
                return None
            return self.join(parts, (lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), True)
        if isinstance(node, Not):
            return self.unless(lambda: self.predicate(node.part))
        if isinstance(node, Constant):
            return F.lit(node.value)
        if isinstance(node, Compare):
            return self.compare(node)
        if isinstance(node, Method):
            return self.method(node)
        return self.call(node)

    def arithmetic(self, node: Compare) -> Column:
        """Whether some values of the fields, one of each, compare so, in doubles; what isn't a number or divides by zero doesn't."""
        sides = (node.name, node.value)
        names = sorted(set().union(*({s.name} if isinstance(s, Name) else s.names() if isinstance(s, Arith) else () for s in sides)))

        def result(part, at: dict[str, Column]) -> Column:
            if isinstance(part, Name):
                return at[part.name]
            return _ARITHMETIC[part.op](result(part.left, at), result(part.right, at)) if isinstance(part, Arith) else F.lit(float(part))

        def chosen(k: int, at: dict[str, Column]) -> Column:
            if k == len(names):
                return _OPS[node.op](*(result(s, at) for s in sides))
            return self.join([with_value(k, at, n) for n in self.fields(names[k])], lambda a, b: a | b, False)

        def with_value(k: int, at: dict[str, Column], n: str) -> Column:
            def go(v: Column) -> Column:
                v = v["value"] if self.grouped(n) else v
                v = v if isinstance(self.element(n), T.NumericType) else NORMAL["number"](v.cast("string"))
                return chosen(k + 1, at | {names[k]: v.cast("double")})

            return F.exists(n, go) if isinstance(self.schema[n].dataType, T.ArrayType) else go(F.col(n))

        return chosen(0, {})

    def compare(self, node: Compare) -> Column | None:
        if isinstance(node.name, Arith) or isinstance(node.value, Arith):
            return self.unless(lambda: self.arithmetic(Compare(node.name, "==", node.value))) if node.op == "!=" else self.arithmetic(node)
        if isinstance(node.name, (Call, Method)):
            return self.value_compare(node)
        if node.value is None:
            return self.present(node.name) if node.op == "!=" else self.absent(node.name)
        if isinstance(node.value, Name):
            return self.call(Call("filter", "compare", (Name(node.name), node.op, "ANY", node.value)))
        if isinstance(node.value, tuple):
            inside = lambda: self.join([self.term(node.name, "==", v) for v in node.value], lambda a, b: a | b, False)
            return self.unless(inside) if node.op == "!~" else inside()
        if node.op in ("=^", "=$"):
            mark = re.escape(str(node.value))
            return self.term(node.name, "=~", mark + ".*" if node.op == "=^" else ".*" + mark)
        if node.op == "!=":
            return self.differs(node.name, node.value)
        if node.op == "!~":
            return self.unless(lambda: self.term(node.name, "=~", node.value))
        return self.term(node.name, node.op, node.value)

    def value_compare(self, node: Compare) -> Column:
        """A comparison of what a function returns: a time in milliseconds, or any of a method's values."""
        inner = node.name
        if isinstance(inner, Call) and inner.name in ("getMaxTime", "getMinTime"):
            if isinstance(node.value, (int, float)):
                want = F.lit(int(node.value))
            elif found := literal_date(node.value):
                want = F.unix_millis(F.to_timestamp(F.lit(found[0].isoformat(sep=" "))))
            else:
                raise QuerySyntaxError(f"{node.value!r} is no time")
            return _OPS[node.op](self.time_of(inner), want)
        found = self.group_values(inner) if isinstance(inner, Method) else None
        if found is None:
            raise QuerySyntaxError(f"can't compare what {inner.name} returns")
        want = fold_text(str(node.value))
        return F.exists(found, lambda v: _OPS[node.op](fold(v.cast("string")), F.lit(want)))

    def time_of(self, call: Call) -> Column:
        pick = F.array_max if call.name == "getMaxTime" else F.array_min
        name = self.field_of(call, 0)
        return F.unix_millis(pick(F.transform(self.values(name), lambda v: date(v))))

    def group_values(self, node: Method) -> Column | None:
        """Values of the groups a method names; groups that hold a value; None for other methods."""
        names = self.fields(node.name)
        if node.method not in ("getValuesForGroups", "getValueForGroup", "getGroupsForValue"):
            return None
        if len(names) != 1 or not self.grouped(names[0]):
            raise QuerySyntaxError(f"{node.method} needs one field with grouping contexts, not {node.name}")
        items = F.col(names[0])
        if node.method == "getGroupsForValue":
            want = fold_text(str(node.args[0]))
            return F.transform(F.filter(items, lambda o: fold(o["value"].cast("string")) == F.lit(want)), lambda o: o["group"])
        groups = self.groups(node.args[0]) if isinstance(node.args[0], Call) else F.array(*(F.lit(str(a)) for a in node.args))
        return F.transform(F.filter(items, lambda o: F.array_contains(groups, o["group"])), lambda o: o["value"])

    def groups(self, call: Call) -> Column:
        """Grouping contexts in which all pairs of a call match."""
        if call.name != "getGroupsForMatchesInGroup":
            raise QuerySyntaxError(f"{call.name} returns no groups")
        pairs = self.pairs(call.args)
        held = lambda n, r: F.transform(F.filter(F.col(n), lambda o: matched(o["value"], r)), lambda o: o["group"])
        return self.join([held(n, r) for n, r in pairs], F.array_intersect, True)

    def method(self, node: Method) -> Column:
        if (found := self.group_values(node)) is not None:
            return self.value_compare(Compare(node, node.op, node.value)) if node.op else F.size(found) > 0
        values = self.values(node.name)
        if node.method == "size":
            return _OPS[node.op](F.size(values), F.lit(int(node.value))) if node.op else F.size(values) > 0
        if node.method in ("min", "max"):
            least = (F.array_min if node.method == "min" else F.array_max)(values)
            return _OPS[node.op](least, F.lit(node.value))
        if node.method in ("contains", "lessThan", "greaterThan", "compareWith"):
            if len(node.args) < (2 if node.method == "compareWith" else 1):
                raise QuerySyntaxError(f"{node.method} lacks an argument")
            op, value = {"contains": ("==", node.args[0]), "lessThan": ("<", node.args[0]), "greaterThan": (">", node.args[0])}.get(node.method) or (node.args[1], node.args[0])
            return self.term(node.name, op, value)
        raise QuerySyntaxError(f"no method {node.method}")

    @staticmethod
    def field_of(call: Call, k: int) -> str:
        if len(call.args) <= k:
            raise QuerySyntaxError(f"{call.space}:{call.name} lacks an argument")
        value = call.args[k]
        return value.name if isinstance(value, Name) else str(value)

    def call(self, node: Call) -> Column | None:
        if node.space == "f" and _OPTIONS.match(node.name):
            args = [a.name if isinstance(a, Name) else a for a in node.args]
            listed = [x for a in args for x in str(a).split(",")]
            if node.name == "noExpansion":
                self.fixed.update(listed)
            elif node.name in ("lenient", "strict"):
                getattr(self, node.name).update(listed)
            self.options.append((node.name, args))
            return None
        try:
            out = self.function(node)
        except (IndexError, KeyError, TypeError, ValueError) as wrong:
            if isinstance(wrong, QuerySyntaxError):
                raise
            raise QuerySyntaxError(f"arguments of {node.space}:{node.name}: {wrong}") from wrong
        if out is None:
            raise QuerySyntaxError(f"no function {node.space}:{node.name}")
        return out

    def function(self, node: Call) -> Column | None:
        f = node.name
        if node.space == "content":
            return self.content(f, node.args)
        if node.space == "grouping":
            return self.grouping(f, node.args)
        name = node.args[0].name if node.args and isinstance(node.args[0], Name) else None
        rest = [a.name if isinstance(a, Name) else a for a in node.args[1:]] if name else list(node.args)
        if node.space in ("filter", "f"):
            return self.filter(f, name, rest, node)
        if node.space == "geo":
            if f == "within_bounding_box":
                if len(rest) == 2:
                    return self.any_value(name, lambda v: geo.in_box(v, rest[0], rest[1]))
                lon, lat = self.values(name), self.values(rest[0])
                west, south, east, north = map(float, rest[1:5])
                return F.exists(lon, lambda x: x.try_cast("double").between(west, east)) & F.exists(lat, lambda y: y.try_cast("double").between(south, north))
            if f == "within_circle":
                return self.any_value(name, lambda v: geo.in_circle(v, rest[0], float(rest[1])))
        if node.space == "geowave" and f in geometry.PREDICATES:
            return self.any_value(name, lambda v: geometry.related(v, f, str(rest[0])))
        if node.space == "normalize" and f in NORMAL:
            return self.present(name)
        return None

    def filter(self, f: str, name: str, rest: list, node: Call) -> Column | None:
        if f in ("includeRegex", "matchRegex", "getAllMatches"):
            return self.any_value(name, lambda v: matched(v, rest[0]))
        if f == "excludeRegex":
            return self.unless(lambda: self.any_value(name, lambda v: matched(v, rest[0])))
        if f == "includeText":
            return self.any_value(name, lambda v: v.cast("string") == F.lit(rest[0]))
        if f == "isNull":
            return self.absent(name)
        if f == "isNotNull":
            return self.present(name)
        if f in ("betweenDates", "beforeDate", "afterDate", "betweenLoadDates", "beforeLoadDate", "afterLoadDate"):
            return self.dates(f, name, [str(r) for r in rest])
        if f == "timeFunction":
            if len(rest) < 4:
                raise QuerySyntaxError("timeFunction takes two fields, an operation, a comparison and a goal")
            millis = lambda n, pick: F.unix_millis(date(pick(self.values(n)))).cast("bigint")
            first, second = millis(name, F.array_max), millis(rest[0], F.array_min)
            total = first - second if rest[1] == "-" else first + second
            return _OPS[rest[2]](total, F.lit(int(rest[3])))
        if f in ("getMaxTime", "getMinTime"):
            return self.time_of(node).isNotNull()
        if f == "occurrence":
            op, n = (rest[0], rest[1]) if len(rest) > 1 else ("==", rest[0])
            return _OPS[op](F.size(self.values(name)), F.lit(int(n)))
        if f == "matchesAtLeastCountOf":
            least, name, wanted = node.args[0], node.args[1].name, node.args[2:]
            return F.size(F.filter(F.array(*(F.coalesce(self.term(name, "==", w), F.lit(False)) for w in wanted)), lambda x: x)) >= F.lit(int(least))
        if f == "compare":
            op, mode, other = rest
            left, right = self.values(name), self.values(other)
            every = F.forall if str(mode).upper() == "ALL" else F.exists
            return (F.size(left) > 0) & (F.size(right) > 0) & every(left, lambda a: every(right, lambda b: _OPS[op](a, b)))
        if f == "length":
            return self.any_value(name, lambda v: F.length(v.cast("string")).between(int(rest[0]), int(rest[1])))
        if f == "between":
            low, high = rest[0], rest[1]
            if all(isinstance(r, (int, float)) for r in (low, high)):
                numeric = all(isinstance(self.element(n), T.NumericType) for n in self.fields(name))
                return self.any_value(name, lambda v: (v if numeric else v.try_cast("double")).between(low, high))
            return self.any_value(name, lambda v: fold(v.cast("string")).between(fold_text(str(low)), fold_text(str(high))))
        return None

    def dates(self, f: str, name: str, rest: list[str]) -> Column:
        """Date functions: an optional layout of the field, then dates, then an optional layout of those."""
        at = next((k for k, r in enumerate(rest) if re.match(r"^\d", r)), len(rest))
        layout = rest[0] if at else None
        wanted = 2 if f.startswith("between") else 1
        stamps = [literal_date(r) for r in rest[at : at + wanted]]
        if len(stamps) < wanted or not all(stamps):
            raise QuerySyntaxError(f"filter:{f} takes {wanted} date{'s' * (wanted > 1)}, not {rest}")
        names = self.fields(name)

        def one(n: str) -> Column:
            data = self.element(n)
            like = data if is_time(data) else None
            low, high = time_literal(stamps[0][0], like), time_literal(unit_end(*stamps[-1]) if stamps[-1][1] != "day" or not f.startswith("between") else stamps[-1][0], like)
            if f.startswith("between"):
                return self._one(n, lambda v: date_of(v, data, layout).between(low, high))
            return self._one(n, (lambda v: date_of(v, data, layout) < low) if f.startswith("before") else (lambda v: date_of(v, data, layout) > low))

        return self.join([one(n) for n in names], lambda a, b: a | b, False)

    def content(self, f: str, args: tuple) -> Column:
        """Positions of words: an optional zone, a distance or a least score, the map of offsets (implied), and the terms.

        Without a zone every text field is searched. Scores come from a field ``<zone>_SCORES``, an array beside the words,
        the least the better; without one every word scores 0.
        """
        values = [a for a in args if not (isinstance(a, Name) and a.name in _OFFSETS)]
        numbers = [a for a in values if isinstance(a, (int, float)) and not isinstance(a, bool)]
        zones = [a.name for a in values if isinstance(a, Name)]
        words = [str(a) for a in values if isinstance(a, str)]
        if not zones and any(isinstance(a, Name) and a.name in _OFFSETS for a in args) and isinstance(args[0], str) and isinstance(args[1], (Name, int)) and words and words[0] == args[0]:
            zones, words = [words[0]], words[1:]
        if not words or f not in ("phrase", "adjacent", "within", "scoredPhrase"):
            raise QuerySyntaxError(f"content:{f} takes terms, not {args}")
        distance = int(numbers[0]) if numbers and f == "within" else len(words) - 1
        tests = {"phrase": lambda v: content.phrase(v, words), "adjacent": lambda v: content.within(v, words, len(words) - 1), "within": lambda v: content.within(v, words, distance)}
        parts = []
        for n in (n for z in zones or [ANY_FIELD] for n in self.fields(z)):
            if self.kind(n) != "text":
                continue
            if f == "scoredPhrase":
                scores = F.col(f"{n}_SCORES") if f"{n}_SCORES" in self.schema.names else None
                parts.append(self._one(n, lambda v, s=scores: content.scored_phrase(v.cast("string"), words, s, float(numbers[0]))))
            else:
                parts.append(self._one(n, lambda v: tests[f](v.cast("string"))))
        return self.join(parts, lambda a, b: a | b, False)

    @staticmethod
    def pairs(args: tuple) -> list[tuple[str, str]]:
        """(field, regex) of alternating arguments; a trailing number is the index of the group part."""
        plain = [a.name if isinstance(a, Name) else a for a in args]
        plain = plain[:-1] if len(plain) % 2 and isinstance(plain[-1], int) else plain
        if not plain or len(plain) % 2:
            raise QuerySyntaxError(f"fields and regexes must come in pairs, not {args}")
        return list(zip(plain[0::2], map(str, plain[1::2]), strict=True))

    def grouping(self, f: str, args: tuple) -> Column:
        """Fields are arrays of (group, value) structs; all pairs must match within one group.

        ``matchesInGroup`` compares the right part of grouping contexts with dots in them, ``matchesInGroupLeft`` the left.
        """
        if f in ("matchesInGroup", "matchesInGroupLeft", "getGroupsForMatchesInGroup"):
            pairs = self.pairs(args)
            part = _left if f == "matchesInGroupLeft" else _right
            first, regex = pairs[0]
            same = lambda g, n, r: F.exists(F.col(n), lambda o: (part(o["group"]) == part(g["group"])) & matched(o["value"], r))
            hit = lambda g: self.join([matched(g["value"], regex), *(same(g, n, r) for n, r in pairs[1:])], lambda a, b: a & b, True)
            return F.exists(F.col(first), hit)
        if f == "atomValuesMatch":
            names = [a.name if isinstance(a, Name) else a for a in args]
            same = lambda g, n: F.exists(F.col(n), lambda o: (o["group"] == g["group"]) & (o["value"] == g["value"]))
            return F.exists(F.col(names[0]), lambda g: self.join([same(g, n) for n in names[1:]], lambda a, b: a & b, True))
        raise QuerySyntaxError(f"no function grouping:{f}")

    def hit_terms(self) -> Column:
        """``FIELD:value`` of every value that a positive term of the query hit."""

        def of(n: str, tests: list) -> Column:
            some = lambda v: self.join([F.coalesce(t(v), F.lit(False)) for t in tests], lambda a, b: a | b, False)
            array = isinstance(self.schema[n].dataType, T.ArrayType)
            kept = F.filter(F.coalesce(F.col(n), F.array().cast(self.schema[n].dataType)), some) if array else F.filter(F.array(n), some)
            return F.transform(kept, lambda v: F.concat(F.lit(f"{n}:"), (v["value"] if self.grouped(n) else v).cast("string")))

        lists = [of(n, tests) for n, tests in self.hits.items() if n in self.schema.names]
        return F.array_distinct(F.array_compact(F.concat(*lists))) if lists else F.array().cast("array<string>")


def parsed(text: str, syntax: str = "jexl"):
    if syntax not in ("jexl", "lucene"):
        raise QuerySyntaxError(f"no syntax {syntax!r}")
    return (jexl if syntax == "jexl" else lucene).parse(text)


def query(documents: DataFrame, text: str, syntax: str = "jexl", model: Model | None = None, fields: list[str] | None = None, limits: dict[str, int] | None = None, max_results: int | None = None, parameters: dict[str, str] | None = None) -> DataFrame:
    """The documents a query selects, shaped as its ``f:`` functions and the parameters ask.

    ``parameters`` are per-query options by name (``plans.parameters``), which ``f:options`` may also set. ``fields``
    projects, ``limits`` caps the values of multi-valued fields that no term of the query hit (adding
    ``<F>_ORIGINAL_COUNT``; hits come first and all stay), and ``max_results`` stops after so many documents.
    """
    asked = Parameters(parameters or {})
    tree = parsed(text, asked.syntax or syntax)
    documents = asked.before(documents)
    compiler = Compiler(documents.schema, asked.model(model or Model()))
    # Options may appear anywhere, and some change how terms compile: read them first.
    compiler.predicate(tree)
    for name, args in compiler.options:
        if name == "options":
            asked.update(dict(zip(map(str, args[0::2]), map(str, args[1::2]), strict=True)))
    compiler = Compiler(documents.schema, asked.model(compiler_model(compiler, model or Model())))
    compiler.fixed |= asked.fixed()
    compiler.predicate(tree)
    fixed, lenient, strict = compiler.fixed, compiler.lenient, compiler.strict
    compiler = Compiler(documents.schema, asked.model(model or Model()))
    compiler.fixed, compiler.lenient, compiler.strict = fixed, lenient, strict
    where = compiler.predicate(tree)
    out = documents if where is None else documents.where(where)
    if asked.hit_list():
        out = out.withColumn("HIT_TERM", compiler.hit_terms())
    limits = (limits or {}) | asked.limits()
    for name, args in compiler.options:
        if name == "limit_fields":
            limits |= Parameters({"limit.fields": ",".join(map(str, args))}).limits()
    if limits:
        out = shaping.limit_fields(out, limits, compiler.hits, asked.matching_sets())
    out = asked.added(out, documents)
    out = asked.after(shaping.apply(out, compiler.options + asked.options()))
    if fields:
        out = out.select(*fields)
    most = min((n for n in (max_results, asked.max_results()) if n is not None), default=None)
    return out if most is None else out.limit(most)


def compiler_model(compiler: Compiler, model: Model) -> Model:
    return Model(model.types, model.aliases, model.searched, frozenset(compiler.lenient), frozenset(compiler.strict))


def count(documents: DataFrame, text: str, syntax: str = "jexl", model: Model | None = None, parameters: dict[str, str] | None = None) -> DataFrame:
    """One row: how many documents a query selects. Only the fields that its terms name are read."""
    return query(documents, text, syntax, model, parameters=parameters).agg(F.count("*").alias("count"))
