"""jq filters lowered to Spark expressions over variants.

``lower`` reads a filter and gives a function from a variant column to the array of its
outputs, made of Spark's own higher-order functions, so a filter runs within code generation and
nothing interprets it row by row. A null array is a runtime error of that row.

Filters: ``.``, ``.a``, ``."a"``, ``.["a"]``, ``.[n]``, ``.[]``, ``?``, ``|``, ``,``, ``//``, ``and``, ``or``, comparisons,
``+ - * / %``, ``-x``, literals, ``[f]``, ``{a: f, b}``, ``if then elif else end``, and the functions of ``FUNCTIONS``. Others, such as
definitions, variables, ``reduce`` and ``..``, are refused when the query is built.

Departures: numbers are doubles once they are computed with; the entries of an object come in the order of
their keys; arrays and objects are compared for equality alone, in order comparisons they are an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Filter = Callable[[Column], Column]


class Unsupported(ValueError):
    """The query is no filter of the supported forms."""


TOKEN = re.compile(r'\s*(?:(\.[A-Za-z_]\w*)|("(?:[^"\\]|\\.)*")|(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(//|==|!=|<=|>=|[.\[\]{}()|,:;?+\-*/%<>]))')
MANY = "array<variant>"
LEVELS = (("//",), ("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _null() -> Column:
    return F.parse_json(F.lit("null"))


def _none() -> Column:
    return F.array().cast(MANY)


def _error() -> Column:
    return F.lit(None).cast(MANY)


def _variant(x: Column) -> Column:
    return x.cast("variant")


def _kind(v: Column) -> Column:
    """null, boolean, number, string, array or object."""
    named = lambda k: F.when(k == "VOID", "null").when(k == "BOOLEAN", "boolean").when(k == "STRING", "string").when(k.startswith("ARRAY"), "array").when(k.startswith("OBJECT"), "object").otherwise("number")
    return let(F.schema_of_variant(v), named)


def _by_kind(f: Callable[..., Column], *values: Column) -> Column:
    """``f`` of the kinds of some values. Within lambdas Spark works out each mention of an expression anew, and a kind reads its whole value."""
    if not values:
        return f()
    return let(_kind(values[0]), lambda k: _by_kind(lambda *more: f(k, *more), *values[1:]))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _items(v: Column) -> Column:
    """The elements of an array or the values of an object; an error for others."""
    return _by_kind(lambda k: F.when(k == "array", _as(v, MANY)).when(k == "object", F.map_values(_as(v, "map<string,variant>"))), v)


def _each(outputs: Column, f: Filter) -> Column:
    """What ``f`` gives for each of some outputs, one after the other; an error in one is an error."""
    return F.flatten(F.transform(outputs, f))


def _listed(outputs: Column) -> Column:
    """Some outputs as one, an array."""
    return let(outputs, lambda x: F.when(x.isNotNull(), F.array(F.to_variant_object(x))))


def _truthy(v: Column) -> Column:
    return ~(F.is_variant_null(v) | ((F.schema_of_variant(v) == "BOOLEAN") & ~F.coalesce(_as(v, "boolean"), F.lit(True))))


def _equal(a: Column, b: Column) -> Column:
    same = F.to_json(a) == F.to_json(b)
    return _by_kind(lambda k, m: F.when((k == "number") & (m == "number"), _as(a, "double") == _as(b, "double")).otherwise((k == m) & same), a, b)


def _less(a: Column, b: Column) -> Column:
    """Null before false before true before numbers before strings; null for arrays and objects."""
    rank = lambda v: _by_kind(lambda k: F.when(k == "null", 0).when(k == "boolean", F.when(_truthy(v), 2).otherwise(1)).when(k == "number", 3).when(k == "string", 4), v)
    same = lambda r: F.when(r == 3, _as(a, "double") < _as(b, "double")).when(r == 4, _as(a, "string") < _as(b, "string")).otherwise(F.lit(False))
    return let(rank(a), lambda r: let(rank(b), lambda s: F.when(r != s, r < s).when(r == s, same(r))))


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    """The output of ``a op b``."""
    return _by_kind(lambda k, m: _computed(op, a, b, k, m), a, b)


def _computed(op: str, a: Column, b: Column, k: Column, m: Column) -> Column:
    """The output of ``a op b``, values of the kinds k and m."""
    x, y = _as(a, "double"), _as(b, "double")
    numbers, kinds = (k == "number") & (m == "number"), k == m
    one = lambda c: F.array(_variant(c))
    if op == "+":
        out = F.when(F.is_variant_null(a), F.array(b)).when(F.is_variant_null(b), F.array(a)).when(numbers, one(x + y))
        out = out.when(kinds & (k == "string"), one(F.concat(_as(a, "string"), _as(b, "string"))))
        return out.when(kinds & (k == "array"), F.array(F.to_variant_object(F.concat(_as(a, MANY), _as(b, MANY)))))
    if op == "-":
        left = F.filter(_as(a, MANY), lambda v: ~F.exists(_as(b, MANY), lambda w: _equal(v, w)))
        return F.when(numbers, one(x - y)).when(kinds & (k == "array"), F.array(F.to_variant_object(left)))
    if op == "*":
        return F.when(numbers, one(x * y))
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double")
    if op == "/":
        return F.when(numbers & (y != 0), one(x / F.nullif(y, F.lit(0.0))))
    return F.when(numbers & (whole(y) != 0), one(whole(x) % F.nullif(whole(y), F.lit(0.0))))


def _binary(op: str, left: Filter, right: Filter) -> Filter:
    if op == "//":

        def alternative(v: Column) -> Column:
            return let(F.filter(F.coalesce(left(v), _none()), _truthy), lambda good: F.when(F.size(good) > 0, good).otherwise(right(v)))

        return alternative
    if op in ("and", "or"):
        # The right side is not looked at where the left one decides.
        def both(v: Column, a: Column) -> Column:
            rest = F.transform(right(v), lambda b: _variant(_truthy(b)))
            decided = F.array(_variant(F.lit(op == "or")))
            return F.when(_truthy(a), decided if op == "or" else rest).otherwise(rest if op == "or" else decided)

        return lambda v: _each(left(v), lambda a: both(v, a))
    if op in ("==", "!="):
        test = lambda a, b: F.array(_variant(_equal(a, b) if op == "==" else ~_equal(a, b)))
    elif op in ("<", "<=", ">", ">="):

        def test(a: Column, b: Column) -> Column:
            holds_ = {"<": lambda: _less(a, b), ">": lambda: _less(b, a), "<=": lambda: ~_less(b, a), ">=": lambda: ~_less(a, b)}[op]()
            return let(holds_, lambda holds: F.when(holds.isNotNull(), F.array(_variant(holds))))

    else:
        test = lambda a, b: _arithmetic(op, a, b)
    return lambda v: _each(right(v), lambda b: _each(left(v), lambda a: test(a, b)))


def _literal(text: str) -> Filter:
    return lambda v: F.array(F.parse_json(F.lit(text)))


def _field(name: str) -> Filter:
    def get(v: Column) -> Column:
        if re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII):
            found = F.try_variant_get(v, f"$.{name}", "variant")
        else:  # as a map, so that any name is a name and none a path
            found = F.try_element_at(_as(v, "map<string,variant>"), F.lit(name))
        # What has no such field is an object, null, or an error; only then its kind is looked at.
        return let(found, lambda x: F.when(x.isNotNull(), F.array(x)).when(_kind(v).isin("object", "null"), F.array(_null())))

    return get


def _index(n: int) -> Filter:
    def get(v: Column) -> Column:
        at = let(_as(v, MANY), lambda items: F.get(items, F.lit(n) if n >= 0 else F.size(items) + n))
        return _by_kind(lambda k: F.when(k == "array", F.array(F.coalesce(at, _null()))).when(k == "null", F.array(_null())), v)

    return get


def _length(v: Column) -> Column:
    def size(k: Column) -> Column:
        out = F.when(k == "null", 0.0).when(k == "number", F.abs(_as(v, "double"))).when(k == "string", F.char_length(_as(v, "string")).cast("double"))
        return out.when(k == "array", F.size(_as(v, MANY)).cast("double")).when(k == "object", F.size(_as(v, "map<string,variant>")).cast("double"))

    return let(_by_kind(size, v), lambda n: F.when(n.isNotNull(), F.array(_variant(n))))


def _keys(v: Column) -> Column:
    places = F.transform(F.sequence(F.lit(0), F.size(_as(v, MANY)) - 1), _variant)
    names = F.transform(F.array_sort(F.map_keys(_as(v, "map<string,variant>"))), _variant)
    listed = F.array(F.to_variant_object(F.when(F.size(_as(v, MANY)) > 0, places).otherwise(_none())))
    return _by_kind(lambda k: F.when(k == "object", F.array(F.to_variant_object(names))).when(k == "array", listed), v)


def _add(v: Column) -> Column:
    return F.aggregate(_items(v), F.array(_null()), lambda a, x: _arithmetic("+", F.get(a, F.lit(0)), x))


def _to_entries(v: Column) -> Column:
    in_order = F.array_sort(F.map_entries(_as(v, "map<string,variant>")), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    entries = F.transform(in_order, lambda e: F.to_variant_object(F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return F.when(_kind(v) == "object", F.array(F.to_variant_object(entries)))


def _least(largest: bool) -> Filter:
    def find(v: Column) -> Column:
        better = lambda a, x: ~_less(x, a) if largest else _less(x, a)
        step = lambda a, x: F.when(F.size(a) == 0, F.array(x)).otherwise(let(better(F.get(a, F.lit(0)), x), lambda yes: F.when(yes.isNull(), _error()).when(yes, F.array(x)).otherwise(a)))
        best = F.aggregate(_as(v, MANY), _none(), step)
        return F.when(_kind(v) == "array", F.when(F.size(best) == 0, F.array(_null())).otherwise(best))

    return find


def _of_kind(kind: str, f: Filter) -> Filter:
    return lambda v: F.when(_kind(v) == kind, f(v))


def _number(f: Callable[[Column], Column]) -> Filter:
    return _of_kind("number", lambda v: F.array(_variant(f(_as(v, "double")).cast("double"))))


def _to_number(v: Column) -> Column:
    read = _as(v, "string").try_cast("double")
    return F.when(_kind(v) == "number", F.array(v)).when((_kind(v) == "string") & read.isNotNull(), F.array(_variant(read)))


def _whether(all_: bool) -> Filter:
    return lambda v: F.when(_items(v).isNotNull(), F.array(_variant(F.forall(_items(v), _truthy) if all_ else F.exists(_items(v), _truthy))))


def _has(arg: Filter) -> Filter:
    def test(v: Column, k: Column) -> Column:
        name = F.when((_kind(v) == "object") & (_kind(k) == "string"), F.array_contains(F.map_keys(_as(v, "map<string,variant>")), _as(k, "string")))
        place = F.when((_kind(v) == "array") & (_kind(k) == "number"), (_as(k, "double") >= 0) & (_as(k, "double") < F.size(_as(v, MANY))))
        return F.when(F.coalesce(name, place).isNotNull(), F.array(_variant(F.coalesce(name, place))))

    return lambda v: _each(arg(v), lambda k: test(v, k))


def _strings(test: Callable[[Column, Column], Column]) -> Callable[[Filter], Filter]:
    return lambda arg: lambda v: _each(arg(v), lambda a: F.when((_kind(v) == "string") & (_kind(a) == "string"), F.array(_variant(test(_as(v, "string"), _as(a, "string"))))))


#: Functions by name and number of arguments; each takes filters and gives a filter.
FUNCTIONS: dict[tuple[str, int], Callable[..., Filter]] = {
    ("length", 0): lambda: _length,
    ("keys", 0): lambda: _keys,
    ("add", 0): lambda: _add,
    ("to_entries", 0): lambda: _to_entries,
    ("values", 0): lambda: lambda v: F.when(F.is_variant_null(v), _none()).otherwise(F.array(v)),
    ("empty", 0): lambda: lambda v: _none(),
    ("error", 0): lambda: lambda v: _error(),
    ("not", 0): lambda: lambda v: F.array(_variant(~_truthy(v))),
    ("type", 0): lambda: lambda v: F.array(_variant(_kind(v))),
    ("tostring", 0): lambda: lambda v: F.array(_variant(F.when(_kind(v) == "string", _as(v, "string")).otherwise(F.to_json(v)))),
    ("tonumber", 0): lambda: _to_number,
    ("floor", 0): lambda: _number(F.floor),
    ("ceil", 0): lambda: _number(F.ceil),
    ("abs", 0): lambda: _number(F.abs),
    ("sqrt", 0): lambda: _number(F.sqrt),
    ("min", 0): lambda: _least(False),
    ("max", 0): lambda: _least(True),
    ("first", 0): lambda: _index(0),
    ("last", 0): lambda: _index(-1),
    ("any", 0): lambda: _whether(False),
    ("all", 0): lambda: _whether(True),
    ("first", 1): lambda f: lambda v: F.slice(f(v), 1, 1),
    ("map", 1): lambda f: lambda v: _listed(_each(_items(v), f)),
    ("select", 1): lambda f: lambda v: _each(f(v), lambda b: F.when(_truthy(b), F.array(v)).otherwise(_none())),
    ("has", 1): _has,
    ("startswith", 1): _strings(F.startswith),
    ("endswith", 1): _strings(F.endswith),
    ("contains", 1): _strings(F.contains),
}


class _Reader:
    """A recursive descent over the tokens; each method gives a filter."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        end = len(text.rstrip())
        while at < end:
            m = TOKEN.match(text, at)
            if not m:
                raise Unsupported(text)
            self.tokens.append(m[m.lastindex])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        t = self.peek()
        if t is None or wanted and t not in wanted:
            return None
        self.at += 1
        return t

    def need(self, token: str) -> None:
        if not self.take(token):
            raise Unsupported(self.text)

    def pipe(self) -> Filter:
        left = self.comma()
        if not self.take("|"):
            return left
        right = self.pipe()
        return lambda v: _each(left(v), right)

    def comma(self) -> Filter:
        out = self.binary(0)
        while self.take(","):
            out = (lambda a, b: lambda v: F.concat(a(v), b(v)))(out, self.binary(0))
        return out

    def binary(self, level: int) -> Filter:
        if level == len(LEVELS):
            return self.negated()
        out = self.binary(level + 1)
        while op := self.take(*LEVELS[level]):
            # ``//`` leans to the right, comparisons don't chain, the others lean to the left
            out = _binary(op, out, self.binary(level if op == "//" else level + 1))
            if level == 3 and self.peek() in LEVELS[3]:
                raise Unsupported(self.text)
        return out

    def negated(self) -> Filter:
        if self.take("-"):
            return _binary("-", _literal("0"), self.negated())
        return self.postfix()

    def postfix(self) -> Filter:
        out = self.term()
        while True:
            t = self.peek()
            if t and t[0] == "." and len(t) > 1 and t[1] not in "0123456789":
                self.at += 1
                out = self.then(out, _field(t[1:]))
            elif t == "." and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] in '["':
                self.at += 1
                if self.peek()[0] == '"':
                    out = self.then(out, _field(json.loads(self.take())))
            elif t == "[":
                out = self.then(out, self.bracket())
            elif self.take("?"):
                out = (lambda f: lambda v: F.coalesce(f(v), _none()))(out)
            else:
                return out

    @staticmethod
    def then(first: Filter, second: Filter) -> Filter:
        return lambda v: _each(first(v), second)

    def bracket(self) -> Filter:
        self.need("[")
        if self.take("]"):
            return _items
        sign = -1 if self.take("-") else 1
        t = self.take() or ""
        if t.startswith('"') and sign == 1:
            out = _field(json.loads(t))
        elif t.isdigit():
            out = _index(sign * int(t))
        else:
            raise Unsupported(self.text)
        self.need("]")
        return out

    def term(self) -> Filter:
        t = self.peek()
        if t is None:
            raise Unsupported(self.text)
        if t == "[" or t == "{":
            return self.made()
        self.at += 1
        if t == ".":
            if self.peek() and self.peek()[0] == '"':
                return _field(json.loads(self.take()))
            return lambda v: F.array(v)
        if t[0] == "." and not t[1:2].isdigit():
            return _field(t[1:])
        if t == "(":
            out = self.pipe()
            self.need(")")
            return out
        if t[0] == '"':
            if "\\(" in t:
                raise Unsupported(self.text)
            return _literal(json.dumps(json.loads(t)))
        if t[0].isdigit() or t[0] == ".":
            return _literal(json.dumps(float(t)))
        if t in ("null", "true", "false"):
            return _literal(t)
        if t == "if":
            return self.condition()
        args = []
        if self.take("("):
            args.append(self.pipe())
            while self.take(";"):
                args.append(self.pipe())
            self.need(")")
        if (t, len(args)) not in FUNCTIONS:
            raise Unsupported(self.text)
        return FUNCTIONS[t, len(args)](*args)

    def condition(self) -> Filter:
        test = self.pipe()
        self.need("then")
        yes = self.pipe()
        if self.take("elif"):
            no = self.condition()
        else:
            no = self.pipe() if self.take("else") else lambda v: F.array(v)
            self.need("end")
        return lambda v: _each(test(v), lambda c: F.when(_truthy(c), yes(v)).otherwise(no(v)))

    def made(self) -> Filter:
        if self.take("["):
            inner = (lambda v: _none()) if self.peek() == "]" else self.pipe()
            self.need("]")
            return lambda v: _listed(inner(v))
        self.need("{")
        fields: list[tuple[str, Filter]] = []
        while not self.take("}"):
            if fields:
                self.need(",")
            t = self.take() or ""
            if not re.fullmatch(r'[A-Za-z_]\w*|".*"', t, re.S):
                raise Unsupported(self.text)
            name = json.loads(t) if t[0] == '"' else t
            fields = [x for x in fields if x[0] != name] + [(name, self.binary(0) if self.take(":") else _field(name))]
        # One object for each combination of the fields' outputs.
        def build(v: Column, rest: list, done: list[Column]) -> Column:
            if not rest:
                return F.array(F.to_variant_object(F.create_map(*done) if done else F.create_map().cast("map<string,variant>")))
            (name, f), *more = rest
            return _each(f(v), lambda x: build(v, more, [*done, F.lit(name), x]))

        return lambda v: build(v, fields, [])


def lower(query: str) -> Filter:
    """The filter of a query, from a variant to the array of its outputs; ``Unsupported`` if it is none of the forms above."""
    reader = _Reader(query)
    try:
        out = reader.pipe()
    except (json.JSONDecodeError, RecursionError) as e:
        raise Unsupported(query) from e
    if reader.peek() is not None:
        raise Unsupported(query)
    return out
