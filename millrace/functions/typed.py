"""Typed expressions: a value, whether it could be computed, and its type, all as Columns.

A statement that errs drops its row; Spark would give null or stop the job. So an :class:`Expr` carries ``ok`` beside its
value, arithmetic goes through ``try_`` functions, and a block filters once at its end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Static types of expressions.
STRING, BYTES, INT, DOUBLE, BOOL, DATETIME, LIST, DICT, NULL = "string", "bytes", "int", "double", "bool", "datetime", "list", "dict", "null"
INT_MIN, INT_MAX = -(2**63), 2**63 - 1
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|0[xX][0-9a-fA-F]+)$"


@dataclass(frozen=True)
class Expr:
    value: Column
    kind: str
    ok: Column

    def __add__(self, other) -> Expr:
        return plus(self, wrap(other))

    def __sub__(self, other) -> Expr:
        return minus(self, wrap(other))

    def __mul__(self, other) -> Expr:
        return times(self, wrap(other))

    def __truediv__(self, other) -> Expr:
        return over(self, wrap(other))

    def __mod__(self, other) -> Expr:
        return modulo(self, wrap(other))

    def __neg__(self) -> Expr:
        return negative(self)


def expr(value: Column, kind: str, ok: Column | None = None) -> Expr:
    """An expression of a known type; without ``ok``, it errs where the value is null (as an unset field does)."""
    return Expr(value, kind, (F.lit(True) if kind == NULL else value.isNotNull()) if ok is None else ok)


def wrap(x) -> Expr:
    """Python literals as expressions."""
    if isinstance(x, Expr):
        return x
    if x is None:
        return Expr(F.lit(None), NULL, F.lit(True))
    kind = BOOL if isinstance(x, bool) else INT if isinstance(x, int) else DOUBLE if isinstance(x, float) else BYTES if isinstance(x, bytes) else STRING
    return Expr(F.lit(x).cast("bigint") if kind == INT else F.lit(x), kind, F.lit(True))


def _both(a: Expr, b: Expr) -> Column:
    return a.ok & b.ok


def _checked(a: Expr, b: Expr, value: Column, kind: str, extra: Column | None = None) -> Expr:
    ok = _both(a, b) & value.isNotNull()
    if kind == DOUBLE:
        ok = ok & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return Expr(value, kind, F.coalesce(ok if extra is None else ok & extra, F.lit(False)))


def _error(a: Expr, b: Expr) -> Expr:
    return Expr(F.lit(None), NULL, F.lit(False))


def _numeric(a: Expr, b: Expr) -> bool:
    return a.kind in (INT, DOUBLE) and b.kind in (INT, DOUBLE)


def plus(a: Expr, b: Expr) -> Expr:
    """Numbers add with overflow as an error; strings, lists and dicts join; a datetime takes microseconds (int) or seconds (double)."""
    if a.kind == b.kind == STRING:
        return _checked(a, b, F.concat(a.value, b.value), STRING)
    if a.kind == b.kind == BYTES:
        return _checked(a, b, F.concat(a.value, b.value), BYTES)
    if a.kind == b.kind == LIST:
        return _checked(a, b, F.concat(a.value, b.value), LIST)
    if a.kind == b.kind == DICT:
        return _checked(a, b, merged(a.value, b.value), DICT)
    if DATETIME in (a.kind, b.kind):
        t, d = (a, b) if a.kind == DATETIME else (b, a)
        if d.kind not in (INT, DOUBLE):
            return _error(a, b)
        micros = d.value if d.kind == INT else (d.value * 1e6).cast("bigint")
        return _checked(a, b, F.timestamp_micros(F.unix_micros(t.value) + micros), DATETIME)
    if not _numeric(a, b):
        return _error(a, b)
    return _checked(a, b, F.try_add(a.value, b.value), INT if a.kind == b.kind == INT else DOUBLE)


def minus(a: Expr, b: Expr) -> Expr:
    if not _numeric(a, b):
        return _error(a, b)
    return _checked(a, b, F.try_subtract(a.value, b.value), INT if a.kind == b.kind == INT else DOUBLE)


def times(a: Expr, b: Expr) -> Expr:
    if not _numeric(a, b):
        return _error(a, b)
    return _checked(a, b, F.try_multiply(a.value, b.value), INT if a.kind == b.kind == INT else DOUBLE)


def int_div(a: Column, b: Column) -> Column:
    """Division of whole numbers that truncates toward zero; null by zero and at the one overflow."""
    safe = F.when((b != 0) & ~((a == INT_MIN) & (b == -1)), b)
    return F.call_function("div", a, safe)


def over(a: Expr, b: Expr) -> Expr:
    """Whole numbers truncate; by zero is an error."""
    if not _numeric(a, b):
        return _error(a, b)
    if a.kind == b.kind == INT:
        return _checked(a, b, int_div(a.value, b.value), INT)
    return _checked(a, b, F.try_divide(a.value.cast("double"), b.value.cast("double")), DOUBLE)


def modulo(a: Expr, b: Expr) -> Expr:
    """Whole numbers only; the sign is the dividend's."""
    if not a.kind == b.kind == INT:
        return _error(a, b)
    return _checked(a, b, F.try_mod(a.value, F.when(b.value != -1, b.value).when(b.value == -1, F.lit(1).cast("bigint"))), INT)


def negative(a: Expr) -> Expr:
    return minus(wrap(0) if a.kind == INT else wrap(0.0), a)


def parsed_number(s: Column) -> Column:
    """The double that a string spells in full, or null."""
    hexed = F.when(s.rlike(r"^\s*[+-]?0[xX]"), F.conv(F.regexp_extract(s, r"0[xX]([0-9a-fA-F]+)$", 1), 16, 10).cast("double") * F.when(s.rlike(r"^\s*-"), -1.0).otherwise(1.0))
    return F.when(s.rlike(_NUMBER), F.coalesce(hexed, s.try_cast("double")))


def as_number(a: Expr, classic: bool = False) -> Column:
    """The value as a double for comparison; null means not a number. Datetimes count microseconds, or milliseconds in classic filters."""
    v = a.value
    if a.kind in (INT, DOUBLE):
        return v.cast("double")
    if a.kind == STRING:
        return parsed_number(v)
    if a.kind == NULL:
        return F.lit(0.0)
    if a.kind == BOOL:
        return v.cast("int").cast("double")
    if a.kind == DATETIME:
        return (F.unix_millis(v) if classic else F.unix_micros(v)).cast("double")
    return F.lit(None).cast("double")


_SQL = {"<": Column.__lt__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__, ">=": Column.__ge__, ">": Column.__gt__}


def compare(a, op: str, b, classic: bool = False) -> Expr:
    """``< <= == != >= >`` by type: strings of one type bytewise, null only equals null, all else as numbers, where not-a-number makes all but ``!=`` false; ``===`` and ``!==`` ask for one type; ``lt le eq ne ge gt`` compare as strings."""
    a, b = wrap(a), wrap(b)
    if op in ("lt", "le", "eq", "ne", "ge", "gt"):
        sign = {"lt": "<", "le": "<=", "eq": "==", "ne": "!=", "ge": ">=", "gt": ">"}[op]
        return _result(a, b, _SQL[sign](a.value.cast("string"), b.value.cast("string")))
    if op in ("===", "!=="):
        if a.kind != b.kind:
            return _result(a, b, F.lit(op == "!=="))
        op = op[:2]
    same_text = a.kind == b.kind and a.kind in ((STRING, BYTES, LIST, DICT) if classic else (STRING, BYTES))
    if same_text:
        return _result(a, b, _SQL[op](a.value, b.value))
    if NULL in (a.kind, b.kind) and op in ("==", "!="):
        return _result(a, b, F.lit((a.kind == b.kind) == (op == "==")))
    if a.kind == b.kind == INT:
        return _result(a, b, _SQL[op](a.value, b.value))
    x, y = as_number(a, classic), as_number(b, classic)
    bad = x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y)
    return _result(a, b, F.when(bad, F.lit(op == "!=")).otherwise(_SQL[op](x, y)))


def _result(a: Expr, b: Expr, value: Column) -> Expr:
    return Expr(value, BOOL, _both(a, b))


def typed_pair_compare(left: Column, left_type: Column, op: str, right: Column, right_type: Column) -> Column:
    """Comparison of (string, type name) pairs whose types differ from row to row, as in classic filters."""
    text = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))

    def number(s: Column, t: Column) -> Column:
        return (
            F.when(t.isin("string", "int", "integer", "double"), parsed_number(s))
            .when(t == "null", F.lit(0.0))
            .when(t == "boolean", F.when(F.lower(F.substring(s, 1, 1)).isin("t", "y", "1") | (F.lower(s) == "on"), 1.0).otherwise(0.0))
            .when(t == "datetime", F.coalesce(s.try_cast("double") * 1000, F.lit(0.0)))
        )

    x, y = number(text[0], left_type), number(text[1], right_type)
    as_text = (left_type == right_type) & left_type.isin("string", "json", "list", "bytes", "protobuf")
    by_number = F.when(x.isNull() | y.isNull(), F.lit(op == "!=")).otherwise(_SQL[op](x, y))
    r = F.when(as_text, _SQL[op](*text))
    if op in ("==", "!="):
        equal = left_type == right_type
        r = r.when((left_type == "null") | (right_type == "null"), equal if op == "==" else ~equal)
    return r.otherwise(by_number)


def truthy(a: Expr) -> Column:
    """Non-empty strings, bytes and containers, non-zero numbers, true, datetimes off the epoch; null is false."""
    v = a.value
    if a.kind == STRING:
        r = v != ""
    elif a.kind == BYTES:
        r = F.octet_length(v) > 0
    elif a.kind in (INT, DOUBLE):
        r = v != 0
    elif a.kind == BOOL:
        r = v
    elif a.kind in (LIST, DICT):
        r = F.size(v) > 0
    elif a.kind == DATETIME:
        r = F.unix_micros(v) != 0
    else:
        r = F.lit(False)
    return F.coalesce(r, F.lit(False))


def all_of(*parts: Expr) -> Expr:
    """``and``: an operand counts as it is true; an error in one that is reached is an error."""
    parts = tuple(map(wrap, parts))
    ok = parts[0].ok
    so_far = truthy(parts[0])
    for p in parts[1:]:
        ok = ok & (~so_far | p.ok)
        so_far = so_far & truthy(p)
    return Expr(so_far, BOOL, F.coalesce(ok, F.lit(False)))


def any_of(*parts: Expr) -> Expr:
    """``or``, with operands after a true one unread."""
    parts = tuple(map(wrap, parts))
    ok = parts[0].ok
    so_far = truthy(parts[0])
    for p in parts[1:]:
        ok = ok & (so_far | p.ok)
        so_far = so_far | truthy(p)
    return Expr(so_far, BOOL, F.coalesce(ok, F.lit(False)))


def negated(a) -> Expr:
    a = wrap(a)
    return Expr(~truthy(a), BOOL, a.ok)


def coalesced(a, b) -> Expr:
    """``a ?? b``: the second where the first is null or errs."""
    a, b = wrap(a), wrap(b)
    if a.kind == NULL:
        return b
    use = F.coalesce(a.ok & a.value.isNotNull(), F.lit(False))
    return Expr(F.when(use, a.value).otherwise(b.value), a.kind if b.kind in (NULL, a.kind) else b.kind, use | b.ok)


def choose(condition, yes, no) -> Expr:
    """``condition ? yes : no``."""
    c, y, n = wrap(condition), wrap(yes), wrap(no)
    t = truthy(c)
    return Expr(F.when(t, y.value).otherwise(n.value), y.kind if y.kind != NULL else n.kind, F.coalesce(c.ok & F.when(t, y.ok).otherwise(n.ok), F.lit(False)))


def elvis(a, b) -> Expr:
    """``a ?: b``: the first if it is true."""
    a = wrap(a)
    return choose(a, a, b)


def isset(a) -> Expr:
    return Expr(F.coalesce(wrap(a).ok, F.lit(False)), BOOL, F.lit(True))


def switch(subject, cases: list[tuple], default=None) -> Expr:
    """First case that holds: a literal compares by type, a (low, high) pair is a range, both ends in."""
    subject = wrap(subject)
    seen, r = set(), None
    for key, result in cases:
        if key in seen:
            raise ValueError(f"case {key!r} stands twice")
        seen.add(key)
        hit = all_of(compare(subject, ">=", key[0]), compare(subject, "<=", key[1])) if isinstance(key, tuple) else compare(subject, "==", key)
        r = [*(r or []), (hit, wrap(result))]
    out = wrap(default)
    for hit, result in reversed(r or []):
        out = choose(hit, result, out)
    return Expr(out.value, out.kind, out.ok & subject.ok)


def byte_slice(s, start=None, end=None) -> Expr:
    """``s[start..end]`` over bytes: negative counts from the end, both are clamped, start past end is an error. Cuts within a character give what UTF-8 decoding makes of them."""
    s = wrap(s)
    b = s.value.cast("binary")
    n = F.octet_length(s.value).cast("bigint")

    def place(x, default: Column) -> tuple[Column, Column]:
        if x is None:
            return default, F.lit(True)
        x = wrap(x)
        if x.kind != INT:
            return default, F.lit(False)
        return F.greatest(F.least(F.when(x.value < 0, n + x.value).otherwise(x.value), n), F.lit(0).cast("bigint")), x.ok

    (a, a_ok), (z, z_ok) = place(start, F.lit(0).cast("bigint")), place(end, n)
    cut = F.substring(b, (a + 1).cast("int"), F.greatest(z - a, F.lit(0).cast("bigint")).cast("int"))
    return Expr(cut if s.kind == BYTES else cut.cast("string"), s.kind, F.coalesce(s.ok & a_ok & z_ok & (a <= z), F.lit(False)))


def merged(a: Column, b: Column) -> Column:
    """Two maps; a key of both has the second's value and place. The second is made again for every key of the first: see :func:`with_member` and :func:`merged_once`."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def with_member(a: Column, key: Column, value: Column) -> Column:
    """:func:`merged` with a map of one key, which the filter alone reads."""
    return F.map_concat(F.map_filter(a, lambda k, _: k != key), F.create_map(key, value))


def merged_once(a: Column, b: Column) -> Column:
    """:func:`merged` with both maps bound, so that each is made once. Not for maps that Python functions take or make: a plan doesn't find those below nested lambdas."""
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: F.map_concat(F.map_filter(x["a"], lambda k, _: ~F.map_contains_key(x["b"], k)), x["b"]))[0]


#: Members of dicts and lists are text; one that isn't a string is this sign and its JSON.
TYPED = "\ue000"


def _quoted(s: Column) -> Column:
    a = F.to_json(F.array(s))
    return F.substring(a, F.lit(2), F.length(a) - 2)


def member_json(v: Column) -> Column:
    """The JSON of a member."""
    return F.when(v.isNull(), F.lit("null")).when(v.startswith(TYPED), F.substring(v, F.lit(2), F.length(v))).otherwise(_quoted(v))


def member_text(v: Column) -> Column:
    """The text of a member."""
    return F.when(v.startswith(TYPED), F.substring(v, F.lit(2), F.length(v))).otherwise(v)


def json_text(e: Expr) -> Column:
    """A value as JSON."""
    if hasattr(e, "raw"):
        return member_json(e.raw)
    if e.kind == DICT:
        pairs = F.transform(F.map_entries(e.value), lambda x: F.concat(_quoted(x["key"]), F.lit(":"), member_json(x["value"])))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    if e.kind == LIST:
        return F.concat(F.lit("["), F.array_join(F.transform(e.value, member_json), ","), F.lit("]"))
    if e.kind == NULL:
        return F.lit("null")
    return e.value.cast("string") if e.kind in (INT, DOUBLE, BOOL) else _quoted(F.base64(e.value) if e.kind == BYTES else e.value.cast("string"))


def held(e: Expr) -> Column:
    """A value as a member of a dict or list."""
    if hasattr(e, "raw"):
        return e.raw
    return e.value.cast("string") if e.kind in (STRING, BYTES, DATETIME, NULL) else F.concat(F.lit(TYPED), json_text(e))


def texts(e: Expr) -> Expr:
    """A dict or list whose members are all plain text, for functions of text."""
    if e.kind == DICT:
        return Expr(F.transform_values(e.value, lambda _, v: member_text(v)), DICT, e.ok)
    return Expr(F.transform(e.value, member_text), LIST, e.ok) if e.kind == LIST else e


def _kept(raw: Column, variant: Column) -> Column:
    return F.when(F.schema_of_variant(variant).isin("STRING", "VOID"), raw).otherwise(F.concat(F.lit(TYPED), raw))


def json_dict(s: Column) -> Column:
    """The members of a JSON object, in its order, with their types; null where it is none."""
    raw, types = F.from_json(s, "map<string,string>"), F.try_variant_get(F.try_parse_json(s), "$", "map<string,variant>")
    return F.when(types.isNotNull(), F.transform_values(raw, lambda k, v: _kept(v, F.try_element_at(types, k))))


def json_list(s: Column) -> Column:
    """The members of a JSON array with their types; null where it is none."""
    raw, types = F.from_json(s, "array<string>"), F.try_variant_get(F.try_parse_json(s), "$", "array<variant>")
    return F.when(types.isNotNull(), F.zip_with(raw, types, _kept))


def member(x, container) -> Expr:
    """``x in container``: of a list by text, of a dict by key."""
    x, container = wrap(x), texts(wrap(container))
    if container.kind == DICT:
        return Expr(F.map_contains_key(container.value, x.value), BOOL, _both(x, container))
    return Expr(F.coalesce(F.array_contains(container.value, x.value), F.lit(False)), BOOL, _both(x, container))


def element(container, key) -> Expr:
    """``container[key]``: a dict's key, or a list's index from 0, negative from the end; absent is an error."""
    c, k = wrap(container), wrap(key)
    if c.kind == DICT:
        return _raw(F.try_element_at(c.value, k.value), F.coalesce(_both(c, k) & F.map_contains_key(c.value, k.value), F.lit(False)))
    at = F.when(k.value >= 0, k.value + 1).otherwise(k.value).cast("int")
    inside = (k.value < F.size(c.value)) & (k.value >= -F.size(c.value))
    return _raw(F.try_element_at(c.value, F.when(inside, at).otherwise(F.lit(1))), F.coalesce(_both(c, k) & inside, F.lit(False)))


def _raw(v: Column, ok: Column) -> Expr:
    """A member as text that still knows its JSON."""
    e = Expr(member_text(v), STRING, ok)
    object.__setattr__(e, "raw", v)
    return e


def cast_int(a) -> Expr:
    a = wrap(a)
    if a.kind == DATETIME:
        return expr(F.unix_micros(a.value), INT)
    v = a.value.try_cast("bigint")
    return Expr(v, INT, F.coalesce(a.ok & v.isNotNull(), F.lit(False)))


def cast_double(a) -> Expr:
    a = wrap(a)
    v = F.unix_micros(a.value) / 1e6 if a.kind == DATETIME else a.value.try_cast("double")
    return Expr(v, DOUBLE, F.coalesce(a.ok & v.isNotNull(), F.lit(False)))


def cast_string(a) -> Expr:
    a = wrap(a)
    return Expr(F.lit("null") if a.kind == NULL else a.value.cast("string"), STRING, a.ok)


def cast_bool(a) -> Expr:
    a = wrap(a)
    return Expr(truthy(a), BOOL, a.ok)


def cast_datetime(a) -> Expr:
    """From microseconds (int), seconds (double) or ISO 8601 text."""
    a = wrap(a)
    v = F.timestamp_micros(a.value) if a.kind == INT else F.timestamp_micros((a.value * 1e6).cast("bigint")) if a.kind == DOUBLE else F.try_to_timestamp(a.value) if a.kind == STRING else a.value
    return Expr(v, DATETIME, F.coalesce(a.ok & v.isNotNull(), F.lit(False)))


SUPERTYPES = {STRING: {"string", "object"}, BYTES: {"bytes", "object"}, INT: {"integer", "object"}, DOUBLE: {"double", "object"}, BOOL: {"boolean", "object"}, DATETIME: {"datetime", "object"}, LIST: {"list", "sequence", "object"}, DICT: {"dict", "mapping", "object"}, NULL: {"null", "object"}}


def istype(a, name: str) -> Expr:
    """Known when the plan is built: the type or one it derives from."""
    a = wrap(a)
    return Expr(F.lit(name in SUPERTYPES[a.kind]), BOOL, a.ok)


def conjunction(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def disjunction(parts: list[Column]) -> Column:
    return reduce(or_, parts, F.lit(False))
