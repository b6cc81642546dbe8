"""Expression functions by the names that users write, over typed expressions.

Each takes and gives :class:`~millrace.functions.typed.Expr`; an argument that errs, or a result that is null where the
function has no null result, is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import strings as S
from millrace.functions import text_formats as T
from millrace.functions import typed
from millrace.functions.typed import BOOL, BYTES, DATETIME, DICT, INT, LIST, NULL, STRING, Expr, wrap
from millrace.operators.metrics import dedup_labels

FUNCTIONS: dict[str, Callable[..., Expr]] = {}


def _all_ok(args) -> Column:
    return typed.conjunction([a.ok for a in args if isinstance(a, Expr)])


def made(value: Column, kind: str, *args, nullable: bool = False) -> Expr:
    ok = _all_ok(args)
    return Expr(value, kind, F.coalesce(ok if nullable else ok & value.isNotNull(), F.lit(False)))


def function(*names: str):
    def take(f: Callable[..., Expr]) -> Callable[..., Expr]:
        for n in names or (f.__name__.rstrip("_"),):
            FUNCTIONS[n] = f
        return f

    return take


def simple(name: str, kind: str, f: Callable[..., Column]) -> None:
    """A function of the values alone; literals among the arguments reach it as they are."""

    def run(*args, **options) -> Expr:
        es = [typed.texts(wrap(a)) for a in args]
        return made(f(*[e.value for e in es], **options), kind, *es)

    FUNCTIONS[name] = run


def literal(x):
    """What a literal argument holds, for options that shape the plan."""
    return x.literal if hasattr(x, "literal") else x


for _n, _k, _f in (
    ("lower", STRING, S.lower), ("upper", STRING, S.upper), ("str_strip", STRING, S.strip), ("str_lstrip", STRING, S.lstrip), ("str_rstrip", STRING, S.rstrip), ("md5", STRING, S.md5), ("sha1", STRING, S.sha1),
    ("sha256", STRING, lambda x: S.sha2(x, 256)), ("sha512", STRING, lambda x: S.sha2(x, 512)), ("base64_encode", STRING, S.base64_encode), ("base64_decode", BYTES, S.base64_decode), ("urlencode", STRING, S.urlencode),
    ("urldecode", STRING, S.urldecode), ("hex_encode", STRING, S.hex_encode), ("hex_decode", BYTES, S.hex_decode), ("strcasecmp", INT, S.strcasecmp), ("utf8_validate", BOOL, S.utf8_validate), ("utf8_sanitize", STRING, S.utf8_sanitize),
    ("isodate", DATETIME, D.isodate), ("format_isodate", STRING, D.format_isodate), ("parse_cef", DICT, T.parse_cef), ("parse_leef", DICT, T.parse_leef), ("parse_xml", DICT, T.parse_xml), ("format_xml", STRING, T.format_xml),
    ("parse_windows_eventlog_xml", DICT, T.parse_windows_eventlog_xml), ("format_windows_eventlog_xml", STRING, lambda m: T.format_xml(m, "Event")), ("keys", LIST, F.map_keys), ("example_echo", STRING, lambda x: x), ("ip", STRING, lambda s: F.when(S.ipv4_to_int(s).isNotNull() | s.contains(":"), s)),
    ("dedup_metrics_labels", DICT, lambda m: dedup_labels(F.map_entries(m))), ("metrics_labels", DICT, lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))),
):
    simple(_n, _k, _f)


@function("len")
def length(x):
    x = wrap(x)
    return made(S.length(x.value) if x.kind in (STRING, BYTES) else F.size(x.value).cast("bigint"), INT, x)


@function("string")
def string(x):
    return typed.cast_string(x)


@function("repr")
def repr_(x):
    x = wrap(x)
    return made(typed.json_text(x) if x.kind in (DICT, LIST) else x.value.cast("string"), STRING, x)


@function("bytes", "protobuf")
def bytes_(x):
    x = wrap(x)
    return made(x.value.cast("binary"), BYTES, x)


FUNCTIONS |= {"int": typed.cast_int, "double": typed.cast_double, "bool": typed.cast_bool, "datetime": typed.cast_datetime, "isset": typed.isset}


@function("istype")
def istype(x, name):
    return typed.istype(x, literal(name))


@function("dict", "json", "parse_json")
def dict_(x=None):
    """A mapping of an object's members with their types; further access reads inner objects and arrays."""
    if x is None:
        return made(F.create_map().cast("map<string,string>"), DICT)
    x = wrap(x)
    return x if x.kind == DICT else made(typed.json_dict(x.value), DICT, x)


@function("list", "json_array", "tuple")
def list_(x=None):
    if x is None:
        return made(F.array().cast("array<string>"), LIST)
    x = wrap(x)
    return x if x.kind == LIST else made(typed.json_list(x.value), LIST, x)


@function("format_json")
def format_json(x):
    x = wrap(x)
    return made(typed.json_text(x), STRING, x)


@function("str_replace")
def str_replace(s, old, new, limit=None):
    s = wrap(s)
    return made(S.replace(s.value, literal(old), literal(new), literal(limit)), STRING, s)


def _affix(f):
    def run(s, needles, ignorecase=False, limit=None) -> Expr:
        s = wrap(s)
        n = literal(needles)
        extra = {} if limit is None else {"limit": literal(limit)}
        return made(f(s.value, n, bool(literal(ignorecase)), **extra), BOOL, s)

    return run


FUNCTIONS |= {"startswith": _affix(S.startswith), "endswith": _affix(S.endswith), "includes": _affix(S.includes)}


@function("glob_match")
def glob_match(s, patterns):
    s = wrap(s)
    return made(S.glob_match(s.value, literal(patterns)), BOOL, s)


@function("regexp_search")
def regexp_search(s, pattern, keep_zero=False, list_mode=False):
    s = wrap(s)
    return made(S.regexp_search(s.value, literal(pattern), bool(literal(keep_zero)), bool(literal(list_mode))), LIST if literal(list_mode) else DICT, s)


@function("regexp_subst")
def regexp_subst(s, pattern, replacement, **options):
    s = wrap(s)
    names = {"global": "global_", "ignorecase": "ignore_case", "newline": "newline", "groups": "groups"}
    return made(S.regexp_subst(s.value, literal(pattern), literal(replacement), **{names[k]: bool(literal(v)) for k, v in options.items() if k in names}), STRING, s)


@function("digest")
def digest(x, alg="sha256"):
    x = wrap(x)
    return made(S.digest(x.value, literal(alg)), BYTES, x)


@function("uuid", "uuid4")
def uuid_():
    return made(S.uuid4(), STRING)


@function("uuid7")
def uuid7():
    return made(S.uuid7(), STRING)


@function("strptime")
def strptime(s, *formats):
    s = wrap(s)
    return made(D.strptime(s.value, *map(literal, formats)), DATETIME, s, nullable=True)


@function("strftime")
def strftime(fmt, t):
    t = wrap(t)
    return made(D.strftime(literal(fmt), t.value), STRING, t)


@function("subnet")
def subnet(s):
    """A literal network; ``ip in subnet`` tests containment."""
    e = wrap(literal(s))
    object.__setattr__(e, "network", literal(s))
    return e


@function("parse_kv")
def parse_kv(s, value_separator="=", pair_separator=", ", stray_words_key=None):
    s = wrap(s)
    m = T.parse_kv(s.value, literal(value_separator), literal(pair_separator))
    if stray_words_key is not None:
        m = typed.merged(m, F.create_map(F.lit(literal(stray_words_key)), T.stray_words(s.value, literal(value_separator))))
    return made(m, DICT, s)


@function("format_kv")
def format_kv(m, value_separator="=", pair_separator=", "):
    m = typed.texts(wrap(m))
    return made(T.format_kv(m.value, literal(value_separator), literal(pair_separator)), STRING, m)


@function("parse_csv")
def parse_csv(s, columns=None, delimiter=",", dialect="escape-double-char", strip_whitespace=False, greedy=False, **_):
    s = wrap(s)
    if columns is None:
        return made(T.split_csv(s.value, literal(delimiter), '"', literal(dialect)), LIST, s)
    return made(T.parse_csv(s.value, literal(columns), literal(delimiter), '"', literal(dialect), bool(literal(strip_whitespace)), bool(literal(greedy))), DICT, s)


@function("format_csv")
def format_csv(x, columns=None, delimiter=",", default_value=""):
    x = typed.texts(wrap(x))
    values = x.value if x.kind == LIST else F.array(*[F.coalesce(x.value[c], F.lit(literal(default_value))) for c in literal(columns)]) if columns is not None else F.map_values(x.value)
    return made(T.format_csv(values, literal(delimiter)), STRING, x)


@function("format_cef")
def format_cef(m):
    """Header fields by their names, the rest as extensions."""
    m = typed.texts(wrap(m))
    head = [F.coalesce(m.value[k], F.lit("")) for k in T._CEF]
    return made(T.format_cef(head, F.map_filter(m.value, lambda k, _: ~k.isin(*T._CEF))), STRING, m)


@function("format_leef")
def format_leef(m):
    m = typed.texts(wrap(m))
    head = [F.coalesce(m.value[k], F.lit("")) for k in T._LEEF]
    return made(T.format_leef(head, F.map_filter(m.value, lambda k, _: ~k.isin(*T._LEEF))), STRING, m)


@function("flatten")
def flatten(x, separator="."):
    x = wrap(x)
    return made(T.json_fields(typed.json_text(x) if x.kind == DICT else x.value, "", literal(separator)), DICT, x)


@function("unset_empties")
def unset_empties(x, replacement=None, ignorecase=False, targets=None, recursive=False):
    from millrace.plans.block import unset_empties as f

    if literal(recursive):
        raise ValueError("unset_empties() reads the members of one dict; inner ones are JSON")
    x = wrap(x)
    if targets is None:  # an empty string, list or dict, and null
        x = Expr(F.transform_values(x.value, lambda _, v: F.when(v.isNull() | v.isin(f"{typed.TYPED}[]", f"{typed.TYPED}{{}}"), F.lit("")).otherwise(v)), DICT, x.ok)
    return made(f(x.value, tuple(literal(targets)) if targets is not None else ("",), literal(replacement), bool(literal(ignorecase))), DICT, x)


@function("fix_timezone")
def fix_timezone(t, zone):
    t = wrap(t)
    return made(D.fix_timezone(t.value, literal(zone)), DATETIME, t)


@function("set_timezone")
def set_timezone(t, zone):
    """The same instant: a datetime has no zone of its own here, so only text can show one; ``format_isodate`` with the zone does."""
    D.zone_offset(F.lit(0).cast("timestamp"), literal(zone))  # an unknown zone raises
    return wrap(t)


@function("guess_timezone")
def guess_timezone(t, received=None):
    t = wrap(t)
    return made(D.guess_timezone(t.value, wrap(received).value if received is not None else F.current_timestamp()), DATETIME, t)


@function("get_timezone_source")
def get_timezone_source(t):
    t = wrap(t)
    return made(F.lit("parsed"), STRING, t)


@function("get_timestamp")
def get_timestamp(stamp="stamp"):
    return typed.expr(F.col(literal(stamp)), DATETIME)


@function("has_sdata")
def has_sdata():
    return made(F.size("sdata") > 0, BOOL)


@function("get_sdata")
def get_sdata(id_=None):
    return made(F.col("sdata")[literal(id_)] if id_ is not None else F.transform_values("sdata", lambda _, v: F.concat(F.lit(typed.TYPED), F.to_json(v))), DICT)


@function("is_sdata_from_enterprise")
def is_sdata_from_enterprise(number):
    return made(T.is_sdata_from_enterprise(F.col("sdata"), literal(number)), BOOL)


@function("format_syslog_5424")
def format_syslog_5424(message, add_octet_count=False, pri=None):
    m = wrap(message)
    p = wrap(pri).value if pri is not None else F.col("pri")
    return made(T.format_syslog_5424(p, F.col("stamp"), F.col("host"), F.col("program"), F.col("pid"), F.col("msgid"), F.col("sdata"), m.value, bool(literal(add_octet_count))), STRING, m)


@function("null")
def null():
    return Expr(F.lit(None), NULL, F.lit(True))


@function("dict_to_pairs")
def dict_to_pairs(x, key, value):
    """A list of {key, value} objects."""
    x = wrap(x)
    name = lambda n: F.to_json(F.array(F.lit(literal(n)))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(literal(n))))) - 2)
    one = lambda e: F.concat(F.lit(typed.TYPED + "{"), name(key), F.lit(":"), typed.member_json(e["key"]), F.lit(","), name(value), F.lit(":"), typed.member_json(e["value"]), F.lit("}"))
    return made(F.transform(F.map_entries(x.value), one), LIST, x)


@function("set_fields")
def set_fields(x, overrides=None, defaults=None, replacements=None):
    """Fields set always, where unset, or where set; null values are passed over."""
    x = wrap(x)
    valid = lambda m: F.map_filter(wrap(m).value, lambda _, v: v.isNotNull())
    out = x.value
    if overrides is not None:
        out = typed.merged(out, valid(overrides))
    if defaults is not None:
        out = typed.merged(valid(defaults), out)
    if replacements is not None:
        have = F.map_keys(out)
        out = typed.merged(out, F.map_filter(valid(replacements), lambda k, _: F.array_contains(have, k)))
    return made(out, DICT, x)


@function("cache_json_file")
def cache_json_file(path, default_value=None):
    """A JSON object in a file, read when the plan is built; as a literal map it travels with the plan."""
    from millrace.operators.enrich import cached_json

    e = made(cached_json(None, literal(path)), DICT)
    object.__setattr__(e, "default", literal(default_value))
    return e


@function("otel_logrecord", "otel_resource", "otel_scope", "otel_kvlist")
def otel_object(x=None):
    """A mapping with the members of the record; encoding to its wire format is a sink's."""
    return dict_(x)


@function("otel_array")
def otel_array(x=None):
    return list_(x)


@function("pubsub_message")
def pubsub_message(data, attributes=None):
    d = wrap(data)
    a = F.concat(F.lit(typed.TYPED), typed.json_text(wrap(attributes)) if attributes is not None else F.lit("{}"))
    return made(F.create_map(F.lit("data"), S.base64_encode(d.value), F.lit("attributes"), a), DICT, d)
