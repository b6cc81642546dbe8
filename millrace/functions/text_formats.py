"""Text to fields and back: key=value, CSV, JSON, XML, CEF, LEEF, WELF, syslog and structured data, as Columns of maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.strings import quoted

MAP = "map<string,string>"


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` reads it."""
    return F.transform(F.array(x), f)[0]


def _pairs(entries: Column) -> Column:
    """A map of (key, value) structs, a later one of equal key winning."""


    def made(e: Column) -> Column:
        keys = F.transform(e, lambda x: x["key"])
        last = F.filter(e, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(e)).otherwise(F.map_from_entries(last))

    return let(entries, made)


def parse_kv(s: Column, value_separator: str = "=", pair_separator: str = ", ", prefix: str = "") -> Column:
    """Pairs by scanning: a bare value runs to the pair separator or, if that holds spaces, to a space before the next key; quoted values may hold either."""
    v, p = quoted(value_separator), quoted(pair_separator.strip() or " ")
    stop = rf"(?:\s*{p}\s*|\s+(?=[\w.\-\[\]]+{v})|\s*$)"
    # a bare value ends where a stop begins, which only white space, the separator's first character and the end can do
    bare = rf"(?:[^\s{quoted((pair_separator.strip() or ' ')[0])}]++|(?!{stop}).)*+"
    pattern = rf"""[\w.\-\[\]]++{v}(?:"(?:[^"\\]|\\.)*+"(?={stop})|'(?:[^'\\]|\\.)*+'(?={stop})|{bare}(?={stop}))"""
    found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))

    def pair(text: Column) -> Column:
        key = F.substring_index(text, value_separator, 1)
        value = F.substring(text, F.length(key) + len(value_separator) + 1, F.length(text))
        first = F.substring(value, 1, 1)
        quotes = first.isin('"', "'") & (F.length(value) > 1) & (F.right(value, F.lit(1)) == first)
        plain = F.substring(value, F.lit(2), F.length(value) - 2)
        plain = F.when(plain.contains("\\"), F.regexp_replace(plain, r"\\(.)", "$1")).otherwise(plain)
        return F.struct((F.concat(F.lit(prefix), key) if prefix else key).alias("key"), F.when(quotes, plain).otherwise(value).alias("value"))

    return _pairs(F.transform(found, pair))


def stray_words(s: Column, value_separator: str = "=") -> Column:
    """What :func:`parse_kv` leaves: words that are no pair, joined by spaces."""
    v = quoted(value_separator)
    rest = F.regexp_replace(s, rf"""[\w.\-\[\]]+{v}("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s,]*),?""", " ")
    return F.trim(F.regexp_replace(rest, r"[\s,]+", " "))


def format_kv(m: Column, value_separator: str = "=", pair_separator: str = ", ") -> Column:
    def one(e: Column) -> Column:
        odd = e["value"].contains(pair_separator) | e["value"].contains('"') | (e["value"] == "") | e["value"].contains(" ")
        return F.concat(e["key"], F.lit(value_separator), F.when(odd, F.concat(F.lit('"'), F.regexp_replace(e["value"], r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(e["value"]))

    return F.array_join(F.transform(F.map_entries(m), one), pair_separator)


def format_welf(m: Column) -> Column:
    """Keys in order, values quoted where they hold white space."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"].rlike(r"[\s\"]"), F.concat(F.lit('"'), F.replace(e["value"], F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(e["value"]))), " ")


def split_csv(s: Column, delimiter: str = ",", quote: str = '"', dialect: str = "escape-double-char") -> Column:
    """Fields of one record, as an array, for one delimiter and one quote."""
    d, q = quoted(delimiter), quoted(quote)
    inner = {"escape-double-char": rf"(?:[^{q}]|{q}{q})*", "escape-backslash": rf"(?:[^{q}\\]|\\.)*", "escape-none": rf"[^{q}]*"}[dialect]
    pattern = rf"(?s)(?:^|{d})\s*({q}{inner}{q}|(?:(?!{d}).)*)"
    raw = F.regexp_extract_all(s, F.lit(pattern), F.lit(1))

    def clean(x: Column) -> Column:
        body = F.substring(x, F.lit(2), F.length(x) - 2)
        body = F.replace(body, F.lit(quote * 2), F.lit(quote)) if dialect == "escape-double-char" else F.regexp_replace(body, r"\\(.)", "$1") if dialect == "escape-backslash" else body
        return F.when((F.length(x) >= 2) & x.startswith(quote) & x.endswith(quote), body).otherwise(x)

    return F.when(s == "", F.array(F.lit(""))).otherwise(F.transform(raw, clean))


def parse_csv(s: Column, columns: list[str], delimiter: str = ",", quote: str = '"', dialect: str = "escape-double-char", strip: bool = False, greedy: bool = False, null: str | None = None, prefix: str = "") -> Column:
    """A map of the named columns. Missing ones are unset; with ``greedy`` the last takes all that is left, as it stands; fields equal to ``null`` are unset."""
    n = len(columns)
    d, q = quoted(delimiter), quoted(quote)
    head = rf"^(?:(?:{q}(?:[^{q}]|{q}{q})*{q}|(?:(?!{d}).)*){d}){{{n - 1}}}"
    rest = F.when(s.rlike(head), F.regexp_replace(s, head, "")) if greedy else F.lit(None).cast("string")

    def made(cut: Column) -> Column:
        pairs = []
        for i, c in enumerate(columns):
            v = cut["rest"] if greedy and i == n - 1 else F.try_element_at(cut["fields"], F.lit(i + 1))
            if strip:
                v = F.trim(v)
            pairs.append(F.when(v.isNotNull() & (v != F.lit(null) if null is not None else F.lit(True)), F.struct(F.lit(prefix + c).alias("key"), v.alias("value"))))
        return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e.isNotNull()))

    # the record is cut once, not for every column
    return let(F.struct(split_csv(s, delimiter, quote, dialect).alias("fields"), rest.alias("rest")), made)


def format_csv(values: Column, delimiter: str = ",") -> Column:
    """An array as a record; fields with the delimiter, quotes or line ends are quoted."""
    odd = lambda x: x.contains(delimiter) | x.rlike(r'["\r\n]')
    return F.array_join(F.transform(values, lambda x: F.when(odd(x), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))), delimiter)


def _scan_csv(line: str, delimiters: str, strings: list[str], pairs: dict[str, str], dialect: str, strip: bool) -> list[str]:
    out, i, n = [], 0, len(line)
    escapes = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "v": "\v", "f": "\f"}
    while True:
        if strip:
            while i < n and line[i] in " \t" and line[i] not in delimiters:
                i += 1
        field, close = [], pairs.get(line[i]) if i < n else None
        if close is not None:
            i += 1
            while i < n:
                c = line[i]
                if dialect.startswith("escape-backslash") and c == "\\" and i + 1 < n:
                    nxt = line[i + 1]
                    field.append(escapes.get(nxt, nxt) if dialect.endswith("sequences") else nxt)
                    i += 2
                    continue
                if c == close:
                    if dialect == "escape-double-char" and i + 1 < n and line[i + 1] == close:
                        field.append(close)
                        i += 2
                        continue
                    i += 1
                    break
                field.append(c)
                i += 1
        ended = False
        while i < n:
            s = next((x for x in strings if line.startswith(x, i)), None)
            if s is not None or line[i] in delimiters:
                i += len(s) if s is not None else 1
                ended = True
                break
            if close is None:
                field.append(line[i])
            i += 1
        text = "".join(field)
        out.append(text.rstrip(" \t") if strip and close is None else text)
        if not ended:
            return out


def scan_csv(s: Column, delimiters: str = ",", strings: tuple[str, ...] = (), quote_pairs: tuple[str, ...] = ('""', "''"), dialect: str = "escape-none", strip: bool = False) -> Column:
    """Fields by the full dialect scanner (several delimiters or quote pairs), in Arrow batches; :func:`split_csv` stays in the JVM."""
    pairs = {p[0]: p[-1] for p in quote_pairs}

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda line: None if line is None else _scan_csv(line, delimiters, list(strings), pairs, dialect, strip))

    return run(s)


def json_fields(s: Column, prefix: str = "", separator: str = ".") -> Column:
    """An object's leaves under dotted names; arrays stay JSON text; null without an object."""
    @F.pandas_udf(MAP)
    def run(x: pd.Series) -> pd.Series:
        import json

        def walk(o: dict, path: str, out: dict) -> dict:
            for k, v in o.items():
                if isinstance(v, dict):
                    walk(v, path + k + separator, out)
                else:
                    out[path + k] = v if isinstance(v, str) else ("" if v is None else json.dumps(v, separators=(",", ":")))
            return out

        def one(t: str | None) -> dict | None:
            try:
                o = json.loads(t)
            except (TypeError, ValueError):
                return None
            return walk(o, prefix, {}) if isinstance(o, dict) else None

        return x.map(one)

    return run(s)


def json_flat(s: Column) -> Column:
    """A flat object's members as a map, in the JVM."""
    return F.from_json(s, MAP)


def json_string(s: Column) -> Column:
    """Text as a JSON string, quoted."""
    a = F.to_json(F.array(s))
    return F.substring(a, F.lit(2), F.length(a) - 2)


def json_object(m: Column) -> Column:
    """A map as an object; values that are objects or arrays in JSON stand as such."""
    inner = lambda v: F.when(v.rlike(r"^\s*[\[{]") & F.get_json_object(v, "$").isNotNull(), v).when(v.isNull(), F.lit("null")).otherwise(json_string(v))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(json_string(e["key"]), F.lit(":"), inner(e["value"]))), ","), F.lit("}"))


def nested_json(m: Column, separator: str = ".") -> Column:
    """A map of dotted names as a nested JSON object, keys in order."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        import json

        def one(pairs) -> str | None:
            if pairs is None:
                return None
            root: dict = {}
            for k, v in sorted(dict(pairs).items()):
                node, parts = root, k.split(separator)
                for p in parts[:-1]:
                    nxt = node.get(p)
                    if not isinstance(nxt, dict):
                        nxt = node[p] = {}
                    node = nxt
                node[parts[-1]] = v
            return json.dumps(root, separators=(",", ":"), ensure_ascii=False)

        return x.map(one)

    return run(m)


def parse_xml(s: Column, prefix: str = "", attribute: str = "_", lists: bool = True, strip: bool = False, exclude: tuple[str, ...] = ()) -> Column:
    """Elements under dotted names; attributes after ``attribute``; repeated elements joined by commas; null where it isn't well formed."""
    @F.pandas_udf(MAP)
    def run(x: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET
        from fnmatch import fnmatchcase

        def walk(e: ET.Element, path: str, out: dict) -> None:
            if any(fnmatchcase(e.tag, p) for p in exclude):
                return
            name = f"{path}{e.tag}"
            text = (e.text or "") + "".join(c.tail or "" for c in e)
            text = text.strip() if strip or len(e) else text
            if text or not len(e):
                out[name] = f"{out[name]},{text}" if lists and name in out else out.get(name, "") + text
            for k, v in e.attrib.items():
                out[f"{name}.{attribute}{k}"] = v
            for c in e:
                walk(c, name + ".", out)

        def one(t: str | None) -> dict | None:
            try:
                root = ET.fromstring(t)
            except (TypeError, ET.ParseError):
                return None
            out: dict = {}
            walk(root, prefix, out)
            return out

        return x.map(one)

    return run(s)


def format_xml(m: Column, root: str = "Event") -> Column:
    """A flat map as elements of one root, keys in order."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit("<"), e["key"], F.lit(">"), esc(e["value"]), F.lit("</"), e["key"], F.lit(">"))), "")
    return F.concat(F.lit(f"<{root}>"), body, F.lit(f"</{root}>"))


def parse_windows_eventlog_xml(s: Column) -> Column:
    """System elements by name and Data elements by their Name attribute, without namespaces."""
    @F.pandas_udf(MAP)
    def run(x: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET

        def one(t: str | None) -> dict | None:
            try:
                root = ET.fromstring(t)
            except (TypeError, ET.ParseError):
                return None
            tag = lambda e: e.tag.rpartition("}")[2]
            out: dict = {}
            for part in root:
                for e in part:
                    name = f"{tag(part)}.{e.attrib['Name']}" if tag(e) == "Data" and "Name" in e.attrib else f"{tag(part)}.{tag(e)}"
                    if e.text and e.text.strip():
                        out[name] = e.text
                    for k, v in e.attrib.items():
                        if not (tag(e) == "Data" and k == "Name"):
                            out[f"{name}._{k}"] = v
            return out

        return x.map(one)

    return run(s)


_CEF = ("version", "device_vendor", "device_product", "device_version", "device_event_class_id", "name", "agent_severity")
_LEEF = ("version", "vendor", "product_name", "product_version", "event_id")


def _header(s: Column, n: int) -> Column:
    return F.regexp_extract_all(s, F.lit(r"((?:[^|\\]|\\.)*)(?:\||$)"), F.lit(1))


def parse_cef(s: Column) -> Column:
    """Header fields and extensions; null unless it begins with CEF: and has all header fields."""
    parts = _header(s, 8)
    unescape = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    head = [x for i, k in enumerate(_CEF) for x in (F.lit(k), unescape(F.regexp_replace(F.try_element_at(parts, F.lit(i + 1)), "^CEF:", "") if not i else F.try_element_at(parts, F.lit(i + 1))))]
    ext = F.regexp_replace(s, r"^(?:(?:[^|\\]|\\.)*\|){7}", "")
    pattern = r"(?:^|\s)([\w.\-]+)=((?:[^\\=]|\\.)*?)(?=\s+[\w.\-]+=|\s*$)"
    keys, values = F.regexp_extract_all(ext, F.lit(pattern), F.lit(1)), F.regexp_extract_all(ext, F.lit(pattern), F.lit(2))
    clean = F.transform(values, lambda v: F.replace(F.regexp_replace(v, r"\\([=\\|])", "$1"), F.lit("\\n"), F.lit("\n")))
    return F.when(s.rlike(r"^CEF:(?:(?:[^|\\]|\\.)*\|){7}"), F.map_concat(F.create_map(*head), F.map_filter(_pairs(F.arrays_zip(keys.alias("key"), clean.alias("value"))), lambda k, _: ~k.isin(*_CEF))))


def parse_leef(s: Column) -> Column:
    """LEEF 1 (tab) and 2 (its own delimiter, also as x and hex digits)."""
    parts = F.split(s, r"\|", 7)
    version = F.regexp_replace(F.try_element_at(parts, F.lit(1)), "^LEEF:", "")
    two = version.startswith("2")
    given = F.try_element_at(parts, F.lit(6))
    hexed = F.regexp_extract(given, "^(?:0?x)([0-9A-Fa-f]{1,4})$", 1)
    mark = F.when(~two | (given == ""), F.lit("\t")).when(hexed != "", F.char(F.conv(hexed, 16, 10).cast("int"))).otherwise(given)
    body = F.when(two, F.try_element_at(parts, F.lit(7))).otherwise(F.array_join(F.slice(parts, 6, 7), "|"))
    fields = F.filter(F.split(F.replace(body, mark, F.lit("\x01")), "\x01"), lambda f: f.contains("="))
    ext = F.transform(fields, lambda f: F.struct(F.substring_index(f, "=", 1).alias("key"), F.regexp_replace(f, "^[^=]*=", "").alias("value")))
    head = [x for i, k in enumerate(_LEEF) for x in (F.lit(k), version if not i else F.try_element_at(parts, F.lit(i + 1)))]
    return F.when(s.rlike(r"^LEEF:(?:[^|]*\|){5}"), F.map_concat(F.create_map(*head), F.map_filter(_pairs(ext), lambda k, _: ~k.isin(*_LEEF))))


def format_cef(header: list[Column], extensions: Column) -> Column:
    esc = lambda c: F.regexp_replace(c, r"([|\\])", r"\\$1")
    return F.concat(F.lit("CEF:"), F.concat_ws("|", *map(esc, header)), F.lit("|"), format_cef_extension(extensions))


def format_cef_extension(m: Column) -> Column:
    value = lambda c: F.replace(F.replace(F.regexp_replace(c, r"([=\\])", r"\\$1"), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), " ")


def format_leef(header: list[Column], extensions: Column) -> Column:
    value = lambda c: F.regexp_replace(c, "[\t\r\n]", " ")
    return F.concat(F.lit("LEEF:"), F.concat_ws("|", *header), F.lit("|"), F.array_join(F.transform(F.array_sort(F.map_entries(extensions)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), "\t"))


def parse_sdata(s: Column) -> Column:
    """``[id k="v" ...]...`` as id to map."""
    element = r'\[([^\s\]="]+)((?:\s+[^\s\]="]+="(?:[^"\\\]]|\\.)*")*)\s*\]'
    ids, bodies = F.regexp_extract_all(s, F.lit(element), F.lit(1)), F.regexp_extract_all(s, F.lit(element), F.lit(2))
    pair = r'([^\s\]="]+)="((?:[^"\\\]]|\\.)*)"'

    def params(b: Column) -> Column:
        values = F.transform(F.regexp_extract_all(b, F.lit(pair), F.lit(2)), lambda v: F.regexp_replace(v, r'\\(["\\\]])', "$1"))
        return _pairs(F.arrays_zip(F.regexp_extract_all(b, F.lit(pair), F.lit(1)).alias("key"), values.alias("value")))

    return F.map_from_arrays(F.array_distinct(ids), F.slice(F.transform(bodies, params), F.lit(1), F.size(F.array_distinct(ids))))


def format_sdata(sdata: Column) -> Column:
    esc = lambda c: F.regexp_replace(c, r'(["\\\]])', r"\\$1")
    one = lambda e: F.concat(F.lit("["), e["key"], F.array_join(F.transform(F.map_entries(e["value"]), lambda p: F.concat(F.lit(" "), p["key"], F.lit('="'), esc(p["value"]), F.lit('"'))), ""), F.lit("]"))
    return F.when(F.size(sdata) > 0, F.array_join(F.transform(F.map_entries(sdata), one), "")).otherwise(F.lit("-"))


def is_sdata_from_enterprise(sdata: Column, enterprise: str) -> Column:
    return F.exists(F.map_keys(sdata), lambda k: k.endswith("@" + enterprise))


def format_syslog_5424(pri: Column, stamp: Column, host: Column, program: Column, pid: Column, msgid: Column, sdata: Column, message: Column, octet_count: bool = False) -> Column:
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    line = F.concat(F.lit("<"), pri.cast("string"), F.lit(">1 "), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00 "), dash(host), F.lit(" "), dash(program), F.lit(" "), dash(pid), F.lit(" "), dash(msgid), F.lit(" "), format_sdata(sdata), F.lit(" "), F.coalesce(message, F.lit("")))
    return F.concat(F.octet_length(line).cast("string"), F.lit(" "), line) if octet_count else line


_MONTH_DAY = r"[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}"
_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"


def parse_syslog(s: Column, default_pri: int = 13, year: Column | None = None) -> dict[str, Column]:
    """RFC 5424 where the version digit says so, else RFC 3164 with BSD or ISO time; what fits neither is a message of the default priority."""
    from millrace.functions import dates

    new = rf"(?s)^<(\d{{1,3}})>1 (-|{_ISO}) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\"\]]|\"(?:[^\"\\]|\\.)*\")*\])+) ?\ufeff?(.*)$"
    old = rf"(?s)^(?:<(\d{{1,3}})>)?({_MONTH_DAY}|{_MONTH_DAY[:-10]}\d{{4}} \d{{2}}:\d{{2}}:\d{{2}}|{_ISO}) (\S+) (?:([^\s:\[]+)(?:\[([^\]]*)\])?: ?)?(.*)$"
    is_new, is_old = s.rlike(new), s.rlike(old)
    n, o = (lambda i: F.regexp_extract(s, new, i)), (lambda i: F.regexp_extract(s, old, i))
    dash = lambda c: F.nullif(c, F.lit("-"))
    bare = F.regexp_extract(s, r"^<(\d{1,3})>", 1).try_cast("int")
    stamp = lambda c: F.coalesce(F.try_to_timestamp(c), dates.strptime(c, "%b %e %H:%M:%S", "%b %e %Y %H:%M:%S", year=year))
    return {
        "pri": F.coalesce(F.when(is_new, n(1).try_cast("int")).otherwise(bare), F.lit(default_pri)),
        "stamp": F.when(is_new, F.try_to_timestamp(dash(n(2)))).when(is_old, stamp(o(2))),
        "host": F.when(is_new, dash(n(3))).when(is_old, o(3)),
        "program": F.when(is_new, dash(n(4))).when(is_old, F.nullif(o(4), F.lit(""))),
        "pid": F.when(is_new, dash(n(5))).when(is_old, F.nullif(o(5), F.lit(""))),
        "msgid": F.when(is_new, dash(n(6))),
        "sdata": F.when(is_new & (n(7) != "-"), parse_sdata(n(7))),
        "message": F.when(is_new, n(8)).when(is_old, o(6)).otherwise(F.regexp_replace(s, r"^<\d{1,3}>", "")),
    }
