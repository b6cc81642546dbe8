"""Parsers: text of an event to its fields. A row that doesn't parse passes unchanged, or goes with ``drop``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions import text_formats as T
from millrace.functions.strings import java_regex, named_groups, text_list
from millrace.functions.templates import Scope, render
from millrace.functions.typed import merged, merged_once
from millrace.session import bound_batches



def _text(df: DataFrame, template: str | None) -> Column:
    return F.col("message") if template is None else render(template, Scope.of(df))


def _apply(df: DataFrame, pairs: Column, drop: bool) -> DataFrame:
    """Parsed once in a column of its own, so that test and use share the work."""
    d = df.withColumn("__parsed", pairs)
    if drop:
        d = d.where(F.col("__parsed").isNotNull())
    none = F.create_map().cast("map<string,string>")
    return d.withColumn("nv", merged_once(F.col("nv"), F.coalesce("__parsed", none))).drop("__parsed")


def csv_parser(df: DataFrame, columns: list[str], delimiters: str = ",", quotes: str = '"', dialect: str = "escape-double-char", strings: tuple[str, ...] = (), quote_pairs: tuple[str, ...] = (), prefix: str = "", strip: bool = False, greedy: bool = False, null: str | None = None, template: str | None = None, drop_invalid: bool = False) -> DataFrame:
    """One delimiter and quote stay in the JVM; more go through the dialect scanner in Arrow batches."""
    s = _text(df, template)
    if len(delimiters) == 1 and len(quotes) <= 1 and not strings and not quote_pairs and dialect != "escape-backslash-with-sequences":
        pairs = T.parse_csv(s, columns, delimiters, quotes or '"', dialect, strip, greedy, null, prefix)
        n = F.size(T.split_csv(s, delimiters, quotes or '"', dialect))
    else:
        d = df.withColumn("__fields", T.scan_csv(s, delimiters, strings, quote_pairs or tuple(q * 2 for q in quotes), dialect, strip))
        f = F.col("__fields")
        items = [F.when(F.try_element_at(f, F.lit(i + 1)).isNotNull() & (F.try_element_at(f, F.lit(i + 1)) != F.lit(null) if null is not None else F.lit(True)), F.struct(F.lit(prefix + c).alias("key"), F.try_element_at(f, F.lit(i + 1)).alias("value"))) for i, c in enumerate(columns)]
        return _apply(d, F.when(F.size(f) == len(columns) if drop_invalid else F.lit(True), F.map_from_entries(F.filter(F.array(*items), lambda e: e.isNotNull()))), drop_invalid).drop("__fields")
    if drop_invalid:
        pairs = F.when((n >= len(columns)) if greedy else (n == len(columns)), pairs)
    return _apply(df, pairs, drop_invalid)


def kv_parser(df: DataFrame, value_separator: str = "=", pair_separator: str = ", ", prefix: str = "", stray_words_into: str | None = None, template: str | None = None) -> DataFrame:
    s = _text(df, template)
    pairs = T.parse_kv(s, value_separator, pair_separator, prefix)
    if stray_words_into:
        pairs = merged(pairs, F.create_map(F.lit(stray_words_into), T.stray_words(s, value_separator)))
    return _apply(df, pairs, False)


_AUDIT = ("name", "proctitle", "path", "dir", "comm", "ocomm", "data", "old", "new")


def linux_audit_parser(df: DataFrame, prefix: str = ".auditd.", template: str | None = None) -> DataFrame:
    """Pairs whose unquoted value is hexadecimal text are decoded for the fields that carry such."""
    s = _text(df, template)
    raw = T.parse_kv(s, "=", " ")
    quoted_ = lambda k: s.contains(F.concat(k, F.lit('="')))
    hexed = lambda k, v: (k.isin(*_AUDIT) | k.rlike(r"^a\d+$")) & ~quoted_(k) & v.rlike("^(?:[0-9A-F]{2})+$") & (F.length(v) > 2)
    plain = F.transform_values(raw, lambda k, v: F.when(hexed(k, v), F.regexp_replace(F.decode(F.unhex(v), "utf-8"), "\x00", "\t")).otherwise(v))
    return _apply(df, F.transform_keys(plain, lambda k, _: F.concat(F.lit(prefix), k)), False)


def json_parser(df: DataFrame, prefix: str = "", marker: str | None = None, extract_prefix: str | None = None, key_delimiter: str = ".", template: str | None = None, drop: bool = True) -> DataFrame:
    """Leaves under dotted names; with a marker, only text that begins with it; of an inner object with ``extract_prefix``."""
    s = _text(df, template)
    if marker is not None:
        s = F.when(F.ltrim(s).startswith(marker), F.substring(F.ltrim(s), F.lit(len(marker) + 1), F.length(s)))
    if extract_prefix:
        s = F.get_json_object(s, "$." + extract_prefix)
    return _apply(df, T.json_fields(s, prefix, key_delimiter), drop)


def xml_parser(df: DataFrame, prefix: str = ".xml.", exclude: tuple[str, ...] = (), strip: bool = False, lists: bool = True, template: str | None = None, drop_invalid: bool = False) -> DataFrame:
    bound_batches(df.sparkSession)
    return _apply(df, T.parse_xml(_text(df, template), prefix, lists=lists, strip=strip, exclude=exclude), drop_invalid)


def windows_eventlog_xml_parser(df: DataFrame, prefix: str = ".eventlog.", template: str | None = None, drop_invalid: bool = False) -> DataFrame:
    bound_batches(df.sparkSession)
    m = T.parse_windows_eventlog_xml(_text(df, template))
    return _apply(df, F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k)), drop_invalid)


def regexp_parser(df: DataFrame, patterns: list[str], prefix: str = "", flags: tuple[str, ...] = (), template: str | None = None, drop: bool = True) -> DataFrame:
    """Named groups of the first pattern that matches."""
    s = _text(df, template)
    made = []
    for p in patterns:
        j = java_regex(p, flags)
        pairs = [x for i, n in named_groups(p) for x in (F.lit(prefix + n), F.regexp_extract(s, j, i))]
        made.append(F.when(s.rlike(j), F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")))
    return _apply(df, F.coalesce(*made), drop)


def date_parser(df: DataFrame, *formats: str, template: str | None = None, time_zone: str | None = None, time_stamp: str = "stamp", drop: bool = True) -> DataFrame:
    """The first format that fits sets a stamp."""
    t = dates.strptime(_text(df, template), *formats)
    if time_zone:
        t = dates.fix_timezone(t, time_zone)
    d = df.withColumn("__t", t)
    d = d.where(F.col("__t").isNotNull()) if drop else d
    return d.withColumn(time_stamp, F.coalesce("__t", time_stamp)).drop("__t")


def syslog_parser(df: DataFrame, template: str | None = None, default_pri: int = 13, year: Column | None = None) -> DataFrame:
    p = T.parse_syslog(_text(df, template), default_pri, year)
    d = df.withColumns({f"__{k}": v for k, v in p.items()})
    keep = {"stamp": F.coalesce("__stamp", "stamp"), "host": F.coalesce("__host", "host")}
    d = d.withColumns({k: keep.get(k, F.coalesce(F.col(f"__{k}"), F.create_map().cast("map<string,map<string,string>>")) if k == "sdata" else F.col(f"__{k}")) for k in p})
    return d.drop(*[f"__{k}" for k in p])


def sdata_parser(df: DataFrame, prefix: str = ".SDATA.", template: str | None = None) -> DataFrame:
    s = T.parse_sdata(_text(df, template))
    flat = F.flatten(F.transform(F.map_entries(s), lambda e: F.transform(F.map_entries(e["value"]), lambda p: F.struct(F.concat(F.lit(prefix), e["key"], F.lit("."), p["key"]).alias("key"), p["value"].alias("value")))))
    return _apply(df, F.map_from_entries(flat), False)


def tags_parser(df: DataFrame, template: str | None = None) -> DataFrame:
    return df.withColumn("tags", F.array_union("tags", text_list(_text(df, template))))


def snmptrapd_parser(df: DataFrame, prefix: str = ".snmp.", template: str | None = None, drop: bool = True) -> DataFrame:
    """Time stamp, host and transport, then ``name = TYPE: value`` variables."""
    s = _text(df, template)
    head = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\S+) \[(.*?)\](?::|\s).*"
    pattern = r"(?:^|\s)([\w.:\-]+(?:\.\d+)*)\s=\s([A-Za-z0-9]+(?: [A-Za-z]+)?):\s?(.*?)(?=,?\s+[\w:\-]+[\w.:\-]*\s=\s|\s*$)"
    keys, values = (F.regexp_extract_all(s, F.lit(pattern), F.lit(i)) for i in (1, 3))
    clean = F.transform(values, lambda v: F.regexp_replace(v, '^"|"$', ""))
    pairs = T._pairs(F.arrays_zip(F.transform(keys, lambda k: F.concat(F.lit(prefix), k)).alias("key"), clean.alias("value")))
    ok = s.rlike("(?s)" + head)
    got = merged(pairs, F.create_map(F.lit(prefix + "hostname"), F.regexp_extract(s, head, 2), F.lit(prefix + "transport_info"), F.regexp_extract(s, head, 3)))
    return _apply(df, F.when(ok, got), drop)


# application presets, composed from the above

APACHE = r'^(?<clientip>\S+) (?<ident>\S+) (?<auth>\S+) \[(?<timestamp>[^\]]+)\] "(?<rawrequest>(?<verb>\S+) (?<request>\S+)(?: HTTP/(?<httpversion>[\d.]+))?|[^"]*)" (?<response>\d{3}|-) (?<bytes>\d+|-)(?: "(?<referrer>[^"]*)" "(?<agent>[^"]*)")?'
PRESETS: dict[str, list[str]] = {
    "apache-accesslog": [APACHE],
    "apache-accesslog-vhost": [r"^(?<vhost>[^:\s]+):(?<port>\d+) " + APACHE[1:]],
    "cisco": [r"^(?:(?<seqno>\d+): )?(?:(?<origin>[^:\s]+): )?[*.]?(?<time>[A-Z][a-z]{2}\s+\d+(?: \d{4})? \d\d:\d\d:\d\d(?:\.\d+)?)(?: \w+)?: %(?<facility>[A-Z0-9_]+)-(?:(?<subfacility>[A-Z0-9_]+)-)?(?<severity>[0-7])-(?<mnemonic>[A-Z0-9_]+): (?<message>.*)$"],
    "sudo": [r"^\s*(?<subject>\S+) : (?<error>[^;=]+ ; )?TTY=(?<tty>\S+) ; PWD=(?<pwd>.*?) ; USER=(?<user>\S+)(?: ; GROUP=(?<group>\S+))?(?: ; ENV=(?<env>.*?))? ; COMMAND=(?<command>.*)$"],
    "qbittorrent": [r"^\((?<level>[A-Z])\) (?<time>\S+) - (?<message>.*)$"],
    "jellyfin": [r"^\[(?<time>[^\]]+)\] \[(?<level>\w+)\] \[(?<thread>\d+)\] (?<class>[^:]+): (?<message>(?s:.*))$"],
    "pihole-ftl": [r"^\[(?<time>[^\]]+?) (?<process>[^\]]+)\] (?:(?<level>[A-Z]+): )?(?<message>.*)$"],
    "arr": [r"^(?<time>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d)\|(?<level>\w+)\|(?<module>[^|]+)\|(?<message>(?s:.*))$"],
    "solaris-msgid": [r"^(?:\[ID (?<msgid>\d+) (?<facility>\w+)\.(?<severity>\w+)\] )(?<message>.*)$"],
    "netskope-head": [r"^<(?<pri>\d+)>(?<json>\{.*\})$"],
}
KV_PRESETS = {"iptables": ("=", " "), "fortigate": ("=", " "), "checkpoint": (":", ";"), "websense": ("=", " ")}
PANOS_TRAFFIC = ["future_use1", "receive_time", "serial_number", "type", "subtype", "future_use2", "generated_time", "src_ip", "dst_ip", "nat_src_ip", "nat_dst_ip", "rule_name", "src_user", "dst_user", "app", "vsys", "src_zone", "dst_zone"]
PANOS_SYSTEM = ["future_use1", "receive_time", "serial_number", "type", "subtype", "future_use2", "generated_time", "vsys", "event_id", "object", "future_use3", "future_use4", "module", "severity", "description"]
POSTGRESQL = ["time", "user", "database", "pid", "connection", "session_id", "session_line", "command_tag", "session_start", "virtual_transaction", "transaction", "severity", "sql_state_code", "message", "detail", "hint", "internal_query", "internal_query_pos", "context", "query", "query_pos", "location", "application_name"]
MARIADB_AUDIT = ["timestamp", "serverhost", "username", "host", "connectionid", "queryid", "operation", "database", "object", "retcode"]


def preset(df: DataFrame, name: str, prefix: str | None = None, template: str | None = None, drop: bool = True) -> DataFrame:
    """An application's log by its preset."""
    prefix = f".{name.split('-')[0]}." if prefix is None else prefix
    if name in PRESETS:
        return regexp_parser(df, PRESETS[name], prefix, template=template, drop=drop)
    if name in KV_PRESETS:
        return kv_parser(df, *KV_PRESETS[name], prefix=prefix, template=template)
    tables = {"panos": PANOS_TRAFFIC, "panos-system": PANOS_SYSTEM, "postgresql-csvlog": POSTGRESQL, "mariadb-audit": MARIADB_AUDIT}
    if name in tables:
        return csv_parser(df, tables[name], prefix=prefix, template=template, drop_invalid=False)
    if name == "netskope":
        return json_parser(df, prefix, template=template, drop=drop)
    raise ValueError(f"no preset {name}; there are {sorted([*PRESETS, *KV_PRESETS, *tables, 'netskope'])}")


def app_parser(df: DataFrame, applications: list[tuple[str, Column, str]], drop: bool = False) -> DataFrame:
    """First match of an ordered chain: (application, filter, preset). One pass: each row keeps the first fields that a fitting preset gives."""
    d, found = df, []
    for app, test, name in applications:
        regex = PRESETS[name]
        s = F.col("message")
        pairs = [F.when(s.rlike(java_regex(p)), F.create_map(*[x for n_, n in named_groups(p) for x in (F.lit(f".{app}.{n}"), F.regexp_extract(s, java_regex(p), n_))], F.lit(".app.name"), F.lit(app))) for p in regex]
        found.append(F.when(F.coalesce(test, F.lit(False)), F.coalesce(*pairs)))
    return _apply(d, F.coalesce(*found), drop)


def kmsg_parser(df: DataFrame, template: str | None = None, prefix: str = ".linux.") -> DataFrame:
    """Kernel ring buffer: ``pri,seq,usec,flags;text`` and indented ``KEY=value`` lines."""
    s = _text(df, template)
    head = r"(?s)^(\d+),(\d+),(\d+),([^;,]*)[^;]*;([^\n]*)(.*)$"
    extra = T._pairs(F.arrays_zip(F.transform(F.regexp_extract_all(s, F.lit(r"\n ([A-Z_]+)=([^\n]*)"), F.lit(1)), lambda k: F.concat(F.lit(prefix), k)).alias("key"), F.regexp_extract_all(s, F.lit(r"\n ([A-Z_]+)=([^\n]*)"), F.lit(2)).alias("value")))
    got = merged(extra, F.create_map(F.lit(prefix + "sequence"), F.regexp_extract(s, head, 2), F.lit(prefix + "timestamp"), F.regexp_extract(s, head, 3)))
    ok = s.rlike(head)
    d = df.withColumns({"pri": F.when(ok, F.regexp_extract(s, head, 1).try_cast("int")).otherwise(F.col("pri")), "program": F.when(ok, F.lit("kernel")).otherwise(F.col("program")), "nv": F.when(ok, merged(F.col("nv"), got)).otherwise(F.col("nv")), "__m": F.when(ok, F.regexp_extract(s, head, 5)).otherwise(F.col("message"))})
    return d.withColumn("message", F.col("__m")).drop("__m")


def python_parser(df: DataFrame, parse, schema=None) -> DataFrame:
    """A user's function of a row dict: it changes the dict and says whether to keep the row. Arrow batches."""

    def run(it):
        import pyarrow as pa

        for b in it:
            rows = [r for r in b.to_pylist() if parse(r)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=b.schema if schema is None else None)

    return df.mapInArrow(run, schema or df.schema)


