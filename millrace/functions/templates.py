"""Templates: ``"$HOST ${.app.x:-none} $(func args)"`` compiled to one Column.

A :class:`Scope` resolves names: core columns, date macros with their R_/S_/C_/P_ prefixes, priority macros, then fields of
the ``nv`` map. ``:-`` gives a default where a name is unset. Functions nest; arguments split at spaces outside quotes and
parentheses. Aggregating functions (sum, context-values, ...) work on a scope that holds a group's rows as an array.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions import strings as S
from millrace.functions import text_formats as T
from millrace.functions import typed

SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "solaris-cron", *(f"local{i}" for i in range(8)))
CORE = {
    "HOST": "host", "HOST_FROM": "host_from", "FULLHOST": "host", "PROGRAM": "program", "PID": "pid", "MSGID": "msgid", "MESSAGE": "message", "MSG": "message", "MSGONLY": "message", "SOURCE": "source",
    "LEGACY_MSGHDR": "legacy_msghdr", "RAWMSG": "rawmsg", "TRANSPORT": "transport", "FILE_NAME": "file_name", "PEERIP": "peer_ip", "SOURCEIP": "peer_ip", "PEERPORT": "peer_port", "SEQNUM": "seqnum", "CONTEXT_ID": "context_id",
}
_TIMES = {"": "stamp", "S_": "stamp", "R_": "recvd", "P_": "processed"}


def _named(names: tuple[str, ...], code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (code + 1).cast("int"))


@dataclass
class Scope:
    """Where names come from: the columns of a table, and ``extra`` ones that go before them."""

    columns: frozenset[str]
    extra: dict[str, Column] = field(default_factory=dict)
    #: For aggregating functions: an array of the group's rows, oldest first.
    rows: Column | None = None
    functions: dict[str, Callable] = field(default_factory=dict)
    #: Templates by name, for ``$(template name)``.
    templates: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, **extra: Column) -> Scope:
        return cls(frozenset(df.columns), extra)

    def column(self, name: str) -> Column | None:
        return F.col(f"`{name}`") if name in self.columns else None

    def get(self, name: str, back: int | None = None) -> Column:
        """The text of a name, null where it is unset; ``back`` counts rows from the newest, 0 first."""
        if back is not None:
            if self.rows is None:
                raise ValueError(f"{name}@{back} needs a group")
            row, own = F.try_element_at(self.rows, F.lit(-(back + 1))), CORE.get(name, name)
            return row[own].cast("string") if own in self.columns else row["nv"][name] if "nv" in self.columns else F.lit(None).cast("string")
        if name in self.extra:
            return self.extra[name].cast("string")
        if self.rows is not None:
            return self.get(name, 0)
        own = self.column(CORE.get(name, name))
        if own is not None:
            return own.cast("string")
        pri = self.column("pri")
        if pri is not None:
            made = {"PRI": lambda: pri, "FACILITY_NUM": lambda: F.floor(pri / 8), "SEVERITY_NUM": lambda: pri % 8, "LEVEL_NUM": lambda: pri % 8, "FACILITY": lambda: _named(FACILITIES, F.floor(pri / 8)), "BSDTAG": lambda: F.concat(_named(SEVERITIES, pri % 8), F.lit("")), "TAG": lambda: F.lpad(F.lower(F.hex(pri.cast("bigint"))), 2, "0")} | {k: (lambda: _named(SEVERITIES, pri % 8)) for k in ("SEVERITY", "LEVEL", "PRIORITY")}
            if name in made:
                return made[name]().cast("string")
        if name == "TAGS" and "tags" in self.columns:
            return F.array_join("tags", ",")
        if name == "SDATA" and "sdata" in self.columns:
            return T.format_sdata(F.col("sdata"))
        if name == "MSGHDR" and {"program", "pid"} <= self.columns:
            return F.concat(F.col("program"), F.when(F.coalesce("pid", F.lit("")) != "", F.concat(F.lit("["), F.col("pid"), F.lit("]"))).otherwise(""), F.lit(": "))
        if name in ("UNIQID", "RCPTID"):
            return F.uuid() if name == "UNIQID" else F.monotonically_increasing_id().cast("string")
        if name == "LOGHOST":
            return F.lit(os.uname().nodename)
        for prefix, column in sorted(_TIMES.items(), reverse=True):
            if name.startswith(prefix) and name[len(prefix) :] in dates.MACROS and column in self.columns:
                return dates.macro(name[len(prefix) :], F.col(column), F.col("tz_offset") if "tz_offset" in self.columns and column == "stamp" else None)
        if name.startswith("C_") and name[2:] in dates.MACROS:
            return dates.macro(name[2:], F.current_timestamp())
        return F.col("nv")[name] if "nv" in self.columns else F.lit(None).cast("string")

    def pairs(self) -> Column:
        """All name-value pairs as a map."""
        return F.col("nv") if "nv" in self.columns else F.create_map(*[x for c in sorted(self.columns) for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])


def _split_args(text: str) -> list[str]:
    out, current, depth, quote, i, any_ = [], "", 0, "", 0, False
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and i + 1 < len(text) and quote == '"':
                current += text[i + 1]
                i += 2
                continue
            if c == quote:
                quote = ""
            else:
                current += c
        elif depth:
            depth += {"(": 1, ")": -1}.get(c, 0)
            current += c
        elif c in "\"'":
            quote, any_ = c, True
        elif c == "(":
            depth, current = 1, current + c
        elif c.isspace():
            if current or any_:
                out.append(current)
            current, any_ = "", False
        else:
            current += c
        i += 1
    if current or any_:
        out.append(current)
    return out


def parts_of(text: str) -> list[tuple]:
    """("lit", text), ("name", name, default or None, back or None) and ("call", name, [argument, ...]) pieces."""
    out: list[tuple] = []
    lit, i = "", 0

    def flush() -> None:
        nonlocal lit
        if lit:
            out.append(("lit", lit))
        lit = ""

    def back_at(j: int) -> tuple[int | None, int]:
        k = j
        if k < len(text) and text[k] == "@":
            k += 1
            while k < len(text) and text[k].isdigit():
                k += 1
            if k > j + 1:
                return int(text[j + 1 : k]), k
        return None, j

    while i < len(text):
        c = text[i]
        if c != "$" or i + 1 >= len(text):
            lit += c
            i += 1
        elif text[i + 1] == "$":
            lit += "$"
            i += 2
        elif text[i + 1] == "{":
            end = text.index("}", i)
            body = text[i + 2 : end]
            name, sep, default = body.partition(":-")
            name, at, number = name.partition("@") if "@" in name and name.rpartition("@")[2].isdigit() else (name, "", "")
            back, j = (int(number), end + 1) if at else back_at(end + 1)
            flush()
            out.append(("name", name, default if sep else None, back))
            i = j
        elif text[i + 1] == "(":
            depth, j = 1, i + 2
            while depth:
                depth += {"(": 1, ")": -1}.get(text[j], 0)
                j += 1
            args = _split_args(text[i + 2 : j - 1])
            flush()
            out.append(("call", args[0], args[1:]))
            i = j
        elif text[i + 1].isalnum() or text[i + 1] in "_.":
            j = i + 1
            while j < len(text) and (text[j].isalnum() or text[j] == "_" or (text[j] == "." and j == i + 1)):
                j += 1
            back, k = back_at(j)
            flush()
            out.append(("name", text[i + 1 : j], None, back))
            i = k
        else:
            lit += c
            i += 1
    flush()
    return out


def render(template: str, scope: Scope) -> Column:
    """The template as a string Column; unset names render as nothing."""
    pieces = []
    for p in parts_of(template):
        if p[0] == "lit":
            pieces.append(F.lit(p[1]))
        elif p[0] == "name":
            pieces.append(F.coalesce(scope.get(p[1], p[3]), F.lit(p[2] or "")))
        else:
            pieces.append(F.coalesce(call(p[1], p[2], scope).cast("string"), F.lit("")))
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0] if pieces else F.lit("")


def condition(text: str, scope: Scope) -> Column:
    """A condition (:mod:`millrace.functions.conditions`) over the scope."""
    from millrace.functions.conditions import as_column

    return as_column(text, scope)


def _options(args: list[str], *flags: str) -> tuple[dict[str, str], list[str]]:
    """Leading ``--name value`` and flag options, and what follows."""
    got: dict[str, str] = {}
    while args and args[0].startswith("-") and len(args[0]) > 1 and not args[0][1:].replace(".", "").isdigit() and ":" not in args[0]:
        name, sep, value = args[0].lstrip("-").partition("=")
        if sep:
            got[name], args = value, args[1:]
        elif name in flags:
            got[name], args = "", args[1:]
        else:
            got[name], args = args[1], args[2:]
    return got, args


def _group_numbers(template: str, scope: Scope) -> Column:
    """The whole numbers that a template gives over a group's rows."""
    return F.filter(F.transform(context_values(template, scope), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def context_values(template: str, scope: Scope) -> Column:
    if scope.rows is None:
        raise ValueError("this function needs a group")
    return F.transform(scope.rows, lambda r: render(template, RowScope(r, scope)))


class RowScope(Scope):
    """Names from one row struct of a group."""

    def __init__(self, row: Column, outer: Scope) -> None:
        super().__init__(outer.columns, {}, None, outer.functions, outer.templates)
        self.row = row

    def get(self, name: str, back: int | None = None) -> Column:
        own = CORE.get(name, name)
        return self.row[own].cast("string") if own in self.columns else self.row["nv"][name] if "nv" in self.columns else F.lit(None).cast("string")


def call(name: str, args: list[str], scope: Scope) -> Column:
    """A template function."""
    if name in scope.functions:
        return scope.functions[name](scope, *args)
    r = lambda i: render(args[i], scope)
    all_ = lambda a=args: [render(x, scope) for x in a]
    listed = lambda i: S.text_list(r(i))
    simple = {
        "echo": lambda: F.concat_ws(" ", *all_()), "length": lambda: F.concat_ws(" ", *[S.length(x).cast("string") for x in all_()]), "strip": lambda: F.concat_ws(" ", *map(S.strip, all_())),
        "lowercase": lambda: F.lower(F.concat_ws(" ", *all_())), "uppercase": lambda: F.upper(F.concat_ws(" ", *all_())), "or": lambda: S.first_of(*all_()), "if": lambda: F.when(condition(args[0], scope), r(1)).otherwise(r(2)),
        "substr": lambda: S.substr(r(0), int(args[1]), int(args[2]) if len(args) > 2 else None), "replace-delimiter": lambda: S.replace_delimiter(r(2), args[0], args[1]), "padding": lambda: S.padding(r(0), int(args[1]), args[2] if len(args) > 2 else " "),
        "binary": lambda: F.decode(F.unhex(F.lit("".join(f"{int(a, 0):02x}" for a in args))), "iso-8859-1"), "base64-encode": lambda: S.base64_encode(F.concat(*all_())), "indent-multi-line": lambda: S.indent_multi_line(r(0)),
        "dirname": lambda: S.dirname(r(0)), "basename": lambda: S.basename(r(0)), "implode": lambda: F.array_join(listed(1), args[0]), "explode": lambda: S.list_text(S.explode(args[0], r(1))),
        "list-concat": lambda: S.list_text(F.concat(*[S.text_list(x) for x in all_()])), "list-append": lambda: S.list_text(F.concat(listed(0), F.array(*all_(args[1:])))), "list-head": lambda: S.list_head(listed(0)),
        "list-tail": lambda: S.list_text(S.list_tail(listed(0))), "list-nth": lambda: S.list_nth(listed(1), int(args[0])), "list-count": lambda: F.size(F.concat(*[S.text_list(x) for x in all_()])).cast("string"),
        "round": lambda: S.rounded(r(0), int(args[1]) if len(args) > 1 else 0), "ceil": lambda: S.ceil(r(0)), "floor": lambda: S.floor(r(0)), "ipv4-to-int": lambda: F.coalesce(S.ipv4_to_int(r(0)).cast("string"), F.lit("")),
        "env": lambda: F.lit(os.environ.get(args[0], "")), "url-encode": lambda: F.concat(*map(S.urlencode, all_())), "url-decode": lambda: F.concat(*map(S.urldecode, all_())), "uuid": F.uuid,
        "names": lambda: S.list_text(F.array_sort(F.map_keys(_selected(args, scope)))), "values": lambda: S.list_text(F.transform(F.array_sort(F.map_entries(_selected(args, scope))), lambda e: e["value"])),
        "format-json": lambda: T.nested_json(_selected(args, scope)), "format-flat-json": lambda: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_selected(args, scope))))), "format-welf": lambda: T.format_welf(_selected(args, scope)),
        "format-cef-extension": lambda: T.format_cef_extension(_selected(args, scope)), "context-length": lambda: F.size(scope.rows).cast("string"), "context-values": lambda: S.list_text(F.concat(*[context_values(a, scope) for a in args])),
        "sum": lambda: _folded(args[0], scope, "sum"), "min": lambda: F.array_min(_group_numbers(args[0], scope)).cast("string"), "max": lambda: F.array_max(_group_numbers(args[0], scope)).cast("string"), "average": lambda: _folded(args[0], scope, "average"),
        "tags-head": lambda: F.try_element_at(F.filter(F.array(*map(F.lit, args)), lambda t: F.array_contains(F.col("tags"), t)), F.lit(1)),
    }
    if name in simple:
        return simple[name]()
    if name in ("+", "-", "*", "/", "%"):
        return S.generic_number(name, r(0), r(1))
    if name in ("grep", "context-lookup"):
        kept = F.filter(scope.rows, lambda row: condition(args[0], RowScope(row, scope)))
        values = F.transform(kept, lambda row: F.concat_ws(",", *[render(a, RowScope(row, scope)) for a in args[1:]]))
        return F.array_join(values, ",") if name == "grep" else S.list_text(values)
    if name == "template":  # a named template of the scope, or one made on the spot
        named = scope.templates.get(args[0])
        return render(named if named is not None else args[0], scope)
    if name == "getent":
        from millrace.operators.enrich import lookup

        return lookup(args[0], r(1))
    if name == "dns-resolve-ip":
        from millrace.operators.enrich import lookup

        return lookup("hosts", r(0))
    if name == "tag":
        hit = F.array_contains(F.col("tags"), args[0])
        return F.when(hit, r(1) if len(args) > 1 else F.lit("1")).otherwise(r(2) if len(args) > 2 else F.lit("" if len(args) > 1 else "0"))
    if name in ("map", "filter"):
        inner = lambda x: Scope(scope.columns, scope.extra | {"_": x}, scope.rows, scope.functions, scope.templates)
        if name == "map":
            return S.list_text(F.transform(listed(1), lambda x: render(args[0], inner(x))))
        return S.list_text(F.filter(listed(1), lambda x: condition(args[0], inner(x))))
    if name == "list-slice":
        lo, _, hi = args[0].partition(":")
        return S.list_text(S.list_slice(listed(1), int(lo) if lo else None, int(hi) if hi else None))
    if name == "list-search":
        o, rest = _options(args)
        return F.coalesce(S.list_search(S.text_list(render(rest[1], scope)), rest[0], o.get("mode", "literal"), int(o.get("start-index", 0))).cast("string"), F.lit(""))
    if name == "sanitize":
        o, rest = _options(args, "c", "no-ctrl-chars")
        return F.concat_ws("/", *[S.sanitize(x, o.get("i", o.get("invalid-chars", "/")), o.get("r", o.get("replacement", "_")), not {"c", "no-ctrl-chars"} & set(o)) for x in all_(rest)])
    if name in ("hash", "md5", "sha1", "sha256", "sha512"):
        o, rest = _options(args)
        return S.hash_(F.concat(*all_(rest)), "sha256" if name == "hash" else name, int(o["length"]) if "length" in o else None)
    if name == "format-date":
        o, rest = _options(args)
        column = {"stamp": "stamp", "recvd": "recvd", "processed": "processed"}[o.get("timestamp", "stamp")]
        offset = dates.zone_offset(F.col(column), o["time-zone"]) if "time-zone" in o else None
        return dates.strftime(" ".join(rest), F.col(column), offset)
    if name == "stardate":
        o, rest = _options(args)
        return dates.stardate(F.timestamp_seconds(render(rest[0], scope).try_cast("bigint")), int(o.get("digits", 2)))
    if name == "graphite-output":
        at = next((i for i, a in enumerate(args) if a.partition("=")[0] == "--timestamp"), None)
        cut = 0 if at is None else 1 if "=" in args[at] else 2
        stamp = render("$R_UNIXTIME" if at is None else args[at].partition("=")[2] or args[at + 1], scope)
        m = _selected(args if at is None else args[:at] + args[at + cut :], scope)
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(" "), e["value"], F.lit(" "), stamp, F.lit("\n"))), "")
    raise ValueError(f"unknown template function {name}")


def _folded(template: str, scope: Scope, how: str) -> Column:
    n = _group_numbers(template, scope)
    total = F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(F.size(n) > 0, total if how == "sum" else typed.int_div(total, F.size(n).cast("bigint"))).cast("string")


def _selected(args: list[str], scope: Scope) -> Column:
    """The pairs that value-pairs options choose: --scope, --key, --exclude, --pair name=template, --rekey prefix handling."""
    from millrace.operators import rewrites

    o: dict[str, list] = {"keys": [], "exclude": [], "pairs": [], "scopes": []}
    rekeys: list[tuple[str, list]] = []  # the glob of names, and what changes them
    it = iter(args)
    for a in it:
        option, _, value = a.partition("=")
        if option in ("--rekey", "--key", "-k") and rekeys and option != "--rekey":
            rekeys.append(("", []))  # a new --key ends the changes
        if option == "--rekey":
            rekeys.append((value or next(it, ""), []))
            o["keys"].append(rekeys[-1][0])
            continue
        if option in ("--shift", "--shift-levels", "--add-prefix", "--replace-prefix", "--replace", "--upper", "--lower"):
            if not rekeys or not rekeys[-1][0]:
                raise ValueError(f"{option} needs a --rekey before it")
            value = value or ("" if option in ("--upper", "--lower") else next(it, ""))
            old, _, new = value.partition("=")
            changes = {"--shift": lambda v=value: rewrites.shift(int(v)), "--shift-levels": lambda v=value: rewrites.shift_levels(int(v)), "--add-prefix": lambda v=value: rewrites.add_prefix(v), "--upper": lambda: rewrites.upper, "--lower": lambda: rewrites.lower}
            rekeys[-1][1].append(changes[option]() if option in changes else rewrites.replace_prefix(old, new))
            continue
        if option in ("--key", "-k", "--exclude", "-x", "--scope", "-s", "--pair", "-p") and not value:
            value = next(it, "")
        if option in ("--key", "-k"):
            o["keys"].append(value)
        elif option in ("--exclude", "-x"):
            o["exclude"].append(value)
        elif option in ("--scope", "-s"):
            o["scopes"] += value.split(",")
        elif option in ("--pair", "-p"):
            k, _, t = value.partition("=")
            o["pairs"].append((k, render(t, scope)))
        elif not option.startswith("-"):
            k, _, t = a.partition("=")
            o["pairs"].append((k, render(t, scope)))
    return rewrites.value_pairs(scope, **o, rekey=tuple(_fitting(glob, tuple(changes)) for glob, changes in rekeys if changes))


def _fitting(glob: str, changes: tuple[Callable, ...]) -> Callable:
    """A change of names that fit a glob."""

    def change(k: Column) -> Column:
        new = k
        for f in changes:
            new = f(new)
        return F.when(k.rlike(S.glob_to_regex(glob)), new).otherwise(k)

    return change
