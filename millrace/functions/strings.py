"""String, digest, encoding and list functions as Columns. Lengths and cuts count bytes where the name says so."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REGEX_SPECIAL = set(r"\.^$|()[]{}*+?-&~#")


def quoted(text: str) -> str:
    """A literal for Java's and Python's regexes alike."""
    return "".join("\\" + c if c in REGEX_SPECIAL else c for c in text)


def length(s: Column) -> Column:
    """Bytes."""
    return F.octet_length(s).cast("bigint")


def lower(s: Column) -> Column:
    """A-Z only; the template function uses :func:`pyspark.sql.functions.lower`."""
    return F.translate(s, _UPPER, _LOWER)


def upper(s: Column) -> Column:
    return F.translate(s, _LOWER, _UPPER)


def strip(s: Column) -> Column:
    return F.trim(s, F.lit(WHITE))


def lstrip(s: Column) -> Column:
    return F.ltrim(s, F.lit(WHITE))


def rstrip(s: Column) -> Column:
    return F.rtrim(s, F.lit(WHITE))


def replace(s: Column, old: str, new: str, limit: int | None = None) -> Column:
    """Literal; with a limit the first places only."""
    if not old:
        return s
    if limit is None:
        return F.replace(s, F.lit(old), F.lit(new))
    if limit <= 0:
        return s
    parts = F.split(s, quoted(old), limit + 1)
    return F.array_join(parts, new)


def _any(test, s: Column, needles, ignore_case: bool) -> Column:
    needles = [needles] if isinstance(needles, str) else list(needles)
    s = lower(s) if ignore_case else s
    r = F.lit(False)
    for n in needles:
        r = r | test(s, "".join(c.lower() if c in _UPPER else c for c in n) if ignore_case else n)
    return r


def startswith(s: Column, needles, ignore_case: bool = False) -> Column:
    return _any(lambda c, n: c.startswith(n), s, needles, ignore_case)


def endswith(s: Column, needles, ignore_case: bool = False) -> Column:
    return _any(lambda c, n: c.endswith(n), s, needles, ignore_case)


def includes(s: Column, needles, ignore_case: bool = False, limit: int | None = None) -> Column:
    """Whether any needle occurs, in the first ``limit`` bytes if given."""
    if limit is not None:
        s = F.substring(s.cast("binary"), 1, limit).cast("string")
    return _any(lambda c, n: c.contains(n), s, needles, ignore_case)


def strcasecmp(a: Column, b: Column) -> Column:
    a, b = lower(a), lower(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def utf8_validate(b: Column) -> Column:
    return F.is_valid_utf8(b.cast("string"))


def utf8_sanitize(b: Column) -> Column:
    """Valid text as it is; text with an invalid sequence has each byte from 128 on as ``\\xNN``."""
    s = b.cast("string")
    pairs = F.regexp_extract_all(F.hex(b.cast("binary")), F.lit("(..)"), F.lit(1))
    spelled = F.transform(pairs, lambda h: F.when(h >= "80", F.concat(F.lit("\\x"), F.lower(h))).otherwise(F.decode(F.unhex(h), "utf-8")))
    return F.when(F.is_valid_utf8(s), s).otherwise(F.array_join(spelled, ""))


def glob_to_regex(pattern: str, path: bool = False) -> str:
    """An anchored regex: ``*`` and ``?``; with ``path``, they don't cross ``/``, ``[...]`` is a class and a leading dot must be spelled out."""
    out, i = [], 0
    any_ = "[^/]" if path else "."
    while i < len(pattern):
        c = pattern[i]
        if c in "*?" and path and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?!\\.)")
        if c == "*":
            out.append(any_ + "*")
        elif c == "?":
            out.append(any_)
        elif c == "[" and path and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and path and i + 1 < len(pattern):
            i += 1
            out.append(quoted(pattern[i]))
        else:
            out.append(quoted(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(s: Column, patterns) -> Column:
    """Whether a file-name pattern fits, as fnmatch has it for paths."""
    r = F.lit(False)
    for p in [patterns] if isinstance(patterns, str) else patterns:
        r = r | s.rlike(glob_to_regex(p, path=True))
    return r


def java_regex(pattern: str, flags: tuple[str, ...] = ()) -> str:
    """A PCRE pattern for Java: named groups respelled, what Java can't do refused when the plan is built."""
    for bad in ("(?R)", "(?0)", "(?1)", "\\K", "(*", "(?P>", "(?&", "\\g{"):
        if bad in pattern:
            raise ValueError(f"{bad} has no counterpart in Java's regexes: {pattern}")
    pattern = pattern.replace("(?P<", "(?<")
    pattern = re.sub(r"\(\?<([A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9_.-]*)?)>", lambda m: f"(?<{group_name(m[1])}>", pattern)
    pattern = pattern.replace("[[:alpha:]]", "\\p{Alpha}").replace("[[:digit:]]", "\\d").replace("[[:space:]]", "\\s").replace("[[:alnum:]]", "\\p{Alnum}").replace("[[:punct:]]", "\\p{Punct}")
    letters = "".join(x for f, x in (("ignore-case", "i"), ("newline", "s"), ("multi-line", "m")) if f in flags)
    return f"(?{letters}){pattern}" if letters else pattern


def group_name(name: str) -> str:
    """Java allows letters and digits only."""
    return "".join(c if c.isalnum() else f"Z{ord(c)}Z" for c in name)


def named_groups(pattern: str) -> list[tuple[int, str]]:
    """Number and name of the named groups of a PCRE pattern."""
    return [(i, n) for n, i in re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern.replace("(?P<", "(?<"))).groupindex.items()]


def regexp_search(s: Column, pattern: str, keep_zero: bool = False, list_mode: bool = False) -> Column:
    """The captures: a map by number or name, or an array (unmatched groups null); empty without a match. Group 0 is there if no other is, or if asked for."""
    n = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern.replace("(?P<", "(?<"))).groups
    names = dict(named_groups(pattern))
    j = java_regex(pattern)
    take = [i for i in range(n + 1) if i or keep_zero or not n]
    hit = s.rlike(j)
    got = {i: F.regexp_extract(s, j, i) for i in take}
    if list_mode:
        kind = "array<string>"
        return F.when(hit, F.array(*[F.when(g != "", g) if i else g for i, g in got.items()])).when(s.isNotNull(), F.array().cast(kind))
    pairs = [x for i, g in got.items() for x in (F.lit(names.get(i, str(i))), g)]
    return F.when(hit, F.create_map(*pairs)).when(s.isNotNull(), F.create_map().cast("map<string,string>"))


def regexp_subst(s: Column, pattern: str, replacement: str, global_: bool = False, ignore_case: bool = False, newline: bool = False, groups: bool = True) -> Column:
    """First place or all; ``\\1`` names a group."""
    j = java_regex(pattern, tuple(f for f, on in (("ignore-case", ignore_case), ("newline", newline)) if on))
    r = re.sub(r"\\\\(\d)", r"$\1", re.sub(r"([\\$])", r"\\\1", replacement)) if groups else re.sub(r"([\\$])", r"\\\1", replacement)
    if global_:
        return F.regexp_replace(s, j, r)
    n = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern.replace("(?P<", "(?<"))).groups
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 1}", r)
    # all that follows the first place is one more group, put back
    body = re.sub(r"\\(\d)", lambda m: "\\" + str(int(m[1]) + 1), j) if n else j
    return F.regexp_replace(s, f"(?s)^(.*?)(?-s:(?:{body}))(.*)$", "$1" + shifted + f"${n + 2}")


def md5(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def sha1(x: Column) -> Column:
    return F.sha1(x.cast("binary"))


def sha2(x: Column, bits: int) -> Column:
    return F.sha2(x.cast("binary"), bits)


def digest(x: Column, alg: str = "sha256") -> Column:
    """Raw bytes."""
    hexed = {"md5": md5, "sha1": sha1, "sha224": lambda c: sha2(c, 224), "sha256": lambda c: sha2(c, 256), "sha384": lambda c: sha2(c, 384), "sha512": lambda c: sha2(c, 512)}
    if alg not in hexed:
        raise ValueError(f"unknown digest {alg}")
    return F.unhex(hexed[alg](x))


def hash_(x: Column, alg: str = "sha256", length_: int | None = None) -> Column:
    """Hex of a digest, cut to a length."""
    h = F.lower(F.hex(digest(x, alg)))
    return h if length_ is None else F.substring(h, 1, length_)


def base64_encode(x: Column) -> Column:
    return F.base64(x.cast("binary"))


def base64_decode(x: Column) -> Column:
    return F.try_to_binary(x, F.lit("base64"))


def urlencode(s: Column) -> Column:
    """RFC 3986: space is %20, the tilde stands."""
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def urldecode(s: Column) -> Column:
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def hex_encode(x: Column) -> Column:
    return F.lower(F.hex(x.cast("binary")))


def hex_decode(s: Column) -> Column:
    return F.when(s.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(s))


def uuid4() -> Column:
    return F.uuid()


def uuid7(now: Column | None = None) -> Column:
    """Milliseconds lead, the rest is random."""
    ms = F.unix_millis(now if now is not None else F.current_timestamp())
    head, r = F.lpad(F.lower(F.hex(ms)), 12, "0"), F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4), F.lit("-7"), F.substring(r, 14, 3), F.lit("-"), F.substring(r, 17, 4), F.lit("-"), F.substring(r, 21, 12))


# template functions


def substr(s: Column, start: int, size: int | None = None) -> Column:
    """Bytes from a place, negative from the end; a negative size leaves so many at the end. Out of range gives nothing."""
    n = F.octet_length(s)
    b = s.cast("binary")
    size_ = F.lit(size) if size is not None else n
    at = F.lit(start) if start >= 0 else n + start
    count = F.when(size_ < 0, n - at + size_).otherwise(F.least(size_, n))
    bad = (F.lit(start) >= n) | (at < 0) | (count < 0)
    return F.when(bad, F.lit("")).otherwise(F.substring(b, (at + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int")).cast("string"))


def sanitize(s: Column, invalid: str = "/", replacement: str = "_", control: bool = True) -> Column:
    """Characters that may not stand in a file name, and control ones."""
    r = F.translate(s, invalid, replacement * len(invalid))
    return F.regexp_replace(r, r"[\x00-\x1f]", replacement) if control else r


def replace_delimiter(s: Column, delimiters: str, new: str) -> Column:
    return F.regexp_replace(s, "[" + "".join(map(quoted, delimiters)) + "]", new.replace("\\", "\\\\").replace("$", "\\$"))


def padding(s: Column, width: int, pad: str = " ") -> Column:
    """On the left; never cuts."""
    return F.when(F.octet_length(s) < width, F.lpad(s, F.lit(width) - F.octet_length(s) + F.length(s), F.lit(pad))).otherwise(s)


def indent_multi_line(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit("\n\t"))


def dirname(s: Column) -> Column:
    return F.when(~s.contains("/"), F.lit(".")).otherwise(F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(s, "/+$", ""), "^(.*?)/+[^/]*$", 1), F.lit("")), F.lit("/")))


def basename(s: Column) -> Column:
    return F.substring_index(F.regexp_replace(s, "(?<=.)/+$", ""), "/", -1)


def first_of(*parts: Column) -> Column:
    """``$(or ...)``: the first that isn't empty."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))


def ipv4_to_int(s: Column) -> Column:
    """The address as an unsigned number, null if it isn't one."""
    part = [F.regexp_extract(s, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("bigint") for i in (1, 2, 3, 4)]
    fits = (part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256)
    return F.when(fits, part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3])


def in_subnet(s: Column, cidr: str) -> Column:
    """IPv4 containment by a range test that stays in generated code."""
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version != 4:
        return in_subnet6(s, cidr)
    return F.coalesce(ipv4_to_int(s).between(int(net.network_address), int(net.broadcast_address)), F.lit(False))


def in_subnet6(s: Column, cidr: str) -> Column:
    """IPv6 containment; addresses have too many spellings for a pattern, so Arrow batches go to Python."""
    @F.pandas_udf("boolean")
    def inside(x: pd.Series) -> pd.Series:
        net = ipaddress.ip_network(cidr, strict=False)

        def one(a) -> bool:
            try:
                return ipaddress.ip_address(a) in net
            except ValueError:
                return False

        return x.map(one).astype(bool)

    return inside(s)


# lists


def list_head(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def list_tail(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))


def list_nth(a: Column, n: int) -> Column:
    """From 0; negative from the end."""
    return F.try_element_at(a, F.lit(n + 1 if n >= 0 else n))


def list_slice(a: Column, start: int | None = None, end: int | None = None) -> Column:
    """As Python's ``a[start:end]``."""
    n = F.size(a)
    at = lambda x, default: F.lit(default) if x is None and default is not None else n if x is None else F.least(F.lit(x), n) if x >= 0 else F.greatest(n + x, F.lit(0))
    lo, hi = at(start, 0), at(end, None)
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def list_search(a: Column, needle: str, mode: str = "literal", start: int = 0) -> Column:
    """Index from 0 of the first fitting element at or after ``start``, or null."""
    tests = {
        "literal": lambda x: x == needle,
        "prefix": lambda x: x.startswith(needle),
        "substring": lambda x: x.contains(needle),
        "glob": lambda x: x.rlike(glob_to_regex(needle)),
        "pcre": lambda x: x.rlike(java_regex(needle)),
    }
    hits = F.filter(F.transform(a, lambda x, i: F.when(tests[mode](x) & (i >= start), i)), lambda x: x.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def implode(separator: str, a: Column) -> Column:
    return F.array_join(a, separator)


def explode(separator: str, s: Column) -> Column:
    """Parts between a literal separator; the empty string has none."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, quoted(separator)))


def list_text(a: Column) -> Column:
    """The list format: comma joined, elements quoted where they hold a comma, quote or space."""
    return F.array_join(F.transform(a, lambda x: F.when(x.rlike(r'[,"\s\\]') | (x == ""), F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(x)), ",")


def text_list(s: Column) -> Column:
    """The elements of list text."""
    items = F.regexp_extract_all(s, F.lit(r'(?:^|,)("(?:[^"\\]|\\.)*"|[^,]*)'), F.lit(1))
    clean = F.transform(items, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), r"\\(.)", "$1")).otherwise(x))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(clean)


def generic_number(op: str, a: Column, b: Column) -> Column:
    """``$(+ a b)`` and its kin on text: whole numbers stay whole, a bad operand or division by zero gives NaN."""
    whole = r"^\s*[+-]?\d+$"
    x, y = a.try_cast("bigint"), b.try_cast("bigint")
    u, v = a.try_cast("double"), b.try_cast("double")
    ints = a.rlike(whole) & b.rlike(whole)
    from millrace.functions.typed import int_div

    by_int = {"+": F.try_add(x, y), "-": F.try_subtract(x, y), "*": F.try_multiply(x, y), "/": int_div(x, y), "%": F.try_mod(x, y)}[op]
    by_double = {"+": u + v, "-": u - v, "*": u * v, "/": F.try_divide(u, v), "%": F.try_mod(u, v)}[op]
    return F.coalesce(F.when(ints, by_int.cast("string")).otherwise(by_double.cast("string")), F.lit("NaN"))


def rounded(a: Column, digits: int = 0) -> Column:
    """Half away from zero, with so many digits; NaN for what isn't a number."""
    v = a.try_cast("double")
    return F.coalesce(F.format_string(f"%.{digits}f", F.round(v, digits)) if digits else F.round(v).cast("bigint").cast("string"), F.lit("NaN"))


def ceil(a: Column) -> Column:
    return F.coalesce(F.ceil(a.try_cast("double")).cast("string"), F.lit("NaN"))


def floor(a: Column) -> Column:
    return F.coalesce(F.floor(a.try_cast("double")).cast("string"), F.lit("NaN"))
