"""Conditions of ``$(if ...)``, ``$(grep ...)``, ``having`` and rule actions: parsed once, evaluated as Columns or over rows in Python.

A condition joins terms by ``and``, ``or``, ``not`` and parentheses. A term compares two templates, quoted or bare, is a
classic filter call such as ``match("x" value("PROGRAM"))``, or is one template, true where it is neither empty nor 0.
What doesn't parse, or names an unknown filter, raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_OPERATORS = ("===", "!==", "==", "!=", "<=", ">=", "<", ">")
_WORDS = ("eq", "ne", "lt", "le", "gt", "ge")
_NUMERIC = ("<", "<=", ">", ">=", "==", "!=")
CALLS = ("match", "program", "host", "message", "severity", "level", "priority", "facility", "tags", "netmask", "netmask6", "source", "true", "false")
_PARTS = ("value", "template", "type", "flags")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace() or c == ",":
            i += 1
        elif c in "()":
            out.append((c, c))
            i += 1
        elif c in "\"'":
            end = i + 1
            while end < len(text) and text[end] != c:
                end += 2 if text[end] == "\\" and c == '"' else 1
            if end >= len(text):
                raise ValueError(f"open quote in condition {text!r}")
            body = text[i + 1 : end]
            out.append(("text", re.sub(r"\\(.)", r"\1", body) if c == '"' else body))
            i = end + 1
        elif op := next((o for o in _OPERATORS if text.startswith(o, i)), None):
            out.append(("op", op))
            i += len(op)
        else:
            start, depth = i, 0
            while i < len(text):
                if text[i] in "({" and (depth or text[i - 1 : i] == "$"):
                    depth += 1
                elif text[i] in ")}" and depth:
                    depth -= 1
                elif not depth and (text[i].isspace() or text[i] in "()\"'," or any(text.startswith(o, i) for o in _OPERATORS)):
                    break
                i += 1
            if i == start:
                raise ValueError(f"unexpected {c!r} in condition {text!r}")
            word = text[start:i]
            out.append(("op", word) if word in _WORDS else ("word", word))
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, _tokens(text), 0

    def fail(self) -> ValueError:
        return ValueError(f"condition {self.text!r} isn't understood at token {self.at + 1}")

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, kind: str) -> str:
        k, v = self.peek()
        if k != kind:
            raise self.fail()
        self.at += 1
        return v

    def either(self) -> tuple:
        out = self.both()
        while self.peek() == ("word", "or"):
            self.at += 1
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.single()
        while self.peek() == ("word", "and"):
            self.at += 1
            out = ("and", out, self.single())
        return out

    def single(self) -> tuple:
        kind, text = self.peek()
        if (kind, text) == ("word", "not"):
            self.at += 1
            return ("not", self.single())
        if kind == "(":
            self.at += 1
            out = self.either()
            self.take(")")
            return out
        if kind == "word" and self.peek(1)[0] == "(" and "$" not in text:
            return self.call()
        left = self.operand()
        if self.peek()[0] == "op":
            op = self.take("op")
            return ("compare", op, left, self.operand())
        return ("truth", left)

    def operand(self) -> str:
        if self.peek()[0] == "text":
            return self.take("text")
        words = []
        while self.peek()[0] == "word" and self.peek()[1] not in ("and", "or", "not"):
            words.append(self.take("word"))
        if not words:
            raise self.fail()
        return " ".join(words)

    def call(self) -> tuple:
        name = self.take("word")
        if name not in CALLS:
            raise ValueError(f"no filter {name}() in conditions")
        self.take("(")
        args, options = [], {}
        while self.peek()[0] != ")":
            kind, text = self.peek()
            if kind == "word" and self.peek(1)[0] == "(":
                if text not in _PARTS:
                    raise self.fail()
                self.at += 2
                own = []
                while self.peek()[0] != ")":
                    own.append(self.take("text" if self.peek()[0] == "text" else "word"))
                self.at += 1
                options[text] = own
            else:
                args += [self.take("text")] if kind == "text" else self.take("word").split("..")
        self.at += 1
        return ("call", name, args, options)


def parse(text: str) -> tuple:
    p = _Parser(text)
    out = p.either()
    if p.peek()[0] != "end":
        raise p.fail()
    return out


def as_column(text: str, scope):
    """The condition as a boolean Column over a template scope."""
    from pyspark.sql import functions as F

    from millrace.functions import typed
    from millrace.functions.strings import in_subnet
    from millrace.functions.templates import FACILITIES, RowScope, SEVERITIES, render

    def column(name: str):
        return scope.row[name] if isinstance(scope, RowScope) else F.col(name)

    def call(name: str, args: list[str], options: dict[str, list[str]]):
        from millrace.operators import filters

        if name in ("true", "false"):
            return F.lit(name == "true")
        if name in ("match", "program", "host", "message"):
            of = render(options["template"][0], scope) if "template" in options else scope.get(options["value"][0] if "value" in options else "MESSAGE" if name == "match" else name.upper())
            return filters.match(of, args[0], options.get("type", ["pcre"])[0], tuple(options.get("flags", ())))
        if name in ("severity", "level", "priority"):
            codes = [SEVERITIES.index(a) for a in args]
            return filters.true((column("pri") % 8).between(min(codes), max(codes)))
        if name == "facility":
            return filters.true(F.floor(column("pri") / 8).isin([int(a) if a.isdigit() else FACILITIES.index(a) for a in args]))
        if name == "tags":
            return filters.true(F.arrays_overlap(column("tags"), F.array(*map(F.lit, args))))
        if name == "source":
            return filters.true(column("source") == args[0])
        return in_subnet(F.coalesce(column("peer_ip"), F.lit("127.0.0.1" if name == "netmask" else "::1")), args[0])

    def walk(e: tuple):
        if e[0] == "or":
            return typed.disjunction([walk(e[1]), walk(e[2])])
        if e[0] == "and":
            return typed.conjunction([walk(e[1]), walk(e[2])])
        if e[0] == "not":
            return ~F.coalesce(walk(e[1]), F.lit(False))
        if e[0] == "call":
            return call(*e[1:])
        if e[0] == "truth":
            return typed.truthy(typed.expr(render(e[1], scope), typed.STRING))
        x, y = (typed.expr(render(v, scope), typed.STRING) for v in e[2:])
        if e[1] in _NUMERIC:
            n, m = typed.parsed_number(x.value), typed.parsed_number(y.value)
            return F.when(n.isNotNull() & m.isNotNull(), typed._SQL[e[1]](n, m)).otherwise(typed.compare(x, e[1], y).value)
        return typed.compare(x, e[1], y).value

    return walk(parse(text))


_PYTHON: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "===": lambda a, b: a == b, "!==": lambda a, b: a != b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
}


def holds(condition: tuple, text: Callable[[str], str], row: dict) -> bool:
    """A parsed condition in Python: ``text`` renders a template, ``row`` is the newest event."""
    kind = condition[0]
    if kind in ("or", "and"):
        a = holds(condition[1], text, row)
        return (a or holds(condition[2], text, row)) if kind == "or" else (a and holds(condition[2], text, row))
    if kind == "not":
        return not holds(condition[1], text, row)
    if kind == "truth":
        return text(condition[1]) not in ("", "0", "false")
    if kind == "compare":
        a, b = text(condition[2]), text(condition[3])
        if condition[1] in _NUMERIC:
            try:
                a, b = float(a), float(b)
            except ValueError:
                pass
        return _PYTHON[condition[1]](a, b)
    _, name, args, options = condition
    if name in ("true", "false"):
        return name == "true"
    if name in ("match", "program", "host", "message"):
        of = text(options["template"][0]) if "template" in options else text("${" + (options["value"][0] if "value" in options else "MESSAGE" if name == "match" else name.upper()) + "}")
        flags, how, pattern = options.get("flags", ()), options.get("type", ["pcre"])[0], args[0]
        if how in ("pcre", "posix"):
            return re.search(pattern, of, re.I if "ignore-case" in flags else 0) is not None
        if how == "glob":
            from millrace.functions.strings import glob_to_regex

            return re.match(glob_to_regex(pattern), of) is not None
        if "ignore-case" in flags:
            of, pattern = of.lower(), pattern.lower()
        return pattern in of if "substring" in flags else of.startswith(pattern) if "prefix" in flags else of == pattern
    if name in ("severity", "level", "priority"):
        from millrace.functions.templates import SEVERITIES

        codes = [SEVERITIES.index(a) for a in args]
        return row["pri"] is not None and min(codes) <= row["pri"] % 8 <= max(codes)
    if name == "facility":
        from millrace.functions.templates import FACILITIES

        return row["pri"] is not None and row["pri"] // 8 in [int(a) if a.isdigit() else FACILITIES.index(a) for a in args]
    if name == "tags":
        return bool(set(args) & set(row["tags"] or ()))
    if name == "source":
        return row["source"] == args[0]
    import ipaddress

    own = row.get("peer_ip") or ("127.0.0.1" if name == "netmask" else "::1")
    return ipaddress.ip_address(own) in ipaddress.ip_network(args[0], strict=False)
