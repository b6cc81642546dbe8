"""The text form of expression blocks: parsed once, compiled to a :class:`~millrace.plans.block.Block`.

``$NAME`` and ``${name}`` are fields of the event, bare names are variables; statements end with ``;``::

    declare total = int($value) + 1;
    if ($PROGRAM == "app" and total > 10) { $class = "big"; } else { $class = "small"; };
    $user ?? "none" != "none";
    $host_part = $HOST[..3];

Values: whole numbers, doubles, strings (with ``$`` inside, templates), true, false, null, ``[...]`` lists, ``{...}`` dicts.
Operators, loosest first: ``? :`` and ``?:``, ``??``, or, and, not, comparisons with in and =~, ``+ -``, ``* / %``, unary minus,
access by ``.name`` and ``[...]``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import typed
from millrace.functions.registry import FUNCTIONS
from millrace.functions.strings import in_subnet, java_regex
from millrace.functions.templates import CORE, FACILITIES, SEVERITIES, Scope, _named, render
from millrace.functions.typed import BOOL, DATETIME, DICT, INT, LIST, NULL, STRING, Expr, wrap
from millrace.operators.rewrites import put
from millrace.plans.block import Block

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<num>0x[0-9a-fA-F]+|\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'[^']*'|`[^`]*`)|(?P<field>\$\{[^}]+\}|\$[A-Za-z_.][A-Za-z0-9_.]*?(?=\.\D|[^A-Za-z0-9_.]|$)|\$[A-Za-z_][A-Za-z0-9_]*)"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>===|!==|=\?\?|\?\?|:\?\?|==|!=|<=|>=|=~|!~|\+=|\.\.|\?:|[-+*/%<>=?:;,.(){}\[\]])""",
    re.X,
)
_WORDS = {"lt", "le", "eq", "ne", "ge", "gt"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"at {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


def literal(x) -> Expr:
    e = wrap(x) if not isinstance(x, list | dict) else _container(x)
    object.__setattr__(e, "literal", x)
    return e


def _container(x) -> Expr:
    if isinstance(x, list):
        return Expr(F.array(*[F.lit(v).cast("string") for v in x]) if x else F.array().cast("array<string>"), LIST, F.lit(True))
    return Expr(F.create_map(*[F.lit(v).cast("string") for p in x.items() for v in p]) if x else F.create_map().cast("map<string,string>"), DICT, F.lit(True))


class Program:
    """Parses text; :meth:`apply` runs it over a table."""

    def __init__(self, text: str) -> None:
        self.tokens = [*tokens(text), ("end", "")]
        self.at = 0
        self.body = self._statements("end")

    # parsing to tuples

    def _peek(self) -> str:
        return self.tokens[self.at][1]

    def _kind(self) -> str:
        return self.tokens[self.at][0]

    def _next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _take(self, text: str) -> bool:
        if self._peek() == text and self._kind() in ("op", "name"):
            self.at += 1
            return True
        return False

    def _want(self, text: str) -> None:
        if not self._take(text):
            raise SyntaxError(f"{text!r} expected before {self._peek()!r}")

    def _statements(self, end: str) -> list:
        out = []
        while not (self._kind() == "end" if end == "end" else self._peek() == end and self._kind() == "op"):
            if self._take(";"):
                continue
            out.append(self._statement())
        if end != "end":
            self._next()
        return out

    def _block(self) -> list:
        self._want("{")
        return self._statements("}")

    def _statement(self):
        if self._kind() == "name":
            word = self._peek()
            if word == "if":
                self._next()
                branches = [(self._expression(), self._block())]
                while self._take("elif"):
                    branches.append((self._expression(), self._block()))
                return ("if", branches, self._block() if self._take("else") else [])
            if word == "switch":
                self._next()
                return self._switch()
            if word in ("drop", "done", "break"):
                self._next()
                return (word,)
            if word == "declare":
                self._next()
                name = self._next()
                self._want("=")
                return ("declare", name, self._expression())
            if word == "unset" and self.tokens[self.at + 1][1] == "(":
                self._next()
                self._next()
                names = []
                while not self._take(")"):
                    names.append(self._postfix())
                    self._take(",")
                return ("unset", names)
        start = self.at
        target = self._postfix()
        for op in ("=??", "+=", "="):
            if self._take(op):
                return ("assign", op, target, self._expression())
        self.at = start
        return ("test", self._expression())

    def _switch(self):
        subject = self._expression()
        self._want("{")
        cases, current = [], None
        while not self._take("}"):
            if self._take("case"):
                low = self._unary()
                value = ("range", low, self._unary()) if self._take("..") else low
                self._want(":")
                current = [value, []]
                cases.append(current)
            elif self._take("default"):
                self._want(":")
                current = [None, []]
                cases.append(current)
            elif not self._take(";"):
                current[1].append(self._statement())
        seen = [repr(c[0]) for c in cases]
        if len(set(seen)) < len(seen):
            raise SyntaxError("a case stands twice")
        return ("switch", subject, cases)

    def _expression(self):
        test = self._coalesce()
        if self._take("?:"):
            return ("elvis", test, self._expression())
        if self._take("?"):
            yes = self._expression()
            self._want(":")
            return ("cond", test, yes, self._expression())
        return test

    def _left(self, inner, ops: tuple[str, ...], tag: str = "bin"):
        left = inner()
        while self._kind() in ("op", "name") and self._peek() in ops:
            op = self._next()
            left = (tag, op, left, inner())
        return left

    def _coalesce(self):
        return self._left(self._or, ("??",))

    def _or(self):
        return self._left(self._and, ("or",))

    def _and(self):
        return self._left(self._not, ("and",))

    def _not(self):
        return ("not", self._not()) if self._take("not") else self._comparison()

    def _comparison(self):
        left = self._sum()
        p = self._peek()
        if self._kind() == "name" and p == "not" and self.tokens[self.at + 1][1] == "in":
            self.at += 2
            return ("not", ("in", left, self._sum()))
        if self._take("in"):
            return ("in", left, self._sum())
        if self._kind() in ("op", "name") and p in ("==", "!=", "===", "!==", "<", "<=", ">", ">=", "=~", "!~", *_WORDS):
            self._next()
            return ("cmp", p, left, self._sum())
        return left

    def _sum(self):
        return self._left(self._product, ("+", "-"))

    def _product(self):
        return self._left(self._unary, ("*", "/", "%"))

    def _unary(self):
        return ("neg", self._unary()) if self._take("-") else self._postfix()

    def _postfix(self):
        e = self._primary()
        while True:
            if self._peek() == "." and self._kind() == "op":
                self._next()
                e = ("attr", e, self._next())
            elif self._peek() == "[" and self._kind() == "op":
                self._next()
                if self._take("]"):
                    e = ("append", e)
                    continue
                low = None if self._peek() == ".." else self._expression()
                if self._take(".."):
                    e = ("slice", e, low, None if self._peek() == "]" else self._expression())
                else:
                    e = ("index", e, low)
                self._want("]")
            else:
                return e

    def _primary(self):
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("lit", int(text, 0) if re.fullmatch(r"0x[0-9a-fA-F]+|\d+", text) and not re.fullmatch(r"0\d+", text) else float(text) if "." in text else int(text))
        if kind == "str":
            body = text[1:-1]
            if text[0] == '"':
                body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)
            return ("template", body) if text[0] != "'" and re.search(r"\$[A-Za-z_{(.]", body) else ("lit", body)
        if kind == "field":
            return ("field", text[2:-1] if text.startswith("${") else text[1:])
        if text == "(":
            e = self._expression()
            if self._take(","):  # a tuple
                items = [e]
                while not self._take(")"):
                    items.append(self._expression())
                    self._take(",")
                return ("list", items)
            self._want(")")
            return e
        if text == "[":
            items = []
            while not self._take("]"):
                items.append(self._expression())
                self._take(",")
            return ("list", items)
        if text == "{":
            pairs = []
            while not self._take("}"):
                key = self._expression() if self._kind() != "name" else ("lit", self._next())
                skip = self._take(":??")
                if not skip:
                    self._want(":")
                pairs.append((key, self._expression(), skip))
                self._take(",")
            return ("dict", pairs)
        if kind == "name":
            if text in ("true", "false"):
                return ("lit", text == "true")
            if text == "null":
                return ("lit", None)
            if self._take("("):
                args, options = [], {}
                while not self._take(")"):
                    if self._kind() == "name" and self.tokens[self.at + 1][1] == "=":
                        name = self._next()
                        self._next()
                        options[name] = self._expression()
                    else:
                        args.append(self._expression())
                    self._take(",")
                return ("call", text, args, options)
            return ("var", text)
        raise SyntaxError(f"unexpected {text!r}")

    # compiling

    def apply(self, df: DataFrame, errors_into: str | None = None, metrics_into: str | None = None) -> DataFrame:
        """The rows that the program keeps, with fields set and declared variables as columns.

        ``metrics_into`` names a column of what update_metric() counted in the row: array<struct<name,labels,value>>, of which
        :func:`millrace.operators.metrics.counted` makes counters. A program that counts needs it.
        """
        run = _Run(df)
        run.statements(self.body)
        if run.metrics and not metrics_into:
            raise ValueError("update_metric() counts into a column: apply(metrics_into=...)")
        return run.finish(errors_into, metrics_into)


class _Run:
    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self.block = Block(df)
        self.metrics: list = []

    def _name(self, target) -> str:
        return "$" + target[1] if target[0] == "field" else target[1]

    def read(self, target) -> Expr:
        name = self._name(target)
        if name in self.block.values:
            return self.block.values[name]
        if target[0] == "var":
            if name in self.df.columns:
                return self.block[name]
            raise NameError(f"variable {name} isn't set before it is read")
        own = CORE.get(target[1], target[1])
        if own in self.df.columns:
            return self.block[own]
        v = Scope.of(self.df).get(target[1])
        if "nv" in self.df.columns and target[1] not in ("SEVERITY", "FACILITY", "PRI"):
            known = F.map_contains_key("nv", F.lit(target[1]))
            return Expr(v, STRING, F.coalesce(known | v.isNotNull(), F.lit(False)))
        return typed.expr(v, STRING)

    def _old(self, target) -> Expr | None:
        try:
            return self.read(target)
        except NameError:
            return None

    def eval(self, e) -> Expr:
        return getattr(self, "_e_" + e[0])(*e[1:])

    def _e_lit(self, x) -> Expr:
        return literal(x)

    def _e_template(self, text: str) -> Expr:
        extra = {n[1:]: x.value for n, x in self.block.values.items() if n[0] == "$"}
        if "pri" in extra:
            level, facility = (extra["pri"] % 8).cast("int"), F.floor(extra["pri"] / 8).cast("int")
            named = {"LEVEL": _named(SEVERITIES, level), "FACILITY": F.coalesce(F.try_element_at(F.array(*map(F.lit, FACILITIES)), facility + 1), facility.cast("string"))}
            extra |= {"PRI": extra["pri"], "LEVEL_NUM": level, "SEVERITY_NUM": level, "FACILITY_NUM": facility, **named, "SEVERITY": named["LEVEL"], "PRIORITY": named["LEVEL"]}
        scope = Scope(frozenset(self.df.columns), extra)
        return Expr(render(text, scope), STRING, F.lit(True))

    def _e_field(self, name: str) -> Expr:
        return self.read(("field", name))

    def _e_var(self, name: str) -> Expr:
        return self.read(("var", name))

    def _e_list(self, items) -> Expr:
        es = [self.eval(i) for i in items]
        out = Expr(F.array(*[typed.held(x) for x in es]) if es else F.array().cast("array<string>"), LIST, typed.conjunction([x.ok for x in es]))
        if all(hasattr(x, "literal") for x in es):
            object.__setattr__(out, "literal", [x.literal for x in es])
        return out

    def _e_dict(self, pairs) -> Expr:
        out, ok = F.create_map().cast("map<string,string>"), F.lit(True)
        for k, v, skip in pairs:
            key, value = self.eval(k), self.eval(v)
            text = typed.held(value)
            put_ = typed.with_member(out, key.value.cast("string"), text)
            if skip:
                out = F.when(F.coalesce(value.ok & text.isNotNull(), F.lit(False)), put_).otherwise(out)
            else:
                out, ok = put_, ok & value.ok
        return Expr(out, DICT, ok)

    def _e_bin(self, op, a, b) -> Expr:
        x, y = self.eval(a), self.eval(b)
        return {"+": typed.plus, "-": typed.minus, "*": typed.times, "/": typed.over, "%": typed.modulo, "??": typed.coalesced, "and": typed.all_of, "or": typed.any_of}[op](x, y)

    def _e_neg(self, a) -> Expr:
        return literal(-a[1]) if a[0] == "lit" else -self.eval(a)

    def _e_not(self, a) -> Expr:
        return typed.negated(self.eval(a))

    def _e_cmp(self, op, a, b) -> Expr:
        x = self.eval(a)
        if op in ("=~", "!~"):
            hit = x.value.cast("string").rlike(java_regex(b[1]))  # a pattern is a literal, whatever it holds
            return Expr(hit if op == "=~" else ~hit, BOOL, x.ok)
        return typed.compare(x, op, self.eval(b))

    def _e_in(self, a, b) -> Expr:
        x, y = self.eval(a), self.eval(b)
        if hasattr(y, "network"):
            return Expr(in_subnet(x.value, y.network), BOOL, x.ok)
        if hasattr(y, "literal") and isinstance(y.literal, list):
            return Expr(typed.disjunction([typed.compare(x, "===", literal(v)).value for v in y.literal]), BOOL, x.ok)
        return typed.member(x, y)

    def _e_cond(self, t, a, b) -> Expr:
        return typed.choose(self.eval(t), self.eval(a), self.eval(b))

    def _e_elvis(self, a, b) -> Expr:
        return typed.elvis(self.eval(a), self.eval(b))

    def _e_attr(self, e, name) -> Expr:
        return self._get(self.eval(e), literal(name))

    def _e_index(self, e, key) -> Expr:
        return self._get(self.eval(e), self.eval(key))

    def _get(self, c: Expr, key: Expr) -> Expr:
        if c.kind in (DICT, LIST):
            return typed.element(c, key)
        # JSON text inside a mapping
        path = f"$.{key.literal}" if isinstance(key.literal, str) else f"$[{key.literal}]"
        v = F.get_json_object(c.value, path)
        return Expr(v, STRING, F.coalesce(c.ok & v.isNotNull(), F.lit(False)))

    def _e_slice(self, e, a, b) -> Expr:
        return typed.byte_slice(self.eval(e), None if a is None else self.eval(a), None if b is None else self.eval(b))

    def _e_call(self, name, args, options) -> Expr:
        if name == "isset":
            try:
                return typed.isset(self.eval(args[0]))
            except NameError:
                return literal(False)
        if name == "enum":
            return literal(args[0][-1])
        if name == "move":
            e = self.eval(args[0])
            self.unset(args[0])
            return e
        if name == "update_metric":
            return self._metric(*[self.eval(a) for a in args], **{k: self.eval(v) for k, v in options.items()})
        if name == "set_pri":
            value = self.eval(args[0] if args else options["pri"])
            pri = value.value.try_cast("int")
            ok = F.coalesce(value.ok & pri.between(0, 1023), F.lit(False))
            self.store(("field", "pri"), Expr(F.when(ok, pri), INT, ok))
            return Expr(F.lit(True), BOOL, ok)
        if name == "set_timestamp":
            value = self.eval(args[0])
            which = getattr(self.eval(args[1]), "literal", None) if len(args) > 1 else getattr(self.eval(options["stamp"]), "literal", None) if "stamp" in options else "stamp"
            if which not in ("stamp", "recvd") or value.kind != DATETIME:
                raise ValueError("set_timestamp() takes a datetime and \"stamp\" or \"recvd\"")
            self.store(("field", which), value)
            return Expr(F.lit(True), BOOL, value.ok)
        if name == "load_vars":
            value = self.eval(args[0])
            names = [x.literal if hasattr(x, "literal") else None for x in (self.eval(a) for a in args[1:])]
            if value.kind != DICT or None in names or not names:
                raise ValueError("load_vars(dict, name, ...) names its variables: columns are fixed when the plan is built")
            for n in names:
                self.block.declared.add(n)
                self.store(("var", n), typed.element(value, literal(n)))
            return Expr(F.lit(True), BOOL, value.ok)
        if name == "failure_info_enable":  # failures of a row are always kept
            return literal(True)
        if name == "failure_info_clear":
            active = self.block.active()
            self.block.errors[:] = [(bad & ~active, what) for bad, what in self.block.errors]
            return literal(True)
        if name == "failure_info_meta":
            if args[0][0] != "dict" or any(v[0] != "lit" for _, v, _ in args[0][1]):
                raise ValueError("failure_info_meta() takes a literal dict")
            self.block.note = " " + json.dumps({k[1]: v[1] for k, v, _ in args[0][1]})
            return literal(True)
        if name == "failure_info":
            return Expr(self.block.failures(), LIST, F.lit(True))
        if name == "vars":
            return Expr(F.create_map(*[x for n, e in self.block.values.items() if n[0] != "$" for x in (F.lit(n), typed.held(e))]), DICT, F.lit(True))
        if name not in FUNCTIONS:
            raise NameError(f"no function {name}")
        return FUNCTIONS[name](*[self.eval(a) for a in args], **{k: self.eval(v) for k, v in options.items()})

    def _metric(self, key: Expr, labels: Expr | None = None, increment: Expr | None = None) -> Expr:
        """Counts where the statement is reached; ``apply(metrics_into=...)`` gives the counts of a row."""
        if not hasattr(key, "literal"):
            raise ValueError("the key of a metric is a literal")
        step = increment if increment is not None else literal(1)
        none = F.create_map().cast("map<string,string>")
        entry = F.struct(F.lit(key.literal).alias("name"), (typed.texts(labels).value if labels is not None else none).alias("labels"), F.coalesce(step.value.try_cast("bigint"), F.lit(0)).alias("value"))
        ok = F.coalesce(step.ok & (labels.ok if labels is not None else F.lit(True)), F.lit(False))
        hit, entry = self.block.keep(self.block.active() & ok, entry)
        self.metrics.append(F.when(hit, entry))
        return Expr(F.lit(True), BOOL, ok)

    def unset(self, target) -> None:
        if target[0] in ("attr", "index"):
            base = self.eval(target[1])
            key = literal(target[2]) if target[0] == "attr" else self.eval(target[2])
            self.store(target[1], Expr(F.map_filter(base.value, lambda k, _: k != key.value), DICT, base.ok))
            return
        name, old, a = self._name(target), self.read(target), self.block.active()
        self.block.put(name, F.when(~a, old.value), old.kind, ~a & old.ok)

    def store(self, target, value: Expr) -> None:
        if target[0] in ("attr", "index"):
            base = self.eval(target[1])
            key = literal(target[2]) if target[0] == "attr" else self.eval(target[2])
            text = typed.held(value)
            if base.kind == LIST:
                n = F.size(base.value)
                at = F.when(key.value < 0, n + key.value).otherwise(key.value)
                inside = F.coalesce((at >= 0) & (at < n), F.lit(False))
                self.store(target[1], Expr(F.transform(base.value, lambda x, i: F.when(i == at, text).otherwise(x)), LIST, base.ok & value.ok & key.ok & inside))
                return
            self.store(target[1], Expr(typed.with_member(base.value, key.value.cast("string"), text), DICT, base.ok & value.ok & key.ok))
            return
        if target[0] == "append":
            base = self.eval(target[1])
            self.store(target[1], Expr(F.array_append(base.value, typed.held(value)), LIST, base.ok & value.ok))
            return
        name, old, b = self._name(target), self._old(target), self.block
        v, ok = b.keep(value.value, F.coalesce(value.ok, F.lit(False)))
        b.fail(ok, f"set {name}")
        a = b.active()
        if old is None or old.kind == NULL:
            b.put(name, F.when(a, v), value.kind, a & ok)
        elif value.kind in (old.kind, NULL):
            b.put(name, F.when(a, v).otherwise(old.value), old.kind, F.when(a, ok).otherwise(old.ok))
        else:  # the type depends on the row: text
            b.put(name, F.when(a, v.cast("string")).otherwise(old.value.cast("string")), STRING, F.when(a, ok).otherwise(old.ok))

    def statements(self, body) -> None:
        for s in body:
            getattr(self, "_s_" + s[0])(*s[1:])

    def _s_test(self, e) -> None:
        self.block.require(self.eval(e), "statement")

    def _s_assign(self, op, target, e) -> None:
        value = self.eval(e)
        if op == "+=":
            value = typed.plus(self.eval(target), value)
        if op == "=??":
            before = self.block.running
            (self.block.running,) = self.block.keep(before & F.coalesce(value.ok & value.value.isNotNull(), F.lit(False)))
            self.store(target, Expr(value.value, value.kind, F.lit(True)))
            self.block.running = before
            return
        self.store(target, value)

    def _s_declare(self, name, e) -> None:
        self.block.declared.add(name)
        self.store(("var", name), self.eval(e))

    def _s_unset(self, names) -> None:
        for n in names:
            self.unset(n)

    def _s_drop(self) -> None:
        self.block.drop()

    def _s_done(self) -> None:
        self.block.running = F.lit(False) & self.block.running

    def _s_break(self) -> None:
        """Handled by the switch."""

    def _s_if(self, branches, otherwise) -> None:
        if not branches:
            self.statements(otherwise)
            return
        (test, then), *rest = branches
        self.block.when(self.eval(test), lambda _: self.statements(then), lambda _: self._s_if(rest, otherwise))

    def _s_switch(self, subject, cases) -> None:
        """Without ``break`` a case runs on into the next; that is spelled out here."""
        x = self.eval(subject)
        hits, bodies = [], []
        for i, (value, _) in enumerate(cases):
            if value is None:
                hits.append(None)
            elif value[0] == "range":
                hits.append(typed.all_of(typed.compare(x, ">=", self.eval(value[1])), typed.compare(x, "<=", self.eval(value[2]))))
            else:
                hits.append(typed.compare(x, "==", self.eval(value)))
            body = []
            for _, statements in cases[i:]:
                body += [s for s in statements if s[0] != "break"]
                if any(s[0] == "break" for s in statements):
                    break
            bodies.append(body)
        default = next((b for h, b in zip(hits, bodies) if h is None), [])

        def chain(left) -> None:
            if not left:
                self.statements(default)
                return
            (h, body), *more = left
            self.block.when(h, lambda _: self.statements(body), lambda _: chain(more))

        chain([(h, b) for h, b in zip(hits, bodies) if h is not None])

    def finish(self, errors_into: str | None, metrics_into: str | None = None) -> DataFrame:
        b = self.block
        d = b.staged(errors_into is not None)
        if metrics_into:
            kind = "array<struct<name:string,labels:map<string,string>,value:bigint>>"
            d = d.withColumn(metrics_into, F.array_compact(F.array(*self.metrics)).cast(kind) if self.metrics else F.array().cast(kind))
        d = d.withColumn(errors_into, b.failures()) if errors_into else d
        variables = {n: F.when(e.ok, e.value) for n, e in b.values.items() if n[0] != "$" and (n in b.declared or n in self.df.columns)}
        d = d.withColumns(variables) if variables else d
        for n, e in b.values.items():
            if n[0] != "$":
                continue
            own, value = CORE.get(n[1:], n[1:]), typed.json_text(e) if e.kind in (DICT, LIST) else e.value
            if own in self.df.columns:
                d = put(d, n[1:], F.when(e.ok, value))
            else:
                cut = F.map_filter("nv", _not(n[1:]))
                d = d.withColumn("nv", F.when(e.ok, typed.with_member(F.col("nv"), F.lit(n[1:]), value.cast("string"))).otherwise(cut))
        return d.drop(*b.temporary)


def _not(name: str):
    return lambda k, _: k != name
