"""Pattern databases: token patterns compiled to regexes, first by specificity, within the rule sets of a program.

A literal outranks a token at the same place, and a longer pattern a shorter one, so rules are tried in the order of their
keys: for each piece of a pattern, literals before tokens. Contexts and actions of rules run as an ordered fold.
"""

from __future__ import annotations

import pickle
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.strings import java_regex, quoted
from millrace.operators.correlate import SCOPES, ordered_fold
from millrace.session import ship

_IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}"
_IPV6 = r"(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f]{1,4}|(?:\d{1,3}\.){3}\d{1,3})?"
TOKENS = {
    "ANYSTRING": r"(?s:.*)", "NUMBER": r"-?(?:0x[0-9A-Fa-f]+|\d+)", "FLOAT": r"-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?", "DOUBLE": r"-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?", "IPv4": _IPV4, "IPv6": _IPV6, "IPvANY": f"(?:{_IPV4}|{_IPV6})",
    "MACADDR": r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}", "HOSTNAME": r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*", "NLSTRING": r"[^\r\n]*",
}


def pieces(pattern: str) -> list[tuple]:
    """("lit", text) and ("token", type, name, parameter) pieces; ``@@`` is an at sign."""
    out, lit, i = [], "", 0
    while i < len(pattern):
        if pattern[i] != "@":
            lit += pattern[i]
            i += 1
        elif pattern[i : i + 2] == "@@":
            lit += "@"
            i += 2
        else:
            end = pattern.index("@", i + 1)
            parts = pattern[i + 1 : end].split(":", 2)
            if lit:
                out.append(("lit", lit))
                lit = ""
            out.append(("token", parts[0], parts[1] if len(parts) > 1 else "", parts[2] if len(parts) > 2 else ""))
            i = end + 1
    if lit:
        out.append(("lit", lit))
    return out


def compile_pattern(pattern: str) -> tuple[str, list[str], tuple]:
    """An anchored regex, the names of its groups, and the pattern's rank (less is first)."""
    rx, names, rank = "^", [], []
    for p in pieces(pattern):
        if p[0] == "lit":
            rx += quoted(p[1])
            rank += [(0, c) for c in p[1]]
            continue
        _, kind, name, arg = p
        if kind == "STRING":
            r = rf"[A-Za-z0-9{''.join(map(quoted, arg))}]+"
        elif kind == "ESTRING":
            r = f"(?:(?!{quoted(arg)})(?s:.))*" if arg else "(?s:.*)"
        elif kind == "QSTRING":
            a, z = (arg[0], arg[-1]) if arg else ('"', '"')
            rx += f"{quoted(a)}([^{quoted(z)}]*){quoted(z)}"
            names.append(name)
            rank.append((1, kind))
            continue
        elif kind in ("SET", "OPTIONALSET"):
            r = f"[{''.join(map(quoted, arg))}]" + ("+" if kind == "SET" else "*")
        elif kind == "PCRE":
            r = f"(?:{re.sub(r'(?<!\\\\)\((?!\?)', '(?:', java_regex(arg))})"
        elif kind == "EMAIL":
            r = r"[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~.]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*"
        elif kind == "LLADDR":
            r = r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})" + (f"{{0,{int(arg) - 1}}}" if arg else "{0,19}")
        else:
            r = TOKENS[kind]
        rx += f"({r})" + (quoted(arg) if kind == "ESTRING" else "")
        names.append(name)
        rank.append((3 if kind == "ANYSTRING" else 2 if kind in ("STRING", "ESTRING") else 1, kind))
    # all that a pattern doesn't end with an any-token must be a whole match of its prefix; the rest of the text may follow
    return rx + "$" if not rx.endswith("(?s:.*))") else rx, names, (tuple(rank), )


@dataclass
class Action:
    trigger: str = "match"  # or timeout
    condition: str = ""
    rate: tuple[int, int] | None = None  # rows, seconds
    values: dict[str, str] = field(default_factory=dict)
    inherit: str = "last-message"


@dataclass
class Rule:
    rule_id: str
    patterns: list[str]
    class_: str = "system"
    programs: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    values: dict[str, str] = field(default_factory=dict)
    context_id: str | None = None
    context_scope: str = "process"
    context_timeout: int = 0
    actions: list[Action] = field(default_factory=list)
    examples: list[tuple[str, str, dict[str, str]]] = field(default_factory=list)


def load_xml(text: str) -> list[Rule]:
    """Rules of a pattern database in XML."""
    rules = []
    root = ET.fromstring(text)
    for rs in root.iter("ruleset"):
        own = [p.text or "" for p in rs.findall("pattern")] + [p.text or "" for p in rs.findall("patterns/pattern")]
        for r in rs.iter("rule"):
            values = {v.get("name"): v.text or "" for v in r.findall("values/value")}
            actions = []
            for a in r.findall("actions/action"):
                n = a.get("rate")
                msg = a.find("message")
                vals = {v.get("name"): v.text or "" for v in (msg if msg is not None else a).iter("value")}
                actions.append(Action(a.get("trigger", "match"), a.get("condition", ""), tuple(map(int, n.split("/"))) if n else None, vals, (msg.get("inherit-mode") if msg is not None else None) or "last-message"))
            examples = [((e.findtext("test_message") or ""), e.find("test_message").get("program", ""), {v.get("name"): v.text or "" for v in e.iter("test_value")}) for e in r.iter("example")]
            rules.append(Rule(r.get("id"), [p.text or "" for p in r.findall("patterns/pattern")], r.get("class", "system"), tuple(own), tuple(t.text or "" for t in r.findall("tags/tag")), values, r.get("context-id"), r.get("context-scope", "process"), int(r.get("context-timeout", 0)), actions, examples))
    return rules


def ordered(rules: list[Rule]) -> list[tuple[Rule, str, list[str]]]:
    """Every pattern of every rule as (rule, regex, group names), the most specific first."""
    made = [(compile_pattern(p), r) for r in rules for p in r.patterns]
    made.sort(key=lambda x: x[0][2])
    return [(r, rx, names) for (rx, names, _), r in made]


class Lookup:
    """Patterns by the literal that they begin with."""

    def __init__(self, rules: list[Rule], prefix: str = "") -> None:
        self.prefix = prefix
        self.by_literal: dict[str, list[tuple]] = {}
        for n, (rule, pattern, names) in enumerate(ordered(rules)):
            programs = frozenset(p for p in rule.programs if "@" not in p)
            wide = [regex.compile(compile_pattern(p)[0], regex.ASCII) for p in rule.programs if "@" in p]
            entry = (n, regex.compile(pattern, regex.ASCII), names, rule, programs, wide)
            self.by_literal.setdefault(_beginning(pattern), []).append(entry)
        self.lengths = sorted({len(x) for x in self.by_literal})

    def first(self, text: str | None, program: str | None) -> tuple[dict[str, str], list[str]] | None:
        """The fields and tags of the first pattern that fits."""
        if text is None:
            return None
        near = [e for n in self.lengths if n <= len(text) for e in self.by_literal.get(text[:n], ())]
        for _, pattern, names, rule, programs, wide in sorted(near, key=lambda e: e[0]):
            if rule.programs and program not in programs and not any(w.search(program or "") for w in wide):
                continue
            m = pattern.search(text)
            if m is None:
                continue
            pairs = {".classifier.class": rule.class_, ".classifier.rule_id": rule.rule_id}
            own: dict[str, str] = {}
            for i, n in enumerate(names):
                if n and n not in own:
                    own[n] = m[i + 1] or ""
            pairs |= {self.prefix + n: v for n, v in own.items()}
            pairs |= {self.prefix + k: v for k, v in rule.values.items() if self.prefix + k not in own}
            return pairs, [*rule.tags, f".classifier.{rule.class_}"]
        return None


def _beginning(pattern: str) -> str:
    """The literal text that every match of an anchored regex of :func:`compile_pattern` begins with."""
    out, i = "", 1
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            out, i = out + pattern[i + 1], i + 2
        elif c in "([$.*+?{|\\":
            return out[:-1] if c in "*+?{" else out
        else:
            out, i = out + c, i + 1
    return out


@lru_cache(maxsize=4)
def _lookup(sent: bytes) -> Lookup:
    return Lookup(*pickle.loads(sent))


def db_parser(df: DataFrame, rules: list[Rule], message: Column | None = None, program: Column | None = None, prefix: str = "", drop_unmatched: bool = False) -> DataFrame:
    """Sets .classifier.class, .classifier.rule_id, the tokens and the rule's values, and its tags.

    The rule set is configuration and travels with the plan. A message is looked up by the literal that a pattern begins
    with, so it meets the few patterns that share its beginning, whatever the number of rules; of these the first that
    matches, in the order of :func:`ordered`, counts. Arrow batches.
    """
    ship(df.sparkSession)
    lookup = Lookup(rules, prefix)
    sent = pickle.dumps((rules, prefix))

    @F.pandas_udf("pairs map<string,string>, tags array<string>")
    def classify(text: pd.Series, name: pd.Series) -> pd.DataFrame:
        found = _lookup(sent)
        got = [found.first(t, n) for t, n in zip(text, name)]
        return pd.DataFrame({"pairs": [g and g[0] for g in got], "tags": [g and g[1] for g in got]})

    del lookup  # made once here, so that a pattern that can't be compiled is refused when the plan is built
    d = df.withColumn("__found", classify(F.col("message") if message is None else message, F.col("program") if program is None else program))
    d = d.withColumn("__rule", F.when(F.col("__found.pairs").isNotNull(), F.col("__found"))).drop("__found")
    if drop_unmatched:
        d = d.where("__rule IS NOT NULL")
    unknown = F.create_map(F.lit(".classifier.class"), F.lit("unknown"))
    from millrace.functions.typed import merged

    d = d.withColumn("nv", merged(F.col("nv"), F.coalesce(F.col("__rule.pairs"), unknown)))
    d = d.withColumn("tags", F.array_union("tags", F.coalesce(F.col("__rule.tags"), F.array(F.lit(".classifier.unknown")))))
    return d.drop("__rule")


def _text(template: str, rows: list[dict]) -> str:
    """``$NAME``, ``${NAME}`` and ``@n`` over a context in Python."""
    from millrace.functions.templates import CORE, parts_of

    out = ""
    for p in parts_of(template):
        if p[0] == "lit":
            out += p[1]
        elif p[0] == "name":
            back = p[3] or 0
            row = rows[-1 - back] if back < len(rows) else None
            v = None if row is None else row.get(CORE.get(p[1], p[1])) or dict(row["nv"] or {}).get(p[1])
            out += str(v if v is not None else p[2] or "")
        elif p[1] == "context-length":
            out += str(len(rows))
    return out


def actions(df: DataFrame, rules: list[Rule], tie: tuple[str, ...] = ()) -> DataFrame:
    """Messages that the rules' actions make, in event time, from rows of :func:`db_parser`: on a match or when a context times out, under a condition and a rate of n rows in so many seconds per key."""
    by_id = {r.rule_id: r for r in rules if r.actions or r.context_id}
    rule = F.col("nv")[".classifier.rule_id"]
    used = df.where(rule.isin(list(by_id)))
    from millrace.functions.templates import Scope, render

    scope = Scope.of(df)
    key = F.coalesce(*[F.when(rule == r.rule_id, F.concat_ws("|", F.lit(r.context_scope), *[F.coalesce(c, F.lit("")) for c in SCOPES[r.context_scope]], render(r.context_id or "", scope))) for r in by_id.values()], F.lit(""))
    out = T.StructType([T.StructField("stamp", T.TimestampType()), T.StructField("rule_id", T.StringType()), T.StructField("trigger", T.StringType()), T.StructField("context_key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("values", T.MapType(T.StringType(), T.StringType()))])

    from millrace.functions.conditions import holds, parse

    parsed = {a.condition: parse(a.condition) for r in by_id.values() for a in r.actions if a.condition}

    def passes(condition: str, rows: list[dict]) -> bool:
        return not condition or holds(parsed[condition], lambda t: _text(t, rows), rows[-1])

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        context: list[dict] = []
        last: Rule | None = None
        spent: dict[tuple[str, int], tuple[float, float]] = {}

        def run(r: Rule, trigger: str, now: float) -> Iterator[dict]:
            for i, a in enumerate(r.actions):
                if a.trigger != trigger or not passes(a.condition, context):
                    continue
                if a.rate:
                    n, seconds = a.rate
                    credit, at = spent.get((r.rule_id, i), (float(n), now))
                    credit = min(float(n), credit + (now - at) * n / seconds)
                    if credit < 1:
                        spent[r.rule_id, i] = (credit, now)
                        continue
                    spent[r.rule_id, i] = (credit - 1, now)
                yield {"stamp": context[-1]["stamp"], "rule_id": r.rule_id, "trigger": trigger, "context_key": context[-1]["__context"], "n": len(context), "values": {k: _text(v, context) for k, v in a.values.items()}}

        for row in rows:
            now = float(int(row["stamp"].timestamp()))
            r = by_id[dict(row["nv"])[".classifier.rule_id"]]
            if context and last is not None and now - int(context[-1]["stamp"].timestamp()) > last.context_timeout:
                yield from run(last, "timeout", now)
                context.clear()
            if not r.context_id:
                context.clear()
            context.append(row)
            last = r
            yield from run(r, "match", now)
        if context and last is not None and last.context_id:
            yield from run(last, "timeout", float(int(context[-1]["stamp"].timestamp()) + last.context_timeout + 1))

    return ordered_fold(used.withColumn("__context", key), ["__context"], ["stamp", *tie], out, fold)


def self_test(rules: list[Rule]) -> list[str]:
    """Failures of the examples that rules carry."""
    failed = []
    table = ordered(rules)
    for r in rules:
        for text, program, values in r.examples:
            hit = next(((x, re.match(rx, text), n) for x, rx, n in table if (not x.programs or program in x.programs) and re.match(rx, text)), None)
            if hit is None or hit[0].rule_id != r.rule_id:
                failed.append(f"{r.rule_id}: {text!r} matches {hit[0].rule_id if hit else 'nothing'}")
                continue
            got = {n: hit[1][i + 1] for i, n in enumerate(hit[2]) if n}
            failed += [f"{r.rule_id}: {k} is {got.get(k)!r}, not {v!r}" for k, v in values.items() if {**hit[0].values, **got}.get(k) != v]
    return failed
