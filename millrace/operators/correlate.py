"""Correlation: groups of events under a key that end when no row comes for a time, early triggers, rate limits and line groups.

Without a trigger a group is a session of event time (whole seconds): a gap of more than the timeout starts another. That is a
built-in window, aggregated in part before the shuffle where the aggregates allow it. With a trigger, or for a fold that needs
order, rows are sorted within partitions by key and time and streamed; only the open group is in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import strings as S
from millrace.functions.templates import RowScope, Scope, condition, parts_of, render
from millrace.functions.typed import int_div, merged, with_member
from millrace.operators.filters import true
from millrace.session import ship

SCOPES = {"global": (), "host": ("host",), "program": ("host", "program"), "process": ("host", "program", "pid")}


def session_groups(df: DataFrame, keys: list[str], timeout: int, aggregates: dict[str, Column], ts: str = "stamp", where: Column | None = None, having: Column | None = None) -> DataFrame:
    """Keys, session_start, session_end (of the last row) and the aggregates of every session."""
    if timeout < 1:
        raise ValueError("a timeout is a second at least")
    d = df if where is None else df.where(where)
    second = F.date_trunc("second", F.col(ts))
    g = d.withColumn("__second", second).groupBy(F.session_window("__second", f"{timeout} seconds").alias("__w"), *keys)
    out = g.agg(*[c.alias(n) for n, c in aggregates.items()])
    out = out.select(*keys, F.col("__w.start").alias("session_start"), (F.col("__w.end") - F.expr(f"interval {timeout} seconds")).alias("session_end"), *aggregates)
    return out if having is None else out.where(having)


def sum_int(template: Column) -> Column:
    """Of what parses as a whole number; null if nothing does."""
    return F.sum(template.try_cast("bigint"))


def average_int(template: Column) -> Column:
    n = template.try_cast("bigint")
    return int_div(F.sum(n), F.count(n))


def context_values(value: Column, order: Column) -> Column:
    """In order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


#: Template functions that aggregates over a group answer, and functions of text that may stand around them.
FOLDED = frozenset({"sum", "average", "min", "max", "context-length", "context-values", "context-lookup", "grep"})
AROUND = frozenset({"echo", "length", "strip", "lowercase", "uppercase", "or", "list-slice", "list-head", "list-tail", "list-nth", "list-count", "list-concat", "list-append", "+", "-", "*", "/", "%"})


def folds(template: str) -> list[tuple[str, tuple[str, ...]]] | None:
    """The calls of a template that aggregates answer; None where it needs the group's rows as a whole."""
    found = []
    for kind, name, args, *rest in (p if len(p) > 2 else (*p, None) for p in parts_of(template)):
        if kind == "name" and rest[0]:
            return None
        if kind == "call" and name in FOLDED:
            if any(x[0] == "call" or x[-1] is not None and x[0] == "name" for a in args[name in ("context-lookup", "grep") :] for x in parts_of(a)):
                return None
            found.append((name, tuple(args)))
        elif kind == "call":
            inner = [folds(a) for a in args]
            if name not in AROUND or None in inner:
                return None
            found += [x for i in inner for x in i]
    return found


class _Folded:
    """One call over a group: what is aggregated of the real rows, and its answer once the synthetic row is known."""

    def __init__(self, call: tuple[str, tuple[str, ...]], at: str, by: Column, row: Column, outer: Scope) -> None:
        self.name, self.args = call
        self.at, self.outer, self.aggregates = at, outer, {}
        own = RowScope(row, outer)
        kept = lambda value, test=None: F.collect_list(F.struct(by.alias("by"), value.alias("v")) if test is None else F.when(test, F.struct(by.alias("by"), value.alias("v"))))
        if self.name in ("context-lookup", "grep"):
            made = [kept(self._joined(own), true(condition(self.args[0], own)))]
        elif self.name == "context-values":
            made = [kept(render(a, own)) for a in self.args]
        elif self.name == "context-length":
            made = [F.count(F.lit(1))]
        else:
            n = render(self.args[0], own).try_cast("bigint")
            made = [F.min(n)] if self.name == "min" else [F.max(n)] if self.name == "max" else [F.sum(n), F.count(n)]
        self.aggregates = {f"{at}_{i}": c for i, c in enumerate(made)}

    def _joined(self, scope: Scope) -> Column:
        return F.concat_ws(",", *[render(a, scope) for a in self.args[1:]])

    def answer(self, synthetic: Column) -> Column:
        got, own = [F.col(c) for c in self.aggregates], RowScope(synthetic, self.outer)
        ordered = lambda c: F.transform(F.array_sort(c), lambda x: x["v"])
        if self.name in ("context-lookup", "grep"):
            last = F.when(true(condition(self.args[0], own)), F.array(self._joined(own))).otherwise(F.array().cast("array<string>"))
            values = F.concat(ordered(got[0]), last)
            return F.array_join(values, ",") if self.name == "grep" else S.list_text(values)
        if self.name == "context-values":
            return S.list_text(F.concat(*[x for c, a in zip(got, self.args) for x in (ordered(c), F.array(render(a, own)))]))
        if self.name == "context-length":
            return (got[0] + 1).cast("string")
        n = render(self.args[0], own).try_cast("bigint")
        if self.name in ("min", "max"):
            return (F.least if self.name == "min" else F.greatest)(got[0], n).cast("string")
        total, count = F.coalesce(got[0] + n, got[0], n), got[1] + n.isNotNull().cast("bigint")
        return F.when(count > 0, total if self.name == "sum" else int_div(total, count)).cast("string")


def grouping_by(df: DataFrame, key: list[str], timeout: int, aggregate: dict[str, str], scope: str = "global", where: Column | None = None, having: Callable[[Scope], Column] | None = None, sort_key: str | None = None, inherit: str = "none", inject: str = "aggregate-only", tags: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Sessions of events, one synthetic event each, whose values are templates over the group.

    While values render, the synthetic row itself stands last in the group, as the template functions expect; ``having`` sees
    the real rows alone. ``inherit`` takes the fields of no row, the last row, or all rows with later ones winning; ``inject``
    "pass-through" gives the source rows as well.

    Numbers, counts and value lists (:data:`FOLDED`) are aggregates: of a row only what they read is shuffled, and a session of
    any length costs what its values hold. Other templates, ``having``, ``sort_key`` and the fields of all rows collect the rows.
    """
    if not key or not aggregate:
        raise ValueError("a key and an aggregate are asked for")
    d = df if where is None else df.where(where)
    own = [*SCOPES[scope]]
    second = F.date_trunc("second", F.col("stamp"))
    fields = [f.name for f in df.schema]
    row = F.struct(F.col("stamp").alias("__o"), *[F.col(f"`{c}`") for c in fields])
    # maps don't order, so rows are sorted by time, then process and text, beside them
    by = F.struct(F.col("stamp"), F.length("pid").alias("n"), F.col("pid"), F.col("message"))
    calls = [folds(t) for t in aggregate.values()]
    if having is None and sort_key is None and inherit != "context" and None not in calls:
        return _folded_groups(df, d, key, own, timeout, aggregate, {x: None for c in calls for x in c}, by, inherit, inject, tags, prefix)
    group = d.withColumns({"__second": second, "__key": F.struct(*key)}).withColumn("__row", F.struct(by.alias("by"), row.alias("row")))
    g = group.groupBy(F.session_window("__second", f"{timeout} seconds").alias("__w"), "__key", *own).agg(F.collect_list("__row").alias("__rows"))
    ordered = F.array_sort("__rows", lambda a, b: F.when(a["by"] < b["by"], -1).when(a["by"] > b["by"], 1).otherwise(0))
    g = g.withColumn("__rows", F.transform(ordered, lambda x: x["row"]))
    rows = F.col("__rows")
    if sort_key is not None:
        s = Scope(frozenset(fields))
        keyed = F.transform(rows, lambda r: F.struct(render(sort_key, RowScope(r, s)).alias("__k"), r.alias("__r")))
        rows = F.transform(F.array_sort(keyed, lambda a, b: F.when(a["__k"] < b["__k"], -1).when(a["__k"] > b["__k"], 1).otherwise(0)), lambda x: x["__r"])
    g = g.withColumn("__rows", rows)
    if having is not None:
        g = g.where(true(having(Scope(frozenset(fields), {}, F.col("__rows")))))
    last = F.element_at("__rows", -1)
    none = F.create_map().cast("map<string,string>")
    nv = {"none": none, "last-message": last["nv"], "context": F.aggregate("__rows", none, lambda a, r: merged(a, r["nv"]))}[inherit]
    base = g.withColumn("__nv", nv)
    for name, template in aggregate.items():
        # values are set one by one: a later one sees those before
        synthetic = F.struct(last["__o"].alias("__o"), *[(F.col("__nv") if c == "nv" else last[c] if c in ("stamp", *own) or inherit != "none" else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in fields])
        seen = F.concat("__rows", F.array(synthetic))
        base = base.withColumn("__nv", with_member(F.col("__nv"), F.lit(prefix + name), F.coalesce(render(template, Scope(frozenset(fields), {}, seen)), F.lit(""))))
    return _synthetic(df, base, lambda c: last[c], own, inherit, inject, tags, prefix)


def _folded_groups(df: DataFrame, d: DataFrame, key: list[str], own: list[str], timeout: int, aggregate: dict[str, str], calls: dict, by: Column, inherit: str, inject: str, tags: tuple[str, ...], prefix: str) -> DataFrame:
    """:func:`grouping_by` where every value is made of aggregates."""
    fields = frozenset(df.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    folded = {call: _Folded(call, f"__a{i}", by, row, Scope(fields)) for i, call in enumerate(calls)}
    last = F.col("__last")
    kept = F.max_by(row, by) if inherit == "last-message" else F.struct(F.max("stamp").alias("stamp"))
    group = d.withColumns({"__second": F.date_trunc("second", F.col("stamp")), "__key": F.struct(*key)}).groupBy(F.session_window("__second", f"{timeout} seconds").alias("__w"), "__key", *own)
    base = group.agg(kept.alias("__last"), *[c.alias(n) for f in folded.values() for n, c in f.aggregates.items()])
    of_last = lambda c: F.col(f"`{c}`") if c in own else last[c] if c == "stamp" or inherit != "none" else F.lit(None)
    base = base.withColumn("__nv", last["nv"] if inherit == "last-message" else F.create_map().cast("map<string,string>"))
    for name, template in aggregate.items():
        synthetic = F.struct(*[(F.col("__nv") if f.name == "nv" else of_last(f.name).cast(f.dataType)).alias(f.name) for f in df.schema])
        functions = {n: (lambda _, *args, n=n, synthetic=synthetic: folded[n, args].answer(synthetic)) for n in FOLDED}
        text = F.coalesce(render(template, Scope(fields, {}, F.array(synthetic), functions)), F.lit(""))
        base = base.withColumn("__value", text).withColumn("__nv", with_member(F.col("__nv"), F.lit(prefix + name), F.col("__value")))
    return _synthetic(df, base, of_last, own, inherit, inject, tags, prefix)


def _synthetic(df: DataFrame, base: DataFrame, of_last: Callable[[str], Column], own: list[str], inherit: str, inject: str, tags: tuple[str, ...], prefix: str) -> DataFrame:
    """The groups' synthetic events, beside the source rows if asked for; ``of_last`` gives a field of the group's last row."""
    made = []
    for f in df.schema:
        c = f.name
        value = F.col("__nv") if c == "nv" else F.array(*map(F.lit, tags)).cast(f.dataType) if c == "tags" and tags else of_last(c) if c in ("stamp", *own) or inherit != "none" else F.lit(None)
        if c in ("host", "program", "pid", "message") and c not in own:
            set_ = F.col("__nv")[prefix + c.upper()]
            value = F.coalesce(set_, of_last(c) if inherit != "none" else F.lit(None))
        made.append(value.cast(f.dataType).alias(c))
    out = base.select(*made)
    return out if inject == "aggregate-only" else df.unionByName(out)


def back_reference(column: str | Column, n: int, keys: list[str], order: list) -> Column:
    """The value n rows before, within a key."""
    return F.lag(column, n).over(W.partitionBy(*keys).orderBy(*order))


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], schema: T.StructType | str, fold: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """Streams each key's rows, in order, as dicts through ``fold``, a generator that gives output dicts. A key of any size costs the memory that the fold keeps."""
    ship(df.sparkSession)
    at = [df.columns.index(k) for k in keys]
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(target)

        def rows() -> Iterator[tuple[tuple, dict]]:
            for b in batches:
                for r in b.to_pylist():
                    values = list(r.values())
                    yield tuple(values[i] for i in at), r

        waiting: list[dict] = []
        for _, group in groupby(rows(), key=lambda x: x[0]):
            for out in fold(r for _, r in group):
                waiting.append(out)
                if len(waiting) >= 4096:
                    yield pa.RecordBatch.from_pylist(waiting, schema=kind)
                    waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=kind)

    d = df.repartition(*[F.col(f"`{k}`") for k in keys]) if keys else df.coalesce(1)
    return d.sortWithinPartitions(*keys, *order).mapInArrow(run, target)


def triggered_groups(df: DataFrame, keys: list[str], timeout: int, aggregate: Callable[[list[dict]], dict], schema: T.StructType | str, trigger: Callable[[list[dict]], bool], having: Callable[[list[dict]], bool] | None = None, ts: str = "stamp", tie: tuple[str, ...] = ()) -> DataFrame:
    """Groups that end when ``trigger`` holds over their rows or after more than ``timeout`` seconds without one; after a trigger the next row begins anew."""

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        open_: list[dict] = []

        def emit() -> Iterator[dict]:
            if open_ and (having is None or having(open_)):
                yield aggregate(open_)
            open_.clear()

        for r in rows:
            if open_ and int(r[ts].timestamp()) - int(open_[-1][ts].timestamp()) > timeout:
                yield from emit()
            open_.append(r)
            if trigger(open_):
                yield from emit()
        yield from emit()

    return ordered_fold(df, keys, [ts, *tie], schema, fold)


def rate_limit(df: DataFrame, keys: list[str], rate: int, ts: str = "stamp", tie: tuple[str, ...] = ()) -> DataFrame:
    """Rows that a token bucket per key lets through, in event time: it holds ``rate`` tokens and gains as many a second, in whole ones."""

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        tokens, filled = rate, None
        for r in rows:
            now = r[ts]
            if filled is None:
                filled = now
            gap = now - filled
            new = ((gap.days * 86400 + gap.seconds) * 1_000_000 + gap.microseconds) * rate // 1_000_000
            if new:
                tokens, filled = min(rate, tokens + new), now
            if tokens >= 1:
                tokens -= 1
                yield r

    return ordered_fold(df, keys, [ts, *tie], df.schema, fold)


def iterate(df: DataFrame, keys: list[str], order: list[str], step: Callable[[str], str], first: str, into: str = "iterated") -> DataFrame:
    """``$(iterate next init)``: each row gets what the row before made of its own value."""

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        value = first
        for r in rows:
            yield r | {into: value}
            value = step(value)

    return ordered_fold(df, keys, order, T.StructType([*df.schema, T.StructField(into, T.StringType())]), fold)


_ERROR = r"(?:[A-Za-z_$][\w$]*[.\\])*[A-Za-z_$][\w$]*(?:Exception|Error|Throwable|Fault)\b"
#: Stack traces as state machines: what begins one in no state, and what goes on from a state, with the state that follows (None: the trace ends with that line).
TRACES: dict[str, list[tuple[str, str | None]]] = {
    "": [
        (r"^Traceback \(most recent call last\):$", "py"), (r"^Unhandled exception:$", "dart"), (r"\bPHP (?:Notice|Warning|Parse error|Fatal error):", "php"), (r"^panic: |\bpanic: ", "go-panic"), (r"http: panic serving ", "go"),
        (rf"^\S*{_ERROR} \(.*\):$", "ruby"), (rf"(?:^|\s){_ERROR}(?::|$|\s*$)", "java"),
    ],
    "java": [(r"^\s+(?:eval )?at\s", "java"), (r"^\s*\.{3} \d+ ", "java"), (r"^\s*(?:Caused by|Suppressed|Wrapped by): ", "java"), (r"^\s*-{3,} ", "java"), (r"^\s*nested exception is", "java"), (rf"^\s+{_ERROR}", "java")],
    "py": [(r"^\s+\S", "py"), (r"^(?:[^\s.():]+\.)*[^\s.():]+(?::|$)", "py-end")],
    "py-end": [(r"^$", "py-next"), (r"^(?:During handling of the above|The above exception was the direct)", "py-next")],
    "py-next": [(r"^$", "py-next"), (r"^(?:During handling of the above|The above exception was the direct)", "py-next"), (r"^Traceback \(most recent call last\):$", "py")],
    "php": [(r"^(?:PHP )?Stack trace:$", "php"), (r"^(?:PHP\s+)?#?\d+[.: ]", "php"), (r"^\s+thrown in ", None)],
    "go-panic": [(r"^\[signal ", "go-panic"), (r"^\s+panic: ", "go-panic"), (r"^$", "go"), (r"^goroutine \d+ \[", "go-frame")],
    "go": [(r"^$", "go"), (r"^goroutine \d+ \[", "go-frame"), (r"^\S+\(.*\)$", "go-place")],
    "go-frame": [(r"^(?:created by )?\S+(?:\(.*\)|\.\S+)", "go-place"), (r"^$", "go")],
    "go-place": [(r"^\s", "go-frame")],
    "ruby": [(r"^\s*$", "ruby"), (r"^\s+.*\.rb:\d+:in ", "ruby"), (r"^\s+\S+:\d+:in ", "ruby"), (r"^\s+\d+: ", "ruby")],
    "dart": [(r"^#\d+\s", "dart-stack"), (r"^<asynchronous suspension>$", "dart-stack"), (r"^.+$", "dart")],
    "dart-stack": [(r"^#\d+\s", "dart-stack"), (r"^<asynchronous suspension>$", "dart-stack")],
}


def trace_steps() -> Callable[[str, str], tuple[bool, str]]:
    """A function of a state and a line: whether the line begins a record, and the state that follows."""
    import re

    rules = {state: [(re.compile(rx), to) for rx, to in steps] for state, steps in TRACES.items()}

    def one(state: str, line: str) -> tuple[bool, str]:
        step = next((to for rx, to in rules[state] if rx.search(line)), "no") if state else "no"
        begins = step == "no"
        if begins:
            step = next((to for rx, to in rules[""] if rx.search(line)), "")
        return begins, step or ""

    return one


def smart_records(lines: Iterator[str]) -> Iterator[bool]:
    """Whether each line begins a record: stack traces go on by :data:`TRACES`, any other line stands alone."""
    step, state = trace_steps(), ""
    for line in lines:
        begins, state = step(state, line)
        yield begins


def smart_begins(df: DataFrame, key: list[str], order: list[str], line: str) -> DataFrame:
    """``df`` with ``__smart``: :func:`smart_records` over each key's lines in order.

    Batches pass as columns. What follows from a state by a text is found once for each text of a batch, so a row costs one
    step of a table; the state at a batch's end goes on in the next.
    """
    ship(df.sparkSession)
    target = T.StructType([*df.schema, T.StructField("__smart", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        step = trace_steps()
        kind, state, before = to_arrow_schema(target), "", None
        for b in batches:
            if not b.num_rows:
                continue
            first = np.zeros(b.num_rows, dtype=bool)
            own = {k: b.column(k) for k in key}
            for c in own.values():
                here, last = c.slice(1), c.slice(0, len(c) - 1)
                other = pc.or_kleene(pc.fill_null(pc.not_equal(here, last), False), pc.xor(pc.is_null(here), pc.is_null(last)))
                first[1:] |= other.to_numpy(zero_copy_only=False)
            now = [c[0].as_py() for c in own.values()]
            first[0] = before is not None and now != before
            before = [c[len(c) - 1].as_py() for c in own.values()]
            coded = pc.fill_null(b.column(line), "").dictionary_encode()
            texts, known, begins = coded.dictionary.to_pylist(), {}, []
            for i, new in zip(coded.indices.to_pylist(), first.tolist()):
                if new:
                    state = ""
                at = (state, i)
                found = known.get(at)
                if found is None:
                    found = known[at] = step(state, texts[i])
                begin, state = found
                begins.append(begin)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(begins, pa.bool_())], schema=kind)

    d = df.repartition(*[F.col(f"`{k}`") for k in key]) if key else df.coalesce(1)
    return d.sortWithinPartitions(*key, *order).mapInArrow(run, target)


def group_lines(df: DataFrame, key: list[str], order: list[str], mode: str = "indented", prefix: str | None = None, suffix: str | None = None, line: str = "line", separator: str = "\n", timeout: int | None = None, ts: str | None = None) -> DataFrame:
    """Physical lines to records: key, first order value, n_lines, message.

    ``indented``: a line that begins with white space goes on; ``regexp``: ``prefix`` begins a record; ``prefix-suffix``: one
    also ends after ``suffix``; ``smart``: stack traces of Python, Java, JavaScript, PHP, Go,
    Ruby and Dart are one record each. A running count of beginnings numbers the records.
    """
    c = F.col(line)
    w = W.partitionBy(*key).orderBy(*order)
    before = F.lag(line).over(w)
    if mode == "indented":
        begins = ~c.rlike(r"^[ \t]")
    elif mode == "regexp":
        begins = c.rlike(prefix)
    elif mode == "prefix-suffix":
        begins = c.rlike(prefix) | F.coalesce(before.rlike(suffix), F.lit(False))
    elif mode == "smart":
        df, begins = smart_begins(df, key, order, line), F.col("__smart")
    else:
        begins = F.lit(True)
    if timeout is not None:
        begins = begins | F.coalesce(F.unix_timestamp(ts) - F.lag(F.unix_timestamp(ts)).over(w) > timeout, F.lit(False))
    d = df.withColumn("__begins", begins.cast("int")).withColumn("__record", F.sum("__begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = d.groupBy(*key, "__record").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("__line")))).alias("__lines"))
    return g.select(*key, *[F.col("__lines")[0][o].alias(o) for o in order], F.size("__lines").alias("n_lines"), F.array_join(F.transform("__lines", lambda x: x["__line"]), separator).alias("message"))
