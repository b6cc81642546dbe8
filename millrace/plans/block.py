"""Expression blocks: statements over variables and fields, compiled to one projection and one filter.

A statement whose value is false, or that errs, fails the block: the row goes. Later statements see earlier assignments.
``done`` ends a row's block with success, ``drop`` with failure; errors are kept in a column if asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import typed
from millrace.functions.typed import Expr, wrap


class Block:
    """Builds statement by statement; :meth:`apply` gives the table after the block.

    What a statement gives is put in columns of its own, so later ones refer to it and plans grow in step with the text.
    """

    def __init__(self, df: DataFrame, kinds: dict[str, str] | None = None) -> None:
        self.source = df
        self.stages: list[dict[str, Column]] = []
        self.early: list[Column] = []  # tests before any assignment: they go to the scan
        self.kinds = dict(kinds or {})
        self.values: dict[str, Expr] = {}
        self.alive: Column = F.lit(True)  # rows that haven't failed
        self.running: Column = F.lit(True)  # and haven't ended by ``done``
        #: Text that failures from here on carry.
        self.note = ""
        self.errors: list[tuple[Column, str]] = []
        self.declared: set[str] = set()
        self.temporary: list[str] = []

    def __getitem__(self, name: str) -> Expr:
        """A variable or column."""
        if name in self.values:
            return self.values[name]
        kind = self.source.schema[name].dataType.typeName()
        column = F.col(f"`{name}`")
        return typed.expr(column.cast("timestamp") if kind == "timestamp_ntz" else column, self.kinds.get(name, _KINDS.get(kind, typed.STRING)))

    def keep(self, *columns: Column) -> list[Column]:
        names = [f"__b{len(self.temporary) + i}" for i in range(len(columns))]
        self.temporary += names
        self.stages.append(dict(zip(names, columns)))
        return [F.col(n) for n in names]

    def staged(self, keep_failed: bool = False) -> DataFrame:
        """The table with all temporary columns, less the rows that failed.

        The filter stays above the projections (a gate that isn't deterministic holds it there): pushed through them it would
        be spelled out in full, which grows with every statement. Early tests are pushed on their own.
        """
        d = self.source
        if not keep_failed:
            for c in self.early:
                d = d.where(F.coalesce(c, F.lit(False)))
        for s in self.stages:
            d = d.withColumns(s)
        if not keep_failed:
            d = d.withColumn("__gate", F.monotonically_increasing_id()).where(self.alive & (F.col("__gate") >= 0)).drop("__gate")
        return d

    def active(self) -> Column:
        return self.alive & self.running

    def fail(self, ok: Column, what: str) -> None:
        """Rows that are running and for which ``ok`` doesn't hold fail."""
        (bad,) = self.keep(self.running & ~F.coalesce(ok, F.lit(False)))
        self.errors.append((self.alive & bad, what + self.note))
        (self.alive,) = self.keep(self.alive & ~bad)

    def put(self, name: str, value: Column, kind: str, ok: Column) -> None:
        v, o = self.keep(value, F.coalesce(ok, F.lit(False)))
        self.values[name] = Expr(v, kind, o)

    def require(self, test, what: str = "statement") -> Block:
        """An expression statement."""
        e = wrap(test)
        if not self.values and len(self.stages) == 2 * len(self.early):
            self.early.append(e.ok & typed.truthy(e))
        self.fail(e.ok & typed.truthy(e), what)
        return self

    def set(self, name: str, value) -> Block:
        """``name = value``, for the rows that run."""
        e = wrap(value)
        old = self[name] if name in self.values or name in self.source.columns else None
        v, ok = self.keep(e.value, F.coalesce(e.ok, F.lit(False)))
        self.fail(ok, f"set {name}")
        a = self.active()
        if old is None:
            self.put(name, F.when(a, v), e.kind, a & ok)
        else:
            self.put(name, F.when(a, v).otherwise(old.value), e.kind, F.when(a, ok).otherwise(old.ok))
        return self

    def set_if_valid(self, name: str, value) -> Block:
        """``name =?? value``: only where the value is neither null nor an error."""
        e = wrap(value)
        v, use = self.keep(e.value, F.coalesce(self.active() & e.ok & e.value.isNotNull(), F.lit(False)))
        old = self[name] if name in self.values or name in self.source.columns else Expr(F.lit(None), e.kind, F.lit(False))
        self.put(name, F.when(use, v).otherwise(old.value), e.kind, F.when(use, F.lit(True)).otherwise(old.ok))
        return self

    def add(self, name: str, value) -> Block:
        return self.set(name, self[name] + value)

    def declare(self, name: str, value) -> Block:
        """Kept to the end of the pipeline, as a column."""
        self.declared.add(name)
        return self.set(name, value)

    def unset(self, name: str) -> Block:
        e = self[name]
        a = self.active()
        self.put(name, F.when(~a, e.value), e.kind, ~a & e.ok)
        return self

    def when(self, test, then: Callable[[Block], object], otherwise: Callable[[Block], object] | None = None) -> Block:
        """if / else blocks; a failure within the taken one fails the block."""
        e = wrap(test)
        ok, t = self.keep(F.coalesce(e.ok, F.lit(False)), typed.truthy(e))
        self.fail(ok, "condition")
        outer = self.running
        left, owns = [], []
        for taken, body in ((t, then), (~t, otherwise)):
            (own,) = self.keep(outer & taken)
            self.running = own
            if body is not None:
                body(self)
            left.append(self.running)
            owns.append(own)
        # without a ``done`` in either, all that ran runs on
        (self.running,) = [outer] if all(a is b for a, b in zip(left, owns)) else self.keep(left[0] | left[1])
        return self

    def done(self, test=True) -> Block:
        (self.running,) = self.keep(self.running & ~typed.truthy(wrap(test)))
        return self

    def drop(self, test=True) -> Block:
        self.fail(~typed.truthy(wrap(test)), "drop")
        return self

    def apply(self, errors_into: str | None = None) -> DataFrame:
        """The rows that passed, with what was assigned; with ``errors_into``, all rows and their failures."""
        made = {n: F.when(e.ok, e.value) for n, e in self.values.items()}
        if errors_into:
            made[errors_into] = self.failures()
        d = self.staged(errors_into is not None)
        return (d.withColumns(made) if made else d).drop(*self.temporary)

    def failures(self) -> Column:
        return F.filter(F.array(*[F.when(bad, F.lit(what)) for bad, what in self.errors]), lambda x: x.isNotNull())


_KINDS = {"long": typed.INT, "integer": typed.INT, "short": typed.INT, "double": typed.DOUBLE, "float": typed.DOUBLE, "boolean": typed.BOOL, "timestamp": typed.DATETIME, "timestamp_ntz": typed.DATETIME, "array": typed.LIST, "map": typed.DICT, "binary": typed.BYTES, "string": typed.STRING}


def set_fields(target: Column, overrides: dict[str, list[Column]] | None = None, defaults: dict[str, list[Column]] | None = None, replacements: dict[str, list[Column]] | None = None) -> Column:
    """A map with fields set to the first value that isn't null: always, if unset, or if set."""
    out = target
    for how, table in (("over", overrides), ("default", defaults), ("replace", replacements)):
        for k, values in (table or {}).items():
            v = F.coalesce(*values)
            has = F.map_contains_key(out, F.lit(k))
            use = v.isNotNull() & (F.lit(True) if how == "over" else ~has if how == "default" else has)
            out = F.when(use, typed.merged(out, F.create_map(F.lit(k), v))).otherwise(out)
    return out


def unset_empties(target: Column, empties: tuple[str, ...] = ("",), replacement: str | None = None, ignore_case: bool = False) -> Column:
    """A map less its empty values (null, or one of ``empties``), or with them replaced."""
    same = [e.lower() for e in empties] if ignore_case else list(empties)
    bad = lambda v: v.isNull() | (F.lower(v) if ignore_case else v).isin(same)
    if replacement is not None:
        return F.transform_values(target, lambda _, v: F.when(bad(v), F.lit(replacement)).otherwise(v))
    return F.map_filter(target, lambda _, v: ~bad(v))


def flatten(json_text: Column, separator: str = ".") -> Column:
    """A nested object's leaves under joined names."""
    from millrace.functions.text_formats import json_fields

    return json_fields(json_text, "", separator)


def keys(target: Column) -> Column:
    return F.map_keys(target)


def dict_to_pairs(target: Column, key: str, value: str) -> Column:
    return F.transform(F.map_entries(target), lambda e: F.struct(e["key"].alias(key), e["value"].alias(value)))


def vars_(block: Block) -> Column:
    """The block's variables as a map of text."""
    return F.create_map(*[x for n, e in block.values.items() for x in (F.lit(n), e.value.cast("string"))])
