"""Programs as text: a small language over named collections.

Python's grammar is the surface, with ``++`` for the union of collections, a backtick before tags, ``:=`` for
what changes, and ``<<`` for feeds.  A program is a list of statements and a last expression, its value.

* values: integers, strings, True, False, ``a.field``, ``rec(x=e, y=e)``, tuples ``(a, b)`` with ``t.0`` and
  ``a, b = t``, arithmetic with ``+ - * //`` (``+`` joins strings), comparisons that chain, ``and or not``,
  ``e if c else f``
* collections: ``[1, 2]``, registered sources, ``[e for x in xs if p for y in ys]``, ``xs ++ ys``,
  ``xs if c else ys``
* aggregates: ``sum(xs)``, ``max(xs)``, ``min(xs)``, ``count(xs)``; no rows give 0 and the least value
* groups: ``groupby(xs, f)`` in a comprehension's ``for g in``, where ``sum(g)`` is of the group and
  ``key(g)`` its key; ``groupby(xs, f)[k]`` is one group
* tagged values: `` `some(7)``, `` `none``; ``match e:`` with ``case `some(v):``, ``case `none:`` and ``case _:``, for
  statements, for a function's value, and as ``x = match e:``; all tags that a value can have need a case
* functions: ``def f(x, y: Int):`` of several statements, with ``if`` and ``match`` that give values, and
  ``return`` or a last expression; a body with ``yield`` makes a collection
* folds: ``acc = 0`` (or ``:=``) then ``for x in xs:`` with ``acc = e``, ``acc += e``, ``if`` and ``match``
* feeds: ``h = defer()``, then ``h << e``, also in loops and under conditions, or once ``h <<= xs``
* transactions: ``x: Mut(Int, Txn) := e``, then ``with begin():`` in a loop or alone; ``await_final(x)``; a feed in
  the block is a reply of the commit, in the order of the source's positions and of the program's blocks; a final
  value may seed a later variable, whose blocks are a phase after it

Every mistake that can be told from the text is a TextError that names its line; statements go on after a
mistake, so that one error names all that do not depend on each other.  Nothing runs while a program is built,
but for the replay of a store when its final values or replies are first read: aggregates, folds and final values
are one-row subqueries of the plan.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import scalars
from tidewell.operators.aggregate import largest, least, size, total
from tidewell.operators.bags import Feed, FeedError
from tidewell.operators.collection import POSITION
from tidewell.operators.transact import TransactionError, Transactions
from tidewell.plans.blocks import MARK, TAG, Body, Routine, tag_of

LONG, TEXT, BOOL, UNIT = T.LongType(), T.StringType(), T.BooleanType(), T.NullType()
VALUE = "value"
ANNOTATIONS = {"Int": LONG, "String": TEXT, "Bool": BOOL}
AGGREGATES = {"sum", "max", "min", "count"}


class TextError(ValueError):
    """A program that does not read, or whose types do not fit."""


@dataclass
class Val:
    """A scalar: a column and its type."""

    col: Column
    kind: T.DataType


@dataclass
class Coll:
    """A collection: rows, and how the element is read from them (one column, or a record of all)."""

    df: DataFrame
    record: bool

    def element(self, alias: str) -> Val:
        names = [c for c in self.df.columns if c != POSITION]
        at = lambda c: F.col(f"`{alias}`.`{c}`")
        if not self.record:
            return Val(at(names[0]), self.df.schema[names[0]].dataType)
        return Val(F.struct(*(at(c).alias(c) for c in names)), T.StructType([self.df.schema[c] for c in names]))


@dataclass
class Groups:
    coll: Coll
    key: Val
    rows: DataFrame


@dataclass
class Group:
    """One group inside a comprehension over groups: aggregates of it are aggregate expressions."""

    element: Val
    key: Val


@dataclass
class Function:
    names: list[str]
    body: ast.expr | list[ast.stmt]
    scope: dict
    kinds: list[T.DataType | None] = field(default_factory=list)

    @property
    def generates(self) -> bool:
        return isinstance(self.body, list) and any(isinstance(x, ast.Yield) for s in self.body for x in ast.walk(s))


@dataclass
class Channel:
    """A deferred collection: a feed, and the type of its elements once something was fed."""

    feed: Feed
    kind: T.DataType | None = None
    record: bool = False
    replies: bool = False


@dataclass
class Shared:
    """A variable of transactions; it is read in blocks, and by await_final."""

    name: str
    kind: T.DataType


def _closed(s: ast.If, rest: list[ast.stmt]) -> ast.If | None:
    """``s``, whose branches all return, with what follows as its last branch; None if one goes on."""
    if not isinstance(s.body[-1], ast.Return):
        return None
    if not s.orelse:
        return ast.copy_location(ast.If(s.test, s.body, rest), s)
    inner = _closed(s.orelse[0], rest) if len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If) else None
    return inner and ast.copy_location(ast.If(s.test, s.body, [inner]), s)


def tagged(kind) -> bool:
    return isinstance(kind, T.StructType) and len(kind) > 0 and kind[0].name == TAG


def arms(kind: T.StructType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in kind.fields[1:]}


def joined_kind(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type of values that are of either type; None where there is none."""
    if a == b:
        return a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return LONG
    if tagged(a) and tagged(b):
        found = arms(a)
        for name, kind in arms(b).items():
            found[name] = joined_kind(found[name], kind) if name in found else kind
            if found[name] is None:
                return None
        return T.StructType([a[0], *(T.StructField(k, found[k]) for k in sorted(found))])
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.fieldNames() == b.fieldNames() and not (tagged(a) or tagged(b)):
        kinds = [joined_kind(x.dataType, y.dataType) for x, y in zip(a, b, strict=True)]
        return None if None in kinds else T.StructType([T.StructField(x.name, k) for x, k in zip(a, kinds, strict=True)])
    return None


def widened(v: Val, kind: T.DataType) -> Val:
    """``v`` as a value of the wider type ``kind``."""
    if v.kind == kind:
        return v
    if tagged(kind):
        own = arms(v.kind)
        made = [widened(Val(v.col[k], own[k]), x).col if k in own else F.lit(None).cast(x) for k, x in arms(kind).items()]
        return Val(F.struct(v.col[TAG].alias(TAG), *(c.alias(k) for c, k in zip(made, arms(kind), strict=True))), kind)
    if isinstance(kind, T.StructType):
        return Val(F.struct(*(widened(Val(v.col[f.name], v.kind[f.name].dataType), f.dataType).col.alias(f.name) for f in kind)), kind)
    return Val(v.col.cast(kind), kind)


class Prepared:
    """Program text as Python's grammar has it; every character keeps its place, strings and comments stay."""

    def __init__(self, text: str):
        out, line, at, self.changes, self.targets = [], 1, 0, set(), {}
        while at < len(text):
            c, two = text[at], text[at : at + 2]
            if c in "'\"" or c == "#":
                end = re.compile(r"#[^\n]*" if c == "#" else c + r"(?:[^\\\n" + c + r"]|\\.)*" + c).match(text, at)
                if end is None:
                    raise TextError(f"line {line}: a string does not end")
                out.append(end.group())
                at = end.end()
            elif two == "++" or two == ":=":
                if two == ":=":
                    self.changes.add(line)
                out.append("@ " if two == "++" else " =")
                at += 2
            else:
                line += c == "\n"
                before = text[at - 1] if at else " "
                if c == "." and text[at + 1 : at + 2].isdigit() and (before.isidentifier() or before in ")]"):
                    c = "._"
                out.append(MARK if c == "`" else c)
                at += 1
        lines = "".join(out).split("\n")
        for k, x in enumerate(lines):
            if found := re.match(r"(\s*)(\w+)\s*=\s*(match\b.*)$", x):
                self.targets[k + 1] = found[2]
                lines[k] = found[1] + found[3]
        try:
            self.tree = ast.parse("\n".join(lines))
        except SyntaxError as fault:
            raise TextError(f"line {fault.lineno}: {fault.msg}") from None


class Text:
    """``Text(spark, users=df).run(program)``."""

    def __init__(self, spark: SparkSession, **sources: DataFrame):
        self.spark, self._count = spark, 0
        self.scope: dict = {k: Coll(v, record=True) for k, v in sources.items()}

    def run(self, program: str) -> DataFrame:
        """The program's value: the elements' columns of a collection, or one row ``value`` of a scalar."""
        made = Prepared(program)
        self.changes, self.targets = made.changes, made.targets
        self.shared: dict[str, tuple[T.DataType, DataFrame]] = {}
        self.writers: list[tuple] = []
        self.replies: dict[str, Channel] = {}
        self.sealed: dict[str, tuple[Transactions, DataFrame | None]] = {}
        scope, result, faults, broken = dict(self.scope), None, [], set()
        for statement in made.tree.body:
            if broken & {x.id for x in ast.walk(statement) if isinstance(x, ast.Name)}:
                result = None
                broken |= self._names(statement)  # not a mistake of its own
                continue
            try:
                result = self._statement(statement, scope)
            except TextError as fault:
                faults.append(str(fault))
                broken |= self._names(statement)
            except (FeedError, TransactionError) as fault:
                faults.append(str(self._fail(statement, str(fault))))
        if not faults and (result is None or not made.tree.body):
            faults.append("the last line must be an expression")
        if isinstance(result, Channel) and not faults:
            result = self._read(made.tree.body[-1], result)
        if not faults and not isinstance(result, (Coll, Val)):
            faults.append("the program's value must be a collection or a scalar")
        if faults:
            raise TextError("; ".join(faults))
        if isinstance(result, Coll):
            return result.df.drop(POSITION)
        return self.spark.range(1).select(result.col.alias(VALUE))

    def _names(self, s: ast.stmt) -> set[str]:
        """What a statement defines."""
        found = {x.id for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
        return found | ({s.name} if isinstance(s, ast.FunctionDef) else set()) | ({self.targets[s.lineno]} if s.lineno in self.targets else set())

    def _fail(self, node: ast.AST, what: str) -> TextError:
        return TextError(f"line {getattr(node, 'lineno', '?')}: {what}")

    # --- statements ---

    def _statement(self, s: ast.stmt, scope: dict):
        if isinstance(s, ast.Expr):
            if isinstance(s.value, ast.BinOp) and isinstance(s.value.op, ast.LShift):
                return self._feed(s.value, scope, lambda v: self.spark.range(1).select(v.col.alias(VALUE)))
            return self.value(s.value, scope)
        if isinstance(s, ast.Assign) and len(s.targets) == 1:
            return self._assign(s, s.targets[0], s.value, scope)
        if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.value is not None:
            return self._annotated(s, scope)
        if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
            return self._augmented(s, scope)
        if isinstance(s, ast.FunctionDef):
            scope[s.name] = Function([a.arg for a in s.args.args], s.body[0].value if len(s.body) == 1 and isinstance(s.body[0], ast.Return) and s.body[0].value else s.body, scope, [self._annotation(a.annotation) for a in s.args.args])
        elif isinstance(s, ast.If):
            test = self._scalar(s.test, scope)
            if test.kind != BOOL:
                raise self._fail(s, "a condition is a boolean")
            branches = [(test.col, own := dict(scope), self._block(s.body, own)), (None, other := dict(scope), self._block(s.orelse, other))]
            return self._merged(s, scope, branches)
        elif isinstance(s, ast.Match):
            return self._matched(s, scope)
        elif isinstance(s, ast.With):
            self._transaction(s, scope, None, None)
        elif isinstance(s, ast.For) and not s.orelse:
            self._for(s, scope)
        elif not isinstance(s, ast.Pass):
            raise self._fail(s, "this statement is not part of the language")
        return None

    def _block(self, body: list[ast.stmt], scope: dict):
        """The value of a block's return or last expression; None if it has none."""
        result = None
        for k, s in enumerate(body):
            if isinstance(s, ast.Return):
                if k < len(body) - 1:
                    raise self._fail(body[k + 1], "nothing comes after a return")
                return self.value(s.value, scope) if s.value else None
            if isinstance(s, ast.If) and k < len(body) - 1 and (whole := _closed(s, body[k + 1 :])):
                return self._statement(whole, scope)
            result = self._statement(s, scope)
        return result

    def _assign(self, s: ast.stmt, target: ast.expr, value: ast.expr, scope: dict) -> None:
        if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id == "defer" and not value.args and isinstance(target, ast.Name):
            scope[target.id] = Channel(Feed(target.id))
            return
        found = self.value(value, scope)
        if isinstance(target, ast.Name):
            if isinstance(scope.get(target.id), Shared):
                raise self._fail(s, f"{target.id!r} is written in transactions alone")
            scope[target.id] = found
        else:
            self._destructure(s, target, found, scope)

    def _destructure(self, s: ast.AST, target: ast.expr, found, scope: dict) -> None:
        if isinstance(target, ast.Name):
            scope[target.id] = found
            return
        if not isinstance(target, ast.Tuple) or not isinstance(found, Val) or not isinstance(found.kind, T.StructType) or tagged(found.kind):
            raise self._fail(s, "only tuples and records come apart")
        if len(target.elts) != len(found.kind):
            raise self._fail(s, f"{len(found.kind)} names are needed")
        for x, f in zip(target.elts, found.kind, strict=True):
            self._destructure(s, x, Val(found.col[f.name], f.dataType), scope)

    def _annotation(self, e: ast.expr | None) -> T.DataType | None:
        """The type that an annotation names; None for one that leaves it open."""
        if e is None or (isinstance(e, ast.Name) and e.id == "_"):
            return None
        if isinstance(e, ast.Name) and e.id in ANNOTATIONS:
            return ANNOTATIONS[e.id]
        raise self._fail(e, "an annotation is Int, String, Bool or _")

    def _annotated(self, s: ast.AnnAssign, scope: dict) -> None:
        mut = isinstance(s.annotation, ast.Call) and isinstance(s.annotation.func, ast.Name) and s.annotation.func.id == "Mut"
        found, kind = self.value(s.value, scope), self._annotation(s.annotation.args[0] if mut else s.annotation)
        if mut != (s.lineno in self.changes):
            raise self._fail(s, "':=' and an annotation Mut(...) go together")
        if kind is not None and (not isinstance(found, Val) or joined_kind(found.kind, kind) != kind):
            raise self._fail(s, f"this is no {kind.simpleString()}")
        domain = s.annotation.args[1] if mut and len(s.annotation.args) > 1 else None
        if not isinstance(domain, ast.Name) or domain.id != "Txn":
            scope[s.target.id] = found
            return
        if not isinstance(found, Val):
            raise self._fail(s, "a variable of transactions holds a scalar")
        if s.target.id in self.shared:
            raise self._fail(s, f"{s.target.id!r} is there already")
        scope[s.target.id] = Shared(s.target.id, found.kind)
        self.shared[s.target.id] = (found.kind, self.spark.range(1).select(found.col.alias(s.target.id)))

    def _augmented(self, s: ast.AugAssign, scope: dict) -> None:
        own = scope.get(s.target.id)
        if isinstance(s.op, ast.LShift):
            if not isinstance(own, Channel):
                raise self._fail(s, f"{s.target.id!r} is not deferred")
            coll = self._coll(s.value, scope)
            own.feed.define(coll.df.drop(POSITION))
            own.kind, own.record = coll.element("x").kind, coll.record
        elif isinstance(own, Val):
            scope[s.target.id] = self._binary(s, s.op, own, self._scalar(s.value, scope))
        else:
            raise self._fail(s, f"{s.target.id!r} is written in transactions alone" if isinstance(own, Shared) else f"{s.target.id!r} has no initial value")

    def _choice(self, node: ast.AST, test: Column, a, b):
        """``a`` where the test holds, else ``b``: scalars, or collections whose rows are gated."""
        if isinstance(a, Val) and isinstance(b, Val):
            kind = joined_kind(a.kind, b.kind)
            if kind is None:
                raise self._fail(node, "a choice needs a boolean and two values of one type")
            return Val(scalars.choose(test, widened(a, kind).col, widened(b, kind).col), kind)
        if isinstance(a, Coll) and isinstance(b, Coll):
            kind = joined_kind(a.element("x").kind, b.element("x").kind)
            if kind is None:
                raise self._fail(node, "both collections have one type")
            holds = F.coalesce(test, F.lit(False))
            one, other = (self._widen(x, kind) for x in (a, b))
            return Coll(one.df.drop(POSITION).filter(holds).unionByName(other.df.drop(POSITION).filter(~holds)), a.record)
        raise self._fail(node, "every branch gives a value of one type")

    def _merged(self, node: ast.stmt, scope: dict, branches: list[tuple[Column | None, dict, object]]):
        """Names that the branches set, chosen into ``scope``; and the branches' value, if they have one."""
        *tests, (_, last, value) = branches
        values = [b[2] for b in branches]
        changed = {k for _, own, _ in branches for k in own if own[k] is not scope.get(k)}
        for k in sorted(changed):
            if not all(k in own for _, own, _ in branches):
                scope.pop(k, None)  # of one branch alone
                continue
            made = last[k]
            for test, own, _ in reversed(tests):
                made = self._choice(node, test, own[k], made)
            scope[k] = made
        if all(v is None for v in values):
            return None
        if any(v is None for v in values):
            raise self._fail(node, "every branch must give a value")
        for test, _, found in reversed(tests):
            value = self._choice(node, test, found, value)
        return value

    def _cases(self, s: ast.Match, subject: Val) -> list[tuple[str | None, str | None, ast.match_case]]:
        """The cases that can be reached, checked: tag, bound name and case."""
        if not tagged(subject.kind):
            raise self._fail(s, "only tagged values are matched")
        known, seen, found = arms(subject.kind), set(), []
        for k, case in enumerate(s.cases):
            try:
                tag, name = tag_of(case.pattern)
            except ValueError as fault:
                raise self._fail(case.pattern, str(fault)) from None
            if case.guard is not None:
                raise self._fail(case.guard, "a case has no guard")
            if tag is None and k < len(s.cases) - 1:
                raise self._fail(case.pattern, "case _ comes last")
            if tag in seen:
                raise self._fail(case.pattern, f"a second case for {tag!r}")
            seen.add(tag)
            if tag in known and (name is None) != isinstance(known[tag], T.NullType):
                raise self._fail(case.pattern, f"{tag!r} has {'no value' if name else 'a value'}")
            if tag is None or tag in known:
                found.append((tag, name, case))
        if None not in seen and (missing := sorted(set(known) - seen)):
            raise self._fail(s, f"no case for {missing}")
        return found

    def _matched(self, s: ast.Match, scope: dict):
        subject, branches = self._scalar(s.subject, scope), []
        for tag, name, case in self._cases(s, subject):
            own = dict(scope)
            inner = own | ({name: Val(subject.col[tag], arms(subject.kind)[tag])} if name and name != "_" else {})
            value = self._block(case.body, inner)
            own |= {k: v for k, v in inner.items() if k != name}
            branches.append((None if tag is None else subject.col[TAG] == tag, own, value))
        value = self._merged(s, scope, branches)
        if s.lineno not in self.targets:
            return value
        if value is None:
            raise self._fail(s, "every branch must give a value")
        scope[self.targets[s.lineno]] = value
        return None

    # --- feeds and generators ---

    def _channel(self, e: ast.expr, scope: dict) -> Channel:
        if not isinstance(e, ast.Name) or not isinstance(scope.get(e.id), Channel):
            raise self._fail(e, "only deferred collections are fed")
        return scope[e.id]

    def _feed(self, e: ast.BinOp, scope: dict, rows) -> None:
        channel, value = self._channel(e.left, scope), self._scalar(e.right, scope)
        self._typed(e, channel, value.kind)
        element = self._made(rows(value), value, [])
        channel.feed.put(lambda: self._widen(element, channel.kind).df)

    def _typed(self, e: ast.AST, channel: Channel, kind: T.DataType) -> None:
        joined = kind if channel.kind is None else joined_kind(channel.kind, kind)
        if joined is None:
            raise self._fail(e, "a feed's values have one type")
        channel.kind, channel.record = joined, isinstance(joined, T.StructType)

    def _widen(self, coll: Coll, kind: T.DataType) -> Coll:
        value = coll.element("x")
        return coll if value.kind == kind else self._made(coll.df.alias("x").select(widened(value, kind).col.alias(VALUE)), Val(F.col(VALUE), kind), [])

    def _read(self, e: ast.AST, channel: Channel) -> Coll:
        if channel.replies:
            self._committed(next(k for k, c in self.replies.items() if c is channel))
        try:
            return Coll(channel.feed.read(), channel.record)
        except FeedError as fault:
            raise self._fail(e, str(fault)) from None

    def _for(self, s: ast.For, scope: dict) -> None:
        if any(isinstance(x, ast.With) for b in s.body for x in ast.walk(b)):
            blocks = [b for b in s.body if isinstance(b, ast.With)]
            if len(blocks) != 1 or any(isinstance(x, ast.With) for b in s.body if b is not blocks[0] for x in ast.walk(b)):
                raise self._fail(s, "a loop holds one transaction, not under a condition")
            return self._transaction(blocks[0], scope, s, self._coll(s.iter, scope))
        if any(isinstance(x, ast.BinOp) and isinstance(x.op, ast.LShift) for b in s.body for x in ast.walk(b)):
            def put(e, value, rows, own):
                self._feed(e, own | {k: v for k, v in scope.items() if isinstance(v, Channel)}, lambda v: rows.select(v.col.alias(VALUE)))

            return self._emit([s], scope, None, put)
        if not isinstance(s.target, ast.Name):
            raise self._fail(s, "a fold's loop names one variable")
        return self._loop(s, scope)

    def _emit(self, body: list[ast.stmt], scope: dict, rows: DataFrame | None, put) -> None:
        """Loops, conditions and definitions down to each yield or feed: ``put(node, value, rows, scope)``."""
        for s in body:
            if isinstance(s, ast.For) and not s.orelse:
                coll = self._coll(s.iter, scope)
                self._count += 1
                alias = f"c{self._count}"
                own, over = dict(scope), coll.df.drop(POSITION).alias(alias)
                self._destructure(s, s.target, coll.element(alias), own)
                self._emit(s.body, own, over if rows is None else rows.crossJoin(over), put)
            elif isinstance(s, ast.If):
                test = self._scalar(s.test, scope)
                holds = F.coalesce(test.col, F.lit(False))
                base = self.spark.range(1) if rows is None else rows
                self._emit(s.body, dict(scope), base.filter(holds), put)
                self._emit(s.orelse, dict(scope), base.filter(~holds), put)
            elif isinstance(s, ast.Match):
                subject, base, rest = self._scalar(s.subject, scope), self.spark.range(1) if rows is None else rows, F.lit(True)
                for tag, name, case in self._cases(s, subject):
                    holds = rest if tag is None else subject.col[TAG] == tag
                    rest = rest & ~holds
                    bound = {name: Val(subject.col[tag], arms(subject.kind)[tag])} if name and name != "_" else {}
                    self._emit(case.body, scope | bound, base.filter(holds), put)
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Yield) and s.value.value is not None:
                put(s.value, s.value.value, self.spark.range(1) if rows is None else rows, scope)
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.BinOp) and isinstance(s.value.op, ast.LShift):
                put(s.value, s.value.right, self.spark.range(1) if rows is None else rows, scope)
            elif isinstance(s, ast.Assign) and len(s.targets) == 1:
                self._destructure(s, s.targets[0], self.value(s.value, scope), scope)
            elif not isinstance(s, ast.Pass):
                raise self._fail(s, "a loop that yields or feeds has loops, conditions and definitions")

    def _generated(self, node: ast.AST, f: Function, scope: dict) -> Coll:
        made: list[Coll] = []

        def put(e, value, rows, own):
            v = self._scalar(value, own)
            made.append(self._made(rows.select(v.col.alias(VALUE)), v, []))

        self._emit(f.body, scope, None, put)
        kind = made[0].element("x").kind
        for x in made[1:]:
            kind = joined_kind(kind, x.element("x").kind)
            if kind is None:
                raise self._fail(node, "what a function yields has one type")
        first, *others = (self._widen(x, kind) for x in made)
        for x in others:
            first = Coll(first.df.unionByName(x.df), first.record)
        return first

    # --- transactions ---

    def _transaction(self, s: ast.With, scope: dict, loop: ast.For | None, coll: Coll | None) -> None:
        """One writer: its body's types are checked here, and its rows replayed when a result is read."""
        call = s.items[0].context_expr
        if len(s.items) != 1 or s.items[0].optional_vars or not isinstance(call, ast.Call) or not isinstance(call.func, ast.Name) or call.func.id != "begin" or call.args:
            raise self._fail(s, "a block opens with 'with begin():'")
        if any(isinstance(x, ast.With) for b in s.body for x in ast.walk(b)):
            raise self._fail(s, "transactions do not nest")
        own, statements = dict(scope), list(s.body)
        if loop is not None:
            if not isinstance(loop.target, ast.Name):
                raise self._fail(loop, "a loop of transactions names one variable")
            if POSITION not in coll.df.columns:
                raise self._fail(loop, "a loop needs positions: a list, or a source with a column 'pos'")
            own[loop.target.id] = coll.element("x")
            before = loop.body[: loop.body.index(s)]
            if any(not isinstance(b, ast.Assign) for b in before) or len(before) < len(loop.body) - 1:
                raise self._fail(loop, "beside its block, a loop of transactions has definitions before it")
            statements = before + statements
        used = {x.id for b in statements for x in ast.walk(b) if isinstance(x, ast.Name)}
        touches = sorted(n for n in used if isinstance(scope.get(n), Shared))
        routines, ready = {}, sorted(used)
        for name in ready:
            f = scope.get(name)
            if isinstance(f, Function) and name not in routines:
                routines[name] = Routine(f.names, f.body)
                ready += [x.id for b in (f.body if isinstance(f.body, list) else [f.body]) for x in ast.walk(b) if isinstance(x, ast.Name)]
        replied = self._check(statements, own | {n: Val(F.lit(None).cast(scope[n].kind), scope[n].kind) for n in touches}, scope, set(touches))
        if not touches:
            raise self._fail(s, "a block touches a variable of transactions")
        if gone := sorted({*touches, *replied} & self.sealed.keys()):
            raise self._fail(s, f"the store was read already, with {', '.join(map(repr, gone))}")
        item = loop.target.id if loop is not None else None
        outer = {n: f"_outer_{n}" for n in sorted(set(ready)) if isinstance(scope.get(n), Val) and n != item}
        rows = coll.df if coll is not None else self.spark.range(1).select(F.lit(0).cast("long").alias(POSITION))
        fields = [c for c in coll.df.columns if c != POSITION] if coll is not None else []
        rows = rows.select(*rows.columns, *(scope[n].col.alias(c) for n, c in outer.items()))
        body = Body(statements, item, coll.record if coll is not None else False, fields, outer, routines, frozenset(touches), frozenset(replied))
        self.writers.append((rows, touches, replied, body))
        for name in replied:
            channel = scope[name]
            if name not in self.replies:
                self.replies[name], channel.replies = channel, True
                channel.feed.put(lambda name=name, channel=channel: self._replied(name, channel))

    def _check(self, body: list[ast.stmt], own: dict, scope: dict, shared: set[str]) -> set[str]:
        """Types of a block's statements; the feeds that it replies to."""
        replied = set()
        for s in body:
            if isinstance(s, ast.If):
                if self._scalar(s.test, own).kind != BOOL:
                    raise self._fail(s, "a condition is a boolean")
                replied |= self._check(s.body, dict(own), scope, shared) | self._check(s.orelse, dict(own), scope, shared)
            elif isinstance(s, ast.Match):
                subject = self._scalar(s.subject, own)
                for tag, name, case in self._cases(s, subject):
                    replied |= self._check(case.body, own | ({name: Val(subject.col[tag], arms(subject.kind)[tag])} if name else {}), scope, shared)
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.BinOp) and isinstance(s.value.op, ast.LShift):
                self._typed(s, self._channel(s.value.left, scope), self._scalar(s.value.right, own).kind)
                replied.add(s.value.left.id)
            elif isinstance(s, (ast.Assign, ast.AugAssign)):
                target = s.targets[0] if isinstance(s, ast.Assign) else s.target
                if not isinstance(target, ast.Name):
                    raise self._fail(s, "a block sets one name at a time")
                made = self._scalar(s.value, own)
                if isinstance(s, ast.AugAssign):
                    made = self._binary(s, s.op, own[target.id] if target.id in own else self._name(target, scope), made)
                if target.id in shared and joined_kind(made.kind, own[target.id].kind) != own[target.id].kind:
                    raise self._fail(s, f"{target.id!r} is {own[target.id].kind.simpleString()}")
                if target.id not in shared and isinstance(scope.get(target.id), Val) and s.lineno in self.changes:
                    raise self._fail(s, f"{target.id!r} is no variable of transactions")
                own[target.id] = made if target.id not in shared else own[target.id]
            elif not isinstance(s, ast.Pass):
                raise self._fail(s, "a block has writes, conditions and replies")
        return replied

    def _related(self, name: str) -> set[str]:
        """The variables and feeds that blocks so far relate to ``name``, itself included."""
        found, before = {name}, set()
        while found != before:
            before = set(found)
            for _, touches, replied, _ in self.writers:
                if found & {*touches, *replied}:
                    found |= {*touches, *replied}
        return found

    def _committed(self, name: str) -> tuple[Transactions, DataFrame | None]:
        """The store of a variable or feed, and its log; it takes no more blocks, other stores do."""
        if name not in self.sealed:
            own = self._related(name)
            store = Transactions({k: (kind.simpleString(), seed) for k, (kind, seed) in self.shared.items() if k in own}, {k: c.kind.simpleString() for k, c in self.replies.items() if k in own})
            writers = [w for w in self.writers if own.intersection(w[1])]
            for rows, touches, _, body in writers:
                store.writer(rows, POSITION, touches, body)
            self.sealed |= dict.fromkeys(own, (store, store.committed() if writers else None))
        return self.sealed[name]

    def _replied(self, name: str, channel: Channel) -> DataFrame:
        store, log = self._committed(name)
        said = store.replies(name, log).select(F.col("value").alias(VALUE))
        return self._made(said, Val(F.col(VALUE), channel.kind), []).df

    def _final(self, e: ast.Call, scope: dict) -> Val:
        x = e.args[0]
        if not isinstance(x, ast.Name) or not isinstance(scope.get(x.id), Shared):
            raise self._fail(e, "'await_final' is of a variable of transactions")
        own = scope[x.id]
        store, log = self._committed(own.name)
        rows = store.await_final(own.name, log) if log is not None else self.shared[own.name][1]
        return Val(rows.select(own.name).scalar(), own.kind)

    # --- loops: an ordered fold of the accumulators that the body writes ---

    def _writes(self, body: list[ast.stmt]) -> list[str]:
        names = []
        for s in body:
            if isinstance(s, ast.If):
                names += self._writes(s.body) + self._writes(s.orelse)
            elif isinstance(s, ast.Match):
                names += [n for c in s.cases for n in self._writes(c.body)]
            elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                names.append(s.target.id)
            elif isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                names.append(s.targets[0].id)
            elif not isinstance(s, ast.Pass):
                raise self._fail(s, "a loop may assign accumulators, under conditions")
        return list(dict.fromkeys(names))

    def _sums(self, body: list[ast.stmt], names: list[str]) -> bool:
        """Whether all that the body does is to add terms that do not read what it writes."""
        for s in body:
            if isinstance(s, ast.If):
                read = {x.id for x in ast.walk(s.test) if isinstance(x, ast.Name)}
                if read & set(names) or not self._sums(s.body + s.orelse, names):
                    return False
            elif not isinstance(s, ast.AugAssign) or not isinstance(s.op, (ast.Add, ast.Sub)) or {x.id for x in ast.walk(s.value) if isinstance(x, ast.Name)} & set(names):
                return False
        return True

    def _loop(self, s: ast.For, scope: dict) -> None:
        coll, names = self._coll(s.iter, scope), self._writes(s.body)
        for name in names:
            if not isinstance(scope.get(name), Val):
                raise self._fail(s, f"{name!r} has no initial value")
        kinds = {n: scope[n].kind for n in names}
        if self._sums(s.body, names) and all(isinstance(k, T.IntegralType) for k in kinds.values()):
            # No order matters: one aggregate, which every task does its part of.
            zero = {n: Val(F.lit(0).cast(LONG), LONG) for n in names}
            self._body(s.body, scope | zero, state := scope | zero, s.target.id, coll.element("x"))
            ends = coll.df.alias("x").agg(*(total(state[n].col).alias(n) for n in names))
            for n in names:
                scope[n] = Val((scope[n].col + ends.select(n).scalar()).cast(kinds[n]), kinds[n])
            return
        fields = [c for c in coll.df.columns if c != POSITION]
        if POSITION not in coll.df.columns:
            raise self._fail(s, "a loop needs positions: a list, or a source with a column 'pos'")
        # What the body reads of the program stands beside the rows: a lambda has no subqueries.
        used = {x.id for b in s.body for x in ast.walk(b) if isinstance(x, ast.Name)}
        outer = {n: v for n, v in scope.items() if isinstance(v, Val) and (n in used or n in names)}

        def merge(acc: Column, row: Column) -> Column:
            own = dict(scope) | {n: Val(F.col(f"_outer_{n}"), v.kind) for n, v in outer.items()} | {n: Val(acc[n], kinds[n]) for n in names}
            item = Val(F.struct(*(row[c].alias(c) for c in fields)), T.StructType([coll.df.schema[c] for c in fields])) if coll.record else Val(row[fields[0]], coll.df.schema[fields[0]].dataType)
            self._body(s.body, own | {s.target.id: item}, state := dict(own), s.target.id, item)
            return F.struct(*(widened(state[n], kinds[n]).col.alias(n) for n in names))

        rows = F.array_sort(F.collect_list(F.struct(POSITION, *fields)))
        first = F.struct(*(F.col(f"_outer_{n}").cast(kinds[n]).alias(n) for n in names))
        beside = coll.df.agg(rows.alias("_rows")).select("_rows", *(v.col.alias(f"_outer_{n}") for n, v in outer.items()))
        end = beside.select(F.aggregate("_rows", first, merge).alias("_end"))
        for n in names:
            scope[n] = Val(end.select(F.col("_end")[n]).scalar(), kinds[n])

    def _body(self, body: list[ast.stmt], scope: dict, state: dict, name: str, item: Val) -> None:
        """Run the body's assignments on ``state``; a condition chooses between both outcomes."""
        for s in body:
            here = state | {name: item}
            if isinstance(s, ast.If):
                test, then, other = self._scalar(s.test, here), dict(state), dict(state)
                self._body(s.body, scope, then, name, item)
                self._body(s.orelse, scope, other, name, item)
                for k in self._writes([s]):
                    state[k] = self._choice(s, test.col, then[k], other[k])
            elif isinstance(s, ast.Match):
                subject, made = self._scalar(s.subject, here), []
                for tag, bound, case in self._cases(s, subject):
                    inner = dict(state) | ({bound: Val(subject.col[tag], arms(subject.kind)[tag])} if bound and bound != "_" else {})
                    self._body(case.body, scope, inner, name, item)
                    made.append((tag, inner))
                for k in self._writes([s]):
                    chosen = made[-1][1][k]
                    for tag, inner in reversed(made[:-1]):
                        chosen = self._choice(s, subject.col[TAG] == tag, inner[k], chosen)
                    state[k] = chosen
            elif isinstance(s, ast.Pass):
                continue
            elif isinstance(s, ast.AugAssign):
                state[s.target.id] = self._binary(s, s.op, here[s.target.id], self._scalar(s.value, here))
            else:
                state[s.targets[0].id] = self._scalar(s.value, here)

    # --- expressions ---

    def _scalar(self, e: ast.expr, scope: dict) -> Val:
        found = self.value(e, scope)
        if not isinstance(found, Val):
            raise self._fail(e, "a scalar is needed here")
        return found

    def _coll(self, e: ast.expr, scope: dict) -> Coll:
        found = self.value(e, scope)
        if isinstance(found, Channel):
            found = self._read(e, found)
        if not isinstance(found, Coll):
            raise self._fail(e, "a collection is needed here")
        return found

    def value(self, e: ast.expr, scope: dict):
        make = getattr(self, f"_{type(e).__name__.lower()}", None)
        if make is None:
            raise self._fail(e, f"{type(e).__name__} is not part of the language")
        return make(e, scope)

    def _constant(self, e: ast.Constant, scope: dict) -> Val:
        for kind, own in ((bool, BOOL), (int, LONG), (str, TEXT)):
            if isinstance(e.value, kind):
                return Val(F.lit(e.value).cast(own), own)
        raise self._fail(e, f"{e.value!r} is no literal of the language")

    def _name(self, e: ast.Name, scope: dict):
        if e.id.startswith(MARK):
            return self._tag(e.id[len(MARK) :], None)
        if e.id not in scope:
            raise self._fail(e, f"{e.id!r} is not defined")
        if isinstance(scope[e.id], Shared):
            raise self._fail(e, f"{e.id!r} is read in transactions, and by await_final")
        return scope[e.id]

    def _tag(self, tag: str, payload: Val | None) -> Val:
        kind = UNIT if payload is None else payload.kind
        value = F.lit(None) if payload is None else payload.col
        return Val(F.struct(F.lit(tag).alias(TAG), value.alias(tag)), T.StructType([T.StructField(TAG, TEXT), T.StructField(tag, kind)]))

    def _tuple(self, e: ast.Tuple, scope: dict) -> Val:
        own = [self._scalar(x, scope) for x in e.elts]
        return Val(F.struct(*(v.col.alias(f"_{k}") for k, v in enumerate(own))), T.StructType([T.StructField(f"_{k}", v.kind) for k, v in enumerate(own)]))

    def _attribute(self, e: ast.Attribute, scope: dict) -> Val:
        record = self._scalar(e.value, scope)
        if not isinstance(record.kind, T.StructType) or e.attr not in record.kind.fieldNames():
            raise self._fail(e, f"no field {e.attr!r}")
        return Val(record.col[e.attr], record.kind[e.attr].dataType)

    def _list(self, e: ast.List, scope: dict) -> Coll:
        items = [self._scalar(x, scope) for x in e.elts]
        kind = items[0].kind if items else LONG
        for x in items[1:]:
            kind = joined_kind(kind, x.kind)
            if kind is None:
                raise self._fail(e, "a list's elements have one type")
        rows = F.array(*(widened(x, kind).col for x in items)) if items else F.array().cast(T.ArrayType(kind))
        df = self.spark.range(1).select(rows.alias("_rows")).select(F.posexplode("_rows").alias(POSITION, VALUE))
        return Coll(df, False) if not isinstance(kind, T.StructType) else Coll(df.select(POSITION, f"{VALUE}.*"), True)

    def _unaryop(self, e: ast.UnaryOp, scope: dict) -> Val:
        x = self._scalar(e.operand, scope)
        if isinstance(e.op, ast.Not) and x.kind == BOOL:
            return Val(~x.col, BOOL)
        if isinstance(e.op, ast.USub) and isinstance(x.kind, T.IntegralType):
            return Val(-x.col, x.kind)
        raise self._fail(e, f"this operator is not for {x.kind.simpleString()}")

    def _binop(self, e: ast.BinOp, scope: dict):
        if isinstance(e.op, ast.MatMult):
            a, b = self._coll(e.left, scope), self._coll(e.right, scope)
            kind = joined_kind(a.element("x").kind, b.element("x").kind)
            if kind is None:
                raise self._fail(e, "a union's arms have one type")
            a, b = self._widen(a, kind), self._widen(b, kind)
            return Coll(a.df.drop(POSITION).unionByName(b.df.drop(POSITION)), a.record)
        return self._binary(e, e.op, self._scalar(e.left, scope), self._scalar(e.right, scope))

    def _binary(self, e: ast.AST, op: ast.operator, a: Val, b: Val) -> Val:
        if isinstance(op, ast.Add) and a.kind == b.kind == TEXT:
            return Val(F.concat(a.col, b.col), TEXT)
        numbers = {ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y, ast.FloorDiv: scalars.int_div}
        logic = {ast.BitAnd: lambda x, y: x & y, ast.BitOr: lambda x, y: x | y, ast.BitXor: scalars.xor}
        whole = isinstance(a.kind, T.IntegralType) and isinstance(b.kind, T.IntegralType)
        if type(op) in numbers and whole:
            return Val(numbers[type(op)](a.col, b.col).cast(LONG), LONG)
        if type(op) in logic and a.kind == b.kind == BOOL:
            return Val(logic[type(op)](a.col, b.col), BOOL)
        raise self._fail(e, f"this operator is not for {a.kind.simpleString()} and {b.kind.simpleString()}")

    def _boolop(self, e: ast.BoolOp, scope: dict) -> Val:
        first, *others = [self._scalar(x, scope) for x in e.values]
        out = first.col
        for x in others:
            out = scalars.both(out, x.col) if isinstance(e.op, ast.And) else scalars.either(out, x.col)
        if any(x.kind != BOOL for x in (first, *others)):
            raise self._fail(e, "'and' and 'or' are for booleans")
        return Val(out, BOOL)

    def _compare(self, e: ast.Compare, scope: dict) -> Val:
        signs = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
        left, rest = self._scalar(e.left, scope), []
        for op, x in zip(e.ops, e.comparators, strict=True):
            right = self._scalar(x, scope)
            if type(op) not in signs or (left.kind != right.kind and not (isinstance(left.kind, T.IntegralType) and isinstance(right.kind, T.IntegralType))):
                raise self._fail(e, f"{left.kind.simpleString()} and {right.kind.simpleString()} cannot be compared so")
            rest += [signs[type(op)], right.col]
            left = right
        return Val(scalars.chain(self._scalar(e.left, scope).col, *rest), BOOL)

    def _ifexp(self, e: ast.IfExp, scope: dict):
        test, a, b = self._scalar(e.test, scope), self.value(e.body, scope), self.value(e.orelse, scope)
        if test.kind != BOOL:
            raise self._fail(e, "a choice needs a boolean and two values of one type")
        return self._choice(e, test.col, *(self._read(e, x) if isinstance(x, Channel) else x for x in (a, b)))

    def _lambda(self, e: ast.Lambda, scope: dict) -> Function:
        return Function([a.arg for a in e.args.args], e.body, scope)

    def _subscript(self, e: ast.Subscript, scope: dict):
        of = self.value(e.value, scope)
        at = self._scalar(e.slice, scope)
        if isinstance(of, Groups):
            return Coll(of.rows.filter(of.key.col == at.col).drop(POSITION), of.coll.record)
        if isinstance(of, Coll) and POSITION in of.df.columns:
            own = of.element("x")
            one = of.df.alias("x").filter(F.col(f"x.{POSITION}") == at.col).agg(F.first(F.struct(own.col.alias(VALUE))).alias("_one"))
            missing = F.raise_error(F.lit(f"line {e.lineno}: no element at this position")).cast(own.kind)
            return Val(one.select(F.when(F.col("_one").isNull(), missing).otherwise(F.col("_one")[VALUE])).scalar(), own.kind)
        raise self._fail(e, "only lists and groups have elements")

    def _apply(self, e: ast.AST, f: Function, values: list):
        if len(f.names) != len(values):
            raise self._fail(e, f"{len(f.names)} arguments are needed")
        for name, kind, value in zip(f.names, f.kinds, values, strict=False):
            if kind is not None and (not isinstance(value, Val) or joined_kind(value.kind, kind) != kind):
                raise self._fail(e, f"{name!r} is {kind.simpleString()}")
        own = f.scope | dict(zip(f.names, values, strict=True))
        if f.generates:
            return self._generated(e, f, own)
        found = self._block(f.body, own) if isinstance(f.body, list) else self.value(f.body, own)
        if found is None:
            raise self._fail(e, "the function gives no value")
        return found

    def _call(self, e: ast.Call, scope: dict):
        name = e.func.id if isinstance(e.func, ast.Name) else None
        if name == "rec" and not e.args:
            own = {k.arg: self._scalar(k.value, scope) for k in e.keywords}
            return Val(F.struct(*(v.col.alias(k) for k, v in own.items())), T.StructType([T.StructField(k, v.kind) for k, v in own.items()]))
        if name == "groupby" and name not in scope and len(e.args) == 2:
            coll, f = self._coll(e.args[0], scope), self.value(e.args[1], scope)
            self._count += 1
            alias = f"g{self._count}"
            rows = coll.df.alias(alias)
            key = self._apply(e, f, [Coll(coll.df, coll.record).element(alias)])
            return Groups(coll, key, rows)
        if name == "key" and name not in scope and len(e.args) == 1:
            of = self.value(e.args[0], scope)
            if not isinstance(of, Group):
                raise self._fail(e, "'key' is of a group")
            return of.key
        if name and name.startswith(MARK):
            if len(e.args) != 1 or e.keywords:
                raise self._fail(e, "a tag holds one value")
            return self._tag(name[len(MARK) :], self._scalar(e.args[0], scope))
        if name == "await_final" and name not in scope and len(e.args) == 1:
            return self._final(e, scope)
        if name in AGGREGATES and name not in scope and len(e.args) == 1:
            return self._aggregate(e, name, e.args[0], scope)
        f = self.value(e.func, scope)
        if not isinstance(f, Function):
            raise self._fail(e, "this is no function")
        return self._apply(e, f, [self.value(x, scope) for x in e.args])

    def _aggregated(self, e: ast.AST, name: str, x: Val) -> Val:
        if name == "count":
            return Val(size(), LONG)
        if name == "sum" and isinstance(x.kind, T.IntegralType):
            return Val(total(x.col), LONG)
        if name == "max" and (isinstance(x.kind, T.IntegralType) or x.kind == TEXT):
            kind = "string" if x.kind == TEXT else "bigint"
            return Val(largest(x.col if x.kind == TEXT else x.col.cast(LONG), kind), TEXT if x.kind == TEXT else LONG)
        if name == "min" and (isinstance(x.kind, T.IntegralType) or x.kind == TEXT):
            return Val(least(x.col), x.kind)
        raise self._fail(e, f"{name!r} is not for {x.kind.simpleString()}")

    def _aggregate(self, e: ast.Call, name: str, of: ast.expr, scope: dict) -> Val:
        # Of a group, or of a comprehension over one group, inside a comprehension over groups.
        if isinstance(of, (ast.ListComp, ast.GeneratorExp)) and len(of.generators) == 1 and isinstance(of.generators[0].target, ast.Name):
            over = self.value(of.generators[0].iter, scope)
            if isinstance(over, Group):
                own = scope | {of.generators[0].target.id: over.element}
                x = self._scalar(of.elt, own)
                for guard in of.generators[0].ifs:
                    x = Val(F.when(self._scalar(guard, own).col, x.col), x.kind)
                return Val(F.count(x.col), LONG) if name == "count" else self._aggregated(e, name, x)
        found = self.value(of, scope)
        if isinstance(found, Channel):
            found = self._read(e, found)
        if isinstance(found, Group):
            return self._aggregated(e, name, found.element)
        if not isinstance(found, Coll):
            raise self._fail(e, f"{name!r} is of a collection")
        made = self._aggregated(e, name, found.element("x"))
        return Val(found.df.alias("x").agg(made.col.alias(VALUE)).scalar(), made.kind)

    def _listcomp(self, e: ast.ListComp, scope: dict) -> Coll:
        own, df, keys, grouped = dict(scope), None, [], False
        for g in e.generators:
            over = self.value(g.iter, own)
            if isinstance(over, Channel):
                over = self._read(e, over)
            if isinstance(over, Groups) and not isinstance(g.target, ast.Name):
                raise self._fail(e, "groups are named by one variable")
            self._count += 1
            alias = f"c{self._count}"
            if isinstance(over, Groups):
                if df is not None or len(e.generators) > 1:
                    raise self._fail(e, "groups are iterated on their own")
                df, grouped, keys = over.rows, True, [over.key.col.alias("_key")]
                own[g.target.id] = Group(self._apply_group(over), Val(F.col("_key"), over.key.kind))
            elif isinstance(over, Coll):
                rows = over.df.drop(POSITION) if len(e.generators) > 1 else over.df
                df = rows.alias(alias) if df is None else df.crossJoin(rows.alias(alias))
                self._destructure(e, g.target, Coll(over.df, over.record).element(alias), own)
            else:
                raise self._fail(e, "a generator iterates a collection")
            if not grouped:
                for guard in g.ifs:
                    df = df.filter(self._scalar(guard, own).col)
        element = self._scalar(e.elt, own)
        if grouped:
            out = df.groupBy(*keys).agg(element.col.alias(VALUE))
            if e.generators[0].ifs:
                kept = [self._scalar(guard, own).col.alias(f"_kept{k}") for k, guard in enumerate(e.generators[0].ifs)]
                out = df.groupBy(*keys).agg(element.col.alias(VALUE), *kept).filter(" AND ".join(f"_kept{k}" for k in range(len(kept))))
                out = out.select("_key", VALUE)
            return self._made(out.drop("_key"), element, [])
        keep = [POSITION] if POSITION in df.columns and len(e.generators) == 1 else []
        return self._made(df.select(*keep, element.col.alias(VALUE)), element, keep)

    _generatorexp = _listcomp

    def _apply_group(self, groups: Groups) -> Val:
        names = [c for c in groups.coll.df.columns if c != POSITION]
        if not groups.coll.record:
            return Val(F.col(f"`{names[0]}`"), groups.coll.df.schema[names[0]].dataType)
        return Val(F.struct(*(F.col(f"`{c}`").alias(c) for c in names)), T.StructType([groups.coll.df.schema[c] for c in names]))

    def _made(self, df: DataFrame, element: Val, keep: list[str]) -> Coll:
        if isinstance(element.kind, T.StructType):
            return Coll(df.select(*keep, f"{VALUE}.*"), True)
        return Coll(df, False)
