"""XPath rules over the element table, as marks on its rows.

An element's number is its place in document order and its end the last number inside it, so every axis is a
condition on numbers, ends and parents.  A step marks rows: whether an element has a marked ancestor is a running
maximum of marked ends, whether a marked element lies inside it a running minimum of marked numbers, siblings are windows
over a parent's children.  So a step takes time in proportion to the elements, however many are marked, and only
the child and parent axes and some positions are joins, on equal keys.

Supported: absolute and relative paths, ``/``, ``//``, ``.``, ``..``, the axes child, descendant, descendant-or-self, parent,
ancestor, ancestor-or-self, following-sibling, preceding-sibling, following, preceding and self; names and ``*``; final ``@name``
and ``text()``; unions; predicates with positions, ``last()``, attributes, ``text()``, ``.``, child names, ``contains``,
``starts-with``, ``normalize-space``, ``string-length``, ``not``, ``and``, ``or``, ``=``, ``!=`` and numeric comparisons.  ``text()`` is the
text before an element's first child.  Anything else raises ``ValueError``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_TOKEN = re.compile(r"\s*(?:(?P<text>\"[^\"]*\"|'[^']*')|(?P<number>\d+(?:\.\d+)?)|(?P<mark>//|::|\.\.|!=|<=|>=|[/@.()\[\],=<>|*])|(?P<name>[\w-]+(?::(?!:)[\w-]+)?))")
_AXES = ("child", "descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "following", "preceding", "self")


@dataclass
class Place:
    """A predicate that counts: a position, or the last of its kind."""

    number: int | None  # none: the last


@dataclass
class Step:
    axis: str
    name: str  # * for any
    predicates: list[Column | Place] = field(default_factory=list)


@dataclass
class Path:
    steps: list[Step]
    value: str = ""  # @name or text(), empty for the element


class _Reader:
    """Reads one expression into paths of steps."""

    def __init__(self, text: str):
        self.text, self.at, self.tokens = text, 0, []
        place = 0
        while place < len(text.rstrip()):
            m = _TOKEN.match(text, place)
            if not m:
                raise ValueError(f"unsupported XPath: {text}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            place = m.end()

    def fail(self):
        raise ValueError(f"unsupported XPath: {self.text}")

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if (wanted and got not in wanted) or not got:
            self.fail()
        self.at += 1
        return got

    def name(self) -> str:
        if self.at >= len(self.tokens) or not (self.tokens[self.at][0] == "name" or self.peek() == "*"):
            self.fail()
        return self.take()

    def union(self) -> list[Path]:
        paths = [self.path()]
        while self.peek() == "|":
            self.take()
            paths.append(self.path())
        if self.at < len(self.tokens):
            self.fail()
        return paths

    def path(self) -> Path:
        steps: list[Step] = []
        deep = False
        if self.peek() in ("/", "//"):
            deep = self.take() == "//"
        while True:
            if self.peek() == "@":
                self.take()
                return Path(self._inside(steps, deep), "@" + self.name())
            if self.peek() == "text" and self.peek(1) == "(":
                self.take(), self.take("("), self.take(")")
                return Path(self._inside(steps, deep), "text()")
            step = self.step()
            if deep and step.axis == "child":
                # a name anywhere below; positions still count among the children of one parent
                steps.append(Step("descendant-or-self", "*"))
                if not steps[:-1]:
                    steps.pop()
                    step.axis = "anywhere"
            elif deep:
                steps.append(Step("descendant-or-self", "*"))
            steps.append(step)
            if self.peek() not in ("/", "//"):
                return Path(steps)
            deep = self.take() == "//"

    @staticmethod
    def _inside(steps: list[Step], deep: bool) -> list[Step]:
        return [*steps, Step("descendant-or-self", "*")] if deep else steps

    def step(self) -> Step:
        if self.peek() == ".":
            self.take()
            return Step("self", "*")
        if self.peek() == "..":
            self.take()
            return Step("parent", "*")
        axis = "child"
        if self.peek(1) == "::":
            axis = self.take()
            self.take("::")
            if axis not in _AXES:
                self.fail()
        name = self.name()
        if self.peek() == "(":
            if name != "node":
                self.fail()
            self.take("("), self.take(")")
            name = "*"
        step = Step(axis, name.lower())
        while self.peek() == "[":
            self.take()
            step.predicates.append(self.predicate())
            self.take("]")
        return step

    def predicate(self) -> Column | Place:
        if self.peek(1) == "]" and self.tokens[self.at][0] == "number":
            return Place(int(self.take()))
        if self.peek() == "last" and self.peek(3) == "]":
            self.take(), self.take("("), self.take(")")
            return Place(None)
        if self.peek() == "position" and self.peek(3) == "=" and self.peek(5) == "]":
            self.take(), self.take("("), self.take(")"), self.take("=")
            return Place(int(self.take()))
        return self.either()

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "or":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.test()
        while self.peek() == "and":
            self.take()
            out = out & self.test()
        return out

    def test(self) -> Column:
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        if self.peek() == "not" and self.peek(1) == "(":
            self.take(), self.take("(")
            out = ~self.either()
            self.take(")")
            return out
        if self.peek() in ("contains", "starts-with") and self.peek(1) == "(":
            kind = self.take()
            self.take("(")
            a = self.value()
            self.take(",")
            b = self.value()
            self.take(")")
            return F.contains(a, b) if kind == "contains" else F.startswith(a, b)
        if self.tokens[self.at][0] == "name" and self.peek(1) != "(":  # a child of that name
            return F.array_contains("children", self.take().lower())
        there = F.col("attrs").getItem(self.peek(1)).isNotNull() if self.peek() == "@" else None
        left = self.value()
        if self.peek() not in ("=", "!=", "<", "<=", ">", ">="):
            return there if there is not None else left != ""
        how = self.take()
        number = self.tokens[self.at][0] == "number"
        right = self.value()
        if number:
            left, right = left.try_cast("double"), right.cast("double")
        out = {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[how]
        out = F.coalesce(out, F.lit(False))
        return out & there if there is not None else out

    def value(self) -> Column:
        """A string: a literal, an attribute, a text, or a function of one."""
        if self.at >= len(self.tokens):
            self.fail()
        kind, token = self.tokens[self.at]
        if kind == "text":
            self.take()
            return F.lit(token[1:-1])
        if kind == "number":
            self.take()
            return F.lit(token)
        if token == "@":
            self.take()
            return F.coalesce(F.col("attrs").getItem(self.name()), F.lit(""))
        if token == ".":
            self.take()
            return F.col("full_text")
        if token in ("text", "normalize-space", "string-length") and self.peek(1) == "(":
            self.take(), self.take("(")
            inner = F.col("text" if token == "text" else "full_text") if self.peek() == ")" else self.value()
            self.take(")")
            if token == "normalize-space":
                return F.trim(F.regexp_replace(inner, r"\s+", " "))
            return F.length(inner).cast("string") if token == "string-length" else inner
        self.fail()


def _page(start: int | None = None, end: int | None = None):
    """Rows of a page, all or, in document order, those before (end -1) or after (start 1) a row."""
    if start is None and end is None:
        return W.partitionBy("page_id")
    return W.partitionBy("page_id").orderBy("elem_id").rowsBetween(W.unboundedPreceding if start is None else start, W.unboundedFollowing if end is None else end)


def _kin(start: int | None = None, end: int | None = None):
    """The same for the children of one parent; an end of 0 includes the row itself."""
    if start is None and end is None:
        return W.partitionBy("page_id", "parent_id")
    return W.partitionBy("page_id", "parent_id").orderBy("elem_id").rowsBetween(W.unboundedPreceding if start is None else start, W.unboundedFollowing if end is None else end)


def _reached(rows: DataFrame, axis: str, first: bool) -> DataFrame:
    """Rows with ``reach``, whether the axis leads there from a marked row; the first step starts above the root."""
    mark = F.col("mark")
    ends, numbers = F.when(mark, F.col("end_id")), F.when(mark, F.col("elem_id"))
    if first:
        return rows.withColumn("reach", (F.col("parent_id") == -1) if axis == "child" else F.lit(axis in ("anywhere", "descendant", "descendant-or-self")))
    no = F.lit(False)
    if axis == "child":
        up = rows.where(mark).select("page_id", F.col("elem_id").alias("parent_id"), F.lit(True).alias("reach"))
        return rows.join(up, ["page_id", "parent_id"], "left").withColumn("reach", F.coalesce("reach", no))
    if axis == "parent":
        down = rows.where(mark).select("page_id", F.col("parent_id").alias("elem_id")).distinct().withColumn("reach", F.lit(True))
        return rows.join(down, ["page_id", "elem_id"], "left").withColumn("reach", F.coalesce("reach", no))
    tests = {
        "self": mark,
        "descendant": F.max(ends).over(_page(end=-1)) >= F.col("elem_id"),
        "ancestor": F.min(numbers).over(_page(start=1)) <= F.col("end_id"),
        "following-sibling": F.max(mark).over(_kin(end=-1)),
        "preceding-sibling": F.max(mark).over(_kin(start=1)),
        "following": F.min(ends).over(_page()) < F.col("elem_id"),
        "preceding": F.max(numbers).over(_page()) > F.col("end_id"),
    }
    test = F.coalesce(tests[axis.removesuffix("-or-self")], no)
    return rows.withColumn("reach", test | mark if axis.endswith("-or-self") else test)


def _at(rows: DataFrame, axis: str, place: Place) -> DataFrame:
    """Rows whose ``fits`` holds at a place of the axis as seen from a marked row."""
    fits, number = F.col("fits"), place.number
    if axis in ("child", "anywhere"):
        nth = F.sum(fits.cast("int")).over(_kin(end=0))
        want = F.sum(fits.cast("int")).over(_kin()) if number is None else F.lit(number)
        return rows.withColumn("now", fits & (nth == want)).withColumn("fits", F.col("now")).drop("now")
    if axis in ("self", "parent"):
        return rows.withColumn("fits", fits & F.lit(number in (None, 1)))
    if number is None:
        raise ValueError(f"last() on the axis {axis}")
    if axis in ("following-sibling", "preceding-sibling"):
        nth = rows.withColumn("nth", F.sum(F.col("test").cast("int")).over(_kin(end=0)))
        ahead = axis == "following-sibling"
        seen = F.col("nth") + number if ahead else F.col("nth") - F.col("test").cast("int") - number + 1
        places = nth.where("mark").select("page_id", "parent_id", seen.alias("nth")).distinct().withColumn("hit", F.lit(True))
        return nth.join(places, ["page_id", "parent_id", "nth"], "left").withColumn("fits", fits & F.coalesce("hit", F.lit(False))).drop("hit", "nth")
    if axis in ("ancestor", "ancestor-or-self"):
        line = F.concat(F.array("elem_id"), "ancestors") if axis.endswith("self") else F.col("ancestors")
        pairs = rows.where("mark").select("page_id", F.col("elem_id").alias("from"), F.posexplode(line).alias("far", "elem_id"))
        near = pairs.join(rows.where("test").select("page_id", "elem_id"), ["page_id", "elem_id"])
        nth = near.withColumn("nth", F.row_number().over(W.partitionBy("page_id", "from").orderBy("far"))).where(F.col("nth") == number)
        return rows.join(nth.select("page_id", "elem_id").distinct().withColumn("hit", F.lit(True)), ["page_id", "elem_id"], "left").withColumn("fits", fits & F.coalesce("hit", F.lit(False))).drop("hit")
    raise ValueError(f"a position on the axis {axis}")


def _marked(rows: DataFrame, steps: list[Step]) -> DataFrame:
    for i, step in enumerate(steps):
        rows = _reached(rows, step.axis, i == 0)
        rows = rows.withColumn("test", F.lit(True) if step.name == "*" else F.col("tag") == step.name)
        rows = rows.withColumn("fits", F.col("reach") & F.col("test"))
        for k, p in enumerate(step.predicates):
            if isinstance(p, Place):
                if any(isinstance(q, Place) for q in step.predicates[:k]) and step.axis not in ("child", "anywhere", "self", "parent"):
                    raise ValueError("two positions on one axis")
                rows = _at(rows, step.axis, p)
            else:
                rows = rows.withColumn("test", F.col("test") & p).withColumn("fits", F.col("fits") & p)
        rows = rows.withColumn("mark", F.col("fits")).drop("reach", "test", "fits")
    return rows


def select(elements: DataFrame, expression: str) -> DataFrame:
    """``page_id``, ``elem_id`` and ``value`` of what an expression finds, in any order: an element's whole text, an attribute or a text."""
    out = None
    cols = ["page_id", "elem_id", "end_id", "parent_id", "tag", "attrs", "text", "full_text", "children", "ancestors"]
    for path in _Reader(expression).union():
        rows = _marked(elements.select(*cols).withColumn("mark", F.lit(False)), path.steps).where("mark")
        if path.value == "text()":
            found = rows.where("text <> ''").select("page_id", "elem_id", F.col("text").alias("value"))
        elif path.value:
            found = rows.select("page_id", "elem_id", F.col("attrs").getItem(path.value[1:]).alias("value")).where("value IS NOT NULL")
        else:
            found = rows.select("page_id", "elem_id", F.col("full_text").alias("value"), "attrs")
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out.dropDuplicates(["page_id", "elem_id", "value"]) if "|" in expression else out

