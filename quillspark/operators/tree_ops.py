"""The commands on a tree of elements, in namespace lui. The tree is a relation (handle, parent, pos, label)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.values import to_text
from ..plans.registry import BUILTIN, Param
from .frame import OrderedFrame, from_scan

NS = "lui"
SCHEMA = "handle long, parent long, pos int, label string"


@dataclass(frozen=True)
class Tree:
    """Elements in order below their parents; roots have none. current is the active element."""

    df: DataFrame
    current: int | None = None

    @staticmethod
    def empty(spark: SparkSession) -> Tree:
        return Tree(spark.createDataFrame([], SCHEMA))

    def children(self, handle: int | None) -> DataFrame:
        return self.df.filter(F.col("parent").eqNullSafe(F.lit(handle))).orderBy("pos", "handle")

    def roots(self) -> DataFrame:
        return self.children(None)

    def siblings(self) -> DataFrame:
        """Each element with the ones before and after it under the same parent."""
        order = Window.partitionBy("parent").orderBy("pos", "handle")
        return self.df.select("*", F.lag("handle").over(order).alias("prev"), F.lead("handle").over(order).alias("next"))

    def ends(self) -> DataFrame:
        """The first and last child of each parent."""
        at = F.struct("pos", "handle")
        return self.df.groupBy("parent").agg(F.min_by("handle", at).alias("first"), F.max_by("handle", at).alias("last"))

    def below(self, handle: int) -> set[int]:
        """A subtree's handles, level by level; trees of elements are small."""
        out, level = {handle}, {handle}
        while level:
            level = {r.handle for r in self.df.filter(F.col("parent").isin(*level)).select("handle").collect()} - out
            out |= level
        return out

    def remove(self, handle: int) -> Tree:
        gone = self.below(handle)
        return Tree(self.df.filter(~F.col("handle").isin(*gone)), None if self.current in gone else self.current)

    def _one(self, df: DataFrame, column: str = "handle") -> int:
        row = df.select(column).first()
        if row is None or row[0] is None:
            raise EngineError("not-found", "there is no such element")
        return row[0]

    def find(self, word: str) -> int:
        """current, parent, next, prev, first, last, root, or a handle's number."""
        if word.isdigit():
            return self._one(self.df.filter(F.col("handle") == int(word)))
        if word == "root":
            return self._one(self.roots())
        if self.current is None:
            raise EngineError("not-found", "there is no current element")
        own = F.col("handle") == self.current
        match word:
            case "current":
                return self.current
            case "parent":
                return self._one(self.df.filter(own), "parent")
            case "next" | "prev":
                return self._one(self.siblings().filter(own), word)
            case "first" | "last":
                return self._one(self.ends().filter(F.col("parent") == self.current), word)
        raise EngineError("argument", f"{word!r} isn't a way to an element")

    def add(self, position: str, reference: str, label: str) -> tuple[Tree, int]:
        """An element before, after or instead of another one, or as its first or last child (child: last)."""
        handle = (self.df.agg(F.max("handle")).first()[0] or 0) + 1
        if reference == "current" and self.current is None:
            if position not in ("child", "first", "last"):
                raise EngineError("argument", f"nothing can be {position} an element that isn't there")
            parent, at = None, self.roots().count()
            others = self.df
        else:
            target = self.find(reference)
            row = self.df.filter(F.col("handle") == target).first()
            if position in ("child", "last", "first"):
                parent, at = target, 0 if position == "first" else self.children(target).count()
                others = self.df
            elif position in ("before", "after", "instead"):
                parent, at = row.parent, row.pos + (position == "after")
                others = self.remove(target).df if position == "instead" else self.df
            else:
                raise EngineError("argument", f"{position!r} isn't a position")
        if position != "instead":
            shift = F.col("parent").eqNullSafe(F.lit(parent)) & (F.col("pos") >= at)
            others = others.withColumn("pos", F.when(shift, F.col("pos") + 1).otherwise(F.col("pos")).cast("int"))
        new = self.df.sparkSession.createDataFrame([(handle, parent, at, label)], SCHEMA)
        return Tree(others.unionByName(new), self.current if self.current is not None else handle), handle


class Desk:
    """A payload that holds a tree."""

    def __init__(self, tree: Tree):
        self.tree = tree


def lui(name: str, *params: Param):
    def register(f):
        def run(context, state, *arguments):
            if not isinstance(context.payload, Desk):
                raise EngineError("argument", f"{name} needs a payload with a tree of elements")
            return f(context, state, context.payload, *arguments)

        run.__doc__, run.__name__, run.__wrapped__ = f.__doc__, f.__name__, f
        BUILTIN.command(name, *params, ns=NS, volatile=True, payload=True)(run)
        return f

    return register


def _handles(df: DataFrame) -> OrderedFrame:
    frame = from_scan(df.select("handle", "pos", "label"))
    return frame.sort(F.col("pos"), True).select("handle", "label")


@lui("add", Param("position"), Param("reference", default="current"))
def add(context, state, desk: Desk, position: str, reference: str):
    """Puts the input into the tree; the result is its handle."""
    value = state.value
    label = value.get("text", value.get("element", "")) if isinstance(value, dict) else to_text(value) if isinstance(value, str | int | float) and not isinstance(value, bool) else type(value).__name__
    desk.tree, handle = desk.tree.add(position, reference, label)
    return str(handle)


@lui("remove", Param("target"))
def remove(context, state, desk: Desk, target: str):
    """Takes an element, and all below it, out of the tree."""
    desk.tree = desk.tree.remove(desk.tree.find(target))


@lui("children", Param("target"))
def children(context, state, desk: Desk, target: str):
    """An element's children, in order."""
    return _handles(desk.tree.children(desk.tree.find(target)))


@lui("roots")
def roots(context, state, desk: Desk):
    """The elements without a parent, in order."""
    return _handles(desk.tree.roots())


def _step(word: str) -> None:
    def run(context, state, desk: Desk, target: str):
        return str(replace(desk.tree, current=desk.tree.find(target)).find(word))

    run.__doc__ = f"The handle of an element's {word}."
    lui(word, Param("target"))(run)


for _word in ("first", "last", "parent", "next", "prev"):
    _step(_word)


@lui("activate", Param("target"))
def activate(context, state, desk: Desk, target: str):
    """Makes an element the current one."""
    desk.tree = replace(desk.tree, current=desk.tree.find(target))
    return str(desk.tree.current)


@lui("submit")
def submit(context, state, desk: Desk):
    """The result of the query that the input is."""
    return context.engine.evaluate_immediately(to_text(state.get()), desk)


def _viewer(name: str, doc: str, make) -> None:
    def run(context, state):
        return make(state)

    run.__doc__ = doc
    BUILTIN.command(name, ns=NS)(run)


def _spec(state):
    import yaml

    found = yaml.safe_load(to_text(state.get()))
    if not isinstance(found, dict):
        raise EngineError("conversion", "an element's description is a mapping")
    return {"element": "spec", **found}


_viewer("ui_spec", "The element that a YAML text describes.", _spec)
_viewer("markdown", "An element that shows Markdown.", lambda state: {"element": "markdown", "text": to_text(state.get())})
_viewer("query_console", "An element to type queries into, with the input as the first.", lambda state: {"element": "query_console", "query": to_text(state.value) if state.value is not None else ""})
