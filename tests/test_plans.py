from datetime import UTC, datetime

import pytest

from quillspark.engine import BUILTIN
from quillspark.errors import EngineError
from quillspark.lang.parser import parse, parse_key
from quillspark.plans.dependencies import Dependencies
from quillspark.plans.expires import IMMEDIATELY, NEVER, combined, parse_expires
from quillspark.plans.planner import Link, Placeholder, Planner, validate
from quillspark.plans.recipes import Recipe, read_recipes
from quillspark.plans.registry import Param


@pytest.fixture
def registry():
    r = BUILTIN.copy()
    add = lambda name, *p, **k: r.command(name, *p, **k)(lambda *a: a)
    add("greet", Param("who", default="world"))
    add("num", Param("n", "int", 3), Param("x", "float?"), Param("b", "bool", False))
    add("pick", Param("c", "enum", "a", {"a": "A", "l": parse("greet")}))
    add("small", Param("n", "int", low=0, high=255))
    add("all", Param("first"), Param("rest", multiple=True))
    add("soon", expires="in 5 min")
    add("now", volatile=True)
    add("need", Param("must", placeholder=True))
    add("own", ns="my")
    r.alias("hi", "greet", ("there",))
    r.alias("loop", "loop")
    return r


def plan(registry, q, **k):
    return Planner(registry).plan(q, **k)


def last(p):
    return p.steps[-1].arguments


def test_arguments(registry):
    assert last(plan(registry, "greet")) == ("world",) and last(plan(registry, "greet-")) == ("",) and last(plan(registry, "greet-x")) == ("x",)
    assert last(plan(registry, "num")) == (3, None, False) and last(plan(registry, "num-~5-2.5-Yes")) == (-5, 2.5, True)
    assert last(plan(registry, "num--")) == (3, None, False)
    assert last(plan(registry, "all-a-b-c")) == ("a", ["b", "c"]) and last(plan(registry, "all-a")) == ("a", [])
    assert last(plan(registry, "pick-a")) == ("A",) and last(plan(registry, "pick-l")) == (Link(parse("greet")),)
    assert last(plan(registry, "greet-~X~num~E")) == (Link(parse("num")),)
    assert last(plan(registry, "hi")) == ("there",)
    assert last(plan(registry, "need")) == (Placeholder("must"),)
    for wrong in ("num-x", "small-256", "small-~1", "pick-z", "all", "q-1", "nothing", "loop", "own", "-R-what/a"):
        with pytest.raises(EngineError):
            plan(registry, wrong)
    p = plan(registry, "greet-a-b")
    assert last(p) == ("a",) and len(p.warnings) == 1
    assert plan(registry, "ns-my/own").steps[0].command.ns == "my"


def test_plan_properties(registry):
    assert not plan(registry, "greet").volatile and plan(registry, "greet/v").volatile and plan(registry, "now/greet").volatile
    assert plan(registry, "greet-~X~now~E").volatile
    assert str(plan(registry, "soon/greet").expires) == "in 5 min"
    p = plan(registry, "-R/a/b.csv/-/greet/q")
    assert [s.kind for s in p.steps] == ["value"] and p.steps[0].value.encode() == "-R/a/b.csv/-/greet"
    p = plan(registry, "-R/a/b.csv/-/greet/num/out.txt")
    assert [s.kind for s in p.steps] == ["asset", "action", "action", "filename"] and p.filename == "out.txt" and "-R/a/b.csv" in p.dependencies
    before, action = p.split()
    assert len(before) == 2 and action.command.name == "num"
    assert plan(registry, "-R/./x/-/greet", cwd=parse_key("d")).steps[0].key.encode() == "d/x"
    assert last(plan(registry, "greet-a", arguments={"who": "b"})) == ("b",) and last(plan(registry, "greet-a", links={"who": parse("num")})) == (Link(parse("num")),)
    with pytest.raises(EngineError):
        plan(registry, "greet", arguments={"nobody": 1})
    assert plan(registry, "-Rname-meta-x/a").warnings and plan(registry, "-R-dir/a").steps[0].kind == "asset_directory"
    assert validate("greet-a-b", registry)["warnings"] and validate("a b", registry)["stage"] == "parse" and not validate("zzz", registry)["valid"]


AT = datetime(2024, 1, 31, 13, 30, tzinfo=UTC)  # a Wednesday


@pytest.mark.parametrize(("text", "when"), [
    ("never", None), ("immediately", "2024-01-31T13:30:00"), ("5 min", "2024-01-31T13:35:00"), ("in 2 hours", "2024-01-31T15:30:00"), ("500ms", "2024-01-31T13:30:00.500000"), ("1 month", "2024-03-01T13:30:00"),
    ("at 14:00", "2024-01-31T14:00:00"), ("at 13:30", "2024-02-01T13:30:00"), ("at 13:00 EST", "2024-01-31T18:00:00"), ("on Wednesday", "2024-02-07T00:00:00"), ("on thu", "2024-02-01T00:00:00"),
    ("EOD", "2024-02-01T00:00:00"), ("end of week", "2024-02-05T00:00:00"), ("EOM", "2024-02-01T00:00:00"), ("2026-03-01", "2026-03-01T00:00:00"), ("2026-03-01 15:00", "2026-03-01T15:00:00"), ("1 day, EOW, never", "2024-02-01T13:30:00"),
])
def test_expiration(text, when):
    e = parse_expires(text)
    then = e.at(AT)
    assert (then and then.replace(tzinfo=None).isoformat()) == when
    assert parse_expires(str(e)) == e


def test_expiration_algebra():
    assert combined([NEVER, NEVER]) == NEVER and combined([parse_expires("1 h"), IMMEDIATELY]) == IMMEDIATELY
    assert str(parse_expires("1 h") | parse_expires("5 min")) == "in 5 min" and parse_expires("EOD,immediately").is_volatile
    for wrong in ("", "soon", "on Caturday", "at 25:00", "1 h,", "5 parsecs"):
        with pytest.raises(EngineError):
            parse_expires(wrong)


def test_dependencies():
    d = Dependencies()
    d.versions |= {"a": "1", "b": "1", "c": "1"}
    d.add("b", "a")
    d.add("c", "b")
    with pytest.raises(EngineError) as e:
        d.add("a", "c")
    assert e.value.type == "cycle" and d.is_current("c")
    assert d.set_version("a", "1") == set() and d.records("b") == [("a", "1")]
    assert d.set_version("a", "2") == {"b", "c"} and d.records("b") == []
    d.load("b", [("a", "1")])
    assert not d.is_current("b")


def test_recipes():
    r = read_recipes("recipes:\n- {query: a/b/x.csv, title: X, arguments: {n: 1}, links: {m: q}, volatile: true, expires: 1 h}\n- c/y.txt\n- a/b\n", parse_key("d"))
    assert set(r) == {"x.csv", "y.txt"} and r["x.csv"].volatile and r["x.csv"].links["m"] == parse("q") and str(r["x.csv"].expires) == "in 1 hours"
    assert Recipe.from_dict(r["x.csv"].to_dict()).query == r["x.csv"].query
    with pytest.raises(EngineError):
        Recipe.from_dict({"title": "x"})
