"""Generic commands, and those that describe commands."""

from __future__ import annotations

import json

from ..errors import EngineError
from ..functions import values
from ..plans.registry import BUILTIN, Param


@BUILTIN.command("to_text")
def to_text(context, state):
    """The value as text, or that of a frame of one row and column; containers and booleans have none."""
    return values.to_text(context.engine.scalar(state.get()))


@BUILTIN.command("to_metadata")
def to_metadata(context, state):
    """The input's metadata."""
    return state.metadata.to_dict()


@BUILTIN.command("to_assetinfo")
def to_assetinfo(context, state):
    """What a listing would show of the input."""
    return [state.metadata.info()]


@BUILTIN.command("show_asset_info")
def show_asset_info(context, state):
    """The same, as text for people."""
    return "\n".join(f"{k}: {v}" for k, v in state.metadata.info().items() if v not in (None, ""))


@BUILTIN.command("from_yaml")
def from_yaml(context, state):
    """A YAML text as a value."""
    import yaml

    try:
        return yaml.safe_load(values.to_text(state.get()))
    except yaml.YAMLError as e:
        raise EngineError("conversion", f"not YAML: {e}") from None


@BUILTIN.command("label", Param("txt"))
def label(context, state, txt: str):
    """An element that shows a text."""
    return {"element": "label", "text": txt}


@BUILTIN.command("text_editor")
def text_editor(context, state):
    """An element that edits the text under a key."""
    return {"element": "text_editor", "key": values.to_key(state.get()).encode()}


@BUILTIN.command("commands_doc", Param("namespace", default=""), Param("command_name", default=""))
def commands_doc(context, state, namespace: str, name: str):
    """All commands, those of a namespace, or one, as Markdown."""
    found = [c for c in sorted(context.engine.registry.commands.values(), key=lambda c: c.id) if (not namespace or c.ns == ("" if namespace == "root" else namespace)) and (not name or c.name == name)]
    if not found:
        raise EngineError("unknown-command", f"there is no command {name or namespace}")
    out, ns = ["# Commands"], None
    for c in found:
        if c.ns != ns:
            ns = c.ns
            out.append(f"\n## Namespace {ns or 'root'}")
        r = c.record()
        out.append(f"\n### {c.name}\n\n{r['doc']}\n")
        out += [f"- `{a['name']}` ({a['type']}{', repeated' if a['multiple'] else ''})" + (f", default `{a['default']}`" if a["default"] is not None else "") for a in r["arguments"]]
    return "\n".join(out) + "\n"


def _described(context, realm: str, namespace: str, name: str) -> str:
    command = context.engine.registry.commands.get((realm, "" if namespace == "root" else namespace, name))
    if command is None:
        raise EngineError("unknown-command", f"there is no command {name} in {namespace or 'the root namespace'}")
    return json.dumps(command.record() | {"version": command.version()}, sort_keys=True, default=str)


for _name in ("command_metadata", "command_implementation"):

    @BUILTIN.command(_name, Param("realm", default=""), Param("namespace", default=""), Param("name"), ns="dep")
    def _describe(context, state, realm: str, namespace: str, name: str):
        """A command's description as JSON, to depend on."""
        return _described(context, realm, namespace, name)
