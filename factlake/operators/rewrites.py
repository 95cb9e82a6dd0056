"""Rewrites of source text as edits; nothing is written back.

A rewrite is a function of one parsed file and its arguments, found by name in a registry, and
returns replacements of spans. ``edits`` runs it over a table of documents and ``apply_edits``
splices the result. A rewrite that doesn't fit the code at the given place raises
:class:`CannotRewrite`, which becomes the row's error.
"""

from __future__ import annotations

import functools
import json
import operator
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from inspect import Parameter, signature
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.names import IDENTIFIER, KEYWORDS
from factlake.operators import text
from factlake.plans.flow import EXIT, LOOPS, STATEMENTS, Flow, member_flow
from factlake.plans.flow import members as flow_members
from factlake.sources.csharp import Node, parse

EDIT_SCHEMA = "doc_id string, start int, length int, new_text string, error string"


class CannotRewrite(ValueError):
    """The code at the place isn't of the form that the rewrite takes."""


@dataclass(frozen=True)
class Edit:
    start: int
    length: int
    new_text: str


@dataclass(frozen=True)
class Rewrite:
    name: str
    category: str
    applies_to: tuple[str, ...]
    run: Callable


CATALOG: dict[str, Rewrite] = {}
#: Declarations that hold statements.
MEMBERS = ("MethodDeclaration", "ConstructorDeclaration", "DestructorDeclaration", "OperatorDeclaration", "PropertyDeclaration", "IndexerDeclaration")


def rewrite(category: str, *applies_to: str):
    def add(f: Callable):
        CATALOG[f.__name__] = Rewrite(f.__name__, category, applies_to, f)
        return f

    return add


class File:
    """A parsed source with the lookups that rewrites need."""

    def __init__(self, source: str):
        self.source = source
        self.nodes = parse(source)
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]

    def offset(self, line: int, column: int) -> int:
        if not 0 <= line < len(self.lines):
            raise CannotRewrite("no such line")
        return self.lines[line] + column

    def text(self, n: Node) -> str:
        return self.source[n.start : n.end]

    def innermost(self, offset: int, *kinds: str) -> Node:
        found = [n for n in self.nodes if n.kind in kinds and n.start <= offset <= n.end]
        if not found:
            raise CannotRewrite(f"no {' or '.join(kinds)} here")
        return max(found, key=lambda n: (n.start, n.depth))

    def inside(self, n: Node, *kinds: str) -> list[Node]:
        return [m for m in self.nodes if m is not n and n.start <= m.start and m.end <= n.end and m.kind in kinds]

    def around(self, n: Node, *kinds: str) -> Node:
        """The nearest node of some kinds that a node lies in, or the root."""
        while n.parent > 0 and self.nodes[n.parent].kind not in kinds:
            n = self.nodes[n.parent]
        return self.nodes[max(n.parent, 0)]

    def flow(self, owner: Node) -> Flow:
        """Control and data flow of a member."""
        return member_flow([n for n in self.nodes if n is owner or n.depth > owner.depth and owner.start <= n.start and n.end <= owner.end], owner)

    def indent(self, offset: int) -> str:
        line = self.source.rfind("\n", 0, offset) + 1
        return re.match(r"[ \t]*", self.source[line:])[0]

    def uses(self, name: str, within: Node | None = None) -> list[Node]:
        return [n for n in (self.inside(within, "IdentifierName") if within else self.nodes) if n.kind == "IdentifierName" and n.ident == name]

    def declared_at(self, n: Node) -> int:
        """Where the name stands in its declaration."""
        if n.name_start is None:
            raise CannotRewrite("the declaration has no name")
        return n.name_start


def _new_name(name: str) -> str:
    if not re.match(IDENTIFIER, name or "") or name in KEYWORDS:
        raise CannotRewrite(f"{name!r} is no identifier")
    return name


_DECLARED = (
    "ClassDeclaration", "StructDeclaration", "InterfaceDeclaration", "RecordDeclaration", "EnumDeclaration", "MethodDeclaration",
    "PropertyDeclaration", "FieldDeclaration", "FieldDeclarator", "EventDeclaration", "Parameter", "LocalDeclarationStatement",
    "LocalDeclarator", "EnumMemberDeclaration",
)


@rewrite("Rename", "IdentifierName", *_DECLARED)
def rename_symbol(f: File, offset: int, new_name: str, in_comments: bool = False, in_strings: bool = False) -> list[Edit]:
    """Rename uses and declarations of the name at a place in one file, in comments and strings as plain text.

    By name alone; :func:`factlake.tools.rename` follows the bound symbol through all files.
    """
    at = next((n for n in f.nodes if n.ident and _names_at(n, offset)), None)
    if not at:
        raise CannotRewrite("no name here")
    name, new = at.ident, _new_name(new_name)
    if at.kind in ("ConstructorDeclaration", "DestructorDeclaration"):
        raise CannotRewrite("constructors are named by their type")
    places = {n.start for n in f.uses(name)} | {n.name_start for n in f.nodes if n.ident == name and n.name_start is not None}
    out = [Edit(p, len(name), new) for p in sorted(places)]
    kinds = ("Comment", "DocumentationComment") * in_comments + ("StringLiteralExpression",) * in_strings
    for n in f.nodes:
        if n.kind in kinds:
            out += [Edit(n.start + m.start(), len(name), new) for m in re.finditer(re.escape(name), f.text(n))]
    return out


def _names_at(n: Node, offset: int) -> bool:
    start = n.start if n.kind == "IdentifierName" else n.name_start
    return start is not None and start <= offset <= start + len(n.ident)


#: Names of variables by the type of their value.
VALUE_NAMES = {
    "string": "str", "int": "num", "long": "num", "double": "value", "decimal": "amount", "bool": "flag", "DateTime": "date", "object": "obj",
}
_EXPRESSIONS = ("StringLiteralExpression", "NumericLiteralExpression", "InvocationExpression", "ObjectCreationExpression")


def literal_type(value: str | None) -> str | None:
    """The type that an expression's text shows: of literals and of objects made in place."""
    value = (value or "").strip()
    if re.fullmatch(r'[$@]*".*"', value, re.S):
        return "string"
    if value in ("true", "false"):
        return "bool"
    if re.fullmatch(r"'(?:\\.|[^'])+'", value):
        return "char"
    if number := re.fullmatch(r"-?(0[xX][0-9a-fA-F_]+|0[bB][01_]+|\d[\d_]*)([uUlL]*)", value):
        return {"": "int", "l": "long", "u": "uint"}.get("".join(sorted(set(number[2].lower()))), "ulong")
    if number := re.fullmatch(r"-?\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?([fFdDmM]?)", value):
        return {"f": "float", "m": "decimal"}.get(number[1].lower(), "double")
    if made := re.match(r"new\s+([\w.]+(?:<[^()]*>)?)\s*[({]", value):
        return made[1]
    return None


def suggested_name(e: Node, value: str) -> str:
    """A name for a variable that holds an expression, by its type and else by what it calls."""
    known = VALUE_NAMES.get(literal_type(value) or "")
    if not known and e.kind == "InvocationExpression" and e.receiver:
        known = e.ident[:1].lower() + e.ident[1:]
    return known or "value"


@rewrite("Extract", *_EXPRESSIONS)
def introduce_variable(f: File, offset: int, name: str | None = None) -> list[Edit]:
    """A variable for the expression at a place, declared before its statement."""
    e = f.innermost(offset, *_EXPRESSIONS)
    start = e.start - len(e.receiver + ".") if e.kind == "InvocationExpression" and e.receiver and e.receiver != "?" else e.start
    s = f.innermost(offset, "LocalDeclarationStatement", "ExpressionStatement", "ReturnStatement", "IfStatement", "ThrowStatement")
    value = f.source[start : e.end]
    new = _new_name(name or suggested_name(e, value))
    return [Edit(s.start, 0, f"var {new} = {value};\n{f.indent(s.start)}"), Edit(start, e.end - start, new)]


#: What a jump leaves or goes on with.
_JUMPS = {"BreakStatement": (*LOOPS, "DoStatement", "SwitchStatement"), "ContinueStatement": (*LOOPS, "DoStatement")}


@rewrite("Extract", "Block")
def extract_method(f: File, offset: int, length: int, name: str, types: dict | None = None) -> list[Edit]:
    """A method of the statements in a span, by the flow of control and data through them.

    What they read of variables that have a value before becomes parameters. One variable that they write
    and that is read afterwards, whether declared inside or outside, becomes the result; more than one is
    refused, and so is control that leaves the span in several ways. ``types`` gives types of variables
    that are declared with ``var``, by name.
    """
    new, owner = _new_name(name), f.innermost(offset, "MethodDeclaration", "ConstructorDeclaration")
    chosen = [n for n in f.inside(owner, *STATEMENTS) if offset <= n.start and n.end <= offset + length and n.kind != "SwitchLabel"]
    if not chosen:
        raise CannotRewrite("the selection holds no statement")
    start, end = min(n.start for n in chosen), max(n.end for n in chosen)
    outer = [n for n in chosen if not any(m is not n and m.start <= n.start and n.end <= m.end for m in chosen)]
    clauses = ("ElseClause", "CatchClause", "FinallyClause")
    if len({n.parent for n in outer}) > 1 or outer[0].kind in clauses or any(n.kind in clauses and n.parent == outer[-1].parent and f.source[end : n.start].strip() == "" for n in f.nodes if n.start >= end):
        raise CannotRewrite("the selection isn't a row of whole statements")
    flow = f.flow(owner)
    units = {k: u for k, u in flow.units.items() if start <= u.node.start < end}
    if any(f.text(u.node).startswith(("yield ", "goto ")) for u in units.values()):
        raise CannotRewrite("the selection yields or jumps")
    entries = {k for k in flow.first if k in units} | {x for k, u in flow.units.items() if k not in units for x in u.next if x in units}
    leaves = {x for u in units.values() if u.reachable for x in u.next if x not in units and x >= 0}
    jumps = any(u.node.kind in _JUMPS and f.around(u.node, *_JUMPS[u.node.kind]).start < start for u in units.values())
    returns = any(u.node.kind == "ReturnStatement" for u in units.values())
    falls = bool(leaves) or any(x == EXIT and u.node.kind not in ("ReturnStatement", "ThrowStatement") for u in units.values() for x in u.next)
    if len(entries) > 1 or jumps or len(leaves) > 1 or returns and falls:
        raise CannotRewrite("control enters or leaves the selection in several ways")
    bits = lambda rows: functools.reduce(operator.or_, rows, 0)
    inside = bits(1 << i for i, s in enumerate(flow.symbols) if start <= s.name_start < end)
    written, used = bits(u.writes | u.may for u in units.values()), bits(u.reads | u.writes | u.may for u in units.values())
    live = bits(flow.units[k].live_in for k in entries) if any(u.reachable for u in units.values()) else used
    needed, results = live & used & ~inside, written & bits(flow.units[x].live_in for x in leaves)
    if results.bit_count() > 1:
        raise CannotRewrite("more than one value is used afterwards")
    first_use = lambda i: min((n.start for n in f.uses(flow.symbols[i].ident, owner) if n.start >= start), default=end)
    type_of = lambda i: (types or {}).get(flow.symbols[i].ident) or _type_of(flow.symbols[i])
    given = sorted(flow_members(needed), key=first_use)
    unset = flow_members(used & ~needed & ~inside)
    result = flow.symbols[results.bit_length() - 1] if results else None
    kind = type_of(results.bit_length() - 1) if results else owner.type_text or "void" if returns else "void"
    waits = any(start <= n.start < end for n in f.inside(owner, "AwaitExpression"))
    if waits and returns:
        kind = re.sub(r"^(?:[\w.]*\b)?Task(?:<(.*)>)?$", lambda m: m[1] or "void", kind)
    body, pad = f.source[start:end], f.indent(owner.start)
    lines = [*(f"{type_of(i)} {flow.symbols[i].ident};" for i in unset), body, *([f"return {result.ident};"] if result else [])]
    kept = [i for i in flow_members(inside & ~results) if any(n.start >= end for n in f.uses(flow.symbols[i].ident, owner))]
    call = f"{'await ' if waits else ''}{new}({', '.join(flow.symbols[i].ident for i in given)});"
    if result:
        call = f"{result.ident} = {call}" if not results & inside else f"{kind} {result.ident} = {call}"
    elif returns:
        call = f"return {call}" if kind != "void" else f"{call}\n{f.indent(start)}return;"
    static = "static " if "static" in (owner.modifiers or "").split() else ""
    if waits:
        static, kind = static + "async ", "Task" if kind == "void" else f"Task<{kind}>"
    # Variables that the span declares, but that only get their value after it, are still declared there.
    call = "".join(f"{type_of(i)} {flow.symbols[i].ident};\n{f.indent(start)}" for i in kept) + call
    params = ", ".join(f"{type_of(i)} {flow.symbols[i].ident}" for i in given)
    text_ = "".join(f"\n{pad}    {x}" for x in lines)
    method = f"\n\n{pad}private {static}{kind} {new}({params})\n{pad}{{{text_}\n{pad}}}"
    return [Edit(start, end - start, call), Edit(owner.end, 0, method)]


def _type_of(n: Node) -> str:
    """The type of a local or parameter, which ``var`` takes from its value."""
    if n.type_text != "var":
        return re.sub(r"^(?:(?:this|params|scoped|const)\s+)+", "", n.type_text)
    found = literal_type(n.detail) if n.detail else None
    if not found:
        raise CannotRewrite(f"the type of {n.ident} can't be told")
    return found


@rewrite("Encapsulate", "FieldDeclaration")
def encapsulate_field(f: File, offset: int) -> list[Edit]:
    """A private field with a property, and the field's uses through it."""
    n = f.innermost(offset, "FieldDeclaration")
    if any(m.kind == "FieldDeclarator" and n.start <= m.start < n.end for m in f.nodes):
        raise CannotRewrite("the declaration has several fields")
    bare = n.ident.lstrip("_")
    prop, hidden = bare[:1].upper() + bare[1:], "_" + bare[:1].lower() + bare[1:]
    mods = [m for m in (n.modifiers or "").split() if m not in ("public", "private", "protected", "internal")]
    value = f.source[f.declared_at(n) + len(n.ident) : n.end]
    pad = f.indent(n.start)
    setter = "" if "readonly" in mods else f" set => {hidden} = value;"
    keep = "".join(m + " " for m in mods if m == "static")
    text = f"private {' '.join([*mods, n.type_text])} {hidden}{value}\n\n{pad}public {keep}{n.type_text} {prop} {{ get => {hidden};{setter} }}"
    return [Edit(n.start, n.end - n.start, text)] + [Edit(u.start, len(n.ident), prop) for u in f.uses(n.ident) if not n.start <= u.start < n.end]


@rewrite("Extract", "ClassDeclaration", "StructDeclaration")
def extract_interface(f: File, offset: int, name: str | None = None) -> list[Edit]:
    """An interface of the public instance methods and properties, added to the type's bases."""
    t = f.innermost(offset, "ClassDeclaration", "StructDeclaration")
    new, pad = _new_name(name or "I" + t.ident), f.indent(t.start)
    rows = []
    for n in f.nodes:
        mods = (n.modifiers or "").split()
        if n.parent != t.number or "public" not in mods or "static" in mods:
            continue
        if n.kind == "MethodDeclaration":
            head = f.source[f.declared_at(n) : n.end]
            deep = cut = 0
            for cut, c in enumerate(head):  # noqa: B007
                deep += (c == "(") - (c == ")")
                if c == ")" and not deep:
                    break
            rows.append(f"{n.type_text} {head[: cut + 1]};")
        elif n.kind == "PropertyDeclaration":
            names = [a.ident for a in f.nodes if a.parent == n.number and a.kind == "AccessorDeclaration" and not a.modifiers] or ["get"]
            rows.append(f"{n.type_text} {n.ident} {{ {' '.join(x + ';' for x in names)} }}")
    if not rows:
        raise CannotRewrite("no public members")
    text = f"public interface {new}\n{pad}{{\n" + "".join(f"{pad}    {r}\n" for r in rows) + f"{pad}}}\n\n{pad}"
    brace = f.source.index("{", t.start)
    colon = f.source.find(":", t.start, brace)
    base = Edit(colon + 1, 0, f" {new},") if colon >= 0 else Edit(f.declared_at(t) + len(t.ident), 0, f" : {new}")
    return [Edit(t.start, 0, text), base]


#: What a new argument is when nothing is said, by the type's name and by how a parameter's name begins.
DEFAULTS = {
    "int": "0", "long": "0", "short": "0", "byte": "0", "double": "0.0", "float": "0.0", "bool": "false", "string": "null", "object": "null",
}
NAME_DEFAULTS = {"is": "false", "count": "0", "index": "0", "name": "null", "text": "null"}


def _default(type_name: str) -> str:
    return "null" if type_name.endswith("[]") else DEFAULTS.get(type_name, "default")


def _arguments(text: str) -> list[str]:
    out, deep, last = [], 0, 0
    for i, c in enumerate(text):
        deep += (c in "([{") - (c in ")]}")
        if c == "," and not deep:
            out.append(text[last:i].strip())
            last = i + 1
    return [*out, text[last:].strip()] if text.strip() else []


def _calls(f: File, m: Node) -> list[tuple[Node, int, str]]:
    """Calls by the method's name: the node, and the place and text of its arguments."""
    out = []
    for n in f.nodes:
        if n.kind == "InvocationExpression" and n.ident == m.ident:
            out.append((n, n.end - 1 - len(f.source[n.start : n.end].split("(", 1)[1][:-1]), n.detail or ""))
    return out


def _parameters(f: File, m: Node) -> tuple[int, int]:
    open_ = f.source.index("(", f.declared_at(m))
    deep = 0
    for i in range(open_, m.end):
        deep += (f.source[i] == "(") - (f.source[i] == ")")
        if not deep:
            return open_ + 1, i
    raise CannotRewrite("the parameter list has no end")


@rewrite("Signature", "MethodDeclaration")
def change_signature(f: File, offset: int, parameters: list[dict], return_type: str | None = None) -> list[Edit]:
    """New parameters and result; calls keep leading arguments and get defaults for the others."""
    m = f.innermost(offset, "MethodDeclaration")
    a, b = _parameters(f, m)
    out = [Edit(a, b - a, ", ".join(f"{p['type']} {_new_name(p['name'])}" for p in parameters))]
    if return_type:
        at = f.source.index(m.type_text, m.start)
        out.append(Edit(at, len(m.type_text), return_type))
    for n, at, text in _calls(f, m):
        given = _arguments(text)[: len(parameters)]
        given += [_default(p["type"]) for p in parameters[len(given) :]]
        out.append(Edit(at, n.end - 1 - at, ", ".join(given)))
    return out


@rewrite("Signature", "MethodDeclaration")
def add_parameter(f: File, offset: int, type_name: str, name: str, default: str | None = None) -> list[Edit]:
    """One more parameter, and an argument for it in every call."""
    m = f.innermost(offset, "MethodDeclaration")
    a, b = _parameters(f, m)
    by_name = next((v for k, v in NAME_DEFAULTS.items() if name.lower().startswith(k)), None)
    value = default or by_name or _default(type_name)
    out = [Edit(b, 0, f"{', ' if f.source[a:b].strip() else ''}{type_name} {_new_name(name)}")]
    return out + [Edit(n.end - 1, 0, f"{', ' if text.strip() else ''}{value}") for n, _, text in _calls(f, m)]


@rewrite("Inline", "LocalDeclarationStatement")
def inline_temporary(f: File, offset: int) -> list[Edit]:
    """Replace a variable that is never assigned again by its value."""
    d = f.innermost(offset, "LocalDeclarationStatement")
    if d.detail is None:
        raise CannotRewrite("the variable has no value")
    if f.inside(d, "LocalDeclarator"):
        raise CannotRewrite("the declaration has several variables")
    block = f.innermost(d.start, "Block")
    uses = [u for u in f.uses(d.ident, block) if u.start >= d.end]
    if any(re.match(r"\s*(?:=(?!=)|[-+*/%&|^]=|\+\+|--)", f.source[u.end :]) for u in uses):
        raise CannotRewrite("the variable is assigned again")
    simple = re.fullmatch(r'[\w.]+|"[^"]*"|[\w.]+\([^()]*\)', d.detail)
    value = d.detail if simple else f"({d.detail})"
    end = re.compile(r"[ \t]*\n?").match(f.source, d.end).end()
    line = f.source.rfind("\n", 0, d.start) + 1
    start = line if not f.source[line : d.start].strip() else d.start
    return [Edit(start, end - start, "")] + [Edit(u.start, len(d.ident), value) for u in uses]


@rewrite("Simplify", "LocalDeclarationStatement", "ExpressionStatement", "IfStatement", "ReturnStatement")
def safely_remove_as(f: File, offset: int) -> list[Edit]:
    """``x as T == null`` becomes ``!(x is T)``, ``x as T != null`` becomes ``x is T``, else a cast."""
    s = f.innermost(offset, "LocalDeclarationStatement", "ExpressionStatement", "IfStatement", "ReturnStatement")
    out = []
    for m in re.finditer(r"\(?([\w.]+)\s+as\s+([\w.<>]+)(\))?(\s*(==|!=)\s*null)?", f.text(s)):
        x, t, closed, test, mark = m.groups()
        whole = f"!({x} is {t})" if mark == "==" else f"{x} is {t}" if test else f"(({t}){x})" if closed else f"({t}){x}"
        start = m.start() + (m[0].startswith("(") and not closed)
        out.append(Edit(s.start + start, m.end() - start, whole))
    if not out:
        raise CannotRewrite("no as here")
    return out


@rewrite("Simplify", "CompilationUnit")
def remove_unnecessary_code(f: File, offset: int = 0) -> list[Edit]:
    """Drop usings whose last segment isn't named, statements that control can't reach, and locals never read."""
    gone: list[Node] = []
    named = {n.ident for n in f.nodes if n.kind == "IdentifierName"} | set(re.findall(r"\w+", " ".join(n.type_text or "" for n in f.nodes)))
    for n in f.nodes:
        if n.kind == "UsingDirective" and not n.modifiers and not n.type_text and n.ident.rsplit(".", 1)[-1] not in named:
            gone.append(n)
        if n.kind == "LocalDeclarationStatement" and n.parent >= 0:
            parent = f.nodes[n.parent]
            alone = not f.inside(n, "LocalDeclarator")
            if alone and not any(u.start >= n.end for u in f.uses(n.ident, parent)) and "(" not in (n.detail or ""):
                gone.append(n)
        if n.kind in MEMBERS:
            gone += _unreachable(f, n)
    return _cut(f, gone)


def _unreachable(f: File, owner: Node) -> list[Node]:
    """Statements of a member, in blocks, that control can't reach; functions among them may still be called."""
    units = sorted(f.flow(owner).units.values(), key=lambda u: u.node.start)
    units = [u for u in units if u.node.kind != "LocalFunctionStatement"]
    if all(u.reachable for u in units):
        return []
    starts, dead = [u.node.start for u in units], [0, *accumulate(not u.reachable for u in units)]
    out = []
    for n in f.inside(owner, *STATEMENTS):
        i, j = bisect_left(starts, n.start), bisect_left(starts, n.end)
        if i < j and dead[j] - dead[i] == j - i and n.kind not in ("SwitchLabel", "LocalFunctionStatement") and f.nodes[n.parent].kind == "Block":
            out.append(n)
    return out


def _cut(f: File, gone: list[Node]) -> list[Edit]:
    """Deletions of nodes, with their line where nothing else is on it."""
    out, upto = [], -1
    for n in sorted(gone, key=lambda n: (n.start, -n.end)):
        line = f.source.rfind("\n", 0, n.start) + 1
        alone = not f.source[line : n.start].strip()
        rest = re.compile(r"[ \t]*(?:\n|$)" if alone else r"[ \t]*").match(f.source, n.end)
        start, end = (line, rest.end()) if alone and rest else (n.start, n.end)
        if start >= upto:
            out.append(Edit(start, end - start, ""))
            upto = end
    return out


_FOR = re.compile(r"for\s*\(\s*(?:var|int)\s+(\w+)\s*=\s*([^;]+);\s*\1\s*(<=?|>=?)\s*([^;]+);\s*(?:\1\s*(\+\+|--)|(\+\+|--)\s*\1)\s*\)")


@rewrite("Convert", "ForStatement")
def convert_for_to_foreach(f: File, offset: int) -> list[Edit]:
    """A loop over all indices of a list becomes one over its items."""
    s = f.innermost(offset, "ForStatement")
    m = _FOR.match(f.text(s))
    size = m and re.fullmatch(r"([\w.]+)\.(?:Count|Length)", m[4].strip())
    if not size or m[2].strip() != "0" or m[3] != "<" or (m[5] or m[6]) != "++":
        raise CannotRewrite("the loop doesn't run over all indices")
    body, item = f.text(s)[m.end() :], "item"
    replaced = re.sub(rf"\b{re.escape(size[1])}\s*\[\s*{m[1]}\s*\]", item, body)
    if re.search(rf"\b{m[1]}\b", replaced):
        raise CannotRewrite("the index is used")
    return [Edit(s.start, s.end - s.start, f"foreach (var {item} in {size[1]}){replaced}")]


@rewrite("Convert", "ForEachStatement")
def convert_foreach_to_for(f: File, offset: int) -> list[Edit]:
    """A loop over items becomes one over the indices of a list."""
    s = f.innermost(offset, "ForEachStatement")
    m = re.match(r"foreach\s*\(\s*([\w.<>]+)\s+(\w+)\s+in\s+([\w.]+)\s*\)", f.text(s))
    if not m:
        raise CannotRewrite("the loop isn't over a name")
    body = re.sub(rf"\b{m[2]}\b", f"{m[3]}[i]", f.text(s)[m.end() :])
    return [Edit(s.start, s.end - s.start, f"for (int i = 0; i < {m[3]}.Count; i++){body}")]


@rewrite("Convert", "IfStatement")
def convert_if_to_switch(f: File, offset: int) -> list[Edit]:
    """A chain of tests of one value for equality becomes a switch."""
    s = f.innermost(offset, "IfStatement")
    text, cases, subject = f.source[s.start :], [], None
    branch = re.compile(r"\s*if\s*\(\s*([\w.]+)\s*==\s*([^()]+?)\s*\)\s*\{([^{}]*)\}\s*(else)?")
    at, default = 0, None
    while m := branch.match(text, at):
        if subject not in (None, m[1]):
            raise CannotRewrite("the tests differ in their value")
        subject = m[1]
        cases.append((m[2], m[3].strip()))
        at = m.end()
        if not m[4]:
            break
        if last := re.compile(r"\s*\{([^{}]*)\}").match(text, at):
            default, at = last[1].strip(), last.end()
            break
    if len(cases) < 2:
        raise CannotRewrite("fewer than two tests for equality")
    pad = f.indent(s.start)
    leave = lambda x: "" if re.search(r"\b(return|throw|continue|break)\b[^;]*;\s*$", x) else f"\n{pad}        break;"
    rows = [f"{pad}    case {v}:\n{pad}        {x}{leave(x)}\n" for v, x in cases]
    rows += [f"{pad}    default:\n{pad}        {default}{leave(default)}\n"] if default is not None else []
    return [Edit(s.start, len(text[:at].rstrip()), f"switch ({subject})\n{pad}{{\n{''.join(rows)}{pad}}}")]


@rewrite("Convert", "ForStatement")
def reverse_for_statement(f: File, offset: int) -> list[Edit]:
    """Run a counting loop the other way."""
    s = f.innermost(offset, "ForStatement")
    m = _FOR.match(f.text(s))
    if not m:
        raise CannotRewrite("the loop doesn't count by one")
    v, start, mark, end, up = m[1], m[2].strip(), m[3], m[4].strip(), (m[5] or m[6]) == "++"
    if up != (mark[0] == "<"):
        raise CannotRewrite("the loop doesn't end")
    last = end if "=" in mark else f"{end} {'-' if up else '+'} 1"
    head = f"for (int {v} = {last}; {v} {'>=' if up else '<='} {start}; {v}{'--' if up else '++'})"
    return [Edit(s.start, m.end(), head)]


def edits(documents: DataFrame, rule: str, targets: DataFrame | None = None, /, **arguments) -> DataFrame:
    """Run a rewrite (doc_id, content) at each target: rows of :data:`EDIT_SCHEMA`, or an error.

    ``targets`` has a row for each place: its doc_id, and its ``offset`` or its ``line`` and ``column``
    from 0; further columns are arguments of their own, before those in ``arguments``. Documents
    without a target aren't touched. Without ``targets`` the rewrite runs on every whole document,
    which only those without a place can do.
    """
    if rule not in CATALOG:
        raise KeyError(rule)
    source = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    if targets is None:
        if signature(CATALOG[rule].run).parameters["offset"].default is Parameter.empty:
            raise ValueError(f"{rule} needs targets")
        source = source.withColumn("more", F.lit("{}"))
    else:
        more = F.to_json(F.struct(*(F.col(f"`{c}`") for c in targets.columns if c != "doc_id")))
        source = source.join(targets.select(F.col("doc_id").cast("string").alias("doc_id"), more.alias("more")), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content, more in zip(batch["doc_id"], batch["content"], batch["more"], strict=True):
                if content is None:
                    continue
                f, given = File(content), arguments | json.loads(more)
                try:
                    if "line" in given:
                        given["offset"] = f.offset(given.pop("line"), given.pop("column", 0))
                    found = CATALOG[rule].run(f, **given)
                    rows += [(doc, e.start, e.length, e.new_text, None) for e in dict.fromkeys(found)]
                except CannotRewrite as e:
                    rows.append((doc, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "new_text", "error"])
            yield out.astype({"start": "Int32", "length": "Int32"})

    return source.mapInPandas(run, EDIT_SCHEMA).distinct()


def applied(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, content, conflict)`` of all documents after edits; those with an error stay as they are."""
    return text.apply_edits(documents, found.filter("error is null"), "doc_id", "content")


def catalog(spark) -> DataFrame:
    """``(category, name, applies_to)`` of all rewrites, in that order."""
    rows = [(r.category, r.name, list(r.applies_to)) for r in CATALOG.values()]
    return spark.createDataFrame(rows, "category string, name string, applies_to array<string>").orderBy("category", "name")
