"""C# source as rows of syntax nodes.

A lexer and a bracket-and-keyword parser, run by ``mapInPandas`` over whole documents, emit one row a
node with offsets, lines and the parent's number. Names are not bound here; that is done by joins.
Positions are 0-based.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.names import KEYWORDS

NODE_SCHEMA = (
    "doc_id string, node_id long, parent_id long, kind string, start int, length int, line int, column int, "
    "end_line int, end_column int, depth int, ident string, modifiers string, type_text string, detail string, "
    "receiver string, args array<string>, name_start int, target int, arg_starts array<int>, owners array<long>, ancestors array<string>, "
    "in_type long, in_member long, in_space string, call_args array<string>, call_starts array<int>, local long"
)
OWNERS = frozenset(
    "ClassDeclaration StructDeclaration InterfaceDeclaration RecordDeclaration RecordStructDeclaration EnumDeclaration NamespaceDeclaration "
    "FileScopedNamespaceDeclaration MethodDeclaration ConstructorDeclaration DestructorDeclaration OperatorDeclaration PropertyDeclaration "
    "IndexerDeclaration FieldDeclaration FieldDeclarator EventDeclaration EnumMemberDeclaration".split()
)
#: Rows of nodes that a worker holds before it hands them on; a batch of documents may have hundreds of times as many.
FRAME_ROWS = 10_000
#: Declarations inside members that names without a receiver may mean.
LOCAL_KINDS = ("LocalDeclarationStatement", "LocalDeclarator", "Parameter", "LambdaParameter", "LocalFunctionStatement")
#: Owners that are types, namespaces, and members with statements or expressions.
_IN_TYPE = frozenset(k for k in OWNERS if k.startswith(("Class", "Struct", "Interface", "Record")) or k == "EnumDeclaration")
_IN_SPACE = frozenset(k for k in OWNERS if "Namespace" in k)
_IN_MEMBER = OWNERS - _IN_TYPE - _IN_SPACE - {"EnumMemberDeclaration"}
MODIFIERS = frozenset(
    "public private protected internal static abstract sealed virtual override async readonly const new extern unsafe "
    "partial volatile required file ref".split()
)
_TYPES = {
    "class": "ClassDeclaration", "struct": "StructDeclaration", "interface": "InterfaceDeclaration",
    "enum": "EnumDeclaration", "record": "RecordDeclaration",
}
_STATEMENTS = {
    "if": "IfStatement", "while": "WhileStatement", "do": "DoStatement", "for": "ForStatement",
    "foreach": "ForEachStatement", "switch": "SwitchStatement", "catch": "CatchClause", "return": "ReturnStatement",
    "break": "BreakStatement", "continue": "ContinueStatement", "throw": "ThrowStatement", "try": "TryStatement",
    "else": "ElseClause", "using": "UsingStatement", "lock": "LockStatement",
}
_TOKEN = re.compile(
    r'''(?P<doc>///[^\n]*)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>(?m:^[ \t]*\#[^\n]*))'''
    r'''|(?P<raw>\$*"""+.*?(?:"""+|\Z))|(?P<verbatim>(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z))'''
    r'''|(?P<string>\$?"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z))|(?P<char>'(?:\\.|[^'\\\n])+')'''
    r'''|(?P<number>\d[\w.]*)|(?P<name>@?[^\W\d]\w*)'''
    r'''|(?P<mark>=>|\?\?=?|\?\.|::|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|[^\s\w])''',
    re.S,
)


_ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??=", "++", "--"))


_TYPE_MARKS = frozenset((".", "<", ">", ",", "?", "[", "]", "*", "::", "(", ")"))


#: Words that may stand in front of a type.
_BEFORE_TYPE = frozenset("this ref out in params readonly scoped where new static const global unmanaged class struct notnull default await".split())
#: Words that begin no declaration, whatever follows.
_NO_TYPE = frozenset("await yield goto new throw return else case when in is as not and or typeof nameof sizeof".split())
#: Signs of a type that stands in brackets before a value.
_VALUE_BEGINS = frozenset(("(", "!", "~"))


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Node:
    kind: str
    start: int
    end: int = 0
    parent: int = -1
    depth: int = 0
    ident: str | None = None
    modifiers: str | None = None
    type_text: str | None = None
    detail: str | None = None
    receiver: str | None = None
    args: list[str] | None = None
    name_start: int | None = None
    target: int | None = None  # where the expression begins that this one is applied to, or that gives it its value
    arg_starts: list[int] | None = None  # where each argument begins, -1 if it is no such expression
    number: int = field(default=-1)


def tokens(source: str) -> tuple[list[Token], list[Token]]:
    """Tokens of the program, and its comments and directives."""
    code, trivia = [], []
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup
        (trivia if kind in ("doc", "comment", "directive") else code).append(Token(kind, m[0], m.start(), m.end()))
    return code, trivia


class _Parser:
    def __init__(self, source: str):
        self.source = source
        self.code, self.trivia = tokens(source)
        self.nodes: list[Node] = []
        self.wrong: list[tuple[str, str, int, int]] = []
        self.match = self._brackets()
        self.opening = {j: i for i, j in self.match.items()}
        self.around = self._around()

    def _brackets(self) -> dict[int, int]:
        pairs, out, stack = {"(": ")", "[": "]", "{": "}"}, {}, []
        for i, t in enumerate(self.code):
            if t.kind != "mark":
                continue
            if t.text in pairs:
                stack.append(i)
            elif t.text in pairs.values():
                if not any(pairs[self.code[k].text] == t.text for k in stack):
                    self.wrong.append(("CS1022", f"{t.text} unexpected", t.start, t.end))
                    continue
                while pairs[self.code[stack[-1]].text] != t.text:
                    self._open(stack.pop(), t.start)
                out[stack.pop()] = i
        for i in reversed(stack):
            out[i] = len(self.code) - 1
            self._open(i, self.code[-1].end)
        return out

    def _around(self) -> list[int]:
        """For each token, the innermost bracket around it, or -1."""
        out, stack = [], [-1]
        for i in range(len(self.code)):
            while stack[-1] >= 0 and self.match[stack[-1]] <= i:
                stack.pop()
            out.append(stack[-1])
            if i in self.match:
                stack.append(i)
        return out

    def _open(self, i: int, at: int) -> None:
        """Note that bracket i has no partner before a place."""
        t = self.code[i]
        error = {"{": ("CS1513", "} expected"), "(": ("CS1026", ") expected"), "[": ("CS1003", "] expected")}[t.text]
        self.wrong.append((*error, at, at))

    def text(self, i: int) -> str:
        return self.code[i].text if 0 <= i < len(self.code) else ""

    def add(self, kind: str, first: int, last: int, parent: Node | None, name: int | None = None, **more) -> Node:
        """A node from token ``first`` to ``last``; its name, if it declares one, is token ``name``."""
        last = max(first, min(last, len(self.code) - 1))
        if name is not None:
            more |= {"ident": self.text(name), "name_start": self.code[name].start if name < len(self.code) else None}
        start = self.code[first].start if self.code else 0
        end = self.code[last].end if self.code else len(self.source)
        node = Node(kind, start, end, parent.number if parent else -1, parent.depth + 1 if parent else 0, **more)
        node.number = len(self.nodes)
        self.nodes.append(node)
        return node

    def source_of(self, i: int, j: int) -> str:
        """Text from token i up to, not including, token j."""
        return self.source[self.code[i].start : self.code[j - 1].end] if i < j else ""

    def run(self) -> list[Node]:
        root = Node("CompilationUnit", 0, len(self.source), number=0)
        self.nodes.append(root)
        self.members(0, len(self.code), root, None)
        for t in self.trivia:
            kind = {"doc": "DocumentationComment", "directive": "Directive"}.get(t.kind, "Comment")
            node = Node(kind, t.start, t.end, 0, 1, detail=t.text, number=len(self.nodes))
            self.nodes.append(node)
            if t.text.startswith("/*") and not (t.text.endswith("*/") and len(t.text) > 3):
                self.wrong.append(("CS1035", "end of comment expected", t.start, t.end))
        for t in self.code:
            if t.kind in ("string", "verbatim", "raw") and (len(t.text.lstrip("$@")) < 2 or not t.text.endswith('"')):
                self.wrong.append(("CS1010", "end of string expected", t.start, t.end))
        for id_, message, start, end in sorted(self.wrong, key=lambda x: (x[2], x[0])):
            self.nodes.append(Node("Error", start, end, 0, 1, ident=id_, detail=message, number=len(self.nodes)))
        return self.nodes

    def type_names(self, i: int, j: int, parent: Node) -> None:
        """Names of types between two tokens, as in a declaration."""
        for k in range(i, j):
            t = self.code[k]
            if k > i and (self.text(k - 1) in (">", "]", "?") or self.code[k - 1].kind == "name" and self.text(k - 1) not in _BEFORE_TYPE):
                continue  # the name of a tuple's element
            if t.kind == "name" and t.text not in KEYWORDS and t.text not in ("var", "where", "notnull", "unmanaged", "await"):
                self.add("IdentifierName", k, k, parent, ident=t.text, receiver=self._receiver(k))

    def declarators(self, i: int, j: int) -> list[tuple[int, int, int]]:
        """(name, first of the value, end) of each variable in a declaration; no value has equal places."""
        out, k = [], i
        while k < j:
            # Up to the name, commas may stand between type arguments; behind "=", in expressions.
            cut = self._comma(k, j)
            equals = self.find(k, cut, "=")
            name = equals - 1
            if name < i or self.code[name].kind != "name":
                break
            out.append((name, min(equals + 1, cut), cut))
            k = cut + 1
        return out

    def _value_end(self, i: int, j: int) -> int:
        """The next comma that isn't inside brackets or the type arguments of an expression."""
        while i < j:
            t = self.text(i)
            if t in ("(", "[", "{") and i in self.match:
                i = self.match[i]
            elif t == "<" and self.code[i - 1].kind == "name":
                i = self._arguments_end(i, j) or i
            elif t == ",":
                return i
            i += 1
        return j

    def _arguments_end(self, i: int, j: int) -> int | None:
        """The closing mark of type arguments that begin at i, by the rule of the language, if they are some."""
        deep = 0
        for k in range(i, j):
            x = self.text(k)
            if x in ("<", ">"):
                deep += 1 if x == "<" else -1
                if not deep:
                    return k if self.text(k + 1) in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "|", "^", "&&", "||", "&", "[", "{", "") else None
            elif self.code[k].kind != "name" and x not in (",", ".", "?", "[", "]", "(", ")"):
                return None
        return None

    def find(self, i: int, end: int, marks: str) -> int:
        """The next token at bracket depth 0 that is one of the marks."""
        while i < end:
            if self.code[i].kind == "mark":
                if self.text(i) in marks.split():
                    return i
                if i in self.match:
                    i = self.match[i]
            i += 1
        return end

    def members(self, i: int, end: int, parent: Node, owner: str | None) -> None:
        while i < end:
            t = self.text(i)
            if t in (";", "}", ")"):
                i += 1
            elif t == "[":
                j = self.match.get(i, i)
                self.attributes(i, j, self.add("AttributeList", i, j, parent, detail=self.source_of(i + 1, j)))
                i = j + 1
            elif t in ("using", "global") and owner is None and (t == "using" or self.text(i + 1) == "using"):
                i = self.using(i, end, parent)
            elif t == "namespace" and owner is None:
                i = self.namespace(i, end, parent)
            else:
                i = self.member(i, end, parent, owner)

    def attributes(self, i: int, end: int, parent: Node) -> None:
        """The attributes between two square brackets, with the texts of their arguments."""
        k = i + 1
        if self.text(k + 1) == ":":  # a target such as assembly
            k += 2
        while k < end:
            j = self._value_end(k, end)
            paren = self.find(k, j, "(")
            args = self._listed(paren + 1, self.match.get(paren, j)) if paren < j else []
            self.add("Attribute", k, j - 1, parent, ident=self.source_of(k, paren), args=args)
            k = j + 1

    def explicit(self, i: int, k: int) -> tuple[int, str | None]:
        """Where the type of a member named by token k ends, and the interface that it names explicitly."""
        j = k
        while j - 2 > i and self.text(j - 1) == "." and self.code[j - 2].kind == "name":
            j -= 2
        return j, self.source_of(j, k - 1) if j < k else None

    def using(self, i: int, end: int, parent: Node) -> int:
        j = self.find(i, end, ";")
        if self.text(i + 1) in ("(", "var"):
            self.statements(i, j + 1, parent)
            return j + 1
        k = i + 1 + (self.text(i) == "global")
        static = self.text(k) == "static"
        k += static
        equals = self.find(k, j, "=")
        alias = self.source_of(k, equals) if equals < j else None
        name = self.source_of(equals + 1 if alias else k, j)
        self.add("UsingDirective", i, j, parent, ident=name, modifiers="static" if static else None, type_text=alias)
        return j + 1

    def namespace(self, i: int, end: int, parent: Node) -> int:
        j = self.find(i, end, "{ ;")
        whole = self.text(j) == ";"
        last = end - 1 if whole else self.match.get(j, end - 1)
        kind = "FileScopedNamespaceDeclaration" if whole else "NamespaceDeclaration"
        node = self.add(kind, i, last, parent, ident=self.source_of(i + 1, j))
        self.members(j + 1, end if whole else last, node, None)
        return end if whole else last + 1

    def member(self, i: int, end: int, parent: Node, owner: str | None) -> int:
        first, mods = i, []
        while self.text(i) in MODIFIERS and not (self.text(i) == "ref" and self.text(i + 1) not in ("struct", "readonly", "partial")):
            mods.append(self.text(i))
            i += 1
        modifiers = " ".join(mods) or None
        if self.text(i) in _TYPES and self.code[i].kind == "name" and not (self.text(i) == "record" and self.text(i + 1) in ("(", "=", ";")):
            return self.type(first, i, end, parent, modifiers)
        if owner is None and parent.kind == "CompilationUnit" and self.text(i) not in ("delegate",):
            j = self.statement_end(first, end)
            self.statements(first, j, parent)
            return max(j, first + 1)
        stop = self.find(i, end, "; { => =")
        paren = self._parameters_at(i, stop)
        if self.text(i) == "event":
            k = stop - 1
            j = self.match.get(stop, stop) if self.text(stop) == "{" else self.find(stop, end, ";")
            event = self.add("EventDeclaration", first, j, parent, k, modifiers=modifiers, type_text=self.source_of(i + 1, k))
            self.type_names(i + 1, k, event)
            return j + 1
        if paren < stop and (self.code[paren - 1].kind == "name" or self.text(paren - 1) in (">", "]") or self.text(i) in ("operator", "~")):
            return self.method(first, i, paren, end, parent, owner, modifiers)
        if self.text(stop) in ("{", "=>") and stop > i:
            return self.property(first, i, stop, end, parent, modifiers)
        j = self.find(i, end, ";")
        found = self.declarators(i, j)
        kind = self.source_of(i, found[0][0]) if found else None
        node = None
        for n, (name, value, stop) in enumerate(found):
            if not n:
                node = self.add("FieldDeclaration", first, j, parent, name, modifiers=modifiers, type_text=kind)
                self.type_names(i, name, node)
            else:
                self.add("FieldDeclarator", name, stop - 1, parent, name, modifiers=modifiers, type_text=kind)
            self.expression(value, stop, self.nodes[-1] if n else node)
        return max(j, i) + 1

    def _parameters_at(self, i: int, stop: int) -> int:
        """The bracket of a method's parameters: not that of a tuple, nor one among type arguments."""
        k, angle = i, 0
        while k < stop:
            t = self.text(k)
            if t == "(":
                if k > i and not angle and self.text(k - 1) not in ("(", ","):
                    return k
                k = self.match.get(k, k)
            elif t == "[":
                k = self.match.get(k, k)
            elif t in ("<", ">") and "operator" not in (self.text(k - 1), self.text(k - 2)):
                angle = max(0, angle + (1 if t == "<" else -1))
            k += 1
        return stop

    def type(self, first: int, i: int, end: int, parent: Node, modifiers: str | None) -> int:
        kind = _TYPES[self.text(i)]
        if self.text(i) == "record" and self.text(i + 1) in ("class", "struct"):
            kind = "RecordStructDeclaration" if self.text(i + 1) == "struct" else kind
            i += 1
        name = self.text(i + 1)
        body = self.find(i + 2, end, "{ ;")
        last = self.match.get(body, body) if self.text(body) == "{" else min(body, end - 1)
        colon = self.find(i + 2, body, ":")
        where = next((k for k in range(i, body) if self.code[k].text == "where"), body)
        bases = self.source_of(colon + 1, where) if colon < where else None
        angle = self._type_end(i + 1, body) if self.text(i + 2) == "<" else i + 2
        given = self.source_of(i + 3, angle - 1) if angle > i + 2 else None
        node = self.add(kind, first, last, parent, i + 1, modifiers=modifiers, type_text=bases, detail=given)
        if bases:
            self.type_names(colon + 1, where, node)
        paren = self.find(i + 2, min(colon, body), "(")
        if paren < min(colon, body):
            self.parameters(paren, node)
        if self.text(body) == "{":
            if kind == "EnumDeclaration":
                k = body + 1
                while k < last:
                    j = self.find(k, last, ",")
                    if self.code[k].kind == "name":
                        self.add("EnumMemberDeclaration", k, j - 1, node, k)
                    k = j + 1
            else:
                self.members(body + 1, last, node, name)
        return last + 1

    def parameters(self, paren: int, parent: Node) -> None:
        k, last = paren + 1, self.match.get(paren, paren)
        while k < last:
            j = self._comma(k, last)
            equals = self.find(k, j, "=")
            begin = k
            while self.text(begin) == "[":
                begin = self.match.get(begin, begin) + 1
            if equals - 1 >= begin:
                default = self.source_of(equals + 1, j) if equals < j else None
                node = self.add("Parameter", k, j - 1, parent, equals - 1, type_text=self.source_of(begin, equals - 1), detail=default)
                self.type_names(begin, equals - 1, node)
            k = j + 1

    def _comma(self, i: int, end: int) -> int:
        """The next comma outside brackets and type arguments."""
        angle = 0
        while i < end:
            t = self.text(i)
            if t in ("(", "[", "{") and i in self.match:
                i = self.match[i]
            elif t == "<":
                angle += 1
            elif t == ">":
                angle -= 1
            elif t == "," and angle <= 0 or t == "=":
                return i if t == "," else self._value_end(i, end)
            i += 1
        return end

    def method(self, first: int, i: int, paren: int, end: int, parent: Node, owner: str | None, modifiers: str | None) -> int:
        k = paren - 1
        if self.text(k) == ">":  # type parameters
            deep = 0
            while k > i:
                deep += (self.text(k) == ">") - (self.text(k) == "<")
                k -= 1
                if not deep:
                    break
        name = self.text(k)
        body = self.find(self.match.get(paren, paren) + 1, end, "{ => ;")
        if self.text(body) == "{":
            last = self.match.get(body, body)
        else:
            last = self.find(body, end, ";")
        kind = "MethodDeclaration"
        if name == owner:
            kind = "DestructorDeclaration" if self.text(k - 1) == "~" else "ConstructorDeclaration"
        elif "operator" in (self.text(k), self.text(k - 1), self.text(i)):
            kind = "OperatorDeclaration"
        stop, face = self.explicit(i, k) if kind == "MethodDeclaration" else (k, None)
        node = self.add(kind, first, last, parent, k, modifiers=modifiers, type_text=self.source_of(i, stop) or None, receiver=face)
        self.type_names(i, k, node)
        self.parameters(paren, node)
        if self.text(body) == "{":
            block = self.add("Block", body, last, node)
            self.statements(body + 1, last, block)
        elif self.text(body) == "=>":
            self.expression(body + 1, last, node)
        return last + 1

    def property(self, first: int, i: int, stop: int, end: int, parent: Node, modifiers: str | None) -> int:
        last = self.match.get(stop, stop) if self.text(stop) == "{" else self.find(stop, end, ";")
        k = stop - 1
        kind = "PropertyDeclaration"
        if self.text(k) == "]":
            kind = "IndexerDeclaration"
            k = next((a for a, b in self.match.items() if b == k), k) - 1
        upto, face = self.explicit(i, k)
        node = self.add(kind, first, last, parent, k, modifiers=modifiers, type_text=self.source_of(i, upto), receiver=face)
        self.type_names(i, k, node)
        if self.text(stop) == "=>":
            self.expression(stop + 1, last, node)
            return last + 1
        j = stop + 1
        while j < last:
            begin = j
            while self.text(j) in MODIFIERS:
                j += 1
            if self.text(j) in ("get", "set", "init", "add", "remove"):
                name = self.text(j)
                close = self.find(j + 1, last, "; {")
                tail = self.match.get(close, close) if self.text(close) == "{" else close
                accessor = self.add("AccessorDeclaration", begin, tail, node, ident=name)
                if self.text(close) == "{":
                    self.statements(close + 1, tail, accessor)
                elif close > j + 1:
                    self.expression(j + 2, close, accessor)
                j = tail
            j += 1
        if self.text(last + 1) == "=":
            close = self.find(last + 1, end, ";")
            self.expression(last + 2, close, node)
            last = close
            node.end = self.code[min(last, len(self.code) - 1)].end
        return last + 1

    def statement_end(self, i: int, end: int) -> int:
        """Past the statement that begins at i."""
        t = self.text(i)
        if t == "{":
            return self.match.get(i, i) + 1
        if t == "await" and self.text(i + 1) in ("foreach", "using"):
            return self.statement_end(i + 1, end)
        if (paren := self._local_function(i, end)) is not None:
            body = self.find(self.match.get(paren, paren) + 1, end, "{ => ;")
            return min((self.match.get(body, body) if self.text(body) == "{" else self.find(body, end, ";")) + 1, end)
        if t in ("if", "while", "for", "foreach", "switch", "using", "lock", "catch", "fixed") and self.text(i + 1) == "(":
            j = self.match.get(i + 1, i + 1) + 1
            if t == "catch" and self.text(j) == "when":
                j = self.match.get(j + 1, j + 1) + 1
            return self.statement_end(j, end) if j < end and self.text(j) != ";" else min(j + 1, end)
        if t in ("else", "do", "try", "finally", "catch", "unsafe", "checked", "unchecked"):
            j = self.statement_end(i + 1, end) if i + 1 < end else end
            return self.find(j, end, ";") + 1 if t == "do" else j
        return min(self.find(i, end, ";") + 1, end)

    def _local_function(self, i: int, end: int) -> int | None:
        """The bracket of the parameters of the local function that begins at i, if one does."""
        while self.text(i) in ("static", "async", "unsafe", "extern"):
            i += 1
        if i >= end or self.code[i].kind != "name" and self.text(i) != "(" or self.text(i) in _STATEMENTS or self.text(i) in _NO_TYPE:
            return None
        stop = self.find(i, end, "; { => =")
        if stop >= end or self.text(stop) not in ("{", "=>"):
            return None
        paren = self._parameters_at(i, stop)
        if paren >= stop or self.text(self.match.get(paren, paren) + 1) not in ("{", "=>", "where"):
            return None
        k = self._name_before(paren, i)
        typed = k > i and self.code[k].kind == "name" and self.text(k) not in KEYWORDS
        before = self.text(k - 1)
        return paren if typed and (before in (">", "]", "?", ")", "*") or self.code[k - 1].kind == "name" and before not in _NO_TYPE) else None

    def _name_before(self, paren: int, i: int) -> int:
        """The name in front of a bracket of parameters and its type parameters."""
        k, deep = paren - 1, 0
        if self.text(k) == ">":
            while k > i:
                deep += (self.text(k) == ">") - (self.text(k) == "<")
                k -= 1
                if not deep:
                    break
        return k

    def local_function(self, first: int, paren: int, end: int, parent: Node) -> None:
        """A function declared among statements: a symbol of the member around it, with a body of its own."""
        i = first
        while self.text(i) in ("static", "async", "unsafe", "extern"):
            i += 1
        k = self._name_before(paren, i)
        node = self.add("LocalFunctionStatement", first, end - 1, parent, k, type_text=self.source_of(i, k), modifiers=self.source_of(first, i) or None)
        self.type_names(i, k, node)
        self.parameters(paren, node)
        body = self.find(self.match.get(paren, paren) + 1, end, "{ => ;")
        if self.text(body) == "{":
            self.statements(body + 1, end - 1, self.add("Block", body, end - 1, node))
        elif self.text(body) == "=>":
            self.expression(body + 1, end - 1, node)

    def statements(self, i: int, end: int, parent: Node) -> None:
        while i < end:
            t, begin = self.text(i), i
            if t in (";", "}", ")"):
                i += 1
                continue
            j = max(i + 1, min(self.statement_end(i, end), end))
            if t == "await" and self.text(i + 1) in ("foreach", "using"):
                i, t = i + 1, self.text(i + 1)
            if t == "{":
                block = self.add("Block", i, j - 1, parent)
                self.statements(i + 1, j - 1, block)
            elif (paren := self._local_function(i, j)) is not None:
                self.local_function(i, paren, j, parent)
            elif t in _STATEMENTS and self.code[i].kind == "name":
                if t == "using" and self.text(i + 1) != "(":
                    self.local(i + 1, j, parent)
                elif t == "switch" or self.text(i + 1) == "(" and t not in ("return", "throw", "else", "try", "do"):
                    close = self.match.get(i + 1, i + 1)
                    node = self.add(_STATEMENTS[t], begin, j - 1, parent, args=[self.source_of(i + 2, close)])
                    self.expression(self.head(t, i + 2, close, node), close, node)
                    self.statements(close + 1, j, node)
                else:
                    node = self.add(_STATEMENTS[t], i, j - 1, parent, detail=self.source_of(i + 1, j - 1) if t in ("return", "throw") else None)
                    if t == "do":
                        stop = self.statement_end(i + 1, j)
                        node.args = [self.source_of(stop + 2, self.match.get(stop + 1, stop + 1))]
                        self.statements(i + 1, stop, node)
                        self.expression(stop + 1, j - 1, node)
                    elif t in ("else", "try", "catch"):
                        self.statements(i + 1, j, node)
                    else:
                        self.expression(i + 1, j - 1, node)
            elif t in ("case", "default") and self.find(i, end, ":") < end and t != "default" or t == "default" and self.text(i + 1) == ":":
                colon = self.find(i, end, ":")
                label = self.add("SwitchLabel", i, colon, parent, detail=self.source_of(i, colon + 1))
                self.expression(i + 1, colon, label)
                i = colon + 1
                continue
            elif t in ("finally", "unsafe", "checked", "unchecked"):
                self.statements(i + 1, j, self.add("FinallyClause", i, j - 1, parent) if t == "finally" else parent)
            else:
                self.local(begin, j, parent)
            i = j

    def head(self, t: str, i: int, close: int, node: Node) -> int:
        """The variables that a loop, using or catch declares; where its other expressions begin."""
        if t == "foreach":
            k = next((k for k in range(i, close) if self.text(k) == "in"), close)
            if k < close and k - 2 >= i and self.code[k - 1].kind == "name":
                self.add("LocalDeclarator", k - 1, k - 1, node, k - 1, type_text=self.source_of(i, k - 1), modifiers="foreach", target=self.root_of(k + 1, close))
                self.type_names(i, k - 1, node)
                return k + 1
        elif t in ("for", "using"):
            stop = self.find(i, close, ";")
            equals = self.find(i, stop, "= (")
            if self.text(equals) == "=" and equals - 2 >= i and equals < stop and all(self.code[k].kind == "name" for k in (equals - 1, equals - 2)):
                found = self.declarators(i, stop)
                for name, value, end in found:
                    given = self.source_of(value, end) or None
                    self.add("LocalDeclarator", name, end - 1, node, name, type_text=self.source_of(i, found[0][0]), detail=given, target=self.root_of(value, end))
                    self.expression(value, end, node)
                self.type_names(i, found[0][0], node)
                return stop
        elif t == "catch" and close - i == 2 and self.code[close - 1].kind == "name":
            self.add("LocalDeclarator", close - 1, close - 1, node, close - 1, type_text=self.text(i))
            self.type_names(i, close - 1, node)
            return close
        return i

    def local(self, i: int, j: int, parent: Node) -> None:
        """A declaration or an expression statement."""
        stop = self._parameters_at(i, self.find(i, j, "= ;"))
        if self.text(i) == "var" and self.text(i + 1) == "(" and self.text(self.match.get(i + 1, i) + 1) == "=":
            node = self.add("ExpressionStatement", i, j - 1, parent)
            for k in range(i + 2, self.match[i + 1]):
                if self.code[k].kind == "name" and self.text(k) != "_":
                    self.add("LocalDeclarator", k, k, node, k, type_text="var")
            self.expression(self.match[i + 1] + 2, j, node)
            return
        first = self.find(i, min(stop, j), ",")
        k = (first if first < stop and self.text(i) != "(" and "<" not in [self.text(x) for x in range(i, first)] else stop) - 1
        typed = k > i and self.code[k].kind == "name" and (self.code[k - 1].kind == "name" or self.text(k - 1) in (">", "]", "?", "*", ")"))
        typed = typed and all(self.code[x].kind == "name" or self.text(x) in _TYPE_MARKS for x in range(i, k))
        if typed and self.text(stop) in ("=", ";") and self.text(i) not in ("await", "yield", "goto", "new", "throw"):
            found = self.declarators(i, self.find(i, j, ";"))
            kind, node = self.source_of(i, found[0][0]), None
            for n, (name, value, stop) in enumerate(found):
                given = self.source_of(value, stop) or None
                if not n:
                    node = self.add("LocalDeclarationStatement", i, j - 1, parent, name, type_text=kind, detail=given, target=self.root_of(value, stop))
                    self.type_names(i, name, node)
                else:
                    self.add("LocalDeclarator", name, stop - 1, node, name, type_text=kind, detail=given, target=self.root_of(value, stop))
                self.expression(value, stop, self.nodes[-1] if n else node)
            return
        node = self.add("ExpressionStatement", i, j - 1, parent)
        self.expression(i, j, node)

    def expression(self, i: int, end: int, parent: Node) -> None:
        """Invocations, object creations, accesses, conversions, conditionals, literals and names, flat under ``parent``.

        Each has the place of the expression that it is applied to, so chains can be followed by joins.
        """
        while i < end:
            t = self.code[i]
            if t.text == "{" and i in self.match and parent.kind != "InitializerExpression":
                previous = self.text(i - 1)
                if previous in ("=>", ")", "delegate"):
                    block = self.add("Block", i, self.match[i], parent)
                    self.statements(i + 1, self.match[i], block)
                    i = self.match[i] + 1
                    continue
            if (past := self._declared_here(i, end, parent)) is not None:
                i = past
                continue
            if t.text == "await" and i + 1 < end and (self.code[i + 1].kind == "name" or self.text(i + 1) == "("):
                last = self.operand_end(i + 1, end) - 1
                self.add("AwaitExpression", i, last, parent, target=self.primary_at(last))
            elif t.text == "as" and t.kind == "name":
                stop = self._type_end(i + 1, end)
                self.add("CastExpression", i, stop - 1, parent, type_text=self.source_of(i + 1, stop))
            elif t.kind == "name" and t.text not in KEYWORDS:
                close = self._generic(i + 1, end)
                target = self.primary_at(i - 2) if self.text(i - 1) in (".", "?.") else None
                if self.text(close) == "(" and self.text(i - 1) != "new":
                    last = self.match.get(close, close)
                    args = self.source_of(close + 1, last)
                    self.add(
                        "InvocationExpression", i, last, parent, ident=t.text, receiver=self._receiver(i), detail=args,
                        args=self._listed(close + 1, last), target=target, arg_starts=self._argument_starts(close + 1, last),
                    )
                elif self.text(i - 1) == "new":
                    first = i
                    while self.text(close) == "." and close + 1 < end and self.code[close + 1].kind == "name":
                        self.add("IdentifierName", i, i, parent, ident=self.text(i), receiver=self._receiver(i))
                        i, t = close + 1, self.code[close + 1]
                        close = self._generic(i + 1, end)
                    last = self.match.get(close, close) if self.text(close) == "(" else close
                    args = self._listed(close + 1, last) if last > close else None
                    starts = self._argument_starts(close + 1, last) if last > close else None
                    made = self.source_of(first, max(i + 1, self._type_end(first, end)))
                    self.add("ObjectCreationExpression", i, last, parent, ident=t.text, receiver=self._receiver(i), args=args, type_text=made, arg_starts=starts)
                    self.nodes[-1].start = self.code[first - 1].start
                    target = None
                writes = self.text(i + 1) in _ASSIGN or self.text(i - 1) in ("++", "--", "out", "ref")
                reads = writes and self.text(i + 1) != "=" and self.text(i - 1) != "out"  # a write that reads, too
                self.add(
                    "IdentifierName", i, i, parent, ident=t.text, receiver=self._receiver(i), detail="write" if writes else None, target=target,
                    args=["read"] if reads else None,
                )
            elif t.text == "[" and i in self.match and self._is_access(i):
                self.add("ElementAccessExpression", i, self.match[i], parent, receiver="this" if self.text(i - 1) == "this" else None, target=self.primary_at(i - 1 - (self.text(i - 1) == "?")))
            elif t.text == "(" and self._is_cast(i, end):
                self.add("CastExpression", i, self.operand_end(i, end) - 1, parent, type_text=self.source_of(i + 1, self.match[i]))
                self.type_names(i + 1, self.match[i], parent)
                i = self.match[i]
            elif t.kind in ("string", "verbatim", "raw"):
                node = self.add("StringLiteralExpression", i, i, parent, detail=t.text)
                if "$" in t.text[:2]:
                    self._holes(t, node)
            elif t.kind == "number":
                self.add("NumericLiteralExpression", i, i, parent, detail=t.text)
            elif t.text == "?" and self._conditional(i, end):
                self.add("ConditionalExpression", i, i, parent)
            elif t.text in ("&&", "||", "??"):
                self.add("BinaryExpression", i, i, parent, detail=t.text)
            i += 1

    # Where expressions begin: each is known by the place of its own sign, which is the last name of a
    # chain, the bracket of an element access, or the word or bracket that converts, creates or awaits.

    def primary_at(self, e: int) -> int | None:
        """The place of the expression that ends with token e, if it is a name, a chain, a literal or one in brackets."""
        while e > 0 and self.text(e) == "!":
            e -= 1
        if e < 0 or e >= len(self.code):
            return None
        t = self.code[e]
        if t.kind == "name":
            return None if t.text in ("this", "base") else self._created(e) if self._created(e) is not None else t.start
        if t.kind != "mark":
            return t.start
        if e not in self.opening:
            return None
        o = self.opening[e]
        b = o - 1
        if t.text == "}" and self.text(b) == ")":
            b = self.opening.get(b, b) - 1
        if self.text(b) == ">":
            b = self._name_before(b + 1, 0)
        made = self._created(b) if b >= 0 and self.code[b].kind == "name" else None
        if made is not None:
            return made
        if t.text == "}":
            return None
        if t.text == "]":
            return self.code[o].start
        if b >= 0 and self.code[b].kind == "name" and self.text(b) not in _STATEMENTS:
            return None if self.text(b) in KEYWORDS else self.code[b].start
        return self.root_of(o + 1, e)

    def _created(self, b: int) -> int | None:
        """The place of ``new`` in front of a type's name that ends with token b."""
        while self.text(b - 1) == "." and b >= 2 and self.code[b - 2].kind == "name":
            b -= 2
        return self.code[b - 1].start if self.text(b - 1) == "new" else None

    def root_of(self, i: int, j: int) -> int | None:
        """The place of the one expression that the tokens from i to j are, if they are one."""
        if i >= j:
            return None
        if self.text(i) == "await":
            return self.code[i].start if self.operand_end(i + 1, j) == j else None
        if self.text(i) == "(" and self.match.get(i) == j - 1:
            return self.root_of(i + 1, j - 1)
        if self._is_cast(i, j):
            return self.code[i].start if self.operand_end(i, j) == j else None
        k = next((k for k in range(i, j) if self.text(k) == "as" and self.around[k] == self.around[i]), None)
        if k is not None:
            return self.code[k].start if self._type_end(k + 1, j) == j else None
        return self.primary_at(j - 1) if self.operand_end(i, j) == j else None

    def operand_end(self, i: int, end: int) -> int:
        """Past the chain of accesses and calls that begins at i."""
        if i >= end:
            return i
        if self._is_cast(i, end):
            return self.operand_end(self.match[i] + 1, end)
        if self.text(i) == "new":
            k = self._type_end(i + 1, end)
            if self.text(k) == "(" and k in self.match:
                k = self.match[k] + 1
            if self.text(k) == "{" and k in self.match:
                k = self.match[k] + 1
        elif self.text(i) == "(" and i in self.match:
            k = self.match[i] + 1
        elif self.code[i].kind != "mark":
            k = i + 1
        else:
            return i
        while k < end:
            t = self.text(k)
            if t in (".", "?.") and k + 1 < end and self.code[k + 1].kind == "name":
                k += 2
            elif t in ("(", "[") and k in self.match:
                k = self.match[k] + 1
            elif t == "<" and self._generic(k, end) > k:
                k = self._generic(k, end)
            elif t == "!" or t == "?" and self.text(k + 1) == "[":
                k += 1
            else:
                break
        return min(k, end)

    def _type_end(self, i: int, end: int) -> int:
        """Past the type that begins at i."""
        if self.text(i) == "(" and i in self.match:
            k = self.match[i] + 1
        else:
            k = i + 1
            while self.text(k) in (".", "::") and k + 1 < end:
                k += 2
        if self.text(k) == "<":
            deep, m = 0, k
            while m < end:
                deep += (self.text(m) == "<") - (self.text(m) == ">")
                m += 1
                if not deep:
                    k = m
                    break
        while k < end and (self.text(k) == "?" and self.text(k + 1) in ("", ")", ",", ";", "[") or self.text(k) == "[" and k in self.match):
            k = self.match[k] + 1 if self.text(k) == "[" else k + 1
        return min(k, end)

    def _is_cast(self, i: int, end: int) -> bool:
        """Whether a type in brackets begins at i that the expression behind it is converted to."""
        if self.text(i) != "(" or i not in self.match or i > 0 and (self.code[i - 1].kind == "name" and self.text(i - 1) not in _NO_TYPE or self.text(i - 1) in (")", "]", ">")):
            return False
        m = self.match[i]
        if m + 1 >= end or m == i + 1 or self._type_end(i + 1, m) != m or self.code[i + 1].kind != "name":
            return False
        behind = self.code[m + 1]
        if behind.kind == "mark":
            return behind.text in _VALUE_BEGINS and self.text(i + 1) in KEYWORDS and m == i + 2
        return behind.text not in ("as", "is", "switch", "and", "or", "when", "with", "in")

    def _is_access(self, i: int) -> bool:
        """Whether a square bracket takes an element of what stands before it."""
        i -= self.text(i - 1) == "?" and not self._conditional(i - 1, len(self.code))
        t = self.code[i - 1] if i > 0 else None
        if t is None or t.kind == "name" and t.text in KEYWORDS and t.text != "this":
            return False
        return t.kind == "name" and self._created(i - 1) is None or t.text in (")", "]")

    def _argument_starts(self, i: int, end: int) -> list[int]:
        out = []
        while i < end:
            j = self._value_end(i, end)
            begin = i + 2 if self.text(i + 1) == ":" and self.code[i].kind == "name" else i
            start = self.root_of(begin, j)
            out.append(-1 if start is None else start)
            i = j + 1
        return out

    def _declared_here(self, i: int, end: int, parent: Node) -> int | None:
        """Past a variable that an expression declares at i: parameters of a lambda, ``out`` and pattern variables."""
        t = self.code[i]
        if t.text == "async" and self.text(i + 1) != "." and (self.text(i + 2) == "=>" or self.text(self.match.get(i + 1, i) + 1) == "=>"):
            return i + 1
        arm = self.around[i] >= 0 and self.text(self.around[i]) == "{" and self.text(self.around[i] - 1) == "switch"
        if t.kind == "name" and self.text(i + 1) == "=>" and not arm and t.text not in KEYWORDS:
            self._lambda_parameter(i, i, i + 1, 0, i, parent)
            return i + 1
        if t.text == "(" and i in self.match and self.text(self.match[i] + 1) == "=>" and not arm:
            k, n = i + 1, 0
            while k < self.match[i]:
                j = self._comma(k, self.match[i])
                name = self.find(k, j, "=") - 1
                if self.code[name].kind == "name":
                    self._lambda_parameter(k, name, j, n, i, parent)
                k, n = j + 1, n + 1
            return self.match[i] + 1
        named = i > 0 and (self.text(i - 1) in ("out", "is") or arm and self.text(i - 1) in (",", "{"))
        if named and t.kind == "name" and t.text not in ("not", "null"):
            k = self._type_end(i, end)
            if k < end and self.code[k].kind == "name" and self.text(k) not in KEYWORDS and self.text(k) not in ("and", "or", "when", "_", "with"):
                self.type_names(i, k, parent)
                self.add("LocalDeclarator", k, k, parent, k, type_text=self.source_of(i, k))
                return k + 1
        return None

    def _lambda_parameter(self, first: int, name: int, end: int, n: int, at: int, parent: Node) -> None:
        """Parameter n of the lambda that begins at a token: its type is written, or asked of the call it is an argument of."""
        while self.text(first) in ("ref", "out", "in", "scoped", "params"):
            first += 1
        written = self.source_of(first, name) or None
        call, place, o = None, None, self.around[at]
        if written is None and o >= 0 and self.text(o) == "(":
            b = self._name_before(o, 0) if self.text(o - 1) == ">" else o - 1
            if b >= 0 and self.code[b].kind == "name" and self.text(b) not in KEYWORDS:
                call = self._created(b) if self._created(b) is not None else self.code[b].start
                k = o + 1
                place = 0
                while (j := self._value_end(k, at)) < at:
                    k, place = j + 1, place + 1
        elif written is None and parent.type_text and (m := re.match(r"(?:Func|Action|Predicate|Comparison)<(.*)>$", parent.type_text)):
            written = _type_arguments(m[1])[n : n + 1]
            written = written[0] if written else None
        self.type_names(first, name, parent)
        detail = f"{place}:{n}" if place is not None else None
        self.add("LambdaParameter", name, name, parent, name, type_text=written or "var", target=call, detail=detail)

    def _listed(self, i: int, end: int) -> list[str]:
        """Texts of the arguments between two brackets."""
        out = []
        while i < end:
            j = self._value_end(i, end)
            out.append(self.source_of(i, j))
            i = j + 1
        return out

    def _holes(self, t: Token, node: Node) -> None:
        """The expressions in an interpolated string."""
        i, text = t.text.index('"') + 1, t.text
        while i < len(text):
            if text[i] == "{" and text[i + 1 : i + 2] != "{":
                deep, j, stop = 1, i + 1, None
                while j < len(text) and deep:
                    deep += (text[j] in "{([") - (text[j] in "})]")
                    if deep == 1 and text[j] in ":," and stop is None and text[j : j + 2] != "::":
                        stop = j
                    j += 1
                inner = _Parser(text[i + 1 : j - 1 if stop is None else stop])
                inner.expression(0, len(inner.code), Node("", 0, depth=node.depth, number=-1))
                first = len(self.nodes)
                for n in inner.nodes:
                    n.start, n.end = n.start + t.start + i + 1, n.end + t.start + i + 1
                    n.parent, n.number = node.number if n.parent < 0 else n.parent + first, n.number + first
                    n.target = None if n.target is None else n.target + t.start + i + 1
                    n.arg_starts = n.arg_starts and [a if a < 0 else a + t.start + i + 1 for a in n.arg_starts]
                    self.nodes.append(n)
                i = j
            else:
                i += 2 if text[i : i + 2] == "{{" else 1

    def _generic(self, i: int, end: int) -> int:
        """Past type arguments that begin at i, if they are some."""
        if self.text(i) != "<":
            return i
        j, deep = i, 0
        while j < end:
            x = self.text(j)
            if x == "<":
                deep += 1
            elif x == ">":
                deep -= 1
                if not deep:
                    return j + 1 if self.text(j + 1) == "(" else i
            elif self.code[j].kind != "name" and x not in (",", ".", "?", "[", "]"):
                return i
            j += 1
        return i

    def _receiver(self, i: int) -> str | None:
        """What stands before the dot: names, or ? for any other expression."""
        j = i
        while self.text(j - 1) in (".", "?.") and j >= 2 and self.code[j - 2].kind == "name":
            j -= 2
        if self.text(j - 1) in (".", "?.") and j >= 1:
            return "?"
        return self.source_of(j, i - 1) if j < i else None

    def _conditional(self, i: int, end: int) -> bool:
        """Whether a question mark has its colon, so that it isn't part of a nullable type."""
        return self.find(i + 1, end, ":") < self.find(i + 1, end, "; , ?") or (
            self.find(i + 1, end, ":") < self.find(i + 1, end, "; ,") and self.find(i + 1, end, "?") < end
        )


def _type_arguments(text: str) -> list[str]:
    """The types between commas, outside of brackets."""
    out, deep, begin = [], 0, 0
    for i, c in enumerate(text):
        deep += (c in "<([") - (c in ">)]")
        if c == "," and not deep:
            out.append(text[begin:i].strip())
            begin = i + 1
    return [*out, text[begin:].strip()]


def parse(source: str) -> list[Node]:
    """Nodes of one file, the root first, parents before children."""
    return _Parser(source.removeprefix("\ufeff")).run()


def _chains(nodes: list[Node]) -> tuple[list[list[int]], list[list[str]]]:
    """For each node, root first: the declarations that it lies in, and the kinds of all its ancestors."""
    owners: list[list[int]] = []
    kinds: list[list[str]] = []
    declared: list[Node] = [n for n in nodes if n.kind in OWNERS]
    for n in nodes:
        if n.parent < 0:
            owners.append([])
            kinds.append([])
        elif n.parent == 0 and n.kind in ("Comment", "DocumentationComment", "Directive", "Error"):
            owners.append([d.number for d in declared if d.start <= n.start and n.end <= d.end])
            kinds.append([nodes[0].kind, *(nodes[d].kind for d in owners[-1])])
        else:
            up = nodes[n.parent]
            owners.append(owners[n.parent] + [n.parent] * (up.kind in OWNERS))
            kinds.append([*kinds[n.parent], up.kind])
    return owners, kinds


def _places(nodes: list[Node], owners: list[int]) -> tuple[int | None, int | None, str | None]:
    """Of the declarations around a node, outermost first: the nearest type and member, and the whole namespace."""
    near = lambda kinds: next((d for d in reversed(owners) if nodes[d].kind in kinds), None)
    spaces = [nodes[d].ident for d in owners if nodes[d].kind in _IN_SPACE]
    return near(_IN_TYPE), near(_IN_MEMBER), ".".join(x for x in spaces if x is not None) if spaces else None


def _locals_used(nodes: list[Node], members: list[int | None]) -> dict[int, int]:
    """The local or parameter that each name without a receiver means, by numbers; ``members`` are those around the nodes.

    Of several of a name in a member, the last one declared before the place; a function anywhere in the member.
    """
    declared: dict[tuple[int, str], list[Node]] = {}
    for n, member in zip(nodes, members, strict=True):
        if n.kind in LOCAL_KINDS and n.name_start is not None and n.ident is not None and member is not None:
            declared.setdefault((member, n.ident), []).append(n)
    used = {}
    for n, member in zip(nodes, members, strict=True):
        if n.kind == "IdentifierName" and n.receiver is None and (some := declared.get((member, n.ident))):
            near = [d for d in some if d.name_start <= n.start or d.kind == "LocalFunctionStatement"]
            if near:
                used[n.number] = max(near, key=lambda d: d.name_start).number
    return used


def node_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of :data:`NODE_SCHEMA` for frames of (doc_id, content), in frames of whole documents that end at :data:`FRAME_ROWS`."""
    columns = [c.strip().split(" ")[0] for c in NODE_SCHEMA.split(",")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"parent_id": "Int64", "name_start": "Int32", "target": "Int32", "in_type": "Int64", "in_member": "Int64", "local": "Int64"})

    for batch in batches:
        rows = []
        for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
            if content is None:
                continue
            text = content.removeprefix("\ufeff")
            starts = [0, *(m.end() for m in re.finditer("\n", text))]
            nodes = parse(text)
            places: dict[tuple[int, ...], tuple] = {}
            owned, above = _chains(nodes)
            for owners in owned:
                if (around := tuple(owners)) not in places:
                    places[around] = _places(nodes, owners)
            local = _locals_used(nodes, [places[tuple(owners)][1] for owners in owned])
            called = {n.start: n for n in nodes if n.kind == "InvocationExpression"}
            for n, owners, kinds in zip(nodes, owned, above, strict=True):
                a, b = (bisect.bisect_right(starts, x) - 1 for x in (n.start, n.end))
                call = called.get(n.start) if n.kind == "IdentifierName" else None
                rows.append(
                    (doc, n.number, n.parent if n.parent >= 0 else None, n.kind, n.start, n.end - n.start, a, n.start - starts[a],
                     b, n.end - starts[b], n.depth, n.ident, n.modifiers, n.type_text, n.detail, n.receiver, n.args, n.name_start,
                     n.target, n.arg_starts, owners, kinds, *places[tuple(owners)],
                     call and call.args, call and call.arg_starts, local.get(n.number))
                )
            if len(rows) >= FRAME_ROWS:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)


def syntax_nodes(documents: DataFrame) -> DataFrame:
    """Rows of :data:`NODE_SCHEMA` for ``documents`` (doc_id, content); null contents have none."""
    return documents.select(F.col("doc_id").cast("string"), "content").mapInPandas(node_frames, NODE_SCHEMA)
