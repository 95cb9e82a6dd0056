"""Control flow and data flow of members.

The statements of a member become units, and straight runs of units basic blocks; edges say where
control goes next. Over the blocks two problems are solved to a fixpoint with bit sets: which variables
are live, that is read later before they are written, and which definitions reach a place. A member is
one small problem, so members are spread over tasks and each is solved in its own.

The flow is followed without deciding conditions, other than the words ``true`` and ``false``. Any
statement of a ``try`` may throw. What a lambda or a function among statements writes may or may not
be written, and what it reads counts as read where it stands.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.sources.csharp import Node, parse

ENTRY, EXIT = -1, -2
#: Statements that are a unit of their own, with the expressions below them.
SIMPLE = ("ExpressionStatement", "LocalDeclarationStatement", "LocalFunctionStatement")
LOOPS = ("WhileStatement", "ForStatement", "ForEachStatement")
JUMPS = ("ReturnStatement", "ThrowStatement", "BreakStatement", "ContinueStatement")
_INLINE = ("Block", "ElseClause", "FinallyClause")
STATEMENTS = (*SIMPLE, *LOOPS, *JUMPS, *_INLINE, "IfStatement", "DoStatement", "SwitchStatement", "SwitchLabel", "TryStatement", "CatchClause", "UsingStatement", "LockStatement")
_DECLARES = ("LocalDeclarationStatement", "LocalDeclarator", "Parameter", "LambdaParameter")


@dataclass
class Unit:
    node: Node
    next: set[int] = field(default_factory=set)
    reads: int = 0
    writes: int = 0  # surely written
    may: int = 0  # perhaps written
    declared: int = 0  # of no value before
    block: int = -1
    place: int = 0  # in its block
    reachable: bool = False
    live_in: int = 0
    live_out: int = 0
    reaching: list[int] = field(default_factory=list)


@dataclass
class Flow:
    """Units by the number of their statement, those that run first, and the declaration that each bit stands for."""

    units: dict[int, Unit]
    first: set[int]
    symbols: list[Node]

    def names(self, bits: int) -> list[str]:
        return [self.symbols[i].ident for i in members(bits)]

    def leads(self, u: Unit) -> list[int]:
        """The blocks that control goes to from a unit, other than on to the next one of its block; -1 is the end."""
        to = (self.units[x] if x >= 0 else None for x in u.next)
        return sorted({-1 if v is None else v.block for v in to if v is None or v.block != u.block or v.place != u.place + 1})


def members(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


class _Builder:
    """Units and edges of one member, statement by statement."""

    def __init__(self, below: dict[int, list[Node]]):
        self.below = below
        self.units: dict[int, Unit] = {}
        self.loops: list[tuple[set[int], set[int]]] = []  # where break and continue come from

    def unit(self, n: Node, before: Iterable[int]) -> int:
        self.units.setdefault(n.number, Unit(n))
        self.link(before, n.number)
        return n.number

    def link(self, before: Iterable[int], to: int) -> None:
        for b in before:
            if b != ENTRY:
                self.units[b].next.add(to)
            else:
                self.first.add(to)

    def statements(self, n: Node) -> list[Node]:
        return [c for c in self.below.get(n.number, ()) if c.kind in STATEMENTS]

    def body(self, n: Node) -> list[Node]:
        """The statement that a head is followed by; blocks before it belong to lambdas in the head."""
        return self.statements(n)[-1:]

    def run(self, roots: list[Node]) -> dict[int, Unit]:
        self.first: set[int] = set()
        for root in roots:
            self.link(self.sequence(self.statements(root), {ENTRY}), EXIT)
        return self.units

    def sequence(self, statements: list[Node], before: set[int]) -> set[int]:
        """Where control is behind some statements in a row."""
        k = 0
        while k < len(statements):
            n, k = statements[k], k + 1
            follow = statements[k] if k < len(statements) else None
            if n.kind in _INLINE:
                before = self.sequence(self.statements(n), before)
            elif n.kind == "IfStatement":
                head = self.unit(n, before)
                yes, no = self.ways(n)
                then = self.sequence(self.body(n), {head} if yes else set())
                if follow is not None and follow.kind == "ElseClause":
                    k += 1
                    before = then | self.sequence(self.statements(follow), {head} if no else set())
                else:
                    before = then | ({head} if no else set())
            elif n.kind in LOOPS:
                head = self.unit(n, before)
                yes, no = self.ways(n)
                behind, breaks = self.loop(self.body(n), {head} if yes else set())
                self.link(behind, head)
                before = breaks | ({head} if no else set())
            elif n.kind == "DoStatement":
                self.units[n.number] = Unit(n)
                start = len(self.units)
                entry = self.first if ENTRY in before else set()
                was = {b: set(self.units[b].next) for b in before if b != ENTRY} | ({ENTRY: set(entry)} if ENTRY in before else {})
                behind, breaks = self.loop(self.statements(n), before)
                begin = {x for b in before for x in (self.first if b == ENTRY else self.units[b].next) - was[b]} if len(self.units) > start else {n.number}
                self.link(behind, n.number)
                yes, no = self.ways(n)
                if yes:
                    self.units[n.number].next |= begin
                before = breaks | ({n.number} if no else set())
            elif n.kind == "SwitchStatement":
                before = self.switch(n, before)
            elif n.kind == "TryStatement":
                known = set(self.units)
                after = self.sequence(self.statements(n), before)
                throws = (set(self.units) - known) | before
                while follow is not None and follow.kind == "CatchClause":
                    k += 1
                    after |= self.sequence(self.statements(follow), {self.unit(follow, throws)})
                    follow = statements[k] if k < len(statements) else None
                if follow is not None and follow.kind == "FinallyClause":
                    k += 1
                    ended = self.sequence(self.statements(follow), after | throws | (set(self.units) - known))
                    self.link(ended, EXIT)
                    after = ended if after else set()
                before = after
            elif n.kind in ("UsingStatement", "LockStatement", "CatchClause"):
                before = self.sequence(self.statements(n), {self.unit(n, before)})
            elif n.kind in ("ReturnStatement", "ThrowStatement"):
                self.link({self.unit(n, before)}, EXIT)
                before = set()
            elif n.kind in ("BreakStatement", "ContinueStatement"):
                at = self.unit(n, before)
                if self.loops:
                    self.loops[-1][n.kind == "ContinueStatement"].add(at)
                before = set()
            elif n.kind != "SwitchLabel":
                before = {self.unit(n, before)}
        return before

    def ways(self, n: Node) -> tuple[bool, bool]:
        """Whether control can go into a body, and past it."""
        head = (n.args or [""])[0].strip()
        if n.kind == "ForStatement":
            parts = head.split(";")
            head = parts[1].strip() if len(parts) == 3 else "?"
            head = head or "true"
        return head != "false", head != "true"

    def loop(self, body: list[Node], before: set[int]) -> tuple[set[int], set[int]]:
        """Where control is behind a body that runs again, and where it breaks off."""
        self.loops.append((set(), set()))
        behind = self.sequence(body, before)
        breaks, continues = self.loops.pop()
        return behind | continues, breaks

    def switch(self, n: Node, before: set[int]) -> set[int]:
        head = self.unit(n, before)
        self.loops.append((set(), self.loops[-1][1] if self.loops else set()))
        parts, complete, behind, part = self.statements(n)[-1:], False, set(), []
        parts = self.statements(parts[0]) if parts and parts[0].kind == "Block" else parts
        for c in [*parts, None]:
            if c is None or c.kind == "SwitchLabel":
                behind = self.sequence(part, behind) if part else behind
                part = []
                if c is not None:
                    behind = behind | {head}
                    complete |= (c.detail or "").startswith("default")
            else:
                part.append(c)
        breaks, _ = self.loops.pop()
        return breaks | behind | (set() if complete else {head})


def member_flow(nodes: list[Node], owner: Node) -> Flow:
    """The flow of one member, from its nodes in order; numbers of nodes need not begin at zero."""
    by_number = {n.number: n for n in nodes}
    below: dict[int, list[Node]] = defaultdict(list)
    for n in nodes:
        if n is not owner:
            below[n.parent].append(n)
    accessors = [n for n in nodes if n.kind == "AccessorDeclaration" and n.parent == owner.number]
    builder = _Builder(below)
    units = builder.run(accessors or [owner])
    symbols = [n for n in nodes if n.kind in _DECLARES and n.name_start is not None]
    declared: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, s in enumerate(symbols):
        declared[s.ident].append((s.name_start, i))

    def unit_of(n: Node) -> tuple[Unit | None, bool]:
        """The unit that a node belongs to, and whether it runs whenever the unit does."""
        sure, m = True, n
        while m is not None and m.number not in units:
            sure &= m.kind not in ("Block", "LocalFunctionStatement")
            m = by_number.get(m.parent) if m is not owner else None
        if m is not None and m.kind == "LocalFunctionStatement":
            sure = False
        return (units[m.number] if m is not None else None), sure

    for i, s in enumerate(symbols):
        u, sure = unit_of(s)
        if u is None or s.kind in ("Parameter", "LambdaParameter"):
            continue
        # A declaration without a value only makes the variable; a loop's, a catch's or a pattern's always gives it one.
        plain = u.node.kind == "LocalDeclarationStatement" and sure
        if u.node.kind == "ForStatement" or not sure:
            u.may |= 1 << i
        else:
            u.declared |= 1 << i
            u.writes |= 0 if plain and s.detail is None else 1 << i
    for n in nodes:
        if n.kind != "IdentifierName" or n.receiver is not None or n.ident not in declared:
            continue
        found = [i for at, i in declared[n.ident] if at <= n.start]
        u, sure = unit_of(n)
        if not found or u is None or symbols[found[-1]].kind == "LambdaParameter":
            continue
        bit = 1 << found[-1]
        if (n.detail != "write" or n.args) and not u.declared & bit:
            u.reads |= bit
        if n.detail == "write":
            # A loop's head holds its first value, its test and its step, of which no one runs each time.
            if sure and u.node.kind != "ForStatement":
                u.writes |= bit
            else:
                u.may |= bit
    flow = Flow(units, builder.first, symbols)
    _solve(flow)
    return flow


def _solve(flow: Flow) -> None:
    """Blocks, reachability, live variables and reaching definitions."""
    units, first = flow.units, flow.first
    before: dict[int, set[int]] = defaultdict(set)
    for k, u in units.items():
        for x in u.next:
            before[x].add(k)
    # Blocks: a unit goes on a block if it alone follows the unit that alone comes before it.
    order = sorted(units, key=lambda k: units[k].node.start)
    blocks: list[list[int]] = []
    for k in order:
        if units[k].block >= 0:
            continue
        at = k
        while len(before[at]) == 1 and at not in first:
            (b,) = before[at]
            if units[b].next != {at} or units[b].block >= 0 or b == k:
                break
            at = b
        run = []
        while at >= 0 and units[at].block < 0:
            units[at].block, units[at].place = len(blocks), len(run)
            run.append(at)
            following = units[at].next
            if len(following) != 1:
                break
            (at,) = following
            if at < 0 or len(before[at]) != 1 or at in first:
                break
        blocks.append(run)
    reached, todo = set(), [x for x in first if x >= 0]
    while todo:
        k = todo.pop()
        if k not in reached:
            reached.add(k)
            units[k].reachable = True
            todo.extend(x for x in units[k].next if x >= 0)
    # Backwards: what a block reads before it writes, and what it surely writes.
    # What is declared further on has no value yet, not even from a loop's last turn.
    gone = {k: u.writes | u.declared for k, u in units.items()}
    for i, s in enumerate(flow.symbols):
        for k, u in units.items():
            if s.name_start > u.node.end:
                gone[k] |= 1 << i
    needs, kills = [0] * len(blocks), [0] * len(blocks)
    for b, run in enumerate(blocks):
        for k in reversed(run):
            needs[b] = units[k].reads | (needs[b] & ~gone[k])
            kills[b] |= gone[k]
    after = [{units[x].block for x in units[run[-1]].next if x >= 0} for run in blocks]
    ahead: list[set[int]] = [set() for _ in blocks]
    for b, following in enumerate(after):
        for x in following:
            ahead[x].add(b)
    live = list(needs)
    work = list(range(len(blocks)))
    while work:
        b = work.pop()
        out = 0
        for x in after[b]:
            out |= live[x]
        new = needs[b] | (out & ~kills[b])
        if new != live[b]:
            live[b] = new
            work.extend(ahead[b])
    for b, run in enumerate(blocks):
        out = 0
        for x in after[b]:
            out |= live[x]
        for k in reversed(run):
            units[k].live_out = out
            out = units[k].reads | (out & ~gone[k])
            units[k].live_in = out
    # Forwards: a definition is a unit that writes a variable.
    definitions = [(k, i) for k in order for i in members(units[k].writes | units[k].may)]
    of_symbol: dict[int, int] = defaultdict(int)
    made: dict[int, int] = defaultdict(int)
    for d, (k, i) in enumerate(definitions):
        of_symbol[i] |= 1 << d
        made[k] |= 1 << d

    def through(k: int, bits: int) -> int:
        for i in members(units[k].writes):
            bits &= ~of_symbol[i]
        return bits | made[k]

    reach = [0] * len(blocks)
    work = list(range(len(blocks)))
    while work:
        b = work.pop()
        bits = reach[b]
        for k in blocks[b]:
            bits = through(k, bits)
        for x in after[b]:
            if reach[x] | bits != reach[x]:
                reach[x] |= bits
                work.append(x)
    for b, run in enumerate(blocks):
        bits = reach[b]
        for k in run:
            units[k].reaching = [definitions[d][0] for d in members(bits) if units[k].reads >> definitions[d][1] & 1]
            bits = through(k, bits)


UNITS = (
    "doc_id string, member_node long, node_id long, kind string, start int, length int, block int, place int, reachable boolean, next array<long>, "
    "reads array<long>, writes array<long>, live_in array<long>, live_out array<long>, reaching array<long>, leads array<int>"
)
#: Declarations that hold statements.
BODIES = (
    "MethodDeclaration", "ConstructorDeclaration", "DestructorDeclaration", "OperatorDeclaration", "PropertyDeclaration", "IndexerDeclaration",
    "FieldDeclaration", "FieldDeclarator", "EventDeclaration",
)


def by_member(nodes: list[Node]) -> Iterator[tuple[Node, list[Node]]]:
    """Each declaration of a file that holds statements, with the nodes that it is the nearest one around."""
    of: list[int] = []
    inside: dict[int, list[Node]] = defaultdict(list)
    for n in nodes:
        of.append(n.number if n.kind in BODIES else of[n.parent] if n.parent >= 0 else -1)
        if of[-1] >= 0:
            inside[of[-1]].append(n)
    for number, its in inside.items():
        yield nodes[number], its


def units(documents: DataFrame, texts: bool = False) -> DataFrame:
    """Rows of ``UNITS``: the statements of each member of documents (doc_id, content) with their flow.

    ``next`` are the statements that may follow, -2 for the end of the member; variables are the nodes
    that declare them; ``reaching`` are the statements whose values what this one reads may have;
    ``leads`` are the blocks that control goes to from the last statement of a block, -1 for the end.
    With ``texts``, ``text`` is what stands at each statement. A document is parsed and solved by one
    task, member by member, so nothing is shuffled; null contents and members without statements have
    no rows. Documents in few partitions are worth spreading first (:func:`factlake.storage.spread`).
    """
    schema = f"{UNITS}, text string" if texts else UNITS
    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                if content is None:
                    continue
                for owner, nodes in by_member(parse(content)):
                    flow = member_flow(nodes, owner)
                    ids = lambda bits, flow=flow: [flow.symbols[i].number for i in members(bits)]
                    rows += [
                        (doc, owner.number, k, u.node.kind, u.node.start, u.node.end - u.node.start, u.block, u.place, u.reachable, sorted(u.next), ids(u.reads),
                         ids(u.writes | u.may), ids(u.live_in), ids(u.live_out), sorted(u.reaching), flow.leads(u))
                        + ((content[u.node.start : u.node.end],) if texts else ())
                        for k, u in flow.units.items()
                    ]
            yield pd.DataFrame(rows, columns=columns)

    return documents.select(F.col("doc_id").cast("string"), "content").mapInPandas(run, schema)


def edges(units_: DataFrame) -> DataFrame:
    """``(doc_id, member_node, src, dst)`` of the control flow between blocks; dst is -1 for the end.

    Only the last unit of a block leads to blocks, and to each once, so rows are distinct as they are.
    """
    return units_.select("doc_id", "member_node", F.col("block").alias("src"), F.explode("leads").alias("dst"))
