"""The rule language: text to typed atoms and back, on the driver (rules are few next to facts).

    head(X,Y) <= body1(X,A), body2(A,Y)

Single capitals and `me_myself_i` are variables; anything else is a constant, which may hold commas
and brackets. A body is brought to a path from the head's variable: relations in walking order, marked
where they are walked backwards, ending in the other variable (binary), a constant, anything (exists)
or where it began (loop). `&&` joins several bodies that must all hold.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass

SELF = "me_myself_i"
INVERSE = "INVERSE_"


@dataclass(frozen=True)
class Step:
    relation: str
    inverse: bool = False

    def __str__(self) -> str:
        return (INVERSE if self.inverse else "") + self.relation

    def back(self) -> Step:
        return Step(self.relation, not self.inverse)


@dataclass(frozen=True)
class Atom:
    """kind: binary, const, exists or loop; constant only for const."""

    path: tuple[Step, ...]
    kind: str
    constant: str | None = None

    def __str__(self) -> str:
        end = {"binary": "", "const": f"({self.constant})", "exists": "(*)", "loop": "(X)"}[self.kind]
        return "*".join(map(str, self.path)) + end


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]  # more than one: all must hold

    def __str__(self) -> str:
        return f"{self.head} <= {'&&'.join(map(str, self.body))}"

    @property
    def kind(self) -> str:
        if self.head.kind == "binary":
            return "B"
        if not self.body:
            return "Z"
        return "Ud" if any(a.kind == "exists" for a in self.body) else "Uc"


def is_variable(name: str) -> bool:
    return re.fullmatch("[A-Z]", name) is not None or name == SELF


def split_atoms(text: str) -> list[str]:
    """Atoms of a conjunction: commas outside of brackets part them."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:k])
            start = k + 1
    return [a.strip() for a in [*out, text[start:]] if a.strip()]


def arguments(text: str) -> tuple[str, str]:
    """Two arguments, of which constants may hold commas: a variable at one end tells where the other begins."""
    parts = text.split(",")
    if len(parts) == 2:
        return parts[0].strip(), parts[1].strip()
    if is_variable(parts[0].strip()):
        return parts[0].strip(), ",".join(parts[1:]).strip()
    if is_variable(parts[-1].strip()):
        return ",".join(parts[:-1]).strip(), parts[-1].strip()
    raise ValueError(f"can't tell the arguments of {text!r} apart")


def parse_atom(text: str) -> tuple[str, str, str]:
    name, _, rest = text.strip().partition("(")
    if not rest.endswith(")"):
        raise ValueError(f"not an atom: {text!r}")
    a, b = arguments(rest[:-1])
    if SELF in (a, b):
        other = b if a == SELF else a
        return name.strip(), other, other
    return name.strip(), a, b


def route(atoms: list[tuple[str, str, str]], start: str, goal: str) -> Atom:
    """The shortest path of a body from start to goal, breadth first; atoms off the path don't count."""
    ways: deque[tuple[str, tuple[int, ...]]] = deque([(start, ())])
    seen = {start}
    while ways:
        at, used = ways.popleft()
        for k, (_, a, b) in enumerate(atoms):
            if k not in used and at in (a, b):
                to = b if at == a else a
                if to == goal:
                    return Atom(steps(atoms, [*used, k], start), "binary")
                if to not in seen and is_variable(to):
                    seen.add(to)
                    ways.append((to, (*used, k)))
    raise ValueError(f"the body doesn't lead from {start} to {goal}")


def steps(atoms: list[tuple[str, str, str]], order: list[int], start: str) -> tuple[Step, ...]:
    path, at = [], start
    for k in order:
        name, a, b = atoms[k]
        path.append(Step(name, inverse=a != at))
        at = b if a == at else a
    return tuple(path)


def walk(atoms: list[tuple[str, str, str]], start: str) -> Atom:
    """The path of a body that goes through all its atoms from start: to a constant, a loose end, or back to where it began."""

    def follow(at: str, used: list[int]) -> tuple[list[int], str] | None:
        if len(used) == len(atoms):
            return used, at
        for k, (_, a, b) in enumerate(atoms):
            if k not in used and at in (a, b) and (found := follow(b if a == at else a, [*used, k])):
                return found
        return None

    found = follow(start, [])
    if not found:
        raise ValueError(f"the body isn't one path from {start}")
    order, at = found
    path = steps(atoms, order, start)
    if at == start:
        return Atom(path, "loop")
    return Atom(path, "exists") if is_variable(at) else Atom(path, "const", at)


def parse_rule(text: str) -> Rule:
    head_text, _, body_text = text.partition("<=")
    name, a, b = parse_atom(head_text)
    if a == b and is_variable(a):
        head, start, goal = Atom((Step(name),), "loop"), a, None
    elif is_variable(a) and is_variable(b):
        head, start, goal = Atom((Step(name),), "binary"), a, b
    elif is_variable(a):
        head, start, goal = Atom((Step(name),), "const", b), a, None
    elif is_variable(b):
        head, start, goal = Atom((Step(name, True),), "const", a), b, None
    else:
        raise ValueError(f"a head needs a variable: {text!r}")
    bodies = [split_atoms(part) for part in body_text.split("&&")]
    parsed = [[parse_atom(x) for x in atoms] for atoms in bodies if atoms]
    return Rule(head, tuple(walk(x, start) if goal is None else route(x, start, goal) for x in parsed))


def canonical(text: str) -> str:
    """One form for all rules that differ in the names of their variables, blanks, and the order of bodies that must all hold."""
    rule = parse_rule(text)
    return f"{rule.head} <= {'&&'.join(sorted(map(str, rule.body)))}"


def chosen_rules(texts: list[str], relation: str | None = None, normal: bool = False, most_steps: int | None = None, kinds: tuple[str, ...] = ()) -> list[str]:
    """The rules of a head relation; without complex bodies; of so many steps at most; of some kinds (B, Ud, Uc, Z)."""
    out = []
    for text in texts:
        rule = parse_rule(text)
        if relation is not None and rule.head.path[0].relation != relation or normal and len(rule.body) > 1 or kinds and rule.kind not in kinds:
            continue
        if most_steps is None or max((len(a.path) for a in rule.body), default=0) <= most_steps:
            out.append(text)
    return out


def inverse_path(path: tuple[Step, ...]) -> tuple[Step, ...]:
    return tuple(s.back() for s in reversed(path))


def write_atom(atom: Atom, start: str = "X", goal: str = "Y") -> str:
    """Back to atoms with variables A, B, C, ... between."""
    names = [start, *(chr(65 + k) for k in range(len(atom.path) - 1))]
    names.append({"binary": goal, "const": atom.constant, "exists": chr(64 + len(atom.path)), "loop": start}[atom.kind])
    return ", ".join(f"{s.relation}({b},{a})" if s.inverse else f"{s.relation}({a},{b})" for s, a, b in zip(atom.path, names, names[1:]))


def write_rule(rule: Rule) -> str:
    return f"{write_atom(rule.head)} <= {' && '.join(map(write_atom, rule.body))}".rstrip()


def simplify_atom(text: str) -> Atom:
    """From the short form: r1*INVERSE_r2, with (c), (*) or (X) behind."""
    path_text, _, end = text.partition("(")
    path = tuple(Step(p.removeprefix(INVERSE), p.startswith(INVERSE)) for p in path_text.split("*"))
    if not end:
        return Atom(path, "binary")
    end = end[:-1]
    return Atom(path, "exists") if end == "*" else Atom(path, "loop") if end == "X" else Atom(path, "const", end)


def length_class(rule: Rule) -> str:
    return f"L{max((len(a.path) for a in rule.body), default=0)}"


def category(rule: Rule) -> str:
    return ("binary" if rule.kind == "B" else "unary") + ("_complex" if len(rule.body) > 1 else "_normal")
