"""The plan of a query, as the parser and the builder make it and the operators lower it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Lit:
    """kind: int, exact (Fraction), string, bool, nil, atom, date, naive, utc, regex, list."""

    value: Any
    kind: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class Dot:
    base: Any
    path: tuple[str, ...]


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class When:
    branches: tuple[tuple[Any, Any], ...]
    default: Any


@dataclass(frozen=True)
class Over:
    """frame: None for the whole partition, else two (side, n), side one of unbounded_preceding, preceding,
    current, following, unbounded_following."""

    call: Call
    partition: tuple = ()
    order: tuple = ()
    frame: tuple | None = None


@dataclass(frozen=True)
class Cmp:
    """op: = not= < > <= >= ~ in subset subset_eq superset superset_eq."""

    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    arg: Any


@dataclass(frozen=True)
class Variant:
    """What a grammar extension contributed; lowering needs the extension to have replaced it."""

    tag: str
    value: Any = None


@dataclass(frozen=True)
class Scoped:
    """An expression over the rows of a group for which the predicate holds."""

    where: Any
    expr: Any


@dataclass(frozen=True)
class Item:
    """A body item: ``alias`` names the output; ``when_param`` leaves it out unless the parameter is true."""

    alias: str
    expr: Any
    where: Any = None
    when_param: str | None = None
    plain: bool = False


@dataclass(frozen=True)
class Spread:
    name: str


@dataclass(frozen=True)
class Order:
    expr: Any
    desc: bool = False


@dataclass(frozen=True)
class Query:
    source: tuple[str, ...]
    select: tuple = ()
    wheres: tuple = ()
    group_by: tuple[tuple[str, ...], ...] = ()
    grouping: str = "plain"
    havings: tuple = ()
    distinct: bool = False
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    required: bool = False
    goal_args: tuple | None = None
    time_field: tuple[str, ...] | None = None
    variant: Any = None
    withs: dict = field(default_factory=dict, hash=False)
    types: dict = field(default_factory=dict, hash=False)

    def but(self, **changes) -> Query:
        return replace(self, **changes)

    @property
    def name(self) -> str:
        return self.source[-1]


@dataclass(frozen=True)
class Combined:
    """op: union, union_all, intersect, except."""

    op: str
    left: Any
    right: Any
    withs: dict = field(default_factory=dict, hash=False)
    types: dict = field(default_factory=dict, hash=False)

    def but(self, **changes) -> Combined:
        return replace(self, **changes)


@dataclass(frozen=True)
class Recursive:
    query: Any


# Type expressions of TYPE declarations.
@dataclass(frozen=True)
class Named:
    name: str
    param: Any = None


@dataclass(frozen=True)
class Nullable:
    base: Any


@dataclass(frozen=True)
class Union:
    members: tuple


@dataclass(frozen=True)
class Shape:
    fields: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class ListOf:
    inner: Any


@dataclass(frozen=True)
class TypeDecl:
    name: str
    kind: str | None
    fields: dict = field(hash=False)


def children(node):
    """The expressions and predicates right below a node."""
    match node:
        case Call(_, args, _):
            return list(args)
        case Dot(base, _):
            return [base]
        case Arith(_, a, b) | Cmp(_, a, b) | And(a, b) | Or(a, b) | Scoped(a, b):
            return [a, b]
        case Unary(_, a) | Not(a):
            return [a]
        case When(branches, default):
            return [x for b in branches for x in b] + [default]
        case Over(call, partition, order, _):
            return [call, *partition, *(o.expr for o in order)]
        case Lit(value, "list"):
            return list(value)
    return []


def rebuilt(node, f):
    """The node with f applied to each expression and predicate right below it."""
    match node:
        case Call(name, args, distinct):
            return Call(name, tuple(map(f, args)), distinct)
        case Dot(base, path):
            return Dot(f(base), path)
        case Arith(op, a, b):
            return Arith(op, f(a), f(b))
        case Cmp(op, a, b):
            return Cmp(op, f(a), f(b))
        case And(a, b):
            return And(f(a), f(b))
        case Or(a, b):
            return Or(f(a), f(b))
        case Scoped(a, b):
            return Scoped(f(a), f(b))
        case Unary(op, a):
            return Unary(op, f(a))
        case Not(a):
            return Not(f(a))
        case When(branches, default):
            return When(tuple((f(c), f(e)) for c, e in branches), f(default))
        case Lit(value, "list"):
            return Lit(tuple(map(f, value)), "list")
    return node
