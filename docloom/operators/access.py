"""Roles and permissions as data: implication and the closure over parents."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPES = {"own": 0, "group": 1, "organization": 2}
ACTIONS = {"*": None, "admin": None, "write": ("write", "create", "update", "delete")}
RESOURCES = ("*", "entity", "collection", "user", "role", "system", "backup", "migration", "transaction", "index")


@dataclass(frozen=True)
class Permission:
    resource: str
    action: str
    scope: str | None = None

    @classmethod
    def parse(cls, text: str) -> Permission:
        parts = text.split(":")
        if not 2 <= len(parts) <= 3 or not all(parts):
            raise ValueError(f"not a permission: {text!r}")
        return cls(*parts)

    def __str__(self) -> str:
        return ":".join(filter(None, (self.resource, self.action, self.scope)))

    def implies(self, other: Permission) -> bool:
        allowed = ACTIONS.get(self.action, (self.action,))
        wide = self.scope is None or (other.scope is not None and SCOPES.get(self.scope, 0) >= SCOPES.get(other.scope, 0))
        return self.resource in ("*", other.resource) and (allowed is None or other.action in allowed) and wide


class PermissionSet(frozenset):
    def __or__(self, other: Iterable[Permission]) -> PermissionSet:
        return PermissionSet(frozenset(self) | frozenset(other))

    def __and__(self, other: Iterable[Permission]) -> PermissionSet:
        """What both grant: the permissions of either that the other implies."""
        other = PermissionSet(other)
        return PermissionSet({p for p in self if other.grants(p)} | {p for p in other if self.grants(p)})

    def __sub__(self, other: Iterable[Permission]) -> PermissionSet:
        return PermissionSet(frozenset(self) - frozenset(other))

    union, intersection, difference = __or__, __and__, __sub__

    def grants(self, p: Permission) -> bool:
        return any(q.implies(p) for q in self)

    def grants_all(self, ps: Iterable[Permission]) -> bool:
        return all(map(self.grants, ps))

    def grants_any(self, ps: Iterable[Permission]) -> bool:
        return any(map(self.grants, ps))


def seed_roles() -> list[tuple]:
    """(name, permissions, parents, system, active, priority)."""
    return [
        ("super_admin", ["*:*"], [], True, True, 100),
        ("admin", ["entity:*", "collection:*", "user:*", "backup:*"], ["user"], True, True, 80),
        ("transaction_manager", ["transaction:*"], ["user"], True, True, 60),
        ("user", ["entity:write", "entity:read"], ["guest"], True, True, 40),
        ("guest", ["entity:read", "collection:read"], [], True, True, 10),
    ]


ROLE_SCHEMA = "name string, permissions array<string>, parents array<string>, system boolean, active boolean, priority int"


def closure(roles: DataFrame) -> DataFrame:
    """(role, reaches): every active role and all active roles it inherits
    from, itself included. Breadth first; pairs already known end a cycle.
    There are as many rounds as the hierarchy is deep."""
    live = roles.filter("active").select("name", "parents")
    edges = live.select("name", F.explode("parents").alias("parent"))
    edges = edges.join(live.select(F.col("name").alias("parent")), "parent", "left_semi").distinct()
    rounds: list[DataFrame] = []
    known = front = live.select(F.col("name").alias("role"), F.col("name").alias("reaches"))
    while True:
        step = front.join(edges, front["reaches"] == edges["name"]).select("role", F.col("parent").alias("reaches"))
        new = step.distinct().join(known, ["role", "reaches"], "left_anti").persist()
        rounds.append(new)
        if new.isEmpty():
            break
        known, front = known.unionByName(new), new
    # the pairs of a role hierarchy are few: kept as rows, so that rounds can go
    pairs = known.toArrow()
    for r in rounds:
        r.unpersist()
    return roles.sparkSession.createDataFrame(pairs)


def effective(roles: DataFrame) -> DataFrame:
    """(role, permission) with all that is inherited."""
    own = roles.filter("active").select(F.col("name").alias("reaches"), F.explode("permissions").alias("permission"))
    return closure(roles).join(own, "reaches").select("role", "permission").distinct()


def implied(granted: Column, asked: Column) -> Column:
    """:meth:`Permission.implies` on columns of ``resource:action[:scope]``."""
    g, a = F.split(granted, ":"), F.split(asked, ":")
    part = lambda x, i: F.try_element_at(x, F.lit(i))
    resource = part(g, 1).isin("*") | (part(g, 1) == part(a, 1))
    action = F.lit(False)
    for name, allowed in ACTIONS.items():
        action = action | ((part(g, 2) == name) & (F.lit(True) if allowed is None else part(a, 2).isin(*allowed)))
    action = action | (part(g, 2) == part(a, 2)) & ~part(g, 2).isin(*[n for n, v in ACTIONS.items() if v is not None])
    level = lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in SCOPES.items() for v in kv]), part(x, 3)), F.lit(0))
    scope = part(g, 3).isNull() | (part(a, 3).isNotNull() & (level(g) >= level(a)))
    return F.coalesce(resource & action & scope, F.lit(False))


def checked(users: DataFrame, roles: DataFrame, asked: DataFrame) -> DataFrame:
    """(user, permission, granted) for every request (user, permission) in
    ``asked``. ``users``: (user, role) assignments. Grants are the effective
    permissions of a user's active roles; there are few of them a user."""
    own = users.join(effective(roles).withColumnRenamed("permission", "held"), "role").select("user", "held").distinct()
    each = asked.select("user", "permission").distinct().join(own, "user", "left")
    return each.groupBy("user", "permission").agg(F.coalesce(F.bool_or(implied(F.col("held"), F.col("permission"))), F.lit(False)).alias("granted"))


def check_permission(users: DataFrame, roles: DataFrame, user: str, p: Permission) -> bool:
    asked = users.sparkSession.createDataFrame([(user, str(p))], "user string, permission string")
    return checked(users, roles, asked).first()["granted"]


def check_permissions(users: DataFrame, roles: DataFrame, user: str, ps: Iterable[Permission]) -> bool:
    """Whether all are granted."""
    asked = users.sparkSession.createDataFrame([(user, str(p)) for p in ps], "user string, permission string")
    return checked(users, roles, asked).filter("not granted").isEmpty()


def has_cycle(roles: DataFrame) -> bool:
    parents = {r["name"]: list(r["parents"] or []) for r in roles.select("name", "parents").collect()}
    state: dict[str, int] = {}

    def visit(n: str) -> bool:
        if state.get(n) == 1:
            return True
        if state.get(n) == 2 or n not in parents:
            return False
        state[n] = 1
        found = any(map(visit, parents[n]))
        state[n] = 2
        return found

    return any(map(visit, parents))


def roles_granting(roles: DataFrame, p: Permission) -> list[str]:
    """Only the names of those that do come to the driver."""
    found = effective(roles).filter(implied(F.col("permission"), F.lit(str(p)))).select("role").distinct()
    return sorted(r[0] for r in found.collect())
