"""Row-level security: what a caller may see, compiled to a filter on every node."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.values import NodeRef


def fnv1a32(text: str) -> int:
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


@dataclass
class Scope:
    """A clearance level, granted collection prefixes and owners who consented."""

    clearance: int = 0
    prefixes: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)

    def __call__(self, ref: NodeRef) -> Column:
        """Whether a bound node may be seen.

        Its sensitivity (0 where absent) is within the clearance; or its collection
        starts with a granted prefix; or its owner consented. With prefixes granted,
        a node without a collection is not tried for consent.
        """

        def prop(name):
            return ref.prop(name) if name in ref.props else None

        level = prop("sensitivity_ord")
        if level is None:
            return F.lit(True)
        seen = F.coalesce(level, F.lit(0)) <= self.clearance
        collection, owner = prop("collection"), prop("owner_hash")
        consent = owner.isin(*self.owners) if owner is not None and self.owners else F.lit(False)
        if self.prefixes:
            if collection is None:
                return seen
            granted = F.lit(False)
            for p in self.prefixes:
                granted = granted | collection.startswith(p)
            return seen | (collection.isNotNull() & (granted | consent))
        return seen | consent


def compile_scope(policies: dict[str, DataFrame], did: str) -> Scope:
    """The scope of an identity from the policy tables; an empty identity sees what is public.

    ``ClearanceAssignment(did, level)``, ``RBACAssignment(did, scope)`` (``*`` counts
    for nothing) and ``ConsentGrant(grantee_did, grantor_did)``. Only the rows of the
    one identity reach the driver.
    """
    if not did:
        return Scope()

    def rows(name: str, who: str, what: str):
        if name not in policies:
            return []
        return [r[0] for r in policies[name].where(F.col(who) == did).select(what).distinct().collect()]

    levels = [int(x) for x in rows("ClearanceAssignment", "did", "level") if x is not None]
    scopes = sorted(x for x in rows("RBACAssignment", "did", "scope") if x and x != "*")
    grantors = rows("ConsentGrant", "grantee_did", "grantor_did")
    return Scope(min(max(levels, default=0), 3), scopes, sorted(fnv1a32(x) for x in grantors if x))
