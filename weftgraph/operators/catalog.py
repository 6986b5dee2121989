"""Index and constraint definitions, kept as metadata."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from ..plans.values import SemanticError, Value


def apply(compiler, c: A.Catalog):
    from ..plans.compiler import Rows

    g = compiler.graph
    kind, what = ("indexes", g.indexes) if "index" in c.action else ("constraints", g.constraints)
    if c.action.startswith("create"):
        name = c.name or f"{c.label}_{'_'.join(c.props)}_{c.kind}"
        what[name] = {"label": c.label, "properties": c.props, "type": c.kind}
    elif c.action.startswith("drop"):
        if c.name not in what and not c.if_exists:
            raise SemanticError(f"no such {kind[:-2] if kind == 'indexes' else kind[:-1]}: {c.name}")
        what.pop(c.name, None)
    else:
        rows = [(n, json.dumps(v, sort_keys=True)) for n, v in sorted(what.items())]
        df = compiler.spark.createDataFrame(rows, "name string, type string")
        return Rows(df, {n: Value(F.col(n), T.StringType()) for n in ("name", "type")})
    return Rows(None, {})


def violations(graph, name: str):
    """Nodes that break a constraint (which writes do not check): their ids."""
    c = graph.constraints[name]
    out = None
    for i in graph.tables_for([c["label"]]):
        t = graph.nodes[i]
        df = t.df if t.label is not None else t.df.where(F.array_contains("labels", c["label"]))
        missing = F.lit(False)
        for p in c["properties"]:
            missing = missing | F.col(f"`{p}`").isNull()
        if c["type"] == "not_null":
            bad = df.where(missing).select("id")
        else:
            twice = df.where(~missing).groupBy(*c["properties"]).agg(F.count(F.lit(1)).alias("@n")).where("`@n` > 1")
            bad = df.join(twice, c["properties"], "left_semi").select("id")
            if c["type"] == "node_key":
                bad = bad.unionByName(df.where(missing).select("id"))
        bad = bad.select(F.col("id").cast("string").alias("id"))
        out = bad if out is None else out.unionByName(bad)
    return out
