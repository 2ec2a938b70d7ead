"""Plain single-process versions to hold the Spark operators against."""

from __future__ import annotations


def roots(nodes, edges):
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def messy(spark, rows, extra="key"):
    """(doc_id, text) rows with columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(i, t, "x", 1, 2.0) for i, t in rows],
        f"doc_id bigint, text string, {extra} string, part int, fp double").select(
        "text", extra, "part", "doc_id", "fp")
