"""Corrective search: a second pass for the queries that the first one does not serve, and for no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import cut

Search = Callable[[DataFrame], DataFrame]


def corrective_search(queries: DataFrame, first: Search, second: Search, ranked: Search, judge: Search) -> DataFrame:
    """queries (qid, ...) -> the hits (qid, ...) of the pass that serves each, ``retried``, ``state`` of the evidence at the end.

    ``first`` and ``second`` search for given queries, ``ranked`` puts hits into the order of their authority, ``judge`` gives
    (qid, state, retry_action) for (queries with their hits) as in ``evidence_state``. The first pass is written once; the second
    one sees only queries whose state has a retry_action, and where it finds nothing the first one's hits stay. One row
    a hit; a query without hits has none.
    """
    found = cut(ranked(first(queries)))
    states = cut(judge(found))
    again = queries.join(states.where("retry_action is not null").select("qid"), "qid", "left_semi")
    if again.isEmpty():
        return found.join(states.select("qid", "state"), "qid").withColumn("retried", F.lit(False))
    later = cut(ranked(second(again)))
    later_states = judge(later).select("qid", "state")
    served = later.select("qid").distinct()
    kept = found.join(served, "qid", "left_anti").join(states.select("qid", "state"), "qid").withColumn("retried", F.lit(False))
    return kept.unionByName(later.join(later_states, "qid").withColumn("retried", F.lit(True)))
