"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .pagerank import link_weight, pagerank  # noqa: F401
from .ranking import dense_topk

#: Edges of a part.
ROWS = 1 << 20


def parts_of(edges: DataFrame, rows: int | None = None) -> int:
    """Parts of about ``ROWS`` of the edges, so that a task groups or sorts as many however large the table is. ``rows``: a bound of their number, if known."""
    return max(edges.sparkSession.sparkContext.defaultParallelism, -(-(edges.count() if rows is None else rows) // ROWS))


def adjacency(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(src, dst, weight) -> both directions, the largest weight of a pair; missing or zero weighs 1, negative 0.

    A pair is grouped once for both directions, and dealt into parts by number of edges (``rows``, counted if not given).
    """
    turned = F.coalesce(F.col("src") > F.col("dst"), F.col("dst").isNull() & F.col("src").isNotNull())
    low, high = F.when(turned, F.col("dst")).otherwise(F.col("src")), F.when(turned, F.col("src")).otherwise(F.col("dst"))
    pairs = edges.select(low.alias("src"), high.alias("dst"), link_weight().alias("weight")).repartition(parts_of(edges, rows), "src", "dst")
    pairs = pairs.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    one = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "weight")
    return pairs.select(F.inline(F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(one("src", "dst"))).otherwise(F.array(one("src", "dst"), one("dst", "src")))))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One hop from seeds (id) in both directions: the largest weight of each neighbour."""
    out = edges.join(seeds, edges["src"] == seeds["id"], "left_semi").select(F.col("dst").alias("id"), "weight")
    back = edges.join(seeds, edges["dst"] == seeds["id"], "left_semi").select(F.col("src").alias("id"), "weight")
    return out.unionByName(back).groupBy("id").agg(F.max("weight").alias("weight")).join(seeds, "id", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, rows: int | None = None) -> DataFrame:
    """(id, hops) of nodes within ``depth`` hops of the seeds; each round joins only the newest front. ``rows`` as in ``adjacency``.

    A link that is there twice does no harm, so links are not grouped.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    n = 2 * parts_of(edges, rows)
    links = both.repartition(n, "src")
    found = front = seeds.select("id", F.lit(0).alias("hops"))
    for hop in range(1, depth + 1):
        front = links.join(front.select(F.col("id").alias("src")).repartition(n, "src"), "src").select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti").withColumn("hops", F.lit(hop))
        found = found.unionByName(front)
    return found


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 3, rows: int | None = None) -> DataFrame:
    """pairs (a, b) -> the first of the shortest paths in order of nodes, up to ``depth`` edges."""
    links = adjacency(edges, rows).select("src", "dst")
    walk = pairs.select("a", "b", F.array("a").alias("path"), F.col("a").alias("at"))
    done = None
    for _ in range(depth):
        walk = walk.join(links, walk["at"] == links["src"]).where(~F.array_contains("path", F.col("dst"))).select("a", "b", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        walk = walk.groupBy("a", "b", "at").agg(F.min("path").alias("path"))
        here = walk.where("at = b").select("a", "b", "path")
        done = here if done is None else done.unionByName(here)
    order = Window.partitionBy("a", "b").orderBy(F.size("path"), "path")
    return done.withColumn("n", F.row_number().over(order)).where("n = 1").select("a", "b", "path")


def entity_search(entities: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """entities (id, vec) and queries (qid, qvec): the k most similar entities of each query."""
    return dense_topk(entities, queries, k, by="cosine")


def low_high(low: DataFrame, high: DataFrame, k: int = 60) -> DataFrame:
    """Fuse entity hits and neighbour hits (qid, key, rank): 1/(k+r) and 0.8/(k+r)."""
    parts = low.select("qid", "key", (F.lit(1.0) / (k + F.col("rank"))).alias("part")).unionByName(high.select("qid", "key", (F.lit(0.8) / (k + F.col("rank"))).alias("part")))
    total = parts.groupBy("qid", "key").agg(F.round(F.sum("part"), 9).alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key")))


def keyword_seeds(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """entities (id, name) and queries (qid, query) -> qid, id: entities whose name is a token of the query."""
    asked = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("name")).where(F.length("name") > 1)
    return asked.join(entities.select("id", F.lower("name").alias("name")), "name").select("qid", "id")


def resolved_relations(said: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """said (chunk, a, b) and entities (chunk, name) -> id, a, b: relations whose ends are both entities of their chunk, once each."""
    ends = lambda c: entities.select(F.col("chunk"), F.col("name").alias(c))
    known = said.join(ends("a"), ["chunk", "a"], "left_semi").join(ends("b"), ["chunk", "b"], "left_semi")
    key = F.substring(F.sha1(F.concat_ws("::", F.col("a").cast("string"), F.lit(kind), F.col("b").cast("string"))), 1, 16)
    return known.select(key.alias("id"), "a", "b").distinct()
