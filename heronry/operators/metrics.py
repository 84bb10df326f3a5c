"""Retrieval quality. results: (query_id, doc_id, rank); qrels: (query_id, doc_id, rel); rel above 0 is relevant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def by_document(hits: DataFrame, doc: str = "document_id") -> DataFrame:
    """The first hit of each document, ranks anew."""
    first = hits.groupBy("query_id", F.col(doc).alias("doc_id")).agg(F.min("rank").alias("__r"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("__r", "doc_id")).alias("rank"))


def per_query(results: DataFrame, qrels: DataFrame, k: int = 10, graded: bool = False) -> DataFrame:
    """(query_id, ndcg, mrr, recall, n_relevant) of each query that has a relevant document; ndcg and recall at k.

    Judgements without a query_id hold for every query of the results: they are ranked once, and joined to the hits alone.
    """
    key = [c for c in ("query_id",) if c in qrels.columns]
    rel = F.col("rel").cast("double") if graded else (F.col("rel") > 0).cast("double")
    right = qrels.where("rel > 0").select(*key, "doc_id", rel.alias("rel"))
    if key:
        order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
        best = right.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
        ideal = right.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
        ideal = ideal.join(best.groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("__r"))).alias("__ideal")), "query_id", "left")
    else:
        best = right.orderBy(F.desc("rel"), "doc_id").limit(k).agg(F.array_sort(F.collect_list("rel"), lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0)).alias("__all"))
        total = F.aggregate(F.transform("__all", lambda r, i: gain(r, i + 1)), F.lit(0.0), lambda s, x: s + x)
        one = right.agg(F.count("*").alias("n_relevant")).where("n_relevant > 0").crossJoin(F.broadcast(best.select(total.alias("__ideal"))))
        ideal = results.select("query_id").distinct().crossJoin(F.broadcast(one))
    hit = results.join(right, [*key, "doc_id"])
    got = hit.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("rel"), F.col("rank")))).alias("__dcg"), F.min("rank").alias("__first"), F.sum((F.col("rank") <= k).cast("int")).alias("__hits")
    )
    rows = ideal.join(got, "query_id", "left")
    zero = F.lit(0.0)
    ndcg = F.when(F.col("__ideal") > 0, F.coalesce("__dcg", zero) / F.when(F.col("__ideal") > 0, F.col("__ideal"))).otherwise(0.0)
    return rows.select("query_id", ndcg.alias("ndcg"), F.coalesce(1 / F.col("__first"), zero).alias("mrr"), F.coalesce(F.col("__hits") / F.col("n_relevant"), zero).alias("recall"), "n_relevant")


def mean(c: Column | str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def grouped(scores: DataFrame, facts: DataFrame) -> DataFrame:
    """Means of per-query scores overall, by category (null: uncategorized) and by strategy, in one pass.

    facts: (query_id, category, strategy). level is all, category or strategy.
    """
    rows = scores.join(facts.select("query_id", F.coalesce("category", F.lit("uncategorized")).alias("category"), "strategy"), "query_id")
    sets = rows.groupingSets([[F.col("category")], [F.col("strategy")], []], F.col("category"), F.col("strategy"))
    out = sets.agg(F.count("*").alias("n"), mean("ndcg").alias("ndcg"), mean("mrr").alias("mrr"), mean("recall").alias("recall"), F.grouping("category").alias("__c"), F.grouping("strategy").alias("__s"))
    level = F.when(F.col("__c") == 0, "category").when(F.col("__s") == 0, "strategy").otherwise("all")
    return out.select(level.alias("level"), F.coalesce(F.when(F.col("__c") == 0, F.col("category")), F.when(F.col("__s") == 0, F.col("strategy")), F.lit("all")).alias("name"), "n", "ndcg", "mrr", "recall")


def strategy_shares(facts: DataFrame) -> DataFrame:
    """(strategy, n, percent) over all queries."""
    counted = facts.groupBy("strategy").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("__all")))).select("strategy", "n", (100 * F.col("n") / F.col("__all")).alias("percent"))


def percentiles(df: DataFrame, value: str, by: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at place floor(share * n), from 0, of each group in order, as p50 and so on, with n. Nulls don't count.

    All rows are sorted by ranges of (group, value), so that a large group lies in many partitions; counts by partition tell which
    place of which partition holds each wanted rank.
    """
    named = [f"__g{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(by, named)), F.col(value).alias("__v"))
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    rows = rows.withColumn("__t", at)  # so that one value that many rows have is cut, too
    sorted_ = rows.repartitionByRange(*named, "__v", "__t").sortWithinPartitions(*named, "__v").select(*named, "__v", at.alias("__at"))
    sorted_ = written(sorted_, "percentiles")
    parts = sorted_.groupBy(*named, F.shiftright("__at", 33).alias("__p")).agg(F.count("*").alias("__c"), F.min("__at").alias("__low"))
    order = Window.partitionBy(*named).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__base", F.coalesce(F.sum("__c").over(order), F.lit(0))).withColumn("n", F.sum("__c").over(Window.partitionBy(*named)))
    names = [f"p{round(p * 100)}" for p in shares]
    rank = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.col("n") - 1, F.floor(F.col("n") * p)).alias("at")) for name, p in zip(names, shares)))).alias("__w")
    wanted = parts.select("n", "__base", "__c", "__low", rank).where("__w.at >= __base and __w.at < __base + __c")
    found = sorted_.join(wanted.select("n", F.col("__w.name").alias("__name"), (F.col("__low") + F.col("__w.at") - F.col("__base")).alias("__at")), "__at")
    out = found.groupBy(*named, "n").agg(*(F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in names))
    return out.select(*(F.col(g).alias(c) for g, c in zip(named, by)), "n", *names)


def difference(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """new less old of each value, for keys of either report; a missing one is 0."""
    a = old.select(*keys, *(F.col(v).alias(f"__a_{v}") for v in values))
    b = new.select(*keys, *(F.col(v).alias(f"__b_{v}") for v in values))
    zero = F.lit(0)
    return a.join(b, keys, "full_outer").select(*keys, *((F.coalesce(f"__b_{v}", zero) - F.coalesce(f"__a_{v}", zero)).alias(f"delta_{v}") for v in values))


def report(groups: DataFrame, shares: DataFrame) -> str:
    """Both tables as text."""
    rows = sorted(groups.collect(), key=lambda r: (r["level"] != "all", r["level"], r["name"]))
    lines = [f"{'':24}{'n':>6}{'NDCG':>8}{'MRR':>8}{'recall':>8}"]
    lines += [f"{r['level'] + ' ' + r['name'] if r['level'] != 'all' else 'all queries':24}{r['n']:>6}{r['ndcg']:>8.3f}{r['mrr']:>8.3f}{r['recall']:>8.3f}" for r in rows]
    lines += [f"strategy {r['strategy']}: {r['n']} ({r['percent']:.1f} %)" for r in sorted(shares.collect(), key=lambda r: r["strategy"])]
    return "\n".join(lines)
