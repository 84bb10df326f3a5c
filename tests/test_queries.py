import pytest

import __spark_entry__ as entry
from heronry.plans import queries

from . import compare


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    if name in queries.SQL:
        compare.same(spark, data, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, data).count() > 0


def test_mmr_is_greedy(spark, data):
    from heronry.operators import rerank

    hits = queries._hits(spark, data)
    by = {}
    for r in hits.collect():
        by.setdefault(r["query_id"], []).append(r)
    got = {}
    for r in queries.mmr_order(spark, data).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        sets = [rerank._tokens(r["content"]) for r in rows]
        left, order = list(range(len(rows))), []
        while left:
            gain = [(0.7 * rows[i]["score"] - 0.3 * max((rerank._alike(sets[i], sets[j]) for j in order), default=0), -i) for i in left]
            order.append(left.pop(max(range(len(left)), key=gain.__getitem__)))
        assert [got[q][k + 1] for k in range(len(order))] == [rows[i]["chunk_id"] for i in order]


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "rank", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_items_are_asked_whole(spark, tmp_path):
    item = "the quick brown fox jumps over a lazy dog by the old river bank"
    docs = [(i, "the quick brown fox", "en", "s") for i in range(15)] + [(50, "Long ago, and far away from here: " + item + ", and so on.", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert queries.contained_topk(spark, str(tmp_path)).where("rank = 1").first()["doc_id"] == 50
    assert [r["doc_id"] for r in queries.bm25_all_terms(spark, str(tmp_path)).collect()] == [50]
