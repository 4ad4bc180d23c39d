import duckdb
import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_near_dedup import brute

from rivulet.llm import decontaminate, mixing, quality
from rivulet.llm.common import normal_words, word_hashes

SF = "/root/testdata/sf0.001"


def test_stages_act_on_all_they_get(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, SF).cache()
        kept[name] = (before, docs)
        if i < len(P.STAGES) - 1:
            assert docs.columns == list(P.COLUMNS)
    before, after = kept["quality"]
    voters = quality.fit_voters(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = quality.with_quality(before, voters).filter(F.col("score") >= quality.THRESHOLD)
    assert sorted(r.doc_id for r in want.collect()) == sorted(r.doc_id for r in after.collect())
    before, after = kept["near_duplicates"]  # by comparing every pair of texts
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(brute([(r.doc_id, r.text) for r in before.collect()]).values()))
    before, after = kept["benchmark_passages"]  # by tiling every pair of document and item
    hashed = {}
    for name, df in (("docs", before.selectExpr("doc_id AS id", "text")), ("items", spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id AS id", "text"))):
        rows = df.select("id", normal_words("text").alias("words")).collect()
        hashed[name] = [(r.id, word_hashes(d := np.frombuffer(r.words.encode(), np.uint8), np.array([0, len(d)]))[0]) for r in rows]
    covered = lambda d, i: sum(n for _, _, n in decontaminate.tile(d, i))
    bad = {d for d, x in hashed["docs"] if any(len(y) >= 5 and np.isin(x, y).sum() >= 5 and covered(x, y) >= 0.6 * len(y) for _, y in hashed["items"])}
    assert bad and {r.doc_id for r in after.collect()} == {d for d, _ in hashed["docs"]} - bad
    before, after = kept["mixture"]  # by SQL
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    want = [d for d, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall() if size for _ in range(taken // size)]
    assert sorted(want) == sorted(r.doc_id for r in after.filter(mixing.words_in("text") > 0).collect())
    before, after = kept["shards"]
    assert after.count() == before.count() and after.select("shard").distinct().count() == 16


def test_run_equals_stages_and_bears_empty_tables(spark, tmp_path):
    assert P.run(spark, SF).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
