"""Categories are counted once, and what links join several times is made once."""

import random

from pyspark.sql import functions as F

from gistmill import rules
from gistmill.functions import classify
from gistmill.operators import links


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_best_category_is_found_once(spark):
    rng = random.Random(5)
    parts = ["短剧", "AI", "短", "剧", "战略", "A股", "B站", " ", "x", "投资", "IPO", "a", "大会", "年", "App"]
    texts = ["", "短x剧"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = rows.select("i", classify.domain_classify(F.col("t")).alias("d"))
    assert _plan(got).count("array_max(") == 1
    for r in got.collect():
        hits = [sum(k in texts[r.i] for k in kws) for _, kws in rules.DOMAINS]
        assert r.d == (rules.DOMAINS[hits.index(max(hits))][0] if max(hits) else rules.DOMAIN_DEFAULT), texts[r.i]


def _rows(spark):
    made = F.reverse(F.concat(F.lit("dm."), (F.col("id") % 7).cast("string"))).alias("rel_path")
    return spark.range(60).select(F.col("id").alias("seq"), F.lit("k").alias("index_key"), made, F.col("id").cast("string").alias("title"))


def test_version_paths_make_candidates_once(spark):
    got = links.version_paths(_rows(spark), spark.createDataFrame([("0.md",)], "rel_path string"))
    assert "reverse(" not in _plan(got) and got.count() == 60


def test_index_entries_make_both_sides_once(spark):
    rows = _rows(spark)
    got = links.append_index_entries(rows, rows.where("seq = 0"), F.current_date())
    assert "reverse(" not in _plan(got) and sorted(r.seq for r in got.collect()) == [1, 2, 3, 4, 5, 6]
