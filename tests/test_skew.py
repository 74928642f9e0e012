"""A key holding a third of all rows: map-side reduction before every shuffle."""

from pyspark.sql import functions as F

from cribra.operators import bronze as B
from cribra.operators import silver as SV
from cribra.operators import stats as ST

N = 120_000
SIG = "abcdef0123456789"


def _plan(df) -> str:
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def _skewed(spark):
    # every third row belongs to one hot trial; the rest spread over 5,000 trials
    key = F.when(F.col("id") % 3 == 0, F.lit("NCT00000001")).otherwise(
        F.format_string("NCT%08d", (F.col("id") % 5000) + 2))
    return spark.range(N).select(key.alias("nct_id"), F.col("id").alias("seq"),
                                 F.format_string("v%d", "id").alias("raw"))


def test_dedupe_limits_each_task_before_the_shuffle(spark):
    df = _skewed(spark)
    out = B.dedupe_latest(df, ["nct_id"], ["seq"])
    plan = _plan(out)
    head = plan.split("\n\n(1)")[0]
    assert head.index("Exchange") < head.rindex("WindowGroupLimit")   # a group limit below the shuffle
    got = {r.nct_id: r.seq for r in out.collect()}
    assert len(got) == 5001 and got["NCT00000001"] == (N - 1) // 3 * 3


def test_failure_counts_aggregate_before_the_shuffle(spark):
    df = _skewed(spark).select("nct_id", F.lit(None).cast("array<struct<criterion_id:string,"
                                                         "text:string,kind:string,is_exclusion:boolean>>")
                               .alias("criteria"), F.concat(F.lit("bad "), "raw").alias("error"), "seq")
    out = SV.accumulate_failures(None, df, SIG, order_col="seq")
    plan = _plan(out)
    assert "Partial" in plan or "partial_" in plan
    hot = out.where("nct_id = 'NCT00000001'").first()
    counted = [i for i in range(0, N, 3) if "429" not in f"v{i}"]   # "429" anywhere = throttled
    assert hot.attempts == len(counted) and hot.error == f"bad v{counted[-1]}"


def test_value_counts_with_a_hot_value(spark):
    df = _skewed(spark).withColumn("kind", F.when(F.col("nct_id") == "NCT00000001", F.lit("other"))
                                   .otherwise(F.lit("lab")))
    dist = {r.kind: r.criteria for r in SV.kind_distribution(df).collect()}
    assert dist == {"other": N // 3, "lab": N - N // 3}
    top = ST.enum_stats(df, "seq", "kind").collect()
    assert {r.value: r.studies for r in top} == dist
    assert "partial_count" in _plan(SV.kind_distribution(df))
