"""External facts and candidates are judged once."""

from pyspark.sql import functions as F

from engram.operators import external


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_validation_runs_once(spark):
    facts = spark.createDataFrame([(1, "I use Redis and I prefer tea.", None), (2, "", None)],
                                  "message_id long, message string, x string")
    accepted, _ = external.parse_facts(facts.withColumn("facts_json", F.lit(
        '{"facts":[{"entity":"user","attribute":"uses","value":"Redis","type":"usage",'
        '"state":"current","scope":"user","confidence":0.9}]}')))
    rows = external.validated_candidates(external.validate(external.per_message(accepted)))
    # A filter on the list would hold the rules once more.
    assert "size(" not in "".join(
        line for line in _plan(rows).split("\n") if line.lstrip(" +-:").startswith("Filter"))
    assert {(r["message_id"], r["pos"], r["attribute"], r["value"]) for r in rows.collect()} == {
        (1, 0, "uses", "Redis"), (2, 0, "uses", "Redis")}


def test_external_candidates_are_read_once(spark):
    local = spark.createDataFrame([(1, 1, 0, "Tea"), (1, 2, 0, "Oslo")],
                                  "user_id long, seq long, pos int, candidate_content string")
    more = spark.createDataFrame([
        (1, 1, 1, "TEA"), (1, 1, 3, "milk"), (1, 1, 2, "Milk"), (1, 1, 2, "mILK"), (1, 2, 0, "tea"),
        (1, 2, 1, None), (None, 2, 1, "jam"), (2, 1, None, "x")],
        "user_id long, seq long, pos int, candidate_content string").withColumn(
        "marked", F.expr("concat(candidate_content, '-only-outside')"))
    out = external.union_candidates(local, more, ["user_id", "seq"])
    assert out.columns == local.columns
    leaves = [line for line in _plan(out).split("\n") if "LogicalRDD" in line]
    assert len(leaves) == 3  # local twice, external once
    assert sorted(map(tuple, out.collect())) == [
        (1, 1, 0, "Tea"), (1, 1, 2, "Milk"), (1, 1, 2, "mILK"), (1, 2, 0, "Oslo"),
        (1, 2, 0, "tea")]
