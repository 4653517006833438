"""Physical-plan checks: pushdown, pruning, no cartesian products, bounded windows."""

from settings import SF_SMALL
from playlake.operators.sampling import stratified_sample
from playlake.session import read_table
from playlake.sources.scans import scan_range


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_range_pushes_filters(spark):
    df = scan_range(read_table(spark, SF_SMALL, "lineitem"), "l_shipdate", "1997-03-01", "1998-06-30")
    plan = _plan(df.select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan


def test_partitioned_read_prunes(spark, tmp_path):
    from playlake.sources.scans import read_partitioned
    from pyspark.sql import functions as F
    li = read_table(spark, SF_SMALL, "lineitem").withColumn("ship_month", F.trunc(F.to_date("l_shipdate"), "month"))
    li.write.partitionBy("ship_month").parquet(str(tmp_path / "t"))
    df = read_partitioned(spark, str(tmp_path / "t"), "ship_month", "1997-03-01", "1997-04-01")
    assert "PartitionFilters: [isnotnull(ship_month" in _plan(df)
    assert {str(r[0]) for r in df.select("ship_month").distinct().collect()} == {"1997-03-01", "1997-04-01"}


def test_dictionary_joins_leave_facts_in_place(spark):
    from playlake.operators import joins as J
    from playlake.operators.encode import category_codes, category_dictionary
    li = read_table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_returnflag")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        coded, _ = category_codes(li, "l_returnflag")
        assert "hashpartitioning(l_returnflag" not in _plan(coded)
        d = category_dictionary(li, "l_returnflag")
        salted = J.dictionary_join(li, d, "l_returnflag", limit=1)
        assert "hashpartitioning(l_returnflag" in _plan(salted) and "_salt" in _plan(salted)
        both = [sorted(map(str, x.select("l_orderkey", "l_returnflag", "code").collect()))
                for x in (salted, J.dictionary_join(li, d, "l_returnflag"))]
        assert both[0] == both[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pair_index_moves_no_vectors(spark):
    from playlake.operators.pairs import pair_index
    e = read_table(spark, SF_SMALL, "embeddings")
    assert pair_index(e, "vec_id", "label", "embedding").columns == ["vec_id", "label", "idx"]


def test_no_usable_vector_is_an_error(spark):
    import pytest
    from playlake.operators.nesting import unwrap_list_record
    df = spark.createDataFrame([([None],), (None,)], "v array<double>")
    with pytest.raises(ValueError, match="usable"):
        unwrap_list_record(df, "v", require_any=True)


def test_stratified_sample_limits_before_shuffle(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    df = stratified_sample(e, "label", "vec_id", 5)
    df.collect()
    plan = _plan(df)
    assert "WindowGroupLimit" in plan


def test_no_cartesian_products(spark):
    import __spark_entry__ as E
    q = E.queries()
    for name in ["e6_class_cross", "h6_nearest_centroid", "h7_silhouette", "i1_ttest_ind", "f13_box_summary",
                 "slice_returnflag_crosstab", "f14_histogram"]:
        df = q[name](spark, SF_SMALL)
        df.collect()
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_entry_runs(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 3 and set(rows[0].asDict()) == {"returnflag_code", "n_f", "n_o"}
