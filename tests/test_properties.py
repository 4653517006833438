"""Properties: nest/un-nest round trip, partition invariance, metric identities."""

from pyspark.sql import functions as F

from settings import SF_SMALL
from playlake.operators import vectors as V
from playlake.operators.nesting import nest_sequences, unnest
from playlake.session import read_table


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_unnest_of_nest_is_identity(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    nested = nest_sequences(li, ["l_orderkey"], ["l_linenumber"], cols, items_name="lines")
    back = unnest(nested, "lines").select("l_orderkey", *cols)
    assert _rows(back) == _rows(li.select("l_orderkey", *cols))


def test_partitioning_does_not_change_results(spark):
    import __spark_entry__ as E
    q = E.queries()
    for name in ["c3_drop_multi_pitcher", "d3_category_codes", "g6_stratified_sample", "e4_same_event_pairs"]:
        base = _rows(q[name](spark, SF_SMALL))
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        try:
            again = _rows(q[name](spark, SF_SMALL))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert base == again, name


def test_ari_of_identical_labels_is_one(spark):
    e = read_table(spark, SF_SMALL, "embeddings").select("label", F.col("label").alias("same"))
    assert abs(V.adjusted_rand(e, "label", "same").first()["ari"] - 1.0) < 1e-12
    assert abs(V.norm_mutual_info(e, "label", "same").first()["nmi"] - 1.0) < 1e-12


def test_class_matrix_is_symmetric(spark):
    import __spark_entry__ as E
    m = {(r.class_i, r.class_j): r.mean_distance for r in E.queries()["f12_interclass_matrix"](spark, SF_SMALL).collect()}
    for (i, j), v in m.items():
        assert m[(j, i)] == v
