"""Dictionaries of many categories: sparse hash vectors, dense and stable codes."""

from pyspark.sql import functions as F

from playlake.functions.hashing import signed_hash_vector
from playlake.operators import encode as EN
from playlake.operators import joins as J


def test_sparse_vectors_are_the_dense_ones(spark):
    df = spark.createDataFrame([(x,) for x in ["a", "b", "c", None, "None", "é", "a"]], "x string")
    out, d = EN.feature_hash(df, "x", out="h", method="murmur3")
    assert d.count() == 5
    for r in out.select("x", EN.dense("h").alias("v"), "h").collect():
        assert list(r.v) == signed_hash_vector(f"x={'None' if r.x is None else r.x}", 6)
        assert r.h.width == 6
    wide = EN.expand_vector(out, "h", 6).select("x", *[f"h{i}" for i in range(6)])
    assert [list(r)[1:] for r in wide.collect()] == [list(r.v) for r in out.select(EN.dense("h").alias("v")).collect()]


def test_the_least_hash_has_a_slot(spark, monkeypatch):
    @F.pandas_udf("long")
    def least(t):
        return t.map(lambda _: -(2 ** 31))

    monkeypatch.setattr(EN, "_murmur", least)
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    r = EN.hash_dictionary(df, "x").first()
    assert (r.hash.width, r.hash.slot, r.hash.sign) == (4, (2147483647 - 3) % 4, -1)


def test_fifty_thousand_categories(spark):
    """The dictionary holds three numbers a category, is joined whole, and facts are not moved by category."""
    n = 50_000
    df = spark.range(3 * n).select((F.col("id") % n).cast("string").alias("player"), "id")
    d = EN.hash_dictionary(df, "player", method="md5")
    sizes = d.agg(F.count("*"), F.max(F.length(F.to_json("hash")))).first()
    assert sizes[0] == n and sizes[1] < 64
    out, _ = EN.feature_hash(df, "player", out="h", dictionary=d)
    r = out.agg(F.count("h"), F.min("h.width"), F.max("h.slot"), F.min("h.slot"), F.count_distinct("h.slot"), F.sum(F.abs("h.sign"))).first()
    assert r[0] == 3 * n and r[1] == n and 0 <= r[3] and r[2] < n and r[4] > n / 2 and r[5] == 3 * n
    assert "hashpartitioning(_label" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_wide_dictionary_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_BYTES", 100)
    df = spark.range(50).select((F.col("id") % 5).cast("string").alias("k"), "id")
    d = spark.range(5).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("x"), 1000).alias("v"))
    out = J.dictionary_join(df, d, "k")
    assert "_salt" in out._jdf.queryExecution().analyzed().toString() and out.where("length(v) = 1000").count() == 50


def test_dense_codes_without_a_one_task_window(spark):
    df = spark.range(20_000).select(F.concat(F.lit("v"), F.lpad((F.col("id") * 7 % 20_000).cast("string"), 6, "0")).alias("v")) \
        .unionByName(spark.createDataFrame([(None,)], "v string"))
    d = EN.category_dictionary(df, "v")
    rows = d.orderBy("v").collect()
    assert [r.code for r in rows] == list(range(20_000))
    coded, _ = EN.category_codes(df, "v", "c", d)
    assert coded.where("v IS NULL").first().c == -1
    assert EN.category_dictionary(df.where("false"), "v").count() == 0


def test_old_codes_stay_when_values_arrive(spark, tmp_path):
    path = str(tmp_path / "codes")
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    codes = lambda d: {r.v: r.code for r in d.collect()}
    assert codes(EN.stable_dictionary(frame("m", "c", None, "m"), "v", path)) == {"c": 0, "m": 1}
    assert codes(EN.stable_dictionary(frame("a", "z", "c"), "v", path)) == {"c": 0, "m": 1, "a": 2, "z": 3}
    assert codes(EN.stable_dictionary(frame("b"), "v", path)) == {"c": 0, "m": 1, "a": 2, "z": 3, "b": 4}
    assert codes(EN.stable_dictionary(frame(None), "v", path)) == {"c": 0, "m": 1, "a": 2, "z": 3, "b": 4}
