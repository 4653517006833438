"""Versioned tables, loads of months and batches, caches: what a reader sees, also after a failure."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from playlake.plans import ingest as IG
from playlake.sources import files as FS
from playlake.sources import versions as V


def table(spark, rows, schema="part string, x long"):
    return spark.createDataFrame(rows, schema)


def seen(df):
    return sorted(tuple(r) for r in df.collect())


def load(spark, path, rows, **more):
    return V.commit(spark, path, table(spark, rows), F.col("part"), **more)


def test_append_replace_truncate(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, [("a", 1), ("b", 2)])
    load(spark, path, [("a", 3), ("c: /*{x}", 4)])
    assert seen(V.read(spark, path)) == [("a", 1), ("a", 3), ("b", 2), ("c: /*{x}", 4)]
    load(spark, path, [("a", 5), ("b", 6)], actions={"a": "replace", "c: /*{x}": "replace"})
    assert seen(V.read(spark, path)) == [("a", 5), ("b", 2), ("b", 6)]
    assert seen(V.counts(spark, path)) == [("a", 1), ("b", 2)]
    assert seen(V.read(spark, path, parts=["b", "z"])) == [("b", 2), ("b", 6)]
    load(spark, path, [("d", 7)], truncate=True)
    assert seen(V.read(spark, path)) == [("d", 7)]
    assert seen(V.read(spark, path, version=1)) == [("a", 1), ("b", 2)]
    load(spark, path, [], truncate=True)
    assert seen(V.read(spark, path)) == [] and V.read(spark, path).columns == ["part", "x"]


def test_a_load_that_stops_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    load(spark, path, [("a", 1)])

    def lost(*_):
        raise RuntimeError("executor of the driver lost")

    with monkeypatch.context() as m:
        m.setattr(V, "_publish", lost)  # the rows are written, the commit does not happen
        with pytest.raises(RuntimeError):
            load(spark, path, [("a", 2)], default="replace")
    assert seen(V.read(spark, path)) == [("a", 1)]
    load(spark, path, [("a", 3)], default="replace")
    assert seen(V.read(spark, path)) == [("a", 3)]
    assert len(V.vacuum(spark, path)) == 3  # the lost load, the replaced one and version 1
    assert seen(V.read(spark, path)) == [("a", 3)] and V.versions(spark, path) == [2]


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, [("a", 1)])
    old = V.read(spark, path)
    load(spark, path, [("a", 2)], truncate=True)
    assert seen(old) == [("a", 1)]


def test_two_loads_at_once_both_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    load(spark, path, [("a", 1)])
    write = V._write

    def slower(df, *rest):
        out = write(df, *rest)
        with monkeypatch.context() as m:
            m.setattr(V, "_write", write)
            load(spark, path, [("a", 2)])  # commits between the write and the commit of the other
        return out

    with monkeypatch.context() as m:
        m.setattr(V, "_write", slower)
        load(spark, path, [("a", 3), ("b", 4)])
    assert seen(V.read(spark, path)) == [("a", 1), ("a", 2), ("a", 3), ("b", 4)]
    assert V.versions(spark, path) == [1, 2, 3]


def test_a_tagged_load_is_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for mark, x in ((0, 1), (0, 1), (1, 2), (1, 2)):
        load(spark, path, [("a", x)], tag=("stream", mark))
    assert seen(V.read(spark, path)) == [("a", 1), ("a", 2)]


def test_other_columns_are_an_error(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, [("a", 1)])
    with pytest.raises(ValueError, match="other columns"):
        V.commit(spark, path, table(spark, [("a", "x")], "part string, x string"), F.col("part"))
    with pytest.raises(ValueError, match="action"):
        load(spark, path, [], default="merge")
    with pytest.raises(FileNotFoundError):
        V.read(spark, str(tmp_path / "none"))


def test_counts_open_no_file(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, [("2020-01-01", 1), ("2020-02-01", 2)])
    for df in (V.counts(spark, path), IG.loaded_months(spark, path),
               IG.plan_load(IG.month_series(spark, "01-2020", "03-2020"), spark, path)):
        assert "parquet" not in df._jdf.queryExecution().executedPlan().toString().lower()


def test_partition_columns_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    V.commit(spark, path, table(spark, [("a", 1), ("b", 2)]), F.lit("p"), partition_by=["part"])
    df = V.read(spark, path).where("part = 'a'")
    assert seen(df.select("part", "x")) == [("a", 1)]
    assert "PartitionFilters: [isnotnull(part" in df._jdf.queryExecution().executedPlan().toString()


def test_empty_is_an_error_only_for_a_table_with_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    FS.write_disposition(table(spark, []), path, "WRITE_EMPTY")
    FS.write_disposition(table(spark, [("a", 1)]), path, "WRITE_EMPTY", ["part"])
    with pytest.raises(ValueError, match="not empty"):
        FS.write_disposition(table(spark, [("a", 1)]), path, "WRITE_EMPTY")
    with pytest.raises(ValueError, match="unknown"):
        FS.write_disposition(table(spark, []), path, "WRITE_SOME")


# ---------------------------------------------------------------- caches

def test_a_failed_build_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")

    def broken():
        return table(spark, [("a", 1)]).select("part", F.raise_error(F.lit("no")).cast("long").alias("x"))

    with pytest.raises(Exception, match="no"):
        FS.write_once_cache(spark, path, broken)
    assert seen(FS.write_once_cache(spark, path, lambda: table(spark, [("a", 2)]))) == [("a", 2)]
    assert seen(FS.write_once_cache(spark, path, broken)) == [("a", 2)]


def test_a_cache_follows_the_files_it_was_built_from(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "cache")

    def cached():
        df = spark.read.parquet(src)
        return seen(FS.write_once_cache(spark, path, lambda: df, FS.fingerprint(df)))

    for rows in ([("a", 1)], [("a", 1), ("b", 2)], [("c", 3)]):
        table(spark, rows).write.mode("overwrite").parquet(src)
        assert cached() == rows == cached()


def test_sentence_vectors_follow_the_documents(spark, tmp_path):
    from playlake.registry import load_all
    queries, _ = load_all()
    path = str(tmp_path / "documents.parquet")
    for n in (5, 9):
        spark.range(n).selectExpr("id AS doc_id", "concat('word ', id) AS text", "'en' AS lang").write.mode("overwrite").parquet(path)
        assert queries["d13_text_embed"](spark, str(tmp_path)).count() == n
        assert queries["d14_sent_features_table"](spark, str(tmp_path)).count() == n


# ---------------------------------------------------------------- months

SPEC = IG.IngestSpec(date_col="day", keys=["k"], order_cols=["i"], header_cols=["e"], item_cols=["i", "x"],
                     numeric_cols=["k", "i", "x"], id_cols=["k", "i"], required_rows=["k", "i", "day"], partition_col="on",
                     items_name="items")
COLUMNS = ["k", "i", "day", "e", "x"]


def feed(spark, *days):
    return table(spark, [(str(n), "1", d, "e", "1.5") for n, d in enumerate(days)], ", ".join(f"{c} string" for c in COLUMNS))


def month(spark, path, raw, first, last, on_existing="skip"):
    plan = IG.plan_load(IG.month_series(spark, first, last), spark, path, on_existing)
    return [(r.month_start.month, r.action, r.sequences, r.status) for r in
            IG.ingest(spark, raw, path, plan, SPEC).orderBy("month_start").collect()]


def test_empty_months_are_a_success(spark, tmp_path):
    path = str(tmp_path / "facts")
    assert month(spark, path, feed(spark), "01-2020", "01-2020") == [(1, "ingest", 0, "empty")]  # a new table
    assert V.read(spark, path).count() == 0
    raw = feed(spark, "2020-01-05", "2020-01-06", "2020-03-01")
    assert month(spark, path, raw, "01-2020", "03-2020") == [
        (1, "ingest", 2, "loaded"), (2, "ingest", 0, "empty"), (3, "ingest", 1, "loaded")]
    assert month(spark, path, feed(spark), "02-2020", "03-2020") == [(2, "ingest", 0, "empty"), (3, "skip", 1, "skipped")]


def test_replace_takes_whole_months_and_append_adds(spark, tmp_path):
    path = str(tmp_path / "facts")
    month(spark, path, feed(spark, "2020-01-05", "2020-01-06", "2020-02-01"), "01-2020", "02-2020")
    assert month(spark, path, feed(spark, "2020-01-06"), "01-2020", "02-2020", "replace") == [
        (1, "replace", 1, "loaded"), (2, "replace", 0, "empty")]
    assert [r.on for r in V.read(spark, path).collect()] == [dt.date(2020, 1, 6)]
    assert month(spark, path, feed(spark, "2020-01-07"), "01-2020", "01-2020", "append") == [(1, "append", 2, "loaded")]


def test_a_replace_that_fails_keeps_the_month(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    month(spark, path, feed(spark, "2020-01-05"), "01-2020", "01-2020")
    with monkeypatch.context() as m:
        m.setattr(V, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            month(spark, path, feed(spark, "2020-01-20"), "01-2020", "01-2020", "replace")
    assert [r.on for r in V.read(spark, path).collect()] == [dt.date(2020, 1, 5)]


def test_a_batch_without_valid_rows_changes_nothing(spark, tmp_path):
    from playlake.streaming.monthly import load_landing
    landing, path, ckpt = (str(tmp_path / n) for n in ("landing", "facts", "ckpt"))
    FS.write_csv(feed(spark, "not a day"), landing)
    load_landing(spark, landing, COLUMNS, path, ckpt, SPEC, max_files_per_trigger=1)
    assert V.read(spark, path).count() == 0
    FS.write_csv(feed(spark, "2020-01-05", "no"), landing, mode="append")
    FS.write_csv(feed(spark, "no"), landing, mode="append")
    load_landing(spark, landing, COLUMNS, path, ckpt, SPEC, max_files_per_trigger=1)
    assert [r.on for r in V.read(spark, path).collect()] == [dt.date(2020, 1, 5)]
    before = V.versions(spark, path)
    load_landing(spark, landing, COLUMNS, path, ckpt, SPEC)
    assert V.versions(spark, path) == before
