"""Line chunks, near-duplicates, contamination and substrings against plain Python, with the awkward inputs."""

import random

import pytest
from brute import components, contaminated, cut_repeats, sha
from pyspark.sql import functions as F

from playlake.llm.common import settings
from playlake.llm.contamination import contamination, proximity_matches
from playlake.llm.lines import dedup_lines
from playlake.llm.minhash import band_keys, near_duplicates, signature
from playlake.llm.substrings import dedup_substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    """Documents of (id, text), with columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.selectExpr("*", "1 AS k1", "'x' AS id", "2 AS n", "3 AS start", "'c' AS chunk", "4 AS cid")


def corpus(seed, n=60):
    """Texts with copies, near copies, shared passages, one large family and a hot passage."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") * r.randint(1, 3) + r.choice("xyz") + str(r.randint(0, 60))
    text = lambda k: " ".join(word() for _ in range(k))
    hot = text(50)
    base = [text(r.randint(1, 120)) for _ in range(n)]
    rows = []
    for i, t in enumerate(base):
        rows.append(t)
        if i % 5 == 0:
            rows.append(t)
        if i % 4 == 0:
            w = t.split()
            w[r.randrange(len(w))] = "changed"
            rows.append(" \t".join(w).upper())
        if i % 3 == 0:
            rows.append(text(20) + "\n" + hot + " " + text(5))
    family = text(200).split()
    for _ in range(25):
        w = list(family)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [None, "", " \n\t ", "one", "one", "two words", "é ü ß 日本", "x" * 20_000, "a " * 5_000]
    r.shuffle(rows)
    out = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    return out + [out[0], out[0], (None, "null id text here"), (None, "null id text here"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_all_pairs(spark, seed):
    rows = corpus(seed)
    got = near_duplicates(docs(spark, rows), shingle_words=3, percent=85)
    want = components(rows, 3, 85)
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()))) == sorted(map(str, want))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_near_duplicates_defaults_are_five_words_and_0_8(spark):
    rows = corpus(3, 25)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, components(rows, 5, 80)))


def test_near_duplicates_are_the_same_however_tables_are_joined(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr("playlake.llm.common.FEW_ROWS", 0)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, rows), 3, 85).collect()]
    assert sorted(map(str, got)) == sorted(map(str, components(rows, 3, 85)))


def test_near_duplicates_move_few_tables(spark):
    # every shuffle costs a task for each of its partitions, however few its rows are
    sc = spark.sparkContext
    sc.setJobGroup("near-duplicate-tasks", "")
    try:
        with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40",
                              "spark.sql.autoBroadcastJoinThreshold": "-1"}):
            near_duplicates(docs(spark, corpus(6)), 3, 85).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near-duplicate-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    assert 0 < tasks <= 2_200, tasks


def test_links_only_through_a_centre_are_kept(spark):
    # variants agree with the original (0.85 and more) but not with each other
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = [(100, " ".join(base))]
    for i in range(30):
        w = list(base)
        for p in (5 * i % 150, (5 * i + 40) % 150, (5 * i + 90) % 150):
            w[p] = f"v{i}x{p}"
        rows.append((i + 1 if i % 2 else i + 200, " ".join(w)))
    got = near_duplicates(docs(spark, rows), shingle_words=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((a, c) for a, _, c in components(rows, 3, 85))


def test_signature_estimates_similarity():
    import numpy as np
    rng = np.random.default_rng(0)
    for size, share in ((6, 0.5), (60, 0.8), (3000, 0.9)):
        same = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            cut = round(size * 2 * share / (1 + share) / 1)
            a, b = pool[:size], np.concatenate([pool[:cut], pool[size:2 * size - cut]])
            sa, sb = (signature(np.unique(x), 180) for x in (a, b))
            same.append((sa == sb).mean())
            assert len(band_keys(sa, 30)) == 30
        true = cut / (2 * size - cut)
        assert abs(sum(same) / len(same) - true) < 0.08


def test_contamination_matches_search(spark):
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "a"]) if r.random() < 0.4 else f"w{r.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(r.choice([3, 12, 13, 14, 30])))) for i in range(12)]
    items += [(3, "another text for item three with a few words more than thirteen of them in it all"), (None, "no id here"),
              (50, None), (51, ""), (52, "..."), (53, "Zürich-straße 日本"), (10, "solo")]
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 80))]
        if i % 3 == 0:
            t = r.choice([t for _, t in items if t]).split()
            a = r.randrange(len(t))
            w[len(w) // 2:len(w) // 2] = t[a:] if i % 2 else t
        rows.append((i, ", ".join(w).title() if i % 4 else "\n".join(w)))
    rows += [rows[3], rows[3], (None, items[0][1]), (900, None), (901, ""), (902, "ZÜRICH straße 日本"),
             (903, "the " * 20_000), (904, " ".join(t for _, t in items if t))]
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS row", "'w' AS words")
    got = contamination(docs(spark, rows), b)
    want = contaminated(rows, items)
    assert sorted(map(str, ((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got.collect()))) == sorted(map(str, want))
    assert all(x.contaminated == (x.n_hit > 0 and 20 * x.n_hit >= x.n_words) for x in got.collect())
    assert any(x[2] for x in want)


def test_contamination_without_a_dictionary(spark, monkeypatch):
    import playlake.llm.contamination as c
    monkeypatch.setattr(c, "DICTIONARY_TERMS", 3)
    rows = [(1, "a b c d e f"), (2, "x a b c y"), (3, "c b a"), (4, None)]
    items = [(1, "a b c"), (2, "e f"), (3, "q")]
    got = c.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), n=3)
    assert sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got.collect()) == contaminated(rows, items, 3)


def test_proximity(spark):
    rows = [(1, "rare x y z scarce"), (2, "rare " + "pad " * 30 + "scarce"), (3, "rare only"), (4, None), (5, "pad pad")]
    items = spark.createDataFrame([(7, "rare scarce"), (8, "absent words"), (9, None)], "item_id long, text string")
    got = [(x.doc_id, x.item_id, x.distance) for x in proximity_matches(docs(spark, rows), items, 5).collect()]
    assert got == [(1, "7", 4)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 35])
def test_substrings_match_counting(spark, n):
    rows = corpus(6, 30) + [(500, "p q p q p q p q"), (501, "r s t u v w x y z r s t u v w x y z")]
    got = dedup_substrings(docs(spark, rows), n=n)
    want = cut_repeats(rows, n)
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()))) == sorted(map(str, want))
    assert all(r.kept_sha256 == sha(r.kept) for r in got.collect())


def test_substrings_leave_no_levels_on_the_disk(spark):
    # only what the result reads stays: the levels and the shuffles that made them are gone
    import glob
    import os
    from playlake.session import scratch_path
    folder = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    rows = corpus(6, 30)
    got = dedup_substrings(docs(spark, rows), n=7)
    new = {os.path.basename(x).rsplit("-", 1)[0] for x in set(glob.glob(f"{folder}/*")) - before}
    assert new == {"copies", "repeated", "keys"}
    assert got.count() == len(rows)


def _lines(rows, divisor=2):
    """dedup_lines in plain Python."""
    import hashlib
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    chunks = []
    for no, (doc, text) in enumerate(rows):
        if text is None:
            continue
        ls = text.split("\n")
        f = [False] + [(h(ls[i - 1]) * 31 + h(ls[i])) % 2**31 % divisor == 0 for i in range(1, len(ls))]
        start = 0
        for i in range(len(ls)):
            if i == len(ls) - 1 or (f[i] and not f[i - 1]):
                if i > start:
                    chunks.append(((doc is None, doc or 0), no, start, i, "\n".join(ls[start:i + 1])))
                start = i + 1
    first, gone = {}, {}
    for key, no, a, b, body in sorted(chunks, key=lambda c: (c[0], rows[c[1]][1], c[2])):
        place = (key, rows[no][1], a)
        if first.setdefault(body, place) != place:
            gone.setdefault(no, set()).update(range(a, b + 1))
    return [(doc, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(no, ())),
             0 if t is None else len(t.split("\n")), len(gone.get(no, ()))) for no, (doc, t) in enumerate(rows)]


def test_lines_match_plain_python(spark):
    r = random.Random(8)
    line = lambda: " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 6)))
    passage = [line() + " shared" for _ in range(12)]
    rows = []
    for i in range(40):
        ls = [line() for _ in range(r.randint(1, 12))]
        if i % 2:
            at = r.randrange(len(ls))
            ls[at:at] = passage[r.randint(0, 2):]
        rows.append((i, "\n".join(ls)))
    rows += [(100, rows[1][1]), rows[3], (101, None), (102, ""), (103, "\n\n\n"), (104, "\n\n\n"), (105, "same\n" * 3000),
             (106, "one line only"), (107, "one line only"), (None, rows[5][1])]
    got = dedup_lines(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns + ["n_lines", "n_removed"]
    want = _lines(rows)
    assert sorted(map(str, ((x.doc_id, x.text, x.n_lines, x.n_removed) for x in got.collect()))) == sorted(map(str, want))
    assert any(x[3] for x in want)


def test_lines_removed_behind_a_shift(spark):
    passage = "\n".join(f"passage line {i}" for i in range(40))
    rows = [(1, "intro\n" + passage), (2, "a\nb\nc\n" + passage + "\nend"), (3, passage)]
    out = {x.doc_id: x for x in dedup_lines(docs(spark, rows)).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed >= 30 and out[3].n_removed >= 30
    assert out[2].text.startswith("a\nb\nc") and out[2].text.endswith("end")


def test_column_names_that_are_taken(spark):
    d = docs(spark, [(1, "a\nb")]).withColumn("n_lines", F.lit(7)).withColumn("lines", F.lit(8))
    out = dedup_lines(d)
    assert out.columns == d.columns + ["_n_lines", "n_removed"] and out.first().lines == 8


def test_empty_tables(spark):
    none = docs(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = docs(spark, [(1, "a b c"), (2, None)])
    assert near_duplicates(none).count() == 0
    assert dedup_lines(none).count() == 0
    assert dedup_substrings(none).count() == 0
    assert contamination(none, items).count() == 0
    got = contamination(some, items.limit(0)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 3, 0, False), (2, 0, 0, False)]
