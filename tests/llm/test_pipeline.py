"""The quality model against a plain Kneser-Ney model, and the pipeline stage by stage."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from brute import components, contaminated
from pyspark.sql import functions as F

import corpus_pipeline
import playlake.llm.quality as quality
import playlake.llm.wordmodel as wordmodel

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kneser_ney(words: Counter, n: int):
    orders = {n: Counter()}
    for w, k in words.items():
        for g in quality.word_grams(w, n):
            orders[n][g] += k
    for k in range(n - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    types = len(orders[1])
    p, gamma = {}, {}
    for k in range(1, n + 1):
        c = orders[k]
        nn = Counter(v for v in c.values() if v <= 4)
        d = wordmodel.FALLBACK
        if nn[1] and nn[2] and nn[3]:
            y = nn[1] / (nn[1] + 2 * nn[2])
            own = tuple(i - (i + 1) * y * nn[i + 1] / nn[i] for i in (1, 2, 3))
            d = own if all(0 < own[i - 1] <= i for i in (1, 2, 3)) else d
        total, spare = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            spare[g[:-1]] += d[min(v, 3) - 1]
        gamma[k] = {h: spare[h] / total[h] for h in total}
        p[k] = {g: (v - d[min(v, 3) - 1]) / total[g[:-1]] + gamma[k][g[:-1]] * (p[k - 1][g[1:]] if k > 1 else 1 / (types + 1))
                for g, v in c.items()}

    def prob(g):
        if not g:
            return 1 / (types + 1)
        k = len(g)
        return p[k][g] if g in p[k] else gamma[k].get(g[:-1], 1.0) * prob(g[1:])

    return prob, p, gamma


def test_model_matches_plain_python(spark):
    r = random.Random(1)
    words = Counter("".join(r.choice("aabbbcde") for _ in range(r.randint(1, 6))) for _ in range(800))
    n = 4
    counts = spark.createDataFrame([(g, k) for w, k in words.items() for g in quality.word_grams(w, n)], "gram string, cnt long")
    model = quality.kneser_ney(counts, n)
    prob, p, _ = kneser_ney(words, n)
    for k in range(1, n + 1):
        got = {x.gram: x.p for x in model[k - 1][0].collect()}
        assert got.keys() == p[k].keys() and all(math.isclose(got[g], p[k][g], rel_tol=1e-9) for g in got)
    # all continuations of a context together are a distribution, but for the share of unseen characters
    grams = sorted({g for w in ["abcab", "zzz", "aé", "", "c"] for g in quality.word_grams(w, n)})
    types = model[0][0].count()
    logs = quality.gram_logs(spark.createDataFrame([(g,) for g in grams], "gram string"), model, types).collect()
    assert len(logs) == len(grams) and all(math.isclose(x.logp, math.log(prob(x.gram)), rel_tol=1e-9) for x in logs)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    sy = ["ta", "ko", "ri", "men", "lu", "sa", "vor", "ne"]
    vocabulary = ["".join(r.choice(sy) for _ in range(r.randint(1, 3))) for _ in range(150)]
    text = lambda k: "\n".join(" ".join(r.choice(vocabulary) for _ in range(9)) for _ in range(k))
    junk = lambda: " ".join("".join(r.choice("#$%qxzjW!") for _ in range(6)) for _ in range(40))
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(20))) for i in range(5)]
    passage = text(12)
    rows, kinds = [], {}
    for i in range(160):
        t, kind = text(r.randint(3, 9)), "clean"
        if i % 10 == 3:
            t, kind = junk(), "junk"
        elif i % 10 == 5:
            w = rows[i - 4][1].split(" ")
            w[len(w) // 2] = "sako"
            t, kind = " ".join(w), "near"
        elif i % 10 == 7:
            t, kind = t.split("\n")[0] + " " + items[i % 5][1], "benchmark"
        elif i % 10 == 9:
            t, kind = t + "\n" + passage, "passage"
        rows.append((i, t, "xx" if i % 2 else "yy", f"s{i % 4}" if i % 11 else None, len(t)))
        kinds[i] = kind
    rows += [(500, None, None, None, None), (501, "", "xx", "s1", 0), (502, " \n", "xx", "s1", 2), (None, rows[0][1], "xx", "s0", 3),
             rows[2], rows[2]]
    labels = [(i, 0 if kinds[i] == "junk" else 1, 0) for i in range(160) if i % 3 and kinds[i] in ("junk", "clean")]
    d = spark.createDataFrame(rows, DOCS)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), \
        spark.createDataFrame(items, "item_id long, text string"), kinds, rows, items


@pytest.fixture(scope="module")
def folder(corpus, tmp_path_factory):
    d, labels, items, *_ = corpus
    out = tmp_path_factory.mktemp("tables")
    for name, t in (("documents", d), ("labels", labels), ("benchmark", items)):
        t.write.parquet(f"{out}/{name}.parquet")
    return str(out)


def test_quality_rejects_junk_and_keeps_clean(spark, corpus, folder):
    d, labels, _, kinds, rows, _ = corpus
    out = quality.score_quality(d.selectExpr("*", "1 AS n", "2 AS id", "'g' AS gram"), labels).collect()
    assert len(out) == len(rows)
    by = {x.doc_id: x for x in out}
    assert all(by[i].rejected for i, k in kinds.items() if k == "junk")
    clean = [by[i].rejected for i, k in kinds.items() if k == "clean"]
    assert sum(clean) <= 0.03 * len(clean)
    assert all(by[i].perplexity is None and not by[i].rejected for i in (500, 501, 502))
    whole = {x.doc_id: x.perplexity for x in out if x.doc_id is not None and x.perplexity}
    shards = quality.score_quality(d, labels, shard_grams=200).collect()
    assert len(shards) == len(rows)
    assert all(math.isclose(x.perplexity, whole[x.doc_id], rel_tol=1e-9) for x in shards if x.doc_id in whole)


@pytest.fixture(scope="module")
def sentences():
    """Texts in which each word tells the next, and labels of all but the last."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 6))) for _ in range(60)]
    follow = {w: r.sample(words, 2) for w in words}

    def text(k):
        out = [r.choice(words)]
        while len(out) < k:
            out.append(r.choice(follow[out[-1]]))
        return out
    texts = [text(r.randint(40, 80)) for _ in range(400)]
    return texts, [(i, 1, 0) for i in range(360)]


def test_word_order_and_repetition_count(spark, sentences):
    texts, labels = sentences
    r = random.Random(12)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(1000 + i, " ".join(r.sample(w, len(w)))) for i, w in enumerate(texts[360:])]
    rows += [(2000 + i, " ".join([w[0]] * 2000)) for i, w in enumerate(texts[360:370])]
    d = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], DOCS)
    out = {x.doc_id: x for x in quality.score_quality(
        d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(out[i].rejected for i in out if i >= 1000)
    assert sum(out[i].rejected for i in range(360, 400)) <= 2


def test_a_toxic_passage_in_clean_text_is_rejected(spark, sentences):
    texts, labels = sentences
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(1000 + i, " ".join([*w[:20], "zqxvk", *w[20:]])) for i, w in enumerate(texts[360:])]
    rows += [(2000 + i, " ".join([*w, *texts[i], *w, "you", "utter", "moron", *texts[i + 1], *w]))
             for i, w in enumerate(texts[360:380])]
    d = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], DOCS)
    out = {x.doc_id: x for x in quality.score_quality(
        d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(out[i].rejected for i in out if i >= 1000)
    assert sum(out[i].rejected for i in range(360, 400)) <= 2


def test_bounds_are_quantiles_where_counts_support_them(spark):
    r = random.Random(14)
    names = "lang string, n long, cost double, spelling double, repeats double, run1 double, run3 double"
    rows = [("many", 1, x, x, 0.0, x, x) for x in (r.gauss(5, 1) for _ in range(4000))]
    rows += [("few", 1, x, x, 0.0, x, x) for x in (r.gauss(5, 1) for _ in range(40))]
    got = {x.lang: x for x in quality.thresholds(spark.createDataFrame(rows, names), 0.0025, 0.995).collect()}
    assert 7.3 < got["many"].cost < 7.9 and 7.3 < got["many"].run1 < 7.9 and 1.9 < got["many"].spelling < 2.5
    assert got["many"].repeats == 0.0 and got["few"].repeats > 0.3
    assert got["few"].cost > 7.5 and got[None].cost < 8


@pytest.mark.parametrize("shard_grams, chunk", [(1_000_000, 2 ** 23), (5, 200)])
def test_word_model_matches_plain_python(spark, monkeypatch, shard_grams, chunk):
    # costs of places against the plain model, with words as units and spelling below them
    monkeypatch.setattr(wordmodel, "CHUNK_BYTES", chunk)  # one chunk, or many
    r = random.Random(13)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(60)]
    grams = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split()]
        grams.update(zip(w, w[1:], w[2:]))
    share = {g: 0.01 * (i + 1) for i, g in enumerate(sorted({g for w in [*words, "new"] for g in quality.word_grams(w, 3)}))}
    spelt = {w: math.prod(share[g] for g in quality.word_grams(w, 3)) for w in [*words, "new"]}
    orders = {3: grams}
    for k in (2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    p, gamma = {}, {}
    for k in (1, 2, 3):
        c = orders[k]
        nn = Counter(v for v in c.values() if v <= 4)
        d = wordmodel.FALLBACK
        if nn[1] and nn[2] and nn[3]:
            y = nn[1] / (nn[1] + 2 * nn[2])
            own = tuple(i - (i + 1) * y * nn[i + 1] / nn[i] for i in (1, 2, 3))
            d = own if all(0 < own[i - 1] <= i for i in (1, 2, 3)) else d
        total, spare = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            spare[g[:-1]] += d[min(v, 3) - 1]
        gamma[k] = {h: spare[h] / total[h] for h in total}
        p[k] = {g: (v - d[min(v, 3) - 1]) / total[g[:-1]] + gamma[k][g[:-1]] * (p[k - 1][g[1:]] if k > 1 else spelt[g[0]])
                for g, v in c.items()}

    def prob(g):
        k = len(g)
        if not k:
            return None
        below = spelt[g[0]] if k == 1 else prob(g[1:])
        return p[k].get(g, gamma[k].get(g[:-1], 1.0) * below)

    tests = texts[:10] + ["new w1 w2 new new", "w3 w3 w3", "new"]
    rows = [(i, i, 0, "xx", t, False) for i, t in enumerate([*tests, "", None])]
    rows += [(1000 + i, 1000 + i, 0, "xx", t, True) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "id long, k1 long, k2 long, lang string, text string, train boolean").repartition(3)
    logs = spark.createDataFrame([(g, math.log(x)) for g, x in share.items()], "gram string, logp double")
    got = {x.id: x for x in quality.score_documents(d, logs, 3, shard_grams).collect()}
    for i, t in enumerate(tests):
        w = ["<s>", "<s>", *t.split()]
        size = sum(len(x) + 1 for x in t.split())
        assert math.isclose(got[i].cost, -sum(math.log(prob(g)) for g in zip(w, w[1:], w[2:])) / size, rel_tol=1e-9)
        assert math.isclose(got[i].spelling, -sum(math.log(spelt[x]) for x in t.split()) / size, rel_tol=1e-9)
    assert got[len(tests)].cost is None and got[len(tests) + 1].n == 0 and len(got) == len(rows)


def test_quality_without_labels_or_documents(spark, corpus):
    d, labels, *_ = corpus
    assert not any(x.rejected for x in quality.score_quality(d, labels.limit(0)).collect())
    assert quality.score_quality(d.limit(0), labels).count() == 0


def test_stages(spark, corpus, folder):
    d, _, items, kinds, rows, item_rows = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]
    stage = dict(corpus_pipeline.STAGES)
    q = stage["quality"](spark, d, folder)
    assert q.columns == d.columns
    assert {i for i, k in kinds.items() if k == "junk"}.isdisjoint(x.doc_id for x in q.collect())
    ln = stage["line_dedup"](spark, d, folder)
    assert ln.columns == d.columns and dict(ln.dtypes) == dict(d.dtypes)
    got = {x.doc_id: x for x in ln.collect()}
    passage = [i for i, k in kinds.items() if k == "passage"]
    assert sum(len(got[i].text) < len(rows[i][1]) for i in passage[1:]) == len(passage) - 1
    assert got[passage[0]].text == rows[passage[0]][1] and None not in got  # the copy without id lost all its lines
    nd = [x.doc_id for x in stage["near_dedup"](spark, d, folder).collect()]
    texts = [(i, t) for i, t, *_ in rows]
    want = [i for i, n, c in components(texts, 5, 80) if i is not None and (n == 0 or i == c)]
    assert Counter(nd) == Counter(set(want))
    dc = Counter(x.doc_id for x in stage["decontaminate"](spark, d, folder).collect())
    assert dc == Counter(i for i, n, h, _ in contaminated(texts, item_rows) if not (h and 20 * h >= n))
    mix = stage["mix"](spark, d, folder)
    assert mix.columns == d.columns + ["copy"]


def test_run(spark, corpus, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {x.doc_id for x in out.collect()}
    kinds = corpus[3]
    assert ids and not any(kinds.get(i) in ("junk", "benchmark") for i in ids)
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_run_over_empty_tables(spark, corpus, tmp_path):
    d, labels, items, *_ = corpus
    for name, t in (("documents", d), ("labels", labels), ("benchmark", items)):
        t.limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_one_of_a_group_without_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f", "x", "s", 1), (None, "a b c d e f", "x", "s", 1), (None, None, "x", "s", 1)], DOCS)
    out = corpus_pipeline.near_dedup(spark, d, "")
    assert sorted(str(x.text) for x in out.select(F.col("text")).collect()) == ["None", "a b c d e f"]


def test_all_trusted_documents_train_or_set_thresholds(spark):
    """No share of the labels is left out, however many there are."""
    import inspect
    from playlake.llm import quality as Q
    labels = spark.range(1_100_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    train, held = Q._trusted_ids(labels)
    assert "max_labelled" not in inspect.signature(Q.score_quality).parameters
    assert train.count() + held.count() == 1_100_000 and train.join(held, "id").count() == 0
    assert 0.79 < train.count() / 1_100_000 < 0.81


def test_word_model_goes_in_rounds_of_chunks(spark, monkeypatch):
    # the questions of an eighth of the chunks at a time give the scores that all at once give
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, i, 0, "xx", " ".join(r.choice(words) for _ in range(9)) + " new" * (i % 2), i % 3 == 0) for i in range(90)]
    d = spark.createDataFrame(rows, "id long, k1 long, k2 long, lang string, text string, train boolean").repartition(2)
    grams = {g for w in [*words, "new"] for g in quality.word_grams(w, 3)}
    logs = spark.createDataFrame([(g, -0.1 * len(g) - 0.01 * i) for i, g in enumerate(sorted(grams))], "gram string, logp double")
    monkeypatch.setattr(wordmodel, "CHUNK_BYTES", 300)
    written, save = [], wordmodel.saved
    monkeypatch.setattr(wordmodel, "saved", lambda df, name: written.append(save(df, name)) or written[-1])

    def scores(least):
        monkeypatch.setattr(wordmodel, "ROUND_CHUNKS", least)
        written.clear()
        return {x.id: x for x in wordmodel.score_documents(d, logs, 3).collect()}, [x.count() for x in written]

    whole, once = scores(10 ** 9)
    parts, rounds = scores(1)
    assert once == [90] and len(rounds) == wordmodel.ROUNDS and sum(rounds) == 90 and max(rounds) <= 30
    assert parts == whole


def test_numbers_of_pairs_tell_all_pairs_apart():
    top, shards = 40, 7
    lay = wordmodel.Layout(shards, top)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(1, top + 1), np.arange(1, top + 1)))
    numbers = np.sort(lay.pair(a, b))
    assert len(np.unique(numbers)) == top * top
    found = set()
    for s, _, _, inside in lay.runs(wordmodel.PAIRS, numbers):
        x, y = lay.words(s, inside)
        assert ((x + y) % shards == s).all()
        found |= set(zip(x.tolist(), y.tolist()))
    assert found == set(zip(a.tolist(), b.tolist()))


def test_texts_are_packed_once_as_numbers_of_all_their_words(spark):
    r = random.Random(8)
    texts = ["", None, " a  b\x1fa\u2003\u00e9t\u00e9 \x85", "\n", *[" ".join(r.choice("abcdefgh") * r.randint(1, 12) for _ in range(30)) for _ in range(20)]]
    rows = [(i, i, 0, "xx", t, i % 2 == 0) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "id long, k1 long, k2 long, lang string, text string, train boolean").coalesce(1)
    out = d.mapInArrow(wordmodel._pack(400, 5, 3), wordmodel.PACKED).toPandas()
    got = {}
    for _, chunk in out[out["kind"] == wordmodel.TEXTS].iterrows():
        words, count = [], []
        for _, x in out[(out["kind"] == wordmodel.WORDS) & (out["chunk"] == chunk["chunk"])].sort_values("shard").iterrows():
            words += wordmodel._strings(wordmodel._unzip(x["x"]), wordmodel._dec(x["y"])).to_pylist()
            count += wordmodel._dec(x["z"]).tolist()
        p = wordmodel._places(out[(out["kind"] == wordmodel.TEXTS) & (out["chunk"] == chunk["chunk"])])
        assert len(set(words)) == len(words) and p.sizes.tolist() == [len(w) + 1 for w in words]
        assert count == (np.bincount(p.code, minlength=len(words)) if chunk["train"] else np.zeros(len(words))).tolist()
        for i, x in enumerate(wordmodel.pa.ipc.open_stream(chunk["x"]).read_all()["id"].to_pylist()):
            got[x] = [words[c] for c in p.code[p.owner == i]]
    assert got == {i: (t or "").split() for i, t in enumerate(texts)}


def test_a_chunk_is_scored_in_little_memory(monkeypatch):
    # what a Python worker holds for a chunk at most, by the places of its words
    r, enc, texts, places, words = np.random.default_rng(3), wordmodel._enc, 400, 200_000, 30_000
    layout = wordmodel.Layout(4, 50_000)
    ids = r.permutation(50_000)[:words]
    monkeypatch.setattr(wordmodel, "_chunk_ids", lambda rows, shards: ids)
    code = np.concatenate([np.arange(words), r.integers(0, words, places - words)])
    out = wordmodel.io.BytesIO()
    keys = pa.table({"id": range(texts), "k1": range(texts), "k2": range(texts), "lang": ["xx"] * texts})
    with pa.ipc.new_stream(out, keys.schema) as writer:
        writer.write_table(keys)
    count = np.bincount(code, minlength=words)
    frequent = wordmodel._rank(np.argsort(-count, kind="stable"))
    packed = pd.DataFrame([(0, out.getvalue(), enc(np.full(texts, places // texts)), enc(frequent[code]), enc(count),
                            enc(np.full(words, 7)))], columns=["chunk", "x", "y", "z", "w", "v"])
    asked = list(wordmodel.Wants(wordmodel._places(packed), ids, layout).rows(0))
    counts = lambda m: enc(np.repeat([[1], [9], [2], [1], [1]], m, axis=1).ravel())
    rows = [(0, wordmodel.PAIRS, x[1], counts(len(wordmodel._dec(x[3]))), enc(np.ones(len(wordmodel._dec(x[5]))))) for x in asked]
    rows += [(0, wordmodel.WORDS, i, counts(words // 4), enc(np.full(words // 4, -9.0).view("int64"))) for i in range(4)]
    rows = pd.DataFrame(rows, columns=["chunk", "kind", "shard", "x", "y"])
    stats = {"n1": 100, "n2": 50, "n3": 20, "n4": 10, "total": 10_000, "types": 2_000}
    score = wordmodel._score_chunk(layout, {k: stats for k in (wordmodel.WORDS, wordmodel.PAIRS, wordmodel.TRIPLES)}, [0] * 5)
    tracemalloc.start()
    got = score(packed, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == texts and (got["n"] == 7 * places // texts).all() and got["cost"].between(0, 9).all()
    assert most < 200 * places, most / places


def test_numbers_keep_their_values_when_packed():
    for x in ([], [0], [0, 255, 256], [2 ** 62, 5], [-1, 3, -2 ** 63]):
        assert wordmodel._dec(wordmodel._enc(np.array(x, "int64"))).tolist() == x


def test_a_table_in_buckets_is_not_moved_again(spark):
    with wordmodel.scratch(spark) as write:
        table = write(spark.range(50).selectExpr("CAST(id % 7 AS INT) AS shard", "id"), "counts", "shard", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
        asked = spark.range(20).selectExpr("CAST(id % 7 AS INT) AS shard", "id")
        import pandas as pd
        out = asked.groupBy("shard").cogroup(table.groupBy("shard")).applyInPandas(
            lambda a, b: pd.DataFrame({"n": [len(a)], "m": [len(b)]}), "n long, m long")
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        got = out.collect()
        assert sum(x.n for x in got) == 20 and sum(x.m for x in got) == 50
