"""Vectors, urls, archives, mixing and personal data against plain Python, with the awkward inputs."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from brute import personal, sha, space_words
from pyspark.sql import functions as F

import playlake.llm.ann as ann
import playlake.llm.pii as pii
import playlake.llm.urls as urls
import playlake.llm.warc as warc
from playlake.llm.mixing import mix_documents, mix_plan

# ---------------------------------------------------------------- nearest


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS vec", "3 AS bucket")


def exact(rows, queries, k):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and i is not None
          and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i in queries:
        if i in ok:
            d = sorted((float(np.sqrt(((ok[i] - v) ** 2).sum())), j) for j, v in ok.items() if j != i)
            out[i] = d[:k]
    return out


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]  # one vector held by many rows
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    v = vectors(spark, rows)
    got = ann.nearest(v, v.where("vec_id % 50 = 0"), k=10).collect()
    want = exact(rows, range(0, 3000, 50), 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hit = 0
    for q, near in want.items():
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
        hit += len({i for _, i in near} & {i for _, _, i in mine})
        truth = dict((i, d) for d, i in exact(rows, [q], 3000)[q])
        assert all(abs(truth[i] - s) < 1e-9 for _, s, i in mine)
    assert hit >= 0.9 * 10 * len(want)
    # the smallest ids of the copies come first
    assert [i for _, _, i in sorted(found[100])] == list(range(101, 111))


def test_nearest_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0]), (200, None), (8, [1.0, 2.0, 3.0])]
    v = vectors(spark, rows)
    got = ann.nearest(v, v.where("vec_id % 100 = 0"), k=10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert ann.nearest(v.limit(0), v, 3).count() == 0
    assert ann.nearest(v, v.limit(0), 3).count() == 0
    assert ann.nearest(v.where("vec_id = 0"), v.where("vec_id = 0"), 3).count() == 0


def test_probes_come_in_order():
    rng = np.random.default_rng(2)
    for _ in range(5):
        p = rng.uniform(-3, 3, 4)
        order = ann.probe_order(p, 200)
        assert len(np.unique(order, axis=0)) == len(order) == 200 and (order[0] == np.floor(p)).all()
        move = order - np.floor(p)
        inside = p - np.floor(p)
        cost = np.where(move > 0, (move - inside) ** 2, np.where(move < 0, (inside - move - 1) ** 2, 0)).sum(axis=1)
        assert (np.diff(cost) >= -1e-12).all()


def test_nearest_in_small_blocks_and_by_scan(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), v) for i, v in enumerate(rng.standard_normal((300, 5)).tolist())]
    v = vectors(spark, rows)
    want = {q: [i for _, i in near] for q, near in exact(rows, range(0, 300, 10), 5).items()}
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(ann, "TASK_QUERIES", 3)
    found = Counter()
    for r in ann.nearest(v, v.where("vec_id % 10 = 0"), k=5).collect():
        found[r.query_id] += r.vec_id in want[r.query_id]
    assert sum(found.values()) >= 0.9 * 150
    monkeypatch.setattr(ann, "_probe_count", lambda *a: None)
    monkeypatch.setattr(ann, "EXACT_QUERIES", 7)
    got = {}
    for r in sorted(ann.nearest(v, v.where("vec_id % 10 = 0"), k=5).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


# ---------------------------------------------------------------- urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("a.com", "/de/x", "allow"), ("com", "/de/", "allow"), (None, "/", "block")]


def judge(url, rules, default="allow"):
    import re
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules
            if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    us = ["http://Example.ORG/es/1", "https://m.example.org/en/12", "https://m.example.org/en/22?x=/en/1", "http://x.com/de/",
          "http://a.com/de/xy", "http://b.a.com/de/xy#q", "http://com/fr/", "http://fooexample.org/es/", "http://org", "http://org?/",
          "no scheme/es/", "", None, "x://", "http://a://b.org/es/", "http://ÄB.org/é/日", "http://x.com/de", "://org/",
          "http://" + "a." * 3000 + "org/" + "p" * 5000, "http://x.org/a\nb", "HTTP://user@x.com:80/fr/"]
    rows = [(i, u) for i, u in enumerate(us)] + [(3, us[3]), (3, us[3]), (None, us[0]), (None, None), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS host", "'v' AS verdict", "1 AS n")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.filter_urls(pages, rules).collect()
    want = [(i, *judge(u, RULES)) for i, u in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


# ---------------------------------------------------------------- archives


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    big = "".join(random.Random(1).choice("ab<é日>\r\n") for _ in range(200_000))
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", big),
            (6, "u", big), (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (8, "ü 日", "\r\n\r\n"), (None, "n", "null id"),
            (None, "n", "<p>x</p>"), (9, "u", "y" * 64), (9, "u", "y" * 64), (10, "u", "y" * 64)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'s' AS size")
    archives = warc.write_warc(pages, folder=str(tmp_path / "w"), chunk_bytes=1000, file_bytes=2000)
    back = warc.read_warc(spark, archives, chunk_bytes=777).collect()
    payload, last = {}, Counter()
    for r in sorted(back, key=lambda r: r.chunk_no):
        if r.record_type == "response":
            key = (r.file, r.record_id) if r.record_id not in ("<urn:page:9>",) else None
            if key:
                payload[key] = payload.get(key, b"") + bytes(r.data)
                assert r.payload_digest == b32(payload[key]) and r.payload_bytes == len(payload[key])
        if r.last:
            last[(r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)] += 1
    n = lambda i: f"<urn:page:{'null' if i is None else i}>"
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and i != f
        want[(n(i), "revisit" if revisit else "response", n(f) if revisit else None, len(data), b32(data))] += 1
    assert last == want
    assert {v for v in payload.values()} >= {big.encode(), b"<p>x</p>", b"", b"\r\n\r\n", b"null id"}
    # any gzip reader can unpack the files, and there are several
    files = [r.file for r in archives.collect()]
    raw = b"".join(gzip.open(f.removeprefix("file:"), "rb").read() for f in files)
    assert raw.count(b"WARC-Type: ") == len(rows) and len(files) > 1 and b"\r\nX: y" not in raw
    ends = warc.read_warc(spark, archives, with_data=False).collect()
    assert len(ends) == len(rows) and all(r.last and r.data is None for r in ends)


def test_warc_small_payloads_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    read = lambda a: warc.read_warc(spark, a, with_data=False).collect()
    assert {r.record_type for r in read(warc.write_warc(pages, min_bytes=3))} == {"response"}
    assert read(warc.write_warc(pages.limit(0))) == []


def test_warc_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    a = warc.write_warc(pages, folder=str(tmp_path / "d"))
    f = a.first().file
    data = gzip.open(f.removeprefix("file:"), "rb").read()
    with gzip.open(f.removeprefix("file:"), "wb") as out:
        out.write(data.replace(b"abc\r\n", b"abd\r\n"))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, a).collect()


# ---------------------------------------------------------------- mixing


def fill(sizes, weights, share, rate):
    """Targets by dealing the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, target = share * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        target.update({s: left * w[s] / total for s in rest})
        over = [s for s in rest if target[s] >= rate * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = rate * sizes[s]
            left -= target[s]
            full.add(s)
        if len(full) == len(names):
            return target


def test_mixing(spark):
    r = random.Random(7)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 40))) or None, "en",
             r.choice(["hot"] * 5 + ["b", "c", "Z", "é", "", None, "tiny"]), 1) for i in range(4000)]
    rows += [(5000, "x", "en", "only blank", 1), (5001, " \n", "en", "nothing", 1), (None, "a b", "en", "b", 1),
             (None, "a b", "en", "b", 1), (7, "long " * 20_000, "en", "long", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS size", "2 AS rate", "3 AS copy", "4 AS s")
    plan = mix_plan(docs).collect()
    assert len(plan) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(space_words(t))
    want = fill(sizes, (3, 1, 2), 1.5, 2.0)
    for p in plan:
        assert p.source_size == sizes[p.source] and abs(p.target - want[p.source]) < 1e-6 * max(1, want[p.source])
        assert p.taken == p.size * p.copies and p.copies <= 2
        taken[p.source] += p.taken
    for s in ("hot", "b", "c", "Z", "é", ""):
        assert abs(taken[s] - want[s]) < 0.15 * want[s]
    assert sorted(map(str, plan)) == sorted(map(str, mix_plan(docs.repartition(5)).collect()))
    out = mix_documents(docs)
    assert out.columns == docs.columns + ["_copy"]
    got = Counter(str((x.doc_id, x.text)) for x in out.collect())
    copies = Counter()
    for p, _ in zip(mix_plan(docs).join(docs.select("doc_id", "text").distinct(), "doc_id", "left").collect(), range(10**9)):
        copies[str((p.doc_id, p.text))] += p.copies
    assert got["(5000, 'x')"] == copies["(5000, 'x')"] and sum(got.values()) == sum(p.copies for p in plan)
    assert mix_plan(docs.limit(0)).count() == 0 and mix_documents(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- personal data

TEXTS = [
    "mail bob@example.com, or a.b+c%d@x-y.co.uk; and q@r then s@t.u%v@w.x", "ip 10.0.0.1 300.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 9.9.9",
    "card 4111 1111 1111 1111 and 4111111111111112 4012-8888-8888-1881 12345678901234", "call +1 (212) 555-0100. or +44 20 7946 0958 +123 +1234567890123456",
    "é日 ünï +49 (30) 901820-0 x@日.de y@z.de 1.1.1.1", "", None, "no data here", "1" * 3000, "1." * 3000, "a@b" + ".c" * 3000, "+" * 500 + "1 2" * 500,
    "%%%@a.b a@b.c@d.e +1(2)(3)4567890. 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "x" * 100_000, "ab " * 20_000 + "z@z.zz", "0.0.0.0256 256.0.0.0 1.1.1.256",
    "+1 (779) 555-0207+1 (779) 555-0208", "4111 1111 1111 1111 4111 1111 1111 1111", "\t\n\x0b a@b.cd\x0b+1 234 567 8901\n",
]


def test_base_spans(spark):
    r = random.Random(3)
    bits = list("0123456789.@+-() abAé%") + ["4111111111111111", "@b.c", "+1 234", "1.2.3.4"]
    texts = TEXTS + ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    rows = list(enumerate(texts)) + [(0, TEXTS[0]), (0, TEXTS[0]), (None, TEXTS[1]), (None, TEXTS[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS start", "3 AS id", "4 AS x")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    want = Counter((i, personal(t)) for i, t in rows)
    assert Counter((g.doc_id, g.base) for g in got) == want
    for g in got:
        b = g.base.split(",") if g.base else []
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(x.startswith(k) for x in b) for k in pii.KINDS]
        assert set(b) <= set(g.spans.split(",")) or not b
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_contexts_reveal_identifiers(spark):
    rows = [(i, f"please phone: +1 212 555 01{i:02d} now") for i in range(12)]
    rows += [(20, "please phone: 555-0199 now"), (21, "part no 555-0198 in stock"), (22, "phone: see 5 now"), (23, None)]
    rows += [(30 + i, f"write to box {i}@here today") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g.doc_id: g for g in pii.personal_data(docs).collect()}
    assert got[20].spans == "phone:14:22" and got[20].base == "" and got[20].n_phone == 0
    assert all(got[i].spans == got[i].base for i in got if i != 20)


def test_values_not_yet_found_are_no_evidence_against_a_context(spark):
    rows = [(i, f"please phone: +1 212 555 01{i:02d} now") for i in range(5)]
    rows += [(i, f"please phone: 555-0{i} now") for i in range(140, 180)]
    rows += [(200, "please phone: 555 01 99 now"), (201, "please phone: (212) 555-0177 now")]
    # the word before has as many seeds, but what follows it is mostly no phone
    rows += [(300 + i, f"about +1 212 556 01{i:02d} ok") for i in range(5)] + [(400 + i, f"about {i} kg") for i in range(20)]
    rows += [(500, "about 555-0188 then")]
    # base values of another kind speak against a context too
    rows += [(600 + i, f"seen +1 212 557 01{i:02d} x") for i in range(3)] + [(700 + i, f"seen 10.0.0.{i} y") for i in range(9)]
    rows += [(800, "seen 555-0199 z")]
    got = {g.doc_id: g.spans for g in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "phone:14:22" for i in range(140, 180))
    assert got[200] == "phone:14:23" and got[201] == "phone:14:28"
    assert got[500] == "" and got[800] == "" and all(got[400 + i] == "" for i in range(20))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a@b.cd é +1 234 567 8901 end"), (2, "none"), (3, None)], "doc_id long, text string")
    d = docs.select("text", *pii.row_keys(F.col("doc_id"), F.col("text")))
    base, more = pii.find_spans(d.select("k1", "k2", "text"))
    out = {r.doc_id: r.text for r in pii.redact(docs, base.unionByName(more)).collect()}
    assert out == {1: "[email] é [phone] end", 2: "none", 3: None}


def test_digest_of_no_spans(spark):
    assert spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0] == sha("")


def test_clear_mentions_by_one_sweep(spark):
    r = random.Random(21)
    spans = [(r.randint(0, 2), a, a + r.randint(1, 9)) for a in (r.randint(0, 300) for _ in range(120))]
    rows = [(r.randint(0, 3), a, a + r.randint(1, 12)) for a in (r.randint(0, 300) for _ in range(400))]
    frame = lambda x: spark.createDataFrame([(k, 0, a, b) for k, a, b in x], "k1 long, k2 long, start long, stop long")
    got = sorted((x.k1, x.start, x.stop) for x in pii._clear(frame(rows), frame(spans)).collect())
    assert got == sorted((k, a, b) for k, a, b in rows if not any(k == s and c < b and d > a for s, c, d in spans))


def test_one_text_with_many_addresses_takes_linear_time(spark):
    import time

    def seconds(n):
        text = " ".join(f"mail user{i}@host{i % 97}.example.org or call 555-{i % 10000:04d} now" for i in range(n))
        t = time.time()
        x = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert x.n_email == n
        return time.time() - t

    seconds(100)
    assert seconds(12_000) < 3 * seconds(3_000) + 10


def test_mixing_leaves_documents_in_place(spark):
    docs = spark.createDataFrame([(i, "a b", "hot" if i % 3 else "b", i) for i in range(50)],
                                 "doc_id long, text string, source string, n long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for out in (mix_plan(docs), mix_documents(docs)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
