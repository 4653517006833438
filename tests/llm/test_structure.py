"""Conversations, source divergence and byte-level BPE against plain Python, with the awkward inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import lower, sha
from pyspark.sql import functions as F

import playlake.llm.bpe as bpe
import playlake.llm.divergence as divergence
import playlake.llm.turns as turns

# ---------------------------------------------------------------- conversations

AFTER = {"": "us", "s": "u", "u": "a", "a": "u"}


def cheapest_script(rows):
    """(cost, audit, repaired lines) by trying every script of (role, text, must go, truncated) rows."""
    @lru_cache(None)
    def best(i, last, inserted):
        ways = []
        if i == len(rows):
            if last in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text, gone, cut = rows[i]
            later = best(i + 1, last, 0)
            if later:
                ways.append((later[0] + 4, "D" + later[1], later[2]))
            if not gone:
                for new, cost, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    initial = new[:1]
                    if initial and initial in AFTER[last]:
                        later = best(i + 1, initial, 0)
                        if later:
                            ways.append((later[0] + cost + 3 * cut, letter + later[1], (f"{new}:{text}",) + later[2]))
        if inserted < 2:
            for new in ("user", "assistant"):
                if new[0] in AFTER[last]:
                    later = best(i, new[0], inserted + 1)
                    if later:
                        ways.append((later[0] + 3, "I" + later[1], (f"{new}:",) + later[2]))
        return min(ways) if ways else None
    return best(0, "", 0)


def faults(rows):
    """(role, text, must go, truncated) and the counts of blank, duplicate and truncated of (role, text) rows."""
    seen, out, n = set(), [], Counter()
    for role, text in rows:
        word = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        kind = "blank" if not word.strip(" \t\n\r\x0b\x0c") else "duplicate" if (role, text) in seen else \
            "truncated" if word[-1] not in ".!?" else ""
        seen.add((role, text))
        n[kind] += 1
        out.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
    return out, n


def repaired(rows):
    """What the report and the digest say of (turn, role, text) rows in order."""
    todo, n = faults([r[1:] for r in rows])
    cost, audit, lines = cheapest_script(tuple(todo))
    t = [r[0] for r in rows if r[0] is not None]
    gaps = max(t) - min(t) + 1 - len(set(t)) if t else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(lines)))


def reported(spark, rows):
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .selectExpr("*", "'x' AS conv", "1 AS at", "2 AS audit", "3 AS h1")
    repair = turns.repair_conversations(convs)
    hashes = {r.conv: r.repaired_sha256 for r in repair.digests().collect()}
    out = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes[r.conv])
           for r in repair.report.collect()}
    lines: dict = {c: [] for c in out}
    for r in repair.turns().orderBy("conv", "number").collect():
        assert r.number == len(lines[r.conv])
        lines[r.conv].append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(x)) for c, x in lines.items()} == hashes
    return out


def test_cheapest_is_the_least_of_all_scripts():
    rnd = random.Random(3)
    for _ in range(400):
        rows = tuple((rnd.choice("suax"), "t", rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(0, 7)))
        rows = tuple((i, t, gone, cut and not gone) for i, t, gone, cut in rows)
        named = tuple(({"s": "system", "u": "user", "a": "assistant", "x": "xenon"}[i], t, g, c) for i, t, g, c in rows)
        found = turns.cheapest([(i, g, c) for i, _, g, c in rows], turns.EMPTY)
        got = min(x for x in (found[s] for s in turns.FINAL) if x)
        assert got == cheapest_script(named)[:2]


def test_conversations_match_plain_python(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK_BITS", 3)  # conversations over many blocks
    monkeypatch.setattr(turns, "BLOCK_ROWS", 8)
    monkeypatch.setattr(turns, "FAN_IN", 2)
    rnd = random.Random(5)
    texts = ["Yes.", "No!", "why", "", " \t", "Well?  ", "one. two", "é.", "Yes. "]
    rows = []
    for conv in [*range(30), None]:
        n = 61 if conv == 7 else rnd.randint(1, 9)
        used = rnd.sample(range(200), n)
        for t in used:
            rows.append((conv, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]),
                         f"{t} " * rnd.randint(0, 1) + rnd.choice(texts)))
    rows += [(40, 1, "user", None), (40, 2, None, "Hello."), (41, None, "user", "Hi."), (41, 3, "assistant", "Ho."),
             (42, 1, "user", "Hi."), (42, 1, "user", "Hi."), (42, 1, "user", "Hi."), (42, 2, "assistant", "x" * 200_000 + ".")]
    want: dict = {}
    for conv, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(None if conv is None else str(conv), []).append((t, role or ("" if role == "" else " "),
                                                                        " " if text is None else text))
    assert reported(spark, rows) == {c: repaired(r) for c, r in want.items()}


def test_conversations_empty_table(spark):
    assert reported(spark, []) == {}


def test_damage_is_by_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (1, None) for t in [*range(60), None]]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in turns.damaged(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want: Counter = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c, t, "user" if k == 4 else role, {1: "", 2: "One Two"}.get(k, text)] += {0: 0, 3: 2}.get(k, 1)
    assert got == +want


# ---------------------------------------------------------------- divergence


def diverging(rows, min_docs, top):
    """Rows of the audit of (lang, source, text) documents."""
    here: dict = {}
    docs: Counter = Counter()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        here.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, groups in here.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, own = p(whole), {s: p(c) for s, c in groups.items()}
        for s in groups:
            pair = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(own[s][t] - q[t], t) for t in kept if groups[s][t] > 0 and own[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_divergence_matches_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    monkeypatch.setattr(divergence, "FAN_IN", 2)
    monkeypatch.setattr(divergence, "CELLS", 50)
    monkeypatch.setattr(divergence, "MAX_COUNTS", 300)
    monkeypatch.setattr(divergence, "SLICE", 64)
    rnd = random.Random(2)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(90)] + ["été", "你好", "Züge", "\U0001f600x"]
    rows = []
    for _ in range(150):
        lang, source = rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c", None])
        text = " ".join(words[min(int(rnd.expovariate(0.05)), len(words) - 1)] for _ in range(rnd.randint(0, 80)))
        rows.append((lang, source, text.upper() if rnd.random() < 0.2 else text))
    rows += [("en", "no words", "12 34"), ("en", "null", None), ("xx", "one", "rare word"), ("xx", "two", ""), ("yy", "alone", "x"),
             ("en", "a", "common-word_and:More " * 3000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string") \
        .selectExpr("*", "1 AS term", "2 AS salt", "'x' AS item")
    got = sorted(tuple(r) for r in divergence.divergence(docs, min_docs=5, top=12)
                 .select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == diverging(rows, 5, 12)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence(docs).collect() == []


def test_skyband_keeps_what_few_dominate():
    rng = np.random.default_rng(4)
    for k in (1, 3):
        here, whole = rng.integers(0, 30, 700), rng.integers(0, 30, 700)
        place = rng.permutation(700)
        dominated = [sum((here >= here[i]) & (whole <= whole[i]) & (place < place[i])) for i in range(700)]
        assert divergence.skyband(here, whole, place, k, step=64).tolist() == [n < k for n in dominated]


def test_shares_are_exact_beyond_64_bits():
    c = np.array([0, 1, 10 ** 13])
    assert divergence.shares(c, 10 ** 13 + 1, 3).tolist() == [1 + 10 ** 9 * (int(x) + 5) // (10 ** 13 + 1 + 15) for x in c]


# ---------------------------------------------------------------- byte-level BPE

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_replay_matches_the_library(library):
    ranks = bpe.load_ranks(PATH)
    merges, tokens, rnd = bpe.Merges(ranks), list(ranks), random.Random(6)
    pieces = [b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    pieces += [b"a" * 3000, b"ab" * 2000, bytes(range(256)) * 3, b"\xff", b""]
    assert bpe.replay(pieces, merges) == [library._encode_single_piece(p) if p else [] for p in pieces]


def test_a_pair_of_lower_rank_goes_first():
    # "bc" has a higher rank than "abc", which only a merge of "bc" behind an "a" makes
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bc": 400, b"abcd": 401, b"cbc": 402}
    plain = tiktoken.Encoding("test", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    pieces = [b"abcbcabcabcbcd", b"bcabcbc", b"cbcabcdbc"]
    assert bpe.replay(pieces, bpe.Merges(ranks)) == [plain._encode_single_piece(p) for p in pieces]


def test_documents_match_the_library_and_come_back(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 500)  # many chunks
    monkeypatch.setattr(bpe, "LONG_TEXT", 2000)
    monkeypatch.setattr(bpe, "INDEX_BYTES", 100)
    rnd = random.Random(8)
    some = ["hello", " world", "你好", "\n\n  ", "don't", "x" * 50, "3.14", "\U0001f600", "<|endoftext|>", " ", "\x1c", "؀", " "]
    texts = ["".join(rnd.choices(some, k=rnd.randint(0, 40))) for _ in range(60)]
    texts += [None, "", " ", "same", "same", "long " * 2000, "y" * 5000]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS piece", "3 AS place")
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in
                  bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect())
    want: Counter = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()] += 1
    assert got == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect() == []


def test_every_character_is_split_as_the_library_does(library):
    merges = bpe.Merges(bpe.load_ranks(PATH))
    cut = bpe.regex.compile(public_tokenizers.PATTERN)
    for c in [*range(0, 0x3000), 0xFEFF, 0x1D7CE, 0x10FFFF, 0x1E950, 0x1FBF0]:
        s = f"a{chr(c)}1 {chr(c)}{chr(c)}b,  {chr(c)}!"
        assert [i for x in bpe.replay([w.encode() for w in cut.findall(s)], merges) for i in x] == library.encode_ordinary(s), c


def test_digest_columns(spark, tmp_path):
    from playlake.llm.q_structure import op13

    spark.createDataFrame([(1, "ab cd")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = op13(spark, str(tmp_path)).first()
    assert r.decoded_sha256 == sha("ab cd") and len(r.ids_sha256) == 64
    assert spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0] == hashlib.sha256(b"").hexdigest()
