"""Personal data: patterns for four kinds, and identifiers that contexts learnt from them reveal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_keys, saved

KINDS = ("email", "ip", "card", "phone")
# Java forms of the four patterns.  Possessive runs and starts tied to the beginning of a run (or the end of the
# last match) find the same matches without going back over long runs of text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried.
TRIGGERS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
# A mention: a run of non-space characters with a digit or @ in it.
MENTION = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
# Groups of digits parted by single spaces, a mention too.
GROUPS = (r"(?<![^\x20\x09-\x0D])[(]?[0-9][0-9().-]*+(?: [(]?[0-9][0-9.-]*[0-9][0-9().-]*+)++(?![A-Za-z0-9@])")
CONTEXT_CHARS = 64
# What a mention must look like to be taken for a kind, apart from its contexts.
SHAPES = {
    "email": r"\A[^@]+@[^@]+\z",
    "ip": r"\A(?:[0-9]{1,3}[.:]){2,7}[0-9]{1,5}\z|\A(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}\z",
    "card": r"\A(?:[0-9][ -]?){11,18}[0-9]\z",
    "phone": r"\A[(]?[0-9](?:[().-]? ?[(]?[0-9]){6,14}\z",
}
# No identifier of these kinds is longer.
MAX_IDENTIFIER = 128
# A pattern is trusted with so many different seeds and this score; an identifier with this one.
MIN_SEEDS, MIN_PATTERN, MIN_IDENTIFIER, ROUNDS = 3, 0.75, 0.75, 3


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    """Whether the digits of ``c`` pass the Luhn check."""
    digits = F.transform(F.split(F.reverse(_digits(c)), ""), lambda x: x.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    octet = lambda p: small(p) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    n = F.length(_digits(value))
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", F.forall(F.split(value, r"\."), octet))
            .when(kind == "card", n.between(14, 19) & _luhn(value))
            .when(kind == "phone", n.between(10, 15)).otherwise(F.lit(True)))


def _matches(docs: DataFrame) -> DataFrame:
    """Every match of the patterns and every mention: k1, k2, kind, start, stop, value, before, after.

    Spark gives matches without places.  A text split at the matches gives
    what lies between them, and running sums of the lengths of both give the
    places, in code points.  ``before`` and ``after`` are the words next to
    a match.
    """
    def parts(kind: str, regex: str, trigger: str) -> list[Column]:
        t = F.when(F.col("text").rlike(trigger), F.col("text"))
        return [F.regexp_extract_all(t, F.lit(regex), F.lit(0)).alias(f"m_{kind}"), F.split(t, regex, -1).alias(f"g_{kind}")]

    every = [(k, PATTERNS[k], TRIGGERS[k]) for k in KINDS] + [("mention", MENTION, "[0-9@]"), ("groups", GROUPS, r"[0-9][().-]* [(]?[0-9]")]
    cols = [c for e in every for c in parts(*e)]
    d = docs.where(F.col("text").rlike("[0-9@]")).select("k1", "k2", F.explode(F.array(F.struct(*cols))).alias("x"))
    d = d.select("k1", "k2", "x.*")
    word = r"[^\x20\x09-\x0D]+"

    def found(kind: str) -> Column:
        gap = lambda i: F.get(F.col(f"g_{kind}"), i)
        last = lambda g: F.regexp_extract(F.right(g, F.lit(CONTEXT_CHARS)), rf"({word})[\x20\x09-\x0D]*\z", 1)
        first = lambda g: F.regexp_extract(F.left(g, F.lit(CONTEXT_CHARS)), rf"\A[\x20\x09-\x0D]*({word})", 1)
        return F.coalesce(F.transform(f"m_{kind}", lambda v, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(gap(i)).cast("long").alias("gap"), v.alias("value"),
            F.lower(last(gap(i))).alias("before"), F.lower(first(gap(i + 1))).alias("after"))),
            F.array().cast("array<struct<kind:string,i:int,gap:bigint,value:string,before:string,after:string>>"))

    d = d.select("k1", "k2", F.concat(*[found(k) for k, _, _ in every]).alias("found")).where(F.size("found") > 0)
    # rows that repeat a text and id are one here; places are summed in the partitions this makes
    d = d.dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("found").alias("x")).select("k1", "k2", "x.*")
    w = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    stop = F.sum(F.col("gap") + F.length("value")).over(w)
    return d.select("k1", "k2", "kind", (stop - F.length("value")).alias("start"), stop.alias("stop"), "value",
                    "before", "after")


def _clear(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The ``rows`` (k1, k2, start, stop, ...) that overlap none of ``spans``, by one sweep along each text.

    At the stop of a row, all spans that start before it have been passed;
    it is clear if none of them reaches beyond its start.
    """
    asked = rows.select("*", F.col("stop").alias("at"), F.lit(0).alias("passed"), F.lit(None).cast("long").alias("reach"))
    passed = spans.select("k1", "k2", F.col("start").alias("at"), F.lit(1).alias("passed"), F.col("stop").alias("reach"))
    w = Window.partitionBy("k1", "k2").orderBy("at", "passed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = asked.unionByName(passed, allowMissingColumns=True).withColumn("reach", F.max("reach").over(w))
    return every.where((F.col("passed") == 0) & (F.col("reach").isNull() | (F.col("reach") <= F.col("start")))).select(*rows.columns)


def _candidates(mentions: DataFrame, base: DataFrame) -> DataFrame:
    """Mentions without outer punctuation, away from all base spans, once for each kind whose shape they have.

    Mentions of no kind's shape come back with the kind ``other``.  Groups
    of digits count if they have a shape, and then for the mentions in them.
    """
    lead = F.length(F.regexp_extract("value", r"\A[^A-Za-z0-9(]*", 0))
    trail = F.length(F.regexp_extract("value", r"[^A-Za-z0-9]*\z", 0))
    m = mentions.select("*", lead.alias("lead"), trail.alias("trail")).where("lead + trail < length(value)")
    m = m.select("k1", "k2", "form", (F.col("start") + F.col("lead")).alias("start"), (F.col("stop") - F.col("trail")).alias("stop"),
                 F.expr("substr(value, lead + 1, length(value) - lead - trail)").alias("value"), "before", "after")
    short = F.length("value") <= MAX_IDENTIFIER
    kinds = F.array_compact(F.array(*[F.when(short & F.col("value").rlike(SHAPES[k]), F.lit(k)) for k in KINDS]))
    m = m.select("*", kinds.alias("kinds")).where((F.col("form") == "mention") | (F.size("kinds") > 0))
    m = _clear(m, base)
    m = m.where(F.col("form") == "groups").unionByName(
        _clear(m.where(F.col("form") != "groups"), m.where(F.col("form") == "groups")))
    kinds = F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array(F.lit("other")))
    return m.select("k1", "k2", "start", "stop", "value", "before", "after", F.explode(kinds).alias("kind"))


def bootstrap(base: DataFrame, candidates: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
              min_pattern: float = MIN_PATTERN, min_identifier: float = MIN_IDENTIFIER) -> DataFrame:
    """The ``candidates`` that stand in contexts typical of a kind of ``base``.

    A pattern is a word before, a word after, or both.  Patterns and
    identifiers (kind, value) form a graph whose edges are counted once.
    Base values have the score 1, others start without one.  Each round scores a
    pattern by what speaks for it, the scores of its identifiers, against
    what speaks against it: values that lack the kind's shape, or are base
    values of another kind.  Values of the right shape that nothing is known
    of count on neither side, however many they are.  At least ``min_seeds``
    base values must use a pattern.  An identifier is scored by the chance
    that any of its trusted patterns is right.  Edges are grouped before they
    are joined; a very common word makes one skewed join key and never one
    group.
    """
    def contexts(x: DataFrame, seed: bool) -> DataFrame:
        b, a = F.col("before") != "", F.col("after") != ""
        patterns = F.array_compact(F.array(
            F.when(b, F.concat(F.lit("B "), "before")), F.when(a, F.concat(F.lit("A "), "after")),
            F.when(a & b, F.concat(F.lit("W "), "before", F.lit(" "), "after"))))
        return x.select("kind", "value", F.lit(seed).alias("seed"), F.explode(patterns).alias("pattern"))

    edges = contexts(base, True).unionByName(contexts(candidates, False))
    edges = saved(edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    # a pattern's values, less those that have the kind's shape and are not base values of other kinds only
    taken = F.max("seed").over(Window.partitionBy("pattern", "value"))
    fits = (edges.withColumn("taken", taken).where((F.col("kind") != "other") & (F.col("seed") | ~F.col("taken")))
            .groupBy("kind", "pattern").agg(F.count("*").alias("fit"), F.count_if("seed").alias("seeds"))
            .where(F.col("seeds") >= min_seeds))
    values = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("values"))
    patterns = saved(fits.join(values, "pattern")
                     .select("kind", "pattern", "seeds", (F.col("values") - F.col("fit")).alias("against")), "patterns")
    edges = edges.where(F.col("kind") != "other")
    score = None
    for i in range(rounds):
        known = patterns
        if score is not None:
            found = (edges.where("NOT seed").join(score, ["kind", "value"]).groupBy("kind", "pattern")
                     .agg(F.sum("score").alias("found")))
            known = known.join(found, ["kind", "pattern"], "left")
        else:
            known = known.withColumn("found", F.lit(0.0))
        favour = F.col("seeds") + F.coalesce("found", F.lit(0.0))
        trusted = (known.select("kind", "pattern", (favour / (favour + F.col("against"))).alias("trust"))
                   .where(F.col("trust") >= min_pattern))
        # 1 - product of (1 - trust); a trust of 1 counts as nearly sure
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6))))
        score = saved(edges.where("NOT seed").join(trusted, ["kind", "pattern"]).groupBy("kind", "value")
                      .agg((1 - F.exp(doubt)).alias("score")), "scores")
    return candidates.join(score.where(F.col("score") >= min_identifier).select("kind", "value"),
                           ["kind", "value"], "left_semi")


def _listed(spans: DataFrame, name: str) -> DataFrame:
    """Per document the ``kind:start:stop`` of its spans, by start and kind."""
    no = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    s = F.array_sort(F.collect_set(F.struct("start", no.alias("no"), "stop", "kind")))
    text = F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")))
    return spans.groupBy("k1", "k2").agg(F.concat_ws(",", text).alias(name),
                                         *[F.count_if(F.col("kind") == k).alias(f"{name}_{k}") for k in KINDS])


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, kind, start, stop, value) of the base spans and of those that contexts add, from (k1, k2, text)."""
    found = saved(_matches(docs), "matches")
    mention = F.col("kind").isin("mention", "groups")
    base = found.where(~mention).where(valid(F.col("kind"), F.col("value")))
    candidates = saved(_candidates(found.where(mention).withColumnRenamed("kind", "form"), base), "candidates")
    more = bootstrap(base, candidates)
    names = ["k1", "k2", "kind", "start", "stop", "value"]
    return base.select(*names), more.select(*names)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find personal data in whole texts.

    Base spans are the matches of each kind's pattern from the left, without
    overlap inside the kind; those that fail the kind's check (parts of an ip
    up to 255; 14 to 19 digits that pass Luhn; 10 to 15 digits of a phone)
    are dropped and not retried.  Base spans then seed :func:`bootstrap`:
    contexts typical of a kind add mentions of like shape that the patterns
    miss.

    Returns one row per row of ``docs``: doc_id, k1, k2 (row key), n_email,
    n_ip, n_card, n_phone (base spans), base and spans (``kind:start:stop``
    in code points, stop exclusive, by start, then kind; joined by commas,
    empty without any).  Null text is an empty one.  Rows that repeat id and
    text come back each and count once as seeds.  Empty table: no rows.
    Other columns are not used.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                    *row_keys(F.col(id_col), F.col(text_col)))
    base, more = find_spans(d.select("k1", "k2", "text"))
    spans = saved(_listed(base.unionByName(more), "spans").select("k1", "k2", "spans")
                  .join(_listed(base, "base"), ["k1", "k2"], "left"), "spans")
    out = d.select("id", "k1", "k2").join(spans, ["k1", "k2"], "left")
    return out.select(F.col("id").alias("doc_id"), "k1", "k2",
                      *[F.coalesce(f"base_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``spans`` (k1, k2, kind, start, stop) replaced by ``[kind]``.

    Of overlapping spans the first is replaced, and the part of a later one
    that it leaves.  Texts without spans, and null, stay as they are.
    """
    per = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "kind"))).alias("redact_spans"))
    a, b = row_keys(docs[id_col], docs[text_col])
    d = docs.select("*", a.alias("k1"), b.alias("k2")).join(per, ["k1", "k2"], "left")
    step = F.expr(f"""aggregate(redact_spans, named_struct('at', 0L, 'out', ''), (acc, s) ->
        if(s.stop <= acc.at, acc, named_struct('at', s.stop, 'out',
           concat(acc.out, substr({text_col}, int(acc.at + 1), int(greatest(s.start - acc.at, 0))), '[', s.kind, ']'))),
        acc -> concat(acc.out, substr({text_col}, int(acc.at + 1))))""")
    text = F.when(F.col("redact_spans").isNull(), F.col(text_col)).otherwise(step)
    return d.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
