"""Repair of the structure of conversations by a cheapest script of edits."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, non_empty, saved

# States of a repaired conversation: nothing yet, after the system turn, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# Where the initial of a role leads from a state; what is not listed is not allowed.
NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ANSWER = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
FINAL = (EMPTY, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# Costs of the edits (fixed values).
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
DELETE_LETTER, INSERT_LETTER, KEEP_LETTER, RELABEL_LETTER = (ord(c) for c in "DIKR")
# Rows that are decided at once, and pieces that are joined at once.
BLOCK_BITS = 8
BLOCK_ROWS = 1 << BLOCK_BITS
FAN_IN = 16
# Rows of an Arrow batch, and rows and characters of a batch that is handed back.
ARROW_ROWS, OUT_ROWS, OUT_CHARS = 500, 5000, 16_000_000
NON_SPACE = r"[^\x20\x09-\x0D]"
PIECE = ("conv string, seq long, rows long, blank long, duplicate long, truncated long, illegal long, "
         "first string, last string, whole boolean, cost array<long>, audit array<string>")


def damaged(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of ``convs`` after repeatable damage by crc32(``conv:turn``) % 20.

    0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4
    makes the role user.  Nulls count as one space in the key, the role and
    the text; the turn stays null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col))) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    d = convs.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.when(k == 4, "user").otherwise(space(role_col)).alias("role"), text.alias("text"),
                     F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("times"))
    again = F.explode(F.array_repeat(F.lit(True), F.col("times"))).alias("again")
    return d.select("conv_id", "turn", "role", "text", again).drop("again")


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the conversation as a string, and 128 bits of conversation, role and text."""
    conv = F.col("conv").cast("string")
    known = F.coalesce(conv, F.lit(" ")), conv.isNull()
    return rows.select(conv.alias("conv"), "turn", "role", "text",
                       F.xxhash64(*known, "role", "text").alias("h1"),
                       F.xxhash64(F.lit("turn"), "text", "role", *known).alias("h2"))


def _in_order(rows: DataFrame) -> list[Column]:
    """The order of a conversation: by turn, nulls first; ties by role, then by hashes of the text."""
    return [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "h1", "h2")]


def _light(rows: DataFrame) -> DataFrame:
    """What decides: one narrow row per turn in the order of the conversations, written, ``at`` its place."""
    last = F.regexp_extract("text", rf"({NON_SPACE})[\x20\x09-\x0D]*\z", 1)
    r = rows.select("conv", "turn", "role", "h1", "h2", F.substring("role", 1, 1).alias("initial"),
                    (~F.col("text").rlike(NON_SPACE)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    order = _in_order(r)
    r = r.repartitionByRange(*order).sortWithinPartitions(*order).drop("role")
    return saved(r.withColumn("at", F.monotonically_increasing_id()), "turns")


def _faults(light: DataFrame) -> DataFrame:
    """``light`` with ``again``: role and text stood earlier in the conversation."""
    first = (light.where("NOT blank").groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("m"))
             .where("m > 1").drop("m"))
    return light.join(first, ["h1", "h2"], "left").select(
        "conv", "at", "initial", "blank", "cut", (~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
        .alias("again"))


def cheapest(rows: list[tuple[str, bool, bool]], start: int) -> list[tuple[int, str] | None]:
    """For each state that ``rows`` (initial, must go, truncated) can end in, the cheapest (cost, audit) from ``start``.

    A script is one integer: its cost above as many bytes as the longest
    audit has letters, these bytes the letters from the top, zeros behind
    the last.  So the smaller integer is the cheaper script, and of equally
    cheap ones the one whose audit comes first in ASCII; each edit adds a
    weight that depends on its place alone, and the least sum along the
    rows is the answer.
    """
    width = 8 * (3 * len(rows) + 2)
    paths: list[tuple[int, int] | None] = [None] * STATES  # (weight, bits left below the next letter)
    paths[start] = (0, width)

    def add(path, cost, letter):
        weight, below = path
        return weight + (cost << width) + (letter << (below - 8)), below - 8

    def insert(at):
        for s in (EMPTY, SYSTEM, ASSISTANT, USER):  # user last: an inserted user can be answered by an inserted assistant
            if at[s] is not None:
                t, path = ANSWER[s], add(at[s], INSERT, INSERT_LETTER)
                if at[t] is None or path < at[t]:
                    at[t] = path
        return at

    paths = insert(paths)
    for initial, must_go, cut in rows:
        after: list[tuple[int, int] | None] = [None] * STATES

        def offer(t, path):
            if after[t] is None or path < after[t]:
                after[t] = path

        kept = NEXT.get(initial, {})
        extra = TRUNCATED if cut else 0
        for s, path in enumerate(paths):
            if path is None:
                continue
            offer(s, add(path, DELETE, DELETE_LETTER))
            if not must_go:
                offer(ANSWER[s], add(path, RELABEL + extra, RELABEL_LETTER))
                if s in kept:
                    offer(kept[s], add(path, extra, KEEP_LETTER))
        paths = insert(after)
    return [None if p is None else unpacked(p[0], width) for p in paths]


def unpacked(weight: int, width: int) -> tuple[int, str]:
    low = weight & ((1 << width) - 1)
    return weight >> width, low.to_bytes(width // 8, "big").rstrip(b"\0").decode("ascii")


def packed(cost: int, audit: str, size: int) -> int:
    """A script as the integer of :func:`cheapest`, for audits of up to ``size`` letters."""
    return (cost << (8 * size)) + int.from_bytes(audit.encode("ascii").ljust(size, b"\0"), "big")


def _joined(left: list, right: list, size: int) -> list:
    """The cheapest scripts (start * 4 + end) through two pieces, one after the other."""
    out: list = [None] * (STATES * STATES)
    for s in range(STATES):
        for t in range(STATES):
            ways = []
            for m in range(STATES):
                a, b = left[s * STATES + m], right[m * STATES + t]
                if a is not None and b is not None:
                    ways.append((a[0] + b[0], a[1] + b[1]))
            if ways:
                out[s * STATES + t] = min(ways, key=lambda w: packed(*w, size))
    return out


def _adjacent(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _piece(conv, seq: int, rows: list, whole: bool) -> tuple:
    todo = [(i, blank or again, cut) for i, blank, again, cut in rows]
    table: list = cheapest(todo, EMPTY)
    for s in range(1, STATES):
        table += [None] * STATES if whole else cheapest(todo, s)
    illegal = sum(not _adjacent(a[0], b[0]) for a, b in zip(rows, rows[1:]))
    return (conv, seq, len(rows), sum(r[1] for r in rows), sum(r[2] and not r[1] for r in rows),
            sum(r[3] and not r[1] and not r[2] for r in rows), illegal, rows[0][0], rows[-1][0], whole,
            [x and x[0] for x in table], [x and x[1] for x in table])


def _pieces(blocks: int):
    """Pieces of the rows of one task, which come by place: runs of a conversation inside a block of places."""
    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []  # the rows of one block

        def flush():
            runs: list = []
            for conv, _, *row in held:
                if not runs or runs[-1][0] != conv:
                    runs.append((conv, []))
                runs[-1][1].append(row)
            at = held[0][1]
            seq = (at >> 33) * blocks + (at & ((1 << 33) - 1)) // BLOCK_ROWS
            return pd.DataFrame([_piece(c, seq, rows, 0 < i < len(runs) - 1) for i, (c, rows) in enumerate(runs)], columns=names)

        for pdf in batches:
            conv = pdf["conv"].astype(object).where(pdf["conv"].notna(), None)
            for row in zip(conv, pdf["at"], pdf["initial"], pdf["blank"], pdf["again"], pdf["cut"]):
                if held and (row[1] // BLOCK_ROWS) != (held[0][1] // BLOCK_ROWS):
                    yield flush()
                    held.clear()
                held.append(row)
        if held:
            yield flush()
    return non_empty(run)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """A few pieces of one conversation as one, numbered by ``number``."""
    pdf = pdf.sort_values("seq")
    names = [c for c in pdf.columns if c != "number"]
    rows = [dict(zip(names, r)) for r in pdf[names].itertuples(index=False, name=None)]
    table = lambda r: [None if a is None else (int(c), a) for c, a in zip(r["cost"], r["audit"])]
    size = sum(max(len(a) for a in r["audit"] if a is not None) for r in rows)
    out = rows[0] | {"seq": int(pdf["number"].iloc[0])}
    best = table(out)
    for r in rows[1:]:
        best = _joined(best, table(r), size)
        out["illegal"] += r["illegal"] + (not _adjacent(out["last"], r["first"]))
        out["last"] = r["last"]
        for c in ("rows", "blank", "duplicate", "truncated"):
            out[c] += r[c]
    out["cost"], out["audit"] = [x and x[0] for x in best], [x and x[1] for x in best]
    out["conv"] = None if pd.isna(out["conv"]) else out["conv"]
    return pd.DataFrame([[out[c] for c in names]], columns=names)


def _decided(light: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit), one row per conversation that has rows."""
    place = F.col("at").bitwiseAND((1 << 33) - 1)
    blocks = light.agg(F.max(place)).first()[0]
    blocks = 1 if blocks is None else blocks // BLOCK_ROWS + 1
    rows = _faults(light).repartition(F.shiftright("at", BLOCK_BITS)).sortWithinPartitions("at")
    pieces = saved(rows.mapInPandas(_pieces(blocks), PIECE), "pieces")
    rest = pieces.where("NOT whole")
    while True:
        # a conversation of n rows has about n / 256 pieces; sixteen neighbours become one until one is left
        number = F.row_number().over(Window.partitionBy("conv").orderBy("seq")) - 1
        groups = rest.withColumn("number", F.floor(number / FAN_IN).cast("long")).groupBy("conv", "number")
        rest = saved(groups.applyInPandas(_merge, PIECE), "pieces-merged")
        if rest.where("seq > 0").isEmpty():
            break
    ends = [F.struct(F.col("cost")[t].alias("cost"), F.col("audit")[t].alias("audit")) for t in FINAL]
    best = F.array_min(F.filter(F.array(*ends), lambda x: x["cost"].isNotNull()))
    counts = ["conv", "blank", "duplicate", "truncated", "illegal"]
    every = pieces.where("whole").unionByName(rest)
    return every.select(*counts, best.alias("best")).select(*counts, "best.cost", "best.audit")


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv, role, text) of the repaired turns, from rows sorted by conversation, its audit first; (conv, None, None) ahead."""
    conv, audit, at, state = None, "", 0, EMPTY

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = ANSWER[state]
            at += 1
            yield conv, ROLE[state], ""

    for pdf in batches:
        for c, script, role, text in zip(pdf["conv"], pdf["audit"], pdf["role"], pdf["text"]):
            if script is not None:
                conv, audit, at, state = None if pd.isna(c) else c, script, 0, EMPTY
                yield conv, None, None
            else:
                letter = audit[at]
                at += 1
                if letter == "K":
                    state = NEXT[role[:1]][state]
                    yield conv, role, text
                elif letter == "R":
                    state = ANSWER[state]
                    yield conv, ROLE[state], text
            yield from inserted()


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, chars, number = [], 0, 0
    for conv, role, text in _replayed(batches):
        if role is None:
            number = 0
            continue
        out.append((conv, number, role, text))
        number += 1
        chars += len(text)
        if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pd.DataFrame(out, columns=["conv", "number", "role", "text"])
            out, chars = [], 0
    yield pd.DataFrame(out, columns=["conv", "number", "role", "text"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    done: list = []
    running = None
    for conv, role, text in _replayed(batches):
        if role is None:
            if running is not None:
                done.append((running[0], running[1].hexdigest()))
            if len(done) >= OUT_ROWS:
                yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
                done = []
            running = [conv, sha256(), b""]
        else:
            running[1].update(running[2] + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            running[2] = b"\n"
    if running is not None:
        done.append((running[0], running[1].hexdigest()))
    yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])


def _replay(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns of each conversation in order behind its audit, in one task, which holds a few rows and the audit."""
    arrow_rows(rows.sparkSession, ARROW_ROWS)
    nothing = {c: F.lit(None).cast(t) for c, t in rows.dtypes}
    first = audits.select(*[F.col("conv") if c == "conv" else v.alias(c) for c, v in nothing.items()], "audit")
    every = rows.withColumn("audit", F.lit(None).cast("string")).unionByName(first)
    order = [F.col("conv").asc_nulls_first(), F.col("audit").isNull(), *_in_order(rows)[1:]]
    return every.repartition("conv").sortWithinPartitions(*order).select("conv", "audit", "role", "text")


class Repair:
    """The repair of the conversations of ``turns`` (conv, turn, role, text); see :func:`repair_conversations`."""

    def __init__(self, turns: DataFrame):
        self.rows = _keyed(turns)
        light = _light(self.rows)
        spread = light.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
        self.audits = saved(_decided(light), "audits")
        self.report = (self.audits.join(spread.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
                       .select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate",
                               "truncated", "illegal", "cost", "audit"))

    def turns(self) -> DataFrame:
        """(conv, number, role, text): the repaired conversations, turns numbered from 0."""
        return _replay(self.rows, self.audits.select("conv", "audit")).mapInPandas(
            non_empty(_turns), "conv string, number long, role string, text string")

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256): SHA-256 of the lines ``role:text`` of each repaired conversation."""
        return _replay(self.rows, self.audits.select("conv", "audit")).mapInPandas(
            non_empty(_digests), "conv string, repaired_sha256 string")


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> Repair:
    """Repair conversations so that the initials of their roles read ``(s?(ua)+)?``, by a cheapest script of edits.

    The turns of a conversation are taken by turn (nulls first; ties by role,
    then by a hash of the text).  A row is blank (no character but ASCII
    white space), else a duplicate (role and text stood earlier in the
    conversation), else truncated (its last such character is none of
    ``.!?``).  Edits are Keep (0), Relabel to user or assistant (3), Delete
    (4; blank rows and duplicates must go) and Insert an empty user's or
    assistant's turn (3); a truncated row that stays costs 3 more.  Of equally
    cheap scripts that with the least audit (the edits' initials) in ASCII.

    ``report``: one row per conversation (conv as string, gaps, blank,
    duplicate, truncated, illegal, cost, audit); ``turns()`` the repaired
    rows; ``digests()`` a hash of them.  Null roles and texts are one space;
    a null conversation is one conversation; rows that repeat are duplicates;
    an empty table gives no rows; other columns are not used.

    Narrow rows without texts are put in order by range, so that a
    conversation of any length lies in many tasks; each block of 256 places
    is decided for every state before and after it, and the blocks of a long
    conversation are joined sixteen at a time.  Texts are moved once, to be
    replayed in order by a task that holds a few of them.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return Repair(turns.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                               space(role_col).alias("role"), space(text_col).alias("text")))
