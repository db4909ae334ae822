"""Problem 4: rebuilding conversations from message rows.

Method: the messages come in overlapping exports (fragments) whose order is not known. A message is
kept as a hash; one fragment goes on in another where its end equals the other's beginning, hash by
hash (``overlaps``). These edges are the overlap graph: fragments that lie in others are left out,
unambiguous paths are merged by doubling (``paths``), and a message's turn is its place in its
fragment behind the messages of the path before (``assembled``). A session whose fragments do not
form one path, or whose messages break the rules on it, is dropped.

The table of messages names no fragments, so each session is cut into windows of ``LENGTH`` messages
in the order of time, ``STEP`` apart (``cut``). The graph is given the place inside a fragment, never
the place of a fragment. A session that holds a third of all rows is many fragments, which no task
of the graph holds together.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.common import map_batches, materialize, one_row_per, read
from textloom.llm.p3_pairs import is_empty
from textloom.operators.sequence import with_ordinal

#: A message's kind: of the user, of the assistant, or neither (another role, empty content).
_ROLES, _NEITHER = {"user": 0, "assistant": 1}, 2


def _role() -> Column:
    return F.lower(F.regexp_replace(F.coalesce("role", F.lit("")), r"^\s+|\s+$", ""))


def messages(chat: DataFrame) -> DataFrame:
    """One row per id with its trimmed, lower-case role and the message's hash ``h``."""
    rows = one_row_per(chat, "id", ["session_id", "created_at", "role", "content"]).withColumn("role", _role())
    return rows.withColumn("h", F.xxhash64("id", "role", "content"))


def _kinds(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with ``kind`` instead of its last two columns, role and content."""
    *rest, role, content = batch.columns
    kind = [_NEITHER if is_empty(c) else _ROLES.get(r, _NEITHER) for r, c in zip(role.to_pylist(), content.to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([*rest, pa.array(kind, pa.int32())], [*batch.schema.names[:-2], "kind"])


#: A session is cut into exports of LENGTH messages that begin STEP apart.
LENGTH, STEP = 6, 4


def cut(rows: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """Messages (session_id, created_at, id, ...) as overlapping exports: (fragment, place) with all columns
    but created_at. NULL is a session of its own."""
    keep = [c for c in rows.columns if c != "created_at"]
    rows = with_ordinal(rows, ["created_at", "id"], "session_id", "o")
    last = F.floor(F.col("o") / step)
    first = F.greatest(F.ceil((F.col("o") - (length - 1)) / step), F.lit(0))
    rows = rows.select(*keep, "o", F.explode(F.sequence(first, last)).alias("k"))
    return rows.select(F.xxhash64("session_id", "k").alias("fragment"), (F.col("o") - F.col("k") * step).alias("place"), *keep)


def fragments(rows: DataFrame) -> DataFrame:
    """The exports (fragment, place, session_id, id, h, kind) of ``messages``."""
    src = rows.select("session_id", "created_at", "id", "h", "role", "content")
    slim = map_batches(src, _kinds, T.StructType([*src.schema.fields[:-2], T.StructField("kind", T.IntegerType())]))
    return materialize(cut(materialize(slim, "messages")), "exports")


# --- the overlap graph ----------------------------------------------------------------------------------------


def overlaps(rows: DataFrame) -> DataFrame:
    """(a, b, shift, whole): fragment ``b`` goes on where ``a`` has ``shift`` messages behind it: every
    message of ``a`` from there on is the one of ``b`` at the same distance. ``whole``: ``b`` ends first.

    ``rows``: (fragment, place, session_id, h). Fragments are compared where the first message of one
    stands in another, so pairs without an overlap are never made.
    """
    sizes = rows.groupBy("fragment").agg(F.count("*").alias("n"))
    heads = rows.where("place = 0").select(F.col("fragment").alias("b"), F.col("session_id").alias("_s"), "h")
    near = rows.join(heads, "h").where(F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("fragment") != F.col("b"))).select(F.col("fragment").alias("a"), "b", F.col("place").alias("shift"))
    x = rows.select(F.col("fragment").alias("a"), F.col("place").alias("at"), F.col("h").alias("ha"))
    y = rows.select(F.col("fragment").alias("b"), F.col("place").alias("to"), F.col("h").alias("hb"))
    met = near.join(x, "a").where("at >= shift").withColumn("to", F.col("at") - F.col("shift")).join(y, ["b", "to"]).where("ha = hb")
    same = met.groupBy("a", "b", "shift").agg(F.count("*").alias("same"))
    both = same.join(sizes.select(F.col("fragment").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("fragment").alias("b"), F.col("n").alias("nb")), "b")
    return both.where(F.col("same") == F.least(F.col("na") - F.col("shift"), F.col("nb"))).select("a", "b", "shift", (F.col("nb") <= F.col("na") - F.col("shift")).alias("whole"))


def paths(rows: DataFrame) -> DataFrame:
    """(fragment, root, start, done) of the fragments that lie in no other one (of equal ones the least is
    kept): the fragment that its path begins with, and the messages of the path before it. A ring has no
    beginning, there ``done`` is false.

    Each fragment follows the one that it overlaps most; where two candidates tie, or one fragment is
    followed by two, the path ends. No path is gathered: they are followed by doubling, and a fragment
    whose beginning is known is not joined again, so the others look up different fragments.
    """
    edges = materialize(overlaps(rows), "overlaps")
    inner = edges.where("whole").alias("e")
    equal = edges.select(F.col("a").alias("_b"), F.col("b").alias("_a"), F.col("whole").alias("_w"), F.col("shift").alias("_s")).where("_w and _s = 0")
    # Of two equal fragments the greater lies in the lesser.
    inner = inner.join(equal, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").where("_w is null or a < b").select(F.col("b").alias("fragment")).distinct()
    kept = materialize(rows.select("fragment").distinct().join(inner, "fragment", "left_anti"), "kept")
    live = edges.where("not whole").join(kept.withColumnRenamed("fragment", "a"), "a").join(kept.withColumnRenamed("fragment", "b"), "b").select("a", "b", "shift")

    def only(by: str) -> DataFrame:
        """The edges of the most overlap by one end, where there is one alone."""
        best = live.groupBy(by).agg(F.min("shift").alias("shift"))
        top = live.join(best, [by, "shift"])
        return top.join(top.groupBy(by).agg(F.count("*").alias("c")).where("c = 1").select(by), by, "left_semi").select("a", "b", "shift")

    steps = materialize(only("a").intersect(only("b")), "steps")
    befores = steps.select(F.col("b").alias("fragment"), F.col("a").alias("root"), F.col("shift").alias("start"))
    afters = steps.select(F.col("a").alias("fragment"), F.lit(True).alias("_led"))
    state = kept.join(befores, "fragment", "left").join(afters, "fragment", "left")
    state = state.select("fragment", F.coalesce("root", "fragment").alias("root"), F.coalesce("start", F.lit(0).cast("long")).alias("start"), F.col("root").isNull().alias("done"), F.coalesce("_led", F.lit(False)).alias("_led"))
    state = materialize(state, "paths")
    alone = state.where("done and not _led").drop("_led")
    chain = state.where("not done or _led").drop("_led")
    # After r rounds all that stand less than 2^r fragments behind a beginning are done; the rest are rings.
    for _ in range(chain.count().bit_length()):
        open_ = chain.where("not done")
        if open_.isEmpty():
            break
        back = chain.select(F.col("fragment").alias("root"), F.col("root").alias("_root"), F.col("start").alias("_start"), F.col("done").alias("_done"))
        moved = open_.join(back, "root").select("fragment", F.col("_root").alias("root"), (F.col("start") + F.col("_start")).alias("start"), F.col("_done").alias("done"))
        chain = materialize(chain.where("done").unionByName(moved), "paths")
    return alone.unionByName(chain)


def assembled(exports: DataFrame) -> DataFrame:
    """(session_id, turn, id, fine, root, other, done): one row per turn, from 0, of the paths of each session.
    ``fine``: a user's turn where it is even, else an assistant's; ``root`` and ``other`` are one in one path.

    ``exports``: (fragment, place, session_id, id, h, kind), see ``fragments``.
    """
    placed = exports.join(paths(exports.select("fragment", "place", "session_id", "h")), "fragment")
    turns = placed.groupBy("session_id", (F.col("place") + F.col("start")).alias("turn")).agg(
        F.min("id").alias("id"), F.min("kind").alias("_least"), F.max("kind").alias("_most"), F.min("root").alias("root"), F.max("root").alias("other"), F.min("done").alias("done")
    )
    parity = F.col("turn") % 2
    return turns.select("session_id", "turn", "id", ((F.col("_least") == parity) & (F.col("_most") == parity)).alias("fine"), "root", "other", "done")


def judged(turns: DataFrame) -> DataFrame:
    """(session_id, sound) of every session of ``assembled``: one path without gaps, and on it user,
    assistant, user, assistant ... from user to assistant, no empty content."""
    by = turns.groupBy("session_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"), F.min("fine").alias("fine"), F.min("root").alias("root"), F.max("other").alias("other"), F.min("done").alias("done"))
    return by.select("session_id", F.expr("fine and done and root = other and n % 2 = 0 and last = n - 1").alias("sound"))


def sessions(chat: DataFrame) -> DataFrame:
    """(session_id, sound): every session, NULL as a session of its own; order as in p3.

    Sound: see ``judged``. Rows delivered twice count once; an empty table gives an empty result.
    """
    return judged(assembled(fragments(messages(chat))))


def conversations(chat: DataFrame) -> DataFrame:
    """(session_id, turn, role, content, id) of the sound sessions, turn from 1 in the order of their paths."""
    rows = materialize(messages(chat), "rows")
    turns = materialize(assembled(fragments(rows)), "turns")
    sound = judged(turns).where("sound").select("session_id")
    turns = turns.join(sound, "session_id", "left_semi").select("session_id", (F.col("turn") + 1).cast("int").alias("turn"), "id")
    return turns.join(rows.select("id", "role", "content"), "id").select("session_id", "turn", "role", "content", "id")


# --- exports that come as they are ----------------------------------------------------------------------------


def merged(exports: DataFrame) -> DataFrame:
    """(session_id, turn, role, content, id) of the sound sessions of overlapping exports (fragment, place,
    session_id, id, role, content), in any order and any number.

    Fragments that lie in another one are left out (of equal ones the least is kept). Each of the others
    follows the one that it overlaps most; where two candidates tie, or one fragment is followed by two,
    the path ends. A session of more than one path has a gap and is dropped, and so are those that are not
    sound (see ``sessions``). NULL sessions, fragments and places are left out; repeated rows count once;
    no rows give none. No session is gathered: paths are followed by doubling.
    """
    src = exports.select("fragment", F.col("place").cast("long").alias("place"), "session_id", "id", _role().alias("role"), "content")
    src = src.where("fragment is not null and place is not null and session_id is not null").dropDuplicates(["fragment", "place"])
    src = materialize(src.withColumn("h", F.xxhash64("id", "role", "content")), "exports")
    rows = src.select("fragment", "place", "session_id", "h")
    state = paths(rows)
    whole = src.select("fragment", "session_id").distinct().join(state, "fragment").groupBy("session_id").agg(F.min("root").alias("root"), F.max("root").alias("other"), F.min("done").alias("done"))
    whole = whole.where("done and root = other").select("session_id")
    placed = src.join(whole, "session_id", "left_semi").join(state.select("fragment", "start"), "fragment").withColumn("turn", F.col("place") + F.col("start"))
    placed = materialize(placed.groupBy("session_id", "turn").agg(F.min(F.struct("id", "role", "content")).alias("m")).select("session_id", "turn", "m.id", "m.role", "m.content"), "placed")

    @F.pandas_udf("boolean")
    def empty(texts: pd.Series) -> pd.Series:
        return texts.map(is_empty)

    fine = (F.col("role") == F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")) & ~empty("content")
    sound = placed.groupBy("session_id").agg(F.min(fine).alias("fine"), F.count("*").alias("n"), F.max("turn").alias("last")).where("fine and n % 2 = 0 and last = n - 1").select("session_id")
    return placed.join(sound, "session_id", "left_semi").select("session_id", (F.col("turn") + 1).cast("int").alias("turn"), "role", "content", "id")


def exported(chat: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """A table of messages as overlapping exports: (fragment, place, session_id, id, role, content)."""
    rows = one_row_per(chat, "id", ["session_id", "created_at", "role", "content"]).where("session_id is not null")
    return cut(rows, length, step).select("fragment", "place", "session_id", "id", "role", "content")


def p4_merged(spark, sf_dir: str) -> DataFrame:
    """The conversations again, from overlapping exports whose order is not known."""
    return merged(exported(read(spark, sf_dir, "chat_history")))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return sessions(read(spark, sf_dir, "chat_history")).where("not sound").select("session_id")


def p4_conversations(spark, sf_dir: str) -> DataFrame:
    return conversations(read(spark, sf_dir, "chat_history"))


_ORDERED = """
with d as (select id, min(struct_pack(s := session_id, t := created_at, r := role, c := content)) m from chat_history where id is not null group by id),
o as (select id, m.s session_id, m.t created_at, lower(regexp_replace(coalesce(m.r, ''), '^\\s+|\\s+$', '', 'g')) r, m.c content from d),
w as (select *, row_number() over (partition by session_id order by created_at nulls first, id) turn, count(*) over (partition by session_id) n from o),
bad as (select distinct session_id from w where r <> case when turn % 2 = 1 then 'user' else 'assistant' end or n % 2 = 1
  or content is null or not regexp_matches(content, '[\\p{L}\\p{N}]') or lower(trim(content, chr(9) || chr(10) || chr(13) || ' ')) in ('null', 'n/a', 'none', '<empty>', '[no response]'))
"""
ORACLE = {
    "p4_found": _ORDERED + "select session_id from bad",
    "p4_merged": _ORDERED + "select session_id, cast(turn as integer) as turn, r as role, content, id from w where session_id not in (select session_id from bad where session_id is not null) and session_id is not null",
    "p4_conversations": _ORDERED + "select session_id, cast(turn as integer) as turn, r as role, content, id from w where session_id not in (select session_id from bad where session_id is not null) and session_id is not null",
}
