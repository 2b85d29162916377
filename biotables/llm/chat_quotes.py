"""Chat formatting by quotation linking.

Lines that start with ``>`` are quotes, the number of ``>`` is their level. Consecutive lines of one level
are a passage. Passages are normalised (A-Z lower-cased, white space to single spaces) and hashed; the hash of a quoted
passage meets, within its conversation, the hashes of what messages say themselves: their unquoted passages
and the single lines of these. The first message that said it is the original, and a quote links to it
if it is older. A quoted passage that no older message said as a whole is taken apart: each line links to the first
message that said its paragraph (cut at blank lines), or else the line; where more than half the lines are known,
the passage links to the older message with the most of them in order, the latest of equals. The latest original among the passages of level 1 is what the message replies to; deeper
levels name the messages quoted there. Threads follow the replies to their first message by pointer
doubling, one join a round.

Result, one row per message: conv_id, turn, role, text (without quotes), n_quoted (quoted passages),
max_level, reply_to (turn, null if it replies to nothing known), quoted (turns of all originals, in order), root (first
turn of the thread) and depth (replies from there). In the order of conv_id, root, turn every thread is in one
piece and every reply comes after what it answers.

All steps are DataFrame functions. Every message says a passage once per hash, and originals are reduced
to one row per conversation and hash before the join, so copies make no pairs.

Defined cases: null text is empty; a row with a null conv_id or turn keeps its text without quotes, links to
nothing and is its own root; rows with equal conv_id and turn are one message that replies to the latest of
what its rows reply to; empty passages are not linked; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.columns import table
from biotables.session import materialize

MARKS = r"^(?:[ \t]*>)+"


def normal(text: Column) -> Column:
    """Key of a passage; null if nothing is left."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    plain = F.regexp_replace(F.regexp_replace(lower, r"[\x09-\x0D\x20]+", " "), "^ | $", "")
    return F.when(plain != "", F.md5(plain))


def quoted_lines(text: Column) -> Column:
    """Array of (level, body), one for each line."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda l: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(l, MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(l, MARKS + "[ \t]?", "").alias("body"),
        ),
    )


def parsed(messages: DataFrame) -> DataFrame:
    """Adds passages: maximal runs of lines of one level, as an array of level and bodies."""
    starts = F.expr("filter(sequence(0, size(lines) - 1), i -> i = 0 or lines[i].level <> lines[i - 1].level)")
    runs = F.expr(
        "transform(starts, (s, k) -> named_struct('level', lines[s].level, 'bodies', "
        "transform(slice(lines, s + 1, if(k + 1 < size(starts), starts[k + 1], size(lines)) - s), l -> l.body)))"
    )
    return messages.withColumn("lines", quoted_lines(F.col("raw"))).withColumn("starts", starts).withColumn("passages", runs).drop("lines", "starts")


def pieces(text: Column) -> Column:
    """Array of (at, key, paragraph): every line that is not blank with its place and the key of its paragraph."""
    lines = lambda p, i: F.transform(
        F.split(p, "\n", -1), lambda l, j: F.struct((i.cast("long") * (1 << 32) + j).alias("at"), normal(l).alias("key"), normal(p).alias("paragraph"))
    )
    return F.filter(F.flatten(F.transform(F.split(text, r"\n(?:[\x09\x0B-\x0D\x20]*\n)+", -1), lines)), lambda x: x["key"].isNotNull())


def by_lines(asked: DataFrame, placed: DataFrame) -> DataFrame:
    """conv_id, turn, level, original of quoted passages by the lines that older messages said."""
    said = (
        placed.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(pieces(F.col("text"))).alias("p")).select("conv_id", "turn", "p.*")
    )
    first = lambda key, name: said.groupBy("conv_id", F.col(key).alias(key)).agg(F.min(F.struct("turn", "at")).alias(name))
    lines = (
        asked.select("conv_id", "turn", "level", F.col("key").alias("passage"), F.size(pieces(F.col("body"))).alias("n"), F.explode(pieces(F.col("body"))).alias("p"))
        .select("conv_id", "turn", "level", "passage", "n", "p.*")
        .join(first("key", "line_said"), ["conv_id", "key"], "left").join(first("paragraph", "paragraph_said"), ["conv_id", "paragraph"], "left")
        .withColumn("said", F.when(F.col("paragraph_said.turn") < F.col("turn"), F.col("paragraph_said")).when(F.col("line_said.turn") < F.col("turn"), F.col("line_said")))
        .where("said is not null")
    )
    in_order = "aggregate(array_sort(found), named_struct('n', 0, 'last', -1L), (a, x) -> if(x.place >= a.last, named_struct('n', a.n + 1, 'last', x.place), a), a -> a.n)"
    passage = ["conv_id", "turn", "level", "passage"]
    best = (
        lines.groupBy(*passage, F.col("said.turn").alias("original"))
        .agg(F.max("n").alias("n"), F.collect_list(F.struct("at", F.col("said.at").alias("place"))).alias("found"))
        .withColumn("held", F.expr(in_order))
        .groupBy(*passage)
        .agg(F.max("n").alias("n"), F.sum(F.size("found")).alias("known"), F.max(F.struct("held", "original")).alias("best"))
    )
    return best.where("2 * known > n").select("conv_id", "turn", "level", "best.original")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages without quotes, with what they reply to; see the module text for the columns."""
    rows = parsed(
        messages.select(
            F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).cast("string").alias("raw")
        )
    )
    own = F.expr("filter(passages, p -> p.level = 0)")
    quoted = F.expr("filter(passages, p -> p.level > 0)")
    rows = materialize(
        rows.select(
            "conv_id", "turn", "role",
            F.regexp_replace(F.array_join(F.transform(own, lambda p: F.array_join(p["bodies"], "\n")), "\n"), r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "").alias("text"),
            F.size(quoted).cast("long").alias("n_quoted"),
            F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("long").alias("max_level"),
            F.array_distinct(F.filter(F.concat(
                F.transform(own, lambda p: normal(F.array_join(p["bodies"], "\n"))),
                F.flatten(F.transform(own, lambda p: F.transform(p["bodies"], normal))),
            ), lambda k: k.isNotNull())).alias("says"),
            F.filter(
                F.transform(quoted, lambda p: F.struct(p["level"].alias("level"), normal(F.array_join(p["bodies"], "\n")).alias("key"), F.array_join(p["bodies"], "\n").alias("body"))),
                lambda q: q["key"].isNotNull(),
            ).alias("quotes"),
        ),
        "messages",
    )
    placed = rows.where("conv_id is not null and turn is not null")
    originals = (
        placed.select("conv_id", "turn", F.explode("says").alias("key"))
        .groupBy("conv_id", "key").agg(F.min("turn").alias("original"))
    )
    asked = placed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.key").distinct()
    whole = asked.join(originals, ["conv_id", "key"]).where("original < turn").select("conv_id", "turn", "level", "key", "original")
    left = (
        placed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").dropDuplicates(["conv_id", "turn", "level", "key"])
        .join(whole, ["conv_id", "turn", "level", "key"], "left_anti")
    )
    left = materialize(left, "quotes-left")
    links = (
        whole.drop("key").union(by_lines(left, placed))
        .groupBy("conv_id", "turn")
        .agg(F.max(F.when(F.col("level") == 1, F.col("original"))).alias("reply_to"), F.array_sort(F.collect_set("original")).alias("quoted"))
    )
    links = materialize(links, "reply-links")
    return (
        rows.select("conv_id", "turn", "role", "text", "n_quoted", "max_level")
        .join(links, ["conv_id", "turn"], "left")
        .join(threads(links), ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "text", "n_quoted", "max_level", "reply_to",
            F.coalesce("quoted", F.array().cast("array<bigint>")).alias("quoted"),
            F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
    )


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth of every message that replies to one; rounds grow with the logarithm of the depth.

    A conversation leaves the rounds when all its messages point to a first message.
    """
    state = links.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth"))
    settled = []
    while True:
        state = materialize(state, "threads")
        above = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        joined = materialize(
            state.join(above, ["conv_id", "root"], "left").select(
                "conv_id", "turn", F.coalesce("higher", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved"),
            ),
            "threads",
        )
        moving = joined.where("moved").select("conv_id").distinct()
        joined = joined.drop("moved")
        if moving.isEmpty():
            return reduce(DataFrame.union, [*settled, joined])
        settled.append(joined.join(moving, "conv_id", "left_anti"))
        state = joined.join(moving, "conv_id", "left_semi")


def as_mail(messages: DataFrame) -> DataFrame:
    """Conversations as mail: every message quotes the two before it, the older one a level deeper."""
    before = lambda n: messages.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"text{n}"))
    mark = lambda text, marks: F.concat(F.lit(marks), F.regexp_replace(F.col(text), "\n", "\n" + marks), F.lit("\n"))
    return (
        messages.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role",
            F.concat(F.coalesce(mark("text2", "> > "), F.lit("")), F.coalesce(mark("text1", "> "), F.lit("")), F.coalesce("text", F.lit(""))).alias("text"),
        )
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The given conversations hold no quotes, so Spark first writes them as mail with nested quotes."""
    linked = link_quotes(as_mail(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")))
    return linked.withColumn("quoted", F.array_join(F.transform("quoted", lambda t: t.cast("string")), ","))


ORACLE_SQL = r"""
    WITH RECURSIVE m AS MATERIALIZED (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    ), k AS (
      SELECT conv_id, turn, text AS piece FROM m UNION ALL SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM m
    ), n AS (
      SELECT conv_id, turn, trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g')) AS key FROM k
    ), o AS MATERIALIZED (
      SELECT conv_id, key, min(turn) AS original FROM n WHERE key <> '' GROUP BY ALL
    ), w AS MATERIALIZED (
      SELECT conv_id, turn, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g')) AS key FROM m
    ), q AS (
      SELECT m.conv_id, m.turn, 1 AS level, o.original FROM m JOIN w ON w.conv_id = m.conv_id AND w.turn = m.turn - 1
        JOIN o ON o.conv_id = m.conv_id AND o.key = w.key WHERE o.original < m.turn
      UNION ALL
      SELECT m.conv_id, m.turn, 2, o.original FROM m JOIN w ON w.conv_id = m.conv_id AND w.turn = m.turn - 2
        JOIN o ON o.conv_id = m.conv_id AND o.key = w.key WHERE o.original < m.turn
    ), l AS MATERIALIZED (
      SELECT conv_id, turn, max(CASE WHEN level = 1 THEN original END) AS reply_to,
        array_to_string(list_sort(list_distinct(list(original))), ',') AS quoted FROM q GROUP BY ALL
    ), up(conv_id, turn, root, depth) AS (
      SELECT conv_id, turn, reply_to, CAST(1 AS BIGINT) FROM l WHERE reply_to IS NOT NULL
      UNION ALL
      SELECT up.conv_id, up.turn, l.reply_to, up.depth + 1 FROM up JOIN l ON l.conv_id = up.conv_id AND l.turn = up.root AND l.reply_to IS NOT NULL
    ), top AS (
      SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY ALL
    ), c AS (
      SELECT m.conv_id, m.turn, (SELECT count(*) FROM w x WHERE x.conv_id = m.conv_id AND x.turn IN (m.turn - 1, m.turn - 2)) AS n_quoted FROM m
    )
    SELECT m.conv_id, m.turn, m.role, regexp_replace(m.text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS text,
      CAST(c.n_quoted AS BIGINT) AS n_quoted, CAST(c.n_quoted AS BIGINT) AS max_level,
      l.reply_to, coalesce(l.quoted, '') AS quoted, coalesce(top.root, m.turn) AS root, coalesce(top.depth, 0) AS depth
    FROM m JOIN c USING (conv_id, turn) LEFT JOIN l USING (conv_id, turn) LEFT JOIN top USING (conv_id, turn)"""
