"""Quotation linking, in DataFrame functions alone.

Lines that begin with one or more ">" are quotations of that level. Runs of lines of one level form passages; a passage
and, where it has several, each of its lines is normalised and hashed. A message's own (level 0) passages are what others can
quote. Within a conversation each quotation is joined to the latest earlier message that holds the passage as its own;
the message quoted at the lowest level is what is replied to. Replies to replies are followed by pointer doubling, which gives every message
the root and depth of its thread. Its place there is the rank in a walk through the tree of replies (down to each answer and up again), found by
pointer doubling too, so that sorting by (conv_id, thread_turn, place) puts every answer behind what it answers and before
the next answer to the same. Lines whose quotation was found are taken out of the bodies; all others stay.

Only lines of quoting messages and passages of quoting conversations take part in joins; texts are read in the scan and not shuffled
unless many messages quote. A passage or message that a whole conversation repeats or answers is dealt in blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What parts lines.
LINE_END = "\r\n|[\n\r\u0085\u2028\u2029]"
#: The marks of a quoted line: blanks and ">" in front, for example "> > text" or ">>text".
MARKS = r"^(?:[ \t]*>)+"
QUOTING = "(?:^|[\n\r\u0085\u2028\u2029])[ \t]*>"
#: Turns of a block.
BLOCK = 1 << 14


def lines_of(text):
    return F.split(text, LINE_END)


def normalised(text):
    """Folded words parted by single blanks; punctuation and marks at line ends don't matter."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(messages: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, n, level, words) of every line; blank lines keep their number and part passages."""
    lines = messages.select("mid", "conv_id", "turn", F.posexplode(lines_of("text")).alias("n", "line"))
    lines = lines.withColumn("marks", F.regexp_extract("line", MARKS, 0))
    return lines.select("mid", "conv_id", "turn", "n", F.length(F.regexp_replace("marks", "[^>]", "")).alias("level"), normalised(F.expr("substring(line, length(marks) + 1)")).alias("words"))


def _passages(lines: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, level, run, hash, ns): each run of non-blank lines of one level, and each line of a longer run; ns are their line numbers.

    The number of a run is the line number less the count of such lines before it within (message, level): one message at a time.
    """
    full = lines.filter("words <> ''")
    order = Window.partitionBy("mid", "level").orderBy("n")
    runs = full.withColumn("run", F.col("n") - F.row_number().over(order))
    whole = runs.groupBy("mid", "conv_id", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("n", "words"))).alias("x"))
    all_of_it = F.struct(F.xxhash64(F.array_join(F.col("x.words"), " ")).alias("hash"), F.col("x.n").alias("ns"))
    each = F.transform("x", lambda w: F.struct(F.xxhash64(w["words"]).alias("hash"), F.array(w["n"]).alias("ns")))
    pieces = F.when(F.size("x") > 1, F.concat(F.array(all_of_it), each)).otherwise(each)
    return whole.select("mid", "conv_id", "turn", "level", "run", F.explode(pieces).alias("p")).select("mid", "conv_id", "turn", "level", "run", "p.hash", "p.ns")


def _sources(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, hash, turn): who holds a quoted passage as their own text. Messages outside quoting conversations are left out first."""
    talks = quoted.select("conv_id").distinct()
    own = _passages(_lines(messages.join(talks, "conv_id", "left_semi").dropDuplicates(["mid"])).filter("level = 0"))
    keys = quoted.select("conv_id", "hash").distinct()
    return own.select("conv_id", "hash", "turn").distinct().join(keys, ["conv_id", "hash"], "left_semi")


def before(rows: DataFrame, by: list[str], order: str, value, name: str) -> DataFrame:
    """`rows` with `name`: the greatest `value` of the rows of the same `by` whose `order` (a whole number) is smaller, null without one.

    A running maximum within blocks of BLOCK numbers, and one over the blocks' maxima, so a hot group is many tasks' work.
    """
    rows = rows.withColumn("_value", value).withColumn("_block", F.floor(F.col(order) / BLOCK))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "_block").agg(F.max("_value").alias("_top")).withColumn("_earlier", F.max("_top").over(earlier)).drop("_top")
    rows = rows.withColumn("_inside", F.max("_value").over(inside)).join(blocks, [*by, "_block"])
    return rows.withColumn(name, F.greatest("_inside", "_earlier")).drop("_value", "_block", "_inside", "_earlier")


def links(messages: DataFrame) -> DataFrame:
    """(mid, parent_turn, n_passages, n_linked, gone): for each quoting message, what it replies to, and the numbers of the lines that were found."""
    quoting = messages.filter(F.col("text").rlike(QUOTING)).dropDuplicates(["mid"])
    quoted = materialize(_passages(_lines(quoting).filter("level > 0")), "quoted")
    sources = _sources(messages, quoted)
    asked = quoted.select("conv_id", "hash", "turn").distinct().withColumn("own", F.lit(False))
    both = asked.unionByName(sources.withColumn("own", F.lit(True)))
    latest = before(both, ["conv_id", "hash"], "turn", F.when(F.col("own"), F.col("turn")), "source").filter("not own and source is not null")
    found = quoted.join(latest.select("conv_id", "hash", "turn", "source"), ["conv_id", "hash", "turn"], "left")
    passage = F.struct("level", "run")
    best = F.min(F.when(F.col("source").isNotNull(), F.struct("level", (-F.col("source")).alias("back"))))
    return found.groupBy("mid").agg(
        (-best["back"]).alias("parent_turn"), F.size(F.collect_set(passage)).alias("n_passages"),
        F.size(F.collect_set(F.when(F.col("source").isNotNull(), passage))).alias("n_linked"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("source").isNotNull(), F.col("ns"))))).alias("gone"),
    )  # one message's lines


def _doubled(state: DataFrame, to: str, sums: list[str], most_rounds: int = 64) -> DataFrame:
    """Follow the pointers `to` of (conv_id, node, to, sums) to their ends, adding up `sums` on the way; log2 of the longest way in rounds.

    Every node is in the state or is an end. Each round is written to the shared folder.
    """
    state = materialize(state, "pointers")
    for _ in range(most_rounds):
        up = state.select("conv_id", F.col("node").alias(to), F.col(to).alias("_to"), *[F.col(s).alias(f"_{s}") for s in sums])
        joined = state.join(up, ["conv_id", to], "left")
        if joined.filter("_to is not null").isEmpty():
            return state
        state = materialize(joined.select("conv_id", "node", F.coalesce("_to", to).alias(to), *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums]), "pointers")
    raise RuntimeError("reply chains did not end")


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth, place) of replies (conv_id, turn, parent_turn) and of the messages they lead to.

    Parents are earlier turns, so there is no cycle. place counts from 0 at the thread's first message.
    """
    kinds = "conv_id long, turn long, thread_turn long, depth long, place long"
    if replies.isEmpty():
        return replies.sparkSession.createDataFrame([], kinds)
    one = F.lit(1).cast("long")
    up = _doubled(replies.select("conv_id", F.col("turn").alias("node"), F.col("parent_turn").alias("thread_turn"), one.alias("depth")), "thread_turn", ["depth"])
    tops = up.select("conv_id", F.col("thread_turn").alias("turn")).distinct()
    rooted = materialize(up.withColumnRenamed("node", "turn").unionByName(tops.select("conv_id", "turn", F.col("turn").alias("thread_turn"), F.lit(0).cast("long").alias("depth"))), "rooted")
    # a walk enters each message (2 x turn) and leaves it (2 x turn + 1); entering counts
    first = replies.groupBy("conv_id", "parent_turn").agg(F.min("turn").alias("first")).withColumnRenamed("parent_turn", "turn")
    after = before(replies.withColumn("back", -F.col("turn")), ["conv_id", "parent_turn"], "back", F.col("back"), "_next").select("conv_id", "turn", "parent_turn", (-F.col("_next")).alias("sibling"))
    nodes = rooted.select("conv_id", "turn").join(first, ["conv_id", "turn"], "left").join(after, ["conv_id", "turn"], "left")
    enters = nodes.select("conv_id", (F.col("turn") * 2).alias("node"), F.coalesce(F.col("first") * 2, F.col("turn") * 2 + 1).alias("next"), one.alias("steps"))
    leaves = nodes.select("conv_id", (F.col("turn") * 2 + 1).alias("node"), F.coalesce(F.col("sibling") * 2, F.col("parent_turn") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("steps"))
    # the last step of a thread has no next: it leads to an end of its own
    end = F.lit(-(1 << 62)).cast("long")
    ranked = _doubled(enters.unionByName(leaves).withColumn("next", F.coalesce("next", end)), "next", ["steps"])
    rank = ranked.filter("node % 2 = 0").select("conv_id", (F.col("node") / 2).cast("long").alias("turn"), "steps")
    whole = rank.join(tops, ["conv_id", "turn"], "left_semi").select("conv_id", F.col("turn").alias("thread_turn"), F.col("steps").alias("all"))
    placed = rooted.join(rank, ["conv_id", "turn"]).join(whole, ["conv_id", "thread_turn"])
    return materialize(placed.select("conv_id", "turn", "thread_turn", "depth", (F.col("all") - F.col("steps")).alias("place")), "threads")


def conversations(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, body, parent_turn, thread_turn, depth, place, n_passages, n_linked.

    body is the text; where quotations were found, it is without their lines, with line feeds between lines and at most one blank line
    between paragraphs. Quoted lines that nobody wrote before stay. Line ends are LF, CR, CR LF, NEL and the two Unicode separators. A message that
    links nothing opens a thread: parent_turn null, thread_turn its own turn, depth and place 0. Null texts have a null body. Messages
    of one (conv_id, turn) are one place in the conversation: the latest message that one of them replies to counts for its descendants and its
    place, while each row keeps its own links. Rows with a null conv_id or turn link nothing. Whole rows that repeat are repeated. n_passages counts
    quoted passages, n_linked those found, whole or by a line. Turns are whole numbers from 0.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # a message is known by its content, so a repeated task gives the same ids and equal messages are one
    rows = rows.withColumn("mid", F.xxhash64("conv_id", "turn", "text"))
    placed = rows.filter("conv_id is not null and turn is not null and text is not null")
    linked = materialize(links(placed), "replies")
    named = linked.filter("parent_turn is not null").join(placed.filter(F.col("text").rlike(QUOTING)).select("mid", "conv_id", "turn").distinct(), "mid")
    tree = threads(materialize(named.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent_turn")), "places"))
    above = tree.select("conv_id", F.col("turn").alias("parent_turn"), "thread_turn", (F.col("depth") + 1).alias("depth"))
    replies = named.select("mid", "conv_id", "turn", "parent_turn").join(above, ["conv_id", "parent_turn"]).join(tree.select("conv_id", "turn", "place"), ["conv_id", "turn"])
    found = linked.join(replies.select("mid", "thread_turn", "depth", "place"), "mid", "left")
    found = materialize(found, "found")  # of known size: where few messages quote, the texts stay where they are
    out = rows.join(found, "mid", "left")
    left = F.array_join(F.filter(lines_of("text"), lambda line, n: ~F.array_contains("gone", n)), "\n")
    body = F.when(F.size("gone") > 0, F.btrim(F.regexp_replace(left, "\n{3,}", "\n\n"), F.lit("\n "))).otherwise(F.col("text"))
    zero = F.lit(0)
    return out.select(
        "conv_id", "turn", "role", body.alias("body"), "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", zero).cast("long").alias("depth"), F.coalesce("place", zero).cast("long").alias("place"),
        F.coalesce("n_passages", zero).cast("long").alias("n_passages"), F.coalesce("n_linked", zero).cast("long").alias("n_linked"),
    )


#: The same for DuckDB, over the table `conversations`: words are compared instead of hashes, and places come from the sorted ways to the root.
SQL = r"""
WITH RECURSIVE m AS (
    SELECT row_number() OVER () AS mid, conv_id, turn, role, text, string_split_regex(text, '\r\n|[\n\r\x{85}\x{2028}\x{2029}]') AS parts FROM conversations
), l AS (
    SELECT mid, conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL
), marked AS (
    SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marks FROM l
), words AS (
    SELECT mid, conv_id, turn, n, length(regexp_replace(marks, '[^>]', '', 'g')) AS level,
           trim(regexp_replace(lower(substr(line, length(marks) + 1)), '[^\p{L}\p{N}]+', ' ', 'g')) AS words
    FROM marked
), runs AS (
    SELECT *, n - row_number() OVER (PARTITION BY mid, level ORDER BY n) AS run FROM words WHERE words <> ''
), pieces AS (
    SELECT mid, conv_id, turn, level, run, words, [n] AS ns FROM runs
    UNION ALL
    SELECT mid, conv_id, turn, level, run, string_agg(words, ' ' ORDER BY n), list(n) FROM runs GROUP BY mid, conv_id, turn, level, run HAVING count(*) > 1
), sources AS (
    SELECT DISTINCT conv_id, words, turn AS source FROM pieces WHERE level = 0
), found AS (
    SELECT q.mid, q.conv_id, q.turn, q.level, q.run, q.ns, max(s.source) AS source
    FROM pieces q LEFT JOIN sources s ON s.conv_id = q.conv_id AND s.words = q.words AND s.source < q.turn
    WHERE q.level > 0 GROUP BY q.mid, q.conv_id, q.turn, q.level, q.run, q.ns, q.words
), linked AS (
    SELECT mid, conv_id, turn, arg_min(source, level * 1000000000000 - source) AS parent_turn, count(DISTINCT (level, run)) AS n_passages,
           count(DISTINCT CASE WHEN source IS NOT NULL THEN (level, run) END) AS n_linked, flatten(list(ns) FILTER (WHERE source IS NOT NULL)) AS gone
    FROM found GROUP BY mid, conv_id, turn
), places AS (
    SELECT conv_id, turn, max(parent_turn) AS parent_turn FROM linked WHERE parent_turn IS NOT NULL GROUP BY conv_id, turn
), tree AS (
    SELECT DISTINCT p.conv_id, p.parent_turn AS turn, p.parent_turn AS thread_turn, 0 AS depth, [p.parent_turn] AS path
    FROM places p WHERE NOT EXISTS (SELECT 1 FROM places q WHERE q.conv_id = p.conv_id AND q.turn = p.parent_turn)
    UNION ALL
    SELECT p.conv_id, p.turn, t.thread_turn, t.depth + 1, list_append(t.path, p.turn) FROM tree t JOIN places p ON p.conv_id = t.conv_id AND p.parent_turn = t.turn
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, thread_turn ORDER BY path) - 1 AS place FROM tree
)
SELECT m.conv_id, m.turn, m.role,
       CASE WHEN len(k.gone) > 0 THEN trim(regexp_replace(array_to_string([m.parts[i] FOR i IN range(1, len(m.parts) + 1) IF NOT list_contains(k.gone, i)], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')
            ELSE m.text END AS body,
       k.parent_turn, coalesce(a.thread_turn, m.turn) AS thread_turn, coalesce(a.depth + 1, 0)::BIGINT AS depth,
       CASE WHEN k.parent_turn IS NULL THEN 0 ELSE own.place END::BIGINT AS place, coalesce(k.n_passages, 0)::BIGINT AS n_passages, coalesce(k.n_linked, 0)::BIGINT AS n_linked
FROM m LEFT JOIN linked k ON k.mid = m.mid
LEFT JOIN placed a ON a.conv_id = m.conv_id AND a.turn = k.parent_turn
LEFT JOIN placed own ON own.conv_id = m.conv_id AND own.turn = m.turn
"""
