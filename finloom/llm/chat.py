"""Operator 2: chat formatting with Spark expressions only.

Turn structs are collected per conversation and sorted, adjacent turns of one
role share a block, and the blocks are concatenated.  The template is

    <s>[INST]role[/INST]text[TURN]text</s>[INST]role[/INST]text</s>

where ``[TURN]`` parts the turns of one block.  Control strings inside roles and
texts get a backslash after their first character (one more, if some are there),
which ``unescape`` takes out again, so that ``parse`` gives every turn back.
``loss_runs`` is the loss mask as run lengths over the output: per turn a run of
markers and a run of text, true for assistant texts.

One shuffle, on conv_id; a conversation is one output row, so it is the unit that
has to fit a task.

Defined cases: null text or role is the empty string; turns sort by (turn, role,
text), null turns first; repeated rows are repeated turns; rows with a null
conv_id form one conversation of null id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm.common import let, prefix_sums, read

LOSS_ROLE = "assistant"
_REST = r"(/?s>|/?INST\]|TURN\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def render(turns: Column) -> Column:
    """struct(formatted, loss_runs) of a sorted array of struct(role, text)."""

    def body(ts: Column) -> Column:
        def marker(t: Column, i: Column) -> Column:
            head = F.concat(F.lit("[INST]"), escape(t["role"]), F.lit("[/INST]"))
            return (
                F.when(i == 0, F.concat(F.lit("<s>"), head))
                .when(F.get(ts, i - 1)["role"] != t["role"], F.concat(F.lit("</s>"), head))
                .otherwise("[TURN]")
            )

        pieces = F.transform(
            ts,
            lambda t, i: F.struct(
                marker(t, i).alias("marker"), escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")
            ),
        )

        def out(ps: Column) -> Column:
            run = lambda chars, loss: F.struct(F.length(chars).alias("chars"), loss.alias("loss"))
            return F.struct(
                F.concat(
                    F.array_join(F.transform(ps, lambda p: F.concat(p["marker"], p["text"])), ""), F.lit("</s>")
                ).alias("formatted"),
                F.concat(
                    F.flatten(
                        F.transform(ps, lambda p: F.array(run(p["marker"], F.lit(False)), run(p["text"], p["loss"])))
                    ),
                    F.array(run(F.lit("</s>"), F.lit(False))),
                ).alias("loss_runs"),
            )

        return let(pieces, out)

    return let(turns, body)


def parse(formatted: Column) -> Column:
    """The turns, as array of struct(role, text), read back from a formatted conversation."""
    inner = F.substr(formatted, F.lit(4), F.length(formatted) - 7)
    return F.flatten(
        F.transform(
            F.split(inner, "</s>"),
            lambda block: let(
                F.split(block, r"\[/INST\]"),
                lambda part: F.transform(
                    F.split(F.element_at(part, 2), r"\[TURN\]"),
                    lambda t: F.struct(
                        unescape(F.substr(F.element_at(part, 1), F.lit(7))).alias("role"), unescape(t).alias("text")
                    ),
                ),
            ),
        )
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_runs: one row per conversation."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select("conv_id", F.struct(F.col("turn"), blank("role"), blank("text")).alias("t"))
    by_turn = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return by_turn.select("conv_id", render(F.col("ts")).alias("r")).select("conv_id", "r.formatted", "r.loss_runs")


def under_mask(formatted: Column, runs: Column) -> Column:
    """The text under the loss mask: the formatted text cut by the lengths of the runs, control strings restored."""

    def body(starts: Column) -> Column:
        cut = F.transform(runs, lambda r, i: F.when(r["loss"], F.substr(formatted, (F.get(starts, i) + 1).cast("int"), r["chars"].cast("int"))))
        return F.array_join(F.transform(cut, unescape), "")

    return let(prefix_sums(F.transform(runs, lambda r: r["chars"])), body)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output: turns, and the text under the loss mask."""

    def body(ts: Column) -> Column:
        line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
        return F.struct(F.size(ts).cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform(ts, line), ""), 256).alias("turns_sha256"))

    got = formatted.select(
        "conv_id", let(parse(F.col("formatted")), body).alias("d"), under_mask(F.col("formatted"), F.col("loss_runs")).alias("loss_text"), "formatted"
    )
    return got.select(
        "conv_id",
        "d.n_turns",
        "d.turns_sha256",
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(
        """SELECT conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
           FROM VALUES (-1L, 0L, 'user'), (-1L, 1L, 'assistant') AS t(conv_id, turn, role)"""
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(turns.unionByName(probe)))


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|TURN\])', '\1\\\2\3', 'g')"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, length({_ESC.format("text")}) AS chars,
         CASE WHEN i = 1 THEN 16 + length({_ESC.format("role")})
              WHEN before <> role THEN 17 + length({_ESC.format("role")}) ELSE 6 END AS marker
  FROM o
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS all_text,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss_text,
         sum(chars + marker) + 4 AS formatted_chars
  FROM p GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss_text)::BIGINT AS loss_chars,
       sha256(loss_text) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM g
"""
