r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and
only that reply is trainable.  A turn is written ``<|im_start|>role\ntext<|im_end|>\n``.
Within texts a backslash is put after the ``<`` of whatever looks like ``<|`` behind any
number of backslashes, so no control string can occur there, and one is taken away when
read back.  Roles also have ``%`` and line ends percent-escaped.

``format_conversations`` holds a conversation's text once, with the spans of its examples;
``expand_examples`` streams them out as full texts.  Both are built-in expressions alone: a
conversation is gathered by its id (its digest needs it in order anyway), all further steps
are narrow.

Cases: null text and null role count as empty; turns are ordered by turn, then role, then
text, so ties and repeated rows have a fixed order; a null conversation id is a conversation
of its own; conversations without assistant turns keep a row without examples; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CLOSE_RE = r"<\|im_end\|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """conv_id, formatted text, and examples as array of (example, loss_start, loss_end, n_chars)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    body = escape(text)
    parts = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), F.concat(head, body, F.lit(CLOSE)).alias("piece"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body")).alias("t"))
    conv = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # Lengths add up to where each turn starts; the fold carries one struct per example.
    end = len(CLOSE)
    spans = F.aggregate(
        "ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<example:int,loss_start:bigint,loss_end:bigint,n_chars:bigint>>)").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["body"] + end).alias("at"),
            F.when(
                t["role"] == trainable,
                F.concat(acc["out"], F.array(F.struct(F.size(acc["out"]).alias("example"), (acc["at"] + t["head"]).alias("loss_start"), (acc["at"] + t["head"] + t["body"]).alias("loss_end"), (acc["at"] + t["head"] + t["body"] + end).alias("n_chars")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return conv.select("conv_id", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"), spans.alias("examples"))


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row an example: its text is the conversation up to and with the reply."""
    return formatted.select("conv_id", "formatted", F.explode_outer("examples").alias("e")).select(
        "conv_id", "formatted", F.col("e.example").alias("example"), F.substring("formatted", F.lit(1), F.col("e.n_chars").cast("int")).alias("text"), F.col("e.loss_start").alias("loss_start"), F.col("e.loss_end").alias("loss_end")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array of (role, text)."""
    pieces = F.split(formatted, CLOSE_RE)
    inner = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, len(OPEN) + 1, 2_000_000_000))
    return F.transform(inner, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of what is under the loss mask, read from the examples."""
    ex = expand_examples(formatted).select(
        "conv_id", "formatted", "example", unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))).alias("reply"), F.length("text").alias("n")
    )
    back = ex.groupBy("conv_id").agg(F.max("formatted").alias("formatted"), F.array_sort(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "reply")))).alias("r"), F.count("example").alias("n_examples"), F.coalesce(F.sum("n"), F.lit(0)).alias("example_chars"))
    loss, turns = F.array_join(F.transform("r", lambda x: x["reply"]), ""), read_turns(F.col("formatted"))
    nl = F.lit("\n")
    return back.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], nl, t["text"], nl)), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_examples", F.col("example_chars").cast("long").alias("example_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), l AS (
  SELECT *, row_number() OVER w AS rn, sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(max(upto) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS example_chars
FROM l GROUP BY conv_id
"""
