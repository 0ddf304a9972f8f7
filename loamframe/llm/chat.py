"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into spans of whole turns: with a
step of the tokens that are free for new turns, turns that lie in one step form
a span, and a turn that crosses from one step into another is a span by itself.
So no window is above the budget unless a single turn, or the system turn, is.
Every later window repeats the leading system turn and a few turns of history;
repeated turns carry another mark and no loss, so that each assistant text is a
target exactly once.

In texts `\\` becomes `\\b` and `<` becomes `\\l` (in roles a line break becomes
`\\n`), so that marks never occur in them and the escape is undone letter by letter.

All is DataFrame expressions.  Defined results: null texts and roles are empty;
rows of one conversation with equal turns are ordered by role and text, repeated
rows are turns of their own; a null conversation id is one conversation; null
turns come first; an empty table gives no windows; other columns are not read.
A conversation's turns are ordered in one task, which holds a few of them at a
time and spills; a digest of a whole conversation needs its text in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.llm.mixing import word_count

#: Marks of the template; fixed values.
NEW, NEW_END, AGAIN, AGAIN_END = "<turn>", "</turn>\n", "<again>", "</again>\n"
#: Tokens that a turn's marks count for.
MARK_TOKENS = 2


def escape(text: Column, line_breaks: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_breaks else out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def block(role: Column, text: Column, again: bool = False) -> Column:
    return F.concat(F.lit(AGAIN if again else NEW), role, F.lit("\n"), text, F.lit(AGAIN_END if again else NEW_END))


def format_windows(conversations: DataFrame, budget: int = 512, history_turns: int = 2, history_budget: int = 128, target: str = "assistant", system: str = "system", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """One row per window: conv_id, window, formatted text, loss spans (code points, [start, end)) and n_new turns.

    A turn's tokens are those that the column tokens_col counts, as a tokenizer gives them, or
    else its words; a null count is 0.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    counted = word_count(text) if tokens_col is None else F.coalesce(F.col(tokens_col), F.lit(0)).cast("long")
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), counted.alias("counted"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select(
        "conv",
        F.row_number().over(order).alias("pos"),
        F.col("role"),
        escape(F.col("role"), line_breaks=True).alias("r"),
        escape(F.col("text")).alias("t"),
        (F.col("counted") + MARK_TOKENS).alias("tokens"),
    )
    order = Window.partitionBy("conv").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("lead", (F.col("pos") == 1) & (F.col("role") == system))
    rows = rows.withColumn("system", F.first(F.when(F.col("lead"), F.struct("r", "t", "tokens"))).over(so_far))
    rows = rows.withColumn("fresh", F.when(F.col("lead"), 0).otherwise(F.col("tokens")))
    rows = rows.withColumn("end", F.sum("fresh").over(so_far)).withColumn("start", F.col("end") - F.col("fresh"))
    step = F.greatest(F.lit(1), F.lit(budget - history_budget) - F.coalesce(F.col("system.tokens"), F.lit(0)))
    rows = rows.withColumn("low", F.floor(F.col("start") / step)).withColumn("high", F.floor((F.col("end") - 1) / step))
    last_low, last_high, after_lead = F.lag("low").over(order), F.lag("high").over(order), F.lag("lead").over(order)
    cut = (F.col("pos") > 1) & ~after_lead & ((F.col("low") != last_low) | (F.col("high") != last_high))
    past = F.collect_list(F.struct("lead", "r", "t", "tokens")).over(order.rowsBetween(-history_turns, -1)) if history_turns else F.array().cast("array<struct<lead:boolean,r:string,t:string,tokens:long>>")
    rows = rows.withColumn("cut", F.coalesce(cut, F.lit(False))).withColumn("past", F.when(F.col("cut"), past))
    rows = rows.withColumn("window", F.sum(F.col("cut").cast("long")).over(so_far))
    grouped = rows.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "r", "t"))).alias("turns"),
        F.min(F.struct("pos", "system")).getField("system").alias("system"),
        F.min(F.struct("pos", "past")).getField("past").alias("past"),
    )
    # the longest end of the history whose tokens are within their budget
    usable = F.filter("past", lambda h: ~h.lead)
    fitting = F.filter(
        F.transform(usable, lambda h, i: F.struct(h.alias("h"), F.aggregate(F.slice(F.col("usable"), i + 1, F.greatest(F.lit(1), F.size("usable"))), F.lit(0).cast("long"), lambda a, x: a + x.tokens).alias("sum"))),
        lambda x: x["sum"] <= history_budget,
    )
    repeated = grouped.withColumn("usable", usable).withColumn("fitting", fitting)
    head = F.concat(
        F.when((F.col("window") > 0) & F.col("system").isNotNull(), block(F.col("system.r"), F.col("system.t"), again=True)).otherwise(F.lit("")),
        F.coalesce(F.array_join(F.transform("fitting", lambda x: block(x.h.r, x.h.t, again=True)), ""), F.lit("")),
    )
    before = F.char_length(F.lit(NEW)) + 1  # the mark and the line break around the role
    spans = F.aggregate(
        "turns",
        F.struct(F.char_length("head").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda s, x: F.struct(
            (s.at + before + F.char_length(x.r) + F.char_length(x.t) + len(NEW_END)).cast("long").alias("at"),
            F.when(
                x.role == target,
                F.concat(s.spans, F.array(F.struct((s.at + before + F.char_length(x.r)).cast("long").alias("start"), (s.at + before + F.char_length(x.r) + F.char_length(x.t)).cast("long").alias("end")))),
            ).otherwise(s.spans).alias("spans"),
        ),
        lambda s: s.spans,
    )
    body = F.array_join(F.transform("turns", lambda x: block(x.r, x.t)), "")
    done = repeated.withColumn("head", head).select("conv", "window", F.concat("head", body).alias("formatted"), spans.alias("loss"), F.size("turns").cast("long").alias("n_new"))
    return done.withColumnRenamed("conv", conv_col)


def read_windows(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per window what its text says: the new turns (role, text) and the unescaped text under the loss spans."""
    pieces = F.filter(F.split("formatted", "</(?:turn|again)>\n"), lambda p: F.startswith(p, F.lit(NEW)))
    turns = F.transform(
        F.transform(pieces, lambda p: F.split(p, "\n", 2)),
        lambda x: F.struct(unescape(F.substring(F.get(x, F.lit(0)), len(NEW) + 1, 1 << 30)).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")),
    )
    targets = F.array_join(F.transform("loss", lambda s: F.substring(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int"))), "")
    return windows.select(conv_col, "window", "formatted", turns.alias("turns"), unescape(targets).alias("target"))


def digests(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation: number and digest of its turns, length and digest of its loss text, length of its windows."""
    read = read_windows(windows, conv_col).select(
        conv_col,
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").alias("said"),
            "target",
        ).alias("w"),
        F.size("turns").cast("long").alias("n"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    sums = read.groupBy(conv_col).agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("w.target", "")
    return sums.select(
        conv_col,
        "n_turns",
        F.sha2(F.array_join("w.said", "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
