"""Preference formatting of chats: the common turns of a chosen and a rejected conversation once as prompt, then both completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.llm import skew
from tracehound.llm.common import shared_folder, table, written

OPEN, HEAD, CLOSE = "<|", "|>\n", "<|end|>\n"
LAST = 2**63 - 1
#: Conversations with one opening that share a copy of the chosen one's turns.
PAIRS_A_SHARE = 128


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template. Markers inside a text are broken, so that no text can open or close a turn."""
    return F.concat(F.lit(OPEN), role, F.lit(HEAD), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit(CLOSE))


def preference_format(sides: DataFrame) -> DataFrame:
    """Rows (pair_id, side, turn, role, text), side 'chosen' or 'rejected', as rows (pair_id, part, turn, rendered, loss_start, loss_end).

    Turns up to the first one that is not the same on both sides are the prompt, once; from there on each side is a
    completion. The loss covers the text and end of assistant turns in completions: characters loss_start to loss_end
    of `rendered`, both 0 elsewhere. Parts in order of turn, put together, are the training texts (see `assembled`).

    Null roles are 'unknown', null texts empty, null turns come last. Rows that share pair, side and turn are one turn, in
    order of role and text; all that differ stay, and the turn is common if both sides have the same rows. A row repeated in
    all three counts once, but for rows without a turn, which stay as often as they come. Rows without a pair_id belong to no pair. Equal sides give a prompt only; a side without turns leaves the other
    as completion. Work is by pair, turn and text, so a pair or a turn of any length is spread.
    """
    rows = sides.where("pair_id IS NOT NULL").select(
        "pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    times = [F.count(F.when(F.col("side") == side, 1)).alias(side) for side in ("chosen", "rejected")]
    once = [F.when(F.col("turn") == LAST, F.col(n)).otherwise(F.least(n, F.lit(1))).alias(n) for n in ("chosen", "rejected")]
    both = written(rows.groupBy("pair_id", "turn", "role", "text").agg(*times).select("pair_id", "turn", "role", "text", *once), shared_folder(sides.sparkSession), "turns")
    split = both.where("chosen != rejected").groupBy("pair_id").agg(F.min("turn").alias("split"))
    placed = both.join(split, "pair_id", "left")
    part = lambda name, n: F.struct(F.lit(name).alias("part"), F.col(n).alias("n"))
    prompt = F.coalesce(F.col("turn") < F.col("split"), F.lit(True))
    parts = F.when(prompt, F.array(part("prompt", "chosen"))).otherwise(F.array(part("chosen", "chosen"), part("rejected", "rejected")))
    out = placed.select("pair_id", "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), F.explode(parts).alias("p")).where("p.n > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("p.n").cast("int")))).select("pair_id", "p.part", "turn", "role", "rendered")
    loss = (F.col("role") == "assistant") & (F.col("part") != "prompt")
    start = F.when(loss, F.length("role") + len(OPEN) + len(HEAD)).otherwise(0)
    end = F.when(loss, F.length("rendered") - 1).otherwise(0)
    return out.select("pair_id", "part", "turn", "rendered", start.cast("long").alias("loss_start"), end.cast("long").alias("loss_end"))


def assembled(parts: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected, and the loss spans of both completions. For pairs whose texts fit into a cell."""
    by_turn = F.array_sort(F.collect_list(F.struct("turn", "rendered", "loss_start", "loss_end"))).alias("turns")
    rows = parts.groupBy("pair_id", "part").agg(by_turn)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.when(t["loss_end"] > 0, F.array(F.array(acc["at"] + t["loss_start"], acc["at"] + t["loss_end"]))).otherwise(F.array().cast("array<array<bigint>>"))
        return F.struct((acc["at"] + F.length(t["rendered"])).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    rows = rows.select("pair_id", "part", F.array_join("turns.rendered", "").alias("text"), F.aggregate("turns", start, step)["spans"].alias("spans"))
    first = lambda part, col: F.max(F.when(F.col("part") == part, F.col(col)))
    texts = [F.coalesce(first(p, "text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")]
    return rows.groupBy("pair_id").agg(*texts, *[F.coalesce(first(p, "spans"), F.array().cast("array<array<bigint>>")).alias(f"{p}_loss") for p in ("chosen", "rejected")])


def paired(conversations: DataFrame) -> DataFrame:
    """Sides of a pair for every conversation (conv_id, turn, role, text); pair_id is a conv_id.

    Conversations with the same first turn are answers to one opening: the one with most rows, then the smallest id,
    is chosen, and each other is rejected against it. A conversation alone with its opening is chosen against itself
    with the last assistant turn replaced by an echo of its first user turn. Turns behind the last assistant turn stay, as
    parts without a loss; a conversation without one is a prompt only. Pairs are stars around the chosen one, not all pairs of a group.

    Rows that share a conversation and a turn all stay, a repeated row once; null turns are its last turn, and stay as often
    as they come; of rows of one turn the first by role and text opens the conversation. Rows without a conv_id belong to none. Conversations with one
    opening are dealt over shares of `PAIRS_A_SHARE`, each with the turns of the chosen one.
    """
    c = conversations.where("conv_id IS NOT NULL").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    folder = shared_folder(conversations.sparkSession)
    c = written(c.where(F.col("turn") < LAST).distinct().unionByName(c.where(F.col("turn") == LAST)), folder, "conversations")
    user = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"]
    heads = c.groupBy("conv_id").agg(
        F.sha2(F.min(F.struct("turn", F.concat_ws("\n", "role", "text").alias("s")))["s"], 256).alias("opening"), F.count("*").alias("turns"),
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"), F.coalesce(user, F.lit("")).alias("echo"),
    )
    heads = written(heads, folder, "heads")
    best = written(heads.groupBy("opening").agg(F.min(F.struct((-F.col("turns")).alias("turns"), "conv_id"))["conv_id"].alias("best"), F.count("*").alias("n")), folder, "best")
    heads = skew.joined(heads, best, "opening", best.select("opening", "n"))
    named = written(heads.select("conv_id", "last", "echo", "best", F.col("n").alias("pairs"), F.col("turns").alias("n")), folder, "named")
    joined = skew.joined(c, named.drop("n"), "conv_id", named.select("conv_id", "n")).withColumnRenamed("pairs", "n")
    own = joined.where("n > 1 AND conv_id != best").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    shares = F.ceil(F.col("pairs") / PAIRS_A_SHARE).cast("int")
    stars = named.where("pairs > 1 AND conv_id != best").select(F.col("conv_id").alias("pair_id"), F.col("best").alias("b"), F.pmod(F.xxhash64("conv_id"), shares).cast("int").alias("share"))
    models = joined.where("n > 1 AND conv_id = best").select(F.col("conv_id").alias("b"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PAIRS_A_SHARE).cast("int") - 1)).alias("share"), "turn", "role", "text")
    chosen = stars.join(models, ["b", "share"]).select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    alone = joined.where("n = 1").select(F.col("conv_id").alias("pair_id"), F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side"), "turn", "role", "text", "last", "echo")
    text = F.when((F.col("side") == "rejected") & (F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.col("echo")).otherwise(F.col("text"))
    return own.unionByName(chosen).unionByName(alone.select("pair_id", "side", "turn", "role", text.alias("text")))


def query(spark, sf_dir: str) -> DataFrame:
    return preference_format(paired(table(spark, sf_dir, "conversations")))


SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
      UNION ALL SELECT conv_id, 9223372036854775807, coalesce(role, 'unknown'), coalesce(text, '') FROM conversations WHERE conv_id IS NOT NULL AND turn IS NULL),
h AS (SELECT conv_id, min(struct_pack(t := turn, s := role || chr(10) || text)).s AS opening, count(*) AS turns, max(turn) FILTER (role = 'assistant') AS last,
             coalesce((min(struct_pack(t := turn, s := text)) FILTER (role = 'user')).s, '') AS echo FROM d GROUP BY conv_id),
b AS (SELECT *, first(conv_id) OVER (PARTITION BY opening ORDER BY turns DESC, conv_id) AS best, count(*) OVER (PARTITION BY opening) AS n FROM h),
cut AS (SELECT d.*, last, echo, best, n FROM d JOIN b USING (conv_id)),
s AS (SELECT conv_id AS pair_id, 'rejected' AS side, turn, role, text FROM cut WHERE n > 1 AND conv_id <> best
      UNION ALL SELECT b.conv_id, 'chosen', cut.turn, cut.role, cut.text FROM b JOIN cut ON cut.conv_id = b.best WHERE b.n > 1 AND b.conv_id <> b.best
      UNION ALL SELECT conv_id, 'chosen', turn, role, text FROM cut WHERE n = 1
      UNION ALL SELECT conv_id, 'rejected', turn, role, CASE WHEN turn = last AND role = 'assistant' THEN echo ELSE text END FROM cut WHERE n = 1),
t AS (SELECT pair_id, turn, role, text, count(*) FILTER (side = 'chosen') AS c, count(*) FILTER (side = 'rejected') AS r FROM s GROUP BY ALL),
p AS (SELECT pair_id, turn, role, text, CASE WHEN turn < 9223372036854775807 THEN least(c, 1) ELSE c END AS c, CASE WHEN turn < 9223372036854775807 THEN least(r, 1) ELSE r END AS r FROM t),
k AS (SELECT pair_id, min(turn) AS split FROM p WHERE c <> r GROUP BY pair_id),
q AS (SELECT p.*, split IS NULL OR turn < split AS pre FROM p LEFT JOIN k USING (pair_id)),
o AS (SELECT pair_id, 'prompt' AS part, turn, role, text, c AS n FROM q WHERE pre UNION ALL SELECT pair_id, 'chosen', turn, role, text, c FROM q WHERE NOT pre UNION ALL SELECT pair_id, 'rejected', turn, role, text, r FROM q WHERE NOT pre),
f AS (SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rendered, unnest(range(n)) AS i FROM o)
SELECT pair_id, part, turn, rendered, CASE WHEN role = 'assistant' AND part <> 'prompt' THEN length(role) + 5 ELSE 0 END::BIGINT AS loss_start,
       CASE WHEN role = 'assistant' AND part <> 'prompt' THEN length(rendered) - 1 ELSE 0 END::BIGINT AS loss_end FROM f
"""
