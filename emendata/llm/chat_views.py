"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant and the
others as named users; system turns stay system turns and are no participants. The mask marks what is to be
learned: the assistant's turns with their end marks. A view of up to TURNS turns is one row. A longer one comes
in pieces of TURNS turns that follow each other without a gap: their texts, one behind the other, are the whole
view, and spans count its characters. So no row holds more than TURNS turns, whatever their numbers are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TURNS = 256
#: Fixed values of the template.
SYSTEM, END, UNKNOWN = "system", "<|end|>\n", "unknown"


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with position: gapless from 0 in each dialogue, by turn, name and text.

    Rows lie in sorted ranges, so a dialogue may spread over many tasks; a part begins after the parts before it.
    """
    order = ["conv", "lone", "turn", "name", "said"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("id", F.monotonically_increasing_id())
    # the number of a row's partition, and its place there
    placed = laid.withColumns({"part": F.shiftright("id", 33), "at": F.col("id").bitwiseAND((1 << 33) - 1)})
    parts = placed.groupBy("conv", "lone", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv", "lone").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("conv", "lone", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return placed.join(first, ["conv", "lone", "part"]).select(*order, (F.col("first") + F.col("at") - F.col("low")).alias("position"))


def _head(name: Column, own: Column) -> Column:
    return F.when(name == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def _begins(numbered: DataFrame) -> DataFrame:
    """(conv, lone, piece, perspective, start) for each piece of each view, from lengths by piece and speaker.

    A view's length is that of a reader who says nothing, less what the speaker's own heads are shorter by.
    """
    spoken = numbered.groupBy("conv", "lone", "piece", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("said")).alias("said"))
    spoken = materialise(spoken.withColumn("size", F.col("said") + F.col("n") * (F.length(_head(F.col("name"), F.lit(False))) + len(END))))
    whole = spoken.groupBy("conv", "lone", "piece").agg(F.sum("size").alias("size"))
    participants = spoken.filter(F.col("name") != SYSTEM).select("conv", "lone", F.col("name").alias("perspective")).distinct()
    less = F.col("n") * (F.length(_head(F.col("name"), F.lit(False))) - F.length(_head(F.col("name"), F.lit(True))))
    own = spoken.select("conv", "lone", "piece", F.col("name").alias("perspective"), less.alias("less"))
    sizes = whole.join(participants, ["conv", "lone"]).join(own, ["conv", "lone", "piece", "perspective"], "left")
    before = Window.partitionBy("conv", "lone", "perspective").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") - F.coalesce("less", F.lit(0))).over(before), F.lit(0))
    return sizes.select("conv", "lone", "piece", "perspective", start.alias("start"))


def rotate(df: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, perspective, piece, n_turns, start, text, spans) for each participant of each dialogue.

    ``df`` has conv_id, turn, role (the speaker's name) and text; other columns are ignored. A null role is the
    participant "unknown", a null text is empty, a null turn comes first (as -1), and rows without conv_id form
    one dialogue. Turns of equal number follow by name and text, and repeated rows are rendered each. A dialogue
    of system turns alone has no participant and gives no row. A piece begins at character ``start`` of the
    view; spans are (start, end) in characters of the view.
    """
    kind = df.schema["conv_id"].dataType
    rows = df.select(
        F.coalesce(F.col("conv_id"), F.lit(0).cast(kind)).alias("conv"),
        F.col("conv_id").isNull().alias("lone"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role"), F.lit(UNKNOWN)).alias("name"),
        F.coalesce(F.col("text"), F.lit("")).alias("said"),
    )
    numbered = _numbered(rows).withColumn("piece", F.expr(f"position div {turns}"))
    # dealt by pieces, so that a long dialogue is spread, and grouped without another exchange
    joined = numbered.join(_begins(numbered), ["conv", "lone", "piece"])
    own = F.col("name") == F.col("perspective")
    turn = F.struct("position", "said", _head(F.col("name"), own).alias("head"), own.alias("own"))
    placed = joined.groupBy("conv", "lone", "piece", "perspective").agg(F.first("start").alias("start"), F.array_sort(F.collect_list(turn)).alias("parts"))
    nothing = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(done, part):
        first = done["at"] + F.length(part["head"])
        after = first + F.length(part["said"]) + len(END) - 1  # the mask covers the end mark, not the line break
        spans = F.when(part["own"], F.concat(done["spans"], F.array(F.struct(first.alias("start"), after.alias("end"))))).otherwise(done["spans"])
        return F.struct((after + 1).alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["said"], F.lit(END))), "")
    conv_id = F.when(~F.col("lone"), F.col("conv")).alias("conv_id")
    return placed.select(conv_id, "perspective", "piece", F.size("parts").cast("long").alias("n_turns"), "start", text.alias("text"), F.aggregate("parts", nothing, step)["spans"].alias("spans"))


def mask_text(spans: str = "spans"):
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


ORACLE = """
WITH rows AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, name, said) - 1 AS position
    FROM (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS said FROM conversations)
), participants AS (
    SELECT DISTINCT conv_id AS c, name AS perspective FROM rows WHERE name <> 'system'
), views AS (
    SELECT conv_id, perspective, position // 256 AS piece, position, name, said,
        CASE WHEN name = 'system' THEN '<|system|>' WHEN name = perspective THEN '<|assistant|>' ELSE '<|user name=' || name || '|>' END || chr(10) AS head
    FROM rows JOIN participants ON conv_id IS NOT DISTINCT FROM c
), placed AS (
    SELECT *, coalesce(sum(length(head) + length(said) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
    FROM views
)
SELECT conv_id, perspective, piece::BIGINT AS piece, count(*) AS n_turns, min(begins)::BIGINT AS start,
    string_agg(head || said || '<|end|>' || chr(10), '' ORDER BY position) AS text,
    coalesce(string_agg(CAST(begins + length(head) AS BIGINT) || '-' || CAST(begins + length(head) + length(said) + 7 AS BIGINT), ',' ORDER BY position) FILTER (WHERE name = perspective), '') AS mask
FROM placed GROUP BY conv_id, perspective, piece
"""
