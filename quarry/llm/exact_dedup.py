"""Exact dedup by skew-safe combining, in DataFrame operations alone.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one
space. Copies are combined in three steps, each of which groups by the whole
normalised text next to its SHA-256, so that two texts with one digest never meet:

1. in each map task, by Spark's partial aggregation;
2. per digest, text and salt, so that a text with a third of all rows is spread
   over ``salts`` reducers;
3. per digest and text, over at most ``salts`` winners.

A text never travels more than twice, and nothing but a minimum and a count is
kept of a group. Rows find their group by digest, which step 3 has shown to stand
for one text; should a digest ever stand for two, rows find it by the text too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import stored, width

#: A run that already is one space needs no replacing; leaving it out keeps matches rare.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: One more than any long: positions fit below, and a null id comes after any id.
_STEP = "1" + "0" * 19


def normalised(text: Column) -> Column:
    """The text by which rows are compared; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as one struct ``_row``, with digest, text and an order that no two rows share."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_at"))
    ident = F.coalesce(F.col("_row")[id_col].cast("decimal(19,0)"), F.lit("9" * 19).cast("decimal(19,0)"))
    order = (ident * F.lit(_STEP).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col("_at").cast("decimal(19,0)")
    text = normalised(F.col("_row")[text_col])
    made = row.select("_row", F.col("_row")[id_col].cast("long").alias("_id"), order.cast("decimal(38,0)").alias("_order"), text.alias("_text"))
    return made.withColumn("_digest", F.unhex(F.sha2("_text", 256)))


def _groups(docs: DataFrame, id_col: str, text_col: str, salts: int) -> tuple[DataFrame, bool]:
    """(_digest, _first, _keep, _size[, _text]) and whether a digest stands for several texts."""
    keyed = _keyed(docs, id_col, text_col).select("_id", "_order", "_text", "_digest")
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(salts)))
    part = salted.groupBy("_digest", "_text", "_salt").agg(F.min("_order").alias("_first"), F.min("_id").alias("_keep"), F.count("*").alias("_size"))
    merged = [F.min("_first").alias("_first"), F.min("_keep").alias("_keep"), F.sum("_size").alias("_size")]
    whole = part.repartition(width(docs.sparkSession), "_digest").groupBy("_digest", "_text").agg(*merged)
    by_digest = whole.groupBy("_digest").agg(*merged, F.count("*").alias("_texts"))
    digests = stored(by_digest, "exact-digests")
    if digests.where("_texts > 1").isEmpty():
        return digests.drop("_texts"), False
    return stored(whole, "exact-texts"), True


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The smallest id of equal texts stays; a null id comes after all others. Rows that
    repeat both text and id are told apart by position, so exactly one row of a group is
    kept; if all ids of a group are null, ``keep_id`` is null and one row is kept.
    A null text counts as empty and empty texts are equal. Other columns, whatever their
    names and nulls, are carried in ``row``. An empty table gives no rows. ``docs`` must
    give the same rows in the same order when read twice, as a table or a scan does.
    """
    groups, shared = _groups(docs, id_col, text_col, salts)
    keyed = _keyed(docs, id_col, text_col).drop("_id")
    joined = keyed.join(groups, ["_digest", "_text"] if shared else "_digest")
    return joined.select(
        F.col("_row").alias("row"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_order") == F.col("_first")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; one of each group of equal texts."""
    groups, shared = _groups(docs, id_col, text_col, salts)
    keyed = _keyed(docs, id_col, text_col)
    on = (keyed["_digest"] == groups["_digest"]) & (keyed["_order"] == groups["_first"])
    if shared:
        on &= keyed["_text"] == groups["_text"]
    return keyed.join(groups, on, "left_semi").select("_row.*")
