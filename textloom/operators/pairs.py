"""Preference pairs with nested chat prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.rubrics import valid_chosen, valid_rejected
from textloom.functions.text import py_strip

PART = "struct<type:string,image:string,text:string>"
FALLBACK = "A scene."


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), text.alias("text")).cast(PART)


def image_parts(paths: Column) -> Column:
    return F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.struct(F.lit("image").alias("type"), p.alias("image"), F.lit(None).cast("string").alias("text")).cast(PART))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def with_context(prompt: str, context: Column) -> Column:
    """The prompt, and a line of context where there is one."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(prompt), F.lit("\nContext: "), context)).otherwise(F.lit(prompt))


def preference_pairs(captions: DataFrame, prompt: str, fallback: str = FALLBACK, ident: str = "caption_id") -> DataFrame:
    """One pair per caption whose description is long enough and says where things are; a raw caption that is too short or
    an action code is replaced. Null descriptions give no pair."""
    chosen, rejected = py_strip(F.col("blv_description")), py_strip(F.coalesce("original_caption", F.lit("")))
    asked = F.array(message("user", F.concat(image_parts(F.col("keyframe_paths")), F.array(text_part(with_context(prompt, F.col("rag_context")))))))
    return captions.where(valid_chosen("blv_description")).select(F.col(ident).alias("pair_id"), "video_id", "dataset", "keyframe_paths", asked.alias("prompt"), chosen.alias("chosen"), F.when(valid_rejected(rejected), rejected).otherwise(fallback).alias("rejected"), "rag_context")


def with_turns(pairs: DataFrame, turns: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """pairs and, for each turn(pair_id, question, answer) of one, a pair whose prompt goes on by the parent's answer and
    the question; ids end in _mt. Turns with a short answer or an unknown parent give none."""
    base = pairs.withColumn("pair_id", F.col("pair_id").cast("string"))
    asked = turns.where(F.length(py_strip(F.col("answer"))) > 10).select(F.col("pair_id").cast("string").alias("pair_id"), "question", "answer")
    more = base.join(asked, "pair_id").select(
        F.concat("pair_id", F.lit("_mt")).alias("pair_id"), "video_id", "dataset", "keyframe_paths",
        F.concat("prompt", F.array(message("assistant", F.array(text_part(F.col("chosen")))), message("user", F.array(text_part(F.col("question")))))).alias("prompt"),
        F.col("answer").alias("chosen"), F.lit(fallback).alias("rejected"), "rag_context",
    )
    return base.unionByName(more)


def transcript(prompt: Column, end: str = "<end_of_utterance>\n") -> Column:
    """Role: text of every message, images left out."""
    return F.array_join(F.transform(prompt, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.array_join(F.transform(F.filter(m["content"], lambda p: p["type"] == "text"), lambda p: p["text"]), " "), F.lit(end))), "")


def padded(ids: Column, width: Column, pad: int, left: bool = False) -> Column:
    """An array padded to a width; longer arrays stay."""
    fill = F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def training_rows(df: DataFrame, prompt: str, response: str, batch: str, most: int = 2048, most_response: int = 512, pad: int = 0) -> DataFrame:
    """Padded ids, mask and labels (-100 over prompt and padding) per batch; rows whose prompt fills `most` drop out."""
    fits = df.where(F.size(prompt) < most)
    answer = F.slice(response, 1, most_response)
    whole = fits.withColumn("_ids", F.slice(F.concat(prompt, answer), 1, most)).withColumn("_own", F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), answer), 1, most))
    widest = whole.groupBy(batch).agg(F.max(F.size("_ids")).alias("_w"))
    out = whole.join(widest, batch)
    mask = padded(F.transform("_ids", lambda _: F.lit(1)), F.col("_w"), 0)
    return out.withColumns({"input_ids": padded(F.col("_ids"), F.col("_w"), pad), "attention_mask": mask, "labels": padded(F.col("_own"), F.col("_w"), -100)}).drop("_ids", "_own", "_w")
