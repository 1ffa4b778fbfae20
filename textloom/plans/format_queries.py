"""Queries of sources and sinks: each writes a table in a format of the reference and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import rubrics as R
from textloom.functions.vectors import from_blob, to_blob
from textloom.operators import sets as S
from textloom.plans.registry import Tables, query
from textloom.session import step_path
from textloom.sources import io
from textloom.streaming import incremental as I


@query("SELECT eval_id, video_id, dataset, blv_description FROM balanced_eval")
def o_src_1_snk_1(t: Tables) -> DataFrame:
    """JSON arrays: written over what stood there, read whole."""
    path = step_path(t.spark, "array")
    rows = t.balanced_eval.select("eval_id", "video_id", "dataset", "blv_description")
    io.write_json_array(rows.limit(1), path)
    io.write_json_array(rows, path)
    return io.json_array(t.spark, path, "eval_id long, video_id string, dataset string, blv_description string")


@query("SELECT train_id::varchar AS video_id, blv_description AS value FROM balanced_train")
def o_src_2(t: Tables) -> DataFrame:
    path = step_path(t.spark, "map")
    io.write_json_map(t.balanced_train, path, "train_id", F.regexp_replace(F.to_json(F.array("blv_description")), r"^\[|\]$", ""))
    return io.json_map(t.spark, path, "string")


@query("SELECT kind AS split, name_id, name_part FROM name_list")
def o_src_3(t: Tables) -> DataFrame:
    path = step_path(t.spark, "splits")
    whole = t.name_list.groupBy("kind").agg(F.to_json(F.collect_list(F.struct("name_id", "name_part"))).alias("rows"))  # a fixed list
    io.write_json_map(whole.coalesce(1), path, "kind", F.col("rows"))
    return io.json_splits(t.spark, path, "name_id long, name_part string", ("given", "family"))


@query("SELECT id, category, description FROM scene_library")
def o_src_4(t: Tables) -> DataFrame:
    path = step_path(t.spark, "member")
    whole = t.scene_library.agg(F.to_json(F.collect_list(F.struct("id", "category", "description"))).alias("rows")).withColumn("name", F.lit("data"))  # 25 rows, fixed
    io.write_json_map(whole, path, "name", F.col("rows"))
    return io.json_member(t.spark, path, "data", "id int, category string, description string")


@query("SELECT row_id, video_id, caption FROM ten_video_eval UNION ALL SELECT row_id + 1000000000, video_id, caption FROM ten_video_eval")
def o_src_5_snk_5(t: Tables) -> DataFrame:
    path = step_path(t.spark, "lines")
    rows = t.ten_video_eval.select("row_id", "video_id", "caption")
    io.append_jsonl(rows, path)
    io.append_jsonl(rows.withColumn("row_id", F.col("row_id") + 1_000_000_000), path)
    return io.jsonl(t.spark, path, "row_id long, video_id string, caption string")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def o_src_6(t: Tables) -> DataFrame:
    path = step_path(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.csv(path, header=True)
    kinds = dict(t.customer.dtypes)
    return io.csv(t.spark, path, ", ".join(f"{c} {kinds[c]}" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal")))


@query("SELECT dataset, count(*) AS n, count(DISTINCT video_id) AS videos, sum(n_frames)::bigint AS frames FROM ten_video_eval GROUP BY dataset")
def o_src_8(t: Tables) -> DataFrame:
    """Metadata that is drained whole is a batch: columns of the records, without their captions."""
    return io.parquet(t.spark, f"{t.folder}/ten_video_eval.parquet").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video_id").alias("videos"), F.sum("n_frames").alias("frames"))


@query("SELECT n_name AS key, 2::bigint AS files FROM nation")
def o_src_11_12(t: Tables) -> DataFrame:
    """Files by the part of their names before the marker, only those with given endings."""
    import pyarrow.fs as pafs

    fs, folder = pafs.FileSystem.from_uri(step_path(t.spark, "frames"))
    fs.create_dir(f"{folder}/deep", recursive=True)
    for row in t.nation.collect():  # 25 rows, fixed
        for name in (f"{row['n_name']}_kf00.jpg", f"deep/{row['n_name']}_kf01.PNG", f"{row['n_name']}_kf02.txt"):
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(b"1")
    return io.files(t.spark, f"{folder}", endings=(".jpg", ".png")).select("key", F.size("paths").cast("bigint").alias("files"))


@query("SELECT row_number() OVER (ORDER BY n_name DESC) - 1 AS pos, n_name AS id FROM nation")
def o_src_14(t: Tables) -> DataFrame:
    path = step_path(t.spark, "ids")
    t.nation.coalesce(1).sortWithinPartitions(F.desc("n_name")).select("n_name").write.text(path)  # 25 rows, fixed
    return io.id_list(t.spark, path).select(F.col("pos").cast("bigint").alias("pos"), "id")


_LISTED = "SELECT DISTINCT unnest(keyframe_paths) AS path FROM all_captions WHERE lower(dataset) = 'charades' AND caption_id % 2 = 0"


@query(f"WITH l AS ({_LISTED}), e AS (SELECT caption_id, unnest(keyframe_paths) AS path, generate_subscripts(keyframe_paths, 1) AS pos FROM all_captions), h AS (SELECT caption_id, count(*) AS n, list(e.path ORDER BY pos) AS held FROM e JOIN l ON e.path = l.path GROUP BY 1) SELECT caption_id, coalesce(n, 0) AS held, held[1] AS head, coalesce(n, 0) = coalesce(len(keyframe_paths), 0) AS all_exist, coalesce(n, 0) > 0 AS any_exists FROM (SELECT c.caption_id, keyframe_paths, n, h.held FROM all_captions c LEFT JOIN h USING (caption_id))")
def o_flt_7_8(t: Tables) -> DataFrame:
    """Frames that a listing holds: all of them, any, and the list cut down to them."""
    listed = t.all_captions.where("lower(dataset) = 'charades' and caption_id % 2 = 0").select(F.explode("keyframe_paths").alias("path"))
    out = io.existing(t.all_captions.select("caption_id", "keyframe_paths"), "keyframe_paths", listed)
    return out.select("caption_id", F.size("keyframe_paths").cast("bigint").alias("held"), F.try_element_at("keyframe_paths", F.lit(1)).alias("head"), "all_exist", "any_exists")


@query("SELECT eval_id, CASE WHEN lower(trim(video_id)) IN (SELECT lower(video_id) FROM balanced_train) THEN lower(trim(video_id)) WHEN video_id || '.mp4' IN (SELECT video_id FROM ten_video_eval) THEN video_id || '.mp4' WHEN upper(video_id) IN (SELECT video_id FROM ten_video_eval) THEN upper(video_id) END AS found FROM balanced_eval")
def o_src_17(t: Tables) -> DataFrame:
    """The first of three places at which something stands."""
    low = t.balanced_train.select(F.lower("video_id").alias("path")).where("path is not null")
    tens = t.ten_video_eval.select(F.concat(F.lit("ten:"), "video_id").alias("path")).where("path is not null")
    out = io.first_existing(t.balanced_eval.select("eval_id", "video_id"), [F.lower(F.trim("video_id")), F.concat(F.lit("ten:"), "video_id", F.lit(".mp4")), F.concat(F.lit("ten:"), F.upper("video_id"))], low.unionByName(tens))
    return out.select("eval_id", F.regexp_replace("found", "^ten:", "").alias("found"))


@query(f"SELECT caption_id, CASE WHEN coalesce(len(regexp_extract_all(blv_description, '[^\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+')), 0) BETWEEN 15 AND 300 THEN 'true' ELSE 'false' END AS is_clean FROM all_captions")
def o_snk_2(t: Tables) -> DataFrame:
    """One pass that routes clean rows and flagged ones apart."""
    path = step_path(t.spark, "routed")
    io.write_routed(t.all_captions.select("caption_id", F.array_compact(F.array(R.length_flag("blv_description"))).alias("flags")), path)
    return t.spark.read.parquet(path).select("caption_id", F.col("is_clean").cast("string").alias("is_clean"))


@query("SELECT eval_id, split FROM balanced_eval")
def o_snk_3(t: Tables) -> DataFrame:
    path = step_path(t.spark, "by-split")
    io.write_splits(t.balanced_eval.select("eval_id", "split"), path)
    return t.spark.read.parquet(path).select("eval_id", "split")


@query("SELECT s_suppkey, s_name FROM supplier")
def o_snk_4(t: Tables) -> DataFrame:
    """A run that keeps what is done every so many rows; a second run adds nothing."""
    path = step_path(t.spark, "blocks")
    todo, n = S.ranked(t.supplier.select("s_suppkey", "s_name"), "s_suppkey")
    for _ in range(2):
        done = I.in_blocks(todo, path, "s_suppkey", lambda d: d, "pos", n, max(1, n // 3))
    return done.select("s_suppkey", "s_name")


@query("SELECT vec_id, len(embedding)::int AS dims, round(embedding[1]::double, 6) AS first, round(list_sum(embedding::double[]), 6) AS total, (SELECT count(*) FROM embeddings) AS rows FROM embeddings")
def o_snk_6_arr_7(t: Tables) -> DataFrame:
    """A table that replaces another one and is counted; vectors go as 32-bit floats in bytes and come back."""
    path = step_path(t.spark, "library")
    io.replace_table(t.spark.range(3), path)
    rows = io.replace_table(t.embeddings.select("vec_id", to_blob("embedding").alias("blob")), path)
    back = t.spark.read.parquet(path).select("vec_id", from_blob("blob").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", F.size("v").alias("dims"), F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(total, 6).alias("total"), F.lit(rows).cast("bigint").alias("rows"))


@query("SELECT 'a' AS model, 9::bigint AS n, 'kept' AS note UNION ALL SELECT run_file, count(*), 'new' FROM ten_video_eval GROUP BY 1 UNION ALL SELECT DISTINCT run_file || ' (old)', 1::bigint, 'kept' FROM ten_video_eval")
def o_snk_7(t: Tables) -> DataFrame:
    """Upsert: rows of old keys are replaced, others are kept with what they hold."""
    new = t.ten_video_eval.groupBy(F.col("run_file").alias("model")).agg(F.count(F.lit(1)).alias("n")).withColumn("note", F.lit("new"))
    kept = new.select(F.concat("model", F.lit(" (old)")).alias("model"), F.lit(1).cast("bigint").alias("n"), F.lit("kept").alias("note"))
    old = new.select("model", F.lit(7).cast("bigint").alias("n"), F.lit("stale").alias("note")).unionByName(kept).unionByName(t.spark.range(1).select(F.lit("a").alias("model"), F.lit(9).cast("bigint").alias("n"), F.lit("kept").alias("note")))
    return S.upsert(old, new, "model")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def o_str_2(t: Tables) -> DataFrame:
    """A stage that is made once: the second call reads what the first wrote, though its maker would fail."""
    path = step_path(t.spark, "memo")
    I.memoised(t.spark, path, lambda: t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))

    def never() -> DataFrame:
        raise RuntimeError("made twice")

    return I.memoised(t.spark, path, never)
