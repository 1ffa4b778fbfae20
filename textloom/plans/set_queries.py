"""Queries of joins, sets, samples, splits, top-k, retrieval and nested pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.rubrics import VALID_SPATIAL
from textloom.functions.vectors import py_round, top_k
from textloom.operators import pairs as P
from textloom.operators import sets as S
from textloom.plans.registry import Tables, query

_VID = "upper(trim(video_id))"


def _vid(df: DataFrame) -> DataFrame:
    return df.withColumn("video", F.upper(F.trim("video_id")))


@query(f"SELECT caption_id FROM all_captions c WHERE NOT EXISTS (SELECT 1 FROM balanced_train t WHERE upper(trim(t.video_id)) = upper(trim(c.video_id)))")
def o_jn_1(t: Tables) -> DataFrame:
    return S.anti(_vid(t.all_captions), _vid(t.balanced_train), "video").select("caption_id")


@query("SELECT e.eval_id, min(c.caption_id) AS caption_id FROM balanced_eval e JOIN all_captions c ON upper(trim(e.video_id)) = upper(trim(c.video_id)) WHERE e.blv_description <> '' AND c.blv_description <> '' AND NOT starts_with(c.blv_description, '[') GROUP BY e.eval_id")
def o_jn_3(t: Tables) -> DataFrame:
    c = _vid(t.all_captions).where("blv_description <> '' and not startswith(blv_description, '[')").select("video", "caption_id")
    return _vid(t.balanced_eval).where("blv_description <> ''").join(c, "video").groupBy("eval_id").agg(F.min("caption_id").alias("caption_id"))


@query("SELECT o.output_id, coalesce(m.score, 0.0) AS score FROM sft_patch_v2_outputs o LEFT JOIN (SELECT video_id, max(mcf) AS score FROM sft_patch_v2_judge_scores GROUP BY 1) m USING (video_id)")
def o_jn_4(t: Tables) -> DataFrame:
    scores = t.sft_patch_v2_judge_scores.groupBy("video_id").agg(F.max("mcf").alias("score"))
    return S.lookup(t.sft_patch_v2_outputs, scores, "video_id", "score", 0.0).select("output_id", "score")


@query("SELECT output_id FROM sft_patch_v2_outputs WHERE video_id IN (SELECT video_id FROM balanced_eval WHERE video_id IS NOT NULL)")
def o_jn_5(t: Tables) -> DataFrame:
    return S.semi(t.sft_patch_v2_outputs, t.balanced_eval, "video_id").select("output_id")


@query("SELECT pos, e.video_id, eval_id FROM (SELECT video_id, row_number() OVER (ORDER BY video_id) - 1 AS pos FROM (SELECT DISTINCT video_id FROM ten_video_eval)) i JOIN balanced_eval e USING (video_id)")
def o_jn_6(t: Tables) -> DataFrame:
    ids, _ = S.ranked(t.ten_video_eval.select("video_id").distinct(), "video_id")
    return S.in_order_of(t.balanced_eval.select("video_id", "eval_id"), ids, "video_id", "pos").select("pos", "video_id", "eval_id")


_CONDITIONS = ["base", "sft_v2", "grpo", "sft_patch_v2"]


@query("SELECT video_id, " + ", ".join(f"min(generated) FILTER (condition = '{c}') AS {c}" for c in _CONDITIONS) + " FROM sft_patch_v2_outputs GROUP BY video_id")
def o_jn_7(t: Tables) -> DataFrame:
    return S.side_by_side(t.sft_patch_v2_outputs, "video_id", "condition", "generated", _CONDITIONS)


@query("""WITH lib AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings WHERE label IS NOT NULL GROUP BY label),
s AS (SELECT v.vec_id, lib.label, list_inner_product(v.embedding::double[], lib.e::double[]) AS score FROM embeddings v, lib)
SELECT vec_id, label, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s) WHERE rank <= 3""")
def o_jn_8_top_2(t: Tables) -> DataFrame:
    library = S.first_of(t.embeddings.where("label is not null"), "label", "vec_id").select("label", "embedding")
    return top_k(t.embeddings, library, "vec_id", "label", 3).withColumn("score", F.round("score", 6))


@query("SELECT * EXCLUDE rank FROM (SELECT a.id AS scene, b.id AS nearest, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) AS score, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.embedding::double[], b.embedding::double[]) DESC, b.id) AS rank FROM scene_library a, scene_library b) WHERE rank = 1")
def o_top_3(t: Tables) -> DataFrame:
    lib = t.scene_library
    found = top_k(lib.withColumnRenamed("id", "scene"), lib.withColumnRenamed("id", "nearest"), "scene", "nearest", 1)
    return found.select("scene", "nearest", F.round("score", 6).alias("score"))


@query("SELECT rec_id, mcf FROM sft_patch_v2_judge_scores ORDER BY mcf DESC NULLS LAST, rec_id LIMIT 300")
def o_top_1(t: Tables) -> DataFrame:
    return S.top(t.sft_patch_v2_judge_scores, 300, F.desc_nulls_last("mcf"), "rec_id").select("rec_id", "mcf")


@query("SELECT caption_id FROM (SELECT caption_id, video_id, row_number() OVER (ORDER BY caption_id) - 1 AS pos FROM all_captions) c WHERE pos < 1000 AND NOT EXISTS (SELECT 1 FROM balanced_train t WHERE t.video_id = c.video_id)")
def o_lim_1(t: Tables) -> DataFrame:
    placed, _ = S.ranked(t.all_captions.select("caption_id", "video_id"), "caption_id")
    return S.anti(placed.where("pos < 1000"), t.balanced_train, "video_id").select("caption_id")


@query("SELECT caption_id FROM all_captions WHERE length(blv_description) > 100 ORDER BY caption_id LIMIT 50")
def o_lim_2(t: Tables) -> DataFrame:
    return S.top(t.all_captions.where(F.length("blv_description") > 100), 50, "caption_id").select("caption_id")


@query("SELECT output_id FROM (SELECT output_id, row_number() OVER (ORDER BY output_id) - 1 AS pos FROM sft_patch_v2_outputs) WHERE pos >= 500")
def o_lim_3(t: Tables) -> DataFrame:
    return S.ranked(t.sft_patch_v2_outputs.select("output_id"), "output_id")[0].where("pos >= 500").select("output_id")


@query("SELECT eval_id FROM (SELECT eval_id, row_number() OVER (ORDER BY md5(eval_id::varchar || ':42'), eval_id) AS n FROM balanced_eval) WHERE n <= 100")
def o_smp_1_2(t: Tables) -> DataFrame:
    return S.top(t.balanced_eval, 100, S.shuffled("eval_id", 42), "eval_id").select("eval_id")


@query("""WITH k AS (SELECT count(*) FILTER (dataset = 'charades') AS ch, count(*) FILTER (dataset = 'avcaps') AS av FROM (SELECT lower(dataset) AS dataset FROM balanced_eval)),
q AS (SELECT 'charades' AS dataset, least(CAST(round(5 * 70 / 7.0) AS BIGINT), ch) AS quota FROM k UNION ALL SELECT 'avcaps', least(70 - least(CAST(round(5 * 70 / 7.0) AS BIGINT), ch), av) FROM k)
SELECT eval_id, dataset FROM (SELECT eval_id, lower(e.dataset) AS dataset, quota, row_number() OVER (PARTITION BY lower(e.dataset) ORDER BY md5(eval_id::varchar || ':7'), eval_id) AS n FROM balanced_eval e JOIN q ON lower(e.dataset) = q.dataset) WHERE n <= quota""")
def o_smp_3_4(t: Tables) -> DataFrame:
    rows = t.balanced_eval.select("eval_id", F.lower("dataset").alias("dataset"))
    sizes = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.agg(F.max(F.when(F.col("dataset") == "charades", F.col("n"))).alias("ch"), F.max(F.when(F.col("dataset") == "avcaps", F.col("n"))).alias("av"))
    n_ch = F.least(F.lit(50), F.coalesce("ch", F.lit(0)))
    quotas = counts.select(F.explode(F.create_map(F.lit("charades"), n_ch, F.lit("avcaps"), F.least(70 - n_ch, F.coalesce("av", F.lit(0))))).alias("dataset", "quota"))
    return S.quota_sample(rows.join(F.broadcast(quotas), "dataset"), "dataset", "eval_id", F.col("quota"), 7).select("eval_id", "dataset")


@query("SELECT train_id FROM (SELECT train_id, row_number() OVER (ORDER BY md5(train_id::varchar || ':3'), train_id) AS n, count(*) OVER () AS total FROM balanced_train) WHERE n <= floor(0.15 * total)")
def o_smp_5(t: Tables) -> DataFrame:
    return S.split_by_share(t.balanced_train.select("train_id"), "train_id", 0.15, 3).where("split = 'train'").select("train_id")


@query("SELECT train_id, scene FROM (SELECT train_id, scene, row_number() OVER (PARTITION BY scene ORDER BY md5(train_id::varchar || ':1'), train_id) AS n FROM balanced_train) WHERE n <= 20")
def o_smp_6(t: Tables) -> DataFrame:
    return S.quota_sample(t.balanced_train.select("train_id", "scene"), "scene", "train_id", 20, 1)


@query("SELECT train_id, CASE WHEN pos < floor(0.9 * total) THEN 'train' ELSE 'val' END AS split FROM (SELECT train_id, row_number() OVER (ORDER BY md5(train_id::varchar || ':42'), train_id) - 1 AS pos, count(*) OVER () AS total FROM balanced_train)")
def o_spl_1(t: Tables) -> DataFrame:
    return S.split_by_share(t.balanced_train.select("train_id"), "train_id", 0.9, 42)


@query("SELECT train_id, CASE WHEN pos < floor(0.9 * total) THEN 'train' ELSE 'val' END AS split FROM (SELECT train_id, row_number() OVER (ORDER BY train_id) - 1 AS pos, count(*) OVER () AS total FROM balanced_train)")
def o_spl_2(t: Tables) -> DataFrame:
    return S.split_by_share(t.balanced_train.select("train_id"), "train_id", 0.9)


@query("SELECT train_id, CASE WHEN pos < 500 THEN 'val' ELSE 'train' END AS split FROM (SELECT train_id, row_number() OVER (ORDER BY md5(train_id::varchar || ':5'), train_id) - 1 AS pos FROM balanced_train)")
def o_spl_3(t: Tables) -> DataFrame:
    placed, _ = S.ranked(t.balanced_train.select("train_id"), "train_id", S.shuffled("train_id", 5))
    return placed.select("train_id", F.when(F.col("pos") < 500, "val").otherwise("train").alias("split"))


@query("SELECT rec_id, CASE WHEN pos >= n - greatest(0, least(greatest(500, n // 6), n - 100)) THEN 'eval' ELSE 'train' END AS split FROM (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS pos, count(*) OVER () AS n FROM sft_patch_v2_judge_scores)")
def o_spl_4(t: Tables) -> DataFrame:
    placed, n = S.ranked(t.sft_patch_v2_judge_scores.select("rec_id"), "rec_id")
    return placed.select("rec_id", F.when(F.col("pos") >= n - S.tail_size(n), "eval").otherwise("train").alias("split"))


@query("SELECT rec_id FROM (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS pos FROM sft_patch_v2_judge_scores) WHERE pos NOT IN (0, 99, 249, 399, 499)")
def o_spl_5(t: Tables) -> DataFrame:
    return S.ranked(t.sft_patch_v2_judge_scores.select("rec_id"), "rec_id")[0].where("pos not in (0, 99, 249, 399, 499)").select("rec_id")


@query("WITH s AS (SELECT output_id, row_number() OVER (ORDER BY md5(output_id::varchar || ':42'), output_id) - 1 AS pos FROM sft_patch_v2_outputs ORDER BY pos LIMIT 600) SELECT output_id, CASE WHEN pos < 30 THEN 'test' ELSE 'train' END AS split FROM s")
def o_spl_6(t: Tables) -> DataFrame:
    chosen = S.top(t.sft_patch_v2_outputs.select("output_id"), 600, S.shuffled("output_id", 42), "output_id")
    placed, n = S.ranked(chosen, "output_id", S.shuffled("output_id", 42))
    return placed.select("output_id", F.when(F.col("pos") < int(0.05 * n), "test").otherwise("train").alias("split"))


@query("SELECT video_id, min(caption_id) AS first_id, max(caption_id) AS last_id FROM all_captions GROUP BY video_id")
def o_ded_1_2(t: Tables) -> DataFrame:
    rows = t.all_captions.select("video_id", "caption_id")
    first, last = S.first_of(rows, "video_id", "caption_id"), S.first_of(rows, "video_id", F.desc("caption_id"))
    both = first.withColumnRenamed("caption_id", "first_id").alias("a").join(last.withColumnRenamed("caption_id", "last_id").alias("b"), F.expr("a.video_id <=> b.video_id"))
    return both.select("a.video_id", "first_id", "last_id")


@query("SELECT train_id AS id, video_id, 'train' AS split, NULL::varchar AS origin FROM balanced_train UNION ALL SELECT eval_id, video_id, split, 'held out' FROM balanced_eval")
def o_set_1(t: Tables) -> DataFrame:
    a = t.balanced_train.select(F.col("train_id").alias("id"), "video_id", F.lit("train").alias("split"))
    b = t.balanced_eval.select(F.col("eval_id").alias("id"), "video_id", "split", F.lit("held out").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT video_id FROM all_captions EXCEPT SELECT video_id FROM balanced_train")
def o_set_2(t: Tables) -> DataFrame:
    return t.all_captions.select("video_id").subtract(t.balanced_train.select("video_id"))


@query("SELECT video_id FROM balanced_train UNION SELECT video_id FROM balanced_eval")
def o_set_3(t: Tables) -> DataFrame:
    return t.balanced_train.select("video_id").union(t.balanced_eval.select("video_id")).distinct()


@query("SELECT caption_id FROM all_captions c WHERE NOT EXISTS (SELECT 1 FROM (SELECT video_id FROM balanced_train UNION SELECT video_id FROM balanced_eval UNION SELECT video_id FROM ten_video_eval) u WHERE u.video_id = c.video_id)")
def o_set_4(t: Tables) -> DataFrame:
    used = o_set_3(t).union(t.ten_video_eval.select("video_id"))
    return S.anti(t.all_captions.select("caption_id", "video_id"), used, "video_id").select("caption_id")


@query("SELECT 'a' AS model, 9 AS n UNION ALL SELECT run_file, count(*) FROM ten_video_eval GROUP BY 1")
def o_snk_7_8(t: Tables) -> DataFrame:
    new = t.ten_video_eval.groupBy(F.col("run_file").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    old = new.select("model", F.lit(0).cast("bigint").alias("n")).unionByName(t.spark.range(1).select(F.lit("a").alias("model"), F.lit(9).cast("bigint").alias("n")))
    return S.upsert(old, new, "model")


_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_S = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_VALID = f"length({_S('blv_description')}) >= 30 AND (" + " OR ".join(f"contains(lower(blv_description), '{w}')" for w in VALID_SPATIAL) + ")"
_RAW = _S("coalesce(original_caption, '')")
_PAIRS = f"""SELECT caption_id AS pair_id, {_S('blv_description')} AS chosen, CASE WHEN length({_RAW}) >= 3 AND NOT (starts_with({_RAW}, 'c0') AND length({_RAW}) < 10) THEN {_RAW} ELSE 'A scene.' END AS rejected,
coalesce(len(keyframe_paths), 0) + 1 AS parts, 'Describe the scene.' || CASE WHEN coalesce(rag_context, '') <> '' THEN chr(10) || 'Context: ' || rag_context ELSE '' END AS asked, rag_context FROM all_captions WHERE {_VALID}"""
_END = "'<end_of_utterance>' || chr(10)"
_TURN = f"length({_S('rag_context')}) > 10"


@query(f"SELECT pair_id, chosen, rejected, parts::int AS parts, asked, keyframe FROM (SELECT p.*, c.keyframe_paths[1] AS keyframe FROM ({_PAIRS}) p JOIN all_captions c ON c.caption_id = p.pair_id)")
def o_arr_5_flt_5(t: Tables) -> DataFrame:
    """The pairs of o_arr_5_pairs, their nested prompts taken apart again."""
    content = F.col("prompt")[0]["content"]
    out = P.preference_pairs(t.all_captions, "Describe the scene.")
    return out.select("pair_id", "chosen", "rejected", F.size(content).alias("parts"), F.element_at(content, -1)["text"].alias("asked"), content[0]["image"].alias("keyframe"))


@query(f"SELECT pair_id::varchar AS pair_id, 1 AS messages, chosen, rejected FROM ({_PAIRS}) UNION ALL SELECT pair_id || '_mt', 3, rag_context, 'A scene.' FROM ({_PAIRS}) WHERE {_TURN}")
def o_arr_6_flat(t: Tables) -> DataFrame:
    return o_arr_6(t).select("pair_id", F.size("prompt").alias("messages"), "chosen", "rejected")


@query(f"SELECT pair_id::varchar AS pair_id, 'User: ' || asked || {_END} AS chat FROM ({_PAIRS}) UNION ALL SELECT pair_id || '_mt', 'User: ' || asked || {_END} || 'Assistant: ' || chosen || {_END} || 'User: What is nearby?' || {_END} FROM ({_PAIRS}) WHERE {_TURN}")
def o_txt_10_13(t: Tables) -> DataFrame:
    """Chat transcripts, with a line of context where there is one."""
    return o_arr_6(t).select("pair_id", P.transcript(F.col("prompt")).alias("chat"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY eval_id) AS i, eval_id, blv_description AS reference FROM balanced_eval), b AS (SELECT row_number() OVER (ORDER BY row_id DESC) AS i, row_id, caption AS hypothesis FROM ten_video_eval)
SELECT eval_id, row_id, reference, hypothesis FROM a JOIN b USING (i)""")
def o_jn_10(t: Tables) -> DataFrame:
    """Two lists zipped by position: positions come from ranges, so neither list goes to one task."""
    a, _ = S.ranked(t.balanced_eval.select("eval_id", F.col("blv_description").alias("reference")), "eval_id")
    b, _ = S.ranked(t.ten_video_eval.select("row_id", F.col("caption").alias("hypothesis")), "row_id", F.desc("row_id"))
    return a.join(b, "pos").select("eval_id", "row_id", "reference", "hypothesis")


@query()
def o_arr_5_pairs(t: Tables) -> DataFrame:
    return P.preference_pairs(t.all_captions, "Describe the scene.")


@query()
def o_arr_6(t: Tables) -> DataFrame:
    pairs = P.preference_pairs(t.all_captions, "Describe the scene.")
    turns = t.all_captions.where("rag_context is not null").select(F.col("caption_id").alias("pair_id"), F.lit("What is nearby?").alias("question"), F.col("rag_context").alias("answer"))
    return P.with_turns(pairs, turns)


_TOKENS = lambda c: f"len(regexp_split_to_array(coalesce({c}, ''), '[ \\t\\n\\x0B\\f\\r]+'))"


@query(f"""WITH r AS (SELECT output_id, output_id // 8 AS batch, {_TOKENS('reference')} AS p, least({_TOKENS('generated')}, 40) AS g FROM sft_patch_v2_outputs),
f AS (SELECT *, least(p + g, 96) AS n FROM r WHERE p < 96) SELECT output_id, (max(n) OVER (PARTITION BY batch))::int AS width, n::int AS used, (n - p)::int AS learned FROM f""")
def o_arr_9_10(t: Tables) -> DataFrame:
    ids = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: F.pmod(F.crc32(w), F.lit(50_000)).cast("int"))
    rows = t.sft_patch_v2_outputs.select("output_id", ids(F.col("reference")).alias("prompt"), ids(F.col("generated")).alias("response"), F.floor(F.col("output_id") / 8).alias("batch"))
    out = P.training_rows(rows, "prompt", "response", "batch", 96, 40)
    return out.select("output_id", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"), F.size(F.filter("labels", lambda x: x != -100)).alias("learned"))


@query("SELECT event_id, round(value / 3, 2) AS third FROM events WHERE value IS NOT NULL")
def o_mth_2(t: Tables) -> DataFrame:
    return t.events.where("value is not null").select("event_id", py_round(F.col("value") / 3, 2).alias("third"))
