"""Text functions, rubrics and metrics against Python and recorded values."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from textloom.functions import metrics as M
from textloom.functions import rubrics as R
from textloom.functions import text as T
from textloom.plans.reference_queries import QUERIES

EDGE = ["", " ", "\n a \n", "a b", "Été, no_1!", "at 1.5 meters. Then stop.", None, "x" * 5000, "  two  words ", "[ERROR: x]"]


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_strip_and_tokens(spark):
    assert values(spark, EDGE, T.py_strip("t")) == [None if t is None else t.strip() for t in EDGE]
    assert values(spark, EDGE, T.py_tokens("t")) == [None if t is None else t.split() for t in EDGE]
    assert values(spark, EDGE, T.word_count("t")) == [0 if t is None else len(t.split()) for t in EDGE]


def test_sentences_tags_and_fences(spark):
    assert values(spark, ["at 1.5 meters. Go!"], T.sentences("t")) == [["at 1", "5 meters", "Go!"]]
    assert values(spark, ["a. b! c?"], T.regex_sentences("t")) == [["a", "b", "c"]]
    tagged = "<reasoning>because\nof it</reasoning> rest"
    assert values(spark, [tagged, "none"], T.tagged("t", "reasoning")) == ["because\nof it", ""]
    assert values(spark, ["x ```json\n{\"a\": 1}\n``` y", "{}"], T.unfenced("t")) == ['{"a": 1}', "{}"]
    assert values(spark, ["say {a} and {b}", "no"], T.first_object("t")) == ["{a}", None]
    assert values(spark, ["say {a {b} c} end"], T.outer_object("t")) == ["{a {b} c}"]
    assert values(spark, ["User: a\nAssistant: b ", "plain"], T.after_last("t", "Assistant:")) == ["b", "plain"]


def test_ngrams_of_short_arrays(spark):
    assert values(spark, ["a b c", "a", ""], T.ngrams(T.py_tokens("t"), 2)) == [["a b", "b c"], [], []]


def test_presence_and_scores(spark):
    assert values(spark, ["To your LEFT", "nothing", None], T.has_any("t", R.SPATIAL)) == [1.0, 0.0, 0.0]
    text = "A kitchen. A chair is near, 2 meters ahead. Careful: a wet floor."
    assert values(spark, [text], R.curation_score_1("t")) == [20 + 10 + 20 + 20 + 20]
    assert values(spark, ["a " * 14, "a " * 15, "a " * 300, "a " * 301], R.length_flag("t")) == [R.TOO_SHORT, None, None, R.TOO_LONG]
    assert values(spark, ["c001 c04", "ok", None, "a cup"], R.valid_rejected("t")) == [False, False, False, True]


def test_flags_keep_their_order(spark):
    got = values(spark, ["It was seemingly nice."], R.flags("t", F.lit(10), repeated=F.lit(True)))
    assert got == [[R.TOO_SHORT, "Low BLV score: 10", "Hallucination phrases: seemingly", R.REPEATED, R.GUIDELINES[0][1]]]


def test_reward_bands(spark):
    row = spark.createDataFrame([("CAUTION: step ahead in the kitchen. Left 2 meters. Right.", "CAUTION a step"), (None, "CAUTION")], "g string, r string")
    got = [round(r[0], 2) for r in row.select(R.reward("g", "r")).collect()]
    assert got == [round(0.40 + 0.24 + 0.20 + 0.16 + 0.10, 2), -0.30]


def test_edit_metrics(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choices("abcde", k=rng.randint(0, 9))), " ".join(rng.choices("abcde", k=rng.randint(0, 9)))) for _ in range(60)]
    pairs += [("", "a"), ("a", ""), ("é", "e")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    df = spark.createDataFrame(pairs, "r string, h string")
    tok = [T.py_tokens("r"), T.py_tokens("h")]
    got = df.select("r", "h", M.wer("r", "h").alias("wer"), M.lcs_length(*tok).alias("a"), M.lcs_long(*tok).alias("b")).collect()
    for x in got:
        r, h = x["r"].split(), x["h"].split()
        assert abs(x["wer"] - (distance(r, h) / len(r) if r else 1.0)) < 1e-9
        assert x["a"] == x["b"] == common(r, h)


def test_answers(spark):
    df = spark.createDataFrame([("Stop", ["stop", "STOP!", "go"]), ("x", ["x"] * 4), ("q", ["a"])], "p string, t array<string>")
    assert [round(r[0], 6) for r in df.select(M.vqa_accuracy("p", "t")).collect()] == [0.666667, 1.0, 0.0]
    df = spark.createDataFrame([("", ""), ("a", ""), ("abcd", "abxy"), ("abc", "xyz")], "p string, t string")
    assert [r[0] for r in df.select(M.anls("p", "t")).collect()] == [1.0, 0.0, 0.5, 0.0]


def test_answers_of_a_group(spark, tmp_path):
    """The truths of a group are never put into one value, which each of its rows would have to look through."""
    rows = [
        (1, "v", "stop", "Stop!"), (2, "v", "STOP", "go"), (3, "v", "stop.", " STOP "), (4, "v", "stop", None), (5, "v", "Go", "none"), (6, "v", None, ""),
        (7, "w", None, "stop"), (8, None, "stop", "stop"), (9, "e", "", "?!"), (10, "e", "...", "x"), (11, "e", "  ", ""), (12, "e", "-", ""), (13, "o", "stop", "stop"),
    ]
    spark.createDataFrame(rows, "output_id long, video_id string, reference string, generated string").write.parquet(str(tmp_path / "sft_patch_v2_outputs.parquet"))
    found = QUERIES["o_met_8"](spark, str(tmp_path))
    assert {r["output_id"]: r["accuracy"] for r in found.collect()} == {1: 1.0, 2: 0.333333, 3: 1.0, 5: 0.0, 6: 0.0, 7: 0.0, 9: 1.0, 10: 0.0, 11: 1.0, 12: 1.0, 13: 0.333333}
    assert found.count() == 11 and found.dtypes == [("output_id", "bigint"), ("accuracy", "double")]
    assert "collect_set" not in found._jdf.queryExecution().toString()


def test_bleu_from_recorded_counts(spark):
    runs = [((13463, 1160, 147, 13), (109997, 108068, 106139, 104210), 106497, 12.24, 0.39), ((17549, 2638, 558, 90), (76500, 74571, 72642, 70713), 106497, 15.5, 1.13), ((13477, 1189, 153, 21), (112049, 110120, 108191, 106262), 106497, 12.03, 0.44)]
    rows = [(str(k), n + 1, c[n], g[n], ref) for k, (c, g, ref, _, _) in enumerate(runs) for n in range(4)]
    got = M.bleu(spark.createDataFrame(rows, "k string, n int, correct long, guess long, reference long"), ("k",)).orderBy("k").collect()
    assert [(round(r["bleu1"], 2), round(r["bleu4"], 2)) for r in got] == [(a, b) for *_, a, b in runs]


def test_repetition_is_the_ratio(spark):
    parts = [["A chair stands near the door", "A chair stands near the doors"], ["one thing here", "quite another matter"], [], None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in parts], "p array<string>").select(M.repeats_itself("p")).collect()]
    assert got == [SequenceMatcher(None, *parts[0]).ratio() > 0.75, False, False, None]


def test_templates_padding_and_first_elements(spark):
    df = spark.createDataFrame([(7, "x", '["a", "b"]'), (123, None, "plain"), (None, "z", "[]")], "n int, t string, j string")
    got = df.select(T.template("<{n}|{t}>", n="n", t="t").alias("a"), T.zero_padded("n", 2).alias("b"), T.first_or_scalar("j").alias("c")).collect()
    assert [r["a"] for r in got] == ["<7|x>", "<123|>", "<|z>"]
    assert [r["b"] for r in got][:2] == ["07", "123"] and [r["c"] for r in got] == ["a", "plain", None]


def test_rounding_blobs_and_search_in_blocks(spark, monkeypatch):
    from textloom.functions import vectors as V

    halves = [0.125, 2.675, 0.5, 1.5, None, -0.125]
    df = spark.createDataFrame([(x,) for x in halves], "x double")
    assert [r[0] for r in df.select(V.py_round("x", 2)).collect()] == [None if x is None else round(x, 2) for x in halves]
    vectors = spark.createDataFrame([(i, [float(i), 1.5, -2.0]) for i in range(7)] + [(9, None)], "k int, v array<float>")
    back = vectors.select("k", "v", V.from_blob(V.to_blob("v")).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in back)
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "q int, embedding array<float>")
    library = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(11)], "l int, embedding array<float>")
    whole = sorted(map(tuple, V.top_k(queries, library, "q", "l", 3).select("q", "l", "rank").collect()))
    monkeypatch.setattr(V, "LIBRARY_ROWS", 4)
    assert whole == sorted(map(tuple, V.top_k(queries, library, "q", "l", 3).select("q", "l", "rank").collect())) and len(whole) == 12


def test_repeats_and_bleu_variants(spark):
    from difflib import SequenceMatcher
    from itertools import combinations
    from random import Random

    rng = Random(3)
    words = ["lamp", "door", "near the", "table", "stairs", "red", "a man walks", "by", "old"]
    rows = []
    for _ in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(2, 9))) for _ in range(rng.randint(0, 5))]
        if parts and rng.random() < 0.4:
            parts.append(parts[0][: -rng.randint(1, 6)] + "xy")
        rows.append(parts)
    rows += [["é" * 300, "é" * 300], ["ab" * 150, "ab" * 150], []]
    want = [any(SequenceMatcher(None, a, b).ratio() > 0.75 for a, b in combinations(x, 2)) for x in rows]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)] + [(999, None)], "i int, x array<string>")
    got = {r["i"]: r["r"] for r in df.select("i", M.repeats_itself("x").alias("r")).collect()}
    assert [got[i] for i in range(len(rows))] == want and got[999] is None
    text = spark.createDataFrame([("It costs 1,000.5 (or so)-no, 3-4!", "It costs 1,000.5, or so; no.")], "h string, r string")
    spaced = text.select(M.tokenized_13a("h").alias("t")).first()["t"].split()
    assert spaced == ["It", "costs", "1,000.5", "(", "or", "so", ")", "-no", ",", "3", "-", "4", "!"]
    none = M.bleu(M.ngram_matches(spark.createDataFrame([("a b", "c d"), (None, "x")], "h string, r string"), "h", "r"), smooth="exp").first()
    assert none["bleu1"] > 0 and M.bleu(M.ngram_matches(text.limit(0), "h", "r")).count() <= 1


def test_cider_by_hand(spark):
    from collections import Counter
    from math import exp, log, sqrt

    pairs = [(1, "a man walks past a red lamp", "a man walks by a red lamp"), (2, "the door is shut", "the door is open now"), (3, "", "a lamp")]
    grams = lambda t, n: Counter(tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1))
    df = Counter(g for _, _, r in pairs for n in range(1, 5) for g in grams(r, n))
    df = Counter({g: sum(1 for _, _, r in pairs if g in grams(r, len(g))) for g in df})
    want = {}
    for k, h, r in pairs:
        total = 0.0
        delta = sum(grams(h, 2).values()) - sum(grams(r, 2).values())
        for n in range(1, 5):
            idf = lambda g: log(len(pairs)) - log(max(1, df[g]))
            a, b = ({g: c * idf(g) for g, c in grams(t, n).items()} for t in (h, r))
            na, nb = sqrt(sum(v * v for v in a.values())), sqrt(sum(v * v for v in b.values()))
            total += sum(min(v, b.get(g, 0)) * b.get(g, 0) for g, v in a.items()) / (na * nb) if na and nb else 0.0
        want[k] = 10 * total / 4 * exp(-(delta**2) / 72)
    got = {r["k"]: r["cider"] for r in M.cider(spark.createDataFrame(pairs, "k int, h string, r string"), "k", "h", "r").collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
