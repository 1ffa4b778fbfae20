"""Operators on training text against brute force, exact round trips and small hand-made cases."""

import random
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from textloom.llm import answers, cuts, near_duplicates, personal, shingles
from textloom.llm.cross_split import canonical_video_id, cross_split_overlaps, cross_split_pairs, overlap_report, pairs_across
from textloom.llm.encoding import RANKS, decode_ids, encode_texts
from textloom.llm.leakage import leaked_items
from textloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs

WORDS = [f"w{i}" for i in range(60)]


def sets(text):
    own = shingles.words(text) if text else []
    return {tuple(own[i : i + 3]) for i in range(len(own) - 2)} if len(own) >= 12 else set()


def alike(a, b):
    return bool(a) and bool(b) and 2 * len(a & b) >= len(a | b)


def variants(rng, n):
    """Texts of many sizes, copies and edits of them, and edge cases."""
    texts = []
    for _ in range(n):
        base = rng.choices(WORDS, k=rng.choice([11, 12, 13, 20, 40, 90, 300, 700]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 8))):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [rng.choice(WORDS)], [own[at], "extra"]])
            texts.append((" ".join(own)).upper() if rng.random() < 0.2 else ", ".join(own))
    return [*texts, None, "", "   ", "a " * 400, "a " * 400, "short text", "é" * 3000, "x y " * 9000, texts[0], texts[0]]


def test_near_duplicates_are_exact(spark):
    rng = random.Random(5)
    texts = variants(rng, 90)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], "c"), (0, texts[0], "c")]
    df = spark.createDataFrame(rows, "k long, body string, component string").repartition(3)
    own = [sets(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if alike(own[i], own[j]):
                parent[find(i)] = find(j)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if find(i) == find(j)}
    got = [tuple(r) for r in near_duplicate_pairs(df, "k", "body").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert near_duplicate_pairs(df.limit(0), "k", "body").count() == 0


def test_near_duplicates_of_one_member_of_a_group(spark):
    """Two texts have the same rarest two thirds of runs; only the one that is no head is alike to the third text."""
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    core, one, two = words("core", 62), words("one", 30), words("two", 30)
    rows = [(1, core + one), (2, core + two), (3, words("own", 30) + core[30:] + two)]
    rows += [(10 + i, words(f"x{i}y", 70) + core[-2:] + (one if i % 2 else two)) for i in range(12)]
    rows = [(i, " ".join(w)) for i, w in rows]
    texts = dict(rows)
    assert alike(sets(texts[1]), sets(texts[2])) and alike(sets(texts[2]), sets(texts[3])) and not alike(sets(texts[1]), sets(texts[3]))
    found = near_duplicate_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert {tuple(r) for r in found} == {(1, 2), (1, 3), (2, 3)}


def test_near_duplicates_of_a_hot_key(spark):
    """Blocks of one key that go to tasks of their own give the same groups."""
    rng = random.Random(9)
    base = [rng.choices(WORDS, k=30) for _ in range(6)]
    texts = []
    for _ in range(240):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(30)] = f"x{rng.randrange(60)}"
        texts.append(" ".join(own + rng.choices(WORDS, k=rng.choice([0, 5, 40]))))
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    whole = {tuple(r) for r in near_duplicate_groups(df, "k", "body").collect()}
    assert whole and whole == {tuple(r) for r in near_duplicate_groups(df, "k", "body", most_groups=33).collect()}


def test_near_duplicates_of_keys_split_into_blocks(spark, tmp_path, monkeypatch):
    """Keys of more groups than one task takes, for all texts and for two blocks of several cuts."""
    rng = random.Random(12)
    common = [f"common{i}" for i in range(8)]
    texts = [" ".join(common + [f"own{i // 2}x{j}" for j in range(5)] + [f"last{i}"] * (i % 3)) for i in range(160)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    own = [sets(t) for t in texts]
    links = {(i, j) for i in range(160) for j in range(i + 1, 160) if alike(own[i], own[j])}
    whole = {tuple(r) for r in near_duplicate_groups(df, "k", "body").collect()}
    split = {tuple(r) for r in near_duplicate_groups(df, "k", "body", most_groups=34).collect()}
    component = dict(whole)
    assert links and len(set(component.values())) < 160 and all(component[i] == component[j] for i, j in links)
    assert split == whole

    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    size = np.sort(np.array([rng.choice([1, 3, 12, 40, 95, 96, 200, 10**9]) for _ in range(90)], np.int64))
    bits = np.array([[rng.getrandbits(64) & rng.choice([3, 2**64 - 1]) for _ in range(2)] for _ in range(90)], np.uint64)
    ids = np.arange(90)[::-1].astype(np.int64)
    tiles = near_duplicates._write_blocks(str(tmp_path / "blocks"), iter([(ids, size, bits)]), 40).to_pylist()
    assert len({t["file"] for t in tiles}) == 1 and len(tiles) > 3
    found = set()
    for t in tiles:
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "blocks" / t["file"])) as file:
            one, two = (near_duplicates._read_block(file, t[c]) for c in "ab")
        for x, y in near_duplicates._block_pairs(one, two, t["a"] == t["b"]):
            found |= {(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True) if p[0] != p[1]}
    differ = lambda i, j: sum(int(a ^ b).bit_count() for a, b in zip(bits[i], bits[j], strict=True))
    near = lambda i, j: 3 * differ(i, j) <= size[i] + size[j] and 2 * size[i] >= size[j]
    assert found == {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in range(90) for j in range(i + 1, 90) if near(i, j)}



def test_word_hashes_agree_with_words():
    """Hashes tell apart what words() tells apart, in ASCII and other batches alike, over windows too."""
    texts = [None, "", "A b_c", "İstanbul ΣΑΣ, Straße 12½ ² हिंदी", "x" * 600_000 + " y z", "a b" * 200_000, "🚶 née"]
    one, counts = shingles.word_hashes(texts)
    own = [shingles.words(t or "") for t in texts]
    assert [len(o) for o in own] == counts.tolist()
    seen = dict(zip((w for o in own for w in o), one.tolist(), strict=True))
    assert [seen[w] for o in own for w in o] == one.tolist() and len(set(seen.values())) == len(seen)
    plain = [t for t in texts if t and t.isascii()]
    assert [seen[w] for t in plain for w in shingles.words(t)] == shingles.word_hashes(plain)[0].tolist()


@pytest.mark.parametrize(
    ("raw", "want"),
    [("AB1C2", "AB1C2"), ("ab1c2", "AB1C2"), (" charades/AB1C2.mp4", "AB1C2"), ("AB1C2_kf07", "AB1C2"), ("1234567890.0", "1234567890"), ("1,234,567,890\t", "1234567890"), ("1.23456789E9", "1234567890"), ("avcaps/1234567890", "1234567890"), ("12345", None), ("", None), (None, None), ("ABCDEF", None)],
)
def test_video_ids(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "v string").select(canonical_video_id(F.col("v"))).first()[0] == want


def test_cross_split_is_exact(spark):
    rng = random.Random(7)
    texts = variants(rng, 60)
    rng.shuffle(texts)
    half = len(texts) // 2
    vids = ["AB1C2", "ab1c2", "1234567890.0", "1234567890", None, None, None, "ZZZZZ"]
    evals = [(i, rng.choice(vids), "charades", "val", t) for i, t in enumerate(texts[:half])]
    train = [(1000 + i, rng.choice(vids), t) for i, t in enumerate(texts[half:])]
    e = spark.createDataFrame([*evals, evals[0]], "eval_id long, video_id string, dataset string, split string, blv_description string")
    t = spark.createDataFrame([*train, train[0]], "train_id long, video_id string, blv_description string")
    canon = {"AB1C2": 1, "ab1c2": 1, "1234567890.0": 2, "1234567890": 2, "ZZZZZ": 3}
    want = {(a, b) for a, va, _, _, ta in evals for b, vb, tb in train if (va and vb and canon[va] == canon[vb]) or alike(sets(ta), sets(tb))}
    pairs = cross_split_pairs(e, t)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    overlaps = cross_split_overlaps(e, t)
    assert overlap_report(e, overlaps).agg(F.sum("pairs")).first()[0] == len(want)
    alike_ones = {(a, b) for a, _, _, _, ta in evals for b, _, tb in train if alike(sets(ta), sets(tb))}
    assert {(r["eval_id"], r["train_id"]) for r in overlaps.where("spans > 0").collect()} == alike_ones
    assert cross_split_pairs(e.limit(0), t).count() == 0 and cross_split_pairs(e, t.limit(0)).count() == 0


def test_pairs_across_splits_both_sides(spark):
    left = spark.createDataFrame([(1, i) for i in range(3)] + [(2, 9), (None, 1), (4, None)], "k long, a long")
    right = spark.createDataFrame([(1, i) for i in range(40)] + [(3, 9), (None, 1), (1, 0)], "k long, b long")
    got = [(r["a"], r["b"]) for r in pairs_across(left, right, "k", "a", "b", block=7).collect()]
    assert len(got) == 120 and set(got) == {(a, b) for a in range(3) for b in range(40)}


def test_leaks_are_exact(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices([f"term{k}" for k in range(400)], k=rng.randint(25, 60)))) for i in range(30)]
    docs = []
    for d in range(250):
        words = rng.choices(WORDS, k=rng.randint(0, 200))
        if rng.random() < 0.7:
            own = rng.choice(items)[1].split()
            at, n = rng.randrange(len(own)), rng.choice([4, 8, 9, 10, 11, 30])
            piece = own[at : at + n]
            if rng.random() < 0.4 and len(piece) > 6:
                piece[rng.randrange(len(piece))] = "swapped"
            words[len(words) // 2 : 0] = [w.upper() if rng.random() < 0.1 else w + rng.choice(["", ",", "."]) for w in piece]
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "x" * 100_000), (903, "  ".join(items[0][1].split())), (0, docs[0][1])]
    want = set()
    for d, text in docs:
        own = shingles.words(text or "")
        four, ten = {tuple(own[i : i + 4]) for i in range(len(own) - 3)}, {tuple(own[i : i + 10]) for i in range(len(own) - 9)}
        for i, item in items:
            it = item.split()
            runs = {tuple(it[k : k + 4]) for k in range(len(it) - 3)}
            if 2 * len(runs & four) >= len(runs) or any(tuple(it[k : k + 10]) in ten for k in range(len(it) - 9)):
                want.add((i, d))
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    got = [(r["item_id"], r["doc_id"]) for r in leaked_items(corpus, tests).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leaked_items(corpus.limit(0), tests).count() == 0 and leaked_items(corpus, tests.limit(0)).count() == 0


def test_ids_and_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(RANKS.replace(".tiktoken", ".json"))
    whole.encode_special_tokens = True
    texts = ["Hello  world's\n\n end ", "", None, "<|endoftext|> a", "हिंदी में 12½ ²", "🚶‍♂️➡️🚪 x́y‍z", "\U0001fae8 new ͸ unassigned", " \t\n ", "a" * 3000, "naïve 'S 's ", " é́"]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id long, text string, row int")
    got = encode_texts(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == sorted([(i, tuple(x)) for i, x in enumerate(want)] + [(0, tuple(want[0]))])
    back = {r["doc_id"]: r["text"] for r in decode_ids(encode_texts(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    monkeypatch.setattr("textloom.llm.encoding.BROADCAST_BYTES", 0)
    monkeypatch.setattr("textloom.llm.encoding.FREQUENT_PIECES", 3)
    again = {r["doc_id"]: tuple(r["ids"]) for r in encode_texts(df, "doc_id", "text").collect()}
    assert again == {i: tuple(x) for i, x in enumerate(want)}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_defects_of_pairs():
    reference = "A tall lamp stands near the door. A man in a red coat walks past the old table and then opens the window."
    given = {
        None: "empty", "": "empty", " ​": "empty", "N/A": "empty", "[ERROR: x]": "empty", "...": "empty", "<end_of_utterance>": "empty",
        "I'm sorry, but I can't describe this video.": "refusal", "No puedo describir este vídeo.": "refusal", "Ich kann dieses Video leider nicht beschreiben.": "refusal", "Je ne peux pas décrire cette vidéo.": "refusal",
        "Answer: " + reference.upper(): "copy", reference.replace("old ", ""): "copy",
        "Un hombre con un abrigo rojo abre la ventana y se sienta en la mesa mientras suena una radio.": "wrong_language",
        "Sure! Un hombre con un abrigo rojo abre la ventana y se sienta en la mesa mientras suena una radio.": "wrong_language",
        'A sign on the door says "sorry, we are closed". You cannot see past a tall shelf on the left of the hall.': None,
        'A woman says "I can\'t help you" and walks to the exit of the hall with a bag.': None,
        'A man opens the window. The banner reads "Feliz cumpleaños a la abuela" and the lamp is on.': None,
    }
    assert {a: answers.defect(reference, a) for a in given} == given
    assert answers.defect(None, "A lamp is on the table.") is None
    assert answers.language("चौकीदार दरवाजा खोलता है") == "hi"


def test_automaton():
    whole = cuts.automaton('"It ends here." :) (end of clip)')
    assert whole["ended"] and not cuts.automaton("It stops in the mid")["ended"]
    assert cuts.automaton("No hazards vis�")["broken"] and cuts.automaton("a gap,")["dangling"]
    assert cuts.automaton("He said “go (now")["open"] == "“("
    assert cuts.automaton("")["core"] == "" and cuts.automaton("...")["core"] == ""


def test_cut_texts(spark):
    rng = random.Random(2)
    nouns, places = ["lamp", "table", "basket", "window", "bucket", "mirror"], ["near the door", "by the stairs", "on the left", "in the far corner"]
    say = lambda: f"A {rng.choice(['red', 'tall', 'wooden', 'striped'])} {rng.choice(nouns)} stands {rng.choice(places)}."
    whole = [" ".join(say() for _ in range(4)) for _ in range(400)]
    cut = [t[: t.rindex(" A ") + rng.choice([4, 5, 9])] for t in whole[:40]]
    bare = [t[:-1] for t in whole[40:80]]
    rows = [(f"w{i}", "s", t) for i, t in enumerate(whole)] + [(f"c{i}", "s", t) for i, t in enumerate(cut)] + [(f"b{i}", "s", t) for i, t in enumerate(bare)] + [("n", "s", None), ("e", None, ""), ("p", "s", "N/A"), ("w0", "s", whole[0])]
    df = spark.createDataFrame(rows, "id string, source string, text string")
    got = Counter((r["id"][0], r["cut"]) for r in cuts.cut_texts(df, df).collect())
    assert got["w", True] == 0 and got["b", True] <= 2 and got["c", False] <= 2
    assert not {"n", "e", "p"} & {k for k, _ in got}
    assert cuts.cut_texts(df.limit(0), df.limit(0)).count() == 0


def test_open_structures_tell_cuts(spark):
    """The same last words are a cut inside an open quote or tag and none outside, with or without a closing mark."""
    assert cuts.automaton("<b>A lamp <i>is</i> near")["open"] == "<b>" and cuts.automaton("<b>A lamp.</b>")["open"] == "" == cuts.automaton('He said "go there."')["open"]
    whole = ["A lamp stands near the big door."] * 150 + ["The big door shuts. A sign is by the big door in the hall."] * 150 + ['A sign reads "mind the step" here.'] * 100
    torn = [f'A man opens the old window and then "reads x{i}' for i in range(30)]
    cut = ['The sign near it says "mind the big door', 'The sign near it says "mind the big door in.', "<p>The sign near it says mind the big door in."]
    fine = ["The sign near it says mind the big door", "The sign near it says mind the big door."]
    source = lambda k, i: "u" if k in "cf" or k == "w" and i % 2 else "s"
    df = spark.createDataFrame([(f"{k}{i}", source(k, i), t) for k, ts in (("w", whole), ("t", torn), ("c", cut), ("f", fine)) for i, t in enumerate(ts)], "id string, source string, text string")
    got = {r["id"]: r["cut"] for r in cuts.cut_texts(df, df).collect()}
    assert {k for k, v in got.items() if v and k[0] != "t"} == {"c0", "c1", "c2"}


def test_refusals_of_any_length():
    late = "The image was received. I looked at the file. I am sorry, but I cannot describe this scene."
    long = "I am sorry, but I cannot describe this video. " + "I cannot say what stands in it, and I will not guess at it. " * 6 + "You may send another file with more light in it than this one has."
    assert answers.is_refusal(late) and answers.is_refusal(long)
    assert not answers.is_refusal("I am sorry to say so. A man in a red coat walks past the old table by the stairs, and a lamp falls. The floor is wet near the door and a dog sleeps on the carpet.")
    reference = "A tall lamp stands near the door. A man in a red coat walks past the old table and then opens the window."
    assert answers.defect(reference, "Here is the full description of this video that you asked me to write for you today: " + reference) == "copy"


def test_own_sentence_is_no_evidence(spark):
    """A text's own end doesn't make its last words an end: a number cut after its point, and a mark after a cut."""
    rng = random.Random(8)
    say = lambda: f"A {rng.choice(['red', 'tall', 'wooden'])} lamp stands {rng.randint(1, 9)}.{rng.randint(1, 9)} meters from the door. It is near a {rng.choice(['chair', 'table'])} by the stairs."
    whole = [" ".join(say() for _ in range(3)) for _ in range(300)]
    rows = [(f"w{i}", t) for i, t in enumerate(whole)] + [("n", whole[0] + " A tall lamp stands 4."), ("m", whole[1] + " It is near a."), ("p", whole[2][:40]), ("q", "A tall la")]
    df = spark.createDataFrame([(i, "s", t) for i, t in rows], "id string, source string, text string")
    pool = spark.createDataFrame([("A tall lamp stands by the wall of the hall.",)], "text string")
    got = {r["id"]: r["why"] for r in cuts.cut_texts(df, pool).where("cut").collect()}
    assert set(got) == {"n", "m", "p", "q"} and got["q"] == "shortened"


def test_defective_pairs(spark):
    rows = [(1, "A lamp is near the door of the hall.", None, "f"), (1, "A lamp is near the door of the hall.", None, "f"), (2, None, "A tall lamp is here.", None)]
    df = spark.createDataFrame(rows, "output_id long, reference string, generated string, run_file string")
    found = answers.defective_pairs(df, df.select(F.col("generated").alias("text")), "output_id", "reference", "generated", "run_file")
    assert [tuple(r) for r in found.collect()] == [(1, "empty")]


NAMES = [("Ansel", "given"), ("Mirela", "given"), ("Hope", "given"), ("Stone", "family"), ("Kolvane", "family"), ("Vossberg-Lind", "family"), ("Banks", "family")]


def test_personal_details(spark):
    rng = random.Random(4)
    given, family = ["Ansel", "Mirela", "Asha"], ["Kolvane", "Vossberg-Lind", "Nandarin"]
    filler = ["the lamp is near the door.", "we hope the stone wall is dry.", "a bank of the river."]
    docs = [(i, f"Reviewed by {rng.choice(given)} {rng.choice(family)} on Tuesday. In the hall {rng.choice(filler)}") for i in range(300)]
    text = "Reviewed by Asha Nandarin on Tuesday. Thanks, ANSEL KOLVANE\nMail asha.nandarin(at)example.org or bo@mail.example.net, ring (415) 555-0179.\nPassport no. 987373750 was here. Clip 5669156659 repeats. He lives at 12B Osprey Court, second floor. Calle Robledina, 114\nOsprey Court was closed. The Stone Bridge is dark."
    docs += [(900, text), (901, None), (902, ""), (900, text), (903, "word " * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kind string")
    names = spark.createDataFrame(NAMES, "name_part string, kind string")
    got = {(r["kind"], r["value"]) for r in personal.personal_details(df, names).where("doc_id = 900").collect()}
    assert got == {("person", "Asha Nandarin"), ("person", "ANSEL KOLVANE"), ("email", "asha.nandarin(at)example.org"), ("email", "bo@mail.example.net"), ("phone", "(415) 555-0179"), ("id_number", "987373750"), ("address", "12B Osprey Court"), ("address", "Calle Robledina, 114")}
    redacted = {r["doc_id"]: r["text"] for r in personal.redacted_texts(df, names).collect()}
    assert redacted[900].startswith("Reviewed by [PERSON] on Tuesday.") and redacted[901] is None and redacted[902] == ""
    assert personal.personal_details(df.limit(0), names).count() == 0
    assert personal.personal_details(df, names.limit(0)).where("kind = 'email'").count() == 2


def test_common_words_are_counted_over_all_documents(spark):
    """Words that only documents outside the sample write in lower case are no names, in long texts too."""
    ids = [r["id"] for r in spark.range(300).orderBy(F.xxhash64("id"), "id").collect()]
    rng = random.Random(4)
    name = lambda: f"{rng.choice(['Ansel', 'Mirela', 'Asha'])} {rng.choice(['Kolvane', 'Vossberg-Lind', 'Nandarin'])}"
    docs = [(i, f"Reviewed by {name()} on Tuesday. In the hall the lamp is near the door.") for i in ids[:200]]
    docs += [(i, "A quill and the wort are near the door.") for i in ids[200:290]]
    docs += [(ids[290], "Reviewed by Quill Wort on Tuesday. In the hall the lamp is near the door."), (ids[291], "Reviewed by Hollow Fern on Tuesday. In the hall."), (ids[292], "a hollow by the fern. " * 1_500)]
    df, names = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(NAMES, "name_part string, kind string")
    got = {r["value"] for r in personal.personal_details(df, names, sample_docs=150).collect()}
    assert "Ansel Kolvane" in got and not {"Quill Wort", "Hollow Fern"} & got
