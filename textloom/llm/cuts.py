"""Problem 2: texts that were cut off, and how often each source cuts.

Each distinct text runs once through a stack automaton (quotes, brackets, markup, escapes, broken characters, closing
marks) that takes off what was put after it, tells what is left open and gives its last sentence. Whether that sentence
needs more words is told by the corpus itself: how often its last words end a sentence in other texts against how often
they stand inside one, which words all sentences with its beginning hold and how long these are, and whether the text,
in the sorted order of all texts, is the beginning of another one that goes on. The evidence is weighed by Bayes' rule
against each source's baseline: the share of cuts among its texts without a closing mark, spikes of its text lengths at a
limit, and the share of its whole texts that leave a quote, bracket or tag open. Counts are over all distinct texts, a
text's own sentences left out of what it is judged by; no models are fitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import shingles
from textloom.session import cut_lineage

TOKEN = re.compile(r"[^\s.,;:!?…।\"“”„«»()\[\]{}<>*`�]+")
ENDS = ".!?।"
#: Ends of sentences inside a text: a mark (not within a number) before a space or the end, or a line's end.
_SENTENCE = re.compile(r"(?<=[.!?।])[\"”»')\]*]*(?:\s+|$)|\n+")
_AFTER = re.compile(r"(?:\s+|[​‌‍﻿]+|\(\s*end[^()]*\)|\[[^\[\]]*\]|<[^<>]*>|[:;]-?[)D(]|[\"“”„«»*`_~#|]+|[\U0001F300-\U0001FAFF☀-➿]️?|--+)$", re.I)
_CLOSERS = re.compile(r"[)\]}'’]+$")
_ESCAPE = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&[a-zA-Z#0-9]{1,6}|%[0-9A-Fa-f]?|<[a-zA-Z/][^<>]{0,20})$")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
#: What an end without anything to take off doesn't hold.
_PLAIN_END = re.compile(r"[\\&%<:;]")
_ANY_STRUCTURE = re.compile(r"[<(\[{“«)\]}”»\"]")
_STRUCTURE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][\w\-]*)(?:\s[^<>]*)?/?>|[(\[{“«)\]}”»\"]")
#: Tags that are never closed.
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "col", "area"}
PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
#: A word that so many of the sentences with one beginning hold is fixed, if by the rule of succession a next one would
#: hold it, too, with a chance of SURE; the same chance makes their least length one.
FIXED_SHARE, SURE = 0.98, 0.96
#: Texts of one length, against the usual number in the source, that make a spike; fewer may be chance.
SPIKE_TEXTS, SPIKE_TIMES = 5, 8
#: Sightings that the shorter word group stands for.
SMOOTHING = 3.0
#: Rows of counts up to which they are broadcast (about 40 bytes each).
BROADCAST_ROWS = 400_000


#: What stands for no text at all.
PLACEHOLDERS = ("n/a", "na", "n.a", "none", "null", "nil", "nan", "no output", "no text", "no description", "no caption", "no answer", "empty", "blank", "tbd", "todo", "undefined", "missing", "not available", "unavailable", "placeholder", "description", "caption", "answer", "output", "sin descripción", "aucune description", "keine beschreibung", "sem descrição")
_MARKERS = re.compile(r"\[[^\[\]]*\]|<[^<>]*>|\(\s*(?:no|empty|error|none|end)[^()]*\)|\{[^{}]{0,40}\}", re.I)


def is_empty(text: str | None) -> bool:
    """Null, blank, only marks, a placeholder, or only bracketed status markers."""
    if text is None:
        return True
    bare = (_MARKERS.sub(" ", text) if any(c in text for c in "[<({") else text).replace("\u00ad", "")
    words = [m[0].lower() for m in islice(shingles.WORD.finditer(bare), 1 + _PLACEHOLDER_LENGTH)]
    return not words or " ".join(words) in _PLACEHOLDER_WORDS


_PLACEHOLDER_WORDS = {" ".join(shingles.words(x)) for x in PLACEHOLDERS}
_PLACEHOLDER_LENGTH = max(len(x.split()) for x in _PLACEHOLDER_WORDS)


def automaton(text: str) -> dict:
    """core: the text without what was put after it; open: what is left unclosed on the stack; broken: it ends in a broken
    character or escape; ended: it has a closing mark; dangling: it ends in a comma, a dash or an open bracket."""
    core, broken, dots = text, False, False
    while True:
        if core.endswith(("…", "...")):
            core, dots = core.rstrip("…").rstrip("."), True
        elif (core[-1:].isalnum() or core[-1:] in ENDS) and not _PLAIN_END.search(core, len(core) - 24 if len(core) > 24 else 0):
            break  # most texts: no pattern below can match
        elif core.endswith(("�", "\ud83d")) or _ESCAPE.search(core):
            core, broken = (core[:-1] if core[-1] in "�\ud83d" else core[: _ESCAPE.search(core).start()]), True
        else:
            match = _AFTER.search(core)
            closing = _CLOSERS.search(core)
            if match and match.start() < len(core):
                core = core[: match.start()]
            elif closing and closing.start() > 0 and core[closing.start() - 1] in ENDS:
                core = core[: closing.start()]
            else:
                break
        if not core:
            break
    stack: list[str] = []
    for match in _STRUCTURE.finditer(text) if _ANY_STRUCTURE.search(text) else ():
        c, taken_off = match[0], match.start() >= len(core)  # what was put after the text opens nothing
        if match["tag"]:
            name = match["tag"].lower()
            if match["end"]:
                if f"<{name}>" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name}>") :]
            elif not taken_off and name not in VOID_TAGS and not c.endswith("/>"):
                stack.append(f"<{name}>")
        elif c in PAIRS or c == '"' and stack and stack[-1] == '"':
            if stack and stack[-1] == PAIRS.get(c, c):
                stack.pop()
        elif not taken_off:
            stack.append(c)
    ended = bool(core) and core[-1] in ENDS and not dots
    return {"core": core, "open": "".join(stack), "broken": broken, "ended": ended, "dangling": bool(core) and core[-1] in ",;-–—(/&+", "dots": dots}


class _Numbers(dict):
    """A 64-bit hash for each token seen; begun anew when large, so that a worker's memory stays bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token)
        return value


_SEEN = _Numbers()
_G2, _G3, _HEAD, _PART = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _read_texts(texts: list[str]) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the automaton says of each text, and of all sentences one after another: the hashes of their tokens, the number
    of these, the text of each sentence, whether it is a whole one and whether it has a closing mark."""
    seen, flat, length, owner, whole, closed = [], [], [], [], [], []
    number = _SEEN.__getitem__
    for i, text in enumerate(texts):
        told = automaton(text)
        parts = [p for p in _SENTENCE.split(_NUMBER.sub("#", told["core"].lower())) if p and not p.isspace()]
        for j, part in enumerate(parts):
            own = TOKEN.findall(part)
            flat.extend(map(number, own))
            length.append(len(own))
            owner.append(i)
            whole.append(j < len(parts) - 1 or told["ended"])
            closed.append(part.rstrip("\"”»')]* ")[-1:] in ENDS)
        told["parts"], told["number"] = len(parts), bool(parts and own and own[-1] == "#")
        seen.append(told)
    return seen, np.array(flat, np.uint64), np.array(length, np.int64), np.array(owner, np.int64), np.array(whole, bool), np.array(closed, bool)


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, the place of one of each, and the sums of the columns by key."""
    order = np.argsort(keys, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[order][start], order[start], *[np.add.reduceat(c[order], start) if len(start) else c[:0] for c in columns]


_COLUMNS = {"kind": pa.string(), "key": pa.int64(), "word": pa.int64(), "x": pa.int64(), "y": pa.int64(), "core": pa.string(), "chars": pa.int32(), "ended": pa.bool_(), "dangling": pa.bool_(), "broken": pa.bool_(), "opened": pa.bool_(), "words": pa.int32(), "k1": pa.int64(), "k2": pa.int64(), "k3": pa.int64(), "head": pa.int64(), "bag": pa.list_(pa.int64()), "number": pa.bool_()}
_SCHEMA = "kind string, key long, word long, x long, y long, core string, chars int, ended boolean, dangling boolean, broken boolean, opened boolean, words int, k1 long, k2 long, k3 long, head long, bag array<long>, number boolean"
_FEATURES = ["key", *list(_COLUMNS)[5:]]


def _batch(kind: str, n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()) if name == "kind" else columns.get(name, pa.nulls(n, at)) for name, at in _COLUMNS.items()], list(_COLUMNS))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def read_texts(texts: DataFrame) -> DataFrame:
    """One reading of the distinct texts(key, text): rows of four kinds.

    t: what the automaton and the last sentence of the text `key` say. g: x times a group of one to three words (key) ends
    a sentence, y times it stands inside one. h: x whole sentences begin with two words (key), the shortest has y. w: x of
    these sentences hold a word. The counts are sums of parts of the corpus.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not is_empty(t)]
            if not kept:
                continue
            seen, token, length, owner, whole, closed = _read_texts([t for _, t in kept])
            one = shingles.mix(token)
            sentence = np.repeat(np.arange(len(length)), length)
            begin = np.cumsum(length) - length
            place = np.arange(len(token)) - begin[sentence]
            two, three = one.copy(), one.copy()
            two[1:] = shingles.mix(one[:-1] * _G2 + one[1:])
            three[2:] = shingles.mix(two[1:-1] * _G3 + one[2:])
            final = place == length[sentence] - 1
            ends, inside = (final & (whole & closed)[sentence]).astype(np.int64), (~final).astype(np.int64)
            use = (ends + inside) > 0
            groups = np.concatenate([one[use], two[use & (place > 0)], three[use & (place > 1)]])
            x, y = (np.concatenate([c[use], c[use & (place > 0)], c[use & (place > 1)]]) for c in (ends, inside))
            key, _, x, y = _summed(groups, x, y)
            yield _batch("g", len(key), key=_signed(key), x=_signed(x), y=_signed(y))
            # beginnings of whole sentences, and the distinct words after them
            long = np.flatnonzero(whole & (length > 2))
            head = np.zeros(len(length), np.uint64)
            any_head = np.flatnonzero(length > 2)
            head[any_head] = two[begin[any_head] + 1] ^ _HEAD
            order = np.argsort(head[long], kind="stable")
            start = np.flatnonzero(np.concatenate([[True], head[long][order][1:] != head[long][order][:-1]])) if len(long) else np.zeros(0, np.int64)
            if len(long):
                yield _batch("h", len(start), key=_signed(head[long][order][start]), x=_signed(np.diff(np.append(start, len(order)))), y=_signed(np.minimum.reduceat(length[long][order], start)))
                after = np.flatnonzero((place > 1) & (whole & (length > 2))[sentence])
                own = np.unique(np.stack([sentence[after].astype(np.uint64), one[after]]), axis=1)
                member = head[own[0].astype(np.int64)]
                _, spot, count = _summed(shingles.mix(member + own[1] * _PART), np.ones(len(member), np.int64))
                yield _batch("w", len(spot), key=_signed(member[spot]), word=_signed(own[1][spot]), x=_signed(count))
            # the texts
            last = np.full(len(kept), -1)
            last[owner] = np.arange(len(owner))  # the last one stays
            words = np.where(last >= 0, length[last], 0) if len(length) else np.zeros(len(kept), np.int64)
            at = np.where(words > 0, begin[last] + words - 1, 0) if len(length) else words
            keys = []
            for n, gram in ((1, one), (2, two), (3, three)):
                keys.append(pa.array(gram[at].view(np.int64) if len(gram) else np.zeros(len(kept), np.int64), mask=words < n))
            spans = [one[at[i] - words[i] + 1 : at[i] + 1].view(np.int64) if words[i] else np.zeros(0, np.int64) for i in range(len(kept))]
            yield _batch(
                "t", len(kept), key=pa.array([k for k, _ in kept], pa.int64()), core=pa.array([s["core"] for s in seen], pa.string()), chars=pa.array([len(t) for _, t in kept], pa.int32()),
                **{n: pa.array([bool(s[m]) for s in seen], pa.bool_()) for n, m in (("ended", "ended"), ("dangling", "dangling"), ("broken", "broken"), ("opened", "open"), ("number", "number"))},
                words=pa.array(words, pa.int32()), k1=keys[0], k2=keys[1], k3=keys[2], head=pa.array(head[last].view(np.int64) if len(head) else np.zeros(len(kept), np.int64), mask=words < 3), bag=pa.array(spans, pa.list_(pa.int64())),
            )

    return texts.mapInArrow(read, _SCHEMA)


def sentence_counts(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of read_texts: (key, ends, inside) of word groups, and (head, sentences, shortest, fixed) of sentence beginnings."""
    rows = cut_lineage(read.where("kind <> 't'").groupBy("kind", "key", "word").agg(F.sum("x").alias("x"), F.min("y").alias("least"), F.sum("y").alias("y")))
    groups = rows.where("kind = 'g'").select("key", F.col("x").alias("ends"), F.col("y").alias("inside"))
    sure = lambda n, of: (F.col(n) + 1) / (F.col(of) + 2) >= SURE
    heads = rows.where("kind = 'h'").select(F.col("key").alias("head"), F.col("x").alias("sentences"), F.col("least").alias("shortest")).where(sure("sentences", "sentences"))
    fixed = rows.where("kind = 'w'").select(F.col("key").alias("head"), "word", "x").join(heads, "head").where(F.col("x") >= FIXED_SHARE * F.col("sentences")).groupBy("head").agg(F.collect_list("word").alias("fixed"))
    return groups, heads.join(fixed, "head", "left")


def shortened(texts: DataFrame) -> DataFrame:
    """(core, goes_on) of the texts(core) that are the beginning of the text after them in sorted order.

    goes_on: that one goes on inside the word or the sentence, not with a closing mark. A text that begins any other one
    begins its next neighbour. Texts are sorted by ranges, so that a hot beginning is spread over tasks; the last of a
    range is compared with the first of the next that isn't empty.
    """
    ranged = cut_lineage(texts.select("core").where("length(core) > 0").repartitionByRange("core").distinct().withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("core").alias("first"))
    over = firsts.withColumn("after", F.lead("first").over(Window.orderBy("part"))).select("part", "after")  # a row per range
    sorted_ = ranged.join(F.broadcast(over), "part").withColumn("next", F.coalesce(F.lead("core").over(Window.partitionBy("part").orderBy("core")), "after"))
    rest = F.substring("next", F.length("core") + 1, F.lit(2))
    return sorted_.where(F.col("next").startswith(F.col("core"))).select("core", (~rest.rlike(r"^[.!?।\n]")).alias("goes_on"))


def _lookup(rows: DataFrame, counts: DataFrame, key: str, small: bool) -> DataFrame:
    """e_key and i_key: how often the last words end a sentence of other texts, and stand inside one."""
    named = counts.select(F.col("key").alias(key), F.col("ends").alias(f"e_{key}"), F.col("inside").alias(f"i_{key}"))
    found = rows.join(F.broadcast(named) if small else named, key, "left").fillna(0, [f"e_{key}", f"i_{key}"])
    return found.withColumn(f"e_{key}", F.greatest(F.lit(0), F.col(f"e_{key}") - F.col("ended").cast("int")))


def _small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def cut_texts(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, source, cut, why) of rows(id, source, text), told by the sentences of these and of corpus(text).

    why names the evidence of a cut, the first in the order open, broken, dangling, shortened, word, needs, ends. Null
    texts, placeholders and texts without words are not cut and stand in no row. An empty corpus leaves only what the
    texts themselves show.
    """
    keyed = rows.where("text is not null").select(F.col("id").cast("string").alias("id"), "source", F.xxhash64("text").alias("key"), "text")
    every = keyed.select("key", "text").unionByName(corpus.where("text is not null").select(F.xxhash64("text").alias("key"), "text"))
    read = cut_lineage(read_texts(every.groupBy("key").agg(F.first("text").alias("text"))))
    counts, heads = sentence_counts(read)
    texts = read.where("kind = 't'").select(*_FEATURES)
    total = counts.join(texts.select("k1").distinct(), counts.key == F.col("k1"), "left_semi").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside")).first()
    ends_all, all_ = float(total["ends"] or 1), float((total["ends"] or 1) + (total["inside"] or 1))
    small = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # what moves is narrow: texts and bags of words meet only small tables, or those they are sorted by
    told = texts.where("words > 0").select("key", "chars", "ended", "dangling", "broken", "opened", "number", "k1", "k2", "k3")
    for key in ("k1", "k2", "k3"):
        told = _lookup(told, counts, key, small)
    headed = texts.where("head is not null").select("key", "head", "words", "bag").join(_small(cut_lineage(heads)), "head")
    lacks, short = F.size(F.array_except("fixed", "bag")) > 0, F.col("words") < F.col("shortest")
    told = told.join(headed.where(F.coalesce(lacks, F.lit(False)) | F.coalesce(short, F.lit(False))).select("key", F.lit(True).alias("needs")), "key", "left")
    begun = texts.where("not ended").select("key", "core").join(_small(cut_lineage(shortened(texts))), "core").select("key", "goes_on")
    told = told.join(begun, "key", "left")
    # how often the last words end a sentence: three words, smoothed by two, these by one; against any place in a text
    base_rate = ends_all / all_
    one = (F.col("e_k1") + 0.2 * base_rate) / (F.col("e_k1") + F.col("i_k1") + 0.2)
    two = (F.col("e_k2") + SMOOTHING * one) / (F.col("e_k2") + F.col("i_k2") + SMOOTHING)
    three = (F.col("e_k3") + SMOOTHING * two) / (F.col("e_k3") + F.col("i_k3") + SMOOTHING)
    odds = base_rate / three
    unknown = (F.col("e_k1") + F.col("i_k1") <= 1) & ~F.col("number")
    open_end = ~F.col("ended")
    why = F.when(open_end & F.col("broken") & (odds > 0.2), "broken").when(open_end & F.col("dangling"), "dangling").when(open_end & F.col("goes_on"), "shortened").when(open_end & unknown, "word")
    told = told.withColumn("hard", why).withColumn("needs", F.coalesce("needs", F.lit(False))).withColumn("odds", odds)
    told = told.select("key", "chars", "ended", "hard", "needs", "odds", "number", "e_k1", "i_k1", "e_k2", "goes_on", "opened")
    told = cut_lineage(keyed.select("id", "source", "key").join(told, "key"))
    # each source's baseline: lengths at a limit, cuts among texts without a closing mark, and structures that whole texts leave open
    spike = told.where("not ended").groupBy("source", "chars").agg(F.count(F.lit(1)).alias("same"))
    usual = spike.groupBy("source").agg(F.avg("same").alias("usual"))
    spikes = spike.join(usual, "source").where((F.col("same") >= SPIKE_TEXTS) & (F.col("same") >= SPIKE_TIMES * F.col("usual"))).select("source", "chars", F.lit(True).alias("spike"))
    base = told.groupBy("source").agg(((F.count_if(~F.col("ended") & F.col("hard").isNotNull()) + 1) / (F.count_if(~F.col("ended")) + 2)).alias("prior"), ((F.count_if(F.col("ended") & F.col("opened")) + 1) / (F.count_if("ended") + 2)).alias("loose"))
    torn = told.where("hard is not null").agg(((F.count_if("opened") + 1) / (F.count(F.lit(1)) + 2)).alias("x")).first()["x"]
    told = told.join(_small(spikes), ["source", "chars"], "left").join(_small(base), "source", "left")
    tear = F.when(F.col("opened"), F.greatest(F.lit(1.0), torn / F.coalesce("loose", F.lit(0.5)))).otherwise(1.0)
    prior = F.greatest(F.lit(0.2), F.least(F.lit(0.8), F.coalesce("prior", F.lit(0.5))))
    weight = prior / (1 - prior) * F.when(F.col("spike"), 5.0).otherwise(1.0) * F.when(F.col("goes_on") == F.lit(False), 0.2).otherwise(1.0)
    never = (F.col("e_k1") == 0) & (F.col("i_k1") >= 20) & (F.col("e_k2") == 0)  # words that end no other sentence
    why = (
        F.when(F.col("ended"), F.when(F.col("opened") & (F.col("odds") * tear > 20), "open").when(F.col("number") & (F.col("odds") > 20) | never, "ends"))
        .when(F.col("opened") & (tear > 1) & (F.col("hard").isNotNull() | F.col("needs") | (weight * tear * F.col("odds") > 1)), "open")
        .when(F.col("hard").isNotNull(), F.col("hard")).when(F.col("needs"), "needs").when(weight * tear * F.col("odds") > 1, "ends")
    )
    return told.select("id", "source", why.isNotNull().alias("cut"), why.alias("why"))


def truncation_by_source(cuts: DataFrame) -> DataFrame:
    """(source, texts, cut, share) of cut_texts."""
    return cuts.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
