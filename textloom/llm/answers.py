"""Problem 1: answers that are no usable answer to their reference, each with its defect.

Rules in this order, the first that holds: `empty`, `refusal`, `wrong_language`, `copy`, `truncated`. Truncation is that of
`cuts`: all answers and references in sorted order, a shortened one beside what it was cut from, spikes of lengths at a
limit, and last sentences that need more words. A copy is found by the longest common subsequence of words. Languages are told by script, else by
function words; languages without either are not told apart.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shingles
from textloom.llm.cuts import cut_texts, is_empty
from textloom.session import spread

COPIED = 0.75
#: Words that a copy may add before the first copied word and elsewhere.
LEAD_WORDS, ODD_WORDS = 10, 3
#: Words of sentences that describe, of all words of an answer that declines, up to which it is a refusal.
DESCRIBED = 0.25

# Function words by language.
FUNCTION_WORDS = {
    "en": "the and of with is are to at from by this that you it its there on an while who which behind near under into past was were has have not or be as for he she they their ahead",
    "es": "el la los las una uno unos unas y del al con sin por para está hay que se en su es son mientras donde sobre bajo detrás junto muy más pero cuando como lo le",
    "fr": "le les une des du et au aux avec sans pour est sont qui que dans sur sous il elle ne pas pendant près à d l un où très plus mais derrière devant son sa ses en",
    "de": "der die das den dem des ein eine einen einem einer und ist sind im am zum zur mit ohne auf unter vor hinter nicht es sich während neben bei wird auch aber sehr",
    "pt": "o os uma uns umas e do da dos das no na nos nas ao à com sem por para está há que se em seu sua é são enquanto perto atrás junto muito mais mas não um",
    "it": "il lo gli una uno e del della dei delle nel nella al alla con senza per è sono che si in su sotto mentre dove vicino dietro molto più ma non di",
    "nl": "de het een en van met zonder voor is zijn op in onder achter naast niet die dat er terwijl bij aan ook maar zeer naar",
}
_SCRIPTS = (("hi", re.compile("[ऀ-ॿ]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("zh", re.compile("[぀-ヿ一-鿿]")), ("ko", re.compile("[가-힯]")), ("el", re.compile("[Ͱ-Ͽ]")), ("he", re.compile("[֐-׿]")), ("th", re.compile("[฀-๿]")), ("bn", re.compile("[ঀ-৿]")), ("ta", re.compile("[஀-௿]")))
_WORDS = {lang: set(words.split()) for lang, words in FUNCTION_WORDS.items()}
_WEIGHT = {w: 1 / n for w, n in Counter(w for ws in _WORDS.values() for w in ws).items()}
_OWNERS = {w: [lang for lang, own in _WORDS.items() if w in own] for w in _WEIGHT}
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|‘[^’\n]{2,}’")

# How answers decline, by language, each with words of which it holds at least one (Hindi: none).
DECLINES = (
    # English
    ("i we", r"\b(?:i|we)(?:\s+am|'m|\s+are)?\s+(?:really\s+|very\s+|so\s+|deeply\s+)?(?:sorry|afraid)\b"),
    ("sorry apologies regrets regrettably unfortunately", r"^(?:\W*)(?:sorry|apologies|my apologies|my regrets|regrettably|unfortunately)\b"),
    ("i we", r"\b(?:i|we)\s+(?:\w+\s+)?(?:apologi[sz]e|regret)\b"),
    ("i we", r"\b(?:i|we)\s+(?:\w+\s+)?(?:cannot|can\s*not|can't|could\s*n[o']t|won't|will\s+not|would\s+not|wouldn't|may\s+not|must\s+not|do\s+not|don't|did\s+not|didn't|decline|refuse|lack)\b"),
    ("rather prefer", r"\b(?:i|we)\s+(?:would|'d)\s+(?:rather|prefer)\s+(?:not|to\s+not)\b|\bprefer\s+not\s+to\b"),
    ("i we", r"\b(?:i|we)\s+(?:must|have\s+to|need\s+to)\s+(?:\w+\s+)?(?:decline|refuse|refrain|abstain)\b"),
    ("i we", r"\b(?:i|we)(?:\s+am|'m|\s+are)\s+(?:\w+\s+)?(?:unable|not\s+able|not\s+(?:allowed|permitted|authori[sz]ed|equipped|capable|going|programmed|comfortable|willing)|incapable|forbidden|prohibited)\b"),
    ("i we", r"\b(?:i|we)\s+(?:have|'ve)\s+(?:been\s+)?(?:instructed|told|asked|trained|no\s+(?:access|way|ability|means))\b|\bi\s+only\s+(?:work|deal|process|handle)\b"),
    ("me us my i", r"\b(?:not\s+possible|impossible)\s+for\s+(?:me|us)\b|\bbeyond\s+(?:what\s+i|my)\b|\boutside\s+(?:what\s+i|my)\b|\bwhat\s+i\s+(?:am|can|may)\b"),
    ("ai model assistant chatbot", r"\bas\s+an?\s+(?:\w+\s+)?(?:ai|language\s+model|assistant|model|chatbot)\b"),
    ("policy policies guidelines rules safety", r"\b(?:against|violates?|because\s+of|due\s+to|under|by)\s+(?:my|our|the|safety|content|company)?\s*(?:policy|policies|guidelines|rules|safety)\b"),
    ("request", r"\brequest\s+(?:was\s+|is\s+|has\s+been\s+)?(?:declined|denied|rejected|refused|blocked|cannot|can't|can\s+not|could\s+not)\b"),
    ("description caption answer account", r"\b(?:no|a)\s+(?:description|caption|answer|account)\s+(?:can|could|will|may|is|cannot|can't)\b"),
    ("assistant model system", r"\b(?:this|the)\s+(?:assistant|model|system)\s+(?:refuses|declines|cannot|can't|is\s+unable|does\s+not|will\s+not|won't)\b|\bby\s+this\s+assistant\b"),
    ("content tool", r"\bcontent\s+(?:is\s+)?not\s+(?:allowed|permitted)\b|\byou\s+(?:will\s+)?need\s+another\s+tool\b"),
    # Spanish
    ("siento lamento temo disculpa disculpas disculpe no niego abstengo como solicitud prefiero mi mis nuestra nuestras", r"\blo\s+(?:siento|lamento)\b|\blamento\b|\bme\s+temo\b|\b(?:mis\s+)?disculpas?\b|\bdisculpe\b|\bno\s+(?:puedo|podré|soy\s+capaz|me\s+es\s+posible|estoy\s+(?:autorizad|en\s+condiciones|en\s+posición)|tengo\s+(?:acceso|permitido|permiso))|\bme\s+(?:niego|abstengo)\b|\bcomo\s+(?:un\s+)?(?:modelo|asistente|ia\b|inteligencia)|\bsolicitud\s+(?:rechazada|denegada|no)|\bprefiero\s+no\b|\bno\s+se\s+puede\s+(?:dar|ofrecer|proporcionar)\b|\b(?:mi|mis|nuestras?)\s+(?:política|políticas|normas|directrices)\b"),
    # French
    ("désolé désolée regrette malheureusement excuses je impossible tant demande aucune ma mes nos", r"\bdésolée?\b|\bje\s+regrette\b|\bmalheureusement\b|\b(?:mes|toutes\s+mes)\s+excuses\b|\bje\s+(?:ne|n['’])\s*(?:peux|puis|pourrai|suis|saurais|dispose|ai|veux|vois|souhaite)\s*(?:pas|en)?|\bil\s+m['’]est\s+impossible\b|\bje\s+(?:refuse|décline|préfère\s+ne)|\ben\s+tant\s+qu(?:e|['’])|\bdemande\s+(?:refusée|rejetée|ne)|\baucune\s+description\b|\b(?:ma|mes|nos)\s+(?:politique|règles|consignes)\b"),
    # German
    ("leid leider entschuldigung bedaure ich nicht als anfrage meine meiner meinen unsere", r"\btut\s+mir\s+leid\b|\bleider\b|\bentschuldigung\b|\bbedaure\b|\bich\s+(?:kann|darf|werde|möchte|will)\b.{0,60}\b(?:nicht|kein\w*|ablehnen)\b|\bkann\s+ich\b.{0,60}\b(?:nicht|kein\w*)\b|\bich\s+bin\s+nicht\b|\bnicht\s+in\s+der\s+lage\b|\bich\s+habe\s+kein\w*\b|\bals\s+(?:ki\b|sprachmodell|assistent|\w+\s+assistent)|\banfrage\s+(?:abgelehnt|verweigert|kann)|\b(?:meine|meiner|meinen|unsere)\s+richtlinien\b|\bich\s+(?:verweigere|lehne)\b"),
    # Portuguese
    ("desculpa desculpas desculpe desculpem desculpo sinto infelizmente não como pedido prefiro recuso minha minhas nossa nossas", r"\bdesculp\w+\b|\bsinto\s+muito\b|\binfelizmente\b|\bnão\s+(?:posso|poderei|consigo|sou\s+capaz|me\s+é\s+possível|estou\s+(?:autorizad|em\s+condições)|tenho\s+(?:acesso|permissão))|\bcomo\s+(?:um\s+)?(?:modelo|assistente|ia\b)|\bpedido\s+(?:recusado|negado|não)|\bprefiro\s+não\b|\brecuso\b|\bnão\s+é\s+possível\b|\b(?:minhas?|nossas?)\s+(?:política|políticas|diretrizes)\b"),
    # Italian, Dutch
    ("dispiace non purtroppo spijt helaas ik", r"\bmi\s+dispiace\b|\bnon\s+(?:posso|sono\s+in\s+grado)\b|\bpurtroppo\b|\bhet\s+spijt\s+me\b|\bhelaas\b|\bik\s+kan\b.{0,40}\bniet\b"),
    # Hindi
    ("", r"माफ़?|क्षमा|खेद\s|असमर्थ|(?:कर|दे|बता|देख)\s+(?:नहीं\s+)?(?:सकता|सकती|सकते)?\s*नहीं|नहीं\s+(?:कर|दे|बता|देख)\s+सक|(?:मैं|मुझे|मेरी|मेरे).{0,60}नहीं|अनुरोध\s+(?:अस्वीकार|पूरा)|सहायक\s+के\s+रूप"),
)
_DECLINE = [(set(needs.split()), re.compile(x, re.I | re.M)) for needs, x in DECLINES]
_SAYS = re.compile(r"[.!?।;\n]+\s*")


def _unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text) if any(c in text for c in "\"“«‘") else text


@lru_cache(maxsize=4_096)  # references are repeated
def language(text: str | None) -> str | None:
    """The language of most of a text, quoted words left out; null where it can't be told."""
    if not text:
        return None
    bare = _unquoted(text)
    if not bare.isascii():
        letters = sum(map(str.isalpha, bare)) or 1
        for lang, script in _SCRIPTS:
            if len(script.findall(bare)) > 0.4 * letters:
                return lang
    words = shingles.words(bare)
    score: Counter = Counter()
    for w, n in Counter(words).items():
        for lang in _OWNERS.get(w, ()):
            score[lang] += n * _WEIGHT[w]
    if not score:
        return None
    (best, most), *rest = score.most_common(2)
    if most < 2 or most < 0.08 * len(words) or (rest and most < 1.25 * rest[0][1]):
        return None
    return best


def is_refusal(text: str) -> bool:
    """A sentence of it declines, outside quotes, and at most a quarter of its words stand in sentences that describe: those
    of ten words or more that don't decline."""
    bare = _unquoted(text.replace("’", "'").strip())
    own = set(shingles.words(bare))
    found = [p for needs, p in _DECLINE if (own & needs if needs else not bare.isascii()) and p.search(bare)]
    if not found:
        return False
    parts = [p for p in _SAYS.split(bare) if p.strip()]
    declines = [any(x.search(p) for x in found) for p in parts]
    told = sum(len(p.split()) for p, no in zip(parts, declines, strict=True) if not no and len(p.split()) > 9)
    return any(declines) and told <= DESCRIBED * len(bare.split())


def copied(reference: list[str], answer: list[str]) -> bool:
    """At least three quarters of the reference's words in order, and nothing else but a lead-in or an odd word."""
    n, m = len(reference), len(answer)
    if not n or m < COPIED * n or m > n + LEAD_WORDS + ODD_WORDS:
        return False
    if sum((Counter(reference) & Counter(answer)).values()) < COPIED * n:
        return False
    spots: dict[str, list[int]] = {}
    for j, w in enumerate(answer):
        spots.setdefault(w, []).append(j)
    tops: list[int] = []
    for w in reference:
        for j in reversed(spots.get(w, ())):
            k = bisect_left(tops, j)
            if k == len(tops):
                tops.append(j)
            else:
                tops[k] = j
    same = len(tops)
    if same < COPIED * n:
        return False
    lead = next((k for k in range(min(m, LEAD_WORDS + 1)) if answer[k : k + 3] == reference[:3]), 0)
    return m - same - lead <= max(ODD_WORDS, m // 25)


def defect(reference: str | None, answer: str | None) -> str | None:
    """The defect that the pair shows by itself; a null or empty reference has no language and can't be copied."""
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if not is_empty(reference):
        asked, given = language(reference), language(answer)
        if asked and given and asked != given:
            return "wrong_language"
        asked_words = shingles.words(reference)
        lead, _, rest = answer.partition(":")
        # a lead-in of any length ends in a colon within its first sentence
        if copied(asked_words, shingles.words(answer)) or (rest and not _SAYS.search(lead) and copied(asked_words, shingles.words(rest))):
            return "copy"
    return None


def defective_pairs(pairs: DataFrame, corpus: DataFrame, ident: str, reference: str, answer: str, source: str) -> DataFrame:
    """(ident, defect) of the defective rows of pairs. corpus(text) are the texts that, with the answers, show how sentences end.

    Rows repeated under one id give one row, the first defect in the order above. No rows give none.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(r, a) for r, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "defect"])

    rows = pairs.select(F.col(ident).cast("string").alias("id"), F.col(reference).alias("reference"), F.col(answer).alias("answer"))
    shown = spread(rows).mapInArrow(judge, "id string, defect string").where("defect is not null")
    cuts = cut_texts(pairs.select(F.col(ident).cast("string").alias("id"), F.col(source).alias("source"), F.col(answer).alias("text")), corpus)
    both = shown.unionByName(cuts.where("cut").select("id", F.lit("truncated").alias("defect")))
    rank = F.array_position(F.array(*map(F.lit, ("empty", "refusal", "wrong_language", "copy", "truncated"))), F.col("defect"))
    first = both.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "defect")).alias("first"))
    return first.select(F.col("id").cast("long").alias(ident), F.col("first.defect").alias("defect"))
