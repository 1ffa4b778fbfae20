"""Problem 8: personal details in free text, by a skip-chain conditional random field.

Nodes are the tokens that may be part of a name, numbers, and what has the form of an e-mail or postal address; their
labels are other, person, phone, id_number, email and address. A linear chain ties neighbouring name tokens; skip edges
tie each similar token, number or form in a document to the one before it (whatever case, accents, possessive endings and
separators it has), so that a plain mention of a name follows the one whose context gives it away. Loopy belief
propagation gives each node's marginals.

The weights of the name features, of chain edges and of skip edges are fitted by likelihood (the chains' exactly, skip edges
given these) on a bounded sample of documents (SAMPLE_DOCS, by hash of the id, texts of up to SAMPLE_CHARS characters)
whose labels come from the list of name parts; each token is learned twice, once with the list's features hidden, so that names missing from the list
are told by their context in any language. Numbers and forms, of which there are no labelled examples, have fixed
potentials for shapes and label words. Which words are common
ones and which street words carry a dot is counted over all documents. Everything is then applied to whole texts of all
documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage, spread

#: Documents on which weights are fitted, and rounds of fitting and of message passing.
SAMPLE_DOCS, SAMPLE_CHARS = 12_000, 20_000
EPOCHS, ROUNDS = 6, 8
FEATURE_BITS = 15
LABELS = ("other", "person", "phone", "id_number", "email", "address")
#: Potential of what has the form of an e-mail or postal address.
FORM = 6.0

# Titles, which are no part of a name.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "dame", "sr", "sra", "srta", "don", "doña", "dra", "mme", "mlle", "herr", "frau", "dom", "dona", "senhor", "senhora", "señor", "señora", "monsieur", "madame", "श्री", "श्रीमती"}
# Words for at and dot when an address is spelled out.
_AT = r"(?:\s*[\(\[{<]\s*(?:at|arroba|ät|@)\s*[\)\]}>]\s*|\s*@\s*|\s+(?:at|arroba|AT)\s+)"
_DOT = r"(?:\s*[\(\[{<]\s*(?:dot|punto|point|punkt|ponto|\.)\s*[\)\]}>]\s*|\s+(?:dot|punto|point|punkt|ponto|DOT)\s+|\.)"
EMAIL = re.compile(
    rf"(?<![\w.@/+\-])[A-Za-z0-9][\w.+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}}(?![\w/@\-])"
    rf"|(?<![\w.@/+\-])[A-Za-z0-9][\w.+\-]*(?:(?:\s+dot\s+|\s*\[dot\]\s*|\s*\(dot\)\s*)[\w+\-]+)*{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*?{_DOT}[A-Za-z]{{2,}}(?:(?:\s+dot\s+|\s*\[dot\]\s*|\s*\(dot\)\s*)[A-Za-z]{{2,}})*(?![\w/@\-])",
    re.I,
)

# Kinds of streets.
_EN_STREET = r"Street|Str|St|Avenue|Ave|Av|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Close|Terrace|Ter|Way|Place|Pl|Square|Sq|Crescent|Cres|Grove|Gardens|Row|Walk|Mews|Hill|Parade|Highway|Hwy|Parkway|Pkwy|Circle|Cir|Trail|Alley|Quay|Rise|Vale|View|Green|Park|Path|Broadway|Loop"
_FR_STREET = r"rue|avenue|av\.|boulevard|bd\.?|chemin|impasse|allée|place|quai|cours|passage|square|route|sentier|faubourg|venelle|ruelle|villa|cité|esplanade|promenade|montée|voie"
_ES_STREET = r"Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carrera|Travesía|Ronda|Callejón|Glorieta|Cuesta|Rambla|Rua|R\.|Travessa|Praça|Largo|Alameda|Estrada|Beco|Calçada|Rodovia|Via|Viale|Piazza|Corso|Vicolo"
_DE_STREET = r"straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm|steig|graben|hof|markt|pfad|stieg|zeile|chaussee|promenade|winkel|kamp|berg|twiete"
_NO = r"\d{1,5}(?:[ \-]?[A-Za-z](?![\w'’])|(?:[ ]?(?:bis|ter|quater))(?!\w)|[/\-]\d{1,4}[A-Za-z]?(?!\w))?"
_CAP = r"(?:[A-ZÀ-ÞŁŠŽ][\w'’\-]*|\d{1,3}(?:st|nd|rd|th))"
ADDRESS = re.compile(
    rf"(?<![\w.,\-/:#])(?P<en>{_NO},? (?:(?:[NSEW]\.?|North|South|East|West|Old|New|Upper|Lower|Great|Little|The|St\.?) )?(?:{_CAP} ){{1,4}}?(?P<abbr>{_EN_STREET})(?!\w))(?P<dot>\.?)"
    rf"|(?<![\w.\-/:#])(?P<fr>{_NO},? (?i:{_FR_STREET}) (?:(?:de|du|des|la|le|les|aux|au|à|en|sur|sous|saint|sainte)(?: |-)|[dl]['’])*{_CAP}(?:(?:[ \-](?:de|du|des|la|le|les|et|[dl]['’]))*[ \-]?{_CAP}){{0,4}})"
    rf"|(?<!\w)(?P<es>(?i:{_ES_STREET}) ?(?:(?:de|del|de la|de las|de los|do|da|dos|das|la|las|los|el|di|della|dei) )*{_CAP}(?: (?:(?:de|del|la|las|los|y|e|do|da|dos|das) )*{_CAP}){{0,4}},? (?:n[.º°o]+ ?)?{_NO})"
    rf"|(?<!\w)(?P<de>(?:{_CAP}[ \-])?[A-ZÄÖÜ][\w\-]*(?i:{_DE_STREET})(?:e)? {_NO}|(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf der|Auf dem|Unter den|Unter der|Beim|Hinter der|Vor dem) [A-ZÄÖÜ][\w\-]+(?: [A-ZÄÖÜ][\w\-]+)? {_NO})"
)
_HOUSE_END = re.compile(r"(?<=\d)[ \-]([A-Za-z])$")

# Shapes of numbers. (?!...) keeps longer numbers, decimals and times out.
_B, _E = r"(?<![\w@/+#.,:\-])", r"(?![\w@#:]|[.,/\-]\d)"
PHONE_SHAPES = (
    (re.compile(_B + r"\+\d{1,3}[ .\-]?(?:\(0?\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-/]?\d{2,4}){1,5}" + _E), 4.0),
    (re.compile(_B + r"\(\+?\d{1,5}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}" + _E), 4.0),
    (re.compile(_B + r"00\d{0,3}[ .\-]\d{2,4}(?:[ .\-/]?\d{2,4}){1,4}" + _E), 3.0),
    (re.compile(_B + r"(?:1[ .\-])?\d{3}([ .\-])\d{3}\1\d{4}" + _E), 3.0),
    (re.compile(_B + r"0\d(?:([ .\-])\d{2})(?:\1\d{2}){3}" + _E), 3.0),
    (re.compile(_B + r"0\d{2,5}[ /\-]\d{3,8}(?:[ \-]\d{2,4}){0,2}" + _E), 2.5),
    (re.compile(_B + r"0\d{9,10}" + _E), 1.0),
    (re.compile(_B + r"[1-9]\d{9,10}" + _E), -1.0),
    (re.compile(_B + r"\d{5} \d{5,6}" + _E), 0.0),
    (re.compile(_B + r"\d{3,4}([ .\-])\d{3,4}(?:\1\d{3,4})?" + _E), -1.5),
    (re.compile(_B + r"\d{2,3}(?: \d{2,3}){3,4}" + _E), -0.5),
)
ID_SHAPES = (
    (re.compile(_B + r"[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]" + _E), 3.0),
    (re.compile(_B + r"\d \d{2} \d{2} \d[\dAB] \d{3} \d{3} \d{2}" + _E), 3.0),
    (re.compile(_B + r"\d{3}-\d{2}-\d{4}" + _E), 2.5),
    (re.compile(_B + r"\d{3}\.\d{3}\.\d{3}-\d{2}" + _E), 2.5),
    (re.compile(_B + r"\d{3} \d{2} \d{4}" + _E), 1.0),
    (re.compile(_B + r"\d{8}-?[A-Z]" + _E), 1.5),
    (re.compile(_B + r"[XYZ]-?\d{7}-?[A-Z]" + _E), 1.5),
    (re.compile(_B + r"\d{4} \d{4} \d{4}(?: \d{4})?" + _E), 0.5),
    (re.compile(_B + r"[A-Z]{1,3}-?\d{6,9}[A-Z]?" + _E), -0.5),
    (re.compile(_B + r"\d{2,6}(?:[ .\-/]\d{2,6}){1,5}" + _E), -3.0),
    (re.compile(_B + r"\d{6,15}" + _E), -2.0),
    (re.compile(_B + r"[A-Z0-9]{6,14}" + _E), -4.0),
)
# Words that label numbers, next before them.
ID_WORDS = re.compile(r"(?:national (?:id|insurance)|identity|identification|\bid\b|social security|\bssn\b|\bnino\b|passport|\btax\b|taxpayer|\btin\b|personal (?:no|number|id|code)|licen[cs]e|\bdni\b|\bnie\b|\bnif\b|\bcurp\b|\bcuit\b|seguridad social|identidad|pasaporte|cédula|identité|\bcni\b|\bnir\b|sécurité sociale|passeport|fiscal|ausweis\w*|reisepass\w*|steuer\w*|sozialversicherung\w*|\bcpf\b|\brg\b|\bnis\b|cidadão|identidade|passaporte|contribuinte|segurança social|पहचान|आधार|पासपोर्ट|पैन|codice fiscale|\bbsn\b|\bpan\b|aadhaar)[^\d\n]{0,28}$", re.I)
PHONE_WORDS = re.compile(r"(?:phone|\btel\b|mobile|\bcell\b|\bcall\b|\bring\b|\bdial\b|\btext\b|whatsapp|\breach\w*|my number|number is|\bfax\b|\bsms\b|tel[eé]fono|móvil|\bllam\w+|téléphone|\bappel\w+|portable|numéro|telefon\w*|handy|nummer|\brufen?\b|anruf\w*|telefone|celular|telemóvel|\blig\w+|número|फोन|फ़ोन|मोबाइल|नंबर|कॉल)[^\d\n]{0,28}$", re.I)
OTHER_WORDS = re.compile(r"(?:ticket|order|serial|\bsn\b|\bclip\b|seed|version|build|checkpoint|score|frames?|\bstep\b|batch|\btck\b|commit|\bport\b|video|\bitem\b|invoice|isbn|counter|loss|tokens?|\brows?\b|\bids? already|release|model|\bkf\b)[^\d\n]{0,20}$", re.I)

_TOKEN = re.compile(r"[^\W\d_]\.(?![^\W\d_])|[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_GAP = re.compile(r"[ \u00a0]{1,2}|, ?")
_SENTENCE_START = re.compile(r"(?:^|[.!?।:;\n>\-–—\"“”(\[•*]\s*)$")


@lru_cache(maxsize=200_000)
def _fold(word: str) -> str:
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))


_STREET_WORDS = {w.casefold() for w in _EN_STREET.split("|") if len(w) > 2} | {"bridge", "station", "fair", "test", "church", "school", "hospital", "hotel", "museum", "market"}
#: Potential against a name part that is no listed one but a word that the documents write in lower case.
COMMON_WORD = -20.0
#: Share of its uses in lower case from which a word counts as common; names, too, are at times written so.
COMMON_SHARE = 0.15
#: Uses in lower case from which a word counts as common.
COMMON_USES = 3
_LOWER, _CAPITAL = re.compile(r"(?<![^\W\d_])[^\W\d_A-ZÀ-Þ]{2,}(?![^\W\d_])"), re.compile(r"(?<![^\W\d_])[A-ZÀ-Þ][^\W\d_]+")
_STREET_DOT = re.compile(rf"\d\S* (?:{_CAP} ){{1,3}}({_EN_STREET})(\.?)(?:,| [a-z])")


#: Without one of these a text holds no e-mail address: a sign, a dot before a letter or in brackets, a dot spelled out.
_MAY_MAIL = re.compile(r"@|\w\.[A-Za-z]|[(\[{<]\s*\.|dot|punto|point|punkt|ponto", re.I)
#: Six digits near each other, without which a text holds no personal number.
_MAY_NUMBER = re.compile(r"\d(?:[^\d\n]{0,3}\d){5,}")
#: Characters before and after such digits that may belong to a number.
_BEFORE, _AFTER_DIGITS = 24, 24
_DIGIT = re.compile(r"\d")


class Names:
    """The list of name parts, and the words that the documents write in lower case."""

    def __init__(self, given: set[str], family: set[str], common: set[str]) -> None:
        self.given, self.family, self.common = given, family, common
        self.seen: dict[str, bool] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def may_be_part(self, token: str) -> bool:
        """Whether a token may be part of a name; kept for each token, begun anew when there are many."""
        may = self.seen.get(token)
        if may is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            fold = _fold(token)
            listed = fold in self.given or fold in self.family or (len(fold) > 2 and token.isalpha() and token.islower() and fold not in self.common)
            may = self.seen[token] = not (fold.rstrip(".") in TITLES or len(token) == 1 or not (token[0].isupper() or listed) or (token.endswith(".") and not token[0].isupper()))
        return may


def _masked(text: str, dotted: set[str]) -> tuple[list[tuple[str, str, int, int]], str]:
    """The e-mail and postal addresses of a text, and the text with these blanked."""
    found, chars = [], None
    for match in EMAIL.finditer(text) if _MAY_MAIL.search(text) else ():
        found.append(("email", match[0], match.start(), match.end()))
    bare = text
    if found:
        chars = list(text)
        for _, _, a, b in found:
            chars[a:b] = "\x00" * (b - a)
        bare = "".join(chars)
    spots = []
    for match in ADDRESS.finditer(bare) if _DIGIT.search(bare) else ():
        a, b = match.span()
        if match["en"]:
            b = match.end("en")
            if match["dot"] and (match["abbr"].casefold() in dotted or bare[match.end("dot") : match.end("dot") + 1] in (".", ",")):
                b = match.end("dot")
            if match["abbr"][0].islower():
                continue
        value = bare[a:b]
        spots.append(("address", value, a, b))
    if spots:
        chars = list(bare)
        for _, _, a, b in spots:
            chars[a:b] = "\x00" * (b - a)
        bare = "".join(chars)
    return found + spots, bare


def _numbers(bare: str) -> list[tuple[int, int, list[float]]]:
    """(begin, end, potentials) of the numbers that may be personal, the longest of those that overlap."""
    places: list[list[int]] = []
    for near in _MAY_NUMBER.finditer(bare):
        if places and near.start() - _BEFORE <= places[-1][1]:
            places[-1][1] = near.end() + _AFTER_DIGITS
        else:
            places.append([max(0, near.start() - _BEFORE), near.end() + _AFTER_DIGITS])
    spots: dict[tuple[int, int], list[float]] = {}
    for place, shapes in ((2, PHONE_SHAPES), (3, ID_SHAPES)):
        for shape, weight in shapes:
            for match in (m for lo, hi in places for m in shape.finditer(bare, lo, hi)):
                digits = sum(map(str.isdigit, match[0]))
                if 6 <= digits <= 16 and (place == 3 or 7 <= digits <= 15):
                    scores = spots.setdefault(match.span(), [0.0, -math.inf, -math.inf, -math.inf])
                    scores[place] = max(scores[place], weight)
    rows = []
    for (a, b), scores in spots.items():
        before = bare[max(0, a - 60) : a]
        if OTHER_WORDS.search(before):
            scores[2], scores[3] = scores[2] - 5, scores[3] - 6
        if ID_WORDS.search(before):
            scores[2], scores[3] = scores[2] - 5, scores[3] + 5.5
        elif PHONE_WORDS.search(before):
            scores[2], scores[3] = scores[2] + 3.5, scores[3] - 4
        else:
            scores[2], scores[3] = scores[2] - 1.5, scores[3] - 1.5
        rows.append((a, b, scores))
    rows.sort(key=lambda r: (r[0] - r[1], -max(r[2][2:])))
    taken, out = [], []
    for a, b, scores in rows:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((a, b, scores))
    return sorted(out)


def _chains(bare: str, names: Names) -> list[list[tuple[int, int, str]]]:
    """Runs of neighbouring tokens that may be names, at least two each, one of them more than an initial."""
    chains, run = [], []

    def close() -> None:
        if len(run) > 1 and any(len(t) > 2 for _, _, t in run):
            chains.append(list(run))
        run.clear()

    for match in _TOKEN.finditer(bare):
        token = match[0]
        if not names.may_be_part(token):
            if run:
                close()
            continue
        if run and not _GAP.fullmatch(bare[run[-1][1] : match.start()]):
            close()
        run.append((match.start(), match.end(), token))
    close()
    out = []
    for chain in chains:
        shouted = sum(t.isupper() for _, _, t in chain) > 6
        lower = [t[0].islower() for _, _, t in chain]
        if shouted or any(lower):  # case says nothing here: only pairs of listed parts and their neighbours
            part: list[tuple[int, int, str]] = []
            for node in [*chain, (0, 0, "")]:
                fold = _fold(node[2])
                if node[2] and (fold in names.given or fold in names.family or (len(fold) > 2 and fold not in names.common) or re.fullmatch(r"[^\W\d_]\.", node[2]) or (not shouted and node[2][0].isupper())):
                    part.append(node)
                else:
                    if len(part) > 1:
                        out.append(part)
                    part = []
        else:
            out.append(chain)
    return out


def _hashed(*parts: str) -> int:
    return zlib.crc32("|".join(parts).encode()) & ((1 << FEATURE_BITS) - 1)


def _token_features(bare: str, chain: list[tuple[int, int, str]], names: Names, hide: bool) -> list[list[int]]:
    before = [w.casefold() for w in re.findall(r"[^\W\d_]+|[:,(<>\"\n]", bare[max(0, chain[0][0] - 40) : chain[0][0]])[-2:]]
    after = [w.casefold() for w in re.findall(r"[^\W\d_]+|[.:,;)<>\"\n?!]", bare[chain[-1][1] : chain[-1][1] + 30])[:2]]
    p1, p2 = (before[-1] if before else "^"), (before[-2] if len(before) > 1 else "^")
    a1, a2 = (after[0] if after else "$"), (after[1] if len(after) > 1 else "$")
    n, rows = len(chain), []
    folds = [_fold(t) for _, _, t in chain]
    for i, (begin, _, token) in enumerate(chain):
        fold = folds[i]
        given, family = (fold in names.given, fold in names.family) if not hide else (False, False)
        common = fold in names.common
        shape = "init" if token.endswith(".") else "lower" if token[0].islower() else "upper" if token.isupper() and len(token) > 1 else "title"
        start = bool(_SENTENCE_START.search(bare[max(0, begin - 3) : begin]))
        kind = ("g" if given else "") + ("f" if family else "") + ("c" if common else "") or "u"
        parts = [("bias",), ("kind", kind), ("shape", shape), ("kind+shape", kind, shape), ("place", str(min(i, 3)), str(min(n, 5))), ("start", str(start), "c" if common else "n")]
        if i == 0:
            parts += [("p1", p1), ("p2", p2, p1), ("p1c", p1, "c" if common else "n")]
        else:
            left = folds[i - 1]
            parts += [("left", "init" if left.endswith(".") else "c" if left in names.common else "n"), ("leftlist", str(not hide and (left in names.given or left in names.family)))]
            parts += [("cp1", p1, "c" if common else "n", "c" if folds[0] in names.common else "n")]
        if i == n - 1:
            parts += [("a1", a1), ("a2", a1, a2), ("a1c", a1, "c" if common else "n")]
        else:
            right = folds[i + 1]
            parts += [("right", "init" if right.endswith(".") else "c" if right in names.common else "n"), ("rightlist", str(not hide and (right in names.given or right in names.family)))]
            parts += [("rightword", right if right in names.common else "street" if right in _STREET_WORDS else "n")]
        parts += [("street", str(fold in _STREET_WORDS), str(i), str(n))]
        rows.append([_hashed(*p) for p in parts])
    return rows


def _distant(chain: list[tuple[int, int, str]], names: Names) -> list[bool]:
    """Labels by the list: parts of a given and a family name side by side, at least one of them sure (no common word, or
    next to an initial or the other kind of part); an unknown capitalised neighbour of a sure part belongs to the name."""
    folds = [_fold(t) for _, _, t in chain]
    listed = [f in names.given or f in names.family for f in folds]
    streets = [f in _STREET_WORDS for f in folds]
    place = [any(streets[i : i + 3]) and not (i and listed[i - 1] and not streets[i - 1] and streets[i] and listed[i]) for i in range(len(folds))]
    given, initial = [f in names.given for f in folds], [t.endswith(".") for _, _, t in chain]
    pair = [listed[i] and any(0 <= j < len(folds) and (initial[j] and j < i or listed[j] and given[i] != given[j]) for j in (i - 1, i + 1)) for i in range(len(folds))]
    sure = [ok and (f not in names.common or two) and not p for ok, f, p, two in zip(listed, folds, place, pair, strict=True)]
    may = [ok or t.endswith(".") or f not in names.common for ok, f, (_, _, t) in zip(listed, folds, chain, strict=True)]
    out = [False] * len(chain)
    for i in range(len(chain)):
        if sure[i]:
            for j in (i - 1, i + 1):
                if 0 <= j < len(chain) and may[j]:
                    out[i] = out[j] = True
                    k = 2 * j - i
                    if chain[j][2].endswith(".") and 0 <= k < len(chain) and may[k]:
                        out[k] = True
    return out


class Model:
    """Weights of token features, of neighbouring and of repeated labels, and the street words that carry a dot."""

    def __init__(self, weights: np.ndarray, near: np.ndarray, again: float, dotted: set[str]) -> None:
        self.weights, self.near, self.again, self.dotted = weights, near, again, dotted


def word_counts(docs: DataFrame) -> tuple[set[str], set[str]]:
    """Of all docs(id, text): the common words, folded, and the street words that carry a dot more often than not."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {kind: Counter() for kind in ("lower", "capital", "dot", "plain")}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(kind, word, _fold(word) if kind == "lower" else word, n) for kind, own in seen.items() for word, n in own.items()]
            for own in seen.values():
                own.clear()
            for lo in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[lo : lo + 50_000], strict=True)], ["kind", "word", "fold", "n"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                _, bare = _masked(text, set())
                seen["lower"].update(_LOWER.findall(bare))
                seen["capital"].update(map(_fold, _CAPITAL.findall(bare)))
                for m in _STREET_DOT.finditer(text) if _DIGIT.search(text) else ():
                    seen["dot" if m[2] else "plain"][m[1].casefold()] += 1
                if sum(map(len, seen.values())) > 500_000:
                    yield from out()
        yield from out()

    rows = docs.where("text <> ''").mapInArrow(count, "kind string, word string, fold string, n long")
    counts = cut_lineage(rows.groupBy("kind", "word", "fold").agg(F.sum("n").alias("n")))
    capital = counts.where("kind = 'capital'").select("fold", F.col("n").alias("capital"))
    lower = counts.where(f"kind = 'lower' and n >= {COMMON_USES}").join(capital, "fold", "left").fillna(0, ["capital"])
    common = lower.where(F.col("n") >= F.lit(COMMON_SHARE) * (F.col("n") + F.col("capital"))).select("fold").distinct()
    marks = {(r["word"], r["kind"]): r["n"] for r in counts.where("kind in ('dot', 'plain')").collect()}  # a fixed list of street words
    return {r["fold"] for r in common.toLocalIterator()}, {w for w, _ in marks if marks.get((w, "dot"), 0) > marks.get((w, "plain"), 0)}


def _tie(token: str) -> str:
    """What similar tokens share: whatever case, accents and possessive ending they have."""
    return re.sub(r"['’]s$|['’]$", "", _fold(token))


def _forward_backward(score: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains of one length with score[chain, place] for a name against none, and near[label, label] for neighbours: the
    chance of a name at each place, and that of each pair of labels of neighbours (place, label, label)."""
    n, length = score.shape
    own = np.stack([np.zeros_like(score), score], axis=2)
    ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    ahead[:, 0] = own[:, 0]
    for i in range(1, length):
        ahead[:, i] = np.logaddexp(ahead[:, i - 1, :1] + near[0], ahead[:, i - 1, 1:] + near[1]) + own[:, i]
    for i in range(length - 2, -1, -1):
        after = own[:, i + 1] + behind[:, i + 1]
        behind[:, i] = np.logaddexp(after[:, :1] + near[:, 0], after[:, 1:] + near[:, 1])
    whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
    one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - whole)
    pairs = np.exp(ahead[:, :-1, :, None] + near + (own + behind)[:, 1:, None, :] - whole[:, :, None, None])
    return one, pairs


def fit(texts: list[str], names: Names, dotted: set[str]) -> Model:
    """Weights of the features of name tokens and of chain edges, fitted together by the likelihood of the chains' labels by
    the list; then that of skip edges, by the likelihood of each label given its chain and those it is tied to."""
    by_length: dict[int, list[tuple[list[list[int]], list[bool], list[int]]]] = {}
    for text in texts:
        _, bare = _masked(text, set())
        chains = _chains(bare, names)
        own = [_distant(chain, names) for chain in chains]
        before: dict[str, bool] = {}
        for chain, y in zip(chains, own, strict=True):
            tied = [0 if len(t) < 3 or _tie(t) not in before else 1 if before[_tie(t)] else -1 for _, _, t in chain]
            before.update((_tie(t), label) for (_, _, t), label in zip(chain, y, strict=True))
            for hide in (False, True):
                by_length.setdefault(len(chain), []).append((_token_features(bare, chain, names, hide), y, tied))
    weights, near, again = np.zeros(1 << FEATURE_BITS), np.zeros((2, 2)), 0.0
    groups = []
    for rows in by_length.values():
        width = max(len(f) for features, _, _ in rows for f in features)
        index = np.array([[f + [-1] * (width - len(f)) for f in features] for features, _, _ in rows])
        groups.append((np.where(index >= 0, index, 0), index >= 0, np.array([y for _, y, _ in rows], float), np.array([tied for _, _, tied in rows], float)))
    order, squares, near_squares = np.random.default_rng(0), np.full(len(weights), 1e-6), np.full((2, 2), 1e-6)
    batches = [(g, part) for g, (_, _, y, _) in enumerate(groups) for part in np.array_split(np.arange(len(y)), max(1, y.size // 256))]
    mixed = [order.permutation(len(y)) for _, _, y, _ in groups]
    for _ in range(EPOCHS):
        for k in order.permutation(len(batches)):
            g, part = batches[k]
            index, used, y = (x[mixed[g][part]] for x in groups[g][:3])
            one, pairs = _forward_backward((weights[index] * used).sum(axis=2), near)
            off = one - y
            spots, back = np.unique(index[used], return_inverse=True)
            grad = np.bincount(back, np.broadcast_to(off[:, :, None], used.shape)[used]) / y.size + 1e-5 * weights[spots]
            squares[spots] += grad**2
            weights[spots] -= 0.3 * grad / np.sqrt(squares[spots])
            label = y.astype(int)
            seen = np.array([[np.sum((label[:, :-1] == i) & (label[:, 1:] == j)) for j in (0, 1)] for i in (0, 1)])
            grad = (pairs.sum(axis=(0, 1)) - seen) / y.size + 1e-5 * near
            near_squares += grad**2
            near = np.clip(near - 0.1 * grad / np.sqrt(near_squares), -3, 3)
    odds, ties, labels = [], [], []
    for index, used, y, tied in groups:
        one = np.clip(_forward_backward((weights[index] * used).sum(axis=2), near)[0], 1e-9, 1 - 1e-9)
        odds.append(np.log(one / (1 - one))[tied != 0]), ties.append(tied[tied != 0]), labels.append(y[tied != 0])
    if groups and sum(map(len, odds)):
        m, t, y = (np.concatenate(x) for x in (odds, ties, labels))
        for _ in range(100):
            again = min(2.0, max(0.0, again - 0.2 * float(np.mean((1 / (1 + np.exp(-np.clip(m + again * t, -30, 30))) - y) * t)) * 10))
    return Model(weights, near, again, dotted)


def _marginals(unary: list[list[float]], edges: list[tuple[int, int, str]], model: Model) -> np.ndarray:
    """Loopy belief propagation, damped; a row of label probabilities per node."""
    score = np.array(unary)
    score = np.where(np.isfinite(score), score, -50.0)
    if edges:
        size = len(LABELS)
        near = np.zeros((size, size))
        near[:2, :2] = model.near
        again = model.again * np.eye(size)
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        table = np.array([near if e[2] == "near" else again for e in edges])
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(source), size))
        for _ in range(ROUNDS):
            belief = score.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + table
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        score = score.copy()
        np.add.at(score, target, message)
    score -= score.max(axis=1, keepdims=True)
    share = np.exp(score)
    return share / share.sum(axis=1, keepdims=True)


def _persons(bare: str, chain: list[tuple[int, int, str]], is_name: list[bool], names: Names) -> Iterator[tuple[int, int]]:
    """Spans of names: neighbouring name tokens, a comma only after a family name that stands first (a listed one, if what
    follows is a given and a family name by itself)."""
    run: list[tuple[int, int, str]] = []
    commas: list[int] = []

    def spans() -> Iterator[tuple[int, int]]:
        parts, begin = [], 0
        for c in [*commas, len(run)]:
            parts.append(run[begin:c])
            begin = c
        i = 0
        while i < len(parts):
            part = parts[i]
            after = parts[i + 1] if i + 1 < len(parts) else []
            alone = len(after) > 1 and _fold(after[-1][2]) in names.family and _fold(part[0][2]) not in names.family
            if len(part) == 1 and after and len(part[0][2]) > 2 and len(after) <= 3 and not alone:
                part = part + parts[i + 1]
                i += 1
            if len(part) > 1 and any(len(t) > 2 for _, _, t in part):
                yield part[0][0], part[-1][1]
            i += 1

    for node, name in zip([*chain, None], [*is_name, False], strict=True):
        if name:
            if run and "," in bare[run[-1][1] : node[0]]:
                commas.append(len(run))
            run.append(node)
        else:
            if run:
                yield from spans()
            run, commas = [], []


def find(text: str, model: Model, names: Names) -> list[tuple[str, str, int, int]]:
    """(kind, value, begin, end) of the personal details of a text, in order."""
    formed, bare = _masked(text, model.dotted)
    chains, numbers = _chains(bare, names), _numbers(bare)
    if not formed and not chains and not numbers:
        return []
    unary: list[list[float]] = []
    edges: list[tuple[int, int, str]] = []
    seen: dict[str, int] = {}
    none = -50.0

    def node(scores: list[float], key: str) -> None:
        if key in seen:
            edges.append((seen[key], len(unary), "again"))
        seen[key] = len(unary)
        unary.append(scores)

    for chain in chains:
        for i, ((_, _, token), features) in enumerate(zip(chain, _token_features(bare, chain, names, False), strict=True)):
            if i:
                edges.append((len(unary) - 1, len(unary), "near"))
            fold = _fold(token)
            common = COMMON_WORD if fold in names.common and fold not in names.given and fold not in names.family else 0.0
            node([0.0, float(model.weights[features].sum()) + common, none, none, none, none], _tie(token) if len(token) > 2 else f"{len(unary)}.")
    for a, b, scores in numbers:
        node([0.0, none, *scores[2:], none, none], "#" + re.sub(r"\W", "", bare[a:b]))
    for kind, value, _, _ in formed:
        node([0.0, none, none, none, *(FORM if kind == label else none for label in LABELS[4:])], kind + _fold(value))
    label, at, found = _marginals(unary, edges, model).argmax(axis=1), 0, []
    for chain in chains:
        for a, b in _persons(bare, chain, [bool(x == 1) for x in label[at : at + len(chain)]], names):
            found.append(("person", text[a:b], a, b))
        at += len(chain)
    spots = [(a, b) for a, b, _ in numbers] + [(a, b) for _, _, a, b in formed]
    found += [(LABELS[which], text[a:b], a, b) for (a, b), which in zip(spots, label[at:], strict=True) if which > 1]
    return sorted(found, key=lambda f: f[2])


def redact(text: str, found: list[tuple[str, str, int, int]]) -> str:
    out, at = [], 0
    for kind, _, a, b in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def _applied(docs: DataFrame, names: DataFrame, ident: str, text: str, redacted: bool, sample_docs: int) -> DataFrame:
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null"))
    listed = names.where("name_part is not null").select("name_part", "kind").distinct().collect()  # a fixed list of name parts
    given = {_fold(r["name_part"]) for r in listed if r["kind"] == "given"}
    family = {_fold(r["name_part"]) for r in listed if r["kind"] == "family"}
    sample = [r["text"] for r in rows.where(F.length("text").between(1, SAMPLE_CHARS)).orderBy(F.xxhash64("id"), "id").limit(sample_docs).collect()]
    common, dotted = word_counts(rows)
    known_names = Names(given, family, common)
    held = spark.sparkContext.broadcast((fit(sample, known_names, dotted), known_names))

    def details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = held.value
        for batch in batches:
            out, judged = [], {}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t not in judged:  # repeated texts once a batch
                    judged[t] = list(dict.fromkeys((kind, value) for kind, value, _, _ in find(t, model, known))) if t else []
                out += [(i, *told) for told in judged[t]]
            ids, kinds, values = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["id", "kind", "value"])

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = held.value
        for batch in batches:
            texts = [redact(t, find(t, model, known)) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    if redacted:
        return rows.mapInArrow(replaced, "id long, text string").withColumnsRenamed({"id": ident, "text": text})
    return rows.where("text <> ''").mapInArrow(details, "id long, kind string, value string").distinct().withColumnRenamed("id", ident)


def personal_details(docs: DataFrame, names: DataFrame, ident: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(ident, kind, value): the distinct personal details of each document, as they stand in it.

    Null and empty texts have none; rows repeated under one id count once. An empty list of names leaves names that only
    their context shows to a model without examples, so none are found; the other kinds don't depend on it.
    """
    return _applied(docs, names, ident, text, False, sample_docs)


def redacted_texts(docs: DataFrame, names: DataFrame, ident: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(ident, text) of every row, each personal detail replaced by its kind in brackets; null and empty texts stay."""
    return _applied(docs, names, ident, text, True, sample_docs)
