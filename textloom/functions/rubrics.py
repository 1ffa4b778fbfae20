"""Keyword rubrics: presence scores, curation scores, flags, coverage and the caution-aware reward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import col, first_sentence, has_any, hits, sentences, word_count

# The banks of the presence scores.
SPATIAL = ("left", "right", "ahead", "behind", "above", "below", "near", "far", "meters", "feet", "distance", "position", "next to", "beside", "in front", "to your", "on your", "at approximately", "straight", "forward", "close", "nearby", "across", "steps away", "directly", "on the left", "on the right")
SOCIAL = ("person", "people", "someone", "man", "woman", "child", "individual", "walking toward", "approaching", "facing", "seated", "standing near", "figure", "human", "group", "crowd", "pedestrian", "user", "you")
ACTION = ("picks up", "walking", "sitting", "standing", "opens", "closes", "carries", "reaches", "bends", "turns", "moves", "steps", "places", "puts", "takes", "holds", "sets", "lifts", "pushes", "pulls", "reaches for", "grabs", "uses", "cooking", "eating", "running")
AMBIENCE = ("indoor", "outdoor", "kitchen", "bedroom", "living room", "street", "office", "hallway", "bathroom", "dining", "bright", "dim", "dark", "light", "morning", "evening", "room", "space", "area", "environment", "floor", "ceiling", "wall", "natural light", "artificial", "carpeted", "tiled", "wooden", "outside", "inside")
OBSTACLES = ("obstacle", "furniture", "table", "chair", "door", "wall", "step", "curb", "barrier", "counter", "desk", "sofa", "couch", "bed", "cabinet", "shelf", "stair", "column", "pillar", "railing", "fence", "appliance", "box", "bin")
STEP_CHANGES = ("step up", "step down", "stairs", "steps", "curb", "ramp", "uneven", "elevation", "threshold", "ledge", "staircase", "raised", "lowered", "slope", "gradient")
DIRECTIONS = ("left", "right", "straight", "forward", "behind", "turn", "head toward", "proceed", "continue", "go to", "move toward", "face", "clockwise", "counterclockwise", "bear left", "bear right")
MOVING_HAZARDS = ("moving", "approaching", "vehicle", "car", "bicycle", "bike", "coming toward", "walking toward", "running toward", "rushing", "swinging", "opening door", "closing door", "falling", "rolling")
DISTANCES = ("meters", "feet", "close", "nearby", "far", "approximately", "about", "distance", "roughly", "within", "less than", "more than", "steps away", "meters away", "a few")
CONTEXT_BANKS = {"spatial": SPATIAL, "social": SOCIAL, "action": ACTION, "ambience": AMBIENCE}
NAVIGATION_BANKS = {"obstacles": OBSTACLES, "step_changes": STEP_CHANGES, "directions": DIRECTIONS, "moving_hazards": MOVING_HAZARDS, "distances": DISTANCES}

# The word-bounded patterns of the coverage metrics.
COVERAGE = {
    "blv_spatial": (r"\bleft\b", r"\bright\b", r"\bahead\b", r"\bbehind\b", r"\bcenter\b", r"\bmeters?\b", r"\bsteps?\b", r"\bnear\b", r"\bfar\b"),
    "blv_social": (r"\bperson\b", r"\bpeople\b", r"\bman\b", r"\bwoman\b", r"\bchild\b", r"\bindividual\b", r"\bsomeone\b"),
    "blv_action": (r"\bwalking\b", r"\bstanding\b", r"\bmoving\b", r"\bsitting\b", r"\bholding\b", r"\bcarrying\b", r"\bpicking\b", r"\brunning\b"),
    "blv_ambience": (r"\bindoor\b", r"\boutdoor\b", r"\broom\b", r"\bhallway\b", r"\bkitchen\b", r"\bstreet\b", r"\bcorridor\b", r"\blighting\b"),
    "nav_obstacles": (r"\bobstacle\b", r"\bbox\b", r"\bchair\b", r"\btable\b", r"\bdoor\b", r"\bwall\b", r"\bobject\b", r"\bblocking\b", r"\bbarrier\b"),
    "nav_step_changes": (r"\bstair", r"\bstep\b", r"\bramp\b", r"\belevation\b", r"\bdown\b", r"\bup ahead\b", r"\bcurb\b"),
    "nav_directions": (r"\bleft\b", r"\bright\b", r"\bahead\b", r"\bstraight\b", r"\bbehind\b", r"\bturn\b"),
    "nav_moving_hazard": (r"\bmoving\b", r"\bapproaching\b", r"\bwalking toward\b", r"\bvehicle\b", r"\bperson moving\b", r"\bcoming\b"),
    "nav_distances": (r"\bmeters?\b", r"\bfoot\b", r"\bfeet\b", r"\bsteps away\b", r"\bapproximately\b", r"\bclose\b", r"\bnearby\b", r"\bnearby\s+\d", r"\d+\s*(?:meters?|feet|foot)"),
}

# The banks of the two curation scores.
ROOMS_1 = ("kitchen", "bedroom", "bathroom", "living room", "hallway", "corridor", "office", "outdoor", "street", "garden", "staircase")
SPATIAL_1 = ("left", "right", "ahead", "behind", "center", "near", "far", "beside", "above", "below")
HEIGHTS_1 = ("height", "waist", "knee", "shoulder")
HAZARDS_1 = ("hazard", "caution", "careful", "obstacle", "trip", "wet", "step", "slippery", "low", "sharp")
ROOMS_2 = ("kitchen", "bedroom", "bathroom", "living", "hallway", "corridor", "office", "dining", "outdoor", "street", "cafeteria", "gym")
SPATIAL_2 = ("left", "right", "ahead", "behind", "center", "near", "far", "front", "back", "side", "corner", "adjacent", "towards")
HEIGHTS_2 = ("height", "waist", "knee", "chest", "floor", "ceiling", "wall", "low", "high", "above", "below", "overhead")
HAZARDS_2 = ("hazard", "caution", "careful", "obstacle", "trip", "slip", "wet", "step", "edge", "slippery", "cautious")

# Phrases and rules of the flags.
INVENTED = ("warm atmosphere", "communal living", "familial", "exudes", "socialization", "suggests ", "appears to be", "seemingly", "reminiscent of", "implies", "evokes", "sense of", "feeling of", "mood of", "conveys", "symbolizes", "metaphor", "atmosphere")
GUIDELINES = (
    (r"\b(was|were|had been|looked like|seemed to)\b", "Past tense used (AD must be present tense)"),
    (r"\b(seemed happy|appeared (angry|sad|scared|excited)|felt |wanted to)\b", "Emotion/intent attributed to subject"),
    (r"\b(we see|camera (shows|pans|zooms)|visible in frame|in the (video|clip|scene|frame))\b", "Camera/viewer language used"),
    (r"\b(thinking|wondering|decided to|trying to|about to|planning to)\b", "Mind-reading language used"),
)
TOO_SHORT, TOO_LONG, REPEATED = "Too short (< 15 words)", "Too long (> 300 words)", "Repetitive sentences"

# The banks of the reward and of validity.
REWARD_DIRECTIONS = ("left", "right", "center", "ahead", "behind")
REWARD_PHRASES = ("no visible text", "i cannot", "i can't", "no text present", "appears to be", "seems to be", "it seems", "i think", "going about day to day", "sharp without any")
REWARD_PLACES = ("kitchen", "living room", "bedroom", "bathroom", "hallway", "corridor", "office", "garage", "garden", "outdoor", "indoor", "staircase", "dining", "waiting area")
VALID_SPATIAL = ("left", "right", "ahead", "front", "behind", "near", "far", "meter", "center", "forward")


def presence(c: Column | str, banks: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """A presence score for each bank and their mean."""
    dims = {name: has_any(c, bank) for name, bank in banks.items()}
    total = F.lit(0.0)
    for value in dims.values():
        total = total + value
    return dims | {"mean": total / F.lit(float(len(banks)))}


def coverage(c: Column | str) -> dict[str, Column]:
    """Whether any pattern of each metric matches, in any case; null matches none."""
    return {name: F.coalesce(col(c).rlike("(?i)(?:" + "|".join(patterns) + ")"), F.lit(False)) for name, patterns in COVERAGE.items()}


def _distinct_hits(c: Column, bank: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for word in bank:
        total = total + F.contains(F.lower(c), F.lit(word)).cast("int")
    return total


def curation_score_1(c: Column | str) -> Column:
    """0 to 100: room, places, distance or height, hazard, two to four full stops in at most 80 words."""
    c = col(c)
    lower = F.lower(c)
    stops, words = F.regexp_count(c, F.lit(r"\.")), word_count(c)
    return (
        F.when(has_any(c, ROOMS_1) > 0, 20).otherwise(0)
        + F.least(F.lit(20), 5 * _distinct_hits(c, SPATIAL_1))
        + F.when(lower.rlike(r"\d+\s*(meter|feet|foot|cm|step)"), 20).when(has_any(c, HEIGHTS_1) > 0, 10).otherwise(0)
        + F.when(has_any(c, HAZARDS_1) > 0, 20).otherwise(0)
        + F.when(stops.between(2, 4) & (words <= 80), 20).otherwise(0)
    )


def curation_score_2(c: Column | str) -> Column:
    """The second variant: other banks and units, two bands of sentences and words."""
    c = col(c)
    lower = F.lower(c)
    ends, words = F.regexp_count(c, F.lit(r"[.!?]")), word_count(c)
    return (
        F.when(has_any(c, ROOMS_2) > 0, 20).otherwise(0)
        + F.least(F.lit(20), 4 * _distinct_hits(c, SPATIAL_2))
        + F.when(lower.rlike(r"[0-9]+\s*(meter|feet|foot|inch|cm|step)"), 20).when(has_any(c, HEIGHTS_2) > 0, 10).otherwise(0)
        + F.when(has_any(c, HAZARDS_2) > 0, 20).otherwise(0)
        + F.when(ends.between(2, 5) & (words <= 100), 20).when((ends <= 8) & (words <= 160), 10).otherwise(0)
    )


def reward(generated: Column | str, reference: Column | str) -> Column:
    """Agreement on CAUTION, directions, distance, length, phrases that hedge, a place in the first sentence."""
    g, r = F.coalesce(col(generated), F.lit("")), F.coalesce(col(reference), F.lit(""))
    theirs, ours = F.contains(F.upper(r), F.lit("CAUTION")), F.contains(F.upper(g), F.lit("CAUTION"))
    parts = F.size(sentences(g))
    return (
        F.when(theirs & ours, 0.40).when(theirs, -0.30).when(ours, -0.10).otherwise(0.0)
        + F.least(_distinct_hits(g, REWARD_DIRECTIONS) * 0.08, F.lit(0.24))
        + F.when(F.lower(g).rlike(r"\d+(\.\d+)?\s*(meter|metre)"), 0.20).otherwise(0.0)
        + F.when(parts.between(2, 4), 0.16).when(parts > 6, -0.10).otherwise(0.0)
        + F.when(has_any(g, REWARD_PHRASES) > 0, -0.20).otherwise(0.0)
        + F.when(has_any(first_sentence(g), REWARD_PLACES) > 0, 0.10).otherwise(0.0)
    )


def length_flag(c: Column | str) -> Column:
    words = word_count(c)
    return F.when(words < 15, TOO_SHORT).when(words > 300, TOO_LONG)


def flags(c: Column | str, score: Column | str, least: int = 40, repeated: Column | None = None) -> Column:
    """The messages of all failed checks, in fixed order: length, score, invented phrases, repetition, guidelines."""
    c, score = col(c), col(score)
    found = hits(c, INVENTED)
    checks = [length_flag(c), F.when(score < least, F.concat(F.lit("Low BLV score: "), score.cast("string"))), F.when(F.size(found) > 0, F.concat(F.lit("Hallucination phrases: "), F.array_join(found, ", ")))]
    if repeated is not None:
        checks.append(F.when(repeated, REPEATED))
    checks += [F.when(F.lower(c).rlike(pattern), message) for pattern, message in GUIDELINES]
    return F.array_compact(F.array(*checks))


def band(pct: Column | str) -> Column:
    return F.when(col(pct) >= 90, "high").when(col(pct) >= 50, "mid").otherwise("low")


def loss_verdict(loss: Column | str) -> Column:
    """Bands of a loss; between 1 and 2 there is no verdict."""
    x = col(loss)
    return F.when(x < 1, "overfit").when(x.between(2, 4), "go").when((x > 4) & (x <= 8), "weak").when(x > 8, "stop")


def valid_chosen(c: Column | str) -> Column:
    from textloom.functions.text import py_strip

    return F.coalesce((F.length(py_strip(c)) >= 30) & (has_any(c, VALID_SPATIAL) > 0), F.lit(False))


def valid_rejected(c: Column | str) -> Column:
    from textloom.functions.text import py_strip

    s = py_strip(c)
    return F.coalesce((F.length(s) >= 3) & ~(s.startswith("c0") & (F.length(s) < 10)), F.lit(False))
