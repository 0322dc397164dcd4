"""Claim governance: classification, durability, change and contradiction, and the conservative gate.

Everything is a column expression over one claim or a pair of claims, so a batch of any
size is one projection. Words decide through the patterns below; nothing is learned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import materialize
from recollect.functions.text import r4

#: Different texts up to this number are broadcast with their classes; more are joined by a shuffle.
FEW = 10_000
STRONG, MEDIUM, WEAK = 0.65, 0.42, 0.25
CLASSIFIED, LOW = 0.60, 0.35
_WHO = r"\bi(?:'m| am) "
_DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"

# Signals of each claim type with their weights, in the order that breaks ties (fixed values).
SIGNALS: dict[str, list[tuple[str, float]]] = {
    "identity": [
        (_WHO + r"(?:a |an )?(?:transgender|trans|nonbinary|non-binary|gay|lesbian|bisexual|queer|cisgender)\b", STRONG),
        (r"\bi was born in\b", STRONG),
        (r"\bi identify as\b", STRONG),
        (r"\bmy name is\b", STRONG),
        (_WHO + r"(?:a |an )?(?:swedish|german|american|british|canadian|french|italian|spanish|irish|dutch|polish)\b", MEDIUM),
        (_WHO + r"(?:originally )?from [a-z]+\b", MEDIUM),
    ],
    "relationship": [
        (r"\bmy (?:husband|wife|partner|boyfriend|girlfriend|spouse|fianc[eé]e?)\b", MEDIUM),
        (_WHO + r"(?:married|single|divorced|engaged|dating|widowed|seeing someone)\b", STRONG),
        (r"\bwe(?:'ve| have) been (?:married|together|friends|dating)\b", STRONG),
        (r"\bmy (?:mom|mum|dad|mother|father|sister|brother|son|daughter|kids?|children|grandma|grandpa|grandmother|grandfather|cousin|aunt|uncle|best friend)\b", MEDIUM),
        (r"\bi have (?:a |an |one |two |three |\d+ )?(?:kids?|children|sons?|daughters?)\b", MEDIUM),
    ],
    "preference_habit": [
        (r"\bi (?:like|love|enjoy|prefer|adore)\b", STRONG),
        (r"\bi (?:hate|dislike|can'?t stand|don'?t (?:like|enjoy))\b", STRONG),
        (r"\bmy favou?rite\b", STRONG),
        (r"\bi (?:usually|often|always|regularly|tend to)\b", MEDIUM),
        (_WHO + r"(?:a fan of|really into)\b", MEDIUM),
    ],
    "current_state": [
        (_WHO + r"(?:swamped|slammed|overwhelmed|stuck|behind|in over my head)\b", STRONG),
        (r"\bright now i(?:'m| am)\b", MEDIUM),
        (r"\b(?:currently|at the moment) i(?:'m| am)\b", MEDIUM),
        (r"\bthese days i(?:'m| am)\b", WEAK),
    ],
    "health_state": [
        (_WHO + r"(?:sick|ill|tired|exhausted|achy|nauseous|pregnant|nursing|burnt out|burned out)\b", STRONG),
        (r"\bi have (?:a |an )?(?:cold|cough|fever|flu|headache|migraine|injury|hashimoto'?s|diabetes|cancer|asthma|the flu)\b", STRONG),
        (r"\bi(?:'ve| have) been (?:diagnosed|recovering|feeling unwell)\b", STRONG),
        (r"\bmy (?:back|head|knee|stomach|shoulder) (?:hurts|aches|is killing me)\b", MEDIUM),
    ],
    "emotion_state": [
        (r"\bi feel (?:so |really |very )?[a-z]+\b", STRONG),
        (_WHO + r"(?:so |really |very |feeling )?(?:happy|sad|excited|thrilled|frustrated|anxious|nervous|proud|angry|upset|grateful|thankful|scared|worried|glad|stressed|annoyed)\b", STRONG),
        (r"\bdriving me (?:crazy|nuts|insane|up the wall|mad)\b", STRONG),
        (r"\b(?:annoyed|frustrated|fed up|furious|irritated|upset|mad|sick) (?:with|at|by|about|of)\b", STRONG),
        (r"\bi was (?:so |really |very )?(?:happy|sad|excited|thrilled|frustrated|anxious|proud|scared|grateful)\b", MEDIUM),
        (r"\bmakes me feel\b", MEDIUM),
        (r"\b(?:ugh|argh|ngl)\b", WEAK),
    ],
    "historical_event": [
        (r"\bi (?:went|attended|visited|launched|graduated|completed|finished|moved|travel?led|hosted|threw)\b", STRONG),
        (r"\b(?:yesterday|last (?:week|month|year|night)|\d+ (?:days?|weeks?|months?|years?) ago)\b", MEDIUM),
        (r"\bi (?:did|saw|made|ran|took|met|had|got) [a-z]+.{0,30}\b(?:yesterday|ago|last (?:week|month|year))\b", MEDIUM),
    ],
    "project_status_plan": [
        (_WHO + r"(?:researching|working on|building|developing|organi[sz]ing|preparing|putting together)\b", STRONG),
        (_WHO + r"in the (?:middle|process) of\b", STRONG),
        (r"\bmy plan is to\b", STRONG),
        (r"\bi started (?:a |an |my )?[a-z]+", MEDIUM),
        (r"\b(?:i've|i have)? ?started [a-z]+ing\b", MEDIUM),
        (_WHO + r"(?:trying|looking) to\b", WEAK),
    ],
    "schedule": [
        (_WHO + rf"(?:going|planning) to .{{0,40}}(?:next (?:week|month)|on (?:{_DAYS})|tomorrow|this weekend|in (?:{_MONTHS}))\b", STRONG),
        (rf"\bi have .{{0,30}}(?:next week|on (?:{_DAYS})|tomorrow|this weekend)\b", MEDIUM),
        (r"\b(?:next week|next month|tomorrow|this weekend) i(?:'m| am|'ll| will)\b", MEDIUM),
    ],
    "belief_value": [
        (r"\bi believe\b", STRONG),
        (r"\bi value\b", STRONG),
        (r"\bi think .{0,40}(?:is important|matters|is wrong|is right|is key)\b", STRONG),
        (r"\b(?:politically|religiously) i\b", STRONG),
        (_WHO + r"(?:liberal|conservative|progressive|religious|spiritual|atheist|christian|catholic|muslim|jewish|buddhist|hindu)\b", STRONG),
        (r"\b(?:is|are) (?:so |really )?important to me\b", MEDIUM),
        (r"\bi prioriti[sz]e\b", MEDIUM),
        (r"\bmatters? (?:a lot )?to me\b", MEDIUM),
    ],
    "aspiration_goal": [
        (r"\bi want to (?:be|become)\b", STRONG),
        (r"\bi want to [a-z]+\b", MEDIUM),
        (r"\bi (?:want|long for|wish for|dream of) (?:a|an|the)?\s*(?:\w+\s+){0,3}?(?:life|lifestyle|future|career|family|home|retirement|marriage|freedom|stability|independence)\b", STRONG),
        (r"\bi (?:hope|dream|aspire|aim) to\b", STRONG),
        (r"\bmy (?:goal|dream|ambition) is\b", STRONG),
        (r"\bsomeday i(?:'d| would| want| hope)\b", STRONG),
        (r"\bi(?:'d| would) love to (?:be|become|have|own|open)\b", MEDIUM),
        (_WHO + r"keen on\b", WEAK),
    ],
    "semantic_fact": [
        (r"\b(?:symboli[sz]es?|represents?|signifies|stands for)\b", STRONG),
        (r"\b(?:it|this|that|the \w+) (?:symboli[sz]es|represents|signifies|means)\b", STRONG),
        (r"\bthe \w+ (?:is|was|supports?|contains?|includes?|offers?|provides?)\b", MEDIUM),
    ],
}
# Signals of durability, and what a type suggests without any (fixed values).
ONE_TIME = r"\b(?:yesterday|last (?:week|month|year|night)|\d+ (?:days?|weeks?|months?|years?) ago|i (?:went|attended|visited|launched|graduated|completed|finished|hosted))\b"
FAST = r"\b(?:right now|currently|at the moment|today|this week|lately|these days|swamped|slammed|busy|overwhelmed|single|dating|nursing|pregnant|sick|tired|exhausted|achy|happy|sad|excited|thrilled|frustrated|anxious|nervous|proud|angry|upset|stressed|annoyed|researching|working on|planning to|next week|tomorrow|this weekend)\b"
STABLE = r"\b(?:born|always been|i(?:'m| am) (?:a |an )?(?:transgender|trans|nonbinary|gay|lesbian|swedish|german|american|british|canadian|french)|originally from|symboli[sz]es|represents|stands for)\b"
SLOW = r"\b(?:usually|often|always|regularly|i (?:like|love|enjoy|prefer|believe|value)|want to (?:be|become)|hope to|aspire|my (?:goal|dream)|prioriti[sz]e|favou?rite)\b"
CHRONIC = r"\b(?:hashimoto'?s|diabetes|cancer|asthma|arthritis|hypertension|lupus|crohn'?s|epilepsy|fibromyalgia|chronic|thyroid)\b"
PRIOR = {"identity": "stable", "semantic_fact": "stable", "relationship": "slow_change", "preference_habit": "slow_change", "belief_value": "slow_change", "aspiration_goal": "slow_change", "current_state": "fast_change", "emotion_state": "fast_change", "health_state": "fast_change", "project_status_plan": "fast_change", "schedule": "fast_change", "historical_event": "one_time"}
PROTECTED = ["health_state", "identity", "belief_value", "relationship"]
SINGLE_VALUED = ["relationship", "identity", "current_state", "health_state"]
SEAMS = [("semantic_fact", "belief_value"), ("aspiration_goal", "project_status_plan"), ("schedule", "project_status_plan")]
CLAUSES = r"(?i),\s*(?:and|but)\s+|;\s*|\.\s+"
# Negation, status words and the words that say nothing about a claim's object (fixed values).
NEGATED = r"\b(?:not|don'?t|doesn'?t|didn'?t|isn'?t|wasn'?t|weren'?t|aren'?t|won'?t|hasn'?t|haven'?t|hadn'?t|can'?t|couldn'?t|wouldn'?t|no longer|stopped|quit|anymore|never|cancell?ed|gave up|broke up|ended)\b"
STATUSES = ["single", "married", "divorced", "engaged", "dating", "widowed"]
EMPTY_WORDS = "i im am is are was were a an the my to of in on and but so really now anymore actually honestly that this it with for about no not longer still just ve have had been".split()
# Sensitive domains by stems (fixed values).
DOMAINS = {
    "recovery": [r"sober", r"sobriet", r"recover", r"relaps", r"addict", r"rehab", r"in recovery", r"twelve.?step", r"12.?step", r"clean and sober"],
    "identity_transition": [r"transition", r"transgender", r"\btrans\b", r"nonbinary", r"non-binary", r"deadnam", r"pronoun", r"genderqueer", r"gender identity", r"coming out", r"\bgay\b", r"lesbian", r"bisexual", r"\bqueer\b", r"asexual"],
    "relationship_status": [r"single", r"married", r"divorc", r"widow", r"engaged", r"separated", r"my husband", r"my wife", r"my partner", r"my spouse"],
    "health_diagnosis": [r"diagnos", r"cancer", r"hashimoto", r"diabet", r"depress", r"anxiety", r"bipolar", r"\bhiv\b", r"disorder", r"chronic", r"illness", r"disease", r"nursing", r"pregnan", r"miscarriag"],
    "faith_religion": [r"religio", r"\bfaith\b", r"christian", r"muslim", r"islam", r"jewish", r"buddhis", r"atheis", r"\bgod\b", r"church", r"mosque", r"synagogue", r"\bpray", r"spiritual"],
    "political_belief": [r"liberal", r"conservativ", r"progressive", r"politic", r"democrat", r"republican", r"\bvote", r"left.?wing", r"right.?wing"],
}
# Signs of a changed fact (fixed values).
RETRACTED = r"\b(?:no longer|not\s+\w+\s+anymore|anymore|don'?t|doesn'?t|isn'?t|aren'?t|stopped|quit|gave up|gave (?:it |them )?away|sold|cancell?ed|broke (?:up|the lease)|laid off|got let go|let go|fired|ended|moved out|drop(?:ped)? out|dropped|ditched|got rid of|left\b|passed away|died|switched off|went off|off it)\b"
CHANGED = r"\b(?:now|these days|instead|switched (?:to|schools|jobs|over)?|moved (?:to|in|into|over)|relocat\w+|got a new|new\b|upgraded|traded|replaced|finally|took (?:a|the|my)|got (?:hired|promoted|my own|certified)|promoted|closed (?:on|my|the|out)?|opened|signed (?:a|my|the|up)|taken over|has become|become my|started|again|back (?:in|at|to|on)|joined|rescheduled|picked up|used to|cut (?:it|my|off))\b"
PLACE = r"([A-Z][\w'.\-]+(?:\s+[A-Z][\w'.\-]+){0,2})"
DIMENSIONS = {
    "residence": (r"\b(?:live|living|lived|reside|residing|moved|relocat\w+|renting|rents?|sublet|crash(?:ing)?|staying|condo|apartment|walk-?up|homeowner|own (?:a |my )?(?:place|home|house|condo))\b", r"\b(?:in|to|near|back to|home to|into)\s+" + PLACE),
    "employer": (r"\b(?:work(?:s|ing)?\s+(?:at|for|as)|employed|job|barista|teacher|teach(?:es)?|nurse|analyst|manager|engineer|designer|coordinator|hired|laid off|promoted|reorg|shift at|the warehouse|freelance)\b", r"\b(?:at|for)\s+" + PLACE),
    "vehicle": (r"\b(?:drive|driving|car|truck|suv|sedan|lease|leasing|jeep|vehicle|pickup|carless|civic|tacoma|outback|tesla|mazda|focus|golf|elantra|f-?150|accord|wrangler|subaru|honda|toyota|hyundai|ford|volkswagen)\b", r"\b(?:drive|driving|lease|leasing|bought|own|upgraded to|for a|to an?)\s+(?:an?\s+|my\s+|the\s+|new\s+)*(?:\d{4}\s+)?([A-Z][\w]+(?:\s+[\w\-]+)?)"),
    "contact": (r"\b(?:phone number|cell number|number is|email(?:\s+address)?|reach me at)\b", None),
}
FAVOURITE = r"\b(?:favou?rite|go-?to|my team|root for|i'?m an?\s+[\w\s]+\bperson)\b"
FILLER = "kind type of comfort way part go thing my a an the new absolute all time right now these days".split()
TOPIC_STOP = "the and but for with that this have has had now you your are was were been being from into out got get just still back over off any more anymore not dont don really actually honestly these days right what when where they them his her she him our their year years month months week weeks last next ago old".split()


# Reasons that the gate gives (fixed values).
REASONS = {
    "locked": "irongrip_versions_on_explicit_only",
    "guarded": "protected_requires_review",
    "unverified": "fact_change_unverified_needs_recognizer",
    "fact": "fact_change_cleared",
    "floor": "sensitive_floor_unclassified_existing_never_auto",
    "out": "out_of_scope",
    "compatible": "scoped_but_compatible",
    "historical": "historical_versioned_not_overwritten",
    "lasting": "stable_not_auto",
    "compound": "compound_candidate_only",
    "unsure": "new_not_confident_enough",
    "fixed": "durability_not_changeable",
    "cleared": "gate_cleared",
}


def rlike(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def type_scores(text: Column) -> Column:
    """An array of struct(minus score, order, type) of the types that show, best first."""
    scores = []
    for i, (name, signals) in enumerate(SIGNALS.items()):
        total = F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.when(rlike(text, p), w).otherwise(0.0) for p, w in signals]))
        scores.append(F.struct((-r4(total)).alias("minus"), F.lit(i).alias("order"), F.lit(name).alias("type")))
    return F.array_sort(F.filter(F.array(*scores), lambda s: s["minus"] < 0))


def durability(text: Column, kind: Column) -> Column:
    """struct(durability, confidence); what the type suggests counts least."""
    one, fast, stable, slow = (rlike(text, p) for p in (ONE_TIME, FAST, STABLE, SLOW))
    prior = F.try_element_at(F.create_map(*[F.lit(x) for p in PRIOR.items() for x in p]), kind)
    say = lambda d, c: F.struct((F.lit(d) if isinstance(d, str) else d).alias("durability"), F.lit(c).alias("confidence"))
    return (
        F.when((kind == "health_state") & rlike(text, CHRONIC), say("slow_change", 0.70)).when(one & ~fast, say("one_time", 0.80)).when(fast, say("fast_change", 0.80))
        .when(stable, say("stable", 0.80)).when(slow, say("slow_change", 0.70)).when(prior.isNotNull(), say(prior, 0.50)).otherwise(say("unknown", 0.30))
    )


def classify(claims: DataFrame, text_col: str = "text") -> DataFrame:
    """``claims`` with claim_type, confidence, status, compound, durability and boundary.

    The top type's score is lowered where the second comes near; a text whose clauses have different
    types is compound and never more than a hint. Each different text is classified once.
    """
    known = materialize(_classified(claims.select(F.col(text_col).alias("__text")).distinct(), "__text"), "claims")
    made = [c for c in known.columns if c != "__text"]
    joined = claims.drop(*made).join(F.broadcast(known) if known.count() <= FEW else known, F.col(text_col).eqNullSafe(F.col("__text")))
    return joined.drop("__text")


def _classified(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``classify`` of distinct texts, dealt over all tasks however few bytes they are."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    scored = texts.repartition(parts, text_col).withColumn("__t", text).withColumn("__s", type_scores(F.col("__t")))
    clauses = F.filter(F.split("__t", CLAUSES), lambda c: F.trim(c) != "")
    tops = F.filter(F.transform(clauses, lambda c: F.try_element_at(type_scores(c), F.lit(1))), lambda s: s["minus"] <= -MEDIUM)
    scored = scored.withColumn("compound", (F.size(clauses) >= 2) & (F.size(F.array_distinct(F.transform(tops, lambda s: s["type"]))) >= 2))
    first, second = F.try_element_at("__s", F.lit(1)), F.try_element_at("__s", F.lit(2))
    top, next_ = -first["minus"], F.coalesce(-second["minus"], F.lit(0.0))
    scored = scored.withColumn("confidence", r4(F.coalesce(top * (0.5 + 0.5 * (top - next_) / top), F.lit(0.0))))
    status = F.when((F.col("confidence") >= CLASSIFIED) & ~F.col("compound"), "classified").when(F.col("confidence") >= LOW, "low_confidence").otherwise("unclassified")
    scored = scored.withColumn("status", status).withColumn("claim_type", F.when(F.col("status") != "unclassified", first["type"]))
    d = F.when(F.size("__s") == 0, F.struct(F.lit("unknown").alias("durability"), F.lit(0.30).alias("confidence"))).otherwise(durability(F.col("__t"), first["type"]))
    scored = scored.withColumn("__d", d)
    guess = (F.col("status") == "unclassified") & (F.col("__d.confidence") <= 0.50)
    pair = reduce(lambda a, b: a | b, [((first["type"] == a) & (second["type"] == b)) | ((first["type"] == b) & (second["type"] == a)) for a, b in SEAMS])
    scored = scored.withColumn("durability", F.when(guess, "unknown").otherwise(F.col("__d.durability"))).withColumn("boundary", F.coalesce(pair & (next_ >= MEDIUM), F.lit(False)))
    return scored.drop("__t", "__s", "__d")


def subject(text: Column) -> Column:
    own = rlike(text, r"^(?:ugh|argh|honestly|actually|yeah|well|so)?[,\s]*i\b") | rlike(text, r"\bmy\b")
    name = F.lower(F.regexp_extract(text, r"\b([A-Z][a-z]+)\b", 1))
    return F.when(own, "self").when(name != "", name).otherwise("unknown")


def polarity(text: Column) -> Column:
    return F.when(rlike(text, NEGATED), -1).otherwise(1)


def object_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(EMPTY_WORDS)))


def _part(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def status_value(text: Column) -> Column:
    return F.coalesce(*[F.when(rlike(text, rf"\b{s}\b"), F.lit(s)) for s in STATUSES])


def favourite_category(text: Column) -> Column:
    words = F.split(F.regexp_extract(F.lower(text), r"\bfavou?rite\s+((?:[a-z']+\s+){0,3}[a-z']+)", 1), r"\s+")
    first = F.try_element_at(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(FILLER)), F.lit(1))
    return F.when(first == "color", "colour").otherwise(first)


def contradicts(old: Column, new: Column, kind: Column) -> Column:
    """Whether two claims of one subject and type exclude each other."""
    unlike = lambda f: F.coalesce(f(old) != f(new), F.lit(False))
    place = lambda t: _part(F.lower(t), r"\b(?:from|live in|moved to|based in|grew up in)\s+([a-z]+)")
    favourite = lambda t: _part(F.lower(t), r"\bfavou?rite\s+\w+\s+is\s+([a-z]+)")
    flip = F.arrays_overlap(object_words(old), object_words(new)) & (polarity(old) != polarity(new))
    state = kind.isin(SINGLE_VALUED) & (polarity(new) == -1) & (polarity(old) == 1)
    return ((kind == "relationship") & unlike(status_value)) | ((kind == "identity") & unlike(place)) | (unlike(favourite) & ~unlike(favourite_category)) | flip | state


def domains(extra: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The sensitive domains with ``extra`` ones; a domain of both has the stems of both, and none can be taken away."""
    return {d: [*DOMAINS.get(d, []), *[s for s in (extra or {}).get(d, []) if s not in DOMAINS.get(d, [])]] for d in [*DOMAINS, *(d for d in extra or {} if d not in DOMAINS)]}


def tripwire(text: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """The first sensitive domain that a text names, in plain or stripped form, or null."""
    lower = F.lower(text)
    bare = F.regexp_replace(lower, r"[^a-z0-9\s]", " ")
    return F.coalesce(*[F.when(lower.rlike(rf"\b(?:{'|'.join(stems)})") | bare.rlike(rf"\b(?:{'|'.join(stems)})"), F.lit(d)) for d, stems in domains(extra).items()])


def dimension(text: Column) -> Column:
    """The single-valued topic of a claim, or null."""
    return F.coalesce(*[F.when(rlike(text, p), F.lit(d)) for d, (p, _) in DIMENSIONS.items()], F.when(rlike(text, FAVOURITE), F.lit("favourite")))


def value(text: Column, dim: Column) -> Column:
    out = F.lit(None).cast("string")
    for d, (_, p) in DIMENSIONS.items():
        if p:
            out = F.when(dim == d, _part(text, p)).otherwise(out)
    return F.trim(F.btrim(F.trim(out), F.lit(".,;:!?'\"")))


def topic_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)), lambda w: ~w.isin(TOPIC_STOP))


def change(old: Column, new: Column) -> Column:
    """struct(dimension, changed): whether the new claim replaces the old one's value or takes it back."""
    retracted, marker = rlike(new, RETRACTED), rlike(new, RETRACTED) | rlike(new, CHANGED)
    dim = dimension(old)
    before, after = value(old, dim), value(new, dim)
    bare = lambda v: F.array_join(F.regexp_extract_all(F.lower(v), F.lit("([a-z0-9]+)"), F.lit(1)), " ")
    a, b = bare(before), bare(after)
    same = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    both = before.isNotNull() & after.isNotNull()
    shared = F.arrays_overlap(topic_words(old), topic_words(new))
    linked = dimension(new).eqNullSafe(dim) | after.isNotNull() | shared
    say = lambda d, c: F.struct((F.lit(d) if isinstance(d, str) else d).alias("dimension"), (F.lit(c) if isinstance(c, bool) else c).alias("changed"))
    null = F.lit(None).cast("string")
    apart = F.coalesce(favourite_category(old) != favourite_category(new), F.lit(False))
    return (
        F.when((F.trim(old) == "") | (F.trim(new) == "") | old.isNull() | new.isNull(), say(null, False))
        .when((dim == "favourite") & apart, say("favourite", False)).when(dim == "favourite", say("favourite", marker))
        .when(dim.isNotNull() & ~linked, say(dim, False)).when(dim.isNotNull() & both & ~same, say(dim, True))
        .when(dim.isNotNull() & both & same & ~retracted, say(dim, False)).when(dim.isNotNull(), say(dim, marker))
        .when(marker & shared, say("generic_change", True)).otherwise(say(null, False))
    )


def classified_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (old_text, new_text) with what the gate needs of both; each different text is classified once."""
    texts = pairs.select(F.explode(F.array("old_text", "new_text")).alias("text")).distinct()
    known = materialize(_classified(texts), "claims")
    side = lambda c, **names: known.select(F.col("text").alias(f"{c}_text"), *[F.col(k).alias(v) for k, v in names.items()])
    old = side("old", status="old_status", claim_type="old_type", durability="old_durability")
    new = side("new", status="new_status", claim_type="new_type", confidence="new_confidence", compound="new_compound")
    return pairs.join(old, "old_text").join(new, "new_text")


def conflict_keys(texts: DataFrame, later: bool) -> DataFrame:
    """(text, key): a conflict of two claims needs a key that both have, so only such pairs are put before the gate.

    Keys are the topic of the first claim, and of the later one every topic of which it has a value; words of the topic; and of one subject and
    type what can exclude each other: the value of a favourite, words of the object, or the type itself where a state has one value.
    """
    known = _classified(texts.select("text").distinct())
    text, kind = F.col("text"), F.col("claim_type")
    say = lambda name, c: F.when(c.isNotNull(), F.concat_ws(":", F.lit(name), c))
    one = [say("topic", dimension(text))]
    if later:
        one += [F.when(value(text, F.lit(d)).isNotNull(), F.lit(f"topic:{d}")) for d in [*DIMENSIONS, "favourite"]] + [F.when(rlike(text, RETRACTED) | rlike(text, CHANGED), F.lit("topic:favourite"))]
    same = F.concat_ws(":", subject(text), kind)
    words = F.transform(topic_words(text), lambda w: F.concat(F.lit("word:"), w))
    favourite = F.when(kind.isNotNull() & rlike(text, r"\bfavou?rite\s+\w+\s+is\s+[a-z]+"), F.concat(F.lit("favourite:"), same))
    state = F.when(kind.isin(SINGLE_VALUED), F.concat(F.lit("state:"), same))
    things = F.when(kind.isNotNull(), F.transform(object_words(text), lambda w: F.concat_ws(":", F.lit("thing"), same, w)))
    keys = F.concat(F.array(*one, favourite, state), words, F.coalesce(things, F.array().cast("array<string>")))
    return known.select("text", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key"))


def govern(new: DataFrame, old: DataFrame, scope: str) -> DataFrame:
    """(old, new, action, reason) of every new claim against every old one of its ``scope``, but where there is no conflict.

    Inputs: ``scope``, old, old_text, old_locked, old_curated; ``scope``, new, new_text, new_curated. The scope is whose
    memory a claim belongs to; in it only claims with a common key meet. A curated old claim is never settled alone by one that is not curated.
    """
    texts = lambda df, c: df.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    keyed = lambda df, c, later: materialize(texts(df, c).join(conflict_keys(df.select(F.col(c).alias("text")).where("text is not null"), later).withColumnRenamed("text", c), c), "keyed")
    pairs = keyed(old, "old_text", False).join(keyed(new, "new_text", True), [scope, "key"]).drop("key").distinct()
    alike = materialize(classified_pairs(pairs.select("old_text", "new_text").distinct()), "pairs")
    locked = alike.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("old_locked"))
    decided = materialize(gate(locked).select("old_text", "new_text", "old_locked", "action", "reason").where("action <> 'no_conflict'"), "decided")
    found = pairs.join(decided, ["old_text", "new_text", "old_locked"])
    shield = (F.col("action") == "auto_supersede") & F.col("old_curated") & ~F.col("new_curated")
    return found.select("old", "new", F.when(shield, "candidate").otherwise(F.col("action")).alias("action"), F.when(shield, F.concat(F.lit("curated_shield: "), "reason")).otherwise(F.col("reason")).alias("reason"))


def enqueue(outcomes: DataFrame, after: int = 0) -> DataFrame:
    """(candidate, old, new, action, reason) of what waits for review, numbered on from ``after`` in order of both claims.

    Numbers are a range partition's place and the prefix sum of the partitions before it, so no task sees the whole queue.
    """
    waiting = outcomes.where(F.col("action").isin("candidate", "version_locked"))
    dealt = materialize(waiting.repartitionByRange("old", "new").withColumn("part", F.spark_partition_id()), "queue")
    inside = dealt.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("old", "new")))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return inside.join(before, "part").select((F.col("n") + F.col("before") + after).alias("candidate"), "old", "new", "action", "reason")


def open_candidates(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The queue without resolved candidates."""
    return queue.join(resolutions.select("candidate"), "candidate", "left_anti")


def coexist(queue: DataFrame, chosen: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(a, b) of the tensions to draw for ``chosen`` candidates: each pair once, without loops and ``conflicts`` (source, target) that exist."""
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    wanted = queue.join(chosen.select("candidate"), "candidate", "left_semi").where("old <> new").select(*pair("old", "new")).distinct()
    return wanted.join(conflicts.select(*pair("source", "target")), ["a", "b"], "left_anti")


def route() -> Column:
    """Of a classified claim: ``auto_eligible``, or ``candidate_only`` where anything about it is unsure, past or protected."""
    sure = (F.col("status") == "classified") & ~F.col("compound") & ~F.col("durability").isin("unknown", "one_time") & ~F.coalesce(F.col("claim_type").isin(PROTECTED), F.lit(False))
    return F.when(sure, "auto_eligible").otherwise("candidate_only")


def gate(pairs: DataFrame, extra: dict[str, list[str]] | None = None, recogniser=None, trace: bool = False) -> DataFrame:
    """``pairs`` with action and reason, with ``trace`` also what was looked at. The gate only ever errs towards review.

    ``extra`` are further sensitive domains. ``recogniser`` maps the rows to a column that is true where a changed fact is confirmed; only then
    is a changed fact, but for favourites, settled without review.

    Inputs: old_text, new_text, old_status, new_status, old_type, new_type, old_durability,
    new_confidence, new_compound, old_locked. Without recognisers wired in, facts that change
    are put up for review, but for favourites.
    """
    old, new = F.col("old_text"), F.col("new_text")
    fact = change(old, new)
    df = pairs.withColumn("__f", fact).withColumn("__trip", F.coalesce(tripwire(old, extra), tripwire(new, extra)))
    known = F.col("old_status") == "classified"
    engage = F.col("__f.changed") & F.col("__f.dimension").isNotNull() & ((F.col("__f.dimension") == "favourite") | (~known & (F.col("__f.dimension") != "generic_change")))
    guarded = F.coalesce(F.col("old_type").isin(PROTECTED), F.lit(False))
    full = known & (F.col("new_status") == "classified")
    scope = F.when(~full, 0.0).when((subject(old) == subject(new)) & (F.col("old_type") == F.col("new_type")), 1.0).when((subject(old) == subject(new)) | (F.col("old_type") == F.col("new_type")), 0.5).otherwise(0.0)
    df = df.withColumn("__fact", F.coalesce(engage, F.lit(False))).withColumn("scope", F.when(F.col("__fact"), 1.0).when(~known, 0.0).otherwise(scope))
    df = df.withColumn("contradiction", F.when(F.col("__fact"), True).otherwise(F.coalesce((F.col("scope") == 1.0) & contradicts(old, new, F.col("old_type")), F.lit(False))))
    say = lambda action, reason: F.struct(F.lit(action).alias("action"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    wire = F.concat(F.lit("tripwire_distrust:"), F.col("__trip"))
    confirmed = F.coalesce(recogniser(df), F.lit(False)) if recogniser else F.lit(False)
    is_fact, locked, tripped = F.col("__fact"), F.col("old_locked"), F.col("__trip").isNotNull()
    decided = (
        F.when(is_fact & locked, say("version_locked", REASONS["locked"])).when(is_fact & tripped, say("candidate", wire))
        .when(is_fact & guarded, say("candidate", REASONS["guarded"])).when(is_fact & (F.col("__f.dimension") != "favourite") & ~confirmed, say("candidate", REASONS["unverified"]))
        .when(is_fact, say("auto_supersede", REASONS["fact"]))
        .when(~known, say("no_conflict", REASONS["floor"])).when(F.col("scope") < 1.0, say("no_conflict", REASONS["out"]))
        .when(~F.col("contradiction"), say("no_conflict", REASONS["compatible"])).when(locked, say("version_locked", REASONS["locked"]))
        .when(F.col("old_durability") == "one_time", say("candidate", REASONS["historical"])).when(F.col("old_durability") == "stable", say("candidate", REASONS["lasting"]))
        .when(guarded, say("candidate", REASONS["guarded"])).when(F.col("new_compound"), say("candidate", REASONS["compound"]))
        .when(F.col("new_confidence") < CLASSIFIED, say("candidate", REASONS["unsure"])).when(~F.col("old_durability").isin("fast_change", "slow_change"), say("candidate", REASONS["fixed"]))
        .when(tripped, say("candidate", wire)).otherwise(say("auto_supersede", REASONS["cleared"]))
    )
    out = df.withColumn("__d", decided).withColumn("action", F.col("__d.action")).withColumn("reason", F.col("__d.reason"))
    if trace:
        seen = F.struct(F.col("__fact").alias("fact_path"), F.col("__f.dimension").alias("dimension"), F.col("__f.changed").alias("changed"), F.col("__trip").alias("tripwire"), known.alias("known"), guarded.alias("guarded"), F.lit(bool(recogniser)).alias("recogniser"), confirmed.alias("confirmed"))
        out = out.withColumn("trace", seen)
    return out.drop("__f", "__trip", "__fact", "__d")


def gate_metrics(decisions: DataFrame) -> DataFrame:
    """One row: decisions by action, and the share of conflicts that the gate settles alone."""
    n = lambda a: F.count_if(F.col("action") == a)
    auto, candidate, locked = n("auto_supersede"), n("candidate"), n("version_locked")
    conflicts = auto + candidate + locked
    return decisions.agg(F.count("*").alias("decisions"), auto.alias("auto_supersede"), candidate.alias("candidate"), locked.alias("version_locked"), n("no_conflict").alias("no_conflict"), F.count_if(F.col("reason").startswith("tripwire")).alias("tripwire"), r4(F.try_divide(auto.cast("double"), conflicts.cast("double"))).alias("auto_fire_rate"))
