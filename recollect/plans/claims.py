"""Queries over claims: classification, change, contradiction and the gate. Claims are written from customers and their nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.text import r4
from recollect.operators import govern
from recollect.plans.graphs import R4
from recollect.plans.registry import query
from recollect.session import table

#: What customers say, first and later; {n} is the nation's name in title case.
FIRST = [
    "I live in {n} and rent a small place.", "I love the food of {n}.", "I am single and dating.", "My favourite drink is coffee.",
    "I work at {n} Shipping as an analyst.", "I believe honesty is important to me.", "I want to become a pilot.", "I went to {n} last year.",
    "I'm working on a report about {n}.", "I am tired and I have a cold.", "I drive a Honda Civic these days.", "The flag represents {n}.",
    "I am sober and in recovery.", "I usually walk home.", "I'm swamped right now.", "My partner is driving me crazy, and I want to be a pilot.",
]
LATER = [
    "I moved to {n} last month.", "I don't like the food of {n} anymore.", "I am married now.", "My favourite drink is tea now.",
    "I got laid off from {n} Shipping.", "I believe honesty is important to me.", "I don't want to become a pilot anymore.", "I visited {n} yesterday.",
    "I stopped working on the report about {n}.", "I am not tired anymore.", "I sold the Civic and drive a Toyota Tacoma now.", "The flag represents freedom.",
    "I stopped going to the meetings.", "I never walk home.", "I'm not busy anymore.", "My partner makes me happy.",
]


def _case(texts: list[str]) -> str:
    """Which text a customer says, as SQL that both engines read alike."""
    name = "concat(substr(n_name, 1, 1), lower(substr(n_name, 2)))"
    one = lambda t: " || ".join(name if p == "{n}" else "'" + p.replace("'", "''") + "'" for p in _split(t))
    return f"CASE c_custkey % {len(texts)} " + " ".join(f"WHEN {i} THEN {one(t)}" for i, t in enumerate(texts)) + " END"


def _split(t: str) -> list[str]:
    a, found, b = t.partition("{n}")
    return [p for p in (a, "{n}" if found else "", b) if p]


SAID = f"said AS (SELECT c_custkey AS id, {_case(FIRST)} AS old_text, {_case(LATER)} AS new_text FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _said(spark, d):
    quoted = lambda s: s.replace("''", "\\'")
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.selectExpr("c_custkey AS id", f"{quoted(_case(FIRST))} AS old_text", f"{quoted(_case(LATER))} AS new_text")


BOUND = "\\b"


def _quote(p: str) -> str:
    return p.replace("'", "''")


def _re(x: str, p: str) -> str:
    return f"regexp_matches({x}, '(?i){_quote(p)}')"


def _total(x: str, signals) -> str:
    return R4("least(1.0::DOUBLE, " + " + ".join(f"CASE WHEN {_re(x, p)} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in signals) + ")")


def _scores_sql(x: str) -> str:
    return "list_sort(list_filter([" + ", ".join(f"{{'minus': -({_total(x, s)}), 'ord': {i}, 'type': '{k}'}}" for i, (k, s) in enumerate(govern.SIGNALS.items())) + "], lambda s: s.minus < 0))"


def _classified_sql(source: str, x: str) -> str:
    """A claim's class from SQL: scores, margin, clauses, durability."""
    clause = "list_filter(regexp_split_to_array(t, ',\\s*(?:and|but)\\s+|;\\s*|\\.\\s+'), lambda c: trim(c) <> '')"
    tops = f"list_distinct(list_transform(list_filter(list_transform({clause}, lambda c: {_scores_sql('c')}[1]), lambda s: s.minus <= -0.42::DOUBLE), lambda s: s.type))"
    prior = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in govern.PRIOR.items())
    one, fast, stable, slow = (_re("t", p) for p in (govern.ONE_TIME, govern.FAST, govern.STABLE, govern.SLOW))
    say = lambda d, c: f"{{'d': {d}, 'c': {c}::DOUBLE}}"
    dur = f"""CASE WHEN len(s) = 0 THEN {say("'unknown'", 0.3)} WHEN s[1].type = 'health_state' AND {_re('t', govern.CHRONIC)} THEN {say("'slow_change'", 0.7)} WHEN {one} AND NOT {fast} THEN {say("'one_time'", 0.8)} WHEN {fast} THEN {say("'fast_change'", 0.8)}
      WHEN {stable} THEN {say("'stable'", 0.8)} WHEN {slow} THEN {say("'slow_change'", 0.7)} ELSE {say(f"CASE s[1].type {prior} END", 0.5)} END"""
    seams = " OR ".join(f"(s[1].type = '{a}' AND s[2].type = '{b}') OR (s[1].type = '{b}' AND s[2].type = '{a}')" for a, b in govern.SEAMS)
    return f"""
    {source}_a AS (SELECT DISTINCT {x} AS text, trim({x}) AS t FROM said), {source}_b AS (SELECT *, {_scores_sql('t')} AS s, coalesce(len({clause}) >= 2 AND len({tops}) >= 2, false) AS compound FROM {source}_a),
    {source}_c AS (SELECT *, {R4("coalesce(-s[1].minus * (0.5::DOUBLE + 0.5::DOUBLE * (-s[1].minus - coalesce(-s[2].minus, 0.0::DOUBLE)) / -s[1].minus), 0.0::DOUBLE)")} AS confidence, {dur} AS dur FROM {source}_b),
    {source}_d AS (SELECT *, CASE WHEN confidence >= 0.6::DOUBLE AND NOT compound THEN 'classified' WHEN confidence >= 0.35::DOUBLE THEN 'low_confidence' ELSE 'unclassified' END AS status FROM {source}_c),
    {source} AS (SELECT text, confidence, compound, status, CASE WHEN status <> 'unclassified' THEN s[1].type END AS claim_type, CASE WHEN status = 'unclassified' AND dur.c <= 0.5::DOUBLE THEN 'unknown' ELSE dur.d END AS durability,
      coalesce(({seams}) AND -s[2].minus >= 0.42::DOUBLE, false) AS boundary FROM {source}_d)"""


@query(f"WITH {SAID}, s AS (SELECT id, unnest({_scores_sql('old_text')}) AS s FROM said) SELECT id, s.type AS claim_type, -s.minus AS score FROM s")
def claim_type_scores(spark, d):
    rows = _said(spark, d).select("id", F.explode(govern.type_scores(F.col("old_text"))).alias("s"))
    return rows.select("id", F.col("s.type").alias("claim_type"), (-F.col("s.minus")).alias("score"))


@query(f"WITH {SAID}, {_classified_sql('c', 'old_text')} SELECT id, claim_type, confidence, status, compound, durability, boundary FROM said JOIN c ON text = old_text")
def claim_classify(spark, d):
    return govern.classify(_said(spark, d), "old_text").select("id", "claim_type", "confidence", "status", "compound", "durability", "boundary")


STATUS_SQL = ", ".join(f"CASE WHEN {_re('new_text', BOUND + s + BOUND)} THEN '{s}' END" for s in govern.STATUSES)


@query(f"WITH {SAID} SELECT id, CASE WHEN {_re('new_text', govern.NEGATED)} THEN -1 ELSE 1 END AS polarity, coalesce({STATUS_SQL}) AS status_value FROM said")
def polarity(spark, d):
    return _said(spark, d).select("id", govern.polarity(F.col("new_text")).alias("polarity"), govern.status_value(F.col("new_text")).alias("status_value"))


def _wire_sql(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')"
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower({x}), '\\b(?:{'|'.join(s)})') OR regexp_matches({bare}, '\\b(?:{'|'.join(s)})') THEN '{k}' END" for k, s in govern.DOMAINS.items()) + ")"


@query(f"WITH {SAID} SELECT id, {_wire_sql('old_text')} AS domain FROM said")
def tripwire(spark, d):
    return _said(spark, d).select("id", govern.tripwire(F.col("old_text")).alias("domain"))


WORDS = lambda x, stop: f"list_filter(regexp_extract_all(lower({x}), '[a-z]{{3,}}'), lambda w: NOT list_contains({stop}, w))"
TOPIC_STOP = "[" + ", ".join(f"'{w}'" for w in govern.TOPIC_STOP) + "]"


def _dim_sql(x: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {_re(x, p)} THEN '{k}' END" for k, (p, _) in govern.DIMENSIONS.items()) + f", CASE WHEN {_re(x, govern.FAVOURITE)} THEN 'favourite' END)"


def _value_sql(x: str, dim: str) -> str:
    quote = lambda p: p.replace("'", "''")
    return "trim(trim(trim(CASE " + dim + " " + " ".join(f"WHEN '{k}' THEN nullif(regexp_extract({x}, '{quote(p)}', 1), '')" for k, (_, p) in govern.DIMENSIONS.items() if p) + " END), '.,;:!?''\"'))"


def _category_sql(x: str) -> str:
    filler = "[" + ", ".join(f"'{w}'" for w in govern.FILLER) + "]"
    first = f"list_filter(regexp_split_to_array(regexp_extract(lower({x}), '\\bfavou?rite\\s+((?:[a-z'']+\\s+){{0,3}}[a-z'']+)', 1), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({filler}, w))[1]"
    return f"CASE WHEN {first} = 'color' THEN 'colour' ELSE {first} END"


BARE = lambda x: f"array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), ' ')"
CHANGE_SQL = f"""
f1 AS (SELECT DISTINCT old_text AS o, new_text AS n FROM said), f2 AS (SELECT *, {_dim_sql('o')} AS dim, {_dim_sql('n')} AS dn, {_re('n', govern.RETRACTED)} AS gone, {_re('n', govern.RETRACTED)} OR {_re('n', govern.CHANGED)} AS marker, len(list_intersect({WORDS('o', TOPIC_STOP)}, {WORDS('n', TOPIC_STOP)})) > 0 AS shared,
  coalesce({_category_sql('o')} <> {_category_sql('n')}, false) AS apart FROM f1),
f3 AS (SELECT *, {_value_sql('o', 'dim')} AS vo, {_value_sql('n', 'dim')} AS vn FROM f2),
f4 AS (SELECT *, {BARE('vo')} <> '' AND {BARE('vn')} <> '' AND (contains({BARE('vo')}, {BARE('vn')}) OR contains({BARE('vn')}, {BARE('vo')})) AS same, vo IS NOT NULL AND vn IS NOT NULL AS both_v FROM f3),
f5 AS (SELECT o, n, CASE WHEN dim IS NOT NULL THEN dim WHEN marker AND shared THEN 'generic_change' END AS dimension,
  CASE WHEN dim = 'favourite' THEN marker AND NOT apart WHEN dim IS NOT NULL AND NOT (dn IS NOT DISTINCT FROM dim OR vn IS NOT NULL OR shared) THEN false WHEN dim IS NOT NULL AND both_v AND NOT same THEN true
  WHEN dim IS NOT NULL AND both_v AND same AND NOT gone THEN false WHEN dim IS NOT NULL THEN marker ELSE marker AND shared END AS changed FROM f4)"""


@query(f"WITH {SAID}, {CHANGE_SQL} SELECT id, dimension, changed FROM said JOIN f5 ON o = old_text AND n = new_text")
def fact_change(spark, d):
    return _said(spark, d).select("id", govern.change(F.col("old_text"), F.col("new_text")).alias("c")).select("id", "c.dimension", "c.changed")


def _pairs(spark, d):
    both = govern.classified_pairs(_said(spark, d))
    return both.withColumn("old_locked", F.col("id") % 11 == 0)


def _subject_sql(x: str) -> str:
    own = f"({_re(x, '^(?:ugh|argh|honestly|actually|yeah|well|so)?[,\\s]*i\\b')} OR {_re(x, BOUND + 'my' + BOUND)})"
    return f"CASE WHEN {own} THEN 'self' WHEN regexp_extract({x}, '\\b([A-Z][a-z]+)\\b', 1) <> '' THEN lower(regexp_extract({x}, '\\b([A-Z][a-z]+)\\b', 1)) ELSE 'unknown' END"


def _status_sql(x: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {_re(x, BOUND + s + BOUND)} THEN '{s}' END" for s in govern.STATUSES) + ")"


def _lower_part(x: str, p: str) -> str:
    return f"nullif(regexp_extract(lower({x}), '{p}', 1), '')"


EMPTY = "[" + ", ".join(f"'{w}'" for w in govern.EMPTY_WORDS) + "]"
OBJECTS = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({EMPTY}, w))"
POLARITY = lambda x: f"CASE WHEN {_re(x, govern.NEGATED)} THEN -1 ELSE 1 END"
_FAV, _WHERE = "\\bfavou?rite\\s+\\w+\\s+is\\s+([a-z]+)", "\\b(?:from|live in|moved to|based in|grew up in)\\s+([a-z]+)"
CONTRADICTS = f"""(old_type = 'relationship' AND coalesce({_status_sql('old_text')} <> {_status_sql('new_text')}, false)) OR (old_type = 'identity' AND coalesce({_lower_part('old_text', _WHERE)} <> {_lower_part('new_text', _WHERE)}, false))
  OR (coalesce({_lower_part('old_text', _FAV)} <> {_lower_part('new_text', _FAV)}, false) AND NOT coalesce({_category_sql('old_text')} <> {_category_sql('new_text')}, false))
  OR (len(list_intersect({OBJECTS('old_text')}, {OBJECTS('new_text')})) > 0 AND {POLARITY('old_text')} <> {POLARITY('new_text')})
  OR (old_type IN ('relationship', 'identity', 'current_state', 'health_state') AND {POLARITY('new_text')} = -1 AND {POLARITY('old_text')} = 1)"""
GATE_SQL = f"""
{SAID}, {_classified_sql('co', 'old_text')}, {_classified_sql('cn', 'new_text')}, {CHANGE_SQL},
pairs AS (SELECT DISTINCT old_text, new_text, co.status AS os, co.claim_type AS old_type, co.durability AS od, cn.status AS ns, cn.claim_type AS nt, cn.confidence AS nc, cn.compound AS ncomp, dimension, changed, coalesce({_wire_sql('old_text')}, {_wire_sql('new_text')}) AS wire
  FROM said JOIN co ON co.text = old_text JOIN cn ON cn.text = new_text JOIN f5 ON o = old_text AND n = new_text),
g1 AS (SELECT *, coalesce(changed AND dimension IS NOT NULL AND (dimension = 'favourite' OR (os <> 'classified' AND dimension <> 'generic_change')), false) AS fact, coalesce(old_type IN ('health_state', 'identity', 'belief_value', 'relationship'), false) AS guarded,
  CASE WHEN os <> 'classified' OR ns <> 'classified' THEN 0.0::DOUBLE WHEN {_subject_sql('old_text')} = {_subject_sql('new_text')} AND old_type = nt THEN 1.0::DOUBLE WHEN {_subject_sql('old_text')} = {_subject_sql('new_text')} OR old_type = nt THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS so FROM pairs),
g2 AS (SELECT *, CASE WHEN fact THEN 1.0::DOUBLE ELSE so END AS scope, CASE WHEN fact THEN true ELSE coalesce(so = 1.0 AND ({CONTRADICTS}), false) END AS contradiction FROM g1),
g3 AS (SELECT id, said.old_text, said.new_text, g2.* EXCLUDE (old_text, new_text), id % 11 = 0 AS locked FROM said JOIN g2 USING (old_text, new_text)),
g AS (SELECT id, scope, contradiction, string_split(CASE WHEN fact AND locked THEN 'version_locked|irongrip_versions_on_explicit_only' WHEN fact AND wire IS NOT NULL THEN 'candidate|tripwire_distrust:' || wire WHEN fact AND guarded THEN 'candidate|protected_requires_review'
  WHEN fact AND dimension <> 'favourite' THEN 'candidate|fact_change_unverified_needs_recognizer' WHEN fact THEN 'auto_supersede|fact_change_cleared' WHEN os <> 'classified' THEN 'no_conflict|sensitive_floor_unclassified_existing_never_auto' WHEN scope < 1 THEN 'no_conflict|out_of_scope'
  WHEN NOT contradiction THEN 'no_conflict|scoped_but_compatible' WHEN locked THEN 'version_locked|irongrip_versions_on_explicit_only' WHEN od = 'one_time' THEN 'candidate|historical_versioned_not_overwritten' WHEN od = 'stable' THEN 'candidate|stable_not_auto' WHEN guarded THEN 'candidate|protected_requires_review'
  WHEN ncomp THEN 'candidate|compound_candidate_only' WHEN nc < 0.6::DOUBLE THEN 'candidate|new_not_confident_enough' WHEN od NOT IN ('fast_change', 'slow_change') THEN 'candidate|durability_not_changeable' WHEN wire IS NOT NULL THEN 'candidate|tripwire_distrust:' || wire ELSE 'auto_supersede|gate_cleared' END, '|') AS x FROM g3)"""


@query(f"WITH {GATE_SQL} SELECT id, scope, contradiction, x[1] AS action, x[2] AS reason FROM g")
def gate_decisions(spark, d):
    """The gate's decision on every customer's two claims; every eleventh is locked."""
    return govern.gate(_pairs(spark, d)).select("id", "scope", "contradiction", "action", "reason")


AUTO_SHARE = "count(*) FILTER (WHERE x[1] = 'auto_supersede')::DOUBLE / count(*) FILTER (WHERE x[1] <> 'no_conflict')"


@query(f"WITH {GATE_SQL} SELECT count(*) AS decisions, count(*) FILTER (WHERE x[1] = 'auto_supersede') AS auto_supersede, count(*) FILTER (WHERE x[1] = 'candidate') AS candidate, count(*) FILTER (WHERE x[1] = 'version_locked') AS version_locked, count(*) FILTER (WHERE x[1] = 'no_conflict') AS no_conflict, count(*) FILTER (WHERE x[2] LIKE 'tripwire%') AS tripwire, {R4(AUTO_SHARE)} AS auto_fire_rate FROM g")
def gate_metrics(spark, d):
    return govern.gate_metrics(govern.gate(_pairs(spark, d)))


@query(f"WITH {SAID}, {_classified_sql('c', 'old_text')}, {_classified_sql('k', 'new_text')} SELECT coalesce(c.claim_type, 'none') AS first_type, coalesce(k.claim_type, 'none') AS later_type, count(*) AS n FROM said JOIN c ON c.text = old_text JOIN k ON k.text = new_text GROUP BY 1, 2")
def confusion_matrix(spark, d):
    """First types against later ones."""
    p = _pairs(spark, d)
    return p.groupBy(F.coalesce("old_type", F.lit("none")).alias("first_type"), F.coalesce("new_type", F.lit("none")).alias("later_type")).agg(F.count("*").alias("n"))


@query(f"WITH {SAID}, {_classified_sql('k', 'new_text')} SELECT status, {R4('avg(CAST(compound AS INTEGER))')} AS compound, count(*) AS n FROM said JOIN k ON k.text = new_text GROUP BY 1")
def compound_share(spark, d):
    """The share of compound claims by status of all later claims."""
    c = govern.classify(_said(spark, d), "new_text")
    return c.groupBy("status").agg(r4(F.avg(F.col("compound").cast("double"))).alias("compound"), F.count("*").alias("n"))


#: Claims of four neighbouring customers are one scope: every later claim meets every first one of its scope.
WIDE = 1_000_000
SCOPED = f"""
{SAID.replace("said AS", "own AS")}, said AS (SELECT a.id * {WIDE} + b.id AS id, a.old_text, b.new_text FROM own a JOIN own b ON a.id // 4 = b.id // 4)"""
SCOPED_SQL = f"""{GATE_SQL.replace(SAID, SCOPED).replace('id % 11 = 0 AS locked', f'(id // {WIDE}) % 11 = 0 AS locked')},
ids AS (SELECT id // {WIDE} AS old, id % {WIDE} AS new, x[1] AS action, x[2] AS reason FROM g),
outcomes AS (SELECT old, new, CASE WHEN shield THEN 'candidate' ELSE action END AS action, CASE WHEN shield THEN 'curated_shield: ' || reason ELSE reason END AS reason
  FROM (SELECT *, action = 'auto_supersede' AND old % 5 = 0 AND new % 7 <> 0 AS shield FROM ids) WHERE action <> 'no_conflict'),
queue AS (SELECT row_number() OVER (ORDER BY old, new) AS candidate, old, new, action, reason FROM outcomes WHERE action IN ('candidate', 'version_locked'))"""


def _outcomes(spark, d):
    own = _said(spark, d).withColumn("scope", F.floor(F.col("id") / 4))
    old = own.select("scope", F.col("id").alias("old"), "old_text", (F.col("id") % 11 == 0).alias("old_locked"), (F.col("id") % 5 == 0).alias("old_curated"))
    new = own.select("scope", F.col("id").alias("new"), "new_text", (F.col("id") % 7 == 0).alias("new_curated"))
    return govern.govern(new, old, "scope")


@query(f"WITH {SCOPED_SQL} SELECT * FROM outcomes")
def govern_batch(spark, d):
    """What the gate does with every later claim against the first claims of its scope; every fifth first claim is curated."""
    return _outcomes(spark, d).select("old", "new", "action", "reason")


@query(f"WITH {SCOPED_SQL} SELECT * FROM queue WHERE new % 3 <> 0 ORDER BY candidate")
def candidates_open(spark, d):
    """The review queue without what was resolved: candidates whose new claim has an id divisible by three."""
    queue = govern.enqueue(_outcomes(spark, d))
    return govern.open_candidates(queue, queue.where("new % 3 = 0").select("candidate", F.lit("coexist").alias("resolution"))).select("candidate", "old", "new", "action", "reason").orderBy("candidate")


@query(f"WITH {SCOPED_SQL} SELECT DISTINCT least(old, new) AS a, greatest(old, new) AS b FROM queue WHERE new % 3 = 0 AND old <> new AND NOT (least(old, new) % 2 = 0 AND greatest(old, new) - least(old, new) = 1)")
def coexist_resolve(spark, d):
    """Tensions drawn for candidates that are resolved as coexisting, but for pairs that conflict already."""
    queue = govern.enqueue(_outcomes(spark, d))
    own = table(spark, d, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") + 1).alias("source"), F.col("c_custkey").alias("target"))
    return govern.coexist(queue, queue.where("new % 3 = 0").select("candidate"), own)


@query(f"WITH {SAID}, {_classified_sql('c', 'old_text')} SELECT id, CASE WHEN status <> 'classified' OR compound OR durability IN ('unknown', 'one_time') OR claim_type IN ('health_state', 'identity', 'belief_value', 'relationship') THEN 'candidate_only' ELSE 'auto_eligible' END AS route FROM said JOIN c ON c.text = old_text")
def claim_routes(spark, d):
    """Which claims the gate may ever settle alone."""
    return govern.classify(_said(spark, d), "old_text").select("id", govern.route().alias("route"))
