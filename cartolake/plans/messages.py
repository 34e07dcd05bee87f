"""What messages say: days, areas, intents (inventory 2.10 and 2.11). The notes are written from the orders, so that what each says is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.functions import text as X
from cartolake.functions.dates import spoken_dates
from cartolake.functions.slots import with_slots
from cartolake.functions.wishes import Vocabulary, with_wishes
from cartolake.operators import rules as R
from cartolake.operators.areas import named_areas
from cartolake.plans.registry import query
from cartolake.sources.tables import Tables

TODAY = "2026-05-01"


@query(
    """SELECT note_id, CASE said_day WHEN 0 THEN DATE '2026-05-02' WHEN 1 THEN DATE '2026-05-03' WHEN 2 THEN DATE '2026-05-03' WHEN 3 THEN day WHEN 4 THEN CASE WHEN month(day) = 5 THEN NULL ELSE day END WHEN 5 THEN day
    WHEN 6 THEN DATE '2026-05-01' + CAST(CASE WHEN weekday = 4 THEN 7 ELSE (weekday + 3) % 7 END AS INT) WHEN 7 THEN DATE '2026-05-01' + CAST((weekday + 3) % 7 AS INT) WHEN 8 THEN day WHEN 9 THEN CASE WHEN day(day) > 23 THEN day END END AS day FROM notes""",
    "notes",
)
def dt_intent_date(t: Tables) -> DataFrame:
    """The day that each note speaks of: written dates, tomorrow, the day after, weekdays; null where it names none."""
    return spoken_dates(t.notes.select("note_id", "content"), "content", F.lit(TODAY).cast("date"), "day").select("note_id", "day")


@query(
    """, m AS (SELECT name, count(DISTINCT city_id) AS cities, min(area_id) AS sole FROM areas WHERE kind = 'DISTRICT' GROUP BY name), k AS (SELECT name, city_id, min(area_id) AS area_id FROM areas WHERE kind = 'DISTRICT' GROUP BY name, city_id),
    n AS (SELECT note_id, said_area, city, (city + 1) % 25 AS next, m.cities, m.sole, h.area_id AS in_here, c.area_id AS in_city FROM notes LEFT JOIN m ON m.name = 'Merkez ' || district LEFT JOIN k h ON h.name = 'Merkez ' || district AND h.city_id = here LEFT JOIN k c ON c.name = 'Merkez ' || district AND c.city_id = city)
    SELECT note_id, CASE WHEN said_area = 1 OR (said_area = 2 AND in_city IS NOT NULL) THEN 'DISTRICT' ELSE 'CITY' END AS kind,
      CASE said_area WHEN 0 THEN city WHEN 1 THEN CASE WHEN cities = 1 THEN sole ELSE in_here END WHEN 2 THEN coalesce(in_city, city) WHEN 3 THEN CASE WHEN length(CAST(next AS VARCHAR)) > length(CAST(city AS VARCHAR)) THEN next WHEN length(CAST(next AS VARCHAR)) < length(CAST(city AS VARCHAR)) THEN city ELSE least(city, next) END END AS area_id
    FROM n WHERE said_area IN (0, 2, 3) OR (said_area = 1 AND (cities = 1 OR in_here IS NOT NULL))""",
    "notes areas",
)
def er_area_match(t: Tables) -> DataFrame:
    """The area that each note means."""
    notes = t.notes.select("note_id", "content", F.col("here").alias("current"))
    return named_areas(notes, t.areas, "note_id", "content", "current")


#: What a note asks for; the first that fits.
WISHES = R.written("""
    stem=sil|cikar|kaldir -> REMOVE_STOP
    word=daha stem=ucuz -> CHEAPER
    stem=hava -> WEATHER
    stem=butce -> BUDGET
    stem=plan|gezelim|rota -> PLAN
    stem=merhaba|selam -> GREETING
""")


@query(
    "SELECT note_id, CASE said_wish WHEN 2 THEN 'REMOVE_STOP' WHEN 1 THEN 'CHEAPER' WHEN 3 THEN 'WEATHER' WHEN 5 THEN 'BUDGET' WHEN 4 THEN CASE WHEN said_area = 0 THEN 'PLAN' ELSE 'GREETING' END ELSE 'PLAN' END AS intent, CASE WHEN said_wish = 5 THEN 1500 END AS amount, CASE WHEN said_wish = 6 THEN 4 END AS people, CASE WHEN said_wish = 2 THEN 2 END AS stop FROM notes",
    "notes",
)
def er_intent_rules(t: Tables) -> DataFrame:
    """What each note asks for, with amounts, numbers of people and stops by number."""
    n, x = t.notes, X.fold(F.col("content"))
    found = R.first_match(n, "note_id", F.concat(R.facts({}), R.name_facts(F.col("content"))), R.conditions(t.spark, WISHES)).withColumnRenamed("outcome", "intent")
    number = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit("")).cast("int")
    order = F.when(F.rlike(x, F.lit(r"\bilk durag")), 1).when(F.rlike(x, F.lit(r"\bikinci durag")), 2).when(F.rlike(x, F.lit(r"\bucuncu durag")), 3)
    said = n.select("note_id", number(r"(\d+) ?(?:tl|lira)\b").alias("amount"), number(r"(\d+) ?(?:kisi|people)").alias("people"), order.alias("stop"))
    return said.join(found, "note_id")


@query(
    """SELECT ask_id, CAST(CASE p WHEN 0 THEN n WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 12 WHEN 4 THEN n END AS INT) AS people, CAST(CASE b WHEN 0 THEN amount WHEN 1 THEN 2500 WHEN 2 THEN 3000 WHEN 3 THEN 1000 END AS INT) AS budget,
    CASE s WHEN 0 THEN 870 WHEN 1 THEN 900 WHEN 2 THEN 840 WHEN 3 THEN 540 END AS start, CASE d WHEN 0 THEN 180 WHEN 1 THEN 300 WHEN 2 THEN 120 END AS minutes, CASE w WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS walking FROM asks""",
    "asks",
)
def er_intent_slots(t: Tables) -> DataFrame:
    """How many, for how much, when, how long and how far each request asks for."""
    return with_slots(t.asks, "ask_id", "content")


@query(
    "SELECT note_id, CASE WHEN ok THEN upper(u.kind) WHEN said_wish = 2 THEN 'REMOVE_STOP' WHEN said_wish = 1 THEN 'CHEAPER' WHEN said_wish = 3 THEN 'WEATHER' WHEN said_wish = 5 THEN 'BUDGET' WHEN said_wish = 4 AND said_area <> 0 THEN 'GREETING' ELSE 'PLAN' END AS intent, coalesce(ok, FALSE) AS by_model FROM notes LEFT JOIN usage u ON u.event_id = note_id",
    "notes usage",
)
def er_intent_fallback(t: Tables) -> DataFrame:
    """The model's answer to each note where it gave one, else what the rules say."""
    answers = t.usage.select(F.col("event_id").alias("note_id"), F.when(F.col("ok"), F.upper("kind")).alias("answer"))
    joined = er_intent_rules(t).select("note_id", "intent").join(answers, "note_id", "left")
    return joined.select("note_id", F.coalesce("answer", "intent").alias("intent"), F.col("answer").isNotNull().alias("by_model"))


#: Beginnings of words that say cheaper, closer, under a roof or in the open, and tags; words without a wish of their own.
CHEAP, CLOSE, ROOFED, OPEN_AIR = ("ucuz", "cheap"), ("yakin", "close"), ("kapali", "indoor"), ("acikhava", "outdoor")
TAGS = {"kahve": "coffee", "deniz": "sea", "gezel": "tour", "hava": "weather"}
FILLER = ("bir", "daha", "icin", "gun", "gunu", "olsun", "olacak", "nasil", "the", "and", "this", "after", "day")
#: Endings that a word is looked for without, if four letters are left.
TAKEN_OFF = ("lar", "ler", "ci", "cu", "li", "lu", "si", "su")

SAID = f"list_filter(list_transform(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}]+'), lambda w: lower(translate(w, '{X.MARKED}', '{X.PLAIN}'))), lambda w: w <> '')"


def any_of(w: str, stems: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({w}, '{x}')" for x in stems) + ")"


TAG = "CASE " + " ".join(f"WHEN starts_with(w, '{x}') THEN '{tag}'" for x, tag in TAGS.items()) + " END"
STEM = "CASE " + " ".join(f"WHEN suffix(w, '{e}') AND length(w) >= {len(e) + 4} THEN left(w, length(w) - {len(e)})" for e in TAKEN_OFF) + " ELSE w END"
TELLS = f"length(w) >= 3 AND w NOT IN {FILLER} AND NOT {any_of('w', CHEAP + CLOSE + ROOFED + OPEN_AIR)}"


@query(
    f""", w AS (SELECT note_id, {SAID} AS ws FROM notes), j AS (SELECT *, array_to_string(ws, '') AS joined, list_filter(ws, lambda w: {TELLS}) AS telling FROM w)
    SELECT note_id, len(list_filter(ws, lambda w: {any_of('w', CHEAP)})) > 0 AS cheaper, len(list_filter(ws, lambda w: {any_of('w', CLOSE)})) > 0 AS closer,
    CASE WHEN {' OR '.join(f"contains(joined, '{x}')" for x in OPEN_AIR)} THEN FALSE WHEN {' OR '.join(f"contains(joined, '{x}')" for x in ROOFED)} THEN TRUE END AS indoor,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(telling, lambda w: {TAG}), lambda x: x IS NOT NULL))), ',') AS tags,
    array_to_string(list_sort(list_distinct(list_transform(list_filter(telling, lambda w: {TAG} IS NULL), lambda w: {STEM}))), ',') AS words FROM j""",
    "notes",
)
def er_stop_wish(t: Tables) -> DataFrame:
    """What each note wishes of a stop: cheaper, closer, under a roof or not, tags, and the words to look for, without endings."""
    return with_wishes(t.notes, "note_id", "content", Vocabulary(CHEAP, CLOSE, ROOFED, OPEN_AIR, TAGS, FILLER, TAKEN_OFF))
