"""What texts state in words: numbers, times and places, in Bangla, romanised Bangla and English.

Spans are found and resolved text by text in Arrow batches; word lists are small, and a gazetteer goes to the tasks only under a checked size.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.geo import haversine_km
from tessera.session import stored

# Number words, scales, and words of vague amounts.
UNITS = {
    "এক": 1, "একজন": 1, "দুই": 2, "দু": 2, "তিন": 3, "চার": 4, "পাঁচ": 5, "ছয়": 6, "সাত": 7, "আট": 8, "নয়": 9, "দশ": 10, "এগারো": 11, "বারো": 12, "তেরো": 13, "চৌদ্দ": 14, "পনেরো": 15, "ষোলো": 16, "সতেরো": 17, "আঠারো": 18, "উনিশ": 19, "বিশ": 20, "পঁচিশ": 25, "ত্রিশ": 30, "চল্লিশ": 40, "পঞ্চাশ": 50, "ষাট": 60, "সত্তর": 70, "আশি": 80, "নব্বই": 90, "দেড়": 1.5, "আড়াই": 2.5,
    "ek": 1, "dui": 2, "du": 2, "tin": 3, "teen": 3, "char": 4, "panch": 5, "pach": 5, "choy": 6, "chhoy": 6, "sat": 7, "shat": 7, "at": 8, "aat": 8, "noy": 9, "dosh": 10, "das": 10, "bish": 20, "tirish": 30, "chollish": 40, "ponchash": 50, "der": 1.5, "deer": 1.5, "arai": 2.5,
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES = {"শ": 100, "শো": 100, "শত": 100, "হাজার": 1e3, "লাখ": 1e5, "লক্ষ": 1e5, "কোটি": 1e7, "sho": 100, "shoto": 100, "hajar": 1e3, "hazar": 1e3, "lakh": 1e5, "lac": 1e5, "lacs": 1e5, "lakhs": 1e5, "koti": 1e7, "crore": 1e7, "crores": 1e7, "hundred": 100, "hundreds": 100, "thousand": 1e3, "thousands": 1e3, "million": 1e6, "dozen": 12, "dozens": 12}
VAGUE = ["hundreds", "thousands", "dozens", "lakhs", "crores", "several", "many", "some", "koyek", "kayek", "koek", "bohu", "onek", "কয়েক", "বহু", "অনেক", "শত শত", "হাজার হাজার"]
# Days before the publication, hours of the parts of a day (and what a clock time in it starts at), months.
DAYS = {2: "day before yesterday|গত পরশু|gotoporshu|goto porshu", 1: "yesterday|last night|গতকাল|গতকালকে|গত রাতে|গতরাতে|গত রাত|gotokal|gotokaal|gotokalke|goto raat|goto rat|gotorat|gotoraat", 0: "today|tonight|this morning|this afternoon|this evening|আজ|আজকে|ajke|ajk|aj|aaj"}
PARTS = {"dawn|daybreak|ভোর|ভোরে|bhor|bhore|vor|vore": (4, 6, 0), "morning|সকাল|সকালে|sokal|sokale|shokal|shokale": (6, 12, 0), "noon|midday|দুপুর|দুপুরে|dupur|dupure": (12, 15, 12), "afternoon|বিকাল|বিকালে|বিকেল|বিকেলে|bikal|bikale|bikel|bikele": (15, 18, 12), "evening|সন্ধ্যা|সন্ধ্যায়|sondha|sondhay|sondhya|sondhyay|shondha": (18, 20, 12), "night|tonight|রাত|রাতে|raat|raate|rat|rate|ratri": (20, 24, 12)}
MONTHS = ["january|jan|জানুয়ারি|জানুয়ারী", "february|feb|ফেব্রুয়ারি|ফেব্রুয়ারী", "march|mar|মার্চ", "april|apr|এপ্রিল", "may|মে", "june|jun|জুন", "july|jul|জুলাই", "august|aug|আগস্ট|অগাস্ট", "september|sep|sept|সেপ্টেম্বর", "october|oct|অক্টোবর", "november|nov|নভেম্বর", "december|dec|ডিসেম্বর"]
#: How far off a place of each level may be, in metres, most specific level first; endings of romanised names; Bangladesh time.
LEVELS = {"locality": 2500, "upazila": 30000, "district": 30000, "division": 90000}
ENDING = re.compile(r"(?:-?(?:e|te|r|er|y|ye|re|tei|ei)|['’]s)?(?![\w'’])")
OFFSET = timedelta(hours=6)
#: Spellings that a gazetteer may have to be sent to the tasks.
MOST_SPELLINGS = 500_000

_DIGITS = str.maketrans("০১২৩৪৫৬৭৮৯", "0123456789")


def composed(text: str) -> str:
    """One form for letters that can be written in two."""
    return unicodedata.normalize("NFC", text)


def _any_of(words: dict | list) -> str:
    return "|".join(re.escape(composed(w)) for w in sorted(words, key=len, reverse=True))


_BEFORE, _AFTER = r"(?<![\wঀ-৿])", r"(?![\wঀ-৿])"
_FIGURE = r"[0-9০-৯]+(?:[,.][0-9০-৯]+)*"
_NUMBER = re.compile(rf"(?<![\wঀ-৿.,])(?P<head>{_FIGURE}|{_any_of(UNITS)})(?:\s*(?P<scale>{_any_of(SCALES)})(?![a-z]))?", re.I)
_UNITS, _SCALES = ({composed(k): v for k, v in d.items()} for d in (UNITS, SCALES))
_VAGUE = re.compile(_any_of(VAGUE), re.I)


def number_of(phrase: str) -> float | None:
    """The number that a phrase states; None if it states none, or a vague amount."""
    phrase = composed(phrase).strip()
    found = _NUMBER.fullmatch(phrase)
    if not found or _VAGUE.match(phrase):
        return None
    head = found["head"].translate(_DIGITS).lower()
    if head[0].isdigit():  # commas group; one point and no comma is a decimal point
        groups = head.replace(",", "")
        if groups.count(".") > 1:
            return None
        n = float(groups)
    else:
        n = _UNITS[head]
    return n * _SCALES[found["scale"].lower()] if found["scale"] else n


def numbers_in(text: str) -> list[tuple[str, float]]:
    """All number phrases of a text with their values."""
    text = composed(text)
    return [(m[0], v) for m in _NUMBER.finditer(text) if (v := number_of(m[0])) is not None]


_PART_WORDS = {w: hours for words, hours in PARTS.items() for w in words.split("|")}
_MONTH_OF = {composed(w): k for k, words in enumerate(MONTHS, 1) for w in words.split("|")}
_DAY_OF = {composed(w): n for n, words in DAYS.items() for w in words.split("|")}
_TWO = "[0-9০-৯]{1,2}"
#: The atoms of a time, each tried at its place: a day, a part of one, a date, a clock time.
_ATOMS = {
    "date": rf"(?:(?P<d1>{_TWO})(?:st|nd|rd|th)?\s+(?P<m1>{_any_of(_MONTH_OF)})|(?P<m2>{_any_of(_MONTH_OF)})\s+(?P<d2>{_TWO})(?:st|nd|rd|th)?)(?:,?\s+(?P<y>(?:19|20|১৯|২০)[0-9০-৯]{{2}}))?",
    "clock": rf"(?P<h>{_TWO})(?:[:.](?P<min>[0-9০-৯]{{2}}))?\s*(?:(?P<ap>[ap])\.?m\.?|টার দিকে|টায়|টার|টা|tar dike|ta dike|tay|tai|tar|ta|o'?clock)(?:\s*(?P<min2>{_TWO})\s*(?:মিনিটে|মিনিট|minutes?|min))?",
    "day": _any_of(_DAY_OF),
    "part": _any_of(_PART_WORDS),
}
_ATOM = {k: re.compile(f"(?:{composed(v)}){_AFTER}", re.I) for k, v in _ATOMS.items()}
_START = re.compile(rf"{_BEFORE}(?=[\w০-৯ঀ-৿])")
_NIGHT, _LAST_HOURS = _PART_WORDS["night"], 6


def _int(digits: str) -> int:
    return int(digits.translate(_DIGITS))


def _date_of(m: re.Match, today: date) -> date | None:
    year = _int(m["y"]) if m["y"] else today.year
    try:
        found = date(year, _MONTH_OF[(m["m1"] or m["m2"]).lower()], _int(m["d1"] or m["d2"]))
        return found.replace(year=year - 1) if not m["y"] and found > today + timedelta(days=1) else found
    except ValueError:
        return None


def _implied_part(words: str) -> tuple[int, int, int] | None:
    """The part of the day that the words for a day have in them."""
    words = words.lower()
    if any(n in words for n in ("night", "রাত", "rat", "raat")):
        return _NIGHT
    return next((_PART_WORDS[w] for w in ("morning", "afternoon", "evening") if w in words), None)


def _clock_of(m: re.Match, part: tuple[int, int, int] | None) -> tuple[int, int] | None:
    hour, minute = _int(m["h"]), _int(m["min"] or m["min2"] or "0")
    if m["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if m["ap"].lower() == "p" else 0)
    elif part and hour < 12 and not (part == _NIGHT and hour <= 4):
        hour += part[2]
    return (hour, minute) if hour <= 23 and minute <= 59 else None


def times_in(text: str, published: datetime) -> list[tuple[str, datetime, datetime, str]]:
    """The clear times of a text, absolute against its publication (both in UTC): surface, start, end, precision (minute, part_of_day or day).

    A time is a day or a date, then a part of the day, then a clock time, each of them optional, with a comma, at or on between; or a clock
    time, then a date. A part of the day alone is none. A clock time without a day that would lie ahead was yesterday's.
    """
    text, local = composed(text), published + OFFSET
    out, at = [], 0

    def atom(kind: str, place: int, glue: str) -> re.Match | None:
        between = re.compile(glue, re.I).match(text, place)
        return between and _ATOM[kind].match(text, between.end())

    while start := _START.search(text, at):
        begin, at = start.start(), start.start() + 1
        day = part = clock = None
        dated, words = False, ""
        if m := _ATOM["day"].match(text, begin):
            words, day, dated = m[0], local.date() - timedelta(days=_DAY_OF[m[0].lower()]), True
            if p := atom("part", m.end(), r"\s*(?:at\s+)?"):
                part, m = _PART_WORDS[p[0].lower()], p
            part = part or _implied_part(words)
        elif m := _ATOM["date"].match(text, begin):
            day, dated = _date_of(m, local.date()), True
            if day is None:
                at = m.end()
                continue
        elif (p := _ATOM["part"].match(text, begin)) and (m := atom("clock", p.end(), r"\s+(?:at\s+)?")):
            part, clock = _PART_WORDS[p[0].lower()], m
        elif m := _ATOM["clock"].match(text, begin):
            clock = m
        else:
            continue
        end = at = m.end()
        if dated:
            glue = r"\s*(?:,|at|এ|on)?\s*"
            if (p := atom("part", end, glue)) and (c := atom("clock", p.end(), r"\s+")):
                part, clock, end = _PART_WORDS[p[0].lower()], c, c.end()
            elif c := atom("clock", end, glue):
                clock, end = c, c.end()
        else:
            day = local.date()
            if (d := atom("date", end, r"\s*(?:,|on)?\s*")) and (found := _date_of(d, day)):
                day, dated, end = found, True, d.end()
        midnight = datetime(day.year, day.month, day.day)
        if clock is not None:
            if (time := _clock_of(clock, part)) is None:
                continue
            moment = midnight + timedelta(hours=time[0], minutes=time[1])
            if not dated and moment > local + timedelta(minutes=30):
                moment -= timedelta(days=1)
            out.append((text[begin:end], moment - OFFSET, moment - OFFSET, "minute"))
        elif part:
            last = part[1] + (_LAST_HOURS if part == _NIGHT and words and _DAY_OF[words.lower()] == 1 else 0)
            out.append((text[begin:end], midnight + timedelta(hours=part[0]) - OFFSET, midnight + timedelta(hours=last) - OFFSET, "part_of_day"))
        else:
            out.append((text[begin:end], midnight - OFFSET, midnight + timedelta(days=1) - OFFSET, "day"))
        at = max(at, end)
    return out


@functools.cache
def numbers() -> Callable[..., Column]:
    """A column function: the number phrases of a text, array of (surface, value); null stays null."""

    @F.pandas_udf("array<struct<surface: string, value: double>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"surface": s, "value": v} for s, v in numbers_in(t)])

    return found


def time_mentions(texts: DataFrame, id_col: str, text_col: str, published: str) -> DataFrame:
    """(id, surface, start, end: seconds, precision) of the times in texts; published: seconds. Rows without a text or a time of publication have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero = datetime(1970, 1, 1)
        for b in batches:
            rows = [(i, s, (x - zero).total_seconds(), (y - zero).total_seconds(), p) for i, t, at in b.itertuples(index=False) if t is not None and at == at for s, x, y, p in times_in(t, zero + timedelta(seconds=at))]
            yield pd.DataFrame(rows, columns=["id", "surface", "start", "end", "precision"])

    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(published).cast("double").alias("at")).where("text IS NOT NULL AND at IS NOT NULL")
    return rows.mapInPandas(run, f"id {kind}, surface string, start double, end double, precision string")


def observed_at(mentions: DataFrame, texts: DataFrame, id_col: str, published: str) -> DataFrame:
    """(id, observed): the earliest time that a text names, not after its publication."""
    at = texts.select(F.col(id_col).alias("id"), F.col(published).alias("published"))
    return mentions.join(at, "id").where("start <= published").groupBy("id").agg(F.min("start").alias("observed"))


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spellings_in(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, spelling) of a text's names: at each place the longest, from left to right without overlaps.

    A Latin name stands alone, perhaps with an ending; a Bangla one begins a word and may go on.
    """
    low, found = _lower(text), {}
    for last, spelling in automaton.iter(low):
        start, end = last - len(spelling) + 1, last + 1
        before = text[start - 1] if start else " "
        if spelling.isascii():
            tail = None if re.match(r"[\w'’]", before) else ENDING.match(low, end)
            if tail is None:
                continue
            stop = tail.end()
        elif "ঀ" <= before <= "৿":
            continue
        else:
            stop = end
        if start not in found or len(spelling) > len(found[start][1]):
            found[start] = (stop, spelling)
    out, at = [], 0
    for start in sorted(found):
        if start >= at:
            out.append((start, *found[start]))
            at = found[start][0]
    return out


def _places_of(found: list[tuple[int, int, str]], places: dict[str, list[tuple]]) -> Iterator[tuple]:
    """(start, end, place) of the spellings found in a text, each place once; places: those of a spelling (rank, name, district, level, lat, lon), the preferred one first."""
    found = list({spelling: (start, end, spelling) for start, end, spelling in reversed(found)}.values())[::-1]  # a spelling is the same place wherever it stands
    named = {p[2] for *_, spelling in found for p in places[spelling] if p[3] == "district"} - {None}
    seen = set()
    for start, end, spelling in found:
        place = next((p for p in places[spelling] if p[2] in named), places[spelling][0])
        if place[1:4] not in seen:
            seen.add(place[1:4])
            yield start, end, place


def place_mentions(texts: DataFrame, gazetteer: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The places that texts name, each once: id, start, end (characters), surface, name, level, district, lat, lon, precision_m.

    gazetteer: spelling, name, level, district, lat, lon; its spellings, at most MOST_SPELLINGS, go to the tasks as one automaton, and their places with them. A spelling of several
    places is the one in a district that the text names too, then that of the most specific level, then the first by name. Texts without a name have no rows; rows that repeat an id
    are texts of their own. A text's places are chosen where it is read: no mention is shuffled or sorted.
    """
    listed = gazetteer.select(F.lower(F.trim("spelling")).alias("spelling"), "name", "level", "district", "lat", "lon").where("spelling <> ''")
    rank = functools.reduce(lambda c, k: c.when(F.col("level") == k[1], k[0]), enumerate(LEVELS), F.when(F.lit(False), -1))
    ordered = listed.groupBy("spelling").agg(F.sort_array(F.collect_set(F.struct(rank.alias("rank"), "name", "district", "level", "lat", "lon"))).alias("places"))
    n = listed.select("spelling").distinct().count()
    if n > MOST_SPELLINGS:
        raise ValueError(f"a gazetteer of {n} spellings; at most {MOST_SPELLINGS} fit into a task")
    places = texts.sparkSession.sparkContext.broadcast({r["spelling"]: [tuple(p) for p in r["places"]] for r in ordered.collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in places.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for b in batches:
            found = ((i, t, *m) for i, t in b.itertuples(index=False) for m in _places_of(spellings_in(t, automaton) if places.value else [], places.value))
            rows = [(i, s, e, t[s:e], name, level, district, lat, lon, LEVELS.get(level)) for i, t, s, e, (_, name, district, level, lat, lon) in found]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "surface", "name", "level", "district", "lat", "lon", "precision_m"], dtype=object)

    kind = {c: listed.schema[c].dataType.simpleString() for c in ("name", "level", "district", "lat", "lon")} | {"id": texts.schema[id_col].dataType.simpleString()}
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInPandas(run, "id {id}, start int, end int, surface string, name {name}, level {level}, district {district}, lat {lat}, lon {lon}, precision_m int".format(**kind))


def best_place(mentions: DataFrame, most_m: int = 300_000) -> DataFrame:
    """Where a text is about: id, name, level, district, lat, lon, precision_m.

    The first place named, made as specific as any named place of its district is; if other districts are named too, the precision widens to cover them.
    mentions are found once and stored.
    """
    mentions = stored(mentions, "place-mentions")
    rank = functools.reduce(lambda c, k: c.when(F.col("level") == k[1], k[0]), enumerate(LEVELS), F.when(F.lit(False), -1))
    first = mentions.groupBy("id").agg(F.min_by(F.struct("district", "name"), "start").alias("first"))
    rows = mentions.join(first, "id")
    same = F.col("district").eqNullSafe(F.col("first.district")) & (F.col("district").isNotNull() | (F.col("name") == F.col("first.name")))
    anchor = rows.where(same).groupBy("id").agg(F.min_by(F.struct("name", "level", "district", "lat", "lon", "precision_m"), F.struct(rank, F.col("start"))).alias("at"))
    apart = mentions.join(anchor, "id").where(~F.col("district").eqNullSafe(F.col("at.district")))
    wide = apart.groupBy("id").agg(F.max(haversine_km(F.col("at.lat"), F.col("at.lon"), F.col("lat"), F.col("lon")) * 1000 + F.col("precision_m")).alias("wide"))
    reach = F.when(F.col("wide").isNull(), F.col("at.precision_m")).otherwise(F.least(F.greatest(F.col("at.precision_m"), F.col("wide")), F.lit(most_m)))
    return anchor.join(wide, "id", "left").select("id", "at.name", "at.level", "at.district", "at.lat", "at.lon", reach.cast("int").alias("precision_m"))
