"""Hierarchical query phrases and scene ids as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cardinals up to nineteen and the tens, their irregular ordinals, and the word for the lowest floor.
CARDINALS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
GROUND = {"ground": 0}


def _number_words() -> dict[str, int]:
    """Cardinals and ordinals: an ordinal is the cardinal and "th", a final y turned into "ie", but for the irregular ones."""
    values = {w: i for i, w in enumerate(CARDINALS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
    return values | {IRREGULAR.get(w, (w[:-1] + "ie" if w.endswith("y") else w) + "th"): n for w, n in values.items()} | GROUND


NUMBER_WORDS = _number_words()
#: What parse_floor gives where a floor is named by no number that it knows; no floor has it.
UNKNOWN_FLOOR = -1

#: Parts of names of structure, left out when a room is named by its objects.
ROOM_STRUCTURE = ("wall", "floor", "ceiling", "railing", "roof", "void", "unlabeled", "misc")
#: The room categories that long queries ask for, and the object categories that they never ask for.
ASKED_ROOMS = ("living room", "kitchen", "bedroom", "bathroom")
UNASKED_OBJECTS = ("wall", "floor", "ceiling", "door", "window", "stairs", "railing", "objects", "misc", "void", "")

_NAME = rf"(?:(?:{'|'.join(TENS)})[ -]\w+|\w+)"
_FLOOR = rf"(?i)\bon (?:the )?floor ({_NAME})|\bon the ({_NAME}) floor"
_TAIL = rf"(?i)\s+on (?:the )?(?:floor {_NAME}|{_NAME} floor)\s*$"


def parse_floor(text: Column) -> Column:
    """The floor number in a phrase, from digits ("2", "2nd") or number words up to ninety-nine; null where no floor is named, -1 where its name is no number."""
    name = F.lower(F.coalesce(F.nullif(F.regexp_extract(text, _FLOOR, 1), F.lit("")), F.nullif(F.regexp_extract(text, _FLOOR, 2), F.lit(""))))
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    digits = lambda w: F.regexp_extract(w, r"^(\d+)(?:st|nd|rd|th)?$", 1).try_cast("int")
    value = lambda w: F.coalesce(F.try_element_at(words, w), digits(w))
    # a word that is no number makes the sum null
    total = F.aggregate(F.split(name, "[ -]"), F.lit(0), lambda s, w: s + value(w))
    return F.when(name.isNotNull(), F.coalesce(total, F.lit(UNKNOWN_FLOOR)))


def parse_room(text: Column) -> Column:
    """The room of "<object> in the <room>" or "in region <room>"; null without one."""
    head = F.regexp_replace(text, _TAIL, "")
    return F.nullif(F.lower(F.trim(F.regexp_extract(head, r"(?i)\bin (?:the |region )+(.+)$", 1))), F.lit(""))


def parse_object(text: Column) -> Column:
    """What stands before the room and floor parts; null if nothing does."""
    head = F.regexp_replace(F.regexp_replace(text, _TAIL, ""), r"(?i)\s*\bin (?:the |region )+.+$", "")
    return F.nullif(F.lower(F.trim(head)), F.lit(""))


def parent_id(scene_id: Column) -> Column:
    """"f_r_o" -> "f_r", "f_r" -> "f", "f" -> the building "0" of the hierarchy's root row."""
    return F.when(F.instr(scene_id, "_") > 0, F.regexp_replace(scene_id, r"_[^_]*$", "")).otherwise(F.lit("building"))


def id_numbers(scene_id: Column) -> Column:
    """The parts as integers, so that room 10 follows room 9."""
    return F.transform(F.split(scene_id, "_"), lambda x: x.cast("int"))


def is_structural(name: Column, names: tuple[str, ...] = ROOM_STRUCTURE) -> Column:
    return F.lower(name).rlike("|".join(names))


def asked_categories(room: Column, item: Column) -> Column:
    """Whether long queries ask for an object of this category in a room of this category."""
    return room.isin(*ASKED_ROOMS) & ~item.isin(*UNASKED_OBJECTS)
