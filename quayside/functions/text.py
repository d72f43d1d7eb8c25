"""Name folding and code extraction as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that compatibility decomposition leaves whole.
STROKES = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "œ": "oe", "Œ": "Oe", "æ": "ae", "Æ": "Ae"}
BOOKING_LETTERS = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i"}
#: Letters that a table folds; names with others (of ROUGH) are decomposed by the JVM's Unicode library.
FOLDED = range(0xC0, 0x250)
#: Characters beyond FOLDED that decomposition could change.
ROUGH = "[^\\x00-\\x9f\\xa1-\\xa7\\xa9\\xab-\\xae\\xb0\\xb1\\xb6\\xb7\\xbb\\xbf-\\u024f\\u0300-\\u034e\\u0350-\\u036f]"


def bare(name: str) -> str:
    """Compatibility decomposition without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))


def _marks() -> str:
    """A class of all characters that combine, as ranges, from the Unicode tables."""
    out: list[list[int]] = []
    for c in range(0x300, 0x1E950):
        if unicodedata.combining(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


_LETTERS = {c: bare(c) for c in map(chr, FOLDED) if bare(c) != c}
_MARKS = _marks()


def fold(name: Column) -> Column:
    """Compatibility decomposition without marks, in the JVM: Latin letters by a table, names that hold others by its Unicode library."""
    plain = F.regexp_replace(replaced(name, _LETTERS), "[\\u0300-\\u034e\\u0350-\\u036f]", "")
    whole = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), name, F.lit(True))
    return F.when(F.rlike(name, F.lit(ROUGH)), F.regexp_replace(whole, _MARKS, "")).otherwise(plain)


def replaced(name: Column, letters: dict[str, str]) -> Column:
    single = {k: v for k, v in letters.items() if len(v) == 1}
    out = F.translate(name, "".join(single), "".join(single.values()))
    for k, v in letters.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def merge_name(name: Column) -> Column:
    """Form of a station's name that is equal across feeds."""
    bare = F.when(F.lower(F.substring(name, 1, 4)) == "s+u ", F.substring(name, F.lit(5), F.length(name))).otherwise(name)
    flat = F.regexp_replace(F.lower(fold(replaced(bare, STROKES))), "[^a-z0-9]", "")
    return F.regexp_replace(F.replace(flat, F.lit("hauptbahnhof"), F.lit("hbf")), "^(.+)bahnhof$", "$1")


def merged_text(name: str) -> str:
    """merge_name of a configured text, on the driver."""
    flat = name[4:] if name[:4].lower() == "s+u " else name
    flat = re.sub("[^a-z0-9]", "", bare("".join(STROKES.get(c, c) for c in flat)).lower()).replace("hauptbahnhof", "hbf")
    return re.sub("^(.+)bahnhof$", r"\1", flat)


def booking_name(name: Column) -> Column:
    """Form that a booking catalogue's names are compared in."""
    return F.regexp_replace(F.lower(fold(replaced(name, BOOKING_LETTERS))), "[^a-z0-9]", "")


def search_name(name: Column) -> Column:
    """Form that searches are compared in: marks dropped, small letters, signs kept."""
    return F.lower(fold(name))


def code_of(stop_id: Column, pattern: str = "[0-9]{7}") -> Column:
    """The first match of a pattern, or null where a digit stands next to it."""
    found = F.regexp_extract(stop_id, f"^(.*?)({pattern})", 2)
    before = F.regexp_extract(stop_id, f"^(.*?)({pattern})", 1)
    after = F.substring(stop_id, F.length(before) + F.length(found) + 1, F.lit(1))
    beside = F.right(before, F.lit(1)).rlike("(?U)^\\d$") | after.rlike("(?U)^\\d$")
    return F.when((found != "") & ~beside, found)


def clock(minutes: Column) -> Column:
    """HH:MM of minutes after midnight, modulo a day."""
    m = minutes.cast("long")
    return F.format_string("%02d:%02d", F.pmod(F.floor(m / 60), F.lit(24)), F.pmod(m, F.lit(60)))


def minutes_of(text: Column) -> Column:
    """Minutes of HH:MM:SS; seconds are dropped, hours may pass 24."""
    parts = F.split(text, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")
