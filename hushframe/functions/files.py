"""Files as binary columns and tag maps: kinds, names, and text of sizes, times and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind, and the longest video in seconds.
EXTENSIONS = {"pdf": "pdf", "image": "jpe?g|png|webp", "video": "mp4|mov|m4v|webm|mkv"}
LONGEST = 600
#: Longest value shown, lines shown of a group.
SHORT, LINES = 120, 60


def ascii_slice(content: Column, at: int, n: int) -> Column:
    """``n`` bytes from ``at`` on as text, a character each."""
    return F.decode(F.substring(content, at + 1, n), "ISO-8859-1")


def kind_of(content: Column) -> Column:
    """jpeg, png, webp, pdf, video or null, from the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    at = lambda k, n: ascii_slice(content, k, n)
    return (
        F.when(head.startswith("FFD8"), "jpeg")
        .when(head.startswith("89") & (at(1, 3) == "PNG"), "png")
        .when((at(0, 4) == "RIFF") & (at(8, 4) == "WEBP"), "webp")
        .when(at(0, 5) == "%PDF-", "pdf")
        .when(at(4, 4).isin("ftyp", "moov", "mdat", "wide") | (head == "1A45DFA3"), "video")
    )


def accepted(path: Column, kind: str, seconds: Column | None = None) -> Column:
    """Whether a file's extension is of a kind, and a video not too long."""
    named = F.coalesce(F.rlike(path, F.lit(rf"(?i)\.(?:{EXTENSIONS[kind]})$")), F.lit(False))
    return named if seconds is None else named & F.coalesce(seconds <= LONGEST, F.lit(False))


def output_name(path: Column, suffix: str, extension: str, prefix: str = "") -> Column:
    """The name of a result: the file's own without folder and extension, prefix and suffix."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat(F.lit(prefix), stem, F.lit(f"{suffix}.{extension}"))


def split_words(key: Column) -> Column:
    """A tag's name as words: camelCase, dots and underscores."""
    return F.regexp_replace(F.regexp_replace(key, "([a-z])([A-Z])", "$1 $2"), "[_.]", " ")


def readable(value: Column) -> Column:
    """Text without control characters, or nothing where no two letters or digits stand together."""
    plain = F.trim(F.regexp_replace(value, r"[\x{0}-\x{1F}\x{FFFD}]", ""))
    return F.when(F.rlike(plain, F.lit("[A-Za-z0-9]{2}")), plain).otherwise("")


def shortened(value: Column, most: int = SHORT) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("…"))).otherwise(value)


def size_text(n: Column) -> Column:
    """A number of bytes as KB (at least one), or MB with one digit."""
    kb = F.greatest(F.lit(1), F.floor(n / 1024 + 0.5)).cast("string")
    return F.when(n < 1024 * 1024, F.concat(kb, F.lit(" KB"))).otherwise(F.format_string("%.1f MB", n / 1024 / 1024))


def time_text(seconds: Column) -> Column:
    """Seconds as m:ss."""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((F.floor(seconds) % 60).cast("string"), 2, "0"))


def place_of(value: Column) -> Column:
    """An ISO 6709 place as latitude and longitude with five digits; null if it is none."""
    part = lambda k: F.regexp_extract(value, r"^([+-][0-9]+(?:\.[0-9]+)?)([+-][0-9]+(?:\.[0-9]+)?)", k).try_cast("double")
    return F.when(part(1).isNotNull(), F.format_string("%.5f, %.5f", part(1), part(2)))


def tag_report(tags: Column, skip: list[str], labels: dict[str, str], place: str | None = None, most: int = LINES) -> Column:
    """``struct<location, other>``, arrays of ``Label: value``: distinct lines of a map of tags, each
    value shortened. ``place`` is the tag of a place; tags in ``skip``, GPS ones and blank ones
    say nothing."""
    where = F.when(place_of(tags[place]).isNotNull(), F.array(F.concat(F.lit("GPS location: "), place_of(tags[place])))) if place else F.lit(None)
    said = F.filter(F.map_entries(tags), lambda e: ~e["key"].isin([*skip, *([place] if place else [])]) & ~F.rlike(e["key"], F.lit("^(?:latitude|longitude|GPS)")) & (F.length(F.trim(e["value"])) > 0))
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map().cast("map<string,string>")
    lines = F.transform(said, lambda e: F.concat(F.coalesce(named[e["key"]], split_words(e["key"])), F.lit(": "), shortened(F.trim(e["value"]))))
    return F.struct(F.coalesce(where, F.array().cast("array<string>")).alias("location"), F.slice(F.array_distinct(lines), 1, most).alias("other"))
