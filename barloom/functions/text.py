"""String functions: names, slugs, counts, density, corrections, formats."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.compat import nullif_blank, strip

# Patterns of prescriptions and references in text.
REP_SCHEME = r"\d+\s*[xX×]\s*\d+\s*(?:@|at)?\s*\d+%"
PERCENT_OF_MAX = r"\d+%\s*(?:of\s+)?(?:1RM|max|PR|one[- ]rep[- ]max)"
PERCENT_SERIES = r"(?:\d+%\s*/\s*\d+\s*[xX]\s*\d+\s*){2,}"
PERCENT = r"\d+%"
SETS_BY_REPS = r"\d+\s*[xX×]\s*\d+"
LIFT_WORDS = r"(?i)(?:snatch|clean|jerk|squat|pull|press|deadlift)"
PLAUSIBLE_AUTHOR = r"^[A-Z][a-zA-Z\s\-\.]{3,40}$"

# References of lifts by name.
KNOWN_LIFTS = {
    "Snatch": "snatch",
    "Clean & Jerk": "clean_and_jerk",
    "Clean": "clean",
    "Back Squat": "back_squat",
    "Front Squat": "front_squat",
    "Snatch Pull": "snatch_pull",
    "Clean Pull": "clean_pull",
    "Snatch Deadlift": "snatch_deadlift",
    "Clean Deadlift": "clean_deadlift",
    "Push Press": "push_press",
    "Overhead Squat": "overhead_squat",
    "Jerk": "jerk",
}

# Misread words and their corrections, in the order applied.
OCR_CORRECTIONS = {
    "snalch": "snatch",
    "c1ean": "clean",
    "jerK": "jerk",
    "squalts": "squats",
    "pu11": "pull",
    "deadlifi": "deadlift",
    "barbe11": "barbell",
    "lRM": "1RM",
    "IRM": "1RM",
    "lrm": "1RM",
    "l00%": "100%",
    "9O%": "90%",
    "8O%": "80%",
    "7O%": "70%",
    "6O%": "60%",
    "5O%": "50%",
    "Medvedyev": "Medvedev",
    "Medvyedev": "Medvedev",
    "Zatsiorski": "Zatsiorsky",
    "Zatsiorksy": "Zatsiorsky",
    "Verkoshansky": "Verkhoshansky",
    "Verkhoshanskiy": "Verkhoshansky",
    "Laputin": "Laputin",
    "mesocyc1e": "mesocycle",
    "microcy1e": "microcycle",
    "microcyc1e": "microcycle",
    "macrocyc1e": "macrocycle",
    "periodisa tion": "periodisation",
    "periodiza tion": "periodization",
    "supercompen sation": "supercompensation",
    "hy- pertrophy": "hypertrophy",
    "in- tensity": "intensity",
    "ac- cumulation": "accumulation",
}


def words(text: Column) -> Column:
    """The non-empty pieces between runs of white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, cut to a whole number."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("int")


def has_numbers(text: Column) -> Column:
    """A set scheme with a percentage, a percentage of a maximum, or a series of percentages."""
    return text.rlike(REP_SCHEME) | text.rlike(PERCENT_OF_MAX) | text.rlike(PERCENT_SERIES)


def density_score(text: Column, numbers: Column) -> Column:
    hits = F.regexp_count(text, F.lit(PERCENT)) * 2 + F.regexp_count(text, F.lit(SETS_BY_REPS)) * 3 + F.regexp_count(text, F.lit(LIFT_WORDS))
    return hits + F.when(numbers, 5).otherwise(0)


def density(text: Column, numbers: Column) -> Column:
    """high from 10 points, medium from 4, else low."""
    score = density_score(text, numbers)
    return F.when(score >= 10, "high").when(score >= 4, "medium").otherwise("low")


def lift_ref(name: Column, known: Mapping[str, str] = KNOWN_LIFTS) -> Column:
    """The mapped reference of a name, else its lower-case form with underscores."""
    plain = F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    if not known:
        return plain
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[name], plain)


def title_of(ref: Column) -> Column:
    return F.initcap(F.replace(ref, F.lit("_"), F.lit(" ")))


def plain_name(name: Column) -> Column:
    """Lower case with underscores, for comparing names."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def first_sentence(text: Column, most: int = 400) -> Column:
    return strip(F.substring(F.split_part(text, F.lit("."), F.lit(1)), 1, most))


def without_article(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^The\s+", "")


def preamble(source: Column, author: Column, chapter: Column, section: Column) -> Column:
    """[Source | Author] and [Chapter | Section] lines and a blank one; empty parts are left out, '' if all are."""

    def line(a: str, x: Column, b: str, y: Column) -> Column:
        inner = F.concat_ws(" | ", F.concat(F.lit(a), nullif_blank(x)), F.concat(F.lit(b), nullif_blank(y)))
        return F.when(inner != "", F.concat(F.lit("["), inner, F.lit("]")))

    lines = F.concat_ws("\n", line("Source: ", source, "Author: ", author), line("Chapter: ", chapter, "Section: ", section))
    return F.when(lines != "", F.concat(lines, F.lit("\n\n"))).otherwise("")


def corrected(text: Column, table: Mapping[str, str] = OCR_CORRECTIONS) -> Column:
    """Apply corrections one after the other; a word boundary is asked for beside alphanumeric ends only."""
    for wrong, right in table.items():
        pattern = (r"\b" if wrong[:1].isalnum() else "") + re.escape(wrong) + (r"\b" if wrong[-1:].isalnum() else "")
        text = F.regexp_replace(text, pattern, right)
    return text


def slug(url: Column) -> Column:
    """Last part of a URL's path."""
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def plausible_author(name: Column) -> Column:
    return name.rlike(PLAUSIBLE_AUTHOR) & ~name.rlike(r"\d")


def without_page_suffix(title: Column) -> Column:
    """A title without a trailing page range or site name."""
    return strip(F.regexp_replace(F.regexp_replace(title, r"\s*[-|–]\s*(?:p{1,2}\.\s*)?\d+\s*-\s*\d+\s*$", ""), r"\s*\|.*$", ""))


def unfenced(text: Column) -> Column:
    """A reply without the code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def lenient_json(text: Column) -> Column:
    """The JSON of a reply: all of it, else its first [...], else its first {...}; null if none parses."""
    body = unfenced(text)
    parsed = lambda c: F.try_parse_json(nullif_blank(c))
    return F.coalesce(parsed(body), parsed(F.regexp_extract(body, r"(?s)(\[.*\])", 1)), parsed(F.regexp_extract(body, r"(?s)(\{.*\})", 1)))


def csv_safe(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}\-_ ]", "")


def snippet(text: Column, most: int = 600) -> Column:
    return F.substring(text, 1, most)


def _general(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"\.?0+$", "")


def weight_label(kg: Column) -> Column:
    return F.concat(_general(kg), F.lit(" kg"))


def effort_label(rpe: Column) -> Column:
    return F.format_string("RPE %.1f", rpe.cast("double"))


def percent_label(pct: Column) -> Column:
    return F.concat(_general(pct), F.lit("%"))


def limiter_covered(names: Column, keywords: list[str]) -> Column:
    """One of the names has one of the keywords in it."""
    return F.exists(names, lambda n: F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(n, k)))


def query_term(limiter: Column) -> Column:
    return F.replace(F.replace(limiter, F.lit("_limited"), F.lit("")), F.lit("_"), F.lit(" "))


def heading_sections(text: Column) -> Column:
    """Array of {heading, body} of a text with markdown headings; a body before any has heading ''."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"(?m)^(?=#{1,6}\s)"), lambda p: strip(p) != "")
    heading = lambda p: F.regexp_extract(strip(p), r"^#{1,6}\s+([^\n]*)", 1)
    body = lambda p: strip(F.regexp_replace(strip(p), r"^#{1,6}\s+[^\n]*\n?", ""))
    return F.transform(parts, lambda p: F.struct(heading(p).alias("heading"), body(p).alias("body")))
