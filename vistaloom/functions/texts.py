"""Expressions over subtitle text and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME = r"^﻿?(\d{2}):(\d{2}):(\d{2})[,.](\d{3})$"


def parse_time(text: Column) -> Column:
    """HH:MM:SS,mmm (or a point) -> milliseconds; null for anything else."""
    part = [F.regexp_extract(text, TIME, i) for i in range(1, 5)]
    ms = sum((F.expr("0L") + F.nullif(p, F.lit("")).cast("long") * f for p, f in zip(part, (3600000, 60000, 1000, 1))), F.lit(0).cast("long"))
    return F.when(text.rlike(TIME), ms)


def format_time(ms: Column) -> Column:
    def div(a: Column, b: int) -> Column:
        return F.floor(a / b)

    return F.format_string("%02d:%02d:%02d,%03d", div(ms, 3600000), div(ms, 60000) % 60, div(ms, 1000) % 60, ms % 1000)


def effective_length(text: Column) -> Column:
    """Characters without white space, question and exclamation marks, commas and points; 1 at least."""
    return F.greatest(F.length(F.regexp_replace(text, r"[\s?!,.]", "")), F.lit(1))


def dialogue_parts(text: Column) -> Column:
    """The lines that start with a hyphen, if two or more do (other lines are then dropped); else the text as one part."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("-"))
    return F.when(F.size(lines) >= 2, lines).otherwise(F.array(text))


def wrap(text: Column, width: int) -> Column:
    """Greedy word wrap: an array of lines. A first word that is too long leaves an empty first line."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))

    def step(state: Column, word: Column) -> Column:
        grown = F.trim(F.concat(state["cur"], F.lit(" "), word))
        fits = F.length(grown) <= width
        return F.struct(F.when(fits, state["lines"]).otherwise(F.concat(state["lines"], F.array(state["cur"]))).alias("lines"), F.when(fits, grown).otherwise(word).alias("cur"))

    done = F.aggregate(F.split(text, " "), start, step)
    return F.concat(done["lines"], F.when(done["cur"] != "", F.array(done["cur"])).otherwise(F.array().cast("array<string>")))


def clean(text: Column) -> Column:
    """Newlines to spaces, trimmed; [EMPTY_TEXT] for nothing."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "))
    return F.when(out == "", F.lit("[EMPTY_TEXT]")).otherwise(out)


def remap(label: Column, table: dict[str, int]) -> Column:
    """table's value, after a trailing .0 is cut off; other integers stay; other text is null."""
    bare = F.regexp_replace(label, r"\.0$", "")
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(known, bare), F.when(bare.rlike("^-?[0-9]+$"), bare.try_cast("int")))


def episode_number(name: Column) -> Column:
    """From names such as result_ep3, s2EP10, episode4 or episode_4, in that order; null for others, such as E5."""
    tried = (r"ep(\d+)", r"episode(\d+)", r"ep_(\d+)", r"episode_(\d+)")
    return F.coalesce(*(F.nullif(F.regexp_extract(F.lower(name), p, 1), F.lit("")).cast("int") for p in tried))


def report_number(report: Column, label: str) -> Column:
    """The number after `label:` in a text report, thousands separators allowed; 0 if it isn't there."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(report, label + r":\s*([\d,]+(?:\.\d+)?)", 1), ",", ""), F.lit("")).cast("double"), F.lit(0.0))


def report_section_number(report: Column, section: str, label: str) -> Column:
    """As report_number, of the first such label after the section's title."""
    return F.coalesce(F.nullif(F.regexp_extract(report, rf"(?s){section}:.*?{label}:\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))


def tolerant_int(text: Column) -> Column:
    """The whole number that a text is, whatever white space and byte order marks stand around it; null for anything else."""
    return F.regexp_replace(text, r"^[\s\ufeff]+|\s+$", "").try_cast("long")


def named_in(character: Column, *lists: Column) -> Column:
    """Whether a character is in one of the arrays; null arrays hold nobody."""
    found = F.lit(False)
    for own in lists:
        found = found | F.coalesce(F.array_contains(own, character), F.lit(False))
    return found
