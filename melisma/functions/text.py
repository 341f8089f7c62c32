"""Text keys, labels and token strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    """Lower case, without a trailing `.number`, separators and other signs as single blanks; nothing left gives 'unknown', null too."""
    t = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    for pattern, to in ((r"\.\d+$", ""), (r"[_\-]+", " "), (r"[^a-z0-9\s]+", " "), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.coalesce(F.nullif(F.trim(t), F.lit("")), F.lit("unknown"))


def path_artist(path: Column) -> Column:
    """Artist by the folder: the last one, or the second under a top folder called 'clean midi'; none gives 'unknown'."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(path.isNull(), None).when((n >= 3) & (normalize_text(parts[0]) == "clean midi"), F.get(parts, F.lit(1))).when(n >= 2, F.get(parts, n - 2)).otherwise("unknown")


def path_title(path: Column) -> Column:
    """File name without its last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def family_key(artist: Column, title: Column) -> Column:
    return F.concat_ws("::", normalize_text(artist), normalize_text(title))


def prefixed_int(token: Column, prefix: str) -> Column:
    """The number after a prefix; other tokens and non-numbers give null."""
    return F.when(token.startswith(prefix), F.substring(token, len(prefix) + 1, 20).try_cast("int"))


def key_token(name: Column) -> Column:
    """'C#:maj' -> 'KEY_C_SHARP_MAJ'; 'uncertain' -> 'KEY_UNCERTAIN'."""
    return F.when(name == "uncertain", "KEY_UNCERTAIN").otherwise(F.concat(F.lit("KEY_"), F.upper(F.replace(F.replace(name, F.lit("#"), F.lit("_SHARP")), F.lit(":"), F.lit("_")))))


def strip_keys(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.startswith("KEY_"))


def checkpoint_step(name: Column) -> Column:
    """Step of `step_N.pt`; other names give null."""
    return F.nullif(F.regexp_extract(name, r"^step_(\d+)\.pt$", 1), F.lit("")).try_cast("long")


def checkpoint_class(name: Column) -> Column:
    """Order of kinds: steps, best, last, latest, others."""
    return F.when(checkpoint_step(name).isNotNull(), 0).when(name == "best.pt", 1).when(name == "last.pt", 2).when(name == "latest.pt", 3).otherwise(4)


def bucket_label(notes: Column, duration: Column) -> Column:
    return F.format_string("note_q%d_dur_q%d", notes, duration)


def format_metric(c: Column, kind: str) -> Column:
    """'percent', 'int' or two decimals; missing and non-finite values read 'NA'."""
    ok = c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    shown = {"percent": F.format_string("%.2f%%", c.cast("double") * 100.0), "int": F.rint(c.cast("double")).cast("long").cast("string")}.get(kind, F.format_string("%.2f", c.cast("double")))
    return F.when(ok, shown).otherwise("NA")


def preview(tokens: Column, shown: int = 24) -> Column:
    """The first tokens, with ' ...' if there are more; none, or null, give '(empty)'."""
    tail = F.when(F.size(tokens) > shown, " ...").otherwise("")
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) <= 0, "(empty)").otherwise(F.concat(F.concat_ws(" ", F.slice(tokens, 1, shown)), tail))


def sanitize_tag(c: Column) -> Column:
    """Letters, digits, dots, underscores and dashes only, without such signs at the ends; nothing left gives null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", ""), F.lit(""))


def tempo_of(token: Column, low: int = 40, high: int = 220) -> Column:
    """Beats a minute of a tempo token; another token, a non-number or a value outside the range fails the query, null stays null."""
    value = prefixed_int(token, "TEMPO_")
    wrong = F.raise_error(F.concat(F.lit("not a tempo token: "), token)).cast("double")
    return F.when(token.isNull(), None).when(F.coalesce(value.between(low, high), F.lit(False)), value.cast("double")).otherwise(wrong)


def instrument_of(token: Column) -> Column:
    """Name of an instrument token, in upper case; another or an empty one fails the query, null stays null."""
    name = F.upper(F.trim(F.substring(token, 6, 100)))
    wrong = F.raise_error(F.concat(F.lit("not an instrument token: "), token)).cast("string")
    return F.when(token.isNull(), None).when(token.startswith("INST_") & (name != ""), name).otherwise(wrong)
