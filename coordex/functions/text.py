"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH_KEYS = r".*sub-(.*)_ses-(.*)_run-(.*)/"


def parse_vector(text: Column) -> Column:
    """"[x y z]" as an array of doubles; a part that is no number is null."""
    inner = F.trim(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""))
    return F.when(F.length(inner) > 0, F.transform(F.split(inner, r"\s+"), lambda x: x.try_cast("double")))


def format_vector(vector: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(" ", F.transform(vector, lambda x: x.cast("string"))), F.lit("]"))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def counter_label(name: Column) -> Column:
    """A counter's name as it is logged: underscores to blanks, first letter large."""
    return capitalize(F.replace(name, F.lit("_"), F.lit(" ")))


def path_parts(path: Column) -> Column:
    """subject, session and run of a path; null where it does not match."""
    part = lambda i: F.regexp_extract(path, PATH_KEYS, i)
    return F.when(path.rlike(PATH_KEYS), F.struct(part(1).alias("subject"), part(2).alias("session"), part(3).alias("run")))


def name_parts(path: Column) -> Column:
    """Subject, session and run by their tokens, in the file name or else anywhere
    in the path; a resliced volume's leading r is dropped from the subject."""
    token = lambda key: F.nullif(F.regexp_extract(path, rf"(?:^|[/_]){key}-([A-Za-z0-9]+)(?!.*(?:^|[/_]){key}-)", 1), F.lit(""))
    subject = F.nullif(F.regexp_extract(path, r"(?:^|[/_])r?sub-([A-Za-z0-9]+)(?!.*(?:^|[/_])r?sub-)", 1), F.lit(""))
    return F.struct(subject.alias("subject"), token("ses").alias("session"), token("run").alias("run"))


def canonical_subject(name: Column) -> Column:
    return F.regexp_replace(name, r"^r(?=sub-)", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column, up: int = 1) -> Column:
    return F.element_at(F.split(path, "/"), -1 - up)


def log_stamp(time: Column) -> Column:
    """A time as log lines begin with it."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss,SSS")


def name_stamp(time: Column) -> Column:
    """A time as file names hold it."""
    return F.date_format(time, "yyyyMMdd_HHmmss")
