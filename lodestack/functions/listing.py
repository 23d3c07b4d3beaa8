"""Expressions over a file listing: ids, extensions, dates, indexability, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import ASSET_FOLDERS, IMAGE_EXTENSIONS, INDEXABLE_EXTENSIONS, INDEXABLE_MIME

FOLDER_MIME = "application/vnd.google-apps.folder"
SHORTCUT_MIME = "application/vnd.google-apps.shortcut"


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def drive_file_id(url: Column) -> Column:
    """Id behind /d/, /folders/, ?id= or &id=; null if there is none."""
    return or_null(F.regexp_extract(url, r"(?:/d/|/folders/|[?&]id=)([A-Za-z0-9_-]+)", 1))


def folder_id_from(text: Column) -> Column:
    """A bare id as it is, a link's id, or null."""
    plain = F.trim(text)
    return F.coalesce(F.when(plain.rlike(r"^[A-Za-z0-9_-]+$"), plain), drive_file_id(plain))


def file_extension(name: Column) -> Column:
    """Lower-case last suffix; none for hidden files, names without a dot and names that end in one."""
    last = F.substring_index(F.rtrim(name, F.lit("/")), "/", -1)
    return F.lower(F.regexp_extract(last, r"^.*[^.].*?\.([^.]+)$", 1))


def modified_date(text: Column) -> Column:
    """month/day/year; null for blank and for anything that is no date."""
    return F.to_date(F.try_to_timestamp(F.trim(text), F.lit("M/d/yyyy")))


def is_indexable(extension: Column, mime: Column, folder: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(folder, F.lit("")), "/"), lambda p: F.lower(F.trim(p)))
    asset = F.arrays_overlap(parts, F.array(*[F.lit(a) for a in ASSET_FOLDERS]))
    return ~(extension.isin(IMAGE_EXTENSIONS) & asset) & (extension.isin(INDEXABLE_EXTENSIONS) | mime.isin(INDEXABLE_MIME))


def stem(name: Column, extension: Column) -> Column:
    """The name without its extension."""
    suffix = F.concat(F.lit("."), extension)
    ends = (extension != "") & F.endswith(F.lower(name), suffix)
    return F.when(ends, F.substring(name, F.lit(1), F.length(name) - F.length(suffix))).otherwise(name)


def title(name: Column, extension: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.replace(stem(name, extension), F.lit("_"), F.lit(" ")), r"\s+", " "))
    return F.when(spaced != "", spaced).otherwise(name)


def safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)^https?://"), url).otherwise("")


def item_kind(mime: Column, target_mime: Column) -> Column:
    """file, folder, folder_shortcut, file_shortcut or skip (a shortcut to nothing)."""
    return (
        F.when(mime == FOLDER_MIME, "folder")
        .when((mime == SHORTCUT_MIME) & (target_mime == FOLDER_MIME), "folder_shortcut")
        .when((mime == SHORTCUT_MIME) & target_mime.isNotNull(), "file_shortcut")
        .when(mime == SHORTCUT_MIME, "skip")
        .otherwise("file")
    )


def quota_day(at: Column) -> Column:
    """The day of a UTC instant in the quota's time zone."""
    return F.to_date(F.from_utc_timestamp(at, "America/Los_Angeles"))
