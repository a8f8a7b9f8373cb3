"""Column functions over names and texts. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words per chunk, seconds planned per chunk, bytes accepted per
# file, accepted extensions.
CHUNK_WORDS = 400
SECONDS_PER_CHUNK = 2.25
MAX_FILE_BYTES = 1_048_576
EXTENSIONS = ["pdf", "txt", "html", "docx"]

# Unicode white space plus the four separator controls that Python's
# ``str.split`` also breaks on.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def split_words(text: Column) -> Column:
    """Words between runs of Unicode white space; never an empty word."""
    return F.filter(F.split(text, WHITESPACE), lambda word: word != "")


def cutting_text(text: Column, max_length: int = CHUNK_WORDS) -> Column:
    """Array of consecutive ``max_length``-word chunks; empty for a blank text.

    The outer ``transform`` binds the word array to a lambda variable, so the
    text is split once and not once per chunk.
    """

    def cut(words: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(words), F.lit(max_length)), lambda start: start < F.size(words)
        )
        return F.transform(
            starts, lambda start: F.array_join(F.slice(words, start + 1, F.lit(max_length)), " ")
        )

    return F.flatten(F.transform(F.array(split_words(text)), cut))


def count_chunks(text: Column, max_length: int = CHUNK_WORDS) -> Column:
    """Number of chunks of a text, without building them."""
    return F.ceil(F.size(split_words(text)) / F.lit(max_length)).cast("int")


def taille_chunk(chunk: Column) -> Column:
    """Length in code points."""
    return F.length(chunk)


def slug_create(name: Column) -> Column:
    """Name as stored when a collection is created."""
    return F.lower(F.translate(name, " _", "--"))


def slug_update(name: Column) -> Column:
    """Name as used in the object key on update; case is kept."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9\-]", "-")


def slug_lookup(name: Column) -> Column:
    """Name as used in the object key on upload and delete; case is kept."""
    return F.translate(name, " _", "--")


def bucket_name(collection_id: Column, slug: Column) -> Column:
    return F.concat(F.lit("collection-"), collection_id.cast("string"), F.lit("-"), slug)


def normalize_filename(filename: Column) -> Column:
    return F.replace(filename, F.lit(" "), F.lit("-"))


def minio_link(bucket: Column, title_document: Column) -> Column:
    return F.concat(F.lit("/browser/"), bucket, F.lit("/"), title_document)


def file_extension(title_document: Column) -> Column:
    """Lower-cased part after the last dot; a name without a dot is its own extension."""
    return F.lower(F.element_at(F.split(title_document, r"\."), -1))


def extension_allowed(title_document: Column) -> Column:
    return file_extension(title_document).isin(EXTENSIONS)


def size_allowed(size_bytes: Column) -> Column:
    return size_bytes <= F.lit(MAX_FILE_BYTES)


def estimated_time(num_of_chunks: Column) -> Column:
    return num_of_chunks * F.lit(SECONDS_PER_CHUNK)


def execution_time_fmt(seconds: Column) -> Column:
    return F.format_string("%.2f secondes", seconds)


def permission_message(grant: Column) -> Column:
    return F.concat(F.lit("You do not have permission to "), F.replace(grant, F.lit("_"), F.lit(" ")), F.lit("."))


def optional_filter(value: Column) -> Column:
    """NULL unless the filter is set: '' and the form's placeholder mean no filter."""
    return F.nullif(F.nullif(value, F.lit("")), F.lit("string"))


def keep_if_falsy(new: Column, old: Column, falsy) -> Column:
    """New value, or the old one where the new one is NULL or falsy."""
    return F.coalesce(F.nullif(new, F.lit(falsy)), old)


def token_expiry(issued_at: Column, minutes: int | None = 30) -> Column:
    """Expiry of a login; without a given lifetime it is 15 minutes."""
    return issued_at + F.make_dt_interval(mins=F.lit(15 if minutes is None else minutes))


def creation_stamps(now: Column) -> tuple[Column, Column]:
    """Creation day and creation time of a row written at ``now``."""
    return F.to_date(now).alias("date_de_creation"), now.alias("created_at")
