"""Column functions for the JSON and argument lists exchanged with a model server, a device and external tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import text_of, trim, valid_id

# Fixed values of the request.
TEMPERATURE, MAX_TOKENS = 0.2, 4096

ITEM = "array<struct<ID:string,VissibleName:string,VisibleName:string,Type:string,Parent:string,fileType:string>>"
COMPLETION = "struct<choices:array<struct<message:struct<content:string>,finish_reason:string>>>"


def listing_items(body: Column) -> Column:
    """Array of (id, name, kind, parent, file_type) of a folder listing; null if the body is no JSON array.

    Items without an id are dropped; of two spellings of the name the first present one counts, and a blank one
    makes the item ``Untitled``.
    """
    raw = F.when(trim(text_of(body)).startswith("["), F.from_json(body, ITEM))

    def item(x: Column) -> Column:
        name = F.coalesce(x["VissibleName"], x["VisibleName"], F.lit(""))
        return F.struct(
            x["ID"].alias("id"),
            F.when(trim(name) == "", F.lit("Untitled")).otherwise(name).alias("name"),
            F.when(x["Type"].eqNullSafe("CollectionType"), F.lit("folder")).otherwise(F.lit("document")).alias("kind"),
            F.coalesce(x["Parent"], F.lit("")).alias("parent"),
            F.coalesce(x["fileType"], F.lit("")).alias("file_type"),
        )

    return F.transform(F.filter(raw, lambda x: F.coalesce(x["ID"], F.lit("")) != ""), item)


def server_model(body: Column) -> Column:
    """The server's model: its alias, else its file's name without ``.gguf``; null if neither is told."""
    path = F.get_json_object(body, "$.model_path")
    return F.coalesce(F.get_json_object(body, "$.model_alias"), F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"(\.gguf)+\z", ""))


def server_vision(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.modalities.vision") == "true", F.lit(False))


def completion(body: Column) -> Column:
    """(text, truncated, error) of a completion; ``error`` says which part is missing."""
    parsed = F.from_json(body, COMPLETION)
    first = F.get(parsed["choices"], 0)
    text = first["message"]["content"]
    unread = ~trim(text_of(body)).startswith("{") | (F.get_json_object(body, "$").isNull())
    error = F.when(unread, F.lit("unreadable")).when(first.isNull(), F.lit("no completion")).when(text.isNull(), F.lit("no content"))
    return F.struct(F.when(error.isNull(), text).alias("text"), (error.isNull() & first["finish_reason"].eqNullSafe("length")).alias("truncated"), error.alias("error"))


def data_url(data: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(data), r"\r?\n", ""))


def chat_request(model: Column, prompt: Column, url: Column) -> Column:
    """A request's JSON: text before image; a null model is left out."""
    parts = F.array(
        F.struct(F.lit("text").alias("type"), prompt.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")),
        F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(url.alias("url")).alias("image_url")),
    )
    return F.to_json(F.struct(
        model.alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), parts.alias("content"))).alias("messages"),
        F.lit(False).alias("stream"),
        F.lit(TEMPERATURE).alias("temperature"),
        F.lit(MAX_TOKENS).alias("max_tokens"),
        F.struct(F.lit(False).alias("enable_thinking")).alias("chat_template_kwargs"),
    ))


def render_command(pdf: Column, width: Column, out: Column) -> Column:
    """Arguments that render a PDF's pages as PNG files."""
    return F.array(F.lit("pdftoppm"), F.lit("-png"), F.lit("-scale-to-x"), width.cast("string"), F.lit("-scale-to-y"), F.lit("-1"), pdf, out)


def page_count_command(pdf: Column) -> Column:
    """Arguments that ask for the number of a PDF's pages."""
    return F.array(F.lit("pdfinfo"), pdf)


def page_count(output: Column) -> Column:
    """The number behind the first ``Pages:`` line that has one."""
    found = F.regexp_extract_all(output, F.lit(r"(?m)^Pages:([^\n]*)$"), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda x: trim(x).try_cast("int")), lambda x: x.isNotNull()), 0)


def page_number(path: Column) -> Column:
    """The number at the end of a rendered file's name, behind its last hyphen; null if there is none."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    return F.regexp_extract(stem, r"-([^-]*)\z", 1).try_cast("bigint")


def download_path(item_id: Column) -> Column:
    """Null for an identifier that could be more than one path segment."""
    return F.when(valid_id(item_id), F.concat(F.lit("/download/"), item_id, F.lit("/placeholder")))


def thumbnail_path(item_id: Column) -> Column:
    return F.when(valid_id(item_id), F.concat(F.lit("/thumbnail/"), item_id))


def is_pdf(data: Column) -> Column:
    return F.coalesce(F.substring(data, 1, 5) == F.lit(b"%PDF-"), F.lit(False))
