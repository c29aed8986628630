"""Display forms of documents, prompts and streamed answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# The display form of found documents.
TABLE_FRAME = "<pre style='white-space: pre-wrap; font-family: monospace;'>"
TEXT_BOX = '<div style="margin-top: 20px; padding: 10px; border: 1px solid #ccc; background-color: #f0f0f0;">'
TABLE_BOX = '<div style="margin-top: 20px; border: 1px solid #ccc; padding: 10px; background-color: #f0f0f0;">'
IMAGE_BOX = '<div style="border: 1px solid #ccc; padding: 10px; background-color: #f0f0f0; width: 100%; margin-top: 20px;">'
IMAGE_STYLE = 'style="width: 50%; height: auto;"'


def table_html(c: Column, always: bool = False) -> Column:
    """A table as it is; other text escaped in a frame that keeps its spaces (with *always* in a table tag instead)."""
    is_table = F.lower(F.trim(c)).startswith("<table")
    if always:
        return F.when(c.startswith("<table"), c).otherwise(F.concat(F.lit("<table>"), c, F.lit("</table>")))
    safe = F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(is_table, c).otherwise(F.concat(F.lit(TABLE_FRAME), safe, F.lit("</pre>")))


def line_breaks(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def score_text(c: Column) -> Column:
    return F.format_string("%.4f", c)


def document_html(kind: Column, content: Column, source: Column, score: Column, place: Column, filename: Column, pages: Column, image: Column, chunk_id: Column) -> Column:
    """A found document as HTML: a heading with its place, score, file and pages, and a box by its type.  *image* is the
    image in base 64.  A table without source and an unknown type have the heading only."""
    lit = F.lit
    head = F.concat(lit("<h4>Document "), place.cast("string"), lit(" (Score: "), score_text(score), lit("), (Doc: "), filename, lit(", Page: "), pages, lit(")</h4>"))
    text = F.concat(lit(TEXT_BOX), line_breaks(content), lit("</div>"))
    table = F.concat(lit(TABLE_BOX), table_html(source), lit("<br><p><strong>Table Summary:</strong> "), content, lit("</p></div>"))
    picture = F.concat(lit(IMAGE_BOX + '<img src="data:image/jpeg;base64,'), image, lit('" alt="Image '), chunk_id.cast("string"), lit(f'" {IMAGE_STYLE} /><p><strong>Image Summary:</strong> '), content, lit("</p></div>"))
    body = F.when(kind == "text", text).when((kind == "table") & (source != ""), table).when(kind == "image", picture).otherwise(lit(""))
    return F.concat(head, body)


def data_uri_bytes(c: Column) -> Column:
    """Bytes of a data URI: what follows the first comma, decoded."""
    return F.unbase64(F.regexp_replace(c, "^[^,]*,", ""))


def data_uri(content: Column, media: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{media};base64,"), F.base64(content))


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")


def with_suffix(c: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(c, r"\.[^./]*$", ""), F.lit(suffix))


def language_folder(c: Column, up: int = 4) -> Column:
    """The part of a path that names the language."""
    parts = F.split(c, "/")
    return F.when(F.size(parts) >= up, F.element_at(parts, -up))


def says_yes(c: Column) -> Column:
    return F.lower(F.trim(c)).contains("yes")


def filled(template: str, **values: Column) -> Column:
    """A prompt with its named places filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def sse_text(line: Column) -> Column:
    """Text of one event line of a streamed answer; null for lines without one.

    Of a JSON object: the content of the first choice's delta, else the choice's text; without choices its text, else its
    first string that is not blank.  Another JSON value, and what is no JSON, is the text itself.
    """
    data = F.trim(F.regexp_extract(F.trim(line), r"(?s)^data:(.*)$", 1))
    keys = F.json_object_keys(data)
    first = F.get_json_object(data, "$.choices[0]")
    chosen = F.coalesce(F.get_json_object(data, "$.choices[0].delta.content"), F.when(~_has(first, "delta") | ~_has(F.get_json_object(first, "$.delta"), "content"), F.get_json_object(first, "$.text")))
    values = F.from_json(data, "map<string,variant>")
    strings = F.filter(F.map_values(values), lambda v: (F.schema_of_variant(v) == "STRING") & (F.trim(F.try_variant_get(v, "$", "string")) != ""))
    other = F.when(_has(data, "text"), F.get_json_object(data, "$.text")).otherwise(F.try_variant_get(F.try_element_at(strings, F.lit(1)), "$", "string"))
    text = F.when(keys.isNotNull(), F.when(first.isNotNull(), chosen).otherwise(other)).otherwise(F.coalesce(F.try_variant_get(F.try_parse_json(data), "$", "string"), data))
    return F.nullif(F.when(data != "[DONE]", text), F.lit(""))


def _has(json: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


# What the log of an ingest says and the progress it stands for; the first that occurs counts.
PROGRESS = [("saving uploaded zip", 5), ("extracting into", 10), ("processing file", 30), ("converting", 30), ("creating chunks", 55), ("embedding", 75), ("insert", 90), ("finished with exit code 0", 100)]
UNKNOWN_PROGRESS = 15


def progress(log: Column) -> Column:
    """Percent that a log, or a line of it, stands for."""
    low = F.lower(F.coalesce(log, F.lit("")))
    out = F.when(low.contains(PROGRESS[0][0]), PROGRESS[0][1])
    for words, percent in PROGRESS[1:]:
        out = out.when(low.contains(words), percent)
    return out.otherwise(UNKNOWN_PROGRESS)


def read_by_ocr(path: Column, languages: tuple[str, ...] = ("hindi",), up: int = 4) -> Column:
    """Whether a file's language folder asks for character recognition."""
    return F.coalesce(F.lower(language_folder(path, up)).isin(*languages), F.lit(False))
