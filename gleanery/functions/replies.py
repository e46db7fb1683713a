"""Replies of a vision model as records: labelled lines first, then JSON, whole or broken, then the bare text; echoes of the prompt are dropped.

All are column expressions. Lengths count code points. In a list of valid JSON, a null element is dropped and an object stands as its JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.vectors import col, let

FIELDS = ("caption", "subjects", "text", "tags")
#: Longest caption recovered from a reply without fields, items of a list, distinct captions looked at and joined.
CAPTION, ITEMS, CAPTIONS, JOINED = 240, 16, 3, 2
#: Parts of the prompt's own descriptions, which a model sometimes echoes.
HINTS = (
    "the action taking place, the feeling or mood, the situation it is used to react to, and why it is funny",
    "the feeling or mood",
    "the situation it is used to react to",
    "the real-life situation you would send it to react to",
    "the real-life situation or feeling you would send it to react to",
    "how a person would search for this meme",
    "do not tag generic appearance",
    "name the meaning instead",
    "covering every searchable facet",
    "a visual recognizer suggests",
    "text visible in the image",
    "leave blank if none",
    "main people, characters, or objects",
    "comma-separated",
    "lowercase keywords",
)
LIST = "array<string>"
#: A JSON string's inside, without backtracking.
STRING = r"[^\"\\]*+(?:\\.[^\"\\]*+)*+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def junk(text: Column) -> Column:
    """An empty value, a placeholder in angle brackets, or an echo of the prompt."""
    low = F.lower(text)
    echo = F.lit(False)
    for hint in HINTS:
        echo = echo | F.contains(low, F.lit(hint))
    return (trimmed(text) == "") | trimmed(text).rlike(r"\A<.*>\z") | echo


def cleaned(text: Column) -> Column:
    """A value without the quotes, brackets and stars around it; empty for junk."""
    return let(F.regexp_replace(text, r"^[\s\"'`*\[\]]+|[\s\"'`*\[\]]+$", ""), lambda v: F.when(junk(v), "").otherwise(v))


def listed(text: Column) -> Column:
    """Up to ITEMS clean values between commas, semicolons and line ends."""
    parts = F.slice(F.filter(F.transform(F.split(text, r"[,;\n]+"), cleaned), lambda v: v != ""), 1, ITEMS)
    return F.when(junk(text), F.array().cast(LIST)).otherwise(parts)


def labelled(reply: Column) -> Column:
    """A struct of FIELDS from lines ``LABEL: value``; a line without a label goes on with the field before it. Null without any labelled line."""
    line_of = rf"(?i)^\s*({'|'.join(FIELDS)})\s*[:\-]\s*(.*)$"
    lines = F.filter(F.split(reply, r"\r?\n"), lambda x: ~x.rlike(r"^\s*```"))
    named = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, line_of, 1)).alias("label"), F.when(x.rlike(line_of), trimmed(F.regexp_extract(x, line_of, 2))).otherwise(trimmed(x)).alias("value")))
    empty = F.struct(F.lit("").alias("current"), *[F.lit("").alias(f) for f in FIELDS])

    def step(acc: Column, line: Column) -> Column:
        current = F.when(line["label"] != "", line["label"]).otherwise(acc["current"])
        joined = lambda f: F.when((current == f) & (line["value"] != ""), F.concat(acc[f], F.when(acc[f] == "", "").otherwise(" "), line["value"])).otherwise(acc[f])
        return F.struct(current.alias("current"), *[joined(f).alias(f) for f in FIELDS])

    found = let(F.aggregate(named, empty, step), lambda a: F.when(a["current"] != "", F.struct(*[a[f].alias(f) for f in FIELDS])))
    return found


def _decoded(inside: Column) -> Column:
    """A JSON string's value from what is between its quotes; null if it isn't one."""
    return trimmed(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), inside, F.lit('"'))), "$", "string"))


def _sound(text: Column) -> Column:
    return F.when(text.isNotNull() & ~junk(text), text)


def string_field(reply: Column, name: str) -> Column:
    """A field's string in JSON that may be broken elsewhere; null if there is none."""
    return let(_decoded(F.regexp_extract(reply, rf'"{name}"\s*:\s*"({STRING})"', 1)), _sound)


def array_field(reply: Column, name: str) -> Column:
    """A field's strings in JSON that may be cut anywhere."""
    inside = F.regexp_extract(reply, rf'"{name}"\s*:\s*\[([^\]]*)', 1)
    strings = F.transform(F.regexp_extract_all(inside, F.lit(f'"({STRING})"'), 1), _decoded)
    return F.slice(F.filter(strings, lambda s: s.isNotNull() & ~junk(s)), 1, ITEMS)


def _without_json(reply: Column) -> Column:
    for pattern in (r"<[^>]*>", r'(?i)"(?:caption|subjects|text|tags)"\s*:', r'[{}\[\]"]', r"[,:]+", r"\s+"):
        reply = F.regexp_replace(reply, pattern, " ")
    return trimmed(reply)


def from_json(reply: Column) -> Column:
    """A record from JSON wrapped in prose, cut or broken; a reply without any is a caption."""
    begin = F.instr(reply, "{")
    stretch = F.regexp_extract(reply, r"(?s)\{.*\}", 0)

    def fields(tree: Column) -> Column:
        kind = lambda name: F.schema_of_variant(F.try_variant_get(tree, f"$.{name}", "variant"))
        whole = lambda name: F.when(kind(name) == "STRING", _sound(trimmed(F.try_variant_get(tree, f"$.{name}", "string"))))
        items = lambda name: F.slice(F.filter(F.transform(F.coalesce(F.try_variant_get(tree, f"$.{name}", LIST), F.array().cast(LIST)), trimmed), lambda s: s.isNotNull() & ~junk(s)), 1, ITEMS)
        lists = lambda name: F.when(F.coalesce(F.startswith(kind(name), F.lit("ARRAY")), F.lit(False)), items(name)).when(kind(name).isNotNull(), F.array().cast(LIST)).otherwise(array_field(reply, name))
        looks = (begin > 0) | reply.rlike('"(?:caption|subjects|text|tags)"')
        bare = F.substring(F.when(looks, _without_json(reply)).otherwise(trimmed(F.regexp_replace(reply, r"\s+", " "))), 1, CAPTION)
        caption = F.coalesce(whole("caption"), string_field(reply, "caption"), bare)
        return F.struct(caption.alias("caption"), lists("subjects").alias("subjects"), F.coalesce(whole("text"), string_field(reply, "text"), F.lit("")).alias("text"), lists("tags").alias("tags"))

    return let(F.try_parse_json(stretch), fields)


def parsed(reply: Column | str) -> Column:
    """struct<caption, subjects, text, tags> of any reply; a null reply is empty."""

    def record(text: Column) -> Column:
        lines = lambda f: F.struct(cleaned(f["caption"]).alias("caption"), listed(f["subjects"]).alias("subjects"), cleaned(f["text"]).alias("text"), listed(f["tags"]).alias("tags"))
        return let(labelled(text), lambda f: F.when(f.isNotNull(), lines(f)).otherwise(from_json(text)))

    return let(trimmed(F.coalesce(col(reply), F.lit(""))), record)


def _plain(text: Column | str) -> Column:
    return trimmed(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+", " "))


def alike(caption_a: Column | str, text_a: Column | str, caption_b: Column | str, text_b: Column | str) -> Column:
    """Two frames say the same: equal writing, and captions of which one contains the other."""
    a, b = _plain(caption_a), _plain(caption_b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)) & (_plain(text_a) == _plain(text_b))
