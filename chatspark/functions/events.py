"""Kinds and placeholders of platform events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Message kind by low 32 bits of the type, application subtype, and needle in the type's name.
BY_TYPE = {1: "text", 3: "image", 34: "voice", 43: "video", 47: "sticker", 48: "location", 50: "call", 10000: "system"}
BY_SUBTYPE = {5: "link", 6: "file", 19: "forward", 33: "app", 36: "app", 57: "quote", 62: "pat", 2000: "transfer", 2001: "red_packet"}
BY_NAME = [("image", "image"), ("voice", "voice"), ("video", "video"), ("file", "file"), ("link", "link")]
APP = 49


def _lookup(column: Column, table: dict) -> Column:
    return F.coalesce(*[F.when(column == k, v) for k, v in table.items()])


def message_kind(local_type: Column, app_type: Column, type_name: Column, quoted: Column) -> Column:
    """Quote evidence first; then the application subtype (also packed into the high 32 bits of a type whose low bits are 49), the type, the name; else unknown."""
    low, high = local_type.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(local_type, 32)
    sub = F.coalesce(app_type.cast("long"), F.when((low == APP) & (high > 0), high))
    named = F.coalesce(*[F.when(F.contains(F.lower(type_name), F.lit(n)), k) for n, k in BY_NAME])
    return F.coalesce(F.when(quoted, "quote"), F.when(low == APP, _lookup(sub, BY_SUBTYPE)), _lookup(low, BY_TYPE), named, F.lit("unknown"))


def normalized_text(content: Column, kind: Column) -> Column:
    """The trimmed text of text and quotes, else a placeholder."""
    t = F.trim(F.coalesce(content, F.lit("")))
    return F.when(kind.isin("text", "quote") & (t != ""), t).otherwise(F.concat(F.lit("["), kind, F.lit("]")))


def event_identity(platform_id: Column, *parts: Column) -> Column:
    """platform:id, or fallback: and a hash of the parts."""
    known = F.coalesce(platform_id, F.lit("")) != ""
    return F.when(known, F.concat(F.lit("platform:"), platform_id)).otherwise(F.concat(F.lit("fallback:"), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)))
