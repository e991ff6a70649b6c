"""Text and address projections as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def normal_url(url: Column) -> Column:
    """Scheme, leading www./m. and fragment dropped, host lower-cased, tracking parameters and a closing slash removed."""
    u = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[a-z]+://", "")
    u = F.regexp_replace(u, r"^(www|m)\.", "")
    host = F.lower(F.regexp_extract(u, "^[^/?]*", 0))
    rest = F.regexp_replace(F.substring(u, F.length(host) + 1, F.length(u)), r"([?&])(utm_[a-z]+|ref|fbclid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&+", "&"), r"\?&", "?")
    return F.concat(host, F.regexp_replace(rest, "[?&/]+$", ""))


def redacted(text: Column) -> Column:
    """E-mails, phone numbers, links and handles become marks of their kind."""
    t = F.regexp_replace(text, r"https?://[^ \t\r\n]+", "[LINK]")
    t = F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    t = F.regexp_replace(t, r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[PHONE]")
    return F.regexp_replace(t, r"@[A-Za-z0-9_]{3,}", "[HANDLE]")


def excerpt(text: Column, limit: int = 300) -> Column:
    """At most limit characters without tags, cut at a word, with an ellipsis; null where nothing is left."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    cut = F.regexp_replace(F.substring(t, 1, limit - 1), " [^ ]*$", "")
    return F.when(F.length(t) == 0, None).when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))


def fold(key: Column, folds: int = 5) -> Column:
    """The fold of a key by its SHA-256: the sum of its hex digits, which equals the number modulo 5."""
    digits = F.transform(F.split(F.sha2(key.cast("string"), 256), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.pmod(F.aggregate(digits, F.lit(0), lambda a, x: a + x), F.lit(folds))


def account_ref(name: Column, salt: str, platform: str) -> Column:
    """An account as a salted hash under its platform's label."""
    return F.concat(F.lit(f"{platform}:"), F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), name.cast("string")), 256), 1, 16))


def parsed_time(text: Column) -> Column:
    """A time in ISO or mail format, without a zone as UTC; null where it is neither."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "EEE, d MMM yyyy HH:mm:ss Z"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats[:3]], F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")))


def local_iso(seconds: Column, hours: int = 6) -> Column:
    """Seconds since 1970 as local ISO time with its offset."""
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(seconds) + hours * 3600), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"+{hours:02d}:00"))


def answer(reply: Column) -> Column:
    """struct(p, label) of the first JSON object in a reply: p clamped to 0.01..0.99, an unknown label is unverified."""
    read = F.from_json(F.regexp_extract(reply, r"(?s)\{.*?\}", 0), "p double, label string")
    known = ["verified", "refuted", "conflicting", "partially_verified", "unverified", "insufficient_evidence"]
    p = F.least(F.greatest(F.coalesce(read["p"], F.lit(0.5)), F.lit(0.01)), F.lit(0.99))
    return F.struct(p.alias("p"), F.when(read["label"].isin(known), read["label"]).otherwise("unverified").alias("label"))


def keyed_hash(key: str, message: Column) -> Column:
    """The HMAC-SHA256 of a text, as hex: what a rate limit keeps of an address."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    pads = {pad: F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C)}
    return F.sha2(F.concat(pads[0x5C], F.unhex(F.sha2(F.concat(pads[0x36], F.encode(message, "UTF-8")), 256))), 256)
