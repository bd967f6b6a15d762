"""Column functions over text: tokens, blocks, markup, classification, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a hard token (colour, file name, number with unit, back-ticked,
#: quoted, run of Arabic letters, run of kana or CJK).
HARD_TOKEN = r'#[0-9A-Fa-f]{6}|[A-Za-z0-9_-]+\.(?:png|pptx)|\d+(?:\.\d+)?(?:cm|pt|px|mm|%|°|×)|`[^`\n]+`|"[^"\n]+"|[\x{0600}-\x{06ff}]+|[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]+'


def hard_tokens(text: Column) -> Column:
    """Sorted array of the hard tokens."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(HARD_TOKEN), F.lit(0)))


def fenced_blocks(text: Column, fence: str = "```") -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)\Q{fence}\E.*?\Q{fence}\E"), F.lit(0))


def strip_markdown(text: Column) -> Column:
    """Without a leading bold label with its colon and without bold marks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\*\*[^*]+\*\*:\s*", ""), r"\*\*", ""))


def strip_tags(html: Column) -> Column:
    """Text of HTML: scripts and styles out, tags to blanks, white space folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"\s+", " "))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def any_of(text: Column, tokens: tuple[str, ...]) -> Column:
    """Whether the text has any of the tokens."""
    out = F.lit(False)
    for t in tokens:
        out = out | text.contains(t)
    return out


def classify(text: Column, classes: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    """The first class of which the text has a token."""
    out = F.lit(other)
    for name, tokens in reversed(classes):
        out = F.when(any_of(text, tokens), name).otherwise(out)
    return out


def protected_replace(text: Column, words: list[tuple[str, str]], code: str = "`[^`]*`") -> Column:
    """Replaces words in order, but not inside code spans: the spans are cut out, the rest is
    replaced, and both are zipped together again."""
    spans = F.regexp_extract_all(text, F.lit(code), F.lit(0))

    def swap(x):
        for a, b in words:
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    between = F.transform(F.split(text, code, -1), swap)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), spans.alias("b")), lambda z: F.array(F.coalesce(z["a"], F.lit("")), F.coalesce(z["b"], F.lit(""))))), "")


def strip_unicode(text: Column) -> Column:
    """Trims all Unicode white space and the four separators U+001C to U+001F."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def is_utc(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.lit(False)) & F.try_to_timestamp(text).isNotNull()


def exact_ratio(number: Column, divisor: int) -> Column:
    """number / divisor as a plain decimal text without trailing zeros; -0 and nothing are 0."""
    d = (number.cast("decimal(38,18)") / F.lit(divisor).cast("decimal(10,0)")).cast("decimal(38,18)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(d, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain.isin("", "-0"), "0").otherwise(plain)


def parse_boolean(text: Column) -> Column:
    """1/true/on and 0/false/off; null stays null, anything else is an error."""
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(text.isin("1", "true", "on"), True).when(text.isin("0", "false", "off"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def api_key(value: Column) -> Column:
    """prefix and secret of prefix_token_secret."""
    parts = F.split(value, "_", 3)
    return F.struct(F.concat_ws("_", parts[0], parts[1]).alias("prefix"), parts[2].alias("secret"))


def relationship_source(name: Column) -> Column:
    """The part whose relationships a `_rels` part has: a/_rels/b.xml.rels -> a/b.xml."""
    return F.regexp_replace(name, r"(^|/)_rels/([^/]*)\.rels$", "$1$2")


def field_type(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.contains("slidenum"), "slidenum").when(low.contains("datetime"), "datetime").otherwise(kind)
