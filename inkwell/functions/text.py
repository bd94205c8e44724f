"""Scalar functions over text columns, all of them expressions of built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width characters and what they stand for, brackets and quotes of entity names.
FULL_WIDTH = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ（）．，：；！？－～　"
HALF_WIDTH = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz(),.:;!?-~ "
BRACKET_SUFFIX = "[（(][^（）()]*[）)]$"
QUOTES = "[\"'‘’「」『』【】《》]"


def entity_name(name: Column) -> Column:
    """Half-width characters, no bracketed suffix, no quotes, single spaces."""
    text = F.translate(F.coalesce(name, F.lit("")), FULL_WIDTH, HALF_WIDTH)
    text = F.regexp_replace(F.regexp_replace(text, BRACKET_SUFFIX, ""), QUOTES, "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def joined(a: Column, b: Column) -> Column:
    """Two remarks as one: the longer if it holds the other, else both with ``；`` between."""
    a, b = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    return F.when(b == "", a).when(a == "", b).when(a.contains(b), a).when(b.contains(a), b).otherwise(F.concat(a, F.lit("；"), b))


def joined_all(remarks: Column, most: int | None = None) -> Column:
    """``joined`` folded over an ordered array, cut to ``most`` characters."""
    text = F.aggregate(remarks, F.lit(""), joined)
    return F.substring(text, 1, most) if most else text


def without_thoughts(text: Column) -> Column:
    """A model's answer without its ``<think>`` blocks and code fences."""
    text = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(text, r"(?m)^```\w*\s*$", ""))


def json_array(text: Column) -> Column:
    """The strings of the first JSON array in a noisy text; null if there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<string>")


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def hide(text: Column, start: int, end: int) -> Column:
    """Characters from start to end (0-based, end excluded) as stars; empty if the text ends before start."""
    size = F.length(text)
    stop = F.least(F.lit(end), size)
    stars = F.repeat(F.lit("*"), F.greatest(stop - start, F.lit(0)))
    masked = F.concat(F.substring(text, 1, start), stars, F.substring(text, F.lit(end + 1), F.greatest(size - end, F.lit(0))))
    return F.when((size == 0) | (size < start) | text.isNull(), "").otherwise(masked)


# What of a name, a card or an address stays readable.
MASKS = {
    "name": (r"(\S)\S(\S*)", "$1*$2"),
    "id_card": (r"(\d{4})\d{10}(\d{3}[Xx]|\d{4})", "$1** **** ****$2"),
    "phone": (r"(\d{3})\d{4}(\d{4})", "$1****$2"),
    "email": (r"(^.)[^@]*(@.*$)", "$1****$2"),
    "bank_card": (r"\d{15}(\d{3})", "**** **** **** **** $1"),
}


def mask(text: Column, kind: str) -> Column:
    """Masked by kind: those of ``MASKS``, password (all stars) or plate (by its length of 7 or 8)."""
    if kind == "password":
        return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").otherwise(F.repeat(F.lit("*"), F.length(text)))
    if kind == "plate":
        masked = F.when(F.length(text) == 7, hide(text, 3, 6)).when(F.length(text) == 8, hide(text, 3, 7)).otherwise(text)
        return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").otherwise(masked)
    return F.regexp_replace(text, *MASKS[kind])


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?<=[a-z0-9])([A-Z])", "_$1"))


def camel_case(text: Column) -> Column:
    parts = F.split(F.lower(text), "_")
    later = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.initcap(x))
    return F.concat(F.element_at(parts, 1), F.array_join(later, ""))


def between_last(text: Column, opening: str, closing: str) -> Column:
    """What stands between the first ``opening`` and the last ``closing`` behind it; null without both."""
    start = F.instr(text, opening) + len(opening)
    rest = F.expr("1") * start
    tail = F.substring(text, rest, F.length(text))
    cut = F.length(tail) - F.instr(F.reverse(tail), closing[::-1]) - len(closing) + 1
    ok = (F.instr(text, opening) > 0) & (F.instr(tail, closing) > 0)
    return F.when(ok, F.substring(tail, F.lit(1), cut))


def to_list(text: Column, separator: str = ",") -> Column:
    """Trimmed parts that aren't blank."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def path_matches(path: Column, pattern: str) -> Column:
    """``?`` one character, ``*`` any but a slash, ``**`` any."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        c = pattern[k]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\Q" + c + "\\E"
        k += 1
    return path.rlike(f"^{out}$")


def decode_labels(values: Column, expression: str, separator: str = ",") -> Column:
    """Labels of the values by an expression ``0=low,1=high``, in the expression's order."""
    pairs = [p.split("=", 1) for p in expression.split(",")]
    wanted = F.split(values, separator)  # a common subexpression: split once for all labels
    found = F.concat_ws(separator, *[F.when(F.array_contains(wanted, k), F.lit(v)) for k, v in pairs])
    return F.when(values.isNotNull(), found)


def encode_labels(labels: Column, expression: str, separator: str = ",") -> Column:
    """The values of labels, in the expression's order."""
    return decode_labels(labels, ",".join("=".join(reversed(p.split("=", 1))) for p in expression.split(",")), separator)


def fill_template(template: str, *values: Column) -> Column:
    """The template with each ``{}`` replaced by the next value; what has no value stays; ``\\{}`` is a plain ``{}``."""
    parts, left = [], list(values)
    pieces = template.split("{}")
    for k, piece in enumerate(pieces):
        escaped = piece.endswith("\\")
        parts.append(F.lit(piece[:-1] if escaped and k < len(pieces) - 1 else piece))
        if k < len(pieces) - 1:
            parts.append(F.lit("{}") if escaped or not left else F.coalesce(left.pop(0).cast("string"), F.lit("null")))
    return F.concat(*parts)


def json_object(text: Column, schema: str) -> Column:
    """The object of a noisy text: the text itself, else what stands in a code fence, else from the first brace to the last."""
    plain = F.trim(without_thoughts(text))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    read = lambda c: F.when(F.get_json_object(c, "$").isNotNull() & c.startswith("{"), F.from_json(c, schema))
    return F.coalesce(read(plain), read(fenced), read(braced))


def string_list(text: Column) -> Column:
    """The strings of a model's JSON list: of the text itself, else of a code fence, else from the first bracket to the last."""
    plain = F.trim(without_thoughts(text))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    braced = F.regexp_extract(plain, r"(?s)(\[.*\])", 1)
    read = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>"))
    return F.coalesce(read(plain), read(fenced), read(braced))
