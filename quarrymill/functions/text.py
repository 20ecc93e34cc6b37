"""Scalar functions over text as Column expressions. White space follows Unicode and includes U+001C-U+001F."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = r"[\s\x1c-\x1f]"
ROOT = "(root)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_W}+|{_W}+$", "")


def collapse(c: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return F.regexp_replace(strip(c), rf"(?U){_W}+", " ")


def entity_key(name: Column) -> Column:
    return collapse(F.lower(name))


def entity_id(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), entity_key(name))


def chunk_id(doc: Column, index: Column) -> Column:
    return F.concat_ws("#", doc, index.cast("string"))


def cite_hex(chunk: Column) -> Column:
    return F.substring(F.sha1(chunk), 1, 12)


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(collapse(text), " "), lambda w: w != ""))


def path_of(stack: Column) -> Column:
    return F.when(F.size(stack) == 0, F.lit(ROOT)).otherwise(F.array_join(stack, " > "))


def segments(path: Column) -> Column:
    parts = F.filter(F.transform(F.split(path, ">"), strip), lambda x: x != "")
    return F.when(path.isNull() | (strip(path) == ROOT), F.array().cast("array<string>")).otherwise(parts)


def norm(text: Column) -> Column:
    """Lower case, plain dashes and quotes, white space collapsed."""
    return collapse(F.translate(F.lower(F.coalesce(text, F.lit(""))), "–—’‘“”", "--''\"\""))


def squash(text: Column) -> Column:
    return F.regexp_replace(norm(text), r"[^\p{L}\p{N}]", "")


def label_number(text: Column) -> Column:
    """One to three digits, perhaps followed by dots or brackets: their number; else null."""
    t = strip(F.regexp_replace(strip(text), r"[.)]+$", ""))
    return F.when(t.rlike(r"^[0-9]{1,3}$"), t.try_cast("int"))


def plain_heading(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\uF000-\\uF0FF]", ""))


def visible_bullets(text: Column) -> Column:
    return F.regexp_replace(text, "[\\uF000-\\uF0FF]", "•")


def section_depth(text: Column) -> Column:
    """How many numbers a heading's first word has, such as 2 for "4.1 Scope" or "4.1. Scope"; null unless it is numbers with dots
    between them, and a word follows."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    numbers = F.split(F.regexp_replace(F.get(words, 0), r"\.$", ""), r"\.")
    return F.when((F.size(words) > 1) & F.forall(numbers, lambda n: n.rlike("^[0-9]+$")), F.size(numbers))


def header_like(cells: Column, most_words: int = 4) -> Column:
    """A row that names columns: every cell filled, short, and not a number."""

    def names(c: Column) -> Column:
        t = strip(F.coalesce(c, F.lit("")))
        return (t != "") & (word_count(t) <= most_words) & ~F.regexp_replace(t, "[., ]", "").rlike(r"^\d+$")

    return F.forall(cells, names)


#: Fixed ranges: hiragana and katakana, CJK extension A, unified ideographs, compatibility ideographs, hangul, supplementary.
CJK = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\uAC00-\\uD7AF\\x{20000}-\\x{2FA1F}"


def drop_stray_glyphs(text: Column) -> Column:
    """Without CJK characters that have no CJK neighbour across white space."""
    alone = rf"(?<![{CJK}])(?<![{CJK}]\s{{1,20}})[{CJK}](?!\s*[{CJK}])"
    return F.when(text.rlike(f"[{CJK}]"), F.replace(F.regexp_replace(text, alone, ""), F.lit("  "), F.lit(" "))).otherwise(text)


def slide_text(text: Column, headings: Column, path: Column) -> Column:
    """A fragment's own words: lines that are a heading, the chain of headings or its path go; white space collapsed."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    own = F.filter(lines, lambda t: (t != "") & (t != F.array_join(headings, " > ")) & ~F.array_contains(headings, t) & ~t.eqNullSafe(path))
    return collapse(F.array_join(own, " "))


#: Layout labels and the kinds of block they become.
KINDS = {
    "title": "heading",
    "section_header": "heading",
    "list_item": "list_item",
    "table": "table",
    "picture": "picture",
    "caption": "caption",
    "code": "code",
    "formula": "code",
    "document_index": "toc",
    "text": "paragraph",
    "paragraph": "paragraph",
    "footnote": "paragraph",
    "reference": "paragraph",
}


def kind_for(label: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.lower(label)), F.lit("other"))


def json_payload(reply: Column) -> Column:
    """A model's reply without its thoughts and code fences."""
    said = F.regexp_replace(reply, r"(?s)^.*</think>", "")
    return strip(F.regexp_replace(strip(said), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Name, least similarity, weight; from the highest band.
BANDS = [("high", 0.85, 1.0), ("medium", 0.75, 0.5), ("low", 0.65, 0.2)]


def band_of(similarity: Column, bands=BANDS) -> Column:
    out = F.when(F.isnan(similarity), F.lit(None))
    for name, low, _ in bands:
        out = out.when(similarity >= low, F.lit(name))
    return out


def weight_of(band: Column, bands=BANDS) -> Column:
    out = F.lit(None).cast("double")
    for name, _, weight in reversed(bands):
        out = F.when(band == name, F.lit(weight)).otherwise(out)
    return out


def now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# --- boxes [x0, y0, x1, y1], y up -------------------------------------------------------------------------------------


def upright(box: Column) -> Column:
    """(left, upper, right, lower) whichever way the axis runs."""
    return F.struct(F.least(box[0], box[2]).alias("left"), F.greatest(box[1], box[3]).alias("upper"), F.greatest(box[0], box[2]).alias("right"), F.least(box[1], box[3]).alias("lower"))


def in_margin(box: Column, height: Column, share: float = 0.12) -> Column:
    return F.coalesce((F.least(box[1], box[3]) < share * height) | (F.greatest(box[1], box[3]) > (1 - share) * height), F.lit(False)) & (F.coalesce(height, F.lit(0.0)) > 0)


def wrapped(first: Column, second: Column) -> Column:
    """Two boxes are lines of one heading: like heights, the second right under the first, the same left edge."""
    h1, h2 = first[3] - first[1], second[3] - second[1]
    gap = first[1] - second[3]
    ok = (h1 > 0) & (h2 > 0) & (F.abs(h1 - h2) <= 0.2 * F.greatest(h1, h2)) & (gap >= -0.2 * h1) & (gap <= 0.8 * h1) & (F.abs(first[0] - second[0]) <= h1)
    return F.coalesce(ok, F.lit(False))


# --- what needs a scan of characters ----------------------------------------------------------------------------------


def _half(x: int) -> bool:
    return 0x20 <= x <= 0x7E or 0xA0 <= x <= 0xFF


def pair(ch: str) -> str | None:
    """The two Latin-1 characters whose bytes make up this character's code, if they do."""
    o = ord(ch)
    if not 0x2000 <= o <= 0xFFFF or 0xD800 <= o <= 0xDFFF:
        return None
    return chr(o >> 8) + chr(o & 0xFF) if _half(o >> 8) and _half(o & 0xFF) else None


def is_pair_decoded(text: str) -> bool:
    """Most characters beyond U+2BFF (private use aside) are two Latin-1 bytes read as one."""
    wide = [c for c in text if ord(c) > 0x2BFF and not 0xE000 <= ord(c) <= 0xF8FF]
    return len(wide) >= 2 and sum(pair(c) is not None for c in wide) >= 0.95 * len(wide)


def undo_pairs(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if ord(text[i]) > 0x2BFF and pair(text[i]):
            j = last = i
            while j < len(text) and (pair(text[j]) or text[j] in " \t\n"):
                last = j if ord(text[j]) > 0x2BFF and pair(text[j]) else last
                j += 1
            run = text[i : last + 1]
            plain = "".join(pair(c) or c for c in run)
            wide = sum(ord(c) > 0x2BFF and pair(c) is not None for c in run)
            latin = sum(c.isalpha() or c.isspace() or c.isascii() and c.isalnum() for c in plain)
            out.append(plain if wide >= 2 and latin >= 0.7 * len(plain) else run)
            i = last + 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def find_word(hay: str, needle: str, start: int = 0, taken=()) -> int:
    """First place from start on at which needle stands as whole words and that isn't taken; -1 if none."""
    at = hay.find(needle, start)
    while at >= 0:
        end = at + len(needle)
        if at not in taken and not hay[at - 1 : at].isalnum() and not hay[end : end + 1].isalnum():
            return at
        at = hay.find(needle, at + 1)
    return -1


@F.pandas_udf(T.BooleanType())
def pair_decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else is_pair_decoded(t))


@F.pandas_udf(T.StringType())
def pairs_undone(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else undo_pairs(t))


@F.pandas_udf(T.IntegerType())
def word_place(hay: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or n is None else find_word(h, n) for h, n in zip(hay, needle, strict=True)], dtype="Int32")


def repair(text: Column) -> Column:
    """Pair-decoded texts put right; others, and the Python for them, are passed over."""
    wide = text.rlike("[\\u2C00-\\uDFFF\\uF900-\\uFFFF]")
    return F.when(F.coalesce(wide, F.lit(False)), F.when(pair_decoded(text), pairs_undone(text)).otherwise(text)).otherwise(text)
