"""Text columns: cleaning, placeholders, diffs, JSON extraction.

What Catalyst can express is a Column; entity decoding, escapes and sequence diffs are Arrow UDFs.
"""

from __future__ import annotations

import difflib
import html
import json
import re
import unicodedata
from functools import reduce
from html.parser import HTMLParser
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: what the results depend on

#: Characters that come in UTF-8 read as Latin-1; "Â" alone is a stray prefix and goes last.
MISREAD = "—–…“”‘’•éèâêîôûöäç"
STRAY = "Â"
#: What filter cleaning takes out, in this order.  Rules for style, script and other tags after the general one can't match any more and are left out.
REMOVED = [
    r"(?i)data:[^;]+;base64,[A-Za-z0-9+/=\s]+",
    r"(?i)\[[^\[\]]*?Image \d+[^\[\]]*?\]",
    r"(?s)/\*.*?\*/",
    r"(?s)<!--.*?-->",
    r"<[^>]+>",
    r"\{\\\*[^{}]*\}",
    r"\{\\\w+[^{}]*\}",
    r"(?s)Normal 0 false false false.*?MicrosoftInternetExplorer4",
    r"mso-[\w\-]+:[^;]+;",
    r"table\.MsoNormalTable\s*\{[^}]+\}",
    r"(?s)/\*.*?\*/",
    r"(?is)Normal\.dotm.*?false false false",
    r"(?i)mso-[^:]+:[^;\"]+;?",
    r"(?i)class=[\"']?Mso\w*[\"']?",
]
#: Punctuation that cleaning rewrites.
PUNCTUATION = {"\u00a0": " ", "\u2013": "-", "\u2014": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"'}
#: Signs of mathematics.
MATH = [
    r"\$[^$]+\$", r"\\\[[\s\S]*?\\\]", r"\\begin\{equation\}[\s\S]*?\\end\{equation\}",
    r"\\frac\{", r"\\sqrt\{", r"\\sum", r"\\int", r"\\lim",
    r"[∀∃∑∫∞≈≃≅≡≤≥√±÷×⋅∠°′″→⇒⇔≈≠∈∉∩∪⊂⊆⊇⊃∅∴∵∝]",
    r"[^\w]\^[^\s]", r"_[^\s\w]",
]
MATH_SIGN = r"[$\\^_∀∃∑∫∞≈≃≅≡≤≥√±÷×⋅∠°′″→⇒⇔≠∈∉∩∪⊂⊆⊇⊃∅∴∵∝]"
#: A tag that holds an image, with the image.
IMAGE = r"(?i)<[^>]+?base64,([^\"'>\s]+)[^>]*>"
#: Tags that the image-preserving form keeps, and all others.
KEPT_TAGS = re.compile(r"(?i)(?P<img><img\s+[^>]*?src=[\"']data:image/[^;]+;base64,[^\"']+[\"'][^>]*?>)|(?P<br><br\s*/?>)|<[^>]*>")
#: Characters of file names and what stands for them.
NAME_CHARS = {"/": "_", "\\": "_", ":": " - ", "*": "_", "?": "_", '"': "'", "<": "(", ">": ")", "|": "_"}
#: Changes of a word diff.
CHANGES = {"replace": "[~~{0}~~ ➝ **{1}**]", "delete": "[~~{0}~~]", "insert": "[**{1}**]"}

_IMAGE = T.StructType([T.StructField("field", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("base64", T.StringType())])
_PLACED = T.StructType([T.StructField("text", T.StringType()), T.StructField("images", T.ArrayType(_IMAGE))])
_SEGMENTS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("segment", T.StringType())]))


def strip_u(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip_u(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def strip_html(c: Column) -> Column:
    """Tags dropped, ends stripped, entities decoded; empty for null."""
    return F.coalesce(unescape(strip_u(F.regexp_replace(c, "<[^>]+>", ""))), F.lit(""))


def sanitize(c: Column) -> Column:
    """Entities decoded again, line ends and tabs (also written out) to spaces, white space squeezed."""
    return squeeze(F.regexp_replace(unescape(c), r"\\r|\\n|\\t", " "))


#: What a text must hold, in any case, for a rule of REMOVED to find something: most texts are spared most rules.
_NEEDED = [";base64,", "image ", "/*", "<!--", "<", "{\\*", "{\\", "normal 0 false", "mso-", "table.msonormaltable", "/*", "normal.dotm", "mso-", "class="]


class _Printable(dict):
    """A table for str.translate that drops characters of category C; filled as characters are met."""

    def __missing__(self, code: int) -> int | None:
        self[code] = found = None if unicodedata.category(chr(code))[0] == "C" else code
        return found


_PRINTABLE = _Printable()


def compat_of(text: str | None) -> str:
    """A text cleaned by the order of steps that filter runs have: bytes beyond ASCII become Latin-1, escapes are read, control characters go."""
    text = text or ""
    folded = text.casefold()
    for needed, pattern in zip(_NEEDED, REMOVED, strict=True):
        if needed in folded:
            shorter = re.sub(pattern, "", text)
            if len(shorter) < len(text):
                text, folded = shorter, shorter.casefold()
    text = html.unescape(text).encode("utf-8").decode("unicode_escape", errors="backslashreplace")
    for sign, plain in PUNCTUATION.items():
        text = text.replace(sign, plain)
    return re.sub(r" +", " ", re.sub(r"[\x00-\x1f\x7f]", "", text)).strip()


@F.pandas_udf(T.StringType())
def sanitize_compat(s: pd.Series) -> pd.Series:
    return s.map(compat_of)


def sanitize_clean(c: Column) -> Column:
    """What the cleaning means: tags to spaces, entities and smart punctuation in plain form, white space squeezed; empty for null."""
    bare = unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    return squeeze(reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), PUNCTUATION.items(), bare))


def misread(sign: str) -> str:
    return sign.encode().decode("latin-1")


def fix_mojibake(c: Column) -> Column:
    pairs = [(misread(sign), sign) for sign in MISREAD] + [(STRAY, "")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def without_illegal(c: Column) -> Column:
    """Without the control characters that XML forbids."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


@F.pandas_udf(T.StringType())
def safe_decode(s: pd.Series) -> pd.Series:
    """Bytes as UTF-8, with U+FFFD where they are none."""
    return s.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="replace"))


def _lines(text: str) -> str:
    """At most one empty line, single blanks, none at the ends of lines."""
    return re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)))


def web_text(text: str | None, keep_images: bool = False) -> str:
    """A text for a web page: printable ASCII, line ends that were written out as <br>; with images, their tags stay between line breaks."""
    text = html.unescape(text or "")
    for sign in MISREAD:
        text = text.replace(misread(sign), sign)
    text = text.replace(STRAY, "").translate(_PRINTABLE)
    text = re.sub(r"\\r\\n|\\r|\\n", "\n", text).replace("\\t", "&nbsp;" * 4)

    def put(m: re.Match) -> str:
        if not keep_images:
            return ""
        return f"<br>{m['img']}<br>" if m["img"] else "<br>" if m["br"] else ""

    def ascii_only(t: str) -> str:
        return re.sub(r"[^\x20-\x7E\n]", "", t.replace("\xa0", " "))

    # without images characters go before tags do, with them after
    text = ascii_only(KEPT_TAGS.sub(put, text)) if keep_images else KEPT_TAGS.sub(put, ascii_only(text))
    return _lines(text).replace("\n", "<br>").strip()


@F.pandas_udf(T.StringType())
def for_web(s: pd.Series) -> pd.Series:
    return s.map(web_text)


@F.pandas_udf(T.StringType())
def for_web_with_images(s: pd.Series) -> pd.Series:
    return s.map(lambda t: web_text(t, keep_images=True))


def viewer_text(text: str | None) -> str | None:
    """A text for the desktop viewer: escapes are read, '[... Image n]' stays as it is; null for broken escapes."""
    parts = re.split(r"(\[[^\[\]]+? Image \d+\])", text or "")
    held = "".join(p if k % 2 == 0 else f"\x1e{k}\x1e" for k, p in enumerate(parts))
    try:
        plain = re.sub(r"<[^>]+?>", "", html.unescape(held)).encode("utf-8").decode("unicode_escape")
    except UnicodeDecodeError:
        return None
    plain = _lines(plain.replace("\r\n", "\n").replace("\r", "\n"))
    for k in range(1, len(parts), 2):
        plain = plain.replace(f"\x1e{k}\x1e", parts[k])
    return plain.strip()


@F.pandas_udf(T.StringType())
def for_viewer(s: pd.Series) -> pd.Series:
    return s.map(viewer_text)


class _Strings(HTMLParser):
    """The texts of a page, without those of scripts, styles and templates."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.silent += tag in ("script", "style", "template")

    def handle_endtag(self, tag) -> None:
        self.silent -= tag in ("script", "style", "template") and self.silent > 0

    def handle_data(self, data) -> None:
        if not self.silent:
            self.found.append(data)


def page_text(page: str | None) -> str:
    parser = _Strings()
    parser.feed(page or "")
    parser.close()
    return re.sub(r"\s+", " ", html.unescape(" ".join(parser.found))).strip()


@F.pandas_udf(T.StringType())
def parsed_text(s: pd.Series) -> pd.Series:
    """The text of a page as a parser reads it, white space squeezed."""
    return s.map(page_text)


def remove_control(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{C}", "")


def plain_text(c: Column) -> Column:
    """The text of a page: scripts, styles and tags to spaces, entities decoded, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    return squeeze(unescape(bare))


@F.pandas_udf(_PLACED)
def image_placeholders(field: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Inline images replaced by '[<field> Image n]', and their data."""

    def one(name: str, value: str | None) -> dict:
        images: list[dict] = []

        def put(m: re.Match) -> str:
            images.append({"field": name, "index": len(images) + 1, "base64": m[1]})
            return f"[{name} Image {len(images)}]"

        return {"text": re.sub(IMAGE, put, value or ""), "images": images}

    return pd.DataFrame([one(f, t) for f, t in zip(field, text, strict=True)], columns=["text", "images"])


def shortened(words: list[str], context: int) -> list[str]:
    """A run of words, its middle as '...' where it has more than `context` at both ends; whole for a context of 0."""
    return words if context <= 0 or len(words) <= 2 * context else words[:context] + ["..."] + words[-context:]


def word_diff_of(old: str | None, new: str | None, context: int = 3) -> str:
    before, after = (old or "").split(), (new or "").split()
    steps = difflib.SequenceMatcher(None, before, after).get_opcodes()
    marked = ([CHANGES[tag].format(" ".join(before[i:j]), " ".join(after[k:m]))] if tag in CHANGES else shortened(before[i:j], context) for tag, i, j, k, m in steps)
    return " ".join(chain.from_iterable(marked))


@F.pandas_udf(T.StringType())
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Words that went and came between two texts, long equal runs shortened."""
    return pd.Series([word_diff_of(a, b) for a, b in zip(old, new, strict=True)])


@F.pandas_udf(_SEGMENTS)
def char_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Character segments by tag, for marking."""

    def one(a: str | None, b: str | None) -> list[dict]:
        a, b = a or "", b or ""
        return [{"tag": t, "segment": a[i:j] if t == "delete" else b[k:m]} for t, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes()]

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


def signed_delta(before: Column, now: Column) -> Column:
    """'+N' or '-N' between two scores; empty where one isn't an integer."""
    a, b = (F.try_cast(c, "int") if hasattr(F, "try_cast") else c.try_cast("int") for c in (before, now))
    d = b - a
    return F.when(d.isNull(), "").otherwise(F.concat(F.when(d >= 0, "+").otherwise("-"), F.abs(d).cast("string")))


def mathiness(c: Column) -> Column:
    """Signs of mathematics for each digit of the text's length; 0 for none."""
    some = F.regexp_like(c, F.lit(MATH_SIGN))  # each sign has one of these; most texts have none
    found = F.when(some, F.regexp_count(c, F.lit("(?U)" + "|".join(MATH)))).otherwise(0)
    return F.coalesce(F.when(F.length(c) > 0, found / F.greatest(F.lit(1.0), F.log10(F.length(c) + 1))), F.lit(0.0))


def first_json(text: str | None) -> str | None:
    """The first braces up to the first closing one, missing braces being put at the ends first; null if it isn't JSON."""
    text = text or ""
    more = text.count("{") - text.count("}")
    m = re.search(r"\{.*?\}", "{" * -more + text + "}" * more, re.DOTALL)
    try:
        return json.dumps(json.loads(m[0])) if m else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def extract_json(s: pd.Series) -> pd.Series:
    return s.map(first_json)


def _braces(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def greedy_json(c: Column, schema: str) -> Column:
    """The outermost braces as a struct of a schema; null where they are missing or broken."""
    found = _braces(c)
    return F.when(F.try_parse_json(found).isNotNull(), F.from_json(found, schema))


def verdict_json(c: Column, schema: str) -> Column:
    """answer (greedy_json), and error and raw where there is none."""
    found = _braces(c)
    missing, broken = found.isNull(), found.isNotNull() & F.try_parse_json(found).isNull()
    error = F.when(missing, "No JSON found in response").when(broken, "not valid JSON")
    return F.struct(greedy_json(c, schema).alias("answer"), error.alias("error"), F.when(missing, c).alias("raw"))


def chosen_answer(long: Column, short: Column) -> Column:
    """The long answer without white space around it, else the short one."""
    return F.coalesce(F.nullif(strip_u(long), F.lit("")), strip_u(short))


def safe_name(c: Column, most: int = 160) -> Column:
    """A file name: path characters replaced, white space squeezed, cut; NULL for null and for nothing."""
    plain = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), NAME_CHARS.items(), c.cast("string"))
    cut = F.regexp_replace(F.substring(squeeze(plain), 1, most), r"(?U)\s+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("NULL"))


def shown(c: Column, most: int) -> Column:
    """A text cut for display."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


@F.pandas_udf(T.StringType())
def without_categories_c(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.translate(_PRINTABLE))
