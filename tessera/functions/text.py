"""Text functions as column expressions: tokens, ids, sanitising, names, keys."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented letters and what they fold to (fixed values).
ACCENTED, FOLDED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Separator of lists kept in one string (fixed value).
SEP = "<SEP>"
#: White space of any kind.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WORD = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def tokens(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def content_id(prefix: str, content: Column) -> Column:
    """Deterministic id of a content: prefix and md5."""
    return F.concat(F.lit(prefix), F.md5(content))


def strip(text: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.btrim(text, F.lit(BLANKS))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def sanitize(text: Column) -> Column:
    """Stripped, without control characters other than tab and line breaks, non-characters and C1 controls; HTML entities unescaped.

    Only texts that hold an ampersand are sent to Python, as only there all names of entities are known."""
    out = strip(text)
    out = F.coalesce(_unescaped(F.when(out.contains("&"), out)), out)
    return strip(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F￾￿]", ""))


#: Full-width forms and dashes, and what they become (fixed values); quotes that may enclose a name, opening and closing.
WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９－＋／＊（）—　"
NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-+/*()- "
ENCLOSING = ('""', "''", "“”", "‘’", "《》")
HAN, LATIN = "[一-龥]", r"[a-zA-Z0-9()\[\]@#$%!&*\-=+_]"


def normalize_name(name: Column, inner_quotes: bool = True) -> Column:
    """An extracted name: paragraph and line-break tags gone, full-width forms narrowed, no blanks beside Chinese characters, enclosing quotes dropped; too short numbers become ''.

    ``inner_quotes``: also without typographic quotes and those that touch Chinese characters."""
    out = F.regexp_replace(name, r"(?i)</p\s*>|<p\s*>|<p/>|</br\s*>|<br\s*>|<br/>", "")
    out = F.translate(out, WIDE, NARROW)
    for before, after in ((HAN, HAN), (HAN, LATIN), (LATIN, HAN)):
        out = F.regexp_replace(out, rf"(?U)(?<={before})\s+(?={after})", "")
    for first, last in ENCLOSING:
        out = F.regexp_replace(out, rf"(?s)^{first}([^{first}{last}]*){last}$", "$1")
    if inner_quotes:
        out = F.regexp_replace(out, rf"[“”‘’]|['\"]+(?={HAN})|(?<={HAN})['\"]+", "")
        out = F.regexp_replace(F.translate(out, "\xa0", " "), r"(?<=[^\d])\u202F", " ")
    out = strip(out)
    return F.when(out.rlike(r"^[0-9]+$") & (F.length(out) < 3), "").when(out.rlike(r"^[0-9]*\.[0-9.]*$") & (F.length(out) < 6), "").otherwise(out)


def truncated(name: Column, most: int = 256) -> Column:
    """An identifier cut to ``most`` characters."""
    return F.substring(name, 1, most)


def facts(said: Column) -> Column:
    """The non-empty facts of a model's JSON answer ({"facts": [...]}), fenced or amid other text; none if there is no such list."""
    bare = F.regexp_replace(F.regexp_replace(strip(F.coalesce(said, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    found = [F.from_json(F.get_json_object(x, "$.facts"), "array<string>") for x in (bare, inner)]
    return F.filter(F.transform(F.coalesce(*found, F.array().cast("array<string>")), strip), lambda x: x != "")


def summary(content: Column, most: int = 250) -> Column:
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)


def pair_key(a: Column, b: Column) -> Column:
    """Key of an undirected pair."""
    return F.concat(F.least(a, b), F.lit(SEP), F.greatest(a, b))


def parts_of(text: Column, markers: str) -> Column:
    """Split on any of a regular expression's markers; trimmed, without empty parts."""
    return F.filter(F.transform(F.split(text, markers), lambda x: F.trim(x)), lambda x: x != "")


def is_number(text: Column) -> Column:
    return text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def without_thoughts(text: Column) -> Column:
    """Without a leading <think> block or, where the text begins otherwise, all up to the last closing tag."""
    return strip(F.regexp_replace(text, r"(?s)^(<think>.*?</think>|.*</think>)", ""))


def cache_key(mode: Column, kind: Column, *parts: Column) -> Column:
    return F.concat_ws(":", mode, kind, F.md5(F.concat(*parts)))


def clamp_percent(x: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(x).cast("int")))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1))


def safe_name(name: Column) -> Column:
    """A file name without path parts and characters that file systems reserve."""
    base = F.regexp_extract(name, r"([^\\/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r'[<>:"|?*\x00-\x1F]', "_"), r"^\.+|[ .]+$", "")


def object_place(url: Column) -> Column:
    """Bucket and key of an object URL."""
    return F.struct(F.regexp_extract(url, r"^s3a?://([^/]+)/", 1).alias("bucket"), F.regexp_extract(url, r"^s3a?://[^/]+/(.*)$", 1).alias("key"))
