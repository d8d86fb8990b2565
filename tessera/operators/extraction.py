"""Entities and relations out of what a model says: records of marked fields, mended, cleaned and checked.

Every record passes one Arrow batch; texts that need no mending or cleaning pass by a glance at their characters.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions.text import ENCLOSING, HAN, LATIN, NARROW, WIDE
from tessera.plans.staging import spread

#: The mark between fields, and how it comes back damaged, in order of repair; what ends an output (fixed patterns).
MARK, END = "<|#|>", "<|COMPLETE|>"
DAMAGED = (
    r"<\|#\|*?#\|>", r"<\|\\#\|>", r"<\|+>", r"<.?\|#\|.?>", r"<\|?#\|?>", r"<[^|]#\|>|<\|#[^|]>", r"<\|#\|+(?!>)",
    r"<\|#:(?!>)", r"<\|+#>", r"<\|\|(?!>)", r"(?<!<)\|#\|>", r"<\|#\|>\|", r"\|\|#\|\|",
)
_DAMAGED = [re.compile(p) for p in DAMAGED]
_BEFORE_RECORD = re.compile(r"<\|#\|>(entity|relation(?:ship)?)(?=<\|#\|>)")
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F￾￿]")
_TAGS = re.compile(r"</p\s*>|<p\s*>|<p/>|</br\s*>|<br\s*>|<br/>", re.IGNORECASE)
_NARROW = str.maketrans(WIDE, NARROW)
_BLANKS = [re.compile(rf"(?<={a})\s+(?={b})") for a, b in ((HAN, HAN), (HAN, LATIN), (LATIN, HAN))]
_ENCLOSED = [re.compile(rf"{a}([^{a}{b}]*){b}", re.DOTALL) for a, b in ENCLOSING]
_INNER = re.compile(rf"[“”‘’]|['\"]+(?={HAN})|(?<={HAN})['\"]+")
_NUMBER = re.compile(r"[-+]?[0-9]*\.?[0-9]+")
#: Plain letters, digits and marks of which no rule changes anything.
_PLAIN = re.compile(r"[A-Za-z][A-Za-z0-9 ,.;:!?()\-_]*")


def cleaned(text: str, names: bool = True) -> str:
    """A field sanitised and normalised as ``text.sanitize`` and ``text.normalize_name`` do; ``names``: also without inner quotes."""
    text = text.strip()
    if _PLAIN.fullmatch(text):
        return text
    text = _CONTROL.sub("", html.unescape(text)).strip()
    text = _TAGS.sub("", text).translate(_NARROW)
    if not text.isascii():
        for pattern in _BLANKS:
            text = pattern.sub("", text)
    for pattern in _ENCLOSED:
        if m := pattern.fullmatch(text):
            text = m[1]
    if names and not text.isascii():
        text = re.sub("(?<=[^0-9])\u202f", " ", _INNER.sub("", text).replace("\xa0", " "))
    text = text.strip()
    if re.fullmatch("[0-9]{1,2}", text) or (len(text) < 6 and re.fullmatch(r"[0-9]*\.[0-9.]*", text)):
        return ""
    return text


def repaired(record: str) -> str:
    """A record with its damaged field marks mended; one that holds none of their characters beside whole marks stays as it is."""
    rest = record.replace(MARK, "")
    if "|" in rest or "<" in rest or ">" in rest:
        for pattern in _DAMAGED:
            record = pattern.sub(MARK, record)
    return record


def records(said: str | None) -> list[list[str]]:
    """Non-empty fields of the records of an output. A field mark that stands for a line break before a record is taken for one."""
    said = (said or "").replace(END, "\n").replace(END.lower(), "\n")
    rows = (x.strip() for x in _BEFORE_RECORD.sub(r"\n\1", said).split("\n"))
    return [[f for f in (f.strip() for f in repaired(r).split(MARK)) if f] for r in rows if r]


def entity(fields: Sequence[str]) -> tuple[str, str, str] | None:
    """(name, type, description) of an entity record, or nothing if it is malformed."""
    if len(fields) != 4 or "entity" not in fields[0]:
        return None
    name, kind, said = cleaned(fields[1]), cleaned(fields[2]), cleaned(fields[3], names=False)
    if not (name and kind and said) or re.search(r"['()<>|/\\]", kind):
        return None
    return name, kind.replace(" ", "").lower(), said


def relation(fields: Sequence[str]) -> tuple[str, str, str, str, float] | None:
    """(src, tgt, keywords, description, weight) of a relation record, or nothing if it is malformed or joins a name with itself.

    The weight is the last field, quotes aside, if that is a number, else 1."""
    if len(fields) != 5 or "relation" not in fields[0]:
        return None
    src, tgt = cleaned(fields[1]), cleaned(fields[2])
    if not (src and tgt) or src == tgt:
        return None
    bare = fields[4].strip('"').strip("'")
    return src, tgt, cleaned(fields[3]).replace("，", ","), cleaned(fields[4], names=False), float(bare) if _NUMBER.fullmatch(bare) else 1.0


def extracted(rows: DataFrame, said: str, keep: Sequence[str]) -> DataFrame:
    """A row for each good record of the outputs ``said``, in order (``nth``): kind (entity, relation), name, type, src, tgt, keywords, description, weight.

    Malformed records are rows of kind ``rejected`` with their text as description, so that they can be put aside and counted."""
    names = ["nth", "kind", "name", "type", "src", "tgt", "keywords", "description", "weight"]
    kinds = [pa.int32(), *[pa.string()] * 7, pa.float64()]

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                for n, fields in enumerate(records(text)):
                    at.append(i)
                    if e := entity(fields):
                        out.append((n, "entity", e[0], e[1], None, None, None, e[2], None))
                    elif r := relation(fields):
                        out.append((n, "relation", None, None, r[0], r[1], r[2], r[3], r[4]))
                    else:
                        out.append((n, "rejected", None, None, None, None, None, MARK.join(fields), None))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]] + [pa.array(c, t) for c, t in zip(columns, kinds)], [*keep, *names])

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return spread(rows.select(*keep, said)).mapInArrow(run, fields + "nth int, kind string, name string, type string, src string, tgt string, keywords string, description string, weight double")
