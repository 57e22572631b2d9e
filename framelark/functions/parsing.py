"""Expressions that turn raw log fields into message columns.

Bad values become null (``try_cast``), never errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import Window
from pyspark.sql import functions as F

# The names and label words that message logs are known to use.
TIMESTAMP_NAMES = ("timestamp", "time", "ts", "t", "arrival_time", "abs_time")
CAN_ID_NAMES = ("can_id", "canid", "id", "arbitration_id", "arbitrationid", "message_id", "msg_id", "pid")
DLC_NAMES = ("dlc", "data_length", "len", "length", "datalength")
LABEL_NAMES = ("label", "flag", "class", "attack", "is_attack", "target", "category", "subclass", "attack_type")
ATTACK_WORDS = (
    "t", "attack", "1", "true", "yes", "malicious", "injected", "anomaly", "dos", "fuzzy", "fuzzing", "spoofing", "replay",
    "impersonation", "gear", "rpm", "flooding", "malfunction", "masquerade", "fabrication",
)
NORMAL_WORDS = ("r", "normal", "0", "false", "no", "benign", "attack_free", "n-attack", "nattack", "clean")
NORMAL_FILES = ("attack_free", "normal", "benign", "free")
LOG_LINE = {"timestamp": r"(?i)Timestamp:\s*([0-9.]+)", "can_id": r"(?i)Timestamp:\s*[0-9.]+.*?ID:\s*([0-9a-f]+)", "dlc": r"(?i)Timestamp:\s*[0-9.]+.*?ID:\s*[0-9a-f]+.*?DLC:\s*(\d+)"}
CANDUMP_LINE = r"^\s*\(\s*([^()\s]+)\s*\)(?:\s+\S+)*?\s+([^\s#]*)#(\S*)\s*$"


def resolve(columns: Iterable[str], names: Sequence[str]) -> str | None:
    """The column that a field's known names point to: an exact match first, in the
    order of the names, then the longest name that a column contains."""
    plain = {}
    for c in columns:
        plain[re.sub(r"[ -]", "_", c.strip().lower())] = c
    exact = [plain[n] for n in names if n in plain]
    if exact:
        return exact[0]
    held = [(c, n) for n in sorted(names, key=len, reverse=True) for p, c in plain.items() if n in p]
    return held[0][0] if held else None


def _plain_id(raw: Column) -> Column:
    """Trimmed, lower-case, without a 0x; a missing id reads as the text 'nan'."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(raw.cast("string"), F.lit("nan")))), "^0x", "")


def looks_hex(raw: Column) -> Column:
    """Whether an id can't be decimal: it holds one of a-f (a missing one counts)."""
    return _plain_id(raw).rlike("[a-f]")


def can_id(raw: Column, hexadecimal: Column) -> Column:
    """An id as a number, in the base that its whole file is in; -1 if it isn't one."""
    plain = _plain_id(raw)
    as_hex = F.when(plain.rlike("^[0-9a-f]{1,15}$"), F.conv(plain, 16, 10).cast("long"))
    as_decimal = F.when(plain.rlike("^[0-9]{1,18}$"), plain.try_cast("long"))
    return F.coalesce(F.when(hexadecimal, as_hex).otherwise(as_decimal), F.lit(-1).cast("long"))


def can_id_by_capture(raw: Column, capture: Column) -> Column:
    """``can_id`` with the base decided over all rows of a capture."""
    return can_id(raw, F.max(looks_hex(raw)).over(Window.partitionBy(capture)))


def label(raw: Column) -> Column:
    """1 for attack words, 0 for normal ones; else 1 if the text contains an attack
    word of three letters or more, else 0."""
    plain = F.lower(F.trim(raw.cast("string")))
    contained = "|".join(re.escape(w) for w in ATTACK_WORDS if len(w) > 2)
    return F.coalesce(F.when(plain.isin(*ATTACK_WORDS), 1).when(plain.isin(*NORMAL_WORDS), 0).when(plain.rlike(contained), 1), F.lit(0)).cast("tinyint")


def numeric_label(raw: Column) -> Column:
    """1 for a number other than 0."""
    return (F.coalesce(raw.try_cast("double"), F.lit(0.0)) != 0).cast("tinyint")


def not_a_number(raw: Column) -> Column:
    """Whether a text that isn't blank is no number; one such label makes a file's labels words."""
    return (F.trim(raw) != "") & raw.try_cast("double").isNull()


def numeric_id(raw: Column) -> Column:
    """An id from a column of numbers; -1 for a missing one."""
    return F.coalesce(raw.try_cast("long"), F.lit(-1).cast("long"))


def last_field(fields: Column) -> Column:
    """The last field that isn't blank."""
    return F.element_at(F.filter(F.transform(fields, lambda x: F.trim(x)), lambda x: x != ""), -1)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def file_label(name: Column) -> Column:
    """0 if the file's name says that it is free of attacks, else 1."""
    return F.when(F.lower(name).rlike("|".join(NORMAL_FILES)), 0).otherwise(1).cast("tinyint")


def between(value: Column, start: Column, end: Column) -> Column:
    """Closed interval; a missing bound holds nothing."""
    return F.coalesce(value.between(start, end), F.lit(False)).cast("tinyint")
