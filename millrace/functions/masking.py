"""Masks for personal data, by kind, and the detection of kinds from column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What names of columns say of their content.
#: Numbers of people, by the whole name of a column.
ID_COLUMNS = ("pt_no", "pat_no", "patient_no", "patient_id", "ptno", "ptid", "emp_no", "staff_no", "chart_no", "ptmiptno", "omt02ptno")
#: By part of the name, the kinds in the order in which they are tried. Identity numbers come before `ID_COLUMNS`, the other kinds after them.
KEYWORDS = {
    "rrn": ("rrn", "jumin", "주민", "idno", "id_no", "ssn", "ptmipsid", "ptmippsid", "reg_no", "regno", "birth_no", "resident"),
    "name": ("name", "nm", "성명", "이름", "환자명", "성함"),
    "phone": ("tel", "phone", "hp", "mobile", "전화", "핸드폰", "휴대폰", "contact"),
    "addr": ("addr", "주소", "거주지"),
    "email": ("mail", "이메일"),
}


def blank(x: Column) -> Column:
    return x.isNull() | x.isin("", "None", "NULL")


def mask_rrn(x: Column) -> Column:
    """Keeps six digits of a resident number; anything else is starred as a whole."""
    plain = F.trim(x)
    return F.when(plain.rlike(r"^\d{6}-?\d{7}$"), F.concat(F.substring(plain, 1, 6), F.lit("-*******"))).otherwise(F.repeat(F.lit("*"), F.length(plain)))


def mask_name(x: Column) -> Column:
    """Hangul: first and last syllable; Latin words: first letters; others: first character."""
    plain, n = F.trim(x), F.length(F.trim(x))
    stars = F.repeat(F.lit("*"), F.greatest(n - 2, F.lit(1)))
    hangul = F.when(n <= 1, F.lit("*")).when(n == 2, F.concat(F.substring(plain, 1, 1), F.lit("*"))).otherwise(F.concat(F.substring(plain, 1, 1), stars, F.substring(plain, -1, 1)))
    latin = F.array_join(F.transform(F.split(plain, r"\s+"), lambda w: F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(w) - 1, F.lit(0))))), " ")
    other = F.concat(F.substring(plain, 1, 1), F.repeat(F.lit("*"), F.greatest(n - 1, F.lit(0))))
    return F.when(plain.rlike(r"^[가-힣]+$"), hangul).when(plain.rlike(r"^[A-Za-z][A-Za-z\s.'-]*$"), latin).otherwise(other)


def mask_phone(x: Column) -> Column:
    """Stars the middle of numbers written with hyphens or as eleven digits; others are starred as a whole."""
    plain = F.trim(x)
    hyphens = F.regexp_replace(plain, r"^(\d{2,3})-(\d{3,4})-(\d{4})$", "$1-****-$3")
    eleven = F.regexp_replace(plain, r"^(\d{3})(\d{4})(\d{4})$", "$1-****-$3")
    return F.when(plain.rlike(r"^\d{2,3}-\d{3,4}-\d{4}$"), hyphens).when(plain.rlike(r"^\d{11}$"), eleven).otherwise(F.repeat(F.lit("*"), F.length(plain)))


def mask_address(x: Column) -> Column:
    """Keeps the first two words."""
    parts = F.split(F.trim(x), r"\s+")
    return F.when(F.size(parts) <= 2, F.concat(F.element_at(parts, 1), F.lit(" ***"))).otherwise(F.concat(F.array_join(F.slice(parts, 1, 2), " "), F.lit(" ***")))


def mask_email(x: Column) -> Column:
    """First letter and domain; without a name or an @, stars only."""
    return F.when(x.rlike(r"^[^@]+@"), F.regexp_replace(x, r"^(.)[^@]*(@.*)$", "$1***$2")).otherwise(F.lit("***"))


def mask_id(x: Column) -> Column:
    """First and last two characters of six or more; first two of fewer."""
    plain = F.trim(x)
    return F.when(F.length(plain) >= 6, F.concat(F.substring(plain, 1, 2), F.lit("****"), F.substring(plain, -2, 2))).when(F.length(plain) > 2, F.concat(F.substring(plain, 1, 2), F.lit("****"))).otherwise(F.lit("****"))


MASKS = {"rrn": mask_rrn, "id": mask_id, "name": mask_name, "phone": mask_phone, "addr": mask_address, "email": mask_email}


def mask(x: Column, kind: str) -> Column:
    """The mask of a kind; null and spelled-out nulls become empty."""
    return F.when(blank(x), F.lit("")).otherwise(MASKS[kind](x.cast("string")))


def kind_of(column: str) -> str | None:
    """What a column holds, from its name in any case; parts of names count, as naming habits are loose."""
    low = column.lower()
    kinds = [kind for kind, words in KEYWORDS.items() if any(w in low for w in words)]
    return "id" if low in ID_COLUMNS and "rrn" not in kinds else next(iter(kinds), None)


def mask_frame(df: DataFrame, kinds: dict[str, str] | None = None, detect: bool = True) -> DataFrame:
    """`df` with the named columns masked by their kind, and others that `kind_of` recognises.

    An unknown kind is an error: nothing passes unmasked because masking failed.
    """
    kinds = dict(kinds or {})
    unknown = set(kinds.values()) - set(MASKS)
    if unknown:
        raise ValueError(f"no mask for {sorted(unknown)}")
    if detect:
        kinds = {c: k for c in df.columns if (k := kind_of(c))} | kinds
    return df.select(*(mask(F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))


def drop_personal(df: DataFrame, limit: int | None = 50) -> DataFrame:
    """`df` without columns of personal data, for prompts; where none is left, only the number of rows."""
    kept = [c for c in df.columns if not kind_of(c)]
    if not kept:
        return df.agg(F.count("*").alias("rows"))
    out = df.select(*(F.col(f"`{c}`") for c in kept))
    return out.limit(limit) if limit is not None else out


#: Personal data in free text: pattern and replacement, applied in this order (fixed values).
FREE_TEXT = (
    (r"\d{6}-[1-4]\d{6}", "[RRN]"),
    (r"\bPT\d{7}\b", "[PATIENT_ID]"),
    (r"\b01[016789]-?\d{3,4}-?\d{4}\b", "[PHONE]"),
    (r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    (r"환자[가-힣]{2,4}", "[PATIENT_NAME]"),
)


def mask_text(x: Column) -> Column:
    """Free text with personal data replaced by labels."""
    for pattern, label in FREE_TEXT:
        x = F.regexp_replace(x, pattern, label)
    return x
