"""Text normalisation and date parsing as column expressions.

Compatibility forms (full-width letters and the like) have no counterpart among the built-in
functions, so ``nfkc`` runs in Arrow batches; every other step is a column expression. Texts of ASCII
characters alone skip the Python step.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Dash characters that are read as a hyphen.
DASHES = "‐‑‒–—―−－ｰ"
#: Variant characters of names, and what they are read as.
NAME_FORMS = "ヶヵ髙﨑德邊邉澤齋齊惠檮嶋冨櫻瀨曾", "ケカ高崎徳辺辺沢斎斉恵梼島富桜瀬曽"
#: Variant characters of addresses, and what they are read as.
ADDRESS_FORMS = "惠澤圓榮邊邉瀨齋齊藪曾德假眞淺檮嶋槇冨髙祗櫻濵", "恵沢円栄辺辺瀬斎斉薮曽徳仮真浅梼島槙富高祇桜浜"
#: Characters of town names that keys don't tell apart.
KEY_FORMS = "ヶヵッ", "ケカツ"
#: Circle marks.
CIRCLES = "◯〇◎●⚪○"

#: How the name of a prefecture begins an address.
PREFECTURE = r"^(北海道|東京都|(?:京都|大阪)府|.{2,3}県)"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def nfkc_folded(c: Column) -> Column:
    """NFKC and case folding; plain lower case for ASCII texts."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(_nfkc(c))


def hyphenated(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def normalized(c: Column) -> Column:
    """Folded, with one kind of dash, single spaces, and no blanks at the ends."""
    return F.trim(F.regexp_replace(hyphenated(nfkc_folded(c)), r"\s+", " "))


def ascii_normalized(c: Column) -> Column:
    """``normalized`` for texts that need no compatibility forms."""
    return F.trim(F.regexp_replace(hyphenated(F.lower(c)), r"[\x20\x09-\x0D]+", " "))


def state_text(c: Column) -> Column:
    """For comparing states: folded, all dashes and the long-vowel mark alike, circles alike, no blanks."""
    one = F.translate(hyphenated(nfkc_folded(c)), "ー" + CIRCLES, "-" + "○" * len(CIRCLES))
    return F.regexp_replace(one, r"\s+", "")


def folded_name(c: Column) -> Column:
    return F.regexp_replace(F.translate(nfkc_folded(c), *NAME_FORMS), r"\s+", "")


def normalized_address(c: Column) -> Column:
    """Half-width digits, brackets and blanks, one kind of dash, and usual characters; no blanks at the ends."""
    half = F.translate(hyphenated(c), "０１２３４５６７８９（）　" + ADDRESS_FORMS[0], "0123456789() " + ADDRESS_FORMS[1])
    return F.trim(F.regexp_replace(half, r"(?<=[0-9])ー(?=[0-9])", "-"))


def town_key(c: Column) -> Column:
    """Key by which towns are compared: usual characters, without the section words 大字 and a leading 字."""
    usual = F.translate(c, ADDRESS_FORMS[0] + KEY_FORMS[0], ADDRESS_FORMS[1] + KEY_FORMS[1])
    return F.regexp_replace(F.replace(usual, F.lit("大字"), F.lit("")), "^字", "")


def kanji_number(n: Column) -> Column:
    """Chinese numerals of 1 to 99; null for other numbers."""
    digit = F.array(*[F.lit(d) for d in ("", "一", "二", "三", "四", "五", "六", "七", "八", "九")])
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    head = F.when(tens == 0, "").when(tens == 1, "十").otherwise(F.concat(F.get(digit, tens), F.lit("十")))
    return F.when(n.between(1, 99), F.concat(head, F.get(digit, ones)))


def kanji_blocks(c: Column) -> Column:
    """A number before a block word in Chinese numerals."""
    number = F.regexp_extract(c, r"^(.*?)([0-9]{1,2})(丁目|条|線|番町)(.*)$", 2)
    head, tail = F.regexp_extract(c, r"^(.*?)([0-9]{1,2})(丁目|条|線|番町)(.*)$", 1), F.regexp_extract(c, r"^(.*?)([0-9]{1,2})((?:丁目|条|線|番町).*)$", 3)
    return F.when(number == "", c).otherwise(F.coalesce(F.concat(head, kanji_number(number.try_cast("int")), tail), c))


def head_and_numbers(c: Column) -> Column:
    """(head, numbers): the text before the first digit, and the numbers after it."""
    return F.struct(F.regexp_extract(c, r"^([^0-9]*)", 1).alias("head"), F.regexp_extract_all(c, F.lit("([0-9]+)")).alias("numbers"))


def mark_state(c: Column) -> Column:
    """yes, no, not_applicable, blank or unknown; a text that is neither stays unknown, never no."""
    t = F.trim(c)
    return (
        F.when(t.rlike(f"^[{CIRCLES}]$"), "yes").when(t.rlike("^[×✕✖xX]$"), "no").when(t.rlike(f"^[-{DASHES}]+$"), "not_applicable")
        .when(t.isNull() | (t == ""), "blank").otherwise("unknown")
    )


def tri_bool(state: Column) -> Column:
    """True for yes, false for no and not_applicable, null otherwise."""
    return F.when(state == "yes", True).when(state.isin("no", "not_applicable"), False)


def official_id(c: Column) -> Column:
    """Six digits and an optional letter, in lower case; null for anything else."""
    t = F.lower(F.trim(c))
    return F.when(t.rlike("^[0-9]{6}[a-z]?$"), t)


def epsg(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)EPSG:\s*([0-9]+)", 1), F.lit("")).try_cast("int")


def safe_int(c: Column) -> Column:
    """The integer, or 0 for anything that isn't digits."""
    return F.coalesce(F.when(F.trim(c).rlike("^-?[0-9]+$"), F.trim(c).try_cast("bigint")), F.lit(0))


def iso_date(c: Column) -> Column:
    """Dates written exactly as year-month-day that the calendar has; null otherwise."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


#: What is added to a year of each era. Years of the era before these have no offset and give null.
ERAS = {"R": 2018, "H": 1988, "S": 1925, "T": 1911}


def era_date(c: Column) -> Column:
    """Dates such as H24.10.19; a year of two digits without an era counts from 2000."""
    p = r"^\s*([RHSTMrhstm]?)\s*([0-9]{1,4})[./年-]\s*([0-9]{1,2})[./月-]\s*([0-9]{1,2})日?\s*$"
    era, part = F.upper(F.regexp_extract(c, p, 1)), [F.regexp_extract(c, p, i).try_cast("int") for i in (2, 3, 4)]
    year = F.when(era == "", F.when(part[0] < 100, part[0] + 2000).otherwise(part[0]))
    for letter, offset in ERAS.items():
        year = F.when(era == letter, part[0] + offset).otherwise(year)
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part[1].cast("string"), 2, "0"), F.lpad(part[2].cast("string"), 2, "0")), "yyyy-MM-dd")


def month_end(c: Column) -> Column:
    """The last day of a month written yyyy-MM, or of a date that is a month's last day; null otherwise."""
    month = F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.last_day(F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")))
    day = iso_date(c)
    return F.coalesce(month, F.when(day == F.last_day(day), day))


def event_types(c: Column, reasons: dict[str, str]) -> Column:
    """Sorted distinct types of all reasons that the text names; the first is that of the first reason."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(c, F.lit(r)), F.lit(t)) for r, t in reasons.items()]))))


def escaped(c: Column) -> Column:
    """Safe within HTML and scripts."""
    out = c
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def ramp(share: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """Hex colour between two colours, linear in a share of 0 to 1."""
    parts = [F.lpad(F.lower(F.hex(F.rint(a + (b - a) * share).cast("long"))), 2, "0") for a, b in zip(low, high)]
    return F.concat(F.lit("#"), *parts)


#: The prefectures.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 "
    "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
#: Characters that take two columns in a fixed-width layout.
WIDE = r"[ᄀ-ᅟ⺀-〾ぁ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]"


def address_start(c: Column) -> Column:
    """Characters before the rightmost prefecture that doesn't lie within an earlier match; null without one."""
    pattern = "|".join(PREFECTURES)
    found, pieces = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    tail = F.length(F.element_at(pieces, -1)) + F.length(F.try_element_at(found, F.lit(-1)))
    return F.length(c) - tail


def display_width(c: Column) -> Column:
    """Columns that a text takes where wide characters take two."""
    return F.length(c) + F.length(F.regexp_replace(c, WIDE.replace("[", "[^", 1), ""))


def slice_columns(c: Column, start: int, end: int) -> Column:
    """The characters that begin in the columns from ``start`` to before ``end``."""
    chars = F.split(c, "")
    width = lambda x: F.when(x.rlike(WIDE), 2).otherwise(1)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + width(x)).alias("at"), F.when((acc["at"] >= start) & (acc["at"] < end), F.concat(acc["out"], x)).otherwise(acc["out"]).alias("out"))
    return F.aggregate(F.filter(chars, lambda x: x != ""), begin, step)["out"]


def cell_text(cell: Column) -> Column:
    """Text of a struct (raw, normalized): the normalized form unless it is blank, else the raw one."""
    return F.coalesce(F.nullif(F.trim(cell["normalized"]), F.lit("")), cell["raw"])


def state_key(fields: list[Column], services: Column) -> Column:
    """Fingerprint of a state: its fields and each of its services, folded, as one digest. A null field
    and an empty one differ."""
    parts = F.array(*[F.coalesce(F.concat(F.lit("="), state_text(f)), F.lit("-")) for f in fields])
    folded = F.transform(F.coalesce(services, F.array().cast("array<string>")), lambda s: F.coalesce(F.concat(F.lit("="), F.lower(F.regexp_replace(s, r"\s+", ""))), F.lit("-")))
    return F.sha2(F.to_json(F.struct(parts.alias("fields"), folded.alias("services"))), 256)
