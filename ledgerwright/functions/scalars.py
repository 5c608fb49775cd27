"""Scalar functions of the invoice engine as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# GB 32100 characters and weights, province codes, Chinese numerals.
USCC_CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28]
CN_DIGITS = {"零": 0, "〇": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "两": 2}
CN_UNITS = {"拾": 10, "佰": 100, "仟": 1000, "十": 10, "百": 100, "千": 1000}
CN_SECTIONS = {"万": 10_000, "亿": 100_000_000}
LABELS = ("发票号码", "开票日期", "价税合计", "购买方", "销售方", "税额", "发票代码", "校验码", "合计")

# Four-digit region codes, the last two digits of an invoice code.
REGIONS = {
    "北京": "1100", "天津": "1200", "上海": "3100", "重庆": "5000", "河北": "1300", "山西": "1400", "辽宁": "2100", "吉林": "2200",
    "黑龙江": "2300", "江苏": "3200", "浙江": "3300", "安徽": "3400", "福建": "3500", "江西": "3600", "山东": "3700", "河南": "4100",
    "湖北": "4200", "湖南": "4300", "广东": "4400", "广西": "4500", "海南": "4600", "四川": "5100", "贵州": "5200", "云南": "5300",
    "西藏": "5400", "陕西": "6100", "甘肃": "6200", "青海": "6300", "宁夏": "6400", "新疆": "6500", "台湾": "7100",
    "大连": "2102", "宁波": "3302", "厦门": "3502", "青岛": "3702", "深圳": "4403",
    "广州": "4401", "杭州": "3301", "南京": "3201", "苏州": "3205", "武汉": "4201", "成都": "5101", "西安": "6101", "长沙": "4301",
    "郑州": "4101", "济南": "3701", "青岛黄岛": "3702",
}
KINDS = {"普票": "11", "专票": "13"}

MONEY = "decimal(18,2)"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def oneline(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def trimmed_lines(text: Column) -> Column:
    """The text without blanks and tabs, its lines stripped, empty lines dropped."""
    return F.regexp_replace(flat_lines(text), r"(?U)^\s+|\s+$", "")


def flat_lines(text: Column) -> Column:
    """``trimmed_lines`` but for white space at both ends of the text, which ``stripped`` takes."""
    bare = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))
    return F.regexp_replace(bare, r"(?U)\s*\n\s*", "\n")


def stripped(text: Column) -> Column:
    """Without white space at both ends; the pattern only runs where the first or last character is some."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def lines(text: Column) -> Column:
    return F.filter(F.split(trimmed_lines(text), "\n", -1), lambda x: x != "")


# Characters that NFKC turns into one other, whatever stands beside them, and blanks that count as spaces.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "￥￠￡ 　​﻿"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + "¥¢£    "
#: Texts of these characters alone are in form NFKC.
NFKC_SAFE = r"^[\x00-\x7F¥¢£§×→※“”‘’、。〈-】一-鿿]*$"


@F.pandas_udf(T.StringType())
def _nfkc(text):
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalised(df: DataFrame, col: str = "text") -> DataFrame:
    """``df`` with unified line ends and blanks in ``col``, then NFKC; null stays null.

    Full-width forms are mapped natively, in texts that hold other characters than
    NFKC_SAFE; only those that still do go to Python, since Spark has no normalisation of its own.
    """
    ends = F.when(F.contains(F.col(col), F.lit("\r")), F.regexp_replace(F.col(col), "\r\n?", "\n")).otherwise(F.col(col))
    staged = df.withColumn("_nf_text", ends).withColumn("_nf_safe", F.col("_nf_text").rlike(NFKC_SAFE))
    staged = staged.withColumn("_nf_text", F.when(F.col("_nf_safe"), F.col("_nf_text")).otherwise(F.translate("_nf_text", _WIDE, _NARROW)))
    staged = staged.withColumn("_nf_safe", F.col("_nf_safe") | F.col("_nf_text").rlike(NFKC_SAFE))
    return staged.withColumn(col, F.when(F.col("_nf_safe"), F.col("_nf_text")).otherwise(_nfkc(F.when(~F.col("_nf_safe"), F.col("_nf_text"))))).drop("_nf_text", "_nf_safe")


def to_money(text: Column) -> Column:
    """Null where the text is no number."""
    return F.regexp_replace(text, r"[,，¥￥\s]", "").try_cast(MONEY)


def to_date(text: Column) -> tuple[Column, Column]:
    """ISO text of a date written in digits, and whether it is no real day (the text is kept)."""
    parts = [F.regexp_extract(text, r"(\d{4})[年\-/.]?(\d{1,2})[月\-/.]?(\d{1,2})日?", k) for k in (1, 2, 3)]
    iso = F.when(parts[0] != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")))
    return iso, iso.isNotNull() & F.try_to_date(iso, "yyyy-MM-dd").isNull()


def cn_amount(text: Column) -> Column:
    """A capital amount as a number; null where nothing in it is a numeral or 元, 角, 分.

    The part before 元 is cut into sections that 万 or 亿 multiply. A section is the sum of
    its tokens: a numeral with the unit after it (a unit that has no numeral or a zero
    before it counts once), and a numeral that ends the section. Bracketed notes, 整 and
    正 do not count.
    """
    numerals, units, sections = ("".join(m) for m in (CN_DIGITS, CN_UNITS, CN_SECTIONS))
    digit, unit, factor = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (CN_DIGITS, CN_UNITS, CN_SECTIONS))

    def after(value):
        clean = F.translate(F.regexp_replace(value, "[（(][^)）]*[)）]", ""), "圆圓圜整正", "元元元")
        return F.regexp_replace(clean, rf"[^{numerals}{units}{sections}元角分]", "")

    def token(x):
        last = F.regexp_extract(x, f"([{numerals}])[{units}]?$", 1)
        n = F.when(last == "", 0).otherwise(digit[last])
        scale = unit[F.right(x, F.lit(1))]
        return F.when(scale.isNull(), n).otherwise(F.greatest(n, F.lit(1)) * scale).cast("long")

    def section(x):
        tokens = F.regexp_extract_all(x, F.lit(f"[{numerals}]*[{units}]|[{numerals}]+"), F.lit(0))
        value = F.aggregate(F.transform(tokens, token), F.lit(0).cast("long"), lambda a, v: a + v)
        return value * F.coalesce(factor[F.right(x, F.lit(1))], F.lit(1))

    def amount(clean):
        whole = F.regexp_extract_all(F.regexp_extract(clean, "^[^元角分]*", 0), F.lit(f"[^{sections}]*[{sections}]|[^{sections}]+"), F.lit(0))
        small = [F.coalesce(digit[F.nullif(F.regexp_extract(clean, f"([{numerals.replace('两', '')}]){u}", 1), F.lit(""))], F.lit(0)) for u in "角分"]
        cents = F.aggregate(F.transform(whole, section), F.lit(0).cast("long"), lambda a, v: a + v) * 100 + small[0] * 10 + small[1]
        return F.when(clean.rlike(f"[{numerals}元角分]"), (cents / 100).cast(MONEY))

    return let(after(text), amount)


def _uscc_sign(code: Column) -> Column:
    """The check character of the first 17 characters of ``code``."""
    total = sum((F.instr(F.lit(USCC_CHARS), F.substr(code, F.lit(i + 1), F.lit(1))) - 1) * w for i, w in enumerate(USCC_WEIGHTS))
    return F.substr(F.lit(USCC_CHARS), F.pmod(31 - F.pmod(total, F.lit(31)), F.lit(31)) + 1, F.lit(1))


def uscc_check(code: Column) -> Column:
    """Whether the check character of an 18-character credit code is right; null for other lengths."""
    c = F.upper(F.trim(code))
    return F.when(F.length(c) == 18, c.rlike(f"^[{USCC_CHARS}]{{18}}$") & (_uscc_sign(c) == F.right(c, F.lit(1))))


def uscc_complete(body: Column) -> Column:
    """17 characters with their check character."""
    return F.concat(body, _uscc_sign(body))


def dedupe_key(code: Column, no: Column) -> Column:
    no, code = (F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit("")) for x in (no, code))
    return F.when(no.isNotNull(), F.concat_ws("-", code, no))


def placeholder_to_empty(x: Column) -> Column:
    return F.when(x == "—", F.lit("")).otherwise(x)


def base_file_name(name: Column) -> Column:
    return F.split_part(name, F.lit(" [第"), F.lit(1))


def display_name(name: Column, k: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(name, F.lit(" [第"), k.cast("string"), F.lit("张/共"), n.cast("string"), F.lit("张]"))).otherwise(name)


def csv_text_cell(x: Column) -> Column:
    """Long digit strings as a text formula, so that a spreadsheet keeps them whole."""
    return F.when(x.rlike(r"^\d{8,}$"), F.concat(F.lit('="'), x, F.lit('"'))).otherwise(x)


def parse_csv_cell(x: Column) -> Column:
    return F.when(x.rlike('^=".*"$'), F.regexp_extract(x, '^="(.*)"$', 1)).otherwise(x)


def csv_escape(x: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.rlike('^=".*"$'), x).when(x.rlike('[",\r\n]'), quoted).otherwise(F.coalesce(x, F.lit("")))


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def percent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 1), F.lit("%"))


def region_code(name: Column) -> Column:
    """The four-digit code of a region's name; four digits stand for themselves, an unknown region is an error."""
    known = F.create_map(*(F.lit(x) for kv in REGIONS.items() for x in kv))
    code = F.coalesce(known[name], F.when(name.rlike("^[0-9]{4}$"), name))
    return F.when(name.isNull(), None).otherwise(F.coalesce(code, F.raise_error(F.concat(F.lit("unknown region: "), name)).cast("string")))


def invoice_code(region: Column, year: Column, batch: Column, kind: Column) -> Column:
    """12 digits: 0, four of the region, two of the year, three of the batch, two of the kind (11 or 13)."""
    return F.concat(F.lit("0"), F.rpad(region, 4, "0"), F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0"), F.lpad(batch.cast("string"), 3, "0"), kind)


def e_invoice_no(region: Column, year: Column, seq: Column, channel: Column) -> Column:
    """20 digits: two of the year, two of the province, one of the channel, 15 of the sequence."""
    return F.concat(F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0"), F.substring(region, 1, 2), channel.cast("string"), F.lpad(seq.cast("string"), 15, "0"))


def code_fault(code: Column) -> Column:
    """What is wrong with the structure of an invoice code: length, start or kind; null for a sound one."""
    return F.when(F.length(code) != 12, "length").when(~code.rlike("^0[0-9]{11}$"), "start").when(~F.right(code, F.lit(2)).isin(*KINDS.values()), "kind")


def readable_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB")))


def text_quality(text: Column) -> Column:
    """How far a text can be an invoice's text layer, from 0 to 1, three decimals.

    Printable characters are all but control characters; digits are ASCII digits. Terms are
    multiplied, divided and added in the order of the SQL, and thousandths are rounded as it
    does: shares such as 76 of 800 are ties in exact numbers, so another order rounds otherwise.
    """

    def score(t):
        n = F.length(t)
        per = lambda p, times=1.0: times * F.regexp_count(t, F.lit(p)) / n
        found = sum(F.when(F.contains(t, F.lit(x)), 1).otherwise(0) for x in LABELS)
        value = (
            0.35 * F.least(n / 200.0, F.lit(1.0))
            + 0.25 * (1 - per(r"[\x00-\x08\x0B-\x1F\x7F]"))
            + 0.40 * F.least(per("[\\u4e00-\\u9fff0-9]") / 0.35, F.lit(1.0))
            - F.least(per(r"[|~^`_{}\[\]<>\\]", 1.5), F.lit(0.25))
            - F.when(t.rlike("[�□]"), 0.20).otherwise(0.0)
            - F.when(found < 2, 0.35).otherwise(0.0)
        )
        return F.when(n == 0, 0.0).otherwise(F.round(1000 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))) / 1000)

    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c")), score)


def jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.split(v, "")) for v in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def same_characters(a: Column, b: Column) -> Column:
    """An upper bound of the ratio of matching blocks: twice the common characters, with their counts, by both lengths."""
    common = F.aggregate(F.transform(F.array_distinct(F.split(a, "")), lambda c: F.least(F.length(a) - F.length(F.replace(a, c)), F.length(b) - F.length(F.replace(b, c)))), F.lit(0), lambda n, x: n + x)
    return 2.0 * common / F.greatest(F.length(a) + F.length(b), F.lit(1))


@F.pandas_udf(T.DoubleType())
def block_ratio(a, b):
    """The ratio of matching blocks, which has no native form; null for null."""
    from difflib import SequenceMatcher

    return a.combine(b, lambda x, y: None if x is None or y is None else SequenceMatcher(None, x, y).ratio())


def apart(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row, which the optimizer does not write the columns' expressions through."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def with_similarity(df: DataFrame, a: Column, b: Column, out: str, least: float = 0.0) -> DataFrame:
    """``out``: the larger of character Jaccard and the ratio of matching blocks; 0 for null or empty texts.

    Only pairs whose bounds allow a ratio of ``least`` and whose Jaccard is below it go
    to Python; for the others the result is the Jaccard, on the right side of ``least``.
    Each step is a column of its own, since the later ones use the earlier many times.
    """
    staged = apart(df.withColumns({"_sm_a": a, "_sm_b": b}))
    a, b = F.col("_sm_a"), F.col("_sm_b")
    some = (F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0)
    staged = staged.withColumn("_sm_j", F.when(some, jaccard(a, b)))
    ask = (a != b) & (2.0 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b)))
    if least > 0:
        ask = ask & (F.col("_sm_j") < least) & F.when(ask, same_characters(a, b) >= least)
    staged = staged.withColumn("_sm_ask", F.coalesce(F.col("_sm_j").isNotNull() & ask, F.lit(False)))
    staged = staged.withColumn("_sm_r", block_ratio(F.when(F.col("_sm_ask"), a), F.when(F.col("_sm_ask"), b)))
    whole = F.when(F.col("_sm_j").isNull(), 0.0).when(a == b, 1.0).otherwise(F.greatest("_sm_j", F.coalesce("_sm_r", F.lit(0.0))))
    return staged.withColumn(out, whole).drop("_sm_a", "_sm_b", "_sm_j", "_sm_ask", "_sm_r")
