"""Invoice fields from normalised text: one native Column per field.

A field is found as a whole match first (its evidence), and its value is taken from that
short match, so the long text is scanned once for each pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars as S

# Title words in order of precedence, stop words of names, labels and shapes of
# the fields, relaxed types. Results depend on them; they stand here in one place.
RAIL, AIR, TOLL = "电子发票(铁路电子客票)", "电子发票(航空运输电子客票行程单)", "电子发票(通行费)"
RELAXED = (RAIL, AIR, TOLL)
TITLES = (
    (("铁路电子客票",), RAIL), (("航空运输电子客票行程单",), AIR),
    (("通行费电子发票",), TOLL), (("电子发票(通行费)",), TOLL), (("收费公路通行费",), TOLL),
    (("电子发票", "专用发票"), "数电发票(增值税专用发票)"), (("电子发票", "普通发票"), "数电发票(普通发票)"),
    (("数电",), "数电发票"), (("全电",), "数电发票"),
    (("增值税电子专用发票",), "电子专用发票"), (("增值税电子普通发票",), "电子普通发票"),
    (("机动车销售统一发票",), "机动车销售统一发票"), (("二手车销售统一发票",), "二手车销售统一发票"),
    (("增值税专用发票",), "增值税专用发票"), (("增值税普通发票",), "增值税普通发票"), (("发票",), "电子发票(其他)"),
)
NAME_STOP = "(?=销售方|购买方|销货方|购货方|统一社会信用代码|纳税人识别号|税号|项目名称|货物或应税|规格型号|单位|数量|单价|金额|税率|征收率|价税合计|合计|备注|开票人|收款人|复核人|地址|开户行|电话|账号|$)"
NAME_END = "统一社会信用代码|纳税人识别号|销售方|购买方|销货方|购货方|项目名称|货物或应税|规格型号|地址|开户行|电话|账号|备注|开票人"
ROLES = {"buyer": ("购买方", "购货方", "付款方"), "seller": ("销售方", "销货方", "收款方")}
ID_LABELS = ("统一社会信用代码", "纳税人识别号", "税号")
AMOUNT = r"-?\d[\d,]*(?:\.\d{1,2})?"
SHAPES = {
    "invoice_no": ("发票号码", r"\d{8,20}"),
    "invoice_code": ("发票代码", r"\d{10,12}"),
    "issue_date": ("开票日期", r"\d{4}[年\-/.]?\d{1,2}[月\-/.]?\d{1,2}日?"),
    "check_code": ("校验码", r"\d{15,25}"),
    "drawer": ("开票人", "[一-龥A-Za-z]{2,8}"),
}
TOTALS = (
    rf"价税合计[^¥￥]{{0,60}}?[¥￥]?({AMOUNT})",
    rf"[(（]小写[)）][¥￥]?({AMOUNT})",
    rf"价税合计[^0-9]{{0,60}}({AMOUNT})",
    rf"票价[^0-9¥￥]{{0,40}}?[¥￥]?({AMOUNT})",
)
PAIR = rf"合计[¥￥]({AMOUNT})[¥￥]({AMOUNT})"
ANY_PAIR = rf"[¥￥]({AMOUNT}[¥￥]{AMOUNT})"
AMOUNT_ALONE, TAX_ALONE = rf"合计金额[¥￥]?({AMOUNT})", rf"(?:合计税额|税额合计)[¥￥]?({AMOUNT})"
CAPITALS = ("价税合计[（(]大写[)）][:：]?([^0-9¥￥]{1,40}?)[（(]小写", "价税合计[（(]大写[)）][:：]?([零壹贰叁肆伍陆柒捌玖〇一二三四五六七八九拾佰仟万亿元角分整正]{2,40})")
ITEM = r"\*[^*\n]{1,20}\*[^*0-9\n]{0,30}"
ITEM_LABEL = r"(?:货物或应税劳务、?服务名称|项目名称)[:：]?([^\d¥￥]{2,30})" + NAME_STOP
TRAIN, STATION, FLIGHT = r"车次[:：]?([GDCZTKY]?\d{1,5})", "([一-龥]{2,8}站)", r"航班号[:：]?([A-Z]{2}\d{3,4})"
FREE = ("免税", "不征税")

# How sure a field is when it is read, by the way it was found.
BASE = {"invoice_no": 0.95, "invoice_code": 0.93, "issue_date": 0.95, "check_code": 0.9, "buyer_name": 0.85, "seller_name": 0.85, "buyer_tax": 0.88, "seller_tax": 0.88, "total": 0.92, "amount": 0.9, "tax": 0.9, "tax_rate": 0.85, "item_name": 0.9, "drawer": 0.85}
BAD_DATE, ALONE, LAST_PAIR, DERIVED, LABELLED_ITEM, RIDE, KNOWN_TYPE, UNKNOWN_TYPE = 0.35, 0.85, 0.55, 0.6, 0.7, 0.8, 0.9, 0.2
UNKNOWN = "未知类型"
EVIDENCE_CHARS = 80


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern's first match, else null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def from_word(text: Column, word: str) -> Column:
    """The text from the first place of ``word``, or null."""
    at = F.instr(text, F.lit(word))
    return F.when(at > 0, F.substr(text, at))


def detect_type(one: Column) -> Column:
    expr = F.when(F.lit(False), "")
    for words, kind in TITLES:
        hit = F.lit(True)
        for w in words:
            hit = hit & F.contains(one, F.lit(w))
        expr = expr.when(hit, kind)
    return expr.otherwise(UNKNOWN)


def is_edigital(kind: Column) -> Column:
    return F.coalesce(F.contains(kind, F.lit("数电")) | F.contains(kind, F.lit("全电")) | F.startswith(kind, F.lit("电子发票(")), F.lit(False))


def clean_name(name: Column) -> Column:
    """The name up to the next label, without blanks, marks and a bracket at its start; null if nothing is left."""
    # not by split(), which compiles its pattern for each row
    head = F.regexp_replace(F.regexp_replace(name, r"(?U)^[:：\s]+", ""), f"(?s)(?:{NAME_END}).*", "")
    head = F.regexp_replace(F.regexp_replace(head, r"(?U)[:：\s]+$", ""), r"^[（(].*?[)）]", "")
    return F.nullif(F.btrim(head, F.lit(" :：,，、")), F.lit(""))


def _first(text: Column, words: tuple[str, ...]) -> Column:
    """Where the first of the words stands (from 1), or null."""
    return F.least(*(F.nullif(F.instr(text, F.lit(w)), F.lit(0)) for w in words))


def _line_start(text: Column, at: Column) -> Column:
    return at - F.length(F.substring_index(F.left(text, at - 1), "\n", -1))


def section(text: Column, own: Column, rival: Column | None) -> Column:
    """The lines of a party: from the line of its first word up to the rival's line below, else eight lines."""
    rest = F.substr(text, _line_start(text, own))
    eight = F.substring_index(rest, "\n", 8)
    if rival is None:
        return F.when(own.isNotNull(), eight)
    below = (rival > own) & (_line_start(text, rival) > own)
    return F.when(own.isNotNull(), F.when(below, F.substr(text, _line_start(text, own), _line_start(text, rival) - _line_start(text, own))).otherwise(eight))


def with_party_name(df: DataFrame, who: str, one: Column, part: Column) -> DataFrame:
    """``<who>_name`` and ``_e_<who>_name``, where it was read: beside its label in the one-line view, else in its section.

    The later ways are tried only where the earlier ones leave no name.
    """
    first, *others = ROLES[who]
    alone = f"(?:信息)?名称[:：]?(.{{2,50}}?){NAME_STOP}"
    marked = f"(?:信息)?[:：]?名称[:：]?(.{{2,50}}?){NAME_STOP}"
    any_word, line = f"(?:{'|'.join(ROLES[who])})", "(?m)名称[:：]?(.+)$"
    out = df.withColumn("_n0", found(one, first + alone, 0)).withColumn("_v", clean_name(found(F.col("_n0"), first + alone)))
    later = {"_n1": F.coalesce(*(found(one, w + alone, 0) for w in others)), "_n2": F.coalesce(*(found(one, w + marked, 0) for w in ROLES[who])), "_n3": found(part, line, 0)}
    out = out.withColumns({k: F.when(F.col("_v").isNull(), x) for k, x in later.items()})
    value = F.coalesce("_v", clean_name(found(F.col("_n1"), any_word + alone)), clean_name(found(F.col("_n2"), any_word + marked)), clean_name(found(F.col("_n3"), line)))
    read = F.when(F.col("_v").isNotNull(), F.col("_n0")).otherwise(F.coalesce("_n1", "_n2", "_n3"))
    return out.withColumns({f"{who}_name": value, f"_e_{who}_name": read})


def party_tax(one: Column, part: Column, who: str) -> Column:
    """Tax id of a party: in its section, else within 120 characters of its word, unless the other party stands between."""
    id_ = f"(?:{'|'.join(ID_LABELS)})/?[:：]?([0-9A-Z]{{15,20}})"
    own, other = ROLES[who][0], ROLES["seller" if who == "buyer" else "buyer"][0]
    wide = found(one, f"{own}(?:信息)?.{{0,120}}?{id_}")
    rival = F.instr(one, F.lit(other))
    foreign = (rival > 0) & (F.instr(one, wide) > rival) & (F.instr(one, F.lit(own)) < rival)
    return F.coalesce(found(part, id_), F.when(~foreign, wide))


def rates(one: Column) -> Column:
    """Distinct rates in order, joined by a slash; amounts glued to a rate are peeled off from the left."""
    numbers = F.transform(F.regexp_extract_all(one, F.lit(r"(?<![\d.])(\d[\d.]*)%"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, r"^(?:\d[\d,]*\.\d{2})+(?=\d)", ""), r"^\.+|\.+$", ""))
    fine = F.filter(numbers, lambda x: (F.length(x).between(1, 5)) & F.coalesce(x.try_cast("double").between(0, 100), F.lit(False)))
    text = F.transform(fine, lambda x: F.concat(F.regexp_replace(x.cast("decimal(9,4)").cast("string"), r"\.?0+$", ""), F.lit("%")))
    listed = F.array_join(F.array_distinct(text), "/")
    free = F.concat_ws("/", *(F.when(F.contains(one, F.lit(w)), w) for w in FREE))
    return F.coalesce(F.nullif(listed, F.lit("")), F.nullif(free, F.lit("")))


def items(text: Column) -> Column:
    """Distinct *kind*name items of the lines, joined, at most 120 characters; null if there are none."""
    each = F.transform(F.regexp_extract_all(text, F.lit(ITEM), F.lit(0)), lambda i: F.regexp_replace(F.trim(i), r"\*$", ""))
    return F.nullif(F.left(F.array_join(F.array_distinct(F.filter(each, lambda i: i != "")), "; "), F.lit(120)), F.lit(""))


def _ride(one: Column, kind: Column) -> Column:
    stations = F.regexp_extract_all(one, F.lit(STATION), F.lit(1))
    train = F.concat(found(one, TRAIN), F.lit("次"))
    trip = F.when(F.size(stations) >= 2, F.array_join(F.slice(stations, 1, 2), "→"))
    return F.when(kind == RAIL, F.nullif(F.concat_ws(" ", train, trip), F.lit(""))).when(kind == AIR, found(one, FLIGHT))


def parse_fields(df: DataFrame, text_col: str = "text", type_col: str | None = None) -> DataFrame:
    """``df`` with the fields of one invoice per row; money as DECIMAL(18,2), a field not found is null.

    Also ``bad_date``, ``cn_amount``, ``c_<field>`` (how sure the field is, null if it is
    missing) and ``evidence`` (field to matched text). ``type_col`` has the type of the
    whole document; without it the row's own text gives the type. A null text gives null
    fields and the unknown type.
    """
    base = df.withColumn("_flat", S.flat_lines(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_t", S.stripped(F.col("_flat"))).withColumn("_one", S.oneline(F.col("_t")))
    one, t = F.col("_one"), F.col("_t")
    shaped = {k: f"{label}[:：]?({shape})" for k, (label, shape) in SHAPES.items()}
    # what patterns that begin with a word have to search: nothing where the word is not there
    base = base.withColumns({f"_from_{k}": from_word(one, w) for k, w in (("sum", "价税合计"), ("code", SHAPES["invoice_code"][0]), ("check", SHAPES["check_code"][0]), ("alone", "合计金额"))})
    place = {"invoice_code": F.col("_from_code"), "check_code": F.col("_from_check")}
    base = base.withColumns({f"_e_{k}": found(place.get(k, one), p, 0) for k, p in shaped.items()})
    base = base.withColumns(
        {
            "_b": _first(t, ROLES["buyer"]), "_s": _first(t, ROLES["seller"]), "_kind": detect_type(one),
            "_e_total": F.coalesce(*(found(F.col("_from_sum") if p.startswith("价税合计") else one, p, 0) for p in TOTALS)), "_e_pair": found(one, PAIR, 0),
            "_e_amount": found(F.col("_from_alone"), AMOUNT_ALONE, 0), "_e_tax": found(one, TAX_ALONE, 0),
            "_cn": F.coalesce(*(found(F.col("_from_sum"), p, 0) for p in CAPITALS)), "_items": items(t), "tax_rate": rates(one),
        }
    )
    base = base.withColumns({"_sb": section(t, F.col("_b"), F.col("_s")), "_ss": section(t, F.col("_s"), None)})
    iso, bad = S.to_date(found(F.col("_e_issue_date"), shaped["issue_date"]))
    for who, part in (("buyer", F.col("_sb")), ("seller", F.col("_ss"))):
        base = with_party_name(base, who, one, part).withColumn(f"{who}_tax", party_tax(one, part, who))
    last = F.element_at(F.regexp_extract_all(one, F.lit(ANY_PAIR), F.lit(1)), -1)
    lone = F.col("_e_pair").isNull() & F.col("_e_amount").isNull() & F.col("_e_tax").isNull()
    base = base.withColumns(
        {
            **{k: found(F.col(f"_e_{k}"), p) for k, p in shaped.items() if k != "issue_date"},
            "issue_date": iso, "bad_date": F.coalesce(bad, F.lit(False)),
            "total": S.to_money(found(F.col("_e_total"), f"({AMOUNT})$")),
            "cn_amount": S.cn_amount(F.coalesce(*(found(F.col("_cn"), p) for p in CAPITALS))),
            "_last": F.when(lone & one.rlike(ANY_PAIR), last),
            "item_name": F.coalesce("_items", found(one, ITEM_LABEL), _ride(one, F.col("_kind"))),
            "invoice_type": F.col(type_col) if type_col else F.col("_kind"),
        }
    )

    def side(k: int, pattern: str, hit: str) -> tuple[Column, Column]:
        paired, alone, rest = S.to_money(found(F.col("_e_pair"), PAIR, k)), S.to_money(found(F.col(hit), pattern)), S.to_money(F.split("_last", "[¥￥]")[k - 1])
        sure = F.when(paired.isNotNull(), BASE["amount"]).when(alone.isNotNull() & F.col("_e_pair").isNull(), ALONE).when(rest.isNotNull(), LAST_PAIR)
        return F.when(F.col("_e_pair").isNotNull(), paired).otherwise(F.coalesce(alone, rest)), sure

    (amount, a), (tax, x) = side(1, AMOUNT_ALONE, "_e_amount"), side(2, TAX_ALONE, "_e_tax")
    base = base.withColumns({"_amount": amount, "c_amount": a, "_tax": tax, "c_tax": x})
    derived = {"amount": F.col("total") - F.col("_tax"), "tax": F.col("total") - F.col("_amount")}
    base = base.withColumns({k: F.coalesce(f"_{k}", v).cast(S.MONEY) for k, v in derived.items()})
    sure = {f"c_{k}": F.when(F.col(k).isNotNull(), v) for k, v in BASE.items() if k not in ("amount", "tax")}
    sure |= {f"c_{k}": F.coalesce(f"c_{k}", F.when(F.col(k).isNotNull(), DERIVED)) for k in derived}
    sure["c_issue_date"] = F.when(F.col("bad_date"), BAD_DATE).when(F.col("issue_date").isNotNull(), BASE["issue_date"])
    ride = F.col("item_name").isNotNull() & F.col("_items").isNull()
    sure["c_item_name"] = F.when(F.col("_items").isNotNull(), BASE["item_name"]).when(ride, F.when(found(one, ITEM_LABEL).isNotNull(), LABELLED_ITEM).otherwise(RIDE))
    sure["c_invoice_type"] = F.when(F.col("invoice_type") == UNKNOWN, UNKNOWN_TYPE).otherwise(KNOWN_TYPE)
    read = {k: F.col(f"_e_{k}") for k in (*SHAPES, "buyer_name", "seller_name", "total")} | {k: F.col(k) for k in ("buyer_tax", "seller_tax", "tax_rate", "item_name", "invoice_type")}
    for k, why in (("amount", "价税合计 − 税额"), ("tax", "价税合计 − 金额")):
        read[k] = F.when(F.col(f"_{k}").isNull() & F.col(k).isNotNull(), why).otherwise(F.coalesce("_e_pair", f"_e_{k}", "_last"))
    read["cn_amount"] = F.col("_cn")
    done = base.withColumns({**sure, "evidence": evidence_map(read)})
    return done.drop(*(c for c in done.columns if c.startswith("_") and c not in df.columns))


def evidence_map(read: dict[str, Column]) -> Column:
    """Field to the text it was read from, without the fields that are missing."""
    pairs = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), F.left(v, F.lit(EVIDENCE_CHARS)).alias("value"))) for k, v in sorted(read.items())))
    return F.map_from_entries(F.array_compact(pairs))
