"""Validation rules R01 to R17 as a registry of Column builders.

A rule gives a list of checks: a condition with level, field, message and suggestion.
``validate`` turns every condition into a boolean column once, and collects the issues of
a record in one array from those; ``issue_rows`` explodes it. Rules that are switched off
are left out of the plan. A rule that cannot be built on the frame (a column is missing,
a type does not fit) gives a warning on its own id instead of ending the run; conditions
use only functions that don't raise on data. The date of the run is a setting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import fields as P
from ..functions import scalars as S

SEVERE, WARN, HINT, DUP = "严重", "警告", "提示", "重复"
# Rates in use and province codes of 20-digit numbers.
VALID_RATES = ("0%", "1%", "1.5%", "3%", "5%", "6%", "9%", "10%", "11%", "13%", "16%", "17%", "免税", "不征税", "***")
PROVINCES = (
    "11", "12", "13", "14", "15", "21", "22", "23", "31", "32", "33", "34", "35", "36", "37", "41",
    "42", "43", "44", "45", "46", "50", "51", "52", "53", "54", "61", "62", "63", "64", "65", "71",
)


@dataclass(frozen=True)
class Check:
    when: Column
    level: str
    field: str
    message: Column | str
    suggest: str


RULES: dict[str, tuple[str, str, Callable[[Config], list[Check]]]] = {}


def rule(rule_id: str, level: str, title: str):
    """Registers a builder of checks; the extension point for rules of one's own."""

    def register(fn):
        if rule_id in RULES:
            raise ValueError(f"rule {rule_id} is registered twice")
        RULES[rule_id] = (level, title, fn)
        return fn

    return register


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _money(x: Column) -> Column:
    return F.format_number(x, 2)


def relaxed() -> Column:
    kind = F.coalesce("invoice_type", F.lit(""))
    hit = F.lit(False)
    for t in P.RELAXED:
        hit = hit | F.contains(kind, F.lit(t))
    return hit


@rule("R01", SEVERE, "必填字段缺失")
def required(cfg):
    labels = {"invoice_no": "发票号码", "issue_date": "开票日期", "total": "价税合计", "seller_name": "销售方名称", "buyer_name": "购买方名称"}
    return [Check((_text(k) == "") & (~relaxed() if k == "seller_name" else F.lit(True)), SEVERE, v, f"未识别到「{v}」", "核对原件，必要时人工补录") for k, v in labels.items()]


@rule("R02", SEVERE, "发票号码含非数字")
def digits_only(cfg):
    return [Check((_text("invoice_no") != "") & ~_text("invoice_no").rlike("^[0-9]+$"), SEVERE, "发票号码", F.concat(F.lit("发票号码含非数字："), _text("invoice_no")), "核对发票号码")]


@rule("R03", WARN, "发票号码位数异常")
def number_length(cfg):
    no = _text("invoice_no")
    modern = P.is_edigital(F.col("invoice_type")) | (F.length(no) == 20)
    wrong = F.when(modern, F.length(no) != 20).otherwise(~F.length(no).isin(8, 9, 10, 12))
    return [Check((no != "") & wrong, WARN, "发票号码", F.concat(F.lit("发票号码位数为 "), F.length(no).cast("string")), "核对发票号码位数")]


@rule("R04", SEVERE, "开票日期异常")
def date_range(cfg):
    text, day = _text("issue_date"), F.try_to_date(F.col("issue_date"), "yyyy-MM-dd")
    limit = F.date_add(F.lit(cfg.as_of).cast("date"), cfg.future_date_grace_days)
    return [
        Check((text != "") & day.isNull(), SEVERE, "开票日期", F.concat(F.lit("开票日期无效："), text), "核对开票日期"),
        Check(day > limit, SEVERE, "开票日期", F.concat(F.lit("开票日期晚于当前日期："), text), "核对开票日期"),
        Check(day < F.lit("2000-01-01").cast("date"), WARN, "开票日期", F.concat(F.lit("开票日期过早："), text), "核对开票日期"),
    ]


@rule("R05", SEVERE, "金额勾稽不平")
def balance(cfg):
    gap = F.col("amount") + F.col("tax") - F.col("total")
    missing = F.col("total").isNotNull() & (F.col("amount").isNull() | F.col("tax").isNull())
    out = [Check(F.abs(gap) > F.lit(cfg.balance_tolerance).cast("decimal(9,4)"), SEVERE, "金额勾稽", F.concat(F.lit("金额 + 税额 与价税合计相差 "), _money(gap)), "核对金额、税额与价税合计")]
    return [*out, Check(missing, WARN, "金额勾稽", "金额或税额缺失，无法勾稽", "人工补录")] if cfg.missing_amount_warning else out


@rule("R06", HINT, "价税合计为负或零")
def sign(cfg):
    return [Check(F.col("total") < 0, HINT, "价税合计", "价税合计为负数（红字发票）", "确认是否红冲"), Check(F.col("total") == 0, WARN, "价税合计", "价税合计为 0", "核对金额")]


def _tax_ids():
    """Tax id, label and whether its check character is right, of buyer and seller."""
    return ((F.upper(F.trim(_text(k))), v, F.col(f"_ok_{k}")) for k, v in (("buyer_tax", "购买方税号"), ("seller_tax", "销售方税号")))


@rule("R07", SEVERE, "税号格式异常")
def tax_id_shape(cfg):
    out = []
    for x, label, _ in _tax_ids():
        shaped = x.rlike("^[0-9A-Z]{15,20}$")
        out += [Check((x != "") & ~shaped, SEVERE, label, F.concat(F.lit("税号格式异常："), x), "核对税号"), Check(shaped & ~F.length(x).isin(15, 17, 18, 20), WARN, label, F.concat(F.lit("税号位数为 "), F.length(x).cast("string")), "核对税号位数")]
    return out


@rule("R08", WARN, "信用代码校验位错误")
def tax_id_check(cfg):
    return [Check(~ok, WARN, label, F.concat(F.lit("统一社会信用代码校验位不通过："), x), "核对税号") for x, label, ok in _tax_ids()]


@rule("R09", WARN, "购销双方同名")
def same_party(cfg):
    return [Check((F.trim(_text("buyer_name")) != "") & (F.trim(_text("buyer_name")) == F.trim(_text("seller_name"))), WARN, "购销双方", "购买方与销售方名称相同", "核对购销双方")]


@rule("R10", HINT, "税率不常见")
def known_rate(cfg):
    """The first rate, of all that the invoice names, that is not in use."""
    odd = F.get(F.filter(F.split(_text("tax_rate"), "/"), lambda r: (r != "") & ~r.isin(*VALID_RATES)), F.lit(0))
    return [Check(odd.isNotNull(), HINT, "税率", F.concat(F.lit("税率不常见："), odd), "核对税率")]


@rule("R11", WARN, "非数电发票缺少发票代码")
def code_needed(cfg):
    return [Check(~P.is_edigital(F.col("invoice_type")) & (_text("invoice_code") == "") & (_text("invoice_no") != ""), WARN, "发票代码", "未识别到发票代码", "人工核对")]


@rule("R12", WARN, "销售方税号缺失")
def seller_tax_needed(cfg):
    return [Check(~relaxed() & (F.trim(_text("seller_tax")) == ""), WARN, "销售方税号", "销售方纳税人识别号缺失", "人工补录")]


def single_rate() -> Column:
    """The only percentage in ``tax_rate``, or null."""
    only = F.filter(F.split(_text("tax_rate"), "/"), lambda r: F.endswith(r, F.lit("%")))
    return F.when(F.size(only) == 1, F.regexp_replace(only[0], "%$", "").try_cast("decimal(9,4)"))


@rule("R13", SEVERE, "税额与金额×税率不勾稽")
def rate_balance(cfg):
    a, t = F.abs(F.col("amount")), F.abs(F.col("tax"))
    expect = a * single_rate() / 100
    slack = F.greatest(F.lit(cfg.rate_abs_floor).cast("decimal(9,4)"), a * F.lit(cfg.rate_rel_tolerance).cast("decimal(9,4)"))
    return [Check((a != 0) & (F.abs(t - expect) > slack), SEVERE, "税率×金额", F.concat(F.lit("税率 "), _text("tax_rate"), F.lit(" 与税额 "), _money(F.col("tax")), F.lit(" 不符")), "核对税率、金额与税额")]


@rule("R14", WARN, "数电发票号码结构异常")
def number_structure(cfg):
    no, year = _text("invoice_no"), F.substring(_text("issue_date"), 1, 4)
    long = no.rlike("^[0-9]{20}$")
    return [
        Check(long & ~F.substring(no, 3, 2).isin(*PROVINCES), WARN, "发票号码", F.concat(F.lit("省级区域码不在编码表内："), F.substring(no, 3, 2)), "核对发票号码"),
        Check(long & year.rlike("^[0-9]{4}$") & (F.substring(no, 1, 2) != F.substring(year, 3, 2)), WARN, "发票号码", F.concat(F.lit("号码前两位与开票年份不一致："), F.substring(no, 1, 2)), "核对号码或日期"),
    ]


@rule("R15", WARN, "发票代码结构异常")
def code_structure(cfg):
    code = _text("invoice_code")
    long = code.rlike("^[0-9]{12}$")
    return [
        Check(long & (F.substring(code, 1, 1) != "0"), WARN, "发票代码", F.concat(F.lit("12 位发票代码首位应为 0："), F.substring(code, 1, 1)), "核对发票代码"),
        Check(long & ~F.substring(code, 11, 2).isin("11", "13"), HINT, "发票代码", F.concat(F.lit("票种码不常见："), F.substring(code, 11, 2)), "确认票种码"),
    ]


@rule("R16", WARN, "购销方名称高度相似但税号不同")
def similar_parties(cfg):
    return [Check(F.col("_ok_similar") >= cfg.vendor_similarity, WARN, "购销双方", "购销双方名称高度相似但税号不同", "核对名称是否缺字，或确为关联方")]


def with_similar_parties(df: DataFrame, cfg: Config) -> DataFrame:
    """``_ok_similar``: how alike the parties' names are, where both names and both tax ids are there and differ."""
    (bt, *_), (st, *_) = _tax_ids()
    bn, sn = (F.trim(_text(k)) for k in ("buyer_name", "seller_name"))
    asked = (bn != "") & (sn != "") & (bt != "") & (st != "") & (bn != sn) & (bt != st)
    return S.with_similarity(df, F.when(asked, bn), F.when(asked, sn), "_ok_similar", cfg.vendor_similarity)


@rule("R17", WARN, "大写金额与小写金额不一致")
def capital_amount(cfg):
    return [Check(F.abs(F.col("cn_amount") - F.col("total")) > F.lit(cfg.balance_tolerance).cast("decimal(9,4)"), WARN, "价税合计", F.concat(F.lit("大写金额 "), _money(F.col("cn_amount")), F.lit(" 与小写不一致")), "核对大小写金额")]


def checks(df: DataFrame, cfg: Config, only: tuple[str, ...] | None = None) -> list[tuple[str, Check]]:
    """The checks of all rules that are on, by the names of their boolean columns, in the order of rule ids."""
    out: list[tuple[str, Check]] = []
    for rule_id, (_, _, build) in sorted(RULES.items()):
        if rule_id in cfg.rules_disabled or (only is not None and rule_id not in only):
            continue
        try:
            made = build(cfg)
            df.select(*(c.when for c in made)).schema  # analysed, not run
        except (PySparkException, TypeError, ValueError, KeyError, AttributeError) as e:
            made = [Check(F.lit(True), WARN, f"规则{rule_id}", f"规则无法执行：{type(e).__name__}", "联系维护者")]
        out += [(f"_is_{rule_id}_{k}", c) for k, c in enumerate(made)]
    return out


def flagged(df: DataFrame, cfg: Config, only: tuple[str, ...] | None = None) -> tuple[DataFrame, list[tuple[str, Check]]]:
    """``df`` with a boolean column for each check and ``issues`` made from them; the columns start with ``_is_`` and ``_ok_``."""
    ready = df.withColumns({f"_ok_{k}": S.uscc_check(F.col(k)) for k in ("buyer_tax", "seller_tax") if k in df.columns})
    if "R16" not in cfg.rules_disabled and (only is None or "R16" in only) and {"buyer_name", "seller_name"} <= set(ready.columns):
        ready = with_similar_parties(ready, cfg)
    found = checks(ready, cfg, only)
    ready = ready.withColumns({name: F.coalesce(c.when, F.lit(False)) for name, c in found})

    def row(name: str, c: Check) -> Column:
        text = F.lit(c.message) if isinstance(c.message, str) else c.message
        return F.when(F.col(name), F.struct(F.lit(c.level).alias("level"), F.lit(c.field).alias("field"), text.alias("message"), F.lit(c.suggest).alias("suggest")))

    none = F.array().cast("array<struct<level:string,field:string,message:string,suggest:string>>")
    return ready.withColumn("issues", F.array_compact(F.array(*(row(*x) for x in found))) if found else none), found


def plain(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(("_is_", "_ok_"))))


def validate(df: DataFrame, cfg: Config = Config(), only: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with ``issues``: the issues of all rules that are on, in the order of rule ids."""
    return plain(flagged(df, cfg, only)[0])


def issue_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per issue with its position. The outer form keeps the optimizer from testing the array below, which would compute the rules twice."""
    return df.select(*keys, F.posexplode_outer("issues").alias("position", "i")).where("i is not null").select(*keys, "position", "i.*")


def registry(spark, cfg: Config = Config()) -> DataFrame:
    """The rules as a table: id, level, title and whether the rule is on."""
    return spark.createDataFrame([(k, level, title, k not in cfg.rules_disabled) for k, (level, title, _) in sorted(RULES.items())], "rule_id string, level string, title string, active boolean")
