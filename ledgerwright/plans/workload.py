"""The invoice workload on the star-schema tables and its queries; ``oracles`` has their SQL.

Each line item becomes an invoice in integer cents, so that sums are exact in every
engine. Every 97th order's total is off by 180.00, which the balance rule has to find.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import fields as P
from ..functions import scalars as S
from ..operators import ledger as L
from ..operators import rules as R
from ..operators import scoring as C
from ..operators import segments as G
from ..operators import templates as M
from ..operators import views as V
from ..sources import files as FS
from ..storage import written
from ..streaming import watch as W
from . import batch as B
from . import sinks as K

TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
AS_OF = Config(as_of="2030-01-01")


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to at least as many tasks as there are cores: a file of one row group is read by one."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def cents(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with amount_c, tax_c, total_c and rate_pct."""
    amount = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("long")
    items = t(spark, sf, "lineitem").withColumn("amount_c", amount)
    items = items.withColumn("tax_c", F.floor(F.col("amount_c") * F.col("l_tax") + 0.5).cast("long"))
    off = F.when(F.col("l_orderkey") % 97 == 0, 18000).otherwise(0)
    return items.withColumn("total_c", F.col("amount_c") + F.col("tax_c") + off).withColumn("rate_pct", F.floor(F.col("l_tax") * 100 + 0.5).cast("int"))


def money(c: str):
    return (F.col(c).cast("decimal(18,0)") / 100).cast(S.MONEY)


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Records with the ledger's fields: buyers are customers, sellers suppliers, numbers and ids made by rule."""
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = t(spark, sf, "customer").select("c_custkey", "c_name")
    suppliers = t(spark, sf, "supplier").select("s_suppkey", "s_name")
    j = cents(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    j = spread(j, "l_orderkey")
    day = F.col("o_orderdate").cast("date")
    region = F.lpad((F.col("l_suppkey") % 70 + 10).cast("string"), 2, "0")
    uscc = lambda k: S.uscc_complete(F.concat(F.lit("91310000"), F.lpad(F.col(k).cast("string"), 9, "0")))
    number = S.e_invoice_no(region, F.year(day), F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.lit(1))
    return j.select(
        *TIES,
        F.concat(F.lit("inv-"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.lit("数电发票(普通发票)").alias("invoice_type"),
        number.alias("invoice_no"),
        F.lit(None).cast("string").alias("invoice_code"),
        F.date_format(day, "yyyy-MM-dd").alias("issue_date"),
        F.lit(False).alias("bad_date"),
        F.col("c_name").alias("buyer_name"),
        uscc("o_custkey").alias("buyer_tax"),
        F.col("s_name").alias("seller_name"),
        F.when(F.col("l_suppkey") % 11 == 0, F.concat(F.substring(uscc("l_suppkey"), 1, 17), F.lit("Z"))).otherwise(uscc("l_suppkey")).alias("seller_tax"),
        money("amount_c").alias("amount"), money("tax_c").alias("tax"), money("total_c").alias("total"),
        F.concat(F.col("rate_pct").cast("string"), F.lit("%")).alias("tax_rate"),
        F.lit("*服务*咨询").alias("item_name"), F.lit(None).cast("string").alias("check_code"), F.lit("王芳").alias("drawer"),
        F.lit(None).cast("decimal(18,2)").alias("cn_amount"),
    )


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices with issues, confidence and status."""
    return C.judged(invoices(spark, sf), AS_OF)


#: What a case changes in the invoice it is made from; case 0 and the numbers not named change nothing.
SPECIAL = "增值税专用发票"
CASES = 26


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices with ``case``: each but the first breaks the invoice in one way, so that every rule has hits."""
    row = invoices(spark, sf).withColumn("case", ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")) % CASES).cast("int"))
    none = F.lit(None).cast("string")
    ten = F.lpad(F.col("l_orderkey").cast("string"), 10, "0")
    plus = lambda c, x: (F.col(c) + F.lit(x).cast("decimal(18,2)")).cast(S.MONEY)
    change = {
        "invoice_type": {5: F.lit(P.RAIL), 9: F.lit(SPECIAL), 10: F.lit(SPECIAL)},
        "invoice_no": {1: none, 7: F.concat(F.lit("2631A2"), ten, F.lit("0000")), 8: F.left("invoice_no", F.lit(19)), 9: F.right(ten, F.lit(8)), 10: F.concat(F.lit("1"), ten)},
        "invoice_code": {10: F.lit("131002600111"), 11: F.lit("031002600199")},
        "issue_date": {2: none, 12: F.lit("2021-02-30"), 13: F.lit("2031-05-05")},
        "buyer_name": {6: none},
        "seller_name": {4: F.lit(""), 5: F.lit(""), 19: F.col("buyer_name"), 23: F.concat("buyer_name", F.lit("0"))},
        "buyer_tax": {16: F.lit("abc-1"), 17: F.lit("9131000000000000")},
        "seller_tax": {21: none},
        "amount": {14: -F.col("amount"), 15: F.lit(0).cast(S.MONEY)},
        "tax": {14: -F.col("tax"), 15: F.lit(0).cast(S.MONEY), 22: plus("tax", 100)},
        "total": {3: F.lit(None).cast(S.MONEY), 14: -F.col("total"), 15: F.lit(0).cast(S.MONEY), 22: plus("total", 100)},
        "tax_rate": {20: F.lit("6%/7%"), 25: F.lit("免税")},
        "cn_amount": {24: plus("total", 1)},
    }
    new = {}
    for col, by_case in change.items():
        expr = F.col(col)
        for k, v in by_case.items():
            expr = F.when(F.col("case") == k, v).otherwise(expr)
        new[col] = expr
    return row.withColumns({**new, "bad_date": F.col("case") == 12})


def q_rule_cases(spark, sf):
    """Issues of every rule, by case."""
    return R.issue_rows(R.validate(cases(spark, sf), AS_OF), "case").groupBy("case", "level", "field").agg(F.count(F.lit(1)).alias("n_issues"))


def q_case_status(spark, sf):
    rows = C.judged(cases(spark, sf), AS_OF)
    return rows.groupBy("case", "status", F.round(F.col("confidence") * 1000).cast("int").alias("permille")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_case_summary(spark, sf):
    rows = C.judged(cases(spark, sf), AS_OF)
    return rows.groupBy("case", F.sha2(C.summary(2), 256).alias("issue_sha256")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_rules_off(spark, sf):
    """The cases again with three rules switched off."""
    rows = C.judged(cases(spark, sf), Config(as_of="2030-01-01", rules_disabled=frozenset(("R05", "R10", "R14"))))
    return rows.groupBy("case", "status").agg(F.count(F.lit(1)).alias("n_rows"))


def q_invoice_balance(spark, sf):
    """R05 over all invoices, by supplier."""
    bad = R.validate(invoices(spark, sf), AS_OF, only=("R05",)).where(F.size("issues") > 0)
    gap = F.sum(((F.col("amount") + F.col("tax") - F.col("total")) * 100).cast("long"))
    return bad.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"), gap.alias("gap_c"))


def q_rate_check(spark, sf):
    """R13 over all invoices whose rate is written three points too low."""
    low = F.greatest(F.floor(F.col("l_tax") * 100 + 0.5).cast("int") - 3, F.lit(0))
    rows = invoices(spark, sf).withColumn("rate_pct", low + 3).withColumn("tax_rate", F.concat(low.cast("string"), F.lit("%")))
    return R.validate(rows, AS_OF, only=("R13",)).groupBy("tax_rate").agg(F.count_if(F.size("issues") > 0).alias("n_bad"), F.count(F.lit(1)).alias("n_rows"))


def q_seller_summary(spark, sf):
    return L.seller_summary(judged(spark, sf))


def q_top_sellers(spark, sf):
    return L.seller_summary(judged(spark, sf), top=20)


def q_status_histogram(spark, sf):
    return L.status_histogram(judged(spark, sf))


def q_ledger_totals(spark, sf):
    """Counted rows of the cases, every tenth supplier's rows marked as duplicates."""
    rows = C.judged(cases(spark, sf), AS_OF)
    return L.totals(rows.withColumn("status", F.when(F.col("l_suppkey") % 10 == 0, C.DUPLICATE).otherwise(F.col("status"))))


def q_issue_counts(spark, sf):
    return R.issue_rows(judged(spark, sf), "file_name").groupBy("level", "field").agg(F.count(F.lit(1)).alias("n_issues"))


def q_issue_summary(spark, sf):
    return judged(spark, sf).groupBy(C.summary().alias("issue")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_confidence(spark, sf):
    return judged(spark, sf).groupBy("status", F.round(F.col("confidence") * 1000).cast("int").alias("permille")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_uscc_check(spark, sf):
    keys = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("91310000"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("body"))
    code = keys.withColumn("code", S.uscc_complete(F.col("body")))
    return code.select("c_custkey", "code", S.uscc_check(F.col("code")).alias("ok"), S.uscc_check(F.concat("body", F.lit("0"))).alias("ok_zero"), S.uscc_check(F.concat(F.left("body", F.lit(16)), F.lit("I0"))).alias("ok_letter"))


def q_numbering(spark, sf):
    o = t(spark, sf, "orders")
    year, kind = F.year(F.col("o_orderdate").cast("date")), F.when(F.col("o_orderkey") % 2 == 0, "11").otherwise("13")
    region = F.lpad((F.col("o_custkey") % 90 + 10).cast("string"), 2, "0")
    return o.select("o_orderkey", S.invoice_code(region, year, F.col("o_orderkey") % 1000, kind).alias("code"), S.e_invoice_no(region, year, F.col("o_orderkey"), F.lit(1)).alias("number"), (~region.isin(*R.PROVINCES)).alias("bad_province"))


def q_region_codes(spark, sf):
    """Codes made from region names, and what is wrong with codes broken on purpose."""
    names = list(S.REGIONS)
    o = t(spark, sf, "orders").withColumn("region", F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int")))
    code = S.invoice_code(S.region_code(F.col("region")), F.year(F.col("o_orderdate").cast("date")), F.col("o_orderkey") % 999 + 1, F.lit(S.KINDS["专票"]))
    broken = F.when(F.col("o_orderkey") % 4 == 0, F.left("code", F.lit(11))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("1"), F.substring("code", 2, 11))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.left("code", F.lit(10)), F.lit("12"))).otherwise(F.col("code"))
    return o.withColumn("code", code).select("o_orderkey", "region", "code", S.code_fault(broken).alias("fault"))


def q_file_dedupe(spark, sf):
    """Documents as files; those with an id that 17 divides are in the ledger already."""
    files = t(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), (F.col("doc_id") % 13).alias("mtime"), F.col("doc_id").alias("file_name"))
    ledger = files.where("doc_id % 17 = 0").select(F.left(F.sha2("content", 256), F.lit(16)).alias("file_hash"))
    return L.file_dedupe(files, ledger).select("doc_id", "file_hash", "is_first", "known")


def q_invoice_dedupe(spark, sf):
    marked = L.first_wins(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"])
    return marked.where("is_first").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_first"), F.sum("l_partkey").alias("parts"))


def q_text_quality(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.round(S.text_quality(F.col("text")) * 1000).cast("int").alias("permille"))


def _line(*parts) -> F.Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def _rendered(spark, sf):
    i = invoices(spark, sf)
    text = _line(
        "发票号码：", F.col("invoice_no"), "\n开票日期：", F.regexp_replace("issue_date", r"(\d+)-(\d+)-(\d+)", "$1年$2月$3日"), "\n电子发票（普通发票）\n购买方名称：", F.col("buyer_name"), "\n纳税人识别号：", F.col("buyer_tax"),
        "\n销售方名称：", F.col("seller_name"), "\n纳税人识别号：", F.col("seller_tax"), "\n*服务*咨询\n税率", F.col("tax_rate"), "\n合计￥", F.col("amount").cast("string"), "￥", F.col("tax").cast("string"),
        "\n价税合计（小写）￥", F.col("total").cast("string"), "\n开票人：王芳",
    )
    return i.withColumn("text", text)


def _compared(parsed: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    """Rows and equal values per field; counted side by side and turned into rows after it, so that no row is copied for each field."""
    counts = parsed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(c).eqNullSafe(F.col(f"true_{c}"))).alias(c) for c in cols))
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("field"), "n_rows", F.col(c).alias("n_equal")) for c in cols)))
    return counts.select(*keys, each)


def q_field_extract(spark, sf):
    """Texts rendered from invoices and parsed back; one row per field with the number of rows and of equal values."""
    true = _rendered(spark, sf)
    cols = ["invoice_no", "issue_date", "buyer_name", "buyer_tax", "seller_name", "seller_tax", "amount", "tax", "total", "tax_rate", "drawer"]
    rows = S.normalised(true.select("text", *(F.col(c).alias(f"true_{c}") for c in cols)))
    return _compared(P.parse_fields(rows), cols)


LAYOUTS = 10


def q_layouts(spark, sf):
    """Ten layouts of the same invoices parsed back: sums apart, derived, in pairs, whole, negative; tickets, labelled items, capitals, bad dates.

    One row per layout and field, with the confidence of amount and item in thousandths.
    """
    i = invoices(spark, sf).withColumn("layout", ((F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey")) % LAYOUTS).cast("int")).withColumns({"tax": F.abs("tax"), "total": F.abs(F.col("amount") + F.col("tax")).cast(S.MONEY)})
    k, m = F.col("layout"), lambda c: F.col(c).cast("string")
    whole = lambda c: F.round(c, 0).cast("decimal(18,0)").cast("string")
    head = _line("发票号码:", F.col("invoice_no"), "\n开票日期:", F.when(k == 9, "2021-02-30").otherwise(F.col("issue_date")), "\n购买方 名称:", F.col("buyer_name"), " 税号:", F.col("buyer_tax"), "\n销售方 名称:", F.col("seller_name"), " 税号:", F.col("seller_tax"), "\n")
    digit = F.element_at(F.array(*map(F.lit, "壹贰叁肆伍陆柒捌玖")), (F.col("l_linenumber") % 9 + 1).cast("int"))
    bodies = [
        _line("普通发票 电子发票\n合计金额¥", m("amount"), " 合计税额¥", m("tax"), "\n价税合计¥", m("total")),
        _line("电子发票 专用发票\n税额合计", m("tax"), "\n价税合计(小写)¥", m("total")),
        _line("数电\n", "¥1.00¥2.00 x ¥", m("amount"), "¥", m("tax"), "\n价税合计:¥", m("total")),
        _line("发票\n合计¥", whole(F.col("amount")), "¥", whole(F.col("tax")), "\n(小写)¥", whole(F.col("total"))),
        _line("增值税专用发票\n合计¥-", m("amount"), "¥-", m("tax"), "\n价税合计-", m("total")),
        _line("铁路电子客票\n车次:G", (F.col("l_linenumber") + 100).cast("string"), "\n票价¥", m("total"), "\n甲乙站,丙丁站"),
        _line("航空运输电子客票行程单\n航班号:CA", (F.col("l_linenumber") + 1000).cast("string"), "\n票价:¥", m("total")),
        _line("增值税普通发票\n项目名称:咨询服务费单价\n合计¥", m("amount"), "¥", m("tax"), "\n价税合计¥", m("total")),
        _line("增值税电子普通发票\n*信息*服务* 1\n价税合计(大写)", digit, "万零", digit, "拾圆整(小写)¥", m("total")),
        _line("机动车销售统一发票\n*车辆*轿车\n合计¥", m("amount"), "¥", m("tax"), "\n价税合计¥", m("total")),
    ]
    types = ["数电发票(普通发票)", "数电发票(增值税专用发票)", "数电发票", "电子发票(其他)", SPECIAL, P.RAIL, P.AIR, "增值税普通发票", "电子普通发票", "机动车销售统一发票"]

    def by_layout(values: dict[int, F.Column], other=None):
        out = F.lit(None) if other is None else other
        for n, v in values.items():
            out = F.when(k == n, v).otherwise(out)
        return out

    rounded = lambda c: F.round(F.col(c), 0).cast(S.MONEY)
    none, item = F.lit(None).cast(S.MONEY), F.lit(None).cast("string")
    true = {
        "invoice_type": F.element_at(F.array(*map(F.lit, types)), k + 1),
        "amount": by_layout({3: rounded("amount"), 4: -F.col("amount"), 5: none, 6: none, 8: none}, F.col("amount")),
        "tax": by_layout({3: rounded("tax"), 4: -F.col("tax"), 5: none, 6: none, 8: none}, F.col("tax")),
        "total": by_layout({3: rounded("total"), 4: -F.col("total")}, F.col("total")),
        "item_name": by_layout({5: _line("G", (F.col("l_linenumber") + 100).cast("string"), "次 甲乙站→丙丁站"), 6: _line("CA", (F.col("l_linenumber") + 1000).cast("string")), 7: F.lit("咨询服务费单价"), 8: F.lit("*信息*服务"), 9: F.lit("*车辆*轿车")}, item),
        "issue_date": by_layout({9: F.lit("2021-02-30")}, F.col("issue_date")),
        "bad_date": k == 9,
        "cn_amount": by_layout({8: ((F.col("l_linenumber") % 9 + 1) * 10010).cast(S.MONEY)}, none),
        "buyer_name": F.col("buyer_name"), "seller_name": F.col("seller_name"), "buyer_tax": F.col("buyer_tax"), "seller_tax": F.col("seller_tax"),
    }
    text = by_layout(dict(enumerate(bodies)))  # only the body of the row's own layout is made
    rows = i.select("layout", F.concat(head, text).alias("text"), *(v.alias(f"true_{c}") for c, v in true.items()))
    parsed = P.parse_fields(S.normalised(rows))
    sure = lambda c: F.coalesce(F.round(F.col(c) * 1000).cast("int"), F.lit(0))
    return _compared(parsed.withColumns({"sure_amount": sure("c_amount"), "sure_item": sure("c_item_name")}), list(true), "layout", "sure_amount", "sure_item")


def q_type_detect(spark, sf):
    """The title of every document and of titles made from orders."""
    titles = F.array(*(F.lit(x) for x in ("电子发票(铁路电子客票)", "电子发票 增值税专用发票", "电子发票 普通发票", "增值税专用发票", "全电", "二手车销售统一发票", "收据", "发票", "航空运输电子客票行程单", "收费公路通行费", "增值税电子专用发票", "增值税电子普通发票", "机动车销售统一发票", "增值税普通发票", "数电发票备注")))
    k = t(spark, sf, "orders").select(F.element_at(titles, (F.col("o_orderkey") % 15 + 1).cast("int")).alias("title"))
    k = k.unionByName(t(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("title")))
    return k.groupBy(P.detect_type(F.col("title")).alias("invoice_type")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_rate_extract(spark, sf):
    text = F.concat(F.lit("税率1,234.50"), F.col("rate_pct").cast("string"), F.lit("%税额13%"))
    return cents(spark, sf).groupBy(P.rates(text).alias("rates")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_normalise(spark, sf):
    """Order comments of a kind in full-width forms, and texts of documents, in form NFKC."""
    wide = F.translate(F.concat(F.lit("No."), F.col("o_orderkey").cast("string"), F.lit(" (A)￥５Ⅷ㈱\r\n")), "0123456789().", "０１２３４５６７８９（）．")
    made = S.normalised(t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), wide.alias("text")))
    return made.select("key", "text")


def q_csv_cells(spark, sf):
    o = F.col("o_orderkey").cast("string")
    return t(spark, sf, "orders").select(
        "o_orderkey", S.csv_text_cell(F.lpad(o, 9, "0")).alias("cell"), S.parse_csv_cell(S.csv_text_cell(F.lpad(o, 9, "0"))).alias("back"), S.csv_escape(F.concat(F.col("o_orderpriority"), F.lit(',"'))).alias("escaped"),
        S.html_escape(F.concat(F.lit("<a&"), o, F.lit('">'))).alias("html"), F.format_number(F.col("o_orderkey") * 1000, 2).alias("money"), S.percent((F.col("o_orderkey") % 1000) / 1000).alias("percent"),
        S.placeholder_to_empty(F.when(F.col("o_orderkey") % 2 == 0, "—").otherwise(o)).alias("plain"), S.display_name(o, F.col("o_orderkey") % 3 + 1, F.col("o_orderkey") % 3 + 1).alias("shown"),
        S.readable_size(F.col("o_orderkey") * 64).alias("size"),
    )


def q_ledger_merge(spark, sf):
    """Two batches of orders by date; the second brings some customers' first batch again."""
    o = t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("invoice_no"), F.lit("").alias("invoice_code"), F.col("o_orderkey"), F.col("o_orderdate").cast("date").alias("day"))
    first, _ = L.split_duplicates(o.where("day < date'1996-01-01'"), ["day", "o_orderkey"])
    fresh, again = L.split_duplicates(o.where("day >= date'1996-01-01'"), ["day", "o_orderkey"], ledger=first)
    count = lambda d, n: d.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("keys"))
    return count(first, "first").union(count(fresh, "fresh")).union(count(again, "again"))


def q_review_list(spark, sf):
    """Invoices whose money and names were not read: their confidence puts them on the list."""
    thin = invoices(spark, sf).withColumns({k: F.when(F.col("l_linenumber") >= 4, F.lit(None)).otherwise(F.col(k)) for k in ("amount", "tax", "seller_tax", "buyer_tax", "tax_rate", "item_name")})
    rows = L.review_list(written(C.judged(thin, AS_OF).select("l_linenumber", "status"), "judged"))
    return rows.groupBy("status", "l_linenumber").agg(F.count(F.lit(1)).alias("n_rows"))


def q_distinct_files(spark, sf):
    named = S.display_name(F.col("file_name"), F.col("l_linenumber"), F.lit(7))
    return L.distinct_files(invoices(spark, sf).withColumn("file_name", named))


def _polls(spark, sf):
    return t(spark, sf, "events").select((F.col("event_id") % 20).alias("poll"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.lit(0).alias("mtime"), F.floor(F.col("event_id") % 20 / 5).alias("size")).distinct()


def q_watch_settle(spark, sf):
    return W.settled(_polls(spark, sf)).groupBy("poll").agg(F.count(F.lit(1)).alias("n_ready"))


def q_watch_rounds(spark, sf):
    """The same polls as six rounds of the watcher, each from the state before it."""
    polls = written(_polls(spark, sf).where("poll < 6").withColumn("mtime", F.timestamp_seconds("mtime")), "polls")
    state, out = spark.createDataFrame([], W.STATE), None
    for k in range(6):
        state = written(W.next_state(state, polls.where(F.col("poll") == k).drop("poll"), first=k == 0), "poll-state")
        n = state.agg(F.lit(k).cast("long").alias("poll"), F.count(F.lit(1)).alias("n_files"), F.count_if("ready").alias("n_ready"))
        out = n if out is None else out.unionByName(n)
    return out


def q_cn_amount(spark, sf):
    """Capital amounts made from order keys and read back, and six written ones."""
    words = F.array(*(F.lit(x) for x in ("壹仟零陆拾圆整", "叁佰壹拾捌元伍角", "一亿二千万元", "拾元零叁分", "整", "玖万捌仟柒佰陆拾伍元肆角叁分")))
    o = t(spark, sf, "orders")
    d = lambda p: F.element_at(F.array(*map(F.lit, "零壹贰叁肆伍陆柒捌玖")), (F.floor(F.col("o_orderkey") / p) % 10 + 1).cast("int"))
    made = F.concat(d(10000), F.lit("万"), d(1000), F.lit("仟"), d(100), F.lit("佰"), d(10), F.lit("拾"), d(1), F.lit("元整"))
    text = F.when(F.col("o_orderkey") % 3 == 0, made).otherwise(F.element_at(words, (F.col("o_orderkey") % 6 + 1).cast("int")))
    return o.select("o_orderkey", S.cn_amount(text).alias("amount"))


def q_similarity(spark, sf):
    """Every customer against the supplier of the same key, where there is one; the ratio has no SQL, tests hold it against difflib."""
    s = t(spark, sf, "supplier").select("s_suppkey", "s_name")
    pairs = t(spark, sf, "customer").join(s, F.col("c_custkey") % 100 + 1 == F.col("s_suppkey"))
    return S.with_similarity(pairs, F.col("c_name"), F.col("s_name"), "similarity").select("c_custkey", "similarity")


def q_jaccard(spark, sf):
    s = t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return s.select("c_custkey", F.round(S.jaccard(F.col("c_name"), F.col("c_mktsegment")) * 1000).cast("int").alias("permille"))


def _files(spark, sf):
    """The rendered invoices of each order in one text."""
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "invoice_no", "text")))
    return _rendered(spark, sf).groupBy("l_orderkey", "file_name").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("n"))


def q_segments(spark, sf):
    """The texts of orders split again, repeated numbers of a file dropped, the rest named by place."""
    rows = G.split_segments(_files(spark, sf)).withColumn("invoice_no", F.regexp_extract("text", r"发票号码：(\d+)", 1))
    kept = G.named(G.drop_repeated_numbers(rows))
    return kept.groupBy("file_name", "n", "segments").agg(F.count(F.lit(1)).alias("n_kept"), F.max_by("display_name", "segment").alias("last_name"))


def q_segment_forms(spark, sf):
    """Files whose invoices start by other labels, by titles, or hold a fragment and a mention of another number."""
    o = t(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 4)
    key = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    body = "\n开票日期:2026-01-01\n合计¥1¥1\n价税合计¥2"
    ticket = lambda n: _line("(票据号码: ", key, n, body)
    titled = lambda n: _line("电子发票(普通发票)\n发票号码:", key, n, body)
    text = F.when(F.col("k") == 0, F.concat_ws("\n", F.lit("发票号码 发票号码"), ticket("1"), ticket("2"))).when(F.col("k") == 1, F.concat_ws("\n", titled("1"), titled("2"), titled("3")))
    text = text.when(F.col("k") == 2, _line(titled("1"), "\n备注:原发票号码 ", key, " 已作废")).otherwise(_line("发票No ", key, body, "\n增值税普通发票\n页脚 发票No ", key))
    rows = G.split_segments(o.select("k", F.concat(F.lit("o"), key).alias("file_name"), text.alias("text")))
    return rows.groupBy("k", "segments").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("file_name").alias("n_files"))


def q_detail_csv(spark, sf):
    """Every invoice as a line of the detail file."""
    rows = judged(spark, sf).withColumn("issue", C.summary())
    return K.csv_lines(rows.drop("confidence_map")).groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))


def q_view_choice(spark, sf):
    """Conversations as files, their turns as views, those of the assistant as recognised texts."""
    turns = t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "ocr").otherwise("layer").alias("source"), "text")
    picked = V.choose_view(turns, "conv_id", "turn")
    return picked.select("conv_id", "choice", F.sha2("text", 256).alias("text_sha256"), F.round(F.col("quality") * 1000).cast("int").alias("permille"))


def q_distinct_views(spark, sf):
    turns = t(spark, sf, "conversations").select(F.col("conv_id").alias("file_name"), F.col("turn").alias("view"), F.left(F.coalesce("text", F.lit("")), F.lit(1)).alias("text"))
    return V.distinct_views(turns).groupBy("file_name").agg(F.count(F.lit(1)).alias("n_views"), F.min("view").alias("first_view"), F.max("view").alias("last_view"))


def q_best_view(spark, sf):
    """Line items as views of their order, their quantity as confidence: the best mean, the earliest of equals."""
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_name"), F.col("l_linenumber").alias("view"), (F.col("l_quantity") / 50).cast("double").alias("_read"))
    best = C.best_views(rows, "file_name")
    return best.groupBy("file_name", "view", "views").agg(F.count(F.lit(1)).alias("n_rows"))


def q_extractor_mix(spark, sf):
    return L.extractor_mix(t(spark, sf, "events").select(F.col("event_type").alias("extractor")))


def q_numbered(spark, sf):
    """Orders numbered by date and key, after 1000 others."""
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return L.with_seq(o, ["day", "o_orderkey"], start=1000).select("o_orderkey", "seq")


def q_issue_upkeep(spark, sf):
    """Issues of two batches of orders: inserted if absent, stale ones purged, numbered anew."""
    o = t(spark, sf, "orders")
    stale = F.when(F.col("o_orderkey") % 3 == 0, "文本提取").otherwise("税率")
    def rows(k):
        return o.where(F.col("o_orderkey") % 5 < k).select(F.concat(F.lit("f"), (F.col("o_custkey") % 500).cast("string")).alias("file_name"), F.when(F.col("o_orderkey") % 2 == 0, "—").otherwise(F.lit("")).alias("invoice_no"), F.lit("警告").alias("level"), stale.alias("field"), F.col("o_orderpriority").alias("message"))
    both = L.add_issues(L.add_issues(rows(0), rows(2)), rows(4))
    kept = L.purge_issues(both, both.where("cast(substr(file_name, 2) as int) % 4 = 0").select("file_name"))
    return kept.groupBy("file_name", "invoice_no", "level", "field", "message").agg(F.count(F.lit(1)).alias("n_rows"))


def q_removed_rows(spark, sf):
    files = t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 100).cast("string").alias("file_hash"))
    return L.remove_rows(files, files.where("o_orderkey % 90 = 0")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("keys"))


def q_templates(spark, sf):
    """Three templates over texts of orders: a pattern with a group, one without, a broken one, a date, a fixed value."""
    o = t(spark, sf, "orders")
    money_text = F.format_number(F.col("o_orderkey") * 1000 / 100, 2)
    text = _line("发票 甲公司 单号", F.col("o_orderkey").cast("string"), " 金额", money_text, " 日期1996/3/7 级别", F.split("o_orderpriority", "-")[0], F.when(F.col("o_orderkey") % 5 == 0, " 作废").otherwise(""), F.when(F.col("o_orderkey") % 3 == 0, " 乙集团").otherwise(""))
    made = [
        {"name": "甲", "keywords": ["发票", "甲公司"], "exclude_keywords": ["作废"], "fields": {"invoice_no": [r"单号(\d{9,})", r"单号(\d+)"], "total": [r"金额([\d,.]+?)日期"], "issue_date": [r"\d{4}/\d+/\d+"], "item_name": ["级别(?P<n>[0-9])", "("]}, "static": {"seller_name": "甲公司"}},
        {"name": "乙", "keywords": ["发票", "甲公司", "乙集团"], "fields": {"invoice_no": [r"单号\d+"]}, "static": {"seller_name": "乙集团"}},
        {"name": "丙", "keywords": ["发票"], "fields": {}, "static": {}},
    ]
    rows = M.apply_templates(P.parse_fields(o.select("o_orderkey", text.alias("text"))), made)
    return rows.select("o_orderkey", "template", "invoice_no", "total", "issue_date", "item_name", "seller_name", F.round(F.coalesce("c_invoice_no", F.lit(0.0)) * 1000).cast("int").alias("sure"), F.map_keys("evidence").cast("string").contains("!item_name").alias("broken"))


def delivered(spark, sf) -> DataFrame:
    """Files of two batches: each order's text, byte copies under other names, the same invoices with a note, and files without text."""
    files = written(_files(spark, sf).select(F.col("l_orderkey").alias("ok"), "file_name", "text"), "files")
    key = F.col("ok").cast("string")
    main = F.col("ok") % 4 != 0
    noted = F.concat("text", F.lit("\n备注:重开"))
    kinds = [
        (1, 0, main, "file_name", F.col("text")), (1, 1, main & (F.col("ok") % 5 == 1), "copy-", F.col("text")), (1, 2, main & (F.col("ok") % 9 == 2), "re-", noted), (1, 3, F.col("ok") % 50 == 7, "scan-", None),
        (2, 4, ~main, "file_name", F.col("text")), (2, 5, main & (F.col("ok") % 6 == 1), "file_name", F.col("text")), (2, 6, main & (F.col("ok") % 6 == 2), "new-", F.col("text")), (2, 7, main & (F.col("ok") % 9 == 2), "re-", noted), (2, 8, F.col("ok") % 50 == 7, "scan-", None),
    ]
    out = None
    for batch, when, which, name, text in kinds:
        named = F.col("file_name") if name == "file_name" else F.concat(F.lit(name), key, F.lit(".pdf"))
        body = F.lit(None).cast("string") if text is None else text
        mark = F.concat(F.lit("scan"), key) if text is None else body
        part = files.where(which).select(
            F.lit(batch).alias("batch"), F.concat(F.lit(f"/{batch}/"), named).alias("path"), named.alias("file_name"), F.timestamp_seconds(F.lit(when)).alias("mtime"), F.left(F.sha2(mark, 256), F.lit(16)).alias("file_hash"),
            F.lit(0).alias("view"), F.lit("pdf-text(stdlib)").alias("source"), body.alias("text"), F.lit(1).alias("pages"), F.lit(None).cast("string").alias("note"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def q_batch_runs(spark, sf):
    """Two batches booked one after the other: what each counted, and the ledger, issues and audit that are left."""
    files = written(delivered(spark, sf), "delivered")
    first = B.run_batch(spark, files.where("batch = 1").drop("batch"), cfg=AS_OF)
    second = B.run_batch(spark, files.where("batch = 2").drop("batch"), first.ledger, first.issues, AS_OF)
    out = None
    for k, b in ((1, first), (2, second)):
        rows = b.stats.select(F.lit(k).alias("batch"), "what", "n")
        rows = rows.unionByName(b.audit.agg(F.lit(k).alias("batch"), F.lit("audit").alias("what"), F.count(F.lit(1)).alias("n")))
        out = rows if out is None else out.unionByName(rows)
    last = second.ledger
    n = lambda what, value: last.agg(F.lit(2).alias("batch"), F.lit(what).alias("what"), value.alias("n"))
    out = out.unionByName(n("rows", F.count(F.lit(1)))).unionByName(n("last seq", F.max("seq"))).unionByName(n("seqs", F.countDistinct("seq"))).unionByName(n("total_c", F.sum((F.col("total") * 100).cast("long"))))
    by_status = last.groupBy("status").count().select(F.lit(2).alias("batch"), F.col("status").alias("what"), F.col("count").alias("n"))
    by_issue = second.issues.groupBy("level", "field").count().select(F.lit(2).alias("batch"), F.concat_ws("/", "level", "field").alias("what"), F.col("count").alias("n"))
    return out.unionByName(by_status).unionByName(by_issue)


def q_registry(spark, sf):
    return R.registry(spark).select("rule_id", "level", "active")


# --- PDF files made from orders ---------------------------------------------------


def pdf_bytes(text: str, kind: int) -> bytes:
    """A small PDF of one page that shows the lines of ``text``: 0 Flate, 1 ASCII85 over Flate, 2 raw deflate and plain codes, 3 an object stream, 4 UTF-16 codes."""
    codes = {c: i + 1 for i, c in enumerate(dict.fromkeys(text.replace("\n", "")))}
    if kind == 2:
        show = lambda s: b"(" + s.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    elif kind == 4:
        show = lambda s: b"<" + s.encode("utf-16-be").hex().encode() + b">"
    else:
        show = lambda s: b"<" + b"".join(b"%04x" % codes[c] for c in s) + b">"
    body = b"BT /F1 12 Tf " + b" T* ".join(show(x) + b" Tj" for x in text.split("\n")) + b" ET"
    cmap = b"begincmap %d beginbfchar " % len(codes) + b" ".join(b"<%04x> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for c, i in codes.items()) + b" endbfchar endcmap"

    def stream(data: bytes, how: int) -> bytes:
        if how == 1:
            import base64

            data, name = base64.a85encode(zlib.compress(data)) + b"~>", b"[/ASCII85Decode /FlateDecode]"
        elif how == 2:
            z = zlib.compressobj(9, zlib.DEFLATED, -15)
            data, name = z.compress(data) + z.flush(), b"/FlateDecode"
        else:
            data, name = zlib.compress(data), b"/FlateDecode"
        return b"<< /Length %d /Filter %s >>\nstream\n%s\nendstream" % (len(data), name, data)

    font = {2: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 4: b"<< /Type /Font /Subtype /Type0 /Encoding /UniGB-UTF16-H >>"}.get(kind, b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>")
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: stream(body, kind), 5: font, 6: stream(cmap, kind % 2)}
    if kind == 3:
        packed = {k: objects.pop(k) for k in (1, 2, 3, 5)}
        head, at = [], 0
        for k, v in packed.items():
            head.append(b"%d %d" % (k, at))
            at += len(v) + 1
        index = b" ".join(head) + b" "
        data = zlib.compress(index + b" ".join(packed.values()))
        objects[7] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), len(index), len(data), data)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in sorted(objects.items())) + b"%%EOF"


@F.pandas_udf(T.BinaryType())
def _pdf_of(text, kind):
    return text.combine(kind, lambda t, k: pdf_bytes(t, int(k)))


def q_pdf_text(spark, sf):
    """Orders as PDF files of five kinds, read back: text, pages, fingerprint and the copies among them."""
    o = t(spark, sf, "orders").withColumn("kind", (F.col("o_orderkey") % 5).cast("int"))
    plain = _line("Invoice (No) ", F.col("o_orderkey").cast("string"), "\nTotal ", F.col("o_totalprice").cast("string"), "\n\\end")
    text = F.when(F.col("kind") == 2, plain).otherwise(_line("电子发票(普通发票)\n发票号码:", F.lpad(F.col("o_orderkey").cast("string"), 20, "0"), "\n价税合计¥", F.col("o_totalprice").cast("string")))
    files = spread(o.select("kind", "o_orderkey", text.alias("true")), "o_orderkey").withColumn("content", _pdf_of("true", "kind"))
    files = files.select("kind", "true", F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_name"), F.timestamp_seconds(F.lit(0)).alias("mtime"), F.left(F.sha2("content", 256), F.lit(16)).alias("file_hash"), "content")
    files = written(files, "pdf-files")
    views = FS.read_views(files).select("path", "text", "pages", "source")
    return files.join(views, "path").groupBy("kind", "source", "pages").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("text") == F.col("true")).alias("n_equal"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k[2:]: f for k, f in globals().items() if k.startswith("q_")}
