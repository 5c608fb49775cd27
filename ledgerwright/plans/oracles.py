"""SQL for the workload's queries, written against the same tables.

The rules stand here once more, as SQL conditions over records that SQL makes by itself.
"""

from __future__ import annotations

from ..functions import scalars as S
from ..operators import rules as R
from ..operators import scoring as C
from .workload import CASES, LAYOUTS

_CENTS = """c AS (SELECT *, CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS amount_c FROM lineitem),
x AS (SELECT *, CAST(floor(amount_c * l_tax + 0.5) AS BIGINT) AS tax_c, CAST(floor(l_tax * 100 + 0.5) AS INTEGER) AS rate_pct FROM c),
i AS (SELECT *, amount_c + tax_c + CASE WHEN l_orderkey % 97 = 0 THEN 18000 ELSE 0 END AS total_c FROM x)"""

_CHAR = "substr('0123456789ABCDEFGHJKLMNPQRTUWXY', {0}, 1)"
_AT = " + ".join(f"(instr('0123456789ABCDEFGHJKLMNPQRTUWXY', substr(body, {i + 1}, 1)) - 1) * {w}" for i, w in enumerate(S.USCC_WEIGHTS))


_JOIN = "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
_BUYER, _SELLER = (_AT.replace("body", f"'91310000' || lpad({k}::VARCHAR, 9, '0')") for k in ("o_custkey", "l_suppkey"))
_SIGN = "substr('0123456789ABCDEFGHJKLMNPQRTUWXY', ((31 - ({}) % 31) % 31 + 1)::BIGINT, 1)"
_PROVINCE_LIST = ", ".join(f"'{x}'" for x in R.PROVINCES)
_RATE_LIST = ", ".join(f"'{x}'" for x in R.VALID_RATES)

#: The records of ``invoices``.
_RECORDS = f"""{_CENTS},
r0 AS (SELECT i.*, 'inv-' || l_orderkey || '.pdf' AS file_name, '数电发票(普通发票)' AS invoice_type,
  lpad((year(o_orderdate::DATE) % 100)::VARCHAR, 2, '0') || lpad((l_suppkey % 70 + 10)::VARCHAR, 2, '0') || '1' || lpad((l_orderkey * 10 + l_linenumber)::VARCHAR, 15, '0') AS invoice_no,
  NULL::VARCHAR AS invoice_code, strftime(o_orderdate::DATE, '%Y-%m-%d') AS issue_date, c_name AS buyer_name,
  '91310000' || lpad(o_custkey::VARCHAR, 9, '0') || {_SIGN.format(_BUYER)} AS buyer_tax, s_name AS seller_name,
  '91310000' || lpad(l_suppkey::VARCHAR, 9, '0') || CASE WHEN l_suppkey % 11 = 0 THEN 'Z' ELSE {_SIGN.format(_SELLER)} END AS seller_tax,
  (amount_c::DECIMAL(18,0) / 100)::DECIMAL(18,2) AS amount, (tax_c::DECIMAL(18,0) / 100)::DECIMAL(18,2) AS tax, (total_c::DECIMAL(18,0) / 100)::DECIMAL(18,2) AS total,
  rate_pct || '%' AS tax_rate, '*服务*咨询' AS item_name, '王芳' AS drawer, NULL::DECIMAL(18,2) AS cn_amount, l_suppkey % 11 = 0 AS wrong_digit
  FROM i {_JOIN})"""

#: The records of ``cases``: what each case changes.
_CHANGES = {
    "invoice_type": {5: "'电子发票(铁路电子客票)'", 9: "'增值税专用发票'", 10: "'增值税专用发票'"},
    "invoice_no": {1: "NULL", 7: "'2631A2' || ten || '0000'", 8: "left(invoice_no, 19)", 9: "right(ten, 8)", 10: "'1' || ten"},
    "invoice_code": {10: "'131002600111'", 11: "'031002600199'"},
    "issue_date": {2: "NULL", 12: "'2021-02-30'", 13: "'2031-05-05'"},
    "buyer_name": {6: "NULL"},
    "seller_name": {4: "''", 5: "''", 19: "buyer_name", 23: "buyer_name || '0'"},
    "buyer_tax": {16: "'abc-1'", 17: "'9131000000000000'"},
    "seller_tax": {21: "NULL"},
    "amount": {14: "-amount", 15: "0.00"},
    "tax": {14: "-tax", 15: "0.00", 22: "tax + 100.00"},
    "total": {3: "NULL", 14: "-total", 15: "0.00", 22: "total + 100.00"},
    "tax_rate": {20: "'6%/7%'", 25: "'免税'"},
    "cn_amount": {24: "total + 1.00"},
}
_MONEY = ("amount", "tax", "total", "cn_amount")


def _changed(col: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in _CHANGES[col].items())
    return f"(CASE k {whens} ELSE {col} END)" + ("::DECIMAL(18,2)" if col in _MONEY else "") + f" AS {col}"


_KEPT = ("l_suppkey", "l_linenumber", "file_name", "item_name", "drawer", "wrong_digit")
_CASE_RECORDS = f"""{_RECORDS},
k AS (SELECT *, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % {CASES} AS k, lpad(l_orderkey::VARCHAR, 10, '0') AS ten FROM r0),
r AS (SELECT k::INTEGER AS "case", {", ".join(_KEPT)}, {", ".join(map(_changed, _CHANGES))} FROM k)"""
_PLAIN_RECORDS = f"""{_RECORDS}, r AS (SELECT 0 AS "case", * FROM r0)"""

_RELAXED = "(coalesce(invoice_type, '') IN ('电子发票(铁路电子客票)', '电子发票(航空运输电子客票行程单)', '电子发票(通行费)'))"
_DIGITAL = "(contains(invoice_type, '数电') OR contains(invoice_type, '全电') OR starts_with(invoice_type, '电子发票('))"
_NO, _CODE, _DATE = "coalesce(invoice_no, '')", "coalesce(invoice_code, '')", "coalesce(issue_date, '')"
_FMT = "format('{{:,.2f}}', ({})::DOUBLE)"


def _tax_rules(col: str, label: str, wrong: str) -> list[tuple]:
    x = f"upper(trim(coalesce({col}, '')))"
    return [
        ("R07", "严重", label, f"{x} <> '' AND NOT regexp_full_match({x}, '[0-9A-Z]{{15,20}}')", f"'税号格式异常：' || {x}"),
        ("R07", "警告", label, f"regexp_full_match({x}, '[0-9A-Z]{{15,20}}') AND length({x}) NOT IN (15, 17, 18, 20)", f"'税号位数为 ' || length({x})"),
        ("R08", "警告", label, f"length({x}) = 18 AND {wrong}", f"'统一社会信用代码校验位不通过：' || {x}"),
    ]


_TAX = [_tax_rules("buyer_tax", "购买方税号", "false"), _tax_rules("seller_tax", "销售方税号", "wrong_digit")]
_JACCARD = "len(list_intersect(string_split(buyer_name, ''), string_split(seller_name, ''))) / len(list_distinct(list_concat(string_split(buyer_name, ''), string_split(seller_name, ''))))::DOUBLE"
#: Rule, level, field, condition and message of every check, in the order of rules.
RULES_SQL: list[tuple[str, str, str, str, str]] = [
    *(("R01", "严重", label, f"coalesce({c}::VARCHAR, '') = ''" + (f" AND NOT {_RELAXED}" if c == "seller_name" else ""), f"'未识别到「{label}」'") for c, label in (("invoice_no", "发票号码"), ("issue_date", "开票日期"), ("total", "价税合计"), ("seller_name", "销售方名称"), ("buyer_name", "购买方名称"))),
    ("R02", "严重", "发票号码", f"{_NO} <> '' AND NOT regexp_full_match({_NO}, '[0-9]+')", f"'发票号码含非数字：' || {_NO}"),
    ("R03", "警告", "发票号码", f"{_NO} <> '' AND CASE WHEN {_DIGITAL} OR length({_NO}) = 20 THEN length({_NO}) <> 20 ELSE length({_NO}) NOT IN (8, 9, 10, 12) END", f"'发票号码位数为 ' || length({_NO})"),
    ("R04", "严重", "开票日期", f"{_DATE} <> '' AND try_cast(issue_date AS DATE) IS NULL", f"'开票日期无效：' || {_DATE}"),
    ("R04", "严重", "开票日期", "try_cast(issue_date AS DATE) > DATE '2030-01-01'", f"'开票日期晚于当前日期：' || {_DATE}"),
    ("R04", "警告", "开票日期", "try_cast(issue_date AS DATE) < DATE '2000-01-01'", f"'开票日期过早：' || {_DATE}"),
    ("R05", "严重", "金额勾稽", "abs(amount + tax - total) > 0.02", f"'金额 + 税额 与价税合计相差 ' || {_FMT.format('amount + tax - total')}"),
    ("R06", "提示", "价税合计", "total < 0", "'价税合计为负数（红字发票）'"),
    ("R06", "警告", "价税合计", "total = 0", "'价税合计为 0'"),
    *_TAX[0][:2], *_TAX[1][:2], _TAX[0][2], _TAX[1][2],
    ("R09", "警告", "购销双方", "trim(coalesce(buyer_name, '')) <> '' AND trim(buyer_name) = trim(coalesce(seller_name, ''))", "'购买方与销售方名称相同'"),
    ("R10", "提示", "税率", f"len(list_filter(string_split(coalesce(tax_rate, ''), '/'), lambda x: x <> '' AND x NOT IN ({_RATE_LIST}))) > 0", f"'税率不常见：' || list_filter(string_split(coalesce(tax_rate, ''), '/'), lambda x: x <> '' AND x NOT IN ({_RATE_LIST}))[1]"),
    ("R11", "警告", "发票代码", f"NOT {_DIGITAL} AND {_CODE} = '' AND {_NO} <> ''", "'未识别到发票代码'"),
    ("R12", "警告", "销售方税号", f"NOT {_RELAXED} AND trim(coalesce(seller_tax, '')) = ''", "'销售方纳税人识别号缺失'"),
    ("R13", "严重", "税率×金额", "amount <> 0 AND len(list_filter(string_split(coalesce(tax_rate, ''), '/'), lambda x: suffix(x, '%'))) = 1 AND abs(100 * abs(tax) - abs(amount) * try_cast(rtrim(tax_rate, '%') AS DECIMAL(9,4))) > greatest(5, 2 * abs(amount))", f"'税率 ' || tax_rate || ' 与税额 ' || {_FMT.format('tax')} || ' 不符'"),
    ("R14", "警告", "发票号码", f"regexp_full_match({_NO}, '[0-9]{{20}}') AND substr({_NO}, 3, 2) NOT IN ({_PROVINCE_LIST})", f"'省级区域码不在编码表内：' || substr({_NO}, 3, 2)"),
    ("R14", "警告", "发票号码", f"regexp_full_match({_NO}, '[0-9]{{20}}') AND regexp_full_match(left({_DATE}, 4), '[0-9]{{4}}') AND left({_NO}, 2) <> substr({_DATE}, 3, 2)", f"'号码前两位与开票年份不一致：' || left({_NO}, 2)"),
    ("R15", "警告", "发票代码", f"regexp_full_match({_CODE}, '[0-9]{{12}}') AND left({_CODE}, 1) <> '0'", f"'12 位发票代码首位应为 0：' || left({_CODE}, 1)"),
    ("R15", "提示", "发票代码", f"regexp_full_match({_CODE}, '[0-9]{{12}}') AND right({_CODE}, 2) NOT IN ('11', '13')", f"'票种码不常见：' || right({_CODE}, 2)"),
    ("R16", "警告", "购销双方", f"buyer_name <> '' AND seller_name <> '' AND buyer_name <> seller_name AND coalesce(buyer_tax, '') <> '' AND coalesce(seller_tax, '') <> '' AND upper(trim(buyer_tax)) <> upper(trim(seller_tax)) AND {_JACCARD} >= 0.9", "'购销双方名称高度相似但税号不同'"),
    ("R17", "警告", "价税合计", "abs(cn_amount - total) > 0.02", f"'大写金额 ' || {_FMT.format('cn_amount')} || ' 与小写不一致'"),
]


def _flags(records: str, off: tuple[str, ...] = ()) -> tuple[str, list[tuple]]:
    """A CTE ``f`` with a boolean column for each check, and the checks with their columns."""
    found = [(f"f{n}", *r) for n, r in enumerate(RULES_SQL) if r[0] not in off]
    return f"{records}, f AS (SELECT *, {', '.join(f'coalesce({c}, false) AS {n}' for n, _, _, _, c, _ in found)} FROM r)", found


def _exploded(records: str, off: tuple[str, ...] = ()) -> str:
    """One row per issue: case, level, field."""
    with_flags, found = _flags(records, off)
    listed = ", ".join(f"CASE WHEN {n} THEN {{'level': '{level}', 'field': '{field}'}} END" for n, _, level, field, _, _ in found)
    return f"""WITH {with_flags}, u AS (SELECT "case", unnest(list_filter([{listed}], lambda x: x IS NOT NULL)) AS i FROM f)"""


def _summed(found: list[tuple], source: str, limit: int) -> str:
    """CTEs that add the issue summary ``issue`` to the records of ``source``, as ``s``."""
    texts: dict[int, list[str]] = {}
    for n, _, level, field, _, message in found:
        texts.setdefault(C.SEVERITY[level], []).append(f"CASE WHEN {n} THEN '[{level}] {field}: ' || ({message}) END")
    ordered = ", ".join(x for _, some in sorted(texts.items()) for x in some)
    tail = f"CASE WHEN len(t) > {limit} THEN ['另有 ' || (len(t) - {limit}) || ' 条，见异常记录'] ELSE [] END"
    return f"""a AS (SELECT *, list_filter([{ordered}], lambda x: x IS NOT NULL) AS t FROM {source}),
s AS (SELECT *, array_to_string(list_concat(t[1:{limit}], {tail}), '； ') AS issue FROM a)"""


def _issue_text(records: str, limit: int) -> str:
    with_flags, found = _flags(records)
    return f"WITH {with_flags}, {_summed(found, 'f', limit)}"


#: How sure each field is when present, in thousandths, and what raises it.
_SURE = {"invoice_no": 950, "invoice_code": 930, "issue_date": 950, "buyer_name": 850, "seller_name": 850, "buyer_tax": 880, "seller_tax": 880, "total": 920, "amount": 900, "tax": 900, "tax_rate": 850, "item_name": 900, "drawer": 850}


def _scored(records: str, off: tuple[str, ...] = ()) -> str:
    """A CTE ``j`` with permille and status of each record."""
    with_flags, found = _flags(records, off)
    uneven = " OR ".join(n for n, _, _, field, _, _ in found if field in ("金额勾稽", "税率×金额")) or "false"
    raised = dict.fromkeys(("amount", "tax", "total"), (f"NOT ({uneven}) AND amount IS NOT NULL AND tax IS NOT NULL AND total IS NOT NULL", 50))
    raised |= {"buyer_tax": ("length(trim(coalesce(buyer_tax, ''))) = 18", 70), "seller_tax": ("length(trim(coalesce(seller_tax, ''))) = 18 AND NOT wrong_digit", 70)}
    raised["invoice_no"] = (f"{_NO} <> '' AND {_DATE} <> ''", 30)
    cols = []
    for k, base in _SURE.items():
        if k == "issue_date":
            x = f"CASE WHEN {_DATE} = '' THEN 0 WHEN try_cast(issue_date AS DATE) IS NULL THEN 350 ELSE {base} END"
        else:
            x = f"CASE WHEN coalesce({k}::VARCHAR, '') <> '' THEN {base} ELSE 0 END"
        if k in raised:
            x = f"CASE WHEN {raised[k][0]} THEN least(990, {x} + {raised[k][1]}) ELSE {x} END"
        for n, _, level, field, _, _ in found:
            if level == "严重" and k in C.behind(field):
                x = f"CASE WHEN {n} THEN round(({x}) * 6 / 10.0)::INTEGER ELSE {x} END"
        cols.append(f"{x} AS c_{k}")
    weighed = " + ".join(f"c_{k} * {int(10 * C.WEIGHTS[k])}" for k in _SURE)
    severe = " OR ".join(n for n, _, level, _, _, _ in found if level == "严重")
    weak = " OR ".join(f"coalesce({k}::VARCHAR, '') = '' OR c_{k} < 500" for k in ("invoice_no", "issue_date", "total"))
    return f"""WITH {with_flags}, cf AS (SELECT *, {", ".join(cols)} FROM f),
p AS (SELECT *, round(({weighed} + 900 * 5) / 213.0)::INTEGER AS permille FROM cf),
j AS (SELECT *, CASE WHEN {severe} THEN '异常' WHEN permille < 750 OR {weak} THEN '待复核' WHEN {" OR ".join(n for n, *_ in found)} THEN '存在提示' ELSE '正常' END AS status FROM p)"""


_SUMS = "count(*) AS n_rows, sum(amount)::DECIMAL(28,2) AS amount_sum, sum(tax)::DECIMAL(28,2) AS tax_sum, sum(total)::DECIMAL(28,2) AS total_sum"

_SHARE = "(length(t) - length(regexp_replace(t, '{}', '', 'g'))) / length(t)::DOUBLE"
_FOUND = " + ".join(f"contains(t, '{x}')::INTEGER" for x in S.LABELS)
_QUALITY = f"""0.35::DOUBLE * least(length(t) / 200.0::DOUBLE, 1.0::DOUBLE) + 0.25::DOUBLE * (1 - {_SHARE.format(r"[\x00-\x08\x0B-\x1F\x7F]")})
 + 0.40::DOUBLE * least({_SHARE.format(r"[\x{4e00}-\x{9fff}0-9]")} / 0.35::DOUBLE, 1.0::DOUBLE) - least(1.5::DOUBLE * {_SHARE.format(r"[|~^`_{}\[\]<>\\]")}, 0.25::DOUBLE)
 - CASE WHEN regexp_matches(t, '[�□]') THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN {_FOUND} < 2 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END"""



def _cell(c: str) -> str:
    x = f"({c})::VARCHAR"
    quoted = f"""'"' || replace({x}, '"', '""') || '"'"""
    return f"""CASE WHEN regexp_full_match({x}, '[0-9]{{8,}}') THEN '="' || {x} || '"' WHEN regexp_matches({x}, '[",\\r\\n]') THEN {quoted} ELSE coalesce({x}, '') END"""


_CSV = ("file_name", "invoice_type", "invoice_code", "invoice_no", "issue_date", "buyer_name", "buyer_tax", "seller_name", "seller_tax", "amount", "tax", "total", "tax_rate", "item_name", "NULL", "drawer", "conf", "status", "issue")
_LINE = " || ',' || ".join(map(_cell, _CSV))
_THIN = _RECORDS.replace("r0 AS (", "r9 AS (") + """,
r0 AS (SELECT * REPLACE (CASE WHEN l_linenumber >= 4 THEN NULL ELSE amount END AS amount, CASE WHEN l_linenumber >= 4 THEN NULL ELSE tax END AS tax, CASE WHEN l_linenumber >= 4 THEN NULL ELSE seller_tax END AS seller_tax,
 CASE WHEN l_linenumber >= 4 THEN NULL ELSE buyer_tax END AS buyer_tax, CASE WHEN l_linenumber >= 4 THEN NULL ELSE tax_rate END AS tax_rate, CASE WHEN l_linenumber >= 4 THEN NULL ELSE item_name END AS item_name) FROM r9),
r AS (SELECT 0 AS "case", * FROM r0)"""
_REGIONS = "[" + ", ".join(f"'{k}'" for k in S.REGIONS) + "]", "[" + ", ".join(f"'{v}'" for v in S.REGIONS.values()) + "]"
_WORDS = "['壹仟零陆拾圆整', '叁佰壹拾捌元伍角', '一亿二千万元', '拾元零叁分', '整', '玖万捌仟柒佰陆拾伍元肆角叁分']"
#: A digit 0 before a unit counts once, as the unit alone does.
_CAPITAL = " + ".join(f"{w} * CASE WHEN (o_orderkey // {w}) % 10 = 0 THEN {0 if w == 1 else 1} ELSE (o_orderkey // {w}) % 10 END" for w in (1, 10, 100, 1000))

_LAYOUT_SURE = {0: (850, 0), 1: (600, 0), 2: (550, 0), 3: (900, 0), 4: (900, 0), 5: (0, 800), 6: (0, 800), 7: (900, 700), 8: (0, 900), 9: (900, 900)}
#: The invoices that are left of each order's file: the first of each number in the order of the rendered texts.
_NUMBERS = f"""WITH {_PLAIN_RECORDS}, n AS (SELECT l_orderkey AS ok, invoice_no AS no, l_orderkey % 97 = 0 AS gap, issue_date < '2000-01-01' AS early, wrong_digit AS digit, substr(invoice_no, 3, 2) NOT IN ({_PROVINCE_LIST}) AS place,
 rate_pct IN (2, 4, 7, 8) AS rate, total_c, row_number() OVER (PARTITION BY l_orderkey, invoice_no ORDER BY l_linenumber, seller_name, tax_rate, amount::VARCHAR, tax::VARCHAR) AS nth FROM r),
one AS (SELECT * FROM n WHERE nth = 1), d AS (SELECT ok, count(*) AS nos FROM one GROUP BY ok)"""
_MAIN, _AGAIN = "ok % 4 <> 0", "ok % 4 <> 0 AND ok % 9 = 2"


def _n(batch: int, what: str, table: str, where: str, value: str = "count(*)") -> str:
    return f"SELECT {batch} AS batch, '{what}' AS what, coalesce({value}, 0)::BIGINT AS n FROM {table} WHERE {where}"


_STATUS = "CASE WHEN gap THEN '异常' WHEN early OR digit OR place OR rate THEN '存在提示' ELSE '正常' END"
_SCANS = "(SELECT count(*) FROM d WHERE ok % 50 = 7)"
_BATCHES = [
    _n(1, "skipped", "d", "false"), _n(1, "duplicate", "d", _MAIN, f"count(*) FILTER (ok % 5 = 1) + coalesce(sum(nos) FILTER ({_AGAIN}), 0)"), _n(1, "new_files", "d", _MAIN, f"count(*) + count(*) FILTER ({_AGAIN})"),
    _n(1, "ocr_todo", "d", "ok % 50 = 7"), _n(1, "new_invoices", "d", _MAIN, "sum(nos)"), _n(1, "audit", "d", _MAIN, f"sum(nos) + {_SCANS}"),
    _n(2, "skipped", "d", "true", f"count(*) FILTER ({_MAIN} AND ok % 6 = 1) + {_SCANS}"), _n(2, "duplicate", "d", _MAIN, f"count(*) FILTER (ok % 6 = 2) + coalesce(sum(nos) FILTER ({_AGAIN}), 0)"), _n(2, "new_files", "d", "true", f"count(*) FILTER (ok % 4 = 0) + count(*) FILTER ({_AGAIN})"),
    _n(2, "ocr_todo", "d", "false"), _n(2, "new_invoices", "d", "ok % 4 = 0", "sum(nos)"), _n(2, "audit", "d", "ok % 4 = 0", "sum(nos)"),
    *(_n(2, what, "d", "true", f"sum(nos) + {_SCANS}") for what in ("rows", "last seq", "seqs")), _n(2, "total_c", "one", "true", "sum(total_c)"),
    f"SELECT 2, {_STATUS}, count(*) FROM one GROUP BY 2", _n(2, "待人工录入", "d", "ok % 50 = 7"),
    *(_n(2, f"{level}/{field}", "one", flag, f"count(*) + count(*) FILTER ({_AGAIN})") for flag, level, field in (("gap", "严重", "金额勾稽"), ("early", "警告", "开票日期"), ("digit", "警告", "销售方税号"), ("place", "警告", "发票号码"), ("rate", "提示", "税率"))),
    _n(2, "重复/发票唯一性", "d", _AGAIN, "sum(nos)"), _n(2, "重复/文件指纹", "d", _MAIN, "count(*) FILTER (ok % 5 = 1) + count(*) FILTER (ok % 6 = 2)"), _n(2, "严重/文本提取", "d", "ok % 50 = 7"),
]
_SHOWN = "'inv-' || ok || '.pdf'"

ORACLES: dict[str, str] = {
    "rule_cases": _exploded(_CASE_RECORDS) + """ SELECT "case", i.level AS level, i.field AS field, count(*) AS n_issues FROM u GROUP BY ALL""",
    "case_status": _scored(_CASE_RECORDS) + """ SELECT "case", status, permille, count(*) AS n_rows FROM j GROUP BY ALL""",
    "case_summary": _issue_text(_CASE_RECORDS, 2) + """ SELECT "case", sha256(issue) AS issue_sha256, count(*) AS n_rows FROM s GROUP BY ALL""",
    "rules_off": _scored(_CASE_RECORDS, ("R05", "R10", "R14")) + """ SELECT "case", status, count(*) AS n_rows FROM j GROUP BY ALL""",
    "issue_counts": _exploded(_PLAIN_RECORDS) + " SELECT i.level AS level, i.field AS field, count(*) AS n_issues FROM u GROUP BY ALL",
    "issue_summary": _issue_text(_PLAIN_RECORDS, 6) + " SELECT issue, count(*) AS n_rows FROM s GROUP BY ALL",
    "confidence": _scored(_PLAIN_RECORDS) + " SELECT status, permille, count(*) AS n_rows FROM j GROUP BY ALL",
    "status_histogram": _scored(_PLAIN_RECORDS) + " SELECT status, count(*) AS n_rows FROM j GROUP BY ALL",
    "review_list": _scored(_THIN) + " SELECT status, l_linenumber, count(*) AS n_rows FROM j WHERE status IN ('待复核', '待人工录入') GROUP BY ALL",
    "ledger_totals": f"WITH {_CASE_RECORDS} SELECT {_SUMS} FROM r WHERE l_suppkey % 10 <> 0",
    "invoice_balance": f"WITH {_CENTS} SELECT l_suppkey, count(*) AS n_rows, sum(amount_c + tax_c - total_c)::BIGINT AS gap_c FROM i {_JOIN} WHERE abs(amount_c + tax_c - total_c) > 2 GROUP BY 1",
    "rate_check": f"WITH {_CENTS} SELECT greatest(rate_pct - 3, 0) || '%' AS tax_rate, count(*) FILTER (abs(100 * tax_c - amount_c * greatest(rate_pct - 3, 0)) > greatest(500, 2 * amount_c)) AS n_bad, count(*) AS n_rows FROM i {_JOIN} GROUP BY 1",
    "detail_csv": _scored(_PLAIN_RECORDS) + ", " + _summed(_flags(_PLAIN_RECORDS)[1], "(SELECT *, format('{:.1f}', permille / 10.0) || '%' AS conf FROM j)", 6) + f" SELECT {_LINE} AS value, count(*) AS n_rows FROM s GROUP BY 1",
    "view_choice": f"""WITH x AS (SELECT conv_id, turn, coalesce(role, '') = 'assistant' AS o, coalesce(text, '') AS raw, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t FROM conversations),
 s AS (SELECT *, length(t) AS n, round(CASE WHEN t = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_QUALITY})) END, 3) AS q FROM x),
 k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, o ORDER BY q DESC, turn, raw DESC) AS r FROM s),
 c AS (SELECT conv_id, l.n >= 20 AS thick, l.raw AS lr, l.q AS lq, a.raw AS ar, a.q AS aq FROM (SELECT * FROM k WHERE r = 1 AND NOT o) l FULL JOIN (SELECT * FROM k WHERE r = 1 AND o) a USING (conv_id)),
 d AS (SELECT *, CASE WHEN thick AND lq >= 0.55 THEN 'accepted' WHEN ar IS NOT NULL AND (NOT coalesce(thick, false) OR aq > lq) THEN 'ocr' WHEN thick THEN 'kept' ELSE 'manual' END AS choice FROM c)
 SELECT conv_id, choice, CASE choice WHEN 'ocr' THEN sha256(ar) WHEN 'manual' THEN NULL ELSE sha256(lr) END AS text_sha256, (1000 * CASE choice WHEN 'ocr' THEN aq WHEN 'manual' THEN NULL ELSE lq END)::INTEGER AS permille FROM d""",
    "text_quality": f"WITH x AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t FROM documents) SELECT doc_id, round(1000 * CASE WHEN t = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_QUALITY})) END)::INTEGER AS permille FROM x",
    "seller_summary": f"WITH {_CENTS} SELECT s_name AS seller_name, count(*) AS n_rows, CAST(sum(amount_c)::DECIMAL(28,0) / 100 AS DECIMAL(28,2)) AS amount_sum, CAST(sum(tax_c)::DECIMAL(28,0) / 100 AS DECIMAL(28,2)) AS tax_sum, CAST(sum(total_c)::DECIMAL(28,0) / 100 AS DECIMAL(28,2)) AS total_sum FROM i JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "top_sellers": f"WITH {_CENTS} SELECT s_name AS seller_name, count(*) AS n_rows, CAST(sum(amount_c)::DECIMAL(28,0) / 100 AS DECIMAL(28,2)) AS amount_sum, CAST(sum(tax_c)::DECIMAL(28,0) / 100 AS DECIMAL(28,2)) AS tax_sum, CAST(sum(total_c)::DECIMAL(28,0) / 100 AS DECIMAL(28,2)) AS total_sum FROM i JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY 5 DESC, 1 LIMIT 20",
    "numbering": "WITH k AS (SELECT o_orderkey, lpad((o_custkey % 90 + 10)::VARCHAR, 2, '0') AS r, lpad((year(o_orderdate::DATE) % 100)::VARCHAR, 2, '0') AS y FROM orders) SELECT o_orderkey, '0' || r || '00' || y || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '11' ELSE '13' END AS code, y || r || '1' || lpad(o_orderkey::VARCHAR, 15, '0') AS number, r NOT IN (" + ", ".join(f"'{p}'" for p in R.PROVINCES) + ") AS bad_province FROM k",
    "invoice_dedupe": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS n FROM lineitem) SELECT l_returnflag, count(*) AS n_first, sum(l_partkey)::BIGINT AS parts FROM r WHERE n = 1 GROUP BY 1",
    "rate_extract": f"WITH {_CENTS} SELECT CASE WHEN rate_pct = 13 THEN '13%' ELSE rate_pct::VARCHAR || '%/13%' END AS rates, count(*) AS n_rows FROM i GROUP BY 1",
    "ledger_merge": "WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE < DATE '1996-01-01' AS early FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, early ORDER BY d, o_orderkey) AS n, bool_or(early) OVER (PARTITION BY o_custkey) AS seen FROM o), p AS (SELECT CASE WHEN early AND n = 1 THEN 'first' WHEN NOT early AND n = 1 AND NOT seen THEN 'fresh' WHEN NOT early THEN 'again' END AS part, o_orderkey FROM r) SELECT x.part, count(p.part) AS n_rows, sum(o_orderkey)::BIGINT AS keys FROM (VALUES ('first'), ('fresh'), ('again')) x(part) LEFT JOIN p ON x.part = p.part GROUP BY 1",
    "watch_settle": "WITH o AS (SELECT DISTINCT event_id % 20 AS poll, user_id, floor((event_id % 20) / 5) AS size FROM events), s AS (SELECT *, coalesce(lag(poll) OVER w = poll - 1 AND lag(size) OVER w = size, false) AS same FROM o WINDOW w AS (PARTITION BY user_id ORDER BY poll)), b AS (SELECT *, coalesce(lag(same) OVER (PARTITION BY user_id ORDER BY poll), false) AS before FROM s) SELECT poll, count(*) AS n_ready FROM b WHERE same AND NOT before GROUP BY 1",
    "jaccard": "WITH x AS (SELECT c_custkey, list_distinct(string_split(c_name, '')) AS a, list_distinct(string_split(c_mktsegment, '')) AS b FROM customer) SELECT c_custkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 1000)::INTEGER AS permille FROM x",
    "field_extract": "WITH n AS (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) SELECT field, n AS n_rows, n AS n_equal FROM n, (VALUES ('invoice_no'), ('issue_date'), ('buyer_name'), ('buyer_tax'), ('seller_name'), ('seller_tax'), ('amount'), ('tax'), ('total'), ('tax_rate'), ('drawer')) f(field)",

    "uscc_check": f"WITH k AS (SELECT c_custkey, '91310000' || lpad(c_custkey::VARCHAR, 9, '0') AS body FROM customer), n AS (SELECT *, {_AT} AS n FROM k), d AS (SELECT *, {_CHAR.format('((31 - n % 31) % 31 + 1)::BIGINT')} AS c FROM n) SELECT c_custkey, body || c AS code, true AS ok, c = '0' AS ok_zero, false AS ok_letter FROM d",
    "region_codes": f"WITH k AS (SELECT o_orderkey, {_REGIONS[0]}[(o_orderkey % {len(S.REGIONS)} + 1)::INTEGER] AS region, '0' || {_REGIONS[1]}[(o_orderkey % {len(S.REGIONS)} + 1)::INTEGER] || lpad((year(o_orderdate::DATE) % 100)::VARCHAR, 2, '0') || lpad((o_orderkey % 999 + 1)::VARCHAR, 3, '0') || '13' AS code FROM orders) SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'length' WHEN 1 THEN 'start' WHEN 2 THEN 'kind' END AS fault FROM k",
    "file_dedupe": "WITH h AS (SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS file_hash FROM documents) SELECT doc_id, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY doc_id % 13, doc_id) = 1 AS is_first, file_hash IN (SELECT file_hash FROM h WHERE doc_id % 17 = 0) AS known FROM h",
    "layouts": f"""WITH {_CENTS}, l AS (SELECT ((l_orderkey + l_linenumber + l_partkey) % {LAYOUTS})::INTEGER AS layout, count(*) AS n FROM i {_JOIN} GROUP BY 1),
 s(layout, sure_amount, sure_item) AS (VALUES {", ".join(f"({k}, {a}, {b})" for k, (a, b) in _LAYOUT_SURE.items())})
 SELECT layout, sure_amount, sure_item, field, n AS n_rows, n AS n_equal FROM l JOIN s USING (layout), (VALUES ('invoice_type'), ('amount'), ('tax'), ('total'), ('item_name'), ('issue_date'), ('bad_date'), ('cn_amount'), ('buyer_name'), ('seller_name'), ('buyer_tax'), ('seller_tax')) f(field)""",
    "type_detect": """WITH x AS (SELECT list_extract(['电子发票(铁路电子客票)', '电子发票 增值税专用发票', '电子发票 普通发票', '增值税专用发票', '全电', '二手车销售统一发票', '收据', '发票', '航空运输电子客票行程单', '收费公路通行费', '增值税电子专用发票', '增值税电子普通发票', '机动车销售统一发票', '增值税普通发票', '数电发票备注'], (o_orderkey % 15 + 1)::INTEGER) AS t FROM orders UNION ALL SELECT coalesce(text, '') FROM documents)
 SELECT CASE WHEN contains(t, '铁路电子客票') THEN '电子发票(铁路电子客票)' WHEN contains(t, '航空运输电子客票行程单') THEN '电子发票(航空运输电子客票行程单)' WHEN contains(t, '通行费电子发票') OR contains(t, '电子发票(通行费)') OR contains(t, '收费公路通行费') THEN '电子发票(通行费)'
 WHEN contains(t, '电子发票') AND contains(t, '专用发票') THEN '数电发票(增值税专用发票)' WHEN contains(t, '电子发票') AND contains(t, '普通发票') THEN '数电发票(普通发票)' WHEN contains(t, '数电') OR contains(t, '全电') THEN '数电发票' WHEN contains(t, '增值税电子专用发票') THEN '电子专用发票' WHEN contains(t, '增值税电子普通发票') THEN '电子普通发票'
 WHEN contains(t, '机动车销售统一发票') THEN '机动车销售统一发票' WHEN contains(t, '二手车销售统一发票') THEN '二手车销售统一发票' WHEN contains(t, '增值税专用发票') THEN '增值税专用发票' WHEN contains(t, '增值税普通发票') THEN '增值税普通发票' WHEN contains(t, '发票') THEN '电子发票(其他)' ELSE '未知类型' END AS invoice_type, count(*) AS n_rows FROM x GROUP BY 1""",
    "normalise": "SELECT o_orderkey AS key, 'No.' || o_orderkey || ' (A)¥5VIII(株)' || chr(10) AS text FROM orders",
    "csv_cells": """SELECT o_orderkey, '="' || lpad(o_orderkey::VARCHAR, 9, '0') || '"' AS cell, lpad(o_orderkey::VARCHAR, 9, '0') AS back, '"' || o_orderpriority || ',' || '""' || '"' AS escaped, '&lt;a&amp;' || o_orderkey || '&quot;&gt;' AS html, format('{:,.2f}', (o_orderkey * 1000)::DOUBLE) AS money,
 format('{:.1f}', (o_orderkey % 1000) / 10.0) || '%' AS percent, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderkey::VARCHAR END AS plain, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR ELSE o_orderkey || ' [第' || (o_orderkey % 3 + 1) || '张/共' || (o_orderkey % 3 + 1) || '张]' END AS shown,
 CASE WHEN o_orderkey * 64 < 1024 THEN (o_orderkey * 64) || ' B' WHEN o_orderkey * 64 < 1048576 THEN format('{:,.1f}', round_even(o_orderkey * 64 / 1024.0, 1)) || ' KB' ELSE format('{:,.1f}', round_even(o_orderkey * 64 / 1048576.0, 1)) || ' MB' END AS size FROM orders""",
    "distinct_files": f"SELECT count(DISTINCT l_orderkey) AS n_files FROM lineitem {_JOIN}",
    "watch_rounds": """WITH RECURSIVE o AS (SELECT DISTINCT event_id % 20 AS poll, user_id, floor((event_id % 20) / 5) AS size FROM events WHERE event_id % 20 < 6),
 q AS (SELECT *, poll = 0 OR coalesce(lag(poll) OVER w = poll - 1 AND lag(size) OVER w = size, false) AS quiet FROM o WINDOW w AS (PARTITION BY user_id ORDER BY poll)),
 b AS (SELECT *, coalesce(lag(poll) OVER w = poll - 1 AND lag(quiet) OVER w, false) AS before FROM q WINDOW w AS (PARTITION BY user_id ORDER BY poll))
 SELECT k.poll, count(b.poll) AS n_files, count(*) FILTER (quiet AND NOT before) AS n_ready FROM range(6) k(poll) LEFT JOIN b USING (poll) GROUP BY 1""",
    "cn_amount": f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ({_CAPITAL} + 10000 * ((o_orderkey // 10000) % 10))::DECIMAL(18,2) ELSE list_extract([1060.00, 318.50, 120000000.00, 10.03, NULL, 98765.43], (o_orderkey % 6 + 1)::INTEGER)::DECIMAL(18,2) END AS amount FROM orders",
    "segments": f"{_NUMBERS}, cn AS (SELECT ok, count(*) AS n FROM n GROUP BY ok) SELECT {_SHOWN} AS file_name, n, n::INTEGER AS segments, nos AS n_kept, {_SHOWN} || CASE WHEN nos > 1 THEN ' [第' || nos || '张/共' || nos || '张]' ELSE '' END AS last_name FROM cn JOIN d USING (ok)",
    "batch_runs": f"{_NUMBERS} SELECT * FROM (" + " UNION ALL ".join(_BATCHES) + ") WHERE n > 0 OR what IN ('skipped', 'duplicate', 'new_files', 'ocr_todo', 'new_invoices', 'audit')",
    "segment_forms": "WITH s(k, segments) AS (VALUES (0, 2), (1, 3), (2, 1), (3, 1)) SELECT k, segments, count(*) * max(segments) AS n_rows, count(*) AS n_files FROM s JOIN orders ON o_orderkey % 4 = k GROUP BY ALL",
    "distinct_views": "WITH f AS (SELECT conv_id, left(coalesce(text, ''), 1) AS t, min(turn) AS turn FROM conversations GROUP BY 1, 2) SELECT conv_id AS file_name, count(*) AS n_views, min(turn) AS first_view, max(turn) AS last_view FROM f GROUP BY 1",
    "best_view": "WITH v AS (SELECT l_orderkey, l_linenumber, round(avg(l_quantity / 50), 4) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS views FROM v) SELECT l_orderkey AS file_name, l_linenumber AS view, views::INTEGER AS views, n AS n_rows FROM r WHERE k = 1",
    "extractor_mix": "SELECT event_type AS extractor, count(*) AS n_rows FROM events GROUP BY 1",
    "numbered": "SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate::DATE, o_orderkey) AS seq FROM orders",
    "issue_upkeep": """WITH o AS (SELECT o_orderkey % 5 AS b, 'f' || (o_custkey % 500) AS file_name, '警告' AS level, CASE WHEN o_orderkey % 3 = 0 THEN '文本提取' ELSE '税率' END AS field, o_orderpriority AS message FROM orders WHERE o_orderkey % 5 < 4),
 d AS (SELECT DISTINCT file_name, level, field, message FROM o), p AS (SELECT DISTINCT file_name FROM d WHERE substr(file_name, 2)::INTEGER % 4 = 0)
 SELECT file_name, '' AS invoice_no, level, field, message, 1::BIGINT AS n_rows FROM d WHERE NOT (field = '文本提取' AND file_name IN (SELECT file_name FROM p))""",
    "removed_rows": "SELECT count(*) AS n_rows, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_custkey % 100 NOT IN (SELECT o_custkey % 100 FROM orders WHERE o_orderkey % 90 = 0)",
    "templates": """WITH t AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN '乙' ELSE '甲' END AS template FROM orders)
 SELECT o_orderkey, template, CASE template WHEN '甲' THEN o_orderkey::VARCHAR WHEN '乙' THEN '单号' || o_orderkey END AS invoice_no, CASE WHEN template = '甲' THEN (o_orderkey * 10)::DECIMAL(18,2) END AS total, CASE WHEN template = '甲' THEN '1996-03-07' END AS issue_date,
 CASE WHEN template = '甲' THEN left(o_orderpriority, 1) END AS item_name, CASE template WHEN '甲' THEN '甲公司' WHEN '乙' THEN '乙集团' END AS seller_name, 930 AS sure, template = '甲' AS broken FROM t""",
    "registry": "SELECT * FROM (VALUES " + ", ".join(f"('R{k:02}', '{v}', true)" for k, v in enumerate("严重 严重 警告 严重 严重 提示 严重 警告 警告 提示 警告 警告 严重 警告 警告 警告 警告".split(), 1)) + ") x(rule_id, level, active)",
    "pdf_text": "SELECT (o_orderkey % 5)::INTEGER AS kind, 'pdf-text(stdlib)' AS source, 1 AS pages, count(*) AS n_files, count(*) AS n_equal FROM orders GROUP BY 1",
}
