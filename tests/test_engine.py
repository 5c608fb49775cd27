"""The invoice engine on small fixtures."""

import json
import zlib

import __spark_entry__
import pytest
from ledgerwright.config import Config, load_config
from ledgerwright.functions import fields as P
from ledgerwright.functions import scalars as S
from ledgerwright.operators import ledger as L
from ledgerwright.operators import rules as R
from ledgerwright.operators import scoring as C
from ledgerwright.operators import segments as G
from ledgerwright.operators import templates as M
from ledgerwright.operators import views as V
from ledgerwright.plans import sinks as K
from ledgerwright.sources import files as FS
from ledgerwright.sources.pdf import extract_text
from ledgerwright.streaming import watch as W
from pyspark.sql import functions as F

GOOD = """电子发票（普通发票）
发票号码：26312000000012345678
开票日期：2026年07月01日
购买方信息名称：上海甲乙科技有限公司
统一社会信用代码/纳税人识别号：91310000MA1K3XXX0X
销售方信息名称：北京丙丁咨询有限公司
统一社会信用代码/纳税人识别号：91110108MA01ABCD12
*咨询服务*技术咨询费 6%
合计¥10000.00¥600.00
价税合计（大写）壹万零陆佰圆整（小写）¥10600.00
开票人：王芳"""


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("words", "number"), [("壹仟零陆拾圆整", 1060), ("叁佰壹拾捌元伍角", 318.5), ("一亿二千万元", 120000000), ("拾元零叁分", 10.03), ("整", None), (None, None)])
def test_cn_amount(spark, words, number):
    got = one(spark, S.cn_amount(F.col("w")), w=words)
    assert got is None if number is None else float(got) == number


def test_uscc(spark):
    body = "91310000MA1K3ABCD"
    code = one(spark, S.uscc_complete(F.col("c")), c=body)
    assert len(code) == 18 and one(spark, S.uscc_check(F.col("c")), c=code) is True
    assert one(spark, S.uscc_check(F.col("c")), c=body + ("0" if code[-1] != "0" else "1")) is False
    assert one(spark, S.uscc_check(F.col("c")), c="12") is None


def parsed(spark, text, cfg=Config(as_of="2026-12-31"), templates=None):
    frame = P.parse_fields(S.normalised(spark.createDataFrame([(text,)], "text string")))
    return C.judged(frame if templates is None else M.apply_templates(frame, templates), cfg)


def test_ordinary_invoice(spark):
    r = parsed(spark, GOOD).first()
    assert (r.invoice_no, r.issue_date, float(r.amount), float(r.tax), float(r.total)) == ("26312000000012345678", "2026-07-01", 10000, 600, 10600)
    assert (r.buyer_name, r.seller_name, r.tax_rate, r.drawer) == ("上海甲乙科技有限公司", "北京丙丁咨询有限公司", "6%", "王芳")
    assert r.invoice_type == "数电发票(普通发票)" and float(r.cn_amount) == 10600
    assert r.status in ("正常", "存在提示") and r.confidence > 0.75


def test_unbalanced_invoice_is_severe(spark):
    r = parsed(spark, GOOD.replace("（小写）¥10600.00", "（小写）¥11200.00")).first()
    assert {"金额勾稽", "价税合计"} <= {i.field for i in r.issues} and r.status == "异常"
    assert r.confidence < parsed(spark, GOOD).first().confidence


def test_rail_ticket_needs_no_seller(spark):
    r = parsed(spark, "电子发票（铁路电子客票）\n发票号码：26319110000000000012\n开票日期：2026年03月01日\n上海虹桥站 G123 南京南站\n车次：G123\n票价：￥106.00").first()
    assert r.invoice_type == P.RAIL and float(r.total) == 106 and "销售方名称" not in {i.field for i in r.issues}


def test_null_text_and_empty_table(spark):
    r = C.judged(P.parse_fields(spark.createDataFrame([(None,)], "text string"))).first()
    assert r.invoice_type == "未知类型" and r.invoice_no is None and len(r.issues) >= 4
    assert R.validate(P.parse_fields(spark.createDataFrame([], "text string"))).count() == 0


def test_rules_can_be_switched_off(spark):
    assert len(R.RULES) == 17
    frame = P.parse_fields(spark.createDataFrame([(None,)], "text string"))
    assert R.validate(frame, Config(rules_disabled=frozenset(R.RULES))).first().issues == []


def test_text_quality_order(spark):
    score = lambda t: one(spark, S.text_quality(F.col("t")), t=t)
    assert score(GOOD) > 0.55 > score("|~^`_{}[]<>" * 20) and score("") == score(None) == 0.0


def test_first_wins_and_merge(spark):
    rows = spark.createDataFrame([("1", "", 1), ("1", "", 2), (None, "", 3), (None, "", 4), ("2", "9", 5)], "invoice_no string, invoice_code string, k int")
    fresh, again = L.split_duplicates(rows, ["k"])
    assert sorted(r.k for r in fresh.collect()) == [1, 3, 4, 5] and [r.k for r in again.collect()] == [2]
    later, dup = L.split_duplicates(rows, ["k"], ledger=fresh)
    assert sorted(r.k for r in later.collect()) == [3, 4] and sorted(r.k for r in dup.collect()) == [1, 2, 5]


def test_seq_is_gapless(spark):
    rows = L.with_seq(spark.range(1000).repartition(7), ["id"], start=5).orderBy("id").collect()
    assert [r.seq for r in rows] == list(range(6, 1006))


def test_issues_are_added_once_and_purged(spark):
    cols = "file_name string, invoice_no string, level string, field string, message string"
    old = spark.createDataFrame([("a", "—", "警告", "流程", "m")], cols)
    new = spark.createDataFrame([("a", "", "警告", "流程", "m"), ("b", "1", "严重", "税率", "n"), ("b", "1", "严重", "税率", "n")], cols)
    both = L.add_issues(old, new)
    assert both.count() == 2
    assert [r.file_name for r in L.purge_issues(both, spark.createDataFrame([("a",)], "file_name string")).collect()] == ["b"]


def test_segments_split_and_merge(spark):
    two = GOOD + "\n" + GOOD.replace("12345678", "87654321")
    assert len(G.split_text(two)) == 2 and G.split_text(GOOD) == [GOOD] and G.split_text(None) == [""]
    assert "\n".join(G.split_text(two)) == "\n".join(G.text_lines(two))
    body = "{}\n开票日期:2026-01-01\n税额1\n"
    for label in ("票据号码:12345678", "发票No 12345678", "[(发票号码:12345678", "电子发票(普通发票)\n发票号码:12345678"):
        assert len(G.split_text(body.format(label) + body.format(label.replace("1234", "4321")))) == 2, label
    no_date = "发票号码:12345678\n税额1\n发票号码:87654321\n税额2"
    assert G.split_text(no_date) == [no_date]
    mention = body.format("电子发票\n发票号码:12345678") + "备注:原发票号码 87654321 已作废"
    assert G.split_text(mention) == [mention]
    frame = spark.createDataFrame([("a", two), ("b", GOOD), ("c", None)], "file_name string, text string")
    assert sorted((r.file_name, r.segment, r.segments) for r in G.split_segments(frame).collect()) == [("a", 1, 2), ("a", 2, 2), ("b", 1, 1), ("c", 1, 1)]


def test_summary_limits(spark):
    issues = [{"level": "提示" if k else "严重", "field": "f", "message": str(k), "suggest": ""} for k in range(8)]
    frame = spark.createDataFrame([(issues,)], "issues array<struct<level:string,field:string,message:string,suggest:string>>")
    text = frame.select(C.summary().alias("s")).first().s
    assert text.startswith("[严重] f: 0； ") and text.endswith("另有 2 条，见异常记录")


def test_csv_cells(spark):
    assert one(spark, S.csv_text_cell(F.col("c")), c="12345678") == '="12345678"'
    assert one(spark, S.parse_csv_cell(F.col("c")), c='="12345678"') == "12345678"
    assert one(spark, S.csv_escape(F.col("c")), c='a,"b') == '"a,""b"'
    assert "&lt;" in one(spark, S.html_escape(F.col("c")), c="<")


def test_pdf_text():
    body = zlib.compress(b"BT /F1 12 Tf (Hello \\(x\\)) Tj T* [(Wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode /Length " + str(len(body)).encode() + b">>\nstream\n" + body + b"\nendstream endobj\n%%EOF"
    assert extract_text(pdf) == "Hello (x)\nWorld"
    assert extract_text(b"junk") is None and extract_text(None) is None


def test_sources_config_templates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "~$b.pdf", "c.txt", "d.PNG"):
        (tmp_path / "in" / name).write_bytes(b"x")
    got = FS.read_files(spark, str(tmp_path / "in")).select("file_name", "file_hash").collect()
    assert sorted(r.file_name for r in got) == ["a.pdf", "d.PNG"] and len({r.file_hash for r in got}) == 1
    (tmp_path / "c.json").write_text(json.dumps({"balance_tolerance": 0.5, "rules_disabled": ["R01"], "ocr_timeout": 1}))
    cfg = load_config(str(tmp_path / "c.json"), {"INVOICE_FUTURE_DATE_GRACE_DAYS": "3", "INVOICE_FORCE": "yes", "INVOICE_MIN_TEXT_CHARS": "x"}, [("min_confidence", "0.5"), ("balance_tolerance", 9)])
    assert (cfg.balance_tolerance, cfg.rules_disabled, cfg.future_date_grace_days, cfg.force, cfg.min_text_chars, cfg.min_confidence) == (0.5, frozenset({"R01"}), 3, True, 20, 0.5)
    assert M.load_templates(str(tmp_path / "none.json")) == M.DEFAULT_TEMPLATES


def test_templates(spark):
    cols = "text string, invoice_no string, total decimal(18,2), issue_date string, seller_name string, c_invoice_no double, c_total double, c_seller_name double, evidence map<string,string>"
    rows = [("甲公司 号码77 金额1,234.50 2026年3月7日", "1", None, None, "旧", 0.95, None, 0.85, {"invoice_no": "x"}), ("甲公司专票", None, None, None, None, None, None, None, {}), (None,) * 8 + ({},)]
    made = [
        {"name": "t", "keywords": ["甲公司"], "exclude_keywords": ["专票"], "fields": {"invoice_no": ["号码[0-9]+", "(", "("], "total": [r"金额([\d,.]+?)\d{4}年", r"金额([\d,]+\.\d\d)"], "issue_date": [r"(\d{4}年\d+月\d+日)"]}, "static": {"seller_name": "甲公司", "buyer_name": "x"}},
        {"name": "u", "keywords": ["公司"]},
    ]
    a, b, c = M.apply_templates(spark.createDataFrame(rows, cols), made).collect()
    assert (a.invoice_no, a.issue_date, a.seller_name, a.template) == ("号码77", "2026-03-07", "甲公司", "t") and float(a.total) == 1234.5
    assert (a.c_invoice_no, a.c_seller_name) == (0.93, 0.9) and a.evidence["!invoice_no"] == "(" and a.evidence["invoice_no"] == "[t] 号码77"
    assert (b.template, b.invoice_no, c.template) == ("u", None, None)
    assert M.apply_templates(spark.createDataFrame(rows, cols), []).where("template is not null").count() == 0


def test_settled_and_watch(spark, tmp_path):
    seen = [(p, "a", 1, s) for p, s in ((0, 1), (1, 1), (2, 1), (3, 2), (4, 2))] + [(0, "b", 1, 1), (2, "b", 1, 1)]
    ready = W.settled(spark.createDataFrame(seen, "poll int, path string, mtime int, size int")).collect()
    assert sorted((r.path, r.poll) for r in ready) == [("a", 1), ("a", 4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    got = []
    W.watch(spark, str(tmp_path / "in"), lambda df, k: got.append(df.count()), str(tmp_path / "ck"), once=True).awaitTermination()
    assert sum(got) == 1


def test_watch_rounds_settle_and_survive_errors(spark, tmp_path):
    folder, states, got = tmp_path / "in", f"file://{tmp_path}/states", []
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"x")

    def each(files, k):
        if k == 3:
            raise RuntimeError("broken")
        got.append((k, sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect())))

    assert W.poll(spark, str(folder), states, 0, each) == 1  # the first round takes what is there
    (folder / "b.pdf").write_bytes(b"y")
    assert W.poll(spark, str(folder), states, 1, each) == 0  # not settled yet
    assert W.poll(spark, str(folder), states, 2, each) == 1 and W.poll(spark, str(folder), states, 2, each) == 1  # again: the same
    (folder / "b.pdf").write_bytes(b"longer")
    (folder / "a.pdf").unlink()
    assert [W.poll(spark, str(folder), states, k, each) for k in (3, 4)] == [0, 1]
    assert got == [(0, ["a.pdf"]), (2, ["b.pdf"]), (2, ["b.pdf"]), (4, ["b.pdf"])]


def test_report_and_csv(spark, tmp_path):
    frame = parsed(spark, GOOD).withColumn("file_name", F.lit("a<b.pdf")).withColumn("seq", F.lit(1))
    page = K.report(frame, R.issue_rows(frame, "file_name"))
    assert "a&lt;b.pdf" in page and "10,600.00" in page and "台账发票行数" in page
    K.write_csv(frame.unionByName(frame.withColumn("seq", F.lit(0))), str(tmp_path / "x.csv"))
    raw = (tmp_path / "x.csv").read_bytes().decode()
    assert raw.startswith("\ufeff序号,源文件名,") and raw.count("\r\n") == 3 and '="26312000000012345678"' in raw and raw.split("\r\n")[1].startswith("0,")
    back = FS.read_ledger_csv(spark, str(tmp_path / "x.csv")).orderBy("seq").collect()
    assert [(r.seq, r.invoice_no, float(r.total)) for r in back] == [(0, "26312000000012345678", 10600.0), (1, "26312000000012345678", 10600.0)]
    assert abs(back[0].confidence - frame.first().confidence) < 0.001
    K.write_xlsx(str(tmp_path / "x.xlsx"), {"发票台账": K.sheet(frame, K.COLUMNS), "空": (["a"], [])})
    sheets = dict(FS.read_xlsx(str(tmp_path / "x.xlsx")))
    assert sheets["空"] == [["a"]] and len(sheets["发票台账"]) == 2
    assert FS.read_ledger_xlsx(spark, str(tmp_path / "x.xlsx"), skip=("空",)).first().invoice_no == "26312000000012345678"


def test_entry_contract():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 25


def test_view_choice(spark):
    noise = "~~~~ ^^^^ |||| ~~~~ ^^^^ ||||"
    rows = [
        ("good", 0, "stdlib", noise), ("good", 1, "stdlib", GOOD), ("good", 2, "pymupdf", GOOD + " "),
        ("worse", 0, "stdlib", noise), ("worse", 1, "ocr(x)", GOOD),
        ("kept", 0, "stdlib", noise), ("kept", 1, "ocr(x)", None),
        ("scan", 0, "ocr(x)", "短"), ("short", 0, "stdlib", "短"), ("empty", 0, None, None),
    ]
    df = spark.createDataFrame(rows, "file_name string, view int, source string, text string")
    got = {r["file_name"]: (r["choice"], r["source"]) for r in V.choose_view(df).collect()}
    assert got == {"good": ("accepted", "pymupdf"), "worse": ("ocr", "ocr(x)"), "kept": ("kept", "stdlib"), "scan": ("ocr", "ocr(x)"), "short": ("manual", None), "empty": ("manual", None)}
    assert V.choose_view(df.limit(0)).collect() == []
    again = df.union(spark.createDataFrame([("good", 5, "stdlib", GOOD)], df.schema))
    assert sorted(map(tuple, V.distinct_views(again).collect()), key=str) == sorted(rows, key=str)
