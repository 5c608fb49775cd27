"""The batch run, its products, the rules on written cases, PDF files and the hooks, on small fixtures."""

import difflib
import json
import random
import sys
import unicodedata
import zlib

import pytest
from ledgerwright import storage
from ledgerwright.config import Config
from ledgerwright.functions import fields as P
from ledgerwright.functions import scalars as S
from ledgerwright.operators import rules as R
from ledgerwright.operators import scoring as C
from ledgerwright.operators import templates as M
from ledgerwright.plans import batch as B
from ledgerwright.plans import sinks as K
from ledgerwright.plans import workload as Q
from ledgerwright.sources import files as FS
from ledgerwright.sources import pdf, recognise
from ledgerwright.streaming import watch as W
from pyspark.sql import functions as F

CFG = Config(as_of="2026-12-31")
BUYER = "购买方信息 名称：某某科技有限公司  统一社会信用代码：91310115MA1H8WXYQ4"
SELLER = "销售方信息 名称：虚拟信息技术服务有限公司  统一社会信用代码：91110108MA01C2XY3P"
EINVOICE = f"电子发票（普通发票）\n发票号码：26312000000012345678     发票代码：031002600111\n开票日期：2026年03月12日\n{BUYER}\n{SELLER}\n项目名称 *信息技术服务*技术服务费\n合计 ¥10000.00 ¥600.00\n价税合计（小写）¥10600.00\n税率 6%\n开票人：张三"
OLD = "增值税电子普通发票\n发票号码：12345678  发票代码：031002600111\n开票日期：2026年03月12日\n购买方信息 名称：甲公司  纳税人识别号：91310115MA1H8WXYQ4\n销售方信息 名称：乙公司  纳税人识别号：91110108MA01C2XY3P\n合计金额 ¥1000.00 合计税额 ¥{}\n价税合计（小写）¥{}\n税率 6%"
PLAIN_CODE = "     发票代码：031002600111"
SHIPPED = [
    *M.DEFAULT_TEMPLATES,
    {"name": "数电", "keywords": ["电子发票", "发票号码"], "fields": {"invoice_no": [r"发票号码[:：]?\s*(\d{20})"], "invoice_code": [r"发票代码[:：]?\s*(\d{12})"], "issue_date": [r"开票日期[:：]?\s*(\d{4}[年\-/.]\d{1,2}[月\-/.]\d{1,2})"], "total": [r"价税合计[^0-9¥￥]{0,40}?[¥￥]?\s*(-?[0-9][0-9,]*\.[0-9]{2})"]}},
]


def judged(spark, *texts, templates=None):
    frame = P.parse_fields(S.normalised(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")))
    return C.judged(frame if templates is None else M.apply_templates(frame, templates), CFG).orderBy("k").collect()


def test_written_cases(spark):
    rail = EINVOICE.replace("（普通发票）", "（铁路电子客票）").replace(SELLER, "车次 G1234  北京南站 上海虹桥站").replace("合计 ¥10000.00 ¥600.00\n", "票价 ¥106.00\n").replace("10600.00", "106.00").replace(PLAIN_CODE, "")
    whole = EINVOICE.replace(".00", "").replace(PLAIN_CODE, "")
    odd = EINVOICE.replace("¥10000.00 ¥600.00", "¥1000.00 ¥60.00").replace("10600", "1120")
    good, gap, rate, ints, train, low = judged(spark, EINVOICE, OLD.format("60.00", "1120.00"), OLD.format("130.00", "1130.00"), whole, rail, odd)
    fields = lambda r: {i.field for i in r.issues}
    assert (good.invoice_no, float(good.amount), float(good.tax), float(good.total), good.drawer) == ("26312000000012345678", 10000, 600, 10600, "张三")
    assert "金额勾稽" in fields(gap) and gap.status == "异常" and "税率×金额" in fields(rate) and "金额勾稽" not in fields(rate)
    assert (float(ints.amount), float(ints.tax), float(ints.total)) == (10000, 600, 10600)
    assert train.invoice_type == P.RAIL and float(train.total) == 106 and "销售方名称" not in fields(train)
    assert low.confidence <= 0.85 < good.confidence
    shipped = judged(spark, EINVOICE, templates=SHIPPED)[0]
    assert (shipped.confidence, shipped.status, shipped.template) == (0.923, "存在提示", "数电")


def test_split_labels_score_low(spark):
    scattered = "26312000000012345678\n2026-03-12\n10000.00\n600.00\n10600.00\n6%\n某某科技有限公司\n虚拟信息技术服务有限公司\n91310115MA1H8WXYQ4\n91110108MA01C2XY3P\n发票号码 开票日期 合计金额 合计税额 价税合计 税率 购买方信息 名称 销售方信息 名称 纳税人识别号 项目名称 开票人"
    frame = P.parse_fields(S.normalised(spark.createDataFrame([(EINVOICE,), (scattered,)], "text string")))
    good, bad = (r.x for r in frame.select(C.read_confidence().alias("x")).collect())
    assert good > bad < 0.6


def test_credit_notes_and_rates(spark):
    note, two = judged(spark, EINVOICE.replace("¥10000.00 ¥600.00", "¥-10000.00 ¥-600.00").replace("（小写）¥10600.00", "-10600.00"), EINVOICE.replace("税率 6%", "税率 6%\n1,234.507%"))
    assert float(note.total) == -10600 and {i.field for i in note.issues if i.level == "提示"} == {"价税合计"}
    assert two.tax_rate == "6%/7%" and [i.message for i in two.issues if i.field == "税率"] == ["税率不常见：7%"]


def test_party_name_falls_back_to_its_section(spark):
    text = "购买方\n名称：\n地址 电话\n纳税人识别号：91310115MA1H8WXYQ4\n名称：甲乙有限公司\n销售方\n名称：丙丁有限公司\n税号：91110108MA01C2XY3P"
    r = judged(spark, text)[0]
    assert (r.buyer_tax, r.seller_name, r.seller_tax) == ("91310115MA1H8WXYQ4", "丙丁有限公司", "91110108MA01C2XY3P")


def test_a_rule_that_cannot_be_built_is_a_warning(spark):
    R.RULES["R99"] = ("提示", "x", lambda cfg: [R.Check(F.col("no_such_column") > 1, "提示", "x", "x", "x")])
    R.RULES["R98"] = ("提示", "x", lambda cfg: [R.Check(F.col("drawer") == "张三", "严重", "drawe", "x", "x")])
    try:
        r = judged(spark, EINVOICE)[0]
    finally:
        del R.RULES["R99"], R.RULES["R98"]
    assert {"规则R99", "drawe"} <= {i.field for i in r.issues}
    assert r.confidence_map["drawer"] == 0.51  # a label that is no field's: those whose name holds it


def test_normalised_equals_nfkc(spark):
    rnd = random.Random(3)
    pool = "aZ0 ：（）￥　 ​﻿Ⅷ㈱ﬁé́가ㄱ中、。「」…\r\n１Ａ～" + "".join(map(chr, range(0xFF01, 0xFF60)))
    texts = [None, "", *("".join(rnd.choices(pool, k=rnd.randrange(1, 30))) for _ in range(400))]

    def brute(t):
        t = t.replace("\r\n", "\n").replace("\r", "\n")
        for c in " 　​﻿":
            t = t.replace(c, " ")
        return unicodedata.normalize("NFKC", t)

    got = [r.text for r in S.normalised(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")).orderBy("k").collect()]
    assert got == [None if t is None else brute(t) for t in texts]


def test_similarity_against_difflib(spark):
    rnd = random.Random(8)
    pairs = [("", "a"), ("甲乙丙", "甲乙丙"), (None, "x")]
    for _ in range(200):
        a = "".join(rnd.choices("甲乙丙丁戊公司有限", k=rnd.randrange(1, 14)))
        b = list(a)
        for _ in range(rnd.randrange(0, 3)):
            b[rnd.randrange(len(b))] = rnd.choice("甲乙丙丁戊")
        pairs.append((a, "".join(b) + rnd.choice(["", "公"])))

    def brute(a, b):
        return 0.0 if not a or not b else 1.0 if a == b else max(len(set(a) & set(b)) / len(set(a) | set(b)), difflib.SequenceMatcher(None, a, b).ratio())

    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    rows = S.with_similarity(S.with_similarity(frame, F.col("a"), F.col("b"), "s"), F.col("a"), F.col("b"), "t", 0.9).orderBy("k").collect()
    for (a, b), r in zip(pairs, rows, strict=True):
        assert abs(r.s - brute(a, b)) < 1e-12 and (r.t >= 0.9) == (brute(a, b) >= 0.9)


def test_region_codes_and_structure(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    code = S.invoice_code(S.region_code(F.lit("上海")), F.lit(2026), F.lit(1), F.lit("11"))
    assert one(code) == "031002600111" and one(S.e_invoice_no(S.region_code(F.lit("上海")), F.lit(2026), F.lit(1), F.lit(1))) == "26311000000000000001"
    assert [one(S.code_fault(F.lit(x))) for x in ("031002600111", "03100260011", "131002600111", "031002600112")] == [None, "length", "start", "kind"]
    with pytest.raises(Exception, match="unknown region"):
        one(S.region_code(F.lit("无此地")))


def views(spark, rows):
    """rows: (path, hash, view, text)"""
    made = [(p, p.rsplit("/", 1)[1], k if t is None else 0, h, v, f"pdf-text({'pymupdf' if v else 'stdlib'})", t, 1, "scan" if t is None else None) for k, (p, h, v, t) in enumerate(rows)]
    frame = spark.createDataFrame(made, "path string, file_name string, k int, file_hash string, view int, source string, text string, pages int, note string")
    return frame.withColumn("mtime", F.timestamp_seconds("k")).drop("k")


def test_batch(spark, tmp_path):
    two = EINVOICE + "\n" + EINVOICE.replace("12345678", "87654321")
    noise = "|||~~~ noise 发票号码 12 ^^^^^^^^^^^^^^"
    rows = [("/1/a.pdf", "h1", 0, EINVOICE), ("/1/b.pdf", "h2", 0, two), ("/1/c.pdf", "h1", 0, EINVOICE), ("/1/f.pdf", "h4", 0, EINVOICE + " "), ("/1/g.pdf", "h4", 0, EINVOICE + " "), ("/1/v.pdf", "h5", 0, noise), ("/1/v.pdf", "h5", 1, EINVOICE.replace("12345678", "11111111")), ("/1/x.pdf", "h3", 0, None), ("/1/y.pdf", "h3", 0, None)]
    first = B.run_batch(spark, views(spark, rows), cfg=CFG, now="t0")
    got = [(r.seq, r.file_name, r.status) for r in first.ledger.orderBy("seq").collect()]
    assert got == [(1, "a.pdf", "存在提示"), (2, "b.pdf [第2张/共2张]", "存在提示"), (3, "v.pdf", "存在提示"), (4, "x.pdf", "待人工录入")]
    assert {r.what: r.n for r in first.stats.collect()} == {"skipped": 0, "duplicate": 5, "new_files": 5, "ocr_todo": 1, "new_invoices": 3}
    dups = {(r.file_name, r.field) for r in first.issues.where("level = '重复'").collect()}
    assert dups == {("b.pdf", "发票唯一性"), ("f.pdf", "发票唯一性"), ("g.pdf", "发票唯一性"), ("c.pdf", "文件指纹"), ("y.pdf", "文件指纹")}
    assert first.issues.where("field = '发票唯一性' and message like '%「a.pdf」第 1 行%'").count() == 3
    assert first.ledger.where("file_name = 'v.pdf'").first().extractor == "pdf-text(pymupdf)(多视图择优，共 2 个视图)"
    audit = [json.loads(x) for x in first.audit.toJSON().collect()]
    assert len(audit) == 4 and sum("error" in x for x in audit) == 1 and all("evidence" in x for x in audit if x["status"] != "待人工录入")

    paths = K.write_all(first.ledger, first.issues, first.audit, {"new_invoices": 3}, str(tmp_path), xlsx=True)
    assert set(paths) == {"csv", "json", "issue_csv", "review_csv", "audit", "report", "xlsx"}
    detail = json.loads((tmp_path / K.NAMES["json"]).read_text(encoding="utf-8"))
    assert len(detail) == 4 and json.loads(detail[0]["识别证据"])["total"].endswith("10600.00") and detail[0]["识别置信度"].endswith("%")
    assert (tmp_path / K.NAMES["review_csv"]).read_text(encoding="utf-8").count("待人工录入") == 1
    assert (tmp_path / K.NAMES["report"]).read_text(encoding="utf-8").count("<tr><td>") == 4 + first.issues.count()

    state = f"file://{tmp_path}/state"
    assert K.load_state(spark, state) is None and K.save_state(first.ledger, first.issues, state) == 1
    ledger, issues = K.load_state(spark, state)
    again = B.run_batch(spark, views(spark, [*rows, ("/2/z.pdf", "h2", 0, two)]), ledger, issues, CFG, now="t1")
    assert again.new_rows.count() == 0 and again.ledger.count() == 4
    assert again.issues.count() == issues.count() + 1 and [r.seq for r in again.issues.orderBy("seq").collect()] == list(range(1, issues.count() + 2))

    found = B.run_batch(spark, views(spark, [("/1/x.pdf", "h3", 0, EINVOICE.replace("12345678", "22222222"))]), ledger, issues, Config(as_of="2026-12-31", retry_failed=True), now="t2")
    assert found.ledger.where("status = '待人工录入'").count() == 0 and found.issues.where("file_name = 'x.pdf' and field = '文本提取'").count() == 0
    marked = B.run_batch(spark, views(spark, rows[:5]), cfg=Config(as_of="2026-12-31", on_duplicate="mark"))
    assert [r.status for r in marked.ledger.orderBy("seq").collect()].count("重复未入账") == 2 and marked.issues.where("file_name = 'g.pdf'").first().field == "文件指纹"
    forced = B.run_batch(spark, views(spark, rows[:2]), ledger, issues, Config(as_of="2026-12-31", force=True), now="t3")
    assert sorted(r.seq for r in forced.ledger.collect()) == [1, 2, 3, 4] and forced.ledger.where("processed_at = 't3'").count() == 2
    none = B.run_batch(spark, views(spark, rows[:1]).limit(0), ledger, issues, CFG)
    assert none.ledger.count() == 4 and none.new_rows.count() == 0


def test_fallback_reader_fills_weak_records(spark):
    asked = Config(as_of="2026-12-31", fallback_enabled=True)

    def reader(text):
        if "broken" in text:
            raise ValueError("no answer")
        return {"seller_name": "某公司", "total": "1,060.00", "invoice_no": "99999999"}

    rows = [("/a.pdf", "h1", 0, "发票号码:12345678 weak text without much"), ("/b.pdf", "h2", 0, "broken text 发票 without anything in it"), ("/c.pdf", "h3", 0, EINVOICE)]
    done = B.run_batch(spark, views(spark, rows), cfg=asked, fallback=reader).ledger.orderBy("seq").collect()
    assert [(r.invoice_no, r.seller_name) for r in done] == [("12345678", "某公司"), (None, None), ("26312000000012345678", "虚拟信息技术服务有限公司")]
    assert float(done[0].total) == 1060 and done[0].issue.endswith("；补读 2 项") and "no answer" in done[1].issue and "补读" not in done[2].issue


@pytest.mark.parametrize("kind", range(5))
def test_pdf_kinds(kind):
    text = "Invoice (No) 7\n\\end" if kind == 2 else "电子发票(普通发票)\n𠮷野家 12\n价税合计¥1,060.00"
    assert pdf.read_text(Q.pdf_bytes(text, kind)) == (text, 1, None)


def test_pdf_details():
    cmap = pdf.CodeMap(b"1 beginbfrange <0001> <0003> <D842DFB7> endbfrange 2 beginbfrange <0010> <0011> [<0041> <00420043>] <0000> <FFFFFF> <4E00> endbfrange")
    assert [cmap.get(k) for k in (1, 2, 0x10, 0x11, 5)] == ["𠮷", "𠮸", "A", "BC", "丅"]
    proc = zlib.compress(b"BT /F1 1 Tf (kept) Tj ET")
    form = b"%%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R /Resources << /ProcSet [/PDF /ImageB] /XObject << /X 3 0 R /I 4 0 R >> >> >> endobj\n2 0 obj << /Length 12 >> stream\n/I Do /X Do \nendstream endobj\n3 0 obj << /Subtype /Form /Resources << /ProcSet [/ImageB] >> /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n4 0 obj << /Subtype /Image >> stream\n(1 0 obj) Tj\nendstream endobj" % (len(proc), proc)
    assert pdf.read_text(form)[0] == "kept"
    big = b"BT (" + b"x" * (17 << 20) + b") Tj ET"
    packed = zlib.compress(big)
    whole = b"%%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj 2 0 obj << /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj" % (len(packed), packed)
    assert len(pdf.read_text(whole)[0]) == 17 << 20  # decoded whole, never a prefix
    assert pdf.read_text(whole.replace(packed, big).replace(b"/Filter /FlateDecode", b""))[0] is None  # stored above the limit: left alone
    assert pdf.read_text(b"%PDF-1.4 trailer << /Encrypt 5 0 R >>")[2] == "encrypted"
    assert pdf.read_text(b"")[0] is None and pdf.read_text(b"junk")[2] == "not a PDF file" and pdf.read_text(b"%PDF-1.4 1 0 obj << /A [ ( << endobj")[0] is None
    rnd = random.Random(1)
    for _ in range(200):
        raw = bytearray(Q.pdf_bytes("发票号码\n12", rnd.randrange(5)))
        for _ in range(8):
            raw[rnd.randrange(9, len(raw))] = rnd.randrange(256)
        pdf.read_text(bytes(raw))


def test_files_to_ledger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(Q.pdf_bytes(EINVOICE, 0))
    (tmp_path / "in" / "b.png").write_bytes(b"image")
    (tmp_path / "in" / "c.jpg").write_bytes(b"bad image")

    def engine(content):
        if content.startswith(b"bad"):
            raise RuntimeError("engine crashed")
        return EINVOICE.replace("12345678", "33333333")

    found = FS.read_views(FS.read_files(spark, str(tmp_path / "in")), CFG, engine)
    assert sorted((r.file_name, r.text is None) for r in found.collect()) == [("a.pdf", False), ("b.png", False), ("c.jpg", True)]
    each = W.book_into(spark, f"file://{tmp_path}/state", cfg=CFG, engine=engine)
    raw = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    each(raw, 0)
    each(raw, 0)
    ledger, issues = K.load_state(spark, f"file://{tmp_path}/state")
    assert sorted((r.file_name, r.status) for r in ledger.collect()) == [("a.pdf", "存在提示"), ("b.png", "存在提示"), ("c.jpg", "待人工录入")]
    assert "engine crashed" in issues.where("field = '文本提取'").first().message


def test_recognition_runs_apart(spark):
    code = "import sys, json; d = sys.stdin.buffer.read(); print('log'); print(json.dumps({'text': d.decode() * 2}))"
    assert recognise.isolated([sys.executable, "-c", code], b"ab") == "abab"
    for bad, what in (("import os; os.abort()", "signal"), ("print(1)", "no answer"), ("import sys; sys.exit(3)", "exit code 3")):
        with pytest.raises(RuntimeError, match=what):
            recognise.isolated([sys.executable, "-c", bad], b"")
    with pytest.raises(RuntimeError, match="more than"):
        recognise.isolated([sys.executable, "-c", "import time; time.sleep(9)"], b"", 0.2)
    texts = [EINVOICE, "", "|||~~~", "短", "发票号码 开票日期" * 30, "\x01\x02 x"]
    got = [r.q for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", S.text_quality(F.col("t")).alias("q")).orderBy("k").collect()]
    assert [recognise.quality(t) for t in texts] == got
    assert recognise.provider() is None or recognise.provider() in recognise.ENGINES


def test_state_json_and_empty_rows(spark, tmp_path):
    rows = [{"seq": 1, "file_name": "a.pdf", "invoice_no": "1", "total": 10.5, "confidence": "93.1%", "status": "正常"}, {"seq": 2}]
    (tmp_path / "s.json").write_text(json.dumps({"rows": rows, "issues": [{"序号": 1, "源文件名": "a.pdf", "问题级别": "警告"}]}, ensure_ascii=False), encoding="utf-8")
    ledger, issues = FS.read_state_json(spark, str(tmp_path / "s.json"))
    r = ledger.first()
    assert ledger.count() == 1 and (r.seq, float(r.total), r.confidence) == (1, 10.5, 0.931) and issues.first().level == "警告"


def test_intermediate_tables_are_deleted(spark):
    before = len(storage._left)
    with storage.Scratch(spark) as tables:
        tables.written(spark.range(3), "gone")
        kept = tables.written(spark.range(4), "kept", keep=True)
        assert len(storage._left) == before + 2
    assert len(storage._left) == before + 1 and kept.count() == 4


def test_records_are_dealt_by_file_once(spark):
    parsed, _ = B.candidates(views(spark, [("/1/a.pdf", "h1", 0, EINVOICE)]), Config())
    plan = B.parse_views(parsed, Config(), [])._jdf.queryExecution().executedPlan().toString()
    assert "mtime" in plan
    top = plan[: plan.index("REPARTITION_BY_NUM")]
    assert top.count("Window") >= 3 and top.count("Exchange") == 1
