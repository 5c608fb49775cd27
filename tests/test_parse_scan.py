"""Parsing: no pattern is compiled for each row, and the short ways give what the plain ones do."""

import re
import unicodedata

from ledgerwright.functions import fields as P
from ledgerwright.functions import scalars as S
from pyspark.sql import functions as F

ODD = [
    "", " ", "\n", "\r", "\r\n\r\n", "a", " a\tb \n\n c　", "\u0085x ", "x\u0085", " 名称 :甲 公司\n地址 一\n", "甲\n地址", "地址甲", "：：（注）甲公司，地址\n乙",
    "１２３\r\n（Ａ）Ⅷ㈱\r", "£5§×→\r", None, "价税合计¥1.00 价税合计(大写)壹元整(小写)¥2.00", "发票代码 发票代码:031002600111", "价税合计—— 小写 (小写)¥3", "x价税合计", "校验码 1234 校验码:123456789012345",
]


def test_short_ways_equal_the_plain_ones(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "k int, text string")
    rows = docs.withColumns({"lines": S.trimmed_lines(F.col("text")), "parts": S.stripped(S.flat_lines(F.col("text"))), "one": S.oneline(F.col("text")), "one2": S.oneline(S.trimmed_lines(F.col("text")))})
    for r in rows.withColumn("name", P.clean_name(F.col("text"))).withColumn("split", F.split("text", P.NAME_END, 2)[0]).withColumn("head", P.clean_name(F.col("split"))).collect():
        assert (r.lines, r.one, r.name) == (r.parts, r.one2, r["head"]), r
    blank = {" ": " ", "　": " ", " ": " "}
    for r in docs.join(S.normalised(docs).withColumnRenamed("text", "new"), "k").collect():
        want = None if r.text is None else unicodedata.normalize("NFKC", "".join(blank.get(c, c) for c in re.sub("\r\n?", "\n", r.text)))
        assert r.new == want, r
    got = {r.k: r for r in P.parse_fields(docs).collect()}
    assert [str(got[k].total) for k in (16, 18)] == ["1.00", "3.00"] and got[19].total is None and got[15].total is None
    assert got[16].cn_amount == 1 and got[17].invoice_code == "031002600111" and got[20].check_code == "123456789012345"


def test_no_pattern_is_compiled_for_each_row(spark):
    parsed = P.parse_fields(spark.createDataFrame([("购买方名称:甲",)], "text string")).select("buyer_name", "seller_name")
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert P.NAME_END in plan and f", {P.NAME_END}, 2)" not in plan
