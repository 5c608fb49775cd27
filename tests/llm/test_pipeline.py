"""The pipeline against a brute-force version on a small part of a fixture of its own."""

import random
from collections import Counter

import corpus_pipeline
from ledgerwright.llm import line_dedup, ngram_join
from pyspark.sql import functions as F

from .test_operators import brute_components, brute_lines, brute_rules, check_pieces


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(21)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 9))) for _ in range(800)]
    line = lambda: " ".join(rnd.choices(words, k=14))
    common = line()
    texts = []
    for _ in range(25):
        body = [line() for _ in range(8)]
        texts.append("\n".join([common, *body]))
        if rnd.random() < 0.5:
            texts.append("\n".join([*body[:-1], body[-1] + " more"]))
    texts += [None, "", "short", "### " * 100, texts[0], "mail x.y@a.example.com\n" + "\n".join(line() for _ in range(7))]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")

    def verdict(t):
        n, chars, symbols, dup, rep = brute_rules(t)
        caps = sum("A" <= c <= "Z" for c in t or "")
        letters = sum(any(not (33 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126) for c in w) for w in (t or "").split())
        return not (10 * letters < 6 * n or n < 1 or 100 * rep > 50 * n or chars < 2 * n or chars > 12 * n or 10 * symbols > 2 * n or 10 * caps > 4 * chars or 10 * dup > 6 * len((t or "").split("\n")))

    rows = [(i, t) for i, t in enumerate(texts) if verdict(t)]
    docs = corpus_pipeline.STAGES[0][1](spark, frame, str(tmp_path))
    assert docs.columns == frame.columns and sorted((r.doc_id, r.text) for r in docs.collect()) == rows
    rows = [(d, t) for d, _, t in brute_lines(rows)]
    docs = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert docs.columns == frame.columns and sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)
    keep = {d for d, _, c in brute_components(sorted(rows)) if c == d}
    docs = corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path))
    assert docs.columns == frame.columns and {r.doc_id for r in docs.collect()} == keep < {d for d, _ in rows}
    docs = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert docs.columns == frame.columns and docs.where(F.col("text").contains("x.y@a.example.com")).count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0 and docs.count() == len(keep)
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_pieces(packed, None, 2048)
    assert {r.doc_id for r in packed} == keep


def test_shared_lines_survive_the_join(spark, tmp_path):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(3, 8))) for _ in range(3000)]
    line = lambda n=14: " ".join(rnd.choices(words, k=n))
    body = lambda: [line() for _ in range(8)]
    held, alone = line(8), line(8)
    bodies = [body() for _ in range(4)]
    texts = {i: [*b, line(3)] for i, b in enumerate(bodies)} | {20 + i: [*b, alone, line(3)] for i, b in enumerate(bodies[:3])}
    texts |= {10: [*body()[:4], held, *body()[:4]], 11: [held.upper() + " ", *body()], 30: [*bodies[3], held, line(3)]}
    rows = [(i, "\n".join(t), "en", "s", 0) for i, t in texts.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = corpus_pipeline.line_stage(spark, frame, str(tmp_path))
    got = {r.doc_id: r for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    low = {d: [x.strip().lower() for x in r.text.split("\n")] for d, r in got.items()}
    for text in (held, alone):
        assert sum(x.count(text) for x in low.values()) == 1
    shared = Counter(x for t in texts.values() for x in {y.strip().lower() for y in t} if len(x) >= 20)
    assert all(any(x in t for t in low.values()) for x, n in shared.items() if n >= 3)
    assert set(got) == {0, 1, 2, 3, 10, 11} and got[11].text == "\n".join(texts[11]) and got[2].text.endswith("\n" + alone)


def test_lines_go_back_in_place():
    a, b, c = "the first long shared line", "The second long shared line ", "x"
    keys = [line_dedup.struct.unpack(">qq", line_dedup.xxhash.xxh3_128_digest(x.strip().lower().encode())) for x in (a, b)]
    assert line_dedup.with_lines_back(c, 1, [(1, f"{a}\n{c}\n{b}", keys)]) == f"{a}\n{c}\n{b}"
    assert line_dedup.with_lines_back("", 1, [(1, f"{a}\n{b}", keys[1:])]) == b
    assert line_dedup.with_lines_back("other row", 1, [(1, f"{a}\n{b}", keys)]) == "other row"
    assert line_dedup.with_lines_back(c, 1, [(2, f"{b}\n{a}\n{b}", keys), (3, a, keys)]) == f"{c}\n{b}\n{a}"


def test_targets_gather_moved_lines_only(spark):
    lines = [f"a shared line with the number {i:04}" for i in range(40)]
    rest = "\n".join(f"other words that stay behind {i}" for i in range(500))
    raw = spark.createDataFrame([(i, f"{x}\n{rest}\n{x}") for i, x in enumerate(lines)], "doc_id long, text string")
    keys = [line_dedup.line_key(x, 20) for x in lines]
    moves = spark.createDataFrame([(i, 0, [k]) for i, k in enumerate(keys)], "donor long, target long, keys array<struct<h1:long,h2:long>>")
    got = {r.donor: r._ld_before for r in line_dedup.line_sources(moves, raw).collect()}
    assert got == dict(enumerate(lines)) | {0: f"{lines[0]}\n{rest}\n{lines[0]}"}
    docs = raw.where("doc_id = 0").withColumn("text", F.lit(rest))
    text = line_dedup.move_lines(docs, moves, raw).first().text
    assert text.startswith(f"{lines[0]}\n{rest}\n{lines[0]}\n") and sorted(text.split("\n")[502:]) == lines[1:]


def test_sample_of_the_order_takes_one_worker_a_task(spark):
    docs = spark.range(30).selectExpr("id", "if(id = 7, null, concat('one two three four five six ', id % 10)) text")
    codes = ngram_join._codes(docs)
    assert codes._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    none = ngram_join.np.empty(0, "uint64")
    both = ngram_join._signatures(ngram_join._classes(docs, none)).select("sig")
    assert sorted(r.sig for r in codes.collect()) == sorted(r.sig for r in both.collect())
