from __future__ import annotations

import tiktoken
import pytest
from pyspark.sql import functions as F

from forgelens.llm import bpe, mixing, residue, subjects

from ..conftest import rows

RESIDUE = [
    "Dear <Your Name>, thanks for {{ project.name }}.", "Built from @@VERSION@@ by the @@TEAM@@ team.", "# x\n\nLorem ipsum dolor sit amet, consectetur", "404 Not Found\n\nThe page you requested could not be located on this server.", "Home | Docs\n\nOops! Something went wrong on our side.",
    "You need to enable JavaScript to run this app.", "Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.", "TODO: write a short summary of the module.", "Released by undefined on [object Object] for it.", "<!-- describe what the change does -->\n- [ ] tests added", "抱歉，您访问的页面不存在。", "{0} depends on {1}.",
    "<noscript>Sorry, this view does not work properly without JavaScript enabled.</noscript>", "Your content here. Your content here.",
]
CONTENT = [
    "The renderer fills `{{ name }}` and `{% if x %}` blocks.", "```yaml\npython: ${{ matrix.python }}\n```\nThe matrix covers 3 versions.", "A small generator of lorem ipsum for tests: it makes 5 words.", "When the tracker answers 404 Not Found for a file, the client now stops.", "I removed the last TODO in the code.",
    "The log says \"Bad Gateway\" and the file is dropped.", "As an example we use $x_{i}$ and $\\frac{a}{b}$.", "The dictionary {'a': 1} and the set {1, 2} are printed.", "`run <source> <target> [--force]` needs both names.", "Without scripts the page still lists all; only sorting needs JavaScript.", "[core] fix slow parser", "see [docs](x) and [1]",
    "> You need to enable JavaScript to run this app.\n\nThis is what users saw.", "<|endoftext|> is plain text", "", "   ", None,
]


def test_residue(spark):
    texts = [(i, t, "s" if i % 2 else None) for i, t in enumerate(RESIDUE + CONTENT)]
    df = spark.createDataFrame([*texts, (0, RESIDUE[0], "s")], "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("norm", F.lit("x"))
    assert {r.doc_id for r in residue.residue(df).collect()} == set(range(len(RESIDUE)))
    assert residue.residue(df.limit(0)).count() == 0


CUED = [
    "Dear None,", "Released by None", "Version nan", "Hello null!", "Details to be provided", "Section will be inserted", "dolor sit amet consectetur", "consectetur adipiscing", "рыба-текст", "Text text text.", "XXX", "Coming soon", "Replace this line", "Bitte ersetzen", "örnek metin", "占位符", "Buraya metin",
    "Please verify that you are human.", "The page you are looking for has been deleted.", "找不到您要的内容", "Доступ запрещён", "Страница не найдена", "PAGE NON TROUVÉE", "Connection timed  out", "Sign  in again to go on.", "Please come back  later", "Включите JavaScript", "Temporarily out  of service", "You have used  up your hourly quota", "Go  back or search for another page",
    "If this goes  on, write to support", "We have been told about it", "That link is dead", "This service is taking a short break", "Wait 3 seconds and reload", "Your session has expired", "We hit a snag", "Too  many requests.", "the wiki cannot be shown", "Repository unavailable", "Scripts required", "If nothing happens, allow them",
]


def test_every_rule_gets_past_the_cue(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*CUED, "A plain line of prose."])], "doc_id long, text string, source string")
    found = {r.doc_id for r in residue.messages(df).collect()}
    assert [t for i, t in enumerate(CUED) if i not in found] == [] and len(CUED) not in found
    beside = spark.createDataFrame([(i, f"{t}\n503 Service Unavailable", "s") for i, t in enumerate(CUED)], "doc_id long, text string, source string")
    judged = residue.residue_lines(residue.messages(beside)).where("norm not like '%service unavailable'").select("doc_id").distinct().count()
    assert judged == len(CUED)  # each is an example of a rule


def test_weak_phrases_alone_are_the_whole_text(spark):
    many = spark.createDataFrame([(i, "Nothing to see here", "a") for i in range(3)] + [(9, "We hit a snag", "b"), (10, "We hit a snag\n\nThe lamp is green.", "b")], "doc_id long, text string, source string")
    assert rows(residue.residue(many), "doc_id", "kind") == [(i, "error_page") for i in (0, 1, 2, 9)]


def test_weak_phrases_beside_each_other_need_no_recurrence(spark):
    texts = [(1, "Your session has expired. Sign in again to go on."), (2, "The lamp is green.\n\nWe hit a snag. We hit a snag."), (3, "Please come back later\n\n503 Service Unavailable"), (4, "The lamp is green.\n\nWe hit a snag. Please come back later.")]
    df = spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, source string")
    assert rows(residue.residue(df), "doc_id", "kind") == [(1, "error_page"), (3, "error_page"), (4, "error_page")]


def test_message_counts_are_of_the_masked_message(spark):
    texts = [(i, f"Wait {i} seconds and reload\nWait {i + 50} seconds and reload", f"s{i % 3}") for i in range(7)] + [(7, "wait 3  seconds and reload", None), (7, "wait 3 seconds and reload", None)]
    texts += [(20, "Set [NAME] there", "s0"), (21, "Set [name] there", "s1"), (22, "set [NAME] there", "s1")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    assert rows(residue.recurrence(df), "kind", "norm", "documents", "sources") == [("error_page", "wait # seconds and reload", 8, 4), ("placeholder", "set [name] there", 3, 2)]


def test_ids_equal_the_public_tokenizer(spark):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world's", "  two  blanks \n\t x\n\n", "", None, "naïve café İstanbul ışık", "日本語 текст \U0001f600\u0007", "x" * 3000, "ab" * 700 + "=" * 400, "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(2500)), "".join(chr(33 + (i * 31 + i // 7) % 90) for i in range(900)), "日本" * 60, "<|endoftext|>", "don't we'll I'VE 12345", "\u00a0\u2003wide\u3000", "mainframe-lens_v2.unzip()", "Hello world's"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("pos", F.lit(1))
    got = {r.doc_id: r for r in bpe.encode(df).withColumn("back", bpe.decode(F.col("ids"))).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == enc.encode_ordinary(t or ""), t
        assert got[i].back == (t or "")
    assert bpe.encode(df.limit(0)).count() == 0


def test_words_of_a_row_without_key_are_kept(spark):
    texts = ["naïve café", "日本語 текст", "plain text", "naïve café"]
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[0])], "doc_id long, text string")
    got = bpe.encode(df).select("doc_id", bpe.decode(F.col("ids")).alias("back")).collect()
    assert sorted(r.back for r in got if r.doc_id is None) == sorted(texts) and [r.back for r in got if r.doc_id == 1] == texts[:1]


def mixed(spark, docs, targets, **k):
    s = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m, plans = mixing.mix(s, t, **k)
    return m, {r.source: r for r in mixing.shares(m, plans).collect()}


def test_mixture_meets_shares(spark):
    docs = [(i, "big", 10 + i % 5) for i in range(3000)] + [(10_000 + i, "small", 7) for i in range(200)] + [(20_000, None, 5), (20_001, "other", 5), (20_002, "big", 0)]
    m, got = mixed(spark, docs, [("big", 0.7, 1), ("small", 0.2, 3), ("gone", 0.1, 2)])
    assert got["big"].actual_share == pytest.approx(7 / 9, abs=0.003) and got["small"].actual_share == pytest.approx(2 / 9, abs=0.003)
    assert got["gone"].tokens == 0 and got["small"].max_copies <= 3 and m.where("source not in ('big', 'small')").count() == 0
    assert m.groupBy("doc_id").count().where("count > 1").count() == 0


def test_mixture_with_a_given_total_reports_the_shortfall(spark):
    docs = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(10)]
    m, got = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], total=1000)
    assert got["a"].tokens == 500 and got["b"].tokens == 200 and got["b"].wanted == 200 and got["b"].max_copies == 2
    empty, none = mixed(spark, [], [("a", 1.0, 1)])
    assert empty.count() == 0 and none["a"].actual_share == 0


def test_thresholds_against_sorting(spark):
    docs = [(i, "s", 1 + (i * 7919) % 50) for i in range(2000)]
    total = 9_000
    m, got = mixed(spark, docs, [("s", 1.0, 1)], total=total)
    assert abs(got["s"].tokens - total) <= 25 and m.agg(F.max("copies")).first()[0] == 1


def test_subjects(spark):
    kinds = {
        "AI/ML": ("Trains neural networks on images", ["pytorch", "Deep_Learning"]), "Web": ("Serves pages with routes and cookies", ["django", "http"]), "Data": ("Loads spreadsheets and cleans tables", ["pandas", "etl"]),
        "Security": ("Finds weak ciphers in networks", ["pentest", "malware"]), "Diger": ("Knitting patterns row by row", ["knitting"]),
    }
    data = [(f"{c}{i}", d, t) for c, (d, t) in kinds.items() for i in range(12)]
    data += [("bare-web", "Serves pages with routes and cookies", []), ("two", "Trains neural networks on images. Also: Loads spreadsheets and cleans tables", None), ("none", None, None), ("blank", "  ", [" ", None]), ("none", None, None)]
    df = spark.createDataFrame([(n, t, d) for n, d, t in data], "full_name string, topics array<string>, description string")
    df = df.withColumn("votes", F.lit("clash")).withColumn("category", F.lit("x"))
    labels = spark.createDataFrame([(f"{c}{i}", c) for c in kinds for i in range(4)] + [("Web5", "Data"), (None, "Web"), ("Web6", None), ("Web7", "No such")], "full_name string, category string")
    catalogue = spark.createDataFrame([(c, f"all about {c}") for c in [*kinds, "Mobile"]] + [(None, "x")], "category string, meaning string")
    got = {}
    for r in subjects.subjects(df, labels, catalogue).collect():
        got.setdefault(r.full_name, set()).add(r.category)
    assert all(got[f"{c}{i}"] == {c} for c in kinds for i in range(12))
    assert got["bare-web"] == {"Web"} and got["two"] == {"AI/ML", "Data"} and got["none"] == got["blank"] == {"Diger"}
    assert subjects.subjects(df.limit(0), labels, catalogue).count() == 0
    fresh = [("law", "Compares statutes and court rulings"), ("chips", "Flashes bootloaders onto microcontrollers"), ("sea", "Charts tides of estuaries"), ("choir", "Arranges madrigals by voice range")]
    unknown = spark.createDataFrame([(n, [], d) for n, d in fresh], "full_name string, topics array<string>, description string")
    assert {r.category for r in subjects.subjects(df.select("full_name", "topics", "description").union(unknown), labels, catalogue).where("full_name in ('law', 'chips', 'sea', 'choir')").collect()} == {"Diger"}
