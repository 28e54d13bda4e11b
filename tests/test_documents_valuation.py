import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import lexicons as lx
from tallyloom.operators import documents as d
from tallyloom.operators import valuation as v


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def analysed(spark, *texts):
    return {r.doc_id: r for r in d.analyze(d.paragraphs(docs(spark, *texts))).filter("pos = 0").collect()}


def test_paragraphs_split_on_blank_lines_and_mark_headings(spark):
    rows = d.paragraphs(docs(spark, "OVERVIEW\n\nSales rose.\n\n\n ALL CAPS. \n\n")).orderBy("pos").collect()
    assert [(r.text, r.is_heading) for r in rows] == [("OVERVIEW", True), ("Sales rose.", False), ("ALL CAPS.", True)]


def test_long_single_block_is_cut_at_heading_lines(spark):
    body = "word " * 500
    text = f"First line.\n{body.strip()}.\nNext Heading\nmore text."
    rows = d.paragraphs(docs(spark, text)).orderBy("pos").collect()
    assert len(rows) == 2 and rows[1].text == "Next Heading\nmore text." and "".join(r.text for r in rows).count("word") == 500
    assert d.paragraphs(docs(spark, "a\nHeading\nb")).count() == 1


def test_flags_and_relevance(spark):
    got = analysed(
        spark,
        "We expect revenue of $1.2 million and demand may grow.",
        "Costs increased 3 % compared to the prior year.",
        "Safe harbor: actual results may differ.",
        "A material and significant increase in customer orders is likely.",
        "Unaspected borders.",
    )
    assert got[0].temporality == "forward_looking" and got[0].has_dollar and set(got[0].topics) == {"revenue", "demand"} and got[0].relevance == 4
    assert got[1].temporality == "historical" and got[1].has_percent and got[1].relevance == 1
    assert got[2].is_boilerplate and got[2].relevance == 2 - 3
    assert got[3].is_material and got[3].is_significant and got[3].is_change and got[3].relevance == 6
    # Keywords are substrings: "asp" and "order".
    assert set(got[4].topics) == {"pricing", "revenue"}


def test_tone_counts_do_not_overlap_and_may_be_unknown(spark):
    df = docs(spark, "growth growth risk", "nothing here", "aaaa")
    got = {r.doc_id: r for r in d.with_tone(df).collect()}
    assert got[0].tone == pytest.approx(2 / 3) and got[0].tone_label == "positive"
    assert got[1].tone is None and got[1].tone_label == "neutral"
    assert {r.doc_id: r.positive_count for r in d.with_tone(df, positive=("aaa",), negative=("zz",)).collect()}[2] == 1


def test_whole_word_option(spark):
    row = d.lowered(docs(spark, "in every aspect")).select(d.topics(d.LOW).alias("a"), d.topics(d.LOW, whole_words=True).alias("b")).first()
    assert row.a == ["pricing"] and row.b == []


def test_html_to_text(spark):
    html = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><h1>Title</h1><p>One <b>two</b> &amp; &copy; &#65;</p><!-- no --><div>x</div></body></html>"
    out = spark.createDataFrame([(html,)], "h string").select(d.html_to_text("h").alias("t")).first().t
    assert out == "Title\n\nOne\ntwo\n& © A\n\nx"


def test_html_to_text_equals_its_sql_on_odd_pages(spark, scratch_dir):
    import duckdb

    import __spark_entry__ as entry_point

    pages = [
        "<p>cut off &amp</p><p>&am</p>and&&&amp", "<p>a&copy b &amp;lt; &amp;amp;</p>", "<p>x&nbsp;</p><p>&nbsp;</p>y", "\xa0 \f<b> one</b>\f \r\n\xa0\n\n\n two \xa0",
        "<script>a <!-- </script> --> b</script>c", "<pé>d<p\n>e<!DOCTYPE x>f", "", "  \n", None,
    ]
    path = f"{scratch_dir}/sf"
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").select("page_id", F.lit("").alias("url"), "html").coalesce(1).write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, chars, digest FROM ({entry_point.oracle_sql()['txt_html_to_text']}) q ORDER BY 1").fetchall()
    assert [tuple(r) for r in entry_point.queries()["txt_html_to_text"](spark, path).orderBy("page_id").collect()] == want


SPECS = [{"section": "risk", "title": r"risk\s+factors", "item": "1a", "next_item": "7"}, {"section": "mdna", "title": r"management.s\s+discussion", "item": "7", "next_item": "8"}]


def test_sections_skip_contents_and_cross_references(spark):
    contents = "Item 1. Business\nItem 1A. Risk Factors\nItem 7. Management's Discussion\nItem 8. Statements\n"
    risk, mdna = "r" * 300, "m" * 300
    text = contents + "c" * 3200 + f"\nsee Item 7. above\nItem 1A. Risk Factors\n{risk}\nItem 7.\nManagement's Discussion\n{mdna}\nItem 8. Statements\nend"
    rows = {r.section: r.text for r in d.sections(docs(spark, text), SPECS, min_length=200).collect()}
    assert rows["risk"] == f"Item 1A. Risk Factors\n{risk}\n" and rows["mdna"] == f"Item 7.\nManagement's Discussion\n{mdna}\n"
    assert d.sections(docs(spark, text), SPECS, min_length=2000).count() == 0
    bare = "x" * 10 + f"\nRisk Factors\n{risk}\nItem 7. next"
    assert d.sections(docs(spark, bare), SPECS, min_length=200).first().text == f"Risk Factors\n{risk}\n"


def test_tickers(spark):
    df = docs(spark, "CEO of AAPL met Tesla", "nothing", "Buy $TSLA and $toolong now $ABCDEF")
    rows = d.ticker_mentions(df, universe=["AAPL"]).select("doc_id", "ticker").collect()
    assert sorted((r.doc_id, r.ticker or "") for r in rows) == [(0, "AAPL"), (0, "TSLA"), (1, ""), (2, "")]
    assert df.filter("doc_id = 2").select(d.cashtags("text")).first()[0] == ["TSLA"]


def test_scoring_uses_the_injected_model_once_per_task_and_skips_scored(spark):
    texts = spark.createDataFrame([(i, f"growth {i}", i, None if i == 3 else "T") for i in range(6)], "id int, body string, at int, ticker string")
    scores = spark.createDataFrame([(0,)], "id int")

    def load():
        return lambda batch: [(0.7, 0.1, 0.2)] * len(batch)

    out = d.score_incremental(texts, scores, "id", "body", "at", "ticker", load, version="m1").collect()
    assert sorted(r.id for r in out) == [1, 2, 4, 5] and all(r.model_version == "m1" and r.composite == pytest.approx(0.6) for r in out)
    lexicon = d.score(texts, "body", d.lexicon_scorer()).first()
    assert lexicon.pos + lexicon.neg + lexicon.neu == pytest.approx(1.0)
    assert [r.id for r in d.unscored(texts, scores, "id", "at", limit=2).collect()] == [5, 4]


def test_word_lists_are_lower_case():
    words = [*lx.POSITIVE_WORDS, *lx.NEGATIVE_WORDS, *lx.GUIDANCE_KEYWORDS, *lx.BOILERPLATE, *[w for ws in lx.TOPICS.values() for w in ws]]
    assert all(w == w.lower() for w in words)


# --- valuation -----------------------------------------------------------------------------------


def valued(spark, rate, growth, flows, debt=0.0, cash=0.0, shares=10.0):
    df = spark.createDataFrame([(rate, growth, flows, debt, cash, shares)], "wacc double, terminal_growth double, flows array<double>, total_debt double, cash double, shares double")
    return v.dcf(df).first()


def test_dcf_known_case(spark):
    row = valued(spark, 0.10, 0.025, [100e6] * 8, 1e6, 2e6, 1e6)
    pv = sum(100e6 / 1.1**i for i in range(1, 9))
    tv = 100e6 * 1.025 / 0.075 / 1.1**8
    assert row.implied_price == pytest.approx((pv + tv + 1e6) / 1e6) and row.pv_terminal > row.pv_flows and row.dcf_error is None


def test_dcf_rejects_bad_inputs(spark):
    assert valued(spark, 0.02, 0.025, [1.0]).dcf_error.startswith("wacc") and valued(spark, 0.02, 0.025, [1.0]).implied_price is None
    assert valued(spark, 0.1, 0.02, [1.0], shares=0.0).dcf_error.startswith("shares")


def test_wacc_without_debt_and_without_value(spark):
    df = spark.createDataFrame([("a", 1.2, 100.0, 0.0, None, 0.2), ("b", 1.0, 100.0, 100.0, None, 0.2), ("c", 1.0, 0.0, 1.0, 1.0, 0.2)], "ticker string, beta double, market_cap double, total_debt double, interest_expense double, tax_rate double")
    got = {r.ticker: r for r in v.wacc(df).collect()}
    assert got["a"].wacc == pytest.approx(0.04 + 1.2 * 0.045)
    assert got["b"].wacc == pytest.approx(0.5 * 0.085 + 0.5 * 0.035 * 0.8) and got["b"].interest_source == "estimated"
    assert got["c"].wacc is None and got["c"].error


def test_growth_path_ends_on_terminal(spark):
    path = spark.range(1).select(v.growth_path(F.lit(0.2), F.lit(0.02)).alias("g")).first().g
    assert path[:3] == [0.2] * 3 and path[-1] == pytest.approx(0.02) and path[3] == pytest.approx(0.2 - 0.18 / 5)


def test_projection_and_overrides(spark):
    base = spark.createDataFrame([("t", 100.0, 0.1, 0.02, 0.4, 0.5, 0.1, 0.05, 0.04, 0.2, 0.1)], "ticker string, base_revenue double, latest_growth double, terminal_growth double, margin_start double, margin_target double, sga_pct double, da_pct double, capex_pct double, tax_rate double, nwc_pct double")
    first = v.projection_rows(v.project(v.with_paths(base)), "ticker").orderBy("year").first()
    ebit = 110 * (0.4 - 0.1 - 0.05)
    assert first.revenue == pytest.approx(110) and first.ufcf == pytest.approx(ebit * 0.8 + 5.5 - 4.4 - 1.0)
    out = v.overridden(base, [{"scenario": "x", "first_growth": 0.3, "flat_margin": 0.6}]).first()
    assert out.growths[0] == pytest.approx(0.3) and out.growths[-1] == pytest.approx(0.02) and set(out.margins) == {0.6}


def test_identity_checks_treat_zero_as_missing(spark):
    cols = "ticker string, fiscal_year int, total_revenue double, cost_of_revenue double, gross_profit double, ebitda double, depreciation_and_amortization double, ebit double"
    df = spark.createDataFrame([("a", 1, 1000.0, 400.0, 700.0, 0.0, 0.0, 0.0), ("b", 1, 1000.0, 400.0, 605.0, 300.0, -50.0, 200.0), ("c", 1, -5.0, 0.0, 1.0, 1.0, 1.0, 0.0)], cols)
    assert sorted((r.ticker, r.rule) for r in v.identity_checks(df).collect()) == [("a", "gross_profit"), ("b", "ebit"), ("c", "negative_revenue")]


def test_facts_priority_amendment_and_reconcile(spark):
    def e(fy, val, filed, form="10-K", fp="FY"):
        return {"fy": fy, "fp": fp, "form": form, "filed": filed, "val": val}

    body = {"Revenues": {"units": {"USD": []}}, "SalesRevenueNet": {"units": {"USD": [e(2020, 100.0, "2021-02"), e(2020, 110.0, "2021-06"), e(2021, 0.0, "2022-02"), e(2021, 5.0, "2022-03", "10-Q", "Q1")]}}}
    raw = spark.createDataFrame([("t", json.dumps(body))], "ticker string, j string").select("ticker", F.from_json("j", v.FACTS_SCHEMA).alias("facts"))
    best = v.by_concept_priority(v.latest_filed(v.annual_facts(raw)))
    assert {r.fiscal_year: r.val for r in best.collect()} == {2020: 110.0, 2021: 0.0}
    b = spark.createDataFrame([("t", "Total Revenue", 2020, 112.0), ("t", "Total Revenue", 2021, 3.0)], "ticker string, item string, fiscal_year int, value double")
    out = {(r.field, r.fiscal_year): (r.status, r.pct_diff) for r in v.reconcile(best.drop("concept"), b, raw.select("ticker")).collect()}
    assert out[("Revenues", 2020)][0] == "MATCH" and out[("Revenues", 2021)] == ("MISMATCH", float("inf")) and out[("Cash", None)][0] == "A_MISSING"


def test_keywords_are_counted_in_one_pass(spark):
    import random

    from tallyloom.functions.keywords import keyword_counts

    rng = random.Random(3)
    lists = (("aa", "ab", "aab", "é"), ("a", "aa", "xyz"), (), ("b b",))
    texts = ["", "aaaa", "aabab", "é aé", "b b b b", None, *["".join(rng.choices("aab xé", k=rng.randrange(60))) for _ in range(200)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.c for r in df.select("id", keyword_counts("t", *lists).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else [sum(t.count(w) for w in dict.fromkeys(words)) for words in lists])
