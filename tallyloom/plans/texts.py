"""Document, page and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import lexicons as lx
from tallyloom.functions.text import valid_ticker
from tallyloom.operators import documents as d
from tallyloom.operators.layout import spread
from tallyloom.plans.registry import query
from tallyloom.sources.tables import Tables

# Stems of the invented prose, so that tone and topics have hits there.
UPS, DOWNS = ("tion", "eau", "ung"), ("ment", "ent", "sch")
PROSE_TOPICS = {"articles": ("the", "der", "les"), "endings": ("tion", "ment"), "rare": ("zzz", "qqq"), "joins": ("and", "und", " et ")}


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _count_sql(words, col: str = "low") -> str:
    return "(" + " + ".join(f"(length({col}) - length(replace({col}, '{w}', ''))) // {len(w)}" for w in words) + ")"


def _contains_sql(words, col: str = "low") -> str:
    quoted = ["'" + w.replace("'", "''") + "'" for w in words]
    return "(" + " OR ".join(f"contains({col}, {q})" for q in quoted) + ")"


def _word_sql(words, col: str = "txt") -> str:
    body = "|".join(w.replace(r"\w", r"[\p{L}\p{N}_]") for w in words)
    return f"regexp_matches({col}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({body})($|[^\\p{{L}}\\p{{N}}_])')"


# A phrase per source in front of each text, so that every flag of the analysis has hits.
PHRASES = {
    "src0": "We expect revenue growth to continue to exceed $1.2 million next year",
    "src1": "Operating income increased 3.5 % compared to the prior period on strong demand",
    "src2": "SAFE HARBOR",
    "src3": "A material decline in customer orders may significantly impair liquidity and cash flow",
    "src4": "The increase was driven by pricing; we anticipate further tariff and inflation pressure",
    "src5": "Actual results may differ from forward-looking statements",
    "src6": "Our strategy and product pipeline remain on track for an improved outlook",
    "src7": "Sales grew year over year despite foreign exchange headwinds and supply chain risk",
}
PHRASE_CASE = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}. ' || chr(10) || chr(10)" for k, v in PHRASES.items()) + " ELSE '' END"
DX_SQL = f"dx AS (SELECT doc_id, {PHRASE_CASE} || text AS text FROM documents)"


def worded(t: Tables) -> DataFrame:
    """Documents with their source's phrase as a first paragraph."""
    phrase = F.coalesce(*[F.when(F.col("source") == k, F.lit(v + ". \n\n")) for k, v in PHRASES.items()], F.lit(""))
    return t.documents.select("doc_id", F.concat(phrase, "text").alias("text"))


HEAD = "(length({0}) < 120 AND (NOT suffix({0}, '.') OR {0} = upper({0})))"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
LINE = STRIP.format("l")
PARA_SQL = f"""{DX_SQL},
chunks AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda c: {STRIP.format("c")}), lambda c: c <> '') AS cs FROM dx),
parts AS (SELECT doc_id, CASE WHEN len(cs) = 1 AND length(cs[1]) > 2000 THEN list_transform(string_split(array_to_string(list_transform(string_split(cs[1], chr(10)),
    lambda l, i: CASE WHEN i > 1 AND {LINE} <> '' AND {HEAD.format(LINE)} THEN chr(1) || {LINE} ELSE {LINE} END), chr(10)), chr(10) || chr(1)), lambda b: {STRIP.format("b")})
  ELSE cs END AS ps FROM chunks WHERE len(cs) > 0),
paras AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS txt FROM parts),
pa AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, txt, lower(txt) AS low, {HEAD.format("txt")} AND txt <> '' AS is_heading FROM paras)"""
TOPIC_LIST = ", ".join(f"CASE WHEN {_contains_sql(w)} THEN '{k}' END" for k, w in lx.TOPICS.items())
AN_SQL = f"""{PARA_SQL},
fl AS (SELECT *, {_word_sql(lx.FORWARD)} AS fwd, {_word_sql(lx.HISTORICAL)} AS hist, regexp_matches(txt, '(?i)\\$\\s*[\\d,.]+\\s*(million|billion|thousand)?') AS has_dollar,
  regexp_matches(txt, '[\\d,.]+\\s*%') AS has_percent, {_word_sql(lx.MATERIAL)} AS is_material, {_word_sql(lx.SIGNIFICANT)} AS is_significant, {_word_sql(lx.CHANGE)} AS is_change,
  {_contains_sql(lx.BOILERPLATE)} AS is_boilerplate, list_filter([{TOPIC_LIST}], lambda x: x IS NOT NULL) AS topics, {_count_sql(UPS)} AS p, {_count_sql(DOWNS)} AS n FROM pa),
an AS (SELECT *, CASE WHEN fwd AND hist THEN 'mixed' WHEN fwd THEN 'forward_looking' WHEN hist THEN 'historical' ELSE 'neutral' END AS temporality,
  CASE WHEN p + n > 0 THEN p / (p + n) END AS tone,
  2 * fwd::INT + (has_dollar OR has_percent)::INT + is_material::INT + is_significant::INT + is_change::INT + (len(topics) >= 2)::INT - 3 * is_boilerplate::INT AS relevance FROM fl)"""


def paras(t: Tables) -> DataFrame:
    return d.paragraphs(worded(t))


def analyzed(t: Tables) -> DataFrame:
    return d.analyze(paras(t), positive=UPS, negative=DOWNS)


@query("txt_paragraphs", f"WITH {PARA_SQL} SELECT doc_id, pos, is_heading, length(txt) AS chars, md5(txt) AS digest FROM pa")
def txt_paragraphs(t: Tables) -> DataFrame:
    return paras(t).select("doc_id", "pos", "is_heading", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("txt_temporality", f"WITH {AN_SQL} SELECT temporality, count(*) AS paragraphs FROM an GROUP BY 1")
def txt_temporality(t: Tables) -> DataFrame:
    return d.lowered(paras(t)).groupBy(d.temporality().alias("temporality")).agg(F.count("*").alias("paragraphs"))


@query("txt_topics", f"WITH {AN_SQL} SELECT doc_id, pos, array_to_string(topics, ',') AS topics FROM an WHERE len(topics) > 0")
def txt_topics(t: Tables) -> DataFrame:
    found = analyzed(t).select("doc_id", "pos", "topics").filter(F.size("topics") > 0)
    return found.withColumn("topics", F.array_join("topics", ","))


@query("txt_amount_flags", f"WITH {AN_SQL} SELECT has_dollar, has_percent, is_material, is_significant, is_change, count(*) AS paragraphs FROM an GROUP BY 1, 2, 3, 4, 5")
def txt_amount_flags(t: Tables) -> DataFrame:
    flags = d.amount_flags()
    return d.lowered(paras(t)).select(*[c.alias(n) for n, c in flags.items()]).groupBy(*flags).agg(F.count("*").alias("paragraphs"))


@query("txt_boilerplate", f"WITH {AN_SQL} SELECT is_boilerplate, count(*) AS paragraphs FROM an GROUP BY 1")
def txt_boilerplate(t: Tables) -> DataFrame:
    return d.lowered(paras(t)).groupBy(d.is_boilerplate().alias("is_boilerplate")).agg(F.count("*").alias("paragraphs"))


@query("txt_relevance", f"WITH {AN_SQL} SELECT relevance, is_heading, count(*) AS paragraphs FROM an GROUP BY 1, 2")
def txt_relevance(t: Tables) -> DataFrame:
    return analyzed(t).groupBy("relevance", "is_heading").agg(F.count("*").alias("paragraphs"))


@query("txt_tone", f"""WITH {AN_SQL} SELECT doc_id, pos, p AS positive_count, n AS negative_count, round(tone, 8) AS tone,
  CASE WHEN tone > 0.6 THEN 'positive' WHEN tone < 0.4 THEN 'negative' ELSE 'neutral' END AS tone_label FROM an""")
def txt_tone(t: Tables) -> DataFrame:
    out = d.with_tone(paras(t), positive=UPS, negative=DOWNS)
    return out.select("doc_id", "pos", "positive_count", "negative_count", F.round("tone", 8).alias("tone"), "tone_label")


@query("txt_tone_default", f"WITH {PARA_SQL} SELECT doc_id, CAST(sum({_count_sql(lx.POSITIVE_WORDS)}) AS BIGINT) AS positive_count, CAST(sum({_count_sql(lx.NEGATIVE_WORDS)}) AS BIGINT) AS negative_count FROM pa GROUP BY 1")
def txt_tone_default(t: Tables) -> DataFrame:
    return d.document_tone(d.with_tone(paras(t))).select("doc_id", "positive_count", "negative_count")


@query("txt_guidance", f"WITH {PARA_SQL} SELECT doc_id, pos, md5(txt) AS digest FROM pa WHERE NOT is_heading AND length(txt) <= 2000 AND {_contains_sql(lx.GUIDANCE_KEYWORDS + ('tion of',))}")
def txt_guidance(t: Tables) -> DataFrame:
    found = d.guidance(paras(t), keywords=lx.GUIDANCE_KEYWORDS + ("tion of",))
    return found.select("doc_id", "pos", F.md5("text").alias("digest"))


@query("agg_doc_tone", f"WITH {AN_SQL} SELECT doc_id, CAST(sum(p) AS BIGINT) AS positive_count, CAST(sum(n) AS BIGINT) AS negative_count, round(sum(p) / nullif(sum(p) + sum(n), 0), 8) AS tone FROM an GROUP BY 1")
def agg_doc_tone(t: Tables) -> DataFrame:
    out = d.document_tone(d.with_tone(paras(t), positive=UPS, negative=DOWNS))
    return out.withColumn("tone", F.round("tone", 8))


@query("agg_topic_summary", f"WITH {AN_SQL}, tx AS (SELECT unnest(topics) AS topic, tone FROM an) SELECT topic, count(*) AS paragraphs, round(avg(tone), 6) AS avg_tone FROM tx GROUP BY 1")
def agg_topic_summary(t: Tables) -> DataFrame:
    return d.topic_summary(analyzed(t)).withColumn("avg_tone", F.round("avg_tone", 6))


@query("topk_paragraphs", f"""WITH {AN_SQL} SELECT doc_id, pos, relevance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, pos) AS rank FROM an WHERE NOT is_heading) x WHERE rank <= 5""")
def topk_paragraphs(t: Tables) -> DataFrame:
    return d.relevant_paragraphs(analyzed(t)).select("doc_id", "pos", "relevance", "rank")


WORD_UNION = " UNION ALL ".join(f"SELECT '{w}' AS word, CAST(sum((length(low) - length(replace(low, '{w}', ''))) // {len(w)}) AS BIGINT) AS n FROM (SELECT lower(text) AS low FROM documents) x" for w in UPS + DOWNS)


@query("topk_words", f"SELECT word, n FROM ({WORD_UNION}) w WHERE n > 0 ORDER BY n DESC, word LIMIT 5")
def topk_words(t: Tables) -> DataFrame:
    return d.top_words(t.documents, UPS + DOWNS, n=5)


BLOCKS = "|".join(lx.BLOCK_TAGS)


@query("txt_html_to_text", f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!doctype[^>]*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<({BLOCKS})\\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS h FROM a),
c AS (SELECT page_id, list_transform(string_split(h, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(160))) AS ls FROM b),
e AS (SELECT page_id, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\\n{{2,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM c),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM e)
SELECT page_id, length(x) AS chars, md5(x) AS digest FROM u""")
def txt_html_to_text(t: Tables) -> DataFrame:
    return spread(t.pages.select("page_id", "html"), "page_id").select("page_id", d.html_to_text("html").alias("x")).select("page_id", F.length("x").cast("bigint").alias("chars"), F.md5("x").alias("digest"))


SPECS = [
    {"section": "risk", "title": r"risk\s+factors", "item": "1a", "next_item": "7"},
    {"section": "mdna", "title": r"management.s\s+discussion", "item": "7", "next_item": "8"},
]
COVER = 300


def filing_texts(t: Tables) -> DataFrame:
    """Filing-shaped documents: contents, cover, and the document's text as two sections."""
    nl = F.lit("\n")
    contents = F.lit("Item 1. Business\nItem 1A. Risk Factors\nItem 7. Management's Discussion\nItem 8. Statements\n")
    cover = F.repeat(F.lit("Cover page. "), COVER)
    return t.documents.select(
        "doc_id",
        F.concat(contents, cover, nl, F.lit("Item 1A. Risk Factors\n"), "text", nl, F.lit("Item 7. Management's Discussion\n"), "text", F.lit(" "), "text", nl, F.lit("Item 8. Statements\nend")).alias("text"),
    )


@query("txt_sections", """WITH x AS (SELECT doc_id, text, 'Item 1A. Risk Factors' || chr(10) || text || chr(10) AS a,
  'Item 7. Management''s Discussion' || chr(10) || text || ' ' || text || chr(10) AS b FROM documents)
SELECT doc_id, 'risk' AS section, length(a) AS chars, md5(a) AS digest FROM x WHERE length(a) - 8 >= 500
UNION ALL SELECT doc_id, 'mdna', length(b), md5(b) FROM x WHERE length(b) - 7 >= 500""")
def txt_sections(t: Tables) -> DataFrame:
    out = d.sections(filing_texts(t), SPECS, min_length=500)
    return out.select("doc_id", "section", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("win_toc_cluster", "SELECT doc_id, CAST(length('Item 1. Business') + length('Item 1A. Risk Factors') + length('Item 7. Management''s Discussion') + 3 + length('Item 8') AS INTEGER) AS body FROM documents")
def win_toc_cluster(t: Tables) -> DataFrame:
    return d.body_start(d.anchors(filing_texts(t), SPECS))


@query("join_range_sections", """SELECT 'risk' AS section, count(*) AS found FROM documents WHERE length(text) + 23 - 8 >= 500
UNION ALL SELECT 'mdna', count(*) FROM documents WHERE 2 * length(text) + 34 - 7 >= 500""")
def join_range_sections(t: Tables) -> DataFrame:
    return d.sections(filing_texts(t), SPECS, min_length=500).groupBy("section").agg(F.count("*").alias("found"))


@query("win_latest_filing", """SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) x WHERE rn = 1""")
def win_latest_filing(t: Tables) -> DataFrame:
    """Newest document per company and kind; length stands in for the filing date."""
    return d.latest_document(t.documents.drop("text"), "source", "lang", "n_chars", "doc_id").select("source", "lang", "doc_id")


@query("ticker_cashtag", """WITH p AS (SELECT doc_id, text || ' $' || upper(lang) || ', $' || upper(lang) || '9 $ABCDEF $X' AS text FROM documents)
SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\$([A-Z]{1,5})($|[^\\p{L}\\p{N}_])', 1))) AS symbol FROM p""")
def ticker_cashtag(t: Tables) -> DataFrame:
    tag = F.concat(F.lit(" $"), F.upper("lang"), F.lit(", $"), F.upper("lang"), F.lit("9 $ABCDEF $X"))
    posts = t.documents.select("doc_id", F.concat("text", tag).alias("text"))
    return posts.select("doc_id", F.explode(d.cashtags("text")).alias("symbol"))


NAME_LIST = ", ".join("CASE WHEN contains(low, '" + c.replace("'", "''") + f"') THEN '{s}' END" for c, s in lx.COMPANY_TICKERS.items())


@query("ticker_mentions", f"""WITH tk AS (SELECT doc_id, lower(text) AS low, list_filter(list_distinct(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')),
    lambda w: regexp_full_match(w, '[A-Z]{{1,5}}') AND NOT list_contains({_sql_list(lx.TICKER_STOP_WORDS)}, w)) AS found FROM documents),
al AS (SELECT doc_id, list_distinct(list_concat(found, list_filter([{NAME_LIST}], lambda x: x IS NOT NULL))) AS ts FROM tk)
SELECT doc_id, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS ticker FROM al""")
def ticker_mentions(t: Tables) -> DataFrame:
    return d.ticker_mentions(t.documents.select("doc_id", "text")).select("doc_id", "ticker")


@query("validate_ticker", """SELECT CASE WHEN regexp_full_match(upper(trim(p_type)), '[A-Z]{1,10}') THEN upper(trim(p_type)) END AS a,
  CASE WHEN regexp_full_match(upper(trim(p_brand)), '[A-Z]{1,10}') THEN 1 END AS b, count(*) AS n FROM part GROUP BY 1, 2""")
def validate_ticker(t: Tables) -> DataFrame:
    return t.part.groupBy(valid_ticker(F.lower("p_type")).alias("a"), F.when(valid_ticker("p_brand").isNotNull(), 1).alias("b")).agg(F.count("*").alias("n"))


@query("text_min_len", """SELECT conv_id, turn, length(trim(role || ' ' || text)) AS chars FROM conversations WHERE length(trim(role || ' ' || text)) >= 40""")
def text_min_len(t: Tables) -> DataFrame:
    return d.long_enough(t.conversations, "role", "text", 40).select("conv_id", "turn", F.length("text").cast("bigint").alias("chars"))


SCORED_SQL = f"""sx AS (SELECT doc_id, lang, {_count_sql(UPS)} AS p, {_count_sql(DOWNS)} AS n FROM (SELECT *, lower(text) AS low FROM documents) z)"""


@query("txt_sentiment_model", f"WITH {SCORED_SQL} SELECT doc_id, round(p / (p + n + 1), 8) AS pos, round(n / (p + n + 1), 8) AS neg, round(1 / (p + n + 1), 8) AS neu FROM sx")
def txt_sentiment_model(t: Tables) -> DataFrame:
    out = d.score(t.documents.select("doc_id", "text"), "text", d.lexicon_scorer(UPS, DOWNS))
    return out.select("doc_id", *[F.round(c, 8).alias(c) for c in ("pos", "neg", "neu")])


@query("txt_score_incremental", f"""WITH {SCORED_SQL} SELECT doc_id, lang AS ticker, round((p - n) / (p + n + 1), 8) AS composite, 'lexicon-1' AS model_version
FROM sx WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'fr'""")
def txt_score_incremental(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", "text", "n_chars", F.when(F.col("lang") != "fr", F.col("lang")).alias("ticker"))
    out = d.score_incremental(texts, t.labels, "doc_id", "text", "n_chars", "ticker", d.lexicon_scorer(UPS, DOWNS))
    return out.select("doc_id", "ticker", F.round("composite", 8).alias("composite"), "model_version")


@query("join_anti_unscored", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 25")
def join_anti_unscored(t: Tables) -> DataFrame:
    return d.unscored(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id", "n_chars", limit=25)
