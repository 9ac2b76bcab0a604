"""Queries on pages, documents and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words
from ..operators import texts as X
from ..sources import tables as T
from .registry import TRIALS, query

MD = """md AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\\r', '', 'g'),
  '(?is)<(title|h1)[^>]*>(.*?)</(title|h1)>', chr(10) || '# \\2' || chr(10), 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g'),
  '(?i)<(p|br)[^>]*>', chr(10) || chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS text FROM pages)"""
SEC = f"""WITH {MD}, pc AS (SELECT page_id, unnest(p) AS piece, unnest(range(len(p))) AS section FROM (SELECT page_id,
    list_filter(string_split(regexp_replace(text, '(?m)^(#{{1,6}}[ \\t])', chr(1) || '\\1', 'g'), chr(1)), lambda x, i: i > 1 OR x <> '') AS p FROM md)),
sec AS (SELECT page_id, section, length(regexp_extract(piece, '\\A(#{{1,6}})[ \\t]', 1)) AS level,
    trim(regexp_extract(piece, '\\A#{{1,6}}[ \\t]+([^\\n]*)', 1)) AS title, regexp_replace(piece, '\\A#{{1,6}}[ \\t]+[^\\n]*\\n?', '') AS body
  FROM pc WHERE regexp_matches(piece, '\\A#{{1,6}}[ \\t]'))"""
LINES = f"""{SEC}, ln AS (SELECT page_id, section, title, unnest(l) AS raw, unnest(range(len(l))) AS line FROM (SELECT *, string_split(body, chr(10)) AS l FROM sec)),
lt AS (SELECT page_id, section, title, line, regexp_replace(raw, '\\A\\s+|\\s+\\z', '', 'g') AS text FROM ln)"""


def page_sections(spark, folder):
    pages = T.table(spark, folder, "pages").select("page_id", X.page_markdown(F.col("html")).alias("text"))
    return X.sections(pages, "page_id")


@query("page_sections", f"{SEC} SELECT page_id, section, level, title, md5(body) AS body_md5, length(body) AS n_chars FROM sec")
def page_sections_query(spark, folder):
    s = page_sections(spark, folder)
    return s.select("page_id", "section", "level", "title", F.md5(F.encode("body", "UTF-8")).alias("body_md5"), F.length("body").cast("long").alias("n_chars"))


@query("topic_lines", f"{LINES} SELECT page_id, section, line, text FROM lt WHERE contains(lower(text), 'the')")
def topic_lines(spark, folder):
    return X.find_lines(page_sections(spark, folder), "page_id", "The").select("page_id", "section", "line", "text")


@query("section_by_title", f"""{SEC} SELECT page_id, section, level, title, md5(regexp_replace(body, '\\A\\s+|\\s+\\z', '', 'g')) AS text_md5 FROM sec
WHERE contains(lower(title), 'the') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY section) = 1""")
def section_by_title(spark, folder):
    s = X.find_section(page_sections(spark, folder), "page_id", "THE")
    return s.select("page_id", "section", "level", "title", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("section_bullets", f"""{LINES} SELECT page_id, section, line, text FROM lt WHERE (contains(lower(title), 'the') OR contains(lower(title), 'de'))
  AND (starts_with(text, '-') OR starts_with(text, '*') OR starts_with(text, '1.') OR starts_with(text, '2.') OR starts_with(text, '3.'))""")
def section_bullets(spark, folder):
    return X.bullet_lines(page_sections(spark, folder), "page_id", ("the", "de")).select("page_id", "section", "line", "text")


@query("section_titles", f"{SEC} SELECT page_id, section, title FROM sec")
def section_titles(spark, folder):
    return page_sections(spark, folder).select("page_id", "section", "title")


def page_paths(spark, folder):
    pages = T.table(spark, folder, "pages").select("page_id", X.page_markdown(F.col("html"), "##").alias("text"))
    return X.section_paths(pages, "page_id")


TRIMMED = "regexp_replace(body, '\\A\\s+|\\s+\\z', '', 'g')"
PATHS = f"""{SEC.replace("'# \\2'", "'## \\2'")}, al AS (SELECT page_id, section, level, title, body FROM sec WHERE level IN (2, 3) UNION ALL
  SELECT page_id, section, 0, '(preamble)', piece FROM pc WHERE NOT regexp_matches(piece, '\\A#{{1,6}}[ \\t]')),
pt AS (SELECT page_id, section, title, {TRIMMED} AS body FROM al WHERE {TRIMMED} <> '')"""
CHUNK = 2000


def chunk_sql() -> str:
    """The packing rule as a recursion over the pieces of a page."""
    opens = f"CASE WHEN it.big THEN it.k = 0 OR rec.chars + it.len > {CHUNK} ELSE rec.big OR rec.chars + it.len > {CHUNK} END"
    shown = "string_agg(CASE WHEN it.big THEN t ELSE '### ' || title || chr(10) || chr(10) || t END, chr(10) || chr(10) ORDER BY it.i)"
    return f"""{PATHS.replace("WITH ", "WITH RECURSIVE ", 1)},
pp AS (SELECT *, length(body) > {CHUNK} AS big FROM pt),
pk AS (SELECT page_id, section, title, big, unnest(p) AS t, unnest(range(len(p))) AS k FROM (SELECT *, CASE WHEN big THEN string_split(body, chr(10) || chr(10)) ELSE [body] END AS p FROM pp)),
it AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY section, k) AS i, length(t) AS len, CASE WHEN big THEN length(t) + 2 ELSE length(t) + length(title) + 8 END AS more FROM pk),
rec AS (SELECT page_id, i, 1 AS no, more AS chars, big FROM it WHERE i = 1 UNION ALL
  SELECT it.page_id, it.i, rec.no + CASE WHEN {opens} THEN 1 ELSE 0 END,
    CASE WHEN NOT ({opens}) THEN rec.chars + it.more WHEN it.big AND it.k > 0 THEN it.len ELSE it.more END, it.big
  FROM rec JOIN it ON it.page_id = rec.page_id AND it.i = rec.i + 1)
SELECT page_id, no::BIGINT AS chunk, arg_min([title], it.i) AS path, md5({shown}) AS body_md5,
  (CASE WHEN bool_or(it.big) THEN arg_max(chars, it.i) ELSE length({shown}) END // {CHUNK_TOKEN})::BIGINT AS token_estimate
FROM rec JOIN it USING (page_id, i) GROUP BY page_id, no"""


CHUNK_TOKEN = X.CHARS_PER_TOKEN


@query("section_paths", f"{PATHS} SELECT page_id, section, [title] AS path, md5(body) AS body_md5 FROM pt")
def section_paths(spark, folder):
    p = page_paths(spark, folder)
    return p.select("page_id", "section", "path", F.md5(F.encode("body", "UTF-8")).alias("body_md5"))


@query("page_chunks", chunk_sql())
def page_chunks(spark, folder):
    """Page sections packed into chunks of at most 2000 characters."""
    c = X.pack_chunks(page_paths(spark, folder), "page_id", CHUNK)
    return c.select("page_id", "chunk", "path", F.md5(F.encode("body", "UTF-8")).alias("body_md5"), "token_estimate")


@query("document_slugs", """SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), 60), ''), 'strategy') AS slug FROM documents""")
def document_slugs(spark, folder):
    return T.table(spark, folder, "documents").select("doc_id", words.slug(F.col("text")).alias("slug"))


def described(spark, folder):
    p = T.table(spark, folder, "part")
    phrase = F.lit("plain trade of")
    for i, text in enumerate(("Breakout above swing high", "EMA 9/21 set up", "RSI oversold fade", "hedge ratio of a pair trading book", "random forest classifier", "MA crossing", "Donchian channel")):
        phrase = F.when(F.col("p_size") % 9 == i, F.lit(text)).otherwise(phrase)
    return p.select("p_partkey", F.concat_ws(" ", phrase, F.col("p_name")).alias("text"), "p_size", "p_name")


@query("strategy_family", """SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'trend_following' WHEN 1 THEN 'ema_crossover' WHEN 3 THEN 'pairs_trading' WHEN 5 THEN 'ema_crossover'
  WHEN 6 THEN 'trend_following' ELSE 'mean_reversion' END AS family FROM part""")
def strategy_family(spark, folder):
    return described(spark, folder).select("p_partkey", words.classify_strategy(F.col("text")).alias("family"))


@query("parameter_aliases", """SELECT p_partkey, CASE WHEN p_size >= 30 THEN 9.0 ELSE p_size END::DOUBLE AS ema_fast, CASE WHEN p_size >= 30 THEN 21.0 ELSE 30.0 END::DOUBLE AS ema_slow,
  1.5::DOUBLE AS atr_sl_multiplier, CASE WHEN p_size < 50 AND p_size > 0 THEN p_size ELSE 30.0 END::DOUBLE AS rsi_oversold, 70.0::DOUBLE AS rsi_overbought,
  2.5::DOUBLE AS tp_r_multiple, 10.0::DOUBLE AS reversal_lookback, 'standard' AS mode, p_size / 10.0::DOUBLE AS entry_zscore, 60.0::DOUBLE AS hedge_window, 'GBPUSD' AS symbol2, ['atr_sl_multiplier'] AS rejected FROM part""")
def parameter_aliases(spark, folder):
    p = T.table(spark, folder, "part")
    size = F.col("p_size").cast("string")
    named = F.create_map(F.lit("Fast-Period"), size, F.lit("slow ma"), F.lit("30"), F.lit("stop atr"), F.lit("abc"), F.lit("Oversold"), F.concat(size, F.lit("%")),
                         F.lit("overbought"), F.lit("120"), F.lit("RR"), F.lit(" 2.5 "), F.lit("z-score"), (F.col("p_size") / 10.0).cast("string"))
    kinds = {"e": "ema_crossover", "m": "mean_reversion", "t": "trend_following", "q": "pairs_trading"}
    known = p.select("p_partkey", words.normal_keys(named).alias("known"))
    x = known.select("p_partkey", *[words.strategy_params(kind, F.col("known"), True).alias(n) for n, kind in kinds.items()])
    return x.select("p_partkey", "e.ema_fast", "e.ema_slow", "e.atr_sl_multiplier", "m.rsi_oversold", "m.rsi_overbought", "t.tp_r_multiple", "t.reversal_lookback", "t.mode",
                    "q.entry_zscore", "q.hedge_window", "q.symbol2", "e.rejected")


@query("metric_lines", f"""WITH {TRIALS} SELECT sr_id, round(sharpe, 4) AS sharpe, guard = 'PASS' AS guard_pass, CASE WHEN sr_id % 5 = 0 THEN 0.0 ELSE round(win_rate, 1) END::DOUBLE AS win_rate,
  round(max_dd, 2) AS max_dd, 5000 + sr_id AS bars, trades FROM trials""")
def metric_lines(spark, folder):
    t = T.trials(spark, folder)
    wr = F.when(F.col("sr_id") % 5 != 0, F.format_string(" win_rate=%.1f%%", "win_rate")).otherwise(F.lit(""))
    line = F.concat(F.format_string("SHARPE %.4f\nGUARD %s drawdown=%.2f%%", "sharpe", "guard", "max_dd"), wr, F.format_string(" bars=%d trades=%d\n", F.lit(5000) + F.col("sr_id"), "trades"))
    return t.select("sr_id", words.engine_line(line).alias("m")).select("sr_id", "m.*")


@query("fenced_json", """SELECT p_partkey, p_name AS name, p_size::BIGINT AS n_rules FROM part""")
def fenced_json(spark, folder):
    p = T.table(spark, folder, "part")
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.array_repeat(F.lit("rule"), F.col("p_size")).alias("entry_rules")))
    fence = "`" * 3
    text = F.concat(F.lit(f"  {fence}json\n"), body, F.lit(f"\n{fence}\n"))
    parsed = F.from_json(words.strip_fence(text), "name string, entry_rules array<string>")
    return p.select("p_partkey", parsed.alias("j")).select("p_partkey", "j.name", F.size("j.entry_rules").cast("long").alias("n_rules"))
