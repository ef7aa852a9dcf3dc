"""Queries of HTML cleaning and of string, number and date functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _WINDOWS, query, rounded
from .functions import html, sql, strings, values, vectors, windows
from .operators import joins
from .session import table

_NATIONS = "x AS (SELECT r_name, n_name, n_nationkey, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _cells(*cells):
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c if not isinstance(c, str) else F.lit(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _pages(spark, d, head, row, before):
    """One page per region: something before, a table of its nations, something after."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = n.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    page = F.concat(before, F.lit("<table>"), head, F.col("rows"), F.lit("</table><p>The&nbsp;end.</p>"))
    return lines.select("r_name", page.alias("page"))


@query(f"""WITH {_NATIONS} SELECT r_name, 'Scores of ' || r_name || ' [TABLE] Scores of ' || r_name || ': ' || string_agg(n_name || ' | NPS: ' || n_nationkey, ' ; ' ORDER BY n_nationkey) || ' [/TABLE]. The end.' AS text FROM x GROUP BY r_name""")
def html_column_hits(spark, d):
    """Tables whose column name alone mentions a phrase: that column of every row, under the heading before the table."""
    pages = _pages(spark, d, _cells("Nation", "NPS", "Region"), _cells(F.col("n_name"), F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")), F.concat(F.lit("<h2>Scores of "), F.col("r_name"), F.lit("</h2>")))
    return pages.select("r_name", html.clean_html("page", ["nps"]).alias("text"))


@query(f"""WITH {_NATIONS} SELECT r_name, '[TABLE] Figures of ' || r_name || ': ' || string_agg('Nations — Measure: NPS of ' || n_name || ' | Target: ' || n_nationkey || ' | Result: ' || (n_nationkey + 1), ' ; ' ORDER BY n_nationkey) || ' [/TABLE]. The end.' AS text FROM x GROUP BY r_name""")
def html_row_hits(spark, d):
    """Tables whose rows mention a phrase: those rows with the names of their columns, under their section and title row."""
    head = F.concat(_cells(F.concat(F.lit("Figures of "), F.col("r_name"), F.lit(":"))), _cells("Measure", "Target", "Result 2"), _cells("Nations:"))
    pages = _pages(spark, d, head, F.concat(_cells(F.concat(F.lit("NPS of "), F.col("n_name"), F.lit(" 4")), F.col("n_nationkey").cast("string"), (F.col("n_nationkey") + 1).cast("string")), _cells("Sales", "1", "2")), F.lit(""))
    return pages.select("r_name", html.clean_html("page", ["nps"]).alias("text"))


@query(f"""WITH {_NATIONS} SELECT r_name, string_agg('• The nation of ' || n_name || ' is one of those that this page lists, and its NPS is told nowhere in it.', ' ' ORDER BY n_nationkey) || ' The end.' AS text FROM x GROUP BY r_name""")
def html_layout_tables(spark, d):
    """Tables that only lay out sentences stay prose."""
    said = F.concat(F.lit("The nation of "), F.col("n_name"), F.lit(" is one of those that this page lists, and its NPS is told nowhere in it."))
    return _pages(spark, d, F.lit(""), _cells("•", said), F.lit("")).select("r_name", html.clean_html("page", ["nps"]).alias("text"))


@query(f"""WITH {_NATIONS} SELECT r_name, 'Nation Key ' || string_agg(CASE WHEN n_nationkey % 2 = 0 THEN 'NPS Pharmaceuticals of ' ELSE '' END || n_name || ' ' || n_nationkey, ' ' ORDER BY n_nationkey) || ' The end.' AS text FROM x GROUP BY r_name""")
def html_masked_phrases(spark, d):
    """Phrases that only stand in excluded ones don't count, so the tables stay as they are."""
    row = _cells(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "NPS Pharmaceuticals of ").otherwise(""), F.col("n_name")), F.col("n_nationkey").cast("string"))
    return _pages(spark, d, _cells("Nation", "Key"), row, F.lit("")).select("r_name", html.clean_html("page", ["nps"], ["nps pharmaceuticals"]).alias("text"))


@query(r"""SELECT record_id, regexp_replace(regexp_replace(translate(core_text || ' By: /s/ John A. Doe', chr(160) || chr(10) || chr(13), '   '), 'By:\s*/s/\s*[A-Za-z .-]+', '', 'gi'), '/s/\s*[A-Za-z .-]+', '', 'g') AS text FROM raw_records WHERE core_text IS NOT NULL""")
def signatures_removed(spark, d):
    r = table(spark, d, "raw_records").filter("core_text IS NOT NULL")
    return r.select("record_id", html.strip_signatures(html.plain_spaces(F.concat("core_text", F.lit(" By: /s/ John A. Doe")))).alias("text"))


@query("SELECT record_id, replace(replace(lower(core_text), 'score', '     '), 'net', '   ') AS text FROM raw_records WHERE core_text IS NOT NULL")
def masked_texts(spark, d):
    """Excluded phrases blanked out at equal length."""
    return table(spark, d, "raw_records").filter("core_text IS NOT NULL").select("record_id", html.mask_phrases(F.lower("core_text"), ["score", "", "net"]).alias("text"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'rest' WHEN c_custkey % 3 = 1 THEN 'keep' ELSE c_name || ' [TABLE] b [/TABLE] c' END AS text FROM customer""")
def cut_tables(spark, d):
    """Tables of which a cut took one marker are left out."""
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat("c_name", F.lit(" [/TABLE] rest"))).when(k == 1, F.concat(F.lit("keep [TABLE] a: "), F.col("c_name"))).otherwise(F.concat("c_name", F.lit(" [TABLE] b [/TABLE] c")))
    return table(spark, d, "customer").select("c_custkey", windows.whole_tables(text).alias("text"))


@query("""SELECT c_custkey, 'a [TABLE] nps: ' || repeat('1 | ', 150 + CAST(c_custkey % 7 AS INT)) || '[/TABLE]' || left(repeat(' tail', 200), greatest(0, 600 - length(': ' || repeat('1 | ', 150 + CAST(c_custkey % 7 AS INT)) || '[/TABLE]'))) AS context FROM customer""")
def table_windows(spark, d):
    """A window whose phrase stands in a table reaches to the table's end, beyond the ordinary cap."""
    text = F.concat(F.lit("a [TABLE] nps: "), F.repeat(F.lit("1 | "), (150 + F.col("c_custkey") % 7).cast("int")), F.lit("[/TABLE]"), F.repeat(F.lit(" tail"), F.lit(200)))
    c = table(spark, d, "customer").select("c_custkey", text.alias("t"))
    return windows.context_windows(c, "c_custkey", "t", windows.WindowRule(("nps",))).select("c_custkey", "context")


@query(r"""SELECT c_custkey, left(coalesce(nullif(trim(regexp_replace(translate(c_name || ':  ' || c_mktsegment || '/x', ':*?"<>|/\', '_________'), '\s+', ' ', 'g')), ''), 'unnamed'), 20) AS base_name, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS bare,
  'V' || c_nationkey || ': ' || upper(left(c_mktsegment, 1)) || substr(c_mktsegment, 2) || ' x' AS reference, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS padded, 'name=' || url_encode(c_name) || '&key=' || c_custkey AS query,
  c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (A, B)' ELSE '' END || ' (CIK ' || c_custkey || ')' AS entity FROM customer""")
def name_strings(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey").cast("string")
    return c.select(
        "c_custkey", strings.base_name(F.concat("c_name", F.lit(":  "), "c_mktsegment", F.lit("/x")), 20).alias("base_name"), strings.without_prefix("c_name", ["Nobody", "Customer#", "Cust"]).alias("bare"),
        strings.reference_label(F.concat(F.lit("V"), F.col("c_nationkey").cast("string"), F.lit("_"), "c_mktsegment", F.lit("_x"))).alias("reference"), strings.padded_key("c_custkey").alias("padded"),
        strings.query_string([("name", "c_name"), ("none", F.lit(None).cast("string")), ("empty", F.lit("")), ("key", k)]).alias("query"),
        strings.entity_name("c_name", F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")), k).alias("entity"),
    )


@query("""SELECT o_orderkey, CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' h' AS duration, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' AS words,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderpriority || ' (' || printf('%.1f', CAST(o_orderkey AS DOUBLE)) || ' ms/ctx)' END AS label, 'status: ' || o_orderstatus || '  |  key: ' || o_orderkey AS summary, 'C:/' || o_orderkey || '/x' AS path, 'a|' || o_orderkey || '|b' AS parts
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) % 90000 AS s FROM orders)""")
def report_strings(spark, d):
    o = table(spark, d, "orders")
    s, k = F.floor("o_totalprice").cast("long") % 90_000, F.col("o_orderkey").cast("string")
    return o.select(
        "o_orderkey", strings.duration(s).alias("duration"), strings.duration_words(s).alias("words"), strings.timed_label("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey"))).alias("label"),
        strings.summary_line([("status", "o_orderstatus"), ("none", F.lit(None).cast("string")), ("key", k)]).alias("summary"), strings.posix_path(F.concat(F.lit("C:\\"), k, F.lit("\\x"))).alias("path"),
        F.array_join(strings.comma_list(F.concat(F.lit(" a,, "), k, F.lit(" ,b ,"))), "|").alias("parts"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(day - INTERVAL 2 YEAR AS DATE) WHEN 1 THEN CAST(day - INTERVAL 10 DAY AS DATE) WHEN 2 THEN day WHEN 3 THEN DATE '2000-01-01' WHEN 4 THEN CAST(day - INTERVAL 1 YEAR AS DATE) ELSE DATE '2000-01-01' END AS start FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)""")
def date_macros(spark, d):
    """Range macros: years and days back, other units, and what is no macro."""
    macro = F.element_at(F.array(*map(F.lit, ["2y", "10d", "3w", "custom", "1Y", ""])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", strings.range_start(macro, F.col("o_orderdate").cast("date"), F.lit("2000-01-01")).alias("start"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 1.0::DOUBLE WHEN o_orderkey % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS truth, abs(o_totalprice - round(o_totalprice)) <= greatest(1e-9 * greatest(abs(o_totalprice), abs(round(o_totalprice))), 0.25) AS near, least(greatest(o_totalprice, 1000), 200000) AS clamped, round(1 / (1 + exp(-(o_totalprice / 100000 - 1))), 6) AS chance FROM orders""")
def number_functions(spark, d):
    o, p = table(spark, d, "orders"), F.col("o_totalprice")
    text = F.when(F.col("o_orderstatus") == "O", " Yes").when(F.col("o_orderstatus") == "P", "TRUE").otherwise((F.col("o_orderkey") % 2).cast("string"))
    return rounded(o.select("o_orderkey", values.truthy(text).alias("truth"), values.close(p, F.round(p), 0.25).alias("near"), values.clamp(p, 1000.0, 200000.0).alias("clamped"), values.sigmoid(p / 100000 - 1).alias("chance")))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS flag, CASE WHEN o_orderkey % 5 <> 4 THEN round(o_totalprice, 2) END AS amount, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderkey % 7 AS INT) END AS whole FROM (SELECT *, o_orderkey % 5 AS k FROM orders) WHERE k IN (0, 4)
UNION ALL SELECT o_orderkey, FALSE, NULL, NULL FROM orders WHERE o_orderkey % 5 NOT IN (0, 4)""")
def parsed_answers(spark, d):
    """Answers of a language model: fenced JSON, missing properties, arrays, prose and broken JSON."""
    o = table(spark, d, "orders")
    flag, amount, whole = (F.col("o_orderkey") % 3 == 0).cast("string"), F.replace(F.round("o_totalprice", 2).cast("string"), F.lit("."), F.lit(",")), (F.col("o_orderkey") % 7).cast("string")
    full = F.concat(F.lit('```json\n{"flag": '), flag, F.lit(', "amount": "'), amount, F.lit('", "whole": '), whole, F.lit(".0}\n```"))
    answer = F.when(F.col("o_orderkey") % 5 == 0, full).when(F.col("o_orderkey") % 5 == 1, F.lit("[1, 2]")).when(F.col("o_orderkey") % 5 == 2, F.lit("I think so")).when(F.col("o_orderkey") % 5 == 3, F.lit('{"flag": tru')).otherwise(F.concat(F.lit('{"flag": '), flag, F.lit("}")))
    parsed = values.parse_answer(answer, {"flag": "bool", "amount": "float", "whole": "int"})
    return rounded(o.select("o_orderkey", parsed.alias("a")).select("o_orderkey", "a.*"), 2)


@query("""SELECT n_name, CAST(k AS INT) AS position, CASE k WHEN 0 THEN 61 WHEN 1 THEN 4 WHEN 2 THEN 57.5 ELSE -3 END::DOUBLE AS value, CASE k WHEN 0 THEN length(n_name) + 4 WHEN 1 THEN length(n_name) + 10 WHEN 2 THEN length(n_name) + 18 ELSE length(n_name) + 48 END::INT AS "begin" FROM nation, (SELECT unnest(range(4)) AS k)""")
def numbers_in_text(spark, d):
    """Numbers of up to three digits that are no part of longer ones, with their places."""
    n = table(spark, d, "nation").select("n_name", F.concat("n_name", F.lit(" of 61 up +4 from 57.5 in 2020, 12,000 Q4 or so -3.")).alias("t"))
    return values.numeric_candidates(n, "n_name", "t").select("n_name", "position", "value", "begin")


@query("SELECT CAST(count(*) AS BIGINT) AS texts, CAST(sum(len(regexp_extract_all(' ' || regexp_replace(context, '[^0-9]+', ' ', 'g') || ' ', '[0-9]+'))) AS BIGINT) AS runs FROM context_windows")
def digit_runs(spark, d):
    """Texts by the numbers that they hold, counted in the JVM."""
    w = table(spark, d, "context_windows")
    return w.agg(F.count("*").alias("texts"), F.sum(F.size(F.regexp_extract_all("context", F.lit("[0-9]+"), F.lit(0)))).alias("runs"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS length, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first, 1.0::DOUBLE AS self FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def unit_vectors(spark, d):
    e = table(spark, d, "embeddings")
    unit = vectors.normalised("embedding")
    return rounded(e.select("vec_id", vectors.norm(F.col("embedding")).alias("length"), unit[0].alias("first"), vectors.cosine_columns(unit, F.col("embedding")).alias("self")))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice * l_discount * 64, 0) / 64 AS DOUBLE) AS price FROM lineitem")
def exact_rounding(spark, d):
    """Halves to even on the exact binary value (here: of numbers of which many are exact halves)."""
    x = F.col("l_extendedprice") * F.col("l_discount") * 64
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (vectors.round_exactly(x, 0) / 64).alias("price"))


@query("SELECT record_id, len(list_filter(string_split(regexp_replace(core_text, '([.!?])[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', '', 'g') <> ''))::INT AS sentences FROM raw_records WHERE core_text IS NOT NULL")
def sql_sentences(spark, d):
    """The registered SQL function for sentences, called from SQL."""
    sql.register(spark)
    table(spark, d, "raw_records").createOrReplaceTempView("parchmill_records")
    return spark.sql("SELECT record_id, size(split_sentences(core_text)) AS sentences FROM parchmill_records WHERE core_text IS NOT NULL")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sql_cosines(spark, d):
    sql.register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("parchmill_vectors")
    return spark.sql("SELECT a.vec_id, round(cosine_sim(a.embedding, b.embedding), 6) AS score FROM parchmill_vectors a JOIN parchmill_vectors b ON b.vec_id = a.vec_id + 1")


@query(f"WITH {_WINDOWS} SELECT record_id, hit_sentence_index AS sentence_no, context FROM wins WHERE matched_phrase = 'nps'")
def sql_windows(spark, d):
    """The registered table function for windows, joined laterally in SQL."""
    sql.register(spark)
    table(spark, d, "raw_records").createOrReplaceTempView("parchmill_records")
    return spark.sql("SELECT record_id, sentence_no, context FROM parchmill_records, LATERAL context_windows(core_text, 'nps') WHERE core_text IS NOT NULL")


@query("SELECT n_name, 2 AS numbers, 'Key: ' || n_nationkey AS text FROM nation")
def sql_table_functions(spark, d):
    """Registered functions for HTML and for numbers, the latter as a table function."""
    sql.register(spark)
    table(spark, d, "nation").createOrReplaceTempView("parchmill_nations")
    return spark.sql("SELECT n_name, CAST(count(*) AS INT) AS numbers, first(clean_html(concat('<p>Key: ', n_nationkey, '</p>'))) AS text FROM parchmill_nations, LATERAL numeric_candidates(concat('from 5 to ', n_nationkey)) GROUP BY n_name")


@query("SELECT n_name, CAST(rank AS INT) AS rank, name FROM (SELECT a.n_name, b.n_name AS name, row_number() OVER (PARTITION BY a.n_name ORDER BY CASE WHEN a.n_name = b.n_name THEN 0 ELSE 1 END) AS rank FROM nation a CROSS JOIN nation b) WHERE rank = 1")
def exact_names_first(spark, d):
    """Names found by the weighted ratio: a name's best match is itself."""
    n = table(spark, d, "nation").select("n_name")
    found = joins.similar_names(n, n.select(F.col("n_name").alias("name")), "n_name", "name", 1, joins.weighted_ratio)
    return found.select(F.col("query").alias("n_name"), "rank", "name")


@query("SELECT o_orderkey, 'sha' AS kind, sha256('{\"a\":' || o_orderkey || ',\"b\":\"' || o_orderstatus || '\"}') AS id FROM orders")
def stable_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.lit("sha").alias("kind"), strings.stable_id(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("b")).alias("id"))


@query("SELECT o_orderstatus AS name, CAST(count(*) AS BIGINT) AS rows, CAST(min(o_orderkey) AS BIGINT) AS first FROM orders GROUP BY ALL")
def first_seen_groups(spark, d):
    o = table(spark, d, "orders")
    n = F.count("*").over(Window.partitionBy("o_orderstatus"))
    from .operators import aggregates

    return aggregates.distinct_first_seen(o.withColumn("rows", n).select("o_orderstatus", "o_orderkey", "rows"), ["o_orderstatus"], ["o_orderkey"]).select(F.col("o_orderstatus").alias("name"), "rows", F.col("o_orderkey").alias("first"))
