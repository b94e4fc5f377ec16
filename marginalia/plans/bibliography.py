"""Registered queries of the bibliography operators, with DuckDB SQL for the same rows.

The tables hold no BibTeX, so each query writes it from orders (one article per
order, in one source per row or per customer) and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import functions as B
from marginalia import operators as O
from marginalia.runtime import ship, table


def _text(key, customer, priority, year):
    """The BibTeX of one article."""
    return F.format_string("@article{o%d,\n author = {Customer%d, C},\n title = {Order %d},\n journal = {Priority %s},\n year = {%d},\n volume = {%d},\n doi = {10.5555/%d}\n}\n", key, customer, key, priority, year, key % 50 + 1, key)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey, yr and the BibTeX of one article per order."""
    ship(spark)
    orders = table(spark, sf_dir, "orders", spread=True).select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"), "o_orderpriority")
    return orders.withColumn("bibtex", _text(F.col("o_orderkey"), F.col("o_custkey"), F.substring("o_orderpriority", 1, 1), F.col("yr")))


def _by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every customer by key, in an array ``all`` of numbers only: texts are written where the array lies."""
    ship(spark)
    orders = table(spark, sf_dir, "orders", by="o_custkey").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    each = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "yr", "priority"))).alias("all"))
    # Without a step between, each use of the array is an aggregate of its own, and each field read from a report another reading of the source.
    return each.select("o_custkey", F.explode_outer(F.array("all")).alias("all"))


def _texts():
    """The BibTeX of each of a customer's orders."""
    return F.transform("all", lambda o: _text(o["o_orderkey"], F.col("o_custkey"), o["priority"], o["yr"]))


def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per customer, with entries by order key; every seventh has an unclosed block."""
    end = F.when(F.col("o_custkey") % 7 == 0, F.lit("\n@broken{never closed")).otherwise(F.lit(""))
    return _by_customer(spark, sf_dir).select("o_custkey", F.col("all.o_orderkey").alias("orders"), F.concat(F.array_join(_texts(), "\n"), end).alias("bibtex"))


def _shelf(column, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shelves(spark, sf_dir).select("o_custkey", column().alias(name))

    return query


def _article(column, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return articles(spark, sf_dir).select("o_orderkey", column().alias(name))

    return query


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.explode_entries(shelves(spark, sf_dir).select("o_custkey", "bibtex"), fields=("key", "entry_type", "title", "volume", "doi"), recovery="report")
    return rows


def explode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.explode_entries(shelves(spark, sf_dir).select("o_custkey", "bibtex"), recovery="report", outer=False)
    wanted = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.format_string("o%d", "o_orderkey").alias("key"))
    return rows.join(wanted, "key", "left_semi").select("o_custkey", "key", "title")


def year_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.disambiguate(articles(spark, sf_dir).select("o_orderkey", "o_custkey", "yr"), ["o_custkey", "yr"], "o_orderkey")


def number_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("ord"))
    return O.number_citations(lines, "doc", "key", "ord").select("doc", "key", "ord", F.col("number").cast("bigint").alias("number"))


def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(F.col("o_custkey").alias("key"))
    held = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("key"))
    return O.missing_references(cited, held, ["key"])


def dedupe_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return O.dedupe_entries(parts, ["p_type"], "p_partkey")


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.explode_blocks(shelves(spark, sf_dir).select("o_custkey", "bibtex"))
    return rows.groupBy("o_custkey", "kind").agg(F.count("*").alias("n"), F.sum(F.col("span_end") - F.col("span_start")).alias("size")).filter("kind IN ('entry', 'failed')")


def raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.explode_fields(articles(spark, sf_dir).select("o_orderkey", "bibtex"), columns=("field_no", "name", "value", "value_mode"))
    return rows.select("o_orderkey", F.col("field_no").cast("bigint").alias("field_no"), "name", "value", "value_mode")


def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = shelves(spark, sf_dir)
    cited = held.select(F.col("o_custkey").alias("doc_id"), F.posexplode("orders").alias("ord", "o")).select("doc_id", "ord", F.format_string("o%d", "o").alias("key"), F.lit(None).cast("string").alias("locator"))
    return O.render_documents(cited, held.select(F.col("o_custkey").alias("doc_id"), "bibtex"), style="ieee").select("doc_id", "ord", "text", "bibliography", "error")


def _keys():
    return F.transform("orders", lambda o: F.format_string("o%d", o))


def _joined(report, parts: tuple[str, ...]):
    """Fields of a report as one text."""
    shown = [F.array_join(report[p], ",") if p in ("keys", "diagnostics") else report[p].cast("string") for p in parts]
    return F.concat_ws("|", *[F.coalesce(x, F.lit("null")) for x in shown])


def bibliographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole bibliographies of every customer, as a line per entry."""
    return shelves(spark, sf_dir).select("o_custkey", B.full_bibliography_text("bibtex", recovery="report").alias("bibliography"))


QUERIES = {
    "entries": entries,
    "bibliographies": bibliographies,
    "explode_lookup": explode_lookup,
    "entry_count": _shelf(lambda: B.entry_count("bibtex"), "entry_count"),
    "recovered_count": _shelf(lambda: B.entry_count("bibtex", recovery="report"), "entry_count"),
    "can_parse": _shelf(lambda: B.can_parse("bibtex"), "can_parse"),
    "has_diagnostics": _shelf(lambda: B.has_diagnostics("bibtex", recovery="report"), "has_diagnostics"),
    "diagnostics": _shelf(lambda: F.array_join(B.diagnostics("bibtex", recovery="report"), ";"), "diagnostics"),
    "parse_report": _shelf(lambda: _joined(B.parse_report("bibtex"), ("ok", "entry_count", "keys", "diagnostics")), "report"),
    "keys": _shelf(lambda: F.array_join(B.keys("bibtex", recovery="report"), ","), "keys"),
    "to_entry_json": _article(lambda: B.to_entry_json("bibtex"), "json"),
    "cite": _article(lambda: B.cite("bibtex", F.format_string("o%d", "o_orderkey")), "cite"),
    "cite_html": _article(lambda: B.cite_html("bibtex", F.format_string("o%d", "o_orderkey"), style="chicago-author-date"), "cite_html"),
    "cite_rendered": _article(lambda: B.cite_rendered("bibtex", F.format_string("o%d", "o_orderkey"), style="ieee")["text"], "cite"),
    "cite_each": _shelf(lambda: F.array_join(B.cite_each("bibtex", _keys(), style="ieee", recovery="report"), " "), "cites"),
    "cite_each_html": _shelf(lambda: F.array_join(B.cite_each_html("bibtex", _keys(), recovery="report"), " "), "cites"),
    "cite_each_rendered": _shelf(lambda: F.array_join(B.cite_each_rendered("bibtex", _keys(), style="chicago-author-date", recovery="report")["text"], " "), "cites"),
    "cite_group": _shelf(lambda: B.cite_group("bibtex", _keys(), style="ieee", recovery="report"), "cite"),
    "cite_group_html": _shelf(lambda: B.cite_group_html("bibtex", _keys(), recovery="report"), "cite"),
    "cite_group_rendered": _shelf(lambda: B.cite_group_rendered("bibtex", _keys(), style="chicago-author-date", recovery="report")["html"], "cite"),
    "full_bibliography_text": _article(lambda: B.full_bibliography_text("bibtex"), "bibliography"),
    "full_bibliography_html": _article(lambda: B.full_bibliography_html("bibtex"), "bibliography"),
    "full_bibliography_rendered": _article(lambda: B.full_bibliography_rendered("bibtex", style="ieee")["text"], "bibliography"),
    "tidy_bibtex": _article(lambda: B.tidy_bibtex("bibtex", numeric=True, sort_fields=["title", "year"], omit=["journal"]), "bibtex"),
    "tidy_bibtex_report": _shelf(lambda: _joined(B.tidy_bibtex_report("bibtex"), ("ok", "count", "error")), "report"),
    "generate_keys": _article(lambda: B.keys(B.tidy_bibtex("bibtex", generate_keys=True))[0], "key"),
    "set_field": _article(lambda: B.set_field("bibtex", F.format_string("o%d", "o_orderkey"), F.lit("title"), F.lit("New title")), "bibtex"),
    "raw_blocks": raw_blocks,
    "raw_fields": raw_fields,
    "year_suffix": year_suffix,
    "number_citations": number_citations,
    "missing_references": missing_references,
    "dedupe_entries": dedupe_entries,
    "render_documents": render_documents,
}

#: A few articles of a customer whose raw text needs every kind of formatting.
def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey and an untidy entry: caps, quotes, bare numbers, doubled and empty fields."""
    ship(spark)
    orders = table(spark, sf_dir, "orders", spread=True)
    text = F.format_string('@ARTICLE{o%d, TITLE={{Big}   Title %d}, Title={again}, month={%s}, year={%d}, pages="1-%d", note={}, author={A B and C D and E F}, url={http://x/a_b}}', "o_orderkey", "o_orderkey", F.date_format("o_orderdate", "MMMM"), F.year("o_orderdate"), F.col("o_orderkey") % 90 + 10)
    return orders.select("o_orderkey", "o_custkey", text.alias("bibtex"))


def _option(**options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return messy(spark, sf_dir).select("o_orderkey", B.tidy_bibtex("bibtex", **options).alias("bibtex"))

    return query


def _messy_sql(title="{{Big} Title %s}", again=False, month="{%s}", year="{%s}", pages='"1--%s"', note="{}", author="{A B and C D and E F}", url="{http://x/a_b}", order=None, indent="  ", align=14, comma="", kind="article", case=str.lower) -> str:
    """SQL for the formatted text of :func:`messy`, field by field."""
    quoted = {"TITLE": (title, "o_orderkey"), "Title": ("{again}" if again else None, None), "month": (month, "strftime(o_orderdate, '%B')"), "year": (year, "year(o_orderdate)"), "pages": (pages, "(o_orderkey % 90 + 10)"), "note": (note, None), "author": (author, None), "url": (url, None)}
    lines = []
    for name in order or quoted:
        text, value = quoted[name]
        if text is None:
            continue
        shown = case(name)
        head = indent + (shown + " " * max(1, align - len(shown)) if align else shown + " ") + "= "
        before, mark, after = text.partition("%s")
        lines.append(f"'{head}{before}'" + (f" || {value} || '{after}'" if mark else ""))
    return f"SELECT o_orderkey, '@{kind}{{o' || o_orderkey || ',' || chr(10) || " + " || ',' || chr(10) || ".join(lines) + f" || '{comma}' || chr(10) || '}}' || chr(10) AS bibtex FROM orders"


def tidy_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each customer's source after sorting its entries by year, then key, both descending."""
    held = shelves(spark, sf_dir)
    return held.select("o_custkey", F.array_join(B.keys(B.tidy_bibtex("bibtex", sort=["-year", "-doi"])), ",").alias("keys"))


def tidy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left of a source in which every order occurs twice under two keys and one DOI."""
    twice = F.transform(_texts(), lambda text: F.concat(text, F.replace(text, F.lit("{o"), F.lit("{copy"))))
    held = _by_customer(spark, sf_dir).select("o_custkey", F.array_join(F.array_sort(twice), "\n").alias("bibtex"))
    report = B.tidy_bibtex_report("bibtex", duplicates=["doi"], merge="first")
    told = held.select("o_custkey", report.alias("r"))
    warned = F.array_join(F.array_sort(F.transform("r.warnings", lambda w: w["message"])), ";")
    return told.select("o_custkey", F.col("r.count").cast("bigint").alias("n_read"), B.entry_count(F.col("r.bibtex")).cast("bigint").alias("n_left"), warned.alias("warned"))


def citation_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return O.citation_positions(lines, "doc", "key", "ord")


def assign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"))
    named = orders.withColumn("name", F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")))
    return O.assign_keys(named, ["name", "yr"], ["o_custkey"], "o_orderkey").select("o_orderkey", "new_key")


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "orders").select("o_custkey", F.format_string("o%d", F.col("o_orderkey") + F.col("o_orderkey") % 3).alias("key"))
    held = O.explode_entries(shelves(spark, sf_dir).select("o_custkey", "bibtex"), fields=("key", "title"), recovery="report")
    return O.lookup(cited, held, ["o_custkey", "key"]).select("o_custkey", "key", "title")


QUERIES |= {
    "citation_positions": citation_positions,
    "assign_keys": assign_keys,
    "lookup": lookup,
    "select_keys": _shelf(lambda: F.array_join(B.select_keys("bibtex", "article > periodical[volume] & !book", recovery="report"), ","), "keys"),
    "tidy_defaults": _option(),
    "tidy_omit_empty": _option(omit=["url"], remove_empty_fields=True),
    "tidy_keep_duplicate_fields": _option(remove_duplicate_fields=False),
    "tidy_months": _option(months=True),
    "tidy_curly": _option(curly=True),
    "tidy_max_authors": _option(max_authors=2),
    "tidy_encode_urls": _option(encode_urls=True),
    "tidy_remove_braces": _option(remove_braces=True),
    "tidy_enclosing_braces": _option(enclosing_braces=True),
    "tidy_layout": _option(tab=True, align=20, trailing_commas=True),
    "tidy_no_align": _option(align=False, space=4),
    "tidy_no_lowercase": _option(lowercase=False),
    "tidy_sort_fields": _option(sort_fields=True),
    "tidy_sort": tidy_sort,
    "tidy_duplicates": tidy_duplicates,
}

_FAMILY = "'Customer' || o_custkey"
_YEAR = "year(o_orderdate)"
_VOLUME = "(o_orderkey % 50 + 1)"
_JOURNAL = "'Priority ' || substr(o_orderpriority, 1, 1)"
_BIB = f"""('@article{{o' || o_orderkey || ',' || chr(10) || ' author = {{Customer' || o_custkey || ', C}},' || chr(10) || ' title = {{Order ' || o_orderkey || '}},' || chr(10) || ' journal = {{' || {_JOURNAL} || '}},' || chr(10)
 || ' year = {{' || {_YEAR} || '}},' || chr(10) || ' volume = {{' || {_VOLUME} || '}},' || chr(10) || ' doi = {{10.5555/' || o_orderkey || '}}' || chr(10) || '}}' || chr(10))"""
_BY = "FROM orders GROUP BY o_custkey"
_END = "@broken{never closed"
#: Where the unclosed block of a customer begins: behind the entries and the line breaks between them.
_SPAN = f"(sum(strlen({_BIB})) + count(*)) || '..' || (sum(strlen({_BIB})) + count(*) + {len(_END)})"
#: Letters of the articles that one customer has in one year, by title; places in the order cited.
_LETTERS = f"""(SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate, {_YEAR} AS yr, {_YEAR} || CASE WHEN count(*) OVER same = 1 THEN '' WHEN row_number() OVER told <= 26 THEN chr(CAST(96 + row_number() OVER told AS INT))
  ELSE chr(CAST(96 + (row_number() OVER told - 1) // 26 AS INT)) || chr(CAST(97 + (row_number() OVER told - 1) % 26 AS INT)) END AS shown, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
  FROM orders WINDOW same AS (PARTITION BY o_custkey, {_YEAR}), told AS (PARTITION BY o_custkey, {_YEAR} ORDER BY lower('Order ' || o_orderkey)))"""

ORACLE_SQL = {
    "entries": f"SELECT o_custkey, 'o' || o_orderkey AS key, 'Article' AS entry_type, 'Order ' || o_orderkey AS title, CAST({_VOLUME} AS VARCHAR) AS volume, '10.5555/' || o_orderkey AS doi FROM orders",
    "bibliographies": f"SELECT o_custkey, string_agg({_FAMILY} || ', C. (' || shown || '). Order ' || o_orderkey || '. ' || {_JOURNAL} || ', ' || {_VOLUME} || '. https://doi.org/10.5555/' || o_orderkey, chr(10) ORDER BY yr, lower('Order ' || o_orderkey)) AS bibliography FROM {_LETTERS} GROUP BY o_custkey",
    "explode_lookup": "SELECT o_custkey, 'o' || o_orderkey AS key, 'Order ' || o_orderkey AS title FROM orders WHERE o_totalprice > 200000",
    "entry_count": f"SELECT o_custkey, CAST(CASE WHEN o_custkey % 7 <> 0 THEN count(*) END AS INT) AS entry_count {_BY}",
    "recovered_count": f"SELECT o_custkey, CAST(count(*) AS INT) AS entry_count {_BY}",
    "can_parse": "SELECT DISTINCT o_custkey, o_custkey % 7 <> 0 AS can_parse FROM orders",
    "has_diagnostics": "SELECT DISTINCT o_custkey, o_custkey % 7 = 0 AS has_diagnostics FROM orders",
    "diagnostics": f"SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 'ignored malformed BibTeX block at ' || {_SPAN} || ': entry ended before closing delimiter' ELSE '' END AS diagnostics {_BY}",
    "parse_report": f"SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 'false|null|null|parse error at ' || {_SPAN} || ': entry ended before closing delimiter' ELSE 'true|' || count(*) || '|' || string_agg('o' || o_orderkey, ',' ORDER BY o_orderkey) || '|' END AS report {_BY}",
    "keys": f"SELECT o_custkey, string_agg('o' || o_orderkey, ',' ORDER BY o_orderkey) AS keys {_BY}",
    "to_entry_json": f"""SELECT o_orderkey, '[{{"author":"' || {_FAMILY} || ', C","date":"' || {_YEAR} || '","id":"o' || o_orderkey || '","key":"o' || o_orderkey || '","parent":{{"title":"' || {_JOURNAL} || '","type":"periodical","volume":"' || {_VOLUME} || '"}},"serial-number":{{"doi":"10.5555/' || o_orderkey || '"}},"title":"Order ' || o_orderkey || '","type":"article"}}]' AS json FROM orders""",
    "cite": f"SELECT o_orderkey, '(' || {_FAMILY} || ', ' || {_YEAR} || ')' AS cite FROM orders",
    "cite_html": f"SELECT o_orderkey, '(' || {_FAMILY} || ' ' || {_YEAR} || ')' AS cite_html FROM orders",
    "cite_rendered": "SELECT o_orderkey, '[1]' AS cite FROM orders",
    "cite_each": f"SELECT o_custkey, string_agg('[' || n || ']', ' ' ORDER BY n) AS cites FROM {_LETTERS} GROUP BY o_custkey",
    "cite_each_html": f"SELECT o_custkey, string_agg('(' || {_FAMILY} || ', ' || shown || ')', ' ' ORDER BY n) AS cites FROM {_LETTERS} GROUP BY o_custkey",
    "cite_each_rendered": f"SELECT o_custkey, string_agg('(' || {_FAMILY} || ' ' || shown || ')', ' ' ORDER BY n) AS cites FROM {_LETTERS} GROUP BY o_custkey",
    "cite_group": f"SELECT o_custkey, CASE count(*) WHEN 1 THEN '[1]' WHEN 2 THEN '[1], [2]' ELSE '[1]–[' || count(*) || ']' END AS cite {_BY}",
    "cite_group_html": f"SELECT o_custkey, '(' || any_value({_FAMILY}) || ', ' || string_agg(shown, ', ' ORDER BY yr, n) || ')' AS cite FROM {_LETTERS} GROUP BY o_custkey",
    "cite_group_rendered": f"SELECT o_custkey, '(' || any_value({_FAMILY}) || ' ' || string_agg(shown, ', ' ORDER BY n) || ')' AS cite FROM {_LETTERS} GROUP BY o_custkey",
    "full_bibliography_text": f"SELECT o_orderkey, {_FAMILY} || ', C. (' || {_YEAR} || '). Order ' || o_orderkey || '. ' || {_JOURNAL} || ', ' || {_VOLUME} || '. https://doi.org/10.5555/' || o_orderkey AS bibliography FROM orders",
    "full_bibliography_html": f"""SELECT o_orderkey, '<div class="csl-entry" data-key="o' || o_orderkey || '">' || {_FAMILY} || ', C. (' || {_YEAR} || '). Order ' || o_orderkey || '. <i>' || {_JOURNAL} || '</i>, <i>' || {_VOLUME} || '</i>. <a href="https://doi.org/10.5555/' || o_orderkey || '">https://doi.org/10.5555/' || o_orderkey || '</a></div>' AS bibliography FROM orders""",
    "full_bibliography_rendered": f"SELECT o_orderkey, '[1] C. ' || {_FAMILY} || ', “Order ' || o_orderkey || ',” ' || {_JOURNAL} || ', vol. ' || {_VOLUME} || ', ' || {_YEAR} || ', doi: 10.5555/' || o_orderkey || '.' AS bibliography FROM orders",
    "tidy_bibtex": f"""SELECT o_orderkey, '@article{{o' || o_orderkey || ',' || chr(10) || '  title         = {{Order ' || o_orderkey || '}},' || chr(10) || '  year          = ' || {_YEAR} || ',' || chr(10)
 || '  author        = {{' || {_FAMILY} || ', C}},' || chr(10) || '  volume        = ' || {_VOLUME} || ',' || chr(10) || '  doi           = {{10.5555/' || o_orderkey || '}}' || chr(10) || '}}' || chr(10) AS bibtex FROM orders""",
    "tidy_bibtex_report": f"SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 'false|null|line ' || (9 * count(*) + 1) || ':1: entry ended before closing delimiter' ELSE 'true|' || count(*) || '|null' END AS report {_BY}",
    "generate_keys": f"SELECT o_orderkey, 'customer' || o_custkey || {_YEAR} || 'order' AS key FROM orders",
    "set_field": f"SELECT o_orderkey, replace({_BIB}, 'title = {{Order ' || o_orderkey || '}}', 'title = {{New title}}') AS bibtex FROM orders",
    "raw_blocks": f"SELECT o_custkey, 'entry' AS kind, count(*) AS n, CAST(sum(length({_BIB}) - 1) AS BIGINT) AS size {_BY} UNION ALL SELECT DISTINCT o_custkey, 'failed', 1, length('@broken{{never closed') FROM orders WHERE o_custkey % 7 = 0",
    "raw_fields": " UNION ALL ".join(f"SELECT o_orderkey, CAST({i} AS BIGINT) AS field_no, '{n}' AS name, CAST({v} AS VARCHAR) AS value, 'Braced' AS value_mode FROM orders" for i, (n, v) in enumerate((("author", f"{_FAMILY} || ', C'"), ("title", "'Order ' || o_orderkey"), ("journal", _JOURNAL), ("year", _YEAR), ("volume", _VOLUME), ("doi", "'10.5555/' || o_orderkey")))),
    "year_suffix": f"WITH RECURSIVE l AS (SELECT CAST(0 AS BIGINT) AS place, 'a' AS letters UNION ALL SELECT place + 1, CASE WHEN letters = repeat('z', length(letters)) THEN repeat('a', length(letters) + 1) ELSE substr(letters, 1, length(rtrim(letters, 'z')) - 1) || chr(ascii(right(rtrim(letters, 'z'), 1)) + 1) || repeat('a', length(letters) - length(rtrim(letters, 'z'))) END FROM l WHERE place < (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, {_YEAR}))), p AS (SELECT o_orderkey, o_custkey, CAST({_YEAR} AS INT) AS yr, row_number() OVER (PARTITION BY o_custkey, {_YEAR} ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey, {_YEAR}) AS n FROM orders) SELECT o_orderkey, o_custkey, yr, CASE WHEN n > 1 THEN letters ELSE '' END AS suffix FROM p JOIN l USING (place)",
    "number_citations": "WITH f AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS number FROM lineitem GROUP BY 1, 2) SELECT l_orderkey AS doc, l_partkey AS key, l_linenumber AS ord, number FROM lineitem JOIN f USING (l_orderkey, l_partkey)",
    "missing_references": "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)",
    "dedupe_entries": "SELECT p_partkey, p_type FROM part QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(p_type, '[^a-zA-Z0-9]', '', 'g')) ORDER BY p_partkey) = 1",
    "render_documents": f"""SELECT o_custkey AS doc_id, CAST(n - 1 AS INT) AS ord, CASE WHEN o_custkey % 7 <> 0 THEN '[' || n || ']' END AS text, CASE WHEN o_custkey % 7 <> 0 AND n = 1 THEN bibliography END AS bibliography,
  CASE WHEN o_custkey % 7 = 0 THEN 'parse error at ' || span || ': entry ended before closing delimiter' END AS error
  FROM {_LETTERS} JOIN (SELECT o_custkey, string_agg('[' || n || '] C. ' || {_FAMILY} || ', “Order ' || o_orderkey || ',” ' || {_JOURNAL} || ', vol. ' || {_VOLUME} || ', ' || yr || ', doi: 10.5555/' || o_orderkey || '.', chr(10) ORDER BY n) AS bibliography, {_SPAN} AS span FROM {_LETTERS} GROUP BY o_custkey) USING (o_custkey)""",
}

ORACLE_SQL |= {
    "citation_positions": "SELECT l_suppkey AS doc, l_partkey AS key, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber) = 1 THEN 'first' ELSE 'subsequent' END AS position FROM lineitem",
    "assign_keys": f"SELECT o_orderkey, 'customer' || o_custkey || {_YEAR} || CASE WHEN count(*) OVER (PARTITION BY o_custkey, {_YEAR}) > 1 THEN CAST(row_number() OVER (PARTITION BY o_custkey, {_YEAR} ORDER BY o_orderkey) AS VARCHAR) ELSE '' END AS new_key FROM orders",
    "lookup": "SELECT c.o_custkey, 'o' || (c.o_orderkey + c.o_orderkey % 3) AS key, CASE WHEN e.o_orderkey IS NOT NULL THEN 'Order ' || e.o_orderkey END AS title FROM orders c LEFT JOIN orders e ON c.o_custkey = e.o_custkey AND e.o_orderkey = c.o_orderkey + c.o_orderkey % 3",
    "select_keys": f"SELECT o_custkey, string_agg('o' || o_orderkey, ',' ORDER BY o_orderkey) AS keys {_BY}",
    "tidy_defaults": _messy_sql(),
    "tidy_omit_empty": _messy_sql(order=["TITLE", "month", "year", "pages", "author"]),
    "tidy_keep_duplicate_fields": _messy_sql(again=True),
    "tidy_months": "WITH t AS (" + _messy_sql().replace("SELECT o_orderkey,", "SELECT o_orderkey, strftime(o_orderdate, '%B') AS m,", 1) + ") SELECT o_orderkey, replace(bibtex, '{' || m || '}', lower(substr(m, 1, 3))) AS bibtex FROM t",
    "tidy_curly": _messy_sql(pages="{1--%s}"),
    "tidy_max_authors": _messy_sql(author="{A B and C D and others}"),
    "tidy_encode_urls": _messy_sql(url="{http://x/a\\%5Fb}"),
    "tidy_remove_braces": _messy_sql(title="{Big Title %s}"),
    "tidy_enclosing_braces": _messy_sql(title="{{{Big} Title %s}}"),
    "tidy_layout": _messy_sql(indent="\t", align=20, comma=","),
    "tidy_no_align": _messy_sql(indent="    ", align=0),
    "tidy_no_lowercase": _messy_sql(kind="ARTICLE", case=str),
    "tidy_sort_fields": _messy_sql(order=["TITLE", "author", "year", "month", "pages", "url", "note"]),
    "tidy_sort": f"SELECT o_custkey, CASE WHEN o_custkey % 7 <> 0 THEN string_agg('o' || o_orderkey, ',' ORDER BY {_YEAR} DESC, '10.5555/' || o_orderkey DESC) END AS keys {_BY}",
    "tidy_duplicates": f"SELECT o_custkey, 2 * count(*) AS n_read, count(*) AS n_left, string_agg('Duplicate removed. Entry copy' || o_orderkey || ' has an identical DOI to entry o' || o_orderkey || '.', ';' ORDER BY o_orderkey || ' ') AS warned {_BY}",
}
