import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia import functions as B
from marginalia import operators as O
from marginalia.plans import bibliography as Q
from marginalia.plans import sources as R
from marginalia import runtime, sources

SF = "/root/testdata/sf0.001"
ARTICLE = "@article{lund2024, author={Lund, Jonna}, title={Ebb}, journal={J}, year=2024, volume=3}"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, ARTICLE, "lund2024", ["lund2024"]), (2, "@broken{", "lund2024", ["lund2024"]), (3, None, "x", None), (4, ARTICLE, None, ["lund2024", None]), (5, "", "x", []), (6, ARTICLE, "no", ["no"])], "id int, bibtex string, key string, keys array<string>")


def test_null_contract(rows):
    got = {r.id: r for r in rows.select("id", B.parse_report("bibtex"), B.entry_count("bibtex"), B.can_parse("bibtex"), B.diagnostics("bibtex"), B.entries("bibtex"), B.cite("bibtex", "key"), B.cite_rendered("bibtex", "key"), B.cite_each("bibtex", "keys"), B.cite_group("bibtex", "keys"), B.tidy_bibtex_report("bibtex")).collect()}
    assert got[1].cite == "(Lund, 2024)" and got[1].entry_count == 1 and got[1].diagnostics == []
    assert got[2].can_parse is False and got[2].entry_count is None and "parse error" in got[2].diagnostics[0] and got[2].tidy_bibtex_report.error.startswith("line 1:1: ")
    assert got[3].parse_report is not None and got[3].parse_report.ok is None and got[3].tidy_bibtex_report is None and got[3].cite_rendered is None
    assert got[4].cite is None and got[4].cite_each is None and got[4].cite_group is None
    assert got[5].entry_count == 0 and got[5].cite_each == [] and got[5].cite_group == "" and got[5].entries == []
    assert got[6].cite is None and got[6].cite_each is None


def test_construction_errors():
    for make, error in ((lambda: B.cite("b", "k", style="nope"), ValueError), (lambda: B.entries("b", fields="key"), TypeError), (lambda: B.entries("b", fields=["x"]), ValueError), (lambda: B.keys("b", recovery="maybe"), ValueError)):
        with pytest.raises(error):
            make()


def test_namespace_sql_and_one_evaluation(spark, rows):
    B.install()
    B.register(spark)
    rows.createOrReplaceTempView("sources")
    assert rows.select(F.col("bibtex").bib.cite("key")).columns == ["cite"]
    got = spark.sql("SELECT bib_entry_count(bibtex) AS n, bib_cite(bibtex, key, style => 'ieee') AS c, bib_cite_each(bibtex, keys) AS e, bib_full_bibliography_text(bibtex) AS b, bib_tidy_bibtex(bibtex) AS t, bib_has_diagnostics(bibtex, false) AS d FROM sources WHERE id = 1").first()
    assert got.n == 1 and got.c == "[1]" and got.e == ["(Lund, 2024)"] and got.b.startswith("Lund, J. (2024)") and got.t.startswith("@article{lund2024,\n") and got.d is False
    got = spark.sql("""SELECT bib_tidy_bibtex(bibtex, '{"omit": ["journal", "volume"], "sort_fields": ["year"]}') AS t, bib_select_keys(bibtex, 'article') AS k, bib_set_field(bibtex, key, 'title', 'New') AS e, bib_yaml_to_entry_json('a: {title: T}') AS y FROM sources WHERE id = 1""").first()
    assert got.t.split("\n")[1].startswith("  year") and "journal" not in got.t and got.k == ["lund2024"] and "title={New}" in got.e and '"title":"T"' in got.y
    assert spark.sql("SELECT s.id, b.kind FROM sources s, LATERAL bib_blocks(s.bibtex) b").count() == 4
    assert spark.sql("SELECT f.name FROM sources s, LATERAL bib_fields(s.bibtex) f WHERE s.id = 1").count() == 5
    assert spark.sql("SELECT e.title FROM sources s, LATERAL bib_entry_rows(s.bibtex) e WHERE s.id = 1").first().title == "Ebb"
    plan = rows.select(B.entry_count("bibtex"), B.can_parse("bibtex"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") <= 1


def test_outer_explode_and_stream(spark, rows, tmp_path):
    assert O.explode_entries(rows.select("id", "bibtex")).count() == 6
    assert O.explode_entries(rows.select("id", "bibtex"), outer=False).count() == 3
    from marginalia.streaming import stream_entries

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bib").write_text(ARTICLE)
    query = stream_entries(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("arrived").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.bib").write_bytes(b"@misc{a, title={caf\xe9}}")
    got = sources.read_bibliography(spark, str(tmp_path)).first()
    assert "café" in got.bibtex and got.diagnostics
    sources.write_bibliography(spark.createDataFrame([(ARTICLE,)], "bibtex string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == ARTICLE


QUERIES, SQL = Q.QUERIES | R.QUERIES, Q.ORACLE_SQL | R.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in "customer part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = sorted(str(tuple(r)) for r in df.select(sorted(df.columns)).collect())
    held = con.execute(SQL[name])
    names = [d[0] for d in held.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(str(tuple(r[i] for i in order)) for r in held.fetchall())


@pytest.mark.parametrize("name", ["entries", "explode_lookup", "lookup", "raw_blocks", "raw_fields"])
def test_a_source_is_parsed_once(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_letters_go_on_after_z(spark):
    got = [r.suffix for r in O.disambiguate(spark.range(710).withColumn("g", F.lit(1)), ["g"], "id").orderBy("id").collect()]
    assert got[:2] == ["a", "b"] and got[25:28] == ["z", "aa", "ab"] and got[701:704] == ["zz", "aaa", "aab"] and len(set(got)) == 710


def test_null_keys_are_numbered_and_first_rows_kept(spark):
    cited = spark.createDataFrame([(1, "a", 1), (1, None, 2), (1, "b", 3), (1, None, 4), (None, "a", 1)], "doc int, key string, ord int")
    assert sorted((r.doc or 0, r.ord, r.number) for r in O.number_citations(cited, "doc", "key", "ord").collect()) == [(0, 1, 1), (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 2)]
    held = spark.createDataFrame([(1, "A b"), (2, "a-B"), (3, None), (4, ""), (None, "ab"), (5, "x")], "o int, v string")
    assert sorted(r.o for r in O.dedupe_entries(held, ["v"], "o").collect()) == [1, 3, 4, 5]


def test_duplicate_rules(spark):
    rows = [(1, "K", "10.1/X", "Lund, Jonna and Rask, R", "A Title!", None, "an abstract"), (2, "k", "https-10.1/x", "Jonna {Lund}", "a title", "0", "An Abstract."), (3, "l", None, None, "a title", "0", None)]
    held = spark.createDataFrame(rows, "n int, key string, doi string, author string, title string, number string, abstract string")
    for rule, left in (("key", [1, 3]), ("citation", [1, 3]), ("abstract", [1, 3]), ("doi", [1, 2, 3])):
        assert sorted(r.n for r in O.dedupe_entries(held, [], "n", value=O.duplicate_value(rule)).collect()) == left
    with pytest.raises(ValueError):
        O.duplicate_value("isbn")


def test_documents_say_why_they_do_not_render(spark):
    cited = spark.createDataFrame([(1, 0, "k", None), (1, None, "k", "3"), (2, 0, "k", None), (3, 0, None, None), (4, 1, "zz", None), (5, 0, "k", None), (6, 0, "k", None)], "doc_id int, ord int, key string, locator string")
    held = spark.createDataFrame([(1, "@misc{k,author={A B},year=2020}"), (3, "@misc{k,title={x}}"), (4, ""), (5, "@misc{k,"), (6, ""), (6, "")], "doc_id int, bibtex string")
    got = {(r.doc_id, r.ord): r for r in O.render_documents(cited, held).collect()}
    assert len(got) == 7 and got[1, 0].text == "(B, 2020)" and got[1, None].text == "(B, 2020, p. 3)" and got[1, 0].error is None
    assert [got[d, o].error.split(":")[0] for d, o in ((2, 0), (3, 0), (4, 1), (5, 0), (6, 0))] == ["the document has no library", "a citation has no key", 'missing reference "zz"', "parse error at 0..8", "the document has 2 libraries"]
    assert all(got[d, o].text is None for d, o in ((2, 0), (3, 0), (4, 1), (5, 0), (6, 0)))


def test_functions_ship_the_package(tmp_path):
    """From a foreign folder, without PYTHONPATH, before any registered query has run."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").getOrCreate()
from marginalia import functions as B
print("COUNT", spark.createDataFrame([("@misc{{a, title={{t}}}}",)], "bibtex string").select(B.entry_count("bibtex").alias("n")).first().n)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "COUNT 1" in done.stdout, done.stderr[-2000:]


def test_signatures_name_every_option():
    import inspect

    assert len(inspect.signature(B.tidy_bibtex).parameters) == 28 and inspect.signature(B.tidy_bibtex_report).parameters["align"].default == 14
    for name in ("cite", "cite_html", "cite_each", "cite_each_html", "cite_group", "cite_group_html", "full_bibliography_text", "full_bibliography_html"):
        assert {"style", "locale", "recovery"} <= set(inspect.signature(getattr(B, name)).parameters)


def _dealt(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_rows_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path):
    """Splits without the middle of a row group are empty, so their number says nothing."""
    plain = spark.range(120_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 12_000).alias("o_custkey"), F.lit("2020-01-05").cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    plain.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:
            spark.conf.set(k, "65536")
        assert spark.read.parquet(str(tmp_path / "orders.parquet")).rdd.getNumPartitions() >= 4
        assert max(_dealt(R.orders(spark, str(tmp_path)))) <= 25_000 and max(_dealt(Q.articles(spark, str(tmp_path)))) <= 25_000
        shelves = _dealt(Q.shelves(spark, str(tmp_path)))
        assert sum(shelves) == 12_000 and len(shelves) == 5 and max(shelves) < 3_000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_rows_in_even_splits_stay_where_they_are(spark, tmp_path):
    """A shuffle of them would hold every text on disk once more."""
    spark.range(4_000).withColumn("text", F.lit("x")).repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    spread = runtime.table(spark, str(tmp_path), "documents", spread=True)
    assert "Exchange" not in spread._jdf.queryExecution().executedPlan().toString() and sum(_dealt(spread)) == 4_000
    assert sum(_dealt(runtime.table(spark, str(tmp_path), "documents", by="id"))) == 4_000


def test_media_are_stored_compressed(spark):
    from pathlib import Path

    import pyarrow.parquet as pq

    from marginalia.llm import audio

    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("words " * 500).alias("text"))
    assert audio.audio_digest(docs).count() == 3
    media = max(Path(runtime.shared_dir(spark).removeprefix("file://")).glob(f"{spark.sparkContext.applicationId}/media-*"), key=lambda p: p.stat().st_mtime)
    assert {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in media.glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows} == {"ZSTD"}


def test_files_and_kept_sources_are_bounded(spark, tmp_path):
    """A file of a whole partition, and 64 of them kept parsed, do not fit into a worker."""
    many = spark.range(12_000).coalesce(1).select(F.format_string("@misc{k%d, title={T}}", "id").alias("bibtex"))
    sources.write_bibliography(many, str(tmp_path / "out"), extension="bib")
    read = sources.read_bibliography(spark, str(tmp_path / "out"))
    assert sorted(O.explode_entries(read.select("path", "bibtex"), outer=False).groupBy("path").count().toPandas()["count"]) == [2_000, 5_000, 5_000]
    for start in range(0, 70_000, 10_000):
        B._parsed("\n".join(f"@misc{{k{i}, title={{T}}}}" for i in range(start, start + 2_000)), True)
    assert B._parsed.last.cache_info().currsize == 1 and len(B._parsed("@misc{a, title={x}}", True).records) == 1


@pytest.mark.parametrize("name, readings", [("tidy_duplicates", 2), ("parse_report", 1), ("tidy_bibtex_report", 1)])
def test_a_report_of_a_shelf_is_made_once(spark, name, readings):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
    assert plan.toString().count("], [pythonUDF0#") == readings and "pythonUDF1#" not in plan.toString()


def test_raw_rows_leave_python_as_arrow_columns(spark):
    """Null, empty and many sources, in more than one part; the conversion is not done value by value."""
    sources_ = [None, "", "@misc{a, x = {1} # b}", "% é\n@broken{"] * 150
    df = spark.createDataFrame(list(enumerate(sources_)), "n int, bibtex string").coalesce(1)
    got = df.select("n", B.raw_blocks("bibtex").alias("b"), B.raw_fields("bibtex").alias("f")).orderBy("n").collect()
    for row, source in zip(got, sources_, strict=True):
        assert row.b == (None if source is None else B._blocks(source)) and row.f == (None if source is None else [(*f[:7], [tuple(a) for a in f[7]], *f[8:]) for f in B._field_rows(source)])
    plan = df.select(B.raw_blocks("bibtex"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "work(bibtex" in plan


def test_documents_are_rendered_many_at_a_time(spark):
    """No group of its own for each document; null documents, several libraries and none keep their rows."""
    cited = spark.createDataFrame([(1, 1, "b", None), (1, 0, "a", "4"), (2, 0, "a", None), (3, 0, "a", None), (None, 0, "a", None), (4, None, "a", None), (4, 2, None, None)], "doc_id int, ord int, key string, locator string")
    held = spark.createDataFrame([(1, "@misc{a, title={A}}\n@misc{b, title={B}}"), (2, "@misc{b}"), (2, None), (None, "@misc{a, title={N}}"), (4, "@misc{a}"), (9, "@misc{a}")], "doc_id int, bibtex string")
    got = O.render_documents(cited, held, style="ieee")
    assert "Arrow" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "CoGroup" not in plan and got.columns == ["doc_id", "ord", "text", "html", "bibliography", "error"]
    rows = sorted([(r.doc_id, r.ord, r.text, r.bibliography, r.error) for r in got.collect()], key=str)
    assert rows == sorted([(1, 0, "[1, p. 4]", "[1] A, n.d.\n[2] B, n.d.", None), (1, 1, "[2]", None, None), (2, 0, None, None, "the document has 2 libraries"), (3, 0, None, None, "the document has no library"), (None, 0, "[1]", "[1] N, n.d.", None), (4, 2, None, None, "a citation has no key"), (4, None, None, None, "a citation has no key")], key=str)
