"""Registered queries over untidy sources: formatting options, duplicates, keys, raw blocks, recovery, local objects.

Each order gives one source in which every kind of block and value occurs; the
SQL builds the expected text piece by piece.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import api, runtime, sources
from marginalia import functions as B
from marginalia import operators as O
from marginalia.runtime import table

#: What a mark in a template stands for: Spark column and SQL expression over orders.
_MARKS = {
    "«k»": (F.col, "o_orderkey", "o_orderkey"),
    "«c»": (F.col, "o_custkey", "o_custkey"),
    "«y»": (F.col, "yr", "year(o_orderdate)"),
    "«m»": (F.col, "mon", "month(o_orderdate)"),
}


def _pieces(template: str) -> list[str]:
    for mark in _MARKS:
        template = template.replace(mark, f"\0{mark}\0")
    return [piece for piece in template.split("\0") if piece]


def _text(template: str) -> Column:
    """A template's text as a Spark column of orders."""
    return F.concat(*[F.col(_MARKS[p][1]).cast("string") if p in _MARKS else F.lit(p) for p in _pieces(template)])


def _sql(template: str) -> str:
    """A template's text as a SQL expression of orders."""
    quoted = [_MARKS[p][2] if p in _MARKS else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in _pieces(template)]
    return "('' || " + " || ".join(quoted) + ")"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime.ship(spark)
    return table(spark, sf_dir, "orders", spread=True).select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mon"))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, template: str, column, expected: str, more: str = "", alias: str = "value") -> None:
    """A query of one column over each order's source, and the SQL of its value."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return orders(spark, sf_dir).withColumn("bibtex", _text(template)).select("o_orderkey", column().alias(alias))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT o_orderkey, {expected} AS {alias} FROM orders{more}"


# ---- formatting ----------------------------------------------------------

ODD = """% note é «k»
@STRING{jq = "Quiet"}
@ARTICLE{O«k», author = {Müller, Ä. and {de Souza} Lima, Ana and Smith, Jr., John}, title = {CAFÉ XIV ÜBER «k»}, abstract = "Long words of order «k», which go on for quite a while until the line is full.", month = «m», journal = jq # { Annals}, year = «y», note = {50% & more}}
"""
_HEAD, _COMMENT = '@string{jq = "Quiet"}\n', "% note é «k»\n"
_AUTHOR = r'  author        = {M\"{u}ller, \"{A}. and {de Souza} Lima, Ana and Smith, Jr., John},' + "\n"
_ABSTRACT = '  abstract      = "Long words of order «k», which go on for quite a while until the line is full.",\n'
_REST = "  month         = «m»,\n  journal       = jq # { Annals},\n"


def _odd(comment=_COMMENT, key="O«k»", author=_AUTHOR, title=r"{CAF\'{E} XIV \"{U}BER «k»}", abstract=_ABSTRACT, year="«y»", note=r"{50\% \& more}", gap="") -> str:
    return f"{comment}{_HEAD}{gap}@article{{{key},\n{author}  title         = {title},\n{abstract}{_REST}  year          = {year},\n  note          = {note}\n}}\n"


def _tidied(name: str, expected: str, template: str = ODD, **options) -> None:
    _register(name, template, lambda: B.tidy_bibtex("bibtex", **options), _sql(expected), alias="bibtex")


_tidied("tidy_escape", _odd())
_tidied("tidy_no_escape", _odd(author="  author        = {Müller, Ä. and {de Souza} Lima, Ana and Smith, Jr., John},\n", title="{CAFÉ XIV ÜBER «k»}", note="{50% & more}"), escape=False)
_tidied("tidy_drop_all_caps", _odd(title=r"{Caf\'{e} XIV \"{U}ber «k»}"), drop_all_caps=True)
_tidied("tidy_strip_comments", _odd(comment=""), strip_comments=True)
_tidied("tidy_keep_comments", _odd(), tidy_comments=False)
_tidied("tidy_blank_lines", _odd(gap="\n"), blank_lines=True)
_tidied(
    "tidy_wrap",
    _odd(
        author="  author        = {\n" + r'    M\"{u}ller, \"{A}. and {de Souza} Lima, Ana and' + "\n    Smith, Jr., John\n  },\n",
        abstract="  abstract      = {\n    Words which go on for quite a while until the\n    line is full and one more begins, which is the\n    last of them.\n\n    A new paragraph «k».\n  },\n",
        title="{T}",
        year="{«y»}",
    ),
    ODD.replace("Long words of order «k», which go on for quite a while until the line is full.", "Words which go on for quite a while until the line is full and one more begins, which is the last of them.\n\n A new paragraph «k».").replace("{CAFÉ XIV ÜBER «k»}", "{T}"),
    wrap=52,
    curly=True,
)
_tidied("tidy_strip_enclosing_braces", "@misc{a«k»,\n  title         = {Whole «k»},\n  note          = {{Part} «k»}\n}\n", "@misc{a«k», title={{Whole «k»}}, note={{Part} «k»}}", strip_enclosing_braces=True)
_tidied("tidy_expressions", "@string{q = {Q «k»}}\n@misc{a«k»,\n  journal       = q # \" and \" # {more},\n  month         = jan,\n  note          = {x}\n}\n", '@string{q = {Q «k»}}@misc{a«k», journal = q # " and " # {more}, month = jan, note = {x}}')
_tidied("tidy_sort_fields_listed", "@misc{a«k»,\n  year          = {«y»},\n  title         = {T},\n  zz            = {1},\n  author        = {A}\n}\n", "@misc{a«k», zz={1}, title={T}, author={A}, year={«y»}}", sort_fields=["year", "title"])
_tidied("tidy_special_first", "@string{s = {v}}\n@xdata{x,\n  note          = {1}\n}\n@misc{b«k»,\n  year          = {2}\n}\n@misc{a«k»,\n  year          = {1}\n}\n", "@misc{a«k», year={1}}\n@misc{b«k», year={2}}\n@string{s = {v}}\n@xdata{x, note={1}}\n", sort=["special", "-year"])

# ---- keys ----------------------------------------------------------------

_tidied("keys_from_markers", _odd(key="müllerMüllerEtAlMüllerSouzaLimaEtAlCAFÉXIVÜBER«y»"), generate_keys="[auth:lower]_[authEtAl][authors2]_[shorttitle:capitalize][year:required][duplicateLetter]")
_tidied("keys_from_fields", _odd(key="CAFÉXIVÜBER«k»CAFÉXIVÜBER«k»JQ"), generate_keys="[title][fulltitle:upper]JQ")
_register("keys_with_letters", "@misc{x, author={Lund, A}, title={Tides}, year={«y»}}\n@misc{y, author={Lund, B}, title={Tides}, year={«y»}}\n@misc{z, title={No author}, year={«y»}}", lambda: F.array_join(B.keys(B.tidy_bibtex("bibtex", generate_keys="[auth:required:lower][year][duplicateLetter]")), ","), _sql("lund«y»a,lund«y»b,z"))
_register("keys_with_numbers", "@misc{x, author={Lund, A}, title={The {Big} Tides}, year={«y»}}\n@misc{y, author={Jan van Lund}, title={Big waves}, year={«y»}}", lambda: F.array_join(B.keys(B.tidy_bibtex("bibtex", generate_keys=True)), ","), _sql("lund«y»big1,lund«y»big2"))
_register("keys_without_unsafe_characters", "@misc{x, author={O'Brien, A}, title={C# = {50%}, (x) ~ #«k»}, year={«y»}}", lambda: F.array_join(B.keys(B.tidy_bibtex("bibtex", generate_keys="[auth][fulltitle]")), ","), _sql("OBrienC50x«k»"))

# ---- duplicates ----------------------------------------------------------

PAIRS = "@misc{a«k», doi={10/X.«k»}, author={Ann B Lund and C D}, title={The T}, abstract={Same words, of «k»}}\n@misc{b«k», doi={10-x«k»}, note={N}}\n@misc{c«k», author={Lund, Zoe}, title={the t!}, number={0}}\n@misc{d«k», abstract={same words of «k»}}\n@misc{A«k», title={U}}\n"


def _warned(**options):
    return lambda: F.array_join(F.transform(B.tidy_bibtex_report("bibtex", **options)["warnings"], lambda w: F.concat_ws("|", w["code"], w["rule"], w["message"])), ";")


_register("duplicate_rules", PAIRS, _warned(duplicates=["doi", "citation", "abstract", "key"]), _sql("duplicate_entry|doi|Duplicate detected. Entry b«k» has an identical DOI to entry a«k».;duplicate_entry|abstract|Duplicate detected. Entry d«k» has a similar abstract to entry a«k».;duplicate_entry|key|Duplicate detected. The citation key A«k» has already been used."))
_register("duplicate_citation_rule", PAIRS.replace("Ann B Lund", "Ann Lund"), _warned(duplicates=["citation"], merge="first"), _sql("duplicate_entry|citation|Duplicate removed. Entry c«k» has similar content to entry a«k».;duplicate_entry|key|Duplicate detected. The citation key A«k» has already been used."))
_register("missing_key_warning", "@misc{, title={«k»}}", _warned(), _sql("missing_key|misc entry does not have a citation key."))
_MERGED = "@misc{a, doi={10/x}, title={First «k»}}\n@misc{b, doi={10/X}, title={Second}, note={N «k»}}\n@misc{c, note={n}, abstract={Z}}\n"
_LAST = "@misc{c,\n  note          = {n},\n  abstract      = {Z}\n}\n"
_tidied("merge_first", "@misc{a,\n  doi           = {10/x},\n  title         = {First «k»}\n}\n" + _LAST, _MERGED, merge="first")
_tidied("merge_last", "@misc{b,\n  doi           = {10/X},\n  title         = {Second},\n  note          = {N «k»}\n}\n" + _LAST, _MERGED, merge="last")
_tidied("merge_combine", "@misc{a,\n  doi           = {10/x},\n  title         = {First «k»},\n  note          = {N «k»}\n}\n" + _LAST, _MERGED, merge="combine")
_tidied("merge_overwrite", "@misc{a,\n  doi           = {10/X},\n  title         = {Second},\n  note          = {N «k»}\n}\n" + _LAST, _MERGED, merge="overwrite")
_tidied("merge_chain", "@misc{a,\n  doi           = {10/x},\n  abstract      = {W «k»},\n  note          = {N}\n}\n", "@misc{a, doi={10/x}}\n@misc{b, doi={10/X}, abstract={W «k»}}\n@misc{c, abstract={w «k»}, note={N}}\n", duplicates=["doi", "abstract"], merge="combine")

# ---- raw sources ---------------------------------------------------------

RAW = '% note «k»\n@comment{kept «k»}\n@comment line «k»\n@preamble{"P" # {Q}}\n@string(m = {v «k»})\n@misc{a«k», x = {1 {b}}, y = "2", z = tok, w = m # { «y»}, x = {é}}\nloose «k»\n@broken{«k»\n'
_BLOCKS = [("comment", "% note «k»"), ("comment", "@comment{kept «k»}"), ("comment", "@comment line «k»"), ("preamble", '@preamble{"P" # {Q}}'), ("string", "@string(m = {v «k»})"), ("entry", '@misc{a«k», x = {1 {b}}, y = "2", z = tok, w = m # { «y»}, x = {é}}'), ("other", "loose «k»\n"), ("failed", "@broken{«k»\n")]


def raw_block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.explode_blocks(orders(spark, sf_dir).withColumn("bibtex", _text(RAW)).select("o_orderkey", "bibtex"))
    return rows.filter("kind <> 'whitespace'").select("o_orderkey", "kind", "raw", (F.col("span_end") - F.col("span_start")).cast("bigint").alias("size"))


def raw_value_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.explode_fields(orders(spark, sf_dir).withColumn("bibtex", _text(RAW)).select("o_orderkey", "bibtex"), columns=("key", "kind", "field_no", "name", "value", "value_mode", "atoms"))
    atoms = F.array_join(F.transform("atoms", lambda a: F.concat(a["value_mode"], F.lit(":"), a["value"])), "+")
    return rows.select("o_orderkey", "key", "kind", F.col("field_no").cast("bigint").alias("field_no"), "name", "value", "value_mode", atoms.alias("atoms"))


_FIELDS = [("x", "1 {b}", "Braced", "Braced:1 {b}"), ("y", "2", "Quoted", "Quoted:2"), ("z", "tok", "Bare", "Bare:tok"), ("w", "m # { «y»}", "Expression", "Bare:m+Braced: «y»"), ("x", "é", "Braced", "Braced:é")]
QUERIES |= {"raw_block_kinds": raw_block_kinds, "raw_value_modes": raw_value_modes}
ORACLE_SQL |= {
    "raw_block_kinds": " UNION ALL ".join(f"SELECT o_orderkey, '{kind}' AS kind, {_sql(raw)} AS raw, CAST(strlen({_sql(raw)}) AS BIGINT) AS size FROM orders" for kind, raw in _BLOCKS),
    "raw_value_modes": " UNION ALL ".join(f"SELECT o_orderkey, {_sql('a«k»')} AS key, 'misc' AS kind, CAST({n} AS BIGINT) AS field_no, '{name}' AS name, {_sql(value)} AS value, '{mode}' AS value_mode, {_sql(atoms)} AS atoms FROM orders" for n, (name, value, mode, atoms) in enumerate(_FIELDS)),
}

EDITED = '@misc{a«k», x = {1}, y = "2", z = tok, w = m # {v}, x = {twice}} % tail'


def _edits() -> Column:
    """Five edits, one in each mode, then six that would corrupt the source."""
    source = F.col("bibtex")
    for name, value in (("x", "{NASA} «k»"), ("y", "{ESA} x"), ("z", "{JAXA} x"), ("w", "one"), ("z", "tok-2")):
        source = B.set_field(source, _text("a«k»"), F.lit(name), _text(value))
    refused = [F.coalesce(B.set_field("bibtex", _text("a«k»"), F.lit(name), F.lit(value)), F.lit("refused")) for name, value in (("x", "a}{b"), ("x", "end\\"), ("y", 'say "x"'), ("z", "{open"), ("w", "50%"), ("no", "x"))]
    return F.concat_ws("|", source, *refused)


_register("set_field_modes", EDITED, _edits, _sql('@misc{a«k», x = {{NASA} «k»}, y = "{ESA} x", z = {tok-2}, w = {one}, x = {twice}} % tail' + "|refused" * 6))

# ---- reading and recovery ------------------------------------------------

GOOD = "@article{good«k», author={Lund, A}, title={Kept}, year={«y»}}\n"
#: A defect, the keys left, and what is said of it once its place is taken out.
BROKEN = [
    ("@broken{x,\n  title = {No close}\n", "good«k»", "ignored malformed BibTeX block at #: entry ended before closing delimiter"),
    ("@article{bad,\n  title = ,\n  year = {2024}\n}\n", "good«k»", 'ignored BibTeX entry "bad" at # because syntax validation failed: field "title" has no value'),
    ("@article{bad,\n  -title = {Bad}\n}\n", "good«k»", 'ignored BibTeX entry "bad" at # because syntax validation failed: field name "-title" is not an identifier'),
    ("@article{m, journal = JMLR # { X}, month = {16}}\n", "good«k»,m", 'syntax recovery could not pre-filter BibTeX entries after parse error: unknown abbreviation "JMLR" in entry "m";ignored BibTeX field "month" in entry "m" because value "16" is not valid for normalization'),
    ("@string{badstring}\n@article{m, year=1999}\n", "good«k»,m", 'syntax recovery could not pre-filter BibTeX entries after parse error at #: the definition has no value;ignored string definition "" at # during literal recovery'),
    ("@article{good«k», title={Again}}\nloose text\n", "good«k»", 'ignored duplicate BibTeX entry key "good«k»" at #;ignored raw BibTeX text at #'),
    ("@misc{d, date={soon}, day={0}}\n", "good«k»,d", 'ignored BibTeX field "date" in entry "d" because type conversion failed: invalid date "soon";ignored BibTeX field "day" in entry "d" because value "0" is not valid for normalization'),
]


def recovery_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order once with every defect."""
    variants = F.array(*[F.struct(F.lit(n).cast("bigint").alias("variant"), _text(GOOD + bad).alias("bibtex")) for n, (bad, _, _) in enumerate(BROKEN)])
    each = orders(spark, sf_dir).select("o_orderkey", F.explode(variants).alias("v")).select("o_orderkey", "v.variant", "v.bibtex")
    told = each.select("o_orderkey", "variant", B.recovery_report("bibtex").alias("r"))
    said = F.regexp_replace(F.array_join("r.diagnostics", ";"), r"\d+\.\.\d+", "#")
    return told.select("o_orderkey", "variant", "r.strict_ok", "r.ok", F.array_join("r.keys", ",").alias("keys"), said.alias("diagnostics"))


QUERIES["recovery_stages"] = recovery_stages
ORACLE_SQL["recovery_stages"] = " UNION ALL ".join(f"SELECT o_orderkey, CAST({n} AS BIGINT) AS variant, false AS strict_ok, true AS ok, {_sql(keys)} AS keys, {_sql(said)} AS diagnostics FROM orders" for n, (_, keys, said) in enumerate(BROKEN))

RICH = "@string{jl = \"Jour\"}\n@xdata{x«k», publisher={House}}\n@incollection{a«k», xdata={x«k»}, crossref={p«k»}, author={M{\\\"u}ller, Jr., Jan and {The Group}}, title={On {\\ss} -- \\'etudes}, pages={1-20}, year=«y», month=«m», doi={https://doi.org/10.5/«k»}, url={http://x/a\\_b}}\n@collection{p«k», title={Whole}, editor={Ed, A}, volume=3}"
_register(
    "entry_json_rich",
    RICH,
    lambda: F.get_json_object(B.to_entry_json("bibtex"), "$[0]"),
    _sql('{"author":["Müller, Jr., Jan","The Group"],"date":"«y»-') + " || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || " + _sql('","id":"a«k»","key":"a«k»","page-range":"1-20","parent":{"editor":"Ed, A","title":"Whole","type":"anthology","volume":"3"},"publisher":"House","serial-number":{"doi":"10.5/«k»"},"title":"On ß – études","type":"anthos","url":"http://x/a_b"}'),
)
YAML = "a«k»:\n  type: article\n  title: {value: T «k», short: t}\n  author: [\"Lund, Jonna\", {name: Rask, given-name: R}]\n  date: «y»\n  url: {value: http://x, date: 2020-09-17}\n  parent: {type: periodical, title: J, volume: 3}\nb:\n  type: video\n  title: V\n"
_register("yaml_entry_json", YAML, lambda: B.yaml_to_entry_json("bibtex"), _sql('[{"author":["Lund, Jonna","Rask, R"],"date":"«y»","id":"a«k»","key":"a«k»","parent":{"title":"J","type":"periodical","volume":"3"},"title":{"short":"t","value":"T «k»"},"type":"article","url":{"date":"2020-09-17","value":"http://x"}},{"id":"b","key":"b","title":"V","type":"video"}]'))
_register("yaml_keys", YAML, lambda: (lambda report: F.concat_ws("|", report["entry_count"].cast("string"), F.array_join(report["keys"], ",")))(B.yaml_report("bibtex")), _sql("2|a«k»,b"))
_register("yaml_failure", "a: [«k»", lambda: B.yaml_report("bibtex")["ok"].cast("string"), "'false'")


def yaml_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = orders(spark, sf_dir).withColumn("yaml", _text(YAML)).select("o_orderkey", B.yaml_entries("yaml", fields=("key", "title", "volume")).alias("e"))
    return held.select("o_orderkey", F.posexplode_outer("e").alias("n", "e")).select("o_orderkey", "e.key", "e.title", "e.volume")


def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written as bibliography files into the shared folder and read back as files."""
    folder = runtime.scratch(spark, "files")
    sources.write_bibliography(orders(spark, sf_dir).select(_text(GOOD).alias("bibtex")), folder, extension="bib")
    read = sources.read_bibliography(spark, folder)
    return O.explode_entries(read.select("bibtex", "format"), fields=("key", "title"), outer=False).select("format", "key", "title")


QUERIES |= {"yaml_entries": yaml_entries, "files_round_trip": files_round_trip}
ORACLE_SQL |= {
    "yaml_entries": f"SELECT o_orderkey, {_sql('a«k»')} AS key, {_sql('T «k»')} AS title, '3' AS volume FROM orders UNION ALL SELECT o_orderkey, 'b', 'V', NULL FROM orders",
    "files_round_trip": f"SELECT 'bib' AS format, {_sql('good«k»')} AS key, 'Kept' AS title FROM orders",
}

# ---- styles, locales, trees ----------------------------------------------

STYLE = "<style xmlns='http://purl.org/net/xbiblio/csl' version='1.0'><info><title>t</title><id>i</id></info><macro name='who'><names variable='author'><name form='short' and='text'/><substitute><text variable='title'/></substitute></names></macro><citation><layout prefix='&lt;' suffix='&gt;' delimiter='; '><text macro='who' font-style='italic'/><date variable='issued' prefix=' '><date-part name='year'/></date></layout></citation><bibliography><sort><key variable='title'/></sort><layout suffix='.'><text variable='citation-number' suffix=' '/><text variable='title' quotes='true'/></layout></bibliography></style>"
TWO = "@misc{b«k», author={Lund, A and Rask, R}, title={Beta}, year={«y»}}\n@article{a«k», title={Alpha «k»}, journal={J}, pages={3--«k»}, year={«y»}}\n"
_BOTH = lambda: F.array(_text("b«k»"), _text("a«k»"))
_register("cite_xml_style", TWO, lambda: B.cite_group_html("bibtex", _BOTH(), style=STYLE), _sql("&lt;<i>Lund and Rask</i> «y»; <i>Alpha «k»</i> «y»&gt;"))
_register("bibliography_xml_style", TWO, lambda: B.full_bibliography_text("bibtex", style=STYLE), _sql("1 “Alpha «k»”.\n2 “Beta”."))
_register("cite_locale", TWO, lambda: B.cite_group("bibtex", _BOTH(), style="chicago-author-date", locale="de-DE"), _sql("(Lund und Rask «y»; Alpha «k» «y»)"))
_register("bibliography_locale", TWO, lambda: B.full_bibliography_text("bibtex", style="ieee", locale="de-DE"), _sql("[1] A. Lund und R. Rask, Beta, «y».\n[2] “Alpha «k»,” J, S. 3–«k», «y»."))
_register("bibliography_html_margin", TWO, lambda: B.full_bibliography_html("bibtex", style="ieee"), _sql('<div class="csl-entry" data-key="b«k»"><div class="csl-left-margin">[1]</div><div class="csl-right-inline">A. Lund and R. Rask, <i>Beta</i>, «y».</div></div><div class="csl-entry" data-key="a«k»"><div class="csl-left-margin">[2]</div><div class="csl-right-inline">“Alpha «k»,” <i>J</i>, pp. 3–«k», «y».</div></div>'))

THREE = "@article{a«k», author={Lund, Anna and Rask, R}, title={Alpha «k»}, journal={J}, volume={7}, number={2}, pages={3--9}, year={«y»}, month=mar, doi={10.5/«k»}}\n@book{b«k», author={Lund, Berit}, title={Beta}, publisher={House}, year={«y»}}\n@book{c«k», author={Lund, Anna and Rask, R}, title={Gamma}, publisher={House}, year={«y»}}\n"
#: Of each bundled style of this language: a citation of three works as HTML, and the bibliography as text.
BUNDLED = {
    "vancouver": "(1–3)|1. Lund A, Rask R. Alpha «k». J. «y»;7(2):3–9. doi:10.5/«k»\n2. Lund B. Beta. House; «y».\n3. Lund A, Rask R. Gamma. House; «y».",
    "nature": "<sup>1–3</sup>|1. Lund, A. & Rask, R. Alpha «k». J 7, 3–9 («y»).\n2. Lund, B. Beta. (House, «y»).\n3. Lund, A. & Rask, R. Gamma. (House, «y»).",
    "american-medical-association": "<sup>1–3</sup>|1. Lund A, Rask R. Alpha «k». J. «y»;7(2):3–9. doi:10.5/«k»\n2. Lund B. Beta. House; «y».\n3. Lund A, Rask R. Gamma. House; «y».",
    "harvard-cite-them-right": "(Lund and Rask, «y»b, «y»a; Lund, «y»)|Lund, A. and Rask, R. («y»a) Gamma. House.\nLund, A. and Rask, R. («y»b) ‘Alpha «k»’, J, 7(2), pp. 3–9. Available at: https://doi.org/10.5/«k».\nLund, B. («y») Beta. House.",  # a year stands before its months
    "modern-language-association": "(Lund and Rask <i>Alpha «k»</i>; Lund; Lund and Rask <i>Gamma</i>)|Lund, Anna, and R Rask. “Alpha «k».” J, vol. 7, no. 2, Mar. «y», pp. 3–9, https://doi.org/10.5/«k».\n---. Gamma. House, «y».\nLund, Berit. Beta. House, «y».",
}
_ALL = lambda: F.array(_text("a«k»"), _text("b«k»"), _text("c«k»"))


def _styled(of: str) -> Column:
    shown = B.cite_and_list("bibtex", _ALL(), style=of)
    return F.concat_ws("|", shown["citation"]["html"], shown["bibliography"]["text"])


for _style, _shown in BUNDLED.items():
    _register("style_" + _style.replace("-", "_"), THREE, lambda of=_style: _styled(of), _sql(_shown))
DATED = "<style xmlns='http://purl.org/net/xbiblio/csl' version='1.0'><info/><citation disambiguate-add-givenname='true' givenname-disambiguation-rule='primary-name' collapse='year-suffix' disambiguate-add-year-suffix='true'><layout delimiter='; '><group delimiter=' '><names variable='author'><name form='short' and='text'><name-part name='family' font-variant='small-caps'/></name></names><date variable='issued' form='text' date-parts='year-month'/></group></layout></citation></style>"
_SC = '<span style="font-variant: small-caps;">'
_register("cite_xml_given_names", THREE, lambda: B.cite_group_html("bibtex", _ALL(), style=DATED, locale="de-DE"), _sql(f"Anna {_SC}Lund</span> und {_SC}Rask</span> März «y», «y»; Berit {_SC}Lund</span> «y»"))


def _local(work, returns: str = "string"):
    return lambda: F.udf(work, returns, useArrow=True)("bibtex")


def _tree(source: str) -> str:
    doc = api.Document(api.Library.parse_bibtex(source), "ieee")
    keys = doc.library.keys()
    got = doc.render([api.Citation("1", keys[0])])
    entry = got.bibliography.tree[0]
    kinds = [n["kind"] + ":" + n["text"] + ":" + n["formatting"]["font_style"] for n in entry["children"][1:]]
    cited = got["1"].tree[0]
    return "|".join([cited["kind"], cited["meta"], cited["children"][0]["meta"], cited["children"][0]["children"][0]["text"], entry["kind"], entry["key"], entry["first_field"]["meta"], *kinds])


IBID = "<style xmlns='http://purl.org/net/xbiblio/csl' version='1.0'><info/><citation><layout><choose><if position='ibid-with-locator'><text value='Ibid at '/><text variable='locator'/></if><else-if position='ibid'><text value='Ibid'/></else-if><else-if position='subsequent'><text value='See '/><text variable='title'/></else-if><else><text variable='title'/></else></choose></layout></citation></style>"


def _places(source: str) -> str:
    doc = api.Document(api.Library.parse_bibtex(source), api.Style.from_xml(IBID))
    a, b, _ = doc.library.keys()
    cited = [api.Cite(a), api.Cite(a), api.Cite(a, "4"), api.Cite(a, "4"), api.Cite(b), api.Cite(a)]
    got = doc.render([api.Citation(str(i), c) for i, c in enumerate(cited)])
    return "|".join([got[str(i)].text for i in range(len(cited))])


_register("cite_xml_positions", THREE, _local(_places), _sql("Alpha «k»|Ibid|Ibid at 4|Ibid|Beta|See Alpha «k»"))
_register("render_tree", TWO, _local(_tree), _sql("Element|Entry|CitationNumber|[1]|bibliography-entry|b«k»|CitationNumber|Text:A. Lund and R. Rask, :Normal|Text:Beta:Italic|Text:, «y».:Normal"))


def _library(source: str) -> str:
    lib = api.Library.parse_bibtex(source)
    keys = lib.keys()
    first = lib[keys[0]]
    return json.dumps([keys, len(lib), keys[1] in lib, "zz" in lib, lib.get("zz", "none"), [r.title for r in lib.get_many(reversed(keys))], [r.key for r in lib.values()], [r.key for r in lib.select("article > periodical")], lib.project(["key", "entry_type"], keys=keys[1:]), lib.to_dicts()[0]["title"], [first.key, first.entry_type, first.volume, first.doi, [n.family for n in first.authors]], lib.diagnostics, lib.is_empty()])


_register("local_library", TWO, _local(_library), _sql('[["b«k»", "a«k»"], 2, true, false, "none", ["Alpha «k»", "Beta"], ["b«k»", "a«k»"], ["a«k»"], [{"key": "a«k»", "entry_type": "Article"}], "Beta", ["b«k»", "Misc", null, null, ["Lund", "Rask"]], [], false]'))


def _document(source: str) -> str:
    lib = api.Library.parse_bibtex(source)
    doc = api.Document(lib, api.Style.load("apa"), api.Locale.load("en-US"))
    b, a = lib.keys()
    got = doc.render([api.Citation("one", api.Cite(a, "3", "figure")), api.Citation("two", api.CitationGroup([b, api.Cite(a, "1-2")]))])
    return "\n".join([got["one"].text, got["two"].html, *got.citation_order, got.bibliography.text, doc.cited_bibliography(api.Citation("x", b)).text, doc.full_bibliography().html])


_register("local_document", TWO, _local(_document), _sql("(“Alpha «k»”, «y», fig. 3)\n(“Alpha «k»”, «y», pp. 1-2; Lund &amp; Rask, «y»)\none\ntwo\n(«y»). Alpha «k». J, 3–«k».\nLund, A., &amp; Rask, R. («y»). Beta.\nLund, A., &amp; Rask, R. («y»). Beta.\n".replace("Lund, A., &amp; Rask, R. («y»). Beta.", "Lund, A., & Rask, R. («y»). Beta.") + '<div class="csl-entry" data-key="a«k»">(«y»). Alpha «k». <i>J</i>, 3–«k».</div><div class="csl-entry" data-key="b«k»">Lund, A., &amp; Rask, R. («y»). <i>Beta</i>.</div>'))


def _raw(source: str) -> str:
    doc = api.BibDocument.parse(source)
    entry = doc.entries.values()[0]
    kept = [len(doc.blocks), len(doc.failed_blocks), doc.comments, doc.preamble, doc.strings, doc.occurrence_keys(), len(doc), entry.get("Y"), [f.value for f in entry.get_all("x")], entry.key in doc.entries]
    doc.set_field(entry.key, "x", "second", 1)
    return json.dumps([kept, doc.to_bibtex() == source.replace("é", "second")], ensure_ascii=False)


_register("local_raw_document", RAW, _local(_raw), _sql('[[14, 1, ["note «k»", "kept «k»", "line «k»"], "\\"P\\" # {Q}", {"m": "v «k»"}, ["a«k»"], 1, "2", ["1 {b}", "é"], true], true]'))


def number_by_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = O.number_by_sort(orders(spark, sf_dir), "o_custkey", ["-yr"], "o_orderkey")
    return numbered.select("o_orderkey", F.col("number").cast("bigint").alias("number"))


def sort_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all customers' balances, largest first, after a total sort."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return O.sort_entries(customers, ["c_nationkey", "-c_acctbal"], "c_custkey")


def explode_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every source, sources that do not parse included."""
    held = orders(spark, sf_dir).withColumn("bibtex", F.when(F.col("o_orderkey") % 3 == 0, _text(GOOD + "@broken{")).otherwise(_text(GOOD)))
    return O.explode_entries(held.select("o_orderkey", "bibtex"), fields=("key", "title"))


def dedupe_citation_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("author"), F.col("p_type").alias("title"), F.col("p_size").cast("string").alias("number"))
    return O.dedupe_entries(parts, [], "p_partkey", value=O.duplicate_value("citation")).select("p_partkey")


QUERIES |= {"number_by_sort": number_by_sort, "sort_entries": sort_entries, "explode_outer": explode_outer, "dedupe_citation_rule": dedupe_citation_rule}
ORACLE_SQL |= {
    "number_by_sort": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey) AS number FROM orders",
    "sort_entries": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    "explode_outer": f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN {_sql('good«k»')} END AS key, CASE WHEN o_orderkey % 3 <> 0 THEN 'Kept' END AS title FROM orders",
    "dedupe_citation_rule": "SELECT min(p_partkey) AS p_partkey FROM part GROUP BY lower(regexp_replace(CASE WHEN p_brand LIKE '% %' THEN substr(p_brand, strpos(p_brand, ' ') + 1) ELSE p_brand END, '[^a-zA-Z0-9]', '', 'g')), lower(regexp_replace(p_type, '[^a-zA-Z0-9]', '', 'g')), p_size",
}
