import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.core import cite, library
from marginalia.core.scan import scan, set_field
from marginalia.core.tidy import TidyOptions, TidySyntaxError, tidy

ARTICLE = "@article{lund2024, author={Lund, Jonna}, title={Tidal Ledgers}, journal={Annals of Quiet Harbours}, year=2024, volume=12, pages={1--20}, doi={10.5555/quiet.7}}"
BOOK = "@book{rask2022, author={Rask, Rafael}, title={Shelves at Sea}, publisher={Lantern House}, year={2022}}"
pieces = st.sampled_from(["@article{a,", "title={x}", "}", "{", '"', "%", "@", "\n", " ", "#", ",", "=", "@comment", "\\", "é", "@string{m={v}}", "(", ")"])


@given(st.lists(pieces, max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_blocks_join_to_the_source(text):
    assert "".join(b.raw for b in scan(text)) == text


def test_block_kinds():
    text = '% note\n@string{m = "v"}\n@preamble{{abc}}\n@article{k, a={1}, a={2}}\nloose\n@broken{'
    assert [b.kind for b in scan(text) if b.kind != "whitespace"] == ["comment", "string", "preamble", "entry", "other", "failed"]


def test_tidy_defaults_and_idempotence():
    out = tidy("@ARTICLE {k,\n number={1}, pages={6-13},author=\"A B\",}").bibtex
    assert out == '@article{k,\n  number        = {1},\n  pages         = {6--13},\n  author        = "A B"\n}\n'
    assert tidy(out).bibtex == out


@given(st.text(alphabet="abc {}$&#é\n-", max_size=30))
@settings(max_examples=150, deadline=None)
def test_tidy_settles(value):
    try:
        once = tidy("@misc{k, note={" + value + "}}").bibtex
    except TidySyntaxError:
        return
    assert tidy(once, TidyOptions(escape=False)).bibtex == once


@pytest.mark.parametrize("options, error", [({"space": True}, TypeError), ({"sort": "key"}, TypeError), ({"merge": "x"}, ValueError), ({"duplicates": ["x"]}, ValueError), ({"nope": 1}, ValueError), ({"generate_keys": "[bad]"}, ValueError), ({"space": -1}, ValueError)])
def test_tidy_options_are_checked(options, error):
    with pytest.raises(error):
        TidyOptions.check(**options)


def test_merge_and_warnings():
    text = "@misc{a, doi={10/X}, title={T}}\n@misc{b, doi={10/x}, note={N}}\n@misc{, title={U}}"
    got = tidy(text, TidyOptions.check(merge="combine"))
    assert "note" in got.bibtex and "@misc{b" not in got.bibtex and got.count == 3
    assert [w.code for w in got.warnings] == ["MISSING_KEY", "DUPLICATE_ENTRY"]


def test_syntax_error_position():
    with pytest.raises(TidySyntaxError) as error:
        tidy("é\n @broken{")
    assert (error.value.line, error.value.column, error.value.byte, error.value.character) == (2, 2, 4, 3)


def test_keys_and_sorting():
    text = "@misc{b, author={Lund, J}, year={2020}, title={The Best}}\n@misc{a, author={Lund, J}, year={2020}, title={The Best}}"
    got = tidy(text, TidyOptions.check(generate_keys=True, sort=["-key"])).bibtex
    assert got.index("lund2020best2") < got.index("lund2020best1")


def test_citations_and_bibliographies():
    lib = library.parse_bibtex(ARTICLE + BOOK)
    assert cite.cite_group(lib, [cite.Cite("lund2024", "12"), cite.Cite("rask2022")], "apa").text == "(Lund, 2024, p. 12; Rask, 2022)"
    assert cite.bibliography(lib.records[1:], "apa")[0] == "Rask, R. (2022). Shelves at Sea. Lantern House."
    assert cite.bibliography(lib.records[:1], "ieee")[0] == "[1] J. Lund, “Tidal Ledgers,” Annals of Quiet Harbours, vol. 12, pp. 1–20, 2024, doi: 10.5555/quiet.7."
    assert '<a href="https://doi.org/10.5555/quiet.7">' in cite.bibliography(lib.records[:1], "apa")[1]
    shown = cite.bibliography(lib.records[:1], "ieee").tree[0]
    assert shown["kind"] == "bibliography-entry" and shown["key"] == "lund2024" and shown["first_field"]["meta"] == "CitationNumber" and shown["children"][0] is shown["first_field"]
    texts = [n for n in shown["children"][1:] if n["kind"] == "Text"]
    assert shown["first_field"]["children"][0]["text"] == "[1]" and [n["text"] for n in texts if n["formatting"]["font_style"] == "Italic"] == ["Annals of Quiet Harbours"]
    assert [n["url"] for n in shown["children"] if n["kind"] == "Link"] == ["https://doi.org/10.5555/quiet.7"]
    one = cite.cite_group(lib, [cite.Cite("lund2024")], "ieee").tree[0]
    assert one["kind"] == "Element" and one["meta"] == "Entry" and one["children"][0]["meta"] == "CitationNumber"
    assert set(one["children"][0]["children"][0]["formatting"]) == {"font_style", "font_variant", "font_weight", "text_decoration", "vertical_align"}
    assert cite.cite_group(lib, [cite.Cite("nobody")], "apa") is None
    assert "href" not in cite.Rendered([("x", "", "javascript:alert(1)")]).html


def test_same_author_year_gets_letters():
    lib = library.parse_bibtex("@misc{a, author={Lund, J}, title={A}, year=2024}@misc{b, author={Lund, J}, title={B}, year=2024}")
    assert [r.text for r in cite.cite_each(lib, ["a", "b"], "apa")] == ["(Lund, 2024a)", "(Lund, 2024b)"]


def test_recovery():
    with pytest.raises(library.ParseFailure, match="parse error"):
        library.parse_bibtex(ARTICLE + "\n@broken{")
    got = library.parse_bibtex(ARTICLE + ARTICLE + "\n@misc{m, month=16, year={2020}}\n@broken{", strict=False)
    assert got.keys() == ["lund2024", "m"] and len(got.diagnostics) == 3
    with pytest.raises(library.ParseFailure):
        library.parse_bibtex("@broken{", strict=False)
    assert library.parse_bibtex("").records == [] and library.parse_bibtex("% x").records == []


def test_normalisation():
    lib = library.parse_bibtex('@xdata{x, publisher={P}}@book{b, xdata={x}, title={G{\\"o}del}, maintitle={Whole}, volume=1}')
    assert lib.records[0].title == "Gödel" and lib.records[0].fields["publisher"] == "P" and lib.records[0].volume == "1"
    assert [r.key for r in library.select(library.parse_bibtex(ARTICLE + BOOK), "article > periodical[volume]")] == ["lund2024"]
    with pytest.raises(ValueError, match="invalid selector"):
        library.select(lib, "article >")
    assert library.decode(b"caf\xe9")[0] == "café" and library.decode(b"caf\xe9")[1]


def test_yaml():
    lib = library.parse_yaml("k:\n  type: article\n  title: T\n  author: [Lund, Jonna]\n  parent: {type: periodical, title: J, volume: 3}\n")
    assert lib.records[0].volume == "3" and lib.records[0].entry_type == "Article"


def test_set_field_touches_nothing_else():
    text = "% c\n@misc{k,\n  a = {1}, b = \"2\", c = 3 }\ntail"
    assert set_field(text, "k", "A", "x") == text.replace("{1}", "{x}")
    assert set_field(text, "k", "b", '{q"q}') == text.replace('"2"', '{{q"q}}')
    assert set_field(text, "k", "c", "two words") == text.replace("= 3", "= {two words}")
    with pytest.raises(KeyError):
        set_field(text, "k", "d", "x")


@pytest.mark.parametrize("name, value, kind", [("a", "Bad } value", "braced"), ("a", "Bad { value", "braced"), ("a", "a}{b", "braced"), ("a", "Bad\\", "braced"), ("a", "100% sure", "braced"), ("a", "two\nlines", "braced"), ("b", 'say "x"', "quoted"), ("b", "Bad\\", "quoted"), ("b", "Bad }", "quoted"), ("c", "Bad { value", "braced"), ("c", "Bad\\", "braced"), ("d", "x", "assignment")])
def test_set_field_refuses_what_would_corrupt_the_source(name, value, kind):
    with pytest.raises(ValueError, match=kind):
        set_field('@misc{k, a = {1}, b = "2", c = tok, d}', "k", name, value)


def test_set_field_takes_balanced_values():
    text = '@misc{k, a = {1}, b = "2", c = tok, e = {1} # {2}}'
    assert set_field(text, "k", "a", "{NASA} and 5\\% \\}") == text.replace("a = {1}", "a = {{NASA} and 5\\% \\}}")
    assert set_field(text, "k", "b", "{ESA} x") == text.replace('"2"', '"{ESA} x"')
    assert set_field(text, "k", "c", "{JAXA} x") == text.replace("tok", "{{JAXA} x}")
    assert set_field(text, "k", "e", "one") == text.replace("{1} # {2}", "{one}")


GOOD = "@article{good, author={Lund, Jonna}, title={Kept}, year={2024}}\n"


@pytest.mark.parametrize("bad, said", [
    ("@broken{missing,\n  title = {No close}\n", "ignored malformed BibTeX block"),
    ("@bad\n", "ignored raw BibTeX text"),
    ("@article{bad,\n  title {No equals},\n  year = {2024}\n}\n", "ignored malformed BibTeX block"),
    ("@article{bad,\n  year = 2024\n  title = {Bad}\n}\n", "ignored malformed BibTeX block"),
    ("@article{bad,\n  title = ,\n  year = {2024}\n}\n", "because syntax validation failed"),
    ("@article{bad\n  title = {Bad},\n  year = {2024}\n}\n", "ignored"),
    ("@article{bad,\n  -title = {Bad},\n  year = {2024}\n}\n", "because syntax validation failed"),
    ("@article{bad,\n  title = Bad{Thing},\n  year = {2024}\n}\n", "ignored malformed BibTeX block"),
    ("@article{good, title={Again}}\n", "ignored duplicate BibTeX entry key"),
])
def test_recovery_leaves_out_what_is_broken(bad, said):
    with pytest.raises(library.ParseFailure, match="parse error"):
        library.parse_bibtex(GOOD + bad)
    got = library.parse_bibtex(GOOD + bad + ("@article{after, title={Later}}\n" if "close" in bad else ""), strict=False)
    assert got.keys() == (["good", "after"] if "close" in bad else ["good"]) and said in got.diagnostics[0] and "bad" not in got.keys()


def test_recovery_takes_values_literally():
    got = library.parse_bibtex("@article{m, author={Lund, Jonna}, title={T}, year={2024}, month=mar, journal = JMLR # { Extra}}", strict=False)
    assert got.records[0].parents[0].title == "JMLR #  Extra" and got.records[0].fields["date"] == "2024-03"
    assert got.diagnostics == ['syntax recovery could not pre-filter BibTeX entries after parse error: unknown abbreviation "JMLR" in entry "m"']
    got = library.parse_bibtex('@string{badstring}\n@string{ = "J"}\n@string{bad = {A} trailing}\n' + GOOD, strict=False)
    assert got.keys() == ["good"] and len(got.diagnostics) == 4 and got.diagnostics[0].startswith("syntax recovery could not pre-filter BibTeX entries")
    assert all(d.startswith("ignored string definition") for d in got.diagnostics[1:])


def test_recovery_drops_typed_fields():
    got = library.parse_bibtex("@article{k, title={T}, year={20x4}, month={16}, day={0}, date={soon}}", strict=False)
    assert got.keys() == ["k"] and [d.split('"')[1] for d in got.diagnostics] == ["year", "month", "day", "date"] and "type conversion failed" in got.diagnostics[-1]


def test_inheritance_goes_through_long_chains_and_circles():
    chain = "".join(f"@xdata{{x{i}, xdata={{x{i + 1}}}}}" for i in range(40)) + "@xdata{x40, publisher={P}}@book{b, xdata={x0}, title={T}}"
    assert library.parse_bibtex(chain).records[0].fields["publisher"] == "P"
    circle = "@book{a, crossref={b}, title={A}, publisher={PA}}@book{b, crossref={a}, title={B}, location={LB}}"
    a, b = library.parse_bibtex(circle).records
    assert a.fields["location"] == "LB" and b.fields["publisher"] == "PA"


def test_duplicate_messages():
    text = "@misc{a, doi={10/X}, author={A B}, title={T}, abstract={Same}}\n@misc{b, doi={10/x}}\n@misc{c, author={A B}, title={t}}\n@misc{d, abstract={same}}\n@misc{A, title={U}}"
    got = tidy(text, TidyOptions.check(duplicates=["doi", "citation", "abstract", "key"]))
    assert [w.message for w in got.warnings] == [
        "Duplicate detected. Entry b has an identical DOI to entry a.", "Duplicate detected. Entry c has similar content to entry a.",
        "Duplicate detected. Entry d has a similar abstract to entry a.", "Duplicate detected. The citation key A has already been used.",
    ]


@given(st.lists(pieces, max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_ends_by_table_are_those_found_by_searching(text):
    from marginalia.core.scan import Ends, _search_end

    table = Ends(text)
    table.searching = False
    for at in range(len(text) + 1):
        for opener in "{(":
            for escapes in (True, False):
                for keyed in (True, False):
                    assert table.after(at, opener, escapes, keyed) == _search_end(text, at, opener, escapes, keyed), (text, at, opener, escapes, keyed)


@pytest.mark.parametrize("part", ["@a{b,\n", "%@a{", "@a{b = \"", "@a(\n", "@", "{", "@ ", '@a{b,"\n', "@a{b,c={\\}\n"])
def test_scanning_takes_time_in_proportion(part):
    import time

    began = time.process_time()
    scan(part * (200_000 // len(part)))
    assert time.process_time() - began < 10


def test_names_are_told_apart():
    lib = library.parse_bibtex("@misc{a, author={Lund, Jonna}, title={A}, year=2021}@misc{b, author={Lund, Kim}, title={B}, year=2021}@misc{c, author={Lund, Jonna}, title={C}, year=2020}@misc{d, author={Smith, Jr., John}, title={D}, year=2021}")
    assert [r.text for r in cite.cite_each(lib, ["a", "b"], "apa")] == ["(J. Lund, 2021)", "(K. Lund, 2021)"]
    assert [r.text for r in cite.cite_each(lib, ["a", "b"], "chicago-author-date")] == ["(Jonna Lund 2021)", "(Kim Lund 2021)"]
    assert cite.cite_group(lib, [cite.Cite("a"), cite.Cite("d"), cite.Cite("c")], "apa").text == "(Lund, 2020, 2021; Smith, 2021)"
    assert cite.bibliography(lib.records[3:], "apa")[0].startswith("Smith, J., Jr. (2021)") and cite.bibliography(lib.records[3:], "ieee")[0].startswith("[1] J. Smith Jr., ")
    many = library.parse_bibtex("@misc{a, author={A, X and B, X and C, X and D, X}, title={A}, year=2021}@misc{b, author={A, X and E, X and C, X and D, X}, title={B}, year=2021}@misc{c, author={A, X and B, X and C, X and D, X}, title={C}, year=2021}")
    assert [r.text for r in cite.cite_each(many, ["a", "b", "c"], "apa")] == ["(A, B, et al., 2021a)", "(A, E, et al., 2021)", "(A, B, et al., 2021b)"]


def test_numbers_collapse():
    lib = library.parse_bibtex("".join(f"@misc{{k{i}, title={{T}}}}" for i in range(6)))
    cites = [cite.Cite(f"k{i}", "7" if i == 4 else None) for i in range(6)]
    assert cite.cite_group(lib, cites, "ieee").text == "[1]–[4], [5, p. 7], [6]"
    assert cite.cite_group(lib, cites[:2], "ieee").text == "[1], [2]"


def test_languages():
    lib = library.parse_bibtex("@article{a, author={Lund, Jonna and Rask, Rafael}, title={A}, journal={J}, pages={1--2}}")
    assert cite.cite_group(lib, [cite.Cite("a", "3")], "chicago-author-date", language="de-DE").text == "(Lund und Rask o. J., 3)"
    assert cite.bibliography(lib.records, "ieee", "de-DE")[0] == "[1] J. Lund und R. Rask, “A,” J, S. 1–2, o. J."
    assert cite.locale("DE-de") == "de-DE" and cite.locale("") == "en-US"
    with pytest.raises(ValueError, match="unknown bundled locale"):
        cite.locale("xx-XX")


def test_recovery_says_what_a_strict_reading_would():
    sources = ["", "stray", "stray @misc{a, title={x}}", "@", "@misc{a, title={x}}", "@misc{a,\n", "@misc{a}@misc{a}", "@misc{a, year={x}}", "@misc{a, date={soon}}", "@misc{a, title=zz}", "@string{x}", "@misc{a, -t={x}}", "@misc{, t={x}}"]
    for source in sources:
        def valid(strict):
            try:
                return library.parse_bibtex(source, strict).valid
            except library.ParseFailure as error:
                return error.valid
        assert valid(False) == valid(True), source


def test_scanning_takes_few_steps_a_field():
    """Fields of one value are read by one match each; blocks without a backslash have one end, searched once."""
    from unittest import mock

    import marginalia.core.scan as scanner

    source = "@misc{a, x = {1 {b} c}, y = \"2\", z = tok, w = {%s}}" % ("word, and = more " * 50)
    with mock.patch.object(scanner, "_search_end", wraps=scanner._search_end) as ends, mock.patch.object(scanner, "atoms_of", wraps=scanner.atoms_of) as values:
        assert [f.name for f in scan(source)[0].entry.fields] == ["x", "y", "z", "w"]
    assert ends.call_count == 1 and values.call_count == 0


def test_yaml_is_read_by_libyaml_where_both_readers_agree():
    from unittest import mock

    import yaml

    text = "a:\n  type: article\n  title: {value: T, short: t}\n  date: 2020\n"
    with mock.patch.object(yaml, "safe_load", side_effect=AssertionError("slow reader")):
        assert library.parse_yaml(text).keys() == ["a"]
    with pytest.raises(library.ParseFailure, match="cannot start any token"):
        library.parse_yaml("a:\n  title: T\n  note: \t")  # libyaml alone would take it


def test_formatting_looks_only_at_what_may_change():
    from unittest import mock

    import marginalia.core.tidy as tidier

    with mock.patch.object(tidier, "latex_of", wraps=tidier.latex_of) as looked:
        assert tidier.escape_text("plain words, 50% of $x_1$ é" + " more" * 50) == r"plain words, 50\% of $x_1$ \'{e}" + " more" * 50
    assert looked.call_count <= 2
    entries = [b.entry for b in scan("".join(f"@misc{{k{i}, author={{Lund, A}}, year={{2020}}}}" for i in range(5)))]
    with mock.patch.object(tidier, "parse_template", wraps=tidier.parse_template) as parsed, mock.patch.object(tidier, "_words", wraps=tidier._words) as words:
        for _ in range(3):
            assert tidier.key_plan(entries, "[auth:lower][year]q")[:2] == ["lund2020qa", "lund2020qb"]
    assert parsed.call_count <= 1 and words.call_count == 0


def test_plain_entries_are_read_in_one_pass():
    """Entries written plainly take one match a field; what they hold is what the longer way finds, and fields are made when asked for."""
    import marginalia.core.scan as scanner

    for source in ('@misc{a1, x = {1 {b}}, y = "2 {"q"}", z = tok, w = m # { é}, x = {\\"u\n}}', "@Article{ k ,\n a=1,\n b={}\n}", "@misc{k,}"):
        assert scanner._plain_block(source, 0, scanner.Ends(source)) == scanner._block(source, 0, scanner.Ends(source))
    for source in ("@misc{k, a = {\\}}}", "@misc{k, a = 1 % x\n}", "@misc{k, a}", "@misc{k, a = }", "@misc(k, a = 1)", "@string{k, a = 1}", "@misc{k, a = {1}", "@misc{k, a = {b}, , c = 1}"):
        assert scanner._plain_block(source, 0, scanner.Ends(source)) is None


def test_edits_that_are_refused_anyway_take_no_scan():
    from unittest import mock

    import marginalia.core.scan as scanner

    for value in ("a}{b", "end\\", "{open", "50%", "a\nb"):
        assert scanner.refused(value)
        with pytest.raises(ValueError):
            set_field("@misc{a, x = {1}}", "a", "x", value)
    assert not any(map(scanner.refused, ("", "tok", 'say "x"', "{a} b", "50\\%")))
    with mock.patch.object(scanner, "scan", wraps=scanner.scan) as scans:
        for key, name in (("b", "x"), ("a", "no")):
            with pytest.raises(KeyError):
                set_field("@misc{a, x = {1}}", key, name, "2")
    assert scans.call_count == 0


def test_fields_of_a_plain_entry_can_be_replaced():
    entry, other = (b.entry for b in scan("@misc{a, x = {1}}@misc{b, y = {2}, z = 3}"))
    entry.key, entry.fields = other.key, list(other.fields)
    assert [f.name for f in entry.fields] == ["y", "z"] and entry == other and entry.parts is None
    merged = tidy("@misc{a, doi={10/x}, title={T}}\n@misc{b, doi={10/X}, note={N}}\n", TidyOptions.check(merge="last")).bibtex
    assert merged == "@misc{b,\n  doi           = {10/X},\n  note          = {N}\n}\n"
