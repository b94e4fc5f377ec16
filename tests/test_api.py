import pytest

from marginalia import api

BIB = "@article{a, author={Lund, Jonna}, title={T}, journal={J}, year=2024}\n@string{m={v}}\n@book{b, author={Rask, R}, title={U}, year=2020}\n"


def test_library(tmp_path):
    (tmp_path / "x.bib").write_text(BIB)
    lib = api.Library.read(tmp_path / "x.bib")
    assert lib.keys() == ["a", "b"] and "a" in lib and len(lib) == 2 and lib["b"].title == "U" and not lib.is_empty()
    assert lib.project(["key", "title"], keys=["b"]) == [{"key": "b", "title": "U"}] and [r.key for r in lib.select("book")] == ["b"]
    for call, error in ((lambda: lib["c"], KeyError), (lambda: lib.get_many("ab"), TypeError), (lambda: lib.project("key"), TypeError), (lambda: lib.project(["x"]), ValueError), (lambda: api.Library.read("x"), ValueError), (lambda: api.Library.read("x.txt"), ValueError)):
        with pytest.raises(error):
            call()
    assert api.cite(tmp_path / "x.bib", "a").text == "(Lund, 2024)" and api.full_bibliography(tmp_path / "x.bib", "ieee")[0].startswith("[1] J. Lund")
    assert api.tidy_file(tmp_path / "x.bib", output=tmp_path / "y.bib").bibtex == (tmp_path / "y.bib").read_text()


def test_document():
    doc = api.Document(api.Library.parse_bibtex(BIB))
    got = doc.render([api.Citation("1", api.Cite("a", "12")), api.Citation("2", (api.Cite("a"), api.Cite("b")))])
    assert got["1"].text == "(Lund, 2024, p. 12)" and got["2"].text == "(Lund, 2024; Rask, 2020)" and got.citation_order == ["1", "2"]
    assert doc.cited_bibliography([]) == ("", "")
    with pytest.raises(api.MissingReferenceError):
        doc.render([api.Citation("1", "zzz")])
    with pytest.raises(ValueError):
        doc.render([api.Citation("1", "a"), api.Citation("1", "b")])


def test_raw_document(tmp_path):
    doc = api.BibDocument.parse(BIB + "% note\n@misc{a, x=1}\n@broken{")
    assert doc.unique_keys() == ["a", "b"] and len(doc.occurrences("a")) == 2 and doc.strings == {"m": "v"} and doc.comments == ["note"] and len(doc.failed_blocks) == 1
    with pytest.raises(api.BibliographyError):
        doc["a"]
    doc.set_field("b", "title", "New")
    assert doc.to_bibtex() == (BIB + "% note\n@misc{a, x=1}\n@broken{").replace("{U}", "{New}")


def test_styles_locales_and_groups(tmp_path):
    doc = api.Document(api.Library.parse_bibtex(BIB), api.Style.load("APA"), api.Locale.load("en-GB"))
    got = doc.render([api.Citation("1", api.CitationGroup(["a", api.Cite("b", "3", "figure")]))])
    assert got["1"].to_text() == "(Lund, 2024; Rask, 2020, fig. 3)" and list(got) == ["1"] and got.bibliography.tree[0]["kind"] == "bibliography-entry"
    assert doc.cited_bibliography(api.Citation("1", "a")).to_html().count("csl-entry") == 1
    xml = '<style xmlns="http://purl.org/net/xbiblio/csl" version="1.0"><info><title>T</title><id>i</id></info><citation><layout><text variable="title"/></layout></citation></style>'
    (tmp_path / "s.csl").write_text(xml)
    style = api.Style.from_path(tmp_path / "s.csl")
    assert (style.id, style.title) == ("i", "T") and api.Document(api.Library.parse_bibtex(BIB), style).render([api.Citation("1", "a")])["1"].text == "T"
    for make, error in ((lambda: api.CitationGroup("a"), TypeError), (lambda: api.CitationGroup([]), ValueError), (lambda: api.Citation("1", ["a"]), TypeError), (lambda: api.Style.load("nope"), ValueError), (lambda: api.Locale.load("xx"), ValueError), (lambda: api.Citation("1", api.Cite("a", "1", "nonsense")).cites(), ValueError)):
        with pytest.raises(error):
            make()


def test_entry_and_field_maps():
    entries = api.BibDocument.parse(BIB + "@misc{a, x=1, x=2}").entries
    assert len(entries) == 2 and list(entries) == ["a", "b"] and len(entries.get_all("a")) == 2 and entries["b"].get("title") == "U" and "c" not in entries
    assert [f.value for f in entries.get_all("a")[1].get_all("X")] == ["1", "2"] and entries["b"].get_unique("year").value == "2020"
    for call, error in ((lambda: entries["a"], api.BibliographyError), (lambda: entries["c"], KeyError), (lambda: entries.get_all("a")[1].get_unique("x"), ValueError)):
        with pytest.raises(error):
            call()
    with pytest.raises(api.TidyError) as error:
        api.BibDocument.parse("@broken{").tidy()
    assert isinstance(error.value, api.BibliographyError) and error.value.line == 1


def test_yaml_keeps_rich_values():
    lib = api.Library.parse_yaml("k:\n  type: Video\n  title: {value: T, short: t}\n  url: {value: 'http://x', date: 2020-09-17}\n  parent:\n    - {type: Conference, title: C}\n    - {type: Video, url: {value: 'http://y', date: 2021-01-02}}\n")
    held = lib.to_dicts()[0]
    assert held["url"] == {"date": "2020-09-17", "value": "http://x"} and held["parent"][1]["url"]["date"] == "2021-01-02" and lib["k"].title == "T"
    with pytest.raises(api.BibliographyError):
        api.Library.parse_yaml("k: 1")


def test_a_raw_document_is_scanned_once(monkeypatch):
    """Every look at it was a scan of its own: eleven in local_raw_document."""
    from marginalia.core import scan as _scan

    scans = []
    monkeypatch.setattr(_scan, "scan", lambda text, inner=_scan.scan: scans.append(text) or inner(text))
    doc = api.BibDocument.parse("% c\n@string{s = {v}}\n@misc{a, x = {1}, x = {2}}\n")
    assert [len(doc.blocks), doc.comments, doc.strings, doc.occurrence_keys(), len(doc), "a" in doc, doc.preamble] == [6, ["c"], {"s": "v"}, ["a"], 1, True, ""]
    doc.blocks.clear()
    assert [f.value for f in doc["a"].get_all("x")] == ["1", "2"] and len(scans) == 1
    doc.set_field("a", "x", "3", 1)
    assert [f.value for f in doc.entries["a"].get_all("x")] == ["1", "3"] and len(scans) == 2
    doc.source = "@misc{b}"
    assert doc.occurrence_keys() == ["b"] and len(scans) == 3


def test_a_style_is_read_once_and_a_bibliography_alone_cites_nothing(monkeypatch):
    from marginalia.core import cite, csl

    reads = []
    monkeypatch.setattr(csl.XmlStyle, "__init__", lambda self, *a, inner=csl.XmlStyle.__init__: reads.append(a) or inner(self, *a))
    xml = "<style><info><id>read-once</id></info><citation><layout><text variable='title'/></layout></citation></style>"
    assert [api.Style.from_xml(xml).id for _ in range(3)] == ["read-once"] * 3 and len(reads) == 1
    doc, told = api.Document(api.Library.parse_bibtex(BIB)), []
    monkeypatch.setattr(cite.Short, "__init__", lambda self, *a, inner=cite.Short.__init__: told.append(a) or inner(self, *a))
    got = doc.render([api.Citation("1", api.CitationGroup(["a", "b"]))])
    assert len(told) == 1 and got.bibliography.text == "Lund, J. (2024). T. J.\nRask, R. (2020). U."
    with monkeypatch.context() as m:
        m.setattr(cite, "cite_group", None)
        assert doc.cited_bibliography(api.Citation("1", "b")).text == "Rask, R. (2020). U."
        with pytest.raises(api.MissingReferenceError):
            doc.cited_bibliography(api.Citation("1", "zz"))
        with pytest.raises(ValueError):
            doc.cited_bibliography(api.Citation("1", "a"), api.Citation("1", "b"))
