import pytest

from marginalia import api
from marginalia.core import cite, csl, library

HEAD = '<style xmlns="http://purl.org/net/xbiblio/csl" class="in-text" version="1.0"><info><title>t</title></info>'
LIB = library.parse_bibtex("@article{a, author={Lund, Jonna and Rask, R and Poe, E}, title={Alpha}, journal={J}, year=2024, volume=3}@book{b, author={Lund, Jonna and Rask, R and Poe, E}, title={Beta}, publisher={P}, year=2024}@misc{c, title={Gamma}}")


def xml(citation, more="", attributes=""):
    return f"{HEAD}{more}<citation {attributes}><layout prefix='(' suffix=')' delimiter='; '>{citation}</layout></citation></style>"


NAMES = "<names variable='author'><name form='short' and='symbol'/><substitute><text variable='title'/></substitute></names>"


def test_names_dates_and_suffix():
    style = xml(f"<group delimiter=', '>{NAMES}<date variable='issued'><date-part name='year'/></date></group>", attributes="et-al-min='3' et-al-use-first='1' disambiguate-add-year-suffix='true'")
    assert [r.text for r in cite.cite_each(LIB, ["a", "b", "c"], cite.style(style))] == ["(Lund et al., 2024a)", "(Lund et al., 2024b)", "(Gamma)"]


def test_position_and_shorter_et_al():
    style = xml(f"{NAMES}<choose><if position='first'><text value=' first'/></if></choose>", attributes="et-al-subsequent-min='3' et-al-subsequent-use-first='1'")
    done, _ = cite.render_document(LIB, [("1", [cite.Cite("a")]), ("2", [cite.Cite("a")])], style)
    assert [r.text for _, r in done] == ["(Lund, Rask, & Poe first)", "(Lund et al.)"]
    assert csl.XmlStyle(style).depends_on("position") and csl.XmlStyle(style).depends_on("subsequent") and not csl.XmlStyle(style).depends_on("citation-number")


def test_numbers_follow_the_bibliography_sort():
    more = "<macro name='n'><text variable='citation-number'/></macro><bibliography><sort><key variable='title' sort='descending'/></sort><layout suffix='.'><text macro='n' suffix=' '/><text variable='title' font-style='italic'/><group prefix=', ' delimiter=' '><text term='volume'/><text variable='volume'/></group></layout></bibliography>"
    style = xml("<text macro='n'/>", more)
    assert [r.text for r in cite.cite_each(LIB, ["a", "b"], style)] == ["(2)", "(1)"] and csl.XmlStyle(style).depends_on("citation-number")
    text, shown = cite.bibliography(LIB.records[:2], style)
    assert text == "1 Beta.\n2 Alpha, vol. 3." and "<i>Alpha</i>" in shown


@pytest.mark.parametrize("text", ["<nope/>", "<style", HEAD + "</style>", HEAD + "<citation><layout><intext/></layout></citation></style>", HEAD.replace("</info>", "<link rel='independent-parent' href='x'/></info>") + "<citation><layout/></citation></style>"])
def test_unusable_styles_are_refused(text):
    with pytest.raises(ValueError):
        cite.style(text)


WORKS = library.parse_bibtex(
    "@book{a, author={Lund, Anna and Rask, R and Poe, Ed}, title={Alpha}, date={2020-03-05}}@book{b, author={Lund, Anna and Rask, R and Moe, K}, title={Beta}, year=2020}"
    "@book{c, author={Lund, Berit}, title={Gamma}, year=2021}@book{d, author={Lund, Anna}, title={Delta}, year=2021}@book{e, author={Lund, Anna}, title={Eta}, year=2021}@book{f, author={{Quiet Press}}, title={What?}, edition=2}"
)
SHORT = "<group delimiter=' '><names variable='author'><name form='short' and='text'/></names><date variable='issued'><date-part name='year'/></date></group>"


def test_more_names_then_given_names_then_letters_tell_works_apart():
    style = xml(SHORT, attributes="et-al-min='3' et-al-use-first='1' disambiguate-add-names='true' disambiguate-add-givenname='true' disambiguate-add-year-suffix='true'")
    assert [r.text for r in cite.cite_each(WORKS, list("abcde"), style)] == ["(Lund, Rask, and Poe 2020)", "(Lund, Rask, and Moe 2020)", "(Berit Lund 2021)", "(Anna Lund 2021a)", "(Anna Lund 2021b)"]
    first = xml(SHORT, attributes="disambiguate-add-givenname='true' givenname-disambiguation-rule='primary-name'")
    assert [r.text for r in cite.cite_each(WORKS, list("cf"), first)] == ["(Lund 2021)", "(Quiet Press)"]
    assert [r.text for r in cite.cite_each(WORKS, list("cd"), first)] == ["(Berit Lund 2021)", "(Anna Lund 2021)"]


@pytest.mark.parametrize(
    "attributes, text",
    [
        ("disambiguate-add-year-suffix='true' collapse='year'", "(Lund 2021a, 2021b; Quiet Press; Lund, Rask, and Poe 2020)"),
        ("disambiguate-add-year-suffix='true' collapse='year-suffix' year-suffix-delimiter=',' after-collapse-delimiter='. '", "(Lund 2021a,b. Quiet Press; Lund, Rask, and Poe 2020)"),
        ("cite-group-delimiter=' + '", "(Lund 2021 + Lund 2021; Quiet Press; Lund, Rask, and Poe 2020)"),
    ],
)
def test_cites_of_the_same_names_collapse(attributes, text):
    assert cite.cite_group(WORKS, [cite.Cite(k) for k in "dfea"], xml(SHORT, attributes=attributes)).text == text


def test_numbers_in_a_row_become_a_range_unless_they_have_locators():
    style = xml("<text variable='citation-number'/><text variable='locator' prefix=':'/>", attributes="collapse='citation-number'")
    works = [cite.Cite(k) for k in "abcdef"]
    done = cite.render_document(WORKS, [("0", works), ("1", [works[3], works[0], works[1], works[2]]), ("2", [works[0], cite.Cite("b", "9"), works[2]])], style)[0]
    assert [r.text for _, r in done] == ["(1–6)", "(1–4)", "(1; 2:9; 3)"]


@pytest.mark.parametrize("language, text", [("en-US", "(March 5, 2020)"), ("en-GB", "(5 March 2020)"), ("de-DE", "(5. März 2020)"), ("es-ES", "(5 de marzo de 2020)"), ("fr-FR", "(5 mars 2020)")])
def test_dates_in_words(language, text):
    assert cite.cite_each(WORKS, ["a"], xml("<date variable='issued' form='text'/>"), language)[0].text == text


def test_terms_serve_their_language_only():
    more = "<locale xml:lang='de'><terms><term name='edition'>Aufl.</term></terms></locale><locale><terms><term name='in'>within</term></terms></locale>"
    style = xml("<group delimiter=' '><number variable='edition' form='ordinal'/><text term='edition'/><text term='in'/></group>", more)
    assert [cite.cite_each(WORKS, ["f"], style, to)[0].text for to in ("en-US", "de-DE")] == ["(2nd ed. within)", "(2. Aufl. within)"]


def test_marks_nest_and_stops_do_not_double():
    style = xml("<group delimiter='. ' font-weight='bold'><text variable='title' font-style='italic'/><names variable='author'><name font-variant='small-caps'/></names></group>")
    shown = cite.cite_each(WORKS, ["f"], style)[0]
    assert shown.text == "(What? Quiet Press)" and shown.html == '(<b><i>What?</i></b> <b><span style="font-variant: small-caps;">Quiet Press</span></b>)'
    assert shown.tree[0]["children"][1]["formatting"]["font_weight"] == "Bold"


def test_repeated_authors_and_labels_of_a_bibliography():
    more = "<bibliography second-field-align='flush' subsequent-author-substitute='—'><sort><key variable='author'/></sort><layout suffix='.'><text variable='citation-number' suffix=' '/><names variable='author' suffix=', '/><text variable='title'/></layout></bibliography>"
    shown = cite.bibliography([WORKS.find(k) for k in "ced"], xml("<text variable='citation-number'/>", more))
    assert shown.text == "1 Anna Lund, Eta.\n2 —, Delta.\n3 Berit Lund, Gamma."
    assert shown.tree[0]["first_field"]["children"][0]["text"] == "1"


def test_a_macro_that_calls_itself_is_refused():
    with pytest.raises(ValueError, match="calls itself"):
        cite.style(xml("<text macro='m'/>", "<macro name='m'><text macro='n'/></macro><macro name='n'><text macro='m'/></macro>"))


@pytest.mark.parametrize("name", sorted(cite.SOURCES))
def test_bundled_styles_render_bare_and_full_records(name):
    of = cite.style(name.upper())
    bare = library.parse_bibtex("@misc{x}")
    assert cite.bibliography(bare.records, of).text is not None and cite.cite_each(bare, ["x"], of)[0].text is not None
    for language in cite.LOCALES:
        shown = cite.bibliography(WORKS.records, of, language)
        assert len(shown.entries) == 6 and ".." not in shown.text and "  " not in shown.text


@pytest.mark.parametrize("of, label", [("ieee", "[1]"), ("vancouver", "1.")])
def test_labels_stand_in_a_margin(of, label):
    shown = cite.bibliography([WORKS.find("c")], of)
    assert shown.html.startswith(f'<div class="csl-entry" data-key="c"><div class="csl-left-margin">{label}</div><div class="csl-right-inline">') and shown.html.endswith("</div></div>")
    assert shown.text.startswith(f"{label} ") and "Gamma" in shown.text


@pytest.mark.parametrize("link, href", [(" https://x.y/z ", "https://x.y/z"), ("MAILTO:a@b", "MAILTO:a@b"), ("javascript:x", None), ("a/https:", None), ("", None)])
def test_addresses_that_may_become_links(link, href):
    assert cite.safe(link) == href and ("<a " in cite.as_html([("t", "", link)])) == bool(href)


#: The ranges that the standard gives as examples, in each form.
RANGES = {
    "expanded": "42–45 321–328 2787–2816", "minimal": "42–5 321–8 2787–816", "minimal-two": "42–45 321–28 2787–816",
    "chicago-15": "3–10 71–72 96–117 100–104 600–613 1100–1123 107–8 505–17 1002–6 321–25 415–532 11564–68 13792–803 1496–1504 2787–2816",
    "chicago-16": "3–10 71–72 96–117 100–104 600–613 1100–1123 107–8 505–17 1002–6 321–25 415–532 11564–68 13792–803 1496–504 2787–816",
}


@pytest.mark.parametrize("form", RANGES)
def test_page_ranges(form):
    full = csl._pages(RANGES[form], "expanded")
    assert csl._pages(full, form) == RANGES[form] and "–" in full
    assert csl._pages("A3–7, x, 9–2, e12", form) == "A3–7, x, 9–2, e12"


def test_page_ranges_of_a_style():
    style = xml("<text variable='page'/>").replace("class=", "page-range-format='minimal' class=")
    assert cite.cite_each(library.parse_bibtex("@misc{p, pages={321--328}}"), ["p"], style)[0].text == "(321–8)"


@pytest.mark.parametrize("citation, attributes", [("<text macro='none'/>", ""), (SHORT, "et-al-min='few'")])
def test_styles_that_cannot_render_are_refused(citation, attributes):
    with pytest.raises(ValueError, match="invalid style"):
        cite.style(xml(citation, attributes=attributes))


def test_bundled_styles_have_names_and_titles():
    assert (api.Style.load("MLA").id, api.Style.load("MLA").title) == ("MLA", "Modern Language Association")
    assert all(api.Style.load(name).title for name in (*api.Style.names(), *cite.ALIASES))
    assert cite.cite_each(WORKS, ["c"], cite.style("american-psychological-association")) == cite.cite_each(WORKS, ["c"], "apa")
    assert api.Locale.load("de-DE").code == "de-DE"


def test_long_lists_of_people_stay_cheap():
    import time

    people = " and ".join([f"Name{k}, A" for k in range(2500)])
    works = library.parse_bibtex("".join([f"@misc{{w{k}, author={{{people}{more}}}, title={{T{k}}}, year=2020}}" for k, more in enumerate(("", "", " and Last, B"))]))
    began = time.process_time()
    for of in ("apa", "chicago-author-date", *cite.SOURCES):
        assert len(cite.cite_each(works, ["w0", "w1", "w2"], of)) == 3
    assert time.process_time() - began < 20
    assert cite.cite_each(works, ["w0", "w1"], "harvard-cite-them-right")[1].text == "(Name0 et al., 2020b)"


def test_odd_numbers_stand_as_they_are():
    odd = library.parse_bibtex("@misc{a, edition={²}, pages={" + "9" * 5000 + "--1}, date={2020-13}}")
    style = xml("<number variable='edition' form='ordinal'/><text variable='page' prefix=' '/><date variable='issued' form='text' prefix=' '/>").replace("class=", "page-range-format='chicago' class=")
    assert cite.cite_each(odd, ["a"], style)[0].text.startswith("(² 999")


def test_citation_and_bibliography_share_what_tells_works_apart():
    from unittest import mock

    from marginalia.core import cite, csl, library

    lib = library.parse_bibtex("@misc{a, author={Lund, A}, title={X}, year=2020}\n@misc{b, author={Lund, B}, title={Y}, year=2020}")
    for style in ("nature", "harvard-cite-them-right", "modern-language-association", "apa"):
        for keys in (["a", "b"], ["b", "a"], ["a"], [], ["zz"]):
            cites = [cite.Cite(k) for k in keys]
            with mock.patch.object(csl.XmlStyle, "tell", autospec=True, side_effect=csl.XmlStyle.tell) as told:
                cited, listed = cite.cite_and_list(lib, cites, style)
            assert told.call_count <= 1 or keys != ["a", "b"]
            assert cited == cite.cite_group(lib, cites, style) and listed == cite.bibliography(lib.records, style)


def test_what_told_works_apart_is_not_rendered_again(monkeypatch):
    """Cites without a locator read as they did when works were told apart; dates are rendered once."""
    from marginalia.core import csl
    from marginalia.core.library import parse_bibtex
    from marginalia.plans.sources import DATED, THREE

    lib = parse_bibtex(THREE.replace("«k»", "1").replace("«y»", "1997"))
    style = csl.XmlStyle(DATED)
    calls = {"_parts": 0, "_shown_date": 0}
    for name in calls:
        monkeypatch.setattr(csl.XmlStyle, name, lambda self, *a, n=name, inner=getattr(csl.XmlStyle, name): calls.__setitem__(n, calls[n] + 1) or inner(self, *a))
    cites = [csl.Cite(k) for k in lib.keys()]
    once = [r.text for _, r in style.citations(lib, [("", cites)])]
    assert once == [r.text for _, r in style.citations(lib, [("", cites)])] and once[0].count("Lund") == 2
    assert calls == {"_parts": 8, "_shown_date": 2}  # seven a citation before, and a date for each
