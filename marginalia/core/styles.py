"""Bundled styles written in the citation style language, after their published guides."""

from __future__ import annotations

_OPEN = '<style xmlns="http://purl.org/net/xbiblio/csl" class="in-text" version="1.0"'

#: Numeric, in brackets, initials without stops.
_VANCOUVER = f"""{_OPEN}><info><title>Vancouver</title><id>vancouver</id></info>
<macro name="people"><names variable="author"><name delimiter=", " initialize-with="" name-as-sort-order="all" sort-separator=" " et-al-min="7" et-al-use-first="6"/>
<substitute><names variable="editor"/></substitute></names></macro>
<macro name="host"><choose><if variable="container-title"><group delimiter=". "><text variable="container-title"/>
<group><group delimiter=";"><date variable="issued"><date-part name="year"/></date><group><text variable="volume"/><text variable="issue" prefix="(" suffix=")"/></group></group><text variable="page" prefix=":"/></group></group></if>
<else><group delimiter="; "><text variable="publisher"/><date variable="issued"><date-part name="year"/></date></group></else></choose></macro>
<citation collapse="citation-number"><sort><key variable="citation-number"/></sort><layout prefix="(" suffix=")" delimiter=","><text variable="citation-number"/><group delimiter=" " prefix=", "><label variable="locator"/><text variable="locator"/></group></layout></citation>
<bibliography second-field-align="flush"><layout><text variable="citation-number" suffix=". "/><group delimiter=". " suffix="."><text macro="people"/><text variable="title"/><text macro="host"/></group><text variable="DOI" prefix=" doi:"/></layout></bibliography></style>"""

#: Numeric, superscript.
_NATURE = f"""{_OPEN}><info><title>Nature</title><id>nature</id></info>
<macro name="people"><names variable="author"><name delimiter=", " and="symbol" delimiter-precedes-last="never" initialize-with=". " name-as-sort-order="all" et-al-min="6" et-al-use-first="1"/><et-al font-style="italic"/><substitute><names variable="editor"/></substitute></names></macro>
<citation collapse="citation-number"><sort><key variable="citation-number"/></sort><layout vertical-align="sup" delimiter=","><text variable="citation-number"/><group prefix="(" suffix=")"><label variable="locator" strip-periods="true"/><text variable="locator"/></group></layout></citation>
<bibliography second-field-align="flush"><layout><text variable="citation-number" suffix=". "/><group delimiter=" " suffix="."><text macro="people" suffix="."/>
<choose><if variable="container-title"><group delimiter=" "><text variable="title" suffix="."/><text variable="container-title" font-style="italic"/><group delimiter=", "><text variable="volume" font-weight="bold"/><text variable="page"/></group></group></if>
<else><text variable="title" font-style="italic" suffix="."/></else></choose>
<group delimiter=", " prefix="(" suffix=")"><choose><if variable="container-title" match="none"><text variable="publisher"/></if></choose><date variable="issued"><date-part name="year"/></date></group></group></layout></bibliography></style>"""

#: Numeric, superscript, journals in italics.
_MEDICAL = f"""{_OPEN}><info><title>American Medical Association</title><id>american-medical-association</id></info>
<macro name="people"><names variable="author"><name delimiter=", " initialize-with="" name-as-sort-order="all" sort-separator=" " et-al-min="7" et-al-use-first="3"/><substitute><names variable="editor"/></substitute></names></macro>
<citation collapse="citation-number"><sort><key variable="citation-number"/></sort><layout vertical-align="sup" delimiter=","><text variable="citation-number"/><group prefix="(" suffix=")"><label variable="locator" strip-periods="true"/><text variable="locator"/></group></layout></citation>
<bibliography second-field-align="flush"><layout><text variable="citation-number" suffix=". "/><group delimiter=". " suffix="."><text macro="people"/>
<choose><if variable="container-title"><text variable="title"/></if><else><text variable="title" font-style="italic"/></else></choose>
<choose><if variable="container-title"><group delimiter=". "><text variable="container-title" font-style="italic"/><group><date variable="issued"><date-part name="year"/></date><group prefix=";"><text variable="volume"/><text variable="issue" prefix="(" suffix=")"/></group><text variable="page" prefix=":"/></group></group></if>
<else><group delimiter="; "><text variable="publisher"/><date variable="issued"><date-part name="year"/></date></group></else></choose></group><text variable="DOI" prefix=" doi:"/></layout></bibliography></style>"""

#: Author and date.
_HARVARD = f"""{_OPEN}><info><title>Cite Them Right - Harvard</title><id>harvard-cite-them-right</id></info>
<macro name="dated"><choose><if variable="issued"><date variable="issued"><date-part name="year"/></date><text variable="year-suffix"/></if><else><text term="no date"/><text variable="year-suffix" prefix="-"/></else></choose></macro>
<macro name="short"><names variable="author"><name form="short" and="text" delimiter-precedes-last="never"/><et-al font-style="italic"/><substitute><names variable="editor"/><text variable="title" font-style="italic"/></substitute></names></macro>
<macro name="people"><names variable="author"><name and="text" delimiter-precedes-last="never" initialize-with="." name-as-sort-order="all"/><et-al font-style="italic"/><substitute><names variable="editor"/><text variable="title" font-style="italic"/></substitute></names></macro>
<citation et-al-min="4" et-al-use-first="1" disambiguate-add-year-suffix="true" disambiguate-add-names="true" disambiguate-add-givenname="true" collapse="year"><layout prefix="(" suffix=")" delimiter="; "><group delimiter=", "><text macro="short"/><text macro="dated"/><group delimiter=" "><label variable="locator"/><text variable="locator"/></group></group></layout></citation>
<bibliography et-al-min="4" et-al-use-first="1"><sort><key macro="people"/><key variable="issued"/><key variable="title"/></sort><layout suffix="."><group delimiter=" "><text macro="people"/><text macro="dated" prefix="(" suffix=")"/>
<choose><if variable="container-title"><group delimiter=", "><group prefix="‘" suffix="’"><text variable="title"/></group><text variable="container-title" font-style="italic"/><group><text variable="volume"/><text variable="issue" prefix="(" suffix=")"/></group><group delimiter=" "><label variable="page"/><text variable="page"/></group></group></if>
<else><group delimiter=". "><text variable="title" font-style="italic"/><text variable="publisher"/></group></else></choose></group><text variable="DOI" prefix=". Available at: https://doi.org/"/></layout></bibliography></style>"""

#: Author and page.
_MODERN = f"""{_OPEN}><info><title>Modern Language Association</title><id>modern-language-association</id></info>
<macro name="short"><names variable="author"><name form="short" and="text" et-al-min="3" et-al-use-first="1"/><substitute><names variable="editor"/><text variable="title" font-style="italic"/></substitute></names></macro>
<macro name="people"><names variable="author"><name and="text" delimiter-precedes-last="always" name-as-sort-order="first" et-al-min="3" et-al-use-first="1" delimiter-precedes-et-al="always"/><substitute><names variable="editor"/><text variable="title" font-style="italic"/></substitute></names></macro>
<citation disambiguate-add-givenname="true"><layout prefix="(" suffix=")" delimiter="; "><group delimiter=" "><text macro="short"/><choose><if disambiguate="true"><text variable="title" font-style="italic"/></if></choose><text variable="locator"/></group></layout></citation>
<bibliography subsequent-author-substitute="---"><sort><key macro="people"/><key variable="title"/></sort><layout suffix="."><group delimiter=" "><text macro="people" suffix="."/>
<choose><if variable="container-title"><group delimiter=" "><group prefix="“" suffix="”"><text variable="title" suffix="."/></group><group delimiter=", "><text variable="container-title" font-style="italic"/><text variable="volume" prefix="vol. "/><text variable="issue" prefix="no. "/><date variable="issued"><date-part name="month" form="short" suffix=" "/><date-part name="year"/></date><group delimiter=" "><label variable="page"/><text variable="page"/></group></group></group></if>
<else><group delimiter=" "><text variable="title" font-style="italic" suffix="."/><group delimiter=", "><text variable="publisher"/><date variable="issued"><date-part name="year"/></date></group></group></else></choose></group><text variable="DOI" prefix=", https://doi.org/"/></layout></bibliography></style>"""

SOURCES = {"american-medical-association": _MEDICAL, "harvard-cite-them-right": _HARVARD, "modern-language-association": _MODERN, "nature": _NATURE, "vancouver": _VANCOUVER}
