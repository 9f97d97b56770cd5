"""The node table, XPath, emission, validation: small documents with known answers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from treeframe.functions import datatypes as D
from treeframe.functions import regexes
from treeframe.operators import emit, identity, patterns, schematron, validation, xpointer
from treeframe.sources import html, shred, store, xml
from treeframe.xpath import evaluate, select
from treeframe.xpath.parser import XPathError, parse

CATALOG = '<catalog xml:lang="en-GB"><book id="b1" lang="en"><title>One</title><author>A</author></book><book id="b2"><title>Two</title></book><magazine><title>Mag</title></magazine><m:x xmlns:m="urn:m" n="3">5</m:x></catalog>'


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, xml string")


@pytest.fixture(scope="module")
def catalog(spark):
    return store.stored(shred.read_xml(documents(spark, CATALOG, '<catalog><book id="z"><title>Z</title></book></catalog>')))


# reading


def test_events_and_spans_of_a_document(spark):
    nodes = shred.read_xml(documents(spark, "<?xml version='1.0'?>\n<a x='1'>t<b/><!--c--><?p d?></a>"))
    rows = {r.pre: r for r in nodes.collect()}
    assert [(rows[i].kind, rows[i].local, rows[i].last, rows[i].parent, rows[i].sib) for i in range(6)] == [("document", None, 5, None, 0), ("element", "a", 5, 0, 0), ("text", None, 2, 1, 0), ("element", "b", 3, 1, 1), ("comment", None, 4, 1, 2), ("pi", "p", 5, 1, 3)]
    assert (rows[1].line, rows[1].col) == (2, 1)
    seen = [r.type for r in shred.events(nodes).orderBy("seq").collect()]
    assert seen == ["startDocument", "startElement", "text", "startElement", "endElement", "comment", "pi", "endElement", "endDocument"]


def test_faults_are_raised_or_noted(spark):
    bad = {"<a><b></a>": "unclosedElement", "<a/><b/>": "multipleRoots", "<a>&x;</a>": "undefinedEntity", "<a b='1' b='2'/>": "duplicateAttribute", "<a>]]></a>": "cdataEndInText", "<p:a/>": "unboundPrefix", "<!DOCTYPE a><a/>": "doctypeForbidden", "": "noRoot", "<a b='<'/>": "lessThanInAttribute", "<a b='1'c='2'/>": "missingSpace", "x<a/>": "contentOutsideRoot", "<a>\x01</a>": "invalidCharacter"}
    for text, code in bad.items():
        with pytest.raises(xml.XMLFault) as e:
            xml.Reader().read(text)
        assert e.value.code == code, text
    noted = {r.doc_id: r.code for r in shred.faults(documents(spark, *bad)).collect()}
    assert set(noted.values()) <= set(bad.values()) and len(noted) == len(bad)
    assert shred.read_xml(documents(spark, "<a><b></a>"), mode="drop").count() == 0
    assert shred.read_xml(documents(spark, "<a><b></a>"), mode="permissive").count() == 3


def test_limits_and_entities():
    with pytest.raises(xml.XMLFault, match="depthLimit"):
        xml.Reader(xml.Limits(max_depth=5)).read("<a>" * 6)
    laughs = "<!DOCTYPE a [<!ENTITY a 'ha'>" + "".join(f"<!ENTITY {chr(98 + i)} '{f'&{chr(97 + i)};' * 10}'>" for i in range(8)) + "]><a>&i;</a>"
    with pytest.raises(xml.XMLFault, match="entityExpansionLimit"):
        xml.Reader(xml.Limits(allow_doctype=True)).read(laughs)
    with pytest.raises(xml.XMLFault, match="recursiveEntity"):
        xml.Reader(xml.Limits(allow_doctype=True)).read("<!DOCTYPE a [<!ENTITY a '&b;'><!ENTITY b '&a;'>]><a>&a;</a>")
    rows = xml.Reader(xml.Limits(allow_doctype=True)).read("<!DOCTYPE a [<!ENTITY e 'x&#38;#38;y'>]><a>&e;&#x41;</a>")
    assert rows[-1][9] == "x&yA"


def test_html_nesting_and_raw_text():
    rows = html.read("<title>a&amp;b</title><p>x<b>y<p>z<ul><li>1<li>2</ul><script>if(1<2)'</p>'</script>")
    paths = [r[15] if len(r) > 18 else None for r in rows if r[5] == "element"]
    assert paths == ["/html", "/html/head", "/html/head/title", "/html/body", "/html/body/p", "/html/body/p/b", "/html/body/p/b/p", "/html/body/p/b/ul", "/html/body/p/b/ul/li", "/html/body/p/b/ul/li", "/html/body/p/b/script"]
    assert rows[-1][9] == "if(1<2)'</p>'"
    assert [r[7] for r in html.read("x<br>y", document=False) if r[5] == "element"] == ["br"]


# XPath

SETS = {
    "//title": ["One", "Two", "Mag", "Z"],
    "/catalog/book[2]/title": ["Two"],
    "//book[@id='b2']/title": ["Two"],
    "/catalog/*[last()]": ["5", "Z"],
    "//title[../@lang]": ["One"],
    "(//title)[2]": ["Two"],
    "//book[1]/following-sibling::*": ["Two", "Mag", "5"],
    "//title/ancestor::book": ["OneA", "Two", "Z"],
    "//magazine/preceding::title": ["One", "Two"],
    "//author/following::title": ["Two", "Mag"],
    "//title/parent::magazine": ["Mag"],
    "//m:x": ["5"],
    "//x": ["5"],
    "//author | //magazine": ["A", "Mag"],
    "//book[position()<2]/@id": ["b1", "z"],
    "id('b1')/title": ["One"],
    "//*[namespace-uri()='urn:m']": ["5"],
    "//book[count(*)=2]/@id": ["b1"],
    "//x[@n<.]": ["5"],
    "//book[not(author)]/@id": ["b2", "z"],
    "//book[contains(title,'w')]/@id": ["b2"],
    "//magazine/preceding-sibling::book[1]/@id": ["b2"],
    "set:leading(//book, //book[@id='b2'])/@id": ["b1", "z"],
    "math:lowest(//x)": ["5"],
    "//author/ancestor-or-self::*[1]": ["A"],
    "//title/text()[1]": ["One", "Two", "Mag", "Z"],
    "//@id/..": ["OneA", "Two", "Z"],
    "//book[2.5]": [],
}


@pytest.mark.parametrize("path", SETS)
def test_node_sets(catalog, path):
    rows = select(catalog, path).orderBy("doc_id", "pre", "band", "sub").collect()
    assert [r.value for r in rows] == SETS[path]


VALUES = {
    "count(//book)": 2.0,
    "sum(//x) + 1": 6.0,
    "1 div 0": float("inf"),
    "string(0 div 0)": "NaN",
    "string(-1 div 0)": "-Infinity",
    "string(1000000)": "1000000",
    "string(0.1)": "0.1",
    "string(-0.5)": "-0.5",
    "5 mod -2": 1.0,
    "-5 mod 2": -1.0,
    "substring('12345', 1.5, 2.6)": "234",
    "substring('12345', 0, 3)": "12",
    "substring('12345', 0 div 0, 3)": "",
    "substring('12345', -42, 1 div 0)": "12345",
    "substring-before('1999/04', '/')": "1999",
    "substring-after('1999/04', '/')": "04",
    "normalize-space('  a \n b ')": "a b",
    "translate('--aaa--', 'abc-', 'ABC')": "AAA",
    "round(-2.5)": -2.0,
    "floor(-1.5)": -2.0,
    "ceiling(1.2)": 2.0,
    "number('1e3') = number('1e3')": False,
    "true() = 1": True,
    "'a' != //title": True,
    "//nothing != //nothing": False,
    "//title = //magazine": True,
    "2 > //x": False,
    "concat('a', 1, true())": "a1true",
    "name(//m:x)": "m:x",
    "local-name(//m:x)": "x",
    "boolean(//nothing)": False,
    "starts-with('abc', '')": True,
    "contains('abc', '')": True,
    "string-length('héllo')": 5.0,
    "exsl:object-type(//x)": "node-set",
    "$v + 1": 3.0,
    "not(1 = 1) or 2 > 1 and 3 != 4": True,
    "- - 3": 3.0,
    "2 * 3 - 4 div 2": 4.0,
}


@pytest.mark.parametrize("expression", VALUES)
def test_values(catalog, expression):
    assert {r.doc_id: r.value for r in evaluate(catalog, expression, variables={"v": 2}).collect()}[1] == VALUES[expression]


def test_lang_namespaces_and_keys(catalog):
    assert [r.value for r in select(catalog, "//title[lang('en')]").where("doc_id = 1").orderBy("pre").collect()] == ["One", "Two", "Mag"]
    assert select(catalog, "//p:x", namespaces={"p": "urn:m"}).count() == 1
    assert select(catalog, "//x", namespaces={"p": "urn:m"}).count() == 0
    assert [r.value for r in select(catalog, "key('k', 'b2')/title", keys={"k": ("book", "@id")}).collect()] == ["Two"]
    assert {r.name for r in select(catalog, "//m:x/namespace::*").collect()} == {"m", "xml"}


@pytest.mark.parametrize("bad", ["//", "a[", "1 +", "foo(", "@@a", "child::", "a/'x'", "nope::a"])
def test_bad_expressions(bad):
    with pytest.raises(XPathError):
        parse(bad)


def test_downward_paths_need_no_join(spark, catalog, capsys):
    select(catalog, "//book/title").explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan


def test_values_agree_with_the_built_in_functions(spark):
    df = documents(spark, "<r><a n='1'>x</a><a n='2'>y<b>z</b></a></r>")
    nodes = store.stored(shred.read_xml(df))
    for e in ("count(//a)", "sum(//@n)", "count(//a[b])", "string-length(//a[2])"):
        ours = evaluate(nodes, e).first().value
        assert ours == df.select(F.xpath_double("xml", F.lit(e)).alias("v")).first().v
    for e in ("string(//a[@n=2])", "name(//*[b])", "//a[last()]/b"):
        assert evaluate(nodes, e).first().value == df.select(F.xpath_string("xml", F.lit(e)).alias("v")).first().v


# writing


def test_serialization_round_trip_and_options(spark):
    text = '<?pi x?><!-- c --><a xmlns="u" xmlns:b="v" z="1" b:y="&lt;&quot;&#10;"><b:c/><d>t &amp; <![CDATA[<u>]]></d><e xmlns=""><f/></e></a>'
    nodes = store.stored(shred.read_xml(documents(spark, text)))
    assert emit.serialize(nodes).first().text == text
    o = emit.Options(ascii_only=True, declaration=True, quote="'", self_close=False, cdata_as_text=True)
    assert "<b:c></b:c>" in (out := emit.serialize(nodes, o).first().text) and out.startswith("<?xml version") and "&lt;u&gt;" in out and "z='1'" in out
    flat = shred.read_xml(documents(spark, "<a><b>x</b><c><d/></c></a>"))
    assert emit.serialize(flat, emit.Options(pretty=True)).first().text == "<a>\n  <b>x</b>\n  <c>\n    <d/>\n  </c>\n</a>"


def test_canonical_forms(spark):
    nodes = store.stored(shred.read_xml(documents(spark, '<!--x--><a  xmlns:q="w" b="2" a="1"><c q:z="&#9;"/><!--y--></a>')))
    assert emit.canonical(nodes).first().text == '<a xmlns:q="w" a="1" b="2"><c q:z="&#x9;"></c></a>'
    assert emit.canonical(nodes, comments=True).first().text.startswith("<!--x-->\n<a")
    assert emit.canonical(nodes, exclusive=True).first().text == '<a a="1" b="2"><c xmlns:q="w" q:z="&#x9;"></c></a>'


def test_html_serialization(spark):
    df = spark.createDataFrame([(1, "<p class=x hidden>a&lt;<br>y<script>1<2</script>")], "doc_id bigint, html string")
    assert emit.serialize_html(shred.read_html(df)).first().text == '<html><head></head><body><p class="x" hidden>a&lt;<br>y<script>1<2</script></p></body></html>'


# patterns and pointers


def test_patterns(catalog):
    found = lambda p: sorted((r.doc_id, r.path) for r in patterns.matches(catalog, p).collect())
    assert found("book/@id") == [(1, "/catalog/book/@id"), (1, "/catalog/book/@id"), (2, "/catalog/book/@id")]
    assert found("/catalog//author") == [(1, "/catalog/book/author")]
    assert found("/book") == [] and found("m:*") == [(1, "/catalog/m:x")]
    with pytest.raises(patterns.PatternError):
        patterns.compile_pattern("a[1]")


def test_pointers(catalog):
    value = lambda p: sorted((r.doc_id, r.value) for r in xpointer.resolve(catalog, p).collect())
    assert value("b2") == [(1, "Two")]
    assert value("element(/1/2/1)") == [(1, "Two")]
    assert value("element(b1/2)") == [(1, "A")]
    assert value("xpointer(//none)xpointer(//author)") == [(1, "A")]
    assert value("xmlns(p=urn:m)xpointer(//p:x)") == [(1, "5")]
    assert [r.name for r in xpointer.resolve(catalog, "xpointer(string-range(//title,'o'))").collect()] == ["3"]
    with pytest.raises(xpointer.PointerError):
        xpointer.parts("xpointer(")


# types

_T = D.SimpleType
TYPES = [
    ("boolean", "true", True), ("boolean", "yes", False), ("int", "2147483648", False), ("unsignedLong", "18446744073709551615", True), ("unsignedLong", "18446744073709551616", False),
    ("date", "2023-02-29", False), ("date", "2024-02-29Z", True), ("dateTime", "2024-01-01T24:00:00", True), ("duration", "P1Y2M3DT4H5M6.7S", True), ("duration", "P", False),
    ("NCName", "a:b", False), ("NMTOKENS", "a b", True), ("NMTOKENS", "", False), ("hexBinary", "0AF", False), ("base64Binary", "YQ==", True), ("float", "INF", True), ("decimal", "1e5", False),
    (_T("decimal", (("totalDigits", 3),)), "012.30", True), (_T("decimal", (("totalDigits", 3),)), "1234", False), (_T("integer", (("maxExclusive", "-5"),)), "-10", True),
    (_T("integer", (("maxExclusive", "-5"),)), "-4", False), (_T("decimal", (("enumeration", ("1.0",)),)), "01", True), (_T("duration", (("maxInclusive", "P30D"),)), "P1M", False),
    (_T("duration", (("maxInclusive", "P32D"),)), "P1M", True), (_T("dateTime", (("minInclusive", "2024-01-01T00:00:00Z"),)), "2024-01-01T01:00:00+02:00", False),
    (_T(item=_T("int"), facets=(("maxLength", 2),)), "1 2 3", False), (_T(members=(_T("int"), _T("boolean"))), "true", True), (_T("string", (("pattern", ("[A-Z]+", "[0-9]+")),)), "42", True),
]


def test_types(spark):
    columns = [D.is_valid(F.lit(v), t).alias(f"c{i}") for i, (t, v, _) in enumerate(TYPES)]
    row = spark.range(1).select(*columns).first()
    assert [(t, v) for i, (t, v, ok) in enumerate(TYPES) if row[i] != ok] == []


@pytest.mark.parametrize("source,yes,no", [("[a-z-[aeiou]]+", "bcd", "bad"), (r"\d{2,3}", "12", "1"), (r"\i\c*", "a-b", "-a"), ("a|b", "a", "ab"), ("^a$", "^a$", "a"), (r"\p{IsBasicLatin}+", "abc", "é"), ("a.c", "abc", "a\nc")])
def test_regexes(spark, source, yes, no):
    j = regexes.translate(source)
    assert tuple(spark.range(1).select(F.lit(yes).rlike(j), F.lit(no).rlike(j)).first()) == (True, False)


def test_bad_regexes():
    for bad in ("(", "a{2,1}", "[a", "*a", r"\q"):
        with pytest.raises(regexes.RegexError):
            regexes.translate(bad)


# validation


def test_identity_dtd_and_schematron(spark):
    nodes = store.stored(shred.read_xml(documents(spark, '<l><b isbn="1"><t>x</t></b><b><t>y</t><a/></b><b isbn="01"/></l>')))
    assert [r.pre for r in identity.unique(nodes, "/l", "b", ["@isbn"], ["integer"]).collect()] == [9]
    assert identity.unique(nodes, "/l", "b", ["@isbn"]).count() == 0
    assert sorted(r.reason for r in identity.unique(nodes, "/l", "b", ["@isbn"], ["integer"], key=True).collect()) == ["duplicate", "missing field"]
    dtd = validation.DTD("<!ELEMENT l (b+)><!ELEMENT b (t?,a*)><!ELEMENT t (#PCDATA)><!ATTLIST b isbn ID #REQUIRED k CDATA 'v'>")
    assert sorted((r.rule, r.pre) for r in dtd.validate(nodes).collect()) == [("dtd-required-attribute", 5), ("dtd-undeclared-element", 8)]
    assert {r.value for r in select(dtd.with_defaults(nodes), "//b/@k").collect()} == {"v"}
    rules = schematron.Schematron('<schema xmlns="http://purl.oclc.org/dsdl/schematron"><let name="k" value="count(t)"/><pattern id="p"><rule context="b[a]"><assert test="@isbn">no isbn, <value-of select="$k"/> <name/></assert></rule><rule context="b"><assert test="t">title</assert></rule></pattern></schema>')
    assert sorted(tuple(r)[1:] for r in rules.validate(nodes).collect()) == [("p", 1, "error", "no isbn, 1 b", 5), ("p", 2, "error", "title", 9)]


def test_html_rules(spark):
    df = spark.createDataFrame([(1, "<p id=a><li id=a>x<td>")], "doc_id bigint, html string")
    found = validation.validate(shred.read_html(df), list(validation.RULES)).collect()
    assert sorted((r.rule, r.reason) for r in found) == [("html-required-parent", "li in p"), ("html-required-parent", "td in li"), ("html-unique-id", "id a is repeated")]


# queries

FAST = ["html_links", "html_titles", "html_paragraphs", "html_language", "xpath_positions", "xpath_following_sibling", "exslt_difference_intersection", "identity_unique", "key_join", "canonical_digest", "schematron_events"]


@pytest.mark.parametrize("name", FAST)
def test_queries_agree_with_sql(spark, name):
    import os

    from treeframe.queries import QUERIES, SQL

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for f in os.listdir(d):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    ours, theirs = QUERIES[name](spark, d).toPandas(), c.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)
