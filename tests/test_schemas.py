"""Schemas, stylesheets, inclusion, catalogs, encodings, tree edits and streams."""

import os

import pytest
from pyspark.sql import functions as F

from treeframe.functions import encodings, uri
from treeframe.operators import catalogs, emit, trees, xinclude, xsd
from treeframe.plans import local, relaxng, xslt
from treeframe.sources import shred, store
from treeframe.sources.xml import Reader
from treeframe.streaming import documents as streams

from test_engine import CATALOG, SETS, VALUES, documents

XSL = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output omit-xml-declaration="yes"/>%s</xsl:stylesheet>'
SOURCE = '<l><i k="b" n="2">x</i><i k="a" n="10">y</i><i k="b" n="1">z<!--c--></i></l>'


def test_both_xpath_evaluators_agree():
    roots = [local.build(Reader().read(t), i) for i, t in enumerate((CATALOG, '<catalog><book id="z"><title>Z</title></book></catalog>'))]
    for path, want in SETS.items():
        assert [n.string() for r in roots for n in local.ordered(local.run(path, local.Context(r)))] == want, path
    for e, want in VALUES.items():
        assert local.run(e, local.Context(roots[0], {"v": 2.0})) == want, e


STYLES = {
    '<xsl:template match="/"><o><xsl:for-each select="l/i"><xsl:sort select="@n" data-type="number" order="descending"/><p q="{@k}-{position()}"><xsl:value-of select="."/></p></xsl:for-each></o></xsl:template>': '<o><p q="a-1">y</p><p q="b-2">x</p><p q="b-3">z</p></o>',
    '<xsl:template match="@*|node()"><xsl:copy><xsl:apply-templates select="@*|node()"/></xsl:copy></xsl:template><xsl:template match="i[@k=\'a\']"/>': '<l><i k="b" n="2">x</i><i k="b" n="1">z<!--c--></i></l>',
    '<xsl:key name="k" match="i" use="@k"/><xsl:template match="/"><xsl:for-each select="//i[generate-id()=generate-id(key(\'k\',@k)[1])]"><g k="{@k}" n="{count(key(\'k\',@k))}"/></xsl:for-each></xsl:template>': '<g k="b" n="2"/><g k="a" n="1"/>',
    '<xsl:template match="/"><xsl:call-template name="f"><xsl:with-param name="n" select="5"/></xsl:call-template></xsl:template><xsl:template name="f"><xsl:param name="n" select="1"/><xsl:choose><xsl:when test="$n &lt;= 1">1</xsl:when><xsl:otherwise><xsl:variable name="r"><xsl:call-template name="f"><xsl:with-param name="n" select="$n - 1"/></xsl:call-template></xsl:variable><xsl:value-of select="$n * $r"/></xsl:otherwise></xsl:choose></xsl:template>': "120",
    '<xsl:template match="i"><xsl:number format="1. "/><xsl:number level="any" format="[a]"/>;</xsl:template>': "1. [a];2. [b];3. [c];",
    '<xsl:template match="i"><xsl:value-of select="format-number(@n * 1234.567, \'#,##0.00\')"/>;</xsl:template>': "2,469.13;12,345.67;1,234.57;",
    '<xsl:template match="/"><xsl:element name="e{1+1}"><xsl:attribute name="a">v</xsl:attribute><xsl:comment>c</xsl:comment></xsl:element></xsl:template>': '<e2 a="v"><!--c--></e2>',
    '<xsl:template match="i" priority="2">P</xsl:template><xsl:template match="i[1]">Q</xsl:template>': "PPP",
    '<xsl:template match="/"><xsl:apply-templates select="//i" mode="m"/></xsl:template><xsl:template match="i" mode="m"><xsl:if test="position()=last()">L</xsl:if></xsl:template>': "L",
}


@pytest.mark.parametrize("style", STYLES)
def test_stylesheets(style):
    assert xslt.Stylesheet(XSL % style).transform(SOURCE) == STYLES[style]


def test_import_params_and_faults(spark):
    load = {"b": XSL % '<xsl:template match="i">I(<xsl:value-of select="@k"/>)</xsl:template>'}
    sheet = XSL % '<xsl:import href="b"/><xsl:param name="p" select="0"/><xsl:template match="i[1]">T<xsl:value-of select="$p"/><xsl:apply-imports/></xsl:template>'
    out = xslt.transform(documents(spark, SOURCE, "<bad", None), sheet, params={"p": 7.0}, resources=load).orderBy("doc_id").collect()
    assert out[0].output == "T7I(b)I(a)I(b)" and out[1].output is None and out[1].error and out[2] == (3, None, None)
    with pytest.raises(ValueError):
        xslt.transform(documents(spark, SOURCE), XSL % '<xsl:include href="none"/>')


RNG = '<element name="b" xmlns="http://relaxng.org/ns/structure/1.0"><zeroOrMore><element name="c"><attribute name="n"><data type="int"/></attribute><optional><attribute name="e"/></optional><interleave><element name="x"><text/></element><optional><element name="y"><empty/></element></optional></interleave></element></zeroOrMore></element>'


@pytest.mark.parametrize("text,valid", [("<b/>", True), ('<b><c n="1"><y/><x>t</x></c></b>', True), ('<b><c n="q"><x/></c></b>', False), ('<b><c n="1"/></b>', False), ("<b><c><x/></c></b>", False), ("<b>t</b>", False), ('<b> <c n="1" e=""> <x/> </c> </b>', True), ('<b><c n="1"><x/><x/></c></b>', False), ("<z/>", False)])
def test_relaxng(text, valid):
    assert relaxng.Grammar(RNG).check(text)[0] is valid


def test_relaxng_recursion_lists_and_grammars():
    g = relaxng.Grammar('<grammar xmlns="http://relaxng.org/ns/structure/1.0"><start><ref name="t"/></start><define name="t"><element name="t"><choice><text/><oneOrMore><ref name="t"/></oneOrMore></choice></element></define></grammar>')
    assert g.check("<t><t>x</t><t/></t>")[0] and not g.check("<t><t/>x</t>")[0]
    g = relaxng.Grammar('<element name="l" xmlns="http://relaxng.org/ns/structure/1.0"><list><oneOrMore><data type="integer"><param name="minInclusive">3</param></data></oneOrMore></list></element>')
    assert [g.check(f"<l>{x}</l>")[0] for x in ("3 4", "2", "")] == [True, False, False]
    with pytest.raises(relaxng.GrammarError):
        relaxng.Grammar('<nope xmlns="http://relaxng.org/ns/structure/1.0"/>')


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="o"><xs:complexType><xs:sequence><xs:element name="a" type="xs:int" maxOccurs="3"/><xs:choice minOccurs="0"><xs:element name="b" type="T"/><xs:any/></xs:choice></xs:sequence><xs:attribute name="k" use="required" type="K"/></xs:complexType><xs:unique name="u"><xs:selector xpath="a"/><xs:field xpath="."/></xs:unique></xs:element>
<xs:simpleType name="K"><xs:restriction base="xs:string"><xs:pattern value="[A-Z]+"/></xs:restriction></xs:simpleType><xs:complexType name="T"><xs:all><xs:element name="p" type="xs:date"/><xs:element name="q" type="T" minOccurs="0"/></xs:all></xs:complexType></xs:schema>"""


def test_xsd(spark):
    texts = ['<o k="A"><a>1</a><b><q><p>2024-01-01</p></q><p>2024-02-01</p></b></o>', "<o><a>x</a></o>", '<o k="a"><a>1</a><a>1</a><z><any/></z></o>', '<o k="A" j="1"><b/></o>', '<o k="A">t<a>1</a><b><p>2024-13-01</p><p>2024-01-01</p></b></o>', "<w/>"]
    nodes = store.stored(shred.read_xml(documents(spark, *texts)))
    found = sorted((r.doc_id, r.rule, r.pre) for r in xsd.Schema(XSD).validate(nodes).collect())
    assert found == [(2, "xsd-required-attribute", 1), (2, "xsd-value", 2), (3, "xsd-attribute-value", 1), (3, "xsd-unique", 4), (4, "xsd-content", 1), (4, "xsd-content", 2), (4, "xsd-undeclared-attribute", 1), (5, "xsd-content", 5), (5, "xsd-text", 1), (5, "xsd-value", 6), (6, "xsd-undeclared-element", 1)]
    with pytest.raises(xsd.SchemaError):
        xsd.Schema("<nope/>")


REFERENCES = {"g": "http://a/b/c/g", "../g": "http://a/b/g", "../../../g": "http://a/g", "?y": "http://a/b/c/d;p?y", "#s": "http://a/b/c/d;p?q#s", "./": "http://a/b/c/", "..": "http://a/b/", "//g": "http://g", "/./g": "http://a/g", "g;x=1/../y": "http://a/b/c/y", "": "http://a/b/c/d;p?q", "g:h": "g:h"}


@pytest.mark.parametrize("reference", REFERENCES)
def test_references(reference):
    assert uri.resolve("http://a/b/c/d;p?q", reference) == REFERENCES[reference]


def test_catalogs(spark):
    entries = catalogs.parse_oasis('<catalog xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog" xml:base="http://x/"><system systemId="a" uri="b"/><rewriteSystem systemIdStartString="http://o/" rewritePrefix="l/"/><rewriteSystem systemIdStartString="http://o/p/" rewritePrefix="m/"/><public publicId="-//P" uri="p"/><systemSuffix systemIdSuffix=".dtd" uri="s"/></catalog>')
    ids = spark.createDataFrame([(1, None, "a", None), (2, None, "http://o/p/q", None), (3, " -//P ", None, None), (4, None, "zz/x.dtd", None), (5, None, "no", None)], "id int, public string, system string, uri string")
    got = {r.id: r.target for r in catalogs.resolve_identifiers(ids, catalogs.rules(spark, entries)).collect()}
    assert got == {1: "http://x/b", 2: "http://x/m/q", 3: "http://x/p", 4: "http://x/s", 5: None}
    assert catalogs.parse_sgml('PUBLIC "-//X" "x.dtd" -- c -- OVERRIDE YES SYSTEM "q" "r"', "http://b/") == [("public", "-//X", "http://b/x.dtd", False), ("system", "q", "http://b/r", True)]
    chain = {"a": '<catalog xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog"><nextCatalog catalog="b"/></catalog>', "b": 'SYSTEM "s" "t" CATALOG "a"'}
    assert ("system", "s", "t", False) in catalogs.closure("a", chain.get)


def test_inclusion(spark):
    xi = 'xmlns:xi="http://www.w3.org/2001/XInclude"'
    docs = spark.createDataFrame([(1, f'<r {xi}><xi:include href="a.xml"/><xi:include href="t.txt" parse="text"/><xi:include href="no"><xi:fallback>fb</xi:fallback></xi:include></r>', "http://h/d"), (2, f'<r {xi}><xi:include href="l"/></r>', "http://h/l"), (3, f'<r {xi}><xi:include href="gone"/></r>', "http://h/g")], "doc_id bigint, xml string, uri string")
    held = spark.createDataFrame([("http://h/a.xml", f'<a {xi}><xi:include href="b.xml" xpointer="k"/></a>'), ("http://h/b.xml", '<b><c id="k">in</c></b>'), ("http://h/t.txt", "1<2"), ("http://h/l", f'<r {xi}><xi:include href="l"/></r>')], "uri string, content string")
    out = {r.doc_id: r for r in xinclude.include(docs, held).collect()}
    assert out[1].xml.replace(f" {xi}", "") == '<r><a><c id="k">in</c></a>1&lt;2fb</r>'
    assert "includes itself" in out[2].error and "no resource" in out[3].error


def test_encodings(spark):
    assert encodings.decode_bytes("<a>é</a>".encode("utf-16")) == "<a>é</a>"
    text = '<?xml version="1.0" encoding="koi8-r"?><a>я</a>'
    assert encodings.decode_bytes(text.encode("koi8-r")) == text
    df = spark.createDataFrame([(bytearray("語".encode("gbk")), "é語")], "b binary, t string")
    row = df.select(encodings.decode(F.col("b"), "GBK"), encodings.encode(F.col("t"), "ISO-8859-1"), encodings.decode_detected(F.col("t").cast("binary"))).first()
    assert (row[0], bytes(row[1]), row[2]) == ("語", b"\xe9&#35486;", "é語")


def test_tree_edits(spark):
    nodes = store.stored(shred.read_xml(documents(spark, '<a><b>x</b><c k="1">y<d/></c><b/></a>')))
    text = lambda n: emit.serialize(n).first().text
    assert text(trees.remove(nodes, F.col("local") == "c")) == "<a><b>x</b><b/></a>"
    assert text(trees.set_attribute(nodes, F.col("local") == "d", "q", F.lit(5))) == '<a><b>x</b><c k="1">y<d q="5"/></c><b/></a>'
    assert text(trees.remove_attribute(nodes, F.col("local") == "c", "k")) == "<a><b>x</b><c>y<d/></c><b/></a>"
    assert text(trees.append(nodes, F.col("local") == "b", '<z i="1"><y>t</y></z>')) == '<a><b>x<z i="1"><y>t</y></z></b><c k="1">y<d/></c><b><z i="1"><y>t</y></z></b></a>'
    gone = trees.remove(nodes, F.col("local") == "c")
    assert sorted((r.pre, r.last, r.parent) for r in gone.collect() if r.parent is not None) == [(1, 4, 0), (2, 3, 1), (3, 3, 2), (4, 4, 1)]


def test_streams(spark, tmp_path):
    schema = "doc_id string, seq bigint, chunk string, last boolean"
    for i, part in enumerate(["<a>", "x<b/>", "</a>"]):
        spark.createDataFrame([(f"d{k}", i, part, i == 2) for k in range(2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chunks"))
    q = streams.read_chunks(chunks, mode="permissive").select("doc_id", "pre").writeStream.format("memory").queryName("chunked").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("SELECT doc_id, count(*) FROM chunked GROUP BY doc_id").collect()) == [("d0", 4), ("d1", 4)]
    os.makedirs(tmp_path / "files")
    (tmp_path / "files" / "x.xml").write_text("<a>\n<b/></a>")
    q = streams.read_files(spark, str(tmp_path / "files")).writeStream.format("memory").queryName("filed").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.sql("SELECT * FROM filed").count() == 4


def test_relaxng_compact():
    from treeframe.plans import relaxng_compact

    g = relaxng_compact.compile_compact("""# cards
namespace p = "urn:p"
start = book
book = element book { attribute id { xsd:ID }?, card*, element p:note { text }? }
card = element card { (element name { text } & element age { xsd:int { minInclusive = "0" } }?), attribute kind { "a" | "b" } }
""")
    good = ["<book/>", '<book id="x"><card kind="a"><age>3</age><name>n</name></card></book>', '<book><n:note xmlns:n="urn:p">x</n:note></book>']
    bad = ['<book><card kind="c"><name/></card></book>', '<book><card kind="a"><age>-3</age><name/></card></book>', "<book><note/></book>", '<book><card kind="a"/></book>']
    assert [g.check(x)[0] for x in good + bad] == [True] * len(good) + [False] * len(bad)
    assert relaxng_compact.compile_compact('element a { list { xsd:int+ } }').check("<a>1 2</a>")[0]
    with pytest.raises(relaxng.GrammarError):
        relaxng_compact.to_xml("element a { b, c | d }")


def test_lint_and_declarations(spark):
    from treeframe import api

    df = documents(spark, "<?xml version='1.0' encoding=\"utf-8\"?><a><b></a>", "<a/>")
    assert [(r.doc_id, r.rule) for r in api.lint(df).collect()] == [(1, "unclosedElement")]
    assert [tuple(r) for r in api.text_declaration(df).orderBy("doc_id").collect()] == [(1, "1.0", "utf-8", None), (2, None, None, None)]


def test_typed_projection(spark):
    import datetime
    import decimal

    from treeframe.operators import projection

    nodes = store.stored(shred.read_xml(documents(spark, '<r><i n=" 1 " d="2024-02-29" b="1" x="1e2"><p>3.50</p></i><i n="x" d="2023-02-29"/></r>')))
    columns = {"n": ("@n", "int"), "d": ("@d", "date"), "b": ("@b", "boolean"), "x": ("@x", "double"), "p": ("p", "decimal"), "k": ("count(p)", "int"), "parent": ("name(..)", "string")}
    rows = projection.project(nodes, "/r/i", columns).orderBy("pre").collect()
    assert tuple(rows[0])[2:] == (1, datetime.date(2024, 2, 29), True, 100.0, decimal.Decimal("3.500000000000000000"), 1, "r")
    assert tuple(rows[1])[2:] == (None, None, None, None, None, 0, "r")
