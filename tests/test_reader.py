"""Start tags are read alike whichever way their attributes are written."""

from __future__ import annotations

import gc
import random
import time

import pytest

from treeframe.sources import xml


def rows(text: str, **limits) -> list[list]:
    """Rows without their columns in the line, which the way of writing shifts."""
    return [r[:-1] for r in xml.Reader(xml.Limits(**limits)).read(text)]


def test_plain_and_other_attributes_give_the_same_rows():
    draw = random.Random(7)
    names = ["k", "long.name", "é", "b:k", "xml:lang", "n-1"]
    for _ in range(300):
        plain, other = '<r xmlns:b="u">', "<r xmlns:b = 'u'>"
        for _ in range(draw.randint(0, 5)):
            held = [(k, draw.choice(["", "v", "1 2", ">", "/", "xmlns"])) for k in draw.sample(names, draw.randint(0, 4))]
            empty = draw.random() < 0.5
            plain += "<b:e" + "".join(f' {k}="{v}"' for k, v in held) + ("/>" if empty else "></b:e>")
            other += "<b:e" + "".join(f" {k} = '{v}'" for k, v in held) + (" />" if empty else "></b:e >")
        assert rows(plain + "</r>") == rows(other + "</r>")


def test_names_are_resolved_in_their_own_scope():
    text = '<a xmlns="u" xmlns:p="v"><p:b p:k="1" k="1"/><c xmlns="" xmlns:p="w"><p:b p:k="1"/><b/></c><p:b p:k="1"/><b/></a>'
    found = [(r[7], r[8], r[11] and [a[2] for a in r[11]]) for r in rows(text) if r[5] == "element"]
    assert found == [("a", "u", []), ("b", "v", ["v", ""]), ("c", "", []), ("b", "w", ["w"]), ("b", "", []), ("b", "v", ["v"]), ("b", "u", [])]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ('<a k="1" k="2"/>', "duplicateAttribute"),
        ('<a xmlns:p="u" xmlns:q="u" p:k="1" q:k="2"/>', "duplicateAttribute"),
        ('<a k="1"l="2"/>', "missingSpace"),
        ('<a k="1" l/>', "malformedAttribute"),
        ('<a k="<"/>', "lessThanInAttribute"),
        ('<a k="&x;"/>', "undefinedEntity"),
        ('<a p:k="1"/>', "unboundPrefix"),
        ("<a/><b/>", "multipleRoots"),
        ("<a><b></a>", "unclosedElement"),
        ('<a k="1/>', "malformedMarkup"),
    ],
)
def test_faults_of_start_tags(text, code):
    with pytest.raises(xml.XMLFault) as e:
        xml.Reader().read(text)
    assert e.value.code == code


def test_an_unbound_prefix_is_a_fault_each_time():
    reader = xml.Reader(recover=True)
    reader.read("<a><p:b/><p:b/></a>")
    assert [f[0] for f in reader.faults] == ["unboundPrefix"] * 2


def test_long_faulty_tags_take_linear_time():
    began = time.process_time()
    with pytest.raises(xml.XMLFault):
        xml.Reader().read("<r><a " + "k='v' " * 100_000 + '"')
    assert time.process_time() - began < 5


def test_shredding_restores_the_collector():
    import pyarrow as pa

    from treeframe.sources import shred

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["<a/>", None, "<a>t</a>"]})
    run = shred._shredder(lambda s: xml.Reader().read(s), ["pre", "kind"])
    assert gc.isenabled()
    assert [b.num_rows for b in run(iter([batch]))] == [5]
    assert gc.isenabled()
