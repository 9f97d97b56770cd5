"""The node table: one row for each tree node, in document order.

A document is the rows of one doc_id. ``pre`` is a node's number in document order (the document node has 0) and ``last``
that of its last descendant, so ``b`` is below ``a`` if ``a.pre < b.pre <= a.last``. ``anc`` lists the ancestors' numbers,
which makes the ancestor relation an equi-join; ``path`` has the names from the root, which makes a downward path without
predicates a filter. Attributes and namespace bindings are held by their element, and become nodes of their own (band 2
and 1 of the order key) where a query asks for them.
"""

from __future__ import annotations

ATTRIBUTE = "struct<prefix:string,local:string,ns:string,value:string>"
#: Columns of the node table besides doc_id.
FIELDS = {
    "pre": "int",
    "last": "int",
    "parent": "int",
    "level": "int",
    "sib": "int",
    "kind": "string",
    "prefix": "string",
    "local": "string",
    "ns": "string",
    "value": "string",
    "sval": "string",
    "attrs": f"array<{ATTRIBUTE}>",
    "nsmap": "map<string,string>",
    "nsown": "map<string,string>",
    "anc": "array<int>",
    "path": "string",
    "lang": "string",
    "line": "int",
    "col": "int",
}
#: Of a document that could not be read without error, a row for each fault.
FAULTS = {"code": "string", "message": "string", "line": "int", "col": "int"}


def ddl(fields: dict[str, str], doc: str = "bigint") -> str:
    return ", ".join([f"doc_id {doc}", *(f"`{k}` {v}" for k, v in fields.items())])
