"""Column functions: checks of names, ids and sizes, filters over flattened fields, and the one UDF."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jsontext

# Fixed values of the data model.
MAX_ID_BYTES = 256
MAX_NAME = 64
MAX_LIMIT = 1000

CANONICAL = T.StructType([T.StructField("doc", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])


BAD_NAME = "a collection's name is 1 to 64 letters, digits, _ or -"
BAD_ID = "an id is 1 to 256 bytes without control characters"


def naming_problem(collection: str, id: str | None = None) -> str | None:
    """The same checks for one name, on the driver."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", collection):
        return BAD_NAME
    if id is not None and not (1 <= len(id.encode()) <= MAX_ID_BYTES and all(unicodedata.category(c) != "Cc" for c in id)):
        return BAD_ID
    return None


def valid_collection(name: Column) -> Column:
    """1 to 64 ASCII letters, digits, ``_`` or ``-``; false for null."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), F.lit(False))


def valid_id(id: Column) -> Column:
    """1 to 256 bytes without control characters; false for null."""
    return F.coalesce(F.octet_length(id).between(1, MAX_ID_BYTES) & ~id.rlike(r"\p{Cc}"), F.lit(False))


def crc32(value: Column) -> Column:
    return F.crc32(value.cast("binary"))


def equals(path: str, wanted: str, fields: str = "fields", doc: str = "doc") -> Column:
    """Whether a document's field has this text; false where it is missing. Texts too long for the flattened fields are looked up in the document."""
    if len(wanted.encode()) > jsontext.MAX_FIELD_BYTES:
        return F.coalesce(_long_match(path, wanted)(F.col(doc)), F.lit(False))
    return F.coalesce(F.try_element_at(F.col(fields), F.lit(path)) == wanted, F.lit(False))


def all_equal(filters, fields: str = "fields", doc: str = "doc") -> Column:
    return reduce(lambda a, b: a & b, (equals(p, w, fields, doc) for p, w in filters), F.lit(True))


def _long_match(path: str, wanted: str):
    @F.arrow_udf(T.BooleanType())
    def match(docs: pa.Array) -> pa.Array:
        return pa.array([d is not None and jsontext.matches(jsontext.parse(d), path, wanted) for d in docs.to_pylist()], pa.bool_())

    return match


def canonical(text: str | None) -> dict:
    """doc, fields (as pairs) and error of one text."""
    try:
        if text is None:
            raise jsontext.JsonTextError("no text")
        value = jsontext.parse(text)
        if not isinstance(value, jsontext.Members):
            raise jsontext.JsonTextError("a document is a JSON object")
        doc = jsontext.write(value)
        if len(doc) > jsontext.MAX_DOC_BYTES or len(doc.encode()) > jsontext.MAX_DOC_BYTES:
            raise jsontext.JsonTextError(f"a document has at most {jsontext.MAX_DOC_BYTES} bytes")
        return {"doc": doc, "fields": list(jsontext.flatten(value).items()), "error": None}
    except jsontext.JsonTextError as e:
        return {"doc": None, "fields": None, "error": str(e)}


@F.arrow_udf(CANONICAL)
def canonicalise(text: pa.Array) -> pa.Array:
    """Canonical document, its flattened fields, or what is wrong with the text."""
    kind = pa.struct([("doc", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
    return pa.array([canonical(t) for t in text.to_pylist()], kind)
