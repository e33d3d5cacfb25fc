"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


PAGE = struct(page_id=L, url=S, html=S)
SNAPSHOT = struct(page_id=L, url=S, html=S, snapshot_ts=T.TimestampType())

#: A text node: place in the page text, number of element siblings before it, NFKC form,
#: and the text as written where that differs.
CHUNK = struct(pos=I, after=I, txt=S, raw=S)

#: One row per element. ``pre`` is document order inside the page and ``last`` the
#: ``pre`` of the last descendant, so the first n descendants of ``a`` are the rows
#: with ``a`` among their ancestors and ``pre - a.pre <= n``.
NODE = struct(
    page_id=L, tree=I, host=I, pre=I, last=I, parent=I, depth=I, child_idx=I, n_children=I,
    nth=I, tag=S, id=S, classes=T.ArrayType(S), attrs=T.MapType(S, S),
    chunks=T.ArrayType(CHUNK), text_len=I, ancestors=T.ArrayType(I), path=S, hidden=B,
    page_url=S, base_url=S,
)

LOCATOR = struct(css=S, scope=B, anchored=B, tag=S, elem_id=S, attr=S, val=S,
                 classes=T.ArrayType(S), steps=T.ArrayType(S))

FIELD = struct(collection_id=S, field_no=I, id=S, name=S, type=S, attribute=S, pattern=S, pattern_flags=S,
               multiple=B, required=B, hidden=B, explanation=S, confidence=D,
               locators=T.ArrayType(LOCATOR))

#: One field value: exactly one of the members is set, all are null for "no value".
VALUE = struct(str=S, num=D, arr=T.ArrayType(S))

RECORD = struct(
    id=S, session_id=S, page_id=L, item=I, seq=L, values=T.MapType(S, VALUE),
    original_values=T.MapType(S, T.ArrayType(S)), source_url=S, captured_at=T.TimestampType(),
    batch_id=S, fingerprint=S, incomplete=B,
)

PLAN_FIELD = struct(name=S, type=S, sources=T.ArrayType(S), operation=S, pattern=S, multiple=B, reason=S,
                    confidence=D)
PLAN = struct(recordType=S, fields=T.ArrayType(PLAN_FIELD), droppedSources=T.ArrayType(S),
              deduplicateBy=T.ArrayType(S), summary=S)
