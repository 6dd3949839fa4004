"""JSON documents that don't parse: rejects with their text instead of rows that vanish.

``from_json`` gives NULL for a document it can't read, and exploding NULL gives nothing.
Here a document is parsed once as VARIANT (``try_parse_json``); it is accepted when it parses
and holds what its reader needs, else it is a reject with the reason and the whole text. Both
sides are projections and filters of one table: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a reader needs of a document: a path, and the kind of value there.
NEEDS = {"comments": ("$.items", "ARRAY"), "submission": ("$", "OBJECT"), "keyed": ("$", "OBJECT"), "page": ("$.props.pageProps.reviews", "ARRAY")}
MALFORMED, NOT_THERE, MISSING = "malformed", "no {}", "no document"


def reject_reason(doc: Column, kind: str) -> Column:
    """Why a document can't be read as ``kind``; NULL when it can.

    NULL and blank documents are missing; a document of another shape (wrong root, no
    list where the rows should be) is named by the path that it lacks.
    """
    path, wanted = NEEDS[kind]
    parsed = F.try_parse_json(doc)
    there = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    return (F.when(doc.isNull() | (F.trim(doc) == ""), MISSING).when(parsed.isNull(), MALFORMED)
            .when(~F.coalesce(there.startswith(wanted), F.lit(False)), NOT_THERE.format(path)))


def split_documents(docs: DataFrame, col: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(documents that can be read, rejects): the rejects have ``reason`` and ``document`` beside the other columns."""
    tagged = docs.withColumn("_reason", reject_reason(F.col(col), kind))
    rejects = tagged.filter(F.col("_reason").isNotNull())
    others = [c for c in docs.columns if c not in (col, "reason", "document")]
    return (tagged.filter(F.col("_reason").isNull()).drop("_reason"),
            rejects.select(*others, F.col("_reason").alias("reason"), F.col(col).alias("document")))
