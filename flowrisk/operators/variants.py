"""P12 with the event as a VARIANT: documents of records of any shape in one table.

A struct column gives a table one record type. A variant keeps each document's own
fields with their types, so flows of another sensor's record, or of a later version of
it, are appended without a change of the table. Fields are read by path; Spark reads
only the paths that a query names out of the stored variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    quote = next((q for q in "'\"" if q not in name), None)
    if quote is None:
        raise ValueError(f"a path can't hold a name with both quotes: {name}")
    return quote + name + quote


def path_of(*names: str | int) -> str:
    """Path of a field: names with no more than one kind of quotes, and places in arrays."""
    return "$" + "".join(f"[{n if isinstance(n, int) else _quoted(n)}]" for n in names)


def variant_docs(docs: DataFrame, event: str = "event") -> DataFrame:
    """Prediction documents with their nested event as a variant; null events stay null."""
    return docs.withColumn(event, F.when(F.col(event).isNotNull(), F.to_variant_object(event)))


def event_field(names: str | list[str | int], kind: str, event: Column | str = "event") -> Column:
    """Field of a variant event as ``kind``; null if the document has none, or one of another kind."""
    names = [names] if isinstance(names, str) else names
    return F.try_variant_get(F.col(event) if isinstance(event, str) else event, path_of(*names), kind)


def event_shapes(docs: DataFrame, by: list[str], event: str = "event") -> DataFrame:
    """Record type of the events of each group: the types of all its documents merged."""
    return docs.groupBy(*by).agg(F.schema_of_variant_agg(event).alias("shape"), F.count(F.lit(1)).alias("documents"))
