"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A label's ids are first ranked in so many parts, so that no task ranks all ids of a frequent label.
PARTS = 64


def labelled(docs: DataFrame, labels: DataFrame, per_label: int, most: int, max_chars: int) -> list[tuple[str, object]]:
    """(text, label) of at most per_label ids of each label and `most` in all, chosen by a hash of the id.

    docs: doc_id, text. labels: doc_id, label. Only ids take part that have a text of at most max_chars characters,
    so that long texts cost a label none of its sample. Ids are chosen first, in narrow rows; then their texts, one for
    an id that repeats (the smallest), and equal texts count once, with the label of the smallest id. So at most
    most * max_chars characters come to the driver. An id with several labels has the smallest. Null ids, labels and
    texts are left out.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(PARTS))
    fitting = docs.where(F.length("text") <= max_chars)
    chosen = (
        labels.where("doc_id is not null and label is not null")
        .join(fitting.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .withColumn("n", F.row_number().over(Window.partitionBy("label", part).orderBy(*order)))
        .where(F.col("n") <= per_label)
        .withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(*order)))  # of PARTS * per_label at most
        .where(F.col("n") <= per_label)
        .orderBy("n", *order)
        .limit(most)
    )
    rows = (
        fitting.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")  # at most `most` rows
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .collect()
    )
    return sorted({r["text"]: r["label"] for r in sorted(rows, key=lambda r: -r["doc_id"])}.items())
