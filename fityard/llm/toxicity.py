"""Toxicity scores from a counterfactually regularised classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fityard.llm import text_classifier

# Words that name groups of people, neutral words among them. In a counterfactual text every word of a
# group is replaced by the next one of its group (the last by the first).
IDENTITY_GROUPS = [
    ["people", "women", "men"],
    ["person", "woman", "man", "girl", "boy"],
    ["persons", "girls", "boys"],
    ["believers", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "atheists"],
    ["religious", "muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "atheist"],
    ["human", "gay", "lesbian", "bisexual", "straight", "queer", "transgender"],
    ["local", "black", "white", "asian", "african", "latino", "arab", "european", "indigenous"],
    ["citizens", "immigrants", "refugees", "migrants", "foreigners"],
    ["adult", "old", "young", "elderly", "disabled", "blind", "deaf"],
]


def swap_pairs(groups: list[list[str]]) -> list[tuple[str, str]]:
    return [(a, b) for g in groups for a, b in zip(g, [*g[1:], g[0]])]


def is_held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_labelled: int = text_classifier.MAX_LABELLED) -> text_classifier.Model:
    """Fit on the labelled rows that aren't held out; about ``max_labelled`` of them, by a hash of the id.

    Null ids, null labels and labels other than 0 and 1 are left out; of several labels of one id the
    larger counts. Rows that repeat an id all count.
    """
    known = (labels.select(labels[id_col].cast("bigint").alias("id"), labels[label_col].cast("int").alias("label"))
             .filter("id is not null and label in (0, 1)").filter(~is_held_out("id"))
             .groupBy("id").agg(F.max("label").alias("label")))
    sample = text_classifier.bounded_sample(known, "id", max_labelled)
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    # The sample is bounded by max_labelled rows of two numbers.
    return text_classifier.fit(texts.join(F.broadcast(sample), "id").select("text", "label"), [0, 1],
                               swap_pairs(IDENTITY_GROUPS))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_labelled: int = text_classifier.MAX_LABELLED) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every row of ``docs``, whole texts.

    ``score`` is the probability of label 1, ``predicted`` whether it is 0.5 at least. Only the text is an
    input; null and empty texts get the score of a text without known words. Without labels the
    score is 0.5 for all; if all labels are equal, it is their smoothed share. ``held_out`` is null
    for a null id.
    """
    model = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    scored = text_classifier.with_posteriors(
        docs.select(docs[id_col].alias("row"), docs[text_col].cast("string").alias("text")), model)
    return scored.select(F.col("row").alias(id_col), is_held_out("row").alias("held_out"),
                         F.col("posteriors")[1].alias("score"),
                         (F.col("posteriors")[1] >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", max_labelled: int = text_classifier.MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below 0.5 (see ``score``)."""
    model = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    scored = text_classifier.with_posteriors(text_classifier.carried(docs, text_col), model)
    return scored.filter(F.col("posteriors")[1] < 0.5).select("row.*")
