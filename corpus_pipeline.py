"""The corpus pipeline: documents through quality rules to packed sequences.

    quality_rules    documents that break the rules go
    near_duplicates  one document of each group of near duplicates stays
    repeats          passages of 20 words or more that also stand earlier go from the texts
    source_mixing    documents are taken by the target weights of their sources, once an epoch
    packing          token pieces in sequences of 1024

Every stage takes all rows its predecessor kept and, but for the last, returns the columns of
documents. Near duplicates are judged by their texts alone, whatever the ids: rows of one id
with different texts both stay, rows without an id are compared like others, and of equal rows
one stays. A text that loses words is its kept words joined by one space.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm import jaccard, mixing, packing, quality_rules, repeats
from wayline.llm.queries import MIX
from wayline.llm.tables import fresh, table
from wayline.session import materialize

#: Token pieces in each of a worker's two cache generations.
PIECES = 100_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and their host's verdict."""
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similar texts connect, the row of the smallest id (and code).

    Rows without words link with nothing and stay. Texts are shuffled once, by the row's code, to
    meet what was decided; a plan that broadcasts the decisions while they are few would need
    another at scale.
    """
    found = materialize(jaccard.join(docs, coded=True).where("component is not null").select("component", "doc_id", "row_code"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_code")
    stays = found.groupBy(F.col("component").alias("group")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("stays")).where("n > 1")
    # written, so that the join has a shuffle of its own and a large group's rows can be split
    stays = materialize(stays.select("group", F.col("stays.row_code").alias("stays")), "stays")
    rows = found.join(stays, found["component"] == stays["group"])
    # rows that are equal in id and text have one code: one of them stays if theirs does
    rows = rows.groupBy(F.col("row_code").alias("judged")).agg(F.max(F.col("row_code") == F.col("stays")).alias("stays"), F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.where("NOT stays OR n > 1").select("judged", F.col("stays").alias("judged_stays")), "judged")

    code, again = fresh(docs, "row_code"), fresh(docs, "again")
    stays = fresh(docs, "judged_stays")
    coded = docs.withColumn(code, jaccard.row_code(docs["doc_id"].cast("long"), docs["text"]))
    rows = rows.select(F.col("judged").alias(judged := fresh(docs, "judged")), F.col("judged_stays").alias(stays))
    met = coded.join(rows.hint("merge"), coded[code] == rows[judged], "left")
    kinds = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    plain = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, kinds)]
    first = F.row_number().over(Window.partitionBy(code).orderBy(*plain))
    one = met.where(F.col(stays)).withColumn(again, first).where(F.col(again) == 1)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return met.where(F.col(stays).isNull()).select(*own).unionByName(one.select(*own))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier; other texts as they are."""
    added = {name: fresh(docs, name) for name in ("n_removed", "kept_text")}
    cut = repeats.remove_repeats(docs)
    lost = F.col(added["n_removed"]) > 0
    text = F.when(lost, F.col(added["kept_text"])).otherwise(cut["text"])
    new = {"text": text, "n_chars": F.when(lost, F.char_length(F.col(added["kept_text"])).cast("long")).otherwise(cut["n_chars"]) if "n_chars" in docs.columns else None}
    return cut.select(*[new[c].alias(c) if c in new else cut[f"`{c}`"] for c in docs.columns])


def take_by_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights, once for each epoch they are taken in."""
    return mixing.mix_documents(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences.

    An executor that ran the other stages has grown to what it may use: fewer pieces are cached.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=PIECES)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_by_rules),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("source_mixing", take_by_weights),
    ("packing", pack),
]

#: Token ids have no SQL: each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
