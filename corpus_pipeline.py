"""From documents to token ids in five stages: toxicity, line dedup, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Rows that share a doc_id are one document; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.llm import bpe, cube, jaccard, linededup, toxicity
from helixloom.llm.common import stored, table, unused
from helixloom.llm.tokenizer_files import tokenizer_spec

#: Near duplicates: five words a shingle, similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.5; without usable labels all of them."""
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand earlier; one of which nothing is left goes, as all of it is kept
    elsewhere. Null and empty texts stay."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    done = linededup.dedup_lines(docs.select(*kept)).where("n_dropped = 0 or n_lines > n_dropped")
    return done.select(*kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document, that of the smallest doc_id (null last), once; texts without words are no duplicates. Rows are known by doc_id and text, so
    a row goes or stays by its own group, whatever other rows have its doc_id or none. A row without words that is repeated exactly stays once, without a doc_id as often as it stands."""
    groups = jaccard.jaccard_groups(docs.select("doc_id", "text"), SHINGLE, NUM, DEN)
    own, mark, alone, no = unused(docs.columns, "own_id", "mark", "alone", "no")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("head")
    heads = groups.where("root is not null").groupBy("root").agg(head).select("head.doc_id", "head.th", F.lit(False).alias(alone))
    others = groups.where("root is null").select("doc_id", "th", F.lit(True).alias(alone)).distinct()
    keys = heads.unionByName(others).select(F.col("doc_id").alias(own), F.col("th").alias(mark), alone)
    kept = docs.join(keys, docs["doc_id"].eqNullSafe(keys[own]) & (F.xxhash64(docs["text"]) == keys[mark]))
    again = Window.partitionBy("doc_id", mark).orderBy(F.lit(1))
    kept = kept.select("*", F.row_number().over(again).alias(no))
    return kept.where((F.col(no) == 1) | (F.col(alone) & F.col("doc_id").isNull())).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go. Rows that share a doc_id get the same number."""
    own, often, time = unused(docs.columns, "own_id", "often", "time")
    copies = cube.mix_sources(docs).groupBy(F.col("doc_id").alias(own)).agg(F.min("copies").alias(often))
    both = docs.join(copies, docs["doc_id"].eqNullSafe(copies[own])).where(F.col(often) > 0)
    times = F.explode(F.sequence(F.lit(1), F.col(often))).alias(time)
    return both.select(*docs.columns, times).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row."""
    done = bpe.encode_documents(docs.select("doc_id", "text"), tokenizer_spec())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix),
    ("BPE", encode),
]

#: Compression distances, the cube method and BPE have no SQL; tests/llm holds run() against a plain recomputation of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
