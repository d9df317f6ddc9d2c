"""A training corpus from documents: language, near copies, secrets, mixture, sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, packing, secrets, simhash
from plumbline.llm.queries import MIX, held_out, tokenizer_path, with_topic
from plumbline.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; learned from those not held out. Null texts, texts without
    a letter and texts far beyond their language's entropy go."""
    model = langid.fit(held_out(docs).where(~F.col("held_out")).select("doc_id", "lang", "text"))
    names = ("__lang", "__score", "__accepted")
    return langid.predict(docs, model, names=names).where("__accepted").drop(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked."""
    return simhash.one_of_each(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that few owners hold are masked in the text, copied examples stay."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with half the tokens, evened out over source, language and topic."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    keyed = with_topic(docs.select(row, docs["doc_id"], docs["text"], docs["lang"], docs["source"])).drop("text")
    return mixing.mixed(keyed, MIX).where("selected").select("__row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    cut = packing.pieces(docs, tokenizer_path(), ids=False).drop("ids")
    return packing.pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("secret scans", secret_spans),
    ("mixing sources to target weights", mixture),
    ("packing", sequences),
]
#: Character models, fingerprint components and raking are beyond SQL; the tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again. The last one has written out
    what it needs of its input, so nothing stays in the folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            _remove(spark, f"{folder}/{number - 1}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    _remove(spark, folder)
    return packed


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a stage's table that the next one has replaced."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
