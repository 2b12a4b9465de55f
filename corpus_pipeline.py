"""The corpus pipeline: stages over documents, each written as Parquet and read again.

toxicity drops the documents that the classifier rejects; line dedup keeps one line of every
component of near-equal lines; SimHash near-dedup keeps one document of each group; mixing repeats
or leaves out documents so that sources come near their target weights; packing fills windows.
"""

from pyspark.sql import functions as F

from tillwise.llm import fuzzylines, mixing, packing, simhash, toxicity
from tillwise.llm.shared import STAGED, discard, stage_table
from tillwise.llm.tokens import vocabulary


def toxic_documents(spark, docs, sf_dir):
    """The documents that the toxicity classifier, trained on this input, does not reject.

    Null and empty texts are scored as empty; repeated rows are judged each for itself; other columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def line_dedup(spark, docs, sf_dir):
    """The documents without the later lines of every component; n_chars follows the text."""
    out = fuzzylines.dedup(docs)
    n = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[n if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark, docs, sf_dir):
    """One document of each SimHash group: the row of the smallest id.

    Rows that share that id count as copies if they are one group, and one of them stays.
    """
    rows = stage_table(docs.withColumn("_row", F.monotonically_increasing_id()))
    return simhash.representatives(rows, "_row").drop("_row")


def source_mix(spark, docs, sf_dir):
    """Documents repeated, or left out, by the mix: each as often as its words are taken, rounded to whole copies."""
    return mixing.repeated(docs)


def packed(spark, docs, sf_dir):
    """The pieces of all documents, ids included, with their sequences.

    Copies that the mix made share a doc_id and are told apart by row_id. A null text gives the end id alone.
    """
    return packing.pack(docs, vocabulary())


_behind: list[str] = []  # what the stage before staged


def _tidy(stage):
    """The stage, which first deletes the tables that the stage before it staged for itself.

    A stage is handed the written result of the one before, so nothing reads those any more.
    """

    def run(spark, docs, sf_dir):
        discard(spark, list(_behind))
        made = len(STAGED)
        out = stage(spark, docs, sf_dir)
        _behind[:] = STAGED[made:]
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


STAGES = [
    ("toxicity", _tidy(toxic_documents)),
    ("line_dedup", _tidy(line_dedup)),
    ("near_dedup", _tidy(near_dedup)),
    ("source_mix", _tidy(source_mix)),
    ("packing", _tidy(packed)),
]
# Trained scores, signatures and encodings have no SQL form; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir))
    return docs
