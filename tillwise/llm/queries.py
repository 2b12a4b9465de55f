"""Registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.llm import (
    alignment, caps, centroids, declist, fuzzylines, idstore, licenses, mixing, packing, rulefit, secrets, simhash, toxicity,
)
from tillwise.llm.tokens import vocabulary

QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_source_mix(spark, sf_dir):
    """Words that a low-discrepancy schedule over target weights takes from each document."""
    _, _, taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_pack_windows(spark, sf_dir):
    """Documents packed into windows of 2,048 tokens by non-negative least squares."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary()))


@query
def op10_token_files(spark, sf_dir):
    """Token files with Elias-Fano boundaries, written and read back."""
    return idstore.read(idstore.write(table(spark, sf_dir, "documents"), vocabulary()))


@query
def op5_embedding_caps(spark, sf_dir):
    """Links, components and kept flags of all embeddings at cosine 0.95."""
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_simhash_golay(spark, sf_dir):
    """Fingerprints of whole texts and their groups within four bits."""
    return simhash.groups(table(spark, sf_dir, "documents"))


@query
def op1_toxicity_nnpu(spark, sf_dir):
    """Toxicity scores of all documents from a positive-unlabelled classifier."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_decision_list(spark, sf_dir):
    """Base counts of all documents and the verdict of a learned decision list."""
    docs = table(spark, sf_dir, "documents")
    return declist.judge(docs, declist.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_rule_ensemble(spark, sf_dir):
    """Quality scores of all documents from a sparse rule ensemble."""
    docs = table(spark, sf_dir, "documents")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return rulefit.score(docs, rulefit.fit(docs, table(spark, sf_dir, "labels"), where=learn))


@query
def op3_secret_ledger(spark, sf_dir):
    """Secrets of all documents by way of a ledger of scanned blobs."""
    return secrets.report(secrets.findings(table(spark, sf_dir, "documents")))


@query
def op4_fuzzy_lines(spark, sf_dir):
    """All documents with one line kept of every component of near-equal lines."""
    return fuzzylines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query
def op11_token_alignment(spark, sf_dir):
    """Alignment of two tokenizers over all documents, identical ids by vectors and other links by pair counts."""
    return alignment.alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op12_centroid_clusters(spark, sf_dir):
    """Ten rounds of centroid clustering over all embeddings in whole numbers."""
    return centroids.summed_up(*centroids.cluster(table(spark, sf_dir, "embeddings")))


@query
def op13_license_rules(spark, sf_dir):
    """Licenses in all documents by ordered signature rules."""
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))
