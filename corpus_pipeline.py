"""A training corpus from ``documents``: toxic texts out, near duplicates out, personal data masked, sources mixed, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``.
"""

from geoquarry.llm import mixing, packing, pii, similar, toxicity
from geoquarry.llm.common import table
from geoquarry.session import scratch_path


def drop_toxic(spark, docs, sf_dir):
    """Documents that the compression-distance score rejects go; the model learns from the labels of what is given."""
    return toxicity.without_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group stays that links of a five-word Jaccard similarity of 0.8 or more connect, each verified."""
    return similar.representatives(docs)


def mask_personal_data(spark, docs, sf_dir):
    """Every document stays; what is found in it is replaced by its kind in brackets."""
    return pii.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """A row for each time the mix uses a document; a source's cut shortens one document."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """Every piece of every document and its place in a sequence; nulls and empty texts are an end mark, an empty table gives no rows."""
    # Python workers that ran the stages before have less room for remembered chunks
    return packing.pack(docs, remembered=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn models and tokenize, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; between stages the rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
