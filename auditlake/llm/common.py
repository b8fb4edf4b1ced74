"""Small things that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every ASCII byte that is no letter or digit becomes a space, A-Z become a-z; bytes of other characters stay.
WORD_BYTES = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256)
)
#: ids given to rows without one lie above this; they come from the text's hash
SURROGATE = 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8; bytes.split() splits at exactly 0x20 and 0x09 to 0x0D."""
    return text.encode().split() if text else []


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """doc_id, or for rows without one a number made from the text (rows with equal texts then count as one document)."""
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 2).bitwiseOR(F.lit(SURROGATE))
    return F.coalesce(F.col(doc_id).cast("long"), made)


def real_id(col: Column) -> Column:
    return F.when(col < SURROGATE, col)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model may learn from. A row without an id belongs to no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-auditlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/auditlake/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts and merges both sides, whatever Spark takes their sizes for.

    Spark sizes a table by its files and columns: one that an explode unfolds, or whose files compress well, is taken for
    far smaller than it is, and a side that is taken for small is collected by the driver to be broadcast.
    """
    return df.hint("merge")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most `rows` labelled documents outside the held-out fold, one row an id: (doc_id, label, text).

    The rows are those whose ids have the smallest hashes, so that the choice follows neither order nor source; texts
    of more than max_chars characters are not learned from. Both bounds are parameters of the models that use this.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= max_chars)
    # `picked` has at most `rows` rows of two numbers
    return texts.join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).orderBy("_id")
