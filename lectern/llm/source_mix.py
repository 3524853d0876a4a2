"""Problem 7: documents of several sources in target shares of the tokens.

Efraimidis-Spirakis sampling: each document of a source gets an exponential key
with its quality as rate, and the documents with the least keys come first. A
source whose budget exceeds its tokens is used whole as many times as it fits,
then the rest of the budget is filled in the order of the keys. Order and
prefix sums need no sort of a whole source: keys fall into buckets by their
logarithm, and only the bucket in which a budget ends is sorted.

A mix may be impossible: a source with too few tokens, even repeated, can't
reach its share of the size asked for. Then either the size is kept, and what
such sources lack goes to the others in proportion to their shares, or the
shares are kept, and the mix becomes as large as they allow.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut_lineage

#: Buckets of keys in each doubling of the key. The logarithm of an exponential key has a density of at most 1 / e,
#: whatever its rate, so no bucket is expected to hold more than ln 2 / (e STEPS), 0.025 %, of a source's documents.
STEPS = 1024
#: Rows of targets up to which they are sent to every task (some 100 bytes each); more are joined by shuffle.
BROADCAST_TARGETS = 100_000
#: Seed of the keys: the same seed gives the same mix.
SEED = 20_240_601


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary that tokens are counted with, unless another is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, quality) of each document with an id and a text; empty texts have 0 tokens.

    ``tokenizer`` is the path of a tiktoken rank file on the driver, which is
    sent to the workers and opened there by its name. quality, in (0, 1], is the
    share of letters and digits in the text, less for very short ones.
    """
    import public_tokenizers

    path, pattern = tokenizer or default_tokenizer(), public_tokenizers.PATTERN
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), batch.column("quality")], ["doc_id", "source", "tokens", "quality"])

    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""))
    quality = F.greatest(F.lit(0.05), letters / F.greatest(F.length("text"), F.lit(1)) * (1 - F.exp(-F.length("text") / 200.0)))
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "source", "text", quality.alias("quality"))
    return rows.mapInArrow(count, "doc_id bigint, source string, tokens bigint, quality double")


def _targets(spark_targets: DataFrame) -> DataFrame:
    """One row for each mix and source; of repeated ones the greatest share, repeats and size; null keys and shares have none."""
    return (
        spark_targets.where("mix_id is not null and source is not null and target_share is not null")
        .groupBy("mix_id", "source")
        .agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"), F.max(F.coalesce("size_factor", F.lit(1.0))).alias("size_factor"))
    )


def _key(seed: int) -> Column:
    """Logarithm of an exponential key with rate quality, from a hash of document and mix."""
    uniform = (F.xxhash64("doc_id", "mix_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return F.log(-F.log(uniform)) - F.log("quality")


def bucket_of(key: Column) -> Column:
    return F.floor(key / F.log(F.lit(2.0)) * STEPS).cast("int")


def feasible(targets: DataFrame, total: int, keep: str = "size") -> DataFrame:
    """(…, planned, feasible_share, use): what each source of a mix gives, from target_share, max_repeats, size_factor and have (its tokens).

    ``planned`` is its share of the size asked for. With L as one factor for the
    mix it gives L target_share tokens, but no more than have max_repeats:
    keep="size" takes the L at which the mix has the size asked for (or all that
    there is), keep="shares" the greatest L up to that size at which no source
    with documents is short. feasible_share is its share of what the mix then has.
    """
    cap = (F.col("have") * F.col("max_repeats")).cast("double")
    rows = targets.withColumns({"_cap": cap, "_size": F.col("size_factor") * total}).where("target_share > 0")
    w = Window.partitionBy("mix_id")
    if keep == "shares":
        there = F.when(F.col("have") > 0, F.col("target_share"))
        rows = rows.withColumn("_factor", F.least(F.min(F.when(F.col("have") > 0, F.col("_cap") / F.col("target_share"))).over(w), F.max("_size").over(w) / F.sum(there).over(w)))
    else:
        order = w.orderBy(F.col("_cap") / F.col("target_share"), "source")
        before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("target_share").over(order.rowsBetween(0, Window.unboundedFollowing))
        # the factor if all sources before are short and no other; the first that makes its own source not short holds
        rows = rows.withColumn("_l", (F.max("_size").over(w) - before) / rest)
        rows = rows.withColumn("_factor", F.min(F.when(F.col("_l") <= F.col("_cap") / F.col("target_share"), F.struct((F.col("_cap") / F.col("target_share")).alias("r"), F.col("source").alias("s"), F.col("_l").alias("l")))).over(w).l)
    use = F.least(F.col("_cap"), F.coalesce("_factor", F.lit(float("inf"))) * F.col("target_share"))
    given = rows.withColumn("use", F.floor(F.coalesce(use, F.lit(0.0)) + 0.5).cast("bigint")).withColumn("planned", F.floor(F.col("target_share") * F.col("_size")).cast("bigint"))
    whole = F.sum("use").over(w)
    return given.withColumn("feasible_share", F.when(whole > 0, F.col("use") / whole).otherwise(0.0)).drop("_cap", "_size", "_factor", "_l")


class Mix:
    """The plan of all mixes of a table of targets; ``keep`` says what is kept of a mix that is impossible, see ``feasible``."""

    def __init__(self, docs: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = SEED, keep: str = "size"):
        # read by four plans: written once, a few bytes for each document
        self.counts = cut_lineage(token_counts(docs, tokenizer).dropDuplicates(["doc_id"]))
        targets = _targets(targets)
        small = targets.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
        self._hint = F.broadcast if small else (lambda frame: frame)
        total = int(self.counts.agg(F.sum("tokens")).first()[0] or 0)
        have = self.counts.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("have"))
        known = targets.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
        epochs = F.when(F.col("have") > 0, F.floor(F.col("use") / F.col("have"))).otherwise(0).cast("bigint")
        self.budgets = feasible(known, total, keep).withColumn("epochs", epochs).withColumn("rest", F.col("use") - F.col("epochs") * F.col("have"))
        self.seed = seed

    def copies(self) -> DataFrame:
        """(mix_id, doc_id, source, tokens, copies): how often each document is used, where it is."""
        listed = self.counts.where("source is not null").join(self._hint(self.budgets.select("mix_id", "source", "epochs", "rest")), "source")
        keyed = listed.withColumn("key", _key(self.seed)).withColumn("bucket", bucket_of(F.col("key")))
        # prefix sums over the buckets of each mix and source: STEPS for each doubling of the key, of which 64 bits of hash allow few
        by_bucket = keyed.where("rest > 0").groupBy("mix_id", "source", "rest", "bucket").agg(F.sum("tokens").alias("in_bucket"))
        so_far = F.sum("in_bucket").over(Window.partitionBy("mix_id", "source").orderBy("bucket"))
        last = by_bucket.withColumn("so_far", so_far).where("so_far > rest").groupBy("mix_id", "source").agg(F.min_by(F.struct("bucket", (F.col("so_far") - F.col("in_bucket")).alias("before")), "bucket").alias("l"))
        ends = last.select("mix_id", "source", F.col("l.bucket").alias("last_bucket"), F.col("l.before").alias("before"))
        placed = keyed.join(self._hint(ends), ["mix_id", "source"], "left")
        whole = placed.where("rest <= 0 or last_bucket is null or bucket <> last_bucket")
        extra = F.when((F.col("rest") > 0) & (F.col("last_bucket").isNull() | (F.col("bucket") < F.col("last_bucket"))), 1).otherwise(0)
        # the bucket in which the budget ends: documents in the order of their keys, the last one if that comes closer
        upto = F.sum("tokens").over(Window.partitionBy("mix_id", "source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        partial = placed.where("rest > 0 and bucket = last_bucket").withColumn("fits", F.when(F.col("before") + upto - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
        columns = ["mix_id", "doc_id", "source", "tokens"]
        used = whole.select(*columns, (F.col("epochs") + extra).alias("copies")).unionByName(partial.select(*columns, (F.col("epochs") + F.col("fits")).alias("copies")))
        return used.where("copies > 0")

    def shares(self) -> DataFrame:
        """(mix_id, source, target_share, feasible_share, actual_share, tokens, documents_used, most_copies, short): a row for each target.

        short: whether the source has too few tokens for its share of the size
        asked for, even repeated as often as allowed. A target of 0 has no row.
        """
        used = self.copies().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.count(F.lit(1)).alias("documents_used"), F.max("copies").alias("most_copies"))
        zero = F.lit(0).cast("bigint")
        rows = self.budgets.join(used, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("used", zero))
        total = F.sum("tokens").over(Window.partitionBy("mix_id"))  # a row for each source of a mix
        return rows.select(
            "mix_id", "source", "target_share", "feasible_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"), "tokens",
            F.coalesce("documents_used", zero).alias("documents_used"), F.coalesce("most_copies", zero).alias("most_copies"), (F.col("have") * F.col("max_repeats") < F.col("planned")).alias("short"),
        )
