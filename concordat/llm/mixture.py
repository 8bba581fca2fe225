"""Mixing sources to target weights by systematic sampling.

Every record of a source is expected to be used `rate` times, the source's target in tokens over its tokens. The records of a source are laid in a row, by
size, and the prefix sums of their expected uses, shifted by one random offset, cross integers; each crossing is one use. So a record is
used floor(rate) or ceil(rate) times, the number of uses is exact to one, and the mix of sizes is that of the source.

The row is a range-partitioned sort with partition totals carried over, so a source of any size is spread over many tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from concordat.functions.lineage import cut

#: Where the public tokenizers lie, and the one that counts.
TOKENIZERS, TOKENIZER = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer cuts a text before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose length in tokens a worker remembers; they are counted anew beyond that.
REMEMBERED = 300_000


@lru_cache(maxsize=1)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(path: str):
    """A function from text to its number of tokens: merging never crosses the pattern's pieces, so pieces are counted once and remembered."""
    encode, pieces, known = _encoding(path).encode_ordinary, regex.compile(PATTERN).findall, {}

    def count(text: str) -> int:
        total = 0
        for piece in pieces(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[piece] = len(encode(piece))
            total += n
        return total

    return count


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch in batches:
        sizes = pa.array([None if t is None else count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*batch.schema.names[:-1], "n_tokens"])


def token_counts(df: DataFrame, text: str, keep: list[str], tokenizer: str = f"{TOKENIZERS}/{TOKENIZER}") -> DataFrame:
    """The columns `keep` with n_tokens of `text`; null for null texts, 0 for empty ones."""
    slim = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in slim.dtypes[:-1])
    return slim.mapInArrow(lambda b: _count(b, tokenizer), f"{kinds}, n_tokens bigint")


def _offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), source), F.lit(2**40)) / F.lit(float(2**40))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source of `targets`: records and tokens it has and the tokens of its largest record, by which a reachable target may be missed at most as records are drawn in order of size; tokens wanted, the rate of use and whether the target can be reached.

    total is the chosen number of tokens; without it, as many as the records of all listed sources hold. A source without records has rate 0.
    """
    held = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("largest"))
    t = targets.select("source", "target_share", "max_repeats").join(held, "source", "left").na.fill(0, ["n_records", "n_tokens", "largest"])
    whole = F.lit(total).cast("double") if total is not None else F.sum("n_tokens").over(Window.partitionBy(F.lit(1))).cast("double")  # one row per source
    t = t.withColumn("total_tokens", whole).withColumn("wanted_tokens", F.col("target_share") * F.col("total_tokens"))
    need = F.when(F.col("n_tokens") > 0, F.col("wanted_tokens") / F.col("n_tokens")).otherwise(F.lit(0.0))
    return t.withColumn("rate", F.least(need, F.col("max_repeats").cast("double"))).withColumn("reachable", (F.col("n_tokens") > 0) & (need <= F.col("max_repeats")) | (F.col("wanted_tokens") == 0))


def draw(df: DataFrame, key: str, text: str, source: str, targets: DataFrame, total: int | None = None, seed: int = 42, tokenizer: str = f"{TOKENIZERS}/{TOKENIZER}") -> tuple[DataFrame, DataFrame]:
    """(drawn, report). drawn: (key, source, n_tokens, copy_no), one row per use, copy_no from 1.

    report: per source of the targets, what plan() says and the uses, tokens and share reached; `reachable` is false where even max_repeats uses of every record
    fall short, or the source has no records. Records with null, empty or blank text, a null source or one without a target are never drawn. Rows repeated whole count once, two texts under one key
    are two records; equal sizes are ordered by key. targets: (source, target_share, max_repeats), a driver-sized table. An empty collection draws nothing.
    """
    t = F.col(f"`{text}`")
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), t.alias("t"), F.xxhash64(t).alias("content")).filter(F.col("source").isNotNull() & F.col("t").rlike(r"\S"))
    listed = targets.select("source").distinct()
    sizes = token_counts(slim.join(listed, "source", "left_semi"), "t", ["key", "source", "content"], tokenizer).distinct()
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    row = sizes.repartitionByRange(parts, "source", "n_tokens", "key").sortWithinPartitions("source", "n_tokens", "key", "content")
    row = cut(row.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    rates = plan(row.select("source", "n_tokens"), targets, total)
    ends = row.groupBy("part", "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # at most partitions + sources rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("part", "source", "first", before.alias("before"))
    placed = row.join(F.broadcast(ends), ["part", "source"]).join(F.broadcast(rates.select("source", "rate")), "source")
    rank = F.col("at") - F.col("first") + F.col("before")
    crossed = lambda n: F.floor(n * F.col("rate") + _offset(F.col("source"), seed))
    uses = placed.withColumn("uses", (crossed(rank + 1) - crossed(rank)).cast("int")).filter("uses > 0")
    drawn = uses.select(F.col("key").alias(key), "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"))
    got = uses.groupBy("source").agg(F.sum("uses").alias("n_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("drawn_tokens"))
    report = rates.join(got, "source", "left").na.fill(0, ["n_uses", "drawn_tokens"])
    report = report.withColumn("reached_share", F.col("drawn_tokens") / F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1))))
    report = report.withColumn("share_of_total", F.when(F.col("total_tokens") > 0, F.col("drawn_tokens") / F.col("total_tokens")))
    return drawn, report
