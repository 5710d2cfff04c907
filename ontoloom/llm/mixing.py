"""Mixing sources to target weights by nested hash thresholds.

Each record has a fixed hash. For every source, tokens are summed by hash bucket, the bucket in which the source's
budget ends is found and only that bucket is refined, until the threshold is exact. A record is then taken by
comparing its hash with the thresholds of its source: no sort, no rank, no row counted twice.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontoloom.functions.iri import stripped
from ontoloom.llm.spans import slices
from ontoloom.session import broadcast_if_small, materialize

#: Default place of the public tokenizer's ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that parts a text before byte pairs are merged, as published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the pattern knows it, and the length from which a run is encoded apart from it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = 50_000

LEVEL_BITS = 10
LEVELS = 6
HASH_BITS = LEVEL_BITS * LEVELS


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def count_tokens(text: str | None, ranks: bytes) -> int:
    """Tokens of a text; 0 for null.

    The pattern backtracks over a run of white space and fails on very long ones. Such a run is a piece of its
    own but for its last character, which belongs to what follows; so it is encoded as one piece, without the pattern.
    """
    if not text:
        return 0
    encoding, n, at = _encoding(ranks), 0, 0
    if len(text) > LONG_SPACE:
        for m in re.finditer(f"[{_SPACE}]{{{LONG_SPACE},}}", text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            n += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : stop]))
            at = stop
    return n + len(encoding.encode_ordinary(text[at:] if at else text))


def token_counts(docs: DataFrame, text: str, name: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` (few columns, ``text`` the last) with the tokens of ``text`` as ``name`` in its place; 0 for null."""
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = pa.array([count_tokens(t, ranks.value) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], name])

    kept = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema) + f", `{name}` long"
    return docs.select(*kept, text).mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    """A source in one spelling: trimmed, lower case, ``_`` for ``-`` and inner white space; blank is null."""
    s = F.regexp_replace(F.lower(stripped(c)), r"[\s-]+", "_")
    return F.when(s != "", s)


def budgets(sources: DataFrame, total: float | None) -> DataFrame:
    """``sources`` (``source, share, repeats, tokens``) that can give anything, with the tokens ``wanted`` of each.

    Without ``total`` it is the greatest size at which every source that has tokens reaches its share within its
    repeats; the shares of targets without any tokens are spread over the others in proportion. With ``total``
    each source gives its share of it or, if that is more than its repeats allow, all that they allow.
    """
    live = sources.filter("tokens > 0 AND share > 0 AND repeats > 0")
    # exact sums: a share must not depend on the order in which rows are added
    whole = live.agg(F.sum(F.col("share").cast("decimal(38, 18)")).cast("double").alias("whole"))
    part = F.col("share") / F.col("whole")
    most = F.col("repeats") * F.col("tokens")
    live = live.crossJoin(F.broadcast(whole))  # one row
    size = F.broadcast(live.agg(F.min(most / part).alias("size"))) if total is None else None
    live = live.crossJoin(size) if size is not None else live.withColumn("size", F.lit(float(total)))
    return live.select("source", "share", "repeats", "tokens", F.least(most, F.floor(part * F.col("size") * (1 + 1e-12) + 1e-6)).alias("wanted"))  # whole tokens, whatever the last digit of the product


class Mixture:
    """A mixture of ``docs``: ``rows()`` has one row per record with its copies, ``shares()`` the shares reached.

    Every table of sources stays a table, so any number of targets is allowed; a plan has one row per source.

    Cases: sources are compared in the spelling of ``source_name``; a null or unlisted source is not in the
    mixture; a null text has no tokens; records with equal id and text have one hash and are taken together; a
    target that occurs twice is one target with the summed share and the lesser repeats; null shares and repeats
    count as 0; empty tables give no rows, or shares of 0. Other columns are not read.
    """

    def __init__(
        self, docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, seed: int = 17, tokenizer: str = TOKENIZER
    ) -> None:
        t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats")).filter("source is not null")
        self.targets = materialize(t.select("source", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("repeats", F.lit(0)).cast("long").alias("repeats")), "targets")
        h = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)), 64 - HASH_BITS)
        part = docs.select(F.col(doc_id).cast("long").alias("doc_id"), source_name(F.col(source)).alias("source"), h.alias("h"), F.col(text).alias("text"))
        part = part.join(broadcast_if_small(self.targets.select("source"), 64), "source", "left_semi").select("doc_id", "source", "h", "text")
        self.sizes = materialize(token_counts(part, "text", "tokens", tokenizer), "sizes")
        self.plan = self._plan(total)

    @staticmethod
    def _bucket(level: int) -> Column:
        return F.shiftright("h", HASH_BITS - LEVEL_BITS * (level + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))

    def _plan(self, total: float | None) -> DataFrame:
        """For each source that gives anything: whole copies of every record, and the threshold of one more copy.

        A level sums tokens by source and bucket, finds the bucket in which the source's budget ends by a running
        sum over at most ``2 ** LEVEL_BITS`` rows, and only the records of that bucket go to the next level.
        """
        last = (1 << LEVEL_BITS) - 1
        rows, plan = self.sizes, None
        for level in range(LEVELS):
            sums = rows.groupBy("source", self._bucket(level).alias("b")).agg(F.sum("tokens").alias("n"))
            if plan is None:
                sums = materialize(sums, "histogram")
                have = self.targets.join(sums.groupBy("source").agg(F.sum("n").alias("tokens")), "source")
                whole = F.least(F.expr("wanted div tokens"), F.col("repeats"))
                plan = budgets(have, total).withColumn("whole", whole)
                plan = plan.select("source", "whole", F.lit(0).cast("long").alias("threshold"), (F.col("wanted") - F.col("whole") * F.col("tokens")).alias("left"), (F.col("whole") < F.col("repeats")).alias("open"))
                plan = materialize(plan, "plan")
            reached = sums.withColumn("up_to", F.sum("n").over(W.partitionBy("source").orderBy("b")))
            ends = plan.filter("open").select("source", "left").join(reached, "source", "left")
            ends = ends.groupBy("source", "left").agg(
                F.coalesce(F.min(F.when(F.col("up_to") > F.col("left"), F.col("b"))), F.lit(last)).cast("long").alias("end"),
                F.coalesce(F.max(F.when((F.col("up_to") <= F.col("left")) & (F.col("b") < last), F.col("up_to"))), F.lit(0)).alias("used"),
            )
            plan = materialize(
                plan.join(ends.drop("left"), "source", "left").select(
                    "source", "whole", F.when(F.col("open"), F.shiftleft("threshold", LEVEL_BITS).bitwiseOR(F.col("end"))).otherwise(F.lit(0)).cast("long").alias("threshold"),
                    (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), "open",
                ), "plan",
            )
            if level < LEVELS - 1:
                at = broadcast_if_small(plan.filter("open").select("source", "threshold"), 64)
                rows = rows.join(at, (rows["source"] == at["source"]) & (F.shiftright(rows["h"], HASH_BITS - LEVEL_BITS * (level + 1)) == at["threshold"])).select(rows["source"], "h", "tokens")
                rows = materialize(rows, "boundary")
                if not rows.limit(1).count():  # nothing is left to refine: all further levels end in their last bucket
                    rest = LEVEL_BITS * (LEVELS - 1 - level)
                    ended = F.shiftleft("threshold", rest).bitwiseOR(F.lit((1 << rest) - 1))
                    plan = materialize(plan.withColumn("threshold", F.when(F.col("open"), ended).otherwise(F.col("threshold"))), "plan")
                    break
        return plan.select("source", "whole", "threshold")

    def rows(self) -> DataFrame:
        """``doc_id, source, tokens, copies`` of the records that are in the mixture."""
        copies = F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
        return self.sizes.join(broadcast_if_small(self.plan, 80), "source").withColumn("copies", copies.cast("int")).filter("copies > 0").select("doc_id", "source", "tokens", "copies")

    def shares(self) -> DataFrame:
        """Per target: target share, tokens at hand, tokens taken, share reached, greatest copies."""
        have = self.sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
        took = self.rows().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
        out = self.targets.join(have, "source", "left").join(took, "source", "left").select(
            "source", F.col("share").alias("target_share"), F.col("repeats").cast("int").alias("max_repeats"), F.coalesce("available", F.lit(0)).alias("available"),
            F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
        total = out.agg(F.greatest(F.sum("taken"), F.lit(1)).alias("total"))
        return out.crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", "available", "taken", (F.col("taken") / F.col("total")).alias("share"), "most_copies")  # one row
