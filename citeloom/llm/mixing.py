"""Problem 9: a mixture of sources at target shares, by a low-discrepancy schedule over blocks of equal size."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.text import SPACE
from citeloom.operators.prefix import running_sum
from citeloom.runtime import materialize, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLOCK_TOKENS = 4_096
LEAST_BITS = 8  # a source's order is cut into 2 ** LEAST_BITS slices at least
SLICE_TOKENS = 1 << 24  # and into so many that one holds about as many tokens of the mixture at most, however large it is


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens, the tokens of the whole text in the given byte-level vocabulary; the text isn't kept. Null has 0."""
    others = [c for c in docs.columns if c != text]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text] + ["n_tokens bigint"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary)
        for f in frames:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in f[text]]
            yield f[others].assign(n_tokens=sizes)

    return docs.mapInPandas(run, fields)


def source_key(c: Column | str) -> Column:
    """A source name without regard to case, outer white space and the difference of blank, '-' and '_'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")), f"(?:{SPACE}|[-_])", "_")


def source_sizes(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: source_name, key, target_share, max_repeats, size, total: the size of all listed sources."""
    t = targets.select("source_name", source_key("source_name").alias("key"), "target_share", "max_repeats")
    sizes = docs.groupBy("key").agg(F.sum("n_tokens").alias("size"))
    j = t.join(sizes, "key", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return j.withColumn("total", F.sum("size").over(Window.partitionBy(F.lit(0))))


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(plan, report) of a mixture as large as all documents of the listed sources taken once.

    docs: doc_id, text, source. targets: source_name, target_share, max_repeats; one row per source, a handful. Extra columns of
    either aren't read. Documents of other or null sources, and empty or null texts, are left out. Repeated documents are
    documents of their own. An empty table on either side gives an empty plan.

    Each source's documents are put in a random order (a hash), once for every allowed use, laid end to end and cut into blocks of
    exactly `block_tokens` tokens, within documents where a border falls there; the mixture is a sequence of slots, of which slot i
    belongs to the source in whose part of [0, 1) the van der Corput point of i falls, the parts being the shares. The k-th slot of
    a source takes its k-th block, as long as its documents last: any stretch of the sequence holds the sources in their shares,
    and every slot but a source's last is full. A source is reachable if its slots could be filled, up to one block: this is read
    off the placed pieces, and must agree with the arithmetic of size, max_repeats and share, which stands beside it.

    plan: slot, source_name, doc_id, use_no, from_token, n_tokens: the tokens of the document that the slot takes. report:
    source_name, target_share, max_repeats, size, wanted, used, actual_share, uses (mean times a document is used), reachable,
    supply_suffices (size * max_repeats reaches wanted).
    """
    spark = docs.sparkSession
    names = targets.select(source_key("source_name").alias("key"))
    kept = docs.where("text IS NOT NULL AND text != ''").select("doc_id", "text", source_key("source").alias("key")).join(F.broadcast(names), "key", "left_semi")
    sized = materialize(token_counts(kept, vocabulary=vocabulary), "tokens")
    sources = sorted(source_sizes(sized, targets).collect(), key=lambda r: r["key"])  # one row per listed source
    total = sources[0]["total"] if sources else 0
    share = sum(r["target_share"] for r in sources) or 1.0
    slots = -(-total // block_tokens)
    rows, at = [], 0.0
    for r in sources:
        wanted = r["target_share"] / share * total
        rows.append((r["key"], r["source_name"], float(r["target_share"]), int(r["max_repeats"]), int(r["size"]), wanted, at, at + r["target_share"] / share, r["size"] * r["max_repeats"] >= wanted and r["size"] > 0))
        at += r["target_share"] / share
    parts = spark.createDataFrame(rows, "key string, source_name string, target_share double, max_repeats int, size bigint, wanted double, lo double, hi double, supply_suffices boolean")
    small = F.broadcast(parts)

    # the schedule: bits of the slot number mirrored about the point, so equal stretches of slots hit equal shares
    n = F.col("slot")
    mirrored = sum((F.shiftright(n, k).bitwiseAND(1) * (2.0 ** -(k + 1)) for k in range(max(1, int(slots).bit_length()))), F.lit(0.0))
    plan = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", mirrored)
    plan = plan.join(small.select("key", "lo", "hi"), (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("slot", "key")
    bits = max(LEAST_BITS, (total // SLICE_TOKENS).bit_length())
    slices = 1 << bits
    width = max(1, -(-slots // slices))
    ranked = running_sum(plan, ["key"], [F.col("slot")], F.lit(1), (F.col("slot") / width).cast("int"), "block", slices)

    # the blocks: every use of a document has a place of its own in the source's order, one use of all before the next
    uses = sized.where("n_tokens > 0").join(small.select("key", "max_repeats", "wanted", "size"), "key")
    needed_uses = F.least(F.col("max_repeats"), F.ceil(F.col("wanted") / F.col("size") + 1e-9).cast("int") + 1)
    uses = uses.withColumn("use_no", F.explode(F.sequence(F.lit(1), needed_uses))).where("use_no <= max_repeats")
    uses = uses.withColumn("place", F.pmod(F.xxhash64("doc_id", "use_no", F.lit(seed)), F.lit(2**40)))
    slice_ = (F.col("use_no") * F.lit(slices) + F.shiftright("place", 40 - bits)).cast("int")
    cut = running_sum(uses, ["key"], [F.col("place"), F.col("doc_id")], F.col("n_tokens"), slice_, "before", slices)
    first, last = F.floor(F.col("before") / block_tokens), F.floor((F.col("before") + F.col("n_tokens") - 1) / block_tokens)
    pieces = cut.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block_tokens, F.col("before"))
    end = F.least((F.col("block") + 1) * block_tokens, F.col("before") + F.col("n_tokens"))
    pieces = pieces.select("key", "block", "doc_id", "use_no", (begin - F.col("before")).alias("from_token"), (end - begin).alias("n_tokens"))
    placed = ranked.join(pieces, ["key", "block"]).join(small.select("key", "source_name"), "key")
    placed = materialize(placed.select("slot", "source_name", "doc_id", "use_no", "from_token", "n_tokens"), "mixture")
    used = placed.groupBy("source_name").agg(F.sum("n_tokens").alias("used"))
    report = parts.join(used, "source_name", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    everything = Window.partitionBy(F.lit(0))  # one row per listed source
    reachable = (F.col("size") > 0) & (F.col("used") + block_tokens > F.col("wanted"))
    report = report.select("source_name", "target_share", "max_repeats", "size", "wanted", "used", (F.col("used") / F.greatest(F.sum("used").over(everything), F.lit(1))).alias("actual_share"),
                           (F.col("used") / F.greatest("size", F.lit(1))).alias("uses"), reachable.alias("reachable"), "supply_suffices")
    return placed, report


def _mix(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, root, "documents"), table(spark, root, "source_targets"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Sources whose slots of the placed mixture couldn't be filled."""
    return _mix(spark, root)[1].where("NOT reachable").select("source_name")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root)[1]


def p9_plan(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root)[0]


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares, "p9_plan": p9_plan}
_KEY = r"regexp_replace(lower(regexp_replace({c}, '^[\s\p{{Z}}\x0B\x{{85}}\x1C-\x1F]+|[\s\p{{Z}}\x0B\x{{85}}\x1C-\x1F]+$', '', 'g')), '[\s\p{{Z}}\x0B\x{{85}}\x1C-\x1F]|[-_]', '_', 'g')"
#: DuckDB has no tokenizer: sizes are counted in characters, as the cases' margins allow any.
SQL: dict[str, str] = {
    "p9_found": f"WITH s AS (SELECT {_KEY.format(c='source')} AS k, sum(length(text)) AS n FROM documents WHERE text <> '' GROUP BY 1), t AS (SELECT *, {_KEY.format(c='source_name')} AS k FROM source_targets), j AS (SELECT t.*, coalesce(s.n, 0) AS n FROM t LEFT JOIN s USING (k)) SELECT source_name FROM j WHERE n * max_repeats < target_share * (SELECT sum(n) FROM j)",
}
