"""Mixing sources to target weights, with exact block quotas dealt to shards by a splitting tree.

1. Every document's size is counted in tokens of a public tokenizer and kept as a narrow table, so that texts are
   read once. A hash puts each document into a block of its source, and into one of ``SUBS`` parts of the block.
   A source has about one block for ``BLOCK_TOKENS`` tokens, at least ``LEAST_BLOCKS`` and at most ``MOST_BLOCKS``.
2. The total is a share of the tokens of all sources with a target (``fraction``), or the total asked for. Each
   source's quota is its target share of it; a source that runs out at its allowed repeats gives all that it has,
   and what it lacks is spread over the others in proportion. ``feasible_total`` is the greatest total without such
   a lack. A quota is so many whole passes over the source's blocks, a further prefix of its permuted blocks, and
   a part of one block for the rest.
3. The draws of all sources are split among the output shards by a tree: each node draws the left half's
   share of each source from a multivariate hypergeometric distribution, so the sums stay exact and every shard
   gets a fair mixture. A leaf takes that many draws off each source's permuted list: disjoint blocks.
4. The rows are dealt out: each shard lies whole in one partition, in the order of a random key within the shard.

The driver holds one number a source and the tree's (shards x sources) counts, for at most ``MAX_SOURCES`` sources.
Blocks, permutations and draws are made in tasks, one source (at most ``MOST_BLOCKS`` rows) at a time.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import materialize

SUBS = 4096
BLOCK_TOKENS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 20, 64, 4096
#: Sources with a target: their sizes are held on the driver. More are refused.
MAX_SOURCES = 100_000
#: Draw tables of up to so many rows are broadcast, larger ones joined by exchange.
MAX_BROADCAST = 1_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_counters: dict = {}


def token_counter(path: str):
    """A function from a text to its number of tokens. The kind follows the file's ending: .tiktoken, .json or .model."""
    if path not in _counters:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _counters[path] = lambda text: len(encode(text))
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _counters[path] = lambda text: len(t.encode(text, add_special_tokens=False).ids)
        elif path.endswith(".model"):
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda text: len(s.encode(text))
        else:
            raise ValueError(f"no tokenizer is known for {path}")
    return _counters[path]


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of each document; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        for batch in batches:
            sizes = [count(x) if x else 0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, tokens bigint")


def _live(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    """source → (share, tokens at the most repeats) of the sources that can give anything."""
    return {s: (w, m * available.get(s, 0)) for s, (w, m) in targets.items() if w > 0 and m > 0 and available.get(s, 0) > 0}


def feasible_total(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """The greatest total at which all sources with documents meet their shares exactly, the shares of the others being spread in proportion."""
    live = _live(available, targets)
    whole = sum(w for w, _ in live.values())
    return min((c * whole / w for w, c in live.values()), default=0.0)


def quotas(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens to take from each source for a sample of ``total`` tokens. ``targets``: source → (share, most repeats).

    A source that would have to be used more than its repeats allow gives all that it has; the rest is shared by
    the others in proportion to their targets. No choice of repeats comes nearer to the shares at this total.
    """
    live = _live(available, targets)
    out: dict[str, float] = {}
    left = float(min(total, sum(c for _, c in live.values())))
    while live:
        whole = sum(w for w, _ in live.values())
        full = {s: c for s, (w, c) in live.items() if left * w / whole >= c}
        if not full:
            return out | {s: left * w / whole for s, (w, _) in live.items()}
        out |= full
        left -= sum(full.values())
        live = {s: x for s, x in live.items() if s not in full}
    return out


def split_tree(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many of each source's draws a shard gets. Rows differ by at most one in their sums, columns sum to ``draws``."""
    if shards == 1:
        return draws.reshape(1, -1)
    left = shards // 2
    n = int(draws.sum())
    m = n * left // shards
    taken = rng.multivariate_hypergeometric(draws, m, method="marginals")
    return np.vstack([split_tree(taken, left, rng), split_tree(draws - taken, shards - left, rng)])


def blocks_of(tokens: int) -> int:
    """How many blocks a source of so many tokens has: a power of two."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (int(tokens) // BLOCK_TOKENS).bit_length()))


def draw_plan(source: str, blocks: np.ndarray, sums: np.ndarray, quota: float, seed: int) -> tuple[int, np.ndarray, tuple[int, float] | None]:
    """(whole passes, blocks of the prefix after them, (block drawn in part, tokens wanted of it) or None)."""
    total = int(sums.sum())
    if total <= 0 or quota <= 0:
        return 0, blocks[:0], None
    passes = int(quota // total)
    rest = quota - passes * total
    order = np.random.default_rng([seed, zlib.crc32(source.encode())]).permutation(np.argsort(blocks, kind="stable"))
    run = np.cumsum(sums[order])
    n = int(np.searchsorted(run, rest, side="right"))
    if n == len(order):
        return passes, blocks[order], None
    return passes, blocks[order[:n]], (int(blocks[order[n]]), float(rest - (run[n - 1] if n else 0)))


def _nearest_prefix(tokens: np.ndarray, wanted: float) -> int:
    """How many of the leading parts come nearest to the tokens wanted."""
    run = np.r_[0, np.cumsum(tokens)]
    return int(np.abs(run - wanted).argmin())


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: int | None = None, shards: int = 64, seed: int = 1, fraction: float = 0.25) -> DataFrame:
    """A sample whose token shares by source meet the targets: doc_id, source, tokens, copy, shard, shuffle_key.

    The sample holds ``total_tokens``, or ``fraction`` of the tokens of all sources with a target. One row per copy
    of a document, at most max_repeats copies. Each shard is whole in one partition and in random order there. The
    rows are the same for equal inputs and seeds, whatever the partitioning.

    Nulls: documents with a null source or a source without target are left out, as are sources with a null, zero
    or negative share or max_repeats; of repeated targets the first in order counts. Empty texts have no tokens and come
    with their block. Repeated documents count as often as they occur. Empty tables give no rows; further columns are ignored.
    """
    spark = documents.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null").distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    wanted: dict[str, tuple[float, int]] = {}
    for r in sorted(rows, key=repr):
        wanted.setdefault(r["source"], (float(r["target_share"] or 0), int(r["max_repeats"] or 0)))
    names = F.broadcast(spark.createDataFrame([(s,) for s in sorted(wanted)], "source string"))
    sizes = materialize(token_sizes(documents.join(names, "source", "left_semi"), tokenizer), "tokens")

    available = {r["source"]: int(r["n"]) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a subset of the targets
    total = fraction * sum(available.get(s, 0) for s, (w, m) in wanted.items() if w > 0 and m > 0) if total_tokens is None else total_tokens
    quota = quotas(available, wanted, total)
    plan = spark.createDataFrame([(s, blocks_of(available[s]), float(q)) for s, q in sorted(quota.items())], "source string, blocks int, quota double")
    slot = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "doc_id"), n).cast("int")
    placed = sizes.join(F.broadcast(plan.select("source", "blocks")), "source").withColumn("block", slot("block", F.col("blocks"))).withColumn("sub", slot("sub", F.lit(SUBS)))

    # one source's blocks at a time: at most MOST_BLOCKS rows
    sums = materialize(placed.groupBy("source", "block").agg(F.sum("tokens").alias("n")), "blocks").join(F.broadcast(plan), "source")

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["source"].iloc[0]
        passes, prefix, part = draw_plan(s, pdf["block"].to_numpy(), pdf["n"].to_numpy(), float(pdf["quota"].iloc[0]), seed)
        block, wanted_ = part or (-1, 0.0)
        return pd.DataFrame({"source": [s], "draws": [passes * len(pdf) + len(prefix)], "part": [block], "part_tokens": [wanted_]})

    parts = sums.groupBy("source").applyInPandas(partial, "source string, draws bigint, part int, part_tokens double").collect()
    part_of = {r["source"]: r for r in parts}
    limits = _part_limits(placed, part_of)
    count = {s: part_of[s]["draws"] + (1 if limits.get(s, 0) else 0) for s in sorted(part_of)}
    dealt = split_tree(np.array(list(count.values()), np.int64), shards, np.random.default_rng(seed)) if count else np.zeros((shards, 0), int)
    column = {s: k for k, s in enumerate(count)}

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["source"].iloc[0]
        blocks = np.sort(pdf["block"].to_numpy())
        passes, prefix, part = draw_plan(s, pdf["block"].to_numpy(), pdf["n"].to_numpy(), float(pdf["quota"].iloc[0]), seed)
        block = np.r_[np.tile(blocks, passes), prefix]
        copy = np.r_[np.repeat(np.arange(passes), len(blocks)), np.full(len(prefix), passes)]
        limit = np.full(len(block), SUBS)
        if limits.get(s, 0):
            block, copy, limit = np.r_[block, part[0]], np.r_[copy, passes], np.r_[limit, limits[s]]
        order = np.random.default_rng([seed, 1, zlib.crc32(s.encode())]).permutation(len(block))
        out = pd.DataFrame({"source": s, "block": block[order], "copy": copy[order], "shard": np.repeat(np.arange(shards), dealt[:, column[s]]), "limit": limit[order]})
        return out.astype({c: "int32" for c in ("block", "copy", "shard", "limit")})

    table = sums.groupBy("source").applyInPandas(deal, "source string, block int, copy int, shard int, limit int")
    out = placed.join(F.broadcast(table) if sum(count.values()) <= MAX_BROADCAST else table, ["source", "block"]).where("sub < limit")
    key = F.xxhash64(F.lit(seed), F.lit("order"), "shard", "copy", "doc_id")
    out = out.select("doc_id", "source", "tokens", "copy", "shard", key.alias("shuffle_key"))
    return out.repartition("shard").sortWithinPartitions("shard", "shuffle_key")


def _part_limits(placed: DataFrame, parts: dict) -> dict[str, int]:
    """How far into the parts of the block that is drawn in part each source goes: as near to the rest of its quota as the parts allow."""
    drawn = [(s, r["part"], r["part_tokens"]) for s, r in parts.items() if r["part"] >= 0]
    if not drawn:
        return {}
    table = placed.sparkSession.createDataFrame(drawn, "source string, block int, wanted double")
    by = placed.join(F.broadcast(table), ["source", "block"]).groupBy("source", "wanted", "sub").agg(F.sum("tokens").alias("n"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sub")
        n = _nearest_prefix(pdf["n"].to_numpy(), float(pdf["wanted"].iloc[0]))
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "limit": [int(pdf["sub"].iloc[n - 1]) + 1 if n else 0]})

    return {r["source"]: r["limit"] for r in by.groupBy("source").applyInPandas(nearest, "source string, limit int").collect()}


def reached_shares(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """What a sample reaches: source, target_share, max_repeats, documents, copies, tokens, actual_share (of the sample's tokens), for every target source."""
    by = sample.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("copies"), F.sum("tokens").alias("tokens"), (F.max("copy") + 1).alias("most_repeats"))
    whole = by.agg(F.sum("tokens").alias("whole"))
    goal = targets.select("source", "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return goal.join(by, "source", "left").join(whole).select(
        "source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("most_repeats"), zero("tokens"),
        F.when(F.col("whole") > 0, F.coalesce(F.col("tokens"), F.lit(0)) / F.col("whole")).otherwise(F.lit(0.0)).alias("actual_share"),
    )
