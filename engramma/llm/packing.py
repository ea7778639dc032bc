"""Problem 6: documents are packed into containers of a fixed capacity, by vector best-fit.

A container has three capacities: tokens, documents (one for each :data:`TOKENS_A_DOCUMENT` of its tokens) and attention cost
(the sum of squared lengths, :data:`ATTENTION_SHARE` of what one document of its whole size would cost). Items go largest
first into the container, of those that can take them under every constraint, whose residual vector is left with the least
weighted norm; if none can, a new one is opened. An item that alone is beyond the attention capacity stays alone. Packing
runs in blocks of a fixed number of items that hashing spreads evenly, so that no source or length can make a block large,
and its cost grows with the input. Containers that a block leaves underfilled are dissolved, and their items packed again in
a second round of blocks.

A text is divided only if it is larger than the capacity: into full containers, which nothing else fits in, and a rest.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.session import stored

#: Items of a block.
BLOCK = 16_384
#: Containers below this fill are dissolved for the second round.
GOOD_FILL = 0.98
#: A container has room for one document for each so many tokens of its capacity, and for eight at least.
TOKENS_A_DOCUMENT = 32
#: Most attention cost of a container as a share of the squared capacity.
ATTENTION_SHARE = 0.9
#: Weights of the residual tokens, documents and attention cost in the norm.
WEIGHTS = (1.0, 0.02, 0.05)
#: So many packs are made at a time.
SPECS = 100

# Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a ``.tiktoken`` file of ranks; special strings count as ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    return os.path.join(os.environ.get("ENGRAMMA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tokens), distinct; null and empty texts have 0 tokens, rows with a null id are left out."""
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["doc_id", "tokens"])

    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(count, "doc_id long, tokens int").distinct()


def max_documents_of(capacity: int) -> int:
    return max(8, capacity // TOKENS_A_DOCUMENT)


def best_fit(sizes: np.ndarray, capacity: int, max_documents: int | None = None, attention_share: float = ATTENTION_SHARE, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The container of each item, numbered from 0. No size may be above the capacity."""
    order = np.argsort(-sizes, kind="stable")
    max_documents = max_documents or max_documents_of(capacity)
    cost_cap = max(1.0, attention_share * float(capacity) ** 2)
    out = np.full(sizes.size, -1, np.int64)
    tokens = np.empty(256, np.float64)  # residual capacities of the open containers
    slots = np.empty(256, np.float64)
    cost = np.empty(256, np.float64)
    number = np.empty(256, np.int64)
    n_open = made = 0
    wt, wd, wc = (w * w for w in weights)
    smallest = float(sizes.min()) if sizes.size else 0.0
    for i in order:
        t = float(sizes[i])
        c = t * t
        k = -1
        if n_open:
            rt, rd, rc = tokens[:n_open] - t, slots[:n_open] - 1, cost[:n_open] - c
            fits = (rt >= 0) & (rd >= 0) & (rc >= 0)
            if fits.any():
                norm = wt * (rt / capacity) ** 2 + wd * (rd / max_documents) ** 2 + wc * (rc / cost_cap) ** 2
                k = int(np.argmin(np.where(fits, norm, np.inf)))
        if k < 0:
            if n_open == tokens.size:
                tokens, slots, cost, number = (np.concatenate([a, np.empty_like(a)]) for a in (tokens, slots, cost, number))
            k = n_open
            tokens[k], slots[k], cost[k], number[k] = capacity, max_documents, cost_cap, made
            n_open += 1
            made += 1
        tokens[k] -= t
        slots[k] -= 1
        cost[k] -= c
        out[i] = number[k]
        if tokens[k] < smallest or slots[k] < 1 or cost[k] < smallest * smallest:  # closed: the last open one takes its place
            n_open -= 1
            for a in (tokens, slots, cost, number):
                a[k] = a[n_open]
    return out


_PACKED = "pack_id int, capacity int, doc_id long, part int, tokens int, container string, filled int"


def _round(pieces: DataFrame, name: str, block: int) -> DataFrame:
    """Pack pieces (pack_id, capacity, doc_id, part, tokens) in blocks of about ``block`` items."""
    count = pieces.groupBy("pack_id").agg(F.count("*").alias("items"))  # one row a pack
    hashed = F.pmod(F.xxhash64("doc_id", "part"), F.greatest(F.lit(1), F.ceil(F.col("items") / block))).cast("long")
    spread = pieces.join(F.broadcast(count), "pack_id").withColumn("block", hashed)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
        capacity = int(rows["capacity"].iloc[0])
        bins = best_fit(rows["tokens"].to_numpy(), capacity)
        rows["container"] = [f"{key[0]}-{name}{key[1]}-{b}" for b in bins]
        rows["filled"] = np.bincount(bins, weights=rows["tokens"]).astype("int32")[bins]
        return rows[["pack_id", "capacity", "doc_id", "part", "tokens", "container", "filled"]]

    return spread.select("pack_id", "block", "capacity", "doc_id", "part", "tokens").groupBy("pack_id", "block").applyInPandas(pack, _PACKED)


def packed(documents: DataFrame, specs: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """Containers with their documents: (pack_id, container, doc_id, part, start_token, tokens, filled, capacity).

    Every document is in every pack of ``specs`` (pack_id, capacity_tokens), whole in one container if it fits in one.
    Specs with a null or no positive capacity are left out; empty tables give an empty result.
    """
    spark = documents.sparkSession
    final = "pack_id int, container string, doc_id long, part int, start_token int, tokens int, filled int, capacity int"
    rows = specs.select("pack_id", "capacity_tokens").where("pack_id is not null and capacity_tokens > 0").distinct().orderBy("pack_id", "capacity_tokens").toLocalIterator()
    first = list(islice(rows, SPECS))
    if not first:
        return spark.createDataFrame([], final)
    counts = stored(token_counts(documents, tokenizer), "tokens")
    out = _packs(counts, first, block)
    while more := list(islice(rows, SPECS)):
        out = out.unionByName(_packs(counts, more, block))
    return out


def _packs(counts: DataFrame, rows: list, block: int) -> DataFrame:
    packs = F.array(*[F.struct(F.lit(r["pack_id"]).cast("int").alias("pack_id"), F.lit(r["capacity_tokens"]).cast("int").alias("capacity")) for r in sorted(rows)])
    each = counts.select("doc_id", F.col("tokens").alias("all_tokens"), F.explode(packs).alias("p")).select("doc_id", "all_tokens", "p.*")
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("all_tokens") / F.col("capacity")).cast("int") - 1))
    pieces = each.select("pack_id", "capacity", "doc_id", F.explode(parts).alias("part"), "all_tokens").withColumn("tokens", F.least("capacity", F.col("all_tokens") - F.col("part") * F.col("capacity"))).drop("all_tokens")
    full = pieces.where("tokens = capacity").select(*pieces.columns, F.concat_ws("-", "pack_id", F.lit("full"), "doc_id", "part").alias("container"), F.col("capacity").alias("filled"))
    first = stored(_round(pieces.where("tokens < capacity"), "a", block), "packed")
    good = F.col("filled") >= GOOD_FILL * F.col("capacity")
    second = _round(first.where(~good).select(*pieces.columns), "b", block)
    return full.unionByName(first.where(good)).unionByName(second).select("pack_id", "container", "doc_id", "part", (F.col("part") * F.col("capacity")).alias("start_token"), "tokens", "filled", "capacity")
