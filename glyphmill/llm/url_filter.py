"""URL filter: blocked Bloom filter in front of an exact join with listed (host, path prefix) rules.

Each URL is cut into host and path, and expanded to the (host suffix, path prefix) keys that a listed
rule could have.  A split-block Bloom filter over the listed keys, sent to every task, drops the keys
that no rule has; the survivors meet the rules in an exact join, which removes its false positives.

Defined results: a null URL or one without ``://`` has empty host and path; hosts are compared after
A-Z are lower-cased; of several fitting rules the longest (host and path together) wins, then the
longer host; a key listed as both allow and block blocks; no fitting rule gives ``rule`` null and the
default verdict.  Repeated rows are judged alike and all returned; other columns pass through.  An
empty rule list or table gives the default verdict or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, free_name, table

#: Bits of the filter for each listed key, and most blocks of 32 bytes (32 MB).  A list of more than 16 million keys has
#: fewer bits a key: more keys pass the filter, and the exact join drops them.
KEY_BITS, MAX_BLOCKS = 16, 1 << 20
#: Blocks that one group builds.
CHUNK_BLOCKS = 1 << 12
#: Longest list (in rules) that is broadcast in the exact join; longer ones are shuffled.
MAX_BROADCAST_RULES = 20_000
#: Odd multipliers, one for each 32-bit lane of a 256-bit block (the published split-block filter).
LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


class BlockedBloom:
    """Split-block Bloom filter: one 256-bit block and eight bits of it for each key."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @classmethod
    def of(cls, hashes: np.ndarray, bits_per_key: int = 16) -> BlockedBloom:
        blocks = np.zeros((max(1, -(-len(hashes) * bits_per_key // 256)), 8), dtype=np.uint32)
        where, masks = cls._place(hashes, len(blocks))
        for lane in range(8):
            np.bitwise_or.at(blocks[:, lane], where, masks[:, lane])
        return cls(blocks)

    @classmethod
    def built(cls, hashes: DataFrame, n: int, most: int = MAX_BLOCKS) -> BlockedBloom:
        """The filter of ``n`` hashes (h: long), built chunk by chunk in tasks; only its bits, 32 MB at most, reach the driver."""
        blocks = max(1, min(most, -(-n * KEY_BITS // 256)))
        where = F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(blocks), 32)

        def fill(t: pa.Table) -> pa.Table:
            chunk = t["chunk"][0].as_py()
            at, masks = cls._place(t["h"].to_numpy(), blocks)
            own = np.zeros((CHUNK_BLOCKS, 8), dtype=np.uint32)
            for lane in range(8):
                np.bitwise_or.at(own[:, lane], at - chunk * CHUNK_BLOCKS, masks[:, lane])
            return pa.table({"chunk": [chunk], "bits": [own.tobytes()]}, schema=pa.schema([("chunk", pa.int64()), ("bits", pa.binary())]))

        out = np.zeros((-(-blocks // CHUNK_BLOCKS) * CHUNK_BLOCKS, 8), dtype=np.uint32)
        for r in hashes.select("h", F.floor(where / CHUNK_BLOCKS).alias("chunk")).groupBy("chunk").applyInArrow(fill, "chunk long, bits binary").collect():
            out[r["chunk"] * CHUNK_BLOCKS : (r["chunk"] + 1) * CHUNK_BLOCKS] = np.frombuffer(r["bits"], dtype=np.uint32).reshape(-1, 8)
        return cls(out[:blocks])

    @staticmethod
    def _place(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        h = np.asarray(hashes).astype(np.int64).view(np.uint64)
        where = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        low = h & np.uint64(0xFFFFFFFF)
        bit = ((low[:, None] * LANES[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        return where.astype(np.int64), (np.uint32(1) << bit.astype(np.uint32)).astype(np.uint32)

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        where, masks = self._place(hashes, len(self.blocks))
        return ((self.blocks[where] & masks) == masks).all(axis=1)


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` (they replace columns of those names)."""
    spark = df.sparkSession
    # one row a key; block wins over allow as the larger string
    listed = rules.select(ascii_lower(F.col("host")).alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv")).dropna().groupBy("rh", "rp").agg(F.max("rv").alias("rv"))
    shape = listed.agg(F.count("*"), F.collect_set(F.size(F.split("rh", r"\."))), F.collect_set(F.length("rp"))).first()
    n, labels, lengths = shape[0], sorted(shape[1]), sorted(shape[2])
    hc, pc = free_name(df, "host"), free_name(df, "path")
    cut = df.withColumns({hc: url_host(F.col(url)), pc: url_path(F.col(url))})
    sites = cut.select(F.col(hc).alias("h"), F.col(pc).alias("p")).distinct()
    if n:
        suffixes = F.array_distinct(F.array(*[F.substring_index("h", ".", -k) for k in labels]))
        prefixes = F.array_distinct(F.filter(F.array(*[F.when(F.length("p") >= k, F.substring("p", 1, k)) for k in lengths]), lambda x: x.isNotNull()))
        keys = sites.withColumn("rh", F.explode(suffixes)).withColumn("rp", F.explode(prefixes))
        sent = spark.sparkContext.broadcast(BlockedBloom.built(listed.select(F.xxhash64("rh", "rp").alias("h")), n).blocks)

        @F.pandas_udf(T.BooleanType())
        def possible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bloom = BlockedBloom(sent.value)
            for h in batches:
                yield pd.Series(bloom.might_hold(h.to_numpy(dtype=np.int64)))

        keys = keys.where(possible(F.xxhash64("rh", "rp")))
        exact = F.broadcast(listed) if n <= MAX_BROADCAST_RULES else listed
        best = F.max(F.struct((F.length("rh") + F.length("rp")).alias("l"), F.length("rh").alias("lh"), F.concat("rh", "rp").alias("rule"), F.col("rv").alias("verdict"))).alias("b")
        judged = keys.join(exact, ["rh", "rp"]).groupBy("h", "p").agg(best).select("h", "p", F.col("b.rule").alias("r"), F.col("b.verdict").alias("v"))
    else:
        judged = sites.select("h", "p", F.lit(None).cast("string").alias("r"), F.lit(None).cast("string").alias("v"))
    others = [cut[c] for c in df.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    out = cut.join(judged, (cut[hc] == judged["h"]) & (cut[pc] == judged["p"]), "left")
    return out.select(*others, cut[hc].alias("host"), cut[pc].alias("path"), judged["r"].alias("rule"), F.coalesce(judged["v"], F.lit(default)).alias("verdict"))


def op2_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id,
  coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fits AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM cut) s, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, c.host, c.path, rule, coalesce(verdict, 'allow') AS verdict FROM cut c LEFT JOIN fits f ON c.host = f.host AND c.path = f.path
"""

QUERIES = {"op2_url_filter": op2_url_filter}
SQL = {"op2_url_filter": OP2_SQL}
