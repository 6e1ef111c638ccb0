"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a word budget. A document of a source with budget/size ratio
``r`` is taken ``floor(r)`` times for certain and once more with inclusion
probability ``r - floor(r)``. The cube method's flight phase moves these
probabilities through the null space of the balancing constraints (sum of
probabilities, sum of probability x size), until each is 0 or 1 but for two at
most. The flight runs in blocks of a source's documents; what is left of a block
(two documents at most) goes on to the next level, so each level is ``BLOCK / 2``
times smaller and no task holds more than a block. The landing, per source, is
over two documents at most: it takes the leading words of them that are still
missing, so a source's words meet its target but for rounding.

Defined results: null and empty texts have size 0 (they are sampled too, and take
no words); a null source is a source of its own, the last in order; repeated rows
are documents of their own; if all sizes are 0 all targets are 0; empty tables give
no rows. Blocks and random numbers come from hashes of the rows: reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.llm.common import settled

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2
#: Documents in a block of the flight phase.
BLOCK = 1024


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT) -> dict[str | None, float]:
    """Budget of each source: ``share`` of all sizes by weight (repeating in code
    point order, null last), capped at ``most`` times the source's size; the excess
    goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    target: dict[str | None, float] = {}
    left, free = share * sum(n for _, n in order), [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > cap[s]]
        if not above:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            target[s] = cap[s]
        left -= sum(cap[s] for s in above)
        free = [s for s in free if s not in target]
    return target


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight phase: ``p`` with all but ``x.shape[0]`` entries at 0 or 1 and
    ``x @ p`` unchanged. ``x`` has a row per constraint. Each step looks at one more
    entry than there are constraints, so it is a null vector of a small matrix."""
    p = p.copy()
    k = x.shape[0]
    todo = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    window, at = todo[: k + 1], k + 1
    while window:
        a = x[:, window]
        if len(window) <= k:
            # fewer entries than constraints + 1: move only if the constraints still leave a direction
            _, s, v = np.linalg.svd(a)
            if len(window) <= int((s > 1e-9 * max(1.0, s[0])).sum()):
                break
            u = v[-1]
        elif k == 2:
            u = np.cross(a[0], a[1])
            if not np.any(u):
                u = np.linalg.svd(a)[2][-1]
        else:
            u = np.linalg.svd(a)[2][-1]
        u = u / np.abs(u).max()
        now = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 1e-12, (1 - now) / u, np.where(u < -1e-12, -now / u, np.inf)).min()
            down = np.where(u > 1e-12, now / u, np.where(u < -1e-12, (now - 1) / u, np.inf)).min()
        step = up if rng.random() * (up + down) < down else -down
        now = now + step * u
        now[now < 1e-9] = 0.0
        now[now > 1 - 1e-9] = 1.0
        p[window] = now
        window = [i for i in window if 0 < p[i] < 1]
        while len(window) <= k and at < len(todo):
            window.append(todo[at])
            at += 1
    return p


def _seed(key: str) -> np.random.Generator:
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest(key.encode(), 17))


def _fly_block(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["row_id", "row_hash", "size"], kind="stable").reset_index(drop=True)
    if len(block):
        # balanced on document count and words, in units of the block's mean size
        x = np.vstack([np.ones(len(block)), block["size"].to_numpy(float) / max(1.0, block["size"].mean())])
        block["p"] = flight(block["p"].to_numpy(float), x, _seed(f"{block['source_no'].iat[0]}:{block['level'].iat[0]}:{block['block'].iat[0]}"))
    return block


def _land(group: pd.DataFrame) -> pd.DataFrame:
    """Landing of one source: the words still missing, from the documents that are still open."""
    group = group.sort_values(["row_id", "row_hash", "size"], kind="stable").reset_index(drop=True)
    want = int(round(float((group["p"] * group["size"]).sum())))
    part = []
    for size in group["size"].tolist():
        part.append(min(size, want))
        want -= part[-1]
    group["part"] = np.array(part, dtype=np.int64)
    return group


_UNIT = "doc_id long, row_id long, row_hash long, source_no int, size long, p double, level int, block long"
_KEY = ["doc_id", "row_id", "row_hash"]


def _row_keys() -> list[Column]:
    """Two independent hashes that tell rows apart (rows equal in id, source and text share them)."""
    return [F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text")).alias("row_id"), F.xxhash64(F.lit(1), F.col("text")).alias("row_hash")]


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_REPEAT, block: int = BLOCK) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source): a row per input row with doc_id,
    source, size, source_size, target, copies (whole copies taken) and taken (words
    taken, repeats counted; ``taken - copies * size`` leading words are taken on top
    of the whole copies), and the row's keys."""
    spark = docs.sparkSession
    sized = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *_row_keys(), n_words(F.col("text")).alias("size")))
    # one row per source: as many as there are sources, not documents
    per_source = sorted(((r["source"], int(r["source_size"]), int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    target = share_targets([(s, n) for s, n, _ in per_source], weights, share, most)
    plan = F.broadcast(
        spark.createDataFrame(
            [(i, s, n, float(target[s]), int(target[s] // n) if n else 0, (target[s] / n) % 1.0 if n else 0.0, -(-count // block)) for i, (s, n, count) in enumerate(per_source)],
            "source_no int, source string, source_size long, target double, whole int, p double, blocks long",
        )
    )
    units = sized.alias("d").join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.row_id", "d.row_hash", "d.size", "s.source_no", "s.p", "s.blocks")
    at = units.where("p > 1e-9").select(*_KEY, "source_no", "size", "p", F.lit(0).alias("level"), F.pmod(F.xxhash64(F.lit(0), "row_id"), F.col("blocks")).alias("block"))
    decided = units.where("p <= 1e-9").select(*_KEY, "source_no", "size", F.lit(0).alias("copy"), F.lit(0).cast("long").alias("part"))
    largest, level = max((n for _, _, n in per_source), default=0), 0
    while True:
        flown = settled(at.groupBy("source_no", "block").applyInPandas(_fly_block, _UNIT))
        decided = decided.unionByName(flown.where("p = 0 or p = 1").select(*_KEY, "source_no", "size", F.col("p").cast("int").alias("copy"), F.lit(0).cast("long").alias("part")))
        rest = flown.where("p > 0 and p < 1")
        if largest <= block:
            break
        # two of a block stay open at most: the next level's size
        largest, level = 2 * -(-largest // block), level + 1
        at = rest.select(*_KEY, "source_no", "size", "p", F.lit(level).alias("level"), F.pmod(F.xxhash64(F.lit(level), "row_id"), F.lit(-(-largest // block))).alias("block"))
    landed = rest.groupBy("source_no").applyInPandas(_land, _UNIT + ", part long").select(*_KEY, "source_no", "size", F.lit(0).alias("copy"), "part")
    copies = (F.col("whole") + F.col("copy")).alias("copies")
    return decided.unionByName(landed).join(plan.drop("p", "blocks"), "source_no").select(*_KEY, "source", "size", "source_size", "target", copies, (copies * F.col("size") + F.col("part")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with the mix's size, source_size, target, copies and taken; documents of
    which the mix takes nothing are dropped. The join is on the row keys; equal rows are
    told apart by their number among equals."""
    columns = docs.columns
    extra = ["size", "source_size", "target", "copies", "taken"]
    chosen = mix(docs, **params).groupBy("row_id", "row_hash").agg(F.sort_array(F.collect_list(F.struct("taken", "copies", "size", "source_size", "target")), asc=False).alias("mixed"))
    keyed = docs.select(F.struct(*columns).alias("doc"), *_row_keys()).join(chosen, ["row_id", "row_hash"])
    nth = F.row_number().over(Window.partitionBy("row_id", "row_hash").orderBy("row_id"))
    one = keyed.withColumn("mixed", F.col("mixed")[nth - 1]).where("mixed.taken > 0")
    return one.select(*[F.col("doc")[c].alias(c) for c in columns if c not in extra], *[F.col("mixed")[c].alias(c) for c in extra])
