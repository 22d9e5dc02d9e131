"""Near-dedup: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. Every text becomes its set of word shingles, a digest of that set and a MinHash
   signature.  Texts with equal sets are one class; only one of a class goes on.
2. Classes that share a band of the signature are candidates.  The candidates of a band are
   tied to the smallest of them, and the connected families of these ties bound what has to
   be compared: no pair is listed.
3. A family is dealt out in blocks of bounded size, each with the same few members of the
   family (hubs).  Within a block, signatures are compared batch by batch; a pair is dropped
   once the posterior probability that its similarity reaches the threshold falls below
   ``miss``.  Pairs that survive and aren't yet connected are confirmed on the full sets.  A
   block returns a spanning forest of confirmed links.
4. Hubs tie the blocks of a family together.  Members outside the family's largest component
   are then compared in the same way with all other blocks, so no link is lost that
   could change a component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import likely_in
from .common import checkpointed, packed, unpacked
from .graph import components
from .words import Words, text_words, windows

SHINGLE = 5
PERCENT = 75  # least similarity of linked texts
HASHES, BAND = 128, 4  # 32 bands of 4: similarity 0.75 escapes all bands with probability 5e-6
BATCH = 32  # signature positions between two looks at the posterior
MISS = 1e-6  # probability at which a pair is given up
BLOCK, HUBS = 400, 4

_draws = np.random.default_rng(7).integers(0, 1 << 32, (2, HASHES), dtype=np.uint32)
_FACTOR, _SHIFT = _draws[0] | np.uint32(1), _draws[1]


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingles; fewer words than a shingle are one."""
    runs = windows(words.hashes, SHINGLE)
    for start, stop in zip(words.at[:-1], words.at[1:]):
        if stop - start >= SHINGLE:
            yield np.unique(runs[start : stop - SHINGLE + 1])
        else:
            yield windows(words.hashes[start:stop], stop - start)[: stop - start]


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 4096):
        np.minimum(out, (high[at : at + 4096, None] * _FACTOR + _SHIFT).min(axis=0), out=out)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, words in text_words(batch.column("text"), lower=True):
            counts, digests, signatures = [], [], []
            for shingles in shingle_sets(words):
                counts.append(len(shingles))
                known = len(shingles) > 0
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if known else None)
                signatures.append(signature(shingles).tobytes() if known else None)
            yield pa.record_batch(
                [batch.column("id").slice(first, last - first), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                ["id", "n_shingles", "shingle_set", "signature"],
            )


def least_matches(percent: int, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """For each batch, the fewest matching positions so far with which a pair goes on.

    With a uniform prior, m matches in n positions make the similarity Beta(m + 1, n - m + 1);
    it reaches t with the probability that a binomial of n + 1 draws at t is m at most.
    """
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        reach, m = 0.0, -1
        while reach < miss:
            m += 1
            reach += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    both = int(np.count_nonzero(large[place] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], signatures: np.ndarray, root: np.ndarray, probes: np.ndarray, percent: int, miss: float) -> list[tuple[int, int]]:
    """Confirmed links that join members in different components: a forest.

    ``root`` has the component of each member and is updated; ``probes`` are the members that
    are compared, each with all members.  Most similar signatures come first.
    """
    least, out = least_matches(percent, miss), []
    sizes = np.array([len(s) for s in sets])
    for i in probes:
        others = np.flatnonzero((root != root[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        matches = np.zeros(len(others), int)
        for k, needed in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + np.count_nonzero(signatures[others, part] == signatures[i, part], axis=1)
            others, matches = others[matches >= needed], matches[matches >= needed]
        for j in others[np.argsort(-matches, kind="stable")]:
            if root[i] != root[j] and similar(sets[i], sets[j], percent):
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _block(percent: int, miss: float, known: bool):
    """Links within a block; with ``known`` components only from its probes."""

    def run(block: pa.Table) -> pa.Table:
        sets = [s for _, _, words in text_words(block.column("text"), lower=True) for s in shingle_sets(words)]
        signatures = np.frombuffer(b"".join(block.column("signature").to_pylist()), np.uint32).reshape(len(sets), HASHES)
        if known:
            _, root = np.unique(block.column("component").to_numpy(), return_inverse=True)
            probes = np.flatnonzero(block.column("probe").to_numpy(zero_copy_only=False))
        else:
            root, probes = np.arange(len(sets)), np.arange(len(sets))
        found = links(sets, signatures, root.copy(), probes, percent, miss)
        ids = block.column("rep")
        ends = [ids.take(pa.array([pair[k] for pair in found], pa.int64())) for k in (0, 1)]
        return pa.table(ends, names=["a", "b"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """All rows of ``docs`` with the group of near copies that each belongs to.

    Words are runs outside U+0020 and U+0009 to U+000D, A-Z lower-cased; a text's set is its
    distinct runs of five words, or its whole sequence when shorter.  Texts are linked when
    their sets' Jaccard similarity reaches ``percent``; groups are the components.  Adds
    ``n_shingles``, ``component_id`` (smallest id of the group) and ``kept``, which take the
    place of columns so named.  Null and wordless texts have no shingle and are linked with
    nothing.  A row with a null id is linked with nothing, has a null ``component_id`` and
    stays.  Rows that repeat an id count as one document in links.  An empty table gives an
    empty table.
    """
    added = ["n_shingles", "component_id", "kept"]
    found = component_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), percent, miss, block)
    rows = docs.select(packed(docs, added).alias("row"), F.col(id_col).alias("row_id"))
    ids = found.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    joined = rows.join(ids, rows["row_id"].eqNullSafe(ids["id"]), "left")
    return joined.select(*unpacked(rows, "row"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def component_of(texts: DataFrame, percent: int = PERCENT, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """``texts`` (id, text) to (id, n_shingles, component_id), one row each."""
    kind = texts.schema["id"].dataType.simpleString()
    signed = checkpointed(texts.mapInArrow(_sign, f"id {kind}, n_shingles long, shingle_set binary, signature binary"))
    classes = checkpointed(
        signed.where("id IS NOT NULL AND shingle_set IS NOT NULL")
        .groupBy("shingle_set")
        .agg(F.min("id").alias("rep"), F.first("signature").alias("signature"))
    )
    bands = classes.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda b: F.xxhash64(b, F.col("signature").substr(b * BAND * 4 + 1, F.lit(BAND * 4))))).alias("band"))
    shared = bands.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band", "low")
    ties = bands.join(shared, "band").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    families = checkpointed(components(ties))

    # Written first, so that the join's side with large families is an exchange Spark can split.
    sizes = checkpointed(families.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block)))
    members = families.join(sizes, "component").select(
        F.col("component").alias("family"), F.col("node").alias("rep"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    )
    draw = lambda seed: F.xxhash64("rep", F.lit(seed))
    drawn = [F.min_by("rep", draw(k)) for k in range(1, HUBS + 1)]
    hubs = members.where("blocks > 1").groupBy("family").agg(F.array(*drawn).alias("hubs")).select("family", F.explode(F.array_distinct("hubs")).alias("rep"), F.lit(True).alias("hub"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    members = checkpointed(
        members.join(hubs, ["family", "rep"], "left").withColumn("targets", F.when(F.col("hub"), everywhere).otherwise(F.array("block"))).drop("hub")
    )
    wanted = members.select(F.xxhash64("rep").alias("key"))
    texts_of = likely_in(texts.select("id", "text", F.xxhash64("id").alias("key")), "key", wanted, "key")
    full = checkpointed(members.select("rep").join(classes, "rep").join(texts_of, F.col("rep") == F.col("id")).select("rep", "signature", "text"))
    ends = f"a {kind}, b {kind}"
    dealt = full.join(members.select("rep", "family", "targets"), "rep").withColumn("block", F.explode("targets"))
    first = checkpointed(dealt.select("family", "block", "rep", "signature", "text").groupBy("family", "block").applyInArrow(_block(percent, miss, False), ends))
    grouped = components(first)

    # Families of several blocks: what is outside the largest component meets all blocks.
    large = members.where("blocks > 1").select("family", "rep", "block", "blocks")
    spread = checkpointed(large.join(grouped, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node"))
    parts = spread.groupBy("family", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("family").agg(F.max_by("component", F.struct("size", "component")).alias("main"), (F.sum("size") - F.max("size")).alias("outside"))
    main = main.where("outside > 0").withColumn("parts", F.ceil(F.col("outside") / block))
    marked = checkpointed(spread.join(main, "family").withColumn("probe", F.col("component") != F.col("main")))
    if not marked.isEmpty():
        part = F.pmod(draw(0), F.col("parts"))
        # A group is one part of the probes and one block; a probe of the block itself is there once.
        all_parts, all_blocks = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        in_block = F.transform(all_parts, lambda p: F.struct(p.alias("part"), F.col("block").alias("block"), (F.col("probe") & (p == part)).alias("probe")))
        as_probe = F.transform(F.filter(all_blocks, lambda b: b != F.col("block")), lambda b: F.struct(part.alias("part"), b.alias("block"), F.lit(True).alias("probe")))
        placed = marked.select("family", "rep", "component", F.when(F.col("probe"), F.concat(in_block, as_probe)).otherwise(in_block).alias("places"))
        wide = full.join(placed, "rep").withColumn("place", F.explode("places")).select("family", "place.part", "place.block", "place.probe", "rep", "component", "signature", "text")
        second = wide.groupBy("family", "part", "block").applyInArrow(_block(percent, miss, True), ends)
        grouped = components(first.union(second))

    named = classes.select("shingle_set", "rep").join(grouped, F.col("rep") == F.col("node"), "left")
    named = named.select("shingle_set", F.coalesce("component", "rep").alias("component"))
    return signed.join(named, "shingle_set", "left").select(
        "id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with the columns of ``docs``."""
    found = component_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    dropped = found.where("id <> component_id").select("id").distinct()
    return docs.join(dropped, docs[id_col] == dropped["id"], "left_anti")
