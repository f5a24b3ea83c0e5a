"""Near duplicates by SimHash fingerprints and ball hashing that meets in the middle."""

import functools
import itertools
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow, bounds, complete, cut_lineage, forest, table, text_bytes, unlink, wide_key
from lodestream.llm.components import components

BITS = 64
SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more hashes in memory than a short one.
BLOCK = 1 << 14
#: Variants a group of fingerprints is planned for.
GROUP = 1 << 18
#: Variants from which on a group is split, and the further bits of a variant that split it.
HOT, MORE = 1 << 21, 8

# lane k of entry v is bit k of v: adding entries counts the bits of up to 255 bytes in eight lanes
_LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255))
    return sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text in UTF-8; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = [0, *itertools.accumulate(map(len, words))]
    n = len(words) - shingle + 1
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, BLOCK):
        stop = min(start + BLOCK, n)
        hashes = [digest(line[ends[i] + i : ends[i + shingle] + i + shingle - 1], SEED) for i in range(start, stop)]
        counts += _bit_counts(np.array(hashes, np.uint64))
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle):
    def run(batches):
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            prints = [fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(starts, starts[1:])]
            yield {"key": batch.column("key"), "id": batch.column("id"), "fp": np.array(prints, np.uint64).view(np.int64)}

    return run


def _flips(width: int, low: int) -> np.ndarray:
    """All values of width bits with low bits set, as 64-bit numbers."""
    out = [sum(1 << k for k in chosen) for chosen in itertools.combinations(range(width), low)]
    return np.array(out, np.uint64)


def _reach(prefix_bits: int, even: bool, radius: tuple[int, int]) -> list[int]:
    """Masks that carry a fingerprint to every prefix its variants have."""
    masks = []
    for low in range((radius[0] if even else radius[1]) + 1):
        for mask in _flips(prefix_bits, low):
            mask = int(mask) << (BITS - prefix_bits)
            masks.append(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask)
    return masks


class _Variants:
    """Variants of a fingerprint that keep a given prefix, by the bits flipped in the rest."""

    def __init__(self, prefix_bits: int):
        self.rest = BITS - prefix_bits
        self.flips = {}

    def of(self, prints, prefix, high, distance):
        """(variants, place of the fingerprint) at exactly that distance and with that prefix."""
        out = []
        for h in range(distance + 1):
            here = np.flatnonzero(high == h)
            low = distance - h
            if len(here) == 0 or low > self.rest:
                continue
            if low not in self.flips:
                self.flips[low] = _flips(self.rest, low)
            bottom = prints[here] & np.uint64((1 << self.rest) - 1)
            made = (bottom[:, None] ^ self.flips[low][None, :]) | prefix
            out.append((made.ravel(), np.repeat(here, len(self.flips[low]))))
        return out


def _meet(prefix_bits: int, block: int = 256):
    """Links among the fingerprints that have variants in a prefix.

    Variants are taken with an odd number of set bits only. A fingerprint with
    an even number emits the 64 at distance one; one with an odd number itself
    and the 2,016 at distance two. Two fingerprints up to three bits apart
    always meet in one, and of two that meet at least one is within distance one
    of it, unless both are odd and at distance two, which proves nothing: such
    pairs are not formed. The others are verified bit by bit and linked to the
    smallest near fingerprint of the meeting place.
    """
    variants = _Variants(prefix_bits)
    shift = np.uint64(BITS - prefix_bits)

    def links(prints, prefix):
        prefix = prefix << shift
        high = np.bitwise_count((prints ^ prefix) >> shift)
        odd = np.bitwise_count(prints) & 1 == 1
        evens, odds = prints[~odd], prints[odd]
        near = [(v, evens[p]) for v, p in variants.of(evens, prefix, high[~odd], 1)]
        near += [(v, odds[p]) for v, p in variants.of(odds, prefix, high[odd], 0)]
        if not near:
            return
        place = np.concatenate([v for v, _ in near])
        who = np.concatenate([w for _, w in near])
        order = np.lexsort((who, place))
        place, who = place[order], who[order]
        cut = bounds(place)
        first = np.repeat(cut[:-1], np.diff(cut))
        yield who, who[first]
        spots, hubs = place[cut[:-1]], who[cut[:-1]]
        scatter = np.uint64(0x9E3779B97F4A7C15)
        taken = np.zeros(1 << 20, bool)
        taken[(spots * scatter) >> np.uint64(44)] = True
        far, far_high = odds, high[odd]
        for start in range(0, len(far), block):
            some = far[start : start + block]
            for v, p in variants.of(some, prefix, far_high[start : start + block], 2):
                maybe = np.flatnonzero(taken[(v * scatter) >> np.uint64(44)])
                at = np.minimum(np.searchsorted(spots, v[maybe]), len(spots) - 1)
                hit = spots[at] == v[maybe]
                yield some[p[maybe[hit]]], hubs[at[hit]]

    def run(batches):
        for whole in complete(batches, "prefix"):
            prefixes = whole.column("prefix").to_numpy().view(np.uint64)
            prints = whole.column("fp").to_numpy().view(np.uint64)
            cut = bounds(prefixes)
            for start, stop in zip(cut, cut[1:]):
                found = list(links(np.unique(prints[start:stop]), prefixes[start]))
                if not found:
                    continue
                a = np.concatenate([x for x, _ in found])
                b = np.concatenate([x for _, x in found])
                real = (a != b) & (np.bitwise_count(a ^ b) <= 3)
                if real.any():
                    a, b = forest(a[real].view(np.int64), b[real].view(np.int64))
                    yield {"a": a, "b": b}

    return run


def _is_even() -> F.Column:
    return F.bit_count("fp") % 2 == 0


def _made(bits: int, even: F.Column, flips: F.Column) -> F.Column:
    """Variants that a fingerprint so many flips away from a prefix has in it."""
    rest = BITS - bits
    odd = F.when(flips == 0, F.lit(1 + rest * (rest - 1) // 2)).when(flips == 1, F.lit(rest)).otherwise(F.lit(1))
    return F.when(even, F.when(flips == 0, F.lit(rest)).otherwise(F.lit(1))).otherwise(odd).cast("long")


def _masks(bits: int, even: F.Column) -> F.Column:
    return F.when(even, F.array(*[F.lit(m) for m in _reach(bits, True, (1, 2))])).otherwise(
        F.array(*[F.lit(m) for m in _reach(bits, False, (1, 2))])
    )


def _longer(rows: DataFrame, bits: int, more: int) -> DataFrame:
    """(prefix, fp) under prefixes longer by so many bits, for what a fingerprint may still flip."""
    flips = F.bit_count(F.shiftrightunsigned("fp", BITS - bits).bitwiseXOR(F.col("prefix")))
    left = F.when(_is_even(), 1).otherwise(2) - flips
    masks = [[int(m) for low in range(most + 1) for m in _flips(more, low)] for most in range(3)]
    chosen = F.when(left == 0, F.array(*map(F.lit, masks[0]))).when(left == 1, F.array(*map(F.lit, masks[1])))
    own = F.shiftrightunsigned("fp", BITS - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    return rows.select("prefix", "fp", F.explode(chosen.otherwise(F.array(*map(F.lit, masks[2])))).alias("mask")).select(
        F.shiftleft("prefix", more).bitwiseOR(own.bitwiseXOR(F.col("mask").cast("long"))).alias("prefix"), "fp"
    )


def _dealt(prints: DataFrame, bits: int) -> tuple[list[tuple[int, DataFrame]], list[DataFrame]]:
    """[(bits of a prefix, rows (prefix, fp))], and the written steps they are read from.

    A prefix with more than HOT variants gets further bits, and so do those
    again that are still above it: a group of near copies is split however close
    they are, as at most 2,081 fingerprints are within reach of one variant.
    First the variants are counted from how many fingerprints share a prefix.
    """
    out, steps, rest = [], [], BITS - bits
    rows = prints.select("fp", F.explode(_masks(bits, _is_even())).alias("mask")).select(
        F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("mask")), rest).alias("prefix"), "fp"
    )
    own = prints.groupBy(F.shiftrightunsigned("fp", rest).alias("own"), _is_even().alias("even")).agg(F.count("*").alias("n"))
    sizes = own.select("*", F.explode(_masks(bits, F.col("even"))).alias("mask")).select(
        F.col("own").bitwiseXOR(F.shiftrightunsigned("mask", rest)).alias("prefix"),
        (F.col("n") * _made(bits, F.col("even"), F.bit_count("mask"))).alias("made"),
    )
    while True:
        hot = cut_lineage(sizes.groupBy("prefix").agg(F.sum("made").alias("made")).filter(F.col("made") > HOT).select("prefix"))
        steps.append(hot)
        if bits == BITS or hot.isEmpty():
            return [*out, (bits, rows)], steps
        out.append((bits, rows.join(hot, "prefix", "left_anti")))
        more = min(MORE, BITS - bits)
        rows = cut_lineage(_longer(rows.join(hot, "prefix", "left_semi"), bits, more))
        steps.append(rows)
        bits += more
        flips = F.bit_count(F.shiftrightunsigned("fp", BITS - bits).bitwiseXOR(F.col("prefix")))
        sizes = rows.select("prefix", _made(bits, _is_even(), flips).alias("made"))


def _linked(prints: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) that connect all distinct fingerprints up to max_bits apart."""
    if max_bits != 3:
        raise ValueError("the two half radii are laid out for three bits")
    n = prints.count()
    made = n * (64 + 2017) / 2
    prefix_bits = min(24, max(4, math.ceil(math.log2(max(2, made / GROUP)))))
    dealt, steps = _dealt(prints, prefix_bits)
    parts = [
        arrow(rows.repartition("prefix").sortWithinPartitions("prefix"), _meet(bits), "a long, b long") for bits, rows in dealt
    ]
    if len(parts) == 1:
        return parts[0]
    links = cut_lineage(functools.reduce(DataFrame.unionByName, parts))
    unlink(*steps)
    return links


def simhash_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3, key=None
) -> DataFrame:
    """(key, id, fp, root, component_id) of every document.

    Words are what ASCII white space separates, A-Z lower-cased; a text without
    words (null, empty, blank) has fingerprint zero and is linked like any
    other. Equal fingerprints are one node, so copies cost nothing. root names
    the group, component_id is its smallest id (null if it has none). Repeated
    rows are documents of their own. Only the number of distinct fingerprints
    reaches the driver: it sets how many bits of a variant make a shuffle key.
    The distance is a property of the ball layout: three bits.
    """
    rows = docs.select((wide_key(doc_id, text) if key is None else key).alias("key"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()
    id_type = rows.schema["id"].dataType.simpleString()
    prints = cut_lineage(arrow(rows, _fingerprints(shingle), f"key {key_type}, id {id_type}, fp long"))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("id")))
    star = components(_linked(nodes.select("fp"), max_bits))
    roots = nodes.join(star.select(F.col("a").alias("fp"), F.col("b").alias("top")), "fp", "left").select(
        "fp", "id", F.coalesce("top", "fp").alias("root")
    )
    least = cut_lineage(roots.groupBy("root").agg(F.min("id").alias("component_id")))
    known = cut_lineage(roots.join(least, "root").select("fp", "root", "component_id"))
    unlink(star)
    unlink(nodes)
    unlink(least)
    return prints.join(known, "fp")


def op4_simhash(spark, sf_dir):
    """Fingerprint and component of every document, three-word shingles, three bits."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
