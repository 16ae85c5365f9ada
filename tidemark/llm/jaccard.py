"""Exact Jaccard join of documents over word n-grams by universe partitioning and the pigeonhole principle.

Two sets of sizes a and b reach the threshold t only if they differ in at most (1 - t) / (1 + t) * (a + b) elements. Sizes fall
into bands. The scheme of a band bounds the differences of every pair whose smaller set lies in it by H, and hashes all
shingles into m > H segments; a set takes part in the scheme of its own band and, as a larger partner, in the one below. As
a difference spoils one segment only, two similar sets must agree on m - H segments.

* **Index.** A set writes one signature for each segment that is not empty: a digest of the segment's shingles. For small sets
  it also writes the one-deletion neighbourhood, a digest for each segment without each one of its shingles.
* **Free units.** A segment that no other set shares costs every partner a difference for nothing. A set with more than H of
  them has no partner at all and leaves. This takes out nearly everything that only shares passages.
* **Allocation.** A remaining set has to test as many segments as H + 1 minus its free units, and takes those whose lists are
  shortest; empty segments, whose list would be everything, are never tested. Where segments are too few because many are
  empty, a test within one deletion counts twice. If even that does not suffice, the set is compared with its whole band.
* **Sketches.** A set has ``SKETCH`` words of 64 bits; every shingle flips one bit. Sketches differ in at most as many bits as the
  sets in elements, so a pair whose sketches differ in more bits than linked sets of these sizes can differ in elements is no
  link. Such pairs never form, and the sets of the others alone travel. Sets of many more shingles than bits fill their sketch,
  which then excludes less and never a link.
* **Verification** is exact, on the sets. Equal sets are one class from the start. Lists are resolved by components: members
  are first compared with the leader that leads most of their lists, the one that shares most, and lists of one component go.
* **Pairs.** A list that is left and has at most ``PAIRS`` tests is searched for pairs: at most that many comparisons of sketches
  for each of its members.
* **Thinning.** In a longer list, every member is compared with its leader L, the member that shares most. Two members
  that link without both linking with L share a shingle outside L, unless one is smaller than L and the other has all that
  it needs inside L; these few are verified at once. So lists by (L, shingle outside L) replace the list, with
  as few shingles of each member as the overlap that it needs outside L allows. Members of a large group of near copies agree
  in what the group has in common and rarely in their differences: the group costs its size and not its square. This is
  repeated while long lists are left and that halves their pairs; then these are searched as well. No pair that could join two
  components is left out at any step.

Shingles and sets are compared by 64-bit digests. Nothing is collected: components are found by joins, each time only over links
between the components of before.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.columns import blocks, flat_bytes, fresh, with_small
from tidemark.llm.held import begin
from tidemark.session import materialise

WORDS = 5
#: Pairs link when SHARE_A * shared >= SHARE_B * (size a + size b): 100 I >= 75 U.
SHARE_A, SHARE_B = 7, 3
#: Bands grow by this ratio; schemes of at most SMALL differences have deletion neighbourhoods.
GROWTH, SMALL = (16, 9), 16
BLOCK_BYTES, FLUSH = 1 << 18, 1 << 18
#: Lists with more tests than this are replaced by thinner ones while that halves their pairs. A pair of sketches is compared in
#: place, where a set and its leader travel to be compared.
PAIRS = 256
#: Words of a sketch, and sketches that are broadcast.
SKETCH, SKETCHES = 8, 100_000
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: What separates words, and ASCII capitals become small.
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Per text the sorted distinct digests of its ``WORDS``-word shingles; of fewer words, one of the whole sequence."""
    for part in blocks([len(t) for t in texts], BLOCK_BYTES):
        raw, ends = flat_bytes([t.encode("utf-8", "surrogatepass") + b" " for t in texts[part]])
        raw = LOWER[raw]
        word = ~IS_SPACE[raw]
        first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        last = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
        size = 1 << max(16, len(raw).bit_length())
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[: len(raw)], out=sums[1:])
        words = mix((sums[last] - sums[first]) * powers(BACK, size)[first] + (last - first).astype(np.uint64))
        grams = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            grams = mix(grams + words[k : k + len(grams)])
        at = np.searchsorted(first, ends)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(grams[a : b - WORDS + 1])
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    h = mix(h + w)
                yield h
            else:
                yield np.zeros(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(grams: np.ndarray) -> np.ndarray:
    """``SKETCH`` signed 64-bit words in which every shingle has flipped one bit."""
    bit = ((mix(grams ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(64 * SKETCH) >> np.uint64(32)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64)


# ---- schemes

def most_apart(a: int, b: int) -> int:
    """How many elements two linked sets of these sizes can differ in."""
    return (a + b) * (SHARE_A - 2 * SHARE_B) // SHARE_A


def largest_partner(n: int) -> int:
    return n * (SHARE_A - SHARE_B) // SHARE_B


@functools.lru_cache(maxsize=1 << 16)
def schemes(n: int) -> tuple[tuple[int, int, int, bool], ...]:
    """The schemes that a set of ``n`` takes part in: (band, segments, differences to expect, has deletions).

    The first is that of its own band, the second, if any, that of the band below. Schemes without differences are left out,
    as equal sets are one class already.
    """
    low, band, before = 1, 0, None
    while True:
        high = max(low + 1, low * GROWTH[0] // GROWTH[1]) - 1
        if n <= high:
            break
        before, low, band = high, high + 1, band + 1

    def scheme(index: int, top: int, apart: int) -> tuple[int, int, int, bool]:
        bound = most_apart(top, largest_partner(top))
        return index, -(-6 * (bound + 1) // 5) + int(3 * (bound + 1) ** 0.5) + 2, apart, bound <= SMALL

    out = []
    if most_apart(n, largest_partner(n)):
        out.append(scheme(band, high, most_apart(n, largest_partner(n))))
    if before is not None and n <= largest_partner(before) and most_apart(n, before):
        out.append(scheme(band - 1, before, most_apart(n, before)))
    return tuple(out)


def segmented(grams: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles by segment: their own digests in segment order, where each used segment starts, its number, its digest."""
    own = mix(grams ^ np.uint64(0xD6E8FEB86659FD93))
    segment = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    segment, parts = segment[order], mix(own[order])
    starts = np.flatnonzero(np.diff(segment, prepend=np.uint64(m)))
    return parts, starts, segment[starts] + np.uint64(band << 40), np.add.reduceat(parts, starts)


def signatures(grams: np.ndarray, band: int, m: int, deletions: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment signatures, those of the one-deletion neighbourhoods, and the numbers of the segments of both.

    The lowest bit of a signature tells neighbouring bands apart.
    """
    parts, starts, place, digest = segmented(grams, band, m)
    close = lambda d, p: (mix(d + mix(p)) & ~np.uint64(1)) | np.uint64(band & 1)
    if not deletions:
        return close(digest, place), np.zeros(0, np.uint64), place, place[:0]
    size = np.diff(np.append(starts, len(parts)))
    of = np.repeat(np.arange(len(starts)), size)
    many = size[of] > 1
    return close(digest, place), close(digest[of[many]] - parts[many], place[of[many]]), place, place[of[many]]


# ---- tables

def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, n, class`` per row, and for either parity of a scheme ``band, need, twos``.

    ``need`` is how many units the used segments lack to reach H + 1 (0 or less: enough), ``twos`` how many segments can be
    tested within one deletion.
    """
    fields = [("id", pa.string()), ("n", pa.int64()), ("class", pa.int64())] + [(f"{c}{p}", pa.int32()) for p in (0, 1) for c in ("band", "need", "twos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        for batch in batches:
            rows = []
            for key_, grams in zip(batch.column(0).to_pylist(), shingle_sets([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                row = {"id": key_, "n": len(grams), "class": set_id(grams) if len(grams) else None}
                for band, m, apart, deletions in schemes(len(grams)) if len(grams) else ():
                    parts, starts, _, _ = segmented(grams, band, m)
                    twos = int((np.diff(np.append(starts, len(parts))) > 1).sum()) if deletions else 0
                    row |= {f"band{band & 1}": band, f"need{band & 1}": apart + 1 - len(starts), f"twos{band & 1}": twos}
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in fields], [name for name, _ in fields])

    schema = "id string, n bigint, class bigint, " + ", ".join(f"{c}{p} int" for p in (0, 1) for c in ("band", "need", "twos"))
    return docs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, schema)


def entries(docs: DataFrame, text: str) -> DataFrame:
    """``sig, class, deleted``: the index of all sets. A task writes each class once, so that copies of it do not add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, bool]] = []

        def flushed() -> pa.RecordBatch:
            sig = np.concatenate([s for s, _, _ in held]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.concatenate([c for _, c, _ in held])), pa.array(np.concatenate([np.full(len(s), d) for s, _, d in held]))], ["sig", "class", "deleted"])

        for batch in batches:
            for grams in shingle_sets([t or "" for t in batch.column(0).to_pylist()]):
                if not len(grams) or (name := set_id(grams)) in seen:
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(name)
                for band, m, _, deletions in schemes(len(grams)):
                    for sig, deleted in zip(signatures(grams, band, m, deletions)[:2], (False, True), strict=True):
                        if len(sig):
                            held.append((sig, np.full(len(sig), name, np.int64), deleted))
                if sum(len(s) for s, _, _ in held[-4:]) and len(held) % 64 == 0 and sum(len(s) for s, _, _ in held) > FLUSH:
                    yield flushed()
                    held = []
        if held:
            yield flushed()

    return docs.select(F.col(text)).mapInArrow(run, "sig bigint, class bigint, deleted boolean")


def probes(index: DataFrame, classes: DataFrame) -> DataFrame:
    """``sig, class, deleted, probe, n, weight`` of the sets that can have a partner; see the module for the reasoning.

    ``weight`` is how much a set shares: the lengths of its lists together.
    """
    same = Window.partitionBy("sig")
    own, other = F.when(~F.col("deleted"), F.col("class")), F.when(F.col("deleted"), F.col("class"))
    met = index.select(
        "sig", "class", "deleted", F.min(own).over(same).alias("s0"), F.max(own).over(same).alias("s1"), F.min(other).over(same).alias("d0"), F.max(other).over(same).alias("d1"), F.count("*").over(same).alias("length")
    )
    outside = lambda a, b: F.coalesce((F.col(a) != F.col("class")) | (F.col(b) != F.col("class")), F.lit(False))
    met = met.withColumn("shared", ~F.col("deleted") & (F.col("s0") != F.col("s1")))
    met = met.where(F.col("shared") | F.when(F.col("deleted"), outside("s0", "s1")).otherwise(outside("d0", "d1")))
    met = met.select("sig", "class", "deleted", "shared", "length", F.col("sig").bitwiseAND(1).alias("parity")).repartition("class", "parity").dropDuplicates(["class", "parity", "sig", "deleted"])
    facts = classes.select("class", "n", F.explode(F.array(*[F.struct(F.lit(p).cast("bigint").alias("parity"), F.col(f"need{p}").alias("need")) for p in (0, 1)])).alias("x")).where(F.col("x.need").isNotNull()).select("class", "n", "x.parity", "x.need")
    mine = Window.partitionBy("class", "parity")
    ranked = met.join(facts, ["class", "parity"]).withColumn("units", F.col("need") + F.sum(F.col("shared").cast("int")).over(mine))
    ranked = ranked.where(F.col("units") > 0).withColumn("rank", F.row_number().over(mine.orderBy(F.col("shared").desc(), "length", "sig")))
    probe = F.when(F.col("shared"), F.col("rank") <= F.col("units")).otherwise(F.col("need") > 0)
    return ranked.withColumn("weight", F.sum(F.when(F.col("shared"), F.col("length")).otherwise(0)).over(mine)).select("sig", "class", "deleted", probe.alias("probe"), "n", "weight")


def _close(a, b):
    """Whether sizes allow a link."""
    return F.least(a, b) * (SHARE_A - SHARE_B) >= F.greatest(a, b) * SHARE_B


def sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``class, grams, s0 ..`` of the classes in ``wanted`` (``id, class``) with their sketches, read again from the texts of one document each."""
    plain = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    rows = with_small(plain, wanted.select("id", "class"), F.col("k").eqNullSafe(F.col("id"))).select("class", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c, g) for c, g in zip(batch.column(0).to_pylist(), shingle_sets([t or "" for t in batch.column(1).to_pylist()]), strict=True) if set_id(g) == c] if batch.num_rows else []
            words = np.array([sketch(g) for _, g in found], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([g.tobytes() for _, g in found], pa.binary()), *[pa.array(words[:, i].copy()) for i in range(SKETCH)]], ["class", "grams", *SKETCHED])

    return rows.mapInArrow(run, "class bigint, grams binary, " + ", ".join(f"{s} bigint" for s in SKETCHED))


#: The columns of a sketch.
SKETCHED = [f"s{i}" for i in range(SKETCH)]


def _near(a: str, b: str, both):
    """Whether the sketches ``a0 ..`` and ``b0 ..`` allow a link of sets whose sizes sum to ``both``."""
    bits = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(SKETCH)), F.lit(0))
    return bits * SHARE_A <= both * (SHARE_A - 2 * SHARE_B)


def sketches_of(sets: DataFrame, name: str, prefix: str) -> DataFrame:
    """The sketches of classes, keyed by ``name`` and with columns of this prefix."""
    return sets.select(F.col("class").alias(name), *[F.col(s).alias(f"{prefix}{i}") for i, s in enumerate(SKETCHED)])


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` of ``a, b, both`` (sum of sizes) whose sketches allow a link, as ``a, b``."""
    for side in ("a", "b"):
        pairs = with_small(pairs.withColumnRenamed(side, f"{side}_"), sketches_of(sets, side, f"{side}s"), F.col(f"{side}_") == F.col(side), most=SKETCHES).drop(f"{side}_")
    return pairs.where(_near("as", "bs", F.col("both"))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets link. Only sets of pairs travel."""
    pairs = materialise(pairs.select("a", "b"), "jaccard-pairs")
    left, right = sets.select(F.col("class").alias("of"), F.col("grams").alias("x")), sets.select(F.col("class").alias("b"), F.col("grams").alias("y"))
    left = with_small(left, pairs, F.col("of") == F.col("a")).drop("of")
    right = with_small(right, pairs.select(F.col("b").alias("of")).distinct(), F.col("b") == F.col("of"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(two, one), len(two) - 1)
                keep.append(SHARE_A * int((two[place] == one).sum()) >= SHARE_B * (len(one) + len(two)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return left.join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``class, comp`` for every class in ``edges`` (``a, b``): labels fall to the least neighbour's, and then to their label's."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = materialise(both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("class").alias("b"), "comp"), "b").groupBy(F.col("a").alias("class")).agg(F.min("comp").alias("near"))
        lower = label.join(near, "class").select("class", F.col("comp").alias("was"), F.least("comp", "near").alias("low"))
        # The label is a class itself; its own label may be lower still.
        jump = label.select(F.col("class").alias("low"), F.col("comp").alias("lowest"))
        label = materialise(lower.join(jump, "low", "left").select("class", F.least("low", F.coalesce("lowest", "low")).alias("comp"), "was"), "labels")
        if not label.where(F.col("was") != F.col("comp")).limit(1).count():
            return label.select("class", "comp")


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (``class, comp``) with the links ``a, b`` added. Only what they join of components and new classes is worked on."""
    for side in ("a", "b"):
        links = links.join(comps.select(F.col("class").alias(side), F.col("comp").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    links = materialise(links.where("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "jaccard-links")
    if not links.limit(1).count():
        return comps
    new = components(links).select("class", F.col("comp").alias("new"))
    # A component's name is a class of its own, so the names among the vertices have their row in comps and the others have none.
    moved = comps.join(new.select(F.col("class").alias("comp"), "new"), "comp", "left").select("class", F.coalesce("new", "comp").alias("comp"))
    return materialise(moved.union(new.join(comps, "class", "left_anti").select("class", "new")), "jaccard-components")


def mixed(lists: DataFrame, comps: DataFrame, lead) -> DataFrame:
    """The entries of the lists that still hold two components and a test, with ``comp`` made new, ``asks``, the tests of each, and ``lead``, the least ``lead`` of each.

    Lists are summed before they are joined, so that a long one is never one task.
    """
    named = lists.drop("comp", "asks", "lead", "small").join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    heads = named.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count_if("probe").alias("asks"), F.min(lead).alias("lead"), F.min("n").alias("small"))
    return named.join(heads.where((F.col("c0") != F.col("c1")) & (F.col("asks") > 0) & F.col("lead").isNotNull()).select("sig", "asks", "lead", "small"), "sig")


def proposals(lists: DataFrame) -> DataFrame:
    """One pair ``a, b, both`` for each class: it and the leader that leads most of its lists."""
    met = lists.where((F.col("lead.comp") != F.col("comp")) & (F.col("probe") | F.col("lead.probe")) & _close(F.col("n"), F.col("lead.n")))
    votes = met.groupBy(F.col("class").alias("a"), F.col("lead.class").alias("b")).agg(F.count("*").alias("count"), F.first(F.col("n") + F.col("lead.n")).alias("both"))
    return votes.groupBy("a").agg(F.max(F.struct("count", "b", "both")).alias("best")).select("a", "best.b", "best.both")


def beyond(one: np.ndarray, head: np.ndarray, small: int) -> tuple[bool, int, np.ndarray]:
    """Whether a set links with the leader of its lists, what they share, and the shingles outside the leader to meet partners by.

    ``small`` is the least size in the lists. A partner of the set shares at least what the smallest possible partner would
    need; what the set does not have in the leader must be met outside. Of two linked sets that do not both link with the
    leader, one has this above 0, or is left to :func:`loose_pairs`. So the first shingles outside, by value, up to what may
    be missing, have one in common.
    """
    place = np.minimum(np.searchsorted(head, one), len(head) - 1)
    inside = head[place] == one
    shared = int(inside.sum())
    least = max(small, -(-len(one) * SHARE_B // (SHARE_A - SHARE_B)))
    needed = max(1, -(-SHARE_B * (len(one) + least) // SHARE_A) - shared)
    rest = one[~inside]
    return SHARE_A * shared >= SHARE_B * (len(one) + len(head)), shared, rest[: max(0, len(rest) - needed + 1)]


def thinned(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """``class, head, n, probe, weight, small, linked, shared, keys``: every class beside the leaders of its lists, and the lists that replace them."""
    met = lists.groupBy("class", F.col("lead.class").alias("head")).agg(F.first("n").alias("n"), F.max("probe").alias("probe"), F.max("weight").alias("weight"), F.min("small").alias("small")).where(F.col("class") != F.col("head"))
    rows = met.join(sets.select("class", F.col("grams").alias("x")), "class").join(sets.select(F.col("class").alias("head"), F.col("grams").alias("y")), "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, common, keys = [], [], []
            for name, small, x, y in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), batch.column(6), batch.column(7), strict=True):
                ties, shared, rest = beyond(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), small)
                linked.append(ties)
                common.append(shared)
                keys.append(mix(rest + mix(np.array([name], np.int64).view(np.uint64))).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([*keys, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(linked, pa.bool_()), pa.array(common, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["class", "head", "n", "probe", "weight", "small", "linked", "shared", "keys"])

    return rows.select("class", "head", "n", "probe", "weight", "small", "x", "y").mapInArrow(run, "class bigint, head bigint, n bigint, probe boolean, weight bigint, small bigint, linked boolean, shared bigint, keys array<bigint>")


def loose_pairs(lists: DataFrame, beside: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of a set that does not link with its leader and a set below the leader's size, for which the first has enough in the leader."""
    loose = beside.where(~F.col("linked") & (SHARE_A * F.col("shared") >= SHARE_B * (F.col("n") + F.col("small")))).select("class", "head", "shared")
    now = lists.drop("comp").join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")).withColumn("head", F.col("lead.class"))
    one = now.join(loose, ["class", "head"]).select("sig", F.col("class").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), "shared")
    two = now.where(F.col("n") < F.col("lead.n")).select("sig", F.col("class").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
    met = one.join(two, "sig").where((F.col("ca") != F.col("cb")) & _close(F.col("na"), F.col("nb")) & (SHARE_A * F.col("shared") >= SHARE_B * (F.col("na") + F.col("nb"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("both")).distinct()


def list_pairs(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of different components that meet in a list in which one of them has a test, and whose sketches allow a link."""
    drawn = with_small(lists, sketches_of(sets, "of", "s"), F.col("class") == F.col("of"), most=SKETCHES)
    side = lambda c, m: drawn.select("sig", F.col("class").alias(c), F.col("comp").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.col("probe").alias(m), *[F.col(s).alias(f"{c}{s}") for s in SKETCHED])
    pair = side("a", "asks").where("asks").join(side("b", "asked"), "sig")
    met = pair.where((F.col("ca") != F.col("cb")) & _close(F.col("na"), F.col("nb")) & (~F.col("asked") | (F.col("a") < F.col("b"))) & _near("as", "bs", F.col("na") + F.col("nb")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 1, thinnings: int = 12) -> DataFrame:
    """``id, n, class, comp`` per row of ``docs``: size of its set, its class of equal sets, its component (a class).

    Null and empty texts have no set, no class and no component. Rows of equal sets share a class. Rows are told apart by
    their text alone, so null or repeated ids do no harm. An empty table gives an empty result.
    """
    rows = materialise(described(docs, key, text), "jaccard-rows")
    facts = [F.first(f"{c}{p}").alias(f"{c}{p}") for p in (0, 1) for c in ("band", "need", "twos")]
    classes = materialise(rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), *facts), "jaccard-classes")
    lists = materialise(probes(entries(docs, text), classes), "jaccard-lists")
    wild = classes.where(F.greatest(*[F.col(f"need{p}") - F.col(f"twos{p}") for p in (0, 1)]) > 0)
    wild = [
        wild.where(F.col(f"need{p}") > F.col(f"twos{p}")).select(F.col("class").alias("a"), F.col("n").alias("na"), F.col(f"band{p}").alias("band"))
        .join(classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col(f"band{p}").alias("band")), "band")
        .where((F.col("a") != F.col("b")) & _close(F.col("na"), F.col("nb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("both"))
        for p in (0, 1)
    ]
    wild = materialise(wild[0].union(wild[1]).distinct(), "jaccard-wild")
    named = lists.select("class").union(wild.select("a")).union(wild.select("b")).distinct()
    sets = materialise(sets_of(docs, classes.join(named, "class", "left_semi"), key, text), "jaccard-sets")
    comps = merged(docs.sparkSession.createDataFrame([], "class bigint, comp bigint"), verified(possible(wild, sets), sets))
    for step in range(rounds):
        order = F.xxhash64("comp", F.lit(step)) if step else -F.col("weight")
        lead = F.when(~F.col("deleted"), F.struct(order.alias("o"), "comp", "class", "n", "probe"))
        lists = materialise(mixed(lists, comps, lead), "jaccard-lists")
        comps = merged(comps, verified(possible(proposals(lists), sets), sets))
    before = None
    for step in range(thinnings + 1):
        lists = materialise(mixed(lists.select("sig", "class", "n", "probe", "weight"), comps, F.struct((-F.col("weight")).alias("o"), "class", "n")), "jaccard-lists")
        long = F.col("asks") > PAIRS
        size = lists.agg(F.count("*").alias("k"), F.sum(F.when(long, F.col("asks"))).alias("pairs")).first()
        if not size.k:
            break
        last = step == thinnings or not size.pairs or (before is not None and 2 * size.pairs > before)
        comps = merged(comps, verified(list_pairs(lists if last else lists.where(~long), sets), sets))
        if last:
            break
        before, lists = size.pairs, lists.where(long)
        beside = materialise(thinned(lists, sets), "jaccard-beside")
        comps = merged(comps, beside.where("linked").select(F.col("class").alias("a"), F.col("head").alias("b")))
        comps = merged(comps, verified(possible(loose_pairs(lists, beside, comps), sets), sets))
        lists = beside.select(F.explode("keys").alias("sig"), "class", "n", "probe", "weight")
    found = rows.select("id", "n", "class").join(comps, "class", "left")
    return found.select("id", "n", "class", F.coalesce("comp", "class").alias("comp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key, n_shingles, component_id``: the least key of its component; a row without a set is its own component."""
    rows = materialise(joined(docs, key, text).withColumn("key", F.col("id").cast(docs.schema[key].dataType)), "jaccard-joined")
    least = rows.where(F.col("comp").isNotNull()).groupBy(F.col("comp").alias("of")).agg(F.min("key").alias("least"))
    found = rows.join(least, F.col("comp") == F.col("of"), "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of its class with the least key, the row with that key.

    Null keys come last; of wholly repeated rows one stays; rows without a set link with nothing and all stay. Only the rows
    of classes that have copies or partners are told apart by a join; all others pass through as they are read.
    """
    kind = docs.schema[key].dataType
    rows = materialise(joined(docs, key, text).where(F.col("class").isNotNull()).withColumn("key", F.col("id").cast(kind)), "jaccard-joined")
    by_class = rows.groupBy("class").agg(F.min("key").alias("least"), F.count("*").alias("rows"), F.first("comp").alias("comp"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "class"))
    best = by_class.groupBy(F.col("comp").alias("of")).agg(first.alias("best"), F.sum("rows").alias("all"))
    touched = by_class.join(best.where(F.col("all") > 1), F.col("comp") == F.col("of")).select(F.col("class").alias("of"), "least", (F.col("best.class") == F.col("class")).alias("stays"))
    touched = materialise(touched, "jaccard-touched")
    name, of, least, stays = fresh(docs, "class", "of", "least", "stays")
    at = docs.columns.index(text)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_id(g) if len(g) else None for g in shingle_sets([t or "" for t in batch.column(at).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, name])

    marked = docs.mapInArrow(classed, docs.withColumn(name, F.lit(None).cast("bigint")).schema)
    marked = with_small(marked, touched.select(F.col("of").alias(of), F.col("least").alias(least), F.col("stays").alias(stays)), F.col(name) == F.col(of), "left")
    alone = marked.where(F.col(of).isNull())
    chosen = marked.where(F.col(stays) & F.col(key).eqNullSafe(F.col(least))).dropDuplicates([name])
    return alone.unionByName(chosen).select(*docs.columns)


#: The same rows as :func:`near_duplicates` by comparing all documents that share a shingle, for DuckDB.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM met UNION SELECT b, a FROM met),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, both_.b FROM reach JOIN both_ ON reach.r = both_.a)
SELECT sets.doc_id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least_ AS component_id
FROM sets JOIN (SELECT d, min(r) AS least_ FROM reach GROUP BY d) ON d = sets.doc_id
"""
