"""Near-duplicate documents: circulant MinHash, banding, exact confirmation, connected components.

1. A document is its set of distinct word shingles. Two permutations make its signature: the first
   (sigma) scatters the shingles over a universe of ``UNIVERSE`` places, the second (pi) is shifted
   circularly by one place for each of the ``BANDS * ROWS`` coordinates (C-MinHash), so a shingle's
   coordinates are one contiguous window of pi.
2. Documents with the same set are one class, found by a 128-bit digest of the set; a class goes on as
   its least doc_id. Groups of copies, however large, are counted before they are shuffled.
3. Classes that share a band meet in a bucket. No pairs within a bucket are listed: each member is
   tied to the bucket's least member only (a star), and stars make candidate clusters. A star holds
   members of every size, as two that fit each other need not fit the least one; sizes are compared
   for pairs only.
4. Within a cluster, shingles that at most two classes hold are rare, others common. The number of
   rare ones that two classes share, plus the lesser of their numbers of common ones, bounds their
   intersection from above. So two classes can be similar enough only if they share rare shingles
   (these pairs come from the shingles' counts, least and greatest holders: no lists of holders), or
   if both have ``percent`` of common ones. A passage that many documents share makes none of these.
5. The latter, alone, are compared within buckets: all members with the one that has the largest
   share of common shingles; then, where a bucket still holds more than one component, members outside
   that one's component in turn, a few at first and eight times as many in each round, with the members
   of other components that the bound allows. When no member is left, every pair of a bucket was
   compared, excluded by the bound or lies in one component: no link between candidates is lost.
6. Pairs are confirmed on full shingle sets, by hashes first and then on the words themselves, and
   confirmed links joined into components, always by rounds over the cluster.

A pair at the threshold of 0.75 misses all 32 bands of 4 rows with a chance of 5 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardframe.llm import textbytes as tb
from hazardframe.llm.graph import components
from hazardframe.llm.store import Workspace, read_table

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
UNIVERSE = 1 << 20
SEED = 20240607
#: Members of a bucket that are heads in the second round; each later round takes eight times as many.
FIRST_PIVOTS = 8
#: Members that are compared with one copy of their head's text, about.
GROUP_PAIRS = 1000


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """sigma, and the windows of pi: row p holds pi at p, p + 1, ... around the circle."""
    rng = np.random.default_rng(SEED)
    sigma = rng.permutation(UNIVERSE).astype(np.int64)
    pi = rng.permutation(UNIVERSE).astype(np.uint32)
    return sigma, sliding_window_view(np.concatenate([pi, pi[: BANDS * ROWS - 1]]), BANDS * ROWS)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    low = tb.LOWER[data]
    starts, ends = tb.runs(data, bounds, tb.NOT_SPACE)
    words = tb.span_hashes(low, starts, ends, 13)
    n_words = np.bincount(tb.owner_of(bounds, starts), minlength=len(bounds) - 1)
    grams = tb.gram_hashes(words, k)
    first = np.cumsum(n_words) - n_words
    out = []
    for at, n in zip(first.tolist(), n_words.tolist(), strict=True):
        if n >= k:
            s = np.sort(grams[at : at + n - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(tb.gram_hashes(words[at : at + n], n, 17) if n else words[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The C-MinHash coordinates of a non-empty set."""
    sigma, windows = _permutations()
    at = sigma[(shingles & tb.U64(UNIVERSE - 1)).astype(np.int64)]
    least = None
    for k in range(0, len(at), 2048):
        part = windows[at[k : k + 2048]].min(0)
        least = part if least is None else np.minimum(least, part)
    return least


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, numbers = tb.randoms(ROWS, 19), np.arange(BANDS, dtype=np.uint64) * tb.U64(0xD6E8FEB86659FD93)
    for batch in tb.slices(batches):
        sets = shingle_sets(*tb.texts(batch.column("text")))
        sizes = np.array([len(s) for s in sets])
        digest = np.zeros((2, len(sets)), np.uint64)
        bands = []
        for i, s in enumerate(sets):
            if len(s):
                digest[0, i], digest[1, i] = tb.mix(s + tb.U64(1)).sum(), tb.mix(s ^ tb.U64(0xA5A5A5A5A5A5A5A5)).sum()
                bands.append(tb.mix((signature(s).reshape(BANDS, ROWS).astype(np.uint64) * rows).sum(1, dtype=np.uint64) + numbers))
        at = pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]), pa.int32())
        values = pa.array(tb.signed(np.concatenate(bands)) if bands else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(tb.signed(digest[0])), pa.array(tb.signed(digest[1])), pa.ListArray.from_arrays(at, values)],
            ["doc_id", "n", "s1", "s2", "bands"],
        )


def _word_shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for a text of at least one word."""
    words = text.translate(tb.LOWER.tobytes()).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _confirm(k: int, percent: int):
    """Links (a, b) among the pairs of heads (rows without m) and the members (m) that follow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, head, x, words = None, b"", None, None
        for batch in tb.slices(batches):
            data, bounds = tb.texts(batch.column("text"))
            sets, links = shingle_sets(data, bounds, k), []
            for i, (now, m) in enumerate(zip(batch.column("p").to_pylist(), batch.column("m").to_pylist(), strict=True)):
                text = data[bounds[i] : bounds[i + 1]].tobytes()
                if m is None:
                    p, head, x, words = now, text, sets[i], None
                    continue
                y = sets[i]
                near = x[x <= y[-1]] if len(y) else x[:0]
                both = np.count_nonzero(y[np.searchsorted(y, near)] == near)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    words = words or _word_shingles(head, k)
                    other = _word_shingles(text, k)
                    both = len(words & other)
                    if 100 * both >= percent * (len(words) + len(other) - both):
                        links.append((min(p, m), max(p, m)))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    return run


def _postings(k: int):
    """(cluster, rep, s): every shingle of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            sets = shingle_sets(*tb.texts(batch.column("text")), k)
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            shingles = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("cluster").take(at), batch.column("doc_id").take(at), pa.array(tb.signed(shingles))], ["cluster", "rep", "s"])

    return run


def _allowed(n: str, f: str, other_n: str, other_f: str, percent: int, shared=0):
    """Whether the bound on the intersection reaches percent of the union."""
    most = F.least(f, other_f) + shared
    return most * (100 + percent) >= (F.col(n) + F.col(other_n)) * percent


def _fits(x: str, y: str, percent: int):
    """Sizes that allow the similarity: exact, as an intersection is no larger than either set."""
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, first_pivots: int = FIRST_PIVOTS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    ``docs`` has doc_id (unique) and text; other columns are not read. Documents are linked where
    100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id
    reachable and kept marks it. A null or wordless text has no shingles and is linked with nothing.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if shingle != SHINGLE:
        raise ValueError(f"signatures take shingles of {SHINGLE} words")
    signed = space.save(docs.mapInArrow(_sign, "doc_id long, n long, s1 long, s2 long, bands array<long>"), "signed")
    classes = signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = space.save(classes, "classes")

    banded = classes.select("rep", "n", F.explode("bands").alias("h"))
    buckets = banded.groupBy("h").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    members = space.save(banded.join(buckets.hint("merge"), "h"), "members")

    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = space.save(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "texts")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        # a head's text goes once to each group of its members; a head of many members has many groups
        groups = pairs.groupBy("p").agg(F.ceil(F.count("*") / GROUP_PAIRS).alias("parts"))
        dealt = pairs.join(groups, "p").select("p", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("m"), "parts")
        dealt = dealt.select("p", F.pmod(F.xxhash64("m"), "parts").alias("part"), "m").join(texts.withColumnRenamed("doc_id", "m"), "m")
        heads = groups.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        heads = heads.join(texts.withColumnRenamed("doc_id", "p"), "p").select("p", "part", F.lit(None).cast("long").alias("m"), "text")
        rows = heads.union(dealt.select("p", "part", "m", "text")).repartition("p", "part").sortWithinPartitions("p", "part", F.col("m").asc_nulls_first())
        return space.save(rows.mapInArrow(_confirm(shingle, percent), "a long, b long"), name)

    stars = members.where("rep <> pivot")
    clusters = components(stars.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), space, "clusters")

    # shingles held by one or two classes of a cluster, counted by their holders
    inside = texts.join(clusters.select(F.col("v").alias("doc_id"), F.col("root").alias("cluster")).hint("merge"), "doc_id")
    postings = inside.mapInArrow(_postings(shingle), "cluster long, rep long, s long")
    holders = postings.groupBy("cluster", "s").agg(F.count("*").alias("held"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    shared = space.save(holders.where("held <= 2").groupBy("lo", "hi").agg(F.count("*").alias("shared")), "shared")
    rare = shared.select(F.col("lo").alias("rep"), "shared").union(shared.where("lo <> hi").select("hi", "shared")).groupBy("rep").agg(F.sum("shared").alias("rare"))
    sizes = classes.select("rep", "n").join(clusters.select(F.col("v").alias("rep")), "rep", "left_semi")
    profile = space.save(sizes.join(rare, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common")), "profile")

    side = lambda x, end: profile.select(F.col("rep").alias(x), F.col("n").alias(f"n_{end}"), F.col("common").alias(f"common_{end}"))
    few = shared.where("lo <> hi").join(side("lo", "a"), "lo").join(side("hi", "b"), "hi")
    few = few.where(_allowed("n_a", "common_a", "n_b", "common_b", percent, F.col("shared")) & _fits("n_a", "n_b", percent))

    core = members.select("h", "rep").join(profile.where(F.col("common") * 100 >= F.col("n") * percent), "rep")
    core = space.save(core.withColumn("rank", F.struct((1 - F.col("common") / F.col("n")).alias("off"), "rep")), "core")
    heads = core.groupBy("h").agg(F.count("*").alias("size"), F.min_by(F.struct("rep", "n", "common"), "rank").alias("head")).where("size > 1")
    headed = core.join(heads, "h").select("h", "rep", "n", "common", "rank", "size", F.col("head.rep").alias("p"), F.col("head.n").alias("p_n"), F.col("head.common").alias("p_common"))
    headed = space.save(headed, "headed")
    first = headed.where((F.col("rep") != F.col("p")) & _allowed("n", "common", "p_n", "p_common", percent) & _fits("n", "p_n", percent))
    first = first.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"), "p")
    pairs = space.save(first.union(few.select("lo", "hi", F.col("lo").alias("p"))).groupBy("a", "b").agg(F.min("p").alias("p")), "pairs-1")
    links = confirm(pairs, "links-1")
    roots = components(links, space, "round-1")

    # pairs that share a bucket of more than two, and neither a component nor a confirmed comparison
    compared, k, pivots = pairs, 1, first_pivots
    rest = headed.where("size > 2").select("h", "rep", "n", "common", "rank").join(classes.select("rep", "bands"), "rep")
    done = None
    while True:
        k += 1
        now = rest.join(roots.withColumnRenamed("v", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        mixed = now.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("root", "rank").alias("main")).where("lo <> hi")
        rest = space.save(now.join(mixed, "h").select("h", "rep", "n", "common", "rank", "bands", "root", "main"), f"rest-{k}")
        outside = rest.where("root <> main")
        if done is not None:
            outside = outside.join(done, ["h", "rep"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("h").orderBy("rank"))
        chosen = space.save(outside.withColumn("turn", turn).where(F.col("turn") <= pivots).select("h", F.col("rep").alias("p"), F.col("n").alias("p_n"), F.col("common").alias("p_common"), F.col("bands").alias("p_bands"), F.col("root").alias("p_root")), f"chosen-{k}")
        if chosen.isEmpty():
            break
        allowed = _allowed("n", "common", "p_n", "p_common", percent) & _fits("n", "p_n", percent)
        once = F.array_min(F.array_intersect("bands", "p_bands")) == rest.h  # a pair counts in its least bucket only
        found = rest.join(chosen, "h").where((F.col("root") != F.col("p_root")) & allowed & once)
        found = found.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"), "p").groupBy("a", "b").agg(F.min("p").alias("p"))
        pairs = space.save(found.join(compared, ["a", "b"], "left_anti"), f"pairs-{k}")
        compared = compared.union(pairs)
        links = confirm(pairs, f"links-{k}")
        newly = chosen.select("h", F.col("p").alias("rep"))
        done = newly if done is None else done.union(newly)
        rest = rest.select("h", "rep", "n", "common", "rank", "bands")
        pivots *= 8
        if links.isEmpty():
            continue
        ends = links
        for c in "ab":  # links between components
            ends = ends.join(roots.withColumnRenamed("v", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        up = components(ends, space, f"round-{k}")
        moved = roots.join(up.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        roots = space.save(moved.union(up.join(roots.select("v"), "v", "left_anti").select("v", "root")), f"roots-{k}")

    space.drop("texts", "members", "shared", "profile", "core", "headed")
    space.drop(*(f"{x}-{i}" for x in ("pairs", "links", "rest", "chosen") for i in range(1, k + 1)))
    ids = classes.select("n", "s1", "s2", "rep").join(roots.withColumnRenamed("v", "rep"), "rep", "left")
    ids = ids.select("n", "s1", "s2", F.coalesce("root", "rep").alias("component_id"))
    found = signed.select("doc_id", "n", "s1", "s2").join(ids.hint("merge"), ["n", "s1", "s2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def dedup_near(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group of near-duplicates (its least doc_id), with all columns."""
    kept = near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept.hint("merge"), "doc_id", "left_semi")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
