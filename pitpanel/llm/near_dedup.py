"""MinHash near-duplicate groups: one-permutation hashing, optimal densification, banded buckets, star edges.

Documents with equal shingle sets form a class, so copies are one row from then on. Each class gets a signature by
one-permutation hashing; empty bins are filled by optimal densification. In each bucket of a band, members are
linked with one centre only, so there are as many candidate edges as bucket members, not pairs; every edge is
confirmed on the full sets. Where a bucket is not of one component afterwards, its centre leaves it, having met all
others, and a second star has another centre; further ones follow while they empty large buckets. What buckets hold after
that is compared whole, in blocks within tasks, so within a bucket no link between two components is lost. Most buckets are
done after one or two stars; a large one whose members are mostly not near each other costs the square of its size.
A sketch of each set, of 1,024 bits, rules out many edges without the sets: bits that two sketches don't share are a lower bound of the
shingles that the sets don't share. So only sets of likely edges are shuffled.
Components come from minimum labels with pointer jumping, in joins over checkpointed tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, evaluated_once, mix, split_by_ids, text_bytes, tight, unused, window_hashes, word_codes, word_hashes

SHINGLE = 2
#: Bands and rows of a band: a pair at similarity 0.8 misses every bucket with a probability of about (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Star rounds at least before the members that buckets still hold are compared in blocks of about this many rows.
STAR_ROUNDS, BLOCK_ROWS = 2, 1024
#: Shingles of such a block, about: 32 MB of sets.
BLOCK_SHINGLES = 1 << 22
#: Classes with more than one in so many rows, fewer than so many, are broadcast with their labels.
COMMON = 4096
_U64 = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; of fewer words than a shingle has, one for the whole sequence."""
    words = [t.translate(_LOWER).split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    hashed = word_hashes(*word_codes([w for ws in words for w in ws]))
    shingles = window_hashes(hashed, width)
    out, at = [], 0
    for n in lengths:
        if n >= width:
            out.append(np.unique(shingles[at : at + n - width + 1]))
        elif n:
            out.append(window_hashes(hashed[at : at + n], int(n)) + _U64(n))
        else:
            out.append(np.zeros(0, _U64))
        at += n
    return out


def signature(values: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minima over `bins` bins of a set; an empty bin takes the value of the first filled bin in its own
    random sequence of bins, the same for all sets (optimal densification)."""
    hashed = mix(values)
    at = ((hashed >> _U64(32)) * _U64(bins)) >> _U64(32)
    out = np.full(bins, np.iinfo(np.uint64).max, _U64)
    np.minimum.at(out, at.astype(np.int64), hashed << _U64(32) | (values & _U64(0xFFFFFFFF)))
    filled = np.zeros(bins, bool)
    filled[at.astype(np.int64)] = True
    empty = np.flatnonzero(~filled)
    source, first = out.copy(), 0
    while len(empty):
        tried = probes(bins, first)[:, empty]
        found = filled[tried]
        some = found.any(axis=0)
        out[empty[some]] = source[tried[found.argmax(axis=0), np.arange(len(empty))][some]]
        empty, first = empty[~some], first + PROBES
    return out


#: Probes of a bin that are worked out at once.
PROBES = 64


@functools.cache
def probes(bins: int, first: int) -> np.ndarray:
    """The bins that each empty bin looks at in its probes number first + 1 to first + PROBES; they don't depend on the set."""
    attempt = np.arange(first + 1, first + PROBES + 1, dtype=_U64)[:, None]
    return (mix(np.arange(bins, dtype=_U64)[None, :] * _U64(0x9E3779B97F4A7C15) + attempt) % _U64(bins)).astype(np.int64)


def bands_of(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = signature(values, bands * rows).reshape(bands, rows)
    return window_hashes_rows(sig).view(np.int64)


def window_hashes_rows(sig: np.ndarray) -> np.ndarray:
    out = sig[:, 0].copy()
    for k in range(1, sig.shape[1]):
        out = out * _U64(0x9E3779B97F4A7C15) + sig[:, k]
    return mix(out)


SKETCH_WORDS = 16


def sketch_of(values: np.ndarray) -> np.ndarray:
    """A bit set for each shingle."""
    place = mix(values ^ _U64(0xA0761D6478BD642F)) >> _U64(54)
    out = np.zeros(SKETCH_WORDS * 64, np.uint8)
    out[place.astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def _profiler(width: int, bands: int, rows: int) -> Callable:
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out = [text_bytes(t) for t in batch], []
            for a, b in chunks(texts):
                for values in shingle_sets(texts[a:b], width):
                    if len(values):
                        out.append((len(values), *_digest(values), bands_of(values, bands, rows), sketch_of(values)))
                    else:
                        out.append((0, 0, 0, None, None))
            yield pd.DataFrame(out, columns=["n", "low", "high", "bands", "sketch"])

    return profile


def _digest(values: np.ndarray) -> tuple[int, int]:
    sums = np.array([values.sum(dtype=_U64), mix(values ^ _U64(0x5851F42D4C957F2D)).sum(dtype=_U64)])
    low, high = mix(sums).view(np.int64)
    return int(low), int(high)


def _set_maker(width: int) -> Callable:
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, lows, out = [text_bytes(t) for t in batch], [], []
            for a, b in chunks(texts):
                for values in shingle_sets(texts[a:b], width):
                    lows.append(_digest(values)[0] if len(values) else 0)
                    out.append(values.view(np.int64))
            yield pd.DataFrame({"low": lows, "set": out})

    return sets


def _low_maker(width: int) -> Callable:
    def lows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out = [text_bytes(t) for t in batch], []
            for a, b in chunks(texts):
                out += [_digest(values)[0] if len(values) else 0 for values in shingle_sets(texts[a:b], width)]
            yield pd.Series(out, dtype=np.int64)

    return lows


def _confirmed(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label, the smallest node reachable, for all nodes of the edges (a, b); a table of scratch."""
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    labels = scratch.table(labels)
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("old")
        )
        # the label's own label may be smaller already
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = scratch.table(
            step.join(further, "label", "left").select("node", F.least("label", "next").alias("label"), "old")
        )
        labels = moved.select("node", "label")
        if not moved.filter("label < old").limit(1).count():
            return labels


def relabelled(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, label) after joining the components whose labels the edges (a, b) connect."""
    to = components(edges, scratch).toDF("label", "new")
    return scratch.table(labels.join(to, "label", "left").select("node", F.coalesce("new", "label").alias("label")))


def near_groups(
    docs: DataFrame, percent: int = 80, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (doc_id = component_id) of every row.

    Documents whose sets have 100 * intersection >= percent * union are linked. Without words (null or empty texts) a
    set is empty and its document is linked with nothing. Rows with a null doc_id are linked with nothing, get a null
    component_id and are kept; rows that repeat a doc_id belong together. An empty table stays empty; other columns, whatever
    their names, are ignored. A very long text is one set in a task's memory, of 8 bytes for each distinct shingle.
    """
    with Scratch(docs.sparkSession) as scratch:
        profiled, classes, labels = _near_labels(docs, percent, width, bands, rows, scratch)
        with_words = profiled.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
        # One doc_id may come with several texts: the components of its classes belong together.
        twice = scratch.table(with_words.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"))
        if twice.limit(1).count():
            own = with_words.join(twice, "doc_id").select("doc_id", "low", "high").distinct()
            own = own.join(classes.select("low", "high", "node"), ["low", "high"]).join(labels, "node")
            own = scratch.table(own.select("doc_id", "label").distinct())
            heads = own.groupBy("doc_id").agg(F.min("label").alias("b"))
            same = scratch.table(own.join(heads, "doc_id").filter("label <> b").select(F.col("label").alias("a"), "b").distinct())
            if same.limit(1).count():
                labels = relabelled(labels, same, scratch)
        done = scratch.table(classes.join(labels, "node").select("low", "high", "copies", F.col("label.id").alias("label")))
        total = done.agg(F.sum("copies").alias("n")).first()["n"] or 0
        scratch.keep(profiled, done)
    # Rows that are linked with nothing meet no label, and those of common classes a broadcast one; so no key of the join has many rows.
    is_common = F.col("copies") * COMMON > total
    common = done.filter(is_common).select("low", "high", "label", F.lit(True).alias("is_common"))
    single = (F.col("n") == 0) | F.col("doc_id").isNull()
    marked = profiled.join(F.broadcast(common), ["low", "high"], "left")
    settled = marked.filter(single | F.col("is_common").isNotNull()).select("doc_id", "n", F.when(single, F.col("doc_id")).otherwise(F.col("label")).alias("component_id"))
    rest = marked.filter(~single & F.col("is_common").isNull()).select("doc_id", "n", "low", "high").join(done.filter(~is_common), ["low", "high"])
    return settled.union(rest.select("doc_id", "n", F.col("label").alias("component_id"))).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _near_labels(
    docs: DataFrame, percent: int, width: int, bands: int, rows: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows, classes of equal sets, and the label of each class: the smallest node among the near ones.

    A class's node is its smallest doc_id with its digest, as one doc_id may come with several texts. Links between the
    classes of one doc_id aren't in the labels.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = evaluated_once(_profiler(width, bands, rows), "n long, low long, high long, bands array<long>, sketch array<long>", F.col("text"))
    profiles = scratch.table(texts.select("doc_id", profile.alias("p")).select("doc_id", "p.*"))
    profiled = profiles.select("doc_id", "n", "low", "high")
    with_words = profiles.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.table(
        with_words.groupBy("low", "high").agg(
            F.min("doc_id").alias("id"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("n", "bands", "sketch")]
        ).select("low", "high", "copies", F.struct("id", "low").alias("node"), "n", "bands", "sketch")
    )
    banded = classes.select("node", "n", F.posexplode("bands").alias("band", "hash"))
    shared = scratch.table(banded.groupBy("band", "hash").agg(F.count("*").alias("size")).filter("size > 1").select("band", "hash"))
    # Most buckets have one member, so few rows are left to be shuffled.
    bucket = F.xxhash64("band", "hash")
    likely, _ = split_by_ids(banded, bucket, shared.select(bucket.alias("bucket")), shared.count())
    members = scratch.table(likely.join(shared, ["band", "hash"]))
    profiled = scratch.table(profiled)
    sketches = scratch.table(members.select("node").distinct().join(classes.select("node", "sketch"), "node"))
    wanted = sketches.select("node.id", "node.low")
    sets_of = evaluated_once(_set_maker(width), "low long, set array<long>", F.col("text"))
    # Most documents share no bucket: their texts are neither shuffled nor made into sets. A few sets too many do no harm, but
    # where the ids are too many for a tight bitmap the exact join drops the rest.
    count = wanted.count()
    texts, _ = split_by_ids(texts, F.col("doc_id"), wanted.select("id"), count)
    sets = texts.select(F.col("doc_id").alias("id"), sets_of.alias("p")).select("id", "p.low", "p.set").filter("size(set) > 0")
    if not tight(count):
        sets = sets.join(wanted, ["id", "low"], "left_semi")
    sets = sets.select(F.struct("id", "low").alias("node"), "set")
    # rows may repeat both doc_id and text
    if with_words.groupBy("doc_id", "low").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])
    labels = classes.select("node", F.col("node").alias("label"))
    sets = scratch.table(sets)
    number, large = 0, None
    while True:
        live = _live(members, labels, number, scratch)
        # after the first rounds stars go on while they empty buckets too large for a task's block
        before, large = large, live.filter(F.col("size") > BLOCK_ROWS).count()
        if number >= STAR_ROUNDS and (not large or large > 0.9 * (before or 0)) or not live.limit(1).count():
            break
        number += 1
        edges = _star_edges(live, percent).join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
        edges = scratch.table(edges.filter(_may_be_near(percent)).select("a", "b", "label_a", "label_b"))
        ends = edges.select("a.id").union(edges.select("b.id"))
        needed, _ = split_by_ids(sets, F.col("node.id"), ends, 2 * edges.count())
        found = (
            edges.join(needed.toDF("a", "set_a"), "a")
            .join(needed.toDF("b", "set_b"), "b")
            .filter(_confirmed(F.col("set_a"), F.col("set_b"), percent))
        )
        found = scratch.table(found.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
        if found.limit(1).count():
            labels = relabelled(labels, found, scratch)
        # centres have met all others of their bucket
        members = live.filter("not centre").select("band", "hash", "node", "n")
    found = _named(scratch.table(_rest(live, sets, percent)))
    if found.limit(1).count():
        labels = relabelled(labels, found, scratch)
    return profiled, classes, labels


def _live(members: DataFrame, labels: DataFrame, number: int, scratch: Scratch) -> DataFrame:
    """Members of buckets that aren't of one component yet: their label, whether they are the centre of this round (the
    first in its random order), and the number of members of their bucket."""
    labelled = scratch.table(members.join(labels, "node").withColumn("order", F.xxhash64("node", F.lit(number))))
    open_ = scratch.table(
        labelled.groupBy("band", "hash")
        .agg(F.count("*").alias("size"), F.min("order").alias("first"), F.min("label").alias("x"), F.max("label").alias("y"))
        .filter("x < y")
        .select("band", "hash", "size", "first")
    )
    centre = F.col("order") == F.col("first")
    return scratch.table(
        labelled.join(open_, ["band", "hash"]).select("band", "hash", "node", "n", "label", "size", centre.alias("centre"))
    )


def _rest(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between labels from all pairs of members that a bucket still holds, and how many pairs were compared.

    A bucket is cut into blocks, of BLOCK_ROWS rows up to 64 blocks and of up to 16 times as many beyond, so that a set is copied
    64 times in a bucket of a million members; a bucket of long sets is cut into as many blocks as hold BLOCK_SHINGLES each. A task
    compares two blocks tile by tile, by products of their incidence matrices, and gives out the linked labels only, so no pairs
    are written and no task gets more than two blocks.
    """
    rows = F.greatest(F.lit(BLOCK_ROWS), F.least(F.lit(16 * BLOCK_ROWS), F.ceil(F.col("size") / 64)))
    blocks = F.greatest(F.ceil(F.col("size") / rows), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(-1)), blocks).cast("int")
    shingles = live.groupBy("band", "hash").agg(F.sum("n").alias("shingles"))
    placed = live.join(shingles, ["band", "hash"]).join(sets, "node").select("band", "hash", "label", "set", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    keyed = placed.select("band", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label.id", "label.low", "set")
    return keyed.groupBy("band", "hash", "i", "j").applyInPandas(_linker(percent), "a long, a_low long, b long, b_low long, pairs long")


def _named(linked: DataFrame) -> DataFrame:
    name = lambda id_, low: F.struct(F.col(id_).alias("id"), F.col(low).alias("low"))
    return linked.filter("pairs is null").select(name("a", "a_low").alias("a"), name("b", "b_low").alias("b")).distinct()


def _linker(percent: int) -> Callable:
    def links(frame: pd.DataFrame) -> pd.DataFrame:
        own, sets = frame["own"].to_numpy(), frame["set"].to_list()
        names, labels = np.unique(frame[["id", "low"]].to_numpy(np.int64), axis=0, return_inverse=True)
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        ours, theirs = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found, compared = [np.zeros((2, 0), np.int64)], 0
        for s in range(0, len(ours), BLOCK_ROWS):
            for t in range(s if i == j else 0, len(theirs), BLOCK_ROWS):
                x, y = ours[s : s + BLOCK_ROWS], theirs[t : t + BLOCK_ROWS]
                apart = labels[x][:, None] != labels[y][None, :]
                if not apart.any():
                    continue
                compared += int(apart.sum()) // (2 if i == j and s == t else 1)
                a, b = np.nonzero(_similar([sets[k] for k in x], [sets[k] for k in y], percent) & apart)
                found.append(np.unique(np.sort(np.stack([labels[x[a]], labels[y[b]]]), axis=0), axis=1))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        # the last row has the number of compared pairs instead of a link
        columns = {"a": names[a, 0], "a_low": names[a, 1], "b": names[b, 0], "b_low": names[b, 1]}
        out = {c: pd.array([*v.tolist(), None], dtype="Int64") for c, v in columns.items()}
        return pd.DataFrame(out | {"pairs": pd.array([None] * len(a) + [compared], dtype="Int64")})

    return links


def _similar(ours: list[np.ndarray], theirs: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of our sets (rows) are near which of theirs (columns)."""
    parts = [(np.repeat(np.arange(len(x)), sizes), np.concatenate(x), sizes) for x in (ours, theirs) for sizes in [np.fromiter(map(len, x), np.int64, len(x))]]
    (row, value, n), (column, other, m) = parts
    shared = np.intersect1d(value, other)
    both = np.zeros((len(n), len(m)), np.float32)
    (row, value), (column, other) = ((r[use], np.searchsorted(shared, v[use])) for r, v in ((row, value), (column, other)) for use in [np.isin(v, shared)])
    for start in range(0, len(shared), 4096):
        left, right = np.zeros((len(n), 4096), np.float32), np.zeros((len(m), 4096), np.float32)
        use = (value >= start) & (value < start + 4096)
        left[row[use], value[use] - start] = 1
        use = (other >= start) & (other < start + 4096)
        right[column[use], other[use] - start] = 1
        both += left @ right.T
    same = both.astype(np.int64)
    return same * 100 >= (n[:, None] + m[None, :] - same) * percent


def _star_edges(live: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from the members of each bucket to its centres b, as far as they aren't connected yet."""
    centres = live.filter("centre").select(
        "band", "hash", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b")
    )
    return (
        live.join(centres, ["band", "hash"])
        .filter("label <> label_b and (not centre or node < b)")
        .filter(f"least(n, n_b) * 100 >= greatest(n, n_b) * {percent}")
        .select(F.col("node").alias("a"), "b", F.col("label").alias("label_a"), "label_b", "n", "n_b")
        .distinct()
    )


def _may_be_near(percent: int) -> Column:
    """Whether edges with sketch_a, sketch_b and the set sizes n, n_b can be links: sets that differ in d shingles are near only if d * (100 +
    percent) <= (n + n_b) * (100 - percent), and d is at least the number of bits that the sketches differ in."""
    bits = F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda total, k: total + k)
    return apart * (100 + percent) <= (F.col("n") + F.col("n_b")) * (100 - percent)


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of docs that stand for their group of near texts, with the columns of docs, whatever their names.

    Of rows that repeat both doc_id and text one stays; different texts of one doc_id aren't copies of each other and
    stand for groups of their own. Texts without words and rows with a null doc_id all stay, but for repeated rows of a
    doc_id; of tied copies the smallest doc_id stays; an empty table stays empty. Only rows that may go are shuffled.
    """
    with Scratch(docs.sparkSession) as scratch:
        profiled, classes, labels = _near_labels(docs, percent, width, BANDS, ROWS, scratch)
        heads = classes.join(labels, "node").filter("node = label").select("node.id", "node.low")
        known = profiled.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "low", "n")
        stays = scratch.table(heads.union(known.filter("n = 0").select("id", "low")).distinct())
        several = scratch.table(known.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"))
        gone = known.select("id", "low").join(stays, ["id", "low"], "left_anti").select("id")
        judged = scratch.table(gone.union(several).distinct().toDF("judged_id"))
        again = several.limit(1).count() > 0
        scratch.keep(judged, *([stays, several] if again else []))
    own = F.col("doc_id").cast("long")
    doubtful, sure = split_by_ids(docs, own, judged, judged.count())
    # Renamed, so that no column of docs clashes with those of the tables.
    cid, clow = (unused(x, docs.columns) for x in ("own_id", "own_low"))
    out = sure.union(doubtful.join(judged.toDF(cid), own == F.col(cid), "left_anti"))
    if again:
        low = evaluated_once(_low_maker(width), "long", F.col("text").cast("string"))
        rows = doubtful.join(several.toDF(cid), own == F.col(cid), "left_semi").withColumns({cid: own, clow: low})
        out = out.union(rows.join(stays.toDF(cid, clow), [cid, clow], "left_semi").dropDuplicates([cid, clow]).select(*docs.columns))
    return out
