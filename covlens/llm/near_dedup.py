"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of sub-keys, each of WIDTH minhashes, are computed per
distinct shingle set; table keys are all pairs of one sub-key from either
collection, so the tables are the square of the sub-keys of a collection, at
2 x WIDTH minhashes for each of those. SUBKEYS is their least number; a lower
threshold takes more.
A pair's key can be shared only if both its sub-keys are, so sub-keys met once
are dropped before keys are formed. Sets that share a key are candidates.

Within a bucket, members are compared with one centre (the member that shares
most) and not with each other; candidates are screened by size and by their
signatures (a screen that a pair at the threshold fails with a probability
below 1e-6) and confirmed on the full sets. That finds nearly all links. What
a bucket then still holds of different components is settled exactly by its
rarest shingles: two sets at the threshold share one of the first shingles of
either, as many as may be missing and one more, in any common order. Ordered by
how few of the open sets hold a shingle, most sets' first shingles are their
own alone, and such sets are done. Sets that share one and are of different
components form a group, a group is dealt into blocks of bounded size, and a
task that holds two blocks intersects their sets by an inverted index and
returns only the links that join components. So no pair that shares a key stays
unchecked, no bucket emits its pairs, and no task holds a group.

At the threshold, a pair of sets shares no key with a probability of at most
about MISSED (similarity 0.85: 10 sub-keys, 1.5e-4; 0.8: 14 sub-keys, 0.9e-4);
more similar pairs less.

Defined results: null or empty text, or text without words, has an empty set
and no links; a document without doc_id takes no part in linking (component
null, kept); repeated rows are in one component; rows that share a doc_id but
not their text are linked one by one, each by its own set; equal sets are one
class, so copies are never expanded into pairs; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored
from .components import components
from .words import mix, runs, word_hashes

WIDTH = 3
SUBKEYS = 10
HASHES = 2 * SUBKEYS * WIDTH
#: Probability with which a pair at the threshold may share no key.
MISSED = 1.5e-4
#: Bytes of text handled at once.
CHUNK_BYTES = 1 << 20
#: Sets and shingles of a block, on average.
BLOCK_SETS, BLOCK_SHINGLES = 512, 500_000

_SEEDS_BY_SIZE: dict[int, np.ndarray] = {}


def _seeds(hashes: int) -> np.ndarray:
    """Multipliers and masks of the minhashes; more of them begin with the first HASHES."""
    if hashes not in _SEEDS_BY_SIZE:
        rng = np.random.default_rng(7)
        drawn = [rng.integers(1, 1 << 32, (2, n), dtype=np.uint64) for n in (HASHES, hashes - HASHES)]
        _SEEDS_BY_SIZE[hashes] = np.hstack(drawn).astype(np.uint32) | np.uint32(1)
    return _SEEDS_BY_SIZE[hashes]


def missed(percent: int, subkeys: int) -> float:
    """The probability with which a pair at the threshold shares no table key."""
    none = (1 - (percent / 100) ** WIDTH) ** subkeys  # no sub-key of one collection
    return 1 - (1 - none) ** 2


def subkeys_for(percent: int) -> int:
    """Sub-keys of a collection, so that at most MISSED of the pairs at the threshold share no key."""
    subkeys = SUBKEYS
    while percent > 0 and missed(percent, subkeys) > MISSED:
        subkeys += 1
    return subkeys


def chunks(batch: pa.RecordBatch, size: int = CHUNK_BYTES):
    """Parts of a batch with about ``size`` bytes of text each; null texts as empty."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        done = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, done + size)))
        part = batch.slice(first, end - first)
        yield part, pc.fill_null(part.column("text"), "")
        first = end


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text in ascending order, their number per text)."""
    hashes, counts, _, _ = word_hashes(texts, fold_case=True)
    at = runs(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(hashes)) - np.repeat(at, counts)
    whole = np.minimum(counts, k)  # words of a shingle of this text
    with np.errstate(over="ignore"):
        value = whole[doc].astype(np.uint64)
        padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
        for j in range(k):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.where(j < whole[doc], padded[j:j + len(hashes)], 0).astype(np.uint64))
    starts = nth <= (counts - whole)[doc]
    value, doc = value[starts], doc[starts]
    per = np.bincount(doc, minlength=len(counts))
    parts = [np.unique(x) for x in np.split(value, np.cumsum(per)[:-1])]
    return np.concatenate(parts) if parts else value, np.array([len(p) for p in parts], np.int64)


def set_hash(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ np.uint64(salt)), dtype=np.uint64)])
            out.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
    return out[0], out[1]


def minhashes(shingles: np.ndarray, counts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Set x hashes minhashes of 32 bits; empty sets get zeros."""
    out, seeds = np.zeros((len(counts), hashes), np.uint32), _seeds(hashes)
    full = np.flatnonzero(counts)
    if len(full):
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        at = runs(counts)[full]
        with np.errstate(over="ignore"):
            for h in range(hashes):
                x = (low ^ seeds[1, h]) * seeds[0, h]
                x ^= x >> np.uint32(15)
                out[full, h] = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), at)
    return out


def signatures(docs: DataFrame, k: int, hashes: int) -> DataFrame:
    """Per document: doc_id, th (hash of its text), n (set size), ha and hb (128 bits of the set), sig (its minhashes)."""

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch):
                shingles, counts = shingle_sets(texts, k)
                ha, hb = set_hash(shingles, counts)
                sig = [row.tobytes() for row in minhashes(shingles, counts, hashes)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(counts), pa.array(ha), pa.array(hb), pa.array(sig, pa.binary())],
                    ["doc_id", "th", "n", "ha", "hb", "sig"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sliced(run), "doc_id long, th long, n long, ha long, hb long, sig binary")


def _sig_matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, hashes)


def _subkeys(subkeys: int):
    """Rows (sub, side, cid): the 2 x subkeys sub-keys of each class."""

    def run(batches):
        for batch in batches:
            sig = _sig_matrix(batch.column("sig"), 2 * subkeys * WIDTH).astype(np.uint64).reshape(-1, 2 * subkeys, WIDTH)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(2 * subkeys, dtype=np.uint64), sig.shape[:2])
                for w in range(WIDTH):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, w])
            cid = np.repeat(batch.column("cid").to_numpy(), 2 * subkeys)
            side = np.tile(np.arange(2 * subkeys) // subkeys, len(sig)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(side), pa.array(cid)], ["sub", "side", "cid"])

    return run


def tensored_members(classes: DataFrame, subkeys: int) -> DataFrame:
    """(key, cid, mass): the members of every table bucket with at least two.

    ``mass`` adds up the sizes of a member's buckets: how much it shares.
    """
    subs = stored(classes.select("cid", "sig").mapInArrow(sliced(_subkeys(subkeys)), "sub long, side int, cid long"), "subkeys")
    shared = stored(subs.groupBy("sub").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("sub"), "shared-subkeys")
    lists = subs.join(shared, "sub").groupBy("cid").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("sub"))).alias("left"),
        F.collect_list(F.when(F.col("side") == 1, F.col("sub"))).alias("right"),
    )
    keys = lists.select("cid", F.explode("left").alias("l"), "right").select("cid", "l", F.explode("right").alias("r"))
    keys = stored(keys.select("cid", F.xxhash64("l", "r").alias("key")), "table-keys")
    sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "buckets")
    members = stored(keys.join(sizes, "key"), "members")
    mass = members.groupBy("cid").agg(F.sum("c").alias("mass"))
    return stored(members.select("key", "cid").join(stored(mass, "mass"), "cid"), "members-mass")


def full_sets(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cid, shingles): the full set of each class, from the texts under the doc_id that names it."""

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch):
                shingles, counts = shingle_sets(texts, k)
                ha, hb = set_hash(shingles, counts)
                same = (ha == part.column("ha").to_numpy()) & (hb == part.column("hb").to_numpy())
                sets = np.split(shingles, np.cumsum(counts)[:-1])
                at = np.flatnonzero(same)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid").take(pa.array(at)), pa.array([sets[i].tobytes() for i in at], pa.binary())], ["cid", "shingles"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return texts.join(classes.select("rep", "cid", "ha", "hb"), "rep").mapInArrow(sliced(run), "cid long, shingles binary")


def _least_matches(percent: int) -> int:
    """Equal minhashes that a pair at the threshold has but for a chance below 1e-6 (five deviations)."""
    s, hashes = percent / 100, 2 * subkeys_for(percent) * WIDTH
    return int(hashes * s - 5 * (hashes * s * (1 - s)) ** 0.5)


def screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""
    least, hashes = _least_matches(percent), 2 * subkeys_for(percent) * WIDTH

    def run(batches):
        for batch in batches:
            same = (_sig_matrix(batch.column("sa"), hashes) == _sig_matrix(batch.column("sb"), hashes)).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return joined.filter(fits).select("a", "b", "sa", "sb").mapInArrow(sliced(run), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on the full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(sliced(run), "a long, b long")


def _shingle_rows(batches):
    """(s, cid): every shingle of every set."""
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64)
        n = pc.divide(pc.binary_length(batch.column("shingles")), 8).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(batch.column("cid").to_numpy(), n))], ["s", "cid"])


def rare_lists(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, cid, comp): rare shingles with the sets of different components that have them among their first ones.

    ``rest`` holds members (key, cid, comp) of unfinished buckets. Shingles of one open set alone come first and
    are in no list; of the others, those that fewest open sets hold.
    """
    members = rest.select("cid", "comp").distinct()
    held = stored(members.join(sets, "cid"), "open-sets")
    rows = held.select("cid", "shingles").mapInArrow(sliced(_shingle_rows), "s long, cid long")
    met = stored(rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "met-shingles")
    shared = rows.join(met, "s").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("shared"))
    n = (F.octet_length("shingles") / 8).cast("long")
    alone = n - F.size("shared")
    first = n - F.ceil(n * percent / 100).cast("long") + 1 - alone  # of the shared ones
    lists = held.join(shared, "cid").filter(first > 0).select("cid", "comp", F.explode(F.slice("shared", F.lit(1), first.cast("int"))).alias("f"))
    lists = stored(lists.select(F.col("f.s").alias("key"), "cid", "comp"), "rare-lists")
    spans = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return stored(lists.join(spans, "key"), "open-lists")


def _block_links(percent: int):
    """Of the sets of one or two blocks, the links that join components (a forest of them)."""

    def run(table: pa.Table) -> pa.Table:
        cid, comp, block, n = (table.column(c).to_numpy() for c in ("cid", "comp", "block", "n"))
        values = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(values, kind="stable")
        ranked, holders = values[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sizes = np.diff(np.append(starts, len(ranked)))
        place = np.empty(len(values), np.int64)
        place[order] = np.repeat(np.arange(len(starts)), sizes)
        first, two = runs(n), len(np.unique(block)) > 1
        parent = {c: c for c in comp.tolist()}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for i in range(len(n)):
            at = place[first[i]:first[i] + n[i]]
            at = at[sizes[at] > 1]
            length = sizes[at]
            ends = np.cumsum(length)
            met = holders[np.repeat(starts[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
            common = np.bincount(met, minlength=len(n))
            linked = (100 * common >= percent * (n + n[i] - common)) & (comp != comp[i]) & (~two | (block != block[i]))
            for j in np.flatnonzero(linked[:i]).tolist():
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((int(cid[i]), int(cid[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def group_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among the sets that lists (key, cid, comp) connect."""
    least = stored(rest.groupBy("key").agg(F.min("cid").alias("b")), "bucket-least")
    groups = components(rest.join(least, "key").select(F.col("cid").alias("a"), "b"))
    known = rest.select("cid", "comp").distinct().join(groups.withColumnRenamed("id", "cid"), "cid")
    held = stored(known.withColumnRenamed("component", "group").join(sets, "cid"), "grouped-sets")
    held = held.withColumn("n", (F.octet_length("shingles") / 8).cast("long"))
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = stored(held.groupBy("group").agg(size.alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "blocks")
    dealt = held.join(blocks.filter("lo < hi").drop("lo", "hi"), "group")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cid", "comp", "block", "n", "shingles", "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return dealt.groupBy("group", "i", "j").applyInArrow(_block_links(percent), "a long, b long")


def class_links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component) of the classes that have links."""
    members = tensored_members(classes, subkeys_for(percent))
    involved = stored(members.select("cid").distinct(), "involved")
    known = stored(classes.join(involved, "cid"), "involved-classes")
    sets = stored(full_sets(docs, known, k).dropDuplicates(["cid"]), "sets")
    most = F.max(F.struct("mass", (-F.col("cid")).alias("c")))
    centres = stored(members.groupBy("key").agg(most.alias("m")).select("key", (-F.col("m.c")).alias("centre")), "centres")
    met = members.join(centres, "key").filter("cid <> centre")
    pairs = stored(met.select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).distinct(), "pairs")
    links = stored(confirmed(stored(screened(pairs, known, percent), "screened"), sets, percent), "verified")
    found = stored(components(links), "components")
    rest = members.join(centres, "key").filter("cid <> centre").select("key", "cid")
    rest = rest.join(found.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
    rest = stored(rest, "rest")
    spans = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    rest = stored(rest.join(spans, "key"), "unfinished-members")
    if rest.isEmpty():
        return found
    rest = rare_lists(rest, sets, percent)
    if rest.isEmpty():
        return found
    more = stored(group_links(rest, sets, percent), "group-links")
    return found if more.isEmpty() else stored(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "components")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, th (hash of the text)."""
    rows = stored(signatures(docs, shingle_words, 2 * subkeys_for(percent) * WIDTH), "signatures")
    named = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = named.groupBy("ha", "hb", "n").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = class_links(docs, classes, shingle_words, percent)
    reached = classes.select("ha", "hb", "n", "rep", "cid").join(found.withColumnRenamed("id", "cid"), "cid", "left")
    reached = stored(reached.select("ha", "hb", "n", "rep", "component"), "reached")
    least = reached.filter("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    reached = reached.join(least, "component", "left").select("ha", "hb", "n", F.coalesce("least", "rep").alias("component_id"))
    out = rows.drop("sig").join(reached, ["ha", "hb", "n"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    out = out.withColumn("component_id", own)
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "th")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates (the smallest doc_id), with the columns of docs.

    A row is told by its doc_id and its text's hash, so of rows that share a doc_id each goes by its own text.
    """
    verdicts = near_duplicates(docs, shingle_words, percent)
    dropped = stored(verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).distinct(), "near-dropped")
    same = (docs["doc_id"].cast("long") == dropped["_doc"]) & (F.xxhash64(docs["text"]) == dropped["_th"])
    return docs.join(dropped, same, "left_anti")
