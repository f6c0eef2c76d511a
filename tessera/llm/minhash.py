"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A shingle is five consecutive words (a text of fewer words is one shingle); its weight is its count in the text times its inverse document
frequency, 1 + log10(texts / texts that hold it), with the exact frequency of every shingle. Texts are written in bundles of about BUNDLE words.
A bundle sends its distinct shingles, each with the number of texts that hold it, in sorted slices to the parts of the hashes' range; a part sums
them and sends the frequencies back in the same order, so that they are read beside the bundle's shingles and no table of shingles is ever held
or broadcast as a whole. A text's frequencies go with its words from there on. Consistent weighted sampling draws, for each of the sketch's
entries, the shingle (and a level of its weight) that two texts share with a chance equal to their weighted Jaccard similarity. Entries are
joined to bands; texts with an equal band are candidates.

Texts of equal words form one class at once and only the smallest id goes on. Large bands are not expanded into all pairs. Members are
range-sorted by band, those first that share bands with most others; a partition may cut through a band, and within it each run of CHUNK
members is compared with its first, and that one with the first of the run before. Links join classes. In bands that still hold several
classes, all members outside of the band's largest class are compared with all members, block by block, each pair in the first band that it
shares. So every link between candidates of different classes is found, no group is expanded into rows of pairs, and no task gets a band.

Words are written once in bundles and move three times: by id to their table, which is dealt by id so that later joins leave it in place, and once
for each candidate pair or block. Ids are whole numbers. Defined results: a text without words (null, empty) is its own class; repeated rows of an id are in one class,
each with a row; of an id with several texts one is compared (that with the smallest MD5), and copies of all of them join its class; rows
without an id are left out; ties go to the smallest id; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_rows, blocks, bucketed, long_id, materialise, scratch, settle, tune
from .components import components
from .words import binary_slices, read_words
from .wordscan import Words, gram_hashes, inside, mix64

SHINGLE = 5
THRESHOLD = 0.8
#: Bands and entries in a band: at a similarity of 0.8 a pair shares a band with a chance of 0.998.
BANDS, ROWS = 12, 4
#: Words of texts that are counted and sketched together.
BUNDLE = 1 << 20
#: Shingles of bundles that one part of the hashes' range counts, and the least bits of a part's number.
PART, PART_BITS = 1 << 21, 9
#: Members of a band that are compared with one of them.
CHUNK = 512
#: Weight of a block of members; a text weighs 1 and one more for each 1,024 words.
BLOCK = 256
#: Tasks over which a key that many rows share is dealt in joins.
SALTS = 32
#: Pairs whose sketches agree in less than this part of their entries are not compared in blocks: at a similarity of 0.8 one of 2,000 does.
AGREE = 0.6

def _shingle_places(w: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of some texts: hashes (uint64) and the text of each, ascending."""
    n = np.diff(first)
    wide = mix64(w.astype(np.uint64) + np.uint64(1))
    h, ok = gram_hashes(wide, k), inside(first, k, len(w))
    at = np.flatnonzero(ok)
    hashes, doc = [h[at]], [np.searchsorted(first, at, side="right") - 1]
    for d in np.flatnonzero((n > 0) & (n < k)).tolist():
        a, b = int(first[d]), int(first[d + 1])
        hashes.append(gram_hashes(wide[a:b], b - a))
        doc.append(np.array([d]))
    hashes, doc = np.concatenate(hashes), np.concatenate(doc)
    if len(doc) > len(at):
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    return hashes, doc


def _by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ascending hashes, and in that order whether a hash is the first of its kind."""
    order = np.argsort(hashes)
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return order, new


def text_counts(w: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of some texts together, ascending (uint64), and the number of these texts that hold each (uint32)."""
    hashes, doc = _shingle_places(w, first, k)
    order, new = _by_hash(hashes)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(hashes))).astype(np.uint32)
    # shingles that stand at several places: a text counts once
    many = np.flatnonzero(n > 1)
    if len(many):
        which = np.repeat(np.arange(len(many)), n[many])
        pairs = which * len(first) + doc[order[np.repeat(n > 1, n)]]
        pairs.sort()
        once = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
        n[many] = np.bincount(once // len(first), minlength=len(many))
    return hashes[order[at]], n


def text_frequencies(w: np.ndarray, first: np.ndarray, df: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each of some texts, in order of text and hash: hashes (uint64), counts in the text, document frequencies (uint32), and
    where each text's begin. df: frequencies of the distinct shingles of these texts together, as text_counts() orders them."""
    hashes, doc = _shingle_places(w, first, k)
    order, new = _by_hash(hashes)
    if int(new.sum()) != len(df):
        raise ValueError(f"{len(df)} frequencies for {int(new.sum())} shingles")
    hashes, doc, df = hashes[order], doc[order], df[np.cumsum(new) - 1]
    order = np.argsort(doc.astype(np.uint16) if len(first) <= 1 << 16 else doc, kind="stable")
    hashes, doc, df = hashes[order], doc[order], df[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), df[at], np.searchsorted(doc[at], np.arange(len(first)))


def weights_of(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF weights (float32) of shingles that df of n texts hold."""
    return (tf * (1 + np.log10(n / df.astype(np.float64)))).astype(np.float32)


def _block_words(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    w = Words(block.column("_text"))
    return w.hash.astype(np.uint32), w.first


def text_bundles(rows: DataFrame, size: int = BUNDLE) -> DataFrame:
    """For rows (id, _text) one row each: bundle, id, text_key (MD5 of the words, null if there are none), n_words, words (binary, uint32), and fresh: it
    has words, and its task did not give the same id and words before. A bundle is of one task and ends at `size` words or a text beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        bundle, held = TaskContext.get().partitionId() << 32, 0
        seen: set[tuple[int, bytes]] = set()
        for block in blocks(batches, "_text"):
            w, first = _block_words(block)
            raw, at = memoryview(w.tobytes()), (first * 4).tolist()
            keys = [hashlib.md5(raw[a:b]).digest() if b > a else None for a, b in zip(at, at[1:], strict=False)]
            fresh = []
            for pair in zip(block.column("id").to_pylist(), keys, strict=True):
                fresh.append(pair[1] is not None and pair not in seen)
                if fresh[-1]:
                    seen.add(pair)
            if held and held + len(w) > size:
                bundle, held = bundle + 1, 0
            held += len(w)
            cols = [pa.array(np.full(len(keys), bundle)), block.column("id"), pa.array(keys, pa.binary()), pa.array(np.diff(first)), binary_slices(w, first), pa.array(fresh, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["bundle", "id", "text_key", "n_words", "words", "fresh"])

    return rows.mapInArrow(run, "bundle bigint, id bigint, text_key binary, n_words bigint, words binary, fresh boolean")


def _binaries(group: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column, and the number of each row's."""
    data = [np.frombuffer(x.as_buffer(), kind) for x in group.column(column)]
    return np.concatenate(data) if data else np.zeros(0, kind), np.array([len(x) for x in data], np.int64)


def document_frequencies(bundles: DataFrame, bits: int = PART_BITS) -> DataFrame:
    """bundle, part, df (binary, uint32): in how many texts of all bundles (bundle, words) each shingle of this bundle stands; parts in order, and the
    shingles of a part in order, are those of text_counts()."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(64 - bits)

    def deal(group: pa.Table) -> pa.Table:
        settle()
        h, n = text_counts(*_group_words(group))
        cuts = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]]).astype(np.int64)
        some = np.flatnonzero(np.diff(cuts))
        first = np.append(cuts[some], len(h))
        bundle = pa.array(np.full(len(some), group.column("bundle")[0].as_py()))
        return pa.table([bundle, pa.array(some.astype(np.int32)), binary_slices(h, first), binary_slices(n, first)], ["bundle", "part", "shingles", "n"])

    def count(group: pa.Table) -> pa.Table:
        h, sizes = _binaries(group, "shingles", np.uint64)
        n, _ = _binaries(group, "n", np.uint32)
        order, new = _by_hash(h)
        at = np.flatnonzero(new)
        df = np.empty(len(h), np.uint32)
        df[order] = np.repeat(np.add.reduceat(n[order], at), np.diff(np.append(at, len(h))))
        return pa.table([group.column("bundle"), group.column("part"), binary_slices(df, np.concatenate([[0], np.cumsum(sizes)]))], ["bundle", "part", "df"])

    dealt = bundles.select("bundle", "words").groupBy("bundle").applyInArrow(deal, "bundle bigint, part int, shingles binary, n binary")
    return dealt.groupBy("part").applyInArrow(count, "bundle bigint, part int, df binary")


def _group_words(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return read_words(group.column("words").combine_chunks())


def _gamma2_quantiles(bits: int) -> np.ndarray:
    """The middle quantiles of a Gamma(2, 1) variable in 2^bits equal parts."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    lo, hi = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(60):
        x = (lo + hi) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        lo, hi = np.where(under, x, lo), np.where(under, hi, x)
    return (lo + hi) / 2


_tables: list[np.ndarray] = []


def sketch(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray, entries: int) -> np.ndarray:
    """Improved consistent weighted sampling: uint64 samples, one row for each text and one column for each entry. Texts without
    shingles get 0. For a shingle of weight w with draws r, c ~ Gamma(2, 1) and b ~ U(0, 1): t = floor(ln w / r + b), and the sample is the
    (shingle, t) of the smallest ln c - r (t - b) - r."""
    if not _tables:
        r = _gamma2_quantiles(14)
        _tables[:] = [r.astype(np.float32), (1 / r).astype(np.float32), np.log(_gamma2_quantiles(16)).astype(np.float32)]
    r_of, inverse, ln_c = _tables
    n = np.diff(first)
    full = np.flatnonzero(n > 0)
    out = np.zeros((len(n), entries), np.uint64)
    if not len(full):
        return out
    # in runs of texts that fit the processor's cache
    cuts = [0]
    while cuts[-1] < len(full):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first[full], first[full[cuts[-1]]] + 16384))))
    for a, b in zip(cuts, cuts[1:], strict=False):
        which = full[a:b]
        lo, hi = int(first[which[0]]), int(first[which[-1] + 1])
        h, ln_w = hashes[lo:hi], np.log(weights[lo:hi])
        starts, sizes = first[which] - lo, n[which]
        for e in range(entries):
            x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * e + 1)) & 0xFFFFFFFFFFFFFFFF)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            at = (x >> np.uint64(50)).astype(np.int32)
            beta = ((x >> np.uint64(10)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(ln_w * inverse[at] + beta)
            rank = ln_c[((x >> np.uint64(34)) & np.uint64(0xFFFF)).astype(np.int32)] - r_of[at] * (t - beta + 1)
            least = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            hit = hit[np.searchsorted(hit, starts)]
            out[which, e] = mix64(h[hit] + t[hit].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def band_keys(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """uint64 keys of the bands of sketches (uint32), with the band's number in them."""
    wide = samples.astype(np.uint64)
    key = wide[:, ::rows] + (np.arange(wide.shape[1] // rows, dtype=np.uint64) << np.uint64(32))
    for j in range(1, rows):
        key = mix64(key * np.uint64(31) + wide[:, j::rows])
    return key


def sketches(bundles: DataFrame, frequencies: DataFrame, n_texts: int, entries: int = BANDS * ROWS) -> DataFrame:
    """id, text_key, n_words, sketch and df (binary, uint32; of its distinct shingles in order of their hashes) for the fresh rows of bundles."""

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        settle()
        df, _ = _binaries(found.sort_by("part"), "df", np.uint32)
        h, tf, df, at = text_frequencies(*_group_words(group), df)
        fresh = np.flatnonzero(group.column("fresh").to_numpy())
        samples = sketch(h, weights_of(tf, df, n_texts), at, entries)[fresh].astype(np.uint32)
        rows = group.select(["id", "text_key", "n_words"]).take(pa.array(fresh))
        data = binary_slices(samples.ravel(), np.arange(len(fresh) + 1) * entries)
        return rows.append_column("sketch", data).append_column("df", binary_slices(df, at).take(pa.array(fresh)))

    both = bundles.select("bundle", "id", "text_key", "n_words", "words", "fresh").groupBy("bundle").cogroup(frequencies.groupBy("bundle"))
    return both.applyInArrow(run, "id bigint, text_key binary, n_words bigint, sketch binary, df binary")


def band_members(nodes: DataFrame) -> DataFrame:
    """key, id, n for texts (id, sketch) that share a band; n: about how many do. A few others come along where a batch or partition ends."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, _ = read_words(batch.column("sketch"))
            key = band_keys(w.reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), key.shape[1]))], ["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cut = np.flatnonzero(np.diff(key)) + 1
            sizes = np.diff(np.concatenate([[0], cut, [len(key)]]))
            n = np.repeat(sizes, sizes)
            keep = n > 1
            keep[0] = keep[-1] = True
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), batch.column("id").filter(pa.array(keep)), pa.array(n[keep])], ["key", "id", "n"])

    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once, as sorting by ranges reads its input twice
    rows = materialise(nodes.select("id", "sketch").mapInArrow(keys, "key bigint, id bigint"), "bands")
    with batch_rows(spark, 65_536):
        return materialise(rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").mapInArrow(run, "key bigint, id bigint, n bigint"), "members")


def star_pairs(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) that tie the members of each band: b comes first among chunk members, in order of how many texts they share bands with."""
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hubs = members.groupBy("id").agg(F.sum("n").alias("hub"))
    rows = materialise(members.select("key", "id").join(hubs.hint("merge"), "id").select("key", (-F.col("hub")).alias("order"), "id"), "ordered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        begun, at_key, seen, lead = False, 0, 0, 0

        def out(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(key), pa.array(a), pa.array(b)], ["kind", "part", "key", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            if not begun:
                begun = True
                at_key = int(key[0])
                yield out(1, key[:1], ids[:1], ids[:1])
            index = np.arange(len(key))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = int(key[0]) != at_key
            start = np.maximum.accumulate(np.where(new, index, -1))
            place = np.where(start < 0, index + seen, index - start)  # in the band
            leads = place % chunk == 0
            lead_at = np.maximum.accumulate(np.where(leads, index, -1))
            of = np.where(lead_at < 0, lead, ids[lead_at])
            # a lead is tied to the one before it in its band
            before = np.where(index > 0, of[index - 1], lead)
            b = np.where(leads, np.where(place > 0, before, ids), of)
            tied = b != ids
            yield out(0, key[tied], ids[tied], b[tied])
            at_key, seen, lead = int(key[-1]), int(place[-1]) + 1, int(of[-1])
        if begun:
            last = np.array([lead])
            yield out(2, np.array([at_key]), last, last)

    with batch_rows(spark, 65_536):
        order = ("key", "order", "id")
        ties = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "id").mapInArrow(run, "kind int, part int, key bigint, a bigint, b bigint"), "ties")
    # bands that go on in the next partition: two rows a partition
    ends = ties.where("kind > 0").groupBy("part").agg(*(F.max(F.when(F.col("kind") == kind, F.struct("key", "a"))).alias(name) for kind, name in ((1, "head"), (2, "tail"))))
    met = ends.select("head", F.lag("tail").over(Window.orderBy("part")).alias("tail")).where("head.key = tail.key").select(F.col("head.a").alias("a"), F.col("tail.a").alias("b"))
    return ties.where("kind = 0").select("a", "b").unionByName(met).where("a <> b").distinct()


def _similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    (h, w), (g, v) = one, other
    at = np.searchsorted(h, g)
    at[at == len(h)] = 0
    same = h[at] == g if len(h) else np.zeros(len(g), bool)
    low = float(np.minimum(w[at[same]], v[same]).sum(dtype=np.float64))
    total = float(w.sum(dtype=np.float64) + v.sum(dtype=np.float64)) - low
    return low / total if total > 0 else 0.0


class _Shingles:
    """The weighted shingles of texts, made when they are asked for; about `most` are held."""

    def __init__(self, n_texts: int, most: int = 4_000_000) -> None:
        self.n_texts, self.most, self.held = n_texts, most, 0
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, i: int, words: pa.BinaryScalar, df: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
        found = self.known.get(i)
        if found is None:
            if self.held > self.most:
                self.known.clear()
                self.held = 0
            w = np.frombuffer(words.as_buffer(), np.uint32)
            h, tf, df, _ = text_frequencies(w, np.array([0, len(w)]), np.frombuffer(df.as_buffer(), np.uint32))
            found = self.known[i] = h, weights_of(tf, df, self.n_texts)
            self.held += len(h)
        return found


_LINKS = "a bigint, b bigint, similarity double"


def _links(rows: list[tuple[int, int, float]]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())]


def verify(pairs: DataFrame, words: DataFrame, n_texts: int, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches threshold, with it. words: id, words, df, dealt by id."""
    of = lambda x: words.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words"), F.col("df").alias(f"{x}_df"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_words", "a_df", "b_words", "b_df")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known = _Shingles(n_texts)
        for batch in batches:
            found = []
            ids = (batch.column(x).to_pylist() for x in ("a", "b"))
            for a, b, x, p, y, q in zip(*ids, *(batch.column(x) for x in ("a_words", "a_df", "b_words", "b_df")), strict=True):
                s = _similarity(known.get(a, x, p), known.get(b, y, q))
                if s >= threshold:
                    found.append((min(a, b), max(a, b), s))
            yield pa.RecordBatch.from_arrays(_links(found), ["a", "b", "similarity"])

    return both.mapInArrow(run, _LINKS)


def split_bands(members: DataFrame, roots: DataFrame, weights: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Members (key, id, root) with their classes, and the bands that hold several: key, main (the largest class), n_all and n_rest: blocks that all
    members and those of other classes are dealt into. weights: id, weight."""
    placed = members.select("key", "id").distinct().join(roots, "id", "left").join(weights, "id").select("key", "id", F.coalesce("root", "id").alias("root"), "weight")
    placed = materialise(placed, "placed")
    per = placed.groupBy("key", "root").agg(F.sum("weight").alias("weight"))
    found = per.groupBy("key").agg(F.count("*").alias("classes"), F.sum("weight").alias("all"), F.max(F.struct("weight", (-F.col("root")).alias("root"))).alias("main")).where("classes > 1")
    blocks_of = lambda x: F.ceil(x / F.lit(block)).cast("int")
    return placed, found.select("key", (-F.col("main.root")).alias("main"), blocks_of(F.col("all")).alias("n_all"), blocks_of(F.col("all") - F.col("main.weight")).alias("n_rest"))


def block_links(placed: DataFrame, split: DataFrame, words: DataFrame, n_texts: int, threshold: float = THRESHOLD) -> DataFrame:
    """Links that join classes, between members outside of a band's largest class and all members. Task (i, j) of a band compares block i of the former with
    block j of all, and gives no more links than it has members. words: id, words, df, sketch, dealt by id."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    dealt = split.select("*", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    here = placed.withColumn("salt", salt).join(dealt.hint("merge"), ["key", "salt"])
    at = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rest = here.where("root <> main").select("key", "id", "root", at(F.col("n_rest")).alias("i"), to(F.col("n_all")).alias("j"), F.lit(True).alias("rest"))
    every = here.select("key", "id", "root", to(F.col("n_rest")).alias("i"), at(F.col("n_all")).alias("j"), F.lit(False).alias("rest"))
    rows = rest.unionByName(every).join(words.select("id", "words", "df", "sketch"), "id")
    return rows.groupBy("key", "i", "j").applyInArrow(_block_task(n_texts, threshold), _LINKS)


def _block_task(n_texts: int, threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, root, rest = (group.column(c).to_numpy() for c in ("id", "root", "rest"))
        samples = read_words(group.column("sketch").chunk(0))[0].reshape(len(ids), -1)
        links = _forest(group.column("key")[0].as_py(), ids, root, rest, samples, group.column("words").chunk(0), group.column("df").chunk(0), n_texts, threshold)
        return pa.table(_links(links), names=["a", "b", "similarity"])

    return run


def _forest(band: int, ids: np.ndarray, root: np.ndarray, rest: np.ndarray, samples: np.ndarray, words: pa.Array, df: pa.Array, n_texts: int, threshold: float) -> list[tuple[int, int, float]]:
    """The links among `rest` and the other rows that join different classes, as a forest. A pair is looked at in the first band that it shares."""
    keys = band_keys(samples)
    number = int(np.flatnonzero(keys[0].view(np.int64) == band)[0])
    one, other = np.flatnonzero(rest), np.flatnonzero(~rest)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for x in one.tolist():
        agree = (samples[other] == samples[x]).mean(axis=1)
        ok = (agree >= AGREE) & (root[other] != root[x]) & ~(keys[other, :number] == keys[x, :number]).any(axis=1)
        pairs.append((np.full(int(ok.sum()), x), other[ok], agree[ok]))
    if not pairs:
        return []
    a, b, agree = (np.concatenate(p) for p in zip(*pairs, strict=True))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    known, out = _Shingles(n_texts), []
    for k in np.argsort(-agree, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        p, q = find(int(root[x])), find(int(root[y]))
        if p == q:
            continue
        s = _similarity(known.get(int(ids[x]), words[x], df[x]), known.get(int(ids[y]), words[y], df[y]))
        if s >= threshold:
            parent[max(p, q)] = min(p, q)
            out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y])), s))
    return out


def candidate_links(nodes: DataFrame, texts: DataFrame, n_texts: int, threshold: float = THRESHOLD, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Links (a, b, similarity) that give the same classes as all candidate pairs of nodes (id, n_words, sketch, df) that reach threshold would. texts: id,
    text_key, words."""
    members = band_members(nodes)
    needed = nodes.join(members.select("id").distinct().hint("merge"), "id", "left_semi")
    # words meet sketches by id, whatever their number, and stay dealt by id; of an id's texts, that with the smallest MD5
    met = texts.select("id", "text_key", "words").join(needed.select("id", "n_words", "sketch", "df").hint("merge"), "id")
    met = met.groupBy("id").agg(F.min(F.struct("text_key", "words")).alias("m"), *(F.first(c).alias(c) for c in ("sketch", "df", "n_words")))
    words = bucketed(met.select("id", F.col("m.words").alias("words"), "df", "sketch", "n_words"), "words", "id")
    links = materialise(verify(star_pairs(members, chunk), words, n_texts, threshold), "links")
    roots = components(links)
    weights = words.select("id", (1 + F.floor(F.col("n_words") / 1024)).alias("weight"))
    placed, split = split_bands(members, roots, weights, block)
    split = materialise(split, "split")
    if not split.limit(1).count():
        return links
    return links.unionByName(materialise(block_links(placed, split, words, n_texts, threshold), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each of docs with an id: id, class_id (the smallest id of the texts it is linked to, directly or by others), n_copies (rows with its very
    words), n_links (verified links of its text to other texts; those inside of a class that others tie already are not looked for), similarity (the
    largest of them; null if there are none)."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("_text")).where("id is not null")
    with scratch(spark):
        bundles = bucketed(text_bundles(rows), "bundles", "bundle")
        n_texts, n_words = bundles.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        with scratch(spark):
            frequencies = materialise(document_frequencies(bundles, max(PART_BITS, (n_words // PART).bit_length())), "frequencies")
            made = materialise(sketches(bundles, frequencies, n_texts), "sketches", keep=True)
        keys = materialise(bundles.select("id", "text_key"), "keys", keep=True)
        own = keys.select("id", F.coalesce("text_key", F.concat(F.lit("-"), F.col("id").cast("string")).cast("binary")).alias("text_key"))
        # copies of one text are counted in parts first, so that no task gets all of them
        parts = own.groupBy("text_key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        parts = materialise(parts, "parts")
        reps = materialise(parts.groupBy("text_key").agg(F.min("rep").alias("rep"), F.sum("n").alias("n_copies")), "reps")
        first = made.join(reps.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("text_key", "n_words", "sketch", "df")).alias("m"))
        nodes = materialise(first.select("id", "m.n_words", "m.sketch", "m.df"), "nodes")
        links = candidate_links(nodes, bundles.where("fresh"), n_texts, threshold)
        # copies and links are both links of classes; an id that has several texts joins theirs
        twice = own.groupBy("id").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi").select("id")
        spread = own.join(twice, "id", "left_semi").distinct().join(reps, "text_key").select(F.col("rep").alias("a"), F.col("id").alias("b"))
        roots = components(links.select("a", "b").unionByName(spread))
        ends = links.select(F.col("a").alias("id"), "similarity").unionByName(links.select(F.col("b").alias("id"), "similarity"))
        seen = ends.groupBy("id").agg(F.count("*").alias("n_links"), F.max("similarity").alias("similarity"))
        known = reps.join(roots.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").join(seen.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
        known = known.select("text_key", F.coalesce("root", "rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "similarity")
        classes = materialise(parts.select("text_key", "salt").join(known.hint("merge"), "text_key"), "classes", keep=True)
    salted = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return salted.join(classes.hint("merge"), ["text_key", "salt"]).select(F.col("id").alias(id_col), "class_id", "n_copies", "n_links", "similarity")
