"""Chosen-path Jaccard join on word n-grams.

Method: every distinct text becomes a MinHash embedding of ``COORDS``
coordinates, so that Jaccard similarity is the share of equal coordinates.
Each run splits the texts recursively: a node of the path tree samples
coordinates (1 / threshold of them on average, by a hash of the path) and
passes every text on to the child of its value there.  A text may follow
several paths or none; a pair at the threshold has one shared child on average.
Buckets of one text end, buckets of at most ``LEAF`` texts are brute-forced,
larger ones are split again up to ``DEPTH`` levels; what is still larger then
is dense and brute-forced in pairs of blocks.  Runs are repeated until a pair
at the threshold is met with probability ``RECALL``.

A pair is compared only in its first common bucket, so links are counted once
without listing pairs; every candidate is verified on the whole sets of
shingles.  Where groups are asked for and not counts of links (``deduplicate``),
pairs of large buckets that links connect already are not compared.  Exact copies are one text throughout: a hot group of copies is
counted before any shuffle of texts.

Shingles are five words, A-Z lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.
Rows: a null text counts as empty; a text of fewer than five words has no
shingle and is linked to its exact copies only.  Repeated rows are copies; rows
with a null id are documents too.  An empty table gives no rows.  The result
has only its own columns, so clashing names cannot arise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialise
from tessera.llm.textops import chunks, lower_table, permutation_constants, shingles, space_table, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
COORDS = 64
LEAF = 64
DEPTH = 4
RECALL = 0.97
BLOCK = 256
# Equal coordinates below which a pair is not verified: four standard deviations under the threshold.
MIN_EQUAL = int(THRESHOLD * COORDS - 4 * math.sqrt(COORDS * THRESHOLD * (1 - THRESHOLD)))


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a leaf with the given probability."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)  # one shared child on average at every node
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _id_text(c: Column) -> Column:
    """An id as text to join by, nulls too."""
    return F.coalesce(c.cast("string"), F.lit(""))


def _sets(data, offs):
    words, per_row = word_hashes(data, offs, space_table(), lower_table())
    return shingles(words, per_row, SHINGLE)


def signatures(texts: DataFrame) -> DataFrame:
    """(k, sig) for every row of (k, text) with a shingle: ``COORDS`` 32-bit MinHash values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutation_constants(COORDS, 23)
        for batch in batches:
            for first, rows, data, offs in chunks(batch.column("text")):
                h, counts = _sets(data, offs)
                full = counts > 0
                if not full.any():
                    continue
                starts = (np.cumsum(counts) - counts)[full]
                sig = np.empty((len(starts), COORDS), np.uint32)
                for i in range(COORDS):
                    sig[:, i] = np.minimum.reduceat(h * a[i] + b[i], starts) >> np.uint64(32)
                offs_out = np.arange(len(starts) + 1, dtype=np.int32) * (4 * COORDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").slice(first, rows).filter(pa.array(full)),
                     pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs_out.tobytes()), pa.py_buffer(sig.tobytes())])],
                    names=["k", "sig"])

    return texts.select("k", "text").mapInArrow(run, "k binary, sig binary")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _children(path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for every coordinate that the rows' nodes have chosen."""
    limit = np.uint64(int((1 << 64) * min(1.0, 1 / (THRESHOLD * COORDS))) - 1)
    rows, out = [], []
    for i in range(COORDS):
        salt = np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        hit = np.flatnonzero(_mix(path + salt) <= limit)
        if len(hit):
            rows.append(hit)
            out.append(_mix(_mix(path[hit] ^ salt) + sig[hit, i].astype(np.uint64)))
    return (np.concatenate(rows), np.concatenate(out)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _sig_matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, COORDS)


def split_paths(rows: DataFrame, runs: int | None = None) -> DataFrame:
    """(k, sig[, path]) to (k, path) one level deeper; with ``runs``, from the roots of so many runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, keys = _sig_matrix(batch.column("sig")), batch.column("k")
            for r in range(runs or 1):
                path = (np.full(len(sig), _mix(np.array([r + 1], np.uint64))[0]) if runs
                        else batch.column("path").to_numpy().astype(np.int64).view(np.uint64))
                at, child = _children(path, sig)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(child.view(np.int64))], names=["k", "path"])

    return rows.mapInArrow(run, "k binary, path bigint")


def leaf_members(sigs: DataFrame) -> DataFrame:
    """(bucket, n, k): the members of all buckets that are to be brute-forced, each set of members once."""
    done = None
    rows = materialise(split_paths(sigs, runs_for()), "paths")
    for level in range(1, DEPTH + 1):
        sizes = rows.groupBy("path").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y")).where("n > 1")
        small = sizes if level == DEPTH else sizes.where(F.col("n") <= LEAF)
        leaves = small.groupBy("x", "y", "n").agg(F.min("path").alias("path"))
        one = rows.join(leaves.select("path", "n"), "path").select(F.col("path").alias("bucket"), "n", "k")
        done = one if done is None else done.unionByName(one)
        if level < DEPTH:
            large = sizes.where(F.col("n") > LEAF).select("path")
            rows = materialise(split_paths(rows.join(large, "path").join(sigs, "k")), "paths")
    # The same members may be a leaf on several levels: keep one bucket of them.
    done = materialise(done, "leaves")
    marks = done.groupBy("bucket", "n").agg(F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y"))
    once = marks.groupBy("x", "y", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    return done.join(once, "bucket")


def _blocks(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")


def _dealt(rows: DataFrame, other: Column) -> DataFrame:
    """A row (bucket, g, side) for every block that the member's ``own`` block of ``nb`` meets."""
    out = rows.withColumn("other", F.explode(other))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return out.withColumn("g", low * F.col("nb") + high).withColumn("side", (F.col("own") == high) & (low != high)).drop("nb", "own", "other", "n")


def block_rows(members: DataFrame, centres: bool = False) -> DataFrame:
    """Deal members to comparison groups (bucket, g, side): one group for a bucket of at most ``BLOCK``,
    else one for every pair of its blocks; with ``centres``, of its first block and each."""
    out = members.withColumn("nb", _blocks(F.col("n"))).withColumn("own", F.pmod(F.xxhash64("k", F.lit(7)), F.col("nb")).cast("int"))
    one = (F.col("nb") == 1) | (F.col("own") > 0) if centres else F.col("nb") == 1
    return _dealt(out, F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1)))


def rest_rows(members: DataFrame, label: DataFrame) -> DataFrame:
    """Comparison groups of the pairs that ``block_rows`` with ``centres`` leaves, but for those within the component
    (k, label) that holds most of a bucket: the other members' blocks meet each other and that component's blocks."""
    large = members.where(F.col("n") > BLOCK).join(label, "k", "left").withColumn("label", F.coalesce("label", "k"))
    most = (large.groupBy("bucket", "label").agg(F.count("*").alias("c"))
            .groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("most")).select("bucket", "most.c", F.col("most.label").alias("main")))
    out = large.join(most, "bucket").where(F.col("c") < F.col("n"))
    mine = F.col("label") == F.col("main")
    out = out.withColumn("nr", _blocks(F.col("n") - F.col("c"))).withColumn("nm", _blocks(F.col("c")))
    part = F.pmod(F.xxhash64("k", F.lit(7)), F.when(mine, F.col("nm")).otherwise(F.col("nr"))).cast("int")
    out = out.withColumn("own", F.when(mine, F.col("nr") + part).otherwise(part)).withColumn("nb", F.col("nr") + F.col("nm"))
    meets = F.sequence(F.lit(0), F.when(mine, F.col("nr")).otherwise(F.col("nb")) - 1)
    return _dealt(out, meets).drop("label", "c", "main", "nr", "nm")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, int, pa.Table]]:
    """Cut batches sorted by (bucket, g) into groups; only the group at hand is held."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]).select(columns)
        rest = t if rest is None else pa.concat_tables([rest, t])
        b, g = rest["bucket"].to_numpy(), rest["g"].to_numpy()
        cut = np.flatnonzero((b[1:] != b[:-1]) | (g[1:] != g[:-1])) + 1
        at = 0
        for c in cut:
            yield int(b[at]), int(g[at]), rest.slice(at, c - at)
            at = int(c)
        rest = rest.slice(at).combine_chunks()
    if rest is not None and rest.num_rows:
        yield int(rest["bucket"][0].as_py()), int(rest["g"][0].as_py()), rest


def _new_pairs(bucket: int, t: pa.Table) -> np.ndarray:
    """Matrix of the pairs that this group has to compare: across the two blocks, or all of one
    block, without those that meet in an earlier bucket."""
    side = t["side"].to_numpy()
    n = len(side)
    want = np.triu(np.ones((n, n), bool), 1)
    if side.any():
        want = (~side)[:, None] & side[None, :]
    lists = t["buckets"].to_pylist()
    rows = np.repeat(np.arange(n), [len(x) for x in lists])
    ids = np.array([b for x in lists for b in x], np.int64)
    early = ids < bucket
    if early.any():
        names, inv = np.unique(ids[early], return_inverse=True)
        m = np.zeros((n, len(names)), np.float32)
        m[rows[early], inv] = 1
        m = m[:, m.sum(0) > 1]
        if m.shape[1]:
            want &= (m @ m.T) == 0
    return want


def prune(rows: DataFrame) -> DataFrame:
    """(bucket, g, side, k, buckets, sig) to (bucket, g, side, k, buckets) of texts with a candidate in the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n_kept = [], 0
        for bucket, _, t in _groups(batches, ["bucket", "g", "side", "k", "buckets", "sig"]):
            want = _new_pairs(bucket, t)
            if not want.any():
                continue
            sig = _sig_matrix(t["sig"])
            for i in np.flatnonzero(want.any(1)):
                j = np.flatnonzero(want[i])
                want[i, j] = (sig[j] == sig[i]).sum(1) >= MIN_EQUAL
            keep = want.any(0) | want.any(1)
            if keep.any():
                kept.append(t.drop_columns(["sig"]).filter(pa.array(keep)))
                n_kept += int(keep.sum())
                if n_kept >= 4096:
                    yield from pa.concat_tables(kept).combine_chunks().to_batches()
                    kept, n_kept = [], 0
        if kept:
            yield from pa.concat_tables(kept).combine_chunks().to_batches()

    return (rows.repartition("bucket", "g").sortWithinPartitions("bucket", "g")
            .mapInArrow(run, "bucket bigint, g int, side boolean, k binary, buckets array<bigint>"))


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, by bit maps over the shingles that two sets hold."""
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1
    keep = count[inv] > 1
    width = int((count > 1).sum())
    bits = np.zeros((len(sets), -(-max(width, 1) // 64) * 8), np.uint8)
    col = common[inv[keep]]
    np.bitwise_or.at(bits, (at[keep], col >> 3), (1 << (col & 7)).astype(np.uint8))
    words = bits.view(np.uint64)
    out = np.empty(len(i), np.int64)
    step = max(1, (1 << 21) // words.shape[1])
    for a in range(0, len(i), step):
        out[a:a + step] = np.bitwise_count(words[i[a:a + step]] & words[j[a:a + step]]).sum(1)
    return out


def _component(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's connected component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(rows: DataFrame) -> DataFrame:
    """(bucket, g, side, k, buckets, copies, text) to (k, n_texts, n_docs, peer): links found in the group
    and one linked text that stands for the group's component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, nt, nd, peers = [], [], [], []
        for bucket, _, t in _groups(batches, ["bucket", "g", "side", "k", "buckets", "copies", "text"]):
            want = _new_pairs(bucket, t)
            i, j = np.nonzero(want)
            if not len(i):
                continue
            sets = []
            for _, _, data, offs in chunks(t["text"]):
                h, counts = _sets(data, offs)
                sets += [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])]
            size = np.array([len(s) for s in sets])
            near = np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j])
            i, j = i[near], j[near]
            shared = _shared(sets, i, j)
            linked = shared >= THRESHOLD * (size[i] + size[j] - shared)
            i, j = i[linked], j[linked]
            copies = t["copies"].to_numpy()
            n = len(sets)
            texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            docs = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
            label = _component(n, i, j)
            key = t["k"].to_pylist()
            for x in np.flatnonzero(texts):
                ks.append(key[x])
                nt.append(int(texts[x]))
                nd.append(int(docs[x]))
                peers.append(key[label[x]])
            if len(ks) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(nt), pa.array(nd), pa.array(peers, pa.binary())],
                                                 names=["k", "n_texts", "n_docs", "peer"])
                ks, nt, nd, peers = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(nt, pa.int64()), pa.array(nd, pa.int64()), pa.array(peers, pa.binary())],
                                         names=["k", "n_texts", "n_docs", "peer"])

    return (rows.repartition("bucket", "g").sortWithinPartitions("bucket", "g")
            .mapInArrow(run, "k binary, n_texts bigint, n_docs bigint, peer binary"))


def components(edges: DataFrame) -> DataFrame:
    """(k, label) for the nodes of (k, peer): the smallest key of the connected component.

    Labels spread over the edges and then jump to the label's label, so the
    rounds grow with the logarithm of the longest path; each round is written
    to shared storage.
    """
    both = materialise(edges.select("k", "peer").unionByName(edges.select(F.col("peer").alias("k"), F.col("k").alias("peer")))
                       .where(F.col("k") != F.col("peer")).distinct(), "edges")
    labels = materialise(both.groupBy("k").agg(F.least(F.col("k"), F.min("peer")).alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnsRenamed({"k": "peer", "label": "l"}), "peer").groupBy("k").agg(F.min("l").alias("l"))
                .join(labels, "k").select("k", F.col("label").alias("old"), F.least("l", "label").alias("mid")))
        new = materialise(near.join(labels.select(F.col("k").alias("mid"), F.col("label").alias("jump")), "mid", "left")
                          .select("k", "old", F.least("mid", "jump").alias("label")), "labels")
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("k", "label")
        if not changed:
            return labels


def join(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``class_id`` (smallest id of the group that links connect),
    ``copy_id`` (smallest id among exact copies), ``n_copies`` (documents with its text) and ``n_links``
    (other documents at the threshold or more, copies among them), ``n_link_texts`` (other texts)."""
    links, classes = text_links(docs, doc, text)
    keyed = docs.select(F.col(doc).alias("doc_id"), text_key(F.col(text)).alias("k"))
    info = classes.join(links, "k", "left").select(
        "k", "rep", "copies", F.coalesce("label", "k").alias("label"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    ids = info.groupBy("label").agg(F.min("rep").alias("class_id"))
    return (keyed.join(info, "k").join(ids, "label").select(
        F.col("doc_id").alias(doc), "class_id", F.col("rep").alias("copy_id"), F.col("copies").alias("n_copies"),
        (F.col("n_docs") + F.col("copies") - 1).alias("n_links"), F.col("n_texts").alias("n_link_texts")))


def _cards(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(d, text, k) of the documents, classes of copies (k, rep, copies), and the members of buckets (bucket, n, k)
    with all their buckets and signatures."""
    keyed = docs.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"), text_key(F.col(text)).alias("k"))
    classes = materialise(keyed.groupBy("k").agg(F.min("d").alias("rep"), F.count("*").alias("copies")), "classes")
    sigs = materialise(signatures(keyed).groupBy("k").agg(F.first("sig").alias("sig")), "signatures")
    members = materialise(leaf_members(sigs), "members")
    met = members.groupBy("k").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))  # a few buckets per run at most
    return keyed, classes, members.join(met.join(sigs, "k"), "k")


def _links_in(rows: DataFrame, keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """(k, n_texts, n_docs, peer): the links found in the comparison groups of ``rows``."""
    found = materialise(prune(rows), "candidates")
    wanted = found.select("k").distinct().join(classes, "k")
    # One row of each wanted text; the id is part of the key, so copies spread over the tasks.
    same = wanted.select("k", F.col("rep").alias("d"), "copies").withColumn("d", _id_text(F.col("d")))
    texts = (keyed.withColumn("d", _id_text(F.col("d"))).join(same, ["k", "d"]).dropDuplicates(["k", "d"]).select("k", "copies", "text"))
    return materialise(verify(found.join(texts, "k")), "links")


def text_links(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links between different texts, (k, label, n_texts, n_docs), and classes of copies, (k, rep, copies)."""
    keyed, classes, cards = _cards(docs, doc, text)
    checked = _links_in(block_rows(cards), keyed, classes)
    label = components(checked)
    per_text = checked.groupBy("k").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    return per_text.join(label, "k", "left"), classes


def text_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The groups that the links of :func:`text_links` connect, (k, label), without counting them, and classes of copies.

    A bucket of more than ``BLOCK`` is compared with its first block only, which connects most of a dense group
    with rows and comparisons in proportion to it; then only the members outside its largest component are
    compared with all others.  Pairs left out are of one component already.
    """
    keyed, classes, cards = _cards(docs, doc, text)
    cards = materialise(cards, "cards")
    links = _links_in(block_rows(cards, centres=True), keyed, classes)
    label = components(links)
    if cards.where(F.col("n") > BLOCK).limit(1).count():
        more = _links_in(rest_rows(cards, label), keyed, classes)
        if more.limit(1).count():
            label = components(links.unionByName(more))
    return label, classes


def deduplicate(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group connected by links or copies the one with the
    smallest id (of several rows with that id and text, one)."""
    links, classes = text_groups(docs, doc, text)
    label = classes.join(links, "k", "left").withColumn("label", F.coalesce("label", "k"))
    stay = (label.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "k")).alias("m"))
            .select(F.col("m.k").alias("__k"), _id_text(F.col("m.rep")).alias("__d")))
    keyed = docs.withColumns({"__k": text_key(F.col(text)), "__d": _id_text(F.col(doc))})
    return keyed.join(stay, ["__k", "__d"]).dropDuplicates(["__k", "__d"]).select(*docs.columns)
