"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles. Signatures are unbiased for the weighted Jaccard similarity of such
multisets: each shingle owns Poisson processes over discretised weight ranges (0, 1], (1, 2], (2, 4], ..., a document of
count c sees the points whose weight is at most c, and each register keeps the earliest point that falls to it. Bands of
registers give candidate pairs, and the overlap of the multisets themselves decides.

Texts that are equal are folded first and never compared. Nodes of the graph are distinct texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import fresh, materialize, scratch, small_or_plain
from tesserae.llm.textops import U, mix, per_row, shingles
from tesserae.runtime import ship

WIDTH = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: Members outside the largest component of a neighbourhood are checked against its spokesmen in up to so many turns, while over a
#: hundredth of these checks find links.
STARS = 10
#: What is left of a neighbourhood is compared in blocks of about so many members.
BLOCK = 1024
#: A block has more, smaller parts where its members' shingles would number more than this.
BLOCK_CODES = 1 << 21
#: A party of a neighbourhood is spread over so many tasks where it meets a table that is too large to broadcast.
SALTS = 16
#: Registers of the longer signature that the blocks are compared by.
FINE = 768
_LAST = (1 << 63) - 1


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from the upper 53 bits."""
    return ((h >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def bag_minhash(elements: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """Signature of a multiset of distinct ``elements`` (64-bit hashes) with integer ``counts``: one 64-bit point identity per register.

    Two multisets agree in a register with probability equal to their weighted Jaccard similarity. Points are made
    only up to a time by which the registers are almost surely full; if one is empty the time is doubled.
    """
    sig = np.zeros(registers, dtype=U)
    if len(elements) == 0:
        return sig
    total = float(counts.sum())
    limit = registers * (math.log(registers) + 4.0) / total
    levels = int(counts.max() - 1).bit_length() + 1
    with np.errstate(over="ignore"):
        while True:
            times, points = [], []
            for level in range(levels):
                low = 0 if level == 0 else 1 << (level - 1)
                width = 1 if level == 0 else 1 << (level - 1)
                chosen = counts > low
                seeds = mix(elements[chosen] + U(level + 1) * U(0xA0761D6478BD642F))
                caps = counts[chosen]
                expected = limit * width
                k0, columns = 0, int(expected + 3.0 * math.sqrt(expected)) + 2
                at = np.zeros(len(seeds))
                while len(seeds):
                    steps = np.arange(k0 + 1, k0 + columns + 1, dtype=U) * U(0xE7037ED1A0B428DB)
                    h = mix(seeds[:, None] + steps[None, :])
                    x = at[:, None] + np.cumsum(-np.log(_unit(h)) / width, axis=1)
                    inside = x <= limit
                    h2 = mix(h[inside] + U(0x8EBC6AF09C88C6E3))
                    x2 = x[inside]
                    if width > 1:
                        cell = low + 1 + (h2 >> U(32)).astype(np.int64) % width
                        seen = cell <= np.broadcast_to(caps[:, None], inside.shape)[inside]
                        h2, x2 = h2[seen], x2[seen]
                    times.append(x2)
                    points.append(h2)
                    on = x[:, -1] <= limit
                    seeds, caps, at = seeds[on], caps[on], x[on, -1]
                    k0, columns = k0 + columns, max(4, columns // 4)
            t, p = np.concatenate(times), np.concatenate(points)
            register = ((p & U(0xFFFFFFFF)) % U(registers)).astype(np.int64)
            order = np.argsort(-t, kind="stable")
            best = np.full(registers, -1, dtype=np.int64)
            best[register[order]] = order
            if (best >= 0).all():
                return p[best]
            limit *= 2.0


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band: equal exactly if the band's registers are (up to a hash)."""
    with np.errstate(over="ignore"):
        parts = sig.reshape(bands, -1)
        out = mix(np.arange(1, bands + 1, dtype=U) * U(0x589965CC75374CC3))
        for k in range(parts.shape[1]):
            out = mix(out ^ parts[:, k])
    return out.view(np.int64)


def multiset_codes(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted codes of (element, occurrence): the overlap of two such sets is the multiset overlap."""
    ends = np.cumsum(counts)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    with np.errstate(over="ignore"):
        return np.sort(mix(np.repeat(elements, counts) + nth.astype(U) * U(0x9E3779B97F4A7C15)))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted code arrays; 0 if both are empty."""
    if len(a) == 0 or len(b) == 0:
        return 0.0
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def _bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for words in per_row(column):
        yield np.unique(shingles(words, WIDTH), return_counts=True)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) -> (doc_id, digest, n, bands)."""
    for b in batches:
        n, keys = [], []
        for elements, counts in _bags(b.column(2)):
            n.append(int(counts.sum()))
            if len(elements):
                keys.append(band_keys(bag_minhash(elements, counts, BANDS * ROWS)))
        ends = np.concatenate([[0], np.cumsum([BANDS * (x > 0) for x in n])]).astype("int32")
        flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), bands], names=["doc_id", "digest", "n", "bands"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, codes)."""
    for b in batches:
        codes = [multiset_codes(e, c).tobytes() for e, c in _bags(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["node", "codes"])


_VERIFIED = "a long, b long, similarity double, size_a long, size_b long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, codes of a, codes of b) -> (a, b, similarity, number of codes of a, of b)."""
    for t in batches:
        left, right = ([np.frombuffer(x.as_py(), dtype=U) for x in t.column(i)] for i in (2, 3))
        s = [overlap(x, y) for x, y in zip(left, right, strict=True)]
        sizes = [pa.array([len(x) for x in side], pa.int64()) for side in (left, right)]
        yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(s, pa.float64()), *sizes], names=["a", "b", "similarity", "size_a", "size_b"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, codes) -> (node, sketch): a longer signature, one byte per register. Codes are a set, so all counts are 1."""
    for b in batches:
        made = []
        for x in b.column(1):
            codes = np.frombuffer(x.as_py(), dtype=U)
            sig = bag_minhash(codes, np.ones(len(codes), dtype=np.int64), FINE)
            made.append((sig >> U(40)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["node", "sketch"])


def _least(registers: int, similarity: float, deviations: float) -> int:
    return math.floor(registers * similarity - deviations * math.sqrt(registers * similarity * (1.0 - similarity)))


def _compare_blocks(similarity: float):
    """Links between the components of a group: enough of them to join whatever its links join, at most one per member.

    A group holds rows of one neighbourhood: a block of its minority and a block of the rest (``major``), or one or two blocks
    of the minority. ``s`` is the similarity to the neighbourhood's centre, and 1 - similarity is a metric, so two members
    whose ``s`` differ by more than 1 - ``similarity`` are no pair. Pairs whose sketches agree often enough, within four standard
    deviations of ``similarity``, are checked exactly, unless links found before have joined them. A first look at 128
    registers allows five deviations.
    """
    few, least_few, least = 128, _least(128, similarity, 5.0), _least(FINE, similarity, 4.0)
    gap = 1.0 - similarity + 1e-9

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "node"], kind="stable")
        minor = ~pdf["major"].to_numpy(dtype=bool)
        block = pdf["block"].to_numpy()
        first = minor & (block == block[minor].min()) if minor.any() else minor
        left = np.flatnonzero(first)
        right = np.flatnonzero(~first)
        if not len(right) and minor.all():
            right = left
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            node, label, s = pdf["node"].to_numpy(), pdf["label"].to_numpy(), pdf["s"].to_numpy()
            codes = [np.frombuffer(x, dtype=U) for x in pdf["codes"]]
            sketch = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(len(pdf), FINE)
            near, away = np.ascontiguousarray(sketch[right][:, :few]), s[right]
            # ``joined`` names the component of each member as far as the links of this group tell.
            joined = np.unique(label, return_inverse=True)[1]
            for k in left.tolist():
                lo, hi = np.searchsorted(away, s[k] - gap), np.searchsorted(away, s[k] + gap, side="right")
                some = lo + np.flatnonzero(joined[right[lo:hi]] != joined[k])
                some = some[(near[some] == sketch[k, :few]).sum(1) >= least_few]
                some = right[some]
                agree = (sketch[some] == sketch[k]).sum(1)
                for j in some[np.argsort(-agree, kind="stable")][: np.count_nonzero(agree >= least)].tolist():
                    if joined[j] != joined[k] and overlap(codes[k], codes[j]) >= similarity:
                        joined[joined == joined[j]] = joined[k]
                        out.append((min(node[k], node[j]), max(node[k], node[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the same throughout a connected component.

    Each round hooks every node to its best neighbour and contracts the links; components shrink by a constant
    factor a round, stars at once. Odd rounds rank nodes by themselves, even ones by a hash, so no numbering of a path
    can slow it down. Nothing is gathered but the number of links left.
    """
    edges, labels, rounds = links.select("a", "b"), None, 0
    while True:
        rank = (lambda c: F.col(c)) if rounds % 2 == 0 else (lambda c, r=rounds: F.xxhash64(F.lit(r), F.col(c)))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", rank("b")).alias("to"))
        stay = rank("node") <= rank("to")
        hook = materialize(best.select("node", F.when(stay, F.col("node")).otherwise(F.col("to")).alias("to")), "hooks")
        to_a = hook.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        to_b = hook.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        labels = (
            hook.select("node", F.col("to").alias("label"))
            if labels is None
            else labels.join(hook.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        )
        labels = materialize(labels, "labels")
        edges = edges.join(to_a, "a").join(to_b, "b").filter("pa <> pb")
        edges = edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = materialize(edges, "links")
        rounds += 1
        if edges.isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more ``links`` (a, b); a node without a label is its own."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    lifted = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    between = lifted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    between = materialize(between, "between")
    if between.isEmpty():
        return labels
    to = components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    new = to.join(labels, "label", "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))
    new = new.join(labels, "node", "left_anti")
    moved = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(moved.unionByName(new), "labels")


def _digest():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _parties(hoods: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, tops, minor) of the neighbourhoods that hold several components.

    ``placed`` is every member with its label. ``tops`` has one row per mixed neighbourhood: its largest component and that
    one's spokesman of this ``turn``. ``minor`` has the other components of it. Members are counted by (centre, label) before anything
    is gathered by centre, so a neighbourhood that holds a third of all texts is one row per component.
    """
    placed = hoods.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rank = F.xxhash64(F.lit(turn), F.col("node"))
    parties = placed.groupBy("center", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("node", rank).alias("rep"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("size").alias("codes")
    )
    parties = materialize(parties, "parties")
    size = F.struct("n", "label")
    tops = parties.groupBy("center").agg(
        F.max_by("label", size).alias("major"), F.max_by("rep", size).alias("major_rep"), F.max("n").alias("n_major"), F.max_by("codes", size).alias("c_major"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("k")
    )
    # Of two members one is the centre, and everyone has been compared with the centre.
    tops = materialize(tops.filter("k > 1 and m > 2"), "tops")
    minor = parties.join(small_or_plain(tops.select("center", "major")), "center").filter("label <> major").drop("major")
    return placed, tops, materialize(minor, "minor")


def _of_parties(placed: DataFrame, parties: DataFrame) -> DataFrame:
    """Members of ``parties`` (center, label, ...): by broadcast if these are few, else salted, as one party may be a third of all."""
    few = small_or_plain(parties)
    if few is not parties:
        return placed.join(few, ["center", "label"])
    salted = parties.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = placed.withColumn("salt", F.pmod(F.xxhash64(F.lit(4), F.col("node")), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["center", "label", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, digest.

    A class is a connected component of texts whose shingle multisets overlap (weighted Jaccard) by ``similarity`` or more;
    equal texts always share one. ``class_id`` is the smallest doc_id of the class, and exactly one row of it is ``kept``.
    A text of one to four words is one shingle. A null, empty or blank text has no shingles and is a class of its own; so its
    class_id is its own doc_id. Null doc_ids count last; a class of nothing else has a null class_id. An empty table gives an
    empty result.

    The first text of a band's bucket is its centre, and all that share a bucket with a centre are its neighbourhood. Every member is
    checked against the centre. Where a neighbourhood still holds several components, members outside its largest one are checked
    against a member of that one and of the largest of their own, again while that finds links. Then longer signatures of what is
    still outside are compared with all members of other components, block by block, and every pair that may reach
    ``similarity`` (four standard deviations allowed) is checked in place. So no candidate pair is given up, a neighbourhood of copies costs
    a few checks per member, what is sent again is the minority only, and no task holds more than two blocks.
    """
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return _near_duplicates(docs, similarity, keep)


def _near_duplicates(docs: DataFrame, similarity: float, keep) -> DataFrame:
    signed = docs.select(F.col("doc_id"), _digest().alias("digest"), F.col("text")).mapInArrow(
        _sign, "doc_id long, digest binary, n long, bands array<long>"
    )
    rows = keep(materialize(signed.withColumn("rid", F.monotonically_increasing_id()), "signed"))
    worded = rows.filter("n > 0")
    first = F.coalesce("doc_id", F.lit(_LAST))
    texts = materialize(
        worded.groupBy("digest").agg(
            F.min_by("rid", first).alias("node"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
        ),
        "texts",
    )
    nodes = worded.select(F.col("rid").alias("node"), "n", "bands").join(texts.select("node"), "node", "left_semi")
    members = materialize(nodes.select("node", F.explode("bands").alias("bucket")), "members")
    shared = members.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("last")).filter("center < last")
    pairs = members.join(shared.select("bucket", "center"), "bucket").filter("node <> center")
    pairs = materialize(pairs.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(texts.join(ends, "node", "left_semi").select("node", "digest"), "wanted")
    again = docs.select(_digest().alias("digest"), "text").join(small_or_plain(wanted), "digest")
    codes = again.select("node", "text").dropDuplicates(["node"]).mapInArrow(_encode, "node long, codes binary")
    codes = materialize(codes, "codes")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        with_b = pairs.join(codes.select(F.col("node").alias("b"), F.col("codes").alias("codes_b")), "b")
        with_a = with_b.join(codes.select(F.col("node").alias("a"), F.col("codes").alias("codes_a")), "a")
        checked = with_a.select("a", "b", "codes_a", "codes_b").mapInArrow(_verify, _VERIFIED)
        return materialize(checked, label)

    near = verified(pairs, "near")
    done, links = near, near.filter(F.col("similarity") >= similarity)
    labels = components(links)
    hoods = near.select(F.col("a").alias("center"), F.col("b").alias("node"), F.col("similarity").alias("s"), F.col("size_b").alias("size"))
    hoods = hoods.unionByName(near.select(F.col("a").alias("center"), F.col("a").alias("node"), F.lit(1.0).alias("s"), F.col("size_a").alias("size")).distinct())

    def ordered_pairs(df: DataFrame) -> DataFrame:
        both = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return both.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")

    for turn in range(1, STARS):
        placed, tops, minor = _parties(hoods, labels, turn)
        if minor.isEmpty():
            break
        size = F.struct("n", "label")
        second = minor.groupBy("center").agg(F.max_by("label", size).alias("second"), F.max_by("rep", size).alias("second_rep"))
        spoken = minor.select("center", "label").join(tops.select("center", "major_rep"), "center").join(second, "center")
        spoken = materialize(spoken, "spoken")
        facing = _of_parties(placed, spoken)
        facing = facing.select("node", F.explode(F.array("major_rep", F.when(F.col("second") != F.col("label"), F.col("second_rep")))).alias("rep"))
        facing = facing.filter("rep is not null").select(F.col("rep").alias("a"), F.col("node").alias("b"))
        found = verified(materialize(ordered_pairs(facing), "pairs"), "near")
        done = done.unionByName(found)
        joins = found.filter(F.col("similarity") >= similarity)
        labels = merged(labels, joins)
        if joins.count() <= found.count() / 100:
            break
    # What is left: pairs between the minority of a neighbourhood and its other members, by blocks.
    placed, tops, minor = _parties(hoods, labels, 0)
    if not minor.isEmpty():
        gap = 1.0 - similarity + 1e-9
        left = minor.groupBy("center").agg(F.sum("n").alias("n_minor"), F.sum("codes").alias("c_minor"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        blocks = lambda n, c: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(c) / BLOCK_CODES)).cast("int")
        sizes = tops.join(left, "center").select(
            "center", "major", "k", blocks("n_minor", "c_minor").alias("minors"), blocks("n_major", "c_major").alias("majors"),
            (F.col("lo") - gap).alias("lo"), (F.col("hi") + gap).alias("hi"),
        )
        sizes = materialize(sizes, "sizes")
        deal = lambda n: F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.col(n)).cast("int")
        place = lambda i, j, within: F.struct(i.alias("i"), j.alias("j"), F.lit(within).alias("within"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        few = _of_parties(placed, minor.select("center", "label").join(sizes, "center")).withColumn("block", deal("minors"))
        against = F.transform(upto("majors"), lambda j: place(F.col("block"), j, False))
        among = F.transform(upto("minors"), lambda k: place(F.least(k, F.col("block")), F.greatest(k, F.col("block")), True))
        at = F.when(F.col("k") > 2, F.concat(against, among)).otherwise(against)
        few = few.select("center", "node", "label", "s", "block", F.lit(False).alias("major"), F.explode(at).alias("at"))
        most = _of_parties(placed, sizes.withColumnRenamed("major", "label")).filter("s between lo and hi").withColumn("block", deal("majors"))
        facing = F.transform(upto("minors"), lambda i: place(i, F.col("block"), False))
        most = most.select("center", "node", "label", "s", "block", F.lit(True).alias("major"), F.explode(facing).alias("at"))
        dealt = materialize(few.unionByName(most), "dealt")
        fine = codes.join(dealt.select("node").distinct(), "node", "left_semi").mapInArrow(_sketch, "node long, sketch binary")
        fine = materialize(fine, "fine").join(codes, "node")
        dealt = dealt.join(fine, "node").select("center", "at", "node", "label", "s", "block", "major", "sketch", "codes")
        across = materialize(dealt.groupBy("center", "at").applyInPandas(_compare_blocks(similarity), "a long, b long"), "across")
        if not across.isEmpty():
            labels = merged(labels, across)

    labelled = texts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = labelled.groupBy("label").agg(
        F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min_by("node", first).alias("keeper")
    )
    by_text = keep(materialize(labelled.select("digest", "label").join(classes, "label").drop("label"), "classes"))
    joined = worded.select("rid", "doc_id", "digest").join(by_text, "digest")
    with_words = joined.select("doc_id", "class_id", "class_size", (F.col("rid") == F.col("keeper")).alias("kept"), "digest")
    without = rows.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "digest")
    return with_words.unionByName(without)


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one of every class, with the columns of ``docs``.

    Rows are matched by doc_id and the text's digest; of rows equal in both one stays, except that every row without a word
    stays.
    """
    mark, kid, kmark = (fresh(docs, n) for n in ("__digest", "__kept_id", "__kept_digest"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(mark, _digest())
    kept = near_duplicates(docs, similarity).filter("kept").select(F.col("doc_id").alias(kid), F.col("digest").alias(kmark)).distinct()
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept[kid]) & (marked[mark] == kept[kmark]))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = found.filter(worded).dropDuplicates(["doc_id", mark]).select(*columns)
    return once.unionByName(docs.filter(~worded))
