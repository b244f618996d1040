"""Problem 1: pairs of records with nearly the same words, whatever their order.

The similarity of two records is that of their multisets of words: words in
common over words in either, repeated words counted as often as they occur.
Every (word, occurrence) of a record is one 64-bit token, so the multisets are
sets and a record is a sorted array of tokens.

1. Records with the same multiset are one class; only its representative is
   compared.
2. Two sets can only reach the threshold if they share a token among the first
   ``n - ceil(t * n) + 1`` of a common order.  The order puts tokens that fall
   in thinly filled counters of a sketch of fixed size first; a token alone in
   its counter is left out, since no other record has it.
3. Representatives that share such a token form tiles: in the order of size,
   a record meets those that are at most ``1 / t`` times its size.  A token
   that more than BLOCK records have is cut into size bands of ratio ``1 / t``
   and these into blocks; two blocks of a band, or of a band and the next, are
   tiles of their own, in tasks of their own.
4. Where a pair meets at its first common token, all common tokens stand at or
   after it in both records, which bounds the overlap; bitmaps of SIGNATURE
   words bound it again: bits set in one record alone need as many tokens that
   the other lacks.
5. What remains is intersected exactly.

Nothing but the bounds in 2 to 4 drops a pair, and they are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritylens.llm.consistent import class_pairs, consistent_form, first_copies, text_key
from paritylens.llm.words import words
from paritylens.session import cut_lineage, spread

#: Bits of a signature, in 64-bit words.
SIGNATURE = 4
#: Counters of the sketch that orders tokens; its size does not depend on the data.
COUNTERS = 1 << 21
#: Records of one token that are compared in one tile.
BLOCK = 20_000
#: Records of one class that are expanded in one piece where it is linked.
PIECE = 2_000
#: Rows that a task compares at once, unless one tile has more.
CHUNK = 200_000


_BITS = [f"s{i}" for i in range(SIGNATURE)]


def _signature(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bitmaps of concatenated token arrays, one row of SIGNATURE words each."""
    out = np.zeros((len(ends), SIGNATURE), np.uint64)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    bit = (tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 6 - (SIGNATURE - 1).bit_length())
    np.bitwise_or.at(out, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, raw, form_key, words) with sorted hashes of words -> (id, raw, class_key, n, tokens).

    The k-th occurrence of a word is a token of its own; the class key is a
    128-bit sum over the tokens, so it does not depend on their order.
    """
    for batch in batches:
        lists = batch.column("words")
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        first = np.ones(len(flat), bool)
        first[1:] = flat[1:] != flat[:-1]
        first[starts[sizes > 0]] = True
        at = np.arange(len(flat))
        nth = at - np.maximum.accumulate(np.where(first, at, 0)) if len(flat) else at
        tokens = _mixed(flat + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0)
        key = np.empty((len(sizes), 2), np.uint64)
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(tokens, salt))))
            key[:, i] = run[ends] - run[starts]
        # Without words, only the same form is the same.
        keys = [w if not n else k for n, k, w in zip(sizes, key.view("V16")[:, 0].tolist(), batch.column("form_key").to_pylist())]
        offsets = pa.array(np.concatenate((np.zeros(1, np.int64), ends)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("raw"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(tokens.view(np.int64)))],
            names=["id", "raw", "class_key", "n", "tokens"],
        )


def token_records(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, raw, class_key, n, tokens) of every record with an id and a text; ``raw`` is the key of the text as it is."""
    rows = df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    forms = consistent_form(spread(rows).withColumn("raw", text_key(F.col("text"))), "text")
    hashed = forms.select("id", "raw", "form", F.sort_array(F.transform(words(F.col("form")), lambda w: F.xxhash64(w))).alias("words"))
    hashed = hashed.select("id", "raw", F.when(F.size("words") == 0, text_key(F.col("form"))).alias("form_key"), "words")
    return hashed.mapInArrow(_number, "id long, raw binary, class_key binary, n int, tokens array<long>")


def _counters(records: DataFrame) -> np.ndarray:
    """How many tokens fall in each of COUNTERS counters: at most COUNTERS rows reach the driver."""
    counts = records.select(F.explode("tokens").alias("t")).groupBy(F.pmod("t", F.lit(COUNTERS)).cast("int").alias("c")).count()
    got = counts.select("c", F.least(F.col("count"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int32)
    out[got.column("c").to_numpy()] = got.column("n").to_numpy()
    return out


def _bands(threshold: Fraction) -> np.ndarray:
    """Least sizes of the bands: partners of a record are in its band or a neighbour of it."""
    least = [1]
    while least[-1] < 2**31:
        least.append(least[-1] * threshold.denominator // threshold.numerator + 1)
    return np.array(least, np.int64)


def _prefixes(threshold: Fraction, counters):
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill, bands = counters.value, _bands(threshold)
        for batch in batches:
            lists = batch.column("tokens")
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = batch.column("n").to_numpy()
            if not len(sizes):
                continue
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            full = fill[tokens % COUNTERS]
            # The order of tokens: thin counters first, then the upper half of the token, then
            # the word, by which the tokens of a record already stand.
            rare = (full.astype(np.int64) << 32) | ((tokens >> 32) & 0xFFFFFFFF)
            order = np.lexsort((rare, owner))
            rank = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)
            need = -(-threshold.numerator * sizes.astype(np.int64) // threshold.denominator)
            # A token that no other record has makes no pair.
            keep = (rank < np.repeat(sizes - need + 1, sizes)) & (full[order] > 1)
            own = owner[keep]
            found, size = tokens[order][keep], sizes[own].astype(np.int64)
            sig = _signature(tokens, ends)
            band = np.searchsorted(bands, sizes, "right") - 1
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(ids[own]), pa.array((size << 32) + rank[keep]), pa.array(band[own], pa.int32()), pa.array(fill[found % COUNTERS] > block), *(pa.array(sig[own, i].view(np.int64)) for i in range(SIGNATURE))],
                names=["token", "id", "spot", "band", "thick", *_BITS],
            )

    return run


def _sweep(threshold: Fraction):
    """Rows (tile, spot, side, id, s0...) with each tile in one piece -> candidate pairs of each tile."""
    num, den, chunk = threshold.numerator, threshold.denominator, CHUNK

    def tile(rows: pa.Table) -> pa.RecordBatch:
        # By size within a tile.
        order = np.lexsort((rows.column("spot").to_numpy(), rows.column("tile").to_numpy()))
        col = lambda c: rows.column(c).to_numpy()[order]
        at = np.cumsum(np.r_[0, np.diff(col("tile")) != 0])
        n, ids, side = col("spot") >> 32, col("id"), col("side")
        # Tokens from the common one on; size of which a partner has at most.
        rest = n - (col("spot") & 0xFFFFFFFF)
        widest = den * n
        bits = [col(c).view(np.uint64) for c in _BITS]
        found_a, found_b = [], []
        # The smaller of two records has its common token early: its partner is no smaller.
        live = np.flatnonzero((den + num) * rest >= 2 * num * n)
        step = 0
        while len(live):
            step += 1
            live = live[: np.searchsorted(live, len(n) - step)]
            other = live + step
            # Sizes ascend within a tile, so a record that has left its band is done.
            near = (at[live] == at[other]) & (widest[live] >= num * n[other])
            live, other = live[near], other[near]
            fits = (den + num) * np.minimum(rest[live], rest[other]) >= num * (n[live] + n[other])
            # Where a tile has two sides, only records of different ones meet here.
            fits &= (side[live] < 0) | (side[live] != side[other])
            a, b = live[fits], other[fits]
            if not len(a):
                continue
            lack_a = np.zeros(len(a), np.int64)
            lack_b = np.zeros(len(a), np.int64)
            for s in bits:
                x, y = s[a], s[b]
                lack_a += np.bitwise_count(x & ~y)
                lack_b += np.bitwise_count(y & ~x)
            fits = (den + num) * np.minimum(n[a] - lack_a, n[b] - lack_b) >= num * (n[a] + n[b])
            found_a.append(ids[a[fits]])
            found_b.append(ids[b[fits]])
        pairs = np.stack([np.concatenate(found_a), np.concatenate(found_b)]) if found_a else np.zeros((2, 0), np.int64)
        pairs = np.sort(pairs, axis=0)
        pairs = pairs[:, np.lexsort(pairs[::-1])]
        pairs = pairs[:, np.r_[True, np.any(pairs[:, 1:] != pairs[:, :-1], axis=0)]] if pairs.shape[1] else pairs
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["id_a", "id_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < chunk:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("tile").to_numpy()
            # The last tile may go on in the next batch.
            before = np.flatnonzero(key != key[-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield tile(rows.slice(0, cut))
            held, size = rows.slice(cut).to_batches(), len(rows) - cut
        if size:
            yield tile(pa.Table.from_batches(held))

    return run


def _tiles(index: DataFrame) -> DataFrame:
    """(tile, spot, side, id, s0...): index rows with the number of their tile and their side in it.

    Records of a token are one tile.  A token that more than BLOCK records
    have is cut into size bands, and a band into blocks; a tile then holds one
    block, or two blocks of a band, or one of a band and one of the next.
    """
    # A token is crowded only if its counter of the sketch is, so few rows are counted;
    # at most (index rows / BLOCK) tokens are crowded.
    thick = index.where("thick")
    per_band = thick.groupBy("token", "band").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / BLOCK).cast("int"))))
    crowded = per_band.groupBy("token").agg(F.sum("n").alias("n"), blocks.alias("blocks")).where(F.col("n") > BLOCK).select("token", "blocks")
    marked = thick.join(crowded, "token", "left")
    row = ["spot", "side", "id", *_BITS]
    calm = index.where("not thick").unionByName(marked.where("blocks is null").drop("blocks")).withColumn("side", F.lit(-1)).select(F.col("token").alias("tile"), *row)
    wide = marked.where("blocks is not null").withColumn("own", F.pmod(F.xxhash64("id"), F.element_at("blocks", F.col("band"))).cast("int"))

    def mates(other: Column, lower: Column) -> Column:
        """Tiles with the blocks of another band, or of the own one."""
        count = F.coalesce(F.element_at("blocks", other), F.lit(0))
        same = other == F.col("band")
        here, there = F.struct(F.col("band"), F.col("own")), lambda j: F.struct(other.alias("band"), j.alias("own"))
        pair = lambda j: F.when(lower, F.xxhash64("token", here, there(j))).otherwise(F.xxhash64("token", there(j), here))
        of = lambda j: F.struct(pair(j).alias("tile"), F.when(same & (j == F.col("own")), F.lit(-1)).otherwise(F.col("own") * 2 + F.col("band") % 2).alias("side"))
        inner = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda j: F.when(same & (j < F.col("own")), F.struct(F.xxhash64("token", there(j), here).alias("tile"), (F.col("own") * 2 + F.col("band") % 2).alias("side"))).otherwise(of(j)))
        return F.when(count > 0, inner).otherwise(F.array().cast("array<struct<tile:bigint,side:int>>"))

    band = F.col("band")
    every = F.concat(mates(band, F.lit(True)), mates(band + 1, F.lit(True)), mates(band - 1, F.lit(False)))
    wide = wide.withColumn("mate", F.explode(every)).select(F.col("mate.tile").alias("tile"), "spot", F.col("mate.side").alias("side"), "id", *_BITS)
    return calm.unionByName(wide)


def near_classes(df: DataFrame, id_col: str, text: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records that have an id and a text.

    members: (id, raw, class_key, rep, n_records): records with the same words as
    often share a class; ``rep`` is its smallest id.
    links: (rep_a, rep_b, similarity) between classes whose similarity is at
    least ``threshold``, rep_a < rep_b.  Null texts have no row; texts without
    words are only the same as texts of the same form.  A repeated id counts once
    if its text is repeated too.
    """
    t = Fraction(str(threshold))
    spark = df.sparkSession
    records = cut_lineage(token_records(df, id_col, text))
    narrow = records.groupBy("id", "class_key").agg(F.min("raw").alias("raw"))
    # Copies are counted per text before a class meets, so a hot class sends one row per map task.
    classes = narrow.groupBy("class_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_records"))
    # Only classes of several records have to be told which is their representative;
    # written, their number is known, and while they are few the tokens need not move.
    several = cut_lineage(classes.where("n_records > 1"))
    members = narrow.join(several, "class_key", "left").withColumns({"rep": F.coalesce("rep", "id"), "n_records": F.coalesce("n_records", F.lit(1).cast("long"))})
    filled = records.where("n > 0")
    reps = filled.join(several.drop("n_records"), "class_key", "left").where("rep is null or rep = id").select("id", "n", "tokens")
    counters = spark.sparkContext.broadcast(_counters(filled))
    index = cut_lineage(reps.mapInArrow(_prefixes(t, counters), "token long, id long, spot long, band int, thick boolean, " + ", ".join(f"{c} long" for c in _BITS)))
    tiles = _tiles(index).repartition("tile").sortWithinPartitions("tile")  # one number, so no rows are compared
    candidates = cut_lineage(tiles.mapInArrow(_sweep(t), "id_a long, id_b long").distinct())
    asked = candidates.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    sides = cut_lineage(filled.select("id", "n", "tokens").join(asked, "id", "left_semi").dropDuplicates(["id"]))
    a, b = (sides.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}")) for x in "ab")
    both = candidates.join(a, "id_a").join(b, "id_b")
    enough = (t.denominator + t.numerator) * F.col("common") >= t.numerator * (F.col("n_a") + F.col("n_b"))
    exact = both.withColumn("common", F.size(F.array_intersect("t_a", "t_b"))).where(enough)
    links = exact.select(F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b"), (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("similarity"))
    return members, links


def near_pairs(df: DataFrame, id_col: str, text: str, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of records with similarity of at least ``threshold``.

    All pairs of different texts are listed, within a class of the same words
    and between linked classes.  Only of more than REPRESENTATIVES + 1
    byte-identical texts the first ones stand for the others, as in
    ``class_pairs``.
    """
    members, links = near_classes(df, id_col, text, threshold)
    members = cut_lineage(first_copies(cut_lineage(members), ["class_key"]))
    same = class_pairs(members.where("n_records > 1"), ["class_key"]).select("id_a", "id_b")
    # Large classes go in pieces, every piece of one with every piece of the other.
    pieces = F.ceil(F.col("n_records") / PIECE).cast("int")
    own = members.select("rep", "id", "first", F.pmod(F.xxhash64("id"), pieces).cast("int").alias("piece"))
    large = members.where(F.col("n_records") > PIECE).select("rep", pieces.alias("pieces")).distinct()
    for x in ("a", "b"):
        count = large.select(F.col("rep").alias(f"rep_{x}"), "pieces")
        links = links.join(count, f"rep_{x}", "left").withColumn(f"piece_{x}", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    links = cut_lineage(links.select("rep_a", "rep_b", "piece_a", "piece_b"))

    def expand(left: str, right: str) -> DataFrame:
        p = own.where(left).select(F.col("rep").alias("rep_a"), F.col("piece").alias("piece_a"), F.col("id").alias("p"))
        q = own.where(right).select(F.col("rep").alias("rep_b"), F.col("piece").alias("piece_b"), F.col("id").alias("q"))
        found = links.join(p, ["rep_a", "piece_a"]).join(q, ["rep_b", "piece_b"]).where("p <> q")
        return found.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))

    across = expand("true", "first").unionByName(expand("first", "not first")).distinct()
    return same.unionByName(across)
