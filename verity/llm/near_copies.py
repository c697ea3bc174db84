"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Documents with equal sets are one entry. SimHash names candidates: fingerprints of several 64-bit words, joined by
the binary tries of operator 5. A word is cut into parts; a trie's root is a part's value, and its entries are that
word and the next one of the documents that have the value. Entries of a root that are joined, directly or by others,
within BITS[parts] differing bits are a band. A band's entries are candidates only. What bands hang together is a
cluster, and the texts of its entries (and only those) are dealt by cluster, so that an entry travels once and not
once for each of its bands. A cluster is cut into blocks of bounded numbers of entries and of shingles. In a block
each pair that is not yet linked is
compared exactly; a block returns a spanning forest, never the pairs of a group. Links meet in distributed connected
components. Of a cluster of one block that is all. One of several blocks is cut twice, by two hashes, so that a large
group of near copies hangs together for twice its rows; then those of its bands follow that are not yet one component,
those of the first quarter of the words first; bands with the same entries count once. Shingles are compared as 64-bit
hashes.

Bits of two sets with a Jaccard similarity of 0.8 differ with a probability of 0.15 (0.16 in sets of under 40
shingles, 0.19 for 4 of 5), so that a part of 12 bits is the same in 0.14 of the words. A pair at exactly 0.8 has none
of the 90 parts in common with probability 1e-6 (5e-6, 4e-4), a closer pair with much less. Roots of 12 bits hold
1 / 4096 of the documents each; for more documents parts are longer and words more (PLANS), so that by
calculation (not measured) work grows as the power 1.25 of the documents and not as their square.

A band of several blocks is cut twice as well. The second round compares what that left open: entries outside a band's largest
component with that component, block by block, and with each other. A band that is one component has none. So the
work grows with a band's entries times those that are not near copies of the rest, not with the square of a group.

Texts are dealt through a bounded Bloom filter (see sieve): those that surely are no entry, or surely stay, do not
travel. What passes it is joined exactly.

Nulls: a null text has no shingles, like an empty one, and all such documents are one group; a null doc_id represents
a group only if no row of the group has an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verity.llm.common import cut, map_pieces, pieces, quoted, texts
from verity.llm.components import Forest, components
from verity.llm.hashing import U, mix
from verity.llm.sieve import sieve
from verity.llm.simhash import shingle_hashes, trie_join

#: Up to how many documents how many words are cut into how many parts each.
PLANS = [(1 << 21, 18, 5), (1 << 26, 47, 4), (1 << 63, 140, 3)]
#: Differing bits of two words of entries that share a part, by parts of a word: near copies at 0.8 differ in 17.6 on
#: average with a deviation of 3.9, documents at random in 58 with 5.4 (of the 116 bits outside a part of 12).
BITS = {5: 32, 4: 30, 3: 28}
#: What a row is in the part that it is compared in: of the known component, beside one, or compared with all.
KNOWN, OTHER, ALL = 0, 1, 2
#: What a row is found again by: its id and a hash of its text.
KEYS = ["null", "id", "hash"]


def prints_of(raw: list[bytes], shingle: int = 5, words: int = PLANS[0][1]) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Of each text the key of its set of shingles, the sorted set, and a fingerprint of so many words (texts
    without words: 0)."""
    hashes, counts = shingle_hashes(raw, shingle)
    data, ends = np.array(hashes, np.uint64), np.cumsum(counts)
    sets = [np.unique(data[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    keys = [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
    out = np.zeros((len(raw), words), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = votes([sets[i] for i in some.tolist()], words)
    return keys, sets, out


def votes(sets: list[np.ndarray], words: int) -> np.ndarray:
    """SimHash of non-empty sets of 64-bit hashes: a bit of a word is 1 if it is set in over half of the set's values,
    which are mixed anew for each word. Eight bits of a word are counted at once, in the bytes of a 64-bit sum."""
    data, counts = np.concatenate(sets), np.array([len(s) for s in sets], np.int64)
    first, runs = np.cumsum(counts) - counts, -(-counts // 255)  # of at most 255 values, which a byte can count
    run = np.cumsum(runs) - runs
    starts = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(run, runs))
    out = np.zeros((len(sets), words), np.uint64)
    for j in range(words):
        mixed = mix(data + U(0x9E3779B97F4A7C15 * (2 * j + 1) & (1 << 64) - 1))
        for s in range(8):
            found = np.add.reduceat((mixed >> U(s)) & U(0x0101010101010101), starts).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(found, run, axis=0, dtype=np.int64) * 2 > counts[:, None]
            out[:, j] |= (ones.astype(U) << (np.arange(8, dtype=U) * U(8) + U(s))).sum(axis=1, dtype=U)
    return out


def linked(sets: list[np.ndarray], similarity: float, known: int = 0) -> np.ndarray:
    """Root of each set in the forest of links with at least this Jaccard similarity. The first `known` sets are one
    component already; if there are any, the others are compared with them only."""
    sizes, forest = np.array([len(s) for s in sets]), Forest(len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts, mark = ends - sizes, np.zeros(len(flat), bool)
    if known:
        forest.union(np.arange(1, known), np.zeros(known - 1, np.int64))
    for i in range(known, len(sets) - (not known)):
        up = forest.roots()
        n = sizes[i]
        rest = np.arange(known) if known else np.arange(i + 1, len(sets))
        rest = rest[up[rest] != up[i]]
        rest = rest[np.minimum(sizes[rest], n) >= similarity * np.maximum(sizes[rest], n) - 1e-9]
        if not len(rest):
            continue
        mark[flat[starts[i] : ends[i]]] = True
        got = sizes[rest]
        at = np.cumsum(got) - got
        same = np.add.reduceat(mark[flat[np.repeat(starts[rest] - at, got) + np.arange(got.sum())]], at, dtype=np.int64)
        mark[flat[starts[i] : ends[i]]] = False
        rest = rest[same >= similarity * (n + got - same) - 1e-9]
        forest.union(rest, np.full(len(rest), i))
    return forest.roots()


def candidates(distinct: DataFrame, words: int, parts: int, rows_per_partition: int = 100_000) -> DataFrame:
    """Bands (set, band, word, lead) of a table of distinct fingerprints (set, print): what is joined within BITS[parts] bits
    under a root of the tries. lead is the smallest of the band's sets."""
    width, n = 64 // parts, distinct.count()
    # Roots travel together by the upper bits of their value, packed: a set and two words an entry.
    upper = min(width, (n // 16_384).bit_length())

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("set").to_numpy()
            prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), "<u8").reshape(len(own), words)
            for w in range(words):
                group, data = [], []
                entry = np.stack([own.view(np.uint64), prints[:, w], prints[:, (w + 1) % words]], axis=1)
                for j in range(parts):
                    at = (prints[:, w] << U(j * width) >> U(64 - upper)).astype(np.int64) if upper else np.zeros(len(own), np.int64)
                    order = np.argsort(at, kind="stable")
                    edge = np.flatnonzero(np.diff(at[order], prepend=-1)).tolist()
                    for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
                        group.append((w * parts + j) << width | int(at[order[a]]))
                        data.append(entry[order[a:b]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(data, pa.binary())], ["group", "data"])

    def join(batches):
        part, held = [], []
        for b in batches:
            part += (b.column("group").to_numpy() >> width).tolist()
            held += [np.frombuffer(d, "<u8").reshape(-1, 3) for d in b.column("data").to_pylist()]
        if not held:
            return
        part, held = np.repeat(np.array(part, np.int64), [len(h) for h in held]), np.concatenate(held)
        root = part.astype(np.uint64) << U(width) | held[:, 1] << (part % parts * width).astype(np.uint64) >> U(64 - width)
        order = np.lexsort((held[:, 2], held[:, 1], root))
        root, held = root[order], held[order]
        up = trie_join(root, held[:, 1:], BITS[parts], 1 << 16, neighbours=4).roots()
        some = np.flatnonzero(np.bincount(up, minlength=len(up))[up] > 1)
        band = mix(mix(held[up[some], 0]) ^ root[some])
        # Bands of a group have few leads if each is its band's smallest set: few different links to find clusters by.
        own = held[:, 0].view(np.int64)
        low = own.copy()
        np.minimum.at(low, up, own)
        lead = low[up[some]]
        yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(band.view(np.int64)), pa.array((root[some] >> U(width)).astype(np.int64) // parts), pa.array(lead)], ["set", "band", "word", "lead"])

    partitions = max(4, -(-n * words * parts // rows_per_partition))
    return distinct.mapInArrow(deal, "group long, data binary").repartition(partitions, "group").mapInArrow(join, "set long, band long, word long, lead long")


def keyed(ident, row) -> list:
    """KEYS of a row from its id and the hash of its text."""
    return [ident.isNull().alias("null"), F.coalesce(ident, F.lit(0)).alias("id"), row.alias("hash")]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 1024, hashes: int = 1 << 21, rows_per_partition: int = 10_000) -> DataFrame:
    """One row per row of docs: doc_id, row (hash of the text), group (a key that near copies share). A block has about
    `block` entries and `hashes` shingles at most."""
    slim = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), F.coalesce(quoted(docs, text_col).cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("row", F.xxhash64("text"))

    def prints():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, found, prints = prints_of(texts(batch), shingle, words)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([len(f) for f in found], pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary())], ["doc_id", "row", "set", "size", "print"])

        return step

    def compare(batches):
        part, names, held, known = None, [], [], 0

        def links():
            up = linked(held, similarity, known)
            k = known + np.flatnonzero(up[known:] != np.arange(known, len(up)))
            own = np.array(names, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[k]), pa.array(own[up[k]])], ["u", "v"])

        for b in (piece for batch in batches for piece in pieces(batch, "text")):
            for key, side, name, data in zip(*(b.column(c).to_pylist() for c in ("part", "side", "set")), prints_of(texts(b), shingle, 0)[1], strict=True):
                if key != part:
                    if len(held) > 1:
                        yield links()
                    part, names, held, known = key, [], [], 0
                names.append(name)
                held.append(data)
                known += side == KNOWN
        if len(held) > 1:
            yield links()

    def compared(each: DataFrame) -> DataFrame:
        """Links of rows (set, part, side): in a part, entries that are known to be one component come first."""
        # One row of docs stands for each set that is compared. Join and ranks have the same keys, so that texts are dealt
        # once to be found and once to their parts.
        stands = cut(each.groupBy("set").agg(F.collect_list(F.struct("part", "side")).alias("places")).join(distinct.select("set", *keyed(F.col("r.doc_id"), F.col("r.row"))), "set"))
        partitions = max(4, -(-(stands.agg(F.sum(F.size("places"))).first()[0] or 0) // rows_per_partition))
        rows = slim.select(*keyed(F.col("doc_id"), F.col("row")), "text")
        rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("text"))
        shown = rows.where(sieve(stands, KEYS)).join(stands, KEYS).withColumn("rank", rank).where("rank = 1")
        shown = shown.select("set", "text", F.explode("places").alias("p")).select("set", "text", "p.part", "p.side")
        return shown.repartition(partitions, "part").sortWithinPartitions("part", "side").mapInArrow(compare, "u long, v long")

    def blocks(n: str, total: str):
        """How many blocks n entries with so many shingles make."""
        return F.least(F.greatest(F.ceil(F.col(n) / F.lit(block)), F.ceil(F.col(total) / F.lit(hashes)), F.lit(1)), F.greatest(F.col(n), F.lit(1))).cast("int")

    def place(seed: int, n: str):
        """The block of an entry among n."""
        return F.pmod(F.xxhash64("set", F.lit(seed)), F.col(n)).cast("int")

    words, parts = next((w, p) for most, w, p in PLANS if slim.count() <= most)
    all_rows = cut(map_pieces(slim, prints, "doc_id long, row long, set long, size long, print binary"))
    distinct = cut(all_rows.where("size > 0").groupBy("set").agg(F.first("size").alias("size"), F.first("print").alias("print"), F.min(F.struct("row", "doc_id")).alias("r")))
    entries = cut(candidates(distinct, words, parts))
    all_rows = all_rows.drop("print")
    few = words // 4

    def blocked(entries: DataFrame) -> DataFrame:
        """Entries (set, size, band) of different bands with the number of blocks of their band."""
        bands = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("members"), F.min("set").alias("low")).where("n > 1")
        bands = bands.groupBy("n", "total", "members", "low").agg(F.min("band").alias("band"))
        return cut(entries.join(bands.select("band", blocks("n", "total").alias("b")), "band"))

    def dealt(members: DataFrame) -> DataFrame:
        """Links in blocks; bands of several blocks are cut twice."""
        each = members.withColumn("seed", F.explode(F.when(F.col("b") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        return compared(each.select("set", F.xxhash64("band", "seed", F.pmod(F.xxhash64("set", "seed"), F.col("b"))).alias("part"), F.lit(ALL).alias("side")))

    def settled(entries: DataFrame, known: DataFrame) -> DataFrame:
        """(id, component) of the links in bands, and of those known."""
        members = blocked(entries)
        whole = components(dealt(members).unionByName(known.select(F.col("id").alias("u"), F.col("component").alias("v"))))
        # Bands of several blocks that are not one component: rows of the largest one (known) and the others.
        open_ = members.where("b > 1").join(whole, F.col("set") == F.col("id"), "left").select("band", "set", "size", F.coalesce("component", "set").alias("c"))
        sizes = open_.groupBy("band", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("ks"))
        sizes = sizes.groupBy("band").agg(F.max(F.struct("k", "c", "ks")).alias("m"), F.sum("k").alias("n"), F.sum("ks").alias("t")).where("n > m.k")
        sizes = sizes.select("band", F.col("m.c").alias("main"), F.col("m.k").alias("k"), F.col("m.ks").alias("ks"), (F.col("n") - F.col("m.k")).alias("o"), (F.col("t") - F.col("m.ks")).alias("os"))
        open_ = cut(open_.join(sizes.select("band", "main", blocks("k", "ks").alias("bm"), blocks("o", "os").alias("bo")), "band"))
        if not open_.isEmpty():
            upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
            inside = open_.where("c = main").select("set", "band", place(2, "bm").alias("own"), upto("bo"))
            outside = open_.where("c <> main").select("set", "band", "bm", "bo", place(2, "bo").alias("own"))
            met = outside.select("set", "band", "own", upto("bm"))
            among = outside.select("set", "band", "own", upto("bo"))
            second = inside.select("set", F.xxhash64("band", F.lit("met"), "own", "other").alias("part"), F.lit(KNOWN).alias("side"))
            second = second.unionByName(met.select("set", F.xxhash64("band", F.lit("met"), "other", "own").alias("part"), F.lit(OTHER).alias("side")))
            second = second.unionByName(among.select("set", F.xxhash64("band", F.lit("among"), F.least("own", "other"), F.greatest("own", "other")).alias("part"), F.lit(ALL).alias("side")))
            whole = components(compared(second).unionByName(whole.select(F.col("id").alias("u"), F.col("component").alias("v"))))
        return whole

    clusters = components(entries.select(F.col("set").alias("u"), F.col("lead").alias("v")))
    clusters = blocked(clusters.select(F.col("id").alias("set"), F.col("component").alias("band")).join(distinct.select("set", "size"), "set"))
    whole = cut(components(dealt(clusters)))

    def unsettled(entries: DataFrame, whole: DataFrame) -> DataFrame:
        """Entries of bands that are not one component, in clusters of several blocks."""
        state = clusters.select("set", "size", "b").join(whole, F.col("set") == F.col("id"), "left").select("set", "size", "b", F.coalesce("component", "set").alias("c"))
        rest = entries.select("set", "band", "word").join(state, "set")
        split = rest.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("b").alias("b")).where("lo <> hi and b > 1").select("band")
        return cut(rest.select("set", "size", "band", "word").join(split, "band", "left_semi"))

    rest = unsettled(entries, whole)
    if not rest.isEmpty():
        whole = cut(settled(rest.where(F.col("word") < few).drop("word"), whole))
        rest = unsettled(rest.where(F.col("word") >= few).drop("size"), whole)
        if not rest.isEmpty():
            whole = settled(rest.drop("word"), whole)
    return all_rows.join(whole, all_rows["set"] == whole["id"], "left").select("doc_id", "row", F.coalesce("component", "set").alias("group"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, that stay: one of each group of near copies, that with the smallest
    id (of different texts of that id any, always the same one; a null id comes last)."""
    low = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("low")
    found = cut(groups(docs, id_col, text_col, shingle, similarity))
    kept = cut(found.groupBy("group").agg(low).select(*keyed(F.col("low.doc_id"), F.col("low.row"))))
    # A row whose keys no other row has and which is kept stays where it is; only the others are dealt.
    times = found.select(*keyed(F.col("doc_id"), F.col("row"))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    doubt = cut(times.join(kept.withColumn("kept", F.lit(True)), KEYS, "left").where("kept is null or n > 1").select(*KEYS))
    row = F.xxhash64(F.coalesce(quoted(docs, text_col).cast("string"), F.lit("")))
    rows = docs.select(*keyed(quoted(docs, id_col).cast("long"), row), F.struct(*(quoted(docs, c) for c in docs.columns)).alias("row"))
    doubtful = sieve(doubt, KEYS)
    # Join and ranks have the same keys, so that texts are dealt once.
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("row").getField(text_col)))
    dealt = rows.where(doubtful).join(kept, KEYS, "left_semi").select("row", rank.alias("rank")).where("rank = 1")
    return rows.where(~doubtful).select("row.*").union(dealt.select("row.*"))
