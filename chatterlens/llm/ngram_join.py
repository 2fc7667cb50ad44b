"""N-gram Jaccard self-join of documents by a grouped prefix join, and the components of its links.

1. Documents with equal shingle sets are one class; all further work is on classes.
2. A class can only have a partner if enough of its shingles stand in other classes. The 30 % of its shingles with the
   smallest hashes decide, as far as they are among the partner's 30 % as well: of the two samples, all shared shingles of
   the one that ends first lie in the other, so the least of both sizes less what the partner may miss must be shared.
   Hashes are dealt to buckets in packed form; a hash that several classes of one batch hold is handed on once.
3. Prefix join of what is left: shingles in order of rising frequency; partners share a shingle within their prefixes.
   Classes with identical prefixes and sizes collapse into one group, groups meet through their prefix shingles, pairs
   of groups are filtered by size and position, then expanded to members and verified on the whole sets.
4. A group of near copies is not compared all with all. First every member is verified against one leader per prefix
   shingle, the class with the fewest rare shingles; then, until nothing is left, members outside the largest component
   of a shingle's list against all members of other components that pass a bound from parity bitmaps. Pairs that are
   already connected need no comparison,
   so the links found span every component, and no link between two components is missed.

Two classes link when 100 * intersection >= 80 * union (parameters).

Defined results: a text without words, or null, has an empty set and is linked with nothing; one with fewer words than
the shingle length has the whole sequence as its only shingle; rows with a null id get a null component and take part in
no link; rows with equal ids are linked by their texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlens.llm.base import map_texts, row_key, small_batches, written
from chatterlens.llm.components import components

#: Share of a set, in per cent, that is looked at before the join.
SAMPLE = 30
SHINGLES_PER_GROUP = 500_000
LEAST_GROUPS = 64
CODES_PER_BUCKET = 400_000
LEAST_BUCKETS = 256
WORDS = 8  # 64-bit words of a parity bitmap
SHARED = np.iinfo(np.int64).min  # stands for several classes of one batch

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SEED = np.random.default_rng(20_240_229)  # fixed: equal words hash equally on every worker
_BYTE = _SEED.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_PLACE = _SEED.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the hash's base and of its inverse (modulo 2^64), as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n, _STEP)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n, inverse)), dtype=np.uint64)
        return self.up[:n], self.down


POWERS = Powers()


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word, by differences of prefix sums."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64)
    up, down = POWERS.upto(len(raw))
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[raw] * up, dtype=np.uint64))
    return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_set(text: str, size: int) -> np.ndarray:
    """The hashes of the distinct shingles of a text, ascending."""
    words = word_hashes(text.encode().lower())
    if not len(words):
        return words
    n = min(size, len(words))
    made = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        made = made + words[k : len(words) - n + 1 + k] * _PLACE[k]
    return np.unique(_mixed(made))


def signature(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def least_overlap(n, percent: int):
    """The fewest shingles that a set of n shares with any partner: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def least_sampled(n: Column, percent: int) -> Column:
    """The fewest shingles that the samples of a set of n and of any partner have in common.

    With i shingles shared by sets of n and m, the sample that ends at the smaller hash has all its shared shingles in the
    other one: ceil(.3 n) - (n - i) or ceil(.3 m) - (m - i) at least. The first is least for the smallest partner. The
    second falls by 0.2 or more a step of m but for two roundings, so it is least for one of the ten largest partners.
    """

    def ceiling(x: Column, by: int) -> Column:
        return F.ceil(x / by).cast("long")

    def shared(m: Column) -> Column:
        return ceiling(percent * (n + m), 100 + percent)

    least, most = ceiling(percent * n, 100), F.floor(100 * n / percent).cast("long")
    bounds = [ceiling(SAMPLE * n, 100) - n + shared(least)]
    for k in range(11):
        m = F.greatest(most - k, least)
        bounds.append(ceiling(SAMPLE * m, 100) - m + shared(m))
    return F.least(*bounds)


def sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, sig, row_key) of every document: the size of its shingle set, a signature of the set, a hash of the text."""

    def work():
        def function(texts: list[str]) -> dict:
            found = [shingle_set(t, size) for t in texts]
            return {"n": np.array(list(map(len, found)), np.int64), "sig": pa.array([signature(s) for s in found], pa.binary())}

        return function

    return map_texts(docs, id_col, text_col, work, "n long, sig binary", key=row_key(text_col)).withColumnRenamed(id_col, "id")


def promising(docs: DataFrame, classes: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The classes with enough shared shingles among those with the smallest hashes."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total * SAMPLE // 100 // CODES_PER_BUCKET)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            names, parts = [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, size)
                if len(s) and (name := int.from_bytes(signature(s)[:8], "big", signed=True)) not in met:
                    met.add(name)
                    names.append(name)
                    parts.append(s[: -(-SAMPLE * len(s) // 100)])
            if not names:
                continue
            codes = np.concatenate(parts)
            holder = np.repeat(np.array(names, np.int64), list(map(len, parts)))
            order = np.argsort(codes, kind="stable")
            codes, holder = codes[order], holder[order]
            same = np.append(codes[1:] == codes[:-1], False)
            again = np.append(False, same[:-1])
            inside, n_inside = np.unique(holder[same | again], return_counts=True)
            posted = ~again  # one posting per code, without a class if several hold it
            codes, holder = codes[posted], np.where(same, SHARED, holder)[posted]
            bucket = (codes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, codes, holder = bucket[order], (codes[order] >> np.uint64(16)).astype(np.uint32), holder[order]
            own = np.mod(inside, buckets)
            rows = []
            for b in np.unique(np.append(bucket, own)):
                lo, hi = np.searchsorted(bucket, [b, b + 1])
                here = own == b
                counts = n_inside[here].astype(np.int64)
                rows.append((int(b), *(x.tobytes() for x in (codes[lo:hi], holder[lo:hi], inside[here], counts))))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), *[pa.binary()] * 4])]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "codes", "holders", "inside", "counts"])

    def count(group: pa.Table) -> pa.Table:
        kinds = {"codes": np.uint32, "holders": np.int64, "inside": np.int64, "counts": np.int64}
        codes, holders, inside, counts = (np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in kinds.items())
        order = np.lexsort((holders, codes))
        codes, holders = codes[order], holders[order]
        found = np.empty(0, np.int64)
        if len(codes):
            start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            sizes = np.diff(np.append(start, len(codes)))
            shared = np.repeat(holders[start] != holders[start + sizes - 1], sizes)
            fresh = np.append(True, (codes[1:] != codes[:-1]) | (holders[1:] != holders[:-1]))
            found = holders[shared & fresh & (holders != SHARED)]
        names, at = np.unique(np.concatenate([found, inside]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(len(found)), counts]), minlength=len(names))
        return pa.table({"holder": names, "shared": total.astype(np.int64)})

    dealt = texts.mapInArrow(deal, "bucket long, codes binary, holders binary, inside binary, counts binary")
    shared = dealt.groupBy("bucket").applyInArrow(count, "holder long, shared long").groupBy("holder").agg(F.sum("shared").alias("shared"))
    holder = _as_long(F.col("sig"))
    # Where partners may miss a whole sample, classes that share nothing in theirs stay as well.
    joined = classes.join(shared, holder == F.col("holder"), "inner" if 100 - percent < SAMPLE else "left")
    return joined.filter(F.coalesce("shared", F.lit(0)) >= least_sampled(F.col("n"), percent)).select(*classes.columns)


def _as_long(sig: Column) -> Column:
    """The first eight bytes of a signature as the number that the tasks use."""
    digits = F.hex(F.substring(sig, 1, 8))
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def shingles_of(docs: DataFrame, chosen: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(sig, n, shingles) of the chosen classes, from the text of one document each; twice where an id is repeated."""
    spark = docs.sparkSession
    small_batches(spark)
    # Spark's own runtime filter keeps the texts that are not chosen out of the shuffle; its rule wants a selective side.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "16MB")
    wanted = chosen.filter("n > 0").select(F.col("least_id").alias("id"), "sig")
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(sig, shingle_set(text or "", size)) for text, sig in zip(batch.column("text").to_pylist(), batch.column("sig").to_pylist())]
            found = [(sig, s) for sig, s in found if signature(s) == sig]  # not another text with the same id
            if found:
                sigs, sizes = pa.array([g for g, _ in found], pa.binary()), pa.array([len(s) for _, s in found], pa.int64())
                arrays = pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([sigs, sizes, arrays], names=["sig", "n", "shingles"])

    return pair.mapInArrow(run, "sig binary, n long, shingles array<long>")


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bitmap whose bits tell whether an odd number of shingles hash to them.

    Two bitmaps differ in at most as many bits as there are shingles in one of the sets only.
    """
    bits = np.bincount((shingles >> np.uint64(20) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def shingle_counts(keyed: DataFrame, buckets: int) -> DataFrame:
    """(key, shingles, counts): in how many sets the shingles of a group of sets occur in all, for those in two or more.

    Each group hands on every shingle once, with its own count, to the shingle's bucket, and gets the sum back.
    """

    def deal(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        once = dict(zip(group.column("sig").to_pylist(), range(group.num_rows)))
        flat = group.column("shingles").take(pa.array(list(once.values()))).combine_chunks().flatten().to_numpy().view(np.uint64)
        shingles, counts = np.unique(flat, return_counts=True)
        bucket = (shingles >> np.uint64(13)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        some = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
        parts = [order[bounds[b] : bounds[b + 1]] for b in some]
        return pa.table({
            "bucket": pa.array(some, pa.int64()), "key": pa.array([key] * len(some), pa.int64()),
            "shingles": pa.array([shingles[p].tobytes() for p in parts], pa.binary()),
            "counts": pa.array([counts[p].astype(np.uint32).tobytes() for p in parts], pa.binary()),
        })

    def add(group: pa.Table) -> pa.Table:
        shingles = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in group.column("counts").to_pylist()])
        names, at = np.unique(np.concatenate(shingles), return_inverse=True)
        total = np.bincount(at, counts, minlength=len(names)).astype(np.int64)[at]
        rows, begin = [], 0
        for s in shingles:
            sums = total[begin : begin + len(s)]
            rows.append((s[sums > 1].tobytes(), sums[sums > 1].astype(np.uint32).tobytes()))
            begin += len(s)
        names_of, counts_of = (pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))
        return pa.table({"key": group.column("key"), "shingles": names_of, "counts": counts_of})

    dealt = keyed.groupBy("key").applyInArrow(deal, "bucket long, key long, shingles binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(add, "key long, shingles binary, counts binary")


def prefixes(chosen: DataFrame, percent: int) -> DataFrame:
    """(sig, n, shingles, rare, grp, prefix, places, w0 ..) of the classes that can have a partner, each once.

    ``prefix`` holds the prefix shingles that stand in another set as well, ``places`` their positions in the order of
    rising frequency; ``rare`` is how many shingles stand in no other set; ``grp`` names the whole prefix and the size;
    ``w0`` and so on are the words of the parity bitmap.
    """
    total = chosen.agg(F.sum("n")).first()[0] or 0
    groups = max(LEAST_GROUPS, total // SHINGLES_PER_GROUP)
    keyed = chosen.select(F.pmod(F.xxhash64("sig"), F.lit(groups)).cast("long").alias("key"), "sig", "shingles")
    words = [f"w{i}" for i in range(WORDS)]
    names = ["sig", "n", "shingles", "rare", "grp", "prefix", "places", *words]
    numbers = pa.list_(pa.int64())
    kinds = [pa.binary(), pa.int64(), numbers, pa.int64(), pa.binary(), numbers, numbers, *[pa.int64()] * WORDS]

    def cut(sets_of: pa.Table, counts: pa.Table) -> pa.Table:
        known = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in counts.column("shingles").to_pylist())])
        often = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(b, np.uint32) for b in counts.column("counts").to_pylist())])
        order = np.argsort(known)
        known, often = np.append(known[order], np.uint64(2**64 - 1)), np.append(often[order], np.uint32(1))
        rows, column = [], sets_of.column("shingles")
        for sig, row in dict(zip(sets_of.column("sig").to_pylist(), range(sets_of.num_rows))).items():
            s = column[row].values.to_numpy().view(np.uint64)
            at = np.searchsorted(known, s)
            count = np.where(known[at] == s, often[at], 1)
            n, rare = len(s), int(np.count_nonzero(count == 1))
            if n - rare < least_overlap(n, percent):
                continue
            first = np.lexsort((s, count))[: n - least_overlap(n, percent) + 1]
            shared = np.flatnonzero(count[first] > 1)
            prefix = s[first]
            name = xxhash.xxh3_128_digest(prefix.tobytes() + n.to_bytes(8, "little"))
            rows.append((sig, n, s.view(np.int64), rare, name, prefix[shared].view(np.int64), shared, *parity(s).tolist()))
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)

    made = "sig binary, n long, shingles array<long>, rare long, grp binary, prefix array<long>, places array<long>, " + ", ".join(f"{w} long" for w in words)
    return keyed.groupBy("key").cogroup(shingle_counts(keyed, groups).groupBy("key")).applyInArrow(cut, made)


def may_link(percent: int, n1: str, p1: str, n2: str, p2: str) -> Column:
    """Size and position filter of two sets that share a shingle at the given places of their orders."""
    sizes = (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
    most = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2))
    return sizes & ((100 + percent) * most >= percent * (F.col(n1) + F.col(n2)))


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    left = members.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = members.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter((100 + percent) * both >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def links(chosen: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that span every component of the similarity graph."""
    members = written(prefixes(chosen, percent), "prefixes")
    # Members of one group have the same prefix and size; the group's head speaks for it.
    groups = written(members.groupBy("grp", "n").agg(F.min(F.struct("rare", "sig", "prefix", "places")).alias("h")).select(
        "grp", "n", "h.rare", F.col("h.sig").alias("head"), "h.prefix", "h.places"), "groups")
    spread = groups.select("grp", "n", "rare", "head", F.explode(F.arrays_zip("prefix", "places")).alias("x")).select(
        "grp", "n", "rare", "head", F.col("x.prefix").alias("shingle"), F.col("x.places").alias("place"))
    postings = written(spread, "postings")

    # First the members of a group against its head, and the groups of a shingle's list against the list's leader.
    inside = members.join(groups.select("grp", "n", "head"), ["grp", "n"]).filter("sig <> head")
    inside = inside.select(F.col("sig").alias("a"), F.col("head").alias("b"))
    least = postings.groupBy("shingle").agg(F.min(F.struct("rare", "head", "n", "place")).alias("l"), F.count("*").alias("c"))
    leader = written(least.filter("c > 1").select(
        "shingle", F.col("l.head").alias("l_head"), F.col("l.n").alias("l_n"), F.col("l.place").alias("l_place")), "leaders")
    led = postings.join(leader, "shingle").filter((F.col("head") != F.col("l_head")) & may_link(percent, "n", "place", "l_n", "l_place"))
    led = led.select("grp", "n", "l_head").distinct()
    led = members.select("sig", "grp", "n").join(led, ["grp", "n"]).select(F.col("sig").alias("a"), F.col("l_head").alias("b"))
    found = written(verified(inside.unionByName(led).distinct(), members, percent), "found")

    # Then what these links leave apart: members outside the largest component of a list against the other components.
    roots = written(components(found), "roots")
    words = [f"w{i}" for i in range(WORDS)]
    placed = members.select("sig", "grp", "n", *words).join(roots, F.col("sig") == F.col("node"), "left").select(
        "grp", "n", "sig", F.coalesce("root", "sig").alias("root"), *words)
    placed = written(placed, "placed")
    narrow = postings.select("grp", "n", "shingle", "place")
    parts = narrow.join(placed.select("grp", "n", "root"), ["grp", "n"]).groupBy("shingle", "root").agg(F.count("*").alias("c"))
    lists = parts.groupBy("shingle").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("roots"))
    largest = written(lists.filter("roots > 1").select("shingle", "main"), "largest")
    several = written(written(narrow.join(largest, "shingle"), "lists").join(placed, ["grp", "n"]), "several")
    loose = several.filter("root <> main").select(
        "shingle", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("root").alias("ra"), *[F.col(w).alias(f"a{w}") for w in words])
    other = several.select(
        "shingle", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("root").alias("rb"), F.col("main").alias("mb"),
        *[F.col(w).alias(f"b{w}") for w in words])
    # The bitmaps bound how many shingles only one of the two sets has.
    differ = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in words[1:]), F.bit_count(F.col("aw0").bitwiseXOR(F.col("bw0"))))
    near = (100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))
    once = (F.col("rb") == F.col("mb")) | (F.col("a") < F.col("b"))
    fits = (F.col("ra") != F.col("rb")) & once & may_link(percent, "na", "pa", "nb", "pb") & near
    rest = loose.join(other, "shingle").filter(fits).select("a", "b").distinct()
    return found.unionByName(written(verified(rest, members, percent), "rest"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_shingles`` and ``component_id`` (the smallest id of the component) of every document.

    Two more columns follow: ``component``, a key of the component (null for documents that take part in no link), and
    ``row_key``, the hash of the text, for rows that share an id.
    """
    rows = written(sets(docs, size, id_col, text_col), "sets")
    full = rows.filter("n > 0 AND id IS NOT NULL")
    classes = written(full.groupBy("sig", "n").agg(F.min("id").alias("least_id")), "classes")
    chosen = promising(docs.filter(F.col(id_col).isNotNull()), classes, size, percent, id_col, text_col)
    chosen = written(shingles_of(docs, written(chosen, "promising"), size, id_col, text_col), "chosen")
    roots = components(links(chosen, percent))
    named = classes.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "least_id", F.coalesce("root", "sig").alias("root"))
    named = written(named, "named")
    least = written(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least-ids")
    by_class = written(named.join(least, "root").select(F.col("sig").alias("c_sig"), "component_id", F.col("root").alias("component")), "by-class")
    # A class that a third of all documents belong to is split by the skew join, both sides being shuffled.
    named_row = [F.col("id").alias(id_col), F.col("n").alias("n_shingles")]
    linked = full.join(by_class, F.col("sig") == F.col("c_sig")).select(*named_row, "component_id", "component", "row_key")
    none = F.lit(None).cast("binary").alias("component")
    alone = rows.filter("n = 0 OR id IS NULL").select(*named_row, F.col("id").alias("component_id"), none, "row_key")
    return linked.unionByName(alone)
