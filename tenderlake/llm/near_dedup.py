"""Near-duplicate classes by BagMinHash over weighted five-word shingles.

A document is the multiset of its five-word shingles (of all its words, if it has
fewer); two documents are linked if their multisets overlap by 0.8 or more: the sum of
smaller counts over the sum of larger ones. Classes are the connected documents.

BagMinHash: each shingle owns a Poisson process over (time, weight), split by weight
into the intervals 0-1, 1-2, 2-4, 4-8 ...; a document takes the points below its count.
The first point of each of m components is a signature that agrees between documents
with exactly the chance of their weighted overlap. Points arrive at a rate known from a
document's total, so only those up to the time when all components are settled are made.

1. Equal texts become one representative; signatures are kept per representative.
2. Bands of the signature are bucket keys. In each bucket the most popular member (the
   one that shares most buckets with others, as the original of a family does) is the
   centre, and every other member is compared with it: pairs grow with the members.
3. The overlap of pairs is computed from whole texts.
4. Classes of the links; buckets whose members are of one class are done. For the rest,
   see open_pairs.

Nodes of the graph are distinct texts, named by the smallest key that has the text. Where
keys repeat, a key's first text (by hash) has its name; every further text of it, and a
text that has null keys only, is named by a number above 2**62 made of its hash.

Defined results: null and empty texts are equal texts and make one class; a text without
words is linked to equal texts only; rows that repeat are members of one class; a key with
several texts is a member of the class of each; a class id is the smallest name in its
class, so a class whose texts all have made names has such a number as its id; an empty
table gives an empty one. Keys are integers (others are cast, and null if they can't be);
texts of any length are compared whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ALNUM, U64, Texts, drop, fields, gram_hashes, join_counted, mix, slices, stored
from .components import components

SHINGLE = 5
#: Bands times rows are the components of a signature. A pair of overlap 0.8 shares no band with chance (1 - 0.8**4)**20 = 3e-5.
BANDS, ROWS = 20, 4
LOW48 = U64((1 << 48) - 1)


def shingle_counts(texts: Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 48-bit shingle hash, count) of each distinct shingle, in that order."""
    words = texts.words(ALNUM, fold=True)
    grams, inside = words.grams(shingle)
    owner = words.owner()
    hashes, docs = grams[inside], owner[: len(grams)][inside]
    lengths = np.diff(words.doc)
    for k in range(1, shingle):
        first = words.doc[:-1][lengths == k]
        if len(first):
            got = gram_hashes(words.hashes, k)[first] + U64(k)
            hashes, docs = np.append(hashes, got), np.append(docs, np.flatnonzero(lengths == k))
    out = [], [], []
    for low in range(0, len(texts), 1 << 16):  # document numbers of 16 bits
        here = slice(None) if len(texts) <= 1 << 16 else (docs >= low) & (docs < low + (1 << 16))
        key = np.sort((docs[here] - low).astype(np.uint64) << U64(48) | hashes[here] >> U64(16))
        heads = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
        out[0].append((key[heads] >> U64(48)).astype(np.int64) + low)
        out[1].append(key[heads] & LOW48)
        out[2].append(np.diff(np.append(heads, len(key))))
    return tuple(np.concatenate(x) for x in out) if out[0] else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


#: Points that are made at once, about.
POINTS = 600_000


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures, n_docs by m, of weighted sets in the order of documents; those without elements have zeros."""
    step = max(16, int(POINTS / (m * (np.log(m) + 6))))
    cuts = np.searchsorted(doc, np.arange(0, n_docs + step, step))
    parts = [_bag_minhash(doc[a:b] - k * step, element[a:b], weight[a:b], min(step, n_docs - k * step), m) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if k * step < n_docs]
    return np.concatenate(parts) if parts else np.zeros((0, m), np.uint32)


def _bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    out = np.zeros((n_docs, m), np.uint32)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    # one entry for each weight interval that an element reaches: [0, 1), [1, 2), [2, 4) ...
    level = np.zeros(len(doc), np.int64)
    level[weight > 1] = np.ceil(np.log2(weight[weight > 1])).astype(np.int64)
    rows = np.repeat(np.arange(len(doc)), level + 1)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    width = np.where(k == 0, 1, 1 << np.maximum(k - 1, 0)).astype(np.float64)
    floor = np.where(k == 0, 0, width)
    seed = mix(element[rows] + k.astype(np.uint64) * U64(0xD1B54A32D192ED03))
    owner, limit_weight = doc[rows], weight[rows]
    horizon = np.where(total > 0, (np.log(m) + 6.0) / np.maximum(total, 1), 0.0)
    open_docs = np.flatnonzero(total > 0)
    while len(open_docs):
        chosen = np.isin(owner, open_docs) if len(open_docs) < n_docs else np.ones(len(owner), bool)
        slots, times, ids = _points(seed[chosen], owner[chosen], width[chosen], floor[chosen], limit_weight[chosen], horizon, m)
        best = np.full(n_docs * m, np.inf)
        np.minimum.at(best, slots, times)
        first = times == best[slots]
        flat = out.reshape(-1)
        flat[slots[first]] = ids[first]
        missing = np.isinf(best.reshape(n_docs, m)).any(axis=1)
        open_docs = open_docs[missing[open_docs]]
        horizon[open_docs] *= 2
    return out


def _points(seed: np.ndarray, owner: np.ndarray, width: np.ndarray, floor: np.ndarray, most: np.ndarray, horizon: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document * m + component, time, id) of all points up to the documents' horizons.

    Entries make their points in blocks of about as many as they are expected to have.
    """
    rate = m * width
    expected = rate * horizon[owner]
    size = np.minimum(np.ceil(np.log2(np.maximum(expected, 0.25) * 1.3 + 1)).astype(np.int64), 9)
    slots, times, ids = [], [], []
    for s in np.unique(size):
        live = np.flatnonzero(size == s)
        g = 1 << int(s)
        at, index = np.zeros(len(live)), 0
        while len(live):
            step = np.arange(index, index + g, dtype=np.uint64)
            h = mix(seed[live][:, None] ^ mix((step + U64(1)) * U64(0x9E3779B97F4A7C15))[None, :])
            gap = -np.log((h >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate[live][:, None]
            t = at[:, None] + np.cumsum(gap, axis=1)
            other = mix(h + U64(0x632BE59BD9B4E019))
            component = (other & U64(0xFFFFFF)) * U64(m) >> U64(24)
            # the place in the interval halves it again and again: a hierarchy of weights down to units
            place = (other >> U64(24)).astype(np.float64) * 2.0**-40
            fits = (t <= horizon[owner[live]][:, None]) & (floor[live][:, None] + np.floor(place * width[live][:, None]) < most[live][:, None])
            r, c = np.nonzero(fits)
            slots.append(owner[live][r] * m + component[r, c].astype(np.int64))
            times.append(t[r, c])
            ids.append((h[r, c] >> U64(7)).astype(np.uint32))
            more = t[:, -1] <= horizon[owner[live]]
            live, at, index = live[more], t[more, -1], index + g
    return np.concatenate(slots), np.concatenate(times), np.concatenate(ids)


#: Texts whose signatures a task remembers, so that a text's copies in it are signed once.
REMEMBERED = 50_000


def _signatures(text: str, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, text):
                # the bands of a text go out once, and null for its further copies
                fps = batch.column(1).to_pylist()
                new = []
                for i, fp in enumerate(fps):
                    if fp not in seen:
                        seen.add(fp)
                        new.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                texts = Texts(batch.column(batch.schema.get_field_index(text)).take(pa.array(new, pa.int64())))
                doc, element, weight = shingle_counts(texts)
                signature = bag_minhash(doc, element, weight, len(texts), bands * rows)
                some = np.bincount(doc, minlength=len(texts)) > 0
                # rows of a band are mixed into one 64-bit key
                keys = gram_hashes(np.ascontiguousarray(signature).reshape(-1).astype(np.uint64), rows)[::rows].reshape(len(texts), bands) if len(texts) else np.zeros((0, bands), np.uint64)
                packed: list[bytes | None] = [None] * len(fps)
                for i, k, s in zip(new, keys, some):
                    packed[i] = k.tobytes() if s else b""
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "fp", "bands"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column("bands").to_pylist()
        n = np.array([len(b) // 8 for b in blobs])
        keys = np.frombuffer(b"".join(blobs), np.int64)
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), n)
        band = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([pa.array(band, pa.int32()), pa.array(keys), pa.array(ids, pa.int64())], ["band", "bucket", "id"])


def overlaps(a: Texts, b: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the sums of smaller and of larger shingle counts of two texts."""
    da, ea, wa = shingle_counts(a)
    db, eb, wb = shingle_counts(b)
    order_a = np.lexsort((ea, da))
    da, ea, wa = da[order_a], ea[order_a], wa[order_a]
    # one number per (row, shingle), comparable between the sides
    ka = mix(ea + da.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    kb = mix(eb + db.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    by = np.argsort(ka)
    place = np.searchsorted(ka[by], kb)
    place = by[np.minimum(place, max(len(by) - 1, 0))] if len(by) else np.zeros(len(kb), np.int64)
    same = (ka[place] == kb) if len(by) else np.zeros(len(kb), bool)
    shared = np.bincount(db[same], weights=np.minimum(wa[place[same]], wb[same]), minlength=len(a))
    total = np.bincount(da, weights=wa, minlength=len(a)) + np.bincount(db, weights=wb, minlength=len(a))
    return shared, total - shared


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (b for a in slices(whole, "text_b") for b in slices(a, "text_a")):
                low, high = overlaps(Texts(batch.column(batch.schema.get_field_index("text_a"))), Texts(batch.column(batch.schema.get_field_index("text_b"))))
                near = pa.array((high > 0) & (low >= threshold * high - 1e-9))
                yield batch.select(["a", "b"]).filter(near)

    return run


EDGES = T.StructType(fields(a="long", b="long"))


def linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts overlap enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    return join_counted(pairs.join(right, "b"), left, ["a"], counts, "_n").select("a", "b", "text_a", "text_b").mapInArrow(_verify(threshold), EDGES)


def _named(fp: Column) -> Column:
    return F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(fp), 3)


def _whole(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, fp, text) of all rows; id is null where the key is."""
    whole = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return whole.select("id", F.unhex(F.md5("text")).alias("fp"), "text")


def representatives(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """(id, fp, n, bands, node) of each distinct text: its smallest key, hash, rows, bands and name; and where it is stored."""
    signed = _whole(docs, key, text).mapInArrow(_signatures("text", BANDS, ROWS), T.StructType(fields(id="long", fp="binary", bands="binary")))
    reps = signed.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("bands", ignorenulls=True).alias("bands"))
    reps, path = stored(reps.withColumn("node", F.coalesce("id", _named(F.col("fp")))), "representatives")
    again = reps.groupBy("node").agg(F.min("fp").alias("_first"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
    if again.limit(1).count():
        again, again_path = stored(again, "repeated-keys")
        counted = reps.groupBy("node").agg(F.count(F.lit(1)).alias("_m")).where("_m = 1").select("node", "_m", F.lit(None).cast("binary").alias("_first"))
        named = again.select("node", "_m", "_first").unionByName(counted)
        named = join_counted(reps, named, ["node"], named, "_m")
        named = named.withColumn("node", F.when(F.col("_first").isNull() | (F.col("_first") == F.col("fp")), F.col("node")).otherwise(_named(F.col("fp"))))
        old = path
        reps, path = stored(named.select("id", "fp", "n", "bands", "node"), "representatives")
        drop(docs.sparkSession, old, again_path)
    return reps, path


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of each bucket's centre and every other member; members: (band, bucket, id, m), m of the bucket."""
    popular = members.groupBy("id").agg(F.sum("m").alias("popular"))
    ranked = members.join(popular, "id").select("band", "bucket", "id", "m", F.struct("popular", (-F.col("id")).alias("less")).alias("place"))
    centres = ranked.groupBy("band", "bucket").agg(F.max("place").alias("top"), F.count(F.lit(1)).alias("_m")).select("band", "bucket", "_m", (-F.col("top.less")).alias("a"))
    pairs, _ = stored(join_counted(ranked, centres, ["band", "bucket"], centres, "_m").where("a <> id").select("a", F.col("id").alias("b")).distinct(), "pairs")
    return pairs


#: Components of the sharper signature for pairs that stars left open, in 8 bits each.
SHARP = 1024
#: Members of a block; larger buckets are compared block by block in tasks of their own.
BLOCK = 500


def _sharp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = Texts(batch.column(1))
            found = shingle_counts(texts)
            signature = bag_minhash(*found, len(texts), SHARP).astype(np.uint8)
            bands = bag_minhash(*found, len(texts), BANDS * ROWS).astype(np.uint64)
            keys = gram_hashes(bands.reshape(-1), ROWS)[::ROWS].reshape(len(texts), BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([x.tobytes() for x in signature], pa.binary())], ["id", "keys", "sharp"])


def _compare(least: int):
    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("component").to_numpy()
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        if len(part) > 1 and (part != part[0]).any():
            ids, block = rows.column("id").to_numpy(), rows.column("block").to_numpy()
            i, j, band = (rows.column(c)[0].as_py() for c in ("i", "j", "band"))
            keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint64).reshape(len(ids), -1)
            sharp = np.frombuffer(b"".join(rows.column("sharp").to_pylist()), np.uint8).reshape(len(ids), -1)
            # the smaller of two blocks is walked through
            order = np.argsort((block == (i if (block == i).sum() > (block == j).sum() else j)) if i != j else block, kind="stable")
            ids, part, keys, sharp, block = ids[order], part[order], keys[order], sharp[order], block[order]
            cut = len(ids) if i == j else int((block == block[0]).sum())
            for x in range(cut):
                low = x + 1 if i == j else cut
                other = np.flatnonzero(part[low:] != part[x]) + low
                # a pair belongs to the first band that it shares
                other = other[(keys[other] == keys[x]).argmax(axis=1) == band] if len(other) else other
                near = [other[k : k + 4096][(sharp[other[k : k + 4096]] == sharp[x]).sum(axis=1) >= least] for k in range(0, len(other), 4096)]
                other = np.concatenate(near) if near else other
                a.append(np.minimum(ids[other], ids[x]))
                b.append(np.maximum(ids[other], ids[x]))
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return run


def open_pairs(members: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """Pairs of different classes that share a bucket and may be linked, or None where no bucket has two classes.

    Sharper signatures of the members are compared inside the tasks; a pair leaves a task
    only if their agreement is within four standard deviations of the threshold. In each
    bucket the members of its largest class need only meet the rest: those and the rest
    are cut into blocks of about BLOCK members, and a task's group is a block of the rest
    with another block. Rows that are sent grow with the bucket times the blocks of its
    rest, so with the square only of members that no link has joined yet.
    """
    spark = members.sparkSession
    placed = members.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    kinds = placed.groupBy("band", "bucket", "component").agg(F.count(F.lit(1)).alias("_c"))
    several = kinds.groupBy("band", "bucket").agg(F.max(F.struct("_c", (-F.col("component")).alias("less"))).alias("_top"), F.sum("_c").alias("_m")).where("_top._c < _m")
    several = several.select("band", "bucket", "_m", F.col("_top._c").alias("_most"), (-F.col("_top.less")).alias("_main"))
    found, path = stored(join_counted(placed, several, ["band", "bucket"], several, "_m"), "open")
    if found.limit(1).count() == 0:
        drop(spark, path)
        return None
    sharp = texts.join(found.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(_sharp, T.StructType(fields(id="long", keys="binary", sharp="binary")))
    most, rest = F.ceil(F.col("_most") / BLOCK).cast("int"), F.ceil((F.col("_m") - F.col("_most")) / BLOCK).cast("int")
    main = F.col("component") == F.col("_main")
    place = F.xxhash64("id", F.lit(5))
    # blocks of the largest class have numbers below zero
    dealt = found.withColumn("block", F.when(main, -1 - F.pmod(place, most)).otherwise(F.pmod(place, rest)).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.when(main, 0).otherwise(-most), rest - 1)))
    dealt = dealt.select("band", "bucket", "id", "component", "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"))
    sigma = (threshold * (1 - threshold) / SHARP) ** 0.5
    least = int(np.floor(SHARP * (threshold - 4 * sigma)))
    pairs, _ = stored(dealt.join(sharp, "id").groupBy("band", "bucket", "i", "j").applyInArrow(_compare(least), EDGES), "pairs")
    drop(spark, path)
    return pairs


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(id, fp, n, node, class_id) of each distinct text, and (fp, n) alone."""
    spark = docs.sparkSession
    reps, _ = representatives(docs, key, text)
    bands = reps.select(F.col("node").alias("id"), "bands").mapInArrow(_unpack, T.StructType(fields(band="int", bucket="long", id="long")))
    shared = bands.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("m"))
    members, members_path = stored(join_counted(bands, shared, ["band", "bucket"], shared, "m").where("m > 1"), "members")
    wanted = reps.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("id", "fp", "node")
    texts = _whole(docs, key, text).withColumn("id", F.coalesce("id", F.lit(-1))).join(wanted.withColumn("id", F.coalesce("id", F.lit(-1))), ["id", "fp"]).select(F.col("node").alias("id"), "text")
    if _keys_repeat(docs, key):
        texts = texts.dropDuplicates(["id"])
    texts, texts_path = stored(texts, "texts")
    edges, edges_path = stored(linked(star_pairs(members), texts, threshold), "links", 100)
    classes, classes_path = stored(components(edges), "classes")
    drop(spark, edges_path)
    more = open_pairs(members, classes, texts, threshold)
    if more is not None:
        extra, extra_path = stored(linked(more, texts, threshold), "links", 100)
        if extra.limit(1).count():
            # each class shrinks to its id: links between classes join classes
            named = lambda side: extra.join(classes.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").select(*[c for c in extra.columns if c != side], F.coalesce(f"c{side}", side).alias(side))
            extra = named("a")
            extra = named("b")
            merged, merged_path = stored(components(extra), "classes")
            merged = merged.withColumnsRenamed({"node": "old", "component": "new"})
            sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
            moves = sizes.join(merged.withColumnRenamed("old", "component"), "component", "left")
            known = join_counted(classes, moves, ["component"], moves, "_n").select("node", F.coalesce("new", "component").alias("component"))
            classes, _ = stored(known.unionByName(merged.select(F.col("old").alias("node"), F.col("new").alias("component"))).distinct(), "classes")
            drop(spark, classes_path, merged_path)
        drop(spark, extra_path)
    drop(spark, members_path, texts_path)
    return reps.join(classes, "node", "left").select("id", "fp", "n", "node", F.coalesce("component", "node").alias("class_id")), reps.select("fp", "n")


def _keys_repeat(docs: DataFrame, key: str) -> bool:
    """Whether a key has several rows, or is null: only then is it worth a shuffle to look for equal rows."""
    return docs.groupBy(F.col(key)).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count() > 0


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Per document: key, class_id, copies (rows of equal text), kept (the key and text that stand for the class; rows that repeat wholly are all marked)."""
    classes, counts = near_classes(docs, key, text, threshold)
    rows = docs.select(F.col(key), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("fp"))
    found = join_counted(rows, classes, ["fp"], counts, "n")
    kept = (F.col("node") == F.col("class_id")) & F.col(key).cast("long").eqNullSafe(F.col("id"))
    return found.select(F.col(key), "class_id", F.col("n").alias("copies"), kept.alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One document of each class, with all its columns."""
    classes, _ = near_classes(docs, key, text, threshold)
    best = classes.where("node = class_id").select(F.col("id").alias("_tl_id"), F.col("fp").alias("_tl_fp"))
    marked = docs.withColumns({"_tl_fp": F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))), "_tl_id": F.col(key).cast("long")})
    # keys and texts together name few rows each, unless rows repeat wholly
    rows = marked.alias("l").join(best.alias("r"), (F.col("l._tl_fp") == F.col("r._tl_fp")) & F.col("l._tl_id").eqNullSafe(F.col("r._tl_id")), "left_semi")
    if _keys_repeat(docs, key):
        rows = rows.dropDuplicates(["_tl_fp"])
    return rows.select(*[F.col(c) for c in docs.columns])
