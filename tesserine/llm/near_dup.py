"""Near-duplicate texts by improved consistent weighted sampling (ICWS).

A text is the weighted set of its five-word shingles.  The weight of a shingle
is TF-IDF: its count in the text times the mean inverse document frequency of
its words; those are counted over all documents in a fixed number of hashed
buckets, as Spark's HashingTF does, so the table has a proven size.  ICWS draws
samples of which two texts share a share equal to their weighted Jaccard
similarity.  Samples are banded, texts of a band value meet in a bucket, and
pairs are verified by the exact weighted Jaccard similarity of whole texts.

Within a bucket no set of all pairs is made.  Every text is compared with the
bucket's most central one; linked texts need no further comparison, as only
classes count.  Texts that remain outside its class are then compared with the
rest of the bucket, in groups of bounded size that return links only; so no link
is lost that the buckets show.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import dropped, written
from .textbytes import U, chunks, column, mixed, word_hashes
from .worker import fresh, task

WORDS = 5
THRESHOLD = 0.8
#: Bands, and samples of a band: a pair at the threshold shares no band with probability below 0.0003.
BANDS, ROWS = 16, 4
#: Hashed buckets of document frequencies, and parts in which they travel.
TERMS, PARTS = 1 << 18, 64
#: Bits kept of each sample for the sketch that rules pairs out, and samples that may differ in it: a pair at the threshold exceeds that with probability below 0.000003.
SKETCH_BITS, MAY_DIFFER = 4, 28
#: Members of a bucket that one task of its joins takes, about.
HOT = 1024
#: Texts of a bucket that a group compares, with how many others, and bytes of either.
OUTSIDERS, OTHERS, GROUP_BYTES = 512, 2048, 16 << 20
CHUNK = 1 << 19

_QUANTILES = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2: solves 1 - (1 + x) exp(-x) = p by bisection."""
    p = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    low, high = np.zeros(_QUANTILES), np.full(_QUANTILES, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        above = 1 - (1 + mid) * np.exp(-mid) > p
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return low


_R = _gamma_quantiles().astype(np.float32)
_LN_C = np.log(_gamma_quantiles()).astype(np.float32)
_C = mixed(np.arange(1, WORDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def weighted_shingles(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, their weights, and where each text begins (one entry more).

    A text of fewer than five words, but some, has one shingle of all its words.
    """
    words, first = word_hashes(texts)
    n = np.diff(first)
    counts = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][owner]
    size = np.minimum(n, WORDS)[owner]
    sums = np.concatenate(([0.0], np.cumsum(idf[(words >> U(64 - 18)).astype(np.int64)])))
    weight = (sums[at + size] - sums[at]) / np.maximum(size, 1)
    padded = np.concatenate((words, np.zeros(WORDS, U)))
    h = np.zeros(len(at), U)
    for j in range(WORDS):
        h += np.where(j < size, padded[at + j], U(0)) * _C[j]
    h = mixed(h)
    order = np.lexsort((h, owner))
    h, owner, weight = h[order], owner[order], weight[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    tf = np.diff(np.append(start, len(h)))
    return h[start], weight[start] * tf, np.searchsorted(owner[start], np.arange(len(texts) + 1))


def samples(h: np.ndarray, weight: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS band values for each text that has shingles, and its sketch: SKETCH_BITS words, each with one bit of each sample."""
    ln_w = np.log(weight).astype(np.float32)
    counts = np.diff(first)
    out, sketch = np.zeros((len(counts), BANDS), U), np.zeros((len(counts), SKETCH_BITS), U)
    for band in range(BANDS):
        value = np.full(len(counts), mixed(np.array([band + 1], U))[0], U)
        for row in range(ROWS):
            x = mixed(h ^ mixed(np.array([(band * ROWS + row + 1) * 0x51ED2701], U)))
            r = _R[(x & U(0xFFFF)).astype(np.int64)]
            beta = (x >> U(32)).astype(np.float32) * np.float32(2.0**-32)
            t = np.floor(ln_w / r + beta)
            ln_a = _LN_C[((x >> U(16)) & U(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
            least = np.minimum.reduceat(ln_a, first[:-1])
            hit = np.flatnonzero(ln_a == np.repeat(least, counts))
            pick = hit[np.searchsorted(hit, first[:-1])]
            drawn = mixed(h[pick] + t[pick].astype(np.int64).astype(U) * U(0xD6E8FEB86659FD93))
            value = mixed(value * U(0x9E3779B97F4A7C15) + drawn)
            for bit in range(SKETCH_BITS):
                sketch[:, bit] |= ((drawn >> U(bit)) & U(1)) << U(band * ROWS + row)
        out[:, band] = value
    return out, sketch


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequencies of the hashed words: ln((1 + documents) / (1 + documents with the word)) + 1, over all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for b in batches:
            for _, run in chunks(column(b, "__text"), CHUNK):
                words, first = word_hashes(run)
                term = (words >> U(64 - 18)).astype(np.int64)
                owner = np.repeat(np.arange(len(run)), np.diff(first))
                total += np.bincount(np.unique(owner * TERMS + term) % TERMS, minlength=TERMS)
                n += len(run)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([n] * PARTS, pa.int64()), pa.array([t.tobytes() for t in np.split(total, PARTS)], pa.binary())], names=["part", "n", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist())
        return pa.table({"part": table["part"][:1], "n": [sum(table["n"].to_pylist())], "counts": pa.array([total.tobytes()], pa.binary())}, schema=table.schema)

    sums = docs.select(F.col(text_col).cast("binary").alias("__text")).mapInArrow(task(counted), "part int, n long, counts binary")
    rows = sums.groupBy("part").applyInArrow(added, "part int, n long, counts binary").collect()  # TERMS numbers in all
    if not rows:
        return np.ones(TERMS)
    df = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["part"])])
    return np.log((1 + rows[0]["n"]) / (1 + df)) + 1


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with ascending hashes."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - shared
    return float(shared / union) if union > 0 else 0.0


def _signatures(docs: DataFrame, sent, id_col: str, text_col: str) -> DataFrame:
    """id, node (digest of the text), weight, bands, sketch of each row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = sent.value
        for b in batches:
            bands, sketches, weights = [], [], []
            for _, run in chunks(column(b, "__text"), CHUNK):
                h, weight, first = weighted_shingles(run, idf)
                full = np.diff(first) > 0
                got = iter(())
                if full.any():
                    got = zip(*(x.view(np.int64).tolist() for x in samples(h, weight, np.append(first[:-1][full], first[-1]))))
                for f in full:
                    band, sketch = next(got) if f else ([], [])
                    bands.append(band)
                    sketches.append(sketch)
                weights += np.diff(np.concatenate(([0.0], np.cumsum(weight)))[first]).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(weights, pa.float64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "node", "weight", "bands", "sketch"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), _node(text_col).alias("node"), F.col(text_col).cast("binary").alias("__text"))
    return plain.mapInArrow(task(signed), "id long, node binary, weight double, bands array<long>, sketch array<long>")


def _worth_a_look(threshold: float) -> F.Column:
    """Of the columns x and y (structs of two members of a bucket): whether their similarity can reach the threshold, and this is the first bucket that they share."""
    x, y = F.col("x"), F.col("y")
    differ = reduce(lambda p, q: p.bitwiseOR(q), (x["sketch"][i].bitwiseXOR(y["sketch"][i]) for i in range(SKETCH_BITS)))
    weights = F.least(x["weight"], y["weight"]) >= F.lit(threshold - 1e-9) * F.greatest(x["weight"], y["weight"])
    earlier = reduce(lambda p, q: p | q, ((F.col("nth") > i) & (x["bands"][i] == y["bands"][i]) for i in range(BANDS - 1)))
    return weights & (F.bit_count(differ) <= MAY_DIFFER) & ~earlier


def _node(text_col: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _verified(pairs: DataFrame, texts: DataFrame, sent, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose texts a and b are as similar as the threshold or more."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, last = sent.value, (None, None)
        for batch in batches:
            keep = []
            a, b = column(batch, "a"), column(batch, "b")
            for k, (ta, tb) in enumerate(zip(column(batch, "text_a"), column(batch, "text_b"))):
                if a[k] != last[0]:  # pairs come sorted by a
                    last = a[k], weighted_shingles([ta], idf)[:2]
                keep.append(similarity(last[1], weighted_shingles([tb], idf)[:2]) >= threshold)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(2)], names=["a", "b"])

    both = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").sortWithinPartitions("a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(task(checked), "a binary, b binary")


def _outsiders(rest: DataFrame, sent, threshold: float) -> DataFrame:
    """Links (a, b) between the outside members of buckets and members of other components.

    Every part of a bucket's outsiders meets every slice of its members in a
    group of bounded size, which returns links, one for each pair of components
    at most, and no pairs.
    """
    size = F.octet_length("text")
    sizes = rest.groupBy("band", "salt").agg(F.count_if("outside").alias("o"), F.sum(F.when(F.col("outside"), size)).alias("ob"), F.count("*").alias("n"), F.sum(size).alias("nb"))
    sizes = sizes.groupBy("band").agg(F.greatest(F.ceil(F.sum("o") / OUTSIDERS), F.ceil(F.sum("ob") / GROUP_BYTES)).alias("parts"), F.greatest(F.ceil(F.sum("n") / OTHERS), F.ceil(F.sum("nb") / GROUP_BYTES)).alias("slices"), (F.max("salt") + 1).alias("salts"))
    sizes = written(sizes, "bands").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    dealt = rest.join(sizes, ["band", "salt"]).withColumn("h", F.xxhash64("x.node"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    found = dealt.select("band", every("parts").alias("part"), F.pmod("h", "slices").alias("slice"), F.lit(False).alias("seeks"), "nth", "x", "component", "outside", "text")
    seeking = dealt.where("outside").select("band", F.pmod("h", "parts").alias("part"), every("slices").alias("slice"), F.lit(True).alias("seeks"), "nth", "x", "component", "outside", "text")
    flat = found.unionByName(seeking).select("band", "part", "slice", "seeks", "nth", "x.node", "x.weight", "x.bands", "x.sketch", "component", "outside", "text")

    def compared(table: pa.Table) -> pa.Table:
        idf, node, text, component = sent.value, *(table[c].to_pylist() for c in ("node", "text", "component"))
        seeks, outside = (table[c].to_numpy(zero_copy_only=False) for c in ("seeks", "outside"))
        weight, nth = table["weight"].to_numpy(), table["nth"][0].as_py()
        sketch, bands = (np.array(table[c].to_pylist(), np.int64).view(U) for c in ("sketch", "bands"))
        _, kind = np.unique(np.array([c.hex() for c in component]), return_inverse=True)
        _, order = np.unique(np.array([n.hex() for n in node]), return_inverse=True)
        others = np.flatnonzero(~seeks)
        sets: dict[int, tuple] = {}

        def of(i: int) -> tuple:
            if i not in sets:
                if len(sets) > 4096:
                    sets.clear()
                sets[i] = weighted_shingles([text[i]], idf)[:2]
            return sets[i]

        a, b = [], []
        for i in np.flatnonzero(seeks):
            w, o = weight[i], others
            ok = (kind[o] != kind[i]) & (np.minimum(weight[o], w) >= (threshold - 1e-9) * np.maximum(weight[o], w)) & (~outside[o] | (order[o] > order[i]))
            o = o[ok]
            o = o[np.bitwise_count(np.bitwise_or.reduce(sketch[o] ^ sketch[i], axis=1)) <= MAY_DIFFER]
            o = o[~(bands[o, :nth] == bands[i, :nth]).any(axis=1)]  # else an earlier bucket has them
            linked: set[int] = set()
            for j in o.tolist():
                if kind[j] not in linked and similarity(of(i), of(j)) >= threshold:
                    linked.add(kind[j])
                    a.append(component[i])
                    b.append(component[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return flat.groupBy("band", "part", "slice").applyInArrow(compared, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, node, class_id, class_size, kept for each row of docs.

    A class is a connected component of equal texts and of texts as similar as
    the threshold; class_id is its smallest id and the row with it is kept (rows
    repeated with id and text stay together; where all ids of a class are null,
    those of its smallest text are kept).  Null and empty texts have no class
    mates: class_size is 1 and class_id their own id.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(document_frequencies(docs, text_col))
    rows = written(_signatures(docs, sent, id_col, text_col), "signatures")
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("weight", "bands", "sketch")))
    nodes = written(nodes, "texts")

    # Members of buckets of two texts or more; a text's rank is the size of all its buckets, so the highest is the most central.
    placed = nodes.select("node", F.posexplode("bands").alias("nth", "band"))
    sizes = placed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    placed = written(placed.join(sizes, "band"), "buckets")
    central = placed.groupBy("node").agg(F.sum("size").alias("rank"))
    about = central.join(nodes, "node").select(F.struct("node", "weight", "bands", "sketch", "rank").alias("x"), "least")
    # Of a bucket with many members, `salt` deals them to several tasks, of which each gets what all of them need.
    salts = F.ceil(F.col("size") / HOT).cast("int")
    members = placed.join(about, F.col("node") == F.col("x.node"))
    members = written(members.select("band", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), salts.alias("salts"), "nth", "x"), "members")
    source = docs.select(F.col(id_col).cast("long").alias("id"), _node(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    texts = source.join(about.select("x.node", "least"), (F.col("key") == F.col("node")) & F.col("id").eqNullSafe(F.col("least"))).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "candidate-texts")
    dropped(spark, placed)

    def to_all(rows: DataFrame) -> DataFrame:
        """A row a bucket for each of its salts."""
        return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    first = F.min(F.struct((-F.col("x.rank")).alias("r"), "x.node", "x")).alias("lead")
    leads = members.groupBy("band", "salt").agg(first, F.first("salts").alias("salts")).groupBy("band").agg(F.min("lead").alias("lead"), F.first("salts").alias("salts"))
    leads = written(leads.select("band", F.col("lead.x").alias("y"), "salts"), "leads")
    pairs = members.join(to_all(leads), ["band", "salt"]).where((F.col("x.node") != F.col("y.node")) & _worth_a_look(threshold)).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    edges = written(_verified(pairs, texts, sent, threshold), "links")
    classes = components(edges)

    # Buckets that still hold several components: those outside the main one are compared with all others.
    now = members.join(classes.withColumnRenamed("node", "n2"), F.col("x.node") == F.col("n2"), "left").select("band", "salt", "salts", "nth", "x", F.coalesce("component", "x.node").alias("component"))
    main = F.min(F.struct((-F.col("x.rank")).alias("r"), "x.node", "component")).alias("lead")
    several = now.groupBy("band", "salt").agg(F.min("component").alias("low"), F.max("component").alias("high"), main, F.first("salts").alias("salts"))
    several = several.groupBy("band").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("lead").alias("lead"), F.first("salts").alias("salts"))
    mixed_bands = written(several.where("low < high").select("band", F.col("lead.component").alias("main"), "salts"), "bands")
    rest = now.drop("salts").join(to_all(mixed_bands), ["band", "salt"]).select("band", "salt", "nth", "x", "component", (F.col("component") != F.col("main")).alias("outside"))
    rest = written(rest.join(texts.withColumnRenamed("node", "n2"), F.col("x.node") == F.col("n2")).drop("n2"), "members")
    dropped(spark, members, texts, leads)
    more = written(_outsiders(rest, sent, threshold), "links")
    dropped(spark, rest)
    classes = components(edges.union(more))

    found = nodes.join(classes.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select("node", "least", "n", F.coalesce("component", "node").alias("component"))
    whole = found.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.min("node").alias("first"))
    found = written(found.join(whole, "component").select("node", "class_id", "class_size", "first"), "classes")
    void = F.col("node") == F.unhex(F.md5(F.lit("")))
    return rows.select("id", "node").join(found, "node").select(
        "id", "node", F.when(void, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(void, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.coalesce(void | (F.col("id") == F.col("class_id")), F.col("class_id").isNull() & (F.col("node") == F.col("first"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, all columns kept, whatever their names."""
    key, own, node = fresh(docs, "__key", "__id", "__node")
    keep = near_duplicates(docs, threshold, id_col, text_col).where("kept").select(F.col("id").alias(own), F.col("node").alias(node)).distinct()
    marked = docs.withColumn(key, _node(text_col))
    return marked.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(key) == F.col(node)), "left_semi").drop(key)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


QUERIES = {"op5_near_dup": op5_near_dup}
