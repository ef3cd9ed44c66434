"""MinHash near-dedup with sequential Bayesian verification.

Equal shingle sets are one class from the start. Classes whose signatures agree in a band are candidates. A candidate
pair's signatures are compared in batches; it is pruned once the posterior probability of a similarity at or above the
threshold (uniform prior, so a Beta posterior) falls below miss. Survivors are verified on their full sets.

A band's bucket may hold very many classes, so its pairs are not all made: first every class is compared with the
bucket's smallest; after the links found are joined to components, the pairs of a bucket that lie in different
components are compared. Pairs inside a component add nothing to it, so the components are those of all candidates.
In large buckets the classes outside the most common component meet all others in blocks, where pairs are pruned and
verified; only links become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import byte_slices, components, cut, settled, small

#: At similarity 0.8 a pair misses all bands with a probability of 3e-6, and is pruned with one of MISS at most.
BANDS, ROWS, BATCH, MISS = 32, 5, 32, 1e-6
SHINGLE, THRESHOLD = 5, 80
#: Members up to which a bucket's pairs are made by a join; beyond it, members and bytes (signatures, full sets) of a block.
SMALL_BUCKET, BLOCK, BLOCK_BYTES = 16, 512, 32 << 20
#: Hashed words kept by a task, and the bytes of the longest that is kept.
KEPT_WORDS, KEPT_WORD = 100_000, 64


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text: A-Z lower-cased, words parted by ASCII white space."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not ws:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in ws:
            if w not in known and len(w) <= KEPT_WORD:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] if len(w) <= KEPT_WORD else xxhash.xxh64_intdigest(w) for w in ws], dtype=np.uint64)
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, 1469598103934665603 + min(len(h), self.width), np.uint64)
        for i in range(min(self.width, len(h))):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each hash function the least of (a * x) xor b over the set, on mixed 32-bit values."""
    x = ((s ^ (s >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        v = x[i : i + 2048, None] * a[None, :]
        v ^= b[None, :]
        np.minimum(low, v.min(axis=0), out=low)
    return low


def least_matches(batch: int, total: int, threshold: float, miss: float) -> dict[int, int]:
    """For each number of values compared, the matches below which a pair is pruned.

    With k matches of m the posterior is Beta(k + 1, m - k + 1), and P(s >= t) = P(Binomial(m + 1, t) <= k).
    """
    out = {}
    for m in range(batch, total + 1, batch):
        cum, k = 0.0, 0
        while True:
            cum += comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
            if cum >= miss:
                break
            k += 1
        out[m] = k
    return out


def signed(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, fp, sig, bands); fp is a 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, a = Shingler(width), multipliers(bands * rows)
        b = multipliers(2 * bands * rows)[bands * rows :]
        for batch in (part for whole in batches for part in byte_slices(whole, 1)):
            n, fp, sig, keys = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = sets(t)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                low = signature(s, a, b) if len(s) else None
                sig.append(None if low is None else low.tobytes())
                keys.append([] if low is None else [xxhash.xxh64_intdigest(low[i * rows : (i + 1) * rows].tobytes(), seed=i) - (1 << 63) for i in range(bands)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "sig", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, fp binary, sig binary, bands array<long>")


def pruned(pairs: DataFrame, reps: DataFrame, threshold: int, batch: int, miss: float, total: int) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures doesn't prune."""
    least = least_matches(batch, total, threshold / 100, miss)
    need = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sigs = cut(reps.select(F.col("rep").alias("id"), "sig").join(small(need, 400_000), "id", "left_semi"))
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = np.frombuffer(b"".join(f["sa"]), np.uint32).reshape(len(f), total)
            y = np.frombuffer(b"".join(f["sb"]), np.uint32).reshape(len(f), total)
            alive, matches = np.arange(len(f)), np.zeros(len(f), np.int64)
            for m, k in least.items():
                part = slice(m - batch, m)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= k]
            yield f.iloc[alive][["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def block_members(members: DataFrame) -> DataFrame:
    """members dealt to the blocks (band, i, j) of their bucket: the classes outside its major component as side 0, all of its classes as side 1."""
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int")
    m = members.withColumn("na", blocks("n_rest", "b_rest")).withColumn("nb", blocks("n_all", "b_all"))
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = m.where("c <> major").select("band", "place", "rep", "c", F.lit(0).alias("side"), mine("na").alias("i"), each("nb").alias("j"))
    return rest.unionByName(m.select("band", "place", "rep", "c", F.lit(1).alias("side"), each("na").alias("i"), mine("nb").alias("j")))


def block_links(members: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, threshold: int, batch: int, miss: float, bands: int, rows: int) -> DataFrame:
    """Links that join different components within the buckets of members (band, place, rep, c, major, n_all, n_rest, b_all, b_rest).

    A first pass over the blocks marks the classes that have a pair the pruning leaves; a second one gets their full
    sets and verifies those pairs. A pair counts in the first band it agrees in only, and is passed over once its
    classes are joined within the block, so a block returns fewer links than it has classes.
    """
    total = bands * rows
    least = least_matches(batch, total, threshold / 100, miss)
    sigs = lambda need: cut(reps.select(F.col("rep").alias("id"), "sig").join(small(cut(need.select(F.col("rep").alias("id")).distinct()), 400_000), "id", "left_semi"))

    def left(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of x with the rows of y that the pruning leaves."""
        sx = np.frombuffer(b"".join(x["sig"]), np.uint32).reshape(len(x), total)
        sy = np.frombuffer(b"".join(y["sig"]), np.uint32).reshape(len(y), total)
        cx, cy, place = x["c"].to_numpy(), y["c"].to_numpy(), int(x["place"].iloc[0])
        for at in range(len(sx)):
            s, alive = sx[at], np.flatnonzero(cy != cx[at])
            matches = np.zeros(len(cy), np.int64)
            for n, k in least.items():
                part = slice(n - batch, n)
                matches[alive] += (sy[alive, part] == s[part]).sum(axis=1)
                alive = alive[matches[alive] >= k]
            if len(alive):
                agrees = (sy[alive] == s).reshape(len(alive), bands, rows).all(axis=2)
                alive = alive[agrees.any(axis=1) & (agrees.argmax(axis=1) == place)]
            if len(alive):
                yield at, alive

    def mark(f: pd.DataFrame) -> pd.DataFrame:
        x, y = f[f["side"] == 0], f[f["side"] == 1]
        hit_x, hit_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        if len(x) and len(y):
            for at, alive in left(x, y):
                hit_x[at] = True
                hit_y[alive] = True
        return pd.concat([x[hit_x], y[hit_y]])[["band", "place", "rep", "c", "side", "i", "j"]]

    def link(f: pd.DataFrame) -> pd.DataFrame:
        x, y = f[f["side"] == 0], f[f["side"] == 1]
        out, up = [], {}

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        if len(x) and len(y):
            tx, ty = ([np.frombuffer(s, np.uint64) for s in d["s"]] for d in (x, y))
            cx, cy, rx, ry = x["c"].tolist(), y["c"].tolist(), x["rep"].tolist(), y["rep"].tolist()
            for at, alive in left(x, y):
                p, mine = tx[at], root(cx[at])
                for other in alive.tolist():
                    q, its = ty[other], root(cy[other])
                    # The smaller set can't hold more than its size in common.
                    if its == mine or 100 * min(len(p), len(q)) < threshold * max(len(p), len(q)):
                        continue
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= threshold * (len(p) + len(q) - both):
                        out.append((min(rx[at], ry[other]), max(rx[at], ry[other])))
                        up[max(mine, its)] = min(mine, its)
                        mine = root(mine)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    schema = "band long, place int, rep long, c long, side int, i int, j int"
    sides = block_members(members)
    marked = cut(sides.join(sigs(members), F.col("rep") == F.col("id")).drop("id").groupBy("band", "i", "j").applyInPandas(mark, schema))
    sets = full_sets(marked.select(F.col("rep").alias("id")).distinct(), docs, doc_id, text, width)
    full = marked.join(sigs(marked), F.col("rep") == F.col("id")).drop("id").join(sets, F.col("rep") == F.col("id")).drop("id")
    return full.groupBy("band", "i", "j").applyInPandas(link, "a long, b long").distinct()


def full_sets(ids: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, s): the full shingle sets of the documents of ids."""
    need = cut(ids)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(width)
        for batch in (part for whole in batches for part in byte_slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sets(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "s"])

    return cut(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(small(need, 400_000), "id", "left_semi").mapInArrow(full, "id long, s binary"))


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, threshold: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= threshold * union."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, doc_id, text, width)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in byte_slices(whole, *map(whole.schema.get_field_index, ("sa", "sb")))):
            a, b, x, y = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("a", "b", "sa", "sb"))
            keep = []
            for u, v in zip(x, y, strict=True):
                p, q = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, k in zip(a, keep, strict=True) if k], pa.int64()), pa.array([i for i, k in zip(b, keep, strict=True) if k], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, batch: int = BATCH, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    A null, empty or blank text has an empty set and is linked with nothing. A text of fewer than width words has one shingle, its whole sequence. Repeated rows are copies. A null doc_id is linked with nothing; its component is null and it is kept. doc_id names a document: rows that share it share a component. Extra columns are left out. An empty table gives an empty result.
    """
    return settled(lambda: _near_duplicates(docs, doc_id, text, width, threshold, bands, rows, batch, miss))


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, width: int, threshold: int, bands: int, rows: int, batch: int, miss: float) -> DataFrame:
    all_docs = cut(signed(docs, doc_id, text, width, bands, rows))
    live = all_docs.where("n_shingles > 0 and doc_id is not null")
    reps = cut(live.groupBy("fp").agg(F.min(F.struct("doc_id", "sig", "bands", "n_shingles")).alias("r")).select("fp", F.col("r.doc_id").alias("rep"), "r.sig", "r.bands", "r.n_shingles"))
    keys = reps.select("rep", (F.col("n_shingles") * 8 + F.length("sig")).alias("size"), F.posexplode("bands").alias("place", "band"))
    # Buckets of one class are dropped before anything is joined.
    buckets = cut(keys.groupBy("band").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1").select("band", "center"))
    members = cut(keys.join(buckets, "band"))
    total = bands * rows
    check = lambda p: verified(cut(pruned(p, reps, threshold, batch, miss, total)), docs, doc_id, text, width, threshold)
    stars = members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    links = settled(lambda: check(cut(stars)))
    first = settled(lambda: components(links))
    at = cut(members.join(small(first, 400_000), F.col("rep") == F.col("node"), "left").select("band", "place", "rep", "size", F.coalesce("component", "rep").alias("c")))
    per = at.groupBy("band", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("band").agg(F.max(F.struct("n", "c", "size")).alias("top"), F.sum("n").alias("n_all"), F.sum("size").alias("b_all"), F.count("*").alias("k")).where("k > 1")
    mixed = per.select("band", F.col("top.c").alias("major"), "n_all", (F.col("n_all") - F.col("top.n")).alias("n_rest"), "b_all", (F.col("b_all") - F.col("top.size")).alias("b_rest"))
    open_ = cut(at.join(small(cut(mixed), 400_000), "band"))
    few = open_.where(F.col("n_all") <= SMALL_BUCKET)
    across = few.alias("x").join(few.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.c") < F.col("y.c"))).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    many = settled(lambda: block_links(open_.where(F.col("n_all") > SMALL_BUCKET), reps, docs, doc_id, text, width, threshold, batch, miss, bands, rows))
    more = settled(lambda: check(cut(across))).union(many)
    # A set held by several documents whose doc_id also holds another set ties these classes by doc_id.
    copies = live.join(reps.select("fp", "rep"), "fp").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = settled(lambda: components(links.union(more).union(copies)))
    out = all_docs.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
