"""Phrase collocation mining: exact counts of frequent phrases, from sorted fixed-width keys.

Words that are frequent enough get a number; all others break the pieces that they stand in.  At every
place the ids of the next words, zeros after a break, are one fixed-width binary key.  Keys are sorted
by radix inside a task, equal ones counted, and dealt by ranges of the key; in a range one more
sort brings equal prefixes together, so run lengths count phrases of every length at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, batch_rows, checked_broadcast

BREAK = b"\xff"  # no UTF-8 text has this byte
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes.maketrans(UPPER + ENDS + b"\t", LOWER + b"\n" * len(ENDS) + b" ")
TEXT_BYTES = 1 << 14  # of texts in a row of ids; a scan holds some thousands of such rows
KEYS = 1 << 20  # keys that are sorted at once
WORDS = 200_000  # that a task counts before it passes them on


def tokens(text: bytes) -> list[bytes]:
    """The words of a text with BREAK between pieces."""
    return text.translate(TABLE).replace(b"\n", b" " + BREAK + b" ").split()


def texts_by_language(batches: Iterator, size: int = TEXT_BYTES) -> Iterator[tuple[str, bytes]]:
    """Texts of one language joined into chunks of about `size` bytes, a piece's end between two texts."""
    import pyarrow as pa

    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text)
            if sizes[lang] >= size:
                yield lang, b"\n".join(held.pop(lang))
                del sizes[lang]
            elif sizes.total() >= 32 * size:  # many languages
                for one in list(held):
                    yield one, b"\n".join(held.pop(one))
                sizes.clear()
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def cleaned(docs: DataFrame) -> DataFrame:
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(lang.alias("lang"), text.alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f.  A task counts before the shuffle and never holds many more than WORDS of them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: dict[str, Counter] = {}

        def emit() -> Iterator:
            for lang, c in counts.items():
                words = pa.array(list(c), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), words, pa.array(list(c.values()), pa.int64())], names=["lang", "word", "f"])
            counts.clear()

        for lang, text in texts_by_language(batches, 1 << 19):
            c = counts.setdefault(lang, Counter())
            c.update(tokens(text))
            del c[BREAK]
            if sum(map(len, counts.values())) > WORDS:
                yield from emit()
        yield from emit()

    return cleaned(docs).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(words: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, word, f, id: ids from 1, the commonest words first, by ranges of a distributed sort."""
    t = scratch.write(words.orderBy(F.desc("f"), "lang", "word").select("*", F.monotonically_increasing_id().alias("_m")))
    t = t.select("lang", "word", "f", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    sizes = {r[0]: r[1] for r in t.groupBy("_p").count().collect()}  # one row a partition
    offsets, n = [], 1
    for p in sorted(sizes):
        offsets.append((p, n))
        n += sizes[p]
    o = t.sparkSession.createDataFrame(offsets, "_p long, _o long")
    return scratch.write(t.join(F.broadcast(o), "_p").select("lang", "word", "f", (F.col("_o") + F.col("_i")).cast("int").alias("id")))


def id_bytes(n: int) -> int:
    """Bytes of an id among n."""
    return max(1, (n.bit_length() + 7) // 8)


def encoded(docs: DataFrame, words: DataFrame, n: int, most: int) -> DataFrame:
    """ids: arrays of word ids, with 0 for breaks and at the end, a text or several in each.

    Up to `most` words the dictionary is broadcast, a bound of what tasks hold.  Beyond it the `most`
    commonest still are, and words are looked up by a join only where they are none of those; they are
    rare, so no key of the join is hot.
    """
    spark = docs.sparkSession
    head = words.select("lang", "word", "id") if n <= most else words.orderBy(F.desc("f"), "id").limit(most).select("lang", "word", "id")
    sent = spark.sparkContext.broadcast(head.toArrow())

    def lookup() -> dict[str, dict[bytes, int]]:
        import pyarrow as pa

        t, out = sent.value, {}
        for lang, word, i in zip(t["lang"].to_pylist(), t["word"].cast(pa.binary()).to_pylist(), t["id"].to_pylist(), strict=True):
            out.setdefault(lang, {})[word] = i
        return out

    if n <= most:

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            known = lookup()
            for lang, text in texts_by_language(batches):
                get = known.get(lang, {}).get
                ids = np.fromiter(map(get, [*tokens(text), BREAK], repeat(0)), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names=["ids"])

        return cleaned(docs).mapInArrow(run, "ids array<int>")

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = lookup()
        for lang, text in texts_by_language(batches):
            t = [*tokens(text), BREAK]
            ids = [known.get(lang, {}).get(w, 0) for w in t]
            # a number for a common word, the word itself for any other, neither for a break
            rest = [None if i or w == BREAK else w for i, w in zip(ids, t, strict=True)]
            cols = [pa.array([lang], pa.string()), pa.array([ids], pa.list_(pa.int32())), pa.array([rest], pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "ids", "rest"])

    t = Scratch(spark, "encoded").write(cleaned(docs).mapInArrow(split, "lang string, ids array<int>, rest array<string>").withColumn("chunk", F.monotonically_increasing_id()))
    rare = t.select("chunk", "lang", F.posexplode("rest").alias("at", "word")).where("word is not null")
    found = rare.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("at", "id"))).alias("more"))
    ids = F.transform("ids", lambda i, k: F.when(i > 0, i).otherwise(F.coalesce(F.try_element_at("more", k), F.lit(0).cast("long"))))
    return t.join(found, "chunk", "left").select(F.when(F.col("more").isNull(), F.col("ids")).otherwise(ids).alias("ids"))


def packed(ids: np.ndarray, longest: int, width: int, share: float = 1.0) -> np.ndarray:
    """A key of `longest` ids of `width` big-endian bytes for every id that is not 0, as 16-bit digits [n, digits].

    The ids after it, up to the next 0, follow; zeros fill the rest.  With a share below 1: of so many places.
    """
    at = np.flatnonzero(ids)
    if share < 1.0:
        at = at[np.random.default_rng(len(ids)).random(len(at)) < share]
    wide = np.zeros((len(ids) + longest, 4), dtype=np.uint8)
    wide[: len(ids)] = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    alive = np.concatenate([ids > 0, np.zeros(longest, dtype=bool)])
    keys = np.zeros((len(at), longest * width + longest * width % 2), dtype=np.uint8)
    going = np.ones(len(at), dtype=bool)
    for j in range(longest):
        going &= alive[at + j]
        keys[:, j * width : (j + 1) * width] = wide[at + j, 4 - width :] * going[:, None]
    return keys.view(">u2").astype(np.uint16)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Least significant digit first; NumPy's stable sort of 16-bit integers is a radix sort."""
    order = np.argsort(keys[:, -1], kind="stable")
    for d in range(keys.shape[1] - 2, -1, -1):
        order = order[np.argsort(keys[order, d], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and how often they came."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    order = radix_order(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    counts = np.diff(np.append(new, len(keys))) if counts is None else np.add.reduceat(counts[order], new)
    return keys[new], counts


def to_bytes(keys: np.ndarray) -> bytes:
    return keys.astype(">u2").tobytes()


def squeezed(a: np.ndarray) -> bytes:
    """Rows of integers byte plane by byte plane, compressed; of sorted keys the first planes are nearly constant."""
    import pyarrow as pa

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(blob, n: int, kind: str, width: int) -> np.ndarray:  # noqa: ANN001
    """[n, width] integers of that kind."""
    import pyarrow as pa

    size = np.dtype(kind).itemsize * width
    planes = np.frombuffer(pa.decompress(blob, n * size, codec="zstd"), dtype=np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind)


def phrase_runs(keys: np.ndarray, counts: np.ndarray, longest: int, width: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of sorted distinct keys, for each length from 2: the phrases' ids [n, length] and counts.

    Phrases below `least` go, but for the first and the last of a range, which may go on in the next one.
    """
    raw = keys.astype(">u2").view(np.uint8)
    for m in range(2, longest + 1):
        part = raw[:, : m * width]
        new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1)]))
        total = np.add.reduceat(counts, new)
        keep = total >= least
        keep[0] = keep[-1] = True
        keep &= part[new, (m - 1) * width :].any(axis=1)  # shorter phrases end in a zero
        rows = part[new[keep]].reshape(-1, m, width)
        ids = np.zeros(rows.shape[:2], dtype=np.int32)
        for b in range(width):
            ids = (ids << 8) | rows[:, :, b]
        yield ids, total[keep]


def splitters(ids: DataFrame, n: int, longest: int, width: int, per: int) -> list[bytes]:
    """Keys that cut a sample into ranges of about `per` keys; the sample is at most 64 keys a range and 250,000.

    Only the ranges' sizes depend on it, never a result.
    """
    ranges = -(-n // per)
    if ranges < 2:
        return []
    want = min(64 * ranges, 250_000)
    share = min(1.0, want / n)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keys = packed(b.column("ids").flatten().to_numpy(), longest, width, share)
            yield pa.RecordBatch.from_arrays([pa.array([to_bytes(k) for k in keys], pa.binary())], names=["k"])

    got = sorted(r[0] for r in ids.mapInArrow(run, "k binary").limit(4 * want).collect())
    got = [bytes(k) for k in got]
    cuts = [got[i * len(got) // ranges] for i in range(1, ranges)] if got else []
    return sorted(set(cuts))


def dealt(ids: DataFrame, longest: int, width: int, cuts: list[bytes], size: int = KEYS) -> DataFrame:
    """range, n, keys, counts: sorted distinct keys of a task as blobs, one for each range that they touch."""

    def blobs(parts: list[np.ndarray]) -> Iterator:
        import pyarrow as pa

        keys, counts = run_lengths(np.concatenate(parts), None)
        raw = keys.astype(">u2")
        kind = np.dtype(("S", raw.shape[1] * 2)) if len(raw) else None
        if kind is None:
            return
        # S compares like bytes up to trailing zeros, which shorter phrases end in: the order is the same
        at = np.searchsorted(raw.view(np.uint8).reshape(len(raw), -1).copy().view(kind).ravel(), np.array(cuts, dtype=kind), side="left") if cuts else np.zeros(0, int)
        edges = np.concatenate([[0], at, [len(raw)]])
        counts = counts.astype("<u4")
        rows = [(i, b - a, squeezed(raw[a:b]), squeezed(counts[a:b])) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        r, n, k, c = zip(*rows, strict=True)
        cols = [pa.array(r, pa.int32()), pa.array(n, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["range", "n", "keys", "counts"])

    def run(batches: Iterator) -> Iterator:
        held, n = [], 0
        for b in batches:
            ids = b.column("ids").flatten().to_numpy()
            for at in range(0, len(ids), size):
                # the ids after a part's last place belong to its keys, too
                part = packed(ids[at : at + size + longest - 1], longest, width)
                part = part[: np.count_nonzero(ids[at : at + size])]
                held.append(part)
                n += len(part)
                if n >= size:
                    yield from blobs(held)
                    held, n = [], 0
        if n:
            yield from blobs(held)

    return ids.mapInArrow(run, "range int, n int, keys binary, counts binary")


def counted(blobs: DataFrame, ranges: int, longest: int, width: int, least: int) -> DataFrame:
    """ids, f: the phrases of two words or more that occur at least `least` times.

    There are as many partitions as ranges, so what a task reads stays the same, however large the corpus.
    """
    digits = (longest * width + 1) // 2

    def merge(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        n = table.column("n").to_pylist()
        keys = np.concatenate([unsqueezed(k.as_buffer(), i, ">u2", digits).astype(np.uint16) for k, i in zip(table.column("keys"), n, strict=True)])
        counts = np.concatenate([unsqueezed(c.as_buffer(), i, "<u4", 1).ravel() for c, i in zip(table.column("counts"), n, strict=True)])
        keys, counts = run_lengths(keys, counts.astype(np.int64))
        parts = list(phrase_runs(keys, counts, longest, width, least))
        flat = [pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, ids.shape[1]), pa.int32()), pa.array(ids.ravel())) for ids, _ in parts]
        return pa.table({"ids": pa.concat_arrays(flat), "f": pa.array(np.concatenate([f for _, f in parts]))})

    out = blobs.repartition(ranges, "range").groupBy("range").applyInArrow(merge, "ids array<int>, f long")
    # a phrase that goes over the end of a range comes once from each
    return out.groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrase_counts(docs: DataFrame, least: int, longest: int, most_words: int = 1_000_000, per: int = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the frequent phrases (ids, f), the frequent words (lang, word, f, id) and all words (lang, n)."""
    scratch = Scratch(docs.sparkSession, "phrases")
    batch_rows(docs.sparkSession)
    every = scratch.write(word_counts(docs))
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = numbered(every.where(F.col("f") >= least), scratch)
    size, places = words.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    width = id_bytes(size)
    ids = scratch.write(encoded(docs, words, size, most_words))
    cuts = splitters(ids, places, longest, width, per)
    phrases = scratch.write(counted(dealt(ids, longest, width, cuts), len(cuts) + 1, longest, width, least))
    return phrases, words, total


def inner_parts(ids: Column, longest: int) -> Column:
    """All shorter contiguous parts of two words or more."""
    none = F.array().cast("array<array<int>>")

    def runs(m: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(ids) - (m - 1))
        return F.when(F.size(ids) > m, F.transform(starts, lambda i: F.slice(ids, i, m))).otherwise(none)

    return F.array_distinct(F.concat(none, *[runs(m) for m in range(2, longest)]))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, most_words: int = 1_000_000, per: int = KEYS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language.

    a: how often the phrase occurs; l and r: its two parts at the cut with the least score, of equal ones
    the first; n: all words of the language; score: floor(1000 a n / (l r)), in exact decimals.  A phrase
    goes if a longer one that holds it occurs as often.  A null language is `und`, a null text
    empty; equal texts all count.  Ties in score and a are ordered by the phrase's bytes.  Without
    frequent words, as in an empty table, the result is empty.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    phrases, words, total = phrase_counts(docs, least, longest, most_words, per)
    size = F.size("ids")
    cut = F.explode(F.sequence(F.lit(1), size - 1))
    cuts = phrases.withColumn("k", cut)
    cuts = cuts.select("ids", "f", "k", F.slice("ids", F.lit(1), F.col("k")).alias("one"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("two"))
    parts = phrases.select("ids", "f").unionByName(words.select(F.array("id").alias("ids"), "f"))
    part = lambda key, name: parts.select(F.col("ids").alias(key), F.col("f").alias(name))
    cuts = cuts.join(part("one", "l"), "one").join(part("two", "r"), "two")
    # the language, its words and each cut's score
    w = checked_broadcast(words.select("lang", "word", "id"))
    first = cuts.join(w.select("lang", F.col("id").alias("_id")), F.col("_id") == F.col("ids")[0]).drop("_id")
    first = first.join(checked_broadcast(total), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    first = first.withColumn("above", (F.lit(1000).cast("decimal(4,0)") * wide("f")).cast("decimal(23,0)") * wide("n").cast("decimal(15,0)"))
    first = first.withColumn("below", wide("l") * wide("r")).withColumn("score", F.expr("above div below"))
    best = first.groupBy("lang", "ids").agg(F.first("f").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "ids", "a", "b.l", "b.r", "n", "b.score")
    held = phrases.select(F.explode(inner_parts(F.col("ids"), longest)).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    best = best.join(held, "ids", "left").where("longer is null or 100 * longer < 100 * a").drop("longer")
    best = scratch.write(best)
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(w.select("id", "word"), "id").groupBy("ids")
    spelled = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = best.join(spelled, "ids")
    from pyspark.sql import Window as W

    by = [F.desc("score"), F.desc("a"), "phrase"]
    # first the best of each of 64 parts of a language, so that one task ranks 64 * top rows at most
    part = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*by))
    out = out.withColumn("rank", part).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
