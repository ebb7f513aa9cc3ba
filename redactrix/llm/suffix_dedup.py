"""Suffix-array deduplication of byte strings of a fixed length.

Any LENGTH bytes hold a smallest hash among their GRAM-byte pieces (their anchor), the same wherever they stand. So
strings part into runs by anchor, and equal strings meet by their anchor's hash:

1. Each task cuts its texts into runs (anchor hash, run hash, place), drops repeats of its own and deals the rest by anchor.
2. Of runs with equal bytes all but the first go whole. Where an anchor has several different runs, their firsts
   may share some strings: they are fetched from the texts and dealt once more by anchor.
3. There the runs of a bucket are put into one suffix array by two-stage sorting, and strings whose suffixes'
   adjacent common prefixes reach LENGTH go, all but the earliest. An anchor with more runs than a task should
   hold has its runs cut into single strings, dealt by their own hashes.
4. The places meet their texts by document id; the texts are dealt out once for both 2 and 4.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactrix.llm import textnp
from redactrix.llm.common import Scratch, bucket_count, fresh

U = np.uint64
LENGTH, GRAM = 100, 32
#: Different runs of one anchor that are sorted together at most.
HOT = 20_000
#: Runs that a task deals out at once, and bytes of text a bucket of runs stands for.
DEAL, BUCKET = 500_000, 16 << 20
END = 0xFF  # no byte of UTF-8


# ---- two-stage suffix sorting ----


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first byte highest; zeros follow the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(U)
    w = np.zeros(len(t), U)
    for k in range(8):
        w = (w << U(8)) | padded[k : k + len(t)]
    return w


def _smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one is not."""
    n = len(t)
    rising, differs = np.zeros(n, bool), np.zeros(n, bool)
    rising[:-1], differs[:-1] = t[:-1] < t[1:], t[:-1] != t[1:]
    differs[-1] = True
    at = np.where(differs, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rising[at]


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of t (bytes) in order of at least their first ``depth`` bytes; suffixes equal so far stand together.

    Only those smaller than their successors are sorted directly, eight bytes a round and only where still tied.
    Scanning the buckets (by first byte) in order then puts each remaining suffix behind its successor's turn:
    a larger suffix's bucket begins with those whose successors came earlier, in that order.
    """
    if not len(t):
        return np.zeros(0, np.int64)
    small, w = _smaller_than_next(t), _words(t)
    direct = np.flatnonzero(small)
    direct = direct[np.argsort(w[direct], kind="stable")]
    tied = np.zeros(len(direct), bool)
    group = np.zeros(len(direct), np.int64)
    if len(direct):
        new = np.ones(len(direct), bool)
        new[1:] = w[direct][1:] != w[direct][:-1]
        for r in range(8, depth, 8):
            group = np.cumsum(new) - 1
            tied = np.bincount(group)[group] > 1
            if not tied.any():
                break
            at = np.flatnonzero(tied)
            nxt = direct[at] + r
            key = np.where(nxt < len(t), w[np.minimum(nxt, len(t) - 1)], U(0))
            by = np.lexsort((key, group[at]))
            direct[at] = direct[at][by]
            key, g = key[by], group[at]
            new[at[1:]] |= (g[1:] == g[:-1]) & (key[1:] != key[:-1])
    first = t[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # the very last suffix has no successor to follow
    if not small[-1]:
        waiting[t[-1]].append(np.array([len(t) - 1]))
    out = []
    for c in range(256):
        turn = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        larger = [turn]
        while len(turn):
            turn = turn[turn > 0] - 1
            turn = turn[t[turn] == c]
            larger.append(turn)
        done = np.concatenate([*larger, direct[bounds[c] : bounds[c + 1]]])
        waiting[c] = []
        out.append(done)
        before = done[done > 0] - 1
        before = before[(t[before] > c) & ~small[before]]
        chars = t[before]
        by = np.argsort(chars, kind="stable")
        before, chars = before[by], chars[by]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b of t, up to ``most``."""
    w, n = _words(t), len(t)
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for r in range(0, most, 8):
        x, y = a[live] + r, b[live] + r
        diff = np.where(x < n, w[np.minimum(x, n - 1)], U(0)) ^ np.where(y < n, w[np.minimum(y, n - 1)], U(0))
        same = diff == 0
        out[live[same]] += 8
        part = live[~same]
        diff = diff[~same]
        for k in range(7):
            out[part] += (diff >> U(56 - 8 * k) == 0).astype(np.int64)
        live = live[same]
        if not len(live):
            break
    return np.minimum(out, most)


# ---- runs ----


def runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of consecutive string starts with one anchor: text number, first start (in the text), starts, anchor and run hashes."""
    n, n_grams = len(data), LENGTH - GRAM + 1
    none = {"text": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "count": np.zeros(0, np.int64), "anchor": np.zeros(0, U), "run": np.zeros(0, U)}
    if n < LENGTH:
        return none
    c = textnp.prefix_hash(data, textnp.BYTE)
    places = np.arange(n - GRAM + 1)
    gram = textnp.mixed((c[GRAM:] - c[:-GRAM]) * textnp.powers(textnp.INVERSE, n)[: n - GRAM + 1])
    # hash above, place below: the smallest is the leftmost of the smallest hashes
    low = (gram & U(0xFFFFFFFF00000000)) | places.astype(U)
    size = 1
    while size * 2 <= n_grams:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = n_grams - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & U(0xFFFFFFFF)).astype(np.int64)[: n - LENGTH + 1]
    start = np.arange(n - LENGTH + 1)
    text = np.searchsorted(offsets, start, "right") - 1
    ok = start + LENGTH <= offsets[text + 1]
    start, at, text = start[ok], at[ok], text[ok]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, anchor = start[first], at[first]
    run = textnp.range_hash(c, begin, begin + count + LENGTH - 1) + (anchor - begin).astype(U) * textnp.MULTIPLIERS[13]
    return {"text": text[first], "start": begin - offsets[text[first]], "count": count, "anchor": gram[anchor], "run": textnp.mixed(run)}


def runs_of_texts(data: np.ndarray, offsets: np.ndarray):
    """The runs of all texts, about a block of bytes at a time; a long text is cut into pieces that overlap by LENGTH - 1 bytes.

    A cut may part a run in two. The strings in it are the same, so that is a difference in how they are dealt only.
    """
    for i, j in textnp.blocks(offsets):
        begin, end = int(offsets[i]), int(offsets[j])
        if end - begin <= 2 * textnp.BLOCK:
            r = runs(data[begin:end], offsets[i : j + 1] - begin)
            yield r | {"text": r["text"] + i}
            continue
        for s in range(begin, end, textnp.BLOCK):
            part = data[s : min(end, s + textnp.BLOCK + LENGTH - 1)]
            r = runs(part, np.array([0, len(part)]))
            yield r | {"text": r["text"] + i, "start": r["start"] + (s - begin)}


PLACE = np.dtype([("anchor", "<u4"), ("run", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("count", "u1")])


def _first_of_each(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by run and then place; which of them are the first of their run."""
    p = p[np.lexsort((p["start"], p["doc"], p["run"], p["anchor"]))]
    first = np.ones(len(p), bool)
    first[1:] = (p["run"][1:] != p["run"][:-1]) | (p["anchor"][1:] != p["anchor"][:-1])
    return p, first


MARKS = "doc long, begin int, end int, anchor int, kind int"
#: Kinds of marks: bytes to remove; a run to be sorted with others; one whose strings are dealt out singly.
REMOVE, SORT, SINGLE = 0, 1, 2


def _marks(p: np.ndarray, kind) -> dict:
    return {"doc": pa.array(p["doc"].astype(np.int64)), "begin": pa.array(p["start"].astype(np.int32)), "end": pa.array((p["start"].astype(np.int64) + p["count"] + LENGTH - 1).astype(np.int32)), "anchor": pa.array(p["anchor"].view(np.int32) if p["anchor"].flags["C_CONTIGUOUS"] else np.ascontiguousarray(p["anchor"]).view(np.int32)), "kind": pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(p)))}


def _deal_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, places): each task's runs, one for each of its different runs; bucket -1 holds its own repeats."""

    def dealt(found, bucket):
        p, bucket = np.concatenate(found), np.concatenate(bucket)
        order = np.lexsort((p["start"], p["doc"], p["run"], p["anchor"], bucket))
        p, bucket = p[order], bucket[order]
        again = np.zeros(len(p), bool)
        again[1:] = (p["run"][1:] == p["run"][:-1]) & (p["anchor"][1:] == p["anchor"][:-1]) & (bucket[1:] == bucket[:-1])
        own = p[again]
        p, bucket = p[~again], bucket[~again]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
        out = [(-1 - int(own["doc"][0] % buckets), own.tobytes())] if len(own) else []
        out += [(int(bucket[s]), p[s:e].tobytes()) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "places"])

    def work(batches):
        for b in batches:
            data, offsets = textnp.text_bytes(b.column("text"))
            doc = b.column("doc_id").to_numpy()
            found, bucket = [], []
            for r in runs_of_texts(data, offsets):
                p = np.zeros(len(r["text"]), PLACE)
                p["anchor"], p["run"], p["doc"], p["start"], p["count"] = r["anchor"] & U(0xFFFFFFFF), r["run"], doc[r["text"]], r["start"], r["count"]
                found.append(p)
                bucket.append(((r["anchor"] >> U(32)) % U(buckets)).astype(np.int32))
                if sum(map(len, found)) > DEAL:
                    yield dealt(found, bucket)
                    found, bucket = [], []
            if found:
                yield dealt(found, bucket)

    return docs.mapInArrow(work, "bucket int, places binary")


def _meet(t: pa.Table) -> pa.Table:
    """Marks of a bucket's runs: repeats to remove, and firsts of anchors that have several runs."""
    p = np.frombuffer(b"".join(t.column("places").to_pylist()), PLACE)
    if t.column("bucket")[0].as_py() < 0:
        return pa.table(_marks(p, REMOVE))
    p, first = _first_of_each(p)
    gone, firsts = p[~first], p[first]
    _, of, n = np.unique(firsts["anchor"], return_inverse=True, return_counts=True)
    n = n[of]
    several = firsts[n > 1]
    parts = [_marks(gone, REMOVE), _marks(several, np.where(n[n > 1] > HOT, SINGLE, SORT))]
    return pa.table({k: pa.concat_arrays([x[k] for x in parts]) for k in parts[0]})


# ---- strings of runs ----

PIECE = np.dtype([("doc", "<i8"), ("begin", "<u4"), ("length", "<u4")])


def _deal_pieces(buckets: int):
    """Cuts the marked runs out of their texts: rows (bucket, pieces, data); single strings go by their own hash."""

    def work(batches):
        for b in batches:
            by: dict[int, list] = {}
            for doc, text, marks in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("marks").to_pylist(), strict=True):
                data = memoryview(text.as_buffer())
                for m in marks:
                    if m["kind"] == SORT:
                        by.setdefault(m["anchor"] % buckets, []).append((doc, m["begin"], bytes(data[m["begin"] : m["end"]])))
                    else:
                        for s in range(m["begin"], m["end"] - LENGTH + 1):
                            piece = bytes(data[s : s + LENGTH])
                            by.setdefault(int.from_bytes(hashlib.blake2b(piece, digest_size=6).digest()) % buckets, []).append((doc, s, piece))
            rows = [(k, np.array([(d, s, len(x)) for d, s, x in v], PIECE).tobytes(), b"".join(x for _, _, x in v)) for k, v in by.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "pieces", "data"])

    return work


def repeated_strings(pieces: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, begin, end) of the bytes in pieces that a repeated string covers, in its places but the earliest."""
    lengths = pieces["length"].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    t = np.full(int(lengths.sum()) + len(pieces), END, np.uint8)
    at = begin + np.arange(len(pieces))
    inside = np.ones(len(t), bool)
    inside[at + lengths] = False
    t[inside] = np.frombuffer(data, np.uint8)
    of = np.repeat(np.arange(len(pieces)), lengths + 1)
    place = np.arange(len(t)) - at[of]
    order = suffix_array(t)
    order = order[place[order] + LENGTH <= lengths[of[order]]]
    if len(order) < 2:
        return (np.zeros(0, np.int64),) * 3
    same = common_prefixes(t, order[:-1], order[1:]) >= LENGTH
    group = np.concatenate([[0], np.cumsum(~same)])
    doc, start = pieces["doc"][of[order]], pieces["begin"].astype(np.int64)[of[order]] + place[order]
    by = np.lexsort((start, doc, group))
    later = np.zeros(len(order), bool)
    later[by[1:]] = group[by[1:]] == group[by[:-1]]
    doc, start = doc[later], start[later]
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    if not len(doc):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], start[new], start[last] + LENGTH


def _sort_bucket(t: pa.Table) -> pa.Table:
    pieces = np.frombuffer(b"".join(t.column("pieces").to_pylist()), PIECE)
    doc, begin, end = repeated_strings(pieces, b"".join(t.column("data").to_pylist()))
    return pa.table({"doc": pa.array(doc, pa.int64()), "begin": pa.array(begin.astype(np.int32)), "end": pa.array(end.astype(np.int32))})


def kept_bytes(data, spans) -> tuple[bytes, int, int]:
    """What is left of data without the spans (any order, overlapping), the bytes removed, and the removed runs."""
    out, at, runs_, removed = [], 0, 0, 0
    last = -1
    for b, e in sorted(spans):
        if b > last:
            out.append(data[at:b])
            runs_ += 1
            at = e
            removed += e - b
        elif e > at:
            removed += e - at
            at = e
        last = max(last, at)
    out.append(data[at:])
    return b"".join(out), removed, runs_


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; ids not null and unique) with ``spans``, all places to remove."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), bucket_count(docs, BUCKET))
    marks = scratch.write(_deal_runs(docs, buckets).groupBy("bucket").applyInArrow(_meet, MARKS), "marks")
    # no number of partitions: small ones are put together as measured, and so make few files
    dealt = docs.repartition("doc_id")
    asked = scratch.again(marks).filter(F.col("kind") != REMOVE).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("begin", "end", "anchor", "kind")).alias("marks"))
    pieces = dealt.join(asked, "doc_id").select("doc_id", "text", "marks").mapInArrow(_deal_pieces(buckets), "bucket int, pieces binary, data binary")
    shared = pieces.groupBy("bucket").applyInArrow(_sort_bucket, "doc long, begin int, end int")
    spans = marks.filter(F.col("kind") == REMOVE).select("doc", "begin", "end").union(shared)
    spans = spans.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return dealt.join(spans, "doc_id", "left")


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) of the rows with an id, one for each id; and, where ids repeat, what those stand for: (key, doc_id, text_hash).

    Where ids repeat, rows of different texts get keys of their own in the order of ids (and, within one, of the
    texts' hashes). The keys are numbered in a written table, so that a lost executor changes none.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    if not own.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return own, None
    own = own.withColumn("text_hash", F.xxhash64("text"))
    keys = own.select("doc_id", "text_hash").distinct().orderBy("doc_id", "text_hash").withColumn("key", F.monotonically_increasing_id())
    keys = scratch.write(keys, "keys")
    return own.join(keys, ["doc_id", "text_hash"]).dropDuplicates(["key"]).select(F.col("key").alias("doc_id"), "text"), scratch.again(keys)


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_bytes, n_removed, n_spans, kept) of each document; ``kept`` is the bytes left.

    Every byte covered by a string of LENGTH bytes that also starts earlier (smaller doc_id, or the same document
    and an earlier start) is removed; strings are judged on the texts as they came. Null text: empty. Rows of one
    id with different texts are documents of their own, in the order of their texts' hashes; rows equal in id and
    text are one document. Rows without an id are left out. Empty table: no rows. ``text_hash`` (xxhash64 of the
    text, null as empty) is null where no ids repeat. ``as_text`` gives ``kept`` as a string, without the halves
    of characters that a removed run cut.
    """
    kind = pa.string() if as_text else pa.binary()

    def cut(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                data = memoryview(text.as_buffer())
                kept, removed, n = kept_bytes(data, [(s["begin"], s["end"]) for s in spans or ()])
                rows.append((len(data), removed, n, kept.decode("utf-8", "ignore") if as_text else kept))
            n_bytes, removed, n, kept = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    own, keys = _keyed(docs, Scratch(docs.sparkSession, "keys"))
    done = _with_spans(own).select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    found = ["n_bytes", "n_removed", "n_spans", "kept"]
    if keys is None:
        return done.select("doc_id", F.lit(None).cast("long").alias("text_hash"), *found)
    return done.withColumnRenamed("doc_id", "key").join(keys, "key").select("doc_id", "text_hash", *found)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the passages that came earlier cut out of ``text``; characters cut in half by a removed run are left out.

    All rows stay, even where nothing is left of the text; n_chars, if docs has it, is counted anew where bytes
    went. Rows of one id are cut each by its own text; rows equal in id and text are cut alike. Rows without an id
    pass unchanged. The columns of docs are kept, whatever their names.
    """
    done = Scratch(docs.sparkSession, "repeats").write(remove_repeats(docs.select("doc_id", "text"), as_text=True).filter("n_removed > 0"), "cut")
    id_, hash_, kept = fresh(docs, "cut_id", "cut_hash", "cut_text")
    done = done.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("kept").alias(kept))
    same = (docs["doc_id"].cast("long") == F.col(id_)) & (F.col(hash_).isNull() | (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(hash_)))
    out, cut = docs.join(done, same, "left"), F.col(id_).isNotNull()
    new = {"text": F.when(cut, F.col(kept)).otherwise(docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(kept)).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def dedup_digests(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Rows without an id are left whole."""
    done = remove_repeats(docs).select("doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rest = rows.filter("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    again = rows.filter("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.count("*").alias("c")).filter("c > 1")
    if again.limit(1).count():
        done = done.join(again, ["doc_id", "text_hash"], "left").withColumn("__n", F.explode(F.sequence(F.lit(1), F.coalesce("c", F.lit(1)).cast("int"))))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").union(rest)
