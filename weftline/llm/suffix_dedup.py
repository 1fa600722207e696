"""Exact removal of repeated byte strings with suffix arrays built by linear grouping.

Every string of ``SPAN`` bytes has one selected k-gram (the one of smallest hash),
so equal strings meet under the same key. The strings a k-gram is selected for
form one stretch of text. Each stretch is cut down to what some other stretch of its
key has on the same side of the k-gram; a suffix array sorts what is left, and its
neighbours tell which strings occur twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._rolling import BYTES, once, smallest, spans, windows
from weftline.llm._rows import id_type, one_row_per_id, per_document, signed
from weftline.llm._spark import checkpoint, partitions

SPAN = 200
GRAM = 50
BLOCK = 1000  # stretches in one suffix array; those of a key with more are cut down and made distinct first, and if they still are more, split into blocks, each with a suffix array, whose classes of strings are matched by their bytes


def suffix_array(text) -> list[int]:
    """The suffixes of a sequence of integers in ascending order (a shorter one before its extensions).

    First, suffixes are grouped by their longest Lyndon prefix: groups are taken in
    descending order; each suffix of a group points to the nearest suffix before it
    in a lower group, whose prefix grows by the group's own, so it moves to a new
    group just above its old one. Then groups are emitted in ascending order: a
    suffix that follows its Lyndon prefix is smaller, so it is out already and has
    put the suffix in its place.
    """
    n = len(text)
    letters = sorted(set(text))
    number = {c: k for k, c in enumerate(letters)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(letters)  # of the Lyndon prefix
    lower, higher = list(range(-1, len(letters) - 1)), [*range(1, len(letters)), -1]
    left = list(range(n + 1))  # left[i + 1]: i + 1 while suffix i waits, later a step to the nearest waiting one before it
    top, descending = len(letters) - 1, []
    while top >= 0:
        now = [i for i in members[top] if group[i] == top]
        if len(now) == 1:  # most groups; as below
            i = p = now[0]
            left[i + 1] = i
            while left[p] != p:
                left[p] = p = left[left[p]]
            if p:
                g, made = group[p - 1], len(size)
                size.append(size[g] + size[top])
                members.append([p - 1])
                group[p - 1] = made
                up = higher[g]
                lower.append(g)
                higher.append(up)
                lower[up] = higher[g] = made
            descending.append(top)
            top = lower[top]
            continue
        for i in now:
            left[i + 1] = i
        times: dict[int, int] = {}
        for i in now:
            p = i
            while left[p] != p:
                left[p] = p = left[left[p]]
            if p:
                times[p - 1] = times.get(p - 1, 0) + 1
        new: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            new.setdefault((group[p], k), []).append(p)
        for (g, k), grown in sorted(new.items(), key=lambda x: -x[0][1]) if len(new) > 1 else new.items():
            made = len(size)  # just above its old group; with fewer repeats, below those with more
            size.append(size[g] + k * size[top])
            members.append(grown)
            for p in grown:
                group[p] = made
            up = higher[g]
            lower.append(g)
            higher.append(up)
            lower[up], higher[g] = made, made
        descending.append(top)
        top = lower[top]
    follows: list[list[int]] = [[] for _ in range(n + 1)]
    for i, g in enumerate(group):
        follows[i + size[g]].append(i)
    placed: list[list[int]] = [[] for _ in size]
    out = []
    for i in follows[n]:
        placed[group[i]].append(i)
    for g in reversed(descending):
        row = placed[g]
        for j in row:  # grows on the way: a suffix can place another one of its group
            for i in follows[j]:
                placed[group[i]].append(i)
        out += row
    return out


def classes(stretches: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of ``span`` bytes of the stretches: its stretch, its start, and the number of its class of equal strings."""
    text = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.int16) + 1, 0) for x in stretches])
    which = np.repeat(np.arange(len(stretches)), [len(x) + 1 for x in stretches])
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in stretches])])[:-1]
    order = np.array(suffix_array(text.tolist()), np.int64)
    start = order - begin[which[order]]
    size = np.array([len(x) for x in stretches])
    order = order[start + span <= size[which[order]]]
    new = np.ones(len(order), bool)
    strings = np.lib.stride_tricks.sliding_window_view(text, span)
    for k in range(1, len(order), 20_000):
        a = order[k - 1 : k + 19_999]
        new[k : k + len(a) - 1] = (strings[a[1:]] != strings[a[:-1]]).any(axis=1)
    return which[order], order - begin[which[order]], np.cumsum(new) - 1


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _anchors(text: bytes, span: int, gram: int):
    data = np.frombuffer(text, np.uint8)
    grams = windows(BYTES[data], gram)
    return data, grams, smallest(grams, span - gram + 1)


RANGE = "key long, stretch long, start int, stop int, string binary, shared boolean"


def _common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share from their start."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def shared_parts(stretches: list[bytes], leads: list[int], gram: int) -> list[tuple[int, int]]:
    """For each stretch the range around its k-gram (which starts at its lead) beyond which no other stretch agrees.

    Strings that are equal have the k-gram at the same place, so those that a stretch
    shares with another lie within what the two have in common on either side of it.
    """
    most = []
    for sides in ([x[:k][::-1] for x, k in zip(stretches, leads, strict=True)], [x[k + gram :] for x, k in zip(stretches, leads, strict=True)]):
        order = sorted(range(len(sides)), key=sides.__getitem__)  # of sorted strings, neighbours share most
        most.append([0] * len(sides))
        for a, b in zip(order, order[1:], strict=False):
            n = _common(sides[a], sides[b])
            most[-1][a], most[-1][b] = max(most[-1][a], n), max(most[-1][b], n)
    return [(k - before, k + gram + after) for k, before, after in zip(leads, *most, strict=True)]


def _match(batches, span: int, gram: int):
    """Rows (key, salt, salted, stretch, content, lead, times), sorted by key and salt, to ranges of repeated strings of each stretch.

    Stretches with a lead are cut down here; ``times``: how often one occurs. A key in
    one block is settled there. For a key of several blocks each class of the block
    also gives one row with its string, to be matched byte for byte across the
    blocks: ``shared`` says that it is settled already.
    """
    names = [x.split(" ")[0] for x in RANGE.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]

    def settle(key, salted, ids, contents, leads, times):
        parts = [(0, len(x)) for x in contents] if leads[0] is None else shared_parts(contents, leads, gram)
        many: dict[bytes, int] = {}
        for x, (a, z), n in zip(contents, parts, times, strict=True):
            if z - a >= span:
                many[x[a:z]] = many.get(x[a:z], 0) + n
        if not many:
            return
        pieces = list(many)
        which, start, kind = classes(pieces, span)
        twice = np.bincount(kind, np.array([*many.values()])[which])[kind] > 1
        flags = {}
        for k, piece in enumerate(pieces):
            flags[piece] = np.zeros(len(piece) - span + 1, bool)
            flags[piece][start[(which == k) & twice]] = True
        for k, (a, z) in enumerate(parts):
            if z - a >= span:
                for lo, hi in zip(*_runs(flags[contents[k][a:z]]), strict=True):
                    yield key, ids[k], a + lo, a + hi, None, True
        if salted:  # contents are distinct and whole here, so they are the pieces
            _, at = np.unique(kind, return_index=True)
            for k in at:
                string = pieces[which[k]][start[k] : start[k] + span]
                yield key, ids[which[k]], start[k], start[k] + 1, string, bool(twice[k])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    held, was, group, rows = None, False, [], []
    for b in batches:
        for key, salt, salted, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (key, salt) != held:
                if held is not None:
                    rows += settle(held[0], was, *map(list, zip(*group, strict=True)))
                held, was, group = (key, salt), salted, []
            group.append(row)
        if len(rows) >= 20_000:
            yield batch(rows)
            rows = []
    if held is not None:
        rows += settle(held[0], was, *map(list, zip(*group, strict=True)))
    if rows:
        yield batch(rows)


def _cut(hot: DataFrame, gram: int) -> DataFrame:
    """key, stretch, shift, piece: the stretches (key, stretch, content, lead) of frequent keys, cut down as by ``shared_parts``.

    No task sees a whole key: rows are put in order by range, for each side of the
    k-gram in turn, and a row is held against its neighbours in the part. The first
    and last row of a part, whose neighbours are elsewhere, keep that side whole.
    """
    n = partitions(hot.sparkSession)

    def most(side: str):
        def run(batches):
            before, waiting = None, None  # the row before, and the bytes it shares with the one before it (None: unknown)

            def out(rows):
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], ["key", "stretch", side])

            for b in batches:
                made = []
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if before is not None:
                        n = _common(before[2], row[2]) if before[0] == row[0] else 0
                        made.append((*before[:2], len(before[2]) if waiting is None else max(waiting, n)))
                        waiting = n
                    before = row
                if made:
                    yield out(made)
            if before is not None:
                yield out([(*before[:2], len(before[2]))])

        return run

    split = hot.select("key", "stretch", "lead", F.expr("substring(content, 1, lead)").alias("head"), F.expr(f"substring(content, lead + {gram + 1})").alias("tail"), "content")
    found = hot
    for side, text in (("left", F.expr("unhex(array_join(reverse(regexp_extract_all(hex(head), '..', 0)), ''))")), ("right", F.col("tail"))):
        rows = checkpoint(split.select("key", "stretch", text.alias("side")))
        dealt = rows.repartitionByRange(n, "key", "side", "stretch").sortWithinPartitions("key", "side", "stretch")
        found = found.join(checkpoint(dealt.mapInArrow(most(side), f"key long, stretch long, {side} int"), rows), ["key", "stretch"])
    return found.select("key", "stretch", (F.col("lead") - F.col("left")).alias("shift"), F.expr(f"substring(content, lead - left + 1, left + {gram} + right)").alias("piece"))


def repeated_strings(documents: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, starts, stops: ranges of the places (in bytes) of strings of ``span`` bytes that also start elsewhere.

    Of documents only doc_id and text are used. Null and empty texts have no strings;
    where an id has several rows the greatest text stands for it; a null id is an id.
    """
    docs, kind = one_row_per_id(documents), id_type(documents)
    docs = docs.where(F.octet_length("text") >= span)

    def anchors(text: bytes):
        _, grams, at = _anchors(text, span, gram)
        at = once(at)
        return signed(grams[at]), at.astype(np.int32)

    def stretches(text: bytes, kept: np.ndarray):
        data, grams, at = _anchors(text, span, gram)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        stop = np.append(first[1:], len(at)) + span - 1
        good = np.isin(at[first], kept)
        first, stop = first[good], stop[good]
        return signed(grams[at[first]]), signed(spans(BYTES[data], first, stop)), first.astype(np.int32), (stop - first - span + 1).astype(np.int32), (at[first] - first).astype(np.int32)

    def contents(text: bytes, keys: np.ndarray, ids: np.ndarray, starts: np.ndarray, strings: np.ndarray, leads: np.ndarray):
        cut = np.empty(len(keys), object)
        cut[:] = [text[a : a + n + span - 1] for a, n in zip(starts.tolist(), strings.tolist(), strict=True)]
        return keys, ids, cut, leads

    rows = checkpoint(docs.mapInArrow(lambda b: per_document(b, anchors, ["doc_id", "key", "pos"]), f"doc_id {kind}, key long, pos int"))
    keys = checkpoint(rows.groupBy("key").count().where("count > 1").select("key"))  # written: Spark splits a frequent key only where both sides of a join are shuffled for it
    kept = checkpoint(rows.join(keys, "key").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("pos").alias("kept")), rows, keys)
    with_kept = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "kept")
    names = ["doc_id", "key", "stretch", "start", "strings", "lead"]
    found = checkpoint(with_kept.mapInArrow(lambda b: per_document(b, stretches, names), f"doc_id {kind}, key long, stretch long, start int, strings int, lead int"), kept)

    each = found.groupBy("key", "stretch").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "start", "strings", "lead")).alias("one"))
    each = checkpoint(each)
    several = checkpoint(each.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    whole = each.where("times > 1").select("key", "stretch", F.lit(0).alias("lo"), F.col("one.strings").alias("hi"))
    asked = each.join(several, "key").groupBy(F.col("one.doc_id").alias("_id")).agg(*[F.collect_list(c).alias(f"_{k}") for k, c in enumerate(("key", "stretch", "one.start", "one.strings", "one.lead"))])
    asked = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "_0", "_1", "_2", "_3", "_4")
    distinct = checkpoint(asked.mapInArrow(lambda b: per_document(b, contents, ["doc_id", "key", "stretch", "content", "lead"]), f"doc_id {kind}, key long, stretch long, content binary, lead int").select("key", "stretch", "content", "lead"))
    frequent = several.where(F.col("kinds") > block).select("key")
    cut = checkpoint(_cut(distinct.join(frequent, "key"), gram).where(F.octet_length("piece") >= span).withColumn("piece_hash", F.xxhash64("piece")))
    pieces = checkpoint(cut.groupBy("key", "piece_hash").agg(F.first("piece").alias("content"), F.count("*").cast("int").alias("times")))
    blocks = checkpoint(pieces.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    salt = F.pmod(F.xxhash64("piece_hash"), F.col("blocks")).cast("int")
    hot = pieces.join(blocks, "key").select("key", salt.alias("salt"), (F.col("blocks") > 1).alias("salted"), F.col("piece_hash").alias("stretch"), "content", F.lit(None).cast("int").alias("lead"), "times")
    few = distinct.join(frequent, "key", "left_anti").select("key", F.lit(0).alias("salt"), F.lit(False).alias("salted"), "stretch", "content", "lead", F.lit(1).alias("times"))

    def settled(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(partitions(documents.sparkSession), "key", "salt").sortWithinPartitions("key", "salt")
        return checkpoint(dealt.mapInArrow(lambda b: _match(b, span, gram), RANGE))

    matched, matched_hot = settled(few), settled(hot)
    across = matched_hot.where("string is not null")
    twice = checkpoint(across.groupBy("key", "string").count().where("count > 1").drop("count"))
    named = F.col("key"), F.col("stretch"), F.col("start").alias("lo"), F.col("stop").alias("hi")
    of_pieces = matched_hot.where("string is null").select(*named).unionByName(across.where("not shared").join(twice, ["key", "string"]).select(*named))
    of_pieces = checkpoint(of_pieces.withColumnRenamed("stretch", "piece_hash"))
    of_hot = cut.select("key", "stretch", "shift", "piece_hash").join(of_pieces, ["key", "piece_hash"]).select("key", "stretch", (F.col("shift") + F.col("lo")).alias("lo"), (F.col("shift") + F.col("hi")).alias("hi"))
    ranges = checkpoint(whole.unionByName(matched.select(*named)).unionByName(of_hot), each, several, distinct, cut, pieces, blocks, matched, matched_hot, twice, of_pieces)
    places = found.select("doc_id", "key", "stretch", "start").join(ranges, ["key", "stretch"])
    places = places.groupBy("doc_id").agg(F.collect_list(F.col("start") + F.col("lo")).alias("starts"), F.collect_list(F.col("start") + F.col("hi")).alias("stops"))
    return checkpoint(places, found, ranges)


def deduplicate(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, kept (binary: the bytes left), n_bytes, n_removed, spans (array of start, stop of the removed runs).

    One row per id, see ``repeated_strings``; an empty table gives no rows.
    """
    places = repeated_strings(documents, span).withColumnRenamed("doc_id", "_id")
    docs = one_row_per_id(documents).join(places, F.col("doc_id").eqNullSafe(F.col("_id")), "left")

    def run(batches):
        for b in batches:
            out = []
            for text, starts, stops in zip(b.column(1), b.column(2), b.column(3), strict=True):
                data = text.as_py().encode()
                if not starts.is_valid:
                    out.append((data, len(data), 0, []))
                    continue
                edge = np.zeros(len(data) + span + 1, np.int32)
                np.add.at(edge, np.asarray(starts.values), 1)
                np.add.at(edge, np.asarray(stops.values) + span - 1, -1)
                gone = np.cumsum(edge[: len(data)]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((kept, len(data), int(gone.sum()), [{"start": a, "stop": z} for a, z in zip(*(x.tolist() for x in _runs(gone)), strict=True)]))
            kept, n, removed, runs = zip(*out, strict=True) if out else ([], [], [], [])
            runs = pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), runs], ["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    schema = f"doc_id {id_type(documents)}, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>"
    return docs.select("doc_id", "text", "starts", "stops").mapInArrow(run, schema)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicate(documents).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
