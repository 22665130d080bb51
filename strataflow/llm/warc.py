"""WARC archives: written by Spark's own writer, read back by verified record boundaries.

Writing. A WARC record ends with two line ends, so Spark's text writer with that as its line separator writes true
archives, to any store that Spark knows, without Python.

Reading. Spark's text reader deals byte ranges of an archive to tasks; with the line that begins a record as its
separator, a row is what stands between two places that look like the start of a record. A payload may hold such
bytes, and a task that starts in the middle of an archive can't tell them from a record. So a task lists for each
place where the next record would start, and follows these links inside its range: what it emits for a candidate is
the place where the chain leaves the range. Pointer jumping over these exits, from the start of every archive, tells
which candidate each range is really entered at; only records on the chain from there are kept. Payloads stay in the
JVM, which digests them; those that hold such bytes, and so are in several rows, are put together once their records
are known to be real.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.common import cut, drop_path, dropped, fresh_path, table

END = "\r\n\r\n"
MAGIC = "WARC/1.1\r\n"
#: Payloads of so many bytes or more are written once.
LEAST_SHARED = 1000
#: A header has so many bytes at most, and is spread over so many byte ranges at most.
HEADER = 1 << 16
RANGES = 8

FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "full_bytes": "X-Payload-Length",
    "length": "Content-Length",
}


def decided(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to; columns of these names are replaced.

    Of equal payloads of LEAST_SHARED bytes at least, the one with the largest key is the response; rows that repeat that
    key are responses too. A null payload is an empty one. A row without a key is a response, or a revisit if its
    payload is that of a row with one. An empty table gives an empty one. Only keys and digests are shuffled; a
    digest shared by any number of rows is summed before.
    """
    added = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    names = [c for c in pages.columns if c not in added or c in (key, payload)]
    flat = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own, body = F.col(f"c{names.index(key)}"), F.encode(F.coalesce(F.col(f"c{names.index(payload)}"), F.lit("")), "UTF-8")
    rows = flat.withColumns({"bytes": F.octet_length(body).cast("long"), "digest": F.sha1(body)})
    shared = rows.where(F.col("bytes") >= LEAST_SHARED).groupBy(F.col("digest").alias("shared"))
    first = shared.agg(F.max(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = cut(first, "warc-shared")
    # Short payloads match nothing; a key of their own keeps equal ones, such as empty pages, from meeting in one task.
    same = F.when(F.col("bytes") >= LEAST_SHARED, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(own.cast("string"), F.lit(""))))
    out = rows.withColumn("same", same).join(first, F.col("same") == F.col("shared"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(own)
    made = (F.col("bytes"), F.col("digest"), F.when(revisit, "revisit").otherwise("response"), F.when(revisit, F.col("first")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *[x.alias(c) for x, c in zip(made, added, strict=True)])


def record(key: Column, url: Column, payload: Column) -> Column:
    """A record as text, without the two line ends that close it."""
    body = F.when(F.col("record_type") == "response", F.coalesce(payload, F.lit(""))).otherwise("")
    safe = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\\x00-\\x20\\x7F]", "")
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: <urn:page:"), safe(key), F.lit(">\r\n"),
        F.when(safe(url) != "", F.concat(F.lit("WARC-Target-URI: "), safe(url), F.lit("\r\n"))).otherwise(""),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), safe(F.col("refers_to")), F.lit(">\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes archives under path, one a task, of any size: they are read by byte ranges. pages carries the columns of decided()."""
    records = pages.select(record(F.col(f"`{key}`"), F.col(f"`{url}`"), F.col(f"`{payload}`")).alias("value"))
    records.write.option("lineSep", END).text(path)


def field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?:^|\r\n){name}[ \t]*:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1)
    return F.when(found != "", found)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """A row for what stands between two starts, in order: archive, range (where it begins), and value."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("range"), "value")


def looked_at(rows: DataFrame) -> DataFrame:
    """pieces() as what a task needs of them: the size, the header, the fields of a well-formed one, and, of a record that
    ends inside its row, whether it is closed and its payload's digest."""
    stop = F.instr("value", END)
    head = F.when(stop > 0, F.substring("value", F.lit(1), stop - 1)).otherwise(F.col("value"))
    df = rows.withColumns({"size": F.octet_length("value").cast("long"), "ended": stop > 0, "head": head})
    df = df.withColumn("head", F.when(F.octet_length("head") <= HEADER, F.col("head")))
    well = F.forall(F.split("head", "\r\n"), lambda x: F.instr(x, ":") > 1)
    found = {n: F.when(F.col("ended") & F.col("well"), field(F.col("head"), x)) for n, x in FIELDS.items()}
    df = df.withColumn("well", well).withColumns(found)
    number = lambda c: F.when(F.col(c).rlike(r"^\d{1,18}$"), F.col(c).cast("long"))
    df = df.withColumns({"length": number("length"), "full_bytes": number("full_bytes"), "body_at": F.octet_length("head").cast("long") + 4})
    fits = F.col("body_at") + F.col("length") + 4 <= F.col("size")
    raw, at, n = F.col("value").cast("binary"), F.col("body_at").cast("int"), F.when(fits, F.col("length")).cast("int")
    closed = F.when(fits, F.substring(raw, at + n + 1, F.lit(4)) == F.lit(END).cast("binary"))
    return df.select(
        "archive", "range", "size", "ended", F.col("head").cast("binary").alias("head"), "body_at", "length",
        closed.alias("closed"), F.when(closed, F.sha1(F.substring(raw, at + 1, n))).alias("body_digest"), *[n for n in FIELDS if n != "length"],
    )


def header(data: bytes) -> dict | None:
    """The fields of a header, by the rules of looked_at()."""
    lines = [x.partition(b":") for x in data.split(b"\r\n")]
    if any(not name or not colon for name, colon, _ in lines):
        return None
    out: dict = {}
    for key, name in FIELDS.items():
        values = [v.strip(b" \t") for n, _, v in lines if n.rstrip(b" \t") == name.encode()]
        out[key] = values[0].decode("utf-8", "replace") if values and values[0] else None
    for key in ("length", "full_bytes"):
        out[key] = int(out[key]) if out[key] and re.fullmatch(r"[0-9]{1,18}", out[key]) else None
    return out if out["length"] is not None else None


#: A row for each start of a record or what looks like one, at a place in its range; `span` is null where there is no record.
#: `part` is a header that the range ends in. One row more tells a range's bytes and what it begins with, up to a header's end.
CANDIDATE = "archive string, range long, place long, span long, exit long, body_at long, body_bytes long, body_digest string, part binary, bytes long, lead binary, record_id string, record_type string, digest string, refers_to string, full_bytes long"
CANDIDATES = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in CANDIDATE.split(", "))])


def list_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CANDIDATE rows of the ranges of a task, whose rows come in order."""
    magic, end = MAGIC.encode(), END.encode()

    def emitted(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in CANDIDATES], schema=CANDIDATES)

    def linked(at: tuple, rows: list[dict], used: int, lead: bytes | None, ended: bool) -> list[dict]:
        exits: dict[int, int] = {}
        for r in reversed(rows):  # links lead forward, so exits are known from the back
            if r["span"] is not None:
                after = r["place"] + r["span"]
                exits[r["place"]] = r["exit"] = exits.get(after, after)
        return [*rows, {"archive": at[0], "range": at[1], "bytes": used, "lead": None if lead is None else lead + (end if ended else b"")}]

    at, rows, used, lead, ended, begun = None, [], 0, b"", False, []
    for batch in batches:
        for x in batch.to_pylist():
            if (x["archive"], x["range"]) != at:
                if at:
                    yield emitted(linked(at, rows, used, lead, ended))
                at, rows, used, lead, ended, begun = (x["archive"], x["range"]), [], 0, b"", False, []
            first = not used
            # Headers that hold the separator go on in this row.
            going, begun = begun, []
            for r, data in going:
                data = None if x["head"] is None else data + magic + x["head"]
                if data is None or len(data) > HEADER:
                    r["part"] = None
                elif x["ended"]:
                    r["part"] = None
                    if found := header(data):
                        r |= {k: v for k, v in found.items() if k != "length"} | {"body_at": len(data) + 4, "body_bytes": found["length"], "span": len(magic) + len(data) + 8 + found["length"]}
                else:
                    r["part"] = data
                    begun.append((r, data))
            if lead is not None and not ended:
                lead = None if x["head"] is None or len(lead) > HEADER else (x["head"] if first else lead + magic + x["head"])
                ended = x["ended"]
            if not (first and x["range"] == 0):
                r = {"archive": at[0], "range": at[1], "place": used - len(magic), "span": None}
                rows.append(r)
                if x["length"] is not None and x["closed"] is not False:
                    r |= {k: x[k] for k in ("record_id", "record_type", "digest", "refers_to", "full_bytes", "body_at", "body_digest")}
                    r |= {"body_bytes": x["length"], "span": len(magic) + x["body_at"] + x["length"] + 4}
                elif not x["ended"] and x["head"] is not None:
                    r["part"] = x["head"]
                    begun.append((r, x["head"]))
            used += x["size"] + len(magic)
    if at:
        yield emitted(linked(at, rows, used, lead, ended))


def continued(found: DataFrame) -> DataFrame:
    """found with the headers that a range ends in, completed by what the next ranges begin with."""
    parts = found.where(F.col("part").isNotNull())
    if parts.isEmpty():
        return found
    ahead = Window.partitionBy("archive").orderBy("range").rowsBetween(1, RANGES)
    leads = found.where(F.col("bytes").isNotNull()).select("archive", "range", F.collect_list("lead").over(ahead).alias("leads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                data, r = x["part"], x | {"part": None}
                for lead in x["leads"]:
                    # The next range begins right after a separator.
                    data += MAGIC.encode() + lead
                    if lead.endswith(END.encode()) or len(data) > HEADER:
                        break
                if data.endswith(END.encode()) and len(data) <= HEADER and (known := header(data[:-4])):
                    after = len(MAGIC) + len(data) + known["length"] + 4
                    r |= {k: v for k, v in known.items() if k != "length"} | {"body_at": len(data), "body_bytes": known["length"], "span": after, "exit": r["place"] + after}
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in CANDIDATES], schema=CANDIDATES)

    whole = parts.join(leads, ["archive", "range"]).select(*CANDIDATES.names, "leads").mapInArrow(run, CANDIDATE)
    return found.where(F.col("part").isNull()).union(whole)


def placed(found: DataFrame) -> DataFrame:
    """found with `at`, the place in the archive: a range's bytes before it, summed over ranges. exit and next are such places too."""
    before = Window.partitionBy("archive").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.where(F.col("bytes").isNotNull()).select("archive", "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    rows = found.where(F.col("place").isNotNull()).drop("part", "bytes", "lead").join(sizes, ["archive", "range"])
    moved = {n: F.col("base") + c for n, c in (("at", F.col("place")), ("exit", F.col("exit")), ("next", F.col("place") + F.col("span")))}
    return rows.withColumns(moved).drop("base")


def entries(links: DataFrame) -> DataFrame:
    """The (archive, at) where each range is entered, by pointer jumping from every archive's start.

    links: (archive, at, exit), the candidates that some chain enters a range at. Each round doubles
    the reach of the jumps and adds what the places reached so far lead to, so rounds are about the
    logarithm of an archive's ranges.
    """
    jump = links.select("archive", "at", F.col("exit").alias("to"))
    reached = jump.where(F.col("at") == 0).select("archive", "at")
    count = reached.count()
    while True:
        step = reached.join(jump, ["archive", "at"]).select("archive", F.col("to").alias("at")).join(links.select("archive", "at"), ["archive", "at"], "left_semi")
        wider = cut(reached.union(step).distinct(), "warc-reached")
        dropped(reached)
        new = wider.count()
        if new == count:
            dropped(jump)
            return wider
        reached, count = wider, new
        far = jump.select("archive", F.col("at").alias("to"), F.col("to").alias("further"))
        longer = cut(jump.join(far, ["archive", "to"], "left").select("archive", "at", F.coalesce("further", "to").alias("to")), "warc-jump")
        dropped(jump)
        jump = longer


def walked(found: DataFrame, entered: DataFrame) -> DataFrame:
    """(archive, range, at, real) of every place in a range from where it is entered: whether it is on the chain.

    A range's places stream in order through one task, which holds nothing but the next place of the chain.
    """
    into = entered.join(found.select("archive", "range", "at"), ["archive", "at"]).select("archive", "range", F.col("at").alias("entry"))
    rows = found.select("archive", "range", "at", "next").join(into, ["archive", "range"]).where(F.col("at") >= F.col("entry"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, due = None, None
        for batch in batches:
            real = np.zeros(batch.num_rows, bool)
            columns = (batch.column(i).to_pylist() for i in range(4))
            for i, (archive, begin, at, after) in enumerate(zip(*columns, strict=True)):
                if (archive, begin) != where:
                    where, due = (archive, begin), at
                if at == due:
                    real[i], due = after is not None, after
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(real)], names=["archive", "range", "at", "real"])

    rows = rows.select("archive", "range", "at", "next").repartition("archive", "range").sortWithinPartitions("archive", "range", "at")
    return rows.mapInArrow(run, "archive string, range long, at long, real boolean")


def put_together(spark: SparkSession, path: str, found: DataFrame, kept: DataFrame) -> DataFrame:
    """(archive, at, body_digest) of the kept records that hold separators: null for those that aren't closed.

    A range's rows belong to the last such record that starts before them, in it or in an earlier range.
    """
    wide = kept.where(F.col("body_digest").isNull()).select("archive", "range", "at", F.struct("at", "next", "body_at", "body_bytes").alias("owner"))
    order = Window.partitionBy("archive", "range").orderBy("at")
    marked = found.select("archive", "range", "at", "place").join(wide, ["archive", "range", "at"], "left")
    marked = marked.withColumn("own", F.last("owner", True).over(order))
    ranges = found.select("archive", "range").distinct().join(wide.groupBy("archive", "range").agg(F.max("owner").alias("last")), ["archive", "range"], "left")
    earlier = Window.partitionBy("archive").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("archive", "range", F.last("last", True).over(earlier).alias("carried"))
    owned = marked.join(carried, ["archive", "range"]).withColumn("owner", F.coalesce("own", "carried"))
    needed = cut(owned.where(F.col("at") < F.col("owner.next")).select("archive", "range", "place", "at", "owner"), "warc-needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, used = None, 0
        for batch in batches:
            places = []
            for archive, begin, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (archive, begin) != where:
                    where, used = (archive, begin), 0
                places.append(used - len(MAGIC))
                used += size + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.int64()), batch.column(3)], names=["archive", "range", "place", "value"])

    raw = pieces(spark, path).select("archive", "range", F.octet_length("value"), F.col("value").cast("binary").alias("value"))
    raw = raw.mapInArrow(run, "archive string, range long, place long, value binary").join(needed, ["archive", "range", "place"])
    one = raw.groupBy("archive", "owner").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("string").alias("value")))).alias("rows"))
    data = F.array_join(F.transform("rows", lambda r: r["value"]), MAGIC).cast("binary")
    start, n = F.col("owner.body_at").cast("int"), F.col("owner.body_bytes")
    fits = F.octet_length("data") >= F.col("owner.body_at") + n + 4
    closed = F.when(fits, F.substring("data", start + n.cast("int") + 1, F.lit(4)) == F.lit(END).cast("binary"))
    digest = F.when(closed, F.sha1(F.substring("data", start + 1, n.cast("int"))))
    return one.withColumn("data", data).select("archive", F.col("owner.at").alias("at"), digest.alias("body_digest"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: archive, at, record_id, record_type, digest, refers_to, full_bytes,
    and body_bytes and body_digest of the payload as stored, which may have 2 GB.

    Bytes inside payloads that look like records are left out; so are a damaged record and all that follows it in its
    archive. Empty archives hold nothing; no archives at all are an error of the reader's. Nothing depends on an archive's size.
    """
    listed = cut(looked_at(pieces(spark, path)).mapInArrow(list_candidates, CANDIDATE), "warc-listed")
    found = cut(placed(continued(listed)), "warc-candidates")
    dropped(listed)
    # Only a candidate that a chain can enter a range at matters between ranges: the first of an archive, or some exit.
    linked = found.where(F.col("span").isNotNull())
    into = linked.select("archive", F.col("exit").alias("at")).distinct()
    own = linked.select("archive", "at", "exit")
    links = cut(own.join(into, ["archive", "at"], "left_semi").union(own.where("at = 0")).distinct(), "warc-links")
    entered = entries(links)
    real = walked(found, entered).where("real").select("archive", "range", "at")
    kept = cut(found.join(real, ["archive", "range", "at"], "left_semi"), "warc-kept")
    dropped(links, entered)
    columns = ["archive", "at", "record_id", "record_type", "digest", "refers_to", "full_bytes", "body_bytes", "body_digest"]
    if kept.where(F.col("body_digest").isNull()).isEmpty():
        dropped(found)
        return kept.select(*columns)
    made = cut(put_together(spark, path, found, kept), "warc-joined")
    dropped(found)
    damaged = made.where(F.col("body_digest").isNull()).groupBy("archive").agg(F.min("at").alias("stop"))
    out = kept.join(made.withColumnRenamed("body_digest", "joined"), ["archive", "at"], "left").join(damaged, ["archive"], "left")
    out = out.where(F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    return out.withColumn("body_digest", F.coalesce("body_digest", "joined")).select(*columns)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; what is returned comes from the archives alone.

    A null html is an empty payload. Repeated page ids come back as often as they are there; a null one as null.
    """
    path = fresh_path(spark, "warc")
    write(decided(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "html"), path)
    back = read(spark, path)
    drop_path(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    stored = F.col("record_type") == "response"
    return back.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(stored, F.col("body_bytes")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
        F.when(stored, F.col("body_digest")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
