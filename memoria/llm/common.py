"""Helpers shared by the corpus operators: shared storage, table access and native span search."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.sources.shared import shared_folder

NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark so that any store it can reach will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of `df` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def below_share(hashed: Column, share: Column | float) -> Column:
    """True for about that share of 64-bit hashes, however small it is."""
    return hashed.cast("double") / 2.0**64 + 0.5 < share


#: A key that over one in HOT_SHARE of all rows have is hot; rows of hot keys are spread over SPREAD others.
HOT_SHARE, SPREAD = 1000, 997


def joined_by_key(rows: DataFrame, values: DataFrame, key: str, times: str = "times") -> DataFrame:
    """`rows` with the columns of `values` (null where it lacks the key).

    `values` is written already and has each key once, with the number of its rows in `times`. Hot keys, of which there are fewer than
    HOT_SHARE, are broadcast and their rows dealt evenly, so that no task gets all rows of a key; the others meet by hash.
    """
    total = values.agg(F.sum(times)).first()[0] or 0
    others = [c for c in values.columns if c not in (key, times)]
    hot, own, cold = unused(rows, "_hot", "_key", "_cold")
    name = F.concat(F.lit("k"), F.col(key).cast("string"))
    spread = F.concat(F.lit("s"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))
    near = values.filter(F.col(times) * HOT_SHARE > total).select(key, F.struct(*others).alias(hot))
    keyed = rows.join(F.broadcast(near), key, "left").withColumn(own, F.when(F.col(hot).isNotNull(), spread).otherwise(name))
    df = keyed.join(values.select(name.alias(own), F.struct(*others).alias(cold)), own, "left")
    return df.select(*rows.columns, *[F.coalesce(hot, cold)[c].alias(c) for c in others])


#: Bits that `perhaps_in` has for each key, so that about one in so many other rows stays.
KEY_BITS = 16


def perhaps_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose values in the columns of `keys` may be one of the keys: all that are, and few others.

    Bitmaps of the keys' hashes are broadcast, two bytes for each key, so that a join on the same columns needn't shuffle the other rows.
    `keys` is written already.
    """
    n = max(1, keys.count()) * KEY_BITS
    bucket, bits = unused(rows, "_bucket", "_bits")
    at = F.pmod(F.xxhash64(*keys.columns), F.lit(n))
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(maps), bucket)
    return met.filter(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*rows.columns)


SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,score:double>"
NO_SPANS = f"array<{SPAN}>"
RUN = 64
#: Characters of the parts that a text is cut into before many small pieces are taken from it.
PART = 4096


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, the value being made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What the values before each place add up to, and at last all of them; `zero` is neutral.

    Appending copies an array, so the values are taken in runs of about the root of their number, each summed by itself.
    """

    def sums(run: Column, first: Column) -> Column:
        return F.aggregate(run, F.array(first), lambda acc, v: F.array_append(acc, add(F.element_at(acc, -1), v)))

    def from_runs(runs: Column) -> Column:
        starts = sums(F.transform(runs, lambda run: F.aggregate(run, zero, lambda a, v: add(a, v))), zero)
        inner = lambda first, run: F.when(run.isNull(), F.array(first)).otherwise(bound(sums(run, first), lambda x: F.slice(x, F.lit(1), F.size(x) - 1)))
        return F.flatten(F.zip_with(starts, runs, inner))

    def cut(all_: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(RUN))
        runs = F.transform(F.sequence(F.lit(1), F.size(all_), size), lambda i: F.slice(all_, i, size))
        return F.when(F.size(all_) > 0, bound(runs, from_runs)).otherwise(F.array(zero))

    return bound(values, cut)


def parts_of(text: Column) -> Column:
    """The text in parts of PART code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def piece(parts: Column, start: Column, end: Column) -> Column:
    """Code points from `start` to `end` of the text that `parts` are of; only the parts around are read."""
    first = F.floor(start / PART).cast("int")
    some = F.slice(parts, first + 1, F.floor(end / PART).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(some, ""), (start - first * PART + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def regex_spans(text: Column, kind: str, pattern: str, score: float, possible: Column) -> Column:
    """Leftmost non-overlapping matches as spans in code points (end exclusive), with JVM functions only.

    `possible` is a cheap necessary condition; where it is false the pattern is not run.
    Matches and the pieces between them alternate, so positions are running sums of lengths.
    """
    none = F.array().cast(NO_SPANS)
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def spans(of: Column) -> Column:
        lengths = F.zip_with(of["gaps"], of["hits"], lambda gap, hit: F.struct(F.length(gap).cast("bigint").alias("gap"), F.coalesce(F.length(hit), F.lit(0)).cast("bigint").alias("hit")))
        return bound(lengths, lambda ls: F.filter(F.zip_with(of["hits"], with_starts(ls), span_of), lambda s: s["value"].isNotNull()))

    def with_starts(lengths: Column) -> Column:
        ends = running(F.transform(lengths, lambda x: x["gap"] + x["hit"]), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return F.zip_with(lengths, ends, lambda x, at: at + x["gap"])

    def span_of(hit: Column, start: Column) -> Column:
        end = start + F.length(hit).cast("bigint")
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), hit.alias("value"), F.lit(score).alias("score"))

    return F.when(possible & text.rlike(pattern), bound(both, spans)).otherwise(none)


def spans_text(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ordered(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """Spans by kind (in the order of `kinds`) then start, or by start then kind."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])

    def keyed(s: Column) -> Column:
        r = F.element_at(rank, s["kind"])
        first, second = (r.cast("bigint"), s["start"]) if by_kind else (s["start"], r.cast("bigint"))
        return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("c"), s.alias("span"))

    return F.transform(F.array_sort(F.transform(spans, keyed)), lambda x: x["span"])


def apart_from(spans: Column, others: Column) -> Column:
    """The spans (in order of their starts) that overlap none of `others`; in one sweep over both."""
    far = 1 << 62
    key = lambda s, mine, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mine).alias("mine"), i.alias("i"))
    at = F.sort_array(F.concat(F.transform(spans, lambda s, i: key(s, True, i)), F.transform(others, lambda s, i: key(s, False, i))))

    def sweep(all_: Column) -> Column:
        other_end = F.transform(all_, lambda x: F.when(x["mine"], F.lit(0)).otherwise(x["end"]).cast("bigint"))
        other_start = F.reverse(F.transform(all_, lambda x: F.when(x["mine"], F.lit(far)).otherwise(x["start"]).cast("bigint")))
        before = running(other_end, F.lit(0).cast("bigint"), F.greatest)
        behind = F.reverse(F.slice(running(other_start, F.lit(far).cast("bigint"), F.least), F.lit(1), F.size(all_)))
        rows = F.zip_with(F.zip_with(all_, before, lambda x, b: F.struct(x.alias("x"), b.alias("before"))), behind, lambda y, e: F.struct(y["x"].alias("x"), y["before"].alias("before"), e.alias("behind")))
        free = F.filter(rows, lambda y: y["x"]["mine"] & (y["before"] <= y["x"]["start"]) & (y["behind"] >= y["x"]["end"]))
        return F.transform(free, lambda y: F.get(spans, y["x"]["i"]))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), bound(at, sweep)).otherwise(spans)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
