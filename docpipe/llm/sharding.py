"""Sharding by minimax contiguous partition, with DataFrame operations alone.

Equal texts form one atomic group. Groups are laid in the order of their digest, which spreads them evenly over
blocks of that order, so that prefix sums need no sampling and are the same at each run. The smallest shard capacity for
which a greedy pass needs no more than the asked shards is found by bisection in the driver, over ends of blocks; blocks in
which a cut may fall are opened, all at once, into smaller ones and at last into their groups, until no cut falls into a
block that is not open. A group above the capacity takes a shard alone. A departure from cutting where the greedy pass
does: of the cuts that the least capacity allows, those nearest to even shares are taken, so that the last shard is not left
short; no shard exceeds that capacity, which is what makes the partition minimax.

Cases: null texts are one group of size 8 a row; the empty text is another; a very long text is one row of its size; rows
repeated with their id are counted before they are numbered and get slots of their own; a tie between two places for a cut
goes to the earlier one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docpipe.llm.common import table, written

#: Hexadecimal digits of the digest that name a block. The driver holds one offset for each of the 4096.
DIGITS, WHOLE = 3, 32
#: Parts into which the rows of one group are dealt for numbering; rows repeated at once.
SALTS, REPEATED = 1024, 1024
#: Ends of smaller blocks, or of groups, that come to the driver at once.
FETCHED = 100_000


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of numbers as a frame, from a literal."""
    names = [x.split()[0] for x in schema.split(", ")]
    held = json.dumps([dict(zip(names, x, strict=True)) for x in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(held), f"array<struct<{', '.join(x.replace(' ', ':') for x in schema.split(', '))}>>")))


class Line:
    """Ends of groups on the line of bytes, and rows up to them, as far as blocks are open.

    ends[k] is the end of a block of inside[k] groups that begin after ends[k - 1]; asked holds the blocks in which a look
    fell while they were not open, with how far beside it the look may fall once blocks before it are open.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups.select("block", "end_bytes", "end_rows", F.rpad(F.lower(F.hex("gid")), WHOLE, "0").alias("hex"))
        self.ends, self.rows, self.inside, self.keys, self.before = [0], [0], [1], [""], {}
        self.asked: dict[int, int] = {}
        blocks = self.groups.groupBy("block").agg(F.max("end_bytes").alias("b"), F.max("end_rows").alias("r"), F.count("*").alias("n")).collect()  # a row a block
        for x in sorted(blocks, key=lambda x: x["block"]):
            self.before[f"{x['block']:0{DIGITS}x}"] = self.ends[-1], self.rows[-1]
            self.keys.append(f"{x['block']:0{DIGITS}x}")
            self.ends.append(self.ends[-1] + x["b"])
            self.rows.append(self.rows[-1] + x["r"])
            self.inside.append(x["n"])
        self.total, self.total_rows = self.ends[-1], self.rows[-1]

    def offsets(self) -> DataFrame:
        spark = self.groups.sparkSession
        return rows_of(spark, [(int(k, 16), b, r) for k, (b, r) in self.before.items()], "block int, at_bytes long, at_rows long")

    def open(self, asked: dict[int, int]) -> None:
        """Opens blocks and as many beside each as asked: a job for each size of block among them, which is mostly one."""
        wide = sorted({i for k, m in asked.items() for i in range(max(1, k - m), min(len(self.ends), k + m + 1)) if self.inside[i] > 1})
        parts: dict[str, list[tuple[int, int, int, str]]] = {}
        for depth in sorted({len(self.keys[i]) for i in wide}):
            these = [i for i in wide if len(self.keys[i]) == depth]
            deep = WHOLE
            if sum(self.inside[i] for i in these) > FETCHED:
                deep = next(d for d in range(WHOLE, depth, -1) if d == depth + 1 or len(these) * 16 ** (d - depth) <= FETCHED)
            found = self.groups.where(F.substring("hex", 1, depth).isin([self.keys[i] for i in these]))
            found = found.select("end_bytes", "end_rows", F.lit(1).alias("n"), F.col("hex").alias("key")) if deep == WHOLE else found.groupBy(F.substring("hex", 1, deep).alias("key")).agg(F.max("end_bytes").alias("end_bytes"), F.max("end_rows").alias("end_rows"), F.count("*").alias("n"))
            for x in found.collect():  # FETCHED rows, or sixteen a block
                b, r = self.before[x["key"][:DIGITS]]
                parts.setdefault(x["key"][:depth], []).append((b + x["end_bytes"], r + x["end_rows"], x["n"], x["key"]))
        new: list[tuple[int, int, int, str]] = []
        for x in zip(self.ends, self.rows, self.inside, self.keys, strict=True):
            new += sorted(parts.get(x[3], [x]))
        self.ends, self.rows, self.inside, self.keys = map(list, zip(*new, strict=True))

    def look(self, target: int, reach: int) -> tuple[int, int, int, int]:
        """For a target below total: the last known end at or below it, the rows up to that end, the next end and its rows."""
        k = bisect_right(self.ends, target)
        if self.inside[k] > 1:
            self.asked[k] = max(reach, self.asked.get(k, 0))
        return self.ends[k - 1], self.rows[k - 1], self.ends[k], self.rows[k]

    def cuts(self, capacity: int, shards: int, closed: bool = False) -> list[tuple[int, int]] | None:
        """The greedy cuts (bytes, rows), None where shards do not suffice. closed: of blocks as they are, none above the capacity."""
        out, p = [], 0
        while p < self.total:
            if len(out) == shards:
                return None
            if p + capacity >= self.total:
                p, r = self.total, self.total_rows
            else:
                b, r, nb, nr = self.look(p + capacity, len(out) + 1)
                if b <= p and closed and self.inside[bisect_right(self.ends, p + capacity)] > 1:
                    return None
                p, r = (b, r) if b > p else (nb, nr)
            out.append((p, r))
        return out

    def even(self, capacity: int, latest: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Cuts within the same capacity, as near to even as can be.

        A greedy pass from the right gives the earliest place of each cut; each cut then goes to the even share of what
        is left, kept between that place and the reach of the cut before.
        """
        n, earliest = len(latest), [(self.total, self.total_rows)]
        while len(earliest) < n:
            q = earliest[-1][0]
            if q <= capacity:
                earliest.append((0, 0))
                continue
            _, _, b, r = self.look(max(0, q - capacity - 1), len(earliest))  # the first end at or above q - capacity
            earliest.append((b, r) if b < q else self.look(q - 1, len(earliest))[:2])
        earliest.reverse()
        out, at = [], 0
        for j in range(n - 1):
            share = at + max(1, (self.total - at) // (n - j))
            b, r, nb, nr = self.look(share, 1)
            pick = (nb, nr) if b <= at or nb - share < share - b else (b, r)
            if pick[0] - at > capacity:  # a group alone, or the last end within reach
                pick = (b, r) if b > at else (nb, nr)
            out.append(max(pick, earliest[j]))
            at = out[-1][0]
            if at >= self.total:
                return out
        return [*out, (self.total, self.total_rows)]


def least_capacity(total: int, largest: list[int], shards: int) -> int:
    """A bound below: what groups above the capacity leave must fit the shards left. largest: the shards + 1 largest groups."""
    low, high = 1, max(total, 1)
    while low < high:
        c = (low + high) // 2
        giants = [x for x in largest if x > c]
        if len(giants) <= shards and total - sum(giants) <= c * (shards - len(giants)):
            high = c
        else:
            low = c + 1
    return low


def first_that(fits, low: int, high: int) -> int:
    """The least number from low to high that fits; high if none below it does."""
    while low < high:
        c = (low + high) // 2
        low, high = (low, c) if fits(c) else (c + 1, high)
    return low


def minimax_cuts(line: Line, largest: list[tuple[int, str]], shards: int) -> list[tuple[int, int]]:
    """The cuts (bytes, rows) of the least capacity. largest: bytes and digests of the shards + 1 largest groups."""
    if not line.total:
        return []
    base = least_capacity(line.total, [b for b, _ in largest], shards)
    places = {k: i for i, k in enumerate(line.keys)}
    line.open({places[hexed[:DIGITS]]: 0 for b, hexed in largest if b > base})
    while True:
        # What blocks as they are can do, the groups in them can do as well.
        most = first_that(lambda c: line.cuts(c, shards, closed=True) is not None, base, line.total)
        line.asked = {}
        best = first_that(lambda c: line.cuts(c, shards) is not None, base, most)
        cuts = line.cuts(best, shards)
        out = cuts and line.even(best, cuts)
        if not line.asked:
            return out
        line.open(line.asked)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) of docs (doc_id, text): shards of sizes as equal as whole groups allow."""
    text = docs["text"]
    by_id = F.conv(F.substring(F.md5(docs["doc_id"].cast("string")), 1, 3), 16, 10).cast("long")
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        F.coalesce(F.unhex(F.md5(text)), F.unhex(F.lit(""))).alias("gid"),
        F.conv(F.substring(F.coalesce(F.md5(text), F.lit("0" * DIGITS)), 1, DIGITS), 16, 10).cast("int").alias("block"),
        (F.coalesce(by_id, F.monotonically_increasing_id()) % SALTS).cast("int").alias("salt"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows, _ = written(rows, "sized")  # the texts are read once
    in_block = Window.partitionBy("block").orderBy("gid")
    parts = rows.groupBy("block", "gid", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select(
        "block", "gid", "salt", "n",
        F.sum("bytes").over(in_block).alias("end_bytes"),  # equal keys count together: the end of the whole group
        F.sum("n").over(in_block).alias("end_rows"),
        F.sum("bytes").over(Window.partitionBy("block", "gid")).alias("group_bytes"),
        (F.sum("n").over(Window.partitionBy("block").orderBy("gid", "salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("rows_before"),
    )
    parts, _ = written(parts, "shards")
    groups = parts.where("rows_before + n = end_rows")  # the last part of each
    line = Line(groups)
    largest = groups.select("group_bytes", F.rpad(F.lower(F.hex("gid")), WHOLE, "0").alias("hex")).orderBy(F.desc("group_bytes"), "hex").limit(shards + 1).collect()
    cuts = minimax_cuts(line, [(x["group_bytes"], x["hex"]) for x in largest], shards)
    last = F.array(*[F.lit(b) for b, _ in cuts]) if cuts else F.array(F.lit(0))
    first_row = F.array(*[F.lit(r) for r in [0, *[r for _, r in cuts]]])
    placed = parts.join(F.broadcast(line.offsets()), "block").select(
        "gid", "salt",
        F.size(F.filter(last, lambda c: c < F.col("at_bytes") + F.col("end_bytes"))).alias("shard"),
        (F.col("at_rows") + F.col("rows_before")).alias("rows_before"),
    )
    # Rows of one id and text are alike: they are counted, numbered at once and repeated.
    counted = rows.groupBy("gid", "salt", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("gid", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = counted.withColumn("nth", F.sum("n").over(upto) - F.col("n"))
    met = numbered.join(placed, ["gid", "salt"]).withColumn("first", F.col("rows_before") + F.col("nth") - F.element_at(first_row, F.col("shard") + 1))
    many = met.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {REPEATED}"))))
    low = F.col("chunk") * REPEATED
    each = many.withColumn("k", F.explode(F.sequence(low, F.least(F.col("n"), low + REPEATED) - 1)))
    return each.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("k")).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same laws and orders: groups by digest, the least capacity by bisection, even cuts within it.
SQL = """
with recursive d as (select doc_id, coalesce(md5(text), '') as gid, (coalesce(strlen(text), 0) + 8)::bigint as size, text,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 3))::int % 1024 as salt from documents),
g as (select gid, sum(size)::bigint as b, count(*) as n from d group by gid),
ends as materialized (select gid, (sum(b) over (order by gid))::bigint as e from g),
t as (select max(e) as total from ends),
search as (select 1::bigint as lo, total as hi, (1 + total) // 2 as c, 0 as used, 0::bigint as p, total from t union all
  select lo2, hi2, case when over then (lo2 + hi2) // 2 else c end, case when over then 0 else used + 1 end,
    case when over then 0 else coalesce((select max(e) from ends where e <= s.p + s.c and e > s.p), (select min(e) from ends where e > s.p)) end, total
  from (select *, p = total or used = 24 as over, case when p <> total and used = 24 then c + 1 else lo end as lo2, case when p = total then c else hi end as hi2 from search where lo < hi) s),
cap as (select max(lo) as c from search where lo >= hi),
latest as (select 0 as j, 0::bigint as p union all
  select j + 1, coalesce((select max(e) from ends where e <= l.p + (select c from cap) and e > l.p), (select min(e) from ends where e > l.p)) from latest l where p < (select total from t)),
m as (select max(j) as m from latest),
early as (select (select m from m) - 1 as j, total as q from t union all
  select j - 1, case when q <= (select c from cap) then 0 when (select min(e) from ends where e >= y.q - (select c from cap)) < q then (select min(e) from ends where e >= y.q - (select c from cap))
    else coalesce((select max(e) from ends where e < y.q), 0) end from early y where j > 0),
even as (select -1 as j, 0::bigint as p union all
  select j + 1, case when j + 1 = (select m from m) - 1 then (select total from t) else greatest((select q from early where early.j = v.j + 1),
    case when pick - p > (select c from cap) then case when b > p then b else nb end else pick end) end
  from (select *, case when b <= p or nb - share < share - b then nb else b end as pick from
    (select *, coalesce((select max(e) from ends where e <= w.share), 0) as b, (select min(e) from ends where e > w.share) as nb from
      (select j, p, p + greatest(1, ((select total from t) - p) // ((select m from m) - (j + 1))) as share from even where p < (select total from t)) w)) v),
bits as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tbl),
crcs as (select text, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295)::bigint as text_crc32
  from (select distinct text from documents), bits),
placed as (select d.*, (select count(*) from even where j >= 0 and even.p < ends.e)::int as shard from d join ends using (gid))
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by gid, salt, doc_id nulls first) - 1 as slot, null::int as grown_shard
from placed join crcs on placed.text is not distinct from crcs.text
"""
